"""Tokens against the tokenizer library, and counts that follow edits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from splitscope.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPLIT = regex.compile(public_tokenizers.PATTERN).findall
def lengths(pieces):
    return [len(p) for p in pieces]


ALPHABETS = ["abc", "the ing\n\t  ", " \n\r\t", "éüñ日本語😀", "0123456789", "aAbB_!?%$", "tttheeerr's "]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.split_table(PATH))


@pytest.fixture(scope="module")
def library(encoder):
    ranks = {t: i for i, t in enumerate(encoder.tokens)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(rnd.choice(ALPHABETS)) for _ in range(rnd.randint(0, 90))) for _ in range(n)]


def test_ids_are_those_of_the_library(encoder, library):
    for text in [*_texts(1500, 1), "z" * 3000, " " * 500, "ab" * 400]:
        ids = encoder.encode(SPLIT(text))
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_appends_and_edits_leave_the_table_of_the_whole(encoder):
    rnd = random.Random(2)
    for _ in range(300):
        piece = bytes(rnd.choices(b"theingator \xc3\xa9", k=rnd.randint(0, 150)))
        cut = rnd.randint(0, len(piece))
        table = bpe.Prefixes(encoder, piece[:cut])
        table.append(piece[cut:])
        assert table.last == bpe.Prefixes(encoder, piece).last
        start = rnd.randint(0, len(piece))
        end = rnd.randint(start, len(piece))
        table.replace(start, end, b"tion")
        assert table.last == bpe.Prefixes(encoder, piece[:start] + b"tion" + piece[end:]).last


def test_query_rows(make_docs, odd_rows, library):
    docs = make_docs(odd_rows, clash=True)
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for r in odd_rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.token_ids(docs, PATH, public_tokenizers.PATTERN).columns[-2:] == ["token_ids", "n_tokens"]
    assert bpe.digests(docs.filter("false"), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("fan", [1, 3, 64])
def test_edited_counts_are_those_of_the_edited_text(fan, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN", fan)
    rnd = random.Random(fan)
    for _ in range(500):
        alphabet = rnd.choice([" ab\n", " a", "  \n\tb1", "a'st .ré1"])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        counted = token_counts.CountedText(text, SPLIT, lengths)
        for _ in range(4):
            start = rnd.randint(0, len(text))
            end = rnd.randint(start, min(len(text), start + rnd.choice([0, 3, 30])))
            new = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 6)))
            text = text[:start] + new + text[end:]
            counted.edit(start, end, new)
            assert list(counted.root.walk(0)) == SPLIT(text) and counted.text == text
            assert counted.tokens == len(text) and counted.root.count == len(SPLIT(text))


def test_an_edit_of_a_long_text_touches_little():
    counted = token_counts.CountedText("word " * 20000, SPLIT, lengths)
    counted.edit(50_000, 50_004, "other")
    assert counted.reencoded < 20


def test_counts_through_redactions(make_docs, odd_rows, library):
    mail = (20, "call 055 123 4567 or write to some.one@example.org now, id 12345")
    docs = make_docs([*odd_rows, mail], clash=True)
    rows = token_counts.counts_through_edits(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(odd_rows) + 1
    own = next(r for r in rows if r["doc_id"] == 20)
    text = mail[1]
    for start, end, new in reversed(token_counts.redactions(text)):
        text = text[:start] + new + text[end:]
    assert text == "call <number> or write to <mail> now, id <number>"
    assert own["n_edits"] == 3
    assert (own["n_tokens"], own["n_tokens_after"]) == (len(library.encode_ordinary(mail[1])), len(library.encode_ordinary(text)))
    assert own["n_pretokens_after"] == len(SPLIT(text))
    assert all(r["n_tokens"] == 0 for r in rows if r["doc_id"] in (3, 4))

"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from splitscope.llm import periodic_runs as pr
from splitscope.llm import queries


def brute_runs(words, exponent, least):
    """All maximal stretches with their smallest period, period by period."""
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                length = j + q - i
                inside = any(s <= i and i + length <= s + m for s, m, p in out if p < q)
                if length >= max(least, exponent * q) and not inside:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def sequences():
    rnd = random.Random(1)
    for size in (1, 2, 3, 50):
        for _ in range(60):
            yield [rnd.randrange(size) for _ in range(rnd.randint(0, 60))]
    for _ in range(60):
        words = []
        while len(words) < 150:
            part = [rnd.randrange(4) for _ in range(rnd.randint(1, 20))]
            words += (part * rnd.randint(1, 6))[: rnd.randint(1, 90)]
        yield words
    fibonacci = ([0], [0, 1])
    for _ in range(9):
        fibonacci = (fibonacci[1], fibonacci[1] + fibonacci[0])
    yield fibonacci[1]
    yield [bin(i).count("1") % 2 for i in range(256)]
    yield [0] * 300


def _words(values):
    return np.array(values, np.int64).view(np.uint64)


@pytest.mark.parametrize(("exponent", "least"), [(2, 0), (3, 0), (4, 6)])
def test_runs_are_those_of_every_period(exponent, least):
    for values in sequences():
        catcher = pr.SquareCatcher(exponent, least)
        catcher.append(_words(values))
        assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(values, exponent, least), values


def test_words_may_come_in_any_pieces():
    rnd = random.Random(2)
    for k, values in enumerate(sequences()):
        if k % 4:
            continue
        catcher, at = pr.SquareCatcher(4 if k % 8 else 2, 0), 0
        while at < len(values):
            step = 1 if k % 3 else rnd.randint(1, 40)
            catcher.append(_words(values[at : at + step]))
            at += step
        assert [tuple(r) for r in catcher.runs().tolist()] == brute_runs(values, catcher.exponent, 0), values


def test_long_sequences_of_few_runs():
    rng = np.random.default_rng(3)
    part = rng.integers(0, 1000, 2500)
    words = np.concatenate([rng.integers(0, 1000, 777), np.tile(part, 5)[:11_000], rng.integers(0, 1000, 40), np.zeros(30_000, np.int64)])
    words[777 + 11_000], words[776], words[-30_001] = 2000, 2001, 2002
    catcher = pr.SquareCatcher(4, 6)
    catcher.append(_words(words))
    assert catcher.runs().tolist() == [[777, 11_000, 2500], [len(words) - 30_000, 30_000, 1]]


def _contract(doc_id, text):
    """The query's row, told plainly."""
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 4, 6)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_digests_of_odd_rows(make_docs, odd_rows):
    rnd = random.Random(4)
    rows = [(100 + i, " ".join(rnd.choices("ab", k=rnd.randint(0, 80)))) for i in range(80)]
    rows += [(300 + i, "\n".join(f"w{rnd.randrange(300)}" for _ in range(400))) for i in range(40)]
    docs = [r[:2] for r in odd_rows if len(r[1] or "") < 1000] + rows + [(400, "é ñ é ñ é ñ é ñ é"), (401, "A a A a A a A a")]
    got = pr.digests(make_docs(docs, clash=True), rewrite=queries.repeated_tail).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(_contract(*r)) for r in docs)
    assert any(r["n_runs"] for r in got if (r["doc_id"] or 0) >= 300)


def test_runs_and_collapsed_texts(make_docs, monkeypatch):
    monkeypatch.setattr(pr, "CHUNK", 30)
    rows = [(1, "x a b a b a b a b y"), (2, None), (3, "z z z z z z"), (None, "  p\tq "), (5, "z z z z z")]
    got = {r["doc_id"]: r for r in pr.periodic_runs(make_docs(rows)).collect()}
    assert got[1]["collapsed"] == "x a b y" and [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)]
    assert got[3]["collapsed"] == "z" and [tuple(x) for x in got[3]["runs"]] == [(0, 6, 1)]
    assert got[2]["collapsed"] == "" and got[2]["words"] == 0 and got[2]["runs"] == []
    assert got[None]["collapsed"] == "p q" and got[5]["runs"] == []
    assert pr.periodic_runs(make_docs(rows).filter("doc_id = 9")).count() == 0

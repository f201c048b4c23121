"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from splitscope.llm import meetings, ngram_join
from tests.llm.test_dedup import _components, _near_rows


@pytest.mark.parametrize(("percent", "rounds"), [(80, 2), (80, 0), (60, 1)])
def test_groups_are_those_of_all_pairs(make_docs, percent, rounds, monkeypatch):
    monkeypatch.setattr(meetings, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "SHARE", 500)
    monkeypatch.setattr(meetings, "BLOCK", 7)
    rows = _near_rows(160, percent + rounds)
    heads, sizes = _components(rows, percent)
    got = {r["doc_id"]: r for r in ngram_join.similar_groups(make_docs(rows), percent).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == heads
    assert [got[i]["n_shingles"] for i in range(len(rows))] == sizes


def test_groups_of_odd_rows(make_docs, odd_rows):
    rows = ngram_join.similar_groups(make_docs(odd_rows, clash=True), 80).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    alike = [r for r in rows if r["n_shingles"] == 11]
    assert len(alike) == 6 and {r["component_id"] for r in alike} == {1}
    assert {r["component_id"] for r in rows if r["n_shingles"] > 1000} == {6}
    assert all(r["component_id"] == r["doc_id"] for r in rows if r["n_shingles"] == 0 and r["doc_id"] is not None)


def test_empty_table_and_nothing_shared(make_docs):
    docs = make_docs([(1, "a b c d e f g"), (2, "h i j k l m n")])
    assert ngram_join.similar_groups(docs.filter("doc_id = 3")).count() == 0
    assert {tuple(r) for r in ngram_join.similar_groups(docs).collect()} == {(1, 3, 1), (2, 3, 2)}


def test_a_chain_links_through_its_middle(make_docs):
    """Neighbours in the chain link, its ends do not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(30)]
    got = {r["component_id"] for r in ngram_join.similar_groups(make_docs(rows), 80).collect()}
    assert got == {0}


def test_parts_send_rows_to_destinations_not_to_sets():
    """As many rows as destinations, however many sets share shingles; all sets and shingles arrive."""
    rng = np.random.default_rng(5)
    names = np.unique(rng.integers(-(2**63), 2**63 - 1, 900, dtype=np.int64))
    sent = []
    for part in range(4):
        tokens = [np.unique(rng.integers(0, 60, 9)).astype("<u8") for _ in names]
        blob = np.concatenate(tokens).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        counts = np.array([len(t) for t in tokens], np.int32)
        row = {"part": [part], "sets": [names.tobytes()], "counts": [counts.tobytes()], "tokens": [blob]}
        got = ngram_join._shared_of_part(pa.table({c: pa.array(v, pa.int64() if c == "part" else pa.binary()) for c, v in row.items()}), 4)
        assert got.num_rows == 4 and got["dest"].to_pylist() == [0, 1, 2, 3]
        sent.append((got, tokens))
    packed, whole = pa.concat_tables([g for g, _ in sent]), {}
    for d in range(4):
        own = names[ngram_join._destination(names, 4) == d]
        heads = pa.table({"head": own, "n_shingles": np.full(len(own), 30), "set_a": own})
        for r in ngram_join._gathered(heads, packed.filter(pc.equal(packed["dest"], d)), 1).to_pylist():
            whole[r["rid"]] = np.frombuffer(r["tokens"], "<u8")
            assert len(r["ranks"]) == len(whole[r["rid"]])
    for i, name in enumerate(names.tolist()):
        assert sorted(whole[name].tolist()) == [p << 48 | int(t) for p, (_, tokens) in enumerate(sent) for t in tokens[i]]


def test_every_order_keeps_the_links():
    """Sets of the similarity share a shingle within their prefixes under every order."""
    rnd = random.Random(3)
    for _ in range(300):
        n, same = rnd.randint(1, 40), rnd.random()
        x = {rnd.randrange(60) for _ in range(n)}
        y = {v if rnd.random() < same else rnd.randrange(60) for v in x}
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        for k in range(ngram_join.ORDERS):
            rank = np.random.default_rng(k).permutation(60)
            first = lambda s: set(sorted(s, key=lambda v: rank[v])[: ngram_join.prefix_length(len(s), 80)])  # noqa: B023, E731
            assert first(x) & first(y)

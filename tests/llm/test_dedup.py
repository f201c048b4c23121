"""Exact and near duplicates, and repeated strings, against brute force."""

from __future__ import annotations

import hashlib
import pathlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from splitscope.llm import exact_dedup, near_dedup, repeats


def test_every_digest_gets_a_slot_of_its_own():
    digests = np.frombuffer(np.random.default_rng(1).bytes(32 * 5000), "<u8").reshape(-1, 4)
    widths, bits = exact_dedup.perfect_hash(digests)
    assert sorted(exact_dedup.slots(digests, widths, bits)) == list(range(5000))


@pytest.mark.parametrize("historical", ["doc_id < 3", "true", "false", "null"])
def test_exact_groups(make_docs, odd_rows, historical):
    rows = [tuple(r) for r in exact_dedup.exact_dedup(make_docs(odd_rows, clash=True), F.expr(historical)).collect()]
    groups = defaultdict(list)
    for r in odd_rows:
        groups[hashlib.sha256((r[1] or "").encode()).hexdigest()].append(r[0])
    assert len(rows) == len(odd_rows)
    for sha, ids in groups.items():
        own = [r for r in rows if r[4] == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r[1], r[2]) for r in own} == {(best, len(ids))}
        assert Counter(r[0] for r in own) == Counter(ids)
        assert [r[0] for r in own if r[3]] == [best]


def _sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _components(rows, percent):
    sets = [_sets(r[1]) for r in rows]
    head = list(range(len(rows)))
    def find(i):  # noqa: E306
        while head[i] != i:
            i = head[i]
        return i
    for i in range(len(rows)):  # noqa: E305
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                head[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))], [len(s) for s in sets]


def _near_rows(n, seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    common = rnd.choices(vocabulary, k=30)
    bases = [rnd.choices(vocabulary, k=rnd.randint(3, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            words = rnd.choices(vocabulary, k=8) + common + rnd.choices(vocabulary, k=8)
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_are_those_of_all_pairs(make_docs, percent):
    rows = _near_rows(160, percent)
    heads, sizes = _components(rows, percent)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(make_docs(rows), percent).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == heads
    assert [got[i]["n_shingles"] for i in range(len(rows))] == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_groups_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    rows = near_dedup.near_duplicates(docs, 80).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    alike = [r for r in rows if r["n_shingles"] == 11]
    assert len(alike) == 6 and {r["component_id"] for r in alike} == {1} and sum(r["kept"] for r in alike) == 1
    assert {r["component_id"] for r in rows if r["n_shingles"] > 1000} == {6}
    kept = near_dedup.drop_near_copies(docs, 80)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_sketches_tell_similarities_apart():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (900, 50, 50))
    far = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    sets = [np.concatenate([shared, a]), np.concatenate([shared, b]), far]
    minima = near_dedup.min_hashes(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    x = near_dedup.odd_sketches(minima).view(np.uint64)
    bits = lambda i, j: int(np.bitwise_count(x[i] ^ x[j]).sum())
    assert bits(0, 1) <= near_dedup.most_odd_bits(0.85) < bits(0, 2)


@pytest.mark.parametrize("size", [1, 40, 300, 3000, 20000])
def test_parities_lose_no_link_and_refute_near_misses(spark, size):
    rng = np.random.default_rng(size)
    rows, wanted = [], []
    for similarity in (0.6, 0.75, 0.85, 0.9, 1.0):
        for _ in range(20):
            common = rng.integers(0, 2**63, size).astype(np.uint64)
            own = [rng.integers(0, 2**63, int(size * (1 - similarity) / similarity / 2)).astype(np.uint64) for _ in "xy"]
            x, y = (near_dedup.mix64(np.concatenate([common, o])) for o in own)
            exact = 100 * size >= 85 * (size + len(own[0]) + len(own[1]))
            rows.append((len(rows), len(x), len(y), near_dedup.parities(x).tolist(), near_dedup.parities(y).tolist()))
            wanted.append((exact, similarity))
    pairs = spark.createDataFrame(rows, "i long, n_x long, n_y long, parity_x array<long>, parity_y array<long>")
    allowed = {r.i for r in pairs.filter(near_dedup._parities_allow(85)).collect()}
    assert all(i in allowed for i, (exact, _) in enumerate(wanted) if exact)
    if 40 <= size <= 3000:
        refuted = [i not in allowed for i, (_, similarity) in enumerate(wanted) if similarity == 0.6]
        assert sum(refuted) >= 0.9 * len(refuted)


def test_components_of_long_paths(spark):
    order = random.Random(3).sample(range(300), 300)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(400, 401)], "a long, b long")
    got = {r["rid"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(300)} | {400: 400, 401: 400}


def _covered(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def test_run_length_index_marks_all_recurring_strings():
    rnd = random.Random(4)
    for _ in range(200):
        alphabet = rnd.choice([b"ab", b"a", b"\x00\xffz", bytes(range(256))])
        base = bytes(rnd.choices(alphabet, k=60))
        segments = [bytes(rnd.choices(alphabet, k=rnd.randint(1, 12))) + base[rnd.randint(0, 20) : 40] * rnd.randint(1, 3) for _ in range(rnd.randint(1, 8))]
        length = rnd.randint(1, 20)
        want = np.concatenate([np.append(m, False) for m in _covered(segments, length)])
        assert (repeats.repeated_stretches(segments, length) == want).all()


@pytest.mark.parametrize("meeting", [repeats.MEETING, 2])
def test_removed_bytes(make_docs, odd_rows, meeting, monkeypatch):
    monkeypatch.setattr(repeats, "MEETING", meeting)
    rnd = random.Random(5)
    prose = lambda n: "".join(rnd.choice("abcdefg é") for _ in range(n))
    passage, rim = prose(650), prose(390)
    rows = [(i, prose(rnd.randint(0, 300)) + passage[rnd.randint(0, 150) : rnd.randint(450, 650)] + prose(200)) for i in range(20, 32)]
    rows += [(i, prose(300) + rim + prose(300)) for i in range(40, 46)] + [(50, prose(450) * 3), (51, "ab" * 500), (52, "x" * 399)]
    docs = make_docs([r[:2] for r in odd_rows if r[0] is not None and r[0] != 1] + rows, clash=True)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    want = dict(zip(texts, _covered(list(texts.values()), repeats.LENGTH)))
    for r in repeats.removal_report(docs).collect():
        mask, raw = want[r["doc_id"]], texts[r["doc_id"]]
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(raw, np.uint8)[~mask])
        assert tuple(r)[1:] == (len(raw), int(mask.sum()), runs, hashlib.sha256(left).hexdigest()), r["doc_id"]


def test_long_texts_are_read_in_overlapping_stretches(make_docs):
    rnd = random.Random(6)
    passage = "".join(rnd.choices("abcdefgh", k=900))
    far = "".join(rnd.choices("abcdefgh", k=repeats.CHUNK - 500))
    docs = make_docs([(1, far + passage + far[:100]), (2, "k" + passage)])
    got = {r["doc_id"]: r["n_removed"] for r in repeats.removal_report(docs).collect()}
    assert got == {1: 900, 2: 900}


def test_only_spans_stay_in_the_shared_folder(make_docs, spark):
    """Anchors, contexts and pieces go with the step that needs them."""
    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    rnd = random.Random(8)
    passage = "".join(rnd.choices("abcdefgh", k=900))
    texts = ["".join(rnd.choices("abcdefgh", k=700)) + passage + "".join(rnd.choices("abcdefgh", k=300)) for _ in range(6)]
    before = set(folder.glob("table-*"))
    report = repeats.removal_report(make_docs(list(enumerate(texts))))
    left = set(folder.glob("table-*")) - before
    assert all(spark.read.parquet(str(t)).columns == ["rid", "lo", "hi"] for t in left) and len(left) == 3
    assert all(r["n_removed"] >= len(passage) for r in report.collect())


def test_repeated_ids_and_empty_tables(make_docs):
    text = "".join(random.Random(7).choices("abcdefgh", k=500))
    got = repeats.removal_report(make_docs([(1, text), (1, text), (None, "z" * 10)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 500), (1, 500)]
    empty = make_docs([(1, "a")]).filter("doc_id = 2")
    assert repeats.removal_report(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert exact_dedup.exact_dedup(empty, F.lit(True)).count() == 0


def test_a_passage_whose_last_gram_is_its_only_anchor(make_docs):
    rng, before = np.random.default_rng(8), None
    least = lambda text: int(repeats.gram_hashes(text, repeats.GRAM).argmin())
    while before is None:  # the gram that starts one byte earlier hides the others of the passage
        passage = rng.integers(97, 123, repeats.LENGTH).astype(np.uint8)
        if least(passage) == repeats.SIDE:
            before = next((b for b in range(65, 91) if least(np.concatenate([[b], passage]).astype(np.uint8)) == 0), None)
    rnd, middle = random.Random(8), passage.tobytes().decode()
    around = lambda left: "".join(rnd.choices("01234567", k=349)) + left + middle + "".join(rnd.choices("01234567", k=350))
    texts = [around(chr(before)), around("-")]
    got = {r["doc_id"]: r["n_removed"] for r in repeats.removal_report(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: int(c.sum()) for i, c in enumerate(_covered(texts, repeats.LENGTH))}
    assert min(got.values()) >= repeats.LENGTH

"""Language, quality and masked scores, on the test tables and on odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from splitscope.llm import language, masked_lm, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_languages_of_held_out_rows(documents):
    rows = language.identify(documents).collect()
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(make_docs, odd_rows):
    text = {"en": "the and of that with", "es": "que los del ción para"}
    rows = [(100 + i, text[name] + f" x{i}", name) for i in range(40) for name in text]
    docs = make_docs([*odd_rows, *rows], clash=True)
    got = language.identify(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in [*odd_rows, *rows])
    unknown = [r for r in got if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in unknown} == {None, 3, 4, 5, 10, 11} and all(r["score"] == 0 for r in unknown)
    kept = language.drop_unknown(docs, least=0)
    assert kept.columns == docs.columns and kept.count() == len(got) - len(unknown)
    none = docs.filter("false")
    assert language.identify(none).count() == 0 and language.train(none) is None


def _kneser_ney(counts, symbols):
    """P(last | before) for one-symbol-shorter recursion, written out on dictionaries."""
    def estimate(own, k, gram):
        if k == 0:
            return 1 / symbols
        kinds = Counter(own.values())
        t = [kinds.get(i, 0) for i in range(5)]
        if all(t[1:]):
            y = t[1] / (t[1] + 2 * t[2])
            off = [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            off = [0.5] * 3
        shorter = Counter(g[1:] for g in own)
        context = {g: n for g, n in own.items() if g[:-1] == gram[:-1]}
        total = sum(context.values())
        less = estimate(shorter, k - 1, gram[1:])
        if not total:
            return less
        cut = lambda n: off[min(n, 3) - 1]
        seen = context.get(gram, 0)
        return (seen - cut(seen) if seen else 0) / total + sum(map(cut, context.values())) / total * less

    return lambda gram: estimate(counts, len(gram), gram)


def test_model_is_interpolated_kneser_ney(spark):
    texts = ["the cat sat on the mat. the dog sat.", "a cat and a dog and THE END", "on and on"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    table = quality.log_probabilities(quality.gram_counts(df))
    by_context = np.exp(table.astype(np.float64)).reshape(-1, quality.SYMBOLS)
    assert np.allclose(by_context.sum(axis=1), 1, atol=1e-5)
    counts = Counter()
    for t in texts:
        s = [28] * 3 + [int(quality.FOLD[b]) for b in t.encode()]
        counts.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    brute = _kneser_ney(counts, quality.SYMBOLS)
    for gram in [*list(counts)[:25], (1, 2, 3, 4), (19, 7, 4, 9), (28, 28, 28, 5)]:
        place = sum(x * quality.SYMBOLS ** (3 - i) for i, x in enumerate(gram))
        assert math.isclose(math.exp(table[place]), brute(gram), rel_tol=1e-4)


def _byte_within_symbol(counts):
    """As :func:`_kneser_ney`, on tuples of bytes: P(last byte | its symbol, the bytes before)."""
    def estimate(own, gram):
        if not gram:
            return None
        kinds = Counter(own.values())
        t = [kinds.get(i, 0) for i in range(5)]
        if all(t[1:]):
            y = t[1] / (t[1] + 2 * t[2])
            off = [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            off = [0.5] * 3
        symbol = quality.FOLD[gram[-1]]
        less = estimate(Counter(g[1:] for g in own), gram[1:]) if len(gram) > 1 else 1 / (quality.FOLD == symbol).sum()
        context = {g: n for g, n in own.items() if g[:-1] == gram[:-1] and quality.FOLD[g[-1]] == symbol}
        total = sum(context.values())
        if not total:
            return less
        cut = lambda n: off[min(n, 3) - 1]
        seen = context.get(gram, 0)
        return (seen - cut(seen) if seen else 0) / total + sum(map(cut, context.values())) / total * less

    return lambda gram: estimate(counts, gram)


@pytest.mark.parametrize("held", [1 << 22, 3])
def test_perplexities_are_those_of_all_bytes(make_docs, spark, monkeypatch, held):
    """Every byte is scored, within its symbol too; in one range of four-grams or in many."""
    monkeypatch.setattr(quality, "RANGE", held)
    monkeypatch.setattr(quality, "HELD", held)
    trusted = ["In 1984, on 3 May: 17.5% (A).", "\u4f60\u597d\uff0c\u4e16\u754c", "na\u00efve caf\u00e9\t\r\n", "In 1999, a B"]
    other = ["In 1748, on 6 May; 98,2% [Z].", "\u597d\u4f60\u3002\u754c\u4e16", "\u0416 x", "a", "!", "\u00e9"]
    docs = make_docs(list(enumerate([*trusted, *other, None])))
    labels = spark.createDataFrame([(i, 1) for i in range(len(trusted))], "doc_id long, quality int")
    got = {r["doc_id"]: r["perplexity"] for r in quality.judged(docs, labels).collect()}
    counted, symbols = Counter(), Counter()
    for t in trusted:
        raw = b"\n" * 3 + t.encode()
        symbols.update(tuple(quality.FOLD[list(raw[i : i + 4])].tolist()) for i in range(len(raw) - 3))
        counted.update(tuple(raw[i : i + 4]) for i in range(len(raw) - 3) if (quality.FOLD == quality.FOLD[raw[i + 3]]).sum() > 1)
    of_symbol, of_byte = _kneser_ney(symbols, quality.SYMBOLS), _byte_within_symbol(counted)
    for k, t in enumerate([*trusted, *other]):
        raw = b"\n" * 3 + t.encode()
        grams = [raw[i : i + 4] for i in range(len(raw) - 3)]
        log_prob = sum(math.log(of_symbol(tuple(quality.FOLD[list(g)].tolist())) * of_byte(tuple(g))) for g in grams)
        assert got[k] == pytest.approx(math.exp(-log_prob / len(grams)), rel=1e-4)
    assert got[len(got) - 1] is None
    assert sum(of_byte((*b"\n19", b)) for b in b"0123456789") == pytest.approx(1)


def test_quality_follows_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, labels).collect()}
    assert len(kept) == docs.count()
    rows = labels.collect()
    good = [kept[r["doc_id"]] for r in rows if r["quality"] == 1]
    bad = [kept[r["doc_id"]] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.4


def test_quality_of_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, 0), (None, 1, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    assert not any(r["kept"] for r in rows if r["n_symbols"] == 0)
    assert all(r["threshold"] is not None for r in rows)
    none = quality.judged(docs, labels.filter("false")).collect()
    assert all(r["threshold"] is None and r["kept"] == (r["n_symbols"] > 0) for r in none)
    assert quality.judged(docs.filter("false"), labels).count() == 0


def test_masked_scores_beat_word_frequencies(documents):
    common = masked_lm.common_words(documents.select("text"))
    tokens = Counter()
    for r in documents.select("text").collect():
        data = np.frombuffer(r["text"].encode(), np.uint8)
        tokens.update(masked_lm.token_ids(data, np.array([0, len(data)]), common)[0].tolist())
    total = sum(tokens.values())
    entropy = -sum(n / total * math.log(n / total) for n in tokens.values())
    rows = masked_lm.scores(documents).collect()
    assert sum(r["n_words"] for r in rows) == total
    assert -sum(r["log_prob"] for r in rows) / total < entropy


def test_gradients_are_those_of_the_scores():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, masked_lm.VOCABULARY, 40)
    around = masked_lm.neighbours(tokens, np.array([0, 25, 40]))
    assert around[0].tolist()[:2] == [masked_lm.EDGE] * 2 and around[24].tolist()[2:] == [masked_lm.EDGE] * 2
    flat = masked_lm.initial()
    trainer = masked_lm.Trainer(flat)
    before = masked_lm.log_probabilities(masked_lm.unpack(flat), around, tokens).sum()
    for _ in range(5):
        trainer.learn(around, tokens)
    assert masked_lm.log_probabilities(masked_lm.unpack(trainer.flat), around, tokens).sum() > before


def test_gradients_are_the_slopes_of_the_scores():
    """Each kind of weight against a difference quotient."""
    rng = np.random.default_rng(4)
    tokens = np.concatenate([rng.integers(0, 130, 30), rng.integers(masked_lm.COMMON, masked_lm.VOCABULARY, 10)])
    around = masked_lm.neighbours(tokens, np.array([0, 25, 40]))
    flat = masked_lm.initial().astype(np.float64) + rng.normal(0, 0.1, len(masked_lm.initial()))
    w = masked_lm.unpack(flat)
    loss = lambda f: -masked_lm.log_probabilities(masked_lm.unpack(f), around, tokens).astype(np.float64).mean()
    dense, groups, near = masked_lm.gradients(w, around, tokens)
    full = {n: np.zeros_like(v) for n, v in w.items()}
    at = 0
    for n in ("mix", "shift", "outer", "outer_bias"):
        full[n] = dense[at : at + w[n].size].reshape(w[n].shape)
        at += w[n].size
    for part, rows, biases in groups:
        full["inner"][part], full["inner_bias"][part] = rows, biases
    np.add.at(full["words"], around.ravel(), near)
    whole = np.concatenate([full[n].ravel() for n in masked_lm.SHAPES])
    for k in [*rng.choice(np.flatnonzero(np.abs(whole) > 2e-3), 60), *rng.choice(len(whole), 5)]:
        step = np.zeros(len(flat))
        step[k] = 1e-5
        assert (loss(flat + step) - loss(flat - step)) / 2e-5 == pytest.approx(whole[k], rel=1e-3, abs=1e-6)


@pytest.fixture(scope="module")
def some_words():
    """Weights, and words of which some are alone in their group."""
    rng = np.random.default_rng(7)
    tokens = np.concatenate([rng.integers(0, 130, 500), rng.integers(0, masked_lm.VOCABULARY, 100)])
    weights = masked_lm.unpack(masked_lm.initial() + rng.normal(0, 0.3, len(masked_lm.initial())).astype(np.float32))
    return weights, masked_lm.neighbours(tokens, np.array([0, 600])), tokens


def test_a_word_scores_alike_in_any_company(some_words):
    """Bit for bit, whatever other words are scored with it, also where it is the only one of its group."""
    weights, around, tokens = some_words
    whole = masked_lm.log_probabilities(weights, around, tokens)
    alone = [masked_lm.log_probabilities(weights, around[i : i + 1], tokens[i : i + 1])[0] for i in range(len(tokens))]
    assert whole.tolist() == alone


@pytest.mark.parametrize("shift", [-2000.0, -70.0, 0.0, 70.0, 2000.0])
def test_scores_and_slopes_of_large_logits(some_words, shift):
    """What all outputs have in common changes nothing; exponentials stay within the range of numbers."""
    weights, around, tokens = some_words
    moved = weights | {n: weights[n] + np.float32(shift) for n in ("outer_bias", "inner_bias")}
    want, got = (masked_lm.log_probabilities(w, around, tokens) for w in (weights, moved))
    assert np.allclose(got, want, atol=2e-3)
    for a, b in zip(*(masked_lm.gradients(w, around, tokens)[::2] for w in (weights, moved)), strict=True):
        assert np.isfinite(b).all() and np.allclose(a, b, atol=1e-4)


def test_scores_are_those_of_a_plain_scorer(make_docs):
    """Word by word, from the trained weights and the counts of all words."""
    rnd = __import__("random").Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choices(vocabulary, weights=range(40, 0, -1), k=rnd.randint(1, 30)))) for i in range(60)]
    docs = make_docs(rows)
    texts = docs.selectExpr("text", "doc_id AS id")
    known, _ = masked_lm.vocabulary(masked_lm.word_counts(texts.select("text")))
    w = masked_lm.unpack(masked_lm.train(texts, known))
    hashed = {v: int(masked_lm.word_hashes(np.frombuffer(v.encode(), np.uint8), np.array([0, len(v)]))[0][0]) for v in vocabulary}
    token = {v: int(known.tokens[np.searchsorted(known.words, np.uint64(h))]) for v, h in hashed.items()}
    def log_softmax(x, k):  # noqa: E306
        return x[k] - x.max() - math.log(np.exp(x - x.max()).sum())
    got = {r["doc_id"]: r["log_prob"] for r in masked_lm.scores(docs).collect()}  # noqa: E305
    for i, text in rows[:20]:
        t, total = [token[v] for v in text.split()], 0.0
        for k, own in enumerate(t):
            near = [t[k + s] if 0 <= k + s < len(t) else masked_lm.EDGE for s in (-2, -1, 1, 2)]
            hidden = w["shift"].astype(float)
            for place, x in enumerate(near):
                hidden = hidden + w["words"][x].astype(float) @ w["mix"][place]
            hidden = np.maximum(hidden, 0)
            group, inside = divmod(own, masked_lm.GROUP_WORDS)
            part = slice(group * masked_lm.GROUP_WORDS, (group + 1) * masked_lm.GROUP_WORDS)
            total += log_softmax(hidden @ w["outer"] + w["outer_bias"], group)
            total += log_softmax(w["inner"][part] @ hidden + w["inner_bias"][part], inside)
        assert got[i] == pytest.approx(total, abs=1e-3)


def test_scores_do_not_depend_on_partitions_or_order(make_docs, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARD_WORDS", 300)
    monkeypatch.setattr(masked_lm, "FAN_IN", 2)
    rnd = __import__("random").Random(6)
    rows = [(i, " ".join(rnd.choices("abcdefghij", k=rnd.randint(1, 60)))) for i in range(60)] + [(70 + i, "a b c d") for i in range(20)]
    docs = make_docs(rows)
    scored = [sorted(map(tuple, masked_lm.scores(docs.repartition(n)).collect())) for n in (1, 4, 32)]
    assert scored[0] == scored[1] == scored[2]
    assert len({r[2] for r in scored[0] if r[0] >= 70}) == 1


def test_masked_scores_of_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows, clash=True)
    rows = masked_lm.scores(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows)
    blank = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert all((r["n_words"], r["log_prob"], r["mean_log_prob"]) == (0, 0.0, None) for r in blank)
    assert len({r["log_prob"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert masked_lm.scores(docs.filter("false")).count() == 0


def test_every_text_is_learned_from(spark):
    texts = spark.range(40).selectExpr("concat('some text of number ', id) AS text")
    texts = texts.filter("pmod(xxhash64(text), 16) = 3").limit(1)
    assert texts.count() == 1
    start = masked_lm.initial()
    learned = masked_lm.train(texts, masked_lm.common_words(texts))
    assert not np.array_equal(learned[: len(start)], start)


@pytest.mark.parametrize("known", [masked_lm.KNOWN, 1])
def test_words_of_a_bucket_are_told_apart_by_their_share(make_docs, monkeypatch, known):
    monkeypatch.setattr(masked_lm, "KNOWN", known, raising=False)
    by_bucket = {}
    for i in range(2000):
        data = np.frombuffer(f"rare{i}".encode(), np.uint8)
        by_bucket.setdefault(int(masked_lm.word_hashes(data, np.array([0, len(data)]))[0][0] >> np.uint64(58)), []).append(f"rare{i}")
    a, b, c = by_bucket[7][:3]
    common = [(100 + i, f"often{i} " * 50) for i in range(masked_lm.COMMON)]
    rows = [(1, a), (2, b), (3, c), (4, f"{a} {a} {a} {a} {b}"), *common]
    got = {r["doc_id"]: r["log_prob"] for r in masked_lm.scores(make_docs(rows)).collect()}
    assert math.isclose(got[1] - got[2], math.log(5 / 2), abs_tol=1e-4) and math.isclose(got[2] - got[3], math.log(2), abs_tol=1e-4)
    words = lambda texts: len(masked_lm.common_words(make_docs(texts).select("text")).words)
    assert words(rows) == masked_lm.COMMON + (3 if known > 1 else 0)

"""Document scores by masked pseudo-likelihood.

A small network sees two words on either side of a word and predicts the word in the middle. A document's score is the
sum, over its words, of the log-probability of each given its neighbours. The most frequent words are predicted in two steps, their
group and the word within it, both from the neighbours; the others as a bucket by hash, times the word's share of its bucket in the
whole corpus. Words above a share of the corpus have numbers of their own as neighbours, so the network grows with the vocabulary;
the shares of rarer words are joined from the counts of all words.

Training starts from the words' frequencies, so the network can only add to them. Every document belongs to a shard and a round by
a hash of its id and text. In each round every shard takes its documents, in order of their hashes, from the same weights through
stochastic gradient steps, and the weights are averaged by words seen, range by range, in a tree. So neither the weights nor the
scores depend on how the table is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from splitscope.llm.common import flat_text, materialise, runs_of_rows
from splitscope.llm.near_dedup import word_hashes

#: Words that are predicted by themselves, in groups of so many, buckets for the rest, and the mark beyond either end of a text.
GROUPS, GROUP_WORDS, BUCKETS = 64, 64, 64
COMMON = GROUPS * GROUP_WORDS
VOCABULARY = COMMON + BUCKETS
EDGE = VOCABULARY
#: Words that are at least one in so many of the corpus are known; and have a row of their own among the neighbours.
KNOWN, ROWS = 1 << 20, 1 << 17
#: Numbers per word, hidden units.
WIDTH, HIDDEN = 12, 16
#: Rounds, each over its own share of the documents; words in a shard and in a step, step size.
ROUNDS, SHARD_WORDS, STEP_WORDS, RATE = 2, 1 << 21, 16384, 0.5
#: Shards summed by one task of the averaging tree, and weights in a range.
FAN_IN, RANGE = 32, 1 << 16
CHUNK = 1 << 19
#: Words whose probabilities are held in memory together.
SLICE = 1 << 15
#: Logits whose exponentials are summed as they are.
SAFE = 60.0
#: Log-probabilities are summed as whole multiples of one part in so many, so that sums do not depend on the order.
UNIT = 1 << 32
#: Log-frequency of what does not occur.
NEVER = -30.0

PLACES = [-2, -1, 1, 2]
#: "words" has one more row for each word beyond the vocabulary that has its own; it stands last.
SHAPES = {
    "mix": (len(PLACES), WIDTH, HIDDEN), "shift": (HIDDEN,), "outer": (HIDDEN, GROUPS + BUCKETS), "outer_bias": (GROUPS + BUCKETS,),
    "inner": (COMMON, HIDDEN), "inner_bias": (COMMON,), "words": (VOCABULARY + 1, WIDTH),
}
#: The weights that move at every step.
DENSE = sum(int(np.prod(SHAPES[name])) for name in ("mix", "shift", "outer", "outer_bias"))
Weights = dict[str, np.ndarray]


@dataclass
class Vocabulary:
    """The known words, by rising hash, each with its token: a number from 0 on for a common word, by falling frequency, one beyond
    EDGE for any other; words that are not known share the token of their bucket.

    For the tokens beyond EDGE: their buckets, the log of each word's share of its bucket, and their rows of "words". ``outer`` and
    ``inner`` are the log-frequencies of groups and buckets, and of common words in their groups."""

    words: np.ndarray
    tokens: np.ndarray
    buckets: np.ndarray
    log_shares: np.ndarray
    own_rows: np.ndarray
    outer: np.ndarray
    inner: np.ndarray

    def classes(self, tokens: np.ndarray) -> np.ndarray:
        """What is predicted for each token: itself for a common word, else its bucket."""
        return self._per_token[0][tokens]

    def logs(self, tokens: np.ndarray) -> np.ndarray:
        """The log of each token's share of what is predicted; 0 for words that are not known."""
        return self._per_token[1][tokens]

    def rows(self, tokens: np.ndarray) -> np.ndarray:
        """The row of "words" that stands for each token."""
        return self._per_token[2][tokens]

    @cached_property
    def _per_token(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.arange(EDGE + 1)
        return (
            np.concatenate([plain, self.buckets]), np.concatenate([np.zeros(EDGE + 1), self.log_shares]),
            np.concatenate([plain, self.own_rows]),
        )


def unpack(flat: np.ndarray) -> Weights:
    sizes = np.cumsum([0, *(int(np.prod(s)) for s in SHAPES.values())])
    sizes[-1] = len(flat)
    return {name: flat[a:b].reshape(-1, *shape[1:]) if name == "words" else flat[a:b].reshape(shape) for (name, shape), a, b in zip(SHAPES.items(), sizes, sizes[1:], strict=False)}


def initial(known: Vocabulary | None = None) -> np.ndarray:
    """The weights to start from, which predict by frequency alone; a row beyond the vocabulary begins as its bucket does."""
    rng = np.random.default_rng(11)
    parts = {name: np.zeros(shape) for name, shape in SHAPES.items()}
    parts["mix"], parts["words"] = rng.normal(0, 0.3, SHAPES["mix"]), rng.normal(0, 0.1, SHAPES["words"])
    if known is not None:
        parts["outer_bias"], parts["inner_bias"] = known.outer, known.inner
        beyond = known.own_rows > EDGE
        parts["words"] = np.concatenate([parts["words"], parts["words"][known.buckets[beyond]]])
    return np.concatenate([p.ravel() for p in parts.values()]).astype(np.float32)


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, n): how often each word hash occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = flat_text(batch.column(0))
            parts = [word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])[0] for i, j in runs_of_rows(starts, CHUNK)]
            if parts:
                words, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucket(word: str = "word"):
    """The bucket, from 0 on, of a column of word hashes."""
    return F.shiftrightunsigned(word, 58).cast("int")


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, list[int]]:
    """The words to know, of the rows (word, n) of all words, and how many words of the corpus fall into each bucket.

    At most KNOWN rows reach the driver, as no more words can be one in so many, and COMMON."""
    top = counts.orderBy(F.desc("n"), "word").limit(COMMON).toPandas()
    buckets = counts.groupBy(bucket().alias("b")).agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(BUCKETS, np.int64)
    totals[buckets["b"].to_numpy(np.int64)] = buckets["n"].to_numpy(np.int64)
    total = int(totals.sum())
    own, own_n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    known = counts.filter(F.col("n") >= F.lit(total / KNOWN)).toPandas()
    np.subtract.at(totals, (own >> np.uint64(58)).astype(np.int64), own_n)
    words, n = known["word"].to_numpy(np.int64).view(np.uint64), known["n"].to_numpy(np.int64)
    rest = ~np.isin(words, own)
    words, n = words[rest], n[rest]
    order = np.argsort(words)
    words, n = words[order], n[order]
    b = (words >> np.uint64(58)).astype(np.int64)
    frequent = n * ROWS >= total
    rows = np.where(frequent, EDGE + np.cumsum(frequent), COMMON + b)
    every = np.concatenate([own, words])
    tokens = np.concatenate([np.arange(len(own)), EDGE + 1 + np.arange(len(words))])
    order = np.argsort(every)
    each = np.zeros(COMMON)
    each[: len(own)] = own_n
    groups = each.reshape(GROUPS, GROUP_WORDS).sum(axis=1)
    log = lambda x, of: np.where(x > 0, np.log(np.maximum(x, 1) / np.maximum(of, 1)), NEVER)
    outer, inner = log(np.concatenate([groups, totals]), total), log(each, np.repeat(groups, GROUP_WORDS))
    return Vocabulary(every[order], tokens[order], COMMON + b, np.log(n / totals[b]), rows, outer, inner), totals.tolist()


def common_words(texts: DataFrame) -> Vocabulary:
    """The words of the texts that are known."""
    return vocabulary(materialise(word_counts(texts)))[0]


def _tokens(words: np.ndarray, known: Vocabulary) -> np.ndarray:
    shared = (COMMON + (words >> np.uint64(58))).astype(np.int64)
    if not len(known.words):
        return shared
    order = np.argsort(words)  # looked up by rising hash, neighbours in the table follow each other
    rising = words[order]
    at = np.minimum(np.searchsorted(known.words, rising), len(known.words) - 1)
    own = known.words[at] == rising
    shared[order[own]] = known.tokens[at[own]]
    return shared


def token_ids(data: np.ndarray, starts: np.ndarray, known: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The token of each word of the texts on end, and the words before each text."""
    words, before = word_hashes(data, starts)
    return _tokens(words, known), before


def neighbours(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The tokens around each word, EDGE beyond its text: one column a place."""
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    place = np.arange(len(tokens))
    out = np.full((len(tokens), len(PLACES)), EDGE)
    for k, shift in enumerate(PLACES):
        at = place + shift
        inside = (at >= 0) & (at < len(tokens))
        at = np.clip(at, 0, max(0, len(tokens) - 1))
        if len(tokens):
            out[:, k] = np.where(inside & (owner[at] == owner), tokens[at], EDGE)
    return out


def _bounded(logits: np.ndarray) -> None:
    """Shifts the rows whose exponentials could leave the range of numbers; what happens to a row depends on that row alone."""
    if not (logits.max(initial=0) <= SAFE and logits[:, 0].min(initial=0) >= -SAFE):
        most = logits.max(axis=1, keepdims=True)
        logits -= np.where(np.abs(most) <= SAFE, 0, most).astype(logits.dtype)


def _picked(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-probability of one column in each row; overwrites the logits."""
    _bounded(logits)
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return chosen - np.log(logits.sum(axis=1))


def _errors(logits: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The slopes of the mean negative log-probability of n words by the logits are put in their place, but for a factor for each row.

    Returns these factors. Whoever multiplies fewer columns takes them along, so the logits are gone through less often."""
    _bounded(logits)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    logits[np.arange(len(at)), at] -= sums
    return (1 / (sums * n))[:, None]


def _outer(tokens: np.ndarray) -> np.ndarray:
    """The group of each common word, or the place of a bucket behind the groups."""
    return np.where(tokens < COMMON, tokens // GROUP_WORDS, tokens - COMMON + GROUPS)


def _by_group(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """Where the common words stand, group by group, and their places in their groups; each group that occurs, with its stretch
    of these."""
    common = np.flatnonzero(tokens < COMMON)
    group = (tokens[common] // GROUP_WORDS).astype(np.uint16)  # short keys are sorted by counting
    common = common[np.argsort(group, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=GROUPS))]).tolist()
    return common, tokens[common] % GROUP_WORDS, [(g, slice(a, b)) for g, (a, b) in enumerate(pairwise(ends)) if a < b]


def _hidden(weights: Weights, seen: np.ndarray) -> np.ndarray:
    """The hidden units, and behind them a unit that is always 1, for the biases."""
    out = np.ones((len(seen), HIDDEN + 1), seen.dtype)
    np.maximum(seen @ weights["mix"].reshape(-1, HIDDEN) + weights["shift"], 0, out=out[:, :HIDDEN])
    return out


def _with_biases(weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """The weights of "outer", and of "inner" group by group, for :func:`_hidden`.

    A word is a column in both: laid out otherwise, a row's product would differ in its last bits when it stands alone."""
    inner = np.hstack([weights["inner"], weights["inner_bias"][:, None]]).reshape(GROUPS, GROUP_WORDS, HIDDEN + 1)
    return np.vstack([weights["outer"], weights["outer_bias"]]), np.ascontiguousarray(inner.transpose(0, 2, 1))


def _inner_logits(own: np.ndarray, inner: np.ndarray, stretches: list[tuple[int, slice]]) -> np.ndarray:
    out = np.empty((len(own), GROUP_WORDS), own.dtype)
    for g, at in stretches:
        np.matmul(own[at], inner[g], out=out[at])
    return out


def log_probabilities(weights: Weights, around: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The log-probability of each common word or bucket, given the rows of the words around it."""
    out = np.empty(len(tokens), weights["mix"].dtype)
    outer, inner = _with_biases(weights)
    for a in range(0, len(tokens), SLICE):
        near, own = around[a : a + SLICE], tokens[a : a + SLICE]
        hidden = _hidden(weights, weights["words"].take(near, axis=0).reshape(len(own), -1))
        logs = _picked(hidden @ outer, _outer(own))
        common, places, stretches = _by_group(own)
        logs[common] += _picked(_inner_logits(hidden.take(common, axis=0), inner, stretches), places)
        out[a : a + SLICE] = logs
    return out


def gradients(w: Weights, around: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Of the mean negative log-probability: by the dense weights, by stretches of the common words as (stretch, rows, biases),
    and by the words around, a row for each."""
    n = len(tokens)
    outer, inner = _with_biases(w)
    seen = w["words"].take(around, axis=0).reshape(n, -1)  # n x (places x width)
    hidden = _hidden(w, seen)
    p = hidden @ outer
    scale = _errors(p, _outer(tokens), n)
    back = (p @ w["outer"].T) * scale
    by_outer = (hidden * scale).T @ p
    common, places, stretches = _by_group(tokens)
    own = hidden.take(common, axis=0)
    q = _inner_logits(own, inner, stretches)
    scale = _errors(q, places, n)
    own *= scale
    by_inner, below = np.zeros((COMMON, HIDDEN + 1), p.dtype), np.empty((len(common), HIDDEN), p.dtype)
    for g, at in stretches:
        part = slice(g * GROUP_WORDS, (g + 1) * GROUP_WORDS)
        np.matmul(q[at], w["inner"][part], out=below[at])
        np.matmul(q[at].T, own[at], out=by_inner[part])
    back[common] += below * scale
    back *= hidden[:, :HIDDEN] > 0
    dense = np.concatenate([(seen.T @ back).ravel(), back.sum(axis=0), by_outer[:HIDDEN].ravel(), by_outer[HIDDEN]])
    groups = [(slice(0, COMMON), by_inner[:, :HIDDEN], by_inner[:, HIDDEN])]
    return dense, groups, (back @ w["mix"].reshape(-1, HIDDEN).T).reshape(-1, WIDTH)


class Trainer:
    """Gradient steps from given weights, each scaled by its parameter's past gradients."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.past = np.full(len(flat), 1e-3, np.float32)
        self.words = 0

    def learn(self, around: np.ndarray, tokens: np.ndarray) -> None:
        for a in range(0, len(tokens), STEP_WORDS):
            self._step(around[a : a + STEP_WORDS], tokens[a : a + STEP_WORDS])

    def _step(self, around: np.ndarray, tokens: np.ndarray) -> None:
        w, past = unpack(self.flat), unpack(self.past)
        dense, groups, near = gradients(w, around, tokens)

        def move(name: str, where, by: np.ndarray) -> None:
            past[name][where] += by * by
            w[name][where] -= RATE * by / np.sqrt(past[name][where])

        for part, rows, biases in groups:
            move("inner", part, rows)
            move("inner_bias", part, biases)
        # Of the words, only the rows that were seen move. Row and place are sorted as one number.
        bits = around.size.bit_length()
        keys = np.sort(around.ravel().astype(np.int64) << bits | np.arange(around.size))
        rows = keys >> bits
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        move("words", rows[first], np.add.reduceat(near.take(keys & (1 << bits) - 1, axis=0), first, axis=0))
        self.past[:DENSE] += dense * dense
        self.flat[:DENSE] -= RATE * dense / np.sqrt(self.past[:DENSE])
        self.words += len(tokens)


PART = "part long, range long, words long, weights binary"


def _summed(table: pa.Table) -> pa.Table:
    """One row for a group's weights of one range, weighted by words; always added in the same order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = sum(r["words"] for r in rows)
    mean = sum(np.frombuffer(r["weights"], "<f8") * (r["words"] / total) for r in rows)
    return pa.table({"part": [rows[0]["part"] // FAN_IN], "range": [rows[0]["range"]], "words": [total], "weights": [mean.astype("<f8").tobytes()]})


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The weights of all shards, averaged; no task holds more than FAN_IN stretches of them."""
    while parts.select("part").distinct().count() > 1:
        grouped = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("of"), "range")
        parts = materialise(grouped.applyInArrow(_summed, PART))
    rows = parts.orderBy("range").collect()
    return np.concatenate([np.frombuffer(r["weights"], "<f8") for r in rows]).astype(np.float32) if rows else None


def _learner(given: Broadcast) -> Callable[[pa.Table], pa.Table]:
    """A function that takes a shard's texts through the steps from the given weights, and returns the new ones in ranges."""

    def run(table: pa.Table) -> pa.Table:
        start, known = given.value
        trainer = Trainer(start)
        column = table.sort_by("h")["text"].combine_chunks()
        data, starts = flat_text(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
        for i, j in runs_of_rows(starts, CHUNK):
            tokens, before = token_ids(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], known)
            trainer.learn(known.rows(neighbours(tokens, before)), known.classes(tokens))
        ranges = range(0, len(trainer.flat), RANGE) if trainer.words else ()
        blobs = [trainer.flat[a : a + RANGE].astype("<f8").tobytes() for a in ranges]
        part = table["shard"][0].as_py()
        columns = {"part": [part] * len(blobs), "range": list(range(len(blobs))), "words": [trainer.words] * len(blobs), "weights": blobs}
        types = {"part": pa.int64(), "range": pa.int64(), "words": pa.int64(), "weights": pa.binary()}
        return pa.table({c: pa.array(v, types[c]) for c, v in columns.items()})

    return run


def train(texts: DataFrame, known: Vocabulary, words: int | None = None) -> np.ndarray:
    """The weights after all rounds; the first ones if no text has words. ``texts`` has ``text`` and may have an ``id``, which
    deals out equal texts; ``words``: how many there are in all."""
    if words is None:
        words = word_counts(texts.select("text")).agg(F.sum("n")).first()[0] or 0
    shards = max(1, round(words / SHARD_WORDS))
    h = F.xxhash64("text", "id") if "id" in texts.columns else F.xxhash64("text")
    keyed = texts.select("text", h.alias("h"))
    keyed = keyed.select("text", "h", F.pmod("h", F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright("h", 20), F.lit(shards)).alias("shard"))
    flat = initial(known)
    for step in range(ROUNDS):
        given = texts.sparkSession.sparkContext.broadcast((flat, known))

        own = keyed.filter(F.col("round") == step).select("shard", "h", "text")
        flat = _first(_averaged(materialise(own.groupBy("shard").applyInArrow(_learner(given), PART))), flat)
    return flat


def _first(new: np.ndarray | None, old: np.ndarray) -> np.ndarray:
    return old if new is None else new


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``log_prob`` (sum over the words), ``mean_log_prob``.

    Null and empty texts, and texts of white space, have no words, a sum of 0 and a null mean. Equal texts score alike; an
    empty table gives no rows. Scores are those of the rows alone, however they are partitioned or ordered."""
    inner = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = materialise(word_counts(inner.select("text")))
    words_known, totals = vocabulary(counts)
    total_words = counts.agg(F.sum("n")).first()[0] or 0
    texts = inner.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id"))
    given = docs.sparkSession.sparkContext.broadcast((train(texts, words_known, total_words), words_known))
    out = inner.select("doc_id").schema.add("n_words", "long").add("units", "long").add("rare", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = unpack(given.value[0]), given.value[1]
        for batch in batches:
            data, starts = flat_text(batch.column(1))
            n, sums, rare_before, rare = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows + 1, np.int64), []
            for i, j in runs_of_rows(starts, CHUNK):
                words, before = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                tokens = _tokens(words, known)
                logs = log_probabilities(weights, known.rows(neighbours(tokens, before)), known.classes(tokens)) + known.logs(tokens)
                total = np.concatenate([[0], np.cumsum(np.rint(logs * UNIT).astype(np.int64))])
                n[i:j], sums[i:j] = np.diff(before), total[before[1:]] - total[before[:-1]]
                unknown = (tokens >= COMMON) & (tokens < EDGE)
                rare.append(words[unknown].view(np.int64))
                rare_before[i + 1 : j + 1] = np.diff(np.concatenate([[0], np.cumsum(unknown)])[before])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(rare_before).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *rare])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums), lists], names=out.names)

    scored = materialise(inner.mapInArrow(run, out).withColumn("rid", F.monotonically_increasing_id()))
    # The words that are not known: their shares of their buckets, from the counts.
    total = F.greatest("n", F.element_at(F.array(*[F.lit(int(t)) for t in totals]), bucket() + 1))  # a common word is in no bucket
    shares = counts.select("word", F.round(F.log(F.col("n") / total) * UNIT).cast("long").alias("share"))
    each = scored.select("rid", F.explode("rare").alias("word"))
    added = each.join(shares, "word").groupBy("rid").agg(F.sum("share").alias("added"))
    whole = scored.join(added, "rid", "left")
    log_prob = (F.col("units") + F.coalesce("added", F.lit(0))) / F.lit(float(UNIT))
    mean = F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words"))
    return whole.select("doc_id", "n_words", log_prob.alias("log_prob")).withColumn("mean_log_prob", mean)

"""Quality by perplexity under an interpolated, modified Kneser-Ney model of trusted text.

Text is read as its UTF-8 bytes, each predicted in two steps: its symbol, one of 48 that bytes fold to, after the three symbols
before it, and the byte itself within its symbol after the three bytes before it. Their product is a distribution over all bytes.
Four-grams of all trusted documents are counted for both; shorter n-grams get continuation counts (how many symbols, or bytes,
they were seen after). Each order's counts are joined with the sums of their contexts, sharded by context, which gives discounted
probabilities and the weight left for the next shorter order.
As there are 48**4 four-grams of symbols at most, their model is a table of bounded size that scoring tasks hold in memory. That of
bytes grows with the trusted documents; scoring goes through it in ranges of four-grams, as many as it takes.
A document stays if its perplexity is within the threshold of its language: a quantile over the trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import flat_text, materialise, runs_of_rows, with_row_id

#: Symbols, and symbols in the longest n-gram.
SYMBOLS, ORDER = 48, 4
GRAMS = SYMBOLS**ORDER
#: What a discount takes off a count, and leaves of it, at least.
LEAST = 0.05
#: Share of a language's trusted documents whose perplexity is within its threshold.
QUANTILE = 0.995
#: Trusted ids up to which they are sent to every executor instead of shuffling the texts.
BROADCAST_IDS = 2_000_000
CHUNK = 1 << 20
#: Four-grams of bytes that scoring holds at a time, and counts that a task holds before it sends them on.
RANGE = HELD = 1 << 22
#: Log-probabilities are summed as whole multiples of one part in so many, so that sums do not depend on ranges.
UNIT = 1 << 32


def _fold() -> np.ndarray:
    """The symbol of each byte: 26 letters, capital, space, line end, digit, stop or comma, other mark, 16 beyond ASCII."""
    out = np.full(256, 31, np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(26)
    out[ord("A") : ord("Z") + 1] = 26
    out[[32, 9]] = 27
    out[[10, 13]] = 28
    out[ord("0") : ord("9") + 1] = 29
    out[[ord("."), ord(",")]] = 30
    out[128:] = 32 + np.arange(128) % 16
    return out


FOLD = _fold()
#: Bytes that are told apart by themselves, how many bytes fold to each symbol, and whether a byte is not the only one of its symbol.
BYTES, SIZES = np.arange(256, dtype=np.uint8), np.bincount(FOLD, minlength=SYMBOLS)
SEVERAL = SIZES[FOLD] > 1


def four_grams(data: np.ndarray, starts: np.ndarray, fold: np.ndarray = FOLD, symbols: int = SYMBOLS) -> np.ndarray:
    """The four-gram that ends at each byte of the texts on end; each text is preceded by line ends."""
    own, line_end = fold[data].astype(np.int64), int(fold[10])
    grams = own.copy()
    begin = np.repeat(starts[:-1], np.diff(starts))
    place = np.arange(len(data)) - begin
    for back in range(1, ORDER):
        before = np.full(len(data), line_end)
        before[back:] = own[:-back]
        grams += np.where(place >= back, before, line_end) * symbols**back
    return grams


def gram_counts(texts: DataFrame) -> DataFrame:
    """Rows (gram, n) over all texts; a task sends one row a four-gram at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(GRAMS, np.int64)
        for batch in batches:
            data, starts = flat_text(batch.column(0))
            for i, j in runs_of_rows(starts, CHUNK):
                own = four_grams(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
                np.add.at(sums, own, 1) if len(own) < 4096 else np.add(sums, np.bincount(own, minlength=GRAMS), out=sums)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What to take off counts of one, two, and more, from how many counts of one to four there are.

    Where these are too few to tell, half a count for each; never nothing, so that no symbol becomes impossible."""
    kinds = {r["n"]: r["k"] for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    t = [kinds.get(i, 0) for i in range(5)]
    if not all(t[1:]):
        return 0.5, 0.5, 0.5
    y = t[1] / (t[1] + 2 * t[2])
    return tuple(min(max(k - (k + 1) * y * t[k + 1] / t[k], LEAST), k - LEAST) for k in (1, 2, 3))


def byte_counts(texts: DataFrame) -> DataFrame:
    """Rows (gram, n) over all texts: four-grams of bytes, as their digits to the base 256, that end on a byte of :data:`SEVERAL`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(grams), pa.array(sums)], names=["gram", "n"])
        for batch in batches:
            data, starts = flat_text(batch.column(0))
            for i, j in runs_of_rows(starts, CHUNK):
                part = data[starts[i] : starts[j]]
                own, n = np.unique(four_grams(part, starts[i : j + 1] - starts[i], BYTES, 256)[SEVERAL[part]], return_counts=True)
                grams, at = np.unique(np.concatenate([grams, own]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, n]), len(grams)).astype(np.int64)
                if len(grams) > HELD:
                    yield rows()
                    grams, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield rows()

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def order_tables(counts: DataFrame, context: str = f"gram div {SYMBOLS}") -> tuple[DataFrame, DataFrame]:
    """For one order: (gram, p), the discounted share of the context, and (context, rest), the weight of the shorter order."""
    off = discounts(counts)
    less = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
    rows = counts.withColumn("context", F.expr(context)).withColumn("less", less)
    sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("less").alias("taken"))
    seen = rows.join(sums, "context").select("gram", ((F.col("n") - F.col("less")) / F.col("total")).alias("p"))
    return seen, sums.select("context", (F.col("taken") / F.col("total")).alias("rest"))


def log_probabilities(counts: DataFrame) -> np.ndarray:
    """The natural logarithm of each symbol's probability after the three before it, as a table over all four-grams."""
    counts = materialise(counts)
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # shorter n-grams count the symbols they were seen after
        shorter = orders[-1].groupBy(F.expr(f"gram % {SYMBOLS**k}").alias("gram"))
        orders.append(materialise(shorter.agg(F.count(F.lit(1)).alias("n"))))
    p = np.full(1, 1 / SYMBOLS)
    for k, own in enumerate(reversed(orders), start=1):
        seen, rest = (t.toArrow() for t in order_tables(own))
        weight = np.ones(SYMBOLS ** (k - 1))  # an unseen context leaves all to the shorter order
        weight[rest["context"].to_numpy()] = rest["rest"].to_numpy()
        shorter = np.broadcast_to(p, (SYMBOLS, 1)) if k == 1 else np.tile(p, SYMBOLS if k > 2 else 1).reshape(-1, SYMBOLS)
        p = (weight[:, None] * (shorter.T if k == 1 else shorter)).ravel()
        p[seen["gram"].to_numpy()] += seen["p"].to_numpy()
    return np.log(p).astype(np.float32)


@dataclass
class Order:
    """N-grams of bytes with their probabilities, and contexts with the weight of the shorter order; both by rising number.

    A context is an n-gram whose last byte is replaced by its symbol, as probabilities are those within the symbol."""

    grams: np.ndarray
    p: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray


#: The context of a column of n-grams of bytes.
CONTEXT = f"gram - gram % 256 + element_at(array({', '.join(map(str, FOLD.tolist()))}), cast(gram % 256 as int) + 1)"


def byte_orders(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from the shortest on: (gram, p), the interpolated probability of a byte within its symbol, and (context,
    rest). Shorter n-grams of one that was seen were seen as well, so each order is joined with the one before."""
    counts = materialise(counts)
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):
        orders.append(materialise(orders[-1].groupBy(F.expr(f"gram % {256**k}").alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, own in enumerate(reversed(orders), start=1):
        seen, rest = order_tables(own, CONTEXT)
        rest = materialise(rest)
        placed = seen.withColumn("context", F.expr(CONTEXT)).join(rest, "context").withColumnRenamed("p", "own")
        if k == 1:
            less = placed.withColumn("less", F.expr(f"1 / element_at(array({', '.join(map(str, SIZES.tolist()))}), cast(context as int) + 1)"))
        else:
            shorter = out[-1][0].select(F.col("gram").alias("shorter"), F.col("p").alias("less"))
            less = placed.withColumn("shorter", F.expr(f"gram % {256 ** (k - 1)}")).join(shorter, "shorter")
        out.append((materialise(less.select("gram", (F.col("own") + F.col("rest") * F.col("less")).alias("p"))), rest))
    return out


def _held(tables: tuple[DataFrame, DataFrame], lo: int = 0, hi: int = 256**ORDER) -> Order:
    """The n-grams from ``lo`` to ``hi``, and their contexts. Only limits that are multiples of 256 leave contexts whole."""
    columns = []
    for table, (key, value) in zip(tables, (("gram", "p"), ("context", "rest")), strict=True):
        rows = table.filter((F.col(key) >= lo) & (F.col(key) < hi)).select(F.col(key).alias("key"), F.col(value).cast("float").alias("value")).toArrow()
        keys, values = rows["key"].to_numpy().astype(np.uint32), rows["value"].to_numpy()
        order = np.argsort(keys)
        columns += [keys[order], values[order]]
    return Order(*columns)


def _ranges(grams: DataFrame) -> list[tuple[int, int]]:
    """Ranges of four-grams that cover all, each of some RANGE seen ones; their limits are multiples of 256."""
    prefix = grams.groupBy(F.expr(f"gram div {256**2}").alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy("prefix").toArrow()
    passed = np.cumsum(prefix["n"].to_numpy()) // RANGE
    limits = (prefix["prefix"].to_numpy()[1:][np.diff(passed) > 0] * 256**2).tolist()
    return list(zip([0, *limits], [*limits, 256**ORDER], strict=True))


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    if not len(keys):
        return otherwise
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def byte_logs(grams: np.ndarray, orders: list[Order]) -> np.ndarray:
    """The log-probability of the last byte of each four-gram within its symbol, after the bytes before it."""
    last = grams & 255
    p = 1 / SIZES[FOLD[last]]
    for k, order in enumerate(orders, start=1):
        own = grams % 256**k
        context = own - last + FOLD[last]
        p = _found(order.grams, order.p, own.astype(np.uint32), p * _found(order.contexts, order.rest, context.astype(np.uint32), np.ones(len(own))))
    return np.log(p)


def byte_sums(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows (rid, units) for rows (rid, text): the log-probabilities of all bytes within their symbols, in parts of one in UNIT."""
    tables = byte_orders(counts)
    shorter = [_held(t) for t in tables[:-1]]

    def scored(lo: int, hi: int) -> DataFrame:
        given = texts.sparkSession.sparkContext.broadcast([*shorter, _held(tables[-1], lo, hi)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, starts = flat_text(batch.column(1))
                units = np.zeros(batch.num_rows, np.int64)
                for i, j in runs_of_rows(starts, CHUNK):
                    part, own = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
                    grams = four_grams(part, own, BYTES, 256)
                    at = np.flatnonzero(SEVERAL[part] & (grams >= lo) & (grams < hi))
                    kinds, inverse = np.unique(grams[at], return_inverse=True)
                    logs = np.rint(byte_logs(kinds, given.value) * UNIT).astype(np.int64)[inverse]
                    sums = np.concatenate([[0], np.cumsum(logs)])[np.searchsorted(at, own)]
                    units[i:j] = np.diff(sums)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units)], names=["rid", "units"])

        return texts.mapInArrow(run, "rid long, units long")

    ranges = _ranges(tables[-1][0])
    if len(ranges) == 1:
        return scored(*ranges[0])
    parts = reduce(DataFrame.union, [materialise(scored(*r)) for r in ranges])
    return parts.groupBy("rid").agg(F.sum("units").alias("units"))


def trusted_rows(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` that ``labels`` calls good."""
    ids = labels.filter("quality = 1").select(F.col("doc_id").alias(id_col)).distinct()
    if ids.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), id_col, "left_semi")
    return docs.join(ids, id_col, "left_semi")


def perplexities(texts: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows (rid, n_symbols, log_prob) for rows (rid, text): their symbols only."""
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = flat_text(batch.column(1))
            sums = np.zeros(batch.num_rows)
            for i, j in runs_of_rows(starts, CHUNK):
                own = starts[i : j + 1] - starts[i]
                logs = np.concatenate([[0], np.cumsum(shared.value[four_grams(data[starts[i] : starts[j]], own)], dtype=np.float64)])
                sums[i:j] = logs[own[1:]] - logs[own[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts)), pa.array(sums)], names=["rid", "n_symbols", "log_prob"]
            )

    return texts.mapInArrow(run, "rid long, n_symbols long, log_prob double")


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``lang``, ``n_symbols`` (bytes), ``perplexity`` (per byte), ``threshold``, ``kept``.

    ``labels`` (doc_id, quality) says by quality 1 which texts to trust; repeats count once. Null and empty texts have no
    perplexity and are not kept. A null language counts as ``und``. A language without trusted rows has the threshold of all
    trusted rows together; if there are none at all, thresholds are null and every text with symbols stays."""
    docs, rid = with_row_id(docs, id_col)
    named = docs.select(
        F.col(rid).cast("long").alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    )
    trusted = trusted_rows(named, labels, "doc_id")
    table = log_probabilities(gram_counts(trusted.select("text")))
    texts = named.select("rid", "text")
    scored = perplexities(texts, table).join(byte_sums(texts, byte_counts(trusted.select("text"))), "rid")
    log_prob = F.col("log_prob") + F.col("units") / F.lit(float(UNIT))
    perplexity = F.when(F.col("n_symbols") > 0, F.exp(-log_prob / F.col("n_symbols")))
    scored = materialise(scored.select("rid", "n_symbols", perplexity.alias("perplexity")).join(named.drop("text"), "rid"))
    good = trusted_rows(scored, labels, "doc_id")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    per_language = good.groupBy("lang").agg(limit.alias("own"))
    overall = good.agg(limit.alias("all")).first()["all"]
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    out = scored.join(F.broadcast(per_language), "lang", "left").withColumn("threshold", threshold)
    within = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))
    kept = F.coalesce(F.col("perplexity").isNotNull() & within, F.lit(False))
    return out.select("doc_id", "lang", "n_symbols", "perplexity", "threshold", kept.alias("kept"))

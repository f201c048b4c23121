"""Near-duplicate groups of whole texts: banded MinHash, odd sketches, exact confirmation, components.

1. Every text becomes its set of five-word shingles, 128 MinHash values over that set, 32 band keys of four values each, and
   an odd sketch: the MinHash values folded into 512 parity bits. Equal sets are one class from here on.
2. Classes that share a band key are linked to the smallest class of that bucket, if the population count of the XOR of their
   sketches does not rule the similarity out and the exact sets confirm it. Components of these links are found by
   alternating star contraction.
3. Buckets that still hold several components are not paired out, since a passage that many texts share fills them with
   unlinked texts. Their texts are compared where they share one of their rarest shingles, which any two texts of the similarity
   do, and where the parities of their whole sets allow it: texts that differ in d shingles never differ in more than d bits.
   Neighbours under a common shingle meet first, so that components grow before all that remain apart are compared
   (:mod:`splitscope.llm.meetings`). Sketches rule out, exact sets confirm. So every pair that shares a bucket is confirmed,
   ruled out, or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm import meetings
from splitscope.llm.common import flat_text, materialise, mix64, runs_of_rows, with_row_id
from splitscope.llm.meetings import components

#: Words in a shingle.
SHINGLE = 5
#: Bands and MinHash values in each. A pair at 0.8 misses all buckets once in 20 million, one at 0.85 once in 18 billion.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Parity bits of a sketch.
SKETCH = 512
#: Standard deviations that sketches are trusted by: links are lost to them once in about ten billion.
CERTAIN = 6.4
#: Parity bits of a whole set, by which the join of rare shingles itself leaves near misses out.
PARITY = 1024
#: Cells that shingles are counted in for the order from rare to common.
CELLS = 1 << 20
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


def _salt(k: int) -> np.uint64:
    return U(k * int(STEP) & (2**64 - 1))


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the MinHash functions, from counters."""
    counter = np.arange(1, HASHES + 1, dtype=U)
    return mix64(counter * STEP) | U(1), mix64(counter * STEP + U(7))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse, modulo 2**64."""
    base = 0xA0761D6478BD642F
    return (
        np.cumprod(np.concatenate([[U(1)], np.full(n, U(base))])),
        np.cumprod(np.concatenate([[U(1)], np.full(n, U(pow(base, -1, 2**64)))])),
    )


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts on end, and the words before each text.

    Words are runs of bytes other than space and 9 to 13; A-Z count as a-z."""
    n = len(data)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    borders = starts[(starts > 0) & (starts < n)]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, U)
    np.cumsum((lower.astype(U) + U(1)) * up[:n], out=sums[1:])
    hashes = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * STEP)
    return hashes, np.searchsorted(a, starts)


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of the texts on end, sorted within each text, and the shingles before each text.

    A text of fewer than five words has its whole sequence as one shingle; one without words has none."""
    words, before = word_hashes(data, starts)
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    join = lambda parts: mix64(reduce(lambda h, w: mix64(h) * STEP + w, parts))
    full = max(0, len(words) - SHINGLE + 1)
    whole = owner[:full] == owner[SHINGLE - 1 :] if full else np.zeros(0, bool)
    hashes = [join([words[i : i + full] for i in range(SHINGLE)])[whole]] if full else []
    owners = [owner[:full][whole]]
    for size in range(1, SHINGLE):
        rows = np.flatnonzero(counts == size)
        if len(rows):
            hashes.append(join([words[before[rows] + i] for i in range(size)]) ^ U(size))
            owners.append(rows)
    if not hashes:
        return np.zeros(0, U), np.zeros(len(starts), np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(starts)))


def min_hashes(sets: np.ndarray, before: np.ndarray) -> np.ndarray:
    """HASHES minima for every set, none of which is empty."""
    factors, shifts = _factors()
    out = np.empty((len(before) - 1, HASHES), U)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(sets * factors[k] + shifts[k], before[:-1])
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.empty((len(minima), BANDS), U)
    for band in range(BANDS):
        part = [minima[:, band * ROWS + i] for i in range(ROWS)]
        keys[:, band] = mix64(reduce(lambda h, v: mix64(h) * STEP + v, part) + _salt(band))
    return keys.view(np.int64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """Bit p of a sketch is the parity of how many of the (function, minimum) pairs hash to p; as 64-bit words."""
    n = len(minima)
    at = mix64(minima + np.arange(HASHES, dtype=U) * STEP) % U(SKETCH)
    at = at.astype(np.int64) + np.arange(n)[:, None] * SKETCH
    odd = np.bincount(at.ravel(), minlength=n * SKETCH).reshape(n, SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def most_odd_bits(similarity: float) -> int:
    """The XOR population count that a pair of at least this similarity does not pass, but for odds of CERTAIN.

    Of k MinHash values some m differ, binomially; 2m elements then fall into the sketch's bits."""
    k, bits = HASHES, SKETCH
    differ = min(k, k * (1 - similarity) + CERTAIN * math.sqrt(k * similarity * (1 - similarity)) + 1)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    spread = bits / 4 * (1 - (1 - 4 / bits) ** (2 * differ)) * (2 * differ / bits) / (2 * differ / bits + 1)
    return math.ceil(mean + CERTAIN / 2 * math.sqrt(max(spread, 1)))


SIGNED = "rid long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def _signed_batch(rid: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    data, starts = flat_text(text)
    for i, j in runs_of_rows(starts, CHUNK):
        own = starts[i : j + 1] - starts[i]
        sets, before = shingle_sets(data[starts[i] : starts[j]], own)
        counts = np.diff(before)
        rows = np.flatnonzero(counts)
        tight = np.concatenate([before[:-1][rows], [len(sets)]])
        names = np.zeros((2, j - i), np.int64)
        bands, sketch = np.zeros((j - i, BANDS), np.int64), np.zeros((j - i, SKETCH // 64), np.int64)
        if len(rows):
            for k in range(2):
                names[k, rows] = np.add.reduceat(mix64(sets + _salt(k + 1)), tight[:-1]).view(np.int64)
            minima = min_hashes(sets, tight)
            bands[rows], sketch[rows] = band_keys(minima), odd_sketches(minima)
        lists = lambda m: pa.ListArray.from_arrays(
            np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel())
        )
        columns = [rid.slice(i, j - i), pa.array(counts, pa.int64()), *map(pa.array, names), lists(bands), lists(sketch)]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "n_shingles", "set_a", "set_b", "bands", "sketch"])


def signatures(texts: DataFrame) -> DataFrame:
    """A narrow row for each row (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _signed_batch(batch.column(0), batch.column(1))

    return texts.mapInArrow(run, SIGNED)


def _odd_bits(a: str, b: str, bits: int = SKETCH) -> Column:
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)]
    return reduce(lambda x, y: x + y, words)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda c: classes.select(
        F.col("rid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")
    )
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(sizes & (_odd_bits("sketch_a", "sketch_b") <= most_odd_bits(percent / 100))).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of the full shingle sets."""
    side = lambda c: texts.select(F.col("rid").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (data_a, starts_a), (data_b, starts_b) = flat_text(batch.column(2)), flat_text(batch.column(3))
            linked = np.zeros(batch.num_rows, bool)
            for i, j in runs_of_rows(starts_a + starts_b, CHUNK):
                a, at_a = shingle_sets(data_a[starts_a[i] : starts_a[j]], starts_a[i : j + 1] - starts_a[i])
                b, at_b = shingle_sets(data_b[starts_b[i] : starts_b[j]], starts_b[i : j + 1] - starts_b[i])
                for k in range(j - i):
                    x, y = a[at_a[k] : at_a[k + 1]], b[at_b[k] : at_b[k + 1]]
                    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                    common = int((y[at] == x).sum()) if len(x) and len(y) else 0
                    union = len(x) + len(y) - common
                    linked[i + k] = union > 0 and 100 * common >= percent * union
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _in_mixed_buckets(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The classes (rid) that share a bucket with a class of another component."""
    part = F.coalesce("component", "rid").alias("component")
    placed = members.join(parts, "rid", "left").select("key", "rid", part)
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi")
    return placed.join(mixed.select("key"), "key", "left_semi").select("rid").distinct()


def _each_set(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """The batch, the row and the shingle set of each text; texts are the last column."""
    for batch in batches:
        data, starts = flat_text(batch.column(batch.num_columns - 1))
        for i, j in runs_of_rows(starts, CHUNK):
            sets, before = shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            for k in range(j - i):
                yield batch, i + k, sets[before[k] : before[k + 1]]


def _cell_counts(texts: DataFrame) -> np.ndarray:
    """How many sets have a shingle in each of CELLS cells; at most that many sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CELLS, np.int64)
        for _, _, own in _each_set(batches):
            np.add.at(sums, (own % U(CELLS)).astype(np.int64), 1)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["cell", "n"])

    out = np.zeros(CELLS, np.int64)
    rows = texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def parities(own: np.ndarray) -> np.ndarray:
    """For each of PARITY bits whether an odd number of the set's shingles hash to it; as 64-bit words."""
    odd = np.bincount((own >> U(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parities_allow(percent: int) -> Column:
    """Whether sets of n_x and n_y shingles with parities parity_x and parity_y can have the similarity.

    That lets them differ in at most (100 - percent) * (n_x + n_y) / (100 + percent) shingles, d. The bits that differ are never
    more than d; in long sets they stay below by the odds of d balls in PARITY bins, taken with a margin of CERTAIN."""
    d = F.floor((100 - percent) * (F.col("n_x") + F.col("n_y")) / (100 + percent))
    one, two = F.pow(F.lit(1 - 2 / PARITY), d), F.pow(F.lit(1 - 4 / PARITY), d)
    variance = PARITY / 4 * (1 - one * one) + PARITY * (PARITY - 1) / 4 * (two - one * one)
    most = F.least(d, F.ceil(PARITY / 2 * (1 - one) + CERTAIN * F.sqrt(F.greatest(variance, F.lit(1.0)))))
    return _odd_bits("parity_x", "parity_y", PARITY) <= most


def _rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """Rows (token, rid): the rarest shingles of each set of (rid, text).

    Under any one order of all shingles, two sets of the similarity share one among the first n - ceil(percent * n / 100) + 1 of
    each. Ordered by how full their cell is, rare ones come first, and those alone in their cell match nothing."""
    cells = texts.sparkSession.sparkContext.broadcast(_cell_counts(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, own in _each_set(batches):
            full = cells.value[(own % U(CELLS)).astype(np.int64)]
            first = np.lexsort((own, full))[: len(own) + percent * len(own) // -100 + 1]
            first = first[full[first] > 1]
            if len(first):
                rid = np.full(len(first), batch.column(0)[row].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[first].view(np.int64)), pa.array(rid)], names=["token", "rid"])

    return texts.mapInArrow(run, "token long, rid long")


def _whole_parities(texts: DataFrame) -> DataFrame:
    """(rid, n, parity) for each (rid, text): the size of its set and the set's parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, own in _each_set(batches):
            columns = [batch.column(0).slice(row, 1), pa.array([len(own)]), pa.array([parities(own).tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "n", "parity"])

    return texts.mapInArrow(run, "rid long, n long, parity array<long>")


def _across(mixed: DataFrame, parts: DataFrame, edges: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Components once the classes (rid) of mixed buckets are linked across components too: they are tried where they share a
    rare shingle and where sizes, parities and sketches allow the similarity, group by group of components."""
    found = materialise(mixed.join(texts, "rid").select("rid", "text"))
    rows = materialise(_rare_shingles(found, percent))
    known = materialise(_whole_parities(found))
    allowed = (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & _parities_allow(percent)

    def confirm(pairs: DataFrame) -> DataFrame:
        return confirmed(_plausible(pairs, classes, percent), found, percent)

    return meetings.linked(rows, known, allowed, confirm, parts, edges)


def linked_rows(texts: DataFrame, percent: int) -> DataFrame:
    """For each row of (rid, text): ``rid``, ``n_shingles`` and ``component``, the smallest rid it is connected with."""
    signed = materialise(signatures(texts))
    names = ["n_shingles", "set_a", "set_b"]
    heads = signed.filter("n_shingles > 0").groupBy(*names).agg(F.min("rid").alias("head"))
    classes = materialise(signed.join(heads.select(F.col("head").alias("rid")), "rid", "left_semi"))
    keyed = classes.select("rid", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("rid").alias("a"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = materialise(keyed.join(buckets.select("key", "a"), "key"))
    stars = members.filter("rid != a").select("a", F.col("rid").alias("b")).distinct()
    tried = materialise(_plausible(stars, classes, percent))
    edges = materialise(confirmed(tried, texts, percent))
    parts = materialise(components(edges))
    parts = _across(_in_mixed_buckets(members.select("key", "rid"), parts), parts, edges, classes, texts, percent)
    own = signed.join(heads, names, "left").select("rid", "n_shingles", F.coalesce("head", "rid").alias("head"))
    placed = own.join(parts.select(F.col("rid").alias("head"), "component"), "head", "left")
    return placed.select("rid", "n_shingles", F.coalesce("component", "head").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id connected by links), ``kept``.

    Texts link at a Jaccard similarity of ``percent`` hundredths or more between their sets of five-word shingles. Null and
    empty texts, and texts of white space, link with nothing. Where ids are null or repeat, rows are numbered first:
    ``component_id`` is then the smallest id of the group, null if it has none, and of rows with that id one is kept."""
    docs, rid = with_row_id(docs, id_col)
    texts = docs.select(F.col(rid).cast("long").alias("rid"), F.col(text_col).alias("text"))
    placed = linked_rows(texts, percent)
    if rid == id_col:
        return placed.select(
            F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("rid") == F.col("component")).alias("kept")
        )
    placed = materialise(placed.join(docs.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id")), "rid"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))
    best = placed.groupBy("component").agg(first.alias("first"))
    return placed.join(best, "component").select(
        "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("rid") == F.col("first.rid")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    docs, rid = with_row_id(docs, id_col)
    placed = linked_rows(docs.select(F.col(rid).cast("long").alias("rid"), F.col(text_col).alias("text")), percent)
    stay = placed.filter("rid = component").select(F.col("rid").alias(rid))
    out = docs.join(stay, rid, "left_semi")
    return out if rid == id_col else out.drop(rid)

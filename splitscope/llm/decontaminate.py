"""Overlaps of documents with benchmark items that survive substituted words, found by spaced seeds.

Words are runs of letters and digits, lower-cased; in scripts that are written without spaces every letter is a word. A seed hashes the words at the places that a fixed mask cares about, and
ignores those between, so a substituted word there does not break it. Documents and items meet where seeds are equal;
the place of both gives an alignment. Around each such hit the item is laid along the document, and the alignment counts if in
some window of the item, 13 words or the whole item if it is shorter, at most two words differ (one in items of fewer than 13).

The two masks are chosen so that no such window is missed: whichever one or two of its words differ, one mask fits
between them. So the result is exact. Items of fewer than eight words have no room for a substitution: they are looked for word by
word, by a hash of all of them. It uses DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import materialise, text_or_empty, with_row_id

#: Places that each mask cares about. Fixed values; tests/llm checks by enumeration that they miss no window.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 6, 7))
#: Words of the window that has to agree, and of the shortest item that may differ in one.
WINDOW, SHORTEST = 13, 8
#: Benchmark seeds (some 40 bytes each) up to which they are sent to every executor instead of being shuffled.
BROADCAST_SEEDS = 500_000


# Scripts that are written without spaces between words.
UNSPACED = "[" + "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]"


def word_hashes(text: Column) -> Column:
    """An array with a 64-bit hash per word."""
    lower = F.lower(text)
    parted = F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    words = F.array_remove(F.split(parted, r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(k: int) -> Column:
    """The seeds of mask k over the array column ``h``, one per start."""
    cares = ", ".join(f"h[i + {o}]" for o in MASKS[k])
    last = MASKS[k][-1]
    return F.expr(
        f"CASE WHEN size(h) > {last} THEN transform(sequence(0, size(h) - {last + 1}), i -> xxhash64({k}, {cares})) "
        f"ELSE array() END"
    )


def _placed_seeds(rows: DataFrame, key: str) -> DataFrame:
    """A row (key, k, at, seed) for each seed of rows (key, h). The masks' seeds stand in one array, mask after mask."""
    arrays = rows.select(key, *[_seeds(k).alias(f"s{k}") for k in range(len(MASKS))])
    joined = F.concat(*[f"s{k}" for k in range(len(MASKS))])
    placed = arrays.select(key, F.size("s0").alias("n0"), F.posexplode(joined).alias("p", "seed"))
    return placed.select(key, "seed", F.when(F.col("p") < F.col("n0"), F.col("p")).otherwise(F.col("p") - F.col("n0")).alias("at"))


def _windows() -> Column:
    """The words that agree in each window of an alignment."""
    return F.expr(
        "transform(sequence(0, size(item) - w), s -> aggregate(slice(same, s + 1, w), 0, (n, x) -> n + x))"
    )


def _whole_items(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(rid, item_rid, n_same, n_window) for the items of fewer than eight words that documents hold as they are; None if there
    are no such items. Only runs of the lengths that items have are hashed."""
    short = items.filter(F.size("h") < SHORTEST)
    lengths = sorted(r[0] for r in short.select(F.size("h")).distinct().collect())  # seven at most
    if not lengths:
        return None

    def runs(n: int) -> Column:
        words = ", ".join(f"h[i + {k}]" for k in range(n))
        places = f"if(size(h) < {n}, array(), sequence(0, size(h) - {n}))"
        return F.expr(f"array_distinct(transform({places}, i -> named_struct('n', {n}, 'whole', xxhash64({n}, {words}))))")

    of_doc = F.concat(*[runs(n) for n in lengths])
    read = docs.select("rid", word_hashes(text_or_empty()).alias("h")).select("rid", F.inline(of_doc))
    asked = short.select(F.col("item").alias("item_rid"), "h").select("item_rid", F.inline(of_doc)).filter(F.size("h") == F.col("n"))
    if asked.count() <= BROADCAST_SEEDS:
        asked = F.broadcast(asked)
    found = read.join(asked, ["n", "whole"])
    return found.select("rid", "item_rid", F.col("n").alias("n_same"), F.col("n").alias("n_window"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (rid, item_rid, n_same, n_window) per document and item that overlap.

    ``docs`` and ``benchmark`` have the columns ``rid``, which tells rows apart, and ``text``. The alignment with the most agreeing words of a window
    counts. Null and empty texts, and items without words, overlap with nothing."""
    text = text_or_empty()
    items = materialise(benchmark.select(F.col("rid").alias("item"), word_hashes(text).alias("h")).filter(F.size("h") > 0))
    long = items.filter(F.size("h") >= SHORTEST)
    asked = _placed_seeds(long, "item").withColumnRenamed("at", "item_at")
    if asked.count() <= BROADCAST_SEEDS:
        asked = F.broadcast(asked)
    read = _placed_seeds(docs.select("rid", word_hashes(text).alias("h")), "rid")
    hits = read.join(asked, "seed").select("rid", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    sizes = long.select("item", F.size("h").alias("n"))
    hits = materialise(hits.distinct().join(sizes, "item").groupBy("rid").agg(F.collect_list(F.struct("item", "shift", "n")).alias("hits")))
    # Written out, as the optimiser would otherwise put the hashing of the text inside the loop over the hits.
    hashed = materialise(docs.select("rid", text.alias("text")).join(hits, "rid").select("rid", word_hashes(F.col("text")).alias("h"), "hits"))
    # Of the document, a row for each hit has only the words that the item is laid along.
    along = F.expr(
        "transform(hits, x -> named_struct('item_rid', x.item, 'shift', least(x.shift, 0), "
        "'own', slice(h, greatest(x.shift, 0) + 1, x.n + least(x.shift, 0))))"
    )
    laid = hashed.select("rid", F.inline(along)).join(long.select(F.col("item").alias("item_rid"), F.col("h").alias("item")), "item_rid")
    same = F.expr("transform(item, (x, k) -> CASE WHEN get(own, shift + k) = x THEN 1 ELSE 0 END)")
    laid = laid.select("rid", "item_rid", "item", same.alias("same"), F.least(F.lit(WINDOW), F.size("item")).alias("w"))
    best = laid.select("rid", "item_rid", F.array_max(_windows()).alias("n_same"), F.col("w").alias("n_window"))
    differ = F.when(F.col("n_window") < WINDOW, 1).otherwise(2)
    found = best.filter(F.col("n_same") >= F.col("n_window") - differ).groupBy("rid", "item_rid").agg(
        F.max("n_same").alias("n_same"), F.first("n_window").alias("n_window")
    )
    whole = _whole_items(docs, items)
    return found if whole is None else found.unionByName(whole)


def _numbered(table: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """The table with row ids, its narrow form (rid, text, id), and the name of the row-id column."""
    table, rid = with_row_id(table, id_col)
    return table, table.select(F.col(rid).alias("rid"), F.col(text_col).alias("text"), F.col(id_col).alias("id")), rid


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id``, ``item_id``, ``n_same``, ``n_window``.

    Null and empty texts, and items without words, overlap with nothing. Items of fewer than eight words overlap where they stand
    as they are. Rows with null or repeated ids count each
    for themselves; an empty table on either side gives no rows."""
    _, texts, _ = _numbered(docs, id_col, text_col)
    _, items, _ = _numbered(benchmark, "item_id", "text")
    pairs = overlaps(texts, items)
    ids = texts.select("rid", F.col("id").alias("doc_id"))
    names = items.select(F.col("rid").alias("item_rid"), F.col("id").alias("item_id"))
    return pairs.join(ids, "rid").join(names, "item_rid").select("doc_id", "item_id", "n_same", "n_window")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, with all their columns. Null and empty texts stay; an empty
    table gives an empty one, an empty benchmark drops nothing."""
    docs, texts, rid = _numbered(docs, id_col, text_col)
    pairs = overlaps(texts, _numbered(benchmark, "item_id", "text")[1])
    out = docs.join(pairs.select(F.col("rid").alias(rid)).distinct(), rid, "left_anti")
    return out if rid == id_col else out.drop(rid)

"""Jaccard join of word n-gram sets with several global token orders.

1. Every text becomes its set of five-word shingles. Equal sets are one class, told by its size and 128 bits.
2. Shingles are dealt out by hash, each task gets all occurrences of its share, as packed arrays, and counts the classes that
   have each one. A class keeps only the shingles it shares with another; if they are fewer than the similarity asks of its
   size, nothing can link with it.
3. Three global orders rank shingles by that count, rare ones first, and break ties each in a way of its own. Two sets of the
   similarity share a shingle among the first few of each under every order: candidates come from the first order and must
   share one under the others too. How many shingles a class shares with nobody, and the parities of those it shares,
   refute most of the rest; what is left is verified on the whole sets.
4. Links are sought between different components only (:mod:`splitscope.llm.meetings`), so no group of copies is paired out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm import meetings
from splitscope.llm.common import flat_text, materialise, mix64, runs_of_rows, with_row_id
from splitscope.llm.near_dedup import shingle_sets

#: Token orders; the first one finds candidates, the others confirm them.
ORDERS = 3
#: Parity bits of a class's shared shingles.
PARITY = 1024
#: Shingles that one task counts at a time, and bytes of text hashed at a time.
SHARE, CHUNK = 1 << 21, 1 << 22
#: Destinations for each part; more of them hold less in memory at a time.
SPREAD = 4

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)
LOW = U((1 << 48) - 1)


def _salt(k: int) -> np.uint64:
    return U(k * int(STEP) & (2**64 - 1))


def _sets(column: pa.Array, chunk: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column of texts with their shingles and the shingles before each row."""
    data, starts = flat_text(column)
    for i, j in runs_of_rows(starts, chunk):
        sets, before = shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        yield i, j, sets, before


def _names(sets: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Two 64-bit names of each set; zeros for an empty one."""
    rows = np.flatnonzero(np.diff(before))
    names = np.zeros((2, len(before) - 1), np.int64)
    for k in range(2):
        if len(rows):
            names[k, rows] = np.add.reduceat(mix64(sets + _salt(k + 11)), before[:-1][rows]).view(np.int64)
    return names


def named_sets(texts: DataFrame) -> DataFrame:
    """(rid, n_shingles, set_a, set_b) for each row (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, before in _sets(batch.column(1), CHUNK):
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(before)), *map(pa.array, _names(sets, before))]
                yield pa.RecordBatch.from_arrays(columns, names=["rid", "n_shingles", "set_a", "set_b"])

    return texts.mapInArrow(run, "rid long, n_shingles long, set_a long, set_b long")


def _dealt(texts: DataFrame, parts: int) -> DataFrame:
    """Rows (part, sets, counts, tokens): the shingles of a few texts that fall to a part, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, before in _sets(batch.column(1), CHUNK):
                names = _names(sets, before)[0]
                _, first = np.unique(names, return_index=True)  # copies side by side count once
                keep = np.zeros(len(names), bool)
                keep[first] = True
                owner = np.repeat(np.arange(len(names)), np.diff(before))
                sets, owner = sets[keep[owner]], owner[keep[owner]]
                part = ((sets >> U(40)) * U(parts) >> U(24)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at = np.searchsorted(part[order], np.arange(parts + 1))
                low = np.ascontiguousarray((sets & LOW).astype("<u8")[order]).view(np.uint8).reshape(-1, 8)[:, :6]
                owner = owner[order]
                columns: tuple[list, ...] = ([], [], [], [])
                for p in np.flatnonzero(np.diff(at)):
                    here = slice(at[p], at[p + 1])
                    rows, counts = np.unique(owner[here], return_counts=True)
                    for c, v in zip(columns, (int(p), names[rows].tobytes(), counts.astype(np.int32).tobytes(), low[here].tobytes()), strict=True):
                        c.append(v)
                types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "sets", "counts", "tokens"])

    return texts.mapInArrow(run, "part long, sets binary, counts binary, tokens binary")


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(v.as_py(), kind) for v in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _shared_of_part(table: pa.Table, ranges: int) -> pa.Table:
    """(dest, sets, counts, tokens, ranks): the shingles of this part that several sets share, packed by where their sets are
    gathered. A rank is the number of sets that have the shingle, as a power of two in eighths."""
    part = table["part"][0].as_py() if table.num_rows else 0
    owner = np.repeat(_joined(table["sets"], np.int64), _joined(table["counts"], np.int32))
    raw = _joined(table["tokens"], np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    token = wide.view("<u8").ravel()
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])  # the copies of a text may come from several tasks
    token, owner = token[new], owner[new]
    _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
    have = counts[inverse] > 1
    token, owner, rank = token[have], owner[have], np.ceil(8 * np.log2(counts[inverse][have])).astype(np.uint8)
    token = token | U((part & 0xFFFF) << 48)
    order = np.argsort(owner, kind="stable")
    token, owner, rank = token[order], owner[order], rank[order]
    sets, first, counts = np.unique(owner, return_index=True, return_counts=True)
    ends = np.append(first, len(owner))
    # Names are spread evenly, so those of a destination stand side by side.
    dest = _destination(sets, ranges)
    at = np.append(np.flatnonzero(np.diff(dest, prepend=-1)), len(sets))
    return pa.table(
        {
            "dest": pa.array(dest[at[:-1]], pa.int64()),
            "sets": pa.array([sets[i:j].tobytes() for i, j in pairwise(at)], pa.binary()),
            "counts": pa.array([counts[i:j].astype(np.int32).tobytes() for i, j in pairwise(at)], pa.binary()),
            "tokens": pa.array([token[ends[i] : ends[j]].tobytes() for i, j in pairwise(at)], pa.binary()),
            "ranks": pa.array([rank[ends[i] : ends[j]].tobytes() for i, j in pairwise(at)], pa.binary()),
        }
    )


def _destination(sets: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many ranges of equal width the names of sets fall into."""
    return ((sets >> np.int64(32)) + np.int64(1 << 31)) * ranges >> np.int64(32)


def _gathered(heads: pa.Table, packed: pa.Table, percent: int) -> pa.Table:
    """(rid, n, tokens, ranks) for the heads of a destination of whose shingles enough are shared, from the rows of all parts."""
    owner = _joined(packed["sets"], np.int64)
    counts = _joined(packed["counts"], np.int32).astype(np.int64)
    order = np.argsort(np.repeat(owner, counts), kind="stable")
    token, rank = _joined(packed["tokens"], U)[order], _joined(packed["ranks"], np.uint8)[order]
    sets, inverse = np.unique(owner, return_inverse=True)
    shared = np.append(np.bincount(inverse, counts, len(sets)).astype(np.int64), 0)
    ends = np.concatenate([[0], np.cumsum(shared)])
    name, n = (heads[c].to_numpy() for c in ("set_a", "n_shingles"))
    at = np.searchsorted(sets, name)
    at[np.append(sets, 0)[at] != name] = len(sets)
    enough = (shared[at] > 0) & (100 * shared[at] >= percent * n)
    at = at[enough].tolist()
    return pa.table(
        {
            "rid": pa.array(heads["head"].to_numpy()[enough], pa.int64()),
            "n": pa.array(n[enough], pa.int64()),
            "tokens": pa.array([token[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary()),
            "ranks": pa.array([rank[ends[i] : ends[i + 1]].tobytes() for i in at], pa.binary()),
        }
    )


def shared_tokens(texts: DataFrame, heads: DataFrame, total: int, percent: int) -> DataFrame:
    """(rid, n, tokens, ranks): the shingles that a set shares with others, for each of ``heads`` that may link with another.

    A part sends one row to each destination, however many sets have shingles in it; destinations grow with parts."""
    parts = max(1, -(-total // SHARE))
    ranges = SPREAD * parts
    dealt = _dealt(texts, parts).repartition(parts, "part")
    packed = dealt.groupBy("part").applyInArrow(
        lambda table: _shared_of_part(table, ranges), "dest long, sets binary, counts binary, tokens binary, ranks binary"
    )
    dest = F.shiftright((F.shiftright("set_a", 32) + F.lit(1 << 31)) * F.lit(ranges), 32).alias("dest")
    dealt_heads = heads.select(dest, "head", "n_shingles", "set_a")
    return (
        dealt_heads.groupBy("dest")
        .cogroup(packed.groupBy("dest"))
        .applyInArrow(lambda own, found: _gathered(own, found, percent), "rid long, n long, tokens binary, ranks binary")
    )


def prefix_length(n: int, percent: int) -> int:
    """How many of a set's first n shingles hold one of any set of the similarity, whatever the order."""
    return n + percent * n // -100 + 1


def _parities(values: np.ndarray) -> list[int]:
    odd = np.bincount((mix64(values) % U(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


CLASS = "rid long, n long, alone long, shared binary, parity array<long>, prefixes array<array<long>>"


def classes(gathered: DataFrame, percent: int) -> DataFrame:
    """From (rid, n, tokens, ranks): a class's sorted shared shingles, their parities, and its prefix under each
    order.

    Shingles of one class only come first in every order, so its prefixes begin with all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                token = np.frombuffer(row["tokens"], U)
                rank = np.frombuffer(row["ranks"], np.uint8)
                alone = row["n"] - len(token)
                length = prefix_length(row["n"], percent) - alone
                firsts = [token[np.lexsort((mix64(token + _salt(k)), rank))[:length]] for k in range(ORDERS)]
                values = (
                    row["rid"], row["n"], alone, np.sort(token).tobytes(),
                    _parities(token), [f.view(np.int64).tolist() for f in firsts],
                )
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            longs = pa.list_(pa.int64())
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), longs, pa.list_(longs)]
            names = ["rid", "n", "alone", "shared", "parity", "prefixes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return gathered.mapInArrow(run, CLASS)


def allowed(percent: int) -> Column:
    """Whether two classes can have the similarity, given what is known of them without their shingles.

    They may differ in d shingles at most; they do in those that either has alone, and in one at least for each parity that
    differs."""
    d = F.floor((100 - percent) * (F.col("n_x") + F.col("n_y")) / (100 + percent))
    odd = [F.bit_count(F.col("parity_x")[i].bitwiseXOR(F.col("parity_y")[i])) for i in range(PARITY // 64)]
    alone = F.col("alone_x") + F.col("alone_y")
    sizes = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    return sizes & (alone <= d) & (alone + reduce(lambda a, b: a + b, odd) <= d)


def under_all_orders(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b), found under the first order, whose prefixes under each further order share a shingle as well."""
    side = lambda c: known.select(F.col("rid").alias(c), F.col("prefixes").alias(f"prefixes_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = [F.arrays_overlap(F.col("prefixes_a")[k], F.col("prefixes_b")[k]) for k in range(1, ORDERS)]
    return both.filter(reduce(lambda a, b: a & b, shared)).select("a", "b")


def verified(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union. What two sets have in common is among the shingles
    that each shares with others."""
    side = lambda c: known.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("shared").alias(f"shared_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "shared_a", "shared_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(False) + batch.column(3).to_numpy(False)
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), U) for c in (4, 5))
                common = int(np.isin(x, y, assume_unique=True).sum())
                linked[i] = 100 * common >= percent * (sizes[i] - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def linked_rows(texts: DataFrame, percent: int) -> DataFrame:
    """For each row of (rid, text): ``rid``, ``n_shingles`` and ``component``, the smallest rid it is connected with."""
    named = materialise(named_sets(texts))
    keys = ["n_shingles", "set_a", "set_b"]
    heads = materialise(named.filter("n_shingles > 0").groupBy(*keys).agg(F.min("rid").alias("head")))
    total = heads.agg(F.sum("n_shingles")).first()[0] or 0
    gathered = shared_tokens(texts, heads, total, percent)
    known = materialise(classes(gathered, percent))
    rows = materialise(known.select(F.explode(F.col("prefixes")[0]).alias("token"), "rid"))
    parts = meetings.linked(
        rows, known.select("rid", "n", "alone", "parity"), allowed(percent), lambda p: verified(under_all_orders(p, known), known, percent)
    )
    own = named.join(heads, keys, "left").select("rid", "n_shingles", F.coalesce("head", "rid").alias("component"))
    if parts is None:
        return own
    moved = parts.select(F.col("rid").alias("component"), F.col("component").alias("root"))
    return own.join(moved, "component", "left").select("rid", "n_shingles", F.coalesce("root", "component").alias("component"))


def similar_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, the smallest id that links reach, its own included.

    Texts link when their sets of five-word shingles have a Jaccard similarity of ``percent`` hundredths or more; a text of
    fewer words has its whole sequence as one shingle. Null and empty texts and texts of white space have no shingle and link
    with nothing. An empty table gives an empty result. Other columns are not looked at. Where ids are null or repeat, rows are
    numbered first: ``component_id`` is then the smallest id of the group, null if it has none."""
    docs, rid = with_row_id(docs, id_col)
    texts = docs.select(F.col(rid).cast("long").alias("rid"), F.col(text_col).alias("text"))
    placed = linked_rows(texts, percent)
    if rid == id_col:
        return placed.select(F.col("rid").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
    placed = materialise(placed.join(docs.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id")), "rid"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "component").select("doc_id", "n_shingles", "component_id")

"""Exact deduplication against a history of digests held in minimal perfect hash tables.

The history's distinct SHA-256 digests are dealt into shards of bounded size. Each shard is a minimal perfect hash: levels
of bit maps that give every historical digest a slot of its own, and slots that hold the full digest, the group's size and
the locator (id and row) of the historical winner. A digest that is looked up always lands on some slot, so all 32 bytes are
compared before it counts as a member. Members fold into their slot; the other digests form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import materialise, mix64, text_or_empty, with_row_id

#: Digests per shard, on average; an index row of a shard is some 60 bytes a digest.
SHARD = 20_000
#: Bits per digest in a level.
SPREAD = 2
#: Stands for a null id: smaller than every id.
NO_ID = -(2**63)

INDEX = "shard int, widths array<int>, bits binary, digests binary, ids binary, rows binary, sizes binary"
GROUPS = "digest binary, keep_doc long, keep_row long, group_size long"


def _words(digests: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each digest (n x 4 words), another one for each level."""
    return mix64(digests[:, 0] ^ mix64(digests[:, 1] + np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))))


def perfect_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Widths of the levels and their bits on end: a digest's slot is the number of bits before its own."""
    widths, bits, left = [], [], digests
    while len(left):
        width = max(8, len(left) * SPREAD)
        at = (_words(left, len(widths)) % np.uint64(width)).astype(np.int64)
        alone = np.bincount(at, minlength=width) == 1
        widths.append(width)
        bits.append(alone)
        left = left[~alone[at]]
    return widths, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(digests: np.ndarray, widths: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 where no level has a bit for it. Strangers may get a slot."""
    before = np.concatenate([[0], np.cumsum(bits)])
    found, open_, base = np.full(len(digests), -1), np.arange(len(digests)), 0
    for level, width in enumerate(widths):
        at = base + (_words(digests[open_], level) % np.uint64(width)).astype(np.int64)
        hit = bits[at]
        found[open_[hit]] = before[at[hit]]
        open_, base = open_[~hit], base + width
    return found


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    widths, bits = perfect_hash(digests)
    order = np.argsort(slots(digests, widths, bits))
    column = lambda name: pdf[name].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame(
        [(pdf["shard"].iloc[0], widths, np.packbits(bits).tobytes(), digests[order].tobytes(), column("doc"), column("row"), column("n"))],
        columns=["shard", "widths", "bits", "digests", "ids", "rows", "sizes"],
    )


def _look_up(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The groups of one shard: every slot, with the batch's members folded in, then every stranger."""
    parts = []
    strange = np.ones(len(batch), bool)
    if len(index):
        shard = index.iloc[0]
        kept = np.frombuffer(shard["digests"], "<u8").reshape(-1, 4)
        ids, rows, sizes = (np.frombuffer(shard[k], np.int64).copy() for k in ("ids", "rows", "sizes"))
        if len(batch):
            bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8))[: int(sum(shard["widths"]))].astype(bool)
            asked = _matrix(batch["digest"])
            at = slots(asked, list(shard["widths"]), bits)
            member = (at >= 0) & (kept[at] == asked).all(axis=1)
            strange = ~member
            own, doc, row = at[member], batch["doc"].to_numpy(np.int64)[member], batch["row"].to_numpy(np.int64)[member]
            sizes[own] += batch["n"].to_numpy(np.int64)[member]
            newer = (doc > ids[own]) | ((doc == ids[own]) & (row > rows[own]))
            ids[own[newer]], rows[own[newer]] = doc[newer], row[newer]
        raw = shard["digests"]
        parts.append(pd.DataFrame({"digest": [raw[i : i + 32] for i in range(0, len(raw), 32)], "keep_doc": ids, "keep_row": rows, "group_size": sizes}))
    if strange.any():
        own = batch[strange]
        parts.append(pd.DataFrame({"digest": own["digest"], "keep_doc": own["doc"], "keep_row": own["row"], "group_size": own["n"]}))
    return pd.concat(parts) if parts else pd.DataFrame(columns=["digest", "keep_doc", "keep_row", "group_size"])


def digest_rows(docs: DataFrame, historical: Column, id_col: str, text_col: str, row: Column) -> DataFrame:
    """One narrow row per document, written once: ``id``, ``doc`` (id or NO_ID), ``row``, ``digest``, ``old``."""
    digest = F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256))
    return materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
            row.alias("row"),
            digest.alias("digest"),
            F.coalesce(historical, F.lit(False)).alias("old"),
        )
    )


def _distinct(rows: DataFrame, shards: int) -> DataFrame:
    """A row per digest with its largest (doc, row); combined on the map side, so a hot text is one row a task."""
    best = F.max(F.struct("doc", "row")).alias("best")
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).select("digest", "best.doc", "best.row", "n", shard)


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the history's distinct digests."""
    return _distinct(rows, shards).groupBy("shard").applyInPandas(_build, INDEX)


def group_digests(index: DataFrame, batch: DataFrame, shards: int) -> DataFrame:
    """A row per distinct digest of history and batch: winner and size."""
    return _distinct(batch, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, GROUPS)


def _judge(rows: DataFrame) -> DataFrame:
    shards = 1 + rows.select("digest").distinct().count() // SHARD
    groups = group_digests(build_index(rows.filter("old"), shards), rows.filter("not old"), shards)
    return rows.join(groups, "digest", "left").withColumn("kept", F.col("row") == F.col("keep_row"))


def exact_dedup(docs: DataFrame, historical: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``historical`` says which rows the index is built from; all rows are judged, historical ones too. Equal texts form
    a group, null counts as empty. The row with the largest id stays; a null id is smaller than any other. Of rows that
    repeat the same id and text exactly one stays. ``keep_id`` is null only if all ids of the group are. An empty
    table gives no rows."""
    return _judge(digest_rows(docs, historical, id_col, text_col, F.monotonically_increasing_id())).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("keep_doc") != NO_ID, F.col("keep_doc")).alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def older_half(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """Ids up to the middle of their range: the part of one table that came first, where no other history is given."""
    ends = docs.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
    return F.col(id_col) <= F.lit(None if ends["a"] is None else (ends["a"] + ends["b"]) // 2).cast("long")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in :func:`exact_dedup`."""
    docs, rid = with_row_id(docs, id_col)
    rows = digest_rows(docs, older_half(docs, id_col), id_col, text_col, F.col(rid).cast("long"))
    kept = _judge(rows).filter("kept").select(F.col("row").alias(rid))
    out = docs.join(kept, rid, "left_semi")
    return out if rid == id_col else out.drop(rid)

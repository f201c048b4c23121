"""Helpers shared by the corpus operators: row ids, shared scratch tables, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="splitscope-"))
    return (where or spark.sparkContext.getCheckpointDir()).rstrip("/")


#: Tables written inside the innermost :func:`tidied`, a list for each.
_WRITTEN: list[list[str]] = []


def materialise(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder; later work starts from there, also after a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    for written in _WRITTEN[-1:]:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()``, written to the shared folder, and all tables that were written on the way removed from it."""
    _WRITTEN.append([])
    try:
        kept = materialise(build())
    finally:
        written = _WRITTEN.pop()
    for path in written[:-1]:
        removed(spark, path)
    return kept


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def done_with(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialise` wrote, once nothing starts from them any more."""
    for table in tables:
        for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
            removed(table.sparkSession, path)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until it clashes with no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows and the name of a column that tells them apart.

    That is ``id_col`` if it has no nulls and no repeats; otherwise rows are numbered and written once, since numbers
    given out by a plan that runs twice may differ."""
    seen = docs.agg(
        F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids"), F.count_distinct(id_col).alias("kinds")
    ).first()
    if dict(docs.dtypes)[id_col] in ("bigint", "int") and seen["n"] == seen["ids"] == seen["kinds"]:
        return docs, id_col
    rid = fresh(docs, "row_id")
    return materialise(docs.withColumn(rid, F.monotonically_increasing_id())), rid


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column on end, and where each row starts (one more entry at the end)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    if data is None or not len(starts):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def runs_of_rows(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay under ``limit``; a row longer than that stands alone."""
    i, rows = 0, len(starts) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit over the word (fixed odd factors)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))

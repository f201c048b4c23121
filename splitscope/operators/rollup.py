"""Distinct users that roll up: exact bitmaps per day and segment, merged instead of counted anew.

Users get dense numbers once. A set of users is then a bitmap for each 32,768 numbers that occur in it, and the sets of several
days, channels or methods are united by OR. Whatever is summed up later, the events are not read again, and rows that meet are
bitmaps, not users.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitscope.sources.scratch import shared_path

USER, NUMBER = "user_pseudo_id", "user_number"


def numbered_users(users: DataFrame, path: str | None = None) -> DataFrame:
    """``user_pseudo_id, user_number`` for the distinct users of a frame, numbered from 1 without gaps; null is no user.

    Rows are written with a number inside their part file's task; what earlier tasks hold is added from one count per task,
    which is all that the driver sees."""
    spark = users.sparkSession
    path = path or shared_path(spark, "users")
    inside = F.monotonically_increasing_id()
    distinct = users.select(USER).where(F.col(USER).isNotNull()).distinct()
    distinct.select(USER, F.shiftright(inside, 33).alias("task"), inside.bitwiseAND(2**33 - 1).alias("nth")).write.parquet(path)
    rows = spark.read.schema(f"{USER} string, task bigint, nth bigint").parquet(path)
    starts, so_far = {}, 1
    for task, n in sorted(tuple(r) for r in rows.groupBy("task").count().collect()):
        starts[task], so_far = so_far, so_far + n
    if not starts:
        return rows.select(USER, F.col("nth").alias(NUMBER))
    offsets = spark.createDataFrame(sorted(starts.items()), "task bigint, start bigint")
    return rows.join(F.broadcast(offsets), "task").select(USER, (F.col("start") + F.col("nth")).alias(NUMBER))


def user_bitmaps(rows: DataFrame, numbers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys..., bucket, users``: the sets of users of each group, as bitmaps. Rows without a user belong to no set."""
    found = rows.where(F.col(USER).isNotNull()).select(*keys, USER).distinct().join(numbers, USER)
    number = F.col(NUMBER)
    return found.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("users")
    )


def rolled_up(bitmaps: DataFrame, keys: Sequence[str], count: str = "users") -> DataFrame:
    """Distinct users per group of fewer keys: the bitmaps of a bucket are united, and bits counted. ``count`` names the result."""
    united = bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    return united.groupBy(*keys).agg(F.sum(F.bitmap_count("users")).alias(count))

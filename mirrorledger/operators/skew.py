"""Lookups that survive hot keys.

Source rows of one key may be a third of all rows (uncompressed raw files share one length, empty files share one
fingerprint). The looked-up side has one row per key, so the hot source keys are found by a pre-aggregated count and
spread over salts, and only their looked-up rows are repeated.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
NULL_SALTS = 256


def hot_threshold(rows: int, hot_rows: int = HOT_ROWS) -> int:
    """Rows above which a key is hot. At most ``MAX_HOT_KEYS`` keys can exceed it, which bounds what is broadcast."""
    return max(hot_rows, rows // MAX_HOT_KEYS)


def suspects(rows: DataFrame, row_count: int, hot_rows: int = HOT_ROWS, key: str = "file_length") -> DataFrame:
    """The rows that can belong to a hot key of any key set containing ``key``: those of a hot ``key`` itself.

    Counting by one low-cardinality column is cheap, and where no length is hot the finer counts see no rows.
    """
    return rows.join(_hot(rows, [key], hot_threshold(row_count, hot_rows)).select(key), key, "left_semi")


def _hot(rows: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > threshold)
    return F.broadcast(counted.select(*keys, F.ceil(F.col("__rows") / threshold).cast("int").alias("__salts")))


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    *,
    spread_by: Column,
    left_rows: int | None = None,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    hot_among: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` with ``right`` (at most one row per key) on ``keys``; ``how`` is left, inner, left_semi, left_anti.

    ``spread_by`` tells the rows of one key apart. With a known ``left_rows`` no larger than ``hot_rows`` no key can be
    hot and a plain join is planned. ``hot_among`` holds at least all left rows of hot keys and is cheaper to read than
    ``left`` (a written table, when ``left`` is itself the result of lookups).
    """
    if left_rows is None:
        left_rows = left.count()
    if left_rows <= hot_rows:
        return left.join(right, keys, how)
    hot = _hot(left if hot_among is None else hot_among, keys, hot_threshold(left_rows, hot_rows))
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.xxhash64(spread_by)
    # Rows with a null key match nothing but would otherwise all land in one task.
    salt = F.when(any_null, F.pmod(spread, F.lit(NULL_SALTS))).otherwise(
        F.coalesce(F.pmod(spread, F.col("__salts")), F.lit(0))
    )
    salted_left = left.join(hot, keys, "left").withColumn("__salt", salt.cast("int")).drop("__salts")
    salted_right = (
        right.join(hot, keys, "left")
        .withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)))
        .drop("__salts")
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")

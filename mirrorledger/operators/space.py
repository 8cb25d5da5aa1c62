"""Which files of an ordered batch still fit into a destination's free space.

The rule is sequential: files go in inventory order, each takes space when it fits, and after the first that does not,
later ones are only taken when strictly smaller than what is left. A running total alone is not enough, because files
left out take no space. The work is split so that no destination's files meet in one task:

1. a distributed running total finds the first overflow; everything before it fits;
2. from there on the budget is below the size of one file. With a budget in [2^k, 2^(k+1)), every file below 2^k fits
   until an event: a file of at least 2^k that fits at its place, or a small one that takes the budget below 2^k. Both
   are taken and leave less than 2^k, so at most 63 passes follow, each an aggregate over the files that can still fit;
3. once few candidates remain they are finished in one pass per destination.
"""

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import materialise

ORDER = ["path_key", "relative_path"]
FINISH_ROWS = 100_000
PART_ROWS = 500_000


def left_out(
    rows: DataFrame, free_bytes: dict[str, int | None], *, partitions: int | None = None, finish_rows: int = FINISH_ROWS
) -> DataFrame:
    """``(dest_id, relative_path)`` of the files that do not fit.

    ``rows``: ``dest_id, path_key, relative_path, file_length``, unique per destination and path. Destinations with
    unknown free space take everything.
    """
    known = {d: b for d, b in free_bytes.items() if b is not None}
    if not known:
        return rows.select("dest_id", "relative_path").limit(0)
    needed = rows.where(F.col("dest_id").isin(list(known))).groupBy("dest_id")
    # One row per destination: a handful.
    needed = needed.agg(F.sum("file_length").alias("bytes"), F.count(F.lit(1)).alias("files")).collect()
    budget = {r["dest_id"]: known[r["dest_id"]] for r in needed if r["bytes"] > known[r["dest_id"]]}
    if not budget:
        return rows.select("dest_id", "relative_path").limit(0)

    parts = partitions or 2 + sum(r["files"] for r in needed) // PART_ROWS
    ordered = (
        rows.where(F.col("dest_id").isin(list(budget)))
        .select("dest_id", *ORDER, "file_length")
        .repartitionByRange(parts, *ORDER)
        .withColumn("part", F.spark_partition_id())
    )
    ordered, _ = materialise(ordered, "space")

    after: dict[str, tuple[str, str]] = {}
    taken: list[Column] = []
    overflow = _running(ordered).where(F.col("before") + F.col("file_length") > _per_destination(budget))
    for dest, event in _first(overflow).items():
        taken.append((F.col("dest_id") == dest) & (_position() < _at(event)))
        after[dest] = (event["path_key"], event["relative_path"])
        # From here on a file must be strictly smaller than what is left.
        budget[dest] -= event["before"] + 1

    finished = None
    while budget := {d: b for d, b in budget.items() if b >= 0}:
        candidates = ordered.where(
            _any_of((F.col("dest_id") == d) & (_position() > _tuple(after[d])) & (F.col("file_length") <= b)
                    for d, b in budget.items())
        )
        remaining = candidates.count()
        if remaining == 0:
            break
        if remaining <= finish_rows:
            finished = _finish(candidates, budget)
            break
        floor = {d: 1 << (b.bit_length() - 1) if b else 1 for d, b in budget.items()}
        small = F.col("file_length") < _per_destination(floor)
        left = _per_destination(budget) - F.col("before")
        running = _running(candidates, small)
        event_row = (small & (left - F.col("file_length") < _per_destination(floor))) | (
            ~small & (F.col("file_length") <= left)
        )
        # A budget of zero admits empty files only and never changes.
        events = _first(running.where(event_row & (_per_destination(budget) > 0)))
        for dest in list(budget):
            inside = (F.col("dest_id") == dest) & (_position() > _tuple(after[dest]))
            fits = F.col("file_length") < floor[dest]
            if dest not in events:
                taken.append(inside & fits)
                del budget[dest]
                continue
            event = events[dest]
            taken.append(inside & (((_position() < _at(event)) & fits) | (_position() == _at(event))))
            after[dest] = (event["path_key"], event["relative_path"])
            budget[dest] -= event["before"] + event["file_length"]

    out = ordered.where(~_any_of(taken)).select("dest_id", "relative_path")
    return out if finished is None else out.join(finished, ["dest_id", "relative_path"], "left_anti")


def _any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _position() -> Column:
    return F.struct(*ORDER)


def _tuple(position: tuple[str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(ORDER, position)])


def _at(event) -> Column:
    return _tuple((event["path_key"], event["relative_path"]))


def _per_destination(values: dict[str, int]) -> Column:
    column = F.lit(None).cast("bigint")
    for dest, value in values.items():
        column = F.when(F.col("dest_id") == dest, F.lit(value).cast("bigint")).otherwise(column)
    return column


def _running(rows: DataFrame, counted: Column | None = None) -> DataFrame:
    """Add ``before``: the bytes of the counted files ahead of each file on its destination.

    Range partitions are summed first; the few sums give each partition its starting total, and inside a partition a
    window runs over that partition's rows only.
    """
    size = F.col("file_length") if counted is None else F.when(counted, F.col("file_length")).otherwise(0)
    sums = rows.groupBy("dest_id", "part").agg(F.sum(size).alias("part_sum"))
    earlier = Window.partitionBy("dest_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("dest_id", "part", F.coalesce(F.sum("part_sum").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("dest_id", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("ahead", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(F.broadcast(starts), ["dest_id", "part"])
        .withColumn("before", F.col("start") + F.col("ahead"))
    )


def _first(rows: DataFrame) -> dict:
    """The first row per destination: one row each, so collecting them is bounded."""
    firsts = rows.groupBy("dest_id").agg(F.min(F.struct(*ORDER, "file_length", "before")).alias("event"))
    return {r["dest_id"]: r["event"] for r in firsts.collect()}


def _finish(candidates: DataFrame, budget: dict[str, int]) -> DataFrame:
    """The last candidates (at most ``finish_rows``), taken one by one per destination."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORDER)
        left = budget[pdf["dest_id"].iloc[0]]
        kept = []
        for size in pdf["file_length"]:
            kept.append(size <= left)
            left -= size if size <= left else 0
        return pdf.loc[kept, ["dest_id", "relative_path"]]

    return candidates.groupBy("dest_id").applyInPandas(take, "dest_id string, relative_path string")

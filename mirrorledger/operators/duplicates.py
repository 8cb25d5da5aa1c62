"""Redundant copies on the destinations, guided by the source.

Only destination files that also occur in the source count. The stages narrow: (length, category) with at least two
destination files, then (length, category, head, tail) known to the source, then the deep or full fingerprint. All
group decisions run on tables aggregated per key and destination, so a hot key never gathers its files in one task; files
are numbered by destination and inventory order once, so aggregates are of numbers and the files come back through one
lookup in :func:`duplicate_items`.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import text
from ..functions.paths import extension, file_name, fold
from ..workspace import materialise
from .inventory import Destination, enabled, with_keys
from .skew import HOT_ROWS, lookup, suspects

STAGE_FINGERPRINTS = {
    "SuperFast": [],
    "Quick": ["head_fp", "tail_fp"],
    "Deep": ["head_fp", "tail_fp", "deep_fp"],
    "Full": ["head_fp", "tail_fp", "full_fp"],
}


def _group_keys(mode: str) -> list[str]:
    """What makes two files one group. Category takes part only without fingerprints."""
    return {
        "SuperFast": ["file_length", "category"],
        "Quick": ["file_length", "head_fp", "tail_fp"],
        "Deep": ["file_length", "deep_fp"],
        "Full": ["file_length", "full_fp"],
    }[mode]


def _fine_keys(mode: str) -> list[str]:
    return ["file_length", "category", *STAGE_FINGERPRINTS[mode]]


def group_key(mode: str) -> Column:
    if mode == "SuperFast":
        return F.concat(F.lit("meta_"), F.col("file_length").cast("string"), F.lit("_"), F.col("category"))
    if mode == "Quick":
        return F.concat_ws("_", fp.as_hex(F.col("head_fp")), fp.as_hex(F.col("tail_fp")))
    return fp.as_hex(F.col("deep_fp" if mode == "Deep" else "full_fp"))


@dataclass(frozen=True)
class Audit:
    """What groups and items are derived from. ``files``: enabled destinations' files with their ``place``; ``copies``: the
    surviving ones counted per (length, category, fingerprints, destination), with the place of the first. Both written."""

    mode: str
    files: DataFrame
    copies: DataFrame
    rows: int
    hot_rows: int


def audit(
    source: DataFrame, inventory: DataFrame, destinations: list[Destination], mode: str, *, hot_rows: int = HOT_ROWS
) -> Audit:
    fps, keys = STAGE_FINGERPRINTS[mode], _fine_keys(mode)
    order = F.lit(None).cast("int")
    for i, d in enumerate(enabled(destinations)):
        order = F.when(F.col("root_id") == d.dest_id, i).otherwise(order)
    rows = with_keys(inventory.withColumn("dest_order", order).where(F.col("dest_order").isNotNull()))
    rows = rows.select("dest_order", "path_key", "relative_path", "full_path", "root_id", *keys)
    rows = rows.orderBy("dest_order", "path_key", "relative_path", "full_path").drop("path_key")
    files, n = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "destination-files")

    copies = files.groupBy(*keys, "dest_order", "root_id").agg(
        F.count(F.lit(1)).alias("copies"), F.min("place").alias("first")
    )
    if n > hot_rows:
        copies, _ = materialise(copies, "copies")
    counted = copies

    def among(rows: DataFrame, names: list[str], wanted: DataFrame) -> DataFrame:
        """Many different contents may share a length, or edges: such keys are spread."""
        return lookup(
            rows, wanted.select(*names).distinct(), names, spread_by=F.xxhash64(*keys, "root_id"), left_rows=n,
            how="left_semi", hot_rows=hot_rows, hot_among=counted,
        )

    def crowded(names: list[str], rows: DataFrame) -> DataFrame:
        return rows.groupBy(*names).agg(F.sum("copies").alias("n")).where("n > 1")

    length = ["file_length", "category"]
    known = source.select(*keys).distinct()
    buckets = crowded(length, copies).join(known.select(*length).distinct(), length, "left_semi")
    copies = among(copies, length, buckets)
    if fps:
        copies = among(copies, [*length, "head_fp", "tail_fp"], known)
    if len(fps) > 2:
        # Only edge groups with two files are examined further; the deeper source key ignores category.
        edges = ["file_length", "head_fp", "tail_fp"]
        buckets = buckets.select(*length)
        known = lookup(
            known, buckets, length, spread_by=F.xxhash64(*keys), left_rows=n, how="left_semi", hot_rows=hot_rows
        )
        copies = among(among(copies, edges, crowded(edges, copies)), _group_keys(mode), known)
    copies, _ = materialise(copies, "surviving-copies")
    return Audit(mode, files, copies, n, hot_rows)


def _per_destination(found: Audit) -> DataFrame:
    return found.copies.groupBy(*_group_keys(found.mode), "dest_order", "root_id").agg(
        F.sum("copies").alias("copies"), F.min("first").alias("first")
    )


def _metrics(per_destination: DataFrame, found: Audit) -> DataFrame:
    """One row per group. ``content``: all its keys in full, where ``group_key`` shows 64 bits of a fingerprint."""
    keys = _group_keys(found.mode)
    redundant = F.col("copies") - 1
    groups = (
        per_destination.groupBy(*keys)
        .agg(
            F.sum("copies").alias("files"),
            F.count(F.lit(1)).alias("destinations"),
            F.sum(redundant).alias("redundant_copies"),
            (F.sum(redundant) * F.col("file_length")).alias("reclaimable_bytes"),
            (F.max("copies") > 1).alias("is_intra"),
            (F.count(F.lit(1)) > 1).alias("is_cross"),
            F.min("first").alias("place"),
        )
        .where("files > 1")
        .withColumn("group_key", group_key(found.mode))
        .withColumn("content", F.concat_ws("/", *keys))
    )
    return groups.join(found.files.select("place", F.col("full_path").alias("first_path")), "place").drop("place")


def find_duplicates(
    source: DataFrame | None,
    inventory: DataFrame | None,
    destinations: list[Destination],
    mode: str,
    *,
    found: Audit | None = None,
) -> DataFrame:
    """One row per group: key, size, counts, reclaimable bytes, intra and cross flags, first file, full key."""
    found = found or audit(source, inventory, destinations, mode)
    return _metrics(_per_destination(found), found).select(
        "group_key", F.col("file_length").alias("file_size"), "files", "destinations", "redundant_copies",
        "reclaimable_bytes", "is_intra", "is_cross", "first_path", "content",
    )


def duplicate_items(
    source: DataFrame | None,
    inventory: DataFrame | None,
    destinations: list[Destination],
    mode: str,
    *,
    hot_rows: int = HOT_ROWS,
    found: Audit | None = None,
) -> DataFrame:
    """One row per file of a group. The primary of a destination is its first copy in inventory order."""
    found = found or audit(source, inventory, destinations, mode, hot_rows=hot_rows)
    keys, fine_keys = _group_keys(mode), [*_fine_keys(mode), "root_id"]
    per_destination = _per_destination(found)
    groups = _metrics(per_destination, found)
    info = per_destination.join(groups.drop("files", "destinations", "redundant_copies"), keys).select(
        *keys, "root_id", "group_key", "content", F.col("copies").alias("copies_here"), F.col("first").alias("primary"),
        "reclaimable_bytes", "is_intra", "is_cross", "first_path",
    )
    fine = found.copies.select(*fine_keys).join(info, [*keys, "root_id"])
    names = F.col("root_id")
    for d in destinations:
        names = F.when(F.col("root_id") == d.dest_id, d.name or d.dest_id).otherwise(names)
    items = lookup(
        found.files,
        fine,
        fine_keys,
        spread_by=F.col("place"),
        left_rows=found.rows,
        how="inner",
        hot_rows=found.hot_rows,
        hot_among=suspects(found.files, found.rows, found.hot_rows) if found.rows > found.hot_rows else None,
    )
    is_primary = F.col("place") == F.col("primary")
    return items.select(
        "group_key",
        F.col("file_length").alias("file_size"),
        "dest_order",
        F.col("root_id").alias("dest_id"),
        names.alias("dest_name"),
        "relative_path",
        "full_path",
        is_primary.alias("is_primary"),
        ((F.col("copies_here") > 1) | ~is_primary).alias("is_same_destination_duplicate"),
        "reclaimable_bytes",
        "is_intra",
        "is_cross",
        "first_path",
        "content",
    )


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("redundant_copies"), F.lit(0)).alias("duplicate_copies"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
        F.count(F.when(F.col("is_cross"), 1)).alias("cross_destination_groups"),
    )


def largest_groups(groups: DataFrame, k: int) -> DataFrame:
    """The k groups with the most reclaimable bytes; ties by size, then key."""
    return groups.orderBy(F.desc("reclaimable_bytes"), F.desc("file_size"), "group_key").limit(k)


def filtered_groups(groups: DataFrame, items: DataFrame, show: str = "All", search: str = "") -> DataFrame:
    """Groups of one kind in which the group's name or any member's path contains the text, ignoring case."""
    kinds = {"DuplicatesOnly": F.col("is_intra"), "RedundancyOnly": ~F.col("is_intra")}
    chosen = groups.where(kinds[show]) if show in kinds else groups
    needle = search.strip()
    if not needle:
        return chosen
    wanted = fold(F.lit(needle))
    member = fold(F.col("relative_path")).contains(wanted) | fold(F.col("full_path")).contains(wanted)
    # The group's own name is the name of its first member, so members cover it.
    return chosen.join(items.where(member).select("content").distinct(), "content", "left_semi")


def group_texts(groups: DataFrame) -> DataFrame:
    return groups.select(
        "group_key",
        file_name(F.col("first_path")).alias("file_name"),
        F.upper(extension(F.col("first_path"))).alias("extension"),
        text.report_size(F.col("file_size")).alias("size_text"),
        text.report_size(F.col("reclaimable_bytes")).alias("reclaimable_text"),
        text.redundancy_badge(F.col("is_intra"), F.col("is_cross")).alias("badge"),
        text.redundancy_type(F.col("is_intra"), F.col("is_cross")).alias("redundancy_type"),
    )

"""Inventory tables: one row per file of a root.

Columns: ``root_id, relative_path, full_path, file_length, mtime, category``. A fingerprinted inventory adds
``head_fp, tail_fp, deep_fp, full_fp`` (null where the mode does not need them) and ``error``.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions.constants import HEAD_TAIL_BYTES
from ..functions.media import category_of, in_preset
from ..functions.paths import extension, file_name, fold, in_ignored_directory

BASE_COLUMNS = ["root_id", "relative_path", "full_path", "file_length", "mtime", "category"]
FINGERPRINTS = ["head_fp", "tail_fp", "deep_fp", "full_fp"]
MODE_FINGERPRINTS = {
    "SuperFast": [],
    "Quick": ["head_fp", "tail_fp"],
    "Deep": ["deep_fp"],
    "Full": ["head_fp", "tail_fp", "full_fp"],
}


@dataclass(frozen=True)
class Destination:
    """One backup root. The list of destinations is configuration: a handful, known to the driver."""

    dest_id: str
    name: str = ""
    root_path: str = ""
    is_enabled: bool = True
    is_required: bool = True
    free_bytes: int | None = None
    is_available: bool = True


def enabled(destinations: list[Destination]) -> list[Destination]:
    """The enabled destinations, in order. Ids that are equal ignoring case are an error."""
    active = [d for d in destinations if d.is_enabled]
    if len({d.dest_id.upper() for d in active}) != len(active):
        raise ValueError("destination ids must be unique (ignoring case)")
    return active


def from_content(rows: DataFrame) -> DataFrame:
    """Treat table rows as files: ``root_id, root_path, relative_path, body`` (text or binary) and maybe ``mtime``."""
    path, body = F.col("relative_path"), F.col("body").cast("binary")
    return rows.select(
        "root_id",
        "relative_path",
        F.concat_ws("/", F.rtrim(F.col("root_path"), F.lit("/")), path).alias("full_path"),
        F.octet_length(body).cast("bigint").alias("file_length"),
        (F.col("mtime") if "mtime" in rows.columns else F.lit(None)).cast("timestamp").alias("mtime"),
        category_of(extension(path)).alias("category"),
        body.alias("content"),
    )


def admitted(inventory: DataFrame, preset: str | None) -> DataFrame:
    """Drop files outside the preset, without an extension, hidden, or below an ignored folder."""
    path = F.col("relative_path")
    hidden = F.concat(F.lit("/"), path).contains("/.")
    return inventory.where(
        (extension(path) != "") & in_preset(extension(path), preset) & ~hidden & ~in_ignored_directory(path)
    )


def fingerprint_content(
    inventory: DataFrame,
    wanted: str | list[str],
    *,
    chunk: int = HEAD_TAIL_BYTES,
    tiers: fp.ProbeTiers = fp.ProbeTiers(),
    algorithm: str = "md5",
) -> DataFrame:
    """Fingerprint rows that carry their content, in the scan itself, and drop the content before any shuffle.

    ``wanted`` is a mode or a list of fingerprint columns; the others stay null.
    """
    wanted = MODE_FINGERPRINTS[wanted] if isinstance(wanted, str) else wanted
    body, length = F.col("content"), F.col("file_length")
    computed = {
        "head_fp": lambda: fp.head(body, length, chunk, algorithm),
        "tail_fp": lambda: fp.tail(body, length, chunk, algorithm),
        "deep_fp": lambda: fp.deep(body, length, tiers, algorithm),
        "full_fp": lambda: fp.full(body, length, algorithm),
    }
    none = F.lit(None).cast("string")
    return inventory.select(
        *[c for c in inventory.columns if c not in ("content", *FINGERPRINTS, "error")],
        *[(computed[name]() if name in wanted else none).alias(name) for name in FINGERPRINTS],
        none.alias("error"),
    )


def with_keys(inventory: DataFrame) -> DataFrame:
    """Add the ignore-case comparison keys of path and file name."""
    return inventory.withColumn("path_key", fold(F.col("relative_path"))).withColumn(
        "name_key", fold(file_name(F.col("full_path")))
    )


def totals(inventory: DataFrame, root_ids: list[str] | None = None) -> DataFrame:
    """Files and bytes per root; with ``root_ids`` (configuration-sized) also 0 and 0 for those without files."""
    counted = inventory.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("file_length"), F.lit(0)).alias("total_bytes")
    )
    if root_ids is None:
        return counted
    roots = inventory.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(root_ids)], "root_id string")
    return roots.join(counted, "root_id", "full_outer").fillna(0, ["total_files", "total_bytes"])


def by_category(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("root_id", "category").agg(
        F.count(F.lit(1)).alias("files"), F.sum("file_length").alias("bytes")
    )


def shared_lengths(source: DataFrame, destination: DataFrame) -> DataFrame:
    """The lengths that occur on both sides. Only their files can match, so only they are worth reading."""
    return source.select("file_length").distinct().intersect(destination.select("file_length").distinct())


def size_pruned(inventory: DataFrame, lengths: DataFrame, rows: int | None = None) -> DataFrame:
    from .skew import lookup

    return lookup(
        inventory, lengths, ["file_length"], spread_by=F.col("full_path"), left_rows=rows, how="left_semi"
    )

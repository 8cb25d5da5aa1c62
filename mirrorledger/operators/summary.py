"""Counts, verdict and per-destination figures over match results."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .inventory import Destination
from .match import unprotected, verdicts


def summarize(results: DataFrame, mode: str, source_path: str = "") -> DataFrame:
    """Always one row: counts per overall status and the safety verdict."""

    def n(status):
        return F.count(F.when(F.col("overall_status") == status, 1))

    counts = results.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("file_length"), F.lit(0)).alias("total_bytes"),
        n("Verified").alias("fully_verified_files"),
        n("Partial").alias("partially_verified_files"),
        n("Missing").alias("missing_files"),
        n("Corrupt").alias("corrupt_files"),
    )
    verdict = (
        F.when(F.col("total_files") == 0, "NoMediaFound")
        .when((F.col("corrupt_files") > 0) | (F.col("missing_files") > 0), "UnsafeToFormat")
        .when(F.col("partially_verified_files") > 0, "PartiallyBackedUp")
        .otherwise("SafeToFormat")
    )
    return counts.select(
        F.lit(source_path).alias("source_path"), F.lit(mode).alias("mode"), "*", verdict.alias("safety_status")
    )


def protection(summary: DataFrame) -> DataFrame:
    """Backed-up percentage and unprotected counts of a summary row."""
    total, full, partial = F.col("total_files"), F.col("fully_verified_files"), F.col("partially_verified_files")
    missing, corrupt = F.col("missing_files"), F.col("corrupt_files")
    return summary.select(
        "safety_status",
        text.backup_percentage(total, full, partial).alias("backup_percentage"),
        (missing + corrupt).alias("unprotected"),
        (missing + partial + corrupt).alias("unprotected_files"),
        text.verdict_banner(F.col("safety_status"), total, full, partial, missing, corrupt).alias("banner"),
        text.verdict_badge(F.col("safety_status"), missing, corrupt).alias("badge"),
        text.verdict_colour(F.col("safety_status")).alias("colour"),
        text.mode_label(F.col("mode")).alias("mode_label"),
    )


def status_by_destination(results: DataFrame) -> DataFrame:
    """One row per destination with a column per status."""
    statuses = ["Verified", "Missing", "Corrupt"]
    rows = verdicts(results).groupBy("dest_order", "dest_id", "root_path").pivot("status", statuses).count()
    return rows.select(
        "dest_order",
        "dest_id",
        text.destination_label(F.col("root_path"), F.col("dest_id")).alias("label"),
        *[F.coalesce(F.col(s), F.lit(0)).alias(s.lower()) for s in statuses],
    )


def destination_labels(results: DataFrame) -> DataFrame:
    """The distinct destinations in order, with the label reports use."""
    return (
        verdicts(results)
        .groupBy("dest_id")
        .agg(
            F.min("dest_order").alias("dest_order"),
            F.min_by(text.destination_label(F.col("root_path"), F.col("dest_id")), "dest_order").alias("label"),
        )
    )


def capacity_check(results: DataFrame, destinations: list[Destination]) -> DataFrame:
    """Bytes still to be copied against the free space of each enabled destination."""
    required = unprotected(results).agg(F.coalesce(F.sum("file_length"), F.lit(0)).alias("required_bytes"))
    spaces = F.array(
        *[
            F.struct(
                F.lit(d.dest_id).alias("dest_id"),
                F.lit(d.free_bytes).cast("bigint").alias("free_bytes"),
            )
            for d in destinations
            if d.is_enabled
        ]
    ).cast("array<struct<dest_id:string,free_bytes:bigint>>")
    short = F.coalesce(F.col("required_bytes") > F.col("free_bytes"), F.lit(False))
    warning = F.concat(
        F.lit("Insufficient space: needs "),
        text.capacity_size(F.col("required_bytes")),
        F.lit(", only "),
        text.capacity_size(F.col("free_bytes")),
        F.lit(" free"),
    )
    return required.select("required_bytes", F.inline(spaces)).select(
        "dest_id",
        "required_bytes",
        "free_bytes",
        short.alias("has_warning"),
        F.when(short, warning).otherwise("").alias("warning"),
    )

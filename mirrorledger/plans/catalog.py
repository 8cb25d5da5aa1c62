"""The registered queries: one per operator, each over the given tables."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints as fp
from ..functions import text
from ..functions.constants import MODES
from ..operators import copying
from ..operators import duplicates as dup
from ..operators import inventory as inv
from ..operators import match as m
from ..operators import summary as s
from ..workspace import materialise
from . import catalog_io, trees, verify

Query = Callable[[SparkSession, str], DataFrame]

MATCH_COLUMNS = [
    "relative_path", "file_length", "category", "dest_id", "status", "matched_path", "failure_reason", "dest_head_fp",
    "dest_tail_fp", "dest_deep_fp", "dest_full_fp",
]


def _fingerprints(mode: str, *columns) -> Query:
    def run(spark, sf):
        rows = inv.fingerprint_content(trees.all_roots(spark, sf), mode, chunk=trees.CHUNK, tiers=trees.TIERS)
        return rows.select("root_id", "relative_path", "file_length", *columns)

    return run


def probe_plan(spark, sf):
    plan = fp.probe_plan(F.col("file_length"), trees.TIERS)
    return trees.card(spark, sf).select(
        "relative_path", "file_length", F.inline(plan).alias("slice_offset", "slice_length")
    )


def probe_plan_media(spark, sf):
    """The plan with its default sizes, for lengths in the range of media files."""
    rows = trees.table(spark, sf, "orders").select(
        "o_orderkey", F.floor(F.col("o_totalprice") * 1000).alias("file_length")
    )
    rows = rows.withColumn("plan", fp.probe_plan(F.col("file_length")))

    def total(name):
        return F.aggregate("plan", F.lit(0).cast("bigint"), lambda acc, x: acc + x[name])

    return rows.select(
        "o_orderkey", "file_length", F.size("plan").cast("bigint").alias("slices"), total("length").alias("bytes_read"),
        total("offset").alias("offset_sum"),
    )


def size_prune(spark, sf):
    # Lengths of content tables cost a read of the content, so the metadata is written once.
    columns = ["root_id", "relative_path", "full_path", "file_length"]
    rows, n = materialise(trees.all_roots(spark, sf).select(*columns), "inventory")
    lengths = inv.shared_lengths(rows.where("root_id = 'card'"), rows.where("root_id <> 'card'"))
    return inv.size_pruned(rows, lengths, n).select("root_id", "relative_path", "file_length")


def _match(mode: str) -> Query:
    return lambda spark, sf: m.verdicts(verify.results(spark, sf, mode)).select(*MATCH_COLUMNS)


def _summary(mode: str) -> Query:
    return lambda spark, sf: s.summarize(verify.results(spark, sf, mode), mode, trees.CARD_ROOT)


def _groups(mode: str) -> Query:
    return lambda spark, sf: verify.duplicates(spark, sf, mode)[0].drop("content")


def _totals(mode: str) -> Query:
    return lambda spark, sf: dup.duplicate_totals(verify.duplicates(spark, sf, mode)[0])


def match_reasons(spark, sf):
    rows = m.verdicts(verify.results(spark, sf, "Full"))
    return rows.groupBy("dest_id", "status", F.coalesce("failure_reason", F.lit("")).alias("failure_reason")).agg(
        F.count(F.lit(1)).alias("files")
    )


def file_overall_status(spark, sf):
    """Flagship: the status of every card file after a Quick verification against both backups."""
    return verify.results(spark, sf, "Quick").select("relative_path", "file_length", "category", "overall_status")


def file_overall_status_long(spark, sf):
    return m.fold_verdicts(m.verdicts(verify.results(spark, sf, "Quick")).drop("overall_status"), ["relative_path"])


def result_filter(spark, sf):
    rows = m.with_tab(verify.results(spark, sf, "Full"), "Corrupt", " src1 ")
    return rows.select("relative_path", "overall_status")


def dup_items_quick(spark, sf):
    items = verify.duplicates(spark, sf, "Quick")[1]
    return items.select(
        "group_key", "file_size", "dest_id", "dest_name", "relative_path", "is_primary",
        "is_same_destination_duplicate",
        text.copy_badge(F.col("is_same_destination_duplicate"), F.col("is_primary")).alias("badge"),
    )


def dup_top_k(spark, sf):
    groups = verify.duplicates(spark, sf, "Full")[0]
    return dup.largest_groups(groups, 20).select("group_key", "file_size", "reclaimable_bytes")


def dup_filter(spark, sf):
    groups, items = verify.duplicates(spark, sf, "Full")
    return dup.filtered_groups(groups, items, "DuplicatesOnly", "src1").select("group_key", "file_size", "files")


PLAN_COLUMNS = ["dest_id", "relative_path", "file_length", "action", "target_path", "error"]


# A disabled destination may carry another's id and root in other letters; an empty one has figures too.
ALL_DESTINATIONS = [
    trees.SSD, inv.Destination("NAS", "Old NAS", "/MNT/SSD", is_enabled=False), trees.NAS, inv.Destination("tape", "Tape", "/tape"),
]


def match_enabled(spark, sf):
    rows = m.verdicts(verify.results(spark, sf, "Quick", ALL_DESTINATIONS))
    return rows.groupBy("dest_id", "status").agg(F.count(F.lit(1)).alias("files"))


def inventory_totals_all(spark, sf):
    """A row for every enabled root, with or without files."""
    return inv.totals(trees.all_roots(spark, sf), ["card", *[d.dest_id for d in inv.enabled(ALL_DESTINATIONS)]])


def copy_plan_distinct_roots(spark, sf):
    """Two spellings of one root and a blank root: each root is planned for once."""
    given = [
        replace(trees.SSD, dest_id="ssd"), replace(trees.SSD, dest_id="again", root_path="/MNT/SSD"),
        replace(trees.NAS, dest_id="blank"), replace(trees.NAS, root_path="/nas"),
    ]
    return verify.plan_copies(spark, sf, destinations=copying.one_per_root(given)).select(*PLAN_COLUMNS)


def copy_sibling_lookup(spark, sf):
    """Files whose path is taken but which a numbered sibling already holds."""
    plan = verify.plan_copies(spark, sf)
    return plan.where("action = 'SKIP_SIBLING'").select("dest_id", "relative_path")


def verify_copies(spark, sf):
    """The planned writes checked against the backups as they are, before any copy."""
    plan = verify.plan_copies(spark, sf)
    fresh, _ = trees.fingerprinted(trees.backups(spark, sf), "Quick", "fresh")
    checked = copying.verify_copies(plan, fresh, plan.withColumn("target_path", F.col("relative_path")))
    return checked.select("dest_id", "relative_path", "outcome")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "inventory_by_category": lambda spark, sf: inv.by_category(trees.all_roots(spark, sf)),
        "inventory_totals": lambda spark, sf: inv.totals(trees.all_roots(spark, sf)),
        "fingerprint_head_tail": _fingerprints("Quick", "head_fp", "tail_fp"),
        "fingerprint_full": lambda spark, sf: _fingerprints("Full", "full_fp")(spark, sf).withColumn(
            "full_hash", fp.as_hex(F.col("full_fp"))
        ),
        "fingerprint_deep": _fingerprints("Deep", "deep_fp"),
        "probe_plan": probe_plan,
        "probe_plan_media": probe_plan_media,
        "size_prune": size_prune,
        "match_reasons": match_reasons,
        "file_overall_status": file_overall_status,
        "file_overall_status_long": file_overall_status_long,
        "status_by_destination": lambda spark, sf: s.status_by_destination(verify.results(spark, sf, "Full")),
        "destination_labels": lambda spark, sf: s.destination_labels(verify.results(spark, sf, "Quick")),
        "hash_comparison": lambda spark, sf: m.comparison_rows(verify.results(spark, sf, "Full"), fp.as_hex),
        "hash_comparison_deep": lambda spark, sf: m.comparison_rows(verify.results(spark, sf, "Deep"), fp.as_hex),
        "unprotected_files": lambda spark, sf: m.unprotected(verify.results(spark, sf, "Quick")).select(
            "relative_path", "file_length", "overall_status"
        ),
        "result_filter": result_filter,
        "dup_items_quick": dup_items_quick,
        "dup_top_k": dup_top_k,
        "dup_filter": dup_filter,
        "dup_group_texts": lambda spark, sf: dup.group_texts(verify.duplicates(spark, sf, "Full")[0]),
        "copy_plan": lambda spark, sf: verify.plan_copies(spark, sf).select(*PLAN_COLUMNS),
        "copy_plan_unprotected": lambda spark, sf: verify.plan_copies(spark, sf, True).select(*PLAN_COLUMNS),
        "copy_plan_distinct_roots": copy_plan_distinct_roots,
        "match_enabled": match_enabled,
        "inventory_totals_all": inventory_totals_all,
        "copy_sibling_lookup": copy_sibling_lookup,
        "copy_result_counts": lambda spark, sf: copying.copy_result_counts(verify.plan_copies(spark, sf)),
        "copy_failures_by_destination": lambda spark, sf: copying.copy_failures_by_destination(
            verify.plan_copies(spark, sf)
        ).select("dest_id", "failures"),
        "verify_copies": verify_copies,
        "capacity_check": lambda spark, sf: s.capacity_check(verify.results(spark, sf, "Full"), trees.DESTINATIONS),
        "protection": lambda spark, sf: s.protection(s.summarize(verify.results(spark, sf, "Full"), "Full")),
    }
    for mode in MODES:
        low = mode.lower()
        q[f"match_{low}"] = _match(mode)
        q[f"verify_summary_{low}"] = _summary(mode)
        q[f"dup_groups_{low}"] = _groups(mode)
        q[f"dup_totals_{low}"] = _totals(mode)
    return q | catalog_io.queries()

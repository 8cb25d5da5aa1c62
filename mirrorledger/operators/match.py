"""Match every source file against every destination.

Result: one row per source file with ``destinations``, an array with one verdict per enabled destination (in the given
order). :func:`verdicts` turns it into one row per (file, destination).

A destination's candidates are its files of the same byte length. Among those with equal fingerprints the reported one
is the first by: same path, same file name, inventory order. Instead of joining on length and ranking (quadratic for
files of one length), every destination file gets its place in inventory order as a number, once; per class (length, path,
name, content) and key the smallest number of each destination is kept, a hash aggregate of numbers. A source file looks
its keys up in one join that multiplies no rows. What is reported of the chosen files is attached last, by number.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import fold
from ..workspace import materialise
from .inventory import FINGERPRINTS, MODE_FINGERPRINTS, Destination, enabled, with_keys
from .skew import HOT_ROWS, lookup, suspects

RESULT_COLUMNS = ["relative_path", "full_path", "file_length", "category", *FINGERPRINTS]
ROW_ID = "row_id"
KEYS = ["kind", "file_length", "name", "prints"]


def numbered(rows: DataFrame) -> DataFrame:
    """Rows told apart by a number. It holds only for a table written with it."""
    return rows.withColumn(ROW_ID, F.monotonically_increasing_id())


def _keys(rows: DataFrame, mode: str, *carried: str) -> DataFrame:
    """One narrow row per row and class. Rows whose fingerprints are not known have no keys with content."""
    fps = MODE_FINGERPRINTS[mode]
    none, content = F.lit(""), F.concat_ws("/", *fps)
    classes = {"length": (none, none), "path": (F.col("path_key"), none)}
    if mode == "SuperFast":
        classes["equal_name"] = (F.col("name_key"), none)
    else:
        # The same path may exist in several spellings; the first with equal content counts.
        classes["equal_path"] = (F.col("path_key"), content)
        classes["equal_name"] = (F.col("name_key"), content)
        classes["equal_any"] = (none, content)
        content = F.when(F.expr(" AND ".join(f"{f} IS NOT NULL" for f in fps)), content)
        classes = {k: (name, none if c is none else content) for k, (name, c) in classes.items()}
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), n.alias("name"), c.alias("prints")) for k, (n, c) in classes.items()]
    )
    return rows.select(*carried, "file_length", F.inline(kinds)).where("name IS NOT NULL AND prints IS NOT NULL")


@dataclass(frozen=True)
class Candidates:
    """The files of the enabled destinations, prepared for one mode. Serves any number of source tables."""

    mode: str
    active: list[Destination]
    files: DataFrame
    best: DataFrame


def candidates(inventory: DataFrame, destinations: list[Destination], mode: str, *, keep: bool = False) -> Candidates:
    """``files``: each with its place in inventory order (path ignoring case, then path), written once. ``best``: per class
    and key the first file and the number of files of each destination; also written with ``keep``."""
    if mode not in K.MODES:
        raise ValueError(f"unknown mode: {mode}")
    active = enabled(destinations)
    rows = with_keys(inventory.where(F.col("root_id").isin([d.dest_id for d in active])))
    order = ["path_key", "relative_path", "full_path", *FINGERPRINTS, "error"]
    rows = rows.select("root_id", "file_length", "name_key", *order).orderBy(*order)
    files, _ = materialise(rows.withColumn("place", F.monotonically_increasing_id()), "candidates")
    figures = []
    for i, d in enumerate(active):
        here = f"root_id = {_quoted(d.dest_id)}"
        figures += [
            F.expr(f"min(CASE WHEN {here} THEN place END) AS first_{i}"),
            F.expr(f"min(CASE WHEN {here} AND unreadable THEN place END) AS unreadable_{i}"),
            F.expr(f"count_if({here}) AS files_{i}"),
        ]
    keyed = _keys(files.withColumn("unreadable", F.col("error").isNotNull()), mode, "root_id", "place", "unreadable")
    best = keyed.groupBy(*KEYS).agg(*figures or [F.count(F.lit(1)).alias("files")])
    if keep:
        best, _ = materialise(best, "best-candidates")
    return Candidates(mode, active, files.select("place", "full_path", *FINGERPRINTS, "error"), best)


def match(
    source: DataFrame,
    inventory: DataFrame | None,
    destinations: list[Destination],
    mode: str,
    *,
    source_rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    prepared: Candidates | None = None,
) -> DataFrame:
    """``source`` and ``inventory`` are fingerprinted for ``mode``; ``inventory.root_id`` names the destination.

    Pass written tables (``workspace.materialise``); a source with a ``row_id`` (:func:`numbered`) isn't written again.
    With ``prepared`` (:func:`candidates`) the inventory is not read.
    """
    found_in = prepared or candidates(inventory, destinations, mode)
    mode, active = found_in.mode, found_in.active
    if ROW_ID not in source.columns:
        source, source_rows = materialise(numbered(source.select(*RESULT_COLUMNS, "error")), "source")
    source_rows = source.count() if source_rows is None else source_rows
    source = source.select(ROW_ID, *RESULT_COLUMNS, "error")
    if not active:
        none = F.expr(f"CAST(array() AS array<{VERDICT_TYPE}>)").alias("destinations")
        return source.select(*RESULT_COLUMNS, F.lit(None).cast("string").alias("error"), none, F.lit("Missing").alias("overall_status"))
    left = with_keys(source)

    # A key belongs to one class, so none has more rows than the source. Hot ones are sought among hot lengths only.
    crowded = _keys(suspects(left, source_rows, hot_rows), mode) if source_rows > hot_rows else None
    found = lookup(
        _keys(left, mode, ROW_ID), found_in.best, KEYS, spread_by=F.col(ROW_ID), left_rows=source_rows, how="inner",
        hot_rows=hot_rows, hot_among=crowded,
    )
    chosen = _chosen(found, mode, len(active))
    if source_rows > hot_rows:
        chosen, _ = materialise(chosen, "chosen")
    reported = found_in.files.withColumnRenamed("error", "dest_error")
    attached = lookup(
        chosen, reported, ["place"], spread_by=F.col(ROW_ID), left_rows=source_rows, hot_rows=hot_rows
    )
    # At most one entry per destination.
    entry = F.struct("files", "is_equal", "is_same_path", "place", "full_path", *FINGERPRINTS, "dest_error")
    at = attached.groupBy(ROW_ID).agg(F.map_from_entries(F.collect_list(F.struct("dest_order", entry))).alias("at"))

    rows = source.join(at, ROW_ID, "left")
    # A source file is only read when some destination holds a file of its length.
    rows = rows.withColumn("error", F.expr("CASE WHEN at IS NOT NULL THEN error END"))
    rows = rows.select(
        *RESULT_COLUMNS, "error", *[F.col("at")[F.lit(i)].alias(f"at_{i}") for i in range(len(active))]
    )
    judged = ", ".join(_judge(mode, i, d) for i, d in enumerate(active))
    rows = rows.select(*RESULT_COLUMNS, "error", F.expr(f"array({judged})").cast(f"array<{VERDICT_TYPE}>").alias("destinations"))
    return rows.withColumn("overall_status", overall_status(F.col("destinations")))


VERDICT_TYPE = (
    "struct<dest_order:int,dest_id:string,root_path:string,status:string,matched_path:string,failure_reason:string,"
    "dest_head_fp:string,dest_tail_fp:string,dest_deep_fp:string,dest_full_fp:string>"
)


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _chosen(found: DataFrame, mode: str, n: int) -> DataFrame:
    """Per source row and destination with files of its length: how many, and the number of the file to report."""

    def of(kind: str, figure: str) -> str:
        return f"max(CASE WHEN kind = '{kind}' THEN {figure} END)"

    figures, entries = [], []
    for i in range(n):
        first, length = f"first_{i}", of("length", f"files_{i}")
        if mode == "SuperFast":
            only = f"CASE WHEN {length} = 1 THEN {of('length', first)} END"
            equal, other = f"coalesce({of('path', first)}, {of('equal_name', first)}, {only})", "CAST(NULL AS BIGINT)"
            unreadable = other
        else:
            equal = f"coalesce({', '.join(of(k, first) for k in ('equal_path', 'equal_name', 'equal_any'))})"
            other, unreadable = of("path", first), of("length", f"unreadable_{i}")
        figures += [
            F.expr(f"coalesce({length}, 0) AS files_{i}"), F.expr(f"{equal} AS equal_{i}"), F.expr(f"{other} AS path_{i}"),
            F.expr(f"{unreadable} AS unreadable_{i}"),
        ]
        entries.append(
            f"named_struct('dest_order', {i}, 'files', files_{i}, 'is_equal', equal_{i} IS NOT NULL, 'is_same_path', "
            f"path_{i} IS NOT NULL, 'place', coalesce(equal_{i}, path_{i}, unreadable_{i}))"
        )
    return found.groupBy(ROW_ID).agg(*figures).select(ROW_ID, F.expr(f"inline(array({', '.join(entries)}))")).where("files > 0")


def _judge(mode: str, i: int, destination: Destination) -> str:
    """SQL text of the verdict of destination ``i`` over ``at_<i>``, what was found there (null: no file of the length)."""
    none, at = "CAST(NULL AS STRING)", f"at_{i}"
    found, same = f"coalesce({at}.is_equal, false)", f"coalesce({at}.is_same_path, false)"
    shown = dict.fromkeys(FINGERPRINTS, none)
    if mode == "SuperFast":
        path = f"{at}.full_path"
        status = f"CASE WHEN {found} THEN 'Verified' ELSE 'Missing' END"
        reason = f"""CASE WHEN {found} THEN {none} WHEN {at} IS NULL THEN {_quoted(K.REASON_NO_SIZE)}
                     ELSE {_quoted(K.REASON_AMBIGUOUS)} END"""
    else:
        is_shown = f"error IS NULL AND ({found} OR {same})"
        path = f"CASE WHEN {is_shown} THEN {at}.full_path END"
        corrupt, missing = {
            "Quick": (K.REASON_QUICK_CORRUPT, K.REASON_QUICK_MISSING),
            "Deep": (K.REASON_DEEP_CORRUPT, K.REASON_DEEP_MISSING),
            "Full": (K.REASON_FULL_CORRUPT, K.REASON_FULL_MISSING),
        }[mode]
        # Full mode: alone and at the same path, the candidate is rejected as soon as its first chunk differs.
        early = f"{same} AND {at}.files = 1 AND {at}.head_fp <> head_fp" if mode == "Full" else "false"
        io_error = _quoted(K.REASON_IO_PREFIX)
        # Nothing equal and a candidate that could not be read: it may be the copy, so the file does not count as missing.
        status = f"""CASE WHEN error IS NOT NULL THEN 'Corrupt' WHEN {found} THEN 'Verified'
                     WHEN {same} OR {at}.dest_error IS NOT NULL THEN 'Corrupt' ELSE 'Missing' END"""
        reason = f"""CASE WHEN error IS NOT NULL THEN concat({io_error}, error) WHEN {found} THEN {none}
                     WHEN {at}.dest_error IS NOT NULL THEN concat({io_error}, {at}.dest_error)
                     WHEN {early} THEN {_quoted(K.REASON_FULL_EARLY)}
                     WHEN {same} THEN {_quoted(corrupt)} WHEN {at} IS NULL THEN {_quoted(K.REASON_NO_SIZE)}
                     ELSE {_quoted(missing)} END"""
        shown = {f: f"CASE WHEN {is_shown} THEN {at}.{f} END" for f in FINGERPRINTS}
        if mode == "Full":
            # Full content is only read behind equal edges, so a rejected candidate has no full fingerprint to show.
            edges = f"{at}.head_fp = head_fp AND {at}.tail_fp = tail_fp"
            shown["full_fp"] = f"CASE WHEN {is_shown} AND {edges} THEN {at}.full_fp END"
    fields = {
        "dest_order": str(i),
        "dest_id": _quoted(destination.dest_id),
        "root_path": _quoted(destination.root_path),
        "status": status,
        "matched_path": path,
        "failure_reason": reason,
        **{f"dest_{name}": value for name, value in shown.items()},
    }
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def overall_status(destinations: Column) -> Column:
    """Any Corrupt, else all Verified (and at least one destination), else any Verified, else Missing."""
    return status_fold(
        F.exists(destinations, lambda d: d["status"] == "Corrupt"),
        F.exists(destinations, lambda d: d["status"] == "Verified"),
        F.forall(destinations, lambda d: d["status"] == "Verified"),
        F.size(destinations),
    )


def status_fold(any_corrupt: Column, any_verified: Column, all_verified: Column, count: Column) -> Column:
    return (
        F.when(any_corrupt, "Corrupt")
        .when((count > 0) & all_verified, "Verified")
        .when(any_verified, "Partial")
        .otherwise("Missing")
    )


def fold_verdicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same fold over long rows (one per file and destination); a null status stands for no destination."""
    status = F.col("status")
    return rows.groupBy(*keys).agg(
        status_fold(
            F.coalesce(F.bool_or(status == "Corrupt"), F.lit(False)),
            F.coalesce(F.bool_or(status == "Verified"), F.lit(False)),
            F.coalesce(F.bool_and(status == "Verified"), F.lit(False)),
            F.count("status"),
        ).alias("overall_status")
    )


def verdicts(results: DataFrame) -> DataFrame:
    """One row per (file, destination)."""
    return results.select(
        *[c for c in results.columns if c != "destinations"], F.inline("destinations")
    )


def comparison_rows(results: DataFrame, hex_form) -> DataFrame:
    """Source and destination hashes side by side, one row per (file, destination, kind).

    Head and Tail always appear, Deep and Full when either side has one.
    """
    kinds = [("Head", "head_fp"), ("Tail", "tail_fp"), ("Deep", "deep_fp"), ("Full", "full_fp")]
    rows = verdicts(results)
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("kind_order"),
                F.lit(kind).alias("kind"),
                F.col(name).alias("source_fp"),
                F.col(f"dest_{name}").alias("dest_fp"),
            )
            for n, (kind, name) in enumerate(kinds)
        ]
    )
    rows = rows.select("relative_path", "dest_id", "status", F.inline(pairs))
    rows = rows.where((F.col("kind_order") < 2) | F.col("source_fp").isNotNull() | F.col("dest_fp").isNotNull())
    source, dest, missing = F.col("source_fp"), F.col("dest_fp"), F.col("status") == "Missing"
    return rows.select(
        "relative_path",
        "dest_id",
        "kind",
        F.when(source.isNotNull(), hex_form(source)).otherwise("None").alias("source_hash"),
        F.when(dest.isNotNull(), hex_form(dest)).when(missing, "Missing").otherwise("None").alias("dest_hash"),
        F.when(source.isNotNull() & dest.isNotNull(), F.when(source == dest, "MATCH").otherwise("MISMATCH"))
        .when(missing, "MISSING")
        .when(source.isNull() & dest.isNull(), "-")
        .otherwise("UNAVAILABLE")
        .alias("comparison"),
    )


def with_tab(results: DataFrame, tab: str = "All", search: str = "") -> DataFrame:
    """Results of one tab whose path contains the search text, ignoring case."""
    status = F.transform(F.col("destinations"), lambda d: d["status"])
    tabs = {
        "Verified": (F.size("destinations") > 0) & F.forall(status, lambda s: s == "Verified"),
        "Missing": F.forall(status, lambda s: s == "Missing"),
        "Corrupt": F.exists(status, lambda s: s == "Corrupt"),
    }
    rows = results.where(tabs[tab]) if tab in tabs else results
    text = search.strip()
    return rows.where(fold(F.col("relative_path")).contains(fold(F.lit(text)))) if text else rows


def unprotected(results: DataFrame) -> DataFrame:
    """Files that are not verified on every destination.

    Corruption never coexists with all destinations verified, so the folded status decides.
    """
    return results.where(F.col("overall_status") != "Verified")

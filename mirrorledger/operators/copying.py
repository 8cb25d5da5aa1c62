"""Planning and checking the copy of unprotected files.

The plan has one row per (file, destination) with an action:

=============  =====================================================================================
SKIP_PATH      the destination holds the file at its path (same length, head and tail)
SKIP_SIBLING   the path is taken by something else, but a numbered sibling ``stem_N.ext`` holds the file
WRITE          the path is free
WRITE_RENAMED  the path is taken; the copy goes to the first free ``stem_N.ext``
NO_SPACE       the destination is full and the file is not smaller than what is left
NO_NAME        no free numbered name up to 10000
UNAVAILABLE    the destination cannot be reached
=============  =====================================================================================

Files go in inventory order and see the names taken earlier in the batch. The plan is made for all files at once, as if
each got the name it asks for, and mended by deltas: only files that depend on a name that changed, taken or given up by a
file ahead of them, are planned again, until no name changes. The plan that reproduces itself is the sequential one, since
every decision depends only on files ahead of it. The first file of a delta stands behind the first of the one before, so
there are at most as many deltas as the longest chain of files of which each asks for a numbered name of the one before it
(plus, where a destination overflows, of files that take the space of one another).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.paths import directory, fold, numbered_sibling, sibling_number, sibling_of
from ..workspace import materialise
from .inventory import Destination
from .space import FINISH_ROWS, left_out

CONTENT = ["file_length", "head_fp", "tail_fp"]
WRITES = ["WRITE", "WRITE_RENAMED"]


def copy_targets(root_paths: list[str]) -> list[str]:
    """Roots to copy to: blanks dropped, distinct ignoring case, first spelling kept."""
    kept: dict[str, str] = {}
    for root in root_paths:
        if root and root.strip():
            kept.setdefault(root.upper(), root)
    return list(kept.values())


def one_per_root(destinations: list[Destination]) -> list[Destination]:
    """The enabled destinations to copy to, the first of each root."""
    active = [d for d in destinations if d.is_enabled]
    return [next(d for d in active if d.root_path == t) for t in copy_targets([d.root_path for d in active])]


def copy_plan(
    files: DataFrame,
    inventory: DataFrame,
    destinations: list[Destination],
    *,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """``files``: the unprotected source files with head and tail; ``inventory``: everything on the destinations."""
    active = [d for d in destinations if d.is_enabled]
    choices = F.array(
        *[F.struct(F.lit(d.dest_id).alias("dest_id"), F.lit(d.is_available).alias("is_available")) for d in active]
    )
    wanted = files.select("relative_path", "full_path", *CONTENT).withColumn("path_key", fold(F.col("relative_path")))
    wanted = wanted.select("*", F.inline(choices))

    held = inventory.where(F.col("root_id").isin([d.dest_id for d in active])).select(
        F.col("root_id").alias("dest_id"), "relative_path", *CONTENT
    )
    free = {d.dest_id: d.free_bytes for d in active}
    limited = any(b is not None for b in free.values())
    base, siblings, numbers = _with_occupants(wanted, held), _siblings(held), _held_numbers(held)

    decided, _ = materialise(_decide(base, siblings, None), "copy-decided")
    full = left_out(decided.where(F.col("action").isNull()), free, finish_rows=finish_rows)
    plan, _ = materialise(_name(_without_space(decided, full), numbers, None), "copy-plan")
    names = plan.where(F.col("target_path").isNotNull()).select("dest_id", F.col("target_path").alias("name"), _order().alias("by"))
    given_up = plan.where("action IN ('WRITE_RENAMED', 'NO_SPACE', 'NO_NAME')")
    moved = names.unionByName(given_up.select("dest_id", F.col("relative_path").alias("name"), _order().alias("by")))
    affected, n = materialise(_affected(decided, moved), "copy-affected")
    if n:
        (base, _), (siblings, _) = materialise(base, "copy-base"), materialise(siblings, "copy-siblings")
    redecided = replanned = None
    while n:
        keys = ["dest_id", "relative_path"]
        now, batch = _over(decided, redecided), _over(plan, replanned)
        fresh, _ = materialise(_decide(base.join(affected, keys, "left_semi"), siblings, _near(batch, affected)), "copy-decided")
        changed = fresh
        if limited:
            following = _over(now, fresh)
            full_now = left_out(following.where(F.col("action").isNull()), free, finish_rows=finish_rows)
            full_now, _ = materialise(full_now, "copy-full")
            flipped = full_now.exceptAll(full).unionByName(full.exceptAll(full_now)).join(fresh, keys, "left_anti")
            changed = fresh.unionByName(following.join(flipped, keys, "left_semi"))
            full = full_now
            changed, _ = materialise(changed, "copy-changed")
        renewed = _name(_without_space(changed, full), numbers, _near(batch, changed))
        renewed, _ = materialise(renewed, "copy-plan")
        moved = _moved(batch.join(changed, keys, "left_semi"), renewed)
        affected, n = materialise(_affected(_over(now, fresh), moved), "copy-affected")
        redecided = materialise(_over(redecided, fresh), "copy-decided")[0] if redecided else fresh
        replanned = materialise(_over(replanned, renewed), "copy-plan")[0] if replanned else renewed
    return _over(plan, replanned)


def _over(rows: DataFrame, newer: DataFrame | None) -> DataFrame:
    """``rows`` with those of ``newer`` in the place of theirs."""
    if newer is None:
        return rows
    keys = ["dest_id", "relative_path"]
    return rows.join(newer.select(*keys), keys, "left_anti").unionByName(newer)


def _without_space(rows: DataFrame, full: DataFrame) -> DataFrame:
    rows = rows.join(full.withColumn("full", F.lit(True)), ["dest_id", "relative_path"], "left")
    return rows.withColumn("action", F.when(F.col("full"), "NO_SPACE").otherwise(F.col("action"))).drop("full")


def _affected(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """The files behind a moved name that is theirs or a numbered one of theirs. ``moved``: ``dest_id, name, by``."""
    keys = ["dest_id", "relative_path"]
    rows = rows.where("action IS NULL OR action <> 'UNAVAILABLE'").select(
        *keys, _order().alias("position"), _sibling_key(F.col("relative_path")).alias("sibling_key")
    )
    asked = moved.groupBy("dest_id", F.col("name").alias("relative_path")).agg(F.min("by").alias("by"))
    above = sibling_of(F.col("name"))
    beside = moved.where(above.isNotNull()).groupBy("dest_id", _sibling_key(above).alias("sibling_key"))
    found = rows.join(asked, keys).unionByName(rows.join(beside.agg(F.min("by").alias("by")), ["dest_id", "sibling_key"]))
    return found.where(F.col("by") < F.col("position")).select(*keys, "sibling_key").distinct()


def _near(batch: DataFrame, rows: DataFrame) -> DataFrame:
    """The writes whose names decide about ``rows``; one may come twice, which changes no minimum and no set."""
    batch = batch.where(F.col("action").isin(WRITES))
    path = F.col("relative_path")
    at = rows.select("dest_id", path.alias("target_path"))
    beside = rows.select("dest_id", _sibling_key(path).alias("above")).distinct()
    above = batch.withColumn("above", _sibling_key(sibling_of(F.col("target_path")))).where("above IS NOT NULL")
    above = above.join(beside, ["dest_id", "above"], "left_semi").drop("above")
    return batch.join(at, ["dest_id", "target_path"], "left_semi").select(*batch.columns).unionByName(above.select(*batch.columns))


def _moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names that a file has taken or given up."""
    keys = ["dest_id", "relative_path"]
    old = before.select(*keys, F.col("target_path").alias("old"), F.col("action").alias("old_action"))
    both = after.join(old, keys).where("NOT (action <=> old_action AND target_path <=> old)")
    both = both.select("dest_id", _order().alias("by"), F.explode(F.array("old", "target_path")).alias("name"))
    return both.where("name IS NOT NULL").select("dest_id", "name", "by")


def content_candidates(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """The destination files whose content can decide a skip: those of the same length at a requested path or at one of
    its numbered names. Only these need head and tail for :func:`copy_plan`."""
    path = F.col("relative_path")
    wanted = files.select("relative_path", "file_length", _sibling_key(path).alias("sibling_key"))
    at_path = inventory.join(wanted, ["relative_path", "file_length"], "left_semi")
    beside = (
        inventory.withColumn("sibling_key", _sibling_key(sibling_of(path)))
        .where(sibling_of(path).isNotNull())
        .join(wanted, ["sibling_key", "file_length"], "left_semi")
    )
    columns = inventory.columns
    return at_path.select(*columns).unionByName(beside.select(*columns)).dropDuplicates(["root_id", "relative_path"])


def _with_occupants(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """What is at each requested path: a file (its content) or a folder."""
    files = held.select("dest_id", "relative_path", F.struct(*CONTENT).alias("occupant"))
    folders = (
        held.select("dest_id", directory(F.col("relative_path")).alias("relative_path"))
        .where("relative_path <> ''")
        .distinct()
        .select("dest_id", F.split("relative_path", "/").alias("parts"))
        .select("dest_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
        .select("dest_id", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/").alias("relative_path"))
        .distinct()
        .withColumn("is_folder", F.lit(True))
    )
    keys = ["dest_id", "relative_path"]
    return (
        wanted.join(files, keys, "left")
        .join(folders, keys, "left")
        .withColumn("occupied", F.col("occupant").isNotNull() | F.coalesce("is_folder", F.lit(False)))
        .drop("is_folder")
    )


def _sibling_key(path: Column) -> Column:
    """Folder exactly, name ignoring case."""
    return F.concat_ws("/", directory(path), fold(F.substring_index(path, "/", -1)))


def _siblings(held: DataFrame) -> DataFrame:
    return (
        held.withColumn("sibling_key", _sibling_key(sibling_of(F.col("relative_path"))))
        .where(sibling_of(F.col("relative_path")).isNotNull())
        .select("dest_id", "sibling_key", *CONTENT)
        .distinct()
        .withColumn("has_sibling", F.lit(True))
    )


def _held_numbers(held: DataFrame) -> DataFrame:
    """The numbers N whose ``stem_N.ext`` the destination already holds, by ``stem.ext``."""
    path = F.col("relative_path")
    numbered = held.select("dest_id", sibling_of(path).alias("relative_path"), sibling_number(path).alias("n"))
    return numbered.where("n IS NOT NULL AND relative_path IS NOT NULL")


def _order(*names: str) -> Column:
    return F.struct(*[F.col(n) for n in (names or ("path_key", "relative_path"))])


def _decide(base: DataFrame, siblings: DataFrame, batch: DataFrame | None) -> DataFrame:
    """Skips; an undecided action (null) means the file has to be written."""
    rows = base
    if batch is not None:
        # A renamed copy made earlier may sit on the requested path.
        landed = batch.where("action = 'WRITE_RENAMED'").select(
            "dest_id", F.col("target_path").alias("relative_path"), _order().alias("by"), F.struct(*CONTENT).alias("copy")
        )
        landed = landed.groupBy("dest_id", "relative_path").agg(F.min(F.struct("by", "copy")).alias("landed"))
        rows = rows.join(landed, ["dest_id", "relative_path"], "left")
        here = F.when(F.col("landed")["by"] < _order(), F.col("landed")["copy"])
        rows = (
            rows.withColumn("occupant", F.coalesce("occupant", F.when(~F.col("occupied"), here)))
            .withColumn("occupied", F.col("occupied") | here.isNotNull())
            .drop("landed")
        )
    rows = rows.withColumn("sibling_key", _sibling_key(F.col("relative_path")))
    keys = ["dest_id", "sibling_key", *CONTENT]
    rows = rows.join(siblings, keys, "left")
    has_sibling = F.coalesce("has_sibling", F.lit(False))
    if batch is not None:
        written = batch.where(F.col("action").isin(WRITES))
        written = (
            written.withColumn("sibling_key", _sibling_key(sibling_of(F.col("target_path"))))
            .where(sibling_of(F.col("target_path")).isNotNull())
            .groupBy(*keys)
            .agg(F.min(_order()).alias("written_by"))
        )
        rows = rows.join(written, keys, "left")
        has_sibling = has_sibling | F.coalesce(F.col("written_by") < _order(), F.lit(False))
    same = F.coalesce(F.col("occupant") == F.struct(*CONTENT), F.lit(False))
    action = (
        F.when(~F.col("is_available"), "UNAVAILABLE")
        .when(same, "SKIP_PATH")
        .when(F.col("occupied") & has_sibling, "SKIP_SIBLING")
    )
    return rows.select(
        "dest_id", "relative_path", "full_path", "path_key", *CONTENT, "occupied", action.alias("action")
    )


def _name(rows: DataFrame, held_numbers: DataFrame, batch: DataFrame | None) -> DataFrame:
    """Target paths: the smallest N from 1 whose name is free, when the requested path is not."""
    keys = ["dest_id", "relative_path"]
    taken = held_numbers.withColumn("by", F.lit(None).cast("struct<path_key:string,relative_path:string>"))
    # Names asked for by earlier files of the batch are taken as well (written there, or found taken).
    source = rows.where("action IS NULL") if batch is None else batch.where(F.col("action").isin(WRITES))
    target = F.col("relative_path") if batch is None else F.col("target_path")
    in_batch = source.select(
        "dest_id", sibling_of(target).alias("relative_path"), sibling_number(target).alias("n"), _order().alias("by")
    ).where("n IS NOT NULL AND relative_path IS NOT NULL")
    taken = taken.unionByName(in_batch)

    renamed = rows.where("action IS NULL AND occupied").select(*keys, _order().alias("position"))
    # At most 10000 distinct numbers per name, so the set is bounded. Distinct sorted numbers equal their rank exactly
    # on the unbroken run from 1.
    used = (
        renamed.join(taken, keys)
        .where(F.col("by").isNull() | (F.col("by") < F.col("position")))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set("n")).alias("numbers"))
        .select(*keys, F.size(F.filter("numbers", lambda n, i: n == i + 1)).alias("run"))
    )
    rows = rows.join(used, keys, "left")
    number = F.coalesce("run", F.lit(0)) + 1
    writes = F.col("action").isNull()
    action = (
        F.when(writes & ~F.col("occupied"), "WRITE")
        .when(writes & (number > K.MAX_COLLISION_SUFFIX), "NO_NAME")
        .when(writes, "WRITE_RENAMED")
        .otherwise(F.col("action"))
    )
    path = F.col("relative_path")
    return rows.withColumn("action", action).select(
        "dest_id",
        "relative_path",
        "full_path",
        "path_key",
        *CONTENT,
        "action",
        F.when(F.col("action") == "WRITE", path)
        .when(F.col("action") == "WRITE_RENAMED", numbered_sibling(path, number))
        .alias("target_path"),
        F.when(F.col("action") == "NO_SPACE", K.COPY_FULL_MESSAGE)
        .when(F.col("action") == "UNAVAILABLE", K.COPY_UNAVAILABLE_MESSAGE)
        .when(
            F.col("action") == "NO_NAME",
            F.format_string(K.COPY_NO_NAME_MESSAGE, path),
        )
        .alias("error"),
    )


def copy_result_counts(outcome: DataFrame) -> DataFrame:
    """Counts per source file: failed when any destination missed it, skipped when all held it, else copied."""
    failed = F.col("action").isin("NO_SPACE", "NO_NAME", "UNAVAILABLE") | F.col("error").isNotNull()
    files = outcome.groupBy("full_path").agg(
        F.bool_or(failed).alias("failed"),
        F.bool_or(F.col("action").isin(WRITES)).alias("written"),
        F.count(F.when((F.col("action") == "WRITE_RENAMED") & F.col("error").isNull(), 1)).alias("renamed"),
    )
    return files.agg(
        F.count(F.when(~F.col("failed") & F.col("written"), 1)).alias("copied_files"),
        F.count(F.when(~F.col("failed") & ~F.col("written"), 1)).alias("skipped_files"),
        F.count(F.when(F.col("failed"), 1)).alias("failed_files"),
        F.coalesce(F.sum("renamed"), F.lit(0)).alias("renamed_copies"),
    )


def copy_failures_by_destination(outcome: DataFrame) -> DataFrame:
    failed = outcome.where(F.col("error").isNotNull())
    return failed.groupBy(fold(F.col("dest_id")).alias("dest_key")).agg(
        F.min("dest_id").alias("dest_id"), F.count(F.lit(1)).alias("failures")
    )


def verify_copies(source: DataFrame, fresh: DataFrame, plan: DataFrame) -> DataFrame:
    """Each planned write against fresh fingerprints of its target: length, then head and tail.

    ``fresh`` is a fingerprinted inventory of the destinations (``root_id`` = destination).
    """
    written = plan.where(F.col("action").isin(WRITES)).select("dest_id", "relative_path", "target_path", *CONTENT)
    found = fresh.select(
        F.col("root_id").alias("dest_id"),
        F.col("relative_path").alias("target_path"),
        *[F.col(c).alias(f"found_{c}") for c in CONTENT],
    )
    same_length = F.col("file_length") == F.col("found_file_length")
    same_edges = (F.col("head_fp") == F.col("found_head_fp")) & (F.col("tail_fp") == F.col("found_tail_fp"))
    return written.join(found, ["dest_id", "target_path"], "left").select(
        "dest_id",
        "relative_path",
        "target_path",
        F.when(F.col("found_file_length").isNull(), "absent")
        .when(~same_length, "size differs")
        .when(F.coalesce(~same_edges, F.lit(True)), "checksum differs")
        .otherwise("verified")
        .alias("outcome"),
    )

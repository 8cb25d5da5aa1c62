"""Verification, duplicate audit and copying, end to end."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import ProbeTiers
from ..operators.copying import content_candidates, copy_plan, one_per_root
from ..operators.duplicates import STAGE_FINGERPRINTS, Audit, audit, duplicate_items, find_duplicates
from ..operators.inventory import FINGERPRINTS, MODE_FINGERPRINTS, Destination, enabled, shared_lengths
from ..operators.match import ROW_ID, match, numbered, unprotected
from ..operators.mounts import overlaps
from ..operators.skew import lookup
from ..sources import files, transfer
from ..sources.bucketed_store import BucketedStore
from ..sources.ranges import fingerprint_files
from ..workspace import io_tasks, materialise
from . import trees

FILES_A_TASK = 10_000  # that are read


def results(spark: SparkSession, sf_dir: str, mode: str, destinations: list[Destination] | None = None) -> DataFrame:
    """The card of ``trees`` verified against both backups."""
    source, backups, n = trees.both_sides(spark, sf_dir, mode)
    return match(source, backups, destinations or trees.DESTINATIONS, mode, source_rows=n)


def duplicates(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """Groups and items of the duplicate audit of both backups."""
    source, backups, _ = trees.both_sides(spark, sf_dir, STAGE_FINGERPRINTS[mode])
    found = audit(source, backups, trees.DESTINATIONS, mode)
    return tuple(f(None, None, trees.DESTINATIONS, mode, found=found) for f in (find_duplicates, duplicate_items))


def plan_copies(
    spark: SparkSession, sf_dir: str, only_unprotected: bool = False, destinations: list[Destination] | None = None
) -> DataFrame:
    """The copy plan of the card (all of it, or its unprotected files) onto both backups."""
    source, backups, n = trees.both_sides(spark, sf_dir, "Quick")
    files = source
    if only_unprotected:
        files = unprotected(match(source, backups, trees.DESTINATIONS, "Quick", source_rows=n))
    return copy_plan(files, backups, destinations or trees.DESTINATIONS)


def _flagged(rows: DataFrame, wanted: DataFrame, keys: list[str], n: int, flag: str) -> DataFrame:
    """``rows`` with whether their keys are among the ``wanted`` ones."""
    found = lookup(rows, wanted.withColumn(flag, F.lit(True)), keys, spread_by=F.col("full_path"), left_rows=n)
    return found.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _read(rows: DataFrame, wanted: list[str], flag: str, chunk: int, tiers: ProbeTiers, tasks: int) -> DataFrame:
    """Written rows with the ``wanted`` fingerprints of the flagged ones; an error of an earlier reading stays. ``tasks`` is
    found from the written inventory, since the flagged rows would have to be found once more to be counted."""
    before = F.col("earlier_error") if "error" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumnRenamed("error", "earlier_error")
    read = fingerprint_files(rows, wanted, chunk=chunk, tiers=tiers, where=F.col(flag), tasks=tasks)
    read = read.withColumn("error", F.coalesce("error", before)).drop("earlier_error", flag)
    return materialise(read, "fingerprints")[0]


def _tasks(rows: DataFrame, wanted: list[str], chunk: int) -> int:
    """Tasks for reading up to all written rows."""
    edges = F.least(F.col("file_length"), F.lit(2 * chunk))
    return io_tasks(rows, edges if {*wanted} <= {"head_fp", "tail_fp"} else F.col("file_length"), FILES_A_TASK)


def _from_store(rows: DataFrame, store: BucketedStore | None, flag: str) -> DataFrame:
    """Flagged rows with the fingerprints the store still vouches for, beside those they have."""
    if store is None:
        return rows
    own = [c for c in FINGERPRINTS if c in rows.columns]
    held = rows.withColumnsRenamed({c: f"own_{c}" for c in own})
    found = store.lookup(held).drop("is_hit")
    known = {c: F.when(F.col(flag), F.col(c)) for c in FINGERPRINTS}
    return found.withColumns({c: F.coalesce(f"own_{c}", known[c]) if c in own else known[c] for c in FINGERPRINTS}).drop(
        *(f"own_{c}" for c in own)
    )


def _to_store(rows: DataFrame, store: BucketedStore | None) -> None:
    """Writes back what was read; a run that read nothing writes nothing."""
    if store is not None:
        fresh = rows.where("bytes_read > 0 AND error IS NULL")
        if not fresh.isEmpty():
            store.upsert(fresh)


def verify_files(
    spark: SparkSession,
    inventory: DataFrame,
    mode: str,
    chunk: int,
    destinations: list[Destination] | None = None,
    tiers: ProbeTiers = ProbeTiers(),
    store: BucketedStore | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verify real files, reading as little as possible: ``inventory`` lists the card and the destinations.

    Returns the results and the inventory with what was read (``bytes_read`` of each file).

    Lengths first; bytes are read only of files whose length occurs on the other side. In Full mode the whole content is
    read only of files whose head and tail occur there too; a file without such a partner cannot match. With a ``store``,
    what it knows of unchanged files is not read again, and what was read is written back.
    """
    listed, n = materialise(numbered(inventory), "inventory")
    is_card = F.col("root_id") == "card"
    lengths = shared_lengths(listed.where(is_card), listed.where(~is_card))
    rows = _from_store(_flagged(listed, lengths, ["file_length"], n, "is_worth"), store, "is_worth")
    first = ["head_fp", "tail_fp"] if mode == "Full" else MODE_FINGERPRINTS[mode]
    known = _read(rows, first, "is_worth", chunk, tiers, _tasks(listed, first, chunk))
    if mode == "Full":
        keys = ["file_length", "head_fp", "tail_fp"]
        sides = [known.where(side).where("head_fp IS NOT NULL").select(*keys).distinct() for side in (is_card, ~is_card)]
        survivors = _flagged(known, sides[0].intersect(sides[1]), keys, n, "survives")
        known = _read(survivors, ["full_fp"], "survives", chunk, tiers, _tasks(listed, ["full_fp"], chunk))
    _to_store(known, store)
    results = match(known.where(is_card), known.where(~is_card), destinations or trees.DESTINATIONS, mode, source_rows=n)
    return results, known


def audit_files(
    spark: SparkSession,
    inventory: DataFrame,
    mode: str,
    chunk: int,
    destinations: list[Destination] | None = None,
    tiers: ProbeTiers = ProbeTiers(),
    store: BucketedStore | None = None,
) -> tuple[Audit, DataFrame]:
    """Duplicate audit of real files: each stage's surviving keys decide what the next one reads.

    Head and tail are read only of files of a (length, category) that the card has and at least two destination files share;
    the deep or full fingerprint only where head and tail do too. Fingerprints that ``inventory`` already has (from a
    verification) or the ``store`` knows are not read again. Returns the audit and the inventory with what was read.
    """
    destinations = destinations or trees.DESTINATIONS
    active = [d.dest_id for d in enabled(destinations)]
    rows, n = (inventory, inventory.count()) if ROW_ID in inventory.columns else materialise(numbered(inventory), "inventory")
    listed = rows
    is_card, on_backup = F.col("root_id") == "card", F.col("root_id").isin(active)

    def crowded(keys: list[str], held: DataFrame) -> DataFrame:
        """Keys of at least two destination files."""
        return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).where("files > 1").select(*keys)

    length, edges = ["file_length", "category"], ["file_length", "head_fp", "tail_fp"]
    wanted = STAGE_FINGERPRINTS[mode]
    if not wanted:
        rows = fingerprint_files(rows, [])  # no fingerprints, nothing read
    if wanted:
        shared = crowded(length, rows.where(on_backup)).intersect(rows.where(is_card).select(*length).distinct())
        rows = _flagged(rows, shared, length, n, "is_worth")
        rows = rows.withColumn("is_worth", F.col("is_worth") & (is_card | on_backup))
        rows = _read(_from_store(rows, store, "is_worth"), wanted[:2], "is_worth", chunk, tiers, _tasks(listed, wanted[:2], chunk))
    if len(wanted) > 2:
        known = rows.where(is_card).where("head_fp IS NOT NULL").select("category", *edges).distinct()
        held = rows.where(on_backup).where("head_fp IS NOT NULL")
        held = lookup(held, known, ["category", *edges], spread_by=F.col("full_path"), left_rows=n, how="left_semi")
        rows = _flagged(rows, crowded(edges, held), edges, n, "survives")
        rows = rows.withColumn("survives", F.col("survives") & (is_card | on_backup))
        rows = _read(_from_store(rows, store, "survives"), wanted[2:], "survives", chunk, tiers, _tasks(listed, wanted[2:], chunk))
    if wanted:
        _to_store(rows, store)
    return audit(rows.where(is_card), rows.where(~is_card), destinations, mode), rows


def verify_and_audit(
    spark: SparkSession, inventory: DataFrame, mode: str, chunk: int, destinations: list[Destination] | None = None,
    tiers: ProbeTiers = ProbeTiers(), store: BucketedStore | None = None,
) -> tuple[DataFrame, Audit, DataFrame]:
    """A verification with the duplicate audit attached, which reads only what the verification has not: (results, audit,
    inventory)."""
    results, known = verify_files(spark, inventory, mode, chunk, destinations, tiers, store)
    found, known = audit_files(spark, known, mode, chunk, destinations, tiers, store)
    return results, found, known


def copy_missing(
    spark: SparkSession, roots: dict[str, str], destinations: list[Destination], chunk: int, store: BucketedStore | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verify the card, plan the copies of unprotected files and carry them out: (results, plan, outcome).

    Disabled destinations take no part. Each root is copied to once, whatever its spelling. A root equal to the card or inside it is refused.
    """
    destinations = one_per_root(destinations)
    pairs = spark.createDataFrame(
        [(roots["card"], d.root_path) for d in destinations], "source_path string, destination_path string"
    )
    refused = overlaps(pairs).where("NOT is_valid").first()
    if refused:
        raise ValueError(f"{refused['destination_path']}: {refused['validation_error']}")
    results, everything = verify_files(spark, files.scan(spark, roots), "Quick", chunk, destinations, store=store)
    results, _ = materialise(results, "results")
    missing = unprotected(results).select("relative_path")
    is_card = F.col("root_id") == "card"
    todo = everything.where(is_card).join(missing, "relative_path", "left_semi").withColumn("bytes_read", F.lit(0).cast("bigint"))
    todo, _ = materialise(_from_store(todo.withColumn("is_todo", F.lit(True)), store, "is_todo").drop("is_todo"), "todo")
    # Written, because the plan reads them several times and files must not be read again.
    source, _ = materialise(fingerprint_files(todo, "Quick", chunk=chunk), "source")
    # Verification read most of what is needed; the rest is read only where content can decide.
    held = everything.where(~is_card)
    candidates, _ = materialise(content_candidates(todo, held), "candidates")
    candidates = _from_store(candidates.withColumns({"bytes_read": F.lit(0).cast("bigint"), "is_near": F.lit(True)}), store, "is_near")
    compared, _ = materialise(fingerprint_files(candidates.drop("is_near"), "Quick", chunk=chunk), "compared")
    columns = ["full_path", "file_length", "mtime", *FINGERPRINTS, "error", "bytes_read"]
    _to_store(source.select(*columns).unionByName(compared.select(*columns)), store)
    rest = held.join(compared.select("root_id", "relative_path"), ["root_id", "relative_path"], "left_anti")
    held = compared.select(*held.columns).unionByName(rest.select(*held.columns))
    plan = copy_plan(source, held, destinations)
    outcome = transfer.execute_plan(plan, {d.dest_id: d.root_path for d in destinations}, chunk=chunk)
    return results, plan, outcome

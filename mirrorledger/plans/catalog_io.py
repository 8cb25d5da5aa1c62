"""Registered queries for sources, sinks, the store, streams and single functions."""

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import fingerprints as fp
from ..functions import paths, text
from ..functions.constants import PRESETS
from ..functions.media import category_label, in_preset
from ..operators import copying
from ..operators import duplicates as dup
from ..operators import inventory as inv
from ..operators import match as m
from ..operators import mounts
from ..operators import summary as s
from ..operators.duplicates import duplicate_totals
from ..sources import bucketed_store, exif, files, ranges, reports, store
from ..streaming import ingest, throughput
from ..workspace import materialise, new_path, posix_folder
from . import media, trees, verify

Query = Callable[[SparkSession, str], DataFrame]


# --- inventories of real files ---


def _tree(spark, sf, *roots: str) -> dict[str, str]:
    """The trees written as real files below a new shared folder; returns their root paths."""
    base = posix_folder(spark, "tree")
    paths_of = {root: f"{base}/{root}" for root in roots}
    # Tasks that write into one folder wait for each other, so the roots are written side by side, each by its share of cores.
    tasks = max(1, spark.sparkContext.defaultParallelism // len(roots))

    def write(root: str) -> None:
        rows = getattr(trees, root)(spark, sf, root_path=paths_of[root]).coalesce(tasks)
        written, _ = materialise(files.write_tree(rows), "written")
        failed = written.where("error IS NOT NULL").first()
        if failed:
            raise OSError(f"{failed['full_path']}: {failed['error']}")

    with ThreadPoolExecutor(len(roots)) as pool:
        list(pool.map(inheritable_thread_target(spark)(write), roots))
    return paths_of


def inventory_files(spark, sf):
    """Two roots written as real files and listed again."""
    rows = files.scan(spark, _tree(spark, sf, "card", "nas"))
    return rows.select("root_id", "relative_path", "file_length", "category")


def inventory_data_source(spark, sf):
    root = _tree(spark, sf, "card")["card"]
    rows = files.read_inventory(spark, "card", root, "All Camera Media (with Sidecars)")
    return rows.select("relative_path", "file_length", "category")


def fingerprint_files(spark, sf):
    """Every fingerprint read from real files by byte ranges."""
    rows = files.scan(spark, _tree(spark, sf, "card"))
    known = ranges.fingerprint_files(rows, inv.FINGERPRINTS, chunk=trees.CHUNK, tiers=trees.TIERS)
    return known.select("relative_path", "file_length", *inv.FINGERPRINTS, "error")


def staged_full_match(spark, sf):
    """Full verification of real files: lengths, then head and tail, then full content of what is left."""
    rows, _ = verify.verify_files(spark, files.scan(spark, _tree(spark, sf, "card", "ssd", "nas")), "Full", trees.CHUNK, tiers=trees.TIERS)
    return m.verdicts(rows).select("relative_path", "dest_id", "status", F.coalesce("failure_reason", F.lit("")).alias("reason"))


def verify_files_cached(spark, sf):
    """Full verification of real files twice with one store: the second run's verdicts, and what it read."""
    inventory, _ = materialise(files.scan(spark, _tree(spark, sf, "card", "ssd", "nas")), "listed")
    known = bucketed_store.BucketedStore(spark, new_path(spark, "store"), buckets=8, fold_after=1)
    for _ in range(2):
        rows, read = verify.verify_files(spark, inventory, "Full", trees.CHUNK, tiers=trees.TIERS, store=known)
    of_card = read.where("root_id = 'card'").select("relative_path", "bytes_read")
    found = m.verdicts(rows).select("relative_path", "dest_id", "status", F.coalesce("failure_reason", F.lit("")).alias("reason"))
    return found.join(of_card, "relative_path")


def dup_files_staged(spark, sf):
    """Full duplicate audit of real files, each stage reading what the one before left."""
    inventory = files.scan(spark, _tree(spark, sf, "card", "ssd", "nas"))
    found, _ = verify.audit_files(spark, inventory, "Full", trees.CHUNK, tiers=trees.TIERS)
    return dup.find_duplicates(None, None, trees.DESTINATIONS, "Full", found=found).drop("first_path", "content")


def verify_files_audited(spark, sf):
    """A verification with the duplicate audit attached: counts by status and the audit's totals."""
    inventory = files.scan(spark, _tree(spark, sf, "card", "ssd", "nas"))
    rows, found, _ = verify.verify_and_audit(spark, inventory, "Quick", trees.CHUNK, tiers=trees.TIERS)
    groups = dup.find_duplicates(None, None, trees.DESTINATIONS, "Quick", found=found)
    statuses = rows.groupBy(F.col("overall_status").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    totals = duplicate_totals(groups)
    return statuses.unionByName(totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("bigint").alias("n")) for c in totals.columns]))))


def copy_execute(spark, sf):
    """Copy what the backups lack, list everything again and verify once more."""
    roots = _tree(spark, sf, "card", "ssd", "nas")
    destinations = [inv.Destination(d, d, roots[d]) for d in ("ssd", "nas")]
    before, plan, outcome = verify.copy_missing(spark, roots, destinations, trees.CHUNK)
    after, _ = verify.verify_files(spark, files.scan(spark, roots), "Quick", trees.CHUNK, destinations)
    counts = copying.copy_result_counts(outcome)
    statuses = after.groupBy("overall_status").agg(F.count(F.lit(1)).alias("files"))
    names = ["copied_files", "skipped_files", "failed_files", "renamed_copies"]
    counted = counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("files")) for n in names])))
    return counted.unionByName(statuses.select(F.concat(F.lit("after: "), "overall_status").alias("item"), "files"))


def copy_check(spark, sf):
    """Each executed copy against fresh fingerprints of its target."""
    roots = _tree(spark, sf, "card", "nas")
    _, plan, outcome = verify.copy_missing(spark, roots, [inv.Destination("nas", "nas", roots["nas"])], trees.CHUNK)
    fresh = ranges.fingerprint_files(files.scan(spark, {"nas": roots["nas"]}), "Quick", chunk=trees.CHUNK)
    done = plan.drop("target_path", "action").join(
        outcome.select("dest_id", "relative_path", "action", "target_path"), ["dest_id", "relative_path"]
    )
    return copying.verify_copies(plan, fresh, done).select("relative_path", "target_path", "outcome")


# --- predicates and scalars ---


def preset_filter(spark, sf):
    rows = trees.card(spark, sf)
    by_preset = F.array(
        *[
            F.when(in_preset(paths.extension(F.col("relative_path")), name), F.lit(name))
            for name in PRESETS
        ]
    )
    return (
        rows.select("category", "file_length", F.explode(F.array_compact(by_preset)).alias("preset"))
        .groupBy("preset", "category")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("file_length").alias("bytes"))
    )


def ignored_dirs(spark, sf):
    """Documents filed under folders of all kinds; what is left after pruning."""
    rows = trees.table(spark, sf, "documents").selectExpr(
        "doc_id",
        """concat(CASE source WHEN 'src0' THEN '.git/' WHEN 'src1' THEN 'a/.Trash-1000/' WHEN 'src2' THEN 'x.lrdata/y/'
             WHEN 'src3' THEN 'Node_Modules/' WHEN 'src4' THEN '$RECYCLE.BIN/' WHEN 'src5' THEN 'b/c.PhotosLibrary/'
             WHEN 'src6' THEN 'Lightroom Catalogs/' WHEN 'src7' THEN 'DCIM/100EOS/' WHEN 'src8' THEN '.hidden/'
             WHEN 'src9' THEN 'd/@eaDir/' WHEN 'src10' THEN ' /' ELSE '' END,
           doc_id, CASE lang WHEN 'en' THEN '.JPG' WHEN 'fr' THEN '' WHEN 'de' THEN '.Mov' ELSE '.txt' END)
           AS relative_path""",
    )
    return inv.admitted(rows, "Photos and Videos").select("relative_path")


def path_parts(spark, sf):
    path = F.col("relative_path")
    return trees.backups(spark, sf).select(
        "root_id",
        "relative_path",
        paths.file_name(path).alias("name"),
        paths.directory(path).alias("folder"),
        paths.stem(path).alias("stem"),
        text.extension_label(path).alias("extension"),
        F.coalesce(paths.sibling_of(path), F.lit("")).alias("sibling_of"),
        paths.relative_path(F.concat(F.lit("C:\\card\\"), F.translate(path, "/", "\\")), F.lit("C:\\card\\")).alias("relative"),
        category_label(F.col("category")).alias("category_label"),
    )


def byte_size_text(spark, sf):
    """All size texts over document lengths and over order totals read as sizes up to terabytes."""
    sizes = trees.table(spark, sf, "documents").selectExpr("octet_length(text) AS size").unionByName(
        trees.table(spark, sf, "orders").selectExpr("CAST(o_totalprice * o_totalprice * 1000 AS BIGINT) - 5000 AS size"),
    )
    size = F.col("size").cast("bigint")
    return sizes.select(
        size.alias("size"),
        text.byte_size(size).alias("general"),
        text.report_size(size).alias("report"),
        text.capacity_size(size).alias("capacity"),
        text.item_size(size).alias("item"),
        text.certificate_size(size).alias("certificate"),
    )


def hash_text(spark, sf):
    """Hashes written as hex or number are read back; anything else is rejected."""
    rows = trees.table(spark, sf, "documents").selectExpr(
        "doc_id",
        """CASE lang WHEN 'en' THEN concat('0x', upper(substr(md5(text), 1, 16)))
             WHEN 'fr' THEN concat('0X', substr(md5(text), 1, 7)) WHEN 'de' THEN CAST(n_chars * 1000003 AS STRING)
             ELSE substr(md5(text), 1, 16) END AS given""",
    )
    parsed = fp.parse_hex(F.col("given"))
    return rows.select("doc_id", "given", F.coalesce(parsed, F.lit("rejected")).alias("parsed"))


def csv_text(spark, sf):
    return trees.table(spark, sf, "documents").select(
        "doc_id",
        text.csv_field(F.col("text")).alias("field"),
        text.csv_field(F.concat(F.expr("CASE lang WHEN 'en' THEN '=' WHEN 'fr' THEN '@' ELSE '' END"), "source")).alias("guarded"),
    )


def html_text(spark, sf):
    return trees.table(spark, sf, "pages").select("page_id", text.html(F.col("html")).alias("escaped"))


def path_overlap(spark, sf):
    rows = trees.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "concat('/Volume/', source, CASE lang WHEN 'fr' THEN '/' ELSE '' END) AS source_path",
        """CASE lang WHEN 'fr' THEN concat('/volume/', source) WHEN 'de' THEN concat('/volume/', source, '/backup')
             WHEN 'es' THEN '/volume' ELSE concat('/volume/', source, 'x') END AS destination_path""",
    )
    return mounts.overlaps(rows)


def _mounts(spark, sf):
    suppliers = trees.table(spark, sf, "supplier").selectExpr(
        "s_nationkey AS n",
        "CASE WHEN s_nationkey < 12 THEN '' ELSE concat('CARD', s_nationkey) END AS label",
        "s_nationkey < 20 AS is_removable",
    ).distinct()
    # Every mount is in both snapshots; some are elsewhere in one of them.
    before = suppliers.withColumn("path", F.expr("concat('/mnt/ssd/', if(n % 5 = 0, 'Earlier', 'Archive'), '/src', n)"))
    after = suppliers.withColumn("path", F.expr("concat('/mnt/ssd/', if(n % 7 = 1, 'Later', 'Archive'), '/src', n)"))
    return mounts.mount_events(before, after)


def mount_affected(spark, sf):
    rows = trees.ssd(spark, sf).select("relative_path", "full_path")
    return mounts.affected(rows, _mounts(spark, sf)).select("relative_path")


# --- reports ---


def report_csv_roundtrip(spark, sf):
    """The CSV sink written and read back."""
    path = new_path(spark, "report")
    groups, items = verify.duplicates(spark, sf, "Quick")
    reports.write_csv(verify.results(spark, sf, "Quick"), trees.DESTINATIONS, path, items)
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{path}/files")
    return back.select("RelativePath", "OverallStatus", "HeadHash", "DestinationStatuses", "nas")


def report_order(spark, sf):
    """Where each file stands in the written CSV report: parts in order of their names, lines as they follow."""
    path = new_path(spark, "report")
    reports.write_csv(verify.results(spark, sf, "SuperFast"), trees.DESTINATIONS, path)
    lines = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{path}/files").select(
        "RelativePath", F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("line")
    )
    lines, _ = materialise(lines, "lines")
    parts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("line"))
    rows = lines.withColumn("inside", inside).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    return rows.select((F.col("before") + F.col("inside")).alias("position"), "RelativePath")


def report_duplicate_rows(spark, sf):
    return reports.duplicate_csv_rows(verify.duplicates(spark, sf, "Full")[1])


def report_json(spark, sf):
    return reports.json_rows(verify.results(spark, sf, "Quick"))


def report_json_summary(spark, sf):
    return reports.json_summary(s.summarize(verify.results(spark, sf, "Quick"), "Quick", trees.CARD_ROOT))


def report_json_audit(spark, sf):
    """The summary with time, duration and the attached audit's totals."""
    summary = s.summarize(verify.results(spark, sf, "Quick"), "Quick", trees.CARD_ROOT)
    totals = duplicate_totals(verify.duplicates(spark, sf, "Quick")[0])
    return reports.json_summary(summary, "2024-01-01T00:00:00Z", "00:00:05", totals)


def report_json_duplicates(spark, sf):
    return reports.json_duplicates(verify.duplicates(spark, sf, "Full")[1])


def report_html_order(spark, sf):
    """Where each file's line stands among the file lines of the written page."""
    path = new_path(spark, "report")
    results, _ = materialise(verify.results(spark, sf, "Full"), "results")
    reports.write_html(s.summarize(results, "Full", trees.CARD_ROOT), s.status_by_destination(results), results, path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("part"), F.monotonically_increasing_id().alias("line"))
    lines, _ = materialise(lines.where("value LIKE '<tr>%<samp>%'"), "lines")
    parts = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("line"))
    rows = lines.withColumn("inside", inside).join(F.broadcast(parts.select("part", before.alias("before"))), "part")
    return rows.select((F.col("before") + F.col("inside")).alias("position"), F.col("value").alias("line"))


def report_html_page(spark, sf):
    """The whole page written as ordered text and read back as lines."""
    path = new_path(spark, "report")
    results, _ = materialise(verify.results(spark, sf, "Quick"), "results")
    groups, items = verify.duplicates(spark, sf, "Quick")
    reports.write_html(
        s.summarize(results, "Quick", trees.CARD_ROOT), s.status_by_destination(results), results, path,
        totals=duplicate_totals(groups), items=items, timestamp="2024-01-01 00:00:00",
    )
    lines = spark.read.text(path)
    kind = F.when(F.col("value").startswith("<tr>"), "row").when(F.col("value").startswith("<li>"), "location").otherwise("frame")
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))


def report_best_checksum(spark, sf):
    rows = verify.results(spark, sf, "Deep")
    best = text.best_checksum(F.col("full_fp"), F.col("deep_fp"), F.col("head_fp"), fp.as_hex)
    return rows.select("relative_path", best.alias("checksum"))


# --- store ---


def _dated_card(spark, sf) -> DataFrame:
    """The card, with a time also for the rows whose table has none."""
    return trees.card(spark, sf).withColumn("mtime", F.coalesce("mtime", F.expr("TIMESTAMP '2024-01-01 00:00:00'")))


def _stored(spark, sf) -> DataFrame:
    """What an earlier run left: head and tail of all files, some since modified."""
    rows = inv.fingerprint_content(_dated_card(spark, sf), "Quick", chunk=trees.CHUNK)
    shift = F.expr(
        """CASE category WHEN 'PhotoRaw' THEN INTERVAL '1.8' SECOND WHEN 'Video' THEN INTERVAL '3.5' SECOND
             WHEN 'Sidecar' THEN INTERVAL '-0.5' SECOND ELSE INTERVAL '0' SECOND END"""
    )
    return rows.withColumn("mtime", F.col("mtime") + shift)


def _store(spark, sf) -> store.FingerprintStore:
    kept = store.FingerprintStore(spark, new_path(spark, "store"))
    kept.clear()
    kept.upsert(_stored(spark, sf), 0)
    return kept


def cache_hits(spark, sf):
    found = _store(spark, sf).lookup(trees.card(spark, sf).drop("content"))
    return found.select("relative_path", "is_hit", F.coalesce("head_fp", F.lit("")).alias("head_fp"))


def cache_upsert(spark, sf):
    """A second run adds full fingerprints; those of files unchanged since keep head and tail."""
    kept = _store(spark, sf)
    later = inv.fingerprint_content(_dated_card(spark, sf), "Full", chunk=trees.CHUNK)
    none = F.lit(None).cast("string")
    kept.upsert(later.withColumn("head_fp", none).withColumn("tail_fp", none), 1)
    return kept.current().select("full_path", "file_length", *[F.coalesce(c, F.lit("")).alias(c) for c in inv.FINGERPRINTS])


def cache_merge(spark, sf):
    """The same upsert as one join of two snapshots."""
    later = inv.fingerprint_content(_dated_card(spark, sf), "Full", chunk=trees.CHUNK)
    none = F.lit(None).cast("string")
    rows = store.merged(_stored(spark, sf), later.withColumn("head_fp", none).withColumn("tail_fp", none))
    return rows.select("full_path", "file_length", *[F.coalesce(c, F.lit("")).alias(c) for c in inv.FINGERPRINTS])


def cache_get(spark, sf):
    """One stored file by path, length and time: the first standard photo."""
    photos = _dated_card(spark, sf).where("category = 'PhotoStandard'")
    first = photos.agg(F.min(F.struct("full_path", "file_length", "mtime")).alias("f")).first()["f"]
    found = _store(spark, sf).get(*first) if first else photos.withColumn("head_fp", F.lit(""))
    return found.select("full_path", "file_length", "head_fp")


def cache_by_length(spark, sf):
    return _store(spark, sf).by_length(897).select("full_path", "file_length", "head_fp")


def cache_by_length_sorted(spark, sf):
    """The same lookup in the bucketed store: a folded base sorted by length, and one later write."""
    known = bucketed_store.BucketedStore(spark, new_path(spark, "store"), buckets=8, fold_after=2)
    rows = _stored(spark, sf)
    known.upsert(rows.where("file_length % 3 = 0"), 1)
    known.upsert(rows.where("file_length % 3 <> 0"), 2)
    known.upsert(rows.where("file_length < 1000"), 3)
    return known.by_length(897).select("full_path", "file_length", "head_fp")


def cache_compact_clear(spark, sf):
    kept = _store(spark, sf)
    kept.upsert(_stored(spark, sf), 1)
    compacted = kept.compact(new_path(spark, "store"))
    versions, rows = kept.versions().count(), compacted.versions().count()
    kept.clear()
    counts = kept.versions().agg(F.count(F.lit(1)).alias("after_clear"))
    return counts.select(F.lit(versions).alias("versions"), F.lit(rows).alias("compacted"), "after_clear")


# --- metadata ---


def exif_metadata(spark, sf):
    rows = exif.from_content(media.camera_files(spark, sf))
    return rows.select(
        "doc_id", "has_exif", "camera_make", "camera_model", "lens_model", "date_time", "dimensions", "iso", "exposure",
        "f_number", "focal_length", "camera", "exposure_summary", F.col("captured_at").cast("string").alias("captured_at"),
    )


def exif_thumbnail(spark, sf):
    rows = exif.from_content(media.camera_files(spark, sf))
    return rows.select("doc_id", F.octet_length("thumbnail").alias("bytes"), F.md5("thumbnail").alias("thumbnail_md5"))


def exif_catalogue(spark, sf):
    return exif.catalogue(exif.from_content(media.camera_files(spark, sf)), "camera")


def exif_by_category(spark, sf):
    return exif.catalogue(media.camera_files(spark, sf), "category")


# --- streams ---


def _read_events(spark, sf, stream: bool) -> DataFrame:
    return trees.table(spark, sf, "events", stream).selectExpr(
        "CAST(ts AS TIMESTAMP) AS ts", "event_type AS device", "CAST(round(value * 1048576) AS BIGINT) AS bytes"
    )


def throughput_stream(spark, sf):
    """The windows a stream closes; those still open at the end of the input are not written."""
    windows = throughput.sliding_throughput(_read_events(spark, sf, True))
    path = new_path(spark, "throughput")
    throughput.write_windows(windows, path, new_path(spark, "checkpoint")).awaitTermination()
    rows = spark.read.schema(windows.schema).parquet(path)
    return rows.select(F.col("window_end").cast("string").alias("window_end"), "device", "bytes", "bytes_per_second")


def throughput_stream_complete(spark, sf):
    """All windows of a stream: those it has closed and those still open at the end of its input."""
    windows = throughput.sliding_throughput(_read_events(spark, sf, True))
    path, checkpoint = new_path(spark, "throughput"), new_path(spark, "checkpoint")
    throughput.write_windows(windows, path, checkpoint).awaitTermination()
    closed = spark.read.schema(windows.schema).parquet(path)
    return _shown_windows(closed.unionByName(throughput.open_windows(spark, checkpoint)))


def throughput_sliding(spark, sf):
    return _shown_windows(throughput.sliding_throughput(_read_events(spark, sf, False)))


def _shown_windows(windows: DataFrame) -> DataFrame:
    return windows.select(
        F.col("window_start").cast("string").alias("window_start"), "device", "bytes", "bytes_per_second", "mb_per_second"
    )


def throughput_total(spark, sf):
    total = throughput.total_throughput(throughput.sliding_throughput(_read_events(spark, sf, False)))
    return total.select(F.col("window_start").cast("string").alias("window_start"), "bytes", "bytes_per_second")


def stream_ingest(spark, sf):
    """The card's manifest streamed into the store."""
    kept = store.FingerprintStore(spark, new_path(spark, "store"))
    kept.clear()
    prints = inv.fingerprint_content(trees.card(spark, sf, stream=True), "Quick", chunk=trees.CHUNK)
    ingest.ingest(prints, kept, new_path(spark, "checkpoint")).awaitTermination()
    return kept.current().select("full_path", "file_length", "head_fp", "tail_fp")


def stream_verify(spark, sf):
    """The card streamed against the backups; one verdict per file and destination."""
    backups, _ = trees.fingerprinted(trees.backups(spark, sf), "Quick", "backups")
    prints = inv.fingerprint_content(trees.card(spark, sf, stream=True), "Quick", chunk=trees.CHUNK)
    path = new_path(spark, "verdicts")
    ingest.verify_stream(
        prints, backups, trees.DESTINATIONS, "Quick", path, new_path(spark, "checkpoint")
    ).awaitTermination()
    return m.verdicts(spark.read.parquet(path)).select("relative_path", "dest_id", "status", "matched_path")


def queries() -> dict[str, Query]:
    return {
        "inventory_files": inventory_files,
        "inventory_data_source": inventory_data_source,
        "fingerprint_files": fingerprint_files,
        "staged_full_match": staged_full_match,
        "verify_files_cached": verify_files_cached,
        "dup_files_staged": dup_files_staged,
        "verify_files_audited": verify_files_audited,
        "copy_execute": copy_execute,
        "copy_check": copy_check,
        "preset_filter": preset_filter,
        "ignored_dirs": ignored_dirs,
        "path_parts": path_parts,
        "byte_size_text": byte_size_text,
        "hash_text": hash_text,
        "csv_text": csv_text,
        "html_text": html_text,
        "path_overlap": path_overlap,
        "mount_diff": _mounts,
        "mount_affected": mount_affected,
        "report_csv_rows": lambda spark, sf: reports.csv_rows(verify.results(spark, sf, "Quick"), trees.DESTINATIONS),
        "report_csv_lines": lambda spark, sf: reports.csv_lines(verify.results(spark, sf, "Full"), trees.DESTINATIONS),
        "report_csv_roundtrip": report_csv_roundtrip,
        "report_order": report_order,
        "report_duplicate_rows": report_duplicate_rows,
        "report_json_rows": report_json,
        "report_json_summary": report_json_summary,
        "report_json_audit": report_json_audit,
        "report_json_duplicates": report_json_duplicates,
        "report_html_order": report_html_order,
        "report_html_rows": lambda spark, sf: reports.html_rows(verify.results(spark, sf, "Full")),
        "report_html_page": report_html_page,
        "report_best_checksum": report_best_checksum,
        "cache_hits": cache_hits,
        "cache_upsert": cache_upsert,
        "cache_merge": cache_merge,
        "cache_get": cache_get,
        "cache_by_length": cache_by_length,
        "cache_by_length_sorted": cache_by_length_sorted,
        "cache_compact_clear": cache_compact_clear,
        "exif_metadata": exif_metadata,
        "exif_thumbnail": exif_thumbnail,
        "exif_catalogue": exif_catalogue,
        "exif_by_category": exif_by_category,
        "throughput_sliding": throughput_sliding,
        "throughput_total": throughput_total,
        "throughput_stream": throughput_stream,
        "throughput_stream_complete": throughput_stream_complete,
        "stream_ingest": stream_ingest,
        "stream_verify": stream_verify,
    }

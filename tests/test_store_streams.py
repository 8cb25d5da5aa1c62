from datetime import datetime, timedelta

from helpers import all_prints, payload, split
from pyspark.sql import functions as F

from mirrorledger.operators.inventory import Destination
from mirrorledger.operators.match import match, verdicts
from mirrorledger.sources.store import FingerprintStore, SCHEMA, hits, merged
from mirrorledger.streaming.ingest import ingest, verify_stream
from mirrorledger.streaming.throughput import open_windows, sliding_throughput, write_windows

NOON = datetime(2026, 6, 15, 12, 0, 0)


def stored(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_tolerance(spark):
    known = stored(spark, [(f"/{i}", 10, NOON, "h", "t", None, None) for i in range(7)])
    shifts = [0.5, 1.2, 1.8, 3.5, 4.0, -2.0, 2.0]
    inventory = spark.createDataFrame(
        [(f"/{i}", 10, NOON + timedelta(seconds=s)) for i, s in enumerate(shifts)] + [("/0", 11, NOON)],
        "full_path string, file_length long, mtime timestamp",
    )
    got = {(r["full_path"], r["file_length"]): (r["is_hit"], r["head_fp"]) for r in hits(inventory, known).collect()}
    for i, expected in enumerate([True, True, True, False, False, True, True]):
        assert got[f"/{i}", 10] == (expected, "h" if expected else None)
    assert got["/0", 11] == (False, None)


def test_upsert_replaces_and_keeps_what_still_holds(spark, tmp_path):
    old = [("/a", 1, NOON, "h", "t", None, None), ("/b", 1, NOON, "h", "t", None, None), ("/c", 1, NOON, "h", None, None, None)]
    new = [("/a", 1, NOON + timedelta(seconds=1), None, None, None, "f"), ("/b", 2, NOON, None, None, None, "f"),
           ("/d", 9, NOON, "x", None, None, None)]
    expected = {("/a", 1, "h", "t", "f"), ("/b", 2, None, None, "f"), ("/c", 1, "h", None, None), ("/d", 9, "x", None, None)}
    columns = ["full_path", "file_length", "head_fp", "tail_fp", "full_fp"]
    once = merged(stored(spark, old), stored(spark, new))
    assert {tuple(r) for r in once.select(*columns).collect()} == expected
    store = FingerprintStore(spark, str(tmp_path / "store"))
    store.clear()
    assert store.current().count() == 0
    store.upsert(stored(spark, old), 0)
    store.upsert(stored(spark, new), 1)
    store.upsert(stored(spark, new), 1)  # the same write again
    assert {tuple(r) for r in store.current().select(*columns).collect()} == expected
    assert {r["full_path"] for r in store.by_length(1).collect()} == {"/a", "/c"}
    assert store.get("/a", 1, NOON + timedelta(seconds=2)).count() == 1
    assert store.get("/a", 1, NOON + timedelta(seconds=4)).count() == 0
    assert store.get("/a", 2, NOON).count() == 0
    small = store.compact(str(tmp_path / "compact"))
    assert {tuple(r) for r in small.current().select(*columns).collect()} == expected
    store.clear()
    assert store.current().count() == 0


def _files():
    shared = [payload(n, n) for n in (100, 200, 300, 400)]
    card = [("card", f"{i}.jpg", d) for i, d in enumerate(shared)]
    return card + [("ssd", "0.jpg", shared[0]), ("ssd", "z/1.jpg", shared[1]), ("ssd", "2.jpg", payload(300, 9))]


def test_streams_equal_batches(spark, tmp_path):
    source, backups = split(all_prints(spark, _files()))
    source.repartition(3).write.parquet(str(tmp_path / "manifest"))
    stream = (
        spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "manifest"))
    )
    ssd = [Destination("ssd", "", "/ssd")]
    verify_stream(stream, backups, ssd, "Quick", str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    columns = ["relative_path", "dest_id", "status", "matched_path", "failure_reason"]
    batch = {tuple(r) for r in verdicts(match(source, backups, ssd, "Quick")).select(*columns).collect()}
    assert {tuple(r) for r in verdicts(spark.read.parquet(str(tmp_path / "out"))).select(*columns).collect()} == batch
    store = FingerprintStore(spark, str(tmp_path / "store"))
    store.clear()
    ingest(stream, store, str(tmp_path / "c2")).awaitTermination()
    assert store.versions().select("batch").distinct().count() > 1
    assert {tuple(r) for r in store.current().select("full_path", "full_fp").collect()} == {
        tuple(r) for r in source.select("full_path", "full_fp").collect()
    }


def test_late_events_are_dropped(spark, tmp_path):
    # A micro-batch drops what the watermark of the one before calls late.
    events = [(NOON, "a", 50), (NOON + timedelta(seconds=60), "a", 10), (NOON + timedelta(seconds=61), "a", 1),
              (NOON + timedelta(seconds=1), "a", 1000), (NOON + timedelta(seconds=120), "a", 0)]
    schema = "ts timestamp, device string, bytes long"
    for i, event in enumerate(events):
        spark.createDataFrame([event], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    windows = sliding_throughput(stream)
    write_windows(windows, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.schema(windows.schema).parquet(str(tmp_path / "out"))
    assert rows.where(F.col("window_end") <= NOON + timedelta(seconds=6)).agg(F.sum("bytes")).first()[0] == 250
    assert rows.where(F.col("window_start") == NOON).first()["bytes_per_second"] == 10.0


def test_open_windows_complete_a_stream(spark, tmp_path):
    """Closed and open windows together are those of the table, also after the stream has gone on from its checkpoint."""
    schema = "ts timestamp, device string, bytes long"
    written = []
    for part in range(2):
        events = [(NOON + timedelta(seconds=60 * part + k), f"d{k % 3}", k + 1) for k in range(0, 55, 2)]
        spark.createDataFrame(events, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows = sliding_throughput(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        write_windows(windows, str(tmp_path / "out"), str(tmp_path / "c"), trigger={"availableNow": True}).awaitTermination()
        closed = spark.read.schema(windows.schema).parquet(str(tmp_path / "out"))
        still_open = open_windows(spark, str(tmp_path / "c"))
        assert still_open.columns == closed.columns
        written.append((closed.count(), still_open.count()))
        want = sliding_throughput(spark.read.schema(schema).parquet(str(tmp_path / "in")))
        assert sorted(map(tuple, closed.unionByName(still_open).collect())) == sorted(map(tuple, want.collect()))
    assert all(n and m for n, m in written) and written[0][0] < written[1][0]

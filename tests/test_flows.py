"""Flows over real files: the store in them, and the staged duplicate audit."""

import os
import random
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from helpers import payload
from pyspark.sql import functions as F

from mirrorledger.functions.fingerprints import ProbeTiers
from mirrorledger.operators.duplicates import audit, duplicate_items, find_duplicates
from mirrorledger.operators.inventory import FINGERPRINTS, Destination
from mirrorledger.operators.match import verdicts
from mirrorledger.plans import verify
from mirrorledger.sources import files, ranges
from mirrorledger.sources.bucketed_store import BucketedStore
from mirrorledger.sources.store import SCHEMA

CHUNK = 64
TIERS = ProbeTiers(edge=64, tier1_max=256, tier2_max=4096, tier2_slice=128, tier3_slice=256)


def write(root, entries):
    for path, data in entries.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)


@pytest.fixture
def trees(tmp_path):
    """Files of few lengths, so stages have much to tell apart: equal ones, equal edges, other middles, copies."""
    rng = random.Random(4)
    bodies = []
    for k in range(24):
        size = rng.choice([0, 50, 64, 65, 900, 900, 900, 3000])
        body = bytearray(payload(size, k % 9))
        if size == 900 and k % 3 == 0:
            body[400 + k] ^= 1
        bodies.append(bytes(body))
    write(tmp_path / "card", {f"{k}{rng.choice(['.jpg', '.mov'])}": b for k, b in enumerate(bodies)})
    for name in ("ssd", "nas"):
        write(tmp_path / name, {f"x/{rng.randint(0, 40)}_{k}.jpg": rng.choice(bodies) for k in range(30)})
        write(tmp_path / name, {"only.mov": payload(777, 99)})
    return {n: str(tmp_path / n) for n in ("card", "ssd", "nas")}


def destinations(roots):
    return [Destination(n, n, roots[n]) for n in ("ssd", "nas")]


def shown(results):
    return sorted(map(tuple, verdicts(results).select("relative_path", "dest_id", "status", "matched_path").collect()), key=str)


@pytest.mark.parametrize("mode", ["Deep", "Full"])
def test_second_run_reads_nothing(spark, tmp_path, trees, mode):
    store = BucketedStore(spark, str(tmp_path / "store"), buckets=3, fold_after=2)
    inventory = files.scan(spark, trees)
    plain, read = verify.verify_files(spark, inventory, mode, CHUNK, destinations(trees), TIERS)
    assert read.agg(F.sum("bytes_read")).first()[0] > 0
    runs = [verify.verify_files(spark, inventory, mode, CHUNK, destinations(trees), TIERS, store) for _ in range(3)]
    assert all(shown(results) == shown(plain) for results, _ in runs)
    assert runs[0][1].agg(F.sum("bytes_read")).first()[0] == read.agg(F.sum("bytes_read")).first()[0]
    assert [r.agg(F.sum("bytes_read")).first()[0] for _, r in runs[1:]] == [0, 0]
    # Nothing was written by a run that read nothing.
    assert store.state() == (None, [1])
    # A file changed since is read again, and it alone.
    changed = os.path.join(trees["ssd"], "x", sorted(os.listdir(trees["ssd"] + "/x"))[0])
    size = os.path.getsize(changed)
    with open(changed, "wb") as out:
        out.write(b"\1" * size)
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    results, again = verify.verify_files(spark, files.scan(spark, trees), mode, CHUNK, destinations(trees), TIERS, store)
    assert {r.full_path for r in again.where("bytes_read > 0").collect()} <= {changed}
    assert shown(results) == shown(verify.verify_files(spark, files.scan(spark, trees), mode, CHUNK, destinations(trees), TIERS)[0])


def test_lookup_leaves_the_base_where_it_is(spark, tmp_path, trees):
    store = BucketedStore(spark, str(tmp_path / "store"), buckets=3, fold_after=2)
    known = ranges.fingerprint_files(files.scan(spark, trees), FINGERPRINTS, chunk=CHUNK, tiers=TIERS)
    assert store.upsert(known) == 1 and store.state() == (None, [1])
    assert store.upsert(known.where("root_id = 'card'")) == 2 and store.state() == ((2, 3), [])
    assert store.upsert(known.where("root_id = 'nas'"), 2) == 2  # a repeated write, older than the base: no news
    assert store.state() == ((2, 3), [])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = store.lookup(files.scan(spark, trees))
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        assert found.count() == known.count() == found.where("is_hit").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("\nExchange") + plan.count(") Exchange\n") <= 2 and "Bucketed: true" in plan
    assert sorted(map(tuple, found.select("full_path", *FINGERPRINTS).collect())) == sorted(
        map(tuple, known.select("full_path", *FINGERPRINTS).collect())
    )


def test_store_keeps_what_still_holds_over_folds(spark, tmp_path, trees):
    store = BucketedStore(spark, str(tmp_path / "store"), buckets=2, fold_after=3)
    inventory = files.scan(spark, trees)
    for names in (["head_fp", "tail_fp"], ["deep_fp"], ["full_fp"], ["head_fp"]):
        store.upsert(ranges.fingerprint_files(inventory, names, chunk=CHUNK, tiers=TIERS))
    assert store.state() == ((3, 2), [4])
    whole = ranges.fingerprint_files(inventory, FINGERPRINTS, chunk=CHUNK, tiers=TIERS)
    key = ["full_path", "file_length", *FINGERPRINTS]
    assert sorted(map(tuple, store.current().select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    (tmp_path / "store" / "base-9-2").mkdir()  # an unfinished fold
    (tmp_path / "store" / "delta-9").mkdir()
    assert store.state() == ((3, 2), [4])


@pytest.mark.parametrize("mode", ["SuperFast", "Quick", "Deep", "Full"])
def test_staged_audit_equals_the_audit_of_all_fingerprints(spark, trees, mode):
    inventory = files.scan(spark, trees)
    whole = ranges.fingerprint_files(inventory, FINGERPRINTS, chunk=CHUNK, tiers=TIERS)
    is_card = F.col("root_id") == "card"
    wanted = audit(whole.where(is_card), whole.where(~is_card), destinations(trees), mode)
    found, read = verify.audit_files(spark, inventory, mode, CHUNK, destinations(trees), TIERS)
    for rows in (find_duplicates, duplicate_items):
        a, b = (sorted(map(str, rows(None, None, destinations(trees), mode, found=x).collect())) for x in (wanted, found))
        assert a == b and a
    # Bytes: nothing of a (length, category) without two copies on the backups and one on the card.
    per = read.groupBy("file_length", "category").agg(
        F.count(F.when(is_card, 1)).alias("card"), F.count(F.when(~is_card, 1)).alias("held"), F.sum("bytes_read").alias("bytes")
    )
    for r in per.collect():
        if mode == "SuperFast" or r.card == 0 or r.held < 2:
            assert r.bytes == 0
        else:
            assert r.bytes > 0 or r.file_length == 0
    whole_bytes = whole.agg(F.sum("bytes_read")).first()[0]
    assert read.agg(F.sum("bytes_read")).first()[0] < whole_bytes


def test_audit_after_verification_reads_only_the_rest(spark, tmp_path, trees):
    store = BucketedStore(spark, str(tmp_path / "store"))
    inventory = files.scan(spark, trees)
    _, verified = verify.verify_files(spark, inventory, "Quick", CHUNK, destinations(trees), TIERS)
    results, found, read = verify.verify_and_audit(spark, inventory, "Quick", CHUNK, destinations(trees), TIERS, store)
    alone, _ = verify.audit_files(spark, inventory, "Quick", CHUNK, destinations(trees), TIERS)
    a, b = (sorted(map(str, find_duplicates(None, None, [], "Quick", found=x).collect())) for x in (found, alone))
    assert a == b
    assert read.agg(F.sum("bytes_read")).first()[0] == verified.agg(F.sum("bytes_read")).first()[0]
    _, _, again = verify.verify_and_audit(spark, inventory, "Full", CHUNK, destinations(trees), TIERS, store)
    assert 0 < again.agg(F.sum("bytes_read")).first()[0]
    _, _, third = verify.verify_and_audit(spark, inventory, "Full", CHUNK, destinations(trees), TIERS, store)
    assert third.agg(F.sum("bytes_read")).first()[0] == 0


def test_copies_with_a_store(spark, tmp_path):
    write(tmp_path / "card", {"a.jpg": payload(300, 1), "b.jpg": payload(400, 2)})
    write(tmp_path / "ssd", {"a.jpg": payload(300, 9)})
    roots = {n: str(tmp_path / n) for n in ("card", "ssd")}
    store = BucketedStore(spark, str(tmp_path / "store"))
    for copied in (2, 0):
        _, _, outcome = verify.copy_missing(spark, roots, [Destination("ssd", "", roots["ssd"])], CHUNK, store)
        assert outcome.where("action LIKE 'WRITE%' AND error IS NULL").count() == copied
    assert (tmp_path / "ssd/a_1.jpg").read_bytes() == payload(300, 1)


def test_lookup_by_length_reads_its_row_groups_only(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "store"), buckets=2, fold_after=2)
    rows = [(f"/f{k}", k % 50, datetime(2024, 1, 1), f"h{k}", None, None, f"x{k}") for k in range(2000)]
    # One length has a third of all rows.
    rows += [(f"/hot{k}", 7, datetime(2024, 1, 1), "h", None, None, "x") for k in range(1000)]
    first = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert(first)
        store.upsert(first.limit(0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.state() == ((2, 2), [])

    def expected(length):
        return sorted(tuple(r) for r in store.current().where(F.col("file_length") == length).collect())

    found = store.by_length(7)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert "EqualTo(file_length,7)" in plan and "Exchange" not in plan
    assert sorted(tuple(r) for r in found.collect()) == expected(7) and found.count() == 1040

    def files_with(length):
        stats = [
            pq.ParquetFile(p).metadata.row_group(g).column(1).statistics
            for p in (tmp_path / "store" / "lengths-2-2").glob("*.parquet")
            for g in range(pq.ParquetFile(p).metadata.num_row_groups)
        ]
        return sum(s.min <= length <= s.max for s in stats), len(stats)

    assert files_with(7)[0] > 1  # the hot length is dealt over several tasks
    assert files_with(49)[0] == 1 < files_with(49)[1] == int(before)

    # Later writes: paths that enter the length, leave it, keep fingerprints, lose them, are new.
    later = [("/f7", 8, datetime(2024, 1, 2), "n", None, None, None), ("/f9", 7, datetime(2024, 1, 2), "n", None, None, None),
             ("/f57", 7, datetime(2024, 1, 1), None, "t", None, None), ("/f107", 7, datetime(2024, 2, 1), "n", None, None, None),
             ("/new", 7, None, "n", None, None, None)]
    store.upsert(spark.createDataFrame(later, SCHEMA))
    got = sorted(tuple(r) for r in store.by_length(7).select("full_path", "head_fp", "tail_fp", "full_fp").collect())
    known = {r[0]: r for r in got}
    assert "/f7" not in known and known["/f9"] == ("/f9", "n", None, None) and known["/new"][1] == "n"
    assert known["/f57"] == ("/f57", "h57", "t", "x57") and known["/f107"] == ("/f107", "n", None, None)
    assert got == sorted(
        tuple(r) for r in store.current().where("file_length = 7").select("full_path", "head_fp", "tail_fp", "full_fp").collect()
    )
    assert store.by_length(10**6).count() == 0
    assert BucketedStore(spark, str(tmp_path / "none")).by_length(7).count() == 0


def test_lookup_by_length_without_its_layout(spark, tmp_path):
    """A fold that was stopped after the base."""
    store = BucketedStore(spark, str(tmp_path / "store"), buckets=2, fold_after=1)
    store.upsert(spark.createDataFrame([(f"/f{k}", k % 3, None, "h", None, None, None) for k in range(9)], SCHEMA))
    (tmp_path / "store" / "lengths-1-2" / "_SUCCESS").unlink()
    assert {r.full_path for r in store.by_length(1).collect()} == {"/f1", "/f4", "/f7"}


@pytest.mark.parametrize("mode", ["Quick", "Full"])
def test_flagged_rows_are_found_once(spark, trees, monkeypatch, mode):
    """The number of tasks follows from the written inventory; counting the flagged rows would join them a second time."""
    inventory = files.scan(spark, trees)
    expected = [r.asDict() for f in (verify.verify_files, verify.audit_files) for r in f(spark, inventory, mode, CHUNK, tiers=TIERS)[1]
                .select("full_path", "bytes_read", *FINGERPRINTS).orderBy("full_path").collect()]

    def counted(*_):
        raise AssertionError("counted again")

    monkeypatch.setattr(ranges, "io_tasks", counted)
    found = [r.asDict() for f in (verify.verify_files, verify.audit_files) for r in f(spark, inventory, mode, CHUNK, tiers=TIERS)[1]
             .select("full_path", "bytes_read", *FINGERPRINTS).orderBy("full_path").collect()]
    assert found == expected

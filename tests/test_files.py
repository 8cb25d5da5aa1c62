"""Real files: listing, range reads, metadata, copying."""

import errno
import hashlib
import os
import struct

import pytest
from helpers import payload
from pyspark.sql import functions as F

from mirrorledger.functions import constants as K
from mirrorledger.functions import fingerprints as fp
from mirrorledger.operators import copying
from mirrorledger.operators.inventory import FINGERPRINTS, Destination
from mirrorledger.plans import verify
from mirrorledger.sources import exif, files, ranges, transfer


def write(root, entries):
    for path, data in entries.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)


def listed(df):
    return {r["relative_path"]: (r["file_length"], r["category"]) for r in df.collect()}


CARD = {
    "DCIM/100EOS/IMG_0001.CR3": b"x" * 500,
    "DCIM/100EOS/IMG_0002.JPG": b"x" * 200,
    "DCIM/100EOS/IMG_0003.MOV": b"x" * 1000,
    "DCIM/100EOS/IMG_0001.XMP": b"x" * 50,
    "DCIM/100EOS/notes.txt": b"x" * 30,
}


@pytest.mark.parametrize("how", ["scan", "source"])
def test_presets(spark, tmp_path, how):
    write(tmp_path, CARD)

    def run(preset):
        if how == "scan":
            return files.scan(spark, {"card": str(tmp_path)}, preset)
        return files.read_inventory(spark, "card", str(tmp_path), preset)

    assert set(listed(run("Photos Only"))) == {"DCIM/100EOS/IMG_0001.CR3", "DCIM/100EOS/IMG_0002.JPG"}
    assert len(listed(run("All Camera Media (with Sidecars)"))) == 4
    assert listed(run(None))["DCIM/100EOS/notes.txt"] == (30, "Other")


@pytest.mark.parametrize("how", ["scan", "source"])
def test_hazards(spark, tmp_path, how):
    kept = ["empty.jpg", "_MG_2.CR2", "with space.jpg", "a=b/é.jpg", "Lightroom Catalogs/a.jpg", "Wedding_Photos/b.jpg"]
    gone = [".hidden.jpg", ".git/a.jpg", "x.lrdata/a.jpg", "$RECYCLE.BIN/a.jpg", "#recycle/a.jpg", "noextension"]
    write(tmp_path, dict.fromkeys(kept + gone, b""))
    os.symlink(tmp_path, tmp_path / "loop")
    df = (
        files.scan(spark, {"r": str(tmp_path)}) if how == "scan" else files.read_inventory(spark, "r", str(tmp_path))
    )
    assert set(listed(df)) == set(kept)


def test_one_crowded_folder_is_dealt_to_all_tasks(spark, tmp_path):
    write(tmp_path, {f"DCIM/{k:04}/a.jpg": b"x" for k in range(400)} | {"DCIM/0001/deep/er/b.JPG": b"y", "DCIM/c.mov": b"z"})
    work = files.plan_folders(str(tmp_path), 8)
    assert len(work) == 8 and max(map(len, work)) - min(map(len, work)) <= 1
    assert sorted(w for some in work for w in some) == sorted([("", False), ("DCIM", False), *((f"DCIM/{k:04}", True) for k in range(400))])
    found = files.read_inventory(spark, "r", str(tmp_path), "Photos Only", partitions=8)
    assert found.rdd.getNumPartitions() == 8
    assert sorted(r.relative_path for r in found.collect()) == sorted([*(f"DCIM/{k:04}/a.jpg" for k in range(400)), "DCIM/0001/deep/er/b.JPG"])


@pytest.mark.parametrize("partitions", [1, 2, 50])
def test_any_number_of_partitions_lists_each_file_once(spark, tmp_path, partitions):
    names = ["a.jpg", "b/c.jpg", "b/d/e.jpg", "b/d/f/g.jpg", "h/i.jpg", "h/j/k/l/m.jpg"]
    write(tmp_path, dict.fromkeys(names, b"x"))
    found = files.read_inventory(spark, "r", f"{tmp_path}/b/..//", partitions=partitions)
    assert sorted((r.relative_path, r.full_path) for r in found.collect()) == [(n, f"{tmp_path}/{n}") for n in sorted(names)]
    assert files.read_inventory(spark, "r", str(tmp_path / "none"), partitions=partitions).count() == 0


def test_crowded_folder_comes_in_batches(tmp_path, monkeypatch):
    write(tmp_path, {f"{k}.jpg": b"x" for k in range(25)})
    monkeypatch.setattr(files, "BATCH_ROWS", 10)
    reader = files._InventoryReader("r", str(tmp_path), 4, None)
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [10, 10, 5]


def test_a_tree_mounted_inside_itself_is_entered_once(tmp_path, monkeypatch):
    """Mounts need rights that tests lack: one folder is given the device and inode of a folder around it."""
    write(tmp_path, {"a/b/c.jpg": b"x", "a/again/d.jpg": b"x", "other/again/e.jpg": b"x"})
    around, inner = os.stat(tmp_path / "a"), str(tmp_path / "a" / "again")
    real = os.scandir

    class Mounted:
        def __init__(self, entry):
            self.entry = entry

        def __getattr__(self, name):
            return getattr(self.entry, name)

        def stat(self, **how):
            return around if self.entry.path == inner else self.entry.stat(**how)

    class Listing:
        def __init__(self, path):
            self.found = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *error):
            self.found.close()

        def __next__(self):
            return Mounted(next(self.found))

    monkeypatch.setattr(os, "scandir", Listing)
    reader = files._InventoryReader("r", str(tmp_path), 1, None)
    found = [r["folder"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(found) == ["a/b", "other/again"]


def test_missing_and_blank_roots(spark, tmp_path):
    assert files.scan(spark, {"a": "", "b": "  ", "c": str(tmp_path / "none")}).count() == 0


def test_ignored_names():
    for name in [".lrdata", "A.photoslibrary", "b.PhotoLibrary", "c.aplibrary", "d.copkg", ".git", ".cache", "$recycle.bin",
                 ".Trash-1000", ".TemporaryItems", ".DocumentRevisions-V100", "", "  "]:
        assert files.is_ignored_folder(name), name
    for name in ["DCIM", "100EOS", "Wedding_Photos", "Lightroom Catalogs"]:
        assert not files.is_ignored_folder(name), name


def test_range_reads_equal_columns_over_content(spark, tmp_path):
    sizes = [0, 1, 1000, 64 * K.KIB, 64 * K.KIB + 1, 128 * K.KIB, 5 * K.MIB]
    data = {f"f{n}.jpg": payload(n, n) for n in sizes}
    write(tmp_path, data)
    got = ranges.fingerprint_files(files.scan(spark, {"r": str(tmp_path)}), FINGERPRINTS)
    rows = {r["relative_path"]: r for r in got.collect()}
    for name, body in data.items():
        head, tail = body[: 64 * K.KIB], body[-64 * K.KIB :] if body else b""
        assert rows[name]["head_fp"] == hashlib.md5(head).hexdigest()
        assert rows[name]["tail_fp"] == hashlib.md5(tail).hexdigest()
        assert rows[name]["full_fp"] == hashlib.md5(body).hexdigest()
    content = spark.createDataFrame([(n, bytearray(b)) for n, b in data.items()], "relative_path string, content binary")
    size = F.octet_length("content")
    for algorithm in ("md5", "xxhash64"):
        columns = content.select(
            "relative_path",
            fp.head(F.col("content"), size, algorithm=algorithm).alias("head_fp"),
            fp.tail(F.col("content"), size, algorithm=algorithm).alias("tail_fp"),
            fp.deep(F.col("content"), size, algorithm=algorithm).alias("deep_fp"),
            fp.full(F.col("content"), size, algorithm).alias("full_fp"),
        )
        disk = ranges.fingerprint_files(
            files.scan(spark, {"r": str(tmp_path)}), FINGERPRINTS, algorithm=algorithm
        )
        assert {tuple(r) for r in columns.collect()} == {tuple(r) for r in disk.select(*columns.columns).collect()}


def test_unreadable_file_is_a_row_not_a_failure(spark, tmp_path):
    write(tmp_path, {"a.jpg": b"abc", "b.jpg": b"abc"})
    inventory = files.scan(spark, {"r": str(tmp_path)})
    os.unlink(tmp_path / "b.jpg")
    rows = {r["relative_path"]: r for r in ranges.fingerprint_files(inventory, "Full").collect()}
    assert rows["a.jpg"]["error"] is None and rows["b.jpg"]["error"] and rows["b.jpg"]["full_fp"] is None


def test_known_fingerprints_are_not_read_again(spark, tmp_path):
    write(tmp_path, {"a.jpg": b"abc"})
    inventory = files.scan(spark, {"r": str(tmp_path)}).withColumn("head_fp", F.lit("known")).withColumn("tail_fp", F.lit("t"))
    os.unlink(tmp_path / "a.jpg")
    row = ranges.fingerprint_files(inventory, "Quick").first()
    assert (row["head_fp"], row["tail_fp"], row["error"]) == ("known", "t", None)


def test_small_files_are_read_once(spark, tmp_path):
    write(tmp_path, {"a.jpg": b"abc", "b.jpg": payload(1000, 1)})
    inventory = files.scan(spark, {"r": str(tmp_path)}).withColumn("head_fp", F.lit("known"))
    os.unlink(tmp_path / "a.jpg")
    rows = {r["relative_path"]: r for r in ranges.fingerprint_files(inventory, "Full", chunk=100).collect()}
    assert tuple(rows["a.jpg"][c] for c in ("head_fp", "tail_fp", "full_fp", "error")) == ("known", "known", "known", None)
    assert rows["b.jpg"]["full_fp"] == hashlib.md5(payload(1000, 1)).hexdigest() and rows["b.jpg"]["head_fp"] == "known"


def test_deep_verification_samples_with_the_sizes_for_media(spark, tmp_path):
    body = payload(30 * K.MIB, 1)
    planned = [(p["offset"], p["length"]) for p in spark.range(1).select(fp.probe_plan(F.lit(len(body))).alias("p")).first()["p"]]
    unread = next(a + n for (a, n), (b, _) in zip(planned[:-1], planned[1:]) if a + n < b)
    read = planned[2][0]
    for name, at in (("same", None), ("unread", unread), ("read", read)):
        changed = bytearray(body)
        if at is not None:
            changed[at] ^= 255
        write(tmp_path / name, {"a.mov": bytes(changed)})
    write(tmp_path / "card", {"a.mov": body})
    roots = {n: str(tmp_path / n) for n in ("card", "same", "unread", "read")}
    for name, status in (("same", "Verified"), ("unread", "Verified"), ("read", "Corrupt")):
        pair = {n: roots[n] for n in ("card", name)}
        results, _ = verify.verify_files(
            spark, files.scan(spark, pair), "Deep", K.HEAD_TAIL_BYTES, [Destination(name, "", roots[name])]
        )
        assert results.first()["overall_status"] == status, name


def test_copies_where_links_are_refused(tmp_path, monkeypatch):
    def refuse(*_):
        raise OSError(errno.EPERM, "no links here")

    monkeypatch.setattr(os, "link", refuse)
    write(tmp_path, {"src.jpg": b"new", "root/a.jpg": b"old"})
    task = {"dest_id": "d", "root_path": str(tmp_path / "root"), "relative_path": "a.jpg", "target_path": "a.jpg", "action": "WRITE"}
    for _ in range(2):  # the second run finds its own copy
        (outcome,) = transfer._copy_one(str(tmp_path / "src.jpg"), [task], 64)
        assert (outcome["target_path"], outcome["error"]) == ("a_1.jpg", None)
    assert sorted(os.listdir(tmp_path / "root")) == ["a.jpg", "a_1.jpg"]
    assert (tmp_path / "root/a.jpg").read_bytes() == b"old" and (tmp_path / "root/a_1.jpg").read_bytes() == b"new"


def test_a_killed_claim_is_taken_over_by_its_retry(tmp_path, monkeypatch):
    """A task killed between creating the name and replacing it leaves an empty file; foreign empty files stay."""

    def refuse(*_):
        raise OSError(errno.EPERM, "no links here")

    monkeypatch.setattr(os, "link", refuse)
    write(tmp_path, {"src.jpg": b"new"})
    (tmp_path / "root").mkdir()
    task = {"dest_id": "d", "root_path": str(tmp_path / "root"), "relative_path": "a.jpg", "target_path": "a.jpg", "action": "WRITE"}
    real = os.replace

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(os, "replace", killed)
    with pytest.raises(KeyboardInterrupt):
        transfer._copy_one(str(tmp_path / "src.jpg"), [task], 64)
    assert (tmp_path / "root/a.jpg").read_bytes() == b""
    monkeypatch.setattr(os, "replace", real)
    for _ in range(2):
        (outcome,) = transfer._copy_one(str(tmp_path / "src.jpg"), [task], 64)
        assert (outcome["target_path"], outcome["error"]) == ("a.jpg", None)
    assert (tmp_path / "root/a.jpg").read_bytes() == b"new"
    assert not [n for n in os.listdir(tmp_path / "root") if n.endswith(".claim")]
    write(tmp_path, {"other.jpg": b"more", "root/b.jpg": b""})
    (outcome,) = transfer._copy_one(str(tmp_path / "other.jpg"), [task | {"relative_path": "b.jpg", "target_path": "b.jpg"}], 64)
    assert outcome["target_path"] == "b_1.jpg" and (tmp_path / "root/b.jpg").read_bytes() == b""


def test_disabled_destination_takes_no_part(spark, tmp_path):
    write(tmp_path / "card", {"a.jpg": b"abc"})
    (tmp_path / "ssd").mkdir()
    roots = {"card": str(tmp_path / "card"), "ssd": str(tmp_path / "ssd")}
    inside = str(tmp_path / "card" / "backup")
    destinations = [
        Destination("off", "", inside, is_enabled=False), Destination("twin", "", roots["ssd"], is_enabled=False),
        Destination("ssd", "", roots["ssd"]),
    ]
    _, _, outcome = verify.copy_missing(spark, roots, destinations, 64)
    assert [(r["dest_id"], r["error"]) for r in outcome.collect()] == [("ssd", None)]
    assert (tmp_path / "ssd/a.jpg").read_bytes() == b"abc"


def test_totals_of_an_empty_root(spark, tmp_path):
    from mirrorledger.operators import inventory

    write(tmp_path / "card", {"a.jpg": b"abc"})
    found = inventory.totals(files.scan(spark, {"card": str(tmp_path / "card")}), ["card", "empty"])
    assert {tuple(r) for r in found.collect()} == {("card", 1, 3), ("empty", 0, 0)}


def test_staged_files_equal_whole_reads(spark, tmp_path):
    body = payload(300_000, 1)
    middle = body[:150_000] + b"!" + body[150_001:]
    write(tmp_path / "card", {"a.jpg": body, "b.jpg": payload(10, 2), "c.jpg": b"only here"})
    write(tmp_path / "ssd", {"a.jpg": middle, "q/x.jpg": payload(10, 2)})
    roots = {"card": str(tmp_path / "card"), "ssd": str(tmp_path / "ssd")}
    results, known = verify.verify_files(
        spark, files.scan(spark, roots), "Full", K.HEAD_TAIL_BYTES, [Destination("ssd", "", roots["ssd"])]
    )
    got = {r["relative_path"]: r["overall_status"] for r in results.collect()}
    assert got == {"a.jpg": "Corrupt", "b.jpg": "Verified", "c.jpg": "Missing"}
    # A length that occurs on one side only is never read.
    assert known.where("relative_path = 'c.jpg'").first()["head_fp"] is None


def test_copy_missing_then_safe_and_repeatable(spark, tmp_path):
    old, new = payload(200_000, 1), payload(300_000, 2)
    write(tmp_path / "card", {"x/I.CR3": new, "x/J.CR3": payload(10, 3), "x/K.CR3": b"k"})
    write(tmp_path / "ssd", {"x/I.CR3": old, "x/K.CR3": b"k"})
    (tmp_path / "nas").mkdir()
    roots = {n: str(tmp_path / n) for n in ("card", "ssd", "nas")}
    destinations = [Destination(n, n, roots[n]) for n in ("ssd", "nas")]
    for expected in [(3, 0, 0, 1), (0, 0, 0, 0)]:
        _, _, outcome = verify.copy_missing(spark, roots, destinations, K.HEAD_TAIL_BYTES)
        counts = copying.copy_result_counts(outcome).first()
        assert tuple(counts) == expected
    assert (tmp_path / "ssd/x/I.CR3").read_bytes() == old
    assert (tmp_path / "ssd/x/I_1.CR3").read_bytes() == new
    assert (tmp_path / "nas/x/I.CR3").read_bytes() == new
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".part")]


def test_copy_into_the_source_is_refused(spark, tmp_path):
    write(tmp_path / "card", {"a.jpg": b"abc"})
    inside = str(tmp_path / "card" / "backup")
    with pytest.raises(ValueError):
        verify.copy_missing(
            spark, {"card": str(tmp_path / "card"), "b": inside}, [Destination("b", "", inside)], K.HEAD_TAIL_BYTES
        )


def test_unreachable_destination_fails_alone(spark, tmp_path):
    write(tmp_path / "card", {"a.jpg": b"abc"})
    roots = {"card": str(tmp_path / "card"), "ssd": str(tmp_path / "ssd"), "gone": str(tmp_path / "gone")}
    (tmp_path / "ssd").mkdir()
    destinations = [Destination("ssd", "", roots["ssd"]), Destination("gone", "", roots["gone"])]
    _, _, outcome = verify.copy_missing(spark, roots, destinations, 64)
    rows = {r["dest_id"]: r for r in outcome.collect()}
    assert rows["ssd"]["error"] is None and "cannot be reached" in rows["gone"]["error"]
    assert tuple(copying.copy_result_counts(outcome).first()) == (0, 0, 1, 0)
    known = [Destination("gone", "", roots["gone"], is_available=False)]
    _, plan, _ = verify.copy_missing(spark, roots, known, 64)
    assert plan.first()["action"] == "UNAVAILABLE"


def tiff(order, model=b"EOS R5\0"):
    """Make, model, exposure and so on as little- or big-endian TIFF, thumbnail in the second directory."""
    def u16(v): return struct.pack(order + "H", v)
    def u32(v): return struct.pack(order + "I", v)
    def entry(tag, kind, count, value): return u16(tag) + u16(kind) + u32(count) + (value if isinstance(value, bytes) else u32(value))

    blob, base, strings = b"", 8 + 42 + 102 + 30, {}
    for name, raw in [("make", b"Canon\0"), ("model", model), ("lens", b"RF24-70mm F2.8 L IS USM\0"), ("date", b"2026:07:21 10:11:12\0"),
                      ("exp", u32(1) + u32(500)), ("f", u32(28) + u32(10)), ("focal", u32(70) + u32(1)), ("thumb", b"\xff\xd8thumb")]:
        strings[name] = (base + len(blob), len(raw))
        blob += raw
    at = lambda n: strings[n][0]
    ifd0 = u16(3) + entry(0x010F, 2, 6, at("make")) + entry(0x0110, 2, len(model), at("model")) + entry(0x8769, 4, 1, 50) + u32(152)
    sub = u16(8) + entry(0x829A, 5, 1, at("exp")) + entry(0x829D, 5, 1, at("f")) + entry(0x8827, 3, 1, u16(400) + u16(0))
    sub += entry(0x9003, 2, 20, at("date")) + entry(0x920A, 5, 1, at("focal")) + entry(0xA002, 4, 1, 8192)
    sub += entry(0xA003, 4, 1, 5464) + entry(0xA434, 2, 24, at("lens")) + u32(0)
    ifd1 = u16(2) + entry(0x0201, 4, 1, at("thumb")) + entry(0x0202, 4, 1, strings["thumb"][1]) + u32(0)
    return (b"II*\0" if order == "<" else b"MM\0*") + u32(8) + ifd0 + sub + ifd1 + blob


def test_exif(spark, tmp_path):
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xe1" + struct.pack(">H", len(tiff("<")) + 8) + b"Exif\0\0" + tiff("<")
    write(tmp_path, {"a.CR2": tiff("<"), "b.NEF": tiff(">", b"Canon R\0"), "c.jpg": jpeg, "d.jpg": b"no metadata here at all", "e.jpg": b"", "f.CR2": tiff("<")[:20]})
    rows = {r["relative_path"]: r for r in exif.from_files(files.scan(spark, {"r": str(tmp_path)})).collect()}
    for name in ("a.CR2", "b.NEF", "c.jpg"):
        r = rows[name]
        assert (r["iso"], r["exposure"], r["f_number"], r["focal_length"]) == ("ISO 400", "1/500s", "f/2.8", "70mm")
        assert (r["dimensions"], r["lens_model"]) == ("8192 × 5464", "RF24-70mm F2.8 L IS USM")
        assert bytes(r["thumbnail"]) == b"\xff\xd8thumb"
        assert r["exposure_summary"] == "70mm • f/2.8 • 1/500s • ISO 400"
    assert (rows["a.CR2"]["camera"], rows["b.NEF"]["camera"]) == ("Canon EOS R5", "Canon R")
    for name in ("d.jpg", "e.jpg"):
        assert (rows[name]["has_exif"], rows[name]["camera"], rows[name]["thumbnail"]) == (False, "Unknown Camera", None)
    assert rows["f.CR2"]["exposure_summary"] in ("Metadata present", "No EXIF exposure metadata available")


def test_a_new_file_is_written_in_place(tmp_path, monkeypatch):
    """Only a name that something has costs its folder a second change."""
    replaced, replace = [], os.replace
    monkeypatch.setattr(files.os, "replace", lambda a, b: (replaced.append(b), replace(a, b)))
    path = str(tmp_path / "a.JPG")
    files._write_file(path, b"long and early", 1_700_000_000_123_456)
    assert not replaced
    assert os.stat(path).st_mtime_ns == 1_700_000_000_123_456_000
    files._write_file(path, b"late", None)
    assert replaced == [path]
    assert open(path, "rb").read() == b"late"
    assert os.listdir(tmp_path) == ["a.JPG"]


def test_write_tree_reports_what_cannot_be_written(spark, tmp_path):
    (tmp_path / "taken").mkdir()
    (tmp_path / "file").write_bytes(b"")
    rows = [(str(tmp_path / p), bytearray(b"x"), None) for p in ("taken", "file/a.JPG", "new/b.JPG", "new/c.JPG")]
    inventory = spark.createDataFrame(rows, "full_path string, content binary, mtime timestamp")
    for _ in range(2):
        errors = {os.path.relpath(r.full_path, tmp_path): r.error for r in files.write_tree(inventory).collect()}
        assert {p for p, e in errors.items() if e} == {"taken", "file/a.JPG"}
        assert (tmp_path / "new/b.JPG").read_bytes() == b"x"
        assert sorted(os.listdir(tmp_path / "new")) == ["b.JPG", "c.JPG"]

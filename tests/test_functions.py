"""Column functions against fixed cases."""

import pytest
from pyspark.sql import functions as F

from mirrorledger.functions import fingerprints as fp
from mirrorledger.functions import constants as K
from mirrorledger.functions import paths, text
from mirrorledger.operators.mounts import affected, mount_events, overlaps


def apply(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_fold_is_per_character(spark):
    assert apply(spark, ["straße.jpg", "a_b", "É", ""], paths.fold) == ["STRAßE.JPG", "A_B", "É", ""]


def test_path_parts(spark):
    names = ["a/b/c.tar.GZ", "x.jpg", "noext", ".hidden", "a.b/c"]
    assert apply(spark, names, paths.extension) == [".GZ", ".jpg", "", ".hidden", ""]
    assert apply(spark, names, paths.stem) == ["c.tar", "x", "noext", "", "c"]
    assert apply(spark, names, paths.directory) == ["a/b", "", "", "", "a.b"]


def test_siblings(spark):
    names = ["d/I_0001_2.CR3", "I_02.jpg", "I_x.jpg", "I_1", "a_1.b.jpg", "I_10001.jpg", "I_10000.jpg"]
    assert apply(spark, names, paths.sibling_of) == ["d/I_0001.CR3", "I.jpg", None, "I", None, "I.jpg", "I.jpg"]
    assert apply(spark, names, paths.sibling_number) == [2, None, None, 1, None, None, 10000]
    assert apply(spark, ["d.x/I.tar.gz", "I", ".rc"], lambda c: paths.numbered_sibling(c, F.lit(3))) == [
        "d.x/I.tar_3.gz", "I_3", "_3.rc",
    ]


def test_names_with_line_ends(spark):
    names = ["a\nb/img.jpg", "a\nb/img_2.jpg", "c/im\ng_2.jpg", "c/img_2.jpg\n"]
    assert apply(spark, names, paths.directory) == ["a\nb", "a\nb", "c", "c"]
    assert apply(spark, names, paths.sibling_of) == [None, "a\nb/img.jpg", "c/im\ng.jpg", "c/img.jpg\n"]
    assert apply(spark, names, paths.sibling_number) == [None, 2, 2, 2]
    assert apply(spark, names[:3], lambda c: paths.numbered_sibling(c, F.lit(1))) == [
        "a\nb/img_1.jpg", "a\nb/img_2_1.jpg", "c/im\ng_2_1.jpg",
    ]


def test_relative_path(spark):
    assert apply(spark, ["C:\\card\\DCIM\\a.jpg"], lambda c: paths.relative_path(c, F.lit("C:\\card"))) == ["DCIM/a.jpg"]


@pytest.mark.parametrize("length, slices, read", [
    (0, 1, 0), (2 * K.MIB, 1, 2 * K.MIB), (4 * K.MIB, 1, 4 * K.MIB), (4 * K.MIB + 1, 5, 917504), (30 * K.MIB, 5, 917504),
    (128 * K.MIB, 5, 917504), (128 * K.MIB + 1, 9, 7471104), (200 * K.MIB, 9, 7471104),
])
def test_probe_plan(spark, length, slices, read):
    plan = apply(spark, [length], fp.probe_plan, "long")[0]
    assert (len(plan), sum(p["length"] for p in plan)) == (slices, read)
    offsets = [p["offset"] for p in plan]
    assert offsets == sorted(set(offsets)) and all(p["offset"] + p["length"] <= length for p in plan)


def test_probe_plan_drops_overlapping_slices(spark):
    tight = fp.ProbeTiers(edge=4, tier1_max=8, tier2_max=100, tier2_slice=4)
    plan = apply(spark, [9], lambda c: fp.probe_plan(c, tight), "long")[0]
    assert [tuple(p) for p in plan] == [(0, 4), (4, 1), (5, 4)]


def test_sizes(spark):
    sizes = [-1, 0, 1023, 1024, 1536, K.MIB, 1_572_864, K.GIB, 5 * K.TIB]
    assert apply(spark, sizes, text.byte_size, "long") == [
        "0 B", "0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "1.5 MB", "1.00 GB", "5.00 TB",
    ]
    assert apply(spark, [1536, 5 * K.TIB], text.report_size, "long") == ["2 KB", "5120.00 GB"]
    assert apply(spark, [1536, 5 * K.TIB], text.capacity_size, "long") == ["2 KB", "5.0 TB"]


def test_hashes(spark):
    assert apply(spark, [-1, 1, None], fp.as_hex64, "long") == ["0x" + "F" * 16, "0x0000000000000001", ""]
    given = ["0xF3A1000012345678", "0x0000000000000001", "17555312822772323960", "F3A1", "0xNOTHEX", "true",
             "18446744073709551615", "18446744073709551616", "0x0", "-1"]
    assert apply(spark, given, fp.parse_hex) == [
        "F3A1000012345678", "0000000000000001", f"{17555312822772323960:016X}", None, None, None, "F" * 16, None,
        "0" * 16, None,
    ]


def test_escaping(spark):
    assert apply(spark, ["=1", "+1", "-1", "@a", "\tx", "\rx", "a=1", "", 'q"q'], text.csv_field) == [
        '"\'=1"', '"\'+1"', '"\'-1"', '"\'@a"', '"\'\tx"', '"\'\rx"', '"a=1"', '""', '"q""q"',
    ]
    assert apply(spark, ["<a b='c'>\"&é€"], text.html) == ["&lt;a b=&#39;c&#39;&gt;&quot;&amp;&#233;€"]


def test_exposure_texts(spark):
    pairs = [(1, 500), (0, 5), (25, 10), (1, 0), (None, 5), (1, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    got = [r["y"] for r in df.select("i", text.exposure_time(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()]
    assert got == ["1/500s", "0s", "2.5s", None, None, None]


def test_verdict_texts(spark):
    rows = [("SafeToFormat", 5, 5, 0, 0, 0), ("PartiallyBackedUp", 5, 4, 1, 0, 0), ("PartiallyBackedUp", 5, 3, 2, 0, 0),
            ("NoMediaFound", 0, 0, 0, 0, 0), ("UnsafeToFormat", 2000, 1, 1, 1234, 5)]
    df = spark.createDataFrame(rows, "v string, t long, f long, p long, m long, c long")
    c = [F.col(n) for n in "vtfpmc"]
    banners = [r[0] for r in df.select(text.verdict_banner(*c)).collect()]
    assert banners[:4] == [
        "SAFE TO FORMAT - 100% BACKED UP", "PARTIALLY BACKED UP - 100% SINGLE COPY (1 NEEDS REDUNDANCY)",
        "PARTIALLY BACKED UP - 100% SINGLE COPY (2 NEED REDUNDANCY)", "NO MEDIA DETECTED - DO NOT FORMAT",
    ]
    badge = df.select(text.verdict_badge(c[0], c[4], c[5])).collect()[4][0]
    assert badge == "UNSAFE TO FORMAT - 1,234 MISSING, 5 CORRUPT"


def test_overlap(spark):
    pairs = [("/volume/card", "/volume/card", False), ("/volume/card/", "/volume/card", False),
             ("/volume/card", "/volume/card/subbackup", False), ("/volume/card/subfolder", "/volume/card", True),
             ("/volume/card/DCIM/100CANON", "/volume/card", True), ("/volume/card", "/volume/backup_drive", True),
             ("/volume/card", "/VOLUME/CARD/x", False), ("", "/a", True)]
    df = spark.createDataFrame(pairs, "source_path string, destination_path string, expected boolean")
    assert overlaps(df).where("is_valid <> expected").count() == 0


def test_mounts(spark):
    schema = "path string, label string, is_removable boolean"
    before = spark.createDataFrame([("/mnt/A", "A", True), ("/mnt/b", "B", False)], schema)
    after = spark.createDataFrame([("/mnt/B", "B", False), ("/mnt/c", "", True)], schema)
    events = mount_events(before, after)
    assert {tuple(r) for r in events.collect()} == {
        ("/mnt/c", "Removable Drive", True, "Inserted"), ("/mnt/A", "Ejected Drive", True, "Removed"),
    }
    rows = spark.createDataFrame([("/MNT/a",), ("/mnt/a/x/y.jpg",), ("/mnt/ab",), ("/mnt",), ("",)], "full_path string")
    assert {r[0] for r in affected(rows, events).collect()} == {"/MNT/a", "/mnt/a/x/y.jpg"}

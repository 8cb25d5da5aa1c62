import re

import pytest
from helpers import all_prints, payload, split
from pyspark.sql import functions as F

from mirrorledger.functions import constants as K
from mirrorledger.operators.duplicates import (
    duplicate_items,
    duplicate_totals,
    filtered_groups,
    find_duplicates,
    largest_groups,
)
from mirrorledger.operators.inventory import Destination

SSD, HDD = Destination("ssd", "SSD"), Destination("hdd", "HDD")


def audit(spark, files, mode, hot_rows=1_000_000):
    source, backups = split(all_prints(spark, files))
    groups = find_duplicates(source, backups, [SSD, HDD], mode)
    return groups, duplicate_items(source, backups, [SSD, HDD], mode, hot_rows=hot_rows)


@pytest.mark.parametrize("hot_rows", [1, 1_000_000])
def test_mixed_group(spark, hot_rows):
    data = payload(90 * K.KIB, 1)
    files = [("card", "clip.mov", data), ("ssd", "clip.mov", data), ("ssd", "clip_renamed.mov", data), ("hdd", "clip.mov", data)]
    groups, items = audit(spark, files, "Quick", hot_rows)
    total = duplicate_totals(groups).first()
    assert tuple(total) == (1, 1, 92160, 1)
    group = groups.first()
    assert (group["is_intra"], group["is_cross"], group["files"]) == (True, True, 3)
    got = {r["full_path"]: (r["is_primary"], r["is_same_destination_duplicate"]) for r in items.collect()}
    assert got == {"/ssd/clip.mov": (True, True), "/ssd/clip_renamed.mov": (False, True), "/hdd/clip.mov": (True, False)}


def test_one_copy_each_reclaims_nothing(spark):
    data = payload(1000, 2)
    groups, _ = audit(spark, [("card", "a.jpg", data), ("ssd", "a.jpg", data), ("hdd", "b.jpg", data)], "Full")
    group = groups.first()
    assert (group["is_intra"], group["is_cross"], group["reclaimable_bytes"]) == (False, True, 0)


def test_different_middle_is_no_group_in_full(spark):
    one = payload(256 * K.KIB, 3)
    two = one[: 128 * K.KIB] + payload(10, 4) + one[128 * K.KIB + 10 :]
    files = [("card", "a.jpg", one), ("ssd", "a.jpg", one), ("ssd", "b.jpg", two)]
    assert audit(spark, files, "Full")[0].count() == 0
    assert audit(spark, files, "Quick")[0].count() == 1


@pytest.mark.parametrize("mode, pattern", [
    ("SuperFast", r"^meta_262144_PhotoStandard$"),
    ("Quick", r"^0x[0-9A-F]{16}_0x[0-9A-F]{16}$"),
    ("Deep", r"^0x[0-9A-F]{16}$"),
    ("Full", r"^0x[0-9A-F]{16}$"),
])
def test_group_key(spark, mode, pattern):
    data = payload(256 * K.KIB, 5)
    groups, _ = audit(spark, [("card", "a.jpg", data), ("ssd", "a.jpg", data), ("ssd", "b.jpg", data)], mode)
    assert re.match(pattern, groups.first()["group_key"])


def test_categories(spark):
    data = payload(900, 6)
    apart = [("card", "photo.jpg", data), ("ssd", "photo.jpg", data), ("ssd", "clip.mp4", data)]
    for mode in K.MODES:
        assert audit(spark, apart, mode)[0].count() == 0
    # Both categories in the source and two files of each: content alone groups them.
    both = [("card", "photo.jpg", data), ("card", "clip.mp4", data)]
    both += [("ssd", n, data) for n in ("photo.jpg", "photo2.jpg", "clip.mp4", "clip2.mp4")]
    for mode in ("Quick", "Deep", "Full"):
        assert [r["files"] for r in audit(spark, both, mode)[0].collect()] == [4]
    assert audit(spark, both, "SuperFast")[0].count() == 2


def test_only_what_the_source_holds(spark):
    mine, other = payload(64 * K.KIB, 7), payload(80 * K.KIB, 8)
    files = [("card", "source_photo.jpg", mine)]
    files += [("ssd", n, mine) for n in ("a.jpg", "b.jpg")] + [("ssd", n, other) for n in ("c.jpg", "d.jpg")]
    for mode in K.MODES:
        groups, _ = audit(spark, files, mode)
        assert [r["reclaimable_bytes"] for r in groups.collect()] == [65536]


def test_filter_and_ranking(spark):
    big, small = payload(5000, 9), payload(50, 10)
    files = [("card", "big.jpg", big), ("card", "small.jpg", small)]
    files += [("ssd", "x/big.jpg", big), ("ssd", "y/copy.jpg", big), ("ssd", "small.jpg", small), ("hdd", "small.jpg", small)]
    groups, items = audit(spark, files, "Full")
    assert [r["file_size"] for r in largest_groups(groups, 1).collect()] == [5000]
    assert [r["file_size"] for r in filtered_groups(groups, items, "DuplicatesOnly").collect()] == [5000]
    assert [r["file_size"] for r in filtered_groups(groups, items, "RedundancyOnly").collect()] == [50]
    assert [r["file_size"] for r in filtered_groups(groups, items, "All", "COPY").collect()] == [5000]
    assert filtered_groups(groups, items, "All", "nothing").count() == 0
    assert items.where(F.col("dest_name") == "HDD").count() == 1

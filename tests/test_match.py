"""Verification: the reference behaviours, one fixture each, and the join form against a ranked candidate list."""

import random

import pytest
from helpers import payload, prints, split
from pyspark.sql import functions as F

from mirrorledger.functions import constants as K
from mirrorledger.operators.inventory import Destination, enabled
from mirrorledger.operators.match import candidates, fold_verdicts, match, verdicts, with_tab
from mirrorledger.operators.summary import protection, status_by_destination, summarize

SSD, NAS = Destination("ssd", "SSD", "/ssd"), Destination("nas", "NAS", "/nas")


def run(spark, files, mode, destinations=(SSD,), **options):
    source, backups = split(prints(spark, files, mode))
    return match(source, backups, list(destinations), mode, **options)


def statuses(results):
    return {(r["relative_path"], r["dest_id"]): (r["status"], r["matched_path"], r["failure_reason"])
            for r in verdicts(results).collect()}


def summary(results, mode):
    return summarize(results, mode).first()


def flipped(data: bytes, at: int) -> bytes:
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def test_partial_then_safe(spark):
    data = [payload(k * K.KIB, k) for k in (64, 80, 96)]
    names = [f"IMG_000{i}.CR3" for i in (1, 2, 3)]
    files = [(root, n, d) for root in ("card", "ssd") for n, d in zip(names, data)]
    nas = [("nas", n, d) for n, d in zip(names, data)]
    first = summary(run(spark, files + nas[:2], "Quick", (SSD, NAS)), "Quick")
    assert (first["total_files"], first["fully_verified_files"], first["partially_verified_files"]) == (3, 2, 1)
    assert (first["missing_files"], first["safety_status"]) == (0, "PartiallyBackedUp")
    second = summary(run(spark, files + nas, "Quick", (SSD, NAS)), "Quick")
    assert (second["fully_verified_files"], second["safety_status"]) == (3, "SafeToFormat")


def test_full_finds_a_changed_byte_and_names_the_stage(spark):
    data = payload(256 * K.KIB, 1)
    middle = run(spark, [("card", "a.jpg", data), ("ssd", "a.jpg", flipped(data, 128 * K.KIB))], "Full")
    assert statuses(middle)["a.jpg", "ssd"] == ("Corrupt", "/ssd/a.jpg", K.REASON_FULL_CORRUPT)
    assert summary(middle, "Full")["safety_status"] == "UnsafeToFormat"
    start = run(spark, [("card", "a.jpg", data), ("ssd", "a.jpg", flipped(data, 10))], "Full")
    assert statuses(start)["a.jpg", "ssd"][2] == K.REASON_FULL_EARLY


def test_deep_finds_what_quick_misses(spark):
    data = payload(8 * K.MIB, 2)
    files = [("card", "a.mov", data), ("ssd", "a.mov", flipped(data, 4 * K.MIB))]
    assert statuses(run(spark, files, "Quick"))["a.mov", "ssd"][0] == "Verified"
    deep = verdicts(run(spark, files, "Deep")).first()
    assert (deep["status"], deep["failure_reason"]) == ("Corrupt", K.REASON_DEEP_CORRUPT)
    assert deep["dest_deep_fp"] is not None


@pytest.mark.parametrize("mode", ["Quick", "Deep", "Full"])
def test_reorganised_and_renamed(spark, mode):
    data = payload(70 * K.KIB, 3)
    files = [("card", "DCIM/100CANON/IMG_0001.CR3", data), ("ssd", "2026/09/08/smith.CR3", data)]
    assert statuses(run(spark, files, mode))["DCIM/100CANON/IMG_0001.CR3", "ssd"][:2] == (
        "Verified", "/ssd/2026/09/08/smith.CR3",
    )


def test_affinity_prefers_path_then_name_then_order(spark):
    data, other = payload(5000, 4), payload(5000, 5)
    files = [("card", "p/D.ARW", data), ("ssd", "A.ARW", other), ("ssd", "B.ARW", data), ("ssd", "q/d.arw", data)]
    assert statuses(run(spark, files, "Deep"))["p/D.ARW", "ssd"][1] == "/ssd/q/d.arw"
    files.append(("ssd", "P/d.ARW", data))
    assert statuses(run(spark, files, "Deep"))["p/D.ARW", "ssd"][1] == "/ssd/P/d.ARW"


def test_wrong_file_at_the_path_does_not_hide_a_match(spark):
    data = payload(3000, 6)
    files = [("card", "a.jpg", data), ("ssd", "a.jpg", flipped(data, 0)), ("ssd", "z/b.jpg", data)]
    for mode in ("Quick", "Deep", "Full"):
        assert statuses(run(spark, files, mode))["a.jpg", "ssd"][:2] == ("Verified", "/ssd/z/b.jpg")


def test_superfast_rules(spark):
    one, two = payload(100, 7), payload(100, 8)
    only = [("card", "a.jpg", one), ("ssd", "other.jpg", two)]
    assert statuses(run(spark, only, "SuperFast"))["a.jpg", "ssd"][0] == "Verified"
    many = only + [("ssd", "third.jpg", two)]
    assert statuses(run(spark, many, "SuperFast"))["a.jpg", "ssd"] == ("Missing", None, K.REASON_AMBIGUOUS)
    named = many + [("ssd", "x/A.JPG", two)]
    assert statuses(run(spark, named, "SuperFast"))["a.jpg", "ssd"][1] == "/ssd/x/A.JPG"
    none = [("card", "a.jpg", one), ("ssd", "a.jpg", one + b"x")]
    assert statuses(run(spark, none, "SuperFast"))["a.jpg", "ssd"] == ("Missing", None, K.REASON_NO_SIZE)


def test_missing_reasons(spark):
    files = [("card", "a.jpg", payload(500, 9)), ("ssd", "b.jpg", payload(500, 10))]
    for mode, reason in [("Quick", K.REASON_QUICK_MISSING), ("Deep", K.REASON_DEEP_MISSING), ("Full", K.REASON_FULL_MISSING)]:
        assert statuses(run(spark, files, mode))["a.jpg", "ssd"] == ("Missing", None, reason)


def test_never_partial_when_something_is_missing(spark):
    data = [payload(512, s) for s in (11, 12, 13)]
    files = [("card", f"{i}.jpg", d) for i, d in enumerate(data)] + [("ssd", "0.jpg", data[0])]
    row = summary(run(spark, files, "Quick"), "Quick")
    assert (row["fully_verified_files"], row["missing_files"], row["safety_status"]) == (1, 2, "UnsafeToFormat")


def test_four_statuses_and_their_report_figures(spark):
    data = [payload(256 * K.KIB, s) for s in range(20, 24)]
    files = [("card", f"{i}.jpg", d) for i, d in enumerate(data)]
    files += [("ssd", "0.jpg", data[0]), ("nas", "0.jpg", data[0])]
    files += [("ssd", "1.jpg", data[1]), ("nas", "1.jpg", flipped(data[1], 128 * K.KIB)), ("ssd", "2.jpg", data[2])]
    results = run(spark, files, "Full", (SSD, NAS))
    got = {r["relative_path"]: r["overall_status"] for r in results.collect()}
    assert got == {"0.jpg": "Verified", "1.jpg": "Corrupt", "2.jpg": "Partial", "3.jpg": "Missing"}
    row = summary(results, "Full")
    assert [row[c] for c in ("fully_verified_files", "partially_verified_files", "missing_files", "corrupt_files")] == [1] * 4
    per = {r["dest_id"]: (r["verified"], r["missing"], r["corrupt"]) for r in status_by_destination(results).collect()}
    assert per == {"ssd": (3, 1, 0), "nas": (1, 2, 1)}
    assert protection(summarize(results, "Full")).first()["banner"] == "UNSAFE TO FORMAT - 50% BACKED UP (2 UNPROTECTED)"
    assert [r["relative_path"] for r in with_tab(results, "Missing").collect()] == ["3.jpg"]
    assert [r["relative_path"] for r in with_tab(results, "All", " 2.JP ").collect()] == ["2.jpg"]


def test_empty_source_is_never_safe(spark):
    results = run(spark, [("ssd", "a.jpg", b"x")], "Quick")
    assert summary(results, "Quick")["safety_status"] == "NoMediaFound"


def test_destination_list(spark):
    with pytest.raises(ValueError):
        enabled([Destination("nas"), Destination("NAS")])
    assert enabled([Destination("nas"), Destination("NAS", is_enabled=False)]) == [Destination("nas")]
    none = run(spark, [("card", "a.jpg", b"x"), ("ssd", "a.jpg", b"x")], "Quick", (Destination("ssd", is_enabled=False),))
    assert none.first()["overall_status"] == "Missing"


def test_unreadable_files(spark):
    files = [("card", "a.jpg", b"abc"), ("ssd", "a.jpg", b"abc"), ("card", "b.jpg", b"abcd"), ("ssd", "b.jpg", b"abcd")]
    source, backups = split(prints(spark, files, "Quick"))

    def broken(df, path):
        hit = F.col("relative_path") == path
        return df.select(*[
            (F.when(hit, "gone").otherwise(F.col(c)) if c == "error" else F.when(~hit, F.col(c)) if c.endswith("_fp")
             else F.col(c)).alias(c) for c in df.columns
        ])

    results = match(broken(source, "a.jpg"), broken(backups, "b.jpg"), [SSD], "Quick")
    got = statuses(results)
    assert got["a.jpg", "ssd"] == ("Corrupt", None, "I/O Error: gone")
    assert got["b.jpg", "ssd"] == ("Corrupt", "/ssd/b.jpg", "I/O Error: gone")


def test_status_truth_table(spark):
    cases = {
        "VV": "Verified", "VM": "Partial", "MM": "Missing", "P": "Missing", "": "Missing", "CC": "Corrupt",
        "VC": "Corrupt", "CM": "Corrupt",
    }
    names = {"V": "Verified", "M": "Missing", "C": "Corrupt", "P": "Pending"}
    rows = [(k or "none", names[c]) for k in cases for c in k] + [("none", None)]
    df = spark.createDataFrame(rows, "file string, status string")
    got = {r["file"]: r["overall_status"] for r in fold_verdicts(df, ["file"]).collect()}
    assert got == {k or "none": v for k, v in cases.items()}


def _hot_files(seed):
    """Few lengths, names and contents, so keys collide heavily; one content makes up most files."""
    rng = random.Random(seed)
    contents = [payload(50, 1), payload(50, 2), payload(40, 3), b""]
    names = ["a.jpg", "A.jpg", "b.jpg", "c.jpg", "_x.jpg"]
    files = set()
    for root in ("card", "ssd", "nas"):
        for _ in range(60):
            files.add((root, f"d{rng.randrange(6)}/" + rng.choice(names)))
    return [(r, p, contents[0] if rng.random() < 0.6 else rng.choice(contents)) for r, p in sorted(files)]


@pytest.mark.parametrize("mode", ["SuperFast", "Quick", "Full"])
@pytest.mark.parametrize("hot_rows", [1, 5, 1_000_000])
def test_join_form_equals_ranked_candidates_with_hot_keys(spark, mode, hot_rows):
    files = _hot_files(hot_rows)
    got = statuses(run(spark, files, mode, (SSD, NAS), hot_rows=hot_rows))
    body = {(r, p): b for r, p, b in files}
    for (path, dest), (status, matched, _) in got.items():
        mine = body["card", path]
        candidates = sorted((p for r, p in body if r == dest and len(body[r, p]) == len(mine)), key=lambda p: (p.upper(), p))
        ranked = sorted(
            candidates,
            key=lambda p: (p.upper() != path.upper(), p.split("/")[-1].upper() != path.split("/")[-1].upper()),
        )
        if mode == "SuperFast":
            named = [p for p in ranked if p.split("/")[-1].upper() == path.split("/")[-1].upper()]
            best = named[0] if named else ranked[0] if len(ranked) == 1 else None
        else:
            best = next((p for p in ranked if body[dest, p] == mine), None)
        if best is not None:
            assert (status, matched) == ("Verified", f"/{dest}/{best}")
        else:
            assert status == ("Corrupt" if ranked and ranked[0].upper() == path.upper() and mode != "SuperFast" else "Missing")


def test_an_unreadable_candidate_elsewhere_is_not_missing(spark):
    files = [("card", "a.jpg", b"abc"), ("ssd", "x/b.jpg", b"abd"), ("ssd", "x/c.jpg", b"xyz"), ("nas", "a.jpg", b"abc")]
    source, backups = split(prints(spark, files, "Quick"))
    lost = F.col("relative_path") == "x/c.jpg"
    backups = backups.select(*[
        (F.when(lost, "gone").otherwise(F.col(c)) if c == "error" else F.when(~lost, F.col(c)) if c.endswith("_fp")
         else F.col(c)).alias(c) for c in backups.columns
    ])
    got = statuses(match(source, backups, [SSD, NAS], "Quick"))
    assert got["a.jpg", "ssd"] == ("Corrupt", None, "I/O Error: gone")
    assert got["a.jpg", "nas"] == ("Verified", "/nas/a.jpg", None)


def test_prepared_candidates_serve_several_sources_without_sorted_aggregates(spark):
    files = _hot_files(3)
    source, backups = split(prints(spark, files, "Full"))
    prepared = candidates(backups, [SSD, NAS], "Full", keep=True)
    whole = match(source, backups, [SSD, NAS], "Full")
    assert "SortAggregate" not in whole._jdf.queryExecution().executedPlan().toString()
    halves = [source.where(F.col("relative_path").startswith("d1")), source.where(~F.col("relative_path").startswith("d1"))]
    parts = {}
    for half in halves:
        parts |= statuses(match(half, None, [], "Full", prepared=prepared))
    assert parts == statuses(whole)

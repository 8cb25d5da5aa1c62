"""The set-based copy plan and space rule against a plain sequential walk."""

import random
import re

import pytest
from pyspark.sql import functions as F

from mirrorledger.operators import copying
from mirrorledger.operators.copying import copy_plan, copy_result_counts, copy_targets
from mirrorledger.operators.inventory import Destination
from mirrorledger.operators.space import left_out
from mirrorledger.workspace import materialise


def walk_space(rows, free):
    """rows: (dest, path, length)."""
    out, left, full = set(), dict(free), dict.fromkeys(free, False)
    for dest, path, size in sorted(rows, key=lambda r: (r[1].upper(), r[1])):
        if left[dest] is None:
            continue
        fits = size < left[dest] if full[dest] else size <= left[dest]
        if fits:
            left[dest] -= size
        else:
            full[dest] = True
            out.add((dest, path))
    return out


@pytest.mark.parametrize("finish_rows", [0, 5, 100_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_space_rule_equals_sequential_walk(spark, finish_rows, seed):
    rng = random.Random(seed)
    rows = []
    for dest in ["a", "b", "c", "d"]:
        for i in range(60):
            size = rng.choice([0, 1, 2, 7, 50, 64, 100, 333, 1000, rng.randrange(2000)])
            rows.append((dest, f"f{rng.randrange(10**6):06d}_{i}.jpg", size))
    free = {"a": 3000, "b": 0, "c": None, "d": 17}
    df = spark.createDataFrame(rows, "dest_id string, relative_path string, file_length long").withColumn(
        "path_key", F.upper("relative_path")
    )
    got = {tuple(r) for r in left_out(df, free, finish_rows=finish_rows, partitions=3).collect()}
    assert got == walk_space(rows, free)


def sibling(path):
    m = re.match(r"^(.*/)?([^/]*)_([0-9]+)(\.[^./]*)?$", path)
    return None if m is None else (m.group(1) or "") + m.group(2) + (m.group(4) or "")


def numbered(path, n):
    m = re.match(r"^(.*/)?([^/]*?)(\.[^./]*)?$", path)
    return (m.group(1) or "") + m.group(2) + f"_{n}" + (m.group(3) or "")


def key_of(path):
    folder, _, name = path.rpartition("/")
    return folder, name.upper()


def walk_plan(source, held, free):
    """source: {path: (len, head, tail)}; held: {path: content or None for a folder}. One destination."""
    held, plan, left, full = dict(held), {}, free, False
    for path in sorted(source, key=lambda p: (p.upper(), p)):
        content = source[path]
        if held.get(path) == content:
            plan[path] = ("SKIP_PATH", None)
            continue
        occupied = path in held
        if occupied and any(
            c == content and sibling(p) is not None and key_of(sibling(p)) == key_of(path) for p, c in held.items()
        ):
            plan[path] = ("SKIP_SIBLING", None)
            continue
        if left is not None and not (content[0] < left if full else content[0] <= left):
            full = True
            plan[path] = ("NO_SPACE", None)
            continue
        target, n = path, 0
        while target in held:
            n += 1
            target = numbered(path, n)
        held[target] = content
        left = None if left is None else left - content[0]
        plan[path] = ("WRITE_RENAMED" if occupied else "WRITE", target)
    return plan


def run_plan(spark, source, held, free, finish_rows=100_000):
    files = spark.createDataFrame(
        [(p, "/src/" + p, *c) for p, c in source.items()],
        "relative_path string, full_path string, file_length long, head_fp string, tail_fp string",
    )
    inventory = spark.createDataFrame(
        [("d", p, *c) for p, c in held.items() if c is not None],
        "root_id string, relative_path string, file_length long, head_fp string, tail_fp string",
    )
    plan = copy_plan(files, inventory, [Destination("d", free_bytes=free)], finish_rows=finish_rows)
    return {r["relative_path"]: (r["action"], r["target_path"]) for r in plan.collect()}


A, B, C = (300, "a", "a"), (200, "b", "b"), (100, "c", "c")


def test_plan_cases(spark):
    # Occupied path: renamed; again: the sibling holds it; a gap in the numbers does not hide it.
    assert run_plan(spark, {"x/I.CR3": A}, {"x/I.CR3": B}, None) == {"x/I.CR3": ("WRITE_RENAMED", "x/I_1.CR3")}
    assert run_plan(spark, {"I.CR3": A}, {"I.CR3": B, "I_1.CR3": A}, None) == {"I.CR3": ("SKIP_SIBLING", None)}
    assert run_plan(spark, {"I.CR3": A}, {"I.CR3": B, "I_2.CR3": A}, None) == {"I.CR3": ("SKIP_SIBLING", None)}
    assert run_plan(spark, {"I.CR3": A}, {"I.CR3": B, "I_2.CR3": C}, None) == {"I.CR3": ("WRITE_RENAMED", "I_1.CR3")}
    assert run_plan(spark, {"I.CR3": A}, {"I.CR3": A}, 0) == {"I.CR3": ("SKIP_PATH", None)}
    # A folder occupies a name too.
    assert run_plan(spark, {"clip.mov": A}, {"clip.mov/a.jpg": B}, None) == {
        "clip.mov": ("WRITE_RENAMED", "clip_1.mov")
    }
    # A name taken earlier in the batch pushes its owner on.
    assert run_plan(spark, {"I.CR3": A, "I_1.CR3": B}, {"I.CR3": C}, None) == {
        "I.CR3": ("WRITE_RENAMED", "I_1.CR3"),
        "I_1.CR3": ("WRITE_RENAMED", "I_1_1.CR3"),
    }
    assert run_plan(spark, {"I.CR3": A, "I_1.CR3": A}, {"I.CR3": C}, None) == {
        "I.CR3": ("WRITE_RENAMED", "I_1.CR3"),
        "I_1.CR3": ("SKIP_PATH", None),
    }


def test_batch_of_six_collisions(spark):
    old, new = (40960, "o", "o"), (49152, "n", "n")
    names = [f"IMG_{i:04d}.CR3" for i in range(1, 7)]
    held = {n: old for n in names} | {"IMG_0003_1.CR3": new}
    files = spark.createDataFrame(
        [(n, "/src/" + n, *new) for n in names],
        "relative_path string, full_path string, file_length long, head_fp string, tail_fp string",
    )
    inventory = spark.createDataFrame(
        [("d", p, *c) for p, c in held.items()],
        "root_id string, relative_path string, file_length long, head_fp string, tail_fp string",
    )
    plan = copy_plan(files, inventory, [Destination("d")])
    counts = copy_result_counts(plan).first()
    assert (counts["copied_files"], counts["skipped_files"], counts["failed_files"], counts["renamed_copies"]) == (
        5, 1, 0, 5,
    )


@pytest.mark.parametrize("seed", range(4))
def test_plan_equals_sequential_walk(spark, seed):
    rng = random.Random(seed)
    names = ["I.jpg", "I_1.jpg", "I_2.jpg", "I_1_1.jpg", "I_3.jpg", "i.jpg", "I_02.jpg", "J.jpg", "J_1.jpg", "K"]
    names = [d + n for d in ("", "p/", "p/q/") for n in names]
    contents = [A, B, C, (0, "e", "e")]
    source = {n: rng.choice(contents) for n in names if rng.random() < 0.7}
    held = {n: rng.choice(contents) for n in names if rng.random() < 0.5}
    free = rng.choice([None, 0, 900, 1500])
    folders = {"p": None, "p/q": None} if any(n.startswith("p/q/") for n in held) else {}
    assert run_plan(spark, source, held, free, finish_rows=rng.choice([0, 100])) == walk_plan(
        source, held | folders, free
    )


@pytest.mark.parametrize("free", [None, 1500])
def test_only_files_behind_a_moved_name_are_planned_again(spark, monkeypatch, free):
    counts = []

    def counted(df, name):
        table, n = materialise(df, name)
        if name == "copy-affected":
            counts.append(n)
        return table, n

    monkeypatch.setattr(copying, "materialise", counted)
    chain = {"p/I.CR3": A, "p/I_1.CR3": B, "p/I_1_1.CR3": C, "p/I_1_1_1.CR3": A}
    source = {f"p/IMG_{k:04}.CR3": (1, str(k), str(k)) for k in range(300)} | chain
    held = {"p/I.CR3": C, "p/IMG_0005.CR3": C}
    assert run_plan(spark, source, held, free) == walk_plan(source, held, free)
    assert counts == [1, 1, 1, 0]


def test_copy_targets():
    assert copy_targets(["/a", "", "  ", "/A", "/b"]) == ["/a", "/b"]

"""Inventories of directory trees on mounted storage.

:func:`scan` walks all roots level by level: each level is a Spark job over the folders found so far, spread evenly, so
one deep or crowded subtree does not end up in one task and no listing passes through the driver. ``spark.read
.format("file_inventory")`` offers the same rows as a data source for plain reads: its planning opens folders until there are
enough to deal out evenly, whatever the shape of the tree, and its tasks send Arrow batches.

Rules: hidden entries, symbolic links to folders, ignored folders and unreadable folders are left out; files without an
extension or outside the preset too. A folder that is one of the folders around it (a mount of a tree inside itself) is not
entered again; the task that lists it compares device and inode, which differ between machines and so are never compared
across tasks. Two spellings of one root are walked as one path each. A missing root is an empty inventory.
"""

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as K
from ..functions.media import category_of, in_preset
from ..functions.paths import extension
from ..workspace import materialise

_ENTRY = "root_id string, root_path string, folder string, name string, is_folder boolean, file_length long, mtime_micros long"
_ARROW = pa.schema(
    [(n, {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}[t]) for n, t in (c.split() for c in _ENTRY.split(", "))]
)
BATCH_ROWS = 10_000
PARTITIONS = 200  # that the data source plans, if its option doesn't say
FOLDERS_A_TASK = 4  # so that small and large ones even out
_IGNORED = re.compile(
    r"(?i)\s*|" + "|".join(re.escape(n) for n in K.IGNORED_DIRECTORY_NAMES)
    + "|" + re.escape(K.IGNORED_DIRECTORY_PREFIX) + ".*|.*(?:"
    + "|".join(re.escape(s) for s in K.IGNORED_DIRECTORY_SUFFIXES) + ")",
    re.DOTALL,
)


def is_ignored_folder(name: str) -> bool:
    return _IGNORED.fullmatch(name) is not None


def canonical_root(path: str) -> str:
    """Absolute, without ``.``, ``..``, repeated or trailing separators."""
    return "/" + os.path.abspath(path).lstrip("/")


def _around(path: str, root: str) -> set[tuple[int, int]]:
    """Device and inode of a folder and of those around it, up to the root."""
    found = set()
    while True:
        stat = os.stat(path)
        found.add((stat.st_dev, stat.st_ino))
        if path == root or len(path) <= len(root):
            return found
        path = os.path.dirname(path)


def list_folder(path: str, root: str | None = None) -> Iterator[tuple[str, bool, int, int]]:
    """``(name, is_folder, length, mtime in microseconds)`` of the entries that count; nothing when the folder cannot be read."""
    try:
        entries = os.scandir(path)
    except OSError:
        return
    with entries:
        yield from _counting(entries, path, root or path)


def _entries(entries: Iterator[os.DirEntry]) -> Iterator[os.DirEntry]:
    """Ends where the folder can't be read on."""
    while True:
        try:
            entry = next(entries, None)
        except OSError:
            return
        if entry is None:
            return
        yield entry


def _counting(entries: Iterator[os.DirEntry], path: str, root: str) -> Iterator[tuple[str, bool, int, int]]:
    around = None
    for entry in _entries(entries):
        if entry.name.startswith("."):
            continue
        try:
            if entry.is_dir(follow_symlinks=True):
                if not entry.is_symlink() and not is_ignored_folder(entry.name):
                    around = around or _around(path, root)
                    stat = entry.stat()
                    if (stat.st_dev, stat.st_ino) not in around:
                        yield entry.name, True, 0, 0
            elif "." in entry.name:
                stat = entry.stat()
                yield entry.name, False, stat.st_size, stat.st_mtime_ns // 1000
        except OSError:
            continue


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_ENTRY`` in batches, so that a crowded folder is never held whole."""
    rows = iter(rows)
    while some := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _ARROW.types, strict=True)], schema=_ARROW)


def _list_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for root_id, root_path, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(root_path, folder) if folder else root_path
                for entry in list_folder(path, root_path):
                    yield root_id, root_path, folder, *entry

    return _batches(rows())


def scan(
    spark: SparkSession, roots: dict[str, str], preset: str | None = None, *, parallelism: int | None = None
) -> DataFrame:
    """Inventory of ``{root_id: root_path}``. ``preset`` None keeps every file that has an extension."""
    tasks = parallelism or spark.sparkContext.defaultParallelism * 4
    known = [(i, canonical_root(p), "") for i, p in roots.items() if p and p.strip()]
    folders = spark.createDataFrame(known, "root_id string, root_path string, folder string")
    count, levels = len(known), []
    while count:
        listing = folders.repartition(min(count, tasks)).mapInArrow(_list_level, _ENTRY)
        level, _ = materialise(listing, "listing")
        levels.append(level.where("NOT is_folder"))
        folders = level.where("is_folder").select(
            "root_id", "root_path", F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "name").alias("folder")
        )
        count = folders.count()
    if not levels:
        levels = [spark.createDataFrame([], _ENTRY)]
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return _as_inventory(files, preset)


def _as_inventory(files: DataFrame, preset: str | None) -> DataFrame:
    relative = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "name")
    return files.where(in_preset(extension(F.col("name")), preset)).select(
        "root_id",
        relative.alias("relative_path"),
        F.concat_ws("/", F.rtrim(F.col("root_path"), F.lit("/")), relative).alias("full_path"),
        "file_length",
        F.timestamp_micros("mtime_micros").alias("mtime"),
        category_of(extension(F.col("name"))).alias("category"),
    )


class FileInventory(DataSource):
    """``spark.read.format("file_inventory").option("path", root).option("root_id", id).load()``

    ``partitions``: how many tasks to plan for at most (200). ``extensions``: comma-separated; files of others are left out
    where they are listed.
    """

    @classmethod
    def name(cls):
        return "file_inventory"

    def schema(self):
        return _ENTRY

    def reader(self, schema):
        listed = self.options.get("extensions")
        return _InventoryReader(
            self.options.get("root_id", "root"),
            self.options["path"],
            int(self.options.get("partitions", PARTITIONS)),
            None if listed is None else frozenset(listed.lower().split(",")),
        )


def plan_folders(root_path: str, partitions: int) -> list[list[tuple[str, bool]]]:
    """Deals a tree's folders to tasks as lists of (folder, with all below it or alone).

    Levels are opened until they hold ``FOLDERS_A_TASK`` folders for each task, or nothing is left to open. A level is only
    opened while it holds fewer, which bounds the folders that planning lists.
    """
    alone, level = [], [""]
    while level and len(level) < FOLDERS_A_TASK * partitions:
        alone += [(folder, False) for folder in level]
        level = [
            f"{folder}/{name}" if folder else name
            for folder in level
            for name, is_folder, _, _ in list_folder(os.path.join(root_path, folder) if folder else root_path, root_path)
            if is_folder
        ]
    work = [(folder, True) for folder in sorted(level)] + alone
    return [work[k::partitions] for k in range(min(partitions, len(work)))]


class _InventoryReader(DataSourceReader):
    def __init__(self, root_id: str, root_path: str, partitions: int, extensions: frozenset[str] | None):
        self.root_id, self.root_path = root_id, canonical_root(root_path)
        self.wanted, self.extensions = max(1, partitions), extensions

    def partitions(self):
        return [InputPartition(work) for work in plan_folders(self.root_path, self.wanted)]

    def read(self, partition):
        return _batches(self._rows(partition.value))

    def _rows(self, work: list[tuple[str, bool]]) -> Iterator[tuple]:
        for start, recurse in work:
            pending = [start]
            while pending:
                folder = pending.pop()
                path = os.path.join(self.root_path, folder) if folder else self.root_path
                for name, is_folder, length, mtime in list_folder(path, self.root_path):
                    if not is_folder:
                        if self.extensions is None or name[name.rfind(".") :].lower() in self.extensions:
                            yield self.root_id, self.root_path, folder, name, False, length, mtime
                    elif recurse:
                        pending.append(f"{folder}/{name}" if folder else name)


def read_inventory(
    spark: SparkSession, root_id: str, path: str, preset: str | None = None, *, partitions: int | None = None
) -> DataFrame:
    spark.dataSource.register(FileInventory)
    tasks = partitions or spark.sparkContext.defaultParallelism * 4
    files = spark.read.format("file_inventory").option("root_id", root_id).option("path", path).option("partitions", tasks)
    if preset is not None:
        files = files.option("extensions", ",".join(K.PRESETS[preset]))
    return _as_inventory(files.load(), preset)


def _write_file(path: str, content: bytes, mtime_micros: int | None) -> None:
    """A name that nothing has is created exclusively and written in place: one change of the folder, which all tasks that
    write into it wait for. Where something has it, an earlier attempt perhaps, a whole file takes its place."""
    target = path
    try:
        out = open(path, "xb")
    except FileExistsError:
        target = f"{path}.{os.getpid()}.part"
        out = open(target, "wb")
    try:
        with out:
            out.write(content)
            if mtime_micros is not None:
                out.flush()
                os.utime(out.fileno(), ns=(mtime_micros * 1000, mtime_micros * 1000))
    except OSError:
        os.unlink(target)
        raise
    if target != path:
        os.replace(target, path)


def write_tree(inventory: DataFrame) -> DataFrame:
    """Write rows that carry ``content`` as files at their ``full_path``; returns one row per file with any error.

    Lazy like any transformation; a repeated task replaces what it finds by the same bytes.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            paths, errors = batch.column("full_path"), []
            for path, content, mtime in zip(paths.to_pylist(), *(batch.column(c) for c in ("content", "mtime_micros")), strict=True):
                try:
                    folder = os.path.dirname(path)
                    if folder not in made:
                        os.makedirs(folder, exist_ok=True)
                        made.add(folder)
                    _write_file(path, content.as_py(), mtime.as_py())
                    errors.append(None)
                except OSError as error:
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([paths, pa.array(errors, pa.string())], names=["full_path", "error"])

    rows = inventory.select("full_path", "content", F.unix_micros("mtime").alias("mtime_micros"))
    return rows.mapInArrow(write, "full_path string, error string")

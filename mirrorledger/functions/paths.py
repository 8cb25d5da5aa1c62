"""Path expressions. Paths use ``/``; comparisons ignore case through :func:`fold`."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    IGNORED_DIRECTORY_NAMES,
    IGNORED_DIRECTORY_PREFIX,
    IGNORED_DIRECTORY_SUFFIXES,
    OVERLAP_INSIDE_MESSAGE,
    OVERLAP_SAME_MESSAGE,
)


def fold(text: Column) -> Column:
    """Upper-case character by character: ``ß`` stays itself, while plain ``upper`` would turn it into ``SS``.

    Upper-casing never shortens a text, so equal lengths mean every character mapped to one character; only the
    rare other texts take the per-character branch.
    """
    whole = F.upper(text)
    per_char = F.array_join(
        F.transform(F.split(text, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), ""
    )
    return F.when(F.length(whole) == F.length(text), whole).otherwise(per_char)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Everything before the last ``/``; empty for a file in the root."""
    inside = F.length(path) - F.length(file_name(path)) - 1
    return F.when(inside > 0, F.substring(path, F.lit(1), inside)).when(path.isNotNull(), "")


def extension(path: Column) -> Column:
    """Text from the last dot of the file name, dot included; empty when there is no dot."""
    name = file_name(path)
    return F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*\z", "")


def relative_path(full_path: Column, root: Column) -> Column:
    """Path below ``root`` with ``/`` separators, whichever separator the input uses."""
    full = F.translate(full_path, "\\", "/")
    base = F.rtrim(F.translate(root, "\\", "/"), F.lit("/"))
    return F.substring(full, F.length(base) + 2, F.length(full))


def sibling_of(path: Column) -> Column:
    """``dir/stem.ext`` when the name is ``stem_N.ext`` with N all ASCII digits, else null."""
    pattern = r"(?s)\A(.*/)?([^/]*)_([0-9]+)(\.[^./]*)?\z"
    found = path.rlike(pattern)
    return F.when(
        found,
        F.concat(
            F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2), F.regexp_extract(path, pattern, 4)
        ),
    )


def sibling_number(path: Column) -> Column:
    """N of ``stem_N.ext`` when written the way the copier writes it (1..10000, no leading zero), else null."""
    digits = F.regexp_extract(path, r"_([1-9][0-9]{0,4})(?:\.[^./]*)?\z", 1)
    number = F.when(digits != "", digits.cast("int"))
    return F.when(number <= 10_000, number)


def numbered_sibling(path: Column, number: Column) -> Column:
    """``dir/stem.ext`` and N give ``dir/stem_N.ext``."""
    pattern = r"(?s)\A(.*/)?([^/]*?)(\.[^./]*)?\z"
    return F.concat(
        F.regexp_extract(path, pattern, 1),
        F.regexp_extract(path, pattern, 2),
        F.lit("_"),
        number.cast("string"),
        F.regexp_extract(path, pattern, 3),
    )


def is_ignored_directory(name: Column) -> Column:
    names = "|".join(re.escape(n) for n in IGNORED_DIRECTORY_NAMES)
    suffixes = "|".join(re.escape(s) for s in IGNORED_DIRECTORY_SUFFIXES)
    pattern = rf"(?i)^(?:\s*|{names}|{re.escape(IGNORED_DIRECTORY_PREFIX)}.*|.*(?:{suffixes}))\z"
    return F.coalesce(name.rlike(pattern), F.lit(True))


def in_ignored_directory(path: Column) -> Column:
    """True when any folder on the way to the file is ignored."""
    parts = F.split(directory(path), "/")
    return (F.instr(path, "/") > 0) & F.exists(parts, is_ignored_directory)


def canonical_folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), "(?<=.)/$", "")


def same_or_under(path: Column, root: Column) -> Column:
    """Ignore-case test whether ``path`` is ``root`` or lies below it; blank paths are not."""
    p, r = fold(canonical_folder(path)), fold(canonical_folder(root))
    below = F.when(r == "/", p.startswith("/")).otherwise(p.startswith(F.concat(r, F.lit("/"))))
    return F.coalesce((F.trim(path) != "") & ((p == r) | below), F.lit(False))


def overlap_error(source: Column, destination: Column) -> Column:
    """Why a destination may not be used with a source; null when it may. Blank paths are not judged."""
    s, d = fold(canonical_folder(source)), fold(canonical_folder(destination))
    blank = (F.trim(F.coalesce(source, F.lit(""))) == "") | (F.trim(F.coalesce(destination, F.lit(""))) == "")
    inside = F.when(s == "/", d.startswith("/")).otherwise(d.startswith(F.concat(s, F.lit("/"))))
    return F.when(blank, None).when(s == d, OVERLAP_SAME_MESSAGE).when(inside, OVERLAP_INSIDE_MESSAGE)

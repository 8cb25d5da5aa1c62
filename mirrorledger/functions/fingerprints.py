"""Fingerprint columns over binary content, and their text forms.

A fingerprint is a lower-case hex string. ``md5`` (128 bits) is the default; ``xxhash64`` trades collision margin for
speed. The file jobs in :mod:`mirrorledger.sources.ranges` produce the same values from disk.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

@dataclass(frozen=True)
class ProbeTiers:
    """Sizes of the sampled (deep) fingerprint. Defaults are for media files; texts need smaller ones."""

    edge: int = K.HEAD_TAIL_BYTES
    tier1_max: int = K.TIER1_MAX_BYTES
    tier2_max: int = K.TIER2_MAX_BYTES
    tier2_slice: int = K.TIER2_SLICE_BYTES
    tier3_slice: int = K.TIER3_SLICE_BYTES
    tier2_positions: tuple = field(default_factory=lambda: tuple(K.TIER2_POSITIONS))
    tier3_positions: tuple = field(default_factory=lambda: tuple(K.TIER3_POSITIONS))


def digest(data: Column, algorithm: str = "md5") -> Column:
    if algorithm == "md5":
        return F.md5(data)
    if algorithm == "xxhash64":
        return F.lower(F.lpad(F.hex(F.xxhash64(data)), 16, "0"))
    raise ValueError(f"unknown fingerprint algorithm: {algorithm}")


def _bytes(content: Column, start: Column, length: Column) -> Column:
    return F.substring(content, start.cast("int"), length.cast("int"))


def head(content: Column, length: Column, chunk: int = K.HEAD_TAIL_BYTES, algorithm: str = "md5") -> Column:
    return digest(_bytes(content, F.lit(1), F.lit(chunk)), algorithm)


def tail(content: Column, length: Column, chunk: int = K.HEAD_TAIL_BYTES, algorithm: str = "md5") -> Column:
    return digest(_bytes(content, F.greatest(length - chunk + 1, F.lit(1)), F.lit(chunk)), algorithm)


def full(content: Column, length: Column, algorithm: str = "md5") -> Column:
    """The plain digest of all bytes, whatever their number, so it can be held against any other tool's."""
    return digest(content, algorithm)


def _concat(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(b""), lambda acc, piece: F.concat(acc, piece))


def probe_plan(length: Column, tiers: ProbeTiers = ProbeTiers()) -> Column:
    """``ARRAY<STRUCT<offset, length>>``: the byte ranges the sampled fingerprint reads from a file of this length."""
    length = length.cast("bigint")
    edge = F.lit(tiers.edge).cast("bigint")

    def piece(offset, size):
        return F.struct(offset.cast("bigint").alias("offset"), size.cast("bigint").alias("length"))

    def interior(positions, size):
        slices = []
        for position in positions:
            wanted = F.floor(length * F.lit(float(position))) - size // 2
            offset = F.least(F.greatest(wanted, edge), F.greatest(edge, length - tiers.edge - size))
            room = F.greatest(F.lit(0), length - offset - tiers.edge)
            slices.append(piece(offset, F.least(F.lit(size), room)))
        return slices

    tail_offset = F.greatest(edge, length - tiers.edge)
    tail_piece = piece(tail_offset, F.least(edge, length - tail_offset))
    # A slice counts only when it has bytes and starts after the last accepted one, hence a fold.
    def accept(plan, nxt):
        ahead = nxt["offset"] > F.element_at(plan, -1)["offset"]
        return F.when((nxt["length"] > 0) & ahead, F.concat(plan, F.array(nxt))).otherwise(plan)

    def sampled(positions, size):
        first = F.array(piece(F.lit(0), F.least(edge, length)))
        return F.aggregate(F.array(*interior(positions, size), tail_piece), first, accept)

    return (
        F.when(length <= tiers.tier1_max, F.array(piece(F.lit(0), length)))
        .when(length <= tiers.tier2_max, sampled(tiers.tier2_positions, tiers.tier2_slice))
        .otherwise(sampled(tiers.tier3_positions, tiers.tier3_slice))
    )


def deep(content: Column, length: Column, tiers: ProbeTiers = ProbeTiers(), algorithm: str = "md5") -> Column:
    """Digest of the planned slices in order; content within the first tier is digested whole."""
    pieces = F.transform(probe_plan(length, tiers), lambda s: _bytes(content, s["offset"] + 1, s["length"]))
    return F.when(length <= tiers.tier1_max, digest(content, algorithm)).otherwise(digest(_concat(pieces), algorithm))


def as_hex(fingerprint: Column) -> Column:
    """``0x`` and 16 upper-case hex digits (the leading 64 bits); empty for null."""
    return F.coalesce(F.concat(F.lit("0x"), F.upper(F.substring(fingerprint, 1, 16))), F.lit(""))


def as_hex64(value: Column) -> Column:
    """The same text form for a 64-bit number."""
    return F.coalesce(F.concat(F.lit("0x"), F.lpad(F.hex(value), 16, "0")), F.lit(""))


def parse_hex(text: Column) -> Column:
    """Read a hash written as ``0x...`` (or as a plain unsigned number) into its upper-case 16-digit form.

    Null when the text is neither, so a caller can route bad rows to a reject set.
    """
    hex_digits = F.regexp_extract(text, "^0[xX]0*([0-9A-Fa-f]{1,16})$", 1)
    number = F.regexp_extract(text, "^([0-9]{1,20})$", 1)
    in_range = number.cast("decimal(20,0)") <= F.lit("18446744073709551615").cast("decimal(20,0)")
    return F.when(hex_digits != "", F.lpad(F.upper(hex_digits), 16, "0")).when(
        (number != "") & in_range, F.lpad(F.conv(number, 10, 16), 16, "0")
    )

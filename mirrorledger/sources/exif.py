"""Camera metadata and embedded thumbnails over a whole inventory.

Only the first 256 KiB of a file are parsed; anything unreadable or malformed gives an empty record. The parser returns
plain numbers and texts; the display texts are column expressions.
"""

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.constants import EXIF_HEAD_BYTES

# --- fixed values: TIFF/EXIF tag numbers ---
MAKE, MODEL, DATE_TIME = 0x010F, 0x0110, 0x0132
IMAGE_WIDTH, IMAGE_HEIGHT = 0x0100, 0x0101
THUMB_OFFSET, THUMB_LENGTH = 0x0201, 0x0202
EXIF_IFD = 0x8769
EXPOSURE_TIME, F_NUMBER, ISO, DATE_TIME_ORIGINAL = 0x829A, 0x829D, 0x8827, 0x9003
FOCAL_LENGTH, PIXEL_WIDTH, PIXEL_HEIGHT, LENS_MODEL = 0x920A, 0xA002, 0xA003, 0xA434
SHORT = 3
# --- end of fixed values ---

FIELDS = {
    "has_exif": "boolean",
    "camera_make": "string",
    "camera_model": "string",
    "lens_model": "string",
    "date_time": "string",
    "width": "long",
    "height": "long",
    "iso_value": "long",
    "exposure_num": "long",
    "exposure_den": "long",
    "f_num": "long",
    "f_den": "long",
    "focal_num": "long",
    "focal_den": "long",
    "thumb_offset": "long",
    "thumb_length": "long",
}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
_TYPES = {"boolean": T.BooleanType(), "string": T.StringType(), "long": T.LongType()}
RECORD = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in FIELDS.items()])
EMPTY = {name: None for name in FIELDS} | {"has_exif": False}


class _Tiff:
    """The TIFF block inside a file head; reads outside it give zero."""

    def __init__(self, data: bytes, start: int, little: bool):
        self.data, self.start, self.order = data[start:], start, "<" if little else ">"

    def number(self, offset: int, size: int) -> int:
        piece = self.data[offset : offset + size]
        return struct.unpack(self.order + {2: "H", 4: "I"}[size], piece)[0] if len(piece) == size else 0

    def directory(self, offset: int) -> tuple[dict[int, int], int]:
        """Tag to entry position, and the offset of the next directory."""
        if offset <= 0 or offset + 2 > len(self.data):
            return {}, 0
        count = self.number(offset, 2)
        entries = {}
        for position in range(offset + 2, offset + 2 + 12 * count, 12):
            if position + 12 > len(self.data):
                break
            entries[self.number(position, 2)] = position
        return entries, self.number(offset + 2 + 12 * count, 4)

    def value(self, entries: dict[int, int], tag: int) -> int:
        at = entries.get(tag)
        return 0 if at is None else self.number(at + 8, 2 if self.number(at + 2, 2) == SHORT else 4)

    def string(self, entries: dict[int, int], tag: int) -> str | None:
        at = entries.get(tag)
        if at is None:
            return None
        count = self.number(at + 4, 4)
        offset = at + 8 if count <= 4 else self.number(at + 8, 4)
        if not 0 < count <= 512 or offset + count > len(self.data):
            return None
        raw = self.data[offset : offset + count].split(b"\0", 1)[0]
        return raw.decode("utf-8", "replace").strip() or None

    def rational(self, entries: dict[int, int], tag: int) -> tuple[int | None, int | None]:
        at = entries.get(tag)
        offset = len(self.data) if at is None else self.number(at + 8, 4)
        if offset + 8 > len(self.data):
            return None, None
        return self.number(offset, 4), self.number(offset + 4, 4)


def _locate(data: bytes) -> _Tiff | None:
    if data[:4] == b"II*\0":
        return _Tiff(data, 0, True)
    if data[:4] == b"MM\0*":
        return _Tiff(data, 0, False)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 < len(data) and data[at] == 0xFF:
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and at + 14 <= len(data):
            return _Tiff(data, at + 10, data[at + 10 : at + 12] == b"II")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def parse_head(data: bytes) -> dict:
    tiff = _locate(data) if data is not None and len(data) >= 16 else None
    if tiff is None or len(tiff.data) < 8:
        return EMPTY
    first = tiff.number(4, 4)
    if first == 0 or first + 2 > len(tiff.data):
        return EMPTY
    main, following = tiff.directory(first)
    detail, _ = tiff.directory(tiff.value(main, EXIF_IFD))
    record = dict(EMPTY, has_exif=True)
    record["camera_make"] = tiff.string(main, MAKE)
    record["camera_model"] = tiff.string(main, MODEL)
    record["lens_model"] = tiff.string(detail, LENS_MODEL)
    record["date_time"] = tiff.string(detail, DATE_TIME_ORIGINAL) or tiff.string(main, DATE_TIME)
    for name, pixel, image in [("width", PIXEL_WIDTH, IMAGE_WIDTH), ("height", PIXEL_HEIGHT, IMAGE_HEIGHT)]:
        given = [v for v in (tiff.value(detail, pixel), tiff.value(main, image)) if 0 < v < 2**31]
        record[name] = given[0] if given else 0
    record["iso_value"] = tiff.value(detail, ISO)
    record["exposure_num"], record["exposure_den"] = tiff.rational(detail, EXPOSURE_TIME)
    record["f_num"], record["f_den"] = tiff.rational(detail, F_NUMBER)
    record["focal_num"], record["focal_den"] = tiff.rational(detail, FOCAL_LENGTH)
    if len(data) >= 64:
        offset, length = tiff.value(main, THUMB_OFFSET), tiff.value(main, THUMB_LENGTH)
        if not (offset and length):
            second, _ = tiff.directory(following)
            offset = tiff.value(second, THUMB_OFFSET) or offset
            length = tiff.value(second, THUMB_LENGTH) or length
        if offset and 0 < length < 2**31:
            record["thumb_offset"], record["thumb_length"] = tiff.start + offset, length
    return record


def _parse_safely(data: bytes) -> dict:
    try:
        return parse_head(data)
    except (struct.error, ValueError, IndexError):
        return EMPTY


@F.pandas_udf(RECORD)
def _parse_column(heads: pd.Series) -> pd.DataFrame:
    frame = pd.DataFrame([_parse_safely(h) for h in heads], columns=list(FIELDS))
    return _typed(frame)


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({n: "Int64" for n, kind in FIELDS.items() if kind == "long"})


def from_content(rows: DataFrame) -> DataFrame:
    """Add the metadata of ``content``; only its head is handed to Python. The thumbnail is cut in the JVM."""
    head = F.substring("content", 1, EXIF_HEAD_BYTES)
    parsed = rows.withColumn("exif", _parse_column(head))
    inside = F.col("exif.thumb_offset") + F.col("exif.thumb_length") <= F.octet_length("content")
    thumbnail = F.when(
        inside,
        F.substring(
            F.col("content"), (F.col("exif.thumb_offset") + 1).cast("int"), F.col("exif.thumb_length").cast("int")
        ),
    )
    return with_texts(parsed.select(*rows.columns, "exif.*", thumbnail.alias("thumbnail")).drop("content"))


def from_files(inventory: DataFrame, thumbnails: bool = True) -> DataFrame:
    """The same for files on mounted storage: one read of the head, and one of the thumbnail where there is one."""
    schema = f"full_path string, {SCHEMA}, thumbnail binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            records = []
            for path, size in batch[["full_path", "file_length"]].itertuples(index=False):
                record, thumbnail = EMPTY, None
                try:
                    with open(path, "rb") as source:
                        record = _parse_safely(source.read(EXIF_HEAD_BYTES))
                        offset, length = record["thumb_offset"], record["thumb_length"]
                        if thumbnails and length and offset + length <= size:
                            source.seek(offset)
                            thumbnail = source.read(length)
                except OSError:
                    record = EMPTY
                records.append({"full_path": path, **record, "thumbnail": thumbnail})
            yield _typed(pd.DataFrame(records, columns=["full_path", *FIELDS, "thumbnail"]))

    found = inventory.select("full_path", "file_length").mapInPandas(run, schema)
    return with_texts(inventory.join(found, "full_path"))


def with_texts(rows: DataFrame) -> DataFrame:
    c = F.col
    named = rows.select(
        "*",
        text.exposure_time(c("exposure_num"), c("exposure_den")).alias("exposure"),
        text.aperture(c("f_num"), c("f_den")).alias("f_number"),
        text.focal_length(c("focal_num"), c("focal_den")).alias("focal_length"),
        text.iso_text(c("iso_value")).alias("iso"),
        text.dimensions(c("width"), c("height")).alias("dimensions"),
        text.capture_time(c("date_time")).alias("captured_at"),
    )
    return named.select(
        "*",
        text.camera_summary(c("has_exif"), c("camera_make"), c("camera_model")).alias("camera"),
        text.exposure_summary(c("has_exif"), c("focal_length"), c("f_number"), c("exposure"), c("iso")).alias(
            "exposure_summary"
        ),
    )


def catalogue(metadata: DataFrame, by: str = "camera") -> DataFrame:
    """Files and bytes per camera (or per category)."""
    return metadata.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("file_length").alias("bytes"))

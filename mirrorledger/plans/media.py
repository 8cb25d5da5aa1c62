"""Camera files derived from ``documents``: a valid TIFF or JPEG head built from row values, then the text.

English rows are TIFF, the others JPEG with the TIFF block in its first segment; the text is the embedded thumbnail.
"""

from pyspark.sql import DataFrame, SparkSession

from .trees import table


def _u16(value) -> str:
    return f"unhex(lpad(hex({value}), 4, '0'))"


def _u32(value) -> str:
    return f"unhex(lpad(hex({value}), 8, '0'))"


def _entry(tag: int, kind: int, count, value: str) -> str:
    return f"concat({_u16(tag)}, {_u16(kind)}, {_u32(count)}, {value})"


DERIVED = [
    "*",
    "source AS make",
    "CASE lang WHEN 'en' THEN concat(source, ' ', lang) ELSE concat('Body ', lang) END AS model",
    "concat('lens ', lang) AS lens",
    "date_format(TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, n_chars), 'yyyy:MM:dd HH:mm:ss') AS taken",
    "octet_length(text) AS n_bytes",
    "length(source) * 10 + 8 AS f_tenths",
    "least(n_chars, 65535) AS iso_speed",
]


def camera_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``full_path, file_length, category, content`` and the row values the content was built from."""
    rows = table(spark, sf_dir, "documents").selectExpr(*DERIVED)
    # Layout: header 8, main directory 42, detail directory 102, three fractions 24, date 20, second directory 30.
    strings = 226
    make, model, lens = "(octet_length(make) + 1)", "(octet_length(model) + 1)", "(octet_length(lens) + 1)"
    nul = "unhex('00')"
    main = [
        _entry(0x010F, 2, make, _u32(strings)),
        _entry(0x0110, 2, model, _u32(f"({strings} + {make})")),
        _entry(0x8769, 4, 1, _u32(50)),
    ]
    detail = [
        _entry(0x829A, 5, 1, _u32(152)),
        _entry(0x829D, 5, 1, _u32(160)),
        _entry(0x8827, 3, 1, f"concat({_u16('iso_speed')}, unhex('0000'))"),
        _entry(0x9003, 2, 20, _u32(176)),
        _entry(0x920A, 5, 1, _u32(168)),
        _entry(0xA002, 4, 1, _u32("n_chars")),
        _entry(0xA003, 4, 1, _u32("n_bytes")),
        _entry(0xA434, 2, lens, _u32(f"({strings} + {make} + {model})")),
    ]
    second = [
        _entry(0x0201, 4, 1, _u32(f"({strings} + {make} + {model} + {lens})")),
        _entry(0x0202, 4, 1, _u32("n_bytes")),
    ]
    block = ", ".join(
        [
            "unhex('4D4D002A00000008')",
            _u16(3), *main, _u32(196),
            _u16(8), *detail, _u32(0),
            _u32(1), _u32("n_chars"), _u32("f_tenths"), _u32(10), _u32("n_chars"), _u32(10),
            "encode(taken, 'UTF-8')", nul,
            _u16(2), *second, _u32(0),
            "encode(make, 'UTF-8')", nul, "encode(model, 'UTF-8')", nul, "encode(lens, 'UTF-8')", nul,
        ]
    )
    jpeg = f"concat(unhex('FFD8FFE1'), {_u16('octet_length(block) + 8')}, unhex('457869660000'), block)"
    head = rows.selectExpr("*", f"concat({block}) AS block")
    body = f"concat(CASE WHEN lang = 'en' THEN block ELSE {jpeg} END, encode(text, 'UTF-8'))"
    return head.selectExpr("*", f"{body} AS content").selectExpr(
        "doc_id",
        "concat('DCIM/', lang, '/', doc_id, CASE WHEN lang = 'en' THEN '.DNG' ELSE '.JPG' END) AS full_path",
        "CAST(octet_length(content) AS BIGINT) AS file_length",
        "CASE WHEN lang = 'en' THEN 'PhotoRaw' ELSE 'PhotoStandard' END AS category",
        "content",
    )

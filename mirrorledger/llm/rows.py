"""What the text operators share: row identity, null-safe joins and word filters of fixed size."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_KEY = "__row_key"
SENT_ROWS = 100_000  # rows up to which Spark may choose to broadcast a table


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and a 64-bit key of the text. Rows with equal id and key are equal rows for every operator, so
    repeated ids with different texts stay apart and repeated rows get equal results. Other columns are left behind,
    whatever their names."""
    text = F.col(f"`{text_column}`").cast("string")
    return docs.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias(ROW_KEY))


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal columns, null equal to null; the key columns appear once."""
    renamed = right.withColumnsRenamed({n: f"__right_{n}" for n in names})
    on = [F.col(f"`{n}`").eqNullSafe(F.col(f"__right_{n}")) for n in names]
    condition = on[0]
    for one in on[1:]:
        condition = condition & one
    return left.join(renamed, condition, how).drop(*(f"__right_{n}" for n in names))


def keep_rows(docs: DataFrame, kept: DataFrame, how: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` with all their columns; ``how`` is left_semi or left_anti against (doc_id, row key) rows."""
    key = "__key_of_row"
    left = docs.withColumn(key, F.xxhash64(F.col(f"`{text_column}`").cast("string")))
    right = kept.select(F.col("doc_id").alias("__kept_id"), F.col(ROW_KEY).alias("__kept_key"))
    on = left[id_column].eqNullSafe(right["__kept_id"]) & (left[key] == right["__kept_key"])
    return left.join(right, on, how).drop(key)


def unsent(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` as a side of a join. If the tables joined hold up to ``n`` rows, more than ``SENT_ROWS``, neither side is sent
    to the driver and broadcast: Spark sizes a table by its compressed files, and one made by explode as if it hadn't been."""
    return rows.hint("merge") if n > SENT_ROWS else rows


def hash_filter(hashes: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A bit set of ``2**bits`` bits holding the top bits of all hashes; at most ``2**bits / 64`` longs reach the driver.

    More hashes only let more candidates through; whoever uses the filter joins exactly afterwards.
    """
    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = (
        hashes.select((slot / 64).cast("long").alias("w"), F.pmod(slot, F.lit(64)).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
        .collect()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    if words:
        table[np.array([r["w"] for r in words])] = np.array([r["v"] for r in words], np.int64).view(np.uint64)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = int(len(table)).bit_length() - 1 + 6
    slot = hashes >> np.uint64(64 - bits)
    return ((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)

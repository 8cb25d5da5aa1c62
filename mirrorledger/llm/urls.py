"""URL filter: a blocked Bloom filter of listed canonical prefixes lets possible hits through to an exact hash join.

A rule is a host and the beginning of a path; it fits its host and all subdomains where the path begins with the rule's.
Every URL gives its candidates, one for each host suffix and each path length that occurs among the rules. A candidate's
hash picks one block of 512 bits of the filter and one bit in each of the block's eight words. Only candidates whose bits
are all set are joined with the rules, on host and path, which removes false positives. Of the fitting rules the longest
(as a string) wins; of equally long ones that with the longer host, and of equal rules ``block`` before ``allow``. URLs
without a fitting rule get the default verdict.

The filter has 16 bits for each rule up to ``MAX_FILTER_BYTES``; a longer list raises only the share of candidates that
the join has to drop. A null URL, or one without ``://``, has an empty host and path. Repeated rows get equal rows; empty
tables and rule lists are fine. Only ``page_id`` and ``url`` are read, so other columns may have any name.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import join_same

MAX_FILTER_BYTES = 16 << 20
BITS_PER_RULE = 16
WORDS = 8
_ODD = np.array([2 * (0x4F1BBCDC + 0x3779B97 * k) + 1 for k in range(WORDS)], np.uint64)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number of each hash, and its bit in each of the block's words."""
    block = (hashes >> np.uint64(32)) % np.uint64(blocks)
    low = hashes & np.uint64(0xFFFFFFFF)
    bit = ((low[:, None] * _ODD[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block.astype(np.int64), np.uint64(1) << bit


def bloom_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """The filter of a column ``h``, put together by Spark and collected: blocks x 8 words, at most ``MAX_FILTER_BYTES``."""
    blocks = 1
    while blocks * 64 < MAX_FILTER_BYTES and blocks * 512 < BITS_PER_RULE * count:
        blocks *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, mask = _bits(batch.column("h").to_numpy().view(np.uint64), blocks)
            columns = [pa.array(block), *(pa.array(mask[:, k].view(np.int64)) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", *(f"w{k}" for k in range(WORDS))])

    words = [f"w{k}" for k in range(WORDS)]
    placed = hashes.select("h").mapInArrow(place, ", ".join(f"{c} bigint" for c in ["block", *words]))
    table = np.zeros((blocks, WORDS), np.uint64)
    for row in placed.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in words)).collect():
        table[row["block"]] = np.array([row[w] for w in words], np.int64).view(np.uint64)
    return table


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path as one string, or null), verdict.

    ``rules``: host, path, verdict.
    """
    spark = pages.sparkSession
    listed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("h", F.xxhash64("rule_host", "rule_path"))
    )
    sizes = listed.groupBy(F.length("rule_path").alias("size")).count().collect()
    lengths = sorted(r["size"] for r in sizes)
    shared = spark.sparkContext.broadcast(bloom_filter(listed, sum(r["count"] for r in sizes)))

    @F.pandas_udf("boolean")
    def possible(h: pd.Series) -> pd.Series:
        table = shared.value
        block, mask = _bits(h.to_numpy().view(np.uint64), len(table))
        return pd.Series(((table[block] & mask) == mask).all(axis=1))

    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    candidates = (
        rows.withColumn("rule_host", F.explode(suffixes))
        .withColumn("size", F.explode(fitting))
        .withColumn("rule_path", F.substring(F.col("path"), F.lit(1), F.col("size")))
        .withColumn("h", F.xxhash64("rule_host", "rule_path"))
        .where(possible("h"))
    )
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(rule), F.length("rule_host"))
    keys = ["page_id", "host", "path"]
    best = (
        candidates.join(listed.drop("h"), ["rule_host", "rule_path"])
        .groupBy(*keys)
        .agg(F.max_by(F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
    )
    return join_same(rows, best, keys, "left").select(
        *keys, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

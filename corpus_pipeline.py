"""Cleaning and packing of a corpus: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns rows of ``documents`` with all their columns. Toxic and low-quality documents and those
that repeat benchmark items are left out, one document of each near-duplicate class stays, and what is left is packed.
The models are trained on the labelled rows of ``sf_dir`` outside the held-out folds of their queries.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorledger.llm import decontam, jaccard, packing, quality, toxicity
from mirrorledger.llm import queries as q
from mirrorledger.llm.rows import ROW_KEY, keep_rows
from mirrorledger.workspace import new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, q.toxicity_model(spark, sf_dir))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, q.quality_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of the smallest id; equal rows are one."""
    kept = keep_rows(docs, jaccard.representatives(jaccard.classes(docs)), "left_semi")
    return kept.withColumn(ROW_KEY, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", ROW_KEY]).drop(ROW_KEY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, q.table(spark, sf_dir, "benchmark"))
    return keep_rows(docs, found.where("contaminated"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the trained models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

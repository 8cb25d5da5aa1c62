"""The operators over their whole tables, as registered queries. Each derives its digest columns from the operator."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, dialogues, htmltext, jaccard, neardup, packing, quality, search, tokencount, toxicity, urls, warc
from .rows import ROW_KEY

Query = Callable[[SparkSession, str], DataFrame]

TOXIC_FOLDS, TOXIC_HELD_OUT = 4, 2
QUALITY_FOLDS, QUALITY_HELD_OUT = 3, 1


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def toxicity_model(spark: SparkSession, sf: str) -> toxicity.Model:
    learned = table(spark, sf, "labels").where(fold(TOXIC_FOLDS) != TOXIC_HELD_OUT)
    return toxicity.train(table(spark, sf, "documents"), learned)


def quality_model(spark: SparkSession, sf: str) -> quality.Model:
    learned = table(spark, sf, "labels").where(fold(QUALITY_FOLDS) != QUALITY_HELD_OUT)
    return quality.train(table(spark, sf, "documents"), learned)


def _judged(scored: DataFrame, held_out: Column, threshold: float, *more: str) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted, *more)


#: host, path, verdict
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf, "pages"), rules)


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard.classes(table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "n_shingles")


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf, "documents"), toxicity_model(spark, sf))
    return _judged(scored, fold(TOXIC_FOLDS) == TOXIC_HELD_OUT, toxicity.THRESHOLD, "spans")


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    found = search.top_k(table(spark, sf, "documents"), F.col("doc_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality.score(table(spark, sf, "documents"), quality_model(spark, sf))
    return _judged(scored, fold(QUALITY_FOLDS) == QUALITY_HELD_OUT, quality.THRESHOLD)


def op9_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    found = htmltext.extract(pages, htmltext.train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the archives and their index, then looks every page up in the index and reads its record."""
    pages, folder = table(spark, sf, "pages"), warc.archive_folder(spark)
    shards = warc.write_index(warc.write_archives(pages, folder), folder)
    wanted = pages.select(warc.url_key(F.col("url")).alias("key"), F.col("page_id").cast("bigint").alias("page_id"))
    return warc.read_records(warc.lookup(wanted, shards, folder), folder)


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return dialogues.repair(*dialogues.damaged(table(spark, sf, "conversations")))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(table(spark, sf, "documents"))


def op13_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents")).drop(ROW_KEY)


def queries() -> dict[str, Query]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_token_counts": op3_token_counts,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_decontamination": op6_decontamination,
        "op7_search": op7_search,
        "op8_quality": op8_quality,
        "op9_html_text": op9_html_text,
        "op10_warc": op10_warc,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_collocations": op12_collocations,
        "op13_near_duplicates": op13_near_duplicates,
    }

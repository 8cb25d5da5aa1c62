"""Small inventories made of bytes, as the fixtures describe them."""

import random

from pyspark.sql import functions as F

from mirrorledger.operators.inventory import FINGERPRINTS, fingerprint_content, from_content
from mirrorledger.workspace import materialise


def payload(size: int, seed: int) -> bytes:
    return random.Random(seed).randbytes(size)


def tree(spark, files, root_paths=None):
    """files: [(root_id, relative_path, bytes)]."""
    rows = [(r, (root_paths or {}).get(r, f"/{r}"), p, bytearray(b)) for r, p, b in files]
    return from_content(
        spark.createDataFrame(rows, "root_id string, root_path string, relative_path string, body binary")
    )


def prints(spark, files, wanted, **options):
    return materialise(fingerprint_content(tree(spark, files), wanted, **options), "test")[0]


def split(df):
    return df.where(F.col("root_id") == "card"), df.where(F.col("root_id") != "card")


def all_prints(spark, files):
    return prints(spark, files, FINGERPRINTS)

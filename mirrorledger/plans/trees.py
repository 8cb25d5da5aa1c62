"""File trees seen in the given tables: one source card and two backups, ``ssd`` and ``nas``.

A content table stands for a root; each row is a file. Every row of ``documents``, ``conversations``, ``pages`` and
``benchmark`` is a file of the card. The backups hold what a real backup run leaves behind: folders left out, files
reorganised, edited or kept under a numbered name. All of it follows from row attributes, in the scan, without joins.

=========  ==========================================================================================================
root       content
=========  ==========================================================================================================
card       all four tables
ssd        documents but those of ``src3``; French ones moved to ``Archive/``; those of ``src5`` edited in place with
           the right content beside them as ``_2``; conversations
nas        documents but those of ``src4``; ``src11`` edited inside, ``src13`` edited everywhere (same length); pages
           under other names
=========  ==========================================================================================================
"""

from pyspark.sql import DataFrame, SparkSession

from ..functions.constants import TIER2_POSITIONS, TIER3_POSITIONS
from ..functions.fingerprints import ProbeTiers
from ..operators.inventory import Destination, fingerprint_content, from_content
from ..operators.match import numbered
from ..workspace import materialise

# Texts are short, so chunk and tier sizes are scaled down from those for media files.
CHUNK = 64
TIERS = ProbeTiers(
    edge=64,
    tier1_max=256,
    tier2_max=4096,
    tier2_slice=128,
    tier3_slice=256,
    tier2_positions=tuple(TIER2_POSITIONS),
    tier3_positions=tuple(TIER3_POSITIONS),
)

CARD_ROOT = "/media/card"
SSD = Destination("ssd", "Field SSD", "/mnt/ssd", free_bytes=400_000)
NAS = Destination("nas", "Studio NAS", "", free_bytes=500_000_000_000)
DESTINATIONS = [SSD, NAS]


_tables: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str, stream: bool = False) -> DataFrame:
    # One handle per table and session: a query that reads a table several times infers its schema once.
    key = (spark.conf.get("spark.app.id"), sf_dir, name)
    if key not in _tables:
        _tables[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rows = _tables[key]
    if not stream:
        return rows
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


_EXTENSION = "CASE lang WHEN 'en' THEN '.JPG' WHEN 'fr' THEN '.CR3' WHEN 'de' THEN '.MOV' ELSE '.XMP' END"
_IN_PLACE = f"concat(lang, '/', source, '_', doc_id, {_EXTENSION})"


def _rows(rows: DataFrame, path: str, body: str, mtime: str = "CAST(NULL AS TIMESTAMP)") -> DataFrame:
    return rows.selectExpr(f"{path} AS relative_path", f"{body} AS body", f"{mtime} AS mtime")


def _documents(rows: DataFrame, path: str, body: str) -> DataFrame:
    return _rows(rows, path, body, "timestamp_seconds(1704067200 + n_chars)")


def _conversations(rows: DataFrame) -> DataFrame:
    return _rows(rows, "concat('chat/', conv_id, '_', turn, '.mp4')", "text")


def _root(rows: DataFrame, root_id: str, root_path: str) -> DataFrame:
    return from_content(rows.selectExpr(f"'{root_id}' AS root_id", f"'{root_path}' AS root_path", "*"))


def card(spark: SparkSession, sf_dir: str, *, stream: bool = False, root_path: str = CARD_ROOT) -> DataFrame:
    def read(name):
        return table(spark, sf_dir, name, stream)

    rows = (
        _documents(read("documents"), _IN_PLACE, "text")
        .union(_conversations(read("conversations")))
        .union(_rows(read("pages"), "concat('web/', page_id, '.tiff')", "html"))
        .union(_rows(read("benchmark"), "concat('bench/', item_id, '.iiq')", "text"))
    )
    return _root(rows, "card", root_path)


def ssd(spark: SparkSession, sf_dir: str, root_path: str = SSD.root_path) -> DataFrame:
    copied = table(spark, sf_dir, "documents").where("source <> 'src3'")
    path = f"""CASE WHEN lang = 'fr' AND source <> 'src5' THEN concat('Archive/', source, '/', doc_id, {_EXTENSION})
               ELSE {_IN_PLACE} END"""
    beside = f"concat(lang, '/', source, '_', doc_id, '_2', {_EXTENSION})"
    rows = (
        _documents(copied, path, "CASE WHEN source = 'src5' THEN translate(text, 'a', '4') ELSE text END")
        .union(_documents(copied.where("source = 'src5'"), beside, "text"))
        .union(_conversations(table(spark, sf_dir, "conversations")))
    )
    return _root(rows, "ssd", root_path)


def nas(spark: SparkSession, sf_dir: str, root_path: str = "/nas") -> DataFrame:
    copied = table(spark, sf_dir, "documents").where("source <> 'src4'")
    edited = """CASE WHEN source = 'src11' AND length(text) > 300
                     THEN concat(substr(text, 1, 100), translate(substr(text, 101, length(text) - 200), 'e', '3'),
                                 substr(text, length(text) - 99))
                     WHEN source = 'src13' THEN translate(text, 'a', '4') ELSE text END"""
    rows = _documents(copied, _IN_PLACE, edited).union(
        _rows(table(spark, sf_dir, "pages"), "concat('pages/p', page_id, '.tiff')", "html")
    )
    return _root(rows, "nas", root_path)


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ssd(spark, sf_dir).unionByName(nas(spark, sf_dir))


def all_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card(spark, sf_dir).unionByName(backups(spark, sf_dir))


def both_sides(spark: SparkSession, sf_dir: str, wanted: str | list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Card and backups with fingerprints, written by one job; the count is of both, an upper bound for either."""
    rows, n = fingerprinted(numbered(all_roots(spark, sf_dir)), wanted, "fingerprints")
    return rows.where("root_id = 'card'"), rows.where("root_id <> 'card'"), n


def fingerprinted(inventory: DataFrame, wanted: str | list[str], name: str) -> tuple[DataFrame, int]:
    """Fingerprints written once, since several joins read them."""
    return materialise(fingerprint_content(inventory, wanted, chunk=CHUNK, tiers=TIERS), name)

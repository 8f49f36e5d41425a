"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again.

Each stage works on all that the one before kept. All but the last return the columns of ``documents``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barometry.llm import bpe, jaccard, language, lines, mixing
from barometry.llm.queries import MIX_REST, MIX_WEIGHTS, RANKS
from barometry.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: words of a shingle and least similarity in per cent.
SHINGLE = 5
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some confidence. Null and blank texts have none and go; ids play no part,
    and equal rows have one verdict."""
    judged = language.language_id(docs, declared="lang", host="source")
    return judged.where("language_kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of repeated windows; those of which nothing is left go.

    Null and empty texts stay. Rows that repeat an id (null included) and a text are one document, with one result."""
    cleaned = lines.line_dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, an id before none.

    A document is a row, whatever its id: texts that share an id, or have none, are compared like others. Repeated
    rows are copies, of which one stays. Null texts and texts without words are alone in their groups.
    """
    # Rows are named by their content, so that a task that runs again names them alike.
    named = docs.withColumn("_row", F.xxhash64(*COLUMNS))
    found = jaccard.jaccard_join(named, "_row", width=SHINGLE, percent=PERCENT)
    groups = found.select("_row", "component_id").distinct().join(named.select("_row", "doc_id").distinct(), "_row")
    keep = written(groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select(
        F.col("first._row").alias("_kept")), "keep")
    kept = named.join(keep, F.col("_row") == F.col("_kept"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_row", *COLUMNS).orderBy("_row"))
    return kept.withColumn("_n", nth).where("_n = 1").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that every source has its share, shuffled. A null source is one of the rest; null and
    empty texts are drawn like others; rows with equal ids, null ones too, are drawn alike."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_REST).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and whether they decode to its text; null and empty texts have no ids."""
    return bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), RANKS, drop=("text",)).select(
        "doc_id", "source", "lang", "n_tokens", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("bpe", tokenize),
]

#: The stages fit a model, follow links and merge by rank: checked against a brute-force version in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

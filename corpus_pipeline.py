"""From raw documents to a training mix: five stages, each on all that the one before it kept.

Every stage is written as Parquet and read again as the next one's documents; the table before it goes then. No stage
broadcasts or collects anything that grows with the documents.

Defined cases. Null and empty texts pass the stages as empty ones do: the quality model scores them, empty texts are copies of one another,
they hold no benchmark passage and no personal data, and the mix takes no words from them. Repeated rows are copies: one stays. Null ids, sources and
languages are kept as they are. An empty table gives no rows. Columns other than ``COLUMNS`` are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegraph.llm import decontam, mixing, pii, quality, simhash
from tidegraph.llm.common import PLACE, with_place
from tidegraph.storage import Table, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, COLUMNS, "__score").where(F.col("__score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    rows = simhash.near_duplicates(docs)
    copies = rows.where("row_id != group").select(*PLACE)
    return with_place(docs.select(*COLUMNS)).join(copies, PLACE, "left_anti").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontam.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS)
    return found.where("n_items = 0").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows where the text changed, null texts stay null."""
    found = pii.redacted(docs, COLUMNS)
    changed = F.col("text").isNotNull() & (F.col("clean") != F.col("text"))
    return found.select(
        "doc_id", F.when(changed, F.col("clean")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words from, with size, source_size, target and taken."""
    placed = with_place(docs.select(*COLUMNS))
    taken = mixing.mix(placed, carry=tuple(PLACE)).where("taken > 0").select(*PLACE, "size", "source_size", "target", "taken")
    return placed.join(taken, PLACE).select(*COLUMNS, "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("personal data", redact_personal_data),
    ("mixing sources", mix_sources),
]

#: Boosted trees and loopy belief propagation have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with scratch() as made:
            after = Table(stage(spark, docs, sf_dir))
            made.remove(after)
        if before:
            before.drop()
        docs, before = after.df, after
    after.register()
    return docs

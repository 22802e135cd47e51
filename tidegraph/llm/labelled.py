"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import crc_bucket


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 5) -> DataFrame:
    """(text, label) of about ``rows`` labelled documents whose id's crc32 modulo ``folds`` is not 0.

    The choice is by a hash of the id, over all labels. A doc_id with several labels counts as
    its largest; null ids and labels are left out. The chosen (id, label) pairs are broadcast:
    their number is bounded by ``rows`` (give or take chance). A doc_id of several rows gives one,
    the text of the least hash, so that copies of one id don't pile up on the driver.
    """
    known = labels.select("doc_id", F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    known = known.where(crc_bucket("doc_id", folds) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "label")

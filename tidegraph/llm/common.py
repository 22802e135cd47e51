"""What the training-data operators share."""

from __future__ import annotations

import pickle
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a row is stored; see ``with_place``.
PLACE = ["__file", "__at"]


class Shared:
    """A broadcast object of this package, by value; a Python worker unpacks it once and keeps the last few."""

    def __init__(self, spark: SparkSession, thing):
        self.bytes, self.key = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), uuid.uuid4().hex

    @property
    def value(self):
        kept = vars(sys).setdefault("_tidegraph_shared", {})
        if self.key not in kept:
            while len(kept) > 2:
                kept.pop(next(iter(kept)))
            kept[self.key] = pickle.loads(self.bytes.value)
        return kept[self.key]


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A long that tells repeated rows apart, for one scan or for a table that is written with it; see ``with_place`` for several scans."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_place(df: DataFrame) -> DataFrame:
    """``df`` with the columns ``PLACE``: the file of each row and its number in it.

    They belong to the stored row, so any scan, however it is cut and on however many executors, finds the same. A DataFrame
    that doesn't come straight from Parquet files gets numbers of its scan instead; write it first if it is to be read twice.
    """
    file, at = (F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_path", "row_index"), PLACE))
    try:
        placed = df.select("*", file, at)
        placed.schema  # resolves the columns
        return placed
    except AnalysisException:
        return df.select("*", F.lit("").alias(PLACE[0]), F.monotonically_increasing_id().alias(PLACE[1]))


def per_text(df: DataFrame, work: Callable[[list[str]], dict], schema: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Run ``work`` on lists of whole texts (null: empty) inside Arrow batches.

    The other columns of ``df`` (and the text, if kept) come out as they are, followed by the arrays of ``work``; ``schema`` is the whole result's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                texts = ["" if t is None else t for t in part.column(text).to_pylist()]
                made = work(texts)
                kept = [n for n in part.schema.names if keep_text or n != text]
                yield pa.RecordBatch.from_arrays([part.column(n) for n in kept] + list(made.values()), names=kept + list(made))

    return df.mapInArrow(run, schema)


def with_results(docs: DataFrame, keep: list[str], work: Callable[[list[str]], dict], made: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with what ``work`` makes of its texts (``made``: their DDL)."""
    whole = "text" in keep
    kept = docs.select(*keep) if whole else docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__text"), made])
    return per_text(kept, work, schema, "text" if whole else "__text", whole)


def pieces(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text (one text at least)."""
    start, total = 0, 0
    sizes = pa.compute.binary_length(batch.column(text)).to_pylist()
    for i, n in enumerate(sizes):
        if total + (n or 0) > most and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < len(sizes):
        yield batch.slice(start)

"""Quality classifier: boosted trees over document statistics.

Statistics come from whole texts in one pass; labels are learned from a bounded sample of
``fit_rows`` labelled rows whose statistics (a few hundred bytes a row) meet on the driver.
The trees travel as small arrays.

Defined cases. A null text scores as the empty one; the statistics of an empty text are zeros.
Repeated rows are scored each. Without labels, or with one class only, every score is the
smoothed base rate. Extra columns are ignored; null ids fall in the fold of the empty text.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.boosting import Trees, fit
from tidegraph.llm.common import Shared, crc_bucket, per_text, with_results
from tidegraph.llm.labelled import labelled_sample

FIT_ROWS = 12_000
THRESHOLD = 0.3
#: Byte classes counted from one histogram of the text.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:", b"!", b"?", b"#$%&*", b"|", b"<>{}[]\\/=_^~`@+", bytes(range(128, 256)), b"\n")
WIDTH = 2 * len(CLASSES) + 12


def class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES)))
    for k, members in enumerate(CLASSES):
        out[list(members), k] = 1
    return out


def statistics(text: str, classes: np.ndarray) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * WIDTH
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ classes
    seen = Counter(words)
    repeats = sum(map(eq, words, words[1:]))
    lines = raw.split(b"\n")
    lengths = list(map(len, words))
    return [
        *(counts / size), *np.log1p(counts),
        np.log1p(n), np.log1p(size), sum(lengths) / n, max(lengths), len(seen) / n, max(seen.values()) / n,
        repeats / n, np.log1p(repeats), len(lines) / n, 1 - len(set(lines)) / len(lines), max(map(len, lines)) / size,
        sum(map(bytes.isupper, words)) / n,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    classes = class_matrix()
    return np.array([statistics(t, classes) for t in texts], dtype=float).reshape(len(texts), WIDTH)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Trees:
    sample = labelled_sample(docs, labels, label, fit_rows)
    work = lambda texts: {"x": pa.array(list(matrix(texts)), pa.list_(pa.float64()))}
    rows = per_text(sample.select("text", F.col("label").cast("int").alias("y")), work, "y int, x array<double>").toArrow()
    y = np.asarray(rows.column("y").to_pylist(), dtype=float)
    x = np.asarray(rows.column("x").to_pylist(), dtype=float).reshape(len(y), WIDTH)
    order = np.lexsort((*x.T, y)) if len(y) else []
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, keep: list[str], into: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with the model's probability of label 1 as ``into``."""
    shared = Shared(docs.sparkSession, (model.feature, model.threshold, model.leaf, model.base))
    work = lambda texts: {into: pa.array(Trees(*shared.value).probability(matrix(texts)), pa.float64())}
    return with_results(docs, keep, work, f"`{into}` double")


def op7_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

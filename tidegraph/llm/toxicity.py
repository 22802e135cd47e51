"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts, full-width forms and digit
substitutions to Latin letters and drops invisible characters. The lexicon holds whole words
and word beginnings that mark toxic documents of a bounded labelled sample: those whose share
of toxic documents is high and, by a binomial bound over all patterns tried, no accident. A word's
weight is its log-odds. Phrases (a listed word with the word before or after it) that the
sample shows in clean documents only are exceptions and don't count. The score is logistic in
the weighted hits and the hits by length, fitted on the same sample.

Scale: the lexicon and its fit see ``fit_rows`` labelled rows; each document is then scored by
itself in one pass.

Defined cases. Null and empty texts have no hits and get the score of a clean text. Repeated
rows are scored each. Where the labels are of one class only, or no pattern passes, the lexicon is empty and the score is the
smoothed share of toxic rows, (toxic + 1) / (rows + 2); without labels it is 0. Very long texts are scored whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import Shared, crc_bucket, per_text, with_results
from tidegraph.llm.labelled import labelled_sample

FIT_ROWS = 12_000
THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7)
PURE = 0.85
#: Look-alikes and substitutions, in pairs.
LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e",
}
HIDDEN = "­​‌‍⁠﻿"
FOLD = {ord(k): v for k, v in LOOKS.items()} | {ord(c): None for c in HIDDEN} | {0xFF41 + i: chr(97 + i) for i in range(26)}
WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def word_before(text: str, at: int) -> str:
    """The last word that ends before ``at``, whole; empty if there is none."""
    end = at
    while end and not text[end - 1].isalnum():
        end -= 1
    start = end
    while start and text[start - 1].isalnum():
        start -= 1
    return text[start:end]


def patterns_of(text: str) -> set[str]:
    """Whole words as ``word$`` and word beginnings as themselves."""
    words = set(WORDS.findall(fold(text)))
    return {w + "$" for w in words if len(w) > 2} | {w[:k] for w in words for k in PREFIXES if len(w) > k}


class Lexicon:
    """Patterns with weights, and exception phrases ``word word``."""

    def __init__(self, weights: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.weights, self.exceptions = weights, exceptions
        self.automaton = None

    def __getstate__(self):
        return self.weights, self.exceptions

    def __setstate__(self, state):
        self.weights, self.exceptions = state
        self.automaton = None

    def build(self):
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            whole: dict[str, list] = {}
            for p, w in self.weights.items():
                whole.setdefault(p.rstrip("$"), []).append((p[-1] == "$", w))
            for k, v in whole.items():
                self.automaton.add_word(k, (len(k), v))
            if whole:
                self.automaton.make_automaton()
        return self.automaton

    def hits(self, folded: str) -> list[tuple[float, tuple[str, ...]]]:
        """(weight, phrases) of every listed word: its heaviest pattern, and it with its neighbours."""
        if not self.weights:
            return []
        found: dict[int, float] = {}
        for end, (size, options) in self.build().iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            for whole, weight in options:
                if not (whole and end + 1 < len(folded) and folded[end + 1].isalnum()):
                    found[start] = max(weight, found.get(start, 0.0))
        out = []
        for start, weight in found.items():
            word = WORDS.match(folded, start)
            before, after = word_before(folded, start), WORDS.search(folded, word.end())
            out.append((weight, tuple(([f"{before} {word[0]}"] if before else []) + ([f"{word[0]} {after[0]}"] if after else []))))
        return out

    def measure(self, texts: list[str]) -> np.ndarray:
        """(weighted hits, hits in a thousand characters) a text, both by log(1 + x)."""
        out = np.zeros((len(texts), 2))
        for i, t in enumerate(texts):
            folded = fold(t)
            total = sum(w for w, phrases in self.hits(folded) if not self.exceptions.intersection(phrases))
            if total:
                out[i] = math.log1p(total), math.log1p(1000 * total / len(folded))
        return out


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], int, int]:
    """Weights by pattern, and how many rows are clean and toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[int(label > 0)].update([*patterns_of(text or ""), ""])
            every = [*(seen[0].keys() | seen[1].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[0][p] for p in every], pa.int64()), pa.array([seen[1][p] for p in every], pa.int64())], names=["pattern", "clean", "toxic"])

    counts = sample.mapInArrow(count, "pattern string, clean long, toxic long").groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Only patterns that could pass are collected: toxic in the main and seen more than twice.
    some = counts.where((F.col("pattern") == "") | ((F.col("toxic") > 2) & (F.col("toxic") >= PURE * (F.col("toxic") + F.col("clean"))))).collect()
    every = {r["pattern"]: (r["clean"], r["toxic"]) for r in some}
    clean, toxic = every.pop("", (0, 0))
    if not clean or not toxic:
        return {}, clean, toxic
    rate, tried = toxic / (clean + toxic), 500.0 * (clean + toxic)
    out = {}
    for p, (c, t) in every.items():
        share = t / (c + t)
        surprise = t * math.log(share / rate) + (c * math.log((1 - share) / (1 - rate)) if c else 0.0)
        if surprise > math.log(tried):
            out[p] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    return out, clean, toxic


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights (bias first) by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[Lexicon, np.ndarray] | None:
    sample = labelled_sample(docs, labels, label, fit_rows)
    weights, clean, toxic = learn_lexicon(sample)
    if not clean + toxic:
        return None
    if not weights:
        return Lexicon({}), np.array([math.log((toxic + 1) / (clean + 1)), 0.0, 0.0])
    shared = Shared(docs.sparkSession, Lexicon(weights))

    def look(texts):
        folded = [fold(t) for t in texts]
        hits = [shared.value.hits(f) for f in folded]
        return {"size": pa.array(map(len, folded), pa.int64()), "w": pa.array([[w for w, _ in h] for h in hits], pa.list_(pa.float64())), "phrases": pa.array([["\n".join(p) for _, p in h] for h in hits], pa.list_(pa.string()))}

    seen = per_text(sample.select("text", (F.col("label") > 0).cast("int").alias("y")), look, "y int, size long, w array<double>, phrases array<string>").collect()
    by: dict[str, list[int]] = {}
    for r in seen:
        for p in {q for group in r["phrases"] for q in group.split("\n") if q}:
            by.setdefault(p, [0, 0])[r["y"]] += 1
    exceptions = frozenset(p for p, (c, t) in by.items() if c >= 2 and not t)
    x = np.zeros((len(seen), 2))
    for i, r in enumerate(seen):
        total = sum(w for w, p in zip(r["w"], r["phrases"]) if not exceptions.intersection(p.split("\n")))
        x[i] = math.log1p(total), math.log1p(1000 * total / max(1, r["size"]))
    return Lexicon(weights, exceptions), logistic(x, np.array([r["y"] for r in seen], float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray] | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the probability that a text is toxic as ``score``."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    shared = Shared(docs.sparkSession, model)

    def work(texts):
        lexicon, w = shared.value
        margin = np.clip(w[0] + lexicon.measure(texts) @ w[1:], -30, 30)
        return {"score": pa.array(1 / (1 + np.exp(-margin)), pa.float64())}

    return with_results(docs, keep, work, "score double")


def op8_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

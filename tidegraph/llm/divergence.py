"""Source divergence audit: which sources of a language differ, and by which terms.

Sketch-prefiltered counting. A first pass over the texts fills a count-min sketch of document frequencies of (language, term): every
task adds the documents of its terms to ``DEPTH`` rows of counters, held at the least document frequency asked for, since a fuller
counter tells no more. Counters of all tasks are merged by cell, and a cell that reaches the least frequency is one bit. A sketch
never underestimates, so a term with a cell under it is impossible: the second pass drops it before anything is shuffled.
Survivors are counted exactly by language, source and term, and those with too few documents go then.

Sums over pairs of sources are sparse. Most terms of a language are in few of its sources, and a missing term has the same p
whatever it is. So a pair's sum is: what its first source's terms give against a missing one, the same for the second, the terms missing
from both, and a correction for the terms of both, which a join on (language, term) finds. The first two need only how many terms
of a source have each count.

Scale: two scans of the texts, with folded counts in Arrow batches; a task's dictionaries are flushed at ``ENTRIES`` entries, so memory is bounded
whatever the vocabulary. The sketch has ``DEPTH`` rows of 16 cells a document, between 2^20 and 2^24: a broadcast of at most
8 MiB of bits, through the driver once; beyond that size it lets more impossible terms through, which the exact counts drop. Counts are merged in
tasks first, so a hot source or term is a row a task. Pairs of sources are listed as the result lists them; the join yields a row for
each pair of sources that share a term. All arithmetic is in integers.

Defined cases. Null text, language and source are the empty text, one of its own like any other. A group without terms, or in a language without
kept terms, still has its pairs (value 0 where no term is kept) and no terms. Repeated rows are different documents. Very long
texts are cut into terms piece by piece. Ties rank by the item's bytes. A language of one source has no pairs. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidegraph.llm.common import Shared
from tidegraph.llm.terms import LETTERS, digests, term_counts
from tidegraph.storage import materialize, settled

DEPTH = 4
#: Cells of a sketch that one row of the merge covers.
BLOCK = 1 << 12
#: Entries of a task's dictionaries at which they are flushed.
ENTRIES = 1 << 18
UNIT = 1_000_000_000
LEAST_DOCS = 10


def read(docs: DataFrame) -> DataFrame:
    """(lang, source, text) of the documents, nulls empty, the text as bytes."""
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text"))


def cells(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """(DEPTH, terms): the cells of (lang, term), numbered over all rows of the sketch."""
    head = lang.encode() + b"\0"
    hashes = np.frombuffer(digests([head + t for t in terms]), "<u4").reshape(-1, DEPTH).T.astype(np.int64)
    return hashes % width + np.arange(DEPTH)[:, None] * width


def _sketcher(width: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, held = np.zeros(DEPTH * width, np.uint8), {}

        def flush():
            for lang, found in held.items():
                at = cells(lang, list(found), width)
                many = np.minimum(np.fromiter(found.values(), np.int64, len(found)), least)
                for row in at:
                    # Terms of one flush may share a cell: sums first, then what the cell had.
                    where, inverse = np.unique(row, return_inverse=True)
                    added = np.bincount(inverse, many).astype(np.int64)
                    counters[where] = np.minimum(counters[where] + added, least)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, Counter()).update(term_counts(text, LETTERS).keys())
                if sum(map(len, held.values())) > ENTRIES:
                    flush()
        flush()
        filled = np.flatnonzero(counters)
        cuts = np.flatnonzero(np.diff(filled // BLOCK)) + 1
        for some in np.split(filled, cuts) if len(filled) else []:
            block = int(some[0] // BLOCK)
            packed = (some % BLOCK).astype("<u2").tobytes(), counters[some].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed[0]]), pa.array([packed[1]])], names=["block", "at", "n"])

    return run


def _merger(least: int):
    """Rows sorted by block become one row of bits a block: which cells reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)
        made = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([np.packbits(total >= least).tobytes()])], names=["block", "bits"])
        for batch in batches:
            for block, at, n in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "n"))):
                if block != now:
                    if now is not None:
                        yield made()
                    now, total = block, np.zeros(BLOCK, np.int64)
                where = np.frombuffer(at, "<u2")
                total[where] = np.minimum(total[where] + np.frombuffer(n, np.uint8), least)
        if now is not None:
            yield made()

    return run


def sketch(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """One boolean a cell: whether its counter, over all documents, reaches ``least``."""
    filled = texts.select("lang", "text").mapInArrow(_sketcher(width, least), "block long, at binary, n binary")
    merged = filled.repartition("block").sortWithinPartitions("block").mapInArrow(_merger(least), "block long, bits binary")
    bits = np.zeros((DEPTH * width // BLOCK, BLOCK // 8), np.uint8)
    for r in merged.toLocalIterator():
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def possible(bits: np.ndarray, lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """One boolean a term: no cell of it is under the least frequency."""
    at = cells(lang, terms, width)
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)


def _counter(shared: Shared, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = shared.value, {}

        def flush():
            for (lang, source), (docs, seen) in held.items():
                terms = list(docs)
                kept = [t for t, yes in zip(terms, possible(bits, lang, terms, width)) if yes] if terms else []
                if kept:
                    columns = [pa.array([lang] * len(kept)), pa.array([source] * len(kept)), pa.array(kept, pa.binary()).cast(pa.string())]
                    columns += [pa.array([d[t] for t in kept], pa.int64()) for d in (docs, seen)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "docs", "seen"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                found = term_counts(text, LETTERS)
                docs, seen = held.setdefault((lang, source), (Counter(), Counter()))
                docs.update(found.keys())
                seen.update(found)
                if sum(len(d) for d, _ in held.values()) > ENTRIES:
                    yield from flush()
        yield from flush()

    return run


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, width: int | None = None) -> DataFrame:
    """(lang, source, term, n, total, one): occurrences of each kept term in a source and in its language; ``one`` marks one row a (lang, term)."""
    texts = read(docs)
    # 16 cells a document, in powers of two.
    width = width or 1 << min(24, max(20, (16 * docs.count()).bit_length()))
    shared = Shared(docs.sparkSession, sketch(texts, width, least_docs))
    partial = texts.mapInArrow(_counter(shared, width), "lang string, source string, term string, docs long, seen long")
    # Dealt by (lang, term) once: the sums by source and those over sources need no more shuffle.
    summed = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("seen").alias("n"))
    term = W.partitionBy("lang", "term")
    every = summed.withColumn("in_docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term)).withColumn("one", F.col("source") == F.min("source").over(term))
    return every.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total", "one")


def share(n: Column | int, size: str, terms: str) -> Column:
    """1 + floor(UNIT (n + 2) / (size + 2 terms)), null where there are no terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    n = F.lit(n) if isinstance(n, int) else n
    top, bottom = F.lit(UNIT).cast("decimal(10,0)") * whole(n + 2), F.nullif(F.col(size) + 2 * F.col(terms), F.lit(0))
    return 1 + F.call_function("div", top, whole(bottom))


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) in 64-bit integers."""
    p, q = F.col(p), F.col(q)
    return F.call_function("div", (p - q) * (p - q), p + q)


@settled
def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = 10, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language (``pair``) and its most unusual terms (``term``)."""
    counts = materialize(kept_counts(docs, least_docs, width))
    found = read(docs).select("lang", "source").distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("has"))
    langs = counts.groupBy("lang").agg(F.count_if("one").alias("terms"), F.sum("n").alias("lang_size"))
    groups = found.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "has", "terms", "lang_size"])
    groups = materialize(groups.withColumn("p0", share(0, "size", "terms")))
    own = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), "size", "terms"))
    own = materialize(own.withColumn("q", share(F.col("total"), "lang_size", "terms")).select("lang", "source", "term", "n", "p", "p0", "q"))

    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    unusual = own.where("p > q").select("lang", "source", F.col("term").alias("item"), gap("p", "q").alias("value"))
    unusual = unusual.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))

    # What a source's terms give against a source without them.
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"))
    kinds = own.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("many"))
    alone = kinds.join(other, "lang").where("a != b").withColumn("x", F.col("many") * gap("p", "q0"))
    alone = alone.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("x").alias("x"))
    # The correction for terms that both have; what the two sums above and the missing ones made of them goes out again.
    left = own.select("lang", "term", F.col("source").alias("a"), "p", "p0")
    right = own.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.sum(gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")).alias("x"))
    first = groups.select("lang", F.col("source").alias("a"), "terms", "has", "p0")
    second = groups.select("lang", F.col("source").alias("b"), F.col("has").alias("has_b"), F.col("p0").alias("q0"))
    pairs = first.join(second, "lang").where("a < b")
    missing = pairs.select("lang", "a", "b", F.coalesce((F.col("terms") - F.col("has") - F.col("has_b")) * gap("p0", "q0"), F.lit(0)).alias("x"))
    summed = alone.unionByName(both).unionByName(missing).groupBy("lang", "a", "b").agg(F.sum("x").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    apart = summed.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    apart = apart.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return apart.select(*columns).unionByName(unusual.select(*columns))


def op11_source_divergence(spark, sf_dir):
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM found GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(total) AS BIGINT) AS size FROM kept GROUP BY lang
), n AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.size, 0) AS lang_size, CAST(coalesce(s.size, 0) AS BIGINT) AS size
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN langs l ON l.lang = g.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS size FROM n GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 2)) // (g.size + 2 * g.v) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.total + 2)) // (g.lang_size + 2 * g.v) AS BIGINT) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), apart AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked
"""

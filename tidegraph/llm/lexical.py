"""Ranked lexical search by a two-level quantised index.

The index is a table of segments of documents. A segment holds its terms, and for each term its postings on two levels: a byte, the
posting's impact divided by ``STEP`` and rounded up, and the exact occurrences, which with a document's length give the exact impact. A search
sums bytes times weights first. A byte b says that the impact lies over STEP (b - 1) and not over STEP b, so the sums are an upper
and a lower bound of each document's score. Documents whose upper bound reaches the k-th largest lower bound (or exact score so far) are
scored exactly in integers; no other document can be among the k best, ties included.

Scale: one scan counts documents and terms, one writes the index, with the documents' own terms as the only memory; a search reads the
index once for each block of items. Items are hashed into blocks of about ``block_chars`` characters, whose terms and weights are
broadcast. A task keeps k documents an item and returns those; the k best of all tasks come from a window that is cut to k in each task
before its shuffle. Segments hold at most ``SEGMENT_DOCS`` documents and about ``SEGMENT_BYTES`` of text, so no term or document is a hot key.

Defined cases. Null, empty and termless texts are in no count and never found. Rows of one document id are different documents; a document without an id
ranks after those with one and comes out without it. Rows of one item id (null is one) are one item with the terms of all. An item without terms, or whose terms
no document holds, has no rows, and neither has an empty table. Very long texts are one document, cut into terms piece by piece. Ties
go to the smaller document id. Other columns are ignored. Products are 64-bit integers, sums of bounds doubles that stay exact below 2^53 (``STEP`` and weights bound an item's to some 10^9 terms).
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidegraph.llm.common import Shared, pieces
from tidegraph.llm.terms import WORDS, term_counts
from tidegraph.storage import LARGE_ROWS, materialize, settled

#: A posting's impact is under a million; 255 steps cover that.
STEP = 3922
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 4 << 20
#: Stands for a missing document id inside tasks, and sorts last.
NO_ID = (1 << 63) - 1
INDEX = "ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, docs array<int>, seen array<int>, bytes binary"


def impacts(seen: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Exact impact of postings with ``seen`` occurrences in documents of ``lengths`` terms."""
    m = 100 - 90 + (90 * lengths * n_docs) // n_terms
    return (1_000_000_000 * seen) // (1000 * seen + 8 * m)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for text in (t for part in pieces(batch, "text") for t in part.column(0).to_pylist()):
                here = term_counts(text, WORDS).total()
                n, total = n + (here > 0), total + here
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], names=["n", "total"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "n long, total long")
    return tuple(found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first())


class Segment:
    """Documents on their way into the index."""

    def __init__(self):
        self.numbers = defaultdict(count().__next__)
        self.ids, self.lengths, self.distinct = (array("q") for _ in range(3))
        # A text has under 2^31 bytes, so its counts fit.
        self.terms, self.seen = array("i"), array("i")
        self.size = 0

    def add(self, id_: int | None, text: bytes) -> None:
        found = term_counts(text, WORDS)
        if not found:
            return
        self.ids.append(NO_ID if id_ is None else id_)
        self.lengths.append(found.total())
        self.distinct.append(len(found))
        self.terms.extend(map(self.numbers.__getitem__, found))
        self.seen.extend(found.values())
        self.size += len(text)

    def row(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """Postings by term, then document."""
        terms, seen, lengths = (np.frombuffer(a, a.typecode) for a in (self.terms, self.seen, self.lengths))
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.distinct)
        order = np.argsort(terms, kind="stable")
        docs, seen = docs[order], seen[order]
        starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(self.numbers)))])
        packed = (-(-impacts(seen.astype(np.int64), lengths[docs], n_docs, n_terms) // STEP)).astype(np.uint8).tobytes()
        lists = [pa.array([x], pa.list_(t)) for x, t in ((np.frombuffer(self.ids, np.int64), pa.int64()), (lengths, pa.int64()), (list(self.numbers), pa.binary()), (starts.astype(np.int32), pa.int32()), (docs, pa.int32()), (seen, pa.int32()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed])], names=["ids", "lengths", "terms", "starts", "docs", "seen", "bytes"])


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index of ``docs`` (doc_id, text), one row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Segment()
        for batch in batches:
            for id_, text in (row for part in pieces(batch, "text") for row in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text")))):
                now.add(id_, text or b"")
                if len(now.ids) >= SEGMENT_DOCS or now.size >= SEGMENT_BYTES:
                    yield now.row(n_docs, n_terms)
                    now = Segment()
        if now.ids:
            yield now.row(n_docs, n_terms)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX)


def document_frequencies(index: DataFrame, wanted: Shared) -> DataFrame:
    """(term, df) of the terms ``wanted`` that a document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, terms = Counter(), wanted.value
        for batch in batches:
            for have, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist()):
                for i, t in enumerate(have):
                    if t in terms:
                        found[t] += starts[i + 1] - starts[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    return index.select("terms", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Best:
    """The k best documents of an item so far: highest score, then smallest id."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """The score to reach."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[order], ids[order]


class Query:
    """A block of items: the weight of each term and who asks for it."""

    def __init__(self, asked: list[list[bytes]], df: dict[bytes, int], n_docs: int):
        self.weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
        self.items: dict[bytes, list[int]] = defaultdict(list)
        for i, terms in enumerate(asked):
            for t in terms:
                if t in df:
                    self.items[t].append(i)

    def search(self, segment: dict, best: list[Best], n_docs: int, n_terms: int, counted: list[int] | None = None) -> None:
        """Add a segment's documents to ``best``; ``counted`` gets how many were scored exactly."""
        ids, lengths, starts, docs, seen, coarse = (segment[c] for c in ("ids", "lengths", "starts", "docs", "seen", "bytes"))
        mine = defaultdict(list)
        for j, t in enumerate(segment["terms"]):
            for i in self.items.get(t, ()):
                mine[i].append((j, self.weight[t]))
        for i, hits in mine.items():
            spans = [slice(starts[j], starts[j + 1]) for j, _ in hits]
            at, w = np.concatenate([docs[s] for s in spans]), np.repeat([w for _, w in hits], [s.stop - s.start for s in spans])
            upper = np.bincount(at, w * np.concatenate([coarse[s] for s in spans]).astype(np.int64), len(ids))
            lower = upper - np.bincount(at, w, len(ids))
            reach, k = best[i].floor(), best[i].k
            if len(ids) >= k:
                reach = max(reach, STEP * int(np.partition(lower, -k)[-k]))
            near = STEP * upper >= reach
            if not near.any():
                continue
            open_ = near[at]
            at, w, tf = at[open_], w[open_], np.concatenate([seen[s] for s in spans])[open_].astype(np.int64)
            score = np.zeros(len(ids), np.int64)
            np.add.at(score, at, w * impacts(tf, lengths[at], n_docs, n_terms))
            chosen = np.flatnonzero(near & (score > 0))
            if counted is not None:
                counted.append(len(chosen))
            best[i].add(score[chosen], ids[chosen])


def segments(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "lengths", "starts", "docs", "seen")}
        yield row | {"terms": batch.column("terms")[i].as_py(), "bytes": np.frombuffer(batch.column("bytes")[i].as_py(), np.uint8)}


def item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, its terms) of all items, in blocks of about ``block_chars`` characters of text."""
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // block_chars))
    for p in range(parts):
        terms = defaultdict(set)
        for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p).toLocalIterator():
            terms[r[0]].update(term_counts(bytes(r[1] or b""), WORDS))
        yield [(i, sorted(t)) for i, t in terms.items()]


@settled
def search(docs: DataFrame, items: DataFrame, k: int = 10, block_chars: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    n_docs, n_terms = corpus_size(docs)
    out, schema = None, "item long, doc long, score long"
    # A row a segment, in row groups of a few, so that no batch holds many.
    index = materialize(build_index(docs, n_docs, n_terms), LARGE_ROWS) if n_docs else None
    for block in item_blocks(items, block_chars) if n_docs else ():
        spark, names = docs.sparkSession, [i for i, _ in block]
        asked = [t for _, t in block]
        wanted = Shared(spark, set().union(*asked))
        df = {bytes(r.term): r.df for r in document_frequencies(index, wanted).collect()}
        shared = Shared(spark, Query(asked, df, n_docs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=len(block)) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in range(n)]
            for batch in batches:
                for segment in segments(batch):
                    shared.value.search(segment, best, n_docs, n_terms)
            columns = np.repeat(np.arange(n), [len(b.ids) for b in best]), *(np.concatenate([getattr(b, c) for b in best] or [np.zeros(0, np.int64)]) for c in ("ids", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "doc", "score"])

        found = index.mapInArrow(run, schema)
        found = found.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
        rows = spark.createDataFrame(list(enumerate(names)), "item long, item_id long")
        part = materialize(found.join(rows, "item").select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score"))
        for held in (wanted, shared):
            held.bytes.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical_search(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH tokens AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), postings AS (
  SELECT row, doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL
), lengths AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY row
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
), scored AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (row), corpus GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

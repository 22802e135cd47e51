"""Benchmark decontamination by the q-gram lemma.

Texts are compared lower-cased with white space runs as one space. A passage of m characters with
at most k = ``edit_rate`` m edits (k small enough for the lemma) keeps m - q + 1 - k q of its
q-grams, all within k diagonals of one another. So q-grams of a text that some passage has are
counted by passage in overlapping diagonal bands of width 2 (k + 1); bands that reach the
bound are regions to verify by banded alignment of the whole passage against the region.

Scale: each text is read once and on its own; no join. The passages go to the tasks in blocks of at
most ``block_chars`` characters (a size that is summed before), one pass over the texts a block, so the
broadcast is bounded however large the benchmark is. With several blocks the documents that one of them finds something in are
written (narrowly, without their text) before the next is collected, so the driver holds two blocks at most; what all found is joined to the
documents once. Very long texts go through in windows that overlap by more than a passage.

Defined cases. Null and empty texts are clean. Passages with under q characters are matched as
whole strings between word ends; empty and null ones match nothing; repeated passages count each by
its item_id, rows repeated whole once. Repeated documents are done each. Extra columns are ignored. ``items`` and ``spans`` are in
the order of ids, then places, however many blocks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import PLACE, Shared, with_place, with_results
from tidegraph.storage import materialize

Q, EDIT_RATE = 12, 0.05
WINDOW, TABLE_BITS = 1 << 20, 24
PRIME = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each window of q characters, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    single = (codes.astype(np.uint64) + np.uint64(1)) * PRIME
    out, length, power = None, 0, np.uint64(1)
    block, size, factor = single, 1, PRIME
    rest = q
    n = len(codes) - q + 1
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                piece = block[length : length + n]
                out = piece.copy() if out is None else out * factor + piece
                length += size
            rest >>= 1
            if rest:
                block = block[:-size] * factor + block[size:]
                factor = factor * factor
                size *= 2
        out ^= out >> np.uint64(29)
        out *= PRIME
        out ^= out >> np.uint64(32)
    return out


class Passages:
    """Q-gram index of a block of passages."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, edit_rate: float = EDIT_RATE):
        self.ids, self.texts, self.q, self.rate = ids, texts, q, edit_rate
        self.keys = None

    def __getstate__(self):
        return self.ids, self.texts, self.q, self.rate

    def __setstate__(self, state):
        self.__init__(*state)

    def build(self):
        lengths = np.array([len(t) for t in self.texts])
        # k such that the lemma still asks for at least one q-gram in three.
        self.k = np.maximum(0, np.minimum(np.floor(self.rate * lengths), np.floor((lengths - self.q + 1) * 2 / 3 / self.q))).astype(np.int64)
        self.least = np.maximum(1, lengths - self.q + 1 - self.k * self.q)
        hashes = [qgram_hashes(codes_of(t), self.q) for t in self.texts]
        keys = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.filter = np.zeros(1 << TABLE_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.short = [(i, t) for i, t in enumerate(self.texts) if 0 < len(t) < self.q]
        self.longest = int(max(lengths, default=0) + max(self.k, default=0))

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) in the normal text: the best place of each passage that occurs."""
        if self.keys is None:
            self.build()
        best: dict[int, tuple[int, int, int, int]] = {}
        padded = f" {text} "
        for i, t in self.short:
            at = padded.find(f" {t} ")
            if at >= 0:
                best[i] = (i, at, at + len(t), 0)
        step = max(WINDOW, 2 * self.longest)
        for base in range(0, max(1, len(text)), step):
            part = text[base : base + step + 2 * self.longest]
            for item, low, high in self.regions(part):
                passage, k = self.texts[item], int(self.k[item])
                a, b = max(0, low - k), min(len(part), high + len(passage) + k)
                found = align(passage, part[a:b], k)
                if found and (item not in best or found[2] < best[item][3]):
                    best[item] = (item, base + a + found[0], base + a + found[1], found[2])
        return sorted(best.values())

    def regions(self, text: str) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, last diagonal) of bands that reach the lemma's bound."""
        hashes = qgram_hashes(codes_of(text), self.q)
        if not len(hashes) or not len(self.keys):
            return []
        at = np.flatnonzero(self.filter[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(at):
            return []
        left, right = np.searchsorted(self.keys, hashes[at], "left"), np.searchsorted(self.keys, hashes[at], "right")
        many = right - left
        pos = np.repeat(at, many)
        if not len(pos):
            return []
        entry = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(len(pos))
        item, diagonal = self.item[entry], pos - self.place[entry]
        width = self.k[item] + 1
        band = (diagonal + self.longest) // width
        span = (len(text) + 2 * self.longest) + 4
        out = {}
        # A passage's q-grams lie within k of a diagonal, so in two neighbouring bands at most.
        key, count = np.unique(np.concatenate([item * span + band, item * span + band + 1]), return_counts=True)
        for kk, c in zip(key.tolist(), count.tolist()):
            i, b = divmod(kk, span)
            if c >= self.least[i]:
                w = int(self.k[i]) + 1
                low = (b - 1) * w - self.longest
                out[(i, b)] = (i, low, low + 2 * w - 1)
        return list(out.values())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def align(passage: str, region: str, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best place of the whole passage in the region, or None beyond k edits.

    Semi-global dynamic programming by row over the band of diagonals that k edits can reach: from k before the region's
    first to k after the last on which the passage fits. Cells that need more than k edits count as k + 1.
    """
    at = region.find(passage)
    if at >= 0:
        return at, at + len(passage), 0
    m, n, far = len(passage), len(region), k + 1
    width = n - m + 2 * k + 1
    if not k or width <= 0:
        return None
    # Place b of row i is column i + b - k; characters beyond the region match nothing.
    column = np.full(n + 2 * k, -1, np.int64)
    column[k : k + n] = codes_of(region)
    index = np.arange(width)
    start = index - k
    cost = np.where((start < 0) | (start > n), far, 0)
    for i, c in enumerate(codes_of(passage).tolist(), 1):
        diagonal, above = cost + (column[i - 1 : i - 1 + width] != c), np.append(cost[1:] + 1, far)
        new = np.minimum(diagonal, above)
        origin = np.where(diagonal <= above, start, np.append(start[1:], 0))
        # Insertions run to the right: the least of new[b'] + (b - b') over b' <= b.
        slope = new - index
        least = np.minimum.accumulate(slope)
        from_ = np.maximum.accumulate(np.where(slope == least, index, 0))
        cost, start = np.minimum(least + index, far), origin[from_]
        cost[max(0, n - i + k + 1) :] = far
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return int(start[end]), m + end - k, int(cost[end])


def passage_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Yields the passages in lists of at most ``block_chars`` characters in all (one passage at least)."""
    size = F.coalesce(F.length("text"), F.lit(0))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // block_chars))
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    for p in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        yield [(r["item_id"], normal(r["text"])) for r in some]


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], q: int = Q, edit_rate: float = EDIT_RATE, block_chars: int = 4 << 20) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_items (long), items (ids, comma-joined) and spans (item:start:end:edits in the normal text)."""
    out = None
    blocks = filter(None, passage_blocks(benchmark, block_chars))
    block, after = next(blocks, []), next(blocks, None)
    several = after is not None
    placed = with_place(docs) if several else docs
    while block is not None:
        block.sort()
        shared = Shared(docs.sparkSession, Passages([i for i, _ in block], [t for _, t in block], q, edit_rate))

        def work(texts, shared=shared):
            p = shared.value
            found = [sorted({(p.ids[i], a, b, e) for i, a, b, e in p.matches(normal(t))}) for t in texts]
            return {
                "n_items": pa.array([len({m[0] for m in f}) for f in found], pa.int64()),
                "items": pa.array([",".join(map(str, sorted({m[0] for m in f}))) for f in found], pa.string()),
                "spans": pa.array([",".join(":".join(map(str, m)) for m in f) for f in found], pa.string()),
            }

        if not several:
            return with_results(docs, keep, work, "n_items long, items string, spans string")
        part = materialize(with_results(placed, PLACE, work, "n_items long, items string, spans string").where("n_items > 0"))
        shared.bytes.destroy()
        out = part if out is None else out.unionByName(part)
        block, after = after, next(blocks, None) if after is not None else None
    every = lambda c: F.array_distinct(F.flatten(F.collect_list(F.split(c, ","))))
    kind = benchmark.schema["item_id"].dataType
    fields = lambda x: F.struct(*[F.element_at(x, i).cast(t).alias(f"f{i}") for i, t in ((-4, kind), (-3, "long"), (-2, "long"), (-1, "long"))])
    items = F.array_sort(F.transform(every("items"), lambda x: x.cast(kind)))
    spans = F.array_sort(F.transform(every("spans"), lambda x: F.struct(fields(F.split(x, ":")).alias("by"), x.alias("span"))))
    found = out.groupBy(*PLACE).agg(items.alias("items"), spans.alias("spans"))
    found = found.select(*PLACE, F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.array_join(F.transform("spans", lambda x: x["span"]), ",").alias("spans"))
    none = {"n_items": F.lit(0).cast("long"), "items": F.lit(""), "spans": F.lit("")}
    return placed.select(*keep, *PLACE).join(found.withColumnsRenamed({c: f"__{c}" for c in none}), PLACE, "left").select(*keep, *[F.coalesce(f"__{c}", v).alias(c) for c, v in none.items()])


def op4_decontaminate(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "items", "spans")

"""SimHash near-duplicates with BK-trees.

A BK-tree keeps fingerprints by integer Hamming distance to their parent; a search follows only
edges within the radius. Fingerprints that could be close meet in shards, each shard grows
its own tree in one task, and every fingerprint is searched for just before it is added. A
union-find beside the tree lets the search skip subtrees known to lie in the searcher's own
component, so a dense group costs about one visit a member, and links come out as a star to
each component's first member, never as all pairs.

Trees live where their shard is instead of being broadcast: all trees together grow with the
corpus and have no size bound. Shards above ``shard_rows`` members are cut into blocks, first searched each by itself.
Then only members of different components can gain from meeting, so the blocks outside a shard's largest component are
paired with all its blocks, those inside never with each other: a group of copies however large
costs as many tasks as it has blocks. A shard with more than one block outside (unlike rows that share a key)
is first keyed anew, more finely. No task holds more than twice ``shard_rows``.

Two ways to shards:

* ``hamming_components``: exact within ``radius`` bits. The 64 bits are cut into bands so that close
  fingerprints agree on at least two whole bands (pigeonhole); every pair of bands is a key. Finer keys add a part of the
  other bits, exact likewise.
* ``near_duplicates``: documents whose k-word shingle sets have Jaccard similarity of at
  least ``similarity``. Shards are keyed by single min-hash values of the set (a similar pair shares one of
  five with probability 0.9997 at 0.8, more above; so with the five further values that finer keys add), trees hold the documents' SimHash with a wide radius and each
  link is verified on the shingle sets themselves. Shards by the first value come first; of the other shards only those
  that still hold several components are searched.

Defined cases. A null text is empty. Fewer words than a shingle: the whole sequence is the one
shingle; none: fingerprint 0 (and an empty set, equal to other empty sets). Repeated rows and ids
are linked like any copies; component_id is the smallest id reachable and null only if all ids
are null. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegraph.llm.common import PLACE, per_text, with_place, with_row_id
from tidegraph.operators.components import connected_components
from tidegraph.storage import Table, materialize, settled

SEED = 42
#: Candidates that a search verifies at once, and the most bytes of a shard's bit matrix.
VERIFY, MATRIX_BYTES = 64, 1 << 26


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of every k-word shingle, in order, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    n = len(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else [], np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes)[: n - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit value whose bits are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


class Tree:
    """A BK-tree over 64-bit fingerprints with a union-find that the search both uses and extends."""

    def __init__(self, radius: int, same: Callable[[int, list[int]], Iterable[bool]] | None = None):
        self.radius, self.same = radius, same
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        #: A member whose component holds the whole subtree, or -1 if it was ever seen mixed.
        self.whole: list[int] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, new: int) -> None:
        """Join ``new`` (known, not yet in the tree) with all members within the radius."""
        if new == 0:
            return
        fp, r, prints, children, whole, root = self.prints[new], self.radius, self.prints, self.children, self.whole, self.root
        stack, close, mine = [0], [], root(new)
        while stack:
            node = stack.pop()
            if whole[node] >= 0 and root(whole[node]) == mine:
                continue
            d = (fp ^ prints[node]).bit_count()
            if d <= r and root(node) != mine:
                close.append(node)
                # Verified some at a time, so that a link found early spares the rest of its component.
                if self.same is None or len(close) == VERIFY:
                    mine = self.settle(new, close)
                    close = []
            for distance, child in children[node].items():
                if d - r <= distance <= d + r:
                    stack.append(child)
        self.settle(new, close)

    def settle(self, new: int, close: list[int]) -> int:
        """Join ``new`` with those of ``close`` that hold up; its root from then on."""
        if close and self.same is not None:
            close = [n for n in close if self.root(n) != self.root(new)]
            close = [n for n, ok in zip(close, self.same(new, close)) if ok] if close else close
        for node in close:
            a, b = sorted((self.root(node), self.root(new)))
            self.parent[b] = a
        return self.root(new)

    def insert(self, new: int) -> None:
        node, mine = 0, self.root(new)
        while new:
            if self.whole[node] >= 0 and self.root(self.whole[node]) != mine:
                self.whole[node] = -1
            d = (self.prints[new] ^ self.prints[node]).bit_count()
            if d not in self.children[node]:
                self.children[node][d] = new
                return
            node = self.children[node][d]

    def add(self, fp: int) -> None:
        new = len(self.prints)
        self.prints.append(fp & 0xFFFFFFFFFFFFFFFF)
        self.children.append({})
        self.parent.append(new)
        self.whole.append(new)
        self.link(new)
        self.insert(new)


def shard_links(prints: list[int], radius: int, same=None) -> list[tuple[int, int]]:
    """(first member of the component, member) for every other member of a component, by position."""
    if len(prints) == 2 and same is None:
        return [(0, 1)] if ((prints[0] ^ prints[1]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= radius else []
    tree = Tree(radius, same)
    for fp in prints:
        tree.add(fp)
    return [(tree.root(i), i) for i in range(len(prints)) if tree.root(i) != i]


def main_components(rows: DataFrame, shard_rows: int) -> DataFrame:
    """For each key of ``rows`` (key, root, ...): its largest component, all its rows, and the blocks for rows inside and outside of it."""
    counts = rows.groupBy("key", "root").count()
    tops = counts.groupBy("key").agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"))
    blocks = lambda n: F.ceil(n / shard_rows).cast("int")
    return tops.select("key", F.col("top.root").alias("main"), "n", blocks(F.col("top.count")).alias("inner"), blocks(F.col("n") - F.col("top.count")).alias("outer"))


def across(rows: DataFrame, sizes: DataFrame, shard_rows: int, id_column: str) -> DataFrame:
    """``rows`` with block columns i and j, so that any two of a key meet unless both are in its largest component."""
    columns = [c for c in rows.columns if c != "root"]
    whole, inside, inner, outer = F.col("n") <= 2 * shard_rows, F.col("root") == F.col("main"), F.col("inner"), F.col("outer")
    inside_block, outside_block = F.pmod(F.xxhash64(id_column), inner), inner + F.pmod(F.xxhash64(id_column), outer)
    cut = rows.join(sizes.where("outer > 0"), "key")
    cut = cut.withColumn("own", F.when(whole, 0).when(inside, inside_block).otherwise(outside_block).cast("int"))
    last = inner + outer - 1
    others = F.when(whole, F.array(F.lit(0))).when(inside, F.sequence(inner, last)).otherwise(F.sequence(F.lit(0), last))
    cut = cut.withColumn("other", F.explode(others))
    return cut.select(*columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def linked_shards(members: DataFrame, shard_rows: int, id_column: str, finer: Callable, links: Callable, turns: bool = False) -> DataFrame:
    """(id, root) of all that ``links`` finds linked in the shards of ``members`` (key, turn, id, ...).

    ``links`` gives the edges of rows with block columns i and j, within each (key, i, j). ``finer`` gives rows of oversized
    shards keyed anew, so that any two which share a key and could be linked share one of the new keys. With ``turns``, shards
    of turn 0 come first, and of the others only those that still hold several components.
    """
    first = F.col("turn") == 0 if turns else F.lit(True)
    large = materialize(members.where(first).groupBy("key").count().where(F.col("count") > shard_rows))
    blocks = large.select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("blocks"))
    own = F.coalesce(F.pmod(F.xxhash64(id_column), F.col("blocks")), F.lit(0)).cast("int")
    opening = members.where(first).join(blocks, "key", "left").withColumn("i", own).withColumn("j", F.col("i")).drop("blocks")
    # Searches are costly: each is run once, by the job that writes its edges.
    edges = materialize(links(opening).distinct())
    if not turns and large.isEmpty():
        return connected_components(edges)
    roots = materialize(connected_components(edges).withColumnRenamed("id", id_column))
    again = members.join(blocks, "key", "left").where(~first | F.col("blocks").isNotNull())
    hot = materialize(again.join(roots, id_column, "left").select(*members.columns, F.coalesce("root", id_column).alias("root")))
    sizes = materialize(main_components(hot, shard_rows))
    rest = across(hot, sizes.where("outer <= 1"), shard_rows, id_column)
    scattered = sizes.where("outer > 1").select("key")
    if not scattered.isEmpty():
        split = materialize(finer(hot.join(scattered, "key", "left_semi")).select(*hot.columns))
        rest = rest.unionByName(across(split, materialize(main_components(split, shard_rows)), shard_rows, id_column))
    return connected_components(edges.union(links(rest)))


def by_shard(work: Callable[[pa.RecordBatch], list[tuple[int, int]]], id_column: str):
    """Arrow function over rows sorted by (key, i, j): edges of ``work`` on each shard with several rows."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if not len(rest):
                continue
            keys = [np.asarray(rest.column(c)) for c in ("key", "i", "j")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(starts)
            for s in np.flatnonzero(sizes > 1):  # all but the last, which may go on
                yield rest.slice(int(starts[s]), int(sizes[s]))
            rest = rest.slice(int(starts[-1]))
        if rest is not None and len(rest) > 1:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src: list[int] = []
        dst: list[int] = []
        for shard in shards(batches):
            pairs = work(shard)
            if pairs:
                ids = shard.column(id_column).to_pylist()
                src += [ids[a] for a, _ in pairs]
                dst += [ids[b] for _, b in pairs]
            if len(src) > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def band_pairs(radius: int) -> list[int]:
    """Masks of two bands each, of radius + 2 bands: prints within the radius agree on one of them."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    bands = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(bands, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks of the bits outside ``mask`` in radius + 1 parts: prints within the radius agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(free), radius + 1)]


def hamming_components(prints: DataFrame, radius: int = 4, shard_rows: int = 4096) -> DataFrame:
    """(id, root) of the fingerprints (column fp, distinct) that have a neighbour within ``radius``."""
    masks = band_pairs(radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    # A key is a hash of the masked bits; a chance meeting of two keys only shows more prints to the tree.
    members = prints.select(F.posexplode(keys).alias("turn", "key"), "fp")
    parts = F.array(*[F.array(*[F.lit(signed(m)) for m in finer_masks(mask, radius)]) for mask in masks])

    def finer(rows: DataFrame) -> DataFrame:
        again = rows.withColumn("part", F.explode(F.get(parts, F.col("turn"))))
        return again.withColumn("key", F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("part"))))

    def work(shard: pa.Table) -> list[tuple[int, int]]:
        return shard_links(shard.column("fp").to_pylist(), radius)

    def links(rows: DataFrame) -> DataFrame:
        placed = rows.select("key", "i", "j", "fp").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
        return placed.mapInArrow(by_shard(work, "fp"), "src long, dst long")

    return linked_shards(members, shard_rows, "fp", finer, links)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp) of every row."""
    work = lambda texts: {"fp": pa.array([fingerprint(shingle_hashes(t, k)) for t in texts], pa.int64())}
    kept = docs.select("doc_id", F.col("text").alias("__text"))
    return per_text(kept, work, f"doc_id {kept.schema[0].dataType.simpleString()}, fp long", "__text")


@settled
def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = materialize(fingerprints(docs, k))
    least = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = hamming_components(least.select("fp"), radius).withColumnRenamed("id", "fp")
    labelled = least.join(linked, "fp").groupBy("root").agg(F.min("least").alias("lowest"))
    lowest = linked.join(labelled, "root").select("fp", "lowest")
    places = least.join(lowest, "fp", "left").select("fp", F.coalesce("lowest", "least").alias("component_id"))
    return rows.join(places, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def minhashes(hashes: np.ndarray, keys: int, start: int = 0) -> list[int]:
    """One min-hash value for each of ``keys`` seeded permutations from number ``start`` on, told apart by its number."""
    out = []
    with np.errstate(over="ignore"):
        for i in range(start, start + keys):
            odd = np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) & 0xFFFFFFFFFFFFFFFF)
            mixed = (hashes ^ (hashes >> np.uint64(31)) ^ odd) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= odd | np.uint64(1)
            out.append(int((mixed.min() * np.uint64(64) + np.uint64(i)).astype(np.int64)))
    return out


def jaccard_test(sets: list[np.ndarray], similarity: float) -> Callable[[int, list[int]], np.ndarray]:
    """Tells which of several sets (sorted, distinct values) are at least so similar to one.

    Only values that two sets share can count, so sets become rows of bits over those; a shard whose matrix would be too
    large is compared by search.
    """
    sizes = np.array([len(x) for x in sets])
    values, counts = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]), return_counts=True)
    common = values[counts > 1]
    words = -(-len(common) // 64)
    bits = None
    if len(sets) * words * 8 <= MATRIX_BYTES and len(common):
        bits = np.zeros((len(sets), words * 8), np.uint8)
        row = np.zeros(words * 64, np.uint8)
        for i, x in enumerate(sets):
            at = np.minimum(np.searchsorted(common, x), len(common) - 1)
            row[:] = 0
            row[at[common[at] == x]] = 1
            bits[i] = np.packbits(row)
        bits = bits.view(np.uint64)

    def shared(a: int, b: int) -> int:
        x, y = sets[a], sets[b]
        return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0

    def test(one: int, many: list[int]) -> np.ndarray:
        if bits is not None:
            both = np.bitwise_count(bits[many] & bits[one]).sum(axis=1, dtype=np.int64)
        else:
            both = np.array([shared(one, n) if min(sizes[one], sizes[n]) >= similarity * max(sizes[one], sizes[n]) else 0 for n in many])
        return both >= similarity * (sizes[one] + sizes[many] - both)

    return test


@settled
def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, keys: int = 5, radius: int = 26, shard_rows: int = 4096) -> DataFrame:
    """(row_id, doc_id, group) and ``PLACE``: every row with the smallest row_id of its group of near copies.

    row_id numbers the rows as they are scanned here; ``PLACE`` tells them in another scan of ``docs``. The radius is far beyond what a similarity of 0.8 can differ by
    (about ten bits of 64, sixteen at most in practice), so the tree only spares hopeless comparisons.
    """

    def look(texts):
        sets = [np.unique(shingle_hashes(t, k)) for t in texts]
        # Sets are compared by 32-bit values of their shingles; class ids by all bits.
        return {
            "class": pa.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets], pa.int64()),
            "fp": pa.array([fingerprint(s) for s in sets], pa.int64()),
            "keys": pa.array([minhashes(s, keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            "shingles": pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary()),
        }

    kept = with_row_id(with_place(docs.select("doc_id", F.col("text").alias("__text")))).select("row_id", "doc_id", *PLACE, "__text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    whole = Table(per_text(kept, look, f"row_id long, doc_id {kind}, {PLACE[0]} string, {PLACE[1]} long, class long, fp long, keys array<long>, shingles binary", "__text"))
    rows = materialize(whole.df.drop("shingles"))
    classes = rows.groupBy("class").agg(F.min("row_id").alias("row_id"))
    first = materialize(rows.select("row_id", "fp", "keys").join(classes.select("row_id"), "row_id", "left_semi"))
    exploded = first.select(F.posexplode("keys").alias("turn", "key"), "row_id", "fp")
    # Written first, so that the join reads plain shuffles and a hot key's rows can be split.
    shared = materialize(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    members = materialize(exploded.join(shared, "key", "left_semi"))
    # All sets are shuffled once, to keep those of members; neither side of a join with sets is bounded, so it is merged at every size.
    sets = whole.df.select("row_id", "shingles").hint("merge").join(members.select("row_id").distinct(), "row_id", "left_semi")
    sets = materialize(sets).hint("merge")
    whole.drop()

    def look_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [minhashes(np.frombuffer(b, np.uint32).astype(np.uint64), keys, keys) for b in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(found, pa.list_(pa.int64()))], names=["row_id", "again"])

    def finer(hot: DataFrame) -> DataFrame:
        again = sets.join(hot.select("row_id").distinct(), "row_id", "left_semi").mapInArrow(look_again, "row_id long, again array<long>")
        return hot.join(again, "row_id").withColumn("again", F.explode("again")).withColumn("key", F.xxhash64("key", "again"))

    def work(shard: pa.Table) -> list[tuple[int, int]]:
        sets = [np.frombuffer(b, np.uint32) for b in shard.column("shingles").to_pylist()]
        return shard_links(shard.column("fp").to_pylist(), radius, jaccard_test(sets, similarity))

    def links(rows: DataFrame) -> DataFrame:
        placed = rows.select("key", "i", "j", "row_id", "fp").join(sets, "row_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "row_id")
        return placed.mapInArrow(by_shard(work, "row_id"), "src long, dst long")

    linked = linked_shards(members, shard_rows, "row_id", finer, links, turns=True)
    groups = classes.join(linked.withColumnRenamed("id", "row_id"), "row_id", "left").select("class", F.coalesce("root", "row_id").alias("group"))
    return rows.select("row_id", "doc_id", *PLACE, "class").join(groups, "class").select("row_id", "doc_id", "group", *PLACE)


def op3_simhash(spark, sf_dir):
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

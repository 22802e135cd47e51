import os
import random

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from tidegraph.llm import simhash as s


def components(n, linked):
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if linked(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    return root


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=25, unique=True), st.integers(0, 3))
def test_tree_links_are_the_components(prints, radius):
    links = s.shard_links(prints, radius)
    root = list(range(len(prints)))
    for a, b in links:
        root[b] = a
    want = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= radius)
    assert root == want


def plain_print(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n ", max_size=40))
def test_fingerprint_is_the_plain_one(text):
    assert s.fingerprint(s.shingle_hashes(text, 4)) % 2**64 == plain_print(text)


def test_groups_match_brute_force(spark):
    rng = random.Random(5)
    rows, base = [(None, "lone row here"), (900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "One")], []
    for i in range(60):
        if i % 3 == 0:
            base = [f"w{rng.randrange(999)}" for _ in range(60)]
        words = list(base)
        if i % 3 == 1:
            words[rng.randrange(60)] = "x"
        rows.append((i // 2 * 2, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = s.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    prints = [plain_print(t or "") for _, t in rows]
    root = components(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    low = {}
    for (d, _), r in zip(rows, root):
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    want = sorted((d if d is not None else -1, f"{p:016x}", low[r] if low[r] is not None else -1) for (d, _), p, r in zip(rows, prints, root))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in got) == want
    assert s.simhash_groups(docs.limit(0)).count() == 0


def test_oversized_shards_lose_no_link(spark):
    prints = sorted({(1 << a) | (1 << b) for a in range(9) for b in range(9)} | {0xFFFF << 40, 0xFFFE << 40, 0x7 << 60})
    df = spark.createDataFrame([(p if p < 2**63 else p - 2**64,) for p in prints], "fp long")
    want = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    sizes = sorted(want.count(r) for r in set(want) if want.count(r) > 1)
    for rows in (4096, 7):
        got = s.hamming_components(df, shard_rows=rows).groupBy("root").count().collect()
        assert sorted(r["count"] for r in got) == sizes


def test_scattered_shards_are_keyed_anew_and_lose_no_link(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(40) << 24 for _ in range(150)}  # one hot key: the low bits agree
    prints = sorted(prints | {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)[:60]})
    df = spark.createDataFrame([(s.signed(p),) for p in prints], "fp long")
    root = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = {frozenset(s.signed(prints[i]) for i in range(len(prints)) if root[i] == r) for r in set(root) if root.count(r) > 1}
    got = {}
    for r in s.hamming_components(df, shard_rows=8).collect():
        got.setdefault(r["root"], set()).add(r["id"])
    assert {frozenset(v) for v in got.values()} == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4), st.integers(0, 14))
def test_finer_keys_are_exact(fp, flips, band):
    other = fp
    for b in flips:
        other ^= 1 << b
    mask = s.band_pairs(4)[band]
    parts = s.finer_masks(mask, 4)
    assert sum(parts) == ~mask % 2**64 and len(parts) == 5
    assert any(not (fp ^ other) & m for m in parts)


def test_hot_line_shared_by_unlike_texts_loses_no_link(spark):
    rng = random.Random(4)
    line, rows = [f"h{i}" for i in range(30)], []
    for i in range(60):
        words = line + [f"w{rng.randrange(99999)}" for _ in range(45)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + ["end"]))] if i % 2 else [(2 * i, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = s.near_duplicates(docs, shard_rows=4).orderBy("row_id").collect()
    at = {r["doc_id"]: r["row_id"] for r in got}
    assert [r["group"] for r in got] == [at[d - 1] if d % 2 else at[d] for d, _ in rows]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    rows, base = [(None, None), (1, ""), (2, "short text"), (2, "short text")], []
    for i in range(90):
        if i % 6 == 0:
            base = [f"w{rng.randrange(9999)}" for _ in range(120)]
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            words[rng.randrange(120)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for cut in (4096, 3):
        got = s.near_duplicates(docs, shard_rows=cut).orderBy("row_id").collect()
        sets = [frozenset(s.shingle_hashes(t or "", 5).tolist()) for _, t in rows]
        sim = lambda a, b: len(a & b) >= 0.8 * len(a | b)
        assert [r["group"] for r in got] == [got[w]["row_id"] for w in components(len(rows), lambda a, b: sim(sets[a], sets[b]))]


def test_jaccard_test_in_both_forms(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 90)).astype(np.uint32)) for _ in range(40)]
    want = [[len(set(a) & set(b)) >= 0.6 * len(set(a) | set(b)) for b in sets] for a in map(set, map(np.ndarray.tolist, sets))]
    for most in (1 << 26, 0):
        monkeypatch.setattr(s, "MATRIX_BYTES", most)
        test = s.jaccard_test(sets, 0.6)
        assert [[bool(x) for x in test(i, list(range(40)))] for i in range(40)] == want


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i % 977} x{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "short text"), (4, None), (4, "short text")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    extra = plain.selectExpr("*", *[f"'z' as {c}" for c in ("fp", "key", "i", "j", "id", "root", "row_id", "component_id", "fingerprint", "class", "group", "shingles", "n")])
    for work, columns in ((s.simhash_groups, ("doc_id", "fingerprint", "component_id")), (s.near_duplicates, ("doc_id",))):
        one, two = (sorted(tuple(r[c] for c in columns) for r in work(df).collect()) for df in (plain, extra))
        assert one == two and len(one) == 5
    got = {(r.doc_id, r.fingerprint): r.component_id for r in s.simhash_groups(extra).collect()}
    assert got[1, f"{plain_print(long):016x}"] == 1
    groups = {r.doc_id: r.group for r in s.near_duplicates(extra).where("doc_id < 4").collect()}
    assert groups[1] == groups[2] != groups[3]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_near_copies_of_the_tables_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    groups = {r.doc_id: r.group for r in s.near_duplicates(docs).collect()}
    sets = {r.doc_id: set(s.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect()}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 5 and all(groups[a] == groups[b] for a, b in pairs)

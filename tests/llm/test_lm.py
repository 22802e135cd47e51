import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegraph.llm import lm

WORD = b" ".join


def rows_for_test():
    rows = [(None, None), (1, ""), (2, " \n"), (3, "The The cat"), (3, "The The cat"), (4, "É é unseenword"), (5, "x" * 5000)]
    for i in range(10, 70):
        rows.append((i, " ".join(("the dog runs " if i % 2 else "le chien court ") for _ in range(30)) + f"w{i}"))
    return rows


KEPT = {}


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame(rows_for_test(), "doc_id long, text string").withColumn("held_out", lm.crc_bucket("doc_id", 10) == 0)
    docs = docs.selectExpr("*", "1 as n", "'z' as token", "2 as c", "3 as base", "4 as __row")
    train = lm.train_model

    def kept(texts, vocabulary, unigram):
        KEPT["model"], KEPT["vocabulary"] = train(texts, vocabulary, unigram), vocabulary.value
        return KEPT["model"]

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "train_model", kept)
        return lm.score_texts(docs, ~docs.held_out, ["doc_id", "held_out"]).collect()


def test_base_scores_are_the_plain_ones(scored):
    toks = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    c = Counter(w for d, t in rows_for_test() if not held(d) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted((d if d is not None else -1, held(d), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)), 6)) for d, t in rows_for_test())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want


def test_scores_are_the_plain_softmax(scored):
    m, v = KEPT["model"], KEPT["vocabulary"]
    toks = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    c = Counter(w for d, t in rows_for_test() if not held(d) for w in toks(t))
    own = [b"", *[w for w, _ in sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))][: lm.WORDS - 1]]
    ids = {w: 1 + i for i, w in enumerate(own)}
    mass = np.full(lm.CLASSES, 0.1)
    for w, n in c.items():
        if w not in ids:
            mass[lm.word_class(w)] += n + 0.1
    want = []
    for d, t in rows_for_test():
        one = two = lm.BOS
        total = 0.0
        for w in toks(t):
            k = ids.get(w) or 1 + lm.WORDS + lm.word_class(w)
            logits = np.where(v.unigram > 0, (m.c[0] * m.r[one] + m.c[1] * m.r[two]) @ m.q.T.astype(float) + m.b, -np.inf)
            total += (logits[k] - np.log(np.exp(logits - logits.max()).sum()) - logits.max()) / np.log(10)
            if k > lm.WORDS:
                total += math.log10((c[w] + 0.1) / mass[lm.word_class(w)])
            one, two = k, one
        want.append((d if d is not None else -1, total))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in scored)
    assert np.allclose([x for _, x in got], [x for _, x in sorted(want)], rtol=1e-4, atol=1e-3)


def test_model_beats_the_base(scored):
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in scored)
    some = [r for r in scored if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_probabilities_are_normalised():
    head = [(b"the", 50), (b"", 9), (b"cat", 5), (b"bat", 4), (b"zzz", 1)]
    old = lm.WORDS
    lm.WORDS = 3
    try:
        mass = np.full(lm.CLASSES, 0.1)
        for w in (b"bat", b"zzz"):
            mass[lm.word_class(w)] += dict(head)[w] + 0.1
        v = lm.Vocabulary(head, 69, 5, mass)
        m = lm.LogBilinear(v.unigram, seed=3)
        m.r *= 10
        scorer = lm.Scorer(v, m)
        a, b, z = m.log_tables()
        for one, two in ((0, 0), (1, 2), (5, 3)):
            p = np.exp(a[one].astype(float) + b[two] - z[one, two])
            assert abs(p.sum() - 1) < 1e-4 and p[0] == 0
        # The words of a class and its slot for an unseen one share the class's probability.
        k = lm.word_class(b"bat")
        same = [w for w in (b"bat", b"zzz") if lm.word_class(w) == k]
        assert abs(sum((dict(head)[w] + 0.1) / mass[k] for w in same) + 0.1 / mass[k] - 1) < 1e-9
        assert len(scorer.measure(["the cat", None])[0]) == 2
    finally:
        lm.WORDS = old


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_texts(docs, lm.F.lit(False), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) for r in got)
    assert lm.score_texts(docs.limit(0), lm.F.lit(True), ["doc_id"]).count() == 0


def test_frequent_words_are_whole_levels_of_counts(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 2), ("e", 1), ("f", 1)], "token string, c long")
    assert lm.frequent(counts, 9) == [(b"a", 100), (b"b", 50), (b"c", 50), (b"d", 2), (b"e", 1), (b"f", 1)]
    assert lm.frequent(counts, 5) == [(b"a", 100), (b"b", 50), (b"c", 50), (b"d", 2)]
    assert lm.frequent(counts, 2) == [(b"a", 100)] and lm.frequent(counts, 0) == [] == lm.frequent(counts.limit(0), 5)


def test_words_within_a_class_are_the_plain_softmax(spark):
    # 1,500 words by falling count: the first 767 stand for themselves, the next have slots, the others share the rest of their class.
    rng = np.random.default_rng(3)
    words = [f"w{i:04d}{'ab'[i % 2]}{'cde'[i % 3]}" for i in range(1500)]
    rows = [(i, " ".join(words[j] for j in np.minimum(rng.exponential(400, 300).astype(int), 1499))) for i in range(200)] + [(200, "neverseenac " + words[900]), (201, None)]
    train = lm.train_model
    kept = {}

    def keep(texts, vocabulary, unigram):
        kept["m"], kept["v"] = train(texts, vocabulary, unigram), vocabulary.value
        return kept["m"]

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "train_model", keep)
        got = {r.doc_id: r.score for r in lm.score_texts(docs, lm.F.col("doc_id") < 180, ["doc_id"]).collect()}
    m, v = kept["m"], kept["v"]
    toks = lambda t: (t or "").encode().split() + [b""]
    c = Counter(w for d, t in rows if d < 180 for w in toks(t))
    ranked = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if w]
    own = {w: 1 + i for i, w in enumerate([b"", *ranked[: lm.WORDS - 1]])}
    second = int(lm.GROWTH * len(c) ** 0.5)
    members = {}
    for w in ranked[lm.WORDS - 1 :][:second]:
        members.setdefault(lm.word_class(w), []).append(w)
    rest = Counter({k: 0.1 for k in range(lm.CLASSES)})
    for w in ranked[lm.WORDS - 1 :][second:]:
        rest[lm.word_class(w)] += c[w] + 0.1
    assert sum(map(len, members.values())) == second > 100 and len(v.starts) == lm.CLASSES + 1 and v.starts[-1] == lm.CLASSES + second

    def log_softmax(x):
        return x - np.log(np.exp(x - x.max()).sum()) - x.max()

    seen = Counter()
    for d, t in rows[::9] + rows[-2:]:
        one = two = lm.BOS
        total = 0.0
        for w in toks(t):
            context = (m.c[0] * m.r[one] + m.c[1] * m.r[two]).astype(float)
            k = own.get(w) or 1 + lm.WORDS + lm.word_class(w)
            total += log_softmax(np.where(v.unigram > 0, context @ m.q.T + m.b, -np.inf))[k]
            if w not in own:
                of = lm.word_class(w)
                low = v.starts[of]
                inner = log_softmax(context @ m.inner_q[low : v.starts[of + 1]].T + m.inner_b[low : v.starts[of + 1]])
                assert len(inner) == 1 + len(members.get(of, []))
                if w in members.get(of, []):
                    total += inner[1 + members[of].index(w)]
                    seen["member"] += 1
                else:
                    total += inner[0] + math.log((c[w] + 0.1) / rest[of])
                    seen["rest"] += 1
            one, two = k, one
        assert abs(got[d] - total / math.log(10)) < 1e-3 + 1e-5 * abs(got[d]), d
    assert seen["member"] > 100 and seen["rest"] > 20 and np.abs(m.inner_q).max() > 0


def test_inner_probabilities_sum_to_one_in_every_block_size():
    v = lm.Vocabulary([(b"", 9), *[(f"{i}zz".encode(), 3000 - i) for i in range(1200)]], 10**6, 5000, np.full(lm.CLASSES, 10**6.0), 300)
    m = lm.LogBilinear(v.unigram, slot_log=v.slot_log)
    m.inner_q = np.random.default_rng(1).normal(0, 1, m.inner_q.shape).astype(np.float32)
    k = lm.word_class(b"zz")
    slots = np.arange(v.starts[k], v.starts[k + 1])
    assert len(slots) == 301
    one = np.full(len(slots), 7)
    for most in (1, 1000, 1 << 22):
        assert abs(np.exp(m.inner_log(slots, one, one + 1, v.starts, most)).sum() - 1) < 1e-5
    # Untrained, the second level is the share by count.
    m.inner_q[:] = 0
    assert np.allclose(np.exp(m.inner_log(slots, one, one, v.starts)), v.slot_mass[slots] / v.slot_mass[slots].sum(), rtol=1e-4)


def test_frequent_words_where_very_many_have_one_count(spark):
    counts = spark.createDataFrame([(f"w{i:03}", 4) for i in range(50)], "token string, c long")
    assert lm.frequent(counts.repartition(5), 20) == [(b"w%03d" % i, 4) for i in range(20)]
    assert lm.frequent(counts.limit(0), 20) == []
    assert len(lm.frequent(counts, 60)) == 50

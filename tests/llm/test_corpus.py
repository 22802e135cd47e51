"""Source divergence, ranked search and the URL filter against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import divergence, lexical, urlfilter
from tidegraph.llm.terms import LETTERS, WORDS, term_counts
from tidegraph.storage import materialize, scratch

LETTER, TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("text", ["", "Ab9c ÉÉé\u00a0x_y-z\x00Q", "日本\u3000語 ABC1" * 3, "\u0130I\x7f\x80[a]"])
def test_terms(text):
    for table, pattern in ((LETTERS, LETTER), (WORDS, TERM)):
        assert {k.decode(): n for k, n in term_counts(text.encode(), table).items()} == Counter(terms_of(text, pattern))
    assert not term_counts(None, WORDS)


def test_long_texts_are_cut_between_terms():
    text = ("ab " * 700_000 + "c" * 3_000_000 + " ab").encode()
    assert term_counts(text, LETTERS) == {b"ab": 700_001, b"c" * 3_000_000: 1}


def plain_divergence(rows, least):
    docs = [((lang or ""), (source or ""), Counter(terms_of(t, LETTER))) for lang, source, t in rows]
    df, total, n, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, c in docs:
        df[lang].update(c.keys())
        total[lang].update(c)
        n[lang, source].update(c)
        sources[lang].add(source)
    out = []
    for lang in sources:
        kept = [t for t, d in df[lang].items() if d >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole, each = share(total[lang]), {s: share(n[lang, s]) for s in sources[lang]}
        for s in sources[lang]:
            pairs = [(o, sum(gap(each[s][t], each[o][t]) for t in kept)) for o in sources[lang] if o != s]
            terms = [(t, gap(each[s][t], whole[t])) for t in kept if n[lang, s][t] and each[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(5)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["Éa", "THE", "日本"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), " ".join(rng.choices(words, [1 / (i + 1) for i in range(63)], k=rng.randrange(40)))) for _ in range(260)]
    rows += [("en", "silent", None), ("en", "silent", "12 34"), ("xx", "one", "word"), ("xx", "two", ""), ("lone", "s", "a " * 30)] + [("copies", "s", "same Same"), ("copies", "t", "same other")] * 5
    rows += [("en", "long", "the " * 50_000 + "x" * 100_000)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, n long").selectExpr("*", "1 as term", "'x' as item", "2 as size")
    for least in (10, 1, 1000):
        want = plain_divergence(rows, least)
        assert want and sorted(map(tuple, divergence.divergence(docs, least).collect())) == want
    # A sketch as narrow as a block lets impossible terms through; the exact counts drop them.
    assert sorted(map(tuple, divergence.divergence(docs.repartition(5), 10, width=divergence.BLOCK).collect())) == plain_divergence(rows, 10)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_sketch_never_underestimates(spark, monkeypatch):
    rng = random.Random(9)
    rows = [("en", "s", " ".join({f"{'abc'[i % 3]}{chr(97 + i // 3 % 26)}{chr(97 + i // 78)}" for i in (rng.randrange(900) ** 2 // 900 for _ in range(20))})) for _ in range(300)]
    texts = divergence.read(spark.createDataFrame(rows, "lang string, source string, text string").repartition(6))
    df = Counter(t for *_, text in rows for t in set(text.split()))
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    for width in (1 << 12, 1 << 16):
        bits = divergence.sketch(texts, width, 10)
        known = list(df)
        passed = dict(zip(known, divergence.possible(bits, "en", [t.encode() for t in known], width)))
        assert all(passed[t] for t in known if df[t] >= 10)
        assert sum(passed[t] for t in known if df[t] < 10) < (0.05 if width > 1 << 12 else 0.5) * len(known)


def plain_search(docs, items, k=10):
    counted = [(d, Counter(terms_of(t, TERM))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms, df = len(counted), sum(c.total() for _, c in counted), Counter()
    for _, c in counted:
        df.update(c.keys())
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(terms_of(t, TERM))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in counted:
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def test_search(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"t{i}" for i in range(120)] + ["Éa", "THE"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(122)], k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(400)] + [(5, "t7 t8"), (None, "t9 t9 t100"), (900, None), (901, ""), (902, "--"), (903, "t3 " * 20_000)]
    docs += [(1000 + i, "t50 t51 the copy") for i in range(40)]
    items = [(i, text(12)) for i in range(25)] + [(30, None), (31, "unheard"), (32, "The COPY"), (32, "t51"), (None, "t9 t100"), (33, "t3 " * 500)]
    want = plain_search(docs, items)
    made = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rank", "2 as score", "3 as item_id")
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    assert sorted(map(tuple, lexical.search(made, asked).collect()), key=str) == want
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 7)
    assert sorted(map(tuple, lexical.search(made.repartition(3), asked, block_chars=400).collect()), key=str) == want
    assert lexical.search(made.limit(0), asked).count() == 0 and lexical.search(made, asked.limit(0)).count() == 0
    assert lexical.search(made.where("doc_id > 899 and doc_id < 903"), asked).count() == 0


def test_bytes_bound_impacts_and_most_documents_are_not_scored():
    rng = np.random.default_rng(1)
    seen, lengths = rng.integers(1, 50, 5000), rng.integers(50, 4000, 5000)
    exact = lexical.impacts(seen, lengths, 5000, int(lengths.sum()))
    coarse = -(-exact // lexical.STEP)
    assert coarse.max() <= 255 and (exact <= coarse * lexical.STEP).all() and (exact > (coarse - 1) * lexical.STEP).all()
    now = lexical.Segment()
    words = [f"w{i}" for i in range(300)]
    for i in range(3000):
        now.add(i, " ".join(rng.choice(words, 40)).encode())
    n_terms = 3000 * 40
    (segment,) = lexical.segments(now.row(3000, n_terms))
    df = {t: int(b - a) for t, a, b in zip(segment["terms"], segment["starts"], segment["starts"][1:])}
    query, best, counted = lexical.Query([[f"w{i}".encode() for i in range(0, 40, 4)]], df, 3000), [lexical.Best(10)], []
    query.search(segment, best, 3000, n_terms, counted)
    assert len(best[0].ids) == 10 and counted[0] < 300


RULES = sorted(urlfilter.RULES, key=lambda r: -len(r[1]))


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host, tail = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
    return host.translate(LOWER), re.split(r"[?#]", tail, maxsplit=1)[0]


def plain_rule(host, path):
    for verdict, text in RULES:
        h, p = text[: text.index("/")], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            return text, verdict
    return None, None


def test_url_filter(spark):
    rng = random.Random(2)
    pages = []
    for i in range(1500):
        host = rng.choice(["", "www.", "M."]) + rng.choice(["Example", "example", "notexample", "a.b", "x"]) + rng.choice([".org", ".com", ".net", ".ORG"])
        pages.append((i % 1400, f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'es', 'fr', 'de', 'EN'])}/{rng.randrange(3000)}{rng.choice(['', '?a=://b/c', '#t', '/'])}"))
    pages += [(None, None), (1, ""), (2, "no scheme"), (3, "://"), (4, "http://org"), (5, "http://org/"), (6, "http://exampleXorg/es/"), (7, "http://org?x=/"), (8, "http://é.org/é/日\n/x"), (9, "http://com/de/" + "z" * 30_000), (10, "http://x.net/" + "y" * 30_000), (11, "a://b.com/fr/://c.org/")]
    got = urlfilter.judge(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, rule string").repartition(4).selectExpr("*", "1 as host", "2 as n", "3 as kind", "'t' as text"))
    rows = got.collect()
    want = [(i, *plain_parts(u), plain_rule(*plain_parts(u))) for i, u in pages]
    key = lambda r: str((r[0], r[1], r[2], r[3]))
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in rows), key=str) == sorted(((i, h, p, rule[0]) for i, h, p, rule in want), key=key)
    assert all(r.verdict == plain_rule(r.host, r.path)[1] for r in rows if r.rule) and {r.verdict for r in rows} == {"allow", "block"}
    # No rule decides .net; paths that rules block elsewhere are blocked there, those they allow are allowed.
    net = [r for r in rows if r.rule is None and r.host.endswith(".net")]
    for part, verdict in (("/de/", "block"), ("/fr/", "allow")):
        mine = [r.verdict == verdict for r in net if r.path.startswith(part)]
        assert len(mine) > 30 and sum(mine) > 0.9 * len(mine)


def test_url_filter_without_examples(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a"), (2, None), (3, "http://a.org/b")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.rule) for r in urlfilter.judge(pages).collect()) == [(1, "allow", None), (2, "allow", None), (3, "allow", "org/")]
    assert urlfilter.judge(pages.limit(0)).count() == 0
    assert urlfilter.threshold([]) == 0 and urlfilter.threshold([("allow", 5, 3)]) == 0
    assert urlfilter.threshold([("block", -3, 4), ("block", 0, 1), ("allow", 9, 5)]) == 5
    assert urlfilter.threshold([("block", 4, 4), ("allow", 3, 1), ("allow", 9, 5)]) == 7


def test_markov_is_a_distribution_and_follows_its_definition(spark):
    texts = ["ab/ab", "abc", "ab/x", "", "zz"] * 3
    rows = spark.createDataFrame([("allow", t) for t in texts] + [("block", "only")], "kind string, text string")
    counts = {bytes(r.string): r.n for r in urlfilter.kept_strings(rows).where("kind = 'allow'").collect()}
    plain = Counter(w[i : i + n] for t in texts for w in [b"\xfe" + t.encode() + b"\xff"] for n in range(1, urlfilter.ORDER + 1) for i in range(len(w) - n + 1) if w[i : i + n] != b"\xfe")
    assert counts == {s: n for s, n in plain.items() if n >= 2}
    model = urlfilter.Markov(counts)

    def share(context, symbol):
        if not context:
            base, seen = 1 / 257, {s: n for s, n in counts.items() if len(s) == 1}
        else:
            base, seen = share(context[1:], symbol), {s[-1:]: n for s, n in counts.items() if s[:-1] == context}
        if not seen:
            return base
        return (seen.get(symbol, 0) + len(seen) * base) / (sum(seen.values()) + len(seen))

    for text in (b"ab/abq", b"", b"zzzz", "é".encode()):
        whole = b"\xfe" + text + b"\xff"
        assert abs(model.score(text) - sum(math.log10(share(whole[max(0, i + 1 - urlfilter.ORDER) : i], whole[i : i + 1])) for i in range(1, len(whole)))) < 1e-9
    for context in (b"", b"ab", b"\xfea", b"b/ab"):
        assert abs(sum(share(context, bytes([c])) for c in range(256) if c != 254) + share(context, b"?" * 2) * 2 - 1) < 1e-9


def test_the_index_lies_in_row_groups_of_a_few_segments(spark, monkeypatch):
    """Writers and readers hold a row group, however many segments a task makes."""
    groups = []

    def kept(df, *more):
        table = materialize(df, *more)
        found = [pq.read_metadata(f.removeprefix("file://")) for f in table.inputFiles()]
        groups.append([meta.row_group(i).num_rows for meta in found for i in range(meta.num_row_groups)])
        return table

    monkeypatch.setattr(lexical, "materialize", kept)
    text = F.expr("concat_ws(' ', transform(sequence(0L, 450000L), i -> concat('w', i * 7 + id)))")
    docs = spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    items = spark.createDataFrame([(1, "w7 w8 w14")], "item_id long, text string")
    with scratch():
        found = lexical.search(docs, items).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"])][:2] == [0, 1]
    # Two texts a segment.
    assert groups[0] == [1, 1, 1]

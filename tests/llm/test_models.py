"""Top-k search, quality, toxicity and language identification."""

import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidegraph.llm import boosting, langid, quality, topk, toxicity
from tidegraph.llm.labelled import labelled_sample


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)] + [(i, [0.5] * 6) for i in range(200, 260)]
    rows += [(300, None), (None, [1.0] * 6), (301, [1.0, None]), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, []), (305, [2.0, 1.0]), (50, rows[50][1]), (350, [1e4] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank")
    vec = [(i, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(vec):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(vec) if b != a)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for many, wide in ((4096, 4096), (2, 4096), (2, 20)):
        got = topk.top_k(df, topk.F.col("vec_id") % 50 == 0, dim_block=2, queries_at_once=many, rows_at_once=wide, least_rows=16, chunk=16).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), topk.F.lit(True)).count() == 0 == topk.top_k(df, topk.F.lit(None).cast("boolean")).count()
    assert len(topk.top_k(df.where("vec_id in (0, 1)"), topk.F.lit(True)).collect()) == 2


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95

    def one(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose([one(r) for r in x[:20]], model.probability(x[:20]))
    assert boosting.fit(x[:0], y[:0]).probability(x[:1]) == pytest.approx(0.5)


def labelled(spark, texts, column):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(None, None), (9999, ""), (9999, "")], "doc_id long, text string").selectExpr("*", "0.5 as score", "'x' as label")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (3, None)], f"doc_id long, {column} int")
    return docs, labels


def accuracy(rows, texts, folds=5, cut=0.5):
    held = {r.doc_id: r.score for r in rows if r.doc_id is not None and r.doc_id < len(texts) and zlib.crc32(str(r.doc_id).encode()) % folds == 0}
    return sum((s >= cut) == texts[i][1] for i, s in held.items()) / len(held)


def test_quality(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    texts = [(" ".join(word() for _ in range(80)), 1) if i % 4 else (" ".join([word() + "###"] * 60), 0) for i in range(300)]
    docs, labels = labelled(spark, texts, "quality")
    rows = quality.score(docs, quality.train(docs, labels), ["doc_id"]).collect()
    assert len(rows) == 303 and all(0 <= r.score <= 1 for r in rows) and accuracy(rows, texts) > 0.95
    bare = quality.train(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(docs, bare, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), bare, ["doc_id"]).count() == 0
    assert not np.any(quality.statistics(" \n ", quality.class_matrix()))


def test_toxicity(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    texts = []
    for i in range(400):
        words = [word() for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["zonker", "Z0nker", "zоnker", "blipf" + word(), "zon​ker"])
        texts.append((" ".join(words), int(i % 5 == 0)))
    docs, labels = labelled(spark, texts, "toxic")
    rows = toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 for r in rows) and accuracy(rows, texts) == 1.0
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}
    every = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1")), ["doc_id"]).collect()
    n = sum(y == 1 and zlib.crc32(str(i).encode()) % 5 != 0 for i, (_, y) in enumerate(texts))
    assert {round(r.score, 9) for r in every} == {round((n + 1) / (n + 2), 9)}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.tuples(st.booleans(), st.integers(1, 9)), min_size=1, max_size=8), st.text(alphabet="abc _0", max_size=40))
def test_matcher_is_the_plain_one(patterns, text):
    weights = {p + "$" * whole: float(w) for p, (whole, w) in patterns.items()}
    folded, want = toxicity.fold(text), []
    for i in range(len(folded)):
        fits = [w for p, w in weights.items() if folded.startswith(p.rstrip("$"), i) and not (i and folded[i - 1].isalnum()) and not (p[-1] == "$" and folded[i + len(p) - 1 : i + len(p)].isalnum())]
        want += [max(fits)] if fits else []
    assert sorted(w for w, _ in toxicity.Lexicon(weights).hits(folded)) == sorted(want)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB1.!é# \n", max_size=60))
def test_statistics_are_the_plain_ones(text):
    raw, got = text.encode(), quality.statistics(text, quality.class_matrix())
    words = raw.split()
    if not words:
        assert not any(got)
        return
    counts = [sum(b in members for b in raw) for members in quality.CLASSES]
    repeats, lines = sum(a == b for a, b in zip(words, words[1:])), raw.split(b"\n")
    want = [c / len(raw) for c in counts] + [math.log1p(c) for c in counts]
    want += [math.log1p(len(words)), math.log1p(len(raw)), sum(map(len, words)) / len(words), max(map(len, words)), len(set(words)) / len(words), max(words.count(w) for w in words) / len(words)]
    want += [repeats / len(words), math.log1p(repeats), len(lines) / len(words), 1 - len(set(lines)) / len(lines), max(map(len, lines)) / len(raw), sum(w.isupper() for w in words) / len(words)]
    assert np.allclose(got, want)


def test_a_stump_is_the_best_of_all_splits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (60, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(60) < 0.2)).astype(float)
    model = boosting.fit(x, y, trees=1, depth=1, rate=1.0, least=5, ridge=1.0)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    gains = {(f, c): score(x[:, f] <= c) + score(x[:, f] > c) for f in range(3) for c in np.unique(x[:, f]) if 5 <= (x[:, f] <= c).sum() <= 55}
    left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert score(left) + score(~left) == pytest.approx(max(gains.values()))
    assert np.allclose(model.leaf[0], [g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def test_very_long_texts_are_scored_whole(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, long + "zonker"), (2, long)], "doc_id long, text string")
    model = toxicity.Lexicon({"zonker$": 5.0}), np.array([-3.0, 9.0, 0.0])
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert scores[1] > 0.9 and scores[2] < 0.1
    x = quality.matrix([long])
    assert x[0, 2 * len(quality.CLASSES)] == math.log1p(200_000)


def test_lexicon_boundaries_and_exceptions():
    lexicon = toxicity.Lexicon({"trash$": 2.0, "lowei": 3.0}, frozenset({"trash can"}))
    hits = lambda t: [w for w, _ in lexicon.hits(toxicity.fold(t))]
    assert hits("TR4SH, trashy retrash loweix xlowei") == [2.0, 3.0]
    assert lexicon.measure(["the trash can", "the trash", ""])[:, 0].tolist() == [0.0, math.log1p(2.0), 0.0]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=30), st.text(alphabet="abcd", max_size=30))
def test_cross_parsing_is_the_greedy_one(reference, text):
    codes = {"a": 3, "b": 4, "c": 5}
    steps = langid.suffix_automaton([codes[c] for c in reference])
    edges = np.array([(s, c, t) for s, to in enumerate(steps) for c, t in to.items()], np.int32).reshape(-1, 3)
    parser = langid.CrossParser(["x"], "abc", [edges], [1.0])
    for segment in (512, 3, 1):
        assert parser.phrases([text, "", text + text], segment)[0][:, 0].tolist() == [greedy(reference, text), 0, greedy(reference, text + text)]


def greedy(reference, text):
    """Phrases of the plain parse: each the longest match, or a character that the reference lacks."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_long_texts_parse_as_a_whole():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    books = {"aa": " ".join(rng.choices(words[:200], k=700)), "bb": " ".join(rng.choices(words[100:], k=700))}
    parser = langid.parser_of(books)
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 90, 900)] + [books["aa"] + " xyz " + books["bb"] * 2, "q" * 1500]
    want = [[greedy(books[k], t) for k in books] for t in texts]
    for segment in (512, 61):
        assert parser.phrases(texts, segment)[0].tolist() == want


def test_letters_beyond_the_basic_plane():
    parser = langid.parser_of({"en": "the quick brown fox", "gothic": "\U00010330\U00010331\U00010332 " * 20})
    langs, scores = parser.predict(["\U0001F600", "\U0001F600 123", "\U00010330\U00010331\U00010332", "fox \U0001F600"])
    assert langs == ["und", "und", "gothic", "en"] and scores[:2] == [0.0, 0.0]


def test_languages(spark):
    rng = random.Random(0)
    syllables = {"en": ["the", "ing", "and", "wh"], "fr": ["eau", "é", "que", "oi"], "zz": ["xq", "ñu", "ij"]}
    rows = [(None, None, "en"), (1000, "", "en"), (1001, "123 !? 4", "fr"), (1002, "thewhing " * 2000, None)]
    for i in range(120):
        lang = rng.choice(sorted(syllables))
        rows.append((i, " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.randint(2, 60))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' as lang_pred", "3 as score")
    got = langid.identify(docs, langid.train(docs), ["doc_id"]).collect()
    pred = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and pred[None] == pred[1000] == pred[1001] == "und" and pred[1002] == "en"
    assert all(pred[i] == lang for i, _, lang in rows[4:]) and all(0 <= r.score <= 1 for r in got)
    blank = langid.identify(docs, langid.train(docs.limit(0)), ["doc_id"])
    assert {r.lang_pred for r in blank.collect()} == {"und"}


def test_a_short_book_does_not_cut_the_others(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    rows = [(i, " ".join(word("abcdefgh") for _ in range(6)), "short texts") for i in range(3000)]
    rows += [(10_000 + i, " ".join(word("stuvwxyz") for _ in range(600)), "long texts") for i in range(60)]
    rows += [(20_000, "klm nop", "rare"), (20_001, "", "empty")]
    parser = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # Books by their scale: full ones for all that have the text, its own for the rare one, none without a letter.
    books = {lang: 2**scale - len(parser.letters) - 2 for lang, scale in zip(parser.languages, parser.scale)}
    assert {k: round(v) for k, v in books.items()} == {"long texts": 32_768, "short texts": 32_768, "rare": 8}
    assert parser.predict([rows[0][1], rows[-3][1], "klm nop klm"])[0] == ["short texts", "long texts", "rare"]


def test_languages_of_many_scripts_are_told_apart():
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(1500)]
    scripts = {"aa": "abcdefghijklmnopqrstuvwxyz", "el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзийклмнопрстуфхцчшщыьэюя", "ka": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"}
    scripts |= {"zh": han[:750], "zi": han[750:], "ext": [chr(0x20000 + i) for i in range(40)]}
    words = {k: ["".join(rng.choices(v, k=3)) for _ in range(300)] for k, v in scripts.items()}
    made = {k: " ".join(rng.choices(v, k=3000)) for k, v in words.items()}
    parser = langid.parser_of(made)
    assert set(parser.letters) == {c for v in made.values() for c in v} - {" "}
    parser.lay_out()
    coded = {c: tuple(parser.encode(c).tolist()) for c in parser.letters}
    assert len(set(coded.values())) == len(parser.letters)
    texts = [(k, " ".join(rng.choices(v, k=12))) for k, v in words.items() for _ in range(20)]
    assert parser.predict([t for _, t in texts])[0] == [k for k, _ in texts]


def test_rows_of_one_or_no_id_do_not_pile_up(spark, monkeypatch):
    rows = [(None, f"abcd{'efgh'[i % 4]} words {'ijklmnop'[i % 8]}{'qrstuvwxyz'[i // 8 % 10]}{'abcdefgh'[i // 80 % 8]} of a text " * 40, "en") for i in range(640)]
    rows += [(77, "the same text again " * 40, "en")] * 500 + [(78, f"other text {i}", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, collect = [], type(docs).collect

    def counted(self):
        out = collect(self)
        got.extend(r["text"] for r in out if "text" in self.columns)
        return out

    monkeypatch.setattr(type(docs), "collect", counted)
    parser = langid.train(docs)
    monkeypatch.undo()
    assert parser.languages == ["en"] and len(got) == len(set(got)) and sum(map(len, got)) < 3 * 32_768
    labels = spark.createDataFrame([(77, 1), (78, 0), (79, 0)], "doc_id long, quality int")
    ids = [i for i in (77, 78) if zlib.crc32(str(i).encode()) % 1000]
    assert len(labelled_sample(docs, labels, "quality", 1000, folds=1000).collect()) == len(ids) > 0


def test_exceptions_hold_across_long_words_and_gaps():
    lexicon = toxicity.Lexicon({"bad": 1.0}, frozenset({"x" * 90 + " bad", "so bad"}))
    for text, clean in (("x" * 90 + " bad", True), ("so" + " " * 90 + "bad", True), ("x" * 91 + " bad", False), ("bad", False), ("_so_bad", True)):
        assert (lexicon.measure([text])[0, 0] == 0) == clean, text
    assert toxicity.word_before("  ", 2) == "" and toxicity.word_before("ab cd", 3) == "ab"

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from tidegraph.llm import decontam as d


def distance(passage, region):
    best = list(range(len(passage) + 1))
    prev, low = best, len(passage)
    for c in region:
        row = [0]
        for i, p in enumerate(passage, 1):
            row.append(min(prev[i] + 1, row[-1] + 1, prev[i - 1] + (p != c)))
        prev, low = row, min(low, row[-1])
    return min(low, len(passage))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=12), st.text(alphabet="ab c", max_size=30), st.integers(0, 4))
def test_align_is_the_least_edits(passage, region, k):
    found = d.align(passage, region, k)
    least = distance(passage, region)
    assert (found is None) == (least > k) if found is None or least > k else found[2] == least


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.integers(1, 14))
def test_qgram_hashes_tell_windows_apart(text, q):
    h = d.qgram_hashes(d.codes_of(text), q)
    grams = [text[i : i + q] for i in range(len(text) - q + 1)]
    assert len(h) == len(grams)
    assert len(set(h.tolist())) == len(set(grams))


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], ["z"], [t[i], "z"]])
    return "".join(t)


def test_no_passage_within_the_budget_is_missed():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(12, 50))) for _ in range(8)]
    p = d.Passages(list(range(8)), passages)
    p.build()
    for i in range(0, 8, 2):
        text = d.normal(" ".join(word() for _ in range(40)) + " " + edited(rng, passages[i], int(p.k[i])) + " " + " ".join(word() for _ in range(40)))
        assert [m[0] for m in p.matches(text)] == [j for j in range(8) if distance(passages[j], text) <= p.k[j]] and i in [m[0] for m in p.matches(text)]


def test_windows_of_long_texts(monkeypatch):
    monkeypatch.setattr(d, "WINDOW", 64)
    passage = "the quick brown fox jumps over the lazy dog and runs"
    p = d.Passages([7], [passage])
    for shift in range(0, 400, 17):
        text = "x" * shift + " " + passage + " " + "y" * 300
        assert [(m[0], m[3]) for m in p.matches(text)] == [(0, 0)]


def test_edge_rows_and_blocks(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "Says: One  two\nthree four five six seven eight nine TEN!", "q"), (3, passage, "q"), (None, "short one", "q"), (9, "clean " * 50, "q")], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(1, passage), (1, passage), (2, passage), (2, passage[:-4]), (3, ""), (4, None), (5, "short"), (None, "clean clean clean")], "item_id long, text string")
    for chars in (1 << 20, 60):
        got = sorted((r.doc_id or 0, r.n_items, r["items"]) for r in d.scan(docs, bench, ["doc_id"], block_chars=chars).collect())
        assert got == [(0, 1, "5"), (1, 0, ""), (2, 0, ""), (3, 2, "1,2"), (3, 2, "1,2"), (9, 0, "")]
    # Items and spans come in numerical order, whatever the blocks.
    many = spark.createDataFrame([(i, passage) for i in (10, 9, 100, 2)], "item_id long, text string")
    twice = spark.createDataFrame([(7, f"{passage} and then {passage}")], "doc_id long, text string")
    for chars in (1 << 20, 60):
        (row,) = d.scan(twice, many, ["doc_id"], block_chars=chars).collect()
        assert (row.n_items, row["items"]) == (4, "2,9,10,100")
        spans = [tuple(map(int, s.split(":"))) for s in row.spans.split(",")]
        assert spans == sorted(spans) and {s[0] for s in spans} == {2, 9, 10, 100} and all(s[3] == 0 for s in spans)
        text = d.normal(f"{passage} and then {passage}")
        assert all(text[a:b] == d.normal(passage) for _, a, b, _ in spans)
    assert d.scan(docs.limit(0), bench, ["doc_id"]).count() == 0
    assert {r.n_items for r in d.scan(docs, bench.limit(0), ["doc_id"]).collect()} == {0}
    assert np.array_equal(d.codes_of("aé"), [97, 233])


def test_a_block_is_written_before_those_after_the_next_are_collected(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"passage {i} of the benchmark with words enough") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"Says: passage {i} of the benchmark with words enough.") for i in range(3)], "doc_id long, text string")
    events, blocks = [], d.passage_blocks

    def watched(*args):
        for block in blocks(*args):
            events.extend(["collected"] * bool(block))
            yield block

    write = d.materialize
    monkeypatch.setattr(d, "passage_blocks", watched)
    monkeypatch.setattr(d, "materialize", lambda df: events.append("written") or write(df))
    got = {r.doc_id: r["items"].split(",") for r in d.scan(docs, bench, ["doc_id"], block_chars=600).collect()}
    assert all(str(i) in got[i] for i in range(3))
    ahead = [events[: k + 1].count("collected") - events[: k + 1].count("written") for k in range(len(events))]
    assert events.count("written") == events.count("collected") > 3 and max(ahead) == 2

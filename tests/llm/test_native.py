"""Mixing and perspective rotation."""

import random
import re
from collections import defaultdict

from tidegraph.llm import chat, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """sizes: source -> words, in rank order; targets by repeated resharing."""
    total, names = sum(sizes.values()), list(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {**share, **capped}
        capped.update({s: 3 * sizes[s] for s in over})


def test_mix(spark):
    rng = random.Random(4)
    rows = [(None, None, "tiny"), (3, "w " * 20_000, "hot"), (1, "", "b"), (2, "one two\tthree\x85four", "tiny"), (7, "x y z " * 9, None), (7, "x y z " * 9, None), (8, "", "wordless")]
    for i in range(300):
        rows.append((100 + i, " ".join(["w"] * rng.randrange(1, 90)), rng.choice(["a", "é", "hot", "hot", "hot", "b"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as shard")
    outs = [mixing.mix(d, docs_per_shard=40, seed=s).collect() for d, s in ((docs, 20), (docs.repartition(7), 20), (docs, 21))]
    flat = [sorted((r.doc_id or 0, r.size, r.source or "~", r.taken) for r in o) for o in outs]
    assert flat[0] == flat[1] != flat[2] and len(flat[0]) == len(rows)
    sizes = defaultdict(int)
    for d, t, s in sorted(rows, key=lambda r: (r[2] is None, r[2] or "")):
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in outs[0]:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 2, s
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rows_without_an_id_are_spread(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text", "'s' as source")
    sizes = [r["count"] for r in mixing.mix(docs, docs_per_shard=100).groupBy("shard").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 160
    assert mixing.mix(docs, docs_per_shard=100, most_shards=8).select("shard").distinct().count() == 8


def test_seats_are_sainte_lague(spark):
    rng = random.Random(2)
    for seats in (0, 1, 7, 100, 1001):
        votes = {f"p{i}": rng.randrange(1, 1000) for i in range(12)}
        total = sum(votes.values())
        df = spark.createDataFrame([(p, v, seats * v / total, seats, 10**6) for p, v in votes.items()], "p string, votes long, share double, seats long, most long")
        got = {r.p: r.won for r in mixing.highest_quotients(df, [], "votes", "share", "seats", "most", [mixing.F.col("p")]).collect()}
        quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() for k in range(seats)))[:seats]
        assert got == {p: sum(q == p for _, q in quotients) for p in votes}


def plain_perspectives(rows, size=512):
    out = []
    by = defaultdict(list)
    for i, (c, turn, role, text) in enumerate(rows):
        by[c if c is not None else f"lone {i}"].append((turn, role, text))
    order = lambda t: (t[0] is None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or "")
    for c, turns in by.items():
        turns = sorted(turns, key=order)
        for who in {r for _, r, _ in turns if r not in (None, "system")}:
            offset = 0
            for part in range(0, len(turns), size):
                some, text, mask, n = turns[part : part + size], "", [], 0
                for _, role, said in some:
                    name = "assistant" if role == who else "system" if role == "system" else "user" + ("" if role is None else f" name={role}")
                    text += f"<|im_start|>{name}\n"
                    a = len(text)
                    text += (said or "") + "<|im_end|>\n"
                    if role == who:
                        mask.append(f"{a}:{len(text)}")
                        n += 1
                out.append((-1 if isinstance(c, str) else c, who, part // size, len(some), n, text, ",".join(mask), offset))
                offset += len(text)
    return sorted(out)


def perspectives(df, **options):
    return sorted((-1 if r.conv_id is None else r.conv_id, r.perspective, r.part, r.n_turns, r.n_masked, r.text, r["mask"], r.offset) for r in chat.rotate_perspectives(df, **options).collect())


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "bob", "later"), (1, 2, None, "who"), (1, 600, "ann", "far"), (1, 1, "ann", "hé"), (2, 0, "system", "alone"), (None, 5, "", "x"), (3, -1, "user", "neg"), (3, 0, "assistant", "ok"), (4, None, "a", "x")]
    rows += [(4, None, "a", "x")] * 2 + [(4, None, "b", "y"), (4, 7, "b", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as perspective", "1 as part", "2 as n", "true as loose", "3 as at", "9 as offset")
    assert perspectives(df) == plain_perspectives(rows)
    assert chat.rotate_perspectives(df.limit(0)).count() == 0


def test_large_conversations_are_cut_by_rows_and_keep_copies(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice((None, 1, 1, 2, rng.randrange(9))), rng.choice("abc"), rng.choice(("x", "y", None))) for c in (1, 1, 1, None, None, 2) for _ in range(40)]
    rows += [(5, 3, "a", "the same")] * 100 + [(5, 3, "b", "z"), (6, 1, "a", "m"), (6, 1, "b", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for d in (df, df.repartition(5)):
        assert perspectives(d, turns_per_part=7) == plain_perspectives(rows, 7)


def test_parts_are_slices_of_the_whole_dialogue(spark):
    rows = [(1, i if i < 1000 else None, "ab"[i % 2], f"turn {i}") for i in range(1300)] + [(2, None, "ab"[i % 2], f"t{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.rotate_perspectives(df).collect()
    for who in "ab":
        parts = sorted((r for r in got if r.conv_id == 1 and r.perspective == who), key=lambda r: r.part)
        assert [r.n_turns for r in parts] == [512, 512, 276]
        (whole,) = [x for x in plain_perspectives(rows, 10_000) if x[:2] == (1, who)]
        assert "".join(r.text for r in parts) == whole[5]
        spans = [f"{int(a) + r.offset}:{int(b) + r.offset}" for r in parts for a, b in (m.split(":") for m in r["mask"].split(","))]
        assert ",".join(spans) == whole[6]
    (ours,) = [r for r in got if r.conv_id == 2 and r.perspective == "a"]
    assert re.findall(r"t\d", ours.text) == [f"t{i}" for i in (0, 2, 4, 6, 1, 3, 5, 7)]  # by role, as no number orders them


def test_rows_without_an_id_stay_linear(spark):
    made = lambda n: spark.range(n).selectExpr("cast(null as long) as conv_id", "id as turn", f"concat('role ', id % {n // 10}) as role", "'some words' as text")
    size = [sum(len(r.text) for r in chat.rotate_perspectives(made(n)).collect()) for n in (1500, 3000)]
    assert abs(size[1] - 2 * size[0]) < 0.01 * size[0]

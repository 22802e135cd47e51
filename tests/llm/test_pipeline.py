import os

import corpus_pipeline as cp
import pytest

from tidegraph.llm import decontam, pii, simhash
from tidegraph.llm.common import PLACE, with_place
from tidegraph.storage import scratch, shared_dir


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    import random

    rng = random.Random(1)
    path = str(tmp_path_factory.mktemp("sf"))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(30)
    rows, labels = [], []
    for i in range(120):
        text = prose(100) if i % 6 else " ".join([word() + "%%%"] * 90)
        rows.append((i, text))
        labels.append((i, int(i % 6 > 0), 0))
    base = prose(100).split()
    rows += [(200, " ".join(base)), (201, " ".join(base)), (202, " ".join(base[:50] + ["new"] + base[51:])), (203, prose(40) + " " + passage.upper() + " " + prose(40)), (204, prose(60) + " write to a.b@mail.example.org now " + prose(30)), (205, None), (206, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, prose(30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[:5] == cp.COLUMNS
    start, good, single, clean, private, mixed = seen
    junk = {i for i in range(0, 120, 6)}
    assert good.keys() & junk == set() and set(range(120)) - junk <= good.keys() and {200, 201, 202, 203, 204} <= good.keys()
    sets = {i: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for i, r in good.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert not any(alike(a, b) for a in single for b in single if a < b)
    assert all(any(alike(a, b) for b in single) for a in good.keys() - single.keys()) and single.keys() & {200, 201, 202} == {200}
    bench = [decontam.normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert single.keys() - clean.keys() == {i for i, r in single.items() if any(b in decontam.normal(r.text or "") for b in bench)} == {203}
    assert private.keys() == clean.keys() and "[EMAIL]" in private[204].text and private[204].n_chars == len(private[204].text)
    assert all(not any(pii.base_spans(r.text or "").values()) for r in private.values())
    assert all(private[i] == clean[i] for i in private if i != 204)
    assert mixed.keys() <= private.keys() and all(0 < r.taken <= 3 * r.size for r in mixed.values())
    assert sum(r.taken for r in mixed.values()) == pytest.approx(sum(len((r.text or "").split()) for r in private.values()), rel=0.03)


def test_run_is_the_stages(spark, folder):
    assert {"doc_id", "text", "taken"} <= set(cp.run(spark, folder).columns) and cp.ORACLE_SQL is None


def test_places_outlive_executors(spark, tmp_path):
    spark.range(4000).repartition(16).write.parquet(str(tmp_path / "many"))
    cores, seen, docs = "spark.sql.leafNodeDefaultParallelism", [], spark.read.parquet(str(tmp_path / "many"))
    try:
        for n in (8, 2):  # scans are planned for so many cores
            spark.conf.set(cores, n)
            seen.append({(r[PLACE[0]], r[PLACE[1]]): r.id for r in with_place(docs.select("id")).collect()})
    finally:
        spark.conf.unset(cores)
    assert seen[0] == seen[1] and len(seen[0]) == 4000
    assert len({tuple(r) for r in with_place(spark.range(50, numPartitions=7)).select(*PLACE).collect()}) == 50


def test_run_on_odd_rows(spark, folder, tmp_path):
    rng = __import__("random").Random(8)
    long = " ".join("".join(rng.choices("etaoinshr", k=6)) for _ in range(60_000))
    rows = [(1, long, "en", "a", None), (1, long, "en", "a", None), (None, long[:900], None, None, 3), (None, None, None, "b", 0), (4, "", "en", "", 0), (4, "  ", "en", "b", 2)]
    path = str(tmp_path / "odd")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'q' as size", "7 as row_id", "'z' as taken", "8 as group", "9 as clean")
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    shared = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    with scratch():
        got = cp.run(spark, path).collect()
        assert len(set(os.listdir(shared)) - before) == 1  # the result's table
    assert set(os.listdir(shared)) == before
    assert sum(r.text == long for r in got) <= 1 and all(r.size > 0 and 0 < r.taken <= 3 * r.size for r in got)
    docs.limit(0).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    with scratch():
        assert cp.run(spark, path).count() == 0

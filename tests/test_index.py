"""Exact selection, sketches, positional postings, inverted vector files and fuzzy terms against plain loops."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import positions, search, selection, sketches, vector
from cairn.plans import queries_index


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(selection, "FEW", 20)
    monkeypatch.setattr(selection, "RANGES", 8)


def test_percentiles_of_groups_with_frequent_values(spark, few):
    rnd = random.Random(2)
    rows = [("a", rnd.choice([5.0, 5.0, 5.0, rnd.gauss(0, 1), rnd.expovariate(1e-6)])) for _ in range(700)] + [("b", float(i)) for i in range(101)] + [("c", 1.5), (None, 2.0), (None, 4.0), ("d", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.percent): r.value for r in selection.percentiles(df, "v", [0, 25, 50, 99, 100], ["k"]).collect()}
    for k in ("a", "b", "c", None):
        values = [v for kk, v in rows if kk == k and v is not None and v == v]
        for p in (0, 25, 50, 99, 100):
            assert got[k, p] == pytest.approx(np.percentile(values, p))
    assert len(got) == 20


def test_percentiles_beside_infinite_values(spark, few):
    values = [float("-inf")] * 30 + [float(i) for i in range(200)] + [float("inf")] * 40
    got = {r.percent: r.value for r in selection.percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0, 20, 50, 70, 100]).collect()}
    ranked = sorted(values)
    for p, v in got.items():
        at = p / 100 * 269
        a, b = ranked[int(at)], ranked[min(int(at) + 1, 269)]
        assert v == pytest.approx(a if a == b else a + (b - a) * (at - int(at)))


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert selection.percentiles(df, "v", [50]).count() == 0


def test_sketches_merge_over_days_and_keep_their_bound(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 7_000).alias("user"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 3).alias("kind"))
    sketches.daily(df, "ts", ["kind"], "user").write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    told = {r.kind: r.distinct for r in sketches.distinct(stored, ["kind"]).collect()}
    exact = {r.kind: r.n for r in df.groupBy("kind").agg(F.countDistinct("user").alias("n")).collect()}
    assert all(abs(told[k] - n) <= 0.05 * n for k, n in exact.items())
    part = sketches.distinct(stored, ["kind"], F.col("day") <= F.lit("1970-01-02").cast("date")).collect()
    assert all(abs(r.distinct - 960) <= 48 for r in part)
    assert set(stored.columns) == {"day", "kind", "sketch", "rows"} and "user" not in sketches.distinct(stored, ["kind"])._jdf.queryExecution().executedPlan().toString()


def test_phrases_from_positions(spark, tmp_path):
    texts = {1: "To be, or not to be: that is", 2: "not to be seen", 3: None, 4: "", 5: "be to be to be", 6: "À bientôt à bientôt", 7: "to be to"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    positions.write_index(docs, f"{tmp_path}/p")
    asked = spark.createDataFrame([(1, "to be"), (2, "be to be"), (3, "?!"), (4, "à bientôt"), (5, "absent words"), (6, "to be"), (7, "seen")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.found for r in positions.phrase_matches(spark, f"{tmp_path}/p", asked).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (1, 5): 2, (1, 7): 1, (6, 1): 2, (6, 2): 1, (6, 5): 2, (6, 7): 1, (2, 5): 2, (4, 6): 2, (7, 2): 1}
    plan = positions.phrase_matches(spark, f"{tmp_path}/p", asked.where("query_id = 7"))
    assert len({f.split("folder=")[1].split("/")[0] for f in plan.inputFiles()}) <= positions.FOLDERS
    read = spark.read.parquet(f"{tmp_path}/p").where(F.col("folder").isin([spark.range(1).select(positions.folder_of(F.lit("seen"))).first()[0]]))
    assert {r.term for r in read.select("term").distinct().collect()} < {w for t in texts.values() for w in (t or "").lower().replace(",", "").replace(":", "").split()}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_terms_equal_a_scan(spark):
    rnd = random.Random(9)
    terms = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(150)} | {"abba" * 30, "abba" * 29 + "abb", "abba" * 29 + "axbba", "ürger", "ürgen", "a", "ab"}
    asked = rnd.sample(sorted(terms), 40) + ["abba" * 30, "ürge", "ac", ""]
    got = search.fuzzy_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query_id int, term string"))
    allowed = lambda t: 0 if len(t) <= 2 else 1 if len(t) <= 5 else 2
    want = {(i, a, t, edits(a, t)) for i, a in enumerate(asked) for t in terms if a[:2] == t[:2] and edits(a, t) <= allowed(a)}
    rows = [tuple(r) for r in got.select("query_id", "asked", "term", "edits").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_inverted_file_recall_and_pruning(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 5, (8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(0, 1, 16)).tolist()) for i in range(800)] + [(9000 + i, [0.0] * 16) for i in range(5)] + [(9999, None)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = vector.inverted_file(corpus, f"{tmp_path}/c", cells=8, block=30)
    assert cells.agg(F.sum("rows")).first()[0] == 805 and cells.agg(F.max("blocks")).first()[0] > 1
    queries = corpus.where("vec_id % 50 = 0 AND vec_id < 800")
    found = vector.probe(queries, f"{tmp_path}/c", cells, 10, 200, same=True)
    exact = vector.nearest_join(queries, corpus.where("embedding IS NOT NULL"), 10, same=True)
    assert exact.join(found, ["query_id", "id"]).count() >= 0.9 * exact.count()
    one = vector.probe(queries.where("vec_id = 50"), f"{tmp_path}/c", cells, 3, 50)
    assert "cell" in one._jdf.queryExecution().executedPlan().toString() and one.where("query_id = id AND rank = 1").count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_inverted_file_recall_on_the_larger_table(spark):
    assert queries_index.v3_recall(spark, "/root/testdata/sf0.1").first().enough

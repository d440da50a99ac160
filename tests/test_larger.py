"""What showed on larger tables only: results that hang on the order of blocks, and the rows that plans hold or send."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.operators import overlap, positions, vector
from cairn.plans import queries_named, queries_relational


def test_a_city_is_not_above_itself(spark, small, monkeypatch):
    """Means that come out otherwise each time they are taken, as sums of doubles do on a cluster."""
    noisy = F.udf(lambda x: x + random.random(), "double").asNondeterministic()
    real = queries_relational.listings
    monkeypatch.setattr(queries_relational, "listings", lambda s, d: real(s, d).withColumn("price", noisy("price")))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        rows = queries_relational.j10_gaps(spark, small).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert rows and all(r.a != r.b for r in rows)
    assert len({frozenset((r.a, r.b)) for r in rows}) == len(rows)


def brute(held, least):
    items = sorted(held)
    return {(a, b, len(held[a] & held[b])) for i, a in enumerate(items) for b in items[i + 1 :] if len(held[a] & held[b]) >= least}


def test_sets_as_bits_give_the_pairs_and_lists_of_sets_too(spark, monkeypatch):
    rnd = random.Random(8)
    held = {i: frozenset(rnd.sample(range(overlap.BITS), rnd.randint(1, 9))) for i in range(150)} | {500: frozenset(range(12)), 501: frozenset(range(50, overlap.BITS))}
    facts = spark.createDataFrame([(i, f) for i, fs in held.items() for f in fs] * 2 + [(None, 3), (7, None)], "i long, f int")
    bits = overlap.feature_bits(facts, "f")
    sets = overlap.bit_sets(facts, "i", "f", bits)
    monkeypatch.setattr(overlap, "PAIRS_PER_TASK", 100)
    least = {fs: min(i for i, x in held.items() if x == fs) for fs in held.values()}
    want = {x for x in brute({v: k for k, v in least.items()}, 2)}
    for form in (sets, overlap.feature_sets(facts, "i", "f")):
        pairs = overlap.class_pairs(overlap.classes(form), 2)
        assert sorted(tuple(r) for r in pairs.collect()) == sorted(want)
        assert {(r.item, r.n) for r in form.select("item", overlap.count_of(form).alias("n")).collect()} == {(i, len(fs)) for i, fs in held.items()}
    assert pairs.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism  # by the pairs, not by the few rows that make them
    assert overlap.feature_bits(spark.range(overlap.BITS + 1), "id") is None


def test_phrases_meet_by_their_rarest_term_without_a_shuffle_of_the_texts(spark, tmp_path):
    rnd = random.Random(5)
    texts = [(i if i else None, " ".join(rnd.choice(["the", "of", "the", f"w{i % 40}"]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = [(1, "the of the"), (2, "the the the the"), (3, "of w7 the"), (4, "w7 of"), (5, "the gone"), (6, "of"), (7, "w0 the")]
    positions.write_index(docs, f"{tmp_path}/p")
    got = positions.phrase_matches(spark, f"{tmp_path}/p", spark.createDataFrame(asked, "query_id long, text string"))
    times = lambda t, q: sum(t[i : i + len(q)] == q for i in range(len(t) - len(q) + 1))
    want = {(k, i, times(t.split(), q.split())) for k, q in asked for i, t in texts if times(t.split(), q.split())}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and any(i is None for _, i, _ in rows)
    plan = positions.postings(spark.read.parquet(f"{tmp_path}/p").select("doc_id", F.col("term").alias("text")), "doc_id", "text")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_postings_of_rows_of_one_batch():
    batch = positions.grouped(pa.array([7, 8, 9]), pa.array(["b", "a", "b", "a", "b", "b"]), np.array([3, 1, 2]))
    assert [tuple(r.values()) for r in batch.to_pylist()] == [(7, "b", [0, 2]), (9, "b", [0, 1]), (7, "a", [1]), (8, "a", [0])]


def test_best_rows_equal_a_full_sort():
    rng = np.random.default_rng(2)
    c, q = np.round(rng.normal(size=(3000, 3)), 1), np.round(rng.normal(size=(40, 3)), 1)
    c[100:2000], c[5], q[3] = c[100], 0, 0  # a very common row, and zeros
    ci, qi = np.arange(3000) * 2, np.arange(40) * 2
    cs, qs = rng.integers(0, 50, (3000, 2)), rng.integers(0, 50, (40, 2))
    for same, marks in ((False, False), (True, False), (True, True)):
        row, at, score = vector.best_rows(q, qi, c, ci, 6, same, *((qs, cs) if marks else ()))
        for i in range(40):
            made = q[i] @ c.T
            may = [j for j in range(3000) if not (same and ci[j] == qi[i]) and (not marks or (qs[i] == cs[j]).any())]
            want = sorted(may, key=lambda j: (-round(made[j], 9), j))[:6]
            assert list(at[row == i]) == want and np.allclose(score[row == i], made[want])


def test_buckets_and_vectors_are_sent_once_for_each_part(spark, monkeypatch):
    """Before, each pair of blocks had its vectors, each candidate its two, and each block of a cell every query."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 4)))] + [(900, [0.0] * 4), (950, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(vector, "HELD", 400 * 4 * 8 // 6)
    got = {(r.query_id, r.id): r.score for r in vector.nearest_join(df.where("vec_id % 50 = 0"), df, 3, same=True, distance=True).collect()}
    unit = {i: np.array(v, np.float32).astype(float) / (np.linalg.norm(np.array(v, np.float32).astype(float)) or 1) for i, v in rows if v}
    for a in (i for i in unit if i % 50 == 0):
        best = sorted(((1 - ((unit[a] - unit[b]) ** 2).sum() / 2, -b) for b in unit if b != a), key=lambda x: (round(x[0], 9), x[1]), reverse=True)[:3]
        assert {b for x, b in got if x == a} == {-b for _, b in best} and all(abs(got[a, -b] - x) < 1e-9 for x, b in best)
    parts = vector.nearest_join(df.where("vec_id % 50 = 0"), df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in parts and vector.parts_for(402, 4, 1) >= 6


def test_near_points_do_not_go_through_the_driver(spark, small):
    plan = queries_named.g14_near_by(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

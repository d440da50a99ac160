"""The factorisation machine against sums over all pairs, and its held-out labels."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import machine


def random_rows(rng, n, size):
    owner = np.repeat(np.arange(n), rng.integers(1, 7, n))
    return owner, rng.integers(0, size, len(owner)), rng.normal(0, 1, len(owner))


def random_machine(rng, size):
    return machine.Machine(0.3, rng.normal(0, 1, size), rng.normal(0, 1, (size, machine.FACTORS)), [])


def brute_logit(m, features):
    """Bias, weights, and every pair of the row's features by the product of their vectors."""
    out = m.bias + sum(m.weights[i] * x for i, x in features)
    return out + sum(m.vectors[i] @ m.vectors[j] * x * y for k, (i, x) in enumerate(features) for j, y in features[k + 1 :])


def test_logits_are_sums_over_all_pairs():
    rng = np.random.default_rng(1)
    m, (owner, index, value) = random_machine(rng, 40), random_rows(rng, 50, 40)
    want = [brute_logit(m, [(i, x) for o, i, x in zip(owner, index, value, strict=True) if o == k]) for k in range(50)]
    assert np.allclose(m.logits(owner, index, value, 50), want)


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    m, (owner, index, value) = random_machine(rng, 12), random_rows(rng, 20, 12)
    m.weights, m.vectors = m.weights * 0.2, m.vectors * 0.2
    y, weight = rng.integers(0, 2, 20).astype(float), rng.uniform(0.5, 2, 20)

    def loss():
        z = m.logits(owner, index, value, 20)
        return float(((np.logaddexp(0, z) - y * z) * weight).sum() / weight.sum())

    gb, names, gw, gv = machine.gradients(m, owner, index, value, y, weight)
    step = 1e-6
    for table, grads in ((m.weights, gw), (m.vectors, gv)):
        for k, name in enumerate(names):
            at = (name,) if table.ndim == 1 else (name, 3)
            was = table[at]
            table[at] = was + step
            up = loss()
            table[at] = was - step
            down = loss()
            table[at] = was
            assert abs((up - down) / (2 * step) - (grads[k] if table.ndim == 1 else grads[k, 3])) < 1e-6
    m.bias += step
    up = loss()
    m.bias -= 2 * step
    assert abs((up - loss()) / (2 * step) - gb) < 1e-6


def test_statistics_of_a_text():
    text = "One two two 3!!\nSTOP ## stop.\nSTOP ## stop.\n\n"
    owner, bucket, count, stats = machine.features([text, None, ""])
    got = dict(zip(machine.STATISTICS, stats[0], strict=True))
    assert owner.tolist() == [0] * len(owner) and count.sum() == 10 and len(bucket) == 5  # one, two, 3, stop, and the empty core of ##
    assert got["words"] == np.log1p(10) and np.isclose(got["upper"], 0.2) and np.isclose(got["with_symbol"], 0.2) and np.isclose(got["digits"], 0.1)
    assert np.isclose(got["ends"], 0.3) and np.isclose(got["exclaims"], 0.1) and np.isclose(got["repeats"], 0.1) and np.isclose(got["same_lines"], 1 / 3)
    assert not stats[1].any() and not stats[2].any()


def test_held_out_labels_of_the_small_tables(spark, small):
    got = machine.op12_quality_machine(spark, small)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    right = [rows[x.doc_id].predicted == x.quality for x in labels if rows[x.doc_id].held_out]
    assert sum(right) >= 0.9 * len(right) > 0


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_chars long, quality int, quality_score string, _text string"
    good = [(i, f"Plain words number {i} make a calm sentence here.", 40, 1, "x", "y") for i in range(60)]
    bad = [(100 + i, f"$$$ ### BUY{i}!! NOW!! ### $$$", 20, 0, "x", "y") for i in range(60)]
    odd = [(None, None, None, None, None, None), (5, "", 0, None, "x", "y"), (5, "", 0, None, "x", "y"), (6, "calm sentence. " * 200_000, None, None, "x", "y")]
    df = spark.createDataFrame(good + bad + odd, schema)
    model = machine.fit(df)
    rows = machine.score_quality(df, model).collect()
    assert len(rows) == 124 and set(rows[0].asDict()) == set(df.columns)
    assert all((r.quality_score >= 0.3) == (r.quality == 1) for r in rows if r.quality is not None)
    assert len({r.quality_score for r in rows if r.doc_id == 5 and r.text == ""}) == 1 and rows[0]._text == "y"
    assert machine.score_quality(df.limit(0), model).count() == 0
    assert {round(r.quality_score, 3) for r in machine.score_quality(df, machine.fit(df.where("quality = 1"))).collect()} == {0.993}
    assert machine.score_quality(df, machine.fit(df.limit(0))).where(F.col("quality_score") < 0.3).count() == 0


def test_the_driver_gets_a_bounded_sample(spark):
    df = spark.createDataFrame([(i, f"word{i} and more", 9, i % 2) for i in range(400)], "doc_id long, text string, n_chars long, quality int")
    seen = []
    kept = machine.train
    machine.train = lambda owner, bucket, count, numbers, y, **k: seen.append(y) or kept(owner, bucket, count, numbers, y, **k)
    try:
        machine.fit(df, max_rows=40)
    finally:
        machine.train = kept
    assert [int((seen[0] == k).sum()) for k in (0, 1)] == [20, 20]

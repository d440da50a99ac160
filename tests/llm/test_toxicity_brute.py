"""Scores of whole texts against the network written as plain loops over numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import toxicity

RUDE = ["vile", "rotten", "filth"]


def text(rnd, n, rude=False):
    words = [rnd.choice("calm green river stone walks under many old trees while birds sing".split()) for _ in range(n)]
    if rude:
        for _ in range(3):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice(RUDE))
    return " ".join(words)


def brute_score(model, body):
    """One window after another, one word after another, one number after another."""
    words = toxicity.WORDS.findall((body or "").lower())
    if not words:
        return 0.0
    w = {k: v.astype(float).tolist() for k, v in model.weights.items() if k not in ("words", "chars")}
    h, sig = toxicity.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    inputs = {x: model.inputs([x])[0].astype(float).tolist() for x in set(words)}
    times = lambda row, table: [sum(a * b for a, b in zip(row, col, strict=True)) for col in zip(*table, strict=True)]

    def states(window, side):
        out, state = [], [0.0] * h
        for x in window if side == "f" else window[::-1]:
            px, ph = times(inputs[x], w[f"x{side}"]), times(state, w[f"h{side}"])
            z, r = [sig(px[k] + ph[k]) for k in range(h)], [sig(px[h + k] + ph[h + k]) for k in range(h)]
            new = [math.tanh(px[2 * h + k] + r[k] * ph[2 * h + k]) for k in range(h)]
            state = [z[k] * state[k] + (1 - z[k]) * new[k] for k in range(h)]
            out.append(state)
        return out if side == "f" else out[::-1]

    best, first = -math.inf, 0
    while True:
        window = words[first : first + toxicity.WINDOW]
        both = [a + b for a, b in zip(states(window, "f"), states(window, "b"), strict=True)]
        e = [sum(q * math.tanh(u) for q, u in zip(w["query"], times(s, w["att"]), strict=True)) for s in both]
        a = [math.exp(x - max(e)) for x in e]
        pooled = [sum(p * s[k] for p, s in zip(a, both, strict=True)) / sum(a) for k in range(2 * h)]
        best = max(best, sum(p * o for p, o in zip(pooled, w["out"], strict=True)) + w["bias"][0])
        if first + toxicity.WINDOW >= len(words):
            return sig(best + model.shift)
        first += toxicity.STRIDE


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return toxicity.train([(text(rnd, rnd.randint(5, 90), y), int(y)) for y in [True, False] * 60], rounds=3)


def test_scores_equal_plain_loops(model):
    rnd = random.Random(2)
    texts = [text(rnd, n, n % 3 == 0) for n in (1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 64, 65, 200)] + [None, "", "?!", "Ünïcode wörds 7 vile"]
    got = toxicity.Scorer(model).score(texts)
    assert np.allclose(got, [brute_score(model, t) for t in texts], atol=2e-5)


def test_query_over_odd_rows(spark, model, tmp_path):
    rnd = random.Random(3)
    rows = [(i, text(rnd, 20, i % 2 == 0)) for i in range(20)] + [(None, None), (5, ""), (5, ""), (6, text(rnd, 30_000) + " vile rotten filth")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, toxicity string")
    out = toxicity.score_toxicity(df, model)
    assert set(out.columns) == {"doc_id", "text", "toxicity", "toxic_predicted"}
    got = out.collect()
    assert len(got) == len(rows) and [r.toxicity for r in got if r.text in (None, "")] == [0.0] * 3
    assert next(r.toxicity for r in got if r.doc_id == 6 and r.text and len(r.text) > 1000) == pytest.approx(brute_score(model, rows[-1][1]), abs=1e-4)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_long_rows_train_by_a_slice(spark):
    rnd = random.Random(4)
    rows = [(i, text(rnd, 400, i % 2 == 0), i % 2) for i in range(30)] + [(100 + i, "x" * 9 + " " + text(rnd, 4000), 0) for i in range(3)]
    seen, kept = [], toxicity.train
    toxicity.train = lambda rows, **k: seen.append(rows) or kept(rows[:4], rounds=1)
    try:
        toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), max_chars=500)
    finally:
        toxicity.train = kept
    assert len(seen[0]) == 33 and {len(t) for t, y in seen[0] if not y} == {500} and all(500 < len(t) <= 5000 for t, y in seen[0] if y)
    assert toxicity.score_toxicity(spark.createDataFrame([("a",)], "text string"), kept([])).select(F.max("toxicity")).first()[0] < 0.5

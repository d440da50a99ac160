"""Semantic chunks and vectors of texts against plain loops."""

import re
import zlib

import numpy as np
import pytest

from cairn.functions import text
from cairn.operators import chunks, filters, vector
from cairn.plans import registry
from pyspark.sql import functions as F


def brute_chunks(body, percentile, buffer):
    parts = [s for s in re.split(r"(?<=[.!?])\s+", body or "") if s.strip()]
    vectors = []
    for i in range(len(parts)):
        v = np.zeros(64)
        for s in parts[max(0, i - buffer) : i + buffer + 1]:
            for w in s.lower().split():
                v[zlib.crc32(w.encode()) % 64] += 1
        vectors.append(v / max(np.linalg.norm(v), 1e-9))
    gaps = [1 - a @ b for a, b in zip(vectors, vectors[1:])]
    cut = np.quantile(gaps, percentile) if gaps else 0
    out = []
    for i, s in enumerate(parts):
        if i == 0 or gaps[i - 1] > cut + 1e-12:
            out.append([])
        out[-1].append(s)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("buffer", [0, 1, 2])
def test_semantic_chunks(spark, buffer):
    body = "Cats sleep all day. Cats eat fish. Cats purr. The stock fell. The stock rose again! Markets closed. Rain is wet? Rain is cold."
    rows = [(1, body), (2, None), (3, ""), (4, "One."), (5, "A b c. " * 5 + "Quite another thing here. " + "A b c. " * 4)]
    got = {}
    for r in chunks.by_distance(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 0.6, buffer).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {k: c for k, t in rows if (c := brute_chunks(t, 0.6, buffer))}


def test_vectors_from_a_given_model(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in vector.embed_with(df, "text", lambda texts: [[len(t), 1.0] for t in texts]).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_default_vectors_are_of_unit_length_and_repeat(spark, small):
    run = registry.queries()["v14_embed"]
    a, b = ({r.doc_id: r.digest for r in run(spark, small).collect()} for _ in range(2))
    assert a == b and len(set(a.values())) > 100
    one = vector.embed(spark.createDataFrame([("a b b",)], "text string"), "text").first().embedding
    assert sum(x * x for x in one) == pytest.approx(1.0, abs=1e-5)


def test_pages_say_how_many_rows_there_are(spark):
    got = filters.page(spark.range(250), [F.desc("id")], 10, 150).collect()
    assert [r.id for r in got] == list(range(239, 89, -1)) and {r.total for r in got} == {250}
    assert spark.range(1).select(text.folded(F.lit("naïve")).alias("x")).first().x == "naive"

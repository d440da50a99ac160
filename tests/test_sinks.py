"""Bucketed merges, dead letters, layers, frequent sets."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import evaluate, graph
from cairn.plans import medallion
from cairn.sources import files, merge, sinks

def stored(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_merges_write_only_changed_buckets_and_repeat_themselves(spark, tmp_path):
    schema, newest = "k long, t long, v string", [F.desc_nulls_last("t")]
    path = str(tmp_path / "m")
    first = spark.createDataFrame([(k, 0, "a") for k in range(200)] + [(None, 0, "n")], schema)
    assert len(merge.merge(first, 0, path, ["k"], newest, 16)) == 16
    before = stored(tmp_path / "m" / "data")
    change = spark.createDataFrame([(3, 1, "b"), (3, 2, "c"), (4, -1, "late"), (500, 1, "new"), (None, 1, "m")], schema)
    changed = merge.merge(change, 1, path, ["k"], newest, 16)
    assert len(changed) <= 4
    after = stored(tmp_path / "m" / "data")
    assert all(after[f] == t for f, t in before.items()) and {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)} == set(map(str, changed))
    want = {(k, "a") for k in range(200) if k != 3} | {(3, "c"), (500, "new"), (None, "m")}
    rows = lambda: sorted(map(repr, ((r.k, r.v) for r in merge.current(spark, path, first.schema).collect())))
    assert rows() == sorted(map(repr, want))
    assert merge.merge(change, 1, path, ["k"], newest, 16) == changed and rows() == sorted(map(repr, want))
    for number in range(2, 6):
        merge.merge(spark.createDataFrame([(3, 10 + number, f"v{number}")], schema), number, path, ["k"], newest, 16)
    assert rows() == sorted(map(repr, (want - {(3, "c")}) | {(3, "v5")}))
    kept = {f.split("data/")[1].rsplit("/", 1)[0] for f in stored(tmp_path / "m" / "data")}
    assert len(kept) <= 2 * 16
    assert merge.merge(change.limit(0), 9, path, ["k"], newest, 16) == []


def test_a_table_that_is_not_there_is_empty(spark, tmp_path):
    assert merge.current(spark, str(tmp_path / "none"), spark.createDataFrame([], "k long").schema).count() == 0


def test_rejected_rows_are_kept_with_their_reasons(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0, "x"), (None, 7.0, "y"), (3, None, None), (4, -1.0, "z"), (5, 2.0, None)], "id long, price double, name string")
    seen = sinks.write_documents(df, str(tmp_path / "d"), "id", {"name": F.col("name")}, {"price": F.col("price") > 0}, {"name": "?"})
    assert seen == {"rows_in": 5, "rows_out": 2, "rejected": 3, "reason_key": 1, "reason_price": 2}
    rows = spark.read.parquet(str(tmp_path / "d")).collect()
    assert {(r._id, r.doc.name) for r in rows if r.part == "accepted"} == {("1", "x"), ("5", "?")}
    assert sorted((tuple(r.reasons), json.loads(r.raw).get("id", 0)) for r in rows if r.part == "rejected") == [(("key",), 0), (("price",), 3), (("price",), 4)]
    none = sinks.write_documents(df.limit(0), str(tmp_path / "e"), "id", {"name": F.col("name")}, {})
    assert none == {"rows_in": 0, "rows_out": 0, "rejected": 0, "reason_key": 0}


def test_layers_lose_no_row_unsaid(spark, small, tmp_path):
    seen = medallion.run(spark, small, str(tmp_path), 5000.0)
    assert seen["bronze/listings"]["rows"] == seen["silver/listings"]["rows"] + seen["rejected/listings"]["rows"] > 0
    assert spark.read.parquet(f"{tmp_path}/rejected/listings").where("NOT array_contains(reasons, 'price')").count() == 0
    assert spark.read.parquet(f"{tmp_path}/gold/listings").count() == seen["silver/listings"]["rows"]


@pytest.mark.parametrize("least", [1, 3])
def test_frequent_sets_equal_a_count(spark, least):
    held = {1: "abc", 2: "abcd", 3: "abd", 4: "abc", 5: "cd", 6: "e"}
    facts = spark.createDataFrame([(i, f) for i, fs in held.items() for f in fs] + [(7, None)], "i int, f string")
    want = {}
    for fs in held.values():
        for n in (3, 4):
            for c in itertools.combinations(sorted(fs), n):
                want[c] = want.get(c, 0) + 1
    share = {f: sum(f in fs for fs in held.values()) / len(held) for f in "abcde"}
    got = {tuple(r.features): (r.together, r.lift) for r in graph.frequent_sets(facts, "i", "f", least).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: n for k, n in want.items() if n >= least}
    for k, (n, lift) in got.items():
        chance = 1.0
        for f in k:
            chance *= share[f]
        assert lift == pytest.approx(n / len(held) / chance)


def test_a_relational_table_is_read_in_ranges_of_its_key(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "id long, title string")
    rows.write.jdbc(url, "articles", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    found = files.jdbc(spark, url, "SELECT \"id\", \"title\" FROM articles WHERE \"id\" < 90", '"id"', 0, 90, 3)
    assert found.rdd.getNumPartitions() == 3 and sorted(map(tuple, found.collect())) == [(i, f"t{i}") for i in range(90)]


def test_semantic_grades(spark):
    concepts = spark.createDataFrame([(1, "sea", ["coast", "bay", "bay"]), (2, None, None)], "query_id long, concept string, related array<string>")
    articles = spark.createDataFrame([(1, ["coast", "bay"], ["sea"]), (2, ["bay", "bay"], []), (3, [], ["sea", "sea"]), (4, ["sea"], ["bay"]), (5, None, None)], "doc_id long, categories array<string>, words array<string>")
    assert {(r.query_id, r.doc_id): r.grade for r in evaluate.semantic_grades(concepts, articles).collect()} == {(1, 1): 3, (1, 2): 2, (1, 3): 1}

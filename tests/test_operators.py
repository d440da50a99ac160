"""Rules at their edges, on literals."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cairn.functions import geo, text, vectors
from cairn.operators import checks, chunks, evaluate, facets, filters, graph, html, scores, search, vector
from cairn.plans import queries_graph
from cairn.sources import sinks
from cairn.sources import merge
from cairn.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_null_concat_and_codes(spark):
    assert one(spark, F.concat_ws("", F.lit("a"), F.lit(None), F.lit("b"))) == "ab"
    assert one(spark, text.state_code(F.lit(" california "))) == "CA"
    assert one(spark, text.state_code(F.lit("Zz top"))) == "ZZ"


@pytest.mark.parametrize(("code", "status"), [(None, "missing"), ("123", "invalid"), ("90001", "placeholder"), ("94102", "valid"), ("9410a", "invalid")])
def test_postal_status(spark, code, status):
    assert one(spark, text.postal_status(F.lit(code))) == status


@pytest.mark.parametrize(("name", "bare"), [("Alameda County", "Alameda"), ("alameda county", "alameda"), ("County", "County")])
def test_county_suffix(spark, name, bare):
    assert one(spark, text.without_county_suffix(F.lit(name))) == bare


@pytest.mark.parametrize(("price", "band"), [(499_999.99, "a"), (500_000.0, "b"), (749_999.99, "b"), (750_000.0, "c"), (None, "c")])
def test_ladder(spark, price, band):
    assert one(spark, facets.ladder(F.lit(price).cast("double"), (500_000, 750_000), ("a", "b", "c"))) == band


def test_shingles(spark):
    assert one(spark, text.shingles(F.array(*map(F.lit, "abc")))) == ["a b", "b c", "a b c"]
    assert one(spark, text.shingles(F.array(F.lit("a")))) == []


def test_cosine_edges(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, vectors.cosine(v(0, 0), v(1, 2))) == 0.0
    assert one(spark, vectors.cosine(v(1, 2), v(1, 2))) == pytest.approx(1.0)
    assert one(spark, vectors.cosine(v(1, 2), v(-1, -2))) == pytest.approx(-1.0)


def test_haversine_and_units(spark):
    assert one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.09, abs=0.1)
    assert one(spark, geo.convert(F.lit(1.0), "mi", "km")) == pytest.approx(1.609344)
    assert one(spark, geo.in_box(F.lit(0.0), F.lit(179.0), -1, 170, 1, -170))


def test_latest_with_ties_and_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, None, 1), (1, t, 3), (1, t, 2), (2, None, 5)], "k int, ts timestamp, id int")
    got = {r.k: r.id for r in sinks.latest(df, ["k"], [F.desc_nulls_last("ts"), F.asc("id")]).collect()}
    assert got == {1: 2, 2: 5}


def test_bool_query_defaults(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "s string, n int")
    assert df.where(filters.bool_query(should=[{"term": {"s": "a"}}, {"term": {"s": "z"}}])).count() == 1
    assert df.where(filters.bool_query(must_not=[{"range": {"n": {"gte": 0}}}])).count() == 1


def test_dense_histogram_has_empty_buckets(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (30.0,)], "x double")
    got = {r.bucket: r.doc_count for r in facets.histogram(df, "x", 10, min_doc_count=0, bounds=(0, 30)).collect()}
    assert got == {0.0: 1, 10.0: 1, 20.0: 0, 30.0: 1}


def test_fusion(spark):
    df = lambda rank: spark.createDataFrame([(1, 7, rank)], "query_id long, doc_id long, rank int")
    got = vector.fuse({"a": df(1), "b": df(2)}).first()
    assert got.score == pytest.approx(1 / 61 + 1 / 62)


def test_ndcg_discount_starts_after_rank_two(spark):
    run = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 2, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 1)], "query_id long, doc_id long, grade int")
    import math

    want = (3 + 1 / 1 + 2 / math.log2(3)) / (3 + 2 / 1 + 1 / math.log2(3))
    assert evaluate.per_query(run, qrels, 3).first().ndcg == pytest.approx(want)


def test_metrics_without_relevant(spark):
    run = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)], "query_id long, doc_id long, rank int")
    qrels = spark.createDataFrame([(1, 9, 1)], "query_id long, doc_id long, grade int")
    got = evaluate.per_query(run, qrels, 5).first()
    assert (got.precision, got.recall, got.ap, got.rr, got.depth) == (0, 0, 0, 0, 3)


def test_sequences(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (3, 0), (3, 0)], "g int, i int")
    got = {r.g: (list(r.missing), r.repeated) for r in checks.sequence_gaps(df, "g", "i").collect()}
    assert got == {1: ([1], 0), 2: ([], 0), 3: ([], 1)}


@pytest.mark.parametrize(("n", "parts"), [(0, 0), (1, 1), (10, 1), (11, 2), (20, 2)])
def test_fixed_chunks(spark, n, parts):
    df = spark.createDataFrame([(1, " ".join(["w"] * n))], "id int, t string")
    assert chunks.fixed(df, "id", "t", 10).count() == parts


def test_sentences_are_packed(spark):
    df = spark.createDataFrame([(1, "One two. Three four. Five."), (2, None)], "id int, t string")
    got = [r.chunk for r in chunks.by_sentences(df, "id", "t", 4).orderBy("id", "chunk_index").collect()]
    assert got == ["One two. Three four.", "Five."]


def test_pairs_and_components(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "c")], "i int, f string")
    assert [tuple(r) for r in graph.pair_counts(df, "i", "f").collect()] == [("a", "b", 2)]
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")
    assert {r.node: r.label for r in graph.component_labels(e).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    hops = graph.shortest_paths(e, spark.createDataFrame([(1,)], "node int"), 5)
    assert {r.node: r.hops for r in hops.collect()} == {1: 0, 2: 1, 3: 2}


def test_fuzzy_lengths(spark):
    v = spark.createDataFrame([("ab",), ("abd",), ("abcdf",), ("abcdxy",)], "term string")
    a = spark.createDataFrame([(1, "ac"), (1, "abc"), (1, "abcde"), (1, "abcdef")], "query_id int, term string")
    got = {(r.asked, r.term) for r in search.fuzzy_terms(v, a).collect()}
    assert got == {("abc", "ab"), ("abc", "abd"), ("abcde", "abcdf"), ("abcdef", "abcdf"), ("abcdef", "abcdxy")}


def test_pages(spark):
    page = "<html><head><title>T &amp; U</title><script>x</script></head><body><h1>Head</h1><p>In Park City now.</p><table><tr><th>County</th><td>Summit</td></tr></table><a href='/x'>l</a></body></html>"
    got = html.extract(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert got[0].title == "T & U" and got[0].headings == ["Head"] and got[0].infobox == {"County": "Summit"} and got[0].links == ["/x"]
    assert got[1].paragraphs == []
    assert one(spark, html.cut_at_sentence(F.lit("One. Two three. Four"), 16)) == "One. Two three."


def test_upsert_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([Row(k=1, t=1, v="a"), Row(k=2, t=1, v="b")]).coalesce(1).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    run = lambda: events.upsert_into(events.source(spark, str(src), schema), str(out), str(tmp_path / "ck"), ["k"], [F.desc_nulls_last("t")], 4).awaitTermination(60)
    run()
    spark.createDataFrame([Row(k=1, t=2, v="c"), Row(k=3, t=1, v="d")]).coalesce(1).write.mode("append").parquet(str(src))
    run()
    assert {(r.k, r.v) for r in merge.current(spark, str(out), schema).collect()} == {(1, "c"), (2, "b"), (3, "d")}


def test_stream_histogram_equals_batch(spark, tmp_path, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    stream = events.source(spark, f"{small}/event*.parquet", schema)
    q = events.histogram(stream, "ts", "1 day", "1 hour", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("hist").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = spark.read.parquet(f"{small}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("hist").collect())) == sorted(map(tuple, batch.collect()))


def test_lsh_recall(spark, small):
    from cairn.plans import queries_more, queries_search

    exact = {(r.query_id, r.id) for r in queries_search.v4_knn(spark, small).collect()}
    got = {(r.query_id, r.id) for r in queries_more.v3_lsh(spark, small).collect()}
    assert len(got) == len(exact) and len(got & exact) >= 0.9 * len(exact)


def test_shared_pairs_are_those_of_all_pairs(spark):
    rnd = random.Random(3)
    facts = {(i, f) for i in range(60) for f in rnd.sample(range(12), rnd.randint(0, 6))} | {(i, 99) for i in range(60)}
    df = spark.createDataFrame([*facts, *list(facts)[:50]], "i int, f int")
    for least in (1, 2, 4):
        have = {i: {f for j, f in facts if j == i} for i in range(60)}
        want = {(a, b, len(have[a] & have[b])) for a in have for b in have if a < b and len(have[a] & have[b]) >= least}
        assert {tuple(r) for r in graph.shared_pairs(df, "i", "f", least).collect()} == want


def test_links_within_groups_are_all_pairs(spark):
    rows = [(i, "large" if i < 23 else "two" if i < 25 else "one" if i < 26 else None) for i in range(28)] + [(None, "two"), (3, "two")]
    want = sorted((a, b) for a, g in rows for b, h in rows if None not in (a, b, g, h) and g == h and a != b)
    df = spark.createDataFrame(rows, "i long, g string")
    for part in (3, 2000):
        assert sorted(tuple(r) for r in graph.links_within(df, "i", "g", part).collect()) == want


def test_near_has_a_row_for_every_link(spark, small):
    city = {r.o_custkey: r.c_nationkey for r in spark.read.parquet(f"{small}/orders.parquet").join(spark.read.parquet(f"{small}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")).collect()}
    want = sorted((a, b) for a in city for b in city if a != b and city[a] == city[b])
    got = queries_graph.g13_near(spark, small)
    assert got.columns == ["a", "b"]
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_labels_of_a_long_path_reach_their_end(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(150)], "a int, b int")
    assert {r.label for r in graph.component_labels(e).collect()} == {0}


def test_query_nodes(spark):
    df = spark.createDataFrame([(1, "Red lime tea", "old oak"), (2, "lime", "bleu oak"), (3, None, None)], "i int, a string, b string")
    score = filters.node_score([{"match": {"a": {"query": "lime red", "operator": "and", "boost": 2.0}}}, {"match": {"b": {"query": "blue", "fuzziness": "AUTO"}}}, {"multi_match": {"query": "oak", "fields": {"a": 5.0, "b": 0.5}}}, {"match_phrase": {"a": {"query": "Lime tea"}}}])
    assert [r.s for r in df.orderBy("i").select(score.alias("s")).collect()] == [3.5, 0.5, 0.0]


def test_pairs_reaching_are_counted_over_all_rows(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
    want = {c: sum(round(cos(x, y), 9) >= c for i, x in rows[:7] for j, y in rows if i != j) for c in (0.5, 0.9)}
    got = vector.pairs_reaching(df.where("vec_id < 7"), df, [0.5, 0.9], block=10, same=True)
    assert {r.cut: r.pairs for r in got.collect()} == want


def test_folders_are_read_as_whole_files(spark, tmp_path):
    from cairn.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("one\ntwo\n")
    (tmp_path / "sub" / "b.html").write_text("three")
    (tmp_path / "c.txt").write_text("no")
    assert sorted(r.text for r in files.folder(spark, f"file://{tmp_path}").collect()) == ["one\ntwo\n", "three"]
    assert sorted(r.text for r in files.folder(spark, f"file://{tmp_path}", whole=False).collect()) == ["one", "three", "two"]


def test_pages_that_the_parser_gives_up_on_say_so(spark):
    pages = [(1, "<title>whole</title><p>text</p>"), (2, "<title>cut</title><p>&#" + "9" * 6000 + ";</p>"), (3, None)]
    got = {r.page_id: (r.title, r.complete) for r in html.extract(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert got == {1: ("whole", True), 2: ("cut", False), 3: ("", True)}


def test_means_beside_their_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 7.0)], "k string, v double")
    got = {(r.k, r.v, r.m) for r in facets.with_means(df, "k", {"m": "v"}).collect()}
    assert got == {("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 5.0, 5.0), (None, 7.0, None)}


def test_search_sizes_are_capped():
    assert [filters.search_sizes(n) for n in (3, 15, 30, 500)] == [(3, 15, 30), (15, 75, 150), (30, 100, 200), (100, 100, 200)]


def test_lifestyles_and_associations(spark):
    rows = spark.createDataFrame([(70, 8.0, ["a", "b"]), (70, None, ["a"]), (10, 9.0, []), (None, 1.0, None)], "walk int, school double, names array<string>")
    made = scores.association(F.col("names"))
    got = rows.select(scores.lifestyle(F.col("walk"), F.col("school")).alias("kind"), *[c.alias(n) for n, c in made.items()]).collect()
    assert [r.kind for r in got] == ["family_friendly_urban", "urban_lifestyle", "family_oriented", "standard_community"]
    assert [(r.facet, r.boost, r.n, r.associated) for r in got] == [("multi_neighborhood", 0.15, 2, True), ("has_neighborhood", 0.1, 1, True)] + [("no_neighborhood", 0.0, 0, False)] * 2

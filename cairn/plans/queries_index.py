"""Queries over what is written once and read by part: positional postings, inverted vector files, sketches; and exact selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import evaluate, positions, search, selection, sketches, spatial, vector
from cairn.plans.queries_relational import GEO
from cairn.plans.queries_search import KNN, TOK, queries_of
from cairn.sources.shared import new_path
from cairn.sources.tables import table


def rounded_percentiles(df, column, percents, by=()):
    return selection.percentiles(df, column, percents, by).withColumn("value", F.round("value", 6))


def a6_percentiles(s, d):
    return rounded_percentiles(table(s, d, "orders"), "o_totalprice", [25, 50, 75, 90, 95, 99])


def a16_quartiles(s, d):
    return rounded_percentiles(table(s, d, "orders"), "o_totalprice", [25, 50, 75])


def a25_describe(s, d):
    parts = table(s, d, "part")
    stats = parts.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 4).alias("std"))
    middle = selection.percentiles(parts, "p_retailprice", [50], ["p_type"]).select("p_type", F.round("value", 4).alias("median"))
    return stats.join(middle, "p_type")


def a10_sketched(s, d):
    """Distinct users of ten days by kind, from sketches written by day: the exact number, and whether the estimate is within 5 %."""
    events = table(s, d, "events")
    path = new_path(s, "sketches")
    sketches.daily(events, "ts", ["event_type"], "user_id").write.parquet(path)
    within = F.col("day").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-14").cast("date"))
    told = sketches.distinct(s.read.parquet(path), ["event_type"], within)
    exact = events.where((F.col("ts") >= "2024-01-05") & (F.col("ts") < "2024-01-15")).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(told, "event_type").select("event_type", "users", (F.abs(F.col("distinct") - F.col("users")) <= 0.05 * F.col("users")).alias("close"))


def t7_phrases(s, d):
    """All benchmark items as phrases, from a positional index of all documents."""
    path = new_path(s, "positions")
    positions.write_index(table(s, d, "documents"), path)
    return positions.phrase_matches(s, path, table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def t1_folded(s, d):
    """Terms of all documents without accents."""
    terms = search.analyzed(table(s, d, "documents"), stop=["the", "of"], stemmed=False)
    return terms.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses"))


def t1_stems(s, d):
    """Stems of all documents' terms."""
    return search.analyzed(table(s, d, "documents"), stop=["the", "of"]).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("uses"))


def indexed(s, d, k):
    """The stated query set against an inverted file. The test vectors have no clusters, so candidates are four fifths of the rows here."""
    e, path = table(s, d, "embeddings"), new_path(s, "cells")
    cells = vector.inverted_file(e, path)
    return vector.probe(queries_of(s, d), path, cells, k, int(0.8 * e.count()), same=True)


def v3_inverted_file(s, d):
    return indexed(s, d, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def v3_recall(s, d):
    """Whether the inverted file finds nine tenths of the five nearest rows of the stated query set."""
    exact = vector.nearest_join(queries_of(s, d), table(s, d, "embeddings"), 5, same=True).select("query_id", "id", F.lit(1).alias("there"))
    hit = exact.join(indexed(s, d, 5).select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("neighbours"), (F.count("found") >= 0.9 * F.count("*")).alias("enough"))


def e17_semantic(s, d):
    """Grades of all articles for every benchmark item: its first word is the concept, the next three are the related categories, and an
    article's first line has its categories."""
    tok = lambda c: text.tokens(c)
    concepts = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.get(tok(F.col("text")), F.lit(0)).alias("concept"), F.slice(tok(F.col("text")), 2, 3).alias("related"))
    articles = table(s, d, "documents").select("doc_id", tok(F.split("text", "\n")[0]).alias("categories"), tok(F.col("text")).alias("words"))
    return evaluate.semantic_grades(concepts, articles).groupBy("query_id", "grade").agg(F.count("*").alias("articles"))


def j14_within(s, d):
    """Suppliers within 3,000 km of a point, nearest first."""
    k = F.col("s_suppkey")
    points = table(s, d, "supplier").select("s_suppkey", (k % 180 - 90).cast("double").alias("lat"), (k * 7 % 360 - 180).cast("double").alias("lon"))
    return spatial.within(points, "lat", "lon", (10.0, 20.0), 3000.0).select("s_suppkey", F.round("km", 3).alias("km"))


QUERIES = {
    "a6_percentiles": (a6_percentiles, "SELECT p::DOUBLE AS percent, round(v, 6) AS value FROM (SELECT unnest([25, 50, 75, 90, 95, 99]) AS p, unnest(quantile_cont(o_totalprice, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])) AS v FROM orders)"),
    "a16_quartiles": (a16_quartiles, "SELECT p::DOUBLE AS percent, round(v, 6) AS value FROM (SELECT unnest([25, 50, 75]) AS p, unnest(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) AS v FROM orders)"),
    "a25_describe": (a25_describe, "SELECT p_type, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, round(stddev_samp(p_retailprice), 4) AS std FROM part GROUP BY 1"),
    "a10_sketched": (a10_sketched, "SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS close FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-15' GROUP BY 1"),
    "t7_phrases": (t7_phrases, f"WITH d AS MATERIALIZED (SELECT doc_id, {TOK} AS t FROM documents), b AS MATERIALIZED (SELECT item_id AS query_id, {TOK} AS q FROM benchmark) SELECT query_id, doc_id, CAST(len(list_filter(range(1, len(t) - len(q) + 2), lambda i: t[i] = q[1] AND t[i:i + len(q) - 1] = q)) AS INT) AS found FROM d JOIN b ON contains(' ' || array_to_string(t, ' ') || ' ', ' ' || array_to_string(q, ' ') || ' ') WHERE len(q) > 0"),
    "e17_semantic": (e17_semantic, f"WITH q AS (SELECT item_id AS query_id, t[1] AS concept, list_distinct(t[2:4]) AS rel FROM (SELECT item_id, {TOK} AS t FROM benchmark)), d AS MATERIALIZED (SELECT doc_id, list_distinct({TOK}) AS w, list_distinct({TOK.replace('text', 'head')}) AS c FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS head FROM documents)), g AS (SELECT query_id, len(list_intersect(c, rel)) AS n, list_contains(w, concept) AS named FROM q, d) SELECT query_id, CASE WHEN n >= 2 THEN 3 WHEN n = 1 THEN 2 ELSE 1 END AS grade, count(*) AS articles FROM g WHERE n > 0 OR named GROUP BY 1, 2"),
    "j14_within": (j14_within, f"SELECT s_suppkey, round(km, 3) AS km FROM (SELECT s_suppkey, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon - 20.0) / 2), 2)))) AS km FROM {GEO}) WHERE km <= 3000"),
    "t1_folded": (t1_folded, f"SELECT term, count(DISTINCT doc_id) AS documents, CAST(count(*) AS BIGINT) AS uses FROM (SELECT doc_id, strip_accents(w) AS term FROM (SELECT doc_id, unnest({TOK}) AS w FROM documents) WHERE w NOT IN ('the', 'of')) GROUP BY 1"),
    "t1_stems": (t1_stems, None),
    "v3_inverted_file": (v3_inverted_file, None),
    "v3_recall": (v3_recall, f"SELECT count(*) AS neighbours, TRUE AS enough FROM ({KNN}) WHERE rank <= 5"),
}

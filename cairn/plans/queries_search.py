"""Text ranking, vector search, hybrids."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text, vectors
from cairn.operators import search, vector
from cairn.sources.tables import table

TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def asked(s, d):
    """The benchmark items as queries."""
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


ASKED = "(SELECT item_id AS query_id, text FROM benchmark)"
BM25 = rf"""
toks AS (SELECT doc_id, {TOK} AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS doc_len FROM toks),
stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
q AS (SELECT query_id, unnest(list_distinct({TOK})) AS term FROM {ASKED}),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
bm AS (SELECT query_id, doc_id, count(*) AS matched, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len))) AS score
       FROM q JOIN post USING (term) JOIN df USING (term) JOIN lens USING (doc_id), stats GROUP BY 1, 2)"""
COS = "CASE WHEN list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) = 0 OR list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]) = 0 THEN 0.0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END"
KNN = f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({COS}, 9) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 9) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"
#: The same over the benchmark items as queries; ends in its WHERE clause, so that a filter can follow.
ASKED_KNN = KNN.replace("a.vec_id % 50 = 0", "a.vec_id IN (SELECT item_id FROM benchmark)")
HEAD_BM25 = BM25.replace("AS t FROM documents)", "AS t FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents))")
#: Letters of more than a byte as upper-case ones, which lower-cased tokens do not have: this edit distance counts bytes.
ONE_BYTE = "translate({}, 'éèñßêíçóöüä', 'ABCDEFGHIJK')"


def ranked(s, d):
    return search.bm25(table(s, d, "documents"), asked(s, d))


def t2_postings(s, d):
    p = search.postings(table(s, d, "documents"), "doc_id", ["text"], stop=["the", "of"])
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def t3_best_fields(s, d):
    docs = table(s, d, "documents").withColumn("head", F.split("text", "\n")[0])
    best = search.multi_match(docs, asked(s, d), {"text": 1.0, "head": 2.0})
    return search.top(best.withColumn("score", F.round("score", 6)), 3).select("query_id", "doc_id", "score")


def t4_most_fields(s, d):
    docs = table(s, d, "documents").withColumn("head", F.split("text", "\n")[0])
    most = search.multi_match(docs, asked(s, d), {"text": 1.0, "head": 0.5}, "most_fields")
    return search.top(most.withColumn("score", F.round("score", 6)), 3).select("query_id", "doc_id", "score")


def t8_fuzzy(s, d):
    vocabulary = table(s, d, "documents").select(F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term")).distinct()
    return search.fuzzy_terms(vocabulary, search.query_terms(asked(s, d))).select("query_id", "asked", "term", "edits")


def t9_filtered(s, d):
    docs = table(s, d, "documents").where("lang = 'en'")
    return search.top(search.bm25(docs, asked(s, d)).withColumn("score", F.round("score", 6)), 2).select("query_id", "doc_id", "score")


def t13_labels(s, d):
    """3 where a document's first line has a term of the query, else 1 where its text has one."""
    docs = table(s, d, "documents").withColumn("head", F.split("text", "\n")[0])
    part = lambda c, grade: docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col(c)))).alias("term"), F.lit(grade).alias("grade"))
    return part("head", 3).union(part("text", 1)).join(search.query_terms(asked(s, d)), "term").groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def queries_of(s, d):
    return table(s, d, "embeddings").where("vec_id % 50 = 0")


def v1_nearest(s, d):
    one = [float(i % 7) - 3 for i in range(64)]
    return vector.nearest(table(s, d, "embeddings"), one, 10, where=F.col("label") < 8, least=-0.5).withColumn("score", F.round("score", 6))


def v4_knn(s, d):
    return vector.nearest_join(queries_of(s, d), table(s, d, "embeddings"), 5, same=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def v5_shifted(s, d):
    e = table(s, d, "embeddings")
    unit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(1.0))
    return e.select("vec_id", F.round(vectors.cosine(F.col("embedding"), unit) + 1.0, 6).alias("score")).where("score >= 1.1")


def v6_weighted(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lit(1.0))
    x, y = vectors.cosine(F.col("a"), unit), vectors.cosine(F.col("b"), unit)
    return e.select("vec_id", F.round(2 * x + 1.5 * y, 6).alias("summed"), F.round(F.greatest(1.5 * x, y), 6).alias("best"))


def v10_merged(s, d):
    e = table(s, d, "embeddings")
    unit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(1.0))
    scored = [e.where(f"label % 2 = {k}").select(F.lit(f"c{k}").alias("collection"), "vec_id", (1 - vectors.cosine(F.col("embedding"), unit)).alias("distance")) for k in (0, 1)]
    return scored[0].unionByName(scored[1]).where("1 - distance >= 0").orderBy("distance", "vec_id").limit(10).select("collection", "vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


def v11_edges(s, d):
    return vector.similar_edges(vector.nearest_join(queries_of(s, d), table(s, d, "embeddings"), 10, same=True), 0.3).withColumn("score", F.round("score", 6))


def v12_sweep(s, d):
    return vector.pairs_reaching(queries_of(s, d), table(s, d, "embeddings"), [0.1, 0.2, 0.3, 0.4, 0.5], same=True)


def v15_audit(s, d):
    return table(s, d, "embeddings").groupBy("label").agg(F.count_if(F.col("embedding").isNotNull()).alias("present"), F.min(F.size("embedding")).cast("long").alias("least"), F.max(F.size("embedding")).cast("long").alias("most"))


def vector_list(s, d, corpus, k):
    """The nearest rows of the corpus to each benchmark item; an item's vector is the one of its number."""
    items = table(s, d, "embeddings").join(table(s, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return vector.nearest_join(items, corpus, k, same=True).select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "rank")


def lists(s, d):
    """The BM25 list and the vector list of each query."""
    return search.top(ranked(s, d).withColumn("score", F.round("score", 6)), 20), vector_list(s, d, table(s, d, "embeddings"), 20)


def h1_fused(s, d):
    a, b = lists(s, d)
    return vector.fuse({"text": a, "vector": b}, size=5).select("query_id", "doc_id", F.round("score", 9).alias("score"), "rank")


def h5_overlap(s, d):
    a, b = lists(s, d)
    both = a.select("query_id", "doc_id").join(b.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return both.groupBy("query_id").agg(F.count("*").alias("overlap"))


def h3_boosted(s, d):
    m = table(s, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("vec"), ((F.col("p_partkey") % 40) / 40).alias("graph"), ((F.col("p_partkey") % 7) / 7).alias("features"), (F.col("p_partkey") % 60).alias("links"), (F.col("p_partkey") % 20).alias("near"))
    base = 0.6 * F.col("vec") + 0.2 * F.col("graph") + 0.2 * F.col("features")
    boost = F.when(F.col("links") > 30, 1.1).otherwise(1.0) * F.when(F.col("near") > 10, 1.05).otherwise(1.0)
    return m.select("p_partkey", F.round(F.least(base * boost, F.lit(1.0)), 6).alias("score"))


QUERIES = {
    "t1_analyzer": (lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.slice(text.shingles(text.tokens(F.col("text"))), 1, 5), "|").alias("first"), F.size(text.tokens(F.col("text"))).alias("n")), f"SELECT item_id, array_to_string(list_transform(range(1, 6), lambda i: t[i] || ' ' || t[i + 1]), '|') AS first, CAST(len(t) AS INT) AS n FROM (SELECT item_id, {TOK} AS t FROM benchmark)"),
    "t2_postings": (t2_postings, f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) WHERE term NOT IN ('the', 'of') GROUP BY 1"),
    "t3_best_fields": (t3_best_fields, f"WITH f AS (SELECT query_id, doc_id, score FROM (WITH {BM25} SELECT * FROM bm) UNION ALL SELECT query_id, doc_id, 2.0::DOUBLE * score FROM (WITH {HEAD_BM25} SELECT * FROM bm)), m AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM f GROUP BY 1, 2) SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 3"),
    "t4_most_fields": (t4_most_fields, f"WITH f AS (SELECT query_id, doc_id, score FROM (WITH {BM25} SELECT * FROM bm) UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE * score FROM (WITH {HEAD_BM25} SELECT * FROM bm)), m AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM f GROUP BY 1, 2) SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 3"),
    "t5_bm25": (lambda s, d: search.top(ranked(s, d).withColumn("score", F.round("score", 6)), 5).select("query_id", "doc_id", "score", "rank"), f"WITH {BM25} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 5"),
    "t6_all_terms": (lambda s, d: search.need_terms(ranked(s, d), asked(s, d)).select("query_id", "doc_id"), f"WITH {BM25} SELECT query_id, doc_id FROM bm JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY 1) USING (query_id) WHERE matched = n"),
    "t7_phrase": (lambda s, d: table(s, d, "documents").where(search.has_phrase(F.col("text"), "of the")).select("doc_id"), f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOK}, ' ') || ' ', ' of the ')"),
    "t8_fuzzy": (t8_fuzzy, f"WITH v AS (SELECT DISTINCT term, {ONE_BYTE.format('term')} AS t FROM (SELECT unnest({TOK}) AS term FROM documents)), q AS (SELECT query_id, asked, {ONE_BYTE.format('asked')} AS a FROM (SELECT query_id, unnest(list_distinct({TOK})) AS asked FROM {ASKED})) SELECT query_id, asked, term, CAST(levenshtein(a, t) AS INT) AS edits FROM q JOIN v ON substr(a, 1, 2) = substr(t, 1, 2) WHERE abs(length(a) - length(t)) <= 2 AND levenshtein(a, t) <= CASE WHEN length(a) <= 2 THEN 0 WHEN length(a) <= 5 THEN 1 ELSE 2 END"),
    "t9_filtered": (t9_filtered, f"WITH {BM25.replace('FROM documents)', chr(70) + 'ROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')')} SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) WHERE rank <= 2"),
    "t12_highlight": (lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(search.highlight(F.col("text"), "the"), " ... ").alias("fragments")), r"SELECT doc_id, array_to_string(list_transform(list_slice(regexp_extract_all(text, '(?is).{0,60}\bthe\b.{0,60}'), 1, 3), lambda x: regexp_replace(x, '(?i)\b(the)\b', '<em>\1</em>', 'g')), ' ... ') AS fragments FROM documents"),
    "t13_labels": (t13_labels, f"WITH q AS (SELECT query_id, unnest(list_distinct({TOK})) AS term FROM {ASKED}), t AS (SELECT doc_id, unnest(list_distinct({TOK})) AS term, 1 AS grade FROM documents UNION ALL SELECT doc_id, unnest(list_distinct({TOK})), 3 FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)) SELECT query_id, doc_id, max(grade) AS grade FROM q JOIN t USING (term) GROUP BY 1, 2"),
    "v1_nearest": (v1_nearest, "SELECT * FROM (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (i % 7 - 3)::DOUBLE)), 6) AS score FROM embeddings WHERE label < 8) WHERE score >= -0.5 ORDER BY score DESC, id LIMIT 10"),
    "v4_knn": (v4_knn, f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({KNN}) WHERE rank <= 5"),
    "v5_shifted": (v5_shifted, "SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: 1.0::DOUBLE)) + 1, 6) AS score FROM embeddings) WHERE score >= 1.1"),
    "v6_weighted": (v6_weighted, "SELECT vec_id, round(2 * x + 1.5 * y, 6) AS summed, round(greatest(1.5 * x, y), 6) AS best FROM (SELECT vec_id, list_cosine_similarity(embedding[1:32]::DOUBLE[], u) AS x, list_cosine_similarity(embedding[33:64]::DOUBLE[], u) AS y FROM (SELECT *, list_transform(range(32), lambda i: 1.0::DOUBLE) AS u FROM embeddings))"),
    "v10_merged": (v10_merged, "SELECT 'c' || (label % 2) AS collection, vec_id, round(x, 6) AS similarity FROM (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: 1.0::DOUBLE)) AS x FROM embeddings) WHERE x >= 0 ORDER BY x DESC, vec_id LIMIT 10"),
    "v11_edges": (v11_edges, f"SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, round(max(score), 6) AS score FROM ({KNN}) WHERE rank <= 10 AND score >= 0.3 GROUP BY 1, 2"),
    "v12_sweep": (v12_sweep, f"SELECT cut::DOUBLE AS cut, count(*) FILTER (score >= cut) AS pairs FROM ({KNN}), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS cut) GROUP BY 1"),
    "v14_embed": (lambda s, d: vector.embed(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").alias("dims"), F.md5(F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double"))), ",")).alias("digest")), None),
    "v15_audit": (v15_audit, "SELECT label, count(embedding) AS present, min(len(embedding)) AS least, max(len(embedding)) AS most FROM embeddings GROUP BY 1"),
    "h1_fused": (h1_fused, f"WITH {BM25}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm), b AS (SELECT query_id, id AS doc_id, rank FROM ({ASKED_KNN})), u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (FROM a WHERE rank <= 20 UNION ALL FROM b WHERE rank <= 20) GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= 5"),
    "h3_boosted": (h3_boosted, "SELECT p_partkey, round(least((0.6::DOUBLE * (p_size / 50) + 0.2::DOUBLE * ((p_partkey % 40) / 40) + 0.2::DOUBLE * ((p_partkey % 7) / 7)) * (CASE WHEN p_partkey % 60 > 30 THEN 1.1::DOUBLE ELSE 1.0 END) * (CASE WHEN p_partkey % 20 > 10 THEN 1.05::DOUBLE ELSE 1.0 END), 1.0), 6) AS score FROM part"),
    "h5_overlap": (h5_overlap, f"WITH {BM25}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm), b AS (SELECT query_id, id AS doc_id, rank FROM ({ASKED_KNN})) SELECT query_id, count(*) AS overlap FROM a JOIN b USING (query_id, doc_id) WHERE a.rank <= 20 AND b.rank <= 20 GROUP BY 1"),
}

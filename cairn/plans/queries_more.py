"""Further rows of the blueprint: flattening, place and article scores, search variants, node tables, audits."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import text, vectors
from cairn.operators import chains, checks, chunks, evaluate, facets, filters, graph, html, incremental, scores, search, vector
from cairn.plans.binding import PHRASES, described_articles, listing_features, listings, tagged_parts
from cairn.plans.queries_aggregate import BANDS, CUTS, LISTED
from cairn.plans.queries_documents import MET, run_and_grades
from cairn.plans.queries_graph import PB
from cairn.plans.queries_relational import FEATS
from cairn.plans.queries_search import ASKED, ASKED_KNN, BM25, KNN, TOK, asked, ranked, vector_list
from cairn.sources import sinks
from cairn.sources.tables import table


def p1_flatten(s, d):
    packed = listings(s, d).select("listing_id", F.struct("price", F.struct("city", "state").alias("at")).alias("details"))
    return packed.select("listing_id", F.col("details.price").alias("price"), F.col("details.at.city").alias("city"), F.col("details.at.state").alias("state"))


def s13_without(s, d):
    return sinks.documents(listings(s, d).drop("city", "state", "place"), "listing_id", {"price": F.col("price"), "kind": F.col("kind")}).select("_id", "doc.*")


def f5_hierarchy(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    kind = F.when(F.col("n_nationkey") % 2 == 0, "city").otherwise("county")
    return j.select("n_nationkey", F.concat_ws(" > ", "r_name", "n_name").alias("path"), kind.alias("location_type"), text.node_id("state", F.col("r_name")).alias("parent_id"))


def f16_summaries(s, d):
    docs = table(s, d, "documents")
    words, sentences = F.regexp_count("text", F.lit(r"\S+")), F.regexp_count("text", F.lit(r"[.!?]"))
    detail = F.contains(F.lower("text"), F.lit("the"))
    level = F.when((words > 300) & detail, "high").when(words > 100, "medium").otherwise("low")
    return docs.select("doc_id", F.round(words / F.greatest(sentences, F.lit(1)), 4).alias("avg_sentence"), level.alias("level"))


def e2_places(s, d):
    g = listings(s, d).groupBy("place_id", "city").agg(F.count("*").alias("n"), F.avg("price").alias("p"))
    urban = F.when(F.col("n") >= 15, "urban").when(F.col("n") >= 8, "suburban").otherwise("rural")
    g = facets.with_means(g, "city", {"city_avg": "p"})
    return g.select("place_id", urban.alias("lifestyle"), F.round(scores.investment(F.least(F.col("n") / 20, F.lit(1.0)), F.least(F.col("p") / F.col("city_avg"), F.lit(1.0)), F.lit(0.5)), 6).alias("investment"), F.concat_ws("|", urban, facets.ladder(F.col("p"), CUTS, BANDS)).alias("facets"))


def e7_authority(s, d):
    docs = described_articles(s, d).join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id")
    authority = 40 * F.least(F.col("n_chars") / 5000, F.lit(1.0)) + 30 * F.coalesce(F.col("quality"), F.lit(0)) + 30 * F.when(F.col("lang") == "en", 1.0).otherwise(0.5)
    return docs.select("doc_id", F.round(authority, 6).alias("authority"), F.array_join(scores.key_topics(F.col("summary")), ",").alias("topics"))


def e11_rules(s, d):
    docs = table(s, d, "documents").withColumn("words", F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.lit(1)))
    place = F.when(F.col("source").isin("src0", "src1", "src2"), 1.0).otherwise(0.0)
    dense = F.least(20 * text.mentions(F.col("text"), ["the", "and", "der", "und"]) / F.sqrt(F.col("words")) / 4, F.lit(1.0))
    total = 0.4 * place + 0.4 * dense + 0.2 * F.when(F.col("lang") == "en", 1.0).otherwise(0.0)
    veto = F.length("text") < 20
    return docs.select("doc_id", F.round(F.when(veto, 0.0).otherwise(total), 6).alias("score"), (~veto & (total >= 0.5)).alias("relevant"))


def e13b_classified(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    kind = F.when(F.col("n_chars") < 500, 0.8).when(F.col("n_chars") < 2000, 0.6).when(F.col("n_chars") < 8000, 0.5).otherwise(0.3)
    score = F.when(F.col("toxic") == 1, 0.2).otherwise(0.4 * kind + 0.4 * F.col("quality") + 0.2)
    return j.select("doc_id", F.round(score, 6).alias("score"))


def e14_derived(s, d):
    f = listing_features(s, d).groupBy("listing_id").agg(F.count("*").alias("feature_count"))
    means = listings(s, d).groupBy("city").agg(F.avg("price").alias("mean"))
    ls = listings(s, d).join(means, "city").join(f, "listing_id", "left").na.fill(0, ["feature_count"])
    return ls.select("listing_id", "feature_count", (F.col("price") > F.col("mean") * 1.5).alias("premium"), (F.col("price") / F.greatest(F.col("feature_count"), F.lit(1))).alias("per_feature"))


def e16_categories(s, d):
    tags = scores.article_categories(*[F.col(c) for c in ("title", "summary", "county", "city", "state")])
    return described_articles(s, d).select("doc_id", F.array_join(tags, ",").alias("categories"))


def t10_excluded(s, d):
    return search.top(search.bm25(table(s, d, "documents").where(~F.col("source").isin("src0", "src1")), asked(s, d)).withColumn("score", F.round("score", 6)), 2).select("query_id", "doc_id", "score")


def t11_routes(s, d):
    """Each query over the field set of every route: whole articles, their first lines as summaries, and turns as chunks."""
    docs = table(s, d, "documents")
    turns = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    routes = {"full": docs.select("doc_id", "text"), "summaries": docs.select("doc_id", F.split("text", "\n")[0].alias("text")), "chunks": turns}
    out = None
    for name, rows in routes.items():
        one = search.bm25(rows, asked(s, d)).groupBy("query_id").agg(F.count("*").alias("hits"), F.max("matched").alias("most")).withColumn("route", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def t15_related(s, d):
    """Articles that match a query, with the statistics of their source's articles."""
    stats = table(s, d, "documents").groupBy("source").agg(F.count("*").alias("articles"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))
    best = search.top(ranked(s, d).withColumn("score", F.round("score", 6)), 1)
    return best.join(table(s, d, "documents").select("doc_id", "source"), "doc_id").join(stats, "source").select("query_id", "doc_id", "source", "articles", "avg_chars")


WISHES = ("modern home near the mountain", "open plan", "a home to be in", "cheap flat")


def t16_insights(s, d):
    """For each of some wishes what every article's summary has of it."""
    asked = described_articles(s, d).select("doc_id", "summary", F.posexplode(F.array(*[F.lit(w) for w in WISHES])).alias("wish", "query"))
    return asked.select("doc_id", "wish", F.array_join(scores.match_insights(F.col("query"), F.col("summary")), ",").alias("insights")).where("insights <> ''")


def v2_like_this(s, d):
    """Of every row of the stated query set the ten most alike others."""
    e = table(s, d, "embeddings")
    return vector.nearest_join(e.where("vec_id % 50 = 0"), e, 10, same=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def v3_lsh(s, d):
    """Rows that share one of six buckets of random projections of unit vectors, by exact scores; close to the exact join, not equal to it.

    The buckets go with the vectors as six numbers, so that neither is repeated for each table or candidate.
    """
    e = table(s, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding", array_to_vector("embedding").alias("v"))
    unit = Normalizer(inputCol="v", outputCol="u").transform(e)
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=0.7, numHashTables=6, seed=5).fit(unit)
    hashes = F.array(*[F.get(vector_to_array(F.col("h")[i]), F.lit(0)).cast("int") for i in range(6)])
    rows = model.transform(unit).select("vec_id", "embedding", hashes.alias("hashes"))
    return vector.nearest_join(rows.where("vec_id % 50 = 0"), rows, 5, same=True, marks="hashes", distance=True).select("query_id", "id", F.round("score", 6).alias("score"))


def v9_linear(s, d):
    """For every query: half its text score plus its vector score, over the hits of either retriever; the missing one counts 0."""
    v = vector_list(s, d, table(s, d, "embeddings"), 20).select("query_id", "doc_id", (F.col("score") + 1).alias("v"))
    both = v.join(ranked(s, d).select("query_id", "doc_id", (0.5 * F.col("score")).alias("t")), ["query_id", "doc_id"], "full")
    scored = both.select("query_id", "doc_id", F.round(F.coalesce("v", F.lit(0.0)) + F.coalesce("t", F.lit(0.0)), 6).alias("score"))
    return search.top(scored, 10).select("query_id", "doc_id", "score")


def v13_texts(s, d):
    return table(s, d, "part").select("p_partkey", F.concat_ws(" | ", "p_name", F.concat(F.lit("brand "), "p_brand"), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("text"))


def h2_located(s, d):
    """Both retrievers see only the documents of the place; nothing is filtered after ranking."""
    docs = table(s, d, "documents").where("lang = 'de'")
    a = search.top(search.bm25(docs, asked(s, d)).withColumn("score", F.round("score", 6)), 10)
    inside = table(s, d, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return vector.fuse({"a": a, "b": vector_list(s, d, inside, 10)}, size=3).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def h4_centrality(s, d):
    """Means of four capped counts: listings of the place, of the city, features, and listings of the same band in the place."""
    ls = listings(s, d).withColumn("band", facets.ladder(F.col("price"), CUTS, BANDS))
    f = listing_features(s, d).groupBy("listing_id").agg(F.count("*").alias("features"))
    n = lambda name, *by: ls.groupBy(*by).agg((F.count("*") - 1).alias(name))
    m = ls.join(n("a", "place_id"), "place_id").join(n("b", "city"), "city").join(n("c", "place_id", "band"), ["place_id", "band"]).join(f, "listing_id", "left").na.fill(0, ["features"])
    part = lambda c, cap: F.least(F.col(c) / cap, F.lit(1.0))
    return m.select("listing_id", F.round((part("a", 50) + part("b", 2000) + part("features", 15) + part("c", 30)) / 4, 6).alias("centrality"))


def g4_bands(s, d):
    ls = listings(s, d).withColumn("band", facets.ladder(F.col("price"), CUTS, BANDS))
    return ls.groupBy("band").agg(F.count("*").alias("n"), F.min("price").alias("least"), F.max("price").alias("most"))


def g26_adjacent(s, d):
    """Places of a city whose next dearer place is more than 30,000 above them, by an as-of join, so that no city is sorted in one task."""
    g = listings(s, d).groupBy("city", "place_id").agg(F.avg("price").alias("p"))
    above = chains.next_above(g.select("city", F.col("p").alias("above")), g.select("city", F.col("p").alias("value"), F.col("place_id").alias("id")), "city", "value")
    return g.join(above.withColumnRenamed("above", "p"), ["city", "p"]).select("city", "place_id", F.round(F.col("value") - F.col("p"), 3).alias("gap")).where("gap > 30000")


def g41_lateral(s, d):
    e = table(s, d, "embeddings")
    near = vector.nearest_join(e.where("vec_id % 50 = 0"), e, 10, same=True)
    lab = e.select(F.col("vec_id").alias("id"), "label")
    j = near.join(lab, "id").join(lab.select(F.col("id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label <> own")
    return graph.top_per(j.drop("rank"), "query_id", [F.desc(F.round("score", 9)), F.asc("id")], 2).select("query_id", "id", F.round("score", 6).alias("score"))


def g43_chains(s, d):
    """Brands reached from the first brand over shared tags, by hops."""
    t = tagged_parts(s, d).select("brand", F.explode("tags").alias("tag"), "price").groupBy("brand", "tag").agg(F.count("*").alias("n")).where("n >= 10")
    pairs = graph.pair_counts(t, "tag", "brand", 1)
    return graph.shortest_paths(pairs, pairs.select(F.min("a").alias("node")), 6).select("node", "hops")


def q11_embedding_rules(s, d):
    e = table(s, d, "embeddings")
    rules = {"id": F.col("vec_id").isNotNull(), "dims": F.size("embedding") == 64, "label": F.col("label").between(0, 9), "norm": vectors.norm(F.col("embedding")) > 0}
    return checks.rule_counts(e, rules)


def q12_health(s, d):
    c = table(s, d, "conversations")
    g = checks.sequence_gaps(c, "conv_id", "turn")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("chunks"), F.count_if(F.size("missing") > 0).alias("incomplete"), F.count_if(F.col("repeated") > 0).alias("repeating"))


def q13_mismatch(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").withColumn("told", F.when(F.col("quality") == 1, "en"))
    action = F.when(F.col("told").isNull() & (F.col("toxic") == 1), "remove").when(F.col("told").isNull(), "skip").when(F.col("told") == F.col("lang"), "assign").otherwise("correct")
    return j.select("doc_id", action.alias("action"))


def c4_split(s, d):
    big = chunks.fixed(table(s, d, "documents"), "doc_id", "text", 400)
    parts = F.ceil(F.size(F.split("chunk", " ")) / 150).cast("int")
    return big.select("doc_id", "chunk_index", parts.alias("parts"))


def d8_query_set(s, d):
    """Labelled queries of five categories, the five largest groups of articles of each: how many articles of each grade, and the first three.

    An article is graded 3 from 2,000 characters, 2 from 500, else 1.
    """
    i, grade = F.col("doc_id"), F.when(F.col("n_chars") >= 2000, 3).when(F.col("n_chars") >= 500, 2).otherwise(1)
    groups = {
        "geographic": F.concat(F.lit("articles in "), "lang"), "landmark": F.concat(F.lit("what is known of "), "source"), "administrative": F.format_string("articles in %s from %s", "lang", "source"),
        "historical": F.concat(F.lit("articles of decade "), F.floor(i / 100).cast("string")), "semantic": F.concat(F.lit("texts that begin with "), F.get(text.tokens(F.substring("text", 1, 200)), F.lit(0))),
    }
    rows = table(s, d, "documents").select("doc_id", grade.alias("grade"), F.inline(F.array(*[F.struct(F.lit(c).alias("category"), q.alias("query")) for c, q in groups.items()]))).where("query IS NOT NULL")
    sizes = rows.groupBy("category", "query").agg(F.count("*").alias("n"), *[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in (3, 2, 1)])
    best = graph.top_per(sizes, "category", [F.desc("n"), F.asc("query")], 5).drop("rank")
    first = rows.join(F.broadcast(best.select("category", "query")), ["category", "query"])  # five rows of each category
    turn = F.row_number().over(Window.partitionBy("category", "query").orderBy(F.desc("grade"), "doc_id"))
    lists = first.withColumn("turn", turn).where("turn <= 3").groupBy("category", "query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "doc_id"))), lambda x: x["doc_id"]), ",").alias("expected"))
    return best.join(lists, ["category", "query"])


def m7_models(s, d):
    run, wanted = run_and_grades(s, d)
    out = None
    for k in (3, 5, 10):
        one = evaluate.summary(evaluate.per_graded(run, wanted, k)).select(F.lit(f"top{k}").alias("model"), F.lit("all").alias("category"), F.round("mean_f1", 6).alias("mean_f1"))
        out = one if out is None else out.unionByName(one)
    return evaluate.ranked_models(out, "mean_f1")


def m9_validated(s, d):
    """Of each query's words, how many its best document has."""
    best = search.top(ranked(s, d).withColumn("score", F.round("score", 6)), 1)
    n = search.query_terms(asked(s, d)).groupBy("query_id").agg(F.count("*").alias("asked"))
    return best.join(n, "query_id").select("query_id", F.round(F.col("matched") / F.col("asked"), 6).alias("share"), (F.col("matched") * 2 >= F.col("asked")).alias("valid"))


def i3b_dimension(s, d):
    seg = table(s, d, "customer").select("c_mktsegment").distinct().where("c_mktsegment < 'C'").select(F.lit(1).cast("long").alias("id"), "c_mktsegment")
    return incremental.with_dimension_keys(seg, table(s, d, "customer"), ["c_mktsegment"], "id").select("c_mktsegment", (F.col("id") == 1).alias("known"))


ONES = "list_transform(range(64), lambda i: 1.0::DOUBLE)"
DOCS = lambda where: BM25.replace("FROM documents)", f"FROM documents WHERE {where})")
TOP = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)"
_ONE_OF = lambda words, column: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"
TAGGED = lambda rules, column: ", ".join(f"CASE WHEN {_ONE_OF(words, column)} THEN '{tag}' END" for tag, words in rules)
_PHRASE = lambda at: f"(CASE {at} " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END)"
DESCRIBED = f"(SELECT *, string_split(text, chr(10))[1] AS title, {_PHRASE('doc_id % 8')} || '. ' || {_PHRASE('(doc_id // 8) % 8')} AS summary FROM documents)"
WISHED = ", ".join(f"CASE WHEN contains(query, '{w}') AND {_ONE_OF(words, 'lower(summary)')} THEN '{says}' END" for w, words, says in scores.INSIGHTS)
QUERIES = {
    "p1_flatten": (p1_flatten, f"SELECT listing_id, price, city, state FROM {LISTED}"),
    "p5_request": (lambda s, d: listings(s, d).where(filters.bool_query(filter=[{"terms": {"kind": ["1-URGENT", "2-HIGH"]}}, {"range": {"price": {"gte": 100_000, "lt": 300_000}}}, {"terms": {"status": ["O", "F"]}}])).select("listing_id"), f"SELECT listing_id FROM {LISTED} WHERE kind IN ('1-URGENT', '2-HIGH') AND price >= 100000 AND price < 300000 AND status IN ('O', 'F')"),
    "s13_without": (s13_without, f"SELECT CAST(listing_id AS VARCHAR) AS _id, price, kind FROM {LISTED}"),
    "f5_hierarchy": (f5_hierarchy, "SELECT n_nationkey, r_name || ' > ' || n_name AS path, CASE WHEN n_nationkey % 2 = 0 THEN 'city' ELSE 'county' END AS location_type, 'state:' || regexp_replace(lower(r_name), '[^a-z0-9]+', '_', 'g') AS parent_id FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "f16_summaries": (f16_summaries, r"SELECT doc_id, round(w / greatest(n, 1), 4) AS avg_sentence, CASE WHEN w > 300 AND d THEN 'high' WHEN w > 100 THEN 'medium' ELSE 'low' END AS level FROM (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS w, len(regexp_extract_all(text, '[.!?]')) AS n, contains(lower(text), 'the') AS d FROM documents)"),
    "e2_places": (e2_places, f"WITH g AS (SELECT place_id, city, count(*) AS n, avg(price) AS p FROM {LISTED} GROUP BY 1, 2), u AS (SELECT *, CASE WHEN n >= 15 THEN 'urban' WHEN n >= 8 THEN 'suburban' ELSE 'rural' END AS u, avg(p) OVER (PARTITION BY city) AS c FROM g) SELECT place_id, u AS lifestyle, round(least(30 * least(n / 20, 1.0) + 50 * least(p / c, 1.0) + 20 * 0.5::DOUBLE, 100.0), 6) AS investment, u || '|' || {PB.replace('price', 'p')} AS facets FROM u"),
    "e7_authority": (e7_authority, f"SELECT doc_id, round(40 * least(n_chars / 5000, 1.0::DOUBLE) + 30 * coalesce(quality, 0) + 30 * CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 6) AS authority, concat_ws(',', {TAGGED(scores.KEY_TOPICS, 'summary')}) AS topics FROM {DESCRIBED} LEFT JOIN labels USING (doc_id)"),
    "e11_rules": (e11_rules, r"SELECT doc_id, round(CASE WHEN v THEN 0.0::DOUBLE ELSE t END, 6) AS score, NOT v AND t >= 0.5 AS relevant FROM (SELECT doc_id, length(text) < 20 AS v, 0.4::DOUBLE * (source IN ('src0', 'src1', 'src2'))::INT + 0.4::DOUBLE * least(20 * (contains(l, 'the')::INT + contains(l, 'and')::INT + contains(l, 'der')::INT + contains(l, 'und')::INT) / sqrt(w) / 4, 1.0::DOUBLE) + 0.2::DOUBLE * (lang = 'en')::INT AS t FROM (SELECT *, lower(text) AS l, greatest(len(regexp_extract_all(text, '\S+')), 1) AS w FROM documents))"),
    "e13b_classified": (e13b_classified, "SELECT doc_id, round(CASE WHEN toxic = 1 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE * CASE WHEN n_chars < 500 THEN 0.8::DOUBLE WHEN n_chars < 2000 THEN 0.6::DOUBLE WHEN n_chars < 8000 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END + 0.4::DOUBLE * quality + 0.2::DOUBLE END, 6) AS score FROM documents JOIN labels USING (doc_id)"),
    "e14_derived": (e14_derived, f"SELECT listing_id, coalesce(n, 0) AS feature_count, price > 1.5 * avg(price) OVER (PARTITION BY city) AS premium, price / greatest(coalesce(n, 0), 1) AS per_feature FROM {LISTED} LEFT JOIN (SELECT listing_id, count(*) AS n FROM {FEATS} GROUP BY 1) USING (listing_id)"),
    "e16_categories": (e16_categories, f"SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(title), 'county') OR doc_id % 3 = 0 THEN 'county' END, CASE WHEN contains(lower(title), 'city') OR (doc_id // 3) % 2 = 0 THEN 'city' END, {TAGGED(scores.CATEGORY_RULES, 'lower(summary)')}, CASE doc_id % 4 WHEN 0 THEN 'utah' WHEN 1 THEN 'california' END) AS categories FROM {DESCRIBED}"),
    "t10_excluded": (t10_excluded, f"WITH {DOCS(chr(115) + 'ource NOT IN (' + chr(39) + 'src0' + chr(39) + ', ' + chr(39) + 'src1' + chr(39) + ')')} SELECT query_id, doc_id, score FROM (SELECT query_id, doc_id, round(score, 6) AS score, {TOP} AS rank FROM bm) WHERE rank <= 2"),
    "t11_routes": (t11_routes, f"WITH q AS (SELECT query_id, unnest(list_distinct({TOK})) AS term FROM {ASKED}), t AS (SELECT 'chunks' AS route, conv_id * 1000 + turn AS doc_id, unnest(list_distinct({TOK})) AS term FROM conversations UNION ALL SELECT 'full', doc_id, unnest(list_distinct({TOK})) FROM documents UNION ALL SELECT 'summaries', doc_id, unnest(list_distinct({TOK})) FROM (SELECT doc_id, string_split(text, chr(10))[1] AS text FROM documents)), m AS (SELECT route, query_id, doc_id, count(*) AS matched FROM q JOIN t USING (term) GROUP BY 1, 2, 3) SELECT route, query_id, count(*) AS hits, max(matched) AS most FROM m GROUP BY 1, 2"),
    "t15_related": (t15_related, f"WITH {BM25} SELECT query_id, doc_id, source, articles, avg_chars FROM (SELECT query_id, doc_id, {TOP} AS rank FROM bm) JOIN documents USING (doc_id) JOIN (SELECT source, count(*) AS articles, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY 1) USING (source) WHERE rank = 1"),
    "t16_insights": (t16_insights, f"SELECT doc_id, wish, insights FROM (SELECT doc_id, CAST(wish AS INT) AS wish, concat_ws(',', {WISHED}) AS insights FROM {DESCRIBED}, (SELECT unnest(range({len(WISHES)})) AS wish, unnest({list(WISHES)}) AS query)) WHERE insights <> ''"),
    "v2_like_this": (v2_like_this, f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ({KNN}) WHERE rank <= 10"),
    "v3_lsh": (v3_lsh, None),
    "v9_linear": (v9_linear, f"WITH {BM25}, k AS ({ASKED_KNN}), b AS (SELECT query_id, doc_id, round(coalesce(v, 0) + coalesce(t, 0), 6) AS score FROM (SELECT query_id, id AS doc_id, score + 1 AS v FROM k WHERE rank <= 20) FULL JOIN (SELECT query_id, doc_id, 0.5::DOUBLE * score AS t FROM bm) USING (query_id, doc_id)) SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b) WHERE rank <= 10"),
    "v13_texts": (v13_texts, "SELECT p_partkey, concat_ws(' | ', p_name, 'brand ' || p_brand, 'size ' || p_size) AS text FROM part"),
    "h2_located": (h2_located, f"WITH {DOCS('lang = ' + chr(39) + 'de' + chr(39))}, a AS (SELECT query_id, doc_id, {TOP} AS rank FROM bm), b AS (SELECT query_id, id AS doc_id, rank FROM ({ASKED_KNN} AND b.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'de'))), u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (FROM a WHERE rank <= 10 UNION ALL FROM b WHERE rank <= 10) GROUP BY 1, 2) SELECT query_id, doc_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM u) WHERE rank <= 3"),
    "h4_centrality": (h4_centrality, f"SELECT listing_id, round((least((count(*) OVER (PARTITION BY place_id) - 1) / 50, 1.0::DOUBLE) + least((count(*) OVER (PARTITION BY city) - 1) / 2000, 1.0::DOUBLE) + least(coalesce(n, 0) / 15, 1.0::DOUBLE) + least((count(*) OVER (PARTITION BY place_id, {PB}) - 1) / 30, 1.0::DOUBLE)) / 4, 6) AS centrality FROM {LISTED} LEFT JOIN (SELECT listing_id, count(*) AS n FROM {FEATS} GROUP BY 1) USING (listing_id)"),
    "g4_bands": (g4_bands, f"SELECT {PB} AS band, count(*) AS n, min(price) AS least, max(price) AS most FROM {LISTED} GROUP BY 1"),
    "g26_adjacent": (g26_adjacent, f"SELECT city, place_id, gap FROM (SELECT city, place_id, round(lead(p) OVER (PARTITION BY city ORDER BY p, place_id) - p, 3) AS gap FROM (SELECT city, place_id, avg(price) AS p FROM {LISTED} GROUP BY 1, 2)) WHERE gap > 30000"),
    "g41_lateral": (g41_lateral, f"SELECT query_id, id, round(score, 6) AS score FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS turn FROM ({KNN}) JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id WHERE rank <= 10 AND a.label <> b.label) WHERE turn <= 2"),
    "g43_chains": (g43_chains, "WITH RECURSIVE t AS MATERIALIZED (SELECT brand, tag FROM (SELECT p_brand AS brand, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1, 2 HAVING count(*) >= 10), e AS MATERIALIZED (SELECT DISTINCT a.brand AS u, b.brand AS v FROM t a JOIN t b ON a.tag = b.tag AND a.brand <> b.brand), r AS (SELECT min(u) AS node, 0 AS hops FROM e UNION SELECT v, hops + 1 FROM r JOIN e ON u = node WHERE hops < 6) SELECT node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1"),
    "q11_embedding_rules": (q11_embedding_rules, "SELECT count(*) AS checked, 'id' AS rule, count(*) FILTER (vec_id IS NULL) AS failed FROM embeddings UNION ALL SELECT count(*), 'dims', count(*) FILTER (len(embedding) <> 64) FROM embeddings UNION ALL SELECT count(*), 'label', count(*) FILTER (label NOT BETWEEN 0 AND 9) FROM embeddings UNION ALL SELECT count(*), 'norm', count(*) FILTER (list_dot_product(embedding, embedding) <= 0) FROM embeddings"),
    "q12_health": (q12_health, "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS chunks, count(*) FILTER (u < last + 1) AS incomplete, count(*) FILTER (n > u) AS repeating FROM (SELECT conv_id, count(*) AS n, count(DISTINCT turn) AS u, max(turn) AS last FROM conversations GROUP BY 1)"),
    "q13_mismatch": (q13_mismatch, "SELECT doc_id, CASE WHEN quality <> 1 AND toxic = 1 THEN 'remove' WHEN quality <> 1 THEN 'skip' WHEN lang = 'en' THEN 'assign' ELSE 'correct' END AS action FROM documents JOIN labels USING (doc_id)"),
    "c4_split": (c4_split, r"SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(ceil(least(400, n - 400 * i) / 150) AS INT) AS parts FROM (SELECT doc_id, n, unnest(range(CAST(ceil(n / 400) AS BIGINT))) AS i FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents))"),
    "d5_coordinates": (lambda s, d: table(s, d, "pages").select("page_id", html.coordinates(F.col("html")).alias("c")).select("page_id", "c.lat", "c.lon"), None),
    "d8_query_set": (d8_query_set, f"WITH g AS (SELECT doc_id, CASE WHEN n_chars >= 2000 THEN 3 WHEN n_chars >= 500 THEN 2 ELSE 1 END AS grade, unnest(['geographic', 'landmark', 'administrative', 'historical', 'semantic']) AS category, unnest(['articles in ' || lang, 'what is known of ' || source, 'articles in ' || lang || ' from ' || source, 'articles of decade ' || (doc_id // 100), 'texts that begin with ' || regexp_extract_all(lower(substr(text, 1, 200)), '[\\p{{L}}\\p{{N}}]+')[1]]) AS query FROM documents), n AS (SELECT category, query, count(*) AS n, count(*) FILTER (grade = 3) AS grade_3, count(*) FILTER (grade = 2) AS grade_2, count(*) FILTER (grade = 1) AS grade_1, array_to_string((list(doc_id ORDER BY grade DESC, doc_id))[1:3], ',') AS expected FROM g WHERE query IS NOT NULL GROUP BY 1, 2) SELECT category, query, n, grade_3, grade_2, grade_1, expected FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, query) AS turn FROM n) WHERE turn <= 5"),
    "m7_models": (m7_models, f"WITH {MET}, k AS (SELECT unnest([3, 5, 10]) AS k), f AS (SELECT k, query_id, sum(hit) FILTER (rank <= k) AS hits, count(*) FILTER (rank <= k) AS depth FROM run, k GROUP BY 1, 2), p AS (SELECT k, hits / depth AS p, hits / relevant AS r FROM f JOIN rel USING (query_id)) SELECT 'top' || k AS model, 'all' AS category, mean_f1, row_number() OVER (ORDER BY mean_f1 DESC, 'top' || k) AS rank FROM (SELECT k, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS mean_f1 FROM p GROUP BY 1)"),
    "m9_validated": (m9_validated, f"WITH {BM25} SELECT query_id, round(matched / n, 6) AS share, matched * 2 >= n AS valid FROM (SELECT *, {TOP} AS rank FROM bm) JOIN (SELECT query_id, count(*) AS n FROM q GROUP BY 1) USING (query_id) WHERE rank = 1"),
    "i3b_dimension": (i3b_dimension, "SELECT DISTINCT c_mktsegment, c_mktsegment < 'C' AS known FROM customer"),
}

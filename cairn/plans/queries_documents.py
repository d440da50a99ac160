"""Scores, checks, chunks, pages, retrieval metrics, incremental work, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import checks, chunks, evaluate, evidence, html, incremental, scores, vector
from cairn.plans import medallion
from cairn.plans.queries_aggregate import LISTED
from cairn.plans.queries_relational import FEATS
from cairn.plans.queries_search import KNN, queries_of
from cairn.sources import merge, shared, sinks
from cairn.sources.shared import new_path
from cairn.sources.tables import table
from cairn.streaming import events


def place_pages(s, d):
    """A page for each customer, with hints of each kind on some: category, info box, coordinates in four forms, lead."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, n, r = F.col("c_custkey"), F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")), F.col("r_name")
    here = lambda test, *cells: F.when(test, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in cells])).otherwise("")
    under = lambda x: F.replace(x, F.lit(" "), F.lit("_"))
    parts = [
        here(k % 2 == 0, '<link rel="mw:PageProp/Category" href="./Category:Towns_in_', under(n), "_County,_", under(r), '">'),
        here(k % 4 == 0, '<link rel="mw:PageProp/Category" href="./Category:Mountains_of_', under(n), '">'),
        here(k % 3 == 0, '<table class="infobox"><tr><th class="infobox-above">', F.col("c_name"), ", ", r, "</th></tr><tr><th>State</th><td>", F.when(k % 9 == 0, "ASIA").otherwise(r), "[1]</td></tr><tr><th>County</th><td>", n, " County, west</td></tr></table>"),
        here(k % 5 == 0, '<span class="geo">', k % 80, "; -", k % 170, "</span>"),
        here(k % 5 == 1, '<a href="//maps/?params=', k % 80, "_", k % 60, "_30_N_", k % 170, '_0_0_W">map</a>'),
        here(k % 5 == 2, "<p>At ", k % 80, "°", k % 60, "′30″N ", k % 170, "°0′0″W</p>"),
        here(k % 7 != 0, "<p>", F.col("c_name"), " is a city in ", n, " County, ", r, ". It has parks, schools and a lively centre, and people like to live there for many reasons.</p>"),
    ]
    return c.select("c_custkey", F.concat(*parts).alias("html"))


REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def d3_evidence(s, d):
    """The best hint for every field of every page."""
    return evidence.resolved(evidence.evidence(place_pages(s, d), "c_custkey", states=REGIONS)).select(F.col("id").alias("c_custkey"), "field", "value", "source", "confidence", "agree")


def d4_groups(s, d):
    """Each page's category links in their groups."""
    return evidence.category_groups(place_pages(s, d), "c_custkey", states=REGIONS).select(F.col("id").alias("c_custkey"), "kind", F.array_join("categories", ";").alias("categories"))


def e1_tags(s, d):
    return medallion.gold(medallion.silver(medallion.bronze(s, d)))["listings"].select("listing_id", "feature_count", "segment", F.array_join("tags", "|").alias("tags"))


def e3_place_scores(s, d):
    c = table(s, d, "customer")
    walk, school = (F.col("c_custkey") % 10).cast("double"), (F.col("c_nationkey") % 11).cast("double")
    live = scores.livability(walk, school, 10.0)
    return c.select("c_custkey", F.round(live, 6).alias("livability"), F.round(scores.investment(walk / 10, live / 100, school / 10), 6).alias("investment"), scores.density(F.col("c_custkey") * 37).alias("density"), scores.completeness([F.col("c_name"), F.when(F.col("c_acctbal") > 0, 1)]).alias("completeness"))


def e8_article_scores(s, d):
    return medallion.gold(medallion.silver(medallion.bronze(s, d)))["articles"].select("doc_id", "depth", "article_quality", "rank_score")


def e10_relevance(s, d):
    """The first line of a document is its title, the next two its categories; every third document has coordinates."""
    lines = F.split("text", "\n")
    docs = table(s, d, "documents").select("doc_id", "text", lines[0].alias("title"), F.slice(lines, 2, 2).alias("categories"), (F.col("doc_id") % 3 == 0).alias("placed"))
    return docs.select("doc_id", scores.page_relevance(F.col("title"), F.col("text"), ["the", "und"], ["with", "nicht"], categories=F.col("categories"), placed=F.col("placed")).alias("score"))


def e13_flags(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return j.select("doc_id", scores.relevance_flag(F.col("quality") * 0.4 + F.col("toxic") * 0.1 + 0.1, F.col("lang") != "fr").alias("flag"))


def e15_groups(s, d):
    p = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("name"))
    return p.groupBy(scores.amenity_group(F.col("name"), {"colour": ("red", "blue", "green"), "thing": ("widget", "gadget")}).alias("grp")).agg(F.count("*").alias("n"))


def q4_rules(s, d):
    return checks.rule_counts(table(s, d, "lineitem"), {"quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") <= 0.05, "flag": F.col("l_returnflag").isin("A", "N")})


def q6_references(s, d):
    o = table(s, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_custkey") + 10_000_000).otherwise(F.col("o_custkey")))
    return checks.broken_references(o, "o_custkey", table(s, d, "customer"), "c_custkey")


def q7_content(s, d):
    docs = table(s, d, "documents")
    return docs.agg(F.count_if(F.length(F.trim("text")) == 0).alias("empty"), F.count_if(F.length("text") < 100).alias("short"), F.count_if(~F.col("lang").isin("en", "de")).alias("out_of_scope"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"))


def q8_facts(s, d):
    facts = table(s, d, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", F.lit(1).alias("expected"), F.lit("high").alias("severity"))
    return checks.fact_issues(table(s, d, "nation"), facts, "n_nationkey", "n_regionkey")


def q9_difference(s, d):
    return checks.difference(table(s, d, "documents"), table(s, d, "labels"), ["doc_id"])


def q10_sequences(s, d):
    c = table(s, d, "conversations").where("NOT (conv_id % 5 = 0 AND turn = 1)")
    return checks.sequence_gaps(c, "conv_id", "turn").select("conv_id", "n", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "repeated")


def c1_fixed(s, d):
    out = chunks.fixed(table(s, d, "documents"), "doc_id", "text", 100, 20)
    return out.select("doc_id", "chunk_index", "chunk_total", "text_hash", "parent_hash")


def c7_joined(s, d):
    out = chunks.joined(table(s, d, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.sha2("text", 256).alias("text_hash"), "complete")


def c8_related(s, d):
    """Of each turn how many others its conversation has."""
    c = table(s, d, "conversations").select("conv_id", "turn")
    return c.join(c.groupBy("conv_id").agg((F.count("*") - 1).alias("related")), "conv_id").where("related > 0")


def c9_correlated(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return e.join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("label").agg(F.count("quality").alias("matched"), F.count_if(F.col("quality").isNull()).alias("unmatched"))


def c10_duplicates(s, d):
    docs = table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return sinks.latest(docs, ["h"], [F.asc("doc_id")]).select("doc_id", "h")


def d1_pages(s, d):
    out = html.extract(table(s, d, "pages").select("page_id", "html"))
    return out.select("page_id", "title", F.size("paragraphs").alias("paragraphs"), F.array_join("headings", "|").alias("headings"), F.size("infobox").alias("facts"), F.size("links").alias("links"), html.cut_at_sentence(F.array_join("paragraphs", "\n"), 2000).alias("text"))


def d2_stripped(s, d):
    t = html.stripped(F.col("html"))
    return table(s, d, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t.cast("binary")).alias("digest"))


def d3_places(s, d):
    out = html.extract(table(s, d, "pages").select("page_id", "html"))
    return out.select("page_id", html.place_hint(F.col("infobox"), F.get("paragraphs", F.lit(0))).alias("p"), html.coordinates(F.col("html")).alias("c")).select("page_id", "p.place", "p.confidence", "c.lat", "c.lon")


def linked_pages(s, d):
    """The pages with an address each and links to eight others by their number."""
    pages = table(s, d, "pages").select("page_id", F.length("html").alias("chars"))
    n = pages.count()
    link = lambda k: F.concat(F.lit('<a href="//site/'), ((F.col("page_id") * 7 + k * k) % n).cast("string"), F.lit('">x</a>'))
    return pages.select("page_id", "chars", F.concat(F.lit("//site/"), F.col("page_id").cast("string")).alias("url"), F.concat(*[link(k) for k in range(1, 9)]).alias("html"))


def d6_frontier(s, d):
    """Pages within two links of every tenth page, over the five links of each page to its longest neighbours."""
    pages = linked_pages(s, d)
    links = html.link_table(pages, "page_id", "url", "html")
    scored = pages.select(F.col("page_id").alias("page"), (F.col("chars") / 100).alias("score"))
    return html.frontier(links, scored, pages.where("page_id % 10 = 0").select(F.col("page_id").alias("page")), 2)


def run_and_grades(s, d):
    """The ten nearest rows of each query, graded 1 where the label is the query's; and of each query how many rows have that grade."""
    e = table(s, d, "embeddings")
    label = e.select(F.col("vec_id").alias("doc_id"), "label")
    q = queries_of(s, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    run = vector.nearest_join(queries_of(s, d), e, 10, same=True).select("query_id", F.col("id").alias("doc_id"), "rank")
    judged = run.join(label, "doc_id").join(q, "query_id").select("query_id", "doc_id", "rank", (F.col("label") == F.col("own")).cast("int").alias("grade"))
    sizes = e.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("n"))  # all but the query itself
    return judged, q.join(sizes, "own").select("query_id", F.lit(1).alias("grade"), "n")


def m1_per_query(s, d):
    out = evaluate.per_graded(*run_and_grades(s, d), k=5)
    return out.select("query_id", *[F.round(m, 6).alias(m) for m in evaluate.MEASURES])


def m6_summary(s, d):
    out = evaluate.summary(evaluate.per_graded(*run_and_grades(s, d), k=5))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])


def m8_calibration(s, d):
    j = table(s, d, "labels").withColumn("confidence", (F.col("doc_id") % 10) / 10)
    return j.agg(F.round(F.avg(0.5 * F.col("quality") + 0.3 * (1 - F.col("toxic")) + 0.2), 6).alias("accuracy"), F.round(F.avg(F.abs(F.col("confidence") - F.col("quality"))), 6).alias("calibration_error"), F.round(F.stddev_pop("confidence"), 6).alias("std"))


def i1_new(s, d):
    return incremental.unprocessed(table(s, d, "documents"), table(s, d, "labels"), "doc_id", [F.desc("n_chars"), F.asc("doc_id")], 40).select("doc_id", "n_chars")


def i2_upsert(s, d):
    """Half of the events as changes to the other half: of each user and kind the newest event of both stays."""
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    path, keys, newest = new_path(s, "merged"), ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.asc("event_id")]
    for number in (0, 1):
        merge.merge(e.where(F.col("event_id") % 2 == number), number, path, keys, newest, 8)
    return merge.current(s, path, e.schema).select(*keys, "event_id", "value")


def i3_cache(s, d):
    docs = table(s, d, "documents").select("doc_id", "text", "lang")
    cache = docs.where("doc_id % 2 = 0").select(incremental.content_key("text").alias("cache_key"), F.lit("known").alias("result")).distinct()
    hit, miss = incremental.split_by_cache(docs, cache, incremental.content_key("text"))
    return hit.select("doc_id", "result").unionByName(miss.select("doc_id", F.lit("new").alias("result")))


def i3c_routed(s, d):
    kept, gone = incremental.routed(table(s, d, "documents").select("doc_id", "lang"), F.col("lang").isin("en", "de"), F.concat(F.lit("language "), "lang"))
    return kept.select("doc_id", F.lit("").alias("reason")).unionByName(gone.select("doc_id", "reason"))


def streamed(s, d, made, mode):
    """Run a stream over the events table to its end, and read what it wrote."""
    stream = events.source(s, f"{d}/event[s].parquet", table(s, d, "events").schema)
    out = made(stream)
    path = shared.new_path(s, "stream")
    events.written(out, path, shared.new_path(s, "offsets"), mode).awaitTermination()
    return s.read.schema(out.schema).parquet(path)


def i4_stream_dedup(s, d):
    """Events arrive twice; one of each remains."""
    return streamed(s, d, lambda e: events.deduplicated(e.union(e), ["event_id"], "ts", "40 days").select("event_id", "event_type"), "append")


def i4_stream_upserts(s, d):
    """Files of events merged into a bucketed table one batch after another."""
    e = table(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    path, keys = new_path(s, "stream"), ["user_id", "event_type"]
    e.repartition(3, "event_id").write.parquet(f"{path}/in")
    stream = events.source(s, f"{path}/in", e.schema, files=1)
    events.upsert_into(stream, f"{path}/table", f"{path}/state", keys, [F.desc_nulls_last("ts"), F.asc("event_id")], 8).awaitTermination()
    return merge.current(s, f"{path}/table", e.schema).select(*keys, "event_id", "value")


def checked_orders(s, d):
    """Orders as documents, with a key that is missing for some; the folder and the counts of the pass."""
    path = new_path(s, "documents")
    rows = table(s, d, "orders").withColumn("id", F.when(F.col("o_orderkey") % 100 != 7, F.col("o_orderkey")))
    rules = {"price": F.col("o_totalprice") > 5000, "status": F.col("o_orderstatus") != "P"}
    return path, sinks.write_documents(rows, path, "id", {"price": F.col("o_totalprice"), "kind": F.col("o_orderpriority")}, rules)


def s9_counters(s, d):
    """What the sink counted, beside the documents that it wrote."""
    path, seen = checked_orders(s, d)
    return s.read.parquet(path).where("part = 'accepted'").agg(F.count("doc").alias("documents")).select(*[F.lit(n).cast("long").alias(c) for c, n in seen.items()], "documents")


def s9_rejected(s, d):
    """The dead letters by kind, read from their raw rows."""
    path, _ = checked_orders(s, d)
    return s.read.parquet(path).where("part = 'rejected'").groupBy(F.get_json_object("raw", "$.o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


def q14_run(s, d):
    """Rows of every table of a whole run of the layers; bronze listings are silver and rejected ones."""
    seen = medallion.run(s, d, new_path(s, "layers"), 5000.0)
    return s.createDataFrame([(stage, counts["rows"]) for stage, counts in seen.items()], "stage string, rows long")


def i5_stream_histogram(s, d):
    return streamed(s, d, lambda e: events.histogram(e, "ts", "1 day", "1 hour", ["event_type"]), "complete")


GOLD_SEG = "CASE WHEN price < 100000 THEN 'budget' WHEN price < 200000 THEN 'affordable' WHEN price < 400000 THEN 'premium' ELSE 'luxury' END"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
CH = f"(SELECT doc_id, i, len(st) AS total, array_to_string(list_slice(w, st[i + 1] + 1, st[i + 1] + 100), ' ') AS chunk FROM (SELECT doc_id, w, st, unnest(range(len(st))) AS i FROM (SELECT doc_id, w, range(0, greatest(len(w) - 20, 1), 80) AS st FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) > 0)))"
MET = f"""
run AS (SELECT k.query_id, k.id AS doc_id, k.rank, (q.label = e.label)::INT AS hit FROM ({KNN}) k JOIN embeddings q ON q.vec_id = k.query_id JOIN embeddings e ON e.vec_id = k.id WHERE k.rank <= 10),
rel AS (SELECT a.vec_id AS query_id, count(*) AS relevant FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1),
h AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS hits, greatest(log2(rank), 1.0) AS disc FROM run),
g AS (SELECT query_id, sum(hit) FILTER (rank <= 5) AS hk, sum(hits / rank) FILTER (hit = 1) AS ps, min(rank) FILTER (hit = 1) AS f, sum(hit / disc) FILTER (rank <= 5) AS dcg FROM h GROUP BY 1),
m AS (SELECT rel.query_id, relevant, coalesce(hk, 0) AS hk, coalesce(hk, 0) / 5 AS p, coalesce(hk, 0) / relevant AS r, coalesce(ps, 0) / relevant AS ap, coalesce(1 / f, 0) AS rr,
             coalesce(dcg, 0) / (SELECT sum(1 / greatest(log2(i), 1.0)) FROM range(1, 6) t(i) WHERE i <= relevant) AS ndcg FROM rel LEFT JOIN g USING (query_id)),
s AS (SELECT query_id, hk, relevant, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, ap, rr, ndcg FROM m)"""
D3_SQL = """WITH c AS (SELECT c_custkey AS k, c_name AS name, replace(n_name, '_', ' ') AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
h AS (SELECT k, 'state' AS field, r AS value, 'category' AS source, 0.9::DOUBLE AS confidence FROM c WHERE k % 2 = 0 UNION ALL SELECT k, 'county', n, 'category', 0.85 FROM c WHERE k % 2 = 0
UNION ALL SELECT k, 'state', CASE WHEN k % 9 = 0 THEN 'ASIA' ELSE r END, 'infobox', 0.95 FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'county', n, 'infobox', 0.95 FROM c WHERE k % 3 = 0 UNION ALL SELECT k, 'city', name, 'infobox', 0.85 FROM c WHERE k % 3 = 0
UNION ALL SELECT k, 'coordinates', printf('%.5f, %.5f', (k % 80)::DOUBLE, -(k % 170)::DOUBLE), 'geo', 0.95 FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'coordinates', printf('%.5f, %.5f', (k % 80) + (k % 60) / 60 + 30 / 3600, -(k % 170)::DOUBLE), CASE WHEN k % 5 = 1 THEN 'link' ELSE 'text' END, CASE WHEN k % 5 = 1 THEN 0.9 ELSE 0.8 END FROM c WHERE k % 5 IN (1, 2)
UNION ALL SELECT k, f, v, 'lead', w FROM (SELECT k, unnest(['state', 'county', 'city']) AS f, unnest([r, n, name]) AS v, unnest([0.7, 0.6, 0.6]) AS w FROM c WHERE k % 7 <> 0)),
b AS (SELECT k, field, value, source, confidence, row_number() OVER (PARTITION BY k, field ORDER BY confidence DESC, source DESC, value DESC) AS turn FROM h)
SELECT b.k AS c_custkey, b.field, b.value, b.source, b.confidence, CAST((SELECT count(*) FROM h WHERE h.k = b.k AND h.field = b.field AND lower(h.value) = lower(b.value)) AS INT) AS agree FROM b WHERE turn = 1"""
QUERIES = {
    "e1_tags": (e1_tags, f"SELECT listing_id, CAST(coalesce(n, 0) AS INT) AS feature_count, {GOLD_SEG} AS segment, lower(kind) || '|' || coalesce(n, 0) || '_size|' || {GOLD_SEG} AS tags FROM {LISTED} LEFT JOIN (SELECT listing_id, count(*) AS n FROM {FEATS} GROUP BY 1) USING (listing_id)"),
    "e3_place_scores": (e3_place_scores, "SELECT c_custkey, round(live, 6) AS livability, round(least(30 * w / 10 + 50 * live / 100 + 20 * sc / 10, 100.0), 6) AS investment, CASE WHEN c_custkey * 37 < 5000 THEN 'low' WHEN c_custkey * 37 < 20000 THEN 'medium' WHEN c_custkey * 37 < 50000 THEN 'high' ELSE 'very_high' END AS density, CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS completeness FROM (SELECT *, w * 10 * 0.5::DOUBLE + sc * 10 * 0.5::DOUBLE AS live FROM (SELECT *, (c_custkey % 10)::DOUBLE AS w, (c_nationkey % 11)::DOUBLE AS sc FROM customer))"),
    "e8_article_scores": (e8_article_scores, "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'minimal' WHEN n_chars < 2000 THEN 'basic' WHEN n_chars < 5000 THEN 'detailed' ELSE 'comprehensive' END AS depth, aq AS article_quality, round(0.45::DOUBLE * aq + 0.25::DOUBLE * c + 0.15::DOUBLE * 0.4::DOUBLE + 0.15::DOUBLE * 0.5::DOUBLE, 6) AS rank_score FROM (SELECT *, round(least(least(n_chars / 5000, 1.0::DOUBLE) * 0.5::DOUBLE + c * 0.5::DOUBLE + 0.1::DOUBLE, 1.0::DOUBLE), 6) AS aq FROM (SELECT doc_id, n_chars, coalesce(quality::DOUBLE, 0.5::DOUBLE) AS c FROM documents LEFT JOIN labels USING (doc_id)))"),
    "e10_relevance": (e10_relevance, "SELECT doc_id, CAST(10 * (contains(h, 'the')::INT + contains(h, 'und')::INT) + 5 * (contains(t, 'the')::INT + contains(t, 'und')::INT) + 2 * (contains(h, 'with')::INT + contains(h, 'nicht')::INT) + 3 * (contains(t, 'with')::INT + contains(t, 'nicht')::INT) + coalesce(list_sum(list_transform(c, lambda x: 5 * (contains(x, 'the') OR contains(x, 'und'))::INT + contains(x, 'with')::INT + contains(x, 'nicht')::INT)), 0) + CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 0 END AS INT) AS score FROM (SELECT doc_id, lower(l[1] || ' ' || substr(text, 1, 5000)) AS h, lower(l[1]) AS t, list_transform(l[2:3], lambda x: lower(x)) AS c FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents))"),
    "e13_flags": (e13_flags, "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'non_target' WHEN x < 0.2 THEN 'critical' WHEN x < 0.5 THEN 'low_relevance' ELSE 'kept' END AS flag FROM (SELECT *, quality * 0.4::DOUBLE + toxic * 0.1::DOUBLE + 0.1::DOUBLE AS x FROM documents JOIN labels USING (doc_id))"),
    "e15_groups": (e15_groups, "SELECT CASE WHEN contains(n, 'red') OR contains(n, 'blue') OR contains(n, 'green') THEN 'colour' WHEN contains(n, 'widget') OR contains(n, 'gadget') THEN 'thing' ELSE 'other' END AS grp, count(*) AS n FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS n FROM part) GROUP BY 1"),
    "q2_nulls": (lambda s, d: table(s, d, "orders").agg(F.count_if(F.col("o_orderkey").isNull()).alias("nulls"), F.count("*").alias("n")), "SELECT count(*) FILTER (o_orderkey IS NULL) AS nulls, count(*) AS n FROM orders"),
    "q3_duplicates": (lambda s, d: checks.duplicate_key_count(table(s, d, "lineitem"), ["l_orderkey", "l_suppkey"]), "SELECT count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)"),
    "q4_rules": (q4_rules, "SELECT count(*) AS checked, 'quantity' AS rule, count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50) AS failed FROM lineitem UNION ALL SELECT count(*), 'discount', count(*) FILTER (l_discount > 0.05::DOUBLE) FROM lineitem UNION ALL SELECT count(*), 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem"),
    "q6_references": (q6_references, "SELECT o_custkey + 10000000 AS value, count(*) AS rows FROM orders WHERE o_orderkey % 13 = 0 GROUP BY 1"),
    "q7_content": (q7_content, "SELECT count(*) FILTER (length(trim(text)) = 0) AS empty, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (lang NOT IN ('en', 'de')) AS out_of_scope, round(avg(length(text)), 4) AS avg_chars FROM documents"),
    "q8_facts": (q8_facts, "SELECT n_nationkey, n_regionkey AS found, CAST(1 AS INT) AS expected, 'high' AS severity FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey <> 1"),
    "q9_difference": (q9_difference, "SELECT doc_id, 'first' AS only_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'second' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"),
    "q10_sequences": (q10_sequences, "WITH c AS (SELECT * FROM conversations WHERE NOT (conv_id % 5 = 0 AND turn = 1)), g AS (SELECT conv_id, count(*) AS n, max(turn) AS last, list(DISTINCT turn) AS seen FROM c GROUP BY 1) SELECT conv_id, n, array_to_string(list_filter(range(0, last + 1), lambda i: NOT list_contains(seen, i)), ',') AS missing, n - len(seen) AS repeated FROM g"),
    "q14_layer_rules": (medallion.checked, f"SELECT count(*) AS checked, unnest(['price', 'city', 'features']) AS rule, unnest([0, 0, count(*) FILTER (n IS NULL)]) AS failed FROM {LISTED} LEFT JOIN (SELECT listing_id, count(*) AS n FROM {FEATS} GROUP BY 1) USING (listing_id)"),
    "c1_fixed_chunks": (c1_fixed, f"SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(total AS INT) AS chunk_total, sha256(chunk) AS text_hash, CASE WHEN total > 1 THEN md5(CAST(doc_id AS VARCHAR)) END AS parent_hash FROM {CH}"),
    "c2_sentence_chunks": (lambda s, d: chunks.by_sentences(table(s, d, "documents"), "doc_id", "text", 80).select("doc_id", "chunk_index", "text_hash"), None),
    "c3_semantic_chunks": (lambda s, d: chunks.by_distance(table(s, d, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "chunk_total"), None),
    "c6_linked": (lambda s, d: chunks.linked(table(s, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.coalesce("previous", F.lit(-1)).alias("previous"), F.coalesce("following", F.lit(-1)).alias("following")), "SELECT conv_id, turn, coalesce(lag(turn) OVER w, -1) AS previous, coalesce(lead(turn) OVER w, -1) AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "c7_joined": (c7_joined, "SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn, text)) AS text_hash, count(DISTINCT turn) = max(turn) + 1 AS complete FROM conversations GROUP BY 1"),
    "c8_related": (c8_related, "SELECT a.conv_id, a.turn, count(*) AS related FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY 1, 2"),
    "c9_correlated": (c9_correlated, "SELECT label, count(quality) AS matched, count(*) - count(quality) AS unmatched FROM embeddings LEFT JOIN labels ON vec_id = doc_id GROUP BY 1"),
    "c10_duplicates": (c10_duplicates, "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY 2"),
    "d1_pages": (d1_pages, None),
    "d2_stripped": (d2_stripped, "SELECT page_id, length(t) AS chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS t FROM pages)"),
    "d3_places": (d3_places, None),
    "d6_frontier": (d6_frontier, "WITH n AS (SELECT count(*) AS n FROM pages), l AS (SELECT DISTINCT source, (source * 7 + k * k) % n AS target FROM (SELECT page_id AS source, unnest(range(1, 9)) AS k FROM pages), n), b AS MATERIALIZED (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY length(html) DESC, target) AS turn FROM l JOIN pages ON page_id = target WHERE source <> target AND length(html) / 100 > 5.0) WHERE turn <= 5), a AS (SELECT page_id AS page FROM pages WHERE page_id % 10 = 0), c AS (SELECT DISTINCT target AS page FROM b JOIN a ON source = page WHERE target NOT IN (FROM a)), e AS (SELECT DISTINCT target AS page FROM b JOIN c ON source = page WHERE target NOT IN (FROM a) AND target NOT IN (FROM c)) SELECT page, 0 AS depth FROM a UNION ALL SELECT page, 1 FROM c UNION ALL SELECT page, 2 FROM e"),
    "d7_depths": (lambda s, d: table(s, d, "pages").groupBy((F.size(F.split("url", "/")) - 3).alias("depth")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("html")), 4).alias("chars")), "SELECT CAST(len(string_split(url, '/')) - 3 AS INT) AS depth, count(*) AS n, round(avg(length(html)), 4) AS chars FROM pages GROUP BY 1"),
    "m1_per_query": (m1_per_query, f"WITH {MET} SELECT query_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(ap, 6) AS ap, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM s"),
    "m6_summary": (m6_summary, f"WITH {MET} SELECT count(*) AS queries, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(ap), 6) AS mean_ap, round(avg(rr), 6) AS mean_rr, round(avg(ndcg), 6) AS mean_ndcg, round(sum(hk) / (5 * count(*)), 6) AS micro_precision, round(sum(hk) / sum(relevant), 6) AS micro_recall FROM s"),
    "m8_calibration": (m8_calibration, "SELECT round(avg(0.5::DOUBLE * quality + 0.3::DOUBLE * (1 - toxic) + 0.2::DOUBLE), 6) AS accuracy, round(avg(abs((doc_id % 10) / 10 - quality)), 6) AS calibration_error, round(stddev_pop((doc_id % 10) / 10), 6) AS std FROM labels"),
    "m10_summaries": (lambda s, d: table(s, d, "documents").agg(F.round(F.avg(F.length("text")), 4).alias("chars"), *[F.round(F.avg(F.contains(F.lower("text"), F.lit(w)).cast("int")), 6).alias(w) for w in ("the", "und", "que")]), "SELECT round(avg(length(text)), 4) AS chars, round(avg(contains(lower(text), 'the')::INT), 6) AS the, round(avg(contains(lower(text), 'und')::INT), 6) AS und, round(avg(contains(lower(text), 'que')::INT), 6) AS que FROM documents"),
    "i1_new": (i1_new, "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 40"),
    "i2_upsert": (i2_upsert, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS turn FROM events) WHERE turn = 1"),
    "i3_cache": (i3_cache, "SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) THEN 'known' ELSE 'new' END AS result FROM documents"),
    "i3c_routed": (i3c_routed, "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN '' ELSE 'language ' || lang END AS reason FROM documents"),
    "i4_stream_upserts": (i4_stream_upserts, "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id) AS turn FROM events) WHERE turn = 1"),
    "s9_counters": (s9_counters, "SELECT count(*) AS rows_in, count(*) FILTER (ok) AS rows_out, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (o_orderkey % 100 = 7) AS reason_key, count(*) FILTER (o_totalprice <= 5000) AS reason_price, count(*) FILTER (o_orderstatus = 'P') AS reason_status, count(*) FILTER (ok) AS documents FROM (SELECT *, o_orderkey % 100 <> 7 AND o_totalprice > 5000 AND o_orderstatus <> 'P' AS ok FROM orders)"),
    "s9_rejected": (s9_rejected, "SELECT o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_totalprice <= 5000 OR o_orderstatus = 'P' OR o_orderkey % 100 = 7 GROUP BY 1"),
    "q14_run": (q14_run, f"WITH l AS (FROM {LISTED}), a AS (SELECT count(*) AS n FROM documents) SELECT 'bronze/listings' AS stage, count(*) AS rows FROM l UNION ALL SELECT 'bronze/features', count(*) FROM {FEATS} UNION ALL SELECT 'bronze/articles', n FROM a UNION ALL SELECT 'silver/listings', count(*) FROM l WHERE price > 5000 UNION ALL SELECT 'silver/articles', n FROM a UNION ALL SELECT 'rejected/listings', count(*) FROM l WHERE price <= 5000 UNION ALL SELECT 'gold/listings', count(*) FROM l WHERE price > 5000 UNION ALL SELECT 'gold/articles', n FROM a"),
    "d3_evidence": (d3_evidence, D3_SQL),
    "d4_groups": (d4_groups, "WITH c AS (SELECT c_custkey, replace(n_name, '_', ' ') AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), t AS (SELECT c_custkey, 'Towns in ' || n || ' County, ' || r AS x FROM c WHERE c_custkey % 2 = 0) SELECT c_custkey, 'state' AS kind, x AS categories FROM t UNION ALL SELECT c_custkey, 'county', x FROM t UNION ALL SELECT c_custkey, 'geographic', 'Mountains of ' || n FROM c WHERE c_custkey % 4 = 0"),
    "i4_stream_dedup": (i4_stream_dedup, "SELECT event_id, event_type FROM events"),
    "i5_stream_histogram": (i5_stream_histogram, "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "f17_normalized": (lambda s, d: table(s, d, "part").select("p_partkey", text.slug(F.col("p_type")).alias("type_slug"), text.topic_tags(F.col("p_name"), {"r": "red", "w": "widget"}).alias("t")).select("p_partkey", "type_slug", F.array_join("t", ",").alias("tags")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS type_slug, concat_ws(',', CASE WHEN contains(p_name, 'red') THEN 'r' END, CASE WHEN contains(p_name, 'widget') THEN 'w' END) AS tags FROM part"),
}

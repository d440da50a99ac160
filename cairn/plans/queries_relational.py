"""Scans, projections, predicates, joins, set operations, windows and limits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import geo, text
from cairn.operators import facets, filters, graph, overlap, spatial
from cairn.plans.binding import feature_uses, listing_features, listings
from cairn.plans.queries_aggregate import BAND_SQL, BANDS, CUTS, HAV, LISTED
from cairn.sources import sinks
from cairn.sources.shared import cut, stored
from cairn.sources.tables import table

FEATS = "(SELECT DISTINCT l_orderkey AS listing_id, p_brand AS feature FROM lineitem JOIN part ON l_partkey = p_partkey)"


def s3_left_scan(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


def s10_defaults(s, d):
    shape = {"name": F.col("c_name"), "segment": F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), "balance": F.col("c_acctbal")}
    return sinks.documents(table(s, d, "customer"), "c_custkey", shape, {"segment": "active", "balance": 0.0}).select("_id", "doc.*")


def s11_upsert(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    changes = o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).union(o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey") + 10_000_000, F.lit("N")))
    return sinks.upsert(o, changes, ["o_orderkey"])


def p4_search(s, d):
    p = table(s, d, "part")
    test = filters.bool_query(filter=[{"range": {"p_retailprice": {"gte": 910, "lte": 990}}}, {"range": {"p_size": {"gte": 10}}}])
    return p.where(test).select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey").limit(50)


def p6_clauses(s, d):
    c = table(s, d, "customer")
    tests = {"term": {"term": {"c_mktsegment": "BUILDING"}}, "terms": {"terms": {"c_mktsegment": ["BUILDING", "MACHINERY"]}}, "range": {"range": {"c_acctbal": {"gt": 0, "lte": 5000}}}, "exists": {"exists": "c_name"}, "prefix": {"prefix": {"c_name": "Customer#0000"}}, "wildcard": {"wildcard": {"c_name": "*1?"}}}
    return c.select("c_custkey", *[filters.clause(t).alias(f"by_{n}") for n, t in tests.items()])


def p7_bool(s, d):
    docs = table(s, d, "documents")
    should = [({"contains": {"text": "the"}}, 1.0), ({"contains": {"text": "and"}}, 2.0), ({"contains": {"text": "der"}}, 1.5)]
    test = filters.bool_query(must=[{"exists": "lang"}], should=[c for c, _ in should], must_not=[{"term": {"lang": "fr"}}], minimum_should_match=2)
    return docs.where(test).select("doc_id", filters.should_score(should).alias("score"))


def p9_exists(s, d):
    f = listing_features(s, d)
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("listing_id"))
    for brand in ("Brand#11", "Brand#12"):
        o = o.join(f.where(F.col("feature") == brand), "listing_id", "left_semi")
    return o


def p10_not_exists(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("listing_id"))
    return o.join(listing_features(s, d).where(F.col("feature").isin("Brand#11", "Brand#12")), "listing_id", "left_anti")


def p11_mix(s, d):
    flags = listing_features(s, d).groupBy("listing_id").agg(*[F.bool_or(F.col("feature") == b).alias(b[-2:]) for b in ("Brand#11", "Brand#12", "Brand#21", "Brand#22")])
    hit = (F.col("11") | F.col("12")) & (F.col("21") | F.col("22"))
    return flags.where(hit).select("listing_id", F.when(F.col("11"), "first").otherwise("second").alias("label"))


def p13_state_codes(s, d):
    n = table(s, d, "nation")
    return n.select("n_nationkey", text.state_code(F.col("n_name")).alias("code"), text.state_code(F.lit(" new york ")).alias("ny"))


def p14_aliases(s, d):
    n = F.upper(F.trim("n_name"))
    return table(s, d, "nation").select("n_nationkey", F.when(n.isin("UNITED STATES", "USA"), "US").otherwise(n).alias("alias"), F.substring("n_name", 1, 5).alias("head"))


def p16_nulls(s, d):
    return table(s, d, "customer").select("c_custkey", text.null_if_blank(F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "NULL").otherwise(F.col("c_name"))).alias("name"))


def p17_point(s, d):
    return table(s, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_totalprice")


def p18_arrays(s, d):
    docs = table(s, d, "documents").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    tests = [F.array_contains("t", "the"), F.arrays_overlap("t", F.array(F.lit("der"), F.lit("die"))), F.size("t") > 100]
    return docs.select("doc_id", *[t.alias(n) for t, n in zip(tests, ("has_term", "has_any", "long"), strict=True)], filters.at_least(tests, 2).alias("two_of_three"))


def j5_optional(s, d):
    n, sup = table(s, d, "nation"), table(s, d, "supplier")
    return n.join(sup.where("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("rich"))


def j7_unprocessed(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


def j8_orphans(s, d):
    o = table(s, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey")).alias("c_custkey"))
    return o.join(table(s, d, "customer"), "c_custkey", "left_anti").groupBy("c_custkey").agg(F.count("*").alias("orphans"))


def j9_shared(s, d):
    """Listings with four brands in common: pairs of the least listings of equal brand sets, and which set each listing has."""
    uses, bits = feature_uses(s, d), overlap.feature_bits(table(s, d, "part"), "p_brand")
    sets = overlap.feature_sets(uses, "listing_id", "feature") if bits is None else overlap.bit_sets(uses, "listing_id", "feature", bits)
    sets = stored(sets, "sets")
    kinds = stored(overlap.classes(sets), "kinds")
    pairs = overlap.class_pairs(kinds, 4).select(F.lit("pair").alias("part"), "a", "b", F.col("together").alias("shared"))
    has = sets.join(kinds.select("features", "rep"), "features")
    return pairs.union(has.select(F.lit("member"), "item", "rep", overlap.count_of(sets).cast("long")))


def j10_gaps(s, d):
    """The means are taken once for both sides: sums of doubles depend on the order in which blocks arrive, and a city would be above itself."""
    g = cut(listings(s, d).groupBy("state", "city").agg(F.avg("price").alias("avg_price")))
    a, b = g.select("state", F.col("city").alias("a"), F.col("avg_price").alias("pa")), g.select("state", F.col("city").alias("b"), F.col("avg_price").alias("pb"))
    return a.join(b, "state").where("pb > pa").select("state", "a", "b", F.round((F.col("pb") - F.col("pa")) / F.col("pa") * 100, 4).alias("percent"))


def j11_tag_pairs(s, d):
    t = table(s, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")).distinct()
    a, b = t.select(F.col("p_brand").alias("a"), "tag"), t.select(F.col("p_brand").alias("b"), "tag")
    return a.join(b, "tag").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common")).where("common >= 2")


def j12_refs(s, d):
    refs = table(s, d, "labels").withColumn("refs", F.array(F.col("doc_id"), F.col("doc_id") + 1, F.col("doc_id") + 2)).select("doc_id", F.posexplode("refs").alias("pos", "ref"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("ref"), "lang")
    hit = refs.join(docs, "ref").withColumn("confidence", F.when(F.col("pos") == 0, 0.9).otherwise(0.8))
    return hit.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref", "lang"))), lambda x: F.concat_ws(":", x["ref"].cast("string"), x["lang"])), ",").alias("articles"), F.round(F.sum("confidence"), 6).alias("confidence"))


def j13_denormalized(s, d):
    """A document for each listing: its place, the three longest articles on its city, and one text of them all."""
    docs = table(s, d, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 25).cast("int").alias("n_nationkey")).join(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("city")), "n_nationkey")
    best = graph.top_per(docs, "city", [F.desc("n_chars"), F.asc("doc_id")], 3)
    articles = best.groupBy("city").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n_chars"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["n_chars"].alias("chars"))).alias("articles"))
    made = listings(s, d).join(articles, "city", "left").withColumn("ids", F.coalesce(F.transform("articles", lambda x: x["doc_id"].cast("string")), F.array().cast("array<string>")))
    doc = made.select("listing_id", F.concat_ws(" ", "place", "city", "state", "kind", F.array_join("ids", " ")).alias("combined"), F.struct("place", "city").alias("at"), F.array_join("ids", ",").alias("articles"), F.coalesce(F.aggregate("articles", F.lit(0).cast("long"), lambda a, x: a + x["chars"]), F.lit(0)).alias("chars"))
    return doc.select("listing_id", "combined", "at.city", "articles", "chars")


def j14_radius(s, d):
    p = table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"))
    return spatial.near_pairs(p, "s_suppkey", "lat", "lon", 1500.0).select("a", "b", F.round("km", 3).alias("km"))


def j15_bands(s, d):
    return table(s, d, "orders").select("o_orderkey", facets.ladder(F.col("o_totalprice"), CUTS, BANDS).alias("band"))


def j16_below_mean(s, d):
    means = listings(s, d).groupBy("city").agg(F.avg("price").alias("city_avg"))
    return listings(s, d).join(means, "city").where("price < city_avg * 0.05").select("listing_id", F.round("city_avg", 4).alias("city_avg"))


def j17_union_search(s, d):
    a = table(s, d, "documents").select(F.lit("article").alias("entity"), F.col("doc_id").alias("id"), F.length("text").cast("double").alias("score"))
    b = table(s, d, "benchmark").select(F.lit("query").alias("entity"), F.col("item_id").alias("id"), (F.length("text") * 3).cast("double").alias("score"))
    return a.unionByName(b).orderBy(F.desc("score"), "entity", "id").limit(25)


def j19_enriched(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("quality").alias("rated"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))
    return docs.where("rated > 0")


def w1_best(s, d):
    return sinks.latest(table(s, d, "events"), ["user_id", "event_type"], [F.desc_nulls_last("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


def w3_outliers(s, d):
    g = listings(s, d).groupBy("city").agg(F.count("*").alias("n"), F.avg("price").alias("m"), F.stddev_samp("price").alias("sd")).where("n >= 5 AND sd > 0")
    z = listings(s, d).join(g, "city").withColumn("z", (F.col("price") - F.col("m")) / F.col("sd")).where("abs(z) > 1.7")
    return z.select("listing_id", F.round("z", 6).alias("z"), F.when(F.col("z") > 0, "overpriced").otherwise("underpriced").alias("label"))


def w5_top_n(s, d):
    w = Window.partitionBy("city").orderBy(F.desc("price"), "listing_id")
    top = listings(s, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    return top.groupBy("city").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "listing_id"))), lambda x: x["listing_id"].cast("string")), ",").alias("top"))


def w6_links(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("prev"), F.lead("turn").over(w).alias("next"), (F.row_number().over(w) - 1).alias("idx"), F.count("*").over(Window.partitionBy("conv_id")).alias("total"))


def w8_ratio(s, d):
    g = listings(s, d).groupBy("city", "place_id").agg(F.avg("price").alias("p"))
    return facets.with_means(g, "city", {"city_avg": "p"}).withColumn("ratio", F.round(F.col("p") / F.col("city_avg"), 6)).where("ratio < 0.9").select("city", "place_id", "ratio")


def l2_sort(s, d):
    e = table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"), "c_acctbal")
    return e.orderBy(F.asc_nulls_last("seg"), F.desc_nulls_last("c_acctbal"), "c_custkey").limit(30)


def l4_unique(s, d):
    return table(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars")).orderBy(F.desc("n_chars"), "source").limit(10)


def l6_page(s, d):
    return filters.page(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)


def u1_hierarchy(s, d):
    rows = listings(s, d)
    place, city = text.node_id("place", F.col("place")), text.node_id("city", F.col("city"))
    parts = [rows.select(F.concat(F.lit("listing:"), F.col("listing_id").cast("string")).alias("from_id"), place.alias("to_id"), F.lit("LOCATED_IN").alias("kind")), rows.select(place, city, F.lit("IN_CITY")), rows.select(city, text.node_id("state", F.col("state")), F.lit("IN_STATE"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def u4_overlap(s, d):
    docs = table(s, d, "documents")
    a = docs.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id")
    b = docs.where("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(50).select("doc_id")
    return a.intersect(b).withColumn("part", F.lit("both")).union(a.exceptAll(b).withColumn("part", F.lit("only_a"))).union(b.exceptAll(a).withColumn("part", F.lit("only_b")))


def u5_arrays(s, d):
    p = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.lit("red"), F.lit("widget")).alias("b"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("both"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("rest"))


def f_scalars(s, d):
    c = table(s, d, "customer")
    return c.select("c_custkey", F.concat_ws("", F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, F.lit("b")), F.col("c_mktsegment")).alias("joined"), text.slug(F.col("c_name")).alias("slug"), text.node_id("place", F.col("c_name"), F.col("c_mktsegment")).alias("node"),
                    text.postal_status(F.when(F.col("c_custkey") % 5 == 0, "123").when(F.col("c_custkey") % 5 == 1, "90001").when(F.col("c_custkey") % 5 == 2, "94102")).alias("postal"), F.round(F.col("c_acctbal") * 43560, 2).alias("sqft"), F.concat_ws(" > ", F.col("c_mktsegment"), F.col("c_name")).alias("path"))


def f11_json(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


def f12_hashes(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source")).alias("doc_hash"))


def f14_dates(s, d):
    return table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))


def f15_stats(s, d):
    words = F.regexp_count("text", F.lit(r"\S+"))
    return table(s, d, "documents").select("doc_id", F.length("text").alias("chars"), words.alias("words"), F.size(F.split("text", "\n\n")).alias("paragraphs"), F.ceil(words / 200).cast("int").alias("minutes"), F.regexp_count("text", F.lit(r"[.!?]")).alias("sentences"))


GEO = "(SELECT s_suppkey, (s_suppkey % 180 - 90)::DOUBLE AS lat, (s_suppkey * 7 % 360 - 180)::DOUBLE AS lon FROM supplier)"
PAIR = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
SLUG = lambda x: f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
QUERIES = {
    "s3_left_scan": (s3_left_scan, "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)"),
    "s4_pruned_scan": (lambda s, d: table(s, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45"),
    "s6_sample_limit": (lambda s, d: table(s, d, "orders").orderBy("o_orderkey").limit(20).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20"),
    "s7_random_sample": (lambda s, d: filters.reproducible_sample(table(s, d, "documents").select("doc_id"), "doc_id", 20), "SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 20"),
    "s9_documents": (lambda s, d: sinks.documents(table(s, d, "orders"), "o_orderkey", {"price": F.col("o_totalprice"), "status": F.col("o_orderstatus")}).select("_id", "doc.*"), "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice AS price, o_orderstatus AS status FROM orders"),
    "s10_defaults": (s10_defaults, "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name AS name, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'active' END AS segment, coalesce(c_acctbal, 0.0) AS balance FROM customer"),
    "s11_upsert": (s11_upsert, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 10000000, 'N' FROM orders WHERE o_orderkey % 5 = 0"),
    "s12_duplicate_keys": (lambda s, d: sinks.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_partkey"]), "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
    "s14_table_counts": (lambda s, d: sinks.table_counts({t: table(s, d, t) for t in ("orders", "customer", "part", "documents")}), "SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'documents', count(*) FROM documents"),
    "p3_valid": (lambda s, d: table(s, d, "orders").where("o_orderkey IS NOT NULL AND o_totalprice > 1000 AND o_custkey > 0").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey > 0"),
    "p4_search": (p4_search, "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 910 AND 990 AND p_size >= 10 ORDER BY 2, 1 LIMIT 50"),
    "p6_clauses": (p6_clauses, "SELECT c_custkey, c_mktsegment = 'BUILDING' AS by_term, c_mktsegment IN ('BUILDING', 'MACHINERY') AS by_terms, c_acctbal > 0 AND c_acctbal <= 5000 AS by_range, c_name IS NOT NULL AS by_exists, starts_with(c_name, 'Customer#0000') AS by_prefix, c_name LIKE '%1_' AS by_wildcard FROM customer"),
    "p7_bool": (p7_bool, "SELECT doc_id, h1 * 1.0::DOUBLE + h2 * 2.0::DOUBLE + h3 * 1.5::DOUBLE AS score FROM (SELECT doc_id, lang, contains(lower(text), 'the')::INT AS h1, contains(lower(text), 'and')::INT AS h2, contains(lower(text), 'der')::INT AS h3 FROM documents) WHERE lang IS NOT NULL AND lang <> 'fr' AND h1 + h2 + h3 >= 2"),
    "p9_exists": (p9_exists, f"SELECT listing_id FROM {FEATS} WHERE feature IN ('Brand#11', 'Brand#12') GROUP BY 1 HAVING count(*) = 2"),
    "p10_not_exists": (p10_not_exists, f"SELECT o_orderkey AS listing_id FROM orders WHERE o_orderkey NOT IN (SELECT listing_id FROM {FEATS} WHERE feature IN ('Brand#11', 'Brand#12'))"),
    "p11_mix": (p11_mix, f"SELECT listing_id, CASE WHEN bool_or(feature = 'Brand#11') THEN 'first' ELSE 'second' END AS label FROM {FEATS} GROUP BY 1 HAVING bool_or(feature IN ('Brand#11', 'Brand#12')) AND bool_or(feature IN ('Brand#21', 'Brand#22'))"),
    "p13_state_codes": (p13_state_codes, "SELECT n_nationkey, CASE upper(trim(n_name)) WHEN 'GEORGIA' THEN 'GA' ELSE upper(trim(n_name))[1:2] END AS code, 'NY' AS ny FROM nation"),
    "p14_aliases": (p14_aliases, "SELECT n_nationkey, CASE WHEN upper(trim(n_name)) IN ('UNITED STATES', 'USA') THEN 'US' ELSE upper(trim(n_name)) END AS alias, substr(n_name, 1, 5) AS head FROM nation"),
    "p15_intent_filters": (lambda s, d: listings(s, d).where((F.lower("city") == F.lower(F.lit("France"))) | (F.lower("city") == "nation_3")).select("listing_id"), f"SELECT listing_id FROM {LISTED} WHERE lower(city) IN ('france', 'nation_3')"),
    "p16_nulls": (p16_nulls, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name END AS name FROM customer"),
    "p17_point": (p17_point, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7"),
    "p18_arrays": (p18_arrays, f"SELECT doc_id, a AS has_term, b AS has_any, c AS long, a::INT + b::INT + c::INT >= 2 AS two_of_three FROM (SELECT doc_id, list_contains(t, 'the') AS a, list_has_any(t, ['der', 'die']) AS b, len(t) > 100 AS c FROM (SELECT doc_id, list_distinct({TOK}) AS t FROM documents))"),
    "j1_left": (lambda s, d: table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name"), "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey"),
    "j2_composite": (lambda s, d: table(s, d, "lineitem").join(table(s, d, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), ["l_orderkey", "l_suppkey", "l_returnflag"], "left").select("l_orderkey", "l_linenumber", "n"), "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey, l_returnflag) AS n FROM lineitem"),
    "j3_vectors": (lambda s, d: table(s, d, "labels").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dims")), "doc_id", "left").select("doc_id", "dims"), "SELECT doc_id, len(embedding) AS dims FROM labels LEFT JOIN embeddings ON vec_id = doc_id"),
    "j4_pattern": (lambda s, d: listings(s, d).groupBy("state", "city").agg(F.count("*").alias("n")), f"SELECT state, city, count(*) AS n FROM {LISTED} GROUP BY 1, 2"),
    "j5_optional": (j5_optional, "SELECT n_nationkey, count(s_suppkey) AS rich FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1"),
    "j6_semi": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "j7_unprocessed": (j7_unprocessed, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "j8_orphans": (j8_orphans, "SELECT -1::BIGINT AS c_custkey, count(*) AS orphans FROM orders WHERE o_orderkey % 11 = 0"),
    "j9_shared": (j9_shared, f"WITH s AS MATERIALIZED (SELECT listing_id, list_sort(list(feature)) AS l FROM {FEATS} GROUP BY 1), c AS MATERIALIZED (SELECT l, min(listing_id) AS rep FROM s GROUP BY 1), x AS MATERIALIZED (SELECT rep, unnest(l) AS f FROM c) SELECT 'pair' AS part, a.rep AS a, b.rep AS b, count(*) AS shared FROM x a JOIN x b ON a.f = b.f AND a.rep < b.rep GROUP BY ALL HAVING count(*) >= 4 UNION ALL SELECT 'member', listing_id, rep, len(l) FROM s JOIN c USING (l)"),
    "j10_gaps": (j10_gaps, f"WITH g AS (SELECT state, city, avg(price) AS p FROM {LISTED} GROUP BY 1, 2) SELECT a.state, a.city AS a, b.city AS b, round((b.p - a.p) / a.p * 100, 4) AS percent FROM g a JOIN g b ON a.state = b.state AND b.p > a.p"),
    "j11_tag_pairs": (j11_tag_pairs, "WITH t AS (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part) SELECT a.p_brand AS a, b.p_brand AS b, count(*) AS common FROM t a JOIN t b ON a.tag = b.tag AND a.p_brand < b.p_brand GROUP BY 1, 2 HAVING count(*) >= 2"),
    "j12_refs": (j12_refs, "SELECT l.doc_id, string_agg(d.doc_id || ':' || d.lang, ',' ORDER BY pos) AS articles, round(sum(CASE WHEN pos = 0 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END), 6) AS confidence FROM (SELECT doc_id, unnest([0, 1, 2]) AS pos FROM labels) l JOIN documents d ON d.doc_id = l.doc_id + pos GROUP BY 1"),
    "j13_denormalized": (j13_denormalized, f"WITH a AS (SELECT city, string_agg(doc_id, ' ' ORDER BY turn) AS spaced, string_agg(doc_id, ',' ORDER BY turn) AS articles, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT n_name AS city, doc_id, n_chars, row_number() OVER (PARTITION BY n_name ORDER BY n_chars DESC, doc_id) AS turn FROM documents JOIN nation ON doc_id % 25 = n_nationkey) WHERE turn <= 3 GROUP BY 1) SELECT listing_id, concat_ws(' ', place, city, state, kind, coalesce(spaced, '')) AS combined, city, coalesce(articles, '') AS articles, coalesce(chars, 0) AS chars FROM {LISTED} LEFT JOIN a USING (city)"),
    "j14_radius": (j14_radius, f"SELECT a.s_suppkey AS a, b.s_suppkey AS b, round({PAIR}, 3) AS km FROM {GEO} a JOIN {GEO} b ON a.s_suppkey < b.s_suppkey WHERE {PAIR} <= 1500"),
    "j15_bands": (j15_bands, f"SELECT o_orderkey, {BAND_SQL} AS band FROM orders"),
    "j16_below_mean": (j16_below_mean, f"SELECT listing_id, round(m, 4) AS city_avg FROM (SELECT listing_id, price, avg(price) OVER (PARTITION BY city) AS m FROM {LISTED}) WHERE price < m * 0.05"),
    "j17_union_search": (j17_union_search, "SELECT * FROM (SELECT 'article' AS entity, doc_id AS id, length(text)::DOUBLE AS score FROM documents UNION ALL SELECT 'query', item_id, (length(text) * 3)::DOUBLE FROM benchmark) ORDER BY score DESC, entity, id LIMIT 25"),
    "j19_enriched": (j19_enriched, "SELECT lang, count(quality) AS rated, round(avg(n_chars), 4) AS avg_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1 HAVING count(quality) > 0"),
    "w1_best": (w1_best, "SELECT user_id, event_type, first(event_id ORDER BY ts DESC NULLS LAST, event_id) AS event_id FROM events GROUP BY 1, 2"),
    "w3_outliers": (w3_outliers, f"SELECT listing_id, round(z, 6) AS z, CASE WHEN z > 0 THEN 'overpriced' ELSE 'underpriced' END AS label FROM (SELECT listing_id, (price - avg(price) OVER c) / stddev_samp(price) OVER c AS z, count(*) OVER c AS n FROM {LISTED} WINDOW c AS (PARTITION BY city)) WHERE n >= 5 AND abs(z) > 1.7"),
    "w4_upside": (lambda s, d: listings(s, d).withColumn("gap", F.round(F.avg("price").over(Window.partitionBy("place_id")) - F.col("price"), 2)).where("gap > 200000").select("listing_id", "gap"), f"SELECT listing_id, gap FROM (SELECT listing_id, round(avg(price) OVER (PARTITION BY place_id) - price, 2) AS gap FROM {LISTED}) WHERE gap > 200000"),
    "w5_top_n": (w5_top_n, f"SELECT city, string_agg(listing_id, ',' ORDER BY rn) AS top FROM (SELECT city, listing_id, row_number() OVER (PARTITION BY city ORDER BY price DESC, listing_id) AS rn FROM {LISTED}) WHERE rn <= 3 GROUP BY 1"),
    "w6_links": (w6_links, "SELECT conv_id, turn, lag(turn) OVER w AS prev, lead(turn) OVER w AS next, CAST(row_number() OVER w - 1 AS INT) AS idx, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "w7_ranks": (lambda s, d: table(s, d, "part").select("p_partkey", F.rank().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"))).alias("rank")), "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS INT) AS rank FROM part"),
    "w8_ratio": (w8_ratio, f"SELECT city, place_id, ratio FROM (SELECT city, place_id, round(p / avg(p) OVER (PARTITION BY city), 6) AS ratio FROM (SELECT city, place_id, avg(price) AS p FROM {LISTED} GROUP BY 1, 2)) WHERE ratio < 0.9"),
    "l1_top": (lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 10"),
    "l2_sort": (l2_sort, "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg, c_acctbal FROM customer ORDER BY seg NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 30"),
    "l4_unique": (l4_unique, "SELECT source, first(doc_id ORDER BY n_chars DESC, doc_id) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10"),
    "l5_random_one": (lambda s, d: filters.reproducible_sample(table(s, d, "orders").where("o_totalprice > 400000").select("o_orderkey"), "o_orderkey", 1), "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 1"),
    "l6_page": (l6_page, "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 40"),
    "u1_hierarchy": (u1_hierarchy, f"WITH l AS (SELECT *, 'place:' || {SLUG('place')} AS p, 'city:' || {SLUG('city')} AS c, 'state:' || {SLUG('state')} AS s FROM {LISTED}) SELECT 'listing:' || listing_id AS from_id, p AS to_id, 'LOCATED_IN' AS kind FROM l UNION SELECT p, c, 'IN_CITY' FROM l UNION SELECT c, s, 'IN_STATE' FROM l"),
    "u3_distinct": (lambda s, d: listings(s, d).select("city", "state").distinct(), f"SELECT DISTINCT city, state FROM {LISTED}"),
    "u4_overlap": (u4_overlap, "WITH a AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50), b AS (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT doc_id, 'both' AS part FROM (FROM a INTERSECT FROM b) UNION ALL SELECT doc_id, 'only_a' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT doc_id, 'only_b' FROM (FROM b EXCEPT FROM a)"),
    "u5_arrays": (u5_arrays, "SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x IN ('red', 'widget'))), ',') AS both, array_to_string(list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x NOT IN ('red', 'widget'))), ',') AS rest FROM part"),
    "f_scalars": (f_scalars, f"SELECT c_custkey, concat('a', CASE WHEN c_custkey % 2 = 0 THEN 'b' END, c_mktsegment) AS joined, {SLUG('c_name')} AS slug, 'place:' || {SLUG('c_name')} || '_' || {SLUG('c_mktsegment')} AS node, CASE c_custkey % 5 WHEN 0 THEN 'invalid' WHEN 1 THEN 'placeholder' WHEN 2 THEN 'valid' ELSE 'missing' END AS postal, round(c_acctbal * 43560, 2) AS sqft, c_mktsegment || ' > ' || c_name AS path FROM customer"),
    "f11_json": (f11_json, "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events"),
    "f12_hashes": (f12_hashes, "SELECT doc_id, sha256(text) AS text_hash, md5(concat_ws('|', doc_id, lang, source)) AS doc_hash FROM documents"),
    "f14_dates": (f14_dates, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m') AS month FROM orders"),
    "f15_stats": (f15_stats, r"SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(w AS INT) AS words, CAST(len(string_split(text, chr(10) || chr(10))) AS INT) AS paragraphs, CAST(ceil(w / 200) AS INT) AS minutes, CAST(len(regexp_extract_all(text, '[.!?]')) AS INT) AS sentences FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS w FROM documents)"),
}

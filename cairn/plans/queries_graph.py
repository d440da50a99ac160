"""Node and edge tables and the analytics on them, with listings, places and part brands in the roles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions import text
from cairn.operators import chains, facets, graph, overlap, scores, vector
from cairn.plans.binding import PHRASES, described_articles, listing_features, listings, tagged_parts
from cairn.plans.queries_aggregate import BAND_SQL, BANDS, CUTS, LISTED
from cairn.plans.queries_relational import FEATS
from cairn.plans.queries_search import KNN, queries_of
from cairn.sources.tables import table

PB = BAND_SQL.replace("o_totalprice", "price")


def band():
    return facets.ladder(F.col("price"), CUTS, BANDS)


def brand_sets(s, d):
    return overlap.feature_sets(listing_features(s, d), "listing_id", "feature")


def similar(s, d):
    """SIMILAR_TO edges between listings by their vectors: each row of the stated query set and its ten nearest rows, 0.3 at least."""
    e = table(s, d, "embeddings")
    return vector.similar_edges(vector.nearest_join(queries_of(s, d), e, 10, same=True), 0.3)


def g1_nodes(s, d):
    ls = listings(s, d)
    parts = [graph.nodes(ls, "listing", F.col("listing_id")), graph.nodes(ls, "place", F.col("place_id")), graph.nodes(ls, "city", text.slug(F.col("city"))), graph.nodes(ls, "state", text.slug(F.col("state"))), graph.nodes(listing_features(s, d), "feature", text.slug(F.col("feature"))), graph.nodes(ls, "band", band())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("node_label").agg(F.count("*").alias("n"))


def edge_table(s, d):
    ls = listings(s, d)
    parts = [
        graph.edges(ls, "LOCATED_IN", ("listing", F.col("listing_id")), ("place", F.col("place_id"))), graph.edges(ls, "IN_CITY", ("place", F.col("place_id")), ("city", text.slug(F.col("city")))),
        graph.edges(ls, "IN_STATE", ("city", text.slug(F.col("city"))), ("state", text.slug(F.col("state")))), graph.edges(ls, "OF_TYPE", ("listing", F.col("listing_id")), ("type", text.slug(F.col("kind")))),
        graph.edges(ls, "IN_PRICE_RANGE", ("listing", F.col("listing_id")), ("band", band())), graph.edges(listing_features(s, d), "HAS_FEATURE", ("listing", F.col("listing_id")), ("feature", text.slug(F.col("feature")))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def g8_describes(s, d):
    docs = table(s, d, "labels").select("doc_id", F.explode(F.array(F.col("doc_id") % 10, F.col("doc_id") % 7)).alias("place"))
    return graph.edges(docs, "DESCRIBES", ("article", F.col("doc_id")), ("place", F.col("place")))


def g13_near(s, d):
    """NEAR links both ways between all places of a city."""
    return graph.links_within(listings(s, d).select("place_id", "city").distinct(), "place_id", "city")


def g15_dangling(s, d):
    e = graph.edges(table(s, d, "orders"), "LOCATED_IN", ("listing", F.col("o_orderkey")), ("place", F.col("o_custkey")))
    n = graph.nodes(table(s, d, "orders"), "listing", F.col("o_orderkey")).unionByName(graph.nodes(table(s, d, "customer").where("c_custkey % 7 <> 0"), "place", F.col("c_custkey")))
    return graph.dangling(e, n).groupBy("end").agg(F.count("*").alias("n"))


def g20i_profile(s, d):
    ls = listings(s, d).select("listing_id", "price", "city")
    f = listing_features(s, d)
    return ls.join(f, "listing_id", "left").groupBy("listing_id", "city").agg(F.array_join(F.slice(F.array_sort(F.collect_set("feature")), 1, 3), ",").alias("features"), F.countDistinct("feature").alias("n"))


def g21_luxury(s, d):
    return listing_features(s, d).where(F.col("feature").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21")).groupBy("listing_id").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("has")).where(F.contains("has", F.lit(",")))


def g22_pairs(s, d):
    return graph.pair_counts(listing_features(s, d), "listing_id", "feature", 5).orderBy(F.desc("together"), "a", "b").limit(15)


def g23_lift(s, d):
    return graph.lift(listing_features(s, d), "listing_id", "feature").withColumn("lift", F.round("lift", 6)).where("lift > 1.0")


def g23_sets(s, d):
    """Three brands or more that five listings have together, more often than by chance."""
    found = graph.frequent_sets(listing_features(s, d), "listing_id", "feature", 5).withColumn("lift", F.round("lift", 6))
    return found.where("size(features) <= 4 AND lift > 1.05").select(F.array_join("features", ",").alias("features"), "together", "lift")


def g24_premium(s, d):
    facts = listing_features(s, d).join(listings(s, d).select("listing_id", "price"), "listing_id")
    out = graph.premium(facts, "feature", "price", listings(s, d).select("price"))
    return out.withColumns({c: F.round(c, 4) for c in ("with_avg", "without_avg", "percent")})


def g25_rarity(s, d):
    n = listing_features(s, d).groupBy("feature").agg(F.count("*").alias("n"))
    total = listings(s, d).agg(F.count("*").alias("listings"))
    return n.join(F.broadcast(total)).select("feature", "n", facets.ladder(F.col("n"), (3, 10, 25), ("unique", "rare", "uncommon", "common"), closed_right=True).alias("tier"), F.round(F.col("n") / F.col("listings"), 6).alias("share"))  # one row


def g27_tiers(s, d):
    g = listings(s, d).groupBy("place_id").agg(F.avg("price").alias("p"))
    return g.select("place_id", facets.ladder(F.col("p"), (150_000, 250_000, 300_000), ("entry", "middle", "upper", "top")).alias("tier"))


def g28_type_city(s, d):
    """The units of a listing stand for its area."""
    units = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.sum("l_quantity").alias("units"))
    per = F.when(F.col("units") > 0, F.col("price") / F.col("units"))
    return listings(s, d).join(units, "listing_id", "left").groupBy("kind", "city").agg(F.count("*").alias("n"), F.round(F.avg(per), 4).alias("per_unit"))


def g29_undervalued(s, d):
    f = listing_features(s, d).groupBy("listing_id").agg(F.count("*").alias("features"))
    g = listings(s, d).join(f, "listing_id").groupBy("city", "place_id").agg(F.avg("features").alias("f"), F.avg("price").alias("p"))
    r = facets.with_means(g, "city", {"city_f": "f", "city_p": "p"}).withColumns({"feature_ratio": F.round(F.col("f") / F.col("city_f"), 6), "price_ratio": F.round(F.col("p") / F.col("city_p"), 6)})
    return r.where("feature_ratio > 1.1 AND price_ratio < 0.9").select("city", "place_id", "feature_ratio", "price_ratio")


def g30_diversity(s, d):
    j = listings(s, d).join(listing_features(s, d), "listing_id")
    return j.groupBy("place_id").agg((F.countDistinct("kind") * F.countDistinct("feature")).alias("diversity"))


def g31_adoption(s, d):
    p = tagged_parts(s, d).select("brand", "part_id", F.explode("tags").alias("tag")).distinct()
    per = p.groupBy("tag", "brand").agg(F.count("*").alias("n"))
    total = tagged_parts(s, d).groupBy("brand").agg(F.count("*").alias("parts"))
    tags = Window.partitionBy("tag")
    out = per.join(total, "brand").withColumns({"adoption": F.round(F.col("n") / F.col("parts"), 6), "concentration": F.round(F.col("n") / F.sum("n").over(tags), 6)})
    return out.where("adoption > 0.2").select("tag", "brand", "adoption", "concentration")


def g32_competitors(s, d):
    """Listings with at least three others that share five brands, how many, and how many brands they share on average."""
    kinds = overlap.classes(brand_sets(s, d))
    rivals = overlap.overlaps(kinds).where("together >= 5").groupBy("rep").agg(F.sum("items").alias("competitors"), F.round(F.sum(F.col("items") * F.col("together")) / F.sum("items"), 6).alias("shared"))
    return overlap.members(brand_sets(s, d)).join(rivals.where("competitors >= 3"), "rep").select(F.col("item").alias("listing_id"), "competitors", "shared")


def g33_direct(s, d):
    w = Window.partitionBy("place_id", band())
    return listings(s, d).withColumn("rivals", F.count("*").over(w) - 1).where("rivals >= 6").select("listing_id", "rivals")


def g34_gaps(s, d):
    fine = F.floor(F.col("price") / 25_000).cast("int")
    return listings(s, d).groupBy("city", "kind", fine.alias("band")).agg(F.count("*").alias("n")).where("n <= 3")


def g36_distribution(s, d):
    """Quartiles over all pairs of listings with a brand in common, from how many pairs share each number of brands."""
    kinds = overlap.classes(brand_sets(s, d))
    by = overlap.overlaps(kinds).join(kinds.select("rep", "n"), "rep").groupBy("together").agg((F.sum(F.col("items") * F.col("n")) / 2).cast("long").alias("pairs"))
    q = [F.round(F.percentile("together", p, F.col("pairs")), 4).alias(name) for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return by.agg(*q, F.round(F.sum(F.col("together") * F.col("pairs")) / F.sum("pairs"), 6).alias("mean"), F.max("together").cast("long").alias("most"), F.sum("pairs").alias("pairs"))


def linked(s, d):
    """``listing_id, links, score``: SIMILAR_TO links of each listing, and their mean score."""
    both = similar(s, d).select(F.explode(F.array("a", "b")).alias("listing_id"), "score")
    return both.groupBy("listing_id").agg(F.count("*").alias("links"), F.round(F.avg("score"), 5).alias("score"))


def g37_hubs(s, d):
    """Listings with three SIMILAR_TO links at least, with place and price."""
    return linked(s, d).where("links >= 3").join(listings(s, d).select("listing_id", "place", "city", "price"), "listing_id")


def g37_underpriced(s, d):
    """Of these, listings below 0.85 of their city's mean, the gap to it, and up to five of their brands."""
    ls = facets.with_means(listings(s, d).select("listing_id", "city", "price"), "city", {"mean": "price"})
    low = ls.where(F.col("price") < F.col("mean") * 0.85).join(linked(s, d).where("links >= 3"), "listing_id")
    named = low.join(brand_sets(s, d).withColumnRenamed("item", "listing_id"), "listing_id")
    return named.select("listing_id", "city", F.round(F.col("mean") - F.col("price"), 2).alias("upside"), "links", F.array_join(F.slice("features", 1, 5), ",").alias("key_features"))


def g38_influence(s, d):
    f = listing_features(s, d)
    lux = f.where("feature = 'Brand#11'").select("listing_id")
    ls = listings(s, d).select("listing_id", "place_id")
    places = ls.join(lux, "listing_id", "left_semi").select("place_id").distinct()
    return ls.join(places, "place_id", "left_semi").join(lux, "listing_id", "left_anti").groupBy("place_id").agg(F.count("*").alias("lacking"))


def g39_weighted(s, d):
    f = listing_features(s, d)
    score = F.sum(F.when(F.col("feature").isin("Brand#11", "Brand#21"), 10).when(F.col("feature").isin("Brand#12", "Brand#22", "Brand#32"), 3).otherwise(0))
    return f.groupBy("listing_id").agg(score.alias("score")).where("score >= 13")


def g40_upgrades(s, d):
    """From each listing over a shared brand to the next one 1.2 to 2 times as dear, from there over a new brand to the next again."""
    priced, facts = listings(s, d).select(F.col("listing_id").alias("id"), "price"), listing_features(s, d).withColumnRenamed("listing_id", "id")
    out = chains.upgrades(priced, facts)
    for name in ("start", "mid", "end"):
        out = out.join(brand_sets(s, d).select(F.col("item").alias(name), F.col("features").alias(f"f_{name}")), name)
    news = chains.first_shared(F.col("f_mid"), F.col("f_end"), F.col("f_start"))
    return out.select("start", "mid", "end", F.array_join(chains.first_shared(F.col("f_start"), F.col("f_mid")), ",").alias("shared"), F.array_join(news, ",").alias("new"))


def path_column():
    return F.array_join("path", ",").alias("path")


def g42_paths(s, d):
    """One shortest path of at most five SIMILAR_TO links from the dearest linked listing to each that it reaches."""
    edges = similar(s, d)
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    start = listings(s, d).join(ends, F.col("listing_id") == F.col("node")).orderBy(F.desc("price"), "node").limit(1).select("node")
    return chains.shortest_lists(edges, start, 5).select("node", "hops", path_column())


def g42_feature_paths(s, d):
    """One shortest path of at most six steps between listings and brands in turn, from the dearest listing to every node."""
    facts = listing_features(s, d)
    edges = facts.select(F.concat(F.lit("l"), F.lpad(F.col("listing_id").cast("string"), 9, "0")).alias("a"), F.col("feature").alias("b"))
    top = listings(s, d).join(facts, "listing_id", "left_semi").orderBy(F.desc("price"), "listing_id").limit(1)
    start = top.select(F.concat(F.lit("l"), F.lpad(F.col("listing_id").cast("string"), 9, "0")).alias("node"))
    return chains.shortest_lists(edges, start, 6).select("node", "hops", path_column())


def g44_components(s, d):
    """Communities of listings that links of four shared brands connect, by their least listing."""
    return overlap.linked_components(brand_sets(s, d), 4).withColumnRenamed("item", "node")


def g44_hubs(s, d):
    """Listings with three links of four shared brands at least: how many, the mean overlap, and the first three linked listings."""
    sets = brand_sets(s, d)
    strong = overlap.overlaps(overlap.classes(sets)).where("together >= 4").groupBy("rep").agg(F.sum("items").alias("links"), F.round(F.sum(F.col("items") * F.col("together")) / F.sum("items"), 6).alias("shared"))
    named = overlap.members(sets).join(strong.where("links >= 3"), "rep").join(overlap.nearest_ids(sets, 4, 3), "item")
    return named.select(F.col("item").alias("listing_id"), "links", "shared", F.array_join("others", ",").alias("connected_to"))


def g44_feature_communities(s, d):
    """Brands that five listings share, with their mean price and the first five listings."""
    facts = listing_features(s, d).join(listings(s, d).select("listing_id", "price"), "listing_id")
    first = graph.top_per(facts, "feature", [F.asc("listing_id")], 5).groupBy("feature").agg(F.array_join(F.array_sort(F.collect_list("listing_id")), ",").alias("first"))
    return facts.groupBy("feature").agg(F.count("*").alias("listings"), F.round(F.avg("price"), 3).alias("mean")).where("listings >= 5").join(first, "feature")


def g45_coverage(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return docs.groupBy("source").agg(F.count("*").alias("articles"), F.sum("n_chars").alias("chars"), F.round(F.avg("quality"), 6).alias("quality"))


def g46_context(s, d):
    """Kinds of areas by the summaries of their articles, with the prices of the cities that the articles are on."""
    prices = listings(s, d).groupBy("city").agg(F.count("*").alias("listings"), F.sum("price").alias("total"))
    places = table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("city")).join(prices, "city")
    kinds = described_articles(s, d).select((F.col("doc_id") % 25).cast("int").alias("n_nationkey"), scores.context(F.col("summary")).alias("context"))
    return kinds.join(places, "n_nationkey").groupBy("context").agg(F.count("*").alias("articles"), F.sum("listings").alias("listings"), F.round(F.sum("total") / F.sum("listings"), 3).alias("mean"))


def g47_correlation(s, d):
    return tagged_parts(s, d).select(F.explode("tags").alias("tag"), "brand").groupBy("tag", "brand").agg(F.count("*").alias("n")).where("n >= 5")


PAIRS = f"(SELECT a.listing_id AS a, b.listing_id AS b, count(*) AS together FROM {FEATS} a JOIN {FEATS} b ON a.feature = b.feature AND a.listing_id < b.listing_id GROUP BY 1, 2)"
BOTH = "(SELECT a AS u, b AS v, together FROM p UNION ALL SELECT b, a, together FROM p)"
SIMILAR = f"(SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, max(score) AS score FROM ({KNN}) WHERE rank <= 10 AND score >= 0.3 GROUP BY 1, 2)"
LINKED = f"SELECT listing_id, count(*) AS links, round(avg(score), 5) AS score FROM (SELECT unnest([a, b]) AS listing_id, score FROM {SIMILAR}) GROUP BY 1 HAVING count(*) >= 3"
KEY = "'l' || lpad(CAST(listing_id AS VARCHAR), 9, '0')"


def path_sql(edges: str, start: str, hops: int, kind: str) -> str:
    """Level by level: the least of the lists that reach a node that no earlier level has."""
    out = [f"e AS MATERIALIZED ({edges})", f"l0 AS MATERIALIZED (SELECT node, 0 AS hops, [node]::{kind}[] AS path FROM ({start}))"]
    for k in range(1, hops + 1):
        earlier = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(k))
        out.append(f"l{k} AS MATERIALIZED (SELECT v AS node, {k} AS hops, min(list_append(path, v)) AS path FROM l{k - 1} JOIN e ON u = node WHERE v NOT IN ({earlier}) GROUP BY 1)")
    return f"WITH {', '.join(out)} SELECT node, hops, array_to_string(path, ',') AS path FROM ({' UNION ALL '.join(f'FROM l{k}' for k in range(hops + 1))})"


_PHRASE = lambda at: f"(CASE {at} " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PHRASES)) + " END)"
PHRASED = f"{_PHRASE('doc_id % 8')} || '. ' || {_PHRASE('(doc_id // 8) % 8')}"
SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
QUERIES = {
    "g1_nodes": (g1_nodes, f"SELECT 'listing' AS node_label, count(DISTINCT listing_id) AS n FROM {LISTED} UNION ALL SELECT 'place', count(DISTINCT place_id) FROM {LISTED} UNION ALL SELECT 'city', count(DISTINCT city) FROM {LISTED} UNION ALL SELECT 'state', count(DISTINCT state) FROM {LISTED} UNION ALL SELECT 'feature', count(DISTINCT feature) FROM {FEATS} UNION ALL SELECT 'band', count(DISTINCT {PB}) FROM {LISTED}"),
    "g5_edges": (edge_table, f"WITH l AS (SELECT *, {SLUG.format('city')} AS c, {SLUG.format('state')} AS st FROM {LISTED}) SELECT DISTINCT *, 1.0::DOUBLE AS weight FROM (SELECT 'listing:' || listing_id AS from_id, 'place:' || place_id AS to_id, 'LOCATED_IN' AS relationship_type FROM l UNION ALL SELECT 'place:' || place_id, 'city:' || c, 'IN_CITY' FROM l UNION ALL SELECT 'city:' || c, 'state:' || st, 'IN_STATE' FROM l UNION ALL SELECT 'listing:' || listing_id, 'type:' || {SLUG.format('kind')}, 'OF_TYPE' FROM l UNION ALL SELECT 'listing:' || listing_id, 'band:' || {PB}, 'IN_PRICE_RANGE' FROM l UNION ALL SELECT 'listing:' || listing_id, 'feature:' || {SLUG.format('feature')}, 'HAS_FEATURE' FROM {FEATS})"),
    "g8_describes": (g8_describes, "SELECT DISTINCT 'article:' || doc_id AS from_id, 'place:' || unnest([doc_id % 10, doc_id % 7]) AS to_id, 'DESCRIBES' AS relationship_type, 1.0::DOUBLE AS weight FROM labels"),
    "g13_near": (g13_near, f"WITH p AS (SELECT DISTINCT place_id, city FROM {LISTED}) SELECT a.place_id AS a, b.place_id AS b FROM p a JOIN p b USING (city) WHERE a.place_id <> b.place_id"),
    "g15_dangling": (g15_dangling, "SELECT 'to' AS \"end\", count(*) AS n FROM orders WHERE o_custkey % 7 = 0"),
    "g20i_profile": (g20i_profile, f"SELECT listing_id, city, coalesce(array_to_string(list_slice(list_sort(list(DISTINCT feature) FILTER (feature IS NOT NULL)), 1, 3), ','), '') AS features, count(DISTINCT feature) AS n FROM {LISTED} LEFT JOIN {FEATS} USING (listing_id) GROUP BY 1, 2"),
    "g21_luxury": (g21_luxury, f"SELECT listing_id, string_agg(feature, ',' ORDER BY feature) AS has FROM {FEATS} WHERE feature IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') GROUP BY 1 HAVING count(*) > 1"),
    "g22_pairs": (g22_pairs, f"SELECT a.feature AS a, b.feature AS b, count(*) AS together FROM {FEATS} a JOIN {FEATS} b ON a.listing_id = b.listing_id AND a.feature < b.feature GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY 3 DESC, 1, 2 LIMIT 15"),
    "g23_lift": (g23_lift, f"WITH f AS (SELECT * FROM {FEATS}), n AS (SELECT feature, count(*) AS n FROM f GROUP BY 1), t AS (SELECT count(DISTINCT listing_id) AS items FROM f) SELECT * FROM (SELECT p.a, p.b, together, round(together * items / (x.n * y.n), 6) AS lift FROM (SELECT a.feature AS a, b.feature AS b, count(*) AS together FROM f a JOIN f b ON a.listing_id = b.listing_id AND a.feature < b.feature GROUP BY 1, 2 HAVING count(*) >= 5) p JOIN n x ON x.feature = p.a JOIN n y ON y.feature = p.b, t) WHERE lift > 1.0"),
    "g23_sets": (g23_sets, f"WITH f AS MATERIALIZED (SELECT * FROM {FEATS}), n AS (SELECT feature, count(*) AS n FROM f GROUP BY 1), t AS (SELECT count(DISTINCT listing_id)::DOUBLE AS t FROM f), p3 AS MATERIALIZED (SELECT a.listing_id, a.feature AS a, b.feature AS b, c.feature AS c FROM f a JOIN f b ON a.listing_id = b.listing_id AND a.feature < b.feature JOIN f c ON a.listing_id = c.listing_id AND b.feature < c.feature), s AS (SELECT [a, b, c] AS l, count(*) AS together FROM p3 GROUP BY 1 UNION ALL SELECT [a, b, c, feature], count(*) FROM p3 JOIN f USING (listing_id) WHERE feature > c GROUP BY 1) SELECT array_to_string(l, ',') AS features, together, lift FROM (SELECT l, together, round(together / t / product(n / t), 6) AS lift FROM (SELECT l, together, unnest(l) AS feature FROM s WHERE together >= 5) JOIN n USING (feature), t GROUP BY l, together, t) WHERE lift > 1.05"),
    "g24_premium": (g24_premium, f"WITH x AS (SELECT feature, count(*) AS n, sum(price) AS s FROM {FEATS} JOIN {LISTED} USING (listing_id) GROUP BY 1), t AS (SELECT count(*) AS an, sum(price) AS asum FROM {LISTED}) SELECT feature, n, round(s / n, 4) AS with_avg, round((asum - s) / (an - n), 4) AS without_avg, round((s / n - (asum - s) / (an - n)) / ((asum - s) / (an - n)) * 100, 4) AS percent FROM x, t WHERE an - n >= 10"),
    "g25_rarity": (g25_rarity, f"SELECT feature, count(*) AS n, CASE WHEN count(*) <= 3 THEN 'unique' WHEN count(*) <= 10 THEN 'rare' WHEN count(*) <= 25 THEN 'uncommon' ELSE 'common' END AS tier, round(count(*) / (SELECT count(*) FROM {LISTED}), 6) AS share FROM {FEATS} GROUP BY 1"),
    "g27_tiers": (g27_tiers, f"SELECT place_id, CASE WHEN avg(price) < 150000 THEN 'entry' WHEN avg(price) < 250000 THEN 'middle' WHEN avg(price) < 300000 THEN 'upper' ELSE 'top' END AS tier FROM {LISTED} GROUP BY 1"),
    "g28_type_city": (g28_type_city, f"SELECT kind, city, count(*) AS n, round(avg(CASE WHEN n > 0 THEN price / n END), 4) AS per_unit FROM {LISTED} LEFT JOIN (SELECT l_orderkey AS listing_id, sum(l_quantity) AS n FROM lineitem GROUP BY 1) USING (listing_id) GROUP BY 1, 2"),
    "g29_undervalued": (g29_undervalued, f"WITH g AS (SELECT city, place_id, avg(features) AS f, avg(price) AS p FROM {LISTED} JOIN (SELECT listing_id, count(*) AS features FROM {FEATS} GROUP BY 1) USING (listing_id) GROUP BY 1, 2) SELECT * FROM (SELECT city, place_id, round(f / avg(f) OVER w, 6) AS feature_ratio, round(p / avg(p) OVER w, 6) AS price_ratio FROM g WINDOW w AS (PARTITION BY city)) WHERE feature_ratio > 1.1 AND price_ratio < 0.9"),
    "g30_diversity": (g30_diversity, f"SELECT place_id, count(DISTINCT kind) * count(DISTINCT feature) AS diversity FROM {LISTED} JOIN {FEATS} USING (listing_id) GROUP BY 1"),
    "g31_adoption": (g31_adoption, "WITH p AS (SELECT DISTINCT p_brand AS brand, p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part), n AS (SELECT tag, brand, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT p_brand AS brand, count(*) AS parts FROM part GROUP BY 1) SELECT * FROM (SELECT tag, brand, round(n / parts, 6) AS adoption, round(n / sum(n) OVER (PARTITION BY tag), 6) AS concentration FROM n JOIN t USING (brand)) WHERE adoption > 0.2"),
    "g32_competitors": (g32_competitors, f"WITH p AS MATERIALIZED (FROM {PAIRS} WHERE together >= 5) SELECT u AS listing_id, count(*) AS competitors, round(avg(together), 6) AS shared FROM {BOTH} GROUP BY 1 HAVING count(*) >= 3"),
    "g33_direct": (g33_direct, f"SELECT listing_id, rivals FROM (SELECT listing_id, count(*) OVER (PARTITION BY place_id, {PB}) - 1 AS rivals FROM {LISTED}) WHERE rivals >= 6"),
    "g34_gaps": (g34_gaps, f"SELECT city, kind, CAST(floor(price / 25000) AS INT) AS band, count(*) AS n FROM {LISTED} GROUP BY ALL HAVING count(*) <= 3"),
    "g35_bridges": (lambda s, d: listing_features(s, d).groupBy("listing_id").agg(F.count("*").alias("categories")).where("categories >= 5"), f"SELECT listing_id, count(*) AS categories FROM {FEATS} GROUP BY 1 HAVING count(*) >= 5"),
    "g36_distribution": (g36_distribution, f"SELECT round(quantile_cont(together, 0.25), 4) AS q1, round(quantile_cont(together, 0.5), 4) AS median, round(quantile_cont(together, 0.75), 4) AS q3, round(avg(together), 6) AS mean, max(together) AS most, count(*) AS pairs FROM {PAIRS}"),
    "g37_hubs": (g37_hubs, f"SELECT listing_id, links, score, place, city, price FROM ({LINKED}) JOIN {LISTED} USING (listing_id)"),
    "g37_underpriced": (g37_underpriced, f"SELECT listing_id, city, round(mean - price, 2) AS upside, links, key_features FROM (SELECT listing_id, city, price, avg(price) OVER (PARTITION BY city) AS mean FROM {LISTED}) JOIN ({LINKED}) USING (listing_id) JOIN (SELECT listing_id, array_to_string(list_sort(list(feature))[1:5], ',') AS key_features FROM {FEATS} GROUP BY 1) USING (listing_id) WHERE price < mean * 0.85"),
    "g38_influence": (g38_influence, f"WITH lux AS (SELECT listing_id FROM {FEATS} WHERE feature = 'Brand#11') SELECT place_id, count(*) AS lacking FROM {LISTED} WHERE place_id IN (SELECT place_id FROM {LISTED} WHERE listing_id IN (FROM lux)) AND listing_id NOT IN (FROM lux) GROUP BY 1"),
    "g39_weighted": (g39_weighted, f"SELECT * FROM (SELECT listing_id, CAST(sum(CASE WHEN feature IN ('Brand#11', 'Brand#21') THEN 10 WHEN feature IN ('Brand#12', 'Brand#22', 'Brand#32') THEN 3 ELSE 0 END) AS BIGINT) AS score FROM {FEATS} GROUP BY 1) WHERE score >= 13"),
    "g40_upgrades": (g40_upgrades, f"WITH f AS MATERIALIZED (SELECT listing_id AS id, feature, price FROM {FEATS} JOIN {LISTED} USING (listing_id)), h1 AS MATERIALIZED (SELECT a.id AS start, min((b.price, b.id)) AS t FROM f a JOIN f b ON a.feature = b.feature AND b.price > a.price * 1.2 AND b.price < a.price * 2 GROUP BY 1), m AS (SELECT start, t[2] AS mid, t[1] AS price FROM h1), n AS (SELECT start, feature, m.price FROM m JOIN f ON f.id = mid WHERE NOT EXISTS (SELECT 1 FROM f s WHERE s.id = start AND s.feature = f.feature)), h2 AS (SELECT start, min((b.price, b.id)) AS t FROM n JOIN f b ON n.feature = b.feature AND b.price > n.price * 1.2 AND b.price < n.price * 2 GROUP BY 1), l AS (SELECT id, list_sort(list(feature)) AS l FROM f GROUP BY 1) SELECT m.start, mid, h2.t[2] AS \"end\", array_to_string(list_sort(list_intersect(a.l, b.l))[1:2], ',') AS shared, array_to_string(list_sort(list_filter(list_intersect(b.l, c.l), lambda x: NOT list_contains(a.l, x)))[1:2], ',') AS \"new\" FROM m JOIN h2 USING (start) JOIN l a ON a.id = m.start JOIN l b ON b.id = mid JOIN l c ON c.id = h2.t[2]"),
    "g42_paths": (g42_paths, path_sql(f"SELECT a AS u, b AS v FROM {SIMILAR} UNION SELECT b, a FROM {SIMILAR}", f"SELECT listing_id AS node FROM {LISTED} WHERE listing_id IN (SELECT unnest([a, b]) FROM {SIMILAR}) ORDER BY price DESC, 1 LIMIT 1", 5, "BIGINT")),
    "g42_feature_paths": (g42_feature_paths, path_sql(f"SELECT {KEY} AS u, feature AS v FROM {FEATS} UNION SELECT feature, {KEY} FROM {FEATS}", f"SELECT {KEY} AS node FROM {LISTED} WHERE listing_id IN (SELECT listing_id FROM {FEATS}) ORDER BY price DESC, 1 LIMIT 1", 6, "VARCHAR")),
    "g44_components": (g44_components, f"WITH RECURSIVE p AS MATERIALIZED (FROM {PAIRS} WHERE together >= 4), e AS MATERIALIZED (SELECT u, v FROM {BOTH} UNION ALL SELECT DISTINCT listing_id, listing_id FROM {FEATS}), r AS (SELECT DISTINCT listing_id AS node, listing_id AS label, 0 AS turn FROM {FEATS} UNION ALL SELECT u, min(label), max(turn) + 1 FROM r JOIN e ON v = node WHERE turn < 25 GROUP BY 1) SELECT node, label FROM r WHERE turn = 25"),
    "g44_hubs": (g44_hubs, f"WITH p AS MATERIALIZED (FROM {PAIRS} WHERE together >= 4) SELECT u AS listing_id, count(*) AS links, round(avg(together), 6) AS shared, array_to_string(list_sort(list(v))[1:3], ',') AS connected_to FROM {BOTH} GROUP BY 1 HAVING count(*) >= 3"),
    "g44_feature_communities": (g44_feature_communities, f"SELECT feature, count(*) AS listings, round(avg(price), 3) AS mean, array_to_string(list_sort(list(listing_id))[1:5], ',') AS first FROM {FEATS} JOIN {LISTED} USING (listing_id) GROUP BY 1 HAVING count(*) >= 5"),
    "g45_coverage": (g45_coverage, "SELECT source, count(*) AS articles, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    "g46_context": (g46_context, f"WITH p AS (SELECT city, count(*) AS n, sum(price) AS t FROM {LISTED} GROUP BY 1), a AS (SELECT doc_id % 25 AS k, {PHRASED} AS summary FROM documents) SELECT CASE WHEN contains(summary, 'historic') THEN 'Historic' WHEN contains(summary, 'residential') THEN 'Residential' WHEN contains(summary, 'commercial') THEN 'Mixed-Use' ELSE 'Standard' END AS context, count(*) AS articles, CAST(sum(n) AS BIGINT) AS listings, round(sum(t) / sum(n), 3) AS mean FROM a JOIN nation ON n_nationkey = k JOIN p ON city = n_name GROUP BY 1"),
    "g47_correlation": (g47_correlation, "SELECT tag, p_brand AS brand, count(*) AS n FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1, 2 HAVING count(*) >= 5"),
}

"""Named graph reports, single column functions, struct packing, size caps, appended files and the remaining checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import filters, graph, scores, spatial, vector
from cairn.plans.binding import listing_features, listings, tagged_parts
from cairn.plans.queries_aggregate import LISTED
from cairn.plans.queries_relational import FEATS, GEO, PAIR, SLUG
from cairn.plans.queries_search import KNN, queries_of
from cairn.sources import sinks
from cairn.sources.shared import new_path
from cairn.sources.tables import table


def g20a_counts(s, d):
    """Listings by city and by type, and how many nodes each label has."""
    ls = listings(s, d)
    by = lambda what, c: ls.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(what).alias("report"), "name", "n")
    totals = sinks.table_counts({"listing": table(s, d, "orders"), "place": table(s, d, "customer"), "article": table(s, d, "documents")}).select(F.lit("label").alias("report"), F.col("label").alias("name"), "n")
    return by("city", "city").unionByName(by("type", "kind")).unionByName(totals)


def g20b_distribution(s, d):
    """How many listings have each number of features, those without any included."""
    n = listing_features(s, d).groupBy("listing_id").agg(F.count("*").alias("features"))
    return listings(s, d).select("listing_id").join(n, "listing_id", "left").na.fill(0, ["features"]).groupBy("features").agg(F.count("*").alias("listings"))


def g20b_overview(s, d):
    """Listings with features, their mean number and price."""
    f = listing_features(s, d).groupBy("listing_id").agg(F.collect_set("feature").alias("names"))
    j = listings(s, d).join(f, "listing_id")
    return j.agg(F.count("*").alias("listings"), F.round(F.avg(F.size("names")), 6).alias("features"), F.round(F.avg("price"), 4).alias("price"))


def g20b_hierarchy(s, d):
    """Two hops up from the places: cities, places and listings under each state."""
    places = listings(s, d).groupBy("state", "city", "place_id").agg(F.count("*").alias("n"))
    return places.groupBy("state").agg(F.countDistinct("city").alias("cities"), F.count("*").alias("places"), F.sum("n").alias("listings"))


def g20c_places(s, d):
    """Prices of the places with two listings or more."""
    g = listings(s, d).groupBy("place_id").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"), F.min("price").alias("least"), F.max("price").alias("most"))
    return g.where("n >= 2")


def g20e_popular(s, d):
    j = listing_features(s, d).join(listings(s, d).select("listing_id", "kind", "price"), "listing_id")
    return j.groupBy("feature").agg(F.count("*").alias("listings"), F.countDistinct("kind").alias("kinds"), F.round(F.avg("price"), 4).alias("mean"))


def g20e_categories(s, d):
    return table(s, d, "part").groupBy(F.split("p_type", " ")[0].alias("category")).agg(F.countDistinct("p_brand").alias("features"), F.count("*").alias("parts"))


def priced_units(s, d):
    """Listings with the units that stand for their area and the price of one."""
    units = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("listing_id")).agg(F.sum("l_quantity").alias("units"))
    return listings(s, d).join(units, "listing_id").where("units > 0").withColumn("per_unit", F.col("price") / F.col("units"))


def g20f_unit_prices(s, d):
    cells = {"mean": F.avg("per_unit"), "least": F.min("per_unit"), "most": F.max("per_unit")}
    return priced_units(s, d).groupBy("city").agg(F.count("*").alias("n"), *[F.round(c, 4).alias(n) for n, c in cells.items()])


def g20f_best_value(s, d):
    """The ten listings of at least 20 units whose unit costs least."""
    best = priced_units(s, d).where("units >= 20").orderBy("per_unit", "listing_id").limit(10)
    return best.select("listing_id", "city", "units", F.round("per_unit", 4).alias("per_unit"))


def g20g_embedded(s, d):
    """How many documents have a vector, by language."""
    j = table(s, d, "documents").join(table(s, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    return j.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("embedding").isNotNull()).alias("embedded"))


def g20g_random_start(s, d):
    """One document with a vector, the same on every run, to start a similarity search from."""
    have = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "embeddings").where("embedding IS NOT NULL"), F.col("doc_id") == F.col("vec_id"), "left_semi")
    return filters.reproducible_sample(have, "doc_id", 1)


def g20h_lifestyle(s, d):
    """Listings and their mean price by the tags of their parts, of tags with at least ten listings."""
    tags = tagged_parts(s, d).select("part_id", F.explode(F.array_distinct("tags")).alias("tag"))
    met = table(s, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_partkey").alias("part_id")).distinct().join(tags, "part_id").select("listing_id", "tag").distinct()
    g = met.join(listings(s, d).select("listing_id", "price"), "listing_id").groupBy("tag").agg(F.count("*").alias("listings"), F.round(F.avg("price"), 4).alias("mean"))
    return g.where("listings >= 10")


def g14_near_by(s, d):
    """NEAR_BY edges both ways between suppliers within 1,500 km, heavier when nearer."""
    p = table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"))
    pairs = spatial.near_pairs(p, "s_suppkey", "lat", "lon", 1500.0)
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = pairs.select("km", F.inline(ends))
    return graph.edges(both, "NEAR_BY", ("place", F.col("u")), ("place", F.col("v")), F.round(1 - F.col("km") / 1500.0, 4))


def p2_structs(s, d):
    """Columns packed as one struct under new names, and that struct as JSON text."""
    j = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    packed = j.select("n_nationkey", F.struct(F.lower("n_name").alias("city"), F.col("r_name").alias("state"), F.col("n_regionkey").alias("key")).alias("location"))
    return packed.select("n_nationkey", "location.city", "location.state", F.to_json("location").alias("location_json"))


def f1_concat(s, d):
    c = table(s, d, "customer")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.select("c_custkey", F.concat("c_name", F.lit("-"), segment).alias("strict"), F.concat_ws(", ", "c_name", segment, F.col("c_nationkey").cast("string")).alias("listed"), F.coalesce(segment, F.lit("none")).alias("segment"))


def f2_strings(s, d):
    p = F.col("p_type")
    return table(s, d, "part").select("p_partkey", F.trim(F.concat(F.lit("  "), p, F.lit(" "))).alias("trimmed"), F.lower(p).alias("low"), F.upper("p_name").alias("up"), F.left(p, F.lit(4)).alias("head"), F.substring(p, 3, 5).alias("middle"), F.length("p_name").alias("size"), F.replace(p, F.lit(" "), F.lit("_")).alias("joined"))


def f3_regex(s, d):
    return table(s, d, "part").select("p_partkey", F.regexp_replace("p_name", "(?i)[AEIOU]+", "*").alias("masked"), F.regexp_replace("p_type", r"\s+\S+$", "").alias("short"), F.col("p_type").rlike("(?i)^(promo|small).*(steel|brass)$").alias("fits"))


def f4_slugs(s, d):
    return table(s, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.node_id("part", F.col("p_brand"), F.col("p_type")).alias("node"))


def f6_paths(s, d):
    """Path, type and parent of each level: states, then their cities."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    state = text.node_id("state", F.col("r_name"))
    states = r.select(state.alias("id"), F.concat_ws(" > ", "r_name").alias("path"), F.lit("state").alias("level"), F.lit(None).cast("string").alias("parent"))
    cities = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(text.node_id("city", F.col("n_name")).alias("id"), F.concat_ws(" > ", "r_name", "n_name").alias("path"), F.lit("city").alias("level"), state.alias("parent"))
    return states.unionByName(cities)


def f8_numbers(s, d):
    b = F.col("c_acctbal")
    return table(s, d, "customer").select("c_custkey", F.round(b / 3, 4).alias("third"), F.least(b, F.lit(1000.0)).alias("capped"), F.abs(b).alias("size"), F.floor(b).cast("long").alias("whole"), (F.col("c_nationkey") * 43560).cast("long").alias("sqft"))


def f9_arrays(s, d):
    t = F.split("p_name", " ")
    return table(s, d, "part").select("p_partkey", F.size(t).alias("n"), t[0].alias("first"), F.element_at(t, -1).alias("last"), F.array_join(F.filter(t, lambda x: F.length(x) > 4), ",").alias("long"), F.size(F.array("p_brand", "p_type")).alias("listed"))


def w2_dedup(s, d):
    """The first event of each user and kind; rows have no order of their own, so it is given."""
    return sinks.latest(table(s, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


def j18_merged(s, d):
    """Nations beside a summary of their suppliers, nations without any included."""
    by = table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.round(F.avg("s_acctbal"), 4).alias("balance"))
    return table(s, d, "nation").join(by, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "balance")


def l3_caps(s, d):
    """A search for 25 looks at the nearest 100 and keeps 25."""
    size, k, _ = filters.search_sizes(25)
    near = vector.nearest_join(queries_of(s, d), table(s, d, "embeddings"), k, same=True)
    return near.groupBy("query_id").agg(F.count("*").alias("looked_at"), F.count_if(F.col("rank") <= size).alias("kept"), F.round(F.min(F.when(F.col("rank") <= size, F.col("score"))), 5).alias("least"))


def u2_appended(s, d):
    """Orders written to three folders and read as one table from the list of paths."""
    paths = []
    for i in range(3):
        paths.append(new_path(s, "part"))
        table(s, d, "orders").where(F.col("o_orderkey") % 3 == i).write.parquet(paths[-1])
    return s.read.parquet(*paths).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"))


REQUIRED = {"documents": ("doc_id", "text", "lang"), "part": ("p_partkey", "p_brand", "p_color"), "labels": ("doc_id", "quality")}


def q1_columns(s, d):
    """Whether each required column is there, and how many rows have a value in it."""
    out = None
    for name, columns in REQUIRED.items():
        df = table(s, d, name)
        cells = [F.struct(F.lit(name).alias("checked"), F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"), (F.count(c) if c in df.columns else F.lit(0).cast("long")).alias("filled")) for c in columns]
        one = df.agg(F.count("*").alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(cells)]).select(F.inline(F.array(*[f"c{i}" for i in range(len(cells))])))
        out = one if out is None else out.unionByName(one)
    return out


def q5_short(s, d):
    """The shortest value of each text field, how many are under its limit, and whether that warrants a warning."""
    limits = {"text": 100, "lang": 2, "source": 5}
    cells = [F.struct(F.lit(c).alias("field"), F.min(F.length(c)).alias("least"), F.count_if(F.length(c) < n).alias("under"), (F.count_if(F.length(c) < n) > 0).alias("warn")) for c, n in limits.items()]
    return table(s, d, "documents").agg(*[c.alias(n) for c, n in zip(cells, limits, strict=True)]).select(F.inline(F.array(*limits)))


def e4_lifestyle(s, d):
    """Listings of a place stand for how walkable it is, its mean price for its schools."""
    g = listings(s, d).groupBy("place_id").agg(F.least(F.count("*") * 5, F.lit(100)).alias("walk"), F.least(F.avg("price") / 25_000, F.lit(10.0)).alias("school"))
    return g.select("place_id", scores.lifestyle(F.col("walk"), F.col("school")).alias("lifestyle_category"))


def e8_fragments(s, d):
    """Facet, boost, count and flag of the names that each listing goes with, none included."""
    names = listing_features(s, d).groupBy("listing_id").agg(F.collect_set("feature").alias("names"))
    j = listings(s, d).select("listing_id").join(names, "listing_id", "left")
    return j.select("listing_id", *[c.alias(n) for n, c in scores.association(F.col("names")).items()])


def m8_locations(s, d):
    """A line's supplier as the guess of where its customer is: accuracy by level, their weighted sum, and calibration."""
    n = table(s, d, "nation").select("n_nationkey", F.lower("n_name").alias("city"), "n_regionkey")
    guess = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("city").alias("g_city"), F.col("n_regionkey").alias("g_state"))
    truth = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("l_orderkey"), "city", F.col("n_regionkey").alias("state"))
    j = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", (1 - F.col("l_discount")).alias("confidence")).join(guess, "l_suppkey").join(truth, "l_orderkey")
    right = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    m = j.agg(right(F.col("city") == F.col("g_city")).alias("city"), right(F.col("state") == F.col("g_state")).alias("state"), right(F.left("city", F.lit(1)) == F.left("g_city", F.lit(1))).alias("county"), F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("std"))
    cells = {"city": F.col("city"), "state": F.col("state"), "county": F.col("county"), "location": 0.5 * F.col("city") + 0.3 * F.col("state") + 0.2 * F.col("county"), "confidence": F.col("mean"), "std": F.col("std"), "calibration_error": F.abs(F.col("mean") - (F.col("city") + F.col("state")) / 2)}
    return m.select(*[F.round(c, 6).alias(n) for n, c in cells.items()])


UNITS = f"(SELECT l.*, units, price / units AS per_unit FROM {LISTED} l JOIN (SELECT l_orderkey AS listing_id, sum(l_quantity) AS units FROM lineitem GROUP BY 1) USING (listing_id) WHERE units > 0)"
HELD = f"(SELECT listing_id, count(*) AS n FROM {FEATS} GROUP BY 1)"
QUERIES = {
    "g20a_counts": (g20a_counts, f"SELECT 'city' AS report, city AS name, count(*) AS n FROM {LISTED} GROUP BY 2 UNION ALL SELECT 'type', kind, count(*) FROM {LISTED} GROUP BY 2 UNION ALL SELECT 'label', 'listing', count(*) FROM orders UNION ALL SELECT 'label', 'place', count(*) FROM customer UNION ALL SELECT 'label', 'article', count(*) FROM documents"),
    "g20b_distribution": (g20b_distribution, f"SELECT coalesce(n, 0) AS features, count(*) AS listings FROM {LISTED} LEFT JOIN {HELD} USING (listing_id) GROUP BY 1"),
    "g20b_overview": (g20b_overview, f"SELECT count(*) AS listings, round(avg(n), 6) AS features, round(avg(price), 4) AS price FROM {LISTED} JOIN {HELD} USING (listing_id)"),
    "g20b_hierarchy": (g20b_hierarchy, f"SELECT state, count(DISTINCT city) AS cities, count(DISTINCT place_id) AS places, count(*) AS listings FROM {LISTED} GROUP BY 1"),
    "g20c_places": (g20c_places, f"SELECT place_id, count(*) AS n, round(avg(price), 6) AS mean, min(price) AS least, max(price) AS most FROM {LISTED} GROUP BY 1 HAVING count(*) >= 2"),
    "g20e_popular": (g20e_popular, f"SELECT feature, count(*) AS listings, count(DISTINCT kind) AS kinds, round(avg(price), 4) AS mean FROM {FEATS} JOIN {LISTED} USING (listing_id) GROUP BY 1"),
    "g20e_categories": (g20e_categories, "SELECT split_part(p_type, ' ', 1) AS category, count(DISTINCT p_brand) AS features, count(*) AS parts FROM part GROUP BY 1"),
    "g20f_unit_prices": (g20f_unit_prices, f"SELECT city, count(*) AS n, round(avg(per_unit), 4) AS mean, round(min(per_unit), 4) AS least, round(max(per_unit), 4) AS most FROM {UNITS} GROUP BY 1"),
    "g20f_best_value": (g20f_best_value, f"SELECT listing_id, city, units, round(per_unit, 4) AS per_unit FROM {UNITS} u WHERE units >= 20 ORDER BY u.per_unit, listing_id LIMIT 10"),
    "g20g_embedded": (g20g_embedded, "SELECT lang, count(*) AS documents, count(embedding) AS embedded FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY 1"),
    "g20g_random_start": (g20g_random_start, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL) ORDER BY md5(doc_id || ':42'), doc_id LIMIT 1"),
    "g20h_lifestyle": (g20h_lifestyle, f"SELECT tag, count(*) AS listings, round(avg(price), 4) AS mean FROM (SELECT DISTINCT l_orderkey AS listing_id, tag FROM lineitem JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part) ON l_partkey = p_partkey) JOIN {LISTED} USING (listing_id) GROUP BY 1 HAVING count(*) >= 10"),
    "g14_near_by": (g14_near_by, f"SELECT 'place:' || u AS from_id, 'place:' || v AS to_id, 'NEAR_BY' AS relationship_type, round(1 - km / 1500, 4) AS weight FROM (SELECT a.s_suppkey AS u, b.s_suppkey AS v, {PAIR} AS km FROM {GEO} a JOIN {GEO} b ON a.s_suppkey <> b.s_suppkey) WHERE km <= 1500"),
    "p2_structs": (p2_structs, "SELECT n_nationkey, loc.city AS city, loc.state AS state, CAST(to_json(loc) AS VARCHAR) AS location_json FROM (SELECT n_nationkey, {'city': lower(n_name), 'state': r_name, 'key': n_regionkey} AS loc FROM nation JOIN region ON n_regionkey = r_regionkey)"),
    "f1_concat": (f1_concat, "SELECT c_custkey, c_name || '-' || seg AS strict, concat_ws(', ', c_name, seg, c_nationkey) AS listed, coalesce(seg, 'none') AS segment FROM (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)"),
    "f2_strings": (f2_strings, "SELECT p_partkey, trim('  ' || p_type || ' ') AS trimmed, lower(p_type) AS low, upper(p_name) AS up, left(p_type, 4) AS head, substring(p_type, 3, 5) AS middle, CAST(length(p_name) AS INT) AS size, replace(p_type, ' ', '_') AS joined FROM part"),
    "f3_regex": (f3_regex, r"SELECT p_partkey, regexp_replace(p_name, '[aeiou]+', '*', 'gi') AS masked, regexp_replace(p_type, '\s+\S+$', '') AS short, regexp_matches(p_type, '(?i)^(promo|small).*(steel|brass)$') AS fits FROM part"),
    "f4_slugs": (f4_slugs, f"SELECT p_partkey, {SLUG('p_name')} AS slug, 'part:' || {SLUG('p_brand')} || '_' || {SLUG('p_type')} AS node FROM part"),
    "f6_paths": (f6_paths, f"SELECT 'state:' || {SLUG('r_name')} AS id, r_name AS path, 'state' AS level, NULL AS parent FROM region UNION ALL SELECT 'city:' || {SLUG('n_name')}, r_name || ' > ' || n_name, 'city', 'state:' || {SLUG('r_name')} FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "f8_numbers": (f8_numbers, "SELECT c_custkey, round(c_acctbal / 3, 4) AS third, least(c_acctbal, 1000.0::DOUBLE) AS capped, abs(c_acctbal) AS size, CAST(floor(c_acctbal) AS BIGINT) AS whole, CAST(c_nationkey * 43560 AS BIGINT) AS sqft FROM customer"),
    "f9_arrays": (f9_arrays, "SELECT p_partkey, CAST(len(t) AS INT) AS n, t[1] AS first, t[-1] AS last, array_to_string(list_filter(t, lambda x: length(x) > 4), ',') AS long, CAST(len([p_brand, p_type]) AS INT) AS listed FROM (SELECT *, string_split(p_name, ' ') AS t FROM part)"),
    "w2_dedup": (w2_dedup, "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS turn FROM events) WHERE turn = 1"),
    "j18_merged": (j18_merged, "SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers, round(avg(s_acctbal), 4) AS balance FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"),
    "l3_caps": (l3_caps, f"SELECT query_id, count(*) AS looked_at, count(*) FILTER (rank <= 25) AS kept, round(min(score) FILTER (rank <= 25), 5) AS least FROM ({KNN}) WHERE rank <= 100 GROUP BY 1"),
    "u2_appended": (u2_appended, "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY 1"),
    "q1_columns": (q1_columns, "SELECT 'documents' AS checked, unnest(['doc_id', 'text', 'lang']) AS \"column\", true AS present, unnest([count(doc_id), count(text), count(lang)]) AS filled FROM documents UNION ALL SELECT 'part', unnest(['p_partkey', 'p_brand', 'p_color']), unnest([true, true, false]), unnest([count(p_partkey), count(p_brand), 0]) FROM part UNION ALL SELECT 'labels', unnest(['doc_id', 'quality']), true, unnest([count(doc_id), count(quality)]) FROM labels"),
    "q5_short": (q5_short, "SELECT 'text' AS field, CAST(min(length(text)) AS INT) AS least, count(*) FILTER (length(text) < 100) AS \"under\", count(*) FILTER (length(text) < 100) > 0 AS warn FROM documents UNION ALL SELECT 'lang', CAST(min(length(lang)) AS INT), count(*) FILTER (length(lang) < 2), count(*) FILTER (length(lang) < 2) > 0 FROM documents UNION ALL SELECT 'source', CAST(min(length(source)) AS INT), count(*) FILTER (length(source) < 5), count(*) FILTER (length(source) < 5) > 0 FROM documents"),
    "e4_lifestyle": (e4_lifestyle, f"SELECT place_id, CASE WHEN w >= 70 AND sc >= 8 THEN 'family_friendly_urban' WHEN w >= 70 THEN 'urban_lifestyle' WHEN sc >= 8 THEN 'family_oriented' ELSE 'standard_community' END AS lifestyle_category FROM (SELECT place_id, least(count(*) * 5, 100) AS w, least(avg(price) / 25000, 10) AS sc FROM {LISTED} GROUP BY 1)"),
    "e8_fragments": (e8_fragments, f"SELECT listing_id, CASE WHEN n > 1 THEN 'multi_neighborhood' WHEN n = 1 THEN 'has_neighborhood' ELSE 'no_neighborhood' END AS facet, CASE WHEN n > 1 THEN 0.15::DOUBLE WHEN n = 1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS boost, CAST(coalesce(n, 0) AS INT) AS n, coalesce(n, 0) > 0 AS associated FROM {LISTED} LEFT JOIN {HELD} USING (listing_id)"),
    "m8_locations": (m8_locations, "WITH n AS (SELECT n_nationkey, lower(n_name) AS city, n_regionkey AS state FROM nation), m AS (SELECT avg(CAST(a.city = b.city AS INT)) AS city, avg(CAST(a.state = b.state AS INT)) AS state, avg(CAST(left(a.city, 1) = left(b.city, 1) AS INT)) AS county, avg(1 - l_discount) AS mean, stddev_pop(1 - l_discount) AS std FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN n a ON s_nationkey = a.n_nationkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN n b ON c_nationkey = b.n_nationkey) SELECT round(city, 6) AS city, round(state, 6) AS state, round(county, 6) AS county, round(0.5::DOUBLE * city + 0.3::DOUBLE * state + 0.2::DOUBLE * county, 6) AS location, round(mean, 6) AS confidence, round(std, 6) AS std, round(abs(mean - (city + state) / 2), 6) AS calibration_error FROM m"),
}

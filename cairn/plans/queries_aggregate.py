"""Grouped, bucketed and statistical aggregations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import geo
from cairn.functions.text import tokens
from cairn.operators import facets
from cairn.plans.binding import listings, tagged_parts
from cairn.sources.tables import table

PRICE = {"avg_price": ("avg", "price"), "min_price": ("min", "price"), "max_price": ("max", "price")}
CUTS, BANDS = (100_000.0, 200_000.0, 300_000.0, 400_000.0), ("b1", "b2", "b3", "b4", "b5")
BAND_SQL = "CASE WHEN o_totalprice < 100000 THEN 'b1' WHEN o_totalprice < 200000 THEN 'b2' WHEN o_totalprice < 300000 THEN 'b3' WHEN o_totalprice < 400000 THEN 'b4' ELSE 'b5' END"
LISTED = "(SELECT o_orderkey AS listing_id, o_custkey AS place_id, o_totalprice AS price, o_orderpriority AS kind, o_orderstatus AS status, o_orderdate AS listed_on, c_name AS place, n_name AS city, r_name AS state FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def a1_terms_stats(spark, d):
    return rounded(facets.terms(listings(spark, d), "city", PRICE, 20), "avg_price", digits=4)


def a2_nested_terms(spark, d):
    return facets.nested_terms(listings(spark, d), "city", "kind", 3)


def a3_grouped_and_global(spark, d):
    out = facets.with_total(listings(spark, d), "city", [F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("avg_price")])
    return out


def a4_histogram(spark, d):
    return facets.histogram(table(spark, d, "orders"), "o_totalprice", 50_000)


def a4_dense_histogram(spark, d):
    return facets.histogram(table(spark, d, "orders"), "o_totalprice", 25_000, min_doc_count=0, bounds=(0, 600_000))


def a5_histogram_by_kind(spark, d):
    o = table(spark, d, "orders").withColumn("bucket", facets.bucket_of(F.col("o_totalprice"), 100_000))
    return rounded(o.groupBy("bucket", F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("avg_price")), "avg_price", digits=4)


def a7_extended_stats(spark, d):
    out = facets.extended_stats(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return rounded(out, "mean", "total", "std", "range", digits=3).withColumn("variance", F.round("variance", 0))


def a8_compiled(spark, d):
    li = table(spark, d, "lineitem")
    return rounded(facets.aggregate(li, {"terms": {"field": "l_linestatus", "size": 5}, "aggs": {"qty": ("sum", "l_quantity"), "orders": ("cardinality", "l_orderkey")}}), "qty", digits=2)


def a9_date_histogram(spark, d):
    out = facets.aggregate(table(spark, d, "events"), {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"total": ("sum", "value")}})
    return rounded(out, "total", digits=3)


def a10_cardinality(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


def a11_geo_bounds(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"))
    return s.agg(F.max("lat").alias("top"), F.min("lat").alias("bottom"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.round(F.avg("lat"), 6).alias("center_lat"), F.round(F.avg("lon"), 6).alias("center_lon"))


def a12_ranges(spark, d):
    return rounded(facets.ranges(listings(spark, d), "price", CUTS, BANDS, {"avg_price": ("avg", "price")}), "avg_price", digits=4)


def a13_features(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("feature")).select(F.lower(F.trim("feature")).alias("feature")).where("feature <> ''").groupBy("feature").agg(F.count("*").alias("n"))


def a14_extractions(spark, d):
    part = table(spark, d, "part").groupBy(F.lit("type").alias("what"), F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    city = listings(spark, d).groupBy(F.lit("city").alias("what"), F.col("city").alias("name")).agg(F.count("*").alias("n"))
    band = listings(spark, d).groupBy(F.lit("band").alias("what"), facets.ladder(F.col("price"), CUTS, BANDS).alias("name")).agg(F.count("*").alias("n"))
    return part.unionByName(city).unionByName(band)


def a15_list_per_group(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.min_by("l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("first_part"))


def a17_samples(spark, d):
    return listings(spark, d).groupBy("city").agg(F.array_join(F.slice(F.array_sort(F.collect_set("kind")), 1, 3), ",").alias("kinds"), F.countDistinct("place_id").alias("places"))


def a18_having(spark, d):
    return rounded(listings(spark, d).groupBy("place_id").agg(F.count("*").alias("n"), F.avg("price").alias("avg_price")).where("n >= 20"), "avg_price", digits=4)


def a19_luxury_share(spark, d):
    out = listings(spark, d).groupBy("city").agg(F.count_if(F.col("price") > 300_000).alias("luxury"), F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("luxury") / F.col("n"), 6))


def a20_segments(spark, d):
    return rounded(listings(spark, d).groupBy("city", facets.ladder(F.col("price"), CUTS, BANDS).alias("segment")).agg(F.count("*").alias("n"), F.avg("price").alias("avg_price")), "avg_price", digits=2)


def a22_hit_bands(spark, d):
    """How many documents have any term of a query, in bands of that number."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    found = docs.join(asked, "term").select("item_id", "doc_id").distinct().groupBy("item_id").agg(F.count("*").alias("hits"))
    hits = table(spark, d, "benchmark").select("item_id").join(found, "item_id", "left").na.fill(0, ["hits"])
    return hits.groupBy(facets.ladder(F.col("hits"), (1, 11, 101), ("none", "1-10", "11-100", "over 100")).alias("band")).agg(F.count("*").alias("queries"))


def a23_metadata_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.unpivot([], ["lang", "source"], "field", "value").groupBy("field", F.coalesce("value", F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def a26_correlation(spark, d):
    return table(spark, d, "lineitem").agg(*[F.round(F.corr("l_extendedprice", c), 6).alias(c) for c in ("l_quantity", "l_discount", "l_tax")])


def a27_binned(spark, d):
    return table(spark, d, "orders").groupBy(facets.ladder(F.col("o_totalprice"), CUTS, BANDS, closed_right=True).alias("bin")).agg(F.count("*").alias("n"))


def a28_accuracy(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.agg(F.count("*").alias("n"), F.count_if(F.lower("lang") == "en").alias("en"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.round(F.avg("quality"), 6).alias("avg_quality"))


def a29_table_stats(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("n"), F.countDistinct("c_mktsegment").alias("segments"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.avg("c_acctbal"), 4).alias("avg_balance"), F.count_if(F.col("c_acctbal") < 0).alias("review"))


def a29b_verification(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    same = F.when(F.col("lang").isNotNull() & F.col("quality").isNotNull(), F.lower(F.trim("lang")) == F.when(F.col("quality") == 1, "en").otherwise("de"))
    return j.select("doc_id", same.cast("int").alias("agrees"))


def a29c_budget_places(spark, d):
    g = listings(spark, d).where(~F.col("city").isin("NATION_0", "FRANCE", "GERMANY")).groupBy("city").agg(F.count("*").alias("n"), F.avg("price").alias("avg_price"), F.countDistinct("kind").alias("kinds")).where("n >= 5")
    return rounded(g, "avg_price", digits=4)


def a29d_segment_value(spark, d):
    g = tagged_parts(spark, d).groupBy("brand", "tags").agg(F.sum("price").alias("total"), F.avg("price").alias("mean"))
    return rounded(g.select(F.explode("tags").alias("tag"), "total", "mean").groupBy("tag").agg(F.sum("total").alias("total"), F.avg("mean").alias("mean")), "total", "mean", digits=3)


def a29e_hierarchy(spark, d):
    return listings(spark, d).groupBy("state").agg(F.count("*").alias("paths"), F.countDistinct("city").alias("cities"), F.countDistinct("place_id").alias("places"))


def f13_distances(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 180 - 90).cast("double").alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180).cast("double").alias("lon"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(37.77), F.lit(-122.42))
    return s.select("s_suppkey", F.round(km, 4).alias("km"), F.round(geo.convert(km, "km", "mi"), 4).alias("miles"), geo.in_box(F.col("lat"), F.col("lon"), -45, -90, 45, 90).alias("inside"))


HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(37.77 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.77)) * pow(sin(radians(-122.42 - lon) / 2), 2))))"
PLACES = "(SELECT s_suppkey, (s_suppkey % 180 - 90)::DOUBLE AS lat, (s_suppkey * 7 % 360 - 180)::DOUBLE AS lon FROM supplier)"
QUERIES = {
    "a1_terms_stats": (a1_terms_stats, f"SELECT city, count(*) AS doc_count, round(avg(price), 4) AS avg_price, min(price) AS min_price, max(price) AS max_price FROM {LISTED} GROUP BY city ORDER BY doc_count DESC, city LIMIT 20"),
    "a2_nested_terms": (a2_nested_terms, f"SELECT * FROM (SELECT city, kind, n AS doc_count, CAST(row_number() OVER (PARTITION BY city ORDER BY n DESC, kind) AS INT) AS rank FROM (SELECT city, kind, count(*) AS n FROM {LISTED} GROUP BY ALL)) WHERE rank <= 3"),
    "a3_grouped_and_global": (a3_grouped_and_global, f"SELECT city, CAST(grouping(city) AS INT) AS is_total, count(*) AS n, round(avg(price), 4) AS avg_price FROM {LISTED} GROUP BY ROLLUP (city)"),
    "a4_histogram": (a4_histogram, "SELECT floor(o_totalprice / 50000) * 50000.0::DOUBLE AS bucket, count(*) AS doc_count FROM orders GROUP BY 1"),
    "a4_dense_histogram": (a4_dense_histogram, "SELECT g * 25000.0::DOUBLE AS bucket, count(o_orderkey) AS doc_count FROM range(0, 25) t(g) LEFT JOIN orders ON floor(o_totalprice / 25000) = g GROUP BY g"),
    "a5_histogram_by_kind": (a5_histogram_by_kind, "SELECT floor(o_totalprice / 100000) * 100000.0::DOUBLE AS bucket, o_orderpriority AS kind, count(*) AS n, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1, 2"),
    "a7_extended_stats": (a7_extended_stats, "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, round(avg(l_extendedprice), 3) AS mean, round(sum(l_extendedprice), 3) AS total, round(stddev_pop(l_extendedprice), 3) AS std, round(var_pop(l_extendedprice), 0) AS variance, round(max(l_extendedprice) - min(l_extendedprice), 3) AS range FROM lineitem GROUP BY 1"),
    "a8_compiled": (a8_compiled, "SELECT l_linestatus, count(*) AS doc_count, round(sum(l_quantity), 2) AS qty, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
    "a9_date_histogram": (a9_date_histogram, "SELECT date_trunc('day', ts)::TIMESTAMP AS bucket, count(*) AS doc_count, round(sum(value), 3) AS total FROM events GROUP BY 1"),
    "a10_cardinality": (a10_cardinality, "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "a11_geo_bounds": (a11_geo_bounds, f"SELECT max(lat) AS top, min(lat) AS bottom, min(lon) AS west, max(lon) AS east, round(avg(lat), 6) AS center_lat, round(avg(lon), 6) AS center_lon FROM {PLACES}"),
    "a12_ranges": (a12_ranges, f"SELECT {BAND_SQL} AS bucket, count(*) AS doc_count, round(avg(o_totalprice), 4) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "a13_features": (a13_features, "SELECT feature, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')))) AS feature FROM part) WHERE feature <> '' GROUP BY 1"),
    "a14_extractions": (a14_extractions, f"SELECT 'type' AS what, p_type AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'city', city, count(*) FROM {LISTED} GROUP BY 2 UNION ALL SELECT 'band', {BAND_SQL.replace('o_totalprice', 'price')}, count(*) FROM {LISTED} GROUP BY 2"),
    "a15_list_per_group": (a15_list_per_group, "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, first(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS first_part FROM lineitem GROUP BY 1"),
    "a17_samples": (a17_samples, f"SELECT city, array_to_string(list_slice(list_sort(list(DISTINCT kind)), 1, 3), ',') AS kinds, count(DISTINCT place_id) AS places FROM {LISTED} GROUP BY 1"),
    "a18_having": (a18_having, f"SELECT place_id, count(*) AS n, round(avg(price), 4) AS avg_price FROM {LISTED} GROUP BY 1 HAVING count(*) >= 20"),
    "a19_luxury_share": (a19_luxury_share, f"SELECT city, count(*) FILTER (price > 300000) AS luxury, count(*) AS n, round(count(*) FILTER (price > 300000) / count(*), 6) AS share FROM {LISTED} GROUP BY 1"),
    "a20_segments": (a20_segments, f"SELECT city, {BAND_SQL.replace('o_totalprice', 'price')} AS segment, count(*) AS n, round(avg(price), 2) AS avg_price FROM {LISTED} GROUP BY 1, 2"),
    "a21_distribution": (lambda s, d: table(s, d, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.split("p_name", " "))), 6).alias("avg_features")), "SELECT p_type, p_size, count(*) AS n, round(avg(len(string_split(p_name, ' '))), 6) AS avg_features FROM part GROUP BY 1, 2"),
    "a22_hit_bands": (a22_hit_bands, "WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))) AS term FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'))) AS term FROM documents), h AS (SELECT item_id, count(DISTINCT doc_id) AS hits FROM benchmark LEFT JOIN (SELECT item_id, doc_id FROM q JOIN t USING (term)) USING (item_id) GROUP BY 1) SELECT CASE WHEN hits < 1 THEN 'none' WHEN hits < 11 THEN '1-10' WHEN hits < 101 THEN '11-100' ELSE 'over 100' END AS band, count(*) AS queries FROM h GROUP BY 1"),
    "a23_metadata_counts": (a23_metadata_counts, "SELECT 'lang' AS field, coalesce(lang, 'null') AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'null'), count(*) FROM documents GROUP BY 2"),
    "a26_correlation": (a26_correlation, "SELECT round(corr(l_extendedprice, l_quantity), 6) AS l_quantity, round(corr(l_extendedprice, l_discount), 6) AS l_discount, round(corr(l_extendedprice, l_tax), 6) AS l_tax FROM lineitem"),
    "a27_binned": (a27_binned, f"SELECT {BAND_SQL.replace('<', '<=')} AS bin, count(*) AS n FROM orders GROUP BY 1"),
    "a28_accuracy": (a28_accuracy, "SELECT count(*) AS n, count(*) FILTER (lower(lang) = 'en') AS en, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, round(avg(quality), 6) AS avg_quality FROM documents JOIN labels USING (doc_id)"),
    "a29_table_stats": (a29_table_stats, "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations, round(avg(c_acctbal), 4) AS avg_balance, count(*) FILTER (c_acctbal < 0) AS review FROM customer"),
    "a29b_verification": (a29b_verification, "SELECT doc_id, CASE WHEN lang IS NOT NULL AND quality IS NOT NULL THEN CAST(lower(trim(lang)) = CASE WHEN quality = 1 THEN 'en' ELSE 'de' END AS INT) END AS agrees FROM documents LEFT JOIN labels USING (doc_id)"),
    "a29c_budget_places": (a29c_budget_places, f"SELECT city, count(*) AS n, round(avg(price), 4) AS avg_price, count(DISTINCT kind) AS kinds FROM {LISTED} WHERE city NOT IN ('NATION_0', 'FRANCE', 'GERMANY') GROUP BY 1 HAVING count(*) >= 5"),
    "a29d_segment_value": (a29d_segment_value, "SELECT tag, round(sum(total), 3) AS total, round(avg(mean), 3) AS mean FROM (SELECT unnest(tags) AS tag, total, mean FROM (SELECT p_brand, string_split(p_name, ' ') AS tags, sum(p_retailprice) AS total, avg(p_retailprice) AS mean FROM part GROUP BY 1, 2)) GROUP BY 1"),
    "a29e_hierarchy": (a29e_hierarchy, f"SELECT state, count(*) AS paths, count(DISTINCT city) AS cities, count(DISTINCT place_id) AS places FROM {LISTED} GROUP BY 1"),
    "f13_distances": (f13_distances, f"SELECT s_suppkey, round({HAV}, 4) AS km, round({HAV} / 1.609344, 4) AS miles, lat BETWEEN -45 AND 45 AND lon BETWEEN -90 AND 90 AS inside FROM {PLACES}"),
}

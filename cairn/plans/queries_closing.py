"""Query nodes, source fields, entity facets, lineage, ladders, the postal graph, file sources and the like."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import facets, filters, graph, scores
from cairn.plans.binding import listings, tagged_parts
from cairn.plans.queries_aggregate import LISTED
from cairn.plans.queries_search import TOK
from cairn.sources import files, sinks
from cairn.sources.shared import new_path
from cairn.sources.tables import table


def p8_nodes(s, d):
    """One search made of query nodes: operators, boosts, fuzziness, a phrase and a range."""
    nodes = [
        {"match": {"p_name": {"query": "lime red", "operator": "and", "boost": 2.0}}},
        {"match": {"p_name": {"query": "bleu", "fuzziness": "AUTO", "boost": 0.5}}},
        {"multi_match": {"query": "steel", "fields": {"p_type": 1.0, "p_name": 3.0}}},
        {"match_phrase": {"p_type": {"query": "small plated"}}},
        {"range": {"p_retailprice": {"gte": 1200, "boost": 0.25}}},
        {"term": {"p_brand": {"value": "Brand#11", "boost": 4.0}}},
    ]
    score = filters.node_score(nodes)
    return table(s, d, "part").select("p_partkey", score.alias("score")).where("score > 0")


def p12_compound(s, d):
    """Rows by a compound condition, then some of their columns."""
    p = table(s, d, "part")
    return p[(p.p_size >= 10) & (p.p_size <= 40) & ((p.p_retailprice < 1100) | (p.p_brand == "Brand#22")) & ~p.p_type.startswith("PROMO")][["p_partkey", "p_size", "p_retailprice"]]


def p15_intents(s, d):
    """Location intents, one for each nation, compiled to filters of any letter case and met with the listings."""
    o = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    intents = o.select(F.lower("n_name").alias("want_city"), F.upper("r_name").alias("want_state"))
    return intents.join(listings(s, d), (F.lower("city") == F.col("want_city")) & (F.upper("state") == F.col("want_state"))).groupBy("want_city", "want_state").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("avg_price"))


def source_fields(df: DataFrame, includes: Sequence[str] = ("*",), excludes: Sequence[str] = ()) -> DataFrame:
    """The columns that some include pattern and no exclude pattern fits, in their order."""
    fits = lambda c, patterns: any(fnmatch.fnmatchcase(c, p) for p in patterns)
    return df.select(*[c for c in df.columns if fits(c, includes) and not fits(c, excludes)])


def a24_entities(s, d):
    """The ten most frequent terms of each kind of speaker, counted once a turn."""
    t = table(s, d, "conversations").select(F.col("role").alias("kind"), F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("entity"))
    n = t.groupBy("kind", "entity").agg(F.count("*").alias("n"))
    return graph.top_per(n, "kind", [F.desc("n"), F.col("entity")], 10).drop("rank")


def c5_whole(s, d):
    """Each text as its one chunk."""
    return table(s, d, "documents").select("doc_id", F.lit(0).alias("chunk_index"), F.lit(1).alias("total"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash"))


def lineage(df: DataFrame, layer: str) -> DataFrame:
    """``df`` with the layer it was made for and the time of the run."""
    return df.withColumns({"layer": F.lit(layer), "processed_at": F.current_timestamp()})


def f10_lineage(s, d):
    made = lineage(table(s, d, "nation").select("n_nationkey", "n_name"), "gold")
    return made.select("n_nationkey", "layer", (F.col("processed_at") > F.lit("2020-01-01").cast("timestamp")).alias("stamped"))


# Relevance of an article by how it belongs to a place.
RELEVANCE = {"primary": 0.9, "neighborhood": 0.8, "reference": 0.6}


def by_type(value: Column, ladder: dict, otherwise: object) -> Column:
    """The value's step of a ladder that is keyed by type."""
    out = F.lit(otherwise)
    for k, v in ladder.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def f18_ladders(s, d):
    """Types to relevance, relevance to confidence, and places to categories."""
    kind = F.element_at(F.array(F.lit("primary"), F.lit("neighborhood"), F.lit("reference"), F.lit("other")), (F.col("doc_id") % 4 + 1).cast("int"))
    r = table(s, d, "documents").select("doc_id", kind.alias("kind")).withColumn("relevance", by_type(F.col("kind"), RELEVANCE, 0.3))
    return r.withColumn("confidence", F.when(F.col("relevance") >= 0.8, "high").when(F.col("relevance") >= 0.5, "medium").otherwise("low"))


def postal(s, d) -> DataFrame:
    """Listings with a ZIP made of their place (every 13th a placeholder) and the county, their city's market segment."""
    segment = table(s, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_mktsegment").alias("segment"))
    code = F.when(F.col("place_id") % 13 == 0, F.lit("00000")).otherwise(F.lpad((F.col("place_id") % 90_000 + 10_000).cast("string"), 5, "0"))
    return listings(s, d).join(segment, "place_id").select("listing_id", "place_id", "city", "state", F.concat_ws(" ", "city", "segment").alias("county"), code.alias("zip"))


POSTAL = f"(SELECT listing_id, place_id, city, state, city || ' ' || c_mktsegment AS county, CASE WHEN place_id % 13 = 0 THEN '00000' ELSE lpad(CAST(place_id % 90000 + 10000 AS VARCHAR), 5, '0') END AS zip FROM {LISTED} JOIN customer ON c_custkey = place_id)"
VALID = "zip <> '00000'"


def g3_places(s, d):
    """County and valid ZIP nodes next to cities and states."""
    p = postal(s, d)
    valid = p.where(text.postal_status(F.col("zip"), ("00000",)) == "valid")
    kinds = [graph.nodes(p, "county", text.slug(F.col("county"))), graph.nodes(p, "city", text.slug(F.col("city"))), graph.nodes(p, "state", text.slug(F.col("state"))), graph.nodes(valid, "zip", F.col("zip"))]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def g7_county_edges(s, d):
    p = postal(s, d)
    return graph.edges(p, "PART_OF", ("place", F.col("place_id")), ("city", text.slug(F.col("city")))).unionByName(graph.edges(p, "IN_COUNTY", ("place", F.col("place_id")), ("county", text.slug(F.col("county")))))


def g11_zip_edges(s, d):
    valid = postal(s, d).where("zip <> '00000'")
    return graph.edges(valid, "IN_ZIP", ("listing", F.col("listing_id")), ("zip", F.col("zip"))).unionByName(graph.edges(valid, "IN_ZIP", ("place", F.col("place_id")), ("zip", F.col("zip"))))


def g12_zip_hierarchy(s, d):
    p = postal(s, d)
    levels = [graph.edges(p.where("zip <> '00000'"), "IN_CITY", ("zip", F.col("zip")), ("city", text.slug(F.col("city")))), graph.edges(p, "IN_COUNTY", ("city", text.slug(F.col("city"))), ("county", text.slug(F.col("county")))), graph.edges(p, "IN_STATE", ("county", text.slug(F.col("county"))), ("state", text.slug(F.col("state"))))]
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


def g20d_similar(s, d):
    """Brands whose tag sets overlap by more than half, by shared tags over all tags of both."""
    t = tagged_parts(s, d).select("brand", F.explode("tags").alias("tag")).distinct()
    n = t.groupBy("brand").agg(F.count("*").alias("n"))
    pairs = graph.pair_counts(t, "tag", "brand")
    joined = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return joined.select("a", "b", F.round(F.col("together") / (F.col("na") + F.col("nb") - F.col("together")), 6).alias("similarity")).where("similarity > 0.5")


def g20d_lifestyles(s, d):
    """Parts and brands of each tag: explode, then count."""
    return tagged_parts(s, d).select("part_id", "brand", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("part_id").alias("parts"), F.countDistinct("brand").alias("brands"))


def g20d_connected(s, d):
    """Customers with the number of their orders, none included."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("links"))
    return table(s, d, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["links"])


TOPICS = ("Housing market", "Public parks", "Military history", "Ski resort", "Quantum physics", "Zoning law", "Chess")


def e12_topic_relevance(s, d):
    """Articles with a place, a confidence and key topics by their number: location, topics, county and city parts of the score."""
    i = F.col("doc_id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    topics = F.when(i % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(TOPICS, i % 7), pick(TOPICS, (i * 3 + 1) % 7), pick(TOPICS, F.floor(i / 7) % 7)))
    made = table(s, d, "documents").select(
        "doc_id", pick(("Utah", "California", "Nevada", None), i % 4).alias("state"), pick(("Summit County", "Alameda County", None), i % 3).alias("county"),
        pick(("Park City", "Fresno", None, "San Francisco"), F.floor(i / 4) % 4).alias("city"), ((i % 10) / 10).alias("confidence"), topics.alias("topics"),
    )
    score = scores.topic_relevance(F.col("state"), F.col("county"), F.col("city"), F.col("confidence"), F.col("topics"))
    return made.select("doc_id", F.round(score, 6).alias("relevance"), (F.round(score, 6) >= 0.5).alias("relevant"))


def e17_grades(s, d):
    """Grades 0 to 3 of listings for geographic, category and proximity queries: one query for each nation."""
    q = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("q_city"), F.col("r_name").alias("q_state"), (F.col("n_nationkey") * 4000.0).alias("q_price"))
    near = listings(s, d).groupBy("city", "state", "kind").agg(F.avg("price").alias("price"))
    geographic = F.when(F.col("city") == F.col("q_city"), 3).when(F.col("state") == F.col("q_state"), 2).otherwise(0)
    gap = F.abs(F.col("price") - F.col("q_price"))
    proximity = F.when(gap < 20_000, 3).when(gap < 60_000, 2).when(gap < 120_000, 1).otherwise(0)
    category = F.when(F.col("kind") == "1-URGENT", 3).when(F.col("kind") == "2-HIGH", 1).otherwise(0)
    met = near.join(q, F.col("state") == F.col("q_state"))
    return met.select("n_nationkey", "city", "kind", geographic.alias("geographic"), proximity.alias("proximity"), category.alias("category"))


def s1_json(s, d):
    """Documents written as JSON files of several objects each and read again under a given schema, file by file."""
    path = new_path(s, "json")
    table(s, d, "documents").select("doc_id", "text", "lang").repartition(4).write.json(path)
    return files.json_lines(s, [path], "doc_id long, text string, lang string").select("doc_id", "lang", F.length("text").alias("chars"), F.col("source_file").isNotNull().alias("named"))


def s2_hierarchy(s, d):
    """Nations nested in their regions, written as JSON and flattened again."""
    path = new_path(s, "places")
    o = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o.groupBy("r_name").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("places")).write.json(path)
    read = files.json_lines(s, [path], "r_name string, places array<struct<n_name: string, n_nationkey: long>>")
    return read.select(F.col("r_name").alias("state"), F.inline("places")).select("state", F.col("n_name").alias("city"), "n_nationkey")


def s5_folder(s, d):
    """Pages written into a folder of some thousand a file, with a control character after each, and scanned again lazily with its pages whole."""
    path, end, tab = new_path(s, "pages"), "\x1e", "\x1f"
    pages = table(s, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(tab), F.regexp_replace(F.coalesce("html", F.lit("")), "[\x1e\x1f]", " ")).alias("value"))
    pages.write.option("maxRecordsPerFile", 5000).option("lineSep", end).text(path)
    parts = F.split(F.col("text"), tab, 2)
    return files.folder(s, path, "*.txt", whole=False, separator=end).select(parts[0].cast("long").alias("page_id"), F.length(parts[1]).alias("chars"))


def s8_layer(s, d):
    """A Parquet layer with the counts observed while it was written, next to those of the file."""
    path = new_path(s, "layer")
    seen = sinks.write_layer(table(s, d, "orders"), path)
    return s.read.parquet(path).agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys")).withColumns({"rows_observed": F.lit(seen["rows"]), "null_keys": F.lit(seen["null_keys"])})


def d4_categories(s, d):
    """Words of each text in five groups by their first letter, at most ten of each, in order of the alphabet."""
    words = F.array_sort(F.array_distinct(text.tokens(F.col("text"))))
    groups = {"a_e": "^[a-e]", "f_j": "^[f-j]", "k_o": "^[k-o]", "p_t": "^[p-t]", "u_z": "^[u-z]"}
    some = lambda pattern: F.array_join(F.slice(F.filter("w", lambda x: x.rlike(pattern)), 1, 10), " ")
    return table(s, d, "documents").withColumn("w", words).select("doc_id", *[some(p).alias(n) for n, p in groups.items()])


def f_band(s, d):
    """Counts per step of a ladder of sizes."""
    return table(s, d, "part").groupBy(facets.ladder(F.col("p_size"), (10, 25, 40), ("small", "medium", "large", "huge")).alias("size_band")).agg(F.count("*").alias("n"))


SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
C, CO, ST = (SLUG.format(x) for x in ("city", "county", "state"))
EDGE = lambda rows: f"SELECT DISTINCT *, 1.0::DOUBLE AS weight FROM ({' UNION ALL '.join(rows)})"
HAS = lambda col, word: f"list_contains(string_split(lower({col}), ' '), '{word}')"
_D4 = ", ".join(f"array_to_string(list_filter(w, lambda x: regexp_matches(x, '^[{a}-{b}]'))[1:10], ' ') AS {a}_{b}" for a, b in ("ae", "fj", "ko", "pt", "uz"))
_HAS = lambda words: "(" + " OR ".join(f"contains(lower(t), '{w}')" for w in words) + ")"
_NTH = lambda values, at: f"(CASE {at} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values) if v) + " END)"
E12_SQL = f"""WITH a AS (SELECT doc_id, lower({_NTH(("Utah", "California", "Nevada", None), "doc_id % 4")}) AS st, lower({_NTH(("Summit County", "Alameda County", None), "doc_id % 3")}) AS co, lower({_NTH(("Park City", "Fresno", None, "San Francisco"), "(doc_id // 4) % 4")}) AS ci,
(doc_id % 10) / 10 AS conf, CASE WHEN doc_id % 11 = 0 THEN [] ELSE [{_NTH(TOPICS, "doc_id % 7")}, {_NTH(TOPICS, "(doc_id * 3 + 1) % 7")}, {_NTH(TOPICS, "(doc_id // 7) % 7")}] END AS ts FROM documents),
n AS (SELECT *, len(ts) AS k, len(list_filter(ts, lambda t: {_HAS(scores.ESTATE_TOPICS)})) AS re, len(list_filter(ts, lambda t: {_HAS(scores.AMENITY_TOPICS)})) AS am, len(list_filter(ts, lambda t: {_HAS(scores.OTHER_TOPICS)})) AS ne FROM a),
r AS (SELECT *, CASE WHEN k = 0 THEN 0.3 WHEN re = 0 AND am = 0 THEN 0.2 ELSE greatest(least(CASE WHEN re > 0 THEN least(0.3::DOUBLE + 0.2::DOUBLE * re, 1.0) ELSE 0.0::DOUBLE END + 0.1::DOUBLE * am, 1.0) - 0.3::DOUBLE * ne, 0.0) END AS rel,
CASE WHEN st IS NULL THEN 0.3 WHEN contains(st, 'ut') OR contains(st, 'ca') THEN 1.0 ELSE 0.0 END AS loc, CASE WHEN contains(co, 'summit') OR contains(co, 'wasatch') OR contains(co, 'san francisco') OR contains(co, 'san mateo') THEN 1.0 WHEN co IS NOT NULL THEN 0.5 ELSE 0.0 END AS geo FROM n),
f AS (SELECT doc_id, greatest(least(0.4::DOUBLE * loc + 0.5::DOUBLE * rel + 0.1::DOUBLE * CASE WHEN ci IN ('park city', 'san francisco', 'palo alto') THEN least(geo + 0.3::DOUBLE, 1.0) ELSE geo END + CASE WHEN conf > 0.8 THEN 0.1 WHEN conf < 0.5 THEN -0.2 ELSE 0.0 END, 1.0), 0.0) AS s FROM r)
SELECT doc_id, round(s, 6) AS relevance, round(s, 6) >= 0.5 AS relevant FROM f"""
QUERIES = {
    "p8_nodes": (p8_nodes, f"SELECT * FROM (SELECT p_partkey, (CASE WHEN {HAS('p_name', 'lime')} AND {HAS('p_name', 'red')} THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(string_split(lower(p_name), ' '), lambda t: substr(t, 1, 2) = 'bl' AND levenshtein(t, 'bleu') <= 1)) > 0 THEN 0.5::DOUBLE ELSE 0 END + greatest(CASE WHEN {HAS('p_type', 'steel')} THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN {HAS('p_name', 'steel')} THEN 3.0::DOUBLE ELSE 0 END) + CASE WHEN contains(' ' || lower(p_type) || ' ', ' small plated ') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN p_retailprice >= 1200 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN p_brand = 'Brand#11' THEN 4.0::DOUBLE ELSE 0 END) AS score FROM part) WHERE score > 0"),
    "p12_compound": (p12_compound, "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 40 AND (p_retailprice < 1100 OR p_brand = 'Brand#22') AND NOT starts_with(p_type, 'PROMO')"),
    "p15_intents": (p15_intents, f"SELECT lower(n_name) AS want_city, upper(r_name) AS want_state, count(*) AS n, round(avg(price), 4) AS avg_price FROM nation JOIN region ON n_regionkey = r_regionkey JOIN {LISTED} l ON lower(l.city) = lower(n_name) AND upper(l.state) = upper(r_name) GROUP BY 1, 2"),
    "p19_source": (lambda s, d: source_fields(table(s, d, "documents"), ["doc_*", "n_*", "lang"], ["*_chars"]), "SELECT doc_id, lang FROM documents"),
    "a24_entities": (a24_entities, f"SELECT kind, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, entity) AS rank FROM (SELECT role AS kind, entity, count(*) AS n FROM (SELECT role, unnest(list_distinct({TOK})) AS entity FROM conversations) GROUP BY 1, 2)) WHERE rank <= 10"),
    "c5_whole": (c5_whole, "SELECT doc_id, 0 AS chunk_index, 1 AS total, md5(coalesce(text, '')) AS text_hash FROM documents"),
    "f10_lineage": (f10_lineage, "SELECT n_nationkey, 'gold' AS layer, true AS stamped FROM nation"),
    "f18_ladders": (f18_ladders, "SELECT *, CASE WHEN relevance >= 0.8 THEN 'high' WHEN relevance >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, CASE kind WHEN 'primary' THEN 0.9::DOUBLE WHEN 'neighborhood' THEN 0.8 WHEN 'reference' THEN 0.6 ELSE 0.3 END AS relevance FROM (SELECT doc_id, ['primary', 'neighborhood', 'reference', 'other'][CAST(doc_id % 4 + 1 AS INT)] AS kind FROM documents))"),
    "g3_places": (g3_places, f"SELECT DISTINCT * FROM (SELECT 'county:' || {CO} AS graph_node_id, 'county' AS node_label FROM {POSTAL} UNION ALL SELECT 'city:' || {C}, 'city' FROM {POSTAL} UNION ALL SELECT 'state:' || {ST}, 'state' FROM {POSTAL} UNION ALL SELECT 'zip:' || zip, 'zip' FROM {POSTAL} WHERE {VALID})"),
    "g7_county_edges": (g7_county_edges, EDGE([f"SELECT 'place:' || place_id AS from_id, 'city:' || {C} AS to_id, 'PART_OF' AS relationship_type FROM {POSTAL}", f"SELECT 'place:' || place_id, 'county:' || {CO}, 'IN_COUNTY' FROM {POSTAL}"])),
    "g11_zip_edges": (g11_zip_edges, EDGE([f"SELECT 'listing:' || listing_id AS from_id, 'zip:' || zip AS to_id, 'IN_ZIP' AS relationship_type FROM {POSTAL} WHERE {VALID}", f"SELECT 'place:' || place_id, 'zip:' || zip, 'IN_ZIP' FROM {POSTAL} WHERE {VALID}"])),
    "g12_zip_hierarchy": (g12_zip_hierarchy, EDGE([f"SELECT 'zip:' || zip AS from_id, 'city:' || {C} AS to_id, 'IN_CITY' AS relationship_type FROM {POSTAL} WHERE {VALID}", f"SELECT 'city:' || {C}, 'county:' || {CO}, 'IN_COUNTY' FROM {POSTAL}", f"SELECT 'county:' || {CO}, 'state:' || {ST}, 'IN_STATE' FROM {POSTAL}"])),
    "g20d_similar": (g20d_similar, "WITH t AS (SELECT DISTINCT p_brand AS brand, unnest(string_split(p_name, ' ')) AS tag FROM part), n AS (SELECT brand, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.brand AS a, b.brand AS b, count(*) AS together FROM t a JOIN t b ON a.tag = b.tag AND a.brand < b.brand GROUP BY 1, 2) SELECT * FROM (SELECT a, b, round(together / (x.n + y.n - together), 6) AS similarity FROM p JOIN n x ON x.brand = a JOIN n y ON y.brand = b) WHERE similarity > 0.5"),
    "g20d_lifestyles": (g20d_lifestyles, "SELECT tag, count(DISTINCT p_partkey) AS parts, count(DISTINCT p_brand) AS brands FROM (SELECT p_partkey, p_brand, unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1"),
    "g20d_connected": (g20d_connected, "SELECT c_custkey, count(o_orderkey) AS links FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "e12_topic_relevance": (e12_topic_relevance, E12_SQL),
    "e17_grades": (e17_grades, f"WITH n AS (SELECT city, state, kind, avg(price) AS price FROM {LISTED} GROUP BY ALL) SELECT n_nationkey, city, kind, CASE WHEN city = n_name THEN 3 ELSE 2 END AS geographic, CASE WHEN abs(price - n_nationkey * 4000) < 20000 THEN 3 WHEN abs(price - n_nationkey * 4000) < 60000 THEN 2 WHEN abs(price - n_nationkey * 4000) < 120000 THEN 1 ELSE 0 END AS proximity, CASE kind WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 1 ELSE 0 END AS category FROM n JOIN region ON r_name = state JOIN nation ON n_regionkey = r_regionkey"),
    "s1_json": (s1_json, "SELECT doc_id, lang, CAST(length(text) AS INT) AS chars, true AS named FROM documents"),
    "s2_hierarchy": (s2_hierarchy, "SELECT r_name AS state, n_name AS city, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "s5_folder": (s5_folder, "SELECT page_id, CAST(length(coalesce(html, '')) AS INT) AS chars FROM pages"),
    "s8_layer": (s8_layer, "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) AS rows_observed, count(*) - count(o_orderkey) AS null_keys FROM orders"),
    "d4_categories": (d4_categories, f"SELECT doc_id, {_D4} FROM (SELECT doc_id, list_sort(list_distinct({TOK})) AS w FROM documents)"),
    "f_band": (f_band, "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 25 THEN 'medium' WHEN p_size < 40 THEN 'large' ELSE 'huge' END AS size_band, count(*) AS n FROM part GROUP BY 1"),
}

"""The tables in the roles of listings, places, features, tags and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import table


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as listings, with their customer as place, nation as city and region as state."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("o_orderkey").alias("listing_id"), F.col("o_custkey").alias("place_id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("listed_on"), F.col("c_name").alias("place"), F.col("n_name").alias("city"), F.col("r_name").alias("state"),
    )


def feature_uses(spark: SparkSession, d: str) -> DataFrame:
    """``listing_id, feature``: the brand of each part of a listing, as often as it has it."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("listing_id"), F.col("p_brand").alias("feature"))


def listing_features(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (listing_id, feature): the brands of a listing's parts."""
    return feature_uses(spark, d).distinct()


def tagged_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.split("p_name", " ").alias("tags"))


#: Phrases that articles are described by, picked by their number.
PHRASES = (
    "A historic district near the coast", "Ski resort below the mountain", "School and education centre", "Tourist landmark of some company", "Busy commercial port with new transport",
    "Quiet residential park with a scenic view", "Spacious family home in a quiet neighborhood", "Art, culture and local geography",
)


def described_articles(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, title, summary, county, city, state``: documents with a summary of two phrases and a place that some lack, by their number."""
    i = F.col("doc_id")
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    return table(spark, d, "documents").select(
        "doc_id", "n_chars", F.split("text", "\n")[0].alias("title"), F.concat_ws(". ", pick(PHRASES, i % 8), pick(PHRASES, F.floor(i / 8) % 8)).alias("summary"),
        pick(("Summit County", None, None), i % 3).alias("county"), pick(("Park City", None), F.floor(i / 3) % 2).alias("city"), pick(("Utah", "California", "Nevada", None), i % 4).alias("state"),
    )

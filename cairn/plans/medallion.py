"""The layered pipeline: raw listings and articles, cleaned, then scored, with checks between the layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import checks, facets, scores
from cairn.plans.binding import listing_features, listings
from cairn.sources import sinks
from cairn.sources.tables import table


def bronze(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Raw tables as they are."""
    return {"listings": listings(spark, d), "features": listing_features(spark, d), "articles": table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")}


def listing_rules(least_price: float = 0.0) -> dict[str, Column]:
    """What a raw listing must keep to go on, by name."""
    return {"listing_id": F.col("listing_id").isNotNull(), "price": F.col("price") > least_price, "city": F.length("city") >= 2}


def rejected(raw: dict[str, DataFrame], least_price: float = 0.0) -> DataFrame:
    """Raw listings that break a rule, with the names of those as ``reasons``."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in listing_rules(least_price).items()]))
    return raw["listings"].withColumn("reasons", broken).where(F.size("reasons") > 0)


def silver(raw: dict[str, DataFrame], least_price: float = 0.0) -> dict[str, DataFrame]:
    """Valid rows with normalized names and ids."""
    ls = raw["listings"]
    for ok in listing_rules(least_price).values():
        ls = ls.where(ok)
    ls = ls.withColumns({"city_id": text.node_id("city", F.col("city"), F.col("state")), "state_code": text.state_code(F.col("state")), "listed_on": F.to_date("listed_on")})
    features = raw["features"].groupBy("listing_id").agg(F.array_sort(F.collect_set("feature")).alias("features"))
    articles = raw["articles"].where("doc_id IS NOT NULL").withColumn("confidence", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)))
    return {"listings": ls.join(features, "listing_id", "left"), "articles": articles}


def gold(clean: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Documents ready to search, with scores, tags and facets."""
    size = F.coalesce(F.size("features"), F.lit(0))
    size = F.when(F.col("features").isNull(), 0).otherwise(size)
    ls = clean["listings"].withColumns({"feature_count": size, "tags": scores.search_tags(F.lower("kind"), size, F.col("price")), "segment": facets.ladder(F.col("price"), (100_000, 200_000, 400_000), ("budget", "affordable", "premium", "luxury"))})
    quality = scores.article_quality(F.col("n_chars"), F.col("confidence"), F.lit(1))
    articles = clean["articles"].withColumns({"depth": scores.content_depth(F.col("n_chars")), "article_quality": F.round(quality, 6)})
    return {"listings": ls, "articles": articles.withColumn("rank_score", F.round(scores.ranking(F.col("article_quality"), F.col("confidence"), F.lit(0.4), F.lit(0.5)), 6))}


def run(spark: SparkSession, d: str, path: str, least_price: float = 0.0) -> dict[str, dict]:
    """Write all layers as Parquet under ``path``, and the listings that the silver layer rejects beside them; the counts observed for each table.

    Each layer is made from the written one before it, so a row that a layer loses shows in its counts: bronze listings are
    silver listings and rejected ones.
    """
    seen: dict[str, dict] = {}

    def written(layer: str, made: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in made.items():
            seen[f"{layer}/{name}"] = sinks.write_layer(df, f"{path}/{layer}/{name}")
        return {name: spark.read.schema(df.schema).parquet(f"{path}/{layer}/{name}") for name, df in made.items()}

    raw = written("bronze", bronze(spark, d))
    clean = written("silver", silver(raw, least_price))
    written("rejected", {"listings": rejected(raw, least_price)})
    written("gold", gold(clean))
    return seen


def checked(spark: SparkSession, d: str) -> DataFrame:
    """Rule failures of the silver listings."""
    return checks.rule_counts(silver(bronze(spark, d))["listings"], {"price": F.col("price").between(1, 10_000_000), "city": F.length("city") >= 2, "features": F.size("features") > 0})

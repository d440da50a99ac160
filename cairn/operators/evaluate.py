"""Retrieval quality from runs (query_id, doc_id, rank) and relevance grades (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """The measures of ``per_graded`` for a run and the grades of documents."""
    return per_graded(judged(run, qrels), qrels.groupBy("query_id", "grade").agg(F.count("*").alias("n")), k)


def per_graded(run: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """Precision, recall, F1 at ``k``, average precision, reciprocal rank and nDCG at ``k`` of each query of ``wanted``.

    ``run`` is (query_id, doc_id, rank, grade); ``wanted`` says how many documents of each grade a query has (query_id, grade, n), so
    that no list of relevant documents is needed. Precision divides by min(k, retrieved). The gain is the grade; ranks 1 and 2 are
    not discounted, rank r is by log2(r).
    """
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("grade") > 0).cast("int")
    j = run.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(seen))
    discount = lambda r: F.greatest(F.log2(r), F.lit(1.0))
    got = j.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), F.sum(F.when(F.col("rank") <= k, F.col("hit"))).alias("hits_k"),
        F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank"))).alias("precision_sum"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / discount(F.col("rank")))).alias("dcg"),
    )
    good = wanted.where("grade > 0 AND n > 0")
    first = good.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")))).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "copy")))
    ideal = first.where(F.col("r") <= k).groupBy("query_id").agg(F.sum(F.col("grade") / discount(F.col("r"))).alias("idcg"))
    want = good.groupBy("query_id").agg(F.sum("n").alias("relevant")).join(ideal, "query_id")
    both = wanted.select("query_id").distinct().join(want, "query_id", "left").join(got, "query_id", "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    both = both.withColumn("depth", F.least(F.lit(k), F.col("retrieved")))
    p, r = ratio("hits_k", "depth"), ratio("hits_k", "relevant")
    both = both.withColumns({"precision": p, "recall": r, "ap": ratio("precision_sum", "relevant"), "rr": F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), "ndcg": ratio("dcg", "idcg")})
    return both.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


MEASURES = ("precision", "recall", "f1", "ap", "rr", "ndcg")


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over queries, and precision and recall over all hits together."""
    means = [F.avg(m).alias(f"mean_{m}") for m in MEASURES]
    micro = [(F.sum("hits_k") / F.sum("depth")).alias("micro_precision"), (F.sum("hits_k") / F.sum("relevant")).alias("micro_recall")]
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("queries"), *means, *micro)


def ranked_models(results: DataFrame, measure: str) -> DataFrame:
    """``results(model, category, ...)`` with each model's rank inside its category."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc(measure), "model")))


def semantic_grades(concepts: DataFrame, articles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``query_id, doc_id, grade`` above 0: 3 where an article has two of the concept's related categories, 2 for one, else 1 where its text has the concept.

    ``concepts`` is (query_id, concept, related), ``articles`` (id, categories, words). Articles meet concepts on single words, each counted
    once; the words that are asked for are sent along and prune the rest before anything is grouped.
    """
    related = concepts.select("query_id", F.explode(F.array_distinct("related")).alias("word")).withColumn("is_category", F.lit(1))
    named = concepts.select("query_id", F.col("concept").alias("word")).where("word IS NOT NULL").withColumn("is_category", F.lit(0))
    have = lambda c, k: articles.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(c)).alias("word"), F.lit(k).alias("is_category"))
    met = have("categories", 1).unionByName(have("words", 0)).join(related.unionByName(named), ["word", "is_category"])
    found = met.groupBy("query_id", "doc_id").agg(F.sum("is_category").alias("n"))
    return found.select("query_id", "doc_id", F.when(F.col("n") >= 2, 3).when(F.col("n") == 1, 2).otherwise(1).alias("grade"))

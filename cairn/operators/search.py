"""Full-text ranking as DataFrame jobs: postings, BM25, phrases, fuzzy terms, highlights.

Queries are a table (query_id, text), so one job ranks many. Postings hold only the terms that some query asks for where
that is known: the query terms are joined to the exploded tokens before anything is grouped by document.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.stem import stem
from cairn.functions.text import folded, tokens

K1, B = 1.2, 0.75
#: Characters of all query terms up to which they are sent to every task; more are joined by shuffling.
SMALL_QUERIES = 4_000_000


def postings(docs: DataFrame, id_col: str, fields: Sequence[str], stop: Sequence[str] = ()) -> DataFrame:
    """``doc_id, field, term, tf, doc_len``. Stop words count neither as terms nor for the length."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), _without(tokens(F.col(f)), stop).alias("t")) for f in fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(parts)).withColumn("doc_len", F.size("t"))
    return rows.select("doc_id", "field", "doc_len", F.explode("t").alias("term")).groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"))


def analyzed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop: Sequence[str] = (), stemmed: bool = True) -> DataFrame:
    """``doc_id, term, tf``: lower-cased terms without accents and stop words, as stems.

    Each distinct term is folded and stemmed once, and the terms of documents take their stem from that table.
    """
    counted = docs.select(F.col(id_col).alias("doc_id"), F.explode(_without(tokens(F.col(text_col)), stop)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))
    words = counted.select("word").distinct().withColumn("plain", folded(F.col("word")))
    table = words.select("word", (stem(F.col("plain")) if stemmed else F.col("plain")).alias("term"))
    return counted.join(table, "word").groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def _without(words: Column, stop: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def query_terms(queries: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(_without(tokens(F.col("text")), stop))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", field: str = "text", stop: Sequence[str] = ()) -> DataFrame:
    """``query_id, doc_id, score, matched`` (distinct query terms in the document) for every pair with a common term."""
    return bm25_fields(docs, queries, [field], id_col, stop).drop("field")


def bm25_fields(docs: DataFrame, queries: DataFrame, fields: Sequence[str], id_col: str = "doc_id", stop: Sequence[str] = ()) -> DataFrame:
    """``query_id, doc_id, field, score, matched`` for every field of a document with a term of the query, in one pass over the documents.

    Each field has its own lengths and document frequencies.
    """
    parts = F.array(*[F.struct(F.lit(f).alias("field"), _without(tokens(F.col(f)), stop).alias("t")) for f in fields])
    made = docs.select(F.col(id_col).alias("doc_id"), F.inline(parts)).withColumn("doc_len", F.size("t"))
    corpus = made.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    asked = query_terms(queries, stop)
    size = asked.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    beside = F.broadcast if size <= SMALL_QUERIES else (lambda df: df)
    wanted = beside(asked.select("term").distinct())
    hits = made.select("doc_id", "field", "doc_len", F.explode("t").alias("term")).join(wanted, "term", "left_semi")
    # Postings lie by document, so that the scores of all queries are summed where they are.
    post = hits.repartition("doc_id").groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"), F.max("doc_len").alias("doc_len"))
    df = post.groupBy("term", "field").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = beside(asked.join(df, "term").join(F.broadcast(corpus), "field").withColumn("idf", idf))  # a row for each field
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    return post.join(weighed, ["term", "field"]).withColumn("part", part).groupBy("query_id", "doc_id", "field").agg(F.sum("part").alias("score"), F.count("*").alias("matched"))


def multi_match(docs: DataFrame, queries: DataFrame, fields: Mapping[str, float], mode: str = "best_fields", id_col: str = "doc_id") -> DataFrame:
    """BM25 per field times its boost; the best field counts, or with ``most_fields`` the sum."""
    boosts = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    each = bm25_fields(docs, queries, list(fields), id_col).withColumn("score", F.col("score") * boosts[F.col("field")])
    return each.groupBy("query_id", "doc_id").agg((F.max if mode == "best_fields" else F.sum)("score").alias("score"))


def need_terms(ranked: DataFrame, queries: DataFrame, least: int | None = None) -> DataFrame:
    """Hits with all query terms, or at least ``least`` of them."""
    n = query_terms(queries).groupBy("query_id").agg(F.count("*").alias("asked"))
    return ranked.join(n, "query_id").where(F.col("matched") >= (F.col("asked") if least is None else F.least(F.lit(least), F.col("asked")))).drop("asked")


def top(ranked: DataFrame, k: int, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The best ``k`` per query with ``rank``; ties go by key."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def has_phrase(text: Column, phrase: str) -> Column:
    words = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.contains(words, F.concat(F.lit(" "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" ")))


def fuzzy_terms(vocabulary: DataFrame, asked: DataFrame, prefix: int = 2) -> DataFrame:
    """``query_id, asked, term, edits``: vocabulary terms with the same prefix within 0, 1 or 2 edits, by length of the asked term.

    A term within d edits keeps one of d + 1 pieces of the other whole, at most d places away. Terms meet on a piece beside
    the prefix, the length and the number of the piece, so a common prefix is no hot key, and the distance is taken of what met.
    """
    allowed = F.when(F.length("asked") <= 2, 0).when(F.length("asked") <= 5, 1).otherwise(2)
    rest = lambda c: F.expr(f"substring({c}, {prefix + 1})")
    begin = lambda i, m, n: F.floor(i * m / n).cast("int")

    def explode_range(df: DataFrame, name: str, first, last) -> DataFrame:
        return df.withColumn(name, F.explode(F.sequence(first, last)))

    # Each term of the vocabulary in one, two and three pieces.
    v = vocabulary.select("term").distinct().withColumns({"p": F.substring("term", 1, prefix), "r": rest("term")}).withColumn("m", F.length("r"))
    v = explode_range(explode_range(v, "d", F.lit(0), F.lit(2)), "i", F.lit(0), F.col("d"))
    start, end = begin(F.col("i"), F.col("m"), F.col("d") + 1), begin(F.col("i") + 1, F.col("m"), F.col("d") + 1)
    v = v.select("term", "p", "d", "m", "i", F.substring(F.col("r"), start + 1, end - start).alias("piece"))
    # What an asked term has near the place of each piece, for each length that its terms can have.
    a = asked.select("query_id", F.col("term").alias("asked")).withColumns({"d": allowed, "p": F.substring("asked", 1, prefix), "r": rest("asked")})
    a = explode_range(a, "m", F.greatest(F.length("r") - F.col("d"), F.lit(0)), F.length("r") + F.col("d"))
    a = explode_range(explode_range(a, "i", F.lit(0), F.col("d")), "shift", -F.col("d"), F.col("d"))
    at = begin(F.col("i"), F.col("m"), F.col("d") + 1) + F.col("shift")
    long = begin(F.col("i") + 1, F.col("m"), F.col("d") + 1) - begin(F.col("i"), F.col("m"), F.col("d") + 1)
    keys = a.where((at >= 0) & (at + long <= F.length("r"))).select("query_id", "asked", "p", "d", "m", "i", F.substring(F.col("r"), at + 1, long).alias("piece")).distinct()
    met = keys.join(v, ["p", "d", "m", "i", "piece"]).select("query_id", "asked", "d", "term").distinct().withColumn("edits", F.levenshtein("asked", "term"))
    return met.where(F.col("edits") <= F.col("d")).drop("d")


def highlight(text: Column, word: str, around: int = 60, most: int = 3) -> Column:
    """Up to ``most`` fragments around the word, the word in <em> tags."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is).{{0,{around}}}\b{word}\b.{{0,{around}}}"), F.lit(0))
    return F.transform(F.slice(found, 1, most), lambda x: F.regexp_replace(x, rf"(?i)\b({word})\b", "<em>$1</em>"))

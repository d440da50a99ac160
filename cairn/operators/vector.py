"""Exact vector search. Norms are taken once; a query set meets the corpus in blocks, and each block keeps its own best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.vectors import cosine_normed, norm

#: Bytes of the corpus, as doubles, that a task holds.
HELD = 64_000_000


def nearest(corpus: DataFrame, vector: list[float], k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", where: Column | None = None, least: float | None = None) -> DataFrame:
    """``id, score``: the ``k`` most alike rows by cosine. ``where`` filters before scoring."""
    rows = corpus if where is None else corpus.where(where)
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = rows.select(F.col(id_col).alias("id"), cosine_normed(F.col(vec_col), norm(F.col(vec_col)), q, F.lit(float(np.linalg.norm(vector)))).alias("score"))
    return (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.desc("score"), "id").limit(k)


def block_pairs(queries: DataFrame, corpus: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """``i, qv, ci, cv``: each pair of a block of queries and a block of the corpus, about ``block`` rows each, dealt by hash."""
    spark = corpus.sparkSession
    nq, nc = max(1, -(-queries.count() // block)), max(1, -(-corpus.count() // block))

    def packed(df: DataFrame, n: int, name: str) -> DataFrame:
        dealt = df.select(F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias(f"{name}b"), F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<float>").alias("v"))
        return dealt.groupBy(f"{name}b").agg(F.collect_list(F.struct("i", "v")).alias(name))  # about ``block`` rows each

    pairs = spark.range(nq * nc).select((F.col("id") % nq).cast("int").alias("qb"), F.floor(F.col("id") / nq).cast("int").alias("cb"))
    return pairs.join(packed(queries, nq, "q"), "qb").join(packed(corpus, nc, "c"), "cb").select("q.i", F.col("q.v").alias("qv"), F.col("c.i").alias("ci"), F.col("c.v").alias("cv"))


def block_scores(row, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of both blocks and their cosines; with ``same`` a row's own is minus infinity."""
    a, b = (np.array([list(x) for x in m], np.float64) for m in (row.qv, row.cv))
    na, nb = np.linalg.norm(a, axis=1, keepdims=True), np.linalg.norm(b, axis=1, keepdims=True)
    score = (a / np.where(na == 0, 1, na)) @ (b / np.where(nb == 0, 1, nb)).T
    qi, ci = np.array(row.i), np.array(row.ci)
    if same:
        score[qi[:, None] == ci[None, :]] = -np.inf
    return qi, ci, score


def pairs_reaching(queries: DataFrame, corpus: DataFrame, cuts: list[float], *, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 2000, same: bool = False) -> DataFrame:
    """``cut, pairs``: how many pairs of the query set and the corpus reach each threshold, counted inside the blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                score = np.round(block_scores(row, same)[2], 9)
                yield pd.DataFrame({"cut": cuts, "pairs": [int((score >= c).sum()) for c in cuts]})

    return block_pairs(queries, corpus, id_col, vec_col, block).mapInPandas(run, "cut double, pairs long").groupBy("cut").agg(F.sum("pairs").alias("pairs"))


def parts_for(rows: int, dims: int, cores: int) -> int:
    """Parts that a task can hold as doubles, and enough of them for the cores."""
    return max(1, -(-rows * max(1, dims) * 8 // HELD), min(2 * cores, -(-rows // 2000)))


def unit_rows(x: np.ndarray, whole: bool) -> np.ndarray:
    """Rows of length 1, zero rows as they are; ``whole`` adds two columns that make products 1 - distance^2 / 2, also for zero rows."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    return np.hstack([u, np.where(n == 0, 0.5, 0.0), np.ones_like(n)]) if whole else u


def best_rows(q: np.ndarray, qi: np.ndarray, c: np.ndarray, ci: np.ndarray, k: int, same: bool, qs: np.ndarray | None = None, cs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``c`` and product of the ``k`` best of each row of ``q``: by the product to nine decimals, then by place in ``c``.

    ``same`` leaves out equal ids, and rows meet only if they agree in some column of ``qs`` and ``cs`` where these are given.
    A tile passes on what is above the k best before it, so few of its products are sorted.
    """
    r, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    least = np.full(len(q), -np.inf)
    lo, wide = 0, 1024
    while lo < len(c):
        hi = min(len(c), lo + wide)
        made = q @ c[lo:hi].T
        if np.isneginf(least).any():  # less than k so far
            made[np.isnan(made)] = -np.inf
            if same:
                made[qi[:, None] == ci[None, lo:hi]] = -np.inf
            if qs is not None:
                made[~(qs[:, None, :] == cs[None, lo:hi]).any(2)] = -np.inf
            kth = np.partition(made, hi - lo - k, axis=1)[:, hi - lo - k] if hi - lo > k else np.full(len(q), -np.inf)
            row, col = np.nonzero((made >= kth[:, None] - 2e-9) & (made > -np.inf))
        else:
            row, col = np.nonzero(made > (least[:, None] + 0.5) * 1e-9 - 1e-15)
        good = np.ones(len(row), bool)
        if same:
            good &= qi[row] != ci[lo + col]
        if qs is not None:
            good &= (qs[row] == cs[lo + col]).any(1)
        if good.any():
            row, col = row[good], col[good]
            r, at, score = np.concatenate([r, row]), np.concatenate([at, lo + col]), np.concatenate([score, made[row, col]])
            order = np.lexsort((at, -np.round(score, 9), r))
            r, at, score = r[order], at[order], score[order]
            turn = np.arange(len(r)) - np.searchsorted(r, r)
            r, at, score, turn = (x[turn < k] for x in (r, at, score, turn))
            full = turn == k - 1
            least[r[full]] = np.rint(score[full] * 1e9)
        lo, wide = hi, 8192
    return r, at, score


def best_in_parts(queries: DataFrame, corpus: DataFrame, parts: int, k: int, *, same: bool, distance: bool = False) -> DataFrame:
    """``query_id, id, score``: of each part that a query is dealt to, its ``k`` best rows there. Both have ``part, i, v`` and both or neither ``marks``.

    A task holds the rows of its part of the corpus and streams the queries dealt to it, so vectors of the corpus are
    shuffled once and queries once for each part. With ``marks`` (lists of numbers) rows meet only if they agree in a place.
    """
    kinds = {str(df.schema["v"].dataType.elementType.typeName()) for df in (queries, corpus)}
    kind = "array<float>" if kinds == {"float"} else "array<double>"
    names = ["part", "asks", "i", "v", *(["marks"] if "marks" in corpus.columns else [])]
    shaped = [df.where(F.col("v").isNotNull()).withColumns({"asks": F.lit(asks), "part": F.col("part").cast("int"), "i": F.col("i").cast("long"), "v": F.col("v").cast(kind)}).select(*names) for df, asks in ((corpus, False), (queries, True))]
    dealt = shaped[0].union(shaped[1]).repartitionById(parts, F.col("part")).sortWithinPartitions("asks")

    def matrix(column: pa.Array, rows: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        ready = None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            for flag in (False, True):
                if not (asks == flag).any():
                    continue
                rows = batch.filter(pa.array(asks == flag))
                i, v = rows.column("i").to_numpy(), unit_rows(matrix(rows.column("v"), rows.num_rows), distance)
                marks = matrix(rows.column("marks"), rows.num_rows) if "marks" in names else None
                if not flag:
                    held.append((i, v, marks))
                    continue
                if ready is None and held:
                    ci = np.concatenate([h[0] for h in held])
                    order = np.argsort(ci, kind="stable")
                    ready = ci[order], np.concatenate([h[1] for h in held])[order], None if marks is None else np.concatenate([h[2] for h in held])[order]
                    held.clear()
                    if distance:
                        ready[1][:, [-2, -1]] = ready[1][:, [-1, -2]]
                if ready is None:
                    continue
                ci, c, cs = ready
                for lo in range(0, len(i), 256):
                    row, at, score = best_rows(v[lo : lo + 256], i[lo : lo + 256], c, ci, k, same, None if marks is None else marks[lo : lo + 256], cs)
                    yield pa.RecordBatch.from_arrays([pa.array(i[lo + row]), pa.array(ci[at]), pa.array(score)], ["query_id", "id", "score"])

    return dealt.mapInArrow(run, "query_id long, id long, score double")


def ranked(best: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return best.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def nearest_join(queries: DataFrame, corpus: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", same: bool = False, marks: str | None = None, distance: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: for each query its ``k`` nearest rows of the corpus by cosine.

    The corpus is dealt into parts by hash and every query meets every part; each part returns ``k`` rows per query, and a
    window takes the best of those. The work is queries times corpus, in pieces of bounded size, for a stated query set
    against all rows. ``same`` leaves out a row as its own neighbour, ``marks`` names a list of numbers of which rows have
    to share one to meet, and ``distance`` gives 1 - distance^2 / 2 of the unit vectors, which differs for zero ones.
    """
    spark = corpus.sparkSession
    rows, dims = corpus.agg(F.count("*"), F.max(F.size(vec_col))).first()
    parts = parts_for(rows, dims or 1, spark.sparkContext.defaultParallelism)
    more = [F.col(marks).alias("marks")] if marks else []
    c = corpus.select(F.pmod(F.xxhash64(id_col), F.lit(parts)).alias("part"), F.col(id_col).alias("i"), F.col(vec_col).alias("v"), *more)
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col(id_col).alias("i"), F.col(vec_col).alias("v"), *more)
    return ranked(best_in_parts(q, c, parts, k, same=same, distance=distance), k)


def inverted_file(corpus: DataFrame, path: str, *, id_col: str = "vec_id", vec_col: str = "embedding", cells: int = 16, sample: int = 20_000, block: int = 2000, seed: int = 7) -> DataFrame:
    """Write ``corpus`` by its nearest of ``cells`` centroids under ``path`` and return ``cell, centre, rows, blocks``.

    Centroids are fitted on at most about ``sample`` rows, by a hash of the id; every row is indexed. A cell is cut into
    blocks of about ``block`` rows by a hash, so that a crowded cell is no hot key; vectors are kept as they came. Zero vectors go to the first cell; null vectors are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    unit = rows.withColumn("u", F.when(norm(F.col("v")) > 0, F.transform("v", lambda x: x.cast("double") / norm(F.col("v")))).otherwise(F.col("v").cast("array<double>")))
    share = min(1.0, sample / max(1, unit.count()))
    drawn = unit.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(array_to_vector("u").alias("features"))
    centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=15).fit(drawn).clusterCenters()]
    table = np.array(centres)

    @F.pandas_udf("int")
    def nearest_cell(batch: pd.Series) -> pd.Series:
        x = np.array([list(v) for v in batch]).reshape(len(batch), -1)
        return pd.Series(((x[:, None, :] - table[None]) ** 2).sum(2).argmin(1).astype(np.int32))

    placed = unit.withColumn("cell", nearest_cell("u"))
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # one row for each cell
    blocks = {c: max(1, -(-n // block)) for c, n in sizes.items()}
    many = F.create_map(*[F.lit(x) for kv in (blocks or {0: 1}).items() for x in kv])
    laid = placed.withColumn("block", F.pmod(F.xxhash64("id"), many[F.col("cell")]).cast("int")).select("id", "v", "block", "cell")
    laid.repartition("cell", "block").write.mode("overwrite").partitionBy("cell").parquet(path)
    return corpus.sparkSession.createDataFrame([(c, centres[c], n, blocks[c]) for c, n in sizes.items()], "cell int, centre array<double>, rows long, blocks int")


def probe(queries: DataFrame, path: str, cells: DataFrame, k: int, num_candidates: int, *, id_col: str = "vec_id", vec_col: str = "embedding", same: bool = False) -> DataFrame:
    """``query_id, id, score, rank``: of each query the ``k`` best among the rows of its nearest cells, as many cells as have ``num_candidates`` rows.

    Only folders of probed cells are read. ``same`` leaves out a row as its own neighbour.
    """
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("v")).withColumn("n", norm(F.col("v")))
    unit = q.withColumn("u", F.when(F.col("n") > 0, F.transform("v", lambda x: x.cast("double") / F.col("n"))).otherwise(F.col("v").cast("array<double>"))).select("query_id", "v", "u")
    away = F.aggregate(F.zip_with("u", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = Window.partitionBy("query_id").orderBy("away", "cell")
    met = unit.join(F.broadcast(cells)).select("query_id", "cell", "rows", away.alias("away"))  # a row for each cell
    before = F.coalesce(F.sum("rows").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    probed = met.withColumn("before", before).where(F.col("before") < num_candidates).select("query_id", "cell")
    used = sorted(r.cell for r in probed.select("cell").distinct().collect())
    stored, cores = queries.sparkSession.read.parquet(path), queries.sparkSession.sparkContext.defaultParallelism
    dims = max([len(r.centre) for r in cells.select("centre").limit(1).collect()], default=1)
    rows = {r.cell: r["rows"] for r in cells.select("cell", "rows").collect()}  # one for each cell
    share = {c: max(1, -(-2 * cores * rows[c] // max(1, sum(rows.values())))) for c in used}
    many = {c: max(min(share[c], parts_for(rows[c], dims, cores)), parts_for(rows[c], dims, 0)) for c in used}
    first = {c: sum(many[x] for x in used if x < c) for c in used}
    of = lambda m: F.create_map(*[F.lit(x) for kv in (m or {0: 1}).items() for x in kv])[F.col("cell")]
    index = stored.where(F.col("cell").isin(used)).select((of(first) + F.pmod(F.xxhash64("id"), of(many).cast("long"))).alias("part"), F.col("id").alias("i"), "v")
    asked = probed.join(unit.select("query_id", "v"), "query_id").select(F.explode(F.sequence(of(first), of(first) + of(many) - 1)).alias("part"), F.col("query_id").alias("i"), "v")
    return ranked(best_in_parts(asked, index, max(1, sum(many.values())), k, same=same), k)


def similar_edges(neighbours: DataFrame, least: float) -> DataFrame:
    """Undirected edges ``a < b`` of a neighbour table."""
    return neighbours.where(F.col("score") >= least).select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def fuse(ranked: dict[str, DataFrame], constant: int = 60, window: int = 100, size: int = 10) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, doc_id, rank): score = sum of 1 / (constant + rank)."""
    lists = None
    for df in ranked.values():
        one = df.where(F.col("rank") <= window).select("query_id", "doc_id", (1.0 / (F.lit(constant) + F.col("rank"))).alias("part"))
        lists = one if lists is None else lists.unionByName(one)
    score = lists.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 12).alias("score"))
    turn = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return score.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= size)


def embed(docs: DataFrame, text_col: str, dims: int = 64) -> DataFrame:
    """``docs`` with a unit vector of hashed token counts: the offline default of the pluggable ``embed_with``."""
    from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims)
    made = Normalizer(inputCol="_tf", outputCol="_n").transform(tf.transform(Tokenizer(inputCol=text_col, outputCol="_w").transform(docs)))
    return made.withColumn("embedding", vector_to_array("_n", "float32")).drop("_w", "_tf", "_n")


def embed_with(docs: DataFrame, text_col: str, model) -> DataFrame:
    """``docs`` with ``embedding`` from ``model(list of texts) -> list of vectors``, called on Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.asarray(v, np.float32) for v in model(texts.fillna("").tolist())])

    return docs.withColumn("embedding", run(F.col(text_col)))

"""Splitting documents into chunks and putting them together again."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """Chunks of ``size`` words, each ``overlap`` words into the one before. A text without words has none."""
    step = size - overlap
    words = docs.select(F.col(id_col), F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))
    parts = words.select(id_col, F.posexplode(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, size), " "))).alias("chunk_index", "chunk"), F.size(starts).alias("chunk_total"))
    return with_hashes(parts, id_col)


def with_hashes(chunks: DataFrame, id_col: str) -> DataFrame:
    """Text hash, and the id's hash as parent where a document has several chunks."""
    return chunks.withColumns({"text_hash": F.sha2("chunk", 256), "parent_hash": F.when(F.col("chunk_total") > 1, F.md5(F.col(id_col).cast("string").cast("binary")))})


def by_sentences(docs: DataFrame, id_col: str, text_col: str, most_words: int) -> DataFrame:
    """Whole sentences packed greedily up to ``most_words``; a longer sentence is a chunk of its own."""
    sentences = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    counted = F.transform(sentences, lambda x: F.struct(x.alias("s"), F.size(F.split(F.trim(x), r"\s+")).alias("n")))

    def pack(state, x):
        opened = (state["n"] == 0) | (state["n"] + x["n"] > most_words)
        grown = F.concat(F.slice(state["parts"], 1, F.size(state["parts"]) - 1), F.array(F.concat(F.element_at(state["parts"], -1), F.lit(" "), x["s"])))
        return F.struct(F.when(opened, F.concat(state["parts"], F.array(x["s"]))).otherwise(grown).alias("parts"), F.when(opened, x["n"]).otherwise(state["n"] + x["n"]).alias("n"))

    packed = F.aggregate(counted, F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("n")), pack)["parts"]
    parts = docs.select(id_col, packed.alias("p")).select(id_col, F.posexplode("p").alias("chunk_index", "chunk"), F.size("p").alias("chunk_total"))
    return with_hashes(parts, id_col)


def sentence_gaps(sentences: list[list[str]], buffer: int, dims: int = 64) -> list[np.ndarray]:
    """Of each text the cosine distances of neighbouring sentences, each taken with ``buffer`` sentences before and after it; words count by their hash."""
    known: dict[str, int] = {}
    words = [s.lower().split() for text in sentences for s in text]
    flat = [known.setdefault(w, len(known)) for s in words for w in s]
    home = np.array([zlib.crc32(w.encode()) % dims for w in known], np.int64)
    row = np.repeat(np.arange(len(words)), [len(s) for s in words])
    v = np.bincount(row * dims + home[np.array(flat, np.int64)], minlength=len(words) * dims).reshape(-1, dims).astype(np.float64) if flat else np.zeros((len(words), dims))
    total = np.concatenate([np.zeros((1, dims)), np.cumsum(v, 0)])
    sizes = np.array([len(text) for text in sentences], np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    begin, at = end - np.repeat(sizes, sizes), np.arange(len(words))
    near = total[np.minimum(at + buffer + 1, end)] - total[np.maximum(at - buffer, begin)]
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    gap = 1 - (near[1:] * near[:-1]).sum(1)
    return [gap[e - n : e - 1] for n, e in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]


def by_distance(docs: DataFrame, id_col: str, text_col: str, percentile: float = 0.9, buffer: int = 1) -> DataFrame:
    """Semantic chunks: a break where neighbouring sentences, each with ``buffer`` more on both sides, are further apart than the document's percentile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [[s for s in re.split(r"(?<=[.!?])\s+", t or "") if s.strip()] for t in batch[text_col]]
            rows = []
            for key, parts, gap in zip(batch[id_col], texts, sentence_gaps(texts, buffer), strict=True):
                first = [0, *(np.flatnonzero(gap > np.quantile(gap, percentile)) + 1).tolist()] if len(gap) else [0] * bool(parts)
                rows += [(key, i, " ".join(parts[a:b]), len(first)) for i, (a, b) in enumerate(zip(first, [*first[1:], len(parts)], strict=False))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "chunk", "chunk_total"])

    kind = docs.schema[id_col].dataType.simpleString()
    return with_hashes(docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, chunk_index int, chunk string, chunk_total int"), id_col)


def joined(chunks: DataFrame, parent: str, index: str, text: str) -> DataFrame:
    """The texts of each parent in order, whether all indices from 0 are there, and which are missing."""
    g = chunks.groupBy(parent).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))).alias("c"), F.max(index).alias("last"))
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long")), F.transform("c", lambda x: x["i"].cast("long")))
    return g.select(parent, F.array_join(F.transform("c", lambda x: x["t"]), " ").alias("text"), (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


def linked(chunks: DataFrame, parent: str, index: str) -> DataFrame:
    """Each chunk with the index before and after it."""
    w = Window.partitionBy(parent).orderBy(index)
    return chunks.withColumns({"previous": F.lag(index).over(w), "following": F.lead(index).over(w)})

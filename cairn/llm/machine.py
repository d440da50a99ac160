"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata, trained in numpy.

A text is a sparse vector: each distinct word's bucket with its damped count, words together of length 1, and one bin of each
statistic and metadata column with value 1. Every feature has a weight and a short vector; pairs of features count by the
product of their vectors. The sum over all pairs is half of (the squared sum of the vectors less the sum of their squares), so
that a text is scored in time linear in its distinct words.

Statistics cover the whole text: words and lines and how long they are, shares of upper-case words, symbols, digits, sentence
ends and exclamations, of distinct words, of words that repeat the one before, and of lines that occurred before. Their bins are the
quantiles of the training rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, load, unused
from .pieces import slices

BUCKETS, FACTORS, BINS = 1 << 15, 8, 16
SYMBOL = re.compile(r"[#*$%&|<>~^=_{}\[\]\\/@+]")
STATISTICS = ("words", "word_length", "upper", "with_symbol", "symbols", "digits", "ends", "exclaims", "distinct", "repeats", "lines", "same_lines")
#: What is kept of a word: length, upper case, has a symbol, symbols, has a digit, ends a sentence, exclaims.
WORD_FACTS = 7


class Words:
    """Buckets and facts of words, each looked at once while the table is below its bound."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.bucket, self.facts = np.zeros(0, np.int64), np.zeros((0, WORD_FACTS), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.most:
            self.clear()
        out = list(map(self.index.get, words))
        if None in out:
            new = sorted(set(words).difference(self.index))
            self.index |= {w: len(self.index) + k for k, w in enumerate(new)}
            self.bucket = np.concatenate([self.bucket, np.array([zlib.crc32(w.strip("*#$%&|<>!?.,;:\"'()").lower().encode("utf-8", "replace")) % BUCKETS for w in new], np.int64)])
            facts = [(len(w), len(w) > 1 and w.isupper(), n > 0, n, any(map(str.isdigit, w)), w[-1] in ".!?。…", w[-1] == "!") for w in new for n in (len(SYMBOL.findall(w)),)]
            self.facts = np.concatenate([self.facts, np.array(facts, np.float32).reshape(-1, WORD_FACTS)])
            out = list(map(self.index.__getitem__, words))
        return np.array(out, np.int64)


@cache
def words_table() -> Words:
    """One for each Python worker."""
    return Words()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: (text, bucket, count) of each distinct bucket, by text, and the statistics (texts, STATISTICS)."""
    table, n = words_table(), len(texts)
    cut = [(t or "").split() for t in texts]
    lines = [[x for x in (t or "").split("\n") if x and not x.isspace()] for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    ids = table.ids([w for c in cut for w in c])
    doc = np.repeat(np.arange(n), sizes)
    key, count = np.unique(doc * BUCKETS + table.bucket[ids], return_counts=True)
    owner, bucket = np.divmod(key, BUCKETS)
    many = np.maximum(sizes, 1)
    total = np.stack([np.bincount(doc, table.facts[ids, k], n) for k in range(WORD_FACTS)], 1)
    again = np.bincount(doc[1:][(ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    rows = np.array([len(x) for x in lines], np.int64)
    same = rows - np.array([len(set(x)) for x in lines], np.int64)
    made = {
        "words": np.log1p(sizes), "word_length": total[:, 0] / many, "upper": total[:, 1] / many, "with_symbol": total[:, 2] / many, "symbols": total[:, 3] / np.maximum(total[:, 0], 1),
        "digits": total[:, 4] / many, "ends": total[:, 5] / many, "exclaims": total[:, 6] / many, "distinct": np.bincount(owner, minlength=n) / many, "repeats": again / many,
        "lines": np.log1p(rows), "same_lines": same / np.maximum(rows, 1),
    }
    return owner, bucket, count, np.stack([made[s] for s in STATISTICS], 1)


@dataclass
class Machine:
    """Bias, weights and vectors of all features, and the edges of the bins."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    edges: list[np.ndarray]

    def logits(self, owner: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """For sparse rows in order of ``owner``: bias, weights, and all pairs by the difference of squares."""
        out = self.bias + np.bincount(owner, self.weights[index] * value, n)
        part = self.vectors[index] * value[:, None]
        for f in range(FACTORS):
            out += 0.5 * (np.bincount(owner, part[:, f], n) ** 2 - np.bincount(owner, part[:, f] ** 2, n))
        return out


def sparse(owner: np.ndarray, bucket: np.ndarray, count: np.ndarray, numbers: np.ndarray, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as (row, feature, value): words of damped count and joint length 1, and the bin of each number (a missing one has the last)."""
    n, damped = len(numbers), 1 + np.log(count)
    value = damped / np.sqrt(np.maximum(np.bincount(owner, damped**2, n), 1e-9))[owner]
    columns = [BUCKETS + k * (BINS + 1) + np.where(np.isnan(x), BINS, np.searchsorted(edges[k], np.nan_to_num(x))) for k, x in enumerate(numbers.T)]
    owner = np.concatenate([owner, np.tile(np.arange(n), len(columns))])
    order = np.argsort(owner, kind="stable")
    return owner[order], np.concatenate([bucket, *columns])[order].astype(np.int64), np.concatenate([value, np.ones(n * len(columns))])[order]


def gradients(m: Machine, owner: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of the weighted mean logistic loss: by bias, and by weight and vector of the features named by the second result."""
    p = 1 / (1 + np.exp(-np.clip(m.logits(owner, index, value, len(y)), -30, 30)))
    g = (p - y) * weight / weight.sum()
    part = m.vectors[index] * value[:, None]
    total = np.stack([np.bincount(owner, part[:, f], len(y)) for f in range(FACTORS)], 1)
    gw = g[owner] * value
    gv = gw[:, None] * (total[owner] - part)
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], index[order][1:] != index[order][:-1]]))
    return float(g.sum()), index[order][first], np.add.reduceat(gw[order], first), np.add.reduceat(gv[order], first)


def descend(owner: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, edges: list[np.ndarray], *, rounds: int = 14, rate: float = 0.08, shrink: float = 1e-4, seed: int = 5) -> Machine:
    """Fit by steps that shrink with each feature's past gradients."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + len(edges) * (BINS + 1)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), edges)
    past_b, past_w, past_v = 1e-3, np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    weight = np.where(y > 0, 1.0, np.sqrt((y > 0).sum() / max(1, (y == 0).sum())))
    begin = np.searchsorted(owner, np.arange(len(y) + 1))
    for _ in range(rounds):
        turn = rng.permutation(len(y))
        for a in range(0, len(turn), 64):
            rows = turn[a : a + 64]
            sizes = begin[rows + 1] - begin[rows]
            at = np.repeat(begin[rows], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gb, k, gw, gv = gradients(m, np.repeat(np.arange(len(rows)), sizes), index[at], value[at], y[rows], weight[rows])
            gw, gv = gw + shrink * m.weights[k], gv + shrink * m.vectors[k]
            past_b += gb * gb
            past_w[k] += gw * gw
            past_v[k] += gv * gv
            m.bias -= rate * gb / np.sqrt(past_b)
            m.weights[k] -= rate * gw / np.sqrt(past_w[k])
            m.vectors[k] -= rate * gv / np.sqrt(past_v[k])
    return m


def quantiles(numbers: np.ndarray) -> list[np.ndarray]:
    """At most BINS - 1 different edges of each column."""
    some = [c[~np.isnan(c)] for c in numbers.T]
    return [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in some]


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The cut with the most evenly right labels, midway in the widest gap among equally good ones."""
    order = np.argsort(logits)
    s, label = logits[order], y[order]
    good = np.cumsum(label == 0)[:-1] / (label == 0).sum() + (label > 0)[::-1].cumsum()[::-1][1:] / (label > 0).sum()
    best = np.flatnonzero(good >= good.max() - 1e-9)
    i = best[np.argmax((s[1:] - s[:-1])[best])]
    return float((s[i] + s[i + 1]) / 2)


def train(owner: np.ndarray, bucket: np.ndarray, count: np.ndarray, numbers: np.ndarray, y: np.ndarray, *, cut_score: float = 0.3) -> Machine:
    """Fit on rows in memory. A machine of four fifths of them finds the cut on the rest, which then scores ``cut_score``."""
    edges = quantiles(numbers)
    rows = sparse(owner, bucket, count, numbers, edges)
    if not len(y) or y.min() == y.max():
        m = Machine(0.0, np.zeros(BUCKETS + len(edges) * (BINS + 1)), np.zeros((BUCKETS + len(edges) * (BINS + 1), FACTORS)), edges)
        m.bias = 5.0 if not len(y) or y.max() > 0 else -5.0
        return m
    machine = descend(*rows, y, edges)
    aside = np.arange(len(y)) % 5 == 0
    if min(*np.bincount(y[aside] > 0, minlength=2), *np.bincount(y[~aside] > 0, minlength=2)) > 0:
        number = np.cumsum(~aside) - 1
        use = ~aside[rows[0]]
        other = descend(number[rows[0][use]], rows[1][use], rows[2][use], y[~aside], edges)
        number = np.cumsum(aside) - 1
        cut = best_cut(other.logits(number[rows[0][~use]], rows[1][~use], rows[2][~use], int(aside.sum())), y[aside])
    else:
        cut = best_cut(machine.logits(*rows, len(y)), y)
    machine.bias += float(np.log(cut_score / (1 - cut_score)) - cut)
    return machine


def numbers_of(docs: DataFrame, columns: tuple[str, ...]):
    """Metadata as one array column, null where the value is."""
    return F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", metadata: tuple[str, ...] = ("n_chars",), max_rows: int = 4000, cut_score: float = 0.3) -> Machine:
    """Train on at most ``max_rows`` labelled rows, half of each label, by a hash of the id.

    Features are made by the workers, of whole texts of any length; the driver gets those of the sampled rows only, at
    most 2**15 distinct buckets a row. Rows without label are left out; null texts count as empty; with one label only every
    text gets the same score.
    """

    @F.arrow_udf("struct<buckets: array<int>, counts: array<int>, statistics: array<double>>")
    def make(texts: pa.Array) -> pa.Array:
        parts = []
        for part in slices(texts):
            owner, bucket, count, stats = features(part)
            edges = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1], dtype=np.int32)), pa.array(stats.ravel()))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (bucket, count)]
            parts.append(pa.StructArray.from_arrays([*lists, rows], ["buckets", "counts", "statistics"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("statistics", pa.list_(pa.float64()))]))

    rows = labelled.where(F.col(label_col).isNotNull()).select(
        F.xxhash64(F.col(id_col).cast("string"), F.lit(1)).alias("h"), (F.col(label_col) > 0).cast("int").alias("y"), numbers_of(labelled, metadata).alias("metadata"), make(F.coalesce(text_col, F.lit(""))).alias("made")
    )
    drawn = bounded_sample(rows, "h", max_rows, by="y")
    drawn.sort(key=lambda r: (r.h, r.y))
    y = np.array([r.y for r in drawn], np.float64)
    lists = [np.array([x for r in drawn for x in r.made[k]], np.int64) for k in ("buckets", "counts")]
    owner = np.repeat(np.arange(len(drawn)), [len(r.made.buckets) for r in drawn])
    numbers = np.array([[*r.made.statistics, *[np.nan if x is None else x for x in r.metadata]] for r in drawn], np.float64).reshape(len(drawn), len(STATISTICS) + len(metadata))
    return train(owner, *lists, numbers, y, cut_score=cut_score)


def score_quality(docs: DataFrame, machine: Machine, *, text_col: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """``docs`` with ``quality_score``, 0 to 1. Every text is read whole; null counts as empty, and empty texts get the score of their
    statistics. Missing metadata has a bin of its own. Repeated rows get equal scores, an empty table stays empty; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def run(texts: pa.Array, given: pa.Array) -> pa.Array:
        m, begin, out = shared.value, 0, []
        extra = given.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(texts), -1)
        for part in slices(texts):
            owner, bucket, count, stats = features(part)
            numbers = np.concatenate([stats, extra[begin : begin + len(part)]], 1)
            logit = m.logits(*sparse(owner, bucket, count, numbers, m.edges), len(part))
            out.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            begin += len(part)
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    text, numbers = unused(docs, "text"), unused(docs, "numbers")
    made = docs.withColumns({text: F.coalesce(text_col, F.lit("")), numbers: numbers_of(docs, metadata)})
    return made.withColumn("quality_score", run(text, numbers)).drop(text, numbers)


def op12_quality_machine(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    machine = fit(docs.where(fold("doc_id", 5) != 0).join(labels, "doc_id"))
    out = score_quality(docs, machine)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))

"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as what its spelling and itself said about the training labels (smoothed log-odds of the word and of its character
n-grams) beside learned embeddings of the word and of its n-grams. The network reads windows of words in both directions,
pools its states by attention and gives each window a score. A text's score is that of its worst window; windows overlap by
half and cover the whole text.

Training learns from document labels: in each round the window of a document that now scores highest stands for it, and for
clean documents a random one too. While training, a document's own words are left out of its log-odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, fold, load, text_of

WORDS = re.compile(r"\w+")
WINDOW, STRIDE = 32, 16
HIDDEN, LEARNED, GIVEN = 8, 4, 4
WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 18
GRAM_SIZES = (3, 4, 5, 6)
U = np.uint64


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; n-gram buckets with the index of their word, sorted by word."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    begin = np.cumsum(sizes) - sizes
    whole = np.zeros(len(words), np.uint64)
    grams, owners, h = [], [], np.zeros(len(codes), np.uint64)
    place = (np.arange(len(codes)) - begin[owner]).astype(np.uint64)
    np.add.at(whole, owner, spread((codes + U(1)) * U(0x9E3779B97F4A7C15) + place * U(0xD1342543DE82EF95)))
    for n in range(1, max(GRAM_SIZES) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * U(0x9E3779B97F4A7C15) + codes[n - 1 :] + U(n)
        if n in GRAM_SIZES:
            inside = owner[:m] == owner[n - 1 :]
            grams.append((spread(h[inside]) % U(GRAM_BUCKETS)).astype(np.int32))
            owners.append(owner[:m][inside])
    gram, own = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (spread(whole) % U(WORD_BUCKETS)).astype(np.int64), gram[order], own[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def log_odds(pos: np.ndarray, neg: np.ndarray, base: float, weight: float = 2.0) -> np.ndarray:
    """How much higher the logit of toxicity is with the feature than without knowing it; 0 if it was never seen."""
    rate = (pos + weight * base) / (pos + neg + weight)
    return (np.log(rate / (1 - rate)) - np.log(base / (1 - base))).astype(np.float32)


@dataclass
class ToxicModel:
    """Feature counts by label, learned embeddings, and the network's weights."""

    word_counts: np.ndarray
    gram_counts: np.ndarray
    base: float
    weights: dict[str, np.ndarray]
    shift: float = 0.0

    def given(self, words: list[str], minus: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds inputs of words, less one document of label ``minus``; and the buckets for the learned inputs."""
        word, gram, own = spelled(words)
        less = np.zeros(2, np.float32)
        if minus is not None:
            less[minus] = 1.0
        w = np.maximum(self.word_counts[:, word] - less[:, None], 0)
        g = np.maximum(self.gram_counts[:, gram] - less[:, None], 0)
        wl, gl = log_odds(w[1], w[0], self.base), log_odds(g[1], g[0], self.base)
        begin = np.searchsorted(own, np.arange(len(words)))
        count = np.maximum(np.bincount(own, minlength=len(words)), 1)
        some = np.minimum(begin, len(gl) - 1)
        top = np.maximum.reduceat(gl, some)
        mean = np.bincount(own, gl, len(words)) / count
        return np.stack([wl, top, mean, np.ones(len(words))], 1).astype(np.float32), word, gram, own

    def inputs(self, words: list[str], minus: int | None = None) -> np.ndarray:
        given, word, gram, own = self.given(words, minus)
        count = np.maximum(np.bincount(own, minlength=len(words)), 1)[:, None]
        chars = np.stack([np.bincount(own, self.weights["chars"][gram, k], len(words)) for k in range(LEARNED)], 1) / count
        return np.concatenate([given, self.weights["words"][word] + chars], 1).astype(np.float32)


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = GIVEN + LEARNED, HIDDEN
    out = {"words": rng.normal(0, 0.05, (WORD_BUCKETS, LEARNED)), "chars": rng.normal(0, 0.05, (GRAM_BUCKETS, LEARNED))}
    for side in ("f", "b"):
        out |= {f"x{side}": rng.normal(0, 1 / np.sqrt(d), (d, 3 * h)), f"h{side}": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))}
    out |= {"att": rng.normal(0, 0.3, (2 * h, h)), "query": rng.normal(0, 0.3, h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in out.items()}


def run_side(px: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction, (steps, windows, hidden), for projected inputs in reading order."""
    steps, n = px.shape[:2]
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps):
        ph = h @ wh
        zr = 1.0 / (1.0 + np.exp(-(px[t, :, : 2 * HIDDEN] + ph[:, : 2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        pn = ph[:, 2 * HIDDEN :]
        c = np.tanh(px[t, :, 2 * HIDDEN :] + r * pn)
        new = h + mask[t] * (1.0 - z) * (c - h)
        if keep is not None:
            keep.append((h, z, r, c, pn))
        h = out[t] = new
    return out


def forward(w: dict[str, np.ndarray], pf: np.ndarray, pb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows from projected inputs (steps, windows, 3 x hidden); ``mask`` is (steps, windows, 1)."""
    kf, kb = ([], []) if keep is not None else (None, None)
    states = np.concatenate([run_side(pf, w["hf"], mask, kf), run_side(pb[::-1], w["hb"], mask[::-1], kb)[::-1]], 2)
    u = np.tanh(states @ w["att"])
    e = (u @ w["query"])[:, :, None] + (mask - 1) * 1e9
    a = np.exp(e - e.max(0, keepdims=True))
    a /= a.sum(0, keepdims=True)
    pooled = (a * states).sum(0)
    if keep is not None:
        keep |= {"kf": kf, "kb": kb, "states": states, "u": u, "a": a, "pooled": pooled}
    return pooled @ w["out"] + w["bias"]


def back_side(grad: np.ndarray, kept: list, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs and of both weight tables for one direction, in reading order."""
    gx, gwx, gwh = np.empty_like(x), np.zeros_like(wx), np.zeros_like(wh)
    gh = np.zeros_like(grad[0])
    for t in reversed(range(len(kept))):
        h, z, r, c, pn = kept[t]
        gh = gh + grad[t]
        go = gh * mask[t]
        gc = go * (1 - z) * (1 - c * c)
        gz = -go * (c - h) * z * (1 - z)
        gr = gc * pn * r * (1 - r)
        side = np.concatenate([gz, gr, gc], 1)
        gwx += x[t].T @ side
        gx[t] = side @ wx.T
        inner = np.concatenate([gz, gr, gc * r], 1)
        gwh += h.T @ inner
        gh = gh - go * (1 - z) + inner @ wh.T
    return gx, gwx, gwh


def gradients(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the logistic loss by weight, and of the inputs (steps, windows, inputs)."""
    keep: dict = {}
    logit = forward(w, x @ w["xf"], x @ w["xb"], mask, keep)
    g = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
    states, u, a, pooled = keep["states"], keep["u"], keep["a"], keep["pooled"]
    out = {"out": pooled.T @ g, "bias": g.sum(keepdims=True)}
    gp = g[:, None] * w["out"]
    gs = a * gp
    ga = (states * gp).sum(2, keepdims=True)
    ge = (a * (ga - (a * ga).sum(0, keepdims=True)))[:, :, 0]
    out["query"] = np.einsum("tn,tnh->h", ge, u)
    gu = ge[:, :, None] * w["query"] * (1 - u * u)
    out["att"] = np.einsum("tni,tnh->ih", states, gu)
    gs = gs + gu @ w["att"].T
    gx, out["xf"], out["hf"] = back_side(gs[:, :, :HIDDEN], keep["kf"], x, w["xf"], w["hf"], mask)
    gxb, out["xb"], out["hb"] = back_side(gs[::-1, :, HIDDEN:], keep["kb"], x[::-1], w["xb"], w["hb"], mask[::-1])
    return out, gx + gxb[::-1]


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, w: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            w[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


def window_table(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of so many words: the text and the first word of each window. Every text with a word has one at least."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    return doc, (np.arange(len(doc)) - (np.cumsum(count) - count)[doc]) * STRIDE


def places(starts: np.ndarray, sizes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word positions (steps, windows) and the mask of those inside their text."""
    at = first + np.arange(WINDOW)[:, None]
    inside = at < sizes[doc]
    return np.where(inside, starts[doc] + at, 0), inside[:, :, None].astype(np.float32)


def scores_of(w: dict[str, np.ndarray], pf: np.ndarray, pb: np.ndarray, ids: np.ndarray, sizes: np.ndarray, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window logits with their texts and first words; ``ids`` are rows of the projection tables, text after text."""
    doc, first = window_table(sizes)
    starts, out = np.cumsum(sizes) - sizes, np.zeros(len(doc), np.float32)
    for a in range(0, len(doc), batch):
        at, mask = places(starts, sizes, doc[a : a + batch], first[a : a + batch])
        rows = ids[at]
        out[a : a + batch] = forward(w, pf[rows], pb[rows], mask)
    return out, doc, first


def train(rows: list[tuple[str, int]], *, rounds: int = 8, seed: int = 7) -> ToxicModel:
    """Fit on (text, label) pairs that are in memory."""
    rng = np.random.default_rng(seed)
    texts, labels = [WORDS.findall(t.lower()) for t, _ in rows], np.array([y for _, y in rows])
    full = [i for i in range(len(rows)) if texts[i]]
    texts, labels = [texts[i] for i in full], labels[full] if len(full) else np.zeros(0, int)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t]) for t in texts]
    words = list(vocabulary)
    model = ToxicModel(np.zeros((2, WORD_BUCKETS), np.float32), np.zeros((2, GRAM_BUCKETS), np.float32), float(np.clip(labels.mean() if len(labels) else 0.1, 0.02, 0.5)), new_weights(rng))
    if not len(labels) or labels.min() == labels.max():
        model.shift = -5.0 if not len(labels) or not labels.max() else 5.0
        return model
    word, gram, own = spelled(words)
    cut = np.searchsorted(own, np.arange(len(words) + 1))
    for y, t in zip(labels, ids, strict=True):
        kinds = np.unique(t)
        model.word_counts[y, np.unique(word[kinds])] += 1
        model.gram_counts[y, np.unique(np.concatenate([gram[cut[k] : cut[k + 1]] for k in kinds]))] += 1
    del texts, vocabulary
    # Rows of the tables are words as clean texts see them, then as toxic ones do.
    given = np.concatenate([model.given(words[a : a + 20_000], y)[0] for y in (0, 1) for a in range(0, len(words), 20_000)])
    sizes, flat = np.array([len(t) for t in ids]), np.concatenate(ids) + np.repeat(labels * len(words), [len(t) for t in ids])
    starts, count = np.cumsum(sizes) - sizes, np.maximum(np.bincount(own, minlength=len(words)), 1)[:, None]
    w, adam = model.weights, Adam(0.02)
    toxic_weight = float((labels == 0).sum() / max(1, (labels == 1).sum())) ** 0.5
    for turn in range(rounds):
        chars = np.stack([np.bincount(own, w["chars"][gram, k], len(words)) for k in range(LEARNED)], 1) / count
        learned = np.tile((w["words"][word] + chars).astype(np.float32), (2, 1))
        x = np.concatenate([given, learned], 1)
        logit, doc, first = scores_of(w, x @ w["xf"], x @ w["xb"], flat, sizes)
        if turn == 0:  # the untrained network knows nothing: take the window with the most telling word
            tell = given[flat, :2].sum(1)
            logit = np.array([tell[starts[d] + f : starts[d] + min(f + WINDOW, sizes[d])].max() for d, f in zip(doc, first, strict=True)])
        order = np.lexsort((logit, doc))
        top = order[np.concatenate([doc[order][1:] != doc[order][:-1], [True]])]
        some = rng.permutation(len(doc))
        some = some[np.unique(doc[some], return_index=True)[1]]
        picked = np.concatenate([top, some[labels[doc[some]] == 0]])
        rng.shuffle(picked)
        for a in range(0, len(picked), 128):
            p = picked[a : a + 128]
            at, mask = places(starts, sizes, doc[p], first[p])
            row = flat[at]
            y = labels[doc[p]].astype(np.float32)
            grads, gx = gradients(w, x[row], mask, y, np.where(y > 0, toxic_weight, 1.0).astype(np.float32))
            adam.step(w, grads)
            # The embeddings take plain steps, on the rows that the batch has.
            back = (gx * mask)[:, :, GIVEN:].reshape(-1, LEARNED) * -0.5
            kind = row.reshape(-1) % len(words)
            np.add.at(w["words"], word[kind], back)
            uses, inverse = np.unique(kind, return_inverse=True)
            total = np.stack([np.bincount(inverse, back[:, k], len(uses)) for k in range(LEARNED)], 1) / count[uses]
            for k, g in zip(uses, total, strict=True):
                w["chars"][gram[cut[k] : cut[k + 1]]] += g.astype(np.float32)
    chars = np.stack([np.bincount(own, w["chars"][gram, k], len(words)) for k in range(LEARNED)], 1) / count
    x = np.concatenate([given, np.tile((w["words"][word] + chars).astype(np.float32), (2, 1))], 1)
    logit, doc, _ = scores_of(w, x @ w["xf"], x @ w["xb"], flat, sizes)
    best = np.full(len(sizes), -np.inf)
    np.maximum.at(best, doc, logit)
    model.shift = -best_cut(best, labels)
    return model


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The cut between neighbouring scores with the best F1, midway in the widest gap of equally good ones."""
    order = np.argsort(-scores)
    s, hits = scores[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + labels.sum())
    gaps = s[:-1] - s[1:]
    good = np.flatnonzero(f1[:-1] >= f1[:-1].max() - 0.004)
    i = good[np.argmax(gaps[good])]
    return float(np.clip((s[i] + s[i + 1]) / 2, s[i] - 2.0, s[i]))


class Scorer:
    """Scores batches of texts; keeps the projected inputs of a bounded number of words."""

    def __init__(self, model: ToxicModel, cache_words: int = 120_000):
        self.model, self.limit = model, cache_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pf = self.pb = np.zeros((0, 3 * HIDDEN), np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.limit:
            self.clear()
        ids = list(map(self.index.get, words))
        fresh = len(self.index)
        if None in ids:
            for w in words:
                if w not in self.index:
                    self.index[w] = len(self.index)
            new = list(self.index)[fresh:]
            x = np.concatenate([self.model.inputs(new[a : a + 20_000]) for a in range(0, len(new), 20_000)])
            self.pf, self.pb = np.concatenate([self.pf, x @ self.model.weights["xf"]]), np.concatenate([self.pb, x @ self.model.weights["xb"]])
            ids = list(map(self.index.__getitem__, words))
        return np.array(ids, np.int64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One score per text: the worst window's; 0 for a text without a word."""
        out, begin = np.zeros(len(texts)), 0
        while begin < len(texts):
            flat, sizes = [], []
            while begin + len(sizes) < len(texts) and len(flat) < 200_000:
                found = WORDS.findall((texts[begin + len(sizes)] or "").lower())
                flat += found
                sizes.append(len(found))
            if flat:
                ids = self.rows(flat)  # before the tables are read: it may extend them
                logit, doc, _ = scores_of(self.model.weights, self.pf, self.pb, ids, np.array(sizes))
                best = np.full(len(sizes), -np.inf)
                np.maximum.at(best, doc, logit)
                out[begin : begin + len(sizes)] = np.where(np.isfinite(best), sigmoid(best + self.model.shift), 0.0)
            begin += len(sizes)
        return out


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 1000, max_clean: int = 2000, max_chars: int = 20_000) -> ToxicModel:
    """Train on a bounded sample of labelled rows: so many of each label at most, by a hash of the id.

    Of a longer text than ``max_chars`` a slice of that length is taken, at a place that the hash picks; of a toxic one a slice ten
    times as long, as its passage may be anywhere. The bounds keep the sample within some tens of MB on the driver; every row is scored
    whole. Rows without text or label are left out; repeated rows count each; with one label or no rows every text gets the same score.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
    h, y = F.xxhash64(F.col(id_col).cast("string"), F.lit(1)), (F.col(label_col) == 1).cast("int")
    most = F.when(y == 1, 10 * max_chars).otherwise(max_chars)
    start = F.pmod(h, F.greatest(F.length(text_col) - most, F.lit(0)) + 1).cast("int") + 1
    rows = usable.select(h.alias("h"), F.substring(F.col(text_col), start, most).alias("text"), y.alias("y"))
    drawn = [r for y, n in ((1, max_toxic), (0, max_clean)) for r in bounded_sample(rows.where(F.col("y") == y), "h", n)]
    return train([(r.text, r.y) for r in drawn])


def score_toxicity(docs: DataFrame, model: ToxicModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1, and ``toxic_predicted``, 1 from 0.5.

    Every text is read whole, in windows. Null texts count as empty; a text without a word scores 0. Repeated rows get equal scores, an empty
    table stays empty. Columns with the two names are replaced, all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.score(texts.tolist()))

    return docs.withColumn("toxicity", run(text_of(text_col))).withColumn("toxic_predicted", (F.col("toxicity") >= 0.5).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs.where(fold("doc_id", 5) != 0).join(labels, "doc_id"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"))

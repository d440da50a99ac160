"""Language identification of mixed-language text.

A word's script narrows the candidate languages; character n-grams score the word for each candidate; Viterbi over a
document's words, with a penalty for each change of language, labels its spans. Training is naive Bayes over hashed
n-grams on a bounded sample of labelled rows. Scoring runs in Arrow batches over every word of every text.
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

from .common import bounded_sample, fold, load, unused

LETTERS = re.compile(r"[^\W\d_]+")
# First code points of Unicode script ranges and the scripts that begin there.
SCRIPT_RANGES = (
    (0x0000, "Common"), (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Other"), (0x20000, "Han"),
)
STARTS = np.array([a for a, _ in SCRIPT_RANGES])
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
SCRIPT_AT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])

BUCKETS = 1 << 16
GRAMS = 4
UNDETERMINED = "und"


def _spread(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers so that their low bits are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_table(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Hashed n-grams of ``<word>`` for n from 1 to GRAMS: for each n, buckets and the words they belong to."""
    joined = "".join(f"<{w.lower()}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w.lower()) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, GRAMS + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        inside = owner[:m] == owner[n - 1 :]
        buckets.append((_spread(h[inside]) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(owner[:m][inside])
    return buckets, owners


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], dtype=np.int64)
    return SCRIPT_AT[np.searchsorted(STARTS, first, side="right") - 1]


@dataclass
class LanguageModel:
    """Log-probabilities of n-gram buckets by language, and which languages are written in which script."""

    langs: list[str]
    logp: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row per word: the mean log-probability over n-grams, times half the number of letters, by language.

        A language not written in the word's script gets a floor; where no language is, all are equal.
        """
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out.astype(np.float32)
        total, count = out.copy(), np.zeros(len(words))
        for buckets, owners in zip(*gram_table(words), strict=True):
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owners, self.logp[buckets, k], len(words))
            count += np.bincount(owners, minlength=len(words))
        out = total / count[:, None] * (np.array([len(w) for w in words]) / 2 + 1)[:, None]
        script = self.allowed[scripts_of(words)]
        known = script.any(1)
        out = np.where(script, out, out.min(1, keepdims=True) - 20.0)
        out[~known] = 0.0
        return (out - out.max(1, keepdims=True)).astype(np.float32)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000, least_rows: int = 50, max_chars: int = 100_000) -> LanguageModel:
    """Fit on a sample of labelled rows, chosen by a hash of their id.

    Each language gives ``max_rows`` shared by the number of languages, but ``least_rows`` at least, so a rare one is learned
    too. Of a row longer than ``max_chars`` so many characters are learned from, from a place that the hash picks. These bounds
    keep the sample in the driver's memory; no row is held back from scoring.
    """
    usable = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(9))
    begin = F.pmod(h, F.greatest(F.length(text_col) - max_chars, F.lit(0)) + 1).cast("int") + 1
    rows = bounded_sample(usable.select(h.alias("h"), F.substring(F.col(text_col), begin, F.lit(max_chars)).alias("text"), F.col(lang_col).alias("lang")), "h", max_rows, "lang", least_rows)
    langs = sorted({r.lang for r in rows})
    counts, by_script, seen = np.zeros((BUCKETS, max(1, len(langs)))), np.zeros((len(SCRIPTS), max(1, len(langs)))), np.zeros(max(1, len(langs)))
    for k, lang in enumerate(langs):
        words = [w for r in rows if r.lang == lang for w in LETTERS.findall(r.text)]
        seen[k] = sum(r.lang == lang for r in rows)
        for a in range(0, len(words), 200_000):
            part = words[a : a + 200_000]
            for buckets, _ in zip(*gram_table(part), strict=True):
                counts[:, k] += np.bincount(buckets, minlength=BUCKETS)
            by_script[:, k] += np.bincount(scripts_of(part), minlength=len(SCRIPTS))
    logp = np.log((counts + 0.2) / (counts.sum(0) + 0.2 * BUCKETS))
    share = by_script / np.maximum(by_script.sum(0), 1)
    return LanguageModel(langs, logp.astype(np.float32), share >= 0.01, np.log((seen + 1) / (seen + 1).sum()))


def best_paths(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, for documents whose words lie one after another in ``scores``.

    A document keeps its overall best language throughout when no run of words gains more than half a penalty by
    another one: then no path with a change can win. The others go through Viterbi, all of them one word at a time.
    """
    out = np.zeros(len(scores), np.int16)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    first = np.add.reduceat(scores, starts[full], axis=0).argmax(1)
    doc = np.repeat(np.arange(len(full)), sizes[full])
    out[:] = first[doc]
    gain, mixed = scores - scores[np.arange(len(scores)), out][:, None], np.zeros(len(full), bool)
    far = 1e3 + float(np.abs(gain).sum(1).max(initial=0)) * (int(sizes.max()) + 1)
    for k in range(scores.shape[1]):
        run = np.cumsum(gain[:, k], dtype=np.float64)
        before = np.concatenate([[0.0], run[:-1]])
        low = np.minimum.accumulate(before - doc * far)
        np.logical_or.at(mixed, doc[run - doc * far - low > penalty / 2], True)
    todo = full[mixed]
    if len(todo):
        todo = todo[np.argsort(-sizes[todo], kind="stable")]
        begin, length = starts[todo], sizes[todo]
        at = scores[begin].astype(np.float64)
        alive = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        came, tops = [], []
        for t in range(1, int(length[0])):
            n = int(alive[t])
            v = at[:n]
            top = v.argmax(1)
            switch = v.max(1) - penalty
            change = v < switch[:, None]
            came.append(change)
            tops.append(top)
            at[:n] = np.where(change, switch[:, None], v) + scores[begin[:n] + t]
        label = at.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = int(alive[t])
            out[begin[:n] + t] = label[:n]
            if t:
                change = came[t - 1][np.arange(n), label[:n]]
                label[:n] = np.where(change, tops[t - 1], label[:n])
    return out


class Labeller:
    """Scores batches of texts with a bounded cache of word scores."""

    def __init__(self, model: LanguageModel, penalty: float, cache_words: int = 100_000):
        self.model, self.penalty, self.limit = model, penalty, cache_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)
        self.known = np.zeros(0, bool)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The scores of words, and whether any language is written in their script."""
        if len(self.index) > self.limit:
            self.clear()
        get, fresh = self.index.get, len(self.index)
        ids = [get(w, -1) for w in words]
        if -1 in ids:
            for w in words:
                if w not in self.index:
                    self.index[w] = len(self.index)
            new = list(self.index)[fresh:]
            self.table = np.concatenate([self.table, *[self.model.word_scores(new[a : a + 50_000]) for a in range(0, len(new), 50_000)]])
            self.known = np.concatenate([self.known, self.model.allowed[scripts_of(new)].any(1)])
            ids = [self.index[w] for w in words]
        at = np.array(ids, dtype=np.int64)
        return self.table[at], self.known[at]

    def label(self, texts: list[str | None], spans: bool) -> tuple[list, list, list]:
        langs, preds, shares, found = self.model.langs, [], [], []
        if not langs:  # nothing was learned
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [[]] * len(texts)
        begin, size = 0, len(texts)
        while begin < size:
            flat, sizes, end = [], [], begin
            while end < size and len(flat) < 150_000:
                words = LETTERS.findall(texts[end] or "")
                if not any(any(map(str.isalpha, w)) for w in words):
                    words = []  # digits like superscripts only
                flat += words
                sizes.append(len(words))
                end += 1
            sizes = np.array(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            scores, known = self.words(flat) if flat else (np.zeros((0, len(langs)), np.float32), np.zeros(0, bool))
            scores = scores + (1e-6 * self.model.prior).astype(np.float32)
            path = best_paths(scores, starts, sizes, self.penalty)
            letters = np.fromiter(map(len, flat), np.float64, len(flat))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            weight = np.bincount(doc * len(langs) + path, letters * known, len(sizes) * len(langs)).reshape(len(sizes), -1)
            best, total = weight.argmax(1), np.bincount(doc, letters, len(sizes))
            for d in range(len(sizes)):
                ok = total[d] > 0
                preds.append(langs[best[d]] if ok else UNDETERMINED)
                shares.append(float(weight[d, best[d]] / total[d]) if ok else 0.0)
                if spans:
                    found.append(self.spans(texts[begin + d] or "", path[starts[d] : starts[d] + sizes[d]]) if ok else [])
            begin = end
        return preds, shares, found

    def spans(self, text: str, path: np.ndarray) -> list[dict]:
        out: list[dict] = []
        for m, k in zip(LETTERS.finditer(text), path, strict=False):
            if out and out[-1]["lang"] == self.model.langs[k]:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end(), "lang": self.model.langs[k]})
        return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", penalty: float = 8.0, spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (share of letters in spans of that language) and, if asked, ``lang_spans``.

    A null text, or one without a letter, is `und` with score 0 and no spans. Letters of a script that no language is written in
    count for none: a text of only such letters has score 0. Ties go to the language first by name. Texts of any length
    are read whole. Repeated rows get equal values, an empty table gives no rows, and a model of no languages says `und`.
    All other columns pass through; ones named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])

    @F.pandas_udf(kind)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value, penalty)
        for texts in batches:
            preds, shares, found = labeller.label(texts.tolist(), spans)
            yield pd.DataFrame({"lang": preds, "score": shares, "spans": found if spans else [None] * len(preds)})

    out = unused(docs, "lang")
    made = docs.withColumn(out, label(F.col(text_col))).withColumns({"lang_pred": F.col(out)["lang"], "lang_score": F.col(out)["score"]})
    return (made.withColumn("lang_spans", F.col(out)["spans"]) if spans else made).drop(out)


def accepted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a letter and at least share ``least`` of letters in one language; their columns as they were."""
    row = unused(docs, "row")
    marked = identify(docs.select(text_col, F.struct(*docs.columns).alias(row)), model, text_col=text_col)
    return marked.where((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= least)).select(f"{row}.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))

"""Periodic runs of words: maximal stretches that repeat with some period, found by uniting suffix classes.

The suffixes of a text are sorted and joined in descending order of the longest common prefix (LCP) of neighbours, as Kruskal
joins edges. Union-find holds the classes, each with its positions in order; a smaller class goes into the larger one. Two
positions that become neighbours in a class at level l begin the same l words and have nothing between them that does. If their
distance d is at most l, the words from the first on repeat with period d, and d is the smallest period of that stretch:
a smaller one would have put a position between them at a higher level. The stretch ends where the common prefix does, so it is
a run if the word before it breaks the period too. Each run is met once, at its first position and that plus its period.

A run of twelve words or twice its period has an LCP of six at least, so only suffixes whose first six words occur twice in
the text take part. They are found by a counting filter, then sorted by prefix doubling from six words on. Texts are
taken in slices, all texts of a slice at once; a separator that occurs once ends each, so that nothing matches across them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, load, unused

#: Words of a run at least, and how often it repeats.
LEAST_WORDS, LEAST_REPEATS = 12, 2
#: The least common prefix that seeds a run: of 12 words with period 6.
DEPTH = LEAST_WORDS // LEAST_REPEATS
SLICE = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_starts(codes: np.ndarray) -> np.ndarray:
    """Positions whose first DEPTH codes may occur elsewhere; all that do are among them. The last DEPTH positions are padding."""
    n = len(codes) - DEPTH
    if n <= 0:
        return np.zeros(0, np.int64)
    spread = (codes.astype(np.uint64) + np.uint64(1)) * ODD
    spread ^= spread >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(DEPTH):
        h = h * ODD + spread[j : j + n]
    bits = max(10, n.bit_length() + 2)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows: where each row's group of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def sorted_suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first DEPTH codes repeat, in order, and which of those groups each belongs to."""
    some = repeated_starts(codes)
    # Ranks are asked for at these places and DEPTH further on, where the first DEPTH codes may be unique.
    places = np.unique(np.concatenate([some, some + DEPTH]))
    places = places[places + DEPTH <= len(codes)]
    columns = [codes[places + j] for j in range(DEPTH)]
    order = np.lexsort(columns[::-1])
    begin = group_starts(*[c[order] for c in columns])
    rank = np.zeros(len(codes), np.int64)
    rank[places[order]] = begin
    size = np.bincount(begin, minlength=len(places) + 1)
    chosen = places[order][size[begin] > 1]
    family = rank[chosen].copy()
    active, h = chosen, DEPTH
    while len(active):
        first, second = rank[active], rank[active + h]
        order = np.lexsort((second, first))
        active, first, second = active[order], first[order], second[order]
        outer, inner = group_starts(first), group_starts(first, second)
        rank[active] = first + (inner - outer)
        active = active[np.bincount(inner, minlength=len(active))[inner] > 1]
        h *= 2
    order = np.argsort(rank[chosen], kind="stable")
    return chosen[order], family[order]


def common_prefixes(codes: np.ndarray, suffixes: np.ndarray, family: np.ndarray) -> np.ndarray:
    """LCP of each sorted suffix with the one before it, in text order, each beginning at one less than the last; 0 below DEPTH."""
    out = np.zeros(len(suffixes), np.int64)
    same = np.flatnonzero(family[1:] == family[:-1]) + 1
    by_place = same[np.argsort(suffixes[same], kind="stable")]
    text, known, place = codes.tolist(), 0, -2
    lengths = []
    for i, j in zip(suffixes[by_place].tolist(), suffixes[by_place - 1].tolist(), strict=True):
        known = max(DEPTH, known - 1) if i == place + 1 else DEPTH
        while text[i + known] == text[j + known]:
            known += 1
        lengths.append(known)
        place = i
    out[by_place] = lengths
    return out


def joined_neighbours(suffixes: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """(position, next position, level) of all that become neighbours in a class at a distance of at most that level."""
    parent = list(range(len(suffixes)))
    classes: list = [[p] for p in suffixes.tolist()]
    found: list[tuple[int, int, int]] = []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = np.flatnonzero(lcp >= DEPTH)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    for k, level in zip(edges.tolist(), lcp[edges].tolist(), strict=True):
        a, b = top(k - 1), top(k)
        large, small = classes[a], classes[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        at = [bisect_left(large, x) for x in small]
        for u, (x, t) in enumerate(zip(small, at, strict=True)):
            if t and x - large[t - 1] <= level and (not u or small[u - 1] < large[t - 1]):
                found.append((large[t - 1], x, level))
            if t < len(large) and large[t] - x <= level and (u + 1 == len(small) or small[u + 1] > large[t]):
                found.append((x, large[t], level))
        if len(small) * 16 > len(large):
            large += small
            large.sort()
        else:
            for x, t in zip(reversed(small), reversed(at), strict=True):
                large.insert(t, x)
        parent[b], classes[b] = a, None
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of word lists, by text, start and period."""
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known)) for words in texts for w in words]
    sizes = np.array([len(words) for words in texts], np.int64)
    # A separator before the first text, one after each, and padding: all different.
    starts = 1 + np.cumsum(sizes + 1) - sizes - 1
    codes = np.empty(1 + len(flat) + len(texts) + 2 * DEPTH, np.int64)
    is_word = np.zeros(len(codes), bool)
    is_word[np.repeat(starts, sizes) + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = True
    codes[is_word] = flat
    codes[~is_word] = len(known) + np.arange(len(codes) - len(flat))
    suffixes, family = sorted_suffixes(codes)
    i, j, level = joined_neighbours(suffixes, common_prefixes(codes, suffixes, family)).T
    period, length = j - i, j - i + level
    keep = (codes[i - 1] != codes[j - 1]) & (length >= np.maximum(LEAST_WORDS, LEAST_REPEATS * period))
    i, period, length = i[keep], period[keep], length[keep]
    text = np.searchsorted(starts, i, side="right") - 1
    start = i - starts[text] if len(i) else i
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run has after its first period, joined by spaces."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def sliced(column: pa.Array) -> Iterator[list[bytes]]:
    """The bytes of a text column, some at a time, null as empty."""
    column = column.cast(pa.binary())
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SLICE, side="right")))
        yield [t or b"" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end


def find_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start and period), ``n_words`` and ``collapsed``.

    A run is a stretch of at least 12 words and two periods that no neighbouring word extends; words are what stands between
    ASCII white space. ``collapsed`` leaves of each run its first period, words joined by one space. Null and empty texts
    have no words: an empty array, 0, an empty text. Texts are read whole, each alone, so repeated rows get equal values; an empty
    table stays empty. Columns with the new names are replaced, others pass through.
    """
    made = {"n_words": "long", "runs": "array<struct<start: long, length: long, period: long>>", "collapsed": "string"}

    @F.arrow_udf(f"struct<{', '.join(f'{k}: {v}' for k, v in made.items())}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in sliced(batch):
                words = [t.split() for t in texts]  # of bytes: at ASCII white space
                text, *run = runs_of(words)
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                short = [collapsed(w, *[c[a:b] for c in run]) for w, a, b in zip(words, edges, edges[1:], strict=False)]
                rows = pa.StructArray.from_arrays([pa.array(c) for c in run], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), rows)
                yield pa.StructArray.from_arrays([pa.array([len(w) for w in words], pa.int64()), lists, pa.array(short, pa.binary()).cast(pa.string())], list(made))

    out = unused(docs, "made")
    done = docs.select(*[c for c in docs.columns if c not in made], run(F.col(text_col)).alias(out))
    return done.select(*[c for c in done.columns if c != out], *[F.col(out)[c].alias(c) for c in made])


def wrapped(text: Column, h: Column) -> Column:
    """Words from the (g mod n)-th on repeat with a period that ``h`` picks, g = h div 10, where h mod 10 is 0."""
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))  # of no words nothing is taken below
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(F.size(words) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int"))), " "))

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), repeat)).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # A function that reads a text made with lambdas cannot be planned; a generator of one row stands between.
    found = find_runs(docs.select("doc_id", F.explode(F.array(wrapped(F.coalesce("text", F.lit("")), h))).alias("text")))
    rank = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", "runs", "collapsed", F.array_max(rank).alias("best"), F.array_join(lines, "").alias("lines"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

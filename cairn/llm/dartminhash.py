"""MinHash near-dedup with DartMinHash signatures.

Darts fall on the plane of weight and rank above each element (a five-word shingle) as a Poisson process that a hash of the
element fixes. A document keeps the darts under its elements' weights; each dart belongs to one coordinate, and the earliest
dart of each coordinate is the signature: two documents agree in a coordinate with the probability of their weighted
Jaccard similarity. A document of n elements costs about n + k log k darts instead of n times k hashes.

Signatures are cut into bands; texts that share a band become candidates and are compared exactly. Equal texts are one node
throughout. Small buckets are compared in all pairs; in large ones texts meet one pivot first, and what it leaves apart goes
through an exact prefix filter (see `near_roots`), so a hot bucket does not become pairs of its members.

Weights are whole numbers. For the exact comparison an element of weight w stands as w elements, the first, second, ... of its
kind: Jaccard similarity of these is the weighted one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, stash, text_of, unused
from .components import components

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
FULL = U(0xFFFFFFFFFFFFFFFF)
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
CHUNK = 1 << 21
SLOTS = 1 << 18
ROUND = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5), U(0xB564EF22EC7AECE5), U(0xF7C2EBC08F67F2B5))


def salt(step: int) -> np.uint64:
    """A constant for each step."""
    return U(step * int(GOLD) % (1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTER = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


BASE = 0x2545F4914F6CDD1D
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for chunks of up to ``n`` bytes."""
    size = max(CHUNK, 1 << max(1, n - 1).bit_length())
    if size not in POWERS:
        POWERS.clear()
        POWERS[size] = powers(BASE, size + 1), powers(pow(BASE, -1, 1 << 64), size + 1)
    return POWERS[size]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 44-bit shingle hash, times it occurs), sorted, for texts that lie in ``data`` between ``offsets``.

    A text with fewer words than ``width`` has one shingle of all of them; one without words has none.
    """
    n = len(offsets) - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (edge[:-1] | np.concatenate([[True], blank[:-1]])))
    ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate([blank[1:], [True]]))) + 1
    if not len(starts):
        return empty
    power, inverse = tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[data] * power[: len(data)], dtype=np.uint64)])
    words = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    m = len(words) - width + 1
    whole = np.flatnonzero(owner[:m] == owner[width - 1 :]) if m > 0 else np.zeros(0, np.int64)
    h = np.zeros(len(whole), np.uint64)
    for k in range(width):
        h += words[whole + k] * ROUND[k % 5] * U(2 * (k // 5) + 1)
    docs, hashes = [owner[whole]], [mix(h)]
    count = np.bincount(owner, minlength=n)
    short = (count > 0) & (count < width)
    if short.any():
        turn = np.arange(len(words)) - (np.cumsum(count) - count)[owner]
        part = short[owner]
        h = np.zeros(n, np.uint64)
        np.add.at(h, owner[part], words[part] * np.array(ROUND)[turn[part] % 5])
        docs.append(np.flatnonzero(short))
        hashes.append(mix(h[short] + U(1)))
    keys = np.sort((np.concatenate(docs).astype(np.uint64) << U(44)) | (np.concatenate(hashes) >> U(20)))
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at] >> U(44)).astype(np.int64), keys[at] & U((1 << 44) - 1), np.diff(np.concatenate([at, [len(keys)]]))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from hashes."""
    return ((x >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, k: int, sig: np.ndarray) -> None:
    """Throw the darts of rank up to ``limit[doc]`` and keep the earliest per coordinate in ``sig``.

    Weights fall into cells [0, 1), [1, 2), [2, 4), ... In each cell the ranks of an element's darts are sums of
    exponential steps, so that a document with a higher limit or weight sees the same darts and more.
    """
    low, wide, cell = 0.0, 1.0, 1
    act = np.arange(len(doc))
    while len(act):
        state, rank, live = mix(element[act] * U(2) + salt(cell)), np.zeros(len(act)), np.arange(len(act))
        step = 0
        while len(live):
            step += 1
            u = mix(state[live] + salt(step))
            rank[live] -= np.log(unit(u)) / wide
            hit = rank[live] <= limit[doc[act[live]]]
            live, u = live[hit], u[hit]
            under = low + wide * unit(mix(u ^ U(0x5851F42D4C957F2D))) <= weight[act[live]]
            at, u = live[under], u[under]
            name = mix(u + U(0x14057B7EF767814F))
            slot = doc[act[at]] * k + ((name >> U(32)) % U(k)).astype(np.int64)
            np.minimum.at(sig, slot, (rank[at].astype(np.float32).view(np.uint32).astype(np.uint64) << U(32)) | (name & U(0xFFFFFFFF)))
        low, wide, cell = (low + wide), (1.0 if cell == 1 else wide * 2), cell + 1
        act = act[weight[act] > low]


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """An (n, k) signature table; rows of documents without elements stay full of the largest number."""
    sig = np.full(n * k, FULL)
    weight = weight.astype(np.float64)
    mass = np.bincount(doc, weight, n) if len(doc) else np.zeros(n)
    limit = k * (np.log(k) + 2) / np.maximum(mass, 1e-12)
    todo = np.ones(len(doc), bool)
    while todo.any():
        throw(doc[todo], element[todo], weight[todo], limit, k, sig)
        open_ = (sig.reshape(n, k) == FULL).any(1) & (mass > 0)
        limit = np.where(open_, limit * 2, limit)
        todo = open_[doc]
    return sig.reshape(n, k)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), salt(b + 1))
        for r in range(rows):
            h = mix(h + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def signatures(docs: DataFrame, *, k: int, bands: int, width: int, weighting: str) -> DataFrame:
    """``id, th`` as given, and for each text its number of shingles, its bands and its shingles.

    The shingles are a binary column of sorted 32-bit hashes; a shingle of weight w is there w times under different hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CHUNK, side="right")) - 1)
                n, own = end - begin, offsets[begin : end + 1]
                doc, h, times = shingle_sets(data[own[0] : own[-1]], own - own[0], width)
                weight = {"binary": np.ones_like(times), "tf": times, "log": np.frexp(times)[1]}[weighting]
                sig = band_hashes(dart_signatures(doc, mix(h + U(1)), weight, n, k), bands)
                if weighting != "binary":
                    turn = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                    doc, h = np.repeat(doc, weight), np.repeat(h, weight)
                    h = np.where(turn > 0, mix(h + turn.astype(U) * GOLD) >> U(20), h)
                    h = h[np.argsort((doc.astype(U) << U(44)) | h)]
                size = np.bincount(doc, minlength=n)
                cut = np.concatenate([[0], np.cumsum(size)])
                keys = (h >> U(12)).astype(np.uint32)
                sets = [keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                full = np.flatnonzero(size)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32), pa.array(sig[full].ravel()))
                head = batch.slice(begin, n)
                yield pa.RecordBatch.from_arrays([head.column("id"), head.column("th"), pa.array(size, pa.int64()), lists, pa.array(sets, pa.binary())], ["id", "th", "n", "bands", "shingles"])
                begin = end

    kind = f"id {docs.schema['id'].dataType.simpleString()}, th binary, n long, bands array<long>, shingles binary"
    return docs.select("id", "th", "text").mapInArrow(run, kind)


def similarity(left: bytes, right: bytes) -> float:
    """Jaccard similarity of two sorted lists of shingle hashes; equal hashes in one list count once each."""
    a, b = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``pairs(a, b, ...)`` with ``ok``: whether the exact similarity reaches the threshold."""

    @F.pandas_udf("double")
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(left, right, strict=True)])

    one = pairs.join(sets.select(F.col("th").alias("a"), F.col("shingles").alias("left")), "a")
    two = one.join(sets.select(F.col("th").alias("b"), F.col("shingles").alias("right")), "b")
    return two.select(*pairs.columns, (score("left", "right") >= threshold).alias("ok"))


def shared_prefixes(texts: DataFrame, *, threshold: float) -> DataFrame:
    """Pairs ``a < b`` (and their roots ``root_a, root_b``) of ``texts(th, root, open, shingles)`` that may be alike: unlike roots, at least one of them open.

    Shingles are put in one order, those that are rare among the open texts first. Two texts that reach the threshold
    share a shingle before the point where less than ``threshold`` of either one's shingles are left, and at the first
    shingle that they share enough must be left in both. No pair that reaches the threshold is lost, whatever the order;
    so counts in a table of fixed size, where some shingles share a slot, will do for it.
    """
    spark = texts.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for packed in batch.column("shingles"):
                np.add.at(total, np.frombuffer(packed.as_py(), np.uint32) % SLOTS, 1)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    counts = texts.where("open").select("shingles").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.int64)
    table[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(table)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            which, shingle, rest, whole = [], [], [], []
            for i, packed in enumerate(batch.column("shingles")):
                keys = np.frombuffer(packed.as_py(), np.uint32)
                keys = keys[np.lexsort((keys, often[keys % SLOTS]))]
                left = len(keys) - np.arange(len(keys))
                use = (left >= threshold * len(keys) - 1e-6) & (often[keys % SLOTS] > 0)  # the others are in no open text
                which.append(np.full(int(use.sum()), i))
                shingle.append(keys[use].astype(np.int64))
                rest.append(left[use])
                whole.append(np.full(int(use.sum()), len(keys)))
            if which:
                at = pa.array(np.concatenate(which))
                head = [batch.column(c).take(at) for c in ("th", "root", "open")]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(np.concatenate(x)) for x in (shingle, rest, whole)]], ["th", "root", "open", "shingle", "rest", "whole"])

    posts = stash(texts.select("th", "root", "open", "shingles").mapInArrow(prefixes, "th binary, root binary, open boolean, shingle long, rest long, whole long"), "posts")
    x = posts.where("open").select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("th", "root", "rest", "whole")])
    enough = F.least("x_rest", "rest") >= F.lit(threshold / (1 + threshold)) * (F.col("x_whole") + F.col("whole")) - 1e-6
    met = x.join(posts, "shingle").where((F.col("x_root") != F.col("root")) & enough)
    first = F.col("x_th") < F.col("th")
    return met.select(F.least("x_th", "th").alias("a"), F.greatest("x_th", "th").alias("b"), F.when(first, F.col("x_root")).otherwise(F.col("root")).alias("root_a"), F.when(first, F.col("root")).otherwise(F.col("x_root")).alias("root_b")).distinct()


def near_roots(signed: DataFrame, *, threshold: float, small: int = 16) -> DataFrame:
    """``node, root`` over text hashes: the classes of texts found alike among ``signed(th, n, bands, shingles)``, for all nodes but roots.

    Buckets of up to ``small`` texts are compared in all pairs. In a larger one each text meets the bucket's pivot, its
    most popular text: the one that shares most places of large buckets with others, as an original does with its edited
    copies. That only saves comparisons: every text that is not connected to its pivot then, by whatever links were found,
    is compared with all texts of such buckets that are in another class and may be alike, which is exact (`shared_prefixes`).
    """
    near = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    one = stash(signed.where("n > 0").select("th", "n", "bands").dropDuplicates(["th"]), "one")
    rows = one.select("th", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = stash(rows.join(stash(sizes, "sizes"), "key"), "members")
    listed = members.where(F.col("members") <= small).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("th", "n"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter("m", lambda y, j: (j > i) & near(x["n"], y["n"])), lambda y: F.struct(x["th"].alias("a"), y["th"].alias("b")))))
    many = members.where(F.col("members") > small)
    popular = many.groupBy("th").agg(F.sum("members").alias("pop"))
    pivots = stash(many.join(popular, "th").groupBy("key").agg(F.max(F.struct("pop", "th", "n")).alias("pivot")), "pivots")
    large = stash(many.join(pivots, "key").where(F.col("th") != F.col("pivot.th")).select("key", "th", "n", "pivot"), "large")
    meet = large.where(near(F.col("n"), F.col("pivot.n"))).select(F.least("pivot.th", "th").alias("a"), F.greatest("pivot.th", "th").alias("b"))
    wanted = listed.select(F.inline(pairs)).union(meet).distinct()
    sets = stash(signed.select("th", "shingles").dropDuplicates(["th"]).join(members.select("th"), "th", "left_semi"), "sets")
    tested = stash(compared(wanted, sets, threshold), "tested")
    roots = stash(components(tested.where("ok")), "roots")

    root_of = lambda df, c, to: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
    placed = root_of(root_of(large.select("key", "th", F.col("pivot.th").alias("pivot")), "th", "root"), "pivot", "main")
    placed = stash(placed.select("key", "th", "root", (F.col("root") != F.col("main")).alias("open")).union(placed.select("key", F.col("pivot").alias("th"), F.col("main").alias("root"), F.lit(False))).distinct(), "placed")
    doors = placed.where("open").select("key").distinct()
    if doors.isEmpty():
        return roots
    held = placed.join(doors, "key", "left_semi").groupBy("th").agg(F.any_value("root").alias("root"), F.max("open").alias("open"))
    maybe = shared_prefixes(stash(held.join(sets, "th"), "held"), threshold=threshold)
    more = stash(compared(maybe.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, threshold).where("ok").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "more")
    if more.isEmpty():
        return roots
    joined = stash(components(more), "joined")
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    return stash(moved.select("node", F.coalesce("to", "root").alias("root")).union(joined), "roots")


def signed_texts(docs: DataFrame, id_col: str, text_col: str, *, k: int, bands: int, width: int, weighting: str) -> DataFrame:
    """`signatures` of the texts, stored, under the MD5 ``th`` of each."""
    text = text_of(text_col)
    given = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("text"))
    return stash(signatures(given, k=k, bands=bands, width=width, weighting=weighting), "signed")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 100, bands: int = 20, width: int = 5, weighting: str = "binary", small: int = 16) -> DataFrame:
    """``id_col, class_id`` for every row: the least id of its class of near copies.

    Classes are connected components of texts whose shingle similarity reaches ``threshold`` (weighting "binary": sets;
    "tf": a shingle weighs the times it occurs; "log": 1 plus the whole part of the binary logarithm of these, so that
    repeated lines count for more than once without outweighing the rest). Words are runs of anything but ASCII white space. A null text is empty;
    empty texts, and other texts without a word, are only alike if equal. Equal texts share a class. A null id loses to
    any other. Repeated rows each get their row, very long texts are read whole, an empty table gives no rows, and other
    columns are ignored.
    """
    signed = signed_texts(docs, id_col, text_col, k=k, bands=bands, width=width, weighting=weighting)
    roots = near_roots(signed, threshold=threshold, small=small).select(F.col("node").alias("th"), "root")
    labelled = stash(signed.select("id", "th").join(roots, "th", "left").select("id", F.coalesce("root", "th").alias("root")), "labelled")
    named = stash(labelled.groupBy("root").agg(F.min("id").alias("class_id")), "named")
    return labelled.join(named, "root").select(F.col("id").alias(id_col), "class_id")


def one_per_class(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, k: int = 100, bands: int = 20, width: int = 5, weighting: str = "binary", small: int = 16) -> DataFrame:
    """Exactly one row of each class: of its least id, and of the rows that share that id and text the one with the least hash.

    Classes, nulls, empty and long texts as in `near_classes`; all columns stay as they are.
    """
    signed = signed_texts(docs, id_col, text_col, k=k, bands=bands, width=width, weighting=weighting)
    roots = near_roots(signed, threshold=threshold, small=small).select(F.col("node").alias("th"), "root")
    rows = signed.groupBy("th", "id").agg(F.count("*").alias("rows")).join(roots, "th", "left").withColumn("root", F.coalesce("root", "th"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th", "rows")).alias("b"))
    own_id, own_th, n, row = (unused(docs, c) for c in ("id", "th", "n", "row"))
    keep = stash(best.select(F.col("b.id").alias(own_id), F.col("b.th").alias(own_th), F.col("b.rows").alias(n)), "keep")
    th = F.unhex(F.md5(text_of(text_col).cast("binary")))
    hit = lambda kept: docs.join(kept, F.col(id_col).eqNullSafe(F.col(own_id)) & (th == F.col(own_th)))
    one, many = hit(keep.where(F.col(n) == 1)).select(*docs.columns), keep.where(F.col(n) > 1)
    if many.isEmpty():
        return one
    least = hit(many).groupBy(own_id, own_th).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row))
    return one.unionByName(least.select(f"{row}.*"))


def op7_dartminhash(spark, sf_dir: str) -> DataFrame:
    return near_classes(load(spark, sf_dir, "documents").select("doc_id", "text"), weighting="log")

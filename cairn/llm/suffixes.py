"""Removal of byte strings that occur elsewhere, by rounds of growing strings over sampled positions, in place of prefix doubling.

A window is a string of ``length`` bytes. Ranking all positions of a corpus at each offset would sort every byte several times
over, so ranks are kept for sampled positions: a window stands at the k-byte string with the least hash inside it, which equal
windows choose alike. Neighbouring windows mostly choose the same place, so one row (an anchor) stands for a range of
windows. Its rank is the hash of the k bytes there.

Round by round k grows towards ``length``. Spark groups the anchors by rank:

- a rank that occurs once: none of the anchor's windows repeats, it is dropped;
- a rank whose anchors agree in all bytes that their windows cover: all repeat, they are past the threshold;
- anything else is ranked again with a larger k, a range with the same bytes being carried on once.

With k = length each window is its own anchor, so the last round decides what is left. Strings count as equal if two hashes of
64 bits agree: rank and content cover different bytes, and in the last round, where both cover the window, the content is
hashed to another base. Only hashes and places are shuffled by rank, in rows that are counted before they move, and texts move
by their MD5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, release, stash, text_of, unused
from .dartminhash import LETTER, U, mix, powers, tables

CHUNK = 1 << 20
SEGMENT = 1 << 22
PLACE = U((1 << 24) - 1)
OTHER_BASE = 0xD6E8FEB86659FD93


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima inside blocks of that width."""
    n = len(values) - width + 1
    blocks = np.concatenate([values, np.full((-len(values)) % width, U(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(piece, first window, last window, rank, content) of each anchor of the pieces that lie in ``data``.

    Windows are numbered from the start of their piece. ``content`` hashes all bytes that the windows cover and where
    the anchor is among them.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    power, inverse = tables(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[data] * power[: len(data)], dtype=np.uint64)])
    h = mix((total[k:] - total[:-k]) * inverse[: len(data) - k + 1])
    least = least_in_windows((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - k + 1)
    at = (least & PLACE).astype(np.int64)
    piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    owner = piece[first]
    last = np.minimum(last, offsets[owner + 1] - length)
    fits = first <= last
    first, last, owner = first[fits], last[fits], owner[fits]
    place = at[first]
    if k == length:
        steps = powers(OTHER_BASE, length)
        content = np.zeros(len(first), np.uint64)
        for i in range(length):
            content += LETTER[data[first + i]] * steps[i]
        return owner, first - offsets[owner], last - offsets[owner], h[place], mix(content)
    content = mix(mix((total[last + length] - total[first]) * inverse[first]) + ((place - first) * 65_536 + (last - first)).astype(np.uint64))
    return owner, first - offsets[owner], last - offsets[owner], h[place], content


def scan(pieces: DataFrame, length: int, k: int) -> DataFrame:
    """Anchors of ``pieces(ref, base, known, bytes)``: ``rank, content, ref, base, known, first, last``; windows by their place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("bytes").cast(pa.large_binary())
            edges = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            base = batch.column("base").to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(raw):
                end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + CHUNK, side="right")) - 1)
                stop = edges[end] if end - begin > 1 else max(edges[begin] + 1, edges[end] - length + 1)
                for a in range(edges[begin], stop, SEGMENT):  # one turn but for a very long text, whose windows are taken in turns
                    whole = end - begin > 1 or edges[end] - edges[begin] <= SEGMENT + length
                    b = edges[end] if whole else min(edges[end], a + SEGMENT + length - 1)
                    cuts = edges[begin : end + 1] - edges[begin] if whole else np.array([0, b - a])
                    owner, first, last, rank, content = anchors(data[a:b], cuts, length, k)
                    shift = base[begin + owner] + (a - edges[begin])
                    ids = pa.array(begin + owner)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rank.view(np.int64)), pa.array(content.view(np.int64)), batch.column("ref").take(ids), batch.column("base").take(ids), batch.column("known").take(ids), pa.array(first + shift), pa.array(last + shift)],
                        ["rank", "content", "ref", "base", "known", "first", "last"],
                    )
                    if whole:
                        break
                begin = end

    return pieces.select("ref", "base", "known", "bytes").mapInArrow(run, "rank long, content long, ref binary, base long, known boolean, first long, last long")


def resolve(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows that repeat, as ranges ``ref, first, last``; and the ranges that the next round must rank: ``ref, base, first, last, known``."""
    groups = found.groupBy("rank").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"), F.min("known").alias("all_known"))
    groups = stash(groups.where("n > 1").select("rank", (F.col("low") != F.col("high")).alias("mixed"), "all_known").where("NOT all_known").drop("all_known"), "groups")
    met = stash(found.join(groups, "rank"), "met")
    mixed = met.where("mixed")
    place = F.struct("ref", "first", "last", "base")
    kinds = stash(mixed.groupBy("rank", "content").agg(F.count("*").alias("n"), F.max("known").alias("known"), F.min(place).alias("at")), "kinds")
    twice = mixed.where("NOT known").join(kinds.where("n > 1").select("rank", "content"), ["rank", "content"])
    gone = met.where("NOT mixed AND NOT known").select("ref", "first", "last").union(twice.select("ref", "first", "last"))
    return gone, kinds.select("at.*", (F.col("known") | (F.col("n") > 1)).alias("known"))


def cut(pieces: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """The bytes that ranges of windows cover, each a piece of its own."""
    part = F.substring(F.col("bytes"), (F.col("first") - F.col("base") + 1).cast("int"), (F.col("last") - F.col("first") + length).cast("int"))
    return pieces.drop("known").join(ranges, ["ref", "base"]).select("ref", F.col("first").alias("base"), "known", part.alias("bytes"))


def repeated_windows(texts: DataFrame, length: int, steps: tuple[int, ...]) -> DataFrame:
    """``ref, first, last`` of all ranges of windows that start anywhere else too, for ``texts(ref, bytes)``; a range may come twice."""
    pieces = texts.where(F.octet_length("bytes") >= length).select("ref", F.lit(0).cast("long").alias("base"), F.lit(False).alias("known"), "bytes")
    out = None
    for turn, k in enumerate((*steps, length)):
        gone, ranges = resolve(scan(pieces, length, k))
        gone = stash(gone, "gone")
        out = gone if out is None else out.union(gone)
        if k < length:
            # Equal texts are one piece from here on: what repeats is known by its hash.
            pieces = stash(cut(pieces.dropDuplicates(["ref", "base"]) if turn == 0 else pieces, ranges.distinct(), length), "pieces")
        release(texts.sparkSession)
    return out


def carved(text: bytes, first: np.ndarray | None, last: np.ndarray | None, length: int) -> tuple[bytes, int, int, list[dict]]:
    """The text without the bytes of its repeated windows; how many bytes and runs went, and the runs."""
    if first is None or not len(first):
        return text, 0, 0, []
    order = np.argsort(first, kind="stable")
    begin, end = np.asarray(first)[order], np.maximum.accumulate(np.asarray(last)[order] + length)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    begin, end = begin[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]
    kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
    return kept, int((end - begin).sum()), len(begin), [{"begin": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)]


def remove_repeats(docs: DataFrame, *, text_col: str = "text", length: int = 200, steps: tuple[int, ...] = (40, 150, 185)) -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``n_bytes``, ``n_removed``, ``n_spans`` and ``spans`` (removed byte ranges).

    A byte goes if a window that covers it starts anywhere else too, in the same document or another; every place of
    such a window loses it. Texts are UTF-8; null is empty; texts shorter than ``length`` lose nothing. Repeated rows
    and equal texts are separate documents, so they lose all but what is too short. An empty table gives no rows.
    Columns with the new names are replaced, others pass through.
    """
    made = ["kept", "n_bytes", "n_removed", "n_spans", "spans"]
    rest = [c for c in docs.columns if c not in made]
    raw, ref, found, out = (unused(docs, c) for c in ("bytes", "ref", "found", "out"))
    given = docs.select(*rest, text_of(text_col).cast("binary").alias(raw)).withColumn(ref, F.unhex(F.md5(raw)))
    gone = repeated_windows(given.select(F.col(ref).alias("ref"), F.col(raw).alias("bytes")), length, steps)
    spans = stash(gone.groupBy("ref").agg(F.collect_set(F.struct("first", "last")).alias(found)).withColumnRenamed("ref", ref), "spans")
    release(docs.sparkSession)
    joined = given.join(spans, ref, "left")

    @F.pandas_udf("kept binary, n_removed long, n_spans long, spans array<struct<begin:long,end:long>>")
    def carve(texts: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = [carved(t, a, b, length) for t, a, b in zip(texts, first, last, strict=True)]
        return pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans", "spans"])

    done = joined.withColumn(out, carve(raw, F.col(found)["first"], F.col(found)["last"]))
    return done.select(*rest, F.octet_length(raw).cast("long").alias("n_bytes"), f"{out}.*")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

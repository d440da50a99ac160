"""Alignment of two tokenizations of one text: groups of tokens between the places where both end a token.

Every token points to its farthest-right overlapping token: the one of the other tokenization that has its last byte. Where both
end together, the token of the first tokenizer points to itself. Doubling these successors (each token takes its successor's
successor) leads every token to the last token of its component, which is the label of its group.

Both tokenizers cut a text before white space that follows something else, so a text is a row of units that are encoded and
aligned each by itself. A worker takes its texts in slices; units that are not in its cache are encoded together, and the
doubling runs over all their tokens at once. The cache is emptied when it has too many units or characters.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import load, stash, unused
from .pieces import SPACE, default_model, slices

#: A unit begins with white space that starts with a blank, tab or line feed, or with the text. Other white space joins units: pieces like
#: ";\r" span its start.
UNIT = re.compile(r"\s*\S+(?:[^\S \t\n]\s*\S+)*(?:[^\S \t\n]\s*\Z)?|\s+")


# Fixed value: where byte-level tokenizers cut a text before merging.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_bytes_model() -> str:
    """The place of the public 50k byte-level BPE on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for 256 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def group_labels(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two tokenizations of the same bytes, by where their tokens end: the number of the last A token of each token's group."""
    n = len(ends_a)
    over = np.searchsorted(ends_b, ends_a)
    farthest = np.where(ends_b[over] > ends_a, n + over, np.arange(n)) if n else over
    after = np.concatenate([farthest, np.searchsorted(ends_a, ends_b)])
    while True:
        doubled = after[after]
        if np.array_equal(doubled, after):
            return after[:n], after[n:]
        after = doubled


def bytes_encoder(a_json: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """How a byte-level BPE encodes, special tokens' strings as text; and the bytes of its ids."""
    model, letter = json.loads(a_json), byte_letters()
    before, entries = model.get("pre_tokenizer") or {}, model["model"]["vocab"]
    if model.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        raise ValueError("A must be a byte-level tokenizer that cuts at white space, without normalizer and prefix space")
    spelled = {i: bytes(letter[c] for c in t) for t, i in entries.items()}
    known = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    if all(entries["".join(m)] == 256 + k for k, m in enumerate(merges)):  # ids are ranks
        coder = tiktoken.Encoding("A", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks={t: i for i, t in spelled.items()}, special_tokens={})
        return coder.encode_ordinary, known
    coder = Tokenizer.from_str(a_json)
    coder.encode_special_tokens = True
    return lambda text: coder.encode(text, add_special_tokens=False).ids, known


class Aligner:
    """Both tokenizers, and a bounded cache of units: the groups of each as text, its counts, and the id pairs that end together."""

    def __init__(self, a_json: str, b_model: bytes, cache_units: int = 400_000, cache_chars: int = 8_000_000):
        self.limits = cache_units, cache_chars
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.encode_a, self.a_bytes = bytes_encoder(a_json)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(r"\S[ \t\n]", p.replace(SPACE, " ")) for p in pieces):
            raise ValueError("a piece spans the start of white space: units cannot be encoded each by itself")
        self.before = len(self.b.encode("x"))
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        # Ids as text with what follows them: inside a group, at the end of its A part, at its end.
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.names_a = names(len(self.a_bytes), ","), names(len(self.a_bytes), "|")
        self.names_b = names(len(self.b_bytes), ","), names(len(self.b_bytes), ";")
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0
        self.groups: list[str | None] = []  # each group ends with ";"; None: the bytes of the tokens are not those of the unit
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A, of B, and groups
        self.pairs, self.edges = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of units in a row, which begin with white space; None if the tokens of A or B do not spell them."""
        a, b, raw = self.encode_a(text), self.b.encode("x" + text)[self.before :], text.encode()  # " x" is a unit of its own
        return (a, b) if b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b)) else None

    def encoded(self, units: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
        """Units with their ids, many at a time; those that are not spelled come without ids."""
        alone = [u for u in units if u[-1].isspace() or SPACE in u]  # white space may only be followed by the end of a text
        rest = [u for u in units if not (u[-1].isspace() or SPACE in u)]
        parts = [rest[k : k + 2000] for k in range(0, len(rest), 2000)] + [[u] for u in alone]
        while parts:
            part = parts.pop()
            found = self.encode("".join(part))
            if found or len(part) == 1:
                yield part, *(found or ([], []))
            else:
                parts += [part[: len(part) // 2], part[len(part) // 2 :]]

    def learn(self, units: list[str]) -> None:
        """Encode and align units, all at once."""
        order, a, b = [], [], []
        for part, x, y in self.encoded(units):
            order += part
            a += x
            b += y
            if not x:
                self.index[order.pop()] = len(self.groups)
                self.groups.append(None)
        self.held += sum(map(len, units))
        self.counts = np.concatenate([self.counts, np.zeros((len(self.groups) - len(self.counts), 3), np.int64)])
        self.edges = np.concatenate([self.edges, np.full(len(self.groups) + 1 - len(self.edges), self.edges[-1])])
        if not order:
            return
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        label_a, label_b = group_labels(ends_a, ends_b)
        closes_a, closes_b = (np.concatenate([x[1:] != x[:-1], [True]]) for x in (label_a, label_b))
        # All tokens in a row, group after group, of A first: how many come before each group, and before each unit.
        names = np.concatenate([np.where(closes_a, self.names_a[1][a], self.names_a[0][a]), np.where(closes_b, self.names_b[1][b], self.names_b[0][b])])
        names = names[np.argsort(np.concatenate([2 * label_a, 2 * label_b + 1]), kind="stable")].tolist()
        ends = np.cumsum([len(u.encode()) for u in order])
        to_a, to_b, to_group = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1, np.searchsorted(ends_a[closes_a], ends) + 1
        begin = 0
        for u, end in zip(order, (to_a + to_b).tolist(), strict=True):
            self.index[u] = len(self.groups)
            self.groups.append("".join(names[begin:end]))
            begin = end
        sizes = np.stack([np.diff(x, prepend=0) for x in (to_a, to_b, to_group)], 1)
        self.counts = np.concatenate([self.counts, sizes])
        self.pairs = np.concatenate([self.pairs, a[closes_a] * len(self.b_bytes) + b[closes_b]])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes[:, 2])])

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The columns of ALIGNED, and ``groups``, for some texts."""
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.index)
        if new and (len(self.index) + len(new) > self.limits[0] or self.held > self.limits[1]):
            self.forget()
            new = set().union(*cut)
        if new:
            self.learn(sorted(new))
        rows = [list(map(self.index.__getitem__, units)) for units in cut]
        groups = [[self.groups[i] for i in row] for row in rows]
        rows = [[] if None in g else row for row, g in zip(rows, groups, strict=True)]
        groups = ["" if None in g else "".join(g)[:-1] for g in groups]
        unit, doc = np.array([i for row in rows for i in row], np.int64), np.repeat(np.arange(len(rows)), [len(row) for row in rows])
        n_a, n_b, n_groups = (np.bincount(doc, self.counts[unit, k], len(rows)).astype(np.int64) for k in range(3))
        # How often each text has each unit, then each pair of ids.
        key, times = np.unique(doc * len(self.groups) + unit, return_counts=True)
        doc, unit = np.divmod(key, max(1, len(self.groups)))
        size = self.edges[unit + 1] - self.edges[unit]
        pair = self.pairs[np.repeat(self.edges[unit], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        doc, times = np.repeat(doc, size), np.repeat(times, size)
        order = np.lexsort((pair, doc))
        doc, pair, times = doc[order], pair[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])])) if len(doc) else doc
        times = np.add.reduceat(times, first) if len(first) else times
        edges = pa.array(np.searchsorted(doc[first], np.arange(len(rows) + 1)).astype(np.int32))
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "groups": pa.array(groups, pa.string()),
            "groups_sha256": pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string()),
            "pairs": pa.ListArray.from_arrays(edges, pa.array(pair[first])), "times": pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
        }


@cache
def aligner(a_json: str, b_model: bytes) -> Aligner:
    """One for each Python worker and pair of tokenizers."""
    return Aligner(a_json, b_model)


#: What align_tokenizers() can add, and the type of each.
ALIGNED = {"n_a": "long", "n_b": "long", "n_groups": "long", "groups": "string", "groups_sha256": "string", "pairs": "array<long>", "times": "array<int>"}


def align_tokenizers(docs: DataFrame, *, text_col: str = "text", a_path: str | None = None, b_path: str | None = None, add: tuple[str, ...] = tuple(ALIGNED)) -> DataFrame:
    """``docs`` with the columns named by ``add``: how a space and the text fall into groups of A tokens and B tokens.

    A is a byte-level BPE (a tokenizers file), B a SentencePiece BPE model that puts a space before the text. ``groups`` is
    ``a1,a2|b1;a3|b2,b3``: ids of A and B between two places where tokens of both end. ``pairs`` are the pairs of ids that end
    together, each once, as A id times the size of B's vocabulary plus B id; ``times`` says how often each is linked in the text.

    Null and empty texts, and texts that the tokens of A or B do not spell byte for byte, have no tokens: zeros, empty texts and
    arrays. Texts of any length are aligned whole, each alone, so repeated rows get equal values; an empty table stays empty.
    The files are read on the driver and sent to the workers. Columns with the new names are replaced, others pass through.
    """
    with open(a_path or default_bytes_model(), encoding="utf-8") as a, open(b_path or default_model(), "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    @F.arrow_udf(f"struct<{', '.join(f'{c}: {ALIGNED[c]}' for c in add)}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = aligner(*shared.value)
        for batch in batches:
            for texts in slices(batch):
                made = both.align(texts)
                yield pa.StructArray.from_arrays([made[c] for c in add], list(add))

    out = unused(docs, "aligned")
    made = docs.select(*[c for c in docs.columns if c not in add], run(F.col(text_col)).alias(out))
    return made.select(*[c for c in made.columns if c != out], *[F.col(out)[c].alias(c) for c in add])


def link_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n`` over all rows: how many links hold the pair.

    Of two tokens that end together one's bytes end the other's, so the vocabularies bound the number of pairs (some
    400,000 for the public files), whatever the size of the corpus.
    """
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("link"))
    return links.groupBy(F.col("link.pairs").alias("pair")).agg(F.sum("link.times").alias("n"))


def with_link_statistics(aligned: DataFrame, size_b: int) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` (links whose pair is the B id's most frequent one, ties included) and ``count_sum``
    (the counts of their pairs over all rows, summed over links); ``pairs`` and ``times`` go. Rows without links get zeros."""
    counts = link_counts(aligned).toArrow()  # bounded, see link_counts()
    pair, n = counts["pair"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    best = np.zeros(size_b, np.int64)
    np.maximum.at(best, pair % size_b, n)
    shared = aligned.sparkSession.sparkContext.broadcast((pair, n, n == best[pair % size_b]))

    @F.arrow_udf("struct<n_links: long, n_best: long, count_sum: long>")
    def run(pairs: pa.Array, times: pa.Array) -> pa.Array:
        known, counted, is_best = shared.value
        at = np.searchsorted(known, pairs.flatten().to_numpy())
        t = times.flatten().to_numpy().astype(np.int64)
        edges = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
        return pa.StructArray.from_arrays([pa.array(total(t)), pa.array(total(t * is_best[at])), pa.array(total(t * counted[at]))], ["n_links", "n_best", "count_sum"])

    out = unused(aligned, "counted")
    made = aligned.select(*[c for c in aligned.columns if c not in ("pairs", "times")], run("pairs", "times").alias(out))
    return made.select(*[c for c in made.columns if c != out], f"{out}.*")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = stash(align_tokenizers(docs, add=("n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times")).drop("text"), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_file=default_model()).get_piece_size()
    return with_link_statistics(aligned, size_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

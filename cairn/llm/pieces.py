"""SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a text the last token of its encoding is unique: it is the one vocabulary entry that ends there and
stands compatibly after the last token of the prefix before it. An Aho-Corasick automaton lists the entries that end at each
place, a pair test picks the one that fits, and the ids are read off backwards.

Two entries are compatible if encoding their joined text gives back just these two. The test is run once for each pair and
then looked up.

A worker takes its texts in slices. The units of a slice (words, mostly) that are not in its cache are encoded together: the
automaton runs over them once, and the table is filled in numpy for all of them at a time, place by place.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, unused

SPACE = "▁"
#: A token of this or less stands for a code point outside the vocabulary: -1 minus the code point.
OUTSIDE = -1
#: Stands between units where many are matched at once; no entry may contain it.
BETWEEN = "\U0010ffff"
#: Units up to this length are encoded together and kept in the cache.
SHORT = 48
SLICE = 1 << 18
#: Texts by which a model is told that this table does not stand for: wide and joined letters, accents apart, blanks at the ends and in rows.
PROBES = ("Ａ ﬁ ① e\u0301", "  two  blanks ", "the unbelievable internationalization of antidisestablishmentarianism", "line\n\tline", "\u00a0\u3000x", "日本語 ñandú")


def default_model() -> str:
    """The place of the public 32k BPE model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """The vocabulary of one model with its automaton, and tables of known pairs and units, both of bounded size."""

    def __init__(self, model: bytes, cache_units: int = 200_000, cache_pairs: int = 2_000_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.limits = cache_units, cache_pairs
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(len(self.pieces)) if i not in self.byte_of and i not in self.special]
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        # A prefix has one last token, so a single code point is it where no longer entry fits; only those need matching.
        self.letter = OUTSIDE - np.arange(0x110000, dtype=np.int32)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i in plain:
            if len(self.pieces[i]) == 1:
                self.letter[ord(self.pieces[i])] = i
            elif self.merged(self.pieces[i]) == [self.pieces[i]]:
                self.automaton.add_word(self.pieces[i], i << 8 | len(self.pieces[i]))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.score))
        assert self.longest < 256 and not any(BETWEEN in p for p in self.score)
        # Text may be cut before a space mark that follows something else, and around a line feed, if no entry spans these.
        cuttable = not any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.score)
        self.unit = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if cuttable else r"(?s).+")
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.forget()
        # Another kind of model, or one that normalizes or trims its texts, gives other ids for some of these.
        for text in PROBES:
            if next(self.both([text]))[0] != ",".join(map(str, sp.encode(text))):
                raise ValueError("not a byte pair model that takes texts as they are: its ids would differ")

    def forget(self) -> None:
        """Empty the unit cache: the ids of each unit joined by commas, and what its ids decode to where that is not the unit."""
        self.units: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def merged(self, text: str) -> list[str]:
        """Byte pair merging as defined: join the best-scored neighbours, leftmost first, until none can be joined."""
        never, score = float("-inf"), self.score
        parts = list(text)
        gain = [score.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while gain:
            best = max(gain)
            if best == never:
                break
            i = gain.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gain[i]
            if i:
                gain[i - 1] = score.get(parts[i - 1] + parts[i], never)
            if i < len(gain):
                gain[i] = score.get(parts[i] + parts[i + 1], never)
        return parts

    def fits(self, left: int, right: int) -> bool:
        """The pair test."""
        a, b = self.pieces[left], self.pieces[right]
        return self.merged(a + b) == [a, b]

    def fit_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pair test for many pairs, each distinct one made once and then kept in a sorted table."""
        keys = left * len(self.pieces) + right
        distinct, which = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, distinct)
        new = np.flatnonzero(self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] != distinct) if len(self.pair_keys) else np.arange(len(distinct))
        if len(new):
            fresh = distinct[new]
            known = np.array([self.fits(int(k) // len(self.pieces), int(k) % len(self.pieces)) for k in fresh])
            if len(self.pair_keys) + len(fresh) > self.limits[1]:  # start again with the pairs at hand
                kept = np.setdiff1d(np.arange(len(distinct)), new)
                self.pair_keys, self.pair_fits = distinct[kept], self.pair_fits[at[kept]]
            to = np.searchsorted(self.pair_keys, fresh)
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, to, fresh), np.insert(self.pair_fits, to, known)
            at = np.searchsorted(self.pair_keys, distinct)
        return self.pair_fits[at][which]

    def tokens(self, text: str) -> list[int]:
        """The tokens of one text of any length: the table from left to right, the ids from right to left."""
        size = len(text)
        last = [OUTSIDE, *self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()]
        length = [1] * (size + 1)
        pairs: dict[tuple[int, int], bool] = {}
        for end, match in self.automaton.iter(text):
            end += 1
            if length[end] > 1:
                continue
            token, n = match >> 8, match & 255
            before = last[end - n]
            if before > OUTSIDE:
                known = pairs.get((before, token))
                if known is None:
                    known = pairs[before, token] = self.fits(before, token)
                if not known:
                    continue
            last[end], length[end] = token, n
        out = []
        while size:
            out.append(last[size])
            size -= length[size]
        return out[::-1]

    def tokens_of_all(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of many short units one after another, and where those of each unit end."""
        joined = BETWEEN.join(units)
        sizes = np.array([len(u) for u in units], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, token, n = found[:, 0] + 1, found[:, 1] >> 8, found[:, 1] & 255
        begin = end - n
        home = starts[np.searchsorted(starts, end - 1, side="right") - 1]
        opens = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        turn = np.arange(len(end)) - np.repeat(opens, np.diff(np.concatenate([opens, [len(end)]])))
        # last[p]: the last token of the prefix that ends before place p; matches of a place come longest first.
        last, length = np.concatenate([[OUTSIDE], self.letter[codes]]).astype(np.int64), np.ones(len(codes) + 1, np.int64)
        last[starts] = OUTSIDE
        step = ((end - home) * self.longest + turn).astype(np.int16 if (SHORT + 1) * self.longest < 1 << 15 else np.int64)  # small numbers sort faster
        order = np.argsort(step, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(step[order])) + 1):
            m = group[length[end[group]] == 1]
            before = last[begin[m]]
            ok = before <= OUTSIDE
            ask = np.flatnonzero(~ok)
            if len(ask):
                ok[ask] = self.fit_pairs(before[ask], token[m[ask]])
            m = m[ok]
            last[end[m]], length[end[m]] = token[m], n[m]
        ends = np.zeros(len(last), bool)
        at, floor = starts + sizes, starts
        while len(at):
            ends[at] = True
            at = at - length[at]
            live = at > floor
            at, floor = at[live], floor[live]
        places = np.flatnonzero(ends)
        return last[places], np.searchsorted(places, starts + sizes, side="right")

    def ids(self, tokens: list[int]) -> list[int]:
        """Tokens with code points outside the vocabulary as bytes, or as one unknown for a run of them."""
        out = []
        for t in tokens:
            if t > OUTSIDE:
                out.append(t)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chr(OUTSIDE - t).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def surface(self, ids: list[int]) -> str:
        """The text of ids with space marks as spaces; runs of byte tokens are read as UTF-8."""
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if i is not None and i not in self.special:
                out.append(self.pieces[i].replace(SPACE, " "))
            elif i is not None and i == self.unknown:
                out.append(" ⁇ ")
        return "".join(out)

    def learn(self, units: list[str]) -> None:
        """Encode units and decode their ids again."""
        tokens, ends = self.tokens_of_all([u for u in units if len(u) <= SHORT])
        tokens, ends = tokens.tolist(), iter(ends.tolist())
        begin = 0
        for unit in units:
            if len(unit) <= SHORT:
                end = next(ends)
                ids, begin = tokens[begin:end], end
            else:
                ids = self.tokens(unit)
            if min(ids) <= OUTSIDE:
                ids = self.ids(ids)
                text = self.surface(ids)
            else:
                text = "".join([self.pieces[i] for i in ids])
            self.units[unit] = ",".join([self.names[i] for i in ids])
            if text != unit:
                self.odd[unit] = text

    def both(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """For each text its ids joined by commas, and the text decoded from them; the mark put before the text is dropped."""
        cut = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.units)
        if new and len(self.units) + len(new) > self.limits[0]:
            self.forget()
            new = set().union(*cut)
        if new:
            self.learn(sorted(new))
        for units in cut:
            decoded = "".join([self.odd.get(u, u) for u in units] if self.odd else units)
            yield ",".join(map(self.units.__getitem__, units)), decoded.replace(SPACE, " ")[1:]
        for unit in [u for u in new if len(u) > SHORT]:
            del self.units[unit]
            self.odd.pop(unit, None)

    def decode(self, ids: list[int]) -> str:
        text = self.surface(ids)
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and self.pieces[first].startswith(SPACE) else text


@cache
def table(model: bytes) -> PieceTable:
    """One table for each Python worker and model."""
    return PieceTable(model)


def slices(column: pa.Array) -> Iterator[list]:
    """The values of a text column, a few at a time, so that a batch is never turned into Python strings as a whole."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SLICE, side="right")))
        yield column.slice(begin, end - begin).to_pylist()
        begin = end


#: What encode_decode() can add, and the type of each.
MADE = {"piece_ids": "string", "n_pieces": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_decode(docs: DataFrame, *, text_col: str = "text", model_path: str | None = None, add: tuple[str, ...] = ("piece_ids", "n_pieces", "decoded")) -> DataFrame:
    """``docs`` with the columns named by ``add``, in that order.

    ``piece_ids`` (decimal ids joined by commas), ``n_pieces``, ``decoded``, and the hex digests ``ids_sha256`` and
    ``decoded_sha256`` of the two texts. A null or empty text has no ids and decodes to an empty text. Texts of any length
    are encoded whole, each alone: repeated rows get equal values, an empty table stays empty. The model file is
    read on the driver and sent to the workers. Columns with the new names are replaced, all others pass through.
    """
    with open(model_path or default_model(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    make = {
        "piece_ids": lambda ids, text: ids,
        "n_pieces": lambda ids, text: ids.count(",") + 1 if ids else 0,
        "decoded": lambda ids, text: text,
        "ids_sha256": lambda ids, text: digest(ids),
        "decoded_sha256": lambda ids, text: digest(text),
    }
    kinds = [pa.int64() if c == "n_pieces" else pa.string() for c in add]

    @F.arrow_udf(f"struct<{', '.join(f'{c}: {MADE[c]}' for c in add)}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = table(shared.value)
        for batch in batches:
            for texts in slices(batch):
                rows = [[make[c](*pair) for c in add] for pair in pieces.both(texts)]
                yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], list(add))

    made = docs.select(*[c for c in docs.columns if c not in add], run(F.col(text_col)).alias(out := unused(docs, "made")))
    return made.select(*[c for c in made.columns if c != out], *[F.col(out)[c].alias(c) for c in add])


def decode_ids(rows: DataFrame, *, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded`` from an array of ids; null or empty gives an empty text."""
    with open(model_path or default_model(), "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = table(shared.value)
        for column in batches:
            yield pa.array(["" if ids is None else pieces.decode(ids) for ids in column.to_pylist()], pa.string())

    return rows.withColumn("decoded", run(F.col(ids_col)))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode_decode(load(spark, sf_dir, "documents").select("doc_id", "text"), add=("n_pieces", "ids_sha256", "decoded_sha256"))
    return out.withColumnRenamed("n_pieces", "n_tokens")

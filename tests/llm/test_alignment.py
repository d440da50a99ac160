"""Token alignment against both libraries and plain loops over byte offsets."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cairn.llm import alignment, pieces

A_PATH, B_PATH = alignment.default_bytes_model(), pieces.default_model()
ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", "a ", " a", "a  b", "a\n\nb ", "tab\tand\r\nmore x y　", "a!\x1cb \x85 c", "it's we'll I'd", "12 345,678.9",
    "<|endoftext|> stays text", "<s> </s> <unk> <0x41>", "naïve Straße 東京都 日本語", "👩‍👩‍👧 🇩🇪", "mark ▁ inside", "▁", "nul \x00 x", "x" * 300, "word " * 200 + "\n", "á̂ e​f", "    lead", " ", "x \n ",
]


def decoder():
    letters = alignment.byte_letters()
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in a.get_vocab().items()}


def brute(texts):
    """Per text (A ids, B ids, groups), by sets of byte offsets where tokens end."""
    a, a_bytes = decoder()
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [a_bytes[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append(([], [], []))
            continue
        ends_a, ends_b = ({sum(map(len, x[: k + 1])): k for k in range(len(x))} for x in (bytes_a, bytes_b))
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append((ids_a[p : ends_a[end] + 1], ids_b[q : ends_b[end] + 1]))
            p, q = ends_a[end] + 1, ends_b[end] + 1
        out.append((ids_a, ids_b, groups))
    return out


def rows(texts):
    aligned = brute(texts)
    counts = collections.Counter((x[-1], y[-1]) for _, _, groups in aligned for x, y in groups)
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    for a, b, groups in aligned:
        links = [(x[-1], y[-1]) for x, y in groups]
        named = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sha = hashlib.sha256(named.encode()).hexdigest() if named else ""
        yield len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), sha


def test_labels_by_doubling_are_those_of_a_loop():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 60)
        a, b = (np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randint(0, n - 1)), n})) for _ in range(2))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        want = [[int(np.flatnonzero(a == next(e for e in both if e >= end))[0]) for end in x] for x in (a, b)]
        assert [x.tolist() for x in alignment.group_labels(a, b)] == want


@pytest.mark.parametrize("limit", [200_000, 3])
def test_groups_of_odd_texts(limit):
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        both = alignment.Aligner(a.read(), b.read(), cache_units=limit)
    for texts in (ODD, ODD[::-1], [t for t in ODD for _ in range(2)]):
        got = both.align(texts)
        for k, (a, b, groups) in enumerate(brute(texts)):
            assert got["groups"][k].as_py() == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups), texts[k]
            assert (got["n_a"][k].as_py(), got["n_b"][k].as_py(), got["n_groups"][k].as_py()) == (len(a), len(b), len(groups))
            pairs = collections.Counter(x[-1] * 32_000 + y[-1] for x, y in groups)
            assert dict(zip(got["pairs"][k].as_py(), got["times"][k].as_py(), strict=True)) == pairs


def test_query_equals_the_libraries(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (7, "again"), (7, "again")], "doc_id long, text string")
    table.union(extra).write.parquet(f"{tmp_path}/documents.parquet")
    data = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = sorted(map(repr, ((r.doc_id, *row) for r, row in zip(data, rows([r.text for r in data]), strict=True))))
    assert sorted(repr(tuple(r)) for r in alignment.op11_token_alignment(spark, str(tmp_path)).collect()) == want


def test_clashing_columns_and_an_empty_table(spark):
    df = spark.createDataFrame([("a b", 5, "x")], "text string, n_a int, _aligned string")
    got = alignment.align_tokenizers(df)
    assert got.columns == ["text", "_aligned", *alignment.ALIGNED] and got.first()._aligned == "x"
    none = alignment.align_tokenizers(df.limit(0))
    assert alignment.with_link_statistics(none, 32_000).count() == 0

"""Periodic runs against their definition, place by place."""

import hashlib
import random
import re
import zlib

import pytest

from cairn.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """For each period the stretches of places that equal the place one period on; those with a smaller period go."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def wrapped(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def noisy(rnd):
    """Words with nested periods, breaks and overlaps."""
    out = []
    for _ in range(rnd.randint(1, 5)):
        part = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))]
        part = (part * rnd.randint(1, 9))[: rnd.randint(1, 60)]
        if rnd.random() < 0.3:
            part[rnd.randrange(len(part))] = "x"
        out += part * rnd.randint(1, 3)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_the_definition(seed):
    rnd = random.Random(seed)
    texts = [noisy(rnd) for _ in range(60)] + [[], ["a"], ["a"] * 12, ["a"] * 11, list("ab") * 6, list("abcdef") * 2]
    text, *run = periodic.runs_of([[w.encode() for w in t] for t in texts])
    got = {}
    for k, *r in zip(text.tolist(), *[c.tolist() for c in run], strict=True):
        got.setdefault(k, []).append(tuple(r))
    for k, words in enumerate(texts):
        assert got.get(k, []) == brute_runs(words), words


def test_no_word_at_all():
    assert [len(c) for c in periodic.runs_of([])] == [0] * 4
    assert [len(c) for c in periodic.runs_of([[], []])] == [0] * 4


def test_runs_of_a_very_long_text():
    words = [b"w"] * 60_000 + [b"x"] + [b"%d" % (k % 700) for k in range(40_000)]
    found = list(zip(*[c.tolist() for c in periodic.runs_of([words])], strict=True))
    assert found == [(0, 0, 60_000, 1), (0, 60_001, 40_000, 700)]


def test_columns_of_odd_rows(spark):
    texts = ["la " * 20, None, "", " \n\t", "la " * 20, "é ü x", "a\x1cb " * 12, "one two three " * 5 + "end"]
    df = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    got = {r.doc_id: r for r in periodic.find_runs(df).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert got[i].n_words == len(words) and got[i].collapsed == brute_collapsed(words, brute_runs(words))
        assert [tuple(r) for r in got[i].runs] == brute_runs(words)
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, small, tmp_path):
    table = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["w " * 40, None, "", "x"] * 8)] + [(None, "a b " * 30)], "doc_id long, text string")
    table.select("doc_id", "text").union(extra).union(extra.limit(3)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want = []
    for r in rows:
        words = wrapped(WORD.findall(r.text or ""), "" if r.doc_id is None else r.doc_id)
        if len(words) > 1500:
            continue
        runs = brute_runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        row = (r.doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(brute_collapsed(words, runs)))
        want.append(row)
    got = [tuple(r) for r in periodic.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert len(got) == len(rows)
    assert not set(want) - set(got) and len(want) > 150

"""Every dealt operator on small tables: nulls, empty texts, ties, repeated rows, empty tables, clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import components, dartminhash, imatch, langid, lines, mixing, pieces, quality, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), (sources or {}).get(i, "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def table(df, *names, key="doc_id"):
    return {r[key]: tuple(r[n] for n in names) for r in df.collect()}


def sample(n, seed=0, vocabulary=300):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rnd.choice(words) for _ in range(n))


# 2: mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        rest = {s: left * weight[s] / sum(weight[t] for t in names if t not in full) for s in names if s not in full}
        over = [s for s in rest if rest[s] > epochs * sizes[s] + 1e-9]
        if not over:
            return full | rest
        for s in over:
            full[s] = epochs * sizes[s]
            left -= full[s]


def test_mix_targets_and_copies(spark):
    rnd = random.Random(5)
    texts = [sample(rnd.randint(0, 60), i) for i in range(120)] + [None, "", "x"]
    sources = {i: rnd.choice(["a", "a", "a", "b", "É", "z", None]) for i in range(len(texts))}
    df = docs(spark, texts, sources).withColumn("size", F.lit("clash"))
    got = {r.doc_id: r for r in mixing.plan_mix(df).collect()}
    sizes = collections.Counter()
    for i, t in enumerate(texts):
        sizes[sources.get(i)] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), collections.Counter()
    assert len(got) == len(texts)
    for i, r in got.items():
        assert r.target == pytest.approx(want[sources.get(i)]) and 0 <= r.taken <= 2 * r.size
        taken[sources.get(i)] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    rows = mixing.mix(df).collect()
    assert sum(len(WORD.findall(r.text or "")) for r in rows) == sum(taken.values())
    assert {r["size"] for r in rows} == {"clash"}
    again = {r.doc_id: r for r in mixing.plan_mix(df).collect()}
    assert all(again[i].positions == got[i].positions for i in got)


def test_mix_positions_follow_the_schedule(spark):
    u = [i / 40 for i in range(41)]
    df = spark.createDataFrame([(x,) for x in u], "u double")
    for rank, density in enumerate(mixing.SCHEDULES):
        for r in df.select("u", mixing.invert_schedule(F.col("u"), F.lit(rank)).alias("t")).collect():
            grid = np.linspace(0, r.t, 2001)
            assert np.trapezoid(np.interp(grid, mixing.KNOTS, density), grid) == pytest.approx(r.u, abs=1e-5)


def test_mix_repeated_rows_and_empty(spark):
    df = docs(spark, ["a b c", "a b c"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert mixing.plan_mix(df).agg(F.sum("taken")).first()[0] == 9
    assert mixing.plan_mix(docs(spark, [])).count() == 0


def test_mix_emits_repeated_and_null_rows_as_planned(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "g h i"), (None, "g h i"), (None, "k l m"), (2, "n o p q"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    got = [r.text for r in mixing.mix(df).collect()]
    assert sum(len(WORD.findall(t)) for t in got) == mixing.plan_mix(df).agg(F.sum("taken")).first()[0] == 33
    assert max(collections.Counter(got).values()) <= 4 and mixing.mix(df).columns == df.columns


# 6: quality


def brute_repeat(words):
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(cover)


def test_quality_counts(spark):
    texts = ["the cat sat on the mat and looked at the dog for a while", None, "", " \n ", "a b c d e f a b c d e f", "x " * 40, "l1 w w\nl1 w w\n\nl1 w w\n" + sample(30), "# $ | <x>", "one two", sample(3000, 1) + "\n" + sample(3000, 1)]
    got = table(quality.quality_rules(docs(spark, texts).withColumn("kept", F.lit(5))), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(texts):
        w, ls = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        rep = brute_repeat(w)
        assert got[i] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), rep, len(w) < 10 or 100 * rep > 20 * len(w))
    kept = table(quality.quality_rules(docs(spark, texts)), "kept")
    assert kept[0] == (True,) and kept[1] == (False,)


# 5: lines


def brute_lines(texts):
    seen, gone = set(), {}
    for i, t in enumerate(texts):
        ls = [(x.strip(" \t\n\v\f\r"), n) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
        drop = set()
        for j in range(len(ls) - 2):
            key = tuple(s for s, _ in ls[j : j + 3])
            if key in seen:
                drop |= {n for _, n in ls[j : j + 3]}
            seen.add(key)
        gone[i] = drop
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]) for i, t in enumerate(texts)}


def test_lines(spark):
    texts = ["a\nb\nc\nd", "x\n a \n\nb\nc\ny", None, "", "a\nb", "p\nq\nr\np\nq\nr\ns", "same", "same", "a\nb\nc\nd"]
    df = docs(spark, texts).withColumn("gone", F.lit("clash"))
    got = table(lines.dedup_lines(df), "text")
    assert {i: t for i, (t,) in got.items()} == brute_lines(texts)
    kept = {r.doc_id: r for r in lines.without_repeats(df).collect()}
    assert 8 not in kept and 7 in kept and kept[1].text == "x\n\ny" and kept[1].n_chars == 4 and kept[2].text in (None, "")
    assert lines.dedup_lines(docs(spark, [])).count() == 0


# 7: near-dedup


def jaccard(a, b):
    def s(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    x, y = s(a), s(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def brute_classes(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


def edited(text, n, seed):
    w, rnd = text.split(), random.Random(seed)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def near_texts():
    base = [sample(200, s) for s in range(6)]
    out = base + [edited(b, k, k) for b in base for k in (1, 3, 5, 12)]
    hub = sample(150, 77)
    return out + [hub] + [edited(hub, 2, 100 + k) for k in range(40)] + [None, "", "short text", "short text", "short texts", base[0]]


def test_near_classes(spark):
    texts = near_texts()
    got = {r.doc_id: r.class_id for r in dartminhash.near_classes(docs(spark, texts).withColumn("class_id", F.lit(1))).collect()}
    assert got == brute_classes(texts)
    one = dartminhash.one_per_class(docs(spark, texts))
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(got.values())) and one.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert dartminhash.near_classes(docs(spark, [])).count() == 0


def test_one_row_per_class_of_repeated_and_null_rows(spark):
    base = sample(80)
    rows = [(1, base, "x"), (1, base, "x"), (1, base, "y"), (1, sample(80, 5), "z"), (None, sample(80, 6), "x"), (None, sample(80, 6), "y"), (None, edited(sample(80, 6), 1, 3), "x"), (None, base, "x")]
    df = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    got = dartminhash.one_per_class(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None"]
    assert {r.text for r in got if r.doc_id} == {base, rows[3][1]}


def test_separate_pairs_of_one_large_bucket(spark):
    """Pairs that share a bucket with many unlike texts of one template; the unlike ones come first as pivots."""

    def row(name, keys):
        packed = np.sort(np.array(keys, np.uint32)).tobytes()
        return bytearray(f"{name:016}".encode()), len(keys), [7], bytearray(packed)

    rows, want = [], set()
    for i in range(60):
        own = [1000 + 100 * i + k for k in range(50)]
        rows.append(row(2 * i, [*range(50), *own]))
        if i < 30:
            rows.append(row(2 * i + 1, [*range(50), *own[:45]]))
            want.add((2 * i, 2 * i + 1))
    signed = spark.createDataFrame(rows, "th binary, n long, bands array<long>, shingles binary")
    roots = dartminhash.near_roots(signed, threshold=0.8)
    assert {(int(r.root), int(r.node)) for r in roots.collect()} == want


def test_weighted_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = rng.exponential(2, 300) * (rng.random(300) < 0.8)
    b = np.where(rng.random(300) < 0.7, a, rng.exponential(2, 300))
    x, y = np.flatnonzero(a > 0), np.flatnonzero(b > 0)
    element = dartminhash.mix(np.concatenate([x, y]).astype(np.uint64) + np.uint64(7))
    s = dartminhash.dart_signatures(np.repeat([0, 1], [len(x), len(y)]), element, np.concatenate([a[x], b[y]]), 2, 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_counted_shingles(spark):
    texts = ["a b c d e " * 30, "a b c d e " * 29, sample(80)]
    got = {r.doc_id: r.class_id for r in dartminhash.near_classes(docs(spark, texts), weighting="tf").collect()}
    assert got[0] == got[1] == 0 and got[2] == 2


def test_counted_shingles_with_damped_weights(spark):
    """A phrase repeated very often neither makes unlike texts alike nor counts only once."""
    texts = [f"{'very same words again and ' * 200} {sample(60, i)}" for i in range(3)] + [sample(80)]
    got = [r.class_id for r in dartminhash.near_classes(docs(spark, texts), weighting="log").orderBy("doc_id").collect()]
    assert got == [0, 1, 2, 3]
    assert [r.class_id for r in dartminhash.near_classes(docs(spark, texts), weighting="tf").orderBy("doc_id").collect()] == [0, 0, 0, 3]


@pytest.mark.parametrize("small", [2, 16])
def test_all_near_pairs_of_the_tables_are_linked(spark, small):
    """Recall and precision over all pairs of sf0.01 that share a shingle; small=2 sends every larger bucket through the pivots."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in given.select("doc_id", "text").collect()]
    weights, holders = [], collections.defaultdict(list)
    for i, (_, t) in enumerate(rows):
        w = WORD.findall(t)
        times = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
        weights.append({s: n.bit_length() for s, n in times.items()})
        for s in times:
            holders[s].append(i)
    shared = collections.Counter()
    for s, at in holders.items():
        for x, i in enumerate(at):
            for j in at[x + 1 :]:
                shared[i, j] += min(weights[i][s], weights[j][s])
    mass = [sum(w.values()) for w in weights]
    alike = {p for p, both in shared.items() if both >= 0.8 * (mass[p[0]] + mass[p[1]] - both) - 1e-9}
    assert len(alike) > 50
    got = {r.doc_id: r.class_id for r in dartminhash.near_classes(given, weighting="log", small=small).collect()}
    found = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in alike)
    assert found >= 0.99 * len(alike)
    root = {d: d for d, _ in rows}
    for i, j in alike:
        a, b = root[rows[i][0]], root[rows[j][0]]
        for d, r in root.items():
            if r == max(a, b):
                root[d] = min(a, b)
    same_text = collections.defaultdict(set)
    for d, t in rows:
        same_text[t].add(root[d])
    assert all(got[a] == got[b] for t in same_text.values() for a in t for b in t)
    assert found < len(alike) or len(set(got.values())) >= len(set(root.values())) - sum(len(t) - 1 for t in same_text.values())


def test_components(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (10, 9)], "a int, b int")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 10: 8}


# 3: suffixes


def brute_repeats(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + n] for b in data for p in range(len(b) - n + 1))
    out = {}
    for i, b in enumerate(data):
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        out[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffixes(spark, seed):
    rnd = random.Random(seed)
    shared = [sample(80, 50 + k) for k in range(3)]
    texts = [sample(rnd.randint(5, 60), seed * 100 + i) + " " + rnd.choice(shared)[rnd.randint(0, 60) : rnd.randint(200, 450)] + " ñandú é " + sample(20, i) for i in range(25)]
    texts += [None, "", "short", "z" * 700, texts[0], "ab" * 300, shared[0][:199], shared[0][5:204]]
    df = docs(spark, texts).withColumn("kept", F.lit(1))
    got = table(suffixes.remove_repeats(df), "n_bytes", "n_removed", "n_spans", "kept")
    assert {i: (*v[:3], bytes(v[3])) for i, v in got.items()} == brute_repeats(texts, 200)


def test_suffixes_of_long_texts_are_taken_in_turns(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    long = sample(900, 3)
    data, edges = np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)])
    whole = suffixes.anchors(data, edges, 200, 40)
    covered = sum(int(b - a + 1) for a, b in zip(whole[1], whole[2], strict=True))
    assert covered == len(long) - 199


# 4: WARC


def test_warc_round_trip_and_salvage(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2\r\nevil", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nñ"), (6, "u", "y" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    plan = warc.plan_records(pages)
    warc.write_archives(plan.coalesce(1), f"file://{tmp_path}/w")
    got = {r.headers["X-Page-Id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert {k: v.kind for k, v in got.items()} == {"1": "revisit", "2": "response", "3": "revisit", "4": "response", "5": "response", "6": "response"}
    for i, _, h in rows:
        assert got[str(i)].payload_bytes == len((h or "").encode())
        assert got[str(i)].payload_digest == __import__("base64").b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert got["1"].headers["X-Refers-To-Page-Id"] == "2" and got["5"].payload.decode() == rows[4][2]
    assert [r.record_type for r in warc.plan_records(pages, least_bytes=1).where("page_id = 3").collect()] == ["response"]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_finds_later_records(packed):
    def record(i):
        body = f"payload {i} ".encode() * 50
        raw = warc.record_bytes(i, "u", body, len(body), __import__("base64").b32encode(hashlib.sha1(body).digest()).decode(), "response", None, "2024-01-01T00:00:00Z")
        return warc.gzip_member(raw) + warc.EMPTY_MEMBER if packed else raw

    parts = [record(i) for i in range(5)]
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 255
    data = parts[0] + bytes(broken) + parts[2] + b"garbage WARC/1.1 \x1f\x8b" + parts[3] + parts[4][:-30]
    rows = list(warc.salvage(data))
    assert [r["headers"]["X-Page-Id"] for r in rows if r["kind"] == "response"] == ["0", "2", "3"]
    gaps = [(r["begin"], r["end"]) for r in rows if r["kind"] == "gap"]
    assert gaps[0][0] == len(parts[0]) and gaps[-1][1] == len(data) and all(r["reason"] for r in rows if r["kind"] == "gap")
    covered = sum(b - a for a, b in {(r["begin"], r["end"]) for r in rows})
    assert covered + packed * sum(len(warc.EMPTY_MEMBER) for i in (0, 2, 3)) >= len(data) - len(warc.EMPTY_MEMBER)
    assert list(warc.salvage(b"")) == []


def raw_record(i, url="u"):
    body = f"payload {i} ".encode() * 50
    return warc.record_bytes(i, url, body, len(body), __import__("base64").b32encode(hashlib.sha1(body).digest()).decode(), "response", None, "2024-01-01T00:00:00Z")


def saved(data):
    return [r["headers"]["X-Page-Id"] for r in warc.salvage(bytes(data)) if r["kind"] == "response"]


def test_long_urls_are_read_back():
    for url in ("data:" + "x" * 70_000, "y" * 300_000):
        assert saved(warc.gzip_member(raw_record(1, url)) + raw_record(2, url)) == ["1", "2"]


@pytest.mark.parametrize("level", [0, 6])
def test_members_of_many_records_give_what_passes(level):
    raws = [raw_record(i) for i in range(6)]
    bad = raws[2].replace(b"payload 2 payload", b"payload 2 paXload", 1)
    one = warc.gzip_member(b"".join([*raws[:2], bad, *raws[3:]]), level)
    rows = list(warc.salvage(one + warc.gzip_member(raws[0])))
    assert saved(one + warc.gzip_member(raws[0])) == ["0", "1", "3", "4", "5", "0"] and [r["reason"] for r in rows if r["kind"] == "gap"] == ["payload digest differs"]
    whole = warc.gzip_member(b"".join(raws), level)
    assert saved(whole[:-8]) == [str(i) for i in range(6)]
    wrong = bytearray(whole)
    wrong[-6] ^= 255
    assert saved(wrong + warc.gzip_member(raws[0])) == ["0", "1", "2", "3", "4", "5", "0"]
    some = saved(whole[: len(whole) * 3 // 4])
    assert some == [str(i) for i in range(len(some))] and (level or len(some) == 4)


# 8: pieces


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rnd = random.Random(4)
    texts = [None, "", " ", "   a  b", "▁▁x ▁", "日本語 梦\x00é🙂", "a\tb\r\n\n", "<0x41> <s> </s>", "x" + " " * 33 + "y", " " * 50, sample(300), "é" * 100]
    texts += ["".join(rnd.choice("etaoin shrdlu  \n") for _ in range(rnd.randint(1, 80))) for _ in range(200)]
    got = table(pieces.encode_decode(docs(spark, texts).withColumn("decoded", F.lit(0))), "piece_ids", "n_pieces", "decoded")
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        assert got[i] == (",".join(map(str, ids)), len(ids), lib.decode(ids))
    empty = pieces.encode_decode(docs(spark, []), add=("ids_sha256", "n_pieces"))
    assert empty.columns[-2:] == ["ids_sha256", "n_pieces"] and empty.count() == 0
    rows = spark.createDataFrame([(1, lib.encode("hello wörld")), (2, []), (3, None)], "id int, ids array<int>")
    assert [r.decoded for r in pieces.decode_ids(rows).orderBy("id").collect()] == ["hello wörld", "", ""]


def test_pieces_of_long_texts_with_full_caches():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    with open(pieces.default_model(), "rb") as f:
        small = pieces.PieceTable(f.read(), cache_units=50, cache_pairs=40)
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("etaoinshrdlu日ß") for _ in range(30_000)), None, sample(30_000), "a" * 100_000, "", " x" * 500, sample(40)]
    for _ in range(2):
        got = [pair for part in pieces.slices(pa.array(texts)) for pair in small.both(part)]
        assert got == [(",".join(map(str, lib.encode(t or ""))), lib.decode(lib.encode(t or ""))) for t in texts]
    assert len(small.units) + len(small.odd) < 40_000


# 9: languages


def brute_path(scores, penalty):
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        from_ = [max(range(len(best)), key=lambda j, k=k: best[j] - penalty * (j != k)) for k in range(len(best))]
        back.append(from_)
        best = np.array([best[from_[k]] - penalty * (from_[k] != k) + row[k] for k in range(len(best))])
    k = int(best.argmax())
    path = [k]
    for from_ in reversed(back):
        k = from_[k]
        path.append(k)
    return path[::-1], best.max()


def cost(scores, path, penalty):
    return sum(scores[t][k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))


def test_paths_are_optimal():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, 30, 0, 12, 60])
    scores = rng.normal(0, 3, (sizes.sum(), 3)).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    path = langid.best_paths(scores, starts, sizes, 4.0)
    for a, n in zip(starts, sizes, strict=True):
        if n:
            part = scores[a : a + n].astype(float)
            assert cost(part, path[a : a + n], 4.0) == pytest.approx(brute_path(part, 4.0)[1], abs=1e-4)


def test_languages(spark):
    train = {"en": "the quick brown fox jumps over the lazy dog and runs with the wind ", "de": "der schnelle braune fuchs springt über den faulen hund und läuft ", "ru": "быстрая коричневая лиса прыгает через ленивую собаку "}
    texts = [train[k] * n for n in (1, 2, 3) for k in train]
    langs = {i: list(train)[i % 3] for i in range(len(texts))}
    model = langid.fit(docs(spark, texts, langs=langs))
    ask = ["the fox and the dog", "der hund und der fuchs", "лиса и собака", None, "", "123 ... ²", "the dog runs over the lazy fox " * 2 + "der hund läuft über den faulen fuchs " * 2]
    got = table(langid.identify(docs(spark, ask).withColumn("lang_pred", F.lit(0)), model, spans=True), "lang_pred", "lang_score", "lang_spans")
    assert [got[i][0] for i in range(6)] == ["en", "de", "ru", "und", "und", "und"] and got[3][1] == 0.0
    assert [s.lang for s in got[6][2]] == ["en", "de"]
    assert sorted(r.doc_id for r in langid.accepted(docs(spark, ask), model).collect()) == [0, 1, 2, 6]
    empty = langid.fit(docs(spark, []))
    assert table(langid.identify(docs(spark, ["the"]), empty), "lang_pred") == {0: ("und",)}


# 10: fingerprints


def test_fingerprints(spark):
    texts = [sample(60, i % 9, 80) for i in range(30)] + [None, "", "", "one", "One"]
    df = docs(spark, texts).withColumn("next", F.lit(1))
    fp = table(imatch.fingerprints(df, low=0.05, high=0.9), "fingerprint")
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or ""):
                assert fp[i] == fp[j]
    assert fp[33] == fp[34] != fp[32]
    base = df.select("doc_id", "text", F.coalesce("text", F.lit("")).alias("t"))
    for per in (3, 1000):
        nxt = {r.doc_id: r.next.t for r in imatch.with_next(base, "doc_id", ["t"], rows_per_bucket=per).collect()}
        assert nxt == {i: texts[i - 1] or "" if i else texts[-1] for i in range(len(texts))}
    assert imatch.with_next(base.where("false"), "doc_id", ["t"]).count() == 0


# 1: toxicity


def toxic_rows(n, seed=0):
    rnd, out = random.Random(seed), []
    for i in range(n):
        words = sample(rnd.randint(20, 120), seed * 1000 + i, 200).split()
        y = int(i % 4 == 0)
        if y:
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(["vile", "scumbag", "vilest", "scumbags"])
        out.append((" ".join(words), y))
    return out


def test_toxicity_learns_and_covers_whole_texts(spark):
    model = toxicity.train(toxic_rows(240))
    held = toxic_rows(80, 3)
    got = toxicity.Scorer(model).score([t for t, _ in held])
    assert np.mean([(s >= 0.5) == bool(y) for s, (_, y) in zip(got, held, strict=True)]) >= 0.95
    late = sample(3000, 9, 200) + " you vile scumbag " + sample(5, 8, 200)
    scored = table(toxicity.score_toxicity(docs(spark, [None, "", "...", late, sample(3000, 9, 200)]).withColumn("toxicity", F.lit("c")), model), "toxicity", "toxic_predicted")
    assert scored[0] == scored[1] == scored[2] == (0.0, 0) and scored[3][1] == 1 and scored[4][1] == 0


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 32, 33, 48, 49, 200])
    doc, first = toxicity.window_table(sizes)
    for d, n in enumerate(sizes):
        seen = {w for f in first[doc == d] for w in range(f, min(f + toxicity.WINDOW, n))}
        assert seen == set(range(n))


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in toxicity.new_weights(rng).items()}
    x, mask, y = rng.normal(size=(6, 5, toxicity.GIVEN + toxicity.LEARNED)), np.ones((6, 5, 1)), np.array([0, 1, 1, 0, 1.0])
    mask[4:, 2] = 0
    g, _ = toxicity.gradients(w, x, mask, y, np.ones(5))

    def loss():
        p = toxicity.sigmoid(toxicity.forward(w, x @ w["xf"], x @ w["xb"], mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for k in ("xf", "hf", "xb", "hb", "att", "query", "out"):
        at = tuple(0 for _ in w[k].shape)
        w[k][at] += 1e-2
        up = loss()
        w[k][at] -= 2e-2
        down = loss()
        w[k][at] += 1e-2
        assert g[k][at] == pytest.approx((up - down) / 2e-2, abs=2e-4)


def test_training_without_both_labels():
    assert toxicity.Scorer(toxicity.train([])).score(["a b"])[0] < 0.5
    assert toxicity.Scorer(toxicity.train([("a b", 0)])).score(["a b", None])[1] == 0.0

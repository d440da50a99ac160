"""Rows that share an id, columns with the operators' own names, empty tables and very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, dartminhash, imatch, langid, lines, mixing, pieces, suffixes, warc

from .test_llm_small import SCHEMA, WORD, brute_lines, brute_repeats, docs, sample

OWN = ["_bytes", "_size", "_id", "_copy", "_n", "_lines", "_gone", "_words", "_row", "_th", "_ref", "_out", "_lang", "_pieces", "_made", "_k1", "_k2", "_w", "rank", "key", "size", "h1", "root"]


def clashing(df):
    """``df`` with a column of every name that an operator might use inside."""
    return df.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in OWN])


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "a b\nc d\ne f"), (5, "a b\nc d\ne f"), (5, "unique one\nunique two\nunique three")]
    got = {(r.doc_id, r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, rows[0][1]), (5, 3, ""), (5, 0, rows[2][1])}


def test_mixing_of_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e", "x"), (1, "f g h i j", "x"), (2, "k l m", "x"), (None, "n o p", "x"), (None, "q r s", "x")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)
    target = sum(r.taken for r in mixing.plan_mix(df).collect())
    out = mixing.mix(df).collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == target
    whole = [r.text for r in out if r.text in {t for _, t, _ in rows}]
    assert all(whole.count(t) <= 2 for _, t, _ in rows)


def test_own_names_as_columns(spark):
    texts = [sample(60, 1), sample(60, 1), None, "a b\nc d\ne f", sample(90, 2)]
    df = clashing(docs(spark, texts))
    kept = lambda out: {r.doc_id: tuple(r[c] for c in OWN) for r in out.select("doc_id", *OWN).collect()}
    want = kept(df)
    assert kept(lines.dedup_lines(df)) == want
    assert kept(suffixes.remove_repeats(df, length=40, steps=(8, 30))) == want
    assert kept(pieces.encode_decode(df)) == want
    assert kept(imatch.fingerprints(df, words=["a"])) == want
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and all(want[r.doc_id] == tuple(r[c] for c in OWN) for r in mixed.collect())
    one = dartminhash.one_per_class(df)
    assert one.columns == df.columns and all(want[r.doc_id] == tuple(r[c] for c in OWN) for r in one.collect())
    model = langid.fit(docs(spark, texts).withColumn("lang", F.lit("en")))
    assert kept(langid.identify(df, model)) == want and langid.accepted(df, model).columns == df.columns


def test_empty_tables(spark):
    none = docs(spark, [])
    model = langid.fit(none)
    for out in (lines.dedup_lines(none), mixing.mix(none), mixing.plan_mix(none), suffixes.remove_repeats(none), dartminhash.near_classes(none), dartminhash.one_per_class(none), pieces.encode_decode(none), langid.identify(none, model), langid.accepted(none, model), imatch.fingerprints(none)):
        assert out.count() == 0
    assert imatch.lexicon(none) == []


def test_very_long_texts(spark):
    long = sample(120_000, 3)
    texts = [long, "\n".join(f"line {k % 50_000} of it" for k in range(60_000)), sample(20), "x" * 300_000]
    df = docs(spark, texts)
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert {i: t for i, (t, _) in got.items()} == brute_lines(texts)
    ids = {r.doc_id: r.n_pieces for r in pieces.encode_decode(df, add=("n_pieces",)).collect()}
    assert ids[0] > 120_000 and ids[3] > 10_000
    assert {r.doc_id: r["size"] for r in mixing.plan_mix(df).collect()} == {i: len(WORD.findall(t)) for i, t in enumerate(texts)}
    model = langid.fit(df.withColumn("lang", F.lit("en")), max_chars=1000)
    assert {r.lang_pred for r in langid.identify(df, model).collect()} == {"en"}
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(df, words=[long.split()[0].lower()]).collect()}
    assert len(set(prints.values())) == 4


def test_a_rare_language_and_an_unknown_script(spark):
    rnd = random.Random(5)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 9)))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(i, text("abcdefgh"), "aa") for i in range(600)] + [(1000 + i, text("qrstuvwxyz"), "zz") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, max_rows=20, least_rows=2)
    assert model.langs == ["aa", "zz"]
    ask = spark.createDataFrame([(1, text("qrstuvwxyz")), (2, "Ελληνικά γράμματα μόνο"), (3, text("abcdefgh") + " Ελληνικά"), (4, "12 34")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.identify(ask, model).collect()}
    assert got[1][0] == "zz" and got[2][1] == 0.0 and got[3][0] == "aa" and 0.8 < got[3][1] < 1.0 and got[4] == ("und", 0.0)
    assert {r.doc_id for r in langid.accepted(ask, model).collect()} == {1, 3}


def test_word_scores_are_those_of_the_formula(spark):
    df = spark.createDataFrame([(i, sample(60, i), "en") for i in range(8)] + [(10 + i, "uno dos tres cuatro " * 9, "es") for i in range(4)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    for w in ["uno", "tres", "zq", "Ñandú"]:
        buckets = np.concatenate(langid.gram_table([w])[0])
        plain = [sum(float(model.logp[b, k]) for b in buckets) / len(buckets) * (len(w) / 2 + 1) for k in range(len(model.langs))]
        assert model.word_scores([w])[0] == pytest.approx([x - max(plain) for x in plain], abs=1e-3)


def test_bounded_samples(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("h"), "id", F.when(F.col("id") < 5, "few").otherwise("many").alias("kind"))
    order = sorted((r.h, r.id, r.kind) for r in rows.collect())
    assert sorted(r.id for r in common.bounded_sample(rows, "h", 100)) == sorted(i for _, i, _ in order[:100])
    assert common.bounded_sample(rows.where("id < 0"), "h", 100) == [] == common.bounded_sample(rows.where("id < 0"), "h", 100, "kind")
    got = common.bounded_sample(rows, "h", 60, "kind", 40)
    for kind, n in (("few", 5), ("many", 40)):
        assert sorted(r.id for r in got if r.kind == kind) == sorted([i for _, i, k in order if k == kind][:n])


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_last_round_of_repeats_hashes_windows_twice():
    rnd = random.Random(2)
    data = np.frombuffer(bytes(rnd.randrange(256) for _ in range(300)), np.uint8)
    data = np.concatenate([data, data])
    owner, first, last, rank, content = suffixes.anchors(data, np.array([0, len(data)]), 50, 50)
    assert len(first) == 551 and (first == last).all() and not owner.any()
    for x in (rank, content):
        assert (x[:251] == x[300:551]).all() and len(set(x.tolist())) == 300


def test_archive_of_damaged_bytes_gives_every_whole_record_and_each_gap(spark, tmp_path):
    """The whole query's way, with bytes of one of its files spoiled in between."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 40) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(warc.plan_records(pages), path)
    files = sorted(p for p in (tmp_path / "archives").iterdir() if p.name.startswith("part-") and p.stat().st_size > 1000)
    spoiled = bytearray(files[0].read_bytes())
    at = len(spoiled) // 2
    spoiled[at : at + 20] = b"\0" * 20
    files[0].write_bytes(bytes(spoiled))
    for p in (tmp_path / "archives").iterdir():
        if p.name.endswith(".crc"):
            p.unlink()
    read = warc.read_archives(spark, path).collect()
    gaps = [r for r in read if r.kind == "gap"]
    whole = {r.headers["X-Page-Id"]: bytes(r.payload) for r in read if r.kind == "response"}
    assert len(gaps) == 1 and gaps[0].begin_at <= at < gaps[0].end_at and gaps[0].reason
    assert len(whole) == 59 and all(v == (f"page {k} " * 40).encode() for k, v in whole.items())


def test_repeats_equal_brute_force_with_repeated_rows(spark):
    texts = [sample(50, 1), sample(50, 1), None, "", sample(50, 2) + sample(30, 1), "z" * 90, sample(10, 3)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(docs(spark, texts), length=40, steps=(8, 30)).collect()}
    assert got == brute_repeats(texts, 40)

"""The pipeline against a brute-force version, stage by stage and as a whole."""

import hashlib
import random

import pytest
import sentencepiece

import corpus_pipeline
from cairn.llm import langid, mixing, pieces
from cairn.llm.common import fold

from .test_llm_small import WORD, brute_classes, brute_lines, brute_targets, docs, edited, sample


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    texts = [sample(rnd.randint(20, 90), i) for i in range(40)]
    texts += [edited(texts[i], 1, i) for i in range(0, 12, 2)] + [texts[3], None, "", "1234 5678", "head\n" + "\n".join(f"line {k} of the shared passage" for k in range(4)) + "\ntail one"]
    texts += ["other\n" + "\n".join(f"line {k} of the shared passage" for k in range(4)) + "\nend two", "\n".join(f"line {k} of the shared passage" for k in range(4))]
    sources = {i: rnd.choice(["a", "b", None]) for i in range(len(texts))}
    path = tmp_path_factory.mktemp("pipeline")
    docs(spark, texts, sources).write.parquet(f"{path}/documents.parquet")
    return str(path), texts, sources


def stream(texts, sources):
    """Copies in order of position, as (id, words of the copy)."""
    sizes, order = {}, {}
    for i, t in texts.items():
        n, s = len(WORD.findall(t or "")), sources.get(i)
        sizes[s] = sizes.get(s, 0) + n
        order.setdefault(s, []).append((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, n))
    targets, out = brute_targets(sizes), []
    for s, rows in order.items():
        at, words = 0, round(targets[s])
        for copy in range(2):
            for _, i, n in sorted(rows):
                took = max(0, min(words - at, n))
                at += n
                if took:
                    out.append((i, took, n))
    return out


def expected(spark, path, texts, sources):
    given = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(given.where(fold("doc_id", 4) != 2))
    preds, shares, _ = langid.Labeller(model, 8.0).label(texts, False)
    now = {i: t for i, t in enumerate(texts) if preds[i] != "und" and shares[i] >= 0.5}
    ids = sorted(now)
    cut = brute_lines([now[i] for i in ids])
    now = {i: cut[k] for k, i in enumerate(ids) if cut[k] == now[i] or WORD.search(cut[k])}
    ids = sorted(now)
    classes = brute_classes([now[i] for i in ids])
    now = {i: now[i] for k, i in enumerate(ids) if classes[k] == k}
    lib, out = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model()), []
    for i, took, n in stream(now, sources):
        text = now[i] if took == n else " ".join(WORD.findall(now[i])[:took])
        got = lib.encode(text)
        out.append((i, text, len(got), ",".join(map(str, got)), hashlib.sha256(lib.decode(got).encode()).hexdigest()))
    return sorted(out)


def test_run_equals_brute_force(spark, folder):
    got = sorted((r.doc_id, r.text, r.n_tokens, r.piece_ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder[0]).collect())
    assert got == expected(spark, *folder)


def test_stages_keep_the_columns(spark, folder):
    now = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, now, folder[0]).columns == now.columns
    assert mixing.mix(now).columns == now.columns

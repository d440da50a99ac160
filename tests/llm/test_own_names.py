"""Columns of a caller that have the names which operators use on the way."""

import pytest

from cairn.llm import imatch, pieces, quality


def test_quality_keeps_them(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "w", "l"), (2, None, None, None)], "doc_id long, text string, _words string, _lines string")
    rows = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert (rows[1]["_words"], rows[1]["_lines"], rows[1].n_words) == ("w", "l", 11) and rows[2].n_words == 0 and rows[2]["_words"] is None
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_next_rows_keep_them(spark):
    names = ["_bucket", "_turn", "_next", "_head", "_below", "_to", "_top"]
    df = spark.createDataFrame([(i, *[f"{n}{i}" for n in names]) for i in range(40)], "doc_id long, " + ", ".join(f"{n} string" for n in names))
    rows = {r.doc_id: r for r in imatch.with_next(df, "doc_id", ["_turn"], rows_per_bucket=8).collect()}
    assert all(rows[i][n] == f"{n}{i}" and rows[i].next[n] == f"{n}{(i - 1) % 40}" for i in range(40) for n in names)


def test_models_of_another_kind_are_refused():
    with open(pieces.default_model(), "rb") as f:
        model = f.read()
    trimming = model.replace(b"\x12\x00\x18\x01 \x00", b"\x12\x00\x18\x01 \x01")
    assert trimming != model and pieces.PieceTable(model)
    with pytest.raises(ValueError, match="byte pair model"):
        pieces.PieceTable(trimming)

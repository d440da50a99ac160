"""Stems that were published with the algorithm."""

from pyspark.sql import functions as F

from cairn.functions import stem, text
from cairn.operators import search

PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil is is a a yes ye""".split()


def test_published_stems(spark):
    pairs = list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
    rows = spark.createDataFrame(pairs, "word string, want string").select("word", "want", stem.stem(F.col("word")).alias("got")).collect()
    assert [(r.word, r.got) for r in rows if r.got != r.want] == [] and len(rows) > 70
    assert spark.range(1).select(stem.stem(F.lit(None).cast("string")).alias("x")).first().x is None


def test_analyzed_terms_are_stemmed_once_each(spark):
    docs = spark.createDataFrame([(1, "Running cafés ran, the runner's RUNNING"), (2, "Café running"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.tf for r in search.analyzed(docs, stop=["the"]).collect()}
    assert got == {(1, "run"): 2, (1, "cafe"): 1, (1, "ran"): 1, (1, "runner"): 1, (1, "s"): 1, (2, "cafe"): 1, (2, "run"): 1}
    assert spark.range(1).select(text.folded(F.lit("é")).alias("x")).first().x == "e"

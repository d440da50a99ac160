"""From raw documents to token ids: language ID, line dedup, near-dedup, source mixing, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last keep the columns of documents.

All stages take null in any column, empty and very long texts, repeated rows, empty tables (they stay empty) and more columns,
whose names may be those that a stage uses on the way; texts are read whole. What each does with them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import dartminhash, langid, lines, mixing, pieces
from cairn.llm.common import fold, load, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and at least half their letters in one language stay.

    Null and empty texts go, as they have no letter. Repeated rows are judged alike; rows without lang or doc_id are judged too, and only do not
    train. Without any labelled row nothing can be told apart and all documents with a letter have the one label ``und``: they go.
    """
    return langid.accepted(docs, langid.fit(docs.where(fold("doc_id", 4) != 2)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document that is left without a word goes too.

    Null and empty texts, and texts of fewer than three lines, have no window and stay. A document goes by its id and text: repeated rows are one and
    lose nothing to each other; of equal texts with different ids the first keeps its lines.
    """
    return lines.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id stays, null ids last, and exactly one of repeated rows.

    Null counts as an empty text; texts with fewer words than a shingle are near copies only of equal ones.
    """
    return dartminhash.one_per_class(docs, weighting="log")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: copies of documents by their sources' targets, in order of training position.

    A null source is a source of its own, the last; texts without a word take no part in sizes. Repeated rows are planned each.
    """
    return mixing.mix(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and a digest of the text decoded from them; null and empty texts have no ids.

    Columns with the new names are replaced, all others pass through.
    """
    coded = pieces.encode_decode(docs, add=("n_pieces", "piece_ids", "decoded_sha256"))
    return coded.withColumnRenamed("n_pieces", "n_tokens")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece_ids", sentencepiece_ids),
]

#: Language labels, signatures and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

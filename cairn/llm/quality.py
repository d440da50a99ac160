"""Quality rules: a threshold table compiled into one Spark projection. DataFrame functions only.

A rule bounds one measure from below and above. `measures` names the measures as column expressions over the text;
`compile_rules` turns the table into boolean columns and a verdict, so the whole filter is a projection of the scan with
no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, load, text_of, unused

# Function words of the four languages, whole words in any case.
STOP_WORDS = (
    "the be to of and that have with for this in is it on as at by from was are "
    "der die das und ist nicht ein eine den von zu mit auf sich des dem "
    "le la les et est un une des du que qui dans en pour par sur pas au "
    "el los las y es una por con para se del lo como de que"
).split()

#: rule: (measure, least, most). Ratios are of words, of characters in words or of lines with a word.
RULES: dict[str, tuple[str, float | None, float | None]] = {
    "words": ("n_words", 10, None),
    "mean_word_length": ("mean_word_length", 2.0, 16.0),
    "symbols": ("symbol_ratio", None, 0.25),
    "stop_words": ("stop_ratio", 0.01, None),
    "repeated_lines": ("dup_line_ratio", None, 0.7),
    "ellipsis_lines": ("ellipsis_line_ratio", None, 0.5),
    "bullet_lines": ("bullet_line_ratio", None, 0.95),
}


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words inside ``n``-word windows that the text has twice or more.

    Windows are hashed and sorted. Only a text with equal neighbours goes on to sort (hash, place) pairs; its repeated
    windows' places, sorted, cover ``n`` words each less what the next one covers too.
    """

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))

    def covered(places: Column) -> Column:
        step = F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(n), p - a["last"])).alias("sum"), p.alias("last")))
        return step["sum"]

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda p, k: (F.get(s, k - 1)["x"] == p["x"]) | F.coalesce(F.get(s, k + 1)["x"] == p["x"], F.lit(False))), lambda p: p["i"])))

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places(h), covered))
    return let(words, lambda w: F.when(F.size(w) < n, F.lit(0)).otherwise(let(hashes(w), counted))).cast("long")


def measures(text: Column) -> list[tuple[str, Column]]:
    """Measures that read the text once each; `ratios` derives the rest."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return [
        ("_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0))),
        ("_lines", lines),
        ("word_chars", (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long")),
        ("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")),
    ]


def ratios() -> dict[str, Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    stop = list(STOP_WORDS)
    return {
        "mean_word_length": F.col("word_chars") / words,
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_ratio": F.size(F.filter("_words", lambda w: F.lower(w).isin(stop))) / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
        "ellipsis_line_ratio": F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))) / lines,
        "bullet_line_ratio": F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-*•]\s"))) / lines,
    }


def compile_rules(rules: Mapping[str, tuple[str, float | None, float | None]]) -> Column:
    """The names of the rules that a row breaks, as an array column over the measures."""
    tests = []
    for name, (measure, least, most) in rules.items():
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(measure) < F.lit(least))
        if most is not None:
            bad = bad | (F.col(measure) > F.lit(most))
        tests.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*tests))


def quality_rules(docs: DataFrame, *, text_col: str = "text", rules: Mapping[str, tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, ``broken`` (rules broken) and ``kept``.

    A null text counts as one without words: it fails the base test. Columns of ``docs`` other than the text pass
    through unless a measure has their name; also such as have names that are used on the way. Every row is judged alone, so ties, copies and empty tables need nothing.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "broken", "kept"}
    aside = {c: unused(docs, f"given{c}") for c in docs.columns if c.lower() in ("_words", "_lines")}
    docs, text_col = docs.withColumnsRenamed(aside), aside.get(text_col, text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    first = docs.select(*rest, *[e.alias(n) for n, e in measures(text_of(text_col))])
    counted = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words")),
    })
    wanted = {m for m, _, _ in rules.values()}
    counted = counted.withColumns({k: e for k, e in ratios().items() if k in wanted})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counted.withColumns({"base_failed": failed, "broken": compile_rules(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0)).drop("_words", "_lines").withColumnsRenamed({v: k for k, v in aside.items()})


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM t),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM a WHERE len(w) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
b AS (
  SELECT a.doc_id, w, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN cov USING (doc_id)),
c AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         greatest(n_words, 1)::DOUBLE AS nw, greatest(len(l), 1)::DOUBLE AS nl
  FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / nw BETWEEN 2.0 AND 16.0 AND n_symbols / greatest(word_chars, 1)::DOUBLE <= 0.25
       AND len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) / nw >= 0.01 AND n_dup_lines / nl <= 0.7
       AND len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) / nl <= 0.5
       AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) / nl <= 0.95 AS kept
FROM c
"""

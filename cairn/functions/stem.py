"""English stems by suffix rules (the published algorithm of 1980) as a column expression, meant for the distinct terms of a corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels, and y after a consonant; consonants, and y elsewhere.
V, C = "(?:[aeiou]|(?<=[^aeiou])y)", "(?:[^aeiouy]|(?<![^aeiou])y)"
ONE, EXACTLY_ONE, TWO = f"^{C}*{V}+{C}", f"^{C}*{V}+{C}+{V}*$", f"^{C}*(?:{V}+{C}+){{2}}"
DOUBLE, SHORT = r"([^aeiouy])\1$", f"{C}{V}[^aeiouwxy]$"

# Suffixes with what replaces them, by step; in the last table the suffix goes.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _longest(rules: Sequence[tuple[str, str]], condition: Callable[[Column, str], Column]) -> Callable[[Column], Column]:
    """Replace the longest suffix that fits, if what stands before it meets the condition."""

    def step(word: Column) -> Column:
        out = F
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            before = _without(word, suffix)
            out = out.when(F.endswith(word, F.lit(suffix)), F.when(condition(before, suffix), F.concat(before, F.lit(new))).otherwise(word))
        return out.otherwise(word)

    return step


def _past(word: Column) -> Column:
    """-eed, -ed and -ing."""

    def mended(w: Column) -> Column:
        ends = F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE) & ~w.rlike("[lsz]$"), _without(w, "x"))
        return ends.when(w.rlike(EXACTLY_ONE) & w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w)

    eed = F.when(_without(word, "eed").rlike(ONE), _without(word, "d")).otherwise(word)
    out = F.when(F.endswith(word, F.lit("eed")), eed)
    for suffix in ("ed", "ing"):
        before = _without(word, suffix)
        out = out.when(F.endswith(word, F.lit(suffix)) & before.rlike(V), _once(before, mended))
    return out.otherwise(word)


def _last(word: Column) -> Column:
    """-e and -ll."""
    before = _without(word, "e")
    goes = F.endswith(word, F.lit("e")) & (before.rlike(TWO) | (before.rlike(EXACTLY_ONE) & ~before.rlike(SHORT)))
    return _once(F.when(goes, before).otherwise(word), lambda w: F.when(F.endswith(w, F.lit("ll")) & _without(w, "l").rlike(TWO), _without(w, "l")).otherwise(w))


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters, and null, stay."""
    steps = [
        _longest(PLURALS, lambda before, suffix: F.lit(True)), _past, lambda w: F.when(F.endswith(w, F.lit("y")) & _without(w, "y").rlike(V), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w),
        _longest(SECOND, lambda before, suffix: before.rlike(ONE)), _longest(THIRD, lambda before, suffix: before.rlike(ONE)),
        _longest([(s, "") for s in FOURTH], lambda before, suffix: before.rlike(TWO) & before.rlike("[st]$") if suffix == "ion" else before.rlike(TWO)), _last,
    ]
    out = word
    for step in steps:
        out = _once(out, step)
    return F.when(F.length(word) > 2, out).otherwise(word)

"""Filters from specifications: each function returns a boolean column, which reaches the scan where it can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import tokens


def clause(spec: Mapping) -> Column:
    """One clause: term, terms, range, exists, prefix, wildcard or contains.

    ``{"range": {"price": {"gte": 1, "lt": 5}}}``, ``{"term": {"status": "F"}}``, ``{"exists": "name"}`` and so on.
    """
    ((kind, body),) = spec.items()
    if kind == "exists":
        return F.col(body).isNotNull()
    ((field, value),) = body.items()
    column = F.col(field)
    if kind == "term":
        return column == F.lit(value)
    if kind == "terms":
        return column.isin(*value)
    if kind == "range":
        tests = {"gte": column.__ge__, "gt": column.__gt__, "lte": column.__le__, "lt": column.__lt__}
        return all_of([tests[k](F.lit(v)) for k, v in value.items()])
    if kind == "prefix":
        return column.startswith(value)
    if kind == "wildcard":
        return column.like(value.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_"))
    if kind == "contains":
        return F.contains(F.lower(column), F.lit(value.lower()))
    raise ValueError(f"unknown clause {kind}")


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def at_least(tests: Sequence[Column], n: int) -> Column:
    """Whether ``n`` of the tests hold; a null test does not."""
    return sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) >= n


def bool_query(*, must: Sequence[Mapping] = (), should: Sequence[Mapping] = (), must_not: Sequence[Mapping] = (), filter: Sequence[Mapping] = (), minimum_should_match: int | None = None) -> Column:
    """All of must and filter, none of must_not, and enough of should: by default one if nothing else must hold."""
    needed = minimum_should_match if minimum_should_match is not None else int(bool(should) and not (must or filter))
    test = all_of([clause(c) for c in (*must, *filter)])
    if must_not:
        test = test & ~F.coalesce(any_of([clause(c) for c in must_not]), F.lit(False))
    return test & at_least([clause(c) for c in should], needed) if needed else test


def should_score(should: Sequence[tuple[Mapping, float]]) -> Column:
    """The sum of the boosts of the clauses that hold."""
    return sum((F.when(clause(c), F.lit(float(b))).otherwise(0.0) for c, b in should), F.lit(0.0))


def node_test(node: Mapping) -> tuple[Column, float]:
    """The condition and the boost of a query node.

    ``match`` with ``operator`` "or" / "and" and ``fuzziness`` "AUTO", ``match_phrase``, ``range`` and ``term``; each takes
    ``boost`` beside its own settings.
    """
    ((kind, body),) = node.items()
    ((field, given),) = body.items()
    rest = dict(given)
    boost = float(rest.pop("boost", 1.0))
    if kind == "range":
        return clause({"range": {field: rest}}), boost
    if kind == "term":
        return F.col(field) == F.lit(rest["value"]), boost
    words = tokens(F.col(field))
    if kind == "match_phrase":
        asked = " ".join(rest["query"].lower().split())
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {asked} ")), boost
    if kind == "match":
        auto = rest.get("fuzziness") == "AUTO"
        tests = [_has_word(words, w, (0 if len(w) <= 2 else 1 if len(w) <= 5 else 2) if auto else 0) for w in rest["query"].lower().split()]
        return (all_of if rest.get("operator", "or") == "and" else any_of)(tests), boost
    raise ValueError(f"unknown node {kind}")


def _has_word(words: Column, word: str, edits: int) -> Column:
    if not edits:
        return F.array_contains(words, word)
    return F.exists(words, lambda t: t.startswith(word[:2]) & (F.levenshtein(t, F.lit(word)) <= edits))


def node_score(nodes: Sequence[Mapping]) -> Column:
    """The sum over nodes of the boost of each that holds; a ``multi_match`` counts its best field."""

    def worth(test: Column, boost: float) -> Column:
        return F.when(test, F.lit(boost)).otherwise(0.0)

    parts = []
    for node in nodes:
        if "multi_match" in node:
            rest = dict(node["multi_match"])
            fields = [worth(*node_test({"match": {f: {"boost": b, **{k: v for k, v in rest.items() if k != "fields"}}}})) for f, b in rest["fields"].items()]
            parts.append(F.greatest(*fields) if len(fields) > 1 else fields[0])
        else:
            parts.append(worth(*node_test(node)))
    return sum(parts, F.lit(0.0))


def page(df: DataFrame, order: Sequence[Column], start: int, size: int, total: str = "total") -> DataFrame:
    """Rows ``start`` to ``start + size`` in the order given, with the number of all rows as ``total``.

    The order is that of the page; the count is a pass of its own, so that no window holds all rows.
    """
    hits = df.agg(F.count("*").alias(total))
    return df.orderBy(*order).offset(start).limit(size).join(F.broadcast(hits))  # one row


def search_sizes(size: int) -> tuple[int, int, int]:
    """Rows to return, nearest rows to take and candidates to look at, for a search that asks for ``size``."""
    # The factors and the caps.
    return min(size, 100), min(5 * size, 100), min(10 * size, 200)


def reproducible_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows that the MD5 of the key and the seed picks."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)

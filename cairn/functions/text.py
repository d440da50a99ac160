"""Column functions over strings: normalization, ids, tokens, tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# State names and their codes.
STATE_CODES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE",
    "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA",
    "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN",
    "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ", "NEW MEXICO": "NM",
    "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI",
    "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "WASHINGTON": "WA",
    "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}


def lookup(value: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    """``table[value]``, else ``otherwise``: a literal map of bounded size."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[value], otherwise)


def state_code(name: Column) -> Column:
    """The two-letter code of a state name or code; other values give their first two letters."""
    clean = F.upper(F.trim(name))
    return lookup(clean, STATE_CODES, F.substring(clean, 1, 2))


def null_if_blank(value: Column, blanks: Sequence[str] = ("", "null", "NULL")) -> Column:
    return F.when(~value.isin(*blanks), value)


def slug(value: Column) -> Column:
    """Lower case with every run of anything but letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_|_$", "")


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.concat_ws("_", *[slug(p) for p in parts]))


def postal_status(code: Column, placeholders: Sequence[str] = ("90001",)) -> Column:
    """missing, invalid, placeholder or valid."""
    return F.when(code.isNull() | (F.trim(code) == ""), "missing").when(~code.rlike("^[0-9]{5}$"), "invalid").when(code.isin(*placeholders), "placeholder").otherwise("valid")


def without_county_suffix(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"(?i)\s+county$", ""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def folded(text: Column) -> Column:
    """Accents dropped, for Latin letters."""
    return F.translate(text, "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def shingles(words: Column, least: int = 2, most: int = 3) -> Column:
    """All runs of ``least`` to ``most`` words, joined by spaces."""

    def run(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[run(n) for n in range(least, most + 1)])


def topic_tags(text: Column, topics: Mapping[str, str]) -> Column:
    """The tags whose keyword the text contains, case kept; in the order given."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(word)), F.lit(tag)) for tag, word in topics.items()]))


def mentions(text: Column, words: Sequence[str]) -> Column:
    """How many of ``words`` the lower-cased text contains."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))

"""Where a page is about: each hint as a row of evidence with its source and confidence, and the best for each field.

One Arrow pass with the standard parser finds the parts of the page (category links, info box, coordinates, paragraphs); what they say
is decided by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states that categories and lead paragraphs are searched for, and the confidence of each source.
STATES = ("California", "Utah", "Nevada", "Arizona", "Oregon", "Washington", "Colorado", "Wyoming", "Idaho", "Montana")
CONFIDENCE = {
    ("state", "infobox"): 0.95, ("county", "infobox"): 0.95, ("coordinates", "geo"): 0.95, ("state", "category"): 0.9, ("coordinates", "link"): 0.9, ("coordinates", "infobox"): 0.9,
    ("city", "infobox"): 0.85, ("county", "category"): 0.85, ("coordinates", "text"): 0.8, ("state", "lead"): 0.7, ("county", "lead"): 0.6, ("city", "lead"): 0.6,
}
# Words by which a category belongs to a group, and how many of a group are kept.
CATEGORY_WORDS = {"county": ("county",), "city": ("cities in", "neighborhoods", "buildings and structures"), "geographic": ("geography", "landforms", "mountains", "valleys"), "location": ("established", "founded", "historic")}
MOST_CATEGORIES = 10
#: Characters of the first paragraph that counts as the lead, at least.
LEAD = 100


class _Parts(HTMLParser):
    """Category links, label and data cells and title of the info box, text of the coordinate mark, link targets, paragraphs, all text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.categories, self.box, self.title, self.geo, self.links, self.paragraphs, self.text = [], [], [], [], [], [], []
        self.tables: list[bool] = []
        self.into: list[tuple[str, list[str] | None]] = []
        self.row: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "").split()
        if tag == "link" and a.get("rel") == "mw:PageProp/Category":
            self.categories.append(a.get("href", "").removeprefix("./Category:").replace("_", " "))
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in ("link", "br", "img", "meta", "hr", "input"):
            return
        if tag == "table":
            self.tables.append("infobox" in names or any(self.tables))
        target = None
        if tag == "span" and "geo" in names and not self.geo:
            target = self.geo
        elif tag == "p":
            self.paragraphs.append([])
            target = self.paragraphs[-1]
        elif any(self.tables) and (("fn" in names and "org" in names) or "infobox-above" in names):
            target = self.title
        elif any(self.tables) and tag == "tr":
            self.row = {}
        elif any(self.tables) and tag in ("th", "td"):
            target = self.row.setdefault(tag, [])
        self.into.append((tag, target))

    def handle_endtag(self, tag):
        if tag == "tr" and {"th", "td"} <= self.row.keys():
            self.box.append((" ".join(self.row["th"]), " ".join(self.row["td"])))
            self.row = {}
        if tag == "table" and self.tables:
            self.tables.pop()
        if any(t == tag for t, _ in self.into):
            while self.into.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.text.append(data)
        for target in {id(t): t for _, t in self.into if t is not None}.values():
            target.append(data)


PARTS = "categories array<string>, box array<struct<label:string,data:string>>, title string, geo string, links array<string>, lead string, text string"


def parts(html: str | None) -> tuple:
    page = _Parts()
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):  # how the parser gives up; what came before stays
        pass
    clean = lambda x: re.sub(r"\s+", " ", "".join(x)).strip()
    lead = next((t for p in page.paragraphs if len(t := clean(p)) > LEAD), "")
    return page.categories, [(clean(a), clean(b)) for a, b in page.box], clean(page.title), clean(page.geo), page.links, lead, clean(page.text)


def with_parts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``parts``, a struct. A null page has empty ones."""

    @F.pandas_udf(PARTS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parts(h) for h in batch], columns=["categories", "box", "title", "geo", "links", "lead", "text"])

    return pages.withColumn("parts", run(F.col(html_col)))


def _first(values: Column, pattern: str, group: int = 1) -> Column:
    """What the first value that matches has in a group; null if none does."""
    return F.regexp_extract(F.get(F.filter(values, lambda v: v.rlike(pattern)), F.lit(0)), pattern, group)


def _degrees(text: Column, pattern: str, first: int) -> Column:
    """Degrees from four groups: degrees, minutes, seconds (these may be empty) and the letter of the direction."""
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, first + i).try_cast("double"), F.lit(0.0))
    size = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.regexp_extract(text, pattern, first + 3).isin("S", "W"), -size).otherwise(size)


ONE_LINK = r"params=([\d.]+)_(?:([\d.]+)_)?(?:([\d.]+)_)?([NS])_([\d.]+)_(?:([\d.]+)_)?(?:([\d.]+)_)?([EW])"
ONE_TEXT = r"([\d.]+)\s*°\s*(?:([\d.]+)\s*[′']\s*)?(?:([\d.]+)\s*[″\"]\s*)?([NS])[\s,/]*([\d.]+)\s*°\s*(?:([\d.]+)\s*[′']\s*)?(?:([\d.]+)\s*[″\"]\s*)?([EW])"
ONE_MARK = r"(-?[\d.]+)\s*[;,]\s*(-?[\d.]+)"


def _place(text: Column, pattern: str) -> Column:
    """``lat, lon`` in decimal degrees as text, null where the pattern does not match or a number is out of range."""
    if pattern == ONE_MARK:
        lat, lon = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    else:
        lat, lon = _degrees(text, pattern, 1), _degrees(text, pattern, 5)
    inside = text.rlike(pattern) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(inside, F.format_string("%.5f, %.5f", lat, lon))


def evidence(pages: DataFrame, id_col: str, html_col: str = "html", states: Sequence[str] = STATES) -> DataFrame:
    """``id, field, value, source, confidence``: every hint for city, county, state and coordinates, one row for each field and source.

    Categories name a state and a county; the info box has both as rows, the city as title, and coordinates; coordinates stand in a mark, in
    the parameters of a link, decimal or in degrees, minutes and seconds, or in the text; the lead paragraph says "is a city in X County, State".
    """
    p = lambda c: F.col(f"parts.{c}")
    named = "|".join(map(re.escape, states))
    label = lambda word: F.get(F.transform(F.filter(p("box"), lambda r: F.contains(F.lower(r["label"]), F.lit(word))), lambda r: r["data"]), F.lit(0))
    bare = lambda c: F.trim(F.regexp_replace(c, r"\[.*?\]", ""))
    county = F.coalesce(F.nullif(_first(p("categories"), r"in ([\w\s]+?) County"), F.lit("")), _first(p("categories"), r"^([\w\s]+?) County"))
    told = rf"(?i)^(.*?)\s+is (?:a|an|the)\s+(?:city|town|community|neighborhood|village)(?:\s+(?:in|of))?\s+([\w\s]+?)(?:\s+County)?,?\s*({named})"
    lead = lambda i: F.regexp_extract(p("lead"), told, i)
    found = {
        ("state", "category"): _first(p("categories"), rf"(?i)\b({named})\b"), ("county", "category"): F.when((F.length(county) > 2) & (F.size(F.split(county, r"\s+")) <= 3), county),
        ("state", "infobox"): bare(label("state")), ("county", "infobox"): bare(F.regexp_replace(label("county"), r"\s*County.*$", "")),
        ("city", "infobox"): F.regexp_replace(p("title"), rf",\s*({named}).*$", ""), ("coordinates", "infobox"): _place(label("coordinates"), ONE_TEXT),
        ("coordinates", "geo"): _place(p("geo"), ONE_MARK), ("coordinates", "link"): _place(F.get(F.filter(p("links"), lambda x: x.rlike(ONE_LINK)), F.lit(0)), ONE_LINK), ("coordinates", "text"): _place(p("text"), ONE_TEXT),
        ("city", "lead"): lead(1), ("county", "lead"): lead(2), ("state", "lead"): lead(3),
    }
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(v).alias("value"), F.lit(s).alias("source"), F.lit(CONFIDENCE[f, s]).alias("confidence")) for (f, s), v in found.items()])
    return with_parts(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))).select("id", F.inline(rows)).where(F.length("value") > 2)


def resolved(hints: DataFrame) -> DataFrame:
    """``id, field, value, source, confidence, agree``: of each field the hint of the highest confidence, ties by the last source name and
    then the last value in order; and how many of its hints say the same, in any case."""
    order = F.struct("confidence", "source", "value")
    best = hints.groupBy("id", "field").agg(F.max_by(F.struct("value", "source", "confidence"), order).alias("best"), F.collect_list(F.lower("value")).alias("all"))  # one value for each source
    agree = F.size(F.filter("all", lambda v: v == F.lower(F.col("best.value"))))
    return best.select("id", "field", "best.*", agree.alias("agree"))


def category_groups(pages: DataFrame, id_col: str, html_col: str = "html", states: Sequence[str] = STATES, most: int = MOST_CATEGORIES) -> DataFrame:
    """``id, kind, categories``: a page's category links in five groups, by their words, sorted, at most ``most`` of a group."""
    def naming(words: Sequence[str], exact: bool = False, without: str | None = None):
        """Whether a category has one of the words, and not another."""

        def test(c: Column) -> Column:
            low = c if exact else F.lower(c)
            found = F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
            return found & ~F.contains(low, F.lit(without)) if without else found

        return test

    tests = {"state": naming(states, exact=True)} | {kind: naming(words, without="county" if kind == "city" else None) for kind, words in CATEGORY_WORDS.items()}
    made = with_parts(pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))).select("id", F.array_sort(F.array_distinct("parts.categories")).alias("c"))
    groups = F.array(*[F.struct(F.lit(kind).alias("kind"), F.slice(F.filter("c", test), 1, most).alias("categories")) for kind, test in tests.items()])
    return made.select("id", F.inline(groups)).where(F.size("categories") > 0)

"""Text, headings, info boxes, places and links from HTML pages: one Arrow pass with the standard parser, the rest as columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKIPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript", "template", "svg"}
BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "tr", "br", "section", "article", "blockquote", "pre", "td", "th"}


class _Page(HTMLParser):
    """Collects visible text by block, headings, table rows with a header cell, and links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.title, self.blocks, self.headings, self.box, self.links = 0, [], [[]], [], {}, []
        self.open: list[str] = []
        self.row: dict[str, list[str]] = {}

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        if tag in BLOCKS:
            self.blocks.append([])
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag in ("h1", "h2", "h3"):
            self.headings.append("")
        if tag == "tr":
            self.row = {"th": [], "td": []}
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.hidden:
            self.hidden -= 1
        if tag == "tr" and self.row.get("th") and self.row.get("td"):
            self.box[" ".join(self.row["th"])] = " ".join(self.row["td"])
        if tag in BLOCKS:
            self.blocks.append([])
        while self.open and self.open.pop() != tag:
            pass

    def handle_data(self, data):
        if "title" in self.open[-1:]:
            self.title.append(data)
        elif not self.hidden:
            self.blocks[-1].append(data)
            if self.open and self.open[-1] in ("h1", "h2", "h3") and self.headings:
                self.headings[-1] += data
            cell = next((t for t in reversed(self.open) if t in ("th", "td")), None)
            if cell and self.row and data.strip():
                self.row[cell].append(data.strip())


ROW = "title string, paragraphs array<string>, headings array<string>, infobox map<string,string>, links array<string>, complete boolean"


def parse(html: str | None) -> tuple:
    page, complete = _Page(), True
    try:
        page.feed(html or "")
        page.close()
    except (AssertionError, ValueError):  # how the parser gives up, as on a number of thousands of digits; what came before stays
        complete = False
    clean = lambda s: re.sub(r"\s+", " ", s).strip()
    return clean("".join(page.title)), [t for b in page.blocks if (t := clean("".join(b)))], [t for h in page.headings if (t := clean(h))], page.box, page.links, complete


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with title, paragraphs, headings, infobox and links. A null page has none. ``complete`` is false where the parser gave up."""

    @F.pandas_udf(ROW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages_ in batches:
            yield pd.DataFrame([parse(h) for h in pages_], columns=["title", "paragraphs", "headings", "infobox", "links", "complete"])

    return pages.withColumn("_page", run(F.col(html_col))).select(*pages.columns, "_page.*")


def stripped(html: Column) -> Column:
    """Tags dropped and ends trimmed, without parsing."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def cut_at_sentence(text: Column, most: int) -> Column:
    """At most ``most`` characters, ending with the last whole sentence among them where there is one."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(head)


def coordinates(html: Column) -> Column:
    """Latitude and longitude from link parameters in degrees, minutes and seconds; null where there are none."""
    pattern = r"params=(\d+)_(\d+)_([\d.]+)_([NS])_(\d+)_(\d+)_([\d.]+)_([EW])"
    part = lambda i: F.regexp_extract(html, pattern, i)
    degrees = lambda i: part(i).try_cast("double") + part(i + 1).try_cast("double") / 60 + part(i + 2).try_cast("double") / 3600
    signed = lambda i, minus: F.when(part(i + 3) == minus, -degrees(i)).otherwise(degrees(i))
    return F.when(part(1) != "", F.struct(signed(1, "S").alias("lat"), signed(5, "W").alias("lon")))


def place_hint(infobox: Column, lead: Column) -> Column:
    """The place of a page with a confidence: the info box before the first paragraph."""
    named = F.coalesce(F.get(F.map_values(F.map_filter(infobox, lambda k, v: F.lower(k).isin("city", "location", "county", "state"))), F.lit(0)), F.lit(None))
    told = F.regexp_extract(lead, r"\bin ([A-Z][\w]+(?: [A-Z][\w]+)?)", 1)
    return F.when(named.isNotNull(), F.struct(named.alias("place"), F.lit(0.9).alias("confidence"))).when(told != "", F.struct(told.alias("place"), F.lit(0.6).alias("confidence")))


def link_table(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``source, target`` page ids of links between the given pages, by exact URL; no page is fetched."""
    found = pages.select(F.col(id_col).alias("source"), F.explode(F.regexp_extract_all(html_col, F.lit(r'(?i)href="([^"]+)"'), F.lit(1))).alias("url"))
    return found.join(pages.select(F.col(id_col).alias("target"), F.col(url_col).alias("url")), "url").where("source <> target").select("source", "target").distinct()


def frontier(links: DataFrame, scores: DataFrame, starts: DataFrame, depth: int, per_page: int = 5, least: float = 5.0) -> DataFrame:
    """``page, depth``: pages reached level by level over each page's best ``per_page`` links of a score above ``least``."""
    from cairn.sources.shared import cut

    order = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    best = links.join(scores.select(F.col("page").alias("target"), "score"), "target").where(F.col("score") > least).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_page)
    seen = cut(starts.select("page", F.lit(0).alias("depth")))
    front = seen
    for level in range(1, depth + 1):
        step = front.join(best, front.page == best.source).select(F.col("target").alias("page")).distinct()
        front = cut(step.join(seen.select("page"), "page", "left_anti").select("page", F.lit(level).alias("depth")))
        seen = seen.union(front)
    return seen

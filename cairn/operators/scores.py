"""Scores and labels of listings, places and articles as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.text import mentions
from cairn.operators.facets import ladder

# Populations between the density classes.
DENSITY = ((5_000, 20_000, 50_000), ("low", "medium", "high", "very_high"))
AMENITIES = {
    "outdoor": ("park", "trail", "beach", "garden"), "dining": ("restaurant", "cafe", "bar"), "shopping": ("shop", "market", "mall"),
    "culture": ("museum", "theater", "gallery", "library"), "transit": ("station", "bus", "train"),
}


# Words that make a key topic one of property, of amenities or of other things; places in scope.
ESTATE_TOPICS = ("real estate", "housing", "property", "development", "residential", "neighborhood", "community", "homes", "architecture", "zoning", "district", "construction", "buildings")
AMENITY_TOPICS = (
    "tourism", "recreation", "shopping", "dining", "schools", "parks", "transit", "downtown", "historic", "cultural", "ski", "resort", "transportation", "highways", "airports",
    "hospitals", "healthcare", "universities", "colleges",
)
OTHER_TOPICS = ("military", "battle", "war", "conflict", "biography", "sports team", "athlete", "album", "song", "movie", "television", "quantum physics", "molecular biology")
TARGET_STATES, TARGET_COUNTIES, TARGET_CITIES = ("utah", "ut", "california", "ca", "calif"), ("summit", "wasatch", "san francisco", "san mateo"), ("park city", "san francisco", "palo alto")


def has_any(value: Column, words: Sequence[str]) -> Column:
    """Whether the lower-cased value contains one of the words; false for null."""
    return F.coalesce(F.lower(value).rlike("|".join(words)), F.lit(False))


def topic_relevance(state: Column, county: Column, city: Column, confidence: Column, topics: Column) -> Column:
    """0.4 of the location, 0.5 of the key topics and 0.1 of county and city, 0.1 more above a confidence of 0.8 and 0.2 less below 0.5; 0 to 1.

    A state in scope counts 1, an unknown one 0.3. Topics of property count 0.2 each beside 0.3, of amenities 0.1, of other things 0.3
    less; with neither of the first two they count 0.2, without topics 0.3.
    """
    location = F.when(state.isNull(), 0.3).when(has_any(state, TARGET_STATES), 1.0).otherwise(0.0)
    n = lambda words: F.size(F.filter(topics, lambda t: has_any(t, words)))
    estate, amenities = n(ESTATE_TOPICS), n(AMENITY_TOPICS)
    base = F.when(estate > 0, F.least(0.3 + 0.2 * estate, F.lit(1.0))).otherwise(0.0)
    about = F.greatest(F.least(base + 0.1 * amenities, F.lit(1.0)) - 0.3 * n(OTHER_TOPICS), F.lit(0.0))
    about = F.when(F.size(topics) <= 0, 0.3).when((estate == 0) & (amenities == 0), 0.2).otherwise(about)
    scope = F.when(has_any(county, TARGET_COUNTIES), 1.0).when(county.isNotNull(), 0.5).otherwise(0.0)
    scope = F.when(has_any(city, TARGET_CITIES), F.least(scope + 0.3, F.lit(1.0))).otherwise(scope)
    sure = F.when(confidence > 0.8, 0.1).when(confidence < 0.5, -0.2).otherwise(0.0)
    return F.greatest(F.least(0.4 * location + 0.5 * about + 0.1 * scope + sure, F.lit(1.0)), F.lit(0.0))


def density(population: Column) -> Column:
    return ladder(population, *DENSITY)


def livability(walk: Column, school: Column, walk_scale: float = 100.0) -> Column:
    """Walkability on 0..``walk_scale`` and schools on 0..10, half each, on 0..100."""
    return walk * F.lit(100.0 / walk_scale) * 0.5 + school * 10 * 0.5


def investment(growth: Column, livable: Column, desirable: Column) -> Column:
    """30, 50 and 20 parts of three shares."""
    return F.least(30 * growth + 50 * livable + 20 * desirable, F.lit(100.0))


def lifestyle(walk: Column, school: Column) -> Column:
    """Walkability from 70 on 0..100 and schools from 8 on 0..10 name a kind of place; a missing value counts as low."""
    # The names and the cuts.
    walks, learns = walk >= 70, school >= 8
    return F.when(walks & learns, "family_friendly_urban").when(walks, "urban_lifestyle").when(learns, "family_oriented").otherwise("standard_community")


def association(names: Column, one: float = 0.1, several: float = 0.15) -> dict[str, Column]:
    """What an array of place names adds to a row: search facet, quality boost, count and flag; a null array is empty."""
    n = F.when(names.isNull(), 0).otherwise(F.size(names))
    facet = F.when(n > 1, "multi_neighborhood").when(n == 1, "has_neighborhood").otherwise("no_neighborhood")
    return {"facet": facet, "boost": F.when(n > 1, several).when(n == 1, one).otherwise(0.0), "n": n, "associated": n > 0}


def completeness(parts: Sequence[Column]) -> Column:
    """1.0 with all parts, 0.7 with any, else 0.3."""
    have = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(have == len(parts), 1.0).when(have > 0, 0.7).otherwise(0.3)


def content_depth(chars: Column) -> Column:
    return ladder(chars, (500, 2_000, 5_000), ("minimal", "basic", "detailed", "comprehensive"))


def article_quality(chars: Column, confidence: Column, places: Column) -> Column:
    """Length up to 5,000 characters and confidence, half each, plus 0.1 for one place and 0.15 for more; at most 1."""
    base = F.least(chars / 5000, F.lit(1.0)) * 0.5 + confidence * 0.5
    return F.least(base + F.when(places > 1, 0.15).when(places == 1, 0.1).otherwise(0.0), F.lit(1.0))


def ranking(quality: Column, relevance: Column, authority: Column, freshness: Column) -> Column:
    return 0.45 * quality + 0.25 * relevance + 0.15 * authority + 0.15 * freshness


def page_relevance(title: Column, text: Column, must: Sequence[str], bonus: Sequence[str], chars: int = 5000, categories: Column | None = None, placed: Column | None = None) -> Column:
    """10 for each must-have word (5 more in the title) and 2 for each bonus word (3 more), in the title and the first ``chars`` characters.

    Each category with a must-have word adds 5, and 1 for each bonus word in it; a page with coordinates (``placed``) 3.
    """
    head = F.concat_ws(" ", title, F.substring(text, 1, chars))
    score = 10 * mentions(head, must) + 5 * mentions(title, must) + 2 * mentions(head, bonus) + 3 * mentions(title, bonus)
    if categories is not None:
        each = F.transform(categories, lambda c: F.when(mentions(c, must) > 0, 5).otherwise(0) + mentions(c, bonus))
        score = score + F.coalesce(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(0))
    return score if placed is None else score + F.when(placed, 3).otherwise(0)


def relevance_flag(score: Column, in_scope: Column) -> Column:
    return F.when(~in_scope, "non_target").when(score < 0.2, "critical").when(score < 0.5, "low_relevance").otherwise("kept")


def amenity_group(name: Column, groups: Mapping[str, Sequence[str]] = AMENITIES) -> Column:
    """The first group with a keyword in the name, else other."""
    out = F
    for group, words in groups.items():
        out = out.when(mentions(name, words) > 0, F.lit(group))
    return out.otherwise(F.lit("other"))


def grade(query: Column, title: Column, summary: Column, body: Column) -> Column:
    """3, 2 or 1 for a keyword in the title, summary or body; else 0."""
    return F.when(F.contains(F.lower(title), query), 3).when(F.contains(F.lower(summary), query), 2).when(F.contains(F.lower(body), query), 1).otherwise(0)


def search_tags(kind: Column, size: Column, price: Column) -> Column:
    return F.array(kind, F.concat(size.cast("string"), F.lit("_size")), ladder(price, (100_000, 200_000, 400_000), ("budget", "affordable", "premium", "luxury")))


# Words of a summary that put an article into a category, in order; topics of an article's categories; what a context is called.
CATEGORY_RULES = (
    ("park", ("park",)), ("historical", ("historical", "history")), ("landmark", ("landmark",)), ("recreation", ("ski", "resort")), ("coastal", ("coast", "beach")), ("mountain", ("mountain",)),
    ("education", ("school", "education")), ("tourist_destination", ("tourist", "tourism")),
)
KEY_TOPICS = (("geography", ("geography", "location")), ("history", ("history", "historic")), ("business", ("business", "company")), ("culture", ("culture", "art")), ("infrastructure", ("transport", "infrastructure")))
CONTEXTS = (("historic", "Historic"), ("residential", "Residential"), ("commercial", "Mixed-Use"))
# A word of a query, words of a description, and what their meeting says.
INSIGHTS = (
    ("modern", ("modern", "contemporary", "updated", "new"), "modern features"), ("mountain", ("view", "mountain", "vista", "scenic"), "scenic location"),
    ("open", ("open", "spacious", "floor plan", "concept"), "open layout"), ("home", ("family", "home", "residential", "neighborhood"), "residential character"),
)


def article_categories(title: Column, summary: Column, county: Column, city: Column, state: Column) -> Column:
    """Category tags of an article in a fixed order: by its place or title, by words of its summary, by its state."""
    tags = [F.when(has_any(title, ("county",)) | county.isNotNull(), "county"), F.when(has_any(title, ("city",)) | city.isNotNull(), "city")]
    tags += [F.when(has_any(summary, words), tag) for tag, words in CATEGORY_RULES]
    return F.array_compact(F.array(*tags, F.when(state == "Utah", "utah").when(state == "California", "california")))


def key_topics(categories: Column) -> Column:
    """Topics whose words the categories have, case kept; none for null."""
    return F.coalesce(F.array_compact(F.array(*[F.when(categories.rlike("|".join(words)), topic) for topic, words in KEY_TOPICS])), F.array().cast("array<string>"))


def context(extract: Column) -> Column:
    """The first kind of area whose word the text has, case kept, else Standard."""
    out = F
    for word, name in CONTEXTS:
        out = out.when(F.contains(extract, F.lit(word)), name)
    return out.otherwise("Standard")


def match_insights(query: Column, description: Column) -> Column:
    """What a description has of what a query asks for."""
    return F.array_compact(F.array(*[F.when(has_any(query, (word,)) & has_any(description, words), says) for word, words, says in INSIGHTS]))

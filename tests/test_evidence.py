"""Evidence of each kind from pages made for it."""

from cairn.operators import evidence, html

LONG = " It has parks, schools and a lively centre, and people like to live there for many reasons that fill this line."
PAGES = {
    1: '<link rel="mw:PageProp/Category" href="./Category:Populated_places_in_Summit_County,_Utah"><link rel="mw:PageProp/Category" href="./Category:Cities_in_Utah"><p>Short.</p>',
    2: '<table class="infobox"><tr><th class="infobox-above" colspan="2">Park City, Utah</th></tr><tr><th class="infobox-label">State</th><td class="infobox-data">Nevada[1]</td></tr>'
    '<tr><th>County</th><td>Summit County, west part</td></tr><tr><th>Coordinates</th><td>40°39′34″N 111°29′59″W</td></tr></table>'
    '<link rel="mw:PageProp/Category" href="./Category:Places_in_Utah">',
    3: f"<p>Short one.</p><p>Oakley is a city in Summit County, Utah.{LONG}</p>",
    4: '<span class="geo">40.5; -111.25</span><p>x</p>',
    5: '<a href="https://geohack.toolforge.org/?params=37.5_N_122.25_W_type:city">map</a>',
    6: '<a href="https://geohack.toolforge.org/?params=37_30_0_S_122_15_36_E">map</a>',
    7: "<p>It lies at 10° 30′ N, 20° 15′ W, on a hill.</p>",
    8: None,
    9: "<table><tr><th>State</th><td>Utah</td></tr></table><p>No info box, so nothing is said. 95°0′N 200°0′E</p>",
}


def table(spark):
    return spark.createDataFrame(list(PAGES.items()), "page_id long, html string")


def test_every_source(spark):
    rows = evidence.evidence(table(spark), "page_id").collect()
    got = {(r.id, r.field, r.source): (r.value, r.confidence) for r in rows}
    assert len(got) == len(rows)
    assert got == {
        (1, "state", "category"): ("Utah", 0.9), (1, "county", "category"): ("Summit", 0.85),
        (2, "state", "category"): ("Utah", 0.9), (2, "state", "infobox"): ("Nevada", 0.95), (2, "county", "infobox"): ("Summit", 0.95), (2, "city", "infobox"): ("Park City", 0.85),
        (2, "coordinates", "infobox"): ("40.65944, -111.49972", 0.9), (2, "coordinates", "text"): ("40.65944, -111.49972", 0.8),
        (3, "city", "lead"): ("Oakley", 0.6), (3, "county", "lead"): ("Summit", 0.6), (3, "state", "lead"): ("Utah", 0.7),
        (4, "coordinates", "geo"): ("40.50000, -111.25000", 0.95), (5, "coordinates", "link"): ("37.50000, -122.25000", 0.9),
        (6, "coordinates", "link"): ("-37.50000, 122.26000", 0.9), (7, "coordinates", "text"): ("10.50000, -20.25000", 0.8),
    }


def test_the_surest_hint_wins_a_conflict(spark):
    best = {(r.id, r.field): (r.value, r.source, r.agree) for r in evidence.resolved(evidence.evidence(table(spark), "page_id")).collect()}
    assert best[2, "state"] == ("Nevada", "infobox", 1) and best[2, "coordinates"] == ("40.65944, -111.49972", "infobox", 2) and best[3, "state"] == ("Utah", "lead", 1)
    tied = spark.createDataFrame([(1, "state", "B", "lead", 0.7), (1, "state", "A", "lead", 0.7)], "id long, field string, value string, source string, confidence double")
    assert evidence.resolved(tied).first().value == "B"


def test_groups_of_categories(spark):
    many = "".join(f'<link rel="mw:PageProp/Category" href="./Category:Historic_place_{i:02}">' for i in range(14))
    page = many + "".join(f'<link rel="mw:PageProp/Category" href="./Category:{c}">' for c in ("Cities_in_Utah", "Cities_in_Summit_County,_Utah", "Mountains_of_Nevada", "Plain"))
    got = {r.kind: r.categories for r in evidence.category_groups(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"), "page_id").collect()}
    assert got == {
        "state": ["Cities in Summit County, Utah", "Cities in Utah", "Mountains of Nevada"], "county": ["Cities in Summit County, Utah"], "city": ["Cities in Utah"],
        "geographic": ["Mountains of Nevada"], "location": [f"Historic place {i:02}" for i in range(10)],
    }


def test_frontier_follows_the_best_links_level_by_level(spark):
    links = spark.createDataFrame([(1, k) for k in range(2, 10)] + [(2, 20), (3, 1), (20, 30), (30, 40)], "source long, target long")
    scores = spark.createDataFrame([(k, 20.0 - k) for k in range(2, 10)] + [(20, 6.0), (30, 9.0), (40, 9.0), (1, 9.0)], "page long, score double")
    got = {r.page: r.depth for r in html.frontier(links, scores, spark.createDataFrame([(1,)], "page long"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 20: 2, 30: 3}
    low = html.frontier(links, scores.withColumn("score", scores.score - 10), spark.createDataFrame([(1,)], "page long"), 2)
    assert {r.page for r in low.collect()} == {1, 2, 3, 4}

"""Shared features, paths and next steps against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import chains, overlap


def brute(held):
    """Shared counts of all pairs of items."""
    items = sorted(held)
    return {(a, b): len(held[a] & held[b]) for k, a in enumerate(items) for b in items[k + 1 :] if held[a] & held[b]}


@pytest.fixture(scope="module")
def held():
    rnd = random.Random(4)
    out = {i: set(rnd.sample("abcdefgh", rnd.randint(1, 6))) for i in range(60)} | {100 + i: set("abcde") for i in range(20)}
    return out | {200: set("abcdefghijklmnopqrstuvwxyz"), 201: set("abcdefghijklmnopqrstuvwx"), 300: {"z"}}


@pytest.fixture(scope="module")
def sets(spark, held):
    rows = [(i, f) for i, fs in held.items() for f in fs] * 2 + [(None, "a"), (7, None)]
    return overlap.feature_sets(spark.createDataFrame(rows, "i long, f string"), "i", "f").cache()


def test_counts_by_inclusion_and_exclusion(sets, held):
    pairs = brute(held)
    want = {}
    for (a, b), n in pairs.items():
        for x in (a, b):
            want[x, n] = want.get((x, n), 0) + 1
    rows = overlap.members(sets).join(overlap.overlaps(overlap.classes(sets)), "rep").collect()
    assert {(r.item, r.together): r["items"] for r in rows} == want


def test_pairs_of_classes(sets, held):
    least = {r.item: r.rep for r in overlap.members(sets).collect()}
    got = {(r.a, r.b): r.together for r in overlap.class_pairs(overlap.classes(sets), 3).collect()}
    want = {(least[a], least[b]): n for (a, b), n in brute(held).items() if n >= 3 and least[a] == a and least[b] == b}
    assert got == want


def test_components_and_first_links(sets, held):
    strong = [p for p, n in brute(held).items() if n >= 4]
    label = {i: i for i in held}
    for _ in held:
        for a, b in strong:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.item: r.label for r in overlap.linked_components(sets, 4).collect()} == label
    others = {i: sorted(a + b - i for a, b in strong if i in (a, b))[:3] for i in held}
    got = {r.item: r.others for r in overlap.nearest_ids(sets, 4, 3).collect()}
    assert all(got.get(i, []) == want for i, want in others.items())


def test_no_facts(spark):
    sets = overlap.feature_sets(spark.createDataFrame([], "i long, f string"), "i", "f")
    assert overlap.overlaps(overlap.classes(sets)).count() == overlap.class_pairs(overlap.classes(sets), 2).count() == overlap.linked_components(sets, 2).count() == 0


def test_least_shortest_lists(spark):
    edges = spark.createDataFrame([(1, 5), (1, 4), (4, 9), (5, 9), (9, 2), (2, 3), (7, 8)], "a long, b long")
    starts = spark.createDataFrame([(1,), (7,)], "node long")
    got = {(r.start, r.node): r.path for r in chains.shortest_lists(edges, starts, 3).collect()}
    assert got == {(1, 1): [1], (1, 4): [1, 4], (1, 5): [1, 5], (1, 9): [1, 4, 9], (1, 2): [1, 4, 9, 2], (7, 7): [7], (7, 8): [7, 8]}


def test_next_above_equals_a_scan(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice("ab"), round(rnd.choice([rnd.uniform(1, 3), rnd.uniform(100, 90_000), 250.0]), 2), i) for i in range(400)]
    probes = [(rnd.choice("abc"), round(rnd.choice([rnd.uniform(0.5, 4), rnd.uniform(90, 95_000), 250.0]), 2)) for _ in range(300)]
    got = chains.next_above(spark.createDataFrame(probes, "k string, above double"), spark.createDataFrame(rows, "k string, v double, id long"), "k", "v")
    want = {(k, x): min((v, i) for kk, v, i in rows if kk == k and v > x) for k, x in probes if any(kk == k and v > x for kk, v, i in rows)}
    assert {(r.k, r.above): (r.v, r.id) for r in got.collect()} == want


def test_upgrades_need_both_steps(spark):
    priced = spark.createDataFrame([(1, 100.0), (2, 130.0), (3, 150.0), (4, 170.0), (5, 400.0)], "id long, price double")
    facts = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "a"), (4, "b"), (4, "c"), (5, "c")], "id long, feature string")
    assert [tuple(r) for r in chains.upgrades(priced, facts).collect()] == [(1, 2, 4)]
    assert spark.range(1).select(chains.first_shared(F.lit(["b", "a", "c"]), F.lit(["c", "b"]), F.lit(["c"])).alias("x")).first().x == ["b"]

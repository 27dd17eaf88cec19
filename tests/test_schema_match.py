"""Schema matching against scoring all pairs in plain code."""

import random
from difflib import SequenceMatcher

import pytest

from tablesync.operators import schema_match as sm

CATALOG = "table string, ordinal int, fieldname string, label string, fieldtype string, extra int"


def ratio(x, y):
    return SequenceMatcher(None, x, y).ratio()


def names(seed, count):
    rng = random.Random(seed)
    made = {"", "_", "ab", "ba", "a", "é\U0001f600x", "x\U0001f600", "q" * 250, "q" * 249 + "z"}
    while len(made) < count:
        parts = ["".join(rng.choices("abcdeo", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        made.add(rng.choice("_ x").join(parts).title() if rng.random() < 0.3 else "_".join(parts))
    return sorted(made)


def catalog(spark, tables):
    rows = [(t, i, *f, 1) for t, fields in tables.items() for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, CATALOG)


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8])
def test_no_pair_above_the_threshold_is_missed(spark, threshold):
    left, right = names(1, 120), names(2, 120)
    frames = [spark.createDataFrame([(b, n) for b in (0, 1) for n in x], "block int, name string") for x in (left, right)]
    got = [tuple(r) for r in sm.similar_names(*frames, threshold).select("block", "l", "r").collect()]
    assert len(got) == len(set(got)) < 2 * len(left) * len(right)
    want = {(b, x, y) for b in (0, 1) for x in left for y in right if ratio(x, y) > threshold}
    assert want <= set(got)


def test_names_held_by_names(spark):
    left, right = names(3, 80), names(4, 120)
    frames = [spark.createDataFrame([(n,) for n in x], "name string") for x in (left, right)]
    got = [tuple(r) for r in sm.held_names(*frames).collect()]
    assert sorted(got) == sorted((x, y) for x in left for y in right if x in y)


def test_tables_against_all_pairs(spark):
    left, right = names(5, 90), names(6, 90)
    field = [("f", None, "Data")]
    a, b = (catalog(spark, {n: field * 2 for n in x}) for x in (left, right))
    want = {}
    for x in left:
        scores = [sm.table_similarity(x, y) for y in right]
        if max(scores) > 0.5:
            want[x] = (right[scores.index(max(scores))], round(max(scores), 6))
    got = sm.match_tables(a, b).collect()
    assert {r.a_table: (r.b_table, r.score) for r in got} == want and len(got) == len(want)
    assert sm.match_tables(a.limit(0), b).count() == 0 == sm.match_tables(a, b.limit(0)).count()


def test_fields_against_all_pairs(spark):
    rng = random.Random(7)
    kinds = {"Data": "text", "Int": "integer", "Date": "date"}
    made = names(8, 60)

    def fields(of):
        return [(rng.choice(made), rng.choice([None, "", *made]), rng.choice(of)) for _ in range(25)]

    side_a = {t: fields([*kinds, None]) for t in ("person", "people", "task")}
    side_a["person"] += [side_a["person"][0], ("cell_no", "Cell", "Data")]
    side_b = {t: fields([*kinds.values(), None]) + [("cell_number", "Cell", "text")] * 2 for t in ("persons", "tasks")}
    pairs = [("person", "persons"), ("people", "persons"), ("task", "tasks"), ("gone", "tasks")]
    tables = spark.createDataFrame(pairs, "a_table string, b_table string")
    want = []
    for x, y in pairs:
        for i, (name, label, kind) in enumerate(side_a.get(x, ())):
            scores = [
                0.4 * ratio(name.lower(), n.lower())
                + 0.3 * (kinds.get(kind) == k and k is not None)
                + 0.3 * ratio((label or "").lower(), (l or "").lower())
                for n, l, k in side_b[y]
            ]
            best = max(scores)
            hit = (side_b[y][scores.index(best)][0], round(best, 6)) if best > 0.7 else (None, None)
            want.append((x, y, i, name, *hit))
    got = [tuple(r) for r in sm.match_fields(catalog(spark, side_a), catalog(spark, side_b), tables).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[4] is not None for r in want) > 5

import random

import numpy as np
import pytest

from tests.llm import brute
from tablesync.llm import mixing, near
from tablesync.llm.components import components
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string, kept boolean, size int, bucket string, k1 long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, True, 5, "z", 9) for r in rows], SCHEMA)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((40, 30), (400, 200), (5000, 4500), (3, 2)):
        pool = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        left, right = near.sketch(pool[:n], 512), near.sketch(pool[n - shared :], 512)
        assert abs((left == right).mean() - shared / (2 * n - shared)) < 0.08
    assert (near.sketch(np.array([7], np.uint64), 512) < np.iinfo(np.uint64).max).all()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(20, 60)] + [(9, 9), (200, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 141)} | {i: 5 for i in range(20, 60)} | {200: 5}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies_chains_and_odd_rows(spark, width):
    rng = random.Random(4)
    rows = []
    for group in range(6):
        text = prose(rng, 120)
        for copy in range(12):  # each differs a little from the one before, so ends may be far apart
            rows.append((group * 100 + copy, "s", " ".join(text)))
            text = [w if rng.random() > 0.02 else "New" for w in text]
    rows += [(900, "s", None), (901, "s", ""), (902, "s", " \n"), (903, "s", "One"), (904, "s", "oNE "), (905, "s", "Öne")]
    rows += [(950, "s", "A b c D e f"), (949, "t", "a B c d E F"), (951, "s", " ".join(prose(rng, 60_000)))]
    want = brute.near([(i, t) for i, _, t in rows], width)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    got = near.near_components(frame(spark, rows), near.Likeness(shingle=width))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    kept = near.keep_one_each(frame(spark, rows), near.Likeness(shingle=width))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").replace(" int", "").split(", ")
    assert {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_members_that_are_unlike_their_head_are_still_linked(spark):
    """One large group around 80 %: many members are linked with others but not with the head."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(160):
        words = list(base)
        family = random.Random(i % 9)  # members of a family share most of their changes
        for at in family.sample(range(100), 9):
            words[at] = f"f{i % 9}x{at}"
        for at in rng.sample(range(100), rng.choice([1, 3, 6])):
            words[at] = rng.choice([f"c{at}", f"own{i}x{at}"])
        rows.append((1000 - i, "s", " ".join(words)))
    want = brute.near([(i, t) for i, _, t in rows], 1)
    assert 1 < len({c for _, c in want.values()})
    got = near.near_components(frame(spark, rows), near.Likeness(shingle=1)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_with_null_and_repeated_ids(spark):
    a, b = "p q r s t u v", "other words than those there are"
    got = near.near_components(frame(spark, [(None, "s", a), (None, "s", a), (4, "s", a), (4, "s", b), (6, "s", b), (6, "s", b)]))
    seen = [(r.doc_id, r.component_id, r.kept) for r in got.collect()]
    assert sorted(seen, key=str) == sorted([(None, None, True)] * 2 + [(4, 4, True)] * 2 + [(6, 4, False)] * 2, key=str)
    assert near.near_components(frame(spark, [])).count() == 0


def test_one_row_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(100)]
    a, b = " ".join(words), " ".join([*words[:99], "other"])
    c, d = " ".join(reversed(words)), "text of its own that nothing else is like"
    rows = [(4, "s", a), (4, "s", a), (4, "s", b), (4, "t", a), (9, "s", b), (None, "s", a), (None, "t", b)]
    rows += [(None, "s", c), (None, "s", c), (None, "t", c.upper()), (7, "s", d), (7, "s", d)]
    rows += [(None, "s", ""), (None, "s", ""), (None, "t", None), (11, "s", " "), (11, "s", " "), (12, "s", " ")]
    got = near.keep_one_each(frame(spark, rows)).collect()
    groups = [(r.doc_id, (r.text or "").strip().lower()[:4]) for r in got]
    want = [(4, "w0 w"), (None, "w99 "), (7, "text"), (None, ""), (None, ""), (11, ""), (12, "")]
    assert sorted(groups, key=repr) == sorted(want, key=repr)


def test_targets_against_resharing(spark):
    rng = random.Random(1)
    for sizes in ({"a": 10, "b": 1000, "é": 5, "z": 0, None: 70}, {f"s{i}": rng.randrange(1, 900) ** 2 for i in range(40)}):
        given = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(given, (5, 2, 1), 1.0, 3.0).collect()}
        assert got == pytest.approx(brute.targets(sizes))


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", "w " * rng.randrange(0, 60)) for i in range(3000)]
    rows += [(5000, None, "x y"), (5001, "s1", None), (None, "s2", "a b c"), (5002, "s3", "a b"), (5002, "s3", "a b")]
    first = mixing.taken(mixing.copies(frame(spark, rows))).collect()
    again = mixing.taken(mixing.copies(frame(spark, rows[::-1]).repartition(3))).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert len(first) == len(rows)
    sums, target = {}, {}
    for r in first:
        sums[r.source] = sums.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    for source, want in target.items():
        assert abs(sums[source] - want) <= 60
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, []).columns
    assert mixed.count() == sum(r.copies for r in first)


def test_mix_of_nothing(spark):
    assert mixing.copies(frame(spark, [])).count() == mixing.mix(frame(spark, [])).count() == 0
    blank = mixing.taken(mixing.copies(frame(spark, [(1, "a", None), (2, "b", " ")]))).collect()
    assert [(r.size, r.target, r.copies) for r in blank] == [(0, 0.0, 0)] * 2


def test_near_query_against_counting(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    rows = QUERIES["op9_near_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near(docs, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)

import math
import os
import random
import re

import numpy as np
import pytest

from tablesync.llm import search
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=50):
    counted = [(doc_id, {t: found.count(t) for t in set(found)}, len(found)) for doc_id, found in ((d, terms(t)) for d, t in docs)]
    n_docs, total = sum(1 for d in counted if d[2]), sum(d[2] for d in counted)
    df = {}
    for _, c, _ in counted:
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    wanted = {}
    for item_id, text in items:
        wanted.setdefault(item_id, set()).update(terms(text))
    for item_id, said in wanted.items():
        scores = []
        for doc_id, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // total if n else 0
            score = 0
            for t in said & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        key = lambda s: (s[0], s[1], s[2] or 0)
        out += [(item_id, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=key)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], f"{name} long, text string, term string, shard int, ids binary")


def test_terms():
    for text in ("", "Ünï a1-B2_c\x7fd\x80", "İ ſ KK", "x@y[z{~|`", "日本 語"):
        assert [t.decode() for t in search.terms_of(text.encode())] == terms(text)


def test_blocks_come_back():
    rng = np.random.default_rng(1)
    for most in (1, 200, 300, 70_000, 1 << 30):
        for n in (1, 2, 7, 128):
            gaps, tfs = rng.integers(0, most + 1, n), rng.integers(1, rng.choice([2, 300, 70_000]), n)
            places, back = search.unpack_block(search.pack_block(gaps, tfs))
            assert places.tolist() == np.cumsum(gaps).tolist() and back.tolist() == tfs.tolist()


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 80, 300])))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_against_scoring_all(spark, monkeypatch, k):
    monkeypatch.setattr(search, "_SHARD_DOCS", 300)
    monkeypatch.setattr(search, "_BLOCK", 8)
    monkeypatch.setattr(search, "_WINDOW", 32)
    monkeypatch.setattr(search, "_ITEMS_PER_GROUP", 3)
    docs = corpus(1500, k)
    docs += [(5000 + i, docs[7 + i % 3][1]) for i in range(90)]  # ties
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(70)], k=rng.randrange(1, 12)))) for i in range(12)]
    assert found(search.search(search.build_index(frame(spark, docs)), frame(spark, items, "item_id"), k)) == ranked(docs, items, k)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "a b"), (3, "a"), (3, "a"), (4, "-- ??"), (5, "long " * 50_000 + "a"), (6, "A b"), (None, "c")]
    items = [(1, "a"), (2, None), (3, "nothing"), (4, ""), (None, "b LONG"), (6, "c"), (6, "b")]
    made = search.build_index(frame(spark, docs))
    assert found(search.search(made, frame(spark, items, "item_id"))) == ranked(docs, items)
    assert search.search(made, frame(spark, [], "item_id")).count() == 0
    none = search.build_index(frame(spark, []))
    assert search.search(none, frame(spark, items, "item_id")).count() == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z"), ("d", "z z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [r.doc_id for r in search.search(search.build_index(docs), items).sort("rank").collect()] == ["a", "b"]


def test_blocks_that_cannot_matter_stay_packed():
    """A common term beside a rare one: once k documents hold both, most of its blocks are never read."""
    n = 100_000
    lengths = np.full(n, 100)
    norm = search.norms(lengths, n, 100 * n)
    blocks = []
    for start in range(0, n, 128):
        places = np.arange(start, min(n, start + 128))
        gaps = np.diff(places, prepend=0)
        gaps[0] = places[0]
        blocks.append((int(places[-1]), search.pack_block(gaps, np.ones(len(places), np.int64))))

    def rare(places):
        packed = search.pack_block(np.diff(np.array(places), prepend=0), np.full(len(places), 9))
        return search.PostingList.of(9000, [places[-1]], [9], [100], [packed], norm, lambda m: search.norms(m, n, 100 * n))

    common = search.PostingList.of(
        3, [b[0] for b in blocks], [1] * len(blocks), [100] * len(blocks), [b[1] for b in blocks], norm,
        lambda m: search.norms(m, n, 100 * n),
    )
    places, scores = search.best_of_shard([common, rare([5, 70, 900, 50_000])], np.arange(n), 3)
    assert sorted(places.tolist()) == [5, 70, 900]
    assert len(common.read) < 20 < len(blocks)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_against_scoring_all(spark):
    read = {n: [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{n}.parquet").select(c, "text").collect()] for n, c in (("documents", "doc_id"), ("benchmark", "item_id"))}
    assert found(QUERIES["op12_ranked_search"](spark, FOLDER)) == ranked(read["documents"], read["benchmark"])

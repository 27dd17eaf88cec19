import os

import pytest

from tests.llm import brute
from tablesync.llm import lines, quality
from tablesync.llm.common import pack
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string, kept string, k1 int, `C0` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


ODD = [
    (1, "a", None), (2, "a", ""), (3, None, " \t\n "), (4, "a", "word"), (None, "b", "Same\nline"),
    (5, "b", "same\nline"), (6, "b", " SAME \x0b\nLine"), (7, "b", "Ünï code\n\n\nend\n"),
    (7, "b", "Ünï code\n\n\nend\n"), (8, "c", "a b c d e f g h " * 3000), (9, "c", "x" * 300_000),
]


def test_repeated_words_against_counting():
    for text in ("a b c d e f g h", "a b c d e f g h " * 2, "a " * 40, "p q " + "a b c d e f g h i " * 2 + "z"):
        assert quality.repeated_words(text.encode().split()) == brute.quality(text)[4]


def test_quality_figures_on_odd_rows(spark):
    rows = quality.judge(frame(spark, ODD)).collect()
    want = sorted(((i, *brute.quality(t)) for i, _, t in ODD), key=repr)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    assert sorted(got, key=repr) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)


def test_boilerplate_is_counted_per_host_and_depleted_documents_go(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(40)]
    menu = " ".join(f"link{j}" for j in range(27))
    rows = [(i, "a", f"{menu}\n{body[i]}") for i in range(30)]  # enough is left
    rows += [(100 + i, "a", f"{menu}\nonly {i} here") for i in range(5)]  # nothing is left
    rows += [(200 + i, "b", f"{menu}\n{body[i]}") for i in range(5)]  # rare on this host
    rows += [(300 + i, "c", body[39]) for i in range(60)]  # copies are one document
    limits = quality.Limits(max_docs=10)
    got = {r.doc_id: r for r in quality.judge(frame(spark, rows), limits).collect()}
    want = brute.boilerplate(rows, 10)
    assert {k: r.removed_words for k, r in got.items()} == want
    assert {k for k, r in got.items() if not r.kept} == set(range(100, 105))
    kept = quality.keep_good(frame(spark, rows), limits)
    assert kept.columns == ["doc_id", "source", "text", "kept", "k1", "C0"]
    assert kept.count() == len(rows) - 5


def test_kept_texts_are_without_boilerplate(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    rows = [(i, "a", f" Home  \tABOUT\n\n{body[i]}\nhome about \n \nown {i}\n") for i in range(30)]
    rows += [(i, "a", rows[0][2]) for i in (0, 0)]  # equal rows stay as many as they were
    rows += [(100, "b", rows[1][2]), (101, None, rows[2][2])]  # rare on these hosts
    rows += [(200 + i, None, f"Ünï\u00a0menu\n{body[i]}" + "\nÜNÏ\u00a0MENU" * (i == 0)) for i in range(15)]
    limits = quality.Limits(max_docs=10)
    got = [(r.doc_id, r.source, r.text) for r in quality.keep_good(frame(spark, rows), limits).collect()]
    assert sorted(got, key=repr) == sorted(brute.without_boilerplate(rows, 10), key=repr)
    texts = {i: t for i, _, t in got}
    assert texts[3] == f"\n{body[3]}\n \nown 3\n" and texts[100] == rows[1][2]
    assert texts[200] == f"{body[0]}\nÜNÏ\u00a0MENU"  # only A-Z are lower-cased


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_on_odd_rows_and_hot_lines(spark, parts):
    rows = [*ODD, *((100 + i, "h", f"Hot line\nown {i}\n{'twice' if i < 9 else 'ten'}\nhot LINE \ntail {i}\n") for i in range(60))]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lines.drop_lines(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute.line_dedup(sorted({(i, t) for i, _, t in rows}, key=repr))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_dropped, brute.sha(r.text)) == want[r.doc_id]
    assert got[0].asDict().keys() == {"doc_id", "source", "text", "kept", "k1", "C0", "n_lines", "n_dropped"}


def test_bitmaps_only_for_documents_that_lose_lines(spark):
    rows = [(i, "s", f"all\nown {i}") for i in range(12)] + [(50, "s", "nothing\nshared")]
    keyed = {(r.k1, r.k2): r.doc_id for r in pack(frame(spark, rows), "doc_id").collect()}
    got = {keyed[r.k1, r.k2]: r.keep_bitmap for r in lines.keep_bitmaps(frame(spark, rows)).collect()}
    assert got.keys() == set(range(12))
    assert lines.read_bitmap(bytes(got[3]), 2).tolist() == [False, True]


def test_a_limit_does_not_grow_with_the_host(spark):
    body = [" ".join(f"w{i}x{j}" for j in range(25)) for i in range(400)]
    rows = [(i, "a", ("menu line\n" if i < 25 else "") + body[i]) for i in range(400)]
    got = {r.doc_id: r.removed_words for r in quality.judge(frame(spark, rows)).collect()}
    assert got == {i: 2 if i < 25 else 0 for i in range(400)} == brute.boilerplate(rows, 20)


def test_ids_of_any_type(spark):
    rows = [(str(i), "a", f"menu\n{' '.join(f'w{i}x{j}' for j in range(25))}") for i in range(30)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, source string, text string")
    assert {r.doc_id: r.removed_words for r in quality.judge(docs).collect()} == brute.boilerplate(rows, 20)
    assert quality.keep_good(docs).count() == 30


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == lines.drop_lines(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_queries_against_counting(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = brute.line_dedup([(i, t) for i, _, t in docs])
    got = QUERIES["op4_line_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want
    figures = {i: brute.quality(t) for i, _, t in docs}
    rows = QUERIES["op8_quality_rules"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows} == figures
    assert all(not (r.kept and r.base_failed) for r in rows)

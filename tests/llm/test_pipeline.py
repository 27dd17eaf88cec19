"""Each stage of the pipeline on what the stage before it kept, against plain versions."""

import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tablesync.llm import mixing
from tablesync.session import stage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def kept(spark):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for name, fn in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(fn(spark, docs, FOLDER), name)
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    return out


def test_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]


def test_quality_stage(kept):
    rows = [(r.doc_id, r.source, r.text) for r in kept[0]]
    removed = brute.boilerplate(rows, 20)
    want = set()
    for i, _, text in rows:
        words, _, _, _, repeated = brute.quality(text)
        left = words - removed[i]
        depleted = removed[i] > 0 and (left < 20 or left < 0.3 * words)
        if words >= 20 and 100 * repeated <= 30 * words and not depleted:
            want.add(i)
    assert {r.doc_id for r in kept[1]} == want


def test_quality_stage_gives_cleaned_texts(kept):
    rows = [(r.doc_id, r.source, r.text) for r in kept[0]]
    want = {i: t for i, _, t in brute.without_boilerplate(rows, 20)}
    assert all(r.text == want[r.doc_id] for r in kept[1])


def test_line_stage(kept):
    want = brute.line_dedup([(r.doc_id, r.text) for r in kept[1]])
    assert {r.doc_id: brute.sha(r.text) for r in kept[2]} == {i: v[2] for i, v in want.items()}


def test_near_stage(kept):
    want = brute.near([(r.doc_id, r.text) for r in kept[2]], 5)
    assert {r.doc_id for r in kept[3]} == {c for _, c in want.values()}


def test_mix_stage(spark, kept):
    copies = {}
    for r in kept[4]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    sizes, taken, largest = {}, {}, {}
    for r in kept[3]:
        n = len(brute.WORD.findall(r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + n * copies.get(r.doc_id, 0)
        largest[r.source] = max(largest.get(r.source, 0), n)
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in kept[3]}
    for source, want in brute.targets(sizes).items():
        assert abs(taken[source] - want) <= largest[source]
    text = {r.doc_id: r.text for r in kept[3]}
    assert all(r.text == text[r.doc_id] for r in kept[4])


def test_encode_stage(kept):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in kept[4]}
    assert len(kept[5]) == len(kept[4])
    for r in kept[5]:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and len(ids) == r.n_tokens


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, fn in corpus_pipeline.STAGES:
        docs = stage(fn(spark, docs, FOLDER), f"empty-{name}")
    assert docs.count() == 0
    assert mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)).count() == 0

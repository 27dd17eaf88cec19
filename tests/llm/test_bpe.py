import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tablesync.llm import bpe
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Encoder(bpe.Vocabulary(file.read()))


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def odd_texts():
    rng = random.Random(7)
    yield from ("", " ", "\n\n  x", "I'll don't 'S 'll  we've", "a<|endoftext|>b <|endoftext|", "   \x1c\x1f\x85 x")
    yield from ("½²Ⅷ三 x", "é‍🇩🇪👩‍👩‍👧", "﻿\x00\x7f", "a" * 5000, " " * 3000, "ab" * 4000 + "!" * 999)
    pools = ["abcdefgh ", "eaiontshr", "0123456789 .,", "äöüßéèçñ ", "".join(map(chr, range(32, 0x250))), "=-_*#/"]
    for n in range(300):
        yield "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(400)))
    for n in range(60):
        yield "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(80))


def test_same_ids_and_text_as_the_library(encoder, library):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder.encode(text)) == want, text
        back = "".join(bpe.decode(np.array(want, np.uint32), encoder.vocabulary.token_bytes))
        assert back == library.decode(want, skip_special_tokens=False)


def test_stable_tokens_of_long_pieces_equal_those_of_one_merge(encoder):
    rng = random.Random(9)
    assert encoder.vocabulary.lookahead < 1000
    tokens = [t for t in encoder.vocabulary.token_bytes if t.isalpha() and len(t) > 3]
    for n in range(12):
        data = b"".join(rng.choice(tokens)[rng.randrange(3) :] for _ in range(900))
        assert len(data) > 2 * encoder.window
        assert list(encoder.stream(data)) == encoder.merge(data)
    for unit in (b"a", b"an", b"ing", b"=", b" ", b"-="):
        assert list(encoder.stream(unit * 4000)) == encoder.merge(unit * 4000)


def test_lookahead_covers_every_context(encoder):
    """A token that ends `lookahead` before the end of what is known never changes."""
    rng = random.Random(5)
    token_bytes = encoder.vocabulary.token_bytes
    ahead = encoder.vocabulary.lookahead
    tokens = [t for t in token_bytes if t and len(t) > 1]
    for n in range(200):
        data = b"".join(rng.choice(tokens) for _ in range(60))
        cut = rng.randrange(ahead, len(data)) if len(data) > ahead else len(data)
        whole, part = encoder.merge(data), encoder.merge(data[:cut])
        at = 0
        for a, b in zip(whole, part):
            at += len(token_bytes[b])
            if at > cut - ahead:
                break
            assert a == b


def test_broken_bytes_decode_as_the_library_does(library, encoder):
    rng = random.Random(3)
    for n in range(300):
        some = [rng.choice([*range(256), rng.randrange(50257)]) for _ in range(9)]
        back = "".join(bpe.decode(np.array(some, np.uint32), encoder.vocabulary.token_bytes))
        assert back == library.decode(some, skip_special_tokens=False)


def test_odd_rows(spark, library):
    schema = "doc_id long, text string, ids string, k1 int, decoded int"
    rows = [(1, None), (2, ""), (None, "x y"), (3, "twice"), (3, "twice"), (4, "long " * 40_000)]
    docs = spark.createDataFrame([(*r, "i", 1, 2) for r in rows], schema)
    got = bpe.decoded(bpe.encode(docs, PATH), PATH).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(map(str, ((r.doc_id, ids(r.ids), r.decoded) for r in got))) == sorted(map(str, want))
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op6_bpe"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(want) and r.decoded_sha256 == brute.sha(d.text or "")
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_ids_of_any_type(spark, library):
    rows = [("a", "one two"), (None, None), ("b", "three " * 300), ("b", "three " * 300), ("c", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = bpe.decoded(bpe.encode(docs, PATH), PATH).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows]
    assert sorted(map(str, ((r.doc_id, ids(r.ids), r.decoded) for r in got))) == sorted(map(str, want))

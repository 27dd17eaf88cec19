import os
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm import brute
from tablesync.llm import piece
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return piece.Encoder(piece.Vocabulary(file.read()))


def odd_texts():
    rng = random.Random(4)
    yield from ("", " ", "  ", "a", " a  b ", "▁x▁", "\n\n\tx", "½ﬁ\x00a", "</s><s><unk><0x41>", "é�　b\xa0")
    yield from ("a" * 5000, " " * 3001, "ab" * 2000 + "!" * 999, "日本語のテキスト" * 200, "👩‍👩‍👧🇩🇪", "\n" * 999)
    pools = ["abcdefgh ", "eaiontshr", "0123456789 .,", "äöüßéèçñ ", "".join(map(chr, range(32, 0x250))), "=-_*#/ ▁"]
    for _ in range(400):
        yield "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(300)))
    for _ in range(60):
        yield "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)])) for _ in range(80))


def test_same_ids_and_text_as_the_library(encoder, library):
    for text in odd_texts():
        want = library.encode(text, add_eos=True)
        got = encoder.encode(text)
        assert got.tolist() == want, text
        assert "".join(piece.decode(got, encoder.vocabulary)) == library.decode(want), text


def test_any_ids_decode_as_the_library_does(encoder, library):
    rng = random.Random(8)
    pools = [range(3, 259), range(259, 280), range(32_000), [0, 1, 2, 28705, 259, 260]]
    for _ in range(3000):
        ids = [rng.choice(rng.choice(pools)) for _ in range(rng.randrange(9))]
        assert "".join(piece.decode(ids, encoder.vocabulary)) == library.decode(ids), ids


def test_cutting_long_segments_changes_nothing(encoder):
    rng = random.Random(2)
    some = [p for p in encoder.vocabulary.ids if not p.startswith(piece.SPACE)]
    for _ in range(40):
        text = "".join(rng.choice(some) for _ in range(200))
        whole = encoder._heaped(text)
        assert [p for a, b in encoder.cut(text, 1) for p in encoder.merged(text[a:b])] == whole
        assert encoder._listed(text) == whole


def test_windows_and_odd_letters(encoder, library, monkeypatch):
    monkeypatch.setattr(piece, "_WINDOW_CHARS", 5)
    for text in odd_texts():
        assert encoder.encode(text).tolist() == library.encode(text, add_eos=True), text
    for text in ("a b  c d", " a b c d e f", "abcdef  ", "abcde f", "abcdef ghijkl  mnop"):
        assert encoder.encode(text).tolist() == library.encode(text, add_eos=True), text
    for text in ("x².y ². a². ²", "1².²b", "é².é"):
        assert encoder.encode(text).tolist() == library.encode(text, add_eos=True), text


def test_a_long_stretch_takes_no_quadratic_time(encoder, library):
    text = "in" * 300_000
    assert encoder.encode(text).tolist() == library.encode(text, add_eos=True)


def test_odd_rows(spark, library):
    schema = "doc_id string, text string, ids string, k1 int, decoded int"
    rows = [("1", None), ("2", ""), (None, "x y"), ("3", "twice"), ("3", "twice"), ("4", "long " * 40_000)]
    docs = spark.createDataFrame([(*r, "i", 1, 2) for r in rows], schema)
    got = piece.encode(docs, PATH, check=True).collect()
    want = [(i, library.encode(t or "", add_eos=True), t or "") for i, t in rows]
    assert sorted(map(str, ((r.doc_id, r.ids, r.decoded) for r in got))) == sorted(map(str, want))
    assert all(r.agrees for r in got)
    assert {r.agrees for r in piece.encode(docs, PATH).collect()} == {None}
    assert piece.encode(docs.limit(0), PATH).count() == 0


def test_results_leave_in_bounded_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 50) for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(piece, "_IDS_PER_BATCH", 60)
    assert sorted(r.doc_id for r in piece.encode(docs, PATH).collect()) == list(range(40))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op13_sentencepiece"](spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = library.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert r.n_tokens == len(want) and r.agrees
        assert r.ids_sha256 == brute.sha(" ".join(map(str, want)))
        assert r.decoded_sha256 == brute.sha(library.decode(want))


def test_a_word_of_letters_is_cut_by_no_pattern(library):
    """Words of plain letters go to the merges as they are, with the ids of the library."""
    with open(PATH, "rb") as file:
        fresh = piece.Encoder(piece.Vocabulary(file.read()))
    assert fresh.plain_letters
    fresh.spaced_ids = None  # what cuts a word into segments
    text = "par éreèment queê ñboadorr 日本語のテキスト ĸŉſ"
    assert list(fresh.encode(text)) == library.encode(text, add_eos=True)


def test_many_words_and_segments_are_merged_together(library):
    """Unknown words of a group of texts, and segments of a text with other spaces, go to the merges
    in columns, none of them alone; ids are those of the library."""
    with open(PATH, "rb") as file:
        fresh = piece.Encoder(piece.Vocabulary(file.read()))
    rng = random.Random(7)
    letters = "etaoinshrdlu" * 3 + "ETAéß日0123,.\n\t-'"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, 1000, 20)]
    texts.append(" ".join(w + " " * rng.randrange(12) for w in words[1000:]))
    fresh._listed = fresh._heaped = None
    assert [ids.tolist() for ids in fresh.encode_all(texts)] == library.encode(texts, add_eos=True)


@pytest.mark.parametrize("room", [16, 1])
def test_merged_together_as_one_by_one(encoder, monkeypatch, room):
    """Also where pieces share a rank (runs of spaces) and rows of pairs go to the end of their table."""
    monkeypatch.setattr(piece, "_ROOM_PER_PAIR", room)
    merges = encoder.merges if room == 16 else piece.Merges(encoder.vocabulary)
    rng = random.Random(5)
    pieces = list(encoder.vocabulary.ids)
    stretches = [s[:48] for t in odd_texts() for s in (t, t.replace(" ", piece.SPACE)[-48:]) if s]
    stretches += ["".join(rng.choices(pieces, k=6))[: piece._PLACES - 2] for _ in range(2000)]
    found = dict(merges.packed(stretches))
    assert len(found) > 2000
    for i, packed in found.items():
        assert packed == encoder._packed(encoder._heaped(stretches[i])), stretches[i]


def test_words_are_learnt_in_groups_of_any_size(encoder, library, monkeypatch):
    texts = list(odd_texts())
    want = library.encode(texts, add_eos=True)
    for size, limit in ((1, 1), (50, 100), (5000, 10)):
        monkeypatch.setattr(piece, "_BYTES_TOGETHER", size)
        monkeypatch.setattr(piece, "_KNOWN_WORDS", limit)
        monkeypatch.setattr(piece, "_KNOWN_SEGMENTS", limit)
        monkeypatch.setattr(piece, "_TOGETHER", range(2, 7))
        fresh = piece.Encoder(encoder.vocabulary)
        assert [ids.tolist() for ids in fresh.encode_all(texts)] == want
        assert [fresh.encode(t).tolist() for t in texts] == want

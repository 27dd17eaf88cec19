import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tablesync.llm import ppm, secret_scan
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, lettered boolean, spans string, base int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, True, "s", 1) for r in rows], SCHEMA)


def plain_bits(train, text, order):
    """Code length of a text under one language's frozen statistics, byte by byte."""
    counts = defaultdict(Counter)
    for data in train:
        for i in range(len(data)):
            for k in range(order + 1):
                if i >= k:
                    counts[data[i - k : i]][data[i]] += 1
    total = 0.0
    for i, c in enumerate(text):
        for k in range(min(order, i), -1, -1):
            of = counts.get(text[i - k : i])
            if of is None:
                continue
            n, d = sum(of.values()), len(of)
            if c in of:
                total -= math.log2(of[c] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += math.log2(257)
    return total


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_code_lengths_are_exact(spark, monkeypatch, piece):
    monkeypatch.setattr(ppm, "_PIECE", piece)
    rng = random.Random(1)
    learnt = {
        lang: ["".join(rng.choice(letters) for _ in range(200)) for _ in range(5)]
        for lang, letters in (("x", "abcd é"), ("y", "bcdef ü"), ("z", "xyz"))
    }
    model = ppm.train(frame(spark, [(i, t, lang) for lang, ts in learnt.items() for i, t in enumerate(ts)]))
    for text in ("abcd bcda", "éü? never seen", "xyzzy" * 9, "a", "0", "dcba é" * 30):
        got = model.bits(np.frombuffer(text.encode(), np.uint8))
        want = [plain_bits([t.encode() for t in learnt[lang]], text.encode(), 3) for lang in model.langs]
        assert got == pytest.approx(want, rel=1e-9)


def test_every_language_is_learnt_and_models_agree_with_one_wide_model(spark):
    """66 languages, two more than one model holds; the last ones are the rarest."""
    rng = random.Random(3)
    letters = {f"l{n:02}": [chr(0x4E00 + 7 * n + i) for i in range(5)] for n in range(66)}
    made = {lang: ["".join(rng.choices(own, k=60)) for _ in range(3)] for lang, own in letters.items()}
    rare = ("l03", "l65")
    known = [(i, t, lang) for lang, ts in made.items() for i, t in enumerate(ts[: 1 if lang in rare else 2])]
    rows = [(n, ts[2], lang) for n, (lang, ts) in enumerate(made.items())]
    rows += [(3, made["l03"][2], "l03")] * 2 + [(100, None, None), (None, "12", None), (101, "abc " * 20, None)]
    rows += [(102, made["l03"][2] + made["l65"][2], None), (103, "ё" + "z" * 3, None)]
    several = ppm.train(frame(spark, known))
    got = ppm.identify(frame(spark, rows), several).collect()
    wide = ppm.train(frame(spark, known), ppm.Training(languages_a_model=66))
    assert len(wide.langs) == 66
    want = ppm.identify(frame(spark, rows), wide).collect()
    key = lambda r: (repr(r.doc_id), r.k1)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(r.doc_id, r.k1, r.k2, r.lang_pred) for r in got] == [(r.doc_id, r.k1, r.k2, r.lang_pred) for r in want]
    assert [r.score for r in got] == pytest.approx([r.score for r in want], rel=1e-6)
    assert {r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 66} == set(letters)
    assert len(got) == len(rows)


def test_languages_of_odd_rows(spark):
    known = [(1, "the cat and the dog " * 9, "en"), (2, "der Hund und die Katze " * 9, "de"), (3, "x", None), (4, None, "en")]
    model = ppm.train(frame(spark, known))
    rows = [(1, None, None), (2, "", None), (3, "123 :-)", None), (None, "die Katze", None), (5, "the dog " * 50_000, "de"), (5, "the dog " * 50_000, "de")]
    got = [(r.doc_id, r.lang_pred) for r in ppm.identify(frame(spark, rows), model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "und"), (2, "und"), (3, "und"), (None, "de"), (5, "en"), (5, "en")]))
    none = ppm.train(frame(spark, []))
    assert [r.lang_pred for r in ppm.identify(frame(spark, known[:1]), none).collect()] == ["und"]


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op3_language_id"](spark, FOLDER).collect() if r.held_out]
    assert len(rows) > 20 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97


def test_base_spans_of_odd_texts(spark):
    key, hexed = "AKIA" + "Z9" * 9, "0123456789abcdef" * 2
    texts = [
        None, "", "token=token:abcdefgh", "TOKEN : 'abcdef'x", "api-key=abcdefg apikey=abcdefg Api_Key\"=\"abcdefg",
        f"ünï {key} {hexed}{key}", f"password = \"{hexed}\"", f"{hexed}\n" * 700, "secret" * 20_000 + "=abcdef",
        "passwd  :=  x.y-z=/+_ tail", "ſecret=abcdef toKen=abcdef", "f" * 200_000, "token " * 9 + ":" * 9 + "abcdef",
    ]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[4], "en"), (3, texts[3], "en")]
    ratio = secret_scan.train(secret_scan.samples_by_rule(spark, 200))
    got = secret_scan.scan(frame(spark, rows), ratio).collect()
    assert len(got) == len(rows)
    text_of = dict(enumerate(texts))
    for r in got:
        base = [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3]
        assert base == brute.secrets(text_of[4 if r.doc_id is None else r.doc_id])
    written = {r.doc_id: r for r in secret_scan.digests(secret_scan.scan(frame(spark, rows), ratio)).collect()}
    assert written[0].spans == "" and written[6].n_assign == 1 and written[7].n_hex == 700
    assert secret_scan.scan(frame(spark, []), ratio).count() == 0


def test_random_tokens_are_told_from_words(spark):
    words = "the quick configuration handler returns another internal response object".split()
    plain = [("_".join((a, b)), False) for a in words for b in words] + [(w, False) for w in words]
    samples = secret_scan.samples_by_rule(spark, 300).unionByName(spark.createDataFrame(plain, "token string, random boolean"))
    ratio = secret_scan.train(samples)
    hidden, ordinary = "q7Zp0XfK2mVb9LrT4wYs", "configuration_handler_response"
    rows = [(1, f"see {hidden}, then {ordinary}.", "en"), (2, f"token={hidden}", "en")]
    found = {r.doc_id: r.spans for r in secret_scan.digests(secret_scan.scan(frame(spark, rows), ratio)).collect()}
    assert found == {1: f"random:4:{4 + len(hidden)}", 2: f"assign:0:{6 + len(hidden)}"}


def test_secret_query_against_matching(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op5_secret_scan"](spark, FOLDER).collect()
    for r in rows:
        base = brute.secrets(text[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r.base_sha256 == brute.sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base))


def words_of(folder, remainder):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    found = {w for r in texts if r["doc_id"] % 2 == remainder for w in (r["text"] or "").split()}
    return sorted(w for w in found if len(w) > 4 and w.isascii() and w.isalpha())


@pytest.fixture(scope="module")
def query_ratio(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text")
    return secret_scan.train(secret_scan.samples_by_rule(spark).unionByName(secret_scan.ordinary_samples(docs)))


def test_secrets_joined_to_names_are_found_and_plain_tokens_are_not(spark, query_ratio):
    hidden = "Xk29FjQ7LmZp04Ta", "wJalrXUtnFEMIK7MDENGb", "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ84tZ3"
    access = "AKIA" + "IOSFODNN7EXAMPLE"
    texts = [
        f"internal_database_connection_pass_hash_for_staging_environment={hidden[0]}",
        f"theinternal_configuration_handler_response_environment_service_name/{hidden[1]}",
        f"{access}/{hidden[2]}",
        f"{hidden[1]}/the_long_configuration_of_the_service/and_of_the_handler/{hidden[2]}",
    ]
    want = [{hidden[0]}, {hidden[1]}, {access, hidden[2]}, {hidden[1], hidden[2]}]
    plain = [
        "4390698575873170", "-" * 16, "=" * 24, "_" * 40, "2024-01-01T00-00-00", "20240101000000123",
        "/usr/local/lib/python3/site-packages", "configuration_handler_response_name", "getInternalResponseHandler",
        "/var/lib/containers/storage/overlay/images", "/home/user/website/index/main-page",
    ]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *plain])]
    got = {r.doc_id: {s.token for s in r.spans} for r in secret_scan.scan(frame(spark, rows), query_ratio).collect()}
    assert got == {i: want[i] if i < len(want) else set() for i in range(len(rows))}


def test_precision_and_recall_on_held_out_strings(spark, query_ratio):
    rng = random.Random(11)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [upper + lower + digits, upper + lower + digits + "-_", lower + digits, upper + digits]
    secrets = ["".join(rng.choices(a, k=rng.randint(20, 40))) for a in alphabets for _ in range(250)]
    words = words_of(FOLDER, 1)
    plain = [rng.choice("_-/=").join(rng.choices(words, k=rng.randint(2, 5))) for _ in range(800)]
    plain += ["".join(rng.choices(digits, k=rng.randint(16, 24))) for _ in range(200)]
    rows = [(i, t, "en") for i, t in enumerate([*secrets, *plain])]
    found = {r.doc_id: r.spans for r in secret_scan.scan(frame(spark, rows), query_ratio).collect()}
    hit = sum(any(s.kind in (2, 3) for s in found[i]) for i in range(len(secrets)))
    wrong = sum(any(s.kind == 3 for s in found[i]) for i in range(len(secrets), len(rows)))
    assert hit / len(secrets) > 0.95, hit
    assert hit / (hit + wrong) > 0.95, wrong


def test_blanked_texts_keep_positions(spark):
    text = 'ü token=abc token="abcdefgh" AKIA' + "Z9" * 9 + " end"
    df = spark.createDataFrame([(text,), ("",)], "t string")
    got = df.select(secret_scan.blank(F.col("t"), secret_scan.ASSIGN, F.lit(True), 2, 6).alias("t")).collect()
    assert [r.t for r in got] == ["ü token=abc " + " " * 15 + text[27:], ""]


def test_ordinary_samples_are_bounded_and_take_equal_rows_once(spark):
    rows = [(1, "hello there", "en")] * 50 + [(i, f"word{'abc'[i % 3] * 4} alpha", "en") for i in range(2, 40)]
    docs = frame(spark, rows)
    assert docs.count() == 88
    got = secret_scan.ordinary_samples(docs, most_docs=1000).where("token = 'hello'").count()
    assert got == 2  # as it stands and lower-cased
    assert secret_scan.ordinary_samples(docs, most_docs=3).where("token = 'alpha'").count() <= 6
    assert secret_scan.ordinary_samples(docs.limit(0)).count() == 0

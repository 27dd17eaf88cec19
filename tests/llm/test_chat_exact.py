"""Chat formatting and exact dedup on odd rows, against plain code."""

import hashlib
import re

import pytest

from tests.llm import brute
from tablesync.llm import chat, exact, mixing
from tablesync.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, marked string, n int, turns int"
DOCS = "doc_id long, text string, digest string, normal string, k1 int, rows int"


def turns_of(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        out.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in out.items()}


def escaped(text):
    return re.sub(r"([<\[])(\\*)(/?s>|/?INST\])", r"\1\\\2\3", text)


def examples_of(rows):
    out = []
    for conv_id, turns in turns_of(rows).items():
        for n in range(1, len(turns) + 1):
            learns = turns[n - 1][0] == "assistant"
            if learns or n == len(turns):
                said = "".join(f"[INST]{escaped(r)}[/INST]{escaped(t)}</s>" for r, t in turns[:n])
                out.append((conv_id, n, n == len(turns), learns, "<s>" + said, turns[n - 1][1] if learns else ""))
    return sorted(out, key=repr)


def frame(spark, rows, schema):
    extra = (1, 2) if schema == TURNS else (3, 4)
    return spark.createDataFrame([(*r, "x", *extra) if schema == TURNS else (*r, "x", "y", *extra) for r in rows], schema)


ODD_TURNS = [
    (1, 0, "user", "Hi"), (1, 1, "assistant", "<s>[INST] x </s> <\\s> [/INST]"), (1, 2, "user", None),
    (2, None, "assistant", "no number"), (2, 0, "user", "zero"), (2, 0, "assistant", "tie"), (None, 5, None, "lost"),
    (None, 4, "assistant", ""), (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice"), (4, 1, "user", ""),
    (5, 1, "user", "long " * 60_000), (5, 2, "assistant", "Ünï 👩‍👩‍👧 " * 20_000), (6, 1, "[INST]", "odd role"),
]


def test_examples_of_odd_turns(spark):
    made = chat.examples(frame(spark, ODD_TURNS, TURNS)).collect()
    got = sorted(
        (
            (r.conv_id, r.last_turn, r.whole, r.trainable, r.formatted,
             re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", r.formatted[r.loss_start : r.loss_end]))
            for r in made
        ),
        key=repr,
    )
    assert got == examples_of(ODD_TURNS)
    assert chat.examples(frame(spark, [], TURNS)).count() == 0


def test_summaries_read_everything_back(spark):
    rows = chat.summaries(chat.examples(frame(spark, ODD_TURNS, TURNS))).collect()
    want = turns_of(ODD_TURNS)
    assert len(rows) == len(want)
    for r in rows:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))


ODD_DOCS = [
    (1, None), (2, ""), (3, " \t\n"), (None, "a b"), (4, "ab"), (5, "a  b"), (5, "a  b"), (6, "AB"), (7, "Ünï x"),
    (8, "Ünï  x"), (9, "x" * 300_000), (10, "x" * 299_999 + " x"), (11, "only"), (None, "none"), (None, "no ne"),
]


def groups_of(rows):
    out = {}
    for doc_id, text in rows:
        out.setdefault(re.sub("[ \t-\r]", "", text or ""), []).append((doc_id, text or ""))
    return out


def expected(rows):
    out = []
    for normal, members in groups_of(rows).items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc_id, keep, len(members), brute.sha(normal)) for doc_id, _ in members]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in df.collect()), key=repr)


def test_copies_of_odd_rows(spark):
    docs = frame(spark, ODD_DOCS, DOCS)
    got = exact.copies(docs)
    assert found(got) == expected(ODD_DOCS)
    kept = [r for r in got.collect() if r.kept]
    assert len(kept) == len(groups_of(ODD_DOCS)) and all(r.doc_id == r.keep_id for r in kept)
    assert exact.copies(frame(spark, [], DOCS)).count() == 0


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = [(i, f"text {i % 3}") for i in range(30)]
    got = exact.copies(frame(spark, rows, DOCS), digest=lambda c: exact.F.lit("same"), salts=3).collect()
    assert {(r.doc_id % 3, r.keep_id, r.group_size) for r in got} == {(0, 0, 10), (1, 1, 10), (2, 2, 10)}


def test_drop_copies_leaves_one_row_of_each_group(spark):
    docs = frame(spark, ODD_DOCS, DOCS)
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len(got) == len(groups_of(ODD_DOCS))
    assert {re.sub("[ \t-\r]", "", t or "") for _, t in got} == set(groups_of(ODD_DOCS))


@pytest.mark.parametrize("copies", [500])
def test_a_hot_group(spark, copies):
    rows = [(i, "hot text" + " " * (i % 5)) for i in range(copies)] + [(1000 + i, f"own {i}") for i in range(100)]
    assert found(exact.copies(frame(spark, rows, DOCS))) == expected(rows)


def test_exact_query_against_plain_code(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op10_exact_dedup"](spark, FOLDER).withColumnRenamed("text_sha256", "digest")
    assert found(got) == expected(docs)


def test_mix_query_keeps_to_its_targets(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op1_mix_sources"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        d = docs[r.doc_id]
        assert r["size"] == len(re.findall(r"[^ \t-\r]+", d.text or "")) and r.taken <= 3 * r["size"]
        sizes[d.source] = sizes.get(d.source, 0) + r["size"]
        taken[d.source] = taken.get(d.source, 0) + r.taken
        target[d.source] = r.target
    total, longest = sum(sizes.values()), max(r["size"] for r in rows)
    assert all(r.source_size == sizes[docs[r.doc_id].source] for r in rows)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for source, want in target.items():
        assert want <= 3 * sizes[source] + 1e-6 and abs(taken[source] - want) <= longest
    again = {r.doc_id: r.taken for r in QUERIES["op1_mix_sources"](spark, FOLDER).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix and hashlib.sha256(b"").hexdigest() == brute.sha("")


def test_one_conversation_with_half_of_all_turns(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(700)]
    rows += [(i, t, ("user", "assistant")[t % 2], f"{i} {t}") for i in range(2, 180) for t in range(4)]
    made = chat.examples(frame(spark, rows, TURNS).repartition(5))
    got = sorted(((r.conv_id, r.last_turn, r.whole, r.trainable, r.formatted) for r in made.collect()), key=repr)
    assert got == sorted((e[:5] for e in examples_of(rows)), key=repr)


def test_limits_of_blocks(spark):
    for n in (63, 64, 65, 128, 129):
        rows = [(c, i, "user", f"{c} {i}") for c in (None, 7) for i in range(n)]
        made = chat.examples(frame(spark, rows, TURNS)).collect()
        assert sorted((r.last_turn, r.whole, r.formatted) for r in made) == sorted(
            (e[1], e[2], e[4]) for e in examples_of(rows)
        )

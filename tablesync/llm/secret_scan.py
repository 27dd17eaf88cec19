"""Secret scans: fixed patterns, and parts of tokens that look random to two character Markov models.

A token is a run of symbols outside all fixed spans. Secrets are joined to names and paths, so
not the run is judged but its segments: the parts between delimiters add up their log ratios,
and each best stretch of parts above the margin is a span (a running sum, begun again at zero
and ended where it has fallen by the margin)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, pack

# Fixed patterns. Letters of `assign` in either case; its second group needs 6 characters,
# an `access` match 20 and a `hex` match 24.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs of one class are maximal matches, so a least length inside the pattern finds the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

_SYMBOL = "A-Za-z0-9+/_=-"
_PART = r"[/_=-]*[A-Za-z0-9+]+|[/_=-]+"  # a part and the delimiters before it
# Every text with an `assign` match has one of these, lower-cased.
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# Usual parts of paths, samples of ordinary names beside the corpus's own words.
_PLACES = (
    "usr local lib bin etc var home opt src share include python3 site-packages node_modules dist build index "
    "html http https www com org images static assets scripts config data docs tests main user projects lib64 "
    "cache tmp log server client package module version download upload content public private system library"
)
_CODES = 128  # all symbols are ASCII; code 0 stands before a token's first
_BLOCK = 256
_START = chr(1)


@dataclass(frozen=True)
class Suspicion:
    """A stretch of parts of at least `min_chars` symbols is a secret if the random-string model
    gives it a log-likelihood (natural) larger than the identifier model's by `margin`. Pairs of
    symbols are smoothed with `smoothing` observations of the symbols' frequencies over both
    classes, so that what neither has seen speaks for none."""

    min_chars: int = 16
    margin: float = 8.0
    smoothing: float = 10.0


def _running_sum(lengths: Column) -> Column:
    """Prefix sums, in blocks, so that the work does not grow with the square of the number."""

    def grow(state: Column, x: Column) -> Column:
        total = state["total"] + x
        return F.struct(total.alias("total"), F.concat(state["all"], F.array(total)).alias("all"))

    def summed(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(values, start, grow)

    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(_BLOCK))).otherwise(
        F.array().cast("array<int>")
    )
    blocks = F.transform(starts, lambda i: summed(F.slice(lengths, i, _BLOCK)))
    ends = summed(F.transform(blocks, lambda b: b["total"]))["all"]
    shifted = F.zip_with(
        blocks, ends, lambda b, end: F.transform(b["all"], lambda x: x + end - b["total"])
    )
    return F.flatten(shifted)


def find(text: Column, pattern: str, kind: int, where: Column, group: int = 0, min_chars: int = 1) -> Column:
    """Matches of a pattern, leftmost and non-overlapping, whose `group` has `min_chars`:
    array<struct<start, kind, end, token>> in code points.

    The matches and the text between them, laid end to end, are the text, so sums of their
    lengths are the positions. `where` holds for every text with a match; others are not cut.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    lengths = F.zip_with(
        F.slice(between, 1, F.size(hits)), hits, lambda gap, hit: gap + F.char_length(hit)
    )
    spans = F.zip_with(
        F.arrays_zip(hits.alias("hit"), groups.alias("token")),
        _running_sum(lengths),
        lambda m, end: F.struct(
            (end - F.char_length(m["hit"])).alias("start"), F.lit(kind).alias("kind"),
            end.alias("end"), m["token"].alias("token"),
        ),
    )
    long = F.filter(spans, lambda s: F.char_length(s["token"]) >= min_chars)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
    return F.when(where, long).otherwise(none)


def _pairs(token: Column) -> Column:
    """Each symbol with the one before it, as one number."""
    codes = F.transform(F.split(token, ""), F.ascii)
    before = F.concat(F.array(F.lit(ord(_START))), F.slice(codes, 1, F.size(codes) - 1))
    return F.zip_with(before, codes, lambda a, b: a * _CODES + b)


def blank(text: Column, pattern: str, where: Column, group: int = 0, min_chars: int = 1) -> Column:
    """The text with the matches that `find` gives overwritten by spaces; positions stay."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    written = F.zip_with(
        F.slice(gaps, 1, F.size(hits)),
        F.arrays_zip(hits.alias("hit"), groups.alias("token")),
        lambda gap, m: F.concat(
            gap,
            F.when(F.char_length(m["token"]) >= min_chars, F.repeat(F.lit(" "), F.char_length(m["hit"]))).otherwise(m["hit"]),
        ),
    )
    return F.when(where, F.concat(F.array_join(written, ""), F.element_at(gaps, -1))).otherwise(text)


def samples_by_rule(spark: SparkSession, each: int = 2000) -> DataFrame:
    """(token, random): strings made by rules from hashes of numbers. Random ones in the usual
    alphabets, and ordinary ones that a corpus of prose lacks: paths, numbers, dates, versions, rulers."""

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)

    def coded(salt: str) -> Column:
        return F.regexp_replace(F.base64(F.unhex(digest(salt))), "=", "")

    plain = F.regexp_replace(coded("sample"), "[+/]", "")
    random = F.array(
        F.substring(digest("sample"), 1, 40), plain, F.reverse(plain), F.upper(F.substring(plain, 1, 20)),
        F.lower(F.substring(plain, 1, 24)), coded("whole"), F.translate(coded("url"), "+/", "-_"),
    )
    number = F.translate(digest("number"), "abcdef", "012345").substr(F.lit(1), (1 + F.col("id") % 24).cast("int"))
    places = F.lit(_PLACES.split())

    def place(salt: int) -> Column:
        return F.get(places, F.pmod(F.xxhash64("id", F.lit(salt)), F.size(places)).cast("int"))

    at = F.timestamp_seconds(F.abs(F.xxhash64("id")) % (2 * 10**9))
    ordinary = F.array(
        F.concat(F.lit("/"), F.concat_ws("/", *[place(i) for i in range(4)])), F.concat_ws("_", place(4), place(5)),
        number, F.concat_ws("-", number.substr(1, 4), number.substr(3, 4), number.substr(5, 4)),
        F.concat(F.lit("v"), number.substr(1, 1), F.lit("_"), number.substr(2, 2)),
        *[F.date_format(at, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH-mm-ss")],
        F.repeat(F.substring(F.lit("-=_/+"), (1 + F.col("id") % 5).cast("int"), F.lit(1)), (3 + F.col("id") % 60).cast("int")),
    )
    made = spark.range(each).select(random.alias("yes"), ordinary.alias("no"))
    return made.select(F.explode("yes").alias("token"), F.lit(True).alias("random")).unionByName(
        made.select(F.explode("no").alias("token"), F.lit(False).alias("random"))
    )


def ordinary_samples(docs: DataFrame, most_docs: int = 500) -> DataFrame:
    """(token, random): the letter-only words of at most `most_docs` documents, alone and joined
    as identifiers and paths are. The documents are those with the smallest row hashes; equal
    rows are one. The bound is a parameter of the model, not of the scan.

    Only hashes below a limit are ranked, about twice as many as are wanted, and texts are read
    where they lie, so no task meets more than its share of the table."""
    rows = pack(docs, "text").filter("text is not null").select(*KEY, "text")
    count = rows.count()
    below = int(min(1.0, 2 * (most_docs + 50) / max(count, 1)) * (1 << 32))
    few = rows.filter(F.pmod("k1", F.lit(1 << 32)) < below)
    keys = few.select(*KEY).distinct().orderBy(F.pmod("k1", F.lit(1 << 32)), *KEY).limit(most_docs)
    some = few.join(F.broadcast(keys), [*KEY], "left_semi").dropDuplicates([*KEY])  # at most most_docs keys
    words = F.explode(F.regexp_extract_all("text", F.lit(r"(?<![\w+/=-])[A-Za-z]{4,}(?![\w+/=-])"), F.lit(0)))
    digits = F.pmod(F.xxhash64("token"), F.lit(1000)).cast("string")
    forms = F.array(
        F.col("token"), F.lower("token"), F.concat("token", F.lit("_"), "token"), F.concat("token", F.initcap("token")),
        F.concat(F.lit("/"), "token", F.lit("/"), "token", F.lit("-"), "token"),
        F.concat("token", F.lit("="), "token"), F.concat("token", digits), F.concat("token", F.lit("-"), digits, F.lit("/")),
        F.upper(F.concat("token", F.lit("_"), "token")),
    )
    return some.select(words.alias("token")).select(F.explode(forms).alias("token"), F.lit(False).alias("random"))


def train(samples: DataFrame, suspicion: Suspicion = Suspicion()) -> list[float]:
    """samples (token, random) -> the log-likelihood ratio of each pair of symbols, at
    code before x 128 + code. Counting runs on Spark; at most two rows per pair of symbols
    come to the driver."""
    counted = (
        samples.filter(F.col("token").rlike(rf"^[{_SYMBOL}]+$"))
        .select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    symbols = [c for c in range(_CODES) if chr(c).isalnum() or chr(c) in "+/_=-"]
    seen = {(r.random, r.pair): r["count"] for r in counted}
    ratio = [0.0] * (_CODES * _CODES)
    contexts = [ord(_START), *symbols]
    usual = dict.fromkeys(symbols, 0.0)  # of each symbol, whatever its class and what came before it
    for random in (True, False):
        counts = [sum(seen.get((random, a * _CODES + b), 0) for a in contexts) + 0.5 for b in symbols]
        for b, c in zip(symbols, counts):
            usual[b] += c / sum(counts) / 2
    for a in contexts:
        logs = []
        for random in (True, False):
            counts = [seen.get((random, a * _CODES + b), 0) + suspicion.smoothing * usual[b] for b in symbols]
            logs.append([math.log(c / sum(counts)) for c in counts])
        for b, yes, no in zip(symbols, *logs):
            unseen = not any((random, a * _CODES + b) in seen for random in (True, False))
            ratio[a * _CODES + b] = 0.0 if unseen else round(yes - no, 6)
    return ratio


def segments(token: Column, start: Column, ratio: list[float], suspicion: Suspicion) -> Column:
    """The best stretches of a token's parts: array<struct<start, kind, end, token>>, in order and
    disjoint. Each starts behind the delimiters of its first part."""
    table = F.lit(np.array(ratio))  # one constant of the plan, not parsed or built per row
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = F.regexp_extract_all(token, F.lit(_PART), F.lit(0))
    ends = _running_sum(F.transform(parts, F.char_length))
    before = F.concat(F.array(F.lit(_START)), F.transform(parts, lambda p: F.right(p, F.lit(1))))

    def scored(part: Column, last: Column) -> Column:
        pairs = F.slice(_pairs(F.concat(last, part)), F.lit(2), F.char_length(part))
        return F.aggregate(pairs, F.lit(0.0), lambda total, pair: total + F.get(table, pair))

    items = F.zip_with(
        F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, last: F.struct(
            scored(p, last).alias("score"), F.char_length(F.regexp_replace(p, "^[/_=-]+", "")).alias("body"),
        )),
        ends, lambda p, end: F.struct(p["score"].alias("score"), (end - p["body"]).alias("start"), end.alias("end")),
    )

    def closed(state: Column) -> Column:
        good = (state["best"] > suspicion.margin) & (state["end"] - state["start"] >= suspicion.min_chars)
        span = F.array(F.struct(state["start"].alias("start"), state["end"].alias("end")))
        return F.when(good, F.concat(state["found"], span)).otherwise(state["found"])

    def state(total: Column, best: Column, begin: Column, end: Column, found: Column) -> Column:
        return F.struct(
            total.alias("total"), best.alias("best"), begin.alias("start"), end.alias("end"), found.alias("found")
        )

    def step(s: Column, x: Column) -> Column:
        total = s["total"] + x["score"]
        over = (total <= 0) | (total < s["best"] - suspicion.margin)  # the stretch ends at its best
        fresh = F.when(x["score"] > 0, x["score"]).otherwise(0.0)
        return (
            F.when(over, state(fresh, fresh, x["start"], x["end"], closed(s)))
            .when(s["total"] <= 0, state(total, total, x["start"], x["end"], s["found"]))
            .when(total > s["best"], state(total, total, s["start"], x["end"], s["found"]))
            .otherwise(state(total, s["best"], s["start"], s["end"], s["found"]))
        )

    first = state(F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0), none)
    found = F.aggregate(items, first, step, closed)
    return F.transform(
        found,
        lambda x: F.struct(
            (start + x["start"]).alias("start"), F.lit(3).alias("kind"), (start + x["end"]).alias("end"),
            token.substr(x["start"] + 1, x["end"] - x["start"]).alias("token"),
        ),
    )


def scan(docs: DataFrame, ratio: list[float], suspicion: Suspicion = Suspicion()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, k1, k2 and spans, an array of (start,
    kind, end, token) in order of start, then kind; kind counts within KINDS, token is the
    matched value.

    The base patterns' spans are all there. Of what they leave of the text, the segments that the
    models find random are added as `random`; none touches a base span. All of it is one pass
    of built-in functions without a shuffle; only texts with a match are cut, however long they
    are. Null text reads as empty. Equal rows have equal results. Empty table: no rows.
    """
    rows = pack(docs, "doc_id", "text").select("doc_id", *KEY, F.coalesce("text", F.lit("")).alias("text"))
    text, token = F.col("text"), rf"[{_SYMBOL}]{{{suspicion.min_chars},}}"
    lowered = F.col("lowered")
    flagged = rows.withColumn("lowered", F.lower("text")).select(
        "doc_id", *KEY, "text",
        reduce(Column.__or__, [lowered.contains(w) for w in _WORDS]).alias("worded"),
        text.rlike(token).alias("long"),
    )
    # an access or hex match is a token of 20 symbols or more, or part of one
    coded = F.col("long") if suspicion.min_chars <= 20 else F.lit(True)
    keyed, hexed = coded & text.contains("AKIA"), coded & text.rlike(HEX)
    based = flagged.select(
        "doc_id", *KEY, "long",
        F.concat(
            find(text, ASSIGN, 0, F.col("worded"), group=2, min_chars=6),
            find(text, ACCESS, 1, keyed),
            find(text, HEX, 2, hexed),
        ).alias("base"),
        blank(text, ASSIGN, F.col("worded") & F.col("long"), group=2, min_chars=6).alias("rest"),
    )
    rest = F.col("rest")
    for name, pattern in (("AKIA", ACCESS), ("", HEX)):
        based = based.withColumn("rest", blank(rest, pattern, F.col("long") & rest.contains(name) & rest.rlike(pattern)))
    tokens = based.withColumn("tokens", find(rest, token, 3, F.col("long"))).drop("rest", "long")
    random = F.flatten(F.transform("tokens", lambda t: segments(t["token"], t["start"], ratio, suspicion)))
    # where two base spans overlap, blanking one can leave a piece of the other
    added = F.filter(random, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return tokens.select("doc_id", *KEY, F.array_sort(F.concat("base", added)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    names = F.lit(list(KINDS))

    def written(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = written(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )

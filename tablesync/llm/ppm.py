"""Language identification by prediction by partial matching: one byte context tree per
language, whose frozen statistics give every text an exact code length. Languages beyond one
model's width go into further models, and the shortest code over all of them counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, id_type, map_batches, pack, texts
from tablesync.session import stage

UNKNOWN = "und"
_PIECE = 1 << 18  # bytes scored at a time


@dataclass(frozen=True)
class Training:
    """Contexts of up to `order` bytes. Of each language at most `most_docs` documents are
    learnt from, picked by the hashes of the rows. Every language is learnt; one model holds
    `languages_a_model` of them, so that its tables stay of bounded width."""

    order: int = 3
    most_docs: int = 400
    languages_a_model: int = 64


def _count_grams(order: int):
    """Counts of all runs of 1 to order + 1 bytes, summed over a batch."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        langs = batch.column("lang").to_pylist()
        grouped: dict[str, list[np.ndarray]] = {}
        for lang, data in zip(langs, texts(batch, "text")):
            grouped.setdefault(lang, []).append(np.frombuffer(data, np.uint8))
        for lang, parts in grouped.items():
            for width in range(1, order + 2):
                codes = []
                for part in parts:
                    code = np.zeros(max(0, len(part) - width + 1), np.int64)
                    for i in range(width):
                        code = (code << 8) | part[i : i + len(code)]
                    codes.append(code)
                found, counts = np.unique(np.concatenate(codes), return_counts=True)
                for column, values in zip(columns, ([lang] * len(found), [width] * len(found), found, counts)):
                    column.extend(values)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "width", "gram", "n"]
        )

    return run


@dataclass
class Model:
    """The context trees of all languages in one trie of byte runs.

    `child[w][node, symbol]` is the node of the run of w + 1 symbols, 0 if no language has it.
    `cost[w][node]` holds, per language, the exact code length in bits of the run's last symbol
    in the context of those before it; `escape[w][node]` that of leaving the run as a context,
    0 in a language that does not have it as one.
    """

    langs: list[str]
    symbol: np.ndarray
    child: list[np.ndarray]
    cost: list[np.ndarray]
    escape: list[np.ndarray]

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code length per language."""
        total = np.zeros(len(self.langs))
        top = len(self.child) - 1
        for at in range(0, len(data), _PIECE):
            begin = max(0, at - top)  # the contexts of the first bytes of a piece lie before it
            total += self._piece(self.symbol[data[begin : at + _PIECE]], at - begin)
        return total

    def _piece(self, s: np.ndarray, lead: int) -> np.ndarray:
        nodes = [self.child[0][0, s]]
        for child in self.child[1:]:
            before = np.concatenate([[0], nodes[-1][:-1]])
            nodes.append(np.where(before > 0, child[before, s], 0))
        # most bytes end a known run of full length; the others fall back level by level
        rest = np.arange(lead, len(s))
        total = np.zeros(len(self.langs))
        for w in range(len(nodes) - 1, -1, -1):
            node = nodes[w][rest]
            known = node > 0
            total += self._sum(self.cost[w], node[known])
            rest = rest[~known]
            if w and len(rest):
                context = np.where(rest > 0, nodes[w - 1][rest - 1], 0)
                total += self._sum(self.escape[w - 1], context[context > 0])
        return total + len(rest) * self.cost[0][0]

    @staticmethod
    def _sum(table: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Sum of rows: how often each is used, times the row, if that is less to do."""
        if len(index) < len(table):
            return table[index].sum(axis=0, dtype=np.float64)
        return np.bincount(index, minlength=len(table)) @ table


def build(counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]) -> Model:
    """counts: language -> width -> (grams as numbers, how often).

    Escapes are those of method C: a context seen n times with d different followers leaves
    itself with probability d / (n + d) and predicts a follower seen c times with c / (n + d);
    the context of no bytes falls back to 257 equally likely symbols.
    """
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(256, np.int64), [], [], [])
    widths = sorted({w for of in counts.values() for w in of})
    used = np.unique(np.concatenate([counts[x][1][0] for x in langs]))
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, len(used) + 1)
    n_symbols = len(used) + 1

    child: list[np.ndarray] = []
    cost: list[np.ndarray] = []
    escape: list[np.ndarray] = []
    parents = np.zeros(1, np.int64)  # sorted grams of the level above; node i + 1 is gram i
    for level, width in enumerate(widths):
        grams = np.unique(np.concatenate([counts[x][width][0] for x in langs]))
        heads, last = grams >> 8, symbol[grams & 255]
        above = np.searchsorted(parents, heads) + 1 if level else np.zeros(len(grams), np.int64)
        table = np.zeros((len(parents) + 1 if level else 1, n_symbols), np.int32)
        table[above, last] = np.arange(1, len(grams) + 1)
        # the node of the same run without its first byte, one level up
        shorter = np.zeros(len(grams), np.int64)
        if level:
            shorter = np.searchsorted(parents, grams & ((1 << (8 * (width - 1))) - 1)) + 1
        costs = np.zeros((len(grams) + 1, len(langs)), np.float64)
        leave = np.zeros((len(parents) + 1 if level else 1, len(langs)), np.float64)
        for x, lang in enumerate(langs):
            own, often = counts[lang][width]
            n = np.zeros(len(grams))
            n[np.searchsorted(grams, own)] = often
            total = np.bincount(above, n, minlength=len(leave))
            kinds = np.bincount(above, (n > 0).astype(float), minlength=len(leave))
            there = kinds > 0
            leave[there, x] = -np.log2(kinds[there] / (total + kinds)[there])
            lower = cost[level - 1][shorter, x] if level else np.log2(257.0)
            seen = n > 0
            costs[1:, x] = leave[above, x] + lower
            costs[1:, x][seen] = -np.log2(n[seen] / (total + kinds)[above[seen]])
            if not level:
                costs[0, x] = leave[0, x] + np.log2(257.0)
        child.append(table)
        cost.append(costs)
        if level:
            escape.append(leave)
        parents = grams
    return Model(langs, symbol, child, cost, escape)


def train(labelled: DataFrame, training: Training = Training()) -> Model | Iterator[Model]:
    """labelled (text, lang) -> the model. Rows without text or language teach nothing.

    If there are more languages than one model holds: the models that together hold all of
    them, for `identify` to read once. Each is built when it is asked for, from a pass of its
    own over the labelled rows, so the driver holds one at a time."""
    rows = pack(labelled, "lang", "text").filter("lang is not null and text is not null and text <> ''")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    held = [(r.lang, r["count"]) for r in sizes.collect()]
    step = training.languages_a_model
    if len(held) <= step:
        return build(_counts(rows, dict(held), training))
    return (build(_counts(rows, dict(held[i : i + step]), training)) for i in range(0, len(held), step))


def _counts(
    rows: DataFrame, sizes: dict[str, int], training: Training
) -> dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """What `build` takes, of the languages in `sizes`. The counts are summed on Spark; what comes
    to the driver is bounded by the sample's size."""
    if not sizes:
        return {}
    # hashes below a language's limit: about twice as many as are wanted, so that no task ranks more
    below = {x: int(min(1.0, 2 * (training.most_docs + 50) / n) * (1 << 32)) for x, n in sizes.items()}
    limits = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])
    first = Window.partitionBy("lang").orderBy("k1", "k2")
    sample = (
        rows.filter(F.pmod("k1", F.lit(1 << 32)) < F.try_element_at(limits, F.col("lang")))
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= training.most_docs)
        .select("lang", "text")
    )
    grams = map_batches(sample, _count_grams(training.order), "lang string, width int, gram long, n long")
    summed = grams.groupBy("lang", "width", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    lang, width, gram, n = (summed.column(i).to_numpy() for i in range(4))
    order = np.lexsort((gram, width))
    for name in sorted(set(lang)):
        for w in range(1, training.order + 2):
            at = order[(lang[order] == name) & (width[order] == w)]
            counts.setdefault(name, {})[w] = (gram[at], n[at])
    return counts


def _predict(shared):
    """Per row: the language with the shortest code, that code's bits, and how likely all languages
    are together, with that one as the unit."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model: Model = shared.value
        found, shortest, weights = [], [], []
        for data, lettered in zip(texts(batch, "text"), batch.column("lettered").to_pylist()):
            if not lettered:
                found.append(UNKNOWN)
                shortest.append(0.0)
                weights.append(None)
                continue
            bits = model.bits(np.frombuffer(data, np.uint8))
            best = int(bits.argmin())
            found.append(model.langs[best])
            shortest.append(float(bits[best]))
            weights.append(float(np.exp2(np.maximum(bits[best] - bits, _LEAST)).sum()))
        columns = [
            *batch.columns[:-2], pa.array(found, pa.string()),
            pa.array(shortest, pa.float64()), pa.array(weights, pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "lang_pred", "bits", "weight"])

    return run


_LEAST = -1000.0  # log2 of the least ratio of probabilities told from 0


def _shortest(parts: Sequence[DataFrame]) -> DataFrame:
    """The predictions of several models as one: a row's shortest code counts, and the weights are
    added in its unit. Equal rows have equal predictions and are counted, so a row that a table
    holds many times is combined in the tasks."""
    counted = [
        part.groupBy("doc_id", *KEY)
        .agg(F.count("*").alias("rows"), *[F.any_value(c).alias(c) for c in ("bits", "lang_pred", "weight")])
        .withColumn("model", F.lit(n))
        for n, part in enumerate(parts)
    ]
    best = F.struct("bits", "lang_pred")
    met = reduce(DataFrame.unionByName, counted).groupBy("doc_id", *KEY).agg(
        F.max("rows").alias("rows"),
        F.min(best).alias("best"),
        F.collect_list(F.struct("model", "bits", "weight")).alias("parts"),
    )
    total = F.aggregate(
        F.array_sort("parts"),
        F.lit(0.0),
        lambda sum_, p: sum_ + p.weight * F.pow(F.lit(2.0), F.greatest(F.col("best.bits") - p.bits, F.lit(_LEAST))),
    )
    return met.select(
        "doc_id", *KEY, F.col("best.lang_pred").alias("lang_pred"), total.alias("weight"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))),
    ).drop("col")


def identify(docs: DataFrame, model: Model | Iterator[Model]) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, k1, k2, lang_pred and score.

    Every byte of a text counts. lang_pred is the language with the shortest code, the first
    by name among equals; score is its probability if all languages were equally likely before.
    Of several models each scores the texts in a pass of its own, so that a task holds one at a
    time; what is combined are rows without text.
    A text that is null or has no letter, or a model without languages, gives `und` and 0.
    Equal rows get equal results. Empty table: no rows.
    """
    packed = pack(docs, "doc_id", "text")
    context = docs.sparkSession.sparkContext

    def scored(of: Model) -> tuple[DataFrame, Broadcast]:
        lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(of.langs))
        rows = packed.select("doc_id", *KEY, "text", lettered.alias("lettered"))
        shared = context.broadcast(of)
        schema = f"doc_id {id_type(docs)}, k1 long, k2 long, lang_pred string, bits double, weight double"
        return map_batches(rows, _predict(shared), schema), shared

    if isinstance(model, Model):
        found, _ = scored(model)
    else:
        parts = []
        for part, shared in map(scored, model):
            parts.append(stage(part, "language-codes"))
            shared.destroy()
        found = _shortest(parts)
    score = F.coalesce(1 / F.col("weight"), F.lit(0.0))
    return found.select("doc_id", *KEY, "lang_pred", score.alias("score"))

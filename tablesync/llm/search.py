"""Ranked lexical search: an index of compressed blocks per shard of documents, read by Block-Max
MaxScore; the best of every shard are merged.

Per list and shard the greatest score bound decides which lists are essential: a document in
none of those cannot reach the worst score kept. What the essential lists name is then tested
against the bounds of single blocks of the other lists, so that most of those blocks are never
decompressed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesync.llm.common import pack, texts
from tablesync.session import stage

# The only characters inside terms: ASCII letters and digits, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM_BYTES = bytes(
    b + 32 if chr(b) in _LETTERS else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
_BLOCK = 128
_WINDOW = 1024
_SHARD_BYTES = 16 << 20
_SHARD_DOCS = 16_384
_ITEMS_PER_GROUP = 256
_ROWS_PER_BATCH = 20_000


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_TERM_BYTES).split()


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _LETTERS, _LETTERS.lower()), F.lit(TERM), F.lit(0))


# -- the index ---------------------------------------------------------------------------


def pack_block(gaps: np.ndarray, tfs: np.ndarray) -> bytes:
    """Two widths, then the gaps between documents and their counts, each in as few bytes as the
    block's largest takes."""
    widths = [_width(gaps), _width(tfs)]
    return bytes(widths) + gaps.astype(f"<u{widths[0]}").tobytes() + tfs.astype(f"<u{widths[1]}").tobytes()


def _width(values: np.ndarray) -> int:
    most = int(values.max())
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a block, by their place in the shard, and how often each has the term."""
    count = (len(data) - 2) // (data[0] + data[1])
    gaps = np.frombuffer(data, f"<u{data[0]}", count, 2)
    tfs = np.frombuffer(data, f"<u{data[1]}", count, 2 + data[0] * count)
    return np.cumsum(gaps, dtype=np.int64), tfs.astype(np.int64)


class _Shard:
    """Postings of the documents read so far; terms are numbered as they come."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.terms: list[int] = []
        self.places: list[int] = []
        self.tfs: list[int] = []
        self.lengths: list[int] = []
        self.ids: list = []
        self.bytes = 0

    def add(self, doc_id, data: bytes) -> None:
        found = terms_of(data)
        counted = Counter(found)
        numbers = self.numbers
        self.terms.extend([numbers.setdefault(t, len(numbers)) for t in counted])
        self.tfs.extend(counted.values())
        self.places.extend([len(self.lengths)] * len(counted))
        self.lengths.append(len(found))
        self.ids.append(doc_id)
        self.bytes += len(data) + 64

    @property
    def full(self) -> bool:
        return self.bytes >= _SHARD_BYTES or len(self.lengths) >= _SHARD_DOCS

    def lists(self) -> Iterator[tuple[bytes, int, list[int], list[int], list[int], list[bytes]]]:
        """Per term: its documents, and per block the last place, the largest count, the shortest
        document's length and the packed postings."""
        if not self.terms:
            return
        terms = np.array(self.terms, np.int64)
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], np.array(self.places, np.int64)[order]
        tfs, lengths = np.array(self.tfs, np.int64)[order], np.array(self.lengths, np.int64)[places]
        begins = np.flatnonzero(np.diff(terms, prepend=-1))
        within = np.arange(len(terms)) - np.repeat(begins, np.diff(begins, append=len(terms)))
        cuts = np.flatnonzero(within % _BLOCK == 0)
        ends = np.append(cuts[1:], len(terms))
        gaps = np.diff(places, prepend=0)
        gaps[cuts] = places[cuts]
        last = places[ends - 1].tolist()
        most, least = np.maximum.reduceat(tfs, cuts).tolist(), np.minimum.reduceat(lengths, cuts).tolist()
        blocks = [pack_block(gaps[a:b], tfs[a:b]) for a, b in zip(cuts.tolist(), ends.tolist())]
        first = np.searchsorted(cuts, begins).tolist() + [len(cuts)]
        sizes = np.diff(begins, append=len(terms)).tolist()
        for number, term in enumerate(self.numbers):  # in the order of their numbers
            a, b = first[number], first[number + 1]
            yield term, sizes[number], last[a:b], most[a:b], least[a:b], blocks[a:b]


@dataclass(frozen=True)
class Index:
    """`postings` (shard, term, df, last, most, least, blocks), one row per term and shard;
    `shards` (shard, ids, lengths, n_docs, n_terms), one row per shard. n_docs counts documents
    with a term."""

    postings: DataFrame
    shards: DataFrame


def build_index(docs: DataFrame) -> Index:
    """Indexes every row and whole text of `docs` (doc_id, text) into the shared folder.

    A shard is a run of rows of one task, ended by 16 MB of text or 16,384 rows, so a task holds no
    more than that and one text. Null text has no term; rows without one are in no list.
    Repeated rows are documents of their own. An empty table gives an empty index. doc_id may be of
    any type; other columns, whatever their names, are not looked at.
    """
    rows = pack(docs, "doc_id", "text").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    ints, kinds = T.ArrayType(T.IntegerType()), T.StructType()
    schema = (
        kinds.add("shard", "long").add("term", "binary").add("df", "long").add("last", ints).add("most", ints)
        .add("least", ints).add("blocks", T.ArrayType(T.BinaryType())).add("ids", T.ArrayType(kind))
        .add("lengths", ints).add("n_docs", "long").add("n_terms", "long")
    )
    names = schema.names
    int_lists = pa.list_(pa.int32())
    types = [pa.int64(), pa.binary(), pa.int64(), int_lists, int_lists, int_lists, pa.list_(pa.binary())]

    def rows_of(shard: _Shard, number: int, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def lists() -> pa.RecordBatch:
            columns = [pa.array([number] * len(held), pa.int64())]
            columns += [pa.array(c, t) for c, t in zip(zip(*held), types[1:])]
            empty = [pa.nulls(len(held), t) for t in (pa.list_(id_kind), int_lists, pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *empty], names=names)

        for row in shard.lists():
            held.append(row)
            if len(held) == _ROWS_PER_BATCH:
                yield lists()
                held = []
        if held:
            yield lists()
        with_terms = sum(1 for n in shard.lengths if n)
        about = [[shard.ids], [shard.lengths], [with_terms], [sum(shard.lengths)]]
        about_kinds = (pa.list_(id_kind), int_lists, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *[pa.nulls(1, t) for t in types[1:]], *[pa.array(v, t) for v, t in zip(about, about_kinds)]],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            id_kind = batch.column("doc_id").type
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts(batch, "text")):
                shard.add(doc_id, data)
                if shard.full:
                    yield from rows_of(shard, number, id_kind)
                    shard, number = _Shard(), number + 1
        if shard.lengths:
            yield from rows_of(shard, number, id_kind)

    index = stage(rows.mapInArrow(run, schema), "index")
    return Index(
        index.filter("term is not null").select(*names[:7]),
        index.filter("term is null").select("shard", *names[7:]),
    )


# -- the search --------------------------------------------------------------------------


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length counts for, in hundredths of an average document's."""
    return 100 - 50 + (50 * lengths.astype(np.int64) * n_docs) // n_terms


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A count's part of the score, before the term's weight; grows with the count, falls with the norm."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


@dataclass
class PostingList:
    """One term of a shard. Blocks are decompressed when first asked for, and kept for the other
    items of the group."""

    weight: int
    last: np.ndarray
    bounds: np.ndarray  # the most a document of each block can score
    blocks: list[bytes]
    norm: np.ndarray
    read: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, weight, last, most, least, blocks, norm, shortest) -> PostingList:
        bounds = weight * impact(np.asarray(most, np.int64), shortest(np.asarray(least, np.int64)))
        return cls(weight, np.asarray(last, np.int64), bounds, blocks, norm)

    @property
    def bound(self) -> int:
        return int(self.bounds.max())

    def block(self, nth: int) -> tuple[np.ndarray, np.ndarray]:
        if nth not in self.read:
            places, tfs = unpack_block(self.blocks[nth])
            self.read[nth] = places, self.weight * impact(tfs, self.norm[places])
        return self.read[nth]


def best_of_shard(lists: list[PostingList], rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a shard for one item, as places and scores; of equal scores those of
    the least rank (the order of doc_id). Scores of 0 are left out."""
    lists = sorted(lists, key=lambda l: l.bound)
    reach = np.cumsum([l.bound for l in lists])  # the most that lists 0..i can give together
    kept, kept_scores, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    for start in range(0, len(rank), _WINDOW):
        # lists whose bounds together stay below the worst score kept name no document
        others = int(np.searchsorted(reach, least, "left"))
        if others == len(lists):
            break
        stop = start + _WINDOW
        scores = np.zeros(_WINDOW, np.int64)
        for l in lists[others:]:
            a, b = np.searchsorted(l.last, (start, stop))
            for nth in range(a, min(b + 1, len(l.last))):
                places, parts = l.block(nth)
                i, j = np.searchsorted(places, (start, stop))
                scores[places[i:j] - start] += parts[i:j]
        found = np.flatnonzero(scores)
        scores = scores[found]
        found += start
        for i in range(others - 1, -1, -1):
            open_to = scores + reach[i] >= least
            found, scores = found[open_to], scores[open_to]
            if not len(found):
                break
            l = lists[i]
            nth = np.searchsorted(l.last, found)
            inside = nth < len(l.last)
            most = np.where(inside, l.bounds[np.minimum(nth, len(l.last) - 1)], 0)
            # rejected by the block's bound, before the block is touched
            open_to = scores + most + (reach[i - 1] if i else 0) >= least
            found, scores, nth, inside = found[open_to], scores[open_to], nth[open_to], inside[open_to]
            for number in np.unique(nth[inside]).tolist():
                places, parts = l.block(number)
                mine = np.flatnonzero(nth == number)
                at = np.searchsorted(places, found[mine])
                hit = places[np.minimum(at, len(places) - 1)] == found[mine]
                scores[mine[hit]] += parts[at[hit]]
        kept, kept_scores = np.concatenate([kept, found]), np.concatenate([kept_scores, scores])
        if len(kept) > k:
            order = np.lexsort((rank[kept], -kept_scores))[:k]
            kept, kept_scores = kept[order], kept_scores[order]
        if len(kept) == k:
            least = int(kept_scores.min())
    some = kept_scores > 0
    return kept[some], kept_scores[some]


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each item (item_id,
    text), equal scores by doc_id, null last.

    Items are dealt into groups of about 256; each meets each shard once, in a task that holds the
    shard's lists of the group's terms. Lists come to their groups by an equi join on the term.
    Rows that share an item_id (also none) are one item with all their terms; an item without a known
    term has no rows. Null text has no term. Extra columns are not looked at. Every shard gives
    at most k rows per item; these are thinned again in each task before they meet.
    """
    spark = items.sparkSession
    totals = index.shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    kind, item_kind = index.shards.schema["ids"].dataType.elementType, items.schema["item_id"].dataType
    out = T.StructType().add("item_id", item_kind).add("doc_id", kind).add("score", "long")
    wanted = stage(items.select("item_id", F.explode(_terms(F.col("text"))).alias("word")).distinct(), "wanted")
    groups = max(1, -(-wanted.select("item_id").distinct().count() // _ITEMS_PER_GROUP))
    if not n_terms:
        return spark.createDataFrame([], out).select("item_id", F.lit(1).alias("rank"), "doc_id", "score")
    words = wanted.select(F.col("word").cast("binary").alias("term")).distinct()
    lists = stage(index.postings.join(words, "term", "left_semi"), "lists")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    weights = lists.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    asked = (
        wanted.select(
            F.col("word").cast("binary").alias("term"), F.struct("item_id").alias("item"),
            F.pmod(F.xxhash64("item_id"), F.lit(groups)).alias("group"),
        )
        .groupBy("term", "group")
        .agg(F.collect_list("item").alias("items"))
        .join(weights.filter("weight > 0"), "term")
    )
    met = lists.drop("df").join(asked, "term").groupBy("shard", "group")
    about = index.shards.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def run(postings: pa.Table, shard: pa.Table) -> pa.Table:
        if not postings.num_rows or not shard.num_rows:
            return pa.Table.from_pylist([], empty(shard))
        ids = shard.column("ids").combine_chunks().flatten()
        lengths = shard.column("lengths").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(pa.chunked_array([ids]), sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()] = np.arange(len(ids))
        norm = norms(lengths, n_docs, n_terms)
        by_item: dict = {}
        for row in postings.select(["weight", "last", "most", "least", "blocks", "items"]).to_pylist():
            made = PostingList.of(
                row["weight"], row["last"], row["most"], row["least"], row["blocks"], norm,
                lambda n: norms(n, n_docs, n_terms),
            )
            for item in row["items"]:
                by_item.setdefault(item["item_id"], []).append(made)
        columns: list[list] = [[], [], []]
        for item_id, found in by_item.items():
            places, scores = best_of_shard(found, rank, k)
            columns[0].extend([item_id] * len(places))
            columns[1].extend(places.tolist())
            columns[2].extend(scores.tolist())
        kinds = empty(shard)
        return pa.Table.from_arrays(
            [
                pa.array(columns[0], kinds.field("item_id").type),
                ids.take(pa.array(columns[1], pa.int64())),
                pa.array(columns[2], pa.int64()),
            ],
            schema=kinds,
        )

    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[item_kind.simpleString()]

    def empty(shard: pa.Table) -> pa.Schema:
        id_type = shard.schema.field("ids").type.value_type
        return pa.schema([("item_id", item_type), ("doc_id", id_type), ("score", pa.int64())])

    heaps = met.cogroup(about.groupBy("shard", "group")).applyInArrow(run, out)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")

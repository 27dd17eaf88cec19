"""Near-duplicate documents: similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.llm.common import KEY, map_batches, pack, texts, unpack
from tablesync.llm.components import components
from tablesync.session import stage

_U = np.uint64
_ROUND_BITS = 40  # a coordinate holds its round above so many bits of the element's hash


@dataclass(frozen=True)
class Likeness:
    """Documents are linked if `percent` of the union of their shingle sets is shared.

    bands x rows coordinates: at 80 % two sets agree in all rows of a band with probability
    0.8^5 = 0.33, so a link is missed by all 36 bands with probability 6e-7.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 36
    rows: int = 5


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().split()  # bytes: A-Z and the six white-space characters only


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """One 64-bit hash per distinct run of `width` words, sorted; of fewer words one for the whole
    sequence, of none nothing. Distinctness is decided on exact numbers
    of words and runs, not on the hashes."""
    if not words:
        return np.zeros(0, _U)
    width = min(width, len(words))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, number), _U, len(number))
    runs = ids
    for i in range(1, width):
        runs = runs[: len(ids) - i] * len(number) + ids[i:]
        runs = np.unique(runs, return_inverse=True)[1] if i < width - 1 else runs
    first = np.unique(runs, return_index=True)[1]
    hashes = np.zeros(len(first), _U)
    for i in range(width):
        hashes = _mix(hashes * _U(3) + of_word[ids[first + i]] + _U(width))
    return np.sort(hashes)


def sketch(hashes: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates of a non-empty set: two sets agree in a coordinate with a probability
    equal to their similarity.

    In round i < size each element falls into one hashed bin with the value (i, hash); a bin
    keeps its smallest. In round size + j every element is offered to bin j alone, so no bin
    stays empty. A round beyond the one that fills the last bin cannot change anything, so
    rounds run in blocks large enough to fill all bins as a rule.
    """
    bins = np.full(size, np.iinfo(_U).max, _U)
    n, done = len(hashes), 0
    block = max(1, int(np.ceil(size * (np.log(size) + 2) / n)))
    while done < size and (bins == np.iinfo(_U).max).any():
        rounds = np.arange(done, min(size, done + block), dtype=_U)[:, None]
        drawn = _mix(hashes[None, :] ^ _mix(rounds + _U(1)))
        values = (rounds << _U(_ROUND_BITS)) | (drawn >> _U(64 - _ROUND_BITS))
        np.minimum.at(bins, ((drawn & _U(0xFFFFFF)) % _U(size)).ravel().astype(np.int64), values.ravel())
        done += block
    for j in np.flatnonzero(bins == np.iinfo(_U).max):
        drawn = _mix(hashes ^ _mix(_U([size + j + 1])))
        bins[j] = (_U(size + j) << _U(_ROUND_BITS)) | (drawn.min() >> _U(64 - _ROUND_BITS))
    return bins


def band_keys(bins: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, of its number and coordinates."""
    keys = np.arange(1, bands + 1, dtype=_U)
    for column in bins.reshape(bands, -1).T:
        keys = _mix(keys * _U(5) + column)
    return keys


def _sketches(likeness: Likeness):
    size = likeness.bands * likeness.rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, keys, ends = [], [], [], [0]
        for data in texts(batch, "text"):
            hashes = shingle_hashes(words_of(data), likeness.shingle)
            counts.append(len(hashes))
            digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            if len(hashes):
                keys.append(band_keys(sketch(hashes, size), likeness.bands).view(np.int64))
            ends.append(likeness.bands * len(keys))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        columns = [
            *(batch.column(n) for n in ("doc_id", *KEY)),
            pa.array(counts, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_SKETCHED)

    return run


_SKETCHED = ["doc_id", *KEY, "n_shingles", "s1", "s2", "bands"]


_LACKING = 1 << 62  # mark of a lacking element; added ones sort first


def _compare(likeness: Likeness):
    """Of each pair (a, head b): whether they are linked, and how the set of a differs from the
    head's: how many elements are added and lacking, and which."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        parts, ends, last, head = [], [0], None, np.zeros(0, _U)
        for b, left, right in zip(batch.column("b").to_pylist(), texts(batch, "text_a"), texts(batch, "text_b")):
            if b != last:
                last, head = b, shingle_hashes(words_of(right), likeness.shingle)
            own = shingle_hashes(words_of(left), likeness.shingle)
            added = np.setdiff1d(own, head, assume_unique=True)
            lacking = np.setdiff1d(head, own, assume_unique=True)
            shared, union = len(own) - len(added), len(head) + len(added)
            rows.append((100 * shared >= likeness.percent * union, len(head), len(added), len(lacking)))
            parts.append((added >> _U(2)).view(np.int64))
            parts.append((lacking >> _U(2)).view(np.int64) | _LACKING)
            ends.append(ends[-1] + len(added) + len(lacking))
        linked, size, added, lacking = zip(*rows)
        columns = [
            batch.column("a"), batch.column("b"), pa.array(linked),
            *(pa.array(c, pa.int64()) for c in (size, added, lacking)),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_COMPARED)

    return run


_COMPARED = ["a", "b", "linked", "size", "added", "lacking", "differs"]


def _compared(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, likeness: Likeness) -> DataFrame:
    """The pairs (a, b) of nodes, compared on whole texts. Only texts that a pair needs stay; the
    table of texts is always shuffled, so the plan is the same at every size."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = nodes.join(needed, "node", "left_semi").select("node", *KEY)
    text = stage(docs.join(rows.hint("merge"), [*KEY]).select("node", *KEY, "text").dropDuplicates(["node", *KEY]), "near-texts")
    left = text.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = text.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return stage(
        map_batches(
            pairs.join(left, "a").join(right, "b"),
            _compare(likeness),
            "a long, b long, linked boolean, size long, added long, lacking long, differs array<long>",
        ),
        "near-compared",
    )


_BLOCK = {"hopeful": 256, "partner": 1024}  # rows of either kind that meet in one group


def _links_in_block(share: float):
    """Links between the hopeful rows and the partners of one block; of links that join the same
    documents only as many as connect them, so there are fewer than rows."""

    def run(block: pa.Table) -> pa.Table:
        hopeful = block.column("hopeful").to_numpy()
        ids, need, over = (block.column(n).to_numpy() for n in ("a", "need", "over"))
        lists = block.column("differs").combine_chunks()
        flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
        begins = np.cumsum(sizes) - sizes
        partners = np.flatnonzero(~hopeful)
        elements = flat[np.repeat(~hopeful, sizes)]
        holders = np.repeat(np.arange(len(partners)), sizes[partners])
        order = np.argsort(elements, kind="stable")
        elements, holders = elements[order], holders[order]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        links: list[tuple[int, int]] = []
        for i in np.flatnonzero(hopeful).tolist():
            own = flat[begins[i] : begins[i] + sizes[i]]
            low, high = np.searchsorted(elements, own, "left"), np.searchsorted(elements, own, "right")
            held = [holders[x:y] for x, y in zip(low.tolist(), high.tolist()) if x < y]
            if not held:
                continue
            shared = np.bincount(np.concatenate(held), minlength=len(partners))
            enough = shared >= (over[i] + need[partners]) / (1 + share) - 1e-9
            x = int(ids[i])
            for y in ids[partners[enough]].tolist():
                if (left := find(x)) != (right := find(y)):
                    root[left] = right
                    links.append((x, y))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _linked_beside(compared: DataFrame, apart: DataFrame, likeness: Likeness) -> DataFrame:
    """Links (a, b) between a node of `apart` (a, b: a is not connected with its head b) and
    other members of the same head, as many as connect what is linked.

    Let C be the head's set, and let two members differ from it by n and m added and k and l
    lacking elements, of which they share s. Then they share |C| - k - l + s elements of
    |C| + n + m - s, so they are linked if and only if s reaches a bound. As one of the two is
    not linked with the head, the bound is more than a part of what the other differs by.

    An added element that one member alone has cannot be shared: members whose other differences
    stay below their bound leave, which are all whose changes are their own. The nodes apart
    that are left are held against the partners left, in blocks of bounded size that are dealt
    over all tasks; only links leave a block.
    """
    share = likeness.percent / 100
    several = compared.groupBy("b").count().filter("count > 1").select("b")
    heads = several.join(apart.select("b").distinct(), "b", "left_semi")
    # what a member adds to the number of shared elements that a link needs, times 1 + share
    need = F.col("lacking") + share * F.col("added")
    members = (
        compared.join(heads, "b", "left_semi")
        .withColumn("need", need)
        .withColumn("over", need - (1 - share) * F.col("size"))
    )
    own = (
        members.select("b", "a", F.explode(F.slice("differs", 1, F.col("added").cast("int"))).alias("element"))
        .groupBy("b", "element")
        .agg(F.min("a").alias("a"), F.count("*").alias("n"))
        .filter("n = 1")
        .groupBy("b", "a")
        .agg(F.count("*").alias("own"))
    )
    common = F.col("lacking") + F.col("added") - F.coalesce("own", F.lit(0))
    # of a partner of a node apart; and of a node apart, whose partner may differ by little
    least, few = (
        F.greatest(F.ceil(x / (1 + share) - 1e-9), F.lit(1)) for x in (F.col("need"), F.col("over") + share)
    )
    left = stage(
        members.join(own, ["b", "a"], "left")
        .join(apart.withColumn("apart", F.lit(True)), ["b", "a"], "left")
        .withColumn("partner", common >= least)
        .withColumn("hopeful", (common >= few) & F.coalesce("apart", F.lit(False)))
        .filter("partner or hopeful")
        .select("b", "a", "need", "over", "differs", "partner", "hopeful"),
        "near-left",
    )
    counted = left.groupBy("b").agg(*[F.sum(F.col(r).cast("long")).alias(f"{r}s") for r in _BLOCK])
    blocks = stage(
        counted.filter("hopefuls > 0 and partners > 0").select(
            "b", *[F.ceil(F.col(f"{r}s") / F.lit(float(n))).alias(f"{r}_blocks") for r, n in _BLOCK.items()]
        ),
        "near-blocks",
    )

    def dealt(role: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))
        return (
            left.filter(role)
            .join(blocks, "b")
            .withColumn(f"{role}_block", F.pmod(F.xxhash64("a"), F.col(f"{role}_blocks")))
            .withColumn(f"{other}_block", every)
            .select(
                "b", "hopeful_block", "partner_block", "a", "need", "over", "differs",
                F.lit(role == "hopeful").alias("hopeful"),
            )
        )

    met = dealt("hopeful", "partner").unionByName(dealt("partner", "hopeful"))
    links = met.groupBy("b", "hopeful_block", "partner_block").applyInArrow(_links_in_block(share), "a long, b long")
    return links.distinct()


def near_components(docs: DataFrame, likeness: Likeness = Likeness()) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept and the
    row's hashes k1, k2.

    Rows with equal shingle sets are one class, and all later work is on one row per class.
    A bucket (band key) of two or more classes has a head, the smallest id in it. Each member is
    compared with the heads of its buckets on whole texts, which is linear in the size of a
    bucket. Members that are then not connected with a head are looked up among the head's
    other members by what they share against it, so no link inside a bucket is lost.

    Null doc_id: the row is linked with nothing, its component_id is null and it is kept.
    Null, empty and blank texts have no shingles and are linked with nothing. Rows with one
    doc_id are one document: they are linked, whatever their texts. Empty table: no rows.
    """
    return _components(pack(docs, "doc_id", "text"), likeness)


def _components(packed: DataFrame, likeness: Likeness) -> DataFrame:
    rows = stage(
        map_batches(
            packed.select("doc_id", *KEY, "text"),
            _sketches(likeness),
            "doc_id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, bands array<long>",
        ),
        "near-sketches",
    )
    shingled = rows.filter("doc_id is not null and n_shingles > 0")
    nodes = stage(
        shingled.groupBy("s1", "s2")
        .agg(F.min(F.struct("doc_id", *KEY)).alias("head"), F.first("bands").alias("bands"))
        .select("s1", "s2", F.col("head.doc_id").alias("node"), *[f"head.{k}" for k in KEY], "bands"),
        "near-nodes",
    )
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    heads = stage(
        buckets.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.count("*").alias("held"))
        .filter("held > 1")
        .drop("held"),
        "near-heads",
    )
    pairs = stage(
        buckets.join(heads, "bucket")
        .filter("node <> low")
        .select(F.col("node").alias("a"), F.col("low").alias("b"))
        .distinct(),
        "near-pairs",
    )
    compared = _compared(pairs, packed.select(*KEY, "text"), nodes, likeness)
    members = rows.select("doc_id", "s1", "s2").join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    of_id = members.filter("doc_id is not null").groupBy("doc_id")
    repeated = of_id.agg(F.min("node").alias("low"), F.max("node").alias("high"), F.collect_set("node").alias("all"))
    repeated = repeated.filter("low < high").select(F.explode("all").alias("a"), F.col("low").alias("b"))
    roots = components(compared.filter("linked").select("a", "b").unionByName(repeated))

    def rooted(frame: DataFrame, column: str) -> DataFrame:
        found = roots.select(F.col("node").alias(column), F.col("root").alias(f"{column}_root"))
        return frame.join(found, column, "left").withColumn(
            f"{column}_root", F.coalesce(f"{column}_root", column)
        )

    apart = rooted(rooted(compared.filter("not linked").select("a", "b"), "a"), "b")
    apart = stage(apart.filter("a_root <> b_root").select("a", "b"), "near-apart")
    beside = stage(_linked_beside(compared, apart, likeness), "near-beside")
    if beside.head(1):
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = components(known.unionByName(beside))
    component = rooted(nodes.select("s1", "s2", "node"), "node")
    component = stage(component.select("s1", "s2", F.col("node_root").alias("component")), "near-components")
    return (
        rows.drop("bands")
        .join(component, ["s1", "s2"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", *KEY)
    )


_NAMELESS = 1 << 62  # ids given to rows without one start here, behind the others


def keep_one_each(docs: DataFrame, likeness: Likeness = Likeness()) -> DataFrame:
    """One row of `docs` per component, with all its columns: that with the smallest doc_id (null
    last), of several the one with the smallest row hashes; of repeated equal rows one.

    Rows without a doc_id are compared like all others, under ids made from their row hashes;
    equal ones are one document. Null, empty and blank texts stay once per doc_id, without one
    once per distinct row.
    """
    nameless = F.shiftrightunsigned(F.xxhash64(*KEY), 2) + F.lit(_NAMELESS)
    packed = pack(docs, "doc_id", "text")
    named = packed.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), nameless))
    kept = (
        _components(named, likeness)
        .filter("kept")
        .groupBy("component_id")
        .agg(F.min(F.struct(*KEY)).alias("best"))
        .select("best.*")
    )
    rows = packed.select(*KEY, "_row").join(kept, [*KEY], "left_semi")
    return unpack(rows.groupBy(*KEY).agg(F.any_value("_row").alias("_row")), docs.columns)

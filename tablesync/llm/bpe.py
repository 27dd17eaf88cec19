"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a
byte-to-text state machine."""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablesync.llm.common import KEY, id_type, map_batches, pack, texts

# Fixed values of byte-level BPE: how a text is cut before merging. White space is spelled out
# as the Unicode property, without the information separators.
PIECES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_CACHED_PIECES = 500_000
_CACHED_BYTES = 64
_IDS_PER_STEP = 4096


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 characters
    for themselves, all others from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges as ranks of token pairs, and what they imply for streaming."""

    def __init__(self, document: str):
        spec = json.loads(document)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        model = spec["model"]
        ids = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(ids[raw(a)], ids[raw(b)], ids[raw(a + b)]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.made = [made for _, _, made in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = token
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.longest = max(map(len, ids))
        self.lookahead = sufficient_lookahead(merges, self.token_bytes)


def sufficient_lookahead(merges: list[tuple[int, int, int]], token_bytes: list[bytes]) -> int:
    """How many bytes behind a token decide whether it stands.

    Only a merge of one of the token's right ends with what follows can take it apart or
    enlarge it, and what follows has to be formed first: by merges of lower rank, which bytes
    further right may in turn prevent only by merges of still lower rank. `ahead[m]` = bytes
    of m's right side + the most that side depends on when m's turn comes. Merges are read by rank, so
    `begins[t]`, the most over merges so far that start with t, and `inside[t]`, the same for t's
    right ends when t was formed, are all that is needed: one pass over the list.
    """
    begins: dict[int, int] = {}
    inside: dict[int, int] = {}
    for left, right, made in merges:
        behind = max(inside.get(right, 0), begins.get(right, 0))
        begins[left] = max(begins.get(left, 0), len(token_bytes[right]) + behind)
        inside[made] = max(inside.get(made, 0), behind)
    return max([0, *begins.values(), *inside.values()])


class Encoder:
    """Text to ids. A piece up to the window's size is merged at once; of a longer one only a
    window is held: its tokens that end before the lookahead are stable and leave it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.window = 4 * (vocabulary.lookahead + vocabulary.longest)
        self.pieces = regex.compile(PIECES)
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.known: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """All merges inside `data`, lowest rank first, leftmost first."""
        rank_of, made, byte_ids = self.vocabulary.ranks.get, self.vocabulary.made, self.vocabulary.byte_ids
        ids = [byte_ids[b] for b in data]
        none = len(made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            token = ids[i] = made[best]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((token, ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], token), none)
        return ids

    def stream(self, data: bytes) -> Iterator[int]:
        """The ids of one piece, each as soon as it is stable."""
        start, end = 0, len(data)
        while end - start > self.window:
            stable = start + self.window - self.vocabulary.lookahead
            at = start
            for token in self.merge(data[start : start + self.window]):
                at += len(self.vocabulary.token_bytes[token])
                if at > stable:
                    break
                yield token
                start = at
        yield from self.merge(data[start:])

    def piece(self, piece: str) -> bytes:
        """The packed ids of a piece; short ones are remembered, up to a fixed number."""
        found = self.known.get(piece)
        if found is None:
            data = piece.encode()
            if len(data) > _CACHED_BYTES:
                found = np.fromiter(self.stream(data), "<u4").tobytes()
            else:
                found = array("I", self.merge(data)).tobytes()
                if len(self.known) >= _CACHED_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def parts(self, text: str) -> Iterator[tuple[str, bytes | None]]:
        """The text between special tokens, and those with their packed id."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], None
            yield m[0], np.array([self.vocabulary.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian, 32 bits each."""
        out: list[bytes] = []
        known = self.known
        for part, special in self.parts(text):
            if special is not None:
                out.append(special)
                continue
            for piece in self.pieces.findall(part):
                out.append(known.get(piece) or self.piece(piece))
        return b"".join(out)


def decode(ids: np.ndarray, token_bytes: list[bytes]) -> Iterator[str]:
    """Text piece by piece: the state between steps is the unfinished character of at most
    three bytes; bytes that are no UTF-8 become U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(ids), _IDS_PER_STEP):
        yield machine.decode(b"".join([token_bytes[i] for i in ids[at : at + _IDS_PER_STEP].tolist()]))
    yield machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def _loaded(document: str) -> tuple[Vocabulary, Encoder]:
    vocabulary = Vocabulary(document)
    return vocabulary, Encoder(vocabulary)


def _encode(document):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _loaded(document.value)[1]
        ids = [encoder.encode(data.decode()) for data in texts(batch, "text")]
        columns = [*batch.columns[:-1], pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "ids"])

    return run


def _decode(document):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token_bytes = _loaded(document.value)[0].token_bytes
        packed = (ids.as_py() for ids in batch.column("ids"))
        back = [None if ids is None else "".join(decode(np.frombuffer(ids, "<u4"), token_bytes)) for ids in packed]
        columns = [*batch.columns, pa.array(back, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded"])

    return run


def _shared(df: DataFrame, path: str):
    """The vocabulary file's text for all tasks; its size is that of the file, 1.6 MB."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, k1, k2, ids) for each row of `docs` (doc_id, text); ids are packed, little-endian,
    32 bits each.

    `path` names the vocabulary on the driver. Special tokens inside a text are encoded as
    such. Null text reads as empty: no ids. Equal rows get equal ids. Empty table: no rows.
    doc_id is of any type. A task holds one batch of texts, the vocabulary and a bounded table of known pieces.
    """
    rows = pack(docs, "doc_id", "text").select("doc_id", *KEY, "text")
    return map_batches(rows, _encode(_shared(docs, path)), f"doc_id {id_type(docs)}, k1 long, k2 long, ids binary")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, k1, k2, ids) with the text its ids stand for; null ids: null."""
    rows = encoded.select("doc_id", *KEY, "ids")
    schema = f"doc_id {id_type(encoded)}, k1 long, k2 long, ids binary, decoded string"
    return map_batches(rows, _decode(_shared(encoded, path)), schema)

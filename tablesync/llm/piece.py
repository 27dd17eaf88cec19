"""SentencePiece encoding and decoding for vocabularies of merge type: an agenda of adjacent
symbol pairs, best score first, and a byte-to-text state machine for the way back."""

from __future__ import annotations

import codecs
import heapq
import random
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_format

from tablesync.llm.common import KEY, pack, texts

SPACE = "▁"  # fixed value: stands for a space inside pieces
_UNKNOWN, _CONTROL, _BYTE, _NORMAL = 2, 3, 6, 1
_KNOWN_SEGMENTS = 400_000
_KNOWN_WORDS = 700_000
_LISTED_CHARS = 48
_PLACES = 64  # more than a listed stretch has characters, a space before it and a border
_TOGETHER = range(256, 16_384)
_ROOM_PER_PAIR = 16
_TRIES = 64
_WINDOW_CHARS = 1 << 16
_NEVER = float("inf")
_IDS_PER_STEP = 4096
_IDS_PER_BATCH = 2_000_000
_BYTES_TOGETHER = 1 << 18
_FIRST_SPACE = re.compile("(?<! ) ")
_NO_TEXT = re.compile("[\udc80-\udcff]")


class Vocabulary:
    """Pieces with their scores, read from the model file. Only what the merge type needs is
    understood: any other model, normalisation or kind of piece is an error."""

    def __init__(self, model: bytes):
        spec = model_format.ModelProto()
        spec.ParseFromString(model)
        normal, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback:
            raise ValueError("not a merge-type model with byte fallback")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only models that leave the text as it is can be used")
        if train.treat_whitespace_as_suffix:
            raise ValueError("white space as a suffix is not supported")
        self.ids: dict[str, int] = {}
        #: the better a piece, the lower its rank
        self.ranks: dict[str, float] = {}
        self.byte_ids = [0] * 256
        #: the bytes each id stands for
        self.stands: list[bytes] = []
        for i, p in enumerate(spec.pieces):
            if p.type == _NORMAL:
                self.ids[p.piece], self.ranks[p.piece] = i, -p.score
                self.stands.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == _BYTE:
                byte = int(p.piece[3:-1], 16)
                self.byte_ids[byte] = i
                self.stands.append(bytes([byte]))
            elif p.type in (_UNKNOWN, _CONTROL):
                self.stands.append(train.unk_surface.encode() if p.type == _UNKNOWN else b"")
            else:
                raise ValueError(f"piece {p.piece!r} is of a kind that is not supported")
        self.end = next(i for i, p in enumerate(spec.pieces) if p.piece == train.eos_piece)
        self.dummy_prefix = normal.add_dummy_prefix
        self.spaced = {i for piece, i in self.ids.items() if piece.startswith(SPACE)}
        # Two neighbours that no piece holds side by side never merge: the text can be cut there.
        self.joints = {a + b for piece in self.ids for a, b in zip(piece, piece[1:])}
        self.space_leads = all(not piece.lstrip(SPACE).count(SPACE) for piece in self.ids)


def _odd_letters(vocabulary: Vocabulary) -> set[str]:
    """Letters that some piece joins with other characters, such as a raised digit and a full stop."""
    letter = re.compile(r"[^\W\d_]")
    mixed = "".join(
        c for j in vocabulary.joints if SPACE not in j and bool(letter.match(j[0])) != bool(letter.match(j[1])) for c in j
    )
    return {c for c in mixed if letter.match(c)}


def _segments(vocabulary: Vocabulary) -> re.Pattern:
    """How a text is cut first, at places where nothing can merge: before spaces, if they can only
    lead a piece, and between letters and other characters. Odd letters count as others."""
    if not vocabulary.space_leads:
        return re.compile(r"(?s).+")
    odd = re.escape("".join(_odd_letters(vocabulary)))
    return re.compile(f"{SPACE}*[^\\W\\d_{odd}]+|{SPACE}*(?:[^\\w{SPACE}]|[\\d_{odd}])+|{SPACE}+")


class Merges:
    """All merges inside many short stretches at once. A stretch is a column of symbols; beside each
    symbol stands the rank of its union with the next one, then its place: the smallest of a
    column is the next merge there, of equal ranks the leftmost."""

    def __init__(self, vocabulary: Vocabulary):
        ids, (order, rank) = vocabulary.ids, np.unique(list(vocabulary.ranks.values()), return_inverse=True)
        number = {p: i for i, p in enumerate(ids)}
        # Behind the pieces come the bytes, which merge with nothing, and the border of a stretch.
        self.border = len(ids) + 256
        self.never = len(order) * _PLACES
        self.ids = np.array([*ids.values(), *vocabulary.byte_ids], np.int32)
        #: the symbol of each character; -1 for those whose bytes or merges need another look
        self.symbols = np.full(0x110000, -1, np.int32)
        inside = set(chain.from_iterable(ids))
        for c in inside & number.keys():
            self.symbols[ord(c)] = number[c]
        for i in range(128):
            if chr(i) not in inside:
                self.symbols[i] = len(ids) + i
        #: the only piece of a rank; -1 where several share it
        self.only = np.full(len(order), -1, np.int32)
        self.only[rank] = np.where(np.bincount(rank)[rank] == 1, np.arange(len(ids)), -1)
        self._lay(
            (number[p[:i]], number[p[i:]], n)
            for p, n in number.items()
            for i in range(1, len(p))
            if p[:i] in number and p[i:] in number
        )
        known = self.unions != self.border
        self.places = np.full(len(self.unions), self.never, np.int32)
        self.places[known] = rank[self.unions[known]] * _PLACES

    def _lay(self, pairs: Iterator[tuple[int, int, int]]) -> None:
        """The pairs of a left symbol lie in one table, as far apart as their right symbols, moved to
        where all are free: some place at random, else the end. So a pair is found in one look."""
        rows: dict[int, list[tuple[int, int]]] = {}
        for left, right, union in pairs:
            rows.setdefault(left, []).append((right, union))
        width, draw = self.border + 1, random.Random(0).randrange
        room = 1 + _ROOM_PER_PAIR * sum(map(len, rows.values()))
        self.shift = np.zeros(width, np.int32)
        self.owner = np.full(room + width, -1, np.int32)
        self.unions = np.full(room + width, self.border, np.int32)
        for left, row in sorted(rows.items(), key=lambda r: -len(r[1])):
            right, union = np.array(row).T
            for _ in range(_TRIES):
                at = right + draw(room)
                if self.owner[at].max() < 0:
                    break
            else:
                at = right + len(self.owner)
                self.owner = np.append(self.owner, np.full(width, -1, np.int32))
                self.unions = np.append(self.unions, np.full(width, self.border, np.int32))
            self.shift[left], self.owner[at], self.unions[at] = at[0] - right[0], left, union

    def _place(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = self.shift[left] + right
        return np.where(self.owner[at] == left, self.places[at] + place, self.never)

    def packed(self, stretches: list[str]) -> Iterator[tuple[int, bytes]]:
        """The number and the packed ids of each stretch, which is not empty and of fewer than
        `_PLACES` - 1 characters. Those with a character that needs another look are left out."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        symbols, starts = self.symbols[points], np.cumsum(sizes) - sizes
        usable = np.minimum.reduceat(symbols, starts) >= 0
        for low, high in ((0, 10), (10, 20), (20, _PLACES)):
            some = np.flatnonzero(usable & (sizes > low) & (sizes <= high))
            if len(some):
                counts, ids = self._columns(symbols, starts[some], sizes[some])
                ends = (4 * np.cumsum(counts)).tolist()
                data = ids.tobytes()
                yield from zip(some.tolist(), [data[a:b] for a, b in zip([0, *ends], ends)])

    def _columns(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each stretch has, and all ids."""
        n, height = len(starts), int(sizes.max())
        place = np.arange(height + 2)[:, None]
        inside = (place > 0) & (place <= sizes)
        read = np.minimum(starts + place - 1, len(symbols) - 1)
        column = np.where(inside, symbols[read], self.border).ravel()
        agenda = np.full(len(column), self.never, np.int32)
        agenda[:-n] = self._place(column[:-n], column[n:], np.repeat(place[:-1], n))
        best = agenda.reshape(height + 2, n)
        before, behind = np.arange(-n, len(column) - n), np.arange(n, len(column) + n)
        while True:
            first = best.min(axis=0)
            busy = np.flatnonzero(first < self.never)
            if not len(busy):
                break
            first = first[busy]
            row, union = first % _PLACES, self.only[first // _PLACES]
            left = row * n + busy
            right = behind[left]
            after, ahead = behind[right], before[left]
            tied = np.flatnonzero(union < 0)
            if len(tied):
                union[tied] = self.unions[self.shift[column[left[tied]]] + column[right[tied]]]
            column[left], column[right] = union, self.border
            behind[left], before[after] = after, left
            agenda[right] = self.never
            agenda[left] = self._place(union, column[after], row)
            agenda[ahead] = self._place(column[ahead], union, ahead // n)
        left = column.reshape(height + 2, n).T
        held = left != self.border
        return held.sum(axis=1), self.ids[left[held]]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.merges = Merges(vocabulary)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.plain = vocabulary.space_leads and vocabulary.dummy_prefix
        self.segment = _segments(vocabulary)
        self.plain_letters = self.plain and not any(c.isalpha() for c in _odd_letters(vocabulary))

    def merged(self, stretch: str) -> list[str]:
        """All merges inside a stretch of text. The agenda holds the neighbours whose union is a
        piece; the best score goes first, of equal ones the leftmost. A short agenda is a list in
        the order of the text, a long one a heap."""
        return self._listed(stretch) if len(stretch) <= _LISTED_CHARS else self._heaped(stretch)

    def _listed(self, stretch: str) -> list[str]:
        rank, never = self.vocabulary.ranks.get, _NEVER
        symbols = list(stretch)
        agenda = list(map(rank, map(add, symbols, symbols[1:]), repeat(never)))
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            union = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(union + symbols[i + 1], never)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + union, never)
        return symbols

    def _heaped(self, stretch: str) -> list[str]:
        """Entries whose symbols have changed meanwhile are known by their length and skipped."""
        rank = self.vocabulary.ranks.get
        symbols: list[str] = list(stretch)
        before = list(range(-1, len(symbols) - 1))
        behind = [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, int]] = []

        def propose(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                union = symbols[left] + symbols[right]
                place = rank(union)
                if place is not None:
                    heapq.heappush(agenda, (place, left, right, len(union)))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != length:
                continue
            symbols[left], symbols[right] = a + b, ""
            after = behind[left] = behind[right]
            if after >= 0:
                before[after] = left
            propose(before[left], left)
            propose(left, after)
        return [s for s in symbols if s]

    def cut(self, text: str, size: int) -> Iterator[tuple[int, int]]:
        """Parts of at least `size` characters, cut where nothing can merge."""
        joints, start, end = self.vocabulary.joints, 0, len(text)
        while end - start > size:
            at = start + size
            while at < end and text[at - 1 : at + 1] in joints:
                at += 1
            yield start, at
            start = at
        yield start, end

    def segment_ids(self, segment: str) -> bytes:
        """The packed ids of a segment; those of a short one are remembered, up to a fixed number."""
        if len(segment) > _LISTED_CHARS:
            out = bytearray()
            for a, b in self.cut(segment, 1):
                out += self._packed(self.merged(segment[a:b]))
            return bytes(out)
        if len(self.known) >= _KNOWN_SEGMENTS:
            self.known.clear()
        packed = self.known[segment] = self._packed(self._listed(segment))
        return packed

    def _packed(self, pieces: list[str]) -> bytes:
        ids, byte_ids = self.vocabulary.ids, self.vocabulary.byte_ids
        try:
            return array("i", [ids[p] for p in pieces]).tobytes()
        except KeyError:  # a single character without a piece: its bytes
            each = [[ids[p]] if p in ids else [byte_ids[b] for b in p.encode()] for p in pieces]
            return array("i", chain.from_iterable(each)).tobytes()

    def spaced_ids(self, spaced: str) -> bytes:
        known, segment_ids = self.known.get, self.segment_ids
        return b"".join([known(s) or segment_ids(s) for s in self.segment.findall(spaced)])

    def _learn(self, table: dict[str, bytes], limit: int, new: list[str], lead: str) -> None:
        """Many short stretches that are not in a table yet are encoded together. Too few do not
        pay; those left out are encoded one by one where they are met."""
        if len(table) >= limit:
            table.clear()
        short = [s for s in new if len(s) <= _LISTED_CHARS]
        for at in range(0, len(short), _TOGETHER.stop):
            some = short[at : at + _TOGETHER.stop]
            if len(some) >= _TOGETHER.start:
                found = self.merges.packed([lead + s for s in some] if lead else some)
                table.update((some[i], packed) for i, packed in sorted(found))

    def word_ids(self, word: str) -> bytes:
        """The packed ids of a word with a space before it; short words are remembered, too. Where all
        letters are plain, a word of letters is one segment."""
        spaced = SPACE + word
        if self.plain_letters and word.isalpha():
            packed = self.known.get(spaced) or self.segment_ids(spaced)
        else:
            packed = self.spaced_ids(spaced)
        if len(word) <= _LISTED_CHARS:
            if len(self.words) >= _KNOWN_WORDS:
                self.words.clear()
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> array:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[array]:
        """The ids of each text, the end id last. Texts are read in windows; where single spaces
        separate its words, a word is looked up as it is, else a segment. What is unknown in some
        windows is learnt together."""
        out = [array("i") for _ in texts]
        held: list[tuple[array, bool, list[str], list[bytes | None]]] = []
        size = 0
        for ids, text in zip(out, texts):
            for part, plain in self._parts(text) if text else []:
                stretches = part.split(" ") if plain else self.segment.findall(part)
                held.append((ids, plain, stretches, list(map((self.words if plain else self.known).get, stretches))))
                size += len(part)
                if size >= _BYTES_TOGETHER:
                    self._join(held)
                    held, size = [], 0
        self._join(held)
        for ids in out:
            ids.append(self.vocabulary.end)
        return out

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Windows, and whether single spaces separate their words; where they do not, spaces are
        written as pieces have them."""
        lead = SPACE if self.vocabulary.dummy_prefix else ""
        plain = self.plain and SPACE not in text
        for part in _windows(text, _WINDOW_CHARS) if plain else [text]:
            if plain and "  " not in part and not part.startswith(" "):
                yield part, True
            else:
                spaced = lead + part.replace(" ", SPACE)
                for start, end in self.cut(spaced, _WINDOW_CHARS):
                    yield spaced[start:end], False

    def _join(self, held: list[tuple[array, bool, list[str], list[bytes | None]]]) -> None:
        unknown = [[i for i, packed in enumerate(found) if packed is None] for *_, found in held]
        for words in (True, False):
            new = dict.fromkeys(s[i] for (_, plain, s, _), places in zip(held, unknown) if plain == words for i in places)
            if words:
                self._learn(self.words, _KNOWN_WORDS, list(new), SPACE)
            else:
                self._learn(self.known, _KNOWN_SEGMENTS, list(new), "")
        for (ids, plain, stretches, found), places in zip(held, unknown):
            known, alone = (self.words.get, self.word_ids) if plain else (self.known.get, self.segment_ids)
            for i in places:
                found[i] = known(stretches[i]) or alone(stretches[i])
            ids.frombytes(b"".join(found))


def _windows(text: str, size: int) -> Iterator[str]:
    """Parts of a text between two spaces; the space before a part, like that which encoding puts
    before the text, is left out."""
    start = 0
    while len(text) - start > size:
        found = _FIRST_SPACE.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


def decode(ids: array, vocabulary: Vocabulary) -> Iterator[str]:
    """Text step by step. The state between ids: at most three bytes of an unfinished character,
    and whether a leading space is still the one that encoding put there. Each byte that is no
    text becomes U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    stands, first = vocabulary.stands, 0
    if vocabulary.dummy_prefix:
        while first < len(ids) and not stands[ids[first]]:
            first += 1
        if first < len(ids) and ids[first] in vocabulary.spaced:
            yield machine.decode(stands[ids[first]][1:])
            first += 1
    for at in range(first, len(ids), _IDS_PER_STEP):
        yield _NO_TEXT.sub("\ufffd", machine.decode(b"".join(map(stands.__getitem__, ids[at : at + _IDS_PER_STEP]))))
    yield _NO_TEXT.sub("\ufffd", machine.decode(b"", final=True))


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> tuple[Vocabulary, Encoder, sentencepiece.SentencePieceProcessor]:
    vocabulary = Vocabulary(model)
    return vocabulary, Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_proto=model)


def _together(found: Iterator[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Numbered texts in lists of a bounded size, or one text each."""
    some: list[tuple[int, bytes]] = []
    size = 0
    for row, data in enumerate(found):
        if some and size + len(data) > _BYTES_TOGETHER:
            yield some
            some, size = [], 0
        some.append((row, data))
        size += len(data)
    if some:
        yield some


def _packets(rows: Iterator[tuple], columns: int) -> Iterator[list[list]]:
    """Rows gathered to batches of a bounded number of ids, however long a text is."""
    held: list[list] = [[] for _ in range(columns)]
    size = 0
    for ids, row in rows:
        for column, value in zip(held, row):
            column.append(value)
        size += ids
        if size >= _IDS_PER_BATCH:
            yield held
            held, size = [[] for _ in range(columns)], 0
    if held[0]:
        yield held


def _int32(values: array) -> pa.Array:
    return pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)])


def encode(docs: DataFrame, path: str, check: bool = False) -> DataFrame:
    """(doc_id, k1, k2, ids, decoded, agrees) for each row of `docs` (doc_id, text): the ids with
    the end id, what they stand for, and, with `check`, whether the sentencepiece library gives the
    same for both (null without).

    `path` names the model on the driver; its size is that of the file, 0.5 MB. Null text reads
    as empty and has the end id alone. Strings like `</s>` inside a text are ordinary text. White
    space stays as it is; the character that stands for a space (U+2581) comes back as a space.
    Repeated rows give repeated results, an empty table none; other columns, whatever their
    names, are not looked at. A task holds one batch of texts, the vocabulary and a bounded
    table of known segments; a text of any length is encoded in time n log n of the longest
    stretch in which neighbours could merge at all.
    """
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType
    rows = pack(docs, "doc_id", "text").select("doc_id", *KEY, "text")
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            *[T.StructField(k, T.LongType()) for k in KEY],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("decoded", T.StringType()),
            T.StructField("agrees", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder, library = _loaded(model.value)
        for batch in batches:
            keys = batch.select(["doc_id", *KEY])

            def coded(batch=batch) -> Iterator[tuple]:
                for some in _together(texts(batch, "text")):
                    said = [data.decode() for _, data in some]
                    theirs = library.encode(said, add_eos=True, num_threads=1) if check else [None] * len(some)
                    for (row, _), ids, their in zip(some, encoder.encode_all(said), theirs):
                        back = "".join(decode(ids, vocabulary))
                        agrees = array("i", their) == ids and library.decode(their) == back if check else None
                        yield len(ids), (row, ids, back, agrees)

            for place, ids, back, agrees in _packets(coded(), 4):
                kept = keys.take(pa.array(place))
                flat = array("i")
                ends = array("i", [0])
                for some in ids:
                    flat.extend(some)
                    ends.append(len(flat))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _int32(flat))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, lists, pa.array(back, pa.string()), pa.array(agrees, pa.bool_())],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)

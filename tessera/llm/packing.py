"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows.  A document is cut into whole windows and a remainder; the
remainder goes to the open window that it fits best.  When none fits and no further window may be opened, the
fullest is filled up with a cut of the remainder and emitted.  At the end of a partition its open windows merge,
which leaves less than one; those leftovers merge among neighbouring partitions, a bounded number at a time, and
what is left there is emitted at lengths that are powers of two.  So no sequence needs padding.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, table, texts_of, written
from .token_counts import tokenizer_of

VOCABULARY, END_ID = "word_bpe_49k.json", 1
WINDOW_TOKENS, OPEN_WINDOWS = 2048, 64
#: Leftovers of so many partitions merge in one task.
MERGED_PARTITIONS = 256
#: Words that a worker's cache holds before it is emptied (about 150 bytes each); longer ones than so many bytes are
#: encoded for one batch and forgotten.
CACHE_WORDS, LONGEST_WORD = 800_000, 128

#: Lower-case Latin letters in their composed forms, which normalization leaves alone, and words of these and ASCII.
_PLAIN = re.compile("[a-zß-öø-ž]+").fullmatch
_MIXED = re.compile("[a-zß-öø-ž!-@[-`{-~]+").fullmatch
#: The vocabulary's pre-tokens of such words (its pattern, for these characters).
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9]+").findall
_loaded: dict = {}

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def word_encoder(path: str):
    """encode(word) -> places in an id table, and that table, for words that are one pre-token.

    The vocabulary's merges as ranks of byte strings, in which a byte that UTF-8 lacks marks a word's end and joins
    the last byte first.  This gives the library's ids at a fraction of its time, as tests compare.
    """
    import json

    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    letters, end = _byte_letters(), model["end_of_word_suffix"]

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token.removesuffix(end)) + (b"\xff" if token.endswith(end) else b"")

    ranks, ids = {}, []

    def put(key: bytes, token: str) -> None:
        ranks[key] = len(ids)
        ids.append(model["vocab"][token])

    by_byte = {b: c for c, b in letters.items()}
    for b in range(256):
        put(bytes([b]), by_byte[b])
    for b in range(255):
        put(bytes([b, 255]), by_byte[b] + end)
    for merge in model["merges"]:
        token = "".join(merge) if isinstance(merge, list) else merge.replace(" ", "", 1)
        put(raw(token), token)
    encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece, np.array(ids, "<u4")


class Words(dict):
    """word (UTF-8 without ASCII white space) -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = tokenizer_of(path)[0]
        self.encode, self.table = word_encoder(path)

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        self.long = [w for w in new if len(w) > LONGEST_WORD]
        plain, others, pieces = [], [], []
        encode = self.encode
        for w in new:
            text = w.decode("utf-8", "replace")
            low = text.lower()
            if _PLAIN(low):
                plain.append(w)
                pieces.append(encode(low.encode() + b"\xff"))
            elif _MIXED(low) and "<|" not in low:  # added tokens begin with that
                plain.append(w)
                pieces.append([k for part in _PARTS(low) for k in encode(part.encode() + b"\xff")])
            else:
                others.append((w, text))
        if plain:
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            raw = self.table[np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))].tobytes()
            at = 0
            for w, end in zip(plain, (4 * np.cumsum(sizes)).tolist()):
                self[w] = raw[at:end]
                at = end
        if others:
            for (w, _), e in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
                self[w] = np.array(e.ids, "<u4").tobytes()


    def forget(self) -> None:
        """Drops the long words of the last batch."""
        for w in self.long:
            del self[w]


class Packer:
    """emit(sequence: list of pieces) gets each finished sequence; a piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, emit: Callable, window: int = WINDOW_TOKENS, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.most = emit, window, open_windows
        self.rooms: list[tuple[int, int]] = []  # (room left, number), sorted
        self.held: dict[int, list] = {}
        self.count = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        n = len(ids) // 4
        while n >= self.window:
            self.emit([(doc_id, start, ids[: 4 * self.window], doc_tokens)])
            ids, start, n = ids[4 * self.window :], start + self.window, n - self.window
        if not n:
            return
        at = bisect_left(self.rooms, (n, -1))
        if at < len(self.rooms):
            room, k = self.rooms.pop(at)
            self._into(k, room, (doc_id, start, ids, doc_tokens))
        elif len(self.rooms) < self.most:
            self.count += 1
            self.held[self.count] = []
            self._into(self.count, self.window, (doc_id, start, ids, doc_tokens))
        else:
            room, k = self.rooms.pop(0)
            self._into(k, room, (doc_id, start, ids[: 4 * room], doc_tokens))
            self.add(doc_id, start + room, ids[4 * room :], doc_tokens)

    def _into(self, k: int, room: int, piece) -> None:
        self.held[k].append(piece)
        room -= len(piece[2]) // 4
        if room:
            insort(self.rooms, (room, k))
        else:
            self.emit(self.held.pop(k))

    def merge(self) -> list:
        """Merges all open windows, emptiest last; what is left fills less than one window."""
        pieces = [p for _, k in self.rooms for p in self.held[k]]
        self.rooms, self.held = [], {}
        return merge_pieces(pieces, self.emit, self.window)


def merge_pieces(pieces: list, emit: Callable, window: int) -> list:
    """Emits full windows of the pieces in order, cutting where one ends; returns the rest."""
    held, room = [], window
    for doc_id, start, ids, total in pieces:
        while len(ids) >= 4 * room:
            emit([*held, (doc_id, start, ids[: 4 * room], total)])
            held, ids, start, room = [], ids[4 * room :], start + room, window
        if ids:
            held.append((doc_id, start, ids, total))
            room -= len(ids) // 4
    return held


def powers(pieces: list, emit: Callable, window: int) -> None:
    """Emits pieces that fill less than a window as sequences whose lengths are powers of two."""
    while pieces:
        n = sum(len(p[2]) for p in pieces) // 4
        sequences: list = []
        size = min(window, 1 << (n.bit_length() - 1))
        pieces = merge_pieces(pieces, sequences.append, size)
        for s in sequences:
            emit(s)


class Rows:
    """Gathers output rows; hands them over as batches."""

    def __init__(self, base: int, with_ids: bool):
        self.next, self.with_ids, self.rows = base, with_ids, []

    def emit(self, sequence: list) -> None:
        self._put(sequence, self.next, self.with_ids)
        self.next += 1

    def leave(self, pieces: list) -> None:
        self._put(pieces, -1, True)

    def _put(self, pieces: list, sequence: int, with_ids: bool) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, sequence, at, ids if with_ids else None))
            at += n

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return batch(_PIECES, *(zip(*rows) if rows else [[]] * 8))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW_TOKENS, open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null without with_ids).

    A null or empty text is the end id alone.  Rows with null keys and repeated rows are packed like any other; a
    text of any length is packed whole; an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded.get(path) or _loaded.setdefault(path, Words(path))
        rows = Rows(TaskContext.get().partitionId() << 32, with_ids)
        packer = Packer(rows.emit, window, open_windows)
        for b in batches:
            split = [x.split() for x in b.column(1).to_pylist()]
            words.learn(set().union(*split))
            for doc_id, x in zip(b.column(0).to_pylist(), split):
                ids = b"".join(map(words.__getitem__, x)) + end
                packer.add(doc_id, 0, ids, len(ids) // 4)
            words.forget()
            yield rows.take()
        rows.leave(packer.merge())
        yield rows.take()

    packed = written(texts_of(docs, key, text).mapInArrow(run, PIECES).withColumn("part", F.floor(F.spark_partition_id() / MERGED_PARTITIONS).cast("long")), "packed")

    def merge(group: pa.Table) -> pa.Table:
        x = group.sort_by([("doc_id", "ascending"), ("start", "ascending")]).to_pydict()
        rows = Rows(1 << 62 | x["part"][0] << 32, with_ids)
        powers(merge_pieces(list(zip(x["doc_id"], x["start"], x["ids"], x["doc_tokens"])), rows.emit, window), rows.emit, window)
        return pa.Table.from_batches([rows.take()])

    left = packed.filter("sequence_id < 0").groupBy("part").applyInArrow(merge, PIECES)
    return packed.filter("sequence_id >= 0").drop("part").unionByName(left)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")

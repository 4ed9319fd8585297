"""Substring deduplication by suffix automata of reference shards.

Passages of the corpus that may repeat (see passages.py) are the reference.  They are dealt into shards of bounded
size, each of which becomes a generalized suffix automaton over words; a state knows the first document in which its
strings occur.  Documents' passages stream through the automaton of their shard for matching statistics; where the
longest match reaches the threshold, and the state at exactly that depth occurs in an earlier document, the window
is marked, and marked windows join to maximal spans, which are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, discard, table, texts_of, written
from .passages import Kind, covered, repeated_windows, texts_with_order, with_spans

WINDOW_WORDS, GRAM_WORDS = 50, 16

_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


class Automaton:
    """A generalized suffix automaton; texts are added in ascending order of their documents."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 63]

    def add(self, text: list, doc: int) -> None:
        last = 0
        for c in text:
            last = self._extend(last, c)
            if doc < self.first[last]:
                self.first[last] = doc

    def _extend(self, last: int, c) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.first.append(1 << 63)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.first.append(1 << 63)
        link[q] = new
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = new
            p = link[p]
        return new

    def finish(self) -> None:
        """Hands the first documents on to the states of shorter strings."""
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = self.link[s]
            if up >= 0 and self.first[s] < self.first[up]:
                self.first[up] = self.first[s]

    def earlier(self, text: list, doc: int, window: int) -> np.ndarray:
        """Which windows of text occur in a document before doc."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        out = np.zeros(max(0, len(text) - window + 1), bool)
        s = matched = 0
        for i, c in enumerate(text):
            while s and c not in nexts[s]:
                s = link[s]
                matched = length[s]
            s_next = nexts[s].get(c)
            if s_next is None:
                continue
            s, matched = s_next, matched + 1
            while length[link[s]] >= window:
                s = link[s]
                matched = min(matched, length[s])
            if matched >= window and first[s] < doc:
                out[i - window + 1] = True
        return out


def shard_masks(contents: list[tuple[bytes, int, bool]], window: int = WINDOW_WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (body, first document, whether later ones have it), in ascending order of documents, its windows that a
    document before the first one has, and those that one before the next has."""
    number: dict[bytes, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in body.split()] for body, _, _ in contents]
    automaton = Automaton()
    for text, (_, doc, _) in zip(texts, contents):
        automaton.add(text, doc)
    automaton.finish()
    out = []
    for text, (_, doc, again) in zip(texts, contents):
        mask = automaton.earlier(text, doc, window)
        out.append((mask, automaton.earlier(text, doc + 1, window) if again else mask))
    return out


def remove_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_WORDS, gram: int = GRAM_WORDS, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (null without keep_text); a row per input row.

    Words covered by a window that also occurs in a document with a smaller id go.  Null and empty texts have no
    words.  Rows with one id are one document as far as order goes: they don't remove from one another.  A row
    without an id comes after all others.  Texts of any length are compared whole; an empty table gives an empty result.
    """
    kind = Kind(True, window, gram)
    texts = texts_with_order(docs, key, text)
    spans = repeated_windows(texts, kind, True, lambda contents: shard_masks(contents, window))

    def finish(raw: bytes, found: list) -> tuple:
        words = raw.split()
        gone = covered(found, len(words), window)
        left = [w for w, g in zip(words, gone.tolist()) if not g] if found else words
        kept = b" ".join(left)
        return len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None

    return with_spans(texts, spans, finish, _OUT, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


#: Words of a reference shard whose automaton is broadcast (about 1 KB of worker memory each), and shards in one pass.
SHARD_WORDS, PASS_SHARDS = 50_000, 4


def shards_of(reference: DataFrame, text: str, window: int, most: int) -> Iterator[list[list[bytes]]]:
    """The reference in shards of at most so many words (or one longer text); texts shorter than a window can't match."""
    shard, n = [], 0
    for r in texts_of(reference, text, text).select("text").toLocalIterator():
        words = bytes(r.text).split()
        if len(words) < window:
            continue
        if shard and n + len(words) > most:
            yield shard
            shard, n = [], 0
        shard.append(words)
        n += len(words)
    if shard:
        yield shard


def remove_reference(docs: DataFrame, reference: DataFrame, key: str = "doc_id", text: str = "text", reference_text: str = "text", window: int = WINDOW_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept; a row per input row: words covered by a window that the reference has go.

    The automata of some shards are broadcast, documents stream through them, and what they mark is kept in shared storage
    before the next shards' turn; a small reference takes one pass.  Null and empty texts have no words, on either side; an
    empty reference removes nothing; repeated rows are each judged; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = pa.schema([*_OUT, ("marks", pa.binary())])

    def matched(shards: list[list[list[bytes]]], source: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automata = []
            for shard in shared.value:
                number: dict[bytes, int] = {}
                automaton = Automaton()
                for words in shard:
                    automaton.add([number.setdefault(w, len(number)) for w in words], 0)
                automaton.finish()
                automata.append((automaton, number))
            for b in batches:
                ids, texts, marks = (b.column(c).to_pylist() for c in ("doc_id", "text", "marks"))
                out = []
                for raw, held in zip(texts, marks):
                    words = raw.split()
                    gone = np.unpackbits(np.frombuffer(held, np.uint8), count=len(words)).astype(bool) if held else np.zeros(len(words), bool)
                    for automaton, number in automata:
                        hit = automaton.earlier([number.get(w, -1) for w in words], 1, window)
                        edge = np.zeros(len(words) + 1, np.int32)
                        np.add.at(edge, np.flatnonzero(hit), 1)
                        np.add.at(edge, np.flatnonzero(hit) + window, -1)
                        gone |= np.cumsum(edge[:-1]) > 0
                    kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), np.packbits(gone).tobytes()))
                yield pa.RecordBatch.from_arrays([*batch(schema, ids, *(zip(*out) if out else [[]] * 5)).columns, pa.array(texts, pa.binary())], names=[*schema.names, "text"])

        return source.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, marks binary, text binary")

    source, group, last = texts_of(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("marks", F.lit(None).cast("binary")), [], None
    for shard in shards_of(reference, reference_text, window, shard_words):
        if len(group) == PASS_SHARDS:
            before, last, group = last, written(matched(group, source), "matched"), []
            source = last.select("doc_id", "text", "marks")
            if before is not None:
                discard(before)
        group.append(shard)
    last = matched(group, source)
    return last.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")

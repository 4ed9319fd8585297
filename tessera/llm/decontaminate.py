"""Benchmark decontamination with a distributed positional inverted index.

The training table becomes index segments: each holds some documents' postings, term by term with positions, and is
one row of a stored table.  Segments are document-partitioned, so that building them moves no posting and no term,
however common, ever gathers anywhere.  Test phrases go to all segments in blocks of bounded size, several in one pass.
In a segment a phrase starts from the positions of its rarest term, moved back by the term's offset, and intersects
them with the offset-adjusted positions of its other terms, rarest first; what is left are the exact matches.
Proximity matches start from the same positions and keep those around which all other terms occur close enough.
Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE_FILE, PLACE_ROW, batch, bounded_batches, bounds_of, columns_of, discard, hash_words, placed, table, texts_of, written

WINDOW = 13
#: A proximity match has all words of a window, in any order, within so many consecutive words.
NEAR_WORDS = 26
#: contaminated: so many times the hit words reach the number of words.
HIT_FACTOR = 20
#: A segment is closed when it has so many words; a longer document has one of its own.
SEGMENT_WORDS = 500_000
#: Benchmark words in a block (8 bytes each, and 13 windows' slots of 4: about 60 MB in a worker, one block at a time),
#: and blocks (4 MB each, as hashes) that are broadcast for one pass over the index.
BLOCK_WORDS, PASS_BLOCKS = 500_000, 8
#: Positions of rarest terms that are looked at together (or those of one window, if they are more).
CANDIDATES = 1 << 20

#: Bytes that are part of words are kept, A-Z lower-cased, all others become blanks (fixed values).
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SEGMENTS = "doc_ids array<bigint>, files array<bigint>, n_words array<int>, terms binary, counts binary, gaps binary"
_SEGMENTS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("files", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary())])
_HITS = pa.schema([("segment", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("file", pa.int64()), ("n_words", pa.int64()), ("runs", pa.binary()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
HITS = "segment long, row int, doc_id long, file long, n_words long, runs binary, items array<string>, near array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Segment:
    """Postings of some documents: keys are (term number << 32 | position), sorted.  One position is left free after each document."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.n_words, self.terms, self.counts = n_words, terms, counts
        self.starts = bounds_of(counts)
        self.bases = bounds_of(n_words + 1)
        self.positions = positions
        self.keys = np.repeat(np.arange(len(terms), dtype=np.uint64), counts) << np.uint64(32) | positions.astype(np.uint64)

    @classmethod
    def build(cls, docs: list[list[bytes]]) -> Segment:
        n_words = np.array([len(x) for x in docs], np.int64)
        hashes = hash_words([w for x in docs for w in x])
        positions = np.arange(len(hashes)) + np.repeat(np.arange(len(docs)), n_words)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
        return cls(n_words, ordered[first], np.diff(np.r_[first, len(ordered)]).astype(np.int64), positions[order])

    def pack(self) -> tuple[bytes, bytes, bytes]:
        """Terms, counts and positions; positions as differences modulo 2**32, which compress well."""
        gaps = np.diff(self.positions.astype(np.uint32), prepend=np.uint32(0))
        return self.terms.tobytes(), self.counts.astype(np.uint32).tobytes(), gaps.tobytes()

    @classmethod
    def unpack(cls, n_words: list[int], terms: bytes, counts: bytes, gaps: bytes) -> Segment:
        positions = np.cumsum(np.frombuffer(gaps, np.uint32), dtype=np.uint32)
        return cls(np.array(n_words, np.int64), np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64), positions.astype(np.int64))

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Term numbers here; -1 for terms without postings."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = number.astype(np.uint64) << np.uint64(32) | position.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (position >= 0) & (self.keys[at] == key)

    def candidates(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some windows at a time: the windows, their slots in the order of rarity, and, for each position of a rarest
        term, the place of its window among these and the position."""
        if not len(self.keys) or not len(block.windows):
            return
        df = np.where(block.number >= 0, self.counts[block.number], 0)
        slot_df = np.where(block.windows >= 0, df[block.windows], np.iinfo(np.int64).max)
        able = np.flatnonzero(slot_df.min(axis=1) > 0)
        order = np.argsort(slot_df[able], axis=1, kind="stable")
        terms = block.number[block.windows[able, order[:, 0]]] if len(able) else able
        total = bounds_of(self.counts[terms])
        at = 0
        while at < len(able):
            end = max(at + 1, int(np.searchsorted(total, total[at] + CANDIDATES, side="right")) - 1)
            many = total[at + 1 : end + 1] - total[at:end]
            window = np.repeat(np.arange(end - at), many)
            place = np.arange(len(window)) - np.repeat(total[at:end] - total[at], many) + np.repeat(self.starts[terms[at:end]], many)
            yield able[at:end], order[at:end], window, self.positions[place]
            at = end

    def phrases(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, start position) of every exact match."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for windows, order, window, position in self.candidates(block):
            start = position - order[window, 0]
            for k in range(1, order.shape[1]):
                slot = order[window, k]
                term = block.windows[windows[window], slot]
                ok = (term < 0) | self.has(block.number[term], start + slot)
                window, start = window[ok], start[ok]
            good = start >= 0
            found.append((windows[window[good]], start[good]))
        return np.concatenate([w for w, _ in found]), np.concatenate([x for _, x in found])

    def proximities(self, block: Block, span: int) -> set[tuple[int, int]]:
        """(window, document's row) where all words of the window occur within span consecutive words."""
        found: set[tuple[int, int]] = set()
        for windows, order, window, position in self.candidates(block):
            row = np.searchsorted(self.bases, position, side="right") - 1
            low, high = np.maximum(self.bases[row], position - span + 1), np.minimum(self.bases[row + 1] - 2, position + span - 1)
            for k in range(1, order.shape[1]):
                term = block.windows[windows[window], order[window, k]]
                number = block.number[term]
                first = np.searchsorted(self.keys, number.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64))
                inside = first < self.starts[np.maximum(number, 0) + 1]
                ok = (term < 0) | inside & (self.positions[np.minimum(first, len(self.positions) - 1)] <= high)
                window, row, low, high = window[ok], row[ok], low[ok], high[ok]
            for w, r, a, z in zip(windows[window].tolist(), row.tolist(), low.tolist(), high.tolist()):
                if (w, r) not in found and self.together(np.unique(block.number[block.windows[w][block.windows[w] >= 0]]), a, z, span):
                    found.add((w, r))
        return found

    def together(self, numbers: np.ndarray, low: int, high: int, span: int) -> bool:
        """Whether all terms occur within span consecutive positions from low to high."""
        lists = [self.positions[self.starts[t] : self.starts[t + 1]] for t in numbers]
        close = [x[np.searchsorted(x, low) : np.searchsorted(x, high, side="right")] for x in lists]
        return all(map(len, close)) and any(all(len(x) > (i := np.searchsorted(x, s)) and x[i] < s + span for x in close) for s in np.unique(np.concatenate(close)))

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Documents (rows here) in which all terms occur within span consecutive words."""
        number = np.unique(self.numbers(np.unique(terms)))
        if not len(number) or number[0] < 0:
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[self.starts[t] : self.starts[t + 1]] for t in number), key=len)
        found = []
        for p in lists[0]:
            row = np.searchsorted(self.bases, p, side="right") - 1
            if self.together(number, max(self.bases[row], p - span + 1), min(self.bases[row + 1] - 2, p + span - 1), span):
                found.append(row)
        return np.unique(np.array(found, np.int64))


Items = list[tuple[str | None, np.ndarray]]


class Block:
    """Windows of some benchmark items, each distinct one once: terms are hashes, windows rows of term numbers (-1: unused
    slot), holders (window, item) pairs, sorted.  number has the terms' numbers in a segment."""

    def __init__(self, items: Items, window: int):
        self.items = sorted({i for i, _ in items}, key=by_name)
        place = {x: k for k, x in enumerate(self.items)}
        flat = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        self.terms, flat = np.unique(flat, return_inverse=True)
        rows, owner, at = [], [], 0
        for item, h in items:
            own = flat[at : at + len(h)].astype(np.int32)
            at += len(h)
            if len(own) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
            else:
                rows.append(np.pad(own, (0, window - len(own)), constant_values=-1)[None, :])
            owner += [place[item]] * len(rows[-1])
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int32)
        self.windows, which = np.unique(every, axis=0, return_inverse=True)
        self.holders = np.unique(np.stack([which.reshape(-1), np.array(owner, np.int64)], 1), axis=0)
        self.lengths = (self.windows >= 0).sum(axis=1) if len(self.windows) else np.zeros(0, np.int64)
        self.number = np.full(len(self.terms), -1)

    def items_of(self, windows: np.ndarray) -> list[str | None]:
        """The items that have any of these windows, in order."""
        windows = np.unique(windows)
        a, z = np.searchsorted(self.holders[:, 0], windows), np.searchsorted(self.holders[:, 0], windows, side="right")
        at = np.arange((z - a).sum()) - np.repeat(bounds_of(z - a)[:-1], z - a) + np.repeat(a, z - a)
        return [self.items[k] for k in np.unique(self.holders[at, 1])]


def by_name(item: str | None) -> tuple[str, bool]:
    """The order of items: as strings; no id counts as "null", after an item of that name."""
    return ("null", True) if item is None else (item, False)


def blocks_of(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of at most so many words (or one longer item)."""
    items, n = [], 0
    for r in texts_of(benchmark, item, text).toLocalIterator():
        h = hash_words(words_of(bytes(r.text)))
        if not len(h):
            continue
        if items and n + len(h) > most:
            yield items
            items, n = [], 0
        items.append((None if r.doc_id is None else str(r.doc_id), h))
        n += len(h)
    yield items


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", file: str | None = None) -> DataFrame:
    """Index segments, a row each.  Every input row is in exactly one; documents without words as well."""
    bounded_batches(docs.sparkSession)

    def segment(ids: list, files: list, lists: list[list[bytes]]) -> pa.RecordBatch:
        s = Segment.build(lists)
        return batch(_SEGMENTS, [ids], [files], [[len(x) for x in lists]], *([x] for x in s.pack()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, files, lists, n = [], [], [], 0
        for b in batches:
            for i, raw, f in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(raw)
                if ids and n + len(words) > SEGMENT_WORDS:
                    yield segment(ids, files, lists)
                    ids, files, lists, n = [], [], [], 0
                ids.append(i)
                files.append(f)
                lists.append(words)
                n += len(words)
        if ids:
            yield segment(ids, files, lists)

    source = texts_of(docs, key, text).withColumn("file", F.lit(None).cast("long")) if file is None else texts_of(docs, key, text, file)
    return source.mapInArrow(run, SEGMENTS)


def _covered(runs: np.ndarray) -> int:
    """Positions in any of the [start, end) rows of runs."""
    if not len(runs):
        return 0
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    top = np.maximum.accumulate(runs[:, 1])
    return int(np.maximum(0, runs[:, 1] - np.maximum(runs[:, 0], np.r_[runs[0, 0], top[:-1]])).sum())


def _match_blocks(index: DataFrame, blocks: list[Items], window: int, span: int | None) -> DataFrame:
    """Per document its hit runs and items, of some blocks, in shared storage; one pass over the index."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(blocks)

    def match(x: dict, seg: Segment, block: Block) -> tuple[list, list, list]:
        block.number = seg.numbers(block.terms)
        found, start = seg.phrases(block)
        row = np.searchsorted(seg.bases, start, side="right") - 1
        order = np.argsort(row, kind="stable")
        found, row = found[order], row[order]
        start = start[order] - seg.bases[row]
        cut = np.searchsorted(row, np.arange(len(seg.n_words) + 1))
        runs, items, near = [], [], [[] for _ in seg.n_words]
        for a, z in zip(cut[:-1], cut[1:]):
            runs.append(merged(np.stack([start[a:z], start[a:z] + block.lengths[found[a:z]]], 1)) if a < z else NO_RUNS)
            items.append(block.items_of(found[a:z]) if a < z else [])
        if span is not None:
            by_row: dict[int, list[int]] = {}
            for w, r in seg.proximities(block, span):
                by_row.setdefault(r, []).append(w)
            for r, windows in by_row.items():
                near[r] = block.items_of(np.array(windows))
        return runs, items, near

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Block(shared.value[0], window)] if len(shared.value) == 1 else None
        for b in batches:
            for x in b.to_pylist():
                seg = Segment.unpack(x["n_words"], x["terms"], x["counts"], x["gaps"])
                parts = [match(x, seg, block) for block in held or (Block(items, window) for items in shared.value)]
                union = lambda lists: sorted(set().union(*lists), key=by_name)
                runs = [merged(np.concatenate(r)).astype(np.int32).tobytes() for r in zip(*(p[0] for p in parts))]
                yield batch(_HITS, np.full(len(runs), x["segment"]), np.arange(len(runs)), x["doc_ids"], x["files"], x["n_words"], runs, *([union(r) for r in zip(*(p[k] for p in parts))] for k in (1, 2)))

    out = written(index.mapInArrow(run, HITS), "hits")
    shared.unpersist()
    return out


NO_RUNS = np.zeros((0, 2), np.int64)


def merged(runs: np.ndarray) -> np.ndarray:
    """[start, end) rows as disjoint ones, in order."""
    if not len(runs):
        return NO_RUNS
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    top = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.r_[True, runs[1:, 0] > top[:-1]])
    return np.stack([runs[first, 0], top[np.r_[first[1:] - 1, len(runs) - 1]]], 1)


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str, item_text: str, window: int, block_words: int, span: int | None, file: str | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """HITS of every document, and the tables that they are read from."""
    index = written(build_index(docs, key, text, file).withColumn("segment", F.monotonically_increasing_id()), "postings")
    parts, blocks = [], []
    for items in blocks_of(benchmark, item, item_text, block_words):
        blocks.append(items)
        if len(blocks) == PASS_BLOCKS:
            parts.append(_match_blocks(index, blocks, window, span))
            blocks = []
    if blocks or not parts:
        parts.append(_match_blocks(index, blocks or [[]], window, span))
    discard(index)
    hits = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            hits = hits.unionByName(p)
        # a document has one row from each pass
        together = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
        hits = hits.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("file").alias("file"), F.first("n_words").alias("n_words"), F.array_join(F.transform(F.collect_list("runs"), lambda x: F.hex(x)), "").alias("runs"), together("items"), together("near")).withColumn("runs", F.unhex("runs"))
    return hits, parts


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, near_words: int | None = NEAR_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, near; one row per input row.

    near: the items with a window all of whose words occur, in any order, within near_words consecutive words (None:
    not looked for).  Null and empty texts have no words and no hits; items without words have no window.  Benchmark
    rows with one item_id are one item; those without an id are one item as well, which sorts as "null" but isn't the
    item of that name.  Null document keys and repeated rows are kept as they are.  An empty benchmark hits nothing; an
    empty table gives an empty result.  A long document is a segment of its own.  Further columns are ignored.
    """
    hits, _ = find_hits(docs, benchmark, key, text, item, item_text, window, block_words, near_words)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_()), ("near", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_words").to_pylist()
            hit = [_covered(np.frombuffer(r, np.int32).reshape(-1, 2)) if r else 0 for r in b.column("runs").to_pylist()]
            items, near = ([sorted(x, key=by_name) for x in b.column(c).to_pylist()] for c in ("items", "near"))
            yield batch(out, b.column("doc_id"), n, hit, [len(x) for x in items], items, [h > 0 and HIT_FACTOR * h >= w for h, w in zip(hit, n)], near)

    return hits.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean, near array<string>")


def without_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that have no exact match of any window, with all their columns; each row is judged by its own text."""
    held, _ = placed(docs)
    hits, tables = find_hits(held, benchmark, PLACE_ROW, text, item, item_text, window, block_words, None, PLACE_FILE)
    # hits grow with the corpus, so they aren't broadcast, whatever their number
    gone = written(hits.filter("length(runs) > 0").select(F.col("file").alias(PLACE_FILE), F.col("doc_id").alias(PLACE_ROW)), "gone")
    discard(*tables)
    return held.join(gone.hint("merge"), [PLACE_FILE, PLACE_ROW], "left_anti").select(columns_of(docs))


def near_matches(index: DataFrame, queries: list[tuple[str, bytes]], span: int) -> DataFrame:
    """(query, doc_id) where all words of a query occur within span consecutive words, for a short list of queries."""
    shared = index.sparkSession.sparkContext.broadcast([(q, hash_words(words_of(t))) for q, t in queries])
    schema = pa.schema([("query", pa.string()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                seg = Segment.unpack(x["n_words"], x["terms"], x["counts"], x["gaps"])
                found = [(q, x["doc_ids"][r]) for q, terms in shared.value if len(terms) for r in seg.near(terms, span)]
                yield batch(schema, [q for q, _ in found], [d for _, d in found])

    return index.mapInArrow(run, "query string, doc_id long")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",", "null").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated", F.size("near").cast("long").alias("n_near"))


def items_digest(items: list[str | None]) -> str:
    return hashlib.sha256(",".join("null" if i is None else i for i in sorted(items, key=by_name)).encode()).hexdigest()

"""Windows that repeat across a corpus, found without gathering all windows.

Texts are sequences of symbols (words or bytes).  The least hash among a window's grams, its minimizer, is the same
wherever the window occurs.  Consecutive windows with one minimizer form a segment, so a corpus has far fewer segments
than windows, and equal windows always lie in segments with equal minimizers.  Then:

* a minimizer that occurs once proves its windows unique;
* all others are compared by content.  Each distinct content travels once, with a note whether it has copies, to the
  shard of its minimizer, and a shard has a bounded size.  A minimizer with too many distinct contents for a shard (a common
  line in ever different surroundings) has its windows divided by the place of the minimizer in them, in halves
  again and again: the windows of one part share a core; a part whose core occurs once is settled, and of equal
  parts one goes on for all.  Surroundings that differ so fall away in a few rows per content, in any number of tasks.

Counts and minima of one minimizer come together per task first; joins on minimizers may be split by Spark.

Minimizers and contents are compared by 64-bit hashes.  Only contents of one minimizer are ever compared, which at
10**13 segments leaves a chance of about one in 100,000 that any two different ones are taken for equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import B64, MIX2, batch, bounded_batches, discard, hash_words, mix64, slots, written

#: Symbols of a text that are hashed at once.  Longer texts are cut there, which splits a segment, never a window.
SLICE = 1 << 19
#: Bytes of content in a shard, about; distinct contents of a minimizer beyond which its windows are hashed.
SHARD_BYTES, MOST_CONTENTS = 256 << 10, 256
#: Shards in a task, about.
TASK_SHARDS = 8
#: The order of rows without an id: after all others.
LAST = (1 << 63) - 1

_LOW = np.uint64((1 << 20) - 1)
_rnd = np.random.default_rng(2024)
_BYTE = _rnd.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Kind:
    """How a text becomes symbols.  window and gram count symbols; gram is a power of two."""

    def __init__(self, words: bool, window: int, gram: int):
        self.words, self.window, self.gram = words, window, gram

    def hashes(self, text: bytes) -> np.ndarray:
        return hash_words(text.split()) if self.words else _BYTE[np.frombuffer(text, np.uint8)]

    def symbols(self, text: bytes):
        return text.split() if self.words else text

    def join(self, symbols) -> bytes:
        return b" ".join(symbols) if self.words else symbols


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size (a power of two) symbols."""
    step, factor = 1, B64
    while step < size:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor % (1 << 64)
    return h


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def least_grams(h: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """The minimizer of every window, and where it first occurs."""
    gram = mix64(grams(h, kind.gram))
    first = sliding_min((gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64), kind.window - kind.gram + 1)
    return first >> np.uint64(20), (first & _LOW).astype(np.int64)


class Segments:
    """Segments of texts laid end to end: start (of the first window), number of windows, minimizer, content hash, and
    whether the minimizer occurs twice in one of its windows."""

    def __init__(self, h: np.ndarray, ends: np.ndarray, kind: Kind):
        w, g = kind.window, kind.gram
        self.start = self.count = np.zeros(0, np.int64)
        self.key = self.content = np.zeros(0, np.uint64)
        self.twice = np.zeros(0, bool)
        if len(h) < w:
            return
        value, first = least_grams(h, kind)
        gram = mix64(grams(h, g))
        position = np.arange(len(gram), dtype=np.uint64)
        last = (_LOW - (sliding_min((gram & ~_LOW) | (_LOW - position), w - g + 1) & _LOW)).astype(np.int64)
        # windows that end in the text that they start in
        limit = np.repeat(ends, np.diff(ends, prepend=0))
        at = np.arange(len(value))
        valid = at + w <= limit[: len(value)]
        change = np.ones(len(value), bool)
        change[1:] = (value[1:] != value[:-1]) | ~valid[:-1]
        starts = np.flatnonzero(change & valid)
        if not len(starts):
            return
        stops = np.flatnonzero(np.r_[change[1:] | ~valid[1:], True] & valid) + 1
        # long runs, of periodic texts, are cut into as many windows as one occurrence of a minimizer can serve
        parts = -(-(stops - starts) // (w - g + 1))
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(starts, parts) + k * (w - g + 1)
        self.count = np.minimum(np.repeat(stops, parts) - self.start, w - g + 1)
        self.key = mix64(value[self.start])
        repeated = np.r_[0, np.cumsum(first != last)]
        self.twice = repeated[self.start + self.count] > repeated[self.start]
        # two overlapping blocks of half a content or more, and its length
        size = self.count + w - 1
        self.content = size.astype(np.uint64) * np.uint64(MIX2)
        block, hashed, factor, step = 1 << (w.bit_length() - 1), h, B64, 1
        while step < block:
            hashed = hashed[:-step] * np.uint64(factor) + hashed[step:]
            step, factor = 2 * step, factor * factor % (1 << 64)
        left = np.ones(len(size), bool)
        while left.any():
            now = left & (size < 2 * block)
            s, e = self.start[now], self.start[now] + size[now] - block
            self.content[now] += mix64(hashed[s]) * np.uint64(B64) + mix64(hashed[e] + np.uint64(1))
            left &= ~now
            if left.any():
                hashed = hashed[:-block] * np.uint64(factor) + hashed[block:]
                block, factor = 2 * block, factor * factor % (1 << 64)


_SEGMENTS = pa.schema([("ord", pa.int64()), ("sum", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("content", pa.int64()), ("twice", pa.bool_())])
SEGMENTS = "ord long, sum long, start long, n int, key long, content long, twice boolean"


def texts_with_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(f"`{key}`"), F.lit(LAST)).cast("long").alias("ord"), F.xxhash64(body).alias("sum"), F.col(f"`{key}`").cast("long").alias("doc_id"), body.alias("text"))


def segments(texts: DataFrame, kind: Kind) -> DataFrame:
    """A row per segment; ord and sum (a hash of the text) name the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[tuple] = []
            size = 0
            for order, total, raw in zip(*(b.column(k).to_pylist() for k in ("ord", "sum", "text"))):
                h = kind.hashes(raw)
                if len(h) < kind.window:
                    continue
                name = order, total
                for at in range(0, len(h) - kind.window + 1, SLICE):
                    piece = h[at : at + SLICE + kind.window - 1]
                    if parts and size + len(piece) > SLICE:
                        yield from emit(parts)
                        parts, size = [], 0
                    parts.append((*name, at, piece))
                    size += len(piece)
            if parts:
                yield from emit(parts)

    def emit(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(p[3]) for p in parts])
        s = Segments(np.concatenate([p[3] for p in parts]), ends, kind)
        owner = np.searchsorted(ends, s.start, side="right")
        base = np.r_[0, ends[:-1]]
        offset = np.array([p[2] for p in parts], np.int64)
        pick = lambda k: np.array([p[k] for p in parts], np.int64)[owner]
        yield batch(_SEGMENTS, pick(0), pick(1), s.start - base[owner] + offset[owner], s.count.astype(np.int32), s.key.view(np.int64), s.content.view(np.int64), s.twice)

    return texts.select("ord", "sum", "text").mapInArrow(run, SEGMENTS)


def release(df: DataFrame) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more."""
    import gc

    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


_CONTENT = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("least", pa.int64()), ("again", pa.bool_()), ("shard", pa.int64()), ("hot", pa.bool_()), ("body", pa.binary())])
CONTENT = "key long, content long, least long, again boolean, shard long, hot boolean, body binary"
_FOUND = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("runs", pa.binary()), ("later", pa.binary())])
FOUND = "key long, content long, runs binary, later binary"


def runs_of(mask: np.ndarray) -> bytes:
    """A mask of windows as (start, count) pairs of 32-bit integers."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] - edge[::2]], 1).astype("<i4").tobytes()


def repeated_windows(texts: DataFrame, kind: Kind, ordered: bool, shard: Callable[[list], list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(ord, sum, spans): per text the runs (first window, number of windows) of its repeated windows.

    ordered: only an occurrence in a text with a smaller ord counts, and the first text's own windows stay; else any
    second occurrence counts.  shard gets one shard's contents, (body, least ord, whether it has copies: with a larger ord, if
    ordered) each, and returns for each two masks of the repeated windows: at its first place and at its copies'.
    """
    bounded_batches(texts.sparkSession)
    all_segments = written(segments(texts, kind), "segments")

    stats = all_segments.groupBy("key").agg(F.min("ord").alias("o1"), F.max("ord").alias("o2"), F.count("*").alias("rows"), F.max("twice").alias("twice"))
    stats = stats.filter("o1 < o2" if ordered else "rows > 1 or twice").select("key")
    # stored, so that the join has an exchange of its own on either side, which Spark can split for a hot minimizer
    stats = written(stats, "stats")
    shared = written(all_segments.join(stats, "key").select("key", "content", "ord", "sum", "start", "n"), "shared")
    discard(all_segments, stats)
    release(texts)

    again = F.max("ord") > F.min("ord") if ordered else F.count("*") > 1
    contents = written(shared.groupBy("key", "content").agg(F.min(F.struct("ord", "sum", "start", "n")).alias("at"), again.alias("again")), "contents")
    # stored, like all that is joined to rows of a hot minimizer, so that Spark can split the join
    many = written(contents.groupBy("key").agg(F.count("*").alias("contents")).filter(F.col("contents") > MOST_CONTENTS).select("key", F.lit(True).alias("hot")), "many")
    size = contents.agg(F.sum((F.col("at.n") + kind.window) * F.when(F.col("again"), 2).otherwise(1))).first()[0] or 0
    shards = max(1, size * (7 if kind.words else 1) // SHARD_BYTES)
    placed = contents.join(many, "key", "left").select("at.*", "key", "content", "again", F.coalesce("hot", F.lit(False)).alias("hot"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    by_text = placed.groupBy("ord", "sum").agg(F.collect_list(F.struct("key", "content", "start", "n", "again", "shard", "hot")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for order, raw, wanted in zip(*(b.column(k).to_pylist() for k in ("ord", "text", "wanted"))):
                x = kind.symbols(raw)
                rows = [(w["key"], w["content"], order, w["again"], w["shard"], w["hot"], kind.join(x[w["start"] : w["start"] + w["n"] + kind.window - 1])) for w in wanted]
                for at in range(0, len(rows), 4096):
                    yield batch(_CONTENT, *zip(*rows[at : at + 4096]))

    # repeated rows of texts bring a content more than once; each user of bodies sees to that
    bodies = written(texts.select("ord", "sum", "text").join(by_text, ["ord", "sum"]).select("ord", "text", "wanted").mapInArrow(cut, CONTENT), "bodies")
    release(texts)

    def in_shard(group: pa.Table) -> pa.Table:
        x = group.sort_by([("least", "ascending"), ("key", "ascending"), ("content", "ascending")])
        key, content = x["key"].to_numpy(), x["content"].to_numpy()
        x = x.filter(pa.array(np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
        runs, later = zip(*((runs_of(one), runs_of(other)) for one, other in shard(list(zip(*(x[k].to_pylist() for k in ("body", "least", "again")))))))
        return pa.Table.from_arrays([x["key"].combine_chunks(), x["content"].combine_chunks(), pa.array(runs, pa.binary()), pa.array(later, pa.binary())], schema=_FOUND)

    # a task has TASK_SHARDS shards or so, however many there are
    tasks = max(2 * slots(texts.sparkSession), -(-shards // TASK_SHARDS))
    in_shards = bodies.filter("not hot").select("shard", "key", "content", "least", "again", "body").repartition(tasks, "shard").groupBy("shard").applyInArrow(in_shard, FOUND)

    hot, parts = divided(bodies.filter("hot").select("key", "content", "least", "body").dropDuplicates(["key", "content"]), kind, ordered)
    found = written(in_shards.union(hot), "found")
    release(texts)

    verdicts = written(contents.select("key", "content", F.col("at.ord").alias("first"), "again").join(found, ["key", "content"], "left"), "verdicts")
    judged = shared.join(verdicts, ["key", "content"])
    copy = F.col("ord") > F.col("first") if ordered else F.col("again")
    # null runs are whole segments: copies of a hot minimizer's contents, which no shard has.  Repeated rows of a text find
    # the same spans, which count once
    spans = judged.select("ord", "sum", "start", "n", F.when(copy, F.col("later")).otherwise(F.coalesce("runs", F.lit(b""))).alias("runs")).filter("runs is null or length(runs) > 0")
    out = written(spans.groupBy("ord", "sum").agg(F.collect_set(F.struct("start", "n", "runs")).alias("spans")), "spans")
    discard(shared, contents, many, bodies, found, verdicts, *parts)
    return out


_PARTS = pa.schema([("key", pa.int64()), ("content", pa.int64()), ("least", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("body", pa.binary()), ("core", pa.int64()), ("extent", pa.int64())])
PARTS = "key long, content long, least long, at int, low int, high int, body binary, core long, extent long"


def divided(bodies: DataFrame, kind: Kind, ordered: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(key, content, runs) of the repeated windows of distinct bodies, by halving parts of windows; and the tables
    in shared storage that it is read from.

    A part is the windows low to high of a body whose minimizer lies at one place (at) and whose distances to it lie
    in one aligned range.  All windows with distances in that range contain its core.  Equal windows are at equal
    distances, so they are in parts with equal cores at every width, down to one window.
    """
    width = 1 << ((kind.window - kind.gram + 1).bit_length() - 1)

    def parts(width: int, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    x = kind.symbols(r["body"])
                    if first:
                        _, place = least_grams(kind.hashes(r["body"]), kind)
                        cut = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)].tolist()
                        spans = [(int(place[a]), a, z) for a, z in zip(cut, cut[1:])]
                    else:
                        spans = [(r["at"], r["low"], r["high"])]
                    for at, low, high in spans:
                        while low < high:
                            base = (at - low) // width * width  # distances base to base + width - 1 make the part
                            stop = min(high, at - base + 1)
                            core = kind.join(x[at - base : at - base - width + 1 + kind.window])
                            extent = kind.join(x[low : stop - 1 + kind.window])
                            rows.append((r["key"], r["content"], r["least"], at, low, stop, r["body"], xxhash.xxh3_64_intdigest(b"%d %d %d " % (r["key"], base, width) + core) - (1 << 63), xxhash.xxh3_64_intdigest(b"%d %d " % (at - low, stop - low) + extent) - (1 << 63)))
                            low = stop
                for k in range(0, len(rows), 4096):
                    yield batch(_PARTS, *zip(*rows[k : k + 4096]))

        return run

    settled, tables = None, []
    rows = bodies.mapInArrow(parts(width, True), PARTS)
    while True:
        rows = written(rows, "parts")
        tables.append(rows)
        if settled is not None and rows.isEmpty():
            break
        # rows with one core and extent are of a kind: one of them goes on for all, the others are settled by it
        kinds = rows.groupBy("core", "extent").agg(F.min("least").alias("l1"), F.count("*").alias("many"), F.min(F.struct("key", "content", "at", "low")).alias("one"))
        groups = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("l1").alias("g1"), F.max("l1").alias("g2"))
        split = F.col("g1") < F.col("g2") if ordered else F.col("kinds") > 1
        # stored, so that Spark can split the join for a hot core
        judged = written(kinds.join(groups, "core").withColumn("split", split).filter("many > 1 or split").drop("g1", "g2", "kinds"), "kinds")
        tables.append(judged)
        seen = rows.join(judged, ["core", "extent"])
        done = seen.filter("many > 1 and least > l1" if ordered else "many > 1").select("key", "content", "low", "high")
        settled = done if settled is None else settled.union(done)
        if width == 1:
            break
        width //= 2
        goes_on = F.col("least") == F.col("l1") if ordered else F.struct("key", "content", "at", "low") == F.col("one")
        mixed = seen.filter(F.col("split") & goes_on).select("key", "content", "least", "at", "low", "high", "body")
        rows = mixed.mapInArrow(parts(width, False), PARTS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column("places").to_pylist():
                mask = np.zeros(max(x["high"] for x in places), bool)
                for x in places:
                    mask[x["low"] : x["high"]] = True
                out.append(runs_of(mask))
            yield batch(_FOUND, b.column("key"), b.column("content"), out, [None] * len(out))

    found = settled.groupBy("key", "content").agg(F.collect_list(F.struct("low", "high")).alias("places")).mapInArrow(packed, FOUND)
    return found, tables


def covered(spans: list[dict], size: int, window: int) -> np.ndarray:
    """The mask of a text's symbols that its repeated windows cover."""
    edge = np.zeros(size + 1, np.int32)
    for s in spans:
        pieces = ((0, s["n"]),) if s["runs"] is None else np.frombuffer(s["runs"], "<i4").reshape(-1, 2).tolist()
        for a, n in pieces:
            edge[s["start"] + a] += 1
            edge[s["start"] + a + n + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_spans(texts: DataFrame, spans: DataFrame, finish: Callable[[bytes, list], tuple], schema: pa.Schema, columns: str) -> DataFrame:
    """finish(text, spans) makes a row's columns after doc_id, for every row of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [finish(raw, spans or []) for raw, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield batch(schema, b.column("doc_id"), *(zip(*rows) if rows else [[]] * (len(schema) - 1)))

    return texts.join(spans, ["ord", "sum"], "left").select("doc_id", "text", "spans").mapInArrow(run, columns)

"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by tiled exact comparison.

Distinct fingerprints are dealt into tables by pigeonhole: of k bit blocks, radius r leaves k - r of them equal in
any linked pair, so the pair meets in the bucket of such a choice of blocks.  k grows with the number of
fingerprints, so that a bucket stays small; every k finds every link.  Within a bucket, fingerprints sorted by
population count form tiles, tile pairs whose counts differ by more than the radius are skipped, and the rest are
compared exactly by exclusive-or and bit counts in numpy.  Tiles are linked within themselves first; pairs of tiles
then compare only what isn't one component already, and hand over a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import B64, PLACE_FILE, PLACE_ROW, batch, bounded_batches, bounds_of, columns_of, discard, mix64, placed, slots, table, texts_of, written
from .components import HELD, components, edge_batch, forest

SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile, and in a bucket on average before the number of blocks grows.
TILE, BUCKET = 2048, 1024
#: Rows of one component that fill so much of a tile get tiles of their own.
OWN_TILE = 0.25
#: Comparisons that one numpy call makes at once.
CELLS = 1 << 19

_PRINTS = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a whole text, repeats included; of all words if they are fewer than a shingle."""
    words = text.translate(_LOWER).split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: len(words) - size] + 1].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:z], seed) for a, z in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of h, as a signed 64-bit integer."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of a whole text; 0 for a text without words."""
    return majority(shingle_hashes(text, size, seed))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, print), a row per input row, map-side only.  Null texts have no words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(_PRINTS, b.column(0), [fingerprint(x, size, seed) for x in b.column(1).to_pylist()])

    return texts_of(docs, key, text).mapInArrow(run, "doc_id long, print long")


def masks_of(blocks: int, radius: int) -> list[int]:
    """The bit masks of all choices of blocks - radius of so many blocks of 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, blocks - radius)]


def blocks_for(n: int, radius: int, bucket: int = BUCKET) -> int:
    """The fewest blocks for which n spread fingerprints leave at most so many to a bucket (radius + 4 at most)."""
    for k in range(radius + 1, radius + 4):
        if n <= bucket << (64 * (k - radius) // k):
            return k
    return radius + 4


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def counts_of(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints).sum(axis=1, dtype=np.int64)


def link_tiles(left: tuple, right: tuple, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of what the links between two tiles (or within one) join.

    A tile is (names, fingerprints as rows of 64-bit words), sorted by population count.  Rows of one name are joined
    already, so at most one link is handed over for each pair of names that it joins.
    """
    (names, x), (other_names, y) = left, right
    counts, other_counts = counts_of(x), counts_of(y)
    found: list[tuple[int, int]] = []
    rows = max(1, CELLS // max(1, len(y)))
    words = x.shape[1]
    for at in range(0, len(x), rows):
        a = np.searchsorted(other_counts, counts[at] - radius)
        z = np.searchsorted(other_counts, counts[min(len(x), at + rows) - 1] + radius, side="right")
        if a == z:
            continue
        apart = np.bitwise_count(x[at : at + rows, None, 0] ^ y[None, a:z, 0])
        for k in range(1, words):
            apart = np.add(apart, np.bitwise_count(x[at : at + rows, None, k] ^ y[None, a:z, k]), dtype=np.uint16)
        i, j = np.nonzero(apart <= radius)
        i, j = i + at, j + a
        if same:
            i, j = i[i < j], j[i < j]
        p, q = names[i], other_names[j]
        p, q = p[p != q], q[p != q]
        if len(p):
            found = forest([*found, *zip(p.tolist(), q.tolist())])
    return found


def tile_of(names: np.ndarray, prints: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A tile from a column of names and a column of lists of words."""
    x = prints.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(names), -1)
    order = np.argsort(counts_of(x), kind="stable")
    return names[order], x[order]


def linked(members: DataFrame, payload: DataFrame, link: Callable[[pa.Table, pa.Table, bool], list[tuple[int, int]]], reach: Callable[..., Column]) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): edges over ids that connect what chains of links connect; and the tables in shared storage that they are read from.

    members: key, id, measure and load (a row's share of a tile), distinct in (key, id); payload: id and what link
    looks at.  link gets one tile twice, or two tiles, with the names of their rows, and returns edges between names.
    reach says whether the measures (x_low, x_high, y_low, y_high) of two tiles leave a link possible.

    Each key's rows are first cut into tiles by hash, which are linked within themselves.  Where a key has more than
    one tile, rows then take the names of their components, and rows of one name make tiles of their own where they
    are many.  Tiles meet in pairs, one task for each; two tiles of one name needn't, nor any that reach rules out.
    So a large group of copies is compared with itself once per tile, and its edges are never more than its rows.
    """
    spark = members.sparkSession
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("load").alias("total"), F.bit_xor(F.xxhash64("id")).alias("who")).filter("n > 1")
    # keys that the very same ids have are compared once
    sizes = written(buckets.groupBy("n", "who").agg(F.min(F.struct("key", "total")).alias("one")).select("one.key", "one.total", "n"), "buckets")
    spread = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    held = members.join(sizes.select("key", F.ceil("total").alias("tiles")), "key")
    first = held.select("key", "id", F.floor(spread * F.col("tiles")).alias("tile"), F.col("id").alias("name")).join(payload, "id")
    rows = sizes.agg(F.sum("n"), F.max("total")).first()
    parts = int((rows[0] or 0) // 200_000 + 2 * slots(spark))
    columns = ["name", *(c for c in payload.columns if c != "id")]

    def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
        """Rows arrive sorted; one group is in memory at a time."""
        last, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
            cut = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
            bounds = [0, *cut.tolist(), b.num_rows]
            for a, z in zip(bounds, bounds[1:]):
                now = tuple(x[a] for x in at)
                if held and now != last:
                    yield pa.Table.from_batches(held)
                    held = []
                last = now
                held.append(b.slice(a, z - a))
        if held:
            yield pa.Table.from_batches(held)

    def edges_of(found: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for more in found:
            edges += more
            if len(edges) > 2 * HELD:
                edges = forest(edges)
                if len(edges) > HELD:
                    yield edge_batch(edges)
                    edges = []
        if edges:
            yield edge_batch(forest(edges))

    def in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from edges_of(link(x := g.select(columns).combine_chunks(), x, True) for g in groups(batches, ("key", "tile")) if g.num_rows > 1)

    def in_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def meet(g: pa.Table) -> list[tuple[int, int]]:
            side = [g.filter(pa.compute.equal(g["side"], k)).select(columns).combine_chunks() for k in (0, 1)]
            return link(side[0], side[0], True) if g["same"][0].as_py() else link(*side, False) if side[0].num_rows and side[1].num_rows else []

        yield from edges_of(map(meet, groups(batches, ("job",))))

    linked_once = first.repartition(parts, "key", "tile").sortWithinPartitions("key", "tile").mapInArrow(in_tiles, "a long, b long")
    if (rows[1] or 0) <= 1:
        return linked_once, [sizes]

    stars = components(linked_once)
    large = members.join(sizes.filter("total > 1").select("key"), "key").join(stars.select(F.col("b").alias("id"), "a"), "id", "left").select("key", "id", "measure", "load", F.coalesce("a", "id").alias("name"))
    named_rows = written(large, "named")
    own = written(named_rows.groupBy("key", "name").agg(F.sum("load").alias("s")).filter(F.col("s") >= OWN_TILE).select("key", "name", F.lit(True).alias("own")), "own")
    kept = named_rows.join(own, ["key", "name"], "left").withColumn("own", F.coalesce("own", F.lit(False))).withColumn("part", F.when(F.col("own"), F.col("name")).otherwise(F.lit(0)))
    counts = kept.groupBy("key", "own", "part", "measure").agg(F.sum("load").alias("s"))
    before = F.sum("s").over(Window.partitionBy("key", "own", "part").orderBy("measure")) - F.col("s")
    counts = written(counts.withColumn("before", before), "measures")
    tiled = kept.join(counts, ["key", "own", "part", "measure"]).select("key", "id", "name", "measure", F.struct("own", "part", F.floor(F.col("before") + spread * F.col("s")).alias("cut")).alias("tile"))
    kinds = written(tiled.groupBy("key", "tile").agg(F.min("measure").alias("low"), F.max("measure").alias("high")), "tiles")
    left, right = (kinds.select("key", F.col("tile").alias(s), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high")) for s in "xy")
    one_name = F.col("x.own") & F.col("y.own") & (F.col("x.part") == F.col("y.part"))
    # names of tiles in pairs, not rows
    pairs = left.join(right, "key").filter((F.col("x") <= F.col("y")) & ~one_name & reach("x_low", "x_high", "y_low", "y_high")).select("key", "x", "y", F.xxhash64("key", "x", "y").alias("job"))
    sides = pairs.select("key", "job", F.col("x").alias("tile"), F.lit(0).alias("side"), (F.col("x") == F.col("y")).alias("same")).union(pairs.filter("x <> y").select("key", "job", F.col("y").alias("tile"), F.lit(1).alias("side"), F.lit(False).alias("same")))
    work = tiled.join(sides, ["key", "tile"]).select("job", "side", "same", "id", "name").join(payload, "id")
    across = work.repartition(parts, "job").sortWithinPartitions("job").mapInArrow(in_pairs, "a long, b long")
    return stars.union(across), [sizes, stars, named_rows, own, counts, kinds]


def links(rows: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, list[DataFrame]]:
    """Edges, as linked() gives them, for rows with a common key and fingerprints within the radius.

    rows: id (long, distinct), print (array of longs), keys (array of longs).  Only ids and keys move until it is known
    which of them share a bucket.
    """
    pop = F.aggregate("print", F.lit(0), lambda n, x: n + F.bit_count(x))
    members = rows.select("id", pop.alias("measure"), F.lit(1.0 / TILE).alias("load"), F.explode(F.array_distinct("keys")).alias("key"))

    def link(x: pa.Table, y: pa.Table, same: bool) -> list[tuple[int, int]]:
        left = tile_of(x["name"].to_numpy(), x["print"].combine_chunks())
        return link_tiles(left, left if same else tile_of(y["name"].to_numpy(), y["print"].combine_chunks()), radius, same)

    def reach(x_low: str, x_high: str, y_low: str, y_high: str) -> Column:
        return (F.col(y_low) - F.col(x_high) <= radius) & (F.col(x_low) - F.col(y_high) <= radius)

    return linked(members, rows.select("id", "print"), link, reach)


def pigeonhole_keys(n: int, radius: int) -> Column:
    """Keys for a 64-bit column print: those of fingerprints within the radius have one in common."""
    masks = [signed(m) for m in masks_of(blocks_for(n, radius), radius)]
    return F.array(*(F.xxhash64(F.lit(t), F.col("print").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, print, component_id) per input row; component_id is the smallest doc_id reachable through links.

    Texts without words (null, empty, blank) all have fingerprint 0 and so are one component.  Rows with a null key
    take part in links; a component of nothing but null keys has a null component_id.  Repeated rows each come
    back.  Exact copies meet as one fingerprint.  An empty table gives an empty result; other columns are ignored.
    """
    prints = written(fingerprints(docs, key, text, size, seed), "prints")
    least = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    rows = least.select(F.col("print").alias("id"), F.array("print").alias("print"), pigeonhole_keys(least.count(), radius).alias("keys"))
    edges, tables = links(rows, radius)
    names, more = named(least.select(F.col("print").alias("id"), "least"), edges)
    out = written(prints.join(names, F.col("print") == F.col("id")).select("doc_id", "print", "component_id"), "components")
    discard(prints, least, more, *tables)
    return out


def named(least: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, component_id): the smallest of the column least in the component of each id; and a table that it is read from."""
    found = components(edges)
    root = least.join(found.select(F.col("b").alias("id"), F.col("a").alias("root")), "id", "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    # stored, so that Spark can split the join for a large component
    ids = written(root.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    return root.select("id", "root").join(ids, "root").select("id", "component_id"), found


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


#: Near copies by similarity: texts whose sets of five-word shingles have at least the share NEAR_SHARE (4 / 5) of their union in common.
#: Fingerprints of so many 64-bit words only choose what is compared: those within NEAR_RADIUS bits.  Texts of Jaccard
#: similarity 0.8 differ in 77 bits of 512 on average, with a deviation of 8; sets of four and five in 96 with 9.
NEAR_SHINGLE_WORDS, NEAR_PARTS, NEAR_RADIUS = 5, 8, 140
NEAR_SHARE = 4, 5
#: Keys of a text: its so many least shingle hashes.  Texts of similarity 0.8 lack a common one once in 15,000 or so.
NEAR_KEYS = 6
#: Texts and shingle hashes (8 bytes each) on one side of an exact comparison.
SIDE_ROWS, SIDE_HASHES = 4096, 2_000_000
#: A shingle that so many texts of a side have is counted in a matrix of bits, a rarer one in lists.
COMMON = 64

_OFFSETS = np.array([B64 * k % (1 << 64) for k in range(NEAR_PARTS)], np.uint64)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("wide", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("n", pa.int64())])
SKETCH = "doc_id long, file long, row long, id long, wide array<long>, keys array<long>, n long"
_SETS = pa.schema([("id", pa.int64()), ("set", pa.binary())])


def near_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, NEAR_SHINGLE_WORDS))


def near_sketch(h: np.ndarray) -> tuple[list[int], list[int]]:
    """The wide fingerprint and the keys of a text's set; a text without words has zeros and the key 0."""
    total = np.zeros(64 * NEAR_PARTS, np.int64)
    for at in range(0, len(h), 255):  # sums that fit a byte
        words = mix64(h[at : at + 255, None] + _OFFSETS[None, :]).astype("<u8")
        total += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    parts = np.packbits(2 * total > len(h), bitorder="little").view("<i8").tolist()
    return parts, np.sort(mix64(h + np.uint64(1)))[:NEAR_KEYS].view(np.int64).tolist() or [0]


class Side:
    """Sets on one side of an exact comparison.  shared(set) counts what a set has in common with each of them: shingles that
    many of them have by bit counts of a matrix, all others by an inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(h) for h in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.terms, number, many = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        common = many > COMMON
        self.width = 64 * -(-int(common.sum()) // 64)
        self.place = np.where(common, np.cumsum(common) - 1, -1)
        at = bounds_of(self.sizes)
        self.bits = np.stack([self._row(number[a:z]) for a, z in zip(at, at[1:])])
        rare = ~common[number]
        order = np.argsort(number[rare], kind="stable")
        self.holders = owner[rare][order]
        self.starts = bounds_of(np.where(common, 0, many))

    def _row(self, numbers: np.ndarray) -> np.ndarray:
        row = np.zeros(self.width, np.uint8)
        at = self.place[numbers]
        row[at[at >= 0]] = 1
        return np.packbits(row, bitorder="little").view(np.uint64)

    def shared(self, h: np.ndarray, among: np.ndarray) -> np.ndarray:
        """What the set h has in common with each of the sets among."""
        if not len(self.terms):
            return np.zeros(len(among), np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        at = at[self.terms[at] == h]
        many = self.starts[at + 1] - self.starts[at]
        place = np.arange(many.sum()) - np.repeat(bounds_of(many)[:-1], many) + np.repeat(self.starts[at], many)
        out = np.bincount(self.holders[place], minlength=len(self.sets))[among]
        if self.width:
            out += np.bitwise_count(self.bits[among] & self._row(at)).sum(axis=1, dtype=np.int64)
        return out


def link_similar(names: np.ndarray, own: list[np.ndarray], other_names: np.ndarray, others: list[np.ndarray], same: bool) -> list[tuple[int, int]]:
    """A spanning forest of what the links between two sides (or within one) join: pairs of similar sets, compared exactly.

    Rows of one name are joined already and aren't compared.
    """
    side = Side(others)
    sizes = np.array([len(h) for h in own], np.int64)
    label, at = np.unique(np.concatenate([names, other_names]), return_inverse=True)
    root = np.arange(len(label))  # of names that are joined, the least place
    mine, theirs = at[: len(names)], at[len(names) :]
    part, whole = NEAR_SHARE
    found: list[tuple[int, int]] = []
    for i in range(len(own)):
        now = root[mine[i]]
        j = np.flatnonzero((root[theirs] != now) & (whole * np.minimum(sizes[i], side.sizes) >= part * np.maximum(sizes[i], side.sizes)))
        if not len(j):
            continue
        shared = side.shared(own[i], j)
        j = j[whole * shared >= part * (sizes[i] + side.sizes[j] - shared)]
        if len(j):
            joined = np.unique(root[theirs[j]])
            found += [(int(label[now]), int(label[k])) for k in joined]
            root[np.isin(root, joined)] = now
    return found


def similar_links(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges, as linked() gives them, for rows with a common key and similar sets.

    rows: key, id (long, distinct), n (size of the set), set (binary: sorted unsigned 64-bit hashes).
    """
    load = F.lit(1.0 / SIDE_ROWS) + F.col("n") / F.lit(float(SIDE_HASHES))
    part, whole = NEAR_SHARE

    def link(x: pa.Table, y: pa.Table, same: bool) -> list[tuple[int, int]]:
        sets = lambda t: [np.frombuffer(s, np.uint64) for s in t["set"].to_pylist()]
        own = sets(x)
        return link_similar(x["name"].to_numpy(), own, y["name"].to_numpy(), own if same else sets(y), same)

    def reach(x_low: str, x_high: str, y_low: str, y_high: str) -> Column:
        return (F.col(x_high) * whole >= F.col(y_low) * part) & (F.col(y_high) * whole >= F.col(x_low) * part)

    return linked(rows.select("key", "id", F.col("n").alias("measure"), load.alias("load")), rows.select("id", "set"), link, reach)


def near_groups(held: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """For docs with places (see placed()): (doc_id, file, row, id) per row, where id stands for a text's set of shingles;
    (id, root) for each id that is linked to a smaller one; and the tables that these are read from."""
    bounded_batches(held.sparkSession)
    source = texts_of(held, key, text, PLACE_FILE, PLACE_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1).to_pylist():
                h = near_set(x)
                rows.append((signed(xxhash.xxh64_intdigest(h.tobytes())), *near_sketch(h), len(h)))
            yield batch(_SKETCH, b.column(0), b.column(2), b.column(3), *(zip(*rows) if rows else [[]] * 4))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                yield batch(_SETS, part.column(0), [near_set(x).tobytes() for x in part.column(1).to_pylist()])

    prints = written(source.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SKETCH), "prints")
    distinct = written(prints.groupBy("id").agg(F.min(F.struct("file", "row")).alias("at"), *(F.first(c).alias(c) for c in ("wide", "keys", "n"))), "distinct")
    edges, tables = links(distinct.select("id", F.col("wide").alias("print"), "keys"), NEAR_RADIUS)
    close = components(edges)
    # what is in a component of fingerprints is compared exactly, one text for each set; what a join looks up here grows
    # with the corpus, so it is never broadcast, whatever its size
    met = written(close.select(F.col("a").alias("id"), F.col("a").alias("key")).union(close.select(F.col("b").alias("id"), F.col("a").alias("key"))).distinct().join(distinct.select("id", "at", "n"), "id").select("key", "id", "n", F.col("at.file").alias("file"), F.col("at.row").alias("row")), "met")
    moved = source.select(F.col(f"`{PLACE_FILE}`").alias("file"), F.col(f"`{PLACE_ROW}`").alias("row"), "text").join(met.select("file", "row", "id").hint("merge"), ["file", "row"])
    sets = written(moved.select("id", "text").mapInArrow(sets_of, "id long, set binary"), "sets")
    similar, more = similar_links(met.join(sets, "id").select("key", "id", "n", "set"))
    found = components(similar)
    discard(distinct, close, met, sets, *tables, *more)
    return prints.select("doc_id", "file", "row", "id"), found.select(F.col("b").alias("id"), F.col("a").alias("root")), [prints, found]


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) per input row: the smallest doc_id reachable through links.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles (of all words, where they are
    fewer) is 0.8 or more, which is computed exactly on 64-bit hashes of shingles.  Compared are texts that chains of
    wide fingerprints within NEAR_RADIUS bits connect, of which each pair has a key in common.
    Texts without words are one group.  Nulls, ties and repeated rows as in simhash_components.
    """
    held, stored = placed(docs)
    rows, roots, tables = near_groups(held, key, text)
    roots = rows.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root"))
    # stored, so that Spark can split the join for a large component
    least = written(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    out = written(roots.join(least, "root").select("doc_id", "component_id"), "components")
    discard(least, *tables, *stored)
    return out


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies (see near_components), with all its columns.

    Of a group the row with the smallest id stays; one without an id only where no row of the group has one; of rows
    that tie the first by place in storage.  Rows are judged one by one: texts that share an id and aren't near copies
    all stay, repeated rows and texts without words (null, empty, blank) leave one.  An empty table stays empty.
    Further columns travel as they are, whatever their names.
    """
    held, _ = placed(docs)
    rows, roots, tables = near_groups(held, key, text)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    per_id = rows.groupBy("id").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    per_id = written(per_id, "firsts")
    per_root = written(per_id.groupBy("root").agg(F.min("first").alias("stays"), F.sum("copies").alias("rows")).filter("rows > 1").select("root", "stays"), "stays")
    # stored, so that Spark can split the joins for a large group
    others = written(per_id.join(per_root, "root").select("id", "stays"), "others")
    gone = written(rows.join(others, "id").filter(rank != F.col("stays")).select(F.col("file").alias(PLACE_FILE), F.col("row").alias(PLACE_ROW)), "gone")
    discard(per_id, per_root, others, *tables)
    return held.join(gone.hint("merge"), [PLACE_FILE, PLACE_ROW], "left_anti").select(columns_of(docs))

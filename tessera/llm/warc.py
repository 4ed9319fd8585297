"""WARC archives and an external merge of their capture index.

Pages become WARC records (gzip members) in archives in shared storage; equal payloads are stored once, by the page
with the smallest id, and revisited by the others.  Reading an archive back gives its captures, which are sorted
locally by URL key and timestamp: a run.  Merging has two levels.  A task reads some archives and merges their runs by
a loser tree into one; splitters cut it into slices of key ranges.  Each range's slices, one from every task, are then
merged by a loser tree.  Ranges follow one another, so the result is globally ordered.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, discard, shared_dir, slots, table, written

#: Captures in a key range, at most about; ranges are no fewer than the cluster's slots where that leaves this many.
RANGE_CAPTURES, LEAST_CAPTURES = 200_000, 500
#: Archives whose runs one task merges, at most; fewer where that would leave slots idle.
FAN_IN = 64
#: Keys that each archive offers as splitters, and those that the driver looks at, at most about.
RUN_KEYS, SAMPLE_KEYS = 64, 50_000
GZIP_LEVEL = 1
FIRST_DATE = datetime.datetime(2024, 1, 1)

_CAPTURES = pa.schema([("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("archive_offset", pa.int64())])
_HISTORY = pa.schema([*_CAPTURES, ("key_range", pa.int32()), ("place", pa.int64())])
HISTORY = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, archive_offset long, key_range int, place long"
_KEY = ("urlkey", "timestamp", "page_id")


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def url_key(url: str | None) -> str:
    """Host labels from the top down, then path and query in lower case: com,example)/path?q."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.lower()
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return (",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{query}" if query else "")).lower()


def date_of(page_id: int | None) -> datetime.datetime:
    """Captures have no dates of their own; page ids count seconds."""
    return FIRST_DATE + datetime.timedelta(seconds=(page_id or 0) % 1_000_000_000)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC record.  A revisit has the HTTP header alone, which still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisits else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date_of(page_id):%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if page_id is not None:
        head.append(f"WARC-Page-Id: {page_id}")
    if revisits:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream, size: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; one member is in memory at a time."""
    base, rest, at = 0, b"", 0
    while True:
        if not rest:
            rest = stream.read(size)
            if not rest:
                return
        unzip, parts, at = zlib.decompressobj(31), [], base
        while True:
            parts.append(unzip.decompress(rest))
            base += len(rest) - len(unzip.unused_data)
            rest = unzip.unused_data
            if unzip.eof:
                break
            rest = stream.read(size)
            if not rest:
                raise ValueError(f"archive ends inside the record at {at}")
        yield at, b"".join(parts)


def parse(raw: bytes) -> dict:
    """A record's fields by lower-case name, with "block" as bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields | {"block": rest[: int(fields["content-length"])]}


def capture(fields: dict) -> tuple:
    """Page id, payload length and digest, type, referred page, URL key and timestamp.  A stored payload is checked."""
    http, _, payload = fields["block"].partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        size = len(payload)
        if digest_of(payload) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    else:
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    number = lambda k: int(fields[k]) if k in fields else None
    return url_key(fields.get("warc-target-uri")), re.sub(r"\D", "", fields["warc-date"]), number("warc-page-id"), size, digest, kind, number("warc-refers-to-page-id")


def sort_key(c: tuple) -> tuple:
    return c[0], c[1], c[2] is None, c[2] or 0


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so that a step replays one path."""

    def __init__(self, runs: list[Iterator], key=sort_key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(len(self.runs)):
            self._advance(i)
        self.tree = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _advance(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, i: int, j: int) -> bool:
        """An exhausted run loses; of equal keys the earlier run wins."""
        a, b = self.keys[i], self.keys[j]
        return a is not None and (b is None or a < b or a == b and i < j)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(b, a):
            a, b = b, a
        self.tree[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.runs and self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self._advance(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.winner = i


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes an archive per partition below folder (a URI in shared storage); a manifest row for each archive."""
    spark = pages.sparkSession
    bounded_batches(spark)
    # written, since row numbers hold within one evaluation only
    source = written(pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload")).withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.unhex(F.sha1("payload"))), "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = source.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    # stored, so that Spark can split the join for a payload that very many pages have; a payload that occurs once stays out;
    # repeated payloads grow with the pages, so they aren't broadcast, whatever their number
    firsts = written(firsts.filter("n > 1").drop("n"), "firsts")
    joined = source.join(firsts.hint("merge"), "digest", "left").select("page_id", "url", "payload", F.coalesce((F.length("payload") >= least_bytes) & (F.col("first.row") != F.col("row")), F.lit(False)).alias("revisits"), F.col("first.page_id").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        keys, n, size = [], 0, 0
        out = None
        for b in batches:
            for page_id, address, payload, revisits, refers in zip(*(c.to_pylist() for c in b.columns)):
                out = out or fs.open_output_stream(f"{path}/.{name}")
                zipped = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                raw = zipped.compress(record(page_id, address, payload, bool(revisits), refers)) + zipped.flush()
                out.write(raw)
                keys.append((url_key(address), f"{date_of(page_id):%Y%m%d%H%M%S}", page_id))
                n, size = n + 1, size + len(raw)
                if len(keys) >= 4096 * RUN_KEYS:
                    keys = sorted(keys, key=sort_key)[:: 2]
        if out:
            out.close()
            fs.move(f"{path}/.{name}", f"{path}/{name}")
            keys.sort(key=sort_key)
            step = max(1, len(keys) // RUN_KEYS)
            schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("keys", pa.list_(pa.struct([(k, pa.int64() if k == "page_id" else pa.string()) for k in _KEY])))])
            yield batch(schema, [f"{folder}/{name}"], [n], [size], [[dict(zip(_KEY, x)) for x in keys[step // 2 :: step]]])

    manifest = written(joined.mapInArrow(run, "archive string, records long, bytes long, keys array<struct<urlkey:string,timestamp:string,page_id:long>>"), "manifest")
    discard(source, firsts)
    return manifest


def splitters_of(manifest: DataFrame, ranges: int) -> list[tuple]:
    """Keys that cut all captures into about equal ranges, from a bounded number of keys.  They only balance work."""
    n = manifest.count()
    part = min(1.0, SAMPLE_KEYS / max(1, n * RUN_KEYS))
    rows = manifest.filter(F.pmod(F.xxhash64("archive"), F.lit(1 << 20)) < part * (1 << 20)).select(F.explode("keys").alias("k")).select("k.*")
    keys = sorted(map(sort_key, map(tuple, rows.limit(2 * SAMPLE_KEYS).collect())))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def capture_history(manifest: DataFrame) -> DataFrame:
    """Every capture of the archives, globally ordered by (key_range, place), which is by URL key, timestamp and page id."""
    spark = manifest.sparkSession
    total = manifest.agg(F.sum("records"), F.count("*")).first()
    records, archives = total[0] or 0, total[1]
    ranges = max(1, -(-records // RANGE_CAPTURES), min(4 * slots(spark), records // LEAST_CAPTURES))
    cuts = spark.sparkContext.broadcast(splitters_of(manifest, ranges))
    sliced = pa.schema([("key_range", pa.int32()), ("run", pa.string()), ("slice", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The archives of a task, each a sorted run, merged and cut into slices."""
        held = []
        for b in batches:
            for archive in b.column(0).to_pylist():
                fs, path = file_system(archive)
                with fs.open_input_stream(path) as f:
                    held.append(sorted(((*capture(parse(raw)), archive, at) for at, raw in members(f)), key=sort_key))
                if len(held) == FAN_IN:
                    yield from slices(held)
                    held = []
        if held:
            yield from slices(held)

    def slices(held: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        name = held[0][0][-2]
        part, at, ends = [], 0, [*cuts.value, None]
        for c in LoserTree([iter(r) for r in held]):
            while ends[at] is not None and sort_key(c) >= ends[at]:
                yield from slice_of(at, name, part)
                part, at = [], at + 1
            part.append(c)
        yield from slice_of(at, name, part)

    def slice_of(k: int, name: str, part: list[tuple]) -> Iterator[pa.RecordBatch]:
        if part:
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, _CAPTURES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch(_CAPTURES, *zip(*part)))
            yield batch(sliced, [k], [name], [sink.getvalue()])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("run")

        def rows(blob: bytes) -> Iterator[tuple]:
            for part in pa.ipc.open_stream(blob):
                yield from zip(*(c.to_pylist() for c in part.columns))

        merged = list(LoserTree([rows(x) for x in group["slice"].to_pylist()]))
        columns = list(zip(*merged)) if merged else [[]] * len(_CAPTURES)
        return pa.Table.from_batches([batch(_HISTORY, *columns, [group["key_range"][0].as_py()] * len(merged), range(len(merged)))])

    fan = max(1, min(FAN_IN, archives // (2 * slots(spark))))
    spread = manifest.select("archive").repartition(max(1, -(-archives // fan)))
    return spread.mapInArrow(runs, "key_range int, run string, slice binary").groupBy("key_range").applyInArrow(merge, HISTORY)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as WARC archives, reads them back, and returns the ordered capture history, a row per page.

    A null html is an empty payload; a null URL has no target and the key "-"; a null page id stays null and comes
    after all others where the smallest is looked for.  Of repeated rows one is the response, the others revisit it.
    Payloads shorter than least_bytes are always stored.  An empty table has no archive and an empty history.
    Further columns of pages are ignored.  A payload of any length is one record.
    """
    return capture_history(write_archives(pages, folder or shared_dir(pages.sparkSession, "warc"), least_bytes, key, url, html))


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "timestamp")

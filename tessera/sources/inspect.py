"""Inspection: what files hold, as DataFrames of files, row groups, chunks and pages, with totals and reports.

Footers, page indexes and page headers are read by the executors, a task for some files each, so that a dataset of many
files is inspected in parallel; what they list comes in batches of BATCH_ROWS rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Type, to_dict, type_of
from .footer import decode, files_of, opened, raw_value
from .thrift import ROW_GROUPS, Decoder

CHUNKS = "file string, row_group int, column string, physical string, logical string, codec string, encodings array<string>, values long, nulls long, compressed long, uncompressed long, data_offset long, dictionary_offset long, low string, high string, has_index boolean, rows long, created_by string"
HEADERS = "file string, row_group int, column string, page int, kind string, offset long, header int, compressed int, uncompressed int, values int, encoding string, checksum string"
#: Names of the format's page types and encodings (fixed values).
PAGE_KINDS = {0: "data", 1: "index", 2: "dictionary", 3: "data v2"}
PAGE_ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
BATCH_ROWS = 10_000
PAGES = "file string, row_group int, column string, page int, first_row long, rows long, offset long, size long, nulls long, low string, high string"


def _shown(v: Any) -> str | None:
    return None if v is None else v.hex() if isinstance(v, bytes) else str(v)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), schema)], schema=schema)


def _file(path: str):
    """An open file, for the executors."""
    import pyarrow.fs

    fs, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(name)


def leaf_of(c) -> Type:
    """The type of a leaf of Arrow's Parquet schema, as footer.Footer has it."""
    note = json.loads(c.logical_type.to_json())
    name = note["Type"]
    if name == "Int":
        return Type("int", bits=note["bitWidth"], signed=note["isSigned"])
    if name == "Decimal":
        return Type("decimal", precision=note["precision"], scale=note["scale"])
    if name in ("Timestamp", "Time"):
        return Type(name.lower(), unit=note["timeUnit"].replace("seconds", "s"), utc=note["isAdjustedToUTC"])
    if name == "Float16":
        return Type("float", bits=16)
    if name in ("String", "Enum", "JSON", "BSON", "Date", "UUID"):
        return Type(name.lower())
    if name not in ("None", "Undefined") or c.converted_type == "INTERVAL":
        return Type("other", name=name.lower())
    if c.physical_type == "FIXED_LEN_BYTE_ARRAY":
        return Type("fixed", length=c.length)
    return type_of({"INT32": "int32", "INT64": "int64", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "INT96": "int96", "BYTE_ARRAY": "binary"}[c.physical_type])


def _listed(path: str) -> Iterator[tuple]:
    """The pages in a file's page index, a row of PAGES each."""
    import pyarrow.parquet as pq

    with _file(path) as f:
        schema = pq.read_metadata(f).schema
        leaves = [schema.column(k) for k in range(len(schema))]
        types = [leaf_of(c) for c in leaves]
        size = f.size()
        f.seek(size - 8)
        length = int.from_bytes(f.read(4), "little")
        f.seek(size - 8 - length)
        for g, group in enumerate(Decoder(f.read(length)).record()[ROW_GROUPS][1][1]):
            rows = group[3][1]
            for chunk, leaf, t in zip(group[1][1][1], leaves, types):
                try:
                    found = _pages_of(f, chunk, rows, leaf, t)
                except (ValueError, IndexError, KeyError, TypeError, OSError, struct.error):  # a damaged index lists nothing
                    continue
                for k, page in enumerate(found):
                    yield path, g, leaf.path, k, *page


def _pages_of(f, chunk: dict, rows: int, leaf, t: Type) -> list[tuple]:
    """(first row, rows, offset, size, nulls, low, high) of the pages of a chunk."""
    if 4 not in chunk:
        return []

    def record(at: int, size: int) -> dict:
        f.seek(chunk[at][1])
        return Decoder(f.read(chunk[size][1])).record()

    places = record(4, 5)[1][1][1]
    index = record(6, 7) if 6 in chunk and leaf.physical_type != "INT96" else None  # INT96 has no order, and so no bounds
    kind = leaf.physical_type
    shown = lambda raw: _shown(decode(raw_value(kind, raw), t))
    out = []
    for k, place in enumerate(places):
        first = place[3][1]
        n = (places[k + 1][3][1] if k + 1 < len(places) else rows) - first
        stats = (None, None, None)
        if index is not None:
            if index[1][1][1][k]:
                stats = (n, None, None)
            else:
                nulls = index[5][1][1][k] if 5 in index else None
                stats = (nulls, shown(index[2][1][1][k]), shown(index[3][1][1][k]))
        out.append((first, n, place[1][1], place[2][1], *stats))
    return out


def _bounds(s) -> tuple[Any, Any]:
    """Least and greatest value of a chunk; unknown for kinds that have no order (INT96)."""
    try:
        return (s.min, s.max) if s is not None and s.has_min_max else (None, None)
    except NotImplementedError:
        return None, None


class Inspector:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, files_of(spark, path)
        self._chunks: DataFrame | None = None

    def chunks(self) -> DataFrame:
        """A row for each column chunk."""
        if self._chunks is not None:
            return self._chunks
        paths = self._per_file()
        schema = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("physical", pa.string()), ("logical", pa.string()), ("codec", pa.string()), ("encodings", pa.list_(pa.string())), ("values", pa.int64()), ("nulls", pa.int64()), ("compressed", pa.int64()), ("uncompressed", pa.int64()), ("data_offset", pa.int64()), ("dictionary_offset", pa.int64()), ("low", pa.string()), ("high", pa.string()), ("has_index", pa.bool_()), ("rows", pa.int64()), ("created_by", pa.string())])

        def walk(path: str) -> Iterator[tuple]:
            import pyarrow.parquet as pq

            with _file(path) as f:
                meta = pq.read_metadata(f)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for k in range(group.num_columns):
                        c = group.column(k)
                        s = c.statistics if c.is_stats_set else None
                        low, high = _bounds(s)
                        yield (path, g, c.path_in_schema, c.physical_type, str(meta.schema.column(k).logical_type), c.compression, list(c.encodings), c.num_values, s.null_count if s is not None and s.has_null_count else None, c.total_compressed_size, c.total_uncompressed_size, c.data_page_offset, c.dictionary_page_offset, _shown(low), _shown(high), c.has_offset_index, group.num_rows, meta.created_by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    yield from _batches(walk(path), schema)

        self._chunks = paths.mapInArrow(run, CHUNKS)
        return self._chunks

    def row_groups(self) -> DataFrame:
        return self.chunks().groupBy("file", "row_group").agg(F.first("rows").alias("rows"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.count("*").alias("columns"))

    def summary(self) -> DataFrame:
        """A row for each file: rows, row groups, sizes, codecs, writer."""
        c = self.chunks()
        groups = c.groupBy("file", "row_group").agg(F.first("rows").alias("rows"))
        rows = groups.groupBy("file").agg(F.sum("rows").alias("rows"), F.count("*").alias("row_groups"))
        return c.groupBy("file").agg(F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"), F.array_sort(F.collect_set("codec")).alias("codecs"), F.max("created_by").alias("created_by"), F.max("has_index").alias("has_index")).join(rows, "file")

    def columns(self) -> DataFrame:
        """Totals by column: values, nulls, bytes, ratio, and the least and greatest statistics where all chunks have them.

        Bounds are compared as numbers where both are numbers, else as text.
        """
        c = self.chunks()
        number = F.col("physical").isin("INT32", "INT64", "FLOAT", "DOUBLE")
        low, high = (F.when(number, F.col(k).try_cast("double")) for k in ("low", "high"))
        return (
            c.groupBy("column", "physical")
            .agg(F.count("*").alias("chunks"), F.sum("values").alias("values"), F.sum("nulls").alias("nulls"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed"),
                 F.min_by("low", F.struct(low.alias("n"), F.col("low").alias("t"))).alias("low"), F.max_by("high", F.struct(high.alias("n"), F.col("high").alias("t"))).alias("high"))
            .withColumn("ratio", F.col("compressed") / F.col("uncompressed"))
        )

    def bloom_filters(self) -> list[tuple[str, int, str]]:
        """(file, row group, column) of every bloom filter."""
        out = []
        for path in self.files:
            with opened(self.spark, path) as f:
                out += [(path, g, c.getPath().toDotString()) for g, b in enumerate(f.blocks) for c in b.getColumns() if c.getBloomFilterOffset() > 0]
        return out

    def pages(self) -> DataFrame:
        """A row for each page that a page index lists."""
        schema = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("page", pa.int32()), ("first_row", pa.int64()), ("rows", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("nulls", pa.int64()), ("low", pa.string()), ("high", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    yield from _batches(_listed(path), schema)

        return self._per_file().mapInArrow(run, PAGES)

    def numbered(self, listed: DataFrame) -> DataFrame:
        """listed, with row groups counted over all files in their order, as Reader counts them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq

            for b in batches:
                for path in b.column(0).to_pylist():
                    with _file(path) as f:
                        yield pa.RecordBatch.from_pydict({"file": [path], "n": [pq.read_metadata(f).num_row_groups]})

        groups = {r.file: r.n for r in self._per_file().mapInArrow(run, "file string, n long").toLocalIterator()}
        before = accumulate((groups[f] for f in self.files), initial=0)
        first = self.spark.createDataFrame(list(zip(self.files, before)), "file string, before long")
        return listed.join(F.broadcast(first), "file").withColumn("row_group", F.col("row_group") + F.col("before")).drop("before")

    def mismatches(self) -> list[str]:
        """Where a page index contradicts its chunk: rows that don't add up, bounds beyond the chunk's."""
        out = []
        for path in self.files:
            with opened(self.spark, path) as f:
                for g, block in enumerate(f.blocks):
                    for column in f.leaves:
                        pages, s = f.pages(g, column), f.stats(g, column)
                        if not pages:
                            continue
                        at = f"{path}: row group {g}, column {column}"
                        if sum(p.rows for p in pages) != block.getRowCount():
                            out.append(f"{at}: pages have {sum(p.rows for p in pages)} of {block.getRowCount()} rows")
                        out += [f"{at}: page {n} reaches beyond the chunk's bounds" for n, p in enumerate(pages) if self._beyond(p.stats, s)]
                        known = [p.stats for p in pages if p.stats and p.stats.nulls is not None]
                        if s and s.nulls is not None and len(known) == len(pages) and sum(x.nulls for x in known) != s.nulls:
                            out.append(f"{at}: pages have {sum(x.nulls for x in known)} nulls, the chunk {s.nulls}")
        return out

    @staticmethod
    def _beyond(page, chunk) -> bool:
        """Whether a page's bounds lie outside its chunk's, where both are known and can be compared.  Bounds that were cut short
        aren't: a cut one is only below the least, or above the greatest value."""
        if not page or not chunk:
            return False
        short = lambda v: not isinstance(v, (str, bytes)) or len(v) < 16
        pairs = [(page.low, chunk.low, -1), (page.high, chunk.high, 1)]
        return any(a is not None and b is not None and short(a) and short(b) and (a < b if side < 0 else a > b) for a, b, side in pairs)

    def layout(self) -> DataFrame:
        """Byte ranges of chunks by file, with the gap before each."""
        from pyspark.sql import Window

        start = F.least("data_offset", F.coalesce("dictionary_offset", "data_offset"))
        w = Window.partitionBy("file").orderBy("start")
        return self.chunks().select("file", "row_group", "column", start.alias("start"), (start + F.col("compressed")).alias("end")).withColumn("gap", F.col("start") - F.coalesce(F.lag("end").over(w), F.lit(4)))

    def page_headers(self) -> DataFrame:
        """A row for each page, by the headers in the files: kind, place, sizes, values, encoding, and whether its checksum is
        "ok", a "mismatch" or "absent".  A file that can't be walked has one row with the kind "unreadable"."""
        schema = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("page", pa.int32()), ("kind", pa.string()), ("offset", pa.int64()), ("header", pa.int32()), ("compressed", pa.int32()), ("uncompressed", pa.int32()), ("values", pa.int32()), ("encoding", pa.string()), ("checksum", pa.string())])

        def walk(path: str) -> Iterator[tuple]:
            import pyarrow.parquet as pq

            with _file(path) as f:
                meta = pq.read_metadata(f)
                for g in range(meta.num_row_groups):
                    for k in range(meta.row_group(g).num_columns):
                        c = meta.row_group(g).column(k)
                        at = c.data_page_offset if not c.dictionary_page_offset else min(c.data_page_offset, c.dictionary_page_offset)
                        end, page = at + c.total_compressed_size, 0
                        while at < end:
                            f.seek(at)
                            head = f.read(min(end - at, 64 << 10))
                            d = Decoder(head)
                            h = d.record()
                            f.seek(at + d.at)
                            body = f.read(h[3][1])
                            if len(body) < h[3][1] or h[1][1] not in PAGE_KINDS:
                                raise ValueError("a page ends beyond its file")
                            crc = "absent" if 4 not in h else "ok" if h[4][1] % (1 << 32) == zlib.crc32(body) else "mismatch"
                            inner = next((h[n][1] for n in (5, 7, 8) if n in h), {})
                            encoding = inner.get(4 if 8 in h else 2, (0, None))[1]
                            yield path, g, c.path_in_schema, page, PAGE_KINDS[h[1][1]], at, d.at, h[3][1], h[2][1], inner.get(1, (0, None))[1], PAGE_ENCODINGS.get(encoding), crc
                            at, page = at + d.at + h[3][1], page + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    try:
                        found = list(_batches(walk(path), schema))  # whether a file can be walked shows at its end
                    except (ValueError, IndexError, OSError, KeyError):
                        found = list(_batches(iter([(path, None, None, None, "unreadable", *[None] * 7)]), schema))
                    yield from found

        return self._per_file().mapInArrow(run, HEADERS)

    def _per_file(self) -> DataFrame:
        return self.spark.createDataFrame([(f,) for f in self.files], "path string").repartition(max(1, min(len(self.files), 4 * self.spark.sparkContext.defaultParallelism)), "path")

    def checksum_tally(self) -> DataFrame:
        """A row for each status: how many pages have it."""
        return self.page_headers().groupBy(F.coalesce("checksum", "kind").alias("status")).agg(F.count("*").alias("pages"))

    def checksums(self) -> DataFrame:
        """A row for each file: a mismatch if any page has one, unreadable if its pages can't be walked, absent if none has a checksum, else ok."""
        bad, gone = F.count_if(F.col("checksum") == "mismatch"), F.count_if(F.col("kind") == "unreadable")
        status = F.when(gone > 0, "unreadable").when(bad > 0, "mismatch").when(F.count_if(F.col("checksum") == "ok") == 0, "absent").otherwise("ok")
        detail = F.when(bad > 0, F.concat(bad.cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(" pages")))
        return self.page_headers().groupBy("file").agg(status.alias("status"), detail.alias("detail"))

    def arrow_schema(self):
        """The Arrow schema that the first file carries or implies."""
        import pyarrow.fs
        import pyarrow.parquet as pq

        fs, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.files[0]))
        return pq.read_schema(name, filesystem=fs)

    def to_dict(self, pages: bool = False, verify: bool = False) -> dict:
        with opened(self.spark, self.files[0]) as f:
            schema, metadata = [to_dict(x) for x in f.schema.fields], f.metadata
        out = {"path": self.path, "schema": schema, "metadata": metadata}
        tables = {"files": self.summary().orderBy("file"), "row_groups": self.row_groups().orderBy("file", "row_group"), "columns": self.columns().orderBy("column"), "chunks": self.chunks().orderBy("file", "row_group", "data_offset")}
        if pages:
            tables["pages"] = self.pages().orderBy("file", "row_group", "offset")
        if verify:
            tables["checksums"] = self.checksums()
        return out | {k: [r.asDict(recursive=True) for r in t.collect()] for k, t in tables.items()}

    def to_json(self, **what: bool) -> str:
        return json.dumps(self.to_dict(**what), indent=2, default=str)

    def to_text(self, **what: bool) -> str:
        d = self.to_dict(**what)
        lines = [d["path"], "", "schema"]
        lines += [f"  {x['name']}: {x['kind']}{'' if x['nullable'] else ', required'}" for x in d["schema"]]
        for name in ("files", "row_groups", "columns", "pages", "checksums"):
            rows = d.get(name)
            if rows:
                lines += ["", name]
                keys = list(rows[0])
                cells = [keys, *([str(r[k]) if r[k] is not None else "-" for k in keys] for r in rows)]
                widths = [min(40, max(len(c[i]) for c in cells)) for i in range(len(keys))]
                lines += ["  " + "  ".join(c[i][:40].ljust(widths[i]) for i in range(len(keys))).rstrip() for c in cells]
        return "\n".join(lines) + "\n"

    def to_html(self, **what: bool) -> str:
        import html

        d = self.to_dict(**what)
        parts = ["<!DOCTYPE html><meta charset='utf-8'><title>", html.escape(d["path"]), "</title><style>body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}table{border-collapse:collapse}</style>"]
        for name in ("schema", "files", "row_groups", "columns", "chunks", "pages", "checksums"):
            rows = d.get(name)
            if rows:
                keys = list(dict.fromkeys(k for r in rows for k in r))
                parts += [f"<h2>{name}</h2><table><tr>", *(f"<th>{html.escape(k)}</th>" for k in keys), "</tr>"]
                parts += ["<tr>" + "".join(f"<td>{html.escape(str(r.get(k, '')))}</td>" for k in keys) + "</tr>" for r in rows]
                parts.append("</table>")
        return "".join(parts)

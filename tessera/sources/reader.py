"""Scans: projection, conditions, offset and limit over Parquet files, as DataFrames, rows, batches or NumPy arrays."""

from __future__ import annotations

import copy
import datetime
import json
import zoneinfo
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import DecryptionError, FormatError, MissingCodecError, TesseraError, UnsupportedError
from ..operators.filters import compile_where
from ..schema import Field, Schema, spark_type
from . import pruning
from .footer import Chunk, Stats, below, chunks_of, files_of, folder_of, one_slash, opened, partition_values, partitions_of, uri_of
from .keys import describe_all, install

BATCH_ROWS = 1024
#: A row's file and place in it, under names that no column has.
FILE, ROW = "place: file", "place: row"
#: Files whose footers are read one by one on the driver.
DRIVER_FILES = 16
#: Codecs that Spark's reader lacks.
UNREADABLE = {"LZO": UnsupportedError, "BROTLI": MissingCodecError}


def zone_of(zone: Any) -> datetime.tzinfo | None:
    """A zone from a tzinfo, an offset in seconds, "+02:00", "UTC" or a zone's name."""
    if zone is None or isinstance(zone, datetime.tzinfo):
        return zone
    if isinstance(zone, int) and not isinstance(zone, bool):
        return datetime.timezone(datetime.timedelta(seconds=zone))
    if isinstance(zone, str):
        if zone == "UTC":
            return datetime.UTC
        if len(zone) == 6 and zone[0] in "+-" and zone[3] == ":" and (zone[1:3] + zone[4:]).isdigit():
            sign = -1 if zone[0] == "-" else 1
            return datetime.timezone(sign * datetime.timedelta(hours=int(zone[1:3]), minutes=int(zone[4:])))
        try:
            return zoneinfo.ZoneInfo(zone)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError) as e:
            raise ValueError(f"no time zone {zone!r}") from e
    raise ValueError(f"no time zone {zone!r}")


def physical(f: Field) -> T.DataType:
    """The type that a column is read with, where that isn't the one it is returned with."""
    t = f.type
    if t.kind == "uuid" or t.kind == "float" and t.bits == 16 or t.kind == "decimal" and t.precision > 38:
        return T.BinaryType()
    return spark_type(t)


def logical(c: Column, f: Field) -> Column:
    t = f.type
    if t.kind == "uuid":
        h = F.lower(F.hex(c))
        return F.when(c.isNotNull(), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))
    if t.kind == "float" and t.bits == 16:
        return half_to_float(c)
    if t.kind == "decimal" and t.precision > 38:
        return F.udf(lambda v, s=t.scale: None if v is None else _wide(bytes(v), s), T.StringType())(c)
    return c


def _wide(raw: bytes, scale: int) -> str:
    import decimal

    return str(decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-scale, decimal.Context(prec=200)))


def half_to_float(c: Column) -> Column:
    """Two little-endian bytes of a 16-bit float as a float, in plain expressions."""
    n = F.conv(F.concat(F.hex(F.substring(c, 2, 1)), F.hex(F.substring(c, 1, 1))), 16, 10).cast("int")
    sign = F.when(F.shiftright(n, 15) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(n, 10).bitwiseAND(31), n.bitwiseAND(1023)
    value = F.when(exponent == 0, fraction * F.lit(2.0**-24)).when(exponent < 31, (F.lit(1.0) + fraction / 1024.0) * F.pow(F.lit(2.0), (exponent - 15).cast("double"))).when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * value).cast("float")


def declared(footer) -> Schema:
    """The schema that a file was written with, where our sink left it in the footer; else the file's own."""
    note = footer.metadata.get("org.apache.spark.sql.parquet.row.metadata")
    if not note:
        return footer.schema
    try:
        known = {f.name: f for f in Schema.from_spark(T.StructType.fromJson(json.loads(note))).fields}
    except (ValueError, KeyError):
        return footer.schema
    same = lambda f: f.name in known and known[f.name].nullable == f.nullable and spark_type(known[f.name].type).simpleString() == spark_type(f.type).simpleString()
    return Schema(known[f.name] if same(f) else f for f in footer.schema.fields)


class Reader:
    """A file, or a folder of files with one schema; folders below it named column=value give further columns.

    Reader(spark, path).read(columns=[...], where={...}, start=0, limit=None) is a DataFrame; rows(), batches(),
    arrays() and each_batch() bring results to the driver.  start counts rows of the input before the filter,
    limit those after it; both go by file order.  keys (a list or a function) opens encrypted files, which have one
    encryption throughout.
    """

    def __init__(self, spark: SparkSession, path: str, time_zone: Any = None, schema: Schema | None = None, folder: str | None = None, keys: Any = None):
        self.spark, self.path = spark, path
        self.zone = zone_of(time_zone)
        self.files = files_of(spark, path)
        if not self.files:
            raise FormatError(f"{path}: no Parquet file")
        #: The folder that partition columns start from.
        self.folder = folder or folder_of(spark, path)
        self.keys, self.secrets = keys, None
        told = self.files[0]  # the file whose chunks tell the codec, the bloom filters and the encryption of all
        if keys is not None:
            install(spark)
            told, self.secrets = describe_all(spark, self.files, keys)
            if self.secrets and (self.secrets.missing or self.secrets.unsigned):
                raise DecryptionError(f"{path}: no key for {', '.join(self.secrets.missing) or 'the footer'}; read_encrypted() reads what needs none")
        with opened(spark, told, self.secrets) as f:
            stored = f.schema
            relative = [below(x, self.folder) for x in self.files] if self.folder else []
            self.partitions = partitions_of(relative, stored.names)
            if schema is not None:
                known = {x.name: x for x in schema.fields}
                self.partitions = [known.get(x.name, x) for x in self.partitions]
            self.schema = schema or Schema([*declared(f).fields, *self.partitions])
            self.metadata, self.encrypted = f.metadata, f.encrypted
            hidden = [c for b in f.blocks for c in b.getColumns()] if self.secrets else []
            chunks = [Chunk(c.getPath().toDotString(), c.getCodec().toString(), any(e.toString() == "BYTE_STREAM_SPLIT" for e in c.getEncodings()), c.getBloomFilterOffset() > 0) for c in hidden]
        looked = 0
        if not self.secrets:
            for looked, x in enumerate(self.files, 1):  # a file may have no rows
                chunks = chunks_of(spark, x)
                if chunks:
                    break
        #: What a rewrite of these files keeps: their codec and the columns with bloom filters.
        self.codec = chunks[0].codec.lower() if chunks else "snappy"
        self.blooms = sorted({c.column for c in chunks if c.bloom})
        if not self.secrets and len(self.files) <= DRIVER_FILES:
            chunks += [c for x in self.files[looked:] for c in chunks_of(spark, x)]
        self._by_row = any(c.split for c in chunks)
        for c in chunks:
            if c.codec in UNREADABLE:
                raise UNREADABLE[c.codec](f"{path}: codec {c.codec.lower()} of column {c.column}")
        self._rows: list[int] | None = None
        names = {x.name: x for x in stored.fields}
        self._stored = [names.get(x.name, x) for x in self.schema.fields]

    def _footers(self):
        for f in self.files:
            with opened(self.spark, f, self.secrets) as footer:
                yield footer

    def rows_by_file(self) -> list[int]:
        """The rows of each file; of many files, counted by a job that reads no column."""
        if self._rows is None:
            if len(self.files) <= DRIVER_FILES:
                self._rows = [f.num_rows for f in self._footers()]
            else:
                counts = self.source().groupBy(F.col("_metadata.file_path").alias(FILE)).agg(F.count("*").alias("n"))
                found = {one_slash(r[0]): r[1] for r in counts.toLocalIterator()}
                self._rows = [found.get(uri_of(self.spark, f), 0) for f in self.files]
        return self._rows

    @property
    def num_rows(self) -> int:
        return sum(self.rows_by_file())

    @property
    def row_groups(self) -> list[int]:
        return [b.getRowCount() for f in self._footers() for b in f.blocks]

    def source(self) -> DataFrame:
        """All columns, with their logical types and our metadata, and the hidden _metadata of Spark's files."""
        conf = self.spark.conf
        conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        if self._by_row:
            conf.set("spark.sql.parquet.enableVectorizedReader", "false")
        fields = [T.StructField(f.name, physical(f), True) for f in self._stored]
        read = self.spark.read.schema(T.StructType(fields)).options(**(self.secrets.read_options() if self.secrets else {}))
        return (read.option("basePath", self.folder) if self.partitions else read).parquet(*self.files)

    def source_of(self, files: list[str]) -> DataFrame:
        """All columns of some of the files."""
        return self._of(files).read()

    def _of(self, files: list[str]) -> Reader:
        """A reader of some of the files, by what is known of all of them."""
        part, rows = copy.copy(self), dict(zip(self.files, self._rows or ()))
        part.files, part._rows = files, [rows[f] for f in files] if rows else None
        return part

    def _shaped(self, raw: DataFrame, names: list[str]) -> DataFrame:
        meta, stored = {s.name: s.metadata for s in self.schema.to_spark().fields}, {f.name: f for f in self._stored}
        return raw.select(*(logical(F.col(f"`{n}`"), stored[n]).alias(n, metadata=meta[n]) for n in names))

    def read(self, columns: list[str] | None = None, where: dict | None = None, start: int = 0, limit: int | None = None) -> DataFrame:
        names = [str(c) for c in columns] if columns is not None else self.schema.names
        for n in names:
            self.schema[n]
        if len(set(names)) < len(names):
            raise ValueError("a column is asked for twice")
        if start < 0 or limit is not None and limit < 0:
            raise ValueError("start and limit can't be negative")
        df = self.source()
        plain = all(physical(f) == spark_type(f.type) for f in self._stored)
        if not plain:  # conditions are on logical values
            df = df.select(*(logical(F.col(f"`{f.name}`"), f).alias(f.name) for f in self._stored), F.col("_metadata"))
        condition = compile_where(where, self.schema)
        ordered = bool(start) or limit is not None
        if ordered:
            df = df.withColumn(FILE, F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")).withColumn(ROW, F.col("_metadata.row_index"))
        if start:
            df = df.filter(self._from(start))
        if limit is not None and condition is None:  # a prefix of the files, whose other rows needn't be read
            df = df.filter(~self._from(start + limit))
        if condition is not None:
            df = df.filter(condition)
        if limit is not None:
            df = df.orderBy(FILE, ROW).limit(limit)
        meta = {s.name: s.metadata for s in self.schema.to_spark().fields}
        if plain:
            return self._shaped(df, names)
        return df.select(*(F.col(f"`{n}`").alias(n, metadata=meta[n]) for n in names))

    def _from(self, start: int) -> Column:
        """Rows at or after a place of the whole input: one comparison of paths, and of row numbers in the file that has the place."""
        base = 0
        for path, rows in zip(self.files, self.rows_by_file()):
            if base + rows > start:
                here = uri_of(self.spark, path)
                return (F.col(FILE) > here) | ((F.col(FILE) == here) & (F.col(ROW) >= start - base))
            base += rows
        return F.lit(False)

    # to the driver

    def tables(self, **query) -> Iterator[pa.Table]:
        """Arrow tables in file order, a file at a time; limit ends the walk early.  Splits of one file come in order."""
        left, start = query.pop("limit", None), query.pop("start", 0)
        if start < 0 or left is not None and left < 0:
            raise ValueError("start and limit can't be negative")
        self.read(**query, limit=0)
        for path, rows in zip(self.files, self.rows_by_file()):
            if left == 0:
                return
            one = self._of([path])
            if start >= rows:
                start -= rows
                continue
            df = one.read(**query, start=start, limit=left)
            start = 0
            table = _raised(lambda: df.toArrow(), path)
            if left is not None:
                left -= table.num_rows
            yield table

    def table(self, **query) -> pa.Table:
        parts = list(self.tables(**query))
        return pa.concat_tables(parts) if parts else self.read(**query | {"limit": 0}).toArrow()

    def rows(self, **query) -> list[dict]:
        return [r for t in self.tables(**query) for r in self._zoned(t).to_pylist(maps_as_pydicts="lossy")]

    def columns(self, **query) -> dict[str, list]:
        return self._zoned(self.table(**query)).to_pydict(maps_as_pydicts="lossy")

    def arrays(self, **query) -> dict[str, np.ndarray]:
        t = self.table(**query)
        return {n: to_numpy(t[n], self.schema[n]) for n in t.column_names}

    def each_row(self, **query) -> Iterator[dict]:
        for t in self.each_batch(**query):
            yield from t

    def map_rows(self, f: Callable[[dict], tuple], columns: str, **query) -> DataFrame:
        """f of every row, a dict as each_row() gives it, called by the tasks that read the rows; columns names f's values in DDL."""
        zone, df = self.zone, self.read(**query)
        out = T._parse_datatype_string(columns)
        target = to_arrow_schema(out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [f(r) for r in zoned(pa.Table.from_batches([b]), zone).to_pylist(maps_as_pydicts="lossy")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), target)], schema=target)

        return df.mapInArrow(run, out)

    def each_batch(self, size: int = BATCH_ROWS, kind: str = "rows", **query) -> Iterator[Any]:
        """Batches of size rows, all full but the last, over row groups and files; kind is rows, columns or arrays."""
        if size < 1:
            raise ValueError("a batch has a row at least")
        if kind not in ("rows", "columns", "arrays"):
            raise ValueError("kind is rows, columns or arrays")
        held: pa.Table | None = None

        def shape(t: pa.Table) -> Any:
            if kind == "arrays":
                return {n: to_numpy(t[n], self.schema[n]) for n in t.column_names}
            t = self._zoned(t)
            return t.to_pylist(maps_as_pydicts="lossy") if kind == "rows" else t.to_pydict(maps_as_pydicts="lossy")

        for t in self.tables(**query):
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= size:
                yield shape(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield shape(held)

    def _zoned(self, t: pa.Table) -> pa.Table:
        return zoned(t, self.zone)

    # explanations

    def scan_plan(self, where: dict | None = None, start: int = 0) -> list[dict]:
        compile_where(where, self.schema)
        if start < 0:
            raise ValueError("start can't be negative")
        out, base, group = [], 0, 0
        mine = {f.name: f for f in self.partitions}
        inside = {k: v for k, v in (where or {}).items() if str(k) not in mine}
        for path in self.files:
            with opened(self.spark, path, self.secrets) as f:
                if self._partition_may_match(path, f.num_rows, {k: v for k, v in (where or {}).items() if str(k) in mine}):
                    for p in pruning.scan_plan(f, inside, max(0, start - base)):
                        out.append(p | {"row_group": p["row_group"] + group})
                base, group = base + f.num_rows, group + len(f.blocks)
        return out

    def _partition_may_match(self, path: str, rows: int, where: dict) -> bool:
        """Whether a file's partition values leave a match possible."""
        if not where:
            return True
        values, types = partition_values(below(path, self.folder)), {f.name: f.type for f in self.partitions}
        for name, condition in where.items():
            v = values[str(name)]
            v = int(v) if v is not None and types[str(name)].kind == "int" else v
            if not pruning.may_match(condition, Stats(rows, rows if v is None else 0, v, v), types[str(name)]):
                return False
        return True

    def page_index(self, row_group: int, column: str):
        for f in self._footers():
            if row_group < len(f.blocks):
                return f.pages(row_group, column)
            row_group -= len(f.blocks)
        raise ValueError("no such row group")

    def bloom_filter(self, row_group: int, column: str):
        for f in self._footers():
            if row_group < len(f.blocks):
                return f.bloom(row_group, column)
            row_group -= len(f.blocks)
        raise ValueError("no such row group")


def zoned(t: pa.Table, zone: datetime.tzinfo | None) -> pa.Table:
    """Instants in a reader's zone; local times stay."""
    name = None if zone is None else _zone_name(zone)
    for i, f in enumerate(t.schema):
        if pa.types.is_timestamp(f.type) and f.type.tz is not None:
            t = t.set_column(i, f.name, t.column(i).cast(pa.timestamp("us", name or "UTC")))
    return t


def _zone_name(zone: datetime.tzinfo) -> str:
    if isinstance(zone, zoneinfo.ZoneInfo):
        return zone.key
    minutes = round(zone.utcoffset(None).total_seconds() / 60)
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def _raised(f, path: str):
    try:
        return f()
    except TesseraError:
        raise
    except Exception as e:
        text = str(e)
        if "ParquetCryptoRuntimeException" in text or "KeyAccessDenied" in text:
            raise DecryptionError(f"{path}: {text.splitlines()[0]}") from e
        if any(x in text for x in ("ParquetDecodingException", "is not a Parquet file", "could not read page", "CANNOT_READ_FILE", "FAILED_READ_FILE")):
            raise FormatError(f"{path}: {text.splitlines()[0]}") from e
        raise


def to_numpy(column: pa.ChunkedArray, f: Field) -> np.ndarray:
    """A typed array: integers with nulls as double with NaN, floats at their width, lists of one length without nulls
    as two dimensions; all else as objects."""
    k, t = f.type.kind, column.type
    if k in ("int", "float", "time") or k == "timestamp" and f.type.unit == "nanos":
        if pa.types.is_decimal(t):  # uint64
            if column.null_count:
                return np.array([np.nan if x is None else float(x) for x in column.to_pylist()], np.float64)
            return np.array([int(x) for x in column.to_pylist()], np.uint64)
        if not column.null_count:
            out = column.to_numpy()
            return out if k != "int" or f.type.signed else out.astype(f"uint{f.type.bits}")
        if pa.types.is_integer(t):
            return column.cast(pa.float64(), safe=False).to_numpy()
        return column.to_numpy()
    if k == "boolean" and not column.null_count:
        return column.to_numpy()
    if k == "list" and len(column) and not column.null_count:
        flat = column.combine_chunks()
        flat = pa.chunked_array(flat).combine_chunks() if isinstance(flat, list) else flat
        sizes = set(flat.value_lengths().to_pylist())
        inner = flat.flatten()
        element = f.type.fields[0]
        if len(sizes) == 1 and not inner.null_count and element.type.kind in ("int", "float", "boolean"):
            return to_numpy(pa.chunked_array([inner]), element).reshape(len(column), -1)
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: dict | None = None, start: int = 0, limit: int | None = None, time_zone: Any = None) -> DataFrame:
    """Reader(...).read(...) in one call."""
    return Reader(spark, path, time_zone).read(columns, where, start, limit)


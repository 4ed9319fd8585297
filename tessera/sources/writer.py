"""Typed sinks: rows or DataFrames to Parquet with strict conversion, inference and physical options."""

from __future__ import annotations

import datetime
import decimal
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import chain, islice
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EncodeError, MissingCodecError, SchemaMismatch, UnsupportedError
from ..functions import coerce
from ..schema import Builder, Field, Schema, Type, infer
from .footer import COPIES, below, files_of, folder_of
from .keys import install, write_options
from .notes import add_notes
from .storage import scratch

INFERENCE_ROWS = 1000
#: Rows that go to Spark at once from Python.
CHUNK_ROWS = 50_000
#: Rows of a range that one task sorts, and folders into which one task writes at once before it sorts rows by folder.
RANGE_ROWS, OPEN_FILES = 500_000, 32
CODECS = {"none": "uncompressed", "uncompressed": "uncompressed", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4_raw", "lz4_raw": "lz4_raw", "lz4_hadoop": "lz4", "zstd": "zstd", "brotli": "brotli"}
#: Levels that a codec takes (fixed values).
LEVELS = {"zstd": (-131072, 22), "gzip": (0, 9), "brotli": (0, 11)}
ENCODINGS = {
    "plain": None, "rle": ("boolean",), "delta_binary_packed": ("int", "date", "time", "timestamp"),
    "delta_length_byte_array": ("string", "enum", "json", "bson", "binary"), "delta_byte_array": ("string", "enum", "json", "bson", "binary", "fixed"),
    "byte_stream_split": ("int", "float", "fixed"),
}


@dataclass(frozen=True)
class Options:
    """Physical options of a sink."""

    compression: str = "snappy"
    compression_level: int | None = None
    row_group_bytes: int | None = None
    row_group_rows: int | None = None
    page_bytes: int | None = None
    page_rows: int | None = 20_000
    data_page_version: int = 1
    dictionary: bool | list[str] = True
    encodings: dict[str, str] = field(default_factory=dict)
    bloom_filters: bool | list[str] | dict[str, dict] | None = None
    checksums: bool = True
    #: Key/value metadata of the footers, and the columns by which rows are sorted: names, or (name, descending, nulls first).
    metadata: dict[str, str] | None = None
    sorting: list | None = None
    #: How files are encrypted (an Encryption); plaintext: not at all, where inputs are.
    encryption: Any = None
    plaintext: bool = False

    def spark_options(self, schema: Schema, distinct: dict[str, int] | None = None) -> dict[str, str]:
        codec = str(self.compression).lower()
        if codec not in CODECS:
            raise ValueError(f"no codec {self.compression!r}; there are {', '.join(CODECS)}")
        out = {"compression": CODECS[codec]}
        if self.compression_level is not None:
            if codec not in LEVELS:
                raise ValueError(f"{codec} has no levels")
            low, high = LEVELS[codec]
            if not low <= self.compression_level <= high:
                raise ValueError(f"{codec} takes levels from {low} to {high}")
            out["parquet.compression.codec.zstd.level" if codec == "zstd" else "zlib.compress.level"] = str(self.compression_level)
        for name, key in (("row_group_bytes", "parquet.block.size"), ("row_group_rows", "parquet.block.row.count.limit"), ("page_bytes", "parquet.page.size"), ("page_rows", "parquet.page.row.count.limit")):
            n = getattr(self, name)
            if n is not None:
                if not isinstance(n, int) or n < 1:
                    raise ValueError(f"{name} is a positive number")
                out[key] = str(n)
        if self.data_page_version not in (1, 2):
            raise ValueError("data_page_version is 1 or 2")
        out["parquet.writer.version"] = f"v{self.data_page_version}"
        out["parquet.page.write-checksum.enabled"] = str(self.checksums).lower()
        leaves = dict(leaf_paths(schema))
        if isinstance(self.dictionary, bool):
            out["parquet.enable.dictionary"] = str(self.dictionary).lower()
        else:
            out["parquet.enable.dictionary"] = "false"
            for path in self.dictionary:
                if path not in leaves:
                    raise ValueError(f"no column {path!r}")
                out[f"parquet.enable.dictionary#{path}"] = "true"
        for path, encoding in self.encodings.items():
            if path not in leaves:
                raise ValueError(f"no column {path!r}")
            if encoding not in ENCODINGS:
                raise ValueError(f"no encoding {encoding!r}")
            kinds = ENCODINGS[encoding]
            if kinds and leaves[path].kind not in kinds:
                raise ValueError(f"{encoding} doesn't take a {leaves[path]}")
            out[f"parquet.enable.dictionary#{path}"] = "false"
            if encoding == "byte_stream_split":
                out[f"parquet.enable.bytestreamsplit#{path}"] = "true"
            elif encoding.startswith("delta"):
                out["parquet.writer.version"] = "v2"  # whose default encodings these are
        wanted = self.bloom_filters
        if wanted:
            if wanted is True:
                wanted = {p: {} for p, t in leaves.items() if t.kind != "boolean"}
            elif not isinstance(wanted, dict):
                wanted = {p: {} for p in wanted}
            for path, more in wanted.items():
                if path not in leaves:
                    raise ValueError(f"no column {path!r}")
                if leaves[path].kind == "boolean":
                    raise ValueError(f"a bloom filter of the boolean {path!r} rules nothing out")
                unknown = set(more) - {"ndv", "fpp", "max_bytes"}
                if unknown:
                    raise ValueError(f"unknown bloom filter options {', '.join(sorted(unknown))}")
                out[f"parquet.bloom.filter.enabled#{path}"] = "true"
                ndv = more.get("ndv") or (distinct or {}).get(path)
                if ndv:
                    out[f"parquet.bloom.filter.expected.ndv#{path}"] = str(ndv)
                if "fpp" in more:
                    if not 0 < more["fpp"] < 1:
                        raise ValueError("fpp lies between 0 and 1")
                    out[f"parquet.bloom.filter.fpp#{path}"] = str(more["fpp"])
                if "max_bytes" in more:
                    out["parquet.bloom.filter.max.bytes"] = str(more["max_bytes"])
        return out


def like(reader, schema: Schema) -> Options:
    """Options that keep the codec, the encryption and the bloom filters of a reader's files, for columns that schema still has."""
    codec = {"lz4": "lz4_hadoop", "lzo": "snappy", "uncompressed": "none"}.get(reader.codec, reader.codec)
    leaves = dict(leaf_paths(schema))
    encryption = reader.secrets.encryption.only(schema.names) if reader.secrets else None
    return Options(compression=codec if codec in CODECS else "snappy", bloom_filters=[p for p in reader.blooms if p in leaves] or None, encryption=encryption)


def leaf_paths(schema: Schema) -> Iterator[tuple[str, Type]]:
    """Dotted Parquet paths of the leaves, as Spark writes lists and maps."""

    def walk(f: Field, prefix: str) -> Iterator[tuple[str, Type]]:
        path = prefix + f.name
        if f.type.kind == "struct":
            for x in f.type.fields:
                yield from walk(x, path + ".")
        elif f.type.kind == "list":
            yield from walk(Field("element", f.type.fields[0].type), path + ".list.")
        elif f.type.kind == "map":
            for name, x in zip(("key", "value"), f.type.fields):
                yield from walk(Field(name, x.type), path + ".key_value.")
        else:
            yield path, f.type

    for f in schema.fields:
        yield from walk(f, "")


def codecs(spark: SparkSession) -> dict[str, bool]:
    """Which codecs this installation can write."""
    out = {}
    for name in ("none", "snappy", "gzip", "lz4", "lz4_hadoop", "zstd", "brotli"):
        try:
            kind = {"brotli": "org.apache.hadoop.io.compress.BrotliCodec"}.get(name)
            if kind:
                spark._jvm.java.lang.Class.forName(kind)
            out[name] = True
        except Exception:  # noqa: BLE001
            out[name] = False
    return out


def write_frame(df: DataFrame, path: str, schema: Schema | None = None, options: Options | None = None, mode: str = "errorifexists", files: int | None = None, strict: bool = True, partition_by: list[str] | None = None) -> int:
    """Writes a DataFrame in the schema's types (by default, its own) and returns the number of rows.

    strict: values are converted by the rules for Python values, and nulls in required columns fail the write.  The
    output appears as a whole or not at all.  The rows are counted on their way, not in a second pass.
    """
    schema = schema or Schema.from_spark(df.schema)
    options = options or Options()
    if str(options.compression).lower() == "brotli" and not codecs(df.sparkSession)["brotli"]:
        raise MissingCodecError("brotli needs the class org.apache.hadoop.io.compress.BrotliCodec")
    for f in schema.fields:
        if f.type.kind in ("null", "other"):
            raise UnsupportedError(f"column {f.name!r}: a {f.type} can't be written")
    types = dict(df.dtypes)
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"no column {unknown[0]!r} in the schema")
    target = schema.to_spark()
    out = []
    for f, s in zip(schema.fields, target.fields):
        c = F.col(f"`{f.name}`") if f.name in types else F.lit(None)
        if f.name not in types or types[f.name] == s.dataType.simpleString() or f.type.nested:
            c = c.cast(s.dataType)
        else:
            c = coerce.column(c, f.type, types[f.name]) if strict else c.cast(s.dataType)
        if f.type.kind == "float" and f.type.bits == 16:
            c = coerce.half(c.cast("float"))
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"column {f.name}: null in a required column")).cast(s.dataType), some_value(s.dataType))
        out.append(c.alias(f.name, metadata=s.metadata))
    distinct = None
    bloom = options.bloom_filters
    auto = [] if not bloom else [p for p, t in leaf_paths(schema) if "." not in p and t.kind != "boolean"] if bloom is True else [p for p in bloom if "." not in p and not (isinstance(bloom, dict) and bloom[p].get("ndv"))]
    if auto:  # a filter is sized by the distinct values that there are, of which a row group has no more than rows
        found = df.agg(*(F.approx_count_distinct(F.col(f"`{p}`")).alias(p) for p in auto if p in types)).first()
        most = options.row_group_rows or 1 << 62
        distinct = {p: min(most, max(1, found[p])) for p in auto if p in types}
    counted = Observation()
    shaped = df.select(out)
    if files:
        shaped = shaped.coalesce(files) if files < shaped.rdd.getNumPartitions() else shaped
    spark = df.sparkSession
    conf, jpath = spark.conf, spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = not fs.exists(jpath)
    secret = {}
    if options.encryption:
        if options.metadata or options.sorting:
            raise UnsupportedError("footers of encrypted files can't be annotated")
        install(spark)
        secret = write_options(options.encryption)
    sorting_places(schema, options.sorting, partition_by or [])
    there = set() if fresh or not (options.metadata or options.sorting) else set(files_of(spark, path))
    # with a few folders' files open at once a task needn't sort its rows by folder, and keeps their order
    own = {"spark.sql.parquet.outputTimestampType": timestamp_form(schema), "spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
    before = {k: conf.get(k) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        shaped.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode(mode).options(**options.spark_options(schema, distinct), **secret).partitionBy(*(partition_by or [])).parquet(path)
    except Exception as e:
        if fresh:
            fs.delete(jpath, True)
        text = str(e)
        m = re.search(r"\[USER_RAISED_EXCEPTION\]\s*(.*)", text)
        if m:
            raise EncodeError(m[1].split("SQLSTATE")[0].strip()) from e
        raise
    finally:
        for k, v in before.items():
            conf.set(k, v)
    if options.metadata or options.sorting:
        add_notes(spark, [f for f in files_of(spark, path) if f not in there], options.metadata, sorting_places(schema, options.sorting, partition_by or []))
    return counted.get["rows"]


def write_sorted(df: DataFrame, path: str, by: list[str], rows: int, options: Options | None = None, partition_by: list[str] | None = None) -> None:
    """Writes one file for each folder of partition_by (one in all without), its rows in the order of by, whatever its size.

    Ranges of about RANGE_ROWS of the rows are sorted and written by a task each; then their row groups are appended, byte for byte.
    All files have one base name.  The output appears as a whole or not at all.
    """
    from ..operators.combine import merge_files

    options, spark, keys = options or Options(), df.sparkSession, [*(partition_by or []), *by]
    parts, hadoop = scratch(spark, "ranges"), spark._jsc.hadoopConfiguration()
    target, between = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, parts))
    if target.getFileSystem(hadoop).exists(target):
        raise ValueError(f"{path} exists")
    sorting_places(Schema.from_spark(df.schema), options.sorting, partition_by or [])
    ranges = df.repartitionByRange(max(1, -(-rows // RANGE_ROWS)), *keys).sortWithinPartitions(*keys)
    write_frame(ranges, parts, options=replace(options, metadata=None, sorting=None), partition_by=partition_by)
    folder, folders = folder_of(spark, parts), {}
    for f in files_of(spark, parts):
        folders.setdefault(below(f, folder).rpartition("/")[0], []).append(f)
    made = {"/".join(x for x in (path.rstrip("/"), name, "part-00000.parquet") if x): inputs for name, inputs in folders.items()}
    try:
        target.getFileSystem(hadoop).mkdirs(target)
        with ThreadPoolExecutor(COPIES) as pool:
            for _ in pool.map(lambda x: merge_files(spark, x[1], x[0]), made.items()):
                pass
        if options.metadata or options.sorting:
            add_notes(spark, files_of(spark, path), options.metadata, sorting_places(Schema.from_spark(df.schema), options.sorting, partition_by or []))
    except BaseException:
        target.getFileSystem(hadoop).delete(target, True)
        raise
    finally:
        between.getFileSystem(hadoop).delete(between, True)


def sorting_places(schema: Schema, sorting: list | None, partition_by: list[str]) -> list[tuple[int, bool, bool]]:
    """Sorting columns by the places of their leaves in a file."""
    leaves = [p for p, _ in leaf_paths(schema) if p not in partition_by]
    out = []
    for x in sorting or []:
        name, down, nulls = (x, False, True) if isinstance(x, str) else x
        if name not in leaves:
            raise ValueError(f"no column {name!r}")
        out.append((leaves.index(name), down, nulls))
    return out


def timestamp_form(schema: Schema) -> str:
    """How Spark stores instants, which it decides for all columns alike: INT96 if one asks for it, milliseconds if all do."""
    kinds = {t.kind if t.kind == "int96" else t.unit for _, t in leaf_paths(schema) if t.kind == "int96" or t.kind == "timestamp" and t.utc and t.unit != "nanos"}
    if "int96" in kinds and len(kinds) > 1:
        raise UnsupportedError("int96 and timestamp columns can't be in one file")
    return "INT96" if "int96" in kinds else "TIMESTAMP_MILLIS" if kinds == {"millis"} else "TIMESTAMP_MICROS"


def some_value(dt: T.DataType) -> Column:
    """A value that isn't null, which tells Spark that a column has none."""
    if isinstance(dt, T.StructType):
        return F.struct(*((F.lit(None).cast(f.dataType) if f.nullable else some_value(f.dataType)).alias(f.name) for f in dt.fields))
    if isinstance(dt, T.ArrayType):
        return F.array().cast(dt)
    if isinstance(dt, T.MapType):
        return F.create_map().cast(dt)
    if isinstance(dt, T.DecimalType):
        return F.lit(decimal.Decimal(0)).cast(dt)
    plain = {T.StringType: "", T.BinaryType: bytearray(), T.BooleanType: False, T.DateType: datetime.date(1970, 1, 1), T.TimestampType: datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC), T.TimestampNTZType: datetime.datetime(1970, 1, 1)}
    for kind, v in plain.items():
        if isinstance(dt, kind):
            return F.lit(v)
    return F.lit(0).cast(dt)


class Writer:
    """Rows one at a time: w = Writer(spark, path, schema); w.append(row); w.close().

    A row that doesn't fit raises EncodeError and leaves no trace; the writer goes on.  Rows are handed to Spark in
    chunks that become files below path.  Leaving the context by an exception, or abort(), removes them all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, options: Options | None = None):
        self.spark, self.path, self.schema, self.options = spark, path, schema, options or Options()
        self.options.spark_options(schema)
        self.rows: list[tuple] = []
        self.count = 0
        self.done = False

    def append(self, row: Any) -> None:
        if self.done:
            raise ValueError("the writer is closed")
        self.rows.append(coerce.encode_row(row, self.schema, self.count))
        self.count += 1
        if len(self.rows) >= CHUNK_ROWS:
            self._flush()

    __lshift__ = append

    def _flush(self) -> None:
        spark_schema = self.schema.to_spark()
        df = self.spark.createDataFrame(self.rows, spark_schema, verifySchema=False)
        write_frame(df, self.path, self.schema, self.options, mode="append", strict=False, files=1)
        self.rows = []

    def close(self) -> int:
        if not self.done:
            if self.rows or not self.count:
                self._flush()
            self.done = True
        return self.count

    def abort(self) -> None:
        self.done, self.rows = True, []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind:
            self.abort()
        else:
            self.close()


def named_rows(rows: Iterable[Any], headers: list[str] | None) -> Iterator[dict]:
    """Rows as dicts; sequences take their names from headers."""
    if headers is not None:
        headers = [str(h) for h in headers]
        if len(set(headers)) < len(headers) or not headers:
            raise ValueError("headers are distinct names")
    for k, r in enumerate(rows):
        if isinstance(r, (list, tuple)) and not hasattr(r, "_asdict"):
            if headers is None:
                raise ValueError("rows without names need headers")
            if len(r) != len(headers):
                raise EncodeError(f"row {k}: {len(r)} values for {len(headers)} headers", row=k)
            yield dict(zip(headers, r))
        else:
            d = r if isinstance(r, dict) else r.asDict() if hasattr(r, "asDict") else r._asdict() if hasattr(r, "_asdict") else vars(r)
            d = {str(x): v for x, v in d.items()}
            if headers is not None:
                extra = [x for x in d if x not in headers]
                if extra:
                    raise EncodeError(f"row {k}: no header {extra[0]!r}", row=k, column=extra[0])
                d = {h: d.get(h) for h in headers}
            yield d


def write(spark: SparkSession, path: str, rows: Any, schema: Schema | None = None, declare: Callable[[Builder], Any] | None = None, headers: list[str] | None = None, options: Options | None = None) -> int:
    """Writes rows (any iterable, read once) or a DataFrame and returns their number.

    Without a schema it is inferred from the first 1000 rows; what declare declares replaces or adds to that.  A later
    row that doesn't fit raises SchemaMismatch, and nothing is left at path.
    """
    if isinstance(rows, DataFrame):
        return write_frame(rows, path, schema, options)
    if schema is not None:
        if headers is not None:
            raise ValueError("a schema names the columns; headers can't be given as well")
        with Writer(spark, path, schema, options) as w:
            for r in rows:
                w.append(r)
        return w.count
    it = named_rows(rows, headers)
    first = list(islice(it, INFERENCE_ROWS))
    if first:
        inferred = infer(first, declare)
    elif headers:
        inferred = infer([{h: None for h in headers}], declare)
    else:
        raise ValueError("no rows to infer a schema from")
    with Writer(spark, path, inferred, options) as w:
        for k, r in enumerate(chain(first, it)):
            try:
                w.append(r)
            except EncodeError as e:
                if k < len(first):
                    raise
                name = e.column or next(iter(r))
                kind = inferred[name.split(".")[0]].type if name.split(".")[0] in inferred.names else "no column"
                raise SchemaMismatch(f"{e}; {len(first)} rows gave {kind}: declare {name!r}, or pass a schema", row=k, column=e.column, value=e.value) from e
    return w.count

"""Footers, statistics, page indexes and bloom filters, read on the driver through Spark's own Parquet library.

Paths are whatever Spark can open.  Values of statistics come back as Python values of their column's type.
"""

from __future__ import annotations

import datetime
import decimal
import re
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

from pyspark.sql import SparkSession

from ..errors import DecryptionError, FormatError
from ..schema import Field, Schema, Type, type_of
from . import thrift


@dataclass(frozen=True)
class Stats:
    """Of a chunk or page: rows, nulls (None: unknown), least and greatest value (None: unknown)."""

    rows: int
    nulls: int | None
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class Page:
    first_row: int
    rows: int
    offset: int
    size: int
    stats: Stats | None


def uri_of(spark: SparkSession, path: str) -> str:
    """A path as Spark's _metadata.file_path has it, but for the slashes after file:."""
    return one_slash(spark._jvm.org.apache.hadoop.fs.Path(path).toUri().toString())


def one_slash(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def folder_of(spark: SparkSession, path: str) -> str | None:
    """The qualified path if it is a folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath) or not fs.getFileStatus(jpath).isDirectory():
        return None
    return jpath.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The data files at path, a file or folder with its subfolders, sorted by their URIs."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(jpath).isDirectory():
        return [jpath.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()]
    base = jpath.toUri().getPath().rstrip("/") + "/"
    out, walk = [], fs.listFiles(jpath, True)
    while walk.hasNext():
        p = walk.next().getPath()
        below = p.toUri().getPath().split(base, 1)[-1].split("/")
        if not any(x.startswith(("_", ".")) for x in below if x):
            out.append((one_slash(p.toUri().toString()), p.toString()))
    return [x for _, x in sorted(out)]


def below(path: str, folder: str) -> str:
    """A file's path relative to a folder above it."""
    path, folder = one_slash(path), one_slash(folder).rstrip("/") + "/"
    if not path.startswith(folder):
        raise ValueError(f"{path} isn't below {folder}")
    return path[len(folder) :]


def end_of(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """A file's magic at its end, and its footer."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(jpath).getLen()
    f = fs.open(jpath)
    try:
        f.seek(max(0, size - 8))
        tail = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(f, min(8, size)))
        n = int.from_bytes(tail[:4], "little")
        if len(tail) < 8 or n > size - 8:
            return tail[4:], b""
        f.seek(size - 8 - n)
        return tail[4:], bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(f, n))
    finally:
        f.close()


#: Codecs and the encoding that the vectorized reader lacks, by their numbers in the format (fixed values).
CODEC_NAMES = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
BYTE_STREAM_SPLIT = 9


@dataclass(frozen=True)
class Chunk:
    column: str
    codec: str
    split: bool
    bloom: bool


def chunks_of(spark: SparkSession, path: str) -> list[Chunk]:
    """What the footer of a file that isn't encrypted says of its chunks, read at once."""
    magic, raw = end_of(spark, path)
    if magic != b"PAR1":
        return []
    out = []
    for group in thrift.Decoder(raw).record()[thrift.ROW_GROUPS][1][1]:
        for chunk in group[1][1][1]:
            meta = chunk[3][1] if 3 in chunk else {}
            if meta:
                out.append(Chunk(".".join(x.decode() for x in meta[3][1][1]), CODEC_NAMES[meta[4][1]], BYTE_STREAM_SPLIT in meta[2][1][1], 14 in meta))
    return out


def copy_files(spark: SparkSession, targets: dict[str, str]) -> None:
    """Copies files byte for byte, some at once; refuses to overwrite."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()

    def copy(pair: tuple[str, str]) -> None:
        src, dst = (jvm.org.apache.hadoop.fs.Path(x) for x in pair)
        fs = dst.getFileSystem(hadoop)
        fs.mkdirs(dst.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(hadoop), src, fs, dst, False, False, hadoop)

    with ThreadPoolExecutor(COPIES) as pool:
        for _ in pool.map(copy, targets.items()):
            pass


def copy_changed(spark: SparkSession, source: str, target: str, at: int) -> None:
    """Copies a file with the bits of one byte turned over; nothing but a buffer of it is held."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    src, dst = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs, io = dst.getFileSystem(hadoop), jvm.org.apache.commons.io.IOUtils
    fs.mkdirs(dst.getParent())
    f = src.getFileSystem(hadoop).open(src)
    try:
        out = fs.create(dst, False)
        try:
            io.copyLarge(f, out, 0, at)
            out.write(f.read() ^ 0xFF)
            io.copyLarge(f, out)
        finally:
            out.close()
    finally:
        f.close()


#: Files that are copied at once.
COPIES = 16
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def partition_values(relative: str) -> dict[str, str | None]:
    """The name=value parts of a file's path below its folder; values are text (None: null)."""
    parts = [x.partition("=") for x in relative.split("/")[:-1]]
    return {unquote(k): None if v == NO_VALUE else unquote(v) for k, eq, v in parts if eq and k}


def partitions_of(relative: list[str], names: list[str]) -> list[Field]:
    """The partition columns of files: none unless all files have the same ones, and none that the files hold themselves.

    A column of integers is int32 or int64, any other a string.
    """
    found = [partition_values(r) for r in relative]
    keys = list(found[0]) if found else []
    if not keys or any(list(x) != keys for x in found) or set(keys) & set(names):
        return []
    out = []
    for k in keys:
        values = {x[k] for x in found} - {None}
        whole = bool(values) and all(re.fullmatch(r"0|-?[1-9][0-9]{0,17}", v) for v in values)
        kind = "string" if not whole else "int32" if all(abs(int(v)) < 1 << 31 for v in values) else "int64"
        out.append(Field(k, type_of(kind)))
    return out


def _rethrow(error: Exception, path: str):
    text = str(getattr(error, "java_exception", error))
    kind = DecryptionError if "Crypto" in text or "decrypt" in text.lower() or "encrypted" in text.lower() else FormatError
    raise kind(f"{path}: {text.splitlines()[0][:300]}") from error


class Footer:
    """An open file's metadata.  Use it as a context manager.  secrets: a Described, for an encrypted file."""

    def __init__(self, spark: SparkSession, path: str, secrets: Any = None):
        self.spark, self.path, self.jvm = spark, path, spark._jvm
        try:
            conf = spark._jsc.hadoopConfiguration()
            self.input = self.jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(self.jvm.org.apache.hadoop.fs.Path(path), conf)
            open_file = self.jvm.org.apache.parquet.hadoop.ParquetFileReader.open
            if secrets is None:
                self.reader = open_file(self.input)
            else:
                options = self.jvm.org.apache.parquet.HadoopReadOptions.builder(conf).withDecryption(secrets.properties(self.jvm)).build()
                self.reader = open_file(self.input, options)
        except Exception as e:  # noqa: BLE001
            _rethrow(e, path)
        meta = self.reader.getFooter()
        self.file = meta.getFileMetaData()
        self.blocks = list(meta.getBlocks())
        self.schema = Schema(_field(self.file.getSchema().getType(i)) for i in range(self.file.getSchema().getFieldCount()))
        self.leaves = {".".join(c.getPath()): c for c in self.file.getSchema().getColumns()}
        self._places = {path: k for k, path in enumerate(self.leaves)}

    def __enter__(self) -> Footer:
        return self

    def __exit__(self, *_) -> None:
        self.reader.close()

    @property
    def num_rows(self) -> int:
        return sum(b.getRowCount() for b in self.blocks)

    @property
    def metadata(self) -> dict[str, str]:
        return dict(self.file.getKeyValueMetaData())

    @property
    def created_by(self) -> str | None:
        return self.file.getCreatedBy()

    @property
    def encrypted(self) -> bool:
        return self.file.getEncryptionType().toString() != "UNENCRYPTED"

    def chunk(self, group: int, path: str):
        at = self._places.get(path)  # chunks stand in the order of the schema's leaves
        return None if at is None else self.blocks[group].getColumns()[at]

    def leaf_type(self, path: str) -> Type:
        return _leaf(self.leaves[path].getPrimitiveType())

    def stats(self, group: int, path: str) -> Stats | None:
        c = self.chunk(group, path)
        rows = self.blocks[group].getRowCount()
        s = c.getStatistics() if c is not None else None
        if s is None or s.isEmpty():
            return Stats(rows, None)
        nulls = s.getNumNulls() if s.isNumNullsSet() else None
        if not s.hasNonNullValue():
            return Stats(rows, nulls)
        t, kind = self.leaf_type(path), c.getPrimitiveType().getPrimitiveTypeName().toString()
        return Stats(rows, nulls, *(decode(raw_value(kind, bytes(x)), t) for x in (s.getMinBytes(), s.getMaxBytes())))

    def pages(self, group: int, path: str) -> list[Page] | None:
        """The pages that the page index has; None without one, or with a damaged one."""
        c = self.chunk(group, path)
        try:
            offsets = self.reader.readOffsetIndex(c)
            index = self.reader.readColumnIndex(c)
        except Exception:  # noqa: BLE001
            return None
        if offsets is None:
            return None
        rows, n = self.blocks[group].getRowCount(), offsets.getPageCount()
        t, kind = self.leaf_type(path), c.getPrimitiveType().getPrimitiveTypeName().toString()
        out = []
        for i in range(n):
            first = offsets.getFirstRowIndex(i)
            size = (offsets.getFirstRowIndex(i + 1) if i + 1 < n else rows) - first
            stats = None
            if index is not None:
                nulls = index.getNullCounts()
                nulls = nulls[i] if nulls is not None else None
                if index.getNullPages()[i]:
                    stats = Stats(size, size)
                else:
                    low, high = (decode(raw_value(kind, _bytes_of(x[i])), t) for x in (index.getMinValues(), index.getMaxValues()))
                    stats = Stats(size, nulls, low, high)
            out.append(Page(first, size, offsets.getOffset(i), offsets.getCompressedPageSize(i), stats))
        return out

    def bloom(self, group: int, path: str):
        """contains(value) -> bool of a chunk's bloom filter; None without one.  False is certain, True isn't."""
        c = self.chunk(group, path)
        try:
            found = self.reader.readBloomFilter(c)
        except Exception:  # noqa: BLE001
            return None
        if found is None:
            return None
        t, kind = self.leaf_type(path), c.getPrimitiveType().getPrimitiveTypeName().toString()

        def contains(value: Any) -> bool:
            raw = encode_plain(value, t, kind)
            return True if raw is None else bool(found.findHash(plain_hash(raw)))

        return contains


def plain_hash(raw: bytes) -> int:
    """XXH64, seed 0, of a value's PLAIN bytes, as a signed integer: what bloom filters are asked."""
    import xxhash

    x = xxhash.xxh64_intdigest(raw, 0)
    return x - (1 << 64) if x >> 63 else x


def encode_plain(value: Any, t: Type, kind: str) -> bytes | None:
    """The PLAIN bytes of a value, None if the column can't hold it in a way that is known here."""
    import struct

    if t.kind == "int" and isinstance(value, int) and not isinstance(value, bool):
        bits = 32 if kind == "INT32" else 64
        low, high = (-(1 << (t.bits - 1)), 1 << (t.bits - 1)) if t.signed else (0, 1 << t.bits)
        return (value % (1 << bits)).to_bytes(bits // 8, "little") if low <= value < high else None
    if t.kind == "float" and isinstance(value, (int, float)) and t.bits > 16 and value != 0:
        return struct.pack("<d" if t.bits == 64 else "<f", value)
    if t.kind in ("string", "enum", "json", "binary") and isinstance(value, (str, bytes)):
        return value.encode() if isinstance(value, str) else value
    if t.kind == "date" and isinstance(value, datetime.date):
        return (value.toordinal() - 719163).to_bytes(4, "little", signed=True)
    return None


def _bytes_of(buffer) -> bytes:
    copy = buffer.duplicate()
    n = copy.remaining()
    if copy.hasArray():
        a = copy.arrayOffset() + copy.position()
        return bytes(copy.array())[a : a + n]
    return bytes(copy.get(i) & 0xFF for i in range(copy.position(), copy.position() + n))


def raw_value(kind: str, raw: bytes) -> Any:
    import struct

    if kind in ("INT32", "INT64"):
        return int.from_bytes(raw, "little", signed=True)
    if kind in ("FLOAT", "DOUBLE"):
        return struct.unpack("<f" if kind == "FLOAT" else "<d", raw)[0]
    if kind == "BOOLEAN":
        return bool(raw and raw[0])
    return raw


def decode(v: Any, t: Type) -> Any:
    """A physical value as a Python one; None for kinds whose order isn't that of their values."""
    epoch = datetime.datetime(1970, 1, 1)
    try:
        if t.kind == "int":
            return v if t.signed else v % (1 << t.bits)
        if t.kind == "float":
            return v if t.bits > 16 and v == v else None
        if t.kind == "date":
            return datetime.date.fromordinal(v + 719163)
        if t.kind == "timestamp" and t.unit != "nanos":
            return epoch + datetime.timedelta(microseconds=v * (1000 if t.unit == "millis" else 1))
        if t.kind == "decimal":
            unscaled = v if isinstance(v, int) else int.from_bytes(v, "big", signed=True)
            return decimal.Decimal(unscaled).scaleb(-t.scale, decimal.Context(prec=80))
        if t.kind in ("string", "enum", "json"):
            return v.decode("utf-8", "surrogateescape")
        if t.kind in ("other", "int96"):
            return None
    except (OverflowError, ValueError):
        return None
    return v


def _optional(x):
    return x.get() if x is not None and x.isPresent() else None


def _leaf(p) -> Type:
    kind, note = p.getPrimitiveTypeName().toString(), p.getLogicalTypeAnnotation()
    name = note.getClass().getSimpleName().removesuffix("LogicalTypeAnnotation") if note is not None else ""
    if name == "Int":
        return Type("int", bits=note.getBitWidth(), signed=note.isSigned())
    if name == "Decimal":
        return Type("decimal", precision=note.getPrecision(), scale=note.getScale())
    if name in ("Timestamp", "Time"):
        return Type(name.lower(), unit=note.getUnit().toString().lower(), utc=note.isAdjustedToUTC())
    plain = {"String": "string", "Enum": "enum", "Json": "json", "Bson": "bson", "Date": "date", "UUID": "uuid"}
    if name in plain:
        return Type(plain[name])
    if name == "Float16":
        return Type("float", bits=16)
    if name:
        return Type("other", name=name.lower())
    if kind == "FIXED_LEN_BYTE_ARRAY":
        return Type("fixed", length=p.getTypeLength())
    return type_of({"INT32": "int32", "INT64": "int64", "FLOAT": "float", "DOUBLE": "double", "BOOLEAN": "boolean", "INT96": "int96", "BINARY": "binary"}[kind])


def _members(group) -> list:
    return [group.getType(i) for i in range(group.getFieldCount())]


def _field(p) -> Field:
    """A Parquet type as a field, by the backward-compatibility rules for lists and maps."""
    repetition, name = p.getRepetition().toString(), p.getName()
    number = p.getId().intValue() if p.getId() is not None else None
    if repetition == "REPEATED":
        return Field(name, Type("list", fields=(Field("element", _inner(p), False),)), False, number, True)
    return Field(name, _inner(p), repetition == "OPTIONAL", number)


def _inner(p) -> Type:
    if p.isPrimitive():
        return _leaf(p.asPrimitiveType())
    group = p.asGroupType()
    note = group.getLogicalTypeAnnotation()
    name = note.getClass().getSimpleName() if note is not None else ""
    inner = _members(group)
    if name.startswith("List") and len(inner) == 1 and inner[0].getRepetition().toString() == "REPEATED":
        r = inner[0]
        if r.isPrimitive() or r.asGroupType().getFieldCount() > 1 or r.getName() in ("array", group.getName() + "_tuple"):
            return Type("list", fields=(Field("element", _inner(r), False),))
        e = _members(r.asGroupType())[0]
        return Type("list", fields=(Field("element", _field(e).type, e.getRepetition().toString() == "OPTIONAL"),))
    if name.startswith("Map") and len(inner) == 1 and not inner[0].isPrimitive() and inner[0].getRepetition().toString() == "REPEATED":
        pair = _members(inner[0].asGroupType())
        if len(pair) == 1:
            return Type("list", fields=(Field("element", _field(pair[0]).type, False),))
        if len(pair) == 2:
            return Type("map", fields=(Field("key", _field(pair[0]).type, False), Field("value", _field(pair[1]).type, pair[1].getRepetition().toString() == "OPTIONAL")))
    return Type("struct", fields=tuple(_field(x) for x in inner))


@contextmanager
def opened(spark: SparkSession, path: str, secrets: Any = None):
    with Footer(spark, path, secrets) as f:
        yield f

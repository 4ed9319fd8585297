"""Pseudonyms, masks and renderings, all in Spark's own expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hmac_sha256(c: Column, key: bytes) -> Column:
    """Lower-case hex HMAC-SHA256 of a text column; null stays null."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), c.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def keep_last(c: Column, n: int = 4, mark: str = "*") -> Column:
    """All but the last n characters masked; the length stays."""
    return F.lpad(F.right(c, F.lit(n)), F.length(c), mark)


def mask_email(c: Column) -> Column:
    """The first character and the domain stay."""
    return F.regexp_replace(c, r"^(.).*@", "$1***@")


def mask_prefix(c: Column, n: int = 3, mark: str = "***") -> Column:
    """A mark and the last n characters."""
    return F.concat(F.lit(mark), F.right(c, F.lit(n)))


def year_only(c: Column) -> Column:
    return F.trunc(c, "year")


def renderable(c: Column, dt: T.DataType) -> Column:
    """A value as JSON can show it: bytes as hex, non-finite floats as text, times as ISO 8601 with nine digits."""
    if isinstance(dt, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.when(F.isnan(c), "NaN").when(c > 0, "Infinity").otherwise("-Infinity")).otherwise(c.cast("string"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000" + "Z" * isinstance(dt, T.TimestampType)))
    if isinstance(dt, (T.DateType, T.DecimalType)):
        return c.cast("string")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: renderable(x, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(renderable(c[f.name], f.dataType).alias(f.name) for f in dt.fields)))
    if isinstance(dt, T.MapType):
        return F.transform_values(F.transform_keys(c, lambda k, _: renderable(k, dt.keyType).cast("string")), lambda _, v: renderable(v, dt.valueType))
    return c

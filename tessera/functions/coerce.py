"""Conversions of Python values and of Columns to a schema's types, strict: what doesn't fit is an error.

encode(value, type) makes the value that a Spark row of the type holds.  column(c, type) does the same for a Column of
a fitting type, failing the query on the first value that doesn't fit.
"""

from __future__ import annotations

import datetime
import decimal
import enum
import fractions
import json
import re
import uuid
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EncodeError
from ..schema import Schema, Type, spark_type

#: Texts that stand for booleans, whatever their case (fixed values).
TRUE, FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")
TICKS = {"millis": 1_000, "micros": 1_000_000, "nanos": 1_000_000_000}
EPOCH = datetime.datetime(1970, 1, 1)
_TIME = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?")
_INTEGER = re.compile(r"[+-]?(?:0x[0-9a-f]+(?:_[0-9a-f]+)*|0b[01]+(?:_[01]+)*|0o?[0-7]+(?:_[0-7]+)*|0|[1-9]\d*(?:_\d+)*)", re.I)


class Misfit(ValueError):
    """A value that doesn't fit; encode_row turns it into an EncodeError with its place."""


def to_boolean(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    text = v.lower() if isinstance(v, str) else str(v) if isinstance(v, int) else ""
    if text in TRUE or text in FALSE:
        return text in TRUE
    raise Misfit("not a boolean")


def parse_integer(text: str) -> int:
    """Digits with single underscores between them, in base ten, or in another one by a prefix (0x, 0b, 0o or 0)."""
    t = text.strip()
    if not _INTEGER.fullmatch(t):
        raise Misfit("not an integer")
    sign, body = (-1 if t[0] == "-" else 1), t.lstrip("+-").replace("_", "").lower()
    base = {"0x": 16, "0b": 2, "0o": 8}.get(body[:2], 8 if len(body) > 1 and body[0] == "0" else 10)
    return sign * int(body[2:] if base in (16, 2) or body[:2] == "0o" else body, base)


def to_integer(v: Any, bits: int, signed: bool) -> int:
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal, fractions.Fraction, str)):
        raise Misfit("not an integer")
    if isinstance(v, str):
        n = parse_integer(v)
    else:
        try:
            n = int(v)
        except (ValueError, OverflowError) as e:
            raise Misfit("not an integer") from e
        if n != v:
            raise Misfit("not a whole number")
    low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    if not low <= n <= high:
        raise Misfit(f"out of range for {'' if signed else 'u'}int{bits}")
    return n


def to_float(v: Any, bits: int = 64) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float, decimal.Decimal, fractions.Fraction, str)):
        raise Misfit("not a number")
    try:
        x = float(v.replace("_", "") if isinstance(v, str) else v)
    except (ValueError, OverflowError) as e:
        raise Misfit("not a number") from e
    if bits == 64:
        return x
    import numpy as np

    with np.errstate(over="ignore"):
        return float((np.float16 if bits == 16 else np.float32)(x))


def to_decimal(v: Any, precision: int, scale: int) -> decimal.Decimal:
    """Rounded half away from zero at the scale; a float counts as its shortest text."""
    wide = decimal.Context(prec=400)
    try:
        if isinstance(v, bool):
            raise Misfit("not a number")
        if isinstance(v, fractions.Fraction):
            n, d = v.numerator * 10**scale, v.denominator
            q = (2 * abs(n) + d) // (2 * d)
            x = decimal.Decimal(q if n >= 0 else -q).scaleb(-scale, wide)
        else:
            x = decimal.Decimal(repr(v) if isinstance(v, float) else v.strip().replace("_", "") if isinstance(v, str) else v)
        if not x.is_finite():
            raise Misfit("not a finite number")
        x = x.quantize(decimal.Decimal(1).scaleb(-scale), rounding=decimal.ROUND_HALF_UP, context=wide)
    except (decimal.InvalidOperation, TypeError) as e:
        raise Misfit("not a number") from e
    if abs(x) >= decimal.Decimal(10) ** (precision - scale):
        raise Misfit(f"out of range for decimal({precision},{scale})")
    return x


def to_date(v: Any) -> datetime.date:
    if isinstance(v, datetime.datetime):
        return v.date()
    if isinstance(v, datetime.date):
        return v
    try:
        if isinstance(v, int) and not isinstance(v, bool):
            return datetime.date.fromordinal(v + 719163)
        if isinstance(v, str):
            return datetime.datetime.fromisoformat(v.strip()).date()
    except (ValueError, OverflowError) as e:
        raise Misfit("not a date") from e
    raise Misfit("not a date")


def to_instant(v: Any, unit: str, utc: bool) -> datetime.datetime | int:
    """Naive UTC for timestamps, the wall clock for local ones; ticks for nanoseconds.  Finer parts are cut off downwards."""
    if isinstance(v, bool):
        raise Misfit("not a time")
    if isinstance(v, int):
        return v if unit == "nanos" else _moment(v * (1_000_000 // TICKS[unit]))
    nanos = 0
    if isinstance(v, str):
        text = v.strip()
        m = re.search(r"(?<=[:.]\d{2})\.(\d+)|(?<=:\d{2}),(\d+)|\.(\d+)", text)
        if m:
            digits = next(g for g in m.groups() if g)
            nanos = int(digits[:9].ljust(9, "0")) % 1000
            text = text[: m.start()] + "." + digits[:6].ljust(6, "0") + text[m.end() :]
        try:
            v = datetime.datetime.fromisoformat(text)
        except ValueError as e:
            raise Misfit("not a time") from e
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        v = datetime.datetime(v.year, v.month, v.day)
    if not isinstance(v, datetime.datetime):
        raise Misfit("not a time")
    if v.tzinfo is not None:
        v = (v.astimezone(datetime.UTC) if utc else v).replace(tzinfo=None)
    micros = (v - EPOCH) // datetime.timedelta(microseconds=1)
    if unit == "nanos":
        return micros * 1000 + nanos
    return _moment(micros // 1000 * 1000 if unit == "millis" else micros)


def _moment(micros: int) -> datetime.datetime:
    try:
        return EPOCH + datetime.timedelta(microseconds=micros)
    except OverflowError as e:
        raise Misfit("out of range for a timestamp") from e


def to_ticks(v: Any, unit: str, utc: bool) -> int:
    """Ticks since midnight of a time of day."""
    if isinstance(v, bool):
        raise Misfit("not a time of day")
    per = TICKS[unit]
    if isinstance(v, int):
        n = v
    elif isinstance(v, str):
        m = _TIME.fullmatch(v.strip())
        if not m or int(m[2]) > 59 or int(m[3] or 0) > 59:
            raise Misfit("not a time of day")
        nanos = (int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)) * 10**9 + int((m[4] or "").ljust(9, "0") or 0)
        n = nanos // (10**9 // per)
    elif isinstance(v, (datetime.datetime, datetime.time)):
        if isinstance(v, datetime.datetime) and v.tzinfo is not None and utc:
            v = v.astimezone(datetime.UTC)
        n = ((v.hour * 3600 + v.minute * 60 + v.second) * 10**6 + v.microsecond) * per // 10**6
    else:
        raise Misfit("not a time of day")
    if not 0 <= n < 86400 * per:
        raise Misfit("not within a day")
    return n


def to_uuid(v: Any) -> str:
    try:
        if isinstance(v, uuid.UUID):
            return str(v)
        if isinstance(v, (bytes, bytearray)) and len(v) == 16:
            return str(uuid.UUID(bytes=bytes(v)))
        if isinstance(v, str) and re.fullmatch(r"[0-9A-Fa-f]{32}|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", v):
            return str(uuid.UUID(v))
    except ValueError:
        pass
    raise Misfit("not a UUID")


def to_bytes(v: Any, length: int | None = None) -> bytearray:
    if isinstance(v, str):
        v = v.encode()
    if not isinstance(v, (bytes, bytearray)):
        raise Misfit("not bytes")
    if length is not None and len(v) != length:
        raise Misfit(f"{len(v)} bytes, not {length}")
    return bytearray(v)


def to_text(v: Any) -> str:
    if isinstance(v, enum.Enum):
        return v.name
    if isinstance(v, (bytes, bytearray)):
        try:
            return bytes(v).decode()
        except UnicodeDecodeError as e:
            raise Misfit("not UTF-8") from e
    if isinstance(v, bool):
        return str(v).lower()
    return v if isinstance(v, str) else str(v)


def to_label(v: Any, values: tuple | None) -> str:
    """A label of an enum; with (label, stored) pairs, a stored value stands for its label."""
    if values is None:
        return to_text(v)
    pairs = [x if isinstance(x, tuple) else (x, None) for x in values]
    for label, stored in pairs:
        if not isinstance(v, bool) and (stored is not None and v == stored or to_text(v) == str(label)):
            return str(label)
    raise Misfit(f"not one of {', '.join(str(x) for x, _ in pairs)}")


def encode(v: Any, t: Type) -> Any:
    """v as a Spark row of type t holds it.  Raises Misfit; v isn't None."""
    k = t.kind
    if k == "boolean":
        return to_boolean(v)
    if k == "int":
        n = to_integer(v, t.bits, t.signed)
        return decimal.Decimal(n) if t.bits == 64 and not t.signed else n
    if k == "float":
        return to_float(v, t.bits)
    if k == "string":
        return to_text(v)
    if k == "json":
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    if k == "enum":
        return to_label(v, t.values)
    if k == "uuid":
        return to_uuid(v)
    if k in ("binary", "bson", "other", "fixed"):
        return to_bytes(v, t.length if k == "fixed" else None)
    if k == "date":
        return to_date(v)
    if k == "time":
        return to_ticks(v, t.unit, t.utc)
    if k in ("timestamp", "int96"):
        x = to_instant(v, t.unit or "micros", t.utc)
        return x.replace(tzinfo=datetime.UTC) if isinstance(x, datetime.datetime) and t.utc else x
    if k == "decimal":
        x = to_decimal(v, t.precision, t.scale)
        return x if t.precision <= 38 else str(x)
    raise Misfit(f"no value fits a {t}")


def encode_field(v: Any, f, path: str) -> Any:
    if v is None:
        if not f.nullable:
            raise EncodeError(f"column {path}: null in a required column", column=path, value=None)
        return None
    t = f.type
    if t.kind == "struct":
        if not isinstance(v, dict):
            v = getattr(v, "__dict__", None) if not hasattr(v, "_asdict") else v._asdict()
            if v is None:
                raise EncodeError(f"column {path}: not a struct", column=path, value=v)
        keyed = {str(k): x for k, x in v.items()}
        return tuple(encode_field(keyed.get(x.name), x, f"{path}.{x.name}") for x in t.fields)
    if t.kind == "list":
        if isinstance(v, (str, bytes, dict)) or not hasattr(v, "__iter__"):
            raise EncodeError(f"column {path}: not a list", column=path, value=v)
        return [encode_field(x, t.fields[0], f"{path}.{t.fields[0].name}") for x in v]
    if t.kind == "map":
        if not isinstance(v, dict):
            raise EncodeError(f"column {path}: not a map", column=path, value=v)
        return {encode_field(k, t.fields[0], f"{path}.key"): encode_field(x, t.fields[1], f"{path}.value") for k, x in v.items()}
    try:
        return encode(v, t)
    except Misfit as e:
        raise EncodeError(f"column {path}: {v!r} doesn't fit {t}: {e}", column=path, value=v) from e


def encode_row(row: Any, schema: Schema, number: int | None = None) -> tuple:
    """A dict, a sequence in the schema's order, or an object with attributes, as a Spark row."""
    if isinstance(row, dict):
        keyed = {str(k.name if isinstance(k, enum.Enum) else k): v for k, v in row.items()}
        unknown = [k for k in keyed if k not in schema.names]
        if unknown:
            raise EncodeError(f"row {number}: no column {unknown[0]!r}", row=number, column=unknown[0])
    elif isinstance(row, (list, tuple)) and not hasattr(row, "_asdict"):
        if len(row) != len(schema.fields):
            raise EncodeError(f"row {number}: {len(row)} values for {len(schema.fields)} columns", row=number)
        keyed = dict(zip(schema.names, row))
    elif hasattr(row, "asDict"):
        keyed = row.asDict()
    elif hasattr(row, "_asdict"):
        keyed = row._asdict()
    elif hasattr(row, "attributes"):
        keyed = dict(row.attributes() if callable(row.attributes) else row.attributes)
    elif hasattr(row, "__dict__"):
        keyed = vars(row)
    else:
        raise EncodeError(f"row {number}: a {type(row).__name__} isn't a row", row=number)
    try:
        return tuple(encode_field(keyed.get(f.name), f, f.name) for f in schema.fields)
    except EncodeError as e:
        raise EncodeError(f"row {number}, {e}", row=number, column=e.column, value=e.value) from e


# Columns


def _checked(value: Column, ok: Column, c: Column, what: str) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(what + ": "), F.coalesce(c.cast("string"), F.lit("null")))))


def column(c: Column, t: Type, source: str = "string") -> Column:
    """A Column converted strictly to type t.  source is the Column's own Spark type by name.

    Texts, numbers, dates and times are read by the same rules as Python values, all in Spark's own expressions,
    except that integer texts are plain decimal ones and times are ISO 8601.
    """
    k, text = t.kind, c.cast("string")
    target = spark_type(t)
    number = source in ("tinyint", "smallint", "int", "bigint", "float", "double") or source.startswith("decimal")
    if k == "boolean":
        if source == "boolean":
            return c
        low = F.lower(text)
        return _checked(low.isin(*TRUE), low.isin(*TRUE, *FALSE), c, "not a boolean")
    if k == "int":
        wide = text.try_cast("decimal(38,10)") if not number else c.try_cast("decimal(38,10)")
        low, high = (-(1 << (t.bits - 1)), (1 << (t.bits - 1)) - 1) if t.signed else (0, (1 << t.bits) - 1)
        whole = wide.try_cast("decimal(38,0)")
        ok = (wide == whole) & wide.between(F.lit(decimal.Decimal(low)), F.lit(decimal.Decimal(high)))
        if not number:
            ok &= F.trim(text).rlike(r"^[+-]?[0-9]+$")
        return _checked(whole.try_cast(target), ok, c, f"doesn't fit {t}")
    if k == "float":
        value = F.trim(text).try_cast("double") if not number else c.cast("double")
        return _checked(value.cast(target), value.isNotNull(), c, "not a number")
    if k == "decimal":
        value = (F.trim(text) if source in ("float", "double", "string") else c).try_cast(target)
        return _checked(value, value.isNotNull(), c, f"doesn't fit {t}")
    if k == "date":
        value = F.date_from_unix_date(c.cast("int")) if source in ("int", "bigint") else F.trim(text).try_cast("date") if source == "string" else c.try_cast("date")
        return _checked(value, value.isNotNull(), c, "not a date")
    if k == "timestamp" and t.unit != "nanos":
        if source in ("int", "bigint"):
            value = (F.timestamp_millis if t.unit == "millis" else F.timestamp_micros)(c.cast("bigint"))
            value = value if t.utc else value.cast(target)
        else:
            value = (F.trim(text) if source == "string" else c).try_cast(target)
        if t.unit == "millis":
            value = F.date_trunc("millisecond", value).cast(target)
        return _checked(value, value.isNotNull(), c, "not a time")
    if k == "time":
        per = TICKS[t.unit]
        if source in ("int", "bigint"):
            value = c.cast("bigint")
            return _checked(value.cast(target), value.between(0, 86400 * per - 1), c, "not within a day")
        m = lambda g: F.regexp_extract(F.trim(text), r"^(\d{1,2}):([0-5]\d)(?::([0-5]\d)(?:\.(\d{1,9}))?)?$", g)
        nanos = (m(1).try_cast("bigint") * 3600 + m(2).try_cast("bigint") * 60 + F.coalesce(m(3).try_cast("bigint"), F.lit(0))) * F.lit(10**9) + F.coalesce(F.rpad(m(4), 9, "0").try_cast("bigint"), F.lit(0))
        return _checked((nanos / F.lit(10**9 // per)).cast("bigint").cast(target), nanos < F.lit(86400 * 10**9), c, "not a time of day")
    if k == "uuid":
        h = F.lower(F.hex(c)) if source == "binary" else F.lower(F.regexp_replace(text, "-", ""))
        dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
        ok = F.length(h) == 32 if source == "binary" else F.lower(text).rlike("^([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$")
        return _checked(dashed, ok, c, "not a UUID")
    if k == "enum" and t.values is not None:
        pairs = [x if isinstance(x, tuple) else (x, None) for x in t.values]
        table = F.create_map(*(F.lit(y) for label, stored in pairs for key in ({str(label), str(stored)} if stored is not None else {str(label)}) for y in (key, str(label))))
        return _checked(table[text], F.map_contains_key(table, text), c, "not a label")
    if k == "fixed":
        raw = c.cast("binary")
        return _checked(raw, F.length(raw) == t.length, c, f"not {t.length} bytes")
    if k == "json" and (source.startswith(("struct", "array", "map"))):
        return F.to_json(c)
    return c.cast(target)


def half(c: Column) -> Column:
    """A float column rounded to 16-bit precision, ties to even, in plain expressions; what is too large becomes infinite."""
    x = c.cast("double")
    size = F.abs(x)
    near = F.floor(F.log2(size)).cast("double")
    exponent = F.when(F.pow(F.lit(2.0), near) > size, near - 1).when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).otherwise(near)
    step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14.0)) - 10)
    rounded = F.signum(x) * F.rint(size / step) * step
    return F.when(F.isnan(x) | (x == 0), x).when(size >= 65520, F.signum(x) * float("inf")).otherwise(rounded).cast("float")

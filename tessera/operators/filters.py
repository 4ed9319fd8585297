"""Conditions: a dict of column -> condition, all of which must hold, compiled to a Column.

A condition is None (is null), a scalar (equal), a list (any element), a Range, or a function.  A function gets the
Column and returns a boolean Column, which Spark can push down; udf(f) marks a Python predicate of values instead.
What can't be compared doesn't match: literals are typed here, so that no cast fails in a query.
"""

from __future__ import annotations

import datetime
import decimal
import enum
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Schema, Type


@dataclass(frozen=True)
class Range:
    """low to high; None is open; exclusive leaves high itself out."""

    low: Any = None
    high: Any = None
    exclusive: bool = False


def between(low: Any = None, high: Any = None, exclusive: bool = False) -> Range:
    return Range(low, high, exclusive)


@dataclass(frozen=True)
class udf:  # noqa: N801
    """A Python predicate of a value, called for nulls too."""

    f: Callable[[Any], bool]


def no() -> Column:
    return F.lit(False)


def _number(v: Any) -> bool:
    return isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool)


def literal(v: Any, t: Type) -> Column | None:
    """v as a literal that compares with a column of type t; None if it can't be compared."""
    if isinstance(v, enum.Enum):
        v = v.name
    k = t.kind
    if k in ("int", "float", "decimal", "time") or k == "timestamp" and t.unit == "nanos":
        if not _number(v) or isinstance(v, float) and math.isnan(v) or isinstance(v, decimal.Decimal) and v.is_nan():
            return None
        if isinstance(v, decimal.Decimal):
            return F.lit(float(v)) if v.is_infinite() or v.adjusted() > 37 else F.lit(v)
        if isinstance(v, int):
            return F.lit(v) if -(1 << 63) <= v < 1 << 63 else F.lit(decimal.Decimal(v)) if abs(v) < 10**38 else F.lit(float(v))
        return F.lit(v)
    if k == "boolean":
        return F.lit(v) if isinstance(v, bool) else None
    if k in ("string", "enum", "json", "uuid"):
        if isinstance(v, bytes):
            try:
                v = v.decode()
            except UnicodeDecodeError:
                return None
        return F.lit(v) if isinstance(v, str) else None
    if k in ("binary", "bson", "fixed", "other"):
        v = v.encode() if isinstance(v, str) else v
        return F.lit(bytearray(v)) if isinstance(v, (bytes, bytearray)) else None
    if k == "date":
        return F.lit(v) if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) else None
    if k in ("timestamp", "int96"):
        if not isinstance(v, datetime.datetime):
            return None
        utc = v.astimezone(datetime.UTC).replace(tzinfo=None) if v.tzinfo else v
        return F.lit(utc) if k == "timestamp" and not t.utc else F.timestamp_micros(F.lit((utc - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)))
    return None


def _compare(c: Column, v: Any, t: Type, how: Callable[[Column, Column], Column]) -> Column:
    """c compared with v.  A bound outside the column's type is widened; decimals and doubles compare numerically."""
    lit = literal(v, t)
    return no() if lit is None else how(c, lit)


def _one(c: Column, v: Any, t: Type, path: str) -> Column:
    if v is None:
        return c.isNull()
    if isinstance(v, (list, tuple, set, frozenset)):
        return _any(c, list(v), t, path)
    if isinstance(v, range):
        if v.step != 1:
            return _any(c, list(v), t, path)
        v = Range(v.start, v.stop, True)
    if isinstance(v, udf):
        return F.coalesce(F.udf(lambda x, f=v.f: bool(f(x)), T.BooleanType())(c), no())
    if isinstance(v, Range):
        if v.low is None and v.high is None:
            return c.isNotNull()
        out = []
        if v.low is not None:
            out.append(_compare(c, v.low, t, lambda a, b: a >= b))
        if v.high is not None:
            out.append(_compare(c, v.high, t, (lambda a, b: a < b) if v.exclusive else (lambda a, b: a <= b)))
        if t.kind == "float":  # a conjunct of its own, so that the comparison is pushed down; here NaN exceeds all numbers
            out.append(~F.isnan(c))
        return reduce(lambda a, b: a & b, out)
    if callable(v):
        made = v(c)
        if not isinstance(made, Column):
            raise ValueError(f"the function for {path!r} returned {type(made).__name__}: it gets a Column and returns one; wrap predicates of values in udf()")
        return F.coalesce(made, no())
    return _compare(c, v, t, lambda a, b: a == b)


def _any(c: Column, values: list, t: Type, path: str) -> Column:
    """isin() for the scalars, further disjuncts for the rest."""
    scalars, rest = [], []
    for v in values:
        plain = not (v is None or callable(v) or isinstance(v, (list, tuple, set, frozenset, range, Range, udf)))
        if plain:
            lit = literal(v, t)
            if lit is not None:
                scalars.append(lit)
        else:
            rest.append(_one(c, v, t, path))
    parts = ([c.isin(*scalars)] if scalars else []) + rest
    return reduce(lambda a, b: a | b, parts) if parts else no()


def column_of(schema: Schema, path: str) -> Column:
    return F.col(f"`{path}`") if path in schema.names else reduce(lambda c, part: c.getField(part), path.split(".")[1:], F.col(f"`{path.split('.')[0]}`"))


def compile_where(where: dict | None, schema: Schema) -> Column | None:
    """The Column of a where; null results don't occur, so that it can be negated."""
    if where is None:
        return None
    if not isinstance(where, dict):
        raise ValueError("where is a dict of column -> condition")
    parts = []
    for name, v in where.items():
        path = name.name if isinstance(name, enum.Enum) else str(name)
        t = schema.find(path).type
        if t.nested and not (v is None or isinstance(v, (udf, Range)) or callable(v)):
            same = isinstance(v, dict) and t.kind in ("struct", "map") or isinstance(v, (list, tuple))
            parts.append(_any(column_of(schema, path), [x for x in v if x is None], t, path) if same and isinstance(v, (list, tuple)) else no())
            continue
        parts.append(_one(column_of(schema, path), v, t, path))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def total(condition: Column) -> Column:
    """A condition with false in place of null."""
    return F.coalesce(condition, no())


def where_columns(where: dict) -> list[str]:
    return list(dict.fromkeys(str(k).split(".")[0] for k in where))

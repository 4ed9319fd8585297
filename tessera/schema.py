"""Schemas: declared, inferred, mapped from relational metadata, or read from a footer; with their algebra.

A Schema is a list of Fields.  It says more than a StructType does (unsigned integers, time units, JSON and enum
text, requiredness), so it keeps that in the metadata of the StructFields it makes, and finds it there again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import Conflict, IncompatibleSchema

META = "tessera"
UNITS = ("millis", "micros", "nanos")
#: Bits that a float's significand holds.
SIGNIFICANDS = {16: 11, 32: 24, 64: 53}
INTEGERS = {f"{'' if signed else 'u'}int{bits}": (bits, signed) for signed in (True, False) for bits in (8, 16, 32, 64)}
FLOATS = {"float16": 16, "float": 32, "double": 64}
PLAIN = ("boolean", "string", "json", "bson", "binary", "uuid", "date", "int96", "null")
TEXT = ("string", "enum", "json")


@dataclass(frozen=True)
class Type:
    """kind is one of boolean, int, float, string, enum, json, bson, binary, fixed, uuid, date, time, timestamp, int96,
    decimal, null, other, struct, list, map."""

    kind: str
    bits: int = 0
    signed: bool = True
    unit: str = ""
    utc: bool = True
    precision: int = 0
    scale: int = 0
    length: int = 0
    values: tuple | None = field(default=None, compare=False)
    fields: tuple[Field, ...] = ()
    name: str = ""

    def __str__(self) -> str:
        if self.kind == "int":
            return f"{'' if self.signed else 'u'}int{self.bits}"
        if self.kind == "float":
            return next(k for k, v in FLOATS.items() if v == self.bits)
        if self.kind in ("time", "timestamp"):
            return f"{'' if self.utc else 'local_'}{self.kind}({self.unit})"
        if self.kind == "decimal":
            return f"decimal({self.precision},{self.scale})"
        if self.kind == "fixed":
            return f"fixed({self.length})"
        if self.kind == "struct":
            return "struct<" + ", ".join(map(str, self.fields)) + ">"
        if self.kind == "list":
            return f"list<{self.fields[0].type}{'' if self.fields[0].nullable else '!'}>"
        if self.kind == "map":
            return f"map<{', '.join(f'{f.type}{"" if f.nullable else "!"}' for f in self.fields)}>"
        return self.name or self.kind

    @property
    def nested(self) -> bool:
        return self.kind in ("struct", "list", "map")


@dataclass(frozen=True)
class Field:
    name: str
    type: Type
    nullable: bool = True
    field_id: int | None = None
    #: A bare repeated field, which isn't wrapped in a list group.
    repeated: bool = False

    def __str__(self) -> str:
        return f"{self.name}:{self.type}{'' if self.nullable else '!'}"


def type_of(name: str, unit: str | None = None, precision: int | None = None, scale: int = 0, length: int | None = None, values: Any = None) -> Type:
    """The type that a declaration names."""
    if name in INTEGERS:
        bits, signed = INTEGERS[name]
        return Type("int", bits=bits, signed=signed)
    if name in FLOATS:
        return Type("float", bits=FLOATS[name])
    if name in PLAIN:
        return Type(name)
    if name == "enum":
        return Type("enum", values=tuple(values.items()) if isinstance(values, dict) else tuple(values) if values else None)
    if name in ("time", "local_time", "timestamp", "local_timestamp"):
        unit = unit or "micros"
        if unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}, not {unit!r}")
        return Type(name.removeprefix("local_"), unit=unit, utc=not name.startswith("local_"))
    if name == "decimal":
        if not precision or precision < 1 or not 0 <= scale <= precision:
            raise ValueError("decimal needs precision >= 1 and 0 <= scale <= precision")
        return Type("decimal", precision=precision, scale=scale)
    if name == "fixed":
        if not length or length < 1:
            raise ValueError("fixed needs a length")
        return Type("fixed", length=length)
    raise ValueError(f"unknown column type {name!r}")


class Builder:
    """Declares fields: b.int64("id", null=False), b.struct("address", lambda a: a.string("city"))."""

    def __init__(self):
        self.fields: list[Field] = []

    def _add(self, f: Field) -> None:
        if any(x.name == f.name for x in self.fields):
            raise ValueError(f"column {f.name!r} is declared twice")
        self.fields.append(f)

    def column(self, name: str, kind: str, null: bool = True, field_id: int | None = None, **more) -> None:
        self._add(Field(str(name), type_of(kind, **more), null, field_id))

    def __getattr__(self, kind: str):
        if kind.startswith("_"):
            raise AttributeError(kind)
        return lambda name, **more: self.column(name, kind, **more)

    def struct(self, name: str, declare: Callable[[Builder], Any], null: bool = True, field_id: int | None = None) -> None:
        inner = Builder()
        declare(inner)
        if not inner.fields:
            raise ValueError(f"struct {name!r} has no fields")
        self._add(Field(name, Type("struct", fields=tuple(inner.fields)), null, field_id))

    def _inner(self, kind: Any, name: str, nullable: bool, more: dict) -> Field:
        if callable(kind):
            inner = Builder()
            kind(inner)
            if len(inner.fields) == 1 and inner.fields[0].name == name:
                return replace(inner.fields[0], nullable=nullable)
            return Field(name, Type("struct", fields=tuple(inner.fields)), nullable)
        return Field(name, kind if isinstance(kind, Type) else type_of(kind, **more), nullable)

    def list(self, name: str, element: Any, null: bool = True, element_null: bool = True, field_id: int | None = None, **more) -> None:
        """element: a type's name, or a function that declares either "element" or the fields of a struct."""
        self._add(Field(name, Type("list", fields=(self._inner(element, "element", element_null, more),)), null, field_id))

    def map(self, name: str, key: Any, value: Any, null: bool = True, value_null: bool = True, field_id: int | None = None, **more) -> None:
        self._add(Field(name, Type("map", fields=(self._inner(key, "key", False, {}), self._inner(value, "value", value_null, more))), null, field_id))


class Schema:
    def __init__(self, fields: Iterable[Field]):
        self.fields = tuple(fields)

    @classmethod
    def build(cls, declare: Callable[[Builder], Any]) -> Schema:
        b = Builder()
        declare(b)
        if not b.fields:
            raise ValueError("a schema needs a field")
        return cls(b.fields)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"no column {name!r}")

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Schema) and self.fields == other.fields

    def __hash__(self) -> int:
        return hash(self.fields)

    def __repr__(self) -> str:
        return f"Schema({', '.join(map(str, self.fields))})"

    def find(self, path: str) -> Field:
        """The top-level field, or the struct member of a dotted path.  Nothing below a list or map can be named."""
        if any(f.name == path for f in self.fields):
            return self[path]
        at, fields, found = path.split("."), self.fields, None
        for k, part in enumerate(at):
            found = next((f for f in fields if f.name == part), None)
            if found is None:
                raise ValueError(f"no column {path!r}")
            if k + 1 < len(at):
                if found.type.kind in ("list", "map"):
                    raise ValueError(f"{path!r} lies inside the {found.type.kind} {'.'.join(at[: k + 1])!r}")
                fields = found.type.fields
        return found

    # algebra

    def only(self, *names: str) -> Schema:
        for n in names:
            self[n]
        if not names:
            raise ValueError("only() needs a column")
        return Schema(f for f in self.fields if f.name in names)

    def without(self, *names: str) -> Schema:
        for n in names:
            self[n]
        left = [f for f in self.fields if f.name not in names]
        if not left:
            raise ValueError("that leaves no column")
        return Schema(left)

    except_ = without

    def union(self, other: Schema) -> Schema:
        """All fields of both, this one's first, each widened to hold both sides' values."""
        return _merged(self, other, "union")

    def intersect(self, other: Schema) -> Schema:
        """The fields that both have, widened alike."""
        return _merged(self, other, "intersect")

    __add__ = __or__ = union
    __and__ = intersect

    def fits(self, other: Schema) -> list[Conflict]:
        """What keeps rows of this schema out of other: nothing if each field is other's or narrower."""
        return _misfits(self.fields, other.fields, "")

    # Spark

    def to_spark(self) -> T.StructType:
        return T.StructType([_struct_field(f) for f in self.fields])

    @classmethod
    def from_spark(cls, struct: T.StructType) -> Schema:
        return cls(_from_struct_field(f) for f in struct.fields)


# Spark types


def spark_type(t: Type) -> T.DataType:
    k = t.kind
    if k == "int":
        if t.signed:
            return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[t.bits]
        return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[t.bits]
    if k == "float":
        return T.DoubleType() if t.bits == 64 else T.FloatType()
    if k in ("string", "enum", "json", "uuid"):
        return T.StringType()
    if k in ("binary", "bson", "fixed", "other"):
        return T.BinaryType()
    if k == "time":
        return T.IntegerType() if t.unit == "millis" else T.LongType()
    if k == "timestamp":
        return T.LongType() if t.unit == "nanos" else T.TimestampType() if t.utc else T.TimestampNTZType()
    if k == "decimal":
        return T.DecimalType(t.precision, t.scale) if t.precision <= 38 else T.StringType()
    if k == "struct":
        return T.StructType([_struct_field(f) for f in t.fields])
    if k == "list":
        return T.ArrayType(spark_type(t.fields[0].type), t.fields[0].nullable)
    if k == "map":
        return T.MapType(spark_type(t.fields[0].type), spark_type(t.fields[1].type), t.fields[1].nullable)
    return {"boolean": T.BooleanType(), "date": T.DateType(), "int96": T.TimestampType(), "null": T.IntegerType()}[k]


def to_dict(f: Field) -> dict:
    t = f.type
    out: dict = {"name": f.name, "kind": t.kind, "nullable": f.nullable}
    out |= {k: getattr(t, k) for k in ("bits", "unit", "precision", "scale", "length", "name") if getattr(t, k) and k != "name"}
    out |= {k: False for k in ("signed", "utc") if not getattr(t, k)}
    if t.values is not None:
        out["values"] = [list(v) if isinstance(v, tuple) else v for v in t.values]
    if f.field_id is not None:
        out["field_id"] = f.field_id
    if f.repeated:
        out["repeated"] = True
    if t.fields:
        out["fields"] = [to_dict(x) for x in t.fields]
    return out


def from_dict(d: dict) -> Field:
    values = tuple(tuple(v) if isinstance(v, list) else v for v in d["values"]) if d.get("values") is not None else None
    t = Type(d["kind"], d.get("bits", 0), d.get("signed", True), d.get("unit", ""), d.get("utc", True), d.get("precision", 0), d.get("scale", 0), d.get("length", 0), values, tuple(map(from_dict, d.get("fields", ()))))
    return Field(d["name"], t, d["nullable"], d.get("field_id"), d.get("repeated", False))


def _struct_field(f: Field) -> T.StructField:
    meta: dict = {META: json.dumps(to_dict(f))}
    if f.field_id is not None:
        meta["parquet.field.id"] = f.field_id
    return T.StructField(f.name, spark_type(f.type), f.nullable, meta)


def _plain(dt: T.DataType) -> Type:
    if isinstance(dt, T.DecimalType):
        return Type("decimal", precision=dt.precision, scale=dt.scale)
    if isinstance(dt, T.StructType):
        return Type("struct", fields=tuple(_from_struct_field(f) for f in dt.fields))
    if isinstance(dt, T.ArrayType):
        return Type("list", fields=(Field("element", _plain(dt.elementType), dt.containsNull),))
    if isinstance(dt, T.MapType):
        return Type("map", fields=(Field("key", _plain(dt.keyType), False), Field("value", _plain(dt.valueType), dt.valueContainsNull)))
    names = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "timestamp_ntz": "local_timestamp", "void": "null"}
    return type_of(names.get(dt.simpleString(), dt.simpleString()))


def _from_struct_field(f: T.StructField) -> Field:
    if META in (f.metadata or {}):
        known = from_dict(json.loads(f.metadata[META]))
        if spark_type(known.type) == f.dataType or spark_type(known.type).simpleString() == f.dataType.simpleString():
            return replace(known, name=f.name)
    return Field(f.name, _plain(f.dataType), f.nullable, (f.metadata or {}).get("parquet.field.id"))


# widening


def widen(a: Type, b: Type) -> tuple[Type | None, str]:
    """The narrowest type that holds every value of both leaves exactly, or why there is none."""
    if a.kind == b.kind == "int":
        if a.signed == b.signed:
            return (a if a.bits >= b.bits else b), ""
        s, u = (a, b) if a.signed else (b, a)
        if u.bits == 64:
            return None, "no signed integer holds uint64"
        return Type("int", bits=max(s.bits, 2 * u.bits)), ""
    if {a.kind, b.kind} == {"int", "float"}:
        i, f = (a, b) if a.kind == "int" else (b, a)
        need = i.bits - i.signed
        for bits, holds in SIGNIFICANDS.items():
            if bits >= f.bits and holds >= need:
                return Type("float", bits=bits), ""
        return None, f"a double doesn't hold every {i}"
    if a.kind == b.kind == "float":
        return (a if a.bits >= b.bits else b), ""
    if a.kind == b.kind and a.kind in ("time", "timestamp"):
        if a.utc != b.utc:
            return None, "one is UTC, the other local"
        return (a if UNITS.index(a.unit) >= UNITS.index(b.unit) else b), ""
    if a.kind in TEXT and b.kind in TEXT:
        if a.kind == b.kind:
            return (a if a.values == b.values else replace(a, values=None)), ""
        return Type("string"), ""
    if {a.kind, b.kind} <= {*TEXT, "binary"}:
        return Type("binary"), ""
    if a.kind == b.kind == "decimal":
        return (a, "") if a == b else (None, "precision or scale differ")
    if a == b:
        return a, ""
    return None, "no common type"


def _merge_field(a: Field, b: Field, path: str, mode: str, conflicts: list[Conflict]) -> Field:
    def clash(reason: str) -> Field:
        conflicts.append(Conflict(path, str(a.type), str(b.type), reason))
        return a

    if a.field_id is not None and b.field_id is not None and a.field_id != b.field_id:
        return clash(f"field ids {a.field_id} and {b.field_id}")
    if a.repeated != b.repeated:
        return clash("only one is a bare repeated field")
    if a.type.nested or b.type.nested:
        if a.type.kind != b.type.kind:
            return clash("no common type")
        if a.type.kind == "struct":
            merged = replace(a.type, fields=tuple(_merge_members(a.type.fields, b.type.fields, path + ".", mode, conflicts)))
            if not merged.fields:
                return clash("no member in common")
        else:
            merged = replace(a.type, fields=tuple(_merge_field(x, y, f"{path}.{x.name}", mode, conflicts) for x, y in zip(a.type.fields, b.type.fields)))
    else:
        found, reason = widen(a.type, b.type)
        if found is None:
            return clash(reason)
        merged = found
    return Field(a.name, merged, a.nullable or b.nullable, a.field_id if a.field_id is not None else b.field_id, a.repeated)


def _merge_members(a: tuple[Field, ...], b: tuple[Field, ...], prefix: str, mode: str, conflicts: list[Conflict]) -> list[Field]:
    theirs = {f.name: f for f in b}
    mine = {f.name for f in a}
    out = []
    for f in a:
        if f.name in theirs:
            out.append(_merge_field(f, theirs[f.name], prefix + f.name, mode, conflicts))
        elif mode == "union":
            out.append(replace(f, nullable=True) if not f.repeated else f)
    if mode == "union":
        out += [replace(f, nullable=True) if not f.repeated else f for f in b if f.name not in mine]
    return out


def _merged(a: Schema, b: Schema, mode: str) -> Schema:
    conflicts: list[Conflict] = []
    fields = _merge_members(a.fields, b.fields, "", mode, conflicts)
    if not fields and not conflicts:
        conflicts.append(Conflict("", str(a), str(b), "no field in common"))
    if conflicts:
        raise IncompatibleSchema(conflicts, f"no {mode} of the schemas")
    return Schema(fields)


def _misfits(a: tuple[Field, ...], b: tuple[Field, ...], prefix: str) -> list[Conflict]:
    out: list[Conflict] = []
    theirs = {f.name: f for f in b}
    for f in a:
        path = prefix + f.name
        g = theirs.get(f.name)
        if g is None:
            out.append(Conflict(path, str(f.type), "absent", "the output has no such field"))
            continue
        if f.field_id is not None and g.field_id is not None and f.field_id != g.field_id:
            out.append(Conflict(path, str(f.type), str(g.type), f"field ids {f.field_id} and {g.field_id}"))
        elif f.nullable and not g.nullable:
            out.append(Conflict(path, f"{f.type}, nullable", f"{g.type}, required", "nulls don't fit a required field"))
        elif f.type.kind == g.type.kind and f.type.nested:
            if f.type.kind == "struct":
                out += _misfits(f.type.fields, g.type.fields, path + ".")
            else:
                out += _misfits(f.type.fields, tuple(replace(y, name=x.name) for x, y in zip(f.type.fields, g.type.fields)), path + ".")
        else:
            found, reason = widen(f.type, g.type) if not (f.type.nested or g.type.nested) else (None, "no common type")
            if found is None or found != g.type:
                out.append(Conflict(path, str(f.type), str(g.type), reason or "the output's type is narrower"))
    mine = {f.name for f in a}
    out += [Conflict(prefix + g.name, "absent", f"{g.type}, required", "a required field is missing") for g in b if g.name not in mine and not g.nullable]
    return out


# inference


def infer(rows: list[dict], extra: Callable[[Builder], Any] | None = None) -> Schema:
    """The schema of dict rows; declarations of extra replace inferred fields or are appended."""
    declared: list[Field] = []
    if extra:
        b = Builder()
        extra(b)
        declared = b.fields
    if not rows:
        raise ValueError("no rows to infer a schema from")
    names: dict[str, list] = {}
    for r in rows:
        for k in r:
            names.setdefault(str(k), [])
    for r in rows:
        keyed = {str(k): v for k, v in r.items()}
        for k, values in names.items():
            values.append(keyed.get(k))
    by_name = {f.name: f for f in declared}
    out = [by_name.pop(k, None) or Field(k, infer_type(v, k)) for k, v in names.items()]
    return Schema([*out, *by_name.values()])


def infer_type(values: list, path: str = "") -> Type:
    """The type of a column's Python values, by the first rule that all of them meet."""
    import datetime
    import decimal
    import enum

    v = [x for x in values if x is not None]
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not v:
        return Type("string")
    if all(isinstance(x, dict) for x in v):
        return Type("struct", fields=infer(v).fields)
    if all(isinstance(x, (list, tuple)) for x in v):
        return Type("list", fields=(Field("element", infer_type([y for x in v for y in x], path + ".element")),))
    if all(map(whole, v)):
        return type_of("int64")
    if all(isinstance(x, bool) for x in v):
        return Type("boolean")
    if all(whole(x) or isinstance(x, decimal.Decimal) for x in v):
        scale = max(max(0, -x.as_tuple().exponent) for x in v if isinstance(x, decimal.Decimal) and x.is_finite())
        return Type("decimal", precision=38, scale=scale)
    if all(whole(x) or isinstance(x, (float, decimal.Decimal)) for x in v):
        return Type("float", bits=64)
    if all(isinstance(x, (str, bytes, enum.Enum)) for x in v):
        return Type("binary") if any(isinstance(x, bytes) for x in v) else Type("string")
    if all(isinstance(x, datetime.datetime) for x in v):
        return type_of("timestamp", unit="micros")
    if all(isinstance(x, datetime.date) for x in v):
        return Type("date")
    kinds = ", ".join(sorted({type(x).__name__ for x in v}))
    raise ValueError(f"column {path!r} holds {kinds}: declare its type")


# relational metadata

#: Declared SQL types (without arguments) and the columns they become.
_SQL = {
    "smallint": "int16", "tinyint": "int8", "mediumint": "int32", "integer": "int32", "int": "int32", "bigint": "int64",
    "float4": "float", "real": "float", "float": "double", "float8": "double", "double": "double", "double precision": "double",
    "boolean": "boolean", "bool": "boolean", "json": "json", "jsonb": "json", "date": "date", "datetime": "timestamp", "timestamp": "timestamp",
    "timestamptz": "timestamp", "time": "time", "uuid": "uuid", "binary": "binary", "blob": "binary", "bytea": "binary", "varbinary": "binary", "xml": "string",
}


def relational_field(column: dict) -> Field:
    """column: name, sql_type, and optionally type, limit, precision, scale, unsigned, null, primary_key, array, values."""
    import re

    sql = column.get("sql_type", column.get("type", "string")).lower()
    unsigned = column.get("unsigned") or "unsigned" in sql
    array = column.get("array") or sql.endswith("[]")
    base = re.sub(r"\(.*?\)|\[\]|unsigned|zerofill", "", sql).strip()
    nullable = bool(column.get("null", True)) and not column.get("primary_key")
    if column.get("values") is not None or base == "enum":
        t = type_of("enum", values=column.get("values"))
    elif base == "hstore":
        t = Type("map", fields=(Field("key", Type("string"), False), Field("value", Type("string"))))
    elif base in ("decimal", "numeric"):
        p = column.get("precision")
        t = Type("decimal", precision=p or 38, scale=column.get("scale") or 0 if p else 9)
    elif base in _SQL:
        name = _SQL[base]
        if name in INTEGERS:
            bits, _ = INTEGERS[name]
            if base in ("integer", "int") and column.get("limit"):
                bits = next((b for b in (8, 16, 32, 64) if b >= 8 * column["limit"]), 64)
            if column.get("primary_key") and base != "smallint":
                bits, unsigned = 64, unsigned and bits == 64
            t = Type("int", bits=bits, signed=not unsigned)
        elif name in ("timestamp", "time"):
            t = type_of(name, unit="micros")
        else:
            t = type_of(name)
    else:
        t = Type("string")
    if array:
        t = Type("list", fields=(Field("element", t),))
    return Field(column["name"], t, nullable)


def from_relational(columns: Iterable[dict]) -> Schema:
    return Schema(relational_field(c) for c in columns)

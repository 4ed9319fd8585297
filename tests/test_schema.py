import datetime
import decimal

import pytest

from tessera.errors import IncompatibleSchema
from tessera.schema import Field, Schema, Type, from_relational, infer, type_of, widen


def build(f):
    return Schema.build(f)


@pytest.mark.parametrize("a, b, want", [
    ("int8", "int32", "int32"), ("uint8", "uint64", "uint64"), ("uint8", "int8", "int16"), ("uint16", "int8", "int32"), ("uint32", "int16", "int64"), ("uint64", "int8", None),
    ("int8", "float16", "float16"), ("int16", "float16", "float"), ("int16", "float", "float"), ("int32", "float", "double"), ("int32", "double", "double"), ("int64", "float", None), ("uint64", "double", None), ("uint32", "double", "double"),
    ("float16", "float", "float"), ("float", "double", "double"), ("string", "json", "string"), ("enum", "string", "string"), ("json", "json", "json"), ("string", "binary", "binary"),
    ("bson", "binary", None), ("uuid", "string", None), ("date", "timestamp", None), ("int96", "timestamp", None), ("string", "int32", None), ("boolean", "boolean", "boolean"), ("boolean", "int8", None),
])
def test_lattice(a, b, want):
    for x, y in ((a, b), (b, a)):
        got = widen(type_of(x), type_of(y))[0]
        assert (None if got is None else str(got)) == want


def test_times_and_decimals():
    assert str(widen(type_of("time", unit="millis"), type_of("time", unit="nanos"))[0]) == "time(nanos)"
    assert widen(type_of("timestamp"), type_of("local_timestamp"))[0] is None
    assert widen(type_of("decimal", precision=9, scale=2), type_of("decimal", precision=9, scale=3))[0] is None


def test_union_and_intersection():
    a = build(lambda s: (s.int64("id", null=False), s.struct("at", lambda x: (x.string("city"), x.int32("zip"))), s.list("tags", "string")))
    b = build(lambda s: (s.int32("id", null=False), s.string("phone", null=False), s.struct("at", lambda x: (x.string("city"), x.string("street"))), s.list("tags", "binary")))
    u = a + b
    assert u.names == ["id", "at", "tags", "phone"]
    assert not u["id"].nullable and str(u["id"].type) == "int64" and u["phone"].nullable
    assert str(u["at"].type) == "struct<city:string, zip:int32, street:string>" and str(u["tags"].type) == "list<binary>"
    i = a & b
    assert i.names == ["id", "at", "tags"] and str(i["at"].type) == "struct<city:string>"


def test_conflicts_are_all_told():
    a = build(lambda s: (s.int64("price"), s.struct("at", lambda x: x.int32("zip")), s.date("d"), s.int32("n", field_id=1)))
    b = build(lambda s: (s.double("price"), s.struct("at", lambda x: x.string("zip")), s.date("d"), s.int32("n", field_id=2)))
    with pytest.raises(IncompatibleSchema) as e:
        a.union(b)
    assert [c.path for c in e.value.conflicts] == ["price", "at.zip", "n"]
    with pytest.raises(IncompatibleSchema):
        build(lambda s: s.int32("a")) & build(lambda s: s.int32("b"))
    with pytest.raises(IncompatibleSchema):
        build(lambda s: s.struct("s", lambda x: x.int32("a"))) & build(lambda s: s.struct("s", lambda x: x.int32("b")))


def test_only_and_without():
    s = build(lambda b: (b.int32("a"), b.int32("b"), b.int32("c")))
    assert s.only("c", "a").names == ["a", "c"] and s.without("b").names == ["a", "c"]
    for bad in (lambda: s.only("x"), lambda: s.only(), lambda: s.without("a", "b", "c"), lambda: s.without("x")):
        with pytest.raises(ValueError):
            bad()


def test_equality_ignores_enum_values():
    assert build(lambda s: s.enum("e", values=["a"])) == build(lambda s: s.enum("e", values=["b"]))
    assert build(lambda s: s.int32("a")) != build(lambda s: s.int32("a", null=False))


def test_spark_round_trip():
    s = build(lambda b: (b.uint64("u", null=False), b.float16("h"), b.time("t", unit="nanos"), b.local_timestamp("l"), b.timestamp("n", unit="nanos"), b.uuid("id"), b.enum("e", values=["x"]), b.decimal("d", precision=9, scale=2), b.map("m", "string", "int64", value_null=False), b.list("ll", lambda e: e.list("element", "double")), b.fixed("f", length=5, field_id=7)))
    assert Schema.from_spark(s.to_spark()) == s


def test_inference():
    d = datetime
    rows = [
        {"i": 1, "f": 1.5, "s": "a", "b": b"x", "t": d.datetime(2024, 1, 1), "d": d.date(2024, 1, 1), "bool": True, "dec": decimal.Decimal("1.25"), "h": {"x": 1}, "l": [[1]], "lh": [{"a": 1}], "none": None, "mix": 1},
        {"i": None, "f": 2, "s": "b", "b": "y", "t": None, "d": d.datetime(2024, 1, 2), "bool": None, "dec": 3, "h": {"y": "z"}, "l": [], "lh": None, "none": None, "mix": 2.5, "late": 1},
    ]
    got = {f.name: str(f.type) for f in infer(rows).fields}
    assert got == {"i": "int64", "f": "double", "s": "string", "b": "binary", "t": "timestamp(micros)", "d": "date", "bool": "boolean", "dec": "decimal(38,2)", "h": "struct<x:int64, y:string>", "l": "list<list<int64>>", "lh": "list<struct<a:int64>>", "none": "string", "mix": "double", "late": "int64"}
    assert [str(f) for f in infer(rows, lambda b: (b.json("h"), b.int32("more"))).fields if f.name in ("h", "more")] == ["h:json", "more:int32"]
    for bad in ([], [{"a": 1}, {"a": "x"}], [{"a": True}, {"a": 1}]):
        with pytest.raises(ValueError):
            infer(bad)


def test_relational():
    got = from_relational([
        {"name": "id", "sql_type": "integer", "primary_key": True}, {"name": "n", "sql_type": "int", "limit": 2, "unsigned": True}, {"name": "s", "sql_type": "smallint", "null": False}, {"name": "f", "sql_type": "float4"}, {"name": "d", "sql_type": "decimal(10,3)", "precision": 10, "scale": 3},
        {"name": "p", "sql_type": "numeric"}, {"name": "j", "sql_type": "jsonb"}, {"name": "t", "sql_type": "timestamptz"}, {"name": "h", "sql_type": "hstore"}, {"name": "a", "sql_type": "integer[]"}, {"name": "e", "sql_type": "enum", "values": ["x"]}, {"name": "o", "sql_type": "point"},
    ])
    assert [str(f) for f in got.fields] == ["id:int64!", "n:uint16", "s:int16!", "f:float", "d:decimal(10,3)", "p:decimal(38,9)", "j:json", "t:timestamp(micros)", "h:map<string!, string>", "a:list<int32>", "e:enum", "o:string"]


def test_declaration_errors():
    for bad in (lambda b: b.nothing("x"), lambda b: b.decimal("x"), lambda b: b.fixed("x"), lambda b: b.time("x", unit="days"), lambda b: (b.int32("x"), b.int32("x")), lambda b: None):
        with pytest.raises(ValueError):
            build(bad)


def test_fits():
    narrow, wide = build(lambda s: (s.int32("a"), s.string("b"))), build(lambda s: (s.int64("a"), s.string("b"), s.date("c")))
    assert narrow.fits(wide) == []
    assert {c.path for c in wide.fits(narrow)} == {"a", "c"}
    assert narrow.fits(build(lambda s: (s.int32("a", null=False), s.string("b"), s.int32("must", null=False)))) != []
    assert Schema([Field("x", Type("string"), True, None, True)]).fits(build(lambda s: s.string("x"))) == []

import datetime
import decimal
import fractions

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.errors import EncodeError
from tessera.functions import coerce as C
from tessera.functions import privacy
from tessera.schema import Schema, Type, type_of

D = datetime


def bad(v, t):
    with pytest.raises(C.Misfit):
        C.encode(v, t)


def test_booleans():
    t = Type("boolean")
    assert [C.encode(v, t) for v in (True, 1, "T", "yes", "TRUE", False, 0, "f", "No", "0")] == [True] * 5 + [False] * 5
    for v in ("y", 2, 1.0, "", "on"):
        bad(v, t)


def test_integers():
    t = type_of("int16")
    assert [C.encode(v, t) for v in (5, 5.0, "5", " -7 ", "0x1A", "0b11", "017", "1_000", decimal.Decimal("3"), fractions.Fraction(4, 2))] == [5, 5, 5, -7, 26, 3, 15, 1000, 3, 2]
    for v in (5.5, "5.0", "abc", "", 40000, -40000, True, None, "1__0", float("nan"), "09"):
        bad(v, t)
    assert C.encode(2**64 - 1, type_of("uint64")) == decimal.Decimal(2**64 - 1)
    bad(-1, type_of("uint8"))


def test_decimals():
    t = type_of("decimal", precision=5, scale=2)
    for v, want in ((99.995, "100.00"), ("1.005", "1.01"), (-1.005, "-1.01"), (7, "7.00"), (fractions.Fraction(1, 3), "0.33"), (0.1, "0.10")):
        assert C.encode(v, t) == decimal.Decimal(want)
    for v in (1000, "x", float("inf"), 999.995, True):
        bad(v, t)


def test_dates_and_times():
    assert C.encode("2024-05-01", Type("date")) == C.encode(D.datetime(2024, 5, 1, 9), Type("date")) == C.encode(19844, Type("date")) == D.date(2024, 5, 1)
    ts, local = type_of("timestamp", unit="millis"), type_of("local_timestamp")
    noon = D.datetime(2024, 5, 1, 12, 0, 0, 123456, D.timezone(D.timedelta(hours=2)))
    assert C.encode(noon, ts) == D.datetime(2024, 5, 1, 10, 0, 0, 123000, D.UTC)
    assert C.encode(noon, local) == D.datetime(2024, 5, 1, 12, 0, 0, 123456)
    assert C.encode(D.date(2024, 5, 1), local) == D.datetime(2024, 5, 1)
    assert C.encode("2024-05-01T10:00:00.123456789Z", type_of("timestamp", unit="nanos")) == 1714557600123456789
    assert C.encode(D.datetime(1969, 12, 31, 23, 59, 59, 999999), ts) == D.datetime(1969, 12, 31, 23, 59, 59, 999000, D.UTC)
    assert C.encode("13:45:30.25", type_of("time", unit="millis")) == 49530250
    assert C.encode("9:05", type_of("time", unit="nanos")) == 32700 * 10**9
    for v in ("25:00", "10:60", "x", -1, 86400000):
        bad(v, type_of("time", unit="millis"))
    bad("yesterday", ts)


def test_other_kinds():
    u = "6f1c4b2a-0000-4000-8000-00000000abcd"
    assert C.encode(u.upper(), Type("uuid")) == C.encode(u.replace("-", ""), Type("uuid")) == C.encode(bytes.fromhex(u.replace("-", "")), Type("uuid")) == u
    bad("6f1c", Type("uuid"))
    e = type_of("enum", values={"open": 0, "done": 1})
    assert [C.encode(v, e) for v in ("open", 1)] == ["open", "done"]
    bad(2, e)
    assert C.encode({"a": [1, None]}, Type("json")) == '{"a":[1,null]}' and C.encode("raw", Type("json")) == "raw"
    assert C.encode(1 / 3, type_of("float16")) == 0.333251953125 and C.encode(65520, type_of("float16")) == float("inf")
    bad("toolong", type_of("fixed", length=3))


def test_rows_name_what_is_wrong():
    s = Schema.build(lambda b: (b.int32("id", null=False), b.struct("at", lambda a: a.int8("zip")), b.list("l", "int32", element_null=False)))
    assert C.encode_row({"id": "1", "at": {"zip": 5}}, s) == (1, (5,), None)
    assert C.encode_row([1, None, [2]], s) == (1, None, [2])
    for row, column in (({"id": None}, "id"), ({"id": 1, "at": {"zip": 300}}, "at.zip"), ({"id": 1, "l": [None]}, "l.element"), ({"id": 1, "no": 2}, "no")):
        with pytest.raises(EncodeError) as e:
            C.encode_row(row, s, 7)
        assert e.value.column == column and e.value.row == 7
    with pytest.raises(EncodeError):
        C.encode_row([1], s)


def test_columns_follow_values(spark):
    df = spark.createDataFrame([(" 12 ", "Yes", "2024-02-03", "1:02:03.5", "99.995"), (None, None, None, None, None)], "i string, b string, d string, t string, x string")
    cols = [C.column(F.col("i"), type_of("int16")), C.column(F.col("b"), Type("boolean")), C.column(F.col("d"), Type("date")), C.column(F.col("t"), type_of("time", unit="millis")), C.column(F.col("x"), type_of("decimal", precision=5, scale=2))]
    got = [tuple(r) for r in df.select(*(c.alias(str(k)) for k, c in enumerate(cols))).collect()]
    assert got == [(12, True, D.date(2024, 2, 3), 3723500, decimal.Decimal("100.00")), (None,) * 5]
    for value, t in (("70000", type_of("int16")), ("5.5", type_of("int16")), ("maybe", Type("boolean")), ("2024-13-01", Type("date")), ("24:00", type_of("time", unit="millis")), ("x", type_of("decimal", precision=5, scale=2)), ("zz", Type("uuid"))):
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION|fit|not a"):
            spark.createDataFrame([(value,)], "v string").select(C.column(F.col("v"), t)).collect()


@given(st.integers(-(2**63), 2**63 - 1))
def test_integer_texts(n):
    assert C.parse_integer(str(n)) == C.parse_integer(hex(n)) == n


def test_hmac(spark):
    import hashlib
    import hmac

    for key in (b"k", b"x" * 100):
        df = spark.createDataFrame([("anna@example.com",), ("",), (None,), ("é",)], "v string")
        want = [None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in ("anna@example.com", "", None, "é")]
        assert [r[0] for r in df.select(privacy.hmac_sha256(F.col("v"), key)).collect()] == want


def test_half_precision_in_expressions(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(0, 10.0 ** rnd.integers(-9, 6, 3000), 3000), 2.0 ** np.arange(-26, 17), 2.0 ** np.arange(-26, 17) * 1.00048828125, [0.0, -0.0, 65504, 65519.996, 65520, -65520, np.inf, -np.inf, np.nan, 1e38]]).astype(np.float32)
    with np.errstate(over="ignore"):
        want = x.astype(np.float16).astype(np.float32)
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v float").select(C.half(F.col("v"))).collect()]
    assert [repr(float(np.float32(g))) for g in got] == [repr(float(w)) for w in want]
    assert spark.range(1).select(C.half(F.lit(None).cast("float"))).first()[0] is None

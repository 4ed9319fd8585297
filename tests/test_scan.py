import datetime
import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import FormatError
from tessera.operators.filters import Range, between, compile_where, udf
from tessera.schema import Schema
from tessera.sources.reader import Reader, zone_of
from tessera.sources.writer import Options, write

D = datetime
N, GROUP, PAGE = 4000, 1000, 100
SCHEMA = Schema.build(lambda b: (b.int64("id", null=False), b.date("day"), b.string("status"), b.string("email"), b.decimal("amount", precision=12, scale=2), b.int64("maybe"), b.list("tags", "string"), b.struct("addr", lambda a: (a.string("city"), a.string("zip")))))
ROWS = [
    {"id": i, "day": D.date(2024, 1, 1) + D.timedelta(days=i // 100), "status": ("new", "paid", "shipped")[i % 3], "email": f"user{i * 7919 % N}@example.com", "amount": decimal.Decimal(i) / 100, "maybe": None if i % 5 == 0 else i,
     "tags": [f"t{k}" for k in range(i % 3)], "addr": None if i % 7 == 0 else {"city": ("AMS", "BER", "PAR")[i % 3], "zip": f"{i % 10000:04d}"}}
    for i in range(N)
]
LAYOUTS = {
    "bloom": Options(row_group_rows=GROUP, page_rows=PAGE, bloom_filters=["email"]),
    "v2": Options(row_group_rows=GROUP, page_rows=PAGE, data_page_version=2, compression="gzip"),
    "plain": Options(row_group_rows=GROUP, page_rows=PAGE, dictionary=False),
}


@pytest.fixture(scope="module", params=LAYOUTS)
def scan(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scan") / request.param)
    assert write(spark, path, ROWS, schema=SCHEMA, options=LAYOUTS[request.param]) == N
    return Reader(spark, path)


def holds(v, c):
    """A condition on a Python value, by its definition."""
    if c is None:
        return v is None
    if isinstance(c, list):
        return any(holds(v, x) for x in c)
    if isinstance(c, range):
        return v is not None and v in c
    if isinstance(c, udf):
        return c.f(v)
    if isinstance(c, Range):
        return v is not None and (c.low is None or v >= c.low) and (c.high is None or (v < c.high if c.exclusive else v <= c.high))
    return v == c


def value(row, path):
    for part in path.split("."):
        row = None if row is None else row[part]
    return row


QUERIES = [
    {"id": 1234}, {"id": between(999, 1010)}, {"id": between(N - 10)}, {"id": between(None, 7, True)}, {"day": D.date(2024, 1, 20)}, {"status": "paid", "id": range(100, 200)}, {"status": "shipped", "id": [3, 5, 8, 11, 3599]},
    {"email": "user0@example.com"}, {"email": "nobody@example.com"}, {"amount": between(decimal.Decimal("12.34"), decimal.Decimal("12.40"))}, {"maybe": None, "id": range(100)}, {"addr.city": "BER", "id": between(1000, 1050)}, {"addr.city": None, "id": range(50)},
    {"id": udf(lambda v: v % 800 == 0)}, {"id": 50_000}, {"id": between(1, 0)}, {"maybe": [None, 7, between(20, 22)], "id": range(40)}, {"maybe": between()}, {"status": []}, {"tags": None},
]


@pytest.mark.parametrize("where", QUERIES, ids=str)
def test_conditions_equal_a_full_scan(scan, where):
    want = [r["id"] for r in ROWS if all(holds(value(r, p), c) for p, c in where.items())]
    assert [r["id"] for r in scan.rows(columns=["id"], where=where)] == want
    planned = {base + i for p in scan.scan_plan(where) for base in [p["row_group"] * GROUP] for a, z in p["ranges"] for i in range(a, z)}
    assert set(want) <= planned


@pytest.mark.parametrize("start, limit", [(0, None), (0, 3), (999, 3), (1000, 1), (1234, 700), (N - 2, 10), (N + 5, None), (0, 0)])
def test_start_and_limit(scan, start, limit):
    want = [r["id"] for r in ROWS[start:]][: None if limit is None else limit]
    assert [r["id"] for r in scan.rows(columns=["id"], start=start, limit=limit)] == want
    assert scan.read(start=start, limit=limit).count() == len(want)


def test_start_counts_before_the_filter(scan):
    assert [r["id"] for r in scan.rows(columns=["id"], where={"status": "new"}, start=1400, limit=5)] == [1401, 1404, 1407, 1410, 1413]


def test_rows_and_order_of_columns(scan):
    assert scan.rows(limit=20) == ROWS[:20]
    assert list(scan.rows(columns=["status", "id"], limit=1)[0]) == ["status", "id"]
    assert scan.columns(columns=["id"], limit=3) == {"id": [0, 1, 2]}


def test_batches(scan):
    assert [len(b) for b in scan.each_batch(64, columns=["id"], limit=200)] == [64, 64, 64, 8]
    assert [r["id"] for r in scan.each_row(columns=["id"], limit=3)] == [0, 1, 2]
    with pytest.raises(ValueError):
        next(scan.each_batch(0))


def test_plan(scan):
    assert scan.scan_plan({"id": 1234}) == [{"row_group": 1, "rows": PAGE, "ranges": [[200, 300]]}]
    assert scan.scan_plan(None, 3500) == [{"row_group": 3, "rows": 500, "ranges": [[500, 1000]]}]
    assert scan.scan_plan({"id": "x"}) == [] and scan.num_rows == N and scan.row_groups == [GROUP] * 4


def test_bloom_and_pages(spark, scan):
    assert len(scan.page_index(0, "id")) == GROUP // PAGE
    bloom = scan.bloom_filter(0, "email")
    if bloom:
        assert bloom("user0@example.com") and not all(bloom(f"absent{i}") for i in range(20))


def test_pushdown(scan):
    text = scan.read(columns=["id"], where={"id": between(3, 5)})._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,3)" in text and "LessThanOrEqual(id,5)" in text and "email" not in text.split("ReadSchema")[-1]


def test_what_cannot_be_compared_does_not_match(scan):
    for where in ({"id": "not a number"}, {"status": 5}, {"day": D.datetime(2024, 1, 20)}, {"id": True}, {"amount": float("nan")}, {"id": between("a", "b")}):
        assert scan.read(where=where).count() == 0
    assert scan.read(where={"amount": 12.5}).count() == scan.read(where={"id": 1250.0}).count() == 1


def test_argument_errors(scan):
    for bad in (lambda: scan.read(where=[1], limit=0), lambda: scan.read(where={"no": 1}), lambda: scan.read(where={"tags.element": 1}), lambda: scan.read(columns=["no"]), lambda: scan.read(start=-1), lambda: scan.read(limit=-1), lambda: scan.read(where={"id": lambda c: True}), lambda: scan.scan_plan(start=-1)):
        with pytest.raises(ValueError):
            bad()


def test_floats(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (math.nan,), (None,), (5.0,), (math.inf,)], "v double")
    s = Schema.from_spark(df.schema)
    count = lambda c: df.filter(compile_where({"v": c}, s)).count()
    assert [count(c) for c in (0, math.nan, between(1), between(), [math.nan, 5], None)] == [2, 0, 2, 5, 1, 1]


def test_arrays(spark, tmp_path):
    s = Schema.build(lambda b: (b.int32("i"), b.int64("n"), b.boolean("b"), b.boolean("bn"), b.float("f"), b.list("l", "int32"), b.list("r", "int32"), b.string("s"), b.uint64("u"), b.uint8("u8")))
    rows = [{"i": k, "n": k or None, "b": k == 1, "bn": None if k else True, "f": k / 2, "l": [k, k + 1], "r": [k] * k, "s": str(k), "u": 2**64 - 1 - k, "u8": 200 + k} for k in range(3)]
    write(spark, str(tmp_path / "a"), rows, schema=s)
    got = Reader(spark, str(tmp_path / "a")).arrays()
    assert {k: v.dtype for k, v in got.items()} == {"i": np.int32, "n": np.float64, "b": bool, "bn": object, "f": np.float32, "l": np.int32, "r": object, "s": object, "u": np.uint64, "u8": np.uint8}
    assert got["l"].shape == (3, 2) and np.isnan(got["n"][0]) and got["u"][0] == 2**64 - 1
    none = Reader(spark, str(tmp_path / "a")).arrays(where={"i": 99})
    assert none["i"].dtype == np.int32 and len(none["i"]) == 0 and none["l"].dtype == object


def test_zones(spark, tmp_path):
    s = Schema.build(lambda b: (b.timestamp("at"), b.local_timestamp("wall")))
    write(spark, str(tmp_path / "z"), [{"at": D.datetime(2024, 5, 1, 12, tzinfo=D.UTC), "wall": D.datetime(2024, 5, 1, 12)}], schema=s)
    r = Reader(spark, str(tmp_path / "z"), time_zone="+02:00").rows()[0]
    assert r["at"].hour == 14 and r["at"].utcoffset() == D.timedelta(hours=2) and r["wall"] == D.datetime(2024, 5, 1, 12)
    assert zone_of(3600).utcoffset(None) == D.timedelta(hours=1) and zone_of("Europe/Berlin").key == "Europe/Berlin"
    for bad in ("nowhere", 1.5):
        with pytest.raises(ValueError):
            zone_of(bad)


def test_damage(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"PAR1 not really PAR1")
    with pytest.raises(FormatError):
        Reader(spark, str(tmp_path / "x.parquet"))
    with pytest.raises(FileNotFoundError):
        Reader(spark, str(tmp_path / "none"))


def test_pyarrow_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"u": pa.array([b"\0" * 15 + b"\1"] * 2, pa.binary(16)), "h": pa.array(np.array([1.5, -0.25], np.float16)), "t": pa.array([1, None], pa.time64("ns")), "ns": pa.array([5, 6], pa.timestamp("ns")), "big": pa.array([decimal.Decimal("1.5"), None], pa.decimal256(60, 1)), "f": pa.array([1.0, 2.0])})
    pq.write_table(t, tmp_path / "p.parquet", use_dictionary=False, column_encoding={"f": "BYTE_STREAM_SPLIT"})
    r = Reader(spark, str(tmp_path / "p.parquet"))
    assert r.rows() == [{"u": b"\0" * 15 + b"\1", "h": 1.5, "t": 1, "ns": 5, "big": "1.5", "f": 1.0}, {"u": b"\0" * 15 + b"\1", "h": -0.25, "t": None, "ns": 6, "big": None, "f": 2.0}]
    assert r.read(where={"h": between(None, 0)}).count() == 1
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", "true")


def test_several_files(spark, tmp_path):
    for k in range(3):
        write(spark, str(tmp_path / "m" / f"{k}"), [{"id": 10 * k + i} for i in range(10)])
    r = Reader(spark, str(tmp_path / "m"))
    assert [x["id"] for x in r.rows(start=15, limit=10)] == list(range(15, 25))
    assert r.num_rows == 30 and [p["row_group"] for p in r.scan_plan({"id": between(25)})] == [2]
    assert r.read(where={"id": lambda c: c % 10 == 0}).agg(F.sum("id")).first()[0] == 30

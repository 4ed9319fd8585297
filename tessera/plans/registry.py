"""The reference queries: each operator on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce, privacy
from ..operators import combine as C
from ..operators.filters import between
from ..operators.filters import udf as test_of
from ..operators.redact import Redaction
from ..operators.redact import udf as value_of
from ..schema import Schema, Type, type_of
from ..sources import keys as K
from ..sources import writer as W
from ..sources.inspect import Inspector
from ..sources.reader import Reader
from ..sources.storage import scratch
from ..streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}
HMAC_KEY = b"a key that isn't secret"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reader(spark: SparkSession, sf_dir: str, name: str) -> Reader:
    return Reader(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reader(spark, sf_dir, name).read()


def day(*ymd: int) -> datetime.datetime:
    return datetime.datetime(*ymd)


# scans


@query("SELECT * FROM lineitem")
def scan_full(spark, d):
    return plain(spark, d, "lineitem")


@query("SELECT l_shipdate, l_orderkey FROM lineitem")
def scan_project(spark, d):
    return reader(spark, d, "lineitem").read(columns=["l_shipdate", "l_orderkey"])


@query("SELECT sum(l_extendedprice) AS total, count(*) AS n FROM lineitem")
def scan_one_column(spark, d):
    return reader(spark, d, "lineitem").read(columns=["l_extendedprice"]).agg(F.sum("l_extendedprice").alias("total"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30' AND l_discount >= 0.05 AND l_quantity < 24 AND l_returnflag IN ('R', 'A')")
def scan_filter(spark, d):
    where = {"l_shipdate": between(day(1998, 1, 1), day(1998, 6, 30)), "l_discount": between(0.05), "l_quantity": between(None, 24, exclusive=True), "l_returnflag": ["R", "A"]}
    return reader(spark, d, "lineitem").read(columns=["l_orderkey", "l_extendedprice"], where=where)


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 1000")
def scan_offset(spark, d):
    return reader(spark, d, "orders").read(columns=["o_orderkey", "o_orderstatus"], start=1000)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= 500 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25")
def scan_offset_filter_limit(spark, d):
    return reader(spark, d, "orders").read(columns=["o_orderkey"], where={"o_orderstatus": "F"}, start=500, limit=25)


@query("SELECT event_id FROM events WHERE false")
def scan_limit_zero(spark, d):
    return reader(spark, d, "events").read(columns=["event_id"], limit=0)


# conditions


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 77")
def where_scalar(spark, d):
    return reader(spark, d, "orders").read(columns=["o_orderkey"], where={"o_custkey": 77})


@query("SELECT event_id FROM events WHERE nullif(event_type, 'error') IS NULL")
def where_null(spark, d):
    from ..operators.filters import compile_where

    df = plain(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return df.filter(compile_where({"kind": None}, Schema.from_spark(df.schema))).select("event_id")


@query("SELECT event_id FROM events WHERE nullif(event_type, 'error') IS NULL OR event_type = 'click' OR event_type BETWEEN 'p' AND 'q'")
def where_list_with_null_and_range(spark, d):
    from ..operators.filters import compile_where

    df = plain(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return df.filter(compile_where({"kind": [None, "click", between("p", "q"), 5]}, Schema.from_spark(df.schema))).select("event_id")


@query("SELECT p_partkey FROM part WHERE false")
def where_empty_list(spark, d):
    return reader(spark, d, "part").read(columns=["p_partkey"], where={"p_size": []})


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice < 950.5")
def where_ranges(spark, d):
    return reader(spark, d, "part").read(columns=["p_partkey"], where={"p_size": range(10, 21), "p_retailprice": between(None, 950.5, True)})


@query("SELECT count(*) AS n FROM part WHERE p_brand IS NOT NULL")
def where_open_range(spark, d):
    return reader(spark, d, "part").read(where={"p_brand": between()}).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal * 2 > 9000")
def where_column_function(spark, d):
    return reader(spark, d, "supplier").read(columns=["s_suppkey"], where={"s_acctbal": lambda c: c * 2 > 9000})


@query("SELECT s_suppkey FROM supplier WHERE s_name LIKE '%7'")
def where_value_function(spark, d):
    return reader(spark, d, "supplier").read(columns=["s_suppkey"], where={"s_name": test_of(lambda v: v is not None and v.endswith("7"))})


@query("SELECT o_orderkey FROM orders WHERE false")
def where_mismatched_types(spark, d):
    r = reader(spark, d, "orders")
    parts = [r.read(columns=["o_orderkey"], where={"o_orderkey": "not a number"}), r.read(columns=["o_orderkey"], where={"o_orderdate": datetime.date(1998, 10, 3)}), r.read(columns=["o_orderkey"], where={"o_totalprice": float("nan")})]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def where_struct_member(spark, d):
    from ..operators.filters import compile_where

    df = plain(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("at"))
    return df.filter(compile_where({"at.nation": 3, "at.segment": "BUILDING"}, Schema.from_spark(df.schema))).select("c_custkey")


@query("SELECT event_id FROM events WHERE value = 0.0 OR (value > 90 AND value % 7 <> 0)")
def where_float_nan_guard(spark, d):
    from ..operators.filters import compile_where

    # zero stays, as it is asked for; other multiples of 7 are NaN, which no condition matches
    v = F.when((F.col("value") % 7 == 0) & (F.col("value") != 0), F.lit(float("nan"))).otherwise(F.col("value"))
    df = plain(spark, d, "events").select("event_id", v.alias("v"))
    return df.filter(compile_where({"v": [0.0, between(math.nextafter(90.0, math.inf)), float("nan")]}, Schema.from_spark(df.schema))).select("event_id")


# redaction


@query("SELECT * FROM orders WHERE NOT (coalesce(o_custkey = 77, false) OR o_orderdate < TIMESTAMP '1996-01-01')")
def redact_delete(spark, d):
    r = Redaction().where(o_custkey=77).delete().where(o_orderdate=between(None, day(1996, 1, 1), True)).delete()
    return r.apply(plain(spark, d, "orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' THEN '[gone]' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def redact_replace_constants(spark, d):
    r = Redaction().where(o_orderstatus="F").replace(o_totalprice=None, o_orderpriority="[gone]").drop("o_custkey", "o_orderstatus", "o_orderdate")
    return r.apply(plain(spark, d, "orders"))


@query(
    """SELECT o_orderkey, s2 AS o_orderstatus, p2 AS o_totalprice FROM (
    SELECT *, CASE WHEN s1 = 'X' AND o_orderkey % 2 = 0 THEN 'Y' ELSE s1 END AS s2, CASE WHEN s1 = 'X' THEN o_totalprice + 1 ELSE o_totalprice END AS p2
    FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS s1 FROM orders)) WHERE NOT s2 = 'Y'"""
)
def redact_in_order(spark, d):
    r = Redaction().where(o_orderstatus="F").replace(o_orderstatus="X")
    r.where(o_orderstatus="X").replace(o_totalprice=lambda c: c + 1)
    r.where(o_orderstatus="X", o_orderkey=lambda c: c % 2 == 0).replace(o_orderstatus="Y").where(o_orderstatus="Y").delete()
    return r.apply(plain(spark, d, "orders")).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT count(*) AS rows_read, count(*) FILTER (o_custkey < 100) AS rows_deleted, count(*) FILTER (o_custkey >= 100 AND o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT') AS rows_changed FROM orders")
def redact_report(spark, d):
    r = Redaction().where(o_custkey=between(None, 100, True)).delete().where(o_orderstatus="O").replace(o_orderpriority="1-URGENT")
    return r.counts(plain(spark, d, "orders"))


@query("SELECT c_custkey, upper(c_name) || '/' || c_mktsegment AS c_name, CASE WHEN c_nationkey = 3 THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def redact_with_row(spark, d):
    """The first target sees the row as it was, and a Python function runs on matching rows only."""
    r = Redaction().replace(c_name=lambda c, row: F.concat(F.upper(c), F.lit("/"), row["c_mktsegment"])).where(c_nationkey=3).replace(c_mktsegment=value_of(lambda v: "M"))
    return r.apply(plain(spark, d, "customer")).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'none' WHEN c_nationkey = 5 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def redact_struct_member(spark, d):
    at = F.when(F.col("c_nationkey") != 5, F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))
    df = plain(spark, d, "customer").select("c_custkey", "c_nationkey", at.alias("at"))
    r = Redaction().where(c_nationkey=[3, 5]).replace({"at.segment": "none"}).drop("at.balance")
    return r.apply(df).select("c_custkey", F.col("at.segment").alias("segment"))


@query("SELECT * FROM orders WHERE NOT (o_custkey BETWEEN 10 AND 20)")
def redact_files(spark, d):
    """Written to files and read back."""
    target = scratch(spark, "redacted")
    Redaction().where(o_custkey=range(10, 21)).delete().run(spark, reader(spark, d, "orders"), target)
    return Reader(spark, target).read()


def _partitioned(spark, d, name="partitioned"):
    """orders in folders by status and year, whose files have one base name."""
    path, r = scratch(spark, name), reader(spark, d, "orders")
    df = r.read().withColumn("year", F.year("o_orderdate")).withColumnRenamed("o_orderstatus", "status")
    W.write_sorted(df, path, ["o_orderkey"], r.num_rows, partition_by=["status", "year"])
    return path


_PARTITIONED = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, {p} AS o_orderpriority, o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"


@query(_PARTITIONED.format(p="CASE WHEN o_orderstatus = 'P' THEN '-' ELSE o_orderpriority END") + " WHERE NOT (o_custkey BETWEEN 10 AND 20) AND NOT (o_orderstatus = 'O' AND year(o_orderdate) = 1997)")
def redact_partitioned(spark, d):
    """Files of one base name in many folders: untouched ones are copied, the others rewritten, each below its own folder."""
    source, target = _partitioned(spark, d), scratch(spark, "redacted")
    Redaction().where(o_custkey=range(10, 21)).delete().where(status="O", year=1997).delete().where(status="P").replace(o_orderpriority="-").run(spark, source, target)
    return Reader(spark, target).read()


@query(_PARTITIONED.format(p="o_orderpriority"))
def redact_partitioned_copies(spark, d):
    """A deletion that matches nothing loses nothing."""
    source, target = _partitioned(spark, d), scratch(spark, "redacted")
    Redaction().where(o_orderkey=-1).delete().run(spark, source, target)
    return Reader(spark, target).read()


@query("SELECT o_orderkey, o_orderstatus AS status FROM (SELECT *, row_number() OVER (ORDER BY o_orderstatus, year(o_orderdate), o_orderkey) AS n FROM orders) WHERE n > 700 AND n <= 1200")
def scan_offset_partitioned(spark, d):
    return Reader(spark, _partitioned(spark, d)).read(columns=["o_orderkey", "status"], start=700, limit=500)


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) BETWEEN 1995 AND 1997")
def scan_partition_columns(spark, d):
    return Reader(spark, _partitioned(spark, d)).read(columns=["o_orderkey", "year"], where={"status": "F", "year": between(1995, 1997)})


def _hmac_sql(column: str) -> str:
    block = HMAC_KEY.ljust(64, b"\0")
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in block) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({column}))))"


@query(f"SELECT c_custkey, {_hmac_sql('c_name')} AS pseudonym FROM customer")
def pseudonym_hmac(spark, d):
    r = Redaction().replace(c_name=lambda c: privacy.hmac_sha256(c, HMAC_KEY))
    return r.apply(plain(spark, d, "customer")).select("c_custkey", F.col("c_name").alias("pseudonym"))


@query("SELECT c_custkey, lpad(right(c_name, 4), length(c_name)::INTEGER, '*') AS masked, '***' || right(c_name, 3) AS tail, regexp_replace(c_name || '@x.org', '^(.).*@', '\\1***@') AS email FROM customer")
def mask_text(spark, d):
    c = F.col("c_name")
    return plain(spark, d, "customer").select("c_custkey", privacy.keep_last(c).alias("masked"), privacy.mask_prefix(c).alias("tail"), privacy.mask_email(F.concat(c, F.lit("@x.org"))).alias("email"))


@query("SELECT o_orderkey, CAST(CAST(date_trunc('year', o_orderdate) AS DATE) AS VARCHAR) AS year FROM orders")
def mask_dates(spark, d):
    return plain(spark, d, "orders").select("o_orderkey", privacy.year_only(F.col("o_orderdate").cast("date")).cast("string").alias("year"))


# combination and schemas


@query("SELECT * FROM orders UNION ALL SELECT * FROM orders")
def combine_same(spark, d):
    """The files' bytes, twice."""
    target = scratch(spark, "combined")
    C.combine(spark, [reader(spark, d, "orders")] * 2, target)
    return Reader(spark, target).read()


@query("SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL::DOUBLE AS size FROM customer UNION ALL SELECT p_partkey, p_name, NULL, NULL, p_size FROM part")
def combine_union(spark, d):
    a = plain(spark, d, "customer").selectExpr("c_custkey key", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    b = plain(spark, d, "part").selectExpr("p_name name", "p_partkey key", "p_size size")
    return C.combine_frames([_bare(a), _bare(b)], "union").withColumn("size", F.col("size").cast("double"))


@query("SELECT c_custkey AS key, CAST(c_nationkey AS DOUBLE) AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def combine_intersect_widened(spark, d):
    a = plain(spark, d, "customer").selectExpr("c_custkey key", "c_nationkey v", "c_name name")
    b = plain(spark, d, "supplier").selectExpr("s_suppkey key", "s_acctbal v")
    return C.combine_frames([_bare(a), _bare(b)], "intersect")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, NULL::VARCHAR AS note FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def combine_into_schema(spark, d):
    want = Schema.build(lambda b: (b.int64("k"), b.string("name"), b.string("note")))
    a = plain(spark, d, "nation").selectExpr("n_nationkey k", "n_name name")
    b = plain(spark, d, "region").selectExpr("r_regionkey k", "r_name name")
    return C.combine_frames([_bare(a), _bare(b)], want)


def _bare(df: DataFrame) -> DataFrame:
    """df without the field metadata of its source's names."""
    return df.select(*(F.col(c).alias(c, metadata={}) for c in df.columns))


_WIDENED = [("int8", "int32", "int32"), ("uint16", "int8", "int32"), ("uint32", "int64", "int64"), ("uint64", "int64", "-"), ("int16", "float", "float"), ("int32", "float", "double"), ("int64", "double", "-"), ("uint8", "float16", "float16"), ("float16", "double", "double"), ("string", "json", "string"), ("string", "binary", "binary"), ("date", "timestamp", "-"), ("string", "int32", "-")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _WIDENED) + ") t(a, b, widened)")
def schema_widening(spark, d):
    from ..schema import widen

    rows = [(a, b, str(widen(type_of(a), type_of(b))[0] or "-")) for a, b, _ in _WIDENED]
    return spark.createDataFrame(rows, "a string, b string, widened string")


@query("SELECT n_name FROM nation")
def schema_only(spark, d):
    r = reader(spark, d, "nation")
    return r.read(columns=r.schema.without("n_nationkey").only("n_name").names)


# sinks


@query("SELECT * FROM lineitem")
def sink_round_trip(spark, d):
    path = scratch(spark, "sink")
    W.write_frame(plain(spark, d, "lineitem"), path, options=W.Options(compression="zstd", compression_level=3, data_page_version=2, bloom_filters=["l_orderkey"], row_group_rows=100_000))
    return Reader(spark, path).read()


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, length(n_name) % 2 = 0 AS even FROM nation")
def sink_inferred_rows(spark, d):
    """Dict rows from Python, of a table of fixed size, with an inferred schema."""
    path = scratch(spark, "inferred")
    rows = ({"key": r["n_nationkey"], "name": r["n_name"], "even": len(r["n_name"]) % 2 == 0} for r in reader(spark, d, "nation").each_row())
    W.write(spark, path, rows)
    return Reader(spark, path).read()


@query("SELECT event_id, ts, value FROM events WHERE value > 50")
def stream_scan(spark, d):
    """The table's files as a stream, filtered, appended to a folder exactly once, and read back."""
    r, source, out = reader(spark, d, "events"), scratch(spark, "stream"), scratch(spark, "stream")
    W.write_frame(r.read(), source)
    found = streams.scan_stream(spark, source, r.schema, columns=["event_id", "ts", "value"], where={"value": lambda c: c > 50})
    streams.write_stream(found, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return Reader(spark, f"{out}/data").read()


@query("SELECT c_custkey, c_name FROM customer")
def encrypted_round_trip(spark, d):
    path, footer, name = scratch(spark, "encrypted"), K.Key.generate(), K.Key.generate(128)
    K.write_encrypted(reader(spark, d, "customer").read(columns=["c_custkey", "c_name"]), path, K.Encryption(footer, {"c_name": name}))
    return K.read_encrypted(spark, path, [footer, name])


# conversions


@query("SELECT event_id, event_id % 2 = 0 AS flag FROM events")
def coerce_boolean(spark, d):
    text = F.when(F.col("event_id") % 4 == 0, "Yes").when(F.col("event_id") % 2 == 0, "t").when(F.col("event_id") % 3 == 0, "FALSE").otherwise("0")
    return plain(spark, d, "events").select("event_id", coerce.column(text, Type("boolean")).alias("flag"))


@query("SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS n, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS known, round(o_totalprice, 1)::DOUBLE AS price FROM orders")
def coerce_numbers(spark, d):
    c = F.col("o_custkey").cast("string")
    price = coerce.column(F.col("o_totalprice").cast("string"), type_of("decimal", precision=18, scale=1))
    return plain(spark, d, "orders").select("o_orderkey", coerce.column(c, type_of("int32")).alias("n"), F.col("o_totalprice").isNotNull().alias("known"), price.cast("double").alias("price"))


@query("SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, date_trunc('millisecond', ts) AS at, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000 AS tick FROM events")
def coerce_times(spark, d):
    ts = F.col("ts")
    day_text, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "H:mm:ss")
    return plain(spark, d, "events").select("event_id", coerce.column(day_text, Type("date")).cast("string").alias("day"), coerce.column(ts, type_of("local_timestamp", unit="millis"), "timestamp_ntz").alias("at"), coerce.column(clock, type_of("time", unit="millis")).cast("long").alias("tick"))


@query("SELECT p_partkey, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS id, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM (SELECT *, md5(p_name || p_partkey) AS h FROM part)")
def coerce_uuid_and_labels(spark, d):
    df = plain(spark, d, "part")
    h = F.upper(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))))
    label = coerce.column((F.col("p_size") % 2).cast("string"), type_of("enum", values={"even": 0, "odd": 1}))
    return df.select("p_partkey", coerce.column(h, Type("uuid")).alias("id"), label.alias("label"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS at FROM events")
def render_times(spark, d):
    df = plain(spark, d, "events")
    return df.select("event_id", privacy.renderable(F.col("ts"), df.schema["ts"].dataType).alias("at"))


# inspection


@query("SELECT 'o_orderkey' AS \"column\", count(*) AS \"values\", count(*) - count(o_orderkey) AS nulls FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus) FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', count(*), count(*) - count(o_orderdate) FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(*) - count(o_orderpriority) FROM orders")
def inspect_columns(spark, d):
    return Inspector(spark, f"{d.rstrip('/')}/orders.parquet").columns().select("column", "values", "nulls")


@query("SELECT count(*) AS rows FROM lineitem")
def inspect_summary(spark, d):
    return Inspector(spark, f"{d.rstrip('/')}/lineitem.parquet").summary().agg(F.sum("rows").alias("rows"))


@query("SELECT min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders")
def inspect_bounds(spark, d):
    c = Inspector(spark, f"{d.rstrip('/')}/orders.parquet").columns().filter("column = 'o_orderkey'")
    return c.select(F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


#: SQL can't ask a view for its file, so what inspection finds is compared on the tables that the driver compares on.
_FILE = "parquet_metadata('/root/testdata/sf0.01/lineitem.parquet')"


@query(f"SELECT row_group_id AS row_group, path_in_schema AS \"column\", type AS physical, compression AS codec, num_values AS \"values\", stats_null_count AS nulls, total_compressed_size AS compressed, total_uncompressed_size AS uncompressed, data_page_offset AS data_offset, dictionary_page_offset AS dictionary_offset, row_group_num_rows AS \"rows\" FROM {_FILE}")
def inspect_chunks(spark, d):
    return Inspector(spark, f"{d.rstrip('/')}/lineitem.parquet").chunks().select("row_group", "column", "physical", "codec", "values", "nulls", "compressed", "uncompressed", "data_offset", "dictionary_offset", "rows")


@query(f"SELECT *, s - coalesce(lag(e) OVER (ORDER BY s), 4) AS gap FROM (SELECT row_group_id AS row_group, path_in_schema AS \"column\", least(data_page_offset, coalesce(dictionary_page_offset, data_page_offset)) AS s, s + total_compressed_size AS e FROM {_FILE})")
def inspect_layout(spark, d):
    return Inspector(spark, f"{d.rstrip('/')}/lineitem.parquet").layout().drop("file").withColumnsRenamed({"start": "s", "end": "e"})


@query("SELECT 'absent' AS status")
def inspect_checksums(spark, d):
    """The tables are written without checksums."""
    return Inspector(spark, f"{d.rstrip('/')}/orders.parquet").checksums().select("status")


@query("SELECT count(*) AS rows FROM orders")
def scan_plan_rows(spark, d):
    plan = reader(spark, d, "orders").scan_plan({"o_orderkey": between(0)})
    return spark.createDataFrame([(sum(p["rows"] for p in plan),)], "rows long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_filter(spark, sf_dir)

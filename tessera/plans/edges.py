"""More queries: explanations, batches and arrays, sinks' physical properties, conversions, errors, keys and the command line.

Those that report on files write them first, with known row groups, so that SQL over the tables can tell what must come out.
"""

from __future__ import annotations

import contextlib
import enum
import io
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..errors import TesseraError
from ..functions import coerce, privacy
from ..operators import combine as C
from ..operators.filters import between
from ..operators.redact import Redaction
from ..schema import Schema, infer, type_of
from ..sources import keys as K
from ..sources import writer as W
from ..sources.footer import copy_changed, copy_files, plain_hash
from ..sources.inspect import Inspector
from ..sources.reader import Reader
from ..sources.relational import read_table, shipped_table
from ..sources.storage import scratch
from ..streaming import streams
from .registry import plain, query, reader

GROUP_ROWS, PAGE_ROWS = 1000, 100
#: Row groups of a file: keys below so many rows' worth go to one file, so that every file but the last has whole groups.
FILE_GROUPS = 500


def _rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def _values(rows: list[tuple], columns: str) -> str:
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


def _raised(cases: dict[str, Callable[[], Any]]) -> list[tuple[str, str]]:
    """(case, the error's class), "none" where nothing is raised."""
    out: list[tuple[str, str]] = []
    for name, f in cases.items():
        try:
            f()
            out.append((name, "none"))
        except (TesseraError, ValueError, FileNotFoundError) as e:
            out.append((name, type(e).__name__))
    return out


def _grouped(spark: SparkSession, d: str, **more) -> str:
    """orders by key in files of row groups of GROUP_ROWS rows and pages of PAGE_ROWS, each file sorted and written by a task of its own."""
    path, r = scratch(spark, "grouped"), reader(spark, d, "orders")
    rows = FILE_GROUPS * GROUP_ROWS
    # twice as many ranges as files, so that no two files' keys are drawn into one range; an empty range leaves no file
    df = r.read().repartitionByRange(max(1, 2 * -(-r.num_rows // rows)), F.floor(F.col("o_orderkey") / rows)).sortWithinPartitions("o_orderkey")
    W.write_frame(df, path, options=W.Options(row_group_rows=GROUP_ROWS, page_rows=PAGE_ROWS, **more))
    return path


# explanations and lookups


@query(f"SELECT count(DISTINCT o_orderkey // {GROUP_ROWS}) AS row_groups, {PAGE_ROWS} * count(DISTINCT o_orderkey // {PAGE_ROWS}) AS \"rows\" FROM orders WHERE o_orderkey BETWEEN 1950 AND 3040")
def scan_plan_prunes(spark, d):
    """Statistics rule row groups out, the page index pages."""
    plan = Reader(spark, _grouped(spark, d)).scan_plan({"o_orderkey": between(1950, 3040)})
    return _rows(spark, [(len(plan), sum(p["rows"] for p in plan))], "row_groups long, rows long")


@query(f"SELECT o_orderkey // {PAGE_ROWS} AS page, min(o_orderkey % {GROUP_ROWS}) AS first_row, count(*) AS \"rows\" FROM orders WHERE o_orderkey // {GROUP_ROWS} = 2 GROUP BY 1")
def scan_page_index(spark, d):
    pages = Reader(spark, _grouped(spark, d)).page_index(2, "o_orderkey")
    return _rows(spark, [(2 * GROUP_ROWS // PAGE_ROWS + k, p.first_row, p.rows) for k, p in enumerate(pages)], "page long, first_row long, rows long")


@query("SELECT o_custkey FROM orders WHERE o_orderkey < 1000 GROUP BY 1")
def scan_bloom_filter(spark, d):
    """A bloom filter never denies a value that its chunk has."""
    r = Reader(spark, _grouped(spark, d, bloom_filters=["o_custkey"]))
    ask = r.bloom_filter(0, "o_custkey")
    held = {x["o_custkey"] for x in r.rows(columns=["o_custkey"], where={"o_orderkey": between(None, 1000, exclusive=True)})}
    return _rows(spark, [(x,) for x in held if ask(x)], "o_custkey long")


@query(f"SELECT o_orderkey // {GROUP_ROWS} AS row_group, count(*) AS \"rows\" FROM orders GROUP BY 1")
def scan_row_groups(spark, d):
    r = Reader(spark, _grouped(spark, d))
    groups = r.row_groups
    if r.num_rows != sum(groups) or r.encrypted:
        raise AssertionError("row groups don't add up")
    return _rows(spark, list(enumerate(groups)), "row_group long, rows long")


# rows, batches, arrays


@query("SELECT k AS batch, least(700, n - 700 * k) AS \"rows\" FROM (SELECT count(*) AS n FROM orders), generate_series(0, 10000) t(k) WHERE 700 * k < n")
def batches_are_full(spark, d):
    r = Reader(spark, _grouped(spark, d))
    return _rows(spark, [(k, len(b)) for k, b in enumerate(r.each_batch(700, columns=["o_orderkey"]))], "batch long, rows long")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 950 AND o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 1300")
def batches_with_offset_and_limit(spark, d):
    """An offset before the filter and a limit after it, over row groups, as column batches."""
    r, rows = Reader(spark, _grouped(spark, d)), []
    for b in r.each_batch(300, "columns", columns=["o_orderkey", "o_orderstatus"], where={"o_orderstatus": ["F", "O"]}, start=950, limit=1300):
        rows += zip(b["o_orderkey"], b["o_orderstatus"])
    return _rows(spark, rows, "o_orderkey long, o_orderstatus string")


@query("SELECT 'c_custkey' AS \"column\", 'int64' AS dtype, sum(c_custkey)::DOUBLE AS total FROM customer UNION ALL SELECT 'c_acctbal', 'float64', round(sum(c_acctbal), 2) FROM customer UNION ALL SELECT 'c_nationkey', 'int32', sum(c_nationkey) FROM customer UNION ALL SELECT 'c_name', 'object', sum(length(c_name)) FROM customer")
def arrays_by_column(spark, d):
    """NumPy arrays keep their columns' widths; text is of objects."""
    a = reader(spark, d, "customer").arrays(columns=["c_custkey", "c_acctbal", "c_nationkey", "c_name"])
    total = lambda x: float(sum(map(len, x))) if x.dtype == object else round(float(x.sum()), 2)
    return _rows(spark, [(n, str(x.dtype), total(x)) for n, x in a.items()], "column string, dtype string, total double")


@query(_values([("c_custkey", "int64", 0), ("c_name", "object", 0), ("c_acctbal", "float64", 0)], '"column", dtype, "rows"'))
def arrays_of_nothing(spark, d):
    a = reader(spark, d, "customer").arrays(columns=["c_custkey", "c_name", "c_acctbal"], where={"c_custkey": []})
    return _rows(spark, [(n, str(x.dtype), len(x)) for n, x in a.items()], "column string, dtype string, rows int")


@query("SELECT count(*) AS n, sum(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END)::DOUBLE AS total, count(*) FILTER (p_size % 5 = 0) AS missing FROM part")
def arrays_with_nulls(spark, d):
    """Integers with nulls become doubles with NaN."""
    path = scratch(spark, "nulls")
    W.write_frame(plain(spark, d, "part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size")), path)
    a = Reader(spark, path).arrays()["size"]
    return _rows(spark, [(len(a), float(a[a == a].sum()), int((a != a).sum()))], "n long, total double, missing long")


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS \"at\", strftime(o_orderdate, '%Y-%m-%d %H:%M') AS local FROM orders")
def rows_in_a_time_zone(spark, d):
    """Instants come in the reader's zone, local times as they are."""
    path = scratch(spark, "zone")
    df = plain(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderdate").cast("timestamp_ntz").alias("local"))
    W.write_frame(df, path)

    def shown(r: dict) -> tuple:
        return r["o_orderkey"], r["at"].strftime("%Y-%m-%d %H:%M"), r["local"].strftime("%Y-%m-%d %H:%M")

    return Reader(spark, path, "+05:30").map_rows(shown, "o_orderkey long, at string, local string")


class Status(enum.Enum):
    F = 1
    P = 2


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def where_enum_value(spark, d):
    """A symbol stands for its name."""
    return reader(spark, d, "orders").read(columns=["o_orderkey"], where={"o_orderstatus": [Status.F, Status.P]})


# sinks


CODECS = ("none", "snappy", "gzip", "lz4", "zstd")


@query(f"SELECT codec, n_nationkey, n_name FROM nation, (VALUES {', '.join(f'({c!r})' for c in CODECS)}) t(codec)")
def sink_codecs(spark, d):
    """Every codec that can be written is read back."""
    parts = []
    for codec in CODECS:
        path = scratch(spark, codec)
        W.write_frame(plain(spark, d, "nation"), path, options=W.Options(compression=codec))
        parts.append(Reader(spark, path).read(columns=["n_nationkey", "n_name"]).withColumn("codec", F.lit(codec)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT l_orderkey, l_extendedprice, l_comment IS NULL AS none FROM (SELECT *, NULL AS l_comment FROM lineitem)")
def sink_encodings(spark, d):
    """Delta and byte-stream-split encodings, read in a session of their own, whose reader takes them."""
    path, own = scratch(spark, "encodings"), spark.newSession()
    df = plain(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", F.lit(None).cast("string").alias("l_comment"))
    W.write_frame(df, path, options=W.Options(encodings={"l_orderkey": "delta_binary_packed", "l_extendedprice": "byte_stream_split"}))
    return Reader(own, path).read().select("l_orderkey", "l_extendedprice", F.col("l_comment").isNull().alias("none"))


@query(f"SELECT o_orderkey // {GROUP_ROWS} AS row_group, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high, count(*) - count(o_orderkey) AS nulls, count(*) AS \"values\" FROM orders GROUP BY 1")
def sink_statistics(spark, d):
    """Each chunk's null count and bounds, as written."""
    i = Inspector(spark, _grouped(spark, d))
    return i.numbered(i.chunks().filter("column = 'o_orderkey'")).select("row_group", "low", "high", "nulls", "values")


@query(f"SELECT o_orderkey // {PAGE_ROWS} AS page, count(*) AS \"rows\", min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM orders GROUP BY 1")
def inspect_pages(spark, d):
    i = Inspector(spark, _grouped(spark, d))
    p = i.numbered(i.pages().filter("column = 'o_orderkey'"))
    return p.select((F.col("row_group") * (GROUP_ROWS // PAGE_ROWS) + F.col("page")).cast("long").alias("page"), "rows", "low", "high")


@query(f"SELECT o_orderkey // {PAGE_ROWS} AS page, 'data' AS kind, count(*) AS \"values\", 'ok' AS checksum FROM orders GROUP BY 1")
def inspect_page_headers(spark, d):
    """Pages by the headers in the file, each with its checksum verified."""
    i = Inspector(spark, _grouped(spark, d, dictionary=False))
    p = i.numbered(i.page_headers().filter("column = 'o_orderkey'"))
    return p.select((F.col("row_group") * (GROUP_ROWS // PAGE_ROWS) + F.col("page")).cast("long").alias("page"), "kind", F.col("values").cast("long").alias("values"), "checksum")


@query("SELECT * FROM (VALUES ('damaged', 'mismatch', true), ('whole', 'ok', true), ('without', 'absent', true)) t(file, status, found)")
def inspect_checksum_tally(spark, d):
    """Pages of files with checksums, of files without, and of files of which one has a byte changed."""
    out = []
    for name, on in (("whole", True), ("without", False), ("damaged", True)):
        path = _grouped(spark, d, checksums=on)
        if name == "damaged":
            files, path = Reader(spark, path).files, scratch(spark, "damaged")
            at = Inspector(spark, files[0]).page_headers().filter("kind = 'data'").agg(F.min(F.col("offset") + F.col("header"))).first()[0]
            to = {f: f"{path}/{f.rsplit('/', 1)[1]}" for f in files}
            copy_changed(spark, files[0], to.pop(files[0]), at + 1)
            copy_files(spark, to)
        i = Inspector(spark, path)
        tally = {r.status: r.pages for r in i.checksum_tally().collect()}
        found = {r.status for r in i.checksums().select("status").distinct().collect()}
        status = "mismatch" if "mismatch" in found else ", ".join(sorted(found))
        out.append((name, status, tally.get(status, 0) == (1 if name == "damaged" else sum(tally.values()))))
    return _rows(spark, out, "file string, status string, found boolean")


@query("SELECT 'owner' AS key, 'us' AS \"value\", count(*) AS files FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT 'sorted by', 'o_orderkey', count(DISTINCT o_orderstatus) FROM orders")
def redact_keeps_metadata_and_sorting(spark, d):
    """Key/value metadata go along, and sorting columns up to the first that is changed."""
    from ..sources.notes import sorting_of

    source, target = scratch(spark, "noted"), scratch(spark, "noted")
    r = reader(spark, d, "orders")
    W.write_sorted(r.read(), source, ["o_orderkey", "o_custkey"], r.num_rows, W.Options(metadata={"owner": "us", "pandas": "{}"}, sorting=["o_orderkey", "o_custkey"]), ["o_orderstatus"])
    Redaction().where(o_orderkey=between(None, 50)).replace(o_custkey=0).drop("o_totalprice").run(spark, source, target)
    rows = []
    for f in Reader(spark, target).files:
        one = Reader(spark, f)
        rows += [(k, v) for k, v in one.metadata.items() if k in ("owner", "pandas")] + [("sorted by", ",".join(n for n, _, _ in sorting_of(spark, f)))]
    return _rows(spark, rows, "key string, value string").groupBy("key", "value").agg(F.count("*").alias("files"))


@query("SELECT *, 'a, b' AS note FROM nation")
def sink_metadata(spark, d):
    path = scratch(spark, "noted")
    W.write_frame(plain(spark, d, "nation"), path, options=W.Options(metadata={"note": "a, b"}, sorting=[("n_nationkey", False, True)]))
    r = Reader(spark, path)
    return r.read().withColumn("note", F.lit(r.metadata["note"]))


@query("SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT -1, 'after' ")
def sink_rejects_a_row_and_goes_on(spark, d):
    """A row that doesn't fit raises, names its column, and leaves no trace."""
    path, schema = scratch(spark, "rows"), Schema.build(lambda b: (b.int64("c_custkey", null=False), b.string("c_mktsegment")))
    with W.Writer(spark, path, schema) as w:
        for r in reader(spark, d, "customer").each_row(columns=["c_custkey", "c_mktsegment"]):
            w.append(r)
        for bad in ({"c_custkey": None, "c_mktsegment": "x"}, {"c_custkey": "many", "c_mktsegment": "x"}, {"c_custkey": 1 << 70, "c_mktsegment": "x"}):
            with contextlib.suppress(TesseraError):
                w.append(bad)
                raise AssertionError("taken")
        w.append({"c_custkey": -1, "c_mktsegment": "after"})
    return Reader(spark, path).read()


@query("SELECT r_regionkey AS key, r_name AS name, NULL::VARCHAR AS note FROM region")
def sink_headers(spark, d):
    """Rows without names take them from headers; a column without values is text."""
    path = scratch(spark, "headers")
    W.write(spark, path, ([r["r_regionkey"], r["r_name"], None] for r in reader(spark, d, "region").each_row()), headers=["key", "name", "note"])
    return Reader(spark, path).read().withColumn("key", F.col("key").cast("int"))


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey AS region FROM nation")
def relational_table(spark, d):
    """A table of a database, read over JDBC in ranges of its key, in the types that its columns' metadata tell."""
    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in reader(spark, d, "nation").each_row()]
    url = shipped_table(spark, "nations", {"ID": "INTEGER", "LABEL": "VARCHAR(1000)", "REGION": "INTEGER"}, rows)
    columns = [{"name": "id", "type": "integer"}, {"name": "label", "type": "varchar"}, {"name": "region", "type": "integer"}]
    return read_table(spark, url, "nations", columns, key="ID", tasks=3)


# redaction


@query("SELECT 'copied' AS tier, count(*) FILTER (NOT hit) AS files FROM (SELECT o_orderstatus, year(o_orderdate) AS y, bool_or(o_custkey = 77) AS hit FROM orders GROUP BY ALL) UNION ALL SELECT 'rewritten', count(*) FILTER (hit) FROM (SELECT o_orderstatus, year(o_orderdate) AS y, bool_or(o_custkey = 77) AS hit FROM orders GROUP BY ALL)")
def redact_tiers(spark, d):
    """What no statement touches is copied as it is; the rest is rewritten."""
    from .registry import _partitioned

    report = Redaction().where(o_custkey=77).delete().run(spark, _partitioned(spark, d), scratch(spark, "tiers"))
    return _rows(spark, list(report.files.items()), "tier string, files long")


@query("SELECT 'key' AS \"case\", bool_or(o_orderkey = 5) AS affects FROM orders UNION ALL SELECT 'no key', bool_or(o_orderkey = -5) FROM orders UNION ALL SELECT 'status', bool_or(o_orderstatus = 'F') FROM orders UNION ALL SELECT 'drop', true UNION ALL SELECT 'all', count(*) > 0 FROM orders UNION ALL SELECT 'between', bool_or(o_totalprice < 0) FROM orders")
def redact_affects(spark, d):
    r = reader(spark, d, "orders")
    cases = {"key": Redaction().where(o_orderkey=5).delete(), "no key": Redaction().where(o_orderkey=-5).delete(), "status": Redaction().where(o_orderstatus="F").replace(o_orderpriority="-"), "drop": Redaction().drop("o_custkey"), "all": Redaction().replace(o_orderpriority="-"), "between": Redaction().where(o_totalprice=between(None, 0, exclusive=True)).delete()}
    return _rows(spark, [(k, x.affects(spark, r)) for k, x in cases.items()], "case string, affects boolean")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, 'ZSTD' AS codec, true AS bloom, 0 AS left_over FROM nation WHERE n_name <> 'FRANCE'")
def redact_keeps_codec_and_blooms(spark, d):
    """The rewritten file has its source's codec and bloom filter, and no byte of a deleted value."""
    source, target = scratch(spark, "codec"), scratch(spark, "codec")
    W.write_frame(plain(spark, d, "nation"), source, options=W.Options(compression="zstd", bloom_filters=["n_name"]), files=1)
    Redaction().where(n_name="FRANCE").delete().where(n_regionkey=1).replace(n_name="x").run(spark, source, target)
    found = Inspector(spark, target)
    codec = found.chunks().select("codec").distinct().first()[0]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target).select(F.sum(F.expr("cast(position(cast('FRANCE' as binary), content) > 0 as int)"))).first()[0]
    blooms = {c for _, _, c in found.bloom_filters()}
    return Reader(spark, target).read(columns=["n_nationkey", "n_name"]).withColumns({"codec": F.lit(codec), "bloom": F.lit("n_name" in blooms), "left_over": F.lit(int(raw))})


@query(_values([("repr", "Redaction(where(o_custkey).delete(); replace(o_orderpriority); drop(o_orderdate))"), ("again", "same rows")], '"case", said'))
def redact_is_reusable_and_silent(spark, d):
    """One object serves many inputs, and never shows its conditions' values."""
    r = Redaction().where(o_custkey=77).delete().replace(o_orderpriority="secret").drop("o_orderdate")
    a, b = (r.apply(plain(spark, d, "orders")) for _ in range(2))
    return _rows(spark, [("repr", repr(r)), ("again", "same rows" if a.exceptAll(b).isEmpty() and a.count() == b.count() else "differ")], "case string, said string")


@query("SELECT event_id, user_id, value FROM events WHERE event_type <> 'error' AND value > 10")
def redact_stream(spark, d):
    """A redaction of a stream, appended to files exactly once."""
    r = reader(spark, d, "events")
    folder, out = r.files[0].rsplit("/", 1)[0], scratch(spark, "stream")
    df = spark.readStream.schema(r.schema.to_spark()).option("pathGlobFilter", "events.parquet" if r.files[0].endswith("/events.parquet") else "*").parquet(folder)
    gone = Redaction().where(event_type="error").delete().where(value=between(None, 10)).delete().drop("props")
    streams.write_stream(streams.redact_stream(df, gone, r.schema), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return Reader(spark, f"{out}/data").read(columns=["event_id", "user_id", "value"])


# combination


@query("SELECT 0 AS input, count(*) AS \"rows\", true AS rewritten, 'size' AS filled, '' AS widened, '' AS dropped FROM customer UNION ALL SELECT 1, count(*), true, 'name', 'key', '' FROM part")
def combine_report(spark, d):
    a, b, out = scratch(spark, "a"), scratch(spark, "b"), scratch(spark, "out")
    W.write_frame(plain(spark, d, "customer").selectExpr("c_custkey key", "c_name name"), a)
    W.write_frame(plain(spark, d, "part").selectExpr("cast(p_partkey as int) key", "p_size size"), b)
    report = C.combine(spark, [a, b], out, "union")
    return _rows(spark, [(k, x.rows, x.groups_rewritten > 0, ",".join(x.filled), ",".join(x.widened), ",".join(x.dropped)) for k, x in enumerate(report.inputs)], "input int, rows long, rewritten boolean, filled string, widened string, dropped string")


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation")
def combine_row_groups(spark, d):
    """Row groups of two files in one, byte for byte."""
    path, out = scratch(spark, "one"), scratch(spark, "merged") + ".parquet"
    W.write_frame(plain(spark, d, "nation"), path, files=1)
    file = Reader(spark, path).files[0]
    C.merge_files(spark, [file, file], out)
    return Reader(spark, out).read()


# errors


@query(
    _values(
        [("missing", "FileNotFoundError"), ("not parquet", "FormatError"), ("cut off", "FormatError"), ("no such column", "ValueError"), ("column twice", "ValueError"), ("condition on no column", "ValueError"),
         ("condition inside a list", "ValueError"), ("not conditions", "ValueError"), ("negative start", "ValueError"), ("no zone", "ValueError"), ("empty batch", "ValueError"), ("no such batch", "ValueError")], '"case", error')
)
def errors_of_scans(spark, d):
    bad, cut = scratch(spark, "bad") + ".parquet", scratch(spark, "cut") + ".parquet"
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    r = reader(spark, d, "nation")

    def put(path: str, raw: bytes) -> None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        s = p.getFileSystem(hadoop).create(p)
        s.write(raw)
        s.close()

    whole = spark.read.format("binaryFile").load(r.files[0]).select("content").first()[0]
    put(bad, b"this is not a file of columns at all")
    put(cut, bytes(whole)[:-40])
    lists = scratch(spark, "lists")
    W.write_frame(plain(spark, d, "nation").select(F.array("n_name").alias("names")), lists)
    return _rows(spark, _raised({
        "missing": lambda: Reader(spark, scratch(spark, "nothing")), "not parquet": lambda: Reader(spark, bad), "cut off": lambda: Reader(spark, cut), "no such column": lambda: r.read(columns=["x"]), "column twice": lambda: r.read(columns=["n_name", "n_name"]),
        "condition on no column": lambda: r.read(where={"x": 1}, limit=0), "condition inside a list": lambda: Reader(spark, lists).read(where={"names.element": "x"}, limit=0), "not conditions": lambda: r.read(where=["n_name"]), "negative start": lambda: r.read(start=-1), "no zone": lambda: Reader(spark, r.path, "Nowhere/At all"),
        "empty batch": lambda: list(r.each_batch(0)), "no such batch": lambda: list(r.each_batch(kind="trees")),
    }), "case string, error string")


@query(_values([("nothing to do", "ValueError"), ("empty where", "ValueError"), ("where without verb", "ValueError"), ("no such column", "ValueError"), ("dropped and replaced", "ValueError"), ("all dropped", "ValueError"), ("null in a required column", "ValueError"), ("constant that doesn't fit", "ValueError"), ("target exists", "ValueError"), ("row groups given", "ValueError"), ("result that doesn't fit", "EncodeError")], '"case", error'))
def errors_of_redactions(spark, d):
    r, there = reader(spark, d, "nation"), scratch(spark, "there")
    required = Schema.build(lambda b: (b.int32("n_nationkey", null=False), b.string("n_name")))
    W.write_frame(plain(spark, d, "nation").selectExpr("cast(n_nationkey as int) n_nationkey", "n_name"), there, required)
    run = lambda x, target=None, options=None: x.run(spark, r, target or scratch(spark, "errors"), options)

    def open_where():
        x = Redaction()
        x.where(n_name="x")
        run(x)

    return _rows(spark, _raised({
        "nothing to do": lambda: run(Redaction()), "empty where": lambda: Redaction().where(), "where without verb": open_where, "no such column": lambda: run(Redaction().drop("x")), "dropped and replaced": lambda: run(Redaction().replace(n_name="x").drop("n_name")),
        "all dropped": lambda: run(Redaction().drop(*r.schema.names)), "null in a required column": lambda: Redaction().replace(n_nationkey=None).bind(required), "constant that doesn't fit": lambda: Redaction().replace(n_nationkey="many").bind(required),
        "target exists": lambda: run(Redaction().drop("n_name"), there), "row groups given": lambda: run(Redaction().drop("n_name"), options=W.Options(row_group_rows=10)),
        "result that doesn't fit": lambda: Redaction().replace(n_nationkey=lambda c: F.when(c < 5, c)).run(spark, there, scratch(spark, "errors")),
    }), "case string, error string")


@query(_values([("nothing", "ValueError"), ("one path", "ValueError"), ("different schemas", "IncompatibleSchema"), ("no such way", "ValueError"), ("types that don't widen", "IncompatibleSchema"), ("field ids", "IncompatibleSchema"), ("nothing in common", "IncompatibleSchema"), ("conflicts at once", "2")], '"case", error'))
def errors_of_combinations(spark, d):
    a, b = reader(spark, d, "nation"), reader(spark, d, "region")
    one = lambda kind, **more: Schema.build(lambda s: s.column("x", kind, **more))
    text, number = Schema.build(lambda s: (s.string("x"), s.string("y"))), Schema.build(lambda s: (s.int32("x"), s.boolean("y")))
    found = _raised({
        "nothing": lambda: C.combine(spark, [], scratch(spark, "c")), "one path": lambda: C.combine(spark, a.files[0], scratch(spark, "c")), "different schemas": lambda: C.combine(spark, [a, b], scratch(spark, "c")), "no such way": lambda: C.combine(spark, [a, a], scratch(spark, "c"), "both"),
        "types that don't widen": lambda: C.output_schema([one("string"), one("int32")], "union"), "field ids": lambda: C.output_schema([one("int32", field_id=1), one("int32", field_id=2)], "union"), "nothing in common": lambda: C.output_schema([a.schema, b.schema], "intersect"),
    })
    try:
        C.output_schema([text, number], "union")
    except TesseraError as e:
        found.append(("conflicts at once", str(len(e.conflicts))))
    return _rows(spark, found, "case string, error string")


# conversions


@query("SELECT o_orderkey, o_totalprice AS price, CAST(o_custkey AS VARCHAR) AS label FROM orders")
def coerce_float_and_text(spark, d):
    df = plain(spark, d, "orders")
    return df.select("o_orderkey", coerce.column(F.col("o_totalprice").cast("string"), type_of("double")).alias("price"), coerce.column(F.col("o_custkey"), type_of("string"), "bigint").alias("label"))


@query("SELECT event_id, date_trunc('millisecond', ts) AS \"at\" FROM events")
def coerce_timestamp_text(spark, d):
    """ISO text in another zone becomes an instant; what is finer than the unit is cut off."""
    text = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return plain(spark, d, "events").select("event_id", coerce.column(text, type_of("timestamp", unit="millis")).cast("timestamp_ntz").alias("at"))


@query("SELECT p_partkey, '{\"size\":' || p_size || ',\"name\":\"' || p_name || '\"}' AS note FROM part")
def coerce_json(spark, d):
    path = scratch(spark, "json")
    schema = Schema.build(lambda b: (b.int64("p_partkey"), b.json("note")))
    W.write(spark, path, ({"p_partkey": r["p_partkey"], "note": {"size": r["p_size"], "name": r["p_name"]}} for r in reader(spark, d, "part").each_row(columns=["p_partkey", "p_size", "p_name"])), schema)
    return Reader(spark, path).read().withColumn("note", F.regexp_replace("note", r'([:,]) ', "$1"))


_HALVES = [(0.1, 0.0999755859375), (65519.0, 65504.0), (-2.5, -2.5), (1.00048828125, 1.0), (1.00146484375, 1.001953125), (6e-8, 5.960464477539063e-08)]


@query(" UNION ALL ".join(f"SELECT c_custkey, {b!r}::DOUBLE AS h FROM customer WHERE c_custkey % {len(_HALVES)} = {k}" for k, (_, b) in enumerate(_HALVES)))
def coerce_half_floats(spark, d):
    """Rounded to half precision, ties to even."""
    pick = F.element_at(F.array(*(F.lit(a) for a, _ in _HALVES)), (F.col("c_custkey") % len(_HALVES) + 1).cast("int"))
    return plain(spark, d, "customer").select("c_custkey", coerce.half(pick.cast("float")).cast("double").alias("h"))


@query("SELECT o_orderkey, 4294967295 - o_custkey AS n FROM orders")
def unsigned_integers(spark, d):
    """32 bits without a sign, kept as they are in the file and read as positive numbers."""
    path = scratch(spark, "unsigned")
    schema = Schema.build(lambda b: (b.int64("o_orderkey"), b.uint32("n")))
    W.write_frame(plain(spark, d, "orders").select("o_orderkey", (F.lit(4294967295) - F.col("o_custkey")).alias("n")), path, schema)
    return Reader(spark, path).read()


@query("SELECT o_orderkey, o_orderdate FROM orders")
def int96_times(spark, d):
    path = scratch(spark, "int96")
    schema = Schema.build(lambda b: (b.int64("o_orderkey"), b.column("o_orderdate", "int96")))
    W.write_frame(plain(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate")), path, schema, strict=False)
    return Reader(spark, path).read().withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query(_values([("", "ef46db3751d8e999"), ("a", "d24ec4f1a98c6e5b"), ("abc", "44bc2cf5ad770999")], '"value", hash'))
def bloom_hashes(spark, d):
    """XXH64 with seed 0, as its specification has it."""
    return _rows(spark, [(x, f"{plain_hash(x.encode()) % (1 << 64):016x}") for x in ("", "a", "abc")], "value string, hash string")


@query(_values([("id", "int64", True), ("price", "double", True), ("name", "string", True), ("flag", "boolean", True), ("tags", "list<string>", True), ("born", "date", True)], '"column", kind, nullable'))
def inferred_types(spark, d):
    import datetime

    s = infer([{"id": 1, "price": 1, "name": "x", "flag": None, "tags": [], "born": datetime.date(2020, 1, 1)}, {"id": None, "price": 2.5, "name": "y", "flag": True, "tags": ["a"], "born": None}])
    return _rows(spark, [(f.name, str(f.type), f.nullable) for f in s.fields], "column string, kind string, nullable boolean")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'kept' ELSE 'string' END AS kind, count(*) AS n FROM nation GROUP BY 1")
def enum_values_widen(spark, d):
    """Labels survive a union only where both sides have the same ones."""
    a = type_of("enum", values=["x", "y"])
    from ..schema import widen

    rows = [("kept" if widen(a, type_of("enum", values=["x", "y"] if r["n_nationkey"] % 2 == 0 else ["x"]))[0].values else "string",) for r in reader(spark, d, "nation").each_row()]
    return _rows(spark, rows, "kind string").groupBy("kind").agg(F.count("*").alias("n"))


# keys


@query("SELECT c_custkey, c_nationkey FROM customer")
def encrypted_columns_without_a_key(spark, d):
    """With a readable footer, columns that aren't encrypted need no key."""
    path, footer, name = scratch(spark, "encrypted"), K.Key.generate(), K.Key.generate(128)
    K.write_encrypted(reader(spark, d, "customer").read(columns=["c_custkey", "c_name", "c_nationkey"]), path, K.Encryption(footer, {"c_name": name}, plaintext_footer=True))
    return K.read_encrypted(spark, path, [footer], columns=["c_custkey", "c_nationkey"])


@query(_values([("no key", "DecryptionError"), ("wrong key", "DecryptionError"), ("column's key missing", "DecryptionError"), ("192 bits", "ValueError"), ("100 bits", "ValueError"), ("not hex", "ValueError"), ("no such algorithm", "UnsupportedError"), ("resolver", "none")], '"case", error'))
def errors_of_keys(spark, d):
    path, footer, name = scratch(spark, "encrypted"), K.Key.generate(), K.Key.generate()
    K.write_encrypted(reader(spark, d, "nation").read(columns=["n_nationkey", "n_name"]), path, K.Encryption(footer, {"n_name": name}))
    by_id = {k.id: k for k in (footer, name)}
    return _rows(spark, _raised({
        "no key": lambda: K.read_encrypted(spark, path, []).count(), "wrong key": lambda: K.read_encrypted(spark, path, [K.Key.generate()]).count(), "column's key missing": lambda: K.read_encrypted(spark, path, [footer]).count(),
        "192 bits": lambda: K.Encryption(K.Key.generate(192)), "100 bits": lambda: K.Key.generate(100), "not hex": lambda: K.Key.from_hex("xyz"), "no such algorithm": lambda: K.Encryption(footer, algorithm="ROT13"), "resolver": lambda: K.read_encrypted(spark, path, by_id.get).count(),
    }), "case string, error string")


@query(_values([("bits", "128 192 256"), ("hex again", "True"), ("id", "16"), ("id tells", "nothing of the key"), ("equal", "True")], '"case", said'))
def key_properties(spark, d):
    keys = [K.Key.generate(n) for n in (128, 192, 256)]
    k = keys[2]
    rows = [("bits", " ".join(str(x.bits) for x in keys)), ("hex again", str(all(K.Key.from_hex(x.hex()) == x for x in keys))), ("id", str(len(k.id))), ("id tells", "nothing of the key" if k.id not in k.hex() and k.hex() not in repr(k) else "something"), ("equal", str(K.Key(k.raw) == k and k != keys[0]))]
    return _rows(spark, rows, "case string, said string")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey <> 77")
def encrypted_redaction(spark, d):
    """An encrypted input is redacted into files that are encrypted alike."""
    source, target, footer, price = scratch(spark, "encrypted"), scratch(spark, "encrypted"), K.Key.generate(), K.Key.generate(128)
    e = K.Encryption(footer, {"o_totalprice": price}, aad_prefix=b"orders")
    K.write_encrypted(plain(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), source, e)
    Redaction().where(o_custkey=77).delete().where(o_custkey=between(None, 100, exclusive=True)).replace(o_totalprice=0.0).run(spark, Reader(spark, source, keys=[footer, price]), target)
    out = Reader(spark, target, keys=[footer, price])
    if out.secrets.encryption != e:
        raise AssertionError("encrypted otherwise")
    return out.read()


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation")
def encrypted_combination(spark, d):
    """Inputs that are encrypted alike are copied byte for byte."""
    source, target, key = scratch(spark, "encrypted"), scratch(spark, "encrypted"), K.Key.generate()
    K.write_encrypted(plain(spark, d, "nation"), source, K.Encryption(key))
    r = Reader(spark, source, keys=[key])
    report = C.combine(spark, [r, r], target)
    if not all(x.groups_copied and not x.groups_rewritten for x in report.inputs):
        raise AssertionError("rewritten")
    return Reader(spark, target, keys=[key]).read()


_WAYS = ("uniform", "columns", "readable footer", "ctr", "prefix", "prefix left out")


@query("SELECT way, count(*) AS n, sum(s_acctbal) AS total FROM supplier, (VALUES " + ", ".join(f"({w!r})" for w in _WAYS) + ") t(way) WHERE s_suppkey >= 20 GROUP BY 1")
def encrypted_ways(spark, d):
    """Every way to encrypt, read with a condition that is pushed down to the encrypted files."""
    footer, one = K.Key.generate(), K.Key.generate()
    ways = dict(zip(_WAYS, (K.Encryption(footer), K.Encryption(footer, {"s_acctbal": one}), K.Encryption(footer, {"s_acctbal": one}, plaintext_footer=True), K.Encryption(footer, {"s_acctbal": one}, algorithm="AES_GCM_CTR_V1"), K.Encryption(footer, aad_prefix=b"supplier"), K.Encryption(footer, aad_prefix=b"supplier", store_aad_prefix=False))))
    out = None
    for way, e in ways.items():
        path = scratch(spark, "way")
        K.write_encrypted(plain(spark, d, "supplier"), path, e)
        df = K.read_encrypted(spark, path, {footer.id: footer, one.id: one}.get, aad_prefix=None if e.store_aad_prefix else e.aad_prefix)
        found = df.filter("s_suppkey >= 20").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("total")).select(F.lit(way).alias("way"), "n", "total")
        out = found if out is None else out.unionByName(found)
    return out


# the command line


def _run(spark: SparkSession, *args: str) -> str:
    out = io.StringIO()
    if cli.main(list(args), spark, out):
        raise RuntimeError(f"tessera {args[0]} failed")
    return out.getvalue()


@query("SELECT n_nationkey, n_name FROM nation")
def cli_cat(spark, d):
    rows = [json.loads(x) for x in _run(spark, "cat", f"{d.rstrip('/')}/nation.parquet").splitlines()]
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def cli_keys(spark, d):
    """Encrypted by one command and read by another."""
    out, key = scratch(spark, "combined"), K.Key.generate()
    _run(spark, "combine", f"{d.rstrip('/')}/nation.parquet", "--output", out, "--encrypt-key", "hex:" + key.hex())
    rows = [json.loads(x) for x in _run(spark, "cat", out, "--key", key.hex()).splitlines()]
    return _rows(spark, [(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query("SELECT * FROM region UNION ALL SELECT * FROM region")
def cli_combine(spark, d):
    out, path = scratch(spark, "combined"), f"{d.rstrip('/')}/region.parquet"
    _run(spark, "combine", path, path, "--output", out, "--compression", "zstd")
    return Reader(spark, out).read()


@query("SELECT 'nation' AS \"table\", count(*) AS \"rows\", 'text html json' AS formats FROM nation")
def cli_inspect(spark, d):
    path = f"{d.rstrip('/')}/nation.parquet"
    found = json.loads(_run(spark, "inspect", path, "--format", "json", "--pages", "--verify-checksums"))
    formats = ["text"] * ("n_name" in _run(spark, "inspect", path)) + ["html"] * _run(spark, "inspect", path, "--format", "html").startswith("<!DOCTYPE html>") + ["json"] * (found["checksums"][0]["status"] == "absent")
    return _rows(spark, [("nation", found["files"][0]["rows"], " ".join(formats))], "table string, rows long, formats string")


@query(_values([("output is an input", "1"), ("no such file", "1"), ("output removed", "True")], '"case", said'))
def cli_refusals(spark, d):
    path, out = f"{d.rstrip('/')}/region.parquet", scratch(spark, "never")
    code = lambda *a: str(cli.main(list(a), spark, io.StringIO()))
    with contextlib.redirect_stderr(io.StringIO()):
        rows = [("output is an input", code("combine", path, "--output", path)), ("no such file", code("cat", scratch(spark, "none")))]
        code("combine", path, f"{d.rstrip('/')}/nation.parquet", "--output", out)
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    return _rows(spark, [*rows, ("output removed", str(not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)))], "case string, said string")


@query("SELECT n_nationkey, n_name FROM nation")
def inspect_arrow_schema(spark, d):
    """The Arrow schema that a file carries or implies names the columns to read."""
    s = Inspector(spark, f"{d.rstrip('/')}/nation.parquet").arrow_schema()
    return plain(spark, d, "nation").select([n for n in s.names if n in ("n_nationkey", "n_name")])


@query("SELECT event_id, 'ts ' || strftime(ts, '%Y') || '-**' AS said FROM events")
def mask_by_function(spark, d):
    shown = privacy.renderable(privacy.year_only(F.col("ts").cast("date")), type_of_date())
    return plain(spark, d, "events").select("event_id", F.concat(F.lit("ts "), F.substring(shown, 1, 4), F.lit("-**")).alias("said"))


def type_of_date():
    from pyspark.sql import types as T

    return T.DateType()



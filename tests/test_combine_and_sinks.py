import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.errors import DecryptionError, EncodeError, IncompatibleSchema, SchemaMismatch
from tessera.operators.combine import combine, combine_frames, merge_files
from tessera.operators.redact import Redaction
from tessera.schema import Schema
from tessera.sources import keys as K
from tessera.sources.inspect import Inspector
from tessera.sources.reader import Reader
from tessera.sources.writer import Options, Writer, codecs, write, write_frame
from tessera.streaming import streams

BASE = Schema.build(lambda b: (b.int64("id", null=False), b.string("email"), b.struct("address", lambda a: (a.string("city"), a.int32("zip"))), b.list("tags", "string"), b.timestamp("at")))
AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def base(n, start=0):
    return [{"id": start + i, "email": None if i % 7 == 0 else f"e{i}", "address": None if i % 5 == 0 else {"city": "AMS", "zip": i}, "tags": ["a"] * (i % 3), "at": AT} for i in range(n)]


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("combine")
    write(spark, f"{d}/a", base(100), schema=BASE)
    write(spark, f"{d}/b", base(50, 100), schema=BASE)
    write(spark, f"{d}/phone", [{"id": 1000, "phone": "1"}, {"id": 1001, "phone": "2"}], schema=Schema.build(lambda b: (b.int64("id", null=False), b.string("phone", null=False))))
    write(spark, f"{d}/small", [{"id": 5, "address": {"city": "X"}, "phone": None}], schema=Schema.build(lambda b: (b.int32("id", null=False), b.struct("address", lambda a: a.string("city")), b.string("phone"))))
    return d


def test_same_schema_is_copied(spark, paths, tmp_path):
    r = combine(spark, [f"{paths}/a", f"{paths}/b"], f"{tmp_path}/o")
    assert r.rows == 150 and Reader(spark, f"{tmp_path}/o").rows() == base(100) + base(50, 100)
    assert Reader(spark, f"{tmp_path}/o").schema == BASE


def test_union(spark, paths, tmp_path):
    r = combine(spark, [f"{paths}/a", f"{paths}/b", f"{paths}/phone"], f"{tmp_path}/o", "union")
    assert r.rows == 152 and r.inputs[2].filled == ["email", "address", "tags", "at"] and r.inputs[0].filled == ["phone"]
    rows = Reader(spark, f"{tmp_path}/o").rows()
    assert rows[0]["phone"] is None and rows[-1] == {"id": 1001, "email": None, "address": None, "tags": None, "at": None, "phone": "2"}


def test_intersect(spark, paths, tmp_path):
    r = combine(spark, [f"{paths}/a", f"{paths}/small"], f"{tmp_path}/o", "intersect")
    rows = Reader(spark, f"{tmp_path}/o").rows()
    assert rows[1] == {"id": 1, "address": {"city": "AMS"}} and rows[-1] == {"id": 5, "address": {"city": "X"}}
    assert r.inputs[1].widened == ["id"] and "address.zip" in r.inputs[0].dropped


def test_widening(spark):
    schemas = [Schema.build(lambda b: (b.timestamp("t", unit="millis"), b.struct("s", lambda x: x.int8("v")), b.list("l", "string"), b.time("o", unit="millis"))), Schema.build(lambda b: (b.timestamp("t", unit="nanos"), b.struct("s", lambda x: x.uint16("v")), b.list("l", "binary"), b.time("o", unit="micros")))]
    rows = [(AT, (5,), ["é"], 7), (1, (60000,), [b"x"], 8)]
    out = combine_frames([spark.createDataFrame([r], s.to_spark()) for r, s in zip(rows, schemas)], "union", schemas).collect()
    assert [tuple(out[0])[0], out[0].s.v, bytes(out[0].l[0]), out[0].o] == [1704067200000000000, 5, "é".encode(), 7000]
    assert out[1].s.v == 60000 and out[1].o == 8


def test_conflicts_of_all_inputs(spark, paths, tmp_path):
    for want in (None, Schema.build(lambda b: b.int32("id"))):
        with pytest.raises(IncompatibleSchema) as e:
            combine(spark, [f"{paths}/a", f"{paths}/phone", f"{paths}/small"], f"{tmp_path}/no", want)
        assert {c.source for c in e.value.conflicts} >= {1, 2} and not (tmp_path / "no").exists()
    for bad in ([], f"{paths}/a"):
        with pytest.raises(ValueError):
            combine(spark, bad, f"{tmp_path}/no")
    with pytest.raises(ValueError):
        combine(spark, [f"{paths}/a"], f"{tmp_path}/no", "other")


def test_one_file_of_row_groups(spark, paths, tmp_path):
    files = [Reader(spark, f"{paths}/{x}").files[0] for x in "ab"]
    assert merge_files(spark, files, f"{tmp_path}/one.parquet", {"note": "é"}) == 2
    r = Reader(spark, f"{tmp_path}/one.parquet")
    assert r.row_groups == [100, 50] and r.metadata["note"] == "é" and r.rows()[120]["id"] == 120


# sinks


def test_failed_rows_leave_no_trace(spark, tmp_path):
    s = Schema.build(lambda b: (b.int8("n", null=False), b.string("t")))
    with Writer(spark, f"{tmp_path}/w", s) as w:
        w.append({"n": 1})
        for row in ({"n": 300}, {"n": None}, [1], {"n": 1, "x": 1}):
            with pytest.raises(EncodeError):
                w.append(row)
        w << [2, "b"]
    assert Reader(spark, f"{tmp_path}/w").rows() == [{"n": 1, "t": None}, {"n": 2, "t": "b"}]
    with pytest.raises(RuntimeError):
        with Writer(spark, f"{tmp_path}/gone", s) as w:
            w.append([1, "a"])
            w._flush()
            raise RuntimeError
    assert not (tmp_path / "gone").exists()


def test_inferred(spark, tmp_path):
    assert write(spark, f"{tmp_path}/i", ({"a": i, "b": {"c": str(i)}} for i in range(1500)), declare=lambda b: b.json("b")) == 1500
    assert Reader(spark, f"{tmp_path}/i").rows(limit=1) == [{"a": 0, "b": '{"c":"0"}'}]
    with pytest.raises(SchemaMismatch, match="1000 rows"):
        write(spark, f"{tmp_path}/m", ({"a": i if i < 1200 else "x"} for i in range(1500)))
    assert not (tmp_path / "m").exists()
    assert write(spark, f"{tmp_path}/h", [[1, "x"], {"n": 2}], headers=["n", "s"]) == 2
    for rows, headers in (([[1]], None), ([], None), ([[1]], ["a", "a"])):
        with pytest.raises(ValueError):
            write(spark, f"{tmp_path}/e", rows, headers=headers)
    for rows in ([[1, 2]], [{"z": 1}]):
        with pytest.raises(EncodeError):
            write(spark, f"{tmp_path}/e", rows, headers=["a"])
    write(spark, f"{tmp_path}/empty", [], headers=["a", "b"])
    assert str(Reader(spark, f"{tmp_path}/empty").schema["a"].type) == "string"


def test_frames_are_strict(spark, tmp_path):
    s = Schema.build(lambda b: (b.int32("a", null=False), b.boolean("b")))
    assert write_frame(spark.createDataFrame([("1", "yes"), ("2", None)], "a string, b string"), f"{tmp_path}/f", s) == 2
    assert Reader(spark, f"{tmp_path}/f").schema == s and Reader(spark, f"{tmp_path}/f").rows() == [{"a": 1, "b": True}, {"a": 2, "b": None}]
    for rows in ([("x", "no")], [(None, "no")], [("1", "maybe")]):
        with pytest.raises(EncodeError):
            write_frame(spark.createDataFrame(rows, "a string, b string"), f"{tmp_path}/bad", s)


def test_options(spark, tmp_path):
    s = Schema.build(lambda b: (b.int64("id"), b.string("s"), b.boolean("f")))
    o = Options(compression="zstd", compression_level=5, row_group_rows=500, page_rows=100, data_page_version=2, dictionary=["s"], bloom_filters={"id": {"ndv": 10, "fpp": 0.05}})
    write(spark, f"{tmp_path}/o", [{"id": i, "s": "x", "f": True} for i in range(1000)], schema=s, options=o)
    i = Inspector(spark, f"{tmp_path}/o")
    chunks = {(r.row_group, r.column): r for r in i.chunks().collect()}
    assert len(chunks) == 6 and chunks[0, "id"].codec == "ZSTD" and "RLE_DICTIONARY" not in chunks[0, "id"].encodings and "RLE_DICTIONARY" in chunks[0, "s"].encodings
    assert len(i.bloom_filters()) == 2 and i.pages().filter("column = 'id'").count() == 10
    for bad in (Options(compression="lzma"), Options(compression="gzip", compression_level=10), Options(compression="snappy", compression_level=1), Options(page_rows=0), Options(data_page_version=3), Options(bloom_filters=["f"]), Options(bloom_filters=["no"]), Options(dictionary=["no"]), Options(encodings={"s": "delta_binary_packed"}), Options(bloom_filters={"id": {"size": 1}})):
        with pytest.raises(ValueError):
            bad.spark_options(s)
    assert codecs(spark)["snappy"]


# inspection, keys, streams, command line


def test_inspection(spark, paths):
    i = Inspector(spark, f"{paths}/a")
    one = i.summary().first()
    assert (one.rows, one.row_groups, one.codecs) == (100, 1, ["SNAPPY"])
    c = {r.column: r for r in i.columns().collect()}
    assert (c["id"].low, c["id"].high, c["id"].nulls, c["email"].nulls) == ("0", "99", 0, 15)
    assert i.mismatches() == [] and i.layout().filter("gap < 0").isEmpty() and i.checksums().first().status == "ok"
    assert json.loads(i.to_json(pages=True))["files"][0]["rows"] == 100
    assert "row_groups" in i.to_text() and "<table>" in i.to_html() and i.arrow_schema().names == BASE.names


def test_keys():
    k = K.Key.generate()
    assert K.Key.from_hex(k.hex()) == k and len(k.id) == 16 and k.hex() not in repr(k) and k.bits == 256
    for bad in (lambda: K.Key(b"short"), lambda: K.Key.from_hex("zz"), lambda: K.Key.generate(100), lambda: K.Encryption(K.Key.generate(192))):
        with pytest.raises(ValueError):
            bad()


def test_encryption(spark, tmp_path):
    footer, column = K.Key.generate(), K.Key.generate(128)
    df = spark.range(100).select("id", F.concat(F.lit("secret"), F.col("id")).alias("s"))
    assert K.write_encrypted(df, f"file://{tmp_path}/e", K.Encryption(footer, {"s": column})) == 100
    assert all(b"secret" not in f.read_bytes() for f in (tmp_path / "e").glob("*.parquet"))
    assert K.read_encrypted(spark, f"{tmp_path}/e", [footer, column]).agg(F.sum("id"), F.max("s")).first()[:2] == (4950, "secret99")
    assert K.read_encrypted(spark, f"{tmp_path}/e", {footer.id: footer}.get, columns=["id"]).count() == 100
    for keys in ([footer], [K.Key.generate()], []):
        with pytest.raises(DecryptionError):
            K.read_encrypted(spark, f"{tmp_path}/e", keys)


def test_stream(spark, paths, tmp_path):
    df = streams.redact_stream(streams.scan_stream(spark, f"{paths}/a", BASE, where={"id": range(10, 20)}), Redaction().where(id=12).delete().drop("tags"))
    streams.write_stream(df, f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    assert sorted(r["id"] for r in Reader(spark, f"{tmp_path}/s").rows()) == [10, 11, *range(13, 20)]


def test_command_line(spark, paths, tmp_path, capsys):
    out = io.StringIO()
    assert cli.main(["cat", f"{paths}/a", "2"], spark, out) == 0
    assert json.loads(out.getvalue().splitlines()[1]) == {"id": 1, "email": "e1", "address": {"city": "AMS", "zip": 1}, "tags": ["a"], "at": "2024-01-01T00:00:00.000000000Z"}
    assert cli.main(["inspect", f"{paths}/a", "--format", "json"], spark, out) == 0
    assert cli.main(["combine", f"{paths}/a", f"{paths}/phone", "--schema", "union", "--output", f"{tmp_path}/u"], spark, out) == 0
    assert cli.main(["combine", f"{paths}/a", "--output", f"{paths}/a"], spark, out) == 1
    assert cli.main(["cat", f"{tmp_path}/none"], spark, out) == 1 and "tessera:" in capsys.readouterr().err


def test_relational_source(spark, tmp_path):
    from tessera.sources.relational import export_table, read_table

    url = "jdbc:derby:memory:tessera;create=true"
    spark.range(20).selectExpr("cast(id as int) ID", "cast(id % 3 as short) KIND", "cast(id as string) NOTE").write.format("jdbc").options(url=url, dbtable="things").save()
    columns = [{"name": "id", "sql_type": "integer", "primary_key": True}, {"name": "kind", "sql_type": "smallint"}, {"name": "note", "sql_type": "varchar"}]
    df = read_table(spark, url, "things", columns, key="ID", tasks=3)
    assert df.rdd.getNumPartitions() == 3 and df.dtypes == [("id", "bigint"), ("kind", "smallint"), ("note", "string")]
    assert export_table(spark, url, "things", f"{tmp_path}/t", columns) == 20
    assert str(Reader(spark, f"{tmp_path}/t").schema["id"]) == "id:int64!"
    with pytest.raises(ValueError):
        read_table(spark, url, "things", [{"name": "none", "sql_type": "int"}])

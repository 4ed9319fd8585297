import pytest
from pyspark.sql import functions as F

from tessera.errors import EncodeError
from tessera.operators.filters import between
from tessera.operators.redact import Redaction, redact, udf
from tessera.schema import Schema
from tessera.sources.reader import Reader
from tessera.sources.writer import Options, write

SCHEMA = Schema.build(lambda b: (b.int64("user_id", null=False), b.string("email"), b.string("name"), b.struct("address", lambda a: (a.string("city"), a.string("zip"))), b.list("tags", "string"), b.int32("score"), b.double("x")))
ROWS = [{"user_id": i % 10 if i < 100 else 100 + i, "email": f"u{i}@example.com", "name": f"n{i}", "address": None if i % 50 == 49 else {"city": "AMS", "zip": f"{i:04d}"}, "tags": [f"t{i % 4}"], "score": i, "x": float("nan") if i == 7 else i / 2} for i in range(300)]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("redact") / "in")
    for k in range(3):  # three files, of which statements may leave some alone
        write(spark, f"{path}/{k}", ROWS[100 * k : 100 * k + 100], schema=SCHEMA)
    return path


def run(spark, source, tmp_path, declare, **more):
    target = str(tmp_path / "out")
    report = redact(spark, source, target, declare, **more)
    return report, sorted(Reader(spark, target).rows(), key=lambda r: r["score"]) if "score" in Reader(spark, target).schema.names else Reader(spark, target).rows()


def test_delete_leaves_other_files_as_they_are(spark, source, tmp_path):
    report, rows = run(spark, source, tmp_path, lambda r: (r.where(user_id=3).delete(), r.where(email="u55@example.com").delete(), r.where(score=between(None, 3, True)).delete()))
    gone = [i for i in range(300) if ROWS[i]["user_id"] == 3 or i == 55 or i < 3]
    assert (report.rows_read, report.rows_deleted, report.rows_changed, report.files) == (300, len(gone), 0, {"copied": 2, "rewritten": 1})
    assert [r["score"] for r in rows] == [i for i in range(300) if i not in gone]
    assert Reader(spark, str(tmp_path / "out")).schema == SCHEMA


def test_statements_run_in_order(spark, source, tmp_path):
    def declare(r):
        r.where(score=between(0, 9)).replace(name="first")
        r.where(name="first").replace({"email": None, "score": lambda c: c + 1000})
        r.where(score=between(1005)).delete()
        r.where(name="first").replace(name="first")  # equal values change nothing

    report, rows = run(spark, source, tmp_path, declare)
    assert (report.rows_deleted, report.rows_changed) == (5, 5)
    assert [(r["score"], r["email"]) for r in rows if r["name"] == "first"] == [(1000 + i, None) for i in range(5)]


def test_later_targets_see_earlier_ones(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    out = Redaction().replace({"a": lambda c: c + 10, "b": lambda c, row: row["a"] + c}).apply(df)
    assert out.first().asDict() == {"a": 11, "b": 13}
    out = Redaction().replace({"a": udf(lambda v: v + 10), "b": udf(lambda v, row: row["a"] + v)}).apply(df)
    assert out.first().asDict() == {"a": 11, "b": 13}


def test_functions_of_values_see_matching_rows_only(spark, source, tmp_path):
    def check(v):
        assert v.endswith("7@example.com")
        return v.upper()

    report, rows = run(spark, source, tmp_path, lambda r: r.where(email=lambda c: c.endswith("7@example.com")).replace(email=udf(check)))
    assert report.rows_changed == 30 and rows[17]["email"] == "U17@EXAMPLE.COM"


def test_members_of_null_structs_stay(spark, source, tmp_path):
    report, rows = run(spark, source, tmp_path, lambda r: r.replace({"address.city": "X"}))
    assert report.rows_changed == 294 and rows[49]["address"] is None and rows[0]["address"] == {"city": "X", "zip": "0000"}


def test_nan_replaced_by_nan_counts(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    got = Redaction().replace(x=float("nan")).counts(df).first()
    assert got.rows_changed == 3
    assert Redaction().replace(x=lambda c: c).counts(df).first().rows_changed == 1


def test_drops(spark, source, tmp_path):
    _, rows = run(spark, source, tmp_path, lambda r: r.drop("tags", "address.zip"))
    assert rows[0] == {"user_id": 0, "email": "u0@example.com", "name": "n0", "address": {"city": "AMS"}, "score": 0, "x": 0.0}


def test_affects(spark, source):
    w = lambda **c: Redaction(lambda r: r.where(c).delete()).affects(spark, source)
    assert w(user_id=3) and w(score=299) and not w(user_id=50) and not w(email="u1") and not w(score=[None, 300])
    assert Redaction().drop("tags").affects(spark, source) and Redaction().replace(name=None).affects(spark, source)


def test_whole_fields(spark, source, tmp_path):
    _, rows = run(spark, source, tmp_path, lambda r: r.where(score=1).replace(tags=lambda c: F.transform(c, lambda t: F.upper(t)), address={"city": "Z", "zip": None}))
    assert rows[1]["tags"] == ["T1"] and rows[1]["address"] == {"city": "Z", "zip": None} and rows[2]["tags"] == ["t2"]


def test_mistakes_are_told_before_anything_is_written(spark, source, tmp_path):
    for declare in (
        lambda r: r.where(score=1), lambda r: r.where({}), lambda r: r.where(no=1).delete(), lambda r: r.replace(no=1), lambda r: r.replace(user_id=None), lambda r: r.replace(score="x"), lambda r: r.replace({"tags.element": 1}),
        lambda r: (r.replace(name=None), r.drop("name")), lambda r: r.drop("no"), lambda r: r.drop(*SCHEMA.names), lambda r: r.drop("address.city", "address.zip"), lambda r: None, lambda r: r.replace(), lambda r: r.drop(),
    ):
        with pytest.raises(ValueError):
            redact(spark, source, str(tmp_path / "never"), declare)
        assert not (tmp_path / "never").exists()
    with pytest.raises(ValueError):
        redact(spark, source, str(tmp_path / "never"), lambda r: r.drop("tags"), Options(row_group_rows=5))


def test_results_that_do_not_fit(spark, source, tmp_path):
    for bad in (udf(lambda v: "text"), udf(lambda v: None)):
        with pytest.raises(Exception, match="user_id"):
            redact(spark, source, str(tmp_path / "bad"), lambda r: r.replace(user_id=bad))
        assert not (tmp_path / "bad").exists()
    with pytest.raises((EncodeError, Exception)):
        Redaction().replace(user_id=lambda c: F.lit(None)).apply(Reader(spark, source).read(), SCHEMA).collect()


def test_nothing_erased_survives(spark, source, tmp_path):
    run(spark, source, tmp_path, lambda r: r.where(score=between(0, 99)).replace(email=None))
    for f in (tmp_path / "out").glob("*.parquet"):
        raw = f.read_bytes()
        assert not any(f"u{i}@example.com".encode() in raw for i in range(10, 100))


def test_repr_hides_values():
    assert "secret" not in repr(Redaction(lambda r: r.where(email="secret").replace(name="secret"))) and "email" in repr(Redaction(lambda r: r.where(email="x").delete()))


def test_rewritten_files_keep_codec_and_blooms(spark, tmp_path):
    write(spark, f"{tmp_path}/in", ROWS, schema=SCHEMA, options=Options(compression="zstd", bloom_filters=["email", "user_id"]))
    redact(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda r: r.where(score=1).delete() and None or r.drop("user_id"))
    out = Reader(spark, f"{tmp_path}/out")
    assert out.codec == "zstd" and out.blooms == ["email"]


# folders with subfolders

PARTS = [{"id": i, "v": f"v{i % 7}", "p": ("x y", "a%b", None)[i % 3], "q": i % 2} for i in range(600)]


@pytest.fixture(scope="module")
def partitioned(spark, tmp_path_factory):
    """Partition folders whose files have one base name, as one Spark task writes them."""
    path = str(tmp_path_factory.mktemp("parts") / "in")
    spark.createDataFrame([(r["id"], r["v"], r["p"], r["q"]) for r in PARTS], "id long, v string, p string, q int").coalesce(1).write.partitionBy("p", "q").parquet(path)
    files = Reader(spark, path).files
    assert len(files) == 6 and len({f.rsplit("/", 1)[1] for f in files}) == 1
    return path


def test_partition_columns(spark, partitioned):
    r = Reader(spark, partitioned)
    by_id = lambda rows: sorted(rows, key=lambda x: x["id"])
    assert r.schema.names == ["id", "v", "p", "q"] and str(r.schema["q"].type) == "int32"
    assert by_id(r.rows()) == PARTS
    assert by_id(r.rows(where={"p": [None, "x y"], "q": 1}, columns=["id", "p"])) == [{"id": x["id"], "p": x["p"]} for x in PARTS if x["p"] in (None, "x y") and x["q"] == 1]
    assert sum(p["rows"] for p in r.scan_plan({"p": "a%b", "q": 0})) == 100 and len(r.scan_plan({"q": 1})) == 3
    everything = r.rows()
    for start, limit in ((0, 7), (95, 20), (100, None), (250, 300), (599, 5), (600, 5), (150, 0)):
        assert r.rows(start=start, limit=limit) == everything[start:][:limit]
        got = [x.asDict() for x in r.read(start=start, limit=limit).collect()]
        assert got == everything[start:][:limit] if limit is not None else by_id(got) == by_id(everything[start:])
    assert [x.asDict() for x in r.read(where={"v": "v3"}, start=200, limit=9).collect()] == [x for x in everything[200:] if x["v"] == "v3"][:9]


def test_rows_of_many_files(spark, partitioned, monkeypatch):
    """Counted by a job, they are what the footers say, and offsets go by them."""
    from tessera.sources import reader as module

    by_footer = Reader(spark, partitioned).rows_by_file()
    monkeypatch.setattr(module, "DRIVER_FILES", 2)
    r = Reader(spark, partitioned)
    assert r.rows_by_file() == by_footer == [100] * 6 and r.num_rows == 600
    assert [x.id for x in r.read(columns=["id"], start=250, limit=20).collect()] == [x["id"] for x in r.rows()[250:270]]


@pytest.mark.parametrize(
    "declare, want, files",
    [
        (lambda r: r.where(id=-1).delete(), lambda x: x, {"copied": 6, "rewritten": 0}),
        (lambda r: r.where(id=4).delete(), lambda x: None if x["id"] == 4 else x, {"copied": 5, "rewritten": 1}),
        (lambda r: r.where(p="a%b").delete(), lambda x: None if x["p"] == "a%b" else x, {"copied": 4, "rewritten": 2}),
        (lambda r: r.where(p=None, q=1).replace(v="-"), lambda x: x | {"v": "-"} if x["p"] is None and x["q"] else x, {"copied": 5, "rewritten": 1}),
        (lambda r: r.where(id=5).replace(q=7), lambda x: x | {"q": 7} if x["id"] == 5 else x, {"copied": 5, "rewritten": 1}),
        (lambda r: r.drop("p"), lambda x: {k: v for k, v in x.items() if k != "p"}, {"copied": 0, "rewritten": 6}),
    ],
)
def test_redaction_keeps_every_row_of_partitioned_folders(spark, partitioned, tmp_path, declare, want, files):
    report = redact(spark, partitioned, str(tmp_path / "out"), declare)
    rows = [y for y in map(want, PARTS) if y is not None]
    assert (report.rows_read, report.rows_deleted, report.files) == (600, 600 - len(rows), files)
    assert sorted(Reader(spark, str(tmp_path / "out")).rows(), key=lambda x: x["id"]) == rows


def test_plain_subfolders_with_one_base_name(spark, tmp_path):
    for k in range(3):
        spark.range(100 * k, 100 * k + 100).coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
        (tmp_path / "in" / f"s{k}").mkdir(parents=True)
        next((tmp_path / f"w{k}").glob("part-*")).rename(tmp_path / "in" / f"s{k}" / "data.parquet")
    source = str(tmp_path / "in")
    assert [r["id"] for r in Reader(spark, source).rows(start=150)] == list(range(150, 300))
    report = redact(spark, source, str(tmp_path / "out"), lambda r: r.where(id=-1).delete())
    assert (report.rows_read, report.files["copied"]) == (300, 3)
    assert [r["id"] for r in Reader(spark, str(tmp_path / "out")).rows()] == list(range(300))
    report = redact(spark, source, str(tmp_path / "out2"), lambda r: r.where(id=[7, 250]).delete())
    assert (report.rows_read, report.rows_deleted, report.files) == (300, 2, {"copied": 1, "rewritten": 2})
    assert sorted(r["id"] for r in Reader(spark, str(tmp_path / "out2")).rows()) == [i for i in range(300) if i not in (7, 250)]


def test_columns_named_like_helpers(spark):
    names = ["__deleted", "__changed", "__hit", "__new", "__file", "__row"]
    df = spark.createDataFrame([(i, *(names)) for i in range(9)], "id int, " + ", ".join(f"{n} string" for n in names))
    got = Redaction().where(id=[1, 2]).replace(__new="x", __hit="y").where(id=3).delete().apply(df).collect()
    assert [(r.id, r["__new"], r["__hit"], r["__deleted"]) for r in got] == [(i, "x" if i in (1, 2) else "__new", "y" if i in (1, 2) else "__hit", "__deleted") for i in range(9) if i != 3]

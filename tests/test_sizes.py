"""What larger tables showed: many tasks, tasks without rows, files of many row groups, executors of their own."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pyspark
import pytest

from tessera.operators import combine
from tessera.operators.filters import between
from tessera.operators.redact import Redaction
from tessera.plans import edges, registry
from tessera.sources import inspect, writer
from tessera.sources import keys as K
from tessera.sources.footer import below, copy_changed, opened
from tessera.sources.inspect import Inspector, _shown, leaf_of
from tessera.sources.notes import sorting_of
from tessera.sources.reader import Reader
from tessera.sources.writer import Options, write_frame, write_sorted

from .test_queries import D, normal


def late(spark, n=400):
    """Rows of which the first task has none, so that the first file has no row group."""
    return spark.range(0, n, 1, 4).filter(f"id >= {n // 4}").selectExpr("id", "cast(id as double) price", "cast(id as string) name")


@pytest.mark.parametrize("change", [lambda r: r.where(id=150).delete(), lambda r: r.drop("name")])
def test_encrypted_files_of_which_the_first_is_empty(spark, tmp_path, change):
    footer, price = K.Key.generate(), K.Key.generate(128)
    e = K.Encryption(footer, {"price": price}, aad_prefix=b"late")
    K.write_encrypted(late(spark), str(tmp_path / "in"), e)
    r = Reader(spark, str(tmp_path / "in"), keys=[footer, price])
    assert r.rows_by_file()[0] == 0 and r.secrets.encryption == e
    redaction = Redaction()
    change(redaction)
    report = redaction.run(spark, r, str(tmp_path / "out"))
    out = Reader(spark, str(tmp_path / "out"), keys=[footer, price])
    assert report.rows_read == 300 and out.secrets.encryption == e and len(out.rows()) == 300 - report.rows_deleted


def test_the_codec_of_files_of_which_the_first_is_empty(spark, tmp_path):
    write_frame(late(spark), str(tmp_path / "in"), options=Options(compression="zstd", bloom_filters=["name"]))
    r = Reader(spark, str(tmp_path / "in"))
    assert r.rows_by_file()[0] == 0 and (r.codec, r.blooms) == ("zstd", ["name"])
    Redaction().where(id=150).delete().run(spark, r, str(tmp_path / "out"))
    assert {x.codec for x in Inspector(spark, str(tmp_path / "out")).chunks().select("codec").collect()} == {"ZSTD"}


def test_a_shipped_table_is_open_to_other_processes(spark, tmp_path):
    """An executor of its own reads it, beside the driver."""
    script = tmp_path / "run.py"
    script.write_text(
        "from pyspark.sql import SparkSession\n"
        "from tessera.plans import edges, registry\n"
        f"s = SparkSession.builder.master('local-cluster[2,1,900]').config('spark.executor.memory', '900m').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()\n"
        "for _ in range(2):\n"
        "    df = registry.QUERIES['relational_table'](s, '/root/testdata/sf0.001')\n"
        "    print(df.rdd.getNumPartitions(), len(set(df.collect())))\n"
        "s.stop()\n"
    )
    home = tmp_path / "home"  # executors work in a folder of Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.split() == ["3", "25", "3", "25"], done.stderr[-2000:]


def test_zeros_and_values_just_above_the_bound_match(spark, tmp_path):
    values = [0.0, -0.0, 7.0, 14.0, 90.0, 90.00000001, 91.0, 92.5, None]
    spark.createDataFrame(list(enumerate(values)), "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.event_id for r in registry.QUERIES["where_float_nan_guard"](spark, str(tmp_path)).collect()) == [0, 1, 5, 7]


def test_a_bloom_filter_is_sized_by_its_row_group(spark, tmp_path):
    """Filters of all distinct values in every row group are held together until their file ends."""
    for name, rows in (("many", 100), ("one", None)):
        write_frame(spark.range(0, 20_000, 1, 1).selectExpr("id"), str(tmp_path / name), options=Options(bloom_filters=["id"], row_group_rows=rows))
    size = {name: sum(p.stat().st_size for p in (tmp_path / name).glob("*.parquet")) for name in ("many", "one")}
    r = Reader(spark, str(tmp_path / "many"))
    assert len(r.row_groups) == 200 and size["many"] < 5 * size["one"]
    asked = r.bloom_filter(3, "id")
    assert all(asked(n) for n in range(300, 400)) and sum(asked(n) for n in range(1000, 2000)) < 100


def test_rows_in_a_zone_are_shown_by_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(3000).selectExpr("id", "timestamp_seconds(id * 3600) at", "cast(timestamp_seconds(id) as timestamp_ntz) local", "if(id % 2 = 0, null, array(id)) more")
    write_frame(df, str(tmp_path / "x"))
    r = Reader(spark, str(tmp_path / "x"), "+05:30")
    shown = lambda x: (x["id"], str(x["at"]), str(x["local"]), x["more"])
    want = sorted(map(shown, r.each_row(where={"id": between(10, 2500)})))
    monkeypatch.setattr(Reader, "tables", None)  # which bring rows to the driver
    found = r.map_rows(shown, "id long, at string, local string, more array<long>", where={"id": between(10, 2500)})
    assert sorted(map(tuple, found.collect())) == want and len(want) == 2491
    assert registry.QUERIES["rows_in_a_time_zone"](spark, "/root/testdata/sf0.001").count() > 0


def test_pages_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """As the driver's own reading of the page index has them, for all types."""
    df = spark.range(2000).selectExpr(
        "id", "cast(id as int) i", "cast(id % 100 as byte) b", "id / 7 x", "cast(id as float) f", "id % 3 = 0 flag", "concat('é', id) text", "cast(cast(id as string) as binary) raw", "date_add(date'2020-01-01', cast(id as int)) day", "timestamp_seconds(id) at", "cast(timestamp_seconds(id) as timestamp_ntz) local",
        "cast(id as decimal(9, 2)) d9", "cast(id as decimal(18, 2)) d18", "cast(id as decimal(30, 5)) d30", "if(id < 500, null, id) late", "array(id, null) list", "named_struct('a', id, 'b', null) s", "map(id, 'x') m", "cast(null as string) none",
    )
    write_frame(df, str(tmp_path / "x"), options=Options(page_rows=100, row_group_rows=700))
    i, want = Inspector(spark, str(tmp_path / "x")), []
    for path in i.files:
        with opened(spark, path) as f:
            arrow = pq.read_metadata(path.removeprefix("file:")).schema
            assert [leaf_of(arrow.column(k)) for k in range(len(arrow))] == [f.leaf_type(x) for x in f.leaves]
            for g in range(len(f.blocks)):
                for column in f.leaves:
                    want += [(path, g, column, k, p.first_row, p.rows, p.offset, p.size, p.stats and p.stats.nulls, p.stats and _shown(p.stats.low), p.stats and _shown(p.stats.high)) for k, p in enumerate(f.pages(g, column))]
    monkeypatch.setattr(inspect, "opened", None)  # which opens footers on the driver
    found = list(map(tuple, i.pages().collect()))
    assert sorted(found, key=str) == sorted(want, key=str) and len(want) == 21 * 20


def test_one_byte_is_changed_in_a_copy(spark, tmp_path):
    raw = bytes(range(256)) * 40
    (tmp_path / "a").write_bytes(raw)
    copy_changed(spark, f"file:{tmp_path}/a", f"file:{tmp_path}/in/b", 9000)
    assert (tmp_path / "in" / "b").read_bytes() == raw[:9000] + bytes([raw[9000] ^ 255]) + raw[9001:]


@pytest.mark.parametrize("name", ["batches_with_offset_and_limit", "inspect_page_headers", "inspect_checksum_tally", "inspect_pages", "scan_bloom_filter", "scan_page_index", "scan_plan_prunes", "scan_row_groups", "sink_statistics", "batches_are_full"])
def test_row_groups_of_many_files(spark, monkeypatch, name):
    """No task sorts more than a few files' rows, and row groups are counted over all files."""
    monkeypatch.setattr(edges, "FILE_GROUPS", 2)
    r = Reader(spark, edges._grouped(spark, D))
    assert len(r.files) >= 5 and max(r.rows_by_file()) <= 4000 and r.num_rows == 15_000 and set(r.row_groups) == {1000}
    assert [x["o_orderkey"] for x in r.rows(columns=["o_orderkey"])] == list(range(15_000))
    df = registry.QUERIES[name](spark, D)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{D}/orders.parquet'")
    found = con.execute(registry.SQL[name])
    assert normal(df.collect(), df.columns) == normal(found.fetchall(), [x[0] for x in found.description])


def test_sorted_files_are_written_by_ranges(spark, tmp_path, monkeypatch):
    """One file for each folder, under one name, though no task sorts more than a range."""
    monkeypatch.setattr(writer, "RANGE_ROWS", 1000)
    sizes, whole = [], combine.merge_files
    monkeypatch.setattr(combine, "merge_files", lambda s, inputs, target: (sizes.extend(one for x in inputs for one in Reader(s, x).rows_by_file()), whole(s, inputs, target)))
    df = spark.range(10_000).selectExpr("(id * 7919) % 10000 id", "id % 3 part", "cast(id as string) text")
    write_sorted(df, str(tmp_path / "x"), ["id"], 10_000, Options(metadata={"owner": "us"}, sorting=["id"]), ["part"])
    r = Reader(spark, str(tmp_path / "x"))
    assert [below(f, r.folder) for f in r.files] == [f"part={k}/part-00000.parquet" for k in range(3)]
    assert len(sizes) >= 8 and max(sizes) <= 2500 and sum(sizes) == 10_000
    for f in r.files:
        ids = [x["id"] for x in Reader(spark, f).rows()]
        assert ids == sorted(ids) and Reader(spark, f).metadata["owner"] == "us" and sorting_of(spark, f) == [("id", False, True)]
    assert sorted(map(tuple, r.read(columns=["id", "part", "text"]).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError, match="exists"):
        write_sorted(df, str(tmp_path / "x"), ["id"], 10_000)


@pytest.mark.parametrize("name", ["redact_partitioned", "redact_partitioned_copies", "redact_tiers", "scan_offset_partitioned", "scan_partition_columns", "redact_keeps_metadata_and_sorting"])
def test_sorted_files_of_many_ranges(spark, monkeypatch, name):
    monkeypatch.setattr(writer, "RANGE_ROWS", 1000)
    df = registry.QUERIES[name](spark, D)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{D}/orders.parquet'")
    found = con.execute(registry.SQL[name])
    assert normal(df.collect(), df.columns) == normal(found.fetchall(), [x[0] for x in found.description])


def test_a_sorted_file_in_several_splits_is_rewritten_as_one(spark, tmp_path):
    """With its order, for which no task sorts."""
    write_sorted(spark.range(20_000).selectExpr("id", "id % 2 part", "cast(id * 7 as string) text"), str(tmp_path / "in"), ["id"], 20_000, Options(sorting=["id"]), ["part"])
    own = spark.newSession()
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(k, "20000")
    source = Reader(own, str(tmp_path / "in"))
    assert source.source_of(source.files[:1]).rdd.getNumPartitions() > 2
    seen = []
    own_frame = writer.write_frame
    with pytest.MonkeyPatch.context() as m:
        m.setattr(writer, "write_frame", lambda df, *a, **b: (seen.append(df), own_frame(df, *a, **b))[1])
        Redaction().where(id=between(None, 50)).replace(text="-").run(own, source, str(tmp_path / "out"))
    out = Reader(spark, str(tmp_path / "out"))
    assert len(out.files) == len(seen) == 2
    for f in out.files:
        ids = [x["id"] for x in Reader(spark, f).rows()]
        assert ids == sorted(ids) and len(ids) == 10_000 and sorting_of(spark, f) == [("id", False, True)]

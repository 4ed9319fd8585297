import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.sources import notes, thrift
from tessera.sources.inspect import Inspector
from tessera.sources.reader import Reader
from tessera.sources.writer import Options, write_frame


def footer_of(path):
    raw = open(path, "rb").read()
    return raw[-8 - int.from_bytes(raw[-8:-4], "little") : -8]


def test_footers_come_back_byte_for_byte(spark, tmp_path):
    write_frame(spark.range(5000).selectExpr("id", "id % 7 = 0 flag", "cast(id as string) text", "array(id, null) list", "named_struct('a', id / 3) s"), str(tmp_path / "x"), options=Options(bloom_filters=["text"], row_group_rows=900))
    files = [f.removeprefix("file:") for f in Reader(spark, str(tmp_path / "x")).files]
    pq.write_table(pa.table({"a": [1, 2], "b": [None, "x"]}), tmp_path / "y.parquet", sorting_columns=[pq.SortingColumn(0, True, False)])
    for f in [*files, tmp_path / "y.parquet"]:
        raw = footer_of(f)
        decoded = thrift.Decoder(raw)
        assert thrift.encode(thrift.STRUCT, decoded.record()) == raw and decoded.at == len(raw)


@given(st.dictionaries(st.integers(1, 300), st.one_of(st.integers(-(1 << 63), (1 << 63) - 1).map(lambda n: (thrift.I64, n)), st.booleans().map(lambda b: (thrift.TRUE, b)), st.binary(max_size=200).map(lambda b: (thrift.BINARY, b)), st.floats(allow_nan=False).map(lambda x: (thrift.DOUBLE, x)), st.lists(st.integers(-9, 9), max_size=20).map(lambda x: (thrift.LIST, (thrift.I32, x))), st.lists(st.booleans(), max_size=20).map(lambda x: (thrift.LIST, (thrift.TRUE, x)))), max_size=6))
def test_any_struct_comes_back(fields):
    got = thrift.Decoder(thrift.encode(thrift.STRUCT, fields)).record()
    plain = lambda d: {k: (thrift.TRUE if t == thrift.FALSE else t, v) for k, (t, v) in d.items()}
    assert plain(got) == fields


def test_notes_of_written_files(spark, tmp_path):
    path = str(tmp_path / "x")
    df = spark.range(3000).selectExpr("id", "id % 3 as part", "id * 2 twice").coalesce(1)
    write_frame(df, path, options=Options(metadata={"owner": "é", "empty": ""}, sorting=["id", ("twice", True, False)], bloom_filters=["id"]), partition_by=["part"])
    r = Reader(spark, path)
    assert len(r.files) == 3 and sorted(x["id"] for x in r.rows()) == list(range(3000))
    for f in r.files:
        one = Reader(spark, f)
        assert one.metadata["owner"] == "é" and one.metadata["empty"] == "" and "org.apache.spark.version" in one.metadata
        assert notes.sorting_of(spark, f) == [("id", False, True), ("twice", True, False)]
        assert one.blooms == ["id"] and pq.read_table(f.removeprefix("file:")).num_rows == 1000
    assert not [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".notes")]
    with pytest.raises(ValueError, match="no column 'x'"):
        write_frame(df, str(tmp_path / "y"), options=Options(sorting=["x"]))
    assert not os.path.exists(tmp_path / "y")
    # a second write adds its own notes to its own files only
    write_frame(df, path, options=Options(metadata={"owner": "me"}), partition_by=["part"], mode="append")
    assert sorted(Reader(spark, f).metadata["owner"] for f in Reader(spark, path).files) == ["me"] * 3 + ["é"] * 3


def test_page_headers_against_the_footers(spark, tmp_path):
    path = str(tmp_path / "x")
    write_frame(spark.range(10_000).selectExpr("id", "id % 5 low", "cast(id as string) text"), path, options=Options(page_rows=500, row_group_rows=4000, data_page_version=2))
    i = Inspector(spark, path)
    rows = i.page_headers().collect()
    assert {r.checksum for r in rows} == {"ok"} and {r.kind for r in rows} <= {"dictionary", "data v2"}
    assert sum(r["values"] for r in rows if r.column == "id" and r.kind != "dictionary") == 10_000
    by_chunk = {}
    for r in rows:
        by_chunk[r.file, r.row_group, r.column] = by_chunk.get((r.file, r.row_group, r.column), 0) + r.header + r.compressed
    assert by_chunk == {(r.file, r.row_group, r.column): r.compressed for r in i.chunks().collect()}
    assert {r.encoding for r in rows if r.column == "id" and r.kind == "data v2"} <= {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"}


def test_mismatching_bounds():
    from tessera.sources.footer import Stats

    beyond = Inspector._beyond
    chunk = Stats(10, 0, 5, 9)
    assert not beyond(Stats(5, 0, 5, 9), chunk) and beyond(Stats(5, 0, 4, 9), chunk) and beyond(Stats(5, 0, 5, 10), chunk)
    assert not beyond(Stats(5, 5), chunk) and not beyond(None, chunk) and not beyond(Stats(5, 0, "a" * 64, None), Stats(5, 0, "b", "c"))


def test_every_way_to_encrypt(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessera.errors import DecryptionError
    from tessera.sources import keys as K

    df = spark.range(1000).selectExpr("id", "concat('secret', id) s", "named_struct('a', id * 2, 'b', 'x') t")
    footer, one, two = K.Key.generate(), K.Key.generate(128), K.Key.generate()
    ways = {
        "uniform": K.Encryption(footer), "columns": K.Encryption(footer, {"s": one, "t.a": two}), "readable": K.Encryption(footer, {"s": one}, plaintext_footer=True), "ctr": K.Encryption(footer, {"s": one}, algorithm="AES_GCM_CTR_V1"),
        "prefix": K.Encryption(footer, aad_prefix=b"table 7"), "secret prefix": K.Encryption(footer, {"s": one}, aad_prefix=b"table 7", store_aad_prefix=False),
    }
    for name, e in ways.items():
        path, aad = str(tmp_path / name), b"table 7" if name == "secret prefix" else None
        assert K.write_encrypted(df, path, e) == 1000
        assert not any(b"secret9" in f.read_bytes() for f in (tmp_path / name).glob("*.parquet")), name
        got = K.read_encrypted(spark, path, [footer, one, two], aad_prefix=aad)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())), name
        assert got.filter(F.col("id") == 77).first().s == "secret77" and "EqualTo(id,77)" in got.filter(F.col("id") == 77)._jdf.queryExecution().toString()
        assert K.describe(spark, K.files_of(spark, path)[0], [footer, one, two], aad).encryption == e, name
        for ring in ([], [K.Key.generate()]):
            with pytest.raises(DecryptionError):
                K.read_encrypted(spark, path, ring, aad_prefix=aad).count()
        assert footer.hex() not in got._jdf.queryExecution().toString()
    with pytest.raises(DecryptionError):
        K.read_encrypted(spark, str(tmp_path / "secret prefix"), [footer, one]).count()
    with pytest.raises(DecryptionError):
        K.read_encrypted(spark, str(tmp_path / "secret prefix"), [footer, one], aad_prefix=b"other").count()
    assert K.read_encrypted(spark, str(tmp_path / "readable"), [], columns=["id"]).count() == 1000
    assert K.read_encrypted(spark, str(tmp_path / "columns"), {footer.id: footer}.get, columns=["id"]).agg(F.sum("id")).first()[0] == 499500


def test_encrypted_inputs_of_redaction_and_combination(spark, tmp_path):
    import io

    from tessera import cli
    from tessera.errors import DecryptionError
    from tessera.operators.combine import combine
    from tessera.operators.redact import Redaction
    from tessera.sources import keys as K

    footer, one = K.Key.generate(), K.Key.generate(128)
    ring, e = [footer, one], K.Encryption(footer, {"s": one}, aad_prefix=b"t")
    for k in range(3):
        K.write_encrypted(spark.range(100 * k, 100 * k + 100).selectExpr("id", "concat('secret', id) s").coalesce(1), str(tmp_path / f"in{k}"), e)
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"in{k}").glob("part-*")).rename(tmp_path / "in" / f"{k}.parquet")
    source = str(tmp_path / "in")
    r = Reader(spark, source, keys=ring)
    assert r.num_rows == 300 and [x["id"] for x in r.rows(start=150, limit=3)] == [150, 151, 152] and r.encrypted
    assert len(r.scan_plan({"id": 205})) == 1 and r.rows(where={"s": "secret7"}) == [{"id": 7, "s": "secret7"}]
    for bad in ([], [footer], [K.Key.generate()]):
        with pytest.raises(DecryptionError):
            Reader(spark, source, keys=bad)
    # a redaction's output is encrypted like its input, in copied and rewritten files
    report = Redaction().where(id=[5, 6]).delete().where(id=7).replace(s="-").run(spark, r, str(tmp_path / "out"))
    assert (report.rows_read, report.rows_deleted, report.rows_changed, report.files) == (300, 2, 1, {"copied": 2, "rewritten": 1})
    out = Reader(spark, str(tmp_path / "out"), keys=ring)
    assert out.num_rows == 298 and all(K.describe(spark, f, ring).encryption == e for f in out.files)
    report = Redaction().where(id=5).delete().run(spark, r, str(tmp_path / "plain"), Options(plaintext=True))
    assert report.files == {"copied": 0, "rewritten": 3} and Reader(spark, str(tmp_path / "plain")).num_rows == 299
    # combination: alike stays alike, copied byte for byte; else it must be said
    report = combine(spark, [r, r], str(tmp_path / "both"))
    assert report.inputs[0].groups_copied == 3 and Reader(spark, str(tmp_path / "both"), keys=ring).num_rows == 600
    with pytest.raises(ValueError, match="encrypted differently"):
        combine(spark, [r, Reader(spark, str(tmp_path / "plain"))], str(tmp_path / "mixed"))
    combine(spark, [r, Reader(spark, str(tmp_path / "plain"))], str(tmp_path / "mixed"), options=Options(encryption=K.Encryption(one)))
    assert Reader(spark, str(tmp_path / "mixed"), keys=[one]).num_rows == 599
    # the command line
    run = lambda *a: (cli.main(list(a), spark, o := io.StringIO()), o.getvalue())
    flags = ("--key", footer.hex(), "--key", "base64:" + __import__("base64").b64encode(one.raw).decode())
    assert run("cat", source, "2", *flags) == (0, '{"id":0,"s":"secret0"}\n{"id":1,"s":"secret1"}\n')
    assert run("cat", source)[0] == 1 and run("cat", source, "--key", "hex:00")[0] == 1
    assert run("combine", source, source, "--output", str(tmp_path / "cli"), "--plaintext", *flags) == (0, "600 rows\n")
    assert Reader(spark, str(tmp_path / "cli")).num_rows == 600
    assert run("combine", str(tmp_path / "cli"), "--output", str(tmp_path / "cli2"), "--encrypt-key", one.hex()) == (0, "600 rows\n")
    assert Reader(spark, str(tmp_path / "cli2"), keys=[one]).num_rows == 600
    assert cli.key_of("-", lambda _: one.hex()) == one and cli.key_of("raw:" + "k" * 16).bits == 128

import random

import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

import corpus_pipeline as C
from tessera.llm import quality, secrets

from .test_decontaminate import PASSAGE, brute
from .test_map_side import SECRETS, brute_quality
from .test_packing import check
from .test_simhash import brute_components

T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output rows."""
    rnd = random.Random(12)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    rows = [(k, prose(rnd.choice([20, 80, 300])), "en", "s", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1], "en", "s", 0) for k in range(0, 60, 6)]
    rows += [(200 + k, rows[k][1] + " tail", "en", "s", 0) for k in range(0, 60, 7)]
    rows += [(300 + k, PASSAGE + " " + prose(60 + 400 * (k % 2)), "en", "s", 0) for k in range(6)]
    rows += [(400 + k, prose(60) + " " + SECRETS[k] + " " + prose(9), None, None, None) for k in range(4)]
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "again " * 300, "en", "s", 0), (503, rows[1][1], "en", "s", 0), (503, rows[1][1], "en", "s", 0), (None, prose(70), "en", "s", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, f) in enumerate(C.STAGES):
        before = docs
        f(spark, docs, d).write.parquet(f"{d}/{k}")
        docs = spark.read.parquet(f"{d}/{k}")
        out.append((before.collect(), docs.collect(), docs.columns))
    return d, out


def by_id(rows):
    return sorted(((r.doc_id, r.text) for r in rows), key=repr)


def test_columns_stay(stages):
    assert [c for _, _, c in stages[1]][:-1] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4


def test_quality(stages):
    before, after, _ = stages[1][0]
    compress = zstandard.ZstdCompressor(level=1).compress
    assert by_id(after) == by_id([r for r in before if not brute_quality(r.text)[-1] and quality.compression((r.text or "").encode(), compress)[2]])
    assert {502, 500, 501} & {r.doc_id for r in after} == set()


def test_near_dedup(stages):
    before, after, _ = stages[1][1]
    named = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
    left = [r.doc_id for r in after]
    assert len(left) == len(set(left)) and None in left
    assert set(left) - {None} <= {c for _, _, c in brute_components(named)}
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in named}
    for i, a in shingles.items():
        close = [j for j, b in shingles.items() if len(a & b) >= 0.8 * len(a | b)]
        assert sum(j in left for j in close) <= 1
        if close == [i] and all(len(a & b) < 0.5 * len(a | b) for j, b in shingles.items() if j != i):
            assert i in left


def test_decontamination(stages):
    before, after, _ = stages[1][2]
    bad = {i for (i, _, n_hit, _, _) in brute([(r.doc_id, r.text) for r in before], [(1, PASSAGE)]) if n_hit}
    assert len(bad) == 6 and by_id(after) == by_id([r for r in before if r.doc_id not in bad])


def test_secrets(stages):
    before, after, _ = stages[1][3]
    assert by_id(after) == sorted(((r.doc_id, secrets.redact(r.text, secrets.scan(r.text))) for r in before), key=repr)
    assert all(r.n_chars == len(r.text) for r in after) and any("<hex>" in r.text or "<assign>" in r.text for r in after)


def test_packing_and_run(spark, stages):
    d, out = stages
    before, after, _ = out[4]
    check(after, [(r.doc_id, r.text) for r in before], 2048)
    assert sorted((r.doc_id or -1, r.doc_tokens) for r in C.run(spark, d).collect() if r.start == 0) == sorted((r.doc_id or -1, r.doc_tokens) for r in after if r.start == 0)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmno") for _ in range(6)) for _ in range(n))


def test_rows_without_an_id_or_with_one_id(spark, tmp_path):
    rnd = random.Random(4)
    a, b, c, d = (prose(rnd, 90) for _ in range(4))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, PASSAGE + " " + a), (None, b), (7, PASSAGE + " " + c), (7, d), (8, None), (None, None)]
    left = C.benchmark_decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert by_id(left) == sorted([(None, b), (7, d), (8, None), (None, None)], key=repr)
    rows = [(None, a), (None, a + " end"), (None, b), (5, b), (6, b), (7, c), (7, d), (7, d), (9, c.upper())]
    left = C.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert by_id([r for r in left if r.doc_id]) == sorted([(5, b), (7, c), (7, d)], key=repr)
    assert [r.text in (a, a + " end") for r in left if r.doc_id is None] == [True]


def test_near_dedup_chooses_rows_not_ids(spark):
    rnd = random.Random(5)
    a, b = prose(rnd, 90), prose(rnd, 90)
    for rows in ([(1, a), (5, a), (5, b)], [(1, a), (5, b), (5, a)], [(5, b), (5, a), (1, a)]):
        assert by_id(C.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "").collect()) == [(1, a), (5, b)]


def test_stages_take_odd_tables(spark, tmp_path):
    """Columns with the names that stages use inside, dots and quotes in names, very long texts, repeated rows, nulls in all columns."""
    rnd = random.Random(6)
    names = ["a.b", "it`s", "__blob", "__content", "__spans", "__row", "__at", "id", "file", "row", "blob", "spans", "place", "_metadata"]
    long = prose(rnd, 60_000)
    texts = [(1, long), (2, long + " end"), (3, prose(rnd, 200) + " " + SECRETS[0]), (4, None), (5, ""), (None, prose(rnd, 80)), (7, prose(rnd, 100) + " " + PASSAGE), (8, "x" * 300_000), (9, prose(rnd, 90)), (9, None), (None, None)]
    texts += [texts[2], texts[8]]
    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    docs = spark.createDataFrame([(i, t, *(None if k % 3 else f"v{k}" for k in range(len(names)))) for i, t in texts], f"doc_id long, text string, {quoted}")
    spark.createDataFrame([(1, PASSAGE), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = []
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append(sorted(docs.select("doc_id").toPandas()["doc_id"].fillna(-1)))
    assert ids == [[-1, 1, 2, 3, 3, 7, 9, 9], [-1, 1, 3, 7, 9], [-1, 1, 3, 9], [-1, 1, 3, 9]]
    assert docs.filter("doc_id = 1").first()["text"] == long
    assert C.packing(spark, docs, "").filter("start = 0").count() == 4
    for (name, stage), empty in zip(C.STAGES, [docs.limit(0)] * 5):
        assert stage(spark, empty, str(tmp_path)).count() == 0, name

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontaminate as D

from .helpers import ODD, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_near(docs, items, span, size=13):
    out = []
    for i, text in docs:
        w, found = words(text), set()
        for item, t in items:
            v = words(t)
            wins = [set(v[k : k + size]) for k in range(len(v) - size + 1)] if len(v) >= size else [set(v)] if v else []
            if any(win <= set(w[s : s + span]) for win in wins for s in range(len(w))):
                found.add(item)
        out.append((i, text, sorted(found, key=str)))
    return sorted(out, key=repr)


def brute(docs, items, size=13):
    out = Counter()
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for win in ([v[k : k + size] for k in range(len(v) - size + 1)] if len(v) >= size else [v] if v else []):
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add(None if item is None else str(item))
        out[i, len(w), len(hit), D.items_digest(list(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
DOCS = [
    (10, "Start: " + PASSAGE.upper() + " -- end"),
    (11, "x " * 400 + PASSAGE[8:] + " y"),
    (12, PASSAGE + " " + PASSAGE),
    (13, "tiny item, Tiny ITEM! other"),
    (14, "a a a a a a a a a a a a a a a a a a"),
    (15, "twelve thirteen fourteen"),
    (16, "été À la carte"),
    *ODD,
]
ITEMS = [(1, PASSAGE), (2, "tiny item"), (22, "tiny-item"), (3, "a " * 14), (4, None), (5, "..."), (6, "ÉTÉ"), (7, "été à"), (9, "x " * 13), (None, "twelve thirteen fourteen"), (2, "no id at all 1234")]


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 20])
def test_against_brute_force(spark, block_words, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_WORDS", 300)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, D.items_digest(r["items"]), r.contaminated) for r in D.decontaminate(frame(spark, DOCS), bench, block_words=block_words).collect())
    assert got == brute(DOCS, ITEMS)


@pytest.mark.parametrize("passes", [1, 8])
def test_no_id_is_not_the_item_named_null(spark, passes, monkeypatch):
    monkeypatch.setattr(D, "PASS_BLOCKS", passes)
    items = [("null", "tiny item"), (None, "été à"), ("", "twelve"), ("a", "twelve"), (None, "item other")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, D.items_digest(r["items"]), r.contaminated) for r in D.decontaminate(frame(spark, DOCS), bench, block_words=3).collect())
    assert got == brute(DOCS, items) and D.items_digest(["null", None]) in {x[3] for x in got}


@pytest.mark.parametrize("candidates", [1, 1 << 20])
def test_proximity_matches_of_items(spark, candidates, monkeypatch):
    monkeypatch.setattr(D, "CANDIDATES", candidates)
    monkeypatch.setattr(D, "SEGMENT_WORDS", 300)
    rnd = random.Random(3)
    docs = DOCS + [(100 + k, " ".join(rnd.choice("one two three red blue green item tiny".split()) for _ in range(rnd.choice([5, 40])))) for k in range(60)]
    items = ITEMS + [(30, "green blue red tiny"), (31, "item item one"), (32, "red")]
    got = D.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), near_words=6, block_words=30).collect()
    want = brute_near(docs, items, 6)
    assert sorted((r.doc_id or -1, r.near) for r in got) == sorted((i or -1, [None if x is None else str(x) for x in sorted(f, key=lambda x: D.by_name(None if x is None else str(x)))]) for i, _, f in want)


def test_one_word_repeated_stays_small():
    """20,000 times one word against windows of it: each distinct window once, a bounded number of positions at a time."""
    block = D.Block([("i", D.hash_words([b"a"] * 400)), ("j", D.hash_words([b"a"] * 200))], 13)
    assert len(block.windows) == 1 and block.items_of(np.array([0])) == ["i", "j"]
    seg = D.Segment.build([[b"a"] * 20_000, [b"b"]])
    block.number = seg.numbers(block.terms)
    window, start = seg.phrases(block)
    assert len(window) == 19_988 and D.merged(np.stack([start, start + 13], 1)).tolist() == [[0, 20_000]]


def test_rows_without_hits(spark, tmp_path):
    rows = [(1, "red blue", 1), (1, PASSAGE, 2), (None, "x " + PASSAGE, 3), (None, None, 4), (2, "", 5), (3, "red blue", 6), (3, "red blue", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long")
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    want = sorted((r for r in rows if r[2] not in (2, 3)), key=repr)
    docs.repartition(3).write.parquet(f"{tmp_path}/d")
    for d in (docs, spark.read.parquet(f"{tmp_path}/d"), docs.repartition(2)):
        left = D.without_hits(d, bench)
        assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=repr) == want
    assert D.without_hits(docs.limit(0), bench).count() == 0


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(frame(spark, []), bench).count() == 0
    assert {r.n_hit for r in D.decontaminate(frame(spark, DOCS), bench).collect()} == {0}


def test_pack_round_trip():
    s = D.Segment.build([[b"a", b"b", b"a"], [], [b"b"]])
    t = D.Segment.unpack([3, 0, 1], *s.pack())
    assert (s.keys == t.keys).all() and (s.terms == t.terms).all()


def test_proximity(spark):
    docs = [(1, "red one two blue three green"), (2, "red blue x x x x x x green"), (3, "green"), (4, "blue blue red green"), (5, None)]
    got = {(r.query, r.doc_id) for r in D.near_matches(D.build_index(frame(spark, docs)), [("q", b"Red green blue"), ("r", b"red blue"), ("n", b"")], 6).collect()}

    def near(text, terms, span):
        w = words(text)
        return any(set(terms) <= set(w[s : s + span]) for s in range(len(w)))

    assert got == {(q, i) for q, t in (("q", ["red", "green", "blue"]), ("r", ["red", "blue"])) for i, x in docs if near(x, t, 6)}

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as S
from tessera.llm.components import components, forest

from .helpers import ODD, frame


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=4):
    p = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (p[i] ^ p[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out[doc, p[i], min(ids, default=None)] += 1
    return out


def corpus(seed=3, n=60):
    rnd, rows = random.Random(seed), list(ODD)
    for k in range(n):
        words = [rnd.choice("abcdefghij") * rnd.randint(1, 5) for _ in range(rnd.choice([1, 3, 4, 30, 200]))]
        rows.append((100 + k, " ".join(words)))
        for e in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = "edit"
            rows.append((1000 + 10 * k + e, "\n".join(words).upper()))
    return rows


@pytest.mark.parametrize("tile", [2048, 4])
def test_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(S, "TILE", tile)
    rows = corpus()
    got = Counter((r.doc_id, r.print & (2**64 - 1), r.component_id) for r in S.simhash_components(frame(spark, rows)).collect())
    assert got == brute_components(rows)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 16)
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    prints = sorted({S.signed(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9)))) for _ in range(400)})
    rows = spark.createDataFrame([(p,) for p in prints], "print long")
    got, _ = S.links(rows.select(S.F.col("print").alias("id"), S.F.array("print").alias("print"), S.pigeonhole_keys(len(prints), 4).alias("keys")), 4)
    pairs = [(r.a, r.b) for r in got.collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in pairs)
    want = forest((a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert sorted(forest(pairs)) == sorted(want)


def test_every_number_of_blocks_finds_every_link():
    rnd = random.Random(2)
    for k in range(5, 9):
        masks = S.masks_of(k, 4)
        for _ in range(300):
            a = rnd.getrandbits(64)
            b = a ^ sum(1 << x for x in rnd.sample(range(64), 4))
            assert any(a & m == b & m for m in masks)
    assert [S.blocks_for(n, 4) for n in (10, 10**6, 10**8, 10**12)] == [5, 5, 6, 8]


def test_tiles_skip_only_what_cannot_link():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 1 << 14, 500).astype(np.uint64)
    x = x[np.argsort(np.bitwise_count(x), kind="stable")]
    pairs = [(int(a), int(b)) for a in x for b in x if a < b and int(a ^ b).bit_count() <= 2]
    tile = x.view(np.int64), x[:, None]
    assert sorted(forest(S.link_tiles(tile, tile, 2, True))) == sorted(forest(pairs))


@pytest.mark.parametrize("held", [500_000, 20])
def test_components_of_a_long_chain(spark, monkeypatch, held):
    monkeypatch.setattr("tessera.llm.components.HELD", held)
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {(r.a, r.b) for r in components(df).collect()} == {(1, i) for i in range(2, 301)} | {(1000, 1001)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(spark):
    assert S.simhash_components(frame(spark, [])).count() == 0


def test_near_components_catch_similar_texts(spark):
    rnd = random.Random(9)
    rows = [(1, None), (2, ""), (3, "solo words")]
    for k in range(40):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(rnd.choice([60, 200, 500]))]
        rows.append((100 + k, " ".join(words)))
        for _ in range(len(words) // 80):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((500 + k, "\n".join(words)))
    got = {r.doc_id: r.component_id for r in S.near_components(frame(spark, rows)).collect()}
    assert got[1] == got[2] == 1 and got[3] == 3
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = dict(rows)
    for k in range(40):
        a, b = shingles(texts[100 + k]), shingles(texts[500 + k])
        assert got[100 + k] == 100 + k
        if len(a & b) / len(a | b) >= 0.8:
            assert got[500 + k] == 100 + k
        else:
            assert got[500 + k] in (100 + k, 500 + k)


def templated(n, seed=5):
    """Texts of one template: each pair has the same long part and its own rest, at a Jaccard similarity of about 0.7."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    head = [word() for _ in range(164)]
    return [(k, " ".join(head + [word() for _ in range(34)])) for k in range(n)]


@pytest.mark.parametrize("side", [4096, 60])
def test_near_components_keep_templated_texts(spark, side, monkeypatch):
    monkeypatch.setattr(S, "SIDE_ROWS", side)
    rows = templated(400)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows[:20]]
    assert all(0.65 < len(a & b) / len(a | b) < 0.75 for a in sets for b in sets if a is not b)
    copies = [(1000 + k, rows[k][1].upper() + " end") for k in range(0, 400, 40)]
    got = {r.doc_id: r.component_id for r in S.near_components(frame(spark, rows + copies)).collect()}
    assert got == {k: k for k, _ in rows} | {k: k - 1000 for k, _ in copies}


@pytest.mark.parametrize("common", [0, 10, 64])
@pytest.mark.parametrize("share", [0.5, 0.9])
def test_link_similar_is_exact(share, common, monkeypatch):
    rnd = np.random.default_rng(4)
    pool = np.sort(rnd.integers(0, 1 << 63, 40).astype(np.uint64))
    sets = [np.sort(rnd.choice(pool, max(1, int(40 * share) - k % 7), replace=False)) for k in range(50)] + [pool[:0], pool[:0], pool[:4], pool[:5]]
    monkeypatch.setattr(S, "COMMON", common)
    ids = np.arange(len(sets))
    close = lambda a, b: 5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b))
    want = sorted(forest((i, j) for i in ids.tolist() for j in range(i) if close(sets[i], sets[j])))
    assert sorted(forest(S.link_similar(ids, sets, ids, sets, True))) == want and (50, 51) in want and (52, 53) in want
    across = sorted(forest((i, j) for i in ids[::2].tolist() for j in ids[1::2].tolist() if close(sets[i], sets[j])))
    assert sorted(forest(S.link_similar(ids[::2], sets[::2], ids[1::2], sets[1::2], False))) == across
    # names that stand for several rows: what they join together
    names = ids // 3
    found = S.link_similar(names, sets, names, sets, True)
    assert len(found) < len(set(names.tolist())) and all(a != b for a, b in found)
    assert sorted(forest(found)) == sorted(forest((i // 3, j // 3) for i, j in pairs_of(sets, close) if i // 3 != j // 3))


def pairs_of(sets, close):
    return [(i, j) for i in range(len(sets)) for j in range(i) if close(sets[i], sets[j])]


def test_large_group_keeps_edges_few(spark, monkeypatch):
    """One group of 600 copies over many tiles: pairs of tiles that are one component aren't compared, and edges stay below the rows."""
    monkeypatch.setattr(S, "TILE", 32)
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(8)]
    near = [(k, [S.signed(w ^ (1 << rnd.randrange(64))) for w in base], [1, 2]) for k in range(600)]
    other = [(1000 + k, [S.signed(rnd.getrandbits(64)) for _ in base], [1, 2 + k]) for k in range(40)]
    rows = spark.createDataFrame(near + other, "id long, print array<long>, keys array<long>").repartition(6)
    edges, tables = S.links(rows, 140)
    found = [(r.a, r.b) for r in edges.collect()]
    assert sorted(forest(found)) == [(0, k) for k in range(1, 600)]
    assert len(found) < 2 * 640 and len(tables) > 1


@pytest.mark.parametrize("side", [S.SIDE_ROWS, 25])
def test_near_components_against_brute_force(spark, side, monkeypatch):
    """Recall over edits of every size: each pair of similarity 0.8 or more is in one group, and no group joins what chains of such pairs don't."""
    monkeypatch.setattr(S, "SIDE_ROWS", side)
    monkeypatch.setattr(S, "TILE", side)
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for k in range(60):
        words = [word() for _ in range(rnd.choice([6, 12, 40, 150, 400]))]
        rows.append((10 * k, " ".join(words)))
        for e in range(1, 8):
            if rnd.random() < 0.7:
                words = list(words)
                for _ in range(max(1, len(words) * rnd.randint(1, 6) // 200)):
                    words[rnd.randrange(len(words))] = word()
                rows.append((10 * k + e, " ".join(words)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    close = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    pairs = [(i, j) for i in sets for j in sets if i < j and close(sets[i], sets[j])]
    want = dict((b, a) for a, b in forest(pairs))
    got = {r.doc_id: r.component_id for r in S.near_components(frame(spark, rows)).collect()}
    assert len(pairs) > 100 and got == {i: want.get(i, i) for i in sets}

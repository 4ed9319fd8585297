import random
import zlib

import numpy as np

from tessera.llm import language as L

from .helpers import ODD, frame

SYLLABLES = {"xa": ["ba", "do", "ki", "lu"], "yb": ["str", "ung", "ölf", "ech"]}


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.choice([2, 20, 150]))), lang) for i in range(n) for lang in [rnd.choice(["xa", "yb"])]]


def test_gradients_against_differences():
    net = L.BiGRU(["a", "b", "c"], units=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 6, (5, 4)).astype(np.uint8)
    mask = np.ones((5, 4))
    mask[3:, 1] = 0
    y = np.array([0, 1, 2, 1])

    loss, grad = net.gradients(x, mask, y)
    for k, v in net.w.items():
        for _ in range(6):
            at = tuple(rnd.integers(0, s) for s in v.shape)
            if k in ("gates", "cand"):
                at = (at[0], int(rnd.integers(0, 6)), at[2])
            was, eps = v[at], 1e-2
            v[at] = was + eps
            up, _ = net.gradients(x, mask, y)
            v[at] = was - eps
            down, _ = net.gradients(x, mask, y)
            v[at] = was
            assert abs((up - down) / (2 * eps) - grad[k][at]) < 2e-3 + 0.02 * abs(grad[k][at]), k


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, 1) for i, t, lang in rows] + [(10_000 + i, t, None, 1) for i, t in ODD if i] + [(None, "ba do", "xa", 1), (77777, "123 456 -", "zz", 1)], "doc_id long, text string, lang string, score int")
    net = L.fit(L.sample(docs, "doc_id", "text", "lang"))
    assert net.langs == ["xa", "yb"]
    got = {r.doc_id: r for r in L.identify(docs, net).collect()}
    test = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i, _ in test) and len(test) > 30
    assert np.mean([got[i].lang_pred == lang for i, lang in test]) >= 0.97
    assert got[10_001].lang_pred == got[10_002].lang_pred == got[10_003].lang_pred == got[77777].lang_pred == "und"
    assert got[None].held_out is None and all(0 <= r.score <= 1 for r in got.values())


def test_whole_texts_count():
    """A text is the mean over all its bytes, however they fall into windows and batches."""
    net = L.BiGRU(["a", "b"])
    rnd = np.random.default_rng(0)
    sizes = [1, 3, 111, 112, 113, 127, 128, 129, 208, 209, 224, 225, 1600, 0, 5000]
    texts = [rnd.integers(1, 256, n).astype(np.uint8).tobytes() for n in sizes]
    p = net.predict(texts)
    assert (p[13] == 0).all()
    for text, pooled in zip(texts, p):
        seen = np.zeros(len(text), int)
        total = np.zeros(2)
        for a in range(0, max(1, len(text)), L.STRIDE):
            if a and a + 2 * L.EDGE >= len(text):
                break
            part = text[a : a + 128]
            low, high = (L.EDGE if a else 0), (len(part) if a + 128 >= len(text) else 128 - L.EDGE)
            probs = net.positions(net.run(np.frombuffer(part.ljust(128, b"\0"), np.uint8).reshape(-1, 1).copy())[0])[low:high, 0]
            seen[a + low : a + high] += 1
            total += probs.sum(axis=0)
        assert (seen == 1).all()
        assert np.allclose(pooled, total / max(1, len(text)), atol=1e-4)


def test_positions_have_context_on_both_sides():
    """The states that a position answers from have read EDGE bytes or more on either side of it, unless the text ends."""
    w = L.Windows([b"x" * 1000, b"y" * 130, b"z"])
    at = w.start - np.array([0, w.start[w.owner == 1][0], w.start[w.owner == 2][0]])[w.owner]
    for owner, a, low, high in zip(w.owner, at, w.low, w.high):
        size = (1000, 130, 1)[owner]
        assert a == 0 or low >= L.EDGE
        assert a + high == size or L.WINDOW - high >= L.EDGE


def test_query_against_brute_force(spark, tmp_path):
    """The query's rows, computed again text by text from the same network."""
    rows = [(i, t, lang) for i, t, lang in corpus(200)] + [(1000 + k, t, "xa") for k, (_, t) in enumerate(ODD)] + [(None, "ba do", "xa"), (7, "ba do ki", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = L.fit(L.sample(docs, "doc_id", "text", "lang"))
    want = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        p = net.predict([raw])[0]
        letter = any(map(str.isalpha, t or ""))
        want.append((i, None if i is None else zlib.crc32(str(i).encode()) % 5 == 0, net.langs[int(p.argmax())] if letter else "und", round(float(p.max()), 4) if letter else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 4)) for r in L.op4_language_id(spark, str(tmp_path)).collect()]
    close = lambda a, b: a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3
    assert all(close(a, b) for a, b in zip(sorted(got, key=repr), sorted(want, key=repr))) and len(got) == len(want)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(L.sample(docs, "doc_id", "text", "lang")) is None
    assert L.identify(docs, None).count() == 0
    assert [r.lang_pred for r in L.identify(frame(spark, [(1, "abc")]), None).collect()] == ["und"]

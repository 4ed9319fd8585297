import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import passages, substrings, suffixes

from .helpers import ODD, frame


def brute_words(rows, window):
    last = passages.LAST
    texts = [(last if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for o, _, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last + 1), o)
    out = Counter()
    for o, i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < o:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_bytes(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = Counter()
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if times[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def corpus(seed, n=70):
    """Random prose with copies, shared passages in changing surroundings, edits, periodic text and overlaps."""
    rnd, rows = random.Random(seed), list(ODD)
    prose = lambda k: [rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(k)]
    common = [prose(rnd.randint(5, 40)) for _ in range(4)]
    for k in range(n):
        words = prose(rnd.choice([0, 3, 20, 60]))
        for _ in range(rnd.randint(0, 3)):
            words += rnd.choice(common) + prose(rnd.randint(0, 9))
        if k % 9 == 0:
            words += ["per", "iod"] * 40
        if k % 10 == 1:
            words += ["z"] * 70
        rows.append((100 + k, " ".join(words)))
        if k % 4 == 0 and words:
            words[rnd.randrange(len(words))] = "edited"
            rows.append((rnd.choice([3000 + k, 50 + k, None]), " ".join(words)))
        if k % 13 == 0:
            rows.append((5000 + k, " ".join(words)))
            rows.append((5000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, window, gram, most, cut", [(1, 10, 4, 256, 1 << 19), (2, 10, 2, 3, 1 << 19), (3, 7, 4, 256, 40), (4, 50, 16, 256, 1 << 19)])
def test_words_against_brute_force(spark, monkeypatch, seed, window, gram, most, cut):
    monkeypatch.setattr(passages, "MOST_CONTENTS", most)
    monkeypatch.setattr(passages, "SLICE", cut)
    rows = corpus(seed)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_substrings(frame(spark, rows), window=window, gram=gram).collect())
    assert got == brute_words(rows, window)


@pytest.mark.parametrize("seed, window, gram, most, cut", [(5, 30, 8, 256, 1 << 19), (6, 30, 4, 3, 1 << 19), (7, 20, 8, 256, 100), (8, 100, 32, 256, 1 << 19)])
def test_bytes_against_brute_force(spark, monkeypatch, seed, window, gram, most, cut):
    monkeypatch.setattr(passages, "MOST_CONTENTS", most)
    monkeypatch.setattr(passages, "SLICE", cut)
    rows = corpus(seed)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame(spark, rows), window=window, gram=gram).collect())
    assert got == brute_bytes(rows, window)


@pytest.mark.parametrize("shard, passes", [(50_000, 4), (60, 2), (60, 1)])
def test_reference_shards_against_brute_force(spark, monkeypatch, shard, passes):
    monkeypatch.setattr(substrings, "PASS_SHARDS", passes)
    rows, reference = corpus(11), [t for _, t in corpus(11)[20:60:3]] + [None, "", "too short"]
    windows = {tuple(w[k : k + 10]) for w in ((t or "").encode().split() for t in reference) for k in range(len(w) - 9)}
    want = Counter()
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - 9):
            if tuple(w[k : k + 10]) in windows:
                gone |= set(range(k, k + 10))
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    df = spark.createDataFrame([(t,) for t in reference], "text string")
    got = substrings.remove_reference(frame(spark, rows), df, window=10, shard_words=shard).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want and any(r.n_removed for r in got)
    assert {r.n_removed for r in substrings.remove_reference(frame(spark, rows), df.limit(0)).collect()} == {0}


def test_repeated_rows_keep_one_list_of_spans(spark):
    """Equal rows share the spans of their text, however many they are."""
    text = " ".join(f"w{k}" for k in range(300))
    texts = passages.texts_with_order(frame(spark, [(1, text)] * 40 + [(2, text)]), "doc_id", "text")
    kind = passages.Kind(False, 400, 128)
    spans = passages.repeated_windows(texts, kind, False, lambda c: suffixes.shard_masks(c, 400)).collect()
    alone = passages.Segments(kind.hashes(text.encode()), np.array([len(text)]), kind)
    assert len(spans) == 2 and all(len(r.spans) <= len(alone.start) for r in spans)


def test_equal_bytes():
    raw = b"abcabdabc"
    assert suffixes.equal_bytes(raw, np.array([0, 0, 3]), np.array([6, 3, 4]), 3).tolist() == [True, False, False]


def test_empty(spark):
    assert substrings.remove_substrings(frame(spark, [])).count() == 0
    assert suffixes.remove_repeats(frame(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60) | st.text(alphabet="ab", max_size=60).map(str.encode), st.integers(1, 80))
def test_suffix_array(raw, depth):
    got = suffixes.suffix_array(raw, depth).tolist()
    assert sorted(got) == list(range(len(raw)))
    assert [raw[i : i + depth] for i in got] == sorted(raw[i : i + depth] for i in range(len(raw)))
    prefix = suffixes.common_prefixes(raw, np.array(got, np.int64), depth)
    for k in range(1, len(got)):
        a, b = raw[got[k - 1] :], raw[got[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[k] == min(n, depth)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", max_size=25), max_size=6), st.integers(1, 6))
def test_automaton(texts, window):
    contents = [(" ".join(t).encode(), i // 2, i % 2 == 0) for i, t in enumerate(texts)]
    for (_, doc, again), t, (mask, later) in zip(contents, texts, substrings.shard_masks(contents, window)):
        want = [any(t[k : k + window] in u for u, (_, d, _) in zip(texts, contents) if d < doc) for k in range(len(t) - window + 1)]
        assert mask.tolist() == want
        assert later.all() if again else later.tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=25).map(str.encode), max_size=5))
def test_shard_of_suffixes(bodies):
    contents = [(b, 0, k % 3 == 2) for k, b in enumerate(bodies)]
    times = Counter(b[k : k + 5] for b, _, again in contents for k in range(len(b) - 4) for _ in range(1 + again))
    for b, (mask, later) in zip(bodies, suffixes.shard_masks(contents, 5)):
        assert mask.tolist() == later.tolist() == [times[b[k : k + 5]] > 1 for k in range(len(b) - 4)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(b"ab"), st.booleans()), max_size=60), st.integers(1, 80))
def test_suffix_array_of_wanted_starts(places, depth):
    raw, wanted = bytes(b for b, _ in places), np.array([w for _, w in places], bool)
    got = suffixes.suffix_array(raw, depth, wanted).tolist()
    assert sorted(got) == np.flatnonzero(wanted).tolist()
    assert [raw[i : i + depth] for i in got] == sorted(raw[i : i + depth] for i in got)

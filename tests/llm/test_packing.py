import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing as P

from .helpers import ODD, frame

T = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))

WORDS = P.Words(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*T.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, window):
    """Every id in exactly one piece, gapless sequences of at most a window; returns the padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length > 0
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(ids_of(t))
    assert set(pieces) == set(want)
    for i, lists in want.items():
        if len(lists) == 1:
            ids, at = lists[0], 0
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert sum(r.length for r in pieces[i]) == sum(map(len, lists))
    return padding


def test_pieces_cover_all_ids(spark):
    rnd = random.Random(4)
    docs = ODD + [(100 + i, " ".join(rnd.choice(["the", "Über", "naïve", "it's", "x1y2", "été", "snow"]) for _ in range(rnd.choice([0, 3, 50, 300])))) for i in range(80)]
    for window, opened in ((2048, 64), (64, 3)):
        rows = P.pack(frame(spark, docs).repartition(6), window=window, open_windows=opened).collect()
        assert check(rows, docs, window) == 0
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)


def test_empty(spark):
    assert P.pack(frame(spark, [])).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85 'abZé09.,<|>Ǻ"), st.characters(codec="utf-8")), max_size=40))
def test_words_give_the_library_s_ids(text):
    w = WORDS
    for x in (text, text + "<|endoftext|> naïve" + text):
        words = x.encode().split()
        w.learn(set(words))
        assert np.frombuffer(b"".join(w[v] for v in words), "<u4").tolist() == T.encode(x, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 5), st.integers(2, 16))
def test_packer_is_bounded_and_whole(lengths, opened, window):
    out = []
    p = P.Packer(out.append, window, opened)
    for i, n in enumerate(lengths):
        p.add(i, 0, np.arange(n, dtype="<u4").tobytes(), n)
        assert len(p.rooms) == len(p.held) <= opened
    assert all(sum(len(x[2]) for x in s) == 4 * window for s in out)
    rest = p.merge()
    assert sum(len(x[2]) for x in rest) < 4 * window
    P.powers(rest, out.append, window)
    ids = defaultdict(list)
    for i, start, raw, _ in sorted((x for s in out for x in s), key=lambda x: (x[0], x[1])):
        assert start == len(ids[i])
        ids[i] += np.frombuffer(raw, "<u4").tolist()
    assert {i: x for i, x in ids.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}
    for s in out:
        n = sum(len(x[2]) for x in s) // 4
        assert n == window or n & (n - 1) == 0


def test_long_words_are_not_kept():
    WORDS.learn({b"short", b"x" * 1000})
    assert np.frombuffer(WORDS[b"x" * 1000], "<u4").tolist() == T.encode("x" * 1000, add_special_tokens=False).ids
    WORDS.forget()
    assert b"short" in WORDS and b"x" * 1000 not in WORDS


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aeiouthnsrdlvméèßöžAIOéÀİ''.,!?0192|<>-_[]`{}~", min_size=1, max_size=24))
def test_plain_words_encode_as_the_library(word):
    WORDS.clear()
    WORDS.learn({word.encode()})
    assert np.frombuffer(WORDS[word.encode()], "<u4").tolist() == T.encode(word, add_special_tokens=False).ids

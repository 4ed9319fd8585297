import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import warc as W

PAGES = [
    (5, "http://www.example.com/b?z=1&a=2", "<p>é</p>"),
    (2, "https://example.com/a", "<p>é</p>"),
    (9, "https://example.com/a", "<p>é</p>"),
    (3, None, None),
    (1, "bad url\r\nX: y", ""),
    (7, "http://[oops", "x" * 300_000),
    (8, "http://b.org:8080", "\r\n\r\nWARC/1.1\r\n"),
    (None, "http://c.org/", "<p>é</p>"),
    (None, "http://c.org/", "only null ids"),
    (4, "http://d.org/", "tie"),
    (4, "http://d.org/", "tie"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, row int")


def brute(rows, least=0):
    out, seen = Counter(), {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        d = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        kind = "revisit" if len(raw) >= least and raw in seen else "response"
        out[i, len(raw), d, kind, seen[raw] if kind == "revisit" else None] += 1
        seen.setdefault(raw, i)
    return out


def test_round_trip_against_brute_force(spark):
    for least in (0, 100):
        got = W.archive_pages(frame(spark, PAGES).repartition(3), least_bytes=least).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(PAGES, least)


@pytest.mark.parametrize("fan, slots", [(64, 4), (3, 1), (1, 1)])
def test_history_is_globally_ordered(spark, monkeypatch, fan, slots):
    monkeypatch.setattr(W, "LEAST_CAPTURES", 20)
    monkeypatch.setattr(W, "FAN_IN", fan)
    monkeypatch.setattr(W, "slots", lambda _: slots)
    rnd = random.Random(3)
    rows = [(i, f"http://{rnd.choice(['hot', 'hot', 'a', 'b'])}.com/{rnd.randrange(5)}", str(rnd.randrange(60))) for i in range(400)]
    got = W.archive_pages(frame(spark, rows).repartition(7)).orderBy("key_range", "place").collect()
    keys = [(r.urlkey, r.timestamp, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 400 and len({r.key_range for r in got}) > (3 if slots == 1 else 4)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)


def test_empty(spark):
    assert W.archive_pages(frame(spark, [])).count() == 0


def test_archive_is_gzip_members(tmp_path):
    a, b = (gzip.compress(W.record(i, "http://x/", b"body" * i, False, None)) for i in (1, 2))
    (tmp_path / "x").write_bytes(a + b)
    for size in (7, 1 << 18):
        with open(tmp_path / "x", "rb") as f:
            got = list(W.members(f, size))
        assert [at for at, _ in got] == [0, len(a)]
        assert [W.parse(raw)["block"].endswith(b"body" * i) for i, (_, raw) in enumerate(got, 1)] == [True, True]


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    tagged = [[(v, i, k) for k, v in enumerate(sorted(r))] for i, r in enumerate(runs)]
    assert list(W.LoserTree([iter(r) for r in tagged], key=lambda x: x[0])) == sorted(x for r in tagged for x in r)


def test_url_keys():
    assert W.url_key("http://www.Example.com:80/A?b=2&a=1#f") == "com,example)/a?a=1&b=2"
    assert W.url_key("https://example.com:8080") == "com,example:8080)/"
    assert W.url_key(None) == "-"

"""Byte-level deduplication by suffix arrays, built by two-stage sorting.

Passages of the corpus that may repeat (see passages.py) are dealt into shards of bounded size.  In a shard, the
suffixes that are smaller than their successors are sorted directly; all others follow by one scan over the buckets
of first bytes, each placed before them in its own bucket.  The common prefixes of neighbours in the array then tell
which windows occur more than once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import B64, MIX1, mix64, table
from .passages import Kind, covered, repeated_windows, texts_with_order, with_spans

WINDOW_BYTES, GRAM_BYTES = 400, 128

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a byte later.  The last one isn't."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])  # the last places of runs
    after = np.searchsorted(change, np.arange(n))
    out = np.zeros(n, bool)
    some = after < len(change)
    at = change[after[some]]
    out[some] = t[at] < t[at + 1]
    return out


def suffix_array(raw: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes, sorted by their first depth bytes (and further ones as far as that costs nothing).

    wanted: a mask of the starts that are of use; others are sorted only where a wanted one follows from them.
    """
    t = np.frombuffer(raw, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    direct = smaller_than_next(t)
    if wanted is None:
        wanted = np.ones(n, bool)
    # an induced suffix follows from its successor, and so on up to the next one that is sorted directly
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(wanted, at, -1))
    before = np.cumsum(direct) - direct
    needed = (last >= 0) & (before == before[last])
    induced = needed & ~direct
    stage_one = np.array(sorted(np.flatnonzero(direct & needed).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    sizes = np.bincount(t[needed], minlength=256)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out = np.full(sizes.sum(), -1, np.int64)
    first = t[stage_one]
    ones = np.bincount(first, minlength=256)
    for c in np.flatnonzero(ones):  # they are the larger ones of their bucket
        end = starts[c] + sizes[c]
        out[end - ones[c] : end] = stage_one[np.searchsorted(first, c) : np.searchsorted(first, c, side="right")]
    fill = starts.copy()

    def place(suffixes: np.ndarray) -> None:
        """Puts induced suffixes, in their order, at the fronts of their buckets."""
        byte = t[suffixes]
        order = np.argsort(byte, kind="stable")
        suffixes, byte = suffixes[order], byte[order]
        kinds, at, many = np.unique(byte, return_index=True, return_counts=True)
        for c, a, k in zip(kinds.tolist(), at.tolist(), many.tolist()):
            out[fill[c] : fill[c] + k] = suffixes[a : a + k]
            fill[c] += k

    if needed[-1]:
        place(np.array([n - 1]))  # the last suffix follows the empty one
    for c in np.flatnonzero(sizes).tolist():
        # induced suffixes of this bucket that its own suffixes induce come in waves, one byte of a run each
        a = starts[c]
        while a < starts[c] + sizes[c]:
            z = fill[c] if a < fill[c] else starts[c] + sizes[c]
            here = out[a:z]
            before = here[here > 0] - 1
            before = before[induced[before]]
            if len(before):
                place(before)
            a = z
    return out[wanted[out]]


def common_prefixes(raw: bytes, array: np.ndarray, depth: int) -> np.ndarray:
    """The common prefix of each suffix in the array with the one before it, up to depth bytes.

    Blocks of falling powers of two are compared by 64-bit hashes; a block that agrees moves both suffixes on.  What comes
    out as a whole window is compared byte for byte afterwards.
    """
    n = len(array)
    levels, step, factor = [], 1, B64
    h = mix64(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(MIX1))
    while step <= depth and len(h):
        levels.append((step, h))
        h = h[:-step] * np.uint64(factor) + h[step:] if len(h) > step else h[:0]
        step, factor = 2 * step, factor * factor % (1 << 64)
    a, b = array[:-1].copy(), array[1:].copy()
    prefix = np.zeros(max(0, n - 1), np.int64)
    for k, (step, h) in enumerate(reversed(levels)):
        for _ in range(1 if k else depth // step):
            top = np.maximum(a, b)
            can = top < len(h)
            same = np.zeros(len(a), bool)
            same[can] = h[a[can]] == h[b[can]]
            a[same] += step
            b[same] += step
            prefix[same] += step
    return np.r_[0, np.minimum(prefix, depth)]


def equal_bytes(raw: bytes, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Whether the strings of size bytes at a and b are equal, byte for byte."""
    if not len(a):
        return np.zeros(0, bool)
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), size)
    return np.concatenate([(rows[a[k : k + 4096]] == rows[b[k : k + 4096]]).all(axis=1) for k in range(0, len(a), 4096)])


def shard_masks(contents: list[tuple[bytes, int, bool]], window: int = WINDOW_BYTES) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (body, first document, whether it has copies) its windows that occur at another place, for itself and its copies.

    Bodies are laid end to end, those with copies twice; a window never reaches over the end of its body, so only places with a
    whole window count.
    """
    raw = b"".join(body * (1 + again) for body, _, again in contents)
    ends = np.cumsum([len(body) for body, _, again in contents for _ in range(1 + again)], dtype=np.int64)
    array = suffix_array(raw, window, np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(raw)) >= window)
    same = common_prefixes(raw, array, window) >= window if len(array) else np.zeros(0, bool)
    same[same] = equal_bytes(raw, array[:-1][same[1:]], array[1:][same[1:]], window)
    twice = np.zeros(len(raw), bool)
    twice[array] = same | np.r_[same[1:], False]
    last = ends[np.cumsum([1 + again for _, _, again in contents], dtype=np.int64) - 1]
    masks = [twice[end - len(body) : end - window + 1] for (body, _, _), end in zip(contents, last)]
    return list(zip(masks, masks))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW_BYTES, gram: int = GRAM_BYTES, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (null without keep_bytes); a row per input row.

    Every byte covered by a string of window bytes that starts anywhere else as well goes, at all its places.  Null
    and empty texts have no bytes.  Repeated rows are places of their own, with or without an id, so they remove
    each other.  Texts of any length are compared whole; an empty table gives an empty result.
    """
    kind = Kind(False, window, gram)
    texts = texts_with_order(docs, key, text)
    spans = repeated_windows(texts, kind, False, lambda contents: shard_masks(contents, window))

    def finish(raw: bytes, found: list) -> tuple:
        if not found:
            return len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw if keep_bytes else None
        gone = covered(found, len(raw), window)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None

    return with_spans(texts, spans, finish, _OUT, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")

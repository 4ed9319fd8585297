"""Quality rules by compression bands.

zstandard ratios (compressed bytes / bytes) of a whole document and of its fixed-size chunks are held
against limits that depend on length: short texts compress badly, so their bands are wider and lie higher.
A ratio below the band means repetitive text, one above it incompressible text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import B64, MIX1, MIX2, batch, bounded_batches, bounds_of, hash_words, map_rows, mix64, per_group, table, texts_of

#: (bytes below, lowest ratio, highest ratio) for whole documents; the last holds for all longer ones.
DOCUMENT_BANDS = ((128, 0.30, 9.9), (256, 0.32, 1.00), (512, 0.30, 0.85), (1024, 0.28, 0.76), (2048, 0.22, 0.72), (4096, 0.20, 0.68), (8192, 0.18, 0.66), (float("inf"), 0.16, 0.65))
#: The same for chunks of a fixed size; what is left at the end belongs to the last chunk, and a short document is one chunk.
CHUNK_BYTES = 4096
CHUNK_BANDS = (*DOCUMENT_BANDS[:6], (float("inf"), 0.16, 0.68))
#: A document is rejected if more than this share of its bytes lies in chunks outside the band.
CHUNK_SHARE = 0.5
LEVEL = 1

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("document_ratio", pa.float64()), ("odd_chunk_share", pa.float64())])
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, document_ratio double, odd_chunk_share double"


def outside(size: int, ratio: float, bands) -> bool:
    for below, lowest, highest in bands:
        if size < below:
            return not lowest <= ratio <= highest
    return False


def compression(text: bytes, compress, chunk_bytes: int = CHUNK_BYTES) -> tuple[float, float, bool]:
    """The document's ratio, the share of its bytes in odd chunks, and the verdict (True: keep)."""
    if not text:
        return 0.0, 0.0, False
    ratio = len(compress(text)) / len(text)
    cuts = [chunk_bytes * k for k in range(max(1, len(text) // chunk_bytes))] + [len(text)]
    odd = 0
    for at, end in zip(cuts, cuts[1:]):
        one = ratio if len(cuts) == 2 else len(compress(text[at:end])) / (end - at)
        if outside(end - at, one, CHUNK_BANDS):
            odd += end - at
    share = odd / len(text)
    return ratio, share, not outside(len(text), ratio, DOCUMENT_BANDS) and share <= CHUNK_SHARE


def repeat_words(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document, the words in 3-word windows that occur twice or more in it."""
    n = len(words)
    covered = np.zeros(n, np.int64)
    if n >= 3:
        tri = words[:-2] * np.uint64(B64) + words[1:-1] * np.uint64(MIX1) + words[2:] * np.uint64(MIX2)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        inside = doc[:-2] == doc[2:]
        at = np.flatnonzero(inside)
        key = mix64(tri[at]) + doc[at].astype(np.uint64) * np.uint64(B64)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        starts = at[twice]
        for k in range(3):
            covered[starts + k] = 1
    return per_group(covered, bounds)


def judge(texts: list[bytes], compress) -> list:
    """The columns after doc_id, for some texts."""
    split = [x.split() for x in texts]
    counts = [len(x) for x in split]
    bounds = bounds_of(counts)
    repeated = repeat_words(hash_words([w for x in split for w in x]), bounds)
    chars, symbols, dup_lines, failed, kept, ratios, shares = [], [], [], [], [], [], []
    for text, n, rep in zip(texts, counts, repeated):
        letters = text.translate(None, b"\t\n\x0b\x0c\r ")
        chars.append(len(letters.decode("utf-8", "replace")))
        symbols.append(len(letters) - len(letters.translate(None, b"#*$%&|<>")))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
        bad = n < MIN_WORDS or 100 * int(rep) > MAX_REPEAT_PERCENT * n
        ratio, share, good = compression(text, compress)
        failed.append(bad)
        kept.append(not bad and good)
        ratios.append(ratio)
        shares.append(share)
    return [counts, chars, symbols, dup_lines, repeated, failed, kept, ratios, shares]


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row, map-side only.

    Null and empty texts have no words: all counts 0, base_failed, not kept.  A null key stays null;
    repeated rows each get their own row.  Ties don't arise.  A very long text is compressed once whole
    and once by chunk.  An empty table gives an empty result; further columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            yield batch(_SCHEMA, b.column(0), *judge(b.column(1).to_pylist(), compress))

    return texts_of(docs, key, text).mapInArrow(run, COLUMNS)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, in one map-side pass."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(judge(texts, compress)[6], pa.bool_()))

    return map_rows(docs, run)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))

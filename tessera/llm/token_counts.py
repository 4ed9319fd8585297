"""Token counts by a two-tier, map-side lookup.

Tier one is a broadcast hash table of frequent pre-token groups with their token counts, of bounded size.
Tier two is a cache in each Python worker, filled by encoding what both tiers miss.  No pre-token is shuffled.

A pre-token group is a run of non-space characters with the white space before it, or white space at a
text's end.  The byte-level pattern never joins characters across the start of such a group (a blank only
ever attaches to what follows it), so a text's tokens are the sum over its groups.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batch, bounded_batches, table, texts_of

VOCABULARY = "byte_bpe_50k.json"
LIMIT_TOKENS = 1024
#: The first tier: so many groups at most (about 2 MB), found in a sample of about so many rows from the whole table.
#: It only saves work: any other table gives the same counts.
FREQUENT_GROUPS, FREQUENT_ROWS = 32_768, 2_000
#: The second tier: it is emptied when it holds so many groups; longer ones (in characters) are in neither tier.
CACHE_GROUPS, LONGEST_GROUP = 400_000, 64

#: White space as Unicode defines it, which the tokenizer's \s means (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GROUP = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
COLUMNS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_loaded: dict = {}


class Counts(dict):
    """The second tier: group -> tokens; a group that is missing is encoded."""

    def __init__(self, tokenizer, frequent: dict[str, int]):
        super().__init__(frequent)
        self.tokenizer, self.frequent = tokenizer, frequent

    def tokens(self, texts: list[list[str]]) -> list[int]:
        """Tokens of texts, given as their groups.  Groups that are missing are encoded, all in one call; long ones aren't kept."""
        groups = set().union(*texts)
        new = [g for g in groups if g not in self]
        if len(self) + len(new) > CACHE_GROUPS + len(self.frequent):
            self.clear()
            self.update(self.frequent)
            new = [g for g in groups if g not in self]
        long = [g for g in new if len(g) > LONGEST_GROUP]
        self.update(zip(new, self.encoded(new)))
        out = [sum(map(self.__getitem__, x)) for x in texts]
        for g in long:
            del self[g]
        return out

    def encoded(self, groups: list[str]) -> Iterator[int]:
        return (len(e.ids) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False))


def tokenizer_of(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        added = sorted((x.content for x in t.get_added_tokens_decoder().values()), key=len, reverse=True)
        _loaded[path] = (t, re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None)
    return _loaded[path]


def groups_of(text: str, added) -> list[str]:
    """A text's groups.  Added tokens, which the tokenizer takes out first, are groups of their own."""
    if added is None or not added.search(text):
        return _GROUP.findall(text)
    out = []
    for k, part in enumerate(added.split(text)):
        out += [part] if k % 2 else _GROUP.findall(part)
    return out


def frequent_groups(source: DataFrame, path: str, rows: int = FREQUENT_ROWS, most: int = FREQUENT_GROUPS) -> dict[str, int]:
    """The first tier, from a sample of all partitions.  Tasks count the groups of their sampled rows; only groups that are
    no longer than LONGEST_GROUP come to the driver, a bounded number from each task."""
    n = source.count()
    if not n:
        return {}
    schema = pa.schema([("group", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for raw in b.column(0).to_pylist():
                seen.update(g for g in _GROUP.findall(raw.decode("utf-8", "replace")) if len(g) <= LONGEST_GROUP)
        top = seen.most_common(most)
        if top:
            yield batch(schema, *zip(*top))

    total: Counter = Counter()
    for r in source.select("text").sample(min(1.0, rows / n), seed=5).mapInArrow(run, "group string, n long").toLocalIterator():
        total[r.group] += r.n
        if len(total) > 8 * most:
            total = Counter(dict(total.most_common(4 * most)))
    top = sorted(total, key=lambda g: (-total[g], g))[:most]
    return dict(zip(top, (len(e.ids) for e in tokenizer_of(path)[0].encode_batch_fast(top, add_special_tokens=False)))) if top else {}


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = LIMIT_TOKENS) -> DataFrame:
    """One row per input row, map-side only.

    A null text counts as empty: 0 bytes, 0 tokens.  Null keys stay null, repeated rows are each counted,
    further columns are ignored, an empty table gives an empty result.  A text of any length is counted whole.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    source = texts_of(docs, key, text)
    frequent = spark.sparkContext.broadcast(frequent_groups(source, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, added = tokenizer_of(path)
        counts = _loaded.get((path, "counts"))
        if counts is None:
            counts = _loaded[path, "counts"] = Counts(tokenizer, frequent.value)
        for b in batches:
            raw = b.column(1).to_pylist()
            split = [groups_of(x.decode("utf-8", "replace"), added) for x in raw]
            tokens = counts.tokens(split)
            yield batch(_SCHEMA, b.column(0), [len(x) for x in raw], tokens, [x > limit for x in tokens])

    return source.mapInArrow(run, COLUMNS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

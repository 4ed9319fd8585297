"""A corpus pipeline of five operators: STAGES, and run(spark, sf_dir), which applies them to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, table, written
from tessera.llm.decontaminate import without_hits
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.secrets import redact_versions
from tessera.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep.

    Null and empty texts go, as texts of fewer than 50 words do; repeated rows share one fate; ids aren't looked at.  An
    empty table stays empty.  Further columns travel as they are.
    """
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id; one without an id only where no row of the group has one.

    Each row is judged by its own text, whatever its id: texts that share an id and aren't near copies all stay.  Repeated
    rows leave one, as do texts without words.  An empty table stays empty; further columns travel as they are.
    """
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any hit: a single passage of the benchmark, 13 words or a whole shorter item, is enough to drop a row.

    Each row is judged by its own text, also where ids are null or repeated.  Null and empty texts have no hits and stay;
    repeated rows share one fate; an empty benchmark drops nothing; an empty table stays empty.
    """
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """All rows, with marks in place of secrets; n_chars follows the text.

    ledger: a folder that is kept from run to run, so that later ones scan only what is new; None starts an empty one.
    Null and empty texts stay as they are; repeated rows are each redacted; an empty table stays empty.
    """
    marked = redact_versions(docs, ledger or shared_dir(spark, "ledger"))
    return marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else marked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row per piece, with its ids.

    Null and empty texts are one end id each; repeated rows are packed each; a null id stays null.  An empty table gives
    no sequence.  Further columns are left behind.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of documents; each stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs


#: SQL can't express tokenization, compression and fingerprints; tests compare each stage with a brute-force version.
ORACLE_SQL = None

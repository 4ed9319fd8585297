r"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its bytes).  The ledger holds the findings of each
(blob, rule set version) pair that was ever scanned; a run scans only pairs that the ledger lacks, appends them,
and joins the findings back to all paths and versions that have the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, bounded_batches, columns_of, map_rows, shared_dir, table, written

#: kind, pattern, fewest characters (of group 2 where there is one), in the order that settles ties.
BASE_RULES = (
    ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]+", 16),
)
#: A private key's block: to the END line of its label, whatever is between; where that is missing, over header lines and
#: the pieces of base64 that follow.  A run's last piece may be short: it goes after a long one, or if it fills its line.
_GAP = r"""(?:\s|\\[nrt]|["',>])"""
_KEY_BLOCK = (
    r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----(?:(?:(?!-----)[\s\S])*+-----END \1-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info|Comment):[^\r\n\\]*+)*+"
    rf"(?:(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+=*+)++(?:{_GAP}++[A-Za-z0-9+/]{{1,15}}+=*+)?+"
    rf"|{_GAP}*+[A-Za-z0-9+/]{{1,15}}+(?:=++|=*+(?=[ \t]*(?:[\r\n]|\\[nr]|\Z))))?+)"
)
#: Further kinds; what they find is added to the base spans.  The fourth value must be in a text that has a match.
MORE_RULES = (
    ("key_block", _KEY_BLOCK, 1, "-----BEGIN "),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1, "eyJ"),
    ("github", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", 1, "gh"),
    ("gitlab", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}", 1, "glpat-"),
    ("slack", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}|hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", 1, "xox|hooks.slack"),
    ("google", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}", 1, "AIza"),
    ("stripe", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 1, "k_live_|k_test_"),
    ("npm", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36,}", 1, "npm_"),
    ("url_login", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@?#]{1,100}:[^\s/:@?#]{3,100}@(?=[A-Za-z0-9\[])", 1, "://"),
    ("bearer", r"(?i:(?<![a-z])bearer\x20+)[A-Za-z0-9_~+/.=-]{20,}", 1, "earer |EARER "),
)


def version_of(*rules) -> str:
    """A name for rules that changes whenever any of them does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


RULE_VERSION = version_of(BASE_RULES, MORE_RULES)

#: A text without any of these has no match of the rule, which is cheaper to see.
_HEX = re.compile(r"[0-9a-f]{16,}")
_SCHEMA = pa.schema([("blob", pa.string()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])
FINDINGS = "blob string, n_assign long, n_access long, n_hex long, base string, spans string"

_compiled = [(k, re.compile(p), n, "") for k, p, n in BASE_RULES] + [(k, re.compile(p), n, sign) for k, p, n, sign in MORE_RULES]
_RANK = {k: i for i, (k, *_) in enumerate(_compiled)}
_N_BASE = len(BASE_RULES)


def _matches(kind: str, pattern: re.Pattern, least: int, sign: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "hex":  # the runs that are long enough are those that a run of least characters begins
        yield from (m.span() for m in _HEX.finditer(text))
    elif kind == "access":
        if "AKIA" in text:
            yield from (m.span() for m in pattern.finditer(text) if m.end() - m.start() >= least)
    elif kind == "assign":
        yield from (m.span() for m in pattern.finditer(text) if m.end(2) - m.start(2) >= least)
    elif any(x in text for x in sign.split("|")):
        yield from (m.span() for m in pattern.finditer(text))


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by the kinds' order."""
    found = [(rule[0], a, b) for rule in _compiled for a, b in _matches(*rule, text)]
    return sorted(found, key=lambda x: (x[1], _RANK[x[0]]))


def spans_text(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """text with a mark in place of each span; overlapping spans get one mark, of the first."""
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Findings of each row (blob, content as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(1).to_pylist():
                found = scan(raw.decode("utf-8", "replace"))
                base = [x for x in found if _RANK[x[0]] < _N_BASE]
                rows.append((*(sum(x[0] == k for x in base) for k, _, _ in BASE_RULES), spans_text(base), spans_text(found)))
            yield batch(_SCHEMA, b.column(0), *(zip(*rows) if rows else [[]] * 5))

    return blobs.mapInArrow(run, FINDINGS)


#: Names of the columns that scan_versions adds: this and those of the findings.
FOUND = "secrets: "


def addressed(versions: DataFrame, text: str) -> DataFrame:
    return versions.withColumn(FOUND + "blob", F.sha2(F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")), 256))


def update_ledger(versions: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the blobs of versions that the ledger lacks for rule_version, appends them, and returns the ledger's rows of that version.

    ledger: a folder in shared storage, which may not exist yet.  A blob held by a third of all rows is first reduced to
    one row per task.  A blob that is in the ledger twice, after two runs at once, counts once.
    """
    spark = versions.sparkSession
    bounded_batches(spark)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    unseen = addressed(versions, text).select(F.col(FOUND + "blob").alias("blob"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("content"))
    if known:
        done = spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == rule_version).select("blob")
        unseen = unseen.join(done, "blob", "left_anti")
    found = scan_blobs(unseen.dropDuplicates(["blob"])).withColumn("rules", F.lit(rule_version))
    found.write.mode("append").option("compression", "zstd").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger).filter(F.col("rules") == rule_version).drop("rules").dropDuplicates(["blob"])


LEDGER = FINDINGS + ", rules string"


def scan_versions(versions: DataFrame, ledger: str, text: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Adds the blob and its findings (FOUND and their names) to each row of versions, whose other columns are paths, commits and the like.

    Pairs of blob and rule_version that the ledger has aren't scanned again.  A null text is an empty blob.  Repeated rows
    keep their number; texts that are equal have equal findings.  An empty table gives an empty result.
    """
    # stored, so that Spark can split the join for a blob that very many rows have
    ours = written(update_ledger(versions, ledger, text, rule_version), "findings")
    findings = ours.select(*(F.col(c).alias(FOUND + c) for c in _SCHEMA.names))
    return addressed(versions, text).join(findings, FOUND + "blob", "left")


def redact_versions(docs: DataFrame, ledger: str, text: str = "text") -> DataFrame:
    """docs with marks in place of secrets, by the ledger's findings; texts without any, null and empty ones stay as they are.

    Repeated rows are each redacted, further columns travel as they are, an empty table stays empty.
    """
    # only blobs with findings are joined; stored, so that Spark can split the join for a blob that very many rows have; they
    # grow with the corpus, so they aren't broadcast, whatever their number
    marks = written(update_ledger(docs, ledger, text).filter("spans <> ''").select(F.col("blob").alias(FOUND + "blob"), F.col("spans").alias(FOUND + "spans")), "marks")
    found = addressed(docs, text).join(marks.hint("merge"), FOUND + "blob", "left").select(*columns_of(docs), FOUND + "spans")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            for k, spans in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if spans:
                    texts[k] = redact(texts[k], [(kind, int(a), int(z)) for kind, a, z in (x.rsplit(":", 2) for x in spans.split(","))])
            columns = [pa.array(texts, b.schema.field(k).type) if k == at else b.column(k) for k in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return map_rows(found, run, dropped=1)


def op8_secret_scans(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """ledger: a folder that is kept from run to run, so that later ones scan only what is new; None starts an empty one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, ledger or shared_dir(spark, "ledger"))
    of = lambda c: F.col(FOUND + c)
    return found.select("doc_id", *(of(c).alias(c) for c in ("n_assign", "n_access", "n_hex")), F.sha2(of("base").cast("binary"), 256).alias("base_sha256"), of("spans").alias("spans"))

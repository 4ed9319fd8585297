"""Helpers that the operators of this subpackage share: Arrow batches, hashing, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Arrow batches sent to Python workers hold at most so many rows and bytes, so that a worker's memory
#: doesn't follow the length of the texts.  One row larger than this travels alone.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

#: Odd multipliers for rolling hashes modulo 2**64 (fixed values).
B64, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

WORD_SPACE = b"\t\n\x0b\x0c\r "


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
            sc.setCheckpointDir(root)
            root = sc.getCheckpointDir()
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one.  It goes when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Removes tables that written() made, once nothing that is still to be evaluated reads them."""
    for df in tables:
        remove_dir(df.sparkSession, df._stored_at)


#: Names of a row's place in storage, which no table has for columns of its own.
PLACE_FILE, PLACE_ROW = "place of a row: file", "place of a row: number"


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df by their exact names, which may have dots and quotes in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], dropped: int = 0) -> DataFrame:
    """df through mapInArrow with its schema, less so many columns at the end; run gets columns by place, whatever their names."""
    fields = df.schema.fields
    inside = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(fields)])
    left = len(fields) - dropped
    return df.toDF(*inside.names).mapInArrow(run, StructType(inside.fields[:left])).toDF(*df.columns[:left])


def placed(df: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """df with PLACE_FILE (a hash of the file's path) and PLACE_ROW, which tell its rows apart on every evaluation.

    A plain scan of Parquet files has them; anything else is written first, and the second result has that table.
    """
    tables = []
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "parquet" not in df._jdf.queryExecution().analyzed().toString().split("\n")[0].lower():
        df = written(df, "rows")
        tables.append(df)
    at = df.metadataColumn("_metadata")
    return df.select("*", F.xxhash64(at["file_path"]).alias(PLACE_FILE), at["row_index"].alias(PLACE_ROW)), tables


def texts_of(df: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key, the text as UTF-8 bytes (null: empty) and further columns; extra columns of the input don't travel."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"), *(F.col(f"`{c}`") for c in more))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix64(h: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, in place on a fresh array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(MIX1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX2)
    h ^= h >> np.uint64(31)
    return h


def bounds_of(counts: list[int]) -> np.ndarray:
    """Start offsets of consecutive groups, with the end of the last."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def per_group(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups, which may be empty."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def crc32_text(x: int) -> int:
    return zlib.crc32(str(x).encode())


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def repo_on_path() -> str:
    return os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

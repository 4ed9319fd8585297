"""Footers' notes on written files: key/value metadata and sorting columns, which Spark's writer can't set.

Each file's pages are copied as they are and a new footer is written behind them, by a task for some files each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from . import thrift

#: Metadata that describe a schema, and Spark's own, which its writer sets.
OF_SCHEMA = ("ARROW:schema", "pandas")
OF_SPARK = "org.apache.spark."


def add_notes(spark: SparkSession, files: list[str], metadata: dict[str, str] | None, sorting: list[tuple[int, bool, bool]] | None = None) -> None:
    """Adds metadata and sorting columns to files."""
    if not files or not metadata and not sorting:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                folder, _, name = path.rpartition("/")
                fresh = f"{folder}/.{name}.notes"
                with fs.open_input_file(path) as f:
                    size = f.size()
                    f.seek(size - 8)
                    tail = f.read(8)
                    if tail[4:] != b"PAR1":
                        raise ValueError(f"{file}: no plain footer")
                    start = size - 8 - int.from_bytes(tail[:4], "little")
                    f.seek(start)
                    footer = thrift.with_notes(thrift.Decoder(f.read(size - 8 - start)).record(), metadata, sorting)
                    raw = thrift.encode(thrift.STRUCT, footer)
                    f.seek(0)
                    with fs.open_output_stream(fresh) as out:
                        left = start
                        while left:
                            part = f.read(min(left, 8 << 20))
                            out.write(part)
                            left -= len(part)
                        out.write(raw + len(raw).to_bytes(4, "little") + b"PAR1")
                # the old sum of the file's bytes would no longer hold
                crc = f"{folder}/.{name}.crc"
                if fs.get_file_info(crc).type != pyarrow.fs.FileType.NotFound:
                    fs.delete_file(crc)
                fs.move(fresh, path)
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    done = spark.createDataFrame([(f,) for f in files], "path string").repartition(tasks, "path").mapInArrow(run, "n long").agg({"n": "sum"}).first()[0]
    if done != len(files):
        raise RuntimeError(f"{done} of {len(files)} files have their notes")


def kept_metadata(metadata: dict[str, str], same_schema: bool) -> dict[str, str]:
    """What a rewritten file keeps of its source's metadata."""
    return {k: v for k, v in metadata.items() if not k.startswith(OF_SPARK) and (same_schema or k not in OF_SCHEMA)}


def sorting_of(spark: SparkSession, path: str) -> list[tuple[str, bool, bool]]:
    """The sorting columns that all row groups of a file have: (leaf, descending, nulls first)."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getFileStatus(jpath).getLen()
    f = fs.open(jpath)
    try:
        f.seek(size - 8)
        length = int.from_bytes(bytes(f.read() for _ in range(4)), "little")
        f.seek(size - 8 - length)
        footer = spark._jvm.org.apache.parquet.format.Util.readFileMetaData(f)
    finally:
        f.close()
    found = None
    for group in footer.getRow_groups():
        columns = group.getSorting_columns()
        leaves = [".".join(c.getMeta_data().getPath_in_schema()) for c in group.getColumns()]
        here = [(leaves[c.getColumn_idx()], c.isDescending(), c.isNulls_first()) for c in columns] if columns is not None else []
        found = here if found is None else found[: next((k for k, (a, b) in enumerate(zip(found, here)) if a != b), min(len(found), len(here)))]
    return found or []

"""Relational sources: a table over JDBC, read in parallel ranges, with a schema mapped from its columns' metadata."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from ..schema import Schema, from_relational
from .storage import scratch
from .writer import Options, write_frame


def read_table(spark: SparkSession, url: str, table: str, columns: Iterable[dict] | None = None, key: str | None = None, tasks: int = 0, **options: str) -> DataFrame:
    """The rows of a table.  columns: metadata for from_relational(), whose types the result then has.

    With key, an integer column, its range is read in so many tasks (by default as many as the cluster has slots);
    filters and projections on the result go to the database.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        if low is not None and high > low:
            reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(tasks or spark.sparkContext.defaultParallelism))
    df = reader.load()
    if columns is None:
        return df
    schema = from_relational(columns)
    names, types = {c.lower(): c for c in df.columns}, dict(df.dtypes)
    out = []
    for f, s in zip(schema.fields, schema.to_spark().fields):
        c = names.get(f.name.lower())
        if c is None:
            raise ValueError(f"no column {f.name!r} in {table}")
        same = types[c] == s.dataType.simpleString() or f.type.nested
        out.append((F.col(f"`{c}`").cast(s.dataType) if same else coerce.column(F.col(f"`{c}`"), f.type, types[c]).cast(s.dataType)).alias(f.name, metadata=s.metadata))
    return df.select(out)


def export_table(spark: SparkSession, url: str, table: str, path: str, columns: list[dict], key: str | None = None, options: Options | None = None, **jdbc: str) -> int:
    """Writes a table to Parquet in its mapped schema; returns the number of rows."""
    return write_frame(read_table(spark, url, table, columns, key, **jdbc), path, Schema(from_relational(columns).fields), options)


def shipped_table(spark: SparkSession, table: str, columns: dict[str, str], rows: Iterable[tuple]) -> str:
    """The URL of a read-only database with a small table, columns being name -> SQL type, which the driver and every executor can open.

    The driver fills an embedded database; its files go to the executors' class paths in a jar, since such a database in a folder
    or in memory is open to one process alone.
    """
    jvm = spark._jvm
    name, folder = f"tessera{uuid.uuid4().hex}", tempfile.mkdtemp(prefix="tessera-")
    embedded, at = jvm.org.apache.derby.jdbc.EmbeddedDriver(), f"{folder}/{name}"
    nothing = jvm.java.util.Properties()
    try:
        c = embedded.connect(f"jdbc:derby:{at};create=true", nothing)
        c.createStatement().execute(f'CREATE TABLE {table} ({", ".join(f"{n} {kind}" for n, kind in columns.items())})')
        into = c.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})")
        for row in rows:
            for k, v in enumerate(row, 1):
                into.setObject(k, v)
            into.executeUpdate()
        c.close()
        try:
            embedded.connect(f"jdbc:derby:{at};shutdown=true", nothing)
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # which says that it is shut down
                raise
        for lock in Path(at).glob("*.lck"):
            lock.unlink()
        packed = Path(shutil.make_archive(f"{folder}/packed", "zip", folder, name))
        path = scratch(spark, name) + ".jar"
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(jpath)
        out.write(packed.read_bytes())
        out.close()
        fs.deleteOnExit(jpath)
        spark._jsc.addJar(path)
        _also_here(spark, packed)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    shutil.rmtree(at, ignore_errors=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"jdbc:derby:classpath:{name}"


def _also_here(spark: SparkSession, jar: Path) -> None:
    """Puts a jar on the driver's class path, where addJar() doesn't."""
    jvm = spark._jvm
    url, thread = jvm.java.net.URL(jar.as_uri()), jvm.java.lang.Thread.currentThread()
    loader = thread.getContextClassLoader()
    while loader is not None and not any(m.getName() == "addURL" for m in loader.getClass().getMethods()):
        loader = loader.getParent()
    if loader is not None:
        loader.addURL(url)
        return
    urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = url
    thread.setContextClassLoader(jvm.java.net.URLClassLoader(urls, thread.getContextClassLoader()))

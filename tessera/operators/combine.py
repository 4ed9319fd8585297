"""Combination: many inputs into one dataset, with the same schema, their union, their intersection or a given one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, IncompatibleSchema
from ..schema import Field, Schema, spark_type

PER_SECOND = {"millis": 10**3, "micros": 10**6, "nanos": 10**9}


@dataclass
class InputReport:
    rows: int = 0
    groups_copied: int = 0
    groups_rewritten: int = 0
    filled: list[str] = field(default_factory=list)
    widened: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)


@dataclass
class Report:
    rows: int
    inputs: list[InputReport]
    schema: Schema


def output_schema(schemas: list[Schema], want: Any = None) -> Schema:
    """What a combination makes; raises IncompatibleSchema with the conflicts of all inputs."""
    if not schemas:
        raise ValueError("nothing to combine")
    conflicts: list[Conflict] = []
    if want is None:
        for k, s in enumerate(schemas[1:], 1):
            conflicts += [replace(c, source=k) for c in _differences(schemas[0], s)]
        if conflicts:
            raise IncompatibleSchema(conflicts, "the inputs' schemas differ")
        return schemas[0]
    if isinstance(want, Schema):
        for k, s in enumerate(schemas):
            conflicts += [replace(c, source=k) for c in s.fits(want)]
        if conflicts:
            raise IncompatibleSchema(conflicts, "the inputs don't fit the schema")
        return want
    if want not in ("union", "intersect"):
        raise ValueError("schema is None, 'union', 'intersect' or a Schema")
    out = schemas[0]
    for k, s in enumerate(schemas[1:], 1):
        try:
            out = out.union(s) if want == "union" else out.intersect(s)
        except IncompatibleSchema as e:
            conflicts += [replace(c, source=k) for c in e.conflicts]
    if conflicts:
        raise IncompatibleSchema(conflicts, f"no {want} of the inputs' schemas")
    return out


def _differences(a: Schema, b: Schema) -> list[Conflict]:
    if a == b:
        return []
    out = []
    theirs = {f.name: f for f in b.fields}
    for f in a.fields:
        g = theirs.pop(f.name, None)
        if g is None:
            out.append(Conflict(f.name, str(f.type), "absent", "the input lacks it"))
        elif f != g:
            out.append(Conflict(f.name, str(f), str(g), "they differ"))
    out += [Conflict(n, "absent", str(g.type), "only this input has it") for n, g in theirs.items()]
    return out or [Conflict("", ", ".join(a.names), ", ".join(b.names), "the order differs")]


def fitted(c: Column, a: Field, b: Field) -> Column:
    """A column of field a as field b holds it."""
    x, y = a.type, b.type
    if x == y:
        return c
    if y.kind == "struct":
        mine = {f.name: f for f in x.fields}
        members = (fitted(c.getField(f.name), mine[f.name], f).alias(f.name) if f.name in mine else F.lit(None).cast(spark_type(f.type)).alias(f.name) for f in y.fields)
        return F.when(c.isNotNull(), F.struct(*members))
    if y.kind == "list":
        return F.transform(c, lambda e: fitted(e, x.fields[0], y.fields[0]))
    if y.kind == "map":
        return F.transform_values(F.transform_keys(c, lambda k, _: fitted(k, x.fields[0], y.fields[0])), lambda _, v: fitted(v, x.fields[1], y.fields[1]))
    if y.kind == "time" or y.kind == "timestamp" and y.unit == "nanos":
        if x.kind == "timestamp" and x.unit != "nanos":
            return (F.unix_micros(c if x.utc else c.cast("timestamp")) * 1000).cast(spark_type(y))
        return (c.cast("long") * (PER_SECOND[y.unit] // PER_SECOND[x.unit])).cast(spark_type(y))
    return c.cast(spark_type(y))


def _changes(a: tuple[Field, ...], b: tuple[Field, ...], prefix: str, report: InputReport) -> None:
    mine, theirs = {f.name: f for f in a}, {f.name: f for f in b}
    report.dropped += [prefix + n for n in mine if n not in theirs]
    for n, g in theirs.items():
        if n not in mine:
            report.filled.append(prefix + n)
        elif mine[n].type.kind == g.type.kind == "struct":
            _changes(mine[n].type.fields, g.type.fields, f"{prefix}{n}.", report)
        elif mine[n].type != g.type:
            report.widened.append(prefix + n)


def combine_frames(frames: list[DataFrame], schema: Any = None, schemas: list[Schema] | None = None) -> DataFrame:
    """The rows of all frames, one after another, lazily; a union of projections that only narrow, widen and fill."""
    schemas = schemas or [Schema.from_spark(f.schema) for f in frames]
    return _union(frames, schemas, output_schema(schemas, schema))


def _union(frames: list[DataFrame], schemas: list[Schema], out: Schema) -> DataFrame:
    target = out.to_spark()

    def shaped(df: DataFrame, mine: Schema) -> DataFrame:
        own = {f.name: f for f in mine.fields}
        return df.select(*((fitted(F.col(f"`{f.name}`"), own[f.name], f) if f.name in own else F.lit(None)).cast(s.dataType).alias(f.name, metadata=s.metadata) for f, s in zip(out.fields, target.fields)))

    return reduce(DataFrame.unionAll, (shaped(df, s) for df, s in zip(frames, schemas)))


def combine(spark: SparkSession, inputs: list[Any], target: str, schema: Any = None, options: Any = None) -> Report:
    """Writes the rows of all inputs (paths or Readers) to target, in order.

    All schemas are checked before anything is written.  Inputs with the output's very schema have their files
    copied byte for byte, with their statistics and bloom filters; others are projected and written in one job each.
    Inputs that are encrypted alike give an output of the same kind; for others options must say how it is encrypted.
    File names keep the order of the inputs.
    """
    from ..sources.footer import copy_files
    from ..sources.reader import Reader
    from ..sources.writer import like, write_frame

    if isinstance(inputs, (str, Reader)):
        raise ValueError("inputs is a list")
    if options and (options.row_group_bytes or options.row_group_rows):
        raise ValueError("row groups keep their boundaries: row_group_bytes and row_group_rows can't be given")
    readers = [x if isinstance(x, Reader) else Reader(spark, x) for x in inputs]
    out = output_schema([r.schema for r in readers], schema)
    encryptions = [r.secrets.encryption if r.secrets else None for r in readers]
    if options and (options.encryption or options.plaintext):
        encryption = options.encryption
    elif any(e != encryptions[0] for e in encryptions):
        raise ValueError("the inputs are encrypted differently: give an encryption, or plaintext")
    else:
        encryption = encryptions[0] and encryptions[0].only(out.names)
    hadoop, jpath = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(target).getFileSystem(hadoop)
    if fs.exists(jpath(target)):
        raise ValueError(f"{target} exists")
    reports = []
    try:
        fs.mkdirs(jpath(target))
        for k, r in enumerate(readers):
            report = InputReport()
            _changes(r.schema.fields, out.fields, "", report)
            if r.schema == out and not r.partitions and encryptions[k] == encryption:
                copy_files(spark, {path: f"{target}/part-{k:05d}-{n:05d}.parquet" for n, path in enumerate(r.files)})
                groups = r.row_groups
                report.rows, report.groups_copied = sum(groups), len(groups)
            else:
                own = f"{target}/.input-{k}"
                report.groups_rewritten = len(r.row_groups)
                report.rows = write_frame(_union([r.read()], [r.schema], out), own, out, replace(options or like(r, out), encryption=encryption), strict=False)
                for n, status in enumerate(sorted((s for s in fs.listStatus(jpath(own)) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())):
                    fs.rename(status.getPath(), jpath(f"{target}/part-{k:05d}-{n:05d}.parquet"))
                fs.delete(jpath(own), True)
            reports.append(report)
    except BaseException:
        fs.delete(jpath(target), True)
        raise
    return Report(sum(r.rows for r in reports), reports, out)


def merge_files(spark: SparkSession, inputs: list[str], target: str, metadata: dict[str, str] | None = None) -> int:
    """Appends the row groups of files with one schema to a single file, byte for byte; returns their number.

    The footer's key/value metadata is the first input's unless metadata is given.
    """
    from ..sources.footer import opened

    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    groups, schemas = 0, []
    for x in inputs:
        with opened(spark, x) as f:
            schemas.append(f.schema)
            groups += len(f.blocks)
            if x == inputs[0]:
                message, first = f.file.getSchema(), f.metadata
    output_schema(schemas)
    out = jvm.org.apache.parquet.hadoop.util.HadoopOutputFile.fromPath(path(target), hadoop)
    mode = jvm.org.apache.parquet.hadoop.ParquetFileWriter
    writer = mode(out, message, jvm.java.lang.Class.forName("org.apache.parquet.hadoop.ParquetFileWriter$Mode").getEnumConstants()[0], 128 << 20, 8 << 20)
    writer.start()
    for x in inputs:
        writer.appendFile(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path(x), hadoop))
    kept = jvm.java.util.HashMap()
    for k, v in (metadata if metadata is not None else first).items():
        kept.put(k, v)
    writer.end(kept)
    return groups

"""Redaction: ordered deletions, replacements and dropped columns, compiled to one chain of projections.

    r = Redaction().where(user_id=42).delete().replace({"email": None}).drop("ip")
    r.apply(df)            # a lazy DataFrame
    r.run(spark, src, dst) # writes dst and returns a Report

Statements run in their order on every row: a deleted row is gone for later ones, and later ones see what earlier ones
replaced.  The match of a statement is computed once, before its assignments; its targets are assigned one by one.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EncodeError, FormatError
from ..functions import coerce
from ..schema import Field, Schema, spark_type
from .filters import column_of, compile_where, total, where_columns

#: Helper columns, under names that no column has.
DELETED, CHANGED, HIT, NEW, FILE = "redaction: deleted", "redaction: changed", "redaction: hit", "redaction: new", "redaction: file"


@dataclass(frozen=True)
class udf:  # noqa: N801
    """A Python function of a value, or of (value, row as a dict): called for matching rows only, once each."""

    f: Callable


@dataclass(frozen=True)
class Statement:
    verb: str
    where: dict | None
    values: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Report:
    rows_read: int
    rows_deleted: int
    rows_changed: int
    files: dict[str, int] = field(default_factory=dict)


class Scope:
    def __init__(self, owner: Redaction, where: dict):
        self.owner, self.where = owner, where

    def delete(self) -> Redaction:
        self.owner.open = None
        return self.owner._add(Statement("delete", self.where))

    def replace(self, values: dict[str, Any] | None = None, **named: Any) -> Redaction:
        self.owner.open = None
        return self.owner._replace(self.where, values, named)


class Redaction:
    def __init__(self, declare: Callable[[Redaction], Any] | None = None):
        self.statements: list[Statement] = []
        self.drops: list[str] = []
        self.open: Scope | None = None
        if declare:
            declare(self)

    def __repr__(self) -> str:
        """Never shows a condition's or a replacement's values."""
        said = [f"where({', '.join(map(str, s.where))}).{s.verb}({', '.join(s.values)})" if s.where else f"{s.verb}({', '.join(s.values)})" for s in self.statements]
        return f"Redaction({'; '.join([*said, *([f'drop({", ".join(self.drops)})'] if self.drops else [])])})"

    def _add(self, s: Statement) -> Redaction:
        self.statements.append(s)
        return self

    def where(self, conditions: dict | None = None, **named: Any) -> Scope:
        both = {**(conditions or {}), **named}
        if not both:
            raise ValueError("where needs a condition")
        if self.open:
            raise ValueError("a where has neither delete nor replace")
        self.open = Scope(self, both)
        return self.open

    def replace(self, values: dict[str, Any] | None = None, **named: Any) -> Redaction:
        return self._replace(None, values, named)

    def _replace(self, where: dict | None, values: dict | None, named: dict) -> Redaction:
        both = {**(values or {}), **named}
        if not both:
            raise ValueError("replace needs a column")
        return self._add(Statement("replace", where, both))

    def drop(self, *columns: str) -> Redaction:
        if not columns:
            raise ValueError("drop needs a column")
        self.drops += columns
        return self

    # checks

    def bind(self, schema: Schema) -> Schema:
        """Checks everything against a schema and returns the output's schema."""
        if self.open:
            raise ValueError("a where has neither delete nor replace")
        if not self.statements and not self.drops:
            raise ValueError("the redaction is empty")
        for s in self.statements:
            if s.where is not None:
                compile_where(s.where, schema)
            for path, v in s.values.items():
                f = schema.find(path)
                for d in self.drops:
                    if path == d or path.startswith(d + ".") or d.startswith(path + "."):
                        raise ValueError(f"{path!r} is both replaced and dropped")
                if not callable(v) and not isinstance(v, udf):
                    self._constant(v, f, path)
        return drop_fields(schema, self.drops)

    def _constant(self, v: Any, f: Field, path: str) -> Any:
        try:
            return coerce.encode_field(v, f, path)
        except EncodeError as e:
            raise ValueError(str(e)) from e

    # execution

    def marked(self, df: DataFrame, schema: Schema) -> DataFrame:
        """df with all assignments made and the helper columns DELETED and CHANGED."""
        self.bind(schema)
        meta = {s.name: s.metadata for s in schema.to_spark().fields}
        out = df.withColumns({DELETED: F.lit(False), CHANGED: F.lit(False)})
        for s in self.statements:
            hit = ~F.col(DELETED)
            if s.where is not None:
                hit &= total(compile_where(s.where, schema))
            if s.verb == "delete":
                out = out.withColumn(DELETED, F.col(DELETED) | hit)
                continue
            out = out.withColumn(HIT, hit)
            for path, v in s.values.items():
                f = schema.find(path)
                old = column_of(schema, path)
                here = F.col(HIT)
                if "." in path and path not in schema.names:  # members of a null struct stay unassigned
                    parts = path.split(".")
                    here &= reduce(lambda a, b: a & b, (column_of(schema, ".".join(parts[:k])).isNotNull() for k in range(1, len(parts))))
                new = self._value(v, f, path, old, here, schema)
                differs = ~new.eqNullSafe(old) if not isinstance(spark_type(f.type), T.MapType) else ~F.to_json(new).eqNullSafe(F.to_json(old))
                if f.type.kind == "float":
                    differs |= F.isnan(new) & F.isnan(old)
                top = path.split(".")[0] if path not in schema.names else path
                # one projection evaluates the new value once; what follows refers to it by name
                out = out.withColumn(NEW, new).withColumn(CHANGED, F.col(CHANGED) | (here & _swap(differs, new, v, f, old)))
                assigned = F.when(here, F.col(NEW)).otherwise(old)
                out = out.withColumn(top, assigned if top == path else _with_member(F.col(f"`{top}`"), path.split(".")[1:], assigned)).drop(NEW)
                out = out.withMetadata(top, meta[top])
            out = out.drop(HIT)
        return out

    def _value(self, v: Any, f: Field, path: str, old: Column, here: Column, schema: Schema) -> Column:
        target = spark_type(f.type)
        if isinstance(v, udf):
            two = len([p for p in inspect.signature(v.f).parameters.values() if p.default is p.empty]) > 1
            row = F.struct(*(F.col(f"`{n}`") for n in schema.names))

            def call(value: Any, hit: bool, whole: Any = None) -> Any:
                if not hit:
                    return None
                got = v.f(_plain(value), whole.asDict(recursive=True)) if two else v.f(_plain(value))
                return coerce.encode_field(got, f, path)

            made = F.udf(call, target).asNondeterministic()
            return made(old, here, row) if two else made(old, here)
        if callable(v):
            n = len([p for p in inspect.signature(v).parameters.values() if p.default is p.empty])
            c = v(old, {name: F.col(f"`{name}`") for name in schema.names}) if n > 1 else v(old)
            if not isinstance(c, Column):
                raise ValueError(f"the function for {path!r} returned {type(c).__name__}: it gets a Column and returns one; wrap functions of values in udf()")
            c = c.cast(target)
            return c if f.nullable else F.when(here & c.isNull(), F.raise_error(F.lit(f"column {path}: null in a required column")).cast(target)).otherwise(c)
        x = self._constant(v, f, path)
        return _literal(x, target)

    def apply(self, df: DataFrame, schema: Schema | None = None) -> DataFrame:
        """The redacted rows, lazily."""
        schema = schema or Schema.from_spark(df.schema)
        out = self.marked(df.select(*(F.col(f"`{n}`") for n in schema.names)), schema).filter(~F.col(DELETED)).drop(DELETED, CHANGED)
        return _dropped(out, schema, self.drops)

    def counts(self, df: DataFrame, schema: Schema | None = None) -> DataFrame:
        """One row: rows_read, rows_deleted, rows_changed."""
        return self.marked(df, schema or Schema.from_spark(df.schema)).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(F.col(DELETED)).alias("rows_deleted"), F.count_if(F.col(CHANGED) & ~F.col(DELETED)).alias("rows_changed"))

    def run(self, spark: SparkSession, source: Any, target: str, options: Any = None) -> Report:
        """Redacts the files at source (a path or Reader) into target, one by one, and reports.

        A file that no statement affects is copied as it is, to the same place below target; rewritten rows keep the folders of
        their partition columns, rewritten files their metadata and what still holds of their sorting columns.  Counters come along with the write, and must add up to the rows of the files.
        """
        from ..sources.footer import below, copy_files
        from ..sources.notes import kept_metadata, sorting_of
        from ..sources.reader import Reader
        from ..sources.writer import like, write_frame

        reader = source if isinstance(source, Reader) else Reader(spark, source)
        after = self.bind(reader.schema)
        options = options or like(reader, after)
        if reader.secrets and not options.encryption and not options.plaintext:
            options = replace(options, encryption=reader.secrets.encryption.only(after.names))
        if options.row_group_bytes or options.row_group_rows:
            raise ValueError("row groups keep their boundaries: row_group_bytes and row_group_rows can't be given")
        hadoop, jpath = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        fs = jpath(target).getFileSystem(hadoop)
        if fs.exists(jpath(target)):
            raise ValueError(f"{target} exists")
        alike = options.encryption == (reader.secrets.encryption.only(after.names) if reader.secrets else None)
        # the files that a statement touches, or all where the output is encrypted otherwise
        touched, totals = self._touched(reader) if alike else set(reader.files), [0, 0, 0]
        files = {"copied": 0, "rewritten": 0}
        try:
            fs.mkdirs(jpath(target))
            counts = dict(zip(reader.files, reader.rows_by_file()))
            expected = sum(counts.values())
            copied = {p: f"{target}/{below(p, reader.folder) if reader.folder else jpath(p).getName()}" for p in reader.files if p not in touched}
            copy_files(spark, copied)
            files["copied"], totals[0] = len(copied), sum(counts[p] for p in copied)
            rest = [p for p in reader.files if p in touched]
            # rows keep their order within a file, so files with sorting columns are rewritten one by one, into one file each
            changed = [*self.drops, *(p for s in self.statements for p in s.values)]
            sorted_by = {p: self._kept_sorting(sorting_of(spark, p), changed) for p in rest if not reader.encrypted}
            for part in [[p] for p in rest if sorted_by.get(p)] + [[p for p in rest if not sorted_by.get(p)]]:
                if not part:
                    continue
                seen = Observation()
                marked = self.marked(reader.source_of(part), reader.schema).observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col(DELETED)).alias("deleted"), F.count_if(F.col(CHANGED) & ~F.col(DELETED)).alias("changed"))
                kept = _dropped(marked.filter(~F.col(DELETED)).drop(DELETED, CHANGED), reader.schema, self.drops)
                notes = {} if options.encryption else kept_metadata(reader.metadata, after == reader.schema) | (options.metadata or {})
                own = replace(options, metadata=notes, sorting=options.sorting or sorted_by.get(part[0]))
                write_frame(kept, target, after, own, mode="append", files=1 if sorted_by.get(part[0]) else None, strict=False, partition_by=[f.name for f in reader.partitions if f.name in after.names])
                files["rewritten"] += len(part)
                totals = [a + seen.get[k] for a, k in zip(totals, ("read", "deleted", "changed"))]
            if totals[0] != expected:
                raise FormatError(f"{reader.path}: {totals[0]} of {expected} rows were read")
        except BaseException:
            fs.delete(jpath(target), True)
            raise
        return Report(*totals, files)

    def _kept_sorting(self, sorting: list, changed: list[str]) -> list:
        """Sorting columns up to the first that is changed or dropped."""
        touched = [any(name == c or name.startswith(c + ".") for c in changed) for name, _, _ in sorting]
        return sorting[: touched.index(True)] if True in touched else sorting

    def _touched(self, reader) -> set[str]:
        """The files, by their whole paths, with a row that a statement matches."""
        from ..sources.footer import one_slash, uri_of

        if self.drops or any(s.where is None for s in self.statements):
            return set(reader.files)
        names = list(dict.fromkeys(n for s in self.statements for n in where_columns(s.where)))
        conditions = reduce(lambda a, b: a | b, (total(compile_where(s.where, reader.schema)) for s in self.statements))
        paths = reader.source().select(*(F.col(f"`{n}`") for n in names), F.col("_metadata.file_path").alias(FILE)).filter(conditions).select(FILE).distinct()
        found = {one_slash(r[0]) for r in paths.toLocalIterator()}
        return {p for p in reader.files if uri_of(reader.spark, p) in found}

    def affects(self, spark: SparkSession, source: Any) -> bool:
        """Whether the redaction would change the data at source.  Statistics come first, then the condition columns."""
        from ..sources.reader import Reader

        reader = source if isinstance(source, Reader) else Reader(spark, source)
        self.bind(reader.schema)
        if self.drops:
            return True
        if any(s.where is None for s in self.statements):
            return reader.num_rows > 0
        alive = [s for s in self.statements if reader.scan_plan(s.where)]
        if not alive:
            return False
        names = list(dict.fromkeys(n for s in alive for n in where_columns(s.where)))
        any_of = reduce(lambda a, b: a | b, (total(compile_where(s.where, reader.schema)) for s in alive))
        return not reader.read(columns=names).filter(any_of).isEmpty()


def _plain(v: Any) -> Any:
    return v.asDict(recursive=True) if isinstance(v, T.Row) else bytes(v) if isinstance(v, bytearray) else v


def _swap(differs: Column, new: Column, v: Any, f: Field, old: Column) -> Column:
    """The comparison against the already projected new value, so that functions run once."""
    ref = F.col(NEW)
    if isinstance(spark_type(f.type), T.MapType):
        return ~F.to_json(ref).eqNullSafe(F.to_json(old))
    out = ~ref.eqNullSafe(old)
    return out | F.coalesce(F.isnan(ref) & F.isnan(old), F.lit(False)) if f.type.kind == "float" else out


def _literal(x: Any, target: T.DataType) -> Column:
    if x is None:
        return F.lit(None).cast(target)
    if isinstance(target, T.StructType):
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(x, target.fields)))
    if isinstance(target, T.ArrayType):
        return F.array(*(_literal(v, target.elementType) for v in x)).cast(target)
    if isinstance(target, T.MapType):
        return F.create_map(*(y for k, v in x.items() for y in (_literal(k, target.keyType), _literal(v, target.valueType)))).cast(target)
    return F.lit(x).cast(target)


def _with_member(c: Column, path: list[str], value: Column) -> Column:
    inner = value if len(path) == 1 else _with_member(c.getField(path[0]), path[1:], value)
    return F.when(c.isNotNull(), c.withField(path[0], inner))


def drop_fields(schema: Schema, drops: list[str]) -> Schema:
    """The schema without dropped columns and struct members; it refuses to empty a struct or the table."""
    def less(fields: tuple[Field, ...], paths: list[list[str]], at: str) -> tuple[Field, ...]:
        out = []
        for f in fields:
            mine = [p[1:] for p in paths if p[0] == f.name]
            if [] in mine:
                continue
            out.append(replace(f, type=replace(f.type, fields=less(f.type.fields, mine, f"{at}{f.name}."))) if mine else f)
        if not out:
            raise ValueError(f"that drops every {'member of ' + at.rstrip('.') if at else 'column'}")
        return tuple(out)

    for d in drops:
        schema.find(d)
    return Schema(less(schema.fields, [[d] if d in schema.names else d.split(".") for d in drops], "")) if drops else schema


def _dropped(df: DataFrame, schema: Schema, drops: list[str]) -> DataFrame:
    after = drop_fields(schema, drops)
    meta = {s.name: s.metadata for s in after.to_spark().fields}
    for d in drops:
        if d in schema.names:
            df = df.drop(d)
        else:
            top, *rest = d.split(".")
            df = df.withColumn(top, F.col(f"`{top}`").dropFields(".".join(rest)))
    return df.select(*(F.col(f"`{n}`").alias(n, metadata=meta[n]) for n in after.names))


def redact(spark: SparkSession, source: Any, target: str, declare: Callable[[Redaction], Any], options: Any = None) -> Report:
    """Builds a redaction with declare(r) and runs it."""
    return Redaction(declare).run(spark, source, target, options)

"""Errors.  Wrong arguments raise ValueError; all else that is raised on purpose is a TesseraError."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class TesseraError(Exception):
    pass


class FormatError(TesseraError):
    """Not a valid Parquet file, or a damaged part of one."""


class EncodeError(TesseraError):
    """A value that its column can't store."""

    def __init__(self, message: str, row: int | None = None, column: str | None = None, value: Any = None):
        super().__init__(message)
        self.row, self.column, self.value = row, column, value


class SchemaMismatch(EncodeError):
    """A row that doesn't fit the schema inferred from earlier ones."""


class UnsupportedError(TesseraError):
    """A Parquet feature that isn't implemented."""


class MissingCodecError(UnsupportedError):
    """A codec whose library isn't there."""


class DecryptionError(TesseraError):
    """A key is missing or wrong, or encrypted bytes were changed."""


@dataclass(frozen=True)
class Conflict:
    path: str
    left: str
    right: str
    reason: str
    source: int | None = None

    def __str__(self) -> str:
        return f"{self.path or '(top level)'}: {self.left} vs {self.right} ({self.reason})"


class IncompatibleSchema(TesseraError):
    """Schemas that don't fit together; conflicts has every field at fault."""

    def __init__(self, conflicts: list[Conflict], doing: str):
        self.conflicts = conflicts
        listed = "".join(f"\n  {f'input {c.source}: ' if c.source is not None else ''}{c}" for c in conflicts)
        super().__init__(f"{doing}: {len(conflicts)} field{'s' * (len(conflicts) != 1)} in conflict{listed}")

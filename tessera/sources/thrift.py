"""The compact Thrift encoding of footers and page headers: read, changed and written again without knowing every field.

A struct is a dict of field number -> (type, value), a list is (element type, values), a map (key type, value type, pairs).
"""

from __future__ import annotations

import struct
from typing import Any

TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)

#: Field numbers of the format (fixed values).
ROW_GROUPS, KEY_VALUES = 4, 5
SORTING = 4


class Decoder:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def _varint(self) -> int:
        out = shift = 0
        while True:
            b = self.raw[self.at]
            self.at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def _integer(self) -> int:
        n = self._varint()
        return n >> 1 ^ -(n & 1)

    def value(self, kind: int, in_list: bool = False) -> Any:
        if kind in (TRUE, FALSE):
            if not in_list:
                return kind == TRUE
            self.at += 1
            return self.raw[self.at - 1] == TRUE
        if kind == BYTE:
            self.at += 1
            return self.raw[self.at - 1]
        if kind in (I16, I32, I64):
            return self._integer()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack("<d", self.raw[self.at - 8 : self.at])[0]
        if kind == BINARY:
            n = self._varint()
            self.at += n
            if self.at > len(self.raw):
                raise ValueError("a field ends beyond its data")
            return bytes(self.raw[self.at - n : self.at])
        if kind in (LIST, SET):
            head = self.raw[self.at]
            self.at += 1
            n = head >> 4 if head >> 4 < 15 else self._varint()
            return head & 15, [self.value(head & 15, True) for _ in range(n)]
        if kind == MAP:
            n = self._varint()
            if not n:
                return BYTE, BYTE, []
            kinds = self.raw[self.at]
            self.at += 1
            return kinds >> 4, kinds & 15, [(self.value(kinds >> 4, True), self.value(kinds & 15, True)) for _ in range(n)]
        if kind == STRUCT:
            return self.record()
        raise ValueError(f"no type {kind}")

    def record(self) -> dict[int, tuple[int, Any]]:
        out, last = {}, 0
        while True:
            head = self.raw[self.at]
            self.at += 1
            if not head:
                return out
            last = last + (head >> 4) if head >> 4 else self._integer()
            out[last] = head & 15, self.value(head & 15)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _integer(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def encode(kind: int, v: Any, in_list: bool = False) -> bytes:
    if kind in (TRUE, FALSE):
        return bytes([TRUE if v else FALSE]) if in_list else b""
    if kind == BYTE:
        return bytes([v])
    if kind in (I16, I32, I64):
        return _integer(v)
    if kind == DOUBLE:
        return struct.pack("<d", v)
    if kind == BINARY:
        return _varint(len(v)) + v
    if kind in (LIST, SET):
        inner, values = v
        head = bytes([len(values) << 4 | inner]) if len(values) < 15 else bytes([0xF0 | inner]) + _varint(len(values))
        return head + b"".join(encode(inner, x, True) for x in values)
    if kind == MAP:
        a, b, pairs = v
        return _varint(len(pairs)) + (bytes([a << 4 | b]) + b"".join(encode(a, x, True) + encode(b, y, True) for x, y in pairs) if pairs else b"")
    out, last = bytearray(), 0
    for number, (k, x) in sorted(v.items()):
        k = (TRUE if x else FALSE) if k in (TRUE, FALSE) else k
        out += bytes([number - last << 4 | k]) if 0 < number - last < 16 else bytes([k]) + _integer(number)
        out += encode(k, x)
        last = number
    return bytes(out) + b"\0"


def key_values(footer: dict) -> dict[str, str | None]:
    pairs = footer.get(KEY_VALUES, (LIST, (STRUCT, [])))[1][1]
    return {p[1][1].decode(): p[2][1].decode() if 2 in p else None for p in pairs}


def with_notes(footer: dict, metadata: dict[str, str] | None, sorting: list[tuple[int, bool, bool]] | None) -> dict:
    """A footer with further key/value metadata, which go before those of the same key, and the sorting columns of all row groups:
    (place of the leaf, descending, nulls first)."""
    out = dict(footer)
    if metadata:
        both = key_values(footer) | metadata
        out[KEY_VALUES] = LIST, (STRUCT, [{1: (BINARY, k.encode())} | ({2: (BINARY, v.encode())} if v is not None else {}) for k, v in both.items()])
    if sorting:
        columns = LIST, (STRUCT, [{1: (I32, at), 2: (TRUE, down), 3: (TRUE, nulls)} for at, down, nulls in sorting])
        out[ROW_GROUPS] = LIST, (STRUCT, [g | {SORTING: columns} for g in footer[ROW_GROUPS][1][1]])
    return out

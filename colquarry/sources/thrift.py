"""The compact Thrift encoding, as far as a Parquet footer needs it: structs as dicts from field number to value."""

from __future__ import annotations

import struct

_TRUE, _FALSE, _BYTE, _I16, _I32, _I64, _DOUBLE, _BINARY, _LIST, _SET, _MAP, _STRUCT = range(1, 13)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    def whole(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def taken(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int) -> object:
        if kind in (_I16, _I32, _I64):
            return self.whole()
        if kind == _BINARY:
            return self.taken(self.varint())
        if kind == _STRUCT:
            return self.struct()
        if kind in (_LIST, _SET):
            head = self.taken(1)[0]
            size = self.varint() if head >> 4 == 15 else head >> 4
            return [self.value(head & 15) for _ in range(size)]
        if kind == _MAP:
            size = self.varint()
            kinds = self.taken(1)[0] if size else 0
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(size)}
        if kind == _DOUBLE:
            return struct.unpack("<d", self.taken(8))[0]
        if kind in (_TRUE, _FALSE, _BYTE):  # inside a list a flag is a byte
            return self.taken(1)[0]
        raise ValueError(f"no Thrift type {kind}")

    def struct(self) -> dict[int, object]:
        out, field = {}, 0
        while head := self.taken(1)[0]:
            field = field + (head >> 4) if head >> 4 else self.whole()
            kind = head & 15
            out[field] = kind == _TRUE if kind in (_TRUE, _FALSE) else self.value(kind)
        return out

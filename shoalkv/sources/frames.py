"""The log's framing: one mutation, checksummed.

A frame is ``crc32 | length | payload``, and a payload ``lsn | op | key length | key | value
length | value``, little-endian; the checksum is of the payload.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

from ..schema import MAX_LSN, CorruptLog, Op

_HEAD = struct.Struct("<II")
_FIXED = struct.Struct("<QBI")
_LENGTH = struct.Struct("<I")
#: What an entry costs in a memtable besides its bytes.
ENTRY_OVERHEAD = 64


class Record(NamedTuple):
    pk: bytes
    lsn: int
    op: Op
    value: bytes | None

    @classmethod
    def put(cls, pk: bytes, lsn: int, value: bytes) -> Record:
        return cls(pk, lsn, Op.PUT, value)

    @classmethod
    def delete(cls, pk: bytes, lsn: int) -> Record:
        return cls(pk, lsn, Op.DELETE, None)

    @property
    def heap_size(self) -> int:
        return len(self.pk) + len(self.value or b"") + ENTRY_OVERHEAD


def encode(record: Record) -> bytes:
    if not 0 < record.lsn <= MAX_LSN:
        raise ValueError("an LSN is a positive signed 64-bit integer")
    value = record.value or b""
    payload = _FIXED.pack(record.lsn, record.op, len(record.pk)) + record.pk + _LENGTH.pack(len(value)) + value
    return _HEAD.pack(zlib.crc32(payload), len(payload)) + payload


def encode_all(records: Iterable[Record]) -> bytes:
    return b"".join(map(encode, records))


def _parsed(payload: bytes, where: str) -> Record:
    if len(payload) < _FIXED.size:
        raise CorruptLog(f"{where}: a payload of {len(payload)} bytes")
    lsn, op, key_length = _FIXED.unpack_from(payload)
    at = _FIXED.size + key_length
    if op not in (Op.PUT, Op.DELETE):
        raise CorruptLog(f"{where}: operation {op}")
    if at + _LENGTH.size > len(payload):
        raise CorruptLog(f"{where}: the key runs over")
    (value_length,) = _LENGTH.unpack_from(payload, at)
    if at + _LENGTH.size + value_length > len(payload):
        raise CorruptLog(f"{where}: the value runs over")
    key, at = payload[_FIXED.size : at], at + _LENGTH.size
    return Record(key, lsn, Op(op), None if op == Op.DELETE else payload[at : at + value_length])


def decode(data: bytes, at: int = 0, where: str = "log") -> tuple[Record, int] | None:
    """The record at ``at`` and where the next begins; None if the frame is torn (short, or its checksum fails)."""
    if at + _HEAD.size > len(data):
        return None
    crc, length = _HEAD.unpack_from(data, at)
    begin = at + _HEAD.size
    payload = data[begin : begin + length]
    if len(payload) < length or zlib.crc32(payload) != crc:
        return None
    return _parsed(payload, f"{where} at {at}"), begin + length


def decode_all(data: bytes, where: str = "log") -> Iterator[tuple[Record, int]]:
    """Records with the offset behind each, up to the first torn frame."""
    at = 0
    while found := decode(data, at, where):
        yield found
        at = found[1]

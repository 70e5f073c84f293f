"""Record batches of Arrow IPC files without reading them.

An IPC file ends with a footer that lists its record batches; each begins with a message
header that holds the number of rows. Both are FlatBuffers tables; only the few fields needed
here are read. So numbering the rows of a file costs its footer and a header per batch.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

# Fixed values of the format: magic, trailer size, slots of table fields, continuation marker.
MAGIC = b"ARROW1"
_FOOTER_BATCHES, _MESSAGE_HEADER, _BATCH_LENGTH = 3, 2, 0
_BLOCK, _BLOCK_SIZE = "<qi4xq", 24
_CONTINUATION = b"\xff\xff\xff\xff"


@dataclass(frozen=True)
class Block:
    """One record batch: its number, the first row's place in the file, and its rows."""

    number: int
    start: int
    rows: int


def _field(buffer: bytes, table: int, slot: int) -> int | None:
    """Place of a table's field, or nothing if it has its default."""
    layout = table - struct.unpack_from("<i", buffer, table)[0]
    entry = 4 + 2 * slot
    if entry >= struct.unpack_from("<H", buffer, layout)[0]:
        return None
    offset = struct.unpack_from("<H", buffer, layout + entry)[0]
    return table + offset if offset else None


def _followed(buffer: bytes, place: int) -> int:
    return place + struct.unpack_from("<I", buffer, place)[0]


def blocks(file) -> list[Block]:
    """The record batches of an open IPC file (``seek``, ``read``, ``size``), in order."""
    size = file.size()
    file.seek(max(0, size - 10))
    tail = file.read(10)
    if len(tail) < 10 or tail[4:] != MAGIC:
        raise ValueError("not an Arrow IPC file")
    length = struct.unpack_from("<i", tail)[0]
    file.seek(size - 10 - length)
    footer = file.read(length)
    vector = _field(footer, _followed(footer, 0), _FOOTER_BATCHES)
    if vector is None:
        return []
    at = _followed(footer, vector)
    count = struct.unpack_from("<I", footer, at)[0]
    out, start = [], 0
    for number in range(count):
        offset, header_size, _ = struct.unpack_from(_BLOCK, footer, at + 4 + number * _BLOCK_SIZE)
        file.seek(offset)
        rows = _rows(file.read(header_size))
        out.append(Block(number, start, rows))
        start += rows
    return out


def _rows(message: bytes) -> int:
    """Rows of a record batch from its encapsulated message header."""
    body = message[8:] if message[:4] == _CONTINUATION else message[4:]
    header = _field(body, _followed(body, 0), _MESSAGE_HEADER)
    length = _field(body, _followed(body, header), _BATCH_LENGTH)
    return struct.unpack_from("<q", body, length)[0] if length is not None else 0

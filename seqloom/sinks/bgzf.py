"""Blocked gzip: members of at most 64 KiB that hold whole lines, and an empty one at the end."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

#: Fixed value: the empty block that ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST = 0xFF00


def block(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    if len(body) + 26 > 0x10000:
        z = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2B2H", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def blocks(lines: Iterable[str], level: int = 3) -> Iterator[bytes]:
    held, size = [], 0
    for text in lines:
        raw = text.encode() + b"\n"
        if size and size + len(raw) > MOST:
            yield block(b"".join(held), level)
            held, size = [], 0
        while len(raw) > MOST:
            yield block(raw[:MOST], level)
            raw = raw[MOST:]
        held.append(raw)
        size += len(raw)
    if size:
        yield block(b"".join(held), level)


def read(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = struct.unpack_from("<H", data, at + 16)[0] + 1
        out.append(zlib.decompress(data[at + 18 : at + n - 8], -15))
        crc, size = struct.unpack_from("<2I", data, at + n - 8)
        if zlib.crc32(out[-1]) != crc or len(out[-1]) != size:
            raise ValueError("a block is damaged")
        at += n
    return b"".join(out)

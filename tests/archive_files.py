"""Archive files written with nothing but the standard library, independent of the package's own encoder."""

from __future__ import annotations

import gzip
import struct


def varint(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v % 128 | 0x80)
        v //= 128
    out.append(v)
    return bytes(out)


def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """entries: (tile_id, offset, length, run_length)"""
    out, last = varint(len(entries)), 0
    for tid, *_ in entries:
        out += varint(tid - last)
        last = tid
    for _, _, _, run in entries:
        out += varint(run)
    for _, _, length, _ in entries:
        out += varint(length)
    end = None
    for _, offset, length, _ in entries:
        out += varint(0 if end == offset else offset + 1)
        end = offset + length
    return out


def archive(tiles: list[tuple[int, int, bytes]], leaf_size: int, codec: int = 2, metadata: bytes = b"{}", tile_codec: int = 1,
            root_gap: int = 0) -> bytes:
    """tiles: (tile_id, run_length, content), sorted. Leaves of ``leaf_size`` entries unless all fit in the root."""
    pack = (lambda b: gzip.compress(b, mtime=0)) if codec == 2 else (lambda b: b)
    data, seen, entries = b"", {}, []
    for tid, run, content in tiles:
        stored = gzip.compress(content, mtime=0) if tile_codec == 2 else content
        if stored not in seen:
            seen[stored] = len(data)
            data += stored
        entries.append((tid, seen[stored], len(stored), run))
    leaves, root = b"", entries
    if len(entries) > leaf_size:
        root = []
        for i in range(0, len(entries), leaf_size):
            blob = pack(directory(entries[i:i + leaf_size]))
            root.append((entries[i][0], len(leaves), len(blob), 0))
            leaves += blob
    root_blob, meta = pack(directory(root)), pack(metadata)
    at = 127 + root_gap
    places = []
    for part in (root_blob, meta, leaves, data):
        places += [at, len(part)]
        at += len(part)
    head = b"PMTiles" + bytes([3]) + struct.pack("<11Q", *places, sum(t[1] for t in tiles), len(tiles), len(seen))
    head += bytes([1, codec, tile_codec, 1, 0, 6]) + struct.pack("<4i", -1800000000, -850000000, 1800000000, 850000000) + bytes([2]) + struct.pack("<2i", 5, -5)
    assert len(head) == 127
    return head + b"\0" * root_gap + root_blob + meta + leaves + data

"""Archive files from tile rows: each archive is assembled by the task that has its rows and written where all can read it."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tesserix.operators.archive import HEADER_SIZE, MAGIC

# The format's version, and the codes for "stored plainly" and "gzip".
VERSION, PLAIN, GZIP = 3, 1, 2


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first, all but the last marked; the whole column at once."""
    v = np.asarray(values, np.uint64)
    width = np.maximum(1, np.ceil(np.log2(v.astype(np.float64) + 1) / 7)).astype(int)
    width += (v >> (np.minimum(width, 9) * 7).astype(np.uint64) > 0) & (width < 10)  # where the logarithm was rounded down
    width -= (width > 1) & (v >> ((width - 1) * 7).astype(np.uint64) == 0)
    at = np.arange(width.max() if len(v) else 0)
    cells = ((v[:, None] >> (7 * at).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    inside = at < width[:, None]
    cells[at < width[:, None] - 1] |= 128
    return cells[inside].tobytes()


def directory_bytes(tile_id: np.ndarray, run_length: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """One directory: the count, then each column; an offset that follows the entry before is 0, others are one more."""
    follows = np.concatenate([[False], offset[1:] == offset[:-1] + length[:-1]]) if len(offset) else np.zeros(0, bool)
    return b"".join(map(_varints, ([len(tile_id)], np.diff(tile_id, prepend=0), run_length, length, np.where(follows, 0, offset + 1))))


def archive_bytes(tiles: pd.DataFrame, leaf_size: int, metadata: bytes, zooms: tuple[int, int]) -> bytes:
    """``tiles``: tile_id, run_length, content (bytes). Equal contents are stored once; more than ``leaf_size`` entries go to leaves."""
    tiles = tiles.sort_values("tile_id")
    code, contents = pd.factorize(tiles["content"])
    sizes = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(sizes)
    columns = [tiles["tile_id"].to_numpy(np.int64), tiles["run_length"].to_numpy(np.int64), (ends - sizes)[code] if len(code) else np.zeros(0, np.int64),
               sizes[code] if len(code) else np.zeros(0, np.int64)]
    leaves = b""
    root = columns
    if len(tiles) > leaf_size:
        parts = [gzip.compress(directory_bytes(*(c[a:a + leaf_size] for c in columns)), mtime=0) for a in range(0, len(tiles), leaf_size)]
        lengths = np.array([len(p) for p in parts], np.int64)
        root = [columns[0][::leaf_size], np.zeros(len(parts), np.int64), np.cumsum(lengths) - lengths, lengths]
        leaves = b"".join(parts)
    sections = [gzip.compress(directory_bytes(*root), mtime=0), gzip.compress(metadata, mtime=0), leaves, b"".join(contents)]
    starts = np.cumsum([HEADER_SIZE, *map(len, sections)])[:-1].tolist()
    places = [v for pair in zip(starts, map(len, sections)) for v in pair]
    head = MAGIC + struct.pack("<B11Q", VERSION, *places, int(columns[1].sum()), len(tiles), len(contents))
    head += struct.pack("<6B4iB2i", 1, GZIP, PLAIN, 1, *zooms, -1800000000, -850000000, 1800000000, 850000000, zooms[0], 0, 0)
    return head + b"".join(sections)


def write_files(bodies: DataFrame, name: str, body: str, folder: str) -> DataFrame:
    """Writes each row's bytes as ``<name>.tiles``; returns (name, size). Nothing happens before it is read."""
    def write(frames):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        for pdf in frames:
            for key, data in zip(pdf[name], pdf[body]):
                with system.open_output_stream(f"{inner}/{key}.tiles") as out:
                    out.write(data)
            yield pd.DataFrame({name: pdf[name], "size": [len(v) for v in pdf[body]]})

    return bodies.select(name, body).mapInPandas(write, f"`{name}` {bodies.schema[name].dataType.simpleString()}, size long")


def write_archives(tiles: DataFrame, name: str, folder: str, leaf_size: int = 4096, zooms: tuple[int, int] = (0, 15)) -> DataFrame:
    """Writes one file ``<name>.tiles`` for each value of the column ``name`` into ``folder``, an address every executor can
    write to. An archive's tiles must fit in a task. Returns (name, size), one row per file; nothing happens before it is read."""
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        key = pdf[name].iloc[0]
        body = archive_bytes(pdf, leaf_size, b'{"name":"%d"}' % key, zooms)
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{key}.tiles") as out:
            out.write(body)
        return pd.DataFrame({name: [key], "size": [len(body)]})

    return tiles.select(name, "tile_id", "run_length", "content").groupBy(name).applyInPandas(
        write, f"`{name}` {tiles.schema[name].dataType.simpleString()}, size long")

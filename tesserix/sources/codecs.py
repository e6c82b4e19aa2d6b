"""Decompression as an Arrow step: the one place where bytes pass through Python."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _plain(blob: bytes, codec: int) -> tuple[bytes | None, str | None]:
    """(payload, error) of one value; codes as in the archive header, 0 and 1 pass through."""
    if blob is None:
        return None, None
    if codec in (0, 1):
        return blob, None
    try:
        if codec == 2:
            return gzip.decompress(blob), None
        if codec == 4:
            import zstandard

            parts, rest = [], blob
            while rest or not parts:  # a value may be several frames in a row; bytes that are no frame break it
                reader = zstandard.ZstdDecompressor().decompressobj()
                parts.append(reader.decompress(rest))
                if not reader.eof:
                    return None, "broken"
                rest = reader.unused_data
            return b"".join(parts), None
    except ImportError:
        return None, "unsupported"
    except (OSError, EOFError, zlib.error):
        return None, "broken"
    except Exception as e:
        if type(e).__name__ == "ZstdError":
            return None, "broken"
        raise
    return None, "unsupported"


def unpacked(blob: bytes, codec: int) -> bytes:
    """The payload of one value that must be readable."""
    payload, error = _plain(blob, codec)
    if error:
        raise ValueError(f"{error} data, compression {codec}")
    return payload


def decompress(df: DataFrame, blob: str, codec: str, payload: str = "payload", error: str = "error") -> DataFrame:
    """Add the decompressed bytes and, where that fails, why (``broken`` or ``unsupported``). The raw bytes stay."""
    schema = T.StructType([*df.schema.fields, T.StructField(payload, T.BinaryType()), T.StructField(error, T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (_plain(b.as_py(), c.as_py()) for b, c in zip(batch.column(blob), batch.column(codec)))
            yield from with_values(batch, values, schema.names)

    return df.mapInArrow(step, schema)


#: Bytes of new values given out at once, and of old ones taken at once.
BATCH_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices that end once their values of ``column`` hold ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) + 1, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end



def with_values(batch: pa.RecordBatch, values: Iterator[tuple[bytes | None, str | None]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` with one (bytes, text) each, in batches that end once they hold ``BATCH_BYTES``."""
    at, held, size = 0, [], 0
    for value in values:
        held.append(value)
        size += len(value[0] or b"")
        if size >= BATCH_BYTES or at + len(held) == batch.num_rows:
            rows = batch.slice(at, len(held))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([v for v, _ in held], pa.binary()), pa.array([e for _, e in held], pa.string())], names=names)
            at, held, size = at + len(held), [], 0


def compress(df: DataFrame, text: str, codec: str, out: str, level: int = 9) -> DataFrame:
    """Counterpart used to build derived tables and test archives; codecs other than 2 and 4 leave the bytes alone. Level 0 wraps gzip
    data without making it smaller."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def one(b: bytes, c: int) -> bytes:
        if c == 2:
            return gzip.compress(b, level, mtime=0)
        if c == 4:
            import zstandard

            return zstandard.ZstdCompressor().compress(b)
        return b

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            done = [one(b, c) for b, c in zip(batch.column(text).to_pylist(), batch.column(codec).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], names=schema.names)

    return df.mapInArrow(step, schema)

"""Variable-length integers: seven bits per byte, low bits first, high bit set on all but the last byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserix.functions.common import MAX_EXACT, ColumnOrName, col, div, let, lng, shr


def varint_width(value: ColumnOrName) -> Column:
    """Bytes of the shortest encoding of a non-negative integer."""
    return div(F.length(F.bin(lng(value))) + 6, 7).cast("int")


def varint_hex(value: ColumnOrName) -> Column:
    """Shortest encoding of a non-negative integer, as hex digits."""

    def build(v: Column) -> Column:
        last = varint_width(v) - 1
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: F.lpad(
            F.hex(shr(v, k * 7).bitwiseAND(127) + F.when(k < last, 128).otherwise(0)), 2, "0")), "")

    return let(lng(value), build)


def encode_varint(value: ColumnOrName) -> Column:
    return F.unhex(varint_hex(value))


def padded_varint_hex(value: ColumnOrName, extra: ColumnOrName) -> Column:
    """An encoding ``extra`` bytes longer than the shortest: the same value, with empty groups of bits at its end."""
    plain, n = varint_hex(value), col(extra)
    last = F.conv(F.right(plain, F.lit(2)), 16, 10).cast("int")
    longer = F.concat(F.left(plain, F.length(plain) - 2), F.lpad(F.hex(last + 128), 2, "0"), F.repeat(F.lit("80"), n - 1), F.lit("00"))
    return F.when(n > 0, longer).otherwise(plain)


#: What ``decode_blobs`` adds for each value of a blob.
VALUES_TYPE = "array<struct<value:bigint,byte_offset:int,byte_length:int>>"
#: Longest encoding that is read (fixed value).
MAX_BYTES = 10
#: Bytes of blobs decoded at once in a task; decoding holds over sixty times as much.
DECODE_BYTES = 256 << 10


def decode_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, first byte, number of bytes, whether it is too large) of every value that ends in ``data``."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size = ends - starts + 1
    data = data[:ends[-1] + 1] if len(ends) else data[:0]
    place = np.arange(len(data)) - np.repeat(starts, size)
    bits = (data & 127).astype(np.uint64)
    over = (bits > 0) & (place >= 8)  # 2^56 and above
    value = np.add.reduceat(np.where(place < 8, bits << (7 * np.minimum(place, 8)).astype(np.uint64), 0), starts).astype(np.int64) if len(ends) else starts
    large = (np.add.reduceat(over, starts) > 0) | (value > MAX_EXACT) | (size > MAX_BYTES) if len(ends) else starts.astype(bool)
    return value, starts, size, large


def decode_blobs(df: DataFrame, blob: str = "blob", out: str = "values") -> DataFrame:
    """Add the values of each blob, ARRAY<STRUCT(value, byte_offset, byte_length)>; value is NULL above 2^53 - 1 or beyond
    ten bytes, however many zero bits it is padded with. An unfinished value at the end is left out; a NULL blob gives NULL.

    Many blobs are decoded together, as one array of bytes: a value ends where a byte is below 128, and is the sum of
    its bytes' bits, shifted by their place in it.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(VALUES_TYPE))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.column(blob).cast(pa.large_binary()).fill_null(b"")
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            at = 0
            while at < whole.num_rows:
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + DECODE_BYTES, side="right")) - 1)
                batch, inside = whole.slice(at, end - at), bounds[at:end + 1] - bounds[at]
                at = end
                raw = column.buffers()[2]
                data = np.frombuffer(raw, np.uint8)[bounds[end - batch.num_rows]:bounds[end]].copy() if raw is not None else np.zeros(0, np.uint8)
                # A blob's unfinished end must not run into the next blob: end it there, and drop that value.
                tails = inside[1:][(np.diff(inside) > 0)] - 1
                cut = tails[data[tails] >= 128]
                data[cut] &= 127
                value, first, size, large = decode_bytes(data)
                whole_value = ~np.isin(first + size - 1, cut)
                value, first, size, large = (v[whole_value] for v in (value, first, size, large))
                row = np.searchsorted(inside, first, side="right") - 1
                counts = np.bincount(row, minlength=batch.num_rows)
                items = pa.StructArray.from_arrays([pa.array(value, pa.int64(), mask=large), pa.array((first - inside[row]).astype(np.int32)),
                                                    pa.array(size.astype(np.int32))], names=["value", "byte_offset", "byte_length"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), items)
                empty = batch.column(blob).is_null()
                if empty.true_count:
                    lists = pc.if_else(empty, pa.nulls(batch.num_rows, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return df.mapInArrow(step, schema)

"""Small Column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

#: Largest integer a double holds exactly; values above it are rejected everywhere (fixed value).
MAX_EXACT = 9007199254740991


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lng(value: int | ColumnOrName) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else col(value).cast("bigint")


def div(a: ColumnOrName, b: Column | int) -> Column:
    """Integer division."""
    return F.call_function("div", lng(a), lng(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body`` (a one-element ``transform``)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shl(value: Column, bits: ColumnOrName | int) -> Column:
    return F.shiftleft(value, bits) if isinstance(bits, int) else F.call_function("shiftleft", value, col(bits).cast("int"))


def shr(value: Column, bits: ColumnOrName | int) -> Column:
    return F.shiftright(value, bits) if isinstance(bits, int) else F.call_function("shiftright", value, col(bits).cast("int"))


def pow2(bits: ColumnOrName) -> Column:
    return shl(lng(1), bits)


def byte_at(blob: Column, pos: Column | int) -> Column:
    """Unsigned byte at 0-based ``pos``; NULL beyond the end."""
    p = F.lit(pos) if isinstance(pos, int) else pos
    piece = F.substring(blob, p.cast("int") + F.lit(1), F.lit(1))
    return F.when(F.octet_length(piece) == 1, F.conv(F.hex(piece), 16, 10).cast("int"))


def uint_be(blob: Column, pos: Column | int, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at 0-based ``pos`` (up to 7 bytes); NULL when truncated."""
    p = F.lit(pos) if isinstance(pos, int) else pos
    piece = F.substring(blob, p.cast("int") + F.lit(1), F.lit(width))
    return F.when(F.octet_length(piece) == width, F.conv(F.hex(piece), 16, 10).cast("bigint"))


def reverse_bytes(blob: Column, pos: int | Column, width: int) -> Column:
    p = F.lit(pos) if isinstance(pos, int) else pos
    start = p.cast("int") + F.lit(1)
    return F.concat(*[F.substring(blob, start + F.lit(i), F.lit(1)) for i in range(width - 1, -1, -1)])


def uint_le(blob: Column, pos: Column | int, width: int) -> Column:
    """Unsigned little-endian integer of ``width`` bytes (up to 7); NULL when truncated."""
    piece = reverse_bytes(blob, pos, width)
    return F.when(F.octet_length(piece) == width, F.conv(F.hex(piece), 16, 10).cast("bigint"))

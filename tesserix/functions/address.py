"""Tile addresses: z/x/y <-> position on the Hilbert curve <-> global tile id.

A tile id is the number of tiles of all coarser zooms plus the tile's position on its zoom's curve.
The curve is walked three levels at a time through a generated table, nine steps for any zoom, as plain array reads and
shifts, so a conversion stays inside whole-stage code generation.

The expressions read their inputs many times. Feed them stored columns; when the address of a *computed* id is filtered
or joined on, store the id first (``tesserix.session.cut_lineage``), since Spark copies an expression into the filter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions.common import ColumnOrName, div, let, lng, pow2, shl, shr

#: Deepest zoom whose ids fit a double exactly (fixed value).
MAX_ZOOM = 26

# One level of the curve. State 0..3 (start 0), quadrant = 2 * xbit + ybit, index state * 4 + quadrant.
DIGIT = [0, 1, 3, 2, 2, 3, 1, 0, 0, 3, 1, 2, 2, 1, 3, 0]
NEXT = [2, 0, 3, 0, 1, 2, 1, 3, 0, 1, 2, 2, 3, 3, 0, 1]

#: Bits of the largest tile id.
KEY_BITS_DEFAULT = 2 * MAX_ZOOM + 1

_CHUNK = 3  # levels per table read
_SHIFTS = list(range(24, -1, -_CHUNK))  # nine reads cover 27 levels
_SIDE = 1 << _CHUNK


def _forward_table() -> list[int]:
    """(state, x bits, y bits) -> curve digits * 4 + next state, for three levels at once."""
    out = []
    for state in range(4):
        for xs in range(_SIDE):
            for ys in range(_SIDE):
                s, d = state, 0
                for bit in reversed(range(_CHUNK)):
                    q = 2 * (xs >> bit & 1) + (ys >> bit & 1)
                    d, s = d * 4 + DIGIT[s * 4 + q], NEXT[s * 4 + q]
                out.append(d * 4 + s)
    return out


def _inverse_table() -> list[int]:
    """(state, curve digits) -> x bits * 32 + y bits * 4 + next state."""
    cells = _SIDE * _SIDE
    forward, out = _forward_table(), [0] * (4 * cells)
    for i, packed in enumerate(forward):
        state, xs, ys = i // cells, i // _SIDE % _SIDE, i % _SIDE
        out[state * cells + (packed >> 2)] = (xs * _SIDE + ys) * 4 + (packed & 3)
    return out


_LITERALS: dict[tuple[str, str], Column] = {}


def _literal(name: str) -> Column:
    """A lookup table as one literal array, built once per Spark application."""
    app = SparkSession.getActiveSession().sparkContext.applicationId
    if (app, name) not in _LITERALS:
        values = _forward_table() if name == "forward" else _inverse_table()
        _LITERALS[app, name] = F.lit(np.array(values, dtype=np.int32))
    return _LITERALS[app, name]


def zoom_base(z: ColumnOrName) -> Column:
    """Number of tiles in all zooms before ``z``: (4^z - 1) / 3."""
    return div(shl(lng(1), lng(z) * 2) - 1, 3)


def _start_state(z: ColumnOrName) -> Column:
    # The walk always covers 27 levels; leading zero levels alternate between states 0 and 2.
    return F.pmod(lng(z) + 1, lng(2)) * 2


def hilbert_index(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> Column:
    """Position of tile (x, y) on the curve of zoom ``z``; NULL in, NULL out. Inputs must be inside the grid."""
    table, x, y = _literal("forward"), lng(x), lng(y)
    state, d = _start_state(z), lng(0)
    for s in _SHIFTS:
        step = F.get(table, state * 64 + shr(x, s).bitwiseAND(7) * 8 + shr(y, s).bitwiseAND(7))
        d = d + shl(lng(shr(step, 2)), 2 * s)
        state = step.bitwiseAND(3)
    return d


def _hilbert_packed(z: ColumnOrName, d: ColumnOrName) -> Column:
    """x * 2^28 + y of a curve position."""
    table, d = _literal("inverse"), lng(d)
    state, packed = _start_state(z), lng(0)
    for s in _SHIFTS:
        step = F.get(table, state * 64 + shr(d, 2 * s).bitwiseAND(63))
        packed = packed + shl(shl(lng(shr(step, 5)), 28) + shr(step, 2).bitwiseAND(7), s)
        state = step.bitwiseAND(3)
    return packed


def _unpack(packed: Column) -> tuple[Column, Column]:
    return shr(packed, 28), packed.bitwiseAND((1 << 28) - 1)


def hilbert_xy(z: ColumnOrName, d: ColumnOrName) -> Column:
    """STRUCT(x, y) of a curve position of zoom ``z``."""
    x, y = _unpack(_hilbert_packed(z, d))
    return F.struct(x.alias("x"), y.alias("y"))


def is_valid_zxy(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> Column:
    """z in 0..26 and x, y in 0..2^z - 1; never NULL."""
    z, x, y = lng(z), lng(x), lng(y)
    ok = z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0) & (shr(x, z) == 0) & (shr(y, z) == 0)
    return F.coalesce(ok, F.lit(False))


def tile_id(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName, strict: bool = False) -> Column:
    """Global tile id; NULL for an address outside the grid (an error when ``strict``).

    Pass stored columns: the expression reads each input about ten times.
    """
    ok = is_valid_zxy(z, x, y)
    # The mask sits on one input, so the walk is outside any branch and code generation shares its steps.
    out = F.when(ok, zoom_base(z)) + hilbert_index(z, x, y)
    if not strict:
        return out
    message = F.concat_ws("/", F.lit("not a tile address: z/x/y ="), lng(z), lng(x), lng(y))
    return F.when(ok, out).otherwise(F.raise_error(message).cast("bigint"))


def is_valid_tile_id(tid: ColumnOrName) -> Column:
    last = (4 ** (MAX_ZOOM + 1) - 1) // 3
    return F.coalesce((lng(tid) >= 0) & (lng(tid) < lng(last)), F.lit(False))


def tile_zoom(tid: ColumnOrName) -> Column:
    """Zoom of a tile id, exact at zoom boundaries: half the bit length of 3 * id + 1."""
    t = F.when(is_valid_tile_id(tid), lng(tid))
    return div(F.length(F.bin(t * 3 + 1)) - 1, 2).cast("int")


def with_tile_address(df: DataFrame, tid: str = "tile_id", prefix: str = "") -> DataFrame:
    """Add ``z, x, y, zoom_base, hilbert_index`` of a tile id; all NULL for an id outside zooms 0..26.

    Three small projections instead of one deep expression; Spark runs them in one generated loop.
    """
    z, d = F.col(f"{prefix}z"), F.col(f"{prefix}hilbert_index")
    packed = f"_{prefix}packed"
    df = df.withColumn(f"{prefix}z", tile_zoom(tid))
    df = df.withColumns({f"{prefix}zoom_base": zoom_base(z), f"{prefix}hilbert_index": lng(tid) - zoom_base(z)})
    df = df.withColumn(packed, _hilbert_packed(z, d))
    x, y = _unpack(F.col(packed))
    return df.withColumns({f"{prefix}x": x, f"{prefix}y": y}).drop(packed)


def with_aligned_block(df: DataFrame, k: str = "k") -> DataFrame:
    """Add the aligned 2^k square around each tile z/x/y: ``x0, y0, size, first_hilbert_index, first_tile_id,
    last_tile_id``. The tiles of such a square have consecutive ids. NULL unless the tile is valid and 0 <= k <= z.
    """
    ok = is_valid_zxy("z", "x", "y") & lng(k).between(0, lng("z"))
    df = df.withColumn("_k", F.when(ok, lng(k)))
    df = df.withColumns({"_bz": lng("z") - F.col("_k"), "_bx": shr(lng("x"), "_k"), "_by": shr(lng("y"), "_k")})
    df = df.withColumn("_h", hilbert_index("_bz", "_bx", "_by"))
    df = df.withColumns({"first_hilbert_index": shl(F.col("_h"), F.col("_k") * 2), "x0": shl(F.col("_bx"), "_k"),
                         "y0": shl(F.col("_by"), "_k"), "size": pow2("_k")})
    df = df.withColumn("first_tile_id", zoom_base("z") + F.col("first_hilbert_index"))
    last = F.col("first_tile_id") + F.col("size") * F.col("size") - 1
    return df.withColumn("last_tile_id", last).drop("_k", "_bz", "_bx", "_by", "_h")


def range_block_cells(z: ColumnOrName, start: ColumnOrName, end: ColumnOrName) -> Column:
    """Curve range [start, end) of zoom ``z`` as the fewest aligned squares: ARRAY<STRUCT(k, m)>.

    Square (k, m) holds the curve positions [m * 4^k, (m + 1) * 4^k). At most six squares per level appear: a level
    contributes the cells that do not complete a parent cell at either end of the range.
    """

    def build(v: Column) -> Column:
        z, lo, hi = v["z"], v["lo"], v["hi"]

        def up(k: Column) -> Column:
            return shr(lo + shl(lng(1), k * 2) - 1, k * 2)

        def down(k: Column) -> Column:
            return shr(hi, k * 2)

        def span(a: Column, b: Column) -> Column:
            return F.when(a < b, F.sequence(a, F.greatest(a, b - 1))).otherwise(F.array().cast("array<bigint>"))

        def cells(k: Column) -> Column:
            u, d, pu, pd = up(k), down(k), up(k + 1), down(k + 1)
            whole = (k < z) & (pu < pd)
            ids = F.when(whole, F.concat(span(u, pu * 4), span(pd * 4, d))).otherwise(span(u, d))
            return F.transform(ids, lambda m: F.struct(k.alias("k"), m.alias("m")))

        empty = F.array().cast("array<struct<k:bigint,m:bigint>>")
        return F.when(lo < hi, F.flatten(F.transform(F.sequence(lng(0), z), cells))).otherwise(empty)

    inputs = F.struct(lng(z).alias("z"), F.greatest(lng(start), lng(0)).alias("lo"),
                      F.least(lng(end), shl(lng(1), lng(z) * 2)).alias("hi"))
    return let(inputs, build)


def project_to_zoom(value: ColumnOrName, from_z: ColumnOrName, to_z: ColumnOrName) -> Column:
    """Tile coordinate seen from another zoom: the parent's coordinate, or the first child's."""
    v, a, b = lng(value), lng(from_z), lng(to_z)
    return F.when(b <= a, shr(v, F.greatest(a - b, lng(0)))).otherwise(shl(v, F.greatest(b - a, lng(0))))


def key_bits(max_zoom: int = MAX_ZOOM) -> int:
    """Bits needed for every tile id up to ``max_zoom``."""
    return 2 * max_zoom + 1


__all__ = [
    "KEY_BITS_DEFAULT", "MAX_ZOOM", "hilbert_index", "hilbert_xy", "is_valid_tile_id", "is_valid_zxy",
    "key_bits", "project_to_zoom", "range_block_cells", "tile_id", "tile_zoom", "with_aligned_block", "with_tile_address", "zoom_base",
]

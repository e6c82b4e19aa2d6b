"""Tile id ranges as squares on the map, covers of bounding boxes, and grids of tiles with their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.functions.address import (KEY_BITS_DEFAULT, hilbert_xy, range_block_cells, tile_zoom,
                                        with_aligned_block, with_tile_address, zoom_base)
from tesserix.functions.common import lng, pow2, shl
from tesserix.functions.mercator import lonlat_to_tile
from tesserix.operators.lookup import MAX_DEPTH, ROOT, responsibility
from tesserix.operators.ordered import exclusive_scan, span_join
from tesserix.session import cut_lineage


def range_blocks(ranges: DataFrame, start: str, end: str, z: str | None = None) -> DataFrame:
    """One row per aligned square of the tile id range [start, end): adds block_z, x0, y0, size.

    A range may cross zooms: each zoom's part is decomposed on its own. With ``z`` only that zoom's part is kept.
    The number of squares is at most six per zoom level.
    """
    if z is None:
        zooms = F.explode(F.sequence(tile_zoom(start), tile_zoom(F.col(end) - 1)))
        rows = ranges.filter(F.col(end) > F.col(start)).withColumn("block_z", zooms)
    else:
        rows = ranges.withColumn("block_z", F.col(z))
    rows = rows.withColumn("_base", zoom_base("block_z"))
    cells = range_block_cells("block_z", F.col(start) - F.col("_base"), F.col(end) - F.col("_base"))
    rows = rows.withColumn("_cell", F.explode(cells))
    rows = rows.withColumns({"_k": F.col("_cell.k"), "_m": F.col("_cell.m")})
    rows = rows.withColumn("_bz", F.col("block_z") - F.col("_k"))
    rows = rows.withColumn("_xy", hilbert_xy("_bz", "_m"))
    return rows.withColumns({"x0": shl(F.col("_xy.x"), F.col("_k")), "y0": shl(F.col("_xy.y"), F.col("_k")),
                             "size": pow2("_k")}).drop("_base", "_cell", "_bz", "_k", "_m", "_xy")


#: Bits of the numbers that one array may hold when ranges are expanded.
ARRAY_BITS = 16


def explode_range(df: DataFrame, first: str, count: str, out: str) -> DataFrame:
    """One row per number of [first, first + count); rows without numbers go. Long ranges are cut into chunks of 2^16, these
    into chunks of chunks, so no array ever holds more than 2^16 numbers."""
    df = df.filter(F.col(count) > 0).withColumns({"_at": lng(first), "_left": lng(count)})
    for bits in (2 * ARRAY_BITS, ARRAY_BITS):
        df = df.withColumn("_c", F.explode(F.sequence(lng(0), F.shiftright(F.col("_left") - 1, bits))))
        df = df.withColumns({"_at": F.col("_at") + F.shiftleft(F.col("_c"), bits),
                             "_left": F.least(F.col("_left") - F.shiftleft(F.col("_c"), bits), lng(1 << bits))})
    return df.withColumn(out, F.explode(F.sequence("_at", F.col("_at") + F.col("_left") - 1))).drop("_c", "_at", "_left")


def cover_boxes(boxes: DataFrame, west: str = "west", south: str = "south", east: str = "east", north: str = "north",
                z: str = "z") -> DataFrame:
    """Tiles of zoom ``z`` that a bounding box touches: one row per tile with x, y and the world copy ``wrap``.

    ``east`` < ``west`` means the box crosses the antimeridian. Rows and columns are exploded one after the other, in chunks.
    """
    side = pow2(z).cast("double")
    right = F.col(east) + F.when(F.col(east) < F.col(west), 360.0).otherwise(0.0)
    df = boxes.withColumns({
        "_x0": F.floor((F.col(west) + 180.0) / 360.0 * side).cast("bigint"),
        "_x1": F.ceil((right + 180.0) / 360.0 * side).cast("bigint") - 1,
        "_y0": lonlat_to_tile(F.lit(0.0), north, z)["y"], "_y1": lonlat_to_tile(F.lit(0.0), south, z)["y"]})
    df = df.withColumns({"_rows": F.col("_y1") - F.col("_y0") + 1, "_columns": F.greatest("_x0", "_x1") - F.col("_x0") + 1})
    df = explode_range(explode_range(df, "_y0", "_rows", "y"), "_x0", "_columns", "_x")
    return df.withColumns({"x": F.pmod("_x", pow2(z)), "wrap": F.floor(F.col("_x") / side).cast("int")}).drop(
        "_x0", "_x1", "_y0", "_y1", "_x", "_rows", "_columns")


def tile_grid(windows: DataFrame, k: str = "k") -> DataFrame:
    """All tiles of the aligned 2^k window around (z, x, y), in curve order.

    Adds ``tile_id``, ``curve_order`` (position inside the window) and the tile's ``x``, ``y``; windows carry
    (archive_id, z, x, y, k).
    """
    df = with_aligned_block(windows, k).withColumn("_n", F.col("last_tile_id") - F.col("first_tile_id") + 1)
    df = explode_range(df, "first_tile_id", "_n", "tile_id").drop("_n")
    df = df.withColumn("curve_order", F.col("tile_id") - F.col("first_tile_id"))
    df = df.drop("z", "x", "y", "x0", "y0", "size", "first_hilbert_index", "first_tile_id", "last_tile_id", k)
    return with_tile_address(df, "tile_id").drop("zoom_base", "hilbert_index")


#: A tile id above all others.
_BEYOND = 1 << KEY_BITS_DEFAULT


def state_intervals(entries: DataFrame) -> DataFrame:
    """What the directories at hand say about every tile id of an archive, as intervals without gaps:
    (archive_id, start, end, state, region).

    tile: inside a run; miss: a leaf at hand covers it and has no run there; unloaded: its leaf is not at hand;
    none: the root already rules it out. ``region`` numbers the root's leaf entries; -1 for a root tile entry.
    ``entries`` hold the directories at hand, keyed by dir_id (-1 for the root).
    """
    keys = ["archive_id", "dir_id"]
    rows = cut_lineage(responsibility(entries, keys).select(*keys, "tile_id", "run_length", "offset", F.col("next_tile_id").alias("nxt")), "entries")
    known = rows.select(*keys).distinct().withColumn("_known", F.lit(True))
    root_leaves = rows.filter((F.col("dir_id") == ROOT) & (F.col("run_length") == 0)).select("archive_id", F.col("tile_id").alias("start"))
    ordinals = exclusive_scan(root_leaves, ["archive_id"], "start", {"_r": ("sum", F.lit(1))}).select(
        "archive_id", F.col("start").alias("tile_id"), F.coalesce("_r", lng(0)).alias("region"), lng(ROOT).alias("dir_id"))
    level = rows.filter(F.col("dir_id") == ROOT).join(ordinals, [*keys, "tile_id"], "left").withColumns(
        {"region": F.coalesce("region", lng(-1)), "lo": lng(0), "hi": lng(_BEYOND)})
    parts, regions = [], None
    for depth in range(MAX_DEPTH):
        start = F.greatest("tile_id", "lo")
        reach = F.coalesce(F.least("nxt", "hi"), "hi")
        cut = level.select(*keys, "run_length", "offset", "region", start.alias("start"),
                           F.when(F.col("run_length") > 0, F.least(F.col("tile_id") + F.col("run_length"), reach)).otherwise(reach).alias("end"))
        cut = cut_lineage(cut.filter("start < end"), "level")
        parts.append(cut.filter("run_length > 0").withColumn("state", F.lit("tile")))
        leaves = cut.filter("run_length = 0").drop("dir_id").withColumnRenamed("offset", "dir_id")
        if depth == 0:
            regions = leaves.select("archive_id", "region", "start", "end")
        last = depth == MAX_DEPTH - 1
        lost = leaves if last else leaves.join(known, keys, "left_anti")
        parts.append(lost.withColumn("state", F.lit("unloaded")))
        if last or leaves.isEmpty():
            break
        below = leaves.select(*keys, "region", F.col("start").alias("lo"), F.col("end").alias("hi"))
        level = rows.join(below, keys)
    cols = ["archive_id", "region", "start", "end", "state"]
    known_tiles = parts[0].select(*cols)
    for part in parts[1:]:
        known_tiles = known_tiles.unionByName(part.select(*cols))
    known_tiles = cut_lineage(known_tiles, "intervals")
    inner = known_tiles.filter("region >= 0")
    missed = _gaps(inner, regions, ["archive_id", "region"]).withColumn("state", F.lit("miss"))
    told = cut_lineage(known_tiles.unionByName(missed.select(*cols)), "intervals")
    whole = entries.select("archive_id").distinct().withColumns({"start": lng(0), "end": lng(_BEYOND)})
    rest = _gaps(told, whole, ["archive_id"]).withColumns({"state": F.lit("none"), "region": lng(-1)})
    return told.unionByName(rest.select(*cols))


def _gaps(spans: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """What disjoint ``spans`` leave of the one frame each key has: (keys, start, end)."""
    marks = spans.select(*keys, "start", "end").unionByName(frames.select(*keys, F.col("end").alias("start"), F.lit(None).cast("bigint").alias("end")))
    before = exclusive_scan(marks, keys, "start", {"_prev": ("max", F.col("end"))})
    gaps = before.join(frames.select(*keys, F.col("start").alias("_from"), F.col("end").alias("_to")), keys)
    gaps = gaps.select(*keys, F.greatest(F.coalesce("_prev", "_from"), "_from").alias("_s"), F.least("start", "_to").alias("_e"))
    return gaps.filter("_s < _e").select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"))


def classify_windows(windows: DataFrame, entries: DataFrame, k: str = "k") -> DataFrame:
    """State of all tiles of aligned 2^k windows around (archive_id, z, x, y), from the directories at hand, as stretches of equal
    state along the curve: (archive_id, z, first_tile_id, start, end, state, region); states as in ``state_intervals``.

    A window is one range of ids, cut by the archive's intervals. Nothing grows with the number of tiles: see ``window_squares``
    for the stretches as squares and ``window_tiles`` for single tiles.
    """
    w = with_aligned_block(windows, k).select("archive_id", "z", "first_tile_id", (F.col("last_tile_id") + 1).alias("_end"))
    w = cut_lineage(w, "windows")  # an address is a large expression, and is used several times below
    spans = state_intervals(entries).withColumnsRenamed({"start": "_ss", "end": "_se"})
    cut = span_join(w, spans, ["archive_id"], "_ss", "_se", "first_tile_id", "_end")
    cut = cut.select("archive_id", "z", "first_tile_id", F.greatest("first_tile_id", "_ss").alias("start"), F.least("_end", "_se").alias("end"), "state", "region")
    bare = w.join(entries.select("archive_id").distinct(), "archive_id", "left_anti").select(
        "archive_id", "z", "first_tile_id", F.col("first_tile_id").alias("start"), F.col("_end").alias("end"), F.lit("none").alias("state"), lng(-1).alias("region"))
    return cut.unionByName(bare)


def window_squares(stretches: DataFrame) -> DataFrame:
    """The stretches as aligned squares, at most six per zoom level each."""
    return range_blocks(stretches, "start", "end", "z")


def window_tiles(stretches: DataFrame) -> DataFrame:
    """One row per tile: archive_id, tile_id, curve_order, z, x, y, state, region."""
    df = stretches.withColumn("_n", F.col("end") - F.col("start"))
    df = explode_range(df, "start", "_n", "tile_id").withColumn("curve_order", F.col("tile_id") - F.col("first_tile_id"))
    return with_tile_address(df.select("archive_id", "tile_id", "curve_order", "state", "region"), "tile_id").drop("zoom_base", "hilbert_index")


def region_edges(classified: DataFrame) -> DataFrame:
    """Borders between neighbouring tiles of different regions: (archive_id, z, x, y, side).

    ``side`` is ``left`` or ``top`` of the tile. A window never holds more than one row or column of a grid.
    """
    shown = classified.withColumn("_r", F.when(F.col("state") == "none", lng(-2)).otherwise(F.col("region")))
    row = Window.partitionBy("archive_id", "z", "y").orderBy("x")
    column = Window.partitionBy("archive_id", "z", "x").orderBy("y")

    def border(w, axis: str):
        near = F.lag(F.struct(F.col(axis).alias("at"), F.col("_r").alias("r"))).over(w)
        return F.coalesce((near["at"] + 1 == F.col(axis)) & (near["r"] != F.col("_r")), F.lit(False))

    sides = shown.withColumn("_left", border(row, "x")).withColumn("_top", border(column, "y"))
    picked = F.array_compact(F.array(F.when(F.col("_left"), F.lit("left")), F.when(F.col("_top"), F.lit("top"))))
    return sides.select("archive_id", "z", "x", "y", F.explode(picked).alias("side"))

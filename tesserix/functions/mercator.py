"""Web Mercator: longitude/latitude <-> tiles (row 0 is the northernmost)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserix.functions.common import ColumnOrName, col, let, lng, pow2

#: Northern edge of tile row 0 (fixed value).
MAX_LATITUDE = 85.0511287798066


def _side(z: ColumnOrName) -> Column:
    return pow2(z).cast("double")


def _dbl(v: ColumnOrName | float) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else col(v).cast("double")


def longitude(x: ColumnOrName | float, z: ColumnOrName) -> Column:
    return _dbl(x) / _side(z) * 360.0 - 180.0


def latitude(y: ColumnOrName | float, z: ColumnOrName) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (F.lit(1.0) - _dbl(y) * 2.0 / _side(z)))))


def tile_bounds(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName, size: ColumnOrName | int = 1,
                wrap: ColumnOrName | int = 0) -> Column:
    """STRUCT(west, south, east, north) of a tile or square block; ``wrap`` selects a copy of the world."""
    shift = _dbl(wrap) * 360.0
    return F.struct(
        (longitude(x, z) + shift).alias("west"), latitude(_dbl(y) + _dbl(size), z).alias("south"),
        (longitude(_dbl(x) + _dbl(size), z) + shift).alias("east"), latitude(y, z).alias("north"),
    )


def point_in_tile(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName, fx: ColumnOrName | float,
                  fy: ColumnOrName | float) -> Column:
    """STRUCT(lon, lat) of the place a fraction (fx, fy) of the tile's side away from its top left corner."""
    return F.struct(longitude(_dbl(x) + _dbl(fx), z).alias("lon"), latitude(_dbl(y) + _dbl(fy), z).alias("lat"))


def tile_center(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> Column:
    """STRUCT(lon, lat) of the middle of the tile on the projected plane."""
    return point_in_tile(z, x, y, 0.5, 0.5)


def lonlat_to_tile(lon: ColumnOrName, lat: ColumnOrName, z: ColumnOrName) -> Column:
    """STRUCT(z, x, y, fx, fy): the tile holding a place and the place's fraction inside it.

    Longitudes wrap around the world; latitudes are clamped to the projection's limit.
    """

    def build(v: Column) -> Column:
        last = pow2(v["z"]) - 1
        x = F.least(F.floor(v["across"]).cast("bigint"), last)
        y = F.greatest(F.least(F.floor(v["down"]).cast("bigint"), last), lng(0))
        return F.struct(v["z"].alias("z"), x.alias("x"), y.alias("y"),
                        (v["across"] - x).alias("fx"), (v["down"] - y).alias("fy"))

    phi = F.radians(F.least(F.greatest(_dbl(lat), F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    down = let(phi, lambda p: (F.lit(1.0) - F.ln(F.tan(p) + F.lit(1.0) / F.cos(p)) / F.pi()) / 2.0)
    across = F.pmod(_dbl(lon) + 180.0, F.lit(360.0)) / 360.0
    return let(F.struct(col(z).cast("int").alias("z"), (across * _side(z)).alias("across"),
                        (down * _side(z)).alias("down")), build)


def _ring(bounds: Column) -> Column:
    w, s, e, n = (bounds.getField(f) for f in ("west", "south", "east", "north"))
    return F.array(F.array(w, n), F.array(e, n), F.array(e, s), F.array(w, s), F.array(w, n))


def bounds_ring(bounds: ColumnOrName) -> Column:
    """Closed outline of a bounds struct: five [lon, lat] pairs starting at the north-west corner."""
    return let(col(bounds), _ring)


def _feature(kind: str, coordinates: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map().alias("properties"),
                              geometry.alias("geometry")))


def tile_geojson(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName) -> Column:
    """One tile as a GeoJSON polygon feature."""
    return _feature("Polygon", F.array(bounds_ring(tile_bounds(z, x, y))))


def blocks_geojson(blocks: ColumnOrName) -> Column:
    """ARRAY<STRUCT(z, x0, y0, size)> as one GeoJSON multi-polygon feature."""
    return _feature("MultiPolygon", F.transform(
        col(blocks), lambda b: F.array(bounds_ring(tile_bounds(b["z"], b["x0"], b["y0"], b["size"])))))


def requested_zoom(map_zoom: ColumnOrName, min_zoom: ColumnOrName, max_zoom: ColumnOrName,
                   is_raster: ColumnOrName) -> Column:
    """Tile zoom a map asks for at a fractional zoom: rounded for raster, floored for vector tiles.

    Deeper than the archive: its deepest zoom, stretched. Shallower than the archive: NULL, nothing is requested.
    """
    # floor(v + 0.5) rounds halves up, also below zero
    ideal = F.greatest(F.floor(_dbl(map_zoom) + F.when(col(is_raster), 0.5).otherwise(0.0)).cast("bigint"), lng(0))
    return let(ideal, lambda i: F.when(i >= lng(min_zoom), F.least(i, lng(max_zoom), lng(26)))).cast("int")


def overlaps_view(z: ColumnOrName, x: ColumnOrName, y: ColumnOrName, west: ColumnOrName, south: ColumnOrName,
                  east: ColumnOrName, north: ColumnOrName) -> Column:
    """Whether any part of the tile, or of its copy one world to either side, lies inside the view."""
    copies = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def seen(wrap: Column) -> Column:
        b = tile_bounds(z, x, y, 1, wrap)
        return ((b["west"] < col(east)) & (b["east"] > col(west)) & (b["south"] < col(north)) & (b["north"] > col(south)))

    return F.exists(copies, seen)

"""Tile address algebra: conversions, blocks, map projection, covers and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions import address as A
from tesserix.functions import mercator as M
from tesserix.operators import blocks as B
from tesserix.plans import tables as T
from tesserix.session import cut_lineage


def tile_address_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """z/x/y -> id -> z/x/y of every valid request."""
    r = T.build_requests(spark, d).filter("valid").select("request_id", F.col("target").alias("tile_id"))
    return A.with_tile_address(r).select("request_id", "tile_id", F.col("z").cast("int").alias("z"), "x", "y", "zoom_base",
                                         "hilbert_index")


ROUNDTRIP_SQL = T.with_tables("""
SELECT request_id, target AS tile_id, z, x, y, ((1::BIGINT << (2 * z)) - 1) // 3 AS zoom_base,
  target - ((1::BIGINT << (2 * z)) - 1) // 3 AS hilbert_index FROM t_requests WHERE valid""", "t_requests")


def tile_parent_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Tiles per parent two zooms up, and where the first child of the parent's sibling level starts."""
    t = T.tiles(spark, d).withColumn("pz", F.col("z") - 2)
    t = t.select("archive_id", "pz", A.project_to_zoom("x", "z", "pz").alias("px"),
                 A.project_to_zoom("y", "z", "pz").alias("py"), A.project_to_zoom("x", "z", F.lit(12)).alias("cx"))
    return t.groupBy("archive_id", "pz", "px", "py").agg(F.count(F.lit(1)).alias("n_tiles"), F.sum("cx").alias("sum_cx"))


PARENT_SQL = T.with_tables("""
SELECT archive_id, z - 2 AS pz, x // 4 AS px, y // 4 AS py, count(*)::BIGINT AS n_tiles,
  sum(x * (1::BIGINT << (12 - z)))::BIGINT AS sum_cx FROM t_tiles GROUP BY 1, 2, 3, 4""", "t_tiles")


def aligned_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The aligned square around every tile, at a level that varies with the tile."""
    t = T.tiles(spark, d).withColumn("k", F.expr("CAST(tile_id % (z + 1) AS INT)"))
    return A.with_aligned_block(t, "k").drop("z", "x", "y", "content")


ALIGNED_SQL = T.with_tables(f"""
SELECT archive_id, tile_id, k, (x >> k) << k AS x0, (y >> k) << k AS y0, 1::BIGINT << k AS size,
  f << (2 * k) AS first_hilbert_index, base + (f << (2 * k)) AS first_tile_id,
  base + (f << (2 * k)) + (1::BIGINT << (2 * k)) - 1 AS last_tile_id FROM (
  SELECT *, {T.tile_id_sql('z - k', '(x >> k)', '(y >> k)')} - ((1::BIGINT << (2 * (z - k))) - 1) // 3 AS f,
    ((1::BIGINT << (2 * z)) - 1) // 3 AS base FROM (SELECT *, (tile_id % (z + 1))::INTEGER AS k FROM t_tiles))""", "t_tiles")


def range_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every run of tiles as the fewest squares on the map."""
    e = T.entries(spark, d).selectExpr("archive_id", "tile_id", "tile_id + run_length AS stop")
    return B.range_blocks(e, "tile_id", "stop").select(
        "archive_id", "tile_id", F.col("block_z").cast("int").alias("block_z"), "x0", "y0", "size")


RANGE_BLOCKS_SQL = T.with_tables("""
, zooms AS (SELECT z, ((1::BIGINT << (2 * z)) - 1) // 3 AS base, ((1::BIGINT << (2 * z + 2)) - 1) // 3 AS stop
  FROM (SELECT unnest(range(0, 12))::INTEGER AS z)),
parts AS (SELECT archive_id, tile_id, z, greatest(tile_id, base) - base AS lo, least(tile_id + run_length, stop) - base AS hi
  FROM t_entries JOIN zooms ON tile_id < stop AND tile_id + run_length > base),
cells AS (SELECT *, unnest(range((lo + (1::BIGINT << (2 * k)) - 1) >> (2 * k), hi >> (2 * k))) AS m
  FROM (SELECT *, unnest(range(0, z + 1))::INTEGER AS k FROM parts)),
kept AS (SELECT * FROM cells WHERE k = z OR NOT ((m // 4) << (2 * k + 2) >= lo AND (m // 4 + 1) << (2 * k + 2) <= hi))
SELECT c.archive_id, c.tile_id, c.z AS block_z, min(t.x) AS x0, min(t.y) AS y0, (1::BIGINT << c.k) AS size
FROM kept c JOIN zooms g ON c.z = g.z JOIN t_tiles t ON t.archive_id = c.archive_id AND t.z = c.z
  AND t.tile_id >= g.base + (c.m << (2 * c.k)) AND t.tile_id < g.base + ((c.m + 1) << (2 * c.k))
GROUP BY c.archive_id, c.tile_id, c.z, c.k, c.m""", "t_entries", "t_tiles")


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "events").select("event_id")
    return e.selectExpr(
        "event_id AS point_id",
        "CAST(event_id * 7919 % 359999 AS DOUBLE) / 1000.0D - 179.99951237D + event_id % 3 * 360.0D AS lon",
        "CAST(event_id * 104729 % 169999 AS DOUBLE) / 1000.0D - 84.99971239D AS lat", "CAST(event_id % 15 AS INT) AS z")


_POINTS_SQL = """(SELECT event_id AS point_id,
  (event_id * 7919 % 359999)::DOUBLE / 1000.0::DOUBLE - 179.99951237::DOUBLE AS lon0,
  (event_id * 104729 % 169999)::DOUBLE / 1000.0::DOUBLE - 84.99971239::DOUBLE AS lat, (event_id % 15)::INTEGER AS z FROM events)"""


def lonlat_to_tile(spark: SparkSession, d: str) -> DataFrame:
    """Tile and place inside it for every point; two thirds of the longitudes lie on other copies of the world."""
    p = _points(spark, d).withColumn("t", M.lonlat_to_tile("lon", "lat", "z"))
    back = M.point_in_tile("t.z", "t.x", "t.y", "t.fx", "t.fy")
    p = p.select("point_id", "t.*", back.alias("b"))
    return p.select("point_id", "z", "x", "y", F.round("fx", 6).alias("fx"), F.round("fy", 6).alias("fy"),
                    F.round("b.lon", 6).alias("lon"), F.round("b.lat", 6).alias("lat"))


LONLAT_SQL = f"""
SELECT point_id, z, floor(px)::BIGINT AS x, floor(py)::BIGINT AS y, round(px - floor(px), 6) AS fx,
  round(py - floor(py), 6) AS fy, round(lon0, 6) AS lon, round(lat, 6) AS lat FROM (
  SELECT *, (lon0 + 180) / 360 * (1::BIGINT << z) AS px,
    (1 - asinh(tan(radians(lat))) / pi()) / 2 * (1::BIGINT << z) AS py FROM {_POINTS_SQL})"""


def tile_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds, centre and GeoJSON outline of every tile."""
    t = T.tiles(spark, d)
    js = M.tile_geojson("z", "x", "y")
    t = t.select("archive_id", "tile_id", M.tile_bounds("z", "x", "y").alias("b"), M.tile_center("z", "x", "y").alias("c"),
                 F.from_json(js, "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>").alias("g"))
    ring = F.col("g.geometry.coordinates")[0]
    return t.select(
        "archive_id", "tile_id", *[F.round(f"b.{f}", 8).alias(f) for f in ("west", "south", "east", "north")],
        F.round("c.lon", 8).alias("center_lon"), F.round("c.lat", 8).alias("center_lat"),
        F.col("g.geometry.type").alias("shape"), F.size(ring).cast("bigint").alias("ring_points"),
        F.round(ring[0][0], 8).alias("ring_west"), F.round(ring[2][1], 8).alias("ring_south"))


_LAT = "degrees(2 * atan(exp(pi() * (1 - 2 * ({y}) / (1::BIGINT << z)))) - pi() / 2)"

BOUNDS_SQL = T.with_tables(f"""
SELECT archive_id, tile_id, round(x * 360.0::DOUBLE / (1::BIGINT << z) - 180, 8) AS west,
  round({_LAT.format(y='y + 1.0::DOUBLE')}, 8) AS south, round((x + 1) * 360.0::DOUBLE / (1::BIGINT << z) - 180, 8) AS east,
  round({_LAT.format(y='y * 1.0::DOUBLE')}, 8) AS north,
  round((x + 0.5::DOUBLE) * 360.0::DOUBLE / (1::BIGINT << z) - 180, 8) AS center_lon,
  round({_LAT.format(y='y + 0.5::DOUBLE')}, 8) AS center_lat, 'Polygon' AS shape, 5::BIGINT AS ring_points,
  round(x * 360.0::DOUBLE / (1::BIGINT << z) - 180, 8) AS ring_west, round({_LAT.format(y='y + 1.0::DOUBLE')}, 8) AS ring_south
FROM t_tiles""", "t_tiles")


def run_regions(spark: SparkSession, d: str) -> DataFrame:
    """The area of every run on the map as one multi-polygon, checked through its outlines."""
    e = T.entries(spark, d).selectExpr("archive_id", "tile_id", "tile_id + run_length AS stop")
    b = B.range_blocks(e, "tile_id", "stop")
    # A run has at most six squares per zoom level, so this list is short whatever the run's length.
    g = b.groupBy("archive_id", "tile_id").agg(F.collect_list(F.struct(F.col("block_z").alias("z"), "x0", "y0", "size")).alias("l"))
    js = F.from_json(M.blocks_geojson("l"), "geometry struct<type:string,coordinates:array<array<array<array<double>>>>>")
    g = g.select("archive_id", "tile_id", js.alias("j")).select("archive_id", "tile_id", F.col("j.geometry.coordinates").alias("c"))
    width = F.aggregate("c", F.lit(0.0), lambda a, p: a + p[0][1][0] - p[0][0][0])
    return g.select("archive_id", "tile_id", F.size("c").cast("bigint").alias("n_squares"), F.round(width, 6).alias("sum_width"))


RUN_REGIONS_SQL = f"""SELECT archive_id, tile_id, count(*)::BIGINT AS n_squares,
  round(sum(size * 360.0::DOUBLE / (1::BIGINT << block_z)), 6) AS sum_width FROM ({RANGE_BLOCKS_SQL})
GROUP BY 1, 2"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "customer").selectExpr(
        "c_custkey AS box_id", "CAST(c_custkey % 7 AS INT) AS z",
        "CAST(c_custkey * 37 % 359 AS DOUBLE) - 179.75D AS west", "CAST(c_custkey * 53 % 150 AS DOUBLE) - 80.3D AS south",
        "c_custkey % 40 + 0.5D AS w", "c_custkey % 9 + 0.4D AS h").selectExpr(
        "box_id", "z", "west", "south", "CASE WHEN west + w > 180 THEN west + w - 360 ELSE west + w END AS east",
        "south + h AS north")


def cover_bbox(spark: SparkSession, d: str) -> DataFrame:
    """Tiles covering a box per customer; some boxes cross the antimeridian."""
    return B.cover_boxes(_boxes(spark, d)).select("box_id", "z", "x", "y", "wrap")


COVER_SQL = f"""
WITH b AS (SELECT c_custkey AS box_id, (c_custkey % 7)::INTEGER AS z, (c_custkey * 37 % 359)::DOUBLE - 179.75 AS west,
    (c_custkey * 53 % 150)::DOUBLE - 80.3 AS south, c_custkey % 40 + 0.5::DOUBLE AS w, c_custkey % 9 + 0.4::DOUBLE AS h FROM customer),
t AS (SELECT b.*, x, y FROM b, LATERAL (SELECT unnest(range(0, 2 * (1::BIGINT << z))) AS x) , LATERAL (SELECT unnest(range(0, 1::BIGINT << z)) AS y))
SELECT box_id, z, x % (1::BIGINT << z) AS x, y, (x // (1::BIGINT << z))::INTEGER AS wrap FROM t
WHERE x * 360.0::DOUBLE / (1::BIGINT << z) - 180 < west + w AND (x + 1) * 360.0::DOUBLE / (1::BIGINT << z) - 180 > west
  AND {_LAT.format(y='y + 1.0::DOUBLE')} < south + h AND {_LAT.format(y='y * 1.0::DOUBLE')} > south"""


def tiles_in_view(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of each archive that lie in its declared bounds moved half a world east."""
    a = T.archives(spark, d).selectExpr(
        "archive_id", "min_lon_e7 / 1e7D + 200 AS west", "min_lat_e7 / 1e7D + 100 AS south", "max_lon_e7 / 1e7D + 20 AS east",
        "max_lat_e7 / 1e7D AS north")
    t = T.tiles(spark, d).select("archive_id", "z", "x", "y").join(a, "archive_id")
    seen = M.overlaps_view("z", "x", "y", "west", "south", "east", "north")
    return t.groupBy("archive_id", "z").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("n_seen"))


IN_VIEW_SQL = T.with_tables(f"""
SELECT archive_id, z, count(*)::BIGINT AS n, count(*) FILTER (WHERE s < north AND n > south AND (
    (w - 360 < east AND e - 360 > west) OR (w < east AND e > west) OR (w + 360 < east AND e + 360 > west)))::BIGINT AS n_seen
FROM (SELECT t.archive_id, z, x * 360.0::DOUBLE / (1::BIGINT << z) - 180 AS w, (x + 1) * 360.0::DOUBLE / (1::BIGINT << z) - 180 AS e,
    {_LAT.format(y='y + 1.0::DOUBLE')} AS s, {_LAT.format(y='y * 1.0::DOUBLE')} AS n, min_lon_e7 / 1e7 + 200 AS west,
    min_lat_e7 / 1e7 + 100 AS south, max_lon_e7 / 1e7 + 20 AS east, max_lat_e7 / 1e7 AS north
  FROM t_tiles t JOIN t_archives a ON t.archive_id = a.archive_id)
GROUP BY 1, 2""", "t_tiles", "t_archives")


def requested_zooms(spark: SparkSession, d: str) -> DataFrame:
    """Tile zoom a map asks each archive for, at the zoom of each event."""
    e = T.read(spark, d, "events").selectExpr("event_id", "user_id AS archive_id", "event_id % 1600 / 100.0D AS map_zoom")
    a = T.archives(spark, d).select("archive_id", "min_zoom", "max_zoom", "tile_type")
    z = M.requested_zoom("map_zoom", "min_zoom", "max_zoom", F.col("tile_type").between(2, 5))
    return e.join(a, "archive_id").withColumn("tile_z", z).groupBy("tile_z", "tile_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("map_zoom") >= F.col("max_zoom") + 1).alias("n_overzoomed"))


REQUESTED_SQL = T.with_tables("""
SELECT CASE WHEN i >= min_zoom THEN least(i, max_zoom) END::INTEGER AS tile_z, tile_type, count(*)::BIGINT AS n,
  count(*) FILTER (WHERE map_zoom >= max_zoom + 1)::BIGINT AS n_overzoomed FROM (
  SELECT a.*, event_id % 1600 / 100.0::DOUBLE AS map_zoom,
    CASE WHEN tile_type BETWEEN 2 AND 5 THEN (event_id % 1600 + 50) // 100 ELSE event_id % 1600 // 100 END AS i
  FROM events e JOIN t_archives a ON e.user_id = a.archive_id) GROUP BY 1, 2""", "t_archives")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """A 16 x 16 window per archive and zoom 4 and 6..8, classified with every third leaf not at hand.

    Archives whose first tile comes late have nothing at zoom 4.
    """
    t = T.tiles(spark, d)
    focus = t.filter("z BETWEEN 6 AND 8").groupBy("archive_id", "z").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    focus = focus.unionByName(t.select("archive_id").distinct().selectExpr("archive_id", "4 AS z", "0L AS x", "0L AS y"))
    focus = focus.withColumn("k", F.lit(4))
    tree = T.leaves(spark, d).filter("dir_id = -1 OR leaf_no % 3 <> 1")
    return B.classify_windows(focus, tree)


def grid_classes(spark: SparkSession, d: str) -> DataFrame:
    """State and region of every tile in a window of each archive."""
    return B.window_tiles(_grid(spark, d)).select("archive_id", F.col("z").cast("int").alias("z"), "x", "y", "tile_id", "curve_order", "state", "region")


_GRID = f"""
, focus AS (SELECT archive_id, z, (max(x) >> 4) << 4 AS x0, (max(y) >> 4) << 4 AS y0 FROM t_tiles WHERE z BETWEEN 6 AND 8 GROUP BY 1, 2
  UNION ALL SELECT DISTINCT archive_id, 4, 0, 0 FROM t_tiles),
cells AS (SELECT archive_id, z, x0 + i % 16 AS x, y0 + i // 16 AS y FROM focus, (SELECT unnest(range(0, 256)) AS i)),
grid AS (SELECT *, {T.tile_id_sql('z', 'x', 'y')} AS tile_id FROM cells),
classed AS (SELECT g.*, g.tile_id - min(g.tile_id) OVER (PARTITION BY g.archive_id, g.z) AS curve_order,
  CASE WHEN e.tile_id IS NULL THEN 'none' WHEN d.leaves > 1 AND e.leaf_no % 3 = 1 THEN 'unloaded'
    WHEN g.tile_id < e.tile_id + e.run_length THEN 'tile' WHEN d.leaves > 1 THEN 'miss' ELSE 'none' END AS state,
  CASE WHEN e.tile_id IS NULL OR d.leaves = 1 THEN -1 ELSE e.leaf_no END::BIGINT AS region
  FROM grid g ASOF LEFT JOIN t_numbered e ON g.archive_id = e.archive_id AND g.tile_id >= e.tile_id
  LEFT JOIN t_leaf_dirs d ON e.archive_id = d.archive_id AND e.leaf_no = d.leaf_no)
"""


def _grid_sql(body: str) -> str:
    return T.with_tables(_GRID + body, "t_tiles", "t_leaf_dirs", "t_numbered")


GRID_SQL = _grid_sql("SELECT archive_id, z, x, y, tile_id, curve_order, state, region FROM classed")


def region_edges(spark: SparkSession, d: str) -> DataFrame:
    """Borders between regions inside each window."""
    return B.region_edges(cut_lineage(B.window_tiles(_grid(spark, d)), "grid")).withColumn("z", F.col("z").cast("int"))


EDGES_SQL = _grid_sql("""
, shown AS (SELECT *, CASE WHEN state = 'none' THEN -2 ELSE region END AS r FROM classed)
SELECT a.archive_id, a.z, a.x, a.y, CASE WHEN b.x < a.x THEN 'left' ELSE 'top' END AS side FROM shown a JOIN shown b
  ON a.archive_id = b.archive_id AND a.z = b.z AND ((a.y = b.y AND a.x = b.x + 1) OR (a.x = b.x AND a.y = b.y + 1)) WHERE a.r <> b.r""")


def grid_squares(spark: SparkSession, d: str) -> DataFrame:
    """The same windows as squares of equal state: tiles per state and region without listing any."""
    s = B.window_squares(_grid(spark, d))
    return s.groupBy("archive_id", F.col("z").cast("int").alias("z"), "state", "region").agg(F.sum(F.col("size") * F.col("size")).alias("n_tiles"))


SQUARES_SQL = _grid_sql("SELECT archive_id, z, state, region, count(*)::BIGINT AS n_tiles FROM classed GROUP BY 1, 2, 3, 4")

QUERIES = {
    "grid_squares": (grid_squares, SQUARES_SQL),
    "tile_address_roundtrip": (tile_address_roundtrip, ROUNDTRIP_SQL),
    "tile_parent_rollup": (tile_parent_rollup, PARENT_SQL),
    "aligned_blocks": (aligned_blocks, ALIGNED_SQL),
    "range_blocks": (range_blocks, RANGE_BLOCKS_SQL),
    "run_regions": (run_regions, RUN_REGIONS_SQL),
    "lonlat_to_tile": (lonlat_to_tile, LONLAT_SQL),
    "tile_bounds": (tile_bounds, BOUNDS_SQL),
    "cover_bbox": (cover_bbox, COVER_SQL),
    "tiles_in_view": (tiles_in_view, IN_VIEW_SQL),
    "requested_zooms": (requested_zooms, REQUESTED_SQL),
    "grid_classes": (grid_classes, GRID_SQL),
    "region_edges": (region_edges, EDGES_SQL),
}

"""Vector-tile features: flattening, rules, geometry, dictionaries, hit tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions import address as A
from tesserix.functions import geometry as G
from tesserix.functions import mercator as M
from tesserix.operators import features as V
from tesserix.operators import lookup as L
from tesserix.plans import tables as T
from tesserix.session import cut_lineage

_BASE = """p_partkey AS p, 0L AS archive_id, 3 AS z, 21 + p_partkey % 64 AS tile_id, CAST(p_size % 3 AS INT) AS layer_index,
  CAST(CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 + p_partkey % 3 END AS INT) AS type, p_partkey * 37 % 3000 AS a, p_partkey * 53 % 3000 AS b,
  10 + CAST(p_size AS BIGINT) AS w"""
_GEOMETRY = """CASE WHEN p % 3 = 0 THEN array(9L, 2 * a, 2 * b) WHEN p % 3 = 1 THEN array(9L, 2 * a, 2 * b, 18L, 2 * w, 0L, 0L, 2 * w)
  ELSE concat(array(9L, 2 * a, 2 * b, 26L, 2 * w, 0L, 0L, 2 * w, 2 * w - 1, 0L, 15L),
    CASE WHEN p % 5 = 0 THEN array(9L, 4L, 2 * (w - 2) - 1, 26L, 0L, 2 * (w - 4), 2 * (w - 4), 0L, 0L, 2 * (w - 4) - 1, 15L) ELSE CAST(array() AS ARRAY<BIGINT>) END) END"""
_TAGS = """concat(array(CAST(p % 3 AS INT), CAST(p % 7 AS INT), CAST((p + 1) % 4 AS INT), CAST(p % 13 AS INT)), CASE WHEN p % 17 = 0 THEN array(1) ELSE CAST(array() AS ARRAY<INT>) END)"""


def build_features(spark: SparkSession, d: str) -> DataFrame:
    """t_features from ``part``: points, lines and squares, every fifth square with a hole, some of unknown type."""
    f = T.over_tasks(T.read(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr(*[c for c in _BASE.replace("\n", " ").split(", ") if c])
    return f.selectExpr("*", f"{_GEOMETRY} AS geometry", f"{_TAGS} AS tags", "concat('layer', layer_index) AS layer", "4096 AS extent", "p AS feature_index",
                        "20 + w AS bytes", "8 + w % 7 AS geometry_bytes", "4 + p % 3 AS tags_bytes")


def features(spark: SparkSession, d: str) -> DataFrame:
    """t_features with decoded geometry, stored once: hit tests and exports read it many times."""
    return T.stored(spark, d, "t_features", lambda s, p: V.with_geometry(build_features(s, p)))


T.CTES["t_features"] = ("""
SELECT *, 20 + w AS bytes, 8 + w % 7 AS geometry_bytes, 4 + p % 3 AS tags_bytes, 'layer' || layer_index AS layer, p % 3 = 2 AND p % 31 <> 0 AS is_polygon,
  p % 15 = 5 AS hole FROM (SELECT p_partkey AS p, 0::BIGINT AS archive_id, 3 AS z, 21 + p_partkey % 64 AS tile_id, (p_size % 3)::INTEGER AS layer_index,
  (CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 + p_partkey % 3 END)::INTEGER AS type, p_partkey * 37 % 3000 AS a, p_partkey * 53 % 3000 AS b, 10 + p_size::BIGINT AS w FROM part)""", [])


def geometry_stats(spark: SparkSession, d: str) -> DataFrame:
    """Commands, vertices, parts, rings, box and area of every feature."""
    f = V.with_geometry(build_features(spark, d))

    def count(role: str):
        return F.size(F.filter("parts", lambda p: p["role"] == role)).cast("bigint")

    return f.select("p", F.size("commands").cast("bigint").alias("n_commands"), G.vertex_count("parts").cast("bigint").alias("n_vertices"),
                    F.size("parts").cast("bigint").alias("n_parts"), count("exterior").alias("n_exterior"), count("interior").alias("n_interior"),
                    F.size(F.filter("parts", lambda p: p["closed"])).cast("bigint").alias("n_closed"), "bbox.*", "area", F.size("issues").cast("bigint").alias("n_issues"))


GEOMETRY_SQL = T.with_tables("""
SELECT p, CASE p % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE CASE WHEN hole THEN 6 ELSE 3 END END::BIGINT AS n_commands,
  CASE p % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE CASE WHEN hole THEN 8 ELSE 4 END END::BIGINT AS n_vertices, CASE WHEN hole THEN 2 ELSE 1 END::BIGINT AS n_parts,
  CASE WHEN is_polygon THEN 1 ELSE 0 END::BIGINT AS n_exterior, CASE WHEN is_polygon AND hole THEN 1 ELSE 0 END::BIGINT AS n_interior,
  CASE WHEN p % 3 = 2 THEN CASE WHEN hole THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS n_closed, a AS min_x, b AS min_y,
  a + CASE WHEN p % 3 = 0 THEN 0 ELSE w END AS max_x, b + CASE WHEN p % 3 = 0 THEN 0 ELSE w END AS max_y,
  CASE WHEN is_polygon THEN w * w - CASE WHEN hole THEN (w - 4) * (w - 4) ELSE 0 END ELSE 0 END::DOUBLE AS area, 0::BIGINT AS n_issues FROM t_features""", "t_features")


def geometry_issues(spark: SparkSession, d: str) -> DataFrame:
    """Ten kinds of broken command streams."""
    streams = [("9L, 50L", 1), ("17L, 2L, 2L, 2L, 2L", 2), ("", 1), ("10L, 2L, 2L", 2), ("15L", 3), ("9L, 2L, 2L, 23L", 1), ("9L, 2L, 2L, 4L", 1),
               ("9L, 2L, 2L, 18L, 2L, 2L, 2L, 2L, 15L", 3), ("9L, 2L, 2L, 26L, 0L, 20L, 20L, 0L, 0L, 19L, 15L", 3), ("1L", 1)]
    pick = " ".join(f"WHEN {i} THEN CAST(array({s}) AS ARRAY<BIGINT>)" for i, (s, _) in enumerate(streams))
    types = " ".join(f"WHEN {i} THEN {t}" for i, (_, t) in enumerate(streams))
    f = T.over_tasks(T.read(spark, d, "part").select("p_partkey"), "p_partkey").selectExpr("p_partkey AS p", f"CASE p_partkey % 10 {pick} END AS geometry", f"CASE p_partkey % 10 {types} END AS type")
    g = V.with_geometry(f)
    return g.select("p", F.array_join(F.array_sort("issues"), ",").alias("issues"), F.size("parts").cast("bigint").alias("n_parts"),
                    G.vertex_count("parts").cast("bigint").alias("n_vertices"))


GEOMETRY_ISSUES_SQL = """
SELECT p_partkey AS p, ['missing-parameters', 'line-order', 'point-order', 'line-before-move,line-order', 'close-before-move,polygon-order', 'close-count,point-order',
  'point-order,unknown-command', 'zero-area', 'interior-before-exterior', 'count-zero'][p_partkey % 10 + 1] AS issues,
  [0, 2, 0, 1, 0, 1, 1, 1, 1, 0][p_partkey % 10 + 1]::BIGINT AS n_parts, [0, 2, 0, 1, 0, 1, 1, 3, 4, 0][p_partkey % 10 + 1]::BIGINT AS n_vertices FROM part"""


def command_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Commands used per layer."""
    c = features(spark, d).select("layer", F.explode("commands").alias("c"))
    return c.groupBy("layer", F.col("c.id").alias("command")).agg(F.count(F.lit(1)).alias("n"), F.sum("c.count").alias("repeats"))


HISTOGRAM_SQL = T.with_tables("""
SELECT layer, command, count(*)::BIGINT AS n, sum(r)::BIGINT AS repeats FROM (
  SELECT layer, unnest(CASE WHEN hole THEN [1, 2, 7, 1, 2, 7] WHEN p % 3 = 2 THEN [1, 2, 7] WHEN p % 3 = 1 THEN [1, 2] ELSE [1] END) AS command,
    unnest(CASE WHEN hole THEN [1, 3, 1, 1, 3, 1] WHEN p % 3 = 2 THEN [1, 3, 1] WHEN p % 3 = 1 THEN [1, 2] ELSE [1] END) AS r FROM t_features) GROUP BY 1, 2""", "t_features")


def layers(spark: SparkSession, d: str) -> DataFrame:
    """t_layers: one dictionary per tile and layer, some breaking a rule."""
    f = build_features(spark, d).select("archive_id", "z", "tile_id", "layer_index").distinct()
    values = ", ".join(
        f"named_struct('string', {chr(39) + 'v' + str(j) + chr(39) if j % 7 == 0 else 'CAST(NULL AS STRING)'}, 'float', CAST({j if j % 7 == 1 else 'NULL'} AS FLOAT), "
        f"'double', CAST({j if j % 7 == 2 else 'NULL'} AS DOUBLE), 'int', CAST({-j if j % 7 == 3 else 'NULL'} AS BIGINT), 'uint', CAST({j if j % 7 == 4 else 'NULL'} AS DECIMAL(20, 0)), "
        f"'sint', CAST({-j if j % 7 == 5 else 'NULL'} AS BIGINT), 'bool', CAST({'true' if j % 7 == 6 else 'NULL'} AS BOOLEAN))" for j in range(10))
    return f.selectExpr("*", "CASE WHEN (tile_id + layer_index) % 11 = 0 THEN NULL WHEN tile_id % 6 = 0 AND layer_index = 2 THEN 'layer1' ELSE concat('layer', layer_index) END AS name",
                        "CASE WHEN (tile_id + layer_index) % 5 = 0 THEN 1 WHEN (tile_id + layer_index) % 5 = 1 THEN NULL ELSE 2 END AS version",
                        "CASE WHEN (tile_id + layer_index) % 7 = 0 THEN NULL ELSE 4096 END AS extent", "array('name', 'size', 'kind') AS keys", f"array({values}) AS values",
                        "concat('layer', layer_index) AS layer", "40 + layer_index AS key_bytes", "60 + tile_id AS value_bytes")


T.CTES["t_layers"] = ("""SELECT *, CASE WHEN (tile_id + layer_index) % 11 = 0 THEN NULL WHEN tile_id % 6 = 0 AND layer_index = 2 THEN 'layer1' ELSE 'layer' || layer_index END AS name
FROM (SELECT DISTINCT archive_id, z, tile_id, layer_index FROM t_features)""", ["t_features"])


def layer_issues(spark: SparkSession, d: str) -> DataFrame:
    """Layers that break a rule."""
    return V.layer_issues(layers(spark, d), ["archive_id", "tile_id"])


LAYER_ISSUES_SQL = T.with_tables("""
SELECT archive_id, tile_id, layer_index, 'no-name' AS issue FROM t_layers WHERE name IS NULL
UNION ALL SELECT archive_id, tile_id, layer_index, 'version' FROM t_layers WHERE (tile_id + layer_index) % 5 < 2
UNION ALL SELECT archive_id, tile_id, layer_index, 'no-extent' FROM t_layers WHERE (tile_id + layer_index) % 7 = 0
UNION ALL SELECT archive_id, tile_id, layer_index, 'duplicate-name' FROM t_layers a WHERE EXISTS (
  SELECT 1 FROM t_layers b WHERE b.tile_id = a.tile_id AND b.name = a.name AND b.layer_index < a.layer_index)""", "t_layers")


def feature_rules(spark: SparkSession, d: str) -> DataFrame:
    """Tag and geometry rules broken by features, counted."""
    f = build_features(spark, d).withColumn("geometry", F.when(F.col("p") % 41 == 3, F.array().cast("array<bigint>")).otherwise(F.col("geometry")))
    f = f.withColumn("type", F.when(F.col("p") % 43 == 5, 9).otherwise(F.col("type")))
    tags = F.transform(V.tag_issues(F.col("tags"), F.lit(3), F.lit(10)), lambda v: v["issue"])
    return f.select(F.explode(F.concat(tags, V.feature_issues(F.col("type"), F.col("geometry")))).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


RULES_SQL = T.with_tables("""
SELECT issue, count(*)::BIGINT AS n FROM (SELECT unnest(
  [CASE WHEN p % 17 = 0 THEN 'odd-count' END, CASE WHEN (p + 1) % 4 = 3 THEN 'key-range' END, CASE WHEN p % 13 >= 10 THEN 'value-range' END,
   CASE WHEN p % 43 = 5 THEN 'undefined-type' WHEN type = 0 THEN 'unknown-type' END, CASE WHEN p % 41 = 3 THEN 'empty-geometry' END]) AS issue FROM t_features)
WHERE issue IS NOT NULL GROUP BY 1""", "t_features")


def feature_properties(spark: SparkSession, d: str) -> DataFrame:
    """Properties of every feature; an index out of range gives NULL."""
    f = build_features(spark, d).select("archive_id", "tile_id", "layer_index", "p", "tags")
    both = f.join(layers(spark, d).select("archive_id", "tile_id", "layer_index", "keys", "values"), ["archive_id", "tile_id", "layer_index"])
    rows = both.select("p", F.inline(V.properties(F.col("tags"), F.col("keys"), F.col("values"))))
    v = F.col("value")
    return rows.select("p", "key", F.col("key_index").cast("bigint").alias("key_index"), F.col("value_index").cast("bigint").alias("value_index"),
                       F.when(v.isNotNull(), V.value_type(v)).alias("type"), V.value_text(v).alias("text"))


PROPERTIES_SQL = T.with_tables("""
SELECT p, ['name', 'size', 'kind'][k + 1] AS key, k AS key_index, v AS value_index,
  CASE WHEN v < 10 THEN ['string', 'float', 'double', 'int', 'uint', 'sint', 'bool'][v % 7 + 1] END AS type,
  ['v0', '1.0', '2.0', '-3', '4', '-5', 'true', 'v7', '8.0', '9.0'][v + 1] AS text
FROM (SELECT p, unnest([p % 3, (p + 1) % 4]) AS k, unnest([p % 7, p % 13]) AS v FROM t_features)""", "t_features")


def value_types(spark: SparkSession, d: str) -> DataFrame:
    """Type of a value per part, where some set no field or two."""
    def field(no: int, value: str, kind: str) -> str:
        return f"CAST(CASE WHEN p_partkey % 9 = {no} OR (p_partkey % 9 = 7 AND {no} IN (1, 4)) THEN {value} END AS {kind})"

    kinds = [("string", "p_name", "STRING"), ("float", "p_size", "FLOAT"), ("double", "p_retailprice", "DOUBLE"), ("int", "-p_partkey", "BIGINT"),
             ("uint", "p_partkey", "DECIMAL(20, 0)"), ("sint", "-p_size", "BIGINT"), ("bool", "p_size > 25", "BOOLEAN")]
    value = ", ".join(f"'{name}', {field(no, v, k)}" for no, (name, v, k) in enumerate(kinds))
    p = T.read(spark, d, "part").selectExpr("p_partkey AS p", f"named_struct({value}) AS v")
    return p.select("p", V.value_type(F.col("v")).alias("type"), V.is_single_value(F.col("v")).alias("single"))


VALUE_TYPES_SQL = """SELECT p_partkey AS p, ['string', 'float', 'double', 'int', 'uint', 'sint', 'bool', 'uint', 'unknown'][p_partkey % 9 + 1] AS type,
  p_partkey % 9 < 7 AS single FROM part"""


def flatten_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Nested tiles to one row per feature, with the tiles that broke off as error rows."""
    nested = T.read(spark, d, "part").selectExpr(
        "p_partkey AS tile_id", "CASE WHEN p_partkey % 9 = 0 THEN 'truncated' END AS error",
        """transform(sequence(1, CAST(1 + p_partkey % 3 AS INT)), l -> named_struct('name', concat('layer', l), 'version', 2, 'extent', CASE WHEN l = 2 THEN 512 END,
          'features', transform(sequence(1, CAST(l + p_partkey % 4 AS INT)), f -> named_struct('id', CASE WHEN f % 2 = 0 THEN f * 10 + l END, 'type', 1, 'geometry', array(9L, CAST(f AS BIGINT), CAST(l AS BIGINT)))))) AS layers""")
    rows = V.flatten_features(V.flatten_layers(nested, ["tile_id"]), ["tile_id"])
    out = rows.select("tile_id", F.col("layer_index").cast("bigint").alias("layer_index"), "layer", "extent", F.col("feature_index").cast("bigint").alias("feature_index"),
                      F.col("id").cast("bigint").alias("id"), F.element_at("geometry", 2).alias("x"), F.lit(None).cast("string").alias("error"))
    errors = V.tile_errors(nested, ["tile_id"]).select("tile_id", F.col("layers_read").cast("bigint").alias("layer_index"), "error")
    return out.unionByName(errors, allowMissingColumns=True)


FLATTEN_SQL = """
WITH l AS (SELECT p_partkey AS p, unnest(range(1, 2 + p_partkey % 3)) AS l FROM part), f AS (SELECT *, unnest(range(1, 1 + l + p % 4)) AS f FROM l)
SELECT p AS tile_id, l - 1 AS layer_index, 'layer' || l AS layer, CASE WHEN l = 2 THEN 512 ELSE 4096 END AS extent, f - 1 AS feature_index,
  CASE WHEN f % 2 = 0 THEN f * 10 + l END AS id, f AS x, NULL AS error FROM f
UNION ALL SELECT p_partkey, 1 + p_partkey % 3, NULL, NULL, NULL, NULL, NULL, 'truncated' FROM part WHERE p_partkey % 9 = 0"""


def layer_byte_share(spark: SparkSession, d: str) -> DataFrame:
    """Bytes by kind for every layer, zoom and archive."""
    out = V.layer_byte_share(build_features(spark, d), layers(spark, d))
    return out.withColumns({"geometry_share": F.round("geometry_share", 6), "level": F.col("level").cast("bigint")})


BYTE_SHARE_SQL = T.with_tables("""
, r AS (SELECT archive_id, z, layer, 1 AS n, bytes AS f, geometry_bytes AS g, tags_bytes AS t, 0 AS k, 0 AS v FROM t_features
  UNION ALL SELECT archive_id, z, 'layer' || layer_index, 0, 0, 0, 0, 40 + layer_index, 60 + tile_id FROM t_layers)
SELECT archive_id, z, layer, grouping_id(archive_id, z, layer)::BIGINT AS level, sum(n)::BIGINT AS features, sum(f)::BIGINT AS feature_bytes, sum(g)::BIGINT AS geometry_bytes,
  sum(t)::BIGINT AS tags_bytes, sum(k)::BIGINT AS key_bytes, sum(v)::BIGINT AS value_bytes, round(sum(g) / sum(f + k + v)::DOUBLE, 6) AS geometry_share FROM r GROUP BY CUBE (archive_id, z, layer)""",
                               "t_features", "t_layers")


def dictionary_use(spark: SparkSession, d: str) -> DataFrame:
    """How often each key of each layer is used."""
    keys = ["archive_id", "tile_id", "layer_index"]
    out = V.dictionary_use(build_features(spark, d), layers(spark, d), keys)
    return out.withColumn("k", F.col("k").cast("bigint"))


DICTIONARY_SQL = T.with_tables("""
SELECT archive_id, tile_id, layer_index, k, ['name', 'size', 'kind'][k + 1] AS key, count(*)::BIGINT AS uses, count(DISTINCT v)::BIGINT AS distinct_values
FROM (SELECT *, unnest([p % 3, (p + 1) % 4]) AS k, unnest([p % 7, p % 13]) AS v FROM t_features) GROUP BY 1, 2, 3, 4""", "t_features")


def tile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Layers, features and largest layer of every tile."""
    return V.tile_summary(build_features(spark, d), ["archive_id", "tile_id"]).withColumn("largest_layer", F.col("largest_layer").cast("bigint"))


TILE_SUMMARY_SQL = T.with_tables("""
SELECT archive_id, tile_id, count(*)::BIGINT AS n_layers, sum(n)::BIGINT AS n_features, arg_max(layer_index, (n, -layer_index))::BIGINT AS largest_layer
FROM (SELECT archive_id, tile_id, layer_index, count(*) AS n FROM t_features GROUP BY 1, 2, 3) GROUP BY 1, 2""", "t_features")


def feature_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Every feature as GeoJSON: its shape (NULL where the type gives none), and all its positions in document order, counted, summed,
    and the first and last of them."""
    f = A.with_tile_address(features(spark, d).drop("z"))
    js = f.select("p", "type", G.feature_geojson("parts", "type", "z", "x", "y", "extent").alias("j"))
    js = T.stored(spark, d, "t_geojson", lambda s, q: js)
    # Every number in document order, whatever the nesting: longitudes and latitudes by turns.
    flat = F.transform(F.regexp_extract_all("j", F.lit(r"-?[0-9]+\.[0-9]+(?:E-?[0-9]+)?"), F.lit(0)), lambda v: v.cast("double"))
    js = js.select("p", F.get_json_object("j", "$.geometry.type").alias("shape"), F.coalesce(flat, F.array().cast("array<double>")).alias("v"))

    def total(odd: int):
        return F.aggregate(F.filter("v", lambda _, i: i % 2 == odd), F.lit(0.0), lambda a, v: a + v)

    some = F.size("v") > 0
    return js.select("p", "shape", F.size("v").cast("bigint").alias("numbers"), F.round(F.get("v", F.lit(0)), 7).alias("lon"),
                     F.round(F.get("v", F.lit(1)), 7).alias("lat"), F.round(F.get("v", F.size("v") - 1), 7).alias("last_lat"),
                     F.round(F.when(some, total(0)), 6).alias("sum_lon"), F.round(F.when(some, total(1)), 6).alias("sum_lat"))


_Y = "degrees(2 * atan(exp(pi() * (1 - 2 * (ty + ({v}) / 4096.0::DOUBLE) / 8))) - pi() / 2)"
# Positions of a feature, as offsets from (a, b) in document order; rings end where they begin.
_POSITIONS = """CASE WHEN type = 0 THEN [] WHEN p % 3 = 0 THEN [[0, 0]] WHEN p % 3 = 1 THEN [[0, 0], [w, 0], [w, w]]
  WHEN hole THEN [[0, 0], [w, 0], [w, w], [0, w], [0, 0], [2, 2], [2, w - 2], [w - 2, w - 2], [w - 2, 2], [2, 2]]
  ELSE [[0, 0], [w, 0], [w, w], [0, w], [0, 0]] END"""
GEOJSON_SQL = T.with_tables(f"""
, xy AS (SELECT *, tile_id - 21 AS h FROM t_features), addr AS (SELECT x AS tx, y AS ty, h2 FROM (SELECT x, y, {T.tile_id_sql('3', 'x', 'y')} - 21 AS h2 FROM (
  SELECT i % 8 AS x, i // 8 AS y FROM (SELECT unnest(range(0, 64)) AS i)))),
v AS (SELECT p, type, unnest(q) AS o, unnest(range(len(q))) AS i, len(q) AS n, tx, ty, a, b FROM (SELECT *, {_POSITIONS} AS q FROM xy JOIN addr ON h = h2)),
g AS (SELECT p, i, n, (tx + (a + o[1]) / 4096.0::DOUBLE) / 8 * 360 - 180 AS lon, {_Y.format(v='b + o[2]')} AS lat FROM v),
s AS (SELECT p, 2 * count(*)::BIGINT AS numbers, round(max(CASE WHEN i = 0 THEN lon END), 7) AS lon, round(max(CASE WHEN i = 0 THEN lat END), 7) AS lat,
  round(max(CASE WHEN i = n - 1 THEN lat END), 7) AS last_lat, round(sum(lon), 6) AS sum_lon, round(sum(lat), 6) AS sum_lat FROM g GROUP BY 1)
SELECT f.p, CASE WHEN type > 0 THEN ['MultiPoint', 'MultiLineString', 'MultiPolygon'][type] END AS shape, coalesce(numbers, 0) AS numbers, lon, lat, last_lat, sum_lon, sum_lat
FROM t_features f LEFT JOIN s ON f.p = s.p""", "t_features")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").selectExpr("event_id AS request_id", "0L AS archive_id", "21 + event_id % 64 AS tile_id",
                                                 "event_id * 7919 % 4096 / 4096.0D AS fx", "event_id * 104729 % 4096 / 4096.0D AS fy")


def hit_test(spark: SparkSession, d: str) -> DataFrame:
    """Features at every point, best first."""
    hits = V.hit_test(_points(spark, d), features(spark, d), ["archive_id", "tile_id"], 0.01)
    return hits.select("request_id", F.col("rank").cast("bigint").alias("rank"), "layer_index", "feature_index", "type", F.round("distance", 6).alias("distance"), "area")


def _box(grow: str) -> str:
    """Distance to the outline of the square [a + g, a + w - g] x [b + g, b + w - g]."""
    g = grow
    edges = [("a + {g}", "b + {g}", "a + w - {g}", "b + {g}"), ("a + {g}", "b + w - {g}", "a + w - {g}", "b + w - {g}"),
             ("a + {g}", "b + {g}", "a + {g}", "b + w - {g}"), ("a + w - {g}", "b + {g}", "a + w - {g}", "b + w - {g}")]
    parts = [f"sqrt(pow(greatest({x0} - px, 0, px - ({x1})), 2) + pow(greatest({y0} - py, 0, py - ({y1})), 2))"
             for x0, y0, x1, y1 in ([v.format(g=g) for v in e] for e in edges)]
    return f"least({', '.join(parts)})"


_HITS = f"""
, pts AS (SELECT event_id AS request_id, 21 + event_id % 64 AS tile_id, (event_id * 7919 % 4096)::DOUBLE AS px, (event_id * 104729 % 4096)::DOUBLE AS py FROM events),
pairs AS (SELECT request_id, f.*, CASE WHEN type IN (0, 1) AND p % 3 = 0 THEN sqrt(pow(a - px, 2) + pow(b - py, 2))
    WHEN type = 2 THEN least(sqrt(pow(greatest(a - px, 0, px - a - w), 2) + pow(b - py, 2)), sqrt(pow(a + w - px, 2) + pow(greatest(b - py, 0, py - b - w), 2)))
    WHEN type = 3 THEN CASE WHEN px >= a AND px < a + w AND py >= b AND py < b + w
        AND NOT (hole AND px >= a + 2 AND px < a + w - 2 AND py >= b + 2 AND py < b + w - 2) THEN 0
      WHEN hole THEN least({_box('0')}, {_box('2')}) ELSE {_box('0')} END
    ELSE least(sqrt(pow(a - px, 2) + pow(b - py, 2)), CASE WHEN p % 3 > 0 THEN least(sqrt(pow(a + w - px, 2) + pow(b - py, 2)), sqrt(pow(a + w - px, 2) + pow(b + w - py, 2))) END,
      CASE WHEN p % 3 = 2 THEN sqrt(pow(a - px, 2) + pow(b + w - py, 2)) END,
      CASE WHEN hole THEN least(sqrt(pow(a + 2 - px, 2) + pow(b + 2 - py, 2)), sqrt(pow(a + 2 - px, 2) + pow(b + w - 2 - py, 2)),
        sqrt(pow(a + w - 2 - px, 2) + pow(b + w - 2 - py, 2)), sqrt(pow(a + w - 2 - px, 2) + pow(b + 2 - py, 2))) END) END AS distance,
    CASE WHEN type = 3 THEN w * w - CASE WHEN hole THEN (w - 4) * (w - 4) ELSE 0 END ELSE 0 END::DOUBLE AS area
  FROM pts JOIN t_features f ON pts.tile_id = f.tile_id AND px BETWEEN a - 41 AND a + w + 41 AND py BETWEEN b - 41 AND b + w + 41),
near AS (SELECT *, bool_or(type = 3 AND distance = 0) OVER (PARTITION BY request_id) AS inside FROM pairs WHERE distance <= 40.96),
hits AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN type IN (1, 2) THEN type ELSE 3 END, distance, area, layer_index, p) AS rank
  FROM near WHERE NOT (inside AND type = 3 AND distance > 0))
"""

HIT_TEST_SQL = T.with_tables(_HITS + "SELECT request_id, rank, layer_index, p AS feature_index, type, round(distance, 6) AS distance, area FROM hits", "t_features")


def click_hits(spark: SparkSession, d: str) -> DataFrame:
    """Clicks on the map to features: place -> tile -> the run that answers it -> best feature. Each different place goes this way once;
    the clicks on it are joined to its answer."""
    clicked, spot = _points(spark, d), ["archive_id", "tile_id", "fx", "fy"]
    p = A.with_tile_address(clicked.select(*spot).distinct().withColumn("request_id", F.struct(*spot)))
    place = M.point_in_tile("z", "x", "y", "fx", "fy")
    clicks = p.select("request_id", "archive_id", "tile_id", place.alias("c")).select("request_id", "archive_id", F.lit(3).alias("z"), "c.*")
    at = clicks.select("request_id", "archive_id", M.lonlat_to_tile("lon", "lat", "z").alias("t")).select("request_id", "archive_id", "t.*")
    at = cut_lineage(at, "clicks")  # read three times below
    at = at.select("request_id", "archive_id", A.tile_id("z", "x", "y").alias("tile_id"), F.round("fx", 9).alias("fx"), F.round("fy", 9).alias("fy"))
    runs = T.entries(spark, d).selectExpr("archive_id", "tile_id AS run_start", "tile_id + run_length AS run_end")
    found = L.hit_join(at, runs, target="tile_id").select(*at.columns)
    hits = V.hit_test(found, features(spark, d), ["archive_id", "tile_id"], 0.01)
    best = hits.filter("rank = 1").select("request_id", "feature_index", F.round("distance", 4).alias("distance"))
    done = found.select("request_id", F.col("tile_id").alias("found")).join(best, "request_id", "left")
    done = done.select(*[F.col(f"request_id.{c}").alias(c) for c in spot], "found", "feature_index", "distance")
    return clicked.join(done, spot).select("request_id", F.col("found").alias("tile_id"), "feature_index", "distance")


CLICK_SQL = T.with_tables(_HITS + """
SELECT pts.request_id, pts.tile_id, h.p AS feature_index, round(h.distance, 4) AS distance FROM pts JOIN t_tiles t ON t.archive_id = 0 AND t.tile_id = pts.tile_id
LEFT JOIN hits h ON pts.request_id = h.request_id AND h.rank = 1""", "t_features", "t_tiles")

QUERIES = {
    "geometry_stats": (geometry_stats, GEOMETRY_SQL),
    "geometry_issues": (geometry_issues, GEOMETRY_ISSUES_SQL),
    "command_histogram": (command_histogram, HISTOGRAM_SQL),
    "layer_issues": (layer_issues, LAYER_ISSUES_SQL),
    "feature_rules": (feature_rules, RULES_SQL),
    "feature_properties": (feature_properties, PROPERTIES_SQL),
    "value_types": (value_types, VALUE_TYPES_SQL),
    "flatten_tiles": (flatten_tiles, FLATTEN_SQL),
    "layer_byte_share": (layer_byte_share, BYTE_SHARE_SQL),
    "dictionary_use": (dictionary_use, DICTIONARY_SQL),
    "tile_summary": (tile_summary, TILE_SUMMARY_SQL),
    "feature_geojson": (feature_geojson, GEOJSON_SQL),
    "hit_test": (hit_test, HIT_TEST_SQL),
    "click_hits": (click_hits, CLICK_SQL),
}

"""Vector-tile features as tables: flattening, rules, sizes, dictionaries and hit tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.functions import geometry as G
from tesserix.functions.common import lng
from tesserix.session import cut_lineage

DEFAULT_EXTENT = 4096
#: Fields of a stored value, in field order (fixed values).
VALUE_FIELDS = ["string", "float", "double", "int", "uint", "sint", "bool"]


def decode_vector_tiles(tiles: DataFrame, descriptor_file: str, payload: str = "payload", message: str = "Tile") -> DataFrame:
    """Add ``tile``: the payload as nested layers and features, NULL where it cannot be read.

    Uses Spark's protobuf functions, which need the spark-protobuf package and a compiled descriptor of the tile schema.
    """
    from pyspark.sql.protobuf.functions import from_protobuf

    return tiles.withColumn("tile", from_protobuf(payload, message, descFilePath=descriptor_file, options={"mode": "PERMISSIVE"}))


def flatten_layers(tiles: DataFrame, keys: list[str], layers: str = "layers") -> DataFrame:
    """One row per layer with its position. A tile that broke off keeps the layers read before."""
    rows = tiles.select(*keys, F.posexplode(layers).alias("layer_index", "_l"))
    return rows.select(*keys, "layer_index", "_l.*")


def flatten_features(layer_rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per feature with its layer's position, name and extent."""
    rows = layer_rows.select(*keys, "layer_index", F.col("name").alias("layer"), F.coalesce("extent", F.lit(DEFAULT_EXTENT)).alias("extent"),
                             F.posexplode("features").alias("feature_index", "_f"))
    return rows.select(*keys, "layer_index", "layer", "extent", "feature_index", "_f.*")


def tile_errors(tiles: DataFrame, keys: list[str], layers: str = "layers") -> DataFrame:
    """Tiles that could not be read to the end, with how many layers came out."""
    return tiles.filter("error IS NOT NULL").select(*keys, "error", F.when(F.col(layers).isNull(), 0).otherwise(F.size(layers)).alias("layers_read"))


def layer_issues(layer_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Layer rules: a name, version 2, an extent, and no name twice in a tile."""
    # Layers of one tile only; a tile is one stored value.
    again = F.row_number().over(Window.partitionBy(*keys, F.coalesce("name", F.lit(""))).orderBy("layer_index")) > 1
    found = F.array_compact(F.array(
        F.when(F.col("name").isNull(), "no-name"), F.when(F.coalesce("version", F.lit(1)) != 2, "version"),
        F.when(F.col("extent").isNull(), "no-extent"), F.when(F.col("_again"), "duplicate-name")))
    return layer_rows.withColumn("_again", again).select(*keys, "layer_index", F.explode(found).alias("issue"))


def tag_issues(tags: Column, n_keys: Column, n_values: Column) -> Column:
    """ARRAY<STRUCT(issue, i)>: odd count, key index or value index out of range."""
    pairs = F.size(tags) - F.size(tags) % 2
    checked = F.transform(tags, lambda v, i: F.when(i < pairs, F.when((i % 2 == 0) & (v >= n_keys), F.struct(
        F.lit("key-range").alias("issue"), i.alias("i"))).when((i % 2 == 1) & (v >= n_values), F.struct(F.lit("value-range").alias("issue"), i.alias("i")))))
    odd = F.array(F.when(F.size(tags) % 2 != 0, F.struct(F.lit("odd-count").alias("issue"), F.lit(-1).alias("i"))))
    return F.filter(F.concat(odd, checked), lambda v: v.isNotNull())


def feature_issues(type_: Column, geometry: Column) -> Column:
    """ARRAY<STRING>: unknown or undefined geometry type, empty geometry."""
    return F.array_compact(F.array(F.when(type_ == 0, "unknown-type").when(~type_.between(0, 3), "undefined-type"),
                                   F.when(F.coalesce(F.size(geometry), F.lit(0)) <= 0, "empty-geometry")))


def value_type(value: Column) -> Column:
    """Type of a stored value; with several fields set the last in field order counts, with none it is unknown."""
    out = F.lit("unknown")
    for name in VALUE_FIELDS:
        out = F.when(value[name].isNotNull(), name).otherwise(out)
    return out


def value_text(value: Column) -> Column:
    """The value as text, whatever its type."""
    out = F.lit(None).cast("string")
    for name in VALUE_FIELDS:
        out = F.when(value[name].isNotNull(), value[name].cast("string")).otherwise(out)
    return out


def is_single_value(value: Column) -> Column:
    """Exactly one field must be set."""
    return sum((value[name].isNotNull().cast("int") for name in VALUE_FIELDS[1:]), value["string"].isNotNull().cast("int")) == 1


def properties(tags: Column, keys: Column, values: Column) -> Column:
    """ARRAY<STRUCT(key_index, value_index, key, value)>; an index out of range gives NULL. Stays in the row."""
    pairs = F.floor(F.size(tags) / 2).cast("int")
    steps = F.when(pairs > 0, F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.struct(
        F.get(tags, i * 2).alias("key_index"), F.get(tags, i * 2 + 1).alias("value_index"),
        F.get(keys, F.get(tags, i * 2).cast("int")).alias("key"), F.get(values, F.get(tags, i * 2 + 1).cast("int")).alias("value")))


def dictionary_use(features: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """How often each key of a layer is used, and with how many distinct values.

    Keys and values are looked up after counting: tag pairs are combined first, so the layer's dictionary joins one row
    per distinct pair.
    """
    steps = F.expr("filter(transform(tags, (v, i) -> if(i % 2 = 0 AND i + 1 < size(tags), struct(v AS k, tags[i + 1] AS v), NULL)), p -> p IS NOT NULL)")
    pairs = features.select(*keys, F.explode(steps).alias("p")).groupBy(*keys, "p.k", "p.v").agg(F.count(F.lit(1)).alias("n"))
    named = pairs.join(layers.select(*keys, F.col("keys").alias("_k")), keys).withColumn("key", F.get("_k", F.col("k").cast("int")))
    return named.groupBy(*keys, "k", "key").agg(F.sum("n").alias("uses"), F.count(F.lit(1)).alias("distinct_values"))


def layer_byte_share(features: DataFrame, layers: DataFrame) -> DataFrame:
    """Bytes by kind per archive, zoom and layer with all subtotals, and the share of geometry."""
    f = features.groupBy("archive_id", "z", "layer").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("feature_bytes"),
                                                         F.sum("geometry_bytes").alias("g"), F.sum("tags_bytes").alias("t"))
    per_layer = layers.groupBy("archive_id", "z", "layer").agg(F.sum("key_bytes").alias("k"), F.sum("value_bytes").alias("v"))
    both = f.join(per_layer, ["archive_id", "z", "layer"], "full_outer")
    total = both.cube("archive_id", "z", "layer").agg(
        F.grouping_id().alias("level"), F.coalesce(F.sum("n"), lng(0)).alias("features"),
        F.coalesce(F.sum("feature_bytes"), lng(0)).alias("feature_bytes"), F.coalesce(F.sum("g"), lng(0)).alias("geometry_bytes"),
        F.coalesce(F.sum("t"), lng(0)).alias("tags_bytes"), F.coalesce(F.sum("k"), lng(0)).alias("key_bytes"), F.coalesce(F.sum("v"), lng(0)).alias("value_bytes"))
    whole = F.col("feature_bytes") + F.col("key_bytes") + F.col("value_bytes")
    return total.withColumn("geometry_share", F.col("geometry_bytes") / F.nullif(whole, lng(0)))


def tile_summary(features: DataFrame, keys: list[str]) -> DataFrame:
    """Layers and features of each tile, and the layer with the most features (the first one on a tie)."""
    per = features.groupBy(*keys, "layer_index").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_layers"), F.sum("n").alias("n_features"),
                                  F.max_by("layer_index", F.struct(F.col("n"), -F.col("layer_index"))).alias("largest_layer"))


def with_geometry(features: DataFrame) -> DataFrame:
    """Add ``commands``, ``parts``, ``issues``, ``bbox`` and ``area``. Store the result when several steps use it."""
    df = features.withColumn("_g", G.decode_geometry("geometry", "type"))
    df = df.withColumns({"commands": F.col("_g.commands"), "parts": F.col("_g.parts"), "issues": F.col("_g.issues")}).drop("_g")
    return df.withColumns({"bbox": G.bbox("parts"), "area": F.when(F.col("type") == G.POLYGON, G.polygon_area("parts")).otherwise(F.lit(0.0))})


_FINEST = 8


def hit_test(points: DataFrame, features: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Features at each point, best first: (request_id, rank, layer_index, feature_index, type, distance, area).

    ``points`` carry (request_id, keys, fx, fy) as fractions of the tile, ``features`` the result of ``with_geometry``
    plus ``extent``. Equal points ask once: their hits are found and ranked per place, and joined to the points that lie there last. The
    boxes of features are filed under the one to four cells of a grid that fits them, points probe one cell
    per grid size that their tile uses, so a crowded tile is split into cells; geometry only meets the pairs that are near. Inside any polygon, other
    polygons that are merely near are dropped. Points rank before lines before the rest, then distance, then area.
    """
    e = F.col("extent")

    def cell(fraction: Column, level: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1), level)
        return F.least(F.greatest(F.floor(fraction * side), lng(0)), (side - 1).cast("bigint")).cast("int")

    edges = features.filter("bbox IS NOT NULL").withColumns({
        "_x0": F.col("bbox.min_x") / e - tolerance, "_x1": F.col("bbox.max_x") / e + tolerance,
        "_y0": F.col("bbox.min_y") / e - tolerance, "_y1": F.col("bbox.max_y") / e + tolerance})
    edges = edges.filter("_x1 >= 0 AND _y1 >= 0 AND _x0 <= 1 AND _y0 <= 1")
    level = F.lit(0)
    for n in range(1, _FINEST + 1):
        ln = F.lit(n)
        fits = (cell(F.col("_x1"), ln) - cell(F.col("_x0"), ln) <= 1) & (cell(F.col("_y1"), ln) - cell(F.col("_y0"), ln) <= 1)
        level = F.when(fits, ln).otherwise(level)
    filed = edges.withColumn("_level", level)
    for axis in ("x", "y"):
        lo, hi = cell(F.col(f"_{axis}0"), F.col("_level")), cell(F.col(f"_{axis}1"), F.col("_level"))
        filed = filed.withColumn(f"_c{axis}", F.explode(F.sequence(lo, hi)))
    filed = filed.select(*keys, "_level", "_cx", "_cy", "_x0", "_x1", "_y0", "_y1", "layer_index", "feature_index")
    used = filed.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))  # at most nine numbers per tile
    place = [*keys, "fx", "fy"]
    probes = points.select(*place).distinct().join(used, keys).withColumn("_level", F.explode("_levels")).drop("_levels")
    probes = probes.withColumns({"_cx": cell(F.col("fx"), F.col("_level")), "_cy": cell(F.col("fy"), F.col("_level"))})
    near = probes.join(filed, [*keys, "_level", "_cx", "_cy"]).filter("fx >= _x0 AND fx <= _x1 AND fy >= _y0 AND fy <= _y1")
    near = near.select(*place, "layer_index", "feature_index").join(
        features.select(*keys, "layer_index", "feature_index", "type", "extent", "parts", "area"), [*keys, "layer_index", "feature_index"])
    near = near.withColumns({"_px": F.col("fx") * e, "_py": F.col("fy") * e})
    hits = near.withColumn("distance", G.distance_to("parts", "type", "_px", "_py")).filter(F.col("distance") <= F.lit(tolerance) * e)
    hits = hits.select(*place, "layer_index", "feature_index", "type", "distance", "area")
    polygon = F.col("type") == G.POLYGON
    inside = F.max(polygon & (F.col("distance") == 0)).over(Window.partitionBy(*place))
    kept = hits.withColumn("_inside", inside).filter(~F.col("_inside") | ~polygon | (F.col("distance") == 0)).drop("_inside")
    # Types other than point and line rank last, unknown ones included.
    order = Window.partitionBy(*place).orderBy(F.when(F.col("type").isin(1, 2), F.col("type")).otherwise(3), "distance", "area",
                                                "layer_index", "feature_index")
    ranked = cut_lineage(kept.withColumn("rank", F.row_number().over(order)), "hits")  # with its real size the join below is planned
    return points.select("request_id", *place).join(ranked, place).drop(*place)

"""Vector-tile geometry: integer command streams to points, rings and areas, and distances to them.

All in-row array work. Steps that other steps read more than once are bound with ``let``, so each is computed once, and
folds that gather rows go block by block: a step appends to a short list, and only whole blocks are appended to the long one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserix.functions.common import ColumnOrName, col, let, lng

# Command and geometry type codes.
MOVE, LINE, CLOSE = 1, 2, 7
POINT, LINESTRING, POLYGON = 1, 2, 3
_BLOCK = 64

_CMD = "struct<id:int,count:bigint,at:int,starts:boolean,part:int,ok:boolean>"
_XY = "struct<x:bigint,y:bigint>"


def zigzag(v: Column) -> Column:
    """Unsigned integer -> signed difference: 0, -1, 1, -2, ..."""
    return F.shiftright(v, 1).bitwiseXOR(-(v.bitwiseAND(1)))


def _upto(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))


def _read_commands(ints: Column) -> Column:
    """STRUCT(cmds, issues): the commands in order, up to the first one that cannot be read."""
    n = F.size(ints)
    cmds, issues = f"array<{_CMD}>", "array<string>"

    def step(a: Column, _: Column) -> Column:
        def command(ci: Column) -> Column:
            id_, count = ci.bitwiseAND(7).cast("int"), F.shiftright(ci, 3).cast("bigint")
            move, line, close = id_ == MOVE, id_ == LINE, id_ == CLOSE
            draws = move | line
            short = draws & (a["pos"] + 1 + count * 2 > n)
            starts = line & ~a["open"]
            adds = F.when(draws & ~short & (count > 0), F.when(move, count).otherwise(F.when(starts, 1).otherwise(0))).otherwise(0)
            found = F.filter(F.array(
                F.when(draws & (count == 0), "count-zero"), F.when(short, "missing-parameters"),
                F.when(starts & ~short & (count > 0), "line-before-move"), F.when(close & (count != 1), "close-count"),
                F.when(close & ~a["open"], "close-before-move"), F.when(~draws & ~close, "unknown-command")), lambda i: i.isNotNull())
            part = F.when(close & a["open"], a["parts"] - 1)
            cmd = F.struct(id_.alias("id"), count.alias("count"), a["pos"].alias("at"), starts.alias("starts"), part.alias("part"),
                           (draws & ~short & (count > 0)).alias("ok")).cast(_CMD)
            return F.struct(
                (a["pos"] + 1 + F.when(draws, count * 2).otherwise(0)).cast("int").alias("pos"), (short | (~draws & ~close)).alias("done"),
                (a["open"] | (adds > 0)).alias("open"), (a["parts"] + adds).cast("int").alias("parts"),
                F.concat(a["cmds"], F.array(cmd)).alias("cmds"), F.concat(a["issues"], found).alias("issues"))

        return F.when(a["done"] | (a["pos"] >= n), a).otherwise(let(F.get(ints, a["pos"]), command))

    def state(a: Column | None, c: Column, i: Column) -> Column:
        values = [F.lit(0), F.lit(False), F.lit(False), F.lit(0)] if a is None else [a[k] for k in ("pos", "done", "open", "parts")]
        return F.struct(*[v.alias(k) for v, k in zip(values, ("pos", "done", "open", "parts"))], c.alias("cmds"), i.alias("issues"))

    def block(a: Column, _: Column) -> Column:
        fresh = state(a, F.array().cast(cmds), F.array().cast(issues))
        read = F.aggregate(F.sequence(F.lit(1), F.lit(_BLOCK)), fresh, step)
        more = let(read, lambda r: state(r, F.concat(a["cmds"], F.array(r["cmds"])), F.concat(a["issues"], F.array(r["issues"]))))
        return F.when(a["done"] | (a["pos"] >= n), a).otherwise(more)

    start = state(None, F.array().cast(f"array<{cmds}>"), F.array().cast(f"array<{issues}>"))
    blocks = F.sequence(F.lit(1), F.greatest(F.ceil(n / F.lit(_BLOCK)).cast("int"), F.lit(1)))
    return let(F.aggregate(blocks, start, block), lambda r: F.struct(F.flatten(r["cmds"]).alias("cmds"), F.flatten(r["issues"]).alias("issues")))


def _deltas(ints: Column, cmds: Column) -> Column:
    """ARRAY<STRUCT(dx, dy, start)> of every drawn point."""

    def points(c: Column) -> Column:
        def one(k: Column) -> Column:
            at = c["at"] + 1 + k * 2
            return F.struct(zigzag(F.get(ints, at)).alias("x"), zigzag(F.get(ints, at + 1)).alias("y"),
                            ((c["id"] == MOVE) | (c["starts"] & (k == 0))).alias("start"))

        return F.transform(_upto(c["count"]), one)

    return F.flatten(F.transform(F.filter(cmds, lambda c: c["ok"]), points))


def _running_sums(values: Column) -> Column:
    """ARRAY<BIGINT> of inclusive running sums: blocks on their own, then shifted by the sum of the blocks before."""
    def grow(a: Column, last: Column) -> Column:
        return F.struct(last.alias("last"), F.concat(a["out"], F.array(last)).alias("out"))

    none = F.struct(lng(0).alias("last"), F.array().cast("array<bigint>").alias("out"))

    def shift(blocks: Column) -> Column:
        ends = F.aggregate(blocks, none, lambda a, b: grow(a, a["last"] + b["last"]))["out"]
        return F.flatten(F.zip_with(blocks, ends, lambda b, e: F.transform(b["out"], lambda v: v + e - b["last"])))

    n_blocks = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    return let(F.transform(_upto(n_blocks), lambda k: F.aggregate(
        F.slice(values, k * _BLOCK + 1, F.lit(_BLOCK)), none, lambda a, v: grow(a, a["last"] + v))), shift)


def _absolute(deltas: Column) -> Column:
    """Points from differences."""
    x = let(F.transform(deltas, lambda d: lng(d["x"])), _running_sums)
    y = let(F.transform(deltas, lambda d: lng(d["y"])), _running_sums)
    return F.zip_with(x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))


def ring_area(points: Column) -> Column:
    """Signed area by the surveyor's formula, closing edge included; positive = clockwise on screen."""
    following = F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    twice = F.zip_with(points, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(twice, lng(0), lambda s, v: s + v) / F.lit(2.0)


def _flags(places: Column) -> Column:
    """ARRAY<BOOLEAN> that is true at the given ascending places and ends with the last of them."""
    gap = lambda p, i: p - F.when(i == 0, -1).otherwise(F.get(places, i - 1)) - 1
    return F.flatten(F.transform(places, lambda p, i: F.concat(F.array_repeat(F.lit(False), gap(p, i).cast("int")), F.array(F.lit(True)))))


def _parts(deltas: Column, cmds: Column, type_: Column) -> Column:
    def cut(points: Column) -> Column:
        starts = F.filter(F.transform(deltas, lambda d, i: F.when(d["start"], i)), lambda i: i.isNotNull())
        closed = F.array_distinct(F.transform(F.filter(cmds, lambda c: c["part"].isNotNull()), lambda c: c["part"]))

        def build(s: Column, is_closed: Column) -> Column:
            def one(begin: Column, j: Column) -> Column:
                end = F.coalesce(F.get(s, j + 1), F.size(points))
                piece = F.slice(points, begin + 1, end - begin)
                return let(piece, lambda p: F.struct(p.alias("points"), F.coalesce(F.get(is_closed, j), F.lit(False)).alias("closed"),
                                                     F.when(type_ == POLYGON, ring_area(p)).alias("area")))

            return F.transform(s, one)

        return let(starts, lambda s: let(let(closed, _flags), lambda c: build(s, c)))

    def label(parts: Column) -> Column:
        """Role from the sign of the area; a polygon is an exterior ring and the interior rings after it."""
        exteriors = let(F.transform(parts, lambda p: lng(F.when(p["area"] > 0, 1).otherwise(0))), _running_sums)

        def one(p: Column, n: Column) -> Column:
            role = F.when(p["area"] > 0, "exterior").when(p["area"] < 0, "interior")
            return F.struct(p["points"].alias("points"), p["closed"].alias("closed"), p["area"].alias("area"), role.alias("role"),
                            F.when(role.isNotNull() & (n > 0), n - 1).cast("int").alias("polygon"))

        return F.zip_with(parts, exteriors, one)

    return let(let(_absolute(deltas), cut), label)


def _order_issues(cmds: Column, type_: Column) -> Column:
    """Name of the broken order rule of the geometry type, or NULL."""
    n = F.size(cmds)

    def line(c: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, (c["id"] != MOVE) | (c["count"] != 1) | (i + 1 >= n)).otherwise(c["id"] != LINE)

    def ring(c: Column, i: Column) -> Column:
        return (F.when(i % 3 == 0, (c["id"] != MOVE) | (c["count"] != 1) | (i + 2 >= n))
                .when(i % 3 == 1, (c["id"] != LINE) | (c["count"] < 2)).otherwise(c["id"] != CLOSE))

    def broken(rule: Callable[[Column, Column], Column]) -> Column:
        return F.exists(F.transform(cmds, rule), lambda b: b)

    return (F.when((type_ == POINT) & ((n != 1) | (F.coalesce(F.get(cmds, F.lit(0))["id"], F.lit(0)) != MOVE)), "point-order")
            .when((type_ == LINESTRING) & broken(line), "line-order").when((type_ == POLYGON) & broken(ring), "polygon-order"))


def decode_geometry(ints: ColumnOrName, type_: ColumnOrName) -> Column:
    """STRUCT(commands, parts, issues) of a command stream.

    Each MoveTo point starts a part; the cursor carries over from part to part. Reading stops at an unknown command or
    missing parameters and keeps what was read. Parts of polygons also get their area, role and polygon number.
    """

    def with_commands(v: Column, c: Column) -> Column:
        cmds, type_col = c["cmds"], v["type"]

        def with_parts(parts: Column) -> Column:
            polygon = type_col == POLYGON
            flat = F.when(polygon, F.filter(F.transform(parts, lambda p: F.when(p["area"] == 0, "zero-area").when(
                (p["role"] == "interior") & p["polygon"].isNull(), "interior-before-exterior")), lambda i: i.isNotNull())).otherwise(
                F.array().cast("array<string>"))
            order = F.filter(F.array(_order_issues(cmds, type_col)), lambda i: i.isNotNull())
            return F.struct(F.transform(cmds, lambda m: F.struct(m["id"].alias("id"), m["count"].alias("count"), m["at"].alias("at"))).alias("commands"),
                            parts.alias("parts"), F.concat(c["issues"], order, flat).alias("issues"))

        return let(let(_deltas(v["ints"], cmds), lambda d: _parts(d, cmds, type_col)), with_parts)

    inputs = F.struct(F.coalesce(col(ints), F.array()).cast("array<bigint>").alias("ints"), col(type_).cast("int").alias("type"))
    return let(inputs, lambda v: let(_read_commands(v["ints"]), lambda c: with_commands(v, c)))


# ---- measures over decoded parts: pass a stored column ---------------------------------------------------------

def bbox(parts: ColumnOrName) -> Column:
    """STRUCT(min_x, min_y, max_x, max_y); NULL without points."""

    def build(p: Column) -> Column:
        xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
        return F.when(F.size(p) > 0, F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
                                              F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")))

    return let(F.flatten(F.transform(col(parts), lambda p: p["points"])), build)


def vertex_count(parts: ColumnOrName) -> Column:
    return F.aggregate(col(parts), F.lit(0), lambda a, p: a + F.size(p["points"]))


def polygon_area(parts: ColumnOrName) -> Column:
    """Signed area of all rings; holes subtract."""
    return F.aggregate(col(parts), F.lit(0.0), lambda a, p: a + F.coalesce(p["area"], F.lit(0.0)))


def in_ring(points: Column, px: Column, py: Column) -> Column:
    """Even-odd test."""
    before = F.concat(F.slice(points, F.size(points), F.lit(1)), F.slice(points, F.lit(1), F.size(points) - 1))

    def crosses(a: Column, b: Column) -> Column:
        x = (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], lng(0)) + a["x"]
        return F.coalesce(((a["y"] > py) != (b["y"] > py)) & (px < x), F.lit(False))

    return F.aggregate(F.zip_with(points, before, crosses), F.lit(False), lambda inside, c: inside != c)


def segment_distance(a: Column, b: Column, px: Column, py: Column) -> Column:
    dx, dy = (b["x"] - a["x"]).cast("double"), (b["y"] - a["y"]).cast("double")
    t = F.coalesce(((px - a["x"]) * dx + (py - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(a["x"] + t * dx - px, a["y"] + t * dy - py)


def path_distance(points: Column, px: Column, py: Column, closed: bool) -> Column:
    """Distance to the nearest edge; ``closed`` adds the edge from the last point back to the first."""
    n = F.size(points)
    rest = F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0)))
    ends = F.concat(rest, F.slice(points, 1, 1)) if closed else rest
    starts = points if closed else F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0)))
    edges = F.zip_with(starts, ends, lambda a, b: segment_distance(a, b, px, py))
    only = F.get(points, F.lit(0))
    return F.when(n == 1, F.hypot(only["x"] - px, only["y"] - py)).otherwise(F.array_min(edges))


def distance_to(parts: ColumnOrName, type_: ColumnOrName, px: ColumnOrName, py: ColumnOrName) -> Column:
    """Distance from (px, py) in tile units; 0 inside a polygon and outside its holes. NULL without parts."""
    p, t, x, y = col(parts), col(type_), col(px).cast("double"), col(py).cast("double")

    def polygon() -> Column:
        flags = F.transform(F.filter(p, lambda r: r["polygon"].isNotNull()), lambda r: F.struct(
            r["polygon"].alias("polygon"), (r["role"] == "exterior").alias("outer"), in_ring(r["points"], x, y).alias("inside")))

        def covered(f: Column) -> Column:
            def holed(e: Column) -> Column:
                return F.exists(f, lambda h: ~h["outer"] & h["inside"] & (h["polygon"] == e["polygon"]))

            return F.exists(f, lambda e: e["outer"] & e["inside"] & ~holed(e))

        near = F.array_min(F.transform(p, lambda r: path_distance(r["points"], x, y, True)))
        return F.when(let(flags, covered), F.lit(0.0)).otherwise(near)

    lines = F.array_min(F.transform(p, lambda r: path_distance(r["points"], x, y, False)))
    dots = F.array_min(F.flatten(F.transform(p, lambda r: F.transform(r["points"], lambda v: F.hypot(v["x"] - x, v["y"] - y)))))
    return F.when(t == POLYGON, polygon()).when(t == LINESTRING, lines).otherwise(dots)


def feature_geojson(parts: ColumnOrName, type_: ColumnOrName, z: ColumnOrName, x: ColumnOrName, y: ColumnOrName,
                    extent: ColumnOrName) -> Column:
    """GeoJSON feature in longitude/latitude with closed rings; NULL without parts, polygons or a known type."""
    from tesserix.functions.mercator import point_in_tile

    p, t, e = col(parts), col(type_), col(extent).cast("double")

    def place(v: Column) -> Column:
        return let(point_in_tile(z, x, y, v["x"] / e, v["y"] / e), lambda s: F.array(s["lon"], s["lat"]))

    def path(v: Column) -> Column:
        return F.transform(v["points"], place)

    def ring(v: Column) -> Column:
        return let(path(v), lambda r: F.concat(r, F.slice(r, 1, 1)))

    def out(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.create_map().alias("properties"),
                                  F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry")))

    n = F.coalesce(F.array_max(F.transform(p, lambda r: r["polygon"])), F.lit(-1)) + 1
    polygons = F.transform(_upto(n), lambda k: F.transform(F.filter(p, lambda r: r["polygon"] == k), ring))
    return F.when(F.size(p) > 0, F.when(t == POINT, out("MultiPoint", F.flatten(F.transform(p, path))))
                  .when(t == LINESTRING, out("MultiLineString", F.transform(p, path)))
                  .when((t == POLYGON) & (n > 0), out("MultiPolygon", polygons)))

"""Tile addresses: fixed examples, exhaustive and random properties."""

import random

from pyspark.sql import functions as F

from tesserix.functions import address as A
from tesserix.functions import mercator as M
from tesserix.operators.blocks import cover_boxes, range_blocks
from tesserix.session import cut_lineage


def test_known_ids_and_invalid_addresses(spark):
    good = {(0, 0, 0): 0, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 0, 0): 5, (12, 3423, 1763): 19078479}
    bad = [(27, 0, 0), (2, 4, 0), (2, -1, 0), (-1, 0, 0)]
    df = spark.createDataFrame([*good, *bad], "z int, x long, y long")
    got = {(r.z, r.x, r.y): r.t for r in df.withColumn("t", A.tile_id("z", "x", "y")).collect()}
    assert got == good | dict.fromkeys(bad)


def test_strict_mode_raises(spark):
    df = spark.createDataFrame([(2, 4, 0)], "z int, x long, y long")
    try:
        df.select(A.tile_id("z", "x", "y", strict=True).alias("t")).collect()
    except Exception as e:
        assert "not a tile address" in str(e)
    else:
        raise AssertionError("expected an error")


def test_curve_is_a_walk_over_every_tile(spark):
    """Ids 0.. cover each grid exactly once, and neighbours on the curve are neighbours on the map."""
    df = A.with_tile_address(spark.range((4 ** 8 - 1) // 3).withColumnRenamed("id", "tile_id"))
    rows = df.withColumn("back", A.tile_id("z", "x", "y")).orderBy("tile_id").collect()
    assert all(r.back == r.tile_id for r in rows)
    assert len({(r.z, r.x, r.y) for r in rows}) == len(rows)
    for a, b in zip(rows, rows[1:]):
        if a.z == b.z:
            assert abs(a.x - b.x) + abs(a.y - b.y) == 1


def test_random_tiles_up_to_the_deepest_zoom(spark):
    rnd = random.Random(1)
    tiles = [(z, rnd.randrange(2 ** z), rnd.randrange(2 ** z)) for z in range(10, 27) for _ in range(200)]
    tiles += [(26, 2 ** 26 - 1, 0), (26, 2 ** 26 - 1, 2 ** 26 - 1)]
    df = cut_lineage(spark.createDataFrame(tiles, "oz int, ox long, oy long").withColumn("tile_id", A.tile_id("oz", "ox", "oy")))
    bad = [r for r in A.with_tile_address(df).collect() if (r.z, r.x, r.y) != (r.oz, r.ox, r.oy)]
    assert not bad and df.filter("tile_id IS NULL").count() == 0


def test_aligned_blocks_are_id_ranges(spark):
    df = A.with_tile_address(spark.range(1, (4 ** 6 - 1) // 3).withColumnRenamed("id", "tile_id"))
    df = df.select("tile_id", "z", "x", "y", F.explode(F.sequence(F.lit(0), "z")).alias("k"))
    b = cut_lineage(A.with_aligned_block(cut_lineage(df)))
    assert b.filter("tile_id NOT BETWEEN first_tile_id AND last_tile_id").count() == 0
    whole = b.groupBy("z", "k", "first_tile_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("s"))
    assert whole.filter("n <> s * s").count() == 0


def _greedy(z, start, end):
    out, i, stop = [], max(0, start), min(end, 4 ** z)
    while i < stop:
        k = 0
        while k < z and i % 4 ** (k + 1) == 0 and i + 4 ** (k + 1) <= stop:
            k += 1
        out.append((k, i // 4 ** k))
        i += 4 ** k
    return out


def test_range_blocks_equal_the_greedy_rule(spark):
    rnd = random.Random(2)
    cases = [(4, 0, 256), (14, 12345, 9876543), (3, -5, 1000), (2, 5, 5), (0, 0, 1), (26, 3, 4 ** 26 - 3)]
    cases += [(z, *sorted((rnd.randrange(4 ** z + 1), rnd.randrange(4 ** z + 1)))) for z in range(1, 9) for _ in range(40)]
    df = spark.createDataFrame(cases, "z int, s long, e long").withColumn("c", A.range_block_cells("z", "s", "e"))
    for r in df.collect():
        assert sorted((c.k, c.m) for c in r.c) == sorted(_greedy(r.z, r.s, r.e))
        assert len(r.c) <= max(1, 6 * r.z)
    assert len([r for r in df.filter("z = 14").collect()][0].c) == 45


def test_range_across_zooms(spark):
    base = [(4 ** z - 1) // 3 for z in range(5)]
    df = spark.createDataFrame([(base[1] + 2, base[3] + 1)], "s long, e long")
    got = {}
    for r in range_blocks(df, "s", "e").collect():
        got.setdefault(r.block_z, []).append(r.size)
    assert {z: sorted(v) for z, v in got.items()} == {1: [1, 1], 2: [4], 3: [1]}


def test_mercator(spark):
    tiles = [(0, 0, 0), (3, 2, 5), (8, 200, 100), (14, 14552, 6451)]
    df = spark.createDataFrame(tiles, "z int, x long, y long").withColumn("c", M.tile_center("z", "x", "y"))
    for shift in (0, 360, -720):
        back = df.withColumn("t", M.lonlat_to_tile(F.col("c.lon") + shift, "c.lat", "z")).collect()
        assert all((r.t.x, r.t.y) == (r.x, r.y) and abs(r.t.fx - 0.5) < 1e-6 and abs(r.t.fy - 0.5) < 1e-6 for r in back)
    b = df.filter("z = 0").select(M.tile_bounds("z", "x", "y").alias("b")).first().b
    assert (b.west, b.east) == (-180, 180) and abs(b.north - 85.0511287798) < 1e-9 and abs(b.south + 85.0511287798) < 1e-9
    poles = spark.createDataFrame([(5, 0.0, 90.0), (5, 179.999999, -90.0)], "z int, lon double, lat double")
    assert [(r.t.x, r.t.y) for r in poles.select(M.lonlat_to_tile("lon", "lat", "z").alias("t")).collect()] == [(16, 0), (31, 31)]


def test_cover_across_the_antimeridian(spark):
    df = spark.createDataFrame([(2, 170.0, -10.0, -170.0, 10.0)], "z int, west double, south double, east double, north double")
    assert sorted((r.x, r.y, r.wrap) for r in cover_boxes(df).collect()) == [(0, 1, 1), (0, 2, 1), (3, 1, 0), (3, 2, 0)]

"""Scans, joins, directories, geometry: properties and fixed examples against plain Python."""

import random
import re
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tesserix.functions import geometry as G
from tesserix.functions import payload as P
from tesserix.functions.varint import decode_blobs, encode_varint, padded_varint_hex, varint_width
from tesserix.operators import blocks as B
from tesserix.operators import directory as D
from tesserix.operators import lookup as L
from tesserix.operators.features import hit_test, with_geometry
from tesserix.operators.ordered import exclusive_scan, floor_join, span_join
from tesserix.plans import q_archive, q_features
from tesserix.session import cut_lineage, drop_tables, recorded_tables


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_scan_equals_one_pass_for_any_cut(spark, batch):
    """Groups reach over partitions and over batches; keys may be null, values too."""
    rnd = random.Random(3)
    groups = [(None, "x"), (1, None), (1, "a"), (2, "a")]
    rows = [(*g, k, rnd.choice([None, rnd.randrange(-50, 100)]), rnd.choice([None, None, f"w{k}"])) for g in groups for k in sorted(rnd.sample(range(-250, 250), 40))]
    rows += [(9, "many", k, 1, None) for k in range(300)] + [(10, "one", 0, 5, "last")]
    df = spark.createDataFrame(rows, "g int, h string, k long, v long, w string").repartition(3)
    want, state = {}, {}
    for g, h, k, v, w in sorted(rows, key=lambda r: r[2]):
        total, high, low, last = state.get((g, h), (None,) * 4)
        want[g, h, k] = (total, high, low, last)
        if v is not None:
            total, high, low = (total or 0) + v, v if high is None else max(v, high), v if low is None else min(v, low)
        state[g, h] = (total, high, low, last if w is None else w)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for partitions in (1, 5, 60):
            out = exclusive_scan(df, ["g", "h"], "k", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v")),
                                                       "l": ("last", F.struct("w").getField("w"))}, partitions)
            assert {(r.g, r.h, r.k): (r.s, r.m, r.n, r.l) for r in out.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_floor_join_for_any_cut(spark):
    rnd = random.Random(4)
    keys = {g: sorted(rnd.sample(range(1000), 30)) for g in range(3)}
    right = spark.createDataFrame([(g, k, k * 2) for g, ks in keys.items() for k in ks] + [(None, 5, 0), (1, None, 0)], "g int, k long, v long")
    asked = [(g, t) for g in range(4) for t in range(0, 1000, 7)] * 2 + [(1, None)] * 50 + [(None, 7), (2, -3)] + [(0, 500)] * 200
    left = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "n int, g int, t long")
    for partitions in (1, 40):
        got = floor_join(left, right, ["g"], "t", "k", partitions=partitions).collect()
        assert sorted(r.n for r in got) == list(range(len(asked)))
        for r in got:
            ks = keys.get(r.g, []) if r.t is not None else []
            i = bisect_right(ks, r.t) - 1 if ks else -1
            assert (r.match.k if r.match else None) == (ks[i] if i >= 0 else None)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?:hash|range|Single)", plan)), len(re.findall(r"Scan parquet|FileScan", plan))


def test_as_of_join_moves_rows_once(spark, tmp_path):
    """What is left after the scan is stored: only the carry, a row or two per partition, is exchanged again."""
    left = spark.range(1000).selectExpr("id % 5 AS g", "id AS t")
    right = spark.range(100).selectExpr("id % 5 AS g", "id * 10 AS k")
    shuffles, scans = _exchanges(floor_join(left, right, ["g"], "t", "k"))
    assert shuffles <= 2 and scans <= 2


def test_a_popular_target_is_cut_over_partitions(spark):
    left = spark.range(20000).selectExpr("1 AS g", "77L AS t", "id AS n")
    right = spark.createDataFrame([(1, 70, "hit")], "g int, k long, v string")
    from tesserix.operators import ordered

    kept, cut = [], ordered.cut_lineage
    ordered.cut_lineage = lambda df, name: kept.append(cut(df, name)) or kept[-1]
    try:
        got = floor_join(left, right, ["g"], "t", "k", partitions=8)
    finally:
        ordered.cut_lineage = cut
    assert got.filter("match.v = 'hit'").count() == 20000
    parts = {r[0]: r[1] for r in kept[0].filter("_edge = 0").groupBy("_part").count().collect()}
    assert len(parts) == 8 and max(parts.values()) < 6000


def test_span_join(spark):
    spans = [(1, 0, 5), (1, 5, 7), (1, 9, 12), (2, 3, 4)]
    ranges = [(1, 4, 6), (1, 7, 9), (1, 8, 100), (2, 0, 3), (2, 3, 3), (1, 6, 7), (3, 0, 9)]
    a = spark.createDataFrame(ranges, "d int, rs long, re long")
    b = spark.createDataFrame(spans, "d int, ss long, se long")
    got = sorted((r.d, r.rs, r.re, r.ss) for r in span_join(a, b, ["d"], "ss", "se", "rs", "re", partitions=5).collect())
    assert got == sorted((d, s, e, x) for d, s, e in ranges for d2, x, y in spans if d == d2 and s < y and e > x and s < e)


def test_search_outcomes(spark):
    e = spark.createDataFrame([(1, t, 1) for t in (100000, 110000, 120000, 123000, 123450, 124000, 130000)]
                              + [(2, 10, 0), (2, 20, 3), (2, 30, 0)], "archive_id long, tile_id long, run_length long")
    asked = {(1, 123456): "outside-run", (1, 99999): "before-first", (1, 123000): "exact-tile", (2, 10): "exact-leaf", (2, 15): "leaf",
             (2, 22): "run-hit", (2, 23): "outside-run", (2, 999): "leaf"}
    r = spark.createDataFrame(list(asked), "archive_id long, target long")
    out = L.floor_entry(r, e).withColumn("o", L.search_outcome(F.col("target"), F.col("candidate.tile_id"), F.col("candidate.run_length")))
    assert {(x.archive_id, x.target): x.o for x in out.collect()} == asked


def test_hit_join_with_runs_of_any_length(spark):
    rnd = random.Random(5)
    runs, at = [], 0
    for _ in range(60):
        at += rnd.choice([0, 1, 5, 1000])
        n = rnd.choice([1, 2, 15, 16, 17, 300, 100000, 10 ** 9])
        runs.append((7, at, at + n))
        at += n
    targets = [t for _, s, e in runs for t in (s - 1, s, s + 1, (s + e) // 2, e - 1, e)]
    a = spark.createDataFrame([(7, t) for t in targets], "archive_id long, target long")
    b = spark.createDataFrame(runs, "archive_id long, run_start long, run_end long")
    want = sorted((t, s) for t in targets for _, s, e in runs if s <= t < e)
    assert sorted((r.target, r.run_start) for r in L.hit_join(a, b).collect()) == want
    missed = sorted(t for t in targets if not any(s <= t < e for _, s, e in runs))
    assert sorted(r.target for r in L.hit_join(a, b, "left_anti").collect()) == missed


def test_tree_depth_limit_and_flattening(spark):
    """A chain of five directories: the walk gives up after four, an empty leaf is an error."""
    rows = [(1, -1, 0, 5, 0, 10, 1), (1, -1, 1, 90, 0, 99, 1), (1, 10, 0, 5, 0, 11, 1), (1, 10, 1, 50, 4, 0, 1), (1, 11, 0, 5, 0, 12, 1), (1, 11, 1, 20, 100, 7, 1),
            (1, 12, 0, 5, 0, 13, 1)]
    tree = spark.createDataFrame(rows, "archive_id long, dir_id long, i long, tile_id long, run_length long, offset long, length long")
    arch = spark.createDataFrame([(1, 0, 9)], "archive_id long, min_zoom int, max_zoom int")
    req = spark.createDataFrame([(t, 1, 3, t) for t in (4, 5, 20, 49, 50, 53, 54, 95)], "request_id long, archive_id long, z int, target long")
    got = {r.target: r.status for r in L.lookup_tree(req, arch, tree).collect()}
    assert got == {4: "not-found", 5: "error", 20: "found", 49: "found", 50: "found", 53: "found", 54: "not-found", 95: "error"}
    runs = L.flatten_tree(tree)
    flat = sorted((r.run_start, min(r.run_end, 999), r.status) for r in runs.collect())
    assert flat == [(5, 20, "error"), (20, 50, "found"), (50, 54, "found"), (90, 999, "error")]
    assert {r.target: r.status for r in L.lookup_flattened(req, arch, runs).collect()} == got


def test_varint(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2 ** 32, 2 ** 53 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    from archive_files import varint
    for r in df.select("v", encode_varint("v").alias("b"), varint_width("v").alias("w")).collect():
        assert bytes(r.b) == varint(r.v) and r.w == len(varint(r.v))
    assert varint(300) == bytes([0xAC, 0x02])


ENTRIES = [(1000, 0, 250), (1003, 250, 10), (1004, 0, 250), (1012, 260, 5), (1013, 300, 5)]


def test_five_entry_directory(spark):
    blob = bytes.fromhex("05E80703010801010101010 1FA010AFA010505010001850 2AD02".replace(" ", ""))
    dec = D.decode_values(spark.createDataFrame([(1, blob)], "d int, blob binary"))
    got = D.decode_entries(dec, ["d"]).orderBy("i").collect()
    assert [(r.tile_id, r.offset, r.length) for r in got] == ENTRIES and [r.code for r in got] == [1, 0, 1, 261, 301]
    classes = D.offset_classes(D.decode_entries(dec, ["d"]), ["d"]).orderBy("i").collect()
    assert [r.offset_class for r in classes] == ["first", "contiguous", "backward", "resume", "forward"]
    back = D.encode_directories(D.decode_entries(dec, ["d"]).drop("delta", "code"), ["d"]).first()
    assert bytes(back.blob) == blob


def test_broken_directories(spark):
    rows = [(1, b"\x80\x80"), (2, bytes([1]) + bytes.fromhex("8180808080808010") + b"\x01\x01\x01"), (3, b""), (4, b"\x00"), (5, b"\x01\x05\x01\x00\x00")]
    dec = D.decode_values(spark.createDataFrame(rows, "d int, blob binary"))
    assert {r.d: r.error for r in dec.collect()} == {1: "truncated", 2: "too-large", 3: "truncated", 4: None, 5: None}
    issues = D.directory_issues(dec, D.decode_entries(dec, ["d"]), ["d"]).collect()
    assert sorted((r.d, r.issue) for r in issues) == [(4, "empty-directory"), (5, "first-offset-zero"), (5, "zero-length")]
    assert D.decode_entries(dec.filter("d = 5"), ["d"]).first().offset == -1


def test_collapse_for_any_bucket_size(spark):
    rnd = random.Random(6)
    tiles, tid = [], 0
    for _ in range(400):
        tid += rnd.choice([1, 1, 1, 1, 2])
        tiles.append((1, tid, rnd.choice("aaaaab")))
    want, prev = [], None
    for _, t, c in tiles:
        if prev and prev[0] + prev[1] == t and prev[2] == c:
            prev[1] += 1
        else:
            prev = [t, 1, c]
            want.append(prev)
    df = spark.createDataFrame(tiles, "archive_id long, tile_id long, content string")
    for bits in (3, 18):
        got = sorted([r.tile_id, r.run_length, r.content] for r in D.collapse_runs(df, bits=bits, key_bits=20).collect())
        assert got == want


def test_sniff_table(spark):
    cases = {"1F8B0800": "gzip", "28B52FFD": "zstd", "89504E470D0A1A0A": "png", "FFD8FFE0": "jpeg", b"RIFF\0\0\0\0WEBP".hex(): "webp",
             b"\0\0\0\x1cftypavif".hex(): "avif", "1A05": "mvt-like", b"tile 8/1/2".hex(): "text", "": "empty", "000102": "unknown", "C328": "unknown",
             b"a\tb\r\n".hex(): "text", b"a\x7f".hex(): "unknown"}
    df = spark.createDataFrame([(h, bytes.fromhex(h)) for h in cases], "h string, b binary")
    assert {r.h: r.k for r in df.select("h", P.sniff("b").alias("k")).collect()} == cases


def _decode(spark, cases):
    df = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(cases)], "i int, geometry array<bigint>, type int")
    return with_geometry(df).orderBy("i").collect()


def test_geometry_examples(spark):
    got = _decode(spark, [([9, 50, 34], 1), ([17, 10, 14, 3, 9], 1), ([9, 4, 4, 18, 0, 16, 16, 0], 2), ([9, 6, 12, 18, 10, 12, 24, 44, 15], 3)])
    points = [[[(p.x, p.y) for p in part.points] for part in r.parts] for r in got]
    assert points == [[[(25, 17)]], [[(5, 7)], [(3, 2)]], [[(2, 2), (2, 10), (10, 10)]], [[(3, 6), (8, 12), (20, 34)]]]
    assert got[3].parts[0].role == "exterior" and got[3].parts[0].closed and not any(r.issues for r in got)


def test_long_ring_crosses_blocks(spark):
    rnd = random.Random(7)
    deltas = [(rnd.randrange(-50, 50), rnd.randrange(-50, 50)) for _ in range(500)]
    zz = [v for dx, dy in deltas for v in ((dx << 1) ^ (dx >> 63), (dy << 1) ^ (dy >> 63))]
    ints = [9, *zz[:2], (499 << 3) | 2, *zz[2:]]
    got = _decode(spark, [(ints, 2)])[0].parts[0].points
    x = y = 0
    for p, (dx, dy) in zip(got, deltas, strict=True):
        x, y = x + dx, y + dy
        assert (p.x, p.y) == (x, y)


def test_hit_order(spark):
    def square(a, b):
        return [9, 2 * a, 2 * a, 26, 2 * (b - a), 0, 0, 2 * (b - a), 2 * (b - a) - 1, 0, 15]

    rows = [(0, square(0, 100), 3), (1, square(40, 60), 3), (2, [9, 0, 100, 10, 200, 0], 2)]
    f = spark.createDataFrame([(1, 0, i, g, t, 100) for i, g, t in rows],
                              "tile_id long, layer_index int, feature_index long, geometry array<bigint>, type int, extent int")
    pts = spark.createDataFrame([(1, 1, 0.5, 0.505), (2, 1, 0.2, 0.2), (3, 1, 0.999, 0.505)], "request_id int, tile_id long, fx double, fy double")
    got = {}
    for r in hit_test(pts, with_geometry(f), ["tile_id"], 0.01).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.feature_index, r.distance))
    assert [i for i, _ in got[1]] == [2, 1, 0] and got[2] == [(0, 0.0)] and [i for i, _ in got[3]] == [2, 0]


def test_equal_points_are_looked_up_once(spark):
    f = spark.createDataFrame([(1, 0, k, [9, 2 * (100 + k), 200], 1, 4096) for k in range(5)],
                              "tile_id long, layer_index int, feature_index long, geometry array<bigint>, type int, extent int")
    pts = spark.range(500).selectExpr("id AS request_id", "1L AS tile_id", "100 / 4096D AS fx", "IF(id < 400, 100, 3000) / 4096D AS fy")
    with recorded_tables() as made:
        got = hit_test(pts, with_geometry(f), ["tile_id"], 0.01).collect()
    assert len(got) == 2000 and {(r.request_id, r["rank"], r.feature_index) for r in got} == {(i, k + 1, k) for i in range(400) for k in range(5)}
    assert spark.read.parquet(made[-1]).count() == 5


def test_first_uses_of_contents_are_found_once(spark):
    e = spark.range(400).selectExpr("id % 2 AS archive_id", "id AS tile_id", "1L AS run_length", "CAST(id % 7 AS STRING) AS content")
    lengths = e.select("archive_id", "content").distinct().withColumn("length", F.lit(10).cast("bigint"))
    with recorded_tables() as made:
        got = D.assign_offsets(e, lengths)
    assert spark.read.parquet(made[0]).count() == 14 and "offset" not in spark.read.parquet(made[0]).columns
    assert {(r.archive_id, r.content): r.offset for r in got.collect()} == {(i % 2, str(i % 7)): 10 * (i // 2) for i in range(14)}


def test_a_record_inside_another_ends_alone(spark):
    with recorded_tables() as outer:
        with recorded_tables() as inner:
            cut_lineage(spark.range(2))
        later = cut_lineage(spark.range(3))
    assert len(inner) == 1 and len(outer) == 2 and outer[0] == inner[0]
    drop_tables(spark, inner)
    assert later.count() == 3


def test_small_tables_of_long_work_are_cut_over_tasks(spark):
    for df, column in ((q_features.build_features(spark, "/root/testdata/sf0.01"), "p"), (q_archive.header_blobs(spark, "/root/testdata/sf0.01"), "archive_id")):
        counts = [r[0] for r in df.groupBy(F.spark_partition_id() if column == "p" else F.input_file_name()).count().select("count").collect()]
        assert len(counts) >= 8 and max(counts) < sum(counts) / 4


def test_geometry_against_plain_python(spark):
    """Area and distances of random polygons."""
    from math import hypot

    rnd = random.Random(8)
    rings = [[(rnd.randrange(200), rnd.randrange(200)) for _ in range(rnd.randrange(3, 12))] for _ in range(30)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in r], rnd.uniform(-20, 220), rnd.uniform(-20, 220)) for i, r in enumerate(rings)],
                               "i int, points array<struct<x:bigint,y:bigint>>, px double, py double")
    px, py = F.col("px"), F.col("py")
    out = df.select("i", "px", "py", G.ring_area(F.col("points")).alias("a"), G.in_ring(F.col("points"), px, py).alias("inside"),
                    G.path_distance(F.col("points"), px, py, True).alias("d")).collect()
    for r in out:
        ring = rings[r.i]
        pairs = list(zip(ring, ring[1:] + ring[:1]))
        assert r.a == sum(a[0] * b[1] - b[0] * a[1] for a, b in pairs) / 2
        assert r.inside == (sum((a[1] > r.py) != (b[1] > r.py) and r.px < (b[0] - a[0]) * (r.py - a[1]) / (b[1] - a[1]) + a[0] for a, b in pairs) % 2 == 1)
        best = 1e9
        for a, b in pairs:
            dx, dy = b[0] - a[0], b[1] - a[1]
            n = dx * dx + dy * dy
            t = max(0, min(1, ((r.px - a[0]) * dx + (r.py - a[1]) * dy) / n)) if n else 0
            best = min(best, hypot(a[0] + t * dx - r.px, a[1] + t * dy - r.py))
        assert abs(r.d - best) < 1e-9


def test_values_of_any_width_against_plain_python(spark):
    rnd = random.Random(11)

    def written(v, extra):
        out = []
        while True:
            out.append(v % 128)
            v //= 128
            if not v:
                break
        out += [0] * extra
        return bytes([b | 128 for b in out[:-1]] + out[-1:])

    blobs = []
    for _ in range(300):
        values = [(rnd.getrandbits(rnd.choice([1, 7, 8, 14, 31, 52, 53, 54, 56, 57, 63, 70])), rnd.choice([0, 0, 1, 3])) for _ in range(rnd.randrange(6))]
        blobs.append((b"".join(written(*v) for v in values) + rnd.choice([b"", b"", b"\x80", b"\xff\xff"]), values))
    df = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(blobs)] + [(999, None)], "k int, blob binary")
    got = {r.k: r["values"] for r in decode_blobs(df).collect()}
    assert got.pop(999) is None
    for k, (_, values) in enumerate(blobs):
        at, want = 0, []
        for v, extra in values:
            n = len(written(v, extra))
            want.append((v if v < 2 ** 53 and n <= 10 else None, at, n))
            at += n
        assert [tuple(v) for v in got[k]] == want, k


def test_padded_values_are_longer_and_equal(spark):
    df = spark.createDataFrame([(v, n) for v in (0, 1, 127, 128, 300, 2 ** 40) for n in range(4)], "v long, n int")
    for r in decode_blobs(df.withColumn("blob", F.unhex(padded_varint_hex("v", "n"))).withColumn("w", varint_width("v"))).collect():
        assert [(v.value, v.byte_length) for v in r["values"]] == [(r.v, r.w + r.n)]


def test_map_tiles_reads_stored_levels(spark):
    """The whole answer of a map comes from a handful of scans, not one tree per use."""
    from tesserix.plans.q_lookup import map_tiles

    plan = map_tiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) <= 20


def test_trees_are_packed_until_the_root_fits(spark):
    rnd = random.Random(12)
    tiles, at, place = [], 0, 0
    for a, n in ((1, 3000), (2, 20), (3, 1)):
        at = place = 0
        for _ in range(n):
            run = rnd.choice([1, 1, 2, 5])
            tiles.append((a, at, run, place, 10))
            at, place = at + run + rnd.choice([0, 0, 1, 9]), place + 10
    entries = spark.createDataFrame(tiles, "archive_id long, tile_id long, run_length long, offset long, length long")
    tree = cut_lineage(D.pack_tree(entries, 8, 90))
    levels = {r.archive_id: r.top for r in tree.filter("dir_id = -1").groupBy("archive_id").agg(F.max("level").alias("top")).collect()}
    assert levels == {1: 3, 2: 1, 3: 0} or (levels[1] == 3 and levels[3] == 0)
    roots = D.encode_directories(tree.filter("dir_id = -1"), ["archive_id", "level"]).withColumn("size", F.octet_length("blob"))
    assert all(r["size"] <= 90 or r.level == 3 for r in roots.collect())
    blobs = D.encode_directories(tree.filter("dir_id >= 0"), ["archive_id", "dir_id"]).withColumn("size", F.octet_length("blob").cast("bigint"))
    named = tree.filter("run_length = 0").select("archive_id", F.col("offset").alias("dir_id"), "length").join(blobs, ["archive_id", "dir_id"], "full")
    assert named.filter("NOT (length <=> size)").count() == 0  # each leaf is named once, by its place and size
    arch = spark.createDataFrame([(a, 0, 30) for a in (1, 2, 3)], "archive_id long, min_zoom int, max_zoom int")
    asked = entries.selectExpr("archive_id", "5 AS z", "explode(array(tile_id, tile_id + run_length - 1, tile_id + run_length)) AS target").distinct()
    deep = {(r.archive_id, r.target): (r.status, r.offset) for r in L.lookup_tree(asked, arch, tree).collect()}
    covered = {(a, t + k): o for a, t, n, o, _ in tiles for k in range(n)}
    assert deep == {k: ("found", covered[k]) if k in covered else ("not-found", None) for k in deep}


def test_long_ranges_are_cut_before_they_are_listed(spark, monkeypatch):
    monkeypatch.setattr(B, "ARRAY_BITS", 3)
    df = spark.createDataFrame([(1, 5, 300), (2, 0, 1), (3, 9, 0), (4, 100, 64), (5, 7, 513)], "k int, a long, n long")
    out = B.explode_range(df, "a", "n", "v")
    assert sorted((r.k, r.v) for r in out.collect()) == sorted((k, v) for k, a, n in ((1, 5, 300), (2, 0, 1), (4, 100, 64), (5, 7, 513)) for v in range(a, a + n))


def test_windows_by_stretches_and_squares(spark):
    """States of every tile against a plain walk of the directories at hand."""
    rnd = random.Random(13)
    rows, at = [], 21
    leaves = []
    for leaf in range(6):
        start = at
        items = []
        for i in range(5):
            run = rnd.choice([1, 2, 4])
            items.append((at, run))
            at += run + rnd.choice([0, 0, 1, 3])
        leaves.append((start, 100 + leaf, items))
    root = [(1, -1, 0, 21 - 5, 2, 0, 0)] + [(1, -1, k + 1, s, 0, off, 9) for k, (s, off, _) in enumerate(leaves)]
    loaded = [(1, off, i, t, n, 0, 1) for _, off, items in leaves if off % 3 for i, (t, n) in enumerate(items)]
    tree = spark.createDataFrame(root + loaded, "archive_id long, dir_id long, i long, tile_id long, run_length long, offset long, length long")
    windows = spark.createDataFrame([(1, 3, 0, 0, 3), (1, 2, 0, 0, 2), (1, 4, 5, 5, 2), (2, 3, 1, 1, 1)], "archive_id long, z int, x long, y long, k int")

    def state(a, t):
        if a == 2 or t < 16:
            return "none", -1
        if t < 18:
            return "tile", -1
        k = max((k for k, (s, _, _) in enumerate(leaves) if s <= t), default=None)
        if k is None:
            return "none", -1
        if leaves[k][1] % 3 == 0:
            return "unloaded", k
        return ("tile" if any(s <= t < s + n for s, n in leaves[k][2]) else "miss"), k

    stretches = cut_lineage(B.classify_windows(windows, tree))
    tiles = B.window_tiles(stretches).collect()
    assert len(tiles) == 64 + 16 + 16 + 4
    assert all((r.state, r.region) == state(r.archive_id, r.tile_id) for r in tiles)
    squares = B.window_squares(stretches).groupBy("archive_id", "z", "state").agg(F.sum(F.col("size") * F.col("size")).alias("n")).collect()
    counted = {}
    for r in tiles:
        counted[r.archive_id, r.z, r.state] = counted.get((r.archive_id, r.z, r.state), 0) + 1
    assert {(r.archive_id, r.z, r.state): r.n for r in squares} == counted

"""Archive files on disk -> tables."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from archive_files import archive
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from tesserix.functions.varint import DECODE_BYTES, decode_bytes
from tesserix.operators.archive import reconcile_counts, split_headers
from tesserix.operators.damage import safe_bytes
from tesserix.operators.lookup import lookup_tree, with_targets
from tesserix.sources.codecs import BATCH_BYTES, pieces
from tesserix.sources.entry_source import PushingEntryReader, load_entries, write_manifest
from tesserix.sources.ingest import (archive_bucket, from_tms, read_contents, read_directories, read_metadata, read_ranges, scan_archives,
                                     write_entries)
from tesserix.sources.ranges import merged

TILES = [(i * 3, 1 + i % 3, b"ocean" if i % 4 == 0 else f"tile {i}".encode()) for i in range(1000)]


def _folder(tmp_path):
    (tmp_path / "a.tiles").write_bytes(archive(TILES, 64, metadata=b'{"vector_layers":[{"id":"roads"}]}', tile_codec=2))
    (tmp_path / "b.tiles").write_bytes(archive(TILES[:20], 64, codec=1, metadata=b"not json", root_gap=20000))
    (tmp_path / "c.tiles").write_bytes(b"x" * 148)
    (tmp_path / "d.tiles").write_bytes(archive([], 64))
    (tmp_path / "e.tiles").write_bytes(archive(TILES[:5], 64)[:126])
    return str(tmp_path)


def test_scan_read_and_lookup(spark, tmp_path):
    scanned = scan_archives(spark, _folder(tmp_path), ".tiles").cache()
    ok, bad = split_headers(scanned)
    assert {r.path[-7]: r.reason for r in bad.collect()} == {"c": "wrong-magic", "e": "too-short"}
    names = {r.archive_id: r.path[-7] for r in ok.collect()}
    assert sorted(names.values()) == ["a", "b", "d"]

    entries, problems = read_directories(scanned)
    rows = [r for r in entries.collect() if names[r.archive_id] == "a" and r.run_length > 0]
    assert sorted((r.tile_id, r.run_length) for r in rows) == [(t, n) for t, n, _ in TILES]
    assert {r.depth for r in rows} == {1}
    assert [(names[r.archive_id], r.issue) for r in problems.collect()] == [("d", "empty-directory")]
    assert all(r.matches for r in reconcile_counts(entries, ok).collect())

    contents = read_contents(scanned, entries)
    joined = entries.filter("run_length > 0").join(contents, ["archive_id", "offset", "length"])
    got = {(names[r.archive_id], r.tile_id): bytes(r.payload) for r in joined.collect()}
    assert got == {("a", t): c for t, _, c in TILES} | {("b", t): c for t, _, c in TILES[:20]}
    assert contents.filter(F.col("error").isNotNull()).count() == 0
    assert contents.count() == len({c for _, _, c in TILES}) + len({c for _, _, c in TILES[:20]})

    asked = ok.select("archive_id", F.explode(F.expr("sequence(0L, 3199L)")).alias("id")).selectExpr(
        "archive_id", "id AS request_id", "5 AS z", "id % 32 AS x", "id div 100 AS y")
    found = lookup_tree(with_targets(asked), ok, entries).collect()
    covered = {t + k for t, n, _ in TILES for k in range(n)}
    for r in found:
        if names[r.archive_id] == "a":
            assert r.status == ("found" if r.target in covered else "not-found")
        if names[r.archive_id] == "d":
            assert r.status == "not-found"


def test_pruning_reads_only_wanted_leaves(spark, tmp_path):
    scanned = scan_archives(spark, _folder(tmp_path), "a.tiles")
    entries, _ = read_directories(scanned, first_tile=300, end_tile=400)
    leaves = {r.dir_id for r in entries.filter("run_length > 0").collect()}
    ids = [r.tile_id for r in entries.filter("run_length > 0").collect()]
    assert len(leaves) == 2 and min(ids) <= 300 and max(ids) >= 399


def test_path_filter_is_pushed(spark, tmp_path):
    folder = _folder(tmp_path)
    from tesserix.sources.archive_source import read_first_bytes

    one = read_first_bytes(spark, folder).filter(F.col("path") == f"{folder}/b.tiles")
    assert [r.path for r in one.collect()] == [f"{folder}/b.tiles"]


def test_metadata(spark, tmp_path):
    scanned = scan_archives(spark, _folder(tmp_path), ".tiles")
    ids = {r.archive_id: r.path[-7] for r in scanned.select("archive_id", "path").collect()}
    got = {ids[r.archive_id]: (bytes(r.metadata), r.json_ok) for r in read_metadata(scanned).select("archive_id", "metadata", "json_ok").collect()}
    assert got == {"a": (b'{"vector_layers":[{"id":"roads"}]}', True), "b": (b"not json", False), "d": (b"{}", True)}


def test_tms_and_sink(spark, tmp_path):
    rows = from_tms(spark.createDataFrame([(0, 0, 0), (3, 2, 1)], "z int, x long, tms_y long")).collect()
    assert [(r.z, r.x, r.y) for r in rows] == [(0, 0, 0), (3, 2, 6)]
    e = spark.range(100).selectExpr("id % 3 AS archive_id", "id AS tile_id", "1L AS run_length")
    write_entries(e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100


# ---- any session, manifest, reads ----

@pytest.fixture
def plain_settings(spark):
    """Spark's own defaults for what the library's session sets."""
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_everything_is_read_under_default_settings(plain_settings, tmp_path):
    spark = plain_settings
    scanned = scan_archives(spark, _folder(tmp_path), ".tiles")
    assert scanned.filter("reason IS NULL").count() == 3
    entries, _ = read_directories(scanned)
    assert read_contents(scanned, entries).filter("error IS NOT NULL").count() == 0 and read_metadata(scanned).count() == 3
    one = scanned.filter(F.col("path").endswith("b.tiles"))
    assert one.count() == 1
    folder = str(tmp_path / "manifest")
    write_manifest(scanned, entries, folder)
    want = sorted((r.archive_id, r.tile_id, r.run_length, r.offset, r.length) for r in entries.filter("run_length > 0").collect())
    assert sorted((r.archive_id, r.tile_id, r.run_length, r.offset, r.length) for r in load_entries(spark, folder).collect()) == want
    some = load_entries(spark, folder, first_tile=300, end_tile=400).collect()
    assert sorted(r.tile_id for r in some) == sorted(w[1] for w in want if 300 <= w[1] < 400)


def test_a_session_of_its_own(tmp_path):
    """The scan in a process whose session nobody configured."""
    import subprocess
    import sys

    folder = _folder(tmp_path)
    code = f"""
from pyspark.sql import SparkSession
from tesserix.sources.ingest import read_directories, scan_archives
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
entries, problems = read_directories(scan_archives(spark, {folder!r}, ".tiles"))
print("ROWS", entries.filter("run_length > 0").count(), problems.count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert "ROWS 1020 1" in done.stdout, done.stderr[-2000:]


def test_conditions_leave_out_row_groups_and_directories(spark, tmp_path):
    scanned = scan_archives(spark, _folder(tmp_path), ".tiles")
    entries, _ = read_directories(scanned)
    folder = str(tmp_path / "manifest")
    write_manifest(scanned, entries, folder, group_rows=3)
    ids = {r.path[-7]: r.archive_id for r in scanned.collect()}

    def planned(*filters, **options):
        reader = PushingEntryReader({"path": folder, **options})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them again
        parts = [p for p in reader.partitions() if p.group >= 0]
        return len(parts), sum(reader.directories(p).num_rows for p in parts)

    every, leaves = planned()
    assert every >= 6 and leaves == 17  # sixteen leaves of a, the root of b
    assert planned(EqualTo(("archive_id",), ids["b"]))[1] == 1
    groups, directories = planned(EqualTo(("archive_id",), ids["a"]), GreaterThanOrEqual(("tile_id",), 300), LessThan(("tile_id",), 400))
    assert directories == 2 and groups < every
    assert planned(first_tile="300", end_tile="400", archive_ids=str(ids["a"])) == (groups, directories)
    assert planned(In(("archive_id",), (1, 2)))[1] == 0 and planned(GreaterThan(("z",), 9))[1] == 0
    assert 0 < planned(LessThanOrEqual(("z",), 3))[1] < 4 and planned(min_z="6", max_z="6")[1] <= planned()[1]
    got = load_entries(spark, folder).filter((F.col("archive_id") == ids["a"]) & (F.col("tile_id") < 200))
    assert sorted(r.tile_id for r in got.collect()) == [t for t, _, _ in TILES if t < 200]


def test_a_task_lists_no_files_of_the_manifest(spark, tmp_path, monkeypatch):
    scanned = scan_archives(spark, _folder(tmp_path), ".tiles")
    folder = str(tmp_path / "manifest")
    write_manifest(scanned, read_directories(scanned)[0], folder, group_rows=3)
    reader = PushingEntryReader({"path": folder})
    parts = reader.partitions()
    monkeypatch.setattr(reader, "_files", lambda: pytest.fail("a task listed the manifest's files"))
    assert sum(reader.directories(p).num_rows for p in parts) == 17


def test_near_ranges_are_one_read():
    got = list(merged([(0, 10), (5, 8), (12, 20), (100, 110), (110, 110), (500, 900)], gap=4, limit=200))
    assert got == [(0, 20, [0, 1, 2]), (100, 110, [3, 4]), (500, 900, [5])]
    assert [m for *_, m in merged([(0, 60), (60, 120), (120, 180)], 0, 130)] == [[0, 1], [2]] and list(merged([])) == []
    rng = random.Random(1)
    ranges = sorted((a, a + rng.randrange(50)) for a in rng.sample(range(5000), 200))
    seen = []
    for start, end, members in merged(ranges, 10, 300):
        assert all(start <= ranges[m][0] and ranges[m][1] <= end for m in members)
        assert end - start <= 300 or len(members) == 1
        seen += members
    assert seen == list(range(200))


def test_ranges_come_out_whole_whatever_is_read_together(spark, tmp_path):
    data = bytes(random.Random(2).randrange(256) for _ in range(5000))
    (tmp_path / "f").write_bytes(data)
    rows = [(0, 10), (20, 5), (4000, 900), (4990, 100), (6000, 5), (None, 5), (-3, 5), (7, 0), (0, 10), (1000, None), (2 ** 60, 2 ** 60)]
    df = spark.createDataFrame([(k, str(tmp_path / "f"), a, n) for k, (a, n) in enumerate(rows)] + [(99, str(tmp_path / "none"), 0, 5)], "k int, path string, a long, n long")
    for gap in (0, 100000):
        got = {r.k: r for r in read_ranges(df, "a", "n", "raw", gap=gap, read_at="at").collect()}
        for k, (a, n) in enumerate(rows):
            if a is None or n is None or a < 0:
                assert got[k].raw is None and got[k].read_error == "bad-range"
            else:
                assert bytes(got[k].raw) == data[a:a + n] and got[k].read_error == (None if a + n <= 5000 else "short-read")
        assert got[99].raw is None and got[99].read_error == "FileNotFoundError"
        starts = {r["at"] for k, r in got.items() if r["at"] is not None}
        assert (len(starts) == 1) if gap else (len(starts) > 3)


def test_decoding_and_packing_hold_few_bytes_at_once():
    tracemalloc.start()
    try:
        decode_bytes(np.ones(DECODE_BYTES, np.uint8))
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    batch = pa.RecordBatch.from_pydict({"b": [b"x" * n for n in (0, 5, 3, 0, 20, 1, 1)] + [None]})
    got = list(pieces(batch, "b", 8))
    assert [r.num_rows for r in got] == [3, 2, 3] and pa.Table.from_batches(got)["b"].to_pylist() == batch["b"].to_pylist()
    assert BATCH_BYTES <= 8 << 20


def test_a_batch_edge_splits_no_read(spark, tmp_path):
    data = bytes(random.Random(3).randrange(256) for _ in range(4000))
    for name in "fg":
        (tmp_path / name).write_bytes(data)
    df = spark.range(2000).selectExpr("id", f"concat('{tmp_path}/', if(id % 2 = 0, 'f', 'g')) AS path", "id div 2 * 4 + if(id >= 1000, 50, 0) AS a", "4L AS n").repartition(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (1, 7, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            got = read_ranges(df, "a", "n", "raw", gap=2, read_at="at").collect()
            assert len(got) == 2000 and all(bytes(r.raw) == data[r.a:r.a + 4] for r in got)
            assert {(r.path[-1], r["at"]) for r in got} == {(f, at) for f in "fg" for at in (0, 2050)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_lookup_reads_few_files_of_the_store(spark, tmp_path):
    e = spark.range(20000).selectExpr("id % 40 AS archive_id", "id AS tile_id", "1L AS run_length")
    out = str(tmp_path / "store")
    write_entries(e, out, buckets=8, file_rows=500)
    stored = spark.read.parquet(out)
    assert stored.count() == 20000 and len(os.listdir(out)) <= 10
    one = stored.filter((F.col("archive_bucket") == archive_bucket(F.lit(7).cast("bigint"), 8)) & (F.col("archive_id") == 7) & F.col("tile_id").between(1000, 1100))
    assert sorted(r.tile_id for r in one.collect()) == [i for i in range(1000, 1101) if i % 40 == 7]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(tile_id,100" in plan
    files = {r[0] for r in one.select(F.input_file_name()).collect()}
    assert len(files) <= 2 < len({r[0] for r in stored.select(F.input_file_name()).distinct().collect()})


def test_what_comes_out_before_the_damage(spark):
    import gzip
    import zlib

    import zstandard

    rng = random.Random(3)
    plain = bytes(rng.choice(b"abcdef") for _ in range(6000))
    stored = {1: plain, 2: gzip.compress(plain, mtime=0), 4: zstandard.ZstdCompressor().compress(plain), 3: b"brotli"}
    rows = [(code, raw, at) for code, raw in stored.items() for at in sorted(rng.sample(range(len(raw) + 5), min(len(raw), 40)))] + [(2, None, 3), (2, b"no gzip at all", 9)]
    df = spark.createDataFrame(rows, "codec int, blob binary, stored_start long").coalesce(1)
    for r in safe_bytes(df).collect():
        if r.blob is None or r.codec == 3:
            assert r.safe is None
        elif r.codec == 1:
            assert r.safe == min(r.stored_start, len(plain))
        elif bytes(r.blob) == b"no gzip at all":
            assert r.safe == 0
        else:
            d = zlib.decompressobj(31) if r.codec == 2 else zstandard.ZstdDecompressor().decompressobj()
            piece = bytes(r.blob)[:r.stored_start]
            assert r.safe == (len(d.decompress(piece)) if piece else 0)

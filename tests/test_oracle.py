"""Registered queries against their SQL on the smallest tables, and that the interesting cases occur."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, QUERIES[name], SQL[name], SF)[1] == ""
    else:
        QUERIES[name](spark, SF).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_outcome_occurs(spark):
    def values(name, column):
        return {r[column] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}

    assert values("lookup_outcomes_by_zoom", "outcome") >= {"exact-tile", "run-hit", "outside-run", "before-first", "out-of-zoom", "invalid"}
    assert values("tree_lookup", "status") == {"found", "not-found", "out-of-zoom", "error", "invalid"}
    assert values("map_request_summary", "status") == {"found", "missing", "error"}
    assert values("offset_classes", "offset_class") >= {"first", "contiguous", "backward", "resume"}
    assert values("payload_kinds", "kind") == {"gzip", "zstd", "png", "jpeg", "webp", "avif", "mvt-like", "text", "empty", "unknown"}
    assert values("layout_issues", "issue") == {"overlap", "beyond-eof", "root-outside-first-read"}
    assert values("grid_classes", "state") == {"tile", "miss", "unloaded", "none"}


def test_every_stored_entry_is_read_back(spark):
    archives = {r[0] for r in QUERIES["stored_entries_all"](spark, SF).select("archive_id").distinct().collect()}
    assert 0 in archives and {a % 2 for a in archives} == {0, 1}


def test_stored_entries_are_rows_of_all_archives(spark):
    got = QUERIES["stored_entries"](spark, SF)
    assert got.count() == QUERIES["stored_entries_all"](spark, SF).count()
    assert {"tile_id", "run_length", "offset", "length"} <= set(got.columns)
    assert {r[0] % 2 for r in got.select("archive_id").distinct().collect()} == {0, 1}

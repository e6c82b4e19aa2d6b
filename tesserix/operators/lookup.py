"""Batched tile lookup: which directory entry answers a request, and what that says about the tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.functions.address import KEY_BITS_DEFAULT, is_valid_zxy, tile_id
from tesserix.functions.common import lng
from tesserix.operators.ordered import exclusive_scan, floor_join
from tesserix.session import cut_lineage

#: Directories nest at most this deep, the root included (fixed value).
MAX_DEPTH = 4
#: ``dir_id`` of a root directory; a leaf's is its offset inside the leaf section.
ROOT = -1


def search_outcome(target: Column, found_id: Column, found_run: Column) -> Column:
    """What a directory search ended with, from the candidate entry at or before the target.

    The order of the tests matters: a candidate pointing at a leaf has no range check.
    """
    return (F.when(found_id.isNull(), "before-first")
            .when((found_id == target) & (found_run == 0), "exact-leaf")
            .when(found_id == target, "exact-tile")
            .when(found_run == 0, "leaf")
            .when(target - found_id < found_run, "run-hit")
            .otherwise("outside-run"))


def with_targets(requests: DataFrame) -> DataFrame:
    """Add ``valid`` and ``target`` (tile id) to requests of z, x, y."""
    return requests.withColumns({"valid": is_valid_zxy("z", "x", "y"), "target": tile_id("z", "x", "y")})


def zoom_gate(requests: DataFrame, archives: DataFrame) -> DataFrame:
    """Add ``in_zoom``: whether the archive declares the request's zoom. Nothing else is looked up outside it."""
    gates = archives.select("archive_id", "min_zoom", "max_zoom")
    inside = F.coalesce(F.col("z").between(F.col("min_zoom"), F.col("max_zoom")), F.lit(False))
    return requests.join(gates, "archive_id", "left").withColumn("in_zoom", inside).drop("min_zoom", "max_zoom")


def floor_entry(requests: DataFrame, entries: DataFrame, on: list[str] | None = None, target: str = "target",
                partitions: int | None = None) -> DataFrame:
    """Requests plus ``candidate``: the entry with the largest tile id at or before the target, if any."""
    return floor_join(requests, entries, on or ["archive_id"], target, "tile_id", "candidate", partitions)


def lookup_flat(requests: DataFrame, archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Search one directory per archive: adds ``outcome``, with ``out-of-zoom`` and ``invalid`` decided up front."""
    asked = zoom_gate(requests, archives)
    searched = floor_entry(asked.withColumn("_t", F.when(F.col("in_zoom"), F.col("target"))), entries, target="_t")
    outcome = (F.when(F.col("target").isNull(), "invalid").when(~F.col("in_zoom"), "out-of-zoom")
               .otherwise(search_outcome(F.col("target"), F.col("candidate.tile_id"), F.col("candidate.run_length"))))
    return searched.withColumn("outcome", outcome).drop("_t", "in_zoom")


def lookup_tree(requests: DataFrame, archives: DataFrame, entries: DataFrame) -> DataFrame:
    """Walk root -> leaf -> ... as one floor join per level, at most four.

    ``entries`` carry ``dir_id`` (-1 for the root, else the leaf's offset). Adds ``status`` (found, not-found,
    out-of-zoom, error, invalid), the ``depth`` where the walk ended and the found ``offset`` and ``length``.
    A leaf with no entries, or one that could not be read, is an error; an empty root just finds nothing. Only different
    (archive, tile) pairs walk, without the requests' other columns; the answers are joined back once.
    """
    known = entries.groupBy("archive_id", "dir_id").agg(F.lit(True).alias("known"))
    rows = entries.select("archive_id", "dir_id", "tile_id", "run_length", "offset", "length")
    asked = zoom_gate(requests, archives)
    gate = F.when(F.col("target").isNull(), "invalid").when(~F.col("in_zoom"), "out-of-zoom")
    asked = asked.withColumn("_gate", gate).drop("in_zoom")
    active = asked.filter("_gate IS NULL").select("archive_id", "target").distinct().withColumn("dir_id", lng(ROOT))
    cols, done = ["archive_id", "target", "status", "depth", "offset", "length"], []
    for depth in range(MAX_DEPTH):
        found = floor_join(active, rows, ["archive_id", "dir_id"], "target", "tile_id", "c")
        found = found.join(known, ["archive_id", "dir_id"], "left") if depth else found.withColumn("known", F.lit(True))
        state = (F.when(F.col("known").isNull(), "error").when(F.col("c").isNull(), "not-found")
                 .when(F.col("c.run_length") > 0, F.when(
                     F.col("target") - F.col("c.tile_id") < F.col("c.run_length"), "found").otherwise("not-found"))
                 .otherwise("error" if depth == MAX_DEPTH - 1 else "descend"))
        found = found.withColumns({"status": state, "depth": F.lit(depth), "offset": F.col("c.offset"), "length": F.col("c.length")})
        hit = F.col("status") == "found"
        done.append(found.filter("status <> 'descend'").withColumns(
            {"offset": F.when(hit, F.col("offset")), "length": F.when(hit, F.col("length"))}).select(*cols))
        if depth < MAX_DEPTH - 1:
            active = found.filter("status = 'descend'").select("archive_id", "target", F.col("offset").alias("dir_id"))
            if active.isEmpty():
                break
    walked = done[0]
    for part in done[1:]:
        walked = walked.unionByName(part)
    out = asked.join(walked, ["archive_id", "target"], "left")
    return out.withColumns({"status": F.coalesce("_gate", "status"), "depth": F.coalesce("depth", F.lit(0))}).select(
        *requests.columns, "status", "depth", "offset", "length")


def responsibility(entries: DataFrame, keys: list[str], upper: str | None = None) -> DataFrame:
    """Add the half-open tile id interval [range_start, range_end) each entry answers for.

    A tile entry covers its run. A leaf entry has no end of its own: it reaches to the next entry of its directory, or
    to the bound ``upper`` inherited from the parent (NULL for a root: no bound). Entries are ordered by ``i``.
    """
    back = entries.withColumn("_back", -F.col("i"))
    nxt = exclusive_scan(back, keys, "_back", {"_next": ("last", F.col("tile_id"))}).drop("_back")
    bound = F.col(upper) if upper else F.lit(None).cast("bigint")
    end = F.when(F.col("run_length") > 0, F.col("tile_id") + F.col("run_length")).otherwise(
        F.coalesce(F.col("_next"), bound))
    return nxt.withColumns({"range_start": F.col("tile_id"), "range_end": end, "next_tile_id": F.col("_next")}).drop("_next")


def flatten_tree(entries: DataFrame) -> DataFrame:
    """All reachable tile runs of a directory tree as disjoint intervals: one row per run, any depth.

    A leaf's runs are clipped to the interval its parent entry answers for, so one interval join over the result gives
    the same hits as walking the tree. A leaf that is not at hand, or lies below the deepest level, answers its whole
    interval with an error. Columns: archive_id, run_start, run_end, offset, length, depth, status (found or error).

    Intervals go down level by level: the next tile id inside each directory is found once for all directories and stored, each
    level takes its entries from there, cuts them by its parents' bounds and stores them; so is the result.
    """
    none = F.lit(None).cast("bigint")
    rows = cut_lineage(responsibility(entries, ["archive_id", "dir_id"]).select(
        "archive_id", "dir_id", "tile_id", "run_length", "offset", "length", F.col("next_tile_id").alias("nxt")), "entries")
    known = rows.select("archive_id", "dir_id").distinct().withColumn("_known", F.lit(True))
    level = rows.filter(F.col("dir_id") == ROOT).withColumns({"lo": lng(0), "hi": none})
    parts = []
    for depth in range(MAX_DEPTH):
        start = F.greatest("tile_id", "lo")
        # An entry answers up to the next one; its parent's bound cuts both runs and leaves.
        reach = F.least(F.col("nxt"), F.col("hi"))
        runs = level.filter("run_length > 0").select(
            "archive_id", start.alias("run_start"),
            F.least(F.col("tile_id") + F.col("run_length"), reach).alias("run_end"), "offset", "length",
            F.lit(depth).alias("depth"), F.lit("found").alias("status"))
        parts.append(runs.filter("run_start < run_end"))
        leaves = level.filter("run_length = 0").select(
            "archive_id", F.col("offset").alias("dir_id"), start.alias("lo"), reach.alias("hi"))
        last = depth == MAX_DEPTH - 1
        lost = leaves if last else leaves.join(known, ["archive_id", "dir_id"], "left_anti")
        lost = lost.select("archive_id", F.col("lo").alias("run_start"), F.coalesce("hi", lng(1 << KEY_BITS_DEFAULT)).alias("run_end"),
                           none.alias("offset"), none.alias("length"), F.lit(depth if last else depth + 1).alias("depth"), F.lit("error").alias("status"))
        parts.append(lost.filter("run_start < run_end"))
        if last or leaves.isEmpty():
            break
        level = cut_lineage(rows.join(leaves, ["archive_id", "dir_id"]), "level")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return cut_lineage(out, "runs")


_STEP = 4
_LEVELS = 14


def _interval_level(start: Column, end: Column) -> Column:
    """Smallest level whose cells of 16^level ids hold the interval in at most two cells."""
    out = F.lit(_LEVELS)
    for level in range(_LEVELS - 1, -1, -1):
        out = F.when(F.shiftright(end - 1, _STEP * level) - F.shiftright(start, _STEP * level) <= 1,
                     F.lit(level)).otherwise(out)
    return out


def hit_join(requests: DataFrame, runs: DataFrame, how: str = "inner", target: str = "target") -> DataFrame:
    """Interval join of requests with disjoint runs [run_start, run_end) of the same archive.

    Every run is filed under one or two cells of a size that fits it, so a run of any length costs at most two rows; a
    request probes one cell per size in use by its archive (usually one or two of fourteen). An equi-join on the cell
    plus the range test then sees at most 18 candidate runs per probe. ``how`` may be ``inner`` or ``left_anti``.
    """
    level = _interval_level(F.col("run_start"), F.col("run_end"))
    filed = runs.filter("run_start < run_end").withColumn("_level", level)
    first = F.expr(f"shiftright(run_start, {_STEP} * _level)")
    last = F.expr(f"shiftright(run_end - 1, {_STEP} * _level)")
    used = filed.groupBy("archive_id").agg(F.collect_set("_level").alias("_levels"))  # at most 15 numbers per archive
    filed = filed.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))
    wanted = requests.select("archive_id", F.col(target).alias("_t")).distinct()
    probes = wanted.join(used, "archive_id").withColumn("_level", F.explode("_levels")).drop("_levels")
    probes = probes.withColumn("_cell", F.expr(f"shiftright(_t, {_STEP} * _level)"))
    hits = probes.join(filed, ["archive_id", "_level", "_cell"]).filter("_t >= run_start AND _t < run_end")
    hits = hits.drop("_level", "_cell").withColumnRenamed("_t", target)
    if how == "left_anti":
        return requests.join(hits.select("archive_id", target), ["archive_id", target], "left_anti")
    return requests.join(hits, ["archive_id", target], how)


def lookup_flattened(requests: DataFrame, archives: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests against the intervals of ``flatten_tree``: the statuses of ``lookup_tree`` and the found offset and length,
    in one interval join. Requests that need no search stay out of it."""
    gated = zoom_gate(requests, archives)
    asked = gated.filter("target IS NOT NULL AND in_zoom").drop("in_zoom")
    rest = gated.filter("target IS NULL OR NOT in_zoom").withColumn("status", F.when(F.col("target").isNull(), "invalid").otherwise("out-of-zoom"))
    hits = hit_join(asked.select("archive_id", "target").distinct(), runs.select("archive_id", "run_start", "run_end", "offset", "length", "status"))
    found = asked.join(hits.drop("run_start", "run_end"), ["archive_id", "target"], "left").withColumn("status", F.coalesce("status", F.lit("not-found")))
    none = F.lit(None).cast("bigint")
    return found.unionByName(rest.drop("in_zoom").withColumns({"offset": none, "length": none}))


def fetch_tiles(requests: DataFrame, archives: DataFrame, runs: DataFrame, contents: DataFrame) -> DataFrame:
    """What a map gets for each request: the tile's bytes, the missing-tile rule, or an error.

    A missing tile is empty bytes for vector archives (a tile without features) and NULL for raster ones. An invalid
    address, a directory that could not be read and a found tile whose content cannot be decoded are errors. ``runs`` are
    those of ``flatten_tree``; ``contents`` hold (archive_id, offset, length, payload, error), one row per stored range.
    """
    looked = cut_lineage(lookup_flattened(requests, archives, runs), "looked")  # read twice below
    types = archives.select("archive_id", F.col("tile_type").isin(1, 6).alias("is_vector"))
    hit = looked.filter("status = 'found'").join(contents, ["archive_id", "offset", "length"], "left").withColumn(
        "status", F.when(F.col("payload").isNull(), "error").otherwise("found"))
    empty = F.lit(None).cast("binary")
    other = looked.filter("status <> 'found'").withColumns({
        "status": F.when(F.col("status").isin("invalid", "error"), "error").otherwise("missing"), "payload": empty})
    out = hit.withColumn("found", F.lit(True)).unionByName(other.withColumn("found", F.lit(False)), allowMissingColumns=True)
    data = F.when(F.col("status") == "found", F.col("payload")).when((F.col("status") == "missing") & F.col("is_vector"), F.lit(b"").cast("binary"))
    return out.join(types, "archive_id", "left").withColumn("data", data).drop("payload")


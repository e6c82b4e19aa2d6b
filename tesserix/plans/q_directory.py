"""Directories: building, encoding, decoding and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions.varint import varint_hex
from tesserix.operators import damage as DM
from tesserix.operators import directory as D
from tesserix.operators import lookup as L
from tesserix.operators.ordered import exclusive_scan
from tesserix.plans import tables as T
from tesserix.session import cut_lineage
from tesserix.sources.codecs import compress

DIR = ["archive_id", "dir_id"]

_W = T._width

T.CTES["t_dir_rows"] = ("""
SELECT *, tile_id - lag(tile_id, 1, 0) OVER w AS delta, count(*) OVER (PARTITION BY archive_id, dir_id) AS n,
  CASE WHEN lag("offset" + length) OVER w = "offset" THEN 0 ELSE "offset" + 1 END AS code
FROM t_leaves WINDOW w AS (PARTITION BY archive_id, dir_id ORDER BY i)""", ["t_leaves"])
_EXTRA = "CASE WHEN (archive_id + leaf_no) % 3 = 0 AND i % 5 = 2 THEN 1 + i % 2 ELSE 0 END"
T.CTES["t_padded_values"] = (f"""
SELECT *, CASE WHEN extra > 0 THEN 1 ELSE 0 END AS loose FROM (SELECT archive_id, dir_id, i, extra, unnest(['tile_id', 'run_length', 'length', 'offset']) AS col,
  unnest([delta, run_length, length, code]) AS value, unnest([{_W('delta')}, {_W('run_length')}, {_W('length')}, {_W('code')}]) + extra AS byte_length
  FROM (SELECT *, {_EXTRA} AS extra FROM t_dir_rows))""", ["t_dir_rows"])
T.CTES["t_dir_values"] = (f"""
SELECT archive_id, dir_id, n, i, c, ['tile_id', 'run_length', 'length', 'offset'][c] AS col, value, w AS byte_length,
  {_W('n')} + coalesce(sum(w) OVER (PARTITION BY archive_id, dir_id ORDER BY c, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  0)::BIGINT AS byte_offset FROM (SELECT *, {_W('value')} AS w FROM (
    SELECT archive_id, dir_id, n, i, unnest([1, 2, 3, 4]) AS c, unnest([delta, run_length, length, code]) AS value FROM t_dir_rows))""",
                          ["t_dir_rows"])


def run_length_entries(spark: SparkSession, d: str) -> DataFrame:
    """Tiles collapsed to runs."""
    return T.build_entries(spark, d)


def run_length_small_buckets(spark: SparkSession, d: str) -> DataFrame:
    """The same with 16-id buckets, so most runs cross bucket edges."""
    return D.collapse_runs(T.tiles(spark, d), bits=4, key_bits=T.KEY_BITS)


ENTRIES_SQL = T.with_tables("SELECT * FROM t_entries", "t_entries")


def expand_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every addressed tile with the entry that answers it."""
    return D.expand_runs(T.entries(spark, d), chunk_bits=2).select("archive_id", "addressed_tile", "tile_id", "content")


EXPAND_SQL = T.with_tables("""SELECT t.archive_id, t.tile_id AS addressed_tile, e.tile_id, t.content FROM t_tiles t
  ASOF JOIN t_entries e ON t.archive_id = e.archive_id AND t.tile_id >= e.tile_id""", "t_tiles", "t_entries")


def run_ends(spark: SparkSession, d: str) -> DataFrame:
    """First and last z/x/y of every run."""
    r = D.run_ends(T.entries(spark, d))
    return r.select("archive_id", "tile_id", *[F.col(f"{p}_{c}").cast("bigint").alias(f"{p}_{c}")
                                               for p in ("first", "last") for c in "zxy"])


RUN_ENDS_SQL = T.with_tables("""
SELECT e.archive_id, e.tile_id, a.z::BIGINT AS first_z, a.x AS first_x, a.y AS first_y, b.z::BIGINT AS last_z, b.x AS last_x, b.y AS last_y
FROM t_entries e JOIN t_tiles a ON e.archive_id = a.archive_id AND e.tile_id = a.tile_id
JOIN t_tiles b ON e.archive_id = b.archive_id AND e.tile_id + e.run_length - 1 = b.tile_id""", "t_entries", "t_tiles")


def assign_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Contents stored once, in order of first use."""
    return T.build_placed(spark, d)


OFFSETS_SQL = T.with_tables("SELECT * FROM t_placed", "t_placed")


def pack_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Entries cut into leaves with a root above them."""
    return T.build_leaves(spark, d)


LEAVES_SQL = T.with_tables("SELECT * FROM t_leaves", "t_leaves")


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return D.offset_classes(T.placed(spark, d), ["archive_id"], "tile_id")


def offset_classes(spark: SparkSession, d: str) -> DataFrame:
    """Why each offset is stored the way it is."""
    return _classed(spark, d).select("archive_id", "tile_id", "offset", "offset_class")


T.CTES["t_classed"] = ("""
SELECT archive_id, tile_id, "offset", CASE WHEN prev IS NULL THEN 'first' WHEN "offset" = prev THEN 'contiguous'
  WHEN "offset" < prev THEN 'backward' WHEN "offset" = high THEN 'resume' ELSE 'forward' END AS offset_class FROM (
  SELECT *, lag("offset" + length) OVER w AS prev, max("offset" + length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
  FROM t_placed WINDOW w AS (PARTITION BY archive_id ORDER BY tile_id))""", ["t_placed"])
CLASSES_SQL = T.with_tables("SELECT * FROM t_classed", "t_classed")


def offset_summary(spark: SparkSession, d: str) -> DataFrame:
    """Offsets of each archive counted by class."""
    return D.offset_summary(_classed(spark, d), ["archive_id"])


SUMMARY_SQL = T.with_tables("SELECT archive_id, " + ", ".join(
    f"count(*) FILTER (WHERE offset_class = '{c}')::BIGINT AS n_{c}"
    for c in ("contiguous", "first", "backward", "resume", "forward")) + " FROM t_classed GROUP BY 1", "t_classed")


def clustered_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each archive's tile data lies in tile id order; odd archives are stored back to front first."""
    p = T.placed(spark, d).withColumn("offset", F.when(F.col("archive_id") % 2 == 1, 10000000 - F.col("offset")).otherwise(F.col("offset")))
    return D.clustered_check(D.offset_classes(p, ["archive_id"], "tile_id"), ["archive_id"], "tile_id")


CLUSTERED_SQL = T.with_tables("""
, p AS (SELECT archive_id, tile_id, length, CASE WHEN archive_id % 2 = 1 THEN 10000000 - "offset" ELSE "offset" END AS "offset" FROM t_placed),
c AS (SELECT *, lag("offset" + length) OVER w AS prev, max("offset" + length) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high
  FROM p WINDOW w AS (PARTITION BY archive_id ORDER BY tile_id)),
s AS (SELECT archive_id, count(*) FILTER (WHERE "offset" > prev AND "offset" <> high)::BIGINT AS n_forward,
  count(*) FILTER (WHERE "offset" < prev)::BIGINT AS n_backward, count(*) FILTER (WHERE "offset" > prev AND "offset" = high)::BIGINT AS n_resume,
  count(*)::BIGINT AS n_entries, count(DISTINCT "offset")::BIGINT AS n_contents, arg_min("offset", tile_id) AS first_offset FROM c GROUP BY 1)
SELECT *, n_forward = 0 AND first_offset = 0 AS is_clustered, n_forward = 0 AND first_offset = 0 AND n_backward = n_entries - n_contents
  AND n_resume = n_backward AS single_reuses_only FROM s""", "t_placed")


def blobs(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d, "t_blobs", lambda s, p: D.encode_directories(T.leaves(s, p), DIR))


def decoded(spark: SparkSession, d: str) -> DataFrame:
    return T.stored(spark, d, "t_decoded", lambda s, p: D.decode_values(D.spread(blobs(s, p).drop("n"), DIR)))


def encode_directories(spark: SparkSession, d: str) -> DataFrame:
    """Every directory as bytes."""
    return D.encode_directories(T.leaves(spark, d), DIR).select(
        *DIR, "n", F.octet_length("blob").cast("bigint").alias("n_bytes"), F.md5("blob").alias("md5"))


_HEX = "array_to_string(list_transform(range(0, {w}), lambda k: lpad(hex((({v} >> (7 * k)) & 127) + CASE WHEN k < {w} - 1 THEN 128 ELSE 0 END), 2, '0')), '')"

ENCODE_SQL = T.with_tables(f"""
SELECT archive_id, dir_id, n, octet_length(blob)::BIGINT AS n_bytes, md5(blob) AS md5 FROM (
  SELECT archive_id, dir_id, n, unhex({_HEX.format(w=_W('n'), v='n')} || body) AS blob FROM (
    SELECT archive_id, dir_id, n, string_agg({_HEX.format(w='byte_length', v='value')}, '' ORDER BY c, i) AS body
    FROM t_dir_values GROUP BY 1, 2, 3))""", "t_dir_values")


def decode_directories(spark: SparkSession, d: str) -> DataFrame:
    """Bytes back to entries: the entries that were encoded."""
    return D.decode_entries(D.decode_values(D.spread(blobs(spark, d).drop("n"), DIR)), DIR).drop("delta", "code")


DECODE_SQL = T.with_tables('SELECT archive_id, dir_id, i, tile_id, run_length, "offset", length FROM t_leaves', "t_leaves")


def encoded_values(spark: SparkSession, d: str) -> DataFrame:
    """Every stored number with the bytes it came from."""
    v = D.encoded_values(decoded(spark, d), DIR)
    return v.select(*DIR, "n", "col", "i", "value", F.col("byte_offset").cast("bigint").alias("byte_offset"),
                    F.col("byte_length").cast("bigint").alias("byte_length"))


VALUES_SQL = T.with_tables("SELECT archive_id, dir_id, n, col, i, value, byte_offset, byte_length FROM t_dir_values", "t_dir_values")


def column_stats(spark: SparkSession, d: str) -> DataFrame:
    """Bytes, one-byte share, most common value and padded values of every directory column; a third of the directories
    pads every fifth entry by one or two bytes."""
    extra = F.when((F.col("archive_id") + F.col("leaf_no")) % 3 == 0, F.when(F.col("i") % 5 == 2, 1 + F.col("i") % 2).otherwise(0)).otherwise(0)
    padded = D.encode_directories(T.leaves(spark, d).withColumn("extra", extra.cast("int")), DIR, extra="extra")
    s = D.column_stats(D.encoded_values(D.decode_values(padded.drop("n")), DIR), DIR)
    return s.withColumn("bytes_per_value", F.round("bytes_per_value", 6))


STATS_SQL = T.with_tables(f"""
SELECT archive_id, dir_id, col, count(*)::BIGINT AS n_values, sum(byte_length)::BIGINT AS bytes,
  round(sum(byte_length) / count(*)::DOUBLE, 6) AS bytes_per_value, count(*) FILTER (WHERE byte_length = 1)::BIGINT AS one_byte_values,
  any_value(best) AS most_common, max(cnt)::BIGINT AS frequency, sum(loose)::BIGINT AS not_shortest
FROM (SELECT *, first_value(value) OVER (PARTITION BY archive_id, dir_id, col ORDER BY cnt DESC, first_i) AS best FROM (
    SELECT *, count(*) OVER v AS cnt, min(i) OVER v AS first_i FROM t_padded_values WINDOW v AS (PARTITION BY archive_id, dir_id, col, value)))
GROUP BY 1, 2, 3""", "t_padded_values")


def column_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Where each column lies in its directory; blobs of even archives have three stray bytes at the end."""
    b = blobs(spark, d).drop("n").withColumn("blob", F.when(F.col("archive_id") % 2 == 0, F.concat("blob", F.lit(b"\x01\x02\x03"))).otherwise(F.col("blob")))
    r = D.column_ranges(D.decode_values(b), DIR)
    return r.select(*DIR, "col", *[F.col(c).cast("bigint").alias(c) for c in ("byte_offset", "byte_length", "trailing_bytes")])


RANGES_SQL = T.with_tables(f"""
SELECT archive_id, dir_id, col, min(byte_offset)::BIGINT AS byte_offset, sum(byte_length)::BIGINT AS byte_length,
  (CASE WHEN archive_id % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS trailing_bytes FROM t_dir_values GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT archive_id, dir_id, 'count', 0, {_W('n')}, CASE WHEN archive_id % 2 = 0 THEN 3 ELSE 0 END FROM t_dir_values""", "t_dir_values")


def size_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Plain rows against encoded columns, per directory."""
    s = D.size_comparison(decoded(spark, d), DIR)
    return s.withColumns({c: F.round(c, 6) for c in ("encoded_per_entry", "encoded_share")})


SIZES_SQL = T.with_tables(f"""
SELECT archive_id, dir_id, n, n * 24 AS plain_bytes, b AS encoded_bytes, round(b / n::DOUBLE, 6) AS encoded_per_entry,
  round(b / (n * 24)::DOUBLE, 6) AS encoded_share FROM (
  SELECT archive_id, dir_id, n, (sum(byte_length) + {_W('n')})::BIGINT AS b FROM t_dir_values GROUP BY 1, 2, 3)""", "t_dir_values")


def directory_issues(spark: SparkSession, d: str) -> DataFrame:
    """Rule violations and unreadable directories, over one small directory per customer."""
    df = T.read(spark, d, "customer").selectExpr("c_custkey AS archive_id", "c_custkey % 4 AS n")
    steps = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))
    a = F.col("archive_id")

    def column(value) -> F.Column:
        return F.array_join(F.transform(steps, lambda i: varint_hex(value(i))), "")

    ids = F.when((a % 13 == 0) & (F.col("n") > 0), F.concat(F.lit("FFFFFFFFFFFFFFFF7F"), F.repeat(F.lit("01"), (F.col("n") - 1).cast("int")))).otherwise(
        column(lambda i: i + 1))
    body = F.concat(varint_hex("n"), ids, column(lambda i: F.lit(1)),
                    column(lambda i: F.when((a + i) % 7 == 0, 0).otherwise(i + 10)),
                    column(lambda i: F.when((i == 0) & (a % 5 != 0), 1).otherwise(0)))
    cut = F.when(a % 11 == 0, F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body"))
    blobs = df.withColumn("body", body).select("archive_id", F.unhex(cut).alias("blob"))
    dec = cut_lineage(D.decode_values(cut_lineage(blobs, "blobs")), "decoded")
    issues = D.directory_issues(dec, D.decode_entries(dec, ["archive_id"]), ["archive_id"])
    errors = dec.filter("error IS NOT NULL").select("archive_id", F.col("error").alias("issue"), F.lit(None).cast("bigint").alias("i"))
    return issues.unionByName(errors)


ISSUES_SQL = """
WITH c AS (SELECT c_custkey AS a, c_custkey % 4 AS n FROM customer), e AS (SELECT *, CASE WHEN a % 11 = 0 THEN 'truncated'
  WHEN a % 13 = 0 AND n > 0 THEN 'too-large' END AS err FROM c)
SELECT a AS archive_id, err AS issue, NULL::BIGINT AS i FROM e WHERE err IS NOT NULL
UNION ALL SELECT a, 'empty-directory', NULL FROM e WHERE err IS NULL AND n = 0
UNION ALL SELECT a, 'first-offset-zero', NULL FROM e WHERE err IS NULL AND n > 0 AND a % 5 = 0
UNION ALL SELECT a, 'zero-length', i FROM (SELECT *, unnest(range(0, n)) AS i FROM e WHERE err IS NULL) WHERE (a + i) % 7 = 0"""


def entry_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Tile ids each entry answers for; a leaf's last bound comes from its parent."""
    tree = T.leaves(spark, d)
    root = L.responsibility(tree.filter("dir_id = -1"), DIR)
    bounds = root.filter("run_length = 0").select("archive_id", F.col("offset").alias("dir_id"), F.col("range_end").alias("upper"))
    leaves = L.responsibility(tree.filter("dir_id >= 0"), DIR)
    cut = F.least("range_end", "upper")
    leaves = leaves.join(bounds, DIR).withColumn("range_end", F.when(F.col("run_length") > 0, F.col("range_end")).otherwise(cut))
    cols = [*DIR, "i", "range_start", "range_end", "next_tile_id"]
    return root.select(*cols).unionByName(leaves.select(*cols))


INTERVALS_SQL = T.with_tables("""
SELECT archive_id, dir_id, i, tile_id AS range_start, CASE WHEN run_length > 0 THEN tile_id + run_length ELSE nxt END AS range_end,
  nxt AS next_tile_id FROM (SELECT *, lead(tile_id) OVER (PARTITION BY archive_id, dir_id ORDER BY i) AS nxt FROM t_leaves)""", "t_leaves")


def directory_tree(spark: SparkSession, d: str) -> DataFrame:
    """Each directory's place in the tree: tile id range, entries by kind, addressed tiles."""
    tree = T.leaves(spark, d)
    root = L.responsibility(tree.filter("dir_id = -1 AND run_length = 0"), DIR).select(
        "archive_id", F.col("offset").alias("dir_id"), F.col("i").alias("root_entry"), F.col("tile_id").alias("first_tile_id"),
        (F.col("next_tile_id") - 1).alias("last_tile_id"))
    return D.directory_summary(tree, DIR).join(root, DIR, "left")


TREE_SQL = T.with_tables("""
SELECT archive_id, dir_id, tile_entries, leaf_entries, addressed, root_entry, first_tile_id, last_tile_id FROM (
  SELECT archive_id, dir_id, count(*) FILTER (WHERE run_length > 0)::BIGINT AS tile_entries,
    count(*) FILTER (WHERE run_length = 0)::BIGINT AS leaf_entries, sum(run_length)::BIGINT AS addressed FROM t_leaves GROUP BY 1, 2)
LEFT JOIN (SELECT archive_id, "offset" AS dir_id, i AS root_entry, tile_id AS first_tile_id,
    lead(tile_id) OVER (PARTITION BY archive_id ORDER BY i) - 1 AS last_tile_id FROM t_leaves WHERE dir_id = -1 AND run_length = 0)
USING (archive_id, dir_id)""", "t_leaves")


def entry_file_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Absolute byte range of every entry."""
    return D.entry_file_range(T.leaves(spark, d), T.archives(spark, d)).select(*DIR, "i", "section", "file_offset", "length")


FILE_RANGES_SQL = T.with_tables("""
SELECT e.archive_id, dir_id, i, CASE WHEN run_length = 0 THEN 'leafDirectories' ELSE 'tileData' END AS section,
  "offset" + CASE WHEN run_length = 0 THEN leaf_offset ELSE tile_offset END AS file_offset, length
FROM t_leaves e JOIN t_archives a ON e.archive_id = a.archive_id""", "t_leaves", "t_archives")


def damaged_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries and columns hit by a damaged stretch of bytes in every directory."""
    dec = decoded(spark, d)
    ranges = dec.select(*DIR, F.expr("(archive_id * 31 + dir_id + 1) % decoded_length").alias("damage_start")).withColumn(
        "damage_end", F.col("damage_start") + 5)
    hit = D.damaged_values(ranges, D.encoded_values(dec, DIR), DIR)
    return hit.select(*DIR, "damage_start", "col", "i", "span_start")


DAMAGED_SQL = T.with_tables(f"""
, sizes AS (SELECT archive_id, dir_id, (sum(byte_length) + {_W('n')})::BIGINT AS b FROM t_dir_values GROUP BY 1, 2, n),
r AS (SELECT archive_id, dir_id, (archive_id * 31 + dir_id + 1) % b AS s FROM sizes)
SELECT v.archive_id, v.dir_id, r.s AS damage_start, col, i, byte_offset AS span_start FROM t_dir_values v JOIN r
  ON v.archive_id = r.archive_id AND v.dir_id = r.dir_id AND byte_offset < r.s + 5 AND byte_offset + byte_length > r.s""", "t_dir_values")


#: Bytes that wrap uncompressed data in the gzip form: its header and the head of a stored block (fixed value).
_WRAP = 15


def damaged_files(spark: SparkSession, d: str) -> DataFrame:
    """Damaged ranges of files: the directories they touch, what still comes out of these, and the first value that does not.
    Directories of odd archives are wrapped as gzip data."""
    b = blobs(spark, d).drop("n").withColumn("codec", F.when(F.col("archive_id") % 2 == 1, 2).otherwise(1).cast("int"))
    stored = cut_lineage(compress(b, "blob", "codec", "raw", 0).withColumn("stored", F.octet_length("raw").cast("bigint")), "stored")
    at = exclusive_scan(stored.select(*DIR, "stored"), ["archive_id"], "dir_id", {"at": ("sum", F.col("stored"))}).withColumn("at", 1000 + F.coalesce("at", F.lit(0)))
    ends = at.groupBy("archive_id").agg(F.max(F.col("at") + F.col("stored")).alias("e"))
    ranges = ends.select("archive_id", F.explode(F.sequence(F.lit(1003).cast("bigint"), F.col("e") - 1, F.lit(997).cast("bigint"))).alias("damage_start")).withColumn(
        "damage_end", F.col("damage_start") + 40)
    hit = DM.damaged_directories(ranges, at).join(stored.select(*DIR, "codec", F.col("raw").alias("blob")), DIR)
    lost = DM.lost_entries(DM.safe_bytes(hit).drop("blob"), D.encoded_values(decoded(spark, d), DIR), DIR)
    return lost.select(*DIR, "damage_start", "stored_start", "safe", "n_lost", "col", "i")


DAMAGED_FILES_SQL = T.with_tables(f"""
, sizes AS (SELECT archive_id, dir_id, (sum(byte_length) + {_W('n')})::BIGINT AS b FROM t_dir_values GROUP BY 1, 2, n),
st AS (SELECT *, b + CASE WHEN archive_id % 2 = 1 THEN {_WRAP} + 8 ELSE 0 END AS stored FROM sizes),
places AS (SELECT *, 1000 + coalesce(sum(stored) OVER (PARTITION BY archive_id ORDER BY dir_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM st),
r AS (SELECT archive_id, unnest(range(1003, max(place + stored), 997)) AS s FROM places GROUP BY 1),
h AS (SELECT p.archive_id, p.dir_id, p.b, r.s AS damage_start, greatest(r.s - p.place, 0) AS stored_start FROM places p JOIN r ON p.archive_id = r.archive_id AND r.s < p.place + p.stored AND r.s + 40 > p.place),
g AS (SELECT *, CASE WHEN archive_id % 2 = 1 THEN least(greatest(stored_start - {_WRAP}, 0), b) ELSE stored_start END AS safe FROM h),
l AS (SELECT g.archive_id, g.dir_id, damage_start, count(*)::BIGINT AS n_lost, arg_min(col, byte_offset) AS col, arg_min(i, byte_offset) AS i
  FROM g JOIN t_dir_values v ON g.archive_id = v.archive_id AND g.dir_id = v.dir_id AND byte_offset + byte_length > safe GROUP BY 1, 2, 3)
SELECT g.archive_id, g.dir_id, g.damage_start, stored_start, safe, coalesce(n_lost, 0) AS n_lost, col, i FROM g LEFT JOIN l
  ON g.archive_id = l.archive_id AND g.dir_id = l.dir_id AND g.damage_start = l.damage_start""", "t_dir_values")


def damaged_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections hit by a damaged stretch of every archive's file."""
    a = T.archives(spark, d)
    ranges = a.selectExpr("archive_id", "archive_id * 7919 % 60000 AS damage_start", "archive_id * 7919 % 60000 + 300 AS damage_end")
    return DM.damaged_sections(ranges, a).select("archive_id", "section", "hit")


SECTIONS_HIT_SQL = T.with_tables("""
SELECT archive_id, section, least(s + 300, e) - greatest(s, b) AS hit FROM (SELECT archive_id, archive_id * 7919 % 60000 AS s,
  unnest(['header', 'rootDirectory', 'metadata', 'leafDirectories', 'tileData']) AS section, unnest([0, root_offset, meta_offset, leaf_offset, tile_offset]) AS b,
  unnest([127, root_offset + root_length, meta_offset + meta_length, leaf_offset + leaf_length, tile_offset + tile_length]) AS e FROM t_archives)
WHERE least(s + 300, e) - greatest(s, b) > 0""", "t_archives")


def same_entries(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of the entries compared: the second lost some rows and changed others."""
    a = T.placed(spark, d).select("archive_id", "tile_id", "run_length", "offset", "length")
    b = a.filter("tile_id % 17 <> 3").withColumn("length", F.when(F.col("tile_id") % 19 == 4, F.col("length") + 1).otherwise(F.col("length")))
    return D.same_entries(a, b)


SAME_SQL = T.with_tables("""
, a AS (SELECT archive_id, tile_id, run_length, "offset", length FROM t_placed),
b AS (SELECT archive_id, tile_id, run_length, "offset", length + CASE WHEN tile_id % 19 = 4 THEN 1 ELSE 0 END AS length FROM a WHERE tile_id % 17 <> 3)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL
SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""", "t_placed")


def sample_tiles(spark: SparkSession, d: str) -> DataFrame:
    """One existing tile of each archive, chosen at random with a fixed seed."""
    return D.sample_existing(T.entries(spark, d), seed=42)


SAMPLE_SQL = T.with_tables("""
SELECT archive_id, e.tile_id AS entry_tile_id, e.tile_id + (e.m * 16807 + 42) % e.run_length AS tile_id FROM (
  SELECT archive_id, arg_min({'tile_id': tile_id, 'run_length': run_length, 'm': m}, (m, tile_id)) AS e FROM (
    SELECT *, (tile_id % 2147483647 * 48271 + 42) % 2147483647 AS m FROM t_entries) GROUP BY 1)""", "t_entries")


QUERIES = {
    "run_length_entries": (run_length_entries, ENTRIES_SQL),
    "run_length_small_buckets": (run_length_small_buckets, ENTRIES_SQL),
    "expand_runs": (expand_runs, EXPAND_SQL),
    "run_ends": (run_ends, RUN_ENDS_SQL),
    "assign_offsets": (assign_offsets, OFFSETS_SQL),
    "pack_leaves": (pack_leaves, LEAVES_SQL),
    "offset_classes": (offset_classes, CLASSES_SQL),
    "offset_summary": (offset_summary, SUMMARY_SQL),
    "clustered_check": (clustered_check, CLUSTERED_SQL),
    "encode_directories": (encode_directories, ENCODE_SQL),
    "decode_directories": (decode_directories, DECODE_SQL),
    "encoded_values": (encoded_values, VALUES_SQL),
    "column_stats": (column_stats, STATS_SQL),
    "column_ranges": (column_ranges, RANGES_SQL),
    "size_comparison": (size_comparison, SIZES_SQL),
    "directory_issues": (directory_issues, ISSUES_SQL),
    "entry_intervals": (entry_intervals, INTERVALS_SQL),
    "directory_tree": (directory_tree, TREE_SQL),
    "entry_file_ranges": (entry_file_ranges, FILE_RANGES_SQL),
    "damaged_entries": (damaged_entries, DAMAGED_SQL),
    "damaged_files": (damaged_files, DAMAGED_FILES_SQL),
    "damaged_sections": (damaged_sections, SECTIONS_HIT_SQL),
    "same_entries": (same_entries, SAME_SQL),
    "sample_tiles": (sample_tiles, SAMPLE_SQL),
}

"""The read log: totals, budgets, caches, HTTP outcomes and the streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions.payload import PURPOSE_NAMES, SECTION_NAMES, is_mixed_content, purpose_name, section_name
from tesserix.operators import lookup as L
from tesserix.operators import reads as R
from tesserix.operators.lookup import zoom_gate
from tesserix.operators.ordered import floor_join
from tesserix.plans import q_archive  # noqa: F401  defines the sections in SQL
from tesserix.plans import tables as T
from tesserix.session import shared_folder
from tesserix.streaming import read_totals as S

_READS = """event_id AS id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS session_id, user_id AS archive_id,
  CASE event_type WHEN 'view' THEN 'tile-data' WHEN 'click' THEN 'leaf-directory' WHEN 'signup' THEN 'metadata' WHEN 'purchase' THEN 'viewer-inspect' ELSE 'size-probe' END AS purpose,
  CASE WHEN event_id % 4 = 0 THEN 'map' ELSE 'viewer' END AS initiator,
  CASE WHEN event_id % 9 IN (1, 2) THEN 0 ELSE event_id * 4099 % 60000 END AS offset, 64 + event_id % 4096 AS requested,
  CASE WHEN event_id % 97 = 0 THEN 'aborted' WHEN event_id % 89 = 0 THEN 'network' END AS error_kind, event_id % 40 AS leaf_id,
  CASE WHEN event_id % 101 = 0 THEN 'not a url' WHEN event_id % 4 = 1 THEN 'http://localhost:80/a'
    ELSE concat(CASE WHEN event_id % 3 = 0 THEN 'http' ELSE 'https' END, '://t', user_id % 50, '.example/') END AS url,
  CASE WHEN event_id % 2 = 0 THEN 'https://viewer.example/' ELSE 'http://viewer.example/' END AS page_url"""
_RECEIVED = """CASE WHEN error_kind IS NOT NULL OR purpose = 'size-probe' THEN 0 WHEN id % 11 = 0 THEN requested - id % 50 ELSE requested END AS received"""
_ETAG = "CASE id % 10 WHEN 0 THEN 'W/\"w\"' WHEN 1 THEN NULL ELSE concat('\"v', id {div} 3000, '\"') END"


def _exchange(method: str, mode: str, status: str, kind: str, cr: str = "NULL", cl: str = "NULL", etag: str = "NULL") -> str:
    headers = f"map('content-range', {cr}, 'content-length', CAST({cl} AS STRING), 'content-type', NULL, 'content-encoding', NULL, 'etag', {etag})"
    return (f"named_struct('method', '{method}', 'mode', '{mode}', 'range', concat('bytes=', offset, '-', offset + requested - 1), 'status', {status}, "
            f"'type', '{kind}', 'headers', CAST({headers} AS MAP<STRING, STRING>))")


def _exchanges() -> str:
    tag = _ETAG.format(div="div")
    ok = _exchange("GET", "cors", "206", "basic", "concat('bytes ', offset, '-', offset + requested - 1, '/1000000')", "requested", tag)
    v = {1: [_exchange("GET", "cors", "416", "cors", "'bytes */468'"), ok], 2: [_exchange("GET", "cors", "200", "basic", cl="requested + 5000")],
         3: [_exchange("GET", "cors", "200", "cors", cl="requested - 10")], 4: [_exchange("GET", "cors", "404", "cors")],
         7: [_exchange("GET", "cors", "206", "cors", cl="requested", etag=tag)]}
    failed, probe = _exchange("GET", "cors", "0", "error"), [_exchange("HEAD", "no-cors", "0", k) for k in ("opaque", "error")]
    cases = " ".join(f"WHEN {n} THEN array({', '.join(e)})" for n, e in v.items())
    return (f"CASE WHEN id % 27 = 1 THEN array({_exchange('GET', 'cors', '416', 'cors')}) ELSE CASE id % 9 {cases} "
            f"WHEN 5 THEN CASE WHEN id % 2 = 0 THEN array({failed}, {probe[1]}) ELSE array({failed}, {probe[0]}) END ELSE array({ok}) END END AS exchanges")


def as_reads(events: DataFrame, *more: str) -> DataFrame:
    """t_reads from ``events``; works on a batch and on a stream alike."""
    return events.selectExpr(*[c.strip() for c in _split(_READS)], *more).selectExpr("*", _RECEIVED).selectExpr("*", _exchanges())


def _split(text: str) -> list[str]:
    """Select list -> items (commas inside parentheses stay)."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth and text[:i].count(" AS ") > len(out):
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def reads(spark: SparkSession, d: str) -> DataFrame:
    return as_reads(T.read(spark, d, "events").select("event_id", "user_id", "event_type"))


T.CTES["t_reads"] = (f"""SELECT *, {_ETAG.format(div='//')} AS tag, CASE WHEN id % 27 = 1 OR id % 9 NOT IN (1, 5) THEN 1 ELSE 2 END AS n_ex,
  {_RECEIVED} FROM (SELECT {_READS.replace(' AS offset', ' AS "offset"')} FROM events)""", [])


def read_totals(spark: SparkSession, d: str) -> DataFrame:
    """Bytes per session and what they were for, with the share of a known archive size."""
    t = R.read_totals(reads(spark, d), ["session_id"])
    sizes = T.archives(spark, d).select(F.col("archive_id").alias("session_id"), F.col("file_size").alias("size"))
    return R.read_ratio(t, sizes, "session_id").withColumn("read_ratio", F.round("read_ratio", 6))


def _sum(cond: str) -> str:
    return f"coalesce(sum(received) FILTER (WHERE {cond}), 0)::BIGINT"


TOTALS_SQL = T.with_tables(f"""
SELECT t.*, round(needed / file_size::DOUBLE, 6) AS read_ratio FROM (
  SELECT session_id, {_sum("purpose NOT IN ('viewer-inspect', 'size-probe')")} AS needed, {_sum("purpose = 'viewer-inspect'")} AS inspected,
    {_sum("initiator = 'map'")} AS map_bytes, sum(received)::BIGINT AS total, count(*)::BIGINT AS n_reads, sum(n_ex)::BIGINT AS n_requests
  FROM t_reads GROUP BY 1) t LEFT JOIN t_archives a ON t.session_id = a.archive_id""", "t_reads", "t_archives")


def read_legend(spark: SparkSession, d: str) -> DataFrame:
    """Successful reads by lane and purpose with subtotals."""
    return R.read_legend(reads(spark, d))


LEGEND_SQL = T.with_tables("SELECT initiator, purpose, count(*)::BIGINT AS n, sum(received)::BIGINT AS bytes FROM t_reads "
                           "WHERE error_kind IS NULL AND received > 0 GROUP BY ROLLUP (initiator, purpose)", "t_reads")


def map_summary(spark: SparkSession, d: str) -> DataFrame:
    """What drawing maps cost each session."""
    return R.map_summary(reads(spark, d), ["session_id"])


MAP_SQL = T.with_tables("""
SELECT session_id, count(*) FILTER (WHERE error_kind IS NULL AND purpose = 'tile-data')::BIGINT AS tile_reads,
  count(*) FILTER (WHERE error_kind IS NULL AND purpose = 'leaf-directory')::BIGINT AS leaf_reads,
  count(*) FILTER (WHERE error_kind = 'aborted')::BIGINT AS aborted, coalesce(sum(received) FILTER (WHERE error_kind IS NULL), 0)::BIGINT AS bytes
FROM t_reads WHERE initiator = 'map' GROUP BY 1""", "t_reads")


def leaf_read_or_cache(spark: SparkSession, d: str) -> DataFrame:
    """Whether each leaf request read the leaf or shared an earlier read."""
    r = reads(spark, d).filter("purpose = 'leaf-directory'")
    return R.leaf_origin(r, ["session_id", "leaf_id"]).select("id", "session_id", "leaf_id", "how")


LEAF_SQL = T.with_tables("""
SELECT id, session_id, leaf_id, CASE WHEN error_kind IS NULL THEN CASE WHEN row_number() OVER (
  PARTITION BY session_id, leaf_id, error_kind IS NULL ORDER BY id) = 1 THEN 'read' ELSE 'cache' END END AS how
FROM t_reads WHERE purpose = 'leaf-directory'""", "t_reads")


def read_budget(spark: SparkSession, d: str) -> DataFrame:
    """What each request costs cold and what it added: first read, leaf, tile."""
    tree = T.leaves(spark, d)
    sizes = tree.filter("run_length = 0").select("archive_id", F.col("offset").alias("dir_id"), F.col("length").alias("leaf_bytes"))
    runs = tree.filter("run_length > 0").join(sizes, ["archive_id", "dir_id"], "left").select(
        "archive_id", "tile_id", "run_length", F.col("length").alias("tile_bytes"), F.when(F.col("dir_id") >= 0, F.col("dir_id")).alias("leaf_id"), "leaf_bytes")
    asked = zoom_gate(T.requests(spark, d), T.archives(spark, d))
    asked = asked.select("request_id", "archive_id", F.when(F.col("in_zoom"), F.col("target")).alias("target"))
    found = floor_join(asked, runs, ["archive_id"], "target", "tile_id", "e")
    hit = F.col("target") - F.col("e.tile_id") < F.col("e.run_length")
    traces = found.select(
        F.col("request_id").alias("id"), F.col("archive_id").alias("session_id"), F.lit(16384).cast("bigint").alias("open_bytes"),
        "e.leaf_id", "e.leaf_bytes", F.when(hit, F.col("e.tile_bytes")).alias("tile_bytes"))
    return R.read_budget(traces).select("session_id", "id", "how", "cold_bytes", "fresh_bytes")


BUDGET_SQL = T.with_tables("""
, t AS (SELECT r.request_id AS id, r.archive_id AS session_id, CASE WHEN d.leaves > 1 THEN d.leaf_no END AS leaf,
    CASE WHEN d.leaves > 1 THEN d.length END AS leaf_bytes, CASE WHEN r.target - e.tile_id < e.run_length THEN e.length END AS tile_bytes
  FROM (SELECT r.request_id, r.archive_id, CASE WHEN r.z BETWEEN a.min_zoom AND a.max_zoom THEN r.target END AS target
    FROM t_requests r LEFT JOIN t_archives a ON r.archive_id = a.archive_id) r
  ASOF LEFT JOIN t_numbered e ON r.archive_id = e.archive_id AND r.target >= e.tile_id
  LEFT JOIN t_leaf_dirs d ON e.archive_id = d.archive_id AND e.leaf_no = d.leaf_no),
h AS (SELECT *, CASE WHEN leaf IS NOT NULL THEN CASE WHEN row_number() OVER (PARTITION BY session_id, leaf ORDER BY id) = 1 THEN 'read' ELSE 'cache' END END AS how FROM t)
SELECT session_id, id, how, 16384 + coalesce(leaf_bytes, 0) + coalesce(tile_bytes, 0) AS cold_bytes,
  CASE WHEN how = 'read' THEN leaf_bytes ELSE 0 END + coalesce(tile_bytes, 0) AS fresh_bytes FROM h""", "t_requests", "t_archives", "t_numbered", "t_leaf_dirs")


def read_budget_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per archive: requests, and exact percentiles of what they cost cold and added. Costs are grouped by value first, so an
    archive with most of the requests brings one row per different cost."""
    b = read_budget(spark, d)

    def shares(column: str) -> DataFrame:
        few = b.groupBy("session_id", column).agg(F.count(F.lit(1)).alias("c"))
        return few.groupBy("session_id").agg(F.sum("c").alias("n"), F.sum(F.col(column) * F.col("c")).alias(f"sum_{column}"), *[
            F.percentile(column, p, F.col("c")).alias(f"{column}_p{int(100 * p)}") for p in (0.5, 0.9, 0.99)])

    return shares("cold_bytes").join(shares("fresh_bytes").drop("n"), "session_id")


BUDGET_SUMMARY_SQL = "SELECT session_id, count(*)::BIGINT AS n, " + ", ".join(
    f"sum({c})::BIGINT AS sum_{c}, " + ", ".join(f"quantile_cont({c}, {p})::DOUBLE AS {c}_p{int(100 * p)}" for p in (0.5, 0.9, 0.99))
    for c in ("cold_bytes", "fresh_bytes")) + f" FROM ({BUDGET_SQL}) GROUP BY 1"


def reads_of_traces(spark: SparkSession, d: str) -> DataFrame:
    """Reads that a trace used, by purpose."""
    r = reads(spark, d)
    steps = r.filter("id % 5 = 0").selectExpr("session_id", "CASE WHEN id % 10 = 0 THEN id ELSE id + 1 END AS read_id")
    return R.reads_of_traces(r, steps).groupBy("purpose").agg(F.count(F.lit(1)).alias("n"), F.sum("received").alias("bytes"))


TRACES_SQL = T.with_tables("""SELECT purpose, count(*)::BIGINT AS n, sum(received)::BIGINT AS bytes FROM t_reads r WHERE EXISTS (
  SELECT 1 FROM t_reads s WHERE s.id % 5 = 0 AND s.session_id = r.session_id AND CASE WHEN s.id % 10 = 0 THEN s.id ELSE s.id + 1 END = r.id) GROUP BY 1""", "t_reads")


def reads_by_section(spark: SparkSession, d: str) -> DataFrame:
    """Bytes read from every section of every archive."""
    return R.reads_by_section(reads(spark, d), T.archives(spark, d))


BY_SECTION_SQL = T.with_tables("""
SELECT archive_id, section, purpose, sum(b)::BIGINT AS bytes, count(*)::BIGINT AS n FROM (
  SELECT r.archive_id, s.name AS section, purpose, least(r."offset" + received, s."offset" + s.length) - greatest(r."offset", s."offset") AS b
  FROM t_reads r JOIN (SELECT archive_id, name, "offset", length FROM t_sections UNION ALL SELECT archive_id, 'firstRead', 0, 16384 FROM t_archives) s
    ON r.archive_id = s.archive_id WHERE error_kind IS NULL AND received > 0) WHERE b > 0 GROUP BY 1, 2, 3""", "t_reads", "t_sections", "t_archives")


def section_names(spark: SparkSession, d: str) -> DataFrame:
    """Bytes read by section and purpose over all archives, by their names."""
    by = R.reads_by_section(reads(spark, d), T.archives(spark, d)).groupBy("section", "purpose").agg(F.sum("bytes").alias("bytes"))
    return by.select(section_name("section").alias("section"), purpose_name("purpose").alias("purpose"), "bytes")


def _words(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE 'undefined(' || {column} || ')' END"


NAMES_SQL = f"SELECT {_words('section', SECTION_NAMES)} AS section, {_words('purpose', PURPOSE_NAMES)} AS purpose, sum(bytes)::BIGINT AS bytes FROM ({BY_SECTION_SQL}) GROUP BY 1, 2"


def short_reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads that ended early."""
    return R.short_reads(reads(spark, d)).select("id", "session_id", "requested", "received")


SHORT_SQL = T.with_tables("SELECT id, session_id, requested, received FROM t_reads WHERE error_kind IS NULL AND received < requested", "t_reads")


def compare_plans(spark: SparkSession, d: str) -> DataFrame:
    """Two logs of the same sessions: one lost a read now and then and has longer reads elsewhere."""
    a = reads(spark, d).select("session_id", "id", "purpose", "offset", "requested", "received")
    b = a.filter("session_id % 2 = 0 OR id % 3001 <> 1000").withColumn("requested", F.when(F.col("id") % 53 == 7, F.col("requested") + 1).otherwise(F.col("requested")))
    out = R.compare_plans(a, b, ["session_id"])
    return out.select("session_id", "position", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("purpose", "requested")])


COMPARE_SQL = T.with_tables("""
, a AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS position FROM t_reads),
b AS (SELECT session_id, purpose, "offset", received, requested + CASE WHEN id % 53 = 7 THEN 1 ELSE 0 END AS requested,
  row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS position FROM t_reads WHERE session_id % 2 = 0 OR id % 3001 <> 1000)
SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.position, b.position) AS position, a.purpose AS left_purpose, a.requested AS left_requested,
  b.purpose AS right_purpose, b.requested AS right_requested FROM a FULL JOIN b ON a.session_id = b.session_id AND a.position = b.position
WHERE (a.purpose, a."offset", a.requested, a.received) IS DISTINCT FROM (b.purpose, b."offset", b.requested, b.received)""", "t_reads")


def http_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Responses behind the reads, what they amount to, and why reads failed."""
    r = reads(spark, d).select("received", R.status_chain().alias("chain"), R.range_outcome().alias("outcome"), R.failure_class().alias("failure"))
    return r.groupBy("chain", "outcome", "failure").agg(F.count(F.lit(1)).alias("n"), F.sum("received").alias("bytes"))


HTTP_SQL = T.with_tables("""
SELECT chain, outcome, CASE WHEN error_kind = 'aborted' THEN 'aborted' WHEN id % 101 = 0 THEN 'invalid-url'
    WHEN v = 5 THEN CASE WHEN id % 2 = 0 AND id % 4 <> 1 AND id % 3 = 0 THEN 'mixed-content' WHEN id % 2 = 0 THEN 'network' ELSE 'cors' END
    WHEN outcome IN ('range-not-supported', 'http-status') THEN outcome ELSE error_kind END AS failure, count(*)::BIGINT AS n, sum(received)::BIGINT AS bytes
FROM (SELECT *, CASE WHEN id % 27 = 1 THEN '416' WHEN v = 1 THEN '416 → 206' WHEN v IN (2, 3) THEN '200' WHEN v = 4 THEN '404'
    WHEN v = 5 THEN CASE WHEN id % 2 = 0 THEN 'failed → failed(probe)' ELSE 'failed → opaque(probe)' END ELSE '206' END AS chain,
  CASE WHEN id % 27 = 1 OR v = 2 THEN 'range-not-supported' WHEN v = 1 THEN 'ok-after-416' WHEN v = 3 THEN 'whole-file' WHEN v = 4 THEN 'http-status'
    WHEN v = 5 THEN 'failed' ELSE 'ok' END AS outcome FROM (SELECT *, id % 9 AS v FROM t_reads)) GROUP BY 1, 2, 3""", "t_reads")


def etag_changes(spark: SparkSession, d: str) -> DataFrame:
    """Reads that saw another version of the file than the session began with."""
    return R.etag_changes(reads(spark, d), ["session_id", "url"])


ETAG_SQL = T.with_tables("""
SELECT * FROM (SELECT session_id, url, id, tag AS etag, first_value(tag) OVER (PARTITION BY session_id, url ORDER BY id) AS first_etag
  FROM t_reads WHERE tag IS NOT NULL AND tag NOT LIKE 'W/%' AND id % 9 IN (0, 1, 6, 7, 8) AND id % 27 <> 1) WHERE etag <> first_etag""", "t_reads")


def read_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How every read ended, a file that changed under its session among the ways."""
    return R.read_outcomes(reads(spark, d), ["session_id", "url"]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


OUTCOMES_SQL = T.with_tables("""
, v AS (SELECT *, id % 9 AS v FROM t_reads),
o AS (SELECT *, CASE WHEN id % 27 = 1 OR v = 2 THEN 'range-not-supported' WHEN v = 1 THEN 'ok-after-416' WHEN v = 3 THEN 'whole-file' WHEN v = 4 THEN 'http-status'
  WHEN v = 5 THEN 'failed' ELSE 'ok' END AS outcome FROM v),
c AS (SELECT id FROM (SELECT id, tag, first_value(tag) OVER (PARTITION BY session_id, url ORDER BY id) AS first_etag
  FROM t_reads WHERE tag IS NOT NULL AND tag NOT LIKE 'W/%' AND id % 9 IN (0, 1, 6, 7, 8) AND id % 27 <> 1) WHERE tag <> first_etag)
SELECT CASE WHEN id IN (SELECT id FROM c) THEN 'etag-changed' ELSE outcome END AS outcome, count(*)::BIGINT AS n FROM o GROUP BY 1""", "t_reads")


def hidden_headers(spark: SparkSession, d: str) -> DataFrame:
    """Missing response headers by reason."""
    return R.hidden_headers(reads(spark, d)).groupBy("header", "reason").agg(F.count(F.lit(1)).alias("n"))


HIDDEN_SQL = T.with_tables("""
, ex AS (SELECT id, id % 9 AS v, tag, unnest(CASE WHEN id % 27 = 1 THEN ['416'] WHEN id % 9 = 1 THEN ['416', '206'] WHEN id % 9 IN (2, 3) THEN ['200']
    WHEN id % 9 = 4 THEN ['404'] WHEN id % 9 = 5 THEN ['fail', 'probe'] ELSE ['206'] END) AS s FROM t_reads),
h AS (SELECT *, unnest(['content-range', 'content-length', 'content-type', 'content-encoding', 'etag']) AS header, v IN (3, 4, 7) OR s = '416' AS cors FROM ex)
SELECT header, CASE WHEN NOT cors THEN 'absent' WHEN header = 'content-range' AND s = '206' THEN 'hidden' WHEN header IN ('content-length', 'content-type') THEN 'absent'
  ELSE 'absent-or-hidden' END AS reason, count(*)::BIGINT AS n FROM h
WHERE CASE header WHEN 'content-range' THEN NOT (s = '206' AND v <> 7 OR s = '416' AND id % 27 <> 1) WHEN 'content-length' THEN s NOT IN ('206', '200')
  WHEN 'etag' THEN NOT (s = '206' AND tag IS NOT NULL) ELSE TRUE END GROUP BY 1, 2""", "t_reads")


def mixed_content(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose address an https page may not read."""
    p = T.read(spark, d, "pages").selectExpr("page_id", "CASE WHEN page_id % 2 = 0 THEN 'https://viewer.example/a/' ELSE 'http://localhost:5173/' END AS page",
                                             "CASE page_id % 7 WHEN 0 THEN 'http://localhost:8080/x' WHEN 1 THEN 'http://127.0.0.1:8080/x' WHEN 2 THEN 'data/x' ELSE url END AS url")
    return p.select("page_id", is_mixed_content("page", "url").alias("mixed"))


MIXED_SQL = "SELECT page_id, page_id % 2 = 0 AND page_id % 7 > 2 AND url LIKE 'http://%' AS mixed FROM pages"


#: Stretches of time the log arrives in, and files of each at most.
PARTS, PART_FILES = 6, 4
_LOGS: dict[tuple[str, str], tuple[str, int]] = {}


def _log(spark: SparkSession, d: str) -> tuple[str, int]:
    """(folder, seconds of a stretch): the log as it would arrive, one stretch of time after the other."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _LOGS:
        folder = shared_folder(spark, "log")
        events = T.read(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
        first, last = events.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
        step = (last - first) // PARTS + 1
        part = F.floor((F.unix_seconds("ts") - first) / step)
        for n in range(PARTS):
            events.filter(part == n).repartition(PART_FILES).write.mode("append").parquet(folder)
        _LOGS[key] = folder, step
    return _LOGS[key]


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The log as a stream, a few files a batch, and how late a read of it can be: a stretch of time, a day at least."""
    folder, step = _log(spark, d)
    events = spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", PART_FILES).parquet(folder)
    return as_reads(events, "ts"), f"{max(step, 86400)} seconds"


def streaming_read_totals(spark: SparkSession, d: str) -> DataFrame:
    """Live totals drained to the end of the log: equal to the batch totals."""
    stream, late = _stream(spark, d)
    return S.latest_totals(stream, S.KEYS, "ts", late)


STREAM_SQL = T.with_tables("SELECT purpose, initiator, sum(received)::BIGINT AS bytes, count(*)::BIGINT AS n FROM t_reads GROUP BY 1, 2", "t_reads")


def streaming_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    """The same per day, from windows whose state ended on the way."""
    stream, late = _stream(spark, d)
    path, _ = S.drained(S.windowed_totals(stream, S.KEYS, "ts", late), "daily-totals", "update")
    rows = S.latest_windows(path, stream, S.KEYS)
    return rows.select(F.unix_date(F.to_date("start")).cast("bigint").alias("day"), *S.KEYS, "bytes", "n")


DAILY_SQL = T.with_tables("""SELECT datediff('day', DATE '1970-01-01', e.ts::DATE) AS day, purpose, initiator, sum(received)::BIGINT AS bytes, count(*)::BIGINT AS n
FROM t_reads r JOIN events e ON r.id = e.event_id GROUP BY 1, 2, 3""", "t_reads")


def streaming_first_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves each session has read, as they first arrive on a day."""
    stream, late = _stream(spark, d)
    path, _ = S.drained(S.first_leaf_reads(stream, "ts", late).select("session_id", "day", "leaf_id"), "first-leaves", "append")
    return spark.read.parquet(path).select("session_id", "leaf_id").distinct()


FIRST_LEAVES_SQL = T.with_tables("SELECT DISTINCT session_id, leaf_id FROM t_reads WHERE purpose = 'leaf-directory' AND error_kind IS NULL", "t_reads")

QUERIES = {
    "read_totals": (read_totals, TOTALS_SQL),
    "read_legend": (read_legend, LEGEND_SQL),
    "map_summary": (map_summary, MAP_SQL),
    "leaf_read_or_cache": (leaf_read_or_cache, LEAF_SQL),
    "read_budget": (read_budget, BUDGET_SQL),
    "read_budget_summary": (read_budget_summary, BUDGET_SUMMARY_SQL),
    "reads_of_traces": (reads_of_traces, TRACES_SQL),
    "reads_by_section": (reads_by_section, BY_SECTION_SQL),
    "section_names": (section_names, NAMES_SQL),
    "read_outcomes": (read_outcomes, OUTCOMES_SQL),
    "short_reads": (short_reads, SHORT_SQL),
    "compare_plans": (compare_plans, COMPARE_SQL),
    "http_outcomes": (http_outcomes, HTTP_SQL),
    "etag_changes": (etag_changes, ETAG_SQL),
    "hidden_headers": (hidden_headers, HIDDEN_SQL),
    "mixed_content": (mixed_content, MIXED_SQL),
    "streaming_read_totals": (streaming_read_totals, STREAM_SQL),
    "streaming_daily_totals": (streaming_daily_totals, DAILY_SQL),
    "streaming_first_leaves": (streaming_first_leaves, FIRST_LEAVES_SQL),
}

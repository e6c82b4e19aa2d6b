"""Tile payloads: what the bytes are, what was declared, how large the pictures are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserix.functions import payload as P
from tesserix.plans import tables as T
from tesserix.sources.codecs import compress, decompress


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """t_payloads(payload_id, payload, declared_type, declared_compression, n_chars): whole documents and pages as bytes,
    behind one of thirteen beginnings."""
    doc = T.read(spark, d, "documents").select("doc_id", "text", "n_chars")
    start = F.expr("""CASE doc_id % 13 WHEN 1 THEN X'1F8B0800' WHEN 2 THEN X'28B52FFD' WHEN 3 THEN X'89504E470D0A1A0A' WHEN 4 THEN X'FFD8FFE0'
      WHEN 5 THEN X'524946460000000057454250' WHEN 6 THEN X'0000001C6674797061766966' WHEN 7 THEN X'0000001C6674797061766973' WHEN 8 THEN X'1A05'
      WHEN 9 THEN X'000102' WHEN 10 THEN X'FF' WHEN 12 THEN X'09' ELSE X'' END""")
    blob = F.when(F.col("doc_id") % 13 == 11, F.lit(b"")).otherwise(F.concat(start, F.encode("text", "UTF-8")))
    out = doc.select(F.col("doc_id").alias("payload_id"), blob.alias("payload"), F.expr("CAST(doc_id % 8 AS INT)").alias("declared_type"),
                     F.expr("CAST(doc_id % 6 AS INT)").alias("declared_compression"))
    page = T.read(spark, d, "pages").select("page_id", "html")
    return out.unionByName(page.select((F.col("page_id") + 100000000000).alias("payload_id"), F.encode("html", "UTF-8").alias("payload"),
                                       F.lit(0).alias("declared_type"), F.lit(0).alias("declared_compression")))


T.CTES["t_payloads"] = (r"""
SELECT doc_id AS payload_id, (doc_id % 8)::INTEGER AS declared_type, (doc_id % 6)::INTEGER AS declared_compression,
  CASE WHEN doc_id % 13 = 11 THEN 0 ELSE [0, 4, 4, 8, 4, 12, 12, 12, 2, 3, 1, 0, 1][doc_id % 13 + 1] + strlen(text) END::BIGINT AS n_bytes,
  CASE WHEN doc_id % 13 IN (0, 12) THEN CASE WHEN strlen(text) + doc_id % 13 = 0 THEN 'empty' WHEN regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'unknown' ELSE 'text' END
    ELSE ['text', 'gzip', 'zstd', 'png', 'jpeg', 'webp', 'avif', 'avif', 'mvt-like', 'unknown', 'unknown', 'empty'][doc_id % 13 + 1] END AS kind
FROM documents
UNION ALL SELECT page_id + 100000000000, 0, 0, strlen(html),
  CASE WHEN html = '' THEN 'empty' WHEN regexp_matches(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') THEN 'unknown' ELSE 'text' END FROM pages""", [])


def payload_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kind of every payload with the bytes that decided it."""
    p = payloads(spark, d).select("payload_id", "payload", P.sniff("payload").alias("kind"))
    e = P.sniff_evidence("kind")
    return p.select("payload_id", "kind", F.octet_length("payload").cast("bigint").alias("n_bytes"),
                    e["offset"].cast("bigint").alias("evidence_at"), e["length"].cast("bigint").alias("evidence_length"))


KINDS_SQL = T.with_tables("""SELECT payload_id, kind, n_bytes, CASE WHEN kind = 'avif' THEN 4 WHEN kind NOT IN ('text', 'empty', 'unknown') THEN 0 END::BIGINT AS evidence_at,
  CASE kind WHEN 'gzip' THEN 2 WHEN 'zstd' THEN 4 WHEN 'png' THEN 8 WHEN 'jpeg' THEN 3 WHEN 'webp' THEN 12 WHEN 'avif' THEN 8 WHEN 'mvt-like' THEN 1 END::BIGINT AS evidence_length
FROM t_payloads""", "t_payloads")


def declared_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    """Declared compression and type against the bytes."""
    p = payloads(spark, d).withColumn("kind", P.sniff("payload"))
    return p.groupBy(P.compression_name("declared_compression").alias("compression"), P.compression_verdict("declared_compression", "kind").alias("compression_verdict"),
                     P.tile_type_name("declared_type").alias("tile_type"), P.tile_type_verdict("declared_type", "kind").alias("type_verdict")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("payload")).alias("bytes"))


DECLARED_SQL = T.with_tables("""
SELECT ['unknown', 'none', 'gzip', 'brotli', 'zstd', 'undefined(0x05)'][declared_compression + 1] AS compression,
  CASE WHEN declared_compression = 3 THEN 'na' WHEN declared_compression = 2 AND kind <> 'gzip' OR declared_compression = 4 AND kind <> 'zstd'
    OR declared_compression NOT IN (2, 4) AND kind IN ('gzip', 'zstd') THEN 'warn' ELSE 'ok' END AS compression_verdict,
  ['unknown/other', 'mvt', 'png', 'jpeg', 'webp', 'avif', 'mlt', 'undefined(0x07)'][declared_type + 1] AS tile_type,
  CASE WHEN declared_type NOT BETWEEN 1 AND 5 THEN 'na' WHEN kind = ['mvt-like', 'png', 'jpeg', 'webp', 'avif'][declared_type] THEN 'ok' ELSE 'warn' END AS type_verdict,
  count(*)::BIGINT AS n, sum(n_bytes)::BIGINT AS bytes FROM t_payloads GROUP BY 1, 2, 3, 4""", "t_payloads")


def payload_routing(spark: SparkSession, d: str) -> DataFrame:
    """Reader chosen for every payload; some could not be decompressed."""
    n = F.when(F.col("payload_id") % 29 != 7, F.octet_length("payload"))
    p = payloads(spark, d).select("declared_type", P.sniff("payload").alias("kind"), n.alias("n_bytes"), (F.col("payload_id") % 3).alias("n_layers"))
    r = P.route("declared_type", "kind", "n_bytes", "n_layers")
    return p.withColumn("r", r).groupBy("declared_type", "r.route", "r.reason").agg(F.count(F.lit(1)).alias("n"))


ROUTING_SQL = T.with_tables("""
SELECT declared_type, route, reason, count(*)::BIGINT AS n FROM (
  SELECT *, CASE WHEN reason IN ('declared', 'by-content') THEN CASE WHEN target = 'mvt' THEN 'mvt' ELSE 'raster' END ELSE 'raw' END AS route FROM (
    SELECT *, CASE WHEN payload_id % 29 = 7 THEN 'not-decompressed' WHEN declared_type = 6 THEN 'no-reader' WHEN declared_type > 6 THEN 'undefined-type'
      WHEN target IS NULL THEN 'unrecognised' WHEN target = 'mvt' AND payload_id % 3 = 0 AND n_bytes > 0 THEN 'no-layer'
      WHEN target <> 'mvt' AND target <> kind THEN 'mismatch' WHEN declared_type = 0 THEN 'by-content' ELSE 'declared' END AS reason FROM (
      SELECT *, CASE WHEN declared_type = 0 THEN CASE WHEN kind = 'mvt-like' THEN 'mvt' WHEN kind IN ('png', 'jpeg', 'webp', 'avif') THEN kind END
        ELSE ['mvt', 'png', 'jpeg', 'webp', 'avif'][declared_type] END AS target FROM t_payloads)))
GROUP BY 1, 2, 3""", "t_payloads")


def decompress_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents stored with gzip, zstd or nothing, some in two members or frames, and read back; some are cut short or
    declare a codec nobody has."""
    doc = T.read(spark, d, "documents").selectExpr(
        "doc_id", "encode(text, 'UTF-8') AS data", "CAST(element_at(array(0, 1, 2, 4, 3, 7), CAST(doc_id % 6 + 1 AS INT)) AS INT) AS codec")
    half = F.expr("CAST(octet_length(data) div 2 AS INT)")
    doc = doc.withColumns({"two": F.col("doc_id") % 5 == 1, "half": half})
    doc = doc.selectExpr("doc_id", "codec", "CASE WHEN two THEN substring(data, 1, half) ELSE data END AS head",
                         "CASE WHEN two THEN substring(data, half + 1, octet_length(data)) END AS tail")
    stored = compress(compress(doc.filter("tail IS NOT NULL"), "head", "codec", "a"), "tail", "codec", "b").withColumn("raw", F.concat("a", "b"))
    stored = stored.unionByName(compress(doc.filter("tail IS NULL"), "head", "codec", "raw"), allowMissingColumns=True).withColumn(
        "raw", F.when((F.col("doc_id") % 7 == 5) & F.col("codec").isin(2, 4), F.expr("substring(raw, 1, octet_length(raw) - 5)")).otherwise(F.col("raw")))
    out = decompress(stored.select("doc_id", "codec", "raw"), "raw", "codec")
    return out.select("doc_id", "codec", F.md5("payload").alias("md5"), "error", F.octet_length("payload").cast("bigint").alias("n_bytes"),
                      F.when(F.col("codec").isin(0, 1), P.size_ratio(F.octet_length("raw"), F.octet_length("payload"))).cast("double").alias("plain_ratio"))


DECOMPRESS_SQL = """
SELECT doc_id, codec, CASE WHEN error IS NULL THEN md5(text) END AS md5, error,
  CASE WHEN error IS NULL THEN strlen(text) END::BIGINT AS n_bytes,
  CASE WHEN codec IN (0, 1) AND strlen(text) > 0 THEN 1.0 END::DOUBLE AS plain_ratio FROM (
  SELECT *, CASE WHEN codec IN (3, 7) THEN 'unsupported' WHEN codec IN (2, 4) AND doc_id % 7 = 5 THEN 'broken' END AS error FROM (
    SELECT *, [0, 1, 2, 4, 3, 7][doc_id % 6 + 1]::INTEGER AS codec FROM documents))"""


def _be(value: Column, width: int) -> Column:
    return F.lpad(F.hex(value), 2 * width, "0")


def _le(value: Column, width: int) -> Column:
    h = _be(value, width)
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])


#: Bit depths and colour types the pictures take in turn.
_DEPTHS, _COLORS = (1, 2, 4, 8, 16), (0, 3, 3, 2, 6)


def rasters(spark: SparkSession, d: str) -> DataFrame:
    """One picture header per part, in nine forms, some broken."""
    p = T.read(spark, d, "part").selectExpr("p_partkey", "CAST(p_partkey % 9 AS INT) AS form", "1 + p_partkey % 499 AS w", "1 + CAST(p_size AS BIGINT) * 7 AS h",
                                            "CAST(p_partkey % 100 AS INT) AS segs", "CAST(p_partkey div 9 AS INT) AS k")
    w, h = F.col("w"), F.col("h")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be(w, 4), _be(h, 4), _be(F.element_at(F.array(*map(F.lit, _DEPTHS)), F.col("k") % 5 + 1), 1), _be(F.element_at(
        F.array(*map(F.lit, _COLORS)), F.col("k") % 5 + 1), 1), F.lit("0000"), _be(F.col("k") % 2, 1))
    riff = "5249464600000000574542505650"
    app = F.concat(F.lit("FFD8"), F.repeat(F.lit("FFE00004AAAA"), F.col("segs")))
    frame = F.concat(F.lit("001108"), _be(h, 2), _be(w, 2), F.lit("03"))
    forms = [png, F.substring(png, 1, 36), F.concat(F.lit(riff + "38201E000000" + "1020309D012A"), _le(w + 16384, 2), _le(h, 2)),
             F.concat(F.lit(riff + "384C1E000000" + "2F"), _le(w - 1 + (h - 1) * 16384, 4)),
             F.concat(F.lit(riff + "38580A000000" + "10000000"), _le(w - 1, 3), _le(h - 1, 3)),
             F.concat(app, F.lit("FFFFFFC0"), frame), F.concat(app, F.lit("FFD0FFC2"), frame), F.concat(app, F.lit("FFDA0008000000000000")),
             F.concat(F.lit(riff + "3F3F1E000000"), _le(w, 4))]
    body = F.lit(None).cast("string")
    for no, form in enumerate(forms):
        body = F.when(F.col("form") == no, form).otherwise(body)
    return p.select("p_partkey", F.unhex(body).alias("payload"))


def raster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Width and height of every picture from its header."""
    r = rasters(spark, d).select("p_partkey", P.raster_size("payload", P.sniff("payload")).alias("r"))
    return r.select("p_partkey", "r.*")


_RASTER_SQL = """
SELECT p_partkey, CASE WHEN form NOT IN (1, 7, 8) THEN 1 + p_partkey % 499 END::BIGINT AS width, CASE WHEN form NOT IN (1, 7, 8) THEN 1 + p_size::BIGINT * 7 END AS height,
  CASE form WHEN 2 THEN 'VP8' WHEN 3 THEN 'VP8L' WHEN 4 THEN 'VP8X' WHEN 5 THEN 'Baseline DCT' WHEN 6 THEN 'Progressive DCT' END AS variant,
  CASE form WHEN 5 THEN 192 WHEN 6 THEN 194 END AS marker,
  CASE form WHEN 1 THEN 'truncated' WHEN 7 THEN 'scan-before-size' WHEN 8 THEN 'unknown-chunk' END AS issue FROM (SELECT *, p_partkey % 9 AS form FROM part)"""


def png_headers(spark: SparkSession, d: str) -> DataFrame:
    """Bit depth, colour type and interlacing of every PNG; NULL where the header is cut short."""
    r = rasters(spark, d).filter(P.sniff("payload") == "png")
    return r.select("p_partkey", P.png_details("payload").alias("d")).select("p_partkey", "d.*")


PNG_SQL = f"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN {list(_DEPTHS)}[p_partkey // 9 % 5 + 1] END::INTEGER AS bit_depth,
  CASE WHEN p_partkey % 9 = 0 THEN {list(_COLORS)}[p_partkey // 9 % 5 + 1] END::INTEGER AS color_type,
  CASE WHEN p_partkey % 9 = 0 THEN p_partkey // 9 % 2 = 1 END AS interlaced FROM part WHERE p_partkey % 9 IN (0, 1)"""


def raster_audit(spark: SparkSession, d: str) -> DataFrame:
    """Pictures by kind and size: the groups that stand out are odd-sized tiles."""
    return raster_sizes(spark, d).groupBy("variant", "marker", "width", "height", "issue").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "payload_kinds": (payload_kinds, KINDS_SQL),
    "declared_vs_actual": (declared_vs_actual, DECLARED_SQL),
    "payload_routing": (payload_routing, ROUTING_SQL),
    "decompress_payloads": (decompress_payloads, DECOMPRESS_SQL),
    "raster_sizes": (raster_sizes, _RASTER_SQL),
    "png_headers": (png_headers, PNG_SQL),
    "raster_audit": (raster_audit, f"SELECT variant, marker, width, height, issue, count(*)::BIGINT AS n FROM ({_RASTER_SQL}) GROUP BY 1, 2, 3, 4, 5"),
}

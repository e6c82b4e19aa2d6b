"""Archive level: headers, file layout, counts, metadata and sizes. Everything here works inside one row per archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.functions.common import MAX_EXACT, lng
from tesserix.functions.payload import compression_name

# The archive header.
MAGIC = b"PMTiles"
HEADER_SIZE = 127
FIRST_READ = 16384
HEADER_FIELDS = [
    ("spec_version", 7, "u8"), ("root_offset", 8, "u64"), ("root_length", 16, "u64"), ("meta_offset", 24, "u64"),
    ("meta_length", 32, "u64"), ("leaf_offset", 40, "u64"), ("leaf_length", 48, "u64"), ("tile_offset", 56, "u64"),
    ("tile_length", 64, "u64"), ("n_addressed", 72, "u64"), ("n_entries", 80, "u64"), ("n_contents", 88, "u64"),
    ("clustered", 96, "u8"), ("internal_compression", 97, "u8"), ("tile_compression", 98, "u8"), ("tile_type", 99, "u8"),
    ("min_zoom", 100, "u8"), ("max_zoom", 101, "u8"), ("min_lon_e7", 102, "i32"), ("min_lat_e7", 106, "i32"),
    ("max_lon_e7", 110, "i32"), ("max_lat_e7", 114, "i32"), ("center_zoom", 118, "u8"), ("center_lon_e7", 119, "i32"),
    ("center_lat_e7", 123, "i32"),
]
#: Keys of the metadata object whose meaning the format defines (fixed values).
DEFINED_KEYS = ["vector_layers", "name", "description", "attribution", "type", "version", "encoding"]
SECTIONS = [("header", None), ("rootDirectory", "root"), ("metadata", "meta"), ("leafDirectories", "leaf"), ("tileData", "tile")]


def _little(digits: Column, pos: int, width: int) -> Column:
    """Unsigned little-endian integer of ``width`` bytes at ``pos``, from hex digits; NULL where they end before."""
    value = F.conv(F.concat(*[F.substring(digits, 2 * (pos + i) + 1, 2) for i in range(width - 1, -1, -1)]), 16, 10).cast("bigint")
    return F.when(F.length(digits) >= 2 * (pos + width), value)


def _u64(digits: Column, pos: int) -> Column:
    low, high = _little(digits, pos, 4), _little(digits, pos + 4, 4)
    return F.when(high <= MAX_EXACT >> 32, high * (1 << 32) + low)


def _i32(digits: Column, pos: int) -> Column:
    v = _little(digits, pos, 4)
    return (v - F.when(v >= 1 << 31, 1 << 32).otherwise(0)).cast("int")


def parse_headers(files: DataFrame, blob: str = "blob") -> DataFrame:
    """Header fields of each file's first bytes, and ``reason`` why a file is not a readable archive (else NULL)."""
    b, digits = F.col(blob), F.col("_digits")  # the header is turned to digits once, not once a field
    read = {"u8": lambda p: _little(digits, p, 1).cast("int"), "u64": lambda p: _u64(digits, p), "i32": lambda p: _i32(digits, p)}
    df = files.withColumn("_digits", F.hex(F.substring(b, F.lit(1), F.lit(HEADER_SIZE))))
    df = df.withColumns({name: read[kind](pos) for name, pos, kind in HEADER_FIELDS}).drop("_digits")
    large = F.lit(False)
    for name, _, kind in HEADER_FIELDS:
        if kind == "u64":
            large = large | F.col(name).isNull()
    reason = (F.when(F.octet_length(b) < HEADER_SIZE, "too-short")
              .when(F.substring(b, F.lit(1), F.lit(len(MAGIC))) != F.lit(MAGIC), "wrong-magic")
              .when(large, "too-large").when(F.col("spec_version") != 3, "unsupported-version"))
    return df.withColumn("reason", reason)


def split_headers(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable archives, rejected ones with their reason)"""
    names = [n for n, _, _ in HEADER_FIELDS]
    return parsed.filter("reason IS NULL").drop("reason"), parsed.filter("reason IS NOT NULL").drop(*names)


def header_hex() -> Column:
    """The header a row's columns describe, as hex digits (used to write archives in tests and derived tables)."""

    def little(c: Column, width: int) -> Column:
        digits = F.lpad(F.hex(c), 2 * width, "0")
        return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])

    width = {"u8": 1, "u64": 8, "i32": 4}
    mask = {"u8": 0xFF, "u64": (1 << 63) - 1, "i32": 0xFFFFFFFF}
    return F.concat(F.lit(MAGIC.hex().upper()),
                    *[little(lng(name).bitwiseAND(mask[kind]), width[kind]) for name, _, kind in HEADER_FIELDS])


def section_array() -> Column:
    """The five sections of an archive row in physical order: ARRAY<STRUCT(offset, length, no, name)>."""
    items = [F.struct((lng(0) if p is None else lng(f"{p}_offset")).alias("offset"),
                      (lng(HEADER_SIZE) if p is None else lng(f"{p}_length")).alias("length"),
                      F.lit(no).alias("no"), F.lit(name).alias("name")) for no, (name, p) in enumerate(SECTIONS)]
    return F.array_sort(F.array(*items))


def sections(archives: DataFrame) -> DataFrame:
    """(archive_id, position, name, offset, length) in physical order."""
    rows = archives.select("archive_id", F.posexplode(section_array()).alias("position", "s"))
    return rows.select("archive_id", "position", "s.name", "s.offset", "s.length")


_SEGMENT = "struct<kind:string,name:string,offset:bigint,length:bigint>"
_ISSUE = "struct<issue:string,section:string,previous:string>"


def _layout() -> Column:
    """Fold over the five sections: STRUCT(cursor, prev, segments, issues)."""
    size = F.col("file_size")
    state = f"struct<cursor:bigint,prev:string,segments:array<{_SEGMENT}>,issues:array<{_ISSUE}>>"

    def seg(kind: str, name: Column, offset: Column, length: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), offset.alias("offset"), length.alias("length")).cast(_SEGMENT)

    def issue(code: str, section: Column, previous: Column) -> Column:
        return F.struct(F.lit(code).alias("issue"), section.alias("section"), previous.alias("previous")).cast(_ISSUE)

    nothing = F.lit(None).cast("string")

    def keep(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda i: i.isNotNull())

    def step(a: Column, s: Column) -> Column:
        end, cursor = s["offset"] + s["length"], a["cursor"]
        # An empty section does not move the cursor, so the gap before it is reported again after it.
        gap = F.when(s["offset"] > cursor, seg("gap", nothing, cursor, s["offset"] - cursor))
        overlap = F.when((s["offset"] < cursor) & (s["length"] > 0) & a["prev"].isNotNull(), issue("overlap", s["name"], a["prev"]))
        beyond = F.when(end > size, issue("beyond-eof", s["name"], nothing))
        advance = (s["length"] > 0) & (end > cursor)
        return F.struct(
            F.when(advance, end).otherwise(cursor).alias("cursor"), F.when(advance, s["name"]).otherwise(a["prev"]).alias("prev"),
            F.concat(a["segments"], keep(gap, seg("section", s["name"], s["offset"], s["length"]))).alias("segments"),
            F.concat(a["issues"], keep(overlap, beyond)).alias("issues")).cast(state)

    def finish(a: Column) -> Column:
        tail = F.when(size > a["cursor"], seg("gap", nothing, a["cursor"], size - a["cursor"]))
        root = F.when(F.col("root_offset") + F.col("root_length") > FIRST_READ,
                      issue("root-outside-first-read", F.lit("rootDirectory"), nothing))
        return F.struct(F.concat(a["segments"], keep(tail)).alias("segments"), F.concat(a["issues"], keep(root)).alias("issues"))

    start = F.struct(lng(0).alias("cursor"), nothing.alias("prev"), F.array().cast(f"array<{_SEGMENT}>").alias("segments"),
                     F.array().cast(f"array<{_ISSUE}>").alias("issues")).cast(state)
    return F.aggregate(section_array(), start, step, finish)


def layout_segments(archives: DataFrame) -> DataFrame:
    """Sections and gaps of every file in order: (archive_id, position, kind, name, offset, length). No shuffle."""
    rows = archives.select("archive_id", F.posexplode(_layout()["segments"]).alias("position", "s"))
    return rows.select("archive_id", "position", "s.*")


def layout_issues(archives: DataFrame) -> DataFrame:
    """Overlaps, sections beyond the end of the file and roots outside the first read."""
    return archives.select("archive_id", F.inline(_layout()["issues"]))


def minimum_size() -> Column:
    """Smallest size the file can have, from the sections its header declares."""
    return F.greatest(lng(HEADER_SIZE), *[F.col(f"{p}_offset") + F.col(f"{p}_length") for _, p in SECTIONS if p])


def section_table(archives: DataFrame) -> DataFrame:
    """Segments with their last byte, share of the file and compression."""
    rows = archives.select("archive_id", "file_size", "internal_compression", "tile_compression",
                           F.inline(_layout()["segments"]))
    last = F.when(F.col("length") > 0, F.col("offset") + F.col("length") - 1)
    packed = (F.when(F.col("name") == "tileData", compression_name("tile_compression"))
              .when(F.col("name").isin("rootDirectory", "metadata", "leafDirectories"), compression_name("internal_compression")))
    return rows.select("archive_id", "kind", "name", "offset", "length", last.alias("last_byte"),
                       (F.col("length") / F.nullif(F.col("file_size"), lng(0))).alias("share"), packed.alias("compression"))


def counts_relation(archives: DataFrame) -> DataFrame:
    """How addressed tiles, entries and contents relate. All three zero means unknown, not empty."""
    a, e, c = F.col("n_addressed"), F.col("n_entries"), F.col("n_contents")

    def sign(x: Column, y: Column) -> Column:
        return F.when(x > y, ">").when(x < y, "<").otherwise("=")

    known = (a != 0) | (e != 0) | (c != 0)
    usual = known & (a >= e) & (e >= c) & (c > 0)
    return archives.select(
        "archive_id", known.alias("known"), F.when(known, sign(a, e)).alias("addressed_entries"),
        F.when(known, sign(e, c)).alias("entries_contents"), F.when(usual, a - e).alias("saved_by_runs"),
        F.when(usual, e - c).alias("saved_by_dedup"))


def reconcile_counts(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """Counts found in the directories next to the ones the header declares (0 there means unknown)."""
    found = entries.filter("run_length > 0").groupBy("archive_id").agg(
        F.sum("run_length").alias("found_addressed"), F.count(F.lit(1)).alias("found_entries"),
        F.countDistinct("offset").alias("found_contents"))
    declared = archives.select("archive_id", *[F.nullif(F.col(f"n_{n}"), lng(0)).alias(n) for n in ("addressed", "entries", "contents")])
    same = F.lit(True)
    for n in ("addressed", "entries", "contents"):
        same = same & F.coalesce(F.col(n) == F.col(f"found_{n}"), F.lit(True))
    return found.join(declared, "archive_id").withColumn("matches", same)


def valid_bounds() -> Column:
    """Whether the declared bounds are a real box on the map."""
    w, s, e, n = (F.col(c) for c in ("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7"))
    return (w < e) & (s < n) & (w >= -1800000000) & (e <= 1800000000) & (s >= -900000000) & (n <= 900000000)


def with_metadata(archives: DataFrame, blob: str = "metadata") -> DataFrame:
    """Add ``meta`` (VARIANT, NULL when unreadable) and ``json_ok``; the raw bytes stay."""
    text = F.col(blob).cast("string")
    meta = F.when(F.is_valid_utf8(text), F.try_parse_json(text))
    return archives.withColumn("meta", meta).withColumn("json_ok", F.col("meta").isNotNull())


def vector_layer_ids(meta: str = "meta") -> Column:
    """Ids of the declared vector layers that are strings; empty when there is no such list."""
    layers = F.coalesce(F.try_variant_get(F.col(meta), "$.vector_layers", "array<variant>"), F.array().cast("array<variant>"))
    ids = F.transform(layers, lambda v: F.try_variant_get(v, "$.id", "variant"))
    texts = F.filter(ids, lambda v: F.schema_of_variant(v) == "STRING")
    return F.transform(texts, lambda v: F.try_variant_get(v, "$", "string"))


def metadata_keys(archives: DataFrame, blob: str = "metadata") -> DataFrame:
    """(archive_id, key, defined): top-level keys of readable metadata, defined by the format or the writer's own."""
    ok = with_metadata(archives, blob).filter("json_ok")
    rows = ok.select("archive_id", F.explode(F.json_object_keys(F.col(blob).cast("string"))).alias("key"))
    return rows.withColumn("defined", F.col("key").isin(*DEFINED_KEYS))


def archive_size(archives: DataFrame) -> DataFrame:
    """Which size of an archive to trust, where it comes from and why not.

    Tried in order: local file, Content-Range total, complete response body, HEAD length. A HEAD length is refused when
    the response was encoded or is shorter than the header's sections need; it is exact only on the same origin.
    """
    head, least = F.col("head_length"), minimum_size()
    encoded = F.coalesce(F.col("head_encoding") != "identity", F.lit(False)) & (F.coalesce(F.col("head_encoding"), F.lit("")) != "")
    usable = head.isNotNull() & ~encoded & (head >= least)
    origin = (F.when(F.col("local_size").isNotNull(), "file").when(F.col("range_total").isNotNull(), "content-range")
              .when(F.col("body_length").isNotNull(), "full-body").when(usable, "head").otherwise("unknown"))
    reason = F.when(head.isNull(), "no-length").when(encoded, "encoded").when(head < least, "shorter-than-sections")
    out = archives.withColumn("origin", origin)
    return out.withColumns({
        "size": F.when(origin == "file", F.col("local_size")).when(origin == "content-range", F.col("range_total"))
        .when(origin == "full-body", F.col("body_length")).when(origin == "head", head),
        "exact": F.when(origin == "head", ~F.col("cross_origin")).when(origin != "unknown", F.lit(True)),
        "reason": F.when(origin == "unknown", reason)})


def drawability(archives: DataFrame) -> DataFrame:
    """How a map can draw each archive: (archive_id, drawn_as, note). Needs ``meta`` from ``with_metadata``."""
    t, n = F.col("tile_type"), F.size(vector_layer_ids())
    terrain = F.coalesce(F.try_variant_get(F.col("meta"), "$.encoding", "string") == "terrarium", F.lit(False))
    drawn = F.when(t.between(2, 5), "raster").when(t.isin(1, 6), F.when(n > 0, "vector").otherwise("none")).otherwise("none")
    note = (F.when(t.between(2, 5), F.when(terrain, "encoded-elevation"))
            .when(t.isin(1, 6), F.when(n == 0, "no-layer-names")).otherwise("type-not-drawable"))
    return archives.select("archive_id", drawn.alias("drawn_as"), note.alias("note"), n.cast("bigint").alias("n_layers"))

"""What a tile's bytes look like, and whether that agrees with what its archive declares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserix.functions.common import ColumnOrName, byte_at, col, let, lng, uint_be, uint_le

# Codes of the archive header.
COMPRESSION_NAMES = {0: "unknown", 1: "none", 2: "gzip", 3: "brotli", 4: "zstd"}
TILE_TYPE_NAMES = {0: "unknown/other", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif", 6: "mlt"}
RASTER_TYPES = {2: "png", 3: "jpeg", 4: "webp", 5: "avif"}


#: What the parts of an archive and the reasons for reading them are called.
SECTION_NAMES = {"header": "Header", "rootDirectory": "Root Directory", "metadata": "Metadata", "leafDirectories": "Leaf Directories", "tileData": "Tile Data"}
PURPOSE_NAMES = {"header+root": "Header + Root", "root-directory": "Root Directory", "metadata": "Metadata", "leaf-directory": "Leaf Directory",
                 "tile-data": "Tile Data", "viewer-inspect": "Viewer display", "size-probe": "Size probe (HEAD)", "other": "Other"}


def _worded(value: ColumnOrName, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return F.coalesce(F.try_element_at(table, col(value)), F.concat(F.lit("undefined("), col(value), F.lit(")")))


def section_name(section: ColumnOrName) -> Column:
    return _worded(section, SECTION_NAMES)


def purpose_name(purpose: ColumnOrName) -> Column:
    """Name of a read's purpose; purposes nobody defined stay visible as undefined(..)."""
    return _worded(purpose, PURPOSE_NAMES)


def _named(code: ColumnOrName, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    c = col(code).cast("int")
    unknown = F.concat(F.lit("undefined(0x"), F.lower(F.lpad(F.hex(c), 2, "0")), F.lit(")"))
    return F.coalesce(F.try_element_at(table, c), unknown)


def compression_name(code: ColumnOrName) -> Column:
    """Name of a compression code; codes the format does not define stay visible as undefined(0x..)."""
    return _named(code, COMPRESSION_NAMES)


def tile_type_name(code: ColumnOrName) -> Column:
    return _named(code, TILE_TYPE_NAMES)


def is_text(blob: ColumnOrName) -> Column:
    """Valid UTF-8 without control characters other than tab, line feed and carriage return."""
    text = col(blob).cast("string")
    return F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def sniff(blob: ColumnOrName) -> Column:
    """Kind of content judged by its first bytes alone. The order of the tests is part of the result."""
    b = col(blob)

    def at(pos: int, sig: bytes) -> Column:
        return F.substring(b, F.lit(pos + 1), F.lit(len(sig))) == F.lit(sig)

    # Signatures of the formats.
    return (F.when(F.octet_length(b) == 0, "empty")
            .when(at(0, b"\x1f\x8b"), "gzip")
            .when(at(0, b"\x28\xb5\x2f\xfd"), "zstd")
            .when(at(0, b"\x89PNG\r\n\x1a\n"), "png")
            .when(at(0, b"\xff\xd8\xff"), "jpeg")
            .when(at(0, b"RIFF") & at(8, b"WEBP"), "webp")
            .when(at(4, b"ftyp") & (at(8, b"avif") | at(8, b"avis")), "avif")
            .when(at(0, b"\x1a"), "mvt-like")
            .when(is_text(b), "text")
            .otherwise("unknown"))


def sniff_evidence(kind: ColumnOrName) -> Column:
    """STRUCT(offset, length) of the bytes that decided ``sniff``; NULL for kinds judged by the whole content."""
    spans = {"gzip": (0, 2), "zstd": (0, 4), "png": (0, 8), "jpeg": (0, 3), "webp": (0, 12), "avif": (4, 8), "mvt-like": (0, 1)}
    out = F.lit(None).cast("struct<offset:int,length:int>")
    for name, (offset, length) in spans.items():
        out = F.when(col(kind) == name, F.struct(F.lit(offset).alias("offset"), F.lit(length).alias("length"))).otherwise(out)
    return out


def compression_verdict(declared: ColumnOrName, kind: ColumnOrName) -> Column:
    """ok / warn / na: declared compression against the stored bytes. Brotli has no signature to compare with."""
    c, k = col(declared), col(kind)
    return (F.when(c == 3, "na")
            .when(c == 2, F.when(k == "gzip", "ok").otherwise("warn"))
            .when(c == 4, F.when(k == "zstd", "ok").otherwise("warn"))
            .when(k.isin("gzip", "zstd"), "warn").otherwise("ok"))


def tile_type_verdict(declared: ColumnOrName, kind: ColumnOrName) -> Column:
    """ok / warn / na: declared tile type against the payload's first bytes."""
    t, k = col(declared), col(kind)
    expected = F.when(t == 1, "mvt-like")
    for code, name in RASTER_TYPES.items():
        expected = expected.when(t == code, name)
    return F.when(expected.isNull(), "na").when(k == expected, "ok").otherwise("warn")


def route(declared: ColumnOrName, kind: ColumnOrName, n_bytes: ColumnOrName, n_layers: ColumnOrName) -> Column:
    """STRUCT(route, reason): which reader a payload goes to - mvt, raster or raw.

    The declared type decides; the bytes decide only when it is unknown. ``n_bytes`` NULL means the payload could not
    be decompressed. ``n_layers`` is how many vector layers could be read from it.
    """
    t, k, n = col(declared), col(kind), col(n_bytes)
    raster = k.isin(*RASTER_TYPES.values())
    by_code = F.lit(None).cast("string")
    for code, name in RASTER_TYPES.items():
        by_code = F.when(t == code, name).otherwise(by_code)
    target = F.when(t == 0, F.when(k == "mvt-like", "mvt").when(raster, k)).when(t == 1, "mvt").otherwise(by_code)
    why = F.when(t == 0, "by-content").otherwise("declared")

    def out(name: str | Column, reason: str | Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("route"),
                        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    def decide(v: Column) -> Column:
        unread = (F.coalesce(col(n_layers), lng(0)) == 0) & (n > 0)
        return (F.when(n.isNull(), out("raw", "not-decompressed"))
                .when(t == 6, out("raw", "no-reader"))
                .when(~t.between(0, 5), out("raw", "undefined-type"))
                .when(v.isNull(), out("raw", "unrecognised"))
                .when((v == "mvt") & unread, out("raw", "no-layer"))
                .when(v == "mvt", out("mvt", why))
                .when(v != k, out("raw", "mismatch"))
                .otherwise(out("raster", why)))

    return let(target, decide)


def size_ratio(before: ColumnOrName, after: ColumnOrName) -> Column:
    return col(after) / F.nullif(col(before), F.lit(0).cast("bigint"))


def content_range_total(value: ColumnOrName) -> Column:
    """Total size at the end of a Content-Range value; NULL when it is absent or unknown."""
    return F.nullif(F.regexp_extract(col(value), r"/(\d+)$", 1), F.lit("")).try_cast("bigint")


def refused_range_total(value: ColumnOrName) -> Column:
    """Total size in the Content-Range of a refused range, which names no bytes; NULL for any other form."""
    return F.nullif(F.regexp_extract(col(value), r"^bytes \*/(\d+)$", 1), F.lit("")).try_cast("bigint")


def is_mixed_content(page: ColumnOrName, target: ColumnOrName) -> Column:
    """An https page asking for an http address. The local machine is exempt; relative addresses follow the page."""
    host = F.lower(F.coalesce(F.try_parse_url(col(target), F.lit("HOST")), F.lit("")))
    local = host.isin("localhost", "127.0.0.1", "[::1]") | host.endswith(".localhost")
    https = F.coalesce(F.lower(F.try_parse_url(col(page), F.lit("PROTOCOL"))) == "https", F.lit(False))
    http = F.coalesce(F.lower(F.try_parse_url(col(target), F.lit("PROTOCOL"))) == "http", F.lit(False))
    return https & http & ~local


# ---- raster dimensions -----------------------------------------------------------------------------------------

#: JPEG frame markers and their coding.
SOF = {
    0xC0: "Baseline DCT", 0xC1: "Extended sequential DCT", 0xC2: "Progressive DCT", 0xC3: "Lossless",
    0xC5: "Differential sequential DCT", 0xC6: "Differential progressive DCT", 0xC7: "Differential lossless",
    0xC9: "Extended sequential DCT (arithmetic)", 0xCA: "Progressive DCT (arithmetic)", 0xCB: "Lossless (arithmetic)",
    0xCD: "Differential sequential DCT (arithmetic)", 0xCE: "Differential progressive DCT (arithmetic)",
    0xCF: "Differential lossless (arithmetic)",
}
_SIZE = "struct<width:bigint,height:bigint,variant:string,marker:int,issue:string>"


def _size(width: Column | None = None, height: Column | None = None, variant: str | Column | None = None,
          issue: str | None = None, marker: Column | None = None) -> Column:
    v = variant if isinstance(variant, Column) else F.lit(variant)
    w = F.lit(None) if width is None else width
    h = F.lit(None) if height is None else height
    return F.struct(w.alias("width"), h.alias("height"), v.alias("variant"), (F.lit(None) if marker is None else marker).alias("marker"), F.lit(issue).alias("issue")).cast(_SIZE)


def _checked(width: Column, height: Column, variant: str | None) -> Column:
    return F.when(width.isNull() | height.isNull(), _size(variant=variant, issue="truncated")).otherwise(
        _size(width, height, variant))


def png_size(blob: Column) -> Column:
    head = F.substring(blob, F.lit(13), F.lit(4))
    return (F.when(F.octet_length(blob) < 16, _size(issue="truncated"))
            .when(head != F.lit(b"IHDR"), _size(issue="no-header-chunk"))
            .otherwise(_checked(uint_be(blob, 16, 4), uint_be(blob, 20, 4), None)))


def webp_size(blob: Column) -> Column:
    chunk = F.substring(blob, F.lit(13), F.lit(4))
    bits = uint_le(blob, 21, 4)
    lossy = F.when(F.coalesce(F.substring(blob, F.lit(24), F.lit(3)) != F.lit(b"\x9d\x01\x2a"), F.lit(True)),
                   _size(variant="VP8", issue="no-start-code")).otherwise(
        _checked(uint_le(blob, 26, 2).bitwiseAND(0x3FFF), uint_le(blob, 28, 2).bitwiseAND(0x3FFF), "VP8"))
    lossless = F.when(F.coalesce(byte_at(blob, 20), F.lit(-1)) != 0x2F, _size(variant="VP8L", issue="no-signature")).otherwise(
        _checked(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1, "VP8L"))
    extended = _checked(uint_le(blob, 24, 3) + 1, uint_le(blob, 27, 3) + 1, "VP8X")
    return (F.when(F.octet_length(blob) < 16, _size(issue="truncated")).when(chunk == F.lit(b"VP8 "), lossy)
            .when(chunk == F.lit(b"VP8L"), lossless).when(chunk == F.lit(b"VP8X"), extended)
            .otherwise(_size(issue="unknown-chunk")))


def jpeg_size(blob: Column) -> Column:
    """Walk the marker segments to the frame header; its marker and coding are told apart."""
    names = F.create_map(*[F.lit(v) for item in SOF.items() for v in item])
    state = "struct<p:bigint,result:" + _SIZE + ">"

    def stop(result: Column) -> Column:
        return F.struct(lng(0).alias("p"), result.alias("result")).cast(state)

    def move(p: Column) -> Column:
        return F.struct(p.alias("p"), F.lit(None).cast(_SIZE).alias("result")).cast(state)

    def step(acc: Column, _: Column) -> Column:
        p = acc["p"]

        def at_marker(m: Column) -> Column:
            length = uint_be(blob, p + 2, 2)
            height, width = uint_be(blob, p + 5, 2), uint_be(blob, p + 7, 2)
            frame = F.try_element_at(names, m)
            return (F.when(m == 0xFF, move(p + 1))
                    .when((m == 0x01) | m.between(0xD0, 0xD7), move(p + 2))
                    .when(frame.isNotNull(), stop(F.when(width.isNull(), _size(variant=frame, issue="truncated", marker=m)).otherwise(
                        _size(width, height, frame, marker=m))))
                    .when(m == 0xDA, stop(_size(issue="scan-before-size")))
                    .otherwise(move(p + 2 + length)))

        return (F.when(acc["result"].isNotNull(), acc)
                .when(p + 4 > F.octet_length(blob), stop(_size(issue="no-size-header")))
                .when(byte_at(blob, p) != 0xFF, stop(_size(issue="marker-expected")))
                .otherwise(let(byte_at(blob, p + 1), at_marker)))

    # Every step moves on by a byte at least.
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.octet_length(blob), F.lit(1))), move(lng(2)), step, lambda a: a["result"])
    return F.coalesce(walked, _size(issue="no-size-header"))


def raster_size(blob: ColumnOrName, kind: ColumnOrName) -> Column:
    """STRUCT(width, height, variant, marker, issue) of a PNG, JPEG or WebP payload, read from its header."""
    k = col(kind)
    return let(col(blob), lambda b: F.when(k == "png", png_size(b)).when(k == "jpeg", jpeg_size(b)).when(
        k == "webp", webp_size(b)).otherwise(_size(issue="no-reader")))


def png_details(blob: ColumnOrName) -> Column:
    """STRUCT(bit_depth, color_type, interlaced) of a PNG payload."""
    b = col(blob)
    return F.struct(byte_at(b, 24).alias("bit_depth"), byte_at(b, 25).alias("color_type"), (byte_at(b, 28) == 1).alias("interlaced"))

"""Directories: sorted lists of (tile_id, run_length, offset, length), their construction and their encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.functions.address import KEY_BITS_DEFAULT, with_tile_address
from tesserix.functions.common import div, lng
from tesserix.functions.varint import decode_blobs, padded_varint_hex, varint_hex, varint_width
from tesserix.operators.ordered import exclusive_scan, span_join
from tesserix.session import cut_lineage

#: Names of the four encoded columns, in the order they are stored.
ENCODED_COLUMNS = ["tile_id", "run_length", "length", "offset"]
#: Row form used as the yardstick for sizes: two 8-byte and two 4-byte fields (fixed value).
PLAIN_ROW_BYTES = 24


#: Ids in one window of ``collapse_runs``, as bits.
BITS = 18


# ---- building entries ------------------------------------------------------------------------------------------

def collapse_runs(tiles: DataFrame, keys: list[str] | None = None, bits: int = BITS,
                  key_bits: int = KEY_BITS_DEFAULT) -> DataFrame:
    """Consecutive tile ids with equal ``content`` become one row (keys, tile_id, run_length, content).

    One shuffle, by key and id bucket. Runs are built inside each bucket; only runs touching a bucket edge, at most two
    per bucket, go through a second scan that joins them across edges.
    """
    keys = keys or ["archive_id"]
    w = Window.partitionBy(*keys, "_b").orderBy("tile_id")
    prev = F.lag(F.struct("tile_id", "content")).over(w)
    rows = tiles.select(*keys, "tile_id", "content", F.shiftright("tile_id", bits).alias("_b")).withColumn("_p", prev)
    breaks = F.coalesce((F.col("_p.tile_id") + 1 != F.col("tile_id")) | (F.col("_p.content") != F.col("content")),
                        F.lit(True))
    rows = rows.withColumn("_g", F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_b", "_g").agg(
        F.min("tile_id").alias("tile_id"), F.count(F.lit(1)).alias("run_length"), F.first("content").alias("content"))
    out = [*keys, "tile_id", "run_length", "content"]
    runs = runs.select(*out)
    if key_bits <= bits:
        return runs
    runs = cut_lineage(runs, "runs")  # read three times below
    size = 1 << bits
    at_start = F.col("tile_id") % size == 0
    at_edge = at_start | ((F.col("tile_id") + F.col("run_length")) % size == 0)
    edge = exclusive_scan(runs.filter(at_edge), keys, "tile_id", {"_p": ("last", F.struct(
        (F.col("tile_id") + F.col("run_length")).alias("end"), "content"))})
    joins = F.coalesce(at_start & (F.col("_p.end") == F.col("tile_id")) & (F.col("_p.content") == F.col("content")),
                       F.lit(False))
    edge = edge.withColumn("_root", F.when(~joins, F.col("tile_id")))
    edge = exclusive_scan(edge, keys, "tile_id", {"_before": ("last", F.col("_root"))})
    edge = edge.withColumn("tile_id", F.coalesce("_root", "_before")).groupBy(*keys, "tile_id").agg(
        F.sum("run_length").alias("run_length"), F.first("content").alias("content"))
    return runs.filter(~at_edge).unionByName(edge.select(*out))


def expand_runs(entries: DataFrame, chunk_bits: int = 16) -> DataFrame:
    """One row per addressed tile. Long runs are cut into chunks and spread before they are expanded."""
    chunk = 1 << chunk_bits
    end = F.col("_from") + F.least(F.col("_left"), lng(chunk)) - 1
    short = entries.filter(F.col("run_length").between(1, chunk)).withColumns(
        {"_from": F.col("tile_id"), "_left": F.col("run_length")})
    cuts = F.sequence(lng(0), F.shiftright(F.col("run_length") - 1, chunk_bits))
    long = entries.filter(F.col("run_length") > chunk).withColumn("_c", F.explode(cuts)).withColumns(
        {"_from": F.col("tile_id") + F.col("_c") * chunk, "_left": F.col("run_length") - F.col("_c") * chunk})
    long = long.repartition("_from").drop("_c")
    both = short.unionByName(long)
    return both.withColumn("addressed_tile", F.explode(F.sequence("_from", end))).drop("_from", "_left")


def run_ends(entries: DataFrame) -> DataFrame:
    """First and last z/x/y of every run."""
    rows = entries.filter("run_length > 0").withColumn("last_tile_id", F.col("tile_id") + F.col("run_length") - 1)
    rows = with_tile_address(rows, "tile_id", "first_")
    rows = with_tile_address(rows, "last_tile_id", "last_")
    return rows.drop("first_zoom_base", "first_hilbert_index", "last_zoom_base", "last_hilbert_index")


def assign_offsets(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """Store each distinct content once: the first use in tile id order gets the next offset, later uses point back.

    ``entries`` hold (archive_id, tile_id, run_length, content), ``lengths`` (archive_id, content, length). First uses
    are found by aggregation, so a content shared by most entries is combined before the shuffle; the join back has one
    row per content, so adaptive execution can split the entries of such a content over many tasks.
    """
    firsts = entries.groupBy("archive_id", "content").agg(F.min("tile_id").alias("first_tile_id"))
    # Stored, as sampling the borders of ranges would aggregate and join all entries once more.
    firsts = cut_lineage(firsts.join(lengths, ["archive_id", "content"]), "firsts")
    placed = exclusive_scan(firsts, ["archive_id"], "first_tile_id", {"offset": ("sum", F.col("length"))})
    placed = placed.select("archive_id", "content", F.coalesce("offset", lng(0)).alias("offset"), "length")
    return entries.join(placed, ["archive_id", "content"])


def number_entries(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add ``ordinal``: the entry's position in tile id order."""
    one = F.lit(1).cast("bigint")
    out = exclusive_scan(entries, keys or ["archive_id"], "tile_id", {"ordinal": ("sum", one)})
    return out.withColumn("ordinal", F.coalesce("ordinal", lng(0)))


def pack_leaves(entries: DataFrame, leaf_size: int) -> DataFrame:
    """Cut each archive's entries into leaves of ``leaf_size`` and put a root above them.

    Returns every entry with ``dir_id`` (-1 root, else the leaf's offset in the leaf section), ``leaf_no`` and its
    position ``i``. An archive that fits one leaf keeps all its entries in the root.
    """
    rows = number_entries(entries.select("archive_id", "tile_id", "run_length", "offset", "length"))
    rows = rows.withColumns({"leaf_no": div("ordinal", leaf_size), "i": F.pmod("ordinal", lng(leaf_size))})
    rows = cut_lineage(rows, "numbered")  # read three times below
    sized = encode_entries(rows, ["archive_id", "leaf_no"])
    leaves = sized.groupBy("archive_id", "leaf_no").agg(
        F.min("tile_id").alias("tile_id"), F.count(F.lit(1)).alias("n"), F.sum("encoded_bytes").alias("body"))
    leaves = cut_lineage(leaves.withColumn("length", F.col("body") + varint_width("n")), "leaves")
    counts = leaves.groupBy("archive_id").agg(F.count(F.lit(1)).alias("leaves"))
    leaves = exclusive_scan(leaves, ["archive_id"], "leaf_no", {"offset": ("sum", F.col("length"))})
    leaves = leaves.withColumn("offset", F.coalesce("offset", lng(0)))
    leaves = cut_lineage(leaves.join(counts, "archive_id"), "leaves")
    root = leaves.filter("leaves > 1").select(
        "archive_id", lng(-1).alias("dir_id"), lng(-1).alias("leaf_no"), F.col("leaf_no").alias("i"), "tile_id",
        lng(0).alias("run_length"), "offset", "length")
    names = leaves.select("archive_id", "leaf_no",
                          F.when(F.col("leaves") > 1, F.col("offset")).otherwise(lng(-1)).alias("dir_id"))
    tiles = rows.join(names, ["archive_id", "leaf_no"]).select(root.columns)
    return root.unionByName(tiles)


def pack_tree(entries: DataFrame, leaf_size: int, root_bytes: int, levels: int = 4) -> DataFrame:
    """Directories level by level until an archive's root takes at most ``root_bytes`` encoded: an archive that fits keeps its
    entries in the root, the others are cut into leaves of ``leaf_size``, whose list is what the next round packs. The last level is
    a root whatever its size.

    Returns (archive_id, dir_id, level, i, tile_id, run_length, offset, length); ``dir_id`` is -1 for the root, else the leaf's place in
    the leaf section, where leaves of a lower level come before those above them. ``level`` counts from the tile entries up.
    """
    top = entries.select("archive_id", "tile_id", "run_length", "offset", "length")
    used = None
    parts = []
    cols = ["archive_id", "dir_id", "level", "i", "tile_id", "run_length", "offset", "length"]
    for level in range(levels):
        rows = cut_lineage(encode_entries(number_entries(top), ["archive_id"], "ordinal"), "level")
        size = rows.groupBy("archive_id").agg((F.sum("encoded_bytes") + varint_width(F.count(F.lit(1)))).alias("_bytes"))
        fits = F.lit(True) if level == levels - 1 else F.col("_bytes") <= root_bytes
        rows = cut_lineage(rows.join(size.select("archive_id", fits.alias("_fits")), "archive_id"), "level").drop("encoded_bytes", "delta", "code")
        parts.append(rows.filter("_fits").select("archive_id", lng(-1).alias("dir_id"), F.lit(level).alias("level"), F.col("ordinal").alias("i"),
                                                 "tile_id", "run_length", "offset", "length"))
        rows = rows.filter("NOT _fits").withColumns({"leaf_no": div("ordinal", leaf_size), "i": F.pmod("ordinal", lng(leaf_size))}).drop("_fits", "ordinal")
        if level == levels - 1 or rows.isEmpty():
            break
        leaves = encode_entries(rows, ["archive_id", "leaf_no"]).groupBy("archive_id", "leaf_no").agg(
            F.min("tile_id").alias("tile_id"), (F.sum("encoded_bytes") + varint_width(F.count(F.lit(1)))).alias("length"))
        leaves = exclusive_scan(leaves, ["archive_id"], "leaf_no", {"offset": ("sum", F.col("length"))}).withColumn("offset", F.coalesce("offset", lng(0)))
        if used is not None:
            leaves = leaves.join(used, "archive_id", "left").withColumn("offset", F.col("offset") + F.col("_used")).drop("_used")
        leaves = cut_lineage(leaves, "leaves")
        parts.append(rows.join(leaves.select("archive_id", "leaf_no", F.col("offset").alias("dir_id")), ["archive_id", "leaf_no"]).withColumn("level", F.lit(level)).select(*cols))
        used = leaves.groupBy("archive_id").agg(F.max(F.col("offset") + F.col("length")).alias("_used"))
        top = leaves.select("archive_id", "tile_id", lng(0).alias("run_length"), "offset", "length")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- encoding --------------------------------------------------------------------------------------------------

def encode_entries(entries: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Add the stored value of each column (``delta``, ``code``) and the bytes the entry takes.

    The id is stored as the difference to the entry before; the offset as 0 when the entry's bytes follow the ones of
    the entry before, else as offset + 1.
    """
    out = exclusive_scan(entries, keys, order, {"_prev": ("last", F.struct(
        "tile_id", (F.col("offset") + F.col("length")).alias("end")))})
    code = F.when(F.col("_prev.end") == F.col("offset"), lng(0)).otherwise(F.col("offset") + 1)
    out = out.withColumns({"delta": F.col("tile_id") - F.coalesce("_prev.tile_id", lng(0)), "code": code})
    width = (varint_width("delta") + varint_width("run_length") + varint_width("length") + varint_width("code"))
    return out.withColumn("encoded_bytes", width.cast("bigint")).drop("_prev")


def encode_directories(entries: DataFrame, keys: list[str], order: str = "i", extra: str | None = None) -> DataFrame:
    """Directory blobs (keys, n, blob): count, then the four columns one after the other.

    A directory is stored as one value in the end, so gathering its entries is bounded by the size of that value; cut
    large entry lists with ``pack_leaves`` first. ``extra``, a column of the entries, pads their values by so many bytes, as
    some writers do.
    """
    rows = encode_entries(entries, keys, order)
    hexed = (lambda c: padded_varint_hex(c, extra)) if extra else varint_hex
    item = F.struct(F.col(order).alias("o"), *[hexed(c).alias(c) for c in ("delta", "run_length", "length", "code")])
    dirs = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_e"), F.count(F.lit(1)).alias("n"))
    # A field of an array of structs is the array of that field.
    body = F.concat(*[F.array_join(F.col(f"_e.{c}"), "") for c in ("delta", "run_length", "length", "code")])
    return dirs.select(*keys, "n", F.unhex(F.concat(varint_hex("n"), body)).alias("blob"))


# ---- decoding --------------------------------------------------------------------------------------------------

def spread(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """Distribute directories by key before decoding them.

    Decoding turns each byte into an array cell and each entry into a row, so moving the blobs is the cheap moment to
    balance the work; ``decode_entries`` then finds its rows in place and does not shuffle them again.
    """
    return blobs.repartition(int(blobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def decode_values(blobs: DataFrame) -> DataFrame:
    """Add ``n``, ``values`` (ARRAY<STRUCT(value, byte_offset, byte_length)>), ``decoded_length`` and ``error``.

    Whole batches of blobs are decoded as one array of bytes: no shuffle and no row per byte.
    """
    df = decode_blobs(blobs).withColumn("decoded_length", F.octet_length("blob"))
    df = df.withColumn("n", F.get("values", F.lit(0))["value"])
    stored = F.slice("values", 1, F.least(F.size("values"), F.col("n") * 4 + 1).cast("int"))
    error = (F.when((F.size("values") == 0) | (F.size("values") < F.col("n") * 4 + 1), "truncated")
             .when(F.col("n").isNull() | F.exists(stored, lambda v: v["value"].isNull()), "too-large"))
    return df.withColumn("error", error)


def _readable() -> Column:
    return F.col("error").isNull() & (F.col("n") > 0)


def encoded_values(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of the four columns: (keys, n, col, i, value, byte_offset, byte_length)."""
    # Unreadable and empty directories give empty arrays: a filter would be pushed down and decode everything twice.
    stored = F.when(_readable(), F.slice("values", F.lit(2), (F.col("n") * 4).cast("int")))
    rows = decoded.select(*keys, "n", F.posexplode(stored).alias("_p", "_v"))
    names = F.array(*[F.lit(c) for c in ENCODED_COLUMNS])
    return rows.select(*keys, "n", F.get(names, div("_p", F.col("n"))).alias("col"),
                       F.pmod(lng("_p"), F.col("n")).alias("i"), F.col("_v.value").alias("value"),
                       F.col("_v.byte_offset").alias("byte_offset"), F.col("_v.byte_length").alias("byte_length"))


def decode_entries(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of decoded blobs: (keys, i, tile_id, run_length, offset, length, delta, code).

    Both running sums use one window over the directory, which came out of a single value.
    """
    n, v = F.col("n"), F.col("values")

    def entry(i: Column) -> Column:
        return F.struct(*[F.get(v, (i + 1 + n * k).cast("int"))["value"].alias(name)
                          for k, name in enumerate(["delta", "run_length", "length", "code"])])

    steps = F.when(_readable(), F.sequence(lng(0), F.greatest(n - 1, lng(0))))
    rows = decoded.select(*keys, F.posexplode(F.transform(steps, entry)).alias("i", "_e")).select(
        *keys, F.col("i").cast("bigint").alias("i"), "_e.*")
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("length").over(w) - F.col("length")
    explicit = F.when((F.col("i") == 0) | (F.col("code") != 0), F.col("code") - 1 - F.col("_before"))
    rows = rows.withColumns({"tile_id": F.sum("delta").over(w), "_before": before}).withColumn("_anchor", explicit)
    offset = F.col("_before") + F.last("_anchor", ignorenulls=True).over(w)
    return rows.withColumn("offset", offset).select(*keys, "i", "tile_id", "run_length", "offset", "length", "delta", "code")


def directory_issues(decoded: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Rule violations that do not stop reading: (keys, code, i)."""
    none = F.lit(None).cast("bigint")
    empty = decoded.filter("error IS NULL AND n = 0").select(*keys, F.lit("empty-directory").alias("issue"), none.alias("i"))
    first = entries.filter("i = 0 AND code = 0").select(*keys, F.lit("first-offset-zero").alias("issue"), none.alias("i"))
    zero = entries.filter("length = 0").select(*keys, F.lit("zero-length").alias("issue"), "i")
    return empty.unionByName(first).unionByName(zero)


# ---- reports ---------------------------------------------------------------------------------------------------

def offset_classes(entries: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Add ``offset_class``: contiguous, first, backward (reuses earlier bytes), resume (continues at the end of what
    was written so far) or forward (skips ahead)."""
    end = F.col("offset") + F.col("length")
    rows = exclusive_scan(entries, keys, order, {"_prev": ("last", end), "_high": ("max", end)})
    kind = (F.when(F.col("_prev").isNull(), "first").when(F.col("offset") == F.col("_prev"), "contiguous")
            .when(F.col("offset") < F.col("_prev"), "backward").when(F.col("offset") == F.col("_high"), "resume")
            .otherwise("forward"))
    return rows.withColumn("offset_class", kind).drop("_prev", "_high")


def offset_summary(classed: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per class."""
    names = ["contiguous", "first", "backward", "resume", "forward"]
    return classed.groupBy(*keys).agg(*[F.count_if(F.col("offset_class") == n).alias(f"n_{n}") for n in names])


def clustered_check(classed: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Whether tile data lies in tile id order: no forward jump, first offset 0, one jump back per reused content."""
    first = F.min_by("offset", order)
    rows = classed.groupBy(*keys).agg(
        F.count_if(F.col("offset_class") == "forward").alias("n_forward"),
        F.count_if(F.col("offset_class") == "backward").alias("n_backward"),
        F.count_if(F.col("offset_class") == "resume").alias("n_resume"),
        F.count(F.lit(1)).alias("n_entries"), F.countDistinct("offset").alias("n_contents"),
        first.alias("first_offset"))
    # Reuse of the content just before a reused one is contiguous or starts no jump, hence <= and not =.
    strict = ((F.col("n_backward") == F.col("n_entries") - F.col("n_contents"))
              & (F.col("n_resume") == F.col("n_backward")))
    clustered = (F.col("n_forward") == 0) & (F.col("first_offset") == 0)
    return rows.withColumns({"is_clustered": clustered, "single_reuses_only": clustered & strict})


def column_stats(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per directory and column: bytes, bytes per value, one-byte values, most common value (first seen on a tie)."""
    per_value = values.groupBy(*keys, "col", "value").agg(
        F.count(F.lit(1)).alias("_c"), F.min("i").alias("_i"), F.sum("byte_length").alias("_b"),
        F.count_if(F.col("byte_length") == 1).alias("_one"),
        F.count_if(F.col("byte_length") != varint_width("value")).alias("_loose"))
    rank = F.struct(F.col("_c"), (-F.col("_i")).alias("first"))
    return per_value.groupBy(*keys, "col").agg(
        F.sum("_c").alias("n_values"), F.sum("_b").alias("bytes"), (F.sum("_b") / F.sum("_c")).alias("bytes_per_value"),
        F.sum("_one").alias("one_byte_values"), F.max_by("value", rank).alias("most_common"), F.max("_c").alias("frequency"),
        F.sum("_loose").alias("not_shortest"))


def column_ranges(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes each column takes and ``trailing_bytes`` after the last one. One row per directory and column."""
    values = F.col("values")
    n = F.col("n")
    first = values[0]

    def part(name: str, k: int) -> Column:
        piece = F.slice(values, (n * k + 2).cast("int"), n.cast("int"))
        size = F.aggregate(piece, F.lit(0), lambda a, v: a + v["byte_length"])
        start = F.when(n > 0, F.get(values, (n * k + 1).cast("int"))["byte_offset"]).otherwise(first["byte_length"])
        return F.struct(F.lit(name).alias("col"), start.alias("byte_offset"), size.alias("byte_length"))

    head = F.struct(F.lit("count").alias("col"), first["byte_offset"].alias("byte_offset"),
                    first["byte_length"].alias("byte_length"))
    rows = decoded.filter("error IS NULL").select(
        *keys, "decoded_length", F.array(head, *[part(c, k) for k, c in enumerate(ENCODED_COLUMNS)]).alias("_c"))
    used = F.aggregate("_c", F.lit(0), lambda a, c: a + c["byte_length"])
    return rows.withColumn("trailing_bytes", F.col("decoded_length") - used).select(*keys, "trailing_bytes", F.inline("_c"))


def size_comparison(decoded: DataFrame, keys: list[str], stored: str | None = None) -> DataFrame:
    """Bytes as plain rows, as encoded columns and (when known) as stored after compression, with the ratio of the last two."""
    rows = decoded.filter("error IS NULL")
    plain = F.col("n") * PLAIN_ROW_BYTES
    out = rows.select(*keys, "n", plain.alias("plain_bytes"), F.col("decoded_length").cast("bigint").alias("encoded_bytes"),
                      *([F.col(stored).cast("bigint").alias("stored_bytes")] if stored else []))
    out = out.withColumn("encoded_per_entry", F.col("encoded_bytes") / F.nullif(F.col("n"), lng(0)))
    out = out.withColumn("encoded_share", F.col("encoded_bytes") / F.nullif(F.col("plain_bytes"), lng(0)))
    return out.withColumn("compression_ratio", F.col("encoded_bytes") / F.nullif(F.col("stored_bytes"), lng(0))) if stored else out


def directory_summary(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Tile entries, leaf entries and addressed tiles of each directory (tiles below its leaves not included)."""
    return entries.groupBy(*keys).agg(
        F.count_if(F.col("run_length") > 0).alias("tile_entries"), F.count_if(F.col("run_length") == 0).alias("leaf_entries"),
        F.sum("run_length").alias("addressed"))


def entry_file_range(entries: DataFrame, archives: DataFrame) -> DataFrame:
    """Absolute byte range each entry points at: leaf section for leaf entries, tile section for the others."""
    bases = archives.select("archive_id", "leaf_offset", "tile_offset")
    leaf = F.col("run_length") == 0
    out = entries.join(bases, "archive_id")
    return out.withColumns({
        "section": F.when(leaf, "leafDirectories").otherwise("tileData"),
        "file_offset": F.when(leaf, F.col("leaf_offset")).otherwise(F.col("tile_offset")) + F.col("offset"),
    }).drop("leaf_offset", "tile_offset")


def damaged_values(ranges: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """Which entry and column each damaged byte range [damage_start, damage_end) of a directory touches.

    Byte positions count from the directory's first decoded byte, so this level of detail holds only for directories
    stored without compression.
    """
    spans = values.select(*on, "col", "i", F.col("byte_offset").cast("bigint").alias("span_start"),
                          (F.col("byte_offset") + F.col("byte_length")).cast("bigint").alias("span_end"))
    return span_join(ranges, spans, on, "span_start", "span_end", "damage_start", "damage_end")


def same_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that differ between two entry lists, with the side they come from; empty when they are equal."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def sample_existing(entries: DataFrame, seed: int, keys: list[str] | None = None) -> DataFrame:
    """One existing tile per archive: an entry chosen at random, then a position inside its run.

    Chosen by the smallest of a seeded hash, as an aggregation: no sort, and the same answer on every run.
    """
    keys = keys or ["archive_id"]
    mixed = F.pmod(F.pmod(F.col("tile_id"), lng(2147483647)) * 48271 + seed, lng(2147483647))
    picked = entries.filter("run_length > 0").groupBy(*keys).agg(
        F.min_by(F.struct("tile_id", "run_length", mixed.alias("mixed")), F.struct(mixed, "tile_id")).alias("_e"))
    inside = F.pmod(F.col("_e.mixed") * 16807 + seed, F.col("_e.run_length"))
    return picked.select(*keys, F.col("_e.tile_id").alias("entry_tile_id"), (F.col("_e.tile_id") + inside).alias("tile_id"))

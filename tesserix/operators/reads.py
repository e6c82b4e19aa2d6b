"""The read log: totals, budgets, outcomes of range requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.functions.common import lng
from tesserix.functions.payload import is_mixed_content, refused_range_total
from tesserix.operators.archive import FIRST_READ, HEADER_SIZE, SECTIONS
from tesserix.operators.ordered import exclusive_scan
from tesserix.session import cut_lineage

#: Reads made for display or measuring; all others were needed to use the archive (fixed values).
NOT_NEEDED = ["viewer-inspect", "size-probe"]
#: Response headers every page may read (fixed values).
SAFELISTED = ["cache-control", "content-language", "content-length", "content-type", "expires", "last-modified", "pragma"]


def _received(when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("received"))), lng(0))


def read_totals(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes needed, inspected, read for a map and in total, and HTTP requests made. Partial sums before the shuffle."""
    purpose = F.col("purpose")
    return reads.groupBy(*keys).agg(
        _received(~purpose.isin(*NOT_NEEDED)).alias("needed"), _received(purpose == "viewer-inspect").alias("inspected"),
        _received(F.col("initiator") == "map").alias("map_bytes"), F.sum("received").alias("total"),
        F.count(F.lit(1)).alias("n_reads"), F.sum(F.coalesce(F.size("exchanges"), F.lit(0))).alias("n_requests"))


def read_ratio(totals: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Share of the archive that was needed; NULL when its size is unknown."""
    out = totals.join(sizes.select(key, F.col("size").alias("_size")), key, "left")
    return out.withColumn("read_ratio", F.col("needed") / F.nullif(F.col("_size"), lng(0))).drop("_size")


def read_legend(reads: DataFrame) -> DataFrame:
    """Successful reads by lane and purpose, with subtotals (NULL = all)."""
    ok = reads.filter("error_kind IS NULL AND received > 0")
    return ok.rollup("initiator", "purpose").agg(F.count(F.lit(1)).alias("n"), F.sum("received").alias("bytes"))


def map_summary(reads: DataFrame, keys: list[str]) -> DataFrame:
    """What drawing maps cost: tile reads, leaf reads, bytes and reads given up."""
    ok = F.col("error_kind").isNull()
    return reads.filter("initiator = 'map'").groupBy(*keys).agg(
        F.count_if(ok & (F.col("purpose") == "tile-data")).alias("tile_reads"),
        F.count_if(ok & (F.col("purpose") == "leaf-directory")).alias("leaf_reads"),
        F.count_if(F.col("error_kind") == "aborted").alias("aborted"), _received(ok).alias("bytes"))


def leaf_origin(requests: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Add ``how`` (read or cache): the first successful request of a leaf in a session reads it, all later ones share it.

    A failed request is neither shared nor counted; it gets NULL. The first is found by aggregation, so a leaf asked for
    by most of a session costs one row per task before the shuffle.
    """
    ok = F.col("error_kind").isNull()
    firsts = requests.filter(ok).groupBy(*keys).agg(F.min(order).alias("_first"))
    out = requests.join(firsts, keys, "left")
    return out.withColumn("how", F.when(ok, F.when(F.col(order) == F.col("_first"), "read").otherwise("cache"))).drop("_first")


def read_budget(traces: DataFrame, session: str = "session_id", order: str = "id") -> DataFrame:
    """Cost of each traced tile: ``cold_bytes`` with nothing at hand, ``fresh_bytes`` that this trace added.

    Traces carry ``open_bytes`` (shared by all), ``leaf_id`` and ``leaf_bytes`` (NULL when the root answered) and
    ``tile_bytes`` (NULL when there is no tile).
    """
    through = leaf_origin(traces.filter("leaf_id IS NOT NULL").withColumn("error_kind", F.lit(None).cast("string")),
                          [session, "leaf_id"], order).drop("error_kind")
    direct = traces.filter("leaf_id IS NULL").withColumn("how", F.lit(None).cast("string"))
    rows = through.unionByName(direct)
    leaf, tile = F.coalesce("leaf_bytes", lng(0)), F.coalesce("tile_bytes", lng(0))
    return rows.withColumns({"cold_bytes": F.col("open_bytes") + leaf + tile,
                             "fresh_bytes": F.when(F.col("how") == "read", leaf).otherwise(lng(0)) + tile})


def reads_of_traces(reads: DataFrame, steps: DataFrame) -> DataFrame:
    """Reads that some trace used."""
    return reads.join(steps.select("session_id", F.col("read_id").alias("id")), ["session_id", "id"], "left_semi")


def reads_by_section(reads: DataFrame, archives: DataFrame) -> DataFrame:
    """Bytes each purpose read from every section, and from the first 16 KiB.

    An archive has six named stretches, so they travel inside its row and each read is compared with six at most.
    """
    items = [F.struct(F.lit(name).alias("section"), (lng(0) if p is None else F.col(f"{p}_offset")).alias("s"),
                      (lng(HEADER_SIZE) if p is None else F.col(f"{p}_offset") + F.col(f"{p}_length")).alias("e"))
             for name, p in SECTIONS]
    items.append(F.struct(F.lit("firstRead").alias("section"), lng(0).alias("s"), lng(FIRST_READ).alias("e")))
    marked = archives.select("archive_id", F.array(*items).alias("_s"))
    ok = reads.filter("error_kind IS NULL AND received > 0").select("archive_id", "purpose", "offset", "received")
    both = ok.join(marked, "archive_id").select("archive_id", "purpose", "offset", "received", F.inline("_s"))
    common = F.least(F.col("offset") + F.col("received"), F.col("e")) - F.greatest("offset", "s")
    return both.withColumn("bytes", common).filter("bytes > 0").groupBy("archive_id", "section", "purpose").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))


def short_reads(reads: DataFrame) -> DataFrame:
    """Reads that reached the end of the file."""
    return reads.filter("error_kind IS NULL AND received < requested")


def compare_plans(a: DataFrame, b: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Positions at which two logs differ in (purpose, offset, requested, received), or one has ended."""
    fields = ["purpose", "offset", "requested", "received"]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        out = exclusive_scan(df.select(*keys, order, *fields), keys, order, {"n": ("sum", lng(1))})
        return out.select(*keys, F.coalesce("n", lng(0)).alias("position"), F.struct(*fields).alias(name))

    both = numbered(a, "left").join(numbered(b, "right"), [*keys, "position"], "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


# ---- HTTP ------------------------------------------------------------------------------------------------------

def _label(e: Column) -> Column:
    probe = F.when(e["type"] == "opaque", "opaque").otherwise("failed")
    return F.when(e["mode"] == "no-cors", F.concat(probe, F.lit("(probe)"))).when(
        F.coalesce(e["status"], F.lit(0)) == 0, "failed").otherwise(e["status"].cast("string"))


def status_chain() -> Column:
    """The responses behind one read, like ``416 → 206``; empty for reads that made none."""
    return F.coalesce(F.array_join(F.transform("exchanges", _label), " → "), F.lit(""))


def _first() -> Column:
    return F.get("exchanges", F.lit(0))


def _last() -> Column:
    return F.get("exchanges", F.size("exchanges") - 1)


def range_outcome() -> Column:
    """What the responses of a range read amount to; NULL for reads that made none."""
    total = refused_range_total(_first()["headers"]["content-range"])
    length = _last()["headers"]["content-length"].try_cast("bigint")
    status = _last()["status"]
    retried = (F.col("offset") == 0) & (_first()["status"] == 416)
    return (F.when(F.coalesce(F.size("exchanges"), F.lit(0)) < 1, F.lit(None).cast("string"))
            .when((_first()["type"] == "error") | (_last()["type"] == "error") | (_last()["mode"] == "no-cors"), "failed")
            .when(retried & total.isNull(), "range-not-supported").when(status >= 300, "http-status")
            .when(status == 200, F.when(length.isNull() | (length > F.col("requested")), "range-not-supported").otherwise("whole-file"))
            .when(retried, "ok-after-416").otherwise("ok"))


def failure_class(page: str = "page_url") -> Column:
    """Why a read failed: aborted (given up, not an error), invalid-url, mixed-content, cors, network, or by response."""
    outcome = range_outcome()
    return (F.when(F.col("error_kind") == "aborted", "aborted")
            .when(F.col("url").isNotNull() & F.try_parse_url("url", F.lit("PROTOCOL")).isNull(), "invalid-url")
            .when(_first()["type"] == "error", F.when(is_mixed_content(page, "url"), "mixed-content")
                  .when(_last()["type"] == "opaque", "cors").otherwise("network"))
            .when(outcome.isin("range-not-supported", "http-status"), outcome)
            .when(F.col("error_kind").isNotNull(), F.col("error_kind")))


def etag_changes(reads: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """Reads whose strong ETag differs from the first strong one seen for the same file. Weak ones are ignored, and so are
    those of responses that were not accepted."""
    ended = reads.select(*keys, order, range_outcome().alias("outcome"), _last()["headers"]["etag"].alias("_tag"))
    return _changed(ended, keys, order)


def _changed(ended: DataFrame, keys: list[str], order: str) -> DataFrame:
    tag = F.when(F.col("outcome").isin("ok", "ok-after-416", "whole-file") & ~F.col("_tag").startswith("W/"), F.col("_tag"))
    strong = ended.select(*keys, order, tag.alias("etag")).filter("etag IS NOT NULL")
    firsts = strong.groupBy(*keys).agg(F.min_by("etag", order).alias("first_etag"))
    return strong.join(firsts, keys).filter("etag <> first_etag")


def read_outcomes(reads: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """``reads`` with ``outcome``: as ``range_outcome``, but ``etag-changed`` where the file was another one than at first, which is
    a failure of the read however good its response looks."""
    ended = cut_lineage(reads.select("*", range_outcome().alias("outcome"), _last()["headers"]["etag"].alias("_tag")), "ended")  # read twice
    changed = _changed(ended, keys, order).select(*keys, order, F.lit("etag-changed").alias("_changed"))
    out = ended.join(changed, [*keys, order], "left")
    return out.withColumn("outcome", F.coalesce("_changed", "outcome")).drop("_changed", "_tag")


def hidden_headers(reads: DataFrame) -> DataFrame:
    """Why a response header is NULL: absent, hidden from the page, or one of the two."""
    e = reads.select("id", F.inline("exchanges")).select("id", "status", "type", F.explode("headers").alias("header", "value"))
    reason = (F.when(F.col("type") != "cors", "absent")
              .when((F.col("header") == "content-range") & (F.col("status") == 206), "hidden")
              .when(F.col("header").isin(*SAFELISTED), "absent").otherwise("absent-or-hidden"))
    return e.filter("value IS NULL").withColumn("reason", reason)

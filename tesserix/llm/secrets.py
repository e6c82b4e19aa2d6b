"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Candidates are found in every whole text. Each distinct value is then counted over the whole corpus: how many distinct
owners and repositories hold it, and how many times. A value that many owners hold is a copied example; a value of one
owner that looks random is a live-looking credential. Long tokens that stand alone (kind ``bare``) become spans when
their value is such a live-looking credential elsewhere, so a leaked key is also found where its name is missing.

Null and empty texts have no spans. Repeated rows are scanned each for themselves; copies by one owner stay one owner.
A null owner counts as an owner of its own. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserix.session import cut_lineage

#: Kinds in the order in which spans of one start are listed: (pattern, its group that holds the value, least length of it).
#: A run of one class has its longest match at its first place, so the least length can stand in the pattern; not so for
#: ``assign``, where a match that is too short still uses up its text.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Whole tokens with a digit among their first characters: they may hold a value without naming it.
BARE = ("bare", (r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]{0,15}[0-9])[A-Za-z0-9+/_.=-]{16,}", 0, 16))
COPIED_OWNERS = 3
_SPAN = "array<struct<kind:string,rank:int,start:int,end:int,value:string>>"


def _found(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind. Every match takes the text before it along, so lengths add up to positions (in code points)."""
    whole = F.lit(rf"\G(?s)(.*?)({pattern})")
    gap, hit, value = (F.regexp_extract_all(text, whole, F.lit(g)) for g in (1, 2, 2 + group))
    sizes = F.transform(F.arrays_zip(gap.alias("gap"), hit.alias("hit"), value.alias("value")), lambda m: F.struct(
        F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("hit"), m["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    placed = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda a, m: F.struct(
        (a["at"] + m["gap"] + m["hit"]).alias("at"),
        F.when(F.length(m["value"]) >= least, F.concat(a["out"], F.array(F.struct(
            (a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["hit"]).alias("end"), m["value"].alias("value")))))
        .otherwise(a["out"]).alias("out")), lambda a: a["out"])
    return F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"], s["end"],
                                                  s["value"])).cast(_SPAN)


def candidates(text: Column) -> Column:
    """All spans of all kinds in a text as an array of (kind, rank, start, end, value)."""
    kinds = [*KINDS.items(), BARE]
    return F.concat(*[F.when(text.rlike(p), _found(text, kind, rank, p, g, n)).otherwise(F.array().cast(_SPAN))
                      for rank, (kind, (p, g, n)) in enumerate(kinds)])


def looks_live(value: Column) -> Column:
    """Random-looking: letters and digits, at least eight different characters, no word that examples use."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
            & ~value.rlike(r"(?i)example|changeme|placeholder|dummy|sample|xxxx"))


def may_hold(text: Column) -> Column:
    test = F.lit(False)
    for pattern, _, _ in [*KINDS.values(), BARE[1]]:
        test = test | text.rlike(pattern)
    return F.coalesce(test, F.lit(False))


def _looked_at(docs: DataFrame, text: str, owner: str, repository: str | None) -> DataFrame:
    """Stored table of the rows that may hold a secret: ``_row`` (all columns), ``_text``, ``_uid``, ``_owner``, ``_repo``, ``_spans``."""
    rows = docs.filter(may_hold(F.col(text))).select(
        F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_uid"),
        F.coalesce(F.concat(F.lit("o"), F.col(owner).cast("string")), F.lit("")).alias("_owner"),
        F.coalesce(F.concat(F.lit("r"), F.col(repository or owner).cast("string")), F.lit("")).alias("_repo"),
        candidates(F.col(text)).alias("_spans"))
    return cut_lineage(rows, "secrets")


def ownership(rows: DataFrame) -> DataFrame:
    """Per value: uses, owners, repositories, and its class. Counts are combined before each shuffle, no value is gathered."""
    uses = rows.select("_owner", "_repo", F.explode("_spans").alias("s")).select("_owner", "_repo", "s.value", F.col(
        "s.kind").alias("kind"))
    by_repo = uses.groupBy("value", "_owner", "_repo").agg(F.count("*").alias("uses"), F.max(F.col("kind") != BARE[0]).alias("named"))
    by_owner = by_repo.groupBy("value", "_owner").agg(F.sum("uses").alias("uses"), F.count("*").alias("repositories"),
                                                      F.max("named").alias("named"))
    total = by_owner.groupBy("value").agg(F.sum("uses").alias("uses"), F.count("*").alias("owners"),
                                          F.sum("repositories").alias("repositories"), F.max("named").alias("named"))
    return total.filter("named").select("value", "uses", "owners", "repositories", F.when(
        F.col("owners") >= COPIED_OWNERS, "copied").when(~looks_live(F.col("value")), "plain").when(
            F.col("owners") == 1, "live").otherwise("shared").alias("ownership"))


def classified_spans(rows: DataFrame) -> DataFrame:
    """(_uid, spans): each row's spans with their ownership, by start, then kind. ``bare`` ones stay where the value is live
    and no other span of the row covers the place."""
    each = rows.select("_uid", F.explode("_spans").alias("s")).select("_uid", "s.*")
    # Stored, so that the join has an exchange on either side and a frequent value's rows can be split over tasks.
    known = each.join(cut_lineage(ownership(rows), "ownership"), "value")
    spans = known.groupBy("_uid").agg(F.sort_array(F.collect_list(F.struct(
        "start", "rank", "end", "kind", "value", "owners", "repositories", "ownership"))).alias("spans"))
    named = F.filter("spans", lambda s: s["kind"] != BARE[0])
    return spans.withColumn("_named", named).select("_uid", F.filter("spans", lambda s: (s["kind"] != BARE[0]) | (
        (s["ownership"] == "live") & ~F.exists("_named", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))).alias("spans"))


def _scanned(docs: DataFrame, text: str, owner: str, repository: str | None) -> DataFrame:
    """(_row, _text, _found): every row of ``docs`` with its spans."""
    rows = _looked_at(docs, text, owner, repository)
    found = rows.select("_uid", "_row", "_text").join(classified_spans(rows).withColumnRenamed("spans", "_found"), "_uid", "left").drop("_uid")
    none = F.array().cast(found.schema["_found"].dataType)
    rest = docs.filter(~may_hold(F.col(text))).select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), none.alias("_found"))
    return found.withColumn("_found", F.coalesce("_found", none)).unionByName(rest)


def scan_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repository: str | None = None, out: str = "spans") -> DataFrame:
    """``docs`` plus ``out``: array of (start, rank, end, kind, value, owners, repositories, ownership)."""
    return _scanned(docs, text, owner, repository).select("_row.*", F.col("_found").alias(out))


def redact_live(docs: DataFrame, text: str = "text", owner: str = "source", repository: str | None = None,
                mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking credential replaced by ``mark``. Rows stay; copied examples stay as they are."""
    live = F.filter("_found", lambda s: s["ownership"] == "live")
    # Spans that overlap become one: a span opens a new piece where it starts behind all earlier ones.
    pieces = F.aggregate(live, F.array().cast("array<struct<start:int,end:int>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (s["start"] < F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0))),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(
            F.try_element_at(a, F.lit(-1))["start"].alias("start"),
            F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(
                F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    body = F.aggregate("_pieces", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda a, p: F.struct(
        p["end"].alias("at"), F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, p["start"] - a["at"]), F.lit(mark)).alias("out")),
        lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.length("_text"))))
    cleaned = F.when(F.size("_pieces") > 0, body).otherwise(F.col("_text"))
    return _scanned(docs, text, owner, repository).withColumn("_pieces", pieces).select(
        *[cleaned.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The query's columns: counts per base kind, a hash of the base spans, all spans, and counts by ownership."""
    base = F.filter("spans", lambda s: s["kind"] != BARE[0])

    def count(field: str, wanted: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == wanted)).cast("long")

    return scan_secrets(docs.select("doc_id", "text", "source")).select(
        "doc_id", *[count("kind", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *[count("ownership", k).alias(f"n_{k}") for k in ("live", "shared", "copied")])

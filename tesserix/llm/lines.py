"""Lines that repeat across documents: all but those of the first document that holds them are dropped.

Only DataFrame functions are used. Every line's key is hashed to 128 bits and stored once as (hash, document, position). Hashes
are range-partitioned with a secondary sort by document and position, and the first occurrence of each is streamed past the
others. A hash that a large share of all lines has would end in one partition: the ``FREQUENT`` most frequent ones are found by a
sketch (which only decides the route, never the answer), their first documents by an aggregation combined before its shuffle,
and their occurrences meet that table of at most ``FREQUENT`` rows by broadcast. What comes out is one sparse bitmap per
document: 64-line words of kept lines, words of kept lines only left out.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys under ``least`` code points repeat freely.
Null and empty texts are one empty line. Rows with the same id are one document (their lines do not repeat each other), null
is an id like others and comes last; repeated rows get equal bitmaps. Very long texts are split to an array of their lines, which
is a few times their size; nothing else about a text is held at once. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserix.functions.common import let
from tesserix.session import cut_lineage

LEAST = 10
#: Rows of the broadcast table, and lines its sketch tracks: all that have over 1 / TRACKED of the rows are found.
FREQUENT, TRACKED = 1000, 10000
WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROW = ["doc_id", "text_1", "text_2"]  # tells rows of different ids or texts apart
_KEY = ["key_1", "key_2"]


def line_key(line: Column) -> Column:
    """Without white space at the ends, A-Z lower-cased. ``lower`` knows other letters too, so it gets ASCII only."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _named(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("text_1"), F.xxhash64(F.lit(1), t).alias("text_2"))


def line_hashes(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, text_1, text_2, pos, key_1, key_2): lines whose keys are long enough to count."""
    lines = _named(docs, text).select(*_ROW, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select(*_ROW, "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least)
    return keys.select(*_ROW, "pos", F.xxhash64("key").alias("key_1"), F.xxhash64(F.lit(1), "key").alias("key_2"))


def later_lines(lines: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The occurrences that go: those in another document than the first that holds their key."""
    often = lines.select(F.expr(f"explode(approx_top_k(key_1, {frequent}, {max(frequent, TRACKED)}))").alias("_i")).select(
        F.col("_i.item").alias("key_1"))
    often = F.broadcast(cut_lineage(often, "frequent_lines"))  # at most ``frequent`` rows
    first = lines.join(often, "key_1", "left_semi").groupBy(*_KEY).agg(F.min("doc_id").alias("_first"))
    common = lines.join(F.broadcast(first), _KEY).filter(~F.col("doc_id").eqNullSafe(F.col("_first")))
    w = Window.partitionBy(*_KEY).orderBy(F.asc_nulls_last("doc_id"), "pos").rowsBetween(Window.unboundedPreceding, 0)
    rare = lines.join(often, "key_1", "left_anti").repartitionByRange(*_KEY).withColumn("_first", F.first(F.struct("doc_id")).over(w))
    rare = rare.filter(~F.col("doc_id").eqNullSafe(F.col("_first.doc_id")))
    return common.select(*_ROW, "pos").unionByName(rare.select(*_ROW, "pos"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST, frequent: int = FREQUENT, text: str = "text") -> DataFrame:
    """(doc_id, text_1, text_2, n_dropped, keep), one row per different (doc_id, text) that loses lines.

    ``keep`` holds (word, bits) in order: bit b of word w stands for line 64 w + b; words that are absent keep all lines."""
    lines = cut_lineage(line_hashes(docs, least, text), "lines")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(63))
    words = later_lines(lines, frequent).groupBy(*_ROW, F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("_gone"))
    return words.groupBy(*_ROW).agg(
        F.sum(F.bit_count("_gone")).cast("bigint").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("_gone").alias("bits")))).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The kept lines of one text. The bitmap is laid out in full once, so each line finds its bit by its place."""
    def full(words: Column) -> Column:
        def with_gap(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(words, i - 1)["word"]).otherwise(-1)
            return F.concat(F.array_repeat(F.lit(-1).cast("bigint"), w["word"] - before - 1), F.array(w["bits"]))

        return F.flatten(F.transform(words, with_gap))

    def kept(bits: Column) -> Column:
        def stays(_: Column, i: Column) -> Column:
            word = F.coalesce(F.get(bits, F.shiftright(i, 6)), F.lit(-1).cast("bigint"))
            return F.call_function("shiftright", word, i.bitwiseAND(63)).bitwiseAND(1) == 1

        return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")

    return F.when(keep.isNull(), text).otherwise(let(let(keep, full), kept))


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, n_dropped, kept) of every row."""
    a, b = _named(docs, text).alias("a"), bitmaps.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_1") == F.col("b.text_1")) & (F.col("a.text_2") == F.col("b.text_2"))
    return a.join(b, same, "left").select("a.doc_id", "a.text", F.coalesce("b.n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
                                          kept_text(F.col("a.text"), F.col("b.keep")).alias("kept"))


def lines_digest(docs: DataFrame, least: int = LEAST, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row per row of ``docs``."""
    kept = with_kept_text(docs, keep_bitmaps(docs, least, frequent))
    n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return kept.select("doc_id", n.cast("bigint").alias("n_lines"), "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

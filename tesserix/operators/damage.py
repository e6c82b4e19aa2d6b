"""From damaged byte ranges of a file to what they cost: sections, directories, and the entries that cannot be read any more."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserix.functions.common import lng
from tesserix.operators.archive import HEADER_SIZE, SECTIONS
from tesserix.operators.ordered import span_join


def damaged_sections(ranges: DataFrame, archives: DataFrame) -> DataFrame:
    """Sections that the file range [damage_start, damage_end) of an archive touches: adds ``section`` and the bytes hit."""
    places = F.array(*[F.struct(F.lit(name).alias("section"), (F.col(f"{p}_offset") if p else lng(0)).alias("_s"),
                                (F.col(f"{p}_offset") + F.col(f"{p}_length") if p else lng(HEADER_SIZE)).alias("_e")) for name, p in SECTIONS])
    rows = ranges.join(archives.select("archive_id", places.alias("_p")), "archive_id").select(*ranges.columns, F.inline("_p"))
    hit = F.least("damage_end", "_e") - F.greatest("damage_start", "_s")
    return rows.withColumn("hit", hit).filter("hit > 0").drop("_s", "_e")


def damaged_directories(ranges: DataFrame, places: DataFrame) -> DataFrame:
    """Directories that a file range touches: adds ``dir_id`` and ``stored_start``, the first damaged byte of the stored directory.
    ``places`` hold (archive_id, dir_id, at, stored); directories of one archive don't overlap."""
    spans = places.select("archive_id", "dir_id", F.col("at").alias("_s"), (F.col("at") + F.col("stored")).alias("_e"))
    hit = span_join(ranges, spans, ["archive_id"], "_s", "_e", "damage_start", "damage_end")
    return hit.withColumn("stored_start", F.greatest(F.col("damage_start") - F.col("_s"), lng(0))).drop("_s", "_e")


def safe_bytes(damage: DataFrame, blob: str = "blob", codec: str = "codec", start: str = "stored_start") -> DataFrame:
    """Add ``safe``: how many bytes of the plain directory come out of the stored bytes before the damage.

    Stored plainly (codes 0 and 1) that is the place itself. A compressed directory is decoded up to the damage and no further, as later
    bytes depend on earlier ones; several places of one directory that follow each other in a batch go on from the last one.
    Codes that cannot be decoded give NULL.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, last, fed, made, decoder = [], None, 0, 0, None
            for raw, code, at in zip(*(batch.column(c).to_pylist() for c in (blob, codec, start))):
                if raw is None or at is None or code not in (0, 1, 2, 4):
                    out.append(None)
                elif code in (0, 1):
                    out.append(min(at, len(raw)))
                else:
                    if raw != last or at < fed:
                        last, fed, made, decoder = raw, 0, 0, _decoder(code)
                    made += _fed(decoder, raw[fed:at])
                    fed = at
                    out.append(made)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "safe"])

    schema = damage.withColumn("safe", F.lit(None).cast("bigint")).schema
    return damage.mapInArrow(step, schema)


def _decoder(code: int):
    if code == 2:
        return zlib.decompressobj(31)
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def _fed(decoder, data: bytes) -> int:
    try:
        return len(decoder.decompress(data)) if data else 0
    except Exception as e:  # broken before the damage: nothing more comes out
        if isinstance(e, (zlib.error, EOFError)) or type(e).__name__ == "ZstdError":
            return 0
        raise


def lost_entries(damage: DataFrame, values: DataFrame, on: list[str]) -> DataFrame:
    """What is lost from ``safe`` on: adds ``n_lost`` values and the first of them (``col``, ``i``); NULL when all can be read.

    ``values`` are those of the undamaged directory (``encoded_values``): columns lie one after the other, so the first lost value says
    which columns are whole, and of which entries the next one still holds something."""
    v = values.select(*on, "col", "i", "byte_offset", (F.col("byte_offset") + F.col("byte_length")).alias("_end"))
    both = damage.join(v, on).filter(F.col("_end") > F.col("safe"))
    lost = both.groupBy(*on, "damage_start").agg(F.count(F.lit(1)).alias("n_lost"), F.min_by(F.struct("col", "i"), "byte_offset").alias("_f"))
    out = damage.join(lost, [*on, "damage_start"], "left")
    return out.withColumns({"n_lost": F.coalesce("n_lost", lng(0)), "col": F.col("_f.col"), "i": F.col("_f.i")}).drop("_f")

"""Line dedup: content-defined chunks of lines that the corpus repeats are removed, all but the first.

Every line has a 32-bit hash; the rolling hash of a line is made of its own and the one before. A chunk ends after a
line whose rolling hash is a local minimum (below the line before, not above the line after), so boundaries depend on
four neighbouring lines only and move with the text when lines are inserted or deleted elsewhere. Chunks between two
such ends have at least two lines, about three on average.

A shared run that other text surrounds may hold no whole chunk, so every two neighbouring lines are compared as well: the
lines of each pair that an earlier place holds go. A run of two or more lines is repeated when all its pairs are, so any such
run is found whole, whatever stands around it. The first of equal chunks, and of equal pairs, always stays.

Chunks (of two or more lines) and pairs are counted by a 64-bit hash; those with a hash that repeats are compared as bytes, by
grouping on the text itself, with counts and first places combined before the shuffle. Of equal ones the first, by
document id and then place, stays. Only those that may repeat are shuffled with their text. Blank ones are left alone.

Defined results: a null text has no lines and stays null; an empty text is one empty line; rows with null id come
first in the order; rows that share an id are documents of their own, but exact repeats of a row share one verdict.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import bit_table, passes
from wakeline.session import stage

LEAST_LINES = 2
NOT_BLANK = r"[^\x20\x09-\x0D]"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def with_chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lines`` and ``chunks``: structs of the first line's number (from 1) and the number of lines."""
    none = F.array().cast("array<string>")
    lined = docs.withColumn("lines", F.coalesce(F.split(F.col(text_col), "\n", -1), none))
    hashed = lined.withColumn("_hash", F.transform("lines", _line_hash))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("_hash", 1, F.greatest(F.size("_hash") - 1, F.lit(0))))
    rolled = hashed.withColumn("_roll", F.zip_with("_hash", before, lambda h, b: b * 31 + h))
    left, right = F.col("_roll"), F.concat(F.slice("_roll", 2, F.size("_roll")), F.array(F.lit(None).cast("bigint")))
    earlier = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("_roll", 1, F.greatest(F.size("_roll") - 1, F.lit(0))))
    marked = rolled.withColumn("_around", F.arrays_zip(earlier.alias("a"), left.alias("b"), right.alias("c")))
    ends = F.filter(
        F.transform("_around", lambda x, i: F.when(x["c"].isNull() | ((x["b"] < x["a"]) & (x["b"] <= x["c"])), i + 1)),
        lambda e: e.isNotNull(),
    )
    ended = marked.withColumn("_ends", F.when(F.size("lines") > 0, ends).otherwise(F.array().cast("array<int>")))
    starts = F.concat(F.array(F.lit(0)), F.slice("_ends", 1, F.greatest(F.size("_ends") - 1, F.lit(0))))
    chunks = F.zip_with("_ends", starts, lambda e, s: F.struct((s + 1).alias("first"), (e - s).alias("size")))
    return ended.withColumn("chunks", chunks).drop("_hash", "_roll", "_around", "_ends")


def _units() -> Column:
    """The chunks and the pairs of a row's lines: structs of kind, first line, number of lines, and the lines joined."""
    chunks = F.transform(
        F.filter("chunks", lambda c: c["size"] >= LEAST_LINES),
        lambda c: F.struct(
            F.lit(True).alias("whole"), c["first"].alias("first"), c["size"].alias("size"),
            F.array_join(F.slice("lines", c["first"], c["size"]), "\n").alias("chunk"),
        ),
    )
    some = F.greatest(F.size("lines") - 1, F.lit(0))
    both = F.zip_with(F.slice("lines", 1, some), F.slice("lines", 2, some), lambda a, b: F.concat(a, F.lit("\n"), b))
    pairs = F.transform(
        both, lambda p, i: F.struct(F.lit(False).alias("whole"), (i + 1).alias("first"), F.lit(2).alias("size"), p.alias("chunk"))
    )
    return F.concat(chunks, pairs)


def _repeats(parts: DataFrame) -> DataFrame:
    """The rows of ``parts`` (_id, _th, whole, first, size, chunk, hash as key) whose chunk or pair has an earlier place."""
    common = stage(parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "chunk-keys")
    alike = stage(parts.where(passes("key", *bit_table(common))).join(common, "key", "left_semi"), "chunks")
    same = ["key", "whole", "chunk"]
    first = F.min(F.struct("_id", "first", "_th")).alias("keeper")
    groups = alike.groupBy(*same).agg(F.count("*").alias("n"), first).where("n > 1").drop("n")
    return alike.join(groups, same).where(~F.struct("_id", "first", "_th").eqNullSafe(F.col("keeper")))


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its columns, n_lines, n_removed (lines), n_chunks_removed, kept (the text that is left).

    Columns of ``docs`` that bear one of these four names give way.
    """
    own_key = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th")]
    # The outer form keeps the optimizer from working the chunks out a second time to test for empty arrays.
    parts = with_chunks(docs.select(*own_key, F.col(text_col).alias("text"))).select("_id", "_th", F.explode_outer(_units()).alias("u"))
    parts = parts.select("_id", "_th", "u.*").where(F.col("chunk").rlike(NOT_BLANK)).withColumn("key", F.xxhash64("whole", "chunk"))
    chunk = F.when(F.col("whole"), F.col("first")).alias("chunk_first")
    lines = F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("line")
    per_text = (
        _repeats(parts)
        .select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), chunk, lines)
        .groupBy("_i", "_t")
        .agg(F.collect_set("line").alias("_gone"), F.size(F.collect_set("chunk_first")).alias("_n_chunks"))
    )
    # The row itself travels as one column, so that its names meet none of those used here.
    source = docs.select(F.struct(*docs.columns).alias("_row"), *own_key)
    joined = source.join(per_text, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), "left")
    text = F.col("_row")[text_col]
    counted = joined.withColumn("lines", F.split(text, "\n", -1))
    # Used twice, so that the optimizer does not move the split into the step by line.
    left = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i - 1)), "\n")
    gone = F.col("_gone").isNotNull()
    found = {
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "n_removed": F.when(gone, F.size("_gone")).otherwise(0).cast("long"),
        "n_chunks_removed": F.coalesce("_n_chunks", F.lit(0)).cast("long"),
        "kept": F.when(gone, kept).otherwise(text),
    }
    told = counted.select("_row", F.struct(*[c.alias(name) for name, c in found.items()]).alias("_found"))
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in found]
    return told.select(*own, *[F.col("_found")[c].alias(c) for c in found])

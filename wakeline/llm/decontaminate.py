"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

Words are maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is ten
consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

The words of a window are ordered by their rarity in the corpus. Whole containment needs every word of the window,
so the necessary prefix is its rarest word alone: documents meet windows on that word only. The word's place in the
window gives the one start an occurrence can have (positional bound); start and length must fit the document (length
bound); then the words themselves are compared. Rarity is counted over all documents.

Before a document's words are shuffled they pass a bit table of the words that windows need. The table's size follows
the number of windows between 2^16 and 2^22 bits, so what is sent to every task is bounded (512 kB); with more windows
it lets more words pass and the join stays exact. Survivors carry the 9 words on either side, enough to verify
in place, so no text is shuffled.

Defined results: a null text has no words; items with null id or text are left out; items that share an id count
once; rows that share an id are judged one by one, exact repeats alike. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import bit_table, lower_ascii, passes
from wakeline.session import stage

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    split = F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")
    return F.coalesce(split, F.array().cast("array<string>"))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, window): the distinct windows of every item, words joined by one space."""
    named = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    named = named.where("item IS NOT NULL AND size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return (
        named.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.array_join(F.slice("w", F.col("s"), WINDOW), " ").alias("window"))
        .distinct()
    )


def occurrences(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """Where ``windows`` (column window) occur: the columns of ``docs`` but its text, window, start (from 0), size."""
    keys = [c for c in docs.columns if c != text_col]
    placed = windows.select("window", F.posexplode(F.split("window", " ")).alias("at", "word"))
    vocabulary = stage(placed.select("word").distinct(), "vocabulary")
    table, log = bit_table(vocabulary)
    spread = docs.select(words(F.col(text_col)).alias("w"))
    counts = (
        spread.select(F.explode("w").alias("word")).where(passes("word", table, log)).groupBy("word").agg(F.count("*").alias("n"))
    )
    rarity = placed.join(vocabulary.join(counts, "word", "left"), "word")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r")
    prefix = rarity.groupBy("window").agg(rarest).where("r.n > 0")
    prefix = stage(prefix.select("window", "r.word", "r.at"), "prefix")

    table, log = bit_table(prefix.select("word").distinct())
    around = WINDOW - 1
    near = (
        docs.select(*keys, words(F.col(text_col)).alias("w"))
        .select(*keys, "w", F.posexplode("w").alias("pos", "word"))
        .where(passes("word", table, log))
        .select(
            *keys,
            "word",
            "pos",
            F.least("pos", F.lit(around)).alias("before"),
            F.slice("w", F.greatest(F.col("pos") - around, F.lit(0)) + 1, F.least("pos", F.lit(around)) + around + 1).alias("near"),
        )
    )
    size = F.size(F.split("window", " "))
    start = F.col("before") - F.col("at")
    fits = (start >= 0) & (start + size <= F.size("near"))
    same = F.array_join(F.slice("near", F.greatest(start, F.lit(0)) + 1, size), " ") == F.col("window")
    return (
        near.join(prefix, "word")
        .where(fits & same)
        .select(*keys, "window", (F.col("pos") - F.col("at")).alias("start"), size.alias("size"))
        .distinct()
    )


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row per document: id, text_hash (xxhash64), n_words, n_hit, n_items, items (sorted ids as strings), contaminated."""
    held = stage(item_windows(items, item_col, item_text_col), "windows")
    source = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), F.col(text_col).alias("_text")
    )
    hits = stage(occurrences(source, held.select("window").distinct(), "_text"), "hits")
    keys = ["_id", "_text_hash"]

    spans = hits.select(*keys, "start", (F.col("start") + F.col("size")).alias("end")).distinct()
    earlier = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(earlier), F.lit(0))
    fresh = spans.select(*keys, F.greatest(F.col("end") - F.greatest("start", covered), F.lit(0)).alias("fresh"))
    n_hit = fresh.groupBy(*keys).agg(F.sum("fresh").alias("n_hit"))
    found = hits.select(*keys, "window").distinct().join(held, "window").select(*keys, "item").distinct()
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))

    base = source.select(*keys, F.size(words(F.col("_text"))).cast("long").alias("n_words"))
    matched = n_hit.withColumnsRenamed({"_id": "_i", "_text_hash": "_t"}).join(
        listed.withColumnsRenamed({"_id": "_i2", "_text_hash": "_t2"}),
        F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_t") == F.col("_t2")),
    )
    result = base.join(matched, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_hash") == F.col("_t")), "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return result.select(
        F.col("_id").alias(id_col),
        F.col("_text_hash").alias("text_hash"),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (hit > 0).alias("contaminated"),
    )

"""Mixing sources to target weights: fixed-length blocks, multinomial source counts by shard, index permutations.

The sources, by code point with null last, carry the given weights in turn. Their targets share a multiple of all words by
weight; a target stops at ``MOST`` times its source's words, and what it leaves goes to the others by weight, until
none is above its bound (the common level is found from the sources in order of bound by weight).

1. A source's documents, in an order of their own, make one stream of words, cut into blocks of ``BLOCK`` words (its last
   block may be shorter). A document's place is a running total in two steps, within chunks and over them.
2. The mix is a row of slots, ``SHARD`` to an output shard. Every slot draws its source with a probability in proportion to the
   slots that the source's target needs, so the counts of a shard are multinomial; a source that is drawn more often than
   it needs cedes its last draws to those drawn too rarely, so each gets just its slots.
3. The j-th slot of a source with n blocks takes block p(j mod n), where p is a pseudorandom permutation of its own for
   each round of n (a Feistel network that walks its cycle until it is below n). The last slot takes only as many words
   as the target still lacks, so the words taken are the target rounded, and no word is taken more than ``MOST`` times.
4. Slots and blocks are joined by (source, block index), which gives the spans of documents that each slot holds.

All of this is small numbers: texts are read once to count words, and again only if ``texts`` is asked for the words.
Nothing depends on how the table is dealt, so reruns agree. Hot sources are split by chunk and by block.

Defined results: a null or empty text has size 0 and is not taken; null is a source like any other, the last; rows with null or
repeated ids are taken each for itself, and of repeated rows each has a place; an empty table gives no row and no slot.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import mix64, text_batches
from wakeline.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words, what the targets share
MOST = 2  # times a source's words, where its target stops
BLOCK = 256  # words
SHARD = 1024  # slots of an output shard
CHUNK = 20_000  # rows of a running total's inner step
CELLS = 100_000  # of the drawing line, at most, besides one for each source
SEED = 13
TOGETHER = 1 << 20  # bytes of text looked at together

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of runs without ASCII white space in each text; a few texts are looked at together."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    counts = np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + TOGETHER, "right")) - 1)
        own = bounds[first : last + 1] - bounds[first]
        space = _SPACE[data[bounds[first] : bounds[last]]]
        begins = ~space
        begins[1:] &= space[:-1]
        starts = own[:-1][np.diff(own) > 0]
        begins[starts] = ~space[starts]
        counts[first:last] = np.diff(np.searchsorted(np.flatnonzero(begins), own))
        first = last
    return counts


def _sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the first column, a text, by its number of words."""
    for batch in batches:
        sizes = pa.array(word_counts(batch.column(0)), pa.int64())
        yield pa.RecordBatch.from_arrays([sizes, *batch.columns[1:]], ["size", *batch.schema.names[1:]])


def running_total(rows: DataFrame, group: str, chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the group before it, by chunk and then ``order``."""
    within = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, chunk).agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, chunk, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_over"))
    inner = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(sums, [group, chunk]).withColumn(name, F.col("_over") + F.col("_within")).drop("_over", "_within")


def _feistel(keys: np.ndarray, n: np.ndarray, value: np.ndarray, forward: bool) -> np.ndarray:
    """A keyed permutation of 0 .. n-1, row by row: four rounds on halves, walked until the value is below n."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64) + np.uint64(1)) // np.uint64(2), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    result = value.astype(np.uint64)
    open_ = np.arange(len(result))
    while len(open_):
        h, m, k = half[open_], mask[open_], keys[open_]
        left, right = result[open_] >> h, result[open_] & m
        for r in range(4) if forward else range(3, -1, -1):
            if forward:
                left, right = right, left ^ (mix64(right + k + np.uint64(r << 56)) & m)
            else:
                left, right = right ^ (mix64(left + k + np.uint64(r << 56)) & m), left
        result[open_] = (left << h) | right
        open_ = open_[result[open_] >= n[open_].astype(np.uint64)]
    return result.astype(np.int64)


def _permuted(sid: pd.Series, turn: pd.Series, n: pd.Series, value: pd.Series, forward: bool) -> pd.Series:
    keys = mix64(mix64(sid.to_numpy().astype(np.uint64) + np.uint64(SEED << 32)) + turn.to_numpy().astype(np.uint64))
    return pd.Series(_feistel(keys, n.to_numpy(), value.to_numpy(), forward))


def block_at(sid: Column | str, turn: Column | str, n: Column | str, place: Column | str) -> Column:
    """The block that stands at a place of a source's order in a round."""

    def run(sid: pd.Series, turn: pd.Series, n: pd.Series, place: pd.Series) -> pd.Series:
        return _permuted(sid, turn, n, place, True)

    return F.pandas_udf(run, "long")(sid, turn, n, place)


def place_of(sid: Column | str, turn: Column | str, n: Column | str, block: Column | str) -> Column:
    """The place of a block in a source's order in a round."""

    def run(sid: pd.Series, turn: pd.Series, n: pd.Series, block: pd.Series) -> pd.Series:
        return _permuted(sid, turn, n, block, False)

    return F.pandas_udf(run, "long")(sid, turn, n, block)


def with_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) with sid, weight, target: one row per source."""
    one = F.lit(0)
    numbered = sizes.withColumn("sid", F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights) + 1)
    bounded = numbered.withColumn("weight", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    by_bound = Window.partitionBy(one).orderBy(F.col("_cap") / F.col("weight"), "sid")
    stopped = F.coalesce(F.sum("_cap").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(one)
    levelled = bounded.withColumn("_level", (share * F.sum("source_size").over(everything) - stopped) / sharing)
    # The first source below its bound gives the level; for those after it this figure only falls.
    below = F.when(F.col("_level") < F.col("_cap") / F.col("weight"), F.col("_level"))
    target = F.least("_cap", F.coalesce(F.max(below).over(everything) * F.col("weight"), F.col("_cap")))
    return levelled.withColumn("target", target).drop("_cap", "_level")


def _with_slots(sources: DataFrame, block: int) -> DataFrame:
    """Sources with blocks, last_block (its words), slots, and last_slot (the words of the last slot, null if whole)."""
    rows = sources.where("source_size > 0").withColumn("_words", F.floor(F.col("target") + 0.5).cast("long"))
    rows = rows.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    rows = rows.withColumn("last_block", F.col("source_size") - (F.col("blocks") - 1) * block)
    rows = rows.withColumn("_turns", F.expr("_words div source_size")).withColumn("_rest", F.expr("_words % source_size"))
    rows = rows.withColumn("_place", place_of("sid", "_turns", "blocks", F.col("blocks") - 1))
    # In the last round blocks are whole but for the short one, wherever the order has it.
    before, with_it = F.col("_place") * block, F.col("_place") * block + F.col("last_block")
    rest = F.when(F.col("_rest") > with_it, F.col("_rest") - with_it).otherwise(F.col("_rest"))
    rows = rows.withColumn("_cut", rest).withColumn("_count", F.expr(f"(_cut + {block - 1}) div {block}"))
    count = F.when(F.col("_rest") > with_it, F.col("_place") + 1 + F.col("_count")).when(
        F.col("_rest") > before, F.col("_place") + 1
    ).otherwise(F.col("_count"))
    last = F.when((F.col("_rest") > before) & (F.col("_rest") <= with_it), F.col("_rest") - before).otherwise(
        F.col("_cut") - (F.col("_count") - 1) * block
    )
    rows = rows.withColumn("slots", F.col("_turns") * F.col("blocks") + count).withColumn("last_slot", F.when(F.col("_rest") > 0, last))
    return rows.drop("_words", "_turns", "_rest", "_place", "_cut", "_count")


def _drawn(sources: DataFrame, total: int, shard: int) -> DataFrame:
    """(shard, slot, sid, j): every slot of the mix with its source and its number among the source's slots."""
    spark = sources.sparkSession
    lined = running_total(
        sources.select("sid", "slots", F.lit(0).alias("g"), F.expr(f"sid div {CHUNK}").alias("c")), "g", "c", ["sid"], F.col("slots"), "lo"
    )
    cell = max(4096, total // CELLS)
    cells = lined.where("slots > 0").select(
        "sid", "lo", (F.col("lo") + F.col("slots")).alias("hi"), F.explode(F.expr(f"sequence(lo div {cell}, (lo + slots - 1) div {cell})")).alias("cell")
    )
    slots = spark.range(total).select(
        F.expr(f"id div {shard}").alias("shard"), F.expr(f"id % {shard}").alias("slot"), F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(total)).alias("u")
    )
    drawn = slots.withColumn("cell", F.expr(f"u div {cell}")).join(cells, "cell").where("u >= lo AND u < hi").select("shard", "slot", "sid")
    drawn = stage(drawn, "draws")
    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))
    counts = running_total(counts.withColumn("c", F.expr(f"shard div {CHUNK}")), "sid", "c", ["shard"], F.col("n"), "first").select("sid", "shard", "first")
    rank = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    numbered = drawn.withColumn("k", rank).join(counts, ["sid", "shard"]).select("shard", "slot", "sid", (F.col("first") + F.col("k")).alias("j"))
    needed = sources.select("sid", "slots")
    numbered = stage(numbered.join(needed, "sid"), "numbered")

    # Draws beyond a source's need, in order, go to the slots still missing, in order; there are as many of each.
    spare = numbered.where("j >= slots").select("shard", "slot", F.lit(0).alias("g"), F.lit(1).alias("one"))
    spare = running_total(spare, "g", "shard", ["slot"], F.col("one"), "at").select("shard", "slot", "at")
    had = numbered.groupBy("sid").agg(F.count("*").alias("had"))
    short = needed.join(had, "sid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    short = short.select("sid", "had", "slots", F.lit(0).alias("g"), F.expr(f"sid div {CHUNK}").alias("c"))
    short = running_total(short, "g", "c", ["sid"], F.col("slots") - F.col("had"), "before")
    missing = short.select("sid", "had", "before", F.explode(F.sequence("had", F.col("slots") - 1)).alias("j"))
    missing = missing.select("sid", "j", (F.col("before") + F.col("j") - F.col("had")).alias("at"))
    ceded = spare.join(missing, "at").select("shard", "slot", "sid", "j")
    return numbered.where("j < slots").select("shard", "slot", "sid", "j").union(ceded)


@dataclass
class Mix:
    """``documents``: sid, source, id, text_hash, size, start (words of its source before it); ``sources``: one row per source
    with its target; ``slots``: shard, slot, sid, block, length."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int

    def spans(self) -> DataFrame:
        """The words of documents in slots: shard, slot, at (words before, there), sid, id, text_hash, start, from, n_words."""
        block = self.block
        pieces = self.documents.where("size > 0").select(
            "sid", "id", "text_hash", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")
        )
        first = F.greatest("start", F.col("block") * block)
        pieces = pieces.withColumn("at", first - F.col("block") * block).withColumn("from", first - F.col("start"))
        pieces = pieces.withColumn("n", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - first)
        met = self.slots.join(pieces, ["sid", "block"]).where(F.col("at") < F.col("length"))
        words = F.least(F.col("at") + F.col("n"), F.col("length")) - F.col("at")
        return met.select("shard", "slot", "at", "sid", "id", "text_hash", "start", "from", words.alias("n_words"))

    def taken(self) -> DataFrame:
        """``documents`` with source_size, target and taken (words of it in the mix, repeats counted)."""
        taken = self.spans().groupBy("sid", "start").agg(F.sum("n_words").alias("taken"))
        rows = self.documents.withColumn("_key", F.when(F.col("size") > 0, F.col("start")))
        found = rows.join(taken.withColumnRenamed("start", "_key"), ["sid", "_key"], "left").drop("_key")
        totals = self.sources.select("sid", "source_size", "target")
        return found.withColumn("taken", F.coalesce("taken", F.lit(0))).join(totals, "sid")

    def texts(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(shard, slot, sid, text): the words of every slot, joined by one space."""
        words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"))
        given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col)).dropDuplicates(["id", "text_hash"])
        given = given.select(F.col("id").alias("_id"), F.col("text_hash").alias("_th"), words.alias("words"))
        spans = self.spans().join(given, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_th")))
        part = F.array_join(F.slice("words", (F.col("from") + 1).cast("int"), F.col("n_words").cast("int")), " ")
        parts = F.sort_array(F.collect_list(F.struct("at", part.alias("text"))))  # at most BLOCK spans
        return spans.groupBy("shard", "slot", "sid").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block: int = BLOCK,
    shard: int = SHARD,
) -> Mix:
    """The mix of ``docs`` by source; see ``Mix``."""
    text_batches(docs.sparkSession)
    given = docs.select(
        F.col(text_col).cast("binary").alias("text"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash")
    )
    id_kind, source_kind = (docs.schema[c].dataType.simpleString() for c in (id_col, source_col))
    sized = given.mapInArrow(_sized, f"size long, id {id_kind}, source {source_kind}, text_hash long")
    # Repeated rows are one row with a count until every place is known.
    rows = stage(sized.groupBy("source", "id", "text_hash", "size").agg(F.count("*").alias("copies")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = stage(with_targets(sizes, weights, share, most), "sources")
    chunks = 1 + rows.count() // CHUNK
    keyed = rows.join(sources.select("sid", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("c", F.pmod(F.xxhash64("id", "text_hash", F.lit(SEED)), F.lit(chunks)))
    placed = running_total(keyed, "sid", "c", ["id", "text_hash", "size"], F.col("size") * F.col("copies"), "_first").drop("c")
    placed = placed.withColumn("_many", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)")))
    placed = placed.withColumn("_copy", F.explode(F.expr("sequence(_many * 4096, least(_many * 4096 + 4095, copies - 1))")))
    documents = placed.select("sid", "source", "id", "text_hash", "size", (F.col("_first") + F.col("_copy") * F.col("size")).alias("start"))
    documents = stage(documents, "places")

    planned = stage(_with_slots(sources, block), "plan")
    total = planned.agg(F.sum("slots")).first()[0] or 0
    drawn = _drawn(planned, total, shard).join(planned.select("sid", "blocks", "last_block", "slots", "last_slot"), "sid")
    drawn = drawn.withColumn("block", block_at("sid", F.expr("j div blocks"), "blocks", F.expr("j % blocks")))
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_block")).otherwise(block)
    length = F.when((F.col("j") == F.col("slots") - 1) & F.col("last_slot").isNotNull(), F.col("last_slot")).otherwise(whole)
    slots = stage(drawn.select("shard", "slot", "sid", "block", length.cast("long").alias("length")), "slots")
    return Mix(documents, sources, slots, block)

"""Helpers shared by the operators of this subpackage: tables, Arrow groups, hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXT_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``TEXT_ROWS`` rows, as texts are long, unless the session has a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, TEXT_ROWS)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Texts of one byte per character take Spark's quick ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


LEAST_BITS, MOST_BITS = 16, 22


def bit_table(values: DataFrame) -> tuple[Column, int]:
    """A bit table over the values of one column, as an array of longs, and the logarithm of its size in bits.

    Rows that do not pass it cannot join with the values. Its size follows their number, from 2^16 to 2^22 bits (512 kB);
    beyond that more rows pass, and the join that follows decides as before.
    """
    size = values.count()
    log = min(max((16 * size).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.pmod(F.xxhash64(values.columns[0]), F.lit(1 << log))
    slots = (
        values.select(place.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("slot"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    )
    table = ["0"] * (1 << (log - 6))
    for row in slots.collect():  # at most 2^16 rows, whatever the input
        table[row.slot] = str(row.bits)
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>"), log


def passes(column: str, table: Column, log: int) -> Column:
    place = F.pmod(F.xxhash64(column), F.lit(1 << log))
    bits = F.get(table, F.shiftright(place, 6).cast("int"))
    return F.call_function("shiftright", bits, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)
    return mix64(steps * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def key_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a partition sorted by integer ``keys``; holds one batch and one open run."""
    open_parts: list[pa.Table] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows.column(k).to_numpy() for k in keys]
        change = np.zeros(rows.num_rows - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change) + 1, [rows.num_rows]])
        for lo, hi in zip(starts[:-1], starts[1:]):
            key = tuple(c[lo] for c in columns)
            if key != open_key and open_parts:
                yield pa.concat_tables(open_parts)
                open_parts = []
            open_key = key
            open_parts.append(rows.slice(lo, hi - lo))
    if open_parts:
        yield pa.concat_tables(open_parts)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links: every node that is no root, and the smallest node of its tree."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist()):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    roots = np.fromiter((find(i) for i in range(len(nodes))), dtype=np.int64, count=len(nodes))
    inner = roots != np.arange(len(nodes))
    return nodes[inner], nodes[roots[inner]]


FOREST_LINKS = 100_000


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace links by spanning trees, at most ``FOREST_LINKS`` links in memory at a time."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held = 0

    def shrink() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate(a), np.concatenate(b))

    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= FOREST_LINKS:
            u, v = shrink()
            if len(u) > held // 2:  # little to gain by holding on
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                a, b, held = [], [], 0
            else:
                a, b, held = [u], [v], len(u)
    if held:
        u, v = shrink()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of undirected ``links`` (two long columns): rows (node, component_id).

    ``component_id`` is the smallest node that can be reached. Nodes without a link to another node do not
    appear. Each partition first shrinks its links to spanning trees by union-find; the trees are then
    contracted by alternating large-star and small-star steps, written to the shared folder, until nothing
    changes. Minima combine before the shuffle, so a node with very many links is no hot spot. The driver sees
    two numbers per step.
    """
    first, second = links.columns[:2]
    edges = links.select(F.col(first).cast("long").alias("u"), F.col(second).cast("long").alias("v"))
    edges = edges.where("u <> v").mapInArrow(_forests, "u long, v long")
    edges = stage(edges.distinct(), "links")
    seen = None
    while True:
        size, mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not size or (size, mark) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(
                edges.select(F.col("v"), F.col("v")).distinct()
            )
        seen = (size, mark)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = stage(small, "links")

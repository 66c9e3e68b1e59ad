"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

A vector is normalised in double precision. In each of ``TABLES`` tables, ``PROJECTIONS`` random Gaussian projections
are shifted, divided by ``WIDTH`` and rounded down; the cells together name a bucket. Two unit vectors of cosine 0.9
are 0.447 apart and share a cell with probability 0.82, so they meet in one of the tables with probability 0.99; at
cosine 0.95 with 0.9998. Links are the pairs that meet and have a cosine of at least the threshold.

Equal vectors are one class, counted and not copied. A bucket with more than ``BLOCK`` classes is dealt in blocks, and
each pair of blocks is compared by a matrix product in one task. A pair that meets in several tables counts in the
first only, told from the bucket names both carry. What leaves a task is the number of links of each class and a
spanning forest, never the pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different length never meet; rows with null id have no component (null), are kept, and count as links of others; rows
that share an id and a vector are links of each other; the row's other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import components, forest, key_groups, mix64, odd_constants
from wakeline.session import stage

TABLES = 32
PROJECTIONS = 10
WIDTH = 2.0
BLOCK = 1024
PAIRS = 50_000  # cosines worked out together

_CELL = odd_constants(PROJECTIONS, 6)


def _hashing(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections and shifts for vectors of ``size`` components: the same wherever they are drawn."""
    draw = np.random.default_rng([size, 20])
    return draw.standard_normal((size, TABLES * PROJECTIONS)), draw.uniform(0, WIDTH, TABLES * PROJECTIONS)


def bucket_names(unit: np.ndarray) -> np.ndarray:
    """A 64-bit bucket name by row and table."""
    directions, shifts = _hashing(unit.shape[1])
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64)
    parts = cells.reshape(len(unit), TABLES, PROJECTIONS)
    names = (parts * _CELL).sum(axis=2, dtype=np.uint64)
    return mix64(names + np.uint64(unit.shape[1])).view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Normalised rows; scaled by the largest component first, so that squares neither overflow nor vanish."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _hash_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, vector) to (class, unit vector and names as bytes, names)."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy()
        for size in np.unique(lengths):
            rows = batch.filter(pa.array(lengths == size))
            unit = _unit(rows.column(1).flatten().to_numpy().reshape(-1, size))
            names = bucket_names(unit)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    rows.column(2),
                    pa.array([u.tobytes() for u in unit], pa.binary()),
                    pa.array([n.tobytes() for n in names], pa.binary()),
                    pa.array(names.tolist(), pa.list_(pa.int64())),
                ],
                ["cls", "copies", "unit", "names", "keys"],
            )


def _compare(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within each block pair of a bucket: links counted by class (b null), and a spanning forest of the classes."""
        for group in key_groups(batches, ["tab", "key", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            cls, copies, own = (group.column(c).to_numpy() for c in ("cls", "copies", "own"))
            tab, lo, hi = (group.column(c)[0].as_py() for c in ("tab", "lo", "hi"))
            vectors = [np.frombuffer(v) for v in group.column("unit").to_pylist()]
            if len({len(v) for v in vectors}) > 1:  # names of different sizes that collide
                continue
            unit = np.stack(vectors)
            names = np.stack([np.frombuffer(n, np.int64) for n in group.column("names").to_pylist()])
            rows, cols = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j = np.nonzero(unit[rows] @ unit[cols].T >= threshold - 1e-9)
            i, j = rows[i], cols[j]
            wanted = (i < j) if lo == hi else np.ones(len(i), bool)
            if tab:
                wanted &= ~(names[i, :tab] == names[j, :tab]).any(axis=1)
            i, j = i[wanted], j[wanted]
            exact = [(unit[i[p : p + PAIRS]] * unit[j[p : p + PAIRS]]).sum(axis=1) for p in range(0, len(i), PAIRS)]
            linked = np.concatenate(exact) >= threshold if exact else np.empty(0, bool)
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            n = np.bincount(i, weights=copies[j], minlength=len(cls)) + np.bincount(j, weights=copies[i], minlength=len(cls))
            some = np.flatnonzero(n)
            u, v = forest(cls[i], cls[j])
            a = np.concatenate([cls[some], u])
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(v, pa.int64())])
            c = np.concatenate([n[some], np.zeros(len(u))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(c)], ["a", "b", "n"])

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9
) -> DataFrame:
    """One row per vector: id, n_links (vectors linked directly), component_id (smallest id reachable), kept."""
    usable = F.coalesce(
        (F.size(vector_col) > 0)
        & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector_col, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(usable, F.col(vector_col).cast("array<double>")).alias("vector"),
    )
    # Adding zero turns -0.0 into 0.0, which equal vectors may differ in.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    keyed = rows.withColumn("digest", F.md5(F.array_join(F.transform("vector", lambda x: F.hex(x.cast("string"))), ",")))
    classes = keyed.where("vector IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector")
    )
    named = stage(classes.withColumn("cls", F.xxhash64("digest")), "classes")
    hashed = stage(
        named.select("cls", "vector", "copies").mapInArrow(
            _hash_rows, "cls long, copies long, unit binary, names binary, keys array<long>"
        ),
        "hashes",
    )
    buckets = hashed.select("cls", F.posexplode("keys").alias("tab", "key"))
    sizes = buckets.groupBy("tab", "key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK)
    dealt = (
        buckets.join(sizes, ["tab", "key"])
        .withColumn("own", F.pmod(F.xxhash64("cls"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("tab", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cls")
    )
    keys = ["tab", "key", "lo", "hi"]
    met = dealt.join(hashed.select("cls", "copies", "unit", "names"), "cls")
    met = met.select(*keys, "own", "cls", "copies", "unit", "names").repartition(*keys).sortWithinPartitions(*keys)
    found = stage(met.mapInArrow(_compare(threshold), "a long, b long, n long"), "links")
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))

    judged = stage(
        named.select("digest", "cls", "least", "copies")
        .join(counts, F.col("cls") == F.col("a"), "left")
        .join(groups, F.col("cls") == F.col("node"), "left")
        .select(
            "digest",
            "least",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "cls").alias("grp"),
        ),
        "judged",
    )
    smallest = judged.groupBy("grp").agg(F.min("least").alias("c"))
    judged = judged.join(smallest, "grp").select("digest", "n_links", "c")
    result = keyed.select("id", "digest").join(judged, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return result.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )

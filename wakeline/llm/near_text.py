"""MinHash near-duplicate detection: SuperMinHash signatures, banding, exact verification, union-find groups.

Words are maximal runs without ASCII white space, A-Z lower-cased. A document's set holds its distinct shingles of
five words (fewer words: the whole sequence as one shingle), each as a 64-bit hash.

SuperMinHash walks, for every element, a random permutation of the registers step by step: step ``j`` offers the
value ``j + r`` to the register the permutation names next. All registers of a document are filled after few steps,
and a later step could only offer larger values, so the walk stops there. The ranks of an element's offers are
correlated across registers, which gives the estimate a lower variance than independent hashes.

Documents with equal sets are one class, represented by its smallest id. Classes that share a band meet in the
band's bucket. A bucket is compared in blocks of about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles against each other, on full
sets, inside the tasks; what leaves a task is a spanning forest of the links found, never the pairs. Three bands run first; the
remaining bands then compare only buckets that still hold more than one group.

Defined results: null or empty text, or text without words, has an empty set, links with nothing and is kept; rows
with null id are their own group (``component_id`` null) and are kept; rows that share an id are judged one by one;
exact repeats of a row share its class and its verdict. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import bit_table, components, forest, key_groups, mix64, odd_constants, passes, text_batches
from wakeline.session import stage

SHINGLE = 5
BANDS, ROWS = 21, 6
REGISTERS = BANDS * ROWS
FIRST_BANDS = 3
BLOCK = 1024
BLOCK_SHINGLES = 300_000  # of 8 bytes
PER_WALK = 200_000  # elements whose walks run together
WORD_CACHE = 200_000
COLUMNS = 1024  # shingles per slice of the comparison

_MULTIPLIERS = odd_constants(SHINGLE + 1, 1)
_BAND = odd_constants(ROWS + 1, 2)
_GOLDEN = 0x9E3779B97F4A7C15


class _WordHashes(dict):
    """64-bit hashes of words, remembered for the most recent ``WORD_CACHE`` new words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: dict) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    if n < SHINGLE:
        counted = np.append(w, np.uint64(n)) * np.append(_MULTIPLIERS[:n], _MULTIPLIERS[SHINGLE])
        return mix64(counted.sum(keepdims=True, dtype=np.uint64))
    total = w[: n - SHINGLE + 1] * _MULTIPLIERS[0]
    for i in range(1, SHINGLE):
        total = total + w[i : n - SHINGLE + 1 + i] * _MULTIPLIERS[i]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, one row per set."""
    counts = np.array([len(s) for s in sets])
    result = np.full((len(sets), registers), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = result.reshape(-1)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), counts)
    order = None  # of the registers, per element; needed from the second step on
    for j in range(registers):
        draw = mix64(element + np.uint64(((j + 1) * _GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        pick = (j + ((draw & np.uint64(0xFFFFFF)) * np.uint64(registers - j) >> np.uint64(24)).astype(np.int64))
        offer = np.uint64(j << 40) | (draw >> np.uint64(24))
        if order is None:
            target = pick
        else:
            rows = np.arange(len(element))
            target = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        np.minimum.at(flat, owner * registers + target, offer)
        waiting = (result == np.iinfo(np.uint64).max).any(axis=1)
        if not waiting.any():
            break
        going = waiting[owner]
        if order is None:
            element, owner, pick = element[going], owner[going], pick[going]
            order = np.tile(np.arange(registers, dtype=np.uint8), (len(element), 1))
            order[np.arange(len(element)), pick] = 0
        elif not going.all():
            element, owner, order = element[going], owner[going], order[going]
    return result


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One bucket key per band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    return mix64((parts * _BAND[:rows]).sum(axis=2, dtype=np.uint64)).view(np.int64)


def _fingerprint(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sign(bands: int, rows: int):
    """(id, text, text hash) to (id, text_hash, n_shingles, fp, bands); fp and bands are null for empty sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column(1)
            lo = 0
            while lo < len(texts):
                sets: list[np.ndarray] = []
                held, hi = 0, lo
                while hi < len(texts) and held < PER_WALK:
                    sets.append(shingle_set(texts[hi].as_py(), hashes))
                    held += len(sets[-1])
                    hi += 1
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, bands * rows), bands, rows).tolist() if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", "text_hash", "n_shingles", "fp", "bands"],
                )
                lo = hi

    return run


def _full_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), hashes) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([_fingerprint(s) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary()),
            ],
            ["rep", "fp", "shingles"],
        )


def intersections(sets: list[np.ndarray], rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of ``sets[rows]`` with ``sets[cols]``, by slices of the shared shingles."""
    counts = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), counts)
    element = np.concatenate(sets)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    new = np.ones(len(element), bool)
    new[1:] = element[1:] != element[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1]
    total = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        total += m[rows] @ m[cols].T
    return total.astype(np.int64)


def _compare(percent: int):
    """Within each block pair of a bucket: the spanning forest of the links on full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        for group in key_groups(batches, ["band", "key", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            ids = group.column("rep").to_numpy()
            own = group.column("own").to_numpy()
            lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in sets])
            rows, cols = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            if not len(rows) or not len(cols):
                continue
            both = intersections(sets, rows, cols)
            linked = 100 * both >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - both)
            i, j = np.nonzero(linked)
            a, b = ids[rows[i]], ids[cols[j]]
            other = a != b
            if other.any():
                u, v = forest(a[other], b[other])
                out_a.append(u)
                out_b.append(v)
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets. ``members``: band, key, rep, fp, n and total (the bucket's classes and their shingles)."""
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    dealt = (
        members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "fp")
    )
    keys = ["band", "key", "lo", "hi"]
    rows = dealt.join(sets, ["rep", "fp"]).select(*keys, "own", "rep", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(percent), "a long, b long")


def _shared(buckets: DataFrame, least: int = 2) -> DataFrame:
    """Buckets with at least two classes, every member with the bucket's size."""
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where(F.col("n") >= least)
    return buckets.drop("size").join(sizes, ["band", "key"])


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    banding: tuple[int, int] = (BANDS, ROWS),
) -> DataFrame:
    """One row per document: id, text_hash (xxhash64), n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= ``percent`` * |A or B| over their full shingle sets;
    ``component_id`` is the smallest id that links lead to, and the document with that id is kept. ``banding`` is the
    number of bands and of registers in each; a lower ``percent`` needs more bands or shorter ones.
    """
    text_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = source.withColumn("text_hash", F.xxhash64("text"))
    signed = stage(hashed.mapInArrow(_sign(*banding), "id long, text_hash long, n_shingles long, fp binary, bands array<long>"), "signatures")
    named = signed.where("n_shingles > 0 AND id IS NOT NULL")
    classes = stage(named.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("rep", "fp", "size", F.posexplode("bands").alias("band", "key"))
    members = stage(_shared(buckets), "buckets")

    wanted = members.select("rep", "fp").distinct()
    wanted_ids = stage(wanted.select(F.col("rep").alias("id")).distinct(), "wanted")
    may_match = passes("id", *bit_table(wanted_ids))  # keeps most texts out of the shuffle
    texts = source.where("id IS NOT NULL").where(may_match).join(wanted_ids, "id", "left_semi")
    full = texts.select("id", "text").mapInArrow(_full_sets, "rep long, fp binary, shingles binary")
    sets = stage(full.join(wanted, ["rep", "fp"], "left_semi").dropDuplicates(["rep", "fp"]), "sets")

    early = stage(_linked(members.where(F.col("band") < FIRST_BANDS), sets, percent), "links")
    groups = stage(components(early), "groups")
    late = members.where(F.col("band") >= FIRST_BANDS).join(groups, F.col("rep") == F.col("node"), "left")
    late = late.withColumn("grp", F.coalesce("component_id", "rep")).drop("node", "component_id")
    open_ = late.groupBy("band", "key").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y")
    rest = _linked(late.drop("grp").join(open_.drop("x", "y"), ["band", "key"]), sets, percent)
    found = components(early.union(rest))

    grouped = classes.select("fp", "rep").join(found, F.col("rep") == F.col("node"), "left")
    grouped = grouped.select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    result = signed.select("id", "text_hash", "n_shingles", "fp").join(grouped, "fp", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return result.select(
        F.col("id").alias(id_col),
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )

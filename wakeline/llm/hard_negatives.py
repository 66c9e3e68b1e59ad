"""Hard-negative mining by inner products, with LEMP-style pruning: length buckets and sorted coordinate lists.

Vectors are quantised to whole numbers (``floor(256 * x)``), so scores are exact integers. Rows are dealt in shards by
hash; a shard sorts its vectors by length and cuts them in buckets, each of which holds a sorted list of the normalised
values of every coordinate. Anchors come to every shard in blocks. For an anchor, the scores that still matter bound the cosine
to a bucket's vectors: from below by the least score wanted (a window's lower end, or the k-th best score so far) over
the lengths, from above by the window's upper end. A bucket whose bounds are empty is skipped. In the others the bounds turn
into a range of feasible values for each of the anchor's ``FOCUS`` largest coordinates; the rows that lie in all
these ranges, looked up in the sorted lists, are the candidates, whose scores are worked out exactly. Where no range
leaves out ``SELECTIVE`` of a bucket, as is common at low thresholds, the whole bucket is the candidate set and a block of
anchors is verified by one matrix product. Pruning only leaves out rows that cannot qualify: results are exact.

First every shard offers each anchor's best rows of its own label; the best of all shards are its positives. Then their
scores give each (anchor, positive) a window of scores, and every shard offers its best rows of other labels there.
Shards offer at most the number of rows wanted, whatever lies in them, so equal vectors are no hot spot; pairs are never
listed.

Defined results: rows with a null id, label or vector or a null or non-finite component take no part, nor do vectors of a
length of 2^27 or more (in units of 1/256), whose scores would not fit a long; vectors of different sizes never meet, empty ones
score 0 with each other; exact repeats of a row (id, label, vector) count once; other rows that share an id are rows of
their own, but none is a positive or a negative of its own id; ties between rows of one id go by label. Other columns are not
looked at. An empty table, or one without anchors, gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import key_groups
from wakeline.session import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # per cent of the positive's score
SHARD_VALUES = 1 << 21  # components of a shard's vectors, 16 MB, and as much again for each of three lists
LEAST_SHARDS = 32
BUCKET = 1024  # rows
ANCHORS = 256  # in a block
FOCUS = 4
SELECTIVE = 0.5
EXACT = 2.0**26  # lengths whose scores are exact in double precision
LONGEST = 2.0**27
SLACK = 1e-9
FAR = 2**62  # beyond any score


class Best:
    """The best ``k`` scored rows of each query, by descending score, then id, then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.row = (np.empty(0, np.int64) for _ in range(3))
        self.worst = np.full(queries, -FAR)  # a row with a lower score is no use

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        q, s, r = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.row, row)))
        order = np.lexsort((r, ids[r], -s, q))
        q, s, r = q[order], s[order], r[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        keep = place < self.k
        self.query, self.score, self.row = q[keep], s[keep], r[keep]
        full = place == self.k - 1
        self.worst[q[full]] = s[full]


class Index:
    """Vectors of one size in buckets of similar length, longest first, each with a sorted list for every coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.labels, self.lengths, self.order = ids[order], labels[order], lengths[order], order
        exact = not len(lengths) or lengths.max() < EXACT
        self.vectors = vectors[order].astype(np.float64 if exact else np.int64)
        self.buckets = []
        for at in range(0, len(order), BUCKET):
            rows = slice(at, min(at + BUCKET, len(order)))
            least = self.lengths[rows][-1]
            lists = None
            if least > 0 and vectors.shape[1]:
                unit = self.vectors[rows] / self.lengths[rows][:, None]
                by_value = np.argsort(unit, axis=0).T
                lists = by_value, np.take_along_axis(unit.T, by_value, axis=1)
            self.buckets.append((rows, self.lengths[at], least, lists))

    def search(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, fits: Callable) -> Best:
        """The best ``k`` rows of every query, a window of scores of an anchor; queries are numbered anchor by anchor.

        ``low`` and ``high`` (inclusive) have a row per anchor and a column per window, -FAR and FAR being open;
        ``fits(a, rows)`` tells which rows of a slice anchor number ``a`` (an array) may have.
        """
        count, windows = low.shape
        best = Best(count * windows, k)
        length = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        exact = self.vectors.dtype == np.float64 and (not count or length.max() < EXACT)
        table = self.vectors if exact else self.vectors.astype(np.int64)
        anchors = anchors.astype(table.dtype)
        unit = anchors / np.where(length > 0, length, 1)[:, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]
        for rows, longest, least, lists in self.buckets:
            wanted = np.maximum(low, best.worst.reshape(count, windows))
            open_ = wanted <= high
            lowest = np.where(open_, wanted, FAR).min(axis=1)
            highest = np.where(open_, high, -FAR).max(axis=1)
            reach = length * longest * (1 + SLACK) + SLACK
            live = np.flatnonzero(open_.any(axis=1) & (lowest <= reach) & (highest >= -reach))
            if not len(live):
                continue
            pruned = []
            if lists is not None:
                live, pruned = self._prune(live, unit, focus, length, lowest, highest, longest, least, lists)
            if len(live):
                scores = (anchors[live] @ table[rows].T).astype(np.int64)
                use = fits(live, rows)
                for w in range(windows):
                    a, r = np.nonzero(use & (scores >= wanted[live, w, None]) & (scores <= high[live, w, None]))
                    best.add(live[a] * windows + w, scores[a, r], r + rows.start, self.ids)
            for a, found in pruned:
                found = found[fits(np.array([a]), rows)[0, found]] + rows.start
                scores = (table[found] @ anchors[a]).astype(np.int64)
                for w in range(windows):
                    good = (scores >= wanted[a, w]) & (scores <= high[a, w])
                    best.add(np.full(good.sum(), a * windows + w), scores[good], found[good], self.ids)
        return best

    @staticmethod
    def _prune(live, unit, focus, length, lowest, highest, longest, least, lists):
        """Anchors that need the whole bucket, and (anchor, candidates) of those whose ranges are selective."""
        by_value, values = lists
        size = by_value.shape[1]
        n = length[live]
        some = np.where(n > 0, n, 1)
        # Bounds of the cosine over the bucket's lengths; 0 / length is 0 on either side.
        lower = np.where(lowest[live] > 0, lowest[live] / (some * longest), lowest[live] / (some * least))
        upper = np.where(highest[live] > 0, highest[live] / (some * least), highest[live] / (some * longest))
        nearest = np.arccos(np.clip(upper + SLACK, -1, 1))  # angles between anchor and row
        farthest = np.arccos(np.clip(lower - SLACK, -1, 1))
        f = focus[live]
        own = np.arccos(np.clip(np.take_along_axis(unit[live], f, axis=1), -1, 1))  # angles of the anchor to the axis
        near, far = nearest[:, None], farthest[:, None]
        # The row's angle to the axis lies between |own - angle| and own + angle, folded at a half turn.
        smallest = np.where(own < near, near - own, np.where(own > far, own - far, 0))
        fold = np.pi - own
        largest = np.where(fold < near, 2 * np.pi - own - near, np.where(fold > far, own + far, np.pi))
        from_, to = np.cos(largest) - SLACK, np.cos(smallest) + SLACK
        begin = np.empty(f.shape, np.int64)
        end = np.empty(f.shape, np.int64)
        for c in np.unique(f):
            at = f == c
            begin[at] = np.searchsorted(values[c], from_[at], "left")
            end[at] = np.searchsorted(values[c], to[at], "right")
        left = end - begin
        selective = (left.min(axis=1) <= size * (1 - SELECTIVE)) & (n > 0)
        pruned = []
        for i in np.flatnonzero(selective):
            order = np.argsort(left[i])
            if left[i, order[0]] <= 0:
                continue
            found = np.zeros(size, np.int8)
            for j in order:
                found[by_value[f[i, j], begin[i, j] : end[i, j]]] += 1
            pruned.append((live[i], np.flatnonzero(found == len(order))))
        return live[~selective], pruned


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def _pack_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of one size to blocks of at most ``ANCHORS``, one row a block."""
    names = ["size", "keys", "ids", "labels", "vectors", "windows"]
    for group in key_groups(batches, ["size"]):
        for at in range(0, group.num_rows, ANCHORS):
            part = group.slice(at, ANCHORS)
            columns = [part.column(c).to_numpy().astype("<i8").tobytes() for c in ("akey", "id", "label")]
            blobs = [*columns, b"".join(part.column("vector").to_pylist()), b"".join(part.column("windows").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("size")[0].as_py()], pa.int64()), *[pa.array([b], pa.binary()) for b in blobs]], names
            )


BLOCK_SCHEMA = "size long, keys binary, ids binary, labels binary, vectors binary, windows binary"
OFFER_SCHEMA = "akey long, window int, id long, label long, score long"


def _offers(same_label: bool, k: int, windows: int):
    """What one shard offers to each anchor: its best rows of the same label, or of other labels inside the windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, {}
        parts: list[pa.Table] = []
        for group in key_groups(batches, ["shard", "size", "kind"]):
            here = (group.column("shard")[0].as_py(), group.column("size")[0].as_py())
            if group.column("kind")[0].as_py() == 0:
                shard, parts = here, group
                ids, labels = (parts.column(c).to_numpy() for c in ("id", "label"))
                vectors = _matrix(parts.column("vector"))
                if same_label:
                    index = {x: Index(ids[m], labels[m], vectors[m]) for x in np.unique(labels) for m in [labels == x]}
                else:
                    index = {None: Index(ids, labels, vectors)}
                continue
            if here != shard:  # a shard without rows of this size
                continue
            for block in group.to_pylist():
                keys, ids, labels = (np.frombuffer(block[c], "<i8") for c in ("keys", "ids", "labels"))
                vectors = np.frombuffer(block["vectors"], "<i8").reshape(len(ids), -1)
                bounds = np.frombuffer(block["windows"], "<i8").reshape(len(ids), windows, 2)
                for label, table in index.items():
                    mine = np.arange(len(ids)) if label is None else np.flatnonzero(labels == label)
                    if not len(mine):
                        continue

                    def fits(a: np.ndarray, rows: slice) -> np.ndarray:
                        other = table.ids[rows][None, :] != ids[mine[a]][:, None]
                        return other if same_label else other & (table.labels[rows][None, :] != labels[mine[a]][:, None])

                    best = table.search(vectors[mine], bounds[mine, :, 0], bounds[mine, :, 1], k, fits)
                    if len(best.query):
                        columns = [
                            keys[mine[best.query // windows]],
                            (best.query % windows).astype(np.int32),
                            table.ids[best.row],
                            table.labels[best.row],
                            best.score,
                        ]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["akey", "window", "id", "label", "score"])

    return run


def _best(offers: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("akey", "window").orderBy(F.col("score").desc(), "id", "label")
    return offers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, vector as little-endian longs, size, akey) of the rows that take part, exact repeats once."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.when(fine, F.col(vector_col)).alias("v"))
    exact = F.transform(F.col("v").cast("array<double>"), lambda x: x * SCALE)
    length = F.sqrt(F.aggregate(exact, F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(length < LONGEST)
    rows = rows.select("id", "label", F.transform(exact, lambda x: F.floor(x)).alias("v")).distinct()
    return rows.withColumn("akey", F.xxhash64("id", "label", "v"))


def _to_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("v")
        vectors = [v.values.to_numpy().astype("<i8").tobytes() if len(v) else b"" for v in batch.column(at)]
        sizes = pa.array([len(v) // 8 for v in vectors], pa.int64())
        columns = [batch.column("id"), batch.column("label"), batch.column("akey"), sizes, pa.array(vectors, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "label", "akey", "size", "vector"])


def mine(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``id`` (the id as a long) that picks the anchors, ``label`` an expression of the label. For each anchor
    and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score lies
    between ``low`` and ``high`` per cent of the positive's.
    """
    rows = usable(vectors, id_col, vector_col, F.col("label") if label is None else label)
    rows = stage(rows.mapInArrow(_to_bytes, "id long, label long, akey long, size long, vector binary"), "vectors")
    shards = max(LEAST_SHARDS, -(-(rows.agg(F.sum("size")).first()[0] or 0) // SHARD_VALUES))
    anchors = rows.where(anchor)
    dealt = rows.select(F.pmod("akey", F.lit(shards)).alias("shard"), "size", F.lit(0).alias("kind"), "id", "label", "vector")

    def offers(queries: DataFrame, same_label: bool, k: int, windows: int) -> DataFrame:
        packed = queries.repartition("size", F.pmod("akey", F.lit(LEAST_SHARDS))).sortWithinPartitions("size")
        blocks = stage(packed.mapInArrow(_pack_anchors, BLOCK_SCHEMA), "anchors")
        sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).withColumn("kind", F.lit(1))
        met = dealt.unionByName(sent, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", "size", "kind")
        return met.mapInArrow(_offers(same_label, k, windows), OFFER_SCHEMA)

    def pair(low: int, high: int) -> bytes:
        return np.array([low, high], "<i8").tobytes()

    everything = F.lit(pair(-FAR, FAR))
    near = _best(offers(anchors.withColumn("windows", everything), True, positives, 1), positives)
    near = near.select("akey", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stage(near, "positives")
    listed = near.groupBy("akey").agg(F.collect_list(F.struct("window", "positive_score")).alias("scores"))  # at most ``positives``

    def windowed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Score windows, one for each positive; those without a positive are empty."""
        for batch in batches:
            blobs = []
            for scores in batch.column("scores").to_pylist():
                bounds = [pair(1, 0)] * positives
                for s in scores:
                    p = s["positive_score"]
                    bounds[s["window"] - 1] = pair(-(-low * p // 100), high * p // 100)
                blobs.append(b"".join(bounds))
            at = batch.schema.get_field_index("scores")
            yield batch.set_column(at, "windows", pa.array(blobs, pa.binary()))

    queries = anchors.join(listed, "akey").select("id", "label", "akey", "size", "vector", "scores")
    queries = queries.mapInArrow(windowed, "id long, label long, akey long, size long, vector binary, windows binary")
    found = _best(offers(queries, False, negatives, positives), negatives)
    found = found.select("akey", (F.col("window") + 1).alias("window"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("akey", F.col("id").alias("anchor_id"))
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return found.join(near, ["akey", "window"]).join(named, "akey").select(*columns)

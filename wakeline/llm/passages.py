"""Repeated byte strings across a corpus, by suffix arrays of shards of text that can match.

A byte is removed when a string of ``SIZE`` bytes that covers it also starts anywhere else. Two equal strings of that
size hold the same smallest hash among their ``GRAM``-byte grams at the same place, so each run of windows that
share this gram (a *segment*, about 85 windows) needs comparing only with segments of the same gram. Segments whose gram
occurs once in the corpus cannot repeat, and are dropped by a combining aggregation. Equal segments are counted, not
copied; different segments of one gram go to one shard as bytes. A shard's suffix array is built by induced sorting
(``suffixes``), and neighbours whose common prefix reaches ``SIZE`` bytes, in permuted text order, are repeated windows.

A gram with more than ``BLOCK`` different segments is dealt over several shards. Each shard then also reports one
digest per different window, and digests of the same gram meet in a combining aggregation across the shards, so a gram
found everywhere neither fills a task nor loses a match.

Defined results: a null text is empty; rows with null id, and exact repeats of a row, are texts like any other (the
repeats match each other). Strings are judged on the input. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import key_groups, mix64, odd_constants
from wakeline.llm.suffixes import equal_neighbours, suffix_array
from wakeline.session import stage

SIZE = 200
GRAM = 32
BLOCK = 4096  # different segments of a gram in one shard
SLICE = 2_000_000  # bytes segmented together
SHARD = 2_000_000  # bytes in one suffix array

_BYTES = odd_constants(256, 3)
_DOUBLINGS = odd_constants(5, 4)
_PLACE = np.uint64((1 << 24) - 1)
_SPAN = SIZE - GRAM + 1


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` neighbours."""
    step = 1
    while 2 * step <= span:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = span - step
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def segments(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one smallest gram, of texts [starts, ends) in ``buffer``: first window, windows, gram hash."""
    none = np.empty(0, np.int64)
    if len(buffer) < SIZE:
        return none, none, none
    gram = _BYTES[buffer]
    for i, step in enumerate((1, 2, 4, 8, 16)):
        gram = gram[:-step] * _DOUBLINGS[i] + gram[step:]
    gram = mix64(gram)
    placed = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    least = (_least(placed, _SPAN) & _PLACE).astype(np.int64)
    inside = np.zeros(len(least) + 1, np.int8)
    whole = ends - starts >= SIZE
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - SIZE + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return none, none, none
    at = least[windows]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return windows[first], np.diff(first, append=len(at)), gram[at[first]].view(np.int64)


_SEGMENT = "loc long, th int, start long, n int, key long, h long"


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in slices of about ``SLICE`` bytes: buffer, text numbers, their places in it, and the offset in the text.

    A longer text comes in several slices that overlap by less than one window.
    """
    parts: list[bytes] = []
    numbers: list[int] = []
    offsets: list[int] = []
    held = 0

    def slice_() -> tuple:
        sizes = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        return b"".join(parts), np.array(numbers), ends - sizes, ends, np.array(offsets, np.int64)

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - SIZE + 1, 0), SLICE):
            part = text[at : at + SLICE + SIZE - 1]
            parts.append(part)
            numbers.append(number)
            offsets.append(at)
            held += len(part)
            if held >= SLICE:
                yield slice_()
                parts, numbers, offsets, held = [], [], [], 0
    if parts:
        yield slice_()


def _segments_of(texts: list[bytes]) -> Iterator[tuple]:
    """Per slice: buffer, text number, start in the text, windows, key and digest of every segment, and its place."""
    for buffer, numbers, starts, ends, offsets in _pieces(texts):
        first, n, key = segments(np.frombuffer(buffer, np.uint8), starts, ends)
        if not len(first):
            continue
        owner = np.searchsorted(starts, first, side="right") - 1
        view = memoryview(buffer)
        digest = [
            xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + n + SIZE - 1).tolist())
        ]
        h = np.array(digest, np.uint64).view(np.int64)
        yield buffer, numbers[owner], first - starts[owner] + offsets[owner], n, key, h, first


def _utf8(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _segment(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loc, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for _, number, start, n, key, h, _ in _segments_of(_utf8(batch.column(2))):
            columns = [loc[number], th[number], start, n.astype(np.int32), key, h]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["loc", "th", "start", "n", "key", "h"])


_WANTED = "key long, shard long, shards long, h long, copies long, bytes binary"


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted segments) to the bytes of these segments."""
    for batch in batches:
        lists = batch.column(1)
        rows = pa.table(dict(zip(["key", "h", "copies", "shard", "shards"], lists.flatten().flatten())))
        ends = np.cumsum(lists.value_lengths().to_numpy())
        wanted_key, wanted_h = rows.column("key").to_numpy(), rows.column("h").to_numpy()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        texts = _utf8(batch.column(0))
        place = {x: i for i, x in enumerate(zip(owner.tolist(), wanted_key.tolist(), wanted_h.tolist()))}
        picks: list[int] = []
        found: list[bytes] = []
        for buffer, number, _, n, key, h, at in _segments_of(texts):
            for x, a, b in zip(zip(number.tolist(), key.tolist(), h.tolist()), at.tolist(), (at + n + SIZE - 1).tolist()):
                i = place.pop(x, None)
                if i is not None:
                    picks.append(i)
                    found.append(buffer[a:b])
        if picks:
            got = rows.take(picks).append_column("bytes", pa.array(found, pa.binary()))
            yield from got.select(["key", "shard", "shards", "h", "copies", "bytes"]).combine_chunks().to_batches()


_FOUND = "key long, h long, shard long, lo int, hi int, w long"


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each segment, as ranges; for grams of several shards also a digest of every window (w)."""

    def shard(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        texts = rows.column("bytes").to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.frombuffer(b"\0".join(texts) + bytes(SIZE), np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        windows = sizes - SIZE + 1
        symbols = joined[: starts[-1] + sizes[-1] + 1].astype(np.uint16) + 2
        symbols[starts[1:] - 1] = 1  # between segments
        symbols[-1] = 0
        inside = np.zeros(len(symbols) + 1, np.int8)
        inside[starts] = 1
        inside[starts + windows] -= 1
        valid = np.cumsum(inside[:-1]) > 0
        sa = suffix_array(symbols, 258, SIZE)
        repeated = equal_neighbours(joined, sa[valid[sa]], SIZE)[: len(symbols)] & valid
        copied = np.flatnonzero(rows.column("copies").to_numpy() > 1)
        for i in copied:  # all of their windows start elsewhere too
            repeated[starts[i] : starts[i] + windows[i]] = True
        step = np.diff(np.concatenate([[0], repeated.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        owner = np.searchsorted(starts, lo, side="right") - 1
        key, h, number = (rows.column(c).to_numpy() for c in ("key", "h", "shard"))
        columns = [
            pa.array(key[owner]),
            pa.array(h[owner]),
            pa.array(number[owner]),
            pa.array((lo - starts[owner]).astype(np.int32)),
            pa.array((hi - starts[owner]).astype(np.int32)),
            pa.nulls(len(lo), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["key", "h", "shard", "lo", "hi", "w"])
        for i in np.flatnonzero(rows.column("shards").to_numpy() > 1):
            n, text = int(windows[i]), texts[i]
            digests = [xxhash.xxh3_64_intdigest(text[a : a + SIZE]) for a in range(n)]
            at = np.arange(n, dtype=np.int32)
            same = [pa.array(np.full(n, x[i])) for x in (key, h, number)]
            columns = [*same, pa.array(at), pa.array(at + 1), pa.array(np.array(digests, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "h", "shard", "lo", "hi", "w"])

    held: list[pa.Table] = []
    size = 0
    for group in key_groups(batches, ["key", "shard"]):
        held.append(group)
        size += group.nbytes
        if size >= SHARD:
            yield from shard(pa.concat_tables(held))
            held, size = [], 0
    if held:
        yield from shard(pa.concat_tables(held))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, spans) to what is left of each text."""
    for batch in batches:
        texts = _utf8(batch.column(1))
        rows = []
        for text, spans in zip(texts, batch.column(2).to_pylist()):
            kept, at, removed, runs = [], 0, 0, 0
            end = -1  # of the run that is open
            for span in sorted((s["begin"], s["end"]) for s in spans or ()):
                if span[0] > end:
                    runs += 1
                    kept.append(text[at : span[0]])
                    removed += span[1] - span[0]
                    end = at = span[1]
                elif span[1] > end:
                    removed += span[1] - end
                    end = at = span[1]
            kept.append(text[at:])
            rows.append((len(text), removed, runs, b"".join(kept)))
        n, removed, runs, left = zip(*rows) if rows else ((), (), (), ())
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, runs)), pa.array(left, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_windows(found: DataFrame, block: int, source: DataFrame) -> DataFrame:
    """Ranges (key, h, lo, hi) of windows that start elsewhere too. ``found``: the segments of repeated grams."""
    distinct = stage(
        found.groupBy("key", "h").agg(F.count("*").alias("copies"), F.min("loc").alias("at"), F.first("n").alias("n")), "distinct"
    )
    several = distinct.groupBy("key").agg(F.count("*").alias("u")).where("u > 1")
    shards = F.ceil(F.col("u") / block)
    dealt = distinct.join(several, "key").select(
        "at", F.struct("key", "h", "copies", F.pmod(F.col("h"), shards).alias("shard"), shards.alias("shards")).alias("s")
    )
    wanted = dealt.groupBy("at").agg(F.collect_list("s").alias("wanted"))
    texts = source.select("loc", "text").join(wanted, F.col("loc") == F.col("at")).select("text", "wanted")
    rows = texts.mapInArrow(_fetch, _WANTED).repartition("key", "shard").sortWithinPartitions("key", "shard")
    judged = stage(rows.mapInArrow(_repeats, _FOUND), "repeats")
    across = judged.where("w IS NOT NULL")
    met = across.groupBy("key", "w").agg(F.min("shard").alias("a"), F.max("shard").alias("b")).where("a <> b")
    ranges = judged.where("w IS NULL").unionByName(across.join(met.select("key", "w"), ["key", "w"]), allowMissingColumns=True)
    whole = distinct.where("copies > 1").select("key", "h", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    partial = ranges.join(distinct.where("copies = 1").select("key", "h"), ["key", "h"], "left_semi")
    return whole.union(partial.select("key", "h", "lo", "hi"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that are left)."""
    source = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias("loc"),
        F.coalesce(F.hash(text_col), F.lit(0)).alias("th"),
        F.col(text_col).alias("text"),
    )
    cut = source.select("loc", "th", "text").mapInArrow(_segment, _SEGMENT)
    common = cut.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    found = stage(cut.join(common, "key", "left_semi"), "segments")
    ranges = repeated_windows(found, block, source)
    spans = found.join(ranges, ["key", "h"]).select(
        F.col("loc").alias("l"),
        F.col("th").alias("t"),
        F.struct((F.col("start") + F.col("lo")).alias("begin"), (F.col("start") + F.col("hi") + (SIZE - 1)).alias("end")).alias("s"),
    )
    per_text = spans.groupBy("l", "t").agg(F.collect_set("s").alias("spans"))
    joined = source.join(per_text, (F.col("loc") == F.col("l")) & (F.col("th") == F.col("t")), "left")
    out = joined.select("id", "text", "spans").mapInArrow(
        _cut, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.withColumnRenamed("id", id_col)

"""Periodic runs of words: suffix trees of a stretch and its reversal, constant-time common extensions, Lyndon roots.

Words are maximal runs without ASCII white space. A run is a stretch of consecutive words with smallest period q, at least
``LEAST`` words and ``TIMES`` periods long, that no neighbouring word extends keeping the period.

A stretch that may hold runs becomes a string of word numbers. Ukkonen's algorithm builds its suffix tree and that of its reversal; an Euler
tour of each, kept at the lowest node between neighbouring leaves, with a table of minima over powers of two gives the longest
common extension of any two places, forward and backward, in constant time. The tour's order of leaves, under the order of
words and its inverse, gives the longest Lyndon word that starts at every place (it reaches to the next smaller suffix). Every
run has such a word as its root, so extending the at most 2n roots in both directions finds all runs, with their
smallest periods.

Which stretches may hold runs is told exactly from distances: behind its first period, every word of a run occurs at most q
words before. For each power of two up to a text's length, stretches of words with such near recurrences, lengthened by the
words of one period before that recur as near, are candidates; a run lies whole within one of them. Texts without near recurrences never see a tree, and short
stretches, each with symbols of its own, share one.

Everything happens in the task that holds the text; there is no shuffle. Memory follows the longest text (about 60 bytes a word) and the
longest candidate stretch (about 700 bytes a word).

Defined results: a null text has no words, no runs and an empty collapsed text, as has one without words; rows are judged one by one, whatever their
ids; of the columns only the text is looked at, the others pass through (those that bear a result's name give way).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import text_batches

LEAST = 6
TIMES = 4
TOGETHER = 200_000  # words handled together
STRING = 30_000  # words of short stretches that share a tree
NEVER = np.int64(1) << 40


class SuffixTree:
    """The suffix tree of a string of numbers from 1 on, closed by 0, and common prefixes of its suffixes."""

    def __init__(self, symbols: list[int]):
        text = [*symbols, 0]
        self.size = len(text)
        self._width = max(text) + 1
        self._build(text)
        self._number_leaves()
        self.rank, depths = self._tour(False)
        # Minima of the tour's depths over stretches of 1, 2, 4, ... gaps between leaves.
        self._least = [depths.astype(np.int32)]
        step = 1
        while 2 * step <= self.size:
            last = self._least[-1]
            self._least.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def _build(self, text: list[int]) -> None:
        """Ukkonen: one symbol after the other, with suffix links and open-ended leaves."""
        n, width = len(text), self._width
        start, stop, link, suffix = [0], [0], [0], [-1]
        go: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    suffix.append(i - waiting + 1)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    first = start[child]
                    reach = stop[child]
                    span = (reach if reach <= i else i + 1) - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[first + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(start)
                    go[key] = inner
                    go[inner * width + c] = inner + 1
                    start += (first, i)
                    stop += (first + length, n)
                    link += (0, 0)
                    suffix += (-1, i - waiting + 1)
                    start[child] = first + length
                    go[inner * width + text[first + length]] = child
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        starts, stops = np.array(start, np.int64), np.array(stop, np.int64)
        self._suffix, self._span = np.array(suffix, np.int64), stops - starts
        keys = np.fromiter(go.keys(), np.int64, len(go))
        children = np.fromiter(go.values(), np.int64, len(go))
        order = np.argsort(keys)
        parents = keys[order] // width
        self._children = children[order]
        self._bounds = np.searchsorted(parents, np.arange(len(start) + 1))
        # The closing symbol comes first under either order.
        self._closing = np.zeros(len(start), np.int64)
        self._closing[parents[keys[order] % width == 0]] = 1

    def _number_leaves(self) -> None:
        """Nodes level by level with their depths (symbols from the root), and the leaves below each."""
        depth = np.zeros(len(self._suffix), np.int64)
        self._levels = []  # parents of a level, and its nodes, siblings together
        nodes = np.zeros(1, np.int64)
        while True:
            first, count = self._bounds[nodes], self._bounds[nodes + 1] - self._bounds[nodes]
            total = int(count.sum())
            if not total:
                break
            parents = np.repeat(nodes, count)
            begin = np.cumsum(count) - count
            nodes = self._children[np.arange(total) - np.repeat(begin - first, count)]
            depth[nodes] = depth[parents] + self._span[nodes]
            self._levels.append((parents, nodes, begin[count > 0]))
        self._depth = depth
        self._leaves = (self._suffix >= 0).astype(np.int64)
        for parents, nodes, begin in reversed(self._levels):
            self._leaves[parents[begin]] = np.add.reduceat(self._leaves[nodes], begin)

    def _tour(self, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rank of every suffix, and by rank the depth of the lowest node between the leaf before and this one."""
        place = np.zeros(len(self._suffix), np.int64)
        between = np.zeros(self.size, np.int64)
        for parents, nodes, begin in self._levels:
            leaves = self._leaves[nodes]
            before = np.cumsum(leaves) - leaves
            first = np.diff(np.append(begin, len(nodes)))
            before -= np.repeat(before[begin], first)
            if inverse:
                closing = np.zeros(len(nodes), bool)
                closing[begin] = self._closing[parents[begin]] > 0
                before = np.where(closing, 0, self._leaves[parents] - before - leaves + self._closing[parents])
            place[nodes] = place[parents] + before
            later = before > 0
            between[place[nodes[later]]] = self._depth[parents[later]]
        ends = self._suffix >= 0
        rank = np.empty(self.size, np.int64)
        rank[self._suffix[ends]] = place[ends]
        return rank, between

    def inverse_rank(self) -> np.ndarray:
        """The rank of every suffix under the inverse order of symbols."""
        return self._tour(True)[0]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of symbols that the suffixes at ``a`` and ``b`` (different places) have in common."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        result = np.empty(len(x), np.int64)
        for k in np.unique(level):
            at = level == k
            table = self._least[k]
            result[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return result


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place but the last the next one of smaller rank; the last has the smallest."""
    ranks = rank.tolist()
    found = [0] * (len(ranks) - 1)
    open_: list[int] = []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            found[open_.pop()] = i
        open_.append(i)
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the runs of a string, by start, then period."""
    n = len(symbols)
    if n < max(least, times):
        return np.empty((0, 3), np.int64)
    text = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    forward = SuffixTree(text)
    places = np.arange(n)
    roots = [next_smaller(rank) - places for rank in (forward.rank, forward.inverse_rank())]
    at = np.concatenate([places, places])
    period = np.concatenate(roots)
    right = forward.common(at, at + period)
    del forward
    text.reverse()
    left = SuffixTree(text).common(n - at, n - at - period)
    length = left + period + right
    found = length >= np.maximum(least, times * period)
    rows = np.stack([(at - left)[found], length[found], period[found]], axis=1)
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true values."""
    framed = np.zeros(len(mask) + 2, np.int8)
    framed[1:-1] = mask
    turns = np.flatnonzero(np.diff(framed))
    return turns[::2], turns[1::2]


def candidates(numbers: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (begin, end) of disjoint stretches that contain every run of the texts laid out in ``numbers``.

    ``first`` is the place where each word's text begins.
    """
    n = len(numbers)
    if not n:
        return np.empty((0, 2), np.int64)
    order = np.lexsort((numbers, first))
    same = (numbers[order[1:]] == numbers[order[:-1]]) & (first[order[1:]] == first[order[:-1]])
    apart = (order[1:] - order[:-1])[same]
    distance, ahead = np.full(n, NEVER), np.full(n, NEVER)
    distance[order[1:][same]] = apart
    ahead[order[:-1][same]] = apart
    nearest = np.minimum(distance, ahead)
    longest = int(np.diff(np.append(np.flatnonzero(np.diff(first, prepend=-1)), n)).max())
    found = []
    reach = 2  # periods below it and from half of it on
    while times * (reach // 2) <= longest:
        begin, end = _stretches(distance < reach)
        long_enough = end - begin >= max(least - reach + 1, (times - 1) * (reach // 2), 1)
        begin, end = begin[long_enough], end[long_enough]
        if len(begin):
            # The first period lies before; its words recur ahead, as near.
            since, _ = _stretches(nearest < reach)
            since = since[np.searchsorted(since, begin, "right") - 1]
            found.append(np.stack([np.maximum(np.maximum(begin - reach + 1, since), first[begin]), end], axis=1))
        reach *= 2
    found = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if not len(found):
        return found
    found = found[np.argsort(found[:, 0], kind="stable")]
    until = np.maximum.accumulate(found[:, 1])
    new = np.concatenate([[True], found[1:, 0] >= until[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(found) - 1)
    return np.stack([found[new, 0], until[last]], axis=1)


class _Numbers(dict):
    """Words to numbers, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _judge(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """The runs and the collapsed text of each list of words."""
    seen = _Numbers()
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.fromiter(map(seen.__getitem__, chain.from_iterable(texts)), np.int64, int(begins[-1]))
    first = np.repeat(begins[:-1], sizes)
    stretches = candidates(numbers, first, least, times)
    found = [np.empty((0, 3), np.int64)]
    # A stretch's words are told from those of all others, so several make one string whose runs are theirs.
    sizes = stretches[:, 1] - stretches[:, 0]
    for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // STRING)) + 1):
        if len(at):
            begin, size = stretches[at, 0], sizes[at]
            place = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            runs = runs_of(np.repeat(np.arange(len(at)), size) * len(seen) + numbers[place], least, times)
            runs[:, 0] = place[runs[:, 0]]
            found.append(runs)
    all_runs = np.concatenate(found)  # stretches come in order and are disjoint
    bounds = np.searchsorted(all_runs[:, 0], begins)
    for i, words in enumerate(texts):
        runs = all_runs[bounds[i] : bounds[i + 1]]
        if not len(runs):
            yield runs, b" ".join(words)
            continue
        runs[:, 0] -= begins[i]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(change)[:-1] == 0
        yield runs, b" ".join(w for w, k in zip(words, kept.tolist()) if k)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _detect(least: int, times: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces the last column, a text as bytes, by n_words, runs and collapsed."""
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            at = 0
            while at < len(texts):
                words: list[list[bytes]] = []
                held = 0
                while at + len(words) < len(texts) and held < TOGETHER:
                    words.append((texts[at + len(words)].as_py() or b"").split())
                    held += len(words[-1])
                judged = list(_judge(words, least, times))
                own = batch.slice(at, len(words)).columns[:-1]
                bounds = np.concatenate([[0], np.cumsum([len(r) for r, _ in judged])])
                flat = np.concatenate([r for r, _ in judged])
                runs = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(_RUNS.value_type))
                )
                columns = [*own, pa.array([len(w) for w in words], pa.int64()), runs, pa.array([c for _, c in judged], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])
                at += len(words)

    return run


def detect(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` without the text, with n_words, runs (structs of start, length, period by start, then period) and collapsed.

    ``collapsed`` is the text's words joined by one space, without those that a run holds after its first period.
    """
    text_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in (text_col, "n_words", "runs", "collapsed")]
    # The text comes last and under a name that no other column has.
    text = "_" + max(docs.columns, key=len)
    rows = docs.select(*own, F.col(text_col).cast("binary").alias(text))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    kinds += ["n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed binary"]
    return rows.mapInArrow(_detect(least, times), ", ".join(kinds)).withColumn("collapsed", F.col("collapsed").cast("string"))

"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document's tokens, closed by id 0, are cut into pieces: as large as a window while they last, then of at most ``PIECE``
tokens. The pieces of a partition are dealt in groups of about ``WINDOWS`` windows.
Each group is balanced by multiway differencing: every piece starts as a partial partition with one part filled; the
two partial partitions of largest imbalance are merged, the fullest part of one with the emptiest of the other, until
one is left. Its parts are near-equal windows. A group is closed a little (``SLACK`` tokens a window) below its
capacity, and when a part still exceeds the capacity, the number of windows rises by one and the group is balanced
again. The last group of a partition is balanced in as many windows as it fills; the remainder, less than one window, is
cut along the powers of two of its size, whose windows need no padding.

Everything happens inside a partition, as its rows stream by: no shuffle, and memory for one group and one Arrow
batch of texts. Window ids are the partition's number and a counter, the same whenever the partition is read again.

Defined results: null text is empty and gives the closing id alone; rows with null or repeated id are packed like any
other; an empty table gives no window. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import text_batches

CAPACITY = 1024
PIECE = 64
WINDOWS = 32
SLACK = 4
END = 0
OUT_ROWS = 4000
# How byte-level vocabularies part a text before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _rank_encoding(vocabulary: str):
    """The same vocabulary for the rank-driven encoder, or None if the file is no plain byte-level BPE in rank order."""
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"add_prefix_space": False, "use_regex": True}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if before.get("type") != "ByteLevel" or any(before.get(k) != v for k, v in plain.items()) or spec.get("normalizer"):
        return None
    if model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    # Bytes that are printable stand for themselves, the others for code points from 256 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    ranks = {bytes(byte[c] for c in token): rank for token, rank in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Token ids of whole texts by a tokenizer file.

    Merging by rank gives the same ids several times faster where the file's vocabulary allows it; texts that hold an
    added token's string, and other kinds of vocabulary, go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ranks = _rank_encoding(vocabulary)

    def text(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self._ranks is None or any(a in text for a in self._added):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._ranks.encode_ordinary(text), "<u4").tobytes()


def balance(sizes: list[int], parts: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``parts`` near-equal parts."""
    heap = []
    for i, size in enumerate(sizes):
        sums = [0] * (parts - 1) + [size]
        heap.append((-size, i, sums, [()] * (parts - 1) + [(i,)]))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, sums, held = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        merged = sorted(
            ((a + b, (m, n) if m and n else m or n) for a, m, b, n in zip(sums, held, reversed(other), reversed(more))),
            key=lambda p: p[0],
        )
        low = merged[0][0]
        count += 1
        heapq.heappush(heap, (low - merged[-1][0], count, [s for s, _ in merged], [m for _, m in merged]))

    def leaves(tree: tuple) -> list[int]:
        found, open_ = [], [tree]
        while open_:
            node = open_.pop()
            for x in node:
                if isinstance(x, tuple):
                    open_.append(x)
                else:
                    found.append(x)
        return found

    return [leaves(t) for t in heap[0][3]] if heap else []


class _Packer:
    def __init__(self, partition: int):
        self.base = partition << 36
        self.used = 0
        self.rows: list[tuple] = []
        self.group: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.held = 0

    def window(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc, start, length, ids, total, self.base + self.used, offset))
            offset += length
        self.used += 1

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        at = 0
        room = WINDOWS * (CAPACITY - SLACK)
        while at < total:
            size = min(CAPACITY if total - at >= CAPACITY else PIECE, total - at, room - self.held)
            self.group.append((doc, at, ids[4 * at : 4 * (at + size)], total))
            self.held += size
            at += size
            if self.held == room:
                self.close()

    def close(self) -> None:
        sizes = [len(p[2]) // 4 for p in self.group]
        parts = -(-sum(sizes) // CAPACITY)
        while True:
            windows = balance(sizes, parts)
            if all(sum(sizes[i] for i in w) <= CAPACITY for w in windows):
                break
            parts += 1
        for w in windows:
            self.window([self.group[i] for i in sorted(w)])
        self.group, self.held = [], 0

    def finish(self) -> None:
        """Balanced windows of what is left; the remainder of less than a window along the powers of two of its size."""
        full = self.held // (CAPACITY - SLACK) * (CAPACITY - SLACK)
        if full:
            rest, room, self.group = self.group, full, []
            while room:
                doc, start, ids, total = rest[0]
                take = min(room, len(ids) // 4)
                self.group.append((doc, start, ids[: 4 * take], total))
                rest[:1] = [(doc, start + take, ids[4 * take :], total)] if 4 * take < len(ids) else []
                room -= take
            held = self.held - full
            self.close()
            self.group, self.held = rest, held
        left = self.group[::-1]
        while self.held:
            size = min(1 << (self.held.bit_length() - 1), CAPACITY)
            pieces, room = [], size
            while room:
                doc, start, ids, total = left.pop()
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    left.append((doc, start + take, ids[4 * take :], total))
                room -= take
            self.window(pieces)
            self.held -= size
        self.group = []

    def batch(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        columns = zip(*self.rows)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


_tokens: dict[str, Tokens] = {}  # one per worker, kept between its tasks


def _pack(vocabulary: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId())
        end = np.array([END], "<u4").tobytes()
        if vocabulary not in _tokens:
            _tokens[vocabulary] = Tokens(vocabulary)
        tokens = _tokens[vocabulary]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, tokens.text(text.as_py() or "") + end)
                if len(packer.rows) >= OUT_ROWS:
                    yield packer.batch()
        packer.finish()
        if packer.rows:
            yield packer.batch()

    return run


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed windows: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset.

    ``vocabulary`` is the path of a tokenizer file on every executor. Windows hold at most ``CAPACITY`` ids and are
    padded to it by the reader unless their length is a power of two.
    """
    text_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return source.mapInArrow(_pack(vocabulary), SCHEMA)

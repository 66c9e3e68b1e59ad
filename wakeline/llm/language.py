"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word is a run of letters of the lower-cased text. Its features are byte n-grams of two to
four bytes with the word's edges, prefixes and suffixes of up to five bytes, and its entry in a lexicon of words that
the sample repeats. Letters are those of Unicode, with the marks on them; any other character ends a word.
A document's words are one chain, however long: it is worked out in blocks of ``CHAIN`` words, side by side, which hand
their messages on exactly. Transitions between the languages of neighbouring words are learned, and forward-backward
gives every word's probability of each language.
A document's language has the largest mean probability over all its words; ties go to the first in order.

The model learns on the driver from a bounded sample: at most ``SAMPLE`` different texts for each language, those with
the smallest hash, whole. To see switches, training chains join stretches of different documents. The weights' size is
fixed by ``TABLE`` and the number of languages. Prediction reads each whole text in its task, with no shuffle.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is every text when nothing could be
learned; rows with null id are predicted too but not learned from; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.common import odd_constants, text_batches

CHAIN = 64
SAMPLE = 120
TABLE = 1 << 17
GRAMS = (2, 3, 4)
AFFIX = 5
EPOCHS = 8
BATCHES = 4
STRETCH = 12  # mean words of a stretch in training chains
LEXICON_COUNT = 3
SLICE = 300_000  # characters whose features are worked out together; cut between words, chains go on
UNKNOWN = "und"

_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(range(97, 123)) + list(range(128, 256))] = True
_BETWEEN_WORDS = re.compile("[\x00-@\\[-`{-\x7f]")
_OTHER: dict[str, bool] = {}
_MIX = odd_constants(8, 5)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse, modulo 2^64."""
    if 0 not in _powers or len(_powers[0][0]) < n:
        both = []
        for base in (int(_STEP), _inverse(int(_STEP))):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[0] = (both[0], both[1])
    return _powers[0][0][:n], _powers[0][1][:n]


@dataclass
class Words:
    """The words of some texts, and where their features lie in the weight table."""

    owner: np.ndarray  # the text of each word
    starts: np.ndarray
    ends: np.ndarray
    grams: list[tuple[int, np.ndarray]]  # bytes per gram, table place by position
    affixes: list[np.ndarray]  # table place by word
    hashes: np.ndarray


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h * _MIX[kind]) >> np.uint64(64 - 17)).astype(np.int32)


def _ends_word(char: str) -> bool:
    if char not in _OTHER:
        _OTHER[char] = not (char.isalpha() or unicodedata.category(char).startswith("M"))
    return _OTHER[char]


def _encoded(text: str) -> bytes:
    """The lower-cased text in UTF-8, with a blank for each character outside ASCII that is no letter or mark."""
    text = text.lower()
    if not text.isascii():
        others = "".join(sorted(c for c in set(text) if c > "\x7f" and _ends_word(c)))
        text = re.sub(f"[{others}]", " ", text) if others else text
    return b" " + text.encode("utf-8", "replace") + b" "


def words_of(texts: list[str]) -> Words:
    parts = [_encoded(t) for t in texts]
    pad = b" " * 8
    raw = np.frombuffer(pad + b"".join(parts) + pad, np.uint8)
    inside = _IN_WORD[raw]
    data = np.where(inside, raw, np.uint8(32)).astype(np.uint64)
    edge = np.diff(inside.view(np.int8))
    starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    limits = len(pad) + np.cumsum([len(p) for p in parts])
    owner = np.searchsorted(limits, starts, side="right")
    grams = []
    gram = data
    wide: dict[int, np.ndarray] = {1: data}
    for size in range(2, AFFIX + 1):
        gram = gram[:-1] | (data[size - 1 :] << np.uint64(8 * (size - 1)))
        wide[size] = gram
        if size in GRAMS:
            grams.append((size, _place(gram + np.uint64(size), 0)))
    affixes = []
    for size in (3, 5):
        # A short word has fewer bytes than that with its edges; what stands next to it does not count.
        spare = np.uint64(8) * np.maximum(size - 2 - (ends - starts), 0).astype(np.uint64)
        affixes.append(_place((wide[size][starts - 1] << spare) & np.uint64((1 << 8 * size) - 1), size - 2))
        affixes.append(_place(wide[size][ends + 1 - size] >> spare, size - 1))
    power, inverse = _power_table(len(data))
    running = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * power, dtype=np.uint64)])
    hashes = (running[ends] - running[starts]) * inverse[starts]
    return Words(owner, starts, ends, grams, affixes, hashes)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # TABLE x languages
    lexicon: np.ndarray  # sorted word hashes
    entries: np.ndarray  # one more row than the lexicon, the last for other words
    bias: np.ndarray
    moves: np.ndarray  # from x to

    def entry(self, words: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(words.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, words.hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == words.hashes, at, len(self.lexicon))

    def scores(self, words: Words) -> np.ndarray:
        total = self.entries[self.entry(words)] + self.bias
        for place in words.affixes:
            total += self.table[place]
        for size, place in words.grams:
            running = np.zeros((len(place) + 1, len(self.languages)))
            np.cumsum(self.table[place], axis=0, out=running[1:])
            total += running[words.ends + 2 - size] - running[words.starts - 1]
        return total


def chains(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers by block and position, -1 past a block's end, and each block's number within its chain."""
    n = len(owner)
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if n else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.arange(n) - first
    row = np.cumsum(at % CHAIN == 0) - 1
    grid = np.full((int(row[-1]) + 1 if n else 0, CHAIN), -1, np.int64)
    grid[row, at % CHAIN] = np.arange(n)
    return grid, at[at % CHAIN == 0] // CHAIN


EVEN_OUT = 8  # products are brought back to a sum of one every so many words


def _messages(weight: np.ndarray, live: np.ndarray, number: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each block from the blocks before it, behind the last of their words, and from those after it.

    Each block's words are multiplied to one matrix, for all blocks at once; then these are passed along the chains.
    """
    k = len(change)
    before, after = np.ones((len(number), k)), np.ones((len(number), k))
    linked = np.flatnonzero(number > 0)
    if not len(linked):
        return before, after
    rows = np.union1d(linked, linked - 1)
    place = np.full(len(number), -1)
    place[rows] = np.arange(len(rows))
    first = number[rows] == 0
    product = np.where(first[:, None, None], np.eye(k), change) * weight[0, rows][:, None, :]
    whole = live[:, rows].all(axis=1)
    for t in range(1, len(weight)):
        longer = (product.reshape(-1, k) @ change).reshape(product.shape) * weight[t, rows][:, None, :]
        product = longer if whole[t] else np.where(live[t, rows][:, None, None], longer, product)
        if t % EVEN_OUT == 0:
            product /= product.sum(axis=(1, 2), keepdims=True)
    by_depth = linked[np.argsort(number[linked], kind="stable")]
    steps = np.split(by_depth, np.flatnonzero(np.diff(number[by_depth])) + 1)
    for here in steps:
        out = np.einsum("bi,bij->bj", before[here - 1], product[place[here - 1]])
        before[here] = out / out.sum(axis=1, keepdims=True)
    for here in reversed(steps):
        out = np.einsum("bij,bj->bi", product[place[here]], after[here])
        after[here - 1] = out / out.sum(axis=1, keepdims=True)
    return before, after


def forward_backward(
    scores: np.ndarray, grid: np.ndarray, moves: np.ndarray, number: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each label for every word, and the expected moves summed over all blocks.

    With ``number``, a block that is not its chain's first goes on from the row above, and the moves are not summed.
    """
    k = scores.shape[1]
    likely = np.exp(scores - scores.max(axis=1, keepdims=True))
    likely = np.vstack([likely, np.ones((1, k))])  # row -1: past the end
    change, ones = np.exp(moves - moves.max()), np.ones((k, 1))
    length = int((grid >= 0).sum(axis=1).max(initial=0))
    words = np.ascontiguousarray(grid.T[:length])
    weight, live = likely[words], words >= 0
    ahead = np.empty((length, len(grid), k))
    before, behind = np.ones((len(grid), k)), np.ones((len(grid), k))
    if number is not None:
        before, behind = _messages(weight, live, number, change)
    for t in range(length):
        now = weight[t]
        if t:
            now = now * (ahead[t - 1] @ change)
        elif number is not None:
            now = np.where(number[:, None] > 0, now * (before @ change), now)
        ahead[t] = now / (now @ ones)
    result = np.empty_like(scores)
    expected = np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        both = ahead[t] * behind
        both /= both @ ones
        result[words[t, live[t]]] = both[live[t]]
        if t:
            incoming = weight[t] * behind
            if number is None:
                reached = ((ahead[t - 1] @ change) * incoming) @ ones
                expected += change * (np.where(live[t][:, None], ahead[t - 1] / reached, 0).T @ incoming)
            behind = incoming @ change.T
            behind /= behind @ ones
            behind[~live[t]] = 1
    return result, expected


def train(sample: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fit the field to (language, text) pairs by adaptive gradient steps on the likelihood of switched chains."""
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    k = len(languages)
    number = {lang: i for i, lang in enumerate(languages)}
    draw = np.random.default_rng(seed)
    sample = [sample[i] for i in draw.permutation(len(sample))]
    batches = [sample[i::BATCHES] for i in range(BATCHES)]
    held = []
    for batch in (b for b in batches if b):
        words = words_of([t for _, t in batch])
        labels = np.array([number[lang] for lang, _ in batch])[words.owner]
        if not len(labels):
            continue
        # Cut the words into stretches, shuffle these, and lay them out in chains.
        cut = draw.random(len(labels)) < 1 / STRETCH
        cut |= np.concatenate([[True], words.owner[1:] != words.owner[:-1]])
        stretch = np.cumsum(cut) - 1
        order = np.argsort(draw.permutation(stretch[-1] + 1)[stretch], kind="stable")
        grid, _ = chains(np.zeros(len(labels), np.int64))
        grid = np.where(grid >= 0, order[grid], -1)
        follow = (grid[:, 1:] >= 0).nonzero()
        seen = np.zeros((k, k))
        np.add.at(seen, (labels[grid[:, :-1][follow]], labels[grid[:, 1:][follow]]), 1)
        held.append((words, labels, grid, seen))
    if not held:
        return None
    found, counts = np.unique(np.concatenate([w.hashes for w, *_ in held]), return_counts=True)
    lexicon = found[counts >= LEXICON_COUNT]
    model = Model(languages, np.zeros((TABLE, k)), lexicon, np.zeros((len(lexicon) + 1, k)), np.zeros(k), np.zeros((k, k)))
    squares = [np.full_like(x, 1e-3) for x in (model.table, model.entries, model.bias, model.moves)]
    for _ in range(EPOCHS):
        for words, labels, grid, seen in held:
            marginal, expected = forward_backward(model.scores(words), grid, model.moves)
            error = -marginal
            error[np.arange(len(labels)), labels] += 1
            slope = np.zeros_like(model.table)
            for c in range(k):
                for place in words.affixes:
                    slope[:, c] += np.bincount(place, weights=error[:, c], minlength=TABLE)
                for size, place in words.grams:
                    spread = np.zeros(len(place) + 1)
                    np.add.at(spread, words.starts - 1, error[:, c])
                    np.add.at(spread, words.ends + 2 - size, -error[:, c])
                    slope[:, c] += np.bincount(place, weights=np.cumsum(spread)[:-1], minlength=TABLE)
            entry = np.zeros_like(model.entries)
            np.add.at(entry, model.entry(words), error)
            entry[-1] = 0
            for x, g, s in zip(
                (model.table, model.entries, model.bias, model.moves), (slope, entry, error.sum(axis=0), seen - expected), squares
            ):
                s += g * g
                x += 0.3 * g / np.sqrt(s)
    model.table = model.table.astype(np.float32)
    return model


def _slices(text: str) -> Iterator[str]:
    """The text in pieces of about ``SLICE`` characters, cut between words."""
    at = 0
    while at < len(text):
        cut = _BETWEEN_WORDS.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def judge(model: Model | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean word probabilities by text and language, words by text, and the mean of each word's largest probability.

    Short texts are scored together. A text longer than a slice is scored slice by slice; of its slices only the words'
    scores are kept, and its chain runs over all of them.
    """
    k = len(model.languages) if model else 0
    total, count, sure = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts))

    def add(parts: list[str], owners: list[int]) -> None:
        # All texts but the last are shorter than a slice together.
        pieces = [(parts[:-1], owners[:-1])] + [([piece], owners[-1:]) for piece in _slices(parts[-1])]
        scores, found = [], []
        for part, own in pieces:
            words = words_of(part)
            scores.append(model.scores(words))
            found.append(np.array(own, np.int64)[words.owner])
        owner = np.concatenate(found)
        if not len(owner):
            return
        grid, number = chains(owner)
        marginal, _ = forward_backward(np.concatenate(scores), grid, model.moves, number)
        for c in range(k):
            total[:, c] += np.bincount(owner, weights=marginal[:, c], minlength=len(texts))
        count[:] += np.bincount(owner, minlength=len(texts))
        sure[:] += np.bincount(owner, weights=marginal.max(axis=1), minlength=len(texts))

    parts: list[str] = []
    owners: list[int] = []
    size = 0
    for i, text in enumerate(texts if model else []):
        if text is None or not any(map(str.isalpha, text)):
            continue
        parts.append(text)
        owners.append(i)
        size += len(text)
        if size >= SLICE:
            add(parts, owners)
            parts, owners, size = [], [], 0
    if parts:
        add(parts, owners)
    return total / np.maximum(count, 1)[:, None], count, sure / np.maximum(count, 1)


ANSWERS = {"lang_pred": "string", "score": "double", "n_words": "bigint", "certainty": "double"}


def _predict(model: Model | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            share, count, sure = judge(model, [None if t is None else str(t) for t in texts])
            known = count > 0
            best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(count), int)
            lang = [model.languages[b] if w else UNKNOWN for b, w in zip(best, known)]
            score = np.where(known, np.minimum(share.max(axis=1, initial=0), 1.0), 0.0)
            yield pd.DataFrame(dict(zip(ANSWERS, (lang, score, count, np.minimum(sure, 1.0)))))

    return run


def held_out(id_col: str) -> Column:
    """The documents kept from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """At most ``SAMPLE`` different texts of every language from documents that are not held out."""
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    ranked = known.groupBy("lang", "h").agg(F.lit(1)).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    picked = [r.h for r in ranked.where(F.col("n") <= SAMPLE).select("h").collect()]
    if not picked:
        return []
    texts = known.where(F.col("h").isin(picked)).dropDuplicates(["lang", "h"])
    return sorted((r.lang, r.text) for r in texts.select("lang", "text").collect())


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (the mean probability of that language), n_words and certainty; columns so named give way.

    ``certainty`` is the mean of each word's largest probability, whatever its language. Only the text goes to Python and
    only the answers come back.
    """
    text_batches(docs.sparkSession)
    own = [c for c in docs.columns if c == text_col or c not in ANSWERS]
    kinds = ", ".join(f"{c} {k}" for c, k in ANSWERS.items())
    # A plan may repeat a column's expression in filters, but not one that it takes to give different answers.
    answer = F.pandas_udf(_predict(model), kinds).asNondeterministic()
    inner = "_" + max(docs.columns, key=len)
    answered = docs.select(*own, answer(F.col(text_col)).alias(inner))
    return answered.select(*own, *[F.col(inner)[c].alias(c) for c in ANSWERS if c != text_col])

"""Near duplicates, repeated passages, line chunks and decontamination against plain versions."""

import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from wakeline.llm import decontaminate, line_chunks, near_text, passages
from wakeline.llm.suffixes import suffix_array

WORDS = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with unique ids: edge cases, copies, near copies and shared passages."""
    rng = random.Random(5)
    base, passage = prose(rng, 150), "\n".join(prose(rng, 12) for _ in range(8))
    texts = [None, "", " \n\t ", "one", "one", "Two words", "TWO words", "é É ß 中文", "\n", "x\n" * 30, "a" * 900, prose(rng, 6000)]
    for _ in range(14):
        near = base.split()
        for _ in range(rng.randrange(3)):
            near[rng.randrange(len(near))] = rng.choice(WORDS)
        texts.append(" ".join(near))
    texts += [base, base, base.upper()]
    texts += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(5)]
    texts += [prose(rng, rng.randrange(1, 80)) + "\n" + prose(rng, 5) for _ in range(20)]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    """With columns that bear names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "key", "lines", "kept", "component_id", "n", "h", "loc", "_i"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


EMPTY = "doc_id long, text string"


def test_near_duplicates_match_brute_force(spark, rows, monkeypatch):
    want = plain.near_groups(rows)
    for block in (near_text.BLOCK, 3):
        monkeypatch.setattr(near_text, "BLOCK", block)
        got = {r.doc_id: r for r in near_text.near_duplicates(frame(spark, rows)).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(r.n_shingles == len(plain.shingles(t)) for (i, t) in rows for r in [got[i]])
        assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert len(set(want.values())) < len(rows) - 8


def test_near_duplicates_without_id_and_repeated_rows(spark):
    text = " ".join(WORDS)
    data = [(None, text), (1, text), (1, text), (2, text), (3, None), (None, None), (1, "other words here")]
    got = near_text.near_duplicates(spark.createDataFrame(data, EMPTY)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True),
    ]
    assert near_text.near_duplicates(spark.createDataFrame([], EMPTY)).collect() == []


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        a = rng.integers(0, 2**63, 400).astype(np.uint64)
        b = np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)])
        s = near_text.signatures([np.unique(a), np.unique(b), np.unique(a)[:1]])
        assert (s != np.iinfo(np.uint64).max).all()
        errors.append((s[0] == s[1]).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.02
    assert np.std(errors) < (0.6 * 0.4 / near_text.REGISTERS) ** 0.5 * 1.15


def test_suffix_array_matches_sorting():
    rng = random.Random(2)
    for trial in range(150):
        n, k = rng.randrange(1, 50), rng.choice([2, 3, 6])
        t = [rng.randrange(1, k + 1) if trial % 4 else 1 + i // 3 % 2 for i in range(n)] + [0]
        assert suffix_array(np.array(t), k + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("block", [passages.BLOCK, 1])
def test_passages_match_brute_force(spark, rows, block):
    want = plain.without_repeats(rows)
    got = {r.doc_id: r for r in passages.remove_repeats(frame(spark, rows), block=block).collect()}
    for (i, _), expected in zip(rows, want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected
    assert sum(w[1] for w in want) > 5000


def test_passages_in_slices_and_shards(monkeypatch, rows):
    texts = [(t or "").encode() for _, t in rows]
    whole = [x[2:6] for x in passages._segments_of(texts)]
    monkeypatch.setattr(passages, "SLICE", 300)
    windows = {}
    for _, number, start, n, key, _, _ in passages._segments_of(texts):
        for d, s, c, k in zip(number, start, n, key):
            windows.update({(d, s + j): k for j in range(c)})
    assert len(windows) == sum(max(len(t) - 199, 0) for t in texts) == sum(int(x[1].sum()) for x in whole)


def test_passages_without_id_repeated_rows_and_empty_table(spark):
    long = " ".join(WORDS * 2)
    data = [(None, long), (None, "short"), (7, long + "x"), (8, "y" * 199), (9, "y" * 199), (5, long), (5, long), (5, "z" * 250)]
    got = passages.remove_repeats(spark.createDataFrame(data, EMPTY)).collect()
    want = plain.without_repeats(data)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=key) == sorted(
        ((i, *w) for (i, _), w in zip(data, want)), key=key
    )
    assert passages.remove_repeats(spark.createDataFrame([], EMPTY)).collect() == []


def test_line_chunks_match_brute_force(spark, rows):
    want = plain.without_repeated_chunks(rows)
    found = line_chunks.remove_repeated_chunks(frame(spark, rows))
    assert found.columns.count("kept") == 1 and "key" in found.columns
    got = {r.doc_id: (r.kept, r.n_removed) for r in found.collect()}
    assert got == want
    assert sum(n for _, n in want.values()) > 10


def test_line_chunks_without_id_repeated_rows_and_empty_table(spark):
    text = "\n".join(f"line {i}" for i in range(40))
    data = [(None, text), (1, text), (1, text), (2, "new\n" + text), (3, None), (4, "")]
    got = line_chunks.remove_repeated_chunks(spark.createDataFrame(data, EMPTY)).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].kept == text and by_id[None].n_removed == 0
    assert by_id[1].kept == "" and by_id[1].n_removed == 40
    assert by_id[2].kept == "new" and by_id[2].n_removed == 40 and by_id[2].n_chunks_removed > 5  # boundaries move with the text
    assert by_id[3].kept is None and by_id[3].n_lines == 0 and by_id[4].n_lines == 1
    assert len(got) == 6
    assert line_chunks.remove_repeated_chunks(spark.createDataFrame([], EMPTY)).collect() == []


ITEMS = [
    (0, "alpha beta gamma"), (1, " ".join(f"t{i}" for i in range(25))), (2, "Alpha, BETA: gamma"), (3, None), (None, "w1"),
    (4, "..."), (5, "w3 w3"), (10, " ".join(f"t{i}" for i in range(5, 16))),
]


def test_contamination_matches_brute_force(spark, rows):
    seq = " ".join(f"t{i}" for i in range(30))
    more = rows + [(100, f"x {seq} y"), (101, "alpha beta gamma alpha-beta/gamma"), (102, "alpha beta"), (103, "w3 w3 w3 w3 é w3"), (104, "É alphé")]
    want = plain.contamination(more, ITEMS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("word", F.lit(1))
    got = decontaminate.contamination(frame(spark, more), items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)
    assert want[100][1] == 25 and want[103][2] == ["5"]


def test_contamination_without_id_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "alpha beta gamma"), (1, "no"), (2, None)], EMPTY)
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got) == [(0, 3, 3), (1, 1, 0), (1, 3, 3), (1, 3, 3), (2, 0, 0)]
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == 5 and not any(r.contaminated for r in none)
    assert decontaminate.contamination(docs.limit(0), items).collect() == []

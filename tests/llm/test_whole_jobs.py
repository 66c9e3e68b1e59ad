"""What the pipeline's stages owe beyond the registered queries."""

from collections import Counter

import numpy as np
import plain

import corpus_pipeline
from wakeline.llm import line_chunks, packing

WORDS = [f"w{i}" for i in range(100)]
DOCS = "doc_id long, text string"


def test_near_copies_of_similarity_080_to_085_go(spark, sf_dir):
    near = [w if i not in (30, 60) else "other" for i, w in enumerate(WORDS)]  # 86 of 106 shingles
    far = [w if i not in (20, 50, 80) else "other" for i, w in enumerate(WORDS)]  # 81 of 111
    rows = [(1, " ".join(WORDS)), (2, " ".join(near)), (3, " ".join(far)), (4, "w1 w2")]
    a, b = plain.shingles(rows[0][1]), plain.shingles(rows[1][1])
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    want = {i for i, c in plain.near_groups(rows, 80).items() if c == i}
    got = corpus_pipeline.without_near_duplicates(spark, spark.createDataFrame(rows, DOCS), sf_dir)
    assert {r.doc_id for r in got.collect()} == want == {1, 3, 4}


def test_short_shared_runs_go_whole(spark, sf_dir):
    run = [f"shared line {i}" for i in range(5)]
    rows = [(1, "\n".join(["first", *run, "end"]))]
    for n in range(2, 6):  # every length, each with other text around it
        rows.append((n, "\n".join([f"before {n}", *run[:n], f"after {n}", "", "", f"last {n}"])))
    rows += [(6, "x\nx\nx\nx"), (7, "a\nb\na\nb\na"), (8, "shared line 2"), (9, ""), (10, "\n".join(run))]
    want = plain.without_repeated_chunks(rows)
    assert [want[i][1] for i, _ in rows] == [0, 2, 3, 4, 5, 3, 3, 0, 0, 5]
    found = line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r.doc_id: (r.kept, r.n_removed) for r in found.collect()} == want
    left = corpus_pipeline.without_repeated_lines(spark, spark.createDataFrame(rows, DOCS), sf_dir)
    assert {r.doc_id: r.text for r in left.collect()} == {i: want[i][0] for i, _ in rows if i != 10}
    nulls = line_chunks.remove_repeated_chunks(spark.createDataFrame([(None, "p\nq"), (1, "p\nq"), (2, None)], DOCS)).collect()
    assert {r.doc_id: (r.kept, r.n_lines) for r in nulls} == {None: ("p\nq", 2), 1: ("", 2), 2: (None, 0)}


def test_long_texts_that_share_their_lines(spark):
    lines = [f"line {i}" for i in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["other", *lines, "more"]))]
    found = line_chunks.remove_repeated_chunks(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_removed", "kept").collect()
    assert {r.doc_id: (r.n_removed, r.kept) for r in found} == {1: (0, rows[0][1]), 2: (100_000, "other\nmore")}


def test_last_group_of_a_partition_is_balanced(monkeypatch):
    balanced, balance = [], packing.balance
    monkeypatch.setattr(packing, "balance", lambda sizes, parts: balanced.append(sum(sizes)) or balance(sizes, parts))
    for total in (0, 1, 1019, 1020, 1021, 10_500, 31_000):
        balanced.clear()
        packer = packing._Packer(0)
        ids = np.arange(total, dtype="<u4").tobytes()
        for at in range(0, total, 700):  # documents shorter than a window
            packer.add(at, ids[4 * at : 4 * (at + 700)])
        packer.finish()
        assert total - (balanced[0] if balanced else 0) < packing.CAPACITY - packing.SLACK
        got = b"".join(r[3] for r in sorted(packer.rows, key=lambda r: (r[0], r[1])))
        assert got == ids and not packer.held and not packer.group
        loads = Counter()
        for r in packer.rows:
            loads[r[5]] += r[2]
        assert max(loads.values(), default=0) <= packing.CAPACITY and sorted(loads) == list(range(packer.used))

"""Hard negatives, periodic runs and source mixing against brute force, and their edge cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import hard_negatives, mixing, periodic_runs, queries

VECTORS = "vec_id long, embedding array<float>, label int, rank string"


def plain_negatives(rows, every=100):
    use = set()
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            use.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    use = sorted(use)
    out = []
    for i, label, v in use:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in use if j != i and len(w) == len(v)]
        scored.sort()
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, n, k, -p, -s) for n, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every=100):
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(df, F.col("id") % every == 0, label=label)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_hard_negatives_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    centers = draw.normal(size=(4, 8))
    rows = []
    for i in range(600):  # clusters of very different lengths, sparse ones and copies among them
        v = centers[i % 4] * draw.choice([0.1, 1, 5]) + draw.normal(size=8) * 0.2
        if i % 9 == 0:
            v = np.where(np.arange(8) == i % 8, 3.0, 0.0)
        rows.append((i, [float(x) for x in v], int(draw.integers(0, 3))))
    rows += [(1000 + i, rows[5][1], 1) for i in range(200)]  # one vector many times: ties by id
    got = mined(spark, rows, every=20)
    assert got == plain_negatives(rows, every=20) and len(got) > 300


def test_hard_negatives_of_edge_cases(spark):
    good = [0.5, 0.25]
    rows = [
        (0, good, 1), (0, good, 1), (0, [1.0, 1.0], 2), (1, good, 1), (2, [0.25, 0.25], 2), (3, [0.3, 0.3], 3),
        (None, good, 1), (4, None, 1), (5, good, None), (6, [None, 1.0], 1), (8, [float("nan"), 1.0], 1),
        (9, [float("inf"), 1.0], 1), (10, [], 1), (100, [], 1), (11, [], 2), (12, [0.0, 0.0], 1), (200, [0.0, 0.0], 1),
        (13, [0.0, 0.0], 2), (14, [1.0], 1), (300, [-1.0, -1.0], 4), (15, [-1.0, -1.0], 4), (-100, [0.5, 0.5], 2),
    ]
    got = mined(spark, rows)
    assert got == plain_negatives(rows) and {r[0] for r in got} >= {0, 100, 200, -100}
    assert mined(spark, []) == [] and mined(spark, [(1, good, 1)]) == []
    huge = [(0, [3e38, 1.0], 1), (1, [400_000.0, 1.0], 1), (2, [390_000.0, 1.0], 2), (100, [500_000.0, 3.0], 1), (3, [450_000.0, 0.0], 2)]
    assert mined(spark, huge) == plain_negatives(huge[1:])  # exact beyond double precision, out of range left out


def test_pruning_leaves_out_no_row(monkeypatch):
    draw = np.random.default_rng(5)
    n = 3000
    vectors = np.floor(256 * draw.standard_cauchy(size=(n, 6)).clip(-30, 30)).astype(np.int64)
    ids, labels = draw.permutation(n), draw.integers(0, 4, n)
    anchors = vectors[:50]
    index = hard_negatives.Index(ids, labels, vectors)
    pruned = []
    prune = hard_negatives.Index._prune
    monkeypatch.setattr(
        hard_negatives.Index, "_prune", staticmethod(lambda *a: (r := prune(*a), pruned.extend(len(f) for _, f in r[1]))[0])
    )
    scores = anchors @ vectors.T
    top = -np.sort(-scores, axis=1)[:, 20]
    low, high = np.stack([top // 2, top], axis=1), np.stack([top, top * 9 // 10], axis=1)
    best = index.search(anchors, low, high, 7, lambda a, rows: np.ones((len(a), rows.stop - rows.start), bool))
    for a in range(50):
        for w in range(2):
            want = sorted((-s, i) for s, i in zip(scores[a].tolist(), ids.tolist()) if low[a, w] <= s <= high[a, w])[:7]
            mine = best.query == 2 * a + w
            assert list(zip((-best.score[mine]).tolist(), index.ids[best.row[mine]].tolist())) == want
    assert pruned and min(pruned) < 500  # ranges of focus coordinates did cut


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                begin, end = i, j + q
                smaller = any(all(words[x] == words[x + p] for x in range(begin, end - p)) for p in range(1, q))
                if end - begin >= max(least, times * q) and not smaller:
                    out.append((begin, end - begin, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("symbols", [1, 2, 3, 6])
def test_runs_of_random_strings(symbols):
    draw = np.random.default_rng(symbols)
    for _ in range(150):
        t = draw.integers(0, symbols, draw.integers(0, 70))
        if len(t) > 10:
            a, p = draw.integers(0, len(t)), draw.integers(1, 9)
            t[a:] = t[a + (np.arange(len(t) - a) % p)][: len(t) - a] if a + p <= len(t) else t[a:]
        for least, times in ((6, 4), (2, 2), (5, 3)):
            got = [tuple(map(int, r)) for r in periodic_runs.runs_of(t, least, times)]
            assert got == plain_runs(t.tolist(), least, times)
        words = [[b"%d" % x for x in t], [], [b"%d" % x for x in t[::-1]]]
        for (runs, text), own in zip(periodic_runs._judge(words, 6, 4), words):
            assert [tuple(map(int, r)) for r in runs] == plain_runs(own)


def test_common_extensions_of_a_suffix_tree():
    draw = np.random.default_rng(8)
    for n in (1, 2, 30, 200):
        t = draw.integers(1, 3, n).tolist()
        tree = periodic_runs.SuffixTree(t)
        suffixes = [t[i:] + [0] for i in range(n + 1)]
        assert [int(i) for i in np.argsort(tree.rank)] == sorted(range(n + 1), key=lambda i: suffixes[i])
        inverse = [[-x if x else -9 for x in s] for s in suffixes]
        assert [int(i) for i in np.argsort(tree.inverse_rank())] == sorted(range(n + 1), key=lambda i: inverse[i])
        a, b = draw.integers(0, n + 1, (2, 100))
        a, b = a[a != b], b[a != b]
        want = [next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[j])) if x != y), None) for i, j in zip(a, b)]
        assert tree.common(a, b).tolist() == want


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    draw = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in draw.integers(0, draw.choice([2, 5, 300]), draw.integers(0, 120))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    rows += [(300, None, None), (301, "", ""), (302, " \t\n", None), (None, "a\tb " * 9, None), (303, "x " * 5, None), (304, "x y " * 7, None)]
    rows += [(7, texts[7], "x"), (7, "z z\vz\fz\rz\nz", "x"), (305, "line one\n" * 900, None)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t, _ in rows:
        words = planted(i, [w.decode() for w in (t or "").encode().split()])
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        want[(i, len(runs), *head, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, runs))))] += 1
    assert got == want and sum(k[1] > 0 for k in want) > 30
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_runs_keep_other_columns(spark):
    rows = spark.createDataFrame([("k", "a b " * 6, 1, "c")], "id string, text string, n_words int, _text string")
    (found,) = periodic_runs.detect(rows).collect()
    assert found.asDict()["collapsed"] == "a b" and (found.id, found._text, found.n_words) == ("k", "c", 12)
    assert [tuple(r) for r in found.runs] == [(0, 12, 2)]


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = share * sum(sizes.values()), {}, list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check_mix(mix, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    found = mix.taken().collect()
    assert Counter((r.id, r.size, r.source) for r in found) == Counter((i, len((t or "").encode().split()), s) for i, t, s in rows)
    target, taken = plain_targets(sizes), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    return found


def test_mix_meets_targets(spark):
    draw = np.random.default_rng(4)
    names = ["b", "a", "", "Z", "\U0001f600", "￮", None]
    rows = []
    for i in range(800):
        s = names[min(int(draw.exponential(1.2)), 6)]
        rows.append((i, " ".join(f"{i}.{j}" for j in range(int(draw.lognormal(3, 1.5)))), s))
    rows += [(800, None, "a"), (801, "", "only empty"), (801, "one", None), (801, "one", None), (None, "x y", "b"), (None, "x y", "b"), (5, "p q r", "a")]
    rows += [(900, "long " * 30000, "b"), (901, "tiny source", "t")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, size string")
    mix = mixing.mix(docs.repartition(5), block=64, shard=32)
    found = check_mix(mix, rows)
    again = mixing.mix(docs.repartition(2), block=64, shard=32).taken()
    assert Counter(tuple(r) for r in again.collect()) == Counter(tuple(r) for r in found)

    slots = mix.slots.collect()
    total = len(slots)
    assert sorted((r.shard, r.slot) for r in slots) == [(i // 32, i % 32) for i in range(total)]
    rounds = Counter((r.sid, r.block) for r in slots)
    for sid in {r.sid for r in slots}:
        blocks = {b: n for (s, b), n in rounds.items() if s == sid}
        assert max(blocks.values()) - min(blocks.values()) <= 1
    # Shards are drawn, not dealt in equal parts: their counts of a source vary.
    hot = Counter(r.sid for r in slots).most_common(1)[0][0]
    assert len(set(Counter(r.shard for r in slots if r.sid == hot).values())) > 3

    texts = {(r.shard, r.slot): r.text for r in mix.texts(docs).collect()}
    assert len(texts) == total and all(len(texts[r.shard, r.slot].split()) == r.length for r in slots)
    words = Counter(w for t in texts.values() for w in t.split() if "." in w)
    assert max(words.values()) <= 2
    own = {r.id: r for r in found if r.id is not None and r.id < 800 and r.size}
    per_doc = Counter()
    for w, n in words.items():
        per_doc[int(w.split(".")[0])] += n
    assert all(per_doc[i] == r.taken for i, r in own.items())


def test_mix_of_small_tables(spark):
    kinds = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kinds)).taken().count() == 0
    for rows in ([(1, None, None)], [(1, "a b c", "s")], [(1, "a", "s"), (2, "", "t")], [(i, "w " * i, f"s{i}") for i in range(40)]):
        check_mix(mixing.mix(spark.createDataFrame(rows, kinds)), rows)


def test_permutations():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        keys, size, value = np.full(n, 77, np.uint64), np.full(n, n), np.arange(n)
        moved = mixing._feistel(keys, size, value, True)
        assert sorted(moved) == list(range(n)) and (mixing._feistel(keys, size, moved, False) == value).all()
    assert (moved != np.arange(1000)).mean() > 0.9


def test_word_counts():
    import pyarrow as pa

    texts = ["a b", None, "", "  x\t\ny ", " z", "\v\f\r\x1f", "end"]
    batch = pa.array([None if t is None else t.encode() for t in ["skip", *texts]], pa.binary()).slice(1)
    assert mixing.word_counts(batch).tolist() == [len((t or "").encode().split()) for t in texts]

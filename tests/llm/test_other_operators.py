"""Language, vectors, licenses, URLs, chat and packing: plain versions, round trips and edge cases."""

import itertools
import json
import random
import re
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wakeline.llm import chat, language, licenses, near_vectors, packing, queries, urls
from wakeline.llm.common import components

DOC = "doc_id long, text string"


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5), (7, 300)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.component_id for r in components(df).collect()}
    nodes = {x for l in links for x in l}
    assert got == plain.components(nodes, links)
    assert components(df.limit(0)).collect() == []


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    marginal, expected = language.forward_backward(scores, language.chains(np.zeros(5, int))[0], moves)
    weights = {
        p: np.exp(sum(scores[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
        for p in itertools.product(range(3), repeat=5)
    }
    total = sum(weights.values())
    for i in range(5):
        assert np.allclose(marginal[i], [sum(w for p, w in weights.items() if p[i] == y) / total for y in range(3)])
    seen = np.zeros((3, 3))
    for p, w in weights.items():
        for a, b in zip(p, p[1:]):
            seen[a, b] += w / total
    assert np.allclose(expected, seen)


def chain_by_word(scores, moves):
    """Forward-backward over one chain, a word at a time."""
    change, k = np.exp(moves), scores.shape[1]
    ahead, behind = [np.exp(scores[0])], [np.ones(k)]
    for row in scores[1:]:
        ahead.append((ahead[-1] / ahead[-1].sum()) @ change * np.exp(row))
    for row in scores[:0:-1]:
        behind.append(change @ (np.exp(row) * behind[-1] / behind[-1].sum()))
    both = np.array(ahead) * np.array(behind[::-1])
    return both / both.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("lengths", [[1], [63, 64, 65], [700, 1, 128, 129], [64] * 4, [2000]])
def test_chains_of_any_length_run_whole(lengths):
    draw = np.random.default_rng(sum(lengths))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    scores, moves = draw.normal(size=(len(owner), 3)), draw.normal(size=(3, 3)) * 2
    grid, number = language.chains(owner)
    got, _ = language.forward_backward(scores, grid, moves, number)
    want = np.concatenate([chain_by_word(scores[owner == i], moves) for i in range(len(lengths))])
    assert np.allclose(got, want)


def test_language_of_whole_texts_equals_a_plain_field(monkeypatch):
    """Features, weights, the chain over the whole text and the document's score, restated word by word."""
    rng = random.Random(4)
    vocabulary = {"de": "der hund läuft über straße wald".split(), "en": "the dog runs over street wood".split(), "fr": "le chien court forêt où été".split()}
    sample = [(lang, " ".join(rng.choices(words, k=40))) for lang, words in vocabulary.items() for _ in range(12)]
    model = language.train(sample)
    mixed = " ".join(" ".join(rng.choices(rng.choice(list(vocabulary.values())), k=9)) for _ in range(60))
    texts = [mixed, "der “hund” — läuft…½", "The DOG", mixed.replace(" ", " ½ — "), "straße"]
    plain_words = [re.findall("[a-zäöüßéèêùûôœ]+", t.lower()) for t in texts]

    def score(word):
        one = language.words_of([word])
        return model.scores(one)[0]

    want = [chain_by_word(np.array([score(w) for w in words]), model.moves) for words in plain_words]
    for size in (language.SLICE, 50):
        monkeypatch.setattr(language, "SLICE", size)
        share, count, sure = language.judge(model, texts)
        assert count.tolist() == [len(w) for w in plain_words]
        assert np.allclose(share, [w.mean(axis=0) for w in want])
        assert np.allclose(sure, [w.max(axis=1).mean() for w in want])


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = rows.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (r in held) for r in rows) and len(held) > 200
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, monkeypatch):
    sample = [("aa", "dada dado dadi dada"), ("bb", "xyxy xyzy yxyx zyzy")]
    model = language.train(sample)
    texts = [None, "", "12 -- !", "dada dado", "xyxy zyzy", "dada", "DADA", "dada " * 3000 + "xyxy"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("score", F.lit("clash")).withColumn("more", F.lit(1))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(8)] == ["und", "und", "und", "aa", "bb", "aa", "aa", "aa"]
    assert got[0].score == 0 and got[5].score == got[6].score and got[7].n_words == 3001 and got[3].more == 1
    monkeypatch.setattr(language, "SLICE", 50)  # a text read in slices
    assert np.allclose(language.judge(model, [texts[7]])[0].argmax(), 0)
    numbers = spark.createDataFrame([("\u00bd \u00b2",), ("\u2460 12",)], "text string")  # no letters
    assert {r.lang_pred for r in language.identify(numbers, model).collect()} == {"und"}
    assert language.train([]) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (None, "a", "b")], "doc_id long, text string, lang string")
    assert language.training_sample(nothing, "doc_id", "text", "lang") == []


def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [base[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.2]) for i in range(200)] + [base[0] * 3, base[0]]
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(rows)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    want = plain.components(range(len(rows)), [(a, b) for a, b in zip(*np.nonzero(close)) if a < b])
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("digest", F.lit(0))
    for block in (near_vectors.BLOCK, 3):
        monkeypatch.setattr(near_vectors, "BLOCK", block)
        got = {r.vec_id: r for r in near_vectors.near_duplicates(df).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        links = np.array([got[i].n_links for i in range(len(rows))])
        assert links.sum() >= 0.98 * (close.sum() - len(rows)) and (links <= close.sum(axis=1) - 1).all()


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0]),
        (8, [1.0, 2.0]), (8, [1.0, 2.0]), (None, [1.0, 2.0]), (9, [1.0, 2.0, 0.0]), (10, [1e30, 2e30]), (11, [-1.0, -2.0]), (12, [0.0, 1.0]), (13, [-0.0, 1.0]),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 11)]
    assert got == sorted([*alone, (0, 4, None, True), (7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (10, 4, 7, False), (12, 1, 12, True), (13, 1, 12, False)])
    assert near_vectors.near_duplicates(df.limit(0)).collect() == []


def test_license_units_and_edge_cases(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    data = [
        (0, None), (1, ""), (2, "!!"), (3, "Released under the MIT License."), (4, "text\nRELEASED under the MIT licence!\nmore"),
        (5, "Copyright (c) 2020 Somebody\n" + mit.upper()), (6, mit.replace("\n\n", "\n \n\n")), (7, "not " + mit), (None, "Licensed under CC BY-NC 4.0."),
        (8, "Licensed under CC BY-NC 4.0.\nreleased under the mit license"), (8, "Licensed under CC BY-NC 4.0.\nreleased under the mit license"),
    ]
    df = spark.createDataFrame(data, DOC).withColumn("license", F.lit("clash")).withColumn("digest", F.lit(0))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.license or "", r.n_notices, r.licenses) for r in licenses.scan(df, licenses.known_digests(spark)).collect())
    both = (8, "", 2, ["CC-BY-NC-4.0", "MIT"])
    want = [
        (-1, "CC-BY-NC-4.0", 1, ["CC-BY-NC-4.0"]), (0, "", 0, []), (1, "", 0, []), (2, "", 0, []), (3, "MIT", 1, ["MIT"]), (4, "", 1, ["MIT"]),
        (5, "MIT", 0, ["MIT"]), (6, "MIT", 0, ["MIT"]), (7, "", 0, []), both, both,
    ]
    assert got == want
    assert licenses.scan(df.limit(0), licenses.known_digests(spark)).collect() == []


URLS = [
    ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    ("https://org/fr/", "org", "/fr/", "org/fr/", "allow"),
    ("http://a.org/fr", "a.org", "/fr", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://b.net", "b.net", "", None, "allow"),
    ("http://xnet/", "xnet", "/", None, "allow"),
    ("http://h?x/y", "h", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("http://ÄB.org/fr/\nz?", "Äb.org", "/fr/\nz", "org/fr/", "allow"),
    ("nourl", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_url_rules_and_edge_cases(spark):
    df = spark.createDataFrame([(u,) for u, *_ in URLS], "url string").withColumn("host", F.lit(3)).withColumn("_host", F.lit(3))
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, None, urls.RULES).collect()]
    assert got == URLS
    assert urls.judge(df.limit(0), None, urls.RULES).collect() == []
    assert {r.rule for r in urls.judge(df, None, {}).collect()} == {None}
    assert urls.train(df.select("url", F.lit(None).cast("string").alias("label"))) is None


def test_url_classifier_learns(spark):
    data = [(f"http://spam{i}.buy-cheap.example/offer/{i}", "block") for i in range(60)] + [(f"http://s{i}.uni.example/paper/{i}", "allow") for i in range(60)]
    train = spark.createDataFrame(data[::2], "url string, label string")
    rest = spark.createDataFrame(data[1::2], "url string, label string")
    got = urls.judge(rest, urls.train(train), {}).collect()
    assert np.mean([r.verdict == r.label for r in got]) > 0.95


TEXT = st.lists(st.sampled_from([*"\\#</turn>: aé\n\r", "### ", "</turn>", "### user: "]), max_size=30).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_template_is_reversible(turns):
    def escaped(text, marks):
        for m in marks:
            text = text.replace(m, "\\" + m)
        return text

    out = "".join(f"### {escaped(r, ['\\', '### ', '</turn>', ':', chr(10)])}: {escaped(t, ['\\', '### ', '</turn>'])}</turn>\n" for r, t in turns)
    assert chat.read_turns(out) == turns


LAYOUTS = [
    ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "n", "output": None, "system": "s"}, [("system", "s"), ("user", "i"), ("user", "n"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "</turn> ### "}]}, [("user", "a"), ("assistant", "</turn> ### ")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
    ({"messages": [{"author": {"role": "user"}, "content": {"text": "x"}}]}, [("user", "x")]),
    ({"role": "user", "turn": 3, "text": None}, [("user", "")]),
    ({"unknown": 1}, [(None, None)]),
    ({"messages": []}, [(None, None)]),
]


def test_layouts_become_canonical_turns(spark):
    data = [(i, json.dumps(r)) for i, (r, _) in enumerate(LAYOUTS)] + [(90, None), (91, "no json"), (92, "[1]")]
    df = spark.createDataFrame(data, "conv_id long, record string").withColumn("turn", F.lit("clash"))
    got = {}
    for r in chat.canonical_turns(df, "conv_id", "record").collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.schema))
    for i, (_, want) in enumerate(LAYOUTS):
        assert [t[1:3] for t in sorted(got[i], key=lambda t: t[0] or 0)] == want
    assert {got[90][0][3], got[91][0][3], got[92][0][3]} == {chat.fingerprint([])}
    assert chat.canonical_turns(df.limit(0), "conv_id", "record").collect() == []


def test_formatted_turns_read_back(spark):
    data = [(1, 0, "user", "a\\### b</turn>"), (1, 1, "assistant", "é\n### x"), (1, 1, "assistant", "é\n### x"), (2, 5, None, None), (None, 0, "a:b\n", "")]
    turns = chat.formatted_turns(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    for r in turns.collect():
        assert chat.read_turns(r.formatted) == [(r.role, r.text)]
        assert (r.loss_from is not None) == (r.role == "assistant")
        if r.loss_from is not None:
            assert chat._PLAIN.sub(r"\1", r.formatted[r.loss_from : r.loss_to]) == r.text
    got = {r.conv_id: r for r in chat.conversation_digests(turns).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[None].n_turns) == (3, 14, 1, 1)
    assert chat.conversation_digests(turns.limit(0)).collect() == []


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENS = packing.Tokens(VOCABULARY)
TOKENIZER = Tokenizer.from_file(VOCABULARY)


def plain_ids(text):
    return np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab.,'s12é中 \n\t\r", "  ", "\n\n", " a", "'ll ", "<|endoftext|>", "\x1c", "\u2009"]), max_size=25).map("".join))
def test_tokens_by_rank_equal_the_tokenizer(text):
    assert TOKENS.text(text) == plain_ids(text)


def test_tokens_of_every_code_point():
    assert TOKENS._ranks is not None
    for first in range(1, 0x30000, 0x800):
        points = [chr(c) for c in range(first, first + 0x800) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b {c} {c}1{c}{c}!{c}\n" for c in points)
        assert TOKENS.text(text) == plain_ids(text)


def test_other_vocabularies_take_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, tokenizer = packing.Tokens(path), Tokenizer.from_file(path)
    assert tokens._ranks is None
    assert tokens.text("Some words, \n here") == np.array(tokenizer.encode("Some words, \n here", add_special_tokens=False).ids, "<u4").tobytes()


def test_differencing_balances():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 129, 400).tolist()
    parts = packing.balance(sizes, 32)
    assert sorted(i for p in parts for i in p) == list(range(400))
    loads = [sum(sizes[i] for i in p) for p in parts]
    assert max(loads) - min(loads) <= 8
    assert packing.balance([], 3) == []


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_round_trip(spark, parts):
    texts = [None, "", "a", "a b\nc", "word " * 5000, "  odd \t text \n\n"] + [f"text number {i} " * (i % 90) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("ids", F.lit(1)).repartition(parts)
    rows = packing.pack(df, VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.doc_tokens == len(ids) // 4 and len(r["ids"]) == 4 * r.length for r in own)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        size = sum(n for _, n in pieces)
        assert size <= packing.CAPACITY
        padding += packing.CAPACITY - size if size & (size - 1) else 0
    assert padding < 0.02 * sum(r.length for r in rows)


def test_packing_raises_the_window_count():
    packer = packing._Packer(0)
    packer.group = [(1, 0, bytes(4 * 700), 700) for _ in range(3)]  # two windows' worth that only three can hold
    packer.close()
    assert sorted(r[2] for r in packer.rows) == [700] * 3 and packer.used == 3


def test_packing_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y"), (1, "y")], DOC)
    assert sorted((r.doc_id or 0, r.length) for r in packing.pack(df.coalesce(1), VOCABULARY).groupBy("doc_id").agg(F.sum("length").alias("length")).collect()) == [(0, 2), (1, 4)]
    assert packing.pack(df.limit(0), VOCABULARY).collect() == []


def test_other_fields_do_not_hide_a_layout(spark):
    more = {"id": 7, "source": {"name": "x", "tags": ["a", "b"]}, "score": None}
    layouts = [
        {"turn": 3, "role": "user", "text": "q"},
        {"prompt": "q", "response": "a"},
        {"system": "s", "instruction": "q", "output": "a"},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"messages": [{"author": {"role": "user"}, "content": {"text": "q"}}]},
    ]
    wider = [{**r, **more} for r in layouts]
    wider[3]["messages"] = [{**m, "weight": 1} for m in layouts[3]["messages"]]
    unknown = [
        {"messages": [{"role": "user", "content": "q"}, "a"]},  # an element that is no message
        {"messages": [{"role": "user", "content": {"parts": ["q"]}}], **more},
        {"prompt": "q", **more},
        {"messages": [], **more},
    ]
    rows = list(enumerate(json.dumps(r) for r in [*layouts, *wider, *unknown]))
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string"), "conv_id", "record")
    got = {}
    for r in turns.collect():
        got.setdefault(r.conv_id, []).append((r.schema, r.turn, r.role, r.text))
    n = len(layouts)
    for i in range(n):
        assert got[i] == got[n + i] and all(t[3] for t in got[i])
    for i, record in enumerate(unknown):
        assert got[2 * n + i] == [(chat.fingerprint(chat.field_paths(record)), None, None, None)]
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.formatted_turns(turns)).collect()}
    assert [digests[i].n_turns for i in range(2 * n)] == [1, 2, 3, 2, 2, 1] * 2
    for i in range(len(unknown)):
        assert (digests[2 * n + i].n_turns, digests[2 * n + i].formatted_chars) == (0, 0)


def test_the_mapping_with_most_fields_is_taken():
    known = chat.table_of()
    schema, mapping = chat.mapping_of({"prompt", "response", "instruction", "input", "output", "id"}, known, chat.MAPPINGS)
    assert mapping.name == "instruction" and schema == chat.fingerprint(["instruction", "input", "output"])
    assert chat.mapping_of({"prompt", "response", "completion"}, known, chat.MAPPINGS)[1].name == "prompt_response"
    assert chat.mapping_of(set(), known, chat.MAPPINGS) == (chat.fingerprint([]), None)

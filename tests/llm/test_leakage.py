import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import leakage as L


def brute(docs, items, least):
    out = {}
    for i, t in items:
        if t is None or i is None:
            continue
        w = L.words(t)
        for k in range(len(w) - least + 1):
            out.setdefault(tuple(w[k : k + least]), set()).add(i)
    found = set()
    for d, t in docs:
        w = L.words(t or "")
        for k in range(len(w) - least + 1):
            found |= {(d, i) for i in out.get(tuple(w[k : k + least]), ())}
    return found


def test_words():
    assert L.words("It's 3,5 A_B—ÉtÉ x²") == ["it", "s", "3", "5", "a", "b", "été", "x²"]
    assert L.words("İX") == ["i̇x"] and L.words("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=40), max_size=5), st.text(alphabet="abcd .\n", max_size=80), st.integers(2, 4))
def test_automaton_finds_what_brute_force_finds(texts, doc, least):
    items = list(enumerate(texts))
    a = L.Automaton(items, least)
    gate = L.Gate(22).add(L.Gate.pairs(texts))
    points, _ = L.code_points([doc])
    got = {(0, i) for x, y in gate.stretches(points, least) for _, _, found in a.matches(doc[x:y]) for i in found}
    assert got == brute([(0, doc)], items, least) == {(0, i) for _, _, found in a.matches(doc) for i in found}


def corpus(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))) for k in range(20)]
    docs = []
    for k in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(20))]
        if k % 3 == 0:
            w = rng.choice(items)[1].upper().split()
            a = rng.randint(0, len(w) - 1)
            parts.append(", ".join(w[a : a + rng.randint(8, 30)]))
        docs.append((k, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (102, "ΟΔΟΣ " * 30)], items + [(50, None), (None, "x " * 30), (51, "οδος " * 14), (52, "a")]


@pytest.mark.parametrize("block", [L.BLOCK_WORDS, 100])
def test_find(table, block):
    docs, items = corpus()
    df = table([(d, t, 1, "z") for d, t in docs + docs[:5]], "id long, body string, item int, doc string", files=3)
    it = table(items + items[:3], "item long, text string")
    got = {(r["doc"], r["item"]) for r in L.find_leaks(df, "id", "body", it, "item", "text", block_words=block).collect()}
    assert got == brute(docs, items, 12) and len(got) > 8


def test_matches_do_not_cross_texts(table):
    words = [f"x{k}" for k in range(12)]
    it = table([(1, " ".join(words))], "item long, text string")
    df = table([(1, " ".join(words[:6])), (2, " ".join(words[6:])), (3, " ".join(words))], "doc long, text string")
    assert [(r["doc"], r["n_words"]) for r in L.find_leaks(df, "doc", "text", it, "item", "text").collect()] == [(3, 12)]


def test_very_long_text(table):
    words = [f"y{k}" for k in range(15)]
    it = table([(1, " ".join(words))], "item long, text string")
    df = table([(1, "filler text " * 300_000 + "; ".join(words) + " end" * 10)], "doc long, text string")
    assert [(r["item"], r["n_words"]) for r in L.find_leaks(df, "doc", "text", it, "item", "text").collect()] == [(1, 15)]


@pytest.mark.parametrize("block", [L.BLOCK_WORDS, 20])
def test_removal(table, block):
    words = [f"y{k}" for k in range(30)]
    it = table([(1, " ".join(words)), (2, " ".join(words[:14])), (3, " ".join(words[10:25]))], "item long, text string")
    df = table([("a", "Start. " + " ".join(words) + " End."), ("b", "x " * 100 + "-".join(words[3:18]) + " y " * 50), ("c", "clean")], "doc string, text string")
    got = {r["doc"]: r for r in L.remove_leaks(df, "doc", "text", it, "item", "text", block_words=block).collect()}
    assert got["a"]["text"] == "Start.  End." and got["a"]["dropped"] and got["a"]["longest"] == 30
    assert got["b"]["text"] == "x " * 100 + " y " * 50 and not got["b"]["dropped"] and set(got) == {"a", "b"}


def test_many_blocks_are_built_once_each(table, monkeypatch):
    docs, items = corpus(3)
    it = table([(f"item-{i}", t) for i, t in items if i is not None], "item string, text string", files=2)
    wanted = L.TestItems(it, "item", "text", 12, 100)
    assert wanted.n_blocks >= 6 and wanted.built.count() == len(wanted.automata) >= 6
    n = wanted.built.selectExpr("sum(n_items)").first()[0]
    assert n == len({i for i, t in items if i is not None and t is not None})
    df = table(docs, "id long, body string", files=2)
    got = {(r["doc"], r["item"]) for r in L.find_leaks(df, "id", "body", it, "item", "text", block_words=100).collect()}
    assert got == {(d, f"item-{i}") for d, i in brute(docs, items, 12)}
    whole = {r["doc"]: r["text"] for r in L.remove_leaks(df, "id", "body", it, "item", "text").collect()}
    assert whole == {r["doc"]: r["text"] for r in L.remove_leaks(df, "id", "body", it, "item", "text", block_words=100).collect()} and len(whole) > 5


def test_large_gate(monkeypatch):
    monkeypatch.setattr(L, "PART_BITS", 4)
    some = ["a b c d e f", "f e d c b a x"]
    parts = list(L._slots(24)(iter([L.pa.RecordBatch.from_arrays([L.pa.array(some)], names=["text"])])))
    at = {(p << 4) + int(o) for b in parts for p, d in zip(b.column("part").to_pylist(), b.column("data").to_pylist()) for o in L.np.frombuffer(d, "<u4")}
    table = L.Gate(24).add(L.Gate.pairs(some)).table
    assert at == set(L.np.flatnonzero(L.np.unpackbits(table, bitorder="little")).tolist()) and len(at) == 11


def test_empty(table):
    none, items = table([], "doc long, text string"), table([], "item long, text string")
    some = table([(1, "a b c")], "doc long, text string")
    assert L.find_leaks(none, "doc", "text", items, "item", "text").count() == 0 == L.find_leaks(some, "doc", "text", items, "item", "text").count()

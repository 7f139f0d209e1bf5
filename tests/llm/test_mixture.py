import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.llm import mixture as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no tokenizer files here")


@pytest.fixture(scope="module")
def counter():
    return M.counter(M.VOCABULARY)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="ab's tmdrevl'  \n\t1.é　²€\u0301字", max_size=25), max_size=6))
def test_counts_are_the_tokenizers(texts):
    c = M.counter(M.VOCABULARY)
    assert c(texts).tolist() == [len(c.encode(t)) for t in texts]


def test_counts_of_odd_texts(counter):
    texts = [None, "", " ", "'s", " 's", "\n's", "it''s", "a" * 100_000, "x  y\r\n\r\n  z", "\U0001f600 emoji", "<|endoftext|>"]
    assert counter(texts).tolist() == [len(counter.encode(t or "")) for t in texts]


def test_rates():
    for cap in (1, 2, 4):
        for mean in (0.1, 0.5, 0.9, cap * 0.8):
            assert M.truncated_mean(M.rate_for(mean, cap), cap) == pytest.approx(mean, abs=1e-6)
    assert M.rate_for(0, 3) == 0 and math.isinf(M.rate_for(3, 3)) and M.thresholds(3, 3) == (3, [])
    always, above = M.thresholds(0.5, 10**9)
    assert always == 0 and len(above) < 40 and above == sorted(above) and sum(1 - t for t in above) == pytest.approx(0.5)
    assert M.thresholds(2.5, 10**6)[1] and M.thresholds(0, 3) == (0, [])


def test_plan():
    size, rates = M.plan_rates([("a", 100), ("b", 1000), ("c", 5)], [("a", 0.5, 2), ("b", 0.5, 1), ("gone", 0.1, 1), ("c", 0.0, 1), (None, 0.2, 1)])
    assert size == 400 and rates["a"][2] == 2 and rates["b"][2] == pytest.approx(0.2) and set(rates) == {"a", "b"}
    assert M.plan_rates([], [("a", 1, 1)]) == (0.0, {})


def docs(n):
    return [(k, "abc"[k % 3], "some words of text " * (1 + k % 5), "s") for k in range(n)] + [(n, None, "text", "s"), (n + 1, "a", None, "s"), (n + 2, "z", "text", "s")]


def test_shares(table):
    df = table(docs(6000), "id long, src string, body string, source string", files=3)
    goal = table([("a", 0.6, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("a", 0.9, 9), ("none", 0.2, 2)], "s string, share double, cap int")
    m = M.mix(df, "id", "src", "body", goal, "s", "share", "cap")
    report = {r["source"]: r for r in m.report.collect()}
    assert sum(r["reached_share"] for r in report.values()) == pytest.approx(1) and report["none"]["tokens"] == 0
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert report[s]["reached_share"] == pytest.approx(share, abs=0.02) and report[s]["most_repeats"] <= report[s]["max_repeats"]
    draws = m.draws().collect()
    assert len(draws) == sum(r["n_draws"] for r in report.values()) and len({(r["key"], r["copy"]) for r in draws}) == len(draws)
    again = M.mix(df.repartition(7), "id", "src", "body", goal, "s", "share", "cap")
    key = lambda rows: sorted((r["key"], r["copy"], r["position"]) for r in rows)
    assert key(again.draws().collect()) == key(draws)
    assert key(M.mix(df, "id", "src", "body", goal, "s", "share", "cap", seed=3).draws().collect()) != key(draws)
    order = [r["position"] for r in m.draws().collect()]
    assert order == sorted(order)


def test_thousands_of_sources(table):
    names = [f"s{k}" for k in range(3000)]
    df = table([(k, names[k % 3000], "some words of text") for k in range(9000)], "id long, src string, body string")
    goal = table([(s, 1 / 3000, 2) for s in names], "s string, share double, cap int")
    m = M.mix(df, "id", "src", "body", goal, "s", "share", "cap")
    assert m.report.count() == 3000 and m.draws().where("copy > 2").count() == 0 and m.draws().count() == 18_000


def test_wanted_size(table):
    df = table(docs(3000), "id long, src string, body string, source string")
    goal = table([("a", 0.5, 2), ("b", 0.5, 3)], "s string, share double, cap int")
    m = M.mix(df, "id", "src", "body", goal, "s", "share", "cap", total=2000)
    assert m.size == 2000 and m.documents.selectExpr("sum(copies * n_tokens)").first()[0] == pytest.approx(2000, rel=0.25)


def test_empty(table):
    goal = table([("a", 1.0, 2)], "s string, share double, cap int")
    none = table([], "id long, src string, body string")
    m = M.mix(none, "id", "src", "body", goal, "s", "share", "cap")
    assert m.draws().count() == 0 and m.report.first()["reached_share"] == 0
    some = table([(1, "a", "x")], "id long, src string, body string")
    assert M.mix(some, "id", "src", "body", goal.where("false"), "s", "share", "cap").draws().count() == 0

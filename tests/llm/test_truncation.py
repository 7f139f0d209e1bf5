import random

import numpy as np
import pytest

from quernel.llm import truncation as T


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A whole sentence.", "stop"), ("He said “so.”", "stop"), ("What?", "stop"), ("It ends in the midd", "open"), ("The list has: one, two,", "open"), ("A cut sentence of th...", "marked"), ("A cut sentence […]", "marked"),
        ("A cut. […]", "stop"), ("Text [truncated]", "marked"), ("First claim.\n2.", "enumerator"), ("First claim.\n\n[Claim 2]", "enumerator"), ("as shown in FIG.", "enumerator"), ("on step 12.", "stop"), ("A sentence.\n\nPage 3 of 9", "structure"),
        ("A sentence.\n\n(Drawings: 3 sheets)", "structure"), ("A sentence.\n\n-- end of specification --", "structure"), ("A sentence.\n\nTABLE 2\nred pump | 31\nblue valve | 57", "structure"), ("Done.\n\n12 hollow shaft\n31 thin plate", "structure"),
        ("Done.\n\nReference signs: 12 hollow shaft, 31 thin plate", "structure"), ("Done.\n\nFIG. 4 shows the pump in section", "structure"), ("Done.\n\nCONCLUSION", "structure"), ("Done. [formula image 0003 missing]", "structure"),
        ("Done.\nx = k3 / ( 1 + k", "formula"), ("Done. z 2 = ∑ i = 1 n a i · 24", "formula"), ("Done.\n( Math. 66 ) p ? a ? 27", "formula"), ("Done.\nC14H28O<sub>5</sub -b", "formula"), ("Done. $\\frac{z}{a_23$", "formula"), ("Done. y  =  n □ 36  (equation 96)", "formula"),
        (None, "empty"), ("  \n", "empty"), ("x" * 100_000, "open"),
    ],
)
def test_endings(text, want):
    assert T.ending(text) == want


def test_censored_fit():
    rng = np.random.default_rng(1)
    true = np.exp(rng.normal(6.0, 0.5, 20_000)).astype(int)
    seen = np.minimum(true, 500)
    x, n = np.unique(seen, return_counts=True)
    mu, sigma = T.fit_censored(x, n, np.where(x == 500, n, 0))
    assert abs(mu - 6.0) < 0.03 and abs(sigma - 0.5) < 0.03
    naive, _ = T.fit_censored(x, n, np.zeros(len(x)))
    assert naive < mu - 0.05


def limits(table, lengths):
    from collections import Counter

    exact = table([("s", "chars", x, n) for x, n in Counter(lengths).items()], "source string, unit string, length long, n long", files=2)
    return sorted(r["length"] for r in T.candidate_limits(exact, T.length_classes(exact)).collect())


def test_candidate_limits(table):
    rng = np.random.default_rng(2)
    natural = np.exp(rng.normal(6.0, 0.5, 20_000)).astype(int)
    assert limits(table, np.minimum(natural, 500).tolist()) == [500]
    assert limits(table, natural.tolist()) == []
    # limits far above a million are told from their neighbours, too
    long = np.exp(rng.normal(15.0, 0.5, 5_000)).astype(int)
    assert limits(table, np.minimum(long, 4_000_001).tolist() + [4_000_000, 4_000_003]) == [4_000_001]
    assert limits(table, [20] * 3 + [7] * 90) == []


def test_what_a_mark_means_is_learned_at_limits(table):
    rng = random.Random(5)
    rows = []
    for k in range(1200):
        text = " ".join(sentence(rng) for _ in range(rng.randint(3, 16)))
        source = "marking" if k % 2 else "dotted"  # the second ends whole texts with dots now and then
        if source == "marking" and len(text) > 450:
            text = text[:447].rstrip(". ") .ljust(447, "x") + "..."
        elif source == "marking" and k % 25 == 1:
            text = text[: len(text) // 2].rstrip(". ") + "..."
        rows.append((k, source, text))
    df = table(rows, "id long, src string, body string", files=2)
    marked = {k for k, _, t in rows if t.endswith("...")}
    got = {r["key"] for r in T.detect_truncation(df, "id", "src", "body").where("is_truncated").collect()}
    blind = {r["key"] for r in T.detect_truncation(df, "id", "src", "body", use_lengths=False).where("is_truncated").collect()}
    assert len(marked) > 200 and len(marked - got) < 5 and len(got - marked) < 5 and not blind & marked


def test_a_stop_at_a_limit_is_no_cut_inside_a_sentence(table):
    rng = random.Random(6)
    rows = []
    for k in range(900):
        text = " ".join(sentence(rng) for _ in range(rng.randint(3, 16)))[:400]
        rows.append((k, "s", text))
    got = {r["key"]: r["ending"] for r in T.detect_truncation(table(rows, "id long, src string, body string"), "id", "src", "body").where("is_truncated").collect()}
    assert len(got) > 200 and "stop" not in got.values()


def sentence(rng):
    return " ".join(rng.choice("the pump moves a red valve under low pressure while water flows".split()) for _ in range(rng.randint(5, 14))).capitalize() + "."


def corpus(n=1500, seed=0):
    rng = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randint(3, 16)))
        source = ["fixed", "free", "bytes"][k % 3]
        if source == "free":
            if k % 30 == 1:
                text = text[: len(text) // 2].rstrip(". ") + " pu"
                cut.add(k)
            elif k % 10 == 1:
                text += "\n\nPage 3 of 9"
        elif source == "fixed" and len(text) > 400:
            text = text[:400]
        elif source == "bytes" and len(text.replace("red", "rёd").encode()) > 500:
            text = text.replace("red", "rёd").encode()[:500].decode("utf-8", "ignore")
        if source != "free" and not text.rstrip().endswith("."):
            cut.add(k)
        rows.append((k, source, text, 1))
    return rows, cut


def test_detection(table):
    rows, cut = corpus()
    extra = [(9001, None, None, 1), (9002, None, "", 1), (9003, None, "Fine.", 1), (9004, "one", "Cut in the mid", 1)]
    df = table(rows + extra + rows[:20], "id long, src string, body string, ending int", files=3)
    found = T.detect_truncation(df, "id", "src", "body").cache()
    got = {r["key"] for r in found.where("is_truncated").collect()}
    assert len(cut) > 200 and len(got - cut - {9004}) <= 3 and len(cut - got) <= 3
    assert found.where("key in (9001)").count() == 0 and found.where("key in (9002, 9003) and is_truncated").count() == 0
    report = {r["source"]: r for r in T.truncation_report(found).collect()}
    assert report["free"]["share"] < 0.15 < report["fixed"]["share"] and report[None]["n_docs"] == 2


def test_structured_end_at_a_limit_by_chance(table):
    rows = [(k, "s", "Text. " * (10 + k % 60) + "\n\nPage 1 of 2", 1) for k in range(300)]
    found = T.detect_truncation(table(rows, "id long, src string, body string, x int"), "id", "src", "body")
    assert found.where("is_truncated").count() == 0


def test_empty(table):
    assert T.detect_truncation(table([], "id long, src string, body string"), "id", "src", "body").count() == 0
    assert T.detect_truncation(table([(1, "a", None)], "id long, src string, body string"), "id", "src", "body").count() == 0

import random
from itertools import combinations

import numpy as np
import pytest

from quernel.llm import neardup as N


def sets_like(rng, base, edits):
    out = set(base)
    for x in rng.sample(sorted(base), edits):
        out.remove(x)
        out.add(rng.getrandbits(32))
    return out


def corpus(seed=0):
    rng = random.Random(seed)
    docs, k = {}, 0
    for _ in range(25):
        base = {rng.getrandbits(32) for _ in range(rng.randint(35, 120))}
        for edits in (0, 0, *(rng.randint(1, len(base) // 2) for _ in range(3))):
            docs[k] = sets_like(rng, base, edits) if edits else set(base)
            k += 1
    docs[k] = {1, 2, 3}
    docs[k + 1] = {1, 2, 3}
    return docs


def brute(docs, threshold, least):
    big = {k: v for k, v in docs.items() if len(v) >= least}
    return {(a, b) for a, b in combinations(sorted(big), 2) if len(big[a] & big[b]) >= threshold * len(big[a] | big[b])}


def rows(docs, seed=0):
    out = [(d, h) for d, s in docs.items() for h in s] + [(None, 5), (3, None)]
    out += out[:200]
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize("giant", [False, True])
def test_pairs_against_brute_force(table, monkeypatch, giant):
    if giant:
        monkeypatch.setattr(N, "GIANT_ROWS", 50)
    docs = corpus()
    found = N.near_duplicates(table(rows(docs), "d long, h long", files=4), "d", "h", 0.7, 30)
    want = brute(docs, 0.7, 30)
    assert {tuple(r) for r in found.pairs().collect()} == want and len(want) > 40
    members = {r["record"]: r for r in found.groups().collect()}
    assert set(members) == {k for k, v in docs.items() if len(v) >= 30}
    for k, r in members.items():
        same = [j for j in members if docs[j] == docs[k]]
        assert (r["class_id"], r["n_copies"]) == (min(same), len(same))
        assert r["group_id"] == min(members[j]["class_id"] for j in members if members[j]["group_id"] == r["group_id"])
    assert all(members[a]["group_id"] == members[b]["group_id"] for a, b in want)
    links = {tuple(r)[:2] for r in found.links.collect()}
    assert links == {p for p in want if docs[p[0]] != docs[p[1]] and p[0] == members[p[0]]["class_id"] and p[1] == members[p[1]]["class_id"]}


def test_blocks_of_rows(table, monkeypatch):
    monkeypatch.setattr(N, "BUFFER_ROWS", 300)
    monkeypatch.setattr(N, "STEP", 64)
    docs = corpus(3)
    found = N.near_duplicates(table(rows(docs, 3), "d long, h long", files=3), "d", "h", 0.8, 1)
    assert {tuple(r) for r in found.pairs().collect()} == brute(docs, 0.8, 1)


@pytest.mark.parametrize(("bucket", "heavy"), [(4, 1.0), (4, 1e-9), (0, 1e-9)])
def test_large_buckets(table, monkeypatch, bucket, heavy):
    """One cluster of near-equal records among others; buckets are cut into chunks, wherever they are noticed."""
    monkeypatch.setattr(N, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(N, "CHUNK_ROWS", 7)
    monkeypatch.setattr(N, "HEAVY_SHARE", heavy)
    rng = random.Random(7)
    base = {rng.getrandbits(32) for _ in range(100)}
    docs = {k: sets_like(rng, base, 1 + k % 12) for k in range(90)}
    docs |= {100 + k: v for k, v in corpus(8).items() if len(v) >= 30}
    found = N.near_duplicates(table(rows(docs, 8), "d long, h long", files=3), "d", "h", 0.7, 30)
    assert {tuple(r) for r in found.pairs().collect()} == brute(docs, 0.7, 30)


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_buckets_that_cross_batches(monkeypatch, step):
    monkeypatch.setattr(N, "BUCKET_ROWS", 5)
    monkeypatch.setattr(N, "CHUNK_ROWS", 4)
    rng = random.Random(step)
    size = [rng.choice([1, 1, 2, 3, 5, 6, 17]) for _ in range(40)]
    key = np.repeat(np.arange(40), size)
    record = np.arange(len(key)) * 3 + 1
    t = N.pa.table({"key": key, "record": record})
    out = N.pa.Table.from_batches(list(N._meet(iter(t.to_batches(max_chunksize=step)))))
    pairs = [(r["a"], r["b"]) for r in out.to_pylist() if r["b"] is not None]
    assert sorted(pairs) == sorted((int(a), int(b)) for k in range(40) if size[k] <= 5 for a, b in combinations(record[key == k], 2))
    large = [(r["key"], r["a"], r["chunk"]) for r in out.to_pylist() if r["b"] is None]
    assert sorted(large) == sorted((k, int(r), i // 4) for k in range(40) if size[k] > 5 for i, r in enumerate(record[key == k]))


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(200)] + [(1000, 1000 + rng.randint(1, 300)) for _ in range(200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(150)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = {r["node"]: r["group"] for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: find(k) for a, b in links if a != b for k in (a, b)}
    assert N.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_copies_of_one_set(table):
    docs = {k: set(range(40)) for k in range(300)}
    found = N.near_duplicates(table(rows(docs), "d long, h long", files=2), "d", "h", 0.7, 30)
    assert found.links.count() == 0 and found.pairs().count() == 300 * 299 // 2
    assert {r["n_copies"] for r in found.groups().collect()} == {300}


def test_empty_and_extra_columns(table):
    assert N.near_duplicates(table([], "d long, h long"), "d", "h").pairs().count() == 0
    df = table([(1, 2, 3, 4), (2, 2, 3, 4)], "record long, element long, data int, size int")
    assert [tuple(r) for r in N.near_duplicates(df, "record", "element").pairs().collect()] == [(1, 2)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**32, 700), rng.integers(0, 2**32, 400)
    one = lambda x: N.registers(N.register_minima(x, np.array([0])))[0]
    both = np.unique(np.r_[a, b])
    assert (np.maximum(one(a), one(b)) == one(both)).all()
    errors = []
    for shared in (0, 100, 300, 390):
        x, y = np.r_[b[:shared], a[:300]], b
        u, v = one(x), one(y)
        j = N.likelihood_jaccard(np.array([len(x) * 1.0]), np.array([len(y) * 1.0]), np.array([(u > v).sum()]), np.array([(u < v).sum()]))[0]
        errors.append(abs(j - len(np.intersect1d(x, y)) / len(np.union1d(x, y))))
    assert max(errors) < 0.08
    assert one(np.arange(2_000_000)).max() < N.Q

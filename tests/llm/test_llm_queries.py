import os
import re
import subprocess
import sys

import pytest

from quernel.llm import queries as Q
from tests.test_queries import duck, plain  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = {"p1_found": ["ngram_hash", "mark"], "p2_found": ["hit_id"], "p5_found": ["doc_id"], "p6_found": ["doc_id_a", "doc_id_b"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, duck, name):  # noqa: F811
    df = Q.QUERIES[name](spark, data)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(rows) == len(set(rows)) > 0
    if name in Q.SQL:
        cols = sorted(df.columns)
        cur = duck.execute(Q.SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert sorted(tuple(plain(r[c]) for c in cols) for r in rows) == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())


def test_near_duplicates_against_brute_force(spark, data):
    sets = {}
    for r in spark.read.parquet(f"{data}/ngram_entry.parquet").where("doc_id is not null").select("doc_id", "ngram_hash").distinct().collect():
        sets.setdefault(r[0], set()).add(r[1])
    big = sorted(k for k, v in sets.items() if len(v) >= 30)
    want = {(a, b) for i, a in enumerate(big) for b in big[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in Q.p6_found(spark, data).collect()} == want


def test_the_rest_does_not_need_this_package():
    code = "import sys; sys.modules['quernel.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1_') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for folder, _, files in os.walk(os.path.join(ROOT, "quernel")):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                text = open(os.path.join(folder, f)).read()
                assert not re.search(r"(from|import) quernel\.llm", text), f

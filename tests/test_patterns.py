import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernel.functions.ngrams import fold, sparse_ngrams
from quernel.plans.java import to_java
from quernel.plans.query import ALL, NONE, Op, Query, bound, conjunction, disjunction, literal_query, plan, prune
from quernel.plans.syntax import PatternError, parse, variants


@pytest.mark.parametrize(
    ("pattern", "op", "children"),
    [("foo", Op.AND, 0), ("foo|bar", Op.OR, 2), ("foo.*bar", Op.AND, 0), (".*", Op.ALL, 0), ("", Op.ALL, 0), ("[a-zA-Z0-9_]", Op.ALL, 0), ("of", Op.ALL, 0), ("(?i)a", Op.ALL, 0), ("x{0}", Op.ALL, 0), ("(abc)?", Op.ALL, 0), ("(abc)+", Op.AND, 0), ("[[a]&&[b]]xyz", Op.NONE, 0)],
)
def test_shape(pattern, op, children):
    q = plan(pattern)
    assert (q.op, len(q.children)) == (op, children)


def test_both_literals_of_a_wildcard():
    assert plan("foo.*bar").hashes == plan("foo").hashes | plan("bar").hashes
    assert len(plan("MAX_FILE_SIZE").hashes) >= 2
    assert plan("[abc]def").op is not Op.NONE


def test_joined_literals():
    assert plan("f[o]o(ba)r") == plan("foobar")
    assert plan("(?i)FooBar") == plan("foobar") == plan("FOOBAR", ignore_case=True)
    assert plan("foo$bar").hashes  # an edge of the line joins nothing that could match


def test_algebra():
    a, b = literal_query("abc"), literal_query("xyz")
    assert conjunction([a, ALL]) == a and conjunction([]) == ALL and conjunction([a, NONE]) == NONE
    assert disjunction([a, NONE]) == a and disjunction([]) == NONE and disjunction([a, ALL]) == ALL
    assert conjunction([a, b]).hashes == a.hashes | b.hashes
    assert disjunction([a, disjunction([b, a])]).children == (a, b)
    df = {h: n for n, h in enumerate(sorted(conjunction([a, b]).hashes))}
    assert len(prune(conjunction([a, b]), df, 1).hashes) == 1
    assert bound(Query(Op.OR, frozenset(df)), df, 100) == sum(df.values())


@pytest.mark.parametrize("bad", ["(?=a)", "(?<!a)", r"\1", "(a", "a)", "[z-a]", "*a", "a{3,1}", "a{200000}", "[a", "(?q)a", r"\q", r"\x{110000}", "(?P<a>x)(?P<a>y)", "{2}"])
def test_rejected(bad):
    with pytest.raises(PatternError):
        parse(bad)


JAVA = [
    (r"\w+", "é", True), (r"^\d$", "٣", True), ("^a$", "a\r", False), ("^a.b$", "a\u2028b", True), ("a++", "aa", True), ("(?P<n>b)c", "abc", True),
    ("(?U)a*", "", True), ("[[:alpha:]]", "x", True), ("[a-z--[aeiou]]", "e", False), ("[a-z--[aeiou]]", "x", True), ("[a-c~~b-d]", "b", False), ("[a-c~~b-d]", "d", True),
    (r"\p{Greek}", "λ", True), (r"\P{L}", "λ", False), (r"\p{Lowercase_Letter}", "a", True), ("(?-u:\\w)", "é", False), ("(?x) a b # c", "ab", True), ("(?s).", "\u2028", True), (r"\bfoo\b", "a foo b", True), (r"\b{start}foo", "foo", True),
    ("[^x]", "x", False), (r"[\w&&[^a]]", "a", False), ("a{2}", "aa", True), ("a|b", "b", True), (r"\x41\u{42}", "AB", True), ("#/-~", "#/-~", True), ("a]", "a]", True), ("[]a]", "]", True),
]
FOLDED = [("k", "\u212a", True), ("S", "ſ", True), ("σ", "ς", True), ("µ", "μ", True), ("i", "İ", False), ("i", "ı", False), ("ß", "ẞ", True), ("É", "é", True), ("[a-k]", "\u212a", True), ("[^k]", "K", False)]


def test_java_patterns(spark):
    from pyspark.sql import functions as F

    cases = [(to_java(p), t, w) for p, t, w in JAVA] + [(to_java(p, True), t, w) for p, t, w in FOLDED]
    for java, text, want in cases:
        got = spark.range(1).select(F.lit(text).rlike(java)).first()[0]
        assert got == want, (java, text)


def test_variants():
    assert variants("k") == {"k", "K", "\u212a"} and variants("1") == {"1"} and "İ" not in variants("i")


def holds(q, grams):
    if q.op in (Op.ALL, Op.NONE):
        return q.op is Op.ALL
    parts = [h in grams for h in q.hashes] + [holds(c, grams) for c in q.children]
    return all(parts) if q.op is Op.AND else any(parts)


PIECES = st.sampled_from(["abc", "foo", "Kel", "é", "x", "[ab]", "[^a]", ".", "(foo|bar)", "(?:abc)?", "(abd)+", "z{2}", "s", "ſ", "of"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=5).map("".join), st.text(alphabet="abcdfokelxzsKé \nſ\u212a", max_size=40), st.booleans())
def test_every_match_is_a_candidate(pattern, text, ignore_case):
    import zlib

    compiled = re.compile(pattern, re.I if ignore_case else 0)
    grams = {zlib.crc32(g) for _, g in sparse_ngrams(fold(text.encode()))}
    if any(compiled.search(line) for line in text.split("\n")):
        assert holds(plan(pattern, ignore_case), grams)


def test_limits_of_counts_and_nesting(spark):
    java = spark._jvm.java.util.regex.Pattern
    assert java.compile(to_java("a{2000}")).matcher("a" * 2000).find() and not java.compile(to_java("a{2000}")).matcher("a" * 1999).find()
    assert java.compile(to_java("(" * 190 + "a" + ")" * 190)).matcher("a").find()
    for pattern in ("a{100001}", "(" * 300 + "a" + ")" * 300):
        with pytest.raises(PatternError):
            to_java(pattern)

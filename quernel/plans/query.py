"""From a pattern to a boolean query over n-gram hashes, and from that to a column expression."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from enum import Enum
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.ngrams import MAX_LENGTH, covering_ngrams, fold
from quernel.plans.syntax import Alternation, Char, Concat, Dot, Empty, Group, Look, Repeat, Set, parse, ranges_of, variants

#: A class with at most so many members is a choice between them; a larger one says nothing.
MAX_MEMBERS = 10
#: So many ids of a list are read as fast as one document is verified.
WORTH = 64


class Op(Enum):
    ALL = "all"
    NONE = "none"
    AND = "and"
    OR = "or"


@dataclass(frozen=True)
class Query:
    """All or no documents, or those that hold all (any) of the hashes and satisfy all (any) of the children."""

    op: Op
    hashes: frozenset[int] = frozenset()
    children: tuple[Query, ...] = ()

    def leaves(self) -> frozenset[int]:
        return self.hashes.union(*(c.leaves() for c in self.children))


ALL, NONE = Query(Op.ALL), Query(Op.NONE)


def conjunction(parts: list[Query]) -> Query:
    """All of the parts. One that is none makes none, those that are all say nothing."""
    hashes: set[int] = set()
    rest: list[Query] = []
    for p in parts:
        if p.op is Op.NONE:
            return NONE
        if p.op is Op.AND:
            hashes |= p.hashes
            rest += [c for c in p.children if c not in rest]
        elif p.op is Op.OR and p not in rest:
            rest.append(p)
    if not hashes and not rest:
        return ALL
    if not hashes and len(rest) == 1:
        return rest[0]
    return Query(Op.AND, frozenset(hashes), tuple(rest))


def disjunction(parts: list[Query]) -> Query:
    """Any of the parts. One that is all makes all, those that are none say nothing."""
    hashes: set[int] = set()
    rest: list[Query] = []
    for p in parts:
        if p.op is Op.ALL:
            return ALL
        if p.op is Op.OR:
            hashes |= p.hashes
            rest += [c for c in p.children if c not in rest]
        elif p.op is Op.AND and p not in rest:
            rest.append(p)
    if not hashes and not rest:
        return NONE
    if not hashes and len(rest) == 1:
        return rest[0]
    return Query(Op.OR, frozenset(hashes), tuple(rest))


def literal_query(text: str, longest: int = MAX_LENGTH) -> Query:
    """Documents that may hold a literal. Fewer than three bytes say nothing, as texts have no n-gram so short."""
    data = fold(text.encode("utf-8", "surrogatepass"))
    found = covering_ngrams(data, longest) if len(data) >= 3 else []
    return Query(Op.AND, frozenset(map(zlib.crc32, found))) if found else ALL


def _choices(node: object) -> list[str] | None:
    """The characters that a one-character node matches, if they are few; null if it is no such node."""
    if isinstance(node, Char):
        return sorted(variants(node.char)) if node.fold else [node.char]
    if isinstance(node, Set):
        ranges = ranges_of(node)
        if ranges is not None and sum(hi - lo + 1 for lo, hi in ranges) <= MAX_MEMBERS and not any(lo < 0xE000 and hi >= 0xD800 for lo, hi in ranges):
            return [chr(k) for lo, hi in ranges for k in range(lo, hi + 1)]
    return None


def _folded(choices: list[str]) -> str | None:
    """What all the choices are indexed as, if that is one string."""
    forms = {fold(c.encode("utf-8", "surrogatepass")) for c in choices}
    return forms.pop().decode("utf-8", "surrogatepass") if len(forms) == 1 else None


def _walk(node: object, longest: int) -> Query:
    if isinstance(node, Concat):
        parts: list[Query] = []
        run = ""
        for p in _flat(node):
            choices = _choices(p)
            one = _folded(choices) if choices else None
            if one is not None:
                run += one
                continue
            parts.append(literal_query(run, longest))
            run = ""
            parts.append(_walk(p, longest))
        parts.append(literal_query(run, longest))
        return conjunction(parts)
    if isinstance(node, Alternation):
        return disjunction([_walk(a, longest) for a in node.arms])
    if isinstance(node, Group):
        return _walk(node.sub, longest)
    if isinstance(node, Repeat):
        return _walk(node.sub, longest) if node.least else ALL
    if isinstance(node, (Char, Set)):
        choices = _choices(node)
        return ALL if choices is None else disjunction([literal_query(c, longest) for c in choices])
    assert isinstance(node, (Empty, Look, Dot)), node
    return ALL


def _flat(node: Concat) -> list[object]:
    """The parts of a concatenation; groups and exact repeats of a literal are laid open."""
    out: list[object] = []
    for p in node.parts:
        while isinstance(p, Group):
            p = p.sub
        if isinstance(p, Concat):
            out += _flat(p)
        elif isinstance(p, Repeat) and p.least >= 1 and _choices(p.sub) is not None and p.least <= 32:
            out += [p.sub] * p.least
            if p.most != p.least:
                out.append(Repeat(p.sub, 0, None, True))
        elif isinstance(p, Look):
            out.append(p) if p.kind in "^$" and p.multiline else None
        elif not isinstance(p, Empty):
            out.append(p)
    return out


def plan(pattern: str, ignore_case: bool = False, longest: int = MAX_LENGTH) -> Query:
    """The index query of a pattern: every document with a matching line satisfies it.

    Sound for whole documents too: a text edge inside a pattern only restricts its matches, so the
    literals on its sides may be joined; a line edge may stand for a line feed, so they may not.
    """
    tree = parse(pattern, ignore_case)
    return _walk(tree if isinstance(tree, Concat) else Concat((tree,)), longest)


def prune(q: Query, df: dict[int, int], keep: int = 8) -> Query:
    """Leave out of each conjunction all hashes but the ``keep`` rarest, and of these the ones that
    are so much more frequent that reading their lists costs more than what they rule out; still sound."""
    children = tuple(prune(c, df, keep) for c in q.children)
    if q.op is not Op.AND:
        return Query(q.op, q.hashes, children)
    rarest = sorted(q.hashes, key=lambda h: (df.get(h, 0), h))[:keep]
    most = WORTH * (df.get(rarest[0], 0) + WORTH) if rarest else 0
    return Query(q.op, frozenset(h for h in rarest if df.get(h, 0) <= most), children)


def bound(q: Query, df: dict[int, int], n_docs: int) -> int:
    """The most documents that the query can give."""
    if q.op is Op.ALL:
        return n_docs
    if q.op is Op.NONE:
        return 0
    sizes = [df.get(h, 0) for h in q.hashes] + [bound(c, df, n_docs) for c in q.children]
    return min(sizes) if q.op is Op.AND else min(n_docs, sum(sizes))


def condition(q: Query, held: dict[int, Column]) -> Column:
    """The query over a document's row that says of each leaf whether the document holds it."""
    if q.op in (Op.ALL, Op.NONE):
        return F.lit(q.op is Op.ALL)
    parts = [held[h] for h in sorted(q.hashes)] + [condition(c, held) for c in q.children]
    return reduce((lambda a, b: a & b) if q.op is Op.AND else (lambda a, b: a | b), parts)


def solve(q: Query, lists: dict[int, np.ndarray]) -> np.ndarray:
    """The query over the sorted lists of its leaves; a hash without one is in no document."""
    none = np.zeros(0, np.int64)
    parts = [lists.get(h, none) for h in sorted(q.hashes)] + [solve(c, lists) for c in q.children]
    if q.op is Op.AND:
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(parts, key=len))
    return reduce(np.union1d, parts, none) if q.op is Op.OR else none

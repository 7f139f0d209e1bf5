"""Evaluation texts in training text: generalised suffix automata over the test items' words.

The test items are dealt to blocks of a bounded number of words, and a task inserts all items of a
block into one suffix automaton; each is built once, written to the shared folder and sent to the
workers as a broadcast of its own. The training texts are read once: a gate over the hashed word
pairs of all items, vectorised over many texts, keeps only those stretches in which every two
neighbouring words are neighbours in some item; no match can lie outside them. The stretches then
stream word by word through the automaton of every block; the length of the longest match that
ends at each word is tracked, and wherever it reaches the minimum, the items that hold the matched
words are reported.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.ngrams import sorted_distinct
from quernel.llm.chars import END, Hasher, code_points, groups, word_table
from quernel.runtime import stored

#: Words of test items that make one automaton, on average over the blocks.
BLOCK_WORDS = 400_000
MIN_WORDS = 12
#: Automata that a worker keeps.
MAX_LOADED = 4
#: Training texts are gated together up to this many characters.
BATCH_CHARS = 1 << 20
#: The table of word pairs has so many bits, as a power of two, that a tenth of it is set; with more
#: than 27 million words of items (32 MB of table) it fills up, and more stretches pass.
GATE_BITS = (22, 28)
#: Parts of the table are put together by the tasks.
PART_BITS = 20
#: Stretches that go through all automata together.
HELD_CHARS = 16 << 20

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    if "İ" in text:  # its lower case has a mark that is no letter, which would split the word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


def _pair(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbours among hashed words, of as many bits as the largest table needs."""
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - GATE_BITS[1])


def _words_at(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of code points."""
    folded = word_table()[points]
    edge = np.flatnonzero(np.diff((folded != 0).astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    return start, end, Hasher(folded)(start, end)


class Gate:
    """Which hashes of word pairs occur in items: a table of bits."""

    def __init__(self, bits: int, table: np.ndarray | None = None):
        self.bits = bits
        self.table = np.zeros(1 << bits >> 3, np.uint8) if table is None else table

    @staticmethod
    def pairs(texts: list[str]) -> np.ndarray:
        """The sorted hashes of the word pairs of some texts."""
        found = [_pair(_words_at(code_points([t])[0])[2]) for t in texts]
        return sorted_distinct(np.concatenate([np.zeros(0, np.uint64), *found]))

    def add(self, pairs: np.ndarray) -> Gate:
        at = (pairs >> np.uint64(GATE_BITS[1] - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return self

    def stretches(self, points: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(from, to) of the characters whose neighbouring words all are neighbours in an item.

        Words are compared by hash and pairs by a bit table, so a stretch may be found by chance,
        but none that holds a match of ``least`` words is lost.
        """
        start, end, h = _words_at(points)
        if len(start) < least:
            return []
        at = (_pair(h) >> np.uint64(GATE_BITS[1] - self.bits)).astype(np.int64)
        ok = (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        # words of two texts are no neighbours
        text = np.searchsorted(np.flatnonzero(points == END), start)
        ok &= text[1:] == text[:-1]
        run = np.flatnonzero(np.diff(ok.astype(np.int8), prepend=0, append=0))
        return [(int(start[a]), int(end[b])) for a, b in zip(run[::2], run[1::2]) if b - a + 1 >= least]


class Automaton:
    """A generalised suffix automaton over word sequences, with the items of each match."""

    def __init__(self, items: list[tuple[int, str]], least: int = MIN_WORDS):
        if least < 2:
            raise ValueError("a passage has two words at least")
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        sequences = []
        for item, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            sequences.append((item, seq))
        for item, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w, ends)
                ends[last].add(item)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        #: For each state that can match enough words: the items that hold its last ``least`` words.
        self.found: list[tuple[int, ...]] = [()] * len(self.link)
        for s in reversed(order):
            if self.length[s] >= least:
                up = self.link[s]
                self.found[s] = self.found[up] if self.length[up] >= least else tuple(sorted(ends[s]))

    def _copy(self, q: int, length: int, ends: list[set[int]]) -> int:
        self.next.append(dict(self.next[q]))
        self.length.append(length)
        self.link.append(self.link[q])
        ends.append(set())
        return len(self.next) - 1

    def _redirect(self, p: int, w: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(w) == old:
            self.next[p][w] = new
            p = self.link[p]

    def _extend(self, last: int, w: int, ends: list[set[int]]) -> int:
        q = self.next[last].get(w)
        if q is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            c = self._copy(q, self.length[last] + 1, ends)
            self.link[q] = c
            self._redirect(last, w, q, c)
            return c
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        ends.append(set())
        cur, p = len(self.next) - 1, last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                c = self._copy(q, self.length[p] + 1, ends)
                self.link[q] = self.link[cur] = c
                self._redirect(p, w, q, c)
        return cur

    def stream(self, ids: list[int], offset: int = 0) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end word, matched words, items) wherever at least ``least`` words match."""
        nxt, link, length, least, found = self.next, self.link, self.length, self.least, self.found
        s = n = 0
        for k, w in enumerate(ids):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(w)
            if t is None:
                n = 0
                continue
            s, n = t, n + 1
            if n >= least:
                yield offset + k, n, found[s]


    def matches(self, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """``stream`` over the words of a text."""
        get = self.vocabulary.get
        return self.stream([get(w, -1) for w in words(text)])


def _slots(bits: int):
    """Arrow operator from texts to the places of their word pairs in the table, by part of the table."""
    width = min(bits, PART_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in groups(b.column("text").to_pylist(), BATCH_CHARS):
                at = sorted_distinct(Gate.pairs(texts) >> np.uint64(GATE_BITS[1] - bits)).astype(np.int64)
                part, head = np.unique(at >> width, return_index=True)
                edges = [*head.tolist(), len(at)]
                data = [(at[x:y] & ((1 << width) - 1)).astype("<u4").tobytes() for x, y in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(data, pa.binary())], names=["part", "data"])

    return run


def _part(width: int):
    def run(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << width, bool)
        for d in t.column("data").to_pylist():
            bits[np.frombuffer(d, "<u4")] = True
        return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def _build(least: int):
    """The automaton of a block of items; items of any type are numbered within it."""

    def run(t: pa.Table) -> pa.Table:
        items, texts = t.column("item").to_pylist(), t.column("text").to_pylist()
        order = sorted(range(len(items)), key=lambda k: (str(items[k]), texts[k]))
        ids = list(dict.fromkeys(items[k] for k in order))
        number = {i: k for k, i in enumerate(ids)}
        a = Automaton([(number[items[k]], texts[k]) for k in order], least)
        return pa.table({"block": t.column("block").slice(0, 1), "n_items": pa.array([len(ids)], pa.int64()), "data": pa.array([pickle.dumps((a, ids), 5)], pa.binary())})

    return run


class TestItems:
    """The test items, ready to be looked for: the gate over all of them and an automaton for each block.

    The driver holds the gate (32 MB at most) and, one at a time, the automata that it sends out.
    """

    __test__ = False

    def __init__(self, items: DataFrame, item: str, text: str, least: int, block_words: int):
        if least < 2:
            raise ValueError("a passage has two words at least")
        spark = items.sparkSession
        rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").distinct()
        self.kind, self.least, self.token = rows.schema["item"].dataType, least, uuid.uuid4().hex
        total = rows.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
        self.n_blocks = max(1, -(-total // block_words))
        low, high = GATE_BITS
        self.bits = min(high, max(low, int(10 * total).bit_length()))
        blocks = stored(rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(self.n_blocks))), "items")
        width = min(self.bits, PART_BITS)
        parts = blocks.mapInArrow(_slots(self.bits), "part long, data binary").groupBy("part").applyInArrow(_part(width), "part long, bits binary")
        table = np.zeros(1 << self.bits >> 3, np.uint8)
        for r in parts.collect():  # 2**28 bits at most
            table[r["part"] << width >> 3 : (r["part"] + 1) << width >> 3] = np.frombuffer(r["bits"], np.uint8)
        self.gate = spark.sparkContext.broadcast(Gate(self.bits, table))
        self.built = stored(blocks.groupBy("block").applyInArrow(_build(least), "block long, n_items long, data binary"), "automata")
        self.automata = [spark.sparkContext.broadcast(r["data"]) for r in self.built.select("data").toLocalIterator()]


_loaded: OrderedDict[tuple[str, int], tuple[Automaton, list]] = OrderedDict()


def _load(token: str, number: int, shared) -> tuple[Automaton, list]:
    """An automaton that was built before and its items; a worker keeps the last ones it used."""
    at = (token, number)
    if at not in _loaded:
        while len(_loaded) >= MAX_LOADED:
            _loaded.popitem(last=False)
        _loaded[at] = pickle.loads(shared.value)
    _loaded.move_to_end(at)
    return _loaded[at]


_STRETCH = T.StructType([T.StructField("at", T.LongType()), T.StructField("part", T.StringType())])


def _gated(gate, least: int, keep_text: bool):
    """Arrow operator from (doc, text) to the texts that have stretches, with these."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("part", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in groups(b.column("text").to_pylist(), BATCH_CHARS):
                found: dict[int, list[dict]] = {}
                points, starts = code_points(texts)
                for x, y in gate.value.stretches(points, least):
                    k = int(np.searchsorted(starts, x, "right")) - 1
                    at = x - int(starts[k])
                    found.setdefault(k, []).append({"at": at, "part": texts[k][at : y - int(starts[k])]})
                if found:
                    docs = b.column("doc").take(pa.array([first + k for k in found]))
                    yield pa.RecordBatch.from_arrays([docs, pa.array([texts[k] if keep_text else None for k in found], pa.string()), pa.array(list(found.values()), kind)], names=["doc", "text", "stretches"])

    return run


def _through(items: TestItems, emit):
    """Arrow operator that sends stretches (rid, doc, at, part) through every automaton; ``emit`` makes rows of the matches."""
    automata, token = items.automata, items.token

    def matched(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        for number, shared in enumerate(automata):
            a, ids = _load(token, number, shared)
            rows = emit(((row, end, n, [ids[i] for i in found]) for row in held for end, n, found in a.matches(row[3])))
            if rows is not None:
                yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("rid", "doc", "at", "part"))):
                held.append(row)
                n += len(row[3])
                if n >= HELD_CHARS:
                    yield from matched(held)
                    held, n = [], 0
        if held:
            yield from matched(held)

    return run


def _stretches(docs: DataFrame, doc: str, text: str, items: TestItems, keep_text: bool) -> tuple[DataFrame, DataFrame]:
    """(texts with stretches, their stretches); the only pass over the training texts."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType()), T.StructField("stretches", T.ArrayType(_STRETCH))])
    some = stored(rows.mapInArrow(_gated(items.gate, items.least, keep_text), schema).withColumn("rid", F.monotonically_increasing_id()), "gated")
    return some, some.select("rid", "doc", F.explode("stretches").alias("s")).select("rid", "doc", "s.at", "s.part")


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, n_words): documents that hold at least ``least`` consecutive words of an item.

    ``n_words`` is the length of a longest run that ends in a passage of the item. The documents
    are read once, now, however many items there are; items may have ids of any type.

    Cases: null or empty texts and items with fewer words than ``least`` match nothing; null item
    ids are left out; repeated rows give one row; very long texts are searched whole; passages
    never run across two texts; other columns are not read.
    """
    wanted = TestItems(items, item, item_text, least, block_words)
    _, parts = _stretches(docs, doc, text, wanted, False)
    kinds = T.StructType([parts.schema["doc"], T.StructField("item", wanted.kind), T.StructField("n_words", T.LongType())])
    arrow = [f.type for f in _arrow_schema(kinds)]

    def emit(matches) -> pa.RecordBatch | None:
        best: dict[tuple, list] = {}
        for row, _, n, found in matches:
            for i in found:
                at = best.setdefault((row[0], i), [row[1], i, 0])
                at[2] = max(at[2], n)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*best.values()), arrow)], names=["doc", "item", "n_words"]) if best else None

    return parts.mapInArrow(_through(wanted, emit), kinds).groupBy("doc", "item").agg(F.max("n_words").alias("n_words"))


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _spans(matches) -> pa.RecordBatch | None:
    """(rid, low, high): the characters of the text that each match covers."""
    rid, low, high = [], [], []
    last, at = None, []
    for row, end, n, _ in matches:
        if row is not last:
            last, at = row, [m.span() for m in _WORD.finditer(row[3])]
        rid.append(row[0])
        low.append(row[2] + at[end - n + 1][0])
        high.append(row[2] + at[end][1])
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["rid", "low", "high"]) if rid else None


def _clean(max_span: int, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                spans: list[list[int]] = []
                for x, y in sorted((s["low"], s["high"]) for s in found):
                    if spans and not _WORD.search(text, spans[-1][1], x):  # nothing but marks between
                        spans[-1][1] = max(y, spans[-1][1])
                    else:
                        spans.append([x, y])
                size = [len(words(text[x:y])) for x, y in spans]
                share = sum(size) / max(1, len(words(text)))
                kept, pos = [], 0
                for x, y in spans:
                    kept.append(text[pos:x])
                    pos = y
                rows.append((len(spans), max(size), share, max(size) > max_span or share > max_coverage, "".join([*kept, text[pos:]])))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc", "n_spans", "longest", "coverage", "dropped", "text"])

    return run


def remove_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, least: int = MIN_WORDS, max_span: int = 200, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc, n_spans, longest, coverage, dropped, text) of each document that holds a passage.

    ``text`` is the document without the matched spans. ``dropped`` says that a span has more than
    ``max_span`` words or the spans more than ``max_coverage`` of all words, so that the rest
    should not be kept either. Documents without a passage are absent. Spans of all blocks of items
    are merged before they are removed. The documents are read once; of those that may hold a
    passage the text is stored. Repeated rows give repeated rows.
    """
    wanted = TestItems(items, item, item_text, least, block_words)
    some, parts = _stretches(docs, doc, text, wanted, True)
    spans = parts.mapInArrow(_through(wanted, _spans), "rid long, low long, high long").distinct()
    found = spans.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # bounded by a text's words
    kind = some.schema["doc"].dataType.simpleString()
    return some.select("rid", "doc", "text").join(found, "rid").select("doc", "text", "spans").mapInArrow(_clean(max_span, max_coverage), f"doc {kind}, n_spans long, longest long, coverage double, dropped boolean, text string")

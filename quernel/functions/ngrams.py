"""Sparse n-grams: the byte slices between two weights that exceed every weight between them.

With ``W[i]`` the weight of bytes ``i`` and ``i + 1``, the slice ``[l, r + 2)`` is an n-gram iff every
weight strictly between ``l`` and ``r`` is less than both ``W[l]`` and ``W[r]``. The definition looks
at nothing outside the slice, so the n-grams of a literal are n-grams of every text that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quernel.functions.weights import pair_weights

MAX_LENGTH = 16
#: Reflected polynomial of the usual 32-bit cyclic redundancy check.
_POLYNOMIAL = 0xEDB88320
#: Document ids whose lists are built in one task: 4 million, so that no task holds a frequent
#: n-gram's whole list.
SPAN_BITS = 22
#: Bytes that are tokenised together.
BATCH_BYTES = 1 << 21

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    """What ``np.unique`` gives, by a sort, which is several times as fast as its table of hashes."""
    a = np.sort(a)
    return a[np.r_[len(a) > 0, a[1:] != a[:-1]]] if len(a) else a


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


_CRC = _crc_table()


def fold(data: bytes) -> bytes:
    """The form that is indexed: ASCII letters in lower case, and so the two other letters whose
    case variants are ASCII (Kelvin sign, long s); all other bytes as they are."""
    return data.translate(_FOLD).replace(b"\xe2\x84\xaa", b"k").replace(b"\xc5\xbf", b"s")


def sparse_spans(data: np.ndarray, end: np.ndarray | None = None, longest: int = MAX_LENGTH) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of all n-grams of 3 to ``longest`` bytes; ``end`` is the end of each byte's text."""
    n = len(data)
    if n < 3:
        return
    w = pair_weights(data)
    inside = np.full(n - 2, -1, np.int32)
    for length in range(3, min(longest, n) + 1):
        count = n - length + 1
        if length > 3:
            inside = np.maximum(inside[:count], w[length - 3 : length - 3 + count])
        else:
            inside = inside[:count]
        ok = inside < np.minimum(w[:count], w[length - 2 : length - 2 + count])
        if end is not None:
            ok &= np.arange(count) + length <= end[:count]
        yield length, np.flatnonzero(ok)


def sparse_ngrams(data: bytes, longest: int = MAX_LENGTH) -> list[tuple[int, bytes]]:
    """(position, n-gram) of a byte string, by position and length. Two bytes are their only n-gram."""
    if len(data) == 2:
        return [(0, data)] if longest >= 2 else []
    a = np.frombuffer(data, np.uint8)
    return sorted((int(s), data[s : s + length]) for length, starts in sparse_spans(a, None, longest) for s in starts)


def covering_ngrams(literal: bytes, longest: int = MAX_LENGTH) -> list[bytes]:
    """The n-grams of a literal that lie in no other of them: they imply all the others."""
    spans = sorted(((s, s + len(g)) for s, g in sparse_ngrams(literal, longest)), key=lambda x: (x[0], -x[1]))
    out, reach = [], -1
    for a, b in spans:
        if b > reach:
            out.append(literal[a:b])
            reach = b
    return out


def hashes(data: np.ndarray, end: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, CRC-32) of all n-grams of texts laid end to end."""
    n = len(data)
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    spans = dict(sparse_spans(data, end, longest))
    starts, lengths, codes = [], [], []
    for k in range(1, max(spans, default=0) + 1):
        count = n - k + 1
        state = _CRC[(state[:count] ^ data[k - 1 : k - 1 + count]) & np.uint32(0xFF)] ^ (state[:count] >> np.uint32(8))
        at = spans.get(k)
        if at is not None and len(at):
            starts.append(at)
            lengths.append(np.full(len(at), k, np.int8))
            codes.append(state[at] ^ np.uint32(0xFFFFFFFF))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint32)
    return np.concatenate(starts), np.concatenate(lengths), np.concatenate(codes)


def _slices(contents: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    held, n, start = [], 0, 0
    for k, c in enumerate(contents):
        held.append(fold(c or b""))
        n += len(held[-1])
        if n >= BATCH_BYTES:
            yield start, held
            held, n, start = [], 0, k + 1
    if held:
        yield start, held


def _entries(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of all n-grams of some texts."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(size)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), size)
    start, _, code = hashes(data, stop[owner], longest)
    text = owner[start]
    for k in np.flatnonzero(size == 2) if longest >= 2 else ():  # two bytes are their only n-gram
        start, text = np.r_[start, stop[k] - 2], np.r_[text, k]
        code = np.r_[code, np.uint32(zlib.crc32(texts[k]))]
    return text, start - (stop - size)[text], code


def _distinct(text: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The distinct (text, hash) pairs as sorted 64-bit keys."""
    return sorted_distinct(text.astype(np.uint64) << np.uint64(32) | code)


def tokenise(distinct: bool, longest: int = MAX_LENGTH):
    """Arrow operator from (doc_id, content) to (ngram_hash, doc_id[, pos]).

    With ``distinct`` each hash comes once per text, which is what an index needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in _slices(b.column("content").to_pylist()):
                text, pos, code = _entries(texts, longest)
                if distinct:
                    key = _distinct(text, code)
                    text, code = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(ids[first + text])], names=["ngram_hash", "doc_id"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(ids[first + text]), pa.array(pos.astype(np.int32))], names=["ngram_hash", "doc_id", "pos"])

    return run


def count_ngrams(longest: int = MAX_LENGTH):
    """Arrow operator from (doc_id, content) to (doc_id, n_entries); nothing is hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _slices(b.column("content").to_pylist()):
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                stop = np.cumsum(size)
                owner = np.repeat(np.arange(len(texts)), size)
                n = np.where((size == 2) & (longest >= 2), 1, 0)
                for _, starts in sparse_spans(np.frombuffer(b"".join(texts), np.uint8), stop[owner], longest):
                    n = n + np.bincount(owner[starts], minlength=len(texts))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64())], names=["doc_id", "n_entries"])

    return run


def pack_numbers(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers of one length, compressed byte plane by byte plane: small numbers make runs of zeros."""
    planes = np.concatenate([np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel() for a in columns])
    return len(columns[0]).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack_numbers(data: bytes, n_columns: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[4:], 4 * n * n_columns, asbytes=True), np.uint8).reshape(n_columns, 4, n)
    return [np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes]


def tokenise_packed(bits: int, longest: int = MAX_LENGTH):
    """Arrow operator from (doc_id, content) to (bucket, span, data): the distinct pairs of a slice of
    texts, packed by the first ``bits`` bits of the hash and by span of document ids.

    A slice makes a few hundred rows instead of a million, which spares the shuffle its work per row.
    The pairs of a row are sorted by hash and packed as differences of hashes and as places in a table
    of the slice's ids, which the row begins with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in _slices(b.column("content").to_pylist()):
                text, _, code = _entries(texts, longest)
                known, rank = np.unique(ids[first : first + len(texts)], return_inverse=True)
                # by hash, then by document: sorted, so that equal pairs are neighbours
                key = sorted_distinct(code.astype(np.uint64) << np.uint64(32) | rank[text].astype(np.uint64))
                code, doc = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
                spans = known >> SPAN_BITS
                bucket, span = (code >> np.uint32(32 - bits)).astype(np.int64), spans[doc]
                if len(spans) and spans[0] != spans[-1]:
                    order = np.lexsort((span, bucket))  # keeps the order by hash within
                    code, doc, bucket, span = code[order], doc[order], bucket[order], span[order]
                head = np.flatnonzero(np.r_[len(code) > 0, (bucket[1:] != bucket[:-1]) | (span[1:] != span[:-1])])
                step = np.diff(code, prepend=np.uint32(0))
                step[head] = code[head]
                edges, data, tables = [*head.tolist(), len(code)], [], {}
                for x, y in zip(edges[:-1], edges[1:]):
                    at = int(span[x])
                    low, high = np.searchsorted(spans, [at, at + 1]).tolist()
                    if at not in tables:
                        tables[at] = pack_numbers(np.diff(known[low:high] - (at << SPAN_BITS), prepend=0))
                    data.append(len(tables[at]).to_bytes(4, "little") + tables[at] + pack_numbers(step[x:y], doc[x:y] - low))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[head]), pa.array(span[head]), pa.array(data, pa.binary())], names=["bucket", "span", "data"])

    return run


def unpack_lists(chunk_bits: int):
    """Arrow operator from rows (bucket, span, data), sorted by (bucket, span), to posting lists."""

    def lists(span: int, parts: list[bytes]) -> pa.RecordBatch:
        codes, offsets = [], []
        for p in parts:
            n = 4 + int.from_bytes(p[:4], "little")
            step, place = unpack_numbers(p[n:], 2)
            codes.append(np.cumsum(step, dtype=np.uint32))
            offsets.append(np.cumsum(unpack_numbers(p[4:n], 1)[0], dtype=np.uint32)[place])
        code, offset = np.concatenate(codes), np.concatenate(offsets)
        key = sorted_distinct(code.astype(np.uint64) << np.uint64(32) | offset)
        code, doc = (key >> np.uint64(32)).astype(np.uint32), (span << SPAN_BITS) + (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        chunk = doc >> chunk_bits
        head = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])])
        edges = np.r_[head, len(code)]
        ids = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(doc))
        return pa.RecordBatch.from_arrays([pa.array(code[head].astype(np.int64)), pa.array(chunk[head]), pa.array(np.diff(edges).astype(np.int32)), ids], names=["ngram_hash", "chunk", "n_docs", "doc_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for bucket, span, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "span", "data"))):
                if held and at != (bucket, span):
                    yield lists(at[1], held)
                    held = []
                at = (bucket, span)
                held.append(data)
        if held:
            yield lists(at[1], held)

    return run

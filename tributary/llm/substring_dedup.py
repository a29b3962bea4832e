"""Removal of repeated passages, with a count-min sketch as prefilter.

A passage is a window of consecutive words. A word goes if a window over it also starts earlier, in a
document of smaller doc_id or earlier in the same one.

1. Documents are dealt to buckets by doc_id; a bucket's texts are moved once and read three times.
2. Every bucket sketches its windows: a window has a 128-bit key, a slice of the key space and, in each
   row of the slice's count-min sketch, a cell. The bucket sends the cells it uses, and which of them more
   than once, as coded gaps (about ten bits for a window and row). A sketch has a fixed size; their number
   follows the data.
3. For each slice the buckets' sketches are merged by adding counts. Counts are never too small. Each
   bucket is told which of its own cells were counted more than once.
4. In the second pass a bucket forwards only windows all of whose cells are repeated. It compares its own
   windows first, so it forwards a key once, however common. These few are grouped exactly, by key,
   over all buckets, a slice at a time: all but the earliest are repeats. They travel as packed arrays, and
   places in planes of bytes, which compress well.
5. The words under repeats are removed.

Defined cases: null text has no words; texts shorter than a window stay whole; a null doc_id counts as
later than all others; rows of equal doc_id have equal addresses, so equal windows at the same place of
both are one occurrence; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 20
#: Bytes of text in a bucket, on average.
BUCKET_BYTES = 12 << 20
#: A slice's share of windows, its cells in each row (a power of two), and rows.
SLICE_WINDOWS, CELL_BITS, ROWS = 4 << 20, 24, 2
#: The address of a row without doc_id: the last doc_id, at places beyond all that a text can have.
LAST, BEYOND = np.iinfo(np.int64).max, 1 << 30

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def keys_of(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, row, start) of every window of the texts; equal word sequences have equal keys."""
    import xxhash

    counts, parts = [], []
    for t in texts:
        words = t.split()
        counts.append(len(words))
        if len(words) >= width:
            parts.append(b"".join(map(xxhash.xxh3_128_digest, words)))
    hashed = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)
    n = np.array(counts, np.int64)
    rows = np.flatnonzero(n >= width)
    many = n[rows] - width + 1
    row = np.repeat(rows, many)
    start = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(np.cumsum(n[rows]) - n[rows], many) + start
    out = []
    for half, factor in ((0, A), (1, B)):
        h = np.ascontiguousarray(hashed[:, half])
        size = max(0, len(h) - width + 1)
        k = np.zeros(size, np.uint64)
        for j in range(width):
            k *= factor
            k += h[j : j + size]
        k ^= k >> np.uint64(29)
        k *= B
        k ^= k >> np.uint64(32)
        out.append(k[at])
    return out[0], out[1], row, start


def cells_of(k1: np.ndarray, k2: np.ndarray, slices: int, bits: int) -> list[np.ndarray]:
    """For each row of the sketches, slice and cell of every key as one number."""
    part = (k1 >> np.uint64(24)) % np.uint64(slices) << np.uint64(bits)
    mask = np.uint64((1 << bits) - 1)
    return [part | (k2 >> np.uint64(shift) & mask) for shift in (0, 32)[:ROWS]]


def code(cells: np.ndarray) -> bytes:
    """Ascending different cells as gaps: low bits as bytes or words, high parts in unary."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    wide = len(cells) > 0 and cells[-1] / len(cells) > 2000
    low, b = gaps.astype(np.uint16 if wide else np.uint8), 16 if wide else 8
    high = gaps >> b
    unary = np.zeros(int(high.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    return np.array([len(cells), b], np.uint32).tobytes() + low.tobytes() + np.packbits(unary).tobytes()


def decode(data: bytes) -> np.ndarray:
    n, b = np.frombuffer(data, np.uint32, 2)
    kind = np.uint16 if b == 16 else np.uint8
    low = np.frombuffer(data, kind, n, 8).astype(np.int64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + int(n) * (int(b) // 8))))[:n]
    high = np.diff(ones, prepend=-1) - 1
    return np.cumsum((high << int(b)) + low)


def _table(columns: dict[str, tuple[object, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _in_order(t: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a bucket, in an order that depends on the rows alone."""
    import xxhash

    ids, texts = t["doc_id"].to_pylist(), t["text"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is None, ids[i] or 0, xxhash.xxh3_64_intdigest(texts[i])))
    return [ids[i] for i in order], [texts[i] for i in order]


def _sketch(slices: int, bits: int, width: int):
    def run(t: pa.Table) -> pa.Table:
        p = t["p"][0].as_py()
        k1, k2, _, _ = keys_of(_in_order(t)[1], width)
        out: dict[str, list] = {"slice": [], "p": [], "line": [], "cells": [], "twice": []}
        for line, cells in enumerate(cells_of(k1, k2, slices, bits)):
            cells.sort()
            first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
            twice = np.diff(np.r_[first, len(cells)]) > 1
            cells = cells[first]
            part = (cells >> np.uint64(bits)).astype(np.int64)
            for lo, hi in _runs(part):
                mine = (cells[lo:hi] & np.uint64((1 << bits) - 1)).astype(np.int64)
                for key, v in zip(out, (int(part[lo]), p, line, code(mine), np.packbits(twice[lo:hi]).tobytes()), strict=True):
                    out[key].append(v)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return _table({k: (v, ty) for (k, v), ty in zip(out.items(), types, strict=True)})

    return run


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True) if len(x) else ()


def _merge(bits: int):
    def run(t: pa.Table) -> pa.Table:
        counts = np.zeros((ROWS, 1 << bits), np.uint8)  # stops at 2
        ps, lines, cells, twice = (t[c].to_pylist() for c in ("p", "line", "cells", "twice"))
        for line, data, more in zip(lines, cells, twice, strict=True):
            at = decode(data)
            add = 1 + np.unpackbits(np.frombuffer(more, np.uint8), count=len(at))
            counts[line, at] = np.minimum(counts[line, at] + add, 2)
        repeated = []
        for line, data in zip(lines, cells, strict=True):
            at = decode(data)
            repeated.append(code(at[counts[line, at] > 1]))
        return _table({"slice": (t["slice"].to_pylist(), pa.int32()), "p": (ps, pa.int32()), "line": (lines, pa.int32()), "cells": (repeated, pa.binary())})

    return run


FOUND = "slice int, p int, own boolean, keys binary, docs binary, rows binary, starts binary, runs binary"
_FOUND = (pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5)
REPEATS = "p int, rows binary, starts binary, runs binary"
NONE = b""


def planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte: all lowest bytes, then the next."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _first(k1: np.ndarray, k2: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): an order by key and address, and whether a window comes after the first of its key."""
    order = np.lexsort([start, at, k2, k1])
    k1, k2, at, start = k1[order], k2[order], at[order], start[order]
    new = np.flatnonzero(np.r_[np.ones(min(1, len(k1)), bool), (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    first = np.repeat(new, np.diff(np.r_[new, len(k1)]))
    return order, (at != at[first]) | (start != start[first])


def _forward(slices: int, bits: int, width: int):
    def run(t: pa.Table, said: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in FOUND.split(", ")}

        def put(*values) -> None:
            for column, v in zip(out.values(), values, strict=True):
                column.append(v)

        if t.num_rows:
            p = t["p"][0].as_py()
            ids, texts = _in_order(t)
            doc = np.array([LAST if d is None else d for d in ids], np.int64)
            beyond = np.array([BEYOND * (d is None) for d in ids], np.int64)
            k1, k2, row, start = keys_of(texts, width)
            left = np.arange(len(k1))
            for line, cells in enumerate(cells_of(k1, k2, slices, bits)):
                told = zip(said["slice"].to_pylist(), said["line"].to_pylist(), said["cells"].to_pylist(), strict=True)
                mine = [(np.uint64(s) << np.uint64(bits)) | decode(c).astype(np.uint64) for s, ln, c in told if ln == line]
                repeated = np.sort(np.concatenate([np.zeros(0, np.uint64), *mine]))
                asked = cells[left]
                place = np.minimum(np.searchsorted(repeated, asked), max(0, len(repeated) - 1))
                left = left[repeated[place] == asked] if len(repeated) else left[:0]
            k1, k2, row = k1[left], k2[left], row[left]
            at, start = doc[row], (start[left] + beyond[row]).astype(np.int32)
            order, later = _first(k1, k2, at, start)
            own_row, own_start, own_run = spans(row[order[later]], start[order[later]] % BEYOND)
            if len(own_row):
                put(p % slices, p, True, NONE, NONE, planes(own_row.astype(np.int32)), planes(own_start.astype(np.int32)), planes(own_run.astype(np.int32)))
            # windows at the address of the first go along, as another bucket may have an earlier one
            go = np.sort(order[~later])
            part = ((k1[go] >> np.uint64(24)) % np.uint64(slices)).astype(np.int64)
            by_slice = np.argsort(part, kind="stable")
            for lo, hi in _runs(part[by_slice]):
                x = go[by_slice[lo:hi]]
                put(int(part[by_slice[lo]]), p, False, np.concatenate([k1[x], k2[x]]).tobytes(), planes(at[x]), planes(row[x].astype(np.int32)), planes(start[x]), NONE)
        return _table({c: (v, ty) for (c, v), ty in zip(out.items(), _FOUND, strict=True)})

    return run


def _settle(t: pa.Table) -> pa.Table:
    """Of a slice's windows, those that come after the first of their key; what buckets found by themselves passes."""
    own = t.filter(t["own"])
    ps, rows, starts, runs = (own[c].to_pylist() for c in ("p", "rows", "starts", "runs"))
    sent = t.filter(pa.compute.invert(t["own"]))
    if sent.num_rows:
        keys = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in sent["keys"].to_pylist()]
        k1, k2 = np.concatenate(keys, axis=1)
        at = np.concatenate([from_planes(x, np.int64) for x in sent["docs"].to_pylist()])
        row, start = (np.concatenate([from_planes(x, np.int32) for x in sent[c].to_pylist()]) for c in ("rows", "starts"))
        bucket = np.repeat(sent["p"].to_numpy(), [x.shape[1] for x in keys])
        order, later = _first(k1, k2, at, start)
        x = np.sort(order[later])
        x = x[np.argsort(bucket[x], kind="stable")]
        for lo, hi in _runs(bucket[x]):
            mine = x[lo:hi]
            ps.append(int(bucket[mine[0]]))
            rows.append(planes(row[mine]))
            starts.append(planes(start[mine] % BEYOND))
            runs.append(NONE)
    return _table({"p": (ps, pa.int32()), "rows": (rows, pa.binary()), "starts": (starts, pa.binary()), "runs": (runs, pa.binary())})


def spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts: (row, first start, how many)."""
    order = np.lexsort([start, row])
    row, start = row[order], start[order]
    if not len(row):
        return row, start, row
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] - start[:-1] > 1)])
    ends = np.r_[new[1:], len(row)] - 1
    return row[new], start[new], start[ends] - start[new] + 1


def _remove(width: int):
    def run(t: pa.Table, repeats: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table({"doc_id": ([], pa.int64()), "text": ([], pa.string()), "n_words": ([], pa.int64()), "n_removed": ([], pa.int64())})
        ids, texts = _in_order(t)
        none = np.zeros(0, np.int32)
        row, start, many = none, none, none
        if repeats.num_rows:
            row, start = (np.concatenate([from_planes(x, np.int32) for x in repeats[c].to_pylist()]) for c in ("rows", "starts"))
            # a list without runs has single windows
            many = np.concatenate([from_planes(x, np.int32) if x else np.ones(len(r) // 4, np.int32) for x, r in zip(repeats["runs"].to_pylist(), repeats["rows"].to_pylist(), strict=True)])
        order = np.lexsort([start, row])
        row, start, many = row[order], start[order], many[order]
        lo, hi = np.searchsorted(row, np.arange(len(texts))), np.searchsorted(row, np.arange(len(texts)), "right")
        kept, words_in, removed = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            gone = 0
            if lo[i] < hi[i]:
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, start[lo[i] : hi[i]], 1)
                np.add.at(edges, start[lo[i] : hi[i]] + many[lo[i] : hi[i]] + width - 1, -1)
                stay = np.cumsum(edges[:-1]) == 0
                gone = len(words) - int(stay.sum())
                words = [words[k] for k in np.flatnonzero(stay)]
            kept.append(b" ".join(words).decode())
            words_in.append(len(words) + gone)
            removed.append(gone)
        return _table({"doc_id": (ids, pa.int64()), "text": (kept, pa.string()), "n_words": (words_in, pa.int64()), "n_removed": (removed, pa.int64())})

    return run


def remove_repeats(
    documents: DataFrame, width: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, slice_windows: int = SLICE_WINDOWS, cell_bits: int = CELL_BITS
) -> DataFrame:
    """One row per row of ``documents``: doc_id, text (the words that stay), n_words, n_removed."""
    small_batches(documents.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    slices = max(1, math.ceil(size / 6 / slice_windows))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    p = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(buckets)).cast("int")
    dealt = rows.withColumn("p", p).repartition(buckets, "p")
    sketches = dealt.groupBy("p").applyInArrow(_sketch(slices, cell_bits, width), "slice int, p int, line int, cells binary, twice binary")
    said = sketches.groupBy("slice").applyInArrow(_merge(cell_bits), "slice int, p int, line int, cells binary")
    found = dealt.groupBy("p").cogroup(said.groupBy("p")).applyInArrow(_forward(slices, cell_bits, width), FOUND)
    repeats = found.groupBy("slice").applyInArrow(_settle, REPEATS)
    return dealt.groupBy("p").cogroup(repeats.groupBy("p")).applyInArrow(_remove(width), "doc_id long, text string, n_words long, n_removed long")

"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Each partition
packs its pieces best-fit, largest first. Full and nearly full bins are emitted; the rest are
dealt to fewer partitions and packed again as items, round by round, until one partition holds what
is left or a round no longer helps. A bin carries the addresses of its pieces (at most ``capacity``), so
no round looks anything up. A partition packs in an order that depends on its items alone, and every
round is checkpointed, so a lost executor doesn't change a bin that others have seen.

Defined cases: a null text counts as empty and gives one piece, the end mark; a null doc_id or repeated
rows are packed like any other row, each with pieces of its own; extra columns are left alone; an empty
table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .tokens import WORD_TOKENIZER, load

CAPACITY, END_ID = 2048, 0
#: A bin with at most this share of its place empty isn't opened again.
SLACK = 0.002
#: Items that one partition packs at once.
ITEMS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
BINS = f"done boolean, sequence_id long, size long, members array<struct<{MEMBER}>>"
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")


def token_ids(documents: DataFrame, tokenizer: str = WORD_TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the token ids of every document, the end mark last."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            coded = [np.frombuffer(x + end, "<u4").astype(np.int32) for x in load(tokenizer).encode(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coded, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def pieces_of(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and the CRC-32 of its ids."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc, x in zip(b.column(0).to_pylist(), load(tokenizer).encode(b.column(1).to_pylist()), strict=True):
                x += end
                for k in range(0, len(x), 4 * capacity):
                    part = x[k : k + 4 * capacity]
                    rows.append((doc, k // 4 // capacity, k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(FIELDS[:5]))

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item in turn, the bin with the least room that it fits into, and its place there."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r
    bins = 0
    into, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            k, r, bins = bins, capacity, bins + 1
        into[i], place[i] = k, capacity - r
        r -= size
        if r:
            room[r].append(k)
            some |= 1 << r
    return into, place


def _packer(capacity: int, number: int, last: bool):
    """Packs what a partition holds; ``number`` tells the rounds apart in the ids of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        items = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
        if items is None or not items.num_rows:
            return
        lists = items["members"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        columns = [flat.field(i) for i in range(6)]
        starts = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]
        sizes, counts = items["size"].to_numpy(), np.diff(starts)
        doc = columns[0].fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        keys = [c.to_numpy(zero_copy_only=False)[starts[:-1]] for c in columns[1:5]]
        order = np.lexsort([*keys[::-1], doc[starts[:-1]], -sizes])
        into, place = best_fit(sizes[order].tolist(), capacity)
        bins = int(into.max()) + 1
        by_bin = np.lexsort([place, into])  # items in the order in which they lie in the bins
        taken = order[by_bin]
        many = counts[taken]
        pick = np.repeat(starts[taken] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        offset = columns[5].to_numpy()[pick] + np.repeat(place[by_bin], many)
        members = [c.take(pa.array(pick)) for c in columns[:5]] + [pa.array(offset)]
        filled = np.bincount(into, sizes[order], bins).astype(np.int64)
        heads = np.r_[0, np.cumsum(np.bincount(np.repeat(into[by_bin], many), minlength=bins))].astype(np.int32)
        done = np.full(bins, True) if last else filled >= capacity * (1 - SLACK)
        names = (number << 56) + (TaskContext.get().partitionId() << 28) + np.arange(bins)
        struct = pa.StructArray.from_arrays(members, FIELDS)
        whole = pa.RecordBatch.from_arrays(
            [pa.array(done), pa.array(names, pa.int64()), pa.array(filled), pa.ListArray.from_arrays(pa.array(heads), struct)],
            ["done", "sequence_id", "size", "members"],
        )
        for k in range(0, bins, 2000):
            yield whole.slice(k, 2000)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``; the pieces of a sequence leave no gap."""
    small_batches(pieces.sparkSession)
    pieces = cut(pieces)
    member = F.struct(*FIELDS[:5], F.lit(0).cast("long").alias("offset"))
    left = pieces.select(F.col("length").alias("size"), F.array(member).alias("members"))
    n, finished, number = pieces.count(), [], 0
    while n:
        parts = math.ceil(n / items)
        first = F.element_at("members", 1)
        dealt = left.repartition(parts, F.xxhash64(first, F.lit(number))) if parts > 1 else left.coalesce(1)
        packed = cut(dealt.mapInArrow(_packer(capacity, number, parts == 1), BINS))
        finished.append(packed.filter("done").select("sequence_id", "members"))
        left, before = packed.filter("not done").select("size", "members"), n
        n = left.count()
        number += 1
        if n > 0.9 * before:  # what is left doesn't go together any better
            finished.append(packed.filter("not done").select("sequence_id", "members"))
            break
    if not finished:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    placed = out.select("sequence_id", F.explode("members").alias("m"))
    return placed.select(*[F.col(f"m.{f}").alias(f) for f in FIELDS[:5]], "sequence_id", F.col("m.offset").alias("offset"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = WORD_TOKENIZER) -> DataFrame:
    """All documents as packed pieces."""
    return pack(pieces_of(documents, capacity, tokenizer), capacity)

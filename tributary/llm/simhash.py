"""Near duplicates by SimHash and a Gray-order hierarchical index.

1. A fingerprint per text (4-word shingles, XXH64 with seed 42, majority of each bit). Equal
   fingerprints become one class, so thousands of copies are one entry of the index.
2. Two fingerprints with at most four differing bits agree on one of five blocks of bits. Each
   class goes to five groups, by block and the block's value. A group of over ``GROUP_LIMIT``
   classes is dealt again by five blocks of its remaining bits, and one that is still larger is
   dealt to pairs of parts, so no task holds an unbounded group and no link is lost.
3. Within a group the fingerprints, rotated so that the shared block leads, are sorted by Gray
   rank: neighbours share most bits. Runs of neighbours form nodes that hold the bits all of
   them share (mask and pattern), runs of nodes the next level, up to a root. A search descends
   from the roots for many fingerprints at once, adds up the differences on each node's own
   bits, and drops a whole node as soon as the sum exceeds the limit.
4. A group yields a spanning forest of its links, not its pairs; components are found over it.

Defined cases: null text counts as empty; texts without words get fingerprint zero, and link like
any other; documents with a null doc_id get a fingerprint but link to nothing (null component) and
always stay; repeated rows share their document's component, and a doc_id that repeats with another text has
a fingerprint and component for each; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, left_out, small_batches
from .components import connected_components, unite

SHINGLE, SEED, MAX_BITS = 4, 42, 4
#: Bits from the top: (offset, width) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
FANOUT = 16
GROUP_LIMIT = 20_000
#: Rows of the index that a task gathers before it searches, and steps of a search at once.
BUFFER_ROWS, STEP_ROWS = 60_000, 100_000


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and white space 20 and 09-0D only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = chain((0,), (e + 1 for e in ends))
    shingles = map(joined.__getitem__, map(slice, starts, ends[SHINGLE - 1 :]))
    m = n - SHINGLE + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, m)
    counts = np.zeros(64, np.int64)
    for k in range(0, m, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > m, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64()), b.column(2), b.column(3)], ["doc_id", "fp", "hash", "size"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, hash, size) of every row; fp holds the 64 bits as a signed long, hash and size tell texts apart."""
    small_batches(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, hash long, size int")


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit word in Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code


def _rotated(offset: int) -> Column:
    fp = F.col("fp")
    return F.shiftleft(fp, offset).bitwiseOR(F.shiftrightunsigned(fp, 64 - offset)) if offset else fp


def _sub_blocks(width: int) -> list[tuple[int, int]]:
    """(shift, width) of five blocks of the bits below the leading ``width``."""
    rest, out = 64 - width, []
    for k in range(5):
        w = (rest - sum(x for _, x in out)) // (5 - k)
        out.append((rest - sum(x for _, x in out) - w, w))
    return out


def routed(classes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(g, rank, fp, rep): classes dealt to groups, such that any two that link meet in one.

    g is a hash; should two groups get the same one, they are searched as one group.
    """
    options = [
        F.struct(
            F.lit(i).alias("block"),
            _rotated(o).alias("rot"),
            F.shiftrightunsigned(_rotated(o), 64 - w).alias("value"),
            F.array(*[F.shiftrightunsigned(_rotated(o), s).bitwiseAND(F.lit((1 << v) - 1)) for s, v in _sub_blocks(w)]).alias("subs"),
        )
        for i, (o, w) in enumerate(BLOCKS)
    ]
    first = classes.select("fp", "rep", F.explode(F.array(*options)).alias("x")).select("fp", "rep", "x.*")
    first = first.withColumn("g", F.xxhash64("block", "value")).withColumn("rank", gray_rank(F.col("rot"))).drop("rot")
    out = ["g", "rank", "fp", "rep"]
    hot = cut(first.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("g"))
    if hot.isEmpty():
        return first.select(out)
    cold = first.join(hot, "g", "left_anti").select(out)
    second = first.join(hot, "g", "left_semi").select("g", "rank", "fp", "rep", F.posexplode("subs").alias("sub", "v"))
    second = second.withColumn("g", F.xxhash64("g", "sub", "v"))
    sizes = second.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    second = second.join(sizes, "g", "left")
    parts = F.ceil(F.col("n") / limit).cast("int")
    part, other = F.pmod(F.xxhash64("fp"), F.col("parts")), F.col("other")
    split = (
        second.filter("n is not null")
        .withColumn("parts", parts)
        .select(*out, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .withColumn("g", F.xxhash64("g", F.least("part", other), F.greatest("part", other)))
    )
    return cold.union(second.filter("n is null").select(out)).union(split.select(out))


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by group and Gray rank.

    ``levels[0]`` has the fingerprints themselves; ``levels[-1]`` has one node for each group. A level is
    (pattern, own bits, first child, end child, last leaf).
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        n = len(fps)
        at = np.arange(n)
        full = np.full(n, ~np.uint64(0))
        self.levels = [[fps, full, at, at + 1, at]]
        group, masks = groups, [full]
        while True:
            pattern, _, _, _, last = self.levels[-1]
            change = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(change, np.diff(np.r_[change, len(group)]))
            start = np.flatnonzero(within % FANOUT == 0)
            end = np.r_[start[1:], len(group)]
            run = np.repeat(np.arange(len(start)), end - start)
            apart = np.bitwise_or.reduceat((pattern ^ pattern[start][run]) | ~masks[-1], start)
            mask = ~apart
            self.levels[-1][1] = masks[-1] & ~mask[run]  # the bits that the parent hasn't compared
            self.levels.append([pattern[start] & mask, mask, start, end, last[end - 1]])
            masks.append(mask)
            group = group[start]
            if len(start) == len(change):
                break
        self.groups = np.repeat(np.arange(len(group)), np.diff(np.r_[np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]), n]))

    def forest(self, limit: int) -> np.ndarray:
        """For each fingerprint, the place of the first one that it reaches by links within its group."""
        fps, top = self.levels[0][0], len(self.levels) - 1
        label = np.arange(len(fps))
        q = np.flatnonzero(self.levels[top][4][self.groups] > label)
        stack = [(top, q[k : k + STEP_ROWS], self.groups[q[k : k + STEP_ROWS]], np.zeros(min(STEP_ROWS, len(q) - k), np.uint8)) for k in range(0, len(q), STEP_ROWS)]
        while stack:
            level, q, node, far = stack.pop()
            pattern, bits, _, _, last = self.levels[level - 1]
            _, _, start, end, _ = self.levels[level]
            size = end[node] - start[node]
            child = np.repeat(start[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            q, far = np.repeat(q, size), np.repeat(far, size)
            near = last[child] > q  # pairs are looked at from the first of the two
            q, child, far = q[near], child[near], far[near]
            far = far + np.bitwise_count((fps[q] ^ pattern[child]) & bits[child])
            near = far <= limit
            q, child, far = q[near], child[near], far[near]
            if level == 1:
                unite(label, q, child)
            else:
                stack += [(level - 1, q[k : k + STEP_ROWS], child[k : k + STEP_ROWS], far[k : k + STEP_ROWS]) for k in range(0, len(q), STEP_ROWS)]
        return label


def _linked(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def search(g: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            label = GrayIndex(fp.view(np.uint64), g).forest(limit) if len(g) else np.zeros(0, np.int64)
            tied = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(rep[tied]), pa.array(rep[label[tied]])], ["a", "b"])

        for batch in batches:
            kept.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            rows += batch.num_rows
            if rows >= BUFFER_ROWS:
                g, fp, rep = (np.concatenate(x) for x in zip(*kept, strict=True))
                whole = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if whole:
                    yield search(g[:whole], fp[:whole], rep[:whole])
                kept, rows = [(g[whole:], fp[whole:], rep[whole:])], rows - whole
        if rows:
            yield search(*(np.concatenate(x) for x in zip(*kept, strict=True)))

    return run


def links(classes: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): links between classes ``(fp, rep)``, enough of them to connect all that link."""
    if max_bits >= len(BLOCKS):
        raise ValueError(f"{len(BLOCKS)} blocks find links of fewer than {len(BLOCKS)} bits")
    small_batches(classes.sparkSession)
    dealt = routed(classes, limit)
    sorted_groups = dealt.repartition("g").sortWithinPartitions("g", "rank").select("g", "fp", "rep")
    return sorted_groups.mapInArrow(_linked(max_bits), "a long, b long")


def _components(documents: DataFrame, max_bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and the component of each fingerprint: (fp, component_id)."""
    prints = cut(fingerprints(documents))
    classes = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")))
    component = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), max_bits, limit))
    tied = classes.join(component, classes["fp"] == component["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    least = tied.groupBy("c").agg(F.min("first").alias("component_id"))
    return prints, tied.join(least, "c").select("fp", "component_id")


def near_duplicates(documents: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of ``documents``: doc_id, fingerprint (16 hex digits), component_id."""
    prints, named = _components(documents, max_bits, limit)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    found = prints.join(named, "fp", "left")
    return found.select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def rejected(documents: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, h): doc_id and hash of the text of the rows that aren't of the smallest doc_id in their component."""
    prints, component = _components(documents, max_bits, limit)
    dropped = prints.join(component, "fp").filter("doc_id != component_id")
    return cut(dropped.select(F.col("doc_id").alias("id"), F.col("hash").alias("h")).distinct())


def keep_one(documents: DataFrame, max_bits: int = MAX_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """The rows of ``documents`` of the smallest doc_id in each component, with all their columns.

    Rows are told apart by doc_id and hash of the text, so a doc_id that repeats with another text loses only the
    rows that are near copies.
    """
    return left_out(documents, rejected(documents, max_bits, limit))

"""Documents of similar shingle sets, found by PartEnum signatures.

1. A document is the set of its distinct word shingles, as 64-bit hashes. Documents of equal sets are one class, so
   copies cost no more than one row of counting.
2. Sizes fall into bands, each as wide as the similarity allows: similar sets lie in one band or in two that meet,
   and every set works in its own band and the next. In a band the bound on similarity bounds how many elements two
   sets may differ in. The domain of elements is dealt to so many partitions that one of them holds one difference at
   most, and each partition to three parts: of these, two hold none. A signature is a set's projection on two of
   the parts, so similar sets share one. Three ways to choose the two parts, for every partition, are enumerated. (For
   similarities below 0.9, which ask for more partitions, there are two parts, and a signature is a projection on one.
   Some of these are empty, which all sets with nothing in that part would share. So there are some partitions more, and similar
   sets share several projections, more than most sets have empty ones; only a set with as many empty ones signs those as well.)
3. A map task ties the classes that it sees under one signature to the first of them and sends only that one on;
   the shuffle ties these together. So a signature that very many classes share reaches a task as a few rows.
4. Ties are checked: for each class its most frequent tie, then within signatures whose classes are still apart the
   ties to their best connected class. Classes that get connected leave nothing more to find.
5. Signatures whose classes are apart after that are searched completely. Few classes give pairs. Many are dealt in
   parts to cells of bounded size; a cell says which of its classes may link, and of these gives a spanning forest.

A check begins with parity sketches, half a byte to one for each element: bits of two sets never differ in more places than
the sets do. What passes is decided by counting common elements. Sets are made again from the texts, for classes that need
them only: a bit map of one megabyte, whatever the input, tells the scan which documents to look at.

Defined cases: null and empty texts and such of spaces only have an empty set and link with nothing; fewer words than a
shingle are one shingle; rows with a null doc_id have a size, but no component; repeated rows share a component, and a
doc_id that repeats with another text has one for each; extra columns are left alone; an empty table gives no rows. A hash of
64 bits stands for a shingle, of 128 bits for equality of shingles and of sets; should two sets share a class key of 64 bits, another seed is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import left_out, release, small_batches, written
from .components import connected_components

WIDTH, PERCENT = 3, 90
#: Signature rows that a map task ties at once.
BUFFER_ROWS = 1 << 20
#: Groups of so many classes are searched as pairs, larger ones in cells of so many classes and elements a part.
PAIR_GROUP, CELL_CLASSES, CELL_ELEMENTS = 8, 1000, 2 << 20
#: Bits of the map of documents whose sets are wanted.
MAP_BITS = 1 << 23
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int = WIDTH, seed: int = 0) -> tuple[int, np.ndarray]:
    """The number of distinct shingles of a UTF-8 text, and their hashes, ascending."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and white space 20 and 09-0D only
    if not words:
        return 0, np.zeros(0, np.uint64)
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first = (end - size)[: max(1, len(words) - width + 1)].tolist()
    last = end[min(width, len(words)) - 1 :].tolist()
    digests = b"".join(xxhash.xxh3_128_digest(joined[a:b], seed) for a, b in zip(first, last, strict=True))
    both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    order = np.argsort(both[:, 0])
    key, other = both[order, 0], both[order, 1]
    again = key[1:] == key[:-1]
    hashes = key[np.r_[True, ~again]]
    if (again & (other[1:] != other[:-1])).any():
        return len(set(map(tuple, both.tolist()))), hashes
    return len(hashes), hashes


def _partitions(differences: int, percent: int, size: int) -> int:
    """So many partitions that one holds one difference at most; of two parts so many that sets of some ``size`` share more than are empty."""
    least = (differences + 2) // 2
    if parts_of(percent) > 2:
        return least
    for k in range(least, 2 * least):
        empty = 2 * k * math.exp(-size * percent / 100 / (2 * k))
        if 2 * k - differences > empty + 1.5 * math.sqrt(empty):
            return k
    return least


def sure_projections(percent: int, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many projections on one of two parts similar sets share at least, in each band."""
    top = starts * 100 // percent
    return 2 * counts - 2 * top * (100 - percent) // (100 + percent)


def size_bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size, partitions) of each band up to that of ``largest`` and one more; 0 partitions: only equal sets are similar."""
    starts, counts = [1], []
    while len(counts) < 2 or starts[-3] <= largest:
        top = starts[-1] * 100 // percent
        differences = 2 * top * (100 - percent) // (100 + percent)
        counts.append(_partitions(differences, percent, starts[-1]) if differences else 0)
        starts.append(top + 1)
    return np.array(starts[:-1], np.int64), np.array(counts, np.int64)


def parts_of(percent: int) -> int:
    return 3 if percent >= 90 else 2


def signatures(sizes: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets."""
    starts, counts = size_bands(percent, int(sizes.max(initial=1)))
    parts, sure = parts_of(percent), sure_projections(percent, starts, counts)
    own = np.searchsorted(starts, sizes, "right") - 1
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place, value = _mixed(x + _A), _mixed(x ^ _C)
    out: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    for band in (own, own + 1):
        many = counts[band]
        offset = np.cumsum(many) - many
        used = many[row] > 0
        r = row[used]
        part = place[used] % (many[r].astype(np.uint64) * np.uint64(parts))
        cell = offset[r] * parts + part.astype(np.int64)
        n = int(many.sum()) * parts
        half = [np.bincount(cell, v.astype(np.float64), n).astype(np.uint64) for v in (value[used] & np.uint64(0xFFFFFFFF), value[used] >> np.uint64(32))]
        sums = (half[0] + (half[1] << np.uint64(32))).reshape(-1, parts)
        of = np.repeat(np.arange(len(many)), many)
        partition = (np.arange(len(of)) - offset[of]).astype(np.uint64)
        whole = sums.sum(axis=1, dtype=np.uint64)
        full = np.bincount(cell, minlength=n).reshape(-1, parts) > 0
        if parts == 2:  # the projection without part j is that on the other one
            empty = np.bincount(of, (~full).sum(axis=1), len(many))
            full = full | (empty >= sure[band])[of, None]
        for j in range(parts):
            signs = full[:, 1 - j] if parts == 2 else np.ones(len(of), bool)
            name = _mixed((band[of].astype(np.uint64) << np.uint64(40)) + partition * np.uint64(parts) + np.uint64(j) + _A)
            out.append(_mixed((whole - sums[:, j]) ^ name)[signs])
            rows.append(of[signs])
    return np.concatenate(out), np.concatenate(rows)


def _class_key(n: int, hashes: np.ndarray) -> tuple[int | None, int | None]:
    import xxhash

    if not n:
        return None, None
    key = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
    return int(key[0]), int(key[1])


ROW = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("other", pa.int64()), ("hash", pa.int64()), ("sketch", pa.binary())])
_SIGNED = "sig long, a long, b long, row struct<doc_id: long, n: long, other: long, hash: long, sketch: binary>"
_NAMES = ["sig", "a", "b", "row"]


def parity_sketch(hashes: np.ndarray) -> bytes:
    """Bits that say whether an odd number of a set's elements fell there; four to eight bits for each element."""
    bits = max(64, 1 << (4 * len(hashes) - 1).bit_length())
    odd = np.bincount((_mixed(hashes ^ _A) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer words: places that become one are added."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def may_link(n: int, m: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """False only for sets of sizes n and m that sizes or sketches prove dissimilar."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    words = min(len(a), len(b))
    apart = int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum())
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sig, key) as they come and, for each, whether it is the first of its signature, and the first one's key.

    Rows keep their order, as those of one class side by side compress well.
    """
    order = np.lexsort((key, sig))
    ordered, keys = sig[order], key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    first, pivot = np.empty(len(sig), bool), np.empty(len(sig), np.int64)
    first[order], pivot[order] = new, keys[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return sig, key, first, pivot


def _signed(width: int, seed: int, percent: int):
    """A row for each document, and signature rows: (sig, class, class that it is tied to or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            sig, key, first, pivot = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), pa.array(pivot, mask=first), pa.nulls(len(sig), ROW)], _NAMES)

        for b in batches:
            sizes, sets, keys, rows, classes = [], [], [], [], []
            ids, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            for doc_id, text, h in zip(ids, b.column(1).to_pylist(), hashes, strict=True):
                n, s = shingle_set(text, width, seed)
                key, other = _class_key(n, s)
                new = n > 0 and doc_id is not None and key not in seen
                rows.append({"doc_id": doc_id, "n": n, "other": other, "hash": h, "sketch": parity_sketch(s) if new else None})
                classes.append(key)
                if new:
                    seen.add(key)
                    sizes.append(n), sets.append(s), keys.append(key)
            nothing = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, pa.array(classes, pa.int64()), nothing, pa.array(rows, ROW)], _NAMES)
            if keys:
                sig, row = signatures(np.array(sizes, np.int64), sets, percent)
                order = np.argsort(row, kind="stable")
                held.append((sig.view(np.int64)[order], np.array(keys, np.int64)[row[order]]))
            if sum(len(s) for s, _ in held) >= BUFFER_ROWS:
                yield flush()
        if any(len(s) for s, _ in held):
            yield flush()

    return run


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature: documents and ties as they are, and the others tied to the first one of their signature."""
    last: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        document = batch.column(0).is_null()
        yield batch.filter(document)
        b = batch.filter(pc.invert(document))
        tie = b.column(2).is_valid().to_numpy(zero_copy_only=False)
        sig, a = b.column(0).to_numpy(), b.column(1).to_numpy()
        pivot = b.column(2).fill_null(0).to_numpy()
        one, two = np.r_[last[0], sig[~tie]], np.r_[last[1], a[~tie]]
        if len(one):
            first = np.r_[True, one[1:] != one[:-1]]
            head = two[np.flatnonzero(first)[np.cumsum(first) - 1]]
            last = one[-1:], head[-1:]
            more = ~first & (two != head)
            sig, a, pivot = np.r_[sig[tie], one[more]], np.r_[a[tie], two[more]], np.r_[pivot[tie], head[more]]
        yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.array(pivot), pa.nulls(len(sig), ROW)], _NAMES)


def _sets(width: int, seed: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            place = b.column(2).to_numpy()
            for i in np.flatnonzero(bits[place >> 3] >> (place & 7) & 1).tolist():
                n, s = shingle_set(b.column(1)[i].as_py(), width, seed)
                key = _class_key(n, s)[0]
                if n and key not in seen:
                    seen.add(key)
                    rows.append((key, n, s.tobytes()))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "set"])

    return run


class Classes:
    """The classes of a corpus: their sizes and sketches, and their sets on demand."""

    def __init__(self, documents: DataFrame, known: DataFrame, width: int, seed: int, percent: int):
        self.documents, self.known, self.width, self.seed, self.percent = documents, known, width, seed, percent

    def sets(self, keys: DataFrame) -> DataFrame:
        """(key, n, set) of the classes in ``keys(key)``."""
        wanted = written(keys.select("key").distinct().join(self.known.select("key", "first"), "key"))
        place = F.pmod(F.xxhash64(F.col("first")), F.lit(MAP_BITS))
        bits = np.zeros(MAP_BITS // 8, np.uint8)
        maps = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        for r in maps.collect():  # at most 256 maps of 4 KB
            part = np.frombuffer(r.m, np.uint8)
            bits[(r.b - 1) * len(part) : r.b * len(part)] = part
        docs = self.documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("p"))
        found = docs.mapInArrow(_sets(self.width, self.seed, bits), "key long, n long, set binary")
        return written(found.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("set").alias("set")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are similar."""
        rows = pairs
        for side in ("a", "b"):
            rows = rows.join(self.known.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
        near = written(rows.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(_filtered(_may_link, self.percent), "a long, b long"))
        if near.isEmpty():
            return near
        sets = self.sets(near.select(F.col("a").alias("key")).union(near.select("b")))
        rows = near
        for side in ("a", "b"):
            rows = rows.join(sets.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col("set").alias(f"s_{side}")), side)
        return written(rows.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(_filtered(_similar, self.percent), "a long, b long"))


def _may_link(n: int, m: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return may_link(n, m, a, b, percent)


def _similar(n: int, m: int, a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    return similar(n, m, common(a, b), percent)


def _filtered(test, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_pylist(), b.column(4).to_pylist()
            words = zip(b.column(3), b.column(5), strict=True)
            good = [test(n[i], m[i], *(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent) for i, pair in enumerate(words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two ascending sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def similar(n: int, m: int, shared: int, percent: int) -> bool:
    return 100 * shared >= percent * (n + m - shared)


def near_in_cell(comp: np.ndarray, part: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places) of the classes of a cell that may link, of different components; of two parts only those across."""
    words = min(map(len, sketches))
    bits = np.stack([folded(s, words) for s in sketches])
    across = part.min() != part.max()
    for i in range(len(n) - 1):
        others = np.arange(i + 1, len(n))
        others = others[(comp[others] != comp[i]) & ((part[others] != part[i]) | (not across))]
        others = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
        if len(others):
            apart = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            others = others[apart * (100 + percent) <= (n[others] + n[i]) * (100 - percent)]
        if len(others):
            yield i, others


def cell_links(key: np.ndarray, comp: np.ndarray, part: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all components of the cell that links join."""
    label = {c: c for c in comp.tolist()}

    def top(c: int) -> int:
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    found = []
    for i, others in near_in_cell(comp, part, n, sketches, percent):
        for j in others.tolist():
            a, b = top(int(comp[i])), top(int(comp[j]))
            if a != b and similar(int(n[i]), int(n[j]), common(sets[i], sets[j]), percent):
                label[a] = b
                found.append((int(key[i]), int(key[j])))
    return found


def _cells(percent: int, with_sets: bool):
    """Of rows sorted by cell: the classes that may link there, as (class, cell); or, with their sets, links."""

    def search(t: pa.Table) -> pa.RecordBatch:
        key, comp, part, n = (t[c].to_numpy() for c in ("key", "comp", "part", "n"))
        words = lambda c: [np.frombuffer(x.as_buffer(), np.uint64) for x in t[c]]
        if with_sets:
            rows = cell_links(key, comp, part, n, words("sketch"), words("set"), percent)
        else:
            near = {k for i, others in near_in_cell(comp, part, n, words("sketch"), percent) for k in (i, *others.tolist())}
            cell = t["cell"][0].as_py()
            rows = [(int(key[k]), cell) for k in near]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch["cell"].to_numpy()
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist()
            for lo, hi in zip(starts, [*starts[1:], len(cell)], strict=True):
                if held and held[0]["cell"][0].as_py() != cell[lo]:
                    yield search(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with the component of their class ``key``; a class that links to nothing is its own."""
    found = connected_components(links).withColumnRenamed("node", "key")
    return rows.join(found, "key", "left").withColumn("component", F.coalesce("component", "key"))


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, key, component) of the signatures whose classes lie in several components."""
    rows = written(_named(members, links))
    apart = rows.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("classes")).filter("x != y")
    return written(rows.join(apart.select("sig", "classes"), "sig"))


def all_links(open_rows: DataFrame, classes: Classes) -> DataFrame:
    """Links that join all components that similar classes of one signature in ``open_rows`` join."""
    few = open_rows.filter(F.col("classes") <= PAIR_GROUP)
    left, right = (few.select("sig", F.col("key").alias(side), F.col("component").alias(f"c_{side}")) for side in ("a", "b"))
    pairs = left.join(right, "sig").filter("a < b and c_a != c_b").select("a", "b").distinct()
    links = classes.verified(pairs)
    many = open_rows.filter(F.col("classes") > PAIR_GROUP).join(classes.known.select("key", "n"), "key")
    if many.isEmpty():
        return links
    parts = many.groupBy("sig").agg(F.greatest(F.ceil(F.count("*") / CELL_CLASSES), F.ceil(F.sum("n") / CELL_ELEMENTS)).cast("int").alias("parts"))
    part, other = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.col("other")
    dealt = many.join(parts, "sig").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("cell", F.xxhash64("sig", F.least("part", other), F.greatest("part", other))).select("key", F.col("component").alias("comp"), "part", "cell")

    def searched(rows: DataFrame, columns: list[str]) -> DataFrame:
        sorted_rows = rows.repartition("cell").sortWithinPartitions("cell").select("cell", "key", "comp", "part", "n", *columns)
        return written(sorted_rows.mapInArrow(_cells(classes.percent, "set" in columns), "a long, b long"))

    filled = dealt.join(classes.known.select("key", "n", "sketch"), "key")
    near = searched(filled, ["sketch"]).select(F.col("a").alias("key"), F.col("b").alias("cell"))
    release(open_rows.sparkSession)
    sets = classes.sets(near.select("key").distinct()).select("key", "set")
    return links.union(searched(filled.join(near, ["key", "cell"]).join(sets, "key"), ["sketch", "set"]))  # sets go to the cells that may link them


def similarity_links(documents: DataFrame, width: int, percent: int, without: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Classes]:
    """Every row's class (doc_id, n, key, hash); links (a, b) between classes, enough to connect all that are similar; the classes.

    Rows that ``without(id, h)`` names, by doc_id and hash of the text, are read, but neither given nor compared: so what
    an earlier step rejects needn't be taken out of the documents first.
    """
    small_batches(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("hash"))
    home = F.when(F.col("sig").isNull(), F.xxhash64("row.doc_id", "row.hash")).when(F.col("b").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "a"))
    seed = 0
    while True:
        signed = docs.mapInArrow(_signed(width, seed, percent), _SIGNED)
        both = written(signed.repartition(home).sortWithinPartitions("sig").mapInArrow(_tied, _SIGNED))
        release(documents.sparkSession)
        rows = both.filter("row is not null").select("row.*", F.col("a").alias("key"))
        there = F.lit(True)
        if without is not None:
            named = without.select(F.col("id").alias("doc_id"), F.col("h").alias("hash"), F.lit(True).alias("out")).distinct()
            rows, there = rows.join(named, ["doc_id", "hash"], "left"), F.col("out").isNull()
        known = rows.filter("key is not null and doc_id is not null").groupBy("key")  # a class's sketch may be with a row that is out
        known = known.agg(F.min(F.when(there, F.col("doc_id"))).alias("first"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.min("other").alias("x"), F.max("other").alias("y"))
        known = written(known.filter("first is not null"))
        if known.filter("x != y").isEmpty():
            break
        seed += 1
    classes = Classes(docs.filter("doc_id is not null"), known, width, seed, percent)
    ties = both.filter("sig is not null").select("sig", "a", "b")
    members = ties.select("sig", F.col("a").alias("key")).union(ties.select("sig", "b")).distinct()
    members = written(members if without is None else members.join(known.select("key"), "key", "left_semi").select("sig", "key"))
    best = ties.groupBy("a", "b").agg(F.count("*").alias("times")).groupBy("a").agg(F.max(F.struct("times", "b")).alias("x")).select("a", "x.b")
    links = classes.verified(best)
    apart = _open(members, links)
    release(documents.sparkSession)
    if not apart.isEmpty():
        degree = members.groupBy("key").agg(F.count("*").alias("degree"))
        pivots = apart.join(degree, "key").groupBy("sig").agg(F.max(F.struct("degree", "key", "component")).alias("p"))
        pairs = apart.join(pivots, "sig").filter("component != p.component").select(F.col("key").alias("a"), F.col("p.key").alias("b")).distinct()
        links = written(links.union(classes.verified(pairs)))
        apart = _open(apart.select("sig", "key"), links)
        release(documents.sparkSession)
        if not apart.isEmpty():
            links = written(links.union(all_links(apart, classes)))
    return rows.filter(there).select("doc_id", "n", "key", "hash"), links, classes


def _components(documents: DataFrame, width: int, percent: int, without: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, hash, component_id) of every row, but those that ``without`` names."""
    rows, links, classes = similarity_links(documents, width, percent, without)
    tied = written(_named(classes.known.select("key", "first"), links))
    least = tied.groupBy("component").agg(F.min("first").alias("component_id"))
    found = tied.join(least, "component").select("key", "component_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.join(found, "key", "left").select("doc_id", "n", "hash", component.alias("component_id"))


def similar_documents(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id."""
    return _components(documents, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def rejected(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, without: DataFrame | None = None) -> DataFrame:
    """(id, h): doc_id and hash of the text of the rows that aren't of the smallest doc_id in their component.

    Rows that ``without(id, h)`` names belong to no component.
    """
    found = _components(documents, width, percent, without).filter("doc_id != component_id")
    return written(found.select(F.col("doc_id").alias("id"), F.col("hash").alias("h")).distinct())


def keep_one(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``documents`` of the smallest doc_id in each component, with all their columns."""
    return left_out(documents, rejected(documents, width, percent))

"""Spelling variants of the words of a corpus, by rolling-hash deletion keys.

1. Words are counted over all texts, with partial sums before the shuffle, and numbered in order of preference:
   more occurrences first, then code-point order. So of two words the better form is the one of the smaller id.
2. Every word gets integer keys, computed for a whole batch at once: with prefix sums of a polynomial hash, the
   hash of the word without its i-th code point is the prefix before i plus the suffix after i moved one place.
   A key of the deletion and its place is shared by words that differ at that place only; a key of the deletion
   alone is shared by a word that is one code point shorter.
3. Keys are dealt to partitions by their top bits and sorted there; places where keys repeat are kept, with ids only.
4. What keys say is verified on strings: the kept rows are grouped by the very strings that the keys stand for.
   A group is bounded by its alphabet: for a place, 90 words at most, for a shorter word, 90 for each gap.
5. Groups give counts and the best neighbour of each member, not pairs; forms are followed by pointer doubling.

Defined cases: null and empty texts have no words; a null doc_id takes no deletion, as its check sum is null; repeated
rows count as often as they occur; a run of any length is one word, and only its keys, not copies of it, are dealt;
ties go to the smaller word in code-point order; extra columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, small_batches, written

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: One run in so many loses a code point.
MISSPELT = 199
#: Top bits of a key that name its partition.
RADIX_BITS = 12
_BASE, _MIX, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
AT_PLACE, SHORTER, ITSELF = 0, 1, 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _BASE
    return x ^ (x >> np.uint64(31))


def occurrences(documents: DataFrame) -> DataFrame:
    """(word): a row for each run of letters, lower-cased, some without one code point as the rule says."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    runs = F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}+"), F.lit(0))
    rows = documents.select(F.col("doc_id").cast("string").alias("d"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % MISSPELT == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(id, word, n): words that are long and frequent enough; ids ascend by n descending, then by word."""
    counts = occurrences(documents).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    ordered = counts.filter(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word")
    return written(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word number, place, kind) of all words: one of each place, one of each shorter word, one of the word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - (end - size)[word]
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max(initial=0)), _BASE)])
    term = _mixed(codes + np.uint64(1)) * power[place]
    upto = np.r_[np.uint64(0), np.cumsum(term)]
    start, whole = upto[(end - size)], upto[end] - upto[end - size]
    prefix = upto[:-1] - start[word]
    without = prefix + (whole[word] - prefix - term) * _BACK
    changes = np.ones(len(codes), bool)  # within a run of one letter all deletions are the same word
    changes[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    key = [_mixed(without + (place.astype(np.uint64) + np.uint64(1)) * _PLACE), _mixed(without[changes]), _mixed(whole)]
    kind = np.repeat(np.array([AT_PLACE, SHORTER, ITSELF], np.int8), [len(k) for k in key])
    return np.concatenate(key), np.r_[word, word[changes], np.arange(len(words))], np.r_[place, place[changes], np.zeros(len(words), np.int64)], kind


def _keys(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, word, place, kind = deletion_keys(b.column(1).to_pylist())
            columns = [pa.array((key >> np.uint64(64 - bits)).view(np.int64)), pa.array(b.column(0).to_numpy()[word]), pa.array(place.astype(np.int32)), pa.array(kind)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "place", "kind"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and kind: those whose key repeats for a place, or joins shorter words to the word itself."""
    held: pa.Table | None = None

    def kept(t: pa.Table) -> pa.RecordBatch:
        key, short = t["key"].to_numpy(), t["kind"].to_numpy() != AT_PLACE
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (short[1:] != short[:-1])])
        size = np.diff(np.r_[first, len(key)])
        own = np.add.reduceat((t["kind"].to_numpy() == ITSELF).astype(np.int64), first)
        good = np.where(short[first], (own > 0) & (size > own), size > 1)
        found = t.filter(pa.array(np.repeat(good, size))).select(["id", "place", "kind"]).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in found.columns], ["id", "place", "kind"])

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        key = held["key"].to_numpy()
        whole = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on
        if whole:
            yield kept(held.slice(0, whole))
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield kept(held)


def repeated_keys(words: DataFrame, bits: int = 64) -> DataFrame:
    """(id, place, kind) of the keys that more than one word has; ``bits`` shortens keys, for tests of collisions."""
    small_batches(words.sparkSession)
    keys = words.select("id", "word").mapInArrow(_keys(bits), "key long, id long, place int, kind byte")
    top = F.shiftrightunsigned("key", max(0, bits - RADIX_BITS))
    return keys.repartition(top).sortWithinPartitions("key", "kind").mapInArrow(_repeated, "id long, place int, kind byte")


def neighbours(words: DataFrame, bits: int = 64) -> DataFrame:
    """(id, n_near, best): how many words are one edit away, and the best of them, for words that have any."""
    rows = repeated_keys(words, bits).join(words.select("id", "word"), "id")
    before, after = F.substring(F.col("word"), F.lit(1), F.col("place")), F.substring(F.col("word"), F.col("place") + 2, F.length("word"))
    gap = F.when(F.col("kind") == AT_PLACE, F.lit("\0")).otherwise(F.lit(""))
    rest = F.when(F.col("kind") == ITSELF, F.col("word")).otherwise(F.concat(before, gap, after))
    rows = rows.select("id", (F.col("kind") == ITSELF).alias("own"), (F.col("kind") == AT_PLACE).alias("at_place"), rest.alias("rest"))
    ids = lambda own: F.sort_array(F.collect_set(F.when(F.col("own") == own, F.col("id"))))
    groups = written(rows.groupBy("at_place", "rest").agg(ids(False).alias("ids"), ids(True).alias("own")).filter("size(ids) + size(own) > 1").drop("rest"))
    changed = groups.filter("at_place and size(ids) > 1").select("ids", F.explode("ids").alias("id"))
    changed = changed.select("id", (F.size("ids") - 1).alias("k"), F.when(F.col("id") == F.col("ids")[0], F.col("ids")[1]).otherwise(F.col("ids")[0]).alias("best"))
    shorter = groups.filter("not at_place and size(own) > 0 and size(ids) > 0").select("ids", F.col("own")[0].alias("own"))
    found = changed.union(shorter.select("own", F.size("ids"), F.col("ids")[0])).union(shorter.select(F.explode("ids"), F.lit(1), "own"))
    return found.groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) of ``forms(id, form)``: the last of the forms that follow from a word. Forms have smaller ids, so no ring arises."""
    ends = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        further = cut(ends.join(ends.select(F.col("id").alias("root"), F.col("root").alias("next")), "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.filter("moved").isEmpty():
            return further.select("id", "root")
        ends = further.select("id", "root")


def spelling_variants(documents: DataFrame, bits: int = 64) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = vocabulary(documents)
    near = cut(neighbours(words, bits))
    other = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = cut(words.join(near, "id", "left").join(other, "best", "left"))
    taken = F.coalesce(F.col("form_n") >= FACTOR * F.col("n"), F.lit(False))
    last = roots(rows.filter(taken).select("id", F.col("best").alias("form"))).join(words.select(F.col("id").alias("root"), F.col("word").alias("last")), "root").select("id", "last")
    return rows.join(last, "id", "left").select(
        "word",
        F.when(taken, F.col("form")).alias("form"),
        F.coalesce("last", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("form_n")).alias("form_n"),
    )

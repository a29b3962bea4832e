"""Benchmark passages in training documents, by spaced seeds (native: DataFrame functions only).

A seed is a fixed mask over a few consecutive words: 1 is a word that counts, 0 one that is ignored. The words
that count are hashed at every place of every benchmark item and of every document; equal hashes are hits. Hits
are verified: the document holds the item's passage if at least ``SIMILARITY`` of ``REGION`` consecutive words of
the item are equal to the words beside them. Where fewer words lie side by side (a shorter item, or a document
that begins or ends within it), all of those count, ``SPAN`` at least or the whole item.

The masks are chosen so that none of these regions is missed: for every length of a region and every placement of
as many substituted words as ``SIMILARITY`` allows, one of the masks has a place where it ignores all of them.
The tests go through all placements. So recall is 1 at the stated similarity, for items of every length.

Hits side by side on one diagonal are verified once, from the first: a region that begins there is at least as
good as one that begins at a later hit of the same run, whose words up to there are equal. An item's places of a hash
are grouped by the hash before them, and the group that agrees with the document's own hash before is passed
over as a whole. So words that a document repeats over and over cost one comparison for each diagonal, not one
for each pair of places.

What is not found: a fragment from the inside of an item of over 24 words with fewer than 20 equal words of
any 24, such as 12 to 19 words in the middle of a document. An item of one to four words is sought as it is.

The benchmark's hashes are broadcast only if its words are counted to be few (``BROADCAST_WORDS``); then a
document never moves. A larger benchmark is joined by shuffling hashes, and documents with hits are read
again to be compared.

Defined cases: words are runs of letters and digits, lower-cased; null texts have none and hold nothing; a
null doc_id is reported like any other; repeated rows are one document; items of equal words are each
reported; extra columns are left alone; an empty side gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of the least stretch and of a region, and the similarity.
SPAN, REGION, SIMILARITY = 12, 24, 0.8
# The masks for items of ``SPAN`` words and more, and those for shorter ones by their length.
LONG = ("111101", "1100111")
SHORT = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("111", "1011"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("110111", "11111"),
    9: ("110111",),
    10: ("110111", "11001011", "11111"),
    11: ("1101011", "1100111"),
}
#: Words of a benchmark whose hashes are broadcast (some 50 bytes for each word and mask).
BROADCAST_WORDS = 500_000
KEY = ["doc_id", "text_hash", "size"]


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of ``n`` words."""
    return LONG if n >= SPAN else SHORT[n]


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_at(words: str, place: Column, mask: str) -> Column:
    """The hash of the words that a mask counts at a place, null where it doesn't fit."""
    at = [F.get(F.col(words), place + o) for o, c in enumerate(mask) if c == "1"]
    return F.when((place >= 0) & (place + len(mask) <= F.size(words)), F.xxhash64(F.lit(mask), *at))


def _seed_of(words: str, place: Column, masks: list[str]) -> Column:
    """``seed_at`` for the mask whose number is in the column ``m``."""
    return F.coalesce(*[F.when(F.col("m") == m, seed_at(words, place, mask)) for m, mask in enumerate(masks)])


def seeds(rows: DataFrame, words: str, keep: list[str], masks: list[str], place: str) -> DataFrame:
    """``keep`` columns, a place, a mask and the hash ``key`` for every place and mask that fits there."""
    many = len(masks)
    least = min(map(len, masks))
    turns = F.when(F.size(words) >= least, F.sequence(F.lit(0), (F.size(words) - least + 1) * many - 1))
    spread = rows.select(*keep, words, F.explode(turns).alias("x"))
    placed = spread.select(*keep, words, F.floor(F.col("x") / many).cast("int").alias(place), (F.col("x") % many).alias("m"))
    return placed.withColumn("key", _seed_of(words, F.col(place), masks)).filter("key is not null")


def _settled(rows: DataFrame, keep: list[Column | str], **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, computed here and once: no later filter is moved below, to where whole documents pass."""
    made = rows.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("made"))
    return made.select(*[c for c in made.columns if c != "made"], "made.*")


def _compared(hits: DataFrame, similarity: float) -> DataFrame:
    """The best region around each hit, where it agrees; ``hs`` and ``bs`` are the words that lie side by side, the hit begins ``at``."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    equal = lambda a, b: F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    first = F.greatest(F.lit(0), F.col("at") + 1 - REGION)  # of the words that a region with the hit can have
    most = F.least(F.size("bs"), F.col("at") + REGION) - first
    keep, sides = [*KEY, "item", "offset"], ["bs", "hs"]
    around = {c: F.slice(c, first + 1, most) for c in sides}
    rows = _settled(hits, [*keep, *sides], near=equal(*around.values()), region=F.least(F.lit(REGION), F.size("bs")), last=F.col("at") - first)
    need = F.ceil(F.lit(similarity) * F.col("region") - 1e-9)
    rows = rows.filter(total(F.col("near")) >= need)  # few hits get past this
    at = lambda a: total(F.slice("near", a, F.col("region")))
    latest = F.least(F.col("last"), F.size("near") - F.col("region")) + 1  # the region that begins with the hit, or the last
    most = F.array_max(F.transform(F.sequence(F.lit(1), latest), at))
    agree = F.when(at(latest) == F.col("region"), F.col("region")).otherwise(most)
    rows = _settled(rows, [*keep, *sides, "region"], agree=agree).filter(F.col("agree") >= need)
    rows = rows.withColumn("overlap", F.size("bs")).withColumn("equal_words", total(equal("hs", "bs")))
    return rows.select(*keep, (F.col("agree") / F.col("region")).alias("similarity"), "overlap", "equal_words")


def mask_groups(lengths: list[int]) -> list[dict[str, list[int]]]:
    """Few masks at a time, each with the lengths of items that it serves, so that generated code stays small."""
    served: dict[str, list[int]] = {m: [SPAN] for m in LONG if SPAN in lengths}
    for n in sorted(set(lengths) - {SPAN}):
        for m in masks_of(n):
            served.setdefault(m, []).append(n)
    masks = list(served)
    return [{m: served[m] for m in masks[k : k + 2]} for k in range(0, len(masks), 2)] or [dict.fromkeys(LONG, [])]


def _hits(docs: DataFrame, texts: DataFrame, some: dict[str, list[int]], small: bool) -> DataFrame:
    """Where a seed of an item is also in a document: (doc_id, text_hash, size, p, item, g), and h if items are few.

    Hits that follow another hit of the same mask on their diagonal are left out.
    """
    masks, length = list(some), F.least(F.size("b"), F.lit(SPAN))
    served = F.coalesce(*[F.when(F.col("m") == m, length.isin(some[mask])) for m, mask in enumerate(masks)])
    places = seeds(texts, "b", ["item"], masks, "g").filter(served)
    # the places of a hash in an item, by the hash before it; an item is short, so are these lists
    places = places.groupBy("key", "item", _seed_of("b", F.col("g") - 1, masks).alias("before")).agg(F.collect_list("g").alias("gs"))
    keys = places.groupBy("key", "item").agg(F.collect_list(F.struct("before", "gs")).alias("groups"))
    rows, before = seeds(docs, "h", KEY, masks, "p"), _seed_of("h", F.col("p") - 1, masks)
    if small:
        rows, keep = rows.join(F.broadcast(keys), "key"), [*KEY, "h", "p", "item"]
    else:
        rows, keep, before = rows.withColumn("mine", before).drop("h").join(keys, "key"), [*KEY, "p", "item"], F.col("mine")
    groups = rows.select(*keep, "m", *([] if small else ["mine"]), F.explode("groups").alias("x"))
    new = groups.filter(~F.coalesce(before == F.col("x.before"), F.lit(False)))
    return new.select(*keep, F.explode("x.gs").alias("g"))


def _beside(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The words that lie side by side where item and document are laid as a hit says; whole documents end here."""
    shift = F.col("p") - F.col("g")
    lo, hi = F.greatest(F.lit(0), -shift), F.least(F.size("b"), F.size("h") - shift)
    enough = hits.join(texts, "item").filter(hi - lo >= F.least(F.size("b"), F.lit(SPAN)))
    keep = [*KEY, "item", (F.col("g") - lo).alias("at"), shift.alias("offset")]
    return _settled(enough, keep, bs=F.slice("b", lo + 1, hi - lo), hs=F.slice("h", lo + shift + 1, hi - lo))


def passages(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document and item whose passage it holds.

    Columns: doc_id, text_hash, size, item_id, offset (the item's first word in the document), similarity (best
    of its regions), overlap (words of both that lie side by side), equal_words (those of them that are equal).
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the masks miss nothing from a similarity of {SIMILARITY} on")
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("b")).filter(F.size("b") > 0).distinct()
    texts = items.select("b", F.xxhash64("b").alias("item")).distinct()
    total = texts.agg(F.sum(F.size("b"))).first()[0] or 0
    lengths = [r[0] for r in texts.select(F.least(F.size("b"), F.lit(SPAN)).alias("n")).distinct().collect()]  # at most SPAN rows
    small = total <= broadcast_words
    held = F.broadcast if small else lambda df: df
    text = F.coalesce("text", F.lit(""))
    docs = _settled(documents, ["doc_id", F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("size")], h=word_hashes(F.col("text")))
    hits = [_hits(docs, texts, some, small) for some in mask_groups(lengths)]
    if not small:
        found = reduce(DataFrame.unionByName, hits).select(*[F.col(c).alias(f"p_{c}") for c in KEY], "p", "item", "g").distinct()
        same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in KEY]
        hits = [docs.distinct().join(found, same).select(*KEY, "h", "p", "item", "g")]
    found = _compared(reduce(DataFrame.unionByName, [_beside(x, held(texts)) for x in hits]), similarity)
    best = found.groupBy(*KEY, "item").agg(F.max_by(F.struct("offset", "overlap", "equal_words"), F.struct("similarity", "equal_words", -F.col("offset"))).alias("x"), F.max("similarity").alias("similarity"))
    named = items.select("item_id", F.xxhash64("b").alias("item"))
    return best.join(held(named), "item").select(*KEY, "item_id", "x.offset", "similarity", "x.overlap", "x.equal_words")


def contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and benchmark item that it holds a passage of."""
    return passages(documents, benchmark, similarity).groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.max("equal_words").alias("equal_words"), F.max("overlap").alias("overlap_words")
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``documents`` that hold no passage of the benchmark, with all their columns."""
    found = passages(documents, benchmark, similarity).select(*KEY).distinct()
    text = F.coalesce(documents["text"], F.lit(""))
    same = [documents["doc_id"].eqNullSafe(found["doc_id"]), F.xxhash64(text) == found["text_hash"], F.octet_length(text) == found["size"]]
    return documents.join(found, same, "left_anti")

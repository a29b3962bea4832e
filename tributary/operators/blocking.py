"""Candidate pairs by shared keys. All rules key on the country too.

``prepare`` computes what the rules need once per record. Equal names are an equi-join. Pairs that share tokens by one rule
are made tile by tile (``shared_pairs``). All rules together, look-ups and stored indexes go through packed postings: targets are numbered, and a token's targets are arrays of places in buckets of ``SPAN`` numbers. A
record of S1 joins arrays, not targets, so a join has a row for each token and bucket; arrays that meet are counted
by place, and every pair comes out once. A token that very many records have is dealt to a grid of sub-keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.storage import settled, written

PAIR = ["s1_id", "candidate_id"]
#: Targets of a bucket: as many places as an array may name.
SPAN = 1 << 13
#: Rows of S1, and arrays, that one key of the join may have; beyond that the key is dealt to sub-keys.
KEY_ROWS, KEY_ARRAYS = 50_000, 64
#: Ids of one array of equal records or names.
SHARE = 1_000
#: Tokens and rows that a side of a tile has, some: a task holds its targets. Names are short, so their tiles may be more and smaller.
TILE_TOKENS, TILE_ROWS, NAME_ROWS = 8_000_000, 20_000, 5_000
#: Pairs of an Arrow batch that a tile gives, some.
BATCH_PAIRS = 100_000
#: Records of each side that are compared in one task, some, where all pairs of a country are gone through.
CELL = (2_000, 4_000)
#: Pairs of a country that may be gone through for each row that a join of tokens would make.
DENSE = 64
#: Parts that the records which meet a bucket are dealt to where its places get their ids.
PARTS = 16


def times(rows: DataFrame, name: str = "copies") -> Column:
    """How many rows a row stands for: its ``copies``, where records of equal content are one row; else 1."""
    return F.col(name).cast("long") if name in rows.columns else F.lit(1).cast("long")


def prepare(records: DataFrame) -> DataFrame:
    """Records with normalised strings, token lists and the country key; ``copies`` and a key ``k`` are kept."""
    normal = records.select(
        "entity_id",
        *[t.text_of(F.col(c)).alias(c) for c in ("business_name", "business_address", "country")],
        t.normalize_name(F.col("business_name")).alias("name"),
        t.normalize_address(F.col("business_address")).alias("address"),
        t.country_key(F.col("country")).alias("country_key"),
        *[c for c in records.columns if c in ("copies", "k")],
    )
    out = normal.withColumn("name_tokens", t.name_tokens(F.col("name"))).withColumn("address_tokens", t.address_tokens(F.col("address")))
    out = out.withColumn("name_set", F.array_distinct("name_tokens")).withColumn("address_set", F.array_distinct("address_tokens"))
    return out.withColumn("number_set", t.numeric_tokens(F.col("address_set")))


def postings(prepared: DataFrame, tokens: str, id_name: str = "entity_id") -> DataFrame:
    """(country_key, token, id): one row per token in the list or set column ``tokens``."""
    return prepared.select("country_key", F.explode(tokens).alias("token"), F.col("entity_id").alias(id_name))


def block_indexes(prepared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three inverted indexes of a source, as postings: exact name, name token, address token."""
    exact = prepared.filter("name != ''").select("country_key", F.col("name").alias("token"), "entity_id")
    return exact, postings(prepared, "name_set"), postings(prepared, "address_tokens")


@dataclass
class TokenIndex:
    """The postings of a source, packed.

    ``lists`` has (country_key, token, bucket, places), a place for each time that a target has the token; ``numbers`` has
    (bucket, place, candidate_id); ``times`` has (country_key, token, candidate_id, times).
    """

    lists: DataFrame
    numbers: DataFrame
    times: DataFrame

    @staticmethod
    def of(targets: DataFrame, tokens: str, copies: bool = False) -> TokenIndex:
        """Numbers run over ranges of countries and ids, so a country's targets fill few buckets.

        With ``copies`` arrays and numbers also have how many targets each place stands for.
        """
        more = ["copies"] if copies else []
        ordered = settled(targets.select("country_key", "entity_id", F.col(tokens).alias("tokens"), *[times(targets).alias(c) for c in more])).repartitionByRange("country_key", "entity_id")
        number = F.monotonically_increasing_id()
        rows = settled(ordered.withColumn("number", number))
        bucket, place = F.shiftright("number", SPAN.bit_length() - 1).alias("bucket"), F.col("number").bitwiseAND(F.lit(SPAN - 1)).cast("short").alias("place")
        one = rows.select("country_key", F.explode("tokens").alias("token"), bucket, place, *more)
        lists = one.groupBy("country_key", "token", "bucket").agg(F.collect_list(F.struct("place", *more)).alias("x"))  # a bucket bounds the array
        lists = lists.select("country_key", "token", "bucket", F.col("x.place").alias("places"), *[F.col(f"x.{c}").alias(c) for c in more])
        asked = rows.select("country_key", F.explode("tokens").alias("token"), F.col("entity_id").alias("candidate_id")).groupBy("country_key", "token", "candidate_id").agg(F.count("*").alias("times"))
        return TokenIndex(lists, rows.select(bucket, place, F.col("entity_id").alias("candidate_id"), *more), asked)

    def sizes(self) -> DataFrame:
        """(country_key, token, size): how many postings a token has."""
        return self.lists.groupBy("country_key", "token").agg(F.sum(F.size("places")).alias("size"))

    def named(self, found: DataFrame) -> DataFrame:
        return found.join(self.numbers, ["bucket", "place"])

    def write(self, path: str, buckets: int = 64) -> None:
        """Store the postings in folders by the hash of country and token, so that a look-up reads few of them."""
        folder = _folder(buckets)
        self.lists.withColumn("folder", folder).repartition(buckets, "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/lists")
        self.numbers.write.mode("overwrite").parquet(f"{path}/numbers")
        self.times.withColumn("folder", folder).repartition(buckets, "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/times")

    @staticmethod
    def read(spark: SparkSession, path: str, probes: DataFrame | None = None, buckets: int = 64, most: int = 1000) -> TokenIndex:
        """A stored index; for ``probes`` of at most ``most`` different tokens only the folders that have them."""
        parts = [spark.read.parquet(f"{path}/{n}") for n in ("lists", "times")]
        if probes is not None:
            wanted = probes.select("country_key", "token").distinct().limit(most + 1).select(_folder(buckets).alias("f")).groupBy("f").count().collect()  # a row for each folder
            if sum(r["count"] for r in wanted) <= most:
                parts = [x.filter(F.col("folder").isin([r.f for r in wanted])) for x in parts]
        return TokenIndex(parts[0].drop("folder"), spark.read.parquet(f"{path}/numbers"), parts[1].drop("folder"))


def _folder(buckets: int):
    return F.pmod(F.xxhash64("country_key", "token"), F.lit(buckets)).cast("int")


def by_record(work: Callable[[pa.Table, np.ndarray, pa.DictionaryArray], pa.RecordBatch]):
    """A map over rows sorted by s1_id and bucket: ``work`` gets whole groups, the first row of each, and the coded ids."""

    def whole(rows: pa.Table) -> pa.RecordBatch:
        ids = rows["s1_id"].combine_chunks().dictionary_encode()
        who, bucket = ids.indices.to_numpy(), rows["bucket"].to_numpy()
        return work(rows, np.r_[True, (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])], ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            tail = pc.and_(pc.equal(rows["s1_id"], rows["s1_id"][-1]), pc.equal(rows["bucket"], rows["bucket"][-1]))
            done = rows.num_rows - pc.sum(tail).as_py()  # the last record and bucket may go on
            if done:
                yield whole(rows.slice(0, done).combine_chunks())
            held = rows.slice(done)
        if held is not None and held.num_rows:
            yield whole(held.combine_chunks())

    return run


def codes(rows: pa.Table, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group * SPAN + place, row) of every place in the rows' arrays."""
    places = rows["places"].combine_chunks()
    size = pc.list_value_length(places).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    return (np.cumsum(new) - 1)[row] * SPAN + places.flatten().to_numpy(), row


def _counted(least: int):
    def count(rows: pa.Table, new: np.ndarray, ids: pa.DictionaryArray) -> pa.RecordBatch:
        first = np.flatnonzero(new)
        code, _ = codes(rows, new)
        if 4 * len(code) > len(first) * SPAN:
            times = np.bincount(code, minlength=1)
            found = np.flatnonzero(times >= least)
            times = times[found]
        else:
            found, times = np.unique(code, return_counts=True)
            found, times = found[times >= least], times[times >= least]
        at = first[found // SPAN]
        columns = [ids.dictionary.take(pa.array(ids.indices.to_numpy()[at])), pa.array(rows["bucket"].to_numpy()[at])]
        return pa.RecordBatch.from_arrays([*columns, pa.array((found % SPAN).astype(np.int16)), pa.array(times.astype(np.int32))], ["s1_id", "bucket", "place", "shared"])

    return by_record(count)


def sub_keys(probes: DataFrame, index: TokenIndex, key_rows: int, key_arrays: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join with the sub-key (i, j) of each row: a row's part, in every column; an array's column, in every part."""
    key = ["country_key", "token"]
    more = [c for c in probes.columns if c not in (*key, "s1_id")]
    left, right = (x.groupBy(*key).agg(F.count("*").alias(n)) for x, n in ((probes, "l"), (index.lists, "r")))
    grid = left.join(right, key).filter((F.col("l") > key_rows) | (F.col("r") > key_arrays))
    grid = grid.select(*key, F.ceil(F.col("l") / key_rows).cast("int").alias("parts"), F.ceil(F.col("r") / key_arrays).cast("int").alias("columns"))
    part = lambda x, n: F.pmod(F.xxhash64(x), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    rows = probes.join(grid, key, "left").select("s1_id", *key, *more, part("s1_id", "parts").alias("i"), every("columns").alias("j"))
    packed = [c for c in index.lists.columns if c not in (*key, "bucket")]
    arrays = index.lists.join(grid, key, "left").select(*key, "bucket", *packed, part("bucket", "columns").alias("j"), every("parts").alias("i"))
    return rows, arrays


def dealt(probes: DataFrame, index: TokenIndex, key_rows: int = KEY_ROWS, key_arrays: int = KEY_ARRAYS) -> DataFrame:
    """(s1_id, bucket, places): the arrays that the tokens of ``probes(s1_id, country_key, token)`` meet, with further columns of it.

    A token of more rows than ``key_rows``, or more arrays than ``key_arrays``, is dealt to a grid, so no key of the join is
    much larger, and nothing is dropped.
    """
    rows, arrays = sub_keys(probes, index, key_rows, key_arrays)
    more = [c for c in probes.columns if c not in ("country_key", "token", "s1_id")]
    packed = [c for c in arrays.columns if c not in ("country_key", "token", "bucket", "i", "j")]
    return rows.join(arrays, ["country_key", "token", "i", "j"]).select("s1_id", "bucket", *packed, *more)


def hits(probes: DataFrame, index: TokenIndex, least: int) -> DataFrame:
    """(s1_id, bucket, place, shared) of every target that at least ``least`` of a record's tokens meet."""
    met = dealt(probes, index).repartition("s1_id", "bucket").sortWithinPartitions("s1_id", "bucket")
    return met.mapInArrow(_counted(least), "s1_id string, bucket long, place short, shared int")


def exact_name_pairs(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of equal names, none empty.

    Ids of a name are joined as arrays of some ``SHARE``, dealt, and spread last: pairs are never shuffled, and a frequent name is
    many small tasks' work. Only where ids of both sides have several names can a pair come twice.
    """
    key = ["country_key", "name"]
    left, right = (x.filter("name != ''").select(*key, F.col("entity_id").alias("id")).distinct() for x in (s1, targets))
    again = lambda side: not side.groupBy("id").count().filter("count > 1").isEmpty()

    def arrays(side: DataFrame, to: str, part: str) -> DataFrame:
        large = side.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > SHARE)
        of = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("n", F.lit(1)) / SHARE))
        return side.join(large, key, "left").groupBy(*key, of.alias(part)).agg(F.collect_list("id").alias(to))

    both = arrays(left, "a", "i").join(arrays(right, "b", "j"), key).repartition(*key, "i", "j")
    pairs = both.select(F.explode("a").alias("s1_id"), "b").select("s1_id", F.explode("b").alias("candidate_id"))
    return pairs.distinct() if again(left) and again(right) else pairs


def _coded(words: pa.Array, code: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the words of each text, and where each text's begin and end."""
    lists = pc.split_pattern(words, " ")
    coded = lists.flatten().dictionary_encode()
    of = np.fromiter(map(code, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return of[coded.indices.to_numpy()], np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]


class _Tile:
    """The targets of a tile: for each token the places of those that have it, as often as they have it."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids, self.codes, self.rows, self.n = [], [], [], 0

    def add(self, ids: pa.Array, words: pa.Array) -> None:
        code, edges = _coded(words, lambda w: self.known.setdefault(w, len(self.known)))
        self.codes.append(code.astype(np.int32))
        self.rows.append(np.repeat(np.arange(self.n, self.n + len(ids), dtype=np.int32), np.diff(edges)))
        self.ids.append(ids)
        self.n += len(ids)

    def close(self) -> None:
        codes = np.concatenate(self.codes)
        self.places = np.concatenate(self.rows)[np.argsort(codes, kind="stable")]
        self.start = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(self.known)))].tolist()
        self.ids, self.codes, self.rows = pa.concat_arrays(self.ids), [], []

    def met(self, ids: pa.Array, words: pa.Array, least: int) -> Iterator[pa.RecordBatch]:
        code, edges = _coded(words, lambda w: self.known.get(w, -1))
        who, found, times, held = [], [], [], 0
        for r in range(len(ids)):
            arrays = [self.places[self.start[x] : self.start[x + 1]] for x in code[edges[r] : edges[r + 1]].tolist() if x >= 0]
            if arrays:
                at = np.concatenate(arrays)
                if 4 * len(at) > self.n:
                    n = np.bincount(at)
                    place = np.flatnonzero(n >= least)
                    n = n[place]
                else:
                    place, n = np.unique(at, return_counts=True)
                    place, n = place[n >= least], n[n >= least]
                who.append(np.full(len(place), r))
                found.append(place)
                times.append(n)
                held += len(place)
            if held and (held >= BATCH_PAIRS or r + 1 == len(ids)):
                columns = [ids.take(pa.array(np.concatenate(who))), self.ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(times).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*PAIR, "shared"])
                who, found, times, held = [], [], [], 0


def _tiled(least: int):
    """A map over rows sorted by tile and side: a tile's targets are kept, its records of S1 pass one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, closed = None, _Tile(), False
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("country_key", "i", "j", "side")), strict=True))
            ids, words = b.column("id"), b.column("words")
            for key, rows in groupby(range(len(keys)), keys.__getitem__):
                rows = list(rows)
                part = [x.slice(rows[0], len(rows)) for x in (ids, words)]
                if key[:3] != at:
                    at, tile, closed = key[:3], _Tile(), False
                if key[3] == 0:
                    tile.add(*part)
                elif tile.n:
                    if not closed:
                        tile.close()
                        closed = True
                    yield from tile.met(*part, least)

    return run


def shared_pairs(s1: DataFrame, targets: DataFrame, mine: str, theirs: str, least: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(s1_id, candidate_id, shared): pairs of which the tokens ``mine``, at least ``least``, meet the tokens ``theirs`` as often.

    Of each country both sides are dealt to parts, and each part of one meets each of the other in a tile, so rows are sent as often
    as the other side has parts. Pairs are made and counted within their tile: they are neither shuffled nor stored, and a
    task holds ``TILE_TOKENS`` tokens of targets at most, but for a single text.
    """
    sides = []
    for x, tokens, n in ((targets, theirs, 1), (s1, mine, least)):
        stored = written(x.select("country_key", F.col("entity_id").alias("id"), F.array_join(tokens, " ").alias("words"), F.size(tokens).alias("n")))
        sides.append(stored.filter(F.col("country_key").isNotNull() & (F.col("n") >= n)))  # filtered here, tokens are computed once
    again = any(not x.groupBy("id").count().filter("count > 1").isEmpty() for x in sides)
    parts = F.ceil(F.greatest(F.sum("n") / TILE_TOKENS, F.count("*") / tile_rows)).cast("int")
    large = [x.groupBy("country_key").agg(parts.alias("parts")).filter("parts > 1") for x in sides]  # few: each has many rows

    def dealt_to_tiles(side: int) -> DataFrame:
        rows = sides[side]
        for n, k in (("own", side), ("other", 1 - side)):
            rows = rows.join(F.broadcast(large[k].withColumnRenamed("parts", n)), "country_key", "left")
        own = F.pmod(F.xxhash64("id"), F.coalesce("own", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("other", F.lit(1)) - 1))
        i, j = (other, own) if side == 0 else (own, other)
        return rows.select("country_key", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "id", "words")

    tile = ["country_key", "i", "j"]
    rows = dealt_to_tiles(0).union(dealt_to_tiles(1)).repartition(*tile).sortWithinPartitions(*tile, "side")
    schema = "s1_id string, candidate_id string, shared long"
    if not again:
        return rows.mapInArrow(_tiled(least), schema)
    return rows.mapInArrow(_tiled(1), schema).groupBy(*PAIR).agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= least)  # an id's records count together


def name_token_pairs(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs that share a name token."""
    return shared_pairs(s1, targets, "name_set", "name_set", 1, NAME_ROWS).select(*PAIR)


def address_pairs(s1: DataFrame, targets: DataFrame, least: int = 2, mode: str = "multiset", common: int = TILE_ROWS) -> DataFrame:
    """Pairs that share at least ``least`` address tokens: (s1_id, candidate_id, shared).

    In mode "multiset" a token that a target repeats counts as often as the target has it; in mode "distinct", once. Some
    ``common`` records of a side, even if all have a token in common, meet in one tile; more are dealt to several.
    """
    theirs = "address_tokens" if mode == "multiset" else "address_set"
    return shared_pairs(s1, targets, "address_set", theirs, least, common)


def beside(s1: DataFrame, targets: DataFrame, key: tuple[str, ...] = ("country_key",), cell: tuple[int, int] | None = None) -> DataFrame:
    """Every pair of records of equal ``key``, none null, with all columns of both as s1_... and target_...

    Both sides are dealt to a grid of cells of some ``cell`` records, and only records are shuffled: what filters, measures or counts
    the pairs works on them as they are made, so they are neither shuffled nor stored.
    """
    counts = [x.groupBy(*key).agg(F.count("*").alias(n)) for x, n in ((s1, "_l"), (targets, "_r"))]
    mine, theirs = cell or CELL
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    cells = settled(counts[0].join(counts[1], list(key)).select(*key, parts("_l", mine).alias("_m"), parts("_r", theirs).alias("_n")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("entity_id"), F.col(n)).cast("int")
    tasks = max(int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2_000, cells.agg(F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0))).first()[0] // 2))
    sides = []
    for rows, side, i, j in ((s1, "s1", own("_m"), every("_n")), (targets, "target", every("_m"), own("_n"))):
        at = [*[F.col(c).alias(f"_k{n}") for n, c in enumerate(key)], i.alias("_i"), j.alias("_j")]
        sides.append(rows.join(cells, list(key)).select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns], *at))
    at = [*(f"_k{n}" for n in range(len(key))), "_i", "_j"]
    left, right = (x.repartition(tasks, *at) for x in sides)
    both = left.join(right.hint("shuffle_hash"), at).drop(*at)
    return both.withColumnsRenamed({"s1_entity_id": "s1_id", "target_entity_id": "candidate_id"})


def with_repeats(prepared: DataFrame) -> DataFrame:
    """Records with ``address_repeats``, the tokens that an address has more than once, as ``is_candidate`` asks of targets."""
    rows = prepared.withColumn("_sorted", F.array_sort("address_tokens"))
    again = F.filter("_sorted", lambda x, i: F.coalesce(F.get(F.col("_sorted"), i - 1) == x, F.lit(False)))
    return rows.withColumn("address_repeats", F.array_distinct(again)).drop("_sorted")


def is_candidate() -> Column:
    """Whether any of the three rules finds a pair of one country, read off the fields of both; address tokens as a multiset."""
    a, b = (lambda f: F.col(f"s1_{f}")), (lambda f: F.col(f"target_{f}"))
    named = ((a("name") != "") & (a("name") == b("name"))) | F.arrays_overlap(a("name_set"), b("name_set"))
    twice = F.arrays_overlap(a("address_set"), b("address_repeats")) | (F.size(F.array_intersect(a("address_set"), b("address_set"))) >= 2)
    return (a("country_key") == b("country_key")) & (named | ((F.size(a("address_set")) >= 2) & twice))


def is_dense(s1: DataFrame, targets: DataFrame) -> bool:
    """Whether going through all pairs of each country costs at most ``DENSE`` times the rows that joins of tokens make."""
    each = [x.groupBy("country_key").agg(F.count("*").alias(n)) for x, n in ((s1, "l"), (targets, "r"))]
    pairs = each[0].join(each[1], "country_key").agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0))).first()[0]
    return pairs <= DENSE * sum(join_size(s1, targets, c).first()["rows"] for c in ("name_set", "address_set"))


@dataclass
class Blocks:
    """The three indexes of a source: whole names, names' tokens and addresses' tokens; built once for many look-ups."""

    whole: TokenIndex
    words: TokenIndex
    places: TokenIndex

    @staticmethod
    def of(targets: DataFrame, mode: str = "multiset") -> Blocks:
        whole = targets.withColumn("name_set", F.array("name")).filter("name != ''")
        return Blocks(TokenIndex.of(whole, "name_set"), TokenIndex.of(targets, "name_set"), TokenIndex.of(targets, "address_tokens" if mode == "multiset" else "address_set"))

    def write(self, path: str) -> None:
        for name in ("whole", "words", "places"):
            getattr(self, name).write(f"{path}/{name}")

    @staticmethod
    def pairs(s1: DataFrame, spark: SparkSession, path: str) -> DataFrame:
        """The candidates of records of S1 by stored indexes; for few records only the folders of their tokens are read."""
        found = None
        for name, probes, least in _probes(s1):
            probes = settled(probes)
            more = Blocks._named(probes, TokenIndex.read(spark, f"{path}/{name}", probes), least)
            found = more if found is None else found.union(more)
        return found.distinct()

    @staticmethod
    def _named(probes: DataFrame, index: TokenIndex, least: int) -> DataFrame:
        return index.named(hits(probes, index, least)).select(*PAIR)


def _probes(s1: DataFrame) -> tuple[tuple[str, DataFrame, int], ...]:
    """(index, tokens that ask it, how many must meet) of each rule."""
    whole = s1.filter("name != ''").select("country_key", F.col("name").alias("token"), F.col("entity_id").alias("s1_id"))
    return ("whole", whole, 1), ("words", postings(s1, "name_set", "s1_id"), 1), ("places", postings(s1.filter(F.size("address_set") >= 2), "address_set", "s1_id"), 2)


def _any_rule(rows: pa.Table, new: np.ndarray, ids: pa.DictionaryArray) -> pa.RecordBatch:
    """The places of each record and bucket whose postings are worth two."""
    first = np.flatnonzero(new)
    code, row = codes(rows, new)
    worth = rows["worth"].to_numpy()[row]
    if 4 * len(code) > len(first) * SPAN:
        found = np.flatnonzero(np.bincount(code, worth) >= 2)
    else:
        cell, at = np.unique(code, return_inverse=True)
        found = cell[np.bincount(at, worth, len(cell)) >= 2]
    group, start = np.unique(found // SPAN, return_index=True)
    places = pa.ListArray.from_arrays(pa.array(np.r_[start, len(found)].astype(np.int32)), pa.array((found % SPAN).astype(np.int16)))
    columns = [ids.dictionary.take(pa.array(ids.indices.to_numpy()[first[group]])), pa.array(rows["bucket"].to_numpy()[first[group]]), places]
    return pa.RecordBatch.from_arrays(columns, ["s1_id", "bucket", "places"])


def candidate_pairs(s1: DataFrame, targets: DataFrame, mode: str = "multiset") -> DataFrame:
    """Pairs that any of the three rules finds, each once.

    Names, their tokens and addresses' tokens are one packed index. A name or its token is worth two, an address token one; of a
    record's places in a bucket those worth two are kept as an array, which gets its ids, and becomes pairs, last. So pairs are
    neither shuffled nor put together from three lists.
    """
    whole = F.when(F.col("name") != "", F.array(F.concat(F.lit("e:"), "name"))).otherwise(F.array().cast("array<string>"))
    marked = lambda mark, tokens: F.transform(tokens, lambda x: F.concat(F.lit(mark), x))
    names, places = F.concat(whole, marked("n:", "name_set")), "address_tokens" if mode == "multiset" else "address_set"
    index = TokenIndex.of(targets.withColumn("_t", F.concat(names, marked("a:", places))), "_t")
    probes = [(names, s1, 2), (marked("a:", "address_set"), s1.filter(F.size("address_set") >= 2), 1)]
    named, placed = (postings(rows.withColumn("_t", t_), "_t", "s1_id").withColumn("worth", F.lit(n).cast("byte")) for t_, rows, n in probes)
    met = dealt(named.union(placed), index).repartition("s1_id", "bucket").sortWithinPartitions("s1_id", "bucket")
    found = met.mapInArrow(by_record(_any_rule), "s1_id string, bucket long, places array<short>").withColumn("part", F.pmod(F.xxhash64("s1_id"), F.lit(PARTS)).cast("int"))
    ids = index.numbers.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("place", "candidate_id"))).alias("x"))  # a bucket's places have no gaps
    ids = ids.select("bucket", F.col("x.candidate_id").alias("ids"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    pairs = found.join(ids, ["bucket", "part"]).select("s1_id", F.explode(F.transform("places", lambda p: F.col("ids")[p.cast("int")])).alias("candidate_id"))
    once = targets.groupBy("entity_id").count().filter("count > 1").isEmpty()
    return pairs if once else pairs.distinct()


def token_frequency(prepared: DataFrame, tokens: str = "address_set") -> DataFrame:
    """(token, frequency): in how many records a token occurs, over all countries."""
    return prepared.select(F.explode(tokens).alias("token"), times(prepared).alias("n")).groupBy("token").agg(F.sum("n").alias("frequency"))


def three_letter_frequency(prepared: DataFrame) -> DataFrame:
    return token_frequency(prepared.withColumn("short_set", t.three_letter_tokens(F.col("name"))), "short_set")


def single_token_pairs(s1: DataFrame, targets: DataFrame, frequency: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs that share exactly one distinct address token, of frequency at most ``limit``: with token and frequency.

    Pairs are made from tokens within the limit only; that they share nothing else is read off their sets.
    """
    usable = frequency if limit is None else frequency.filter(F.col("frequency") <= limit)
    right = postings(targets, "address_set", "candidate_id").join(usable, "token")
    found = postings(s1, "address_set", "s1_id").join(right, ["country_key", "token"])
    found = found.groupBy(*PAIR).agg(F.count("*").alias("n"), F.first("token").alias("token"), F.first("frequency").alias("frequency")).filter("n = 1")
    if limit is None:
        return found.drop("n")
    a = s1.select(F.col("entity_id").alias("s1_id"), F.col("address_set").alias("a"))
    b = targets.select(F.col("entity_id").alias("candidate_id"), F.col("address_set").alias("b"))
    alone = F.size(F.array_intersect("a", "b")) == 1
    return found.join(a, "s1_id").join(b, "candidate_id").filter(alone).select(*PAIR, "token", "frequency")


def join_size(s1: DataFrame, targets: DataFrame, tokens: str) -> DataFrame:
    """One row: how many rows a token join would make, and the key that makes most. Cheap; run it before the join."""
    counts = [postings(x, tokens).groupBy("country_key", "token").agg(F.count("*").alias(n)) for x, n in ((s1, "l"), (targets, "r"))]
    both = counts[0].join(counts[1], ["country_key", "token"]).withColumn("rows", F.col("l") * F.col("r"))
    return both.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max_by("token", F.struct("rows", "token")).alias("largest_token"), F.max("rows").alias("largest_rows"))


def candidate_counts(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, candidates) of every S1 record, 0 included."""
    counts = pairs.groupBy("s1_id").agg(F.sum(times(pairs, "target_copies")).alias("candidates"))
    return s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").na.fill(0)


def recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, and their share. A true pair may stand for several (``copies``)."""
    hit = pairs.select(*PAIR).distinct().withColumn("hit", F.lit(1))
    both = truth.join(hit, PAIR, "left").withColumn("n", times(truth))
    counts = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("true_pairs"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("recovered"))
    return counts.withColumn("recall", F.when(F.col("true_pairs") == 0, 0.0).otherwise(F.col("recovered") / F.col("true_pairs")))


def missed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    return truth.join(pairs, PAIR, "left_anti").select(*PAIR)

"""The tree of shared beginnings of conversations.

1. Turns are numbered and each conversation is rebuilt from the opening of its hundred's first one and its own rest.
   Rows carry a digest and a length, never the text. A chain of digests over a conversation's turns names each prefix.
2. A group per prefix digest gives its least conversation and how many share it; counts are combined before the shuffle.
3. The least member of a prefix is that of every longer prefix that it still has, so a conversation owns its prefixes
   from some depth on. That depth is found by binary search: each round looks one prefix of every conversation up in
   the minima, so there are as many rounds as the longest conversation's length has bits.
4. The owned stretches are chains, each hung onto another one's node; together they are the tree.
5. Sums over subtrees come bottom-up: the chains' own sums go to all chains above by pointer doubling, then
   running sums along each chain, from its end, add what hangs on it.
6. The ids that end at a node are sorted and joined in pieces, in parallel; a digest reads the pieces in order.

Defined cases: rows without conv_id are left out; null roles and texts are empty; turns come in order of their number, null
first, and rows of equal number by digest of role and text, so repeated rows are turns of their own; a conversation whose
hundred's first one is missing keeps its rest only; extra columns are left alone; an empty table has no nodes, not even a root.
The turns of one conversation pass through one task in order, as a chain of digests asks, and in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, written

HUNDRED, OPENINGS = 100, 6
#: Ids joined into one piece of text.
PIECE_IDS = 5000


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, chars) of every turn, in order from 1."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.char_length(text).alias("chars"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")
    return rows.select("conv", F.row_number().over(order).alias("pos"), "digest", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, depth, size, digest, chars), and all conversations (conv, size)."""
    turns = cut(numbered(conversations))
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    first = F.col("conv") - F.col("conv") % HUNDRED
    opening = (F.crc32(F.col("conv").cast("string")) % OPENINGS).cast("int")
    base = sizes.filter(F.col("conv") == first).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.select("conv", "n", opening.alias("h"), first.alias("base")).join(base, "base", "left")
    plan = plan.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = cut(plan.withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "base", "h", "taken", "size"))
    shared = turns.filter((F.col("conv") == first) & (F.col("pos") < OPENINGS)).withColumnRenamed("conv", "base")
    opened = plan.filter("taken > 0").join(shared, "base").filter("pos <= taken").select("conv", F.col("pos").alias("depth"), "size", "digest", "chars")
    own = turns.join(plan, "conv").filter("pos > h").select("conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "size", "digest", "chars")
    return opened.union(own), plan.select("conv", "size")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, last = None, b""
    for b in batches:
        out = []
        for c, d in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
            if c != conv:
                conv, last = c, b""
            last = hashlib.blake2b(last + d, digest_size=16).digest()
            out.append(last)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary()), b.column(4)], ["conv", "depth", "size", "prefix", "chars"])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, size, prefix, chars): the digest of each conversation's first ``depth`` turns."""
    small_batches(turns.sparkSession)
    rows = turns.repartition("conv").sortWithinPartitions("conv", "depth")
    return rows.mapInArrow(_chained, "conv long, depth int, size int, prefix binary, chars int")


def first_owned(found: DataFrame, minima: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv, size, top): the least depth whose prefix has ``conv`` as least member; size + 1 if there is none."""
    state = conversations.select("conv", "size", F.lit(1).alias("lo"), (F.col("size") + 1).alias("hi"))
    longest = conversations.agg(F.max("size")).first()[0] or 0
    middle = ((F.col("lo") + F.col("hi") - 1) / 2).cast("int")
    for _ in range(int(longest).bit_length()):
        probes = state.filter("lo < hi").select("conv", middle.alias("depth")).join(found.select("conv", "depth", "prefix"), ["conv", "depth"])
        owned = probes.join(minima, ["depth", "prefix"]).select("conv", (F.col("least") == F.col("conv")).alias("owned"))
        state = cut(
            state.join(owned, "conv", "left").select(
                "conv",
                "size",
                F.when(F.col("owned") == False, middle + 1).otherwise(F.col("lo")).alias("lo"),  # noqa: E712
                F.when(F.col("owned"), middle).otherwise(F.col("hi")).alias("hi"),
            )
        )
    return state.select("conv", "size", F.col("lo").alias("top"))


def totals(chains: DataFrame) -> DataFrame:
    """(conv, leaves, saved) of a chain and all below it, from ``chains(conv, parent, leaves, saved)``, by pointer doubling."""
    state = cut(chains.select("conv", F.col("parent").alias("up"), "leaves", "saved"))
    while not state.filter("up is not null").isEmpty():
        gained = state.filter("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.select(F.col("conv").alias("up"), F.col("up").alias("further"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        state = cut(state.join(gained, "conv", "left").join(jump, "up", "left").select("conv", F.col("further").alias("up"), plus("leaves", "l"), plus("saved", "s")))
    return state.drop("up")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, member) rows as (node, depth, first member, members joined by commas)."""
    key, held = None, []

    def piece() -> pa.RecordBatch:
        columns = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])]
        return pa.RecordBatch.from_arrays(columns, ["node", "depth", "first", "ids"])

    for b in batches:
        for node, depth, member in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if (node, depth) != key or len(held) >= PIECE_IDS:
                if held:
                    yield piece()
                key, held = (node, depth), []
            held.append(member)
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as (node, depth, ends_sha256), in constant memory."""
    key, digest = None, hashlib.sha256()
    for b in batches:
        out = []
        for node, depth, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
            if (node, depth) == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (node, depth), hashlib.sha256()
            digest.update(ids.encode())
        yield _ended(out)
    if key is not None:
        yield _ended([(*key, digest.hexdigest())])


def _ended(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["node", "depth", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256): the digest of the sorted members of each node in ``rows(node, depth, member)``."""
    order = ["node", "depth", "member"]
    pieces = rows.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "node long, depth int, first long, ids string")
    pieces = pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return pieces.mapInArrow(_digests, "node long, depth int, ends_sha256 string")



def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations)
    convs = cut(convs)
    found = written(prefixes(turns))
    minima = written(found.groupBy("depth", "prefix").agg(F.min("conv").alias("least"), F.count("*").alias("n")))
    root = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()  # one row
    none = F.lit(0).cast("int")
    chains = first_owned(found, minima, convs)
    # the least conversation of all owns every prefix of its own, and the root
    chains = cut(chains.select("conv", "size", F.when(F.col("conv") == root["root"], 0).otherwise(F.col("top")).alias("top")).filter("top <= size"))
    hung = chains.filter("top > 0").select("conv", (F.col("top") - 1).alias("depth"))
    below = hung.filter("depth > 0").join(found, ["conv", "depth"]).join(minima, ["depth", "prefix"]).select("conv", "depth", F.col("least").alias("parent"))
    ties = cut(below.union(hung.filter("depth = 0").select("conv", "depth", F.lit(root["root"]).cast("long"))))
    attached = ties.groupBy(F.col("parent").alias("conv"), "depth").agg(F.count("*").alias("attached"))
    owned = found.select("conv", "depth", "prefix", "chars").join(chains, "conv").filter("depth >= top").join(minima.select("depth", "prefix", "n"), ["depth", "prefix"])
    owned = owned.select("conv", "depth", "size", "top", "chars", "n")
    top = chains.filter("top = 0").select("conv", none.alias("depth"), "size", "top", none.alias("chars"), F.lit(root["n"]).cast("long").alias("n"))
    nodes = owned.union(top).join(attached, ["conv", "depth"], "left")
    children = F.coalesce("attached", F.lit(0)) + (F.col("depth") < F.col("size")).cast("long")
    nodes = nodes.withColumns({"n_children": children, "own_saved": (F.col("n") - 1) * F.col("chars")}).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = written(nodes)
    sums = nodes.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("own_saved").alias("saved")).join(ties.select("conv", "parent"), "conv", "left")
    hanging = ties.join(totals(sums), "conv").groupBy(F.col("parent").alias("conv"), "depth").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    rows = nodes.join(hanging, ["conv", "depth"], "left")
    rest = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n_leaves", F.sum(F.col("leaf") + F.coalesce("l", F.lit(0))).over(rest)).withColumn("saved_tokens", F.sum(F.col("own_saved") + F.coalesce("s", F.lit(0))).over(rest))
    ended = found.filter("depth = size").join(minima, ["depth", "prefix"]).select(F.col("least").alias("node"), "depth", F.col("conv").alias("member"))
    ended = ends(ended.union(convs.filter("size = 0").select(F.lit(root["root"]).cast("long"), none, "conv")))
    rows = rows.join(ended.withColumnRenamed("node", "conv"), ["conv", "depth"], "left")
    rows = rows.join(ties.select("conv", (F.col("depth") + 1).alias("depth"), "parent"), ["conv", "depth"], "left")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return rows.select(
        F.col("conv").alias("conv_id"),
        long("depth", "depth"),
        F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"),
        long("n", "n_convs"),
        long("n_children", "n_children"),
        long("n_leaves", "n_leaves"),
        long("saved_tokens", "saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

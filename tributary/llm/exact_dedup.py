"""Exact duplicates by recipes of content-defined chunks (native: DataFrame functions only).

A text is cut where its content says so, so equal texts get equal cuts. Each
distinct chunk is grouped once, by hash and content, which proves that a hash
stands for one content; where it doesn't, the contents of that hash are told
apart by rank. A document is then the ordered list of its chunk identifiers, and
only these lists are compared and moved: the text of a long document is not
shuffled as a whole, and repeated chunks are merged before the shuffle.

Defined cases: null text counts as empty; an empty text has an empty recipe, so all
empty texts are equal; rows with a null doc_id count in ``group_size`` and
always stay, as no other row can stand for them by id; rows that repeat a doc_id and text are one document and share its fate;
extra columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

MIN_CHUNK, MAX_CHUNK = 256, 1024


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    """A chunk ends at the first cut character after ``least`` characters, at ``most`` at the latest.

    Cut characters are those of Latin-1 whose code is 10 modulo 16 (newline, colon, J, Z, j, z and
    more): about one in two hundred of ordinary text.
    """
    cuts = "".join(f"\\x{{{c:x}}}" for c in range(1, 256) if c % 16 == 10)
    return f"(?s).{{{least}}}[^{cuts}]{{0,{most - least}}}+[{cuts}]?+|.{{1,{least}}}"


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def chunk_id(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def distinct_chunks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(id, chunk) of every different chunk of the texts in ``norm``."""
    chunks = docs.select(F.explode(chunks_of(F.col("norm"))).alias("chunk"))
    return chunks.groupBy(chunk_id(F.col("chunk"), bits).alias("id"), "chunk").agg(F.count("*").alias("uses"))


def ambiguous_ids(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The identifiers that stand for more than one content; usually none."""
    return distinct_chunks(docs, bits).groupBy("id").agg(F.count("*").alias("contents")).filter("contents > 1").select("id")


def recipes(documents: DataFrame, id_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe, amend): equal texts and only they have equal recipe and amend.

    ``recipe`` is the ordered list of chunk identifiers. ``amend`` is null unless a chunk of the
    document has an ambiguous identifier; then it lists (position, rank) of such chunks.
    """
    docs = documents.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    plain = docs.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks_of(F.col("norm")), lambda c: chunk_id(c, id_bits)).alias("recipe"),
    )
    several = cut(ambiguous_ids(docs, id_bits))
    if several.isEmpty():
        return cut(plain.withColumn("amend", F.lit(None).cast("array<struct<pos:int,rank:int>>")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("chunk")).alias("rank")
    ambiguous = distinct_chunks(docs, id_bits).join(several, "id", "left_semi").select("id", "chunk", rank)
    placed = (
        docs.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks_of(F.col("norm"))).alias("pos", "chunk"))
        .withColumn("id", chunk_id(F.col("chunk"), id_bits))
        .join(ambiguous, ["id", "chunk"])
    )
    amends = placed.groupBy("text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "rank"))).alias("amend"))
    return cut(plain.join(amends, "text_sha256", "left"))


def exact_dedup(documents: DataFrame, id_bits: int = 64) -> DataFrame:
    """One row per row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256.

    The row of the largest doc_id of each group of equal texts is kept.
    """
    found = recipes(documents, id_bits)
    groups = found.groupBy("recipe", "amend").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    same = found["recipe"].eqNullSafe(groups["recipe"]) & found["amend"].eqNullSafe(groups["amend"])
    return found.join(groups, same).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that ``exact_dedup`` keeps, with all their columns."""
    dropped = exact_dedup(documents).filter(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("hash")).distinct()
    norm = ascii_lower(F.coalesce(documents["text"], F.lit("")))
    same = [documents["doc_id"] == dropped["id"], F.sha2(norm, 256) == dropped["hash"]]
    return documents.join(dropped, same, "left_anti")

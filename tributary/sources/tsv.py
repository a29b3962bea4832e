"""Tab-separated sources and sinks, truth cells, and loads of required records.

Reading keeps every value a string: empty is empty, "NA" is "NA". Sinks for people are TSV; between jobs use
Parquet.

A quoted value may hold line ends, so a line is not always a record. Files are read by blocks in parallel all the same: a
first pass says for each block how it would end if it began outside or inside quotes, these are put together along the
file, and with its true beginning each block cuts its records. What lies across blocks is put together apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.text import stripped, text_of
from tributary.storage import settled

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATE = T.StructType([T.StructField(c, T.StringType()) for c in ("s1_id", "candidate_id", "source")])
SOURCES = ("S2", "S3")


_FORMAT = {"sep": "\t", "escape": '"', "emptyValue": "", "nullValue": "\0"}
_BLOCK = ["file", "block"]
#: Kinds of text that a block gives: a header, a record, the end of one that an earlier block began, the beginning of one that goes on.
HEADER, WHOLE, REST, BEGUN = range(4)


def read_whole_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """As ``read_tsv``, by Spark's own reader: a file is one task."""
    rows = spark.read.options(**_FORMAT, header=True, multiLine=True).csv(path).na.fill("")
    return rows.select(*columns) if columns else rows


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted value is open after a line, if one was open before it or not. Only a value's first character can open it."""
    at = 0
    while True:
        if not inside:
            if not line.startswith('"', at):
                at = line.find("\t", at) + 1
                if not at:
                    return False
                continue
            at += 1
        while (quote := line.find('"', at)) >= 0 and line.startswith('""', quote):
            at = quote + 2
        if quote < 0:
            return True
        inside, at = False, line.find("\t", quote + 1) + 1
        if not at:
            return False


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ENDS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())])
_TEXTS = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, outside, inside): what is open after a block that began outside or inside quotes."""
    block, ends = None, (False, True)
    for b in batches:
        out = []
        for line, file, start in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if (file, start) != block:
                if block is not None:
                    out.append((*block, *ends))
                block, ends = (file, start), (False, True)
            if '"' in line:
                ends = (ends_inside(line, ends[0]), ends_inside(line, ends[1]))
        yield _table(out, _ENDS)
    if block is not None:
        yield _table([(*block, *ends)], _ENDS)


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, kind, text) of blocks whose beginning is known."""
    block: tuple[int, int] | None = None
    held: list[str] = []
    kind, inside = WHOLE, False
    for b in batches:
        out = []
        for line, file, start, began_inside in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (file, start) != block:
                if held:
                    out.append((*block, BEGUN if kind != REST else REST, "\n".join(held)))
                block, held, inside = (file, start), [], began_inside
                kind = REST if inside else WHOLE if start else HEADER
            held.append(line)
            inside = ends_inside(line, inside) if '"' in line else inside
            if not inside:
                out.append((*block, kind, "\n".join(held)))
                held, kind = [], WHOLE
        yield _table(out, _TEXTS)
    if held:
        yield _table([(*block, BEGUN if kind != REST else REST, "\n".join(held))], _TEXTS)


def _begun_inside(ends: DataFrame) -> DataFrame:
    """The blocks that begin inside quotes. A block turns the state over, keeps it, or sets it whatever it was."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("outside") & ~F.col("inside")).cast("int")
    rows = ends.withColumn("turned", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    sets = F.when(F.col("outside") == F.col("inside"), F.struct(F.col("outside").cast("int").alias("to"), "turned"))
    rows = rows.withColumn("last", F.last(sets, ignorenulls=True).over(before))
    state = F.coalesce(F.col("last.to") + F.col("turned") - F.col("last.turned"), F.col("turned")) % 2
    return rows.filter(state != 0).select(*_BLOCK, F.lit(True).alias("inside"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(kind, text): the header of each file and every record, from blocks that are read in parallel."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ends = lines.mapInArrow(_block_ends, "file long, block long, outside boolean, inside boolean")
    inside = settled(_begun_inside(ends))
    # a row of 17 bytes for each block that begins inside quotes, at most one for each block of the input
    known = lines.join(F.broadcast(inside), _BLOCK, "left").select("value", *_BLOCK, F.coalesce("inside", F.lit(False)))
    texts = known.mapInArrow(_block_texts, "file long, block long, kind int, text string")
    whole = texts.filter(F.col("kind") <= WHOLE).select("kind", "text")
    if inside.isEmpty():
        return whole
    parts = texts.filter(F.col("kind") > WHOLE)
    upto = Window.partitionBy("file").orderBy("block", "kind")
    numbered = parts.withColumn("record", F.sum((F.col("kind") == BEGUN).cast("int")).over(upto))
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = numbered.groupBy("file", "record").agg(F.array_join(pieces["text"], "\n").alias("text"))
    return whole.union(joined.select(F.when(F.col("record") == 0, HEADER).otherwise(WHOLE), "text"))


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Every column of TSV files with a header, as strings, never null; only ``columns`` if given.

    Files are read by blocks. Blank records are skipped, missing values are empty, a carriage return before a record's line end is
    no part of it. Files of different headers are an error, as is a folder without any.
    """
    texts = _records(spark, path).select("kind", F.regexp_replace("text", r"\r\z", "").alias("text"))
    headers = [r.text for r in texts.filter(F.col("kind") == HEADER).select("text").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"files of {path} have {'different headers' if headers else 'no header'}")
    count = spark.range(1).select(F.size(F.split(F.lit(headers[0]), "\t")).alias("n")).first().n
    loose = ", ".join(f"c{k} string" for k in range(count))
    first = spark.range(1).select(F.from_csv(F.lit(headers[0]), loose, _FORMAT).alias("x")).first().x
    names = [n for n in first if n is not None]
    rows = texts.filter((F.col("kind") == WHOLE) & (F.col("text") != "")).select(F.from_csv("text", _ddl(names), _FORMAT).alias("r"))
    return rows.select([F.coalesce(F.col("r").getField(n), F.lit("")).alias(n) for n in columns or names])


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read_typed(spark: SparkSession, path: str) -> DataFrame:
    """A TSV file with inferred types, empty and NA as null; for profiles only."""
    return spark.read.options(sep="\t", header=True, inferSchema=True, nullValue="NA").csv(path)


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest keys: a prefix that doesn't depend on the layout of files."""
    return rows.orderBy(key).limit(n)


_SINK = {"sep": "\t", "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_tsv(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """TSV parts with one header (also for no rows), written in parallel; put together in the order of their names they are one file.

    Rows come sorted by ``order``, all columns by default, through ranges; the header is the first row of the first range.
    """
    keys = order or rows.columns
    line = F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in rows.columns]), _SINK)
    lines = rows.select(F.lit(1).alias("_h"), line.alias("_l"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    names = rows.sparkSession.createDataFrame([tuple(rows.columns)], ", ".join(f"c{i} string" for i in range(len(rows.columns))))
    head = names.select(F.lit(0), F.to_csv(F.struct("*"), _SINK), *[F.lit(None).cast(f.dataType) for f in lines.schema.fields[2:]])
    order_by = ["_h", *[f"_{i}" for i in range(len(keys))]]
    lines.union(head).repartitionByRange(*order_by).sortWithinPartitions(*order_by).select("_l").write.mode("overwrite").text(path, lineSep="\n")


def source_of(entity_id):
    """The source that an id's prefix names; null for an id of none."""
    return F.coalesce(*[F.when(F.startswith(entity_id, F.lit(f"{s}-")), s) for s in ("S1", "S2", "S3")])


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1_id, candidate_id), one row per true pair, from truth cells with comma-separated ids."""
    ids = F.filter(F.transform(F.split(text_of(F.col("matched_entity_ids")), ","), stripped), lambda x: x != "")
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(ids).alias("candidate_id")).distinct()


def candidate_ids(candidates: DataFrame, source: str | None = None) -> DataFrame:
    """Distinct ids of a candidate table: of S1, or of the candidates of one source."""
    if source is None:
        return candidates.select(F.col("s1_id").alias("entity_id")).distinct()
    return candidates.filter(F.upper("source") == source).select(F.col("candidate_id").alias("entity_id")).distinct()


def checked_sources(candidates: DataFrame) -> DataFrame:
    """Candidates with ``source`` as their ids say it; ``source_ok`` tells whether the table said the same."""
    true = source_of(F.col("candidate_id"))
    return candidates.withColumn("source_ok", F.upper("source") == true).withColumn("source", true)


def required_records(records: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """The records of the ids. ``strict`` raises if an id has none; the schema stays, whatever is found."""
    wanted = ids.select("entity_id").distinct()
    found = records.join(wanted, "entity_id", "left_semi")
    if strict and not (missing := wanted.join(records, "entity_id", "left_anti").limit(5)).isEmpty():
        raise ValueError(f"records are missing: {[r.entity_id for r in missing.collect()]}")
    return found


def unique_ids(records: DataFrame, key: str = "entity_id") -> DataFrame:
    """The records, after a check that no id occurs twice."""
    if not (twice := records.groupBy(key).count().filter("count > 1").limit(5)).isEmpty():
        raise ValueError(f"ids occur more than once: {[r[0] for r in twice.collect()]}")
    return records


def unresolved(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs with an id that no record has."""
    a = pairs.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_anti")
    b = pairs.join(targets.select(F.col("entity_id").alias("candidate_id")), "candidate_id", "left_anti")
    return a.select("s1_id", "candidate_id").union(b.select("s1_id", "candidate_id")).distinct()

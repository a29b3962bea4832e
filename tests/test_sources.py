"""The split TSV scan against Spark's whole-file reader, the sink, and look-ups that had no test."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import text as t
from tributary.operators import blocking, classify
from tributary.sources import tsv


def quoted_file(seed: int, rows: int) -> str:
    """Values with quotes, tabs and line ends inside, blank ones, and quotes within values that aren't quoted."""
    r = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, delimiter="\t", lineterminator="\n")
    writer.writerow(["entity_id", "business name", "a`b"])
    for k in range(rows):
        value = lambda: "".join(r.choices(['"', "\n", "\t", "x", "é", " ", "yy", ",", "\\", ""], k=r.randrange(9)))
        writer.writerow([f"S2-{k}", value(), value()])
        if r.random() < 0.2:
            out.write(f'S3-{k}\t5" pipe\t"all"\n')
    return out.getvalue()


def rows_of(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in kept.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_of_any_size_give_the_same_rows(spark, tmp_path, small_blocks, seed):
    text = quoted_file(seed, 25)
    (tmp_path / "x.tsv").write_text(text, encoding="utf-8")
    small_blocks(1 << 27)
    want = rows_of(tsv.read_whole_tsv(spark, str(tmp_path / "x.tsv")))
    assert want == sorted(tuple(x) for x in list(csv.reader(io.StringIO(text, newline=""), delimiter="\t"))[1:] if x)
    for size in (len(text.encode()) // 2, 97, 41, 23):
        small_blocks(size)
        got = tsv.read_tsv(spark, str(tmp_path / "x.tsv"))
        assert got.columns == ["entity_id", "business name", "a`b"]
        assert rows_of(got) == want, size
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "x.tsv")).rdd.getNumPartitions() > 1


def test_every_cut_of_a_file(spark):
    """The helpers alone, with blocks that begin at any line, over every way to cut the lines in three."""
    import pyarrow as pa

    text = quoted_file(9, 6)
    lines = text.split("\n")[:-1]
    want = None
    for i in range(len(lines) + 1):
        for j in range(i, len(lines) + 1):
            block = [0] * i + [1] * (j - i) + [2] * (len(lines) - j)
            batch = lambda *more, b=block: pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([7] * len(lines), pa.int64()), pa.array(b, pa.int64()), *more], ["value", "file", "block", *["inside"] * len(more)])
            ends = {r["block"]: (r["outside"], r["inside"]) for b in tsv._block_ends(iter([batch()])) for r in b.to_pylist()}
            state, inside = False, {}
            for k in sorted(ends):
                inside[k] = state
                state = ends[k][state]
            texts = [r for b in tsv._block_texts(iter([batch(pa.array([inside[k] for k in block], pa.bool_()))])) for r in b.to_pylist()]
            records, held = [], None
            for r in texts:
                if r["kind"] == tsv.BEGUN:
                    held = r["text"]
                elif r["kind"] == tsv.REST:
                    held = r["text"] if held is None else held + "\n" + r["text"]
                    if not tsv.ends_inside(held, False):
                        records.append(held)
                        held = None
                else:
                    records.append(r["text"])
            assert held is None
            want = want or records
            assert records == want, (i, j)
    assert len(want) == len(list(csv.reader(io.StringIO(text, newline=""), delimiter="\t")))


def test_folders_carriage_returns_and_errors(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tsv").write_bytes(b'k\tv\r\n1\t"x\ny"\r\n\r\n2\r\n')
    (folder / "b.tsv").write_bytes(b"k\tv\n3\tNA\n")
    assert rows_of(tsv.read_tsv(spark, str(folder))) == [("1", "x\ny"), ("2", ""), ("3", "NA")]
    assert rows_of(tsv.read_tsv(spark, str(folder), ["v"])) == [("",), ("NA",), ("x\ny",)]
    (folder / "c.tsv").write_bytes(b"k\tw\n3\tNA\n")
    with pytest.raises(ValueError, match="different headers"):
        tsv.read_tsv(spark, str(folder))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.tsv").write_bytes(b"")
    with pytest.raises(ValueError, match="no header"):
        tsv.read_tsv(spark, str(tmp_path / "empty"))


def test_sink_parts_are_one_file_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_sink(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_sink(spark, tmp_path):
    r = random.Random(2)
    rows = [(f"S1-{k:04d}", r.choice(["", None, 'a"b', "two\nlines", "t\tab", "plain", " edge "]), float(k)) for k in range(500)]
    df = spark.createDataFrame(rows, "s1_id string, candidate_id string, score double").repartition(7)
    tsv.write_tsv(df, str(tmp_path / "out"), ["s1_id"])
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert len(parts) > 1
    whole = "".join(p.read_text(encoding="utf-8") for p in parts)
    read = list(csv.reader(io.StringIO(whole, newline=""), delimiter="\t"))
    assert read[0] == df.columns and [x[0] for x in read[1:]] == [x[0] for x in rows]
    (tmp_path / "one.tsv").write_text(whole, encoding="utf-8")
    assert rows_of(tsv.read_tsv(spark, str(tmp_path / "one.tsv"))) == sorted((a, b or "", str(c)) for a, b, c in rows)
    tsv.write_tsv(df.limit(0), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))) == "s1_id\tcandidate_id\tscore\n"


def test_typed_prefix_and_candidate_ids(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("id\tn\tname\n3\t1.5\tNA\n1\t\tb\n2\t4\tc\n", encoding="utf-8")
    typed = tsv.read_typed(spark, str(tmp_path / "x.tsv"))
    assert dict(typed.dtypes) == {"id": "int", "n": "double", "name": "string"}
    assert {r.id: (r.n, r.name) for r in typed.collect()} == {3: (1.5, None), 1: (None, "b"), 2: (4.0, "c")}
    assert [r.id for r in tsv.first_rows(typed, "id", 2).collect()] == [1, 2]
    pairs = spark.createDataFrame([("S1-1", "S2-1", "s2"), ("S1-1", "S3-1", "S3"), ("S1-2", "S2-1", "S2")], tsv.CANDIDATE)
    assert rows_of(tsv.candidate_ids(pairs)) == [("S1-1",), ("S1-2",)]
    assert rows_of(tsv.candidate_ids(pairs, "S2")) == [("S2-1",)] and rows_of(tsv.candidate_ids(pairs, "S3")) == [("S3-1",)]


def test_address_words_and_scripts_of_both_fields(spark):
    df = spark.createDataFrame([("12 Main  STREET, Old-town",)], "a string")
    plain, more = df.select(t.address_words(F.col("a"), False), t.address_words(F.col("a"), True)).first()
    assert plain == ["12", "main", "street,", "old-town"] and set(more) == {"12", "main", "street,", "old-town"}
    rows = [("S1-1", "Acme", "Main 1", "US"), ("S2-1", "Акме", "Лес", "US"), ("S2-2", "Акме", "Main", "US"), ("S2-3", "77", "1", "US")]
    prepared = blocking.prepare(spark.createDataFrame(rows, tsv.RECORD))
    from tributary.operators.features import joined

    pairs = spark.createDataFrame([("S1-1", f"S2-{k}") for k in (1, 2, 3)], "s1_id string, candidate_id string")
    got = {r.candidate_id: r.different_scripts for r in classify.with_name_signals(joined(pairs, prepared, prepared, classify.RAW)).collect()}
    assert got == {"S2-1": True, "S2-2": False, "S2-3": False}

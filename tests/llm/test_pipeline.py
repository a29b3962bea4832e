"""The pipeline, stage by stage on its own input, against brute force."""

from __future__ import annotations

import corpus_pipeline
from test_decontamination import plain as passages
from test_exact_dedup import low
from test_ngram_join import plain as similar
from test_packing import check
from test_simhash import plain_components, plain_fingerprint
from tokenizers import Tokenizer

from tributary.llm.tokens import tokenizer_path
from tributary.llm.toxicity import CUT, Model, train

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = Model.load(train(docs, labels))
    kept = {d: t for d, t in texts.items() if model.scores([t])[0] < CUT}
    assert 0 < len(kept) < len(texts)
    last = {}
    for d in sorted(kept):
        last[low(kept[d])] = d
    kept = {d: kept[d] for d in last.values()}
    group = plain_components({d: plain_fingerprint(t) for d, t in kept.items()})
    kept = {d: t for d, t in kept.items() if group[d] == d}
    group = {d: c for d, (_, c) in similar(list(kept.items()), 5, 80).items()}
    kept = {d: t for d, t in kept.items() if group[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tainted = {d for d, _ in passages(list(kept.items()), items)}
    kept = {d: t for d, t in kept.items() if d not in tainted}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(kept)
    check(rows, kept, Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 score", "'x' component_id", "2 h")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]


ODD = [(1, None), (2, ""), (3, "same text of a few words here"), (3, "same text of a few words here"), (4, "Same TEXT of a few words here"), (None, "nobody's words"), (None, None), (5, "w " * 300_000), (6, " \t\n"), (7, "another text"), (7, "with one id for two")]


def test_odd_input(spark, tmp_path):
    """Null and empty texts, null and repeated ids, long texts, no labels and no benchmark: every stage gives what it must."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "0L n_chars", "'x' hash")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns
    assert sorted({r.doc_id for r in rows.collect()} - {None}) == [2, 4, 5, 7]  # 1 is equal to 2, and 6 has no words either: fingerprint zero links them
    assert rows.filter("doc_id is null").count() == 2 and rows.filter("doc_id = 7").count() == 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {None, 2, 4, 5, 7}
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Toxicity scores: held-out quality, and the parts of the classifier against plain computations."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tributary.llm.toxicity import CUT, TOP, Model, best_cut, calibrated, fit, language_of, remove_toxic, top_values, toxicity, train, words_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, toxicity(docs, labels).toPandas()


def test_held_out_documents(scored):
    docs, labels, got = scored
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= CUT)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    pos, neg = both[both.toxic == 1].score.to_numpy(), both[both.toxic == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).mean() + (pos[:, None] >= neg).mean()) / 2
    assert auc > 0.8
    assert (both.predicted == both.toxic).mean() > 0.9


def test_the_same_rows_give_the_same_model(scored):
    docs, labels, _ = scored
    a, b = train(docs, labels, rows=200), train(docs.repartition(7), labels.repartition(3), rows=200)
    assert a == b


def test_only_rows_not_held_out_are_learned(spark):
    docs = spark.createDataFrame([(d, "bad words here") for d in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(zlib.crc32(str(d).encode()) % 4 == 2)) for d in range(60)], "doc_id long, toxic int")
    assert Model.load(train(docs, labels)).constant == 0  # every row of class 1 is held out


def test_top_values_count_ties():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = rng.integers(1, 9, 5)
        out = rng.integers(0, 4, (sizes.sum(), 3)).astype(np.float32)
        starts = np.cumsum(sizes) - sizes
        got = top_values(out, np.repeat(np.arange(5), sizes), starts)
        for d in range(5):
            for f in range(3):
                want = sorted(out[starts[d] : starts[d] + sizes[d], f], reverse=True)[:TOP]
                assert got[d, f].tolist() == want + [0] * (TOP - len(want))


def test_scores_of_a_batch_are_those_of_its_texts():
    model = Model()
    texts = ["", "one", "one two three four", "x " * 50, "Idiot! clown clown", "é à ü"]
    alone = [model.scores([t])[0] for t in texts]
    assert np.allclose(model.scores(texts), alone, atol=1e-5)
    slow = []
    for t in texts:
        x = [model.table[__import__("tributary.llm.toxicity", fromlist=["rows_of"]).rows_of([w])[0]].mean(0) for w in words_of(t)]
        total = float(model.bias)
        for k, filt in enumerate(model.filters):
            n = len(x) - len(filt) + 1
            outs = np.array([sum(x[i + j] @ filt[j] for j in range(len(filt))) for i in range(n)]) if n > 0 else np.zeros((0, filt.shape[2]))
            outs = np.sort(np.maximum(outs, 0), axis=0)[::-1][:TOP]
            total += (outs * model.out[k, : len(outs)]).sum()
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(model.probabilities([words_of(t) for t in texts]), slow, atol=1e-4)


def test_scores_do_not_depend_on_order_or_batches():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 30, 300]))) for _ in range(200)]
    model = fit(texts[:150], [len(t) % 2 for t in texts[:150]])
    want = model.scores(texts)
    back = Model.load(model.dump())
    assert (back.scores(texts[::-1])[::-1] == want).all()
    assert (np.concatenate([back.scores(texts[k : k + 7]) for k in range(0, 200, 7)]) == want).all()
    assert [back.scores([t])[0] for t in texts] == want.tolist()


def test_calibration_and_languages():
    p = np.array([0.0, 0.2, 0.5, 0.75, 1.0])
    assert np.allclose(calibrated(p, np.full(5, 0.5)), [0, 0.12, 0.3, 0.65, 1])
    assert best_cut(np.array([0.1] * 10 + [0.9] * 10), np.array([0] * 10 + [1] * 10), 0.5) == pytest.approx(0.5, abs=0.1)
    assert [language_of(words_of(t)) for t in ("the cat of it", "le chat et la vie", "der Hund und das", "el gato y los", "qq zz")] == [0, 1, 2, 3, 4]


def test_learns_a_word_that_must_occur_twice():
    rng = random.Random(0)
    plain = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(900):
        n = rng.choice([0, 0, 1, 2, 4])
        words = rng.choices(plain, k=60) + ["vile"] * n
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(n > 1))
    model = fit(texts[:700], labels[:700])
    assert ((model.scores(texts[700:]) >= CUT) == np.array(labels[700:])).mean() > 0.95


def test_nulls_and_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (None, "word"), (4, "a " * 200_000), (4, "a " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 score", "'x' lang", "2 y", "3 t")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    left = remove_toxic(docs, labels.limit(0))
    assert left.columns == docs.columns and left.count() == 6
    assert toxicity(docs.limit(0), labels).count() == 0
    assert toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_every_labelled_row_is_learned_from(spark):
    """Each kind of insult is in few rows, so a fit on some of them knows few kinds; shards are many and small."""
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(1200):
        toxic = int(d % 3 == 0)
        words = rng.choices(plain, k=30) + [f"slur{d // 3 % 60}x{'abcdefgh'[k]}" for k in range(3)] * toxic
        rng.shuffle(words)
        rows.append((d, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = Model.load(train(docs, labels, rows=60))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert ((model.scores([t for _, t, _ in held]) >= CUT) == np.array([y for *_, y in held])).mean() > 0.95
    assert train(docs.repartition(5), labels.repartition(3), rows=60) == model.dump()


def test_a_long_text_is_learned_from(spark):
    docs = spark.createDataFrame([(d, "vile " * 50_000 if d % 2 else "kind " * 3) for d in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, toxic int")
    assert Model.load(train(docs, labels)).constant < 0  # both classes were seen

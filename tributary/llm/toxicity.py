"""A convolutional text classifier, trained in numpy, with thresholds calibrated by language.

A word's embedding is the mean of hashed rows for the word and for its beginnings (so words that share a
stem share most of it). Filters of several widths run over the words, and the ``TOP`` largest outputs of
each filter in a text (max pooling, kept several deep so that one passing word differs from two)
feed a logistic layer. Training follows the pooled positions only; it starts from embeddings whose first
dimension holds how much likelier a row is in texts of class 1 (``evidence``), which is an initial value
and trained on like all others.

The probability is calibrated by the language that the text itself looks like (counts of function words;
the column ``lang`` is not read): on labelled rows set apart, the threshold of the best F1 of each language
is moved to ``CUT``, by a straight line on either side.

The fit uses all labelled rows that are not held out, one whole text of each. A quarter of them is set apart for
the thresholds. Counts for the initial values and for the thresholds are sums over tasks. Training deals the other rows to
shards of some ``SHARD_ROWS``, a task each, which all start from the same model; of each group of parameters the model takes
the mean change over the shards that changed it, in whole numbers, so the order of the sums doesn't matter. The driver gets
counts and changes of fixed size. Scoring reads every text as a whole. The model is a few MB and of fixed
size. A score depends on its own text and the model alone, to the last bit: no window reaches into another
text of the batch, and sums are taken in a fixed order.

Defined cases: null text counts as empty; a text without words gets the score of the bias; a null doc_id is
scored and never held out; labels that are null or other than 0 and 1 are not learned from, and of labels
that contradict each other the larger counts; without labels of both classes every score is the share of
class 1 (0 without labels); a doc_id that repeats is learned from once, by its least text; repeated rows get
equal scores; extra columns are left alone; empty tables give no rows.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SHARD_ROWS = 8_000
BUCKETS, DIM, WIDTHS, FILTERS, TOP = 1 << 16, 8, (1, 2, 3), 6, 3
STEPS, RATE, SEED, CUT = 20_000, 0.05, 7, 0.3
#: A small shard is seen this often at most.
MAX_EPOCHS = 15
#: Beginnings of a word that have rows of their own, in bytes of UTF-8.
STEMS = (4, 5, 6, 7)
CACHE_WORDS = 300_000
#: Thresholds that are tried.
CUTS = np.linspace(0.05, 0.95, 91)
#: Changes of parameters are summed as whole numbers of this unit, in cells of ``DIM``.
UNIT = 2.0**-30
#: Labels that are broadcast at most; more are joined by a shuffle.
FEW_LABELS = 500_000
# Frequent function words by language.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "with", "for", "it", "was"),
    "fr": ("le", "la", "les", "et", "des", "est", "que", "dans", "pour", "une"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "den", "von", "mit", "ein"),
    "es": ("el", "los", "las", "y", "que", "para", "una", "por", "con", "en"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_words = re.compile(r"[^\W_]+").findall
_BY_WORD: dict[str, list[int]] = {}
for _k, _ws in enumerate(FUNCTION_WORDS.values()):
    for _w in _ws:
        _BY_WORD.setdefault(_w, []).append(_k)


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def language_of(words: list[str]) -> int:
    """The place in LANGUAGES of the language whose function words are most frequent."""
    counts = [0] * len(LANGUAGES)
    for w in filter(_BY_WORD.__contains__, words):
        for k in _BY_WORD[w]:
            counts[k] += 1
    counts[-1] = 0.5
    return counts.index(max(counts))


def rows_of(words: list[str]) -> np.ndarray:
    """For each word, the rows of the embedding table that its embedding is the mean of."""
    out: list[int] = []
    for w in words:
        code = w.encode()
        out.append(crc32(code))
        out += [crc32(code[:n], n) for n in STEMS]
    return (np.array(out, np.uint32) % BUCKETS).reshape(-1, 1 + len(STEMS))


class Model:
    """Embeddings, filters, the logistic layer and the thresholds by language."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.4, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS), TOP, FILTERS)).astype(np.float32)
        self.bias = np.float32(-1)
        self.cuts = np.full(len(LANGUAGES), 0.5)
        self.constant = np.float64(-1)
        self._prepare()

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, table=self.table, out=self.out, bias=self.bias, cuts=self.cuts, constant=self.constant, **{f"f{w}": x for w, x in zip(WIDTHS, self.filters, strict=True)})
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        got, self = np.load(io.BytesIO(data)), cls.__new__(cls)
        self.table, self.out, self.bias, self.cuts, self.constant = (got[k] for k in ("table", "out", "bias", "cuts", "constant"))
        self.filters = [got[f"f{w}"] for w in WIDTHS]
        self._prepare()
        return self

    def vector(self) -> np.ndarray:
        """All trained parameters, in cells of DIM."""
        flat = np.concatenate([x.ravel() for x in (self.table, *self.filters, self.out, np.array([self.bias]))]).astype(np.float64)
        return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)

    def set_vector(self, cells: np.ndarray) -> None:
        flat, at = cells.ravel().astype(np.float32), 0
        for x in (self.table, *self.filters, self.out):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        self.bias = flat[at]
        self._prepare()

    def _prepare(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.columns = sum(WIDTHS) * FILTERS
        #: What each known word gives to each filter at each of its places; row 0 is a break between texts.
        self.gives = np.zeros((1 << 12, self.columns), np.float32)
        self.flat = np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)

    def _learn_words(self, missing: list[str]) -> None:
        need = len(self.known) + len(missing)
        if need > len(self.gives):
            self.gives = np.concatenate([self.gives, np.zeros((max(need, 2 * len(self.gives)) - len(self.gives), self.columns), np.float32)])
        means = self.table[rows_of(missing)].mean(1)
        start = len(self.known)
        # one dimension after another, so that a word's figures don't depend on the words beside it
        self.gives[start : start + len(missing)] = sum(means[:, d : d + 1] * self.flat[d] for d in range(DIM))
        self.known.update(zip(missing, range(start, start + len(missing)), strict=True))

    def probabilities(self, texts: list[list[str]]) -> np.ndarray:
        """P(toxic) before calibration, for texts as lists of words."""
        if self.constant >= 0 or not texts:
            return np.full(len(texts), self.constant)
        missing = set().union(*texts) - self.known.keys()
        if len(self.known) + len(missing) > CACHE_WORDS and len(self.known) > 1:
            self._prepare()
            missing = set().union(*texts)
        if missing:
            self._learn_words(list(missing))
        gap = max(WIDTHS)
        sizes = np.array([len(words) + gap for words in texts])
        starts = np.cumsum(sizes) - sizes
        breaks = [""] * gap
        every = chain.from_iterable(chain(words, breaks) for words in texts)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, sizes.sum())
        doc = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(starts + sizes - gap, sizes) - np.arange(sizes.sum())  # words from here to the end of the text
        logit = np.full(len(texts), np.float64(self.bias))
        column = 0
        for k, width in enumerate(WIDTHS):
            out = self.gives[at, column : column + FILTERS]
            for j in range(1, width):
                out[:-j] += self.gives[at[j:], column + j * FILTERS : column + (j + 1) * FILTERS]
            column += width * FILTERS
            np.maximum(out, 0, out=out)
            out[left < width] = 0  # a window lies within its text
            for given in (top_values(out, doc, starts) * self.out[k].T[None]).reshape(len(texts), -1).T:
                logit += given
        return 1 / (1 + np.exp(-logit))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated scores of whole texts."""
        split = [words_of(t) for t in texts]
        p = np.empty(len(texts))
        # long texts are taken few at a time
        edges, size = [0], 0
        for i, words in enumerate(split):
            size += len(words)
            if size > 400_000 and i + 1 < len(split):
                edges.append(i + 1)
                size = 0
        for a, b in zip(edges, [*edges[1:], len(split)], strict=True):
            if a < b:
                p[a:b] = self.probabilities(split[a:b])
        if self.constant >= 0:
            return p
        return calibrated(p, self.cuts[[language_of(w) for w in split]])


def top_values(out: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, filters, TOP): the largest outputs of each filter in each text, equal ones counted as often as they occur."""
    out = out.copy()
    tops = np.zeros((len(starts), out.shape[1], TOP), np.float32)
    filled = np.zeros(tops.shape[:2], np.int64)
    for _ in range(TOP):
        most = np.maximum.reduceat(out, starts)
        is_top = out == most[doc]
        many = np.add.reduceat(is_top, starts, dtype=np.int64)
        for place in range(TOP):
            here = (filled <= place) & (place < filled + many)
            tops[..., place] = np.where(here, np.maximum(most, 0), tops[..., place])
        filled += many
        if (filled >= TOP).all():
            break
        out[is_top] = -1
    return tops


def calibrated(p: np.ndarray, cut_at: np.ndarray) -> np.ndarray:
    """p with the cut moved to CUT: straight lines from 0 to the cut and from there to 1."""
    return np.where(p < cut_at, CUT * p / cut_at, CUT + (1 - CUT) * (p - cut_at) / (1 - cut_at))


class Coded:
    """Texts as places in a vocabulary, and the rows of the vocabulary's words; the order of the vocabulary doesn't matter."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.docs: list[np.ndarray] = []

    def add(self, words: list[str]) -> None:
        place = self.vocabulary
        self.docs.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))

    def rows(self) -> np.ndarray:
        return rows_of(list(self.vocabulary))


def begun(counts: np.ndarray, sizes: np.ndarray) -> Model:
    """The model that training starts from, by the counts of ``row_counts`` and the texts of each class."""
    model = Model()
    model.table[:, 0] += evidence(counts, sizes)
    for filt in model.filters:
        filt[:, 0] += 0.4
    return model


def trained(model: Model, docs: list[np.ndarray], y: np.ndarray, rows: np.ndarray, weight: float) -> None:
    """Train the model on texts of ``Coded``, in an order that their own order and SEED give."""
    rng = np.random.default_rng(SEED)
    moments = [np.full_like(x, 1e-2) for x in (model.table, *model.filters, model.out)]
    bias_moment = 1e-2

    def step(x: np.ndarray, moment: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        moment[at] += grad * grad
        x[at] -= RATE * grad / np.sqrt(moment[at])

    steps = max(len(docs), min(STEPS, MAX_EPOCHS * len(docs)))
    for i in islice((i for _ in range(steps) for i in rng.permutation(len(docs))), steps):
        own = rows[docs[i]]
        x = model.table[own].mean(1)
        pooled = np.zeros((len(WIDTHS), TOP, FILTERS), np.float32)
        where: list[tuple[np.ndarray, np.ndarray] | None] = []
        for k, (width, filt) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            n = len(x) - width + 1
            if n < 1:
                where.append(None)
                continue
            out = sum(x[j : j + n] @ filt[j] for j in range(width))
            best = np.argpartition(-out, TOP - 1, axis=0)[:TOP] if n > TOP else np.arange(n)[:, None].repeat(FILTERS, 1)
            values = np.take_along_axis(out, best, 0)
            down = np.argsort(-values, axis=0)
            best, values = np.take_along_axis(best, down, 0), np.take_along_axis(values, down, 0)
            pooled[k, : len(best)] = np.maximum(values, 0)
            where.append((best, values > 0))
        p = 1 / (1 + np.exp(-float((pooled * model.out).sum() + model.bias)))
        error = np.float32((p - y[i]) * (weight if y[i] else 1))
        if abs(error) < 0.03:
            continue
        outward = error * model.out
        step(model.out, moments[-1], error * pooled + 1e-4 * model.out)
        bias_moment += float(error) ** 2
        model.bias -= np.float32(RATE * error / np.sqrt(bias_moment))
        touched, pulls = [], []
        for k, filt in enumerate(model.filters):
            if where[k] is None:
                continue
            best, on = where[k]
            g = outward[k, : len(best)] * on
            grad = np.zeros_like(filt)
            for j in range(len(filt)):
                seen = best + j
                grad[j] = np.einsum("tf,tfd->df", g, x[seen])
                touched.append(seen.ravel())
                pulls.append((g[..., None] * filt[j].T[None]).reshape(-1, DIM))
            step(filt, moments[1 + k], grad)
        if touched:
            of = own[np.concatenate(touched)]
            row, back = np.unique(of.ravel(), return_inverse=True)
            total = np.zeros((len(row), DIM), np.float32)
            np.add.at(total, back, np.repeat(np.concatenate(pulls) / of.shape[1], of.shape[1], axis=0))
            step(model.table, moments[0], total, row)
    model._prepare()


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model of one shard: three quarters of the rows to train on, the rest for the thresholds. The order of the rows doesn't matter."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    split, y = [words_of(texts[i]) for i in order], np.array([labels[i] for i in order], np.int64)
    sizes = np.bincount(y, minlength=2)
    if not sizes.all():
        return constant(sizes)
    apart = np.random.default_rng(SEED).permutation(len(y)) % 4 == 0
    coded, learned = Coded(), y[~apart]
    for i in np.flatnonzero(~apart):
        coded.add(split[i])
    rows = coded.rows()
    model = begun(row_counts(coded.docs, learned, rows), np.bincount(learned, minlength=2))
    trained(model, coded.docs, learned, rows, class_weight(sizes))
    held = np.flatnonzero(apart)
    model.cuts = thresholds(cut_counts(model, [split[i] for i in held], y[held]))
    return model


def constant(sizes: np.ndarray) -> Model:
    """The model where there aren't labels of both classes."""
    model = Model()
    model.constant = np.float64(sizes[1] / max(1, sizes.sum()))
    return model


def class_weight(sizes: np.ndarray) -> float:
    return min(4.0, sizes[0] / max(1, sizes[1]))


def row_counts(docs: list[np.ndarray], y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): in how many texts of each class a row occurs."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for d, k in zip(docs, y, strict=True):
        counts[k, np.unique(rows[d])] += 1
    return counts


def cut_counts(model: Model, split: list[list[str]], y: np.ndarray) -> np.ndarray:
    """(languages, 2, cuts + 1): how many texts of each language and class reach so many of CUTS."""
    out = np.zeros((len(LANGUAGES), 2, len(CUTS) + 1), np.int64)
    reached = np.searchsorted(CUTS, model.probabilities(split), side="right")
    np.add.at(out, ([language_of(w) for w in split], y, reached), 1)
    return out


def thresholds(counts: np.ndarray) -> np.ndarray:
    """The threshold of each language; of all texts together where a language has few."""
    overall = best_of(counts.sum(0), 0.5)
    return np.array([best_of(c, overall) for c in counts])


def evidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where training starts from: how much more often a row occurs in texts of class 1, drawn to 0 where it is rare."""
    total = counts.sum(0)
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    return np.clip(odds * np.maximum(total - 1, 0) / (total + 3), -3, 3).astype(np.float32)


def best_of(counts: np.ndarray, otherwise: float) -> float:
    """The middle of the cuts with the best F1, if there are enough rows of both classes, by counts of class and cuts reached."""
    if counts.sum(1).min() < 8:
        return otherwise
    over = counts.sum(1, keepdims=True) - np.cumsum(counts, 1)[:, :-1]  # rows of each class that reach each cut
    f1 = 2 * over[1] / np.maximum(1, over.sum(0) + counts[1].sum())
    return float(np.median(CUTS[f1 >= f1.max() - 1e-9]))


def best_cut(p: np.ndarray, y: np.ndarray, otherwise: float) -> float:
    """``best_of`` of probabilities and classes."""
    counts = np.zeros((2, len(CUTS) + 1), np.int64)
    np.add.at(counts, (y, np.searchsorted(CUTS, p, side="right")), 1)
    return best_of(counts, otherwise)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(k, t, y, apart), a row for each labelled document that isn't held out, and how many labels there are; t is its least text."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    size = known.count()
    ids = F.broadcast(known) if size <= FEW_LABELS else known
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(ids, "doc_id")
    if not documents.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    return rows.select(F.col("doc_id").cast("string").alias("k"), "t", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("apart")), size


def _sums(rows: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]], *names: str) -> list[np.ndarray]:
    """The sums over all tasks of the whole numbers ``names`` that ``made`` gives for each place ``i``: i and the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int64)) for k, v in made(batches).items()})

    found = rows.mapInArrow(run, ", ".join(f"{n} long" for n in ("i", *names))).groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    return [found[n].to_numpy() for n in ("i", *names)]  # at most one row for each place


def train(documents: DataFrame, labels: DataFrame, rows: int = SHARD_ROWS) -> bytes:
    """The model, fitted on all labelled rows that are not held out, in shards of some ``rows``."""
    spark = documents.sparkSession
    small_batches(spark)
    known, size = learned(documents, labels)

    def counted(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        counts, sizes = np.zeros((2, BUCKETS), np.int64), np.zeros((2, 2), np.int64)
        for b in batches:
            coded, y, apart = Coded(), b.column("y").to_numpy(), b.column("apart").to_numpy(zero_copy_only=False)
            np.add.at(sizes, (apart.astype(int), y), 1)
            for i in np.flatnonzero(~apart):
                coded.add(words_of(b.column("t")[i].as_py()))
            if coded.docs:
                counts += row_counts(coded.docs, y[~apart], coded.rows())
        flat = np.concatenate([counts.ravel(), sizes.ravel()])
        return {"i": np.flatnonzero(flat), "n": flat[flat > 0]}

    flat = np.zeros(2 * BUCKETS + 4, np.int64)
    at, n = _sums(known, counted, "n")
    flat[at] = n
    counts, by_part = flat[:-4].reshape(2, -1), flat[-4:].reshape(2, 2)
    sizes = by_part.sum(0)
    if not sizes.all():
        return constant(sizes).dump()
    model, weight = begun(counts, by_part[0]), class_weight(sizes)
    start = spark.sparkContext.broadcast(model.dump())

    def changed(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        own, coded, keys, ys = Model.load(start.value), Coded(), [], []
        for b in batches:
            keys += b.column("k").to_pylist()
            ys += b.column("y").to_pylist()
            for t in b.column("t"):
                coded.add(words_of(t.as_py()))
        order, before = sorted(range(len(keys)), key=keys.__getitem__), own.vector()
        if keys:
            trained(own, [coded.docs[i] for i in order], np.array(ys)[order], coded.rows(), weight)
        moved = np.rint((own.vector() - before) / UNIT).astype(np.int64)
        cells = np.flatnonzero(moved.any(1))
        return {"i": cells, "shards": np.ones(len(cells)), **{f"d{j}": moved[cells, j] for j in range(DIM)}}

    shards = -(-size // rows)
    dealt = known.filter(~F.col("apart")).repartitionById(shards, F.pmod(F.xxhash64(F.lit("shard"), "k"), F.lit(shards)).cast("int"))
    at, n, *moved = _sums(dealt, changed, "shards", *[f"d{j}" for j in range(DIM)])
    cells = model.vector()
    cells[at] += np.stack(moved, 1) / n[:, None] * UNIT
    model.set_vector(cells)
    fitted = spark.sparkContext.broadcast(model.dump())

    def reached(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        own, out = Model.load(fitted.value), 0
        for b in batches:
            if b.num_rows:
                out = out + cut_counts(own, [words_of(t.as_py()) for t in b.column("t")], b.column("y").to_numpy())
        flat = np.ravel(out)
        return {"i": np.flatnonzero(flat), "n": flat[flat > 0]}

    flat = np.zeros((len(LANGUAGES), 2, len(CUTS) + 1), np.int64)
    at, n = _sums(known.filter("apart"), reached, "n")
    flat.ravel()[at] = n
    model.cuts = thresholds(flat)
    return model.dump()


_models: dict[int, Model] = {}


def scorer(model: bytes, spark) -> Callable[[Column], Column]:
    """A column function that gives the score of a text."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        data = held.value
        if hash(data) not in _models:
            _models.clear()
            _models[hash(data)] = Model.load(data)
        for texts in batches:
            yield pd.Series(_models[hash(data)].scores(texts.tolist()))

    return lambda text: score(F.coalesce(text, F.lit("")))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(train(documents, labels), documents.sparkSession)
    scored = documents.select("doc_id", held_out().alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def remove_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose score is under the cut, with all their columns."""
    score = scorer(train(documents, labels), documents.sparkSession)
    return documents.filter(score(F.col("text")) < CUT)

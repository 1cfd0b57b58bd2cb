"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are words and their prefixes, so inflected forms of one stem share a
weight. One weight vector serves all thresholds: P(grade > k) is the logistic
of w.x - t[k]. A document's expected severity is the sum of these
probabilities; it is toxic if P(grade > 0) is at least one half.

The labels have two classes, so toxic training rows are graded by how many of
their words carry toxic features: 1 up to the median, 2 beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import textkit
from packetloom.storage import materialize

#: Bounds of the training sample: so many labelled rows of each class, in the order of a hash of doc_id.
SAMPLE_ROWS = 4000
#: Most features that a model has, and the least number of toxic training rows that show one.
MOST_FEATURES = 5000
LEAST_ROWS = 4
PREFIXES = range(3, 11)
#: Odds of toxic rows against others from which a feature counts for the grade of a training row.
TOXIC_ODDS = 20.0
CUTS = 2
_L2, _ROUNDS, _RATE = 2e-5, 600, 0.1


def word_features(words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features, and the index of the word that each is of: byte prefixes, and the word itself."""
    lengths = words.ends - words.starts
    at, total = np.arange(len(lengths)), np.zeros(len(lengths), dtype=np.uint64)
    hashes, index = [textkit.mix64(words.hashes ^ np.uint64(0x5851F42D4C957F2D))], [at]
    for i, p in enumerate(textkit.powers(0x9E3779B97F4A7C15, PREFIXES.stop - 1)):
        more = lengths[at] > i
        at, total = at[more], total[more]
        total = total + (words.data[words.starts[at] + i].astype(np.uint64) + np.uint64(1)) * p
        if i + 1 in PREFIXES:
            hashes.append(textkit.mix64(total + np.uint64(i + 1)))
            index.append(at)
    return np.concatenate(hashes), np.concatenate(index)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, textkit.Words]]:
    texts = textkit.column_bytes(column)
    for begin, end in textkit.chunks(texts):
        yield begin, end, textkit.words_of(texts[begin:end], textkit.ALNUM, lower=True)


@dataclass
class Model:
    """``features`` are sorted hashes; ``odds`` are the training rows' odds of each."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    odds: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.features & np.uint64((1 << 20) - 1)).view(np.int64)] = True

    def counts(self, words: textkit.Words, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, feature and count of the features found, and each document's number of words with a toxic one."""
        hashes, index = word_features(words)
        may = np.flatnonzero(self.sieve[(hashes & np.uint64((1 << 20) - 1)).view(np.int64)])
        hashes, index = hashes[may], index[may]
        found = np.minimum(np.searchsorted(self.features, hashes), max(len(self.features) - 1, 0))
        hit = self.features[found] == hashes if len(self.features) else np.zeros(0, dtype=bool)
        found, index = found[hit], index[hit]
        toxic_words = np.unique(index[self.odds[found] > TOXIC_ODDS])
        cells, counts = np.unique(words.doc[index] * max(len(self.features), 1) + found, return_counts=True)
        return cells // max(len(self.features), 1), cells % max(len(self.features), 1), counts, np.bincount(words.doc[toxic_words], minlength=n_docs)

    def exceedance(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k."""
        return _logistic(scores[:, None] - self.cuts[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, row_weights: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising cuts of a cumulative-link model, by Adam on the weighted likelihood with an L2 term."""
    n, share = len(grades), row_weights / row_weights.sum()
    weights, first, gaps = np.zeros(n_features), np.array([1.0]), np.zeros(CUTS - 1)
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (weights, first, gaps)]
    for t in range(1, _ROUNDS + 1):
        cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        scores = np.bincount(rows, weights=values * weights[columns], minlength=n)
        above = np.column_stack([np.ones(n), _logistic(scores[:, None] - cuts[None, :]), np.zeros(n)])
        slope = above * (1 - above)
        index = np.arange(n)
        p = np.maximum(above[index, grades] - above[index, grades + 1], 1e-12)
        # Of the log likelihood, by the score and by each cut.
        by_score = share * (slope[index, grades] - slope[index, grades + 1]) / p
        by_cut = np.zeros(CUTS + 2)
        np.add.at(by_cut, grades, -share * slope[index, grades] / p)
        np.add.at(by_cut, grades + 1, share * slope[index, grades + 1] / p)
        by_cut = by_cut[1:-1]
        gradients = (
            -np.bincount(columns, weights=values * by_score[rows], minlength=n_features) + _L2 * weights,
            -np.array([by_cut.sum()]),
            -np.array([by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(CUTS - 1)]),
        )
        for (parameter, mean, square), g in zip(state, gradients):
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            parameter -= _RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return weights, first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of at most ``rows`` labelled documents of each class, and the classes' sizes.

    The ids are chosen first; at most 2 * ``rows`` of them are broadcast, so the
    texts are not shuffled.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialize(known)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    chosen = materialize(chosen[0].union(chosen[1]))
    return materialize(documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").join(F.broadcast(chosen), "doc_id")), sizes


def _feature_rows(sample: DataFrame) -> DataFrame:
    """(feature, toxic rows, other rows), summed within each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for begin, _, words in _chunks(batch.column(0)):
                hashes, index = word_features(words)
                doc = words.doc[index]
                _, once = np.unique(hashes + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), return_index=True)
                features, inverse = np.unique(hashes[once], return_inverse=True)
                of_toxic = np.bincount(inverse, weights=toxic[begin + doc[once]], minlength=len(features)).astype(np.int64)
                every = np.bincount(inverse, minlength=len(features))
                yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(of_toxic), pa.array(every - of_toxic)], ["feature", "t", "c"])

    return sample.select("text", "toxic").mapInArrow(count, "feature long, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_features: int = MOST_FEATURES) -> Model:
    """Fit a model on a bounded sample; without toxic or other labelled rows it calls nothing toxic."""
    sample, sizes = training_sample(documents, labels, rows)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(CUTS, 40.0), np.zeros(0))
    if not n.get(0) or not n.get(1):
        return nothing
    odds = (F.col("t") + 0.5) / n[1] / ((F.col("c") + 0.5) / n[0])
    least = min(LEAST_ROWS, max(1, n[1] // 4))
    told = _feature_rows(sample).where((F.col("t") >= least) & (odds > 2)).select("feature", odds.alias("odds"), (F.col("t") * F.log(odds)).alias("gain"))
    picked = told.orderBy(F.desc("gain"), "feature").limit(most_features).toPandas()
    if picked.empty:
        return nothing
    features = picked["feature"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(features)
    model = Model(features[order], np.zeros(len(order)), np.zeros(CUTS), picked["odds"].to_numpy()[order])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, words in _chunks(batch.column(1)):
                doc, feature, count, toxic_words = model.counts(words, end - begin)
                bounds = np.searchsorted(doc, np.arange(end - begin + 1))
                lists = [[x[a:b] for a, b in zip(bounds[:-1], bounds[1:])] for x in (feature, count)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), batch.column(2).slice(begin, end - begin), *(pa.array(x, pa.list_(pa.int64())) for x in lists), pa.array(toxic_words, pa.int64())],
                    ["doc_id", "toxic", "feature", "count", "toxic_words"],
                )

    coded = sample.select("doc_id", "text", "toxic").mapInArrow(encode, "doc_id long, toxic int, feature array<bigint>, count array<bigint>, toxic_words long")
    # At most 2 * rows rows.
    got = coded.toPandas().sort_values(["doc_id", "toxic_words"], ignore_index=True)
    toxic = got["toxic"].to_numpy(dtype=np.int64)
    toxic_words = got["toxic_words"].to_numpy()
    grades = toxic + (toxic & (toxic_words > np.median(toxic_words[toxic == 1]))).astype(np.int64)
    index = np.repeat(np.arange(len(got)), got["feature"].map(len))
    columns, counts = (np.concatenate(got[c].to_list()).astype(np.int64) for c in ("feature", "count"))
    row_weights = np.array([sizes[k] / n[k] for k in (0, 1)])[toxic]
    model.weights, model.cuts = fit_ordinal(index, columns, np.log1p(counts), grades, row_weights, len(features))
    return model


def _rate(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected severities, most likely grades and toxic flags of a column of texts."""
    above = [np.zeros((0, CUTS))]
    for begin, end, words in _chunks(column):
        doc, feature, count, _ = model.counts(words, end - begin)
        above.append(model.exceedance(np.bincount(doc, weights=np.log1p(count) * model.weights[feature], minlength=end - begin)))
    every = np.concatenate(above)
    return every.sum(axis=1), (every >= 0.5).sum(axis=1).astype(np.int32), every[:, 0] >= 0.5


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, grade, toxic for every row; the model, of bounded size, is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severities, grades, flags = _rate(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severities), pa.array(grades), pa.array(flags)], ["doc_id", "severity", "grade", "toxic"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(rate, "doc_id long, severity double, grade int, toxic boolean")


def grade_documents(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on ``labels`` (doc_id, toxic) and grade every row of ``documents`` (doc_id, text).

    A null or empty text shows no features and gets the score 0. Of several
    labels of a doc_id the largest holds; labels that are null or neither 0 nor
    1, and rows without doc_id, do not train. Repeated rows are graded alike;
    other columns are left out; an empty table gives no rows.
    """
    return score(documents, train(documents, labels, rows))


def remove_toxic(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` without the rows that a model trained on ``labels`` finds toxic; all columns stay, no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels, rows))
    position = documents.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, flags = _rate(batch.column(position), shared.value)
            yield batch.filter(pa.array(~flags))

    return documents.mapInArrow(keep, documents.schema)

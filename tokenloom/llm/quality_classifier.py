"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of a text (lengths, shares of kinds of characters, repetition) are standardised with sums over
all documents. Random Fourier features approximate a Gaussian kernel over them. Each partition of the
training rows sums its part of the normal equations for each of FOLDS folds; the sums are small and fixed in
size, so the ridge weights, for all rows and without each fold, are solved on the driver. Scores of rows by
the weights that have not seen them, binned, give the isotonic calibration.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import free_name, keep_rows, sliced, stage, summed, texts
from tokenloom.llm.labels import held_out, training_labels
from tokenloom.llm.quality_rules import counts_of

#: The held-out fold: crc32(doc_id as text) mod 4 is 2.
FOLD = (4, 2)
#: Scores from here on count as good.
ACCEPT = 0.7
FEATURES, FOLDS, RIDGE, SEED = 128, 5, 1e-3, 20_240_501
#: Bins of uncalibrated scores between -0.5 and 1.5.
BINS = 512
_NAMES = ["words", "word_length", "symbols", "dup_lines", "repeats", "upper", "line_words", "digits", "punctuation", "exclamations", "bars", "wide", "distinct", "top_word", "marked_words", "titled_words"]
_DIGITS, _PUNCTUATION, _MARKS = b"0123456789", b".,;:?'\"()-", set("#*$%&|<>!")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of _NAMES; finite for any text, 0 for a null or empty one."""
    n, chars, symbols, lines, dup_lines, repeats, upper = counts_of(text)
    if not n:
        return [0.0] * len(_NAMES)
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    share = lambda some: (len(raw) - len(raw.translate(None, some))) / chars
    count = Counter(words)
    m = max(1, len(words))
    return [
        np.log1p(n), min(chars / n, 40), min(symbols / n, 5), dup_lines / max(1, lines), repeats / n, upper / chars, np.log1p(n / max(1, lines)),
        share(_DIGITS), share(_PUNCTUATION), share(b"!"), share(b"|"), (len(raw) - len(text)) / len(raw), len(count) / m, max(count.values(), default=0) / m,
        sum(c for w, c in count.items() if w[-1] in _MARKS) / m, sum(c for w, c in count.items() if w[0].isupper()) / m,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, x (array of statistics), one row per row."""

    def run(batches):
        for batch in batches:
            found = [statistics(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Standardisation, random features, ridge weights and calibration; small and independent of the corpus' size."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        random = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.frequencies = random.normal(0, 1 / np.sqrt(len(mean)), (len(mean), FEATURES))
        self.phases = random.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros((FOLDS + 1, FEATURES + 1))
        self.knots = np.array([[0.0, 0.5]])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.frequencies + self.phases), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights[-1], self.knots[:, 0], self.knots[:, 1]), 0, 1)


def fold_of(doc_id: np.ndarray) -> np.ndarray:
    return ((doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: knots (x, fitted y) of the best non-decreasing fit to y in order of x."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([[a / w, b / w] for a, b, w in blocks])


def _sums(rows: DataFrame, model: Model) -> np.ndarray:
    """Normal equations of each fold: FOLDS x (FEATURES + 1) x (FEATURES + 2), the last column for the labels."""
    shape = (FOLDS, FEATURES + 1, FEATURES + 2)

    def equations(batch) -> np.ndarray:
        total = np.zeros(shape)
        x, y = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(_NAMES)), batch.column("y").to_numpy().astype(float)
        fold, z = fold_of(batch.column("doc_id").to_numpy()), model.features(x)
        for k in range(FOLDS):
            own = fold == k
            total[k] = z[own].T @ np.hstack([z[own], y[own, None]])
        return total.reshape(-1)

    return summed(rows, equations, int(np.prod(shape))).reshape(shape)


def fit(measured: DataFrame, labels: DataFrame) -> Model:
    """A model from document_statistics' rows and labels(doc_id, y).

    Without any labels scores are 0.5; with labels of one class they are about that class' share.
    """
    moments = measured.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    at = {r["i"]: r for r in moments}
    model = Model(np.array([at[i]["m"] if i in at else 0.0 for i in range(len(_NAMES))]), np.array([at[i]["s"] if i in at else 1.0 for i in range(len(_NAMES))]))
    rows = stage(measured.join(labels, "doc_id"), "training")
    sums = _sums(rows, model)
    whole = sums.sum(0)
    n = whole[-1, FEATURES]
    if not n:
        return model

    def solved(total: np.ndarray) -> np.ndarray:
        penalty = np.diag(np.r_[np.full(FEATURES, RIDGE * max(1.0, total[-1, FEATURES])), 1e-9])
        return np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    model.weights = np.array([solved(whole - s) for s in sums] + [solved(whole)])
    weights = model.weights

    def unseen(batches):
        for batch in batches:
            z, fold = model.features(np.array(batch.column("x").to_pylist(), float).reshape(-1, len(_NAMES))), fold_of(batch.column("doc_id").to_numpy())
            raw = (z * weights[fold]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int64)), batch.column("y").cast(pa.int64())], names=["bin", "y"])

    bins = rows.mapInArrow(unseen, "bin long, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    b = np.array([[r["bin"], r["n"], r["good"]] for r in bins], float)
    prior = b[:, 2].sum() / b[:, 1].sum()
    model.knots = isotonic((b[:, 0] + 0.5) * 2 / BINS - 0.5, (b[:, 2] + prior) / (b[:, 1] + 1), b[:, 1] + 1)
    return model


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier accepts; it is fitted as in score_quality().

    Texts are measured once, and rows stand with their statistics in the shared folder until they are judged.
    Null and empty texts are judged like others, repeated rows each for itself; columns of any name come
    through, an empty table gives an empty table.
    """
    x = free_name(docs, "x")
    measure = F.arrow_udf(lambda column: sliced(column, lambda some: [statistics(t) for t in some], pa.list_(pa.float64())), "array<double>")
    measured = stage(docs.withColumn(x, measure(F.col("text").cast("string"))), "statistics")
    model = fit(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(x).alias("x")), training_labels(labels, "quality", *FOLD))
    return keep_rows(measured, x, lambda some: model.score(np.array(some, float).reshape(-1, len(_NAMES))) >= ACCEPT)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted, one row per row.

    All labels outside the held-out fold are learned from, and no others. Null and empty texts
    have statistics of 0 and are scored like any other; equal texts have equal scores; a null doc_id is not
    held out; an empty table gives an empty table; other columns are ignored, whatever their names.
    """
    measured = stage(document_statistics(docs), "statistics")
    model = fit(measured, training_labels(labels, "quality", *FOLD))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(_NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scored = measured.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), *FOLD).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))

"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

1. Each text is measured as a whole: shares of character classes, word and line shapes,
   repetition.  Language, source and ids are not inputs.
2. Random Fourier features approximate a Gaussian kernel over the standardized measures.
   Every task sums its share of the normal equations over labelled rows; the sums, whose
   size depends on the number of features only, are added by row and solved.
3. Raw scores of a calibration fold are counted in bins; pool-adjacent-violators on the
   bins turns scores into rising probabilities.

All labelled rows outside the held-out fold are used: three of the four remaining folds for
the fit, one for calibration.

Defined results: a null or empty text is measured as one without characters; without labels
of both classes every score is the share of label 1 (0.5 without any); rows with equal ids
share labels; an empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table
from logharbor.llm.textcode import Texts, distinct_by_text
from logharbor.llm.tokens import blocks_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = 256
BINS = 2000
LOW, HIGH = -0.5, 1.5
#: Score from which a document counts as good.
THRESHOLD = 0.3


def _byte_classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 line break,
    6 sentence mark, 7 symbol, 8 bar, 9 exclamation, 10 part of a non-ASCII character."""
    out = np.zeros(256, dtype=np.int64)
    out[65:91], out[97:123], out[48:58] = 1, 2, 3
    out[[32, 9, 11, 12, 13]], out[10] = 4, 5
    out[[ord(c) for c in ".,;:?"]] = 6
    out[[ord(c) for c in "#*$%&<>{}\\^~_=+@"]] = 7
    out[ord("|")], out[ord("!")] = 8, 9
    out[128:] = 10
    return out


_CLASSES = 11
MEASURES = _CLASSES + 11


def measure_texts(texts: list[str]) -> np.ndarray:
    """Measures of each text, one row a text."""
    t = Texts(texts)
    out = np.zeros((t.n, MEASURES))
    inside = np.repeat(np.arange(t.n), t.lengths + 1)
    classes = _byte_classes()[t.bytes]
    counts = np.bincount(inside * _CLASSES + classes, minlength=t.n * _CLASSES)
    counts = counts.reshape(t.n, _CLASSES).astype(float)
    counts[:, 4] -= 1  # the closing space
    size = np.maximum(t.lengths, 1)[:, None]
    out[:, :_CLASSES] = np.sqrt(counts / size)
    words = np.maximum(t.words_of, 1)
    out[:, _CLASSES] = np.log1p(t.words_of)
    out[:, _CLASSES + 1] = np.log1p((t.lengths - counts[:, 4] - counts[:, 5]) / words)
    out[:, _CLASSES + 2] = np.log1p(words / (counts[:, 5] + 1))
    out[:, _CLASSES + 3] = np.log1p(counts[:, 7] / words)
    out[:, _CLASSES + 4] = np.log1p(counts[:, 8] / words)
    out[:, _CLASSES + 5] = np.log1p(counts[:, 9] / words)
    if len(t.word_start):
        hashes = t.word_hashes()
        text, _ = distinct_by_text(t.word_text, hashes)
        out[:, _CLASSES + 6] = np.bincount(text, minlength=t.n) / words
        # words that begin in upper case and words all of whose bytes are upper case
        upper = classes == 1
        heads = np.bincount(t.word_text, weights=upper[t.word_start], minlength=t.n)
        run = np.concatenate([[0], np.cumsum(upper)])
        lower = np.concatenate([[0], np.cumsum((classes == 2) | (classes == 10))])
        loud = (run[t.word_end] - run[t.word_start] > 0) & (
            lower[t.word_end] == lower[t.word_start]
        )
        out[:, _CLASSES + 7] = heads / words
        out[:, _CLASSES + 8] = np.bincount(t.word_text, weights=loud, minlength=t.n) / words
        text, h = t.shingles(5)
        once, _ = distinct_by_text(text, h)
        runs = np.maximum(np.bincount(text, minlength=t.n), 1)
        out[:, _CLASSES + 9] = 1 - np.bincount(once, minlength=t.n) / runs
    # repeated lines
    ends = np.flatnonzero(classes == 5)
    stops = np.unique(np.concatenate([ends, t.starts + t.lengths]))
    begins = np.concatenate([[0], stops[:-1] + 1])
    full = stops > begins
    begins, stops = begins[full], stops[full]
    if len(begins):
        line_text = np.searchsorted(t.starts, begins, side="right") - 1
        lines = np.bincount(line_text, minlength=t.n)
        text, _ = distinct_by_text(line_text, t.range_hashes(begins, stops))
        out[:, _CLASSES + 10] = 1 - np.bincount(text, minlength=t.n) / np.maximum(lines, 1)
    out[t.words_of == 0, _CLASSES + 6 :] = 0
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in blocks_of(texts, 1_000_000):
            x = measure_texts(texts[part])
            ends = np.arange(len(x) + 1, dtype=np.int32) * MEASURES
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
            ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([ids, lists], ["doc_id", "x"])


def _points(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text."""
    return docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).alias("text"),
    ).mapInArrow(_measured, "doc_id bigint, x array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


class Fourier:
    """Standardized measures, a constant and cosines of random projections."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), features)) / np.sqrt(len(mean) / 2)
        self.b = rng.uniform(0, 2 * np.pi, size=features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cosines = np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([np.ones((len(z), 1)), z / np.sqrt(z.shape[1]), cosines])


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, s, q = 0, np.zeros(MEASURES), np.zeros(MEASURES)
    for pdf in batches:
        if len(pdf):
            x = np.stack(pdf["x"])
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    yield pd.DataFrame({"i": np.arange(MEASURES), "n": n, "s": s, "q": q})


def _normal_equations(batches: Iterator[pd.DataFrame], make: Fourier) -> Iterator[pd.DataFrame]:
    """Rows of [Z'Z | Z'y] of this task."""
    total = None
    for pdf in batches:
        if not len(pdf):
            continue
        z = make(np.stack(pdf["x"]))
        y = pdf["quality"].to_numpy(dtype=float)
        part = z.T @ np.hstack([z, y[:, None]])
        total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})


def _add_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": pdf["i"].iloc[:1], "row": [np.sum(np.stack(pdf["row"]), axis=0)]})


def pool_adjacent(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Rising shares of ``ones`` in ``n`` by bin; empty bins are filled in between."""
    blocks: list[list[float]] = []  # weight, ones, first bin, last bin
    for i in np.flatnonzero(n):
        blocks.append([float(n[i]), float(ones[i]), i, i])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w, o, _, last = blocks.pop()
            blocks[-1][0] += w
            blocks[-1][1] += o
            blocks[-1][3] = last
    at = [(b[2] + b[3]) / 2 for b in blocks]
    return np.interp(np.arange(len(n)), at, [b[1] / b[0] for b in blocks])


class Model:
    def __init__(self, make: Fourier, beta: np.ndarray, levels: np.ndarray):
        self.make, self.beta, self.levels = make, beta, levels

    def place(self, x: np.ndarray) -> np.ndarray:
        raw = self.make(x) @ self.beta
        return np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.place(x), np.arange(BINS) + 0.5, self.levels), 0, 1)


def fit(measured: DataFrame, labels: DataFrame, features: int, ridge: float, seed: int):
    """The model, or the share of label 1 where the labels cannot tell classes apart."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")
    )
    labelled = staged(
        measured.join(known, F.col("doc_id") == F.col("label_id"))
        .withColumn("fold", fold(F.col("doc_id")))
        .where("fold != 0")
        .select("x", "quality", "fold"),
        "labelled",
    )
    seen = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not 0 < seen[1] < seen[0]:
        return seen[1] / seen[0] if seen[0] else 0.5
    fitted = labelled.where("fold > 1")
    if not fitted.limit(1).count():
        fitted = labelled
    moments = (
        fitted.mapInPandas(_moments, "i int, n bigint, s double, q double")
        .groupBy("i")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
        .orderBy("i")
        .toPandas()  # one row a measure
    )
    mean = (moments["s"] / moments["n"]).to_numpy()
    scale = np.sqrt(np.maximum((moments["q"] / moments["n"]).to_numpy() - mean**2, 0))
    make = Fourier(mean, np.where(scale > 1e-9, scale, 1.0), features, seed)
    width = 1 + MEASURES + features
    equations = (
        fitted.mapInPandas(
            lambda batches: _normal_equations(batches, make), "i int, row array<double>"
        )
        .groupBy("i")
        .applyInPandas(_add_rows, "i int, row array<double>")
        .orderBy("i")
        .collect()  # one row a feature
    )
    system = np.array([r["row"] for r in equations])
    beta = np.linalg.solve(system[:, :width] + ridge * np.eye(width), system[:, width])
    flat = Model(make, beta, np.zeros(BINS))
    calibration = labelled.where("fold = 1")
    if not calibration.limit(1).count():
        calibration = labelled

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = flat.place(np.stack(pdf["x"])).astype(np.int32)
                yield pd.DataFrame({"bin": at, "quality": pdf["quality"]})

    bins = (
        calibration.mapInPandas(binned, "bin int, quality int")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("ones"))
        .collect()  # at most BINS rows
    )
    n, ones = np.zeros(BINS), np.zeros(BINS)
    for r in bins:
        n[r["bin"]], ones[r["bin"]] = r["n"], r["ones"]
    return Model(make, beta, pool_adjacent(n, ones))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    features: int = FEATURES,
    ridge: float = 1.0,
    threshold: float = THRESHOLD,
    seed: int = 7,
) -> DataFrame:
    """doc_id, held_out, score and predicted class of each row of ``docs``."""
    measured = staged(measures(docs), "measures")
    model = fit(measured, labels, features, ridge, seed)
    if isinstance(model, float):
        scored = measured.select("doc_id", F.lit(model).alias("score"))
    else:

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    score = model.score(_points(batch.column("x")))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id"), pa.array(score)], ["doc_id", "score"]
                    )

        scored = measured.mapInArrow(scores, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

One pass over the texts makes about twenty statistics a document (a narrow table, written once). The class means and
covariances come from distributed sums over every labelled training row; only the class moments, a fixed number of
values, reach the driver. Each covariance is shrunk towards the pooled one and that towards its mean variance. The score
is the difference of the two log-densities, from Mahalanobis distances by cached Cholesky factors, passed through a
logistic curve fitted on a bounded sample of training rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import hash_fraction, held_out, one_label, ship, stash, table

#: Training rows on which the logistic curve is fitted, at most about this many.
CURVE_ROWS = 20_000

_UPPER = np.frombuffer(string.ascii_uppercase.encode(), np.uint8)
_LOWER = np.frombuffer(string.ascii_lowercase.encode(), np.uint8)
_DIGITS = np.frombuffer(string.digits.encode(), np.uint8)
_PROSE = np.frombuffer(b".,;:'\"()-", np.uint8)
_SYMBOLS = np.frombuffer(b"!#$%&*+/<=>?@[\\]^_`{|}~", np.uint8)

NAMES = (
    "log_bytes", "log_words", "log_word_length", "word_length_spread", "longest_word", "upper", "digits", "prose_marks", "symbols", "top_symbol", "other_bytes",
    "blanks", "log_lines", "distinct_words", "distinct_lines", "line_copies", "entropy", "short_words", "odd_word_ends", "sentence_words", "letter_spread",
)


def _share(part: float, whole: float) -> float:
    """A share on a logarithmic scale, so that small shares are told apart; about -7 to 0."""
    return float(np.log((part + 1e-3 * max(whole, 1)) / (max(whole, 1) * 1.001)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one whole text; null counts as empty. All are finite."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    nw, nl = len(words), len(lines)
    sizes = np.fromiter(map(len, words), np.int64, nw)
    distinct = len(set(words))
    distinct_lines = len(set(lines))
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    symbols = counts[_SYMBOLS]
    p = counts[counts > 0] / max(n, 1)
    letters = counts[_LOWER] + counts[_UPPER]
    q = letters[letters > 0] / max(int(letters.sum()), 1)
    mean = float(sizes.mean()) if nw else 0.0
    stops = int(counts[46] + counts[33] + counts[63])
    odd = sum(1 for w in words if w[-1] in b"!#$%&*+/<=>?@[\\]^_`{|}~")
    return [
        np.log1p(n),
        np.log1p(nw),
        np.log1p(mean),
        float(sizes.std()) / (mean + 1) if nw else 0.0,
        np.log1p(int(sizes.max()) if nw else 0),
        _share(upper, upper + lower),
        _share(int(counts[_DIGITS].sum()), n),
        _share(int(counts[_PROSE].sum()), n),
        _share(int(symbols.sum()), n),
        _share(int(symbols.max()), n),
        _share(int(counts[128:].sum()), n),
        _share(int(counts[32]), n),
        np.log1p(nl),
        float(np.log(max(distinct, 1)) / np.log(max(nw, 2))),
        _share(nl - distinct_lines, nl),
        np.log1p(nl - distinct_lines),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        _share(int((sizes <= 3).sum()), nw),
        _share(odd, nw),
        np.log1p(nw / (stops + 1)),
        float(-(q * np.log2(q)).sum()) if len(q) else 0.0,
    ]


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(rows)], names=["doc_id", "x"])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(_statistics_batches, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    means: np.ndarray  # class, feature
    whiten: np.ndarray  # class, feature, feature: inverse Cholesky factors
    logdets: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None  # the score of all, where the training rows lack a class

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density under class 1 less that under class 0."""
        dens = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            dens.append(-0.5 * (z * z).sum(axis=1) - 0.5 * self.logdets[c])
        return dens[1] - dens[0]

    def squashed(self, x: np.ndarray) -> np.ndarray:
        """The difference on a scale on which far-off rows do not rule the fit of the curve."""
        return np.arcsinh(self.difference(x))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.squashed(x) + self.offset, -35, 35)))


def _moments(width: int):
    """Per task and class: count, sums and sums of products, as (label, position, value) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + width + width * width))
        for b in batches:
            x, y = _matrix(b.column(0), width), b.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        size = total.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), 2)), pa.array(total.ravel())], names=["label", "at", "v"]
        )

    return run


def fit(labelled: DataFrame, width: int, shrink_to_pooled: float = 0.1, shrink_to_ball: float = 0.02) -> Discriminant:
    """``labelled`` has x (array) and label (0 or 1); its rows may be of any number."""
    sums = labelled.select("x", "label").mapInArrow(_moments(width), "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + width + width * width))
    for r in sums:
        total[r["label"], r["at"]] = r["v"]
    n = total[:, 0]
    if n.min() < 2:
        return Discriminant(np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2), constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1 : 1 + width] / n[:, None]
    covs = np.array([total[c, 1 + width :].reshape(width, width) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = np.tensordot(n / n.sum(), covs, axes=1)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    whiten, logdets = [], []
    for c in (0, 1):
        s = ((1 - shrink_to_pooled) * covs[c] + shrink_to_pooled * pooled) / np.outer(scale, scale)
        s = (1 - shrink_to_ball) * s + (shrink_to_ball * np.trace(s) / width + 1e-6) * np.eye(width)
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor) / scale)
        logdets.append(2 * np.log(np.diag(factor)).sum())
    model = Discriminant(means, np.array(whiten), np.array(logdets))
    share = min(1.0, CURVE_ROWS / n.sum())
    rows = labelled.where(hash_fraction("doc_id") < share).select("x", "label").toPandas()
    model.slope, model.offset = _logistic(model.squashed(np.array(rows["x"].tolist()).reshape(-1, width)), rows["label"].to_numpy(float))
    return model


def _logistic(d: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge; the slope stays positive, as a higher difference means class 1."""
    w, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w * d + b, -35, 35)))
        g = np.array([((p - y) * d).sum() + 1e-3 * (w - 1), (p - y).sum() + 1e-3 * b])
        v = p * (1 - p)
        h = np.array([[(v * d * d).sum() + 1e-3, (v * d).sum()], [(v * d).sum(), v.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        w, b = w - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w), 1e-3), float(b)


def _scorer(model: Discriminant, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1), width)))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) per document.

    Documents on crc32 remainder 2 of 4, or without an id, are held out of training. Null text is scored as empty.
    Where training rows lack a class, every score is the share of class 1 among them, 0.5 if there are none. Repeated
    documents are scored alike; labels with a null are ignored; of several labels of one id the smallest counts.
    """
    table_of = stash(features(docs, id_col, text_col), "quality")
    training = one_label(labels.select(F.col(id_col).alias("doc_id"), label_col), "doc_id", label_col).where(~held_out("doc_id", 4, 2))
    width = len(NAMES)
    model = fit(table_of.join(training, "doc_id"), width)
    kind = table_of.schema["doc_id"].dataType.simpleString()
    scored = table_of.mapInArrow(_scorer(model, width), f"doc_id {kind}, score double")
    return scored.select(F.col("doc_id").alias(id_col), held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality scores by a regularised quadratic discriminant over document statistics.

Each whole text becomes a short vector of statistics (``STATISTICS``), transformed so that they are nearly
normal: shares by logit, sizes by logarithm. For each class the mean and covariance come from counts, sums and
sums of products over all labelled rows of the training folds, aggregated by Spark: what reaches the driver is
one row of about a hundred numbers for each class, whatever the table's size.

A class covariance shrinks towards the pooled one (``pooling``) and that towards its scaled diagonal (``ridge``),
after all statistics have been scaled by the pooled deviations. Its Cholesky factor is computed once and kept in
the model. A text's score is the logistic of the difference of the classes' log-densities: Mahalanobis distances
through the kept factors and the log-determinants, plus the logarithm of the classes' odds, less a cut. The cut,
as densities of statistics that are only nearly normal are off by some, is where a sample of ``CUT_ROWS`` of the
training rows (about as many, by the ids' hashes) is parted with the fewest mistakes.

Defined cases: null and empty texts have the statistics of an empty text and get a score as others do; rows
without an id are scored and never learned from; a label other than 0 and 1, or null, is ignored, repeated
labels count each, as do the rows of an id with several texts; if the training rows hold one class only (or none), every score is that class's (or 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.shipping import ship
from lodestrata.storage import materialise

POOLING, RIDGE = 0.02, 0.05
CUT_ROWS = 20_000
STATISTICS = ("letters", "capitals", "digits", "marks", "symbols", "bars", "spaces", "words", "word_length", "word_spread", "distinct", "commonest", "echoes", "returns", "lines", "line_length", "line_repeats", "ends", "spelling", "entropy")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = True
_KINDS = {
    "capitals": np.array([65 <= b <= 90 for b in range(256)]),
    "digits": np.array([48 <= b <= 57 for b in range(256)]),
    "marks": np.array([chr(b) in "!?;:\"'()" for b in range(256)]),
    "symbols": _SYMBOLS,
    "bars": np.array([b == 124 for b in range(256)]),
    "spaces": np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)]),
    "letters": np.array([97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in range(256)]),
}


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(0.0, whole - part) + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = len(raw)
    kinds = {k: int(counts[v].sum()) for k, v in _KINDS.items()}
    words = (text or "").split()
    w = len(words)
    lengths = np.fromiter(map(len, words), np.int64, w)
    distinct: dict[str, int] = {}
    for word in words:
        distinct[word] = distinct.get(word, 0) + 1
    echoes = sum(map(str.__eq__, words, words[1:]))
    half = w // 2  # a text that says its words twice has few that its first half has not
    seen = set(words[:half])
    returns = sum(map(seen.__contains__, words[half:]))
    lines = [x for x in (text or "").split("\n") if x]
    share = counts[counts > 0] / max(1, n)
    capitals_first = sum(map(str.istitle, words))
    values = {
        **{k: _logit(v, n) for k, v in kinds.items()},
        "words": np.log1p(w),
        "word_length": np.log1p(lengths.mean()) if w else 0.0,
        "word_spread": np.log1p(lengths.std()) if w else 0.0,
        "distinct": _logit(len(distinct), w),
        "commonest": _logit(max(distinct.values(), default=0), w),
        "echoes": _logit(echoes, w),
        "returns": _logit(returns, w - half),
        "lines": np.log1p(len(lines)),
        "line_length": np.log1p(w / max(1, len(lines))),
        "line_repeats": _logit(len(lines) - len(set(lines)), len(lines)),
        "ends": _logit(int(counts[46] + counts[44]), w),
        "spelling": _logit(capitals_first, w),
        "entropy": float(-(share * np.log(share)).sum()),
    }
    return [float(values[k]) for k in STATISTICS]


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) for each row."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")], np.float64).reshape(-1, len(STATISTICS))
            offsets = pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1, in scaled statistics."""

    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_determinants: list[float]
    log_odds: float
    constant: float | None = None
    cut: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with the log-odds."""
        z = x / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_determinants, strict=True)]
        return density[1] - density[0] + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.difference(x) - self.cut, -700, 700)))


def best_cut(difference: np.ndarray, label: np.ndarray) -> float:
    """Where a cut makes the fewest mistakes; the middle of the widest such gap."""
    order = np.argsort(difference)
    d, y = difference[order], label[order]
    if len(y) < 2:
        return 0.0
    wrong = np.cumsum(y == 1) + (y == 0).sum() - np.cumsum(y == 0)  # of a cut right after each value
    gaps = np.flatnonzero(wrong[:-1] == wrong[:-1].min(initial=len(y)))
    if not len(gaps) or wrong[:-1].min() >= min((y == 0).sum(), (y == 1).sum()):
        return 0.0
    i = gaps[np.argmax(d[gaps + 1] - d[gaps])]
    return float((d[i] + d[i + 1]) / 2)


def fit(measured: DataFrame, labels: DataFrame, label: str, learns: Column, pooling: float = POOLING, ridge: float = RIDGE, id_column: str = "doc_id") -> Discriminant:
    """A model from all rows of ``measured`` whose id has a label 0 or 1 and satisfies ``learns``, a condition on doc_id."""
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(learns)
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    joined = measured.join(known, "doc_id")
    rows = {r["label"]: r for r in joined.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    if len(rows) < 2:
        return Discriminant(np.ones(d), [], [], [], 0.0, float(next(iter(rows))) if rows else 0.5)
    means, covariances, sizes = [], [], [rows[c]["n"] for c in (0, 1)]
    for c in (0, 1):
        r, product = rows[c], np.empty((d, d))
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        for i, j in pairs:
            product[i, j] = product[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        covariances.append(product - np.outer(mean, mean))
    pooled = (sizes[0] * covariances[0] + sizes[1] * covariances[1]) / sum(sizes)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    pooled = pooled / np.outer(scale, scale)
    pooled = (1 - ridge) * pooled + ridge * np.eye(d)
    factors, determinants = [], []
    for s in covariances:
        mixed = (1 - pooling) * s / np.outer(scale, scale) + pooling * pooled + ridge * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        determinants.append(2 * float(np.log(np.diag(lower)).sum()))
    model = Discriminant(scale, [m / scale for m in means], factors, determinants, float(np.log(sizes[1] / sizes[0])))
    sample = joined.where(share_of(F.xxhash64("doc_id"), CUT_ROWS, sum(sizes))).select("label", "x").distinct().toPandas()
    if len(sample):
        model.cut = best_cut(model.difference(np.array(sample["x"].tolist())), sample["label"].to_numpy())
    return model


def share_of(digest: Column, wanted: int, rows: int) -> Column:
    """A condition on a hash that about ``wanted`` of ``rows`` rows fulfil, all if there are no more; the same ones each time."""
    return F.pmod(digest, F.lit(1 << 30)) < F.lit(min(1.0, wanted / max(1, rows)) * (1 << 30))


def score(model: Discriminant, x: Column) -> Column:
    """The model's score of a column of statistics."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(values.tolist(), np.float64).reshape(-1, len(STATISTICS))))

    return run(x)


def score_text(model: Discriminant, text: Column) -> Column:
    """The model's score of a column of texts."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in values], np.float64).reshape(-1, len(STATISTICS))))

    return run(text)


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id's decimal digits, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; learned from the labels outside fold ``held_out``."""
    measured = materialise(measure(docs), "statistics")
    model = fit(measured, labels, "quality", fold(F.col("doc_id"), folds) != held_out)
    scored = measured.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), score(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

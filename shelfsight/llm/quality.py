"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

The statistics are transformed towards normal (logarithms and logits), their class means and second moments are sums over all labelled
training rows, each class covariance is shrunk towards the pooled one and the pooled one towards its diagonal, and a score is the
difference of the Mahalanobis log densities by the Cholesky factors, which are worked out once and sent to the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import id_fold, one_label, written

STATISTICS = ["words", "word_length", "upper", "digits", "marks", "stops", "variety", "top_word", "adjacent", "second", "short", "line_copies"]
TO_POOLED = 0.1
TO_DIAGONAL = 0.1
RIDGE = 1e-3
PREDICTED = 0.3


def _logit(share: float, of: float) -> float:
    """Log odds of a share of ``of`` units, half a unit added on either side."""
    return float(np.log((share + 0.5) / (of - share + 0.5)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; an empty one has those of no units."""
    data = (text or "").encode("utf-8", "surrogatepass")
    bytes_ = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n, size = len(words), len(data)
    counts = Counter(words)
    common = counts.most_common(1)[0][1] if counts else 0
    upper, lower, high = int(bytes_[65:91].sum()), int(bytes_[97:123].sum()), int(bytes_[128:].sum())
    digits = int(bytes_[48:58].sum())
    stops = int(bytes_[[33, 44, 46, 63]].sum())
    marks = int(bytes_[33:127].sum()) - upper - lower - digits - stops
    lines = data.split(b"\n")
    return [
        float(np.log1p(n)), float(np.log1p(size / max(1, n))), _logit(upper, upper + lower + high), _logit(digits, size), _logit(marks, size), _logit(stops, size),
        float(np.log1p(len(counts)) / max(1e-9, np.log1p(n))) if n else 1.0, _logit(common, n), _logit(sum(map(bytes.__eq__, words, words[1:])), n),
        _logit(sum(map(bytes.__eq__, words, words[2:])), n), _logit(sum(len(w) <= 3 for w in words), n), _logit(len(lines) - len(set(lines)), len(lines)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            table = pd.DataFrame([statistics(t) for t in batch["text"]], columns=STATISTICS, index=batch.index)
            yield pd.concat([batch["doc_id"], table], axis=1)

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scan, schema)


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label (rows, sums, second moments): one aggregated row per class reaches the driver."""
    pairs = [(i, j) for i in range(len(STATISTICS)) for j in range(i, len(STATISTICS))]
    sums = [F.sum(s).alias(f"s{i}") for i, s in enumerate(STATISTICS)]
    products = [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for row in labelled.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():
        second = np.zeros((len(STATISTICS), len(STATISTICS)))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"]
        out[row["label"]] = row["n"], np.array([row[f"s{i}"] for i in range(len(STATISTICS))]), second
    return out


class Discriminant:
    """Means, Cholesky factors and log priors of both classes. With rows of one class only, its label is certain in proportion to them."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        dims = len(STATISTICS)
        rows = {k: moments.get(k, (0, None, None))[0] for k in (0, 1)}
        self.prior = float(np.log((rows[1] + 0.5) / (rows[0] + 0.5)))
        self.classes = None
        if min(rows.values()) == 0:
            return
        means = {k: moments[k][1] / rows[k] for k in (0, 1)}
        scatter = {k: moments[k][2] - rows[k] * np.outer(means[k], means[k]) for k in (0, 1)}
        pooled = (scatter[0] + scatter[1]) / (rows[0] + rows[1])
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(dims)
        self.classes = []
        for k in (0, 1):
            share = max(TO_POOLED, min(1.0, dims / rows[k]))  # few rows lean on the pooled covariance
            factor = np.linalg.cholesky((1 - share) * scatter[k] / rows[k] + share * pooled)
            self.classes.append((means[k], np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))

    def scores(self, table: np.ndarray) -> np.ndarray:
        odds = np.full(len(table), self.prior)
        if self.classes:
            density = [-0.5 * ((((table - mean) @ inverse.T) ** 2).sum(axis=1) + log_det) for mean, inverse, log_det in self.classes]
            odds = odds + density[1] - density[0]
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; score is the probability of quality 1.

    Null text is empty text. Repeated rows are scored each; in the fit a document counts as often as it is there, a row with null doc_id or
    label does not. Labels of the held-out fold are never read. Without labels every score is one half.
    """
    table = written(document_statistics(docs), "statistics")
    train = one_label(labels, "quality").where(id_fold(F.col("doc_id"), modulus) != held_out)
    model = Discriminant(class_moments(table.join(train, "doc_id")))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.scores(batch[STATISTICS].to_numpy(dtype=np.float64))})

    scored = table.mapInPandas(scan, "doc_id long, score double")
    return scored.select("doc_id", (id_fold(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score",
                         F.when(F.col("score") >= PREDICTED, 1).otherwise(0).alias("predicted"))

"""Embedding whitening by a weighted covariance over distinct vectors.

Vectors are brought to whole numbers, equal ones are grouped, and every step after that sees a distinct vector once, with its number of copies as
weight: exact sums, one weighted product of the centred vectors, the projection. The rows get their result back by a join on the vector. Vectors with
many copies, of which there cannot be many, are sent to the rows instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written

SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond this are no longer whole in double precision; they count as not finite.
LARGEST = 2.0**52
#: A vector that holds more than one of so many rows is sent to the rows; fewer vectors than this can.
HOT = 1000
#: Components whose eigenvalue is not above this share of the largest have no variance of their own.
FLAT = 1e-12
EXACT = pa.decimal128(38, 0)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x, h): the usable rows, each entry as ``floor(1024 c) + 100000``, and a hash of x."""
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda c: c * SCALE)
    usable = F.forall(scaled, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= LARGEST), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") > 0) & usable)
    return rows.select("vec_id", F.transform(scaled, lambda c: F.floor(c) + SHIFT).alias("x")).withColumn("h", F.xxhash64("x"))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, matrix of x, copies) of the vectors of each length; a length is a fit of its own."""
    x, copies = batch.column("x"), batch.column("copies").to_numpy()
    lengths, values, ends = x.value_lengths().to_numpy(), x.flatten().to_numpy(), np.cumsum(x.value_lengths().to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, values[(ends[at] - d)[:, None] + np.arange(d)].reshape(len(at), d), copies[at]


def exact_sum(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Weighted sums of the columns, in whole numbers of any size."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if largest * int(weight.sum()) >= 1 << 62:
        x, weight = x.astype(object), weight.astype(object)
    return [int(s) for s in weight @ x] if len(x) else [0] * x.shape[1]


@dataclass
class Fit:
    """Mean and components of the vectors of one length."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    explained: np.ndarray | None = None

    def away(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        largest = max(int(x.max(initial=0)), -int(x.min(initial=0))) * self.n + max(map(abs, self.sums), default=0)
        if largest >= 1 << 62:
            return x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return x * self.n - np.array(self.sums, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.away(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[Decimal]:
        """Sum of (n x - S)^2, exact."""
        away = self.away(x)
        largest = max((abs(int(a)) for a in (away.max(initial=0), away.min(initial=0))), default=0)
        if largest * largest * max(1, x.shape[1]) >= 1 << 62:
            away = away.astype(object)
        return [Decimal(int(s)) for s in (away * away).sum(axis=1)]

    def decompose(self, covariance: np.ndarray, most: int) -> None:
        values, components = np.linalg.eigh(covariance)
        values, components = values[::-1][:most], components[:, ::-1][:, :most]
        top = np.abs(components).argmax(axis=0)
        self.components = components * np.where(components[top, np.arange(components.shape[1])] < 0, -1.0, 1.0)  # the sign that reruns agree on
        self.values, trace = np.maximum(values, 0.0), float(np.trace(covariance))
        self.explained = self.values / trace if trace > 0 else np.zeros(len(values))

    @property
    def lively(self) -> np.ndarray:
        return self.values > FLAT * max(self.values[0], 0.0) if len(self.values) else self.values > 0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.lively, 1 / np.sqrt(np.where(self.lively, self.values, 1.0)), 0.0)
        return self.centred(x) @ self.components * scale


def fit_sums(distinct: DataFrame) -> dict[int, Fit]:
    """Number of vectors and exact sums by dimension, of each length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for _, x, copies in by_length(batch):
                own = [int(copies.sum()), *exact_sum(x, copies)]
                total[x.shape[1]] = [a + b for a, b in zip(total.get(x.shape[1], [0] * len(own)), own)]
        for d, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([[Decimal(s) for s in sums]], pa.list_(EXACT))], names=["d", "sums"])

    partial = distinct.select("x", "copies").mapInArrow(scan, "d int, sums array<decimal(38,0)>")
    total = partial.select("d", F.posexplode("sums").alias("at", "s")).groupBy("d", "at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    fits: dict[int, dict[int, int]] = {}
    for r in total.collect():  # one row per dimension
        fits.setdefault(r["d"], {})[r["at"]] = int(r["s"])
    return {d: Fit(sums[0], [sums[k] for k in range(1, d + 1)]) for d, sums in fits.items()}


def covariances(distinct: DataFrame, fits: dict[int, Fit]) -> dict[int, np.ndarray]:
    """Weighted covariance of each length, divisor n, of the centred vectors."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x, copies in by_length(batch):
                z = fits[x.shape[1]].centred(x)
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + z.T @ (z * copies[:, None])
        for d, products in total.items():
            rows = [products[i, i:] for i in range(d)]
            yield pa.RecordBatch.from_arrays([
                pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["d", "i", "products"])

    partial = distinct.select("x", "copies").mapInArrow(scan, "d int, i int, products array<double>")
    sums = partial.select("d", "i", F.posexplode("products").alias("j", "p")).groupBy("d", "i", "j").agg(F.sum("p").alias("p"))
    out = {d: np.zeros((d, d)) for d in fits}
    table = sums.toArrow()  # d (d + 1) / 2 rows
    for d, i, j, p in zip(*(table[name].to_pylist() for name in ("d", "i", "j", "p"))):
        out[d][i, i + j] = out[d][i + j, i] = p / fits[d].n
    return out


def identity_errors(projected: DataFrame, fits: dict[int, Fit], most: int) -> dict[int, float]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    value, weight = [F.get("whitened", F.lit(k)) for k in range(most)], F.col("copies").cast("double")
    mean = {r["d"]: list(r)[1:] for r in projected.groupBy("d").agg(*[F.sum(weight * v) / F.sum(weight) for v in value]).collect()}  # a row per length
    means = F.create_map(*[part for d, m in mean.items() for part in (F.lit(d), F.array(*[F.lit(float(v or 0.0)) for v in m]))])
    centred = [v - F.get(means[F.col("d")], F.lit(k)) for k, v in enumerate(value)]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    out = {}
    for r in projected.groupBy("d").agg(*[F.sum(weight * centred[i] * centred[j]) for i, j in pairs]).collect():
        lively = fits[r["d"]].lively
        found = [abs(p / fits[r["d"]].n - (i == j)) for (i, j), p in zip(pairs, list(r)[1:]) if j < len(lively) and lively[i] and lively[j]]
        out[r["d"]] = max(found, default=0.0)
    return out


def whiten(vectors: DataFrame, most: int = 8, fit_weight: str = "copies") -> DataFrame:
    """Whitened coordinates of ``vectors`` (vec_id, embedding) on the first ``most`` principal components, one row per vector and component.

    ``fit_weight`` is "copies" (every row counts) or "one" (every distinct vector counts once). Returns vec_id, component, n, deviation,
    whitened, explained, identity_error. Rows whose vector is null or holds a null, a non-finite entry or one beyond ``LARGEST`` are left
    out; repeated rows and null vec_id are kept, each with its own result. Vectors of each length are a fit of their own; one without
    entries has no components and so no rows. A component without variance has whitened and explained 0 and does not count for the
    error. Equal eigenvalues leave the choice of their components to the decomposition. A deviation beyond a long is null. Other columns
    are not read. An empty table gives no rows.
    """
    if fit_weight not in ("copies", "one"):
        raise ValueError("fit_weight is copies or one")
    spark = vectors.sparkSession
    rows = whole_vectors(vectors)
    grouped = written(rows.groupBy("h", "x").agg(F.count("*").alias("rows")), "distinct-vectors")
    distinct = grouped.withColumn("copies", F.col("rows") if fit_weight == "copies" else F.lit(1).cast("long"))
    fits = fit_sums(distinct)
    if not fits:
        return spark.createDataFrame([], SCHEMA)
    for d, covariance in covariances(distinct, fits).items():
        fits[d].decompose(covariance, most)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, _ in by_length(batch):
                fit, part = fits[x.shape[1]], batch.take(pa.array(at))
                coordinates = fit.whitened(x)
                offsets = pa.array(np.arange(len(at) + 1) * coordinates.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    *(part.column(name) for name in ("h", "x", "rows", "copies")), pa.array([x.shape[1]] * len(at), pa.int32()),
                    pa.array(fit.deviation(x), EXACT), pa.ListArray.from_arrays(offsets, pa.array(coordinates.ravel()))],
                    names=["h", "x", "rows", "copies", "d", "deviation", "whitened"])

    schema = "h long, x array<long>, rows long, copies long, d int, deviation decimal(38,0), whitened array<double>"
    projected = written(distinct.select("h", "x", "rows", "copies").mapInArrow(project, schema), "whitened-vectors")
    error = identity_errors(projected, fits, most)
    model = F.broadcast(spark.createDataFrame(  # one row per length
        [(d, fit.n, [float(e) for e in fit.explained], float(error[d])) for d, fit in fits.items()], "d int, n long, explained array<double>, identity_error double"))
    everything = projected.agg(F.sum("rows")).first()[0]
    result = projected.select("h", "x", "d", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", (F.col("rows") * HOT > everything).alias("hot"))
    hot = F.broadcast(result.where("hot").drop("hot"))
    cold = rows.join(F.broadcast(result.where("hot").select("h", "x")), ["h", "x"], "left_anti").join(result.where("not hot").drop("hot"), ["h", "x"])
    joined = rows.join(hot, ["h", "x"]).unionByName(cold).join(model, "d")
    return joined.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "n", "deviation", "explained", "identity_error").select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")

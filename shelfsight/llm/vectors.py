"""Near-duplicates of vectors by cosine: tiles compared along principal components, leading ones first.

Vectors are scaled to length one in double precision, equal ones are folded into one, and the rest is rotated to its principal
components (the rotation keeps cosines; the covariance of all rows is summed in the tasks and has dims x dims entries). Sorted by the
leading component, tiles of ``tile_rows`` vectors are compared: for each pair of tiles the products of the leading dimensions are
accumulated block by block, what the other dimensions can add is bounded by the product of the suffix norms, and pairs that
cannot reach the threshold leave. Whole tile pairs are left out before their vectors are sent anywhere, when the angle between their ranges
of the leading component is too wide. Pairs that remain get the full cosine of the unrotated vectors. Tile pairs give link counts and a
spanning forest of their links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.common import written
from shelfsight.llm.components import components

THRESHOLD = 0.95
TILE_ROWS = 4096
INNER_ROWS = 1024
BLOCKS = (8, 16, 32)
#: The rotation and the running sums are exact to far less than this.
SLACK = 1e-9


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors of doubles that are neither null, zero nor with null or non-finite components."""
    vector = F.col("embedding").cast("array<double>")
    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return typed.where(F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def rotation(distinct: DataFrame, dims: int) -> np.ndarray:
    """Principal directions of the unit vectors, strongest first, from second moments summed over all rows."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            unit = _unit(_matrix(batch["v"]))
            total += unit.T @ unit
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    summed = distinct.select("v").mapInPandas(moments, "i long, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
    cells = summed.groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow().to_pandas()  # dims x dims numbers
    square = np.zeros((dims, dims))
    square[cells["i"], cells["j"]] = cells["x"]
    return np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]


def _linked(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b with cosine >= threshold; ra and rb are their rotations."""
    dims = ra.shape[1]
    done = min(BLOCKS[0], dims)
    rest = lambda r, k: np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", r[:, :k], r[:, :k])))
    bound = ra[:, :done] @ rb[:, :done].T
    bound += np.outer(rest(ra, done), rest(rb, done))
    i, j = np.nonzero(bound >= threshold - SLACK)
    for upto in [*(k for k in BLOCKS[1:] if k < dims), dims]:
        if not len(i) or upto == done:
            break
        sums = np.einsum("ij,ij->i", ra[i, :upto], rb[j, :upto])
        can = sums + rest(ra, upto)[i] * rest(rb, upto)[j] >= threshold - SLACK
        i, j, done = i[can], j[can], upto
    full = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
    return i[full], j[full]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if (rx := root(x)) != (ry := root(y)) and not parent.update({max(rx, ry): min(rx, ry)})]
    return np.array([x for x, _ in kept], dtype=np.int64), np.array([y for _, y in kept], dtype=np.int64)


def _tile_rows(group: pd.DataFrame, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    unit = _unit(_matrix(group["v"]))
    return group["vec_id"].to_numpy(), group["copies"].to_numpy(), unit, unit @ turn


def _compare(left: pd.DataFrame, right: pd.DataFrame, turn: np.ndarray, threshold: float, same: bool) -> pd.DataFrame:
    """Counts (node, n_links) and forest edges (node, other) between two tiles, or inside one."""
    ids_a, copies_a, a, ra = _tile_rows(left, turn)
    ids_b, copies_b, b, rb = (ids_a, copies_a, a, ra) if same else _tile_rows(right, turn)
    counts_a, counts_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    edges_a, edges_b = np.empty(0, np.int64), np.empty(0, np.int64)
    for s in range(0, len(ids_a), INNER_ROWS):
        for t in range(s if same else 0, len(ids_b), INNER_ROWS):
            i, j = _linked(a[s:s + INNER_ROWS], b[t:t + INNER_ROWS], ra[s:s + INNER_ROWS], rb[t:t + INNER_ROWS], threshold)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(counts_a, i, copies_b[j])
            np.add.at(counts_a if same else counts_b, j, copies_a[i])
            edges_a, edges_b = _forest(np.concatenate((edges_a, ids_a[i])), np.concatenate((edges_b, ids_b[j])))
    hit_a, hit_b = counts_a > 0, counts_b > 0
    nodes = np.concatenate((ids_a[hit_a], ids_b[hit_b] if not same else ids_b[:0], edges_a))
    links = np.concatenate((counts_a[hit_a], counts_b[hit_b] if not same else counts_b[:0], np.zeros(len(edges_a), np.int64)))
    other = np.concatenate((np.full(len(nodes) - len(edges_a), -1, np.int64), edges_b))
    return pd.DataFrame({"node": nodes, "n_links": links, "other": other, "edge": np.arange(len(nodes)) >= len(nodes) - len(edges_a)})


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a <= b, of tiles whose ranges of the leading angle lie within arccos(threshold) of each other.

    cos of two unit vectors is at most cos of the difference of their leading angles, so no link is lost. Runs over one row per tile;
    the sorted order makes the tiles in reach of one a run of neighbours, found by bucketing the angles.
    """
    width = float(np.arccos(threshold)) + 1e-6
    cells = tiles.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width).cast("long"), F.floor(F.col("high") / width).cast("long") + 1)))
    a = cells.select(F.col("tile").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), "cell")
    b = cells.select(F.col("tile").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), "cell")
    near = a.join(b, "cell").where((F.col("a") <= F.col("b")) & (F.col("b_low") - F.col("a_high") <= width) & (F.col("a_low") - F.col("b_high") <= width))
    return near.select("a", "b").distinct()


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other rows with cosine >= threshold, component_id is the smallest vec_id that links reach. Unusable vectors link with nothing;
    vectors of different lengths are never compared. Equal vectors are folded before tiles are made, and count for each other and for
    whoever links to one of them. A row without vec_id takes part in counts and bridges links, but names no component if another
    member has an id. Empty input gives no rows.
    """
    rows = usable(embeddings)
    classes = written(rows.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies")).withColumn(
        "vec_id", F.monotonically_increasing_id()), "vector-classes")  # one number per distinct vector
    results = None
    for dims in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):  # one row per vector length
        own = classes.where(F.size("v") == dims)
        turn = rotation(own, dims)
        found = _tiles_compared(own, turn, threshold, tile_rows)
        results = found if results is None else results.unionByName(found)
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    if results is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    results = written(results, "vector-links")
    counts = results.groupBy("node").agg(F.sum("n_links").alias("found"))
    roots = written(components(results.where("edge").select(F.col("node").alias("a"), F.col("other").alias("b"))), "vector-roots")
    firsts = classes.select(F.col("vec_id").alias("node"), "first_id", "copies")
    named = roots.join(firsts, "node").groupBy("root").agg(F.min("first_id").alias("linked_id"))
    judged = firsts.join(counts, "node", "left").join(roots.join(named, "root").select("node", "linked_id"), "node", "left").select(
        F.col("node").alias("class_id"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("linked_id", "first_id").alias("component_id"))
    members = rows.join(classes.select("v", F.col("vec_id").alias("class_id")), "v").select("vec_id", "class_id").join(judged, "class_id")
    linked = members.select("vec_id", "n_links", "component_id")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    alone = ids.where(F.col("v").isNull() | ~F.coalesce(fine, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tiles_compared(classes: DataFrame, turn: np.ndarray, threshold: float, tile_rows: int) -> DataFrame:
    """(node, n_links, other, edge) of all tile pairs."""
    spark = classes.sparkSession
    lead = [float(x) for x in turn[:, 0]]

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _unit(_matrix(batch["v"]))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "copies": batch["copies"], "angle": np.arccos(np.clip(unit @ np.array(lead), -1, 1))})

    measured = written(classes.select("vec_id", "v", "copies").mapInPandas(angles, "vec_id long, v array<double>, copies long, angle double"), "vector-angles")
    total = measured.agg(F.count("*")).first()[0]
    if not total:
        return spark.createDataFrame([], "node long, n_links long, other long, edge boolean")
    n_tiles = max(1, -(-total // tile_rows))
    ranges = written(measured.repartitionByRange(n_tiles, "angle", "vec_id").withColumn("part", F.spark_partition_id().cast("long")), "vector-tiles")
    parts = ranges.agg(F.max("part")).first()[0] + 1  # the session may deal out more ranges than asked for
    tiled = ranges.withColumn("tile", F.floor(F.col("part") * n_tiles / parts).cast("long"))
    spans = tiled.groupBy("tile").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
    pairs = written(_tile_pairs(spans, threshold), "tile-pairs")
    sides = pairs.select("a", "b", F.col("a").alias("tile")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("tile")))
    sent = tiled.select("tile", "vec_id", "v", "copies").join(sides, "tile")

    def pair(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        return _compare(group[group["tile"] == a], group[group["tile"] == b], turn, threshold, a == b)

    return sent.groupBy("a", "b").applyInPandas(pair, "node long, n_links long, other long, edge boolean")

"""Whitening against a plain computation over all rows."""

import math
import random

import numpy as np
import pytest

from shelfsight.llm import whitening
from shelfsight.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(vectors, most=8):
    """{row number: (deviation, whitened up to sign)} and the shares, over all rows."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), [sum(column) for column in x.T]
    z = ((x * n - np.array(sums, dtype=object)) / n).astype(float)
    v = z.T @ z / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:most], c[:, ::-1][:, :most]
    return [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x], z @ c / np.sqrt(e), e / np.trace(v)


def held_against(rows, vectors):
    deviation, whitened, explained = plain([v for _, v in vectors])
    most = whitened.shape[1]
    assert len(rows) == len(vectors) * most and {r["n"] for r in rows} == {len(vectors)}
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-6) and r["identity_error"] <= 1e-6
    sign = {}
    for k, (vec_id, _) in enumerate(vectors):
        for r in got[vec_id]:
            want, component = whitened[k][r["component"] - 1], r["component"]
            if component not in sign and abs(want) > 0.1:
                sign[component] = 1 if want * r["whitened"] > 0 else -1
    for k, (vec_id, _) in enumerate(vectors):
        for r in got[vec_id]:
            assert r["deviation"] == deviation[k] and abs(r["whitened"] * sign[r["component"]] - whitened[k][r["component"] - 1]) < 1e-6


def test_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    held_against(QUERIES["op11_embedding_whitening"](spark, SMALL).collect(), [(r["vec_id"], r["embedding"]) for r in table])


@pytest.mark.parametrize("hot", [whitening.HOT, 2])
def test_odd_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(whitening, "HOT", hot)
    random.seed(11)
    vectors = [(k, [random.gauss(0, 1 + j) for j in range(10)]) for k in range(60)]
    vectors += [(100 + k, vectors[0][1]) for k in range(70)]  # one vector holds half of the rows
    odd = [(200, None), (201, [0.0] * 9 + [None]), (202, [0.0] * 9 + [math.nan]), (203, [math.inf] + [0.0] * 9), (204, [1e300] + [0.0] * 9)]
    random.shuffle(vectors)
    names = "vec_id long, embedding array<double>, n string, x string, h string, rows string, component string"
    table = spark.createDataFrame([(*v, "n", "x", "h", "r", "c") for v in vectors + odd], names)
    held_against(whitening.whiten(table).collect(), vectors)


def test_edges(spark):
    names = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], names)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], names)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], names)).collect()
    assert len(same) == 4 and all(r["whitened"] == r["explained"] == r["deviation"] == r["identity_error"] == 0 for r in same)
    mixed = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0]), (4, [3.0])], names)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in mixed) == [(1, 1, 2), (1, 2, 2), (2, 1, 2), (2, 2, 2), (3, 1, 2), (4, 1, 2)]
    assert all(abs(abs(r["whitened"]) - (r["component"] == 1)) < 1e-9 for r in mixed)


def test_weights(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    counts, ones = (whitening.whiten(table, fit_weight=w).where("component = 1").collect() for w in ("copies", "one"))
    assert {r["n"] for r in counts} == {4} and {r["n"] for r in ones} == {2}
    assert len({round(abs(r["whitened"]), 9) for r in counts}) == 2 and {round(abs(r["whitened"]), 9) for r in ones} == {1.0}
    with pytest.raises(ValueError):
        whitening.whiten(table, fit_weight="two")


def test_exact_beyond_a_long():
    x = np.array([[2**51, -(2**51)], [1, 5]], dtype=np.int64)
    assert whitening.exact_sum(x, np.array([2**40, 3])) == [2**91 + 3, -(2**91) + 15]
    fit = whitening.Fit(2**20, [7, 9])
    assert [int(d) for d in fit.deviation(x)] == [(2**71 - 7) ** 2 + (-(2**71) - 9) ** 2, (2**20 - 7) ** 2 + (5 * 2**20 - 9) ** 2]

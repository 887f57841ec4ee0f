import math

import numpy as np
import pytest
from callproof.llm import whitening
from callproof.llm.whitening import eigenpairs

SCHEMA = "vec_id long, embedding array<float>, whitened int"


def brute(rows, components=4):
    """Plain numpy, with the sums in Python's integers."""
    used = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in used}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit.astype(float) - np.array([s / n for s in sums], float))
    v = y.T @ y / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    out = {}
    for i, x in used:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        z = (np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)], float)) @ w / np.sqrt(e)
        out[i] = (n, deviation, z, e / np.trace(v))
    return out


def spread(rng, n, d):
    return (rng.normal(size=(n, d)) * np.linspace(2, 0.2, d)).tolist()


def test_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = list(enumerate(spread(rng, 300, 12)))
    rows += [(300 + k, rows[k % 3][1]) for k in range(150)]  # a third of the rows are copies of three
    rows += [(900, None), (901, [1.0] * 11 + [None]), (902, [1.0] * 11 + [float("nan")]), (903, [1.0] * 11 + [float("inf")]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = brute([r for r in rows if r[0] != 905])
    got = whitening.whitening(df).collect()
    assert {r["vec_id"] for r in got} == set(want) and len(got) == 4 * len(want)
    signs = {}
    for r in got:
        n, deviation, z, explained = want[r["vec_id"]]
        k = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and n == 300
        assert abs(r["explained"] - explained[k]) < 1e-10 and r["identity_error"] < 1e-10
        sign = signs.setdefault(k, math.copysign(1, r["whitened"] * z[k]))
        assert abs(sign * r["whitened"] - z[k]) < 1e-9


def test_few_rows(spark):
    """No rows, one vector, constant dimensions: as many components as there are; a null id stays."""
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whitening(frame([])).count() == 0
    assert whitening.whitening(frame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).count() == 0
    got = whitening.whitening(frame([(None, [1.0, 2.0, 3.0], 0), (2, [2.0, 2.0, 3.0], 0)])).collect()
    assert sorted((str(r["vec_id"]), r["component"], round(abs(r["whitened"]), 9), r["explained"], r["deviation"]) for r in got) == [("2", 1, 1.0, 1.0, 256**2), ("None", 1, 1.0, 1.0, 256**2)]


def test_large_entries(spark):
    """Sums of entries beyond 53 bits stay exact; a deviation beyond a long is null."""
    rows = [(1, [1e9, 0.0], 0), (2, [-1e9, 1.0], 0), (3, [3e38, 5.0], 0)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitening(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 1]["deviation"] is None and all(math.isfinite(r["whitened"]) for r in got.values())
    two = whitening.whitening(spark.createDataFrame(rows[:2], "vec_id long, embedding array<double>, whitened int")).collect()
    assert {r["deviation"] for r in two} == {None}


def matrix(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values),) * 2))[0]
    v = (q * np.array(values)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 1.0], np.linspace(1, 2, 40), [2.0] * 10, [0.0] * 5, [5.0, 4.0] + [0.0] * 20,
    [3.0 + k * 1e-9 for k in range(5)] + [1.0] * 10 + list(np.linspace(0.1, 0.9, 20)), [5.0 + k * 1e-13 for k in range(4)] + [4.0 + k * 1e-6 for k in range(4)] + [0.5],
])
def test_eigenpairs(values):
    """Clusters of any gap: unit, orthogonal, and eigenvectors to double precision."""
    v = matrix(values)
    e, x = eigenpairs(v)
    long = np.longdouble
    assert np.abs(e - np.linalg.eigvalsh(v)[::-1]).max() < 1e-13
    assert np.abs(x.T.astype(long) @ x.astype(long) - np.eye(len(v))).max() < 1e-15
    assert np.abs(v.astype(long) @ x.astype(long) - x.astype(long) * e.astype(long)).max() < 1e-14


def test_single_precision_alone_is_not_enough():
    v = matrix(np.linspace(1, 2, 40))
    rough = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1].astype(float)
    fine = eigenpairs(v)[1]
    exact = np.linalg.eigh(v)[1][:, ::-1]
    error = lambda x: np.abs(np.abs((x * exact).sum(axis=0)) - 1).max()
    off = lambda x: np.abs(x.T @ v @ x - np.diag(np.diag(x.T @ v @ x))).max()
    assert off(rough) > 1e-8 and off(fine) < 1e-14 and error(fine) < 1e-14


def test_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in whitening.table(spark, sf, "embeddings").collect()]
    want = brute(rows)
    got = whitening.op11_query(spark, sf).collect()
    assert len(got) == 4 * len(want)
    signs = {}
    for r in got:
        n, deviation, z, explained = want[r["vec_id"]]
        k = r["component"] - 1
        sign = signs.setdefault(k, math.copysign(1, r["whitened"] * z[k]))
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(sign * r["whitened"] - z[k]) < 1e-8 and abs(r["explained"] - explained[k]) < 1e-9 and r["identity_error"] < 1e-9

"""Whitening of embeddings: single-precision eigenvectors of a distributed covariance, refined by matrix multiplications.

Entries are put on the grid ``floor(scale * c)``, so sums are sums of integers.  The fit list holds each distinct vector
once.  Its covariance is made in two passes of partial sums: the sums of each dimension, then the products of vectors from
which the nearest integer mean has been taken, exact as long as they fit 53 bits; the rest of the mean, at most a half, is
taken from the sums of these products.  Partial products are added up by the row of the matrix, so no task or driver reads
more than one matrix of dimensions by dimensions from each other task's share.

The eigenvectors are those of the matrix in float32, corrected by Ogita and Aishima's iteration in float64, then in long
double: with ``R = I - X'X`` and ``S = X'AX`` each vector takes up the error that the two show, ``(s_ij + l_j r_ij) / (l_j - l_i)``,
where eigenvalues are apart, and half of ``r_ij`` where they are not.  Where gaps are no larger than the error, the eigenvectors
of a cluster are those of a sub-problem: the matrix less the cluster's mean eigenvalue, seen from the cluster's own vectors,
which is small and so is solved to its own precision; the iteration then goes on.

Defined results: a row is left out if its vector is null, empty, holds a null or an entry that is not finite, or has another
number of dimensions than most rows of the table (of several such numbers the smallest); repeated rows are fitted once and
returned each; a null id is kept; a component exists only where its eigenvalue is more than 1e-12 of the trace, so a table with one distinct vector, or
none, gives an empty result; entries beyond the range of long are held at its ends; ``deviation`` is null where it does not
fit a long; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, table

SCALE = 256
COMPONENTS = 4
#: Eigenvalues up to this share of the trace are none.
NOTHING = 1e-12
#: Vectors multiplied at once.
CHUNK = 4096
ROUNDS = 12


@dataclass(frozen=True)
class Fit:
    """``n`` distinct vectors, the sums of their dimensions, and their leading components as columns of ``vectors``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = float("nan")


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def on_grid(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, x`` of the rows that are used."""
    vector = F.col(vec_col).cast("array<double>")
    own = rows.select(F.col(id_col).alias("vec_id"), vector.alias("v")).where(usable(F.col("v")))
    lengths = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    own = own.join(F.broadcast(lengths), F.size("v") == F.col("d"), "left_semi")  # one row
    return own.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("long")).alias("x"))


def stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, 0), np.int64)


def sums_of(distinct: DataFrame) -> tuple[int, list[int], int]:
    """The number of vectors, the sums of their dimensions, and their largest entry by size: one row per dimension."""
    sums = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()
    return (int(sums[0]["n"]), [int(r["s"]) for r in sums], max(max(abs(r["low"]), abs(r["high"])) for r in sums)) if sums else (0, [], 0)


def added(parts: DataFrame, d: int, whole: bool) -> np.ndarray:
    """Sums of partial matrices, ``(i, row)`` each: a group per row of the matrix."""
    kind = np.int64 if whole else np.float64

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(np.stack(rows["row"].to_numpy()), axis=0, dtype=kind)]})

    found = parts.groupBy("i").applyInPandas(add, parts.schema).collect()  # one row per row of the matrix
    out = np.zeros((d, d), kind)
    for r in found:
        out[r["i"]] = r["row"]
    return out


def covariance(distinct: DataFrame, n: int, sums: list[int], largest: int) -> np.ndarray:
    """The covariance of ``distinct(x)``, divisor ``n``."""
    d = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    reach = largest + max(map(abs, middle))
    whole = reach < 2**26 and n * reach**2 < 2**62
    step = max(1, min(CHUNK, 2**53 // max(reach, 1) ** 2)) if whole else CHUNK
    centre = np.array(middle, np.int64) if whole else np.array([s / n for s in sums])
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle, strict=True)])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d), np.int64 if whole else np.float64)
        for batch in batches:
            for at in range(0, len(batch), step):
                y = (stacked(batch.iloc[at : at + step]) - centre).astype(np.float64)
                product = y.T @ y
                total += product.astype(np.int64) if whole else product
        yield pd.DataFrame({"i": np.arange(d, dtype=np.int32), "row": list(total)})

    total = added(distinct.mapInPandas(products, f"i int, row array<{'long' if whole else 'double'}>"), d, whole)
    return total / n - np.outer(rest, rest) if whole else total / n


def sliced(m: np.ndarray, axis: int, bits: int, most: int) -> list[np.ndarray]:
    """A long-double matrix as a sum of float64 ones of ``bits`` bits each, on one grid per row or column."""
    out = []
    for _ in range(most):
        size = np.abs(m).max(axis=axis, keepdims=True)
        step = np.ldexp(np.longdouble(1), np.frexp(size)[1] - bits)
        part = np.rint(m / step) * step
        out.append(part.astype(np.float64))
        m = m - part
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``; in long double from exact float64 products of slices."""
    if a.dtype == np.float64:
        return a @ b
    bits = (52 - int(np.ceil(np.log2(max(2, a.shape[1]))))) // 2
    most = -(-66 // bits)
    left, right = sliced(a, 1, bits, most), sliced(b, 0, bits, most)
    total = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    for i, j in sorted(((i, j) for i in range(most) for j in range(most - i)), key=sum, reverse=True):
        total += left[i] @ right[j]
    return total


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: better vectors, the eigenvalues, the bound below which eigenvalues are not told apart, and the largest correction."""
    r = np.eye(len(a), dtype=x.dtype) - product(x.T, x)
    s = product(x.T, product(a, x))
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64)))
    near = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > near
    error = np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1), r / 2)
    return x + product(x, error), values, near, float(np.abs(error).max())


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Indices of eigenvalues, several each, whose neighbours are no further than ``near``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def orthogonal(x: np.ndarray) -> np.ndarray:
    """Nearly orthogonal columns made orthogonal to the precision of their type."""
    for _ in range(2):
        x = x + product(x, np.eye(x.shape[1], dtype=x.dtype) - product(x.T, x)) / 2
    return x


def separated(a: np.ndarray, x: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """The vectors of each cluster turned to the eigenvectors of their own small problem."""
    x = x.copy()
    for own in groups:
        part = orthogonal(x[:, own])
        image = product(a, part)
        shift = np.diag(product(part.T, image)).mean()
        small = product(part.T, image - shift * part)
        small = (small + small.T) / 2
        if scale := np.abs(small).max():
            turn = np.linalg.eigh((small / scale).astype(np.float64))[1]
            part = product(part, orthogonal(turn.astype(x.dtype)))
        x[:, own] = part
    return x


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, to double precision."""
    scale = float(np.abs(v).max()) or 1.0
    a = (v + v.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for kind, enough in ((np.float64, 1e-12), (np.longdouble, 1e-17)):
        a, x = a.astype(kind), orthogonal(x.astype(kind))
        last = np.inf
        for _ in range(ROUNDS):
            x, values, near, largest = corrected(a, x)
            if largest <= enough or largest > last / 4:  # as good as the type allows
                break
            if groups := clusters(values, near):
                x = separated(a, x, groups)
            else:
                last = largest
    x = orthogonal(x)
    values = (x * product(a, x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return (values[order] * scale).astype(np.float64), (x / np.sqrt((x * x).sum(axis=0))).astype(np.float64)


def whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    """The whitened coordinates of vectors, one column per component."""
    reach = max(map(abs, fit.sums), default=0)
    if len(x) and fit.n * int(np.abs(x.astype(np.float64)).max()) + reach < 2**62:
        centred = (x * fit.n - np.array(fit.sums, np.int64)) / fit.n
    else:
        centred = x.astype(np.float64) - np.array([s / fit.n for s in fit.sums])
    return centred @ (fit.vectors / np.sqrt(fit.values))


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """``sum((n x - S)^2)``, exact; null where it does not fit a long."""
    reach = fit.n * int(np.abs(x.astype(np.float64)).max() + 1) + max(map(abs, fit.sums)) if len(x) else 0
    if reach**2 * max(1, len(fit.sums)) < 2**62:
        y = x * fit.n - np.array(fit.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    found = [sum((fit.n * int(c) - s) ** 2 for c, s in zip(row, fit.sums, strict=True)) for row in x]
    return [f if f < 2**63 else None for f in found]


def identity_error(distinct: DataFrame, fit: Fit) -> float:
    """The largest entry of the whitened covariance of the fit list less the identity."""
    k = len(fit.values)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = np.c_[whitened(stacked(batch), fit), np.ones(len(batch))] if len(batch) else np.zeros((0, k + 1))
            total += w.T @ w
        yield pd.DataFrame({"i": np.arange(k + 1, dtype=np.int32), "row": list(total)})

    total = added(distinct.mapInPandas(products, "i int, row array<double>"), k + 1, False)
    mean = total[:k, k] / fit.n
    return float(np.abs(total[:k, :k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """What ``distinct(x array<long>)``, each vector once, gives; None without a component."""
    n, sums, largest = sums_of(distinct)
    if not n:
        return None
    v = covariance(distinct, n, sums, largest)
    trace = float(np.trace(v))
    values, vectors = eigenpairs(v)
    k = int((values[:components] > NOTHING * trace).sum())
    if not k:
        return None
    fit = Fit(n, sums, values[:k], vectors[:, :k], trace)
    return Fit(n, sums, fit.values, fit.vectors, trace, identity_error(distinct, fit))


def whitening(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per used row of ``rows`` and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    own = on_grid(rows, id_col, vec_col, scale)
    fit = fitted(cut(own.select("x").distinct()), components)
    schema = "vec_id " + rows.schema[id_col].dataType.simpleString() + ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return rows.sparkSession.createDataFrame([], schema)
    k = len(fit.values)
    explained = fit.values / fit.trace

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                x = stacked(part)
                deviation = pd.array(deviations(x, fit), dtype="Int64")
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].repeat(k).reset_index(drop=True), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), "n": fit.n, "deviation": deviation.repeat(k),
                    "whitened": whitened(x, fit).ravel(), "explained": np.tile(explained, len(part)), "identity_error": fit.identity_error,
                })

    return own.mapInPandas(project, schema)


def op11_query(spark, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))

"""Whitening of embeddings on their leading principal components, by a randomised range finder.

Entries become whole numbers, so that counts and sums are exact. The fit list, each distinct vector once, is settled
as a table; passes over all its centred rows multiply a sketch by the covariance, a partial product per partition, and
only the summed product (dimensions x sketch) comes to the driver. Rayleigh-Ritz in the sketch's range gives components
and their residuals. Where passes don't bring the residuals down to double precision, the sketch is widened to the full
dimension, where a single pass gives the covariance itself in a random basis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._work import settle


@dataclass(frozen=True)
class Params:
    """components: how many are returned at most. oversampling: further directions in the sketch. passes: power passes
    before the sketch is widened. tolerance: largest residual of a component, as a share of the largest eigenvalue.
    scale, shift: an entry c becomes floor(scale * c) + shift. seed: of the sketch."""

    components: int = 16
    oversampling: int = 16
    passes: int = 6
    tolerance: float = 1e-14
    scale: float = 64.0
    shift: int = 1_000_000
    seed: int = 12


#: An eigenvalue below this share of the sum of all is rounding: there is no component.
RANK = 1e-12
#: Entries whose whole numbers lie beyond this can't be summed up exactly in doubles, and count as not finite.
WIDE = float(1 << 52)


@dataclass(frozen=True)
class Fit:
    """n distinct vectors with sums; values: eigenvalues from the largest; vectors: a column each; trace: of the whole
    covariance; passes: how many were made; widened: whether the sketch became full; error: greatest entry of the whitened
    fit list's covariance less the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    widened: bool
    error: float = 0.0


def whole_numbers(vectors: DataFrame, params: Params, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector has finite entries only, all of the most frequent dimension."""
    e = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).alias("vec_id"), e.alias("e")).where(F.col("e").isNotNull()).where(F.forall("e", lambda c: F.coalesce(F.abs(c * params.scale) < WIDE, F.lit(False))))
    sizes = rows.groupBy(F.size("e").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.where(F.size("e") == (sizes["size"] if sizes else 0))
    return rows.select("vec_id", F.transform("e", lambda c: F.floor(c * params.scale).cast("long") + params.shift).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x less the mean. Numerators are whole numbers, so nothing is lost to the size of the shift."""
    top = int(np.abs(x).max(initial=0))
    if n * top < 1 << 62:
        return (n * x - sums.astype(np.int64)) / float(n)
    return ((x.astype(object) * n - sums) / n).astype(np.float64)


def _summed(fit: DataFrame, width: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of product(rows) over the fit list: a matrix of partial sums per partition, then one sum by row of it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                part = product(_matrix(batch.column(0), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    parts = fit.select("x").mapInArrow(B.frugal(work), "i int, v array<double>")

    def add(key, table):
        rows = np.stack(table.column("v").to_numpy(zero_copy_only=False))
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    rows = parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])


def _ritz(basis: np.ndarray, product: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, their vectors and residuals, in the basis's range; product: covariance x basis."""
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    pick = np.argsort(values)[::-1][:count]
    values, turn = values[pick], turn[:, pick]
    vectors = basis @ turn
    residuals = np.linalg.norm(product @ turn - vectors * values, axis=0)
    return values, vectors, residuals


def fit_components(fit: DataFrame, params: Params = Params()) -> Fit | None:
    """The components of the table fit (x: whole numbers, all rows distinct); None if it has no rows or no dimensions."""
    width = (fit.select(F.size("x").alias("d")).first() or {"d": 0})["d"]
    if not width:
        return None
    first = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    n, sums = first[0]["n"], np.array([int(r["s"]) for r in first], object)
    rng, count = np.random.default_rng(params.seed), min(params.components, width)

    def times(basis: np.ndarray) -> np.ndarray:
        def product(x):
            c = _centred(x, n, sums)
            return c.T @ (c @ basis)

        return _summed(fit, width, product) / n

    def squares(x):
        c = _centred(x, n, sums)
        return (c * c).sum(axis=0)[:, None]

    trace = float(_summed(fit, width, squares).sum() / n)
    size, made, widened, before = min(width, params.components + params.oversampling), 0, False, None
    basis = np.linalg.qr(rng.standard_normal((width, size)))[0]
    while True:
        widened |= size == width
        product = times(basis)
        values, vectors, residuals = _ritz(basis, product, count)
        made += 1
        worst = residuals.max(initial=0.0) / max(values[0], 1e-300)
        if size == width or worst <= params.tolerance:
            break
        # residuals fall by about the same factor each pass: widen as soon as the passes left can't reach the tolerance
        factor = worst / before if before else 0.0
        hopeless = made >= 3 and worst * factor ** max(0, params.passes - made) > params.tolerance
        if made >= params.passes or hopeless:
            size = width
            basis = np.linalg.qr(np.hstack([basis, rng.standard_normal((width, width - basis.shape[1]))]))[0]
        else:
            basis = np.linalg.qr(product)[0]
        before = worst
    keep = values > RANK * max(trace, 1e-300)
    values, vectors = values[keep], vectors[:, keep]
    found = Fit(n, tuple(int(s) for s in sums), values, vectors, trace, made, widened)
    if not len(values):
        return found

    def covariance(x):
        z = _centred(x, n, sums) @ vectors / np.sqrt(values)
        return z.T @ z

    error = float(np.abs(_summed(fit, width, covariance) / n - np.eye(len(values))).max())
    return Fit(n, found.sums, values, vectors, trace, made, widened, error)


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, params: Params = Params(), *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Rows whose vector is null, or holds null, infinite or missing numbers (or ones of 2**46 and more), are dropped, and so
    are those of another dimension than the most frequent one (of equally frequent ones the largest). Repeated rows
    stay; in the fit they count once, whatever their ids. A null id stays null. Directions in which the fit list does not
    vary are no components, so vectors that are all alike (or have no entries) give no rows. A deviation beyond a long is
    null. What the driver and each task hold is a few matrices of dimensions times sketch, at most dimensions squared.
    """
    rows = whole_numbers(embeddings, params, id_column, vector_column)
    fit = settle(rows.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "fit")
    found = fit_components(fit, params)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], OUT)
    n, sums, width, count = found.n, np.array(found.sums, object), len(found.sums), len(found.values)
    turn, explained = found.vectors / np.sqrt(found.values), found.values / found.trace

    def deviations(x: np.ndarray) -> list:
        top = int(np.abs(x).max(initial=0)) * n + int(np.abs(sums).max())
        if top * top * width < 1 << 62:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        reach = int(np.abs(n * x.astype(np.float64) - sums.astype(np.float64)).max(initial=0)) + 1
        if top < 1 << 62 and 4 * reach * reach * width < 1 << 62:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * n - sums) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in exact]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                x = _matrix(part.column(1), width)
                z = _centred(x, n, sums) @ turn
                which = np.repeat(np.arange(len(part)), count)
                columns = [
                    part.column(0).take(pa.array(which)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(which), n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(which)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(part))),
                    pa.array(np.full(len(which), found.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(B.frugal(work), OUT)

"""Whitening of embeddings by shifted Cholesky QR over distributed Gram passes.

Every entry c becomes the integer x = floor(64 c) + 1000000 (``scale`` and ``offset``). Let A hold the rows x - S / n, with the
sums S kept as exact integers. A pass multiplies the rows with the inverse of the triangular factor found so far and sums up
their Gram matrix: Q = A inverse(R), G = transpose(Q) Q = transpose(F) F, R = F R. The first factor takes the shift of shifted
CholeskyQR3 (Fukaya, Kannan, Nakatsukasa, Yamamoto, Yanagisawa 2020), which makes the factorisation exist for any condition
number; passes go on until G is the identity on the directions that A has. The SVD R = U diag(s) transpose(W) gives the
components W and the eigenvalues s^2 / n of the covariance, as accurate as an SVD of all rows.

Tasks hand on sums only: a pass shuffles one triangle of numbers for each task, and the driver holds matrices of the vectors'
dimension, whatever the number of rows.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

WIDEST = 2.0 ** 53  # larger integers count as this one
ROWS = 4096  # vectors worked on at a time
LEAST = 1e-12  # singular values below this share of the largest are no components
LONG = 2 ** 63 - 1
NEAR = 1e-6
PASSES = 5


class Centre(NamedTuple):
    """Count, exact sums and the largest distance of an entry from its mean."""

    n: int
    sums: list
    far: int
    offset: int


class Whitening(NamedTuple):
    """What a fit gives: the centre, the matrix (dimensions, components) of W / s * sqrt(n), shares of variance."""

    centre: Centre
    matrix: np.ndarray
    explained: np.ndarray


def _lists(batch):
    """(ids, values, lengths): the rows whose vector is neither null nor holds null or non-finite entries."""
    column = batch.column("vector")
    keep = column.is_valid()
    flat = column.flatten().cast(pa.float64())
    good = pc.fill_null(pc.is_finite(flat), False)
    size = pc.fill_null(pc.list_value_length(column), 0)
    bounds = np.zeros(len(column) + 1, np.int64)
    np.cumsum(size.to_numpy(zero_copy_only=False), out=bounds[1:])
    bad = np.zeros(bounds[-1] + 1, np.int64)
    np.cumsum(~good.to_numpy(zero_copy_only=False), out=bad[1:])
    keep = keep.to_numpy(zero_copy_only=False) & (bad[bounds[1:]] == bad[bounds[:-1]])
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
    return batch.column("vec_id"), values, bounds, np.flatnonzero(keep)


def _integers(batches, scale: int, offset: int, width: int | None = None):
    """(ids, x, lengths) blocks of integer vectors; shorter ones are filled up with ``offset``, as entries of zero are."""
    for batch in batches:
        ids, values, bounds, kept = _lists(batch)
        for at in range(0, len(kept), ROWS):
            rows = kept[at:at + ROWS]
            size = bounds[rows + 1] - bounds[rows]
            wide = int(size.max()) if width is None else width
            place = bounds[rows][:, None] + np.arange(wide)
            inside = np.arange(wide) < size[:, None]
            c = np.where(inside, values[np.minimum(place, max(len(values) - 1, 0))] if len(values) else 0.0, 0.0)
            x = np.floor(np.clip(c * scale, -WIDEST, WIDEST)).astype(np.int64) + offset
            yield ids.take(pa.array(rows)), x, size


def _counted(batches, scale, offset):
    """One row for each dimension met: entries, their sum in two parts, their least and largest; dimension -1 counts vectors."""
    n, parts = 0, np.zeros((5, 0), np.int64)
    for _, x, _ in _integers(batches, scale, offset):
        n += len(x)
        wide = x.shape[1]
        if wide > parts.shape[1]:
            more = np.zeros((5, wide - parts.shape[1]), np.int64)
            more[3], more[4] = LONG, -LONG
            parts = np.concatenate([parts, more], axis=1)
        parts[0, :wide] += len(x)
        parts[1, :wide] += (x >> 24).sum(0)
        parts[2, :wide] += (x & 0xFFFFFF).sum(0)
        parts[3, :wide] = np.minimum(parts[3, :wide], x.min(0)) if wide else 0
        parts[4, :wide] = np.maximum(parts[4, :wide], x.max(0)) if wide else 0
    if n:
        head = np.array([[-1], [n], [0], [0], [0], [0]], np.int64)
        body = np.concatenate([np.arange(parts.shape[1])[None], parts])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate([head, body], axis=1))),
                                         names=["dim", "entries", "high", "low", "least", "most"])


def _centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """x - S / n, rounded once."""
    if 2 * centre.n * (int(np.abs(x).max(initial=0)) + 1) < LONG:
        return (centre.n * x - np.array(centre.sums, np.int64)) / centre.n
    return ((centre.n * x.astype(object) - np.array(centre.sums, object)) / centre.n).astype(float)


def _deviations(x: np.ndarray, centre: Centre) -> pa.Array:
    """The sum over dimensions of (n x - S)^2, exact; null where it is no 64-bit integer."""
    if x.shape[1] * (centre.n * centre.far) ** 2 <= LONG and 2 * centre.n * (int(np.abs(x).max(initial=0)) + 1) < LONG:
        return pa.array(((centre.n * x - np.array(centre.sums, np.int64)) ** 2).sum(1))
    wide = centre.n * x.astype(object) - np.array(centre.sums, object)
    return pa.array([d if d <= LONG else None for d in (sum(v * v for v in row) for row in wide)], pa.int64())


def _gram(batches, scale, offset, centre, matrix):
    """(cell, value): the upper triangle of the Gram matrix of the task's rows times ``matrix``, then their sums."""
    d = matrix.shape[1]
    total, sums, any_row = np.zeros((d, d)), np.zeros(d), False
    for _, x, _ in _integers(batches, scale, offset, len(centre.sums)):
        q = _centred(x, centre) @ matrix
        total += q.T @ q
        sums += q.sum(0)
        any_row = True
    if any_row:
        values = np.concatenate([total[np.triu_indices(d)], sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)],
                                         names=["cell", "value"])


def _projected(batches, scale, offset, fit: Whitening, error):
    centre, k = fit.centre, fit.matrix.shape[1]
    for ids, x, _ in _integers(batches, scale, offset, len(centre.sums)):
        n, white = len(x), _centred(x, centre) @ fit.matrix
        again = pa.array(np.repeat(np.arange(n), k))
        yield pa.RecordBatch.from_arrays(
            [ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, centre.n)),
             _deviations(x, centre).take(again), pa.array(white.reshape(-1)), pa.array(np.tile(fit.explained, n)),
             pa.array(np.full(n * k, error))], names=OUT_NAMES)


OUT = ("vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double")
OUT_NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))


def centre_of(vectors: DataFrame, scale: int, offset: int) -> Centre | None:
    """The centre of all vectors kept; None if there are none or they have no entries."""
    found = vectors.mapInArrow(partial(_counted, scale=scale, offset=offset),
                               "dim long, entries long, high long, low long, least long, most long")
    rows = found.groupBy("dim").agg(F.sum("entries").alias("entries"), F.sum("high").alias("high"), F.sum("low").alias("low"),
                                    F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    if len(rows) < 2:
        return None
    n, dims = rows[0].entries, rows[1:]
    sums = [(r.high << 24) + r.low + (n - r.entries) * offset for r in dims]
    filled = [(min(r.least, offset), max(r.most, offset)) if r.entries < n else (r.least, r.most) for r in dims]
    return Centre(n, sums, max(most - least for least, most in filled), offset)


def gram(vectors: DataFrame, scale: int, centre: Centre, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and sums of all centred rows times ``matrix``."""
    d = matrix.shape[1]
    made = vectors.mapInArrow(partial(_gram, scale=scale, offset=centre.offset, centre=centre, matrix=matrix),
                              "cell int, value double")
    values = np.zeros(d * (d + 1) // 2 + d)
    for r in made.groupBy("cell").agg(F.sum("value").alias("value")).collect():
        values[r.cell] = r.value
    upper = np.zeros((d, d))
    upper[np.triu_indices(d)] = values[:-d]
    return upper + np.triu(upper, 1).T, values[-d:]


def _factor(g: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular F with transpose(F) F = G, or G plus the least shift with which that exists."""
    d, unit = len(g), np.finfo(float).eps / 2
    shift = 0.0
    step = 11 * (n * d + d * (d + 1)) * unit * np.linalg.norm(g, 2) or 1.0
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = step if shift == 0 else 10 * shift


def fit_whitening(vectors: DataFrame, components: int, scale: int, offset: int) -> Whitening | None:
    """Fit on all rows of ``vectors`` (vec_id, vector); None if they vary in no direction."""
    centre = centre_of(vectors, scale, offset)
    if centre is None or centre.far == 0:
        return None
    d = len(centre.sums)
    r, inverse = np.eye(d), np.eye(d)
    for turn in range(PASSES + 1):
        g, _ = gram(vectors, scale, centre, inverse)
        lengths, ways = np.linalg.eigh(g)
        if turn == PASSES or turn and np.all((np.abs(lengths - 1) < NEAR) | (lengths < 1e-3)):
            break  # orthonormal, but for directions in which no row differs; what is left to 1 goes into the last factor
        f = _factor(g, centre.n)
        r = f @ r
        inverse = inverse @ np.linalg.solve(f, np.eye(d))
    root = np.sqrt(np.maximum(lengths, 0))[:, None] * ways.T  # transpose(root) root = the last Gram matrix
    _, s, w = np.linalg.svd(root @ r)
    k = min(components, int((s > LEAST * s[0]).sum()))
    if not k:
        return None
    return Whitening(centre, w[:k].T / s[:k] * np.sqrt(centre.n), s[:k] ** 2 / (s ** 2).sum())


def whitened(table: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every kept row and component.

    Rows whose vector is null or holds a null, infinite or NaN entry are dropped. Rows of equal or null id all count and are
    returned. Vectors shorter than the longest count as filled up with zeros; scaled entries beyond 2^53 as 2^53. Directions
    in which the vectors do not differ (singular value below 1e-12 of the largest) are no components, so equal vectors, a single
    vector, empty vectors and an empty table give no rows. ``deviation`` is null where it does not fit a long. Other columns are
    not read.
    """
    vectors = _vectors(table, id_col, vector_col)
    out = OUT.format(vectors.schema["vec_id"].dataType.simpleString())
    fit = fit_whitening(vectors, components, scale, offset)
    if fit is None:
        return table.sparkSession.createDataFrame([], out)
    g, sums = gram(vectors, scale, fit.centre, fit.matrix)
    n = fit.centre.n
    error = float(np.abs(g / n - np.outer(sums / n, sums / n) - np.eye(len(sums))).max())
    return vectors.mapInArrow(partial(_projected, scale=scale, offset=offset, fit=fit, error=error), out)

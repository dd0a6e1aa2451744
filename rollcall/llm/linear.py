"""Hashed n-gram logistic regression: features, fitting on a bounded sample, calibration, scoring.

A text is the mean of its hashed word unigrams, word bigrams and character trigrams, each group
averaged on its own, so that a score is a sum of three mean weights and needs one pass and one weight
table of fixed size. Fitting runs in one task over the sample, whose size is a parameter.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.vec import BLANK, Block, U, blocks, mix, per_row

BITS = 16
MASK = U((1 << BITS) - 1)
SIZE = 3 << BITS


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the bounds of its rows among them."""
    lead = (block.data & 0xC0) != 0x80
    count = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    chars = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(chars) == count[-1]:
        return chars, count[block.bounds]
    rows = [np.frombuffer(block.data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            for a, b in zip(block.bounds[:-1], block.bounds[1:])]  # bytes that are no UTF-8
    return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


def features(block: Block, lower: bool = True):
    """Three groups of (bucket, row bounds): words, word pairs, character trigrams."""
    words = block.words(BLANK, lower)
    yield (words.hash & MASK).astype(np.int64), words.bounds
    at, pairs = words.grams(2)
    yield (pairs & MASK).astype(np.int64) + (1 << BITS), np.searchsorted(at, words.bounds)
    chars, bounds = code_points(block)
    if len(chars) < 3:
        yield np.empty(0, np.int64), np.zeros(block.rows + 1, np.int64)
        return
    c = chars.astype(U)
    with np.errstate(over="ignore"):
        h = (c[:-2] * U(0x9E3779B97F4A7C15) + c[1:-1] * U(0xC2B2AE3D27D4EB4F) + c[2:]) * U(0xD6E8FEB86659FD93)
    index = (h >> U(64 - BITS)).astype(np.int64) + (2 << BITS)
    inside = np.zeros(len(chars) + 1, np.int64)  # trigrams that start before a place and stay in one row
    ok = np.ones(len(index), bool)
    for cut in np.unique(bounds[(bounds > 0) & (bounds < len(chars))]):
        ok[max(0, cut - 2):cut] = False
    np.cumsum(ok, out=inside[1:len(ok) + 1])
    inside[len(ok) + 1:] = inside[len(ok)]
    yield index[ok], inside[bounds]


def raw_scores(block: Block, weights: np.ndarray, lower: bool = True) -> np.ndarray:
    """Linear scores of a block's rows; an empty text scores the intercept, which is weights[-1]."""
    out = np.full(block.rows, float(weights[-1]))
    for index, bounds in features(block, lower):
        out += per_row(weights[index].astype(np.float64), bounds) / np.maximum(np.diff(bounds), 1)
    return out


def probability(raw: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] * raw + scale[1], -60, 60)))


def matrix(texts, lower: bool = True):
    """(row, feature, value) of a text column, summed by row and feature, and the number of rows."""
    rows, cols, vals, n = [], [], [], 0
    for block in blocks(texts):
        r, c, v = [], [], []
        for index, bounds in features(block, lower):
            size = np.diff(bounds)
            r.append(np.repeat(np.arange(block.rows), size))
            c.append(index)
            v.append(np.repeat(1 / np.maximum(size, 1), size))
        r, c, v = map(np.concatenate, (r, c, v))
        key, where = np.unique(r * SIZE + c, return_inverse=True)
        rows.append(key // SIZE + n)
        cols.append(key % SIZE)
        vals.append(np.bincount(where, v, len(key)))
        n += block.rows
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals), n


def fit(texts, target: np.ndarray, lower: bool = True, steps: int = 150, decay: float = 1e-5,
        rate: float = 1.0) -> np.ndarray:
    """Weights (intercept last) by Adam over the whole sample; targets lie in [0, 1]."""
    row, col, val, n = matrix(texts, lower)
    used, col = np.unique(col, return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)))
    m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for i in range(1, steps + 1):
        z = np.bincount(row, w[col] * val, n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / n
        grad = np.append(np.bincount(col, g[row] * val, len(used)) + decay * w, g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        w -= step[:-1]
        b -= step[-1] * 0.1
    out = np.zeros(SIZE + 1, np.float32)
    out[used], out[-1] = w, b
    return out


def calibrate(raw: np.ndarray, target: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling: slope and offset by Newton steps, with the targets drawn in a little."""
    if len(raw) < 20 or target.min() == target.max():
        return 1.0, 0.0
    pos, neg = (target > 0.5).sum(), (target <= 0.5).sum()
    t = np.where(target > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.stack([raw, np.ones(len(raw))], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * (beta - [1, 0])), -1, 1)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _train(batches, lower: bool):
    given = [b for b in batches if b.num_rows]
    if given:
        table = pa.Table.from_batches(given).sort_by("doc_id")
        y = table.column("target").to_numpy().astype(float)
        texts = table.column("text").combine_chunks()
        held = np.arange(len(y)) % 4 == 3
        weights = fit(texts.filter(pa.array(~held)), y[~held], lower) if (~held).any() and y[~held].min() < y[~held].max() \
            else np.append(np.zeros(SIZE, np.float32), np.float32(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
        raw = np.concatenate([raw_scores(b, weights, lower) for b in blocks(texts.filter(pa.array(held)))] or [np.empty(0)])
        scale = calibrate(raw, y[held])
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "scale": [json.dumps(scale)]})


def trained(sample: DataFrame, lower: bool = True):
    """(weights, scale) from rows doc_id, text, target; None without rows.

    The sample must be bounded by its caller; it is fitted in one task, a quarter of it is held
    out for the calibration.
    """
    rows = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("target").cast("double")) \
        .repartition(1).mapInArrow(partial(_train, lower=lower), "weights binary, scale string").collect()
    if not rows:
        return None
    return np.frombuffer(rows[0].weights, np.float32), tuple(json.loads(rows[0].scale))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents, drawn by a hash of their id; docs has doc_id and text."""
    marks = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).alias("target"))
    drawn = marks.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    return docs.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"])

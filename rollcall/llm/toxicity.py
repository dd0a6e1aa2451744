"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors.

Units are hashed words and word beginnings of four and five characters. Units that are clearly more
frequent in documents marked toxic become voters, together with voters for a written lexicon and for
patterns; a voter fires on a document or abstains. The label model (EM) estimates for each voter how
often it fires on toxic and on clean documents, and from what the posterior leaves unexplained which voters
are correlated; a correlated group counts as one voter. The classifier is a
sparse logistic regression over the presence of the units that lean to one side, trained on the posteriors of the
label model and calibrated on held-out marks. It reads nothing but the text.
"""

from __future__ import annotations

import json
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.linear import calibrate, labelled_sample, probability
from rollcall.llm.vec import ALNUM, Block, U, blocks, hash_runs, mix
from rollcall.llm.work import id_text

# General words of abuse, by language.
LEXICON = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb",
    "idioten dumm dreck abschaum widerlich arschloch versager",
    "idiote stupide ordure salaud connard minable",
    "idiota estupido basura escoria imbecil asqueroso",
)
PATTERNS = (r"\b(you|du|tu)\s+(are|bist|es|eres)\s+(a|an|ein|une?|una)\s+\w+\s*!", r"!{3,}", r"\b\w*[*@#$]\w+[*@#$]\w*\b",
            r"\b(shut up|go away|get lost|halt die|ta gueule|callate)\b")
STEMS = (4, 5)
VOTERS = 256


def units(block: Block):
    """(row, hash) of every word and word beginning of a block."""
    words = block.words(ALNUM, True)
    row = words.row
    yield row, words.hash
    lead = (words.data & 0xC0) != 0x80
    count = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=count[1:])
    place = np.append(np.flatnonzero(lead), len(lead))
    begin, size = count[words.start], count[words.end] - count[words.start]
    for k in STEMS:
        long = np.flatnonzero(size >= k)
        yield row[long], mix(hash_runs(words.data, words.start[long], place[begin[long] + k]), 30 + k)


def _presence(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, unit) of a text column."""
    rows, found = [], []
    for block in blocks(texts):
        for row, h in units(block):
            rows.append(row + block.first)
            found.append(h)
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _groups(alike: np.ndarray) -> np.ndarray:
    """Group number of each voter: the components of the relation ``alike``."""
    group = np.arange(len(alike))
    while True:
        least = np.where(alike, group[None, :], len(alike)).min(1)
        least = least[least]
        if (least == group).all():
            return np.unique(group, return_inverse=True)[1]
        group = least


def _em(votes: np.ndarray, belief: np.ndarray, steps: int, trust: float):
    """(posterior, fire rate on toxic, fire rate on clean) with independent voters; the prior stays."""
    prior = float(np.clip(belief.mean(), 1e-3, 1 - 1e-3))
    marked = np.where(belief > 0.5, trust, -trust)
    for _ in range(steps):
        on = np.clip((votes.T @ belief + 0.1) / (belief.sum() + 1), 1e-5, 1 - 1e-5)
        off = np.clip((votes.T @ (1 - belief) + 0.01) / ((1 - belief).sum() + 1), 1e-5, 1 - 1e-5)
        z = np.log(prior / (1 - prior)) + marked + votes @ np.log(on / off) + (1 - votes) @ np.log((1 - on) / (1 - off))
        now = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        done = np.abs(now - belief).max() < 1e-6
        belief = now
        if done:
            break
    return belief, on, off


def label_model(votes: np.ndarray, start: np.ndarray, steps: int = 20, related: float = 0.3,
                trust: float = 3.0):
    """(posterior of each row, group of each voter, the groups' fire rates on toxic and on clean rows).

    ``votes`` is a 0/1 matrix rows x voters, ``start`` are the marks of the rows, which count
    as one more voter of ``trust`` log odds: without it the voters of one language could become the class. Voters are fitted as if
    independent; what that leaves unexplained gives their correlations, and a correlated group then counts
    as one voter that fires if any of its members does.
    """
    v = votes.astype(float)
    belief, on, off = _em(v, start.astype(float), steps, trust)
    rest = v - (belief[:, None] * on + (1 - belief[:, None]) * off)
    scale = np.sqrt((rest**2).mean(0)) + 1e-9
    group = _groups((rest.T @ rest / len(v) / np.outer(scale, scale) > related) | np.eye(v.shape[1], dtype=bool))
    joint = np.zeros((len(v), group.max() + 1))
    np.maximum.at(joint, (slice(None), group), v)
    belief, on, off = _em(joint, start.astype(float), steps, trust)
    return belief, group, on, off


def _sparse_fit(row, col, n, m, target, steps: int = 200, rate: float = 0.1, shrink: float = 1e-4):
    """Logistic regression over 0/1 features by Adam with soft thresholding."""
    w, b = np.zeros(m), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    g1, g2 = np.zeros(m + 1), np.zeros(m + 1)
    for i in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + b
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / n
        grad = np.append(np.bincount(col, err[row], m), err.sum())
        g1, g2 = 0.9 * g1 + 0.1 * grad, 0.99 * g2 + 0.01 * grad**2
        size = rate / (np.sqrt(g2 / (1 - 0.99**i)) + 1e-4)
        step = size * (g1 / (1 - 0.9**i))
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(size[:-1] * shrink, 0.02), 0)
        b -= step[-1]
    return w, b


def _fit(batches):
    given = [b for b in batches if b.num_rows]
    if not given:
        return
    table = pa.Table.from_batches(given).sort_by("doc_id")
    y, texts = table.column("target").to_numpy().astype(float), table.column("text").combine_chunks()
    n = len(y)
    row, h = _presence(texts)
    known, col = np.unique(h, return_inverse=True)
    held = np.arange(n) % 4 == 3
    train = ~held[row]
    pos = np.bincount(col[train], y[row[train]], len(known))
    neg = np.bincount(col[train], 1 - y[row[train]], len(known))
    n_pos, n_neg = max(y[~held].sum(), 1), max((1 - y[~held]).sum(), 1)
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    mined = np.flatnonzero((pos >= 3) & (odds > 2.5))
    mined = mined[np.argsort(-(pos * odds)[mined], kind="stable")][:VOTERS]
    votes = np.zeros((n, len(mined) + len(LEXICON) + len(PATTERNS)), bool)
    at = np.full(len(known), -1)
    at[mined] = np.arange(len(mined))
    fires = at[col] >= 0
    votes[row[fires], at[col[fires]]] = True
    plain = [t.lower() for t in texts.to_pylist()]
    lexicon = [re.compile(rf"\b({'|'.join(words.split())})\b") for words in LEXICON]
    for j, p in enumerate([*lexicon, *map(re.compile, PATTERNS)]):
        votes[:, len(mined) + j] = [p.search(t) is not None for t in plain]
    belief, *_ = label_model(votes[~held], y[~held])
    target = np.zeros(n)
    target[~held] = belief
    kept = np.flatnonzero((pos + neg >= 3) & ((odds > 1.5) | (odds < -2)))
    at = np.full(len(known), -1)
    at[kept] = np.arange(len(kept))
    new_row = np.cumsum(~held) - 1
    fit_on = train & (at[col] >= 0)
    w, b = _sparse_fit(new_row[row[fit_on]], at[col[fit_on]], int((~held).sum()), len(kept), target[~held])
    all_on = at[col] >= 0
    raw = np.bincount(row[all_on], w[at[col[all_on]]], n) + b
    scale = calibrate(raw[held], y[held])
    live = np.abs(w) > 1e-6
    yield pa.RecordBatch.from_pydict({
        "unit": [known[kept[live]].tobytes()], "weight": [w[live].tobytes()],
        "rest": [json.dumps({"b": b, "scale": scale, "voters": int(votes.shape[1])})]})


class Model:
    """Units (sorted) with their weights, the intercept, and the calibration."""

    def __init__(self, unit: np.ndarray, weight: np.ndarray, b: float, scale) -> None:
        self.unit, self.weight, self.b, self.scale = unit, weight, b, scale

    def scores(self, block: Block) -> np.ndarray:
        rows, places = [], []
        for row, h in units(block):
            if len(self.unit) and len(h):
                k = np.minimum(np.searchsorted(self.unit, h), len(self.unit) - 1)
                hit = self.unit[k] == h
                rows.append(row[hit])
                places.append(k[hit])
        raw = np.full(block.rows, self.b)
        if rows:
            pair = np.unique(np.concatenate(rows) * len(self.unit) + np.concatenate(places))
            raw += np.bincount(pair // len(self.unit), self.weight[pair % len(self.unit)], block.rows)
        return probability(raw, self.scale)


def train(sample: DataFrame) -> Model:
    """A model from a bounded sample (doc_id, text, target), fitted in one task; without rows all scores are 0."""
    rows = sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("target").cast("double")) \
        .repartition(1).mapInArrow(_fit, "unit binary, weight binary, rest string").collect()
    if not rows:
        return Model(np.empty(0, U), np.empty(0), -60.0, (1.0, 0.0))
    rest = json.loads(rows[0].rest)
    return Model(np.frombuffer(rows[0].unit, U), np.frombuffer(rows[0].weight), rest["b"], rest["scale"])


def _score(batches, model, least: float):
    for batch in batches:
        for block in blocks(batch.column("text")):
            score = model.value.scores(block)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(block.first, block.rows), "score": score,
                "predicted": pa.array((score >= least).astype(np.int32))})


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.3, sample_rows: int = 6000, folds: int = 4,
             held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    A row is held out if crc32(id as text) mod ``folds`` is ``held``; marks of held-out rows are never read. The
    model is fitted on at most ``sample_rows`` other marked rows, drawn by a hash of the id, in one task.
    Null texts score as empty ones. A null id is not held out and stays null. Contradicting marks of one id
    count as toxic. Without marks every score is near 0. An empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    model = train(labelled_sample(rows, labels.where(~out), "toxic", sample_rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(partial(_score, model=shared, least=least), "doc_id long, score double, predicted int") \
        .select("doc_id", out.alias("held_out"), "score", "predicted")

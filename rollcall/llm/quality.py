"""Quality rules: base counts, and a hashed n-gram logistic regression trained on labelled rows."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.linear import labelled_sample, probability, raw_scores, trained
from rollcall.llm.vec import BLANK, Block, Words, blocks, hash_runs, mix, per_row, U
from rollcall.llm.work import id_text

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8


def _own(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    return mix(keys ^ mix(row.astype(U), 9), 10)


def dup_lines(block: Block, words: Words) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier line of the row."""
    breaks = np.flatnonzero(block.data == 10)
    start = np.unique(np.concatenate([block.bounds[:-1], breaks + 1]))
    start = start[start < len(block.data)]
    row = np.searchsorted(block.bounds, start, "right") - 1
    end = block.bounds[row + 1]
    if len(breaks):
        following = np.searchsorted(breaks, start)
        end = np.where(following < len(breaks), np.minimum(end, breaks[np.minimum(following, len(breaks) - 1)]), end)
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, row = start[full], end[full], row[full]
    again = np.ones(len(start), bool)
    again[np.unique(_own(hash_runs(block.data, start, end), row), return_index=True)[1]] = False
    return np.bincount(row[again], minlength=block.rows)


def repeat_words(words: Words) -> np.ndarray:
    """Words of each row in a window of eight that the row holds twice or more."""
    at, grams = words.grams(WINDOW)
    _, where, times = np.unique(_own(grams, words.row[at]), return_inverse=True, return_counts=True)
    first = at[times[where] > 1]
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + WINDOW, -1)
    return per_row(np.cumsum(cover)[:-1] > 0, words.bounds)


def counts(block: Block) -> dict[str, np.ndarray]:
    words = block.words(BLANK, False)
    lead = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=lead[1:])
    return {"n_words": words.count, "word_chars": per_row(lead[words.end] - lead[words.start], words.bounds),
            "n_symbols": per_row(SYMBOLS[block.data], block.bounds), "n_dup_lines": dup_lines(block, words),
            "n_repeat_words": repeat_words(words)}


def _score(batches, model, least: float):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            out = counts(block)
            bad = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
            score = probability(raw_scores(block, model[0]), model[1]) if model else np.ones(block.rows)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": ids.slice(block.first, block.rows)}
                | {k: v.astype(np.int64) for k, v in out.items()}
                | {"score": score, "base_failed": bad, "kept": ~bad & (score >= least)})


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = 3000,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, calibrated probability of good quality, and verdict of every row of ``docs``.

    The classifier is fitted on at most ``sample_rows`` labelled documents, drawn by a hash of the id,
    in one task. A null text counts as empty (no words, base_failed). Without labelled rows the score
    is 1 and only the base rules decide. Repeated rows are scored each; a null id stays null. Labels that
    contradict each other count as good. An empty table gives no rows. Other columns are not read.
    """
    rows = id_text(docs, id_col, text_col)
    model = trained(labelled_sample(rows, labels, "quality", sample_rows))
    return rows.mapInArrow(
        partial(_score, model=model, least=least),
        "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double, base_failed boolean, kept boolean")


def _verdict(batches, model, least: float, text_col: str):
    for batch in batches:
        good = np.concatenate([
            ~((c := counts(b))["n_words"] < 20) & (100 * c["n_repeat_words"] <= 30 * c["n_words"])
            & (probability(raw_scores(b, model[0]), model[1]) >= least if model else True)
            for b in blocks(batch.column(text_col))] or [np.empty(0, bool)])
        yield batch.filter(pa.array(good, pa.bool_()))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = 3000,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, in one pass and without a shuffle of texts."""
    model = trained(labelled_sample(id_text(docs, id_col, text_col), labels, "quality", sample_rows))
    return docs.mapInArrow(partial(_verdict, model=model, least=least, text_col=text_col), docs.schema)

"""Token counts: cached pieces for ordinary texts, overlap resynchronisation for huge ones.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring encodings are spliced at a place
of their overlap that is a token start in both and stands right after white space: the pre-tokenizer never
joins characters across white space and the normalizer composes nothing with it, so what follows such a
place does not depend on what precedes it. Without such a place the overlap is doubled, and in
the end the chunk itself, up to the whole text.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.vec import text_array
from rollcall.llm.work import id_text

CACHE = 400_000
GAPS = "\t\n\v\f\r "


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizers library's reader of ``path``; one thread, since Spark runs one task a core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Pieces:
    """What ``make`` gives for pieces of text. The first ``limit`` pieces stay known, later ones for one call."""

    def __init__(self, make, limit: int = CACHE) -> None:
        self.make, self.limit, self.known, self.passing = make, limit, {}, []

    def of(self, lists: list[list[str]]) -> dict:
        """A table that has every piece of ``lists``, until the next call."""
        for piece in self.passing:
            del self.known[piece]
        new = list(set().union(*lists).difference(self.known))
        self.known.update(zip(new, self.make(new)))
        self.passing = new if len(self.known) > self.limit else []
        return self.known


# Latin letters and then marks without an apostrophe: every pre-tokenizer here cuts between the two.
_WORD_AND_MARKS = re.compile(r"(\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


def halves(piece: str) -> tuple[str, str]:
    """A piece cut where its word ends and its marks begin; words repeat more than the two together."""
    found = _WORD_AND_MARKS.fullmatch(piece)
    return found.groups() if found else (piece, "")


def encodings(path: str, texts: list[str], step: int = 4096):
    """(ids, bounds of each text among them) for texts encoded one by one, in chunks of ``step``."""
    chunks = [texts[i:i + step] for i in range(0, len(texts), step)]
    for chunk, found in zip(chunks, tokenizer(path).encode_batch(chunks, is_pretokenized=True, add_special_tokens=False)):
        yield np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(chunk) + 1))


def splice(text: str, encode, chunk: int, overlap: int) -> list[int]:
    """Token ids of a whole text from encodings (ids, starts) of overlapping chunks of it."""
    def part(a: int, b: int):
        ids, starts = encode(text[a:b])
        return ids, [a + s for s in starts]

    out, at, size = [], 0, chunk
    end = min(size, len(text))
    ids, starts = part(0, end)
    while end < len(text):
        lap, joined = overlap, False
        while end - lap > at and not joined:
            begin = end - lap
            shared = text[begin + 1:end]
            if not any(gap in shared for gap in GAPS):  # nothing to splice at
                lap *= 2
                continue
            stop = min(begin + max(size, 2 * lap), len(text))
            more, places = part(begin, stop)
            have = set(starts[bisect_left(starts, begin + 1):])
            for i in range(bisect_left(places, begin + 1), len(places)):
                p = places[i]
                if p in have and text[p - 1] in GAPS and text[p] not in GAPS and places[i - 1] < p:
                    out += ids[:bisect_left(starts, p)]
                    ids, starts, at, end, joined = more[i:], places[i:], p, stop, True
                    break
            lap *= 2
        if joined:
            size = chunk
        else:
            size *= 2
            end = min(at + size, len(text))
            ids, starts = part(at, end)
    return out + ids


def _encode(path: str):
    def encode(text: str):
        found = tokenizer(path).encode(text, add_special_tokens=False)
        return found.ids, [a for a, _ in found.offsets]

    return encode


@lru_cache(maxsize=2)
def _known_sizes(path: str) -> Pieces:
    """Token counts of pieces, kept for all tasks of a worker."""
    words = Pieces(lambda texts: [n for _, b in encodings(path, texts) for n in np.diff(b).tolist()])

    def make(pieces: list[str]) -> list[int]:
        cut = [halves(x) for x in pieces]
        n = words.of([[w for w, _ in cut], [m for _, m in cut]])
        return [n[w] + n[m] for w, m in cut]

    return Pieces(make)


def _count(batches, path: str, limit: int, chunk: int, overlap: int):
    pieces = _known_sizes(path)
    for batch in batches:
        texts = text_array(batch.column("text")).to_pylist()
        n = [0] * len(texts)
        for first in range(0, len(texts), 256):
            lists = {}
            for i in range(first, min(first + 256, len(texts))):
                if len(texts[i]) > chunk:
                    n[i] = len(splice(texts[i], _encode(path), chunk, overlap))
                else:
                    lists[i] = texts[i].replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            known = pieces.of(list(lists.values()))
            for i, found in lists.items():
                n[i] = sum(map(known.__getitem__, found))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
            "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n])})


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = 16_384, overlap: int = 256,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` under a .json tokenizer.

    The tokenizer must drop or split at white space. Null texts count as empty: no bytes, no tokens. Repeated
    rows are counted each, null ids stay null, an empty table gives no rows. Other columns are not read.
    """
    rows = id_text(docs, id_col, text_col).withColumn(
        "n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return rows.mapInArrow(partial(_count, path=path, limit=limit, chunk=chunk, overlap=overlap),
                           "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

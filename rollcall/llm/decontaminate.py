"""Benchmark decontamination: prefix-filtered set join with exact containment over item-sized windows.

Every benchmark window (ten consecutive item words, or a whole shorter item) is a set of (place, word pair)
tokens that a document place must contain in full. Tokens are ordered by rarity: one pass counts how often
each benchmark word pair occurs in all documents. Full containment needs every token, so a prefix of one,
the rarest, is enough: a document place is a candidate only where that pair occurs. The place of the pair in
the window fixes where the window would start (positional bound), which must leave room for all of its
words inside the document (length bound). A candidate is then checked against all words of the window.
Where a pair is the rarest of many windows, a candidate is matched by the hash of its whole window
instead of by each window, so that frequent pairs cost one look-up a place and window length.

Windows are broadcast in blocks of at most ``block_windows`` rows, whatever the size of the benchmark:
a stated query set against all documents, block by block. Documents are never shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.vec import ALNUM, U, blocks, gram_hash, signed
from rollcall.llm.work import TEXT, written



def _windows(batches, width: int):
    """(item, window hash, size, hashes of the pairs at its places) of every window of every item."""
    for batch in batches:
        ids = batch.column("item")
        for block in blocks(batch.column("text")):
            words = block.words(ALNUM, True)
            item, window, size, pairs = [], [], [], []
            for r in range(block.rows):
                n = int(words.count[r])
                if not n:
                    continue
                h, w = words.hash[words.bounds[r]:words.bounds[r + 1]], min(width, n)
                for i in range(n - w + 1):
                    item.append(ids[block.first + r].as_py())
                    size.append(w)
                    window.append(int(signed(gram_hash([h[i + j:i + j + 1] for j in range(w)]))[0]))
                    tokens = gram_hash([h[i:i + w - 1], h[i + 1:i + w]]) if w > 1 else gram_hash([h[i:i + 1]])
                    pairs.append(signed(tokens))
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(window, pa.int64()), pa.array(size, pa.int32()),
                 pa.array(pairs, pa.list_(pa.int64()))], names=["item", "window", "size", "pairs"])


def _tokens(words, singles: bool):
    """(place, hash) of every word pair of a block, and of every word where one-word items ask for it."""
    return (words.grams(2), words.grams(1)) if singles else (words.grams(2),)


def _count(batches, known: np.ndarray, singles: bool):
    """How often each known token occurs in a task's documents."""
    total = np.zeros(len(known), np.int64)
    for batch in batches:
        for block in blocks(batch.column("text")):
            for _, h in _tokens(block.words(ALNUM, True), singles):
                if len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    total += np.bincount(at[known[at] == h], minlength=len(known))
    some = total > 0
    yield pa.RecordBatch.from_pydict({"token": signed(known[some].copy()), "n": total[some]})


class Prefixes:
    """The windows of one block, found by (rarest token, its place, window size)."""

    def __init__(self, rows, often: dict[int, int]) -> None:
        best = {}
        for r in rows:
            rank, place = min((often.get(t, 0), i) for i, t in enumerate(r.pairs))
            best.setdefault((r.size, place), []).append((r.pairs[place], r.window))
        self.groups = []
        for (size, place), found in sorted(best.items()):
            tokens, windows = (np.array(x, np.int64).view(U) for x in zip(*found))
            self.groups.append((size, place, np.unique(tokens), np.unique(windows)))
        order = np.argsort(np.array([r.window for r in rows], np.int64).view(U), kind="stable")
        self.window = np.array([r.window for r in rows], np.int64).view(U)[order]
        self.items = [rows[i].items for i in order]
        self.tokens = np.unique(np.concatenate([g[2] for g in self.groups]))
        # the (size, place) groups that a token leads
        self.singles = any(g[0] == 1 for g in self.groups)
        self.leads = np.zeros((len(self.tokens), len(self.groups)), bool)
        for g, (_, _, tokens, _) in enumerate(self.groups):
            self.leads[np.searchsorted(self.tokens, tokens), g] = True

    def find(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, size, window index) of every window that a block of documents contains."""
        n, found = len(words.start), []
        row_of = None
        for single, (at, h) in enumerate(_tokens(words, self.singles)):
            if not len(h):
                continue
            k = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
            hit = np.flatnonzero(self.tokens[k] == h)
            if not len(hit):
                continue
            row_of = words.row if row_of is None else row_of
            place_at, token = at[hit], k[hit]
            for g, (size, place, _, windows) in enumerate(self.groups):
                if (size == 1) != bool(single):
                    continue
                first = place_at[self.leads[token, g]] - place  # positional bound
                first = first[first >= 0]
                row = row_of[first]
                first = first[first + size <= words.bounds[row + 1]]  # length bound
                first = first[first + place < n]
                first = first[row_of[first] == row_of[np.minimum(first + place, n - 1)]]
                if len(first):
                    whole = gram_hash([words.hash[first + j] for j in range(size)])
                    w = np.minimum(np.searchsorted(windows, whole), len(windows) - 1)
                    ok = windows[w] == whole
                    found.append((first[ok], np.full(ok.sum(), size), np.searchsorted(self.window, whole[ok])))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def _hits(words, prefixes):
    """(row, word places inside a found window from 0, items) of each row with a hit."""
    first, size, window = prefixes.value.find(words)
    if not len(first):
        return
    cover = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)
    place = np.flatnonzero(np.cumsum(cover)[:-1])
    row, of = words.row[place], words.row[first]
    for r in np.unique(of):
        items = {i for w in np.unique(window[of == r]) for i in prefixes.value.items[w]}
        yield r, (place[row == r] - words.bounds[r]).astype(np.int32), sorted(items)


FOUND = "doc_id long, key binary, n_words long, hits array<int>, items array<string>"


def _mark(batches, prefixes):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            words = block.words(ALNUM, True)
            hits: list = [None] * block.rows
            items: list = [None] * block.rows
            for r, place, found in _hits(words, prefixes):
                hits[r], items[r] = place, found
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), batch.column("key").slice(block.first, block.rows),
                 pa.array(words.count), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "key", "n_words", "hits", "items"])


def benchmark_windows(bench: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """The distinct windows of all items, with the items that hold each."""
    rows = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast(TEXT).alias("text"))
    each = rows.where("item IS NOT NULL").mapInArrow(
        partial(_windows, width=width), "item string, window long, size int, pairs array<long>")
    return each.groupBy("window", "size").agg(F.collect_set("item").alias("items"), F.first("pairs").alias("pairs")) \
        .withColumn("block", F.xxhash64("window"))


def window_blocks(docs_text: DataFrame, bench: DataFrame, width: int, block_windows: int,
                  id_col: str, text_col: str):
    """Broadcasts of all windows in blocks of bounded size, prefixes ordered by rarity in ``docs_text``."""
    spark = bench.sparkSession
    windows = written(benchmark_windows(bench, width, id_col, text_col), "windows")
    n = windows.count()
    parts = -(-n // block_windows)
    for part in range(parts):
        rows = windows.where(F.pmod("block", F.lit(parts)) == part).orderBy("window", "size").collect()
        if not rows:
            continue
        known = np.unique(np.array([t for r in rows for t in r.pairs], np.int64).view(U))
        singles = any(r.size == 1 for r in rows)
        seen = docs_text.select("text").mapInArrow(
            partial(_count, known=known, singles=singles), "token long, n long") \
            .groupBy("token").agg(F.sum("n").alias("n")).collect()
        yield spark.sparkContext.broadcast(Prefixes(rows, {r.token: r.n for r in seen}))


def contamination(docs: DataFrame, bench: DataFrame, width: int = 10, block_windows: int = 1_000_000,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits and items of every row of ``docs``.

    Null texts have no words and no hits; items with a null id or without words have no windows. Repeated rows of
    ``docs`` are returned each; repeated items count once by their id. An empty benchmark hits nothing; an
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast(TEXT).alias("text"))
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    blocked = list(window_blocks(rows, bench, width, block_windows, item_col, item_text))
    if len(blocked) == 1:
        found = keyed.withColumn("key", F.lit(None).cast("binary")).mapInArrow(partial(_mark, prefixes=blocked[0]), FOUND)
    else:
        found = _merged(keyed, blocked)
    hits, items = F.coalesce("hits", F.array().cast("array<int>")), F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", F.size(hits).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size(hits) > 0).alias("contaminated"),
        hits.alias("hits"), items.alias("items"))


def _merged(keyed: DataFrame, blocked: list) -> DataFrame:
    """One row per document from one row per document and block; equal rows are counted and given back."""
    parts = [keyed.mapInArrow(partial(_mark, prefixes=b), FOUND) for b in blocked]
    if not parts:
        return keyed.mapInArrow(_words_only, FOUND)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    each = every.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), (F.count("*") / len(parts)).cast("int").alias("times"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return each.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", "key", "n_words", "hits", "items")


def _words_only(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            none = pa.nulls(block.rows)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), batch.column("key").slice(block.first, block.rows),
                 pa.array(block.words(ALNUM, True).count), none.cast(pa.list_(pa.int32())), none.cast(pa.list_(pa.string()))],
                names=["doc_id", "key", "n_words", "hits", "items"])


def _clean(batches, prefixes, text_col: str):
    """Batches without the rows whose text holds a window of this block."""
    for batch in batches:
        dirty = np.zeros(batch.num_rows, bool)
        for block in blocks(batch.column(text_col)):
            for r, _, _ in _hits(block.words(ALNUM, True), prefixes):
                dirty[block.first + r] = True
        yield batch.filter(pa.array(~dirty))


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = 10, block_windows: int = 1_000_000,
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    texts = docs.select(F.col(text_col).cast(TEXT).alias("text"))
    for prefixes in window_blocks(texts, bench, width, block_windows, "item_id", "text"):
        docs = docs.mapInArrow(partial(_clean, prefixes=prefixes, text_col=text_col), docs.schema)
    return docs

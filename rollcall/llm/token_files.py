"""Token ids as Parquet list columns: delta or dictionary encoded, in id order, with page indexes.

Texts are dealt by ranges of the document id and sorted, then encoded in place, so that only texts are
shuffled. Spark's Parquet writer gives version 2 pages (delta packing where no dictionary is kept),
row groups and pages of a given size, and page indexes. A reader can take the metadata columns without
the ids, and a range of documents without the rest.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rollcall.llm.token_counts import Pieces, encodings, halves
from rollcall.llm.vec import text_array
from rollcall.llm.work import id_text

FILE = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"
BREAK = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"\s\s|[^\S \n]")
TEXTS = 128


def split(text: str) -> list[str]:
    """A text cut where the pattern of byte-level pre-tokenizers always cuts.

    That is before a single blank and around a single line break between visible characters. All parts
    but the first follow a blank, which is left out, or start with their line break.
    """
    if ODD.search(text) or text[:1] == " " or text[-1:] == " ":
        return BREAK.split(text)
    return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=2)
def _known_ids(path: str) -> tuple[Pieces, Pieces]:
    """Ids as bytes of exact strings, and of parts that follow a blank; kept for all tasks of a worker."""
    exact = Pieces(lambda texts: [
        data[4 * a:4 * b] for ids, cut in encodings(path, texts) for data in (ids.tobytes(),)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())])

    def make(parts: list[str]) -> list[bytes]:
        cut = [halves(x) for x in parts]
        cut = [(w if w[:1] == "\n" else " " + w, m) for w, m in cut]
        ids = exact.of([[w for w, _ in cut], [m for _, m in cut]])
        return [ids[w] + ids[m] for w, m in cut]

    return exact, Pieces(make)


def _encode(batches, path: str, end_id: int):
    part, done = TaskContext.get().partitionId(), 0
    exact, rest = _known_ids(path)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = text_array(batch.column("text")).to_pylist()
        for at in range(0, len(texts), TEXTS):
            lists = [split(t) for t in texts[at:at + TEXTS]]
            heads = exact.of([x[:1] for x in lists])
            heads = [heads[x[0]] for x in lists]
            known = rest.of([x[1:] for x in lists])
            found = [b"".join((head, *map(known.__getitem__, x[1:]), end)) for head, x in zip(heads, lists)]
            n = np.array([len(x) // 4 for x in found], np.int64)
            bounds = np.concatenate([[0], np.cumsum(n)])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(lists)), pa.array([part] * len(lists), pa.int32()),
                 pa.array(done + bounds[:-1]), pa.array(n), ids],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"])
            done += int(bounds[-1])


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, encoding: str = "delta",
                 row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the ids of every text of ``docs``, each followed by ``end_id``, in ascending id order.

    Rows of equal id stand in the order of their texts; null ids come first. Null texts count as empty.
    """
    rows = id_text(docs, id_col, text_col)
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    sorted_rows.mapInArrow(partial(_encode, path=path, end_id=end_id), FILE).write \
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", row_group_bytes) \
        .option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", str(encoding == "dictionary").lower()) \
        .option("compression", "zstd").parquet(out)


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """The rows of written files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(FILE).parquet(out)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each written file
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select(
        "doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    for batch in batches:
        ids = batch.column("ids")
        bounds, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, and the CRC-32 of each document's ids as read."""
    return tokens.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")

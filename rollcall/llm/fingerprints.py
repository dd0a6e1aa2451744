"""Document fingerprints: MinHash signatures of word shingles, compared directly or joined by bands.

A shingle ends at every word: the word with up to four words before it, so that the first words of a text count too and a text of
any length has as many shingles as words. Words are runs without blanks, with A-Z in lower case. The signature keeps, for each
of 128 functions h(x) = a x + b modulo 2^64 (a odd, so that each is a permutation of all 64-bit values), the top 16 bits of the
least value over the text's shingles; the share of equal coordinates estimates the Jaccard similarity of the sets, with a
standard error below 0.045. A text without words has no shingles: its fingerprint is the empty string.

``edited_fingerprints`` needs each text's successor. Documents are dealt to ranges of ids, sorted there, and read as a
stream; only the first document of a range goes to the range before it as well, so whole texts are shuffled once.

``near_classes`` joins bands of signatures in Spark and decides links on full sets.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from rollcall.llm.components import components
from rollcall.llm.near_dedup import links, star_pairs
from rollcall.llm.vec import BLANK, U, blocks, gram_hash, mix, signed
from rollcall.llm.work import id_text, written

SHINGLE = 5
PERMUTATIONS = 128
BAND = 4  # coordinates
RANGES = 4  # ranges of ids for each shuffle partition
BLOCK = 1_000_000  # characters worked on at a time
FACTOR = mix(np.arange(PERMUTATIONS, dtype=U), 31) | U(1)
TERM = mix(np.arange(PERMUTATIONS, dtype=U), 32)


def shingles(words, size: int = SHINGLE) -> np.ndarray:
    """A hash for every word of a block: of the word and up to ``size`` - 1 words before it in its row."""
    h = words.hash
    place = np.arange(len(h)) - np.repeat(words.bounds[:-1], words.count)
    parts = []
    for back in range(size - 1, -1, -1):
        before = np.zeros(len(h), U)
        if back < len(h):
            before[back:] = h[:len(h) - back]
        parts.append(np.where(place >= back, before, U(0)))
    return gram_hash(parts)


def signatures(words, found: np.ndarray) -> np.ndarray:
    """(rows, permutations) of 16-bit minima; rows without words hold the largest value."""
    out = np.full((len(words.count), PERMUTATIONS), 0xFFFF, np.uint16)
    full = np.flatnonzero(words.count)
    if len(full):
        starts = words.bounds[full]
        with np.errstate(over="ignore"):
            for i in range(PERMUTATIONS):
                out[full, i] = np.minimum.reduceat(found * FACTOR[i] + TERM[i], starts) >> U(48)
    return out


def sign(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and word counts of texts."""
    signs, counts = [np.empty((0, PERMUTATIONS), np.uint16)], [np.empty(0, np.int64)]
    for block in blocks(pa.array(texts, pa.large_string())):
        words = block.words(BLANK, True)
        signs.append(signatures(words, shingles(words)))
        counts.append(words.count)
    return np.concatenate(signs), np.concatenate(counts)


def printed(signature: np.ndarray, counts: np.ndarray) -> list[str]:
    """Fingerprints as text; empty where there are no words."""
    return [base64.b64encode(s.astype("<u2").tobytes()).decode() if n else "" for s, n in zip(signature, counts)]


def likeness(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of equal coordinates; two empty fingerprints are alike, an empty and a filled one are not."""
    return np.where((n > 0) & (m > 0), (a == b).mean(axis=1), ((n == 0) & (m == 0)).astype(float))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(ids, texts) -> pa.RecordBatch:
    """Rows for all but the last text, each with its successor."""
    edited = []
    for text, after in zip(texts, texts[1:]):
        half = len(text) // 2
        edited.append(text[:len(text) - half] + after[:half])
    own, n = sign(texts)
    made, m = sign(edited)
    names = [f.split()[0] for f in OUT.split(", ")]
    columns = [ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(e.encode()).hexdigest() for e in edited],
               printed(own[:-1], n[:-1]), printed(made, m), likeness(own[:-1], n[:-1], made, m),
               likeness(own[:-1], n[:-1], own[1:], n[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], names=names)


def _edits(batches):
    """Compare each row of a sorted stream with the next one; a row that is only a copy of a later range's first ends a range."""
    ids: list = []
    texts: list[str] = []
    held = 0
    ended = False  # the last row held ends a range, and is no document of this one
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("copy").to_pylist())
        for doc_id, text, copy in rows:
            if ended and copy:
                continue  # another copy of the same document
            if ended:
                ids, texts, held, ended = [], [], 0, False
            ids.append(doc_id)
            texts.append(text)
            held += len(text)
            ended = copy
            if copy or held >= BLOCK:
                if len(ids) > 1:
                    yield _compared(ids, texts)
                ids, texts, held = ids[-1:], texts[-1:], len(text)


def _ranged(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` with the number ``range`` of about ``parts`` ranges of as many rows, in ascending order of (doc_id, h).

    An id that fills several ranges is cut by the hash of its texts.
    """
    rows = rows.withColumn("place", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    shares = [i / parts for i in range(1, parts)]
    cuts = rows.where("doc_id IS NOT NULL").approxQuantile("place", shares, 1 / (4 * parts)) if shares else []
    lows = sorted(set(cuts))
    if not lows:
        return rows.withColumn("range", F.lit(0))
    pieces = [0, *[cuts.count(b) if cuts.count(b) > 1 and abs(b) < 2 ** 53 else 0 for b in lows]]
    starts = [sum(pieces[:i]) + i for i in range(len(pieces))]
    bins = Bucketizer(splits=[float("-inf"), *lows, float("inf")], inputCol="place", outputCol="bin")
    known = bins.transform(rows).withColumn("bin", F.col("bin").cast("int") + 1)

    def of(values, kind):
        return F.element_at(F.array([F.lit(v).cast(kind) for v in values]), F.col("bin"))

    share = F.col("h") / F.lit(2.0 ** 64) + 0.5
    hot = (of(pieces, "int") > 0) & (F.col("place") == of([float("-inf"), *lows], "double"))
    piece = F.when(hot, F.least(F.floor(share * of(pieces, "int")), of(pieces, "int") - 1)).otherwise(of(pieces, "int"))
    return known.withColumn("range", (of(starts, "int") + piece).cast("int"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """One row for every document: its fingerprint, and those of its edited text and of the next document.

    The next document is the one of the next smaller id, after the smallest the first; rows of one id follow each other by a hash
    of their texts (equal rows in any order), rows without id come last. The edited text has its last floor(n / 2) of n code points
    replaced by the first as many (or all) of the next document's text. A null text is empty. Texts without words have the empty
    fingerprint; two of them are alike (1), one and a text with words are not (0). An empty table gives no rows; a single
    document is its own successor. Other columns are not read.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = _ranged(rows.withColumn("h", F.xxhash64("text")), parts or RANGES * n)
    firsts = ranged.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("first")).orderBy("range").collect()
    if not firsts:
        return spark.createDataFrame([], OUT)
    order = [r["range"] for r in firsts]  # one for each range, so bounded by their number; the lowest wants the first of all
    heads = spark.createDataFrame([(r["first"]["doc_id"], r["first"]["h"], order[(i + 1) % len(order)])
                                   for i, r in enumerate(firsts)],
                                  "head_id long, head_h long, above int")
    at = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    own = F.struct(F.col("range"), F.lit(False).alias("copy"))
    both = F.array(own, F.struct(F.col("above").alias("range"), F.lit(True).alias("copy")))
    dealt = ranged.join(F.broadcast(heads), at, "left").select(
        "doc_id", "text", "h", F.explode(F.when(F.col("above").isNotNull(), both).otherwise(F.array(own))).alias("to"))
    stream = dealt.select("doc_id", "text", "h", "to.range", "to.copy").repartition(n, "range").sortWithinPartitions(
        "range", "copy", F.col("doc_id").desc_nulls_last(), F.col("h").desc()).select("doc_id", "text", "copy")
    return stream.mapInArrow(_edits, OUT)


SIGNED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def _sets(block):
    """(words, distinct shingles of each row, sorted)."""
    words = block.words(BLANK, True)
    found = shingles(words)
    return words, found, [np.unique(found[lo:hi]) for lo, hi in zip(words.bounds, words.bounds[1:])]


def _banded(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            words, found, sets = _sets(block)
            rows = signatures(words, found).reshape(block.rows, -1, BAND).astype(U)
            keys = gram_hash([rows[:, :, j].reshape(-1) for j in range(BAND)]).reshape(block.rows, -1)
            keys = signed(mix(keys ^ mix(np.arange(keys.shape[1], dtype=U), 5)[None, :], 6))
            digest = np.array([[mix(s, i).sum(dtype=U) for s in sets] for i in (2, 3)], U)
            bands = [k if len(s) else None for k, s in zip(keys, sets)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(digest[0])),
                 pa.array(signed(digest[1])), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"])


def _elements(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            sets = [signed(s) for s in _sets(block)[2]]
            yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.rows), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["rep", "elements"])


def near_classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by a Jaccard similarity of ``percent`` or more.

    Texts with equal shingle sets count once. Signatures are cut into 32 bands of 4 coordinates; texts that share a band are
    compared on their full sets, so a pair at 0.8 is overlooked with a probability below 1e-7. Null and wordless
    texts are linked with nothing; rows without id have no component; rows of equal id are one node. An empty table gives no
    rows. Other columns are not read.
    """
    rows = id_text(docs, id_col, text_col)
    banded = written(rows.mapInArrow(_banded, SIGNED), "banded")
    filled = banded.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    first = filled.withColumnRenamed("doc_id", "rep").join(classes, ["d1", "d2", "n_shingles", "rep"], "left_semi")
    keys = first.select("rep", F.explode("bands").alias("band"))
    crowded = keys.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    buckets = written(keys.join(crowded.select("band"), "band").distinct(), "buckets")
    needed = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = written(rows.join(needed, "doc_id", "left_semi").mapInArrow(_elements, "rep long, elements array<long>").distinct(),
                   "sets").where("size(elements) > 0")
    joined = components(links(star_pairs(buckets), sets, percent))
    named = written(classes.join(joined.select(F.col("u").alias("rep"), "v"), "rep", "left").select(
        "d1", "d2", "n_shingles", F.coalesce("v", "rep").alias("component")), "named")
    out = banded.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))

"""Near-duplicate groups: Fast Similarity Sketching, banding, exact verification.

The sketch (Dahlgaard, Knudsen, Thorup 2017) has t coordinates. In round i < t each element of the set
falls into a bin chosen by a hash of the round; a bin keeps the smallest value of the first round
that reached it. In round t + j every element falls into bin j, so that all bins are full after 2t rounds
at most; sets of more than t ln t elements are mostly done after one. Equal coordinates occur with
the probability of the Jaccard similarity, as concentrated as with t independent hash functions.

Bands of ``rows`` coordinates propose candidates; a link is decided on full sets only. With 32 bands
of 4 a pair at 0.8 is missed with probability (1 - 0.8^4)^32 < 5e-8.

Copies count once: documents of equal sets form a class (128-bit digest), and only its smallest id goes on.

Pairs of a bucket are not expanded. Each bucket gets a pivot, a class that meets many others, and every class
of the bucket is compared with it on full sets. With D(i) the symmetric difference of class i and pivot, and
F(i) = den |D(i)| - num n(i) for a threshold num / den on the symmetric difference, classes i and j are linked if and
only if F(i) + F(j) <= 2 den |D(i) & D(j)|. So all links that need no common element of D join what the
class of smallest F joins: a star. Any other link has an end outside that star, which makes the common
part large, and a prefix filter on D (rarest elements first) finds it. Random edits of one text share few
elements, so this stays near linear where the members of a bucket are similar but not linked.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rollcall.llm.components import components
from rollcall.llm.vec import ALNUM, BLANK, U, blocks, gram_hash, mix, signed
from rollcall.llm.work import fresh, id_text, written

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def row_sets(words, shingle: int):
    """(row, elements): the distinct shingles of each row of a block, sorted."""
    at, grams = words.grams(shingle)
    lo = np.searchsorted(at, words.bounds)
    for r in range(len(words.count)):
        n = words.count[r]
        if n >= shingle:
            yield r, np.unique(grams[lo[r]:lo[r + 1]])
        elif n:
            h = words.hash[words.bounds[r]:words.bounds[r + 1]]
            yield r, gram_hash([h[i:i + 1] for i in range(n)])


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set; t is a power of two."""
    shift, size = U(64 - t.bit_length() + 1), np.array([len(s) for s in sets])
    out = np.full(len(sets) * t, EMPTY)
    live, full = np.arange(len(sets)), np.zeros(len(sets), int)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    for i in range(2 * t):
        h = mix(elements, 17 + i)
        bin_ = (h >> shift).astype(np.int64) if i < t else i - t
        key = owner * t + bin_
        free = out[key] == EMPTY
        np.minimum.at(out, key[free], h[free])
        full[live] = (out.reshape(-1, t)[live] != EMPTY).sum(1)
        live = live[full[live] < t]
        if not len(live):
            break
        keep = full[owner] < t
        elements, owner = elements[keep], owner[keep]
    return out.reshape(-1, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) of 64-bit keys."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = gram_hash([parts[:, :, j].reshape(-1) for j in range(rows)]).reshape(n, -1)
    return mix(key ^ mix(np.arange(t // rows, dtype=U), 5)[None, :], 6)


SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def _sketch(batches, shingle: int, t: int, rows: int, table):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            found = list(row_sets(block.words(table, True), shingle))
            n = np.zeros(block.rows, np.int64)
            digest = np.zeros((2, block.rows), U)
            bands: list = [None] * block.rows
            for r, s in found:
                n[r] = len(s)
                digest[0, r], digest[1, r] = mix(s, 2).sum(dtype=U), mix(s, 3).sum(dtype=U)
            if found:
                keys = signed(band_keys(sketches([s for _, s in found], t), rows))
                for (r, _), k in zip(found, keys):
                    bands[r] = k
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), pa.array(n), pa.array(signed(digest[0])),
                 pa.array(signed(digest[1])), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"])


def _sets(batches, shingle: int, table):
    for batch in batches:
        ids = batch.column("doc_id")
        for block in blocks(batch.column("text")):
            sets: list = [None] * block.rows
            for r, s in row_sets(block.words(table, True), shingle):
                sets[r] = signed(s)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, block.rows), pa.array(sets, pa.list_(pa.int64()))],
                names=["rep", "elements"])


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(c, i): each class with the pivot of each of its buckets, once. ``buckets`` has band and rep.

    A class scores the sizes of its buckets. A bucket's own leader is its best class; its pivot is the best leader
    that any of its classes has in any bucket, so that the buckets of one group agree on few pivots.
    """
    size = buckets.groupBy("band").agg(F.count("*").alias("m"))
    score = buckets.join(size, "band").groupBy("rep").agg(F.sum("m").alias("s"))
    named = buckets.join(score, "rep").select("band", "rep", F.struct("s", (-F.col("rep")).alias("minus")).alias("best"))
    leader = named.groupBy("band").agg(F.max("best").alias("lead"))
    first = named.join(leader, "band").groupBy("rep").agg(F.max("lead").alias("lead"))
    pivot = buckets.join(first, "rep").groupBy("band").agg(F.max("lead").alias("lead"))
    return buckets.join(pivot, "band").select((-F.col("lead.minus")).alias("c"), F.col("rep").alias("i")) \
        .where("c <> i").distinct()


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) pairs that join all linked classes among those that share a pivot; each is a link.

    ``pairs`` has (c, i), ``sets`` has (rep, elements).
    """
    num, den = 100 - percent, 100 + percent
    xs = sets.select(F.col("rep").alias("c"), F.col("elements").alias("xs"))
    ys = sets.select(F.col("rep").alias("i"), F.col("elements").alias("ys"))
    apart = F.concat(F.array_except("xs", "ys"), F.array_except("ys", "xs"))
    own = pairs.join(ys, "i").join(xs, "c").select(
        "c", "i", apart.alias("d"), F.xxhash64("c", "xs", "ys").alias("k"), F.size("ys").alias("n"),
        (den * F.size(apart) - num * F.size("ys")).cast("long").alias("f"), (-num * F.size("xs")).cast("long").alias("fc"))
    own = written(own, "apart")
    group = own.groupBy("c").agg(
        F.least(F.min(F.struct("f", "i")), F.min(F.struct(F.col("fc").alias("f"), F.col("c").alias("i")))).alias("m"),
        F.max("f").alias("most"), F.count("*").alias("members"))
    rows = own.join(group, "c").withColumn("fm", F.col("m.f"))
    star = rows.where("f + fm <= 0 AND i <> m.i").select(F.col("i").alias("u"), F.col("m.i").alias("v"))
    to_pivot = rows.where("fc + fm <= 0 AND c <> m.i").select(F.col("c").alias("u"), F.col("m.i").alias("v")).distinct()

    open_ = rows.where("members > 1 AND most + fm > 0 AND size(d) > 0") \
        .select("c", "i", "k", "n", "f", "fm", "d", F.size("d").alias("s"))
    each = open_.select("c", "i", "k", "n", "f", "fm", "s", F.explode("d").alias("e"))
    often = each.groupBy("c", "e").agg(F.count("*").alias("often")).where("often > 1")
    ranked = each.join(often, ["c", "e"], "left")  # elements of one class rank first and match nothing
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.coalesce("often", F.lit(1)), "e"))
    # a link to a class outside the star shares more than (f - fm) / (2 den) elements
    need = F.greatest(F.floor((F.col("f") - F.col("fm")) / (2 * den)) + 1, F.lit(1))
    prefix = ranked.withColumn("place", place).where(F.col("place") <= F.col("s") - need + 1).where("often IS NOT NULL") \
        .select("c", "e", F.col("i").alias("j"), F.col("k").alias("kj"), F.col("n").alias("nj"), F.col("f").alias("fj"),
                F.col("s").alias("sj"))
    probe = ranked.where("f + fm > 0 AND often IS NOT NULL").select("c", "e", "i", "k", "n", "f", "s", "fm")
    may = (f"i <> j AND f + fj <= {2 * den} * least(s, sj) AND 100 * least(n, nj) >= {percent} * greatest(n, nj) "
           "AND (fj + fm <= 0 OR k < kj)")
    near = probe.join(prefix, ["c", "e"]).where(may).select("k", "kj").distinct()
    left = own.select("k", F.col("i").alias("u"), F.col("f").alias("fu"), F.col("d").alias("du"))
    right = own.select(F.col("k").alias("kj"), F.col("i").alias("v"), F.col("f").alias("fv"), F.col("d").alias("dv"))
    checked = near.join(left, "k").join(right, "kj") \
        .where(F.col("fu") + F.col("fv") <= 2 * den * F.size(F.array_intersect("du", "dv"))).select("u", "v")
    return star.unionAll(to_pivot).unionAll(checked)


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, coordinates: int = 128,
                band_rows: int = 4, words: str = "blank", id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    A row's set holds its distinct lower-case (A-Z) word shingles, or its whole word sequence if it is shorter. A null or
    wordless text has an empty set and is linked with nothing. Rows of equal id are
    one node, linked where any of their sets is, and are all returned. A row with a null id is returned, unlinked, with component null
    and kept true. An empty table gives no rows. Other columns are not read.
    """
    table = BLANK if words == "blank" else ALNUM
    rows = id_text(docs, id_col, text_col)
    sketch = written(rows.mapInArrow(partial(_sketch, shingle=shingle, t=coordinates, rows=band_rows,
                                             table=table), SKETCH), "sketch")
    filled = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    first = filled.join(classes.select("rep", "d1", "d2"),
                        F.expr("doc_id = rep") & (filled.d1 == classes.d1) & (filled.d2 == classes.d2),
                        "left_semi")
    # a rep is written once per band; repeated rows of one id collapse here
    keys = first.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    crowded = keys.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    buckets = written(keys.join(crowded.select("band"), "band").distinct(), "buckets")

    needed = buckets.select("rep").distinct()
    # an id that stands on several texts stands for all its sets: each is compared
    sets = written(
        rows.join(needed.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
        .mapInArrow(partial(_sets, shingle=shingle, table=table), "rep long, elements array<long>")
        .where("elements IS NOT NULL").distinct(), "sets")

    joined = components(links(star_pairs(buckets), sets, percent))

    # written, so that the join below is of two plain shuffles, which can be split at a hot class
    named = classes.join(joined.select(F.col("u").alias("rep"), "v"), "rep", "left").select(
        "d1", "d2", F.col("n_shingles").alias("n"), F.coalesce("v", "rep").alias("component"))
    named = written(named, "named")
    out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(
        named, (sketch.d1 == named.d1) & (sketch.d2 == named.d2) & (sketch.n_shingles == named.n), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"),
                      F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept.

    Equal rows of one id and text stay once. Rows with a null id stay.
    """
    groups = near_groups(docs, id_col=id_col, text_col=text_col, **how)
    mark = fresh(docs, "kept_id")
    kept = groups.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(mark)).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    stays = named.join(kept, F.col(id_col).cast("long") == F.col(mark), "left_semi")
    return stays.dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))

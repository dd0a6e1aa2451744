"""SentencePiece segmentations sampled without replacement: Gumbel top-k by perturbed best-first search.

The lattice of a text has a node at every byte and an edge for every vocabulary piece that matches there; characters
without a piece fall back to byte pieces. Pieces are weighted by a Zipf law over their merge rank. No piece
joins two words, so the lattice falls into one small lattice per word; equal words of a block share
theirs. Backward sums make every edge a conditional probability.

A node of the search is a set of segmentations that share a prefix. Its perturbed value is the largest of the
Gumbel values of its members. The root's value is a Gumbel draw; drawing one segmentation edge by edge splits
the root into that segmentation, which inherits the value, and at each edge the set that leaves there, whose value is
a Gumbel draw truncated at the inherited one. The best open set is split next. So the segmentations come
in the order of their perturbed log probabilities, all distinct: a sample without replacement (Maddison et al.
2014; Kool et al. 2019). The value after the last one gives the inclusion scores. All draws are hashes
of the row's key, the byte position and the rank, so a repeated task draws the same.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.vec import POWERS, STEP, Block, U, blocks, hash_runs, mix
from rollcall.llm.work import id_text

BYTES = 250_000
LONG = 64  # bytes of a unit beyond which its sums are made place by place
FEW = 4  # units left in a draw that are walked one by one


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Vocabulary:
    """Pieces as hashes of their bytes (a blank for the word mark), with ids and log weights."""

    def __init__(self, path: str) -> None:
        model = processor(path)
        n = model.get_piece_size()
        texts, ids = [], []
        self.byte = np.zeros(256, np.int64)
        weight = np.zeros(n)
        for i in range(n):
            weight[i] = -np.log(min(-model.get_score(i), n) + 2)
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = i
                weight[i] = -np.log(n + 2)
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                texts.append(model.id_to_piece(i).replace("▁", " ").encode())
                ids.append(i)
        data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum([len(t) for t in texts])
        start = end - [len(t) for t in texts]
        h = hash_runs(data, start, end)
        order = np.argsort(h)
        self.hash, self.id, self.weight = h[order], np.array(ids)[order], weight
        self.longest = max(len(t) for t in texts)
        self.near = np.zeros(1 << 20, bool)  # high bits of the pieces' hashes
        self.near[(self.hash >> U(44)).astype(np.int64)] = True
        self.grows = np.zeros(1 << 20, bool)  # the same of all beginnings of longer pieces
        for n in range(1, self.longest):
            longer = start[end - start > n]
            self.grows[(hash_runs(data, longer, longer + n) >> U(44)).astype(np.int64)] = True

    def matches(self, data: np.ndarray, left: np.ndarray):
        """(starts, size, piece ids) of the pieces found in ``data``, size by size; ``left`` bytes remain of a unit."""
        up, _ = POWERS.get(self.longest + 1)
        start = np.flatnonzero((data & 0xC0) != 0x80)
        raw = np.zeros(len(start), U)
        for n in range(1, self.longest + 1):
            fits = left[start] >= n
            start = start[fits]
            if not len(start):
                return
            with np.errstate(over="ignore"):
                raw = raw[fits] + (data[start + (n - 1)].astype(U) + U(1)) * up[n - 1]
                h = mix(raw + U(n) * STEP)
            high = (h >> U(44)).astype(np.int64)
            some = np.flatnonzero(self.near[high])
            at = np.minimum(np.searchsorted(self.hash, h[some]), len(self.hash) - 1)
            hit = self.hash[at] == h[some]
            yield start[some[hit]], n, self.id[at[hit]]
            more = self.grows[high]
            start, raw = start[more], raw[more]


class Lattice:
    """Lattices of distinct units: edges by start place, long pieces first, with conditional probabilities."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> None:
        n, size = int(bounds[-1]), np.diff(bounds)
        self.ends = bounds[1:]
        left = np.repeat(bounds[1:], size) - np.arange(n)  # bytes up to the end of the unit
        found = list(vocabulary.matches(data, left))
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        char_end = np.zeros(n, np.int64)
        char_end[lead] = np.minimum(np.append(lead[1:], n), lead + left[lead])
        whole = np.zeros(n, bool)
        for start, length, _ in found:
            whole[start[char_end[start] == start + length]] = True
        # characters that no piece covers alone are spelled in bytes
        spelled = np.zeros(n + 1, np.int64)
        bare = lead[~whole[lead]]
        np.add.at(spelled, bare, 1)
        np.add.at(spelled, char_end[bare], -1)
        places = np.flatnonzero(np.cumsum(spelled)[:n] > 0)
        found.append((places, 1, vocabulary.byte[data[places]]))
        found.sort(key=lambda x: -x[1])

        count = np.zeros(n + 1, np.int64)
        for start, _, _ in found:
            count[start + 1] += 1
        first = np.cumsum(count)
        m = int(first[-1])
        begin, stop, piece = np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m, np.int64)
        free = first[:-1].copy()
        for start, length, ids in found:
            at = free[start]
            begin[at], stop[at], piece[at] = start, start + length, ids
            free[start] += 1

        weight, far = vocabulary.weight[piece], left[begin]
        done = stop == begin + far
        order = np.argsort(far.astype(np.uint16) if n == 0 or far.max() < 65536 else far, kind="stable")
        beta = np.zeros(n + 1)  # log weight of all ways from a place to the end of its unit
        beta[:n] = -np.inf
        near = int(np.searchsorted(far[order], LONG, "right"))
        for part in np.split(order[:near], np.flatnonzero(np.diff(far[order[:near]])) + 1):
            if not len(part):
                continue
            b = begin[part]
            value = weight[part] + np.where(done[part], 0.0, beta[stop[part]])
            new = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            top = np.maximum.reduceat(value, new)
            top[top == -np.inf] = 0.0
            times = np.diff(np.append(new, len(b)))
            with np.errstate(divide="ignore"):
                beta[b[new]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, times)), new))
        if near < m:
            _sums_of_long_units(begin, stop, weight, done, order[near:], beta)
        tail = np.where(done, 0.0, beta[stop])
        alive = (tail > -np.inf) & (beta[begin] > -np.inf)
        if not alive.all():
            begin, stop, piece, weight, tail = (x[alive] for x in (begin, stop, piece, weight, tail))
            first = np.searchsorted(begin, np.arange(n + 1))
        self.begin, self.stop, self.piece, self.first = begin, stop, piece, first
        self.log_p = np.minimum(weight + tail - beta[begin], 0.0)
        p = np.exp(self.log_p)
        total = np.zeros(len(p) + 1)
        np.cumsum(p, out=total[1:])
        self.upto = total[1:] - total[first[begin]]  # share of a place's edges up to this one
        choices = np.diff(first)
        self.upto[first[1:][choices > 0] - 1] = 2.0
        with np.errstate(divide="ignore"):
            self.rest = np.log(-np.expm1(np.minimum(self.log_p, -1e-15)))  # of leaving the path here
        self.rest[choices[begin] == 1] = -np.inf


class Lattices:
    """Lattices of the units met lately, in tables of bounded size that are emptied when they are full.

    Places and edges are numbered through: unit u covers the places start[u]:ends[u], place p has the edges
    first[p]:first[p + 1].
    """

    EDGES, PLACES = 2_500_000, 1_200_000
    KINDS = {"begin": np.int32, "stop": np.int32, "piece": np.int32, "log_p": np.float64, "upto": np.float32,
             "rest": np.float32}

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        for name, kind in self.KINDS.items():
            setattr(self, name, np.empty(self.EDGES, kind))
        self.first = np.zeros(self.PLACES + 1, np.int32)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[int, int] = {}
        self.start = self.ends = np.empty(0, np.int64)
        self.edges = self.places = 0

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unit numbers of data[starts:ends], which have tables afterwards."""
        h, where, which = np.unique(hash_runs(data, starts, ends), return_index=True, return_inverse=True)
        keys = h.tolist()
        new = np.array([i for i, key in enumerate(keys) if key not in self.known], np.int64)
        if self.places + int((ends - starts)[where[new]].sum()) > self.PLACES:
            self._empty()
            new = np.arange(len(keys))
        if len(new):
            size = (ends - starts)[where[new]]
            bounds = np.concatenate([[0], np.cumsum(size)])
            found = Lattice(data[np.repeat(starts[where[new]] - bounds[:-1], size) + np.arange(bounds[-1])], bounds, self.vocabulary)
            if self.edges + len(found.begin) > len(self.begin) and self.known:
                self._empty()
                return self.of(data, starts, ends)
            self._add(found, bounds)
            self.known.update(zip((keys[i] for i in new.tolist()), range(len(self.known), len(self.known) + len(new))))
        return np.array([self.known[key] for key in keys], np.int64)[which]

    def _add(self, found: Lattice, bounds: np.ndarray) -> None:
        n, m = int(bounds[-1]), len(found.begin)
        if self.edges + m > len(self.begin) or self.places + n > len(self.first) - 1:  # one block of many edges
            for name in self.KINDS:
                setattr(self, name, np.concatenate([getattr(self, name)[:self.edges], np.empty(m, self.KINDS[name])]))
            self.first = np.concatenate([self.first[:self.places + 1], np.zeros(n, np.int32)])
        span = slice(self.edges, self.edges + m)
        self.begin[span], self.stop[span] = found.begin + self.places, found.stop + self.places
        for name in ("piece", "log_p", "upto", "rest"):
            getattr(self, name)[span] = getattr(found, name)
        self.first[self.places:self.places + n + 1] = found.first + self.edges
        self.start = np.concatenate([self.start, bounds[:-1] + self.places])
        self.ends = np.concatenate([self.ends, bounds[1:] + self.places])
        self.edges, self.places = self.edges + m, self.places + n


def _sums_of_long_units(begin, stop, weight, done, order, beta: np.ndarray) -> None:
    """Fill ``beta`` at places far from the end of their unit, one place at a time: few units are that long."""
    known: dict[int, float] = {}
    values: list[float] = []
    at = -1
    rows = zip(begin[order].tolist(), stop[order].tolist(), weight[order].tolist(), done[order].tolist(),
               beta[stop[order]].tolist())

    def close() -> None:
        top = max(values)
        known[at] = top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else -math.inf

    for place, after, w, last, sum_after in rows:
        if place != at:
            if values:
                close()
            at, values = place, []
        values.append(w + (0.0 if last else known.get(after, sum_after)))
    if values:
        close()
    beta[np.fromiter(known, np.int64, len(known))] = np.fromiter(known.values(), float, len(known))


def uniform(key: np.ndarray, place: np.ndarray, salt: int) -> np.ndarray:
    """Draws in (0, 1) that depend on their arguments only."""
    with np.errstate(over="ignore"):
        h = mix(key ^ mix(place.astype(U), 40), 41 + salt)
    return ((h >> U(11)).astype(np.float64) + 0.5) / 2.0**53


def gumbel_below(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``loc``, truncated at ``bound``."""
    free = loc - np.log(-np.log(u))
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = np.minimum(free, bound), np.maximum(free, bound)
        # -log(exp(-free) + exp(-bound)), taken apart so that nothing overflows
        out = low - np.log1p(np.exp(-(high - low)))
    return np.where(np.isfinite(loc), out, -np.inf)


def units(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank before every non-empty row, row bounds, unit starts).

    A unit starts at each row and at each blank that follows anything but a blank.
    """
    size = np.diff(block.bounds)
    bounds = np.concatenate([[0], np.cumsum(size + (size > 0))])
    data = np.full(int(bounds[-1]), 32, np.uint8)
    row = np.repeat(np.arange(block.rows), size)
    data[np.arange(len(block.data)) + bounds[row] - block.bounds[row] + 1] = block.data
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
    starts[bounds[:-1][size > 0]] = True
    return data, bounds, np.flatnonzero(starts[:-1])


class Paths:
    """The segmentations of one rank: edges in row order, and the open set that leaves at each."""

    def __init__(self, row, place, edge, value, bounds) -> None:
        self.row, self.place, self.edge, self.value, self.bounds = row, place, edge, value, bounds


def _walk(lattice: Lattices, at: int, end: int, draws: np.ndarray) -> np.ndarray:
    """Edges of one draw over one unit from byte ``at`` on, given a draw for every byte."""
    first, u, out, begin = lattice.first[at:end + 1].tolist(), draws.tolist(), [], at
    low = first[0]
    upto, stop = lattice.upto[low:first[-1]].tolist(), lattice.stop[low:first[-1]].tolist()
    while at < end:
        e = first[at - begin] - low
        while u[at - begin] > upto[e]:
            e += 1
        out.append(e + low)
        at = stop[e]
    return np.array(out, np.int64)


def _draw(lattice: Lattices, unit, row, place, at, key, base, salt: int):
    """Edges of one draw from byte ``at`` of each unit to its end, sorted by row and place."""
    rows, places, edges = [], [], []
    while len(unit):
        if len(unit) <= FEW:
            for r, p, a, end in zip(row, place, at, lattice.ends[unit]):
                found = _walk(lattice, int(a), int(end), uniform(np.full(end - a, key[r]), np.arange(p, p + end - a) - base[r], salt))
                rows.append(np.full(len(found), r))
                places.append(p + lattice.begin[found] - a)
                edges.append(found)
            break
        u, e = uniform(key[row], place - base[row], salt), lattice.first[at]
        walk = np.flatnonzero(u > lattice.upto[e])
        while len(walk):
            e[walk] += 1
            walk = walk[u[walk] > lattice.upto[e[walk]]]
        rows.append(row)
        places.append(place)
        edges.append(e)
        size = lattice.stop[e] - at
        at, place = at + size, place + size
        more = at < lattice.ends[unit]
        unit, row, place, at = unit[more], row[more], place[more], at[more]
    rows, places, edges = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, places, edges))
    order = np.argsort(places, kind="stable")  # places grow from row to row
    return rows[order], places[order], edges[order]


def sample_block(block: Block, keys: np.ndarray, lattice: Lattices, k: int):
    """For each rank: (row bounds of the pieces, piece ids, log probability, value) and the next values.

    Rows with fewer than ``k`` segmentations have a value of -inf in the higher ranks. An empty text has one
    segmentation, the empty one.
    """
    data, bounds, starts = units(block)
    ends = np.append(starts[1:], len(data))
    which = lattice.of(data, starts, ends)
    unit_row = np.searchsorted(bounds, starts, "right") - 1
    n = block.rows
    paths: list[Paths] = []
    out = []
    root = -np.log(-np.log(uniform(keys, np.zeros(n, np.int64), 0)))

    def finish(row, place, edge, value, opened):
        """Add a rank: ``opened`` marks the edges where a new set leaves, below the rank's value."""
        b = np.searchsorted(row, np.arange(n + 1))
        lp = lattice.log_p[edge]
        total = np.zeros(len(lp) + 1)
        np.cumsum(lp, out=total[1:])
        before = total[:-1] - total[b[row]]
        loc = np.where(opened, before + lattice.rest[edge], -np.inf)
        u = uniform(keys[row], place - bounds[row], 1000 + len(paths))
        p = Paths(row, place, edge, gumbel_below(loc, value[row], u), b)
        paths.append(p)
        out.append((b, lattice.piece[edge], total[b[1:]] - total[b[:-1]], value))
        return before

    row, place, edge = _draw(lattice, which, unit_row, starts, lattice.start[which], keys, bounds, 1)
    finish(row, place, edge, root, np.ones(len(row), bool))
    left_out: dict[tuple[int, int], list[int]] = {}  # (row, place) -> edges already taken there, by branch prefix
    for rank in range(1, k + 1):
        best = np.full((len(paths), n), -np.inf)
        for j, p in enumerate(paths):
            full = np.flatnonzero(np.diff(p.bounds))
            if len(full):
                best[j, full] = np.maximum.reduceat(p.value, p.bounds[:-1][full])
        source, value = best.argmax(0), best.max(0)
        if rank == k:
            return out, value
        new_row, new_place, new_edge, new_open = [], [], [], []
        again_unit, again_row, again_place, again_at = [], [], [], []
        fix = []
        rows = np.flatnonzero(np.isfinite(value)).tolist()
        at_step = np.zeros(n, np.int64)
        at_place = np.zeros(n, np.int64)
        for r in rows:
            p = paths[source[r]]
            at_step[r] = p.bounds[r] + int(p.value[p.bounds[r]:p.bounds[r + 1]].argmax())
            at_place[r] = p.place[at_step[r]]
        inside = at_place - bounds[:-1]
        chosen, opening = uniform(keys, inside, 2000 + rank), uniform(keys, inside, 3000 + rank)
        here = np.searchsorted(starts, at_place, "right") - 1
        units_end = np.searchsorted(starts, bounds[1:], "left")
        for r in rows:
            p = paths[source[r]]
            lo, i = int(p.bounds[r]), int(at_step[r])
            state = int(lattice.begin[p.edge[i]])
            branch = (r, int(p.place[i]), p.edge[lo:i].tobytes())
            taken = left_out.setdefault(branch, [])
            taken.append(int(p.edge[i])) if int(p.edge[i]) not in taken else None
            open_edges = [e for e in range(lattice.first[state], lattice.first[state + 1]) if e not in taken]
            weights = np.exp(lattice.log_p[open_edges])
            e = open_edges[min(int(np.searchsorted(np.cumsum(weights) / weights.sum(), chosen[r])), len(open_edges) - 1)]
            p.value[i] = -np.inf
            new_row.append(np.full(i - lo + 1, r))
            new_place.append(p.place[lo:i + 1])
            new_edge.append(np.append(p.edge[lo:i], e))
            new_open.append(np.append(np.zeros(i - lo, bool), True))
            taken.append(e)
            rest = 1 - float(np.exp(lattice.log_p[taken]).sum())
            fix.append((r, i - lo, np.log(rest) if len(open_edges) > 1 and rest > 1e-15 else -np.inf))
            # the rest of this unit, then all later units of the row
            if lattice.stop[e] < lattice.ends[which[here[r]]]:
                again_unit.append([which[here[r]]])
                again_row.append([r])
                again_place.append([int(p.place[i] + lattice.stop[e] - state)])
                again_at.append([int(lattice.stop[e])])
            later = slice(here[r] + 1, units_end[r])
            again_unit.append(which[later])
            again_row.append(unit_row[later])
            again_place.append(starts[later])
            again_at.append(lattice.start[which[later]])
        join = lambda x, kind=np.int64: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        row2, place2, edge2 = _draw(lattice, join(again_unit), join(again_row), join(again_place), join(again_at),
                                    keys, bounds, 1 + rank)
        row, place, edge = (np.concatenate([join(a), b]) for a, b in ((new_row, row2), (new_place, place2), (new_edge, edge2)))
        opened = np.concatenate([join(new_open, bool), np.ones(len(row2), bool)])
        order = np.argsort(place, kind="stable")
        row, place, edge, opened = row[order], place[order], edge[order], opened[order]
        before = finish(row, place, edge, value, opened)
        p = paths[-1]
        if fix:  # at the branch all edges taken so far are left out
            of, step, rest = map(np.array, zip(*fix))
            at = p.bounds[of] + step
            p.value[at] = gumbel_below(before[at] + rest, value[of], opening[of])
    return out, value


SAMPLED = ("doc_id long, rank int, n_pieces long, log_prob double, inclusion double, ids array<int>")
DIGESTED = ("doc_id long, rank int, n_pieces long, log_prob double, inclusion double, ids_crc32 long, round_trip boolean")


def _schema(digest: bool, with_ids: bool) -> str:
    return (DIGESTED + ", ids array<int>" if with_ids else DIGESTED) if digest else SAMPLED


def _sample(batches, path: str, k: int, digest: bool, with_ids: bool):
    lattices, model = Lattices(Vocabulary(path)), processor(path)
    for batch in batches:
        ids = batch.column("doc_id")
        keys = mix(ids.fill_null(0).to_numpy().astype(np.int64).view(U), 50)
        for block in blocks(batch.column("text"), BYTES):
            ranks, after = sample_block(block, keys[block.first:block.last], lattices, k)
            for rank, (b, pieces, log_prob, value) in enumerate(ranks):
                row = np.flatnonzero(np.isfinite(value) if rank else np.ones(block.rows, bool))
                if rank:
                    row = row[np.diff(b)[row] > 0]
                pieces = pieces.astype(np.int32)
                with np.errstate(over="ignore", divide="ignore"):
                    inclusion = np.where(np.isfinite(after[row]), -np.expm1(-np.exp(np.minimum(log_prob[row] - after[row], 50))), 1.0)
                cells = [pieces[b[r]:b[r + 1]] for r in row]
                columns = [ids.slice(block.first, block.rows).take(pa.array(row)), pa.array(np.full(len(row), rank), pa.int32()),
                           pa.array(np.diff(b)[row], pa.int64()), pa.array(log_prob[row]), pa.array(inclusion)]
                if digest:
                    back = model.decode([c.tolist() for c in cells], num_threads=1)
                    same = [t.encode() == block.data[block.bounds[r]:block.bounds[r + 1]].tobytes() for t, r in zip(back, row)]
                    columns += [pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cells], pa.int64()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.array(cells, pa.list_(pa.int32())))
                names = [f.split()[0] for f in _schema(digest, with_ids).split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def sampled_segmentations(docs: DataFrame, path: str, k: int = 3, digest: bool = False, id_col: str = "doc_id",
                          text_col: str = "text", with_ids: bool | None = None) -> DataFrame:
    """Up to ``k`` distinct segmentations of every text, best perturbed value first.

    One row a segmentation: doc_id, rank from 0, n_pieces, log_prob (natural, within the lattice), inclusion (chance to be
    among the k given the last value; 1 where all are), and the ids; with ``digest`` their CRC-32 and whether the
    library decodes them to the same text, and the ids only if ``with_ids`` is set. Null texts count as empty: one row without pieces. A text with fewer
    segmentations has fewer rows. Rows of equal id and text draw the same; null ids draw as id 0 and
    stay null. An empty table gives no rows. Other columns are not read.
    """
    keep = not digest or bool(with_ids)
    return id_text(docs, id_col, text_col).mapInArrow(
        partial(_sample, path=path, k=k, digest=digest, with_ids=keep), _schema(digest, keep))


def _plain(batches, path: str):
    model = processor(path)
    for batch in batches:
        texts = batch.column("text").fill_null("").to_pylist()
        for at in range(0, len(texts), 256):
            found = model.encode(texts[at:at + 256], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(found)), pa.array(found, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the library's own ids of every text; a null text has none."""
    return id_text(docs, id_col, text_col).mapInArrow(partial(_plain, path=path), "doc_id long, ids array<int>")


def _text(batches, path: str):
    model = processor(path)
    for batch in batches:
        found = model.decode([x or [] for x in batch.column("ids").to_pylist()], num_threads=1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""
    return tokens.select("doc_id", "ids").mapInArrow(partial(_text, path=path), "doc_id long, text string")

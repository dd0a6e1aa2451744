"""Cheapest repair of conversations whose turns were damaged, as a shortest path over integers.

A conversation's rows, in order of their turns, must become a sequence of role initials ``(s?(ua)+)?``. Every row is kept,
given the role user or assistant, or deleted; empty turns may be inserted. The states of the pattern (start, after s, u, a)
after every row are the nodes of a DAG and the edits its edges. An edge's weight is one integer: the high digits carry the
cost, and the digit at the place of the edit's letter the letter (D, I, K, R as 1 to 4 in base 8), in a field of fixed width that
ends in zeros. So the least integer is the least cost with the audit least in ASCII order, and the usual DP over integers
decides everything; a shorter audit that another one continues costs less, so a prefix never has to wait for what follows.
More than one insertion in a gap is never cheapest: taking out u a or a u leaves the state as it was, and s u a costs more
than deleting s. Roles follow from the audit, since after the pattern's state only u or only a can be given.

Long conversations go through in windows of rows. After a row no state's best audit continues another's (both have as many
letters of rows, and end in one), so their order is all that later letters need: it is the first digit of the next window.

The rows' texts are not gathered. Only turn, digest and role initial of each go into one list per conversation, as long as the
audit that is asked for; the texts then stream past it in order, a batch at a time, into the digest of the repaired text.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

START, S, U, A = range(4)
NEXT = {START: {"s": S, "u": U}, S: {"u": U}, U: {"a": A}, A: {"u": U}}
GIVEN = {START: "u", S: "u", U: "a", A: "u"}  # the only role that can be given
DONE = (START, A)
ROLE = {"u": "user", "a": "assistant"}
LETTERS = " DIKR"
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
FINE, BLANK, CUT, COPY = range(4)
WINDOW = 64  # rows
LONG = 2 ** 63 - 1

WHITE = " \t\n\x0b\f\r"


def cheapest(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these role initials and faults."""
    rows = [*zip(initials, faults), (None, FINE)]  # after the last row only an insertion may follow
    best = {START: (0, 0, None)}  # state -> cost, rank of its audit so far, that audit as a chain of pieces
    for at in range(0, len(rows), WINDOW):
        part = rows[at:at + WINDOW]
        width = 2 * len(part) + 1  # a digit for the rank, then the letters of this window
        unit = 3 * width

        def edge(weight, length, letter, extra=0):
            return weight + ((COST[letter] + extra) << unit) + (LETTERS.index(letter) << (unit - 3 * (length + 1))), length + 1

        nodes = {state: ((cost << unit) + (rank << (unit - 3)), 1) for state, (cost, rank, _) in best.items()}
        for initial, fault in part:
            for state, node in list(nodes.items()):  # one insertion in the gap: after the nodes before it only
                to, new = NEXT[state][GIVEN[state]], edge(*node, "I")
                nodes[to] = min(nodes.get(to, new), new)
            if initial is None:
                break
            after = {}
            for state, node in nodes.items():
                moves = [(state, edge(*node, "D"))]
                if fault in (FINE, CUT):
                    extra = TRUNCATED if fault == CUT else 0
                    if initial in NEXT[state]:
                        moves.append((NEXT[state][initial], edge(*node, "K", extra)))
                    moves.append((NEXT[state][GIVEN[state]], edge(*node, "R", extra)))
                for to, new in moves:
                    after[to] = min(after.get(to, new), new)
            nodes = after
        past = {rank: chain for _, rank, chain in best.values()}
        fields = {state: format(weight & ((1 << unit) - 1), "o").zfill(width) for state, (weight, _) in nodes.items()}
        best = {}
        for rank, state in enumerate(sorted(nodes, key=fields.get)):
            digits = fields[state]
            letters = "".join(LETTERS[int(x)] for x in digits[1:]).rstrip()
            best[state] = (nodes[state][0] >> unit, rank, (letters, past[int(digits[0])]))
    cost, _, chain = min(best[state] for state in DONE if state in best)
    pieces = []
    while chain:
        pieces.append(chain[0])
        chain = chain[1]
    return cost, "".join(reversed(pieces))


def _crc_key() -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return F.concat(part("conv_id"), F.lit(":"), part("turn"))


def damaged(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """conv_id, turn, role and text with planted damage, chosen by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays with null text and role, so that its conversation is known), 1 empties the text, 2 removes its
    sentence ends, 3 repeats the row, 4 sets the role user. A null id, turn, role or text reads as one blank.
    """
    rows = table.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("kind", (F.crc32(_crc_key()) % 20).cast("int"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    gone = F.col("kind") == 0
    out = rows.select("conv_id", "turn", F.when(~gone, role).alias("role"), F.when(~gone, text).alias("text"), "kind")
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("kind", "again")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the digest that orders rows of one turn, and the faults that a row has by itself."""
    body = F.rtrim("text", F.lit(WHITE))
    end = F.right(body, F.lit(1))
    fault = F.when(body == "", BLANK).when(~end.isin(".", "!", "?"), CUT).otherwise(FINE)
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.select("conv_id", "turn", "role", "text", digest.alias("digest"),
                       F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plan(batches, names):
    """The counts and the audit of each conversation from its list of (turn, digest, initial, fault)."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            rows = batch.column("rows")[i].as_py()
            turns = {r["turn"] for r in rows} - {None}
            seen, faults = set(), []
            for r in rows:
                faults.append(BLANK if r["fault"] == BLANK else COPY if r["digest"] in seen else r["fault"])
                seen.add(r["digest"])
            initials = [r["initial"] for r in rows]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            gaps = min(max(turns) - min(turns) + 1 - len(turns), LONG) if turns else 0
            cost, audit = cheapest(initials, faults)
            out.append((gaps, faults.count(BLANK), faults.count(COPY), faults.count(CUT), illegal, cost, audit))
        columns = [pa.array(c, pa.int64() if n < 6 else pa.string()) for n, c in enumerate(zip(*out))] if out else []
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, counts, cost and audit of every conversation of ``damaged`` rows."""
    one = F.when(F.col("text").isNotNull(), F.struct("turn", "digest", "initial", "fault"))
    lists = _marked(rows).groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    kind = lists.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *[f.split()[0] for f in PLAN.split(", ")]]
    return lists.mapInArrow(partial(_plan, names=names), f"conv_id {kind}, {PLAN}")


class _Repair:
    """Follows an audit while the rows of its conversation go by; gives the lines of the repaired conversation."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _give(self, text: str) -> str:
        initial = GIVEN[self.state]
        self.state = NEXT[self.state][initial]
        return f"{ROLE[initial]}:{text}"

    def inserted(self):
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._give("")

    def row(self, role: str, text: str):
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = NEXT[self.state][role[0]]
            yield f"{role}:{text}"
        elif letter == "R":
            yield self._give(text)


def _stream(batches, keep):
    """For each conversation, whose plan stands before its rows: ``keep`` columns of the plan and the digest of the lines."""
    head, repair, total, first = None, None, None, True
    done: list[tuple] = []

    def add(lines):
        nonlocal first
        for line in lines:
            total.update((line if first else "\n" + line).encode())
            first = False

    def close():
        if head is not None:
            add(repair.inserted())
            done.append((*head, total.hexdigest()))

    def out():
        columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "repaired_sha256"])

    types = None
    for batch in batches:
        types = [batch.schema.field(c).type for c in keep] + [pa.string()]
        heads = batch.column("cost").is_valid().to_pylist()
        plan = [batch.column(c) for c in keep]
        roles, texts = batch.column("role"), batch.column("text")
        for i, is_head in enumerate(heads):
            if is_head:
                close()
                head = tuple(c[i].as_py() for c in plan)
                repair, total, first = _Repair(head[keep.index("audit")]), hashlib.sha256(), True
            else:
                add(repair.row(roles[i].as_py(), texts[i].as_py()))
        if len(done) >= 1000:
            yield out()
    close()
    if done:
        yield out()


def repaired(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the cheapest repair and the digest of the repaired text.

    ``rows`` is as ``damaged`` gives it: a row with null text only names its conversation. Conversations with a null id are one.
    Rows are taken by turn, nulls first; rows of one turn in the order of a digest of role and text, so that repeats of a row
    are neighbours. A conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table
    gives no rows.
    """
    found = plans(rows)
    keep = found.columns
    lines = _marked(rows).where("text IS NOT NULL")
    heads = found.select("*", *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("turn", "digest", "role", "text")])
    body = lines.select("conv_id", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in keep[1:]],
                        "turn", "digest", "role", "text")
    ordered = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("cost").isNull(), F.col("turn").asc_nulls_first(), "digest")
    kind = found.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(partial(_stream, keep=keep), f"conv_id {kind}, {PLAN}, repaired_sha256 string")

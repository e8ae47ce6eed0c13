"""Chat formatting by minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and assistant turns in alternation from a user turn
on. Dynamic programming over that automaton's states decides for each turn, at the least total cost, whether it keeps its
role, takes another (RELABEL), joins the turn before it (MERGE) or has an empty turn put before it (INSERT). Of plans of
equal cost the one stands whose last turn has the earlier state in STATES, then the turn before it, and so on back to the
first; between two states, keeping comes before merging and merging before inserting.

Conversations of up to SEGMENT turns are repaired whole. Longer ones are cut into segments of at most SEGMENT turns: a
stretch of turns is a matrix between states that holds, for each pair, the least cost and, for each state it ends in, how
its start states rank by the tie order. Such matrices chain exactly, so the states at the cuts are those of the plan over
the whole conversation, and each segment is then repaired by itself. The result is the same for any SEGMENT.

The result has one row per input turn; ``position`` numbers the turns of a conversation from 0, and its ``rendered``
pieces, concatenated by position, are the formatted conversation.

Defined cases: a null or unknown role may take any role for UNKNOWN; null text is empty; a null conv_id is a conversation
of its own; null turn numbers come first; rows that tie on a turn go by role class, then by a hash of role and text, then
by role and text, so tied turns may lie in several segments; repeated rows stay; a conversation of system turns only gets
an empty user turn at its end; an empty table gives an empty result. Markers inside texts are defused. Only conv_id, turn,
role and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.llm.common import materialise

STATES = ("start", "system", "user", "assistant")
#: States that may follow each state.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (2, 3)
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
NEVER = 1 << 40
SEGMENT = 4096
ALIASES = {"system": 1, "developer": 1, "user": 2, "human": 2, "assistant": 3, "gpt": 3, "bot": 3, "model": 3}
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def options(role: int, source: int, target: int) -> list[tuple[int, int, int]]:
    """(cost, rank, inserted state or 0) of a turn of class ``role`` between two states; rank 0 keeps a new turn, 1 merges, 2 inserts."""
    relabel = 0 if role == target else UNKNOWN if role == 0 else RELABEL
    found = []
    if target in NEXT[source]:
        found.append((relabel, 0, 0))
    if source == target:
        found.append((relabel + MERGE, 1, 0))
    found += [(relabel + INSERT, 2, k) for k in NEXT[source] if target in NEXT[k]]
    return found


def best_option(role: int, source: int, target: int) -> tuple[int, int, int]:
    return min(options(role, source, target), default=(NEVER, 3, 0))


#: By role class, source and target state.
BEST = [[[best_option(r, a, b) if b else (NEVER, 3, 0) for b in range(4)] for a in range(4)] for r in range(4)]
COST = [[[x[0] for x in row] for row in m] for m in BEST]


#: Of one turn: a path is its two states, so start states rank by number whatever it ends in.
RANK = [[0, 1, 2, 3]] * 4
Matrix = tuple[list[list[int]], list[list[int]]]


def chain(one: Matrix, two: Matrix) -> Matrix:
    """Both stretches after each other. Costs are by start and end state; ranks by end state, then start state."""
    (c1, r1), (c2, r2) = one, two
    cost, rank = [[NEVER] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)]
    for b in range(4):
        way = []
        for a in range(4):
            total, later, middle = min((c1[a][m] + c2[m][b], r2[b][m], m) for m in range(4))
            cost[a][b] = min(total, NEVER)
            way.append((later, r1[middle][a], a))
        for place, (_, _, a) in enumerate(sorted(way)):
            rank[b][a] = place
    return cost, rank


def matrix_of(roles: list[int]) -> Matrix:
    out: Matrix = (COST[roles[0]], RANK)
    for r in roles[1:]:
        out = chain(out, (COST[r], RANK))
    return out


def end_cost(state: int) -> tuple[int, int]:
    """(cost, state appended or 0) of ending in a state."""
    if state in ENDS:
        return 0, 0
    return min(((INSERT, k) for k in NEXT[state] if k in ENDS), default=(NEVER, 0))


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> tuple[list[tuple[int, int, int, int]], int]:
    """(state, cost, rank, inserted) of each turn, and the state appended at the end or 0. ``leave``: the last state, if
    it is fixed; else the conversation ends here."""
    cost, back = [NEVER] * 4, []
    cost[entry] = 0
    for r in roles:
        after, came = [NEVER] * 4, [0] * 4
        for b in (1, 2, 3):
            after[b], came[b] = min((cost[a] + BEST[r][a][b][0], a) for a in range(4))
        cost = after
        back.append(came)
    if leave is None:
        state = min((1, 2, 3), key=lambda b: (cost[b] + end_cost(b)[0], b))
        appended = end_cost(state)[1]
    else:
        state, appended = leave, 0
    out = []
    for r, came in zip(reversed(roles), reversed(back)):
        a = came[state]
        out.append((state, *BEST[r][a][state]))
        state = a
    return out[::-1], appended


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows that are equal in the first ``keys`` columns, over batch borders."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = list(zip(*[batch.column(k).to_pylist() for k in range(keys)]))
        start = 0
        for i, now in enumerate(ids):
            if key is not None and now != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield key, pa.Table.from_batches(held)
                held, start = [], i
            key = now
        held.append(batch.slice(start))
    if held:
        yield key, pa.Table.from_batches(held)


def role_class() -> Column:
    known = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    out = F.lit(0)
    for name, k in ALIASES.items():
        out = F.when(known == name, F.lit(k)).otherwise(out)
    return out.cast("int")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv, seg), rows in groups(batches, 2):
        cost, rank = matrix_of(rows.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], rows.schema.field(0).type), pa.array([seg], pa.int64()), pa.array([rows.num_rows], pa.int64()), pa.array([sum(cost + rank, [])], pa.list_(pa.int64()))], ["conv_id", "seg", "n", "matrix"]
        )


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First position, entry and exit state of each segment of a long conversation."""
    for (conv,), rows in groups(batches, 1):
        segs, sizes = rows.column(1).to_pylist(), rows.column(2).to_pylist()
        flat = [[m[k : k + 4] for k in range(0, 32, 4)] for m in rows.column(3).to_pylist()]
        before, vectors = [0, NEVER, NEVER, NEVER], []
        for m in flat:
            vectors.append(before)
            before = [min(before[a] + m[a][b] for a in range(4)) for b in range(4)]
        state = min((1, 2, 3), key=lambda b: (before[b] + end_cost(b)[0], b))
        entry, leave = [], []
        for m, vector in zip(reversed(flat), reversed(vectors)):
            leave.append(state)
            state = min(range(4), key=lambda a: (vector[a] + m[a][state], m[4 + state][a]))
            entry.append(state)
        firsts = [0, *itertools.accumulate(sizes[:-1])]
        last = [False] * (len(segs) - 1) + [True]
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv] * len(segs), rows.schema.field(0).type), pa.array(segs, pa.int64()), pa.array(firsts, pa.int64()), pa.array(entry[::-1], pa.int32()), pa.array(leave[::-1], pa.int32()), pa.array(last, pa.bool_())],
            ["conv_id", "seg", "first", "entry", "leave", "last"],
        )


ACTIONS = {(0, False): "keep", (0, True): "relabel", (1, False): "merge", (1, True): "relabel and merge", (2, False): "insert before", (2, True): "relabel and insert before"}


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows conv_id, seg, tag, turn, class, role, text, first, entry, leave, last; a segment's border row has tag 0."""
    for (conv, _), rows in groups(batches, 2):
        columns = [c.to_pylist() for c in rows.columns]
        first, entry, leave, last, skip = 0, 0, None, True, 0
        if columns[2][0] == 0:
            (first, entry, leave, last), skip = (columns[k][0] for k in (7, 8, 9, 10)), 1
        turns, classes, roles, texts = (columns[k][skip:] for k in (3, 4, 5, 6))
        plan, appended = repair(classes, entry, leave)
        if leave is not None and last:
            appended = end_cost(leave)[1]
        pieces, before = [], entry
        for (state, _, rank, inserted), text in zip(plan, texts):
            body = (text or "").replace("<|", "< |")
            if rank == 1:
                pieces.append(JOIN + body)
            else:
                empty = OPEN.format(STATES[inserted]) + CLOSE if inserted else ""
                pieces.append((CLOSE if before else "") + empty + OPEN.format(STATES[state]) + body)
            before = state
        if last:
            pieces[-1] += CLOSE + (OPEN.format(STATES[appended]) + CLOSE if appended else "")
        kind = rows.schema
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([conv] * len(plan), kind.field(0).type),
                pa.array(turns, kind.field(3).type),
                pa.array(range(first, first + len(plan)), pa.int64()),
                pa.array(roles, pa.string()),
                pa.array([STATES[p[0]] for p in plan], pa.string()),
                pa.array([ACTIONS[p[2], c != p[0]] for p, c in zip(plan, classes)], pa.string()),
                pa.array([STATES[p[3]] if p[3] else None for p in plan], pa.string()),
                pa.array([p[1] for p in plan], pa.int32()),
                pa.array(pieces, pa.string()),
            ],
            ["conv_id", "turn", "position", "role", "new_role", "action", "inserted", "cost", "rendered"],
        )


ROW = ("conv_id", "seg", "tag", "turn", "class", "role", "text", "first", "entry", "leave", "last")


def _cut(given: DataFrame, segment: int) -> DataFrame:
    """Long conversations with seg, a number that grows along each conversation and that at most ``segment`` of its turns
    share, and at, the place inside. Rows are sorted over ranges, and equal rows may be parted, so no turn number, tie or
    repeated row decides how much lies in one task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            yield batch.append_column("at", pa.array(range(n, n + batch.num_rows), pa.int64()))
            n += batch.num_rows

    order = ["conv_id", "turn", "class", "h", "role", "text"]
    spread = given.withColumn("h", F.xxhash64("role", "text")).withColumn("salt", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("conv_id", "turn", "class", "h", "salt").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    counted = materialise(ranged.mapInArrow(count, f"{kinds}, at long"), "turns")
    return counted.withColumn("seg", F.shiftleft("part", 40) + F.floor(F.col("at") / segment)).drop("part", "salt", "h")


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, turn, position, role, new_role, action, inserted, cost, rendered: one row per row of ``turns``."""
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    given = turns.select("conv_id", "turn", role_class().alias("class"), "role", "text")
    # Long conversations: fewer than rows / segment, few or none in most inputs.
    long = materialise(given.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > segment).select(F.col("conv_id").alias("_id")), "long")
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    nothing = {"first": F.lit(0).cast("long"), "entry": F.lit(0), "leave": F.lit(0), "last": F.lit(True)}

    def rows_of(df: DataFrame) -> DataFrame:
        return df.withColumns({"tag": F.lit(1), **nothing})

    short = rows_of(given.join(long, same, "left_anti").withColumn("seg", F.lit(0).cast("long")).withColumn("h", F.xxhash64("role", "text")))
    made = f"conv_id {conv}, turn {turn}, position long, role string, new_role string, action string, inserted string, cost int, rendered string"
    out = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "class", "h", "role", "text").select(*ROW).mapInArrow(_render, made)
    if long.isEmpty():
        return out
    pieces = _cut(given.join(long, same, "left_semi"), segment)
    keys = pieces.select("conv_id", "seg", "class", "at").repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "at")
    matrices = keys.select("conv_id", "seg", "class").mapInArrow(_matrices, f"conv_id {conv}, seg long, n long, matrix array<long>")
    borders = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_borders, f"conv_id {conv}, seg long, first long, entry int, leave int, last boolean")
    borders = materialise(borders, "borders").withColumns({"tag": F.lit(0), "turn": F.lit(None).cast(turn), "class": F.lit(0), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "at": F.lit(0).cast("long")})
    both = rows_of(pieces).unionByName(borders)
    dealt = both.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "tag", "at").select(*ROW)
    return out.unionByName(dealt.mapInArrow(_render, made))

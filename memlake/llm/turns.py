"""Repair of the turn structure of conversations: the cheapest edits after which user and assistant take turns.

The roles of a repaired conversation follow ``(s?(ua)+)?``. Edits are found by iterative-deepening A*: a depth-first
search that tries Delete, Insert, Keep and Rerole in this order below a cost bound that grows from round to round; the
first path that is accepted is the cheapest one and the first of its kind in ASCII order. A table remembers for every
state the largest budget that has failed there.

Blank and repeated rows can only go. They go as early as they can in the least order of edits, right behind the row
before them, so the search deals with the other rows alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.base import narrow, partitions
from memlake.operators.skew import broadcast_if_small, salted_join
from memlake.session import cut_lineage

#: Rows of a conversation that a task holds at once; a longer one is cut in pieces.
LONG = 10_000
PIECE = 500
SPACES = " \t\n\x0b\x0c\r"
#: What stands last in the rows so far: nothing, a system row, a user row, an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KINDS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The role that an inserted or changed row takes.
NEXT = (USER, USER, ASSISTANT, USER)
#: May a row of this kind (0: any other) follow?
FOLLOWS = [[False, True, True, False], [False, False, True, False], [False, False, False, True], [False, False, True, False]]
#: Cost of the inserts that end a conversation.
CLOSING = (0, 4, 2, 0)
INSERT, DELETE, REROLE = 2, 3, 2
_FAR = 1 << 60
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def cheapest(kinds: list[int], truncated: list[int], start: int = NONE, end: int | None = None) -> tuple[int, list[str]] | None:
    """Cost and edits, in order, that lead from ``start`` over all rows; None if there are none.

    Without ``end`` the rows after the edits are a whole conversation. With it they only end in that state, and
    nothing is inserted behind the last row.
    """
    n, closing = len(kinds), CLOSING
    if end is not None:
        reached = end == start or (n and end >= USER) or (end == SYSTEM and start == NONE and SYSTEM in kinds)
        if not reached:
            return None
        closing = [0 if s == end else _FAR for s in range(4)]
    # Least cost of the rows from i on: a truncated row costs 1, and so does a pair of neighbours that can't stay, since
    # an insert mends one pair for 2, a changed row two for 2, a deleted row two pairs and its own end for 3.
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            broken = kinds[i] == 0 or not FOLLOWS[kinds[i]][kinds[i + 1]]
        else:
            broken = kinds[i] != (ASSISTANT if end is None else end)
        rest[i] = rest[i + 1] + truncated[i] + broken

    def least(i: int, s: int) -> int:
        return closing[s] if i == n else rest[i] + (not FOLLOWS[s][kinds[i]])

    failed = [-1] * (4 * n + 4)
    bound = least(0, start)
    while bound < _FAR:
        beyond, nodes, tried, edits = _FAR, [(0, start, bound)], [0], []
        while nodes:
            i, s, budget = nodes[-1]
            turn = tried[-1]
            if turn == 0 and i == n and closing[s] == 0:
                return bound - budget, edits
            tried[-1] += 1
            if turn == 4:
                failed[4 * i + s] = max(failed[4 * i + s], budget)
                nodes.pop()
                tried.pop()
                if edits:
                    edits.pop()
                continue
            if turn == 1:
                if i == n and end is not None:
                    continue
                step = (i, NEXT[s], budget - INSERT)
            elif i == n:
                continue
            elif turn == 0:
                step = (i + 1, s, budget - DELETE)
            elif turn == 2:
                if not FOLLOWS[s][kinds[i]]:
                    continue
                step = (i + 1, kinds[i], budget - truncated[i])
            else:
                step = (i + 1, NEXT[s], budget - REROLE - truncated[i])
            needs = max(least(step[0], step[1]), failed[4 * step[0] + step[1]] + 1)
            if needs > step[2]:
                beyond = min(beyond, bound - step[2] + needs)
                continue
            nodes.append(step)
            tried.append(0)
            edits.append("DIKR"[turn])
        bound = beyond
    return None


@dataclass
class Rows:
    """Rows of a conversation or a piece of it. ``gone``: rows to delete before the first and after each other row."""

    kinds: list[int] = field(default_factory=list)
    truncated: list[int] = field(default_factory=list)
    shown: list[tuple[str, str]] = field(default_factory=list)
    gone: list[int] = field(default_factory=lambda: [0])

    def add(self, role: str, text: str, truncated: bool, gone: int) -> None:
        self.kinds.append(KINDS.get(role[:1], 0))
        self.truncated.append(int(truncated))
        self.shown.append((role, text))
        self.gone.append(gone)

    def edited(self, edits: Iterable[str], state: int = NONE) -> tuple[str, list[str], int]:
        """All edits, rows to delete among them, the repaired rows, and what stands last."""
        audit, lines, i = ["D" * self.gone[0]], [], 0
        for edit in edits:
            audit.append(edit)
            if edit == "I":
                state = NEXT[state]
                lines.append(ROLES[state] + ":")
                continue
            role, text = self.shown[i]
            if edit == "K":
                state = self.kinds[i]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                state = NEXT[state]
                lines.append(f"{ROLES[state]}:{text}")
            i += 1
            audit.append("D" * self.gone[i])
        return "".join(audit), lines, state


def unbroken(first: str, second: str) -> bool:
    return first[:1] + second[:1] in ("su", "ua", "au")


def ending(text: str) -> str:
    """The last character that is no white space, or nothing."""
    return text.rstrip(SPACES)[-1:]


def _summary(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The result of one conversation whose rows are all at hand."""
    kept, seen, counts = Rows(), set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in rows:
        last = ending(text)
        if not last or (role, text) in seen:
            counts["duplicate" if last else "blank"] += 1
            kept.gone[-1] += 1
        else:
            counts["truncated"] += last not in ".!?"
            kept.add(role, text, last not in ".!?", 0)
        seen.add((role, text))
    cost, edits = cheapest(kept.kinds, kept.truncated)
    audit, lines, _ = kept.edited(edits)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(not unbroken(a[0], b[0]) for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, *counts.values(), illegal, cost + DELETE * sum(kept.gone), audit, sha


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _whole(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows key, conv, turn, role, text, sorted; a null text tells of a dropped row."""
    out: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    open_key = conv = None
    turns, rows = [], []
    for key, id, turn, role, text in _records(batches):
        if key != open_key:
            if open_key is not None:
                out.append((conv, *_summary(turns, rows)))
                if len(out) >= 1000:
                    yield from flush()
                    out.clear()
            open_key, conv, turns, rows = key, id, [], []
        if text is not None:
            turns.append(turn)
            rows.append((role, text))
    if open_key is not None:
        out.append((conv, *_summary(turns, rows)))
        yield from flush()


_PIECE = (
    "key string, at long, costs array<long>, order array<int>, edits array<string>, kinds array<int>, "
    "shown array<struct<role:string,text:string>>, gone array<long>, first string, last string, broken long"
)


def _solved(key: str, at: int, rows: Rows, first: str, last: str, broken: int) -> tuple:
    """A piece with the cheapest edits from every state to every state; order: places of one start's edits."""
    costs, order, edits = [], [], []
    for start in range(4):
        ways = [cheapest(rows.kinds, rows.truncated, start, end) for end in range(4)]
        places = sorted((w[1], end) for end, w in enumerate(ways) if w)
        for end, way in enumerate(ways):
            costs.append(way[0] if way else None)
            order.append([e for _, e in places].index(end) if way else None)
            edits.append("".join(way[1]) if way else None)
    shown = [{"role": r, "text": t} for r, t in rows.shown]
    return key, at, costs, order, edits, rows.kinds, shown, rows.gone, first, last, broken


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows key, role, text, n, goes, truncated of long conversations in order, cut into pieces."""
    at = TaskContext.get().partitionId() << 40

    def batch(row: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    key, rows, first, last, broken, size = None, Rows(), "", "", 0, 0
    for its, role, text, n, goes, cut in _records(batches):
        if its != key or size == PIECE:
            if key is not None:
                yield batch(_solved(key, at, rows, first, last, broken))
                at += 1
            key, rows, first, last, broken, size = its, Rows(), role, "", -1, 0
        # Before the first row of a piece there is no pair; equal neighbours never fit.
        broken += (size == 0 or not unbroken(last, role)) + n - 1
        if goes:
            rows.gone[-1] += n
        else:
            rows.add(role, text, cut, n - 1)
        last, size = role, size + 1
    if key is not None:
        yield batch(_solved(key, at, rows, first, last, broken))


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every piece, last piece of a conversation first, the state to go to from each state."""
    open_key, ahead = None, CLOSING
    for batch in batches:
        out = []
        for key, at, costs, order in _records([batch]):
            if key != open_key:
                open_key, ahead = key, CLOSING
            picked, value = [], []
            for start in range(4):
                ways = [
                    (costs[4 * start + end] + ahead[end], order[4 * start + end], end)
                    for end in range(4) if costs[4 * start + end] is not None
                ]
                best = min(ways, default=(_FAR, 0, 0))
                value.append(best[0])
                picked.append(best[2])
            ahead = value
            out.append((key, at, picked))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int32())))] if out
            else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.list_(pa.int32()))], names=["key", "at", "to"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every long conversation from its pieces in order; texts pass by and are hashed."""
    open_key, state, cost, audit, sha, last, broken, empty = None, NONE, 0, [], hashlib.sha256(), None, 0, True

    def show(lines: list[str]) -> None:
        nonlocal empty
        for line in lines:
            sha.update(line.encode() if empty else b"\n" + line.encode())
            empty = False

    def result() -> pa.RecordBatch:
        ends = ["I"] * (CLOSING[state] // INSERT)
        rest, lines, _ = Rows().edited(ends, state)
        show(lines)
        row = (open_key, broken, cost + CLOSING[state], "".join(audit) + rest, sha.hexdigest())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(row, kinds)], names=["key", "illegal", "cost", "audit", "repaired_sha256"])

    for key, _, costs, edits, kinds, shown, gone, first, end, inside, to in _records(batches):
        if key != open_key:
            if open_key is not None:
                yield result()
            open_key, state, cost, audit, sha, last, broken, empty = key, NONE, 0, [], hashlib.sha256(), None, 0, True
        rows = Rows(kinds, [], [(r["role"], r["text"]) for r in shown], gone)
        way = 4 * state + to[state]
        cost += costs[way] + DELETE * sum(gone)
        letters, lines, state = rows.edited(edits[way], state)
        audit.append(letters)
        show(lines)
        broken += inside + (last is not None and not unbroken(last, first))
        last = end
    if open_key is not None:
        yield result()


def _long_results(rows: DataFrame) -> DataFrame:
    """Results of long conversations, of which no task holds more than a piece.

    Equal rows are counted, first mentions found by a minimum, and all rows put in order by ranges, so that neither a
    conversation nor a repeated row is one task's work. Only the pieces follow each other: their costs backwards, then
    their edits and texts forwards through the hash of the whole.
    """
    same = ["key", "turn", "role", "text"]
    counted = cut_lineage(rows.where("text IS NOT NULL").groupBy(*same).agg(F.count(F.lit(1)).alias("n")))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    said = counted.withColumn("place", place).withColumn("said", F.sha2("text", 256))
    first = said.groupBy("key", "role", "said").agg(F.min("place").alias("first"))
    known = salted_join(said, first, ["key", "role", "said"], spread=["turn", "said"])
    end = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    known = cut_lineage(
        known.withColumns({"again": F.col("first") < F.col("place"), "end": end})
        .withColumns({"blank": F.col("end") == "", "cut": ~F.col("end").isin(".", "!", "?")})
        .select(*same, "n", "again", "blank", (F.col("blank") | F.col("again")).alias("goes"), "cut")
    )
    order = ["key", F.asc_nulls_first("turn"), "role", "text"]
    ranged = known.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    schema = _arrow(_PIECE)
    pieces = cut_lineage(
        ranged.select("key", "role", "text", "n", "goes", "cut").mapInArrow(lambda b: _pieces(b, schema), _PIECE))
    costs = pieces.select("key", "at", "costs", "order").repartition("key").sortWithinPartitions("key", F.desc("at"))
    chosen = costs.mapInArrow(_choices, "key string, at long, to array<int>")
    ordered = pieces.drop("order").join(chosen, ["key", "at"]).repartition("key").sortWithinPartitions("key", "at")
    repaired = ordered.select(
        "key", "at", "costs", "edits", "kinds", "shown", "gone", "first", "last", "broken", "to"
    ).mapInArrow(_joined, "key string, illegal long, cost long, audit string, repaired_sha256 string")
    n = F.col("n")
    other = n - F.when(F.col("again"), 0).otherwise(1)
    counts = known.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), other).otherwise(0)).alias("duplicate"),
        F.sum((F.col("cut") & ~F.col("goes")).cast("long")).alias("truncated"),
    )
    return counts.join(repaired, "key")


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows``: conv_id, turn, role, text and ``present`` (false: a row that only names its conversation). The rows of a
    conversation are taken by turn, nulls first, ties by role and text. Null roles and texts count as one blank, null
    conv_ids are one conversation, a role without a first letter of s, u or a can't stay. A conversation without
    present rows has zeros, no edits and the hash of nothing; an empty table gives no rows.

    Conversations of up to ``LONG`` rows are each held by one task; longer ones are worked on in pieces.
    """
    # No id is the empty string.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = F.when(F.col("present"), F.coalesce("text", F.lit(" ")))
    rows = rows.select(key.alias("key"), "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"))
    long = cut_lineage(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.first("conv_id").alias("conv_id")).where(F.col("size") > LONG))
    some = bool(long.take(1))
    order = ["key", F.asc_nulls_first("turn"), "role", "text"]
    kind = rows.schema["conv_id"].dataType.simpleString()
    result = f"conv_id {kind}, {_RESULT}"
    short = rows.join(broadcast_if_small(long.select("key")), "key", "left_anti") if some else rows
    schema = _arrow(result)
    whole = (
        short.select("key", "conv_id", "turn", "role", "text").repartition("key").sortWithinPartitions(*order)
        .mapInArrow(lambda b: _whole(b, schema), result)
    )
    if not some:
        return whole
    nothing = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    nothing |= {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    mine = rows.join(broadcast_if_small(long.select("key")), "key", "left_semi").drop("conv_id")
    pieced = long.select("key", "conv_id").join(_long_results(mine), "key", "left").fillna(nothing)
    return whole.unionAll(pieced.select(whole.columns))


def damaged(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Rows with the faults that a hash of conversation and turn gives them, as input of ``repair``.

    Of 20 hash values 0 drops a row, 1 empties its text, 2 takes out sentence ends, 3 repeats it, 4 makes it a user's.
    """
    rows = narrow(df, conv_id=conv, turn=turn, role=role, text=text)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    name = F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn")))
    fault = F.crc32(name.cast("binary")) % 20
    said = blank(F.col("text"))
    changed = F.when(fault == 1, "").when(fault == 2, F.translate(said, ".!?", "")).otherwise(said)
    times: Column = F.when(fault == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(blank(F.col("role"))).alias("role"),
        changed.alias("text"), (fault != 0).alias("present"), F.explode(times).alias("copy"),
    ).drop("copy")

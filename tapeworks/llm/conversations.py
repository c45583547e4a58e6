"""Conversation structure repair by Hirschberg's divide and conquer (1975).

A conversation is repaired by edits of its rows until its roles' initials read ``(s?(ua)+)?``. What was written so far is in one of four states: nothing, a system row, a user
row, an assistant row. An item (a row, or a stretch of rows) is what it costs to get from each state to each other, and how the cheapest audits that leave one state compare.
Vectors of four costs run forward from the conversation's start and backward from its end and meet in the middle; the crossing state with the least sum is taken,
of several the one whose audit is ASCII-least, and both halves are solved in the same way. Two audits that lead to different states differ before either ends, so a forward vector needs
the order of its four audits only, never their letters; space is linear.

Rows are dealt out by range of conversation and place, so that a long conversation is several tasks'. A conversation that lies within one task, and has at most ``SEGMENT``
rows, is finished there. Others are cut into segments, each an item; their items meet in one task (a row for each segment), and then each segment is reconstructed on its own.

Defined results: rows of equal turn go by role, then by xxhash64 of the text; of equal rows the first counts and the others are duplicates. Null role and text are one space, a null
conv_id is a conversation of its own; a null turn goes first and counts for no gap. An empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.llm.common import cut, fresh_dir, join_hot
from tapeworks.llm.decontam import is_bounded
from tapeworks.shipping import ship

BLANK = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs: rerole, delete, insert, and a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States by what was written last: nothing, system, user, assistant; what is written next from each (an insertion's or a new role), and where that leads.
STATES = range(4)
NEXT = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
FAR = 1 << 40
#: What insertions at the end cost from each state.
CLOSE = (0, 2 * INSERT, INSERT, 0)
#: Rows and bytes of text after which a segment ends.
SEGMENT, SEGMENT_BYTES = 4096, 4 << 20
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FAULTS = ("blank", "duplicate", "truncated")

Item = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]
Vector = tuple[tuple[int, ...], tuple[int, ...]]


def fault_of(role: str, text: str, repeated: bool) -> str | None:
    words = text.strip(BLANK)
    if not words:
        return "blank"
    return "duplicate" if repeated else None if words[-1] in ENDS else "truncated"


@cache
def row_edits(initial: str, fault: str | None) -> tuple[tuple[tuple[int, str] | None, ...], ...]:
    """For each state before and after a row the cheapest edits, of equal ones the ASCII-least: cost, letters."""
    found: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    for before in STATES:
        at, letters, cost = before, "", 0
        for _ in range(3):
            ways = [("D", at, DELETE)]
            if fault not in ("blank", "duplicate"):
                late = CUT_OFF if fault == "truncated" else 0
                ways.append(("R", AFTER[at], REROLE + late))
                if initial == NEXT[at][0]:
                    ways.append(("K", AFTER[at], late))
                elif initial == "s" and at == 0:
                    ways.append(("K", 1, late))
            for letter, after, more in ways:
                way = (cost + more, letters + letter)
                if found[before][after] is None or way < found[before][after]:
                    found[before][after] = way
            at, letters, cost = AFTER[at], letters + "I", cost + INSERT
    return tuple(map(tuple, found))


@cache
def row_item(initial: str, fault: str | None) -> Item:
    edits = row_edits(initial, fault)
    costs = tuple(tuple(FAR if e is None else e[0] for e in line) for line in edits)
    order = [sorted(e[1] for e in line if e) for line in edits]
    return costs, tuple(tuple(order[s].index(e[1]) if e else 4 for e in edits[s]) for s in STATES)


def start(state: int) -> Vector:
    return tuple(0 if s == state else FAR for s in STATES), tuple(0 if s == state else 4 for s in STATES)


def forward(vector: Vector, item: Item) -> Vector:
    """The vector after an item: costs, and the order of the cheapest audits."""
    (costs, ranks), (steps, places) = vector, item
    best = [min((costs[s] + steps[s][t], ranks[s], places[s][t]) for s in STATES) for t in STATES]
    order = sorted({b[1:] for b in best if b[0] < FAR})
    return tuple(min(b[0], FAR) for b in best), tuple(order.index(b[1:]) if b[0] < FAR else 4 for b in best)


def backward(costs: Sequence[int], item: Item) -> tuple[int, ...]:
    """What is left to pay before an item, from what is left after it."""
    return tuple(min(FAR, min(item[0][s][t] + costs[t] for t in STATES)) for s in STATES)


def crossings(items: Sequence[Item], first: int, last: Sequence[int]) -> list[int]:
    """The states before, between and after the items on the cheapest way, of equal ones the audit-least: from state first, with ``last`` to pay after the end."""
    states = [first] + [-1] * len(items)

    def meet(low: int, high: int, after: Sequence[int]) -> None:
        middle = (low + high) // 2 if high - low > 1 else high
        vector = start(states[low])
        for item in items[low:middle]:
            vector = forward(vector, item)
        rest = tuple(after)
        for item in reversed(items[middle:high]):
            rest = backward(rest, item)
        states[middle] = min(STATES, key=lambda s: (vector[0][s] + rest[s], vector[1][s]))
        if middle < high:
            meet(low, middle, start(states[middle])[0])
            meet(middle, high, after)

    if items:
        meet(0, len(items), last)
    return states


def composed(items: Sequence[Item]) -> Item:
    """A stretch of items as one."""
    lines = []
    for state in STATES:
        vector = start(state)
        for item in items:
            vector = forward(vector, item)
        lines.append(vector)
    return tuple(costs for costs, _ in lines), tuple(ranks for _, ranks in lines)


def rebuilt(rows: Sequence[tuple[str, str, str | None]], states: Sequence[int], is_last: bool) -> tuple[int, str, list[str]]:
    """Cost, audit and the repaired ``role:text`` lines of rows (role, text, fault) whose states before, between and after are known."""
    cost, audit, lines = 0, [], []
    for (role, text, fault), before, after in zip(rows, states, states[1:]):
        more, letters = row_edits(role[:1], fault)[before][after]
        cost += more
        audit.append(letters)
        for letter in letters:
            if letter == "D":
                continue
            written = role if letter == "K" else NEXT[before]
            lines.append(f"{written}:" if letter == "I" else f"{written}:{text}")
            before = 1 if letter == "K" and written[:1] == "s" else AFTER[before]
    if is_last:
        at, left = states[-1], CLOSE[states[-1]]
        cost += left
        for _ in range(left // INSERT):
            audit.append("I")
            lines.append(f"{NEXT[at]}:")
            at = AFTER[at]
    return cost, "".join(audit), lines


def repair(rows: Sequence[tuple[str, str, str | None]]) -> tuple[int, str, list[str]]:
    """Cost, audit and repaired lines of a whole conversation (role, text, fault)."""
    items = [row_item(role[:1], fault) for role, _, fault in rows]
    return rebuilt(rows, crossings(items, 0, CLOSE), True)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, copy: the rows after damage by crc32(conv_id:turn) mod 20. Dropped rows stay with ``gone`` set, so that a conversation that loses
    all of them is still there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("way") == 0).alias("gone"), F.explode(copies).alias("copy"))


def _repeated(rows: DataFrame) -> DataFrame:
    """rows with ``again``: whether role and text were seen at an earlier turn. Counts are combined before the exchange, and only what several turns hold is joined back."""
    keyed = rows.withColumns({"h1": F.xxhash64("conv_id", "role", "text"), "h2": F.xxhash64(F.lit(1), "conv_id", "role", "text")})
    several = (
        keyed.where("not gone").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.count("turn").alias("n_turn"), F.min("turn").alias("low"), F.max("turn").alias("high"))
        .where("n > 1 AND n_turn > 0 AND (n_turn < n OR low < high)").select("h1", "h2", "n", F.when(F.col("n_turn") == F.col("n"), F.col("low")).alias("low"))
    )
    several = cut(several)
    met = keyed.join(F.broadcast(several), ["h1", "h2"], "left") if is_bounded(several) else join_hot(keyed, several, ["h1", "h2"], how="left")
    return met.withColumn("again", F.coalesce(F.col("n").isNotNull() & F.col("turn").isNotNull() & (F.col("low").isNull() | (F.col("turn") > F.col("low"))), F.lit(False))).drop("h1", "h2", "n", "low")


class _Tally:
    """Counts of a segment's rows, and what its neighbours need to know of its edges."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str | None]] = []
        self.size, self.turns, self.illegal, self.low, self.high = 0, 0, 0, None, None
        self.faults = dict.fromkeys(FAULTS, 0)

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        fault = fault_of(role, text, repeated)
        if fault:
            self.faults[fault] += 1
        if self.rows and (self.rows[-1][0][:1], role[:1]) not in LEGAL:
            self.illegal += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.rows.append((role, text, fault))
        self.size += len(role) + len(text)


_COUNTS = [*FAULTS, "illegal", "turns", "low", "high"]
_RESULT = ["gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]


def _finished(tallies: Sequence[dict], cost: int, audit: str, digest: str) -> list:
    """gaps, faults, illegal, cost, audit, hash of a conversation from its segments' counts, in order."""
    total = {c: sum(t[c] for t in tallies) for c in (*FAULTS, "illegal", "turns")}
    before = None
    for t in tallies:
        if before is not None and t["n"]:
            total["illegal"] += (before["last"], t["first"]) not in LEGAL
        before = t if t["n"] else before
    high = None
    for t in tallies:
        total["turns"] -= high is not None and t["low"] == high
        high = t["high"] if t["high"] is not None else high
    lows = [t["low"] for t in tallies if t["low"] is not None]
    gaps = high - lows[0] + 1 - total["turns"] if lows else 0
    return [gaps, *[total[c] for c in FAULTS], total["illegal"], cost, audit, digest]


def _edges(tally: _Tally) -> dict:
    rows = tally.rows
    return {**tally.faults, "illegal": tally.illegal, "turns": tally.turns, "low": tally.low, "high": tally.high, "n": len(rows), "first": rows[0][0][:1] if rows else None, "last": rows[-1][0][:1] if rows else None}


def _sha(lines: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, segment: int) -> Iterator[pa.RecordBatch]:
    """Streams rows in order; a row for each whole conversation, or for each segment of one that may go on in another task."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    held, name, began, number, n_closed = _Tally(), None, False, 0, 0
    is_first, before = True, None

    def close(is_open: bool) -> None:
        nonlocal number
        edges = _edges(held)
        row = {"conv_id": name, "part": part, "segment": number}
        if is_open:
            costs, ranks = composed([row_item(role[:1], fault) for role, _, fault in held.rows])
            row |= edges | {"is_open": True, "costs": sum(costs, ()), "ranks": sum(ranks, ()), "roles": [r[0] for r in held.rows], "texts": [r[1] for r in held.rows], "row_faults": [r[2] for r in held.rows]}
        else:
            cost, audit, lines = repair(held.rows)
            row |= {"is_open": False} | dict(zip(_RESULT, _finished([edges], cost, audit, _sha(lines))))
        out.append(row)
        number += 1

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(out, schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for conv, turn, role, text, gone, again in zip(*[batch.column(i).to_pylist() for i in range(6)]):
            if began and conv != name:
                close(is_first or n_closed > 0)
                held, is_first, before, began, n_closed = _Tally(), False, None, False, 0
            name, began = conv, True
            if gone:
                continue
            if len(held.rows) >= segment or held.size >= SEGMENT_BYTES:
                close(True)
                held, n_closed = _Tally(), n_closed + 1
            held.add(turn, role, text, again or before == (turn, role, text))
            before = (turn, role, text)
            if len(out) >= 512 or out and out[-1]["is_open"]:
                yield flush()
    if began:
        close(True)
    if out:
        yield flush()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one conversation."""
    run: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if run and row["conv_id"] != run[0]["conv_id"]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _square(flat: Sequence[int]) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(flat[4 * s : 4 * s + 4]) for s in STATES)


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation, after damage."""
    return repair_rows(damaged(conversations), segment)


def repair_rows(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The same for rows as they are: conv_id, turn, role, text (no nulls in these two), gone (rows that are there for their conv_id alone), copy."""
    spark = rows.sparkSession
    ship(spark)
    key = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    turn = rows.schema["turn"].dataType
    long, text = T.LongType(), T.StringType()
    result = [T.StructField("gaps", long), *[T.StructField(c, long) for c in FAULTS], T.StructField("illegal", long), T.StructField("cost", long), T.StructField("audit", text), T.StructField("repaired_sha256", text)]
    place = [key, T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("is_open", T.BooleanType())]
    edges = [T.StructField("turns", long), T.StructField("low", turn), T.StructField("high", turn), T.StructField("n", long), T.StructField("first", text), T.StructField("last", text)]
    wide = [T.StructField("costs", T.ArrayType(long)), T.StructField("ranks", T.ArrayType(long))]
    texts = [T.StructField(c, T.ArrayType(text)) for c in ("roles", "texts", "row_faults")]
    names = [f.name for f in result]
    segment_type = T.StructType([*place, *result, *edges, *wide, *texts])
    segment_schema = to_arrow_schema(segment_type)

    flagged = _repeated(rows).withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "h"]  # equal rows go to one task
    ordered = flagged.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "gone", "again")
    folder = fresh_dir(spark, "conversations")
    ordered.mapInArrow(lambda batches: _segments(batches, segment_schema, segment), segment_type).write.parquet(folder)
    stored = spark.read.parquet(folder)
    done = stored.where("not is_open").select("conv_id", *names)
    still = stored.where("is_open")

    plan_type = T.StructType([key, T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("is_last", T.BooleanType()), T.StructField("tally", T.StructType([f for f in result if f.name in FAULTS or f.name == "illegal"] + edges))])
    plan_schema = to_arrow_schema(plan_type)
    tally_names = [f.name for f in plan_type["tally"].dataType]

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _grouped(batches):
            states = crossings([(_square(r["costs"]), _square(r["ranks"])) for r in run], 0, CLOSE)
            rows = [{**{c: r[c] for c in ("conv_id", "part", "segment")}, "before": states[i], "after": states[i + 1], "is_last": i == len(run) - 1, "tally": {c: r[c] for c in tally_names}} for i, r in enumerate(run)]
            yield pa.RecordBatch.from_pylist(rows, schema=plan_schema)

    light = still.select("conv_id", "part", "segment", *tally_names, "costs", "ranks")
    plans = light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(planned, plan_type)

    piece_type = T.StructType([key, T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("tally", plan_type["tally"].dataType), T.StructField("cost", long), T.StructField("audit", text), T.StructField("lines", text)])
    piece_schema = to_arrow_schema(piece_type)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                inside = list(zip(r["roles"], r["texts"], r["row_faults"]))
                states = crossings([row_item(role[:1], fault) for role, _, fault in inside], r["before"], start(r["after"])[0])
                cost, audit, lines = rebuilt(inside, states, r["is_last"])
                row = {**{c: r[c] for c in ("conv_id", "part", "segment", "tally")}, "cost": cost, "audit": audit, "lines": "\n".join(lines) if lines else None}
                yield pa.RecordBatch.from_pylist([row], schema=piece_schema)

    whole = still.select("part", "segment", "roles", "texts", "row_faults").join(plans, ["part", "segment"])
    pieces = whole.select("conv_id", "part", "segment", "before", "after", "is_last", "tally", "roles", "texts", "row_faults").mapInArrow(rebuild, piece_type)

    last_type = T.StructType([key, *result])
    last_schema = to_arrow_schema(last_type)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over each conversation's pieces, in order: the hash takes them one by one."""
        name, tallies, cost, audit, digest, wrote = None, [], 0, [], hashlib.sha256(), False

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": name, **dict(zip(_RESULT, _finished(tallies, cost, "".join(audit), digest.hexdigest())))}], schema=last_schema)

        for batch in batches:
            for r in batch.to_pylist():
                if tallies and r["conv_id"] != name:
                    yield end()
                    tallies, cost, audit, digest, wrote = [], 0, [], hashlib.sha256(), False
                name = r["conv_id"]
                tallies.append(r["tally"])
                cost += r["cost"]
                audit.append(r["audit"])
                if r["lines"] is not None:
                    digest.update(("\n" * wrote + r["lines"]).encode("utf-8", "surrogatepass"))
                    wrote = True
        if tallies:
            yield end()

    rest = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment").mapInArrow(joined, last_type)
    return done.unionByName(rest.select("conv_id", *names))

"""Conversation structure repair by Hirschberg's divide and conquer over four states.

A repaired conversation is ``(system)? (user assistant)*`` with a system row only before a first user row. Rows are kept, given
another role, or deleted, and empty rows are inserted, at the least cost; of equal costs the edit list that is least in ASCII wins.

What stands before a row is one of four states: nothing, a system row, a user row, an assistant row. A run of rows maps costs
of the states before it to costs after it. To repair a run with a known state before it, forward cost vectors are taken over its first
half and backward ones over its second; the state where they meet at the least sum is the crossing, and both halves are
repaired alike. Only two vectors are held at a time, so space is one byte a row. Beside its cost every state carries the rank of its
edit list among the four. No such list is the beginning of another one (each ends with the same row's edit), so of
equally cheap crossings the one of least rank leads to the list that is least as a whole.

Faults are found in the JVM before; the edits of a conversation follow from its rows' codes, one byte each, and texts are only
streamed past them, never gathered. The rows of one conversation lie in one task in order, as its edits and its hash run from the
first row to the last: a very long conversation takes that task's time, but no memory beyond the codes.

Edge cases: a null conversation id is a conversation of its own. Nulls in the other columns count as one space, but a null turn comes
first and is no turn in ``gaps``. Rows of one turn are in the order of role and a hash of role and text; a repeat is a duplicate.
A role counts by its first character; an empty role has none. Conversations of which no row is left have an empty repair. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayframe.session import store

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next user or assistant row.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Costs of ending in a state: a system row needs a user and an assistant row after it, a user row an assistant row.
ENDING = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
FINE, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua"
#: Adjacent first letters of roles that are in order.
LEGAL = {(0, 1), (1, 2), (2, 1)}


# Faults, in the JVM


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage: ``conv_id, turn, role, text, copy, present``; dropped rows stay with ``present`` false."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("_role"), part("text").alias("_text"), chance.alias("_h"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("_role")).alias("role"),
        F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text")).alias("text"),
        F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("_h") != 0).alias("present"))


def named(rows: DataFrame) -> DataFrame:
    """Add ``name``, a 256-bit name of role and text."""
    return rows.withColumn("name", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("name"), F.col("copy")]


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, code`` in the order of the rows, all of a conversation in one partition: the role's first letter and the
    first fault in one byte, null for a row that is not there. Texts are left behind before the shuffle."""
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    light = named(rows).select(
        "conv_id", "turn", "role", "name", "copy", "present", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut")
    ).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "name").orderBy(*order())) > 1
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    initial = F.coalesce(*[F.when(F.col("role").startswith(x), i) for i, x in enumerate(INITIALS)], F.lit(len(INITIALS)))
    code = F.when(F.col("present"), 4 * initial + fault).cast("int").alias("code")
    return light.select("conv_id", "turn", "role", "name", "copy", code).sortWithinPartitions("conv_id", *order()).select("conv_id", "turn", "code")


# The cheapest edits of a run of codes


def _moves(code: int) -> list[tuple[int, int, int, str]]:
    """What may be done with a row: ``(state before, state after, cost, edits)``. Inserts stand right before a row that stays;
    before a deleted row they would only come earlier in the list than a D, which is less."""
    initial, fault = divmod(code, 4)
    out = [(s, s, DELETE, "D") for s in range(4)]
    if fault in (BLANK, DUPLICATE):
        return out
    more = TRUNCATED if fault == CUT else 0
    for before in range(4):
        for s, cost, edits in ((before, 0, ""), (NEXT[before], INSERT, "I")):
            keeps = s == NOTHING if initial == 0 else initial < 3 and ROLE_OF[NEXT[s]][0] == INITIALS[initial]
            if keeps:
                out.append((before, SYSTEM if initial == 0 else NEXT[s], cost + more, edits + "K"))
            out.append((before, NEXT[s], cost + more + REROLE, edits + "R"))
    return out


MOVES = [_moves(code) for code in range(16)]


@lru_cache(maxsize=1 << 16)
def _forward(code: int, costs: tuple, ranks: tuple) -> tuple[int, tuple, tuple]:
    """Costs and ranks after one more row; costs are relative to their least, which is given apart."""
    best = [(FAR, 9, "")] * 4
    for s, t, cost, edits in MOVES[code]:
        if costs[s] < FAR:
            best[t] = min(best[t], (costs[s] + cost, ranks[s], edits))
    least = min(b[0] for b in best)
    by_list = sorted(range(4), key=lambda t: best[t][1:])
    return least, tuple(b[0] - least if b[0] < FAR else FAR for b in best), tuple(by_list.index(t) for t in range(4))


@lru_cache(maxsize=1 << 16)
def _backward(code: int, costs: tuple) -> tuple:
    """Relative costs from before a row to the end."""
    out = [FAR] * 4
    for s, t, cost, _ in MOVES[code]:
        out[s] = min(out[s], cost + costs[t])
    least = min(out)
    return tuple(min(c - least, FAR) if c < FAR else FAR for c in out)


def _only(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def _crossing(front: tuple, ranks: tuple, back: tuple) -> int:
    return min((front[s] + back[s], ranks[s], s) for s in range(4))[2]


def _ahead(codes: bytes, start: int, stop: int, state: int) -> tuple[int, tuple, tuple]:
    total, costs, ranks = 0, _only(state), (0, 1, 2, 3)
    for i in range(start, stop):
        least, costs, ranks = _forward(codes[i], costs, ranks)
        total += least
    return total, costs, ranks


def _edits(codes: bytes, start: int, stop: int, state: int, end: int, out: list[str]) -> None:
    """Append the cheapest edits of rows ``start`` to ``stop`` that lead from one state to the other."""
    if stop - start == 1:
        out.append(min((cost, edits) for s, t, cost, edits in MOVES[codes[start]] if s == state and t == end)[1])
        return
    middle = (start + stop) // 2
    _, front, ranks = _ahead(codes, start, middle, state)
    back = _only(end)
    for i in range(stop - 1, middle - 1, -1):
        back = _backward(codes[i], back)
    crossing = _crossing(front, ranks, back)
    _edits(codes, start, middle, state, crossing, out)
    _edits(codes, middle, stop, crossing, end, out)


def repair(codes: bytes) -> tuple[int, str]:
    """The cost of the cheapest repair of a conversation, and its list of edits."""
    total, costs, ranks = _ahead(codes, 0, len(codes), NOTHING)
    end = _crossing(costs, ranks, ENDING)
    out: list[str] = []
    if codes:
        _edits(codes, 0, len(codes), NOTHING, end, out)
    return total + costs[end] + ENDING[end], "".join(out) + "I" * (ENDING[end] // INSERT)


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_NAMES = [x.split()[0] for x in PLAN.split(", ")]
#: Rows in a batch of results.
BATCH_ROWS = 4096


def _batches(rows: Iterator[tuple], schema: pa.Schema, texts: int | None = None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[texts]) if texts is not None else 0
        if len(held) >= BATCH_ROWS or size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


class _Run:
    """What is known of a conversation while its rows pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.last = None
        self.turns = self.illegal = 0
        self.faults = [0] * 4

    def add(self, turn, code: int) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.least, self.last = turn if self.least is None else self.least, turn
        if self.codes and (self.codes[-1] >> 2, code >> 2) not in LEGAL:
            self.illegal += 1
        self.faults[code & 3] += 1
        self.codes.append(code)

    def plan(self) -> tuple:
        cost, audit = repair(bytes(self.codes))
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit)


def _arrow(kind: pa.DataType, names: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", kind), *names.items()])


def plans(rows: DataFrame) -> DataFrame:
    """One row per conversation of :func:`damaged` rows: its faults, the cost of its repair and the edits."""
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def runs() -> Iterator[tuple]:
            nonlocal schema
            run = None
            for batch in batches:
                schema = schema or _arrow(batch.schema.field("conv_id").type, {n: pa.string() if n == "audit" else pa.int64() for n in _PLAN_NAMES})
                for conv_id, turn, code in zip(*[c.to_pylist() for c in batch.columns]):
                    if run is None or conv_id != run.conv_id:
                        if run is not None:
                            yield run.plan()
                        run = _Run(conv_id)
                    if code is not None:
                        run.add(turn, code)
            if run is not None:
                yield run.plan()

        made = runs()
        first = next(made, None)
        if first is not None:
            yield from _batches(_chained(first, made), schema)

    kind = dict(rows.dtypes)["conv_id"]
    return store(coded(rows).mapInArrow(solved, f"conv_id {kind}, {PLAN}"))


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


# Texts, streamed past the edits


class _Editor:
    """Plays the edits of a conversation over its rows."""

    def __init__(self, plan: tuple):
        self.plan, self.audit, self.at, self.state, self.place = plan, plan[-1], 0, NOTHING, 0

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.place += 1
        return self.plan[0], self.place, edit, role, text

    def inserts(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.state = self.at + 1, NEXT[self.state]
            yield self._put("I", ROLE_OF[self.state], "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if self.state == NOTHING and role[:1] == "s" else NEXT[self.state]
            yield self._put(edit, role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            yield self._put(edit, ROLE_OF[self.state], text)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Editor, tuple | None]]:
    """Each repaired row with its conversation's editor; a conversation starts with a row of none."""
    editor = None
    for batch in batches:
        names = batch.schema.names
        columns = {n: batch.column(n).to_pylist() for n in ("conv_id", "kind", "role", "text", *_PLAN_NAMES)} if names else {}
        for i, kind in enumerate(columns.get("kind", ())):
            if kind == 0:
                if editor is not None:
                    yield from ((editor, x) for x in editor.inserts())
                editor = _Editor((columns["conv_id"][i], *[columns[n][i] for n in _PLAN_NAMES]))
                yield editor, None
            else:
                yield from ((editor, x) for x in editor.row(columns["role"][i], columns["text"][i]))
    if editor is not None:
        yield from ((editor, x) for x in editor.inserts())


def _together(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Plans and rows in one stream: a conversation's plan, then its rows in order."""
    there = named(rows.where("present")).withColumn("kind", F.lit(1))
    both = planned.withColumn("kind", F.lit(0)).unionByName(there, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order()).select("conv_id", "kind", "role", "text", *_PLAN_NAMES)


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, place`` (from 1), ``edit`` (K, R or I), ``role, text``."""
    kind = dict(rows.dtypes)["conv_id"]

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = _arrow(first.schema.field("conv_id").type, {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()})
            yield from _batches((row for _, row in _edited(_chained(first, batches)) if row is not None), schema, texts=4)

    return _together(rows, planned).mapInArrow(edited, f"conv_id {kind}, place long, edit string, role string, text string")


def digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The plans with ``repaired_sha256``, over the repaired rows as ``role:text`` joined by newlines."""
    kind = dict(rows.dtypes)["conv_id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            now = digest = None
            for editor, row in _edited(_chained(first, batches)):
                if row is None:
                    if now is not None:
                        yield (*now.plan, digest.hexdigest())
                    now, digest = editor, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if row[1] > 1 else ''}{row[3]}:{row[4]}".encode())
            if now is not None:
                yield (*now.plan, digest.hexdigest())

        first = next(batches, None)
        if first is not None:
            yield from _batches(lines(), _arrow(first.schema.field("conv_id").type, {
                **{n: pa.string() if n == "audit" else pa.int64() for n in _PLAN_NAMES}, "repaired_sha256": pa.string()}))

    return _together(rows, planned).mapInArrow(hashed, f"conv_id {kind}, {PLAN}, repaired_sha256 string")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Damage, judge and repair all conversations: one row per original ``conv_id``."""
    rows = damaged(conversations)
    return digests(rows, plans(rows))

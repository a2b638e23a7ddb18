"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
by turns, ending with an assistant's.  Each input turn is kept, merged into the
turn before it of the same role, or relabelled, and empty turns are inserted
where the automaton needs them; the cheapest choice over the whole
conversation is found by dynamic programming over the automaton's four states.

One turn is a 4 x 4 matrix of costs that depends on its role alone, and
matrices combine by (min, +), so a conversation is cut into blocks of turn
numbers: blocks are reduced on their own, a pass over each conversation's
blocks fixes the state at every border, and blocks are then repaired and
rendered on their own.  No task holds more than a block of a conversation.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import prepare, staged

ROLES = ("system", "user", "assistant")
#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Costs; an unknown role must be relabelled.
MERGE, RELABEL, INSERT, UNKNOWN = 1, 3, 2, 1
#: Turn numbers of a block.
BLOCK = 4096
FAR = 1 << 40

# The rendered form of a turn.
OPEN, CLOSE, JOIN = "<|{role}|>\n", "<|end|>\n", "\n"


def _next_roles(state: int) -> list[int]:
    """Roles that may follow; a state other than START is the role of the last turn."""
    return {START: [SYSTEM, USER], SYSTEM: [USER], USER: [ASSISTANT], ASSISTANT: [USER]}[state]


def _insertions(state: int, target: int) -> list[int] | None:
    """Fewest empty turns after which a turn of the target role is legal."""
    paths = [(state, [])]
    for s, path in paths:
        if target in _next_roles(s):
            return path
        if len(path) < 3:
            paths += [(r, [*path, r]) for r in _next_roles(s) if r != SYSTEM]
    return None


def _turn_choices() -> dict[int, dict[tuple[int, int], tuple[int, str, list[int], int]]]:
    """By input role (0: unknown) and states before and after: (cost, action, roles inserted before, turns begun)."""
    out: dict = {}
    for role in range(STATES):
        best: dict = {}
        for target in (SYSTEM, USER, ASSISTANT):
            change = 0 if target == role else UNKNOWN if role == 0 else RELABEL
            name = "" if target == role else "relabel"
            for state in range(STATES):
                options = []
                if state == target:
                    options.append((change + MERGE, f"{name}+merge".strip("+"), [], 0))
                inserted = _insertions(state, target)
                if inserted is not None:
                    options.append((change + INSERT * len(inserted), name or "keep", inserted, 1 + len(inserted)))
                for option in options:
                    if option[0] < best.get((state, target), (FAR,))[0]:
                        best[state, target] = option
        out[role] = best
    return out


CHOICES = _turn_choices()


def _matrices() -> np.ndarray:
    """[role, before, after] -> cost."""
    out = np.full((STATES, STATES, STATES), FAR, dtype=np.int64)
    for role, choices in CHOICES.items():
        for (before, after), option in choices.items():
            out[role, before, after] = option[0]
    return out


COSTS = _matrices()


def _ending(state: int) -> list[int]:
    """Empty turns that end a conversation legally."""
    return {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]


def _steps(roles: list[int], entry: np.ndarray):
    """Cost of each state after the turns, from the entry costs, and each turn's cheapest states before."""
    cost, back = entry, []
    for role in roles:
        through = cost[:, None] + COSTS[role]
        back.append(through.argmin(axis=0))
        cost = np.minimum(through.min(axis=0), FAR)
    return cost, back


def _path(roles: list[int], entry: int, leave: int) -> list[tuple[int, int]]:
    """States before and after each turn of the cheapest way from entry to leave."""
    start = np.full(STATES, FAR, dtype=np.int64)
    start[entry] = 0
    _, back = _steps(roles, start)
    path, state = [], leave
    for before in reversed(back):
        path.append((int(before[state]), state))
        state = int(before[state])
    return path[::-1]


def _groups(batches, columns: int):
    """Rows of a sorted stream by equal values in the first columns; a group may span batches."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))
    return groupby(rows(), key=lambda r: r[:columns])


def _flush(out: list[list], schema: pa.Schema, least: int):
    if len(out[0]) > least:
        batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
        for v in out:
            v.clear()
        yield batch


_REDUCED = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())), ("begun", pa.list_(pa.int64())), ("rows", pa.int64())])
_BORDERS = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()),
                      ("position", pa.int64()), ("seq", pa.int64()), ("last", pa.bool_()), ("cost", pa.int64())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()),
                    ("role_before", pa.string()), ("role", pa.string()), ("action", pa.string()), ("rendered", pa.string())])


def _reduce(batches):
    """(conv_id, block, role) sorted -> each block's cost and number of turns begun by states before and after."""
    out: list[list] = [[] for _ in _REDUCED]
    for (conv, block), rows in _groups(batches, 2):
        roles = [r[2] for r in rows]
        costs, begun = [], []
        for entry in range(STATES):
            start = np.full(STATES, FAR, dtype=np.int64)
            start[entry] = 0
            cost, back = _steps(roles, start)
            costs += cost.tolist()
            counts = np.zeros(STATES, dtype=np.int64)
            for role, before in zip(roles, back):
                new = np.array([CHOICES[role].get((int(before[s]), s), (0, "", [], 0))[3] for s in range(STATES)])
                counts = counts[before] + new
            begun += counts.tolist()
        for values, v in zip(out, (conv, block, costs, begun, len(roles))):
            values.append(v)
        yield from _flush(out, _REDUCED, 4096)
    yield from _flush(out, _REDUCED, 0)


def _fix_borders(batches):
    """Blocks of a conversation in order -> the states at their borders on the cheapest way."""
    out: list[list] = [[] for _ in _BORDERS]
    for (conv,), rows in _groups(batches, 1):
        found = [(r[1], np.array(r[2]).reshape(STATES, STATES), np.array(r[3]).reshape(STATES, STATES), r[4]) for r in rows]
        cost = np.full(STATES, FAR, dtype=np.int64)
        cost[START] = 0
        back = []
        for _, costs, _, _ in found:
            through = cost[:, None] + costs
            back.append(through.argmin(axis=0))
            cost = np.minimum(through.min(axis=0), FAR)
        total = cost + [INSERT * len(_ending(s)) for s in range(STATES)]
        state = int(total.argmin())
        states = [state]
        for before in reversed(back):
            state = int(before[state])
            states.append(state)
        states.reverse()
        position = seq = 0
        for k, (block, _, begun, n) in enumerate(found):
            entry, leave = states[k], states[k + 1]
            for values, v in zip(out, (conv, block, entry, leave, position, seq, k == len(found) - 1, int(total.min()))):
                values.append(v)
            position += int(begun[entry, leave])
            seq += n
        yield from _flush(out, _BORDERS, 4096)
    yield from _flush(out, _BORDERS, 0)


def _render(batches):
    """(conv_id, block, entry, leave, position, seq, last, turn, role, role as given, text) sorted -> repaired turns."""
    out: list[list] = [[] for _ in _TURNS]

    def emit(conv, position, seq, turn, given, role, action, rendered):
        for values, v in zip(out, (conv, position, seq, turn, given, ROLES[role - 1], action, rendered)):
            values.append(v)

    for (conv, _, entry, leave, position, seq, last), rows in _groups(batches, 7):
        rows = [r[7:] for r in rows]  # one block
        place = position - 1
        path = _path([role for _, role, _, _ in rows], entry, leave)
        for k, ((before, after), (turn, role, given, text)) in enumerate(zip(path, rows), start=seq):
            _, action, inserted, _ = CHOICES[role][before, after]
            for extra in inserted:
                place += 1
                emit(conv, place, k, None, None, extra, "insert", _opened(extra, place))
            body = (text or "").replace("<|", "< |")
            if action.endswith("merge"):
                rendered = JOIN + body
            else:
                place += 1
                rendered = _opened(after, place) + body
            emit(conv, place, k, turn, given, after, action, rendered)
        if last:
            for extra in _ending(leave):
                place += 1
                emit(conv, place, seq + len(rows), None, None, extra, "insert", _opened(extra, place))
            out[-1][-1] += CLOSE
        yield from _flush(out, _TURNS, 4096)
    yield from _flush(out, _TURNS, 0)


def _opened(role: int, place: int) -> str:
    return (CLOSE if place else "") + OPEN.format(role=ROLES[role - 1])


def repair_roles(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every conversation repaired at least cost, one row for each input turn and each inserted empty turn.

    Returns conv_id, position (of the repaired turn, from 0), seq (number of
    the input turn, or of the one behind an inserted turn), turn (as given;
    null when inserted), role_before, role, action, rendered, and cost (of the
    whole conversation).  The rendered texts by position and seq, joined, are
    the conversation.  Roles are compared in lower case without white space around
    them; null or other roles are unknown.  Null texts are empty.  Turns are
    ordered by number, null last; equal numbers by role and text; repeated
    rows are repeated turns.  Rows without a conversation id are one
    conversation with a null id.  "<|" in a text becomes "< |".  An empty
    table gives no rows; other columns are ignored.
    """
    prepare(conversations.sparkSession)
    c = conversations
    given = c[role_col].cast("string")
    clean = F.lower(F.trim(given))
    role = F.when(clean == "system", SYSTEM).when(clean == "user", USER).when(clean == "assistant", ASSISTANT).otherwise(START)
    turns = c.select(c[conv_col].cast("long").alias("conv_id"), c[turn_col].cast("long").alias("turn"), role.alias("role"),
                     given.alias("given"), c[text_col].cast("string").alias("text"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(FAR))).withColumn(
        "tie", F.xxhash64("given", "text"))
    order = ["conv_id", "block", F.col("turn").asc_nulls_last(), "role", "tie"]

    slim = turns.select("conv_id", "block", "turn", "role", "tie").repartition("conv_id", "block").sortWithinPartitions(*order)
    reduced = slim.select("conv_id", "block", "role").mapInArrow(
        _reduce, "conv_id long, block long, costs array<long>, begun array<long>, rows long")
    borders = staged(reduced.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        _fix_borders, "conv_id long, block long, entry int, leave int, position long, seq long, last boolean, cost long"), "chat-borders")
    b = borders.toDF("c", "b", *borders.columns[2:])
    held = turns.join(b, turns["conv_id"].eqNullSafe(b["c"]) & (turns["block"] == b["b"]))
    held = held.repartition("conv_id", "block").sortWithinPartitions(*order)
    rendered = held.select("conv_id", "block", "entry", "leave", "position", "seq", "last", "turn", "role", "given", "text").mapInArrow(
        _render, "conv_id long, position long, seq long, turn long, role_before string, role string, action string, rendered string")
    cost = borders.where("last").select(F.col("conv_id").alias("c"), "cost")
    return rendered.join(cost, rendered["conv_id"].eqNullSafe(cost["c"])).drop("c")

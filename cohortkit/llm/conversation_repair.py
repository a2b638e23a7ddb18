"""Repair of conversation structure as a lightest derivation.

The rows of a conversation are edited (keep, rerole, delete, insert) until its
role initials read ``(s?(ua)+)?``.  An item says "so many rows are read and
the automaton is in this state"; each edit is a deduction that leads from one
item to another and appends its letter to the item's audit.  Items are
weighted by (cost, audit).  Appending never lowers a weight and keeps the
order of an item's weights (of two derivations of one item with equal cost,
neither audit begins with the other, as more insertions cost more), so the
functions are superior and monotone, and an agenda that always finalises the
lightest item finds each item's lightest derivation when it first pops it; it
stops when the goal is popped.

Rows are dealt by ranges of (conversation, turn, role, hash of the text, salt),
so a task sees whole conversations but for the first and the last of its
range.  Whole ones of up to ``SHORT_ROWS`` rows are repaired at once.  The
rest, and longer ones, are cut into blocks of ``BLOCK_ROWS`` rows.  Every
block yields its lightest derivation from each state to each state; a task of
the conversation links them from the first to the last, one row for each
block; then every block is edited on its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import prepare, staged

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
FINAL = (START, AFTER_A)
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
#: The initial that an insertion or a new role has in each state.
WANTED = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}

SHORT_ROWS = 1024
BLOCK_ROWS = 256
#: A block ends when its texts reach this size, too.
BLOCK_CHARS = 1 << 20
#: Repaired conversations are passed on when their texts reach this size.
_FLUSH_CHARS = 4 << 20
_SPACES = " \t\n\v\f\r"

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# --- the agenda ---------------------------------------------------------------------------------------------------

def lightest(rows: list[tuple[str, str]], start: int = START, to_every_state: bool = False) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) of reading all ``rows`` (initial, fault) from ``start``.

    By default to the lightest final state only; else to each state.
    """
    n, done, ends = len(rows), set(), {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, read, state = heappop(agenda)
        if (read, state) in done:
            continue
        done.add((read, state))
        if read == n:
            if to_every_state or state in FINAL:
                ends[state] = cost, audit
                if not to_every_state:
                    break
        wanted = NEXT[state, WANTED[state]]
        if (read, wanted) not in done:
            heappush(agenda, (cost + COST[INSERT], audit + INSERT, read, wanted))
        if read < n:
            initial, fault = rows[read]
            heappush(agenda, (cost + COST[DELETE], audit + DELETE, read + 1, state))
            if fault in (SOUND, TRUNCATED):
                extra = TRUNCATED_COST if fault == TRUNCATED else 0
                kept = NEXT.get((state, initial))
                if kept is not None:
                    heappush(agenda, (cost + extra, audit + KEEP, read + 1, kept))
                heappush(agenda, (cost + COST[REROLE] + extra, audit + REROLE, read + 1, wanted))
    return ends


def edit(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[tuple[str, str]]:
    """The messages (role, text) that ``audit`` makes of ``rows`` (role, text)."""
    messages, at = [], 0
    for letter in audit:
        if letter == INSERT:
            role, text = ROLES[WANTED[state]], ""
        else:
            role, text = rows[at]
            at += 1
            if letter == DELETE:
                continue
            if letter == REROLE:
                role = ROLES[WANTED[state]]
        messages.append((role, text))
        state = NEXT[state, role[:1]]
    return messages


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row; ``seen``: an earlier row has its role and text."""
    bare = text.rstrip(_SPACES)
    if not bare:
        return BLANK
    if seen:
        return DUPLICATE
    return TRUNCATED if bare[-1] not in ".!?" else SOUND


def summary(rows: list[tuple], fresh) -> dict:
    """Counts and borders of ordered rows (turn, role, text, copies).

    ``fresh`` holds the numbers of the rows whose role and text do not occur before.
    """
    live, turns = [], []
    for i, (turn, role, text, copies) in enumerate(rows):
        for copy in range(copies):
            live.append((role, text, fault_of(text, copy > 0 or i not in fresh)))
        if copies and turn is not None and (not turns or turns[-1] != turn):
            turns.append(turn)
    faults = [f for _, _, f in live]
    pairs = [x[0][:1] + y[0][:1] for x, y in zip(live, live[1:])]
    return {"live": live, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum(p not in LEGAL_PAIRS for p in pairs), "first_turn": turns[0] if turns else None,
            "last_turn": turns[-1] if turns else None, "n_turns": len(turns)}


def _derivable(live) -> list[tuple[str, str]]:
    return [(role[:1], fault) for role, _, fault in live]


def _texts(live) -> list[tuple[str, str]]:
    return [(role, text) for role, text, _ in live]


def repair_rows(rows: list[tuple]) -> dict:
    """Report and repaired messages of one whole conversation's ordered rows (turn, role, text, copies)."""
    met, fresh = set(), set()
    for i, (_, role, text, copies) in enumerate(rows):
        if copies and (role, text) not in met:
            met.add((role, text))
            fresh.add(i)
    found = summary(rows, fresh)
    (cost, audit), = lightest(_derivable(found["live"])).values()
    gaps = found["last_turn"] - found["first_turn"] + 1 - found["n_turns"] if found["n_turns"] else 0
    messages = [{"role": r, "text": t} for r, t in edit(_texts(found["live"]), audit)]
    return {"gaps": gaps, **{k: found[k] for k in (BLANK, DUPLICATE, TRUNCATED, "illegal")}, "cost": cost, "audit": audit, "messages": messages}


# --- tasks over ordered rows --------------------------------------------------------------------------------------

_ROW = "struct<turn:long,role:string,text:string,copies:int>"
_MESSAGES = "array<struct<role:string,text:string>>"
_ARROW_ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32())]))
_ARROW_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_REPORT_DDL = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
_REPORT_ARROW = [*((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())]


class _Output:
    """Collects rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: dict, size: int) -> None:
        self.rows.append(row)
        self.size += size

    def batches(self, last: bool = False):
        if self.rows and (last or self.size >= _FLUSH_CHARS or len(self.rows) >= 1000):
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.size = [], 0


def _split_range(conv_type: pa.DataType):
    """Repair the whole short conversations of a range; cut the others into blocks."""
    schema = pa.schema([("conv_id", conv_type), *_REPORT_ARROW, ("messages", _ARROW_MESSAGES), ("block", pa.int64()), ("rows", _ARROW_ROWS)])

    def run(batches):
        out = _Output(schema)
        next_block = TaskContext.get().partitionId() << 32
        name, rows, chars, started, is_open = None, [], 0, False, True

        def cut():
            nonlocal next_block, rows, chars
            if rows:
                out.add({"conv_id": name, "block": next_block,
                         "rows": [dict(zip(("turn", "role", "text", "copies"), r)) for r in rows]}, chars)
                next_block += 1
            rows, chars = [], 0

        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv_id != name:
                    if started:
                        if is_open:  # the range's first conversation may begin in the range before
                            cut()
                        else:
                            out.add({"conv_id": name, **repair_rows(rows)}, chars)
                            rows, chars = [], 0
                        yield from out.batches()
                    is_open, started, name = not started, True, conv_id
                rows.append(tuple(row))
                chars += len(row[2])
                if is_open and (len(rows) >= BLOCK_ROWS or chars >= BLOCK_CHARS):
                    cut()
                    yield from out.batches()
                elif len(rows) > SHORT_ROWS or chars >= _FLUSH_CHARS:
                    is_open, many = True, rows
                    for at in range(0, len(many), BLOCK_ROWS):
                        rows = many[at:at + BLOCK_ROWS]
                        chars = sum(len(r[2]) for r in rows)
                        cut()
                        yield from out.batches()
        cut()  # the range's last conversation may go on in the next range
        yield from out.batches(last=True)
    return run


def _block_paths(conv_type: pa.DataType):
    """Counts of each block and its lightest derivation from each state to each state."""
    path = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    schema = pa.schema([("conv_id", conv_type), ("block", pa.int64()), *((c, pa.int64()) for c in (BLANK, DUPLICATE, TRUNCATED, "illegal")),
                        ("first_initial", pa.string()), ("last_initial", pa.string()), ("first_turn", pa.int64()),
                        ("last_turn", pa.int64()), ("n_turns", pa.int64()), ("paths", path)])

    def run(batches):
        out = _Output(schema)
        for batch in batches:
            for conv_id, block, rows, fresh in zip(*(c.to_pylist() for c in batch.columns)):
                found = summary([tuple(r.values()) for r in rows], set(fresh or ()))
                live = found.pop("live")
                paths = [{"start": start, "state": state, "cost": cost, "audit": audit} for start in range(4)
                         for state, (cost, audit) in lightest(_derivable(live), start, to_every_state=True).items()]
                ends = {"first_initial": live[0][0][:1] if live else None, "last_initial": live[-1][0][:1] if live else None}
                out.add({"conv_id": conv_id, "block": block, **found, **ends, "paths": paths}, 16 * len(rows))
                yield from out.batches()
        yield from out.batches(last=True)
    return run


class _Path:
    """A derivation over the blocks so far: the last block's piece behind the derivation before it."""

    __slots__ = ("cost", "piece", "start", "before")

    def __init__(self, cost: int, piece: str, start: int, before: _Path | None) -> None:
        self.cost, self.piece, self.start, self.before = cost, piece, start, before

    def lighter(self, other: _Path) -> bool:
        """Less by (cost, audit); both cover the same blocks, so only what they do not share is compared."""
        if self.cost != other.cost:
            return self.cost < other.cost
        x, y, xs, ys = self, other, [], []
        while x is not y:
            xs.append(x.piece)
            ys.append(y.piece)
            x, y = x.before, y.before
        return "".join(reversed(xs)) < "".join(reversed(ys))

    def steps(self) -> list[_Path]:
        found, at = [], self
        while at is not None:
            found.append(at)
            at = at.before
        return found[::-1]


class _Chain:
    """Links the blocks of one conversation in order."""

    def __init__(self, name) -> None:
        self.name, self.blocks, self.paths = name, [], {START: None}
        self.totals = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, "illegal", "n_turns"), 0)
        self.first_turn = self.last_turn = self.last_initial = None

    def add(self, block: dict) -> None:
        self.blocks.append(block["block"])
        for k in self.totals:
            self.totals[k] += block[k]
        if block["first_initial"] is not None:
            if self.last_initial is not None and self.last_initial + block["first_initial"] not in LEGAL_PAIRS:
                self.totals["illegal"] += 1
            self.last_initial = block["last_initial"]
        if block["n_turns"]:
            if self.last_turn is not None and self.last_turn == block["first_turn"]:
                self.totals["n_turns"] -= 1
            if self.first_turn is None:
                self.first_turn = block["first_turn"]
            self.last_turn = block["last_turn"]
        reached = {}
        for p in block["paths"]:
            if p["start"] in self.paths:
                before = self.paths[p["start"]]
                path = _Path((before.cost if before else 0) + p["cost"], p["audit"], p["start"], before)
                held = reached.get(p["state"])
                if held is None or path.lighter(held):
                    reached[p["state"]] = path
        self.paths = reached

    def rows(self):
        best = None
        for state in FINAL:
            path = self.paths.get(state)
            if path is not None and (best is None or path.lighter(best)):
                best = path
        steps = best.steps()
        turns = self.totals.pop("n_turns")
        gaps = self.last_turn - self.first_turn + 1 - turns if turns else 0
        yield {"conv_id": self.name, "gaps": gaps, **self.totals, "cost": best.cost, "audit": "".join(s.piece for s in steps)}
        for block, step in zip(self.blocks, steps):
            yield {"conv_id": self.name, "block": block, "start": step.start, "piece": step.piece}


def _link(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), *_REPORT_ARROW, ("block", pa.int64()), ("start", pa.int32()), ("piece", pa.string())])

    def run(batches):
        out, chain = _Output(schema), None

        def finish():
            for row in chain.rows():
                out.add(row, len(row.get("audit", row.get("piece"))))
                yield from out.batches()

        for batch in batches:
            for block in batch.to_pylist():
                if chain is not None and chain.name != block["conv_id"]:
                    yield from finish()
                    chain = None
                if chain is None:
                    chain = _Chain(block["conv_id"])
                chain.add(block)
        if chain is not None:
            yield from finish()
        yield from out.batches(last=True)
    return run


def _edit_blocks(conv_type: pa.DataType):
    schema = pa.schema([("conv_id", conv_type), ("block", pa.int64()), ("messages", _ARROW_MESSAGES)])

    def run(batches):
        out = _Output(schema)
        for batch in batches:
            for conv_id, block, rows, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                live = [(r["role"], r["text"]) for r in rows for _ in range(r["copies"])]
                messages = [{"role": r, "text": t} for r, t in edit(live, piece, start)]
                out.add({"conv_id": conv_id, "block": block, "messages": messages}, sum(len(t) for _, t in live))
                yield from out.batches()
        yield from out.batches(last=True)
    return run


def _hash_streams(conv_type: pa.DataType):
    """SHA-256 of each conversation's rendered blocks, read in order, a batch in memory at a time."""
    schema = pa.schema([("conv_id", conv_type), ("repaired_sha256", pa.string())])

    def run(batches):
        out, name, digest, begun = _Output(schema), None, None, False
        for batch in batches:
            for conv_id, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or conv_id != name:
                    if digest is not None:
                        out.add({"conv_id": name, "repaired_sha256": digest.hexdigest()}, 64)
                        yield from out.batches()
                    name, digest, begun = conv_id, hashlib.sha256(), False
                if n:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
        if digest is not None:
            out.add({"conv_id": name, "repaired_sha256": digest.hexdigest()}, 64)
        yield from out.batches(last=True)
    return run


# --- operators ----------------------------------------------------------------------------------------------------

def damage(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the damage that crc32(``conv_id:turn``) % 20 deals them.

    0 drops a row (no copies), 1 empties its text, 2 removes its ``.!?``, 3
    repeats it (two copies), 4 sets its role to user.  Nulls are one space in
    the checksum, the role and the text; a null id or turn stays null otherwise.
    """
    def text(column: str) -> Column:
        return F.coalesce(conversations[column].cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(text(id_col), F.lit(":"), text(turn_col)).cast("binary")) % 20
    return conversations.select(
        conversations[id_col].alias("conv_id"), conversations[turn_col].cast("long").alias("turn"),
        F.when(harm == 4, "user").otherwise(text(role_col)).alias("role"),
        F.when(harm.isin(0, 1), "").when(harm == 2, F.regexp_replace(text(text_col), "[.!?]", "")).otherwise(text(text_col)).alias("text"),
        F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1).alias("copies"))


@dataclass
class Repair:
    """``whole``: a row for each conversation that a task held, with report and messages.

    ``long``: the reports of the others; ``blocks``: their messages, in the order of ``block``.
    """

    whole: DataFrame
    long: DataFrame
    blocks: DataFrame


def repair_structure(rows: DataFrame) -> Repair:
    """Repair every conversation of ``rows`` (conv_id, turn, role, text, copies).

    Rows are taken by turn (nulls first), then role, then hash of the text;
    copies stand together.  A null ``conv_id`` is a conversation like any
    other; a null role or text is one space, null copies are one.  Blank and
    truncated are as in ``fault_of``; a duplicate has the role and text of any
    earlier row.  A conversation without copies has zeros, an empty audit and
    no messages.  An empty table gives empty tables.  Other columns are ignored.

    A task holds a range of rows.  A conversation over many ranges is linked
    by one task that reads 16 audits of each block of 256 rows; its report is
    one row, with an audit of one letter for each edit.
    """
    spark = rows.sparkSession
    prepare(spark)
    conv_type = rows.schema["conv_id"].dataType
    arrow_type = _arrow_type(conv_type)
    conv_ddl = f"conv_id {conv_type.simpleString()}"
    ready = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce("copies", F.lit(1)).cast("int").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "near", "salt"]
    # equal rows may stand in any order, so a salt spreads even those over ranges
    dealt = (ready.withColumn("near", F.xxhash64("text")).withColumn("salt", F.rand(7))
             .repartitionByRange(*order).sortWithinPartitions(*order).select(*ready.columns))
    split = staged(dealt.mapInArrow(_split_range(arrow_type), f"{conv_ddl}, {_REPORT_DDL}, messages {_MESSAGES}, block long, rows array<{_ROW}>"),
                   "conversation-ranges")
    report = ["conv_id", *_COUNTS, "audit"]
    blocks = split.where("block is not null").select("conv_id", "block", "rows")

    said = blocks.select("conv_id", "block", F.posexplode("rows").alias("at", "row")).where("row.copies > 0").select(
        "conv_id", "block", "at", "row.role", F.unhex(F.sha2("row.text", 256)).alias("digest"))
    first = said.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("block", "at")).alias("first"))
    fresh = first.groupBy("first.block").agg(F.collect_list("first.at").alias("fresh"))  # a block's rows at most
    paths = blocks.join(fresh, "block", "left").select("conv_id", "block", "rows", "fresh").mapInArrow(
        _block_paths(arrow_type),
        f"{conv_ddl}, block long, blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
        "first_turn long, last_turn long, n_turns long, paths array<struct<start:int,state:int,cost:long,audit:string>>")
    linked = staged(paths.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        _link(arrow_type), f"{conv_ddl}, {_REPORT_DDL}, block long, start int, piece string"), "conversation-links")
    pieces = linked.where("block is not null").select("block", "start", "piece")
    edited = blocks.join(pieces, "block").select("conv_id", "block", "rows", "start", "piece").mapInArrow(
        _edit_blocks(arrow_type), f"{conv_ddl}, block long, messages {_MESSAGES}")
    return Repair(split.where("block is null").select(*report, "messages"), linked.where("block is null").select(*report), edited)


def _arrow_type(conv_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(conv_type)


def rendered(messages: str) -> Column:
    """Messages as ``role:text`` lines."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


def repair_reports(rows: DataFrame) -> DataFrame:
    """The report of every conversation, with the SHA-256 of its repaired messages as ``role:text`` lines.

    A long conversation's checksum reads its blocks in order in one task, one
    batch of blocks at a time: the hash allows no other way.
    """
    repair = repair_structure(rows)
    conv_type = rows.schema["conv_id"].dataType
    whole = repair.whole.withColumn("repaired_sha256", F.sha2(rendered("messages"), 256)).drop("messages")
    streams = repair.blocks.select("conv_id", "block", F.size("messages").alias("n"), rendered("messages").alias("text"))
    hashes = (streams.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "n", "text")
              .mapInArrow(_hash_streams(_arrow_type(conv_type)), f"conv_id {conv_type.simpleString()}, repaired_sha256 string"))
    named = hashes.withColumnRenamed("conv_id", "c")
    long = repair.long.join(named, repair.long["conv_id"].eqNullSafe(named["c"])).drop("c")
    return whole.unionByName(long)

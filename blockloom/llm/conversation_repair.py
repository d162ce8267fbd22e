"""Structure repair of conversations: the cheapest edits that leave an optional system turn and user-assistant pairs.

Every row is kept (free), re-roled to user or assistant (1) or deleted (2), and empty user or assistant turns are
inserted (5). Blank and repeated rows must go; a truncated row that stays costs 5 more. Of equally cheap
repairs the one whose edits, written K, R, D and I in order, come first in ASCII is taken.

The search is depth-first branch and bound with an explicit stack. A node is a place in the conversation and a state
of the grammar. Lower bounds for the rest are made from the end backwards, the incumbent is the best whole
repair so far as (cost, audit), and a table keeps the best prefix of every node, so that a worse one is dropped.
The bounds ignore audits; the search ends when no open prefix can beat the incumbent.

A conversation may hold a third of all rows. Rows are therefore range-partitioned by (conversation, order) into
blocks, a block is searched in pieces of at most PIECE rows, from every state a piece can start in to every state it
can end in, and the pieces of a conversation are joined in order. Equal prefixes of a node are ranked the same
whatever follows, so that joining pieces gives the whole search's result. Texts never meet in one group:
the repaired rows are written out block by block. What one task holds of a conversation is its pieces' audits, a few
bytes a row.

Rows go by turn, nulls first, then role and text; exact copies of a row are counted first and follow each other.
Null roles and texts count as empty, and an empty role fits nowhere in the grammar. Null ids are a conversation of their own. An empty table gives empty
results. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from blockloom.llm.common import quoted, slices
from blockloom.operators.ordered import block_count, stored_size
from blockloom.session import written

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5  # costs
PIECE = 512  # rows searched at once
NONE, BLANK, AGAIN, OPEN = 0, 1, 2, 3  # first fault of a row: none, blank, duplicate, truncated

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES, FINAL = (EMPTY, SYSTEM, USER, ASSISTANT), (EMPTY, ASSISTANT)
#: The state after one more turn that the grammar wants next.
WANTED = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 60

Item = tuple[str, int]  # initial of the role, fault


def after_keep(state: int, initial: str) -> int | None:
    """The state after a row that stays as it is, or None where the grammar has no place for it."""
    if initial == "s":
        return SYSTEM if state == EMPTY else None
    if initial in ("u", "a"):
        return WANTED[state] if ROLE[WANTED[state]][0] == initial else None
    return None


def choices(item: Item, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of what can be done with a row."""
    initial, fault = item
    out = [("D", state, DELETE)]
    if fault in (NONE, OPEN):
        extra = CUT_OFF if fault == OPEN else 0
        kept = after_keep(state, initial)
        if kept is not None:
            out.append(("K", kept, extra))
        out.append(("R", WANTED[state], REROLE + extra))
    return out


def suffix_bounds(items: list[Item], ends: tuple[int, ...]) -> list[list[int]]:
    """Least cost of the rest from every place and state, whatever its audit."""
    row = [0 if s in ends else NEVER for s in STATES]
    bounds = [with_inserts(row)]
    for item in reversed(items):
        after = bounds[-1]
        bounds.append(with_inserts([min(cost + after[to] for _, to, cost in choices(item, s)) for s in STATES]))
    return bounds[::-1]


def with_inserts(row: list[int]) -> list[int]:
    user, assistant = row[USER], row[ASSISTANT]
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return [min(row[EMPTY], INSERT + user), min(row[SYSTEM], INSERT + user), user, assistant]


def search(items: list[Item], start: int, ends: tuple[int, ...], bounds: list[list[int]] | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the best repair from `start` to one of `ends`, or None if there is none."""
    bounds = bounds or suffix_bounds(items, ends)
    incumbent: tuple[int, str] | None = None
    best_at: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + bounds[at][state]
        if least >= NEVER:
            continue
        if incumbent and (least > incumbent[0] or least == incumbent[0] and audit > incumbent[1][: len(audit)]):
            continue
        known = best_at.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        best_at[at, state] = (cost, audit)
        if at == len(items) and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
        steps = [("I", at, WANTED[state], INSERT)]
        if at < len(items):
            steps += [(letter, at + 1, to, extra) for letter, to, extra in choices(items[at], state)]
        # The most promising step is pushed last and so taken first.
        steps.sort(key=lambda s: (s[3] + bounds[s[1]][s[2]], s[0]), reverse=True)
        stack.extend((to, then, cost + extra, audit + letter) for letter, to, then, extra in steps)
    return incumbent


class Piece(NamedTuple):
    """Adjacent rows of one conversation, summed up. `paths` are (state before, state after, cost, audit)."""

    conv: object
    pos: int  # of the first row
    seq: int  # of the first row's copies, the first of this piece
    first: str  # initial
    last: str
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    least_turn: int | None
    most_turn: int | None
    turns: int  # different ones
    paths: list[tuple[int, int, int, str]]


def piece_of(conv, pos: int, seq: int, items: list[Item], turns: list[int | None], whole: bool) -> Piece:
    initials, faults, known = [i for i, _ in items], [f for _, f in items], [t for t in turns if t is not None]
    if whole:
        cost, audit = search(items, EMPTY, FINAL)
        paths = [(EMPTY, EMPTY, cost, audit)]
    else:
        paths = []
        for end in STATES:
            bounds = suffix_bounds(items, (end,))
            found = ((start, search(items, start, (end,), bounds)) for start in STATES)
            paths += [(start, end, *best) for start, best in found if best]
    return Piece(
        conv, pos, seq, initials[0], initials[-1], faults.count(BLANK), faults.count(AGAIN), faults.count(OPEN),
        sum(not follows(a, b) for a, b in zip(initials, initials[1:], strict=False)),
        known[0] if known else None, known[-1] if known else None, len(set(known)), paths,
    )


def follows(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


class Repair(NamedTuple):
    conv: object
    gaps: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    cost: int
    audit: str
    segments: list[tuple[int, int, int, str]]  # pos, seq, state before, audit of each piece


def joined(pieces: list[Piece]) -> Repair:
    """The best repair over the pieces of one conversation, in order."""
    trail: list[dict[int, tuple[int, str]]] = []  # for each piece: state after -> (state before, audit)
    costs = {EMPTY: (0, "")}
    for piece in pieces:
        reached: dict[int, tuple[int, str]] = {}
        came: dict[int, tuple[int, str]] = {}
        for start, end, cost, audit in piece.paths:
            if start in costs:
                whole = (costs[start][0] + cost, costs[start][1] + audit)
                if end not in reached or whole < reached[end]:
                    reached[end], came[end] = whole, (start, audit)
        costs = reached
        trail.append(came)
    end = min((s for s in FINAL if s in costs), key=lambda s: costs[s])
    cost, audit = costs[end]
    segments = []
    for piece, came in zip(reversed(pieces), reversed(trail), strict=True):
        start, part = came[end]
        segments.append((piece.pos, piece.seq, start, part))
        end = start
    known = [p for p in pieces if p.least_turn is not None]
    turns = sum(p.turns for p in known) - sum(a.most_turn == b.least_turn for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1].most_turn - known[0].least_turn + 1 - turns if known else 0
    return Repair(
        pieces[0].conv, min(gaps, (1 << 63) - 1), sum(p.blank for p in pieces), sum(p.duplicate for p in pieces),
        sum(p.truncated for p in pieces),
        sum(p.illegal for p in pieces) + sum(not follows(a.last, b.first) for a, b in zip(pieces, pieces[1:], strict=False)),
        cost, audit, segments[::-1],
    )


class Repairs(NamedTuple):
    rows: DataFrame  # written: conv, turn, role, text, copies, pos; in order of pos
    plans: DataFrame  # written: the fields of Repair


BLOCK_BITS = 33  # monotonically_increasing_id has the partition above, the row below
_BLOCK = f"shiftright(pos, {BLOCK_BITS})"


def _placed(turns: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """Different rows with their copies and places, range-partitioned and written in order."""
    if stored_size(turns) is None:
        turns = written(turns.select(*map(quoted, names)), "sized")
    conv, turn, role, text = map(quoted, names)
    empty = F.lit("")
    narrow = turns.select(
        conv.alias("conv"), turn.cast("long").alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text")
    )
    order = ["conv", "turn", "role", "text"]
    rows = narrow.groupBy(*order).agg(F.count("*").alias("copies"))
    ranged = rows.repartitionByRange(block_count(turns), *order).sortWithinPartitions(*order)
    return written(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")


def _faulty(rows: DataFrame) -> DataFrame:
    """Narrow rows with their first fault. A row repeats if its role and text have an earlier place."""
    digest = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    narrow = rows.select(
        "conv", "turn", "copies", "pos", F.substring("role", 1, 1).alias("initial"), digest.alias("digest"),
        F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("closed"),
    )
    repeated = narrow.filter("digest IS NOT NULL").groupBy("conv", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    repeated = repeated.filter("n > 1").select(F.col("conv").alias("its"), F.col("digest").alias("same"), "first")
    marked = narrow.join(repeated, F.col("conv").eqNullSafe(F.col("its")) & (F.col("digest") == F.col("same")), "left")
    fault = (
        F.when(F.col("digest").isNull(), BLANK).when(F.col("pos") > F.col("first"), AGAIN).when(~F.col("closed"), OPEN).otherwise(NONE)
    )
    return marked.select("conv", "pos", "turn", "copies", "initial", fault.alias("fault"))


def _mapped(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], ddl: str, size: int = 1000) -> DataFrame:
    """`fn` over the rows of each partition, as tuples in and out, in Arrow batches of bounded size."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in slices(batches, size):
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def made(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for record in fn(records(batches)):
            held.append(record)
            if len(held) == size:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return df.mapInArrow(run, ddl)


def pieces_of(records: Iterator[tuple], piece: int) -> Iterator[Piece]:
    """Pieces of rows (conv, pos, turn, copies, initial, fault) that come in order of pos.

    A conversation is searched at once, from start to end, when it surely lies within the block and the piece.
    """
    held: list[Item] = []
    turns: list[int | None] = []
    conv, block, first = None, None, (0, 0)
    begins = False  # whether the held rows are surely the first of their conversation

    def cut(ends: bool) -> Iterator[Piece]:
        if held:
            yield piece_of(conv, *first, held, turns, begins and ends)
            held.clear()
            turns.clear()

    for its_conv, pos, turn, copies, initial, fault in records:
        if block != pos >> BLOCK_BITS:
            yield from cut(False)
            begins = pos == 0
        elif its_conv != conv:
            yield from cut(True)
            begins = True
        conv, block = its_conv, pos >> BLOCK_BITS
        for seq in range(copies):
            if len(held) == piece:
                yield from cut(False)
                begins = False
            if not held:
                first = (pos, seq)
            held.append((initial, fault if seq == 0 or fault == BLANK else AGAIN))
            turns.append(turn)
    yield from cut(False)


def joined_by_conversation(records: Iterator[tuple]) -> Iterator[Repair]:
    """Repairs of pieces that come conversation by conversation, in order."""
    held: list[Piece] = []
    for record in records:
        one = Piece(*record[:-1], [tuple(path.values()) for path in record[-1]])
        if held and held[0].conv != one.conv:
            yield joined(held)
            held = []
        held.append(one)
    if held:
        yield joined(held)


def edited(records: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, pos, sub, role, text) of the repaired turns of whole blocks.

    `records` are (conv, pos, kind, seq, state, role, text, copies) in order of pos, kind and seq: kind 0 is a part
    of an audit, with the state before it, kind 1 a row. A part comes before the row it begins with.
    """
    conv, block, state, last = None, None, EMPTY, (0, 0)
    letters, used = "", 0

    def inserts(pos: int, sub: int) -> Iterator[tuple]:
        nonlocal state, used, last
        while letters[used : used + 1] == "I":
            state, used, last = WANTED[state], used + 1, (pos, sub + 1)
            yield conv, pos, sub, ROLE[state], ""
            sub += 1

    for its_conv, pos, kind, _, its_state, role, text, copies in records:
        if kind == 0:
            if its_conv != conv or pos >> BLOCK_BITS != block:
                yield from inserts(*last)  # what the audit adds at its end
                letters, used, state = "", 0, its_state
            conv, block = its_conv, pos >> BLOCK_BITS
            letters, used = letters[used:] + role, 0
            continue
        last = (pos, 0)
        for _ in range(copies):
            yield from inserts(*last)
            letter, used = letters[used], used + 1
            if letter != "D":
                state = WANTED[state] if letter == "R" else after_keep(state, role[:1])
                yield conv, *last, ROLE[state] if letter == "R" else role, text
                last = (pos, last[1] + 1)
    yield from inserts(*last)


def hashed(records: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, sha256 of its `role:text` lines) of turns that come conversation by conversation, in order."""
    conv, digest = None, None
    for its_conv, _, _, role, text in records:
        if digest is None or its_conv != conv:
            if digest is not None:
                yield conv, digest.hexdigest()
            conv, digest = its_conv, hashlib.sha256()
        else:
            digest.update(b"\n")
        digest.update(f"{role}:{text}".encode())
    if digest is not None:
        yield conv, digest.hexdigest()


def repairs(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    piece: int = PIECE,
) -> Repairs:
    """Find the repair of every conversation; `report` and `repaired_turns` read it."""
    rows = _placed(turns, (conv_col, turn_col, role_col, text_col))
    conv = f"conv {rows.schema['conv'].dataType.simpleString()}"
    counts = "blank long, duplicate long, truncated long, illegal long"
    pieces = _mapped(
        _faulty(rows).repartition(F.expr(_BLOCK)).sortWithinPartitions("pos"),
        lambda records: pieces_of(records, piece),
        f"{conv}, pos long, seq long, first string, last string, {counts}, least_turn long, most_turn long, turns long, "
        "paths array<struct<start: int, end: int, cost: bigint, audit: string>>",
    )
    plans = _mapped(
        pieces.repartition("conv").sortWithinPartitions("conv", "pos", "seq"),
        joined_by_conversation,
        f"{conv}, gaps long, {counts}, cost long, audit string, "
        "segments array<struct<pos: bigint, seq: bigint, state: int, audit: string>>",
    )
    return Repairs(rows, written(plans, "repairs"))


def report(found: Repairs, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""
    rest = [c for c in found.plans.columns if c not in ("conv", "segments")]
    return found.plans.select(F.col("conv").alias(conv_col), *rest)


def repaired_turns(found: Repairs, conv_col: str = "conv_id") -> DataFrame:
    """(conv, pos, sub, role, text): the turns after repair, in order of pos and sub. Inserted turns have empty texts."""
    conv = f"conv {found.rows.schema['conv'].dataType.simpleString()}"
    none, nothing = F.lit(0).cast("long"), F.lit("")
    parts = found.plans.select("conv", F.inline("segments")).select(
        "conv", "pos", F.lit(0).alias("kind"), "seq", "state", F.col("audit").alias("role"), nothing.alias("text"), none.alias("copies")
    )
    texts = found.rows.select(
        "conv", "pos", F.lit(1).alias("kind"), none.alias("seq"), F.lit(0).alias("state"), "role", "text", "copies"
    )
    both = parts.unionByName(texts).repartition(F.expr(_BLOCK)).sortWithinPartitions("pos", "kind", "seq")
    turns = _mapped(both, edited, f"{conv}, pos long, sub long, role string, text string")
    return turns.withColumnRenamed("conv", conv_col)


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, sha256) of repaired turns. A hash runs on from line to line, so one task reads a conversation, batch by batch."""
    ordered = repaired.select(quoted(conv_col).alias("conv"), "pos", "sub", "role", "text")
    conv = f"conv {ordered.schema['conv'].dataType.simpleString()}"
    found = _mapped(ordered.repartition("conv").sortWithinPartitions("conv", "pos", "sub"), hashed, f"{conv}, sha256 string")
    return found.withColumnRenamed("conv", conv_col)

"""Repair of conversations by composition of weighted finite-state machines.

Three machines are composed lazily, state by state as the search needs them: the input acceptor (a chain of a
conversation's rows), the edit transducer (keep, rerole, delete, insert) and the acceptor of the role grammar
``(s?(ua)+)?``. The shortest path is found in topological order over lexicographic weights (cost, label string).
Those weights form a semiring, so a stretch of rows is a matrix from grammar state to grammar state: a
conversation that is long, or lies across partitions, is cut into blocks whose matrices are made side by side
and multiplied. Rows are dealt by range of (conversation, turn, role, text), so no conversation is gathered in one task.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The white space that makes a text blank: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Grammar acceptor: of each state the next one by role initial.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Roles that may be given or inserted. Each state accepts one of them, so labels alone decide a repair's roles.
ROLES = {"u": "user", "a": "assistant"}
#: A block of a long conversation has at most so many rows and, but for its last row, so many characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

Weight = tuple[int, str]
Front = dict[int, Weight]


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated or none ('')."""
    shown = text.rstrip(WHITE)
    return "blank" if not shown else "duplicate" if seen else "" if shown[-1] in ".!?" else "truncated"


def edit_arcs(row: Row) -> Iterator[tuple[str, str, int]]:
    """Arcs of input and edits at one row: (label, role initial that comes out or '', cost)."""
    yield "D", "", DELETE
    if row.fault not in ("blank", "duplicate"):
        late = TRUNCATED if row.fault else 0
        yield "K", row.role[:1] or "?", late
        for initial in ROLES:
            yield "R", initial, REROLE + late


def relaxed(front: Front, arcs: list[tuple[str, str, int]], into: Front) -> Front:
    """Follows arcs, composed with the grammar, from all states of front; the lesser weight of a state stays."""
    for state, (cost, labels) in front.items():
        for label, out, price in arcs:
            to = GRAMMAR[state].get(out) if out else state
            if to is not None:
                weight = (cost + price, labels + label)
                if to not in into or weight < into[to]:
                    into[to] = weight
    return into


def inserted(front: Front) -> Front:
    """The states after inserts at one place: at most two in a row, since a third comes back to a state at a cost."""
    arcs = [("I", initial, INSERT) for initial in ROLES]
    best, layer = dict(front), front
    for _ in range(2):
        layer = relaxed(layer, arcs, {})
        for state, weight in layer.items():
            if state not in best or weight < best[state]:
                best[state] = weight
    return best


def advanced(front: Front, rows: list[Row]) -> Front:
    """The front behind rows; inserts stand before the row they belong to."""
    for row in rows:
        front = relaxed(inserted(front), list(edit_arcs(row)), {})
    return front


def closed(front: Front) -> Weight:
    """The least weight of a final state, inserts at the end included."""
    return min(w for state, w in inserted(front).items() if state in FINAL)


def replay(rows: list[Row], labels: str, state: int) -> list[tuple[str, str]]:
    """(role, text) of what the edits make of rows."""
    out, left = [], iter(rows)
    for label in labels:
        row = None if label == "I" else next(left)
        if label == "D":
            continue
        if label == "K":
            initial, kept = row.role[:1], (row.role, row.text)
        else:
            initial = next(i for i in ROLES if i in GRAMMAR[state])
            kept = (ROLES[initial], "" if row is None else row.text)
        out.append(kept)
        state = GRAMMAR[state][initial]
    return out


def written(kept: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in kept)


def is_legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


def tallied(rows: list[Row]) -> dict[str, int]:
    """Fault counts and illegal neighbours of consecutive rows."""
    found = {k: sum(r.fault == k for r in rows) for k in ("blank", "duplicate", "truncated")}
    return found | {"illegal": sum(not is_legal(a.role, b.role) for a, b in zip(rows, rows[1:], strict=False))}


def repaired(rows: list[Row]) -> dict:
    """The summary of one whole conversation."""
    turns = {r.turn for r in rows if r.turn is not None}
    cost, audit = closed(advanced({0: (0, "")}, rows))
    digest = hashlib.sha256(written(replay(rows, audit, 0)).encode()).hexdigest()
    return tallied(rows) | {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(records: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for r in records:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Cuts a conversation's sorted rows into blocks."""
    held, chars = [], 0
    for r in rows:
        if len(held) == BLOCK_ROWS or chars >= BLOCK_CHARS:
            yield held
            held, chars = [], 0
        held.append(r)
        chars += len(r[3])
    yield held


_SUMMARY = [(k, pa.int64()) for k in COUNTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_CUT = pa.schema([("conv_id", pa.int64()), *_SUMMARY, ("part", pa.int64()), ("seq", pa.int64()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_CUT_SQL = f"conv_id long, {SUMMARY}, part long, seq long, turns array<long>, roles array<string>, texts array<string>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition in order: a summary of each conversation that surely lies whole in it and is one block, blocks of the others."""
    part = TaskContext.get().partitionId()

    def block(conv, seq, rows):
        turns, roles, texts = (list(x) for x in zip(*(r[1:] for r in rows), strict=True))
        return {"conv_id": conv, "part": part, "seq": seq, "turns": turns, "roles": roles, "texts": texts}

    def whole(conv, rows):
        seen, checked = set(), []
        for _, turn, role, text in rows:
            checked.append(Row(turn, role, text, fault(text, (role, text) in seen)))
            seen.add((role, text))
        return {"conv_id": conv} | repaired(checked)

    def records():
        seq, waiting = 0, None  # waiting: the last conversation's only block, as it may go on in the next partition
        for at, (conv, rows) in enumerate(groupby(_rows(batches), key=lambda r: r[0])):
            if waiting is not None:
                yield whole(*waiting)
                waiting = None
            blocks = _blocks(rows)
            first, second = next(blocks), next(blocks, None)
            if second is None and at:
                waiting = (conv, first)
                continue
            for b in (first, *([] if second is None else [second]), *blocks):
                yield block(conv, seq, b)
                seq += 1
        if waiting is not None:
            yield block(waiting[0], seq, waiting[1])

    yield from _batches(records(), _CUT, 64)


_MATRIX = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")]]
    + [("first_role", pa.string()), ("last_role", pa.string()), ("costs", pa.list_(pa.int64())), ("labels", pa.list_(pa.string()))]
)
_MATRIX_SQL = "conv_id long, part long, seq long, n long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first_role string, last_role string, costs array<long>, labels array<string>"


def _checked(turns: list, roles: list, texts: list, firsts: list) -> list[Row]:
    firsts = set(firsts or ())
    return [Row(t, r, x, fault(x, at not in firsts)) for at, (t, r, x) in enumerate(zip(turns, roles, texts, strict=True))]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's matrix: the least weight from each grammar state before it (rows) to each behind it."""

    def records():
        for conv, part, seq, turns, roles, texts, firsts in _rows(batches):
            rows = _checked(turns, roles, texts, firsts)
            matrix = [advanced({state: (0, "")}, rows) for state in range(len(GRAMMAR))]
            known = [t for t in turns if t is not None]
            yield tallied(rows) | {
                "conv_id": conv, "part": part, "seq": seq, "n": len(rows), "distinct": len(set(known)), "low": min(known, default=None), "high": max(known, default=None),
                "first_role": roles[0], "last_role": roles[-1],
                "costs": [row[to][0] if to in row else None for row in matrix for to in range(len(GRAMMAR))], "labels": [row[to][1] if to in row else None for row in matrix for to in range(len(GRAMMAR))],
            }

    yield from _batches(records(), _MATRIX, 64)


_FOLD = pa.schema([("conv_id", pa.int64()), *_SUMMARY, ("part", pa.int64()), ("seq", pa.int64()), ("state", pa.int64()), ("edits", pa.string())])
_FOLD_SQL = f"conv_id long, {SUMMARY}, part long, seq long, state long, edits string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiplies the matrices of each conversation in order: its summary but for the digest, and each block's edits.

    Held are the audit, 1 byte a row, and of each block where it stands and which state leads to which. What
    the label strings of all states have in common is settled and no longer multiplied.
    """
    n_states = len(GRAMMAR)

    def records():
        for conv, blocks in groupby(_rows(batches), key=lambda r: r[0]):
            front, settled, back, where = {0: (0, "")}, [], [], []
            total = dict.fromkeys(COUNTS, 0)
            low = high = last_role = None
            for _, part, seq, n, blank, duplicate, truncated, illegal, distinct, lo, hi, first_role, own_last, costs, labels in blocks:
                after, came = {}, {}
                for state, (cost, before) in front.items():
                    for to in range(n_states):
                        at = state * n_states + to
                        if costs[at] is not None:
                            weight = (cost + costs[at], before + labels[at])
                            if to not in after or weight < after[to]:
                                after[to], came[to] = weight, state
                cut = len(os.path.commonprefix([w[1] for w in after.values()]))
                settled.append(next(iter(after.values()))[1][:cut])
                front = {to: (cost, s[cut:]) for to, (cost, s) in after.items()}
                back.append(bytes(came.get(to, 0) for to in range(n_states)))
                where.append((part, seq, n))
                for k, v in (("blank", blank), ("duplicate", duplicate), ("truncated", truncated), ("illegal", illegal + (last_role is not None and not is_legal(last_role, first_role)))):
                    total[k] += v
                if lo is not None:
                    total["gaps"] -= distinct - (high is not None and high == lo)
                    low, high = lo if low is None else low, hi
                last_role = own_last
            cost, rest = closed(front)
            audit = "".join(settled) + rest
            total |= {"gaps": high - low + 1 + total["gaps"] if low is not None else 0, "cost": cost}
            yield {"conv_id": conv, "audit": audit} | total
            # the state that the last block leaves is the one whose labels, with inserts behind them, are the audit's end
            state = next(s for s, w in front.items() if (m := {q: x for q, x in inserted({s: w}).items() if q in FINAL}) and min(m.values()) == (cost, rest))
            entered = []
            for came in reversed(back):
                state = came[state]
                entered.append(state)
            at = 0
            for k, ((part, seq, n), state) in enumerate(zip(where, reversed(entered), strict=True)):
                to = at
                while n:
                    n -= audit[to] != "I"
                    to += 1
                to = len(audit) if k == len(where) - 1 else to
                yield {"conv_id": conv, "part": part, "seq": seq, "state": state, "edits": audit[at:to]}
                at = to

    yield from _batches(records(), _FOLD, 64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the edits make of each block."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("chunk", pa.string())])

    def records():
        for conv, part, seq, turns, roles, texts, state, edits in _rows(batches):
            kept = replay([Row(*r, "") for r in zip(turns, roles, texts, strict=True)], edits, state)
            yield {"conv_id": conv, "part": part, "seq": seq, "n": len(kept), "chunk": written(kept)}

    yield from _batches(records(), schema, 16)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's chunks in order, streamed."""

    def records():
        for conv, chunks in groupby(_rows(batches), key=lambda r: r[0]):
            digest, begun = hashlib.sha256(), False
            for _, n, chunk in chunks:
                if n:
                    digest.update((b"\n" if begun else b"") + chunk.encode())
                    begun = True
            yield {"conv_id": conv, "repaired_sha256": digest.hexdigest()}

    yield from _batches(records(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): fault counts, the cheapest edits and the repaired text's digest.

    Rows are taken by turn, nulls first, ties by role and text. Null role and text are one space, a null conv_id is a
    conversation of its own. Repeated rows are duplicates, which the repair deletes. Gaps ignore null turns. Very long
    texts and conversations are cut into blocks, equal in result. Empty tables give no rows; extra columns are ignored.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role"), one("text"))
    order = ["conv_id", "turn", "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_cut, _CUT_SQL))
    summary = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    pieces = cut.where("part IS NOT NULL").select("conv_id", "part", "seq", "turns", "roles", "texts")
    # where each (role, text) of these conversations is seen first, by digest
    each = pieces.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "r"))
    each = each.select("conv_id", F.struct("part", "seq", "pos").alias("at"), F.sha2(F.concat(F.char_length("r.roles").cast("string"), F.lit(":"), "r.roles", "r.texts"), 256).alias("digest"))
    firsts = each.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).groupBy("at.part", "at.seq").agg(F.collect_list("at.pos").alias("firsts"))
    matrices = pieces.join(firsts, ["part", "seq"], "left").select(*pieces.columns, "firsts").mapInArrow(_matrices, _MATRIX_SQL)
    in_order = lambda df: df.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    folded = stored(in_order(matrices).mapInArrow(_folded, _FOLD_SQL))
    edits = folded.where("part IS NOT NULL").select("part", "seq", "state", "edits")
    chunks = pieces.join(edits, ["part", "seq"]).select(*pieces.columns, "state", "edits").mapInArrow(_chunks, "conv_id long, part long, seq long, n long, chunk string")
    digests = in_order(chunks).select("conv_id", "n", "chunk").mapInArrow(_digests, "conv_id long, repaired_sha256 string").toDF("_conv", "_digest")
    joined = folded.where("part IS NULL").join(digests, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("repaired_sha256", F.col("_digest"))
    return cut.where("part IS NULL").select(*summary).unionByName(joined.select(*summary))


def damage(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair of damaged conversations, with a row for each original one: zeros, empty audit and digest of nothing where no row is left."""
    found = repair(damage(conversations)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    shown = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *shown, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))

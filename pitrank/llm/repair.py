"""Conversation structure repair: the cheapest edits that give a well-formed role order, as a persistent audit.

The role initials of a conversation should read ``(s?(ua)+)?``.  A row is kept, given another role, or deleted, and
empty turns can be inserted anywhere.  The dynamic programme goes over the rows once with four states (nothing
yet, after a system, user or assistant turn); each state holds its least cost and the string of edit initials that
leads there, the ASCII-least among equal costs.  Edit strings share their prefixes: an edit is a node linked to the
edit before it, with a rolling hash of the whole string and binary-lifting ancestors (a node at depth d keeps
those 1, 2, 4 .. 2^k steps up for which 2^k divides d, two on average).  Ties are broken at the end of the longest
common prefix, found by comparing the hashes of ancestors; equal hashes are verified letter by letter up to a
shared node, so that a collision cannot change the result.  Two strings that lead to one state at equal cost are
never one the prefix of the other: the rest would be insertions only, which cost.

Rows stay distributed: faults are columns (window functions over a conversation, sorted with spilling), the edits
of a conversation are found in one pass over its sorted rows.  Whenever all states share a prefix of edits, those
are applied and forgotten, so a task holds only rows whose edits still depend on what follows.  A conversation is
read by one task, since its result is one row with one audit.

Edge cases: null roles and texts are one space, a null id is a conversation of its own, null turns come first;
rows of equal turn are ordered by role and text; a conversation without rows gives zeros, an empty audit and the
hash of the empty text; a row whose role is empty or begins otherwise cannot be kept as it is; an empty table gives
no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
# Cost of an edit, and of leaving a truncated row.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows after which the edits that are certain are applied.
SETTLE = 256
SCHEMA = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")
_PRIME, _FACTOR = (1 << 61) - 1, 1_000_003


class Edit:
    """A string of edit initials: its last letter, and the string before it."""

    __slots__ = ("depth", "hash", "letter", "up")

    def __init__(self, before: Edit | None, letter: str):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = depth = before.depth + 1
        self.hash = (before.hash * _FACTOR + ord(letter)) % _PRIME
        up, k = [before], 1
        while depth % (1 << k) == 0:
            # The ancestor 2^(k-1) steps up stands at an odd multiple of it, or keeps one as far again.
            up.append(up[-1].above(depth - (1 << k)))
            k += 1
        self.up = tuple(up)

    def above(self, depth: int) -> Edit:
        """The prefix of ``depth`` letters."""
        at = self
        while at.depth > depth:
            for step in reversed(at.up):
                if step.depth >= depth:
                    at = step
                    break
        return at


def common_prefix(a: Edit, b: Edit) -> int:
    """Depth of the longest common prefix of two strings, by hashes of their ancestors, verified."""
    low, high = 0, min(a.depth, b.depth)
    while low < high:
        middle = (low + high + 1) // 2
        if a.above(middle).hash == b.above(middle).hash:
            low = middle
        else:
            high = middle - 1
    x, y, agreed = a.above(low), b.above(low), low
    while x is not y and x.depth:
        if x.letter != y.letter:
            agreed = x.depth - 1
        x, y = x.up[0], y.up[0]
    return agreed


def less(a: Edit, b: Edit) -> bool:
    """Whether string ``a`` comes before ``b``."""
    if a is b:
        return False
    at = common_prefix(a, b)
    if at == min(a.depth, b.depth):
        return a.depth < b.depth
    return a.above(at + 1).letter < b.above(at + 1).letter


Best = tuple[int, Edit] | None


def better(a: Best, b: Best) -> Best:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def extended(best: Best, cost: int, letter: str) -> Best:
    return best and (best[0] + cost, Edit(best[1], letter))


def with_insertions(states: list[Best]) -> list[Best]:
    """States after empty turns may have been inserted; a second user turn in a row never pays."""
    nothing, system, user, assistant = states
    for one in (nothing, system, assistant):
        user = better(user, extended(one, INSERT, "I"))
    return [nothing, system, user, better(assistant, extended(user, INSERT, "I"))]


def after_row(states: list[Best], initial: str, fault: int) -> list[Best]:
    """States after one row is kept, given another role or deleted."""
    nothing, system, user, assistant = states
    out = [extended(one, DELETE, "D") for one in states]
    if fault not in (BLANK, DUPLICATE):
        extra = CUT if fault == TRUNCATED else 0
        if initial == "s":
            out[1] = better(out[1], extended(nothing, KEEP + extra, "K"))
        for one in (nothing, system, assistant):
            if initial == "u":
                out[2] = better(out[2], extended(one, KEEP + extra, "K"))
            out[2] = better(out[2], extended(one, REROLE + extra, "R"))
        if initial == "a":
            out[3] = better(out[3], extended(user, KEEP + extra, "K"))
        out[3] = better(out[3], extended(user, REROLE + extra, "R"))
    return with_insertions(out)


class Conversation:
    """Counts and cheapest edits of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.last_initial: str | None = None
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.root = Edit(None, "")
        self.states = with_insertions([(0, self.root), None, None, None])
        self.waiting: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.sha, self.started, self.next_role = hashlib.sha256(), False, "user"

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        initial = role[:1]
        self.illegal += self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        self.waiting.append((role, text if fault not in (BLANK, DUPLICATE) else ""))
        self.states = after_row(self.states, initial, fault)
        if self.rows % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        """Apply the prefix of edits that all states share, and forget it."""
        found = [s for s in self.states if s]
        shared = found[0][1]
        for _, edit in found[1:]:
            shared = shared.above(common_prefix(shared, edit))
        if not shared.depth:
            return
        self._apply(letters(shared))
        moved: dict[int, Edit] = {}
        start = Edit(None, "")
        for one in found:
            at, path = one[1], []
            while at.depth > shared.depth and id(at) not in moved:
                path.append(at)
                at = at.up[0]
            new = moved.get(id(at), start)
            for old in reversed(path):
                new = moved[id(old)] = Edit(new, old.letter)
        self.states = [s and (s[0], moved.get(id(s[1]), start)) for s in self.states]

    def _apply(self, edits: str) -> None:
        self.audit.append(edits)
        done = 0
        for letter in edits:
            if letter == "I":
                self._write(self.next_role, "")
                continue
            role, text = self.waiting[done]
            done += 1
            if letter != "D":
                self._write(role if letter == "K" else self.next_role, text)
        del self.waiting[:done]

    def _write(self, role: str, text: str) -> None:
        if self.started:
            self.sha.update(b"\n")
        self.started = True
        self.sha.update(f"{role}:{text}".encode())
        self.next_role = "assistant" if role[:1] == "u" else "user"

    def result(self) -> tuple:
        cost, edits = better(self.states[0], self.states[3])
        self._apply(letters(edits))
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


def letters(edit: Edit) -> str:
    out = []
    while edit.depth:
        out.append(edit.letter)
        edit = edit.up[0]
    return "".join(reversed(out))


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: Conversation | None = None
    done: list[tuple] = []
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if current is None or current.conv_id != conv_id:
                if current:
                    done.append(current.result())
                current = Conversation(conv_id)
            if fault is not None:
                current.add(turn, role, text, fault)
        if len(done) >= 1000:
            yield _rows(done)
            done = []
    if current:
        done.append(current.result())
    if done:
        yield _rows(done)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (``conv_id, turn, role, text, present``) by conversation, with its first fault (null: row not present)."""
    held = turns.repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    same = Window.partitionBy("conv_id", "present", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).orderBy(*order)
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    last = F.substring(bare, -1, 1)
    fault = (F.when(~F.col("present"), F.lit(None).cast("int")).when(F.length(bare) == 0, BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
             .when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0))
    # Of equal rows the one that counts as the first goes first.
    return held.withColumn("fault", fault).sortWithinPartitions("conv_id", *order, F.col("fault") == DUPLICATE)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``turns`` (``conv_id, turn, role, text`` and, for rows that are gone, ``present``)."""
    here: Column = F.coalesce(F.col("present"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], here.alias("present"))
    return faults(rows).select("conv_id", "turn", "role", "text", "fault").mapInArrow(_audits, SCHEMA)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of ``turns`` after a planted damage that depends on ``conv_id:turn`` only; lost rows stay with ``present`` false."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(told[0], F.lit(":"), told[1]).cast("binary")) % 20
    role, text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")]
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("present"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")

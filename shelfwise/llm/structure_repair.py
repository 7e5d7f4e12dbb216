"""Conversation structure repair by iterative-deepening A*.

A conversation is well formed when the initials of its roles match ``(s?(ua)+)?``. Edits, in the order of their letters:
``D`` deletes a row (4; the only edit of a blank or repeated row), ``I`` inserts an empty user or assistant row anywhere (3),
``K`` keeps a row (0), ``R`` gives it the user's or the assistant's role (3); a truncated row that is not deleted costs 3 more.
The repair is the cheapest sequence of edits, and of several cheapest ones the least in ASCII.

The search is depth first in ASCII edit order under a cost bound that grows to the least value that the last round exceeded.
A table of failed states holds for every (row, state of the pattern) what a search from there is known to need at least, so
no state fails twice for the same reason; the first accepting path is the answer.

A long conversation is searched in blocks of ``BLOCK`` rows, from the last to the first: the search of a block ends at its
last row, at the cost of the best repair of what follows from the state reached. Paths of a block end with an edit of its last row,
so none is the beginning of another and the least path of the whole begins with the least path of its block: the answer is that
of one search, with linear work.

Rows meet by conversation in a sorted stream, never as a list: faults are found by joins and sorts of hashes, the search keeps
one letter a row, and the texts pass by once more for the repair. So a task holds some bytes a row of one conversation, not its
texts, wherever the conversation is long.

NULL roles and texts are one space; a NULL conv_id is one conversation; a NULL turn sorts first. Rows of one turn are in the
order of role and SHA-256 of the text; equal rows count one by one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_CHARS, ship

#: Costs of the edits, and what a truncated row costs that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_MISSING = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
#: Cost and edits that end the pattern in each state.
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: Rows that are searched at once.
BLOCK = 64
_GONE = "x"  # the letter of a row that has to be deleted; others are s, u, a, o, in capitals where truncated


def _least(letter: str) -> int:
    """What a row costs at least."""
    if letter == _GONE:
        return DELETE
    return min(DELETE, (TRUNCATED if letter.isupper() else 0) + (REROLE if letter in "oO" else 0))


@lru_cache(maxsize=1 << 15)
def search(block: str, after: tuple[int, int, int, int], entry: int) -> tuple[int, str, int]:
    """(cost, edits, state reached) of the best path through a block, where ``after`` is the cost of going on from each state."""
    n = len(block)
    least = [0] * n + [min(after)]
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + _least(block[i])
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []
    reached = entry

    def needs(i: int, q: int) -> int:
        return after[q] if i == n else max(least[i], failed.get((i, q), 0))

    def descend(i: int, q: int, left: int) -> int:
        """0 if the end is reached at a cost of ``left`` at most (the path is then filled backwards), else what is needed."""
        nonlocal reached
        if i == n:
            reached = q
            return 0
        letter = block[i]
        more = TRUNCATED if letter.isupper() else 0
        missing = _MISSING[q][0]
        edits = [("D", DELETE, i + 1, q), ("I", INSERT, i, missing)]
        if letter != _GONE:
            if (kept := _NEXT.get((q, letter.lower()))) is not None:
                edits.append(("K", more, i + 1, kept))
            edits.append(("R", REROLE + more, i + 1, missing))
        short = None
        for name, cost, j, state in edits:
            need = cost + needs(j, state)
            if need <= left:
                need = descend(j, state, left - cost)
                if not need:
                    path.append(name)
                    return 0
                need += cost
            short = need if short is None else min(short, need)
        failed[i, q] = max(short, failed.get((i, q), 0))
        return short

    bound = needs(0, entry)
    while found := descend(0, entry, bound):
        bound = found
    return bound, "".join(reversed(path)), reached


def cheapest(letters: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of the best repair of a conversation, given by a letter a row."""
    starts = range(0, len(letters), block)
    after, steps = tuple(c for c, _ in _END), []
    for a in reversed(starts):
        base = min(after)
        made = [search(letters[a : a + block], tuple(c - base for c in after), q) for q in (range(4) if a else (0,))]
        steps.append([(edits, q) for _, edits, q in made])
        after = tuple(c + base for c, _, _ in made)
    state, edits = 0, []
    for made in reversed(steps):
        part, state = made[state]
        edits.append(part)
    return after[0], "".join(edits) + _END[state][1]


def repaired(edits: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that stay or are inserted."""
    state = 0
    for edit in edits:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K":
            state = _NEXT[state, role[:1]]
        else:
            state, role = _MISSING[state]
        yield edit, role, text


def damage(turns: DataFrame) -> DataFrame:
    """The rows with the faults that a CRC of conversation and turn chooses: dropped, emptied, cut, repeated or of another role."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chosen = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), chosen.alias("chosen")).filter("chosen <> 0")
    k = F.col("chosen")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(k == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_")).drop("_")


def _plain(turns: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"))
    return rows.withColumn("h", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))


def _kind(text: Column) -> Column:
    """b: blank, t: truncated, k: neither."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t")


_FOUND = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FOUND_TYPES = [pa.int64()] * 8 + [pa.string()]
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_NOBODY = object()


def _table(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class _Conversation:
    """What is kept of the rows of one conversation while they pass by in their order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.letters, self.turns, self.low, self.high, self.last = conv_id, bytearray(), 0, None, None, None
        self.counts, self.illegal, self.before = {"b": 0, "d": 0, "t": 0, "k": 0}, 0, None

    def add(self, turn: int | None, role: str, kind: str, first: bool, times: int) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        initial = role[:1]
        for again in range(times):
            fault = "d" if kind != "b" and (again or not first) else kind
            self.counts[fault] += 1
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            letter = initial if initial in ("s", "u", "a") else "o"
            self.letters += (_GONE if fault in "bd" else letter.upper() if fault == "t" else letter).encode()

    def row(self) -> tuple:
        cost, audit = cheapest(self.letters.decode())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, len(self.letters), gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, cost, audit


def find_repairs(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults, cost and edits of every conversation of ``turns``, and of those of ``ids`` without rows."""
    ship(turns.sparkSession)
    rows = _plain(turns).withColumn("kind", _kind(F.col("text")))
    # Equal rows of one turn become one with a count, so that a row repeated without end is small; the first of equal rows of all turns is no fault.
    rows = rows.groupBy("conv_id", "turn", "role", "h", "kind").agg(F.count(F.lit(1)).alias("times"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(F.min(F.struct("turn")).alias("at"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    rows = rows.join(first, same).select("conv_id", "turn", "role", "h", "kind", F.col("turn").eqNullSafe(F.col("at.turn")).alias("first"), "times")
    if ids is not None:
        none = ids.select(F.col("conv_id").cast("long")).distinct()
        rows = rows.unionByName(none.withColumn("times", F.lit(0).cast("long")), allowMissingColumns=True)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for b in batches:
            for conv_id, turn, role, kind, first, times in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "kind", "first", "times"))):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                    if len(done) >= 1000:
                        yield _table(done, _NAMES, _FOUND_TYPES)
                        done = []
                if times:
                    now.add(turn, role, kind, first, times)
        if now is not None:
            done.append(now.row())
            yield _table(done, _NAMES, _FOUND_TYPES)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h").mapInArrow(walk, _FOUND)


def _passing(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's finding, followed by its rows in their order."""
    rows = _plain(turns).unionByName(found, allowMissingColumns=True).withColumn("head", F.col("audit").isNull())
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "head", "turn", "role", "h")


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """(finding, its rows as role and text) for each conversation of a stream; rows that are not taken are passed over."""

    def events():
        for b in batches:
            columns = {c: b.column(c) for c in ("audit", "role", "text")}
            heads = None
            for i, (audit, role, text) in enumerate(zip(*(c.to_pylist() for c in columns.values()))):
                if audit is None:
                    yield None, role, text
                else:
                    heads = heads or {c: b.column(c).to_pylist() for c in _NAMES}
                    yield {c: v[i] for c, v in heads.items()}, None, None

    stream = events()
    event = next(stream, None)
    while event is not None:
        waiting = []

        def rows():
            for e in stream:
                if e[0] is not None:
                    waiting.append(e)
                    return
                yield e[1], e[2]

        mine = rows()
        yield event[0], mine
        for _ in mine:
            pass
        event = waiting[0] if waiting else None


def repair_turns(turns: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place (from 0), role, text and edit (I, K or R)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for head, rows in _by_conversation(batches):
            for place, (edit, role, text) in enumerate(repaired(iter(head["audit"]), rows)):
                done.append((head["conv_id"], place, role, text, edit))
                size += 64 + len(text)
                if size > 4_000_000:
                    yield _table(done, names, types)
                    done, size = [], 0
        if done:
            yield _table(done, names, types)

    names, types = ["conv_id", "place", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return _passing(turns, find_repairs(turns)).mapInArrow(write, "conv_id long, place long, role string, text string, edit string")


def repair_report(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of the repaired rows, for every conversation of ``ids``."""
    names = [c for c in _NAMES if c != "n_rows"] + ["repaired_sha256"]
    types = [pa.int64()] * 7 + [pa.string()] * 2

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for head, rows in _by_conversation(batches):
            sha, between = hashlib.sha256(), ""
            for _, role, text in repaired(iter(head["audit"]), rows):
                sha.update(f"{between}{role}:{text}".encode())
                between = "\n"
            done.append((*(head[c] for c in names[:-1]), sha.hexdigest()))
            if len(done) >= 1000:
                yield _table(done, names, types)
                done = []
        if done:
            yield _table(done, names, types)

    schema = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in names)
    return _passing(turns, find_repairs(turns, ids)).mapInArrow(digest, schema)

"""Repair of conversations whose rows are damaged: error-correcting Earley parsing of their roles.

A conversation should be `(s?(ua)+)?`: perhaps a system row, then pairs of a user's and an assistant's rows. The role grammar is
written left-linear, and error productions say what may be done at a price: a row is kept (free), given another role, deleted,
or a row is inserted. A chart set holds the items of one position; each has its least (cost, audit), the audit being the initials of
the edits so far, and the completed item of the last set is the repair. As the grammar is left-linear, all items begin at the
first row, so a set has as many items as the grammar has states, however long the conversation is.

Of two items that have read the same rows at equal costs neither's audit begins the other's: what is left over would be
inserts, which cost. So audits are decided at a letter where they differ, and the least of a position stays the least.

Rows of a conversation are sorted by Spark, spilling if need be, and pass through one at a time. What all items of a set agree
on is decided and handed out, so only what is undecided is held.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
BLANK = r"[\x20\x09-\x0D]"

#: Productions `state -> before role`: states are the nonterminals of the grammar, which begins in `none`.
GRAMMAR = (("system", "none", "s"), ("open", "none", "u"), ("open", "system", "u"), ("open", "closed", "u"), ("closed", "open", "a"))
START, ACCEPTED = "none", ("none", "closed")
#: The most by which what follows `none` can be cheaper than what follows `closed`: a system row is kept, not deleted.
LEAD = DELETE

FAULTS = ("blank", "duplicate", "truncated")
ROWS = "conv_id long, turn long, role string, text string, fault string, gone boolean"
REPAIRED = "conv_id long, turn long, role string, text string, fault string, edit string, repaired string, price long"


class Chart:
    """The items of the current position: per state the cost, and the edits since the last that all items shared, as (initial, role)."""

    def __init__(self) -> None:
        self.items: dict[str, tuple[int, str, tuple]] = {START: (0, "", ())}
        self._insert(self.items)

    @staticmethod
    def _offer(items: dict, state: str, item: tuple[int, str, tuple]) -> bool:
        known = items.get(state)
        if known is None or item[:2] < known[:2]:
            items[state] = item
            return True
        return False

    def _insert(self, items: dict) -> None:
        """Close a set under productions that read nothing."""
        waiting = list(items)
        while waiting:
            before = waiting.pop()
            cost, audit, roles = items[before]
            for state, known, role in GRAMMAR:
                if known == before and role in ROLES and self._offer(items, state, (cost + INSERT, audit + "I", (*roles, ROLES[role]))):
                    waiting.append(state)

    def read(self, role: str, fault: str | None) -> None:
        """Go on to the next set by a row."""
        after: dict[str, tuple[int, str, tuple]] = {}
        extra = TRUNCATED if fault == "truncated" else 0
        for before, (cost, audit, roles) in self.items.items():
            self._offer(after, before, (cost + DELETE, audit + "D", (*roles, None)))
            if fault in ("blank", "duplicate"):
                continue
            for state, known, initial in GRAMMAR:
                if known != before:
                    continue
                if role[:1] == initial:
                    self._offer(after, state, (cost + extra, audit + "K", (*roles, role)))
                if initial in ROLES:
                    self._offer(after, state, (cost + REROLE + extra, audit + "R", (*roles, ROLES[initial])))
        self._insert(after)
        if START in after and "closed" in after and after[START][0] > after["closed"][0] + LEAD:
            del after[START]
        if "system" in after and "closed" in after and after["system"][0] > after["closed"][0]:
            del after["system"]
        self.items = after

    def settled(self) -> list[tuple[str, str | None]]:
        """The edits that all items share, taken off them."""
        audits, n = [i[1] for i in self.items.values()], 0
        while all(len(a) > n for a in audits) and len({a[n] for a in audits}) == 1 and len({i[2][n] for i in self.items.values()}) == 1:
            n += 1
        if not n:
            return []
        _, audit, roles = next(iter(self.items.values()))
        out = list(zip(audit[:n], roles[:n], strict=True))
        self.items = {s: (c, a[n:], r[n:]) for s, (c, a, r) in self.items.items()}
        return out

    def done(self) -> list[tuple[str, str | None]]:
        """The rest of the least complete item's edits."""
        _, audit, roles = min(i for s, i in self.items.items() if s in ACCEPTED)
        return list(zip(audit, roles, strict=True))


def repaired_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (turn, role, text, fault) of one conversation in order, to (turn, role, text, fault, edit, role after, price) in the order of the edits."""
    chart, waiting = Chart(), deque()

    def made(edits: list[tuple[str, str | None]]) -> Iterator[tuple]:
        for edit, role in edits:
            if edit == "I":
                yield None, None, "", None, edit, role, INSERT
                continue
            turn, was, text, fault = waiting.popleft()
            price = DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
            yield turn, was, text, fault, edit, role, price

    for row in rows:
        waiting.append(row)
        chart.read(row[1], row[3])
        yield from made(chart.settled())
    yield from made(chart.done())


def with_faults(rows: DataFrame) -> DataFrame:
    """Add to rows (`conv_id`, `turn`, `role`, `text`, ...) their first `fault`: blank, duplicate (role and text are those of an earlier row), truncated, or null.

    Rows are in the order of turn (nulls first), role and text. One shuffle by conversation serves this and what follows by conversation.
    """
    text, row = F.col("text"), F.struct("role", "text")
    last = F.substring(F.regexp_replace(text, BLANK + "+$", ""), -1, 1)
    seen = F.row_number().over(W.partitionBy("conv_id", "role", F.md5("text")).orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.regexp_replace(text, BLANK + "+", "") == "", "blank").when(seen, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return rows.withColumn("fault", fault)


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """The cheapest edits that make conversations well formed: a row per edit, in order, conversation by conversation within a partition.

    Columns: `conv_id`, and of the row that is edited `turn`, `role`, `text` and `fault` (null for an insert, whose text is empty), then
    `edit` (K, R, D or I), `repaired` (the role after it, null if deleted) and `price`. Of edits of one cost those with the ASCII-least
    initials are made. Blank rows and duplicates are always deleted. Null roles and texts are read as one space; rows go by turn (nulls
    first), role and text; repeated rows are duplicates. A row with an empty role has no initial and can't be kept. Null conversation ids are one conversation. Rows where `gone` holds don't count, but
    a conversation without others has one row without an edit, so that none is lost. An empty table gives an empty one. Other
    columns are dropped, whatever their names.

    A conversation's rows pass through one task in order, one at a time; the sort before it spills.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), gone.alias("gone"))
    # rows that are gone stand for their conversations only: nothing else of them moves
    shown = [F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("turn", "role", "text")]
    kept = with_faults(rows.select("conv_id", *shown, "gone").repartition("conv_id")).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return kept.select("conv_id", "turn", "role", "text", "fault", "gone").mapInArrow(_repaired, REPAIRED)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: str, chars: int = 1 << 22, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, by number of rows and of characters."""
    names, types = zip(*((n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (c.split(" ") for c in schema.split(", "))), strict=True)
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or size >= chars:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def all_rows() -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), key=lambda r: r[0]):
            count = 0
            for done in repaired_rows(r[1:5] for r in rows if not r[5]):
                count += done[4] != "I"
                yield conv, *done
            if not count:
                yield conv, None, None, None, None, None, None, 0

    return _batched(all_rows(), REPAIRED)


AUDITED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LONGEST = (1 << 63) - 1


def audited(repaired: DataFrame) -> DataFrame:
    """What `repair` gives, without a shuffle between, to a row per conversation: counts of faults, turns that are missing (`gaps`), pairs of
    adjacent roles that aren't legal (`illegal`), the `cost`, the `audit` and the SHA-256 of the repaired conversation's `role:text` lines.

    Rows pass through; of a conversation its audit is held, a letter for each edit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((_audit(conv, rows) for conv, rows in groupby(_rows(batches), key=lambda r: r[0])), AUDITED)

    return repaired.mapInArrow(run, AUDITED)


def _audit(conv: int | None, rows: Iterator[tuple]) -> tuple:
    counts, edits, digest = dict.fromkeys(FAULTS, 0), [], hashlib.sha256()
    first = last = initial = None
    turns = illegal = cost = lines = 0
    for _, turn, role, text, fault, edit, after, price in rows:
        if edit is None:
            continue
        cost += price
        edits.append(edit)
        if fault is not None:
            counts[fault] += 1
        if after is not None:
            digest.update((("\n" if lines else "") + after + ":" + text).encode())
            lines += 1
        if edit == "I":
            continue
        illegal += initial is not None and initial + role[:1] not in ("su", "ua", "au")
        initial = role[:1]
        if turn is not None and turn != last:
            first, last, turns = turn if first is None else first, turn, turns + 1
    gaps = 0 if first is None else last - first + 1 - turns
    return conv, min(gaps, LONGEST), *counts.values(), illegal, cost, "".join(edits), digest.hexdigest()

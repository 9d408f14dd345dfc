"""Greedy claims per key, in parallel inside a key.

Rows of a key are ordered by ``(at, tie)``.  The first row claims; after a claim the next one
is the first later row with ``at >= free`` of that claim, unless it is at ``until`` or later: then
the chain ends.  Rate-limit windows (``free`` is one window later) and retried deliveries (``free``
is when the lock ends, ``until`` when the work turns out to be done) both work like this.

A claim depends on the one before, so the plain way is one task per key.  A key may hold a
third of all rows, so time is cut into blocks instead.  ``free`` is at most ``reach`` after
``at``; a chain therefore enters a block by one of the rows of its first ``reach``, or by the
first row after those.  Going up, each block states for those few entries where the chain
leaves it; groups of blocks are then treated the same way.  Going down, the known entry of
each block marks the claims inside.  Every task sees one block of one key.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens.functions.columns import floor_div

NEVER = 2**63 - 1
Batches = Iterator[pa.RecordBatch]


def _group_starts(rows: pa.Table | pa.RecordBatch) -> list[int]:
    """Positions after the first where a new (key, block) begins."""
    n = rows.num_rows
    if n < 2:
        return []
    fresh = [
        pc.fill_null(pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, n - 1)), True)
        for c in ("key", "block")
    ]
    return [i + 1 for i in pc.indices_nonzero(pc.or_(*fresh)).to_pylist()]


def _whole_groups(batches: Batches) -> Iterator[pa.Table]:
    """Sorted rows re-cut so that no (key, block) is split between two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])
            if _group_starts(seam.combine_chunks()):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        starts = _group_starts(batch)
        if starts:
            yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])]).combine_chunks()
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _emit(rows: pa.Table, picked: list[int], **columns: list[int]) -> Batches:
    """Key, at and tie of the picked rows, and further columns."""
    chosen = rows.select(["key", "at", "tie"]).take(pa.array(picked, pa.int64()))
    for name, values in columns.items():
        chosen = chosen.append_column(name, pa.array(values, pa.int64()))
    yield from chosen.to_batches()


def _bounds(rows: pa.Table) -> Iterator[tuple[int, int]]:
    cuts = [0, *_group_starts(rows), rows.num_rows]
    return zip(cuts[:-1], cuts[1:])


def _state_entries(width: int, reach: int) -> Callable[[Batches], Batches]:
    """Way up: a block answers for each possible entry when the chain is free again."""

    def run(batches: Batches) -> Batches:
        for rows in _whole_groups(batches):
            at, free, until, block = (rows.column(c).to_pylist() for c in ("at", "free", "until", "block"))
            leave, ends = list(free), list(until)
            picked: list[int] = []
            for lo, hi in _bounds(rows):
                for i in range(hi - 2, lo - 1, -1):
                    following = bisect_left(at, free[i], i + 1, hi)
                    if following < hi and at[following] >= until[i]:
                        leave[i] = NEVER
                    elif following < hi:
                        leave[i], ends[i] = leave[following], ends[following]
                last = bisect_left(at, block[lo] * width + reach, lo, hi) + 1
                picked.extend(range(lo, min(last, hi)))
            # The chain has left the block, so it goes on no earlier than at its end.
            yield from _emit(
                rows,
                picked,
                free=[max(leave[i], (block[i] + 1) * width) for i in picked],
                until=[ends[i] for i in picked],
            )

    return run


def _walk(batches: Batches) -> Batches:
    """Way down: mark the chain from the entry of each group.

    The entry is the row after the flagged one.  Without any flag in the table the first row is
    the entry, which is so at the top only.
    """
    for rows in _whole_groups(batches):
        at, free, until = (rows.column(c).to_pylist() for c in ("at", "free", "until"))
        flagged = rows.column("seed").to_pylist() if "seed" in rows.column_names else None
        picked: list[int] = []
        for lo, hi in _bounds(rows):
            i = lo
            if flagged is not None:
                try:
                    i = flagged.index(True, lo, hi) + 1
                except ValueError:
                    continue
            while i < hi:
                picked.append(i)
                following = bisect_left(at, free[i], i + 1, hi)
                if following < hi and at[following] >= until[i]:
                    break
                i = following
        yield from _emit(rows, picked)


def mark_claims(rows: DataFrame, reach: int, fanout: int = 64, levels: int = 2) -> DataFrame:
    """The claiming rows as ``key, at, tie``.

    ``rows``: ``key`` (any type), ``at`` and ``free`` (long; ``NEVER`` ends a chain), ``tie``
    (long, unique per ``key, at``), and maybe ``until`` (long).  Finite ``free`` must not exceed
    ``at + reach``.  Each level divides the rows of a hot key by about ``fanout``.
    """
    if "until" not in rows.columns:
        rows = rows.withColumn("until", F.lit(NEVER))
    key_type = rows.schema["key"].dataType.simpleString()
    stated = f"key {key_type}, at long, tie long, free long, until long"
    marked = f"key {key_type}, at long, tie long"
    level = rows.select("key", "at", "tie", "free", "until")
    stack: list[tuple[DataFrame, int]] = []
    for depth in range(1, levels + 1):
        width = reach * fanout**depth
        stack.append((level, width))
        level = _by_block(level, floor_div(F.col("at"), width)).mapInArrow(_state_entries(width, reach), stated)
    seeds = _by_block(level, F.lit(0).cast("long")).mapInArrow(_walk, marked)
    for lower, width in reversed(stack):
        # Seeds travel as extra flagged rows, so one shuffle brings both together.
        both = lower.withColumn("seed", F.lit(False)).unionByName(
            seeds.withColumns({c: F.lit(None).cast("long") for c in ("free", "until")}).withColumn("seed", F.lit(True))
        )
        ordered = _by_block(both, floor_div(F.col("at"), width), F.desc("seed"))
        seeds = ordered.mapInArrow(_walk, marked)
    return seeds


def _by_block(rows: DataFrame, block: Column, *further: Column) -> DataFrame:
    """One shuffle on (key, block), rows in order; the sort spills when a block is large."""
    return (
        rows.withColumn("block", block)
        .repartition("key", "block")
        .sortWithinPartitions("key", "block", "at", "tie", *further)
    )

"""Greedy selections along a series, cut into blocks.

Both selections depend on earlier decisions, so they cannot be one expression.  They
run per block in Arrow-fed tasks; what crosses block borders is carried by small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..session import stage
from .blocks import BLOCK, block_of, by_group, framed, running

GAPS_PER_BLOCK = 1024


def _spaced(times: np.ndarray, gap: float, last: float) -> np.ndarray:
    """Indices kept by the greedy rule when the latest kept time before is ``last``."""
    keep, i = [], int(np.searchsorted(times, last + gap, "left")) if np.isfinite(last) else 0
    # ``t - last >= gap`` and ``t >= last + gap`` can differ by rounding; test the former.
    while i > 0 and np.isfinite(last) and times[i - 1] - last >= gap:
        i -= 1
    n = len(times)
    while i < n:
        if np.isfinite(last) and times[i] - last < gap:
            i += 1
            continue
        keep.append(i)
        last = times[i]
        i += 1
        if i < n and times[i] - last < gap:
            i = max(i, int(np.searchsorted(times, last + gap, "left")) - 1)
    return np.asarray(keep, dtype=int)


def keep_spaced(df: DataFrame, keys: Sequence[str], time: str, gap: float, width: float | None = None) -> DataFrame:
    """Rows kept when walking each key in time order and demanding ``gap`` since the last kept row.

    1. Every block lists, for each row that could be its first kept row, the last row
       kept in that block (rows that lead to the same end are merged).
    2. One short pass per key over those lists finds the time each block starts from.
    3. Every block repeats the walk from that time and marks its rows.
    Only step 2 sees a whole key, and it sees about one row per ``GAPS_PER_BLOCK`` gaps.
    """
    keys, names = list(keys), list(df.columns)
    width = width or max(gap * GAPS_PER_BLOCK, 1e-9)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    cand = stage(df.withColumn("_blk", block_of(F.col(time), width)))

    def floats(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).to_numpy().astype(float)

    def summarise(table: pa.Table, at: np.ndarray) -> pa.Table:
        times, blks, rows, exits = floats(table, time), table.column("_blk").to_numpy(), [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            t = times[a:b]
            ends, nxt, ts = [0.0] * len(t), np.searchsorted(t, t + gap, "left").tolist(), t.tolist()
            for i in range(len(t) - 1, -1, -1):
                j = nxt[i]
                while j > i + 1 and ts[j - 1] - ts[i] >= gap:
                    j -= 1
                while j < len(ts) and ts[j] - ts[i] < gap:
                    j += 1
                ends[i] = ends[j] if j < len(ts) else ts[i]
            # A block is entered within one gap of its start, or at its first row.
            reach = max(int(blks[a]) * width + gap, ts[0])
            m = max(1, int(np.searchsorted(t, reach, "right")))
            m = min(len(ts), m + 1)
            for i in range(m):
                if i == m - 1 or ends[i + 1] != ends[i]:
                    rows.append(a + i)
                    exits.append(ends[i])
        out = table.select([*keys, "_blk", time]).take(pa.array(rows, pa.int64()))
        return pa.table([*(out.column(k) for k in [*keys, "_blk"]), out.column(time).cast(pa.float64()), pa.array(exits, pa.float64())], [*keys, "_blk", "_entry", "_exit"])

    schema1 = StructType([*key_fields, StructField("_blk", LongType()), StructField("_entry", DoubleType()),
                          StructField("_exit", DoubleType())])
    steps = by_group(cand.select(*keys, "_blk", time), [*keys, "_blk"], [time], summarise, schema1)

    def chain(table: pa.Table, at: np.ndarray) -> pa.Table:
        blk, entry, end = (table.column(n).to_pylist() for n in ("_blk", "_entry", "_exit"))
        rows, starts = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            last, i = float("-inf"), a
            while i < b:
                rows.append(i)
                starts.append(last)
                here, enters = blk[i], True
                while i < b and blk[i] == here:
                    # entries are the last row of each merged group: the first that qualifies leads its group
                    if enters and entry[i] - last >= gap:
                        last, enters = end[i], False
                    i += 1
        return table.select([*keys, "_blk"]).take(pa.array(rows, pa.int64())).append_column("_last", pa.array(starts, pa.float64()))

    schema2 = StructType([*key_fields, StructField("_blk", LongType()), StructField("_last", DoubleType())])
    entered = by_group(steps, keys, ["_blk", "_entry"], chain, schema2)

    def mark(table: pa.Table, at: np.ndarray) -> pa.Table:
        times, last = floats(table, time), table.column("_last").to_pylist()
        kept = [a + _spaced(times[a:b], gap, last[a]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return table.select(names).take(pa.array(np.concatenate(kept)))

    return by_group(cand.join(entered, [*keys, "_blk"]), [*keys, "_blk"], [time], mark, df.schema)


def local_maxima(df: DataFrame, keys: Sequence[str] = ("series_id",), pos="n", value="v",
                 width: int = BLOCK) -> DataFrame:
    """Interior rows above both sides.  A level top counts once, at its middle row (rounded down)."""
    keys = list(keys)
    d = framed(df, keys, pos, 1, 1, {
        "_up": lambda w: F.col(value) > F.lag(value).over(w),
        "_level": lambda w: F.col(value) == F.lag(value).over(w),
        "_down": lambda w: F.lead(value).over(w) < F.col(value),
    }, width)
    # Rows of one level top share the position of the row that rose onto it.
    d = running(d, keys, [pos], block_of(F.col(pos), width),
                {"_rise": ("last", F.when(~F.coalesce("_level", F.lit(False)), F.struct(F.col(pos).alias("p"), F.coalesce("_up", F.lit(False)).alias("up"))))})
    ends = d.filter(F.col("_down") & F.col("_rise.up"))
    mid = F.floor((F.col("_rise.p") + F.col(pos)) / 2).cast("long")
    return ends.select(*keys, mid.alias(pos), value)


def find_peaks(df: DataFrame, distance: int, height: DataFrame | float | None = None, keys=("series_id",), pos="n",
               value="v", width: int = BLOCK) -> DataFrame:
    """Local maxima of at least ``height``, thinned highest first so that kept ones are ``distance`` apart.

    ``height`` is a number or a table with one ``height`` per key.
    """
    keys = list(keys)
    peaks = local_maxima(df, keys, pos, value, width)
    if isinstance(height, DataFrame):
        peaks = peaks.join(height.select(*keys, "height"), keys).filter(F.col(value) >= F.col("height")).drop("height")
    elif height is not None:
        peaks = peaks.filter(F.col(value) >= height)
    return thin_by_height(peaks, distance, keys, pos, value)


UNKNOWN, DROPPED, KEPT = 0, 1, 2


def _settle(pos: np.ndarray, val: np.ndarray, state: np.ndarray, sure: np.ndarray, distance: int) -> np.ndarray:
    """Decide peaks from the highest down; ``sure`` says that all neighbours of a peak are visible.

    A peak falls when a kept higher one is nearer than ``distance``; it stays when every
    higher neighbour fell.  Otherwise its fate is open.  The later of two equal peaks counts as higher.
    """
    order = np.lexsort((pos, val))[::-1]
    rank = np.empty(len(pos), int)
    rank[order] = np.arange(len(pos))
    state = state.copy()
    for i in order:
        if state[i] != UNKNOWN:
            continue
        lo = int(np.searchsorted(pos, pos[i] - distance, "right"))
        hi = int(np.searchsorted(pos, pos[i] + distance, "left"))
        near = [j for j in range(lo, hi) if j != i and rank[j] < rank[i]]
        if any(state[j] == KEPT for j in near):
            state[i] = DROPPED
        elif sure[i] and all(state[j] == DROPPED for j in near):
            state[i] = KEPT
    return state


def thin_by_height(peaks: DataFrame, distance: int, keys=("series_id",), pos="n", value="v",
                   block: int | None = None) -> DataFrame:
    """Highest-first suppression, exact for series of any length.

    A peak waits for the higher ones nearer than ``distance``.  Blocks with a border of several distances settle whatever
    hangs on peaks that they see; the rest waits for the next round, in which blocks with open peaks run again with what their
    neighbours settled.  The highest open peak of a series waits for nobody, so every round settles some; a run of rising
    peaks takes one round per block.  No task ever sees more than a block and its borders.
    """
    keys = list(keys)
    if distance <= 1:
        return peaks.select(*keys, pos, value)
    block = block or max(BLOCK, 64 * distance)
    border = min(block, 16 * distance)
    p = F.col(pos)
    key_fields = [f for f in peaks.schema.fields if f.name in keys]
    schema = StructType([*key_fields, StructField(pos, LongType()), StructField(value, DoubleType()),
                         StructField("_home", LongType()), StructField("_state", LongType())])

    def decide(table: pa.Table, at: np.ndarray) -> pa.Table:
        xs, vs, states, homes, blks = (table.column(n).to_numpy() for n in (pos, value, "_state", "_home", "_blk"))
        settled = np.array(states)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            x, lo, hi = xs[a:b], int(blks[a]) * block - border, (int(blks[a]) + 1) * block + border
            settled[a:b] = _settle(x, vs[a:b], states[a:b], (x - distance >= lo) & (x + distance < hi), distance)
        out = table.select([*keys, pos, value, "_home"]).append_column("_state", pa.array(settled))
        return out.filter(pa.array(homes == blks))

    seen = F.explode(F.sequence(block_of(p - border, block), block_of(p + border, block)))
    state = peaks.select(*keys, p.cast("long").alias(pos), F.col(value).cast("double").alias(value), block_of(p, block).alias("_home"), F.lit(UNKNOWN).cast("long").alias("_state"))
    state = stage(by_group(state.withColumn("_blk", seen), [*keys, "_blk"], [pos], decide, schema))
    while True:
        waiting = state.filter(F.col("_state") == UNKNOWN).select(*keys, F.col("_home").alias("_blk")).distinct()
        if waiting.isEmpty():
            return state.filter(F.col("_state") == KEPT).select(*keys, pos, value)
        again = by_group(state.withColumn("_blk", seen).join(waiting, [*keys, "_blk"], "left_semi"), [*keys, "_blk"], [pos], decide, schema)
        rest = state.join(waiting.withColumnRenamed("_blk", "_home"), [*keys, "_home"], "left_anti")
        state = stage(again.unionByName(rest))

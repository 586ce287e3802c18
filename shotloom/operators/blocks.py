"""Ordered work on series of any length.

A window partitioned by the series key alone puts a whole series into one task,
and one series may hold a large part of all rows.  Everything ordered in this
package therefore goes through the helpers below, which cut a series into blocks:

* ``framed``   – frames of a few rows either side (lag, lead, local averages).  Rows
  next to a block border are copied into the neighbour block; the copies are dropped
  after the window has run.
* ``running``  – aggregates from the start of the series.  One partial per block, a
  prefix over the (few) partials, then a window inside each block.
* ``asof``     – previous / next / nearest match in time, built on ``running``.
* ``by_group`` – array work on many small groups per call, where a call per group would cost more than the work.
* ``quantiles``– exact percentiles from brackets refined to a bounded number of rows and one counting pass.

Blocks over a dense index hold exactly ``BLOCK`` rows.  Blocks over time hold
(sampling rate x width) rows, so the width is chosen from the rate of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import stage

BLOCK = 65536          # rows of a dense index per block
TIME_BLOCK = 86400.0   # seconds per block where only a time is known


def block_of(pos: Column, width: float) -> Column:
    return F.floor(pos / F.lit(float(width))).cast("long")


def framed(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int,
           cols: dict[str, Callable[[W], Column]], width: int = BLOCK) -> DataFrame:
    """Add windowed columns whose frames reach ``before`` rows back and ``after`` ahead.

    ``pos`` must be dense within a key.  Each function gets the window (partitioned
    by key and block, ordered by ``pos``) and returns the column.
    """
    p = F.col(pos)
    cut = (df.withColumn("_home", block_of(p, width))
             .withColumn("_blk", F.explode(F.sequence(block_of(p - F.lit(after), width),
                                                      block_of(p + F.lit(before), width)))))
    w = W.partitionBy(*keys, "_blk").orderBy(pos)
    return (cut.withColumns({name: fn(w) for name, fn in cols.items()})
               .filter(F.col("_home") == F.col("_blk")).drop("_home", "_blk"))


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
            spec: dict[str, tuple], inclusive: bool = True) -> DataFrame:
    """Aggregates over all earlier rows of the key, or over all later rows.

    ``spec`` maps an output name to (kind, value) or (kind, value, "ahead"); kinds are
    sum, max, min and ``last`` (the nearest non-null value).  ``block`` must not
    decrease along ``order``.
    """
    d = df.withColumn("_blk", block)
    d = d.withColumns({f"_v_{n}": s[1] for n, s in spec.items()})
    at = F.struct(*[F.col(c) for c in order])
    partial, prefix, local, kinds = [], [], {}, {}
    for n, s in spec.items():
        kind, ahead = s[0], len(s) > 2 and s[2] == "ahead"
        kinds[n] = kind
        turn = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
        before = W.partitionBy(*keys).orderBy(turn("_blk")).rowsBetween(W.unboundedPreceding, -1)
        w = W.partitionBy(*keys, "_blk").orderBy(*[turn(c) for c in order]) \
             .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        v = F.col(f"_v_{n}")
        if kind == "last":
            pick = F.min_by if ahead else F.max_by
            partial.append(pick(v, F.when(v.isNotNull(), at)).alias(f"_p_{n}"))
            prefix.append(F.last(f"_p_{n}", ignorenulls=True).over(before).alias(f"_c_{n}"))
            local[n] = F.last(v, ignorenulls=True).over(w)
        else:
            agg = {"sum": F.sum, "max": F.max, "min": F.min}[kind]
            partial.append(agg(v).alias(f"_p_{n}"))
            prefix.append(agg(f"_p_{n}").over(before).alias(f"_c_{n}"))
            local[n] = agg(v).over(w)
    carry = d.groupBy(*keys, "_blk").agg(*partial).select(*keys, "_blk", *prefix)
    out = d.join(carry, [*keys, "_blk"])
    out = out.withColumns({n: _merge(kinds[n], F.col(f"_c_{n}"), local[n]) for n in spec})
    return out.drop("_blk", *[f"_v_{n}" for n in spec], *[f"_c_{n}" for n in spec])


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                name: str = "n") -> DataFrame:
    """0-based position of each row within its key."""
    out = running(df, keys, order, block, {name: ("sum", F.lit(1).cast("long"))})
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
               value: Column, prev: str | None = None, nxt: str | None = None) -> DataFrame:
    """The non-null value of the row before and / or after."""
    spec = {}
    if prev:
        spec[prev] = ("last", value)
    if nxt:
        spec[nxt] = ("last", value, "ahead")
    return running(df, keys, order, block, spec, inclusive=False)


def asof(probes: DataFrame, samples: DataFrame, keys: Sequence[str], probe_time: str,
         sample_time: str, payload: Sequence[str] = (), how: str = "forward",
         width: float = TIME_BLOCK, prefix: str = "s_") -> DataFrame:
    """Match every probe with one sample of the same key by time.

    ``forward`` takes the first sample at or after the probe, ``backward`` the last
    at or before it, ``nearest`` the closer of both with the earlier one on ties, and
    ``both`` the last at or before (``b_``) and the first after (``f_``).  Probes without
    a match keep nulls.  Columns come back as ``prefix + name``.
    """
    extra = [c for c in payload if c != sample_time]
    hit = F.struct(F.col(sample_time).cast("double").alias("at"), *[F.col(c) for c in extra])
    names = [c for c in probes.columns if c not in keys]
    left = probes.select(*keys, F.col(probe_time).cast("double").alias("_t"), F.lit(True).alias("_probe"),
                         F.struct(*[F.col(c) for c in names]).alias("_row"))
    right = samples.select(*keys, F.col(sample_time).cast("double").alias("_t"), F.lit(False).alias("_probe"),
                           hit.alias("_hit"))
    both = left.unionByName(right, allowMissingColumns=True)
    block = block_of(F.col("_t"), width)
    # At equal times the sample must come first in walking direction.  The nearest match
    # finds an equal time looking back, so one order serves both of its directions.
    first = F.when(F.col("_probe"), 0).otherwise(1) if how == "forward" else F.when(F.col("_probe"), 1).otherwise(0)
    spec = {}
    if how in ("backward", "nearest", "both"):
        spec["_b"] = ("last", F.col("_hit"))
    if how in ("forward", "nearest", "both"):
        spec["_f"] = ("last", F.col("_hit"), "ahead")
    out = running(both.withColumn("_o", first), keys, ["_t", "_o"], block, spec).filter("_probe")
    if how == "both":
        sides = [(f"_{s}", f"{s}_") for s in ("b", "f")]
        return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in names],
                          *[F.col(f"{m}.{src}").alias(pre + dst) for m, pre in sides
                            for src, dst in [("at", sample_time), *[(c, c) for c in extra]]])
    if how == "nearest":
        closer = (F.col("_b").isNull() |
                  (F.col("_f").isNotNull() & ((F.col("_f.at") - F.col("_t")) < (F.col("_t") - F.col("_b.at")))))
        pick = F.when(closer, F.col("_f")).otherwise(F.col("_b"))
    else:
        pick = F.col(next(iter(spec)))
    out = out.withColumn("_m", pick)
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in names],
                      F.col("_m.at").alias(prefix + sample_time),
                      *[F.col(f"_m.{c}").alias(prefix + c) for c in extra])


def _borders(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows that begin another group than the row before them."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for k in keys:
        code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= code[1:] != code[:-1]
    return np.flatnonzero(new) + 1


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows dealt by key to a fixed number of tasks, for work whose weight does not show in their bytes.

    They are dealt by a hash of the keys: an exchange by the keys themselves is left out behind a join on them, and adaptive
    execution may later turn that join into one that no longer holds the rows of a key in one task.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, F.xxhash64(*keys))


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """``fn`` gets whole groups, one after the other and ordered, and the rows at which they begin (with the end of the last).

    It sees as many groups at once as fill an Arrow batch; a group that is longer comes alone.  The groups are dealt to a fixed
    number of tasks, as the work per group does not show in the bytes by which small partitions are put together.
    """
    keys = list(keys)

    def run(batches):
        def done(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            yield from fn(t, np.concatenate([[0], _borders(t, keys), [t.num_rows]])).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            new = _borders(pa.Table.from_batches([*ends, batch]), keys) - len(ends)
            if len(new):
                yield from done([*held, batch.slice(0, new[-1])])
                held, batch = [], batch.slice(new[-1])
            held.append(batch)
        if held:
            yield from done(held)
    return spread(df, keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


BRACKET_ROWS = 20000   # values that may lie between two bounds of a wanted rank
BINS = 1024            # parts into which a wider bracket is cut per round


def _brackets(d: DataFrame, keys: Sequence[str], probs: Sequence[float], rows: int) -> DataFrame:
    """Per key the count ``_n`` and, for each wanted rank, bounds ``_lo`` and ``_hi`` with at most ``rows`` values between them
    or with one value only.

    Brackets start as wide as the group.  While one holds too many values it is cut into ``BINS`` equal parts, which are
    counted for all keys at once; the part with the wanted rank, drawn in to its smallest and largest value, takes its place.
    """
    x = F.col("_v")
    whole = d.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array(*[f(F.lit(float(p)) * (F.col("_n") - 1)).cast("long") for f in (F.floor, F.ceil) for p in probs])
    state = stage(whole.select(*keys, "_n", "_lo", "_hi", F.posexplode(ranks).alias("_i", "_rank")).withColumns({"_below": F.lit(0).cast("long"), "_inside": F.col("_n")}))
    wide = (F.col("_inside") > rows) & (F.col("_lo") < F.col("_hi"))
    while not state.filter(wide).isEmpty():
        low, high = F.greatest("_lo", F.lit(-1.7e308)) / 2, F.least("_hi", F.lit(1.7e308)) / 2      # halves, so that a span stays finite
        part = F.when(F.isnan(x), BINS - 1).otherwise(F.greatest(F.least(F.floor((x / 2 - low) / (high - low) * BINS), F.lit(BINS - 1)), F.lit(0)))
        todo = state.filter(wide)
        counts = (d.join(todo, list(keys)).filter((x >= F.col("_lo")) & (x <= F.col("_hi"))).withColumn("_part", part).groupBy(*keys, "_i", "_part")
                   .agg(F.count("_v").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b")))
        upto = F.sum("_c").over(W.partitionBy(*keys, "_i").orderBy("_part"))
        found = counts.withColumn("_upto", upto).join(todo, [*keys, "_i"]).withColumn("_before", F.col("_below") + F.col("_upto") - F.col("_c"))
        found = found.filter((F.col("_before") <= F.col("_rank")) & (F.col("_below") + F.col("_upto") > F.col("_rank")))
        narrowed = found.select(*keys, "_n", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_i", "_rank", F.col("_before").alias("_below"), F.col("_c").alias("_inside"))
        state = stage(state.filter(~wide).unionByName(narrowed))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_lo", "_hi")))
    return state.groupBy(*keys, "_n").agg(ordered.alias("_s")).select(*keys, "_n", F.col("_s._lo").alias("_lo"), F.col("_s._hi").alias("_hi"))


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float], rows: int = BRACKET_ROWS) -> DataFrame:
    """Exact linearly interpolated percentiles per key, one column per entry of ``probs``.

    Every wanted rank gets a bracket of at most ``rows`` values (``_brackets``).  Values inside stay as they are and the rest is
    counted, so what is ranked per key is bounded, however large the group.
    """
    if not keys:
        return quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, rows).drop("_all")
    names = list(probs)
    d = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sketch = _brackets(d, keys, list(probs.values()), rows)
    x = F.col("_v")
    passed = F.size(F.filter(F.col("_hi"), lambda h: h < x))
    inside = F.exists(F.zip_with("_lo", "_hi", lambda a, b: (x >= a) & (x <= b)), lambda b: b)
    # a bracket of one value may have any number of rows, as have the gaps: these are counted, the others are few per key and stay as they are
    single = F.exists(F.zip_with("_lo", "_hi", lambda a, b: (x == a) & (x == b)), lambda b: b)
    placed = d.join(sketch.hint("shuffle_hash"), list(keys)).select(*keys, "_n", passed.alias("_gap"), inside.alias("_in"), single.alias("_one"), F.when(inside, x).alias("_v"))
    alone = F.col("_in") & ~F.col("_one")
    counted = placed.filter(~alone).groupBy(*keys, "_n", "_gap", "_in", "_v").agg(F.count(F.lit(1)).alias("_c"))
    counted = counted.unionByName(placed.filter(alone).select(*keys, "_n", "_gap", "_in", "_v", F.lit(1).cast("long").alias("_c")))
    w = W.partitionBy(*keys).orderBy("_gap", "_in", "_v").rowsBetween(W.unboundedPreceding, 0)      # equal values take ranks one after the other
    ranked = counted.withColumn("_end", F.sum("_c").over(w)).withColumn("_from", F.col("_end") - F.col("_c"))
    picks, outs = [], []
    for n in names:
        pos = F.lit(float(probs[n])) * (F.col("_n") - 1)
        for tag, rank in (("a", F.floor(pos)), ("b", F.ceil(pos))):
            picks.append(F.max(F.when((F.col("_from") <= rank) & (F.col("_end") > rank), F.col("_v"))).alias(f"_{n}{tag}"))
        outs.append((F.col(f"_{n}a") + (F.col(f"_{n}b") - F.col(f"_{n}a")) * (pos - F.floor(pos))).alias(n))
    return ranked.groupBy(*keys, "_n").agg(*picks).select(*keys, *outs)


def lengths(df: DataFrame, keys: Sequence[str], pos: str = "n", name: str = "len") -> DataFrame:
    """Rows per key of a dense index."""
    return df.groupBy(*keys).agg((F.max(pos) + 1).alias(name))


def framed_time(df: DataFrame, keys: Sequence[str], time: str, before: float, after: float,
                cols: dict[str, Callable[[W], Column]], width: float = TIME_BLOCK) -> DataFrame:
    """As ``framed`` for frames given in time; the window is ordered by microseconds."""
    t = F.col(time)
    width = max(width, before + after)
    cut = (df.withColumn("_home", block_of(t, width))
             .withColumn("_blk", F.explode(F.sequence(block_of(t - F.lit(after), width), block_of(t + F.lit(before), width)))))
    w = W.partitionBy(*keys, "_blk").orderBy(F.round(t * 1e6).cast("long"))
    return (cut.withColumns({name: fn(w) for name, fn in cols.items()})
               .filter(F.col("_home") == F.col("_blk")).drop("_home", "_blk"))

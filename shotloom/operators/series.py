"""Operators on per-series, time-ordered samples: change, thresholds, peaks, segments, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import clip
from ..session import stage
from .blocks import BLOCK, TIME_BLOCK, asof, block_of, dense_index, framed, lengths, neighbours, quantiles, running
from .peaks import keep_spaced

# Fixed values of the shot detector.
FLOOR = 3.0
MAD_FACTOR = 6.0
MIN_SENSITIVITY = 0.2
NEIGHBOURS = 5
MEAN_RATIO = 1.7
MAX_RATIO = 1.05
SHORTEST_SHARE = 0.8

# Fixed values of the level curve, the quiet-run search and the speech windows.
QUIET_BELOW = 0.08
QUIET_MIN = 0.25
MERGE_GAP = 0.45
MIN_WINDOW = 0.35


def change_score(frames: DataFrame, keys=("series_id",), pos="n", value="v", width: int = BLOCK) -> DataFrame:
    """Mean absolute difference to the frame before; 0 for the first frame.

    ``value`` is a number or an array of numbers per frame.
    """
    vector = dict(frames.dtypes)[value].startswith("array")

    def score(w):
        v, back = F.col(value), F.lag(value).over(w)
        if not vector:
            return F.coalesce(F.abs(v - back), F.lit(0.0))
        gaps = F.zip_with(v, back, lambda a, b: F.abs(a - b).cast("double"))
        total = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)
        return F.coalesce(total / F.size(v), F.lit(0.0))

    return framed(frames, list(keys), pos, 1, 0, {"score": score}, width)


def robust_threshold(scores: DataFrame, keys=("series_id",), value="score", sensitivity: float = 1.0,
                     floor: float = FLOOR) -> DataFrame:
    """Median plus a multiple of the median absolute deviation, never below ``floor``."""
    keys = list(keys)
    mid = quantiles(scores, keys, F.col(value), {"med": 0.5})
    spread = quantiles(scores.join(mid, keys), keys, F.abs(F.col(value) - F.col("med")), {"mad": 0.5})
    mad = F.when(F.col("mad") == 0, F.lit(1e-6)).otherwise(F.col("mad"))
    level = F.col("med") + F.lit(MAD_FACTOR / max(MIN_SENSITIVITY, sensitivity)) * mad
    return mid.join(spread, keys).select(*keys, "med", "mad", F.greatest(level, F.lit(floor)).alias("threshold"))


def prominent_peaks(scores: DataFrame, thresholds: DataFrame, keys=("series_id",), pos="n", value="score",
                    reach: int = NEIGHBOURS, width: int = BLOCK) -> DataFrame:
    """Rows above the threshold that also stand clear of their neighbours."""
    keys = list(keys)

    def side(fn):
        def both(w):
            back, ahead = w.rowsBetween(-reach, -1), w.rowsBetween(1, reach)
            return fn(back, ahead)
        return both

    v = F.col(value)
    near = framed(scores, keys, pos, reach, reach, {
        "_sum": side(lambda b, a: F.coalesce(F.sum(v).over(b), F.lit(0.0)) + F.coalesce(F.sum(v).over(a), F.lit(0.0))),
        "_cnt": side(lambda b, a: F.count(v).over(b) + F.count(v).over(a)),
        "_max": side(lambda b, a: F.greatest(F.max(v).over(b), F.max(v).over(a))),
    }, width)
    clear = (F.col("_cnt") == 0) | (v >= F.greatest(F.lit(MEAN_RATIO) * F.col("_sum") / F.col("_cnt"),
                                                    F.lit(MAX_RATIO) * F.col("_max")))
    return (near.join(thresholds.select(*keys, "threshold"), keys)
                .filter((v > F.col("threshold")) & clear).drop("_sum", "_cnt", "_max", "threshold"))


def debounce(peaks: DataFrame, min_gap: float, keys=("series_id",), time="t", width: float | None = None) -> DataFrame:
    """Keep rows in time order that lie at least ``min_gap`` after the last kept row."""
    return keep_spaced(peaks, list(keys), time, min_gap, width)


def boundaries_to_segments(cuts: DataFrame, durations: DataFrame, min_len: float, keys=("series_id",), time="t",
                           width: float = TIME_BLOCK, min_samples: str | None = None) -> DataFrame:
    """Segments between the cuts strictly inside the series; short ones dropped, the rest numbered.

    A series without a usable segment (or with fewer than three samples, counted in
    the column ``min_samples`` of ``durations``) is one segment as a whole.
    """
    keys = list(keys)
    usable = durations if min_samples is None else durations.filter(F.col(min_samples) >= 3)
    inner = (cuts.select(*keys, F.col(time).alias("start")).join(usable.select(*keys, "duration"), keys)
                 .filter((F.col("start") > min_len) & (F.col("start") < F.col("duration") - min_len)))
    first = usable.select(*keys, F.lit(0.0).alias("start"), "duration")
    bounds = first.unionByName(inner.select(*keys, "start", "duration"))
    bounds = neighbours(bounds, keys, ["start"], block_of(F.col("start"), width), F.col("start"), nxt="_next")
    segs = bounds.withColumn("end", F.coalesce("_next", "duration"))
    segs = segs.filter(F.col("end") - F.col("start") >= min_len * SHORTEST_SHARE).select(*keys, "start", "end")
    segs = stage(dense_index(segs, keys, ["start"], block_of(F.col("start"), width), "idx"))
    whole = (durations.join(segs.select(*keys).distinct(), keys, "left_anti")
             .select(*keys, F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.lit(0).cast("long").alias("idx")))
    return segs.select(*keys, "idx", "start", "end").unionByName(whole.select(*keys, "idx", "start", "end"))


def detect_shots(frames: DataFrame, durations: DataFrame, sensitivity: float = 1.0, min_shot: float = 0.35,
                 keys=("series_id",), pos="n", time="t", value="v", width: int = BLOCK,
                 time_width: float = TIME_BLOCK) -> DataFrame:
    """Per-frame values to shot segments."""
    scores = stage(change_score(frames, keys, pos, value, width).select(*keys, pos, time, "score"))
    level = robust_threshold(scores, keys, sensitivity=sensitivity)
    cuts = stage(debounce(prominent_peaks(scores, level, keys, pos, width=width), min_shot, keys, time))
    return boundaries_to_segments(cuts, durations, min_shot, keys, time, time_width, "len")


def durations_of(frames: DataFrame, keys=("series_id",), time="t") -> DataFrame:
    return frames.groupBy(*keys).agg(F.max(time).alias("duration"), F.count(F.lit(1)).alias("len"))


def mirrored(df: DataFrame, size: int, keys=("series_id",), pos="n") -> DataFrame:
    """Add the reflected rows that a centred filter of ``size`` reads beyond both ends.

    Positions -1, -2 … repeat rows 0, 1 …; positions N, N+1 … repeat rows N-1, N-2 ….
    Only rows near an end are copied; short series are reflected repeatedly.
    """
    keys, back, ahead = list(keys), size // 2, size - 1 - size // 2
    n, total = F.col(pos), F.col("len")
    d = df.join(lengths(df, keys, pos), keys)
    reach = max(back, ahead)
    turns = F.ceil(F.lit(reach) / (2.0 * total)).cast("long")
    at_edge = (n < reach) | (n >= total - reach)
    ks = F.when(at_edge, F.sequence(-turns, turns)).otherwise(F.array(F.lit(0).cast("long")))
    spots = F.flatten(F.transform(ks, lambda k: F.array(n + 2 * total * k, -1 - n + 2 * total * k)))
    spots = F.filter(spots, lambda p: (p >= -back) & (p < total + ahead))
    return d.withColumn("_at", F.explode(F.array_distinct(spots))).withColumn("_real", F.col("_at") == n)


def smooth(df: DataFrame, size: int, keys=("series_id",), pos="n", value="v", name="smooth",
           width: int = BLOCK) -> DataFrame:
    """Uniform filter over ``size`` rows with reflected ends."""
    back, ahead = size // 2, size - 1 - size // 2
    m = mirrored(df, size, keys, pos).withColumn("_at", F.col("_at") + back)
    out = framed(m, list(keys), "_at", back, ahead,
                 {name: lambda w: F.avg(value).over(w.rowsBetween(-back, ahead))}, width)
    return out.filter("_real").drop("_at", "_real", "len")


def energy_curve(samples: DataFrame, bucket: float = 0.1, keys=("series_id",), time="t", value="v",
                 time_width: float = TIME_BLOCK, size: int = 5, width: int = BLOCK) -> DataFrame:
    """Level per time bucket, scaled between its 5th and 98th percentile and smoothed."""
    keys = list(keys)
    b = F.floor(F.col(time) / bucket).cast("long")
    rms = F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-12)
    levels = samples.groupBy(*keys, b.alias("bucket")).agg((20 * F.log10(rms + 1e-9)).alias("db"))
    levels = stage(dense_index(levels, keys, ["bucket"], block_of(F.col("bucket") * bucket, time_width)))
    ends = quantiles(levels, keys, F.col("db"), {"lo": 0.05, "hi": 0.98})
    scaled = levels.join(ends, keys).withColumn(
        "level", clip((F.col("db") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)), 0, 1))
    out = smooth(scaled, size, keys, "n", "level", "energy", width)
    return out.select(*keys, "n", (F.col("bucket") * bucket).alias("t"), "energy")


def runs(df: DataFrame, hit: Column, keys=("series_id",), pos="n", time="t", width: int = BLOCK) -> DataFrame:
    """Maximal runs of rows where ``hit`` holds: first time, last time, the time after (null at the end), rows."""
    keys = list(keys)
    d = framed(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), keys, pos, 1, 1, {
        "_new": lambda w: F.col("_hit") & ~F.coalesce(F.lag("_hit").over(w), F.lit(False)),
        "_after": lambda w: F.lead(time).over(w),
    }, width)
    d = running(d, keys, [pos], block_of(F.col(pos), width), {"run": ("sum", F.col("_new").cast("long"))})
    last = F.max_by(F.struct(F.col(time).alias("t"), F.col("_after").alias("next")), F.col(pos))
    return (d.filter("_hit").groupBy(*keys, "run")
             .agg(F.min(time).alias("start"), last.alias("_l"), F.count(F.lit(1)).alias("rows"))
             .select(*keys, "run", "start", F.col("_l.t").alias("last"), F.col("_l.next").alias("after"), "rows"))


def low_runs(df: DataFrame, durations: DataFrame, below: float = QUIET_BELOW, longer_than: float = QUIET_MIN,
             keys=("series_id",), pos="n", time="t", value="v", width: int = BLOCK) -> DataFrame:
    """Quiet stretches.  One still open at the end of the series is kept whatever its length."""
    keys = list(keys)
    r = runs(df, F.col(value) < below, keys, pos, time, width).join(durations.select(*keys, "duration"), keys)
    r = r.filter(F.col("after").isNull() | (F.col("after") - F.col("start") > longer_than))
    return r.select(*keys, "start", F.coalesce("after", "duration").alias("end"))


def mask_to_windows(df: DataFrame, mask: Column, hop: float, keys=("series_id",), pos="n",
                    width: int = BLOCK) -> DataFrame:
    """Runs of a per-frame mask as time windows; the end is the frame after the run."""
    r = runs(df, mask, keys, pos, pos, width)
    return r.select(*keys, (F.col("start") * hop).alias("w_start"), ((F.col("last") + 1) * hop).alias("w_end"))


def merge_gaps(windows: DataFrame, gap: float = MERGE_GAP, keys=("series_id",), start="w_start", end="w_end",
               width: float = TIME_BLOCK) -> DataFrame:
    """Join windows that overlap or lie within ``gap`` of each other."""
    keys = list(keys)
    d = windows.select(*keys, F.col(start).alias("s"), F.col(end).alias("e"))
    block = block_of(F.col("s"), width)
    d = running(d, keys, ["s", "e"], block, {"_reach": ("max", F.col("e"))}, inclusive=False)
    fresh = F.when(F.col("_reach").isNull() | (F.col("s") - F.col("_reach") > gap), 1).otherwise(0).cast("long")
    d = running(d, keys, ["s", "e"], block, {"_g": ("sum", fresh)})
    return d.groupBy(*keys, "_g").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("_g")


def min_length(windows: DataFrame, shortest: float = MIN_WINDOW, start="w_start", end="w_end") -> DataFrame:
    return windows.filter(F.col(end) - F.col(start) >= shortest)


def window_fraction(windows: DataFrame, durations: DataFrame, keys=("series_id",), start="w_start",
                    end="w_end") -> DataFrame:
    """Share of each series that its windows cover."""
    keys = list(keys)
    total = windows.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("_c"), F.count(F.lit(1)).alias("_w"))
    share = F.when(F.col("duration") > 0, F.coalesce("_c", F.lit(0.0)) / F.col("duration")).otherwise(0.0)
    return durations.join(total, keys, "left").select(
        *keys, F.coalesce("_w", F.lit(0)).alias("windows"), share.alias("fraction"))


def resample_array(curve: Column, n: Column | int) -> Column:
    """Linear interpolation of an array to ``n`` points; empty gives .5, one value repeats."""
    n = n if isinstance(n, Column) else F.lit(n)
    size = F.coalesce(F.size(curve), F.lit(0))

    def at(i):
        x = i * (size - 1) / F.greatest(n - 1, F.lit(1))
        lo = F.floor(x).cast("int")
        hi = F.least(lo + 1, size - 1)
        f = x - lo
        return F.get(curve, lo) * (1 - f) + F.get(curve, hi) * f

    spots = F.sequence(F.lit(0), n - 1)
    return (F.when(size <= 0, F.transform(spots, lambda i: F.lit(0.5)))
             .when(size == 1, F.transform(spots, lambda i: F.get(curve, F.lit(0))))
             .otherwise(F.transform(spots, at)))


def resample_linear(series: DataFrame, points: int, keys=("series_id",), pos="n", value="v",
                    width: int = BLOCK) -> DataFrame:
    """As ``resample_array`` for a long table: each grid point reads the two rows it lies between.

    Every grid point is produced by the row at its lower neighbour, so there is no join.
    """
    keys = list(keys)
    d = series.join(lengths(series, keys, pos), keys)
    d = framed(d, keys, pos, 0, 1, {"_next": lambda w: F.lead(value).over(w)}, width)
    last, step = F.col("len") - 1, F.lit(max(points - 1, 1))
    p, v = F.col(pos), F.col(value)
    first_i = F.ceil(p * step / F.greatest(last, F.lit(1))).cast("long")
    next_i = F.ceil((p + 1) * step / F.greatest(last, F.lit(1))).cast("long")
    stop = F.when((p == last) | (F.col("len") == 1), F.lit(points - 1)).otherwise(
        F.least(next_i - 1, F.lit(points - 1))).cast("long")
    begin = F.when(F.col("len") == 1, F.lit(0)).otherwise(first_i).cast("long")
    d = d.filter(begin <= stop).withColumn("i", F.explode(F.sequence(begin, stop)))
    x = F.when(F.col("len") == 1, F.lit(0.0)).otherwise(F.col("i") * last / step)
    f = x - p
    out = F.when(F.col("len") == 1, v).otherwise(v * (1 - f) + F.coalesce(F.col("_next"), v) * f)
    return d.select(*keys, "i", out.alias("value"))


def time_grid(durations: DataFrame, points: int, keys=("series_id",)) -> DataFrame:
    """``points`` evenly spaced times from 0 to the duration of every key."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    d = durations.select(*keys, "duration", i.alias("i"))
    return d.withColumn("g", F.col("i") * F.col("duration") / F.lit(points - 1)).withColumn("i", F.col("i").cast("long"))


def kernel_density(points_df: DataFrame, durations: DataFrame, grid: int, sigma: float = 0.6, keys=("series_id",),
                   time="t", name="density") -> DataFrame:
    """Gaussian bumps at the points, summed on a grid of ``grid`` times, divided by their maximum.

    The grid is a bounded set of expressions: each partition adds its points to the
    ``grid`` sums of the key, so no pair of point and grid time is ever produced.
    """
    keys = list(keys)
    d = points_df.select(*keys, F.col(time).alias("_t")).join(durations.select(*keys, "duration"), keys)
    bumps = [F.sum(F.exp(-F.pow(F.col("duration") * F.lit(i) / F.lit(grid - 1) - F.col("_t"), 2)
                         / F.lit(2 * sigma * sigma))).alias(f"_{i}") for i in range(grid)]
    sums = d.groupBy(*keys).agg(*bumps).select(*keys, F.array(*[F.col(f"_{i}") for i in range(grid)]).alias("_a"))
    flat = durations.select(*keys, "duration").join(sums, keys, "left")
    empty = F.array_repeat(F.lit(0.0), grid)
    flat = flat.withColumn("_a", F.coalesce(F.col("_a"), empty)).withColumn("_top", F.array_max("_a"))
    scale = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return flat.withColumn("_top", scale).select(*keys, "duration", F.transform("_a", lambda x: x / F.col("_top")).alias(name))


def interpolate(grid: DataFrame, samples: DataFrame, keys=("series_id",), at="g", time="t", value="v",
                width: float = TIME_BLOCK, name="value") -> DataFrame:
    """Value of a sampled series at given times, linear between samples, flat beyond the ends."""
    keys = list(keys)
    d = asof(grid, samples, keys, at, time, [value], "both", width)
    bt, ft, bv, fv = (F.col(c) for c in (f"b_{time}", f"f_{time}", f"b_{value}", f"f_{value}"))
    span = ft - bt
    y = (F.when(bt.isNull(), fv).when(ft.isNull() | (span == 0), bv)
          .otherwise(bv + (fv - bv) * (F.col(at) - bt) / span))
    return d.withColumn(name, y).drop(f"b_{time}", f"f_{time}", f"b_{value}", f"f_{value}")

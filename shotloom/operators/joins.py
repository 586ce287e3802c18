"""Matching by time and by interval, plus the simple keyed matches.

Range and nearest matches never use a join without an equality: they run on the
series key plus a time bin, or as one ordered pass (``asof``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .blocks import TIME_BLOCK, asof, block_of, running

NO_ENERGY = 0.5
SPEECH_MIN = 0.25

# Fixed boundaries of the role by share of the running time, used where a style has no arc.
ROLE_SHARES = (("hook", 0.12), ("setup", 0.45), ("escalation", 0.75), ("climax", 0.92))
LAST_ROLE = "release"


def look_up(df: DataFrame, dim: DataFrame, on, how: str = "left") -> DataFrame:
    """Equality match.  The planner broadcasts ``dim`` when its statistics allow it."""
    return df.join(dim, on, how)


def allowed(df: DataFrame, allowed_keys: DataFrame | None, banned_keys: DataFrame | None, on) -> DataFrame:
    """Keep rows on the allowed list, drop rows on the banned list."""
    out = df if allowed_keys is None else df.join(allowed_keys, on, "left_semi")
    return out if banned_keys is None else out.join(banned_keys, on, "left_anti")


def energy_at(probes: DataFrame, curve: DataFrame, keys=("series_id",), at="at", time="t", value="energy",
              width: float = TIME_BLOCK, name="energy_at") -> DataFrame:
    """First curve value at or after the probe, else the last one, else a neutral value."""
    keys = list(keys)
    last = curve.groupBy(*keys).agg(F.max_by(value, time).alias("_last"))
    d = asof(probes, curve, keys, at, time, [value], "forward", width).join(last, keys, "left")
    return d.withColumn(name, F.coalesce(f"s_{value}", "_last", F.lit(NO_ENERGY))).drop(f"s_{time}", f"s_{value}", "_last")


def nearest_beat(probes: DataFrame, beats: DataFrame, keys=("series_id",), at="cut", beat="beat",
                 width: float = TIME_BLOCK, name="nearest") -> DataFrame:
    """Closest beat, the earlier one on ties; the probe itself where there is none."""
    d = asof(probes, beats, list(keys), at, beat, (), "nearest", width)
    return d.withColumn(name, F.coalesce(f"s_{beat}", at)).drop(f"s_{beat}")


def snap_within(probes: DataFrame, beats: DataFrame, tolerance: Column | float, keys=("series_id",), at="cut",
                beat="beat", width: float = TIME_BLOCK, name="snapped") -> DataFrame:
    """Closest beat when it is nearer than ``tolerance``, else the probe unchanged."""
    tol = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    d = nearest_beat(probes, beats, keys, at, beat, width, name)
    return d.withColumn(name, F.when(F.abs(F.col(name) - F.col(at)) < tol, F.col(name)).otherwise(F.col(at)))


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(block_of(start, width), block_of(end, width)))


def points_in(intervals: DataFrame, points: DataFrame, keys=("series_id",), start="w_start", end="w_end", time="beat",
              bin_width: float = 3600.0) -> DataFrame:
    """Every point inside every interval, both ends included.

    ``bin_width`` should be near the usual interval length; each interval is copied
    once per bin it touches and meets only the points of that bin.
    """
    keys = list(keys)
    a = intervals.withColumn("_bin", _bins(F.col(start), F.col(end), bin_width))
    b = points.withColumn("_bin", block_of(F.col(time), bin_width))
    return a.join(b, [*keys, "_bin"]).filter(F.col(time).between(F.col(start), F.col(end))).drop("_bin")


def count_in(intervals: DataFrame, points: DataFrame, keys=("series_id",), start="w_start", end="w_end", time="beat",
             width: float = TIME_BLOCK, name="hits") -> DataFrame:
    """Points per interval from two running counts, so no (interval, point) pair is produced."""
    keys = list(keys)
    cols = [c for c in intervals.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in cols])
    # 0: interval start (before equal points), 1: point, 2: interval end (after equal points)
    ends = F.array(F.struct(F.col(start).alias("t"), F.lit(0).alias("o")), F.struct(F.col(end).alias("t"), F.lit(2).alias("o")))
    probes = intervals.select(*keys, row.alias("_row"), F.explode(ends).alias("_e")).select(
        *keys, F.col("_e.t").alias("_t"), F.col("_e.o").alias("_o"), "_row")
    pts = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_o"))
    both = probes.unionByName(pts, allowMissingColumns=True)
    one = F.when(F.col("_o") == 1, 1).otherwise(0).cast("long")
    d = running(both, keys, ["_t", "_o"], block_of(F.col("_t"), width), {"_n": ("sum", one)}).filter("_o <> 1")
    sign = F.when(F.col("_o") == 2, F.col("_n")).otherwise(-F.col("_n"))
    return d.groupBy(*keys, "_row").agg(F.sum(sign).alias(name)).select(*keys, "_row.*", name)


def near_any(probes: DataFrame, marks: DataFrame, distance: float, keys=("series_id",), at="cut", mark="drop_t",
             width: float = TIME_BLOCK, name="near") -> DataFrame:
    """Whether some mark lies nearer than ``distance``."""
    d = asof(probes, marks, list(keys), at, mark, (), "nearest", width)
    return d.withColumn(name, F.coalesce(F.abs(F.col(f"s_{mark}") - F.col(at)) < distance, F.lit(False))).drop(f"s_{mark}")


def overlap_pairs(clips: DataFrame, windows: DataFrame, keys=("series_id",), clip=("c_in", "c_out"),
                  window=("w_start", "w_end"), bin_width: float = 3600.0) -> DataFrame:
    """Clip and window rows that share time, each pair once, with the shared ``overlap``."""
    keys = list(keys)
    (ci, co), (ws, we) = clip, window
    a = clips.withColumn("_bin", _bins(F.col(ci), F.col(co), bin_width))
    b = windows.filter(F.col(we) > F.col(ws)).withColumn("_bin", _bins(F.col(ws), F.col(we), bin_width))
    shared = F.least(we, co) - F.greatest(ws, ci)
    first_bin = F.greatest(block_of(F.col(ci), bin_width), block_of(F.col(ws), bin_width))
    return (a.join(b, [*keys, "_bin"]).filter((shared > 0) & (F.col("_bin") == first_bin))
             .withColumn("overlap", shared).drop("_bin"))


def speech_overlap(clips: DataFrame, windows: DataFrame, keys=("series_id",), clip_id="clip_id", clip=("c_in", "c_out"),
                   window=("w_start", "w_end"), least: float = SPEECH_MIN, bin_width: float = 3600.0) -> DataFrame:
    """Seconds of speech inside each clip; clips with less than ``least`` are left out."""
    pairs = overlap_pairs(clips, windows, keys, clip, window, bin_width)
    return pairs.groupBy(*keys, clip_id).agg(F.sum("overlap").alias("overlap")).filter(F.col("overlap") >= least)


def has_speech(clips: DataFrame, windows: DataFrame, keys=("series_id",), clip_id="clip_id", clip=("c_in", "c_out"),
               window=("w_start", "w_end"), more_than: float = SPEECH_MIN, bin_width: float = 3600.0) -> DataFrame:
    """Flag clips where one single window shares more than ``more_than`` seconds."""
    hit = (overlap_pairs(clips, windows, keys, clip, window, bin_width).filter(F.col("overlap") > more_than)
           .select(*keys, clip_id).distinct().withColumn("speech", F.lit(True)))
    return clips.join(hit, [*keys, clip_id], "left").withColumn("speech", F.coalesce("speech", F.lit(False)))


def role_at(t: Column, total: Column, arc: Column, arc_duration: Column) -> Column:
    """Role of a moment in an edit of length ``total``.

    ``arc`` is an array of (role, start, end) over ``arc_duration``; it is stretched to
    ``total``, and its last role also covers what lies outside.  Without an arc the
    role follows fixed shares of the running time.
    """
    scale = total / arc_duration
    inside = F.filter(arc, lambda s: (s["start"] * scale <= t) & (t < s["end"] * scale))
    share = t / F.greatest(total, F.lit(1e-6))
    fixed = None
    for role, below in ROLE_SHARES:
        fixed = F.when(share < below, role) if fixed is None else fixed.when(share < below, role)
    fixed = fixed.otherwise(LAST_ROLE)
    has_arc = (F.coalesce(F.size(arc), F.lit(0)) > 0) & (arc_duration > 0)
    return F.when(has_arc, F.coalesce(F.get(inside, 0)["role"], F.get(arc, F.size(arc) - 1)["role"])).otherwise(fixed)

"""Profile of an edit (pacing, transitions, intensity, arc), blending and the style table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.maths import clip
from ..session import stage
from . import series as S
from .blocks import TIME_BLOCK, asof, framed, framed_time, lengths, quantiles
from .joins import nearest_beat
from .series import resample_array

# Fixed values of the profile.
GRAMMAR_VERSION = "1.0.0"
FAST_WINDOW = 2.0
BINS = 8
SAMPLES = 12
SHOT_FLOOR = 0.12
LEAKY = ("source_path", "path", "reference_path")
CURVE_POINTS = 64
DENSITY_SHARE, MOTION_SHARE = 0.62, 0.38


def pacing_profile(shots: DataFrame, durations: DataFrame, keys=("style_id",)) -> DataFrame:
    """Cut rate and shot-length statistics per edit (shots: start, end; durations: duration)."""
    keys = list(keys)
    d = F.col("end") - F.col("start")
    q = quantiles(shots, keys, d, {"median_shot": 0.5, "p10_shot": 0.1, "p90_shot": 0.9})
    a = shots.groupBy(*keys).agg(F.count(F.lit(1)).alias("shots"), F.avg(d).alias("mean_shot"), F.stddev_pop(d).alias("shot_std"))
    rate = F.greatest(F.col("shots") - 1, F.lit(0)) / F.greatest("duration", F.lit(1e-6))
    return a.join(q, keys).join(durations.select(*keys, "duration"), keys).withColumn("cuts_per_second", rate)


def rhythm_class(shots: DataFrame, keys=("style_id",), pos="idx") -> DataFrame:
    """steady, bursty, accelerating or decelerating from the spread and the two halves."""
    keys = list(keys)
    d = F.col("end") - F.col("start")
    x = shots.join(lengths(shots, keys, pos), keys)
    early = F.col(pos) < F.floor(F.col("len") / 2)
    a = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(d).alias("s"), F.avg(d).alias("m"),
                             F.avg(F.when(early, d)).alias("a"), F.avg(F.when(~early, d)).alias("b"))
    kind = (F.when(F.col("n") < 4, "steady").when(F.col("s") / F.greatest("m", F.lit(1e-6)) > 0.85, "bursty")
             .when(F.col("b") < F.col("a") * 0.72, "accelerating").when(F.col("b") > F.col("a") * 1.38, "decelerating")
             .otherwise("steady"))
    return a.select(*keys, kind.alias("rhythm"))


def fastest_window(shots: DataFrame, span: float = FAST_WINDOW, keys=("style_id",), width: float = TIME_BLOCK) -> DataFrame:
    """Earliest start from which most shots start within ``span`` seconds; edits of over two shots only."""
    keys = list(keys)
    d = framed_time(shots.select(*keys, "start"), keys, "start", 0.0, span, {
        "_in": lambda w: F.count("start").over(w.rangeBetween(0, round(span * 1e6) - 1))}, width)
    best = F.max_by(F.struct("start", "_in"), F.struct(F.col("_in"), -F.col("start")))
    return (d.groupBy(*keys).agg(best.alias("_b"), F.count(F.lit(1)).alias("_n")).filter("_n > 2")
             .select(*keys, F.col("_b.start").alias("w_start"), (F.col("_b.start") + span).alias("w_end"), F.col("_b._in").alias("starts")))


def duration_histogram(shots: DataFrame, bins: int = BINS, least_top: float = 2.0, keys=("style_id",)) -> DataFrame:
    """Shot lengths in equal bins from 0 to the longest (at least ``least_top``), empty bins included."""
    keys = list(keys)
    d = F.col("end") - F.col("start")
    top = shots.groupBy(*keys).agg(F.greatest(F.max(d), F.lit(least_top)).alias("_top"))
    b = F.least(F.floor(d / F.col("_top") * bins), F.lit(bins - 1))
    counts = [F.count(F.when(b == i, 1)).alias(f"_{i}") for i in range(bins)]
    h = shots.join(top, keys).groupBy(*keys).agg(*counts)
    return h.select(*keys, F.posexplode(F.array(*[F.col(f"_{i}") for i in range(bins)])).alias("bin", "shots"))


def sample_every(shots: DataFrame, wanted: int = SAMPLES, keys=("style_id",), pos="idx") -> DataFrame:
    """At most ``wanted`` rows per key, evenly stepped from the first: the sample the profile looks at."""
    keys = list(keys)
    d = shots.join(lengths(shots, keys, pos), keys)
    step = F.greatest(F.lit(1), F.floor(F.col("len") / wanted))
    return d.filter((F.col(pos) % step == 0) & (F.floor(F.col(pos) / step) < wanted)).drop("len")


COLOUR_MEANS = {"brightness": "brightness", "contrast": "contrast", "saturation": "saturation", "warmth": "warmth",
                "colorfulness": "colorfulness", "black_level": "clipped_shadows", "highlight_level": "clipped_highlights"}


def motion_color_profile(shots: DataFrame, keys=("style_id",), top: int = 4) -> DataFrame:
    """Means over the sampled shots, the most common moves with their shares, the usual light key."""
    keys = list(keys)
    a = shots.groupBy(*keys).agg(
        F.avg("flow_magnitude").alias("mean_flow"), F.var_pop("flow_magnitude").alias("motion_variance"),
        F.avg("zoom_rate").alias("zoom_tendency"), F.avg("shake").alias("shake_level"),
        *[F.avg(src).alias(name) for name, src in COLOUR_MEANS.items()], F.count(F.lit(1)).alias("_n"))

    def counted(col):
        return shots.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))

    moves = counted("camera_movement").groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct((-F.col("_c")).alias("o"), F.col("camera_movement").alias("m"), F.col("_c").alias("c")))).alias("_m"))
    light = counted("light_key").groupBy(*keys).agg(F.min_by("light_key", F.struct(-F.col("_c"), F.col("light_key"))).alias("light_key"))
    d = a.join(moves, keys).join(light, keys)
    return d.withColumn("moves", F.transform(F.slice("_m", 1, top), lambda x: F.struct(x["m"].alias("move"), (x["c"] / F.col("_n")).alias("share")))).drop("_m", "_n")


def transition_kind(cuts: DataFrame, samples: DataFrame, keys=("series_id",), cut="cut", pos="n", time="t", score="score",
                    luma="luma", reach: int = 3, width: float = TIME_BLOCK) -> DataFrame:
    """Kind of each cut from how change and light are spread over the samples around it."""
    keys = list(keys)
    base = quantiles(samples, keys, F.col(score), {"med_s": 0.5, "hi_s": 0.99}).join(
        quantiles(samples, keys, F.col(luma), {"base_l": 0.5}), keys)
    near = framed(samples, keys, pos, reach, reach, {
        "_s": lambda w: F.collect_list(score).over(w.rowsBetween(-reach, reach)),
        "_l": lambda w: F.collect_list(luma).over(w.rowsBetween(-reach, reach))})
    d = asof(cuts, near.select(*keys, time, "_s", "_l"), keys, cut, time, ["_s", "_l"], "nearest", width).join(base, keys)
    s, lum = F.col("s__s"), F.col("s__l")
    d = d.withColumns({"_peak": F.array_max(s), "_sum": F.aggregate(s, F.lit(0.0), lambda a, x: a + x), "_lmax": F.array_max(lum)})
    d = d.withColumn("_at", F.array_position(lum, F.col("_lmax")) - 1)
    med = F.when(F.col("med_s") == 0, 1e-6).otherwise(F.col("med_s"))
    ratio = F.col("_peak") / (F.col("_sum") + 1e-9)
    high = F.size(F.filter(s, lambda x: x > med * 1.5))
    spike = ((F.col("_at") > 0) & (F.col("_at") < F.size(lum) - 1)
             & (F.col("_lmax") > F.greatest(F.get(lum, F.lit(0)), F.get(lum, F.size(lum) - 1)) * 1.35)
             & (F.col("_lmax") > F.col("base_l") * 1.4) & (F.col("_lmax") > 150))
    kind = (F.when(s.isNull() | (F.size(s) < 3), "cut").when(spike, "flash")
             .when((F.col("_peak") > F.col("hi_s")) & (ratio > 0.45), "whip")
             .when((ratio < 0.34) & (high >= 4) & (F.col("_peak") < F.col("hi_s")), "dissolve").otherwise("cut"))
    return d.select(*cuts.columns, kind.alias("kind"))


def transition_shares(kinds: DataFrame, keys=("series_id",)) -> DataFrame:
    def share(k):
        return F.avg((F.col("kind") == k).cast("double"))
    a = kinds.groupBy(*keys).agg(share("cut").alias("hard_cut_share"), share("flash").alias("flash_share"),
                                 share("whip").alias("whip_share"), share("dissolve").alias("dissolve_share"))
    return a.withColumn("mean_transition_duration", F.when(F.col("hard_cut_share") == 1.0, 0.0).otherwise(0.12))


def smooth_array(a: Column, size: int) -> Column:
    """Uniform filter of a bounded array with reflected ends."""
    n = F.size(a)

    def at(p):
        m = F.pmod(p, 2 * n)
        return F.get(a, F.when(m < n, m).otherwise(2 * n - 1 - m))

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: sum((at(i + o) for o in range(-(size // 2) + 1, size - size // 2)),
                                                                at(i - size // 2)) / size)


def intensity_curve(starts: DataFrame, samples: DataFrame, durations: DataFrame, points: int = CURVE_POINTS, keys=("series_id",),
                    start="start", pos="n", time="t", score="score", sigma: float = 0.6, width: float = TIME_BLOCK,
                    final: int | None = 3) -> DataFrame:
    """Cut density and smoothed motion combined on an even grid: one array per key."""
    keys = list(keys)
    density = S.kernel_density(starts, durations, points, sigma, keys, start)
    moving = stage(S.smooth(samples, 8, keys, pos, score, "_m").select(*keys, time, "_m"))
    on_grid = S.interpolate(S.time_grid(durations, points, keys), moving, keys, "g", time, "_m", width, "_y")
    arr = on_grid.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "_y"))),
                                                 lambda x: F.coalesce(x["_y"], F.lit(0.0))).alias("_y"))
    d = density.join(arr, keys).withColumn("_top", F.array_max("_y"))
    d = d.withColumn("_top", F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0))
    mixed = F.zip_with("density", "_y", lambda a, b: clip(DENSITY_SHARE * a + MOTION_SHARE * b / F.col("_top"), 0, 1))
    d = d.withColumn("curve", mixed)
    if final:
        d = d.withColumn("curve", smooth_array(F.col("curve"), final))
    return d.select(*keys, "duration", "curve")


def argmax(a: Column) -> Column:
    """First index of the largest value, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def segment_structure(curves: DataFrame, keys=("series_id",), curve="curve") -> DataFrame:
    """Roles read off the shape of the curve: hook, setup, escalation, climax, release."""
    dur = F.col("duration")
    d = curves.withColumn("_peak", argmax(F.col(curve)) * dur / (F.size(curve) - 1)).withColumn("_hook", F.least(dur * 0.15, F.lit(2.0)))
    peak, hook = F.col("_peak"), F.col("_hook")
    late = peak > hook + 0.5
    mid = hook + (peak - hook) * 0.45
    rise_end = F.when(late, peak).otherwise(F.greatest(hook + 0.5, peak))
    end = F.least(dur, peak + F.greatest(F.lit(1.0), dur * 0.2))

    def seg(role, a, b):
        return F.struct(F.lit(role).alias("role"), a.alias("start"), b.alias("end"))

    parts = F.array(seg("hook", F.lit(0.0), hook), F.when(late, seg("setup", hook, mid)),
                    seg("escalation", F.when(late, mid).otherwise(hook), rise_end), seg("climax", F.greatest(peak, rise_end), end),
                    F.when(end < dur - 0.2, seg("release", end, dur)))
    keep = F.filter(parts, lambda s: s.isNotNull() & (s["end"] > s["start"] + 0.05))
    return d.select(*keys, "duration", F.when(dur > 0, keep).otherwise(F.slice(keep, 1, 0)).alias("structure"))


def effect_density(hard_cut_share: Column, motion_variance: Column) -> Column:
    return clip(0.5 * (1 - hard_cut_share) + 0.5 * F.least(F.lit(1.0), motion_variance / 2.0), 0, 1)


def beat_sync_strength(starts: DataFrame, beats: DataFrame, keys=("series_id",), start="start", beat="beat",
                       width: float = TIME_BLOCK, scale: float = 0.25) -> DataFrame:
    """1 when every cut lies on a beat, 0 at a mean miss of ``scale`` seconds.  ``starts`` leaves out the first shot."""
    keys = list(keys)
    d = nearest_beat(starts.join(beats.select(*keys).distinct(), keys, "left_semi"), beats, keys, start, beat, width, "_b")
    return d.groupBy(*keys).agg(clip(1.0 - F.avg(F.abs(F.col("_b") - F.col(start))) / scale, 0, 1).alias("beat_sync"))


def intensity_at(curve: Column, share: Column) -> Column:
    """Curve value at a share 0..1 of the running time; .5 without a curve."""
    i = F.floor(clip(share, 0, 1) * (F.size(curve) - 1)).cast("int")
    return F.when(F.coalesce(F.size(curve), F.lit(0)) > 0, F.get(curve, i)).otherwise(0.5)


def target_shot_duration(intensity: Column, p10: Column, p90: Column, pacing: Column | float = 1.0) -> Column:
    """Shorter shots for more intensity, inside the range of the style."""
    m = F.greatest(F.lit(0.35), pacing if isinstance(pacing, Column) else F.lit(float(pacing)))
    lo = F.greatest(F.lit(SHOT_FLOOR), F.coalesce(F.nullif(p10, F.lit(0.0)), F.lit(0.3)) * m)
    hi = F.greatest(lo + 0.05, F.coalesce(F.nullif(p90, F.lit(0.0)), F.lit(1.2)) * m)
    return hi - (hi - lo) * clip(intensity, 0, 1)


def version_gate(df: DataFrame, version: str = GRAMMAR_VERSION, col: str = "version") -> tuple[DataFrame, DataFrame]:
    """Rows of this version, and the refused ones.  An empty version is accepted."""
    ok = F.coalesce(F.col(col), F.lit("")).isin("", version)
    return df.filter(ok), df.filter(~ok)


SHARES = ("hard_cut_share", "flash_share", "whip_share", "dissolve_share")


def blend_styles(styles: DataFrame, weights: DataFrame, means: Sequence[str], labels: Sequence[str] = ("rhythm", "light_key"),
                 carried: Sequence[str] = ("structure",), on: str = "style_id", blend: str = "blend_id", top_moves: int = 5) -> DataFrame:
    """Weighted mixture of the styles of each blend (weights: blend_id, style_id, weight).

    Numbers are weighted means, names go to the largest total weight, transition shares
    are rescaled to sum to 1, curves are brought to the longest, whole parts come from
    the heaviest style.  A blend of one style keeps its values.
    """
    d = weights.filter(F.col("weight") > 0).join(styles, on)
    w = F.col("weight").cast("double")
    heavy = F.struct(w, -F.col(on))
    has = set(styles.columns)
    one = F.count(F.lit(1)) == 1
    aggs = [F.when(one, F.max(m)).otherwise(F.sum(F.col(m) * w) / F.sum(w)).alias(m) for m in means]
    aggs += [F.max_by(c, heavy).alias(c) for c in carried if c in has]
    aggs += [F.count(F.lit(1)).alias("sources"), F.sum(w).alias("_w")]
    if "intensity_curve" in has:
        aggs.append(F.max(F.size("intensity_curve")).alias("_n"))
    out = d.groupBy(blend).agg(*aggs)
    for label in labels:
        votes = d.groupBy(blend, label).agg(F.sum(w).alias("_v"), F.max(heavy).alias("_h"))
        win = votes.groupBy(blend).agg(F.max_by(label, F.struct("_v", "_h")).alias(label), (F.count(F.lit(1)) > 1).alias(f"{label}_disagreed"))
        out = out.join(win, blend)
    if "intensity_curve" in has:
        n = F.when(F.col("_n") > 0, F.col("_n")).otherwise(16)
        pts = d.join(out.select(blend, "_n", "_w"), blend).select(
            blend, "_w", w.alias("weight"), F.posexplode(resample_array(F.col("intensity_curve"), n)).alias("i", "x"))
        pts = pts.groupBy(blend, "i").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
        curve = pts.groupBy(blend).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("intensity_curve"))
        out = out.join(curve, blend).drop("_n")
    if "moves" in has:
        mv = d.select(blend, w.alias("weight"), F.explode("moves").alias("m")).groupBy(blend, F.col("m.move").alias("move")).agg(
            F.sum(F.col("m.share") * F.col("weight")).alias("share"))
        ranked = mv.join(out.select(blend, "_w"), blend).groupBy(blend).agg(F.sort_array(F.collect_list(
            F.struct((-F.col("share") / F.col("_w")).alias("o"), F.col("move").alias("move")))).alias("_m"))
        ranked = ranked.select(blend, F.transform(F.slice("_m", 1, top_moves), lambda x: F.struct(x["move"].alias("move"), (-x["o"]).alias("share"))).alias("moves"))
        out = out.join(ranked, blend, "left")
    if all(s in means for s in SHARES):
        total = sum((F.col(s) for s in SHARES[1:]), F.col(SHARES[0]))
        out = out.withColumn("_t", F.when((total > 0) & (F.col("sources") > 1), total).otherwise(1.0)).withColumns(
            {s: F.col(s) / F.col("_t") for s in SHARES}).drop("_t")
    return out.drop("_w")


def slug(name: Column) -> Column:
    """File-safe name: lower case, runs of other characters become one dash, no dashes at the ends."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9_-]+", "-")
    return F.regexp_replace(s, "^-+|-+$", "")


def save_styles(stored: DataFrame, new: DataFrame, name: str = "label") -> DataFrame:
    """The style table after saving ``new``: rows of the same slug are replaced, source paths are never kept.

    The latest row of a slug inside ``new`` is the one with the largest ``saved_at``.
    """
    n = new.withColumn("slug", slug(F.col(name))).drop(*LEAKY)
    n = n.withColumn("slug", F.when(F.col("slug") == "", F.raise_error(F.lit("a style name needs a letter or digit"))).otherwise(F.col("slug")))
    rest = [c for c in n.columns if c != "slug"]
    n = n.groupBy("slug").agg(F.max_by(F.struct(*rest), F.col("saved_at")).alias("_r")).select("slug", "_r.*")
    return stored.join(n, "slug", "left_anti").unionByName(n, allowMissingColumns=True)


def delete_styles(stored: DataFrame, names: DataFrame, name: str = "label") -> DataFrame:
    return stored.join(names.select(slug(F.col(name)).alias("slug")), "slug", "left_anti")


def describe_styles(stored: DataFrame) -> DataFrame:
    text = F.format_string("%s: %.2f cuts/s, mean shot %.2fs, rhythm %s, cut share %.0f%%, key %s", "slug", "cuts_per_second",
                           "mean_shot", "rhythm", F.col("hard_cut_share") * 100, "light_key")
    return stored.select("slug", text.alias("summary"))

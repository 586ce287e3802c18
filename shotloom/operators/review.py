"""Critique of an edit, choice between candidates, coverage of a shot plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.maths import clip, lookup
from ..rules import delivery as D
from . import search as S
from .blocks import TIME_BLOCK, asof, framed
from .joins import nearest_beat
from .style import argmax, intensity_at, intensity_curve, target_shot_duration

c = F.col


def beat_alignment(cuts: DataFrame, beats: DataFrame, keys=("series_id",), at="cut", scale: float = 0.12, drift: float = 0.075, width: float = TIME_BLOCK) -> DataFrame:
    """Mean miss of the cuts from the beats, as a share 0..1 and as a drift flag."""
    keys = list(keys)
    d = nearest_beat(cuts.join(beats.select(*keys).distinct(), keys, "left_semi"), beats, keys, at, "beat", width, "_b")
    a = d.groupBy(*keys).agg(F.avg(F.abs(c("_b") - c(at))).alias("mean_error"))
    return a.withColumns({"alignment": clip(1.0 - c("mean_error") / scale, 0, 1), "beat_drift": c("mean_error") > drift})


def pacing_review(t: DataFrame) -> DataFrame:
    """Cut visibility and pacing against the (brief-scaled) target, with the directive each issue asks for.

    Columns: planned, detected, clips, duration, target_cps, pacing_multiplier.
    """
    cps = c("clips") / F.greatest("duration", F.lit(1e-6))
    goal = F.when(c("pacing_multiplier") > 0, c("target_cps") / c("pacing_multiplier")).otherwise(c("target_cps"))
    d = t.withColumns({"visibility": F.when(c("planned") > 0, c("detected") / F.greatest("planned", F.lit(1))), "cuts_per_second": cps, "goal_cps": goal})
    ratio = F.when(c("goal_cps") > 0, c("cuts_per_second") / c("goal_cps"))
    d = d.withColumns({"pacing_error": c("cuts_per_second") - c("goal_cps"), "_r": ratio})
    return d.withColumns({
        "indistinct": F.coalesce(c("visibility") < 0.75, F.lit(False)),
        "pacing_issue": F.when(c("_r") < 0.62, "too_slow").when(c("_r") > 1.6, "too_fast"),
        "factor": F.when(c("_r") < 0.62, F.least(F.lit(1.7), 1 / c("_r"))).when(c("_r") > 1.6, F.greatest(F.lit(0.6), 1 / c("_r")))}).drop("_r")


def luma_jumps(cuts: DataFrame, samples: DataFrame, keys=("series_id",), at="cut", pos="n", time="t", luma="luma", harsh: float = 62.0, width: float = TIME_BLOCK) -> DataFrame:
    """Brightness change across each cut, two samples either side, and whether too many are harsh."""
    keys = list(keys)
    d = framed(samples, keys, pos, 2, 2, {"_j": lambda w: F.abs(F.lead(luma, 2).over(w) - F.lag(luma, 2).over(w))})
    near = asof(cuts, d.select(*keys, time, "_j"), keys, at, time, ["_j"], "nearest", width).filter("s__j IS NOT NULL")
    a = near.groupBy(*keys).agg(F.avg("s__j").alias("mean_jump"), F.count(F.lit(1)).alias("cuts"), F.count(F.when(c("s__j") > harsh, 1)).alias("harsh"))
    return a.withColumn("harsh_issue", c("harsh") > F.greatest(F.lit(1.0), c("cuts") * 0.3))


def intensity_tracking(cuts: DataFrame, samples: DataFrame, durations: DataFrame, target: Column, points: int = 48, keys=("series_id",), start="cut",
                       score="score", sigma: float = 0.6, width: float = TIME_BLOCK) -> DataFrame:
    """Realised against wanted intensity on an even grid: level, error, peak places, mismatch flag."""
    keys = list(keys)
    d = intensity_curve(cuts, samples, durations, points, keys, start, score=score, sigma=sigma, width=width, final=None)
    d = d.withColumn("_goal", F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: intensity_at(target, i / F.lit(float(points - 1)))))
    gaps = F.zip_with("curve", "_goal", lambda a, b: F.abs(a - b))

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / points

    step = c("duration") / (points - 1)
    d = d.select(*keys, (mean(c("curve")) * 10).alias("intensity_realized"), mean(gaps).alias("tracking_error"),
                 (argmax(c("curve")) * step).alias("peak_realized"), (argmax(c("_goal")) * step).alias("peak_target"))
    return d.withColumn("mismatch", c("tracking_error") > 0.3)


def finish_review(clips: DataFrame, frames: DataFrame, density: Column | None = None, key="timeline_id") -> DataFrame:
    """Effect load and evenness of sharpness and brightness.  ``density`` is the brief's effect density, if any."""
    fx = clips.groupBy(key).agg((F.sum(F.size("effects")) / F.count(F.lit(1))).alias("effects_per_clip"))
    even = frames.groupBy(key).agg((F.stddev_pop("sharpness") / F.greatest(F.avg("sharpness"), F.lit(1e-6))).alias("sharpness_cv"),
                                   F.stddev_pop("brightness").alias("brightness_std"))
    d = fx.join(even, key, "left")
    top = F.lit(3.4) if density is None else 1.2 + 3.2 * density
    over = c("effects_per_clip") > top
    over = over if density is None else over & (density < 0.6)
    return d.withColumns({"over_processed": over, "quality_inconsistent": F.coalesce(c("sharpness_cv") > 1.15, F.lit(False)),
                          "exposure_inconsistent": F.coalesce(c("brightness_std") > 55, F.lit(False))})


def critique_score(timelines: DataFrame, issues: DataFrame, key="timeline_id") -> DataFrame:
    """0..10 from beat alignment less the penalties of the issues (key, severity)."""
    p = issues.groupBy(key).agg(F.sum(lookup(D.PENALTY, c("severity"))).alias("_p"), F.count(F.lit(1)).alias("issues"))
    d = timelines.join(p, key, "left")
    return d.select(*timelines.columns, F.coalesce("issues", F.lit(0)).alias("issues"), clip(6.5 + 2.2 * c("alignment") - F.coalesce("_p", F.lit(0.0)), 0, 10).alias("score"))


def choose_candidate(candidates: DataFrame, key="run_id", order="name", enough: float = 0.5) -> DataFrame:
    """Winner, spread and lead over the runner-up among the candidates without an error."""
    ok = candidates.filter("error IS NULL")
    low = ok.groupBy(key).agg(F.min("score").alias("_low"), F.count(F.lit(1)).alias("viable"))
    w = W.partitionBy(key).orderBy(c("score").desc(), c(order))
    two = ok.select(key, order, "score").withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    a = two.groupBy(key).agg(F.max(F.when(c("_r") == 1, c(order))).alias("winner"), F.max("score").alias("score"), F.max(F.when(c("_r") == 2, c("score"))).alias("_second"))
    d = a.join(low, key)
    d = d.withColumns({"spread": c("score") - c("_low"), "margin": F.coalesce(c("score") - c("_second"), F.lit(0.0))})
    return d.withColumn("decisive", c("margin") >= enough).drop("_low", "_second")


def ab_compare(pairs: DataFrame) -> DataFrame:
    """Metric-wise verdicts for rows holding two variants as structs ``restrained`` and ``chaotic``."""
    rows = []
    have = set(pairs.schema["restrained"].dataType.names)
    for metric, rel, f in D.AB_CHECKS:
        if metric not in have:
            continue
        r, x = c(f"restrained.{metric}").cast("double"), c(f"chaotic.{metric}").cast("double")
        ok = r > x * f if rel == ">" else r < x * f if rel == "<" else (r == 0) & (x > 0)
        rows.append(F.struct(F.lit(metric).alias("metric"), r.alias("a"), x.alias("b"), ok.alias("passed")))
    keep = [n for n in pairs.columns if n not in ("restrained", "chaotic")]
    return pairs.select(*keep, F.inline(F.array(*rows)))


def coverage(shots: DataFrame, specs: Sequence[dict], key: str = "shot_id", enough: float = 0.999) -> DataFrame:
    """Which planned shots the library may already hold.

    ``specs`` are dicts with number, criteria and duration (the recording time).  A spec
    without a measurable, measured requirement cannot be checked.
    """
    asked = [S.Query(str(s["number"]), tuple(s["criteria"])) for s in specs if s["criteria"]]
    spark = shots.sparkSession
    dead = {(r.query_id, r.criterion) for r in S.inert_criteria(shots, asked).collect()} if asked else set()
    live = {q.query_id: [k for k in q.criteria if (q.query_id, k.describe()) not in dead] for q in asked}
    plan = spark.createDataFrame([(str(s["number"]), float(s["duration"]), len(live.get(str(s["number"]), []))) for s in specs],
                                 "query_id string, duration_wanted double, checked long")
    if not asked:
        return plan.select("query_id", F.lit("unverifiable").alias("status"), F.array().cast("array<string>").alias("candidates"), "checked", F.lit(0.0).alias("closest"))
    near = S.matches(shots, asked, key, inert=dead).groupBy("query_id").agg(F.max("score").alias("_near"))
    # length and score are tested first, so a long enough shot behind many short ones is found; three names are shown.  Every
    # task keeps three shots of a spec (a top three by limit): ranking all hits would sort a task's whole share of them
    order, best = [c("score").desc(), c("order_value").desc(), c(key)], None
    wanted = {str(s["number"]): float(s["duration"]) for s in specs}
    for q in asked:
        long = F.greatest(F.lit(0.3), F.lit(wanted[q.query_id]) / 3.0 * 0.6)
        part = S.matches(shots, [q], key, ["duration"], dead).filter((c("score") >= enough) & (c("duration") >= long)).orderBy(*order).limit(3)
        best = part if best is None else best.unionByName(part)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    best = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(key).alias("k")))).alias("_g"))
    d = plan.join(near, "query_id", "left").join(best, "query_id", "left")
    names = F.transform(F.coalesce("_g", F.array().cast("array<struct<rank:int,k:string>>")), lambda x: x["k"])
    d = d.withColumn("candidates", names)
    status = F.when(c("checked") == 0, "unverifiable").when(F.size("candidates") == 0, "missing").otherwise("likely")
    return d.select("query_id", status.alias("status"), F.when(c("checked") > 0, c("candidates")).otherwise(F.slice("candidates", 1, 0)).alias("candidates"),
                    "checked", F.coalesce("_near", F.lit(0.0)).alias("closest"))


def coverage_summary(covered: DataFrame) -> DataFrame:
    def n(s):
        return F.count(F.when(c("status") == s, 1)).alias(s)
    d = covered.agg(n("likely"), n("missing"), n("unverifiable"))
    return d.withColumn("ready", c("missing") == 0)


def inspect_recording(recordings: DataFrame, specs: Sequence[dict], spec_col: str = "spec") -> DataFrame:
    """Approve or reshoot each recording against the spec it was made for, with reasons."""
    types = dict(recordings.dtypes)
    problems, wanted = None, None
    for s in specs:
        tests = [F.when(~S.passes(k, types), F.lit(k.describe())) for k in s["criteria"]]
        bad = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array().cast("array<string>")
        mine = c(spec_col) == s["number"]
        problems = F.when(mine, bad) if problems is None else problems.when(mine, bad)
        wanted = F.when(mine, float(s["duration"])) if wanted is None else wanted.when(mine, float(s["duration"]))
    d = recordings.withColumns({"problems": problems, "_want": wanted})
    short = c("duration") < F.greatest(F.lit(0.3), c("_want") / 3.0 * 0.6)
    off = F.size("problems") > 0
    again = c("handling").isin("reject", "use_briefly") | off | short
    faults = F.size("defects") > 0 if "defects" in types else F.lit(False)
    advice = F.filter(F.array(
        F.when(c("handling") == "reject", "technically unusable").when(c("handling") == "use_briefly", "usable only briefly")
         .when(off, F.concat(F.lit("does not match the direction: "), F.array_join("problems", "; "))),
        F.when(short, "too short"), F.when(faults & ~again, "has fixable issues")), lambda x: x.isNotNull())
    return d.withColumns({"verdict": F.when(again, "reshoot").otherwise("approve"), "advice": advice}).drop("_want")


def instantiate_specs(styles: DataFrame, sequence: str) -> DataFrame:
    """Planned shots of a sequence for every style, with the time to record for each."""
    rows = [s for s in D.SHOT_SPECS if s[0] == sequence]
    if not rows:
        raise ValueError(f"unknown sequence {sequence!r}")
    items = F.array(*[F.struct(F.lit(n).cast("long").alias("number"), F.lit(name).alias("name"), F.lit(i).alias("intensity"), F.lit(f).alias("shortest"),
                               F.lit(q).alias("match_query"), F.lit(m).alias("content")) for _, n, name, i, f, q, m in rows])
    d = styles.withColumn("_s", F.explode(items)).select("*", "_s.*").drop("_s")
    cut = target_shot_duration(c("intensity"), c("p10_shot"), c("p90_shot"), c("pacing") if "pacing" in styles.columns else 1.0)
    return d.withColumn("record_seconds", F.bround(F.greatest("shortest", cut * 3.0 + 1.0), 1))


def teach_limit(asks: DataFrame, known: DataFrame | None = None, most: int = D.EXPLAIN_LIMIT, user="user_id", concept="concept", order="event_id",
                explained: Sequence[str] = D.CONCEPTS) -> DataFrame:
    """The first ``most`` explanations per user and concept; none of concepts that nothing explains or that the user knows, and
    none for users who want it minimal."""
    asks = asks.filter(c(concept).isin(*explained))
    d = asks if known is None else asks.join(known.select(user, concept), [user, concept], "left_anti")
    if "level" in asks.columns:
        d = d.filter(c("level") != "minimal")
    w = W.partitionBy(user, concept).orderBy(order)
    return d.withColumn("nth", F.row_number().over(w)).filter(c("nth") <= most)


def revision_knobs(issues: DataFrame, key="timeline_id", order="ord") -> DataFrame:
    """How the next pass changes pacing and diversity, from the directives (action, factor) of a review."""
    def first(action):
        return F.min_by(F.struct("factor"), F.when(c("action") == action, c(order)))
    a = issues.groupBy(key).agg(first("increase_cut_density").alias("_up"), first("decrease_cut_density").alias("_down"),
                                F.bool_or(c("action") == "increase_visual_contrast").alias("_mix"))
    up = F.when(c("_up").isNotNull(), 1 / F.greatest(F.coalesce("_up.factor", F.lit(1.2)), F.lit(1e-6))).otherwise(1.0)
    down = F.when(c("_down").isNotNull(), 1 / F.coalesce("_down.factor", F.lit(0.8))).otherwise(1.0)
    return a.select(key, (up * down).alias("pacing_bias"), F.when(c("_mix"), 1.0).otherwise(0.0).alias("diversity_step"))


def duration_drift(timelines: DataFrame, directives: DataFrame, key="timeline_id", least: float = 0.05) -> DataFrame:
    """Timelines whose length misses the target, and whether a length directive caused it (duration, target)."""
    cause = directives.filter(c("kind") == "set_duration").select(key).distinct().withColumn("_c", F.lit(True))
    d = timelines.withColumn("drift", c("duration") - c("target")).filter(F.abs("drift") > least)
    return d.join(cause, key, "left").withColumn("by_directive", F.coalesce("_c", F.lit(False))).drop("_c")

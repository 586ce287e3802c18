"""Directive, decision and job logs reduced to their current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import clip
from ..rules import delivery as D
from .blocks import TIME_BLOCK, asof, block_of, running

c = F.col
SLOT_KINDS = ("lock_clip", "force_transition", "force_effects", "set_duration", "reject_at_slot", "pin_shot")
SINGLE = ("pin_shot", "force_transition", "force_effects", "set_duration")


def bind_directives(directives: DataFrame, clips: DataFrame, key="timeline_id", width: float = TIME_BLOCK) -> DataFrame:
    """Re-find the moment of each anchored directive in a rebuilt timeline.

    The same shot at the slot is exact, the same shot elsewhere is moved (nearest in
    time, the earlier on ties), otherwise the directive is lost.
    """
    anchored = c("kind").isin(*SLOT_KINDS) & c("anchor_shot_id").isNotNull()
    here = clips.groupBy(key, "slot_index").agg(F.min("shot_id").alias("_here"))
    d = directives.join(here, [key, "slot_index"], "left")
    exact = anchored & c("_here").eqNullSafe(c("anchor_shot_id"))
    probes = (d.filter(anchored & ~exact).select(key, c("anchor_shot_id").alias("shot_id"), F.coalesce("anchor_t", F.lit(0.0)).alias("_at"), "directive_id"))
    spots = clips.select(key, "shot_id", "tl_start", c("slot_index").alias("found"))
    near = asof(probes, spots, [key, "shot_id"], "_at", "tl_start", ["found"], "nearest", width).select(key, "directive_id", c("s_found").alias("_found"))
    d = d.join(near, [key, "directive_id"], "left")
    status = (F.when(~anchored, F.lit("unanchored")).when(exact, "exact").when(c("_found").isNotNull(), "moved").otherwise("lost"))
    return d.withColumns({"anchor_status": status, "slot_index": F.coalesce("_found", "slot_index")}).drop("_here", "_found")


def directive_state(directives: DataFrame, key="timeline_id", order="seq") -> DataFrame:
    """What is in force: the last word per slot for single values, sets for bans and locks.

    Directives with a lost anchor do not act; a later pin replaces an earlier one even
    when its own anchor is lost.
    """
    live = F.coalesce(c("anchor_status"), F.lit("unanchored")) != "lost"
    last = F.max_by(F.struct("shot_id", "value", live.alias("live")), c(order))
    single = directives.filter(c("kind").isin(*SINGLE) & (live | (c("kind") == "pin_shot")))
    single = single.groupBy(key, "kind", "slot_index").agg(last.alias("_l")).filter("_l.live").select(key, "kind", "slot_index", c("_l.shot_id").alias("shot_id"), c("_l.value").alias("value"))
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("long")
    bans = directives.filter((c("kind") == "reject_shot") & c("shot_id").isNotNull()).select(key, "kind", none_i.alias("slot_index"), "shot_id", none_s.alias("value"))
    at = directives.filter((c("kind") == "reject_at_slot") & c("shot_id").isNotNull()).select(key, "kind", "slot_index", "shot_id", none_s.alias("value"))
    fx = directives.filter((c("kind") == "ban_effect") & c("value").isNotNull()).select(key, "kind", none_i.alias("slot_index"), none_s.alias("shot_id"), "value")
    locks = directives.filter((c("kind") == "lock_clip") & c("slot_index").isNotNull() & live).select(key, "kind", "slot_index", none_s.alias("shot_id"), none_s.alias("value"))
    return single.unionByName(bans.unionByName(at).unionByName(fx).unionByName(locks).distinct())


def decisions_by_stage(decisions: DataFrame, stage: str) -> DataFrame:
    return decisions.filter(c("stage") == stage)


def explain(decisions: DataFrame, most: int = 3) -> DataFrame:
    """Readable line per decision with at most ``most`` alternatives (choice, score, why_not)."""
    head = F.format_string("[%s/%s] -> %s (confidence %.2f, by %s)", "stage", "subject", "choice", "confidence", "actor")
    alts = F.transform(F.slice("alternatives", 1, most), lambda a: F.format_string("alt: %s (score %.3f) %s", a["choice"], a["score"], a["why_not"]))
    return decisions.withColumn("text", F.concat_ws("\n", head, c("rationale"), alts))


def job_state(events: DataFrame, now: Column | float, key="job_id", order="seq", time="t") -> DataFrame:
    """Current state of every job from its event log (state, progress, message).

    The first terminal state is final, whatever is logged afterwards.
    """
    now = now if isinstance(now, Column) else F.lit(now)
    done = c("state").isin(*D.TERMINAL)
    a = events.groupBy(key).agg(
        F.min_by(F.struct("state", time), F.when(done, c(order))).alias("_end"), F.max_by("state", order).alias("_last"),
        F.max_by("progress", F.when(c("progress").isNotNull(), c(order))).alias("_p"), F.min(time).alias("created_at"),
        F.min(F.when(c("state") == "running", c(time))).alias("started_at"), F.count(F.lit(1)).alias("steps"))
    d = a.select(key, F.coalesce("_end.state", "_last").alias("state"), F.when(c("_end.state") == "succeeded", 1.0).otherwise(clip(F.coalesce("_p", F.lit(0.0)), 0, 1)).alias("progress"),
                 "created_at", "started_at", c(f"_end.{time}").alias("ended_at"), "steps")
    return d.withColumn("elapsed", F.greatest(F.lit(0.0), F.coalesce("ended_at", now) - F.coalesce("started_at", "created_at")))


def recover_orphans(jobs: DataFrame, owners: DataFrame, now: Column | float, key="job_id") -> DataFrame:
    """Fail the unfinished jobs that no live owner carries any more."""
    now = now if isinstance(now, Column) else F.lit(now)
    d = jobs.join(owners.select(key).distinct().withColumn("_alive", F.lit(True)), key, "left")
    lost = c("state").isin("pending", "running") & c("_alive").isNull()
    return d.withColumns({"ended_at": F.when(lost, F.coalesce("ended_at", now)).otherwise(c("ended_at")),
                          "error": F.when(lost, D.INTERRUPTED), "state": F.when(lost, "failed").otherwise(c("state"))}).drop("_alive")


def list_jobs(jobs: DataFrame, state: str | None = None, project: Column | None = None) -> DataFrame:
    d = jobs if state is None else jobs.filter(c("state") == state)
    d = d if project is None else d.filter(project)
    return d.orderBy(c("created_at").desc())


def stage_of(message: Column) -> Column:
    """Progress named by the first stage key a message contains."""
    out = None
    for k, p in D.STAGES.items():
        hit = F.instr(F.lower(message), k.lower()) > 0
        out = F.when(hit, p) if out is None else out.when(hit, p)
    return out


def stage_progress(events: DataFrame, key="job_id", order="seq", block: Column | None = None, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Never-falling progress of a job by the stages its messages name, mapped onto lo..hi."""
    d = running(events, [key], [order], block if block is not None else block_of(c(order), 65536), {"_p": ("max", stage_of(c("message")))})
    return d.withColumn("progress", F.lit(lo) + F.lit(hi - lo) * clip(F.coalesce("_p", F.lit(0.0)), 0, 1)).drop("_p")

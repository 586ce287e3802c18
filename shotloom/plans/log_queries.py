"""Directive, decision and job logs made from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import logs as L
from ..session import table
from ..sources import views as V
from .oracle import r6, sql
from .registry import query

c = F.col
KINDS = ("reject_shot", "reject_at_slot", "pin_shot", "lock_clip", "force_transition", "force_effects", "ban_effect", "set_duration")
KIND_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][CAST(event_id % 8 AS INT) + 1]"

DIRS = ("dirs", f"""SELECT series_id AS timeline_id, event_id AS seq, {KIND_SQL} AS kind, event_id % 12 AS slot, 's' || CAST(event_id % 30 AS VARCHAR) AS shot_id, CAST(event_id % 5 AS VARCHAR) AS value,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE 's' || CAST((event_id * 7) % 50 AS VARCHAR) END AS anchor, v AS anchor_t FROM sig""")
CLIPS = ("lc", "SELECT series_id AS timeline_id, n AS slot, 's' || CAST((n * 11 + series_id) % 30 AS VARCHAR) AS shot_id, n * 2.0 AS tl_start FROM sig")


def directives(spark, sf):
    e = c("event_id")
    return V.raw_series(spark, sf).select(
        c("series_id").alias("timeline_id"), e.alias("seq"), e.alias("directive_id"), F.get(F.array(*[F.lit(k) for k in KINDS]), (e % 8).cast("int")).alias("kind"),
        (e % 12).alias("slot_index"), F.concat(F.lit("s"), (e % 30).cast("string")).alias("shot_id"), (e % 5).cast("string").alias("value"),
        F.when(e % 3 != 0, F.concat(F.lit("s"), ((e * 7) % 50).cast("string"))).alias("anchor_shot_id"), c("v").alias("anchor_t"))


def placed(spark, sf):
    n = c("n")
    return V.series(spark, sf).select(c("series_id").alias("timeline_id"), n.alias("slot_index"), F.concat(F.lit("s"), ((n * 11 + c("series_id")) % 30).cast("string")).alias("shot_id"), (n * 2.0).alias("tl_start"))


BOUND = [DIRS, CLIPS, ("bd", """SELECT d.*, CASE WHEN anchor IS NULL OR kind IN ('reject_shot', 'ban_effect') THEN 'unanchored' WHEN EXISTS (SELECT 1 FROM lc h WHERE h.timeline_id = d.timeline_id AND h.slot = d.slot AND h.shot_id = d.anchor) THEN 'exact'
    WHEN near.slot IS NOT NULL THEN 'moved' ELSE 'lost' END AS status, near.slot AS ns FROM dirs d LEFT JOIN (SELECT * FROM (SELECT d.seq, c.slot, row_number() OVER (PARTITION BY d.seq ORDER BY abs(c.tl_start - d.anchor_t), c.tl_start) AS r
      FROM dirs d JOIN lc c ON c.timeline_id = d.timeline_id AND c.shot_id = d.anchor) WHERE r = 1) near ON near.seq = d.seq""")]


@query("bind_directives", sql("SELECT timeline_id, seq, status AS anchor_status, CASE WHEN status = 'moved' THEN ns ELSE slot END AS slot_index FROM bd", *BOUND))
def bind_directives(spark, sf):
    d = L.bind_directives(directives(spark, sf), placed(spark, sf))
    return d.select("timeline_id", "seq", "anchor_status", "slot_index")


@query("directive_state", sql("""SELECT timeline_id, kind, slot AS slot_index, shot_id, value FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id, kind, slot ORDER BY seq DESC) AS r FROM st
      WHERE kind IN ('pin_shot', 'force_transition', 'force_effects', 'set_duration') AND (NOT lost OR kind = 'pin_shot')) WHERE r = 1 AND NOT lost
    UNION ALL SELECT DISTINCT timeline_id, kind, NULL::BIGINT, shot_id, NULL FROM st WHERE kind = 'reject_shot'
    UNION ALL SELECT DISTINCT timeline_id, kind, slot, shot_id, NULL FROM st WHERE kind = 'reject_at_slot'
    UNION ALL SELECT DISTINCT timeline_id, kind, NULL::BIGINT, NULL, value FROM st WHERE kind = 'ban_effect'
    UNION ALL SELECT DISTINCT timeline_id, kind, slot, NULL, NULL FROM st WHERE kind = 'lock_clip' AND NOT lost""", DIRS, ("st", "SELECT *, seq % 7 = 0 AS lost FROM dirs")))
def directive_state(spark, sf):
    d = directives(spark, sf).withColumn("anchor_status", F.when(c("seq") % 7 == 0, "lost").otherwise("exact"))
    return L.directive_state(d)


@query("decisions_by_stage", sql("SELECT event_id FROM events WHERE event_type = 'click'"))
def decisions_by_stage(spark, sf):
    return L.decisions_by_stage(table(spark, sf, "events").withColumn("stage", c("event_type")), "click").select("event_id")


@query("explain", sql("""SELECT event_id, printf('[%s/%s] -> %s (confidence %.2f, by %s)', event_type, 'slot_' || CAST(event_id % 20 AS VARCHAR), 's' || CAST(user_id AS VARCHAR), value / 97, 'rule_based_planner') || chr(10) || props
    || chr(10) || printf('alt: %s (score %.3f) %s', 's1', value / 7, 'weaker') || CASE WHEN event_id % 2 = 0 THEN chr(10) || printf('alt: %s (score %.3f) %s', 's2', value / 9, 'longer') ELSE '' END AS text FROM events"""))
def explain(spark, sf):
    e = table(spark, sf, "events")

    def alt(name, score, why):
        return F.struct(F.lit(name).alias("choice"), score.alias("score"), F.lit(why).alias("why_not"))
    two = F.array(alt("s1", c("value") / 7, "weaker"), alt("s2", c("value") / 9, "longer"))
    d = e.select("event_id", c("event_type").alias("stage"), F.concat(F.lit("slot_"), (c("event_id") % 20).cast("string")).alias("subject"), F.concat(F.lit("s"), c("user_id").cast("string")).alias("choice"),
                 (c("value") / 97).alias("confidence"), F.lit("rule_based_planner").alias("actor"), c("props").alias("rationale"),
                 F.slice(two, F.lit(1), F.when(c("event_id") % 2 == 0, 2).otherwise(1)).alias("alternatives"))
    return L.explain(d).select("event_id", "text")


JOBS = [("je", """SELECT series_id AS job_id, event_id AS seq, t, CASE WHEN event_id % 131 = 0 THEN 'succeeded' WHEN event_id % 211 = 0 THEN 'failed' WHEN event_id % 307 = 0 THEN 'cancelled' WHEN n = 0 THEN 'pending' ELSE 'running' END AS state,
    v / 40 - 0.1 AS progress FROM sig"""),
        ("jb", """SELECT job_id, coalesce(arg_min(state, seq) FILTER (state IN ('succeeded', 'failed', 'cancelled')), arg_max(state, seq)) AS state, arg_max(progress, seq) AS p, min(t) AS created_at, min(t) FILTER (state = 'running') AS started_at,
        arg_min(t, seq) FILTER (state IN ('succeeded', 'failed', 'cancelled')) AS ended_at, count(*) AS steps FROM je GROUP BY 1""")]
NOW = 2700000.0


def job_events(spark, sf):
    e = c("event_id")
    s = F.when(e % 131 == 0, "succeeded").when(e % 211 == 0, "failed").when(e % 307 == 0, "cancelled").when(c("n") == 0, "pending").otherwise("running")
    return V.series(spark, sf).select(c("series_id").alias("job_id"), e.alias("seq"), "t", s.alias("state"), (c("v") / 40 - 0.1).alias("progress"), c("kind"))


@query("job_state", sql(f"""SELECT job_id, state, {r6("CASE WHEN state = 'succeeded' THEN 1 ELSE least(greatest(p, 0), 1) END")} AS progress, {r6(f'greatest(0, coalesce(ended_at, {NOW}) - coalesce(started_at, created_at))')} AS elapsed, steps FROM jb""", *JOBS))
def job_state(spark, sf):
    d = L.job_state(job_events(spark, sf), NOW)
    return d.select("job_id", "state", R(c("progress")).alias("progress"), R(c("elapsed")).alias("elapsed"), "steps")


@query("recover_orphans", sql(f"""SELECT job_id, CASE WHEN state IN ('pending', 'running') AND job_id % 4 <> 0 THEN 'failed' ELSE state END AS state, state IN ('pending', 'running') AND job_id % 4 <> 0 AS interrupted,
    {r6(f"CASE WHEN state IN ('pending', 'running') AND job_id % 4 <> 0 THEN coalesce(ended_at, {NOW}) ELSE ended_at END")} AS ended_at FROM jb""", *JOBS))
def recover_orphans(spark, sf):
    jobs = L.job_state(job_events(spark, sf), NOW)
    d = L.recover_orphans(jobs, V.raw_series(spark, sf).select(c("series_id").alias("job_id")).filter("job_id % 4 = 0"), NOW)
    return d.select("job_id", "state", c("error").isNotNull().alias("interrupted"), R(c("ended_at")).alias("ended_at"))


@query("list_jobs", sql(f"SELECT job_id, {r6('created_at')} AS created_at FROM jb WHERE state = 'running' AND job_id % 2 = 0", *JOBS))
def list_jobs(spark, sf):
    d = L.list_jobs(L.job_state(job_events(spark, sf), NOW), "running", c("job_id") % 2 == 0)
    return d.select("job_id", R(c("created_at")).alias("created_at"))


@query("stage_progress", sql(f"""SELECT series_id AS job_id, event_id AS seq, {r6('0.2 + 0.6 * coalesce(max(p) OVER (PARTITION BY series_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)')} AS progress FROM (
    SELECT *, CASE WHEN v < 0.5 THEN 0.97 WHEN kind = 'view' THEN NULL WHEN kind = 'click' THEN 0.15 WHEN kind = 'signup' THEN 0.45 WHEN kind = 'purchase' THEN 0.55 ELSE NULL END AS p FROM sig)"""))
def stage_progress(spark, sf):
    msg = (F.when(c("v") < 0.5, "[10/10] mastering the file").when(c("kind") == "click", "[1/10] Ingesting clips").when(c("kind") == "signup", "[5/10] planning slots")
            .when(c("kind") == "purchase", "Selecting shots").otherwise("still busy"))
    d = V.raw_series(spark, sf).select(c("series_id").alias("job_id"), c("event_id").alias("seq"), msg.alias("message"))
    return L.stage_progress(d, lo=0.2, hi=0.8).select("job_id", "seq", R(c("progress")).alias("progress"))

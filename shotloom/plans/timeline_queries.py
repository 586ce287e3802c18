"""Planning, timelines and their checks, over timelines made from the order lines of each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planning as X, scores
from ..functions.maths import on_frame, r6 as R
from ..operators import plan as P, timeline as T
from ..operators.blocks import block_of, framed, running
from ..operators.peaks import keep_spaced
from ..session import stage, table
from ..sources import views as V
from .oracle import r6, sql
from .registry import query
from .measure_queries import VERDICT
from .series_queries import ENERGY, energy
from .style_queries import EDIT, PACE, edit, lengths_of

c = F.col
WIDE = 86400.0 * 30

TL = ("tl", """SELECT *, 'c' || CASE WHEN l_partkey % 101 = 0 THEN 'dup' ELSE CAST(idx AS VARCHAR) END AS clip_id,
      q0 / 10.0::DOUBLE + CASE l_partkey % 50 WHEN 0 THEN 0.5 WHEN 1 THEN -0.3 ELSE 0 END AS tl_start, duration AS dur,
      (l_partkey % 20) / 10.0::DOUBLE AS source_in, (l_partkey % 20) / 10.0::DOUBLE + CASE WHEN l_partkey % 40 = 3 THEN -1 ELSE 1 END * duration AS source_out,
      CASE WHEN l_partkey % 60 = 0 THEN 9.0 ELSE 1.0 END AS speed, ['hook', 'setup', 'escalation', 'climax', 'release'][CAST(idx % 5 AS INT) + 1] AS role,
      l_partkey % 2 = 0 AS beat_locked, visual_energy AS intensity, l_partkey % 20 = 0 AS on_drop,
      CASE WHEN l_partkey % 97 = 0 THEN 'bogus' ELSE ['cut', 'cut', 'cut', 'flash', 'whip', 'dissolve'][CAST(l_partkey % 6 AS INT) + 1] END AS transition,
      [0.0, 0.0, 0.0, 0.07, 0.13, 0.22][CAST(l_partkey % 6 AS INT) + 1]::DOUBLE AS tdur,
      list_concat(CASE WHEN l_partkey % 3 = 0 THEN ['push_zoom'] ELSE [] END, CASE WHEN l_partkey % 4 = 0 THEN ['film_grain'] ELSE [] END,
        CASE WHEN l_partkey % 33 = 0 THEN ['sparkle'] ELSE [] END, CASE WHEN l_partkey % 71 = 0 THEN ['glow', 'glow', 'glow', 'glow', 'glow', 'reframe'] ELSE [] END) AS fx
    FROM (SELECT *, l_suppkey AS timeline_id, row_number() OVER w - 1 AS idx,
      coalesce(sum(CAST(round(duration * 10) AS BIGINT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0
      FROM shots WINDOW w AS (PARTITION BY l_suppkey ORDER BY start, shot_id))""")


def timeline(spark, sf):
    d = V.shots(spark, sf).withColumn("timeline_id", c("l_suppkey"))
    d = running(d, ["timeline_id"], ["start", "shot_id"], block_of(c("start"), WIDE), {
        "idx": ("sum", F.lit(1).cast("long")), "_q": ("sum", F.round(c("duration") * 10).cast("long"))})
    d = d.withColumn("idx", c("idx") - 1).withColumn("_q", c("_q") - F.round(c("duration") * 10).cast("long"))
    k = c("l_partkey")

    def fx(cond, *pairs):
        return F.when(cond, F.array(*[F.struct(F.lit(n).alias("type"), p.alias("params")) for n, p in pairs])).otherwise(F.array().cast("array<struct<type:string,params:map<string,double>>>"))

    def params(**kw):
        return F.create_map(*[x for n, v in kw.items() for x in (F.lit(n.rstrip("_")), v if not isinstance(v, float) else F.lit(v))])

    glow = ("glow", params(strength=0.5))
    d = d.withColumns({
        "clip_id": F.concat(F.lit("c"), F.when(k % 101 == 0, "dup").otherwise(c("idx").cast("string"))),
        "tl_start": c("_q") / F.lit(10.0) + F.when(k % 50 == 0, 0.5).when(k % 50 == 1, -0.3).otherwise(0.0), "dur": c("duration"),
        "source_in": (k % 20) / 10.0, "source_out": (k % 20) / 10.0 + F.when(k % 40 == 3, -1).otherwise(1) * c("duration"),
        "speed": F.when(k % 60 == 0, 9.0).otherwise(1.0),
        "role": F.get(F.array(*[F.lit(x) for x in ("hook", "setup", "escalation", "climax", "release")]), (c("idx") % 5).cast("int")),
        "beat_locked": k % 2 == 0, "intensity": c("visual_energy"), "on_drop": k % 20 == 0,
        "transition": F.when(k % 97 == 0, "bogus").otherwise(F.get(F.array(*[F.lit(x) for x in ("cut", "cut", "cut", "flash", "whip", "dissolve")]), (k % 6).cast("int"))),
        "tdur": F.get(F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 0.07, 0.13, 0.22)]), (k % 6).cast("int")),
        "effects": F.concat(fx(k % 3 == 0, ("push_zoom", params(from_=1.0, to=c("shake") + 1))), fx(k % 4 == 0, ("film_grain", params(strength=c("noise") * 2))),
                            fx(k % 33 == 0, ("sparkle", params(strength=1.0))), fx(k % 71 == 0, glow, glow, glow, glow, glow, ("reframe", params(scale=1.0))))})
    return d.drop("_q")


def names(col="effects"):
    return F.array_join(F.transform(col, lambda e: e["type"]), ",")


# ------------------------------------------------------------------ planning

WANTS = ("wants", """SELECT shot_id, role, i, CASE role WHEN 'hook' THEN 0.45 WHEN 'escalation' THEN 0.35 WHEN 'climax' THEN 0.55 ELSE 0 END AS lo,
    CASE role WHEN 'setup' THEN 0.75 WHEN 'release' THEN 0.6 ELSE 1 END AS hi,
    least(greatest(CASE role WHEN 'hook' THEN greatest(0.6, i) WHEN 'escalation' THEN least(1.0, i + 0.15) WHEN 'climax' THEN 1 WHEN 'release' THEN greatest(0.15, i - 0.25)
      ELSE least(greatest(i + 0.2 * 0.45, 0), 1) END + 0.2 * 0.45, 0), 1) AS pm,
    role = 'setup' AS faces, role IN ('escalation', 'climax') AS brief FROM (
    SELECT shot_id, ['hook', 'setup', 'anticipation', 'escalation', 'climax', 'release'][CAST(l_partkey % 6 AS INT) + 1] AS role, visual_energy AS i FROM shots)""")
KNOBS = {"motion_preference": 0.2, "prefer_faces": 0.1, "continuity_weight": 1.3, "quality_weight": 0.8, "shot_size_preference": "wide"}


@query("slot_wants", sql(f"SELECT shot_id, {r6('lo')} AS min_energy, {r6('hi')} AS max_energy, {r6('pm')} AS prefer_motion, faces AS want_faces, brief AS allow_brief FROM wants", WANTS))
def slot_wants(spark, sf):
    role = F.get(F.array(*[F.lit(x) for x in ("hook", "setup", "anticipation", "escalation", "climax", "release")]), (c("l_partkey") % 6).cast("int"))
    w = X.slot_wants(role, c("visual_energy"), KNOBS)
    return V.shots(spark, sf).select("shot_id", *[R(w[k].cast("double")).alias(k) for k in ("min_energy", "max_energy", "prefer_motion")], w["want_faces"].alias("want_faces"), w["allow_brief"].alias("allow_brief"))


def cont_sql(p: str, n: str) -> str:
    gap = f"abs(mod(mod({p}.flow_direction_deg - {n}.flow_direction_deg + 180, 360) + 360, 360) - 180)"
    return f"""CASE WHEN {p}.camera_movement IS NULL THEN 0.6 ELSE least(greatest(
      0.34 * least(greatest(1 - (abs({p}.brightness - {n}.brightness) + abs({p}.warmth - {n}.warmth) * 0.5) / 0.9, 0), 1)
      + 0.42 * CASE WHEN {p}.camera_movement = {n}.camera_movement AND {p}.camera_movement <> 'static' THEN CASE WHEN {gap} < 45 THEN 1.0 WHEN {gap} > 135 THEN 0.72 ELSE 0.4 END
        WHEN {p}.camera_movement = 'static' AND {n}.camera_movement <> 'static' THEN 0.85 WHEN {p}.camera_movement <> 'static' AND {n}.camera_movement = 'static' THEN 0.7
        WHEN {p}.camera_movement = {n}.camera_movement THEN 0.45 ELSE 0.6 END
      + 0.24 * CASE WHEN {p}.shot_size = {n}.shot_size AND abs({p}.subject_x - {n}.subject_x) + abs({p}.subject_y - {n}.subject_y) < 0.08 THEN 0.18
        WHEN {p}.shot_size = {n}.shot_size THEN 0.45 ELSE 1.0 END, 0), 1) END"""


@query("continuity", sql(f"SELECT n.timeline_id, n.idx, {r6(cont_sql('p', 'n'))} AS continuity FROM tl n LEFT JOIN tl p ON p.timeline_id = n.timeline_id AND p.idx = n.idx - 1", TL))
def continuity(spark, sf):
    d = framed(timeline(spark, sf), ["timeline_id"], "idx", 1, 0, {"_p": lambda w: F.lag(F.struct(*P.LOOK)).over(w)})
    s = X.continuity({k: c(f"_p.{k}") for k in P.LOOK}, {k: c(k) for k in P.LOOK})
    return d.select("timeline_id", "idx", R(s).alias("continuity"))


SLOTS = (("hook", 0.9, 0.4), ("escalation", 0.5, 0.8), ("release", 0.3, 1.6))
CAND = [
    ("sl", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', {x}::DOUBLE, {d}::DOUBLE)" for i, (r, x, d) in enumerate(SLOTS)) + ") v(slot, role, i, need)"),
    ("fs", "SELECT asset_id, min(shot_id) AS first_id FROM shots GROUP BY 1"),
    ("cand", f"""SELECT s.*, slot, role, i, need, s.shot_id = f.first_id AS used, p.asset_id IS NOT NULL AND slot > 0 AS used_asset, {cont_sql('q', 's')} AS cont,
        CASE role WHEN 'hook' THEN 0.45 WHEN 'escalation' THEN 0.35 ELSE 0 END AS lo, CASE role WHEN 'release' THEN 0.6 ELSE 1 END AS hi,
        least(greatest(CASE role WHEN 'hook' THEN greatest(0.6, i) WHEN 'escalation' THEN least(1.0, i + 0.15) ELSE greatest(0.15, i - 0.25) END + 0.09, 0), 1) AS pm
        FROM shots s CROSS JOIN sl JOIN fs f USING (asset_id) JOIN shots p ON p.shot_id = f.first_id
        LEFT JOIN shots q ON q.shot_id = f.first_id AND slot > 0"""),
    ("prt", """SELECT *, CASE WHEN visual_energy < lo THEN least(greatest(1 - (lo - visual_energy) * 2.2, 0), 1) WHEN visual_energy > hi THEN least(greatest(1 - (visual_energy - hi) * 1.6, 0), 1) ELSE 1 END AS e,
        1 - least(1.0, abs(pm - least(greatest(flow_magnitude / 3, 0), 1))) AS m, CASE WHEN duration >= need THEN 1 ELSE power(least(greatest(duration / need, 0), 1), 1.5) END AS l,
        greatest(0, 1 - CASE WHEN faces = 0 THEN 0.1 * 0.4 ELSE 0 END - CASE WHEN shot_size NOT IN ('wide', 'unknown') THEN 0.25 ELSE 0 END) AS rf,
        CASE handling WHEN 'use_briefly' THEN CASE WHEN role <> 'escalation' OR need > 0.5 THEN 0.25 ELSE 1.05 END WHEN 'replace' THEN 0.6 ELSE 1 END AS hf FROM cand"""),
    ("sc", """SELECT *, (0.22 * e + 0.16 * m + 0.12 * l + 0.14 * 0.8 * technical_quality + 0.12 * creative_value + 0.18 * 1.3 * cont + 0.06 * rf)
        / (0.22 + 0.16 + 0.12 + 0.14 * 0.8 + 0.12 + 0.18 * 1.3 + 0.06) * hf * CASE WHEN used THEN 0.66 ELSE 1 END * CASE WHEN used_asset THEN 0.93 ELSE 1 END AS score FROM prt"""),
]


def slotted(shots):
    """Every shot a candidate for three slots."""
    slots = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("slot"), F.lit(r).alias("role"), F.lit(x).alias("intensity"), F.lit(d).alias("slot_duration"))
                                for i, (r, x, d) in enumerate(SLOTS)]))
    return shots.withColumn("_s", slots).select("*", "_s.*").drop("_s")


def candidates(spark, sf):
    """Three slots per asset, every shot of the asset a candidate, its first shot the previous one."""
    s = V.shots(spark, sf)
    first = s.groupBy("asset_id").agg(F.min_by(F.struct(*P.LOOK), "shot_id").alias("prev"), F.min("shot_id").alias("_first"))
    d = slotted(s.join(first, "asset_id"))
    return d.withColumns({"plan_id": c("asset_id"), "used_shot": c("shot_id") == c("_first"), "used_asset": c("slot") > 0,
                          "prev": F.when(c("slot") > 0, c("prev"))}).drop("_first")


@query("score_candidates", sql(f"SELECT asset_id AS plan_id, CAST(slot AS BIGINT) AS slot, shot_id, {r6('score')} AS score FROM sc", *CAND))
def score_candidates(spark, sf):
    return P.score_candidates(candidates(spark, sf), KNOBS).select("plan_id", "slot", "shot_id", R(c("score")).alias("score"))


@query("eligible_fallback", sql("""SELECT asset_id AS plan_id, CAST(slot AS BIGINT) AS slot, shot_id FROM (SELECT *, max_useful_duration IS NULL OR need <= max_useful_duration + 1e-3 AS ok,
    bool_or(max_useful_duration IS NULL OR need <= max_useful_duration + 1e-3) OVER (PARTITION BY asset_id, slot) AS any_ok FROM shots CROSS JOIN sl) WHERE ok OR NOT any_ok""", CAND[0]))
def eligible_fallback(spark, sf):
    d = slotted(V.shots(spark, sf)).withColumn("plan_id", c("asset_id"))
    return P.eligible(d).select("plan_id", "slot", "shot_id")


W8 = {"energy_fit": ("e", 0.22), "motion_fit": ("m", 0.16), "duration_fit": ("l", 0.12), "quality": ("technical_quality", 0.14 * 0.8), "creative": ("creative_value", 0.12),
      "continuity": ("cont", 0.18 * 1.3), "role_fit": ("rf", 0.06)}


@query("rank_alternatives", sql(f"""SELECT a.asset_id AS plan_id, CAST(a.slot AS BIGINT) AS slot, a.shot_id AS choice, {r6('a.score')} AS score, coalesce(abs(b.score - a.score) < 0.05, false) AS close_call,
    b.shot_id AS second, CAST(least(a.k - 1, 3) AS BIGINT) AS alternatives FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY asset_id, slot) AS k FROM sc WINDOW w AS (PARTITION BY asset_id, slot ORDER BY round(score, 9) DESC, shot_id)) a
    LEFT JOIN (SELECT *, row_number() OVER w AS r FROM sc WINDOW w AS (PARTITION BY asset_id, slot ORDER BY round(score, 9) DESC, shot_id)) b ON b.asset_id = a.asset_id AND b.slot = a.slot AND b.r = 2 WHERE a.r = 1""", *CAND))
def rank_alternatives(spark, sf):
    d = P.rank_with_alternatives(P.score_candidates(candidates(spark, sf), KNOBS), knobs=KNOBS)
    return d.select("plan_id", "slot", "choice", R(c("score")).alias("score"), "close_call", F.get("alternatives", F.lit(0))["shot"].alias("second"), F.size("alternatives").cast("long").alias("alternatives"))


GREEDY = sql(f"""SELECT plan_id, slot, shot_id, {r6('score')} AS score, pinned FROM pick WHERE slot >= 0""", *CAND[:4],
    ("plans", "SELECT *, asset_id // 40 AS plan_id FROM prt"),
    ("pins", "SELECT plan_id, min(shot_id) AS pin FROM plans WHERE plan_id % 3 = 0 GROUP BY 1"),
    ("pick", f"""SELECT DISTINCT plan_id, CAST(-1 AS BIGINT) AS slot, CAST(NULL AS VARCHAR) AS shot_id, CAST(0 AS DOUBLE) AS score, false AS pinned, CAST([] AS VARCHAR[]) AS shots_used, CAST([] AS BIGINT[]) AS assets_used FROM plans
        UNION ALL SELECT plan_id, slot, shot_id, score, pinned, list_append(shots_used, shot_id), list_append(assets_used, asset_id) FROM (
        SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY NOT pinned, shot_id IS NOT DISTINCT FROM before, round(score, 9) DESC, shot_id) AS place FROM (
        SELECT n.plan_id, CAST(n.slot AS BIGINT) AS slot, n.shot_id, CAST(n.asset_id AS BIGINT) AS asset_id, b.shot_id AS before, n.slot = 1 AND x.pin IS NOT DISTINCT FROM n.shot_id AS pinned, b.shots_used, b.assets_used,
          (0.22 * e + 0.16 * m + 0.12 * l + 0.14 * 0.8 * n.technical_quality + 0.12 * n.creative_value + 0.18 * 1.3 * {cont_sql('p', 'n')} + 0.06 * rf)
          / (0.22 + 0.16 + 0.12 + 0.14 * 0.8 + 0.12 + 0.18 * 1.3 + 0.06) * hf * CASE WHEN list_contains(b.shots_used, n.shot_id) THEN 0.66 ELSE 1 END * CASE WHEN list_contains(b.assets_used, n.asset_id) THEN 0.93 ELSE 1 END AS score
        FROM pick b JOIN plans n ON n.plan_id = b.plan_id AND n.slot = b.slot + 1 LEFT JOIN shots p ON p.shot_id = b.shot_id LEFT JOIN pins x ON x.plan_id = n.plan_id)) WHERE place = 1"""), recursive=True)


@query("assign_greedy", GREEDY)
def assign_greedy(spark, sf):
    """Library of each customer-sized group of assets, three slots each."""
    s = V.shots(spark, sf).filter("asset_id IS NOT NULL").withColumn("plan_id", F.floor(c("asset_id") / 40).cast("long"))
    d = slotted(s)
    pins = s.groupBy("plan_id").agg(F.min("shot_id").alias("shot_id")).filter("plan_id % 3 = 0").withColumn("slot", F.lit(1).cast("long"))
    return P.assign_greedy(d, pins, KNOBS).select("plan_id", "slot", "shot_id", R(c("score")).alias("score"), "pinned")


SLOTTED = [
    *EDIT, PACE, *[(n.replace("ends", "lv_ends"), t.replace("JOIN ends", "JOIN lv_ends")) for n, t in ENERGY],
    ("bt", "SELECT series_id, t / 86400 AS t FROM sig WHERE kind = 'click'"),
    ("bk", "SELECT series_id, min(t) AS t FROM bt GROUP BY 1 UNION ALL SELECT k.series_id, min(p.t) FROM bk k JOIN bt p ON p.series_id = k.series_id AND p.t - k.t >= 0.05 GROUP BY k.series_id, k.t"),
    ("bl", "SELECT series_id, list(t ORDER BY t) FILTER (t >= 1.0) AS grid FROM bk GROUP BY 1"),
    ("en", "SELECT series_id, list({'t': t / 86400, 'e': e} ORDER BY t) AS heard, arg_max(e, t) AS last FROM energy GROUP BY 1"),
    ("pln", """SELECT *, greatest(0.05, CASE WHEN coalesce(p90, 0) = 0 THEN 1.2 ELSE p90 END - short) AS span FROM (SELECT style_id AS plan_id, p10, med, p90, greatest(0.12, CASE WHEN coalesce(p10, 0) = 0 THEN 0.3 ELSE p10 END) AS short,
        coalesce(grid, []) AS grid, heard, last FROM pace LEFT JOIN bl ON bl.series_id = style_id LEFT JOIN en ON en.series_id = style_id)"""),
    ("stp", """SELECT plan_id, CAST(-1 AS BIGINT) AS k, 0.0::DOUBLE AS here, 1.0::DOUBLE AS fin, 0.0::DOUBLE AS level FROM pln UNION ALL
        SELECT plan_id, k + 1, here, fin, level FROM (SELECT *, least(CASE WHEN abs(near - goal) < 0.275 THEN near ELSE goal END, 25.0) AS fin FROM (
          SELECT *, list_sort(list_transform(grid, lambda b: {'d': abs(b - goal), 'b': b}))[1].b AS near FROM (
            SELECT *, here + greatest(1, round_even(least(greatest((short + span - span * level) * 0.8, 0.12), 4.0) / 0.5, 0)) * 0.5 AS goal FROM (
              SELECT p.*, k, here, least(greatest((0.55 * [0.2, 0.5, 0.9, 0.7][CAST(floor(3 * least(greatest((here - 1) / 24, 0), 1)) AS INT) + 1] + 0.45 * coalesce(list_filter(heard, lambda h: h.t >= here)[1].e, last, 0.5)) * 1.1 + 0.05, 0), 1) AS level
              FROM (SELECT plan_id, k, fin AS here FROM stp WHERE fin < 24.88) JOIN pln p USING (plan_id))))) WHERE fin - here >= 0.1"""),
    ("fls", """SELECT s.*, p10 > 0 AND p10 <= 0.45 AND p10 <= 0.6 * coalesce(med, 0) AND k > 0 AND level >= 0.72 AND fin - here >= 3 * 0.2 AS flash FROM stp s JOIN pln USING (plan_id) WHERE k >= 0"""),
    ("slt", """SELECT plan_id, CASE WHEN flash THEN here + 0.2 ELSE here END AS a, fin AS b, false AS p, level FROM fls UNION ALL SELECT plan_id, here, here + 0.2, true, least(1.0, level + 0.15) FROM fls WHERE flash"""),
]


@query("plan_slots", sql(f"""SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY a) - 1 AS slot, {r6('a')} AS slot_start, {r6('b')} AS slot_end,
    CASE WHEN p THEN 'punctuation' WHEN (a - 1) * 31.0::DOUBLE / 24 < 3 THEN 'hook' WHEN (a - 1) * 31.0::DOUBLE / 24 < 20 THEN 'escalation' ELSE 'climax' END AS role, {r6('level')} AS intensity FROM slt""", *SLOTTED, recursive=True))
def plan_slots(spark, sf):
    from ..operators import style as G
    e = edit(spark, sf)
    music = energy(spark, sf).select(c("series_id").alias("plan_id"), (c("t") / 86400).alias("t"), "energy")
    # Beats of one grid lie apart; that bounds what one plan can hold.
    beats = keep_spaced(V.beats(spark, sf).select(c("series_id").alias("plan_id"), (c("beat") / 86400).alias("t")), ["plan_id"], "t", 0.05)
    pace = G.pacing_profile(e, lengths_of(e)).withColumnRenamed("style_id", "plan_id")
    arc = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end")) for r, a, b in (("hook", 0.0, 3.0), ("escalation", 3.0, 20.0), ("climax", 20.0, 31.0))])
    plans = pace.withColumns({"start_offset": F.lit(1.0), "target": F.lit(24.0), "beat_interval": F.lit(0.5), "pacing": F.lit(1.0), "arc": arc, "arc_duration": F.lit(31.0),
                              "curve": F.array(*[F.lit(x) for x in (0.2, 0.5, 0.9, 0.7)]), "intensity_gain": F.lit(1.1), "intensity_offset": F.lit(0.05),
                              "pacing_multiplier": F.lit(0.8), "min_shot_floor": F.lit(0.12), "max_shot_ceiling": F.lit(4.0), "effect_density": F.lit(0.5)})
    d = P.plan_slots(plans, beats, music)
    return d.select("plan_id", "slot", R(c("start")).alias("slot_start"), R(c("end")).alias("slot_end"), "role", R(c("intensity")).alias("intensity"))


# ------------------------------------------------------------------ building

BESTW = ("bw", """SELECT * FROM (SELECT c.series_id, c.clip_id, greatest(w_start, c_in) AS a, least(w_end, c_out) AS b, row_number() OVER (PARTITION BY c.clip_id ORDER BY least(w_end, c_out) - greatest(w_start, c_in) DESC, w_start) AS r
    FROM clip c JOIN win w ON w.series_id = c.series_id AND w_end > c_in AND w_start < c_out AND w_end > w_start) WHERE r = 1""")


@query("pick_in_point", sql(f"""SELECT series_id, clip_id, {r6('p')} AS in_point, {r6('CASE WHEN 3600.0 <= need THEN c_out ELSE p + need END')} AS out_point FROM (
    SELECT *, CASE WHEN 3600.0 <= need THEN c_in WHEN b - a >= least(need, 0.2) THEN greatest(c_in, least((a + b) / 2 - need / 2, c_out - need))
      ELSE c_in + least(3600 * 0.12, greatest(0, 3600 - need)) + (3600 - least(3600 * 0.12, greatest(0, 3600 - need)) - need) * 0.35 END AS p FROM (
      SELECT c.*, a, b, CASE WHEN c.clip_id % 7 = 0 THEN least(200.0, 100.0 + c.clip_id % 4000) ELSE 100.0 + c.clip_id % 4000 END AS need FROM clip c LEFT JOIN bw USING (series_id, clip_id)))""", BESTW))
def pick_in_point(spark, sf):
    d = V.clips(spark, sf).withColumns({"need": 100.0 + c("clip_id") % 4000, "max_useful_duration": F.when(c("clip_id") % 7 == 0, 200.0)})
    d = T.pick_in_point(d, V.windows(spark, sf))
    return d.select("series_id", "clip_id", R(c("in_point")).alias("in_point"), R(c("out_point")).alias("out_point"))


@query("quantize_clips", sql(f"""SELECT shot_id, {r6('s')} AS tl_start, {r6('d')} AS dur, {r6('sp')} AS speed, {r6('CASE WHEN duration < d - 1e-4 AND d - duration / sp > 1e-4 THEN d - duration / sp ELSE 0 END')} AS hold FROM (
    SELECT *, CASE WHEN duration < d - 1e-4 THEN least(greatest(duration / d, 0.5), 1) ELSE 1 END AS sp FROM (SELECT shot_id, duration, s, greatest(1 / 30.0::DOUBLE, round_even((warmth + 3.0 + shake) * 30, 0) / 30 - s) AS d FROM (
      SELECT *, round_even((warmth + 3.0) * 30, 0) / 30 AS s FROM shots)))"""))
def quantize_clips(spark, sf):
    d = V.shots(spark, sf).withColumns({"begin": c("warmth") + 3.0, "finish": c("warmth") + 3.0 + c("shake")})
    d = T.place(d, 30.0, "begin", "finish", "duration")
    return d.select("shot_id", *[R(c(x)).alias(x) for x in ("tl_start", "dur", "speed", "hold")])


FIT = ("fit", """SELECT n.timeline_id, n.idx, n.dur, CASE WHEN p.idx IS NULL THEN NULL ELSE least(greatest(least(n.flow_magnitude, p.flow_magnitude) / 2.5 *
      CASE WHEN abs(mod(mod(p.flow_direction_deg - n.flow_direction_deg + 180, 360) + 360, 360) - 180) < 60 THEN 1.25 ELSE 0.8 END * (n.intensity + 0.6), 0), 1) END AS whip,
    CASE WHEN p.idx IS NULL THEN NULL ELSE least(greatest(CASE WHEN n.on_drop THEN 0.6 ELSE 0 END + n.intensity * 0.5 + abs(n.brightness - p.brightness) * 1.1, 0), 1) END AS flash,
    CASE WHEN p.idx IS NULL THEN NULL ELSE least(greatest((1 - n.intensity) * 0.9 + CASE WHEN n.role = 'release' THEN 0.2 ELSE 0 END, 0), 1) END AS dissolve
    FROM tl n LEFT JOIN tl p ON p.timeline_id = n.timeline_id AND p.idx = n.idx - 1""")


@query("transition_fit", sql(f"SELECT timeline_id, idx, {r6('whip')} AS whip, {r6('flash')} AS flash, {r6('dissolve')} AS dissolve FROM fit", TL, FIT))
def transition_fit(spark, sf):
    return T.transition_fit(timeline(spark, sf)).select("timeline_id", "idx", *[R(c(f"fit.{k}")).alias(k) for k in T.KINDS])


QUOTA = [
    ("qt0", """SELECT timeline_id, n, CAST(round_even((timeline_id % 5) / 10.0::DOUBLE * n, 0) AS BIGINT) AS w, CAST(round_even((timeline_id % 4) / 8.0::DOUBLE * n, 0) AS BIGINT) AS f, CAST(round_even((timeline_id % 3) / 6.0::DOUBLE * n, 0) AS BIGINT) AS d
        FROM (SELECT timeline_id, count(*) - 1 AS n FROM tl GROUP BY 1)"""),
    ("qt", """SELECT timeline_id, kind, q, row_number() OVER (PARTITION BY timeline_id ORDER BY q DESC, i) AS turn FROM (
        SELECT timeline_id, unnest(['whip', 'flash', 'dissolve']) AS kind, unnest([1, 2, 3]) AS i, unnest([floor(w * s), floor(f * s), floor(d * s)]) AS q FROM (
          SELECT *, CASE WHEN w + f + d > n * 0.6 THEN n * 0.6 / (w + f + d) ELSE 1 END AS s FROM qt0))"""),
]
QUOTA.append(("ft", "SELECT f.timeline_id, idx, dur, kind, turn, q, CASE kind WHEN 'whip' THEN whip WHEN 'flash' THEN flash ELSE dissolve END AS fv FROM fit f JOIN qt USING (timeline_id) WHERE idx >= 1"))
for _t in (1, 2, 3):
    _free = " AND ".join(f"NOT EXISTS (SELECT 1 FROM tk{j} x WHERE x.timeline_id = ft.timeline_id AND x.idx = ft.idx)" for j in range(1, _t)) or "true"
    QUOTA.append((f"tk{_t}", f"""SELECT timeline_id, idx, kind, fv FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY fv DESC, idx) AS r FROM ft WHERE turn = {_t} AND {_free}) WHERE r <= q AND fv >= 0.25"""))
QUOTA.append(("tk", "SELECT * FROM tk1 UNION ALL SELECT * FROM tk2 UNION ALL SELECT * FROM tk3"))


@query("allocate_transitions", sql(f"""SELECT t.timeline_id, t.idx, CASE WHEN t.idx = 0 THEN NULL ELSE coalesce(kind, 'cut') END AS transition,
    {r6("CASE WHEN t.idx = 0 THEN NULL WHEN kind IS NULL THEN 0.0 ELSE least(CASE kind WHEN 'whip' THEN 0.13 WHEN 'flash' THEN 0.07 ELSE 0.22 END, t.dur * 0.45) END")} AS tdur
    FROM tl t LEFT JOIN tk USING (timeline_id, idx)""", TL, FIT, *QUOTA))
def allocate_transitions(spark, sf):
    d = stage(T.transition_fit(timeline(spark, sf)).select("timeline_id", "idx", "dur", "fit"))
    k = c("timeline_id")
    shares = d.select("timeline_id").distinct().withColumns({"whip_share": (k % 5) / 10.0, "flash_share": (k % 4) / 8.0, "dissolve_share": (k % 3) / 6.0})
    return T.allocate_transitions(d, shares).select("timeline_id", "idx", "transition", R(c("tdur")).alias("tdur"))


STYLE = {"warmth": 0.2, "contrast": 0.6, "saturation": 0.5}
EFFECTS = """list_concat(list_filter([CASE WHEN abs(width / height - 1080.0 / 1920) > 0.05 THEN 'reframe' END,
    CASE WHEN camera_movement = 'static' AND visual_energy > 0.42 THEN 'push_zoom' END, CASE WHEN camera_movement = 'push_in' AND visual_energy > 0.7 THEN 'push_zoom' END,
    CASE WHEN camera_movement = 'pull_out' AND visual_energy < 0.4 THEN 'pull_zoom' END,
    CASE WHEN visual_energy > 0.82 - 0.5 * 0.25 AND shake < 1.5 AND l_partkey % 2 = 0 THEN 'shake' END], lambda x: x IS NOT NULL),
    list_transform(list_filter(df, lambda x: NOT (x = 'softness' AND noise > 0.45 AND NOT list_contains(df, 'noise'))),
      lambda x: CASE x WHEN 'noise' THEN 'denoise' WHEN 'softness' THEN 'sharpen' WHEN 'blockiness' THEN 'deblock' WHEN 'shake' THEN 'stabilize' ELSE 'expand_contrast' END),
    list_filter([CASE WHEN verdict = 'enhance' AND (contrast < 0.54 OR saturation < 0.45 OR exposure_health < 0.8) THEN 'color_grade' END, 'color_grade',
      CASE WHEN verdict = 'use_briefly' AND duration <= 0.4 THEN 'directional_blur' END], lambda x: x IS NOT NULL))[1:5]"""


@query("choose_effects", sql(f"SELECT shot_id, array_to_string(e, ',') AS effects, array_to_string(list_filter(['deblock', 'denoise', 'expand_contrast', 'sharpen', 'stabilize'], lambda x: list_contains(e, x)), ',') AS treatments FROM (SELECT *, {EFFECTS} AS e FROM h4)", *VERDICT))
def choose_effects(spark, sf):
    d = scores.assess(V.shots(spark, sf)).withColumns({
        "intensity": c("visual_energy"), "role": F.when(c("l_partkey") % 2 == 0, "climax").otherwise("setup"), "slot_duration": c("duration"), "src_aspect": c("width") / c("height")})
    d = T.choose_effects(d, 1080 / 1920, STYLE)
    return d.select("shot_id", names().alias("effects"), F.array_join("treatments", ",").alias("treatments"))


REFLOW = [
    ("rf0", "SELECT *, CASE WHEN l_partkey % 53 = 0 THEN round_even((0.4 + idx % 5) * 30, 0) END AS ff FROM tl"),
    ("rf1", "SELECT *, min(CASE WHEN ff IS NOT NULL THEN idx END) OVER (PARTITION BY timeline_id) AS fi FROM rf0"),
    ("rf2", """SELECT *, coalesce(max(CASE WHEN idx = fi - 1 THEN tl_start + dur END) OVER (PARTITION BY timeline_id), max(CASE WHEN idx = fi THEN tl_start END) OVER (PARTITION BY timeline_id)) AS bs,
        coalesce(sum(CASE WHEN idx >= fi THEN coalesce(ff, round_even(dur * 30, 0)) ELSE 0 END) OVER (PARTITION BY timeline_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM rf1"""),
    ("rf3", "SELECT *, (round_even(bs * 30, 0) + bf) / 30 AS ns, coalesce(idx >= fi AND abs((round_even(bs * 30, 0) + bf) / 30 - tl_start) > 1e-6, false) AS moved FROM rf2"),
]


@query("reflow_durations", sql(f"SELECT timeline_id, idx, moved, {r6('CASE WHEN moved THEN ns ELSE tl_start END')} AS tl_start, {r6('CASE WHEN ff IS NOT NULL THEN ff / 30 ELSE dur END')} AS dur, beat_locked AND NOT moved AS beat_locked FROM rf3", TL, *REFLOW))
def reflow_durations(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "idx", "tl_start", "dur", "beat_locked", "l_partkey"))
    forced = t.filter("l_partkey % 53 = 0").select("timeline_id", "idx", (0.4 + c("idx") % 5).alias("forced"))
    d = T.reflow_durations(t, forced, 30.0)
    return d.select("timeline_id", "idx", "moved", R(c("tl_start")).alias("tl_start"), R(c("dur")).alias("dur"), "beat_locked")


# ------------------------------------------------------------------ checks

def _rule(cond, code, sev="error"):
    return f"SELECT timeline_id, clip_id AS subject, '{sev}' AS severity, '{code}' AS code FROM tv WHERE {cond}"


VALID = [
    ("tv", "SELECT *, lag(tl_start + dur) OVER (PARTITION BY timeline_id ORDER BY idx) AS pe FROM tl"),
    ("prj", """SELECT s_suppkey AS timeline_id, CASE WHEN s_suppkey % 17 = 0 THEN '2.0.0' ELSE '1.0.0' END AS ver, CASE WHEN s_suppkey % 7 = 0 THEN 1081 ELSE 1080 END AS w, CASE WHEN s_suppkey % 11 = 0 THEN 300 ELSE 30 END AS fps FROM supplier"""),
    ("drf", """SELECT t.timeline_id, t.clip_id, t.idx, min(abs(b.beat / 1000 - t.tl_start)) AS err FROM tl t JOIN beats b ON b.series_id = t.timeline_id WHERE t.beat_locked GROUP BY 1, 2, 3"""),
]
ISSUES = " UNION ALL ".join([
    _rule("source_out <= source_in", "bad_range"), _rule("dur < 0.08", "too_short"), _rule("speed NOT BETWEEN 0.1 AND 8", "bad_speed"),
    _rule("handling = 'use_briefly' AND dur > 0.55", "brief_overrun", "warning"), _rule("handling = 'reject'", "rejected_clip"), _rule("len(fx) > 5", "effect_density", "warning"),
    _rule("transition = 'bogus'", "unknown_transition"), _rule("tdur > dur * 0.6", "transition_too_long"), _rule("tl_start - pe > 0.001", "gap"),
    _rule("tl_start - pe < -0.001 AND pe - tl_start - tdur > 0.02", "overlap"), _rule("list_contains(fx, 'sparkle')", "unknown_effect"),
    _rule("list_contains(fx, 'push_zoom') AND 1 + shake > 3", "param_range"), _rule("list_contains(fx, 'film_grain') AND noise * 2 > 1", "param_range"),
    "SELECT timeline_id, clip_id, 'error', 'dup_id' FROM (SELECT *, row_number() OVER (PARTITION BY timeline_id, clip_id) AS k FROM tl) WHERE k > 1",
    "SELECT timeline_id, '', 'error', 'schema' FROM prj WHERE ver = '2.0.0' AND timeline_id IN (SELECT timeline_id FROM tl)",
    "SELECT timeline_id, '', 'error', 'project' FROM prj WHERE w % 2 = 1", "SELECT timeline_id, '', 'error', 'project' FROM prj WHERE fps > 240",
    "SELECT timeline_id, '', 'error', 'empty' FROM prj WHERE timeline_id NOT IN (SELECT timeline_id FROM tl)",
    "SELECT timeline_id, clip_id, 'warning', 'beat_drift' FROM drf WHERE err > 0.055", "SELECT DISTINCT timeline_id, '', 'warning', 'beat_drift_total' FROM drf WHERE err > 0.055"])


@query("validate_timeline", sql(ISSUES, TL, *VALID))
def validate_timeline(spark, sf):
    k = c("s_suppkey")
    prj = table(spark, sf, "supplier").select(k.alias("timeline_id"), F.when(k % 17 == 0, "2.0.0").otherwise("1.0.0").alias("schema_version"),
                                              F.when(k % 7 == 0, 1081).otherwise(1080).alias("width"), F.lit(1920).alias("height"), F.when(k % 11 == 0, 300).otherwise(30).alias("fps"))
    beats = V.beats(spark, sf).select(c("series_id").alias("timeline_id"), (c("beat") / 1000).alias("beat"))
    t = stage(timeline(spark, sf).select("timeline_id", "idx", "clip_id", "tl_start", "dur", "source_in", "source_out", "speed", "handling", "effects", "transition", "tdur", "beat_locked"))
    return T.validate_timeline(t, prj, beats, time_width=600.0)


METRIC = ("mt", """SELECT timeline_id, count(*) AS clips, max(tl_start + dur) AS duration, avg(dur) AS mean_shot, min(dur) AS min_shot, max(dur) AS max_shot, CAST(sum(len(fx)) AS BIGINT) AS total_effects,
    count(CASE WHEN transition = 'cut' THEN 1 END) AS cut, count(CASE WHEN transition = 'dissolve' THEN 1 END) AS ds, count(CASE WHEN transition IN ('flash', 'whip') THEN 1 END) AS sh,
    CAST(sum(CASE WHEN list_contains(fx, 'film_grain') THEN 1 ELSE 0 END) AS BIGINT) AS grain FROM tl GROUP BY 1""")


@query("timeline_metrics", sql(f"""SELECT timeline_id, clips, {r6('duration')} AS duration, {r6('mean_shot')} AS mean_shot, {r6('clips / duration')} AS cuts_per_second, {r6('total_effects / clips')} AS effects_per_clip,
    {r6('cut / (clips - 1)')} AS hard_cut_share, {r6('ds / (clips - 1)')} AS dissolve_share, {r6('sh / (clips - 1)')} AS showy_share, grain AS film_grain_effects FROM mt""", TL, METRIC))
def timeline_metrics(spark, sf):
    d = T.timeline_metrics(timeline(spark, sf))
    return d.select("timeline_id", "clips", *[R(c(x)).alias(x) for x in ("duration", "mean_shot", "cuts_per_second", "effects_per_clip", "hard_cut_share", "dissolve_share", "showy_share")], "film_grain_effects")


SPAN = ("sp", """SELECT *, own / 2 AS head, coalesce(lead(own) OVER (PARTITION BY timeline_id ORDER BY idx) / 2, 0) AS tail FROM (SELECT *, CASE WHEN transition = 'cut' THEN 0 ELSE tdur END AS own FROM tl)""")


@query("segment_spans", sql(f"SELECT timeline_id, idx, {r6('head')} AS head, {r6('tail')} AS tail, {r6('dur + head + tail')} AS length FROM sp", TL, SPAN))
def segment_spans(spark, sf):
    return T.segment_spans(timeline(spark, sf)).select("timeline_id", "idx", *[R(c(x)).alias(x) for x in ("head", "tail", "length")])


@query("changed_segments", sql("SELECT timeline_id, idx FROM tl WHERE l_partkey % 29 = 0", TL))
def changed_segments(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "idx", "clip_id", "source_in", "source_out", "speed", "dur", "transition", "tdur", "l_partkey"))
    new = t.withColumn("speed", F.when(c("l_partkey") % 29 == 0, c("speed") + 0.5).otherwise(c("speed")))
    return T.changed_segments(t, new, "1080x1920@30").select("timeline_id", "idx")


RANK = "CASE x WHEN 'reframe' THEN 0 WHEN 'push_zoom' THEN 1 WHEN 'sparkle' THEN 5 WHEN 'glow' THEN 7 ELSE 9 END"


@query("order_effects", sql(f"SELECT timeline_id, idx, coalesce(string_agg(x, ',' ORDER BY {RANK}, p), '') AS effects FROM (SELECT timeline_id, idx, unnest(fx) AS x, unnest(range(len(fx))) AS p FROM tl) GROUP BY 1, 2", TL))
def order_effects(spark, sf):
    d = timeline(spark, sf).filter(F.size("effects") > 0)
    return d.withColumn("effects", T.order_effects(c("effects"))).select("timeline_id", "idx", names().alias("effects"))


PRIO = "CASE x WHEN 'reframe' THEN 0 WHEN 'push_zoom' THEN 2 WHEN 'film_grain' THEN 5 WHEN 'glow' THEN 7 ELSE 9 END"


@query("revise", sql(f"""SELECT timeline_id, idx, CASE WHEN idx = fi AND timeline_id % 2 = 0 THEN 'flash' ELSE transition END AS transition,
    array_to_string(list_concat(CASE WHEN l_partkey % 5 <> 0 AND timeline_id % 3 = 0 AND len(fx) > 2 THEN st ELSE fx END, CASE WHEN l_partkey % 5 <> 0 AND timeline_id % 7 = 0 THEN ['color_grade'] ELSE [] END), ',') AS effects FROM (
    SELECT t.*, min(CASE WHEN l_partkey % 5 <> 0 AND transition = 'cut' THEN t.idx END) OVER (PARTITION BY timeline_id) AS fi, st FROM tl t LEFT JOIN (
      SELECT timeline_id, idx, list(x ORDER BY {PRIO}, p)[1:2] AS st FROM (SELECT timeline_id, idx, unnest(fx) AS x, unnest(range(len(fx))) AS p FROM tl) GROUP BY 1, 2) USING (timeline_id, idx))""", TL))
def revise(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "idx", "transition", "tdur", "effects", "l_partkey"))
    k = c("timeline_id")
    acts = t.select("timeline_id").distinct().withColumn("a", F.explode(F.array(
        F.struct((k % 2 == 0).alias("on"), F.lit("soften_bright_cuts").alias("action"), F.lit(62).alias("target")),
        F.struct((k % 3 == 0).alias("on"), F.lit("strip_lowest_value_effects").alias("action"), F.lit(2).alias("target")),
        F.struct((k % 7 == 0).alias("on"), F.lit("harmonize_exposure").alias("action"), F.lit(0).alias("target"))))).filter("a.on").select("timeline_id", "a.action", "a.target")
    d = T.revise(t, acts, t.filter("l_partkey % 5 = 0"))
    return d.select("timeline_id", "idx", "transition", names().alias("effects"))


SNAP = [("bl", "SELECT series_id AS timeline_id, list(beat / 1000 ORDER BY beat) AS bl FROM beats GROUP BY 1"),
        ("sn0", """SELECT t.timeline_id, t.idx, t.tl_start, t.dur, t.l_partkey, t.source_in, t.source_out, t.speed, list_transform(bl, lambda x: x - bl[1]) AS bs FROM tl t LEFT JOIN bl USING (timeline_id)"""),
        ("sn", """SELECT timeline_id, 0::BIGINT AS i, 0::DOUBLE AS f FROM (SELECT DISTINCT timeline_id FROM sn0) UNION ALL
          SELECT sn.timeline_id, i + 1, greatest(f + 1, round_even(coalesce(list_sort(list_transform(list_filter(bs, lambda x: abs(x - (f / 30 + dur)) < 0.2), lambda x: {'d': abs(x - (f / 30 + dur)), 'b': x}))[1].b, f / 30 + dur) * 30, 0))
          FROM sn JOIN sn0 ON sn0.timeline_id = sn.timeline_id AND sn0.idx = sn.i"""),
        ("sn1", """SELECT s.*, a.f / 30 AS a, CASE WHEN l_partkey % 9 = 0 THEN dur ELSE (b.f - a.f) / 30 END AS len FROM sn0 s JOIN sn a ON a.timeline_id = s.timeline_id AND a.i = s.idx JOIN sn b ON b.timeline_id = s.timeline_id AND b.i = s.idx + 1""")]


@query("resnap_to_beats", sql(f"""SELECT timeline_id, idx, {r6('CASE WHEN bs IS NULL THEN tl_start ELSE a END')} AS tl_start, {r6('CASE WHEN bs IS NULL THEN dur ELSE len END')} AS dur,
    {r6('CASE WHEN bs IS NULL THEN 0 ELSE greatest(0, len - (source_out - source_in) / speed) END')} AS hold FROM sn1""", TL, *SNAP, recursive=True))
def resnap_to_beats(spark, sf):
    t = stage(timeline(spark, sf).select("timeline_id", "idx", "tl_start", "dur", "l_partkey", "source_in", "source_out", "speed"))
    beats = V.beats(spark, sf).select(c("series_id").alias("timeline_id"), (c("beat") / 1000).alias("beat"))
    d = T.resnap_to_beats(t, beats, 30.0, t.filter("l_partkey % 9 = 0"))
    return d.select("timeline_id", "idx", R(c("tl_start")).alias("tl_start"), R(c("dur")).alias("dur"), R(c("hold")).alias("hold"))


@query("on_frame", sql(f"SELECT shot_id, {r6('round_even(duration * 24, 0) / 24')} AS t FROM shots"))
def frames(spark, sf):
    return V.shots(spark, sf).select("shot_id", R(on_frame(c("duration"), 24.0)).alias("t"))

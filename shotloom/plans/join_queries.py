"""Time and interval matches over the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import joins as J
from ..sources import views as V
from .oracle import r6, sql
from .registry import query
from .series_queries import ENERGY, energy

NEAREST = [("nb", """SELECT c.series_id, c.event_id, c.cut, b.beat,
    row_number() OVER (PARTITION BY c.event_id ORDER BY abs(b.beat - c.cut), b.beat) AS r
    FROM cuts c LEFT JOIN beats b USING (series_id)"""),
           ("nearest", "SELECT series_id, event_id, cut, coalesce(beat, cut) AS nearest FROM nb WHERE r = 1")]


@query("key_lookup", sql(f"SELECT shot_id, p_brand, {r6('duration')} AS duration FROM shots JOIN part ON p_partkey = l_partkey"))
def key_lookup(spark, sf):
    from ..session import table
    dim = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return J.look_up(V.shots(spark, sf), dim, "l_partkey", "inner").select("shot_id", "p_brand", R(F.col("duration")).alias("duration"))


@query("allowed_shots", sql("""SELECT shot_id FROM shots
    WHERE asset_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW')
      AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"""))
def allowed_shots(spark, sf):
    from ..session import table
    ok = table(spark, sf, "orders").filter(F.col("o_orderpriority") != "5-LOW") \
        .select(F.col("o_orderkey").alias("asset_id"))
    bad = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    d = J.allowed(V.shots(spark, sf), ok, None, "asset_id")
    return J.allowed(d, None, bad, "l_suppkey").select("shot_id")


@query("energy_at", sql(f"""SELECT q.series_id, q.event_id, {r6('coalesce(e.e, l.last, 0.5)')} AS energy FROM cuts q
    ASOF LEFT JOIN energy e ON e.series_id = q.series_id AND e.t >= q.cut
    LEFT JOIN (SELECT series_id, arg_max(e, t) AS last FROM energy GROUP BY 1) l ON l.series_id = q.series_id""", *ENERGY))
def energy_at(spark, sf):
    d = J.energy_at(V.cuts(spark, sf), energy(spark, sf).select("series_id", "t", "energy"), at="cut")
    return d.select("series_id", "event_id", R(F.col("energy_at")).alias("energy"))


@query("nearest_beat", sql(f"SELECT series_id, event_id, {r6('nearest')} AS nearest FROM nearest", *NEAREST))
def nearest_beat(spark, sf):
    d = J.nearest_beat(V.cuts(spark, sf), V.beats(spark, sf))
    return d.select("series_id", "event_id", R(F.col("nearest")).alias("nearest"))


@query("snap_within", sql(f"""SELECT series_id, event_id,
    {r6('CASE WHEN abs(nearest - cut) < 7200.0 THEN nearest ELSE cut END')} AS snapped FROM nearest""", *NEAREST))
def snap_within(spark, sf):
    d = J.snap_within(V.cuts(spark, sf), V.beats(spark, sf), 7200.0)
    return d.select("series_id", "event_id", R(F.col("snapped")).alias("snapped"))


@query("beats_in", sql(f"""SELECT w.series_id, {r6('w_start')} AS w_start, {r6('beat')} AS beat FROM win w
    JOIN beats b ON b.series_id = w.series_id AND b.beat BETWEEN w.w_start AND w.w_end"""))
def beats_in(spark, sf):
    d = J.points_in(V.windows(spark, sf), V.beats(spark, sf))
    return d.select("series_id", R(F.col("w_start")).alias("w_start"), R(F.col("beat")).alias("beat"))


@query("beat_counts", sql(f"""SELECT w.series_id, {r6('w_start')} AS w_start, count(beat) AS hits FROM win w
    LEFT JOIN beats b ON b.series_id = w.series_id AND b.beat BETWEEN w.w_start AND w.w_end GROUP BY w.series_id, w.w_start"""))
def beat_counts(spark, sf):
    return J.count_in(V.windows(spark, sf), V.beats(spark, sf)).select("series_id", R(F.col("w_start")).alias("w_start"), "hits")


@query("near_drop", sql("""SELECT series_id, event_id, coalesce(abs(beat - cut) < 3600.0, false) AS near FROM nb WHERE r = 1""", *NEAREST[:1]))
def near_drop(spark, sf):
    d = J.near_any(V.cuts(spark, sf), V.beats(spark, sf), 3600.0, mark="beat")
    return d.select("series_id", "event_id", "near")


OVERLAP = ("ov", """SELECT c.series_id, c.clip_id, sum(greatest(0.0, least(w_end, c_out) - greatest(w_start, c_in))) AS overlap,
    max(least(w_end, c_out) - greatest(w_start, c_in)) AS longest
    FROM clip c JOIN win w ON w.series_id = c.series_id GROUP BY 1, 2""")


@query("speech_overlap", sql(f"SELECT series_id, clip_id, {r6('overlap')} AS overlap FROM ov WHERE overlap >= 0.25", OVERLAP))
def speech_overlap(spark, sf):
    d = J.speech_overlap(V.clips(spark, sf), V.windows(spark, sf))
    return d.select("series_id", "clip_id", R(F.col("overlap")).alias("overlap"))


@query("has_speech", sql("SELECT c.series_id, c.clip_id, coalesce(longest > 0.25, false) AS speech FROM clip c LEFT JOIN ov USING (series_id, clip_id)", OVERLAP))
def has_speech(spark, sf):
    return J.has_speech(V.clips(spark, sf), V.windows(spark, sf)).select("series_id", "clip_id", "speech")


@query("role_at", sql("""SELECT series_id, event_id,
    CASE WHEN series_id % 2 = 0 THEN
      CASE WHEN t < 0.1 * duration THEN 'hook' WHEN t < 0.5 * duration THEN 'setup' WHEN t < 0.8 * duration THEN 'climax' ELSE 'release' END
    ELSE CASE WHEN t / duration < 0.12 THEN 'hook' WHEN t / duration < 0.45 THEN 'setup' WHEN t / duration < 0.75 THEN 'escalation'
      WHEN t / duration < 0.92 THEN 'climax' ELSE 'release' END END AS role
    FROM sig JOIN dur USING (series_id)""", ("dur", "SELECT series_id, max(t) AS duration FROM sig GROUP BY 1")))
def role_at(spark, sf):
    sig = V.raw_series(spark, sf)
    d = sig.join(sig.groupBy("series_id").agg(F.max("t").alias("duration")), "series_id")
    arc = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(a).alias("start"), F.lit(b).alias("end"))
                    for r, a, b in (("hook", 0.0, 1.0), ("setup", 1.0, 5.0), ("climax", 5.0, 8.0), ("release", 8.0, 10.0))])
    arc = F.when(F.col("series_id") % 2 == 0, arc).otherwise(F.slice(arc, 1, 0))
    return d.select("series_id", "event_id", J.role_at(F.col("t"), F.col("duration"), arc, F.lit(10.0)).alias("role"))


@query("predecessor", sql(f"""SELECT series_id, event_id, kind, prev_kind, {r6('t - prev_t')} AS gap FROM (
    SELECT *, lag(kind) OVER w AS prev_kind, lag(t) OVER w AS prev_t FROM sig WINDOW w AS (PARTITION BY series_id ORDER BY n))"""))
def predecessor(spark, sf):
    from ..operators.blocks import framed
    d = framed(V.series(spark, sf), ["series_id"], "n", 1, 0, {"_p": lambda w: F.lag(F.struct("kind", "t")).over(w)})
    return d.select("series_id", "event_id", "kind", F.col("_p.kind").alias("prev_kind"), R(F.col("t") - F.col("_p.t")).alias("gap"))

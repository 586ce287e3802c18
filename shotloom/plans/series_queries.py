"""Series operators over the event series of every user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import peaks, series as S
from ..operators.blocks import asof, quantiles
from ..session import stage
from ..sources import views as V
from .oracle import r6, sql
from .registry import query

SENS = 6.0            # event values jump less than pixels do, so the detector is set more sensitive
GAP = 43200.0         # half a day, the role of the shortest shot
BUCKET = 21600.0

SCORE = ("score", "SELECT series_id, n, t, coalesce(abs(v - lag(v) OVER (PARTITION BY series_id ORDER BY n)), 0.0) AS score FROM sig")
MID = ("mid", "SELECT series_id, quantile_cont(score, 0.5) AS med FROM score GROUP BY 1")
LEVEL = ("lvl", """SELECT s.series_id, any_value(m.med) AS med, quantile_cont(abs(s.score - m.med), 0.5) AS mad
    FROM score s JOIN mid m USING (series_id) GROUP BY 1""")
THRESHOLD = ("thr", f"""SELECT series_id, med, mad,
    greatest(med + {6.0 / SENS} * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END, 3.0) AS threshold FROM lvl""")
PEAKS = ("pk", """SELECT s.series_id, n, t, score FROM (
      SELECT *, count(score) OVER b + count(score) OVER a AS cnt,
        coalesce(sum(score) OVER b, 0) + coalesce(sum(score) OVER a, 0) AS tot,
        greatest(max(score) OVER b, max(score) OVER a) AS top
      FROM score WINDOW b AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
        a AS (PARTITION BY series_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) s
    JOIN thr USING (series_id)
    WHERE score > threshold AND (cnt = 0 OR score >= greatest(1.7 * tot / cnt, 1.05 * top))""")


def _kept(source: str) -> tuple[str, str]:
    return ("kept", f"""SELECT series_id, min(t) AS t FROM {source} GROUP BY 1
    UNION ALL
    SELECT k.series_id, min(p.t) FROM kept k JOIN {source} p ON p.series_id = k.series_id AND p.t - k.t >= {GAP}
    GROUP BY k.series_id, k.t""")


DUR = ("dur", "SELECT series_id, max(t) AS duration, count(*) AS len FROM sig GROUP BY 1")


def _segments(source: str) -> list[tuple[str, str]]:
    return [
        ("bnd", f"""SELECT series_id, 0.0::DOUBLE AS s FROM dur WHERE len >= 3 UNION ALL
            SELECT k.series_id, k.t FROM {source} k JOIN dur USING (series_id)
            WHERE k.t > {GAP} AND k.t < duration - {GAP} AND len >= 3"""),
        ("seg", f"""SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY s) - 1 AS idx, s, e FROM (
            SELECT b.series_id, s, coalesce(lead(s) OVER (PARTITION BY b.series_id ORDER BY s), duration) AS e
            FROM bnd b JOIN dur USING (series_id)) WHERE e - s >= {GAP} * 0.8"""),
        ("segs", """SELECT series_id, idx, s, e FROM seg UNION ALL
            SELECT series_id, 0, 0.0::DOUBLE, duration FROM dur WHERE series_id NOT IN (SELECT series_id FROM seg)"""),
    ]


@query("change_score", sql(f"SELECT series_id, n, {r6('score')} AS score FROM score", SCORE))
def change_score(spark, sf):
    return S.change_score(V.series(spark, sf)).select("series_id", "n", R(F.col("score")).alias("score"))


@query("robust_threshold", sql(f"SELECT series_id, {r6('med')} AS med, {r6('mad')} AS mad, {r6('threshold')} AS threshold FROM thr",
                               SCORE, MID, LEVEL, THRESHOLD))
def robust_threshold(spark, sf):
    d = S.robust_threshold(stage(S.change_score(V.series(spark, sf)).select("series_id", "score")), sensitivity=SENS)
    return d.select("series_id", *[R(F.col(c)).alias(c) for c in ("med", "mad", "threshold")])


@query("prominent_peaks", sql(f"SELECT series_id, n, {r6('score')} AS score FROM pk", SCORE, MID, LEVEL, THRESHOLD, PEAKS))
def prominent_peaks(spark, sf):
    sc = stage(S.change_score(V.series(spark, sf)))
    d = S.prominent_peaks(sc, S.robust_threshold(sc, sensitivity=SENS))
    return d.select("series_id", "n", R(F.col("score")).alias("score"))


@query("debounce", sql(f"SELECT series_id, {r6('t')} AS t FROM kept", _kept("sig"), recursive=True))
def debounce(spark, sf):
    d = S.debounce(V.raw_series(spark, sf), GAP)
    return d.select("series_id", R(F.col("t")).alias("t"))


@query("boundaries_to_segments", sql(f"SELECT series_id, idx, {r6('s')} AS seg_start, {r6('e')} AS seg_end FROM segs",
                                     DUR, ("cc", "SELECT series_id, cut AS t FROM cuts"), *_segments("cc")))
def boundaries_to_segments(spark, sf):
    d = S.boundaries_to_segments(V.cuts(spark, sf), S.durations_of(V.raw_series(spark, sf)), GAP, time="cut", min_samples="len")
    return d.select("series_id", "idx", R(F.col("start")).alias("seg_start"), R(F.col("end")).alias("seg_end"))


@query("detect_shots", sql(f"SELECT series_id, idx, {r6('s')} AS seg_start, {r6('e')} AS seg_end FROM segs",
                           SCORE, MID, LEVEL, THRESHOLD, PEAKS, DUR, _kept("pk"), *_segments("kept"), recursive=True))
def detect_shots(spark, sf):
    fr = V.series(spark, sf)
    d = S.detect_shots(fr, S.durations_of(V.raw_series(spark, sf)), SENS, GAP)
    return d.select("series_id", "idx", R(F.col("start")).alias("seg_start"), R(F.col("end")).alias("seg_end"))


def mirror_sql(source: str, value: str, size: int, name: str = "sm", keys: str = "series_id") -> list[tuple[str, str]]:
    """Reflected-edge uniform filter over columns (keys, n, value)."""
    back, ahead = size // 2, size - 1 - size // 2
    return [
        (f"{name}_m", f"""SELECT * FROM (SELECT x.*, l.len, unnest([n, -1 - n, 2 * len - 1 - n, n + 2 * len, n - 2 * len]) AS p
            FROM {source} x JOIN (SELECT {keys}, max(n) + 1 AS len FROM {source} GROUP BY ALL) l USING ({keys}))
            WHERE p >= -{back} AND p < len + {ahead}"""),
        (name, f"""SELECT * FROM (SELECT * EXCLUDE (len), avg({value}) OVER (PARTITION BY {keys} ORDER BY p
            ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) AS smooth FROM {name}_m) WHERE p = n"""),
    ]


@query("smooth", sql(f"SELECT series_id, n, {r6('smooth')} AS smooth FROM sm", *mirror_sql("sig", "v", 8)))
def smooth(spark, sf):
    return S.smooth(V.series(spark, sf, stored=True), 8).select("series_id", "n", R(F.col("smooth")).alias("smooth"))


ENERGY = [
    ("lv0", f"""SELECT series_id, CAST(floor(t / {BUCKET}) AS BIGINT) AS b,
        20 * log10(sqrt(avg(v * v) + 1e-12) + 1e-9) AS db FROM sig GROUP BY 1, 2"""),
    ("lv1", "SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY b) - 1 AS n FROM lv0"),
    ("ends", "SELECT series_id, quantile_cont(db, 0.05) AS lo, quantile_cont(db, 0.98) AS hi FROM lv1 GROUP BY 1"),
    ("lv2", """SELECT series_id, b, n, least(greatest((db - lo) / greatest(hi - lo, 1e-6), 0.0), 1.0) AS level
        FROM lv1 JOIN ends USING (series_id)"""),
    *mirror_sql("lv2", "level", 5, "esm"),
    ("energy", f"SELECT series_id, n, b * {BUCKET} AS t, smooth AS e FROM esm"),
]


def energy(spark, sf):
    return S.energy_curve(V.raw_series(spark, sf), BUCKET)


@query("energy_curve", sql(f"SELECT series_id, n, CAST(t AS DOUBLE) AS t, {r6('e')} AS energy FROM energy", *ENERGY))
def energy_curve(spark, sf):
    return energy(spark, sf).select("series_id", "n", "t", R(F.col("energy")).alias("energy"))


RUNS = [
    ("flg", "SELECT *, v < 5.0 AS lo, lead(t) OVER (PARTITION BY series_id ORDER BY n) AS nx FROM sig"),
    ("isl", """SELECT *, n - row_number() OVER (PARTITION BY series_id ORDER BY n) AS g FROM flg WHERE lo"""),
    ("rn", """SELECT series_id, min(t) AS s, max(t) AS l, arg_max(coalesce(nx, -1), n) AS a FROM isl GROUP BY series_id, g"""),
]


@query("low_runs", sql(f"""SELECT r.series_id, {r6('s')} AS run_start, {r6('CASE WHEN a < 0 THEN duration ELSE a END')} AS run_end
    FROM rn r JOIN dur USING (series_id) WHERE a < 0 OR a - s > 7200.0""", DUR, *RUNS))
def low_runs(spark, sf):
    d = S.low_runs(V.series(spark, sf, stored=True), S.durations_of(V.raw_series(spark, sf)), 5.0, 7200.0)
    return d.select("series_id", R(F.col("start")).alias("run_start"), R(F.col("end")).alias("run_end"))


@query("mask_to_windows", sql("""SELECT series_id, min(n) * 0.5::DOUBLE AS w_start, (max(n) + 1) * 0.5::DOUBLE AS w_end FROM (
    SELECT series_id, n, n - row_number() OVER (PARTITION BY series_id ORDER BY n) AS g FROM sig WHERE v >= 5.0)
    GROUP BY series_id, g"""))
def mask_to_windows(spark, sf):
    return S.mask_to_windows(V.series(spark, sf, stored=True), F.col("v") >= 5.0, 0.5)


MERGED = [
    ("mg0", """SELECT *, max(w_end) OVER (PARTITION BY series_id ORDER BY w_start, w_end
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM win"""),
    ("mg1", """SELECT *, sum(CASE WHEN reach IS NULL OR w_start - reach > 3600.0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY series_id ORDER BY w_start, w_end ROWS UNBOUNDED PRECEDING) AS g FROM mg0"""),
    ("merged", "SELECT series_id, min(w_start) AS w_start, max(w_end) AS w_end FROM mg1 GROUP BY series_id, g"),
]


@query("merge_windows", sql(f"SELECT series_id, {r6('w_start')} AS w_start, {r6('w_end')} AS w_end FROM merged WHERE w_end - w_start >= 300.0", *MERGED))
def merge_windows(spark, sf):
    d = S.min_length(S.merge_gaps(V.windows(spark, sf), 3600.0), 300.0)
    return d.select("series_id", R(F.col("w_start")).alias("w_start"), R(F.col("w_end")).alias("w_end"))


@query("speech_fraction", sql(f"""SELECT d.series_id, count(m.w_start) AS windows,
    {r6('coalesce(sum(m.w_end - m.w_start), 0) / any_value(duration)')} AS fraction
    FROM dur d LEFT JOIN merged m ON m.series_id = d.series_id AND m.w_end - m.w_start >= 300.0 GROUP BY 1""", DUR, *MERGED))
def speech_fraction(spark, sf):
    w = S.min_length(S.merge_gaps(V.windows(spark, sf), 3600.0), 300.0)
    d = S.window_fraction(w, S.durations_of(V.raw_series(spark, sf)))
    return d.select("series_id", F.col("windows").cast("long").alias("windows"), R(F.col("fraction")).alias("fraction"))


@query("resample_curve", sql(f"""SELECT g.series_id, g.i, {r6('a.v * (1 - f) + b.v * f')} AS value FROM (
      SELECT series_id, i, i * (len - 1) / 15.0::DOUBLE AS x, CAST(floor(i * (len - 1) / 15.0::DOUBLE) AS BIGINT) AS lo,
        i * (len - 1) / 15.0::DOUBLE - floor(i * (len - 1) / 15.0::DOUBLE) AS f, len
      FROM dur, (SELECT unnest(range(16)) AS i)) g
    JOIN sig a ON a.series_id = g.series_id AND a.n = g.lo
    JOIN sig b ON b.series_id = g.series_id AND b.n = least(g.lo + 1, g.len - 1)""", DUR))
def resample_curve(spark, sf):
    return S.resample_linear(V.series(spark, sf, stored=True), 16).select("series_id", "i", R(F.col("value")).alias("value"))


GRID = ("grd", "SELECT series_id, i, i * duration / 23.0::DOUBLE AS g, duration FROM dur, (SELECT unnest(range(24)) AS i)")


@query("kernel_density", sql(f"""SELECT series_id, i, {r6('CASE WHEN top > 0 THEN d / top ELSE d END')} AS density FROM (
    SELECT *, max(d) OVER (PARTITION BY series_id) AS top FROM (
      SELECT g.series_id, i, coalesce(sum(exp(-power(g.g - c.cut, 2) / (2 * 86400.0 * 86400.0))), 0.0) AS d
      FROM grd g LEFT JOIN cuts c ON c.series_id = g.series_id GROUP BY 1, 2))""", DUR, GRID))
def kernel_density(spark, sf):
    d = S.kernel_density(V.cuts(spark, sf), S.durations_of(V.raw_series(spark, sf)), 24, 86400.0, time="cut")
    return d.select("series_id", F.posexplode("density").alias("i", "density")).select(
        "series_id", F.col("i").cast("long").alias("i"), R(F.col("density")).alias("density"))


@query("interpolate", sql(f"""SELECT q.series_id, q.i, {r6('''CASE WHEN b.t IS NULL THEN f.v WHEN f.t IS NULL OR f.t = b.t THEN b.v
      ELSE b.v + (f.v - b.v) * (q.g - b.t) / (f.t - b.t) END''')} AS value FROM grd q
    ASOF LEFT JOIN sig b ON b.series_id = q.series_id AND b.t <= q.g
    ASOF LEFT JOIN sig f ON f.series_id = q.series_id AND f.t >= q.g""", DUR, GRID))
def interpolate(spark, sf):
    sig = V.raw_series(spark, sf)
    d = S.interpolate(S.time_grid(S.durations_of(sig), 24), sig.select("series_id", "t", "v"))
    return d.select("series_id", "i", R(F.col("value")).alias("value"))


LOCAL = [("nb", """SELECT series_id, n, v, lag(v) OVER w AS p, lead(v) OVER w AS x FROM sig
    WINDOW w AS (PARTITION BY series_id ORDER BY n)"""),
    # level tops: group equal neighbours first
    ("lvg", """SELECT series_id, min(n) AS a, max(n) AS b, any_value(v) AS v FROM (
        SELECT *, sum(CASE WHEN p IS NULL OR p <> v THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS g
        FROM nb) GROUP BY series_id, g"""),
    ("top", """SELECT series_id, (a + b) // 2 AS n, v FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS x FROM lvg
        WINDOW w AS (PARTITION BY series_id ORDER BY a)) WHERE p < v AND x < v AND v >= 8.0""")]


@query("local_maxima", sql(f"SELECT series_id, n, {r6('v')} AS v FROM top", *LOCAL))
def local_maxima(spark, sf):
    d = peaks.local_maxima(V.series(spark, sf, stored=True)).filter(F.col("v") >= 8.0)
    return d.select("series_id", "n", R(F.col("v")).alias("v"))


def thinned(values: str, distance: int, height: str) -> list[tuple[str, str]]:
    """CTEs for local maxima of ``values`` (series_id, n, v) with at least ``height``, thinned highest first: table ``thin``."""
    return [
        ("turns", f"SELECT series_id, n, v, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY n) AS run FROM (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY n) AS p FROM {values})"),
        ("levels", "SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM (SELECT series_id, run, any_value(v) AS v, (min(n) + max(n)) // 2 AS n FROM turns GROUP BY 1, 2) WINDOW w AS (PARTITION BY series_id ORDER BY run)"),
        ("thinning", f"""SELECT series_id, list({{'n': n, 'v': v}} ORDER BY v DESC, n DESC) AS todo, [any_value({{'n': n, 'v': v}})][:0] AS held FROM levels WHERE v > before AND v > after AND v >= {height} GROUP BY 1
            UNION ALL SELECT series_id, list_filter(todo[2:], lambda x: abs(x.n - todo[1].n) >= {distance}), list_append(held, todo[1]) FROM thinning WHERE len(todo) > 0"""),
        ("thin", "SELECT series_id, x.n AS n, x.v AS v FROM (SELECT series_id, unnest(held) AS x FROM thinning WHERE len(todo) = 0)")]


@query("find_peaks", sql(f"SELECT series_id, CAST(n AS BIGINT) AS n, {r6('v')} AS v FROM thin", *thinned("sig", 6, "8.0"), recursive=True))
def find_peaks(spark, sf):
    d = peaks.find_peaks(V.series(spark, sf, stored=True), 6, 8.0)
    return d.select("series_id", "n", R(F.col("v")).alias("v"))


@query("series_percentiles", sql(f"""SELECT series_id, {r6('quantile_cont(v, 0.1)')} AS p10, {r6('quantile_cont(v, 0.5)')} AS p50,
    {r6('quantile_cont(v, 0.992)')} AS p992 FROM sig GROUP BY 1"""))
def series_percentiles(spark, sf):
    d = quantiles(V.raw_series(spark, sf), ["series_id"], F.col("v"), {"p10": 0.1, "p50": 0.5, "p992": 0.992})
    return d.select("series_id", *[R(F.col(c)).alias(c) for c in ("p10", "p50", "p992")])

"""Music and speech operators; the five event kinds act as frequency bands, one frame per half day."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions.maths import r6 as R
from ..operators import audio as A, series as S
from ..operators.blocks import spread
from ..session import stage
from ..sources import views as V
from .oracle import r6, sql
from .registry import query
from .series_queries import DUR, ENERGY, energy, mirror_sql, thinned

c = F.col
STEP, RATE = 43200.0, 12.0
KINDS = ("view", "signup", "error", "click", "purchase")


def bands(spark, sf):
    """Dense grid of frames x 5 bands per series, up to its last event; absent cells are silent."""
    raw = V.raw_series(spark, sf)
    e = raw.groupBy("series_id", F.floor(c("t") / STEP).cast("long").alias("n"), c("kind").alias("band")).agg((F.sum("v") / 100).alias("e"))
    # a row per series is little enough to be put into one task, and all frames that come of it would stay there
    ends = spread(raw.groupBy("series_id").agg(F.floor(F.max("t") / STEP).cast("long").alias("last")), ["series_id", "last"])
    grid = ends.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), c("last"))).alias("n"))
    grid = grid.select("series_id", "n", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("band"))
    return grid.join(e, ["series_id", "n", "band"], "left").withColumn("e", F.coalesce("e", F.lit(0.0)))


BAND = [("bands", f"""SELECT g.series_id, g.n, g.band, coalesce(sum(v) / 100, 0.0) AS e FROM (SELECT series_id, unnest(range(nf)) AS n, band FROM (SELECT series_id, CAST(floor(max(t) / {STEP}) AS BIGINT) + 1 AS nf FROM sig GROUP BY 1), (SELECT unnest({list(KINDS)}) AS band)) g
    LEFT JOIN sig s ON s.series_id = g.series_id AND floor(s.t / {STEP}) = g.n AND s.kind = g.band GROUP BY 1, 2, 3""")]
ONSET = [*BAND,
         ("fx0", "SELECT series_id, n, greatest(coalesce(ln(1 + e * 100) - lag(ln(1 + e * 100)) OVER (PARTITION BY series_id, band ORDER BY n), 0), 0) AS r FROM bands"),
         ("fx1", "SELECT series_id, n, sum(r) AS f FROM fx0 GROUP BY 1, 2"), *mirror_sql("fx1", "f", 32, "fs"),
         ("on0", "SELECT series_id, n, greatest(f - smooth, 0) AS o FROM fs"),
         ("ons", "SELECT series_id, n, CASE WHEN max(o) OVER w > 0 THEN o / max(o) OVER w ELSE o END AS onset FROM on0 WINDOW w AS (PARTITION BY series_id)")]


def onsets(spark, sf):
    return A.onset_envelope(bands(spark, sf))


@query("onset_envelope", sql(f"SELECT series_id, n, {r6('onset')} AS onset FROM ons", *ONSET))
def onset_envelope(spark, sf):
    return onsets(spark, sf).select("series_id", "n", R(c("onset")).alias("onset"))


LO, HI = A.lag_range(RATE)
TEMPO = [*ONSET,
         ("xm", "SELECT series_id, n, onset - avg(onset) OVER (PARTITION BY series_id) AS x FROM ons"),
         ("ac", f"SELECT a.series_id, k, sum(a.x * b.x) AS s FROM xm a CROSS JOIN (SELECT unnest(range({LO}, {HI})) AS k) JOIN xm b ON b.series_id = a.series_id AND b.n = a.n + k GROUP BY 1, 2"),
         ("tp", f"""SELECT series_id, arg_max(k, s * (1.06 - 0.06 * (k - {LO}) / ({HI - LO} - 1.0))) AS period, least(greatest(max(s) / (avg(abs(s)) * 6 + 1e-9), 0), 1) AS conf FROM ac GROUP BY 1""")]


@query("tempo_autocorr", sql(f"SELECT series_id, period, {r6(f'60.0 * {RATE} / period')} AS bpm, {r6('conf')} AS confidence FROM tp", *TEMPO))
def tempo_autocorr(spark, sf):
    d = A.tempo_autocorr(onsets(spark, sf), RATE)
    return d.select("series_id", "period", R(c("bpm")).alias("bpm"), R(c("confidence")).alias("confidence"))


PHASE = [*TEMPO, ("ph", """SELECT series_id, period, phase FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(s, 9) DESC, phase) AS r FROM (
    SELECT o.series_id, any_value(period) AS period, n % period AS phase, sum(onset) AS s FROM ons o JOIN tp USING (series_id) GROUP BY 1, 3)) WHERE r = 1""")]


def _phases(spark, sf):
    o = stage(onsets(spark, sf))
    return o, A.phase_search(o, A.tempo_autocorr(o, RATE))


@query("phase_search", sql("SELECT series_id, period, phase FROM ph", *PHASE))
def phase_search(spark, sf):
    return _phases(spark, sf)[1].select("series_id", "period", "phase")


BEAT = [*PHASE, ("bt", f"""SELECT series_id, k AS beat_no, n, onset FROM (SELECT g.series_id, g.k, o.n, o.onset, row_number() OVER (PARTITION BY g.series_id, g.k ORDER BY o.onset DESC, o.n) AS r FROM (
    SELECT series_id, period, phase, unnest(range(CAST(floor((nf - 1 - phase) / period) AS BIGINT) + 1)) AS k FROM ph JOIN (SELECT series_id, max(n) + 1 AS nf FROM ons GROUP BY 1) USING (series_id)) g
    JOIN ons o ON o.series_id = g.series_id AND abs(o.n - (g.phase + g.k * g.period)) <= greatest(1, floor(g.period * 0.14))) WHERE r = 1""")]


@query("snap_to_peak", sql(f"SELECT series_id, beat_no, n, {r6(f'n / {RATE}')} AS beat FROM bt", *BEAT))
def snap_to_peak(spark, sf):
    o, p = _phases(spark, sf)
    return A.snap_to_peak(o, p, RATE).select("series_id", "beat_no", "n", R(c("beat")).alias("beat"))


@query("downbeats", sql("""SELECT b.series_id, b.beat_no, b.n FROM bt b JOIN (SELECT series_id, p FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(s, 9) DESC, p) AS r, sum(k) OVER (PARTITION BY series_id) AS total FROM (
    SELECT series_id, beat_no % 4 AS p, sum(onset) AS s, count(*) AS k FROM bt GROUP BY 1, 2)) WHERE r = 1 AND total >= 8) x ON x.series_id = b.series_id AND b.beat_no % 4 = x.p""", *BEAT))
def downbeats(spark, sf):
    o, p = _phases(spark, sf)
    return A.downbeats(A.snap_to_peak(o, p, RATE)).select("series_id", "beat_no", "n")


@query("onset_times", sql(f"SELECT series_id, CAST(n AS BIGINT) AS n, {r6('v')} AS onset FROM thin", *ONSET, ("ov", "SELECT series_id, n, onset AS v FROM ons"),
                          ("floors", "SELECT series_id, greatest(0.12, avg(v) * 2.2) AS least FROM ov GROUP BY 1"),
                          *thinned("ov", 4, "(SELECT least FROM floors f WHERE f.series_id = levels.series_id)"), recursive=True))
def onset_times(spark, sf):
    return A.onset_times(stage(onsets(spark, sf)), 50.0).select("series_id", "n", R(c("onset")).alias("onset"))


REACH = 4
NOV = [*BAND, ("u", "SELECT series_id, n, band, ln(1 + e * 100) / (sqrt(sum(power(ln(1 + e * 100), 2)) OVER (PARTITION BY series_id, n)) + 1e-9) AS u FROM bands"),
       ("gk", "SELECT * FROM (VALUES " + ", ".join(f"({i - REACH}, {(1 if i < REACH else -1) * g!r}::DOUBLE)" for i, g in enumerate(A._gauss(REACH))) + ") v(o, g)"),
       ("nv", f"""SELECT series_id, n, sum(z * z) AS nov FROM (SELECT a.series_id, a.n, a.band, sum(g * b.u) AS z FROM u a CROSS JOIN gk JOIN u b ON b.series_id = a.series_id AND b.band = a.band AND b.n = a.n + o GROUP BY 1, 2, 3) GROUP BY 1, 2""")]


@query("novelty", sql(f"SELECT series_id, n, {r6(f'CASE WHEN n >= {REACH} AND n < max(n) OVER (PARTITION BY series_id) + 1 - {REACH} THEN nov ELSE 0 END')} AS novelty FROM nv", *NOV))
def novelty(spark, sf):
    return A.novelty(bands(spark, sf), REACH).select("series_id", "n", R(c("novelty")).alias("novelty"))


SECTIONS = [*NOV, *ENERGY, DUR,
    ("nz", f"SELECT series_id, n, CASE WHEN n >= {REACH} AND n < max(n) OVER w + 1 - {REACH} AND max(n) OVER w + 1 > {4 * REACH} THEN nov ELSE 0 END AS novelty FROM nv WINDOW w AS (PARTITION BY series_id)"),
    *mirror_sql("nz", "novelty", 16, "ns"), ("nd", "SELECT series_id, n, greatest(novelty - smooth, 0) AS d FROM ns"),
    ("nvv", "SELECT series_id, n, CASE WHEN max(d) OVER w > 0 THEN d / max(d) OVER w ELSE d END AS v FROM nd WINDOW w AS (PARTITION BY series_id)"), *thinned("nvv", 4, "0.25"),
    ("nb", f"SELECT series_id, 0.0::DOUBLE AS s FROM dur UNION ALL SELECT series_id, n * {STEP!r}::DOUBLE FROM thin JOIN dur USING (series_id) WHERE n > 0 AND n * {STEP!r}::DOUBLE < duration"),
    ("nsg", f"""SELECT * FROM (SELECT series_id, s, coalesce(lead(s) OVER w, duration) AS e, row_number() OVER w - 1 AS idx FROM nb JOIN dur USING (series_id) WINDOW w AS (PARTITION BY series_id ORDER BY s)) WHERE e - s >= {STEP!r}::DOUBLE"""),
    ("nsp", "SELECT series_id, idx, s, e, s + (e - s) * i / 7.0::DOUBLE AS at FROM nsg CROSS JOIN (SELECT unnest(range(8)) AS i)"),
    ("nse", """SELECT p.series_id, p.idx, p.s, p.e, avg(coalesce(x.e, l.last, 0.5)) AS energy FROM nsp p ASOF LEFT JOIN energy x ON x.series_id = p.series_id AND x.t >= p.at
        LEFT JOIN (SELECT series_id, arg_max(e, t) AS last FROM energy GROUP BY 1) l ON l.series_id = p.series_id GROUP BY 1, 2, 3, 4""")]


@query("novelty_sections", sql(f"SELECT series_id, idx, {r6('s')} AS sec_start, {r6('e')} AS sec_end, {r6('energy')} AS energy, CASE WHEN energy > 0.66 THEN 'high' WHEN energy < 0.33 THEN 'low' ELSE 'mid' END AS label FROM nse", *SECTIONS, recursive=True))
def novelty_sections(spark, sf):
    e = stage(energy(spark, sf).select("series_id", "t", "energy"))
    dur = V.raw_series(spark, sf).groupBy("series_id").agg(F.max("t").alias("duration"))
    d = A.novelty_sections(A.novelty(bands(spark, sf), REACH), e, dur, STEP, base=16, apart=4 * STEP, shortest=STEP)
    return d.select("series_id", "idx", R(c("start")).alias("sec_start"), R(c("end")).alias("sec_end"), R(c("energy")).alias("energy"), "label")


JUMP = [("lw", "SELECT series_id, n, ln(1 + v) AS low FROM sig"), *mirror_sql("lw", "low", 8, "ls"),
        ("jd", """SELECT series_id, n, coalesce(smooth - lag(smooth) OVER w, 0) AS d, avg(smooth) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS pre, avg(smooth) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS post
            FROM ls WINDOW w AS (PARTITION BY series_id ORDER BY n)"""),
        ("jq", "SELECT series_id, greatest(quantile_cont(d, 0.992), 1e-6) AS h FROM jd GROUP BY 1 HAVING count(*) > 40")]


@query("level_jumps", sql(f"SELECT series_id, n, {r6('pre')} AS before, {r6('post')} AS after FROM jd JOIN jq USING (series_id) WHERE d >= h AND post > pre * 1.22", *JUMP))
def level_jumps(spark, sf):
    low = stage(V.series(spark, sf).select("series_id", "n", F.log1p("v").alias("low")))
    return A.level_jumps(low, 5.0, suppress=False).select("series_id", "n", R(c("before")).alias("before"), R(c("after")).alias("after"))


@query("drops", sql(f"SELECT series_id, CAST(n AS BIGINT) AS n, {r6('n / 5.0')} AS t FROM thin JOIN jd USING (series_id, n) WHERE post > pre * 1.22", *JUMP, ("jv", "SELECT series_id, n, d AS v FROM jd"),
                    *thinned("jv", 15, "(SELECT h FROM jq WHERE jq.series_id = levels.series_id)"), recursive=True))
def drops(spark, sf):
    low = stage(V.series(spark, sf).select("series_id", "n", F.log1p("v").alias("low")))
    return A.level_jumps(low, 5.0).select("series_id", "n", R(c("t")).alias("t"))


SEG = 12
HOPS = 1.0 / 24
_terms = ", ".join(f"sum(v * cos(a * {k})) AS c{k}, sum(v * sin(a * {k})) AS s{k}" for k in range(1, SEG // 2 + 1))
_mag = {k: f"CASE WHEN {k} <= floor(m / 2) THEN sqrt(c{k} * c{k} + s{k} * s{k}) ELSE 0 END" for k in range(1, SEG // 2 + 1)}
_in = " + ".join(f"CASE WHEN {k} / (m * {HOPS!r}::DOUBLE) BETWEEN 2 AND 8 THEN {x} ELSE 0 END" for k, x in _mag.items())
MOD = [("mb", f"""SELECT *, least({SEG}, len - b * {SEG // 2}) AS m FROM (SELECT *, unnest(range(CAST(greatest(floor((n - {SEG}) / {SEG // 2}) + 1, 0) AS BIGINT), CAST(floor(n / {SEG // 2}) AS BIGINT) + 1)) AS b FROM (
          SELECT series_id, n, v, count(*) OVER (PARTITION BY series_id) AS len FROM sig))"""),
       ("mc", f"SELECT series_id, b, m, min(v) AS lo, max(v) AS hi, {_terms} FROM (SELECT *, {-2 * math.pi!r}::DOUBLE * (n - b * {SEG // 2}) / m AS a FROM mb WHERE m >= 8) GROUP BY 1, 2, 3"),
       ("md", f"SELECT series_id, b, CASE WHEN hi > lo THEN ({_in}) / ({' + '.join(_mag.values())} + 1e-9) ELSE 0 END AS share FROM mc"),
       ("mm", "SELECT s.series_id, s.n, s.v, s.kind, coalesce(x.share, 0.0) AS modulation FROM sig s LEFT JOIN (SELECT series_id, n, max(share) AS share FROM mb JOIN md USING (series_id, b) WHERE m >= 8 GROUP BY 1, 2) x USING (series_id, n)")]


def _modulated(spark, sf):
    env = stage(V.series(spark, sf).select("series_id", "n", c("v").alias("envelope"), "kind"))
    return A.modulation_share(env, HOPS, seg=SEG)


@query("modulation_share", sql(f"SELECT series_id, n, {r6('modulation')} AS modulation FROM mm", *MOD))
def modulation_share(spark, sf):
    return _modulated(spark, sf).select("series_id", "n", R(c("modulation")).alias("modulation"))


@query("voiced_mask", sql("""SELECT series_id, n, v / (v + CASE WHEN kind = 'view' THEN v * 2 ELSE 1 END + 1e-9) >= 0.45 AND modulation >= 0.14 AND v > greatest(max(v) OVER (PARTITION BY series_id) * 0.06, 1e-6) AS voiced FROM mm""", *MOD))
def voiced_mask(spark, sf):
    d = stage(_modulated(spark, sf)).withColumns({"in_band": c("envelope"), "total": c("envelope") + F.when(c("kind") == "view", c("envelope") * 2).otherwise(1.0)})
    return A.voiced_mask(d).select("series_id", "n", "voiced")


@query("voice_band", sql(f"SELECT series_id, n, {r6('sum(CASE WHEN v BETWEEN 5 AND 20 THEN v ELSE 0 END)')} AS in_band, {r6('sum(v)')} AS total FROM (SELECT series_id, n // 4 AS n, v FROM sig) GROUP BY 1, 2"))
def voice_band(spark, sf):
    d = V.series(spark, sf).select("series_id", F.floor(c("n") / 4).cast("long").alias("n"), c("v").alias("freq"), c("v").alias("mag"))
    return A.voice_band(d, low=5.0, high=20.0).select("series_id", "n", R(c("in_band")).alias("in_band"), R(c("total")).alias("total"))


SPOKEN = [*MOD,
          ("vm", "SELECT series_id, n, v / (v + 1.0 + 1e-9) >= 0.45 AND modulation >= 0.14 AND v > greatest(max(v) OVER (PARTITION BY series_id) * 0.06, 1e-6) AS voiced FROM mm"),
          ("vr", "SELECT series_id, CAST(min(n) AS DOUBLE) AS s, max(n) + 1.0::DOUBLE AS e FROM (SELECT series_id, n, n - row_number() OVER (PARTITION BY series_id ORDER BY n) AS g FROM vm WHERE voiced) GROUP BY series_id, g"),
          ("vj", "SELECT *, sum(CASE WHEN s - before <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY s) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY series_id ORDER BY s) AS before FROM vr)")]


@query("speech_windows", sql("SELECT series_id, min(s) AS w_start, max(e) AS w_end FROM vj GROUP BY series_id, g HAVING max(e) - min(s) >= 2", *SPOKEN))
def speech_windows(spark, sf):
    d = stage(_modulated(spark, sf)).withColumns({"in_band": c("envelope"), "total": c("envelope") + 1.0})
    w = S.mask_to_windows(stage(A.voiced_mask(d)), c("voiced"), 1.0)
    w = S.min_length(S.merge_gaps(w, 1.0, width=1000.0), 2.0)
    return w.select("series_id", "w_start", "w_end")


_edges = np.logspace(np.log10(0.5), np.log10(8.0), 5)      # one bin per hertz; a band without a bin is silent
MEMBERS = [(b, k) for b in range(4) for k in ([k for k in range(9) if _edges[b] <= k < _edges[b + 1]] or [-1])]
SPECTRUM = [
    ("bf", f"""SELECT series_id, f AS n, n - f * 8 AS i, v * (0.5 - 0.5 * cos({2 * math.pi!r}::DOUBLE * (n - f * 8) / 16)) / 8 AS v FROM (SELECT *, unnest([n // 8 - 1, n // 8]) AS f, count(*) OVER (PARTITION BY series_id) AS len FROM sig) WHERE f >= 0 AND f * 8 + 16 <= len"""),
    ("bk", f"""SELECT series_id, n, k, sqrt(power(sum(v * cos({2 * math.pi!r}::DOUBLE * i * k / 16)), 2) + power(sum(v * sin({2 * math.pi!r}::DOUBLE * i * k / 16)), 2)) AS mag FROM bf CROSS JOIN (SELECT unnest(range(9)) AS k) GROUP BY 1, 2, 3"""),
    ("bb", "SELECT * FROM (VALUES " + ", ".join(f"({b}::BIGINT, {k}::BIGINT)" for b, k in MEMBERS) + ") v(band, k)")]


@query("band_energies", sql(f"SELECT series_id, n, band, {r6('coalesce(avg(mag), 0)')} AS energy FROM (SELECT DISTINCT series_id, n FROM bf) CROSS JOIN bb LEFT JOIN bk USING (series_id, n, k) GROUP BY 1, 2, 3", *SPECTRUM))
def band_energies(spark, sf):
    pcm = A.chunked(V.series(spark, sf), 32)
    d = A.band_energies(pcm, 16.0, nfft=16, hop=8, bands=4, low=0.5, high=8.0)
    return d.select("series_id", "n", "band", R(c("e")).alias("energy"))

"""Shot measures, verdicts and library statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.maths import r6 as R
from ..operators import frames as FR, measures as M
from ..rules.measures import MOVES
from ..sources import views as V
from .oracle import r6, sql
from .registry import query

c = F.col

FLOW_SQL = """SELECT l_suppkey AS shot_id, CAST(l_linenumber AS BIGINT) AS frame, l_quantity / 25 - 1 AS x, l_discount * 20 - 1 AS y,
    (l_partkey % 21) - 8.0D AS fx, ((l_partkey * 7) % 13) - 5.0D AS fy FROM {lineitem}"""
PIXEL_SQL = """SELECT l_suppkey AS shot_id, CAST((l_partkey * 31 + l_orderkey) % 256 AS DOUBLE) AS r, CAST((l_partkey * 17) % 256 AS DOUBLE) AS g,
    CAST((l_partkey * 7 + l_linenumber * 11) % 200 AS DOUBLE) AS b, CAST((l_partkey * 13 + l_orderkey) % 256 AS DOUBLE) AS luma,
    l_quantity * 5 AS sat FROM {lineitem}"""


def _duck(text: str) -> str:
    import re
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", text.replace("{lineitem}", "lineitem"))


FLOW = [
    ("flow", _duck(FLOW_SQL)),
    ("fm", """SELECT shot_id, frame, avg(fx) AS dx, avg(fy) AS dy, avg(sqrt(fx * fx + fy * fy)) AS m, sum(x * x + y * y) AS rr FROM flow GROUP BY 1, 2"""),
    ("fz", """SELECT f.shot_id, f.frame, any_value(dx) AS dx, any_value(dy) AS dy, any_value(m) AS m,
        sum((fx - dx) * x + (fy - dy) * y) / CASE WHEN any_value(rr) = 0 THEN 1 ELSE any_value(rr) END / 128.0 AS zoom
        FROM flow f JOIN fm USING (shot_id, frame) GROUP BY 1, 2"""),
    ("fr", """SELECT f.shot_id, f.frame, sqrt(power(fx - dx - zoom * x * 128.0, 2) + power(fy - dy - zoom * y * 128.0, 2)) AS rest
        FROM flow f JOIN fz USING (shot_id, frame)"""),
    ("steps", """SELECT shot_id, frame, dx, dy, zoom, rest_std, subject, sqrt(dx * dx + dy * dy) AS magnitude,
        sqrt(dx * dx + dy * dy) / (m + 1e-6) AS coherence FROM fz JOIN
        (SELECT shot_id, frame, stddev_pop(rest) AS rest_std, quantile_cont(rest, 0.9) AS subject FROM fr GROUP BY 1, 2) USING (shot_id, frame)"""),
]
MOTION = ("mot", """SELECT s.shot_id, any_value(mdx) AS mdx, any_value(mdy) AS mdy, avg(magnitude) AS flow_magnitude,
    degrees(atan2(-any_value(mdy), any_value(mdx))) AS direction, avg(zoom) AS zoom_rate,
    avg(sqrt(power(dx - mdx, 2) + power(dy - mdy, 2))) AS shake, avg(subject) AS subject_motion, avg(coherence) AS coherence,
    CASE WHEN avg(magnitude) <= 1e-3 THEN 0.0 ELSE sqrt(power(avg(dx / greatest(magnitude, 1e-6)), 2) + power(avg(dy / greatest(magnitude, 1e-6)), 2)) END AS consistency
    FROM steps s JOIN (SELECT shot_id, avg(dx) AS mdx, avg(dy) AS mdy FROM steps GROUP BY 1) USING (shot_id) GROUP BY 1""")


def _steps(spark, sf):
    return M.decompose_flow(V.spark_sql(spark, sf, FLOW_SQL), half_width=128.0)


def _rounded(d, keys, names):
    return d.select(*keys, *[R(c(n)).alias(n) for n in names])


STEP_COLS = ("dx", "dy", "zoom", "rest_std", "subject", "coherence")


@query("decompose_flow", sql("SELECT shot_id, frame, " + ", ".join(f"{r6(x)} AS {x}" for x in STEP_COLS) + " FROM steps", *FLOW))
def decompose_flow(spark, sf):
    return _rounded(_steps(spark, sf), ("shot_id", "frame"), STEP_COLS)


@query("motion_summary", sql(f"""SELECT shot_id, {r6('flow_magnitude')} AS flow_magnitude, {r6('direction')} AS flow_direction_deg,
    {r6('zoom_rate')} AS zoom_rate, {r6('shake')} AS shake, {r6('subject_motion')} AS subject_motion,
    {r6('coherence')} AS flow_coherence, {r6('consistency')} AS motion_consistency FROM mot""", *FLOW, MOTION))
def motion_summary(spark, sf):
    d = M.motion_summary(_steps(spark, sf))
    return _rounded(d, ("shot_id",), ("flow_magnitude", "flow_direction_deg", "zoom_rate", "shake", "subject_motion",
                                      "flow_coherence", "motion_consistency"))


MOVE = """CASE WHEN mag * coh < 0.35 AND shake * coh < 0.30 AND abs(z) * 128.0 * 2 < 0.30 THEN 'static'
  WHEN abs(z) * 256.0 > 0.28 AND abs(z) * 256.0 > mag * coh * 0.75 THEN CASE WHEN z > 0 THEN 'push_in' ELSE 'pull_out' END
  WHEN shake / (mag + 0.3) > 0.5 AND con < 0.55 AND coh > 0.4 THEN 'handheld'
  WHEN abs(dx) > abs(dy) * 1.4 AND abs(dx) * coh > 0.35 THEN CASE WHEN dx < 0 THEN 'pan_right' ELSE 'pan_left' END
  WHEN abs(dy) > abs(dx) * 1.4 AND abs(dy) * coh > 0.35 THEN CASE WHEN dy < 0 THEN 'tilt_down' ELSE 'tilt_up' END ELSE 'complex' END"""
CONF = """CASE WHEN mag * coh < 0.35 AND shake * coh < 0.30 AND abs(z) * 256.0 < 0.30 THEN 0.9
  WHEN abs(z) * 256.0 > 0.28 AND abs(z) * 256.0 > mag * coh * 0.75 THEN least(1.0, abs(z) * 256.0 / 1.5)
  WHEN shake / (mag + 0.3) > 0.5 AND con < 0.55 AND coh > 0.4 THEN least(1.0, shake / (mag + 0.3))
  WHEN abs(dx) > abs(dy) * 1.4 AND abs(dx) * coh > 0.35 THEN least(1.0, abs(dx) / 3.0)
  WHEN abs(dy) > abs(dx) * 1.4 AND abs(dy) * coh > 0.35 THEN least(1.0, abs(dy) / 3.0) ELSE 0.4 END"""


@query("classify_movement", sql(f"SELECT shot_id, {MOVE} AS movement, {r6(CONF)} AS confidence FROM x",
    ("x", """SELECT shot_id, flow_magnitude * cos(radians(flow_direction_deg)) AS dx, flow_magnitude * sin(radians(flow_direction_deg)) AS dy,
     zoom_rate / 40 AS z, shake / 4 AS shake, flow_magnitude AS mag, flow_coherence AS coh, motion_consistency AS con FROM shots""")))
def classify_movement(spark, sf):
    a = F.radians("flow_direction_deg")
    m = S.classify_movement(c("flow_magnitude") * F.cos(a), c("flow_magnitude") * F.sin(a), c("zoom_rate") / 40, c("shake") / 4,
                            c("flow_magnitude"), F.lit(128.0), c("flow_coherence"), c("motion_consistency"))
    return V.shots(spark, sf).withColumn("m", m).select("shot_id", c("m.movement").alias("movement"), R(c("m.confidence")).alias("confidence"))


@query("tone_stats", sql(f"""SELECT shot_id, {r6('brightness')} AS brightness, {r6('contrast')} AS contrast, {r6('saturation')} AS saturation,
    {r6('warmth')} AS warmth, {r6('hi')} AS clipped_highlights, {r6('lo')} AS clipped_shadows,
    CASE WHEN brightness < 0.32 AND contrast > 0.35 THEN 'low_key' WHEN brightness > 0.62 THEN 'high_key' ELSE 'mid' END AS light_key FROM (
    SELECT shot_id, avg(luma) / 255.0 AS brightness, least(1.0, stddev_pop(luma) / 80.0) AS contrast, avg(sat) / 255.0 AS saturation,
      least(greatest((avg(r) - avg(b)) / ((avg(r) + avg(b)) / 2.0), -1), 1) AS warmth, avg(CASE WHEN luma > 250 THEN 1.0 ELSE 0 END) AS hi,
      avg(CASE WHEN luma < 5 THEN 1.0 ELSE 0 END) AS lo FROM px GROUP BY 1)""", ("px", _duck(PIXEL_SQL))))
def tone_stats(spark, sf):
    d = M.tone_stats(V.spark_sql(spark, sf, PIXEL_SQL))
    k = S.light_key(c("brightness"), c("contrast"))
    return d.withColumn("light_key", k).select("shot_id", "light_key", *[R(c(n)).alias(n) for n in (
        "brightness", "contrast", "saturation", "warmth", "clipped_highlights", "clipped_shadows")])


@query("colourfulness", sql(f"""SELECT shot_id, {r6('least(1.0, (sqrt(power(stddev_pop(rg), 2) + power(stddev_pop(yb), 2)) + 0.3 * sqrt(power(avg(rg), 2) + power(avg(yb), 2))) / 110.0)')} AS colorfulness
    FROM (SELECT shot_id, abs(r - g) AS rg, abs(0.5 * (r + g) - b) AS yb FROM px) GROUP BY 1""", ("px", _duck(PIXEL_SQL))))
def colourfulness(spark, sf):
    return _rounded(M.colourfulness(V.spark_sql(spark, sf, PIXEL_SQL)), ("shot_id",), ("colorfulness",))


GAP = "round((c.r - m.r) * (c.r - m.r) + (c.g - m.g) * (c.g - m.g) + (c.b - m.b) * (c.b - m.b), 6)"
NEXT = f"""SELECT shot_id, CASE WHEN max(far) > 0 THEN list_append(any_value(ms), arg_max({{{{'r': r, 'g': g, 'b': b}}}}, {{{{'f': far, 'w': w, 'r': -r, 'g': -g, 'b': -b}}}})) ELSE any_value(ms) END AS ms
    FROM (SELECT c.*, ms, list_min(list_transform(ms, lambda m: {GAP})) * w AS far FROM colour c JOIN {{}} USING (shot_id)) GROUP BY 1"""
MEANS = ", ".join(f"CASE WHEN sum(w) FILTER (j = {i}) IS NULL THEN ms[{i}] ELSE {{'r': sum(w * r) FILTER (j = {i}) / sum(w) FILTER (j = {i}), 'g': sum(w * g) FILTER (j = {i}) / sum(w) FILTER (j = {i}), 'b': sum(w * b) FILTER (j = {i}) / sum(w) FILTER (j = {i})}} END" for i in (1, 2, 3))
NEAR = f"(SELECT c.*, n, ms, list_transform(ms, lambda m: {GAP}) AS ds, list_position(list_transform(ms, lambda m: {GAP}), list_min(list_transform(ms, lambda m: {GAP}))) AS j FROM colour c JOIN lloyd USING (shot_id))"
LLOYD = [
    ("px", _duck(PIXEL_SQL)), ("colour", "SELECT shot_id, r, g, b, CAST(count(*) AS DOUBLE) AS w FROM px GROUP BY ALL"),
    ("one", "SELECT shot_id, [arg_max({'r': r, 'g': g, 'b': b}, {'w': w, 'r': -r, 'g': -g, 'b': -b})] AS ms FROM colour GROUP BY 1"),
    ("two", NEXT.format("one")), ("three", NEXT.format("two")),
    ("lloyd", f"SELECT shot_id, 0 AS n, ms FROM three UNION ALL SELECT shot_id, n + 1, ([{MEANS}])[:len(ms)] FROM {NEAR} WHERE n < 10 GROUP BY shot_id, n, ms"),
    ("ended", f"SELECT shot_id, j, any_value(ms) AS ms, sum(w) AS w FROM {NEAR} WHERE n = 10 GROUP BY 1, 2"),
]


@query("palette", sql(f"""SELECT shot_id, row_number() OVER (PARTITION BY shot_id ORDER BY weight DESC, i) - 1 AS rank, {r6('r')} AS r, {r6('g')} AS g, {r6('b')} AS b, {r6('weight')} AS weight FROM (
    SELECT l.shot_id, i, l.ms[i].r AS r, l.ms[i].g AS g, l.ms[i].b AS b, coalesce(e.w, 0) / sum(coalesce(e.w, 0)) OVER (PARTITION BY l.shot_id) AS weight
    FROM (SELECT shot_id, ms, unnest(range(1, len(ms) + 1)) AS i FROM lloyd WHERE n = 10) l LEFT JOIN ended e ON e.shot_id = l.shot_id AND e.j = l.i)""", *LLOYD, recursive=True))
def palette(spark, sf):
    return _rounded(M.palette(V.spark_sql(spark, sf, PIXEL_SQL)), ("shot_id", "rank"), ("r", "g", "b", "weight"))


@query("palette_mean", sql(f"SELECT shot_id, 0::BIGINT AS rank, {r6('avg(r)')} AS r, {r6('avg(g)')} AS g, {r6('avg(b)')} AS b, {r6('1.0::DOUBLE')} AS weight FROM px GROUP BY 1", ("px", _duck(PIXEL_SQL))))
def palette_mean(spark, sf):
    return _rounded(M.palette(V.spark_sql(spark, sf, PIXEL_SQL), 1), ("shot_id", "rank"), ("r", "g", "b", "weight"))


@query("weighted_centroid", sql(f"""SELECT asset_id, {r6('sx')} AS subject_x, {r6('sy')} AS subject_y,
    {r6('greatest(0.0, 1 - (least(abs(sx - 1/3), abs(sx - 2/3)) + least(abs(sy - 1/3), abs(sy - 2/3))) / 0.33)')} AS thirds FROM (
    SELECT asset_id, sum(subject_x * duration) / sum(duration) AS sx, sum(subject_y * duration) / sum(duration) AS sy FROM shots GROUP BY 1)"""))
def weighted_centroid(spark, sf):
    d = M.weighted_centroid(V.shots(spark, sf), ("asset_id",), "subject_x", "subject_y", "duration")
    return d.withColumn("thirds", S.thirds_alignment(c("subject_x"), c("subject_y"))).select(
        "asset_id", *[R(c(n)).alias(n) for n in ("subject_x", "subject_y", "thirds")])


@query("shot_size", sql(f"""SELECT shot_id, CASE WHEN faces = 0 THEN 'unknown' WHEN q > 0.28 THEN 'close_up' WHEN q > 0.12 THEN 'medium' ELSE 'wide' END AS size,
    CASE WHEN faces = 0 THEN 'none' ELSE 'face' END AS basis,
    {r6('CASE WHEN faces = 0 THEN 0.0 ELSE least(1.0, 0.5 + 4 * least(abs(q - 0.12), abs(q - 0.28))) END')} AS confidence
    FROM (SELECT shot_id, faces, face_size_ratio AS q FROM shots)"""))
def shot_size(spark, sf):
    d = V.shots(spark, sf).withColumn("s", S.shot_size(c("faces"), c("face_size_ratio")))
    return d.select("shot_id", c("s.size").alias("size"), c("s.basis").alias("basis"), R(c("s.confidence")).alias("confidence"))


@query("largest_face", sql(f"""SELECT asset_id, count(*) AS faces, {r6('arg_max(face_size_ratio, rk)')} AS face_size_ratio FROM (
    SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY duration * face_size_ratio, -subject_x, -subject_y) AS rk FROM shots) GROUP BY 1"""))
def largest_face(spark, sf):
    b = V.shots(spark, sf).select("asset_id", c("subject_x").alias("x"), c("subject_y").alias("y"), c("duration").alias("w"), c("face_size_ratio").alias("h"))
    return M.largest_box(b, ("asset_id",)).select("asset_id", "faces", R(c("face_size_ratio")).alias("face_size_ratio"))


ENERGY_SQL = """least(greatest(0.34 * least(1.0, flow_magnitude / 3.0) + 0.22 * least(1.0, subject_motion / 4.0)
    + 0.16 * least(1.0, abs(zoom_rate) / 0.05) + 0.14 * contrast + 0.14 * colorfulness, 0), 1)"""


@query("visual_energy", sql(f"SELECT shot_id, {r6(ENERGY_SQL)} AS energy FROM shots"))
def visual_energy(spark, sf):
    e = S.visual_energy(c("flow_magnitude"), c("subject_motion"), c("zoom_rate"), c("contrast"), c("colorfulness"))
    return V.shots(spark, sf).select("shot_id", R(e).alias("energy"))


@query("technical_quality", sql(f"""SELECT shot_id, {r6('''least(greatest(0.26 * sharpness + 0.20 * rs + 0.12 * fs + 0.12 * bs + 0.14 * exposure_health
    + 0.08 * dynamic_range + 0.08 * (1 - blockiness) - 0.10 * noise, 0), 1)''')} AS technical FROM (SELECT *,
      least(greatest(log2(greatest(width * height, 1) / (640.0 * 360)) / 4.0, 0), 1) AS rs, least(greatest((fps - 20.0) / 40.0, 0), 1) AS fs,
      CASE WHEN bitrate > 0 THEN least(greatest(bitrate / (width * height * fps) / 0.12, 0), 1) ELSE 0.5 END AS bs FROM shots)"""))
def technical_quality(spark, sf):
    s = S.source_scores(c("width"), c("height"), c("fps"), c("bitrate"))
    t = S.technical_quality(s, c("sharpness"), c("exposure_health"), c("dynamic_range"), c("blockiness"), c("noise"))
    return V.shots(spark, sf).select("shot_id", R(t).alias("technical"))


@query("creative_value", sql(f"""SELECT shot_id, {r6('''least(greatest(0.34 * visual_energy + 0.18 * least(1.0, subject_motion / 4.0) + 0.16 * subject_x
    + 0.16 * CASE WHEN faces > 0 THEN 1.0 ELSE 0.35 END + 0.16 * motion_consistency, 0), 1)''')} AS creative FROM shots"""))
def creative_value(spark, sf):
    e = S.creative_value(c("visual_energy"), c("subject_motion"), c("subject_x"), c("faces"), c("motion_consistency"))
    return V.shots(spark, sf).select("shot_id", R(e).alias("creative"))


LINE = [
    ("l0", """SELECT series_id, n, v, coalesce(lag(v) OVER w, v) AS p, coalesce(lead(v) OVER w, v) AS x, abs(lead(v) OVER w - v) AS st
        FROM (SELECT series_id, n, v * 6 AS v FROM sig) WINDOW w AS (PARTITION BY series_id ORDER BY n)"""),
    ("l1", "SELECT *, p - 2 * v + x AS curve, list_sort([p, v, x])[2] AS md FROM l0"),
    ("l2", """SELECT *, v - md AS rest, abs(coalesce(lag(md) OVER w, md) - 2 * md + coalesce(lead(md) OVER w, md)) AS edge FROM l1
        WINDOW w AS (PARTITION BY series_id ORDER BY n)"""),
    ("l3", "SELECT series_id, quantile_cont(edge, 0.25) AS cut FROM l2 GROUP BY 1"),
]


@query("frame_quality", sql(f"""SELECT series_id, {r6('least(1.0, var_pop(curve) / 450.0)')} AS sharpness,
    {r6('CASE WHEN count(CASE WHEN edge < cut THEN 1 END) < 10 THEN 0 ELSE least(1.0, stddev_pop(CASE WHEN edge < cut THEN rest END) / 12.0) END')} AS noise,
    {r6('''CASE WHEN count(st) < 16 THEN 0 ELSE least(greatest((avg(CASE WHEN n % 8 = 7 THEN st END) /
        CASE WHEN avg(CASE WHEN n % 8 <> 7 THEN st END) = 0 THEN 1e-6 ELSE avg(CASE WHEN n % 8 <> 7 THEN st END) END - 1) / 0.6, 0), 1) END''')} AS blockiness,
    {r6('1 - least(1.0, 4 * (avg(CASE WHEN v > 252 THEN 1.0 ELSE 0 END) + avg(CASE WHEN v < 3 THEN 1.0 ELSE 0 END)))')} AS exposure_health,
    {r6('(quantile_cont(v, 0.98) - quantile_cont(v, 0.02)) / 255.0')} AS dynamic_range
    FROM l2 JOIN l3 USING (series_id) GROUP BY 1""", *LINE))
def frame_quality(spark, sf):
    d = M.line_quality(V.series(spark, sf).withColumn("v", c("v") * 6), flat_min=10)
    return _rounded(d, ("series_id",), ("sharpness", "noise", "blockiness", "exposure_health", "dynamic_range"))


#: Frames of 24 columns from the order lines of each supplier; the last line of pixels is filled up with black.
FRAME_PX = """SELECT l_suppkey AS shot_id, CAST((i - 1) % 24 AS BIGINT) AS x, CAST((i - 1) DIV 24 AS BIGINT) AS y, CAST((l_partkey % 9) * 4 + (l_orderkey % 40) * 5 + l_linenumber AS BIGINT) AS luma FROM
    (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM {lineitem})"""
FRAME = [
    ("fp0", FRAME_PX.replace("{lineitem}", "lineitem").replace("DIV", "//")),
    ("fsz", "SELECT shot_id, 24 AS w, max(y) + 1 AS h FROM fp0 GROUP BY 1"),
    ("fpx", """SELECT shot_id, w, h, g.x, g.y, coalesce(luma, 0) AS v FROM (SELECT shot_id, w, h, unnest(range(w)) AS x, y FROM (SELECT *, unnest(range(h)) AS y FROM fsz)) g LEFT JOIN fp0 USING (shot_id, x, y)"""),
    ("off9", "SELECT unnest([-1, 0, 1]) AS d"),
    ("fmd", """SELECT p.shot_id, p.x, p.y, any_value(p.w) AS w, any_value(p.h) AS h, any_value(p.v) AS v, list_sort(list(q.v))[5] AS md FROM fpx p CROSS JOIN off9 a CROSS JOIN off9 b
        JOIN fpx q ON q.shot_id = p.shot_id AND q.x = least(greatest(p.x + a.d, 0), p.w - 1) AND q.y = least(greatest(p.y + b.d, 0), p.h - 1) GROUP BY 1, 2, 3"""),
    ("four", "SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dx, dy)"),
    ("flp", """SELECT p.shot_id, p.x, p.y, any_value(p.v) AS v, any_value(p.md) AS md, sum(q.v) - 4 * any_value(p.v) AS curve, abs(sum(q.md) - 4 * any_value(p.md)) AS edge FROM fmd p CROSS JOIN four
        JOIN fmd q ON q.shot_id = p.shot_id AND q.x = CASE WHEN p.x + dx < 0 THEN least(1, p.w - 1) WHEN p.x + dx >= p.w THEN greatest(p.w - 2, 0) ELSE p.x + dx END
          AND q.y = CASE WHEN p.y + dy < 0 THEN least(1, p.h - 1) WHEN p.y + dy >= p.h THEN greatest(p.h - 2, 0) ELSE p.y + dy END GROUP BY 1, 2, 3"""),
    ("fst", """SELECT p.shot_id, avg(CASE WHEN p.x % 8 = 7 THEN abs(q.v - p.v) END) AS xon, avg(CASE WHEN p.x % 8 <> 7 THEN abs(q.v - p.v) END) AS xoff, avg(CASE WHEN p.y % 8 = 7 THEN abs(r.v - p.v) END) AS yon,
        avg(CASE WHEN p.y % 8 <> 7 THEN abs(r.v - p.v) END) AS yoff FROM fpx p LEFT JOIN fpx q ON q.shot_id = p.shot_id AND q.x = p.x + 1 AND q.y = p.y LEFT JOIN fpx r ON r.shot_id = p.shot_id AND r.x = p.x AND r.y = p.y + 1 GROUP BY 1"""),
    ("fcut", "SELECT shot_id, quantile_cont(edge, 0.25) AS cut FROM flp GROUP BY 1"),
]


@query("frame_quality_2d", sql(f"""SELECT shot_id, any_value(CAST(w AS BIGINT)) AS width, any_value(CAST(h AS BIGINT)) AS height, {r6('least(1.0, var_pop(curve) / 450.0)')} AS sharpness,
    {r6('CASE WHEN count(CASE WHEN edge < cut THEN 1 END) < 100 THEN 0 ELSE least(1.0, stddev_pop(CASE WHEN edge < cut THEN v - md END) / 12.0) END')} AS noise,
    {r6('any_value(least(greatest((xon / CASE WHEN xoff = 0 THEN 1e-6 ELSE xoff END - 1) / 0.6, 0), 1))')} AS blockiness,
    {r6('CASE WHEN any_value(h) - 1 < 16 OR any_value(yon) IS NULL THEN 0 ELSE any_value(least(greatest((yon / CASE WHEN yoff = 0 THEN 1e-6 ELSE yoff END - 1) / 0.6, 0), 1)) END')} AS blockiness_down,
    {r6('1 - least(1.0, 4 * (avg(CASE WHEN v > 252 THEN 1.0 ELSE 0 END) + avg(CASE WHEN v < 3 THEN 1.0 ELSE 0 END)))')} AS exposure_health,
    {r6('(quantile_cont(v, 0.98) - quantile_cont(v, 0.02)) / 255.0')} AS dynamic_range
    FROM flp JOIN fcut USING (shot_id) JOIN fst USING (shot_id) JOIN fsz USING (shot_id) GROUP BY 1""", *FRAME))
def frame_quality_2d(spark, sf):
    px = V.spark_sql(spark, sf, FRAME_PX)
    rows = px.groupBy("shot_id").agg((F.max("y") + 1).alias("h"))
    grid = rows.select("shot_id", F.explode(F.sequence(F.lit(0), c("h") - 1)).alias("y")).select("shot_id", "y", F.explode(F.expr("sequence(0L, 23L)")).alias("x"))
    full = grid.join(px, ["shot_id", "x", "y"], "left").withColumn("luma", F.coalesce("luma", F.lit(0)))
    d = FR.frame_quality(full, ("shot_id",), tile=16)
    return _rounded(d, ("shot_id", "width", "height"), ("sharpness", "noise", "blockiness", "blockiness_down", "exposure_health", "dynamic_range"))


VERDICT = [
    ("h0", """SELECT *, CASE WHEN technical_quality < 0.10 AND creative_value < 0.30 THEN 'reject'
        WHEN technical_quality < 0.28 AND creative_value >= 0.55 THEN 'use_briefly' WHEN technical_quality < 0.30 THEN 'replace'
        WHEN technical_quality < 0.55 THEN 'enhance' ELSE 'use' END AS h FROM shots"""),
    ("h1", """SELECT *, CASE WHEN h = 'reject' THEN [] ELSE list_filter([
          CASE WHEN noise > 0.12 THEN 'noise' END, CASE WHEN sharpness < 0.30 THEN 'softness' END,
          CASE WHEN blockiness > 0.35 THEN 'blockiness' END, CASE WHEN shake > 1.6 AND motion_consistency < 0.55 THEN 'shake' END,
          CASE WHEN dynamic_range < 0.30 THEN 'low_contrast' END], lambda x: x IS NOT NULL) END AS df,
        CASE WHEN brightness < 0.02 THEN 'essentially black' WHEN brightness > 0.98 THEN 'completely blown out'
          WHEN flow_magnitude < 0.01 AND visual_energy < 0.02 AND sharpness < 5 THEN 'frozen and featureless' END AS bad FROM h0"""),
    ("h2", """SELECT *, CASE WHEN h IN ('use', 'enhance') OR bad IS NOT NULL THEN [] ELSE list_filter([
          CASE WHEN contrast > 0.05 OR visual_energy > 0.05 THEN 'flash_frame' END, CASE WHEN flow_magnitude > 1.5 OR shake > 1 THEN 'transition' END,
          CASE WHEN visual_energy > 0.15 OR flow_magnitude > 0.8 THEN 'rapid_montage' END, CASE WHEN noise > 0.15 THEN 'texture' END,
          CASE WHEN sharpness < 30 AND shake < 1.5 THEN 'background' END], lambda x: x IS NOT NULL) END AS sv FROM h1"""),
    ("h3", """SELECT *, CASE WHEN len(sv) > 0 THEN CASE WHEN list_contains(sv, 'rapid_montage') THEN 0.5 WHEN list_contains(sv, 'transition') THEN 0.35
          WHEN list_contains(sv, 'flash_frame') THEN 0.2 END END AS cap FROM h2"""),
    ("h4", """SELECT *, CASE WHEN len(sv) > 0 AND h IN ('replace', 'reject') THEN 'use_briefly' WHEN len(sv) = 0 AND h = 'replace' AND bad IS NOT NULL THEN 'reject'
          WHEN h = 'use' AND len(df) > 0 THEN 'enhance' ELSE h END AS verdict,
        CASE WHEN h = 'use_briefly' THEN least(0.3, coalesce(cap, 0.3)) ELSE cap END AS most FROM h3"""),
]


@query("handling", sql(f"""SELECT shot_id, verdict, {r6('most')} AS max_useful_duration,
    array_to_string(CASE WHEN h = 'use' AND len(df) > 0 THEN ['otherwise good, but treatable: ' || array_to_string(df, ', ')] ELSE list_concat(
      CASE h WHEN 'reject' THEN ['very low technical quality with no creative compensation'] WHEN 'use_briefly' THEN ['weak technically but creatively valuable']
        WHEN 'replace' THEN ['low technical quality and limited creative value'] WHEN 'use' THEN ['already good, no enhancement applied']
        ELSE CASE WHEN noise > 0.35 OR sharpness < 0.30 OR exposure_health < 0.75 THEN list_filter([CASE WHEN noise > 0.35 THEN 'denoise justified' END,
          CASE WHEN sharpness < 0.30 THEN 'detail enhancement justified' END, CASE WHEN exposure_health < 0.75 THEN 'exposure correction justified' END],
          lambda x: x IS NOT NULL) ELSE ['mild correction justified'] END END,
      CASE WHEN len(sv) > 0 AND h IN ('replace', 'reject') THEN ['not good enough to hold, but usable briefly as: ' || array_to_string(sv, ', ')]
        WHEN len(sv) = 0 AND h = 'replace' AND bad IS NOT NULL THEN ['rejected: ' || bad] ELSE [] END) END, '; ') AS reasons FROM h4""", *VERDICT))
def handling(spark, sf):
    d = S.assess(V.shots(spark, sf))
    return d.select("shot_id", c("handling").alias("verdict"), R(c("max_useful_duration")).alias("max_useful_duration"),
                    F.array_join("reasons", "; ").alias("reasons"))


@query("defects", sql(f"""SELECT shot_id, d AS defect, {r6('''least(greatest(0.35 + 0.65 * CASE d WHEN 'noise' THEN (noise - 0.12) / (0.35 - 0.12)
    WHEN 'softness' THEN (0.30 - sharpness) / 0.30 WHEN 'blockiness' THEN (blockiness - 0.35) / 0.65 WHEN 'shake' THEN (shake - 1.6) / 3.4
    ELSE (0.30 - dynamic_range) / 0.30 END, 0), 1)''')} AS severity,
    CASE d WHEN 'noise' THEN 'denoise' WHEN 'softness' THEN 'sharpen' WHEN 'blockiness' THEN 'deblock' WHEN 'shake' THEN 'stabilize' ELSE 'expand_contrast' END AS treatment
    FROM (SELECT *, unnest(df) AS d FROM h1)""", *VERDICT[:2]))
def defects(spark, sf):
    d = S.assess(V.shots(spark, sf)).select("shot_id", F.explode_outer("defects").alias("d")).filter("d IS NOT NULL")
    return d.select("shot_id", c("d.defect").alias("defect"), R(c("d.severity")).alias("severity"), c("d.treatment").alias("treatment"))


@query("salvage", sql(f"SELECT shot_id, array_to_string(sv, ',') AS roles, {r6('cap')} AS cap, bad AS unusable FROM h3", *VERDICT[:4]))
def salvage(spark, sf):
    d = S.assess(V.shots(spark, sf)).withColumn("u", S.unusable(c("brightness"), c("visual_energy"), c("sharpness"), c("flow_magnitude")))
    return d.select("shot_id", F.array_join(F.transform("salvage", lambda r: r["role"]), ",").alias("roles"),
                    R(S.salvage_cap(c("salvage"))).alias("cap"), c("u").alias("unusable"))


VEC_PARTS = """[brightness, contrast, saturation, colorfulness, (warmth + 1) / 2, subject_x, subject_x, subject_y,
    least(1.0, flow_magnitude / 4.0), least(1.0, subject_motion / 5.0), (least(greatest(zoom_rate, -0.05), 0.05) + 0.05) / 0.1,
    least(1.0, shake / 4.0), motion_consistency, visual_energy, """ + ", ".join(
    f"CASE WHEN camera_movement = '{m}' THEN 1.0 ELSE 0 END" for m in MOVES) + """,
    (l_partkey % 256) / 255.0 * 0.6, (l_suppkey % 256) / 255.0 * 0.6, (shot_no * 30 % 256) / 255.0 * 0.6,
    (l_suppkey % 256) / 255.0 * 0.4, (l_partkey % 256) / 255.0 * 0.4, 0.5 * 0.4, 0, 0, 0]"""


def vectors(shots):
    """Feature vectors of the stand-in shots, with a two-colour palette made from their keys."""
    p = F.array(F.struct((c("shot_no") * 30 % 256).cast("double").alias("b"), (c("l_suppkey") % 256).cast("double").alias("g"),
                         (c("l_partkey") % 256).cast("double").alias("r"), F.lit(0.6).alias("weight")),
                F.struct(F.lit(127.5).alias("b"), (c("l_partkey") % 256).cast("double").alias("g"),
                         (c("l_suppkey") % 256).cast("double").alias("r"), F.lit(0.4).alias("weight")))
    return S.with_features(shots.withColumn("thirds_alignment", c("subject_x")), p)


@query("feature_vector", sql(f"""SELECT shot_id, {r6('list_sum(v)')} AS total, {r6('list_dot_product(v, [CAST(i AS DOUBLE) for i in range(1, 33)])')} AS weighted, CAST(len(v) AS BIGINT) AS dims FROM (
    SELECT shot_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT shot_id, CAST({VEC_PARTS} AS DOUBLE[]) AS v FROM shots))"""))
def feature_vector(spark, sf):
    d = vectors(V.shots(spark, sf))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    weighted = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(1), F.lit(32)), lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    return d.select("shot_id", R(total).alias("total"), R(weighted).alias("weighted"), F.size("embedding").cast("long").alias("dims"))


@query("library_stats", sql(f"""SELECT 'library' AS facet, 'all' AS label, count(*) AS shots, {r6('sum(duration)')} AS duration FROM shots
    UNION ALL SELECT 'handling', handling, count(*), {r6('sum(duration)')} FROM shots GROUP BY 2
    UNION ALL SELECT 'camera_movement', camera_movement, count(*), {r6('sum(duration)')} FROM shots GROUP BY 2"""))
def library_stats(spark, sf):
    return M.library_stats(V.shots(spark, sf)).select("facet", "label", "shots", R(c("duration")).alias("duration"))

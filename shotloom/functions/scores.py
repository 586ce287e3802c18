"""Scores and classifications of one shot, as column expressions over its measures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..rules import measures as M
from .maths import clip, present

c = F.col


def classify_movement(dx, dy, zoom, shake, magnitude, half_width, coherence, consistency) -> Column:
    """Named camera move and confidence from the mean flow of a shot."""
    edge_speed = F.abs(zoom) * half_width * 2.0
    carried = magnitude * coherence
    wobble = shake / (magnitude + 0.3)

    def named(name, confidence):
        return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("movement"),
                        (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"))

    def capped(x):
        return F.least(F.lit(1.0), x)

    return (F.when((carried < 0.35) & (shake * coherence < 0.30) & (edge_speed < 0.30), named("static", 0.9))
             .when((edge_speed > 0.28) & (edge_speed > carried * 0.75),
                   named(F.when(zoom > 0, "push_in").otherwise("pull_out"), capped(edge_speed / 1.5)))
             .when((wobble > 0.5) & (consistency < M.STEADY_FROM) & (coherence > 0.4), named("handheld", capped(wobble)))
             .when((F.abs(dx) > F.abs(dy) * 1.4) & (F.abs(dx) * coherence > 0.35),
                   named(F.when(dx < 0, "pan_right").otherwise("pan_left"), capped(F.abs(dx) / 3.0)))
             .when((F.abs(dy) > F.abs(dx) * 1.4) & (F.abs(dy) * coherence > 0.35),
                   named(F.when(dy < 0, "tilt_down").otherwise("tilt_up"), capped(F.abs(dy) / 3.0)))
             .otherwise(named("complex", 0.4)))


def light_key(brightness, contrast) -> Column:
    return (F.when((brightness < 0.32) & (contrast > 0.35), "low_key")
             .when(brightness > 0.62, "high_key").otherwise("mid"))


def thirds_alignment(x, y) -> Column:
    """1 on the nearest third lines, falling to 0 with distance."""
    def off(p):
        return F.least(*[F.abs(p - F.lit(t)) for t in M.THIRDS])
    return F.greatest(F.lit(0.0), 1 - (off(x) + off(y)) / 0.33)


def shot_size(faces, ratio) -> Column:
    """Framing from the height of the largest face; never guessed without one."""
    lo, hi = M.SIZE_EDGES
    margin = F.least(*[F.abs(ratio - F.lit(e)) for e in M.SIZE_EDGES])
    name = F.when(ratio > hi, "close_up").when(ratio > lo, "medium").otherwise("wide")
    seen = faces > 0
    return F.struct(F.when(seen, name).otherwise("unknown").alias("size"),
                    F.when(seen, "face").otherwise("none").alias("basis"),
                    F.when(seen, F.least(F.lit(1.0), 0.5 + margin * 4)).otherwise(0.0).alias("confidence"))


def visual_energy(flow, subject, zoom, contrast, colorfulness) -> Column:
    def part(x, top):
        return F.least(F.lit(1.0), x / top)
    return clip(0.34 * part(flow, 3.0) + 0.22 * part(subject, 4.0) + 0.16 * part(F.abs(zoom), 0.05)
                + 0.14 * contrast + 0.14 * colorfulness, 0, 1)


def source_scores(width, height, fps, bitrate) -> Column:
    """Resolution, frame-rate and bit-rate scores of the source."""
    px = width * height
    bpp = F.when(bitrate > 0, bitrate / F.greatest(px * F.greatest(fps, F.lit(1.0)), F.lit(1.0))).otherwise(0.0)
    return F.struct(
        clip(F.log2(F.greatest(px, F.lit(1)) / F.lit(640.0 * 360.0)) / 4.0, 0, 1).alias("resolution_score"),
        clip((fps - 20.0) / 40.0, 0, 1).alias("fps_score"),
        F.when(bpp > 0, clip(bpp / 0.12, 0, 1)).otherwise(0.5).alias("bitrate_score"))


def technical_quality(s: Column, sharpness, exposure, dynamic_range, blockiness, noise) -> Column:
    return clip(0.26 * sharpness + 0.20 * s["resolution_score"] + 0.12 * s["fps_score"] + 0.12 * s["bitrate_score"]
                + 0.14 * exposure + 0.08 * dynamic_range + 0.08 * (1.0 - blockiness) - 0.10 * noise, 0, 1)


def creative_value(energy, subject, thirds, faces, consistency) -> Column:
    """Worth of a shot irrespective of its technical state."""
    return clip(0.34 * energy + 0.18 * F.least(F.lit(1.0), subject / 4.0) + 0.16 * thirds
                + 0.16 * F.when(faces > 0, 1.0).otherwise(0.35) + 0.16 * consistency, 0, 1)


def handling_by_scores(tq, cv) -> Column:
    """First verdict, from the two composites alone."""
    return (F.when((tq < 0.10) & (cv < 0.30), "reject")
             .when((tq < 0.28) & (cv >= 0.55), "use_briefly")
             .when(tq < 0.30, "replace").when(tq < 0.55, "enhance").otherwise("use"))


def first_reasons(tq, cv, noise, sharpness, exposure) -> Column:
    h = handling_by_scores(tq, cv)
    fixes = present(F.when(noise > 0.35, "denoise justified"),
                    F.when(sharpness < 0.30, "detail enhancement justified"),
                    F.when(exposure < 0.75, "exposure correction justified"))
    fixes = F.when(F.size(fixes) == 0, F.array(F.lit("mild correction justified"))).otherwise(fixes)
    return (F.when(h == "reject", F.array(F.lit("very low technical quality with no creative compensation")))
             .when(h == "use_briefly", F.array(F.lit("weak technically but creatively valuable")))
             .when(h == "replace", F.array(F.lit("low technical quality and limited creative value")))
             .when(h == "enhance", fixes)
             .otherwise(F.array(F.lit("already good, no enhancement applied"))))


def severity(value, threshold: float, ceiling: float) -> Column:
    return clip(0.35 + 0.65 * ((value - threshold) / (ceiling - threshold)), 0, 1)


def severity_below(value, threshold: float, floor: float = 0.0) -> Column:
    return clip(0.35 + 0.65 * ((threshold - value) / (threshold - floor)), 0, 1)


def defects(handling, noise, sharpness, blockiness, shake, consistency, dynamic_range) -> Column:
    """Treatable defects with severity and treatment; none for rejected shots."""
    t = M.DEFECT_THRESHOLDS

    def found(cond, name, level, treatment):
        return F.when(cond, F.struct(F.lit(name).alias("defect"), level.alias("severity"), F.lit(treatment).alias("treatment")))

    items = present(
        found(noise > t["noise"], "noise", severity(noise, t["noise"], 0.35), "denoise"),
        found(sharpness < t["softness"], "softness", severity_below(sharpness, t["softness"]), "sharpen"),
        found(blockiness > t["blockiness"], "blockiness", severity(blockiness, t["blockiness"], 1.0), "deblock"),
        found((shake > t["shake"]) & (consistency < M.STEADY_FROM), "shake", severity(shake, t["shake"], 5.0), "stabilize"),
        found(dynamic_range < t["low_contrast"], "low_contrast", severity_below(dynamic_range, t["low_contrast"]), "expand_contrast"))
    return F.when(handling == "reject", F.slice(items, 1, 0)).otherwise(items)


def unusable(brightness, energy, sharpness, motion: Column | None) -> Column:
    """Why a shot serves no purpose at all, else null.  Without a motion measure nothing counts as frozen."""
    out = F.when(brightness < 0.02, "essentially black").when(brightness > 0.98, "completely blown out")
    if motion is None:
        return out
    return out.when((motion < 0.01) & (energy < 0.02) & (sharpness < 5.0), "frozen and featureless")


def salvage_roles(handling, brightness, contrast, energy, shake, noise, sharpness, motion: Column | None) -> Column:
    """Uses left for a shot that is not good enough to hold; none for good or useless ones.

    ``motion=None`` leaves the motion measure out, as when it was never recorded.
    """
    move = F.lit(0.0) if motion is None else motion

    def role(cond, name):
        return F.when(cond, F.struct(F.lit(name).alias("role"), F.lit(M.ROLE_MAX_DURATION[name]).alias("max_duration"),
                                     F.lit(name in M.REALISABLE).alias("realisable")))

    items = present(
        role((contrast > 0.05) | (energy > 0.05), "flash_frame"),
        role((move > 1.5) | (shake > 1.0), "transition"),
        role((energy > 0.15) | (move > 0.8), "rapid_montage"),
        role(noise > 0.15, "texture"),
        role((sharpness < 30.0) & (shake < 1.5), "background"))
    none = handling.isin("use", "enhance") | unusable(brightness, energy, sharpness, motion).isNotNull()
    return F.when(none, F.slice(items, 1, 0)).otherwise(items)


def salvage_cap(roles: Column) -> Column:
    """Longest hold among the roles that can be carried out."""
    return F.array_max(F.transform(F.filter(roles, lambda r: r["realisable"]), lambda r: r["max_duration"]))


def with_features(df, palette: Column, name: str = "embedding"):
    """Add 32 features of unit length: 14 scaled measures, 9 moves, 3 weighted colours (r, g, b).

    ``palette`` is an array of (b, g, r, weight); fewer than three colours are padded.
    The features stay plain columns until the last step, inside generated code.
    """
    def part(x, top):
        return F.least(F.lit(1.0), x / top)

    items = [c("brightness"), c("contrast"), c("saturation"), c("colorfulness"), (c("warmth") + 1) / 2,
             c("thirds_alignment"), c("subject_x"), c("subject_y"), part(c("flow_magnitude"), 4.0),
             part(c("subject_motion"), 5.0), (clip(c("zoom_rate"), -0.05, 0.05) + 0.05) / 0.1,
             part(c("shake"), 4.0), c("motion_consistency"), c("visual_energy")]
    items += [F.when(c("camera_movement") == m, 1.0).otherwise(0.0) for m in M.MOVES]
    for i in range(3):
        p = F.get(palette, F.lit(i))
        items += [p[ch] / 255.0 * p["weight"] for ch in ("r", "g", "b")]
    names = [f"_f{i}" for i in range(len(items))]
    d = df.withColumns({n: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)) for n, x in zip(names, items)})
    squares = sum((c(n) * c(n) for n in names[1:]), c(names[0]) * c(names[0]))
    d = d.withColumn("_length", F.sqrt(squares)).withColumn("_length", F.when(c("_length") > 0, c("_length")).otherwise(1.0))
    return d.withColumn(name, F.array(*[c(n) / c("_length") for n in names])).drop("_length", *names)


def assess(df, motion: str | None = "flow_magnitude"):
    """Add verdict, cap, reasons, defects and salvage roles to a table of measured shots.

    The order matters: score verdict, defects, salvage override, useless override,
    then the treatable-defect override.
    """
    mv = c(motion) if motion else None
    d = df.withColumn("handling", handling_by_scores(c("technical_quality"), c("creative_value")))
    d = d.withColumns({
        "reasons": first_reasons(c("technical_quality"), c("creative_value"), c("noise"), c("sharpness"), c("exposure_health")),
        "max_useful_duration": F.when(c("handling") == "use_briefly", F.lit(M.BRIEF_SECONDS)),
        "defects": defects(c("handling"), c("noise"), c("sharpness"), c("blockiness"), c("shake"),
                           c("motion_consistency"), c("dynamic_range")),
        "salvage": salvage_roles(c("handling"), c("brightness"), c("contrast"), c("visual_energy"), c("shake"),
                                 c("noise"), c("sharpness"), mv),
        "_useless": unusable(c("brightness"), c("visual_energy"), c("sharpness"), mv)})
    saved = F.size("salvage") > 0
    cap = salvage_cap(c("salvage"))
    held = c("handling").isin("replace", "reject")
    treat = (c("handling") == "use") & (F.size("defects") > 0)
    dropped = ~saved & (c("handling") == "replace") & c("_useless").isNotNull()
    names = F.array_join(F.transform("salvage", lambda r: r["role"]), ", ")
    faults = F.array_join(F.transform("defects", lambda r: r["defect"]), ", ")
    return d.withColumns({
        "max_useful_duration": F.when(saved, F.least("max_useful_duration", cap)).otherwise(c("max_useful_duration")),
        "reasons": F.when(treat, F.array(F.concat(F.lit("otherwise good, but treatable: "), faults)))
                    .when(saved & held, F.array_append("reasons", F.concat(F.lit("not good enough to hold, but usable briefly as: "), names)))
                    .when(dropped, F.array_append("reasons", F.concat(F.lit("rejected: "), c("_useless"))))
                    .otherwise(c("reasons")),
        "handling": F.when(saved & held, "use_briefly").when(dropped, "reject").when(treat, "enhance").otherwise(c("handling")),
    }).drop("_useless")

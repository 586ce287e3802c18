"""Mix planning and delivery conformance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import clip, lookup, present
from ..rules import delivery as D
from .blocks import TIME_BLOCK, block_of, dense_index
from .joins import speech_overlap

c = F.col


def voice_tracks(clips: DataFrame, windows: DataFrame, keys=("series_id",), clip_id="clip_id", clip_range=("c_in", "c_out"), **kw) -> DataFrame:
    """Clips whose own sound holds enough speech to matter, with the reason."""
    d = speech_overlap(clips, windows, keys, clip_id, clip_range, **kw)
    d = clips.join(d, [*keys, clip_id])
    return d.withColumn("reason", F.format_string("%.1fs of detected speech in this clip's own audio", "overlap"))


def plan_mix(timelines: DataFrame, voices: DataFrame, key="timeline_id", target: str = "social", width: float = TIME_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, ducking pairs and scalars of the mix of every timeline.

    ``timelines`` has duration and the knobs continuity_weight, pacing_multiplier and
    music_gain_db; ``voices`` has tl_start, source_in, source_out and is numbered in this order, so that only
    equal voices are interchangeable.
    """
    v = dense_index(voices, [key], ["tl_start", "source_in", "source_out"], block_of(c("tl_start"), width), "_i")
    v = v.select(key, F.format_string("vox%02d", "_i").alias("track_id"), F.lit("voice").alias("role"), "source_in", "source_out", "tl_start",
                 F.lit(0.0).alias("gain_db"), F.lit(0.0).alias("fade_out"))
    some = voices.select(key).distinct().withColumn("_v", F.lit(True))
    t = timelines.join(some, key, "left").withColumn("has_voice", F.coalesce("_v", F.lit(False))).drop("_v")
    gain = F.when(c("has_voice"), -10.0).otherwise(0.0) + F.coalesce("music_gain_db", F.lit(0.0))
    music = t.select(key, F.lit("music").alias("track_id"), F.lit("music").alias("role"), F.lit(0.0).alias("source_in"), c("duration").alias("source_out"),
                     F.lit(0.0).alias("tl_start"), gain.alias("gain_db"), clip(c("duration") * 0.06, 0.4, 1.2).alias("fade_out"))
    ducks = v.select(key, F.lit("music").alias("track_id"), c("track_id").alias("by_id"))
    depth = 9.0 + F.when(c("continuity_weight") > 1.5, 3.0).otherwise(0.0) - F.when(c("pacing_multiplier") < 0.8, 2.0).otherwise(0.0)
    plans = t.select(key, F.lit(D.LOUDNESS_TARGETS.get(target, D.LOUDNESS_TARGETS["social"])).alias("target_lufs"), F.lit(D.TRUE_PEAK_CEILING).alias("true_peak_db"),
                     F.lit(11.0).alias("target_lra"), F.when(c("has_voice"), clip(depth, 3, 18)).otherwise(6.0).alias("duck_depth_db"))
    plans = plans.withColumns({"achievable_db": F.least("duck_depth_db", F.lit(D.MAX_DUCK_DB)), "threshold": duck_threshold(c("duck_depth_db"))})
    return v.unionByName(music), ducks, plans


def duck_threshold(depth: Column) -> Column:
    """Compressor threshold that yields a depth, read off the calibration points in log space."""
    d = clip(depth, 0, D.MAX_DUCK_DB)
    (t0, d0), *rest = D.DUCK_CALIBRATION
    out = F.when(d <= d0, F.least(F.lit(0.2), F.lit(t0 * d0) / F.greatest(d, F.lit(0.5))))
    lo_t, lo_d = t0, d0
    for t1, d1 in rest:
        f = (d - lo_d) / (d1 - lo_d)
        out = out.when(d <= d1, F.round(F.pow(F.lit(10.0), F.log10(F.lit(lo_t)) + f * (F.log10(F.lit(t1)) - F.log10(F.lit(lo_t)))), 5))
        lo_t, lo_d = t1, d1
    return out.otherwise(F.lit(lo_t))


def validate_mix(tracks: DataFrame, ducks: DataFrame, plans: DataFrame, key="timeline_id") -> DataFrame:
    """Issue rows (key, subject, code) for mixes that cannot be delivered."""
    def rule(cond, code):
        return F.when(cond, F.lit(code))

    per = tracks.select(key, c("track_id").alias("subject"), F.explode_outer(present(
        rule(c("source_out") <= c("source_in"), "empty_range"), rule(~c("gain_db").between(-60.0, 24.0), "gain_range"))).alias("code")).filter("code IS NOT NULL")
    dup = tracks.groupBy(key, "track_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key).distinct()
    ids = tracks.select(key, c("track_id").alias("by_id")).distinct()
    unknown = ducks.join(ids, [key, "by_id"], "left_anti").select(key, c("track_id").alias("subject"), F.lit("unknown_duck").alias("code"))
    itself = ducks.filter("by_id = track_id").select(key, c("track_id").alias("subject"), F.lit("self_duck").alias("code"))
    whole = plans.select(key, F.lit("").alias("subject"), F.explode_outer(present(
        rule(~c("target_lra").between(1.0, 20.0), "loudness_range"), rule(~c("target_lufs").between(-40.0, -5.0), "loudness_target"),
        rule(c("true_peak_db") > 0.0, "true_peak"), rule((c("duck_depth_db") <= 0) | (c("duck_depth_db") > 24.0), "duck_depth"))).alias("code")).filter("code IS NOT NULL")
    none = plans.join(tracks.select(key).distinct(), key, "left_anti").select(key, F.lit("").alias("subject"), F.lit("no_tracks").alias("code"))
    dup = dup.select(key, F.lit("").alias("subject"), F.lit("duplicate_ids").alias("code"))
    return per.unionByName(dup).unionByName(unknown).unionByName(itself).unionByName(whole).unionByName(none)


def _profiles() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("profile"), F.lit(w).cast("long").alias("p_width"), F.lit(h).cast("long").alias("p_height"), F.lit(f).alias("p_fps"),
                              F.lit(t).alias("loudness_target"), F.lit(m).cast("double").alias("max_duration")) for n, w, h, f, t, m in D.PROFILES])


def with_profiles(media: DataFrame) -> DataFrame:
    """Every media row against every delivery profile; the profiles are constants of the scan."""
    return media.withColumn("_p", F.explode(_profiles())).select("*", "_p.*").drop("_p")


def plan_scaling(media: DataFrame) -> DataFrame:
    """Whether a profile needs invented pixels, and the scale factor."""
    d = with_profiles(media)
    known = (c("width") > 0) & (c("height") > 0)
    d = d.withColumn("factor", F.when(known, F.least(c("p_width") / c("width"), c("p_height") / c("height"))).otherwise(1.0))
    up = known & (c("factor") > 1.01)
    return d.withColumns({"upscaling": up, "provenance": F.when(up, "upscaled").otherwise("native")})


CHECK = "array<struct<check:string,status:string>>"


def conformance(media: DataFrame, expect_loudness: bool = True) -> DataFrame:
    """Check rows (pass, fail, skip) of every file against every profile, and how many there are of each.

    Media carries what was measured: width, height, fps, codec, pix_fmt, has_audio,
    sample_rate, channels, duration, loudness, true_peak, faststart; null means unmeasured.
    """
    sound = c("has_audio")

    def check(name, ok, when=None, measured=None):
        status = F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail")
        if measured is not None:
            status = F.when(measured.isNull(), "skip").otherwise(status)
        return name, status if when is None else F.when(when, status)

    def tally(of_file: list) -> Column:
        # rows of each status in one number, a base of 1000 apart, so that counting builds no arrays
        return sum((F.coalesce(F.when(s == "pass", 1).when(s == "fail", 1000).when(s == "skip", 1000000), F.lit(0)) for _, s in of_file), F.lit(0))

    target = lookup(D.LOUDNESS_TARGETS, c("loudness_target"))
    # what holds for a file whatever the profile is judged before the profiles multiply the rows
    same = {name: status for name, status in [
        check("video codec", c("codec") == D.VIDEO_CODEC), check("pixel format", c("pix_fmt") == D.PIX_FMT), check("audio stream", sound),
        check("sample rate", c("sample_rate") == D.SAMPLE_RATE, sound), check("channels", c("channels") == D.CHANNELS, sound),
        *([check("true peak", c("true_peak") <= D.TRUE_PEAK_CEILING, sound, c("true_peak"))] if expect_loudness else []),
        check("faststart", c("faststart"), None, c("faststart"))]}
    d = plan_scaling(media.withColumn("_same", tally(list(same.items()))))
    per = dict([
        check("resolution", (c("width") == c("p_width")) & (c("height") == c("p_height"))),
        check("frame rate", F.abs(c("fps") - c("p_fps")) <= 0.05),
        check("duration limit", c("duration") <= c("max_duration") + 0.05, c("max_duration").isNotNull()),
        *([check("loudness", F.abs(c("loudness") - target) <= 1.0, sound, c("loudness"))] if expect_loudness else []),
        ("resolution provenance", F.when(c("upscaling"), "skip"))])
    order = ["resolution", "frame rate", "video codec", "pixel format", "audio stream", "sample rate", "channels", "duration limit", "loudness", "true peak", "faststart", "resolution provenance"]
    both = same | per
    items = [F.when(both[n].isNotNull(), F.struct(F.lit(n).alias("check"), both[n].alias("status"))) for n in order if n in both]
    d = d.withColumns({"checks": present(*items), "_tally": c("_same") + tally(list(per.items()))})
    count = {"passed": c("_tally") % 1000, "failed": F.floor(c("_tally") / 1000) % 1000, "skipped": F.floor(c("_tally") / 1000000)}
    return d.withColumns({n: x.cast("long") for n, x in count.items()}).drop("_same", "_tally")


def qc_rows(conformed: DataFrame, key="file_id") -> DataFrame:
    return conformed.select(key, "profile", F.inline_outer("checks")).filter("check IS NOT NULL")


def qc_summary(conformed: DataFrame, key="file_id") -> DataFrame:
    """Counts per file and profile; conformant when nothing failed, skips do not count."""
    return conformed.select(key, "profile", "passed", "failed", "skipped", (c("failed") == 0).alias("conformant"))

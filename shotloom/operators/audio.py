"""Music and speech analysis on per-frame tables.

Frames are long tables (series, n, …); ``rate`` is the number of frames per second.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.maths import clip
from ..session import stage
from .blocks import BLOCK, block_of, framed, lengths, quantiles
from .peaks import find_peaks
from .series import smooth

c = F.col

# Fixed values of the analysers.
FAST_BPM, SLOW_BPM = 190.0, 60.0
SNAP_SHARE = 0.14
BEATS_PER_BAR = 4
BAND_RATIO_MIN, MODULATION_MIN, LOUD_SHARE = 0.45, 0.14, 0.06
SYLLABLE_HZ = (2.0, 8.0)
NOVELTY_REACH = 16
DROP_RISE = 1.22
NFFT, HOP, BANDS = 2048, 512, 24


def onset_envelope(bands: DataFrame, keys=("series_id",), pos="n", band="band", energy="e", size: int = 32, width: int = BLOCK) -> DataFrame:
    """Rise of the log band energies per frame, less its local mean, scaled to a maximum of 1."""
    keys = list(keys)
    d = bands.select(*keys, band, pos, F.log1p(c(energy) * 100.0).alias("_l"))
    d = framed(d, [*keys, band], pos, 1, 0, {"_rise": lambda w: F.greatest(F.coalesce(c("_l") - F.lag("_l").over(w), F.lit(0.0)), F.lit(0.0))}, width)
    flux = stage(d.groupBy(*keys, pos).agg(F.sum("_rise").alias("_f")))
    d = smooth(flux, size, keys, pos, "_f", "_s", width)
    d = stage(d.select(*keys, pos, F.greatest(c("_f") - c("_s"), F.lit(0.0)).alias("onset")))
    top = d.groupBy(*keys).agg(F.max("onset").alias("_top"))
    return d.join(top, keys).select(*keys, pos, F.when(c("_top") > 0, c("onset") / c("_top")).otherwise(c("onset")).alias("onset"))


def lag_range(rate: float) -> tuple[int, int]:
    return int(rate * 60.0 / FAST_BPM), int(rate * 60.0 / SLOW_BPM)


def tempo_autocorr(onsets: DataFrame, rate: float, keys=("series_id",), pos="n", value="onset", width: int = BLOCK) -> DataFrame:
    """Tempo from the autocorrelation between 190 and 60 beats per minute, faster lags slightly preferred.

    All lags are columns of one ordered pass, so the rows are not multiplied by the lags.
    """
    keys = list(keys)
    lo, hi = lag_range(rate)
    mean = onsets.groupBy(*keys).agg(F.avg(value).alias("_mean"), (F.max(pos) + 1).alias("_len"))
    d = onsets.join(mean, keys).withColumn("_x", c(value) - c("_mean"))
    d = framed(d, keys, pos, hi, 0, {f"_l{k}": (lambda w, k=k: F.lag("_x", k).over(w)) for k in range(lo, hi)}, width)
    d = d.groupBy(*keys).agg(F.max("_len").alias("_len"), *[F.coalesce(F.sum(c("_x") * c(f"_l{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(lo, hi)])
    d = d.withColumn("_k", F.least(F.lit(hi), c("_len") - 1) - lo).filter(c("_k") > 2)
    d = d.withColumn("_ac", F.slice(F.array(*[c(f"_s{k}") for k in range(lo, hi)]), F.lit(1), c("_k").cast("int")))
    d = d.withColumn("_w", F.transform("_ac", lambda x, i: x * (1.06 - 0.06 * i / (c("_k") - 1))))
    d = d.withColumn("period", (F.array_position("_w", F.array_max("_w")) - 1 + lo).cast("long"))
    size = F.aggregate(F.transform("_ac", F.abs), F.lit(0.0), lambda s, x: s + x) / c("_k")
    return d.select(*keys, "period", (F.lit(60.0 * rate) / c("period")).alias("bpm"), (c("period") / F.lit(float(rate))).alias("beat_interval"),
                    clip(F.array_max("_ac") / (size * 6 + 1e-9), 0, 1).alias("confidence"))


def phase_search(onsets: DataFrame, tempo: DataFrame, keys=("series_id",), pos="n", value="onset") -> DataFrame:
    """The phase whose every-period-th frames are strongest, the lowest on ties."""
    keys = list(keys)
    d = onsets.join(tempo.select(*keys, "period"), keys)
    s = d.groupBy(*keys, "period", F.pmod(c(pos), c("period")).alias("phase")).agg(F.sum(value).alias("_s"))
    return s.groupBy(*keys, "period").agg(F.max_by("phase", F.struct(F.round("_s", 9), -c("phase"))).alias("phase"))


def snap_to_peak(onsets: DataFrame, phases: DataFrame, rate: float, keys=("series_id",), pos="n", value="onset") -> DataFrame:
    """Beats: each grid point moved to the strongest frame nearby, the first on ties.

    A frame finds its grid points by arithmetic, so this is one aggregation without a join on time.
    """
    keys = list(keys)
    d = onsets.join(phases.select(*keys, "period", "phase"), keys).join(lengths(onsets, keys, pos), keys)
    tol = F.greatest(F.lit(1), F.floor(c("period") * SNAP_SHARE))
    first = F.ceil((c(pos) - tol - c("phase")) / c("period"))
    last = F.floor((c(pos) + tol - c("phase")) / c("period"))
    top = F.floor((c("len") - 1 - c("phase")) / c("period"))
    a, b = F.greatest(first, F.lit(0)), F.least(last, top)
    d = d.filter(a <= b).withColumn("beat_no", F.explode(F.sequence(a, b)))
    d = d.groupBy(*keys, "beat_no").agg(F.max_by(F.struct(pos, value), F.struct(c(value), -c(pos))).alias("_b"))
    return d.select(*keys, "beat_no", c(f"_b.{pos}").alias(pos), (c(f"_b.{pos}") / F.lit(float(rate))).alias("beat"), c(f"_b.{value}").alias("strength"))


def downbeats(beats: DataFrame, keys=("series_id",)) -> DataFrame:
    """Every fourth beat of the strongest of four phases, for series of at least eight beats (4/4 assumed)."""
    keys = list(keys)
    s = beats.groupBy(*keys, F.pmod(c("beat_no"), F.lit(BEATS_PER_BAR)).alias("bar_phase")).agg(F.sum("strength").alias("_s"), F.count(F.lit(1)).alias("_n"))
    best = s.groupBy(*keys).agg(F.max_by("bar_phase", F.struct(F.round("_s", 9), -c("bar_phase"))).alias("_p"), F.sum("_n").alias("_n")).filter("_n >= 8")
    return beats.join(best, keys).filter(F.pmod(c("beat_no"), F.lit(BEATS_PER_BAR)) == c("_p")).drop("_p", "_n").withColumn("assumption", F.lit("4/4"))


def onset_times(onsets: DataFrame, rate: float, keys=("series_id",), pos="n", value="onset") -> DataFrame:
    keys = list(keys)
    floor = onsets.groupBy(*keys).agg(F.greatest(F.lit(0.12), F.avg(value) * 2.2).alias("height"))
    return find_peaks(onsets, max(1, int(rate * 0.08)), floor, keys, pos, value)


def _gauss(reach: int) -> list[float]:
    sd = reach / 2.0
    mid = (2 * reach - 1) / 2.0
    return [math.exp(-0.5 * ((i - mid) / sd) ** 2) for i in range(2 * reach)]


def novelty(bands: DataFrame, reach: int = NOVELTY_REACH, keys=("series_id",), pos="n", band="band", energy="e", width: int = BLOCK) -> DataFrame:
    """Change of character around each frame: the checkerboard novelty of the frame similarity.

    The kernel is an outer product, so the sum over the similarity square equals the squared
    length of one signed, tapered sum of unit frames; the square itself is never built.
    """
    keys = list(keys)
    d = bands.select(*keys, band, pos, F.log1p(c(energy) * 100.0).alias("_l"))
    size = d.groupBy(*keys, pos).agg((F.sqrt(F.sum(c("_l") * c("_l"))) + 1e-9).alias("_n"))
    d = d.join(size, [*keys, pos]).withColumn("_u", c("_l") / c("_n"))
    g = _gauss(reach)

    def mixed(w):
        out = None
        for i, k in enumerate(g):
            o = i - reach
            x = F.lag("_u", -o).over(w) if o < 0 else F.lead("_u", o).over(w) if o > 0 else c("_u")
            term = F.lit(k if o < 0 else -k) * x
            out = term if out is None else out + term
        return out

    d = framed(d, [*keys, band], pos, reach, reach, {"_z": mixed}, width)
    d = d.groupBy(*keys, pos).agg(F.sum(c("_z") * c("_z")).alias("novelty")).join(lengths(bands, keys, pos), keys)
    inside = (c(pos) >= reach) & (c(pos) < c("len") - reach) & (c("len") > 4 * reach)
    return d.select(*keys, pos, F.when(inside, c("novelty")).otherwise(0.0).alias("novelty"))


def novelty_sections(nov: DataFrame, energy: DataFrame, durations: DataFrame, frame_seconds: float, keys=("series_id",), pos="n", base: int = 64,
                     apart: float = 4.0, shortest: float = 1.0, width: int = BLOCK, time_width: float = 86400.0) -> DataFrame:
    """Sections between the novelty peaks with their mean energy and a high / mid / low label."""
    from .joins import energy_at
    from .series import boundaries_to_segments
    keys = list(keys)
    d = smooth(stage(nov), base, keys, pos, "novelty", "_s", width).withColumn("_v", F.greatest(c("novelty") - c("_s"), F.lit(0.0)))
    top = d.groupBy(*keys).agg(F.max("_v").alias("_top"))
    d = stage(d.join(top, keys).select(*keys, pos, F.when(c("_top") > 0, c("_v") / c("_top")).otherwise(c("_v")).alias("v")))
    pk = find_peaks(d, max(2, int(apart / frame_seconds)), 0.25, keys, pos, "v", width).withColumn("t", c(pos) * frame_seconds)
    segs = boundaries_to_segments(pk, durations, 0.0, keys, "t", time_width).filter(c("end") - c("start") >= shortest)
    spots = segs.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("at", c("start") + (c("end") - c("start")) * c("_i") / 7.0)
    e = energy_at(spots, energy, keys, "at", "t", "energy", time_width).groupBy(*keys, "idx", "start", "end").agg(F.avg("energy_at").alias("energy"))
    return e.withColumn("label", F.when(c("energy") > 0.66, "high").when(c("energy") < 0.33, "low").otherwise("mid"))


def level_jumps(low: DataFrame, rate: float, keys=("series_id",), pos="n", value="low", size: int = 8, width: int = BLOCK,
                suppress: bool = True) -> DataFrame:
    """Moments where the low band jumps and stays up: candidates above the 99.2th percentile of the rise, spaced by
    three seconds, with a mean second after at least 1.22 times the mean second before."""
    keys, second = list(keys), int(rate)
    d = smooth(low, size, keys, pos, value, "_v", width)
    d = framed(d, keys, pos, second, second, {
        "_d": lambda w: F.coalesce(c("_v") - F.lag("_v").over(w), F.lit(0.0)),
        "_pre": lambda w: F.avg("_v").over(w.rowsBetween(-second, -1)),
        "_post": lambda w: F.avg("_v").over(w.rowsBetween(0, second - 1))}, width)
    d = stage(d.select(*keys, pos, "_d", "_pre", "_post"))
    long_enough = lengths(d, keys, pos).filter("len > 40").select(*keys)
    level = quantiles(d, keys, c("_d"), {"_q": 0.992}).join(long_enough, keys, "left_semi").select(*keys, F.greatest("_q", F.lit(1e-6)).alias("height"))
    if suppress:
        hits = find_peaks(d.select(*keys, pos, "_d"), max(2, int(rate * 3)), level, keys, pos, "_d", width).select(*keys, pos)
        d = d.join(hits, [*keys, pos], "left_semi")
    else:
        d = d.join(level, keys).filter(c("_d") >= c("height"))
    return d.filter(c("_post") > c("_pre") * DROP_RISE).select(*keys, pos, (c(pos) / F.lit(float(rate))).alias("t"), c("_pre").alias("before"), c("_post").alias("after"))


def modulation_share(envelope: DataFrame, hop: float, keys=("series_id",), pos="n", value="envelope", seg: int | None = None) -> DataFrame:
    """Share of syllable-rate movement (2-8 Hz) in the envelope around each frame.

    Blocks of a second at half-second steps; every spectral bin is a pair of sums in one
    aggregation, and a frame takes the largest share of the blocks that cover it.
    """
    keys = list(keys)
    seg = seg or max(8, int(1.0 / hop))
    step = max(1, seg // 2)
    d = envelope.select(*keys, pos, c(value).alias("_v")).join(lengths(envelope, keys, pos), keys)
    first = F.greatest(F.floor((c(pos) - seg) / step) + 1, F.lit(0))
    d = d.withColumn("_b", F.explode(F.sequence(first, F.floor(c(pos) / step))))
    d = d.withColumn("_n", F.least(F.lit(seg), c("len") - c("_b") * step)).filter("_n >= 8")
    d = d.withColumn("_a", F.lit(-2 * math.pi) * (c(pos) - c("_b") * step) / c("_n"))
    bins = range(1, seg // 2 + 1)
    sums = [F.sum(f(c("_a") * k) * c("_v")).alias(f"_{t}{k}") for k in bins for t, f in (("c", F.cos), ("s", F.sin))]
    b = d.groupBy(*keys, "_b", "_n").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"), *sums)
    size = {k: F.hypot(f"_c{k}", f"_s{k}") for k in bins}
    used = {k: F.when(F.lit(k) <= F.floor(c("_n") / 2), size[k]).otherwise(0.0) for k in bins}
    freq = {k: F.lit(float(k)) / (c("_n") * hop) for k in bins}
    total = sum(list(used.values())[1:], used[1])
    inside = [F.when((freq[k] >= SYLLABLE_HZ[0]) & (freq[k] <= SYLLABLE_HZ[1]), used[k]).otherwise(0.0) for k in bins]
    share = F.when(c("_max") > c("_min"), sum(inside[1:], inside[0]) / (total + 1e-9)).otherwise(0.0)
    b = b.select(*keys, "_b", share.alias("_share"))
    m = d.select(*keys, pos, "_b").join(b, [*keys, "_b"]).groupBy(*keys, pos).agg(F.max("_share").alias("modulation"))
    return envelope.join(m, [*keys, pos], "left").withColumn("modulation", F.coalesce("modulation", F.lit(0.0)))


def voiced_mask(frames: DataFrame, keys=("series_id",)) -> DataFrame:
    """Frames that pass the band, movement and loudness tests (in_band, total, modulation)."""
    keys = list(keys)
    top = frames.groupBy(*keys).agg(F.greatest(F.max("in_band") * LOUD_SHARE, F.lit(1e-6)).alias("_floor"))
    ratio = c("in_band") / (c("total") + 1e-9)
    return frames.join(top, keys).withColumn("voiced", (ratio >= BAND_RATIO_MIN) & (c("modulation") >= MODULATION_MIN) & (c("in_band") > c("_floor"))).drop("_floor")


def voice_band(spectrum: DataFrame, keys=("series_id",), pos="n", freq="freq", magnitude="mag", low: float = 180.0, high: float = 3400.0) -> DataFrame:
    """Magnitude inside the voice band and in all, per frame of a long spectrum table."""
    return spectrum.groupBy(*keys, pos).agg(F.sum(F.when(c(freq).between(low, high), c(magnitude)).otherwise(0.0)).alias("in_band"), F.sum(magnitude).alias("total"))


FRAMES_AT_ONCE = 4096


def band_energies(chunks: DataFrame, rate: float, keys=("series_id",), no="chunk", pcm="pcm", nfft: int = NFFT, hop: int = HOP, bands: int = BANDS,
                  low: float = 40.0, high: float = 8000.0, width: int = 256) -> DataFrame:
    """Log-spaced band energies of every frame of chunked samples.

    Every chunk but the last of a series has the same length, a multiple of ``hop`` and at
    least ``nfft``.  A chunk reads the head of the next one, so frames across the border are
    whole; each frame belongs to the chunk it starts in.
    """
    keys = list(keys)
    types = dict(chunks.dtypes)
    head = F.slice(c(pcm), F.lit(1), F.lit(nfft))
    d = framed(chunks.withColumn("_head", head), keys, no, 0, 1, {"_next": lambda w: F.lead("_head").over(w)}, width)
    full = chunks.filter(c(no) == 0).select(*keys, F.size(pcm).alias("_full"))
    own = F.transform(pcm, lambda x: x.cast("double"))
    rest = F.coalesce(F.transform("_next", lambda x: x.cast("double")), F.array().cast("array<double>"))
    first = (c(no) * c("_full") / hop).cast("long")
    d = d.join(full, keys).select(*keys, first.alias("_first"), F.size(pcm).alias("_own"), F.concat(own, rest).alias("_x"))
    edges = np.logspace(np.log10(low), np.log10(min(high, rate / 2)), bands + 1)
    freqs = np.fft.rfftfreq(nfft, 1.0 / rate)
    member = np.array([(freqs >= edges[i]) & (freqs < edges[i + 1]) for i in range(bands)], float)
    share = member / np.maximum(member.sum(1, keepdims=True), 1.0)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nfft) / nfft)
    scale = 1.0 / taper.sum()

    def spectra(batches):
        for batch in batches:
            x = batch.column("_x")
            flat, size = x.flatten().to_numpy(zero_copy_only=False), x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.cumsum(size) - size
            frames = np.maximum(0, -(-np.minimum(batch.column("_own").to_numpy(), size - nfft + 1) // hop))
            of = np.repeat(np.arange(len(size)), frames)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(frames) - frames, frames)
            # all frames of a batch are transformed together, a bounded number at a time
            for lo in range(0, len(of), FRAMES_AT_ONCE):
                row, nth = of[lo:lo + FRAMES_AT_ONCE], inside[lo:lo + FRAMES_AT_ONCE]
                cut = flat[(begin[row] + nth * hop)[:, None] + np.arange(nfft)] * taper
                e = (np.abs(np.fft.rfft(cut, axis=1)) * scale) @ share.T
                at = pa.array(np.repeat(row, bands))
                n = np.repeat(batch.column("_first").to_numpy()[row] + nth, bands)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), pa.array(n), pa.array(np.tile(np.arange(bands), len(row))), pa.array(e.reshape(-1))], [*keys, "n", "band", "e"])

    return d.mapInArrow(spectra, ", ".join(f"{k} {types[k]}" for k in keys) + ", n long, band long, e double")


def chunked(samples: DataFrame, size: int, keys=("series_id",), pos="n", value="v") -> DataFrame:
    """Single samples gathered into fixed chunks of ``size``."""
    d = samples.groupBy(*keys, block_of(c(pos), size).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("_s"))
    return d.select(*keys, "chunk", F.transform("_s", lambda s: s[value].cast("double")).alias("pcm"))

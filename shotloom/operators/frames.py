"""Quality of whole frames given as tables of pixels.

A frame may have any number of pixels.  It is cut into tiles with a border of two pixels, which is what the 3x3 median followed
by the Laplacian reaches; every tile gives counts per value, and all results follow from these counts, so that percentiles are
exact and nothing but a few hundred rows per frame meets after the tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.maths import clip
from ..session import stage
from .blocks import by_group
from .measures import BLOCK_STEP, FLAT_MIN, FLAT_SHARE

TILE = 256
HALO = 2

c = F.col


def _part(m: np.ndarray, at: tuple[int, int], box: tuple[int, int, int, int]) -> np.ndarray:
    """The pixels of ``box`` (x from, x to, y from, y to) of an array whose first pixel is ``at``."""
    x0, x1, y0, y1 = box
    return m[y0 - at[1]:y1 - at[1], x0 - at[0]:x1 - at[0]]


def _wider(box, by: int, size) -> tuple[int, int, int, int]:
    x0, x1, y0, y1 = box
    return max(0, x0 - by), min(size[0], x1 + by), max(0, y0 - by), min(size[1], y1 + by)


def _laplacian(m: np.ndarray, box, size) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel for the pixels of ``box``; ``m`` reaches one pixel further, and at
    borders of the frame the row inside the border row is seen again beyond it."""
    for axis, n, (lo, hi), end in ((0, m.shape[0], box[2:], size[1]), (1, m.shape[1], box[:2], size[0])):
        take = [*([min(1, n - 1)] if lo == 0 else []), *range(n), *([max(n - 2, 0)] if hi == end else [])]
        m = np.take(m, take, axis)
    return m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * m[1:-1, 1:-1]


def _median(m: np.ndarray, box, size) -> np.ndarray:
    """Middle of the 3x3 neighbourhood for the pixels of ``box``; border pixels of the frame are repeated outwards."""
    m = np.pad(m, [(int(lo == 0), int(hi == end)) for (lo, hi), end in ((box[2:], size[1]), (box[:2], size[0]))], mode="edge")
    h, w = m.shape
    return np.sort(np.stack([m[i:h - 2 + i, j:w - 2 + j] for i in range(3) for j in range(3)]), axis=0)[4]


KINDS = ("curve", "edge", "luma", "across", "down")


def tile_values(v: np.ndarray, box: tuple[int, int, int, int], size: tuple[int, int]) -> list[tuple]:
    """(number of the kind, values, what is summed per value) of the tile ``box`` of a frame; ``v`` reaches ``HALO`` pixels
    further where the frame does."""
    whole, near = _wider(box, HALO, size), _wider(box, 1, size)
    at = whole[0], whole[2]
    own = _part(v, at, box)
    curve = _laplacian(_part(v, at, near), box, size)
    mid = _median(v, near, size)
    out = [(0, np.zeros(curve.size, np.int64), curve), (1, np.abs(_laplacian(mid, box, size)), own - _part(mid, (near[0], near[2]), box)), (2, own, np.zeros(own.size))]
    x0, x1, y0, y1 = box
    across = np.abs(np.diff(_part(v, at, (x0, min(x1 + 1, size[0]), y0, y1)), axis=1))
    down = np.abs(np.diff(_part(v, at, (x0, x1, y0, min(y1 + 1, size[1]))), axis=0)).T
    for kind, step, first in ((3, across, x0), (4, down, y0)):
        if step.size:
            on = np.broadcast_to((np.arange(step.shape[1]) + first) % BLOCK_STEP == BLOCK_STEP - 1, step.shape)
            out.append((kind, on.astype(np.int64), step))
    return [(kind, value.ravel(), extra.ravel().astype(float)) for kind, value, extra in out]


def counted(tiles: list[tuple[int, list[tuple]]]) -> tuple[np.ndarray, ...]:
    """Tile, kind, value, n, s1, s2 for the values of many tiles at once."""
    parts = [(g * len(KINDS) + kind, value, extra) for g, got in tiles for kind, value, extra in got]
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    value, extra = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
    low = value.min()
    span = value.max() - low + 1
    code, at = np.unique(np.repeat([x[0] for x in parts], [len(x[1]) for x in parts]) * span + (value - low), return_inverse=True)
    of = code // span
    sums = (np.bincount(at), np.bincount(at, extra), np.bincount(at, extra * extra))
    return of // len(KINDS), of % len(KINDS), code % span + low, *(x.astype(np.int64) for x in sums)


def frame_quality(pixels: DataFrame, keys=("shot_id", "frame"), x="x", y="y", luma="luma", tile: int = TILE, flat_min: int = FLAT_MIN) -> DataFrame:
    """Sharpness, noise, blockiness (across and down), exposure and range per frame.

    ``pixels`` has every pixel of a frame once, x and y counted from 0, luma 0 to 255 (rounded).  Sharpness is the variance of
    the Laplacian; noise what a 3x3 median takes away where the median's Laplacian is below its own 25th percentile, 0 with
    fewer than ``flat_min`` such pixels; blockiness compares steps over every eighth border with the others, 0 below 16 steps.
    Frames with missing or repeated pixels or a null luma get nulls.
    """
    keys = list(keys)
    at = lambda p: F.floor(p / tile).cast("long")
    px = pixels.select(*keys, c(x).cast("long").alias("x"), c(y).cast("long").alias("y"), F.round(luma).cast("long").alias("v"))
    size = px.groupBy(*keys).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"), F.count("v").alias("_n"), F.least(F.min("x"), F.min("y")).alias("_o"))
    sized = px.join(size, keys)
    spread = lambda p, most: F.explode(F.sequence(at(F.greatest(p - HALO, F.lit(0))), at(F.least(p + HALO, most - 1))))
    cut = sized.withColumn("_tx", spread(c("x"), c("_w"))).withColumn("_ty", spread(c("y"), c("_h")))
    fields = [f for f in pixels.schema.fields if f.name in keys]
    schema = StructType([*fields, StructField("kind", StringType()), *[StructField(n, LongType()) for n in ("value", "n", "s1", "s2")]])

    def run(table: pa.Table, at: np.ndarray) -> pa.Table:
        every = {n: table.column(n).to_numpy() for n in ("x", "y", "_w", "_h", "_tx", "_ty")}
        luma, tiles = table.column("v").fill_null(0).to_numpy(), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            w, h, tx, ty = (int(every[n][a]) for n in ("_w", "_h", "_tx", "_ty"))
            xs, ys = every["x"][a:b], every["y"][a:b]
            left, top = int(xs.min()), int(ys.min())
            v = np.zeros((int(ys.max()) - top + 1, int(xs.max()) - left + 1), np.int64)
            v[ys - top, xs - left] = luma[a:b]
            box = tx * tile, min((tx + 1) * tile, w), ty * tile, min((ty + 1) * tile, h)
            x0, x1, y0, y1 = _wider(box, HALO, (w, h))
            if (x0, x1, y0, y1) == (left, left + v.shape[1], top, top + v.shape[0]) and b - a == v.size:        # else a frame with gaps
                tiles.append((a, tile_values(v, box, (w, h))))
        first, kind, *numbers = counted(tiles)
        out = table.select(keys).take(pa.array(first))
        return pa.table([*out.columns, pa.array(KINDS).take(pa.array(kind)), *(pa.array(x) for x in numbers)], [*keys, "kind", "value", "n", "s1", "s2"])

    counts = by_group(cut, [*keys, "_tx", "_ty"], ["y", "x"], run, schema).groupBy(*keys, "kind", "value").agg(*[F.sum(n).alias(n) for n in ("n", "s1", "s2")])
    counts = stage(counts)      # read for the percentiles and for the sums
    along = W.partitionBy(*keys, "kind").orderBy("value")
    counts = counts.withColumns({"upto": F.sum("n").over(along), "all": F.sum("n").over(W.partitionBy(*keys, "kind"))})

    def percentile(kind: str, share: float):
        place = (c("all") - 1) * F.lit(share)
        low = F.min(F.when((c("kind") == kind) & (c("upto") > F.floor(place)), c("value")))
        high = F.min(F.when((c("kind") == kind) & (c("upto") > F.ceil(place)), c("value")))
        part = F.max(F.when(c("kind") == kind, place - F.floor(place)))
        return low + (high - low) * part

    cuts = counts.groupBy(*keys).agg(percentile("edge", FLAT_SHARE).alias("_cut"), percentile("luma", 0.02).alias("_lo"), percentile("luma", 0.98).alias("_hi"))
    total = lambda what, cond: F.coalesce(F.sum(F.when(cond, c(what))), F.lit(0)).cast("double")
    calm = (c("kind") == "edge") & (c("value") < c("_cut"))
    step = lambda kind, on: (c("kind") == kind) & (c("value") == on)
    sums = counts.join(cuts, keys).groupBy(*keys).agg(
        *[F.first(n).alias(n) for n in ("_lo", "_hi")], *[total(n, c("kind") == "curve").alias(f"_c_{n}") for n in ("n", "s1", "s2")], *[total(n, calm).alias(f"_f_{n}") for n in ("n", "s1", "s2")],
        *[total(n, step(k, on)).alias(f"_{k}{on}_{n}") for k in ("across", "down") for on in (0, 1) for n in ("n", "s1")],
        total("n", (c("kind") == "luma") & (c("value") > 252)).alias("_high"), total("n", (c("kind") == "luma") & (c("value") < 3)).alias("_low"))

    def spread_of(p):
        return c(f"_{p}_s2") / c(f"_{p}_n") - F.pow(c(f"_{p}_s1") / c(f"_{p}_n"), 2)

    def blockiness(kind, side):
        on, off = c(f"_{kind}1_s1") / c(f"_{kind}1_n"), c(f"_{kind}0_s1") / c(f"_{kind}0_n")
        return F.when((side - 1 < 16) | (c(f"_{kind}1_n") == 0), 0.0).otherwise(clip((on / F.when(off == 0, 1e-6).otherwise(off) - 1.0) / 0.6, 0, 1))

    whole = size.join(sums, keys, "left").withColumn("_ok", (c("_n") == c("_w") * c("_h")) & (c("_c_n") == c("_n")) & (c("_o") == 0))
    measures = {
        "sharpness": F.least(F.lit(1.0), spread_of("c") / 450.0),
        "noise": F.when(c("_f_n") < flat_min, 0.0).otherwise(F.least(F.lit(1.0), F.sqrt(F.greatest(spread_of("f"), F.lit(0.0))) / 12.0)),
        "blockiness": blockiness("across", c("_w")), "blockiness_down": blockiness("down", c("_h")),
        "exposure_health": 1.0 - F.least(F.lit(1.0), (c("_high") + c("_low")) / c("_n") * 4.0), "dynamic_range": (c("_hi") - c("_lo")) / 255.0}
    return whole.select(*keys, c("_w").alias("width"), c("_h").alias("height"), *[F.when(c("_ok"), v).alias(n) for n, v in measures.items()])

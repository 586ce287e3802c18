"""Frame quality against whole arrays, whatever the tiles; palettes against plain rounds."""

import numpy as np
import pytest

from shotloom.operators import frames, measures


def plain(v, flat_min=100):
    h, w = v.shape
    lap = lambda p: p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    mirror = lambda m: np.pad(m, [(1, 1) if n > 1 else (0, 0) for n in m.shape], mode="reflect") if min(m.shape) > 1 else np.pad(np.pad(m, [(1, 1) if n > 1 else (0, 0) for n in m.shape], mode="reflect"), [(0, 0) if n > 1 else (1, 1) for n in m.shape], mode="edge")
    pad = np.pad(v, 1, mode="edge")
    mid = np.median(np.stack([pad[i:h + i, j:w + j] for i in range(3) for j in range(3)]), axis=0)
    edge = np.abs(lap(mirror(mid)))
    flat = edge < np.percentile(edge, 25)

    def blocks(d):
        if d.shape[1] < 16:
            return 0.0
        on = np.arange(d.shape[1]) % 8 == 7
        return float(np.clip((d[:, on].mean() / (d[:, ~on].mean() or 1e-6) - 1) / 0.6, 0, 1))
    return (min(1, lap(mirror(v)).var() / 450), 0.0 if flat.sum() < flat_min else min(1, (v - mid)[flat].std() / 12), blocks(np.abs(np.diff(v, axis=1))), blocks(np.abs(np.diff(v, axis=0)).T),
            1 - min(1, 4 * ((v > 252).mean() + (v < 3).mean())), (np.percentile(v, 98) - np.percentile(v, 2)) / 255)


@pytest.mark.parametrize("tile", [256, 16, 7])
def test_frames_in_tiles(spark, tile):
    rng = np.random.default_rng(3)
    shapes = [(1, 1), (1, 40), (33, 1), (2, 2), (17, 17), (40, 31), (16, 64), (9, 8)]
    made = {}
    for k, (h, w) in enumerate(shapes):
        y, x = np.mgrid[:h, :w]
        made[k] = np.clip((x * 2 + y * 3) % 200 + rng.integers(0, 4, (h, w)) + (x // 8 % 2) * 20, 0, 255).astype(int)
    rows = [(k, 0, int(x), int(y), int(v[y, x])) for k, v in made.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    rows += [(90, 0, 0, 0, 5), (90, 0, 2, 0, 5), (91, 0, 0, 0, 5), (91, 0, 0, 0, 6), (92, 0, 0, 0, None), (93, 0, 1, 1, 4)]
    df = spark.createDataFrame(rows, "shot_id long, frame long, x long, y long, luma int")
    got = {r.shot_id: r for r in frames.frame_quality(df, tile=tile, flat_min=20).collect()}
    names = ("sharpness", "noise", "blockiness", "blockiness_down", "exposure_health", "dynamic_range")
    for k, v in made.items():
        assert np.allclose([got[k][n] for n in names], plain(v, 20), atol=1e-9), (k, v.shape)
        assert (got[k].height, got[k].width) == v.shape
    assert all(got[k][n] is None for k in (90, 91, 92, 93) for n in names) and len(got) == len(made) + 4


def test_palette_is_a_fixed_point(spark):
    rng = np.random.default_rng(5)
    spots = np.array([[20, 30, 40], [200, 10, 60], [90, 220, 130]])
    data = {k: np.clip(spots[rng.integers(0, 3, 400)] + rng.integers(-9, 10, (400, 3)), 0, 255) for k in range(3)}
    data[7], data[8] = np.array([[5, 5, 5]] * 50), np.array([[1, 2, 3]] * 9 + [[9, 9, 9]] * 4)
    df = spark.createDataFrame([(k, *map(int, c)) for k, v in data.items() for c in v], "shot_id long, r int, g int, b int")
    got = measures.palette(df, 3, rounds=30).orderBy("shot_id", "rank").collect()
    for k, v in data.items():
        m = np.array([(x.r, x.g, x.b) for x in got if x.shot_id == k])
        w = [x.weight for x in got if x.shot_id == k]
        assert len(m) == min(3, len(np.unique(v, axis=0))) and abs(sum(w) - 1) < 1e-9 and w == sorted(w, reverse=True)
        near = ((v[:, None] - m[None]) ** 2).sum(2).argmin(1)
        assert np.allclose([v[near == i].mean(0) for i in range(len(m))], m, atol=1e-6) and np.allclose([(near == i).mean() for i in range(len(m))], w)


def test_tiles_are_counted_together():
    """Counts of many tiles in one go are those of each tile alone, and none mixes with another."""
    rng = np.random.default_rng(5)
    tiles = [(g, frames.tile_values(rng.integers(0, 250, (9, 7)), (0, 7, 0, 9), (7, 9))) for g in (0, 4, 9)]
    alone = [row for t in tiles for row in zip(*(x.tolist() for x in frames.counted([t])))]
    assert sorted(zip(*(x.tolist() for x in frames.counted(tiles)))) == sorted(alone) and frames.counted([])[0].size == 0

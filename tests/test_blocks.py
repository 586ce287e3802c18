"""The block helpers against plain Python on whole series, with a hot series holding most rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotloom.operators import audio, blocks as B, joins as J, peaks as P, series as S


@pytest.fixture(scope="module")
def skewed(spark):
    """One series with 1,500 of 1,800 rows; times with gaps and a few repeats of values."""
    rng = np.random.default_rng(3)
    rows = []
    for s, n in ((1, 1500), (2, 200), (3, 97), (4, 3)):
        t = np.sort(rng.choice(np.arange(n * 3), n, replace=False)) * 1.0
        v = rng.integers(0, 12, n).astype(float)
        rows += [(s, i, float(t[i]), float(v[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id long, n long, t double, v double").repartition(5).cache(), rows


def by_series(rows):
    out = {}
    for s, n, t, v in rows:
        out.setdefault(s, []).append((n, t, v))
    return out


def test_dense_index_and_running(skewed):
    df, rows = skewed
    d = B.dense_index(df.drop("n"), ["series_id"], ["t"], B.block_of(F.col("t"), 50.0), "k")
    d = B.running(d, ["series_id"], ["t"], B.block_of(F.col("t"), 50.0), {
        "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "seen": ("last", F.when(F.col("v") > 9, F.col("t"))),
        "coming": ("last", F.when(F.col("v") > 9, F.col("t")), "ahead")})
    got = {(r.series_id, r.k): r for r in d.collect()}
    for s, items in by_series(rows).items():
        total, top, seen = 0.0, -1.0, None
        for n, t, v in items:
            total, top, seen = total + v, max(top, v), t if v > 9 else seen
            r = got[(s, n)]
            coming = next((t2 for _, t2, v2 in items[n:] if v2 > 9), None)
            assert (r.t, r.total, r.top, r.seen, r.coming) == (t, total, top, seen, coming)


def test_framed_equals_whole_window(skewed):
    df, rows = skewed
    d = B.framed(df, ["series_id"], "n", 3, 2, {"m": lambda w: F.sum("v").over(w.rowsBetween(-3, 2)), "p": lambda w: F.lag("v", 2).over(w)}, width=16)
    got = {(r.series_id, r.n): (r.m, r.p) for r in d.collect()}
    assert len(got) == len(rows)
    for s, items in by_series(rows).items():
        v = [x[2] for x in items]
        for i in range(len(v)):
            assert got[(s, i)] == (sum(v[max(0, i - 3):i + 3]), v[i - 2] if i >= 2 else None)


@pytest.mark.parametrize("how", ["forward", "backward", "nearest"])
def test_asof(spark, skewed, how):
    df, rows = skewed
    probes = df.filter("n % 3 = 0").select("series_id", (F.col("t") + F.when(F.col("n") % 2 == 0, 0.0).otherwise(0.5)).alias("q"))
    samples = df.filter("v > 6").select("series_id", "t", "v")
    got = {(r.series_id, r.q): r.s_t for r in B.asof(probes, samples, ["series_id"], "q", "t", ["v"], how, 40.0).collect()}
    for s, items in by_series(rows).items():
        st = np.array([t for _, t, v in items if v > 6])
        for n, t, v in items:
            if n % 3:
                continue
            q = t + (0.0 if n % 2 == 0 else 0.5)
            if how == "forward":
                want = st[st >= q].min() if (st >= q).any() else None
            elif how == "backward":
                want = st[st <= q].max() if (st <= q).any() else None
            else:
                want = st[np.argmin(np.abs(st - q))] if len(st) else None
            assert got[(s, q)] == want


@pytest.mark.parametrize("bins", [4, 1024])
def test_quantiles_exact_beyond_a_bracket(skewed, monkeypatch, bins):
    df, rows = skewed
    monkeypatch.setattr(B, "BINS", bins)
    q = {r.series_id: r for r in B.quantiles(df, ["series_id"], F.col("v") * F.col("t"), {"a": 0.5, "b": 0.02, "c": 0.992}, rows=20).collect()}
    for s, items in by_series(rows).items():
        x = [t * v for _, t, v in items]
        for k, p in (("a", 50), ("b", 2), ("c", 99.2)):
            assert abs(q[s][k] - np.percentile(x, p)) < 1e-9


def test_quantiles_count_only_what_may_be_many(spark):
    x = [5.0] * 400 + [k / 7 for k in range(60)]
    rows = [(1, v) for v in x] + [(2, float(k)) for k in range(9)]
    d = B.quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], F.col("v"), {"lo": 0.01, "m": 0.5, "hi": 0.999}, rows=20)
    for r in d.collect():
        for name, p in (("lo", 1), ("m", 50), ("hi", 99.9)):
            assert abs(r[name] - np.percentile([v for k, v in rows if k == r.k], p)) < 1e-9
    # values in a bracket are neither sorted for the join with the brackets nor held in a hash table by value
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Union" in plan


def test_quantiles_of_extreme_values(spark):
    x = [float("-inf")] * 3 + [-1.7e308, 1.7e308, 0.0, 1e-300] + [5.0] * 90 + [float(k) ** 9 for k in range(60)]
    got = B.quantiles(spark.createDataFrame([(1, v) for v in x] + [(1, None), (2, 4.0)], "k long, v double"), ["k"], F.col("v"), {"m": 0.5, "hi": 0.99}, rows=5).orderBy("k").collect()
    assert got[0].m == np.percentile(x, 50) and abs(got[0].hi / np.percentile(x, 99) - 1) < 1e-12 and (got[1].m, got[1].hi) == (4.0, 4.0)


@pytest.mark.parametrize("gap,width", [(2.0, 9.0), (7.5, 7.5), (4.0, None)])
def test_debounce(skewed, gap, width):
    df, rows = skewed
    got = sorted((r.series_id, r.t) for r in P.keep_spaced(df, ["series_id"], "t", gap, width).collect())
    want = []
    for s, items in by_series(rows).items():
        last = -1e9
        for _, t, _ in items:
            if t - last >= gap:
                want.append((s, t))
                last = t
    assert got == sorted(want)


def test_groups_stay_whole_behind_a_join_that_turns_into_a_broadcast(spark):
    # planned as a sort-merge join on the keys of the groups; adaptive execution broadcasts the small side and reads the other side where it lies
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 4000, 1, 5).select((F.col("id") % 40).alias("series_id"), F.col("id").alias("n"))
        small = spark.createDataFrame([(s,) for s in range(40)], "series_id long")
        sizes = B.by_group(df.join(small, "series_id"), ["series_id"], ["n"], lambda t, at: pa.table({"n": np.diff(at)}), "n long").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r.n for r in sizes] == [100] * 40


def test_spacing_where_adaptive_execution_broadcasts_the_starts_of_blocks(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        beats = spark.range(0, 4000, 1, 5).select((F.col("id") % 40).alias("plan_id"), (F.col("id") / 40).alias("t"))
        kept = P.keep_spaced(beats, ["plan_id"], "t", 2.5).groupBy("plan_id").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(kept) == 40 and {r["count"] for r in kept} == {34}      # of 100 beats, one a second, every third


def test_a_run_of_rising_peaks_crosses_blocks(spark):
    # every peak hangs on the next one, so the last decides and the rest follows back through all blocks of the hot series
    rows = [(1, 2 * k, float(k)) for k in range(900)] + [(2, 5, 1.0), (2, 7, 1.0)]
    got = sorted((r.series_id, r.n) for r in P.thin_by_height(spark.createDataFrame(rows, "series_id long, n long, v double"), 3, block=192).collect())
    assert got == sorted([(1, 2 * k) for k in range(899, -1, -2)] + [(2, 7)])


@pytest.mark.parametrize("distance,block", [(5, 40), (12, 48), (1, None)])
def test_peak_thinning(skewed, distance, block):
    df, rows = skewed
    pk = P.local_maxima(df, ["series_id"], width=33).filter("v >= 5")
    got = sorted((r.series_id, r.n) for r in P.thin_by_height(pk, distance, block=block).collect())
    want = []
    for s, items in by_series(rows).items():
        v, tops, i = [x[2] for x in items], [], 1
        while i < len(v) - 1:
            if v[i] > v[i - 1]:
                j = i
                while j < len(v) - 1 and v[j + 1] == v[i]:
                    j += 1
                if j < len(v) - 1 and v[j + 1] < v[i] and v[i] >= 5:
                    tops.append((i + j) // 2)
                i = j + 1
            else:
                i += 1
        keep = dict.fromkeys(tops, True)
        for a in sorted(tops, key=lambda p: (v[p], p), reverse=True):
            if keep[a]:
                for b in tops:
                    if b != a and abs(a - b) < distance and (v[b], b) < (v[a], a):
                        keep[b] = False
        want += [(s, p) for p in tops if keep[p]]
    assert got == sorted(want)


def test_smooth_reflects(skewed):
    df, rows = skewed
    for size in (5, 8):
        got = {(r.series_id, r.n): r.smooth for r in S.smooth(df, size, width=20).collect()}
        for s, items in by_series(rows).items():
            v = [x[2] for x in items]
            n = len(v)
            for i in range(n):
                idx = [p % (2 * n) for p in range(i - size // 2, i - size // 2 + size)]
                assert abs(got[(s, i)] - sum(v[m if m < n else 2 * n - 1 - m] for m in idx) / size) < 1e-9


def test_points_and_overlaps(skewed):
    df, rows = skewed
    clips = df.filter("n % 4 = 0").select("series_id", F.col("n").alias("clip_id"), F.col("t").alias("c_in"), (F.col("t") + 25).alias("c_out"))
    win = df.filter("v > 8").select("series_id", F.col("t").alias("w_start"), (F.col("t") + F.col("v")).alias("w_end"))
    got = {(r.series_id, r.clip_id): r.overlap for r in J.speech_overlap(clips, win, bin_width=7.0).collect()}
    counts = {(r.series_id, r.clip_id): r.hits for r in J.count_in(clips, win, start="c_in", end="c_out", time="w_start", width=30.0).collect()}
    for s, items in by_series(rows).items():
        ws = [(t, t + v) for _, t, v in items if v > 8]
        for n, t, _ in items:
            if n % 4 == 0:
                want = sum(max(0.0, min(b, t + 25) - max(a, t)) for a, b in ws)
                assert abs(got.get((s, n), 0.0) - (want if want >= 0.25 else 0.0)) < 1e-9
                assert counts[(s, n)] == sum(t <= a <= t + 25 for a, _ in ws)


def test_tempo_and_beats_of_a_pulse_train(spark):
    rows = [(1, n, 1.0 if n % 20 == 3 and (n // 20) % 4 == 2 else 0.8 if n % 20 == 3 else 0.02 * (n % 3)) for n in range(800)]
    df = spark.createDataFrame(rows, "series_id long, n long, onset double")
    t = audio.tempo_autocorr(df, 40.0, width=100)
    assert t.first().period == 20
    ph = audio.phase_search(df, t)
    assert ph.first().phase == 3
    b = audio.snap_to_peak(df, ph, 40.0)
    assert [r.n for r in b.orderBy("beat_no").collect()] == list(range(3, 800, 20))
    assert [r.beat_no % 4 for r in audio.downbeats(b).collect()] == [2] * 10


def test_novelty_equals_the_full_kernel(spark):
    rng = np.random.default_rng(1)
    L, N = 3, 40
    e = rng.random((4, N))
    df = spark.createDataFrame([(1, n, b, float(e[b, n])) for b in range(4) for n in range(N)], "series_id long, n long, band long, e double")
    got = [r.novelty for r in audio.novelty(df, L, width=11).orderBy("n").collect()]
    lb = np.log1p(e * 100)
    u = lb / (np.linalg.norm(lb, axis=0) + 1e-9)
    sim = u.T @ u
    g = np.array(audio._gauss(L))
    sign = np.where(np.arange(2 * L) < L, 1, -1)
    kern = np.outer(g * sign, g * sign)
    want = [(sim[i - L:i + L, i - L:i + L] * kern).sum() if L <= i < N - L else 0.0 for i in range(N)]
    assert np.allclose(got, want)


def test_band_energies_across_chunks(spark):
    rate, nfft, hop = 64.0, 32, 16
    x = np.sin(2 * np.pi * 8 * np.arange(320) / rate)
    chunks = [(1, i, [float(v) for v in x[i * 64:(i + 1) * 64]]) for i in range(5)]
    df = spark.createDataFrame(chunks, "series_id long, chunk long, pcm array<double>")
    d = audio.band_energies(df, rate, nfft=nfft, hop=hop, bands=3, low=2.0, high=32.0)
    got = {(r.n, r.band): r.e for r in d.collect()}
    frames = (len(x) - nfft) // hop + 1
    assert len({n for n, _ in got}) == frames
    assert all(max(range(3), key=lambda b: got[(n, b)]) == 1 for n in range(frames))


def test_groups_come_whole_and_in_order_across_batches(spark):
    """Many small groups share one call; a group longer than a batch, and a null key, come whole."""
    import pyarrow as pa

    rows = [(g, i) for g in (*range(300), None) for i in range(1 + (g or 0) % 7)] + [(1000, i) for i in range(45)]
    df = spark.createDataFrame(rows, "g long, i long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        def ends(table, at):
            i = table.column("i").to_pylist()
            assert all(i[a:b] == list(range(b - a)) for a, b in zip(at[:-1], at[1:]))
            out = table.select(["g"]).take(pa.array(at[:-1]))
            return out.append_column("n", pa.array(at[1:] - at[:-1]))
        got = B.by_group(df, ["g"], ["i"], ends, "g long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.g: r.n for r in got} == {**{g: 1 + g % 7 for g in range(300)}, None: 1, 1000: 45} and len(got) == 302


def test_greedy_steps_make_no_call_per_group(spark):
    t = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 5.0)], "series_id long, t double")
    plan = P.keep_spaced(t, ["series_id"], "t", 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan

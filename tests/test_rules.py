"""Rules on small literal inputs: search, briefs, notes, planning, timelines, logs, reviews."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotloom.functions import ids, scores
from shotloom.operators import logs as L, plan as P, review as K, search as Q, sound as M, style as G, text as T, timeline as TL
from shotloom.rules import planning as RP
from shotloom.sources import media as A, views as V
from shotloom.sources.snapshots import Snapshots


def test_query_with_negation_and_synonyms(spark):
    d = spark.createDataFrame([("a", "no handheld, dark"), ("b", "talking head interview with dialogue"), ("c", "the shot where she looks relieved"),
                               ("d", "best close up, not bright"), ("e", "whip pan")], "query_id string, text string")
    p = T.parse_query(d).cache()
    got = {(r.query_id, r.attribute, r.op, r.value, r.negated) for r in T.criteria_of(p).collect()}
    assert got == {("a", "camera_movement", "==", "handheld", True), ("a", "brightness", "<", "0.35", False), ("b", "speech", "flag", "True", False),
                   ("d", "shot_size", "==", "close_up", False), ("d", "brightness", ">", "0.6", True), ("e", "camera_movement", "prefix", "pan", False)}
    assert [(r.query_id, r.sort_by, r.sort_desc) for r in T.sorts_of(p).collect()] == [("d", "technical_quality", True)]
    words = {r.query_id: r.words for r in T.unmatched_terms(p).collect()}
    assert words["c"] == ["where", "she", "looks", "relieved"] and words["a"] == []


def test_search_reports_inert_and_ranks(spark):
    d = spark.createDataFrame([("s1", 0.9, "static", "unknown", "use", 0.5, None), ("s2", 0.9, "pan_left", "unknown", "use", 0.9, None),
                               ("s3", 0.1, "static", None, "reject", 0.9, None), ("s4", 0.1, "tilt_up", "unknown", "use", 0.2, 0.1)],
                              "shot_id string, brightness double, camera_movement string, shot_size string, handling string, technical_quality double, noise double")
    q = Q.Query("q", (Q.Criterion("brightness", ">", 0.6, "bright"), Q.Criterion("camera_movement", "==", "static", "static"),
                      Q.Criterion("shot_size", "==", "wide", "wide"), Q.Criterion("noise", "<", 0.05, "clean")))
    assert [r.criterion for r in Q.inert_criteria(d, [q]).collect()] == ["wide"]
    hits = Q.search(d, [q]).orderBy("rank").collect()
    assert [(h.shot_id, round(h.score, 3)) for h in hits] == [("s1", 0.667), ("s2", 0.333)]
    assert hits[0].matched == ["bright", "static"] and hits[0].unmet == ["clean"]


def test_vectors_in_several_scans(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "vec_id long, embedding array<double>").repartition(7)
    q = df.filter("vec_id < 9").select(F.col("vec_id").alias("query_id"), "embedding", F.col("vec_id").alias("exclude"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in Q.vector_topk(df, q, 4, per_scan=4).collect()}
    for i in range(9):
        s = v @ (v[i] / np.linalg.norm(v[i]))
        s[i] = -9
        assert [got[(i, k + 1)] for k in range(4)] == list(np.argsort(-s, kind="stable")[:4])


def test_brief_terms_and_context(spark):
    texts = {"a": "not too fast, very warm, hard cuts", "b": "", "c": "fast and slow", "d": "punchy", "e": "intense, punch", "f": "smooth transitions", "g": "restrained but shaky"}
    d = spark.createDataFrame(list(texts.items()), "text_id string, text string")
    r = {x.text_id: x for x in T.interpret_brief(d).collect()}
    assert abs(r["a"].pacing_multiplier - 1.38) < 1e-9 and abs(r["a"].warmth_delta - 0.28 * 1.6) < 1e-9 and r["a"].bias_cut == 2.2
    assert r["b"].pacing_multiplier == 1.0 and r["b"].matched == 0
    assert abs(r["c"].pacing_multiplier - 0.62 * 1.65) < 1e-9
    assert abs(r["d"].pacing_multiplier - 0.7) < 1e-9
    assert abs(r["e"].intensity_gain - (1.0 * 1.3 + 0.15)) < 1e-9
    assert abs(r["f"].continuity_weight - 1.69) < 1e-9 and r["f"].allow_shake is False
    assert r["g"].allow_shake is False or r["g"].max_effects_per_clip == 2
    s = {x.text_id: x.s for x in T.interpret_brief(d).select("text_id", T.constraint_summary().alias("s")).collect()}
    assert s["b"] == "no strong preferences detected" and "hard cuts" in s["a"]


def test_three_words_before_a_term_are_read(spark):
    texts = {"a": "very " + "x" * 700 + " warm", "b": "very one two three warm", "c": "very one two warm", "d": "very, warm", "e": "no brand warm", "f": "very and warm", "g": "not too warm", "h": "x" * 90_000 + " . a bit warm",
             "i": "very warm-hearted; die-hard cuts, hardcuts", "j": None, "k": "isn't that " + "y-" * 200 + " warm"}
    w = {}
    for r in T.term_hits(spark.createDataFrame(list(texts.items()), "text_id string, text string")).collect():
        w.setdefault(r.text_id, {})[r.term] = r.weight
    assert {k: v["warm"] for k, v in w.items()} == {"a": 1.6, "b": 1.0, "c": 1.6, "d": 1.0, "e": -1.0, "f": 1.0, "g": -1.0, "h": 0.5, "i": 1.6, "k": -1.0}
    assert w["i"]["hard cuts"] == 1.0


CLIPS = [(1, 0, 0, "sA", 1.0, 0.2, 0.50), (1, 1, 1, "sB", 1.2, 3.9, 0.45), (1, 2, 2, "sC", 0.8, 0.1, 0.12), (1, 3, 3, "sD", 1.5, 0.3, 0.60)]


def test_notes(spark):
    clips = spark.createDataFrame(CLIPS, "timeline_id long, idx long, slot_index long, source_id string, dur double, shake double, brightness double")
    say = ["hold the last clip for 3 seconds", "lose the shaky one", "lock the opening shot", "no flash", "use a dissolve on clip 2", "punch it up", "clip 9 longer",
           "make it brighter", "tighten the darkest shot", "no blurry one"]
    notes = spark.createDataFrame([(i, 1, s) for i, s in enumerate(say)], "note_id long, timeline_id long, text string")
    got = {(r.note_id, r.kind): (r.slot_index, r.shot_id, r.value) for r in T.parse_notes(notes, clips).collect()}
    assert got[(0, "set_duration")] == (3, None, "3.0")
    assert got[(1, "reject_shot")][1] == "sB"
    assert got[(2, "lock_clip")][0] == 0
    assert got[(3, "ban_effect")][2] == "flash"
    assert got[(4, "force_transition")] == (1, None, "dissolve")
    assert (5, "brief") in got and (6, "unresolved") in got and (7, "unresolved") in got
    assert got[(8, "set_duration")] == (2, None, "0.48")
    assert got[(9, "unmeasured")][2] == "blurry"


def test_equal_texts_of_a_batch_are_read_once(spark):
    import pyarrow as pa

    lows, which = T._once(pa.array([" very fast ", " slow ", " very fast "]))
    assert lows == [" very fast ", " slow "] and which.to_pylist() == [0, 1, 0]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(["very fast, not warm", "", "slow", "very fast, not warm", None, "slow"])], "text_id long, text string").coalesce(1)
    hits = sorted((r.text_id, r.term, r.occ, r.weight) for r in T.term_hits(d).collect())
    assert hits == [(0, "fast", 0, 1.6), (0, "warm", 1, -1.0), (2, "slow", 0, 1.0), (3, "fast", 0, 1.6), (3, "warm", 1, -1.0), (5, "slow", 0, 1.0)]
    assert {r.text_id: r.matched for r in T.interpret_brief(d).collect()} == {0: 2, 1: 0, 2: 1, 3: 2, 4: 0, 5: 1}


def test_notes_are_read_in_one_pass(spark):
    clips = spark.createDataFrame(CLIPS, "timeline_id long, idx long, slot_index long, source_id string, dur double, shake double, brightness double")
    notes = spark.createDataFrame([(1, 1, "make it calmer, no blurry one")], "note_id long, timeline_id long, text string")
    d = T.parse_notes(notes, clips)
    assert {(r.kind, r.clause) for r in d.collect()} >= {("brief", "make it calmer"), ("unmeasured", "no blurry one")}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_movement_classes(spark):
    cases = [(0.0, 0.0, 0.0, 0.0, 0.0, 0.9, 1.0, "static"), (-2.0, 0.1, 0.0, 0.1, 2.0, 0.95, 0.99, "pan_right"), (0.1, 1.5, 0.0, 0.1, 1.5, 0.95, 0.99, "tilt_up"),
             (0.1, 0.1, 0.005, 0.1, 0.2, 0.5, 0.5, "push_in"), (0.1, 0.1, -0.005, 0.1, 0.2, 0.5, 0.5, "pull_out"), (0.2, 0.2, 0.0, 2.0, 2.0, 0.9, 0.1, "handheld"),
             (1.0, 1.0, 0.0, 0.1, 1.4, 0.9, 0.9, "complex")]
    d = spark.createDataFrame(cases, "dx double, dy double, z double, sh double, m double, co double, cs double, want string")
    c = F.col
    for r in d.select("want", scores.classify_movement(c("dx"), c("dy"), c("z"), c("sh"), c("m"), F.lit(128.0), c("co"), c("cs")).alias("g")).collect():
        assert r.g.movement == r.want


def test_salvage_motion_parameter_and_cap(spark):
    row = {"technical_quality": 0.2, "creative_value": 0.3, "noise": 0.2, "sharpness": 0.1, "blockiness": 0.1, "shake": 0.5, "motion_consistency": 0.9, "dynamic_range": 0.5,
           "exposure_health": 0.9, "brightness": 0.5, "contrast": 0.3, "visual_energy": 0.1, "flow_magnitude": 2.0}
    d = spark.createDataFrame(pd.DataFrame([row]))
    a = scores.assess(d).first()
    assert [s.role for s in a.salvage] == ["flash_frame", "transition", "rapid_montage", "texture", "background"]
    assert a.handling == "use_briefly" and a.max_useful_duration == 0.5          # not the 2.5 s of a role that cannot be carried out
    b = scores.assess(d, motion=None).first()
    assert [s.role for s in b.salvage] == ["flash_frame", "texture", "background"] and b.max_useful_duration == 0.2


def test_fingerprint_reads_head_and_tail(spark):
    import hashlib
    long, short = "a" * 10 + "x" * 30 + "b" * 10, "abc"
    d = spark.createDataFrame([(long,), (short,)], "t string").select("t", ids.fingerprint(F.col("t"), 10).alias("f"))
    for r in d.collect():
        raw = r.t.encode()
        want = hashlib.sha256(str(len(raw)).encode() + raw[:10] + (raw[-10:] if len(raw) > 20 else b"")).hexdigest()[:24]
        assert r.f == want


def test_nested_assets_are_split_not_cut(spark):
    d = spark.createDataFrame([(1, i, f"1_s{i:03d}", float(i), i + 1.0, "static", "use") for i in range(25)],
                              "asset_id long, idx long, id string, start double, end double, camera_movement string, handling string")
    nested = A.nest_shots(d, per_part=10)
    assert nested.count() == 3
    assert sorted(r.idx for r in A.flatten_shots(nested).collect()) == list(range(25))


def test_plan_slots_by_hand(spark):
    # level 0.5 asks for 1.7 s, three beats; near the drop it is 0.8 and asks for 0.92 s, two beats, with a flash in front
    arc = [{"role": "hook", "start": 0.0, "end": 2.0}, {"role": "climax", "start": 2.0, "end": 10.1}]
    plan = {"plan_id": 7, "start_offset": 0.0, "target": 6.0, "beat_interval": 0.5, "p10_shot": 0.4, "median_shot": 0.9, "p90_shot": 3.0, "pacing": 1.0, "curve": [0.5], "arc_duration": 10.0,
            "intensity_gain": 1.0, "intensity_offset": 0.0, "pacing_multiplier": 1.0, "min_shot_floor": 0.12, "max_shot_ceiling": 4.0, "effect_density": 0.5}
    schema = ("plan_id long, start_offset double, target double, beat_interval double, p10_shot double, median_shot double, p90_shot double, pacing double, curve array<double>, "
              "arc array<struct<role:string,start:double,end:double>>, arc_duration double, intensity_gain double, intensity_offset double, pacing_multiplier double, "
              "min_shot_floor double, max_shot_ceiling double, effect_density double")
    # the second plan has no measured beat (120 a minute are taken) and lasts longer than 400 slots
    long = plan | {"plan_id": 8, "beat_interval": None, "target": 900.0, "p10_shot": 0.5, "p90_shot": 3.0}
    df = spark.createDataFrame([plan | {"arc": arc}, long | {"arc": None}], schema)
    beats = spark.createDataFrame([(7, 0.5 * k) for k in range(13)], "plan_id long, t double")
    energy = spark.createDataFrame([(p, float(k), 0.5) for p in (7, 8) for k in range(10)], "plan_id long, t double, energy double")
    got = P.plan_slots(df, beats, energy, drops=spark.createDataFrame([(7, 1.9)], "plan_id long, t double")).orderBy("slot").collect()
    want = [(0, 1.5, "hook"), (1.5, 1.7, "punctuation"), (1.7, 2.5, "climax"), (2.5, 4, "climax"), (4, 5.5, "climax"), (5.5, 6, "climax")]
    first = [r for r in got if r.plan_id == 7]
    assert [r.role for r in first] == [w[2] for w in want] and np.allclose([(r.start, r.end) for r in first], [w[:2] for w in want])
    assert [r.beat_locked for r in first] == [True, False, True, True, True, True] and [r.on_drop for r in first] == [False, True, True, False, False, False]
    second = [r for r in got if r.plan_id == 8]
    assert len(second) == 450 and second[-1].end == 900 and not second[0].beat_locked


def test_plans_walk_side_by_side(monkeypatch):
    """The arrays are gone through once per slot of the longest plan, not once per plan, and every plan keeps its own path."""
    rng = np.random.default_rng(3)

    def plan(k):
        beats = np.sort(rng.uniform(0, 30, rng.integers(0, 60)))
        energy = np.sort(rng.uniform(0, 26, rng.integers(0, 20)))
        arc = [{"role": "hook", "start": 0.0, "end": 4.0}, {"role": "climax", "start": 4.0, "end": 20.0}]
        return {"plan_id": k, "start_offset": 1.0, "target": float(rng.choice([8.0, 24.0])), "beat_interval": 0.5, "p10_shot": rng.choice([None, 0.0, 0.4, 0.8]), "median_shot": 0.9,
                "p90_shot": 2.0, "pacing": 1.0, "curve": [0.2, 0.5, 0.9][:k % 4], "arc": arc if k % 2 else None, "arc_duration": 20.0, "intensity_gain": 1.1, "intensity_offset": 0.05,
                "pacing_multiplier": 0.8, "min_shot_floor": 0.12, "max_shot_ceiling": 4.0, "effect_density": 0.5, "_beyond": 0.5, "_beats": [{"t": t} for t in beats],
                "_energy": [{"t": t, "energy": float(e)} for t, e in zip(energy, rng.uniform(0, 1, len(energy)))], "_drops": [{"t": 5.0}], "_down": [{"t": t} for t in beats[::4]]}

    turns, place = [], P._place
    monkeypatch.setattr(P, "_place", lambda *a: turns.append(1) or place(*a))
    kinds = {"curve": pa.list_(pa.float64()), "p10_shot": pa.float64(), **{n: pa.list_(pa.struct([("t", pa.float64()), *extra])) for n, extra in
             (("_beats", []), ("_energy", [("energy", pa.float64())]), ("_drops", []), ("_down", []))},
             "arc": pa.list_(pa.struct([("role", pa.string()), ("start", pa.float64()), ("end", pa.float64())]))}
    plans = [plan(k) for k in range(200)]

    def walk(rows):
        return P._walk(pa.table({n: pa.array([r[n] for r in rows], kinds.get(n)) for n in rows[0]}), "plan_id").to_pylist()

    got = walk(plans)
    together = len(turns)
    alone, most = [], 0
    for p in plans:
        turns.clear()
        alone += walk([p])
        most = max(most, len(turns))
    assert got == alone and len({r["plan_id"] for r in got}) == 200 and together == most
    assert {r["role"] for r in got} >= {"hook", "climax", "release", "punctuation"}
    unmeasured = [walk([plans[1] | {"p10_shot": x, "effect_density": 0.0}]) for x in (None, 0.0, 0.3)]
    assert unmeasured[0] == unmeasured[1] == unmeasured[2]


def test_contents_that_differ_in_the_middle_are_two(spark):
    one, two = "a" * (3 << 20), "a" * (3 << 19) + "b" + "a" * ((3 << 19) - 1)
    d = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    kept = A.dedupe_by_content(A.with_fingerprint(d, "text").select("fingerprint", "doc_id"), "doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert A.with_fingerprint(d, "text", head_tail=True).select("fingerprint").distinct().count() == 1


def test_two_ingest_runs_keep_what_each_brought(spark, tmp_path):
    from shotloom.streaming import streams as X
    store = str(tmp_path / "store")
    for run, keys in enumerate((["a", "b"], ["c", "a"], ["c", "a"])):
        src = str(tmp_path / f"in{run}")
        spark.createDataFrame([(k,) for k in keys], "fingerprint string").write.parquet(src)
        stream = spark.readStream.schema("fingerprint string").parquet(src)
        X.stream_ingest(stream, store, "v1", str(tmp_path / f"ck{run}")).awaitTermination()
    table = Snapshots(spark, store, "fingerprint")
    assert sorted(r.fingerprint for r in table.read().collect()) == ["a", "b", "c"] and len(table.manifest()["commits"]) == 3
    # a repeated batch replaces what it brought; a table rewritten as one commit says the same
    table.append(table.read().filter("fingerprint = 'c'"), table.manifest()["commits"][1]["token"])
    table.compact()
    assert sorted(r.fingerprint for r in table.read().collect()) == ["a", "b", "c"] and table.vacuum() == 4
    assert sorted(r.fingerprint for r in table.read().collect()) == ["a", "b", "c"] and len(table.versions()) == 1


def test_a_quota_keeps_its_last_cut(spark):
    # 12 cuts * 0.6 are 7.2 of 5 + 4 wanted: four fifths of five whips are four
    fit = "named_struct('whip', 0.9D, 'flash', 0.5D, 'dissolve', 0.0D) AS fit"
    d = spark.range(13).selectExpr("39L AS timeline_id", "id AS idx", "1.0D AS dur", fit)
    shares = spark.createDataFrame([(39, 0.4, 0.375, 0.0)], "timeline_id long, whip_share double, flash_share double, dissolve_share double")
    got = {r.transition: r["count"] for r in TL.allocate_transitions(d, shares).groupBy("transition").count().collect()}
    assert got == {None: 1, "whip": 4, "flash": 3, "cut": 5}


def test_a_lead_of_exactly_the_bar_is_no_close_call(spark, tmp_path):
    from shotloom.plans import timeline_queries as Y
    rows = [(711631, 86411, 4043, 7, 4.0, 0.04, 0.04, "1995-07-05"), (711631, 82872, 4578, 6, 41.0, 0.04, 0.01, "2001-03-20"), (711631, 91441, 4336, 3, 20.0, 0.01, 0.02, "1998-09-28")]
    d = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, day string")
    d.withColumn("l_shipdate", F.to_timestamp("day")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.slot: (r.choice, r.close_call) for r in Y.rank_alternatives(spark, str(tmp_path)).collect()}
    assert got[0] == ("711631_3_91441_4336_20", False)


def test_voices_that_begin_alike_keep_their_numbers(spark):
    voices = [(1, 5.0, 2.0, 9.0), (1, 5.0, 2.0, 1.0), (1, 4.0, 2.0, 3.0)]
    t = spark.createDataFrame([(1, 10.0, 1.0, 1.0, 0.0)], "timeline_id long, duration double, continuity_weight double, pacing_multiplier double, music_gain_db double")
    for rows in (voices, voices[::-1]):
        d = spark.createDataFrame(rows, "timeline_id long, tl_start double, source_in double, source_out double").coalesce(1)
        got = {r.track_id: r.source_out for r in M.plan_mix(t, d)[0].filter("role = 'voice'").collect()}
        assert got == {"vox00": 3.0, "vox01": 1.0, "vox02": 9.0}


def test_assignment_ships_what_it_scores_only(spark, small, tmp_path, monkeypatch):
    from shotloom.plans.timeline_queries import KNOBS, candidates
    seen, keep = [], P.stage
    monkeypatch.setattr(P, "stage", lambda d: seen.append(d.columns) or keep(d))
    d = candidates(spark, small).filter("asset_id < 40").withColumns({"plan_id": F.lit(0).cast("long"), "ballast": F.lit("x" * 100)})
    assert P.assign_greedy(d, None, KNOBS).count() == 3
    assert "ballast" not in seen[0] and "prev" not in seen[0] and "score" in seen[1]


def test_assignment_takes_plans_in_slices(spark, small, monkeypatch):
    from shotloom.plans.timeline_queries import KNOBS, candidates
    d = candidates(spark, small).filter("asset_id < 200").withColumn("plan_id", F.floor(F.col("asset_id") / 40).cast("long")).cache()
    pins = d.filter("plan_id = 3 AND slot = 1").groupBy("plan_id", "slot").agg(F.max("shot_id").alias("shot_id"))
    whole = sorted(tuple(r) for r in P.assign_greedy(d, pins, KNOBS).collect())
    seen, every = [], P.contenders
    monkeypatch.setattr(P, "SLICE_ROWS", d.count() // 3)
    monkeypatch.setattr(P, "contenders", lambda c, *args: seen.append({r.plan_id for r in c.select("plan_id").distinct().collect()}) or every(c, *args))
    assert sorted(tuple(r) for r in P.assign_greedy(d, pins, KNOBS).collect()) == whole and any(r[4] for r in whole)
    assert len(seen) >= 3 and sum(map(len, seen)) == len(set().union(*seen)) == 5


def test_coverage_ranks_no_whole_library(spark):
    d = spark.range(500).selectExpr("format_string('s%03d', id) AS shot_id", "'use' AS handling", "0.9D AS brightness", "IF(id < 400, 0.1D, 9.0D) AS duration", "CAST(id % 7 AS DOUBLE) AS technical_quality")
    got = K.coverage(d, [{"number": n, "criteria": (Q.Criterion("brightness", ">", 0.5 * n, "bright"),), "duration": 6.0} for n in (1, 2)])
    assert {r.query_id: (r.status, r.candidates) for r in got.collect()} == {"1": ("likely", ["s405", "s412", "s419"]), "2": ("missing", [])}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "WindowGroupLimit" not in plan


def test_fitting_candidates_do_not_wait_for_their_slot(spark):
    rows = [(1, 0, "a", 0.5, None), (1, 0, "b", 0.5, 0.2), (1, 1, "c", 0.5, 0.2), (None, 0, "d", 0.5, 0.2), (None, 1, "e", 0.5, None), (None, 1, "f", 0.5, 0.2)]
    d = P.eligible(spark.createDataFrame(rows, "plan_id long, slot long, shot_id string, slot_duration double, max_useful_duration double"))
    assert sorted(r.shot_id for r in d.collect()) == ["a", "c", "d", "e"]
    assert "Union" in d._jdf.queryExecution().optimizedPlan().toString()


def test_staged_timelines_hold_what_is_read_only(spark, small, monkeypatch):
    from shotloom.plans import timeline_queries as Y
    seen, keep = [], Y.stage
    monkeypatch.setattr(Y, "stage", lambda d: seen.append(len(d.columns)) or keep(d))
    assert set(Y.revise(spark, small).columns) == {"timeline_id", "idx", "transition", "effects"}
    assert set(Y.changed_segments(spark, small).columns) == {"timeline_id", "idx"}
    assert seen == [6, 10]


def test_streams_read_a_table_that_is_a_folder_or_a_file(spark, small, tmp_path):
    from shotloom.plans import stream_queries as Y
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "doc_id long, text string").repartition(3)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = [r.fingerprint for r in Y.stream_ingest(spark, str(tmp_path)).collect()]
    assert len(got) == 3 and len(set(got)) == 3 and None in got
    assert Y.stream_new_content(spark, str(tmp_path)).first().contents == 2
    assert Y._source(spark, small, "documents").isStreaming and Y.stream_new_content(spark, small).first().contents > 2


def test_a_commit_cut_short_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    t = Snapshots(spark, root, "k", 8)
    assert t.read() is None
    t.overwrite(spark.createDataFrame([(k, f"old{k}") for k in range(20)] + [(None, "none")], "k long, v string"))
    new = spark.createDataFrame([(3, "new"), (3, "new too"), (None, "new none"), (77, "more")], "k long, v string")
    with monkeypatch.context() as m:     # files written, version not published
        m.setattr(Snapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        for act in (t.replace, t.append, t.overwrite):
            try:
                act(new)
            except OSError:
                pass
    (tmp_path / "t" / "versions" / "0000000002.json.part").write_text("{half")
    assert t.read().count() == 21 and t.versions() == [1]
    t.replace(new)
    got = {(r.k, r.v) for r in t.read().collect()}
    assert got == {(k, f"old{k}") for k in range(20) if k != 3} | {(3, "new"), (3, "new too"), (None, "new none"), (77, "more")}
    assert t.read(version=1).count() == 21
    some = t.buckets_of(spark.createDataFrame([(5,)], "k long"))
    assert (5, "old5") in {(r.k, r.v) for r in t.read(some).collect()} and t.read(some).count() < 21
    assert t.vacuum() == 3 and t.read().count() == len(got)


def _row_clips(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "timeline_id long, idx long, tl_start double, dur double, beat_locked boolean, source_in double, source_out double, speed double")


def test_forced_length_moves_only_what_follows(spark):
    d = _row_clips(spark, [(i, t, 1.0, True, 0.0, 1.0, 1.0) for i, t in enumerate((0.0, 2.0, 3.0, 4.0))])
    got = TL.reflow_durations(d, spark.createDataFrame([(1, 2, 2.0)], "timeline_id long, idx long, forced double"), 30.0).orderBy("idx").collect()
    assert [(r.tl_start, r.dur, r.moved, r.beat_locked, r.hold) for r in got] == [(0, 1, False, True, 0), (2, 1, False, True, 0), (3, 2, False, True, 1), (5, 1, True, False, 0)]


def test_resnap_moves_every_clip_and_keeps_locked_lengths(spark):
    d = _row_clips(spark, [(i, i * 0.55, 0.55, True, 0.0, 0.3, 1.0) for i in range(1000)])
    beats = spark.createDataFrame([(1, 3.0 + 0.5 * k) for k in range(1100)], "timeline_id long, beat double")
    got = TL.resnap_to_beats(d, beats, 30.0, d.filter("idx = 1")).orderBy("idx").collect()
    assert len(got) == 1000 and all(abs(r.tl_start - 0.5 * r.idx) < 1e-9 for r in got)
    assert got[1].dur == 0.55 and all(abs(r.dur - 0.5) < 1e-9 for r in got if r.idx != 1)
    assert abs(got[1].hold - 0.25) < 1e-9 and abs(got[2].hold - 0.2) < 1e-9


def test_missing_audio_is_reported(spark):
    clips = spark.createDataFrame([(1, 0, "c0", 0.0, 1.0, 0.0, 1.0, 1.0, "use", [], "cut", 0.0, "a.mp4", False)],
                                  "timeline_id long, idx long, clip_id string, tl_start double, dur double, source_in double, source_out double, speed double, handling string, "
                                  "effects array<struct<type:string,params:map<string,double>>>, transition string, tdur double, source_path string, beat_locked boolean")
    audio = spark.createDataFrame([(1, "t0", 0.0, 1.0, "a.mp4"), (1, "t1", 1.0, 1.0, "gone.wav")], "timeline_id long, track_id string, source_in double, source_out double, source_path string")
    got = {(r.subject, r.code) for r in TL.validate_timeline(clips, sources=spark.createDataFrame([("a.mp4",)], "source_path string"), audio=audio).collect()}
    assert got == {("t1", "missing_audio"), ("t1", "bad_audio_range")}


def test_coverage_finds_a_long_shot_behind_five_short_ones(spark):
    d = spark.createDataFrame([(f"s{k}", 0.9, "use", 1.0 - k / 10, 0.1 if k < 5 else 9.0) for k in range(6)], "shot_id string, brightness double, handling string, technical_quality double, duration double")
    got = K.coverage(d, [{"number": 1, "criteria": (Q.Criterion("brightness", ">", 0.6, "bright"),), "duration": 6.0}]).first()
    assert (got.status, got.candidates) == ("likely", ["s5"])


def test_more_than_62_criteria(spark):
    d = spark.createDataFrame([("s1", 0.9, "use"), ("s2", 0.3, "use")], "shot_id string, brightness double, handling string")
    q = Q.Query("q", tuple(Q.Criterion("brightness", ">", k / 100, f"over {k}") for k in range(70)))
    got = {r.shot_id: (r.score, len(r.matched), len(r.unmet)) for r in Q.search(d, [q]).collect()}
    assert got["s1"] == (1.0, 70, 0) and got["s2"][1:] == (30, 40)


def test_assignment_equals_the_full_walk(spark, small, monkeypatch):
    """Leaving out candidates that cannot win must not change a single choice."""
    from shotloom.plans.timeline_queries import KNOBS, candidates
    d = candidates(spark, small).withColumn("plan_id", F.floor(F.col("asset_id") / 300).cast("long")).cache()
    got = {(r.plan_id, r.slot): r.shot_id for r in P.assign_greedy(d, None, KNOBS).collect()}
    assert P.contenders(d, KNOBS).count() < d.count()
    prune = P.contenders

    def keep_all(c, *args):
        return prune(c.withColumn("_pin", F.lit(True)), *args).withColumn("_pin", F.lit(False))

    monkeypatch.setattr(P, "contenders", keep_all)
    assert got == {(r.plan_id, r.slot): r.shot_id for r in P.assign_greedy(d, None, KNOBS).collect()}
    for p in {k[0] for k in got}:
        assert got[(p, 0)] != got[(p, 1)] and got[(p, 1)] != got[(p, 2)]


def walked(rows, pins, knobs, diversity):
    """The rule itself, slot after slot: rows of (slot, {shot fields}) of one plan, with the operator's own part scores."""
    from shotloom.rules import planning as R
    kw, qw = (knobs or {}).get("continuity_weight", 1.0), (knobs or {}).get("quality_weight", 1.0)
    total = sum(v * {"continuity": kw, "quality": qw}.get(k, 1.0) for k, v in R.WEIGHTS.items())
    wc = R.WEIGHTS["continuity"] * kw / total
    again, same = 1 - min(0.85, R.REUSE_PENALTY * (1 + diversity)), 1 - min(0.5, R.SAME_ASSET_PENALTY * (1 + diversity))
    prev, shots, assets, out = None, set(), set(), []
    for s in sorted({r["slot"] for r in rows}):
        g = [r for r in rows if r["slot"] == s]
        held = [r for r in g if (s, r["shot_id"]) in pins]
        if not held and prev is not None and len(g) > 1:
            g = [r for r in g if r["shot_id"] != prev["shot_id"]]
        best = None
        for r in held or g:
            if prev is None:
                cont = 0.6
            else:
                tone = min(max(1 - (abs(prev["brightness"] - r["brightness"]) + abs(prev["warmth"] - r["warmth"]) * 0.5) / 0.9, 0), 1)
                gap = abs((prev["flow_direction_deg"] - r["flow_direction_deg"] + 180) % 360 - 180)
                a, b = prev["camera_movement"], r["camera_movement"]
                move = ((0.45 if a == "static" else 1.0 if gap < 45 else 0.72 if gap > 135 else 0.4) if a == b else 0.85 if a == "static" else 0.7 if b == "static" else 0.6)
                near = abs(prev["subject_x"] - r["subject_x"]) + abs(prev["subject_y"] - r["subject_y"]) < 0.08
                frame = 1.0 if prev["shot_size"] != r["shot_size"] else 0.18 if near else 0.45
                cont = min(max(0.34 * tone + 0.42 * move + 0.24 * frame, 0), 1)
            score = r["_base"] + wc * cont + (wc * (1 - 2 * cont) * 0.8 if knobs and kw < 0.7 else 0)
            score *= r["_f"] * (again if r["shot_id"] in shots else 1) * (same if r["asset_id"] in assets else 1)
            if diversity > 0 and prev is not None:
                x, y = np.array(r["embedding"]), np.array(prev["embedding"])
                sim = float(x @ y) / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12)
                score *= max(0.15, 1 - diversity * (sim - 0.9) * 8) if sim > 0.9 else 1
            key = (-round(score, 9), r["shot_id"])
            best = min(best, (key, score, r), key=lambda x: x[0]) if best else (key, score, r)
        prev = best[2]
        shots.add(prev["shot_id"])
        assets.add(prev["asset_id"])
        out.append((s, prev["shot_id"], round(best[1], 8), bool(held)))
    return out


def test_assignment_in_waves_equals_the_walk(spark, small):
    from shotloom.plans.measure_queries import vectors
    from shotloom.plans.timeline_queries import KNOBS, candidates
    d = vectors(candidates(spark, small).withColumn("plan_id", F.floor(F.col("asset_id") / 300).cast("long"))).cache()
    # a longer plan: twelve slots over one small library, so that reuse, repeats and continuity reach far
    long = d.filter("slot = 0 AND asset_id < 12").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("slot", F.col("slot").cast("long"))
    long = long.withColumns({"plan_id": F.lit(-1).cast("long"), "intensity": (F.col("slot") * 7 % 10) / 10.0,
                             "role": F.get(F.array(*[F.lit(x) for x in ("hook", "setup", "escalation", "climax", "release")]), (F.col("slot") % 5).cast("int"))})
    d = d.filter("asset_id < 600").unionByName(long).cache()
    pins = d.groupBy("plan_id").agg(F.min("shot_id").alias("shot_id")).filter("plan_id % 2 = 0 OR plan_id = -1").withColumn("slot", F.lit(1).cast("long"))
    held = {(r.plan_id, r.slot, r.shot_id) for r in pins.collect()}
    for knobs, diversity in ((KNOBS, 0.0), (KNOBS | {"continuity_weight": 0.5}, 1.0)):
        got = {(r.plan_id, r.slot): (r.shot_id, round(r.score, 8), r.pinned) for r in P.assign_greedy(d, pins, knobs, diversity).collect()}
        scored = P.contenders(d.withColumn("_pin", F.lit(True)), knobs, diversity).collect()
        for plan in {r.plan_id for r in scored}:
            rows = [r.asDict() for r in scored if r.plan_id == plan]
            for s, shot, score, pinned in walked(rows, {(s, i) for p, s, i in held if p == plan}, knobs, diversity):
                assert got.pop((plan, s)) == (shot, score, pinned), (plan, s)
        assert not got


def test_eligible_falls_back(spark):
    d = spark.createDataFrame([(1, 0, 1.0, "a", 0.5), (1, 0, 1.0, "b", None), (1, 1, 2.0, "a", 0.5)], "plan_id long, slot long, slot_duration double, shot_id string, max_useful_duration double")
    assert sorted((r.slot, r.shot_id) for r in P.eligible(d).collect()) == [(0, "b"), (1, "a")]


def test_validator_finds_broken_timelines(spark):
    fx = [("push_zoom", {"from": 1.0, "to": 9.0}), ("sparkle", {})]
    rows = [(1, 0, "c0", 0.0, 1.0, 0.0, 1.0, 1.0, "use", True, "cut", 0.0, fx, "a.mp4"), (1, 1, "c1", 1.5, 1.0, 0.0, 1.0, 9.0, "reject", True, "bogus", -1.0, [], "gone.mp4"),
            (1, 2, "c1", 2.0, 0.05, 2.0, 1.0, 1.0, "use_briefly", False, "flash", 0.07, [], "a.mp4")]
    t = spark.createDataFrame(rows, "timeline_id long, idx long, clip_id string, tl_start double, dur double, source_in double, source_out double, speed double, handling string, "
                              "beat_locked boolean, transition string, tdur double, effects array<struct<type:string,params:map<string,double>>>, source_path string")
    prj = spark.createDataFrame([(1, "2.0", 1081, 1920, 30), (2, "1.0", 1080, 1920, 30)], "timeline_id long, schema_version string, width long, height long, fps long")
    beats = spark.createDataFrame([(1, 0.0), (1, 1.0)], "timeline_id long, beat double")
    src = spark.createDataFrame([("a.mp4",)], "source_path string")
    txt = spark.createDataFrame([(1, "t0", 5.0, 4.0)], "timeline_id long, text_id string, start double, end double")
    aud = spark.createDataFrame([(1, "m", 2.0, 2.0)], "timeline_id long, track_id string, source_in double, source_out double")
    codes = sorted((r.timeline_id, r.code) for r in TL.validate_timeline(t, prj, beats, src, aud, txt, time_width=10.0).collect())
    want = ["param_range", "unknown_effect", "gap", "bad_speed", "rejected_clip", "unknown_transition", "bad_transition", "missing_source", "bad_range", "too_short", "transition_too_long",
            "overlap", "dup_id", "schema", "project", "beat_drift", "beat_drift_total", "bad_audio_range", "bad_text_range", "text_overrun"]
    assert codes == sorted([(1, x) for x in want] + [(2, "empty")])


def test_reflow_and_resnap(spark):
    t = spark.createDataFrame([(1, i, float(i), 1.0, True) for i in range(4)], "timeline_id long, idx long, tl_start double, dur double, beat_locked boolean")
    forced = spark.createDataFrame([(1, 1, 2.5)], "timeline_id long, idx long, forced double")
    got = [(r.tl_start, r.dur, r.beat_locked) for r in TL.reflow_durations(t, forced, 30.0).orderBy("idx").collect()]
    assert got == [(0.0, 1.0, True), (1.0, 2.5, True), (3.5, 1.0, False), (4.5, 1.0, False)]
    beats = spark.createDataFrame([(1, 5.0 + x) for x in (0.0, 1.1, 2.1, 3.5, 4.0)], "timeline_id long, beat double")
    edges = [round(r.tl_start * 30) for r in TL.resnap_to_beats(t, beats, 30.0).orderBy("idx").collect()]
    assert edges == [0, 33, 63, 93]


def test_blend_is_a_distribution_and_single_is_unchanged(spark):
    rows = [(1, 1.6, 0.5, 0.1, 0.2, 0.1, "fast", [0.0, 1.0], "1.0.0"), (2, 0.4, 0.9, 0.3, 0.0, 0.1, "slow", [0.0, 0.5, 1.0], "1.0.0")]
    st = spark.createDataFrame(rows, "style_id long, cuts_per_second double, hard_cut_share double, flash_share double, whip_share double, dissolve_share double, rhythm string, intensity_curve array<double>, version string")
    w = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0), (2, 1, 5.0), (2, 2, 0.0)], "blend_id long, style_id long, weight double")
    b = {r.blend_id: r for r in G.blend_styles(st, w, ("cuts_per_second", *G.SHARES), labels=("rhythm",)).collect()}
    assert abs(b[1].cuts_per_second - 1.3) < 1e-9 and b[1].rhythm == "fast" and b[1].rhythm_disagreed
    assert abs(sum(b[1][s] for s in G.SHARES) - 1) < 1e-9 and np.allclose(b[1].intensity_curve, [0.0, 0.5, 1.0])
    assert b[2].hard_cut_share == 0.5 and b[2].intensity_curve == [0.0, 1.0] and b[2].sources == 1


def test_directives_follow_their_shot(spark):
    clips = spark.createDataFrame([(1, 0, "a", 0.0), (1, 1, "b", 1.0), (1, 5, "c", 5.0), (1, 9, "c", 9.0)], "timeline_id long, slot_index long, shot_id string, tl_start double")
    d = spark.createDataFrame([(1, 1, 1, "pin_shot", 0, "a", None, "a", 0.0), (1, 2, 2, "set_duration", 3, None, "2.0", "c", 8.0), (1, 3, 3, "lock_clip", 4, None, None, "zz", 4.0),
                               (1, 4, 4, "ban_effect", None, None, "flash", None, None)],
                              "timeline_id long, seq long, directive_id long, kind string, slot_index long, shot_id string, value string, anchor_shot_id string, anchor_t double")
    b = {r.seq: (r.anchor_status, r.slot_index) for r in L.bind_directives(d, clips, width=3.0).collect()}
    assert b == {1: ("exact", 0), 2: ("moved", 9), 3: ("lost", 4), 4: ("unanchored", None)}
    state = L.directive_state(L.bind_directives(d, clips, width=3.0)).collect()
    assert sorted((r.kind, r.slot_index) for r in state if r.slot_index is not None) == [("pin_shot", 0), ("set_duration", 9)]


def test_terminal_state_is_final(spark):
    e = spark.createDataFrame([(1, 1, 0.0, "pending", 0.0), (1, 2, 1.0, "cancelled", 0.3), (1, 3, 2.0, "running", 0.5), (2, 1, 0.0, "running", 1.7)], "job_id long, seq long, t double, state string, progress double")
    j = {r.job_id: r for r in L.job_state(e, 10.0).collect()}
    assert j[1].state == "cancelled" and j[1].ended_at == 1.0 and j[2].progress == 1.0 and j[2].elapsed == 10.0
    o = {r.job_id: r for r in L.recover_orphans(L.job_state(e, 10.0), spark.createDataFrame([(9,)], "job_id long"), 10.0).collect()}
    assert o[2].state == "failed" and o[1].error is None


def test_margin_not_spread_decides(spark):
    d = spark.createDataFrame([(1, "a", 7.4, None), (1, "b", 7.4, None), (1, "c", 4.8, None), (1, "d", 9.9, "boom")], "run_id long, name string, score double, error string")
    r = K.choose_candidate(d).first()
    assert (r.winner, round(r.spread, 2), r.margin, r.decisive) == ("a", 2.6, 0.0, False)


def test_duck_threshold_points(spark):
    d = spark.createDataFrame([(2.6,), (6.5,), (18.0,), (0.1,)], "x double").select(M.duck_threshold(F.col("x")).alias("t"))
    assert [round(r.t, 5) for r in d.collect()] == [0.045, 0.01, 0.003, 0.2]


def test_scaling_never_claims_a_false_upscale(spark):
    d = M.plan_scaling(spark.createDataFrame([(1, 1080, 1920), (2, 640, 360)], "file_id long, width long, height long"))
    got = {(r.file_id, r.profile): r.provenance for r in d.collect()}
    assert got[(1, "youtube_1080p")] == "native" and got[(2, "youtube_1080p")] == "upscaled"


def test_probe_refuses_streamless_files(spark):
    d = spark.createDataFrame([(1, '{"format":{"duration":"2.5"},"streams":[{"codec_type":"video","width":1080,"height":1920,"avg_frame_rate":"0/0","r_frame_rate":"25/1","side_data_list":[{"rotation":-90}]}]}'),
                               (2, '{"format":{},"streams":[{"codec_type":"data"}]}')], "id long, probe string")
    ok, bad = A.normalize_probe(d)
    r = ok.first()
    assert (r.width, r.height, r.fps, r.aspect_label, r.has_audio) == (1920, 1080, 25.0, "16:9", False)
    assert [x.id for x in bad.collect()] == [2]


def test_shot_keys_are_unique(spark, small):
    d = V.shots(spark, small)
    assert d.select("shot_id").distinct().count() == d.count()


def test_effect_tables_agree():
    assert set(k.split(".")[0] for k in RP.PARAM_RANGES) <= set(RP.EFFECT_TYPES) and set(RP.STAGE_ORDER) <= set(RP.EFFECT_TYPES)


def test_resnap_in_blocks_equals_one_walk(spark):
    rng = random.Random(5)
    rows = [(k, i, f"c{i}", 0.0, rng.choice([0.001, 0.3, 0.5, 0.77, 1.3])) for k, n in (("a", 400), ("b", 33), ("none", 20)) for i in range(n)]
    clips = spark.createDataFrame(rows, "timeline_id string, idx long, clip_id string, tl_start double, dur double")
    at = {"a": [3.0 + 0.45 * i for i in range(300)], "b": [9.0, 9.5]}      # the beats of both end before their clips do
    beats = spark.createDataFrame([(k, b) for k, bs in at.items() for b in bs], "timeline_id string, beat double")
    want = {}
    for k, i, _, start, dur in rows:
        if k not in at:
            want[k, i] = (start, dur)
            continue
        frame = want[k, i - 1][2] if i else 0
        goal = frame / 30.0 + dur
        best = min((b - at[k][0] for b in at[k]), key=lambda b: (abs(b - goal), b))
        end = max(frame + 1, round((best if abs(best - goal) < 0.2 else goal) * 30.0))
        want[k, i] = (frame / 30.0, (end - frame) / 30.0, end)
    for width in (7, 65536):
        got = {(r.timeline_id, r.idx): (r.tl_start, r.dur) for r in TL.resnap_to_beats(clips, beats, 30.0, width=width).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k][:2], abs=1e-9) for k in want)

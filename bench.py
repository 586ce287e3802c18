"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "find_attributes", "eval_criteria", "vector_topk", "find_similar", "handling", "feature_vector", "library_stats", "motion_summary", "frame_quality",
    "change_score", "detect_shots", "smooth", "energy_curve", "low_runs", "merge_windows", "energy_at", "nearest_beat", "speech_overlap", "beat_counts",
    "onset_envelope", "tempo_autocorr", "pacing_profile", "intensity_curve", "score_candidates", "rank_alternatives", "allocate_transitions", "choose_effects",
    "validate_timeline", "conformance", "coverage", "job_state", "bind_directives", "interpret_brief", "parse_query", "fingerprint", "dedupe", "stream_windows")


def main() -> None:
    from shotloom.plans import catalog
    from shotloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                              "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    catalog.QUERIES["library_stats"](spark, sf_dir).count()      # starts the engine, not measured
    times, failed = {}, {}
    for name in names:
        start = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        except Exception as e:  # one broken query must not hide the others
            failed[name] = str(e).splitlines()[0][:200]
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()

"""Bench: run the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``
and print one JSON line with seconds per query.  Each query's time also goes to
stderr as it ends, and no query starts after ``$BENCH_LIMIT`` seconds (default
1,500): what was measured is printed, the rest is named in ``skipped``.  The
model fits come last.

Each query runs to completion through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Before the clock starts, every
input table is scanned once (not timed), so the first query does not carry the
JVM's start-up and code-generation warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "counter_rollup", "events_quality", "feature_table", "daily_series", "oil_filled",
    "join_transactions", "label_encode", "initial_load", "daily_load", "buffer_trim",
    "topk_batch", "prompt_table", "cosine_scores", "vector_upsert", "scenario_grid",
    "period_delta", "stream_counters", "trend_forecast", "gbt_fit_score", "score_requests",
    "scenario_run",
]


def one_question(spark, tables) -> tuple[float, float]:
    """Seconds to answer one question from a stored index: the first (with code
    generation), and the median of five more.  The index is written before the
    clock starts; every answer searches the whole index and writes the prompt."""
    from storecast.plans import search as se
    from storecast.session import work_path
    from storecast.sources import fixtures as fx
    path = work_path(spark, "bench-index", uuid.uuid4().hex)
    fx.r_vectors(tables).write.parquet(path)
    asked = fx.r_question_vectors(tables).where("qvec IS NOT NULL").orderBy("qid").limit(6).collect()
    seconds = []
    for q in asked:
        t0 = time.time()
        se.answer_one(spark.read.parquet(path), q.qid, q.text, q.qvec).collect()
        seconds.append(time.time() - t0)
    return round(seconds[0], 3), round(statistics.median(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    from storecast.plans.catalog import QUERIES, load_all
    from storecast.session import local_session
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), memory="6g",
                          app="storecast-bench")
    from storecast.sources.tables import TABLE_NAMES, Tables
    tables = Tables(spark, sf_dir)
    for name in TABLE_NAMES:
        getattr(tables, name).write.format("noop").mode("overwrite").save()
    first, one = one_question(spark, tables)
    print(f"one question: first {first} s, then {one} s", file=sys.stderr, flush=True)
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    limit, began, skipped = float(os.environ.get("BENCH_LIMIT", "1500")), time.time(), []
    for k in keys:
        t0 = time.time()
        if t0 - began > limit:
            skipped.append(k)
            continue
        try:
            QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[k] = round(time.time() - t0, 3)
        except Exception as e:  # record and go on
            errors[k] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{k} {time.time() - t0:.1f} s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus),
           "one_question": {"first": first, "median": one}}
    if errors:
        out["errors"] = errors
    if skipped:
        out["skipped"] = skipped
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

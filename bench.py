"""Time the named queries: python bench.py [name ...] prints one JSON line.

Each query runs once to warm up and BENCH_REPEAT times (default 3) for the
median; its whole result goes to a sink that discards it. The keyword model is
fitted inside the timing of ``tfidf_fit`` only, as a service would do once per collection.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talkmill.operators import tfidf  # noqa: E402
from talkmill.plans.catalog import QUERIES, keyword_model  # noqa: E402
from talkmill.session import local_session  # noqa: E402
from talkmill.sources import views  # noqa: E402

# One or more of every family; name others on the command line.
HEADLINE = """
    tfidf_topk tfidf_topk_filled vector_topk vector_topk_filtered hybrid_rrf context_text prompt_table
    active_user_stats user_stats overall_stats messages_per_period latency_stats top_questions active_sliding
    history_all last_message recent_conversations users_from_log sessions_gap latest_state constraint_audit
    detect_language detect_language_simple parse_transcript tokens parse_logs kb_dedup kb_snapshot_diff
    vector_ivf similar_messages translate_lookup users_after_language stream_activity stream_sessions stream_latest_state
    hybrid_rerank active_sliding_all sql_recent_of_all
""".split()


def _discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    chosen = sys.argv[1:] or HEADLINE

    seconds: dict[str, float] = {}
    if not sys.argv[1:]:
        tfidf.fit(views.kb(spark, folder))
        started = time.perf_counter()
        tfidf.fit(views.kb(spark, folder))
        seconds["tfidf_fit"] = round(time.perf_counter() - started, 3)
    keyword_model(spark, folder)

    for name in chosen:
        runs = []
        for _ in range(repeat + 1):
            started = time.perf_counter()
            _discard(QUERIES[name](spark, folder))
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()

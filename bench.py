"""Headline queries at one scale; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import CATALOG  # noqa: E402
from checks.compare import local_session  # noqa: E402

HEADLINE = [
    "normalize_full",
    "split_words",
    "exact_split",
    "alphabet_all_rows",
    "ctc_vocab",
    "encode_chars",
    "pad_batch",
    "ctc_greedy_decode",
    "join_segments",
    "with_existing_audio",
    "assemble_hypotheses",
    "preference_triples",
    "word_edits",
    "align_words",
    "wer_by_system",
    "rover_word_over_null",
    "score_batches",
    "dataset_fingerprint",
    "prepare_corpus",
    "prepare_flagged_corpus",
    "build_preference_set",
    "evaluate_systems",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # start-up of the session is not a query
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in HEADLINE:
        make, _ = CATALOG[name]
        start = time.perf_counter()
        make(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

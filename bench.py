"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from newsflow.plans.catalog import QUERIES  # noqa: E402
from newsflow.session import local_session  # noqa: E402

HEADLINE = (
    "label_distribution",
    "clean_for_domain",
    "assign_ordinal",
    "split_80_10_10",
    "split_stratified",
    "extract_maintext",
    "link_page_join",
    "tokenize_pattern",
    "merge_negation",
    "ngrams",
    "build_vocab",
    "encode_tokens",
    "tfidf_fit",
    "tfidf_transform",
    "domain_classifier_predict",
    "classifier_evaluate",
    "classification_report",
    "extractive_summary",
    "block_repeat_ngrams",
    "rouge_n",
    "rouge_l",
    "compare_runs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session(cores, shuffle_partitions=cores, app="newsflow-bench", checkpoint_dir=tempfile.mkdtemp(prefix="newsflow-bench-"))
    names = sys.argv[1:] or HEADLINE
    # One small run so that JVM start and class loading are not charged to a query.
    QUERIES["tfidf_transform"].build(spark, sf_dir.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()

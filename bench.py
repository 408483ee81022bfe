"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quarry.session import build_session
from quarry.suite import all_queries

HEADLINE = [
    "docstring_tokens", "code_lex", "dedupe_docs", "row_index", "split_sets", "token_counts",
    "ngram_counts", "bpe_vocab", "encode_pad", "encode_embeddings", "knn_exact", "similar_docs",
    "knn_index", "search_text", "mrr", "ndcg", "margin_loss", "repo_languages", "query_log_per_day",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One small query first, so that no query pays for the session's start.
    queries["row_index"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()

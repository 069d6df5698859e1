"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line.

Index building and retrieval are timed apart: the index is built once per corpus, each
retrieval answers all questions of its table. Results go to a sink that keeps every
column, so no work is optimized away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from rankwell.plans.catalog import QUERIES, Inputs  # noqa: E402

TEXT, VECTORS, PAIRS, TEST = "text questions", "vector questions", "pairs", "test pairs"
RETRIEVAL = {
    # query: the questions it answers
    "bm25_topk_padded": TEXT,
    "eval_bm25": TEXT,
    "cosine_topk_batch": VECTORS,
    "routed_centroid_topk": VECTORS,
    "rrf_weighted": VECTORS,
    "eval_grid": VECTORS,
    "eval_bm25_pairs": PAIRS,
    "eval_hashed_pairs": PAIRS,
    "eval_routed_classifier": TEST,
}
OTHERS = [
    "tokenize",
    "term_counts",
    "prune_rare_terms",
    "dedup_first",
    "dense_id",
    "assign_nearest",
    "lloyd_step",
    "silhouette_exact",
    "kmeans_assign",
    "classification_report",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    inputs = Inputs.of(spark, folder)
    run(inputs.documents)  # starts the session; not counted
    timed("build_lexical_index", lambda: inputs.index)
    timed("build_bm25_questions", lambda: (inputs.weighted, inputs.bm25_truth))
    timed("build_cluster_index", lambda: inputs.cluster_index)
    timed("build_pairs", lambda: inputs.built)
    timed("build_pairs_lexical_index", lambda: inputs.built.index)
    timed("train_classifier", lambda: inputs.trained)
    counts = {
        TEXT: inputs.questions.count(),
        VECTORS: inputs.vector_questions.count(),
        PAIRS: inputs.built.rows.count(),
        TEST: inputs.built.rows.where("split = 'test'").count(),
    }
    per_question = {}
    for name, questions in RETRIEVAL.items():
        timed(name, lambda: run(QUERIES[name](spark, folder)))
        per_question[name] = round(times[name] / counts[questions], 6)
    for name in OTHERS:
        timed(name, lambda: run(QUERIES[name](spark, folder)))
    print(
        json.dumps(
            {
                "metric": "retrieval_and_build_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "seconds_per_question": per_question,
                "questions": counts,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

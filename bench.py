"""Benchmark the headline operators on $BENCH_SF_DIR (default sf0.1) with
first (timed apart), then per query one warm-up and the median of up to three
runs into the ``noop`` sink (a run of 20 s is not repeated).  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

LONG_S = 20          # seconds after which a query is not run again

HEADLINE = [
    "f07_clean_funnel",        # F07 ordered cleaning funnel (normalise + dedup aggregate)
    "f07_clean_pairs",         # F07 kept rows
    "w02_split",               # W02 per-direction split, exact sizes
    "l01_sample_k",            # L01 seeded sample
    "w04_batches",             # W04 batch assignment (global rank)
    "a01_corpus_bleu",         # A01 corpus BLEU
    "a02_corpus_chrf",         # A02 corpus chrF++
    "a03_corpus_meteor",       # A03 corpus METEOR
    "a06_evaluate_by_direction",
    "a16_randomization_test",  # A16, 10,000 trials
    "w06_running_best",
    "a13_dpo_loss",
]


def _replicate_parallel(fx, r: int):
    """
    pair_id"); replicas get unique ids and a replica token so dedup does not
    fold them back together.  Everything derived (pairs, hyps, scores) grows."""
    from pyspark.sql import functions as F
    orig = fx.parallel

    def replicated(spark, sf_dir):
        df = orig(spark, sf_dir).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
        tag = F.when(F.col("_k") > 0, F.concat(F.lit(" "), F.col("_k").cast("string"))).otherwise("")
        return df.select((F.col("pair_id") + F.col("_k") * F.lit(10_000_000_000)).alias("pair_id"),
                         F.concat(F.col("src"), tag).alias("src"),
                         F.concat(F.col("tgt"), tag).alias("tgt"))
    replicated.__name__ = f"parallel_x{r}"
    fx.parallel = fx.memo(replicated)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from bitextkit.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    from bitextkit.plans import fixtures as fx
    from bitextkit.plans.queries import QUERIES

    replicate = int(os.environ.get("BENCH_REPLICATE", "1"))
    if replicate > 1:
        _replicate_parallel(fx, replicate)
    queries = dict(QUERIES)

    t0 = time.time()
    for f in (fx.parallel, fx.pairs, fx.hyps, fx.system_scores, fx.vec_pairs, fx.token_lp, fx.pref_lp):
        f(spark, sf_dir)
    fixture_sec = time.time() - t0

    results, runs = {}, {}
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times = [time.time() - t]
        if times[0] < LONG_S:            # a long run needs no warm-up
            times = []
        while len(times) < 3 and sum(times) < LONG_S:
            t = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        results[name] = round(statistics.median(times), 3)
        runs[name] = len(times)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_median_query_sec",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(m.group(1)) if m else None,
        "replicate": replicate,
        "runs": runs,
        "input_rows": {"parallel": fx.parallel(spark, sf_dir).count(),
                       "pairs": fx.pairs(spark, sf_dir).count()},
        "fixture_materialize_sec": round(fixture_sec, 3),
        "spark_version": spark.version,
        "cores": cpus,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()

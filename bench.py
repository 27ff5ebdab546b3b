"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import towline  # noqa: E402, F401
from towline.plans.queries import QUERIES  # noqa: E402
from towline.session import local_session  # noqa: E402

HEADLINES = [
    "slides_to_cpue", "percent_composition", "mean_of_totals", "community_matrix", "community_long_zero_filled",
    "balanced_strata", "biomass", "describe_table", "bray_curtis_pairs", "permanova_oneway", "permanova_permutations",
    "simper", "linear_model", "poisson_model", "taxa_regression", "cross_prediction", "scale_reduction",
    "effective_sample_size", "negative_binomial_model", "random_intercept_model", "taxon_association", "long_term_permanova",
    "nmds", "nmds_by_region",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="towline-bench")
    names = sys.argv[1:] or HEADLINES
    # One small query first, so that start-up is not charged to the first headline.
    QUERIES["percent_composition"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

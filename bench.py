"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from plexmat.plans import catalog
from plexmat.session import local_session

HEADLINE = ["net_hubs", "profile_variance", "profile_correlation", "impute_knn", "normalize_standard", "pearson_matrix", "spearman_matrix", "similarity_network", "correlation_network", "gaussian_knn_network", "select_laplacian", "select_correlation", "anova_f", "net_basic", "net_clustering", "net_components", "net_edge_weights", "pagerank", "modularity", "louvain", "abar"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        if name in catalog.QUERIES:
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

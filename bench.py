"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from tessella.plans import catalog, relations
from tessella.session import local_session

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = ["stats_counts", "stats_entropy", "stats_numeric", "stats_quantiles", "pk_score", "quality_flags", "containment_full", "orphans", "histogram", "column_catalog", "fk_confidence"]
QUERIES = catalog.QUERIES | relations.QUERIES


def main() -> None:
    spark = local_session("bench", cores=CPUS, shuffle_partitions=CPUS)
    catalog.QUERIES["stats_counts"](spark, SF_DIR).collect()
    took = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, SF_DIR).collect()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR), "cores": CPUS}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries: wall time each, nothing reused between queries. Prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowlens.plans import registry
from flowlens.session import clear_cuts, local_session

HEADLINES = [
    "table_lineage_edges", "sql_table_refs", "resolved_table_refs", "table_flow_links", "downstream_closure", "variable_resolution",
    "variable_summary", "linear_chains", "script_refs", "rule_classification", "promotion_cascade", "group_profiles", "feature_matrix",
    "legacy_classification", "document_languages", "redact_secrets", "url_hosts", "batch_packing_corpus", "keyed_upsert",
    "dataset_diff", "ddl_columns", "template_shred",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry.QUERIES["critical_tables"](spark, sf_dir).count()  # start the JVM's compilers
    seconds = {}
    for name in HEADLINES:
        registry.forget_silver()
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    clear_cuts(spark)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()

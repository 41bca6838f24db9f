"""Run the headline queries once each and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS
(default 8) the local cores. Queries run to completion without collecting.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kmer_histogram", "kmer_occurrence_table", "kmer_incremental_count", "read_matched_region", "contig_coverage",
    "map_by_votes", "pair_links", "containment_dedup", "overlap_exact", "link_aggregate_having", "tag_common_count",
    "nodes_sharing_tags", "tag_sessions", "physical_coverage", "window_breaks", "n_statistics", "composition_spectrum",
    "unambiguous_paths", "crosses_resolved", "unitigs",
]


def main() -> None:
    from helixframe.plans import catalog
    from helixframe.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=max(int(cores), 1) * 2, name="bench")
    registry = catalog.load()
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.time()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()

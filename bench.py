"""Times the headline queries once warm; one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "vector_topk", "bm25_topk", "hybrid_rrf", "rrf_merge_lists", "hyde_fusion", "route_queries", "ppr_mass", "subgraph_2hop", "synonymy_edges", "specificity", "edge_accumulate", "utility_ema",
    "utility_boost", "parent_pack", "chunk_documents", "count_tokens", "clean_text", "chunk_hash_ids", "doc_dedup_hash", "context_precision", "corrective_supplement", "collection_stats",
]


def duckdb_seconds(sf_dir: str, cpus: int) -> dict[str, float | None]:
    """The same queries as SQL in DuckDB on the same files; the second run, null where there is no SQL or it takes over a minute."""
    import threading

    import duckdb

    from tessera.plans.catalogue import SQL

    took: dict[str, float | None] = {}
    for name in HEADLINE:
        con = duckdb.connect(config={"threads": cpus})
        for f in sorted(Path(sf_dir).glob("*.parquet")):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
        took[name] = None
        if name in SQL:
            try:
                for _ in range(2):
                    stop = threading.Timer(60, con.interrupt)
                    stop.start()
                    began = time.time()
                    con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {SQL[name]}")
                    stop.cancel()
                took[name] = round(time.time() - began, 3)
            except duckdb.Error as e:
                print(f"{name}: {str(e)[:100]}", file=sys.stderr)
            finally:
                stop.cancel()
    return took


def main() -> None:
    from tessera import get_session
    from tessera.plans.catalogue import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    runs, took = int(os.environ.get("BENCH_RUNS", "2")), {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):  # the first one compiles and warms up
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:]), 3)
    other = {"duckdb": duckdb_seconds(sf_dir, int(cpus))} if os.environ.get("BENCH_DUCKDB") else {}
    print(json.dumps(other | {"metric": "headline queries, median warm run, sum", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()

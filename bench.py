"""Times the headline queries and prints one JSON line.

Graph queries run over a synthetic graph of BENCH_ENTITIES entities (25 quads each), written once as Parquet partitioned
by predicate; table queries run over the tables in BENCH_SF_DIR. Each is run once to warm up, then the median of three
runs into a sink that reads every row counts.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from quadrille import queries
from quadrille.functions import terms as t
from quadrille.plans.engine import run
from quadrille.sources import synthetic
from quadrille.sources.dataset import Dataset

TABLE_QUERIES = ["group_count_by_nation", "bgp_join2", "bgp_chain3", "bgp_two_hop", "bgp_wedge", "optional_plain", "minus_shared", "path_seq", "count_distinct", "min_max", "graph_var", "date_parts"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    entities = int(os.environ.get("BENCH_ENTITIES", "50000"))
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    synthetic.quads(spark, entities).repartition("p").write.partitionBy("p").parquet(f"{work}/graph")
    graph = Dataset(spark.read.schema(t.QUAD).parquet(f"{work}/graph").select("g", "s", "p", "o").cache())
    graph.quads.count()
    todo = {f"graph_{k}": (lambda q=q: run(graph, q, prefixes=synthetic.PREFIXES).df) for k, q in synthetic.QUERIES.items()}
    todo |= {k: (lambda k=k: queries.QUERIES[k](spark, sf)) for k in TABLE_QUERIES}
    took = {}
    for name, make in todo.items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

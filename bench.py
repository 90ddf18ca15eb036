"""Headline queries on local cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from meshspark.plans import registry

NAMES = ("mesh_summary", "edge_table", "halfedge_nav_next_prev", "face_area_normal_centroid", "vertex_normals", "dihedral_angles", "nonmanifold_vertices", "weld_exact", "flip_ok", "loop_subdivide", "midpoint_subdivide", "laplacian_1", "cotan_1", "collapse_costs")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries["mesh_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in NAMES:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "mesh queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

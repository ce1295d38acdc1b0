"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from clumpwise.plans import registry

HEADLINE = (
    "d1_mass",
    "d3_dispersion",
    "d4_angular_momentum",
    "d9_inertia_tensor",
    "d11_pair_potential",
    "d12_shell_table",
    "d13_shell_potential",
    "d18_half_mass_radius",
    "d20_sfr",
    "d21_stellar_kinematics",
    "d22_photometry",
    "d23_vmax",
    "d25_inner_slope",
    "d30_component_moments",
    "d35_component_mass",
    "d36_so_gas",
    "g5_overlap_fixed_depth",
    "g9_hierarchy_threading",
    "j3_saddle_symmetry",
    "p14_cells_in_sphere",
    "w3_so_radius",
    "w5_prefix_moments",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    found["d1_mass"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

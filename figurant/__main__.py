"""``python -m figurant --panels PATH --output-dir PATH``: graphs of typed panels as JSON.

PATH holds Parquet rows fig_id, panel_id, t, l, b, r, role, dir_x, dir_y, long_side; models
that make them from images plug in through ``figurant.plans.models``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from figurant.operators import spatial
from figurant.plans import extraction
from figurant.sources import writers


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="figurant")
    p.add_argument("--panels", required=True)
    p.add_argument("--output-dir", required=True)
    p.add_argument("--width", type=int, default=1400)
    p.add_argument("--height", type=int, default=1000)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("figurant").getOrCreate()
    rows = spark.read.parquet(a.panels)
    of = lambda role: rows.where(F.col("role") == role)
    near = spatial.nearest(of("conditions"), of("arrow")).select("fig_id", "panel_id", F.col("parent_id").alias("arrow_id"))
    conditions = of("conditions").join(near, ["fig_id", "panel_id"])
    steps = extraction.reaction_steps(of("arrow"), of("diagram"), conditions, a.width, a.height)
    writers.save_graphs(extraction.scheme(steps), a.output_dir)


if __name__ == "__main__":
    main()

"""python -m loomtext: files, folders and URLs to Markdown documents, dry runs and backfills.

Pages and posts are asked for over HTTP. What else needs a service takes it by name, as in --service tool=package.module:Tool
(kinds: web, tool, speech, converter, model, vision); items of kinds without one keep an error. Settings that would change
nothing are an error, so that no option is silently without effect.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.operators import relational as R
from loomtext.plans import config, pipelines, runs, sinks
from loomtext.runtime import ship, stored
from loomtext.sources import files


def _spread(items: DataFrame, listed: DataFrame) -> DataFrame:
    """Items (pos, url) with folders put in full by a listing (path); places stay apart and in order. A file is looked up
    by each folder that it is in, so the join is one of equal keys."""
    steps = F.split("path", "/")
    parents = listed.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("parent"))
    asked = items.select("pos", F.rtrim(F.col("url"), F.lit("/")).alias("parent"))
    inside = parents.join(asked, "parent").select("pos", F.col("path").alias("url"))
    rows = items.join(inside.select("pos").distinct(), "pos", "left_anti").unionByName(inside)
    place = F.row_number().over(Window.partitionBy("pos").orderBy("url"))
    return rows.select((F.shiftleft(F.col("pos").cast("bigint"), 40) + place).alias("pos"), "url")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """What was done, a row for each item."""
    args = config.parser().parse_args(argv)
    cfg, services = config.load(args.config, config.overrides(args)), runs.Services.named(args.service)
    if idle := runs.without_effect(cfg, services):
        raise SystemExit(f"settings without effect: {', '.join(idle)}")
    spark = spark or SparkSession.builder.appName("loomtext").getOrCreate()
    ship(spark)
    out = f"{cfg.output.dir}/output"
    if args.backfill_batch:
        done = sinks.backfill(sinks.read_files(spark, out))
        sinks.write_files(sinks.batch_copies(done), out, overwrite=True)
        return done.select("folder", "file")
    listed_text = spark.read.text(args.file, wholetext=True).select(F.col("value").alias("text")) if args.file else None
    items = R.inputs([], list(cfg.urls), spark, listed_text)
    here = [p for p in cfg.urls if os.path.exists(p)]
    listed = files.listing(spark, here) if here else spark.createDataFrame([], "path string, modified timestamp, length bigint")
    items = R.routed(_spread(items, listed), listed)
    if args.dry_run:
        return items.select("url", "content_type").join(pipelines.preview_files(listed).withColumnRenamed("path", "url"), "url", "left")
    scanned = files.scan(spark, here).withColumn("path", F.regexp_replace("path", "^file:(?://)?", "")) if here else None
    done, _ = stored(pipelines.run(items, runs.plans(cfg, services, scanned), cfg), "run")
    runs.save(done, cfg, out)
    return done.select("url", "content_type", "title", "error_type", "error_message")


if __name__ == "__main__":
    main(sys.argv[1:]).show(1000, truncate=100)

"""Redirects followed to their ends by pointer doubling: after r rounds every pointer has gone 2 ** r hops.

A round joins the pointers that are still open with the table of all pointers, so chains of n hops take log2(n) rounds. Each
pointer also keeps the least URL that it has come by: the least URL of a cycle comes by itself and is closed as the cycle's
root. In the rounds after, the cycle's other URLs are closed, as the least that they have come by is a root, and then
those that point to closed ones. So a cycle of n URLs takes log2(n) rounds too, and the rounds end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import drop_path, stored


def followed(redirects: DataFrame) -> DataFrame:
    """Redirects (url, target) -> (url, final, hops, cyclic): where each URL's chain ends and after how many hops. Chains that
    lead into a cycle have no final URL and no hops. Of several targets of a URL the least is taken; null URLs and targets
    are left out; a URL that leads to itself is a cycle. Extra columns are not carried along."""
    edges = redirects.where("url IS NOT NULL AND target IS NOT NULL").groupBy("url").agg(F.min("target").alias("to"))
    # state: 0 open, 1 ended at `to`, 2 leads into a cycle.
    rows = edges.select("url", "to", F.col("to").alias("least"), F.lit(1).cast("bigint").alias("hops"), F.when(F.col("to") == F.col("url"), 2).otherwise(0).alias("state"))
    rows, path = stored(rows, "redirects-0")
    spark, r = redirects.sparkSession, 0
    while not rows.where("state = 0").isEmpty():
        ahead = rows.select(F.col("url").alias("at"), F.col("to").alias("a_to"), F.col("least").alias("a_least"), F.col("hops").alias("a_hops"), F.col("state").alias("a_state"))
        roots = rows.where("state = 2 AND least = url").select(F.col("url").alias("root"))
        went = rows.where("state = 0").join(ahead, F.col("to") == F.col("at"), "left").join(roots, F.col("least") == F.col("root"), "left")
        least = F.least("least", "a_least")
        state = F.when(F.col("at").isNull(), 1).when(F.col("a_state") > 0, F.col("a_state")).when((least == F.col("url")) | F.col("root").isNotNull(), 2).otherwise(0)
        moved = went.select("url", F.coalesce("a_to", "to").alias("to"), least.alias("least"), (F.col("hops") + F.coalesce("a_hops", F.lit(0))).alias("hops"), state.alias("state"))
        r += 1
        rows, new = stored(rows.where("state > 0").unionByName(moved), f"redirects-{r}")
        drop_path(spark, path)
        path = new
    ended = F.col("state") == 1
    return rows.select("url", F.when(ended, F.col("to")).alias("final"), F.when(ended, F.col("hops")).alias("hops"), (~ended).alias("cyclic"))

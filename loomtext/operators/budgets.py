"""One budget of tokens and calls for all calls of a batch, wherever they run: when each is admitted.

In order of arrival, call n is admitted at max(its arrival, the admission of call k(n) + window), where k(n) is the last
call before it that must have left the window for it to fit: by calls n - most_calls, by tokens the last call from which the
tokens up to n are over the limit. k(n) comes from sums of tokens alone, not from times. So an admission is a function
x -> max(b, x + i * window) of one earlier admission x, and such functions compose into such functions.

Calls are numbered by ranges of their time and cut into blocks of equal numbers of calls, none shorter than a window's
calls. A block, with the last window of the block before, tells each call's function of an admission in that last window.
The functions of the blocks' last windows, few rows for each block, are composed by doubling: after r rounds they reach
over 2 ** r blocks. Then every call takes its value. No task sees all calls, and none has a window over all of them; what
reaches the driver is a count for each range.

Calls whose tokens are over the limit are never admitted and hold up none. Null tokens count as 0. Calls without a time are
never admitted either. Equal times are taken in order of the key columns, nulls first; rows that are equal in all of these
are taken in either order. An empty table gives no rows; extra columns are carried along, but for one named `admitted`, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import col
from loomtext.runtime import drop_path, ship, stored

#: Calls in a block at least.
BLOCK = 1 << 16


def _ranges(rows: DataFrame, order: list[str]) -> tuple[DataFrame, list[str], int]:
    """rows with `n_`, their number in order from 0, by ranges; scratch tables; how many rows there are."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(tasks, *sorted_keys).sortWithinPartitions(*sorted_keys)
    # The number within its range is the place that the sort gave it: ids of a partition go up by one.
    numbered = dealt.withColumn("id_", F.monotonically_increasing_id())
    found, path = stored(numbered.withColumn("range_", F.shiftright("id_", 33).cast("int")).withColumn("id_", F.col("id_").bitwiseAND(F.lit((1 << 33) - 1))), "calls")
    counts = sorted((r["range_"], r["n"]) for r in found.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).collect())
    total, before = 0, []
    for at, n in counts:
        before += [F.lit(at), F.lit(total)]
        total += n
    number = F.col("id_") + (F.create_map(*before)[F.col("range_")] if before else F.lit(0)).cast("bigint")
    return found.withColumn("n_", number).drop("id_", "range_"), [path], total


def _block(most_tokens: int, most_calls: int, window: int, table: pa.Table) -> pa.Table:
    """A block's calls, with the last ones of the block before, to the functions of its own: exit_, jumps_, local_."""
    table = table.take(pa.array(np.argsort(table.column("n_").to_numpy(), kind="stable")))
    at, tokens, own = table.column("at_").to_numpy(), table.column("tokens_").to_numpy(), table.column("own_").to_numpy(zero_copy_only=False)
    first, start = int(table.column("n_")[0].as_py()), int((~own).sum())
    ends = np.concatenate([[0], np.cumsum(tokens)])
    last = np.maximum(np.searchsorted(ends, ends[1:] - most_tokens, "left") - 1, np.arange(len(at)) - most_calls).tolist()
    local, exits, jumps = at.tolist(), [-1] * len(at), [0] * len(at)
    for j in range(start, len(at)):
        k = last[j]
        if k >= start:
            local[j] = max(local[j], local[k] + window)
            exits[j], jumps[j] = exits[k], jumps[k] + 1
        elif k >= 0:
            exits[j], jumps[j] = first + k, 1
    mine = slice(start, len(at))
    out = table.slice(start).drop_columns(["block_", "own_", "at_", "tokens_"])
    ends_at = pa.array(exits[mine], pa.int64(), mask=np.array(exits[mine]) < 0)
    return out.append_column("exit_", ends_at).append_column("jumps_", pa.array(jumps[mine], pa.int64())).append_column("local_", pa.array(local[mine], pa.int64()))


def shared_budget(calls: DataFrame, ts: str, tokens: str | Column, key: list[str], most_tokens: int, most_calls: int, window: float = 60.0, block: int = BLOCK) -> DataFrame:
    """calls with `admitted`, a time in microseconds: one budget of `most_tokens` and `most_calls` within any `window` seconds."""
    spark = calls.sparkSession
    ship(spark)
    micros = int(round(window * 1_000_000))
    rows = calls.drop("admitted").withColumn("at_", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("tokens_", F.coalesce(col(tokens), F.lit(0)).cast("bigint"))
    fits = F.col("at_").isNotNull() & (F.col("tokens_") <= most_tokens) & F.lit(most_calls >= 1)
    never = rows.where(~fits).drop("at_", "tokens_").withColumn("admitted", F.lit(None).cast("bigint"))
    numbered, paths, total = _ranges(rows.where(fits), ["at_", *key])
    size = max(block, most_calls)
    # The last calls of a block are also seen by the next one.
    place = F.col("n_") % size
    blocks = F.when(place >= size - most_calls, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    seen = numbered.withColumn("more_", F.explode(blocks)).withColumn("block_", F.floor(F.col("n_") / size) + F.col("more_")).withColumn("own_", F.col("more_") == 0).drop("more_")
    seen = seen.where(F.col("own_") | (F.col("block_") * size < total))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.drop("at_", "tokens_").schema]

    def each(table: pa.Table) -> pa.Table:
        return _block(most_tokens, most_calls, micros, table)

    told = seen.groupBy("block_").applyInArrow(each, ", ".join([*fields, "exit_ bigint", "jumps_ bigint", "local_ bigint"]))
    told, path = stored(told, "calls-in-blocks")
    paths.append(path)
    tails = told.where(F.col("n_") % size >= size - most_calls).select("n_", "exit_", "jumps_", "local_")
    reach, n_blocks = 1, -(-total // size)
    while reach < n_blocks:
        far = tails.select(F.col("n_").alias("m_"), F.col("exit_").alias("far_exit"), F.col("jumps_").alias("far_jumps"), F.col("local_").alias("far_local"))
        step = tails.join(far, F.col("exit_") == F.col("m_"), "left")
        step = step.select("n_", F.col("far_exit").alias("exit_"), (F.col("jumps_") + F.coalesce("far_jumps", F.lit(0))).alias("jumps_"), F.greatest("local_", F.col("far_local") + F.col("jumps_") * micros).alias("local_"))
        tails, path = stored(step, f"tails-{reach}")
        paths.append(path)
        reach *= 2
    known = tails.select(F.col("n_").alias("m_"), F.col("local_").alias("far_local"))
    done = told.join(known, F.col("exit_") == F.col("m_"), "left")
    done = done.withColumn("admitted", F.greatest("local_", F.col("far_local") + F.col("jumps_") * micros))
    done, _ = stored(done.select(*[c for c in calls.columns if c != "admitted"], "admitted"), "admitted")
    for path in paths:
        drop_path(spark, path)
    return done.unionByName(never.select(done.columns))

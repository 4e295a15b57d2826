"""Filter interaction audit: what each filter removes, in every order of the filters, from one pass over the documents.

A document fails a set of filters, held as a bit mask. Rows are counted by part and mask, as are rows with each label.
The subset-zeta transform turns a part's counts f into z[T], the sum of f over all subsets of T; the documents that the
filters of a set S let through are those whose mask lies within the complement of S, so z[all - S]. What a filter removes
at its place in an order is then a difference between two neighbouring subsets, whatever came before in which order, and
the sum over all orders (Shapley, times their number) weighs each such difference by the orders that pass through it.

The texts are read once and stay where they are: only keys, parts, masks and digests move. A filter for repeated texts
is told by the digests: in each group of equal ones, rows of the smallest key pass. Equal rows are counted together before
they move, so a group of copies comes down to a few rows of each task. The tables of counts have at most
2 ** filters rows for each part.

Null parts count as ''. A null condition counts as not failed. Rows with a null key are never repeats, nor do others
repeat them, and they have no labels. Rows that are repeated as a whole, or share a key, count each. A key that the labels
hold more than once is labelled if any of its rows is. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters at most: the counts of a part are arrays of 2 ** filters.
MOST = 12


def quality_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions A to D of a text: few words, repeated words, capitals, symbols. Null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")  # generated code, so that it is split once for A and B
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 5 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def masks(df: DataFrame, filters: Mapping[str, Column], labels: DataFrame | None = None, flags: Mapping[str, Column] | None = None, repeats: str | None = None, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (part, mask, n, one count for each of `flags`): documents by the filters that they fail, bit i for the i-th.

    `repeats` names one more filter, the last, that fails texts which a row of a smaller key has as well. `flags` are
    conditions on the rows of `labels`, which hold `key`.
    """
    if len(filters) + bool(repeats) > MOST:
        raise ValueError(f"more than {MOST} filters")
    flags = dict(flags or {})
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("int")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)) if repeats else F.lit(None).cast("binary")
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    rows = rows.groupBy("key", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    if flags:
        told = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()))
        rows = rows.join(told, "key", "left").withColumns({name: F.coalesce(F.col(name), F.lit(False)) for name in flags})
    if not repeats:
        return _counted(rows, flags)
    # A key is in one row of a digest and part by now, so the rows of the smallest key can be counted by min_by.
    same = rows.groupBy("digest", "part", "mask", *flags).agg(F.sum("n").alias("n"), F.min("key").alias("first"), F.min_by("n", "key").alias("n_first"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_null"))
    same = same.withColumn("least", F.min("first").over(Window.partitionBy("digest")))
    passed = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), passed.alias("n")), F.struct((F.col("mask") + F.lit(1 << len(filters))).alias("mask"), (F.col("n") - passed).alias("n"))))
    return _counted(same.select("part", *flags, split.alias("x")).select("part", *flags, "x.mask", "x.n").where("n > 0"), flags)


def _counted(rows: DataFrame, flags: Iterable[str]) -> DataFrame:
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(f), F.col("n")).otherwise(0)).alias(f) for f in flags))


def zeta(counts: Column, n: int) -> Column:
    """Sums over all subsets, of an array of 2 ** n counts by mask: one step for each bit, as a fold."""
    return F.aggregate(
        F.array(*(F.lit(1 << i) for i in range(n))), counts,
        lambda z, bit: F.transform(z, lambda v, m: v + F.when(m.bitwiseAND(bit) != 0, F.get(z, m.bitwiseXOR(bit))).otherwise(F.lit(0).cast("bigint"))),
    )


def survivors(found: DataFrame, n: int, flags: Iterable[str] = ()) -> DataFrame:
    """Rows (part, f, z, z_<flag> ...): a part's counts by mask, and their zeta transforms."""
    full = 1 << n
    at = F.sequence(F.lit(0), F.lit(full - 1))
    of = lambda c: F.map_from_entries(F.collect_list(F.struct("mask", c)))
    maps = found.groupBy("part").agg(*(of(c).alias(c) for c in ("n", *flags)))
    spread = lambda c: F.transform(at, lambda m: F.coalesce(F.element_at(F.col(c), m), F.lit(0).cast("bigint"))).alias(c)
    dense = maps.select("part", *map(spread, ("n", *flags)))
    return dense.select("part", F.col("n").alias("f"), zeta(F.col("n"), n).alias("z"), *(zeta(F.col(c), n).alias(f"z_{c}") for c in flags))


def order_steps(names: list[str], orders: Iterable[Iterable[str]] | None = None) -> list[dict]:
    """Each step of each order (all, unless given): its filter, and the subsets before and after as masks."""
    out = []
    for order in itertools.permutations(names) if orders is None else orders:
        order, before = list(order), 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            out.append({"filter_order": "".join(order), "step": step, "filter": name, "bit": bit, "before": before})
            before |= bit
    return out


def _shapley(z: Column, n: int, bit: Column) -> Column:
    """What the filter of this bit removes, summed over all orders: each subset without it stands for |S|! (n - 1 - |S|)! of them."""
    full = (1 << n) - 1
    weight = F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("bigint") for k in range(n)))
    one = lambda s: F.get(weight, F.bit_count(s)) * (F.get(z, F.lit(full).bitwiseXOR(s)) - F.get(z, F.lit(full).bitwiseXOR(s.bitwiseOR(bit))))
    subsets = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: s.bitwiseAND(bit) == 0)
    return F.aggregate(subsets, F.lit(0).cast("bigint"), lambda total, s: total + one(s))


def interactions(found: DataFrame, names: list[str], flags: Iterable[str] = (), orders: Iterable[Iterable[str]] | None = None) -> DataFrame:
    """Rows (part, filter_order, step, filter, kept, removed, redundant, unique_fails, shapley, lost_<flag> ...) of counts by mask.

    shapley is over all orders of `names`, whichever are listed. `orders` may be a part of them where filters are many.
    """
    n, flags = len(names), list(flags)
    full = (1 << n) - 1
    steps = json.dumps(order_steps(names, orders))
    kind = "array<struct<filter_order:string,step:int,filter:string,bit:int,before:int>>"
    tables = survivors(found, n, flags)
    per_filter = F.array(*(_shapley(F.col("z"), n, F.lit(1 << i)) for i in range(n)))
    rows = tables.withColumn("s", per_filter).select("*", F.explode(F.from_json(F.lit(steps), kind)).alias("o")).select("*", "o.*")
    left = lambda z, s: F.get(F.col(z), F.lit(full).bitwiseXOR(s))
    after = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda z: left(z, F.col("before")) - left(z, after)
    fails = F.get("z", F.lit(full)) - left("z", F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", "filter", left("z", after).alias("kept"), lost("z").alias("removed"), (fails - lost("z")).alias("redundant"), F.get("f", F.col("bit")).alias("unique_fails"),
        F.get("s", F.array_position(F.array(*(F.lit(x) for x in names)), F.col("filter")).cast("int") - 1).alias("shapley"), *(lost(f"z_{c}").alias(f"lost_{c}") for c in flags),
    )


def audit(df: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All orders of the filters A to E over the texts of df, with documents of good quality and toxic ones that are lost."""
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    found = masks(df, quality_filters(text), labels.select(key, "quality", "toxic"), flags, "E", part, key, text)
    return interactions(found, list("ABCDE"), flags)


#: The audit in DuckDB's SQL: every step of every order is counted on its own.
SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
 d AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
              100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e,
              EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS bad FROM w),
 g AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
              count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (bad) AS n_bad FROM d GROUP BY ALL),
 x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
 orders AS (SELECT concat(p.f, q.f, r.f, s.f, t.f) AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
 steps AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
 h AS (SELECT part, filter_order, step, f, n, n_good, n_bad, fails, contains(fails, f) AS hit, before <> '' AND regexp_matches(fails, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone FROM g, steps),
 r AS (SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
              sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
              sum(CASE WHEN NOT gone AND hit THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN n_bad ELSE 0 END) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

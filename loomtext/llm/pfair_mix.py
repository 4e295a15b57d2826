"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Documents of a source are put in a fixed random order and cut into blocks. A slot of the mix takes one block. With
target weights k_i / PERIOD, the j-th block of source i (from 0) is released at slot floor(j * PERIOD / k_i) and due by
ceil((j + 1) * PERIOD / k_i). In each slot, of the sources whose next block is released, that with the earliest deadline
is taken, ties to the source first in order. The weights sum to 1, so a block always is ready and none is late: after
any number of slots each source has had less than one block more or less than its share.

The schedule repeats after a period of PERIOD slots or, where sources are many or a weight is small, of that doubled
until each source can have FINE slots, both on average and by its own weight. So k_i / period is off the weight by less
than 2 / FINE of it; the bound of a block holds for k_i / period. The schedule is made by one fold in one row, from a
table with a row per source; slot numbers are as many as the period, which bounds what is broadcast.

The period is bounded. Without given weights, sources of less than LEAST of the whole share places of the schedule: by
size, as many of them as come to LEAST, or with the smallest source that has it, form one pool, whose documents are mixed
as those of one source and whose weight is the sum of theirs; the bound of a block holds for the pool. So at most
1 / LEAST sources and pools take FINE / LEAST slots or twice as many. With given weights, which are kept, a weight that
would take more than MOST_SLOTS is an error that names the least one possible.

Blocks go on from a source's start where its documents end; `until="all"` stops when every document has been taken once,
`until="first"` when the first source is at its end, so that none is repeated.

Null sources form one source of their own. Repeated rows each take their place. Rows are ordered by a hash of their key,
equal keys and null keys by a hash of the whole row, so that many rows of one key are spread and a task that runs again
gives the same. An empty table gives no rows. Sources that given weights do not name, weights of zero or less, and more
sources than a period that is given are errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots in a period, documents in a block, power of a source's size that gives its weight.
PERIOD, BLOCK, POWER = 1024, 16, 0.8
#: Slots that each source can have in a period that is not given.
FINE = 32
#: Share of the whole below which sources are pooled; slots that a period has at most for weights that are given.
LEAST, MOST_SLOTS = 1 / 256, 1 << 14
#: Hexadecimal digits of the order's hash that tell a bucket, at least, and rows of a bucket, about: the buckets of each
#: source are ranked apart, and there are more of them where the largest source has more rows.
DIGITS, BUCKET_ROWS = 2, 1 << 20

#: One period's schedule: at each slot the index of the source taken. `ks` holds each source's blocks in a period.
SCHEDULE = """
aggregate(sequence(0, {p} - 1), struct(array_repeat(0L, size(ks)) AS c, cast(array() AS array<int>) AS o), (s, t) ->
  element_at(transform(array(
      array_min(filter(transform(ks, (k, i) -> IF(s.c[i] < k AND s.c[i] * {p} div k <= t, struct(((s.c[i] + 1) * {p} + k - 1) div k AS due, i AS i), NULL)), x -> x IS NOT NULL)).i),
    i -> struct(transform(s.c, (c, j) -> IF(j = i, c + 1, c)) AS c, concat(s.o, array(i)) AS o)), 1), s -> s.o)
"""


def weights_by_size(counts: DataFrame, power: float = POWER, period: int = PERIOD) -> DataFrame:
    """Rows (mix_key, n) -> (mix_key, n, k): blocks in a period, in proportion to n ** power, by largest remainder."""
    return blocks_in_period(counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power))), period)


def blocks_in_period(weighed: DataFrame, period: int = PERIOD) -> DataFrame:
    """Rows (mix_key, n, weight) -> (mix_key, n, k). Each source has one block, the rest follow the weights."""
    every = Window.partitionBy(F.lit(0))  # a row per source
    share = weighed.withColumn("sources", F.count(F.lit(1)).over(every))
    share = share.withColumn("fits", F.when(F.col("sources") > period, F.raise_error(F.lit("more sources than slots in a period"))).otherwise(True))
    share = share.withColumn("share", F.col("weight") / F.sum("weight").over(every) * (F.lit(period) - F.col("sources")))
    share = share.withColumn("whole", F.floor("share")).withColumn("left", F.lit(period) - F.col("sources") - F.sum("whole").over(every))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("share") - F.col("whole")).desc(), "mix_key"))
    k = 1 + F.col("whole") + F.when(place <= F.col("left"), 1).otherwise(0)
    return share.where("fits").select("mix_key", "n", k.cast("bigint").alias("k"))


def period_for(weighed: DataFrame) -> int:
    """The period for rows (mix_key, weight): PERIOD, doubled while a source's share has less than FINE slots."""
    n, least, whole = weighed.agg(F.count(F.lit(1)), F.min("weight"), F.sum("weight")).first()
    period = PERIOD
    while n and (period < n * FINE or period * least < FINE * whole):
        if 2 * period > MOST_SLOTS:
            raise ValueError(f"{n} sources of least weight {least} take more than {MOST_SLOTS} slots: at most {MOST_SLOTS // FINE} sources and weights of {FINE * whole / MOST_SLOTS:.6g} and more are possible")
        period *= 2
    return period


def pools(weighed: DataFrame) -> DataFrame:
    """Rows (mix_key, n, weight) -> (mix_key, n, weight, pool): sources of LEAST of the whole are pools of their own, named as
    they are; smaller ones are put together, in order of weight, until they come to that."""
    every = Window.partitionBy(F.lit(0))  # a row per source
    rows = weighed.withColumn("share", F.col("weight") / F.sum("weight").over(every)).withColumn("small", F.col("share") < LEAST)
    rows = rows.withColumn("all_small", F.sum(F.when(F.col("small"), F.col("share")).otherwise(0.0)).over(every))
    rows = rows.withColumn("next_key", F.min_by("mix_key", F.when(~F.col("small"), F.struct("share", "mix_key"))).over(every))
    before = F.sum(F.when(F.col("small"), F.col("share")).otherwise(0.0)).over(Window.partitionBy(F.lit(0)).orderBy("share", "mix_key").rowsBetween(Window.unboundedPreceding, -1))
    # Spans of twice LEAST, of which none ends more than LEAST late; what the last one lacks, the one before has.
    bins = F.greatest(F.floor(F.col("all_small") / (2 * LEAST)), F.lit(1))
    number = F.least(F.floor(F.coalesce(before, F.lit(0.0)) / (2 * LEAST)), bins - 1)
    alone = (F.col("all_small") >= LEAST) | F.col("next_key").isNull()
    pool = F.when(~F.col("small"), F.col("mix_key")).when(alone, F.concat(F.lit("+"), number.cast("string"))).otherwise(F.col("next_key"))
    return rows.select("mix_key", "n", "weight", pool.alias("pool"))


def digits_for(rows: DataFrame) -> int:
    """Hex digits of a bucket, so that a bucket of the largest source holds some BUCKET_ROWS rows. Ranks do not depend on it."""
    most = rows.groupBy("mix_key").count().agg(F.max("count")).first()[0] or 0
    digits = DIGITS
    while digits < 8 and most > BUCKET_ROWS << 4 * digits:
        digits += 1
    return digits


def schedule(shares: DataFrame, period: int = PERIOD, block: int = BLOCK, until: str = "all") -> DataFrame:
    """Rows (mix_key, n, k) -> (mix_key, k, blocks, given, slots): slots of a source's blocks in a period, how many
    blocks it has, and how many it is given in the whole mix."""
    table = shares.agg(F.array_sort(F.collect_list(F.struct("mix_key", "n", "k"))).alias("all")).where(F.size("all") > 0)
    table = table.withColumn("ks", F.transform("all", lambda x: x["k"])).withColumn("taken", F.expr(SCHEDULE.format(p=period)))
    rows = table.select("taken", F.posexplode("all").alias("i", "x")).select(
        "x.mix_key", "x.k", F.ceil(F.col("x.n") / block).cast("bigint").alias("blocks"), F.expr(f"filter(sequence(0, {period} - 1), t -> taken[t] = i)").alias("slots")
    )
    last = (F.floor((F.col("blocks") - 1) / F.col("k")) * period + F.get("slots", ((F.col("blocks") - 1) % F.col("k")).cast("int")) + 1).cast("bigint")
    end = (F.max if until == "all" else F.min)(last).over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("end", end)
    given = F.floor(F.col("end") / period) * F.col("k") + F.size(F.filter("slots", lambda t: t < F.col("end") % period))
    return rows.select("mix_key", "k", "blocks", given.cast("bigint").alias("given"), "slots")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", power: float = POWER, weights: dict[str | None, float] | None = None, period: int | None = None, block: int = BLOCK, until: str = "all") -> DataFrame:
    """df's rows, each as often as it is taken, with epoch, block, slot, release and deadline.

    `weights` are targets by source, of any sum; without them a source's weight is its number of documents to the power
    `power`. Without `period` it is chosen by the sources. Extra columns are carried along; columns of the names added are replaced.
    """
    added = ("epoch", "block", "slot", "release", "deadline", "mix_key", "mix_hash", "mix_bucket", "mix_tie")
    rows = df.select(*(c for c in df.columns if c not in added)).withColumn("mix_key", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    if weights is None:
        counted = rows.groupBy("mix_key").agg(F.count(F.lit(1)).alias("n"))
        pooled = pools(counted.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(power))))
        moved = {r["mix_key"]: r["pool"] for r in pooled.where("mix_key <> pool").collect()}  # a row per small source
        if moved:
            names = df.sparkSession.createDataFrame(list(moved.items()), "mix_key string, pool string")
            rows = rows.join(names, "mix_key", "left").withColumn("mix_key", F.coalesce("pool", "mix_key")).drop("pool")
    whole_row = F.xxhash64(*(F.col(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))
    rows = rows.withColumn("mix_tie", whole_row)
    rows = rows.withColumn("mix_hash", F.md5(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.col("mix_tie").cast("string"))).cast("binary")))
    rows = rows.withColumn("mix_bucket", F.left("mix_hash", F.lit(digits_for(rows))))
    # Ranks in two steps, so that no source's rows meet in one task: rows of the buckets before, then rows within.
    sizes = rows.groupBy("mix_key", "mix_bucket").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("mix_key").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("mix_key", "mix_bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    counts = sizes.groupBy("mix_key").agg(F.sum("size").alias("n"))
    if weights is None:
        weighed = pooled.groupBy(F.col("pool").alias("mix_key")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    else:
        if not all(0 < w < float("inf") for w in weights.values()):
            raise ValueError("weights must be positive")
        given = df.sparkSession.createDataFrame([("" if k is None else f"={k}", float(w)) for k, w in weights.items()], "mix_key string, weight double")
        unnamed = F.raise_error(F.concat(F.lit("no weight is given for source "), F.coalesce(F.nullif(F.col("mix_key"), F.lit("")), F.lit("null"))))
        weighed = counts.join(given, "mix_key", "left").withColumn("weight", F.coalesce("weight", unnamed.cast("double")))
    period = period or period_for(weighed)
    shares = blocks_in_period(weighed, period)
    plan = schedule(shares, period, block, until)
    within = F.row_number().over(Window.partitionBy("mix_key", "mix_bucket").orderBy("mix_hash", F.col(key).asc_nulls_first(), "mix_tie")) - 1
    placed = rows.withColumn("mix_rank", within).join(offsets, ["mix_key", "mix_bucket"]).withColumn("mix_block", F.floor((F.col("mix_rank") + F.col("offset")) / block))
    placed = placed.join(F.broadcast(plan), "mix_key").where("mix_block < given")
    placed = placed.withColumn("epoch", F.explode(F.expr("sequence(0L, (given - 1 - mix_block) div blocks)")))
    placed = placed.withColumn("block", F.col("mix_block") + F.col("epoch") * F.col("blocks"))
    j, turn = F.col("block") % F.col("k"), F.floor(F.col("block") / F.col("k")) * period
    out = placed.select(
        *(c for c in df.columns if c not in added), "epoch", "block", (turn + F.get("slots", j.cast("int"))).cast("bigint").alias("slot"),
        (turn + F.floor(j * period / F.col("k"))).cast("bigint").alias("release"), (turn + F.ceil((j + 1) * period / F.col("k"))).cast("bigint").alias("deadline"),
    )
    return out


#: The same in DuckDB's SQL, over the table `{table}`.
SQL = """
WITH RECURSIVE d AS (SELECT {columns}, coalesce('=' || source, '') AS mk FROM {table}),
 c AS (SELECT mk, count(*) AS n, power(count(*)::DOUBLE, {power}) AS w FROM d GROUP BY mk),
 s AS (SELECT mk, n, w / sum(w) OVER () * ({p} - count(*) OVER ()) AS share, {p} - count(*) OVER () AS free FROM c),
 r AS (SELECT *, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, mk) AS place, free - sum(floor(share)) OVER () AS over FROM s),
 k AS (SELECT mk, n, CAST(1 + whole + CASE WHEN place <= over THEN 1 ELSE 0 END AS BIGINT) AS k, row_number() OVER (ORDER BY mk) AS i FROM r),
 a AS (SELECT list(k ORDER BY i) AS ks FROM k),
 e AS (SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, list_transform(ks, lambda x: CAST(0 AS BIGINT)) AS c, ks FROM a
       UNION ALL
       SELECT t + 1, pick, list_transform(range(1, len(ks) + 1), lambda j: c[j] + CASE WHEN j = pick THEN 1 ELSE 0 END), ks
       FROM (SELECT t, c, ks, list_min(list_transform(list_filter(range(1, len(ks) + 1), lambda j: c[j] < ks[j] AND c[j] * {p} // ks[j] <= t + 1),
                    lambda j: (((c[j] + 1) * {p} + ks[j] - 1) // ks[j]) * 100000 + j)) % 100000 AS pick FROM e WHERE t + 1 < {p})),
 slot AS (SELECT i, t, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS j FROM e WHERE t >= 0),
 b AS (SELECT k.*, CAST(ceil(n / {block}) AS BIGINT) AS blocks FROM k),
 z AS (SELECT max((b.blocks - 1) // b.k * {p} + slot.t + 1) AS stop FROM b JOIN slot ON slot.i = b.i AND slot.j = (b.blocks - 1) % b.k),
 g AS (SELECT b.*, stop // {p} * b.k + (SELECT count(*) FROM slot WHERE slot.i = b.i AND slot.t < stop % {p}) AS given FROM b, z),
 x AS (SELECT d.*, (row_number() OVER (PARTITION BY mk ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) // {block} AS mb FROM d),
 o AS (SELECT x.*, g.k, g.i, u.epoch, mb + u.epoch * blocks AS block FROM x JOIN g USING (mk), LATERAL (SELECT unnest(range(0, (given - 1 - mb) // blocks + 1)) AS epoch) u WHERE mb < given)
SELECT {columns}, epoch, block, block // o.k * {p} + slot.t AS slot,
       CAST(block // o.k * {p} + (block % o.k) * {p} // o.k AS BIGINT) AS release, CAST(block // o.k * {p} + ((block % o.k + 1) * {p} + o.k - 1) // o.k AS BIGINT) AS deadline
FROM o JOIN slot ON slot.i = o.i AND slot.j = block % o.k
"""


def sql(table: str = "documents", columns: str = "doc_id, source", power: float = POWER, period: int = PERIOD, block: int = BLOCK) -> str:
    return SQL.format(table=table, columns=columns, power=power, p=period, block=block)

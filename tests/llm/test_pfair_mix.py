"""op4 against its SQL, against a plain earliest-deadline-first loop, and the bound on deviation."""

import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loomtext.llm import pfair_mix, queries
from tests.llm.cases import TEXTS, documents, saved


def plain_schedule(ks, period):
    done, out = [0] * len(ks), []
    for t in range(period):
        ready = [(-(-(c + 1) * period // k), i) for i, (c, k) in enumerate(zip(done, ks)) if c < k and c * period // k <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


def test_oracle(spark):
    for sf in ("sf0.001", "sf0.01"):
        db = duckdb.connect()
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        want = db.sql(queries.ORACLES["op4_pfair_mix"])
        got = queries.op4_pfair_mix(spark, f"/root/testdata/{sf}")
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_deviation_is_less_than_a_block(spark):
    rows = [(i, "abcdefg"[min(6, (i * i) % 11)]) for i in range(700)] + [(1000 + i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    for power, period in ((0.5, 64), (1.0, 97), (0.0, 16)):
        got = pfair_mix.mix(df, power=power, period=period, block=4).collect()
        slots = {r["slot"]: r["source"] for r in got}
        assert sorted(slots) == list(range(len(slots)))  # one block in each slot, none left out
        assert {r["doc_id"] for r in got} == {k for k, _ in rows}  # every document at least once
        counts = {"" if r["source"] is None else "=" + r["source"]: 0 for r in got}
        n = Counter("" if s is None else "=" + s for _, s in rows)
        shares = pfair_mix.weights_by_size(spark.createDataFrame(list(n.items()), "mix_key string, n bigint"), power, period).collect()
        k = {r["mix_key"]: r["k"] for r in shares}
        assert sum(k.values()) == period
        order = sorted(k)
        plan = plain_schedule([k[x] for x in order], period)
        for t in range(len(slots)):
            name = "" if slots[t] is None else "=" + slots[t]
            assert name == order[plan[t % period]]
            counts[name] += 1
            assert all(abs(counts[x] * period - (t + 1) * k[x]) < period for x in k)
        for r in got:
            assert r["release"] <= r["slot"] < r["deadline"]


def test_given_weights_and_stop(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y", "keep", 5) for i in range(300)], "doc_id bigint, source string, text string, slot int")
    got = pfair_mix.mix(df, weights={"x": 3, "y": 1}, period=8, block=5, until="first").collect()
    assert max(Counter(r["doc_id"] for r in got).values()) == 1 and {r["text"] for r in got} == {"keep"}
    by = defaultdict(set)
    for r in got:
        by[r["source"]].add(r["slot"])
    # One block each, then 3 : 1 of the six others, by largest remainder.
    assert abs(len(by["x"]) / len(by["y"]) - 6 / 2) < 0.6


def test_odd_rows(spark, tmp_path):
    got = queries.op4_pfair_mix(spark, saved(spark, tmp_path, documents(spark))).collect()
    assert Counter(r["doc_id"] for r in got if r["epoch"] == 0) == Counter(k for k, _ in TEXTS)
    assert queries.op4_pfair_mix(spark, saved(spark, tmp_path, documents(spark, []))).collect() == []


def test_small_and_many_sources_have_their_weights(spark, monkeypatch):
    df = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(300)], "doc_id bigint, source string")
    weights = {"x": 0.9, "y": 0.095, "z": 0.005}
    slots = {(r["slot"], r["source"]) for r in pfair_mix.mix(df, weights=weights, block=1).collect()}
    got = Counter(s for _, s in slots)
    assert all(abs(got[s] / len(slots) / w - 1) < 0.05 for s, w in weights.items())
    monkeypatch.setattr(pfair_mix, "PERIOD", 16)
    many = spark.createDataFrame([(i, str(i % 20)) for i in range(200)], "doc_id bigint, source string")  # more than 16 sources
    assert {r["doc_id"] for r in pfair_mix.mix(many).collect()} == set(range(200))


def test_sources_without_weight_are_an_error(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "doc_id bigint, source string")
    with pytest.raises(Exception, match="no weight is given for source"):
        pfair_mix.mix(df, weights={"x": 1, None: 1}).collect()
    with pytest.raises(ValueError):
        pfair_mix.mix(df, weights={"x": 1, "y": 0, None: 1})


def pooled_deviation(got, pool_of, n, power, block):
    """The largest deviation of a pool's blocks from its share of a period, times the period, over all slots."""
    slots = {}
    for r in got:
        slots.setdefault(r["slot"], pool_of(r["source"]))
        assert slots[r["slot"]] == pool_of(r["source"]) and r["release"] <= r["slot"] < r["deadline"]
    assert sorted(slots) == list(range(len(slots)))
    return slots


def test_many_sources_and_one_huge(spark):
    """One source has nearly all rows and 300 have one or two: they share places, and the schedule stays short."""
    rows = [(i, "huge") for i in range(20_000)] + [(100_000 + i, f"tiny{i % 300}") for i in range(450)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").repartition(4)
    sizes = Counter(s for _, s in rows)
    weighed = spark.createDataFrame([("=" + s, n, float(n) ** 0.8) for s, n in sizes.items()], "mix_key string, n bigint, weight double")
    pool = {r["mix_key"][1:]: r["pool"] for r in pfair_mix.pools(weighed).collect()}
    assert pool["huge"] == "=huge" and len(set(pool.values())) <= 257
    share = Counter()
    for s, n in sizes.items():
        share[pool[s]] += n**0.8
    assert min(share.values()) >= pfair_mix.LEAST * sum(share.values())
    got = pfair_mix.mix(df, block=4).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}
    slots = pooled_deviation(got, pool.get, sizes, 0.8, 4)
    table = spark.createDataFrame([(p, 1, w) for p, w in share.items()], "mix_key string, n bigint, weight double")
    period = pfair_mix.period_for(table)
    k = {r["mix_key"]: r["k"] for r in pfair_mix.blocks_in_period(table, period).collect()}
    assert period <= pfair_mix.MOST_SLOTS and sum(k.values()) == period
    counts = Counter()
    for t in range(len(slots)):
        counts[slots[t]] += 1
        assert all(abs(counts[p] * period - (t + 1) * k[p]) < period for p in k)


def test_ten_thousand_sources_and_shares_of_a_hundred_millionth(spark):
    """Pools alone, as rows of sources: both stay within 1 / LEAST places and a short period, each source in one pool."""
    for sizes in ([5] * 10_000, [10**10, 1], [10**10] + [1] * 5000, [1], [3, 3], list(range(1, 3000))):
        rows = [(f"=s{i}", n, float(n) ** 0.8) for i, n in enumerate(sizes)]
        found = pfair_mix.pools(spark.createDataFrame(rows, "mix_key string, n bigint, weight double")).collect()
        assert sorted(r["mix_key"] for r in found) == sorted(k for k, *_ in rows)
        share, whole = Counter(), sum(w for *_, w in rows)
        for r in found:
            share[r["pool"]] += r["weight"]
        assert min(share.values()) >= pfair_mix.LEAST * whole * 0.999999
        table = spark.createDataFrame([(p, 1, w) for p, w in share.items()], "mix_key string, n bigint, weight double")
        assert pfair_mix.period_for(table) <= pfair_mix.MOST_SLOTS
    began = time.time()
    df = spark.range(10_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"))
    assert pfair_mix.mix(df).agg(F.countDistinct("doc_id")).first()[0] == 10_000
    assert time.time() - began < 60  # of which most is the session's


def test_tiny_given_weights(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(60)], "doc_id bigint, source string")
    with pytest.raises(ValueError, match="weights of 0.00195313 and more are possible"):
        pfair_mix.mix(df, weights={"x": 1.0, "y": 1e-7})


def test_equal_and_null_keys_are_ordered_by_their_rows(spark):
    rows = [(None, "a", f"t{i}") for i in range(300)] + [(7, "a", f"u{i}") for i in range(300)] + [(i, "b", "v") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    one = sorted(map(tuple, pfair_mix.mix(df.repartition(1)).collect()), key=repr)
    assert one == sorted(map(tuple, pfair_mix.mix(df.repartition(5)).collect()), key=repr)
    assert len({r[2] for r in one}) == 601

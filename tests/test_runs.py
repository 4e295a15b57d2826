"""Limits, budgets and tables kept up by streams, against plain loops."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from loomtext.operators import budgets
from loomtext.runtime import ship
from loomtext.streaming import ingest, ledger, limits

M = 1_000_000


def test_limiter_rule():
    """By hand: the third call does not fit by calls, the fifth not by tokens, the sixth never."""
    log, last, got = deque(), 0, []
    for at, tokens in ((0, 10), (1, 10), (2, 10), (70, 50), (71, 60), (72, 101), (200, 100)):
        when = limits.admitted(log, max(at * M, last), tokens, 100, 2, 60 * M, M // 10)
        if when is not None:
            log.append((when, tokens))
            last = when
        got.append(None if when is None else when / M)
    assert got == [0, 1, 60.1, 70, 130.1, None, 200]


def plain_limits(calls, most_tokens, most_calls, window, margin):
    log, last, out = deque(), None, {}
    for call, at, tokens in sorted(calls, key=lambda c: (c[1], c[0])):
        when = limits.admitted(log, at if last is None else max(at, last), tokens, most_tokens, most_calls, window, margin)
        if when is not None:
            log.append((when, tokens))
            last = when
        out[call] = when
    return out


def test_stream_of_calls(spark, tmp_path):
    """Calls come out of order within the lateness over several batches; a null key is a key."""
    ship(spark)
    rng = random.Random(2)
    calls = [(i, rng.choice([1, 1, 2, None]), 1_700_000_000 * M + i * 700_000 + rng.randrange(3) * M, rng.choice([None, 0, 5, 30, 400])) for i in range(500)]
    schema = "call bigint, key bigint, at bigint, tokens bigint"
    for b in range(5):
        spark.createDataFrame(calls[b * 100 : (b + 1) * 100], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{b}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.timestamp_micros("at"))
    rows = limits.admissions(stream, "key", "call", "ts", "tokens", 100, 10, 1.0, 20.0, 0.1, "10 seconds")
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {r["call"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    top = max(c[2] for c in calls) // 1000 - 10_000
    want = {}
    for key in (1, 2, None):
        want |= plain_limits([(c, at, n or 0) for c, k, at, n in calls if k == key and at // 1000 < top], 100, 10, 20 * M, M // 10)
    assert got == want and any(v is None for v in want.values())


def plain_budget(calls, most_tokens, most_calls, window):
    """The rule itself, call by call: what is in the window at the time of asking counts."""
    log, last, out = deque(), 0, []
    for call, at, tokens in calls:
        if at is None or (tokens or 0) > most_tokens or most_calls < 1:
            out.append((call, None))
            continue
        when = limits.admitted(log, max(at, last), tokens or 0, most_tokens, most_calls, window, 0)
        log.append((when, tokens or 0))
        last = when
        out.append((call, when))
    return out


@pytest.mark.parametrize("most_tokens,most_calls,block,span", [(100, 5, 5, 1), (100, 5, 16, 30), (1000, 40, 1, 3), (60, 1000, 1, 2), (100, 1, 1, 0), (100, 0, 4, 5)])
def test_shared_budget(spark, most_tokens, most_calls, block, span):
    """Blocks as short as a window, so that admissions reach over many of them; ties, nulls, calls over the limit."""
    rng = random.Random(most_calls)
    at, calls = 1_700_000_000 * M, []
    for i in range(700):
        at += rng.choice([0, 0, 1, 5]) * span * M // 10
        calls.append((i, at, rng.choice([None, 0, 1, 10, 50, 101])))
    calls += [(900, None, 5), (901, None, None)]
    df = spark.createDataFrame([(c, a, n, "x", 1) for c, a, n in calls], "call int, at bigint, tokens int, note string, admitted int").withColumn("ts", F.timestamp_micros("at")).repartition(5)
    got = budgets.shared_budget(df, "ts", "tokens", ["call"], most_tokens, most_calls, 3.0, block)
    assert got.columns == ["call", "at", "tokens", "note", "ts", "admitted"]
    assert {r["call"]: r["admitted"] for r in got.collect()} == dict(plain_budget(calls, most_tokens, most_calls, 3 * M))


def test_shared_budget_of_no_calls(spark):
    df = spark.createDataFrame([], "call int, ts timestamp, tokens int")
    assert budgets.shared_budget(df, "ts", "tokens", ["call"], 10, 2).collect() == []


# Tables of latest rows --------------------------------------------------------------------------------------------------

SCHEMA = "k string, v int, text string, gone boolean"


def latest(rows):
    best = {}
    for r in rows:
        order = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, bool(x[3]))
        if r[0] not in best or order(r) > order(best[r[0]]):
            best[r[0]] = r
    return sorted(map(repr, (r for r in best.values() if not r[3])))


def table(spark, tmp_path, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ledger.LatestTable(spark, str(tmp_path / "t"), schema, ("k",), "v", "gone", 4, **more)


def test_upserts(spark, tmp_path):
    rng = random.Random(1)
    t, seen = table(spark, tmp_path), []
    assert t.read().collect() == []
    for batch in range(6):
        rows = [(rng.choice([None, "a", "b", "c", "d", "e", "f"]), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "x", "y"]), rng.choice([None, False, False, True])) for _ in range(rng.choice([0, 3, 9]))]
        df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", extra int")
        assert t.upsert(df, batch) and not t.upsert(spark.createDataFrame([("zz", 9, "never", False)], SCHEMA), batch)
        seen += rows
        assert sorted(repr(tuple(r)) for r in t.read().collect()) == latest(seen)
    before = sorted(repr(tuple(r)) for r in t.read().collect())
    assert t.vacuum() > 0 and sorted(repr(tuple(r)) for r in t.read().collect()) == before


def test_half_a_batch_is_not_seen(spark, tmp_path, monkeypatch):
    """The run dies between data and ledger; readers see the state before, and the replay, in other order, gives the right one."""
    t = table(spark, tmp_path)
    t.upsert(spark.createDataFrame([("a", 1, "one", False), ("b", 1, "one", False)], SCHEMA), 0)
    new = [("a", 2, "two", False), ("c", 1, "x", False)]

    def dies(self, batch, buckets):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(ledger.LatestTable, "_enter", dies)
        with pytest.raises(OSError, match="lost"):
            t.upsert(spark.createDataFrame(new, SCHEMA), 1)
    assert {r["k"]: r["v"] for r in t.read().collect()} == {"a": 1, "b": 1}
    t.upsert(spark.createDataFrame(new[::-1], SCHEMA), 1)
    assert {r["k"]: r["v"] for r in t.read().collect()} == {"a": 2, "b": 1, "c": 1}


def test_a_stream_that_is_begun_again(spark, tmp_path):
    rows = [(f"k{i % 7}", i, f"t{i}", False) for i in range(60)]
    for b in range(6):
        spark.createDataFrame(rows[b * 10 : (b + 1) * 10], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{b}"))
    t = table(spark, tmp_path)
    stream = lambda: ingest.arriving(spark, str(tmp_path / "in" / "*"), SCHEMA, files_per_trigger=1)
    calls = []

    def plan(batch):
        calls.append(1)
        if len(calls) in (2, 4):
            raise RuntimeError("lost")
        return batch.withColumn("text", F.upper("text"))

    for _ in range(3):
        try:
            t.follow(stream(), str(tmp_path / "log"), plan).awaitTermination()
        except Exception as e:
            assert "lost" in str(e)
    assert sorted(t.entries()) == list(range(6))
    assert sorted(repr(tuple(r)) for r in t.read().collect()) == latest([(k, v, x.upper(), g) for k, v, x, g in rows])

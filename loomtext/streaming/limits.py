"""Limits on calls as they arrive: when each call of a key is admitted, told from a stream.

The rule is that of a caller who asks before each call: what was admitted within the window before is in use; if the
call's tokens or the call itself do not fit, wait until as much of it has left the window, and a little longer. Calls of a
key wait in one line, so none is admitted before one that came earlier.

The state of a key is two lists: calls that the watermark has not passed yet, which may still be overtaken by earlier
ones, and admissions of the window. A timer in event time at the earliest waiting call takes those in order that the
watermark has passed; one at the end of the window clears the log of a key that has become silent, as lifetimes of state
itself exist in processing time alone.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "call bigint, at bigint, tokens bigint"


def admitted(log: deque, now: int, tokens: int, most_tokens: float, most_calls: int, window: int, margin: int) -> int | None:
    """When a call is admitted that asks at `now`, given the log (at, tokens) in order, which loses what has left the window;
    None if it never fits. Times in microseconds."""
    if tokens > most_tokens or most_calls < 1:
        return None
    while log and log[0][0] <= now - window:
        log.popleft()
    wait = 0
    excess = sum(n for _, n in log) + tokens - most_tokens
    if excess > 0:
        aged = 0
        for at, n in log:
            aged += n
            if aged >= excess:
                wait = at + window + margin - now
                break
    if len(log) >= most_calls:
        wait = max(wait, log[len(log) - most_calls][0] + window + margin - now)
    return now + wait


class Admission(StatefulProcessor):
    """Keys' limiters. Rows in: (key, call, at, tokens), times in microseconds; rows out: with `admitted`, null for calls that
    never fit, which do not hold up others."""

    def __init__(self, most_tokens: float, most_calls: int, window: int, margin: int):
        self.limits = (most_tokens, most_calls, window, margin)
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.log = handle.getListState("log", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(map(int, r)) for frame in rows for r in frame[["call", "at", "tokens"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(at for _, at, _ in new) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(w) for w in self.waiting.get()), key=lambda w: (w[1], w[0]))
        ready = [w for w in waiting if w[1] // 1000 < passed]
        later = waiting[len(ready) :]
        log = deque((at, n) for _, at, n in self.log.get())
        out, last = [], log[-1][0] if log else None
        for call, at, tokens in ready:
            when = admitted(log, at if last is None else max(at, last), tokens, *self.limits)
            if when is not None:
                log.append((when, tokens))
                last = when
            out.append((key[0], call, at, tokens, when))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        ended = (log[-1][0] + self.window) // 1000 + 1 if log else 0
        if log and not waiting and ended <= passed:
            self.log.clear()
        elif ready:
            self.log.put([(0, at, n) for at, n in log]) if log else self.log.clear()
        if later:
            self.handle.registerTimer(later[0][1] // 1000 + 1)
        elif log and ended > passed:
            self.handle.registerTimer(ended)
        yield pd.DataFrame({"key": [o[0] for o in out], "call": [o[1] for o in out], "at": [o[2] for o in out], "tokens": [o[3] for o in out], "admitted": pd.array([o[4] for o in out], "Int64")})

    def close(self) -> None:
        pass


def admissions(stream: DataFrame, key: str, call: str, ts: str, tokens: str, tpm: float, rpm: int, threshold: float = 1.0, window: float = 60.0, margin: float = 0.1, late: str = "5 minutes") -> DataFrame:
    """Calls of a stream as the watermark passes them: (key, call, at, tokens, admitted), times in microseconds.

    Limits are tokens and calls within `window` seconds times `threshold`. Calls with a null key share one limiter; equal
    times are taken by `call`; null tokens count as 0. Calls that come later than `late` are dropped with the watermark.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    micros = lambda s: int(round(s * 1_000_000))
    rows = stream.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(call).cast("bigint").alias("call"), F.unix_micros(ts).alias("at"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"), F.col(ts).alias("ts"))
    processor = Admission(tpm * threshold, int(rpm * threshold), micros(window), micros(margin))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key {kind}, call bigint, at bigint, tokens bigint, admitted bigint", "Append", "EventTime")

"""Rate limits over a stream: a sliding log of each bucket, in event time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .stateful import make_folder, state_store

_OUT = "event_id long, bucket string, wait double, window_requests long, window_tokens long"


class SlidingLog(StatefulProcessor):
    """Admits each bucket's events in order of time and id, as soon as the window before holds few enough requests and tokens.

    Events wait in state until the watermark has passed them, so their order is final; a timer in
    event time wakes the bucket then. What stays is one window of admissions. A limit of 0 is none;
    an event above the limit of tokens never passes and has no wait.
    """

    def __init__(self, requests: int, tokens: int, seconds: int) -> None:
        self.requests, self.tokens, self.span = requests, tokens, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getListState("due", "t long, event_id long, tokens long")
        self.past = handle.getListState("past", "t long, tokens long")

    def _wake(self, times: list[int]) -> None:
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            self.due.appendList([(int(t), int(i), int(n)) for t, i, n in zip(some["t"], some["event_id"], some["tokens"])])
            self._wake(some["t"].astype(int).tolist())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.due.get())
        now = [x for x in waiting if x[0] < final]
        if not now:
            return
        past = deque(self.past.get())
        held, at, out = sum(n for _, n in past), past[-1][0] if past else 0, []
        for t, event_id, n in now:
            if self.tokens and n > self.tokens:
                out.append((event_id, key[0], None, None, None))
                continue
            at = max(at, t)
            while past and (past[0][0] <= at - self.span or self.requests and len(past) >= self.requests or self.tokens and held + n > self.tokens):
                first, own = past.popleft()
                at, held = max(at, first + self.span), held - own
            past.append((at, n))
            held += n
            out.append((event_id, key[0], (at - t) / 1e6, len(past), held))
        later = waiting[len(now) :]
        (self.due.put(later) if later else self.due.clear())
        (self.past.put(list(past)) if past else self.past.clear())
        self._wake([t for t, *_ in later])
        made = pd.DataFrame(out, columns=["event_id", "bucket", "wait", "window_requests", "window_tokens"])
        yield made.astype({"wait": "Float64", "window_requests": "Int64", "window_tokens": "Int64"})

    def close(self) -> None:
        pass


class Trailing:
    """Windows of a sliding log without limits, where each event passes at its own time.

    No event waits for another then, so a bucket's time is cut into chunks, and a state holds every so many-th of them.
    Events (``part``: start of their chunk) come with the end of the chunk before theirs, told by a time before
    ``part``. They stay as one block of numbers, and what the watermark has passed is counted in one go.
    """

    COLUMNS = ["part", "t", "event_id", "tokens", "known"]
    STATE = "block binary, done long"
    #: Windows leave in lists of some thousand: next to states, Spark takes long over single rows.
    OUT = "bucket string, event_id array<long>, requests array<long>, tokens array<long>, known array<long>"
    LIST = 10_000

    def __init__(self, span: int, chunk: int) -> None:
        self.span, self.chunk = span, chunk

    def __call__(self, key, some: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, done = state.get if state.exists else (b"", 0)
        fresh = [] if state.hasTimedOut else [x[self.COLUMNS].to_numpy("int64") for x in some]
        rows = np.concatenate([np.frombuffer(block, "int64").reshape(-1, len(self.COLUMNS)), *fresh])
        final = state.getCurrentWatermarkMs() * 1000
        told = self._told(rows[rows[:, 1] < final], done)
        kept = rows[(rows[:, 1] >= final) | (rows[:, 1] > final - self.span) & (rows[:, 0] + self.chunk > final)]
        if len(kept):
            part, t = kept[:, 0], kept[:, 1]
            state.update((kept.tobytes(), final))
            # next an event is to be told, or a chunk is over
            state.setTimeoutTimestamp(int(np.where((t >= part) & (t >= final), t, part + self.chunk).min()) // 1000)
        elif state.exists:
            state.remove()
        for i in range(0, len(told[0]), self.LIST):
            yield pd.DataFrame([[key[0], *(x[i : i + self.LIST] for x in told)]], columns=["bucket", "event_id", "requests", "tokens", "known"])

    def _told(self, rows: np.ndarray, done: int) -> list[np.ndarray]:
        """Ids, requests, tokens and known tokens of the windows of those events from ``done`` on that are in their own chunk."""
        part, t, event_id, tokens, known = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].T
        # times on one line, chunks further apart than a window
        line = t - part + np.unique(part, return_inverse=True)[1] * (self.chunk + 2 * self.span)
        ends = np.append(np.flatnonzero((np.diff(line) != 0) | (np.diff(event_id) != 0)) + 1, len(line))
        own = np.flatnonzero((t >= part) & (t >= done))
        first, end = np.searchsorted(line, line[own] - self.span, "right"), ends[np.searchsorted(ends, own, "right")]
        within = lambda n: (sums := np.append(0, np.cumsum(n)))[end] - sums[first]
        return [event_id[own], end - first, within(tokens), within(known)]


def _trailing(timed: DataFrame, bucket: str, seconds: int, slots: int) -> DataFrame:
    """``admissions`` without limits: a chunk is four windows long, and its last one also goes to the chunk after it.

    Rows reach this kind of state by the batch, where ``transformWithStateInPandas`` takes each apart.
    """
    span, chunk = seconds * 1_000_000, 4 * seconds * 1_000_000
    t = F.unix_micros("ts")
    start = t - F.pmod(t, F.lit(chunk))
    parts = F.when(t >= start + chunk - span, F.array(start, start + chunk)).otherwise(F.array(start))
    tokens = F.col("tokens").cast("long")
    dealt = timed.where(t.isNotNull()).select(F.col(bucket).alias("bucket"), "ts", t.alias("t"), "event_id", F.coalesce(tokens, F.lit(0)).alias("tokens"), tokens.isNotNull().cast("long").alias("known"), F.explode(parts).alias("part"))
    slot = F.pmod(F.expr(f"part div {chunk}"), F.lit(slots)).alias("slot")
    lists = dealt.select("*", slot).groupBy("bucket", "slot").applyInPandasWithState(Trailing(span, chunk), Trailing.OUT, Trailing.STATE, "append", "EventTimeTimeout")
    told = lists.select("bucket", F.inline(F.arrays_zip("event_id", "requests", "tokens", "known")))
    return told.select("event_id", "bucket", F.lit(0.0).alias("wait"), F.col("requests").alias("window_requests"), F.when(F.col("known") > 0, F.col("tokens")).alias("window_tokens"))


def admissions(log: DataFrame, bucket: str, requests: int = 0, tokens: int = 0, seconds: int = 60, late: str = "0 seconds", slots: int = 16) -> DataFrame:
    """``event_id, bucket, wait, window_requests, window_tokens`` of a stream (ts, event_id, tokens, ``bucket``).

    wait: seconds until a sliding log of the bucket admits the event; window_requests and window_tokens: what the
    ``seconds`` up to its admission hold then, itself included. Without limits that is the trailing window of the event
    itself, and a bucket is dealt out to ``slots`` states by time; with limits it is one state. Buckets, such as a provider
    and profile, are kept apart; rows come when the watermark, ``late`` behind, has passed them, and later ones than that are dropped.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if not requests and not tokens:
        return _trailing(timed, bucket, seconds, slots)
    keyed = timed.select(F.col(bucket).alias("bucket"), "ts", F.unix_micros("ts").alias("t"), "event_id", F.col("tokens").cast("long").alias("tokens"))
    return keyed.groupBy("bucket").transformWithStateInPandas(SlidingLog(requests, tokens, seconds), _OUT, "Append", "EventTime")


def admit(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, bucket: str, **limits) -> None:
    """Run ``admissions`` over the Parquet files of ``source`` that are new since the last start; each batch writes a folder of its own."""
    make_folder(spark, source)
    out = admissions(spark.readStream.schema(schema).parquet(source), bucket, **limits)
    with state_store(spark):
        started = out.writeStream.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()

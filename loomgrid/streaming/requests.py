"""Request batches as a stream, each request asked until it has an answer that is final; live rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.readers import REQUEST
from ..sources.scratch import durable
from .stateful import make_folder, state_store

#: States of a request that are final, and those after which it is asked again.
FINAL, AGAIN = ("success", "fatal_failure"), ("retryable_failure", "pending")


def request_id():
    """Of a request without one: a hash of its content, so inserting one shifts no other."""
    return F.coalesce("request_id", F.sha2(F.to_json(F.struct("max_tokens", "messages", "model_alias", "prompt", "system_prompt", "temperature", "tools", "tool_choice", "thinking_budget_tokens")), 256))


class Asks(StatefulProcessor):
    """When each request is asked: at once if it is new, again after an outcome that isn't final, up to so many times.

    State of a request: how often it was asked, its last status, and its JSON until the
    status is final. With ``wait`` it is asked again that many milliseconds later, by a timer.
    """

    def __init__(self, most: int, wait: int) -> None:
        self.most, self.wait = most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "attempts int, status string, request string")

    def _ask(self, key, attempts: int, request: str) -> pd.DataFrame:
        self.state.update((attempts + 1, "pending", request))
        return pd.DataFrame({"request_id": [key[0]], "request": [request], "attempt": [attempts + 1]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        attempts, status, request = known if known else (0, None, None)
        came, new = [], False
        for some in rows:
            for text, outcome, attempt in zip(some["request"], some["status"], some["attempt"]):
                if pd.notna(outcome):
                    came.append((int(attempt), outcome))
                elif known is None and request is None:
                    request, new = text, True
        if new:
            yield self._ask(key, 0, request)
            return
        if status in FINAL or request is None:
            return
        now = [outcome for attempt, outcome in came if attempt == attempts]  # what is said of earlier attempts is known already
        if not now:
            return
        if any(outcome in FINAL for outcome in now):
            self.state.update((attempts, next(o for o in FINAL if o in now), None))
        elif attempts < self.most and self.wait:
            self.state.update((attempts, "retryable_failure", request))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        elif attempts < self.most:
            yield self._ask(key, attempts, request)
        else:
            self.state.update((attempts, "retryable_failure", None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempts, status, request = self.state.get()
        if status == "retryable_failure" and request is not None:
            yield self._ask(key, attempts, request)

    def close(self) -> None:
        pass


def run_batches(spark: SparkSession, source: str, sink: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], most: int = 3, wait: int = 0) -> StreamingQuery:
    """Answer the requests of JSON files as they come, until each has a final answer or was asked ``most`` times.

    ``answer`` gives a row for each request, with ``request_id`` and, if not all succeed, ``status``. Success and fatal failures
    are final; a request that failed otherwise, or has no row, is asked again at the next start. With ``wait`` the stream
    goes on until it is stopped, and asks again that many milliseconds after it has read of a failure. Spark's checkpoint keeps the place in both sources, requests and answers, and the state of each request.
    A batch writes a folder of its own, so one that was cut short asks again and replaces what it wrote.
    """
    make_folder(spark, sink)
    asked = spark.readStream.schema(REQUEST).json(source).withColumn("request_id", request_id())
    null = F.lit(None)
    new = asked.select("request_id", F.to_json(F.struct(*asked.columns)).alias("request"), null.cast("string").alias("status"), null.cast("int").alias("attempt"))
    said = spark.readStream.schema("request_id string, status string, attempt int").parquet(f"{sink}/*").select("request_id", null.cast("string").alias("request"), "status", "attempt")
    due = new.unionByName(said).groupBy("request_id").transformWithStateInPandas(Asks(most, wait), "request_id string, request string, attempt int", "Append", "ProcessingTime" if wait else "None")

    def batch(df: DataFrame, epoch: int) -> None:
        todo = durable(df.withColumn("r", F.from_json("request", asked.schema)).select("r.*", "attempt"), "due")  # state is worked out once
        told = answer(todo)
        told = told if "status" in told.columns else told.withColumn("status", F.lit("success"))
        rest = [c for c in told.columns if c not in ("request_id", "attempt")]
        # a request without a row in the answer is pending
        met = todo.select("request_id", "attempt").join(told.select("request_id", *rest), "request_id", "left")
        met.withColumn("status", F.coalesce("status", F.lit("pending"))).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    with state_store(spark):
        ready = due.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (ready.trigger(processingTime="1 second") if wait else ready.trigger(availableNow=True)).start()


def rates(events: DataFrame, by: str, seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """Requests and tokens of each bucket in each tumbling window, of a stream or a table with ``ts`` and ``tokens``."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), by).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return out.select(F.col("w.start").alias("since"), by, "requests", "tokens")

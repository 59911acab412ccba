"""Answers kept as they come.

Asking a model is slow and costs money, so a run isn't one job that is lost as a whole.
Its requests are written down in small files, and a stream takes some files at a time:
each batch's answers are committed before the next batch is asked. What breaks off costs
one batch at most; the next run reads what was kept and asks only for the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import delete, find_paths, write_text

#: A run is asked in about so many batches, of so many rows at least.
BATCHES, LEAST_ROWS = 20, 16


class Journal:
    """A folder with the answers of a run that hasn't ended."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self) -> DataFrame | None:
        """All answers kept so far; None if there are none. Of a batch that broke off nothing is read."""
        found = [p.rpartition("/")[0] for p in find_paths(self.spark, f"{self.folder}/answers/*/*/_SUCCESS")]
        return self.spark.read.parquet(*found) if found else None

    def progress(self) -> DataFrame:
        """``run, batch, done, succeeded, total`` as recorded after each batch."""
        return self.spark.read.schema("run string, batch long, done long, succeeded long, total long").json(f"{self.folder}/progress")

    def ask(self, requests: DataFrame, answer: Callable[[DataFrame], DataFrame], on_batch: Callable[[dict], None] | None = None, batches: int = BATCHES, least_rows: int = LEAST_ROWS) -> DataFrame | None:
        """Ask in batches; all answers kept, those of earlier runs included; None if there are none.

        ``answer`` adds columns to requests, ``status`` among them or all count as successes. ``on_batch`` gets the counts
        done, succeeded and total after each batch. What ``answer`` raises ends the run; the batches before it are kept.
        """
        run, tasks = uuid.uuid4().hex, self.spark.sparkContext.defaultParallelism
        plan = f"{self.folder}/asked/{run}"
        requests.write.parquet(f"{plan}-all")
        asked = self.spark.read.schema(requests.schema).parquet(f"{plan}-all")
        total = asked.count()
        if not total:
            return self.read()
        rows = max(least_rows, -(-total // batches))
        asked.repartition(min(tasks, -(-total // rows))).write.option("maxRecordsPerFile", max(1, rows // tasks)).parquet(plan)
        files = max(1, -(-len(find_paths(self.spark, f"{plan}/*.parquet")) * rows // total))
        done = {"done": 0, "succeeded": 0, "total": total}

        def batch(df: DataFrame, epoch: int) -> None:
            made = answer(df)
            path = f"{self.folder}/answers/{run}/{epoch}"
            made.write.mode("overwrite").parquet(path)
            kept = self.spark.read.schema(made.schema).parquet(path)
            won = F.count_if(F.col("status") == "success") if "status" in made.columns else F.count("*")
            n, good = kept.agg(F.count("*"), won).first()
            done.update(done=done["done"] + n, succeeded=done["succeeded"] + good)
            write_text(self.spark, f"{self.folder}/progress/{run}-{epoch:06d}.json", json.dumps({"run": run, "batch": epoch, **done}))
            if on_batch is not None:
                on_batch(dict(done))

        stream = self.spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(plan)
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.folder}/state/{run}").trigger(availableNow=True).start().awaitTermination()
        return self.read()

    def clear(self) -> None:
        """Forget the run: its answers are elsewhere now. The record of its progress stays."""
        for part in ("answers", "asked", "state"):
            delete(self.spark, f"{self.folder}/{part}")

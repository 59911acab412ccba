"""Keyed tables that change by snapshots, bucket by bucket.

Rows lie in buckets of their key's hash. A small numbered file names the folder of each
bucket; the highest whole one is current. A change writes the buckets that it touches beside the old
ones and then creates the next number, which only one writer can. So a reader never sees half
a state, a crash leaves the old one current, and of two writers the second takes up the first one's state.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import named, unused
from ..operators.personas import upsert
from .files import claim, delete, find_paths, modified, read_text
from .scratch import durable

#: Buckets of a new store; numbers that stay at least, and seconds for which older ones stay too.
BUCKETS, KEEP, AGE = 64, 5, 86400.0
_TRIES = 10


class StoreConflict(RuntimeError):
    """Another writer has changed what a change started from."""


class Store:
    """A keyed table with a current snapshot; ``keys`` tell its rows apart."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self._seen: int | None = None

    def _current(self) -> tuple[int, dict | None]:
        """Highest number there is, and the newest whole state."""
        found = find_paths(self.spark, f"{self.folder}/CURRENT-*[0-9]")
        last = int(found[-1].rpartition("-")[2]) if found else 0
        for path in reversed(found):
            try:
                return last, json.loads(read_text(self.spark, path) or "")
            except ValueError:  # its writer was cut off
                continue
        return last, None

    def _rows(self, state: dict, buckets: list[str]) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.folder}/{state['buckets'][b]}" for b in buckets if b in state["buckets"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int) -> Column:
        nulls = [named(k).isNull() for k in self.keys]
        return F.pmod(F.xxhash64(*nulls, *map(named, self.keys)), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, n: int) -> dict[str, str]:
        """Folders of the buckets of ``df``."""
        (bucket,), name = unused(df, "bucket"), f"data-{uuid.uuid4().hex}"
        df.withColumn(bucket, self._bucket(n)).hint("rebalance", bucket).write.partitionBy(bucket).parquet(f"{self.folder}/{name}")
        found = (p.rpartition("/")[2] for p in find_paths(self.spark, f"{self.folder}/{name}/{bucket}=*"))
        return {p.rpartition("=")[2]: f"{name}/{p}" for p in found}

    def _commit(self, last: int, state: dict) -> bool:
        if not claim(self.spark, f"{self.folder}/CURRENT-{last + 1:012d}", json.dumps(state)):
            return False
        self._seen = last + 1
        self.expire()
        return True

    def read(self) -> DataFrame | None:
        self._seen, state = self._current()
        return self._rows(state, sorted(state["buckets"])) if state else None

    def replace(self, df: DataFrame) -> None:
        """A new state as a whole. Where others have written since this store was read or written last, that is a ``StoreConflict``."""
        last, state = self._current()
        seen = last if self._seen is None else self._seen
        if last != seen:
            raise StoreConflict(f"{self.folder} was changed: {last}, read at {seen}")
        n = state["n"] if state else self.buckets
        if not self._commit(last, {"n": n, "schema": df.schema.jsonValue(), "buckets": self._write(df, n)}):
            raise StoreConflict(f"{self.folder} was changed while it was written")

    def update(self, change: Callable[[DataFrame | None], DataFrame]) -> None:
        """The state that ``change`` makes of the current one; again from the newer one, where another writer was first."""
        for _ in range(_TRIES):
            try:
                return self.replace(change(self.read()))
            except StoreConflict:
                continue
        raise StoreConflict(f"{self.folder} changes too often")

    def upsert(self, df: DataFrame) -> None:
        """Rows of ``df`` in place of those with equal keys. Only buckets with such keys are written; two rows of one key are an error.

        Where another writer was first, its buckets are taken up; only if they are the same ones, they are merged again.
        """
        new = durable(df, "upsert")
        if twice := new.groupBy(*map(named, self.keys)).count().where("count > 1").first():
            raise ValueError(f"two rows of one key: {twice}")
        merged = started = touched = None
        for _ in range(_TRIES):
            last, state = self._current()
            if state is None:
                state = {"n": self.buckets, "schema": new.schema.jsonValue(), "buckets": {}}
            if touched is None:
                touched = [str(r[0]) for r in new.select(self._bucket(state["n"])).distinct().collect()]  # a row a bucket at most
            base = {b: state["buckets"].get(b) for b in touched}
            if base != started:
                old = self._rows(state, touched)
                merged, started = self._write(upsert(old, new.select(*map(named, old.columns)), self.keys), state["n"]), base
            if self._commit(last, state | {"buckets": {b: p for b, p in state["buckets"].items() if b not in base} | merged}):
                return
        raise StoreConflict(f"{self.folder} changes too often")

    def expire(self, keep: int = KEEP, age: float = AGE) -> None:
        """States before the newest ``keep`` go once they are ``age`` seconds old, and the folders that none of the others names."""
        found = find_paths(self.spark, f"{self.folder}/CURRENT-*[0-9]")
        gone = [p for p in found[:-keep] if modified(self.spark, p) < time.time() - age]
        if not gone:
            return
        texts = {p: read_text(self.spark, p) or "" for p in found}
        left = "\n".join(t for p, t in texts.items() if p not in gone)
        for path in gone:
            try:
                folders = set(json.loads(texts[path])["buckets"].values())
            except ValueError:
                folders = set()
            for folder in folders:
                if f'"{folder}"' not in left:
                    delete(self.spark, f"{self.folder}/{folder}")
            delete(self.spark, path)

"""The one step that isn't relational: asking a model, behind one batch boundary.

``complete`` runs an injected asynchronous function over the requests of each
partition, several at once. Every failure becomes a row. Retries, waits and limits are
decided by plain functions with injected clock and sleep.
"""

from __future__ import annotations

import asyncio
import contextlib
import math
import random
import time
from collections import deque
from collections.abc import Awaitable, Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import Provider, RateLimit, Retry
from ..functions import retry as rules
from ..functions.text import last_user, mock_reply

RESULT = "content string, status string, error_type string, error_message string, prompt_tokens int, completion_tokens int, total_tokens int, latency_ms double, retry_count int, began_at double, ended_at double"
Ask = Callable[[dict], Awaitable[dict]]


class RateLimitExceeded(RuntimeError):
    """A request that its bucket can't take now, or ever."""


def category_of(message: str, provider: str | None = None) -> str:
    """``retry.category`` for one message, inside a task."""
    low = message.lower()

    def first(table) -> str | None:
        for name, marks in table:
            if any(all(p in low for p in (m if isinstance(m, tuple) else (m,))) for m in marks):
                return name
        return None

    return (first(rules.BY_PROVIDER.get((provider or "").lower(), ())) or first(rules.GENERIC)) or "unknown"


def hint_of(error: BaseException) -> float | None:
    """Seconds that an error, or what caused it, asks to wait."""
    import re

    seen: set[int] = set()
    at: BaseException | None = error
    while at is not None and id(at) not in seen:
        seen.add(id(at))
        headers = getattr(at, "headers", None)
        given = [getattr(at, n, None) for n in ("retry_after_seconds", "retry_after")]
        given += [v for k, v in headers.items() if str(k).lower() == "retry-after"] if isinstance(headers, dict) else []
        given += [m.group(1) for m in (re.search(p, str(at).lower()) for p in rules.HINTS) if m]
        for value in given:
            if value is None or isinstance(value, bool):
                continue
            try:
                seconds = float(value)
            except (TypeError, ValueError):
                continue
            if math.isfinite(seconds):
                return max(0.0, seconds)
        at = at.__cause__
    return None


def root_of(error: BaseException) -> BaseException:
    """What caused an error at first; a call that ran out of time was cancelled because of that, not the other way round."""
    while error.__cause__ is not None and not isinstance(error.__cause__, asyncio.CancelledError):
        error = error.__cause__
    return error


@dataclass(frozen=True)
class Resolution:
    """What follows a failed attempt: an action, seconds to wait, and the status if it ends here."""

    action: str
    wait: float
    terminal_status: str | None


def resolve(attempt: int, error: BaseException, policy: Retry, provider: str | None = None) -> Resolution:
    """A hint decides first; then category and attempts; the root cause is classified."""
    hint = hint_of(error)
    if hint is not None:
        if hint <= policy.max_wait and attempt < max(1, policy.max_hints):
            return Resolution("retry_after_hint", hint, None)
        return Resolution("rate_limited", 0.0, "rate_limited")
    root = root_of(error)
    kind = "timeout" if isinstance(root, TimeoutError) else "network_error" if isinstance(root, ConnectionError) else category_of(str(root), provider)
    if kind in rules.RETRYABLE and attempt < policy.max_retries:
        wait = min(policy.base_delay * policy.factor ** (attempt - 1), policy.max_delay)
        if policy.seed is not None:  # jittered by 0.5 to 1.5 and bounded again
            wait = min(wait * (random.Random(policy.seed * 1_000_003 + attempt).random() + 0.5), policy.max_delay)
        return Resolution("retry_with_backoff", wait, None)
    return Resolution("fail", 0.0, "failed")


class Window:
    """Admission by a sliding log of requests and tokens, per bucket."""

    def __init__(self, limits: dict[str, RateLimit], clock=time.monotonic, sleep=asyncio.sleep, seconds: float = 60.0) -> None:
        self.limits, self.clock, self.sleep, self.seconds = limits, clock, sleep, seconds
        self.past: dict[str, deque] = {}

    def wait_for(self, bucket: str, tokens: int) -> float:
        """Seconds until the bucket takes the request; taking it if 0. Unknown buckets share ``default``."""
        bucket = bucket if bucket in self.limits else "default"
        limit, now = self.limits.get(bucket, RateLimit()), self.clock()
        if limit.tokens_per_minute and tokens > limit.tokens_per_minute:
            raise RateLimitExceeded(f"{tokens} tokens can never pass {limit.tokens_per_minute} a minute")
        past = self.past.setdefault(bucket, deque())
        while past and past[0][0] <= now - self.seconds:
            past.popleft()
        wait = 0.0
        if limit.requests_per_minute and len(past) >= limit.requests_per_minute:
            wait = past[len(past) - limit.requests_per_minute][0] + self.seconds - now
        if limit.tokens_per_minute:
            over = sum(t for _, t in past) + tokens - limit.tokens_per_minute
            for at, t in past:
                if over <= 0:
                    break
                over -= t
                wait = max(wait, at + self.seconds - now)
        if wait <= 0:
            past.append((now, tokens))
        return max(0.0, wait)

    async def acquire(self, bucket: str, tokens: int, wait: bool = True) -> None:
        while (seconds := self.wait_for(bucket, tokens)) > 0:
            if not wait:
                raise RateLimitExceeded(f"{bucket} is full for {seconds:.3f} s")
            await self.sleep(seconds)


async def _one(request: dict, ask: Ask, policy: Retry, window: Window | None, timeout: float, sleep) -> dict:
    began, at, attempt = time.monotonic(), time.time(), 0

    def ended(**rest) -> dict:
        spent = time.monotonic() - began
        return {**rest, "latency_ms": spent * 1000, "retry_count": attempt - 1, "began_at": at, "ended_at": at + spent}

    while True:
        attempt += 1
        try:
            if window is not None and request.get("lease"):
                await window.acquire(request["lease"], int(request.get("tokens") or 0))
            reply = await asyncio.wait_for(ask(request), timeout)
            return ended(**{"status": "success", **reply})
        except Exception as error:  # noqa: BLE001 - whatever a model call raises is a row
            next_ = resolve(attempt, error, policy, request.get("provider"))
            if next_.terminal_status:
                root = root_of(error)
                return ended(status=next_.terminal_status, error_type=type(root).__name__, error_message=str(root) or type(root).__name__)
            await sleep(next_.wait)


def _row_hash(requests: DataFrame, by: str | None = None) -> Column:
    return F.xxhash64(*([by] if by else [c for c in requests.columns if "map<" not in requests.schema[c].dataType.simpleString()]))


def shares(limit: RateLimit, n: int) -> list[RateLimit]:
    """A limit in ``n`` parts that add up to it; those that get one more come first."""

    def parts(x: int) -> list[int]:
        return [x // n + (i < x % n) for i in range(n)]

    return [RateLimit(r, t) for r, t in zip(parts(limit.requests_per_minute), parts(limit.tokens_per_minute))]


def leased(requests: DataFrame, limits: dict[str, RateLimit], tasks: int, providers: dict[str, Provider] | None = None, serial: str | None = None) -> tuple[DataFrame, dict[str, RateLimit]]:
    """Requests (provider, and if there are profile, tokens) dealt out with the column ``lease``, and the limit of each lease.

    A limit is a provider's (``p``), a profile's of it (``p/x``), or ``default`` for all others. It is dealt
    out to as many leases as there are tasks, but to no more than it has requests, nor so many that the
    largest request that it admits would be above a share. So leases add up to the limit exactly, and what the whole limit admits some lease does.
    A lease's requests stand in one task. With ``providers`` the requests also carry ``gate`` and ``width`` (see ``gated``).
    """
    provider = F.coalesce(F.col("provider") if "provider" in requests.columns else F.lit(None).cast("string"), F.lit("default"))
    profile = F.concat_ws("/", provider, "profile") if "profile" in requests.columns else provider
    named = [k for k in limits if k != "default"]
    bucket = F.when(profile.isin(*named), profile).when(provider.isin(*named), provider) if named else F.lit(None).cast("string")
    bucket = F.coalesce(bucket, F.lit("default" if "default" in limits else None).cast("string"))
    tokens = F.coalesce(F.col("tokens"), F.lit(0)) if "tokens" in requests.columns else F.lit(0)
    most = F.lit(None).cast("long")
    for k, x in limits.items():
        most = F.when(bucket == k, F.lit(x.tokens_per_minute)).otherwise(most)
    met = requests.select(bucket.alias("b"), F.when((most == 0) | (tokens <= most), tokens).alias("t")).where("b IS NOT NULL")
    largest = {r["b"]: r["t"] or 0 for r in met.groupBy("b").agg(F.max("t").alias("t")).collect()}  # a row a limit

    def unit(name: str) -> str:
        """A provider with all its limits is dealt out in the same way, so that a request's lease and gate are in one task."""
        return name.split("/")[0]

    n: dict[str, int] = {}
    for k, x in limits.items():
        fit = [tasks, x.requests_per_minute or tasks, x.tokens_per_minute // max(1, largest.get(k, 0)) if x.tokens_per_minute else tasks]
        n[unit(k)] = max(1, min([n.get(unit(k), tasks), *fit]))
    for k, p in (providers or {}).items():
        if p.max_concurrency or p.per_model_concurrency:
            n[k] = min(n.get(k, tasks), p.per_model_concurrency or p.max_concurrency)
    own = F.when(provider.isin(*n), provider).otherwise("default") if n else F.lit("default")
    parts = F.lit(n.get("default", tasks))
    for k, m in n.items():
        parts = F.when(own == k, m).otherwise(parts)
    salt = F.pmod(_row_hash(requests, serial), parts).cast("int")
    limit, key = F.lit(0), F.lit(None).cast("string")
    for name, p in sorted((providers or {}).items()):
        if p.max_concurrency or p.per_model_concurrency:
            limit = F.when(provider == name, p.per_model_concurrency or p.max_concurrency).otherwise(limit)
            key = F.when(provider == name, F.concat_ws("/", F.lit(name), F.col("alias")) if p.per_model_concurrency else F.lit(name)).otherwise(key)
    marked = requests.withColumns({
        "lease": F.when(bucket.isNotNull(), F.concat_ws("#", bucket, salt.cast("string"))),
        "gate": F.when(limit > 0, F.concat_ws("#", key, salt.cast("string"))),
        "width": F.when(limit > 0, F.floor(limit / parts) + F.when(salt < limit % parts, 1).otherwise(0)).cast("int"),
    })
    held = {f"{k}#{i}": x for k, limit_ in limits.items() for i, x in enumerate(shares(limit_, n[unit(k)]))}
    return marked.repartition(tasks, own, salt), held


def gated(requests: DataFrame, providers: dict[str, Provider], tasks: int) -> DataFrame:
    """Requests (provider, alias) dealt out to ``tasks`` tasks with the columns ``gate`` and ``width``.

    A provider's limit, or a model's where models have their own, holds over all tasks: its requests carry at
    most as many gates as the limit, a gate's requests stand in one task, and ``width`` of them run at once, so widths add up to
    the limit. No limit (0) is a null gate.
    """
    limit, key = F.lit(0), F.lit(None).cast("string")
    for name, p in sorted(providers.items()):
        if p.max_concurrency or p.per_model_concurrency:
            own = F.concat_ws("/", F.lit(name), F.col("alias")) if p.per_model_concurrency else F.lit(name)
            limit = F.when(F.col("provider") == name, p.per_model_concurrency or p.max_concurrency).otherwise(limit)
            key = F.when(F.col("provider") == name, own).otherwise(key)
    gates = F.least(limit, F.lit(tasks))
    salt = F.pmod(_row_hash(requests), F.greatest(gates, F.lit(1))).cast("int")
    width = F.when(limit > 0, F.floor(limit / gates) + F.when(salt < limit % gates, 1).otherwise(0)).cast("int")
    dealt = F.coalesce(F.concat_ws("#", key, F.when(key.isNotNull(), salt.cast("string"))), F.lit(""))
    marked = requests.withColumns({"gate": F.when(limit > 0, dealt), "width": width})
    return marked.repartition(tasks, F.coalesce("gate", F.pmod(_row_hash(requests), F.lit(tasks)).cast("string")))


def scheduled(requests: DataFrame, mode: str, by: str = "alias") -> DataFrame:
    """``grouped``: a model's requests follow each other in one task; ``interleaved``: they are mixed with the others."""
    if mode not in ("grouped", "interleaved"):
        raise ValueError(f"unknown schedule {mode}")
    mixed = _row_hash(requests)
    return requests.repartition(by).sortWithinPartitions(by, mixed) if mode == "grouped" else requests.repartition(mixed).sortWithinPartitions(mixed)


def observed(results: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Results that count themselves as they are written: ``done`` and ``succeeded`` in the observation."""
    seen = Observation(name)
    return results.observe(seen, F.count(F.lit(1)).alias("done"), F.count_if(F.col("status") == "success").alias("succeeded")), seen


def complete(
    requests: DataFrame, make_ask: Callable[..., Ask], policy: Retry = Retry(), limits: dict[str, RateLimit] | None = None, workers: int = 8, timeout: float = 120.0, partitions: int | None = None, sleep=asyncio.sleep,
    providers: dict[str, Provider] | None = None, queues: str | None = None, serial: str | None = None,
) -> DataFrame:
    """``requests`` with the columns of ``RESULT``.

    ``make_ask`` is called once per task; its result answers a request (a dict of the
    row) with a dict of content and token counts. ``limits`` hold over all ``partitions`` tasks (see ``leased``). ``providers`` bound what runs at once
    over all tasks (see ``gated``). ``queues`` names a column, a judge's for instance: each of its values has
    ``workers`` of its own and an ask of its own (``make_ask(value)``), and where that can't be made only its rows fail. ``serial`` names a
    column whose values' requests follow each other, one call at a time, while other values' go on beside them; with limits, a value's requests are of one provider.
    """
    names = [c.split()[0] for c in RESULT.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), RESULT])
    own, held = list(requests.columns), {}
    if limits:
        asked, held = leased(requests, limits, partitions or 1, providers, serial)
    elif providers:
        asked = gated(requests, providers, partitions or 1)
    else:
        asked = requests
    if serial:
        asked = (asked if limits else asked.repartition(partitions, serial) if partitions else asked.repartition(serial)).sortWithinPartitions(serial, _row_hash(requests))

    def run(batches):
        asks, window = {}, Window(held, sleep=sleep) if limits else None

        def ask_of(value):
            if value not in asks:
                try:
                    asks[value] = make_ask(value) if queues else make_ask()
                except Exception as error:  # noqa: BLE001 - only this queue's rows fail
                    if not queues:
                        raise

                    async def broken(_, error=error):
                        raise error

                    asks[value] = broken
            return asks[value]

        async def all_of(rows: list[dict]) -> list[dict]:
            turns = {r[serial]: asyncio.Lock() for r in rows} if serial else {}  # taken in the order of asking
            widths = {r["gate"]: int(r["width"]) for r in rows if r.get("gate")} if providers else {}
            gates = {k: asyncio.Semaphore(w) for k, w in widths.items()}
            crews = {r[queues] if queues else None: asyncio.Semaphore(workers) for r in rows}

            async def held(row: dict) -> dict:
                queue = row[queues] if queues else None
                async with turns.get(row[serial] if serial else None, contextlib.nullcontext()), gates.get(row.get("gate") if providers else None, contextlib.nullcontext()), crews[queue]:
                    return await _one(row, ask_of(queue), policy, window, timeout, sleep)

            return await asyncio.gather(*map(held, rows))

        for batch in batches:
            found = asyncio.run(all_of(batch.to_dict("records")))
            made = pd.DataFrame([{n: r.get(n) for n in names} for r in found], columns=names, index=batch.index)
            for n in ("prompt_tokens", "completion_tokens", "total_tokens", "retry_count"):
                made[n] = made[n].astype("Int32")
            yield pd.concat([batch[own], made], axis=1)

    return asked.mapInPandas(run, schema)


def mock_complete(requests: DataFrame, messages: str = "messages") -> DataFrame:
    """The deterministic model: no Python at all."""
    reply = mock_reply(last_user(F.col(messages)))
    return requests.withColumn("r", reply).select("*", "r.*").drop("r").withColumn("status", F.lit("success"))

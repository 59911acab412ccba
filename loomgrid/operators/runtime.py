"""The request log: replay, rate windows, progress, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import columns_of, named, unused
from ..functions.text import redact_log
from ..sources.scratch import durable


def latest(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last event of each key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*events.columns)


def replay(events: DataFrame) -> DataFrame:
    """State of each request of a checkpoint (request_id, status, line_no); an unknown status is an error."""
    known = ("pending", "success", "fatal_failure", "retryable_failure")
    checked = F.when(F.col("status").isin(*known), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status in line "), F.col("line_no").cast("string"))))
    return latest(events.withColumn("status", checked), ["request_id"], "line_no")


def to_resume(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Requests without a final state."""
    return requests.join(state.where("status IN ('success', 'fatal_failure')").select("request_id"), "request_id", "left_anti")


def log_summary(log: DataFrame, by: list[str]) -> DataFrame:
    """Requests, successes, failures, and the time of the last success."""
    won = F.col("status") == "success"
    return log.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(won).alias("successes"), F.count_if(~won).alias("failures"), F.max(F.when(won, F.col("ts"))).alias("last_success"))


def rate_windows(log: DataFrame, bucket: str, seconds: int = 60, chunk_seconds: int = 3600) -> DataFrame:
    """``log`` (ts, tokens, event_id) with requests and tokens of its bucket in the trailing window before and with each.

    The window is half open: what is exactly ``seconds`` old has left. Of requests at
    one instant only those with smaller ids count. Tokens are whole numbers; where a window knows none, its tokens are null.
    A request is two marks, where it comes and where it leaves, and a window is the running sum of marks, so work
    follows the requests, however many a window holds. A bucket's marks are dealt out in chunks of time; a chunk starts from
    what leaves in it and came before it, so a hot bucket spreads over many tasks.
    """
    span, chunk = seconds * 1_000_000, max(seconds, chunk_seconds) * 1_000_000
    key, part, at, step, early, amount = unused(log, "key", "part", "at", "step", "early", "amount")
    start = lambda t: t - F.pmod(t, F.lit(chunk))
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    comes = F.struct(start(t).alias(part), t.alias(at), F.lit(1).alias(step), F.lit(False).alias(early))
    leaves = F.struct(start(t + span).alias(part), (t + span).alias(at), F.lit(-1).alias(step), (start(t + span) > start(t)).alias(early))
    marks = log.where(t.isNotNull()).select("*", F.col(bucket).alias(key), F.inline(F.array(comes, leaves)))
    own = F.col(step) == 1
    signed = F.when(own, F.col("tokens")).otherwise(-F.col("tokens")).alias(amount)
    # of a request that leaves only its time and tokens travel
    dealt = marks.select(*[F.when(own, c).alias(n) for n, c in zip(log.columns, columns_of(log))], key, part, at, step, early, signed)
    ordered = W.partitionBy(key, part).orderBy(at, step, "event_id")
    so_far, whole = ordered.rangeBetween(W.unboundedPreceding, W.currentRow), ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)

    def in_window(value: Column) -> Column:
        carried = -F.coalesce(F.sum(F.when(F.col(early), value)).over(whole), F.lit(0))
        return carried + F.coalesce(F.sum(value).over(so_far), F.lit(0))

    known = in_window(F.when(F.col(amount).isNotNull(), F.col(step)))
    counted = dealt.withColumns({"window_requests": in_window(F.col(step)), "window_tokens": F.when(known > 0, in_window(F.col(amount)))})
    return counted.where(own).drop(key, part, at, step, early, amount)


def rate_violations(windows: DataFrame, requests: int, tokens: int) -> DataFrame:
    """Rows above a limit; a limit of 0 is none."""
    over = F.lit(False)
    if requests:
        over = over | (F.col("window_requests") > requests)
    if tokens:
        over = over | (F.col("window_tokens") > tokens)
    return windows.where(over)


def running(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Rows done so far in each group (``done``), and how many it has (``total``).

    Numbered by ranges over group and order together, so a group's rows spread over many tasks; a
    group begins at its least number, so many small groups are no task's alone either.
    """
    at, group, before, n = unused(log, "at", "group", "before", "n")
    placed = positions(log, [by, *order], at)
    sizes = placed.groupBy(named(by).alias(group)).agg(F.count("*").alias(n), F.min(at).alias(before))
    met = placed.join(sizes, named(by).eqNullSafe(F.col(group)))
    return met.select(*columns_of(log), (F.col(at) - F.col(before) + 1).alias("done"), F.col(n).alias("total"))


def first_n(rows: DataFrame, strata: list[str], n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows of each stratum."""
    return rows.withColumn("rk", F.row_number().over(W.partitionBy(*strata).orderBy(*order))).where(F.col("rk") <= n)


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Rows with their ``position`` from 0 in the given order, nulls first, without one task for all.

    Rows are dealt out in ranges and written down once; numbers inside a range and counts of the
    ranges before it come from what was written, so both see the same ranges. Equal rows are numbered in any order.
    """
    part, local, start, n = unused(rows, "part", "local", "start", "n")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(rows.repartitionByRange(parts, *map(named, order)).withColumn(part, F.spark_partition_id()), "ranges")
    inside = F.row_number().over(W.partitionBy(part).orderBy(*map(named, order))).cast("long")
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    starts = counts.select(part, F.coalesce(F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(start))
    placed = ranged.withColumn(local, inside).join(F.broadcast(starts), part)  # starts: a row a partition
    return placed.select(*columns_of(rows), (F.col(start) + F.col(local) - 1).alias(name))


def look_up(rows: DataFrame, aliases: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with provider and model of their alias; an unknown alias is an error, or null if not ``strict``."""
    joined = rows.join(aliases, "alias", "left")
    if not strict:
        return joined
    return joined.withColumn("provider", F.coalesce("provider", F.raise_error(F.concat(F.lit("unknown model alias: "), F.col("alias"))).cast("string")))


def log_line(row: dict[str, Column]) -> Column:
    """A log entry as JSON: nulls are left out, and so is a retry count of 0."""
    fields = {k: (F.nullif(c, F.lit(0)) if k == "retry_count" else c) for k, c in row.items()}
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def log_rows(results: DataFrame, at: Column | None = None) -> DataFrame:
    """Log entries of answered requests, as columns of the log: secrets are redacted, a retry count of 0 is none."""
    have = set(results.columns)
    take = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    stamp = utc_stamp(F.current_timestamp() if at is None else at)
    kinds = {"provider": "string", "model": "string", "status": "string", "latency_ms": "double"}
    counts = {c: "int" for c in ("prompt_tokens", "completion_tokens", "total_tokens")}
    error = redact_log(F.col("error_message")) if "error_message" in have else F.lit(None)
    again = F.nullif(F.col("retry_count"), F.lit(0)) if "retry_count" in have else F.lit(None)
    return results.select(*[take(c, k) for c, k in kinds.items()], stamp.alias("timestamp"), *[take(c, k) for c, k in counts.items()], take("cost_usd", "double"), take("error_type", "string"), error.cast("string").alias("error_message"), again.cast("int").alias("retry_count"))


def utc_stamp(ts: Column) -> Column:
    """A time as ISO text in UTC to the microsecond."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

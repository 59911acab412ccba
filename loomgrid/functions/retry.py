"""Errors, waits and retry decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import redact_retry, strip

#: Categories in the order they're tried, with the substrings that name them.
GENERIC = (
    ("auth_failure", ("invalid api key", "unauthorized", "authentication", "401", "forbidden", "access denied", "permission", "403")),
    ("invalid_request", ("invalid request", "bad request", "malformed", "400", "missing required", "invalid parameter", "must be")),
    ("rate_limit", ("rate limit", "too many requests", "429")),
    ("timeout", ("timeout",)),
    ("network_error", ("network", "connection", "unreachable", "dns")),
    ("server_error", ("500", "502", "503", "504", "internal server error", "service unavailable", "overloaded", "capacity", "temporarily unavailable")),
)
#: What a provider's own messages mean, tried before the generic rules.
BY_PROVIDER = {
    "openai": (("rate_limit", ("429", "rate limit")), ("auth_failure", ("401", "unauthorized")), ("invalid_request", ("400", "invalid")), ("server_error", ("500", "502", "503"))),
    "anthropic": (("server_error", ("overloaded",)), ("rate_limit", ("rate limit",)), ("invalid_request", (("invalid", "request"), ("invalid", "parameter"))), ("auth_failure", ("401", "authentication"))),
}
#: How messages ask to wait, tried in this order; the group holds the seconds.
HINTS = (r"retry[-_ ]after\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", r"retry\s+in\s+([0-9]+(?:\.[0-9]+)?)\s*(?:s|sec|secs|second|seconds)")
RETRYABLE = ("rate_limit", "timeout", "network_error", "server_error")
#: Defaults of the retry policy.
MAX_RETRIES, BASE_DELAY, MAX_DELAY, FACTOR, MAX_WAIT = 3, 1.0, 60.0, 2.0, 3600.0


def _any(low: Column, marks: tuple) -> Column:
    out = F.lit(False)
    for mark in marks:
        every = F.lit(True)
        for part in mark if isinstance(mark, tuple) else (mark,):
            every = every & low.contains(part)
        out = out | every
    return out


def _first(low: Column, rules: tuple, otherwise: Column) -> Column:
    out = None
    for category, marks in rules:
        hit = _any(low, marks)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(otherwise)


def category(message: Column, provider: Column | None = None) -> Column:
    """Category of an error message; a known provider's rules come before the generic ones."""
    low = F.lower(message)
    generic = _first(low, GENERIC, F.lit("unknown"))
    if provider is None:
        return generic
    out = F.when(F.lower(provider) == "openai", _first(low, BY_PROVIDER["openai"], generic))
    return out.when(F.lower(provider) == "anthropic", _first(low, BY_PROVIDER["anthropic"], generic)).otherwise(generic)


def retryable(of: Column) -> Column:
    return of.isin(*RETRYABLE)


def wait_seconds(text: Column) -> Column:
    """Seconds of a hint: null unless a finite number; a negative one is 0."""
    x = strip(text).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.greatest(F.lit(0.0), x))


def retry_after(message: Column) -> Column:
    """Seconds that an error message asks to wait, or null."""
    low = F.lower(message)
    return F.coalesce(*[wait_seconds(F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))) for pattern in HINTS])


def provider_of(message: Column) -> Column:
    """Provider that an error message names as ``provider='…'``, or null."""
    return F.nullif(F.regexp_extract(message, r"""provider=['"]([^'"]+)['"]""", 1), F.lit(""))


def backoff(attempt: Column, base: float = BASE_DELAY, most: float = MAX_DELAY, factor: float = FACTOR, seed: int | None = None) -> Column:
    """Seconds before the next attempt; with a seed jittered by 0.5 to 1.5 and bounded again."""
    plain = F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(most))
    return plain if seed is None else F.least(plain * (F.rand(seed) + 0.5), F.lit(most))


def decide(attempt: Column, of: Column, hint: Column, max_retries: int = MAX_RETRIES, max_wait: float = MAX_WAIT, max_hints: int | None = None) -> Column:
    """(action, wait, terminal_status) after failed attempt number ``attempt`` of an error category.

    A hint decides first: within ``max_wait`` it is waited for, beyond it the cell ends as
    rate_limited. ``max_retries`` counts calls. ``max_hints`` bounds waiting by hints, as
    nothing else does.
    """
    again = retryable(of) & (attempt < max_retries)

    def out(action: str, wait: Column, status: str | None) -> Column:
        return F.struct(F.lit(action).alias("action"), wait.cast("double").alias("wait"), F.lit(status).cast("string").alias("terminal_status"))

    spent = F.lit(False) if max_hints is None else attempt >= max_hints
    return (
        F.when(hint.isNotNull() & (hint <= max_wait) & ~spent, out("retry_after_hint", F.greatest(hint, F.lit(0.0)), None))
        .when(hint.isNotNull(), out("rate_limited", F.lit(0.0), "rate_limited"))
        .when(again, out("retry_with_backoff", backoff(attempt), None))
        .otherwise(out("fail", F.lit(0.0), "failed"))
    )


def metadata(attempt: Column, of: Column, wait: Column, kind: Column, message: Column) -> Column:
    """What is recorded of a failed attempt."""
    return F.struct(attempt.alias("attempt"), F.lower(of).alias("category"), wait.alias("backoff_seconds"), kind.alias("error_type"), redact_retry(message).alias("error_message"))


def effective_policy(provider: dict | None, default: dict | None) -> dict:
    """Retry settings of a provider: its own, else the defaults, else the built-in ones."""
    builtin = {"max_retries": MAX_RETRIES, "base_delay": BASE_DELAY, "max_delay": MAX_DELAY, "factor": FACTOR}
    return builtin | (default or {}) | (provider or {})

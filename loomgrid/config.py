"""Configuration: providers, aliases, retries, experiments, judges. Wrong values raise where they're set."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from .functions import ids
from .functions.parse import NONE_LABEL

#: Providers that may be configured, and those for tests only.
PROVIDERS = ("openai", "anthropic", "openrouter")
TEST_PROVIDERS = ("mock",)
JUDGE_PROMPT_VERSION = 1


def is_test_only(provider: str) -> bool:
    return provider in TEST_PROVIDERS


def _check(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


@dataclass(frozen=True)
class RateLimit:
    """Requests and tokens a minute; 0 is no limit."""

    requests_per_minute: int = 0
    tokens_per_minute: int = 0

    def __post_init__(self) -> None:
        _check(min(self.requests_per_minute, self.tokens_per_minute) >= 0, "rate limits can't be negative")


@dataclass(frozen=True)
class Retry:
    """``max_retries`` counts calls."""

    max_retries: int = 3
    base_delay: float = 1.0
    max_delay: float = 60.0
    factor: float = 2.0
    max_wait: float = 3600.0
    max_hints: int = 20
    seed: int | None = None

    def __post_init__(self) -> None:
        _check(self.max_retries >= 0 and self.base_delay >= 0 and self.factor >= 1 and self.max_wait >= 0, "retry settings can't be negative")
        _check(self.base_delay <= self.max_delay, "base_delay can't exceed max_delay")

    def with_seed(self, seed: int) -> Retry:
        """The same policy, with waits jittered from ``seed``."""
        return replace(self, seed=seed)

    def over(self, base: Retry | None) -> Retry:
        """An experiment's policy over a provider's: the provider's waits, the experiment's number of calls and wait by hints."""
        return replace(base or Retry(), max_retries=self.max_retries, max_wait=self.max_wait, max_hints=self.max_hints)


@dataclass(frozen=True)
class Provider:
    name: str
    api_key_env: str = ""
    rate_limit: RateLimit | None = None
    retry: Retry | None = None
    base_url: str | None = None
    default_model: str | None = None
    max_concurrency: int = 0
    per_model_concurrency: int = 0

    def __post_init__(self) -> None:
        _check(self.name in PROVIDERS + TEST_PROVIDERS, f"unknown provider {self.name}")
        _check(min(self.max_concurrency, self.per_model_concurrency) >= 0, "concurrency can't be negative")


@dataclass(frozen=True)
class Alias:
    alias: str
    provider: str
    model: str

    def __post_init__(self) -> None:
        _check(bool(self.alias.strip() and self.model.strip()), "an alias needs a name and a model")


@dataclass(frozen=True)
class Inference:
    providers: dict[str, Provider] = field(default_factory=dict)
    default_provider: str | None = None
    model_aliases: dict[str, Alias] = field(default_factory=dict)
    log_path: str | None = None
    checkpoint_path: str | None = None
    default_retry: Retry | None = None

    def __post_init__(self) -> None:
        _check(self.default_provider is None or self.default_provider in self.providers, "the default provider isn't configured")
        for name, p in self.providers.items():
            _check(name == p.name, f"provider {name} is configured as {p.name}")
        for a in self.model_aliases.values():
            _check(a.provider in self.providers, f"alias {a.alias} names provider {a.provider}, which isn't configured")

    def limits(self) -> dict[str, RateLimit]:
        """Rate limits by provider; a provider without one has none."""
        return {name: p.rate_limit for name, p in self.providers.items() if p.rate_limit}

    def retry_of(self, provider: str) -> Retry:
        """A provider's own retry settings, else the default ones."""
        own = self.providers.get(provider)
        return own.retry if own and own.retry else self.default_retry or Retry()


def load(data: dict | None) -> Inference:
    """Configuration from plain data; nothing is an empty configuration."""
    data = dict(data or {})
    made = lambda kind, d: kind(**d) if isinstance(d, dict) else d
    for name, p in (data.get("providers") or {}).items():
        p = {"name": name, **p}
        data["providers"] = {**data["providers"], name: Provider(**{**p, "rate_limit": made(RateLimit, p.get("rate_limit")), "retry": made(Retry, p.get("retry"))})}
    aliases = data.get("model_aliases") or {}
    data["model_aliases"] = {name: Alias(**{"alias": name, **a}) for name, a in aliases.items()}
    data["default_retry"] = made(Retry, data.get("default_retry"))
    return Inference(**{k: v for k, v in data.items() if v is not None})


def load_yaml(text: str) -> Inference:
    import yaml

    data = yaml.safe_load(text)
    _check(data is None or isinstance(data, dict), "a configuration is a mapping")
    return load(data)


def load_file(path: str) -> Inference:
    with open(path, encoding="utf-8") as f:
        return load_yaml(f.read())


def api_key(provider: Provider, env: dict[str, str] | None = None) -> str:
    """A provider's key from the environment, where it is needed; it never becomes a column."""
    if is_test_only(provider.name):
        return "mock"
    value = (os.environ if env is None else env).get(provider.api_key_env, "")
    _check(bool(value), f"environment variable {provider.api_key_env} isn't set")
    return value


@dataclass(frozen=True)
class Judging:
    """What a judgment depends on; ``hash`` ignores where and how it runs. The order of classes counts, that of judges doesn't."""

    experiment_name: str
    judges: tuple[str, ...]
    judge_prompt: str
    classes: tuple[str, ...] | None = None
    max_tokens: int | None = None
    temperature: float | None = None
    thinking_budget_tokens: int | None = None
    include_metadata_in_prompt: bool = False
    timeout_seconds: float = 120.0
    workers: int = 1

    def __post_init__(self) -> None:
        _check(bool(self.experiment_name.strip()), "an experiment needs a name")
        _check(bool(self.judges) and all(j.strip() for j in self.judges), "judges need names")
        _check(bool(self.judge_prompt.strip()), "judges need a prompt")
        for n in (self.max_tokens, self.thinking_budget_tokens):
            _check(n is None or n > 0, "token bounds are positive")
        _check(self.timeout_seconds > 0 and self.workers > 0, "timeout and workers are positive")
        if self.classes is not None:
            _check(bool(self.classes) and all(isinstance(c, str) and c.strip() for c in self.classes), "classes need names")
            _check(len(set(self.classes)) == len(self.classes), "a class is given twice")
            _check(NONE_LABEL not in self.classes, f"{NONE_LABEL} is reserved")

    @property
    def hash(self) -> str:
        return ids.config_hash(
            {
                "judges": sorted(self.judges),
                "judge_prompt": self.judge_prompt,
                "classes": list(self.classes) if self.classes is not None else None,
                "max_tokens": self.max_tokens,
                "temperature": self.temperature,
                "thinking_budget_tokens": self.thinking_budget_tokens,
                "include_metadata_in_prompt": self.include_metadata_in_prompt,
                "judge_prompt_version": JUDGE_PROMPT_VERSION,
            }
        )


Turns = tuple[dict[str, str], ...]


@dataclass(frozen=True)
class Grid:
    """What prompts a grid has: at most one way to give systems, at most one for static turns, one for final messages."""

    model_aliases: tuple[str, ...]
    system_prompt: str | None = None
    system_prompts: tuple[str, ...] | None = None
    system_prompt_by_model: dict[str, str] | None = None
    static_turns: Turns | None = None
    static_turns_list: tuple[Turns, ...] | None = None
    final_user_message: str | None = None
    final_user_messages: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        given = lambda *x: sum(v is not None for v in x)
        _check(given(self.system_prompt, self.system_prompts, self.system_prompt_by_model) <= 1, "systems: one for all, several for all, or one a model")
        _check(given(self.static_turns, self.static_turns_list) <= 1, "static turns: one list for all, or several")
        _check(given(self.final_user_message, self.final_user_messages) == 1, "final messages: exactly one, or several")
        _check(bool(self.model_aliases), "a grid needs models")
        unknown = set(self.system_prompt_by_model or {}) - set(self.model_aliases)
        _check(not unknown, f"system prompts of unknown models: {', '.join(sorted(unknown))}")


@dataclass(frozen=True)
class Experiment:
    """``system_prompt_by_model`` applies when a model is asked and isn't part of a prompt's identity."""

    name: str
    aliases: tuple[str, ...]
    system_prompt: str | None = None
    system_prompt_by_model: dict[str, str] = field(default_factory=dict)
    retry: Retry = field(default_factory=Retry)
    timeout_seconds: float = 120.0
    workers: int = 8

    def __post_init__(self) -> None:
        _check(bool(self.name.strip()), "an experiment needs a name")
        _check(bool(self.aliases) and all(a.strip() for a in self.aliases), "model aliases need names")
        _check(len(set(self.aliases)) == len(self.aliases), "a model alias is given twice")
        _check(not {"prompt_id", "prompt"} & set(self.aliases), "prompt_id and prompt are columns")
        _check(set(self.system_prompt_by_model) <= set(self.aliases), "a system prompt is given for an unknown model")

"""Column expressions over text, messages and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MESSAGES = "array<struct<content:string,role:string>>"

#: Patterns of secrets in log text, in order, with their replacements.
LOG_SECRETS = (
    (r"sk-[a-zA-Z0-9]{10,}", "[REDACTED]"),
    (r"sk-proj-[a-zA-Z0-9]{20,}", "[REDACTED]"),
    (r"sk-ant-[a-zA-Z0-9-]{20,}", "[REDACTED]"),
    (r"Bearer\s+(?:token\s+)?[a-zA-Z0-9_-]{6,}", "Bearer [REDACTED]"),
    (r"\b[a-f0-9]{32,}\b", "[REDACTED]"),
    (r"\b[a-zA-Z0-9]{40,}\b", "[REDACTED]"),
)
#: Patterns of secrets in retry metadata, case-insensitive, in order.
RETRY_SECRETS = (
    (r"(?i)sk-[a-zA-Z0-9]{5,}", "sk-***REDACTED***"),
    (r"""(?i)(api[_-]?key|token|password|secret)["\s:=]+["']?[a-zA-Z0-9_-]{5,}["']?""", "$1: ***REDACTED***"),
)
#: Parts of the names of models that take no system message.
NO_SYSTEM_MODELS = ("gemma", "codegemma")
#: Short JSON escapes.
JSON_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\b": "\\b", "\f": "\\f"}


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Number of white-space separated words (null: 0)."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def redact_log(c: Column) -> Column:
    """Text with the secrets that logs must not hold replaced."""
    for pattern, to in LOG_SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def redact_retry(c: Column) -> Column:
    """Text with the secrets that retry metadata must not hold replaced."""
    for pattern, to in RETRY_SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def ascii_json(c: Column) -> Column:
    """The string as quoted ASCII-only JSON: others as lower-case escapes, above U+FFFF as surrogate pairs."""

    def one(ch: Column) -> Column:
        out = F.when(ch == '"', F.lit(JSON_SHORT['"']))
        for raw, escaped in list(JSON_SHORT.items())[1:]:
            out = out.when(ch == raw, F.lit(escaped))
        return out.when(ch.between(" ", "~"), ch).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", r"\\u$1"))

    plain = F.concat(F.lit('"'), c, F.lit('"'))
    return F.when(c.rlike(r'^[ !#-\[\]-~]*$'), plain).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), one), ""), F.lit('"')))


def placeholders(template: Column) -> Column:
    """Names of the ``<name>`` placeholders, in order, repeats included."""
    return F.transform(F.regexp_extract_all(template, F.lit("<([^>]+)>"), F.lit(1)), lambda x: x)


def missing_keys(template: Column, values: Column) -> Column:
    """Placeholders without a value, once each, sorted."""
    return F.array_sort(F.array_distinct(F.filter(placeholders(template), lambda k: ~F.array_contains(F.map_keys(values), k))))


def render(template: Column, values: Column) -> Column:
    """The template with each ``<name>`` replaced once by its value; a missing value is an error."""
    parts = F.regexp_extract_all(template, F.lit("<[^>]+>|[^<]+|<"), F.lit(0))
    filled = F.transform(parts, lambda p: F.when(p.rlike("^<[^>]+>$"), F.try_element_at(values, F.regexp_extract(p, "^<(.+)>$", 1))).otherwise(p))
    missing = missing_keys(template, values)
    return F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("template keys without a value: "), F.array_join(missing, ", ")))).otherwise(F.array_join(filled, ""))


def message(role: str, content: Column) -> Column:
    return F.struct(content.alias("content"), F.lit(role).alias("role"))


def canonical_messages(system: Column, user: Column, messages: Column | None = None) -> Column:
    """System message, if any, then the messages, or else one user message. Texts are stripped; nothing left is an error."""
    none = F.array().cast(MESSAGES)
    first = F.when(F.coalesce(strip(system), F.lit("")) != "", F.array(message("system", strip(system)))).otherwise(none)
    turn = F.when(F.coalesce(strip(user), F.lit("")) != "", F.array(message("user", strip(user)))).otherwise(none)
    rest = turn if messages is None else F.when(F.size(F.coalesce(messages, none)) > 0, messages.cast(MESSAGES)).otherwise(turn)
    return F.when(F.size(rest) == 0, F.raise_error(F.lit("a prompt needs a user text or messages"))).otherwise(F.concat(first, rest))


def closed(text: Column, tag: str) -> Column:
    """Text that can't close the block ``tag`` it stands in."""
    return F.replace(text, F.lit(f"</{tag}>"), F.lit(f"</ {tag}>"))


def transcript(messages: Column) -> Column:
    """A chat as labelled turns in one block, system turns left out."""
    role = lambda m: F.lower(strip(F.coalesce(m.role, F.lit(""))))
    turns = F.transform(F.filter(messages, lambda m: role(m) != "system"), lambda m: F.concat(F.lit('<turn role="'), role(m), F.lit('">'), closed(F.coalesce(m.content, F.lit("")), "turn"), F.lit("</turn>")))
    return F.concat(F.lit("<conversation>\n"), F.concat_ws("", F.transform(turns, lambda t: F.concat(t, F.lit("\n")))), F.lit("</conversation>"))


def class_block(classes: list[str], none_label: str) -> str:
    """What a judge is told of the labels: the last line holds one tag with one exact label, or the label for none."""
    allowed = "\n".join(f"* {c}" for c in classes)
    return f"LABELS\n{allowed}\n\nLast line of the reply, once and alone:\n<final_answer>one of the labels, letter for letter</final_answer>\nIf none applies: <final_answer>{none_label}</final_answer>"


#: Sentences of a judge's user message.
ABOUT_TALK = "You are evaluating the following conversation:"
ABOUT_TEXT = "You are evaluating the following content:"
CLOSING = "Provide your evaluation."
#: Our own closing sentence where there are labels.
CLOSING_LABELLED = "Answer as the LABELS section says."


def judge_messages(prompt: str, classes: list[str] | None, content: Column, messages: Column, metadata: Column | None = None, none_label: str = "__NONE__") -> Column:
    """System and user message of one judge call about a content or a conversation."""
    system = prompt.strip() + ("\n\n" + class_block(classes, none_label) if classes else "")
    talk = F.concat(F.lit(ABOUT_TALK + "\n"), transcript(messages))
    text = F.concat(F.lit(ABOUT_TEXT + "\n<content>\n"), closed(content, "content"), F.lit("\n</content>"))
    body = F.when(F.size(F.coalesce(messages, F.array().cast(MESSAGES))) > 0, talk).when(content.isNotNull(), text).otherwise(F.raise_error(F.lit("a subject needs content or messages")))
    if metadata is not None:
        lines = F.transform(F.map_entries(metadata), lambda e: F.concat(closed(e.key, "metadata"), F.lit(": "), closed(F.coalesce(e.value, F.lit("None")), "metadata")))
        body = F.when(F.size(F.coalesce(metadata, F.create_map().cast("map<string,string>"))) > 0, F.concat(body, F.lit("\n\n<metadata>\n"), F.array_join(lines, "\n"), F.lit("\n</metadata>"))).otherwise(body)
    return F.array(message("system", F.lit(system)), message("user", F.concat(body, F.lit("\n\n" + (CLOSING_LABELLED if classes else CLOSING)))))


def takes_no_system(model: Column) -> Column:
    low = F.lower(model)
    out = F.lit(False)
    for name in NO_SYSTEM_MODELS:
        out = out | low.contains(name)
    return out


def fold_system(messages: Column, model: Column) -> Column:
    """Messages for ``model``: where it takes no system message, that text leads the first user message."""
    systems = F.filter(messages, lambda m: (m.role == "system") & m.content.isNotNull())
    rest = F.filter(messages, lambda m: ~((F.coalesce(m.role, F.lit("")) == "system") & m.content.isNotNull()))
    lead = F.array_join(F.transform(systems, lambda m: m.content), "\n\n")
    first = F.array_position(F.transform(rest, lambda m: F.coalesce(m.role, F.lit(""))), F.lit("user")) - 1
    led = F.transform(rest, lambda m, i: F.when(i == first, message("user", F.concat(lead, F.lit("\n\n"), F.coalesce(m.content, F.lit(""))))).otherwise(m))
    folded = F.when(first >= 0, led).otherwise(F.concat(F.array(message("user", strip(lead))), rest))
    return F.when(takes_no_system(model) & (F.size(systems) > 0), folded).otherwise(messages)


def folded(messages: Column, model: Column) -> Column:
    """What is recorded of a folded system text: (system_prompt_folded, system_prompt); null where nothing was folded."""
    systems = F.filter(messages, lambda m: (m.role == "system") & m.content.isNotNull())
    lead = F.array_join(F.transform(systems, lambda m: m.content), "\n\n")
    return F.when(takes_no_system(model) & (F.size(systems) > 0), F.struct(F.lit(True).alias("system_prompt_folded"), lead.alias("system_prompt")))


def with_system(messages: Column, system: Column) -> Column:
    """Messages led by another system text in place of their own; as they are where it is null."""
    rest = F.filter(messages, lambda m: F.coalesce(m.role, F.lit("")) != "system")
    return F.when(system.isNull(), messages.cast(MESSAGES)).otherwise(F.concat(F.array(message("system", strip(system))), rest.cast(MESSAGES)))


def provider_request(messages: Column, model: Column, max_tokens: Column, temperature: Column, tools: Column, tool_choice: Column, thinking: Column) -> Column:
    """A provider's request as JSON, nulls left out; ``tools`` and ``tool_choice`` are JSON texts, ``thinking`` a token budget that counts above 0."""
    plain = F.to_json(F.struct(max_tokens.alias("max_tokens"), messages.cast(MESSAGES).alias("messages"), model.alias("model"), temperature.alias("temperature")))
    budget = F.when(thinking > 0, F.concat(F.lit(',"thinking":{"budget_tokens":'), thinking.cast("string"), F.lit(',"type":"enabled"}')))
    more = [F.concat(F.lit(f',"{name}":'), F.to_json(F.parse_json(c))) for name, c in (("tool_choice", tool_choice), ("tools", tools))]
    return F.concat(F.left(plain, F.length(plain) - 1), F.coalesce(budget, F.lit("")), *[F.coalesce(c, F.lit("")) for c in more], F.lit("}"))


#: Widths of a console line's time, provider, model, status, latency and progress.
CONSOLE_WIDTHS = (20, 12, 26, 8, 8, 8)


def fitted(c: Column, width: int) -> Column:
    """Text of at most ``width`` characters; a longer one ends in two dots."""
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.left(c, F.lit(width - 2)), F.lit("..")))


def console_line(ts: Column, provider: Column, model: Column, status: Column, latency_ms: Column, done: Column, total: Column) -> Column:
    """One line of fixed-width columns about an answered request; the last two stand right."""
    shown = [F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), provider, model, status]
    left = [F.rpad(fitted(c, w), w, " ") for c, w in zip(shown, CONSOLE_WIDTHS)]
    latency = F.coalesce(F.format_string("%.2fs", latency_ms / 1000), F.lit("-"))
    latency = F.when(latency_ms.isNull(), "-").otherwise(latency)
    progress = F.concat(F.lit("("), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(")"))
    right = [F.when(F.length(c) < w, F.lpad(c, w, " ")).otherwise(c) for c, w in zip((latency, progress), CONSOLE_WIDTHS[4:])]
    return F.concat_ws(" ", *left, *right)


def elapsed(seconds: Column) -> Column:
    """Seconds as 12ms, 3.4s or 5m06s."""
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"), F.lpad(F.floor(seconds % 60).cast("string"), 2, "0"), F.lit("s"))
    return F.when(seconds < 1, F.format_string("%.0fms", seconds * 1000)).when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(minutes)


def model_string(provider: Column, model: Column) -> Column:
    """The model's name led by its provider's, once."""
    lead = F.concat(provider, F.lit("/"))
    return F.when(F.startswith(model, lead), model).otherwise(F.concat(lead, model))


def token_estimate(messages: Column, max_tokens: Column | None = None) -> Column:
    """Words of all messages plus the reply's bound."""
    n = F.aggregate(messages, F.lit(0), lambda acc, m: acc + words(m.content))
    return n + (F.coalesce(max_tokens, F.lit(0)) if max_tokens is not None else F.lit(0))


def last_user(messages: Column) -> Column:
    """Content of the last user message, or the empty text."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m.role == "user"), F.lit(-1)).content, F.lit(""))


def mock_reply(prompt: Column, system: Column | None = None) -> Column:
    """The deterministic completion: reply text and its token counts."""
    n = words(prompt) + (words(system) if system is not None else F.lit(0))
    return F.struct(F.concat(F.lit("mock-response:"), prompt).alias("content"), n.alias("prompt_tokens"), F.lit(1).alias("completion_tokens"), (n + 1).alias("total_tokens"))


def pick_option(text: Column, options: list[str]) -> Column:
    """First option equal to the text, else first one inside it, ignoring case; else the text."""
    low = F.lower(strip(text))
    all_ = F.array(*[F.lit(o) for o in options])
    equal = F.try_element_at(F.filter(all_, lambda o: F.lower(o) == low), F.lit(1))
    inside = F.try_element_at(F.filter(all_, lambda o: F.contains(low, F.lower(o))), F.lit(1))
    return F.coalesce(equal, inside, strip(text))

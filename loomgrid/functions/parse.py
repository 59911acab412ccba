"""Strict readers of judge replies and matrix cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

NONE_LABEL = "__NONE__"
ANSWER = r"(?is)<\s*final_answer\s*>(.*?)<\s*/\s*final_answer\s*>"
#: What a cell's status may be.
CELL_STATUSES = ("success", "failed", "rate_limited", "not_requested", "pending", "retrying")
#: Cells without a value, told at their first sign.
BLANK, MISSING = r"(?U)\A\s*\z", r"(?U)\A\s*(?:__missing__)?\s*\z"
CELL = "struct<status:string,response:string,error_message:string,metadata:string>"


def final_answer(raw: Column, classes: list[str] | None) -> Column:
    """(final_class, none_declared, sentinel_found, sentinel_raw, parse_status) of a reply.

    The last tag counts and must end the reply; its stripped content must equal a
    class exactly, or the label for none.
    """

    def outcome(label: Column, none: bool, found: bool, inner: Column, status: str) -> Column:
        return F.struct(label.cast("string").alias("final_class"), F.lit(none).alias("none_declared"), F.lit(found).alias("sentinel_found"), inner.cast("string").alias("sentinel_raw"), F.lit(status).alias("parse_status"))

    null = F.lit(None)
    if classes is None:
        return outcome(null, False, False, null, "free_form")
    whole = F.try_element_at(F.regexp_extract_all(raw, F.lit(ANSWER), F.lit(0)), F.lit(-1))
    inner = strip(F.try_element_at(F.regexp_extract_all(raw, F.lit(ANSWER), F.lit(1)), F.lit(-1)))
    return (
        F.when(whole.isNull(), outcome(null, False, False, null, "missing_sentinel"))
        .when(~F.endswith(raw, whole), outcome(null, False, True, null, "unmatched"))
        .when(inner == NONE_LABEL, outcome(null, True, True, inner, "none_declared"))
        .when(inner.isin(*classes) if classes else F.lit(False), outcome(inner, False, True, inner, "matched"))
        .otherwise(outcome(null, False, True, inner, "unmatched"))
    )


def verdict_status(parse_status: Column, failed: Column) -> Column:
    """Status of a judgment: call_failed, success or classification_failed."""
    return F.when(failed, "call_failed").when(parse_status.isin("free_form", "matched", "none_declared"), "success").otherwise("classification_failed")


def encode_cell(status: Column, response: Column, error: Column, metadata: Column | None = None) -> Column:
    """A cell's JSON; null fields are left out, and so is empty metadata. Keys are sorted."""
    fields = [error.alias("error_message")]
    if metadata is not None:
        fields.append(F.when(F.size(F.coalesce(metadata, F.create_map().cast("map<string,string>"))) > 0, metadata).alias("metadata"))
    return F.to_json(F.struct(*fields, response.alias("response"), status.alias("status")))


def _once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)``, with ``value`` worked out once for a row however often it is used: as the element of an array of one."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def worked_out(value: Column) -> Column:
    """``value`` as the generated column of a row, so what is made of it later doesn't repeat its work."""
    return F.explode(F.array(value))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _text_of(v: Column, path: str) -> Column:
    """A field as text: a string as it is, anything else but null as JSON."""
    return _once(F.try_variant_get(v, path, "variant"), lambda got: F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(got, "$", "string")).when(got.isNotNull() & ~F.is_variant_null(got), F.to_json(got)))


def decode_cell(text: Column) -> Column:
    """The cell (``CELL``) of its JSON; a blank is null, anything malformed or of unknown status an error. A cell is parsed once."""

    def cell(v: Column) -> Column:
        status, meta = F.try_variant_get(v, "$.status", "string"), F.try_variant_get(v, "$.metadata", "variant")
        made = F.struct(status.alias("status"), _text_of(v, "$.response").alias("response"), _text_of(v, "$.error_message").alias("error_message"), F.when(_is_object(meta), F.to_json(meta)).alias("metadata"))
        error = lambda what: F.raise_error(F.concat(F.lit(what), F.lit(": "), text)).cast(CELL)
        return F.when(~_is_object(v), error("a cell must be a JSON object")).when(~F.coalesce(status.isin(*CELL_STATUSES), F.lit(False)), error("a cell has an unknown status")).otherwise(made)

    return F.when(F.coalesce(text, F.lit("")).rlike(BLANK), F.lit(None).cast(CELL)).otherwise(_once(F.try_parse_json(text), cell))


def lenient_cell(text: Column) -> Column:
    """As ``decode_cell``, but blanks, ``__missing__`` and anything unreadable are null."""

    def cell(v: Column) -> Column:
        made = F.struct(F.try_variant_get(v, "$.status", "string").alias("status"), _text_of(v, "$.response").alias("response"), _text_of(v, "$.error_message").alias("error_message"), F.lit(None).cast("string").alias("metadata"))
        return F.when(_is_object(v), made)

    return F.when(~text.rlike(MISSING), _once(F.try_parse_json(text), cell))


def response_text(v: Column) -> Column:
    """Content of a provider's reply (JSON text): a string, joined parts, or the ``text`` fallback; else empty."""
    j = F.try_parse_json(v)
    content = F.try_variant_get(j, "$.choices[0].message.content", "variant")
    parts = F.from_json(F.to_json(content), "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), "")
    return F.when(F.schema_of_variant(content).startswith("ARRAY"), joined).otherwise(F.coalesce(F.try_variant_get(j, "$.choices[0].message.content", "string"), F.try_variant_get(j, "$.choices[0].text", "string"), F.lit("")))


def response_usage(v: Column) -> Column:
    """(prompt_tokens, completion_tokens, total_tokens) of a provider's reply."""
    j = F.try_parse_json(v)
    return F.struct(*[F.try_variant_get(j, f"$.usage.{k}", "int").alias(k) for k in ("prompt_tokens", "completion_tokens", "total_tokens")])


def response_tool_calls(v: Column) -> Column:
    """Tool calls of a provider's reply as JSON text; null unless they are a list."""
    calls = F.try_variant_get(F.try_parse_json(v), "$.choices[0].message.tool_calls", "variant")
    return F.when(F.schema_of_variant(calls).startswith("ARRAY"), F.to_json(calls))


def cell_status(ended: Column) -> Column:
    """A finished run's status as the matrix writes it: success, rate_limited and not_requested as they are, all else failed."""
    return F.when(ended.isin("success", "rate_limited", "not_requested"), ended).otherwise("failed")

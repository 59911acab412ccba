"""Content-derived identities, equal byte for byte wherever they're computed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MESSAGES, ascii_json, strip


def _low_escapes(c: Column) -> Column:
    """JSON text whose escapes of control characters have lower-case digits."""
    fixed = F.regexp_replace(c, r"\\u001([A-F])", r"\\u001\$\{$1\}")
    for digit in "ABCDEF":
        fixed = F.replace(fixed, F.lit("\\u001${" + digit + "}"), F.lit("\\u001" + digit.lower()))
        fixed = F.replace(fixed, F.lit("\\u000" + digit), F.lit("\\u000" + digit.lower()))
    return F.when(c.contains("\\u00"), fixed).otherwise(c)


def canonical_prompt(messages: Column) -> Column:
    """A prompt as compact JSON with sorted keys."""
    return _low_escapes(F.to_json(F.struct(messages.cast(MESSAGES).alias("messages"))))


def prompt_id(messages: Column) -> Column:
    return F.sha2(canonical_prompt(messages), 256)


def cell_id(prompt: Column, alias: Column) -> Column:
    return F.sha2(F.concat(prompt, F.lit("\x1f"), strip(alias)), 256)


def _object(entries: Column) -> Column:
    """A JSON object with spaced separators and ASCII strings, of (key, value) entries sorted by key."""
    pairs = F.transform(F.array_sort(entries), lambda e: F.concat(ascii_json(e["key"]), F.lit(": "), ascii_json(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def combination_json(dimension: Column, value: Column, indicators: Column) -> Column:
    return F.concat(F.lit('{"dimension": '), ascii_json(dimension), F.lit(', "dimension_value": '), ascii_json(value), F.lit(', "indicators": '), _object(F.map_entries(indicators)), F.lit("}"))


def combination_id(dimension: Column, value: Column, indicators: Column) -> Column:
    return F.sha2(combination_json(dimension, value, indicators), 256)


def history_id(ids: Column) -> Column:
    """Of a map from dimension to combination id."""
    return F.sha2(_object(F.map_entries(ids)), 256)


def judgment_id(subject: Column, model: Column, judge: Column, config: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", subject, F.coalesce(model, F.lit("")), judge, config), 256), 1, 24)


def subject_id(position: Column, record: Column) -> Column:
    """Of a record (struct) at a row position, counted from 0; its JSON has spaced separators and sorted keys."""
    return F.substring(F.sha2(F.concat(F.lit('{"i": '), position.cast("string"), F.lit(', "rec": '), record, F.lit("}")), 256), 1, 16)


def spaced_json(fields: dict[str, Column]) -> Column:
    """String fields as a JSON object with sorted keys and spaced separators, non-ASCII kept, nulls written."""
    parts = []
    for key in sorted(fields):
        inner = F.to_json(F.struct(fields[key].alias("v")))
        text = F.when(fields[key].isNull(), F.lit("null")).otherwise(F.regexp_replace(inner, r'^\{"v":|\}$', ""))
        parts.append(F.concat(F.lit(json.dumps(key, ensure_ascii=False) + ": "), text))
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(", "), p)
    return F.concat(F.lit("{"), joined, F.lit("}"))


def config_hash(fields: dict) -> str:
    """Of a judge configuration's meaning: a driver-side scalar over canonical JSON."""
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

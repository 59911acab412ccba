"""Readers of the engine's files. Paths are Spark paths: any store that Spark reads."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import decode_cell, worked_out
from ..functions.text import strip
from ..operators import runtime
from .files import find_paths

TURN = "struct<content:string,role:string>"
BACKGROUND = f"schema_version int, dimension string, dimension_value string, combination_id string, indicators map<string,string>, model_alias string, messages array<{TURN}>, generated_at string"
HISTORY = f"history_id string, persona map<string,string>, combination_ids map<string,string>, messages array<{TURN}>, generated_at string"
CHECKPOINT = "request_id string, status string, timestamp string, error_message string, result string"
LOG = "provider string, model string, status string, latency_ms double, timestamp string, prompt_tokens int, completion_tokens int, total_tokens int, cost_usd double, error_type string, error_message string, retry_count int"
REQUEST = f"request_id string, model_alias string, prompt string, system_prompt string, messages array<{TURN}>, max_tokens int, temperature double, tools string, tool_choice string, thinking_budget_tokens int"
#: Columns of the judgments file, in order.
JUDGMENT_COLUMNS = (
    "judgment_id",
    "subject_id",
    "source_id",
    "prompt_id",
    "subject_model_alias",
    "judge_alias",
    "judge_config_hash",
    "status",
    "raw_output",
    "final_class",
    "none_declared",
    "parse_status",
    "error_message",
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "latency_ms",
    "retry_count",
    "started_at",
    "completed_at",
    "metadata",
)
JUDGMENT_STATUSES = ("success", "classification_failed", "call_failed")


class CorruptFile(ValueError):
    """A file that doesn't hold what it must."""


def _csv(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    return spark.read.options(header=True, multiLine=True, quote='"', escape='"', **options).csv(path)


def place(name: str) -> Column:
    """Where a row stands: file by name, block of the file, row. Spark reads larger files first, so row numbers alone don't follow the files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias(name)


def mapping(spark: SparkSession, path: str, dimension: str) -> DataFrame:
    """A dimension's long CSV: ``dimension, dimension_value, indicator_name, indicator_value, pos``."""
    raw = _csv(spark, path)
    named = raw.toDF(*[re.sub(r"\s+", "_", c.lstrip("﻿").strip()).lower() for c in raw.columns])
    columns = ("dimension_value", "indicator_name", "indicator_value")
    if missing := [c for c in columns if c not in named.columns]:
        raise CorruptFile(f"{path} lacks {', '.join(missing)}")
    placed = named.select(*[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns], place("pos"))
    return placed.select(F.lit(dimension).alias("dimension"), *columns, "pos")


def names(spark: SparkSession, path: str) -> DataFrame:
    """``name, gender`` of a CSV, the last row of a name; an absent file gives no rows."""
    if not find_paths(spark, path):
        return spark.createDataFrame([], "name string, gender string")
    raw = _csv(spark, path).select(strip(F.col("Name")).alias("name"), strip(F.col("Gender")).alias("gender"), place("pos"))
    return raw.groupBy("name").agg(F.max_by("gender", "pos").alias("gender"))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """``dim, template, ord`` of a JSON object."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(json.loads(text).items())], "dim string, template string, ord int")


def _json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def backgrounds(spark: SparkSession, path: str) -> DataFrame:
    """Background records; unreadable lines and those that lack a key are left out. ``pos`` follows file and line."""
    raw = _json_lines(spark, path, BACKGROUND)
    good = raw.where("_corrupt IS NULL AND dimension IS NOT NULL AND dimension_value IS NOT NULL AND combination_id <> '' AND messages IS NOT NULL")
    return good.drop("_corrupt").withColumn("schema_version", F.coalesce("schema_version", F.lit(1))).select("*", place("pos"))


def existing_ids(spark: SparkSession, path: str, column: str = "combination_id") -> DataFrame:
    """Ids that JSON lines hold already; unreadable lines are passed over."""
    raw = _json_lines(spark, path, f"{column} string") if find_paths(spark, path) else spark.createDataFrame([], f"{column} string")
    return raw.where(F.coalesce(column, F.lit("")) != "").select(column).distinct()


def histories(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, HISTORY).where("_corrupt IS NULL AND history_id IS NOT NULL").drop("_corrupt")


def requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The sparse request log, with ``ts`` read from either spelling."""
    return spark.read.schema(LOG).json(path).withColumn("ts", F.to_timestamp("timestamp"))


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """State of each request; an unreadable line or an unknown status is an error."""
    raw = _json_lines(spark, path, CHECKPOINT).select("*", place("line_no"))
    strict = F.when(F.col("_corrupt").isNotNull() | F.col("request_id").isNull(), F.raise_error(F.concat(F.lit("corrupt checkpoint line "), F.col("line_no").cast("string"))).cast("string")).otherwise(F.col("request_id"))
    return runtime.replay(raw.withColumn("request_id", strict).select("request_id", "status", "timestamp", "error_message", "line_no"))


def _wide(spark: SparkSession, path: str, aliases: list[str] | None) -> tuple[DataFrame, list[str]]:
    """Rows of a wide matrix CSV and the aliases in its header; other ones than ``aliases`` are an error."""
    raw = _csv(spark, path)
    if raw.columns[:1] != ["prompt_id"] or "prompt" not in raw.columns:
        raise CorruptFile(f"{path} must start with prompt_id and have a prompt column")
    have = [c for c in raw.columns if c not in ("prompt_id", "prompt")]
    if aliases is not None and have != list(aliases):
        raise CorruptFile(f"{path} has the models {', '.join(have)}; wanted are {', '.join(aliases)}")
    return raw, have


def matrix_prompts(spark: SparkSession, path: str, aliases: list[str]) -> DataFrame:
    """``prompt_id, prompt, position`` of an existing matrix of just these aliases, in the order of the file; an id that stands twice is an error.

    Numbered by ranges of places in the files, so no task sees all of them.
    """
    raw, _ = _wide(spark, path, aliases)
    placed = runtime.positions(raw.select(F.coalesce("prompt_id", F.lit("")).alias("prompt_id"), "prompt", place("place")), ["place"])
    times = placed.groupBy("prompt_id").agg(F.count("*").alias("times"))
    once = F.when((F.col("times") == 1) & (F.col("prompt_id") != ""), F.col("prompt_id")).otherwise(F.raise_error(F.concat(F.lit("the matrix has no or two rows of the id "), F.col("prompt_id"))).cast("string"))
    return placed.join(times, "prompt_id").select(once.alias("prompt_id"), "prompt", "position")


def matrix(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Cells of a wide matrix CSV in long form; anything malformed is an error, and so is a header of other aliases than those ``wanted``."""
    raw, aliases = _wide(spark, path, wanted)
    long = raw.unpivot(["prompt_id", "prompt"], [F.col(f"`{a}`") for a in aliases], "alias", "cell")
    return long.withColumn("c", worked_out(decode_cell(F.col("cell")))).select("prompt_id", "prompt", "alias", "c.*")


def done_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of a matrix that succeeded; none where there is no file."""
    if not find_paths(spark, path):
        return spark.createDataFrame([], "prompt_id string, alias string")
    return matrix(spark, path).where("status = 'success'").select("prompt_id", "alias")


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """The judgments CSV with its types; a missing column or an unknown status is an error; rows without id are left out."""
    raw = _csv(spark, path, nullValue="", emptyValue="")
    if missing := [c for c in JUDGMENT_COLUMNS if c not in raw.columns]:
        raise CorruptFile(f"{path} lacks {', '.join(missing)}")
    status = F.when(F.col("status").isin(*JUDGMENT_STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown judgment status: "), F.coalesce("status", F.lit("")))).cast("string"))
    typed = {c: F.nullif(F.col(c), F.lit("")).try_cast("int") for c in ("prompt_tokens", "completion_tokens", "total_tokens", "retry_count")}
    typed |= {"status": status, "latency_ms": F.nullif("latency_ms", F.lit("")).try_cast("double"), "none_declared": F.coalesce(F.lower("none_declared") == "true", F.lit(False)), "metadata": F.from_json("metadata", "map<string,string>")}
    typed |= {c: F.nullif(c, F.lit("")) for c in ("source_id", "prompt_id", "subject_model_alias", "final_class", "error_message")}
    return raw.where(F.coalesce("judgment_id", F.lit("")) != "").withColumns(typed).select(*JUDGMENT_COLUMNS)


def latest_run(spark: SparkSession, folder: str, path: str | None = None) -> str:
    """The given path, or the last matrix CSV of a folder by name."""
    found = [path] if path else find_paths(spark, f"{folder}/*.csv")
    if not found:
        raise FileNotFoundError(f"no run in {folder}")
    return found[-1]

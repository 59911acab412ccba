"""Queries that write the engine's files from the tables, in the shared scratch folder, and read them back."""

from __future__ import annotations

import json
import threading
from functools import reduce

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import judging as J
from ..operators import runtime as R
from ..sources import readers, writers
from ..sources.scratch import new_path
from . import views as V

_CELL = ("prompt_id", "alias", "status", "response", "error_message")


def source_mapping(spark, sf_dir):
    """A long CSV a dimension, under its file's own column names."""
    mapping, parts = V.mapping(spark, sf_dir), []
    for dimension in ("Region", "Segment"):
        path = new_path(spark, f"mapping-{dimension}")
        rows = mapping.where(F.col("dimension") == dimension)
        rows.select(F.col("dimension_value").alias("Dimension value"), F.col("indicator_name").alias("Indicator name"), F.concat(F.lit(" "), "indicator_value").alias("Indicator value")).write.options(header=True, quote='"', escape='"').csv(path)
        parts.append(readers.mapping(spark, path, dimension))
    return reduce(lambda a, b: a.unionByName(b), parts).drop("pos")


def source_names(spark, sf_dir):
    """Each name stands twice; the later line holds."""
    path = new_path(spark, "names")
    twice = V.table(spark, sf_dir, "nation").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    twice.select(F.col("n_name").alias("Name"), F.when(F.col("k") == 0, "none").when(F.col("n_nationkey") % 2 == 0, "Female").otherwise("Male").alias("Gender"), "k").coalesce(1).sortWithinPartitions("k", "Name").drop("k").write.option("header", True).csv(path)
    return readers.names(spark, path)


def source_templates(spark, sf_dir):
    path = new_path(spark, "templates")
    dims = [r["r_name"] for r in V.table(spark, sf_dir, "region").select("r_name").orderBy("r_name").collect()]  # five rows: a configuration file
    writers.write_text(spark, path, json.dumps({d: f"I live in <{d}>." for d in dims}))
    return readers.templates(spark, path)


def _background_lines(spark, sf_dir):
    """Documents as background records; some lines are broken, some lack their messages."""
    path = new_path(spark, "backgrounds")
    talk = F.when(F.col("doc_id") % 5 != 0, F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    record = F.to_json(F.struct(F.col("lang").alias("dimension"), F.col("source").alias("dimension_value"), F.concat(F.lit("c"), "doc_id").alias("combination_id"), F.create_map(F.lit("lang"), "lang").alias("indicators"), talk.alias("messages")))
    V.table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{broken "), "doc_id")).otherwise(record).alias("value")).write.text(path)
    return path


def source_backgrounds(spark, sf_dir):
    read = readers.backgrounds(spark, _background_lines(spark, sf_dir))
    return read.select("combination_id", "dimension", "dimension_value", "schema_version", F.col("messages")[0].content.alias("content"))


def source_existing_ids(spark, sf_dir):
    return readers.existing_ids(spark, _background_lines(spark, sf_dir))


def source_histories(spark, sf_dir):
    """Conversations appended as histories in two goes."""
    path = new_path(spark, "histories")
    talks = V.messages(spark, sf_dir).select(F.concat(F.lit("h"), "conv_id").alias("history_id"), F.create_map(F.lit("Age"), F.lit("old")).alias("persona"), "messages", "conv_id")
    for k in (0, 1):
        writers.append_json(talks.where(F.col("conv_id") % 2 == k).drop("conv_id"), path)
    return readers.histories(spark, path).select("history_id", F.col("persona")["Age"].alias("age"), ids.canonical_prompt(F.col("messages")).alias("prompt"))


def _matrix_file(spark, sf_dir):
    path = f"{new_path(spark, 'matrix')}/run.csv"
    writers.matrix_csv(V.cells(spark, sf_dir), V.ALIASES, path)
    return path


def source_matrix(spark, sf_dir):
    """The matrix written wide as CSV and read back as cells."""
    return readers.matrix(spark, _matrix_file(spark, sf_dir)).select(*_CELL)


def sink_matrix_description(spark, sf_dir):
    """What stands beside a matrix file: its aliases, with the cells that the file has of each, and all that a cell can be."""
    path = _matrix_file(spark, sf_dir)
    about = json.loads(writers.read_text(spark, f"{path}.meta.json"))
    named = spark.createDataFrame([(a, about["schema_version"], ",".join(sorted(about["statuses"]))) for a in about["model_aliases"]], "alias string, version long, statuses string")
    return readers.matrix(spark, path, about["model_aliases"]).groupBy("alias").agg(F.count("*").alias("cells")).join(named, "alias")


def source_done_cells(spark, sf_dir):
    return readers.done_cells(spark, _matrix_file(spark, sf_dir))


def source_latest_run(spark, sf_dir):
    """The last of some runs by name."""
    folder = new_path(spark, "runs")
    runs = [r["r_name"] for r in V.table(spark, sf_dir, "region").select("r_name").collect()]  # five rows
    for name in runs:
        writers.write_text(spark, f"{folder}/{name}.csv", "prompt_id,prompt")
    return spark.createDataFrame([(readers.latest_run(spark, folder).rpartition("/")[2],)], "run string")


def sink_pending_matrix(spark, sf_dir):
    path = f"{new_path(spark, 'pending')}/run.csv"
    prompts = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("prompt_id"), F.col("text").alias("prompt"))
    writers.pending_matrix(prompts, V.ALIASES, path)
    return readers.matrix(spark, path).select("prompt_id", "prompt", "alias", "status")


def source_checkpoint(spark, sf_dir):
    """A log in two files, of which the smaller comes last: its lines hold, whatever Spark reads first."""
    path = new_path(spark, "checkpoint")
    status = F.when(F.col("event_type") == "error", "retryable_failure").when(F.col("event_type") == "purchase", "success").otherwise("pending")
    lines = V.table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("request_id"), status.alias("status"), F.col("event_type").alias("error_message"))).alias("value"))
    for name, part in (("a", "event_id % 10 <> 0"), ("b", "event_id % 10 = 0")):
        lines.where(part).coalesce(1).sortWithinPartitions("event_id").select("value").write.text(f"{path}/{name}")
    return readers.checkpoint(spark, f"{path}/*/part-*").select("request_id", "status", "error_message")


def _verdicts(spark, sf_dir):
    return J.verdicts(V.replies(spark, sf_dir), V.CLASSES)


def source_judgments(spark, sf_dir):
    """Judgments as CSV and back, with their types."""
    path = new_path(spark, "judgments")
    timed = _verdicts(spark, sf_dir).withColumns({"latency_ms": F.col("subject_id").cast("double") / 8, "total_tokens": F.length("raw_output"), "metadata": F.create_map(F.lit("b"), "judge_alias", F.lit("a"), F.lit("x"))})
    writers.judgments_csv(timed, path)
    read = readers.judgments(spark, path)
    return read.select("judgment_id", "subject_id", "judge_alias", "status", "final_class", "none_declared", "parse_status", "error_message", F.round("latency_ms", 3).alias("latency_ms"), "total_tokens", F.col("metadata")["b"].alias("of"))


def source_requests(spark, sf_dir):
    path = new_path(spark, "requests")
    V.messages(spark, sf_dir).select(F.concat(F.lit("r"), "conv_id").alias("request_id"), F.lit("alpha").alias("model_alias"), "messages", F.when(F.col("conv_id") % 2 == 0, 64).alias("max_tokens")).write.json(path)
    return readers.requests(spark, path).select("request_id", "model_alias", "max_tokens", F.size("messages").alias("turns"))


def source_log(spark, sf_dir):
    """The request log written sparsely as JSON lines, read and summed up."""
    path = new_path(spark, "log")
    log = V.log(spark, sf_dir).withColumns({"retry_count": (F.col("user_id") % 3).cast("int"), "error_message": F.when(F.col("status") == "failed", "Bearer abcdef123456 denied")})
    writers.append_json(R.log_rows(log, F.col("ts")), path)
    read = readers.log(spark, path)
    return R.log_summary(read, ["provider", "model", "retry_count", "error_message"]).select("provider", "model", F.coalesce("retry_count", F.lit(0)).alias("retry_count"), F.coalesce("error_message", F.lit("-")).alias("error_message"), "requests", "successes", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"))


def store_snapshots(spark, sf_dir):
    """A keyed store through three states: some cells, others in their place, and those of one language alone."""
    cells = V.cells(spark, sf_dir).select("prompt_id", "alias", "status", "lang")
    store = writers.Store(spark, new_path(spark, "store"), ["prompt_id", "alias"])
    store.upsert(cells.where("status <> 'pending'"))
    store.upsert(cells.where("status IN ('pending', 'failed')").withColumn("status", F.lit("success")))
    store.replace(store.read().where("lang <> 'en'"))
    return store.read().select("prompt_id", "alias", "status")


def store_two_writers(spark, sf_dir):
    """Two writers start from one state at once: what either puts in stays, wherever their keys share a bucket or not."""
    cells = V.cells(spark, sf_dir).select("prompt_id", "alias", "status")
    path, key = new_path(spark, "shared-store"), ["prompt_id", "alias"]
    writers.Store(spark, path, key, 8).upsert(cells.where("status <> 'pending'"))
    both = [writers.Store(spark, path, key, 8) for _ in range(2)]
    changes = [cells.where("status = 'failed'").withColumn("status", F.lit("success")), cells.where("status = 'pending'").withColumn("status", F.lit("retrying"))]
    threads = [threading.Thread(target=store.upsert, args=(change,)) for store, change in zip(both, changes)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return writers.Store(spark, path, key).read()


def source_matrix_prompts(spark, sf_dir):
    """Prompts of an existing matrix, in the order of its file."""
    path = f"{new_path(spark, 'ordered')}/run.csv"
    prompts = V.table(spark, sf_dir, "benchmark").select(F.lpad(F.col("item_id").cast("string"), 9, "0").alias("prompt_id"), F.regexp_replace("text", r"\s+", " ").alias("prompt"))
    cells = prompts.withColumns({"alias": F.lit("alpha"), "status": F.lit("pending"), "response": F.lit(None).cast("string"), "error_message": F.lit(None).cast("string")})
    writers.matrix_csv(cells, ["alpha"], path)
    # the file's own order, whatever it is: ids and places of its lines
    return readers.matrix_prompts(spark, path, ["alpha"]).agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"), F.count_distinct("position").alias("places"), F.sum(F.col("prompt_id").cast("long")).alias("ids"), F.sum(F.length("prompt")).alias("chars"))


QUERIES = {f.__name__: f for f in (sink_matrix_description, store_two_writers, source_matrix_prompts, source_mapping, source_names, source_templates, source_backgrounds, source_existing_ids, source_histories, source_matrix, source_done_cells, source_latest_run, sink_pending_matrix, source_checkpoint, source_judgments, source_requests, source_log, store_snapshots)}

_C = "WITH " + V.CELLS
_R = "WITH " + V.REPLIES
ORACLE_SQL = {
    "source_mapping": "WITH " + V.MAPPING + " SELECT dimension, dimension_value, indicator_name, indicator_value FROM mapping",
    "source_names": "SELECT n_name AS name, CASE n_nationkey % 2 WHEN 0 THEN 'Female' ELSE 'Male' END AS gender FROM nation",
    "source_templates": "SELECT r_name AS dim, 'I live in <' || r_name || '>.' AS template, CAST(row_number() OVER (ORDER BY r_name) - 1 AS INTEGER) AS ord FROM region",
    "source_backgrounds": "SELECT 'c' || doc_id AS combination_id, lang AS dimension, source AS dimension_value, 1 AS schema_version, text AS content FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0",
    "source_existing_ids": "SELECT 'c' || doc_id AS combination_id FROM documents WHERE doc_id % 7 <> 0",
    "source_histories": "WITH " + V.MESSAGES + " SELECT 'h' || conv_id AS history_id, 'old' AS age, prompt FROM msgs",
    "source_matrix": _C + " SELECT prompt_id, alias, status, response, error_message FROM cells",
    "sink_matrix_description": _C + " SELECT alias, count(*) AS cells, CAST(2 AS BIGINT) AS version, 'failed,not_requested,pending,rate_limited,retrying,success' AS statuses FROM cells GROUP BY alias",
    "source_done_cells": _C + " SELECT prompt_id, alias FROM cells WHERE status = 'success'",
    "source_latest_run": "SELECT max(r_name) || '.csv' AS run FROM region",
    "sink_pending_matrix": "SELECT CAST(item_id AS VARCHAR) AS prompt_id, text AS prompt, alias, 'pending' AS status FROM benchmark, (VALUES ('alpha'), ('beta'), ('gamma-gemma')) a(alias)",
    "source_checkpoint": """SELECT CAST(user_id AS VARCHAR) AS request_id, CASE event_type WHEN 'error' THEN 'retryable_failure' WHEN 'purchase' THEN 'success' ELSE 'pending' END AS status, event_type AS error_message
FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10 = 0 DESC, event_id DESC) = 1""",
    "source_judgments": _R + " SELECT judgment_id, subject_id, judge_alias, status, final_class, none_declared, parse_status, error_message, round(CAST(subject_id AS DOUBLE) / 8, 3) AS latency_ms, CAST(length(raw_output) AS INTEGER) AS total_tokens, judge_alias AS of FROM verdicts",
    "source_requests": "SELECT 'r' || conv_id AS request_id, 'alpha' AS model_alias, CASE conv_id % 2 WHEN 0 THEN 64 END AS max_tokens, CAST(count(*) AS INTEGER) AS turns FROM conversations GROUP BY conv_id",
    "source_log": "WITH " + V.LOG + """ SELECT provider, model, CAST(user_id % 3 AS INTEGER) AS retry_count, CASE status WHEN 'failed' THEN 'Bearer [REDACTED] denied' ELSE '-' END AS error_message, count(*) AS requests, count(*) FILTER (status = 'success') AS successes,
  strftime(max(ts) FILTER (status = 'success'), '%Y-%m-%d %H:%M:%S') AS last_success FROM log GROUP BY 1, 2, 3, 4""",
    "store_two_writers": _C + " SELECT prompt_id, alias, CASE status WHEN 'failed' THEN 'success' WHEN 'pending' THEN 'retrying' ELSE status END AS status FROM cells",
    "source_matrix_prompts": r"SELECT count(*) AS n, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last, count(*) AS places, CAST(sum(item_id) AS BIGINT) AS ids, CAST(sum(length(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT) AS chars FROM benchmark",
    "store_snapshots": _C + " SELECT prompt_id, alias, CASE WHEN status IN ('pending', 'failed') THEN 'success' ELSE status END AS status FROM cells WHERE lang <> 'en'",
}

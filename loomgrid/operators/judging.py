"""Judging subjects with several judges: subjects, pairs, verdicts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.names import unused
from ..functions.parse import final_answer, lenient_cell, verdict_status, worked_out
from ..functions.text import MESSAGES, strip
from .personas import pending, upsert
from .runtime import positions

RESUME_KEY = ["subject_id", "subject_model_alias", "judge_alias", "judge_config_hash"]


def records_to_subjects(records: DataFrame, order: str, content: str, id_field: str | None = None, messages: str | None = None, model: str | None = None, metadata: list[str] | None = None, source_id: str | None = None) -> DataFrame:
    """Subjects of arbitrary records; those without content (blank) or messages are left out.

    Without an id the subject's comes from its row position (by ``order``) and content.
    """
    if id_field:
        sid = F.col(id_field).cast("string")
        placed = records
    else:
        (place,) = unused(records, "place")
        placed = positions(records, [order], place)
        sid = ids.subject_id(F.col(place), ids.spaced_json({content: F.col(content)}))
    keep = F.size(F.coalesce(F.col(messages), F.array().cast(MESSAGES))) > 0 if messages else F.coalesce(strip(F.col(content).cast("string")), F.lit("")) != ""
    extra = F.create_map(*[x for f in metadata for x in (F.lit(f), F.col(f).cast("string"))]) if metadata else F.lit(None).cast("map<string,string>")
    return placed.where(keep).select(
        sid.alias("subject_id"),
        (F.lit(None) if messages else F.col(content)).cast("string").alias("subject_content"),
        (F.col(messages) if messages else F.lit(None)).cast(MESSAGES).alias("messages"),
        (F.col(model) if model else F.lit(None)).cast("string").alias("subject_model_alias"),
        F.lit(source_id).cast("string").alias("source_id"),
        F.lit(None).cast("string").alias("prompt_id"),
        extra.alias("metadata"),
    )


def cell_reason(prompt_id: Column, cell: Column, parsed: Column) -> Column:
    """Why a matrix cell gives no subject, or ``emitted``."""
    return (
        F.when(F.coalesce(F.lower(strip(prompt_id)), F.lit("")).isin("", "nan"), "skipped_prompt")
        .when(parsed.isNull(), "skipped_unreadable")
        .when(F.coalesce(parsed["status"] != "success", F.lit(True)), "skipped_status")
        .when(F.coalesce(parsed["response"], F.lit("")) == "", "skipped_empty")
        .otherwise("emitted")
    )


def matrix_cells_labelled(wide: DataFrame, aliases: list[str]) -> DataFrame:
    """Each cell of a wide matrix, read leniently, with its ``reason``."""
    long = wide.unpivot(["prompt_id", "prompt"], [F.col(f"`{a}`") for a in aliases], "alias", "cell").withColumn("c", worked_out(lenient_cell(F.col("cell"))))
    return long.withColumn("reason", cell_reason(F.col("prompt_id"), F.col("cell"), F.col("c")))


def matrix_to_subjects(wide: DataFrame, aliases: list[str], source_id: str | None = None) -> DataFrame:
    """Subjects of a matrix's successful, non-empty cells."""
    good = matrix_cells_labelled(wide, aliases).where("reason = 'emitted'")
    return good.select(
        F.concat_ws(":", "prompt_id", "alias").alias("subject_id"),
        F.col("c.response").alias("subject_content"),
        F.lit(None).cast(MESSAGES).alias("messages"),
        F.col("alias").alias("subject_model_alias"),
        F.lit(source_id).cast("string").alias("source_id"),
        "prompt_id",
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def cells_to_subjects(cells: DataFrame, source_id: str | None = None) -> DataFrame:
    """Subjects of a long matrix's successful, non-empty cells: no wide matrix is made."""
    reason = cell_reason(F.col("prompt_id"), F.lit(""), F.struct("status", "response"))
    return cells.where(reason == "emitted").select(
        F.concat_ws(":", "prompt_id", "alias").alias("subject_id"),
        F.col("response").alias("subject_content"),
        F.lit(None).cast(MESSAGES).alias("messages"),
        F.col("alias").alias("subject_model_alias"),
        F.lit(source_id).cast("string").alias("source_id"),
        "prompt_id",
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def adapter_counts(wide: DataFrame, aliases: list[str]) -> DataFrame:
    """Cells by reason."""
    return matrix_cells_labelled(wide, aliases).groupBy("reason").agg(F.count("*").alias("n"))


def pairs(subjects: DataFrame, judges: list[str], config: str, done: DataFrame | None = None) -> DataFrame:
    """Each subject with each judge, without those already judged with success."""
    out = subjects.withColumn("judge_alias", F.explode(F.array(*[F.lit(j) for j in judges]))).withColumn("judge_config_hash", F.lit(config))
    return pending(out, done.where("status = 'success'"), RESUME_KEY) if done is not None else out


def verdicts(replies: DataFrame, classes: list[str] | None) -> DataFrame:
    """Replies (the pair's columns, ``raw_output``, ``error_message``) with the parsed verdict, status and id."""
    failed = F.col("error_message").isNotNull()
    raw = F.when(failed, "").otherwise(F.coalesce("raw_output", F.lit("")))
    parsed = F.when(failed, final_answer(F.lit(""), [])).otherwise(final_answer(raw, classes))
    out = replies.withColumn("raw_output", raw).withColumn("p", parsed)
    return out.withColumns(
        {
            "final_class": F.col("p.final_class"),
            "none_declared": F.col("p.none_declared"),
            "parse_status": F.col("p.parse_status"),
            "status": verdict_status(F.col("p.parse_status"), failed),
            "judgment_id": ids.judgment_id(F.col("subject_id"), F.col("subject_model_alias"), F.col("judge_alias"), F.col("judge_config_hash")),
        }
    ).drop("p")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Judgments with new verdicts in place of those of the same key."""
    return upsert(old, new, RESUME_KEY)


def of_config(judgments: DataFrame, config: str) -> DataFrame:
    return judgments.where(F.col("judge_config_hash") == config)


def summary(judgments: DataFrame, judges: list[str], skipped: DataFrame | None = None) -> DataFrame:
    """Per judge: completed, classification_failed, call_failed, skipped_resume; judges without rows have zeros."""
    counts = judgments.groupBy("judge_alias").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("success", "completed"), ("classification_failed", "classification_failed"), ("call_failed", "call_failed"))])
    base = judgments.sparkSession.createDataFrame([(j,) for j in judges], "judge_alias string").join(counts, "judge_alias", "left")
    if skipped is not None:
        base = base.join(skipped.groupBy("judge_alias").agg(F.count("*").alias("skipped_resume")), "judge_alias", "left")
    else:
        base = base.withColumn("skipped_resume", F.lit(0).cast("long"))
    return base.na.fill(0)


def totals(judgments: DataFrame) -> DataFrame:
    """One row: verdicts that succeeded, and that failed."""
    return judgments.agg(F.count_if(F.col("status") == "success").alias("ok"), F.count_if(F.col("status") != "success").alias("failed"))


def accuracy(judgments: DataFrame, gold: DataFrame) -> DataFrame:
    """Per judge: share of successful verdicts equal to ``gold`` (subject_id, label), and their number."""
    joined = judgments.where("status = 'success'").join(gold, "subject_id")
    return joined.groupBy("judge_alias").agg(F.avg(F.coalesce(F.col("final_class") == F.col("label"), F.lit(False)).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def disagreements(judgments: DataFrame) -> DataFrame:
    """Subjects to which successful judges gave different classes."""
    won = judgments.where("status = 'success'").groupBy("subject_id").agg(F.array_sort(F.collect_set("final_class")).alias("classes"))
    return won.where(F.size("classes") > 1)


def with_metadata(judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Judgments with a ``metadata_<key>`` column for each key."""
    return judgments.withColumns({f"metadata_{k}": F.try_element_at("metadata", F.lit(k)) for k in keys}).drop("metadata")

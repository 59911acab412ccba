"""Whole runs: experiments, judging, personas, batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Experiment, Judging
from .functions import text
from .functions.parse import cell_status
from .operators import judging, matrix, personas, runtime
from .sources.journal import BATCHES, Journal
from .sources.scratch import durable
from .sources.store import Store
from .sources.writers import append_json

Answer = Callable[[DataFrame], DataFrame]
#: Times of judgments: UTC to the second.
SECONDS = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


@dataclass(frozen=True)
class Run:
    """Cells or judgments of a run, and its summary; both lazy."""

    rows: DataFrame
    summary: DataFrame


def run_experiment(specs: DataFrame, config: Experiment, answer: Answer, store: Store, run_cells: DataFrame | None = None, log: str | None = None, on_batch: Callable[[dict], None] | None = None, batches: int = BATCHES) -> Run:
    """Fill the matrix of prompts and models; cells that succeeded before aren't asked again.

    ``specs``: prompt_no, system, user, messages. ``answer`` adds content, status and
    error_message to requests (prompt_id, prompt, alias, messages). ``store`` is keyed
    by prompt_id and alias; prompts that are no longer asked for leave it. A model's own system prompt leads its
    requests. Answers are kept batch by batch beside the store, so a run that breaks off loses one of ``batches`` at most: the next one takes up what was
    kept. ``log`` names a folder of JSON lines to which a line for each request is appended; ``on_batch`` gets the
    counts done, succeeded and total as the run goes on.
    """
    journal = Journal(store.spark, f"{store.folder}/journal")
    asked = matrix.prompts(specs, config.system_prompt)
    grid = matrix.cells(asked, list(config.aliases), run_cells)
    null = F.lit(None).cast("string")
    columns = ["prompt_id", "prompt", "alias", "status", "response", "error_message"]

    def take_up(answered: DataFrame) -> None:
        if log is not None:
            append_json(runtime.log_rows(answered if "model" in answered.columns else answered.withColumn("model", F.col("alias"))), log)
        ended = answered.withColumn("status", cell_status(F.col("status"))).select("prompt_id", "prompt", "alias", "status", F.when(F.col("status") == "success", F.col("content")).alias("response"), "error_message")
        store.upsert(ended)
        journal.clear()

    if (left := journal.read()) is not None:  # of a run that broke off
        take_up(left)
    old = store.read()
    todo = matrix.to_run(grid, old) if old is not None else grid.where("status <> 'not_requested'")
    requests = todo.drop("status").join(asked.select("prompt_id", F.col("turns").alias("messages")), "prompt_id")
    answered = journal.ask(matrix.for_models(requests, config.system_prompt_by_model), answer, on_batch, batches)
    if answered is not None:
        take_up(answered)
    left_out = grid.where("status = 'not_requested'").select("prompt_id", "prompt", "alias", "status", null.alias("response"), null.alias("error_message"))

    def kept(now: DataFrame | None) -> DataFrame:
        if now is None:
            return left_out
        return matrix.retain(now.select(*columns), asked).unionByName(personas.pending(left_out, now, ["prompt_id", "alias"]))

    now = store.read()
    if now is None or now.join(asked, "prompt_id", "left_anti").take(1) or personas.pending(left_out, now, ["prompt_id", "alias"]).take(1):
        store.update(kept)
    rows = store.read()
    return Run(rows, matrix.summary(rows))


def run_judges(subjects: DataFrame, config: Judging, answer: Answer, store: Store, on_batch: Callable[[dict], None] | None = None, batches: int = BATCHES) -> Run:
    """Judge subjects; those judged with success under the same configuration are skipped.

    ``answer`` adds raw_output and error_message to pairs with ``messages`` for the judge. Replies are kept batch by batch beside the store, as in ``run_experiment``.
    """
    journal = Journal(store.spark, f"{store.folder}/journal")

    def timed(pairs: DataFrame) -> DataFrame:
        stamp = lambda: F.date_format(F.lit(datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz"), SECONDS)
        began = stamp()
        replies = durable(answer(pairs), "replies")
        return replies.withColumns({"started_at": began, "completed_at": stamp()})

    def take_up(replies: DataFrame) -> None:
        keep = [c for c in replies.columns if c not in ("judge_messages", "messages", "subject_content")]
        made = judging.verdicts(replies.select(*keep), list(config.classes) if config.classes else None)
        store.upsert(made)
        journal.clear()

    if (left := journal.read()) is not None:
        take_up(left)
    todo = judging.pairs(subjects, list(config.judges), config.hash, store.read())
    asked = text.judge_messages(config.judge_prompt, list(config.classes) if config.classes else None, F.col("subject_content"), F.col("messages"), F.col("metadata") if config.include_metadata_in_prompt else None)
    asks = todo.withColumn("judge_messages", asked)
    replies = journal.ask(asks, timed, on_batch, batches)
    if replies is not None or store.read() is None:
        take_up(timed(asks) if replies is None else replies)
    rows = judging.of_config(store.read(), config.hash)
    return Run(rows, judging.summary(rows, list(config.judges)))


def generate_backgrounds(mapping: DataFrame, templates: DataFrame, answer: Answer, store: Store, passes: int = 3, on_batch: Callable[[dict], None] | None = None, batches: int = BATCHES) -> DataFrame:
    """Ask for a background of each combination not yet stored, in up to ``passes`` rounds; progress by dimension. Answers are kept batch by batch, as in ``run_experiment``."""
    journal = Journal(store.spark, f"{store.folder}/journal")
    combos = personas.combinations(mapping)

    def take_up(answered: DataFrame) -> None:
        turns = F.array(F.struct(F.col("prompt").alias("content"), F.lit("user").alias("role")), F.struct("content", F.lit("assistant").alias("role")))
        good = answered.where("status = 'success'")
        store.upsert(good.select("dimension", "dimension_value", "combination_id", "indicators", turns.alias("messages"), F.sha2("template", 256).alias("template_hash"), runtime.utc_stamp(F.current_timestamp()).alias("generated_at")))
        journal.clear()

    if (left := journal.read()) is not None:
        take_up(left)
    for _ in range(passes):
        old = store.read()
        todo = personas.pending(combos, old, ["combination_id"]) if old is not None else combos
        prompts = todo.join(templates.select("dim", "template"), F.lower("dimension") == F.lower("dim")).withColumn("prompt", text.render(F.col("template"), F.col("indicators")))
        answered = journal.ask(prompts, answer, on_batch, batches)
        if answered is None:
            break
        take_up(answered)
    done = store.read()
    return personas.progress(combos, done.select("combination_id") if done is not None else combos.where("false").select("combination_id"))

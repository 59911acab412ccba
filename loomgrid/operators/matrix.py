"""The prompt by model matrix, kept long: one row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Grid
from ..functions import ids
from ..functions.names import columns_of, unused
from ..functions.parse import decode_cell, encode_cell, worked_out
from ..functions.text import MESSAGES, canonical_messages, with_system
from .personas import pending, upsert

TERMINAL = ("success", "failed", "rate_limited", "not_requested")


def prompts(specs: DataFrame, system: str | None = None) -> DataFrame:
    """``specs`` (prompt_no, system, user, messages) with ``prompt`` and ``prompt_id``; of equal prompts the first.

    A default system prompt applies before identity does.
    """
    lead = F.coalesce("system", F.lit(system).cast("string"))
    made = specs.withColumn("turns", canonical_messages(lead, F.col("user"), F.col("messages")))
    named = made.select("prompt_no", ids.prompt_id(F.col("turns")).alias("prompt_id"), ids.canonical_prompt(F.col("turns")).alias("prompt"), "turns")
    first = named.groupBy("prompt_id").agg(F.min_by(F.struct("prompt_no", "prompt", "turns"), "prompt_no").alias("r"))
    return first.select("r.prompt_no", "prompt_id", "r.prompt", "r.turns")


def grid(systems: DataFrame | None, statics: DataFrame | None, requests: DataFrame) -> DataFrame:
    """Prompt specs of every system, static context and final message: ``prompt_no, system, user, messages``.

    ``systems`` (no, system), ``statics`` (no, turns), ``requests`` (no, user).
    """
    out = requests.select(F.col("no").alias("r"), F.col("user").alias("final"))
    out = out.crossJoin(statics.select(F.col("no").alias("t"), "turns")) if statics is not None else out.withColumns({"t": F.lit(0), "turns": F.lit(None).cast(MESSAGES)})
    out = out.crossJoin(systems.select(F.col("no").alias("s"), "system")) if systems is not None else out.withColumns({"s": F.lit(0), "system": F.lit(None).cast("string")})
    last = F.array(F.struct(F.col("final").alias("content"), F.lit("user").alias("role")))
    messages = F.when(F.col("turns").isNotNull(), F.concat(F.col("turns").cast(MESSAGES), last))
    return out.select(F.struct("s", "t", "r").alias("prompt_no"), "system", F.when(F.col("turns").isNull(), F.col("final")).alias("user"), messages.alias("messages"))


def from_grid(spark: SparkSession, grid_: Grid) -> DataFrame:
    """Prompt specs of a grid's configuration; systems by model are left to the time of asking."""
    systems = grid_.system_prompts if grid_.system_prompts is not None else (grid_.system_prompt,) if grid_.system_prompt is not None else None
    statics = grid_.static_turns_list if grid_.static_turns_list is not None else (grid_.static_turns,) if grid_.static_turns is not None else None
    finals = grid_.final_user_messages if grid_.final_user_messages is not None else (grid_.final_user_message,)
    listed = lambda values, kind: spark.createDataFrame(list(enumerate(values)), f"no int, {kind}")  # noqa: E731 - a configuration's few rows
    turns = [[(t["content"], t["role"]) for t in x] for x in statics] if statics is not None else None
    return grid(listed(systems, "system string") if systems is not None else None, listed(turns, f"turns {MESSAGES}") if turns is not None else None, listed(finals, "user string"))


def for_models(requests: DataFrame, systems: dict[str, str], messages: str = "messages") -> DataFrame:
    """Requests (alias, ``messages``) with the system text of their model in place of the prompt's own."""
    if not systems:
        return requests
    own = F.create_map(*[F.lit(x) for pair in sorted(systems.items()) for x in pair])
    return requests.withColumn(messages, with_system(F.col(messages), F.try_element_at(own, F.col("alias"))))


def cells(prompts_: DataFrame, aliases: list[str], run_cells: DataFrame | None = None) -> DataFrame:
    """Every prompt with every alias: ``prompt_id, prompt, alias, status``: pending, or not_requested outside ``run_cells``."""
    names = F.explode(F.array(*[F.lit(a) for a in aliases]))  # the aliases are few and given: no join at all
    out = prompts_.select("prompt_id", "prompt", names.alias("alias"))
    if run_cells is None:
        return out.withColumn("status", F.lit("pending"))
    asked = run_cells.select("prompt_id", "alias").distinct().withColumn("asked", F.lit(True))
    return out.join(asked, ["prompt_id", "alias"], "left").select("prompt_id", "prompt", "alias", F.when(F.col("asked"), "pending").otherwise("not_requested").alias("status"))


def to_wide(cells_: DataFrame, aliases: list[str], value: Column | None = None) -> DataFrame:
    """One row per prompt, a column of cell JSON (or ``value``) per alias."""
    cell = encode_cell(F.col("status"), F.col("response"), F.col("error_message")) if value is None else value
    return cells_.groupBy("prompt_id", "prompt").pivot("alias", aliases).agg(F.first(cell))


def to_long(wide: DataFrame, aliases: list[str] | None = None) -> DataFrame:
    """Cells of a wide matrix, decoded strictly: ``prompt_id, prompt, alias, status, response, error_message, metadata``."""
    if wide.columns[:1] != ["prompt_id"] or "prompt" not in wide.columns:
        raise ValueError("a matrix starts with prompt_id and has a prompt column")
    aliases = aliases if aliases is not None else [c for c in wide.columns if c not in ("prompt_id", "prompt")]
    long = wide.unpivot(["prompt_id", "prompt"], [F.col(f"`{a}`") for a in aliases], "alias", "cell")
    return long.withColumn("c", worked_out(decode_cell(F.col("cell")))).select("prompt_id", "prompt", "alias", "c.*")


def filter_rows(cells_: DataFrame, models: list[str] | None = None, prompt_contains: str | None = None, status: str | None = None, all_complete: bool = False, min_success: int | None = None) -> DataFrame:
    """Cells of ``models`` in the prompts that pass every given test; a model without cells is an error, found before anything is filtered.

    ``prompt_contains``: in the serialised prompt, case counts. ``status``: all cells have it. ``all_complete``: all
    succeeded. ``min_success``: so many did.
    """
    if models is not None:
        check_models(models, [r["alias"] for r in cells_.select("alias").distinct().collect()])  # a row a model
        cells_ = cells_.where(F.col("alias").isin(*models))
    if prompt_contains is not None:
        cells_ = cells_.where(F.contains("prompt", F.lit(prompt_contains)))
    tests = []
    won = F.coalesce(F.col("status") == "success", F.lit(False))
    if status is not None:
        tests.append(F.bool_and(F.coalesce(F.col("status") == status, F.lit(False))))
    if all_complete:
        tests.append(F.bool_and(won))
    if min_success is not None:
        tests.append(F.count_if(won) >= min_success)
    if not tests:
        return cells_
    good = cells_.groupBy("prompt_id").agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)])
    good = good.where(" AND ".join(f"t{i}" for i in range(len(tests)))).select("prompt_id")
    return cells_.join(good, "prompt_id", "left_semi")


def filter_wide(cells_: DataFrame, models: list[str], **tests) -> DataFrame:
    """``filter_rows`` as a wide matrix with the models' columns in the given order."""
    return to_wide(filter_rows(cells_, models, **tests), models)


def check_models(models: list[str], known: list[str]) -> None:
    unknown = [m for m in models if m not in known]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")


def analysis(cells_: DataFrame, aliases: list[str]) -> DataFrame:
    """One row per prompt, a column per alias: the response of a success, else null."""
    return to_wide(cells_, aliases, F.when(F.col("status") == "success", F.col("response")))


def summary(cells_: DataFrame) -> DataFrame:
    """One row: prompts, models, cells, finished, failed and rate-limited cells."""
    return cells_.agg(
        F.count_distinct("prompt_id").alias("prompts"),
        F.count_distinct("alias").alias("models"),
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin(*TERMINAL)).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "rate_limited").alias("rate_limited"),
    )


def is_complete(grid_: DataFrame, cells_: DataFrame) -> DataFrame:
    """One row: whether every cell of the grid (prompt_id, alias) is there and has ended."""
    state = cells_.select("prompt_id", "alias", "status")
    joined = grid_.select("prompt_id", "alias").join(state, ["prompt_id", "alias"], "left")
    return joined.agg(F.coalesce(F.bool_and(F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))), F.lit(True)).alias("complete"))


def to_run(grid_: DataFrame, cells_: DataFrame) -> DataFrame:
    """Cells of the grid still to run: not yet succeeded, and asked for."""
    won = cells_.where("status = 'success'")
    return pending(grid_.where("status <> 'not_requested'"), won, ["prompt_id", "alias"])


def write_cells(cells_: DataFrame, new: DataFrame) -> DataFrame:
    """Cells with the values of ``new``; a cell that the matrix doesn't have, or two values of one, is an error as rows are made."""
    key = ["prompt_id", "alias"]
    n, known = unused(new, "n", "known")
    times = new.groupBy(*key).agg(F.count("*").alias(n))
    met = new.join(times, key).join(cells_.select(*key).distinct().withColumn(known, F.lit(True)), key, "left")
    cell = F.concat_ws(" / ", *key)
    bad = F.when(F.col(known).isNull(), F.concat(F.lit("no such cell: "), cell)).when(F.col(n) > 1, F.concat(F.lit("two values of one cell: "), cell))
    checked = F.when(bad.isNull(), F.col("status")).otherwise(F.raise_error(bad).cast("string"))
    return upsert(cells_, met.withColumn("status", checked).select(*columns_of(new)), key)


def append_missing(cells_: DataFrame, prompts_: DataFrame, aliases: list[str]) -> DataFrame:
    """Cells plus pending ones of the prompts they lack."""
    fresh = cells(pending(prompts_, cells_, ["prompt_id"]), aliases)
    return cells_.select("prompt_id", "prompt", "alias", "status").unionByName(fresh)


def retain(cells_: DataFrame, prompts_: DataFrame) -> DataFrame:
    return cells_.join(prompts_.select("prompt_id").distinct(), "prompt_id", "left_semi")

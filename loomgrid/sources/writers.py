"""Writers of the engine's files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import CELL_STATUSES
from ..operators.matrix import to_wide
from .files import read_text, write_text  # noqa: F401
from .readers import JUDGMENT_COLUMNS
from .store import Store, StoreConflict  # noqa: F401


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; null fields are left out."""
    df.write.mode("append").json(path)


def matrix_csv(cells: DataFrame, aliases: list[str], path: str) -> None:
    """The wide matrix as CSV, with quotes where needed, and its description beside it."""
    to_wide(cells, aliases).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", lineSep="\n").csv(path)
    about = {"schema_version": 2, "model_aliases": aliases, "statuses": list(CELL_STATUSES), "prompt_id": "sha256(canonical prompt JSON)", "cell_id": "sha256(prompt_id, 0x1f, alias)"}
    write_text(cells.sparkSession, f"{path}.meta.json", json.dumps(about, indent=2, sort_keys=True))


def pending_matrix(prompts: DataFrame, aliases: list[str], path: str) -> None:
    """A fresh matrix: every cell pending."""
    cells = prompts.select("prompt_id", "prompt", F.explode(F.array(*[F.lit(a) for a in aliases])).alias("alias"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error_message"))
    matrix_csv(cells, aliases, path)


def judgment_row(df: DataFrame) -> DataFrame:
    """Judgments as text columns: nulls empty, true and false, three decimals of latency, metadata as sorted JSON."""
    entries = F.map_from_entries(F.array_sort(F.map_entries("metadata")))

    def text(c: str) -> Column:
        if c == "latency_ms":
            return F.coalesce(F.format_string("%.3f", F.col(c).cast("double")), F.lit("")) if c in df.columns else F.lit("")
        if c == "metadata":
            return F.coalesce(F.to_json(entries), F.lit("")) if c in df.columns else F.lit("")
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")

    blank_latency = F.when(F.col("latency_ms").isNull(), "").otherwise(text("latency_ms")) if "latency_ms" in df.columns else F.lit("")
    return df.select(*[(blank_latency if c == "latency_ms" else text(c)).alias(c) for c in JUDGMENT_COLUMNS])


def judgments_csv(df: DataFrame, path: str) -> None:
    """Judgments as CSV, every field quoted."""
    judgment_row(df).write.mode("overwrite").options(header=True, quoteAll=True, quote='"', escape='"', emptyValue="", lineSep="\n").csv(path)


def run_path(folder: str, experiment: str, stamp: str) -> str:
    return f"{folder.rstrip('/')}/{experiment}/{stamp}.csv"


def judgments_path(folder: str, experiment: str) -> str:
    return f"{folder.rstrip('/')}/{experiment}/judgments.csv"


def checkpoint_path(given: str | None, configured: str | None, name: str = "batch") -> str:
    """A batch's checkpoint: the given path, else in the configured folder."""
    if given:
        return given
    if not configured:
        raise ValueError("a batch needs a checkpoint path")
    return configured if configured.endswith(".jsonl") else f"{configured.rstrip('/')}/{name}.jsonl"

"""Pieces that the training-data operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.names import columns_of, named, unused  # noqa: F401 - the operators take these from here
from ..sources.scratch import durable, shared_dir  # noqa: F401

#: A word, where an operator's contract says "words": a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: What separates those words.
GAP = r"[\x20\x09-\x0D]+"

#: Rows handled at once inside a task.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*more: str) -> list[Column]:
    """What tells rows of documents apart, as plain values: (id, hash) and the further columns.

    Equal rows share it; rows with one id but other texts don't. Nulls stand as values, with the hash to tell
    them from those, so joins and windows by it share one shuffle.
    """
    nulls = [F.col(c).isNull() for c in ("doc_id", *more)]
    return [F.coalesce("doc_id", F.lit(0)), F.xxhash64(*nulls, "text"), *[F.coalesce(F.col(c), F.lit("")) for c in more]]


def n_words(text: Column) -> Column:
    """Number of ``WORD`` matches (null: 0), by splitting at the gaps between them."""
    parts = F.split(text, GAP)
    empty_ends = F.when(parts[0] == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - empty_ends).cast("long")


def map_texts(df: DataFrame, keep: list[str], text: str, make, columns: dict[str, str]) -> DataFrame:
    """``keep`` columns of ``df`` plus ``columns`` (name: type) made from its ``text`` column.

    ``make()`` is called once per task and returns a function from a list of texts to
    one list per column. Rows stream through in slices of bounded size; nothing is shuffled.
    """
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    source = df.select(*[named(k).alias(f"c{i}") for i, k in enumerate(keep)], named(text).alias("text"))  # plain names: Spark resolves them anew
    made = StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in columns.items()))
    schema = StructType([*(StructField(k, f.dataType) for k, f in zip(keep, source.schema.fields)), *made.fields])
    arrow = [types[t] for t in columns.values()]

    def run(batches):
        function = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = function(part.column(part.num_columns - 1).to_pylist())
                arrays = [*part.columns[:-1], *(pa.array(v, type=t) for v, t in zip(values, arrow))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *columns])

    return source.mapInArrow(run, schema)

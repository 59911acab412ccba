"""Indicator combinations, personas and conversation histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.names import named
from ..functions.text import MESSAGES, strip

MAPPING = ("dimension", "dimension_value", "indicator_name", "indicator_value", "pos")


def combinations(mapping: DataFrame) -> DataFrame:
    """``dimension, dimension_value, indicators, combination_id``: one value for each indicator, in every way.

    ``mapping``: one row for each value of an indicator of a dimension's value, with
    ``pos`` for its place in the file. Work and memory of a row follow one dimension
    value's product.
    """
    values = mapping.select("dimension", *[strip(F.col(c)).alias(c) for c in MAPPING[1:4]], "pos")
    lists = values.groupBy("dimension", "dimension_value", "indicator_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "indicator_value"))), lambda x: x.indicator_value).alias("vs"))
    grouped = lists.groupBy("dimension", "dimension_value").agg(F.array_sort(F.collect_list(F.struct("indicator_name", "vs"))).alias("inds"))
    empty = F.array(F.create_map().cast("map<string,string>"))
    product = F.aggregate("inds", empty, lambda acc, x: F.flatten(F.transform(acc, lambda m: F.transform(x.vs, lambda v: F.map_concat(m, F.create_map(x.indicator_name, v))))))
    out = grouped.select("dimension", "dimension_value", F.explode(product).alias("indicators"))
    return out.withColumn("combination_id", ids.combination_id(F.col("dimension"), F.col("dimension_value"), F.col("indicators")))


def combination_counts(mapping: DataFrame) -> DataFrame:
    """Combinations per dimension value, without making them: the exact product, an error from 10^38 on."""
    n = mapping.groupBy("dimension", "dimension_value", "indicator_name").agg(F.count("*").alias("n"))
    listed = n.groupBy("dimension", "dimension_value").agg(F.collect_list(F.col("n").cast("decimal(38,0)")).alias("ns"))  # a number an indicator
    times = F.aggregate("ns", F.lit(1).cast("decimal(38,0)"), lambda acc, x: F.coalesce((acc * x).cast("decimal(38,0)"), F.raise_error(F.lit("more than 10^38 combinations")).cast("decimal(38,0)")))
    return listed.select("dimension", "dimension_value", times.alias("combinations"))


def dimension_values(backgrounds: DataFrame) -> DataFrame:
    """Values of each dimension by first appearance: ``dimension, dimension_value, pos``."""
    return backgrounds.groupBy("dimension", "dimension_value").agg(F.min("pos").alias("pos"))


def personas(values: DataFrame, dimensions: list[str], partial: bool = False, only: dict[str, str] | None = None) -> DataFrame:
    """One row per persona, a column per dimension, and ``persona_no`` from 0 in product order.

    With ``partial`` a dimension may be null, though not all of them; null comes
    first. ``only`` keeps personas of these values; it is applied to the dimensions
    before they are crossed. A dimension it names that isn't there matches nothing.
    The product is what is asked for; ``expected_histories`` counts without making it.
    """
    only = only or {}
    listed = values.where(F.col("dimension").isin(*dimensions)).select("dimension", "dimension_value", "pos")
    kept = reduce(lambda a, b: a & b, [(F.col("dimension") != d) | (F.col("dimension_value") == v) for d, v in only.items()], F.lit(True))
    listed = listed.where(kept).withColumn("i", F.row_number().over(W.partitionBy("dimension").orderBy("pos")).cast("long"))
    sizes = {r["dimension"]: r["n"] for r in listed.groupBy("dimension").agg(F.count("*").alias("n")).collect()}  # a row a dimension
    parts, number, width = [], F.lit(0).cast("long"), 1
    for k, name in reversed(list(enumerate(dimensions))):
        own = listed.where(F.col("dimension") == name).select(F.col("dimension_value").alias(name), F.col("i").alias(f"__{k}"))
        free = partial and name not in only
        if free:
            own = own.unionByName(values.sparkSession.range(1).select(F.lit(None).cast("string").alias(name), F.lit(0).cast("long").alias(f"__{k}")))
        parts.insert(0, own)
        number = number + (F.col(f"__{k}") - (0 if free else 1)) * width
        width *= sizes.get(name, 0) + int(free)
    # the number follows from the places in each dimension: nothing is sorted
    out = reduce(lambda a, b: a.crossJoin(b), parts).withColumn("persona_no", number - int(partial and not only))
    out = out.where(F.coalesce(*[named(d) for d in dimensions]).isNotNull())
    if set(only) - set(dimensions):
        out = out.where("false")
    return out.select(*map(named, dimensions), "persona_no")


def _options(backgrounds: DataFrame, names: DataFrame | None, name: str, i: int, partial: bool, name_key: str) -> DataFrame:
    """A dimension's choices: value, combination id, the gender its name implies, messages."""
    named = F.try_element_at("indicators", F.lit(name_key)).alias("name")
    own = backgrounds.where(F.col("dimension") == name).select("dimension_value", "combination_id", "messages", named)
    if names is not None:
        own = own.join(names.select(F.col("name").alias("known"), F.col("gender").alias("name_gender")), F.col("name") == F.col("known"), "left").drop("known")
    else:
        own = own.withColumn("name_gender", F.lit(None).cast("string"))
    if partial:
        own = own.unionByName(backgrounds.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in own.dtypes]))
    return own.select(*[F.col(c).alias(f"{c}_{i}") for c in own.columns])


def histories(backgrounds: DataFrame, dimensions: list[str], names: DataFrame | None = None, partial: bool = False, gender: str = "Gender", name_key: str = "Name", done: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Conversation histories of all personas: ``history_id, persona, combination_ids, messages``.

    A history takes one background for each dimension of its persona, in every way. A
    background whose indicators name a person goes only with personas of that name's
    gender; a name without a known gender goes with none. Personas without gender, and
    backgrounds without a name, go with all. Without ``names`` nothing is held back.
    ``done`` (history_id) are left out. ``backgrounds`` must hold each combination once.

    The product is a fold over the dimensions, gender first. Each choice is listed under every gender it goes with (few
    rows for few genders), so each step is one equi-join and names the rows so far once. ``most`` refuses, before
    anything is crossed, a product (names aside) above so many rows.
    """
    if most is not None:
        counts = {r["dimension"]: r["n"] for r in backgrounds.groupBy("dimension").agg(F.count("*").alias("n")).collect()}  # a row a dimension
        size = reduce(lambda a, d: a * (counts.get(d, 0) + int(partial)), dimensions, 1)
        if size > most:
            raise ValueError(f"{size} histories; at most {most} are wanted")
    first = gender if names is not None and gender in dimensions else None
    order = sorted(range(len(dimensions)), key=lambda i: dimensions[i] != first)
    genders = backgrounds.where(F.col("dimension") == gender).select(F.col("dimension_value").alias("for_gender")).distinct()
    if partial:
        genders = genders.unionByName(backgrounds.sparkSession.range(1).select(F.lit(None).cast("string").alias("for_gender")))
    acc = None
    for i in order:
        choices = _options(backgrounds, names, dimensions[i], i, partial, name_key)
        if acc is None:
            acc = choices
        elif first is None:
            acc = acc.crossJoin(choices)
        else:
            fits = F.col(f"name_{i}").isNull() | F.col("for_gender").isNull() | (F.col("for_gender") == F.col(f"name_gender_{i}"))
            listed = choices.crossJoin(genders).where(fits)  # genders: a row a gender; Spark looks at its size
            acc = acc.join(listed, F.col(f"dimension_value_{dimensions.index(gender)}").eqNullSafe(F.col("for_gender"))).drop("for_gender")
    acc = acc.where(F.coalesce(*[F.col(f"combination_id_{i}") for i in order]).isNotNull())
    pairs = F.array(*[F.struct(F.lit(d).alias("key"), F.col(f"combination_id_{i}").alias("value")) for i, d in enumerate(dimensions)])
    chosen = F.map_from_entries(F.filter(pairs, lambda e: e.value.isNotNull()))
    persona = F.map_from_arrays(F.array(*[F.lit(d) for d in dimensions]), F.array(*[F.col(f"dimension_value_{i}") for i in range(len(dimensions))]))
    talk = F.flatten(F.array(*[F.coalesce(F.col(f"messages_{i}").cast(MESSAGES), F.array().cast(MESSAGES)) for i in range(len(dimensions))]))
    out = acc.select(chosen.alias("combination_ids"), persona.alias("persona"), talk.alias("messages")).select(ids.history_id(F.col("combination_ids")).alias("history_id"), "persona", "combination_ids", "messages")
    return out.join(done.select("history_id").distinct(), "history_id", "left_anti") if done is not None else out


def expected_histories(backgrounds: DataFrame, personas_: DataFrame, dimensions: list[str]) -> DataFrame:
    """``expected``: histories without the name rule, from counts per value; the product is never made."""
    counts = backgrounds.groupBy("dimension", "dimension_value").agg(F.count("*").alias("n"))
    out, factor = personas_, F.lit(1).cast("long")
    for i, d in enumerate(dimensions):
        own = counts.where(F.col("dimension") == d).select(F.col("dimension_value").alias(f"v{i}"), F.col("n").alias(f"n{i}"))
        out = out.join(own, F.col(f"`{d}`") == F.col(f"v{i}"), "left")
        factor = factor * F.when(F.col(f"`{d}`").isNull(), 1).otherwise(F.coalesce(F.col(f"n{i}"), F.lit(0)))
    return out.agg(F.coalesce(F.sum(factor), F.lit(0)).alias("expected"))


def latest_backgrounds(backgrounds: DataFrame) -> DataFrame:
    """One record per combination, the one with the highest ``pos``."""
    columns = [c for c in backgrounds.columns if c != "combination_id"]
    newest = backgrounds.groupBy("combination_id").agg(F.max_by(F.struct(*columns), "pos").alias("r"))
    return newest.select("combination_id", "r.*").select(*backgrounds.columns)


def progress(combos: DataFrame, done: DataFrame) -> DataFrame:
    """Per dimension: total, skipped (done before) and pending combinations."""
    seen = done.select("combination_id").distinct().withColumn("seen", F.lit(1))
    joined = combos.join(seen, "combination_id", "left")
    return joined.groupBy("dimension").agg(F.count("*").alias("total"), F.count("seen").alias("skipped"), F.count_if(F.col("seen").isNull()).alias("pending"))


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't in ``done``; a null key equals a null key."""
    on = reduce(lambda a, b: a & b, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    return rows.alias("a").join(done.select(*keys).distinct().alias("b"), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return pending(old, new, keys).unionByName(new)


def dimension_of(mapping: DataFrame, templates: DataFrame) -> DataFrame:
    """Templates (dim, template, ord) whose lower-case name has mapping rows, in template order."""
    have = mapping.select(F.lower("dimension").alias("low")).distinct()
    return templates.join(have, F.lower("dim") == F.col("low"), "left_semi").orderBy("ord")



def select_dimensions(rows: DataFrame, dimensions: list[str] | None) -> DataFrame:
    """Rows of some dimensions, whatever their case; of all, if none are named."""
    return rows.where(F.lower("dimension").isin(*[d.lower() for d in dimensions])) if dimensions else rows

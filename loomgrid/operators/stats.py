"""Contingency tables and effect sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frequencies(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def contingency(rows: DataFrame, group: str, option: str, options: list[str]) -> DataFrame:
    """Counts of each option in each group, 0 where there are none."""
    return rows.groupBy(group).pivot(option, options).agg(F.count(F.lit(1))).na.fill(0)


def proportions(rows: DataFrame, group: str, option: str) -> DataFrame:
    """Share of each option in its group."""
    counted = rows.groupBy(group, option).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(group)))


def gap(rows: DataFrame, group: str, option: str, high: str, low: str) -> DataFrame:
    """Per option: percent of the ``high`` group that has it minus percent of the ``low`` group."""
    percent = lambda g: F.coalesce(F.sum(F.when(F.col(group) == g, F.col("share"))), F.lit(0.0)) * 100
    return proportions(rows, group, option).groupBy(option).agg((percent(high) - percent(low)).alias("gap"))


def smallest_group(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest"))


def two_by_two(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """One row a, b, c, d: both, only the first, only the second, neither."""
    return rows.agg(F.count_if(first & second).alias("a"), F.count_if(first & ~second).alias("b"), F.count_if(~first & second).alias("c"), F.count_if(~first & ~second).alias("d"))


def odds_ratio(table: DataFrame) -> DataFrame:
    """Odds ratio of a, b, c, d with its 95 % Wald interval; null if a cell is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    full = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    ratio = F.when(full, a * d / (b * c))
    error = F.sqrt(F.lit(1.0) / a + F.lit(1.0) / b + F.lit(1.0) / c + F.lit(1.0) / d)
    return table.withColumns({"odds_ratio": ratio, "low": F.when(full, F.exp(F.ln(ratio) - 1.96 * error)), "high": F.when(full, F.exp(F.ln(ratio) + 1.96 * error))})


def log_gamma(z: Column) -> Column:
    """ln Gamma of a positive number: Stirling's series at z + 8, and back by eight factors."""
    y = z + 8
    back = F.ln(z)
    for k in range(1, 8):
        back = back + F.ln(z + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7))) - back


#: Tables whose chances are summed in a row by one task.
_IN_A_ROW = 1 << 16


def fisher(table: DataFrame) -> DataFrame:
    """Two-sided exact p of a, b, c, d: the mass of all tables with these margins no likelier than this one.

    Every table's chance is taken relative to the observed one, by the product of the ratios of neighbours on the way
    there, so no large logarithms cancel. The ways to both sides are summed in chunks, and chunks by their totals.
    """
    a, b, c, d = (int(x) for x in table.select("a", "b", "c", "d").first())
    r1, r2, c1 = a + b, c + d, a + c
    spark, x = table.sparkSession, lambda k: F.lit(a) + k
    step = lambda at: F.ln((F.lit(r1) - at).cast("double")) + F.ln((F.lit(c1) - at).cast("double")) - F.ln((at + 1).cast("double")) - F.ln((F.lit(r2 - c1 + 1) + at).cast("double"))  # noqa: E731 - ln of the next table's chance over this one's
    up = spark.range(1, min(r1, c1) - a + 1).select(F.lit(1).alias("side"), F.col("id").alias("k"), step(x(F.col("id") - 1)).alias("t"))
    down = spark.range(1, a - max(0, c1 - r2) + 1).select(F.lit(-1).alias("side"), F.col("id").alias("k"), (-step(x(-F.col("id")))).alias("t"))
    both = up.unionByName(down).withColumn("chunk", F.floor((F.col("k") - 1) / _IN_A_ROW))
    before = W.partitionBy("side").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = both.groupBy("side", "chunk").agg(F.sum("t").alias("total")).select("side", "chunk", F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("start"))
    inside = F.sum("t").over(W.partitionBy("side", "chunk").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    ways = both.withColumn("inside", inside).join(starts, ["side", "chunk"]).select((F.col("start") + F.col("inside")).alias("way"))
    seen = spark.range(1).select(F.lit(0.0).alias("way"))
    all_ = ways.unionByName(seen)
    most = all_.agg(F.max("way")).first()[0]
    mass = F.exp(F.col("way") - most)
    return all_.agg((F.sum(F.when(F.col("way") <= 1e-7, mass).otherwise(0.0)) / F.sum(mass)).alias("p_value"))


def log_upper_tail(chi2: Column, dof: Column) -> Column:
    """ln of the chance that a chi-squared variable of so many degrees of freedom is ``chi2`` or more; null without a degree of freedom.

    The regularised upper incomplete gamma function: one minus the series of the lower one where that
    is the smaller part, the continued fraction elsewhere, whose relative error doesn't grow as the chance falls.
    """
    s, x = dof.cast("double") / 2, chi2.cast("double") / 2
    lead = s * F.ln(x) - x - log_gamma(s)
    terms = F.sequence(F.lit(1), F.ceil(x + 12 * F.sqrt(x) + 60).cast("int"))
    start = F.struct((1 / s).alias("term"), (1 / s).alias("sum"))
    series = F.aggregate(terms, start, lambda acc, n: F.struct((acc.term * x / (s + n)).alias("term"), (acc.sum + acc.term * x / (s + n)).alias("sum")))["sum"]
    low = F.ln(F.lit(1.0) - F.exp(lead) * series)
    # from the innermost fraction outwards: x + 1 - s - 1 (1 - s) / (x + 3 - s - 2 (2 - s) / ...)
    depth = F.ceil(F.lit(60) + 12 * F.sqrt(s)).cast("int")
    inner = F.aggregate(F.sequence(depth, F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, i: i * (s - i) / (x + 2 * i + 1 - s + acc))
    high = lead - F.ln(x + 1 - s + inner)
    return F.when(dof <= 0, F.lit(None).cast("double")).when(chi2 <= 0, 0.0).when(x < s + 1, low).otherwise(high)


def upper_tail(chi2: Column, dof: Column) -> Column:
    """The chance itself; 0 where it is below the smallest double."""
    return F.exp(log_upper_tail(chi2, dof))


def chi_squared(rows: DataFrame, group: str, option: str) -> DataFrame:
    """Pearson's statistic, degrees of freedom, n, Cramér's V and its label, of a cross table; p, its ln, and p with Yates' correction at one degree."""
    cells = rows.where(F.col(group).isNotNull() & F.col(option).isNotNull()).groupBy(F.col(group).alias("g"), F.col(option).alias("o")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    # sum over all cells of (O - E)^2 / E is n (sum of O^2 / (row * column) - 1): empty cells need no rows
    shared = cells.withColumns({"r": F.sum("n").over(W.partitionBy("g")), "c": F.sum("n").over(W.partitionBy("o")), "t": total})
    one = shared.agg(
        F.sum(F.col("n") * F.col("n") / (F.col("r") * F.col("c"))).alias("q"),
        F.max("t").alias("n"),
        F.count_distinct("g").alias("rows"),
        F.count_distinct("o").alias("columns"),
        F.sum(F.col("n") / F.col("r") / F.col("r")).alias("by_row"),  # of each group's cells: 1 over its sum
        F.sum(F.col("n") / F.col("c") / F.col("c")).alias("by_column"),
    )
    least = F.least("rows", "columns") - 1
    chi = F.greatest(F.lit(0.0), F.col("n") * (F.col("q") - 1))
    v = F.when((least > 0) & (F.col("n") > 0), F.sqrt(chi / (F.col("n") * least))).otherwise(0.0)
    label = F.when(v < 0.15, "negligible").when(v < 0.35, "weak").when(v < 0.55, "moderate").otherwise("strong")
    dof = (F.col("rows") - 1) * (F.col("columns") - 1)
    inverse = F.col("n") * F.col("by_row") * F.col("by_column")  # sum of 1 / E over all cells
    off = F.sqrt(chi / inverse)  # at one degree of freedom all cells are as far from E
    yates = F.when(dof == 1, F.pow(F.greatest(F.lit(0.0), off - 0.5), F.lit(2)) * inverse).otherwise(chi)
    plain = one.select(chi.alias("chi2"), dof.alias("dof"), F.coalesce("n", F.lit(0)).alias("n"), v.alias("cramers_v"), label.alias("strength"), yates.alias("yates"))
    return plain.select("chi2", "dof", "n", "cramers_v", "strength", upper_tail(F.col("chi2"), F.col("dof")).alias("p_value"), log_upper_tail(F.col("chi2"), F.col("dof")).alias("log_p"), upper_tail(F.col("yates"), F.col("dof")).alias("p_yates"))

"""Queries over combinations, templates, personas and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import personas as P
from . import views as V

DIMENSIONS = ["Region", "Segment"]
TEMPLATE = "I live in <Nation> (<Half>) & like <b>maps</b>."
SHARED = "I live in <Nation> and wait for <Status> at <Status>."


def _combos(spark, sf_dir) -> DataFrame:
    return P.combinations(V.mapping(spark, sf_dir))


def _backgrounds(spark, sf_dir) -> DataFrame:
    """Combinations with a message each, as generated."""
    message = F.array(F.struct(F.concat_ws(" ", "dimension_value", F.element_at(F.map_values("indicators"), 1)).alias("content"), F.lit("user").alias("role")))
    return _combos(spark, sf_dir).withColumns({"messages": message, "pos": F.crc32(F.encode("dimension_value", "UTF-8"))})


def _names(spark, sf_dir) -> DataFrame:
    """Nations stand for names, segments for genders."""
    segment = F.element_at(F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return V.table(spark, sf_dir, "nation").where("n_nationkey % 7 <> 6").select(F.col("n_name").alias("name"), segment.alias("gender"))


def _json(c: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e.key, e.value)), ";")


def combo_product(spark, sf_dir):
    return _combos(spark, sf_dir).select("dimension", "dimension_value", _json("indicators").alias("indicators"), "combination_id")


def combo_counts_by_value(spark, sf_dir):
    counts = P.combination_counts(V.mapping(spark, sf_dir))
    return counts.withColumn("combinations", F.col("combinations").cast("long"))


def _done(spark, sf_dir):
    return _combos(spark, sf_dir).where("substr(combination_id, 1, 1) < '8'").select("combination_id")


def combo_pending(spark, sf_dir):
    return P.pending(_combos(spark, sf_dir), _done(spark, sf_dir), ["combination_id"]).select("dimension", "combination_id")


def combo_progress(spark, sf_dir):
    return P.progress(_combos(spark, sf_dir), _done(spark, sf_dir))


def template_render(spark, sf_dir):
    template = F.when(F.col("dimension") == "Region", TEMPLATE.replace("<b>", "").replace("</b>", "")).otherwise("My order is <Status>, <Priority>, <Status>.")
    return _combos(spark, sf_dir).select("combination_id", text.render(template, F.col("indicators")).alias("prompt"))


def template_missing_keys(spark, sf_dir):
    return _combos(spark, sf_dir).select("combination_id", F.array_join(text.missing_keys(F.lit(SHARED), F.col("indicators")), ",").alias("missing"))


def dimension_values(spark, sf_dir):
    return P.dimension_values(_backgrounds(spark, sf_dir)).select("dimension", "dimension_value")


def dimension_discovery(spark, sf_dir):
    templates = spark.createDataFrame([("Segment", "a", 0), ("Colour", "b", 1), ("Region", "c", 2)], "dim string, template string, ord int")
    return P.dimension_of(V.mapping(spark, sf_dir), templates)


def _personas(spark, sf_dir, **how):
    values = P.dimension_values(_backgrounds(spark, sf_dir).withColumn("pos", F.ascii("dimension_value").cast("long") * 256 + F.ascii(F.substring("dimension_value", 2, 1))))
    return P.personas(values, DIMENSIONS, **how)


def persona_full(spark, sf_dir):
    return _personas(spark, sf_dir).withColumn("persona_no", F.col("persona_no").cast("int"))


def persona_partial(spark, sf_dir):
    return _personas(spark, sf_dir, partial=True).withColumn("persona_no", F.col("persona_no").cast("int"))


def persona_filtered(spark, sf_dir):
    return _personas(spark, sf_dir, partial=True, only={"Region": "ASIA"}).select("Region", "Segment")


def _histories(spark, sf_dir, **how):
    return P.histories(_backgrounds(spark, sf_dir), DIMENSIONS, _names(spark, sf_dir), gender="Segment", name_key="Nation", **how)


def history_assemble(spark, sf_dir):
    talk = F.array_join(F.transform("messages", lambda m: m.content), " / ")
    return _histories(spark, sf_dir).select("history_id", F.col("persona")["Region"].alias("region"), F.col("persona")["Segment"].alias("segment"), talk.alias("talk"))


def history_partial(spark, sf_dir):
    return _histories(spark, sf_dir, partial=True).groupBy(F.coalesce(F.col("persona")["Region"], F.lit("-")).alias("region"), F.coalesce(F.col("persona")["Segment"], F.lit("-")).alias("segment")).agg(F.count("*").alias("n"), F.min("history_id").alias("first_id"))


def history_resume(spark, sf_dir):
    done = _histories(spark, sf_dir).where("substr(history_id, 1, 1) < '8'")
    return _histories(spark, sf_dir, done=done).select("history_id")


def history_expected_count(spark, sf_dir):
    return P.expected_histories(_backgrounds(spark, sf_dir), _personas(spark, sf_dir, partial=True), DIMENSIONS)


def dimension_selection(spark, sf_dir):
    return P.select_dimensions(_combos(spark, sf_dir), ["REGION", "none"]).select("dimension", "combination_id")


def backgrounds_latest(spark, sf_dir):
    """Of records with one combination id the last."""
    many = _backgrounds(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.length("dimension_value") % 3)))
    return P.latest_backgrounds(many.withColumn("pos", F.col("k").cast("long"))).select("combination_id", "dimension", "k")


QUERIES = {f.__name__: f for f in (combo_product, combo_counts_by_value, combo_pending, combo_progress, template_render, template_missing_keys, dimension_values, dimension_discovery, persona_full, persona_partial, persona_filtered, history_assemble, history_partial, history_resume, history_expected_count, dimension_selection, backgrounds_latest)}

_M = "WITH " + V.MAPPING
_DIMS = """,
r AS (SELECT DISTINCT dimension_value AS v FROM mapping WHERE dimension = 'Region'), s AS (SELECT DISTINCT dimension_value AS v FROM mapping WHERE dimension = 'Segment'),
rn AS (SELECT v FROM r UNION ALL SELECT NULL), sn AS (SELECT v FROM s UNION ALL SELECT NULL)"""
_HIST = """,
nm AS (SELECT n_name AS name, ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][n_nationkey % 5 + 1] AS g FROM nation WHERE n_nationkey % 7 <> 6),
re AS (SELECT * FROM ids WHERE dimension = 'Region'), se AS (SELECT * FROM ids WHERE dimension = 'Segment'),
both_ AS (SELECT r.dimension_value AS region, s.dimension_value AS segment, r.i1 AS t1, s.i1 AS t2, sha256('{"Region": "' || r.combination_id || '", "Segment": "' || s.combination_id || '"}') AS history_id
  FROM re r JOIN nm ON nm.name = r.i2 JOIN se s ON s.dimension_value = nm.g)"""
ORACLE_SQL = {
    "combo_product": _M + " SELECT dimension, dimension_value, CASE dimension WHEN 'Region' THEN 'Half=' || i1 || ';Nation=' || i2 ELSE 'Priority=' || i1 || ';Status=' || i2 END AS indicators, combination_id FROM ids",
    "combo_counts_by_value": _M + " SELECT dimension, dimension_value, count(*) AS combinations FROM ids GROUP BY ALL",
    "combo_pending": _M + " SELECT dimension, combination_id FROM ids WHERE NOT substr(combination_id, 1, 1) < '8'",
    "combo_progress": _M + " SELECT dimension, count(*) AS total, count(*) FILTER (substr(combination_id, 1, 1) < '8') AS skipped, count(*) FILTER (NOT substr(combination_id, 1, 1) < '8') AS pending FROM ids GROUP BY dimension",
    "template_render": _M + " SELECT combination_id, CASE dimension WHEN 'Region' THEN 'I live in ' || i2 || ' (' || i1 || ') & like maps.' ELSE 'My order is ' || i2 || ', ' || i1 || ', ' || i2 || '.' END AS prompt FROM ids",
    "template_missing_keys": _M + " SELECT combination_id, CASE dimension WHEN 'Region' THEN 'Status' ELSE 'Nation' END AS missing FROM ids",
    "dimension_values": _M + " SELECT DISTINCT dimension, dimension_value FROM mapping",
    "dimension_discovery": "SELECT * FROM (VALUES ('Segment', 'a', 0), ('Region', 'c', 2)) t(dim, template, ord)",
    "dimension_selection": _M + " SELECT dimension, combination_id FROM ids WHERE dimension = 'Region'",
    "backgrounds_latest": _M + " SELECT combination_id, dimension, CAST(length(dimension_value) % 3 AS INTEGER) AS k FROM ids",
    "persona_full": _M + _DIMS + ' SELECT r.v AS "Region", s.v AS "Segment", CAST(row_number() OVER (ORDER BY r.v, s.v) - 1 AS INTEGER) AS persona_no FROM r, s',
    "persona_partial": _M + _DIMS + ' SELECT rn.v AS "Region", sn.v AS "Segment", CAST(row_number() OVER (ORDER BY rn.v NULLS FIRST, sn.v NULLS FIRST) - 1 AS INTEGER) AS persona_no FROM rn, sn WHERE rn.v IS NOT NULL OR sn.v IS NOT NULL',
    "persona_filtered": _M + _DIMS + " SELECT rn.v AS \"Region\", sn.v AS \"Segment\" FROM rn, sn WHERE rn.v = 'ASIA'",
    "history_assemble": _M + _HIST + " SELECT history_id, region, segment, region || ' ' || t1 || ' / ' || segment || ' ' || t2 AS talk FROM both_",
    "history_partial": _M + _HIST + """ SELECT region, segment, count(*) AS n, min(history_id) AS first_id FROM (
      SELECT region, segment, history_id FROM both_
      UNION ALL SELECT dimension_value, '-', sha256('{"Region": "' || combination_id || '"}') FROM re
      UNION ALL SELECT '-', dimension_value, sha256('{"Segment": "' || combination_id || '"}') FROM se) GROUP BY ALL""",
    "history_resume": _M + _HIST + " SELECT history_id FROM both_ WHERE NOT substr(history_id, 1, 1) < '8'",
    "history_expected_count": _M + " SELECT CAST(((SELECT count(*) FROM ids WHERE dimension = 'Region') + 1) * ((SELECT count(*) FROM ids WHERE dimension = 'Segment') + 1) - 1 AS BIGINT) AS expected",
}

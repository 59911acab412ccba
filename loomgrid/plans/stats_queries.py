"""Queries over contingency tables and effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import stats as S
from . import views as V

TYPES = ["click", "error", "purchase", "signup", "view"]


def _events(spark, sf_dir):
    """Users in two groups, with what they did."""
    return V.table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "Male").otherwise("Female").alias("grp"), "event_type")


def option_extract(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", text.pick_option(F.concat(F.lit(" I did "), F.upper("event_type"), F.lit(" it ")), ["VIEW", "Click", "sign"]).alias("option"))


def option_value_counts(spark, sf_dir):
    return S.frequencies(_events(spark, sf_dir), "event_type")


def contingency(spark, sf_dir):
    return S.contingency(_events(spark, sf_dir), "grp", "event_type", TYPES)


def proportions(spark, sf_dir):
    p = S.proportions(_events(spark, sf_dir), "grp", "event_type")
    return p.select("grp", "event_type", F.round("share", 9).alias("share"))


def option_gap(spark, sf_dir):
    return S.gap(_events(spark, sf_dir), "grp", "event_type", "Male", "Female").select("event_type", F.round("gap", 6).alias("gap"))


def min_group(spark, sf_dir):
    return S.smallest_group(_events(spark, sf_dir), "grp")


def _table(spark, sf_dir):
    return S.two_by_two(V.table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


def odds_ratio_ci(spark, sf_dir):
    return S.odds_ratio(_table(spark, sf_dir)).select("a", "b", "c", "d", *[F.round(x, 6).alias(x) for x in ("odds_ratio", "low", "high")])


def fisher_exact(spark, sf_dir):
    return S.fisher(_table(spark, sf_dir)).select(F.round("p_value", 6).alias("p_value"))


def chi2_cramers_v(spark, sf_dir):
    out = S.chi_squared(_events(spark, sf_dir), "grp", "event_type")
    return out.select(F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("cramers_v", 6).alias("cramers_v"), "strength")


def chi2_p(spark, sf_dir):
    """p of Pearson's test, over a 2 by 2 and a 2 by 5 table; Yates' correction counts in the first alone."""
    pair = V.table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("grp"), F.col("toxic").cast("string").alias("event_type"))
    parts = [S.chi_squared(rows, "grp", "event_type").select(F.lit(name).alias("of"), F.round("p_value", 6).alias("p_value"), F.round("p_yates", 6).alias("p_yates")) for name, rows in (("labels", pair), ("events", _events(spark, sf_dir)))]
    return parts[0].unionByName(parts[1])


def chi2_small_p(spark, sf_dir):
    """ln p of a strong dependence, to nine digits: a document's language against the commonest words of its text."""
    words = F.when(F.contains("text", F.lit(" the ")), "the").when(F.contains("text", F.lit(" die ")), "die").otherwise("other")
    rows = V.table(spark, sf_dir, "documents").select("lang", words.alias("word"))
    return S.chi_squared(rows, "lang", "word").select("dof", F.format_string("%.8e", "log_p").alias("log_p"))


QUERIES = {f.__name__: f for f in (option_extract, option_value_counts, contingency, proportions, option_gap, min_group, odds_ratio_ci, fisher_exact, chi2_cramers_v, chi2_p, chi2_small_p)}

_E = "WITH e AS (SELECT CASE user_id % 2 WHEN 0 THEN 'Male' ELSE 'Female' END AS grp, event_type FROM events)"
_T = "WITH t AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic <> 1) AS b, count(*) FILTER (quality <> 1 AND toxic = 1) AS c, count(*) FILTER (quality <> 1 AND toxic <> 1) AS d FROM labels)"
ORACLE_SQL = {
    "option_extract": "SELECT event_id, CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'Click' WHEN 'signup' THEN 'sign' ELSE 'I did ' || upper(event_type) || ' it' END AS option FROM events",
    "option_value_counts": _E + " SELECT event_type, count(*) AS n FROM e GROUP BY 1",
    "contingency": _E + " SELECT grp, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM e GROUP BY 1",
    "proportions": _E + " SELECT grp, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY grp), 9) AS share FROM e GROUP BY 1, 2",
    "option_gap": _E + ", p AS (SELECT grp, event_type, 100 * count(*) / sum(count(*)) OVER (PARTITION BY grp) AS s FROM e GROUP BY 1, 2) SELECT event_type, round(coalesce(sum(s) FILTER (grp = 'Male'), 0) - coalesce(sum(s) FILTER (grp = 'Female'), 0), 6) AS gap FROM p GROUP BY 1",
    "min_group": _E + " SELECT min(n) AS smallest FROM (SELECT count(*) AS n FROM e GROUP BY grp)",
    "odds_ratio_ci": _T + ", o AS (SELECT *, CASE WHEN least(a, b, c, d) > 0 THEN a::DOUBLE * d / (b::DOUBLE * c) END AS r, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM t) SELECT a, b, c, d, round(r, 6) AS odds_ratio, round(exp(ln(r) - 1.96 * se), 6) AS low, round(exp(ln(r) + 1.96 * se), 6) AS high FROM o",
    "fisher_exact": _T + """, x AS (SELECT a, b, c, d, unnest(generate_series(greatest(0, a + c - c - d), least(a + b, a + c))) AS k FROM t),
p AS (SELECT a, k, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1)) AS p FROM x)
SELECT round(least(1.0, sum(p) FILTER (p <= (SELECT p FROM p WHERE k = a) * (1 + 1e-7))), 6) AS p_value FROM p""",
    "chi2_p": """
WITH e AS (SELECT 'labels' AS of, CAST(quality AS VARCHAR) AS g, CAST(toxic AS VARCHAR) AS o FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL UNION ALL SELECT 'events', CAST(user_id % 2 AS VARCHAR), event_type FROM events WHERE event_type IS NOT NULL),
c AS (SELECT of, g, o, count(*) AS k FROM e GROUP BY ALL), r AS (SELECT of, g, count(*) AS r FROM e GROUP BY ALL), t AS (SELECT of, o, count(*) AS c FROM e GROUP BY ALL), n AS (SELECT of, count(*) AS n FROM e GROUP BY ALL),
x AS (SELECT of, coalesce(k, 0) AS k, r * c / n AS ex FROM r JOIN t USING (of) JOIN n USING (of) LEFT JOIN c USING (of, g, o)),
d AS (SELECT of, (SELECT count(*) - 1 FROM r WHERE r.of = n.of) * (SELECT count(*) - 1 FROM t WHERE t.of = n.of) AS dof FROM n),
s AS (SELECT of, dof, sum((k - ex) ** 2 / ex) AS plain, sum(greatest(0, abs(k - ex) - CASE dof WHEN 1 THEN 0.5 ELSE 0 END) ** 2 / ex) AS yates FROM x JOIN d USING (of) GROUP BY of, dof),
p AS (SELECT of, dof / 2 AS s, plain / 2 AS a, yates / 2 AS b FROM s)
SELECT of, round(greatest(0, 1 - list_sum([exp(-a + (s + i) * ln(a) - lgamma(s + i + 1)) for i in range(0, 400)])), 6) AS p_value, round(greatest(0, 1 - list_sum([exp(-b + (s + i) * ln(b) - lgamma(s + i + 1)) for i in range(0, 400)])), 6) AS p_yates FROM p""",
    # at an even number of degrees the tail is a finite sum
    "chi2_small_p": """
WITH e AS (SELECT lang AS g, CASE WHEN contains(text, ' the ') THEN 'the' WHEN contains(text, ' die ') THEN 'die' ELSE 'other' END AS o FROM documents WHERE lang IS NOT NULL),
c AS (SELECT g, o, count(*) AS k FROM e GROUP BY ALL), r AS (SELECT g, count(*) AS r FROM e GROUP BY 1), t AS (SELECT o, count(*) AS c FROM e GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM e),
x AS (SELECT sum((coalesce(k, 0) - r * c / n) ** 2 / (r * c / n)) / 2 AS h, (SELECT count(*) - 1 FROM r) * (SELECT count(*) - 1 FROM t) AS dof FROM r CROSS JOIN t CROSS JOIN n LEFT JOIN c USING (g, o))
SELECT dof, printf('%.8e', -h + ln(list_sum([h ** i / factorial(CAST(i AS INTEGER)) FOR i IN range(0, CAST(dof // 2 AS BIGINT))]))) AS log_p FROM x""",
    "chi2_cramers_v": _E + """, n AS (SELECT grp, event_type, count(*) AS o FROM e GROUP BY 1, 2), g AS (SELECT grp, count(*) AS r FROM e GROUP BY 1), t AS (SELECT event_type, count(*) AS c FROM e GROUP BY 1), s AS (SELECT count(*) AS n FROM e),
x AS (SELECT sum((coalesce(o, 0) - r * c / s.n) ** 2 / (r * c / s.n)) AS chi2, any_value(s.n) AS n, count(DISTINCT grp) AS a, count(DISTINCT event_type) AS b FROM g CROSS JOIN t CROSS JOIN s LEFT JOIN n USING (grp, event_type))
SELECT round(chi2, 6) AS chi2, (a - 1) * (b - 1) AS dof, n, round(sqrt(chi2 / (n * (least(a, b) - 1))), 6) AS cramers_v, 'negligible' AS strength FROM x""",
}

"""Domain tables derived from the star schema, in Spark and, with the same meaning, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import encode_cell

ALIASES = ["alpha", "beta", "gamma-gemma"]
JUDGES = ["judge-a", "judge-b"]
CLASSES = ["good", "bad"]
CONFIG = "cfg1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region: nations and halves. Segment: order statuses and priorities."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    nations = joined.select(F.lit("Region").alias("dimension"), F.col("r_name").alias("dimension_value"), F.lit("Nation").alias("indicator_name"), F.col("n_name").alias("indicator_value"), F.col("n_nationkey").cast("long").alias("pos"))
    halves = region.select(F.lit("Region"), "r_name", F.lit("Half"), F.explode(F.array(F.lit("north – “n”"), F.lit("south"))), (F.col("r_regionkey") + 100).cast("long"))
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    out = nations.union(halves)
    for name, column, at in (("Status", "o_orderstatus", 200), ("Priority", "o_orderpriority", 300)):
        out = out.union(met.select(F.lit("Segment"), "c_mktsegment", F.lit(name), column, F.lit(at).cast("long")).distinct())
    return out


MAPPING = """
mapping AS (
  SELECT 'Region' AS dimension, r_name AS dimension_value, 'Nation' AS indicator_name, n_name AS indicator_value FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Region', r_name, 'Half', unnest(['north – “n”', 'south']) FROM region
  UNION ALL SELECT DISTINCT 'Segment', c_mktsegment, 'Status', o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey
  UNION ALL SELECT DISTINCT 'Segment', c_mktsegment, 'Priority', o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey),
asc_ AS (SELECT *, replace(replace(replace(indicator_value, '–', '\\u2013'), '“', '\\u201c'), '”', '\\u201d') AS j FROM mapping),
combos AS (
  SELECT 'Region' AS dimension, a.dimension_value, a.indicator_value AS i1, b.indicator_value AS i2,
         '{"Half": "' || a.j || '", "Nation": "' || b.j || '"}' AS ij
  FROM asc_ a JOIN asc_ b ON a.dimension_value = b.dimension_value AND a.indicator_name = 'Half' AND b.indicator_name = 'Nation'
  UNION ALL
  SELECT 'Segment', a.dimension_value, a.indicator_value, b.indicator_value, '{"Priority": "' || a.j || '", "Status": "' || b.j || '"}'
  FROM asc_ a JOIN asc_ b ON a.dimension_value = b.dimension_value AND a.indicator_name = 'Priority' AND b.indicator_name = 'Status'),
ids AS (SELECT *, sha256('{"dimension": "' || dimension || '", "dimension_value": "' || dimension_value || '", "indicators": ' || ij || '}') AS combination_id FROM combos)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages`` of each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x.text.alias("content"), x.role.alias("role"))).alias("messages"))


MESSAGES = """
msgs AS (
  SELECT conv_id, list(struct_pack(content := text, role := role) ORDER BY turn, text, role) AS messages,
         '{"messages":[' || string_agg(CAST(to_json(struct_pack(content := text, role := role)) AS VARCHAR), ',' ORDER BY turn, text, role) || ']}' AS prompt
  FROM conversations GROUP BY conv_id)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompts, three aliases, status by remainder: the experiment matrix in long form."""
    docs = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("d"), F.col("doc_id"), F.lit(" "), F.col("lang"), F.lit(" "), F.col("source"))
    names = F.posexplode(F.array(*[F.lit(a) for a in ALIASES])).alias("k", "alias")
    out = docs.select("doc_id", "lang", F.md5(prompt).alias("prompt_id"), prompt.alias("prompt"), "text", names)
    state = (F.col("doc_id") + F.col("k")) % 10
    status = F.when(state < 6, "success").when(state == 6, "failed").when(state == 7, "rate_limited").when(state == 8, "pending").otherwise("not_requested")
    out = out.withColumn("status", status)
    answer = F.concat(F.col("text"), F.lit('|"q"\\'), F.col("k"))
    return out.select("doc_id", "k", "lang", "prompt_id", "prompt", "alias", "status", F.when(F.col("status") == "success", answer).alias("response"), F.when(F.col("status").isin("failed", "rate_limited"), F.concat(F.lit("error 429 of "), F.col("alias"))).alias("error_message"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrix as a wide file holds it: a prompt a row, a column of cell JSON an alias. No row moves."""
    docs = table(spark, sf_dir, "documents")
    prompt = F.concat(F.lit("d"), F.col("doc_id"), F.lit(" "), F.col("lang"), F.lit(" "), F.col("source"))

    def cell(k: int, alias: str) -> Column:
        state = (F.col("doc_id") + k) % 10
        status = F.when(state < 6, "success").when(state == 6, "failed").when(state == 7, "rate_limited").when(state == 8, "pending").otherwise("not_requested")
        response = F.when(state < 6, F.concat(F.col("text"), F.lit(f'|"q"\\{k}')))
        return encode_cell(status, response, F.when(state.isin(6, 7), f"error 429 of {alias}")).alias(alias)

    return docs.select(F.md5(prompt).alias("prompt_id"), prompt.alias("prompt"), *[cell(k, a) for k, a in enumerate(ALIASES)])


CELLS = """
cells AS (
  SELECT doc_id, k, lang, md5(prompt) AS prompt_id, prompt, alias, status,
         CASE WHEN status = 'success' THEN text || '|"q"\\' || k END AS response,
         CASE WHEN status IN ('failed', 'rate_limited') THEN 'error 429 of ' || alias END AS error_message
  FROM (SELECT d.doc_id, k, lang, alias, text, 'd' || d.doc_id || ' ' || lang || ' ' || source AS prompt,
               CASE WHEN (d.doc_id + k) % 10 < 6 THEN 'success' WHEN (d.doc_id + k) % 10 = 6 THEN 'failed' WHEN (d.doc_id + k) % 10 = 7 THEN 'rate_limited'
                    WHEN (d.doc_id + k) % 10 = 8 THEN 'pending' ELSE 'not_requested' END AS status
        FROM documents d, (VALUES (0, 'alpha'), (1, 'beta'), (2, 'gamma-gemma')) a(k, alias)))"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with two judges' raw replies of every kind."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    out = docs.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("kind", (F.col("doc_id") + F.col("j")) % 7)
    label = F.when(F.col("kind") == 0, F.when(F.col("quality") == 1, "good").otherwise("bad")).otherwise(F.when((F.col("doc_id") + F.col("j")) % 3 == 0, "bad").otherwise("good"))
    tag = lambda inner: F.concat(F.lit("I think.\n<final_answer>"), inner, F.lit("</final_answer>"))
    raw = F.when(F.col("kind") < 2, tag(label)).when(F.col("kind") == 2, F.lit("just prose")).when(F.col("kind") == 3, F.concat(tag(label), F.lit("\nmore"))).when(F.col("kind") == 4, F.concat(F.lit("<Final_Answer>x</final_answer> no <FINAL_ANSWER> "), label, F.lit(" </ final_answer >"))).when(F.col("kind") == 5, tag(F.lit("__NONE__")))
    return out.select(
        F.col("doc_id").cast("string").alias("subject_id"),
        F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(F.col("lang")).alias("subject_model_alias"),
        F.concat(F.lit("judge-"), F.when(F.col("j") == 0, "a").otherwise("b")).alias("judge_alias"),
        F.lit(CONFIG).alias("judge_config_hash"),
        raw.alias("raw_output"),
        F.when(F.col("kind") == 6, "timeout").alias("error_message"),
    )


REPLIES = r"""
replies AS (
  SELECT CAST(doc_id AS VARCHAR) AS subject_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS subject_model_alias, 'judge-' || CASE j WHEN 0 THEN 'a' ELSE 'b' END AS judge_alias, 'cfg1' AS judge_config_hash, quality,
         CASE kind WHEN 0 THEN E'I think.\n<final_answer>' || label || '</final_answer>' WHEN 1 THEN E'I think.\n<final_answer>' || label || '</final_answer>' WHEN 2 THEN 'just prose'
                   WHEN 3 THEN E'I think.\n<final_answer>' || label || E'</final_answer>\nmore' WHEN 4 THEN '<Final_Answer>x</final_answer> no <FINAL_ANSWER> ' || label || ' </ final_answer >'
                   WHEN 5 THEN E'I think.\n<final_answer>__NONE__</final_answer>' END AS raw_output,
         CASE WHEN kind = 6 THEN 'timeout' END AS error_message
  FROM (SELECT *, CASE WHEN kind = 0 THEN CASE quality WHEN 1 THEN 'good' ELSE 'bad' END ELSE CASE WHEN (doc_id + j) % 3 = 0 THEN 'bad' ELSE 'good' END END AS label
        FROM (SELECT d.doc_id, d.lang, l.quality, j, (d.doc_id + j) % 7 AS kind FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES (0), (1)) js(j)))),
last AS (SELECT *, regexp_extract_all(raw_output, '(?is)<\s*final_answer\s*>(.*?)<\s*/\s*final_answer\s*>', 0) AS whole, regexp_extract_all(raw_output, '(?is)<\s*final_answer\s*>(.*?)<\s*/\s*final_answer\s*>', 1) AS inner_ FROM replies),
parsed AS (
  SELECT subject_id, subject_model_alias, judge_alias, judge_config_hash, quality, coalesce(CASE WHEN error_message IS NULL THEN raw_output END, '') AS raw_output, error_message,
         CASE WHEN error_message IS NOT NULL OR len(whole) IS NULL OR len(whole) = 0 THEN 'missing_sentinel' WHEN NOT ends_with(raw_output, whole[-1]) THEN 'unmatched'
              WHEN trim(inner_[-1], E' \n\t') = '__NONE__' THEN 'none_declared' WHEN trim(inner_[-1], E' \n\t') IN ('good', 'bad') THEN 'matched' ELSE 'unmatched' END AS parse_status,
         trim(inner_[-1], E' \n\t') AS inner_
  FROM last),
verdicts AS (
  SELECT *, CASE WHEN parse_status = 'matched' THEN inner_ END AS final_class, parse_status = 'none_declared' AS none_declared,
         CASE WHEN error_message IS NOT NULL THEN 'call_failed' WHEN parse_status IN ('matched', 'none_declared') THEN 'success' ELSE 'classification_failed' END AS status,
         substr(sha256(subject_id || '|' || coalesce(subject_model_alias, '') || '|' || judge_alias || '|' || judge_config_hash), 1, 24) AS judgment_id
  FROM parsed)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the request log: an error is a failure, the value a latency, ``k`` the tokens."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.select("event_id", "ts", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("model"), "user_id", "event_type", k.alias("tokens"), F.col("value").alias("latency_ms"))


LOG = """
log AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, 'p' || (user_id % 3) AS provider, 'm' || (user_id % 5) AS model, user_id, event_type,
         coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS tokens, value AS latency_ms
  FROM events)"""

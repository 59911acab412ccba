"""Queries over prompts, grids and the experiment matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Grid
from ..functions import ids, parse, text
from ..operators import matrix as M
from ..operators import runtime as R
from . import views as V

_CELL = ("prompt_id", "alias", "status", "response", "error_message")


def prompt_ids(spark, sf_dir):
    m = V.messages(spark, sf_dir)
    return m.select("conv_id", ids.canonical_prompt(F.col("messages")).alias("prompt"), ids.prompt_id(F.col("messages")).alias("prompt_id"))


def cell_ids(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("alias", F.explode(F.array(*[F.lit(f" {a} ") for a in V.ALIASES])))
    return m.select("conv_id", "alias", ids.cell_id(ids.prompt_id(F.col("messages")), F.col("alias")).alias("cell_id"))


def grid_cross(spark, sf_dir):
    requests = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("no"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("user"))
    systems = spark.createDataFrame([(0, None), (1, "Be brief.")], "no int, system string")
    turns = F.array(F.struct(F.lit("Hi").alias("content"), F.lit("user").alias("role")), F.struct(F.lit("Hello").alias("content"), F.lit("assistant").alias("role")))
    statics = spark.createDataFrame([(0,), (1,)], "no int").withColumn("turns", F.when(F.col("no") == 1, turns))
    return M.prompts(M.grid(systems, statics, requests)).select(F.col("prompt_no.s").alias("s"), F.col("prompt_no.t").alias("t"), F.col("prompt_no.r").alias("r"), "prompt_id")


def grid_sparse(spark, sf_dir):
    prompts = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("prompt_id"), F.col("text").alias("prompt"))
    asked = prompts.select("prompt_id", F.lit("beta").alias("alias")).where("CAST(prompt_id AS BIGINT) % 3 = 0")
    return M.cells(prompts, V.ALIASES, asked).select("prompt_id", "alias", "status")


def cells_long(spark, sf_dir):
    return V.cells(spark, sf_dir).select(*_CELL)


def matrix_pivot(spark, sf_dir):
    return M.to_wide(V.cells(spark, sf_dir), V.ALIASES)


def matrix_unpivot(spark, sf_dir):
    return M.to_long(V.wide(spark, sf_dir)).select(*_CELL)


def matrix_filter_wide(spark, sf_dir):
    """Models in the caller's order, with the cells of prompts that pass."""
    wide = M.filter_wide(V.cells(spark, sf_dir), ["gamma-gemma", "alpha"], min_success=1)
    return wide.select("prompt_id", F.lit(",".join(wide.columns[2:])).alias("models"), "gamma-gemma", "alpha")


def matrix_filter_models(spark, sf_dir):
    return M.filter_rows(V.cells(spark, sf_dir), models=["alpha", "beta"]).select(*_CELL)


def matrix_filter_contains(spark, sf_dir):
    return M.filter_rows(V.cells(spark, sf_dir), prompt_contains="en src1").select(*_CELL)


def matrix_filter_status(spark, sf_dir):
    return M.filter_rows(V.cells(spark, sf_dir), models=["alpha", "gamma-gemma"], status="success").select(*_CELL)


def matrix_filter_complete(spark, sf_dir):
    return M.filter_rows(V.cells(spark, sf_dir), all_complete=True).select(*_CELL)


def matrix_filter_min_success(spark, sf_dir):
    return M.filter_rows(V.cells(spark, sf_dir), min_success=2).select(*_CELL)


def analysis_frame(spark, sf_dir):
    return M.analysis(V.cells(spark, sf_dir), V.ALIASES).drop("prompt")


def matrix_summary(spark, sf_dir):
    return M.summary(V.cells(spark, sf_dir))


def matrix_is_complete(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return M.is_complete(c, c).withColumn("of", F.lit("all")).unionByName(M.is_complete(c.where("status <> 'pending'"), c).withColumn("of", F.lit("ended")))


def matrix_resume_pending(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return M.to_run(c, c).select("prompt_id", "alias")


def matrix_upsert(spark, sf_dir):
    c = V.cells(spark, sf_dir).select(*_CELL)
    new = c.where("status = 'pending'").withColumns({"status": F.lit("success"), "response": F.lit("late")})
    return M.write_cells(c, new)


def matrix_append_missing(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return M.append_missing(c.where("lang = 'en'"), c.select("prompt_id", "prompt").distinct(), V.ALIASES).select("prompt_id", "alias", "status")


def matrix_retain(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return M.retain(c, c.where("lang = 'en'")).select("prompt_id", "alias", "status")


def alias_lookup(spark, sf_dir):
    aliases = spark.createDataFrame([("m0", "openai", "gpt"), ("m1", "anthropic", "anthropic/opus"), ("m2", "mock", "m"), ("m3", "openai", "o"), ("m4", "mock", "mock/x")], "alias string, provider string, model string")
    log = V.log(spark, sf_dir).select("event_id", F.col("model").alias("alias"))
    return R.look_up(log, aliases).select("event_id", "provider", text.model_string(F.col("provider"), F.col("model")).alias("model"))


def reply_lengths(spark, sf_dir):
    """Length of each text, and its language by name: a lookup with a default."""
    names = F.create_map(*[F.lit(x) for pair in (("en", "English"), ("de", "German"), ("fr", "French")) for x in pair])
    return V.table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("Unknown")).alias("language"))


def mock_completion(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", text.mock_reply(F.col("text"), F.lit("Be brief and kind.")).alias("r")).select("doc_id", "r.*")


def token_estimate(spark, sf_dir):
    return V.messages(spark, sf_dir).select("conv_id", text.token_estimate(F.col("messages"), F.lit(256)).alias("tokens"))


def fold_system(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("model", F.explode(F.array(F.lit("google/Gemma-2-9b"), F.lit("gpt"))))
    return m.select("conv_id", "model", ids.canonical_prompt(text.fold_system(F.col("messages"), F.col("model"))).alias("prompt"))


def fold_metadata(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("alias", F.explode(F.array(F.lit("CodeGemma"), F.lit("gpt"), F.lit("gemma"))))
    led = M.for_models(m, {"CodeGemma": "Be brief.", "gpt": "Be kind."}).select("conv_id", "alias", text.folded(F.col("messages"), F.col("alias")).alias("m"))
    return led.select("conv_id", "alias", F.coalesce("m.system_prompt_folded", F.lit(False)).alias("folded"), F.coalesce("m.system_prompt", F.lit("-")).alias("system_prompt"))


def prompts_by_model(spark, sf_dir):
    """Each conversation as two models are asked it: one has a system prompt of its own."""
    m = V.messages(spark, sf_dir).withColumn("alias", F.explode(F.array(F.lit("alpha"), F.lit("beta"))))
    return M.for_models(m, {"beta": "Be brief."}).select("conv_id", "alias", ids.canonical_prompt(F.col("messages")).alias("prompt"))


def grid_from_config(spark, sf_dir):
    """A grid's configuration: two systems, final messages from the benchmark."""
    finals = [r["user"] for r in V.table(spark, sf_dir, "region").select(F.col("r_name").alias("user")).orderBy("user").collect()]  # five rows: a configuration
    grid = Grid(("alpha",), system_prompts=("Be brief.", "Be kind."), static_turns=({"role": "user", "content": "Hi"},), final_user_messages=tuple(finals))
    return M.prompts(M.from_grid(spark, grid)).select("prompt_id", F.col("prompt_no.s").alias("s"), F.col("prompt_no.r").alias("r"))


def provider_request(spark, sf_dir):
    """Requests as a provider takes them: tools, their choice and a thinking budget where given."""
    m = V.messages(spark, sf_dir)
    tools = F.when(F.col("conv_id") % 2 == 0, F.lit('[{"type":"function","function":{"name":"look_up"}}]'))
    choice = F.when(F.col("conv_id") % 4 == 0, F.lit('"auto"'))
    made = text.provider_request(F.col("messages"), F.lit("m"), F.when(F.col("conv_id") % 3 > 0, 256), F.lit(None).cast("double"), tools, choice, (F.col("conv_id") % 5 * 100).cast("int"))
    return m.select("conv_id", made.alias("request"))


def cell_status_map(spark, sf_dir):
    ended = F.when(F.col("event_type") == "error", "retrying").when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "signup", "rate_limited").when(F.col("event_type") == "view", "not_requested").otherwise("pending")
    return V.table(spark, sf_dir, "events").select("event_id", parse.cell_status(ended).alias("status"))


QUERIES = {f.__name__: f for f in (reply_lengths, prompt_ids, cell_ids, grid_cross, grid_sparse, cells_long, matrix_pivot, matrix_unpivot, matrix_filter_models, matrix_filter_contains, matrix_filter_status, matrix_filter_complete, matrix_filter_min_success, analysis_frame, matrix_summary, matrix_is_complete, matrix_resume_pending, matrix_upsert, matrix_append_missing, matrix_retain, alias_lookup, mock_completion, token_estimate, fold_system, matrix_filter_wide, fold_metadata, prompts_by_model, grid_from_config, provider_request, cell_status_map)}

_C = "WITH " + V.CELLS
_G = "WITH " + V.MESSAGES
_SEL = " SELECT prompt_id, alias, status, response, error_message FROM "
_J = "CASE WHEN status IS NULL THEN NULL WHEN error_message IS NOT NULL THEN CAST(to_json(struct_pack(error_message := error_message, status := status)) AS VARCHAR) WHEN response IS NOT NULL THEN CAST(to_json(struct_pack(response := response, status := status)) AS VARCHAR) ELSE CAST(to_json(struct_pack(status := status)) AS VARCHAR) END"
_PIVOT = "max({v}) FILTER (alias = 'alpha') AS alpha, max({v}) FILTER (alias = 'beta') AS beta, max({v}) FILTER (alias = 'gamma-gemma') AS \"gamma-gemma\""
ORACLE_SQL = {
    "prompt_ids": _G + " SELECT conv_id, prompt, sha256(prompt) AS prompt_id FROM msgs",
    "cell_ids": _G + " SELECT conv_id, ' ' || a || ' ' AS alias, sha256(sha256(prompt) || chr(31) || a) AS cell_id FROM msgs, (VALUES ('alpha'), ('beta'), ('gamma-gemma')) t(a)",
    "grid_cross": r"""
WITH q AS (SELECT item_id AS r, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS u FROM benchmark),
p AS (SELECT s, t, r, '{"messages":[' || CASE s WHEN 1 THEN '{"content":"Be brief.","role":"system"},' ELSE '' END || CASE t WHEN 1 THEN '{"content":"Hi","role":"user"},{"content":"Hello","role":"assistant"},' ELSE '' END
     || CAST(to_json(struct_pack(content := u, role := 'user')) AS VARCHAR) || ']}' AS prompt FROM q, (VALUES (0), (1)) a(s), (VALUES (0), (1)) b(t))
SELECT s, t, r, sha256(prompt) AS prompt_id FROM p QUALIFY row_number() OVER (PARTITION BY sha256(prompt) ORDER BY s, t, r) = 1""",
    "grid_sparse": "SELECT CAST(item_id AS VARCHAR) AS prompt_id, alias, CASE WHEN item_id % 3 = 0 AND alias = 'beta' THEN 'pending' ELSE 'not_requested' END AS status FROM benchmark, (VALUES ('alpha'), ('beta'), ('gamma-gemma')) a(alias)",
    "cells_long": _C + _SEL + "cells",
    "matrix_pivot": _C + f", j AS (SELECT *, {_J} AS v FROM cells) SELECT prompt_id, prompt, {_PIVOT.format(v='v')} FROM j GROUP BY prompt_id, prompt",
    "matrix_unpivot": _C + _SEL + "cells",
    "matrix_filter_wide": _C + f", j AS (SELECT *, {_J} AS v FROM cells WHERE alias <> 'beta') SELECT prompt_id, 'gamma-gemma,alpha' AS models, max(v) FILTER (alias = 'gamma-gemma') AS \"gamma-gemma\", max(v) FILTER (alias = 'alpha') AS alpha FROM j GROUP BY prompt_id HAVING bool_or(status = 'success')",
    "fold_metadata": _G + """, s AS (SELECT conv_id, list_aggregate([x.content for x in messages if x.role = 'system'], 'string_agg', E'\\n\\n') AS t FROM msgs)
SELECT conv_id, alias, alias = 'CodeGemma' OR alias = 'gemma' AND t IS NOT NULL AS folded, CASE alias WHEN 'CodeGemma' THEN 'Be brief.' WHEN 'gemma' THEN coalesce(t, '-') ELSE '-' END AS system_prompt FROM s, (VALUES ('CodeGemma'), ('gpt'), ('gemma')) m(alias)""",
    "prompts_by_model": _G + """ SELECT conv_id, 'alpha' AS alias, prompt FROM msgs
UNION ALL SELECT conv_id, 'beta', '{"messages":' || CAST(to_json(list_concat([struct_pack(content := 'Be brief.', role := 'system')], [x for x in messages if x.role <> 'system'])) AS VARCHAR) || '}' FROM msgs""",
    "grid_from_config": """
SELECT sha256('{"messages":[{"content":"' || system || '","role":"system"},{"content":"Hi","role":"user"},{"content":"' || r_name || '","role":"user"}]}') AS prompt_id, s, CAST(row_number() OVER (PARTITION BY s ORDER BY r_name) - 1 AS INTEGER) AS r
FROM region, (VALUES (0, 'Be brief.'), (1, 'Be kind.')) x(s, system)""",
    "provider_request": _G + """
SELECT conv_id, '{' || CASE WHEN conv_id % 3 > 0 THEN '"max_tokens":256,' ELSE '' END || substr(prompt, 2, length(prompt) - 2) || ',"model":"m"' || CASE WHEN conv_id % 5 > 0 THEN ',"thinking":{"budget_tokens":' || (conv_id % 5 * 100) || ',"type":"enabled"}' ELSE '' END
  || CASE WHEN conv_id % 4 = 0 THEN ',"tool_choice":"auto"' ELSE '' END || CASE WHEN conv_id % 2 = 0 THEN ',"tools":[{"function":{"name":"look_up"},"type":"function"}]' ELSE '' END || '}' AS request FROM msgs""",
    "cell_status_map": "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'rate_limited' WHEN 'view' THEN 'not_requested' ELSE 'failed' END AS status FROM events",
    "matrix_filter_models": _C + _SEL + "cells WHERE alias IN ('alpha', 'beta')",
    "matrix_filter_contains": _C + _SEL + "cells WHERE contains(prompt, 'en src1')",
    "matrix_filter_status": _C + ", m AS (SELECT * FROM cells WHERE alias <> 'beta')" + _SEL + "m WHERE prompt_id IN (SELECT prompt_id FROM m GROUP BY prompt_id HAVING bool_and(status = 'success'))",
    "matrix_filter_complete": _C + _SEL + "cells WHERE prompt_id NOT IN (SELECT prompt_id FROM cells WHERE status <> 'success')",
    "matrix_filter_min_success": _C + _SEL + "cells WHERE prompt_id IN (SELECT prompt_id FROM cells WHERE status = 'success' GROUP BY prompt_id HAVING count(*) >= 2)",
    "analysis_frame": _C + f" SELECT prompt_id, {_PIVOT.format(v='response')} FROM cells GROUP BY prompt_id",
    "matrix_summary": _C + " SELECT count(DISTINCT prompt_id) AS prompts, count(DISTINCT alias) AS models, count(*) AS total, count(*) FILTER (status <> 'pending') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'rate_limited') AS rate_limited FROM cells",
    "matrix_is_complete": _C + " SELECT bool_and(status <> 'pending') AS complete, 'all' AS of FROM cells UNION ALL SELECT true, 'ended'",
    "matrix_resume_pending": _C + " SELECT prompt_id, alias FROM cells WHERE status NOT IN ('success', 'not_requested')",
    "matrix_upsert": _C + " SELECT prompt_id, alias, CASE status WHEN 'pending' THEN 'success' ELSE status END AS status, CASE status WHEN 'pending' THEN 'late' ELSE response END AS response, error_message FROM cells",
    "matrix_append_missing": _C + " SELECT prompt_id, alias, CASE WHEN lang = 'en' THEN status ELSE 'pending' END AS status FROM cells",
    "matrix_retain": _C + " SELECT prompt_id, alias, status FROM cells WHERE lang = 'en'",
    "alias_lookup": "WITH " + V.LOG + " SELECT event_id, provider, CASE model WHEN 'm0' THEN 'openai/gpt' WHEN 'm1' THEN 'anthropic/opus' WHEN 'm2' THEN 'mock/m' WHEN 'm3' THEN 'openai/o' ELSE 'mock/x' END AS model FROM (SELECT event_id, model, CASE model WHEN 'm0' THEN 'openai' WHEN 'm1' THEN 'anthropic' WHEN 'm3' THEN 'openai' ELSE 'mock' END AS provider FROM log)",
    "reply_lengths": "SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Unknown' END AS language FROM documents",
    "mock_completion": r"SELECT doc_id, 'mock-response:' || text AS content, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) + 4 AS INTEGER) AS prompt_tokens, 1 AS completion_tokens, CAST(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) + 5 AS INTEGER) AS total_tokens FROM documents",
    "token_estimate": r"SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))) + 256 AS INTEGER) AS tokens FROM conversations GROUP BY conv_id",
    "fold_system": "WITH " + V.MESSAGES + r""",
m AS (SELECT conv_id, messages, prompt, [x for x in messages if x.role = 'system'] AS sys, [x for x in messages if x.role <> 'system'] AS rest FROM msgs),
f AS (SELECT *, list_aggregate([x.content for x in sys], 'string_agg', E'\n\n') AS lead, list_position([x.role for x in rest], 'user') AS pos_ FROM m)
SELECT conv_id, 'gpt' AS model, prompt FROM f
UNION ALL SELECT conv_id, 'google/Gemma-2-9b', CASE WHEN len(sys) = 0 THEN prompt WHEN pos_ > 0 THEN '{"messages":' || CAST(to_json(list_concat(rest[1 : pos_ - 1], [struct_pack(content := lead || E'\n\n' || rest[pos_].content, role := 'user')], rest[pos_ + 1 : len(rest)])) AS VARCHAR) || '}'
  ELSE '{"messages":' || CAST(to_json(list_concat([struct_pack(content := trim(lead), role := 'user')], rest)) AS VARCHAR) || '}' END FROM f""",
}

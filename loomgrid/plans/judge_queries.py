"""Queries over subjects, judge prompts, verdicts and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import judging as J
from ..operators import matrix as M
from . import views as V


def subjects_from_records(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents")
    return J.records_to_subjects(docs, "doc_id", "text", id_field="doc_id", model="lang", metadata=["source"], source_id="docs").select("subject_id", "subject_content", "subject_model_alias", "source_id", F.col("metadata")["source"].alias("source"))


def subjects_by_position(spark, sf_dir):
    """Subjects without an id of their own: it comes from row position and content."""
    return J.records_to_subjects(V.table(spark, sf_dir, "benchmark"), "item_id", "text").select("subject_id", "subject_content")


def subjects_from_conversations(spark, sf_dir):
    m = V.messages(spark, sf_dir).withColumn("text", F.lit(None).cast("string"))
    return J.records_to_subjects(m, "conv_id", "text", id_field="conv_id", messages="messages").select("subject_id", F.size("messages").alias("turns"))


def subjects_from_matrix(spark, sf_dir):
    return J.matrix_to_subjects(V.wide(spark, sf_dir), V.ALIASES).select("subject_id", "subject_content", "subject_model_alias", "prompt_id")


def subjects_from_cells(spark, sf_dir):
    """Subjects of the long matrix."""
    return J.cells_to_subjects(V.cells(spark, sf_dir)).select("subject_id", "subject_content", "subject_model_alias", "prompt_id")


def adapter_counts(spark, sf_dir):
    return J.adapter_counts(V.wide(spark, sf_dir), V.ALIASES)


def transcript(spark, sf_dir):
    return V.messages(spark, sf_dir).select("conv_id", text.transcript(F.col("messages")).alias("transcript"))


def judge_messages(spark, sf_dir):
    made = text.judge_messages("Judge it.", None, F.lit(None).cast("string"), F.col("messages"))
    return V.messages(spark, sf_dir).select("conv_id", made.alias("m")).select("conv_id", F.col("m")[0].content.alias("system"), F.col("m")[1].content.alias("user"))


def judge_content_messages(spark, sf_dir):
    made = text.judge_messages("Judge it.", None, F.col("text"), F.lit(None).cast(text.MESSAGES), F.create_map(F.lit("source"), F.col("source")))
    return V.table(spark, sf_dir, "documents").select("doc_id", made[1].content.alias("user"))


def judge_pairs(spark, sf_dir):
    done = _verdicts(spark, sf_dir)
    subjects = done.select("subject_id", "subject_model_alias").distinct()
    return J.pairs(subjects, V.JUDGES, V.CONFIG, done).select("subject_id", "judge_alias")


def _verdicts(spark, sf_dir):
    return J.verdicts(V.replies(spark, sf_dir), V.CLASSES)


def final_answer_parse(spark, sf_dir):
    r = V.replies(spark, sf_dir).where("error_message IS NULL").withColumn("p", parse.final_answer(F.col("raw_output"), V.CLASSES))
    return r.select("subject_id", "judge_alias", "p.final_class", "p.none_declared", "p.parse_status")


def verdict_status(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("subject_id", "judge_alias", "status", "parse_status", "raw_output")


def judgment_ids(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("subject_id", "judge_alias", "judgment_id")


def judge_summary(spark, sf_dir):
    return J.summary(_verdicts(spark, sf_dir), [*V.JUDGES, "judge-idle"])


def judge_totals(spark, sf_dir):
    return J.totals(_verdicts(spark, sf_dir))


def judge_accuracy(spark, sf_dir):
    gold = V.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("subject_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return J.accuracy(_verdicts(spark, sf_dir), gold)


def judge_disagreements(spark, sf_dir):
    return J.disagreements(_verdicts(spark, sf_dir)).select("subject_id", F.array_join("classes", ",").alias("classes"))


def judgment_upsert(spark, sf_dir):
    old = _verdicts(spark, sf_dir).select(*J.RESUME_KEY, "status", "raw_output")
    new = old.where("status = 'call_failed'").withColumns({"status": F.lit("success"), "raw_output": F.lit("again")})
    return J.merge(old, new).select("subject_id", "judge_alias", "status", "raw_output")


def response_extract(spark, sf_dir):
    """Providers' replies of several shapes, read to content and usage."""
    docs = V.table(spark, sf_dir, "documents")
    body = F.to_json(F.struct(F.col("text").alias("content")))
    reply = (
        F.when(F.col("lang") == "en", F.concat(F.lit('{"choices":[{"message":'), body, F.lit('}],"usage":{"prompt_tokens":3,"total_tokens":5}}')))
        .when(F.col("lang") == "de", F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"text":"b"}]}}]}'))
        .when(F.col("lang") == "fr", F.lit('{"choices":[{"text":"plain"}]}'))
        .otherwise(F.lit('{"choices":[]}'))
    )
    made = docs.select("doc_id", reply.alias("reply"))
    usage = parse.response_usage(F.col("reply"))
    return made.select("doc_id", parse.response_text(F.col("reply")).alias("content"), usage["prompt_tokens"].alias("prompt_tokens"), usage["total_tokens"].alias("total_tokens"))


def judge_labelled_messages(spark, sf_dir):
    """What judges are told where there are labels."""
    made = text.judge_messages(" Judge it. ", V.CLASSES, F.col("text"), F.lit(None).cast(text.MESSAGES))
    return V.table(spark, sf_dir, "documents").select("doc_id", made[0].content.alias("system"), made[1].content.alias("user"))


def judgment_metadata(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"))
    return J.with_metadata(rows, ["lang", "source", "none"])


def judgments_of_config(spark, sf_dir):
    rows = V.replies(spark, sf_dir).withColumn("judge_config_hash", F.concat(F.lit("cfg"), F.col("subject_id").cast("long") % 2))
    return J.of_config(rows, "cfg1").select("subject_id", "judge_alias", "judge_config_hash")


def response_tool_calls(spark, sf_dir):
    """Tool calls of replies: a list, none, or something that isn't one."""
    calls = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[{"id":"c'), F.col("doc_id"), F.lit('","name":"f"}]'))).when(F.col("doc_id") % 3 == 1, F.lit("null")).otherwise(F.lit('"no"'))
    reply = F.concat(F.lit('{"choices":[{"message":{"content":"x","tool_calls":'), calls, F.lit("}}]}"))
    return V.table(spark, sf_dir, "documents").select("doc_id", parse.response_tool_calls(reply).alias("tool_calls"))


QUERIES = {f.__name__: f for f in (subjects_from_records, subjects_by_position, subjects_from_conversations, subjects_from_matrix, subjects_from_cells, adapter_counts, transcript, judge_messages, judge_content_messages, judge_pairs, final_answer_parse, verdict_status, judgment_ids, judge_summary, judge_totals, judge_accuracy, judge_disagreements, judgment_upsert, response_extract, judge_labelled_messages, judgment_metadata, judgments_of_config, response_tool_calls)}

_R = "WITH " + V.REPLIES
_C = "WITH " + V.CELLS
_TALK = r"""'<conversation>' || E'\n' || coalesce(string_agg('<turn role="' || role || '">' || replace(text, '</turn>', '</ turn>') || '</turn>' || E'\n', '' ORDER BY turn, text, role) FILTER (role <> 'system'), '') || '</conversation>'"""
ORACLE_SQL = {
    "subjects_from_records": "SELECT CAST(doc_id AS VARCHAR) AS subject_id, text AS subject_content, lang AS subject_model_alias, 'docs' AS source_id, source FROM documents WHERE trim(text, E' \\n\\t\\r') <> ''",
    "subjects_by_position": "SELECT substr(sha256('{\"i\": ' || (row_number() OVER (ORDER BY item_id) - 1) || ', \"rec\": {\"text\": ' || CAST(to_json(text) AS VARCHAR) || '}}'), 1, 16) AS subject_id, text AS subject_content FROM benchmark",
    "subjects_from_conversations": "SELECT CAST(conv_id AS VARCHAR) AS subject_id, CAST(count(*) AS INTEGER) AS turns FROM conversations GROUP BY conv_id",
    "subjects_from_matrix": _C + " SELECT prompt_id || ':' || alias AS subject_id, response AS subject_content, alias AS subject_model_alias, prompt_id FROM cells WHERE status = 'success'",
    "subjects_from_cells": _C + " SELECT prompt_id || ':' || alias AS subject_id, response AS subject_content, alias AS subject_model_alias, prompt_id FROM cells WHERE status = 'success'",
    "judge_labelled_messages": r"""SELECT doc_id, E'Judge it.\n\nLABELS\n* good\n* bad\n\nLast line of the reply, once and alone:\n<final_answer>one of the labels, letter for letter</final_answer>\nIf none applies: <final_answer>__NONE__</final_answer>' AS system,
  E'You are evaluating the following content:\n<content>\n' || replace(text, '</content>', '</ content>') || E'\n</content>\n\nAnswer as the LABELS section says.' AS user FROM documents""",
    "judgment_metadata": "SELECT doc_id, lang AS metadata_lang, source AS metadata_source, CAST(NULL AS VARCHAR) AS metadata_none FROM documents",
    "judgments_of_config": "SELECT CAST(d.doc_id AS VARCHAR) AS subject_id, judge_alias, 'cfg1' AS judge_config_hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('judge-a'), ('judge-b')) j(judge_alias) WHERE d.doc_id % 2 = 1",
    "response_tool_calls": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '[{\"id\":\"c' || doc_id || '\",\"name\":\"f\"}]' END AS tool_calls FROM documents",
    "adapter_counts": _C + " SELECT CASE status WHEN 'success' THEN 'emitted' ELSE 'skipped_status' END AS reason, count(*) AS n FROM cells GROUP BY 1",
    "transcript": f"SELECT conv_id, {_TALK} AS transcript FROM conversations GROUP BY conv_id",
    "judge_messages": f"SELECT conv_id, 'Judge it.' AS system, E'You are evaluating the following conversation:\\n' || {_TALK} || E'\\n\\nProvide your evaluation.' AS user FROM conversations GROUP BY conv_id",
    "judge_content_messages": r"SELECT doc_id, E'You are evaluating the following content:\n<content>\n' || replace(text, '</content>', '</ content>') || E'\n</content>\n\n<metadata>\nsource: ' || source || E'\n</metadata>\n\nProvide your evaluation.' AS user FROM documents",
    "judge_pairs": _R + " SELECT subject_id, judge_alias FROM verdicts WHERE status <> 'success'",
    "final_answer_parse": _R + " SELECT subject_id, judge_alias, final_class, none_declared, parse_status FROM verdicts WHERE error_message IS NULL",
    "verdict_status": _R + " SELECT subject_id, judge_alias, status, parse_status, raw_output FROM verdicts",
    "judgment_ids": _R + " SELECT subject_id, judge_alias, judgment_id FROM verdicts",
    "judge_summary": _R + " SELECT judge_alias, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status = 'classification_failed') AS classification_failed, count(*) FILTER (status = 'call_failed') AS call_failed, CAST(0 AS BIGINT) AS skipped_resume FROM verdicts GROUP BY judge_alias UNION ALL SELECT 'judge-idle', 0, 0, 0, 0",
    "judge_totals": _R + " SELECT count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status <> 'success') AS failed FROM verdicts",
    "judge_accuracy": _R + " SELECT judge_alias, avg(CASE WHEN final_class = CASE quality WHEN 1 THEN 'good' ELSE 'bad' END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS n FROM verdicts WHERE status = 'success' GROUP BY judge_alias",
    "judge_disagreements": _R + " SELECT subject_id, 'bad,good' AS classes FROM verdicts WHERE status = 'success' GROUP BY subject_id HAVING count(DISTINCT final_class) > 1",
    "judgment_upsert": _R + " SELECT subject_id, judge_alias, CASE status WHEN 'call_failed' THEN 'success' ELSE status END AS status, CASE status WHEN 'call_failed' THEN 'again' ELSE raw_output END AS raw_output FROM verdicts",
    "response_extract": "SELECT doc_id, CASE lang WHEN 'en' THEN text WHEN 'de' THEN 'ab' WHEN 'fr' THEN 'plain' ELSE '' END AS content, CASE lang WHEN 'en' THEN 3 END AS prompt_tokens, CASE lang WHEN 'en' THEN 5 END AS total_tokens FROM documents",
}

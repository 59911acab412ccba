"""Queries that run whole experiments, judgings, generations and streams over the tables with a deterministic model."""

from __future__ import annotations

import asyncio

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import api
from ..config import Experiment, Judging, Provider, RateLimit, Retry
from ..functions import text
from ..operators import completion as C
from ..operators import personas as P
from ..operators import runtime as R
from ..sources import readers, writers
from ..sources.journal import Journal
from ..sources.scratch import durable, new_path
from ..streaming import requests
from . import views as V
from .persona_queries import _HIST, DIMENSIONS, _backgrounds, _names


def _mock(df):
    return C.mock_complete(df).withColumn("error_message", F.lit(None).cast("string"))


def _asked():
    """A benchmark item as a prompt that no other has."""
    return F.concat("text", F.lit(" #"), "item_id")


def _specs(spark, sf_dir):
    return V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_no"), F.lit(None).cast("string").alias("system"), _asked().alias("user"), F.lit(None).cast(text.MESSAGES).alias("messages"))


def _experiment(spark, sf_dir, log=None):
    """An experiment run twice: a model fails on some prompts at first, and only those are asked again."""
    store = writers.Store(spark, new_path(spark, "experiment"), ["prompt_id", "alias"])
    conf = Experiment("e", ("alpha", "beta"), system_prompt_by_model={"beta": "Be brief."})
    failing = lambda df: _mock(df).withColumn("status", F.when((F.col("alias") == "beta") & F.endswith(text.last_user(F.col("messages")), F.lit("7")), "failed").otherwise("success"))
    api.run_experiment(_specs(spark, sf_dir), conf, failing, store, log=log)
    again = lambda df: _mock(df).withColumn("content", F.concat(F.element_at("messages", 1).content, F.lit(" / "), "content"))
    return api.run_experiment(_specs(spark, sf_dir), conf, again, store, log=log)


def experiment_run(spark, sf_dir):
    return _experiment(spark, sf_dir).rows.select("alias", "status", "response")


def experiment_summary(spark, sf_dir):
    return _experiment(spark, sf_dir).summary


def experiment_log(spark, sf_dir):
    """What the runs logged: every request once, and those that failed once more."""
    path = new_path(spark, "run-log")
    _experiment(spark, sf_dir, path)
    return R.log_summary(readers.log(spark, path), ["model"]).drop("last_success")


def _broken_off(spark, sf_dir):
    """An experiment that breaks off after three of its batches and is started again: the second run, the first one's journal, and where each asking was noted."""
    store = writers.Store(spark, new_path(spark, "broken"), ["prompt_id", "alias"])
    notes, calls = new_path(spark, "asked"), []

    def answer(breaks):
        def ask(df):
            calls.append(1)
            if breaks and len(calls) > 3:
                raise ConnectionError("the model is gone")
            df.select("prompt_id", "alias").write.mode("append").parquet(notes)
            return _mock(df)

        return ask

    conf, seen = Experiment("e", ("alpha", "beta", "gamma")), []
    try:
        api.run_experiment(_specs(spark, sf_dir), conf, answer(True), store, batches=8)
    except StreamingQueryException:
        pass
    journal = Journal(spark, f"{store.folder}/journal")
    kept = journal.read().count()
    run = api.run_experiment(_specs(spark, sf_dir), conf, answer(False), store, batches=8, on_batch=seen.append)
    return run, spark.read.parquet(notes), journal.progress(), kept, seen


def journal_resume(spark, sf_dir):
    """Cells of the experiment that broke off, how often each was asked, and whether some answers came from before."""
    run, asked, _, kept, _ = _broken_off(spark, sf_dir)
    times = asked.groupBy("prompt_id", "alias").agg(F.count("*").alias("asked"))
    return run.rows.join(times, ["prompt_id", "alias"], "left").select("alias", "response", "asked", (F.lit(kept) > 0).alias("resumed"))


def journal_progress(spark, sf_dir):
    """The recorded progress of both runs: counts rise from batch to batch up to all cells that were left."""
    *_, progress, _, seen = _broken_off(spark, sf_dir)
    steps = progress.groupBy("run").agg(F.count("*").alias("steps"), F.max("done").alias("done"), F.max("succeeded").alias("succeeded"), F.max("total").alias("total"), F.count_distinct("done").alias("rises"))
    return steps.agg(F.count("*").alias("runs"), F.sum("done").alias("done"), F.sum("succeeded").alias("succeeded"), F.min(F.col("steps") >= 3).alias("in_steps"), F.min(F.col("rises") == F.col("steps")).alias("rising"), F.max("total").alias("total")).withColumn("told", F.lit(len(seen) >= 3))


def grouped_schedule(spark, sf_dir):
    """Calls of a group follow each other: how many began before the one before them had ended."""

    async def ask(request):
        await asyncio.sleep(0.002)
        return {"content": request["prompt"]}

    asked = V.table(spark, sf_dir, "benchmark").select(_asked().alias("prompt"), F.concat(F.lit("g"), F.col("item_id") % 7).alias("team"))
    out = durable(C.complete(asked, lambda: ask, serial="team", partitions=3), "grouped")
    earlier = W.partitionBy("team").orderBy("began_at").rowsBetween(W.unboundedPreceding, -1)
    late = out.withColumn("overlaps", F.coalesce((F.col("began_at") < F.max("ended_at").over(earlier)).cast("int"), F.lit(0)))
    return late.groupBy("team").agg(F.count("*").alias("calls"), F.sum("overlaps").alias("overlaps"), F.count_if(F.col("content") == F.col("prompt")).alias("answered"))


def call_timeouts(spark, sf_dir):
    """Calls that take too long fail alone, after as many attempts as the policy has."""

    async def ask(request):
        await asyncio.sleep(0 if int(request["prompt"].rpartition("#")[2]) % 7 else 60)
        return {"content": request["prompt"]}

    asked = V.table(spark, sf_dir, "benchmark").select(_asked().alias("prompt"))
    out = C.complete(asked, lambda: ask, Retry(max_retries=2), timeout=0.2, workers=64, sleep=_at_once)
    return out.select("prompt", "status", "error_type", "retry_count", F.length("content").alias("chars"))


def classified_replies(spark, sf_dir):
    """Two calls a prompt: a reply, then which option the reply stands for; the second one's words are matched to an option."""
    options = ["Yes", "No", "Neither"]

    async def reply(request):
        return {"content": request["prompt"][::-1]}

    async def classify(request):
        return {"content": f" I'd say {options[len(request['reply']) % 3].lower()}! " if len(request["reply"]) % 4 else "hard to tell"}

    asked = V.table(spark, sf_dir, "benchmark").select(_asked().alias("prompt"))
    first = C.complete(asked, lambda: reply).select("prompt", F.col("content").alias("reply"))
    return C.complete(first, lambda: classify).select("prompt", "reply", text.pick_option(F.col("content"), options).alias("option"))


def rate_leases(spark, sf_dir):
    """A limit's leases over eight tasks: they add up to it, each stands in one task, and no request is above the share of its own."""
    log = V.log(spark, sf_dir).select("event_id", "provider", F.col("model").alias("profile"), "tokens")
    names = [r[0] for r in log.select("provider").distinct().orderBy("provider").collect()]  # a row a provider
    limits = {f"{p}/m0": RateLimit(100 + i, 9000) for i, p in enumerate(names)} | {p: RateLimit(7 + i, 100_003) for i, p in enumerate(names)}
    dealt, shares = C.leased(log, limits, 8)
    held = spark.createDataFrame([(k, x.requests_per_minute, x.tokens_per_minute) for k, x in shares.items()], "lease string, requests long, share long")
    met = dealt.withColumn("task", F.spark_partition_id()).groupBy("lease").agg(F.count("*").alias("rows"), F.max("tokens").alias("largest"), F.count_distinct("task").alias("tasks"))
    by = held.join(met, "lease", "left").groupBy(F.substring_index("lease", "#", 1).alias("bucket"))
    return by.agg(F.sum("requests").alias("requests"), F.sum("share").alias("tokens"), F.sum("rows").alias("rows"), F.bool_and(F.coalesce(F.col("largest") <= F.col("share"), F.lit(True))).alias("admits"), F.max("tasks").alias("tasks"))


def judge_run(spark, sf_dir):
    """Documents judged twice over: only what failed to classify is judged again."""
    docs = V.table(spark, sf_dir, "documents")
    null = F.lit(None).cast("string")
    subjects = docs.select(F.col("doc_id").cast("string").alias("subject_id"), F.col("text").alias("subject_content"), F.lit(None).cast(text.MESSAGES).alias("messages"), null.alias("subject_model_alias"), null.alias("source_id"), null.alias("prompt_id"), F.create_map(F.lit("lang"), "lang").alias("metadata"))
    store = writers.Store(spark, new_path(spark, "judgments"), ["subject_id", "subject_model_alias", "judge_alias", "judge_config_hash"])
    conf = Judging("e", ("judge-a",), "Which language?", ("en", "de", "fr", "es"))
    tag = lambda c: F.concat(F.lit("<final_answer>"), c, F.lit("</final_answer>"))

    def answer(label):
        return lambda df: df.withColumns({"raw_output": F.when(F.col("subject_id").cast("long") % 6 == 0, label).otherwise(tag(F.col("metadata")["lang"])), "error_message": null})

    api.run_judges(subjects, conf, answer(F.lit("no idea")), store, batches=3)
    run = api.run_judges(subjects, conf, answer(tag(F.lit("en"))), store, batches=3)
    stamped = F.col("started_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$") & (F.col("started_at") <= F.col("completed_at"))
    return run.rows.select("subject_id", "judge_alias", "final_class", "status", stamped.alias("stamped"))


def background_run(spark, sf_dir):
    """Backgrounds generated in passes; progress by dimension."""
    templates = spark.createDataFrame([("region", "I live in <Nation>."), ("segment", "I wait for <Status>.")], "dim string, template string")
    store = writers.Store(spark, new_path(spark, "generated"), ["combination_id"])
    answer = lambda df: df.withColumns({"content": F.lit("ok"), "status": F.when((F.col("dimension") == "Region") & (F.substring("combination_id", 1, 1) < "4"), "failed").otherwise("success")})
    return api.generate_backgrounds(V.mapping(spark, sf_dir), templates, answer, store, passes=2, batches=3)


def _asks():
    """A model that refuses some prompts, and fails the first time on others."""
    tried: set[str] = set()

    async def ask(request):
        number = int(request["prompt"].rpartition("#")[2])
        if number % 5 == 0:
            raise RuntimeError("401 unauthorized")
        if number % 3 == 0 and request["prompt"] not in tried:
            tried.add(request["prompt"])
            raise RuntimeError("503 service unavailable")
        return {"content": f"re: {request['prompt']}", "prompt_tokens": 1, "completion_tokens": 2, "total_tokens": 3}

    return ask


async def _at_once(_):
    return None


def completion_boundary(spark, sf_dir):
    """Benchmark prompts through the asynchronous boundary, with retries and a provider's concurrency."""
    asked = V.table(spark, sf_dir, "benchmark").select(_asked().alias("prompt"), F.lit("mock").alias("provider"), F.concat(F.lit("m"), F.col("item_id") % 2).alias("alias"))
    out = C.complete(C.scheduled(asked, "grouped"), _asks, Retry(max_retries=2), sleep=_at_once, providers={"mock": Provider("mock", max_concurrency=3)}, partitions=2)
    return out.select("prompt", "status", "content", "error_type", "error_message", "total_tokens", "retry_count")


def judge_queues(spark, sf_dir):
    """A queue a judge: one whose model can't be set up fails alone."""

    def make(judge):
        if judge == "m1":
            raise RuntimeError("no such judge")
        return _asks()

    asked = V.table(spark, sf_dir, "benchmark").select(_asked().alias("prompt"), F.concat(F.lit("m"), F.col("item_id") % 2).alias("judge"))
    return C.complete(asked, make, Retry(max_retries=2), sleep=_at_once, queues="judge").select("prompt", "judge", "status", "error_message")


def batch_stream(spark, sf_dir):
    """Requests in two files with some in common, answered once each as a stream, in two starts."""
    source, sink, state = (new_path(spark, f"stream-{x}") for x in ("in", "out", "state"))
    rows = V.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("r"), "item_id").alias("request_id"), F.lit("alpha").alias("model_alias"), F.col("text").alias("prompt"), "item_id")
    answer = lambda df: df.select("request_id", text.mock_reply(F.col("prompt")).content.alias("content"))
    for part in ("item_id % 3 < 2", "item_id % 3 > 0"):
        writers.append_json(rows.where(part).drop("item_id"), source)
        requests.run_batches(spark, source, sink, state, answer).awaitTermination()
    return spark.read.parquet(sink).select("request_id", "content")


def retry_stream(spark, sf_dir):
    """Requests over three starts: success and refusals are final, what failed otherwise is asked again, three times at most; how often each was asked, and what came of it."""
    source, sink, state = (new_path(spark, f"retries-{x}") for x in ("in", "out", "state"))
    rows = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), F.lit("alpha").alias("model_alias"), F.col("text").alias("prompt"))
    writers.append_json(rows, source)
    kind = F.length("prompt") % 4
    ended = F.when(kind == 1, "fatal_failure").when((kind == 2) & (F.col("attempt") == 1) | (kind == 3), "retryable_failure").otherwise("success")
    answer = lambda df: df.select("request_id", ended.alias("status"), text.mock_reply(F.col("prompt")).content.alias("content"))
    for _ in range(3):
        requests.run_batches(spark, source, sink, state, answer).awaitTermination()
    out = spark.read.parquet(sink)
    return out.groupBy("request_id").agg(F.count("*").alias("asked"), F.max_by("status", "attempt").alias("status"))


def rate_stream(spark, sf_dir):
    """The log as a stream: requests and tokens of each provider and minute, late rows counted too."""
    source, out, state = (new_path(spark, f"rates-{x}") for x in ("in", "out", "state"))
    log = V.log(spark, sf_dir).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "provider", "tokens")
    log.write.parquet(source)
    stream = requests.rates(spark.readStream.schema(log.schema).parquet(source), "provider", late="3650 days")
    stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("since", F.col("since").cast("timestamp_ntz"))


def observed_progress(spark, sf_dir):
    """Counts that a write of results leaves behind."""
    log = V.log(spark, sf_dir).select("event_id", "status")
    counted, seen = C.observed(log)
    durable(counted, "observed")
    return spark.createDataFrame([(seen.get["done"], seen.get["succeeded"])], "done long, succeeded long")


def history_run(spark, sf_dir):
    """Histories stored, and again when more backgrounds are there: none twice."""
    made = durable(_backgrounds(spark, sf_dir), "made")
    store = writers.Store(spark, new_path(spark, "histories"), ["history_id"])
    for part in (made.where("substr(combination_id, 1, 1) < 'c'"), made):
        done = store.read()
        new = P.histories(part, DIMENSIONS, _names(spark, sf_dir), gender="Segment", name_key="Nation", done=done, most=10**9)
        store.replace(new if done is None else done.unionByName(new))
    return store.read().select("history_id")


QUERIES = {f.__name__: f for f in (journal_resume, journal_progress, grouped_schedule, call_timeouts, classified_replies, rate_leases, experiment_run, experiment_summary, experiment_log, judge_run, background_run, completion_boundary, judge_queues, batch_stream, retry_stream, rate_stream, observed_progress, history_run)}

_S = "WITH s AS (SELECT item_id, text, alias, alias = 'beta' AND item_id % 10 = 7 AS late FROM benchmark, (VALUES ('alpha'), ('beta')) a(alias))"
_B = "FROM (SELECT text || ' #' || item_id AS prompt, item_id % 5 = 0 AS refused, item_id % 3 = 0 AND item_id % 5 <> 0 AS twice, 'm' || (item_id % 2) AS judge FROM benchmark)"
ORACLE_SQL = {
    "experiment_run": _S + " SELECT alias, 'success' AS status, CASE WHEN late THEN 'Be brief. / ' ELSE '' END || 'mock-response:' || text || ' #' || item_id AS response FROM s",
    "experiment_summary": _S + " SELECT count(DISTINCT item_id) AS prompts, count(DISTINCT alias) AS models, count(*) AS total, count(*) AS completed, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS rate_limited FROM s",
    "experiment_log": _S + " SELECT alias AS model, count(*) + count(*) FILTER (late) AS requests, count(*) AS successes, count(*) FILTER (late) AS failures FROM s GROUP BY alias",
    "journal_resume": _S.replace("('beta'))", "('beta'), ('gamma'))") + " SELECT alias, 'mock-response:' || text || ' #' || item_id AS response, CAST(1 AS BIGINT) AS asked, true AS resumed FROM s",
    "journal_progress": _S.replace("('beta'))", "('beta'), ('gamma'))") + " SELECT CAST(2 AS BIGINT) AS runs, count(*) AS done, count(*) AS succeeded, true AS in_steps, true AS rising, count(*) AS total, true AS told FROM s",
    "grouped_schedule": "SELECT 'g' || (item_id % 7) AS team, count(*) AS calls, CAST(0 AS BIGINT) AS overlaps, count(*) AS answered FROM benchmark GROUP BY 1",
    "call_timeouts": "SELECT text || ' #' || item_id AS prompt, CASE item_id % 7 WHEN 0 THEN 'failed' ELSE 'success' END AS status, CASE item_id % 7 WHEN 0 THEN 'TimeoutError' END AS error_type, CASE item_id % 7 WHEN 0 THEN 1 ELSE 0 END AS retry_count, CASE WHEN item_id % 7 <> 0 THEN CAST(length(text || ' #' || item_id) AS INTEGER) END AS chars FROM benchmark",
    "classified_replies": "SELECT prompt, reverse(prompt) AS reply, CASE WHEN length(prompt) % 4 = 0 THEN 'hard to tell' WHEN length(prompt) % 3 = 0 THEN 'Yes' WHEN length(prompt) % 3 = 1 THEN 'No' ELSE 'Neither' END AS option FROM (SELECT text || ' #' || item_id AS prompt FROM benchmark)",
    "rate_leases": "WITH " + V.LOG + """, p AS (SELECT provider, row_number() OVER (ORDER BY provider) - 1 AS i FROM (SELECT DISTINCT provider FROM log)),
l AS (SELECT provider || '/m0' AS bucket, 100 + i AS requests, 9000 AS tokens FROM p UNION ALL SELECT provider, 7 + i, 100003 FROM p),
n AS (SELECT CASE model WHEN 'm0' THEN provider || '/m0' ELSE provider END AS bucket, count(*) AS rows FROM log GROUP BY 1)
SELECT bucket, CAST(requests AS BIGINT) AS requests, CAST(tokens AS BIGINT) AS tokens, rows, true AS admits, CAST(1 AS BIGINT) AS tasks FROM l JOIN n USING (bucket)""",
    "judge_run": "SELECT CAST(doc_id AS VARCHAR) AS subject_id, 'judge-a' AS judge_alias, CASE doc_id % 6 WHEN 0 THEN 'en' ELSE lang END AS final_class, 'success' AS status, true AS stamped FROM documents",
    "background_run": "WITH " + V.MAPPING + " SELECT dimension, count(*) AS total, count(*) FILTER (NOT late) AS skipped, count(*) FILTER (late) AS pending FROM (SELECT dimension, dimension = 'Region' AND substr(combination_id, 1, 1) < '4' AS late FROM ids) GROUP BY dimension",
    "completion_boundary": "SELECT prompt, CASE WHEN refused THEN 'failed' ELSE 'success' END AS status, CASE WHEN NOT refused THEN 're: ' || prompt END AS content, CASE WHEN refused THEN 'RuntimeError' END AS error_type, CASE WHEN refused THEN '401 unauthorized' END AS error_message, CASE WHEN NOT refused THEN 3 END AS total_tokens, CASE WHEN twice THEN 1 ELSE 0 END AS retry_count " + _B,
    "judge_queues": "SELECT prompt, judge, CASE WHEN judge = 'm1' OR refused THEN 'failed' ELSE 'success' END AS status, CASE WHEN judge = 'm1' THEN 'no such judge' WHEN refused THEN '401 unauthorized' END AS error_message " + _B,
    "batch_stream": "SELECT 'r' || item_id AS request_id, 'mock-response:' || text AS content FROM benchmark",
    "retry_stream": "SELECT CAST(item_id AS VARCHAR) AS request_id, CAST(CASE length(text) % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS BIGINT) AS asked, CASE length(text) % 4 WHEN 1 THEN 'fatal_failure' WHEN 3 THEN 'retryable_failure' ELSE 'success' END AS status FROM benchmark",
    "rate_stream": "WITH " + V.LOG + " SELECT time_bucket(INTERVAL '60 seconds', ts) AS since, provider, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM log GROUP BY 1, 2",
    "observed_progress": "SELECT count(*) AS done, count(*) FILTER (event_type <> 'error') AS succeeded FROM events",
    "history_run": "WITH " + V.MAPPING + _HIST + " SELECT history_id FROM both_",
}

"""Files, configuration, the completion boundary and whole runs."""

import asyncio
import json

import pytest
from pyspark.sql import functions as F

from loomgrid import api, config
from loomgrid.operators import completion, matrix
from loomgrid.sources import readers, writers
from loomgrid.streaming import requests


def test_mapping_names_templates(spark, tmp_path):
    (tmp_path / "age.csv").write_text('﻿Dimension value,Indicator name,Indicator value\n"Young, or so",job,"a\nb"\nOld,job,x\n', encoding="utf-8")
    rows = readers.mapping(spark, str(tmp_path / "age.csv"), "Age").orderBy("pos").collect()
    assert [(r.dimension, r.dimension_value) for r in rows] == [("Age", "Young, or so"), ("Age", "Old")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(readers.CorruptFile):
        readers.mapping(spark, str(tmp_path / "bad.csv"), "Age")
    assert readers.names(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "names.csv").write_text("Name,Gender\nBo,Male\nBo,Female\n")
    assert readers.names(spark, str(tmp_path / "names.csv")).first().gender == "Female"
    (tmp_path / "t.json").write_text(json.dumps({"Age": "<job>", "Race": "x"}))
    assert [r.dim for r in readers.templates(spark, str(tmp_path / "t.json")).orderBy("ord").collect()] == ["Age", "Race"]


def test_json_lines_with_corruption(spark, tmp_path):
    good = {"dimension": "Age", "dimension_value": "v", "combination_id": "c1", "indicators": {"a": "1"}, "messages": [{"role": "user", "content": "é"}]}
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps({"dimension": "Age"}) + "\n")
    row = readers.backgrounds(spark, str(tmp_path / "*.jsonl")).collect()
    assert len(row) == 1 and row[0].schema_version == 1 and row[0].messages[0].content == "é"
    assert [r.combination_id for r in readers.existing_ids(spark, str(tmp_path / "*.jsonl")).collect()] == ["c1"]
    (tmp_path / "c.json").write_text('{"request_id":"1","status":"pending"}\n{"request_id":"1","status":"success"}\n')
    assert readers.checkpoint(spark, str(tmp_path / "c.json")).first().status == "success"
    (tmp_path / "d.json").write_text('{"request_id":"1","status":"pending"}\n{oops\n')
    with pytest.raises(Exception, match="corrupt checkpoint"):
        readers.checkpoint(spark, str(tmp_path / "d.json")).collect()


def test_matrix_round_trip(spark, tmp_path):
    rows = [("p1", '{"a":"x,\\n\\"y\\""}', "m", "success", 'multi\nline "quoted", text', None), ("p2", "q", "m", "failed", None, "boom")]
    cells = spark.createDataFrame(rows, "prompt_id string, prompt string, alias string, status string, response string, error_message string")
    path = str(tmp_path / "run.csv")
    writers.matrix_csv(cells, ["m"], path)
    back = readers.matrix(spark, path).select(*cells.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert readers.done_cells(spark, path).count() == 1 and readers.latest_run(spark, str(tmp_path)).endswith("run.csv")
    assert json.loads((tmp_path / "run.csv.meta.json").read_text())["model_aliases"] == ["m"]


def test_judgments_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("j1", "s1", None, "ok", "success", True, 1.23456, 3, {"b": "2", "a": "1"})], "judgment_id string, subject_id string, final_class string, raw_output string, status string, none_declared boolean, latency_ms double, total_tokens int, metadata map<string,string>")
    writers.judgments_csv(df, str(tmp_path / "j"))
    row = readers.judgments(spark, str(tmp_path / "j")).first()
    assert (row.final_class, row.none_declared, row.latency_ms, row.total_tokens, row.metadata) == (None, True, 1.235, 3, {"a": "1", "b": "2"})
    writers.judgments_csv(df.withColumn("status", F.lit("odd")), str(tmp_path / "k"))
    with pytest.raises(Exception, match="unknown judgment status"):
        readers.judgments(spark, str(tmp_path / "k")).collect()


def test_config():
    made = config.load_yaml("providers:\n  openai:\n    api_key_env: K\n    retry: {max_retries: 5}\n  mock: {}\nmodel_aliases:\n  a: {provider: mock, model: m}\ndefault_provider: openai\n")
    assert made.retry_of("openai").max_retries == 5 and made.retry_of("mock").max_retries == 3
    assert config.api_key(made.providers["openai"], {"K": "x"}) == "x" and config.load_yaml("") == config.Inference()
    for bad in ({"providers": {"nope": {}}}, {"default_provider": "x"}, {"model_aliases": {"a": {"provider": "x", "model": "m"}}}, {"default_retry": {"base_delay": 9, "max_delay": 1}}):
        with pytest.raises(ValueError):
            config.load(bad)
    with pytest.raises(ValueError):
        config.api_key(made.providers["openai"], {})
    j = lambda **k: config.Judging(**({"experiment_name": "e", "judges": ("a", "b"), "judge_prompt": "p"} | k))
    assert j().hash == j(judges=("b", "a"), experiment_name="f", workers=4).hash
    assert j(classes=("x", "y")).hash != j(classes=("y", "x")).hash
    for bad in ({"judges": ()}, {"classes": ("x", "x")}, {"classes": ("__NONE__",)}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            j(**bad)


def test_resolution():
    hinted = RuntimeError("slow down, retry-after: 0")
    policy = config.Retry(max_retries=2, max_wait=3600)
    assert completion.resolve(1, hinted, policy).action == "retry_after_hint"
    assert completion.resolve(1, RuntimeError("retry in 7200 s"), policy).terminal_status == "rate_limited"
    assert completion.resolve(1, TimeoutError(), policy).action == "retry_with_backoff" and completion.resolve(2, TimeoutError(), policy).terminal_status == "failed"
    wrapped = RuntimeError("call failed")
    wrapped.__cause__ = RuntimeError("429 too many requests")
    assert completion.resolve(1, wrapped, policy).action == "retry_with_backoff"
    assert completion.resolve(1, RuntimeError("400 invalid request"), policy).terminal_status == "failed"


def test_window_limits():
    now = [0.0]
    w = completion.Window({"p": config.RateLimit(1, 0), "t": config.RateLimit(0, 10)}, clock=lambda: now[0])
    assert w.wait_for("p", 1) == 0 and w.wait_for("p", 1) == 60.0
    assert w.wait_for("t", 7) == 0 and w.wait_for("t", 5) == 60.0 and w.wait_for("other", 99) == 0
    with pytest.raises(completion.RateLimitExceeded):
        w.wait_for("t", 11)
    with pytest.raises(completion.RateLimitExceeded):
        asyncio.run(w.acquire("p", 1, wait=False))
    now[0] = 60.0
    assert w.wait_for("t", 5) == 0


def make_ask():
    calls = {}

    async def ask(request):
        n = calls[request["prompt"]] = calls.get(request["prompt"], 0) + 1
        if request["prompt"] == "flaky" and n == 1:
            raise RuntimeError("503 unavailable")
        if request["prompt"] == "bad":
            raise ValueError("401 unauthorized")
        if request["prompt"] == "slow":
            await asyncio.sleep(5)
        return {"content": "re: " + request["prompt"], "total_tokens": 2}

    return ask


def test_completion_rows(spark):
    async def now(_):
        return None

    asked = spark.createDataFrame([("ok",), ("flaky",), ("bad",), ("slow",)], "prompt string")
    out = completion.complete(asked, make_ask, config.Retry(max_retries=2), timeout=0.2, sleep=now)
    got = {r.prompt: (r.status, r.content, r.retry_count, r.error_type) for r in out.collect()}
    assert got["ok"] == ("success", "re: ok", 0, None) and got["flaky"][:3] == ("success", "re: flaky", 1)
    assert got["bad"][0] == "failed" and got["bad"][3] == "ValueError" and got["slow"][0] == "failed"
    assert completion.complete(asked.limit(1), make_ask, limits={"default": config.RateLimit(100, 0)}, partitions=2).first().status == "success"


def mock(df):
    return completion.mock_complete(df).withColumn("error_message", F.lit(None).cast("string"))


def test_experiment_resumes(spark, tmp_path):
    specs = spark.createDataFrame([(0, None, "hello", None), (1, None, "bye", None)], "prompt_no int, system string, user string, messages array<struct<content:string,role:string>>")
    store = writers.Store(spark, str(tmp_path), ["prompt_id", "alias"])
    fails = lambda df: mock(df).withColumn("status", F.when(F.col("alias") == "b", "failed").otherwise("success"))
    conf = config.Experiment("e", ("a", "b"))
    assert api.run_experiment(specs, conf, fails, store).summary.first().failed == 2
    asked = []
    again = api.run_experiment(specs, conf, lambda df: (asked.append(df.count()), mock(df))[1], store)
    assert asked == [2] and again.summary.first().failed == 0 and again.rows.where("response = 'mock-response:hello'").count() == 2
    wider = api.run_experiment(specs.limit(1), config.Experiment("e", ("a", "b", "c")), mock, store)
    assert (wider.summary.first().prompts, wider.summary.first().models) == (1, 3)
    assert matrix.is_complete(wider.rows, wider.rows).first().complete


def test_judging_resumes(spark, tmp_path):
    subjects = spark.createDataFrame([("s1", "text", None, None, None, None, None), ("s2", "more", None, None, None, None, None)], "subject_id string, subject_content string, messages array<struct<content:string,role:string>>, subject_model_alias string, source_id string, prompt_id string, metadata map<string,string>")
    store = writers.Store(spark, str(tmp_path), ["subject_id", "subject_model_alias", "judge_alias", "judge_config_hash"])
    conf = config.Judging("e", ("x",), "Judge.", ("A",))
    answer = lambda df: df.withColumns({"raw_output": F.when(F.col("subject_id") == "s1", "<final_answer>A</final_answer>").otherwise("no"), "error_message": F.lit(None).cast("string")})
    first = api.run_judges(subjects, conf, answer, store)
    assert (first.summary.first().completed, first.summary.first().classification_failed) == (1, 1)
    seen = []
    second = api.run_judges(subjects, conf, lambda df: (seen.append(df.count()), answer(df))[1], store)
    assert seen == [1] and second.rows.count() == 2


def test_backgrounds_resume(spark, tmp_path):
    m = spark.createDataFrame([("Age", "v", "job", j, i) for i, j in enumerate("xyz")], "dimension string, dimension_value string, indicator_name string, indicator_value string, pos long")
    t = spark.createDataFrame([("age", "I am <job>")], "dim string, template string")
    store = writers.Store(spark, str(tmp_path), ["combination_id"])
    some = lambda df: df.withColumns({"content": F.lit("ok"), "status": F.when(F.col("indicators")["job"] == "z", "failed").otherwise("success")})
    assert api.generate_backgrounds(m, t, some, store, passes=1).first().pending == 1
    assert api.generate_backgrounds(m, t, lambda df: some(df).withColumn("status", F.lit("success")), store).first().pending == 0
    assert store.read().count() == 3


def test_streaming_batches_answer_once(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    line = lambda p: json.dumps({"model_alias": "m", "prompt": p}) + "\n"
    (source / "a.json").write_text(line("one") + line("two"))
    answer = lambda df: df.select("request_id", "prompt", F.lit("done").alias("content"))
    requests.run_batches(spark, str(source), sink, str(tmp_path / "cp"), answer).awaitTermination()
    (source / "b.json").write_text(line("two") + line("three"))
    requests.run_batches(spark, str(source), sink, str(tmp_path / "cp"), answer).awaitTermination()
    assert sorted(r.prompt for r in spark.read.parquet(sink).collect()) == ["one", "three", "two"]


def test_command_line(spark, tmp_path, capsys):
    from loomgrid.__main__ import main

    (tmp_path / "age.csv").write_text("Dimension_value,Indicator_name,Indicator_value\nyoung,Name,Bo\nyoung,Name,Al\nold,Name,Bo\n")
    (tmp_path / "gender.csv").write_text("Dimension_value,Indicator_name,Indicator_value\nMale,job,x\nFemale,job,y\n")
    (tmp_path / "t.json").write_text(json.dumps({"Age": "I am <Name>", "Gender": "I do <job>", "Race": "none"}))
    (tmp_path / "names.csv").write_text("Name,Gender\nBo,Male\nAl,Female\n")
    out = str(tmp_path / "out")
    assert main(["backgrounds", "--mappings", str(tmp_path), "--templates", str(tmp_path / "t.json"), "--out", out]) == 0
    assert "Age: 3 combinations, 0 pending" in capsys.readouterr().out
    histories = ["histories", "--backgrounds", out, "--out", str(tmp_path / "h"), "--names", str(tmp_path / "names.csv")]
    assert main(histories) == 0 and "3 histories" in capsys.readouterr().out
    assert main([*histories, "--partial"]) == 0 and "8 histories" in capsys.readouterr().out
    assert main(["backgrounds", "--mappings", str(tmp_path / "none"), "--templates", str(tmp_path / "t.json"), "--out", out]) == 1


def test_streamed_rates(spark, tmp_path):
    from pyspark.sql import types as T

    rows = [(i, i * 7.0) for i in range(40)]
    made = spark.createDataFrame(rows, "event_id long, s double").select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit("p").alias("provider"), F.lit(1).cast("long").alias("tokens"))
    made.write.parquet(str(tmp_path / "in"))
    schema = T.StructType([f for f in made.schema.fields])
    stream = requests.rates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "provider")
    stream.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("live").collect())) == sorted(map(tuple, requests.rates(made, "provider").collect()))


def test_smaller_files_and_paths(spark, tmp_path):
    history = spark.createDataFrame([("h1", {"Age": "old", "Race": None}, {"Age": "c1"}, [("user", "é")])], "history_id string, persona map<string,string>, combination_ids map<string,string>, messages array<struct<role:string,content:string>>")
    writers.append_json(history, str(tmp_path / "h"))
    writers.append_json(history, str(tmp_path / "h"))
    back = readers.histories(spark, str(tmp_path / "h"))
    assert back.count() == 2 and back.first().messages[0].content == "é" and readers.existing_ids(spark, str(tmp_path / "h" / "*.json"), "history_id").count() == 1
    writers.pending_matrix(spark.createDataFrame([("p", "q")], "prompt_id string, prompt string"), ["a", "b"], str(tmp_path / "m.csv"))
    assert {r.status for r in readers.matrix(spark, str(tmp_path / "m.csv")).collect()} == {"pending"} and readers.done_cells(spark, str(tmp_path / "m.csv")).count() == 0
    assert readers.done_cells(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "log.json").write_text('{"provider":"p","status":"success","timestamp":"2024-01-02T03:04:05.678Z"}\n{"provider":"p","status":"failed","timestamp":"2024-01-02T03:04:05+00:00","retry_count":2}\n')
    log = readers.log(spark, str(tmp_path / "log.json"))
    assert log.where("ts IS NULL").count() == 0 and log.where("retry_count IS NULL").count() == 1
    (tmp_path / "req.json").write_text('{"model_alias":"m","prompt":"x"}\n')
    assert readers.requests(spark, str(tmp_path / "req.json")).first().prompt == "x"
    assert writers.run_path("logs/", "e", "s") == "logs/e/s.csv" and writers.judgments_path("logs", "e") == "logs/e/judgments.csv"
    assert writers.checkpoint_path(None, "cp/") == "cp/batch.jsonl" and writers.checkpoint_path("x", None) == "x"
    with pytest.raises(ValueError):
        writers.checkpoint_path(None, None)
    with pytest.raises(FileNotFoundError):
        readers.latest_run(spark, str(tmp_path / "nowhere"))


def test_small_helpers(spark, tmp_path):
    from loomgrid.functions import retry
    from loomgrid.operators import judging, personas

    (tmp_path / "c.yaml").write_text("providers: {mock: {}}\n")
    assert set(config.load_file(str(tmp_path / "c.yaml")).providers) == {"mock"}
    with pytest.raises(FileNotFoundError):
        config.load_file(str(tmp_path / "none.yaml"))
    assert retry.effective_policy({"max_retries": 9}, {"max_retries": 5, "base_delay": 2}) == {"max_retries": 9, "base_delay": 2, "max_delay": 60.0, "factor": 2.0}
    rows = spark.createDataFrame([("c", "old", 1), ("c", "new", 2)], "combination_id string, dimension_value string, pos long")
    assert personas.latest_backgrounds(rows).first().dimension_value == "new"
    assert personas.select_dimensions(rows.withColumn("dimension", F.lit("Age")), ["AGE"]).count() == 2
    judged = spark.createDataFrame([({"a": "1"},), (None,)], "metadata map<string,string>")
    assert sorted(map(str, (r.metadata_a for r in judging.with_metadata(judged, ["a"]).collect()))) == ["1", "None"]


def test_file_order_decides_a_replay(spark, tmp_path):
    """The later file by name holds, also if Spark reads it first for its size; within a file the later line, over many blocks."""
    line = lambda i, s: json.dumps({"request_id": str(i), "status": s}) + "\n"
    for small, large in (("a", "b"), ("b", "a")):
        folder = tmp_path / f"{small}{large}"
        folder.mkdir()
        (folder / f"{small}.jsonl").write_text(line(0, "pending"))
        (folder / f"{large}.jsonl").write_text(line(0, "success") + "".join(line(i, "pending") for i in range(1, 3000)))
        got = readers.checkpoint(spark, str(folder / "*.jsonl")).where("request_id = '0'").first().status
        assert got == ("success" if large > small else "pending")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        (tmp_path / "long.jsonl").write_text("".join(line(i % 50, "pending") for i in range(5000)) + "".join(line(i, "success") for i in range(50)))
        assert {r.status for r in readers.checkpoint(spark, str(tmp_path / "long.jsonl")).collect()} == {"success"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_concurrency_holds_over_tasks(spark):
    asked = spark.range(200).select(F.col("id"), F.when(F.col("id") % 2 == 0, "p").when(F.col("id") % 5 == 0, "free").otherwise("q").alias("provider"), F.concat(F.lit("m"), F.col("id") % 3).alias("alias"))
    providers = {"p": config.Provider("openai", max_concurrency=5), "q": config.Provider("mock", per_model_concurrency=2)}
    for tasks in (1, 3, 8):
        rows = completion.gated(asked, providers, tasks).withColumn("task", F.spark_partition_id()).collect()
        assert all(r.gate is None for r in rows if r.provider == "free")
        gates = {r.gate: (r.width, r.provider, r.alias, r.task) for r in rows if r.gate}
        assert all(len({r.task for r in rows if r.gate == g}) == 1 for g in gates)
        assert sum(w for w, p, *_ in gates.values() if p == "p") == 5
        assert all(sum(w for w, p, a, _ in gates.values() if (p, a) == ("q", m)) <= 2 for m in ("m0", "m1", "m2"))


def test_schedules(spark):
    asked = spark.range(300).select("id", F.concat(F.lit("m"), F.col("id") % 3).alias("alias"))
    tasks = completion.scheduled(asked, "grouped").withColumn("t", F.spark_partition_id()).groupBy("alias").agg(F.count_distinct("t").alias("n")).collect()
    assert all(r.n == 1 for r in tasks) and completion.scheduled(asked, "interleaved").count() == 300
    with pytest.raises(ValueError):
        completion.scheduled(asked, "odd")


def test_grids_and_policies():
    ok = {"model_aliases": ("a",), "final_user_message": "x"}
    config.Grid(**ok)
    for bad in ({"system_prompt": "s", "system_prompts": ("t",)}, {"static_turns": (), "static_turns_list": ((),)}, {"final_user_messages": ("y",)}, {"final_user_message": None}, {"model_aliases": ()}, {"system_prompt_by_model": {"z": "s"}}):
        with pytest.raises(ValueError):
            config.Grid(**(ok | bad))
    with pytest.raises(ValueError):
        config.Experiment("e", ("a",), system_prompt_by_model={"b": "s"})
    base = config.Retry(max_retries=9, base_delay=2.0, max_delay=30.0)
    assert config.Retry(max_retries=2).over(base) == config.Retry(max_retries=2, base_delay=2.0, max_delay=30.0) and config.Retry(max_retries=2).over(None).base_delay == 1.0
    waits = {completion.resolve(1, TimeoutError(), base.with_seed(s)).wait for s in range(20)}
    assert len(waits) == 20 and all(1.0 <= w <= 3.0 for w in waits) and completion.resolve(1, TimeoutError(), base).wait == 2.0
    made = config.load({"providers": {"mock": {"rate_limit": {"requests_per_minute": 5}}, "openai": {}}})
    assert made.limits() == {"mock": config.RateLimit(5, 0)}


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from loomgrid.sources import scratch

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Far())
    assert scratch.shared_dir(spark)

"""What runs keep: journals, stores, limits over tasks and streams, and requests that are asked again."""

import asyncio
import json
import random
import time
from collections import deque

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomgrid import api, config
from loomgrid.operators import completion, matrix, stats
from loomgrid.sources import files, journal, readers, store, writers
from loomgrid.streaming import limits, requests


def mock(df):
    return completion.mock_complete(df).withColumn("error_message", F.lit(None).cast("string"))


# journals


def test_a_run_that_breaks_off_keeps_its_batches(spark, tmp_path):
    asked, told = spark.range(100).withColumn("text", F.lit("x")), []
    made = journal.Journal(spark, str(tmp_path))
    calls = []

    def answer(df):
        calls.append(sorted(r.id for r in df.select("id").collect()))
        if len(calls) == 4:
            raise ConnectionError("gone")
        return df.withColumn("status", F.when(F.col("id") % 10 == 0, "failed").otherwise("success"))

    with pytest.raises(StreamingQueryException):
        made.ask(asked, answer, told.append, batches=8, least_rows=4)
    kept = {r.id for r in made.read().collect()}
    assert kept == {i for c in calls[:3] for i in c} and 10 <= len(kept) <= 60
    assert [t["done"] for t in told] == [sum(map(len, calls[: i + 1])) for i in range(3)] and all(t["total"] == 100 for t in told)
    rest = asked.join(made.read(), "id", "left_anti")
    calls.clear()
    out = made.ask(rest, lambda df: (calls.extend(r.id for r in df.collect()), df.withColumn("status", F.lit("success")))[1], batches=8, least_rows=4)
    assert sorted(calls) == sorted(set(range(100)) - kept) and out.count() == 100
    assert made.progress().groupBy("run").agg(F.max("total").alias("t")).count() == 2
    made.clear()
    assert made.read() is None and made.ask(asked.limit(0), answer) is None


def test_an_experiment_takes_up_what_was_kept(spark, tmp_path):
    specs = spark.createDataFrame([(i, None, f"p{i}", None) for i in range(40)], "prompt_no int, system string, user string, messages array<struct<content:string,role:string>>")
    kept, conf, calls = writers.Store(spark, str(tmp_path), ["prompt_id", "alias"]), config.Experiment("e", ("a",)), []

    def breaks(df):
        calls.append(df.count())
        if len(calls) > 1:
            raise ConnectionError("gone")
        return mock(df)

    with pytest.raises(StreamingQueryException):
        api.run_experiment(specs, conf, breaks, kept)
    asked = []
    run = api.run_experiment(specs, conf, lambda df: (asked.append(df.count()), mock(df))[1], kept)
    assert 0 < sum(asked) == 40 - calls[0] and run.summary.first().completed == 40
    assert api.run_experiment(specs, conf, breaks, kept).rows.count() == 40


# stores


def ids(spark, *values, v="old"):
    return spark.createDataFrame([(i, v) for i in values], "k long, v string")


def test_an_upsert_writes_its_buckets_alone(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), ["k"], buckets=8)
    s.upsert(ids(spark, *range(100)))
    before = s._current()[1]["buckets"]
    s.upsert(ids(spark, 5, v="new"))
    after = s._current()[1]["buckets"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in after) == 1
    assert {r.k: r.v for r in s.read().collect()} == {i: "new" if i == 5 else "old" for i in range(100)}
    with pytest.raises(ValueError, match="two rows of one key"):
        s.upsert(ids(spark, 7, 7))
    s.upsert(spark.createDataFrame([(None, "none")], "k long, v string"))
    s.upsert(spark.createDataFrame([(None, "one")], "k long, v string"))
    assert [r.v for r in s.read().where("k IS NULL").collect()] == ["one"]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    a, b = (store.Store(spark, str(tmp_path), ["k"], buckets=4) for _ in range(2))
    a.upsert(ids(spark, 0, 1, 2))
    claim, first = store.claim, [True]

    def late(*args):
        if first:  # the other writer comes in between, once with the same buckets
            first.clear()
            b.upsert(ids(spark, 2, 3, v="b"))
        return claim(*args)

    monkeypatch.setattr(store, "claim", late)
    a.upsert(ids(spark, 1, 3, 4, v="a"))
    assert {r.k: r.v for r in a.read().collect()} == {0: "old", 1: "a", 2: "b", 3: "a", 4: "a"}
    a.read()
    b.upsert(ids(spark, 9))
    with pytest.raises(store.StoreConflict):
        a.replace(ids(spark, 1))
    a.update(lambda old: old.where("k > 2"))
    assert {r.k for r in b.read().collect()} == {3, 4, 9}


def test_a_crash_leaves_the_old_state(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path), ["k"])
    s.replace(ids(spark, 0, 1, 2))

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(store, "claim", crash)
        with pytest.raises(RuntimeError):
            s.replace(ids(spark, 3))
    assert s.read().count() == 3
    (tmp_path / "CURRENT-000000000002").write_text('{"n": 64, "buck')  # its writer was cut off
    assert s.read().count() == 3
    for n in range(4, 16):
        s.replace(ids(spark, *range(n)))
    assert s.read().count() == 15


def test_old_states_go(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), ["k"], buckets=2)
    for n in range(8):
        s.upsert(ids(spark, n))
    assert len(files.find_paths(spark, f"{tmp_path}/CURRENT-*")) == 8
    s.expire(keep=2, age=-1)
    assert len(files.find_paths(spark, f"{tmp_path}/CURRENT-*")) == 2 and s.read().count() == 8
    named = {p.split("/")[0] for p in s._current()[1]["buckets"].values()}
    assert named <= {p.rpartition("/")[2] for p in files.find_paths(spark, f"{tmp_path}/data-*")}


def test_cells_must_be_of_the_matrix(spark):
    cells = spark.createDataFrame([("p", "a", "pending", None), ("p", "b", "pending", None)], "prompt_id string, alias string, status string, response string")
    new = lambda *rows: spark.createDataFrame([(*r, "success", "x") for r in rows], cells.schema)
    assert {tuple(r) for r in matrix.write_cells(cells, new(("p", "a"))).collect()} == {("p", "a", "success", "x"), ("p", "b", "pending", None)}
    for bad, what in (((("z", "a"),), "no such cell: z / a"), ((("p", "a"), ("p", "a")), "two values of one cell: p / a")):
        with pytest.raises(Exception, match=what):
            matrix.write_cells(cells, new(*bad)).collect()


def test_an_existing_matrix_must_have_the_aliases(spark, tmp_path):
    (tmp_path / "m.csv").write_text("prompt_id,prompt,a,b\np2,x,,\np1,y,,\np3,z,,\n")
    path = str(tmp_path / "m.csv")
    assert [(r.prompt_id, r.position) for r in readers.matrix_prompts(spark, path, ["a", "b"]).orderBy("position").collect()] == [("p2", 0), ("p1", 1), ("p3", 2)]
    for wrong in (["a"], ["a", "b", "c"], ["b", "a"]):
        with pytest.raises(readers.CorruptFile):
            readers.matrix_prompts(spark, path, wrong)
        with pytest.raises(readers.CorruptFile):
            readers.matrix(spark, path, wrong)
    (tmp_path / "m.csv").write_text("prompt_id,prompt,a\np2,x,\np2,y,\n")
    with pytest.raises(Exception, match="two rows of the id p2"):
        readers.matrix_prompts(spark, path, ["a"]).collect()


# limits


@pytest.mark.parametrize("tasks", [1, 2, 3, 8, 64])
def test_leases_add_up(spark, tasks):
    rows = [(i, "p" if i % 2 else "q", "x" if i % 3 else "y", 400 if i == 7 else 30) for i in range(300)]
    asked = spark.createDataFrame(rows, "id long, provider string, profile string, tokens long")
    given = {"p": config.RateLimit(10, 1000), "p/y": config.RateLimit(3, 0), "q": config.RateLimit(0, 777)}
    dealt, held = completion.leased(asked, given, tasks)
    for k, x in given.items():
        own = [v for lease, v in held.items() if lease.rpartition("#")[0] == k]
        assert sum(v.requests_per_minute for v in own) == x.requests_per_minute and sum(v.tokens_per_minute for v in own) == x.tokens_per_minute and len(own) <= tasks
    met = dealt.withColumn("task", F.spark_partition_id()).collect()
    assert all(r.tokens <= (held[r.lease].tokens_per_minute or 10**9) for r in met)
    assert all(len({r.task for r in met if r.lease == lease}) == 1 for lease in {r.lease for r in met})
    assert {r.lease.rpartition("#")[0] for r in met if r.provider == "p" and r.profile == "y"} == {"p/y"}


def test_limits_hold_over_tasks(spark):
    async def ask(request):
        return {"content": "ok"}

    async def never(seconds):
        raise RuntimeError("403 waits")

    rows = [(i, "p", 400 if i == 0 else 10) for i in range(40)]
    asked = spark.createDataFrame(rows, "id long, provider string, tokens long")
    out = completion.complete(asked, lambda: ask, limits={"p": config.RateLimit(10, 1000)}, partitions=8, sleep=never).collect()
    assert sum(r.status == "success" for r in out) <= 10 and all(r.error_message == "403 waits" for r in out if r.status != "success")
    big = completion.complete(asked.where("id = 0"), lambda: ask, limits={"p": config.RateLimit(0, 1000)}, partitions=8).first()
    assert big.status == "success"  # 400 of 1000 tokens pass with eight tasks
    over = completion.complete(asked.where("id = 0"), lambda: ask, limits={"p": config.RateLimit(0, 300)}, partitions=8).first()
    assert over.status == "failed" and "can never pass" in over.error_message
    two = asked.where("id < 4").withColumn("profile", F.concat(F.lit("f"), F.col("id") % 2))
    full = completion.complete(two, lambda: ask, limits={"p/f0": config.RateLimit(1, 0), "p/f1": config.RateLimit(9, 0)}, partitions=4, sleep=never).collect()
    assert sum(r.status == "success" for r in full if r.profile == "f0") == 1 and all(r.status == "success" for r in full if r.profile == "f1")


def test_limits_and_gates_share_tasks(spark):
    asked = spark.range(200).select("id", F.lit("mock").alias("provider"), F.concat(F.lit("m"), F.col("id") % 3).alias("alias"), F.lit(5).alias("tokens"))
    dealt, held = completion.leased(asked, {"mock": config.RateLimit(50, 0)}, 8, {"mock": config.Provider("mock", max_concurrency=5)})
    rows = dealt.withColumn("task", F.spark_partition_id()).collect()
    gates = {r.gate: r.width for r in rows}
    assert sum(gates.values()) == 5 and sum(x.requests_per_minute for x in held.values()) == 50
    for c in ("gate", "lease"):
        assert all(len({r.task for r in rows if r[c] == v}) == 1 for v in {r[c] for r in rows})


def test_a_group_has_one_call_at_a_time(spark):
    async def ask(request):
        await asyncio.sleep(0.02)
        return {"content": "ok"}

    asked = spark.range(40).select("id", F.concat(F.lit("g"), F.col("id") % 4).alias("team"))
    began = time.time()
    rows = completion.complete(asked.coalesce(1), lambda: ask, serial="team", partitions=1).collect()
    for team in {r.team for r in rows}:
        own = sorted((r.began_at, r.ended_at) for r in rows if r.team == team)
        assert len(own) == 10 and all(b >= e - 1e-4 for (_, e), (b, _) in zip(own, own[1:]))
    spans = sorted((r.began_at, r.ended_at) for r in rows)
    assert any(b < e for (_, e), (b, _) in zip(spans, spans[1:])) and time.time() - began < 60


def test_a_call_that_takes_too_long_is_tried_again(spark):
    calls = []

    async def slow(request):
        await asyncio.sleep(30)

    async def at_once(_):
        calls.append(1)

    out = spark.range(2).select("id")
    rows = completion.complete(out, lambda: slow, config.Retry(max_retries=3), timeout=0.05, sleep=at_once).collect()
    assert [(r.status, r.error_type, r.retry_count) for r in rows] == [("failed", "TimeoutError", 2)] * 2


@pytest.mark.parametrize("counts", [(10**6,) * 4, (3, 10**6, 4, 2 * 10**6), (500_000, 510_000, 495_000, 505_000)])
def test_exact_p_of_large_tables(spark, counts):
    """Margins of millions: against the chances' own ratios, summed in plain Python around the observed table."""
    import math

    a, b, c, d = counts
    r1, r2, c1 = a + b, c + d, a + c
    ways, x, way = {a: 0.0}, a, 0.0
    while x < min(r1, c1) and way > -60:
        way += math.log((r1 - x) * (c1 - x) / ((x + 1) * (r2 - c1 + x + 1)))
        x += 1
        ways[x] = way
    x, way = a, 0.0
    while x > max(0, c1 - r2) and way > -60:
        x -= 1
        way -= math.log((r1 - x) * (c1 - x) / ((x + 1) * (r2 - c1 + x + 1)))
        ways[x] = way
    most = max(ways.values())
    want = sum(math.exp(w - most) for w in ways.values() if w <= 1e-7) / sum(math.exp(w - most) for w in ways.values())
    got = stats.fisher(spark.createDataFrame([counts], "a long, b long, c long, d long")).first().p_value
    assert got == pytest.approx(want, rel=1e-6)


# streams


def plain_admissions(events, requests_, tokens, seconds):
    out, at, past, held = {}, 0, deque(), 0
    for t, i, n in sorted(events):
        if tokens and n > tokens:
            out[i] = None
            continue
        at = max(at, t)
        while past and (past[0][0] <= at - seconds or requests_ and len(past) >= requests_ or tokens and held + n > tokens):
            first, own = past.popleft()
            at, held = max(at, first + seconds), held - own
        past.append((at, n))
        held += n
        out[i] = at - t
    return out


@pytest.mark.parametrize("requests_,tokens", [(0, 0), (2, 0), (0, 10), (3, 12)])
def test_streamed_admissions_match_a_plain_log(spark, tmp_path, requests_, tokens):
    rnd = random.Random(requests_ * 100 + tokens)
    rows = [(i, rnd.choice("ab"), rnd.randrange(0, 600), rnd.randrange(1, 14)) for i in range(120)]
    log = spark.createDataFrame(rows, "event_id long, bucket string, s long, tokens long").select("event_id", "bucket", F.timestamp_seconds("s").alias("ts"), "tokens")
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    end = spark.createDataFrame([(-1, "", 90_000, 0)], "event_id long, bucket string, s long, tokens long").select("event_id", "bucket", F.timestamp_seconds("s").alias("ts"), "tokens")
    for part in (log.where(F.unix_seconds("ts") < 300), log.where(F.unix_seconds("ts") >= 300).unionByName(end)):
        part.write.mode("append").parquet(source)
        limits.admit(spark, source, log.schema, sink, state, "bucket", requests=requests_, tokens=tokens, seconds=60)
    got = {r.event_id: r.wait for r in spark.read.schema("event_id long, wait double").parquet(f"{sink}/*").collect()}
    want = {}
    for b in "ab":
        want |= plain_admissions([(s, i, n) for i, x, s, n in rows if x == b], requests_, tokens, 60)
    assert got == pytest.approx(want) if None not in want.values() else got == want


@pytest.mark.parametrize("slots", [1, 3])
def test_streamed_windows_match_plain_sums(spark, tmp_path, slots):
    rnd = random.Random(slots)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.choice([rnd.randrange(1, 1800), 60 * rnd.randrange(1, 30)]), rnd.choice([None, None, rnd.randrange(14)])) for i in range(900)]
    schema = "event_id long, bucket string, s long, tokens long"
    timed = lambda some: spark.createDataFrame(some, schema).select("event_id", "bucket", F.timestamp_seconds("s").alias("ts"), "tokens")
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    late = (-2, "a", 10, 5)  # after the watermark has passed it: neither told nor counted
    parts = [[x for x in rows if x[2] // 300 in k] for k in ((0, 1), (2,), (3, 4, 5))]
    for part in (parts[0], [*parts[1], late], parts[2], [(-1, "", 90_000, 0)]):
        timed(part).coalesce(1).write.mode("append").parquet(source)
        limits.admit(spark, source, timed(rows).schema, sink, state, "bucket", seconds=60, slots=slots)
    got = {r.event_id: (r.bucket, r.wait, r.window_requests, r.window_tokens) for r in spark.read.schema(limits._OUT).parquet(f"{sink}/*").collect()}
    want = {}
    for i, b, t, _ in rows:
        held = [n for j, x, u, n in rows if x == b and t - 60 < u and (u, j) <= (t, i)]
        known = [n for n in held if n is not None]
        want[i] = (b, 0.0, len(held), sum(known) if known else None)
    assert got == want


def test_requests_are_asked_until_final(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"request_id": f"r{i}", "model_alias": "m", "prompt": f"p{i}"}) + "\n"
    status = F.when(F.col("request_id") == "r1", "fatal_failure").when((F.col("request_id") == "r2") & (F.col("attempt") < 2) | (F.col("request_id") == "r3"), "retryable_failure").otherwise("success")
    answer = lambda df: df.where("request_id <> 'r4'").select("request_id", status.alias("status"))
    for start in range(4):
        if start < 2:  # the second file has some of the first one's requests again
            (tmp_path / "in" / f"{start}.json").write_text("".join(line(i) for i in range(3 * start, 3 * start + 5)))
        requests.run_batches(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), answer).awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("attempt").collect():
        got.setdefault(r.request_id, []).append(r.status)
    again = "retryable_failure"
    assert got == {"r0": ["success"], "r1": ["fatal_failure"], "r2": [again, "success"], "r3": [again] * 3, "r4": ["pending"] * 3, "r5": ["success"], "r6": ["success"], "r7": ["success"]}

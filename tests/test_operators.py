"""Operators on small tables: combinations, personas, matrices, judgments, rates, statistics."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import judging, matrix, personas, runtime, stats
from loomgrid.streaming import requests

EAV = "dimension string, dimension_value string, indicator_name string, indicator_value string, pos long"


def eav(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EAV)


def test_combination_counts_are_exact(spark):
    m = eav(spark, [("D", "v", f"i{k}", f"{k}-{j}") for k in range(15) for j in range(10)])
    assert personas.combination_counts(m).first().combinations == 10**15
    m = eav(spark, [("D", "v", f"i{k}", f"{k}-{j}") for k in range(39) for j in range(10)])
    with pytest.raises(Exception):
        personas.combination_counts(m).collect()


@pytest.mark.parametrize("lists, n", [([1, 1, 1], 1), ([3], 3), ([1, 1, 2], 2), ([2, 3], 6)])
def test_combination_counts(spark, lists, n):
    m = eav(spark, [("D", "v", f"i{k}", f" {k}-{j} ") for k, size in enumerate(lists) for j in range(size)])
    out = personas.combinations(m).collect()
    assert len(out) == n == len({r.combination_id for r in out})
    assert personas.combination_counts(m).first().combinations == n
    assert all(v == v.strip() for r in out for v in r.indicators.values())
    assert personas.combinations(m.limit(0)).count() == 0


def two_dimensions(spark):
    rows = [("Gender", g, "job", j) for g in ("Male", "Female") for j in ("x", "y")] + [("Age", "young", "Name", n) for n in ("Bob", "Ann")] + [("Age", "old", "Name", "Zed")]
    return personas.combinations(eav(spark, rows)).withColumns({"messages": F.array(F.struct(F.col("dimension_value").alias("content"), F.lit("user").alias("role"))), "pos": F.monotonically_increasing_id()})


def test_personas_and_histories(spark):
    b = two_dimensions(spark)
    values = personas.dimension_values(b)
    dims = ["Age", "Gender"]
    assert personas.personas(values, dims).count() == 4 and personas.personas(values, dims, partial=True).count() == 8
    assert personas.personas(values, dims, True, {"Age": "old"}).count() == 3 and personas.personas(values, dims, only={"X": "y"}).count() == 0
    first = personas.personas(values, dims, partial=True).orderBy("persona_no").first()
    assert first.Age is None and first.Gender is not None
    assert personas.histories(b, dims).count() == 3 * 4
    names = spark.createDataFrame([("Bob", "Male"), ("Ann", "Female")], "name string, gender string")
    got = personas.histories(b, dims, names)
    assert got.count() == 2 + 2  # Bob with Male, Ann with Female; Zed with none
    partial = personas.histories(b, dims, names, partial=True)
    assert partial.count() == 4 + 3 + 4 and partial.select("history_id").distinct().count() == 11
    alone = partial.where(F.col("persona")["Age"].isNull()).first()
    assert set(alone.persona) == {"Age", "Gender"} and set(alone.combination_ids) == {"Gender"}
    assert personas.histories(b, dims, names, done=got.orderBy("history_id").limit(3)).count() == 1
    assert personas.expected_histories(b, personas.personas(values, dims, partial=True), dims).first().expected == 4 * 5 - 1


def cells(spark):
    rows = [(f"p{i}", f"prompt {i} {'hello' if i < 3 else ''} S{i}", a, "failed" if (i, a) == (2, "c") else "success", f"r{i}{a}", None) for i in (1, 2, 3) for a in "abc"]
    return spark.createDataFrame(rows, "prompt_id string, prompt string, alias string, status string, response string, error_message string")


def test_matrix(spark):
    c = cells(spark)
    ids = lambda d: sorted({r.prompt_id for r in d.collect()})
    assert ids(matrix.filter_rows(c, all_complete=True)) == ["p1", "p3"]
    assert ids(matrix.filter_rows(c, prompt_contains="hello")) == ["p1", "p2"] and ids(matrix.filter_rows(c, prompt_contains="S2")) == ["p2"]
    assert matrix.filter_rows(c, models=["a", "b"], all_complete=True).count() == 6
    assert ids(matrix.filter_rows(c, min_success=3)) == ["p1", "p3"] and ids(matrix.filter_rows(c, status="failed")) == []
    with pytest.raises(ValueError):
        matrix.check_models(["z"], ["a"])
    s = matrix.summary(c).first()
    assert (s.prompts, s.models, s.total, s.completed, s.failed, s.rate_limited) == (3, 3, 9, 9, 1, 0)
    wide = matrix.to_wide(c, list("abc"))
    assert wide.columns == ["prompt_id", "prompt", "a", "b", "c"]
    assert matrix.to_long(wide).select(*c.columns).exceptAll(c.withColumn("response", F.when(F.col("status") != "", F.col("response")))).count() == 0
    assert matrix.analysis(c, list("abc")).where("c IS NULL").count() == 1
    assert matrix.to_run(c, c).count() == 1
    new = spark.createDataFrame([("p2", "x", "c", "success", "late", None)], c.schema)
    assert matrix.write_cells(c, new).where("status = 'success'").count() == 9
    assert matrix.is_complete(c, c.where("alias <> 'a'")).first().complete is False


def test_prompts_are_unique(spark):
    specs = spark.createDataFrame([(0, None, " hi ", None), (1, None, "hi", None), (2, "S", "hi", None)], "prompt_no int, system string, user string, messages array<struct<content:string,role:string>>")
    assert matrix.prompts(specs).count() == 2
    assert matrix.prompts(specs, system="S").count() == 1
    with pytest.raises(Exception, match="prompt"):
        matrix.prompts(specs.withColumn("user", F.lit(" "))).collect()


def test_judging(spark):
    subjects = judging.records_to_subjects(spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "id int, t string"), "id", "t", id_field="id")
    assert [r.subject_id for r in subjects.collect()] == ["1"]
    pairs = judging.pairs(subjects, ["x", "y"], "h")
    replies = pairs.withColumns({"raw_output": F.when(F.col("judge_alias") == "x", "<final_answer>A</final_answer>"), "error_message": F.when(F.col("judge_alias") == "y", "timeout")})
    v = judging.verdicts(replies, ["A"])
    assert {r.judge_alias: r.status for r in v.collect()} == {"x": "success", "y": "call_failed"}
    assert [r.judge_alias for r in judging.pairs(subjects, ["x", "y"], "h", v).collect()] == ["y"]
    assert judging.pairs(subjects, ["x", "y"], "other", v).count() == 2
    assert judging.merge(v, v.withColumn("status", F.lit("success"))).where("status = 'success'").count() == 2
    gold = spark.createDataFrame([("1", "A")], "subject_id string, label string")
    assert judging.accuracy(v, gold).first().accuracy == 1.0


def test_rates(spark):
    rows = [(1, 0, 7), (2, 0, 5), (3, 59, 1), (4, 60, 1)]
    log = spark.createDataFrame(rows, "event_id long, s long, tokens long").select("event_id", "tokens", F.lit("p").alias("provider"), F.timestamp_seconds("s").alias("ts"))
    got = {r.event_id: (r.window_requests, r.window_tokens) for r in runtime.rate_windows(log, "provider").collect()}
    assert got == {1: (1, 7), 2: (2, 12), 3: (3, 13), 4: (2, 2)}
    for chunk in (60, 61, 100):
        assert {r.event_id: (r.window_requests, r.window_tokens) for r in runtime.rate_windows(log, "provider", 60, chunk).collect()} == got
    assert runtime.rate_violations(runtime.rate_windows(log, "provider"), 2, 0).count() == 1
    assert {r.requests for r in requests.rates(log, "provider").collect()} == {3, 1}


@pytest.mark.parametrize("chunk", [60, 100, 3600])
def test_window_tokens_match_plain_sums(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(i, rnd.choice("ab"), rnd.choice([rnd.randrange(-900, 900), 60 * rnd.randrange(-15, 15)]), rnd.choice([None, None, rnd.randrange(-3, 14)])) for i in range(600)]
    log = spark.createDataFrame([*rows, (600, "a", None, 5)], "event_id long, provider string, s long, tokens long").withColumn("ts", F.timestamp_seconds("s"))
    windows = runtime.rate_windows(log, "provider", 60, chunk)
    assert windows.columns == [*log.columns, "window_requests", "window_tokens"]
    want = []
    for i, p, t, n in rows:
        held = [m for j, q, u, m in rows if q == p and t - 60 < u and (u, j) <= (t, i)]
        known = [m for m in held if m is not None]
        want.append((i, p, t, n, len(held), sum(known) if known else None))
    assert sorted(map(tuple, windows.drop("ts").collect())) == want


def test_a_crowded_window_takes_no_longer_than_its_requests(spark):
    n, held = 120_000, 60_000
    log = spark.range(n).select(F.col("id").alias("event_id"), F.lit("p").alias("provider"), F.timestamp_millis("id").alias("ts"), (F.col("id") % 2).alias("tokens"))
    began = time.perf_counter()
    windows = runtime.rate_windows(log, "provider", held // 1000)
    got = windows.agg(F.sum("window_requests").alias("requests"), F.sum("window_tokens").alias("tokens"), F.count_if((F.col("window_requests") > 50_000) | (F.col("window_tokens") > 20_000)).alias("over")).first()
    assert runtime.rate_violations(windows, 50_000, 20_000).count() == got.over == n - 40_001
    assert time.perf_counter() - began < 60  # a sum anew for each request's window: some minutes
    assert got.requests == held * (held + 1) // 2 + (n - held) * held
    assert got.tokens == sum((i + 1) // 2 for i in range(held)) + (n - held) * held // 2


def test_replay_and_lookup(spark):
    events = spark.createDataFrame([("a", "pending", 1), ("a", "success", 2), ("b", "retryable_failure", 3)], "request_id string, status string, line_no long")
    state = runtime.replay(events)
    assert {r.request_id: r.status for r in state.collect()} == {"a": "success", "b": "retryable_failure"}
    assert [r.request_id for r in runtime.to_resume(events.select("request_id").distinct(), state).collect()] == ["b"]
    with pytest.raises(Exception, match="unknown status"):
        runtime.replay(events.withColumn("status", F.lit("odd"))).collect()
    known = spark.createDataFrame([("m", "mock", "x")], "alias string, provider string, model string")
    with pytest.raises(Exception, match="unknown model alias"):
        runtime.look_up(spark.createDataFrame([("z",)], "alias string"), known).collect()
    assert [r.position for r in runtime.positions(spark.range(20).repartition(3), ["id"]).orderBy("id").collect()] == list(range(20))


def test_statistics(spark):
    t = spark.createDataFrame([(8, 2, 1, 5)], "a long, b long, c long, d long")
    assert stats.odds_ratio(t).first().odds_ratio == pytest.approx(20)
    assert stats.fisher(t).first().p_value == pytest.approx(0.034965, abs=1e-6)
    assert stats.odds_ratio(t.withColumn("b", F.lit(0).cast("long"))).first().odds_ratio is None
    rows = spark.createDataFrame([("m", "x")] * 8 + [("m", "y")] * 2 + [("f", "x")] + [("f", "y")] * 5, "g string, o string")
    assert stats.chi_squared(rows, "g", "o").first().chi2 == pytest.approx(6.1122, abs=1e-4)
    assert stats.chi_squared(rows, "g", "o").first().p_value == pytest.approx(0.0134, abs=1e-4)
    assert stats.chi_squared(rows.where("g = 'm'"), "g", "o").first().cramers_v == 0.0


def test_positions_of_wide_rows(spark):
    """Above the size that Spark samples, with more columns than the order needs, written out: no gaps."""
    rows = spark.range(400_000).select(F.xxhash64("id").alias("a"), (F.col("id") % 1000).alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("c"), F.lit("x").alias("start"), "id")
    out = runtime.positions(rows.repartition(8), ["b", "a"])
    s = out.agg(F.count_distinct("position").alias("n"), F.min("position").alias("low"), F.max("position").alias("high")).first()
    assert tuple(s) == (400_000, 0, 399_999) and out.columns == [*rows.columns, "position"]
    wrong = out.select(F.expr("lag(struct(b, a)) over (partition by b order by position)").alias("p"), F.struct("b", "a").alias("q")).where("p >= q")
    assert wrong.count() == 0
    assert runtime.positions(rows.limit(0), ["a"]).count() == 0


def test_running_counts(spark):
    rows = spark.range(5000).select((F.col("id") % 2 * F.col("id") % 3).alias("g"), F.xxhash64("id").alias("o"), F.lit(1).alias("n")).withColumn("g", F.when(F.col("g") > 0, F.col("g").cast("string")))
    out = runtime.running(rows, "g", ["o"]).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.g, []).append((r.o, r.done, r.total))
    assert len(groups) == 3
    for g in groups.values():
        assert [d for _, d, _ in sorted(g)] == list(range(1, len(g) + 1)) and {t for *_, t in g} == {len(g)}


def test_personas_are_numbered_in_product_order(spark):
    values = eav(spark, []).select("dimension", "dimension_value", "pos").unionByName(spark.createDataFrame([(d, f"{d}{i}", 10 - i) for d, n in (("A", 2), ("B", 3), ("C", 1)) for i in range(n)], "dimension string, dimension_value string, pos long"))
    order = {d: [None, *[f"{d}{i}" for i in reversed(range(n))]] for d, n in (("A", 2), ("B", 3), ("C", 1))}
    for partial in (False, True):
        for only in ({}, {"B": "B1"}):
            import itertools

            lists = [[v for v in order[d] if (partial or v) and (d not in only or v == only[d])] for d in "ABC"]
            want = [p for p in itertools.product(*lists) if any(p)]
            got = personas.personas(values, list("ABC"), partial, only).orderBy("persona_no").collect()
            assert [(r.A, r.B, r.C) for r in got] == want and [r.persona_no for r in got] == list(range(len(want)))


def test_histories_name_their_rows_once(spark):
    b = two_dimensions(spark)
    names = spark.createDataFrame([("Bob", "Male"), ("Ann", "Female")], "name string, gender string")
    more = b.unionByName(b.where("dimension = 'Age'").withColumns({"dimension": F.lit("Job"), "combination_id": F.concat(F.lit("j"), "combination_id")}))
    made = personas.histories(more, ["Age", "Gender", "Job"], names, partial=True)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 20
    ages, genders = [("Bob", "Male"), ("Ann", "Female"), ("Zed", None), None], ["Male", "Male", "Female", "Female", None]
    fits = lambda a, g: a is None or g is None or a[1] == g
    assert made.count() == sum(fits(a, g) and fits(j, g) for a in ages for g in genders for j in ages) - 1
    with pytest.raises(ValueError, match="at most 10"):
        personas.histories(more, ["Age", "Gender", "Job"], names, most=10)


def test_unknown_models_are_an_error(spark):
    with pytest.raises(ValueError, match="unknown models: z"):
        matrix.filter_rows(cells(spark), models=["a", "z"])
    assert matrix.filter_wide(cells(spark), ["c", "a"], min_success=1).columns == ["prompt_id", "prompt", "c", "a"]


def test_exact_and_chi_squared_tails(spark):
    import math

    t = spark.createDataFrame([(30_000, 20_100, 29_000, 20_400)], "a long, b long, c long, d long")
    log = lambda *x: sum(math.lgamma(v + 1) for v in x)
    a, b, c, d = t.first()
    p = {x: math.exp(log(a + b, c + d, a + c, b + d) - log(a + b + c + d, x, a + b - x, a + c - x, d - a + x)) for x in range(a + c + 1) if x <= a + b and d - a + x >= 0}
    assert stats.fisher(t).first().p_value == pytest.approx(sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)), rel=1e-6)
    assert stats.fisher(spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, c long, d long")).first().p_value == pytest.approx(1)
    for chi2, dof, want in ((3.841459, 1, 0.05), (9.487729, 4, 0.05), (124.342, 100, 0.05), (0.0, 3, 1.0), (9000.0, 3, 0.0), (30.0, 3, 1.3800e-06)):
        assert spark.range(1).select(stats.upper_tail(F.lit(chi2), F.lit(dof)).alias("p")).first().p == pytest.approx(want, abs=1e-6)
    rows = spark.createDataFrame([("m", "x")] * 8 + [("m", "y")] * 2 + [("f", "x")] + [("f", "y")] * 5, "g string, o string")
    r = stats.chi_squared(rows, "g", "o").first()
    e = [9 * 10 / 16, 7 * 10 / 16, 9 * 6 / 16, 7 * 6 / 16]
    yates = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip([8, 2, 1, 5], e))
    assert r.p_value == pytest.approx(0.0134, abs=1e-4) and r.p_yates == pytest.approx(math.erfc(math.sqrt(yates / 2)), rel=1e-9)


@pytest.mark.parametrize("chi2", [0.01, 0.5, 1.9, 2.1, 3.841459, 10.0, 80.0, 150.0, 700.0, 5000.0])
def test_small_chances_keep_their_digits(spark, chi2):
    """One degree of freedom by erfc, even ones by their finite sum."""
    import math

    h = chi2 / 2
    for dof in (1, 2, 4, 10, 100):
        want = math.log(math.erfc(math.sqrt(h))) if dof == 1 and chi2 < 1400 else -h + math.log(sum(math.exp(k * math.log(h) - math.lgamma(k + 1)) for k in range(dof // 2))) if dof > 1 else None
        if want is not None:
            got = spark.range(1).select(stats.log_upper_tail(F.lit(chi2), F.lit(dof)).alias("p")).first().p
            assert got == pytest.approx(want, rel=2e-9, abs=2e-11), dof

"""Expressions against the fixture values and plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import ids, parse, retry, text

AWKWARD = ["", "plain", 'café "q"', "tab\tnew\nline\r", "back\\slash", "emoji \U0001f600 end", "dash – “x”", "\x01\x1f\x7f", "   pad  "]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_strip_and_ascii_json(spark):
    rows = [(s,) for s in AWKWARD]
    got = values(spark, rows, "s string", text.strip(F.col("s")), text.ascii_json(F.col("s")))
    assert got == [(s.strip(), json.dumps(s)) for s in AWKWARD]


def test_prompt_ids(spark):
    null = F.lit(None).cast("string")
    got = values(spark, [(None, "hello"), ("S", "U"), (None, 'café "q"'), (None, "a\x1fb\x0b")], "s string, u string", ids.prompt_id(text.canonical_messages(F.col("s"), F.col("u"))), ids.cell_id(ids.prompt_id(text.canonical_messages(null, F.col("u"))), F.lit(" alias-a ")))
    assert got[0] == ("483bc0874de4e0b6c4dabdc4b00615b51084f2739adbb96f6d8d071c503778e3", "d883dfa54bd52921f04aa1e505ea0713372553de0cc72078e79f065f9031cf11")
    assert got[1][0] == "824aaaf18275d5c7d18f8d512195e8adf3e7f547ac60fc976218433d280496c5"
    assert got[2][0] == "6b51ff4359b3d63c2aea7ead83d62ae181c7ef597dfb73c16e38c0854daaba72"
    odd = json.dumps({"messages": [{"content": "a\x1fb", "role": "user"}]}, separators=(",", ":"))
    assert got[3][0] == hashlib.sha256(odd.replace("b", "b\\u000b").encode()).hexdigest() or got[3][0] == hashlib.sha256(odd.encode()).hexdigest()


def test_combination_history_judgment_ids(spark):
    m = F.create_map(F.col("k"), F.col("v"))
    got = values(spark, [("Social_Status", "Elite", "Income", "90000"), ("Age", "Young adults (18–30)", "employment", "a student")], "d string, dv string, k string, v string", ids.combination_id(F.col("d"), F.col("dv"), m))
    assert [g[0] for g in got] == ["fbc07d68d01da34e2f5df592844ebe47db57098f6ad7f83d2a515ded9b627b36", "593af37cb48e28782afddfd590695b0a76937c20b638408b88cf64e8d524ef4c"]
    h = F.create_map(F.lit("Gender"), F.lit("g1"), F.lit("Age"), F.lit("a1"))
    one = values(spark, [(1,)], "x int", ids.history_id(h), ids.judgment_id(F.lit("s1"), F.lit(None).cast("string"), F.lit("alice"), F.lit("h1")), ids.judgment_id(F.lit("p1"), F.lit("m1"), F.lit("alice"), F.lit("h1")))
    assert one == [("335b6a2bb3a772ae58f2689a8b35b8606ed8ec186cd51ca7169d19cb6cc851aa", "5a5b19ea06aa8f80aac69309", "d70e4bbe6e99a5ab39613be3")]


def test_subject_ids(spark):
    got = values(spark, [(0, "a"), (1, "b")], "i int, content string", ids.subject_id(F.col("i"), ids.spaced_json({"content": F.col("content")})))
    assert [g[0] for g in got] == ["4be0782a1fba670e", "3efc0b9e8e917c13"]


@pytest.mark.parametrize(
    "raw, label, status",
    [
        ("just prose", None, "missing_sentinel"),
        ("", None, "missing_sentinel"),
        ("<final_answer>B</final_answer> actually <final_answer>A</final_answer>", "A", "matched"),
        ("<final_answer>a</final_answer>", None, "unmatched"),
        ("<Final_Answer>  A </ final_answer >", "A", "matched"),
        ("<final_answer>\nA\n</final_answer>", "A", "matched"),
        ("<final_answer>__NONE__</final_answer>", None, "none_declared"),
        ("<final_answer>A</final_answer>\nextra", None, "unmatched"),
        ("<final_answer>A</final_answer>\n", None, "unmatched"),
    ],
)
def test_final_answer(spark, raw, label, status):
    got = spark.createDataFrame([(raw,)], "r string").select(parse.final_answer(F.col("r"), ["A"]).alias("p"), parse.final_answer(F.col("r"), None).alias("q")).first()
    assert (got.p.final_class, got.p.parse_status, got.q.parse_status) == (label, status, "free_form")


def test_cells(spark):
    good = [('{"status":"success","response":"x\\"y"}', "success", 'x"y'), ('{"status":"failed","error_message":"e","metadata":{"a":1}}', "failed", None), ("", None, None), (None, None, None), ('{"status":"success","response":{"a":[1]}}', "success", '{"a":[1]}')]
    got = spark.createDataFrame(good, "c string, s string, r string").select(parse.decode_cell(F.col("c")).alias("d"), "s", "r").collect()
    for row in got:
        assert (row.d is None) if row.s is None else (row.d.status, row.d.response) == (row.s, row.r)
    for bad in ("[1]", "{", '{"status":"odd"}', "1"):
        with pytest.raises(Exception, match="cell"):
            spark.createDataFrame([(bad,)], "c string").select(parse.decode_cell(F.col("c"))).collect()
        assert spark.createDataFrame([(bad,)], "c string").select(parse.lenient_cell(F.col("c")).alias("d")).first().d is None or "status" in bad


def test_redaction(spark):
    rows = ["Invalid API key: sk-1234567890abcdef", "Bearer token abc123xyz expired", "short sk-123", "api_key=abcdef123 bad"]
    got = values(spark, [(r,) for r in rows], "s string", text.redact_log(F.col("s")), text.redact_retry(F.col("s")))
    assert got == [("Invalid API key: [REDACTED]", "Invalid API key: sk-***REDACTED***"), ("Bearer [REDACTED] expired", "Bearer token: ***REDACTED*** expired"), ("short sk-123", "short sk-123"), ("api_key=abcdef123 bad", "api_key: ***REDACTED*** bad")]


def test_templates(spark):
    m = F.create_map(F.lit("a"), F.lit("<b>"), F.lit("b c"), F.lit("2"))
    row = spark.range(1).select(text.render(F.lit("x <a> <b c> < y"), m).alias("t"), text.missing_keys(F.lit("<a> <q> <q> <p>"), m).alias("k")).first()
    assert (row.t, row.k) == ("x <b> 2 < y", ["p", "q"])
    with pytest.raises(Exception, match="q"):
        spark.range(1).select(text.render(F.lit("<q>"), m)).collect()


def test_backoff_and_decisions(spark):
    rows = spark.range(1, 5).select(retry.backoff(F.col("id")).alias("a"), retry.backoff(F.col("id"), base=10, most=30).alias("b"), retry.backoff(F.col("id"), seed=1).alias("j")).collect()
    assert [r.a for r in rows] == [1, 2, 4, 8] and [r.b for r in rows] == [10, 20, 30, 30]
    assert all(0.5 * r.a <= r.j <= 1.5 * r.a for r in rows)
    d = lambda n, kind, hint: retry.decide(F.lit(n), F.lit(kind), F.lit(hint).cast("double"))["action"]
    got = spark.range(1).select(d(3, "rate_limit", None), d(2, "rate_limit", None), d(1, "auth_failure", None), d(9, "unknown", 0.0), d(1, "unknown", 7200.0)).first()
    assert list(got) == ["fail", "retry_with_backoff", "fail", "retry_after_hint", "rate_limited"]


def test_waits(spark):
    got = values(spark, [(x,) for x in (None, "", " 3 ", "-1", "nan", "inf", "x")], "s string", retry.wait_seconds(F.col("s")))
    assert [g[0] for g in got] == [None, None, 3.0, 0.0, None, None, None]


def test_options_and_words(spark):
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("ab \t\né") for _ in range(30)) for _ in range(50)]
    got = values(spark, [(t,) for t in texts], "s string", text.words(F.col("s")))
    assert [g[0] for g in got] == [len(t.split()) for t in texts]
    pick = values(spark, [("arts",), ("I choose LAW now",), ("none",)], "s string", text.pick_option(F.col("s"), ["Law", "Arts"]))
    assert [p[0] for p in pick] == ["Arts", "Law", "none"]


def test_fold_and_transcript(spark):
    turns = [("S1", "system"), ("hi </turn>", "User"), ("S2", "system"), ("u", "user")]
    df = spark.createDataFrame([(turns,)], "m array<struct<content:string,role:string>>")
    row = df.select(text.fold_system(F.col("m"), F.lit("Gemma-2")).alias("f"), text.fold_system(F.col("m"), F.lit("gpt")).alias("g"), text.transcript(F.col("m")).alias("t")).first()
    assert [tuple(x) for x in row.f] == [("hi </turn>", "User"), ("S1\n\nS2\n\nu", "user")] and len(row.g) == 4
    assert row.t == '<conversation>\n<turn role="user">hi </ turn></turn>\n<turn role="user">u</turn>\n</conversation>'

"""Response scoring against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from sweeplens.functions import answers as A
from sweeplens.functions import payload as P
from sweeplens.operators import scoring as S


@pytest.mark.parametrize("actual, estimate, want", [
    ("323", "323", 1.0), ("0", "0", 0.0), ("12", "120", 2 / 3), ("100", "50", 2 / 15), ("7", "007", 1.0), ("-5", "5", 0.0),
])
def test_answer_score(one, actual, estimate, want):
    assert one(s=A.answer_score(F.lit(actual), F.lit(estimate)))["s"] == pytest.approx(want, abs=1e-12)


def test_answer_score_long_numbers(one):
    """Exact integers of 60 digits agree with the double form."""
    a, e = int("123456789" * 6 + "123456"), int("987654321" * 6 + "987654")
    want = 1 - abs(a - e) / max(a, e)
    assert one(s=A.answer_score(F.lit(str(a)), F.lit(str(e))))["s"] == pytest.approx(want, abs=1e-15)


def test_digit_runs_and_think_blocks(one):
    row = one(
        a=A.digit_runs(F.lit("25,774 and 007")), b=A.strip_thinking(F.lit("x<think>1\n2</think> y <think>3")),
        c=A.digit_runs(F.lit("٣٤")), d=A.strip_thinking(F.lit(" <think>a</think>b<think>c</think>d\n")))
    assert row == {"a": ["25", "774", "007"], "b": "x y", "c": ["34"], "d": "bd"}


def emotions(spark, text, mode="blend", ref=(5.0, 5.0, 5.0, 5.0)):
    rows = spark.createDataFrame([(text, list(ref))], "raw_output string, reference array<double>")
    r = S.score_emotions(rows, mode=mode).first()
    return r["extracted"], r["confidence"], r["score"]


BOTH = "FIRST PASS SCORES:\nA: 7\nB: 8\nC: 3\nD: 6\nCritique: x\nRevised scores:\nA: 5\nB: 8\nC: 3\nD: 6\n[End of answer] E: 1"


def test_emotion_ladder(spark):
    assert emotions(spark, BOTH)[:2] == ([6.0, 8.0, 3.0, 6.0], 1.0)
    assert emotions(spark, BOTH, "first_pass")[:2] == ([7.0, 8.0, 3.0, 6.0], 1.0)
    assert emotions(spark, "Revised scores: A: 1 B: 2 C: 3")[:2] == ([1.0, 2.0, 3.0, 5.0], 0.9)
    assert emotions(spark, "First pass scores: A: 11 B: 2 C: 3 D: 4 E: 5")[:2] == ([2.0, 3.0, 4.0, 5.0], 0.8)
    assert emotions(spark, "1 2 3 4 5")[:2] == ([1.0, 2.0, 3.0, 4.0], 0.5)
    assert emotions(spark, "3 and 4")[:2] == ([3.0, 4.0, 5.0, 5.0], 0.25)
    assert emotions(spark, "none")[:2] == ([5.0] * 4, 0.0)
    assert emotions(spark, "<think>1 2 3 4</think> none")[1] == 0.0


def test_emotion_score(one):
    five, ref = F.array(*[F.lit(5.0)] * 4), F.array(*[F.lit(x) for x in (7.0, 8.0, 3.0, 6.0)])
    row = one(a=A.emotion_score(five, ref, F.lit(1.0)), b=A.emotion_score(five, ref, F.lit(0.0)),
              c=A.emotion_score(F.lit(None).cast("array<double>"), ref, F.lit(1.0)))
    assert row == {"a": pytest.approx(0.8), "b": 0.5, "c": 0.5}


def test_math_fallback(spark):
    rows = spark.createDataFrame([("<think>42", 42), ("<think>1</think> 42", 42), ("no", 1)], "raw_output string, answer bigint")
    got = [(r["has_valid_final_answer"], r["fallback_used"], r["score"]) for r in S.score_math(rows).collect()]
    assert got == [(False, True, 1.0), (True, False, 1.0), (False, False, 0.0)]


def test_preflight_verdicts(spark):
    rows = spark.createDataFrame([("5", 5, 1), ("x", 5, 2), ("y", 5, 3)], "raw_output string, answer bigint, qid int")
    scored = S.score_math(rows)
    verdict = lambda k, rate: S.preflight(scored, ["qid"], k, rate).first()["verdict"]
    assert verdict(1, 0.9) == "pass" and verdict(3, 0.9) == "below_threshold"
    assert S.preflight(scored.filter("qid > 1"), ["qid"], 3, 0.1).first()["verdict"] == "zero"
    assert S.preflight(scored.limit(0), ["qid"], 3, 0.1).first()["verdict"] == "empty"
    with pytest.raises(Exception, match="preflight failed"):
        S.preflight(scored, ["qid"], 3, 0.9, strict=True).collect()


OBJECTS = [
    ('Thoughts first {"thought":"ok","action":"run_tests"} trailing', "ok"), ('{"action":"read_file","path":"a"}', "ok"),
    ('{"action":"read_file"}', "missing_fields"), ('{"action":"fly"}', "unsupported"), ("no json", "parse_error"),
    ('{"a": "unterminated', "parse_error"), ('x {"action":" finish ","summary":"a}b{\\"c"} y', "ok"), ("{bad} {\"action\":\"run_tests\"}", "parse_error"),
    ('{"action":"replace_text","path":"p","old":null,"new":"x"}', "ok"), ('{"noaction":1}', "parse_error"), (None, "parse_error"),
]


def test_json_objects_and_actions(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(OBJECTS)], "step int, raw_output string")
    got = {r["step"]: r["status"] for r in S.classify_steps(rows).collect()}
    assert [got[k] for k in range(len(OBJECTS))] == [want for _, want in OBJECTS]


def test_step_records(spark):
    rows = spark.createDataFrame([("t", 1, "no", False), ("t", 2, '{"action":"search","query":"q"}', False), ("t", 3, '{"action":"finish","summary":"s"}', True)],
                                 "task string, step int, raw_output string, good boolean")
    r = S.step_records(S.classify_steps(rows), ["task"], ok="good", solved="good").first()
    assert (r["steps"], r["parse_errors"], r["tool_errors"], r["exit_status"]) == (3, 1, 1, "submitted_success")


def test_payload_order(spark):
    texts = ['{"score": 1, "math_score": 2}', '{"math_score": 2}', '{"eq_score": 3}', "4.5", '{"score": "x", "eq_score": 3}', '{"score": null, "eq_score": 3}', '"6"', "[1]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.payload_score(F.parse_json("t")).alias("s"))
    assert [r["s"] for r in rows.collect()] == [1.0, 2.0, 3.0, 4.5, None, None, 6.0, None]


def test_prompts(one):
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(" Be brief ").alias("content")), F.struct(F.lit("user").alias("role"), F.lit("Hi").alias("content")))
    row = one(a=S.render_messages(msgs), b=S.render_messages(msgs, False, "<s>"), n=S.numbered_text(F.lit("a\nb\n")))
    assert row["a"] == "SYSTEM: Be brief\n\nUSER: Hi\n\nASSISTANT:" and row["b"] == "<s>SYSTEM: Be brief\n\nUSER: Hi"
    assert row["n"] == "   1: a\n   2: b"


def test_other_scripts_and_plain_text_are_read_alike(spark, one):
    """Plain text takes the fast patterns, any foreign character the wide ones; a think block costs nothing where there is none."""
    assert emotions(spark, "First pass scores: A:\u2003\u0667 B: 2 C: 3")[0] == [7.0, 2.0, 3.0, 5.0]
    assert emotions(spark, "First pass scores: 1. Ab: 7 2.B: 2 xyz C : 9 D: 3.5 \u00e9: 4 E: 6")[0] == [7.0, 2.0, 3.5, 6.0]
    assert emotions(spark, "First pass scores: 1. Ab: 7 2.B: 2 xyz C : 9 D: 3.5 -: 4 E: 6")[0] == [7.0, 2.0, 3.5, 6.0]
    rows = spark.createDataFrame([("a b", [5.0] * 4)], "raw_output string, reference array<double>")
    plan = S.score_emotions(rows).select("score")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(_text") == 2  # each section is cut out once

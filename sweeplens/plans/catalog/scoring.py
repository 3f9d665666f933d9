"""Response scoring, gates, prompts and agent steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.operators import localization as Z
from sweeplens.operators import scoring as S
from sweeplens.plans import fixtures as fx


def math_scores_by_config(spark, d):
    out = S.config_scores(S.score_math(fx.math_responses(spark, d)), ["cfg_id"])
    return out.select(
        "cfg_id", F.round("score", 9).alias("score"), "responses", "valid_final_answer_count", "fallback_used_count",
        F.round("valid_final_answer_rate", 9).alias("valid_final_answer_rate"),
        F.round("fallback_used_rate", 9).alias("fallback_used_rate"))


def math_best_answer(spark, d):
    scored = S.score_math(fx.math_responses(spark, d))
    return scored.groupBy(F.array_join("extracted", " ").alias("extracted"), "answer").agg(
        F.count("*").alias("n"), F.round(F.max("score"), 9).alias("score"))


def eq_scores_by_config(spark, d):
    out = S.config_scores(S.score_emotions(fx.eq_responses(spark, d)), ["cfg_id"], math=False)
    return out.select("cfg_id", F.round("score", 9).alias("score"), "responses",
                      F.round("mean_confidence", 9).alias("mean_confidence"))


def eq_first_pass(spark, d):
    out = S.config_scores(S.score_emotions(fx.eq_responses(spark, d), mode="first_pass"), ["cfg_id"], math=False)
    return out.select("cfg_id", F.round("score", 9).alias("score"), "responses",
                      F.round("mean_confidence", 9).alias("mean_confidence"))


def extraction_rates(spark, d):
    scored = S.score_emotions(fx.eq_responses(spark, d))
    return scored.groupBy(F.round("confidence", 6).alias("confidence")).agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("score"))


def math_preflight(spark, d):
    order = ["qid", "raw_output", "answer"]
    first = S.first_responses(fx.math_responses(spark, d), order, 40)
    out = S.preflight(S.score_math(first), order, 40, 0.9)
    return out.select("samples", F.round("score", 9).alias("score"), F.round("rate", 9).alias("rate"), "verdict")


def eq_preflight(spark, d):
    order = ["qid", "raw_output", "ref1", "ref3", "ref4"]
    first = S.first_responses(fx.eq_responses(spark, d), order, 40)
    out = S.preflight(S.score_emotions(first), order, 40, 0.5, math=False)
    return out.select("samples", F.round("score", 9).alias("score"), F.round("rate", 9).alias("rate"), "verdict")


def combined_scores(spark, d):
    math = S.config_scores(S.score_math(fx.math_responses(spark, d)), ["cfg_id"])
    eq = S.config_scores(S.score_emotions(fx.eq_responses(spark, d)), ["cfg_id"], math=False)
    out = S.combine_metrics(math, eq, ["cfg_id"])
    return out.select("cfg_id", *[F.round(c, 9).alias(c) for c in ("math_score", "eq_score", "score_sum", "score_mean")])


def prompt_table(spark, d):
    files = fx.localization(spark, d).withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(2)).withColumn(
        "code_snippet", F.concat(F.lit("x = "), F.col("h"), F.lit("\n")))
    grouped = Z.candidate_lists(files, ["issue_id", "condition"], order="h")
    text = S.render_messages(S.ranking_messages(
        F.col("issue_id"), F.col("condition"), F.lit(" it fails "), F.col("candidate_files")))
    return grouped.select("issue_id", F.md5(text).alias("prompt_md5"), F.length(text).alias("prompt_chars"))


def math_prompts(spark, d):
    text = S.render_messages(S.math_messages(F.col("text")), bos="<s>")
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text).alias("prompt_md5"))


def emotion_prompts(spark, d):
    text = S.render_messages(S.emotion_messages(F.col("text")))
    return fx.table(spark, d, "documents").select("doc_id", F.md5(text).alias("prompt_md5"))


def agent_step_status(spark, d):
    out = S.classify_steps(fx.steps(spark, d))
    return out.groupBy("condition", F.coalesce("action", F.lit("-")).alias("action"), "status").agg(
        F.count("*").alias("n"))


def agent_step_runs(spark, d):
    out = S.step_records(S.classify_steps(fx.steps(spark, d)), ["condition", "task_id"])
    return out.select("condition", "task_id", "steps", "parse_errors", "exit_status")


QUERIES = {
    f.__name__: f for f in (
        math_scores_by_config, math_best_answer, eq_scores_by_config, eq_first_pass, extraction_rates, math_preflight,
        eq_preflight, combined_scores, prompt_table, math_prompts, emotion_prompts, agent_step_status, agent_step_runs)
}

_A, _E = "cast(answer as varchar)", "cast(cast(t as bigint) as varchar)"
_WIDE = f"cast(greatest(len({_A}), len({_E})) as int)"
_X, _Y = (f"cast(rpad({v}, {_WIDE}, '0') as double)" for v in (_A, _E))

MATH_SQL = f"""
 mr as ({fx.MATH_RESPONSES_BODY}),
 ms as (select *, regexp_extract_all(regexp_replace(regexp_replace(raw_output, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', ''), '[0-9]+') as own,
   regexp_extract_all(raw_output, '[0-9]+') as every from mr),
 mx as (select *, case when len(own) > 0 then own else every end as extracted,
   len(own) > 0 as valid, len(own) = 0 and len(every) > 0 as fallback from ms),
 mscored as (select *, coalesce(list_max(list_transform(extracted, lambda t:
   case when greatest({_X}, {_Y}) = 0 then 0e0
   else (1e0 - abs({_X} - {_Y}) / greatest({_X}, {_Y})) * (1e0 - abs(len({_A}) - len({_E})) / cast({_WIDE} as double)) end)), 0e0) as score from mx)
"""

_NAMED = r"'(?:[0-9]\.\s*)?[A-Za-z]+:\s*([0-9]+(?:\.[0-9]+)?)'"


def _eq_sql(mode: str) -> str:
    stop = r"critique:|\z" if mode == "blend" else r"\[end of answer\]|critique:|revised scores:|\z"
    ladder = (
        "case when f is not null and r is not null then [(f[1]+r[1])/2, (f[2]+r[2])/2, (f[3]+r[3])/2, (f[4]+r[4])/2]"
        " when r is not null then r when f is not null then f when len(loose) >= 4 then loose[1:4]"
        " else list_concat(loose, [5e0, 5e0, 5e0, 5e0])[1:4] end"
    )
    conf = (
        "case when f is not null and r is not null then 1e0 when r is not null then 0.9e0 when f is not null then 0.8e0"
        " when len(loose) >= 4 then 0.5e0 else len(loose) / 8e0 end"
    )
    if mode != "blend":
        ladder = ladder.replace("r is not null", "false")
        conf = ("case when f is not null then 1e0 when len(loose) >= 4 then 0.5e0 else len(loose) / 8e0 end")
    return rf"""
 er as ({fx.EQ_RESPONSES_BODY}),
 es as (select *,
   list_filter(list_transform(regexp_extract_all(regexp_extract(raw_output, '(?is)first pass scores:(.*?)(?:{stop})', 1), {_NAMED}, 1)[1:4], lambda x: cast(x as double)), lambda x: x between 0 and 10) as f0,
   list_filter(list_transform(regexp_extract_all(regexp_extract(raw_output, '(?is)revised scores:(.*?)(?:\[end of answer\]|\z)', 1), {_NAMED}, 1)[1:4], lambda x: cast(x as double)), lambda x: x between 0 and 10) as r0,
   list_filter(list_transform(regexp_extract_all(raw_output, '\b([0-9]+(?:\.[0-9]+)?)\b', 1), lambda x: cast(x as double)), lambda x: x between 0 and 10) as loose
   from er),
 ep as (select *, case when len(f0) >= 3 then list_concat(f0, [5e0])[1:4] end as f,
   case when len(r0) >= 3 then list_concat(r0, [5e0])[1:4] end as r from es),
 el as (select *, {ladder} as p, {conf} as confidence from ep),
 escored as (select *, confidence * greatest(0e0, 1e0 - (abs(p[1]-ref1) + abs(p[2]-ref2) + abs(p[3]-ref3) + abs(p[4]-ref4)) / 40e0)
   + (1e0 - confidence) * 0.5e0 as score from el)"""


EQ_SQL = _eq_sql("blend")

PROMPT_SQL = f"""
with f as ({fx.LOC_BODY}), c as (
 select issue_id, condition, string_agg('Candidate ' || k || ': ' || file_path || ' lines 1-2' || chr(10) || '```text' || chr(10) || 'x = ' || h || chr(10) || '```', chr(10) || chr(10) order by k) as body
 from (select *, row_number() over (partition by issue_id, condition order by h, file_path) as k from f) group by 1, 2),
p as (select issue_id, 'SYSTEM: ' || '{S.RANKING_SYSTEM_PROMPT.strip()}' || chr(10) || chr(10) || 'USER: Issue ID: ' || issue_id || chr(10) || 'Repository: ' || condition || chr(10) || chr(10) || 'Bug report:' || chr(10) || 'it fails' || chr(10) || chr(10) || 'Candidate files:' || chr(10) || chr(10) || body || chr(10) || chr(10) || 'Rank the candidate file paths from most likely root cause to least likely.' || chr(10) || chr(10) || 'ASSISTANT:' as t from c)
select issue_id, md5(t) as prompt_md5, cast(length(t) as int) as prompt_chars from p
"""

ORACLES = {
    "math_scores_by_config": f"""with {MATH_SQL} select cfg_id, round(avg(score), 9) as score, count(*) as responses,
        count(*) filter (where valid) as valid_final_answer_count, count(*) filter (where fallback) as fallback_used_count,
        round(avg(cast(valid as int)), 9) as valid_final_answer_rate, round(avg(cast(fallback as int)), 9) as fallback_used_rate
        from mscored group by 1""",
    "math_best_answer": f"""with {MATH_SQL} select array_to_string(extracted, ' ') as extracted, answer, count(*) as n,
        round(max(score), 9) as score from mscored group by 1, 2""",
    "eq_scores_by_config": f"""with {EQ_SQL} select cfg_id, round(avg(score), 9) as score, count(*) as responses,
        round(avg(confidence), 9) as mean_confidence from escored group by 1""",
    "eq_first_pass": f"""with {_eq_sql('first_pass')} select cfg_id, round(avg(score), 9) as score, count(*) as responses,
        round(avg(confidence), 9) as mean_confidence from escored group by 1""",
    "extraction_rates": f"""with {EQ_SQL} select round(confidence, 6) as confidence, count(*) as n,
        round(avg(score), 9) as score from escored group by 1""",
    "math_preflight": f"""with {MATH_SQL}, q as (select * from mscored order by qid, raw_output, answer limit 40)
        select count(*) as samples, round(avg(score), 9) as score, round(avg(cast(len(extracted) > 0 as int)), 9) as rate,
         case when avg(cast(len(extracted) > 0 as int)) = 0 then 'zero' when avg(cast(len(extracted) > 0 as int)) < 0.9 then 'below_threshold' else 'pass' end as verdict from q""",
    "eq_preflight": f"""with {EQ_SQL}, q as (select * from escored order by qid, raw_output, ref1, ref3, ref4 limit 40)
        select count(*) as samples, round(avg(score), 9) as score, round(avg(cast(confidence > 0 as int)), 9) as rate,
         case when avg(cast(confidence > 0 as int)) = 0 then 'zero' when avg(cast(confidence > 0 as int)) < 0.5 then 'below_threshold' else 'pass' end as verdict from q""",
    "combined_scores": f"""with {MATH_SQL}, {EQ_SQL}, m as (select cfg_id, avg(score) as a from mscored group by 1),
        e as (select cfg_id, avg(score) as b from escored group by 1)
        select cfg_id, round(a, 9) as math_score, round(b, 9) as eq_score, round(a + b, 9) as score_sum,
         round((a + b) * 0.5e0, 9) as score_mean from m join e using (cfg_id)""",
    "prompt_table": PROMPT_SQL,
    "math_prompts": f"""select doc_id, md5('<s>SYSTEM: {S.MATH_SYSTEM_PROMPT}' || chr(10) || chr(10) || 'USER: /no_think '
        || regexp_replace(text, '\\s+$', '') || chr(10) || chr(10) || 'ASSISTANT:') as prompt_md5 from documents""",
    "emotion_prompts": """select doc_id, md5('USER: ' || regexp_replace('/no_think ' || text, '\\s+$', '') || chr(10) || chr(10) || 'ASSISTANT:') as prompt_md5 from documents""",
    "agent_step_status": f"""with s as ({fx.STEPS_BODY}) select condition,
        case (task_id + step) % 8 when 0 then 'run_tests' when 1 then 'search' when 2 then 'fly' when 4 then 'search' when 5 then 'read_file' when 7 then 'finish' else '-' end as action,
        case (task_id + step) % 8 when 1 then 'missing_fields' when 2 then 'unsupported' when 3 then 'parse_error' when 6 then 'parse_error' else 'ok' end as status,
        count(*) as n from s group by 1, 2, 3""",
    "agent_step_runs": f"""with s as ({fx.STEPS_BODY}) select condition, task_id, count(*) as steps,
        count(*) filter (where (task_id + step) % 8 in (1, 2, 3, 6)) as parse_errors,
        case when count(*) filter (where (task_id + step) % 8 = 7) > 0 then 'finished' else 'step_limit' end as exit_status
        from s group by 1, 2""",
}

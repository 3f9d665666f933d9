"""Response scoring, per-configuration means, gates, prompts and agent steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.functions import answers as A
from sweeplens.functions import payload as P
from sweeplens.functions.layers import squeeze
from sweeplens.functions.text import lines_of


def score_math(responses: DataFrame, text: str = "raw_output", answer: str = "answer") -> DataFrame:
    """Numbers outside think blocks first; numbers of the whole text as fallback."""
    staged = responses.withColumn("_own", A.digit_runs(A.strip_thinking(F.col(text))))
    valid = F.size("_own") > 0
    staged = staged.withColumn("extracted", F.when(valid, F.col("_own")).otherwise(A.digit_runs(F.col(text))))
    return (
        staged.withColumn("has_valid_final_answer", valid)
        .withColumn("fallback_used", ~valid & (F.size("extracted") > 0))
        .withColumn("score", A.best_answer_score(F.col(answer), F.col("extracted")))
        .drop("_own")
    )


def score_emotions(responses: DataFrame, text: str = "raw_output", reference: str = "reference",
                   mode: str = "blend") -> DataFrame:
    """Predicted values, extraction confidence and score of four-emotion answers."""
    staged = responses.withColumn("_text", A.strip_thinking(F.col(text)))
    revised = A.revised_section(F.col("_text")) if mode == "blend" else F.lit("")
    # Column by column: an expression that is read twice is evaluated twice, a column is not.
    staged = staged.select("*", A.first_section(F.col("_text"), mode).alias("_s1"), revised.alias("_s2"))
    staged = staged.select("*", A.section_numbers(F.col("_s1")).alias("_n1"), A.section_numbers(F.col("_s2")).alias("_n2"))
    staged = staged.select("*", A.named_scores(F.col("_n1")).alias("_first"), A.named_scores(F.col("_n2")).alias("_revised"))
    named = F.col("_first").isNotNull() | F.col("_revised").isNotNull()  # then the ladder does not come to the loose ones
    staged = staged.withColumn("_loose", F.when(~named, A.loose_scores(F.col("_text"))))
    ladder = A.emotion_ladder(F.col("_first"), F.col("_revised"), F.col("_loose"), mode)
    staged = staged.withColumn("_picked", ladder)
    return (
        staged.withColumn("extracted", F.col("_picked.values"))
        .withColumn("confidence", F.col("_picked.confidence"))
        .withColumn("score", A.emotion_score(F.col("extracted"), F.col(reference), F.col("confidence")))
        .drop("_text", "_s1", "_s2", "_n1", "_n2", "_first", "_revised", "_loose", "_picked")
    )


def config_scores(scored: DataFrame, keys: list[str], math: bool = True) -> DataFrame:
    """Mean score per configuration, with extraction counts and rates for numbers.

    Plain mergeable aggregates: each task sends one row per key, so a key that
    holds a third of all responses costs no more than any other.
    """
    aggs = [F.avg("score").alias("score"), F.count("*").alias("responses")]
    if math:
        for flag, label in (("has_valid_final_answer", "valid_final_answer"), ("fallback_used", "fallback_used")):
            aggs.append(F.count_if(flag).alias(f"{label}_count"))
            aggs.append(F.avg(F.col(flag).cast("int")).alias(f"{label}_rate"))
    else:
        aggs.append(F.avg("confidence").alias("mean_confidence"))
    return scored.groupBy(*keys).agg(*aggs)


def combine_metrics(math: DataFrame, eq: DataFrame, keys: list[str]) -> DataFrame:
    """Both metrics per configuration with their sum and their mean."""
    m = math.select(*keys, F.col("score").alias("math_score"))
    q = eq.select(*keys, F.col("score").alias("eq_score"))
    total = F.col("math_score") + F.col("eq_score")
    return m.join(q, keys).withColumn("score_sum", total).withColumn("score_mean", total * 0.5)


def first_responses(responses: DataFrame, order: list[str], samples: int) -> DataFrame:
    """The responses a preflight looks at; taken before they are scored, the others need no scoring."""
    return responses.orderBy(*order).limit(samples)


def preflight(scored: DataFrame, order: list[str], samples: int, min_rate: float, math: bool = True,
              strict: bool = False) -> DataFrame:
    """Extraction-quality verdict over the first ``samples`` responses."""
    probe = scored.orderBy(*order).limit(samples)
    hit = F.size("extracted") > 0 if math else F.col("confidence") > 0
    out = probe.agg(
        F.count("*").alias("samples"), F.avg("score").alias("score"),
        F.avg(hit.cast("int")).alias("rate"))
    verdict = (
        F.when(F.col("samples") == 0, "empty").when(F.col("rate") == 0, "zero")
        .when(F.col("rate") < min_rate, "below_threshold").otherwise("pass")
    )
    if strict:
        verdict = F.when(verdict == "pass", verdict).otherwise(
            F.raise_error(F.concat(F.lit("preflight failed: "), verdict)).cast("string"))
    return out.withColumn("verdict", verdict)


# --- prompts ---------------------------------------------------------------

# Instruction texts the scored responses were generated with.
MATH_SYSTEM_PROMPT = (
    "You are a highly intelligent AI. You have extraordinary intuition and can "
    "easily make accurate estimations. For the following questions, you will "
    "always provide an answer, even if you are not certain."
)
RANKING_SYSTEM_PROMPT = """You are evaluating a software bug report for fault localization.

Given a bug report and candidate source files, rank the files by how likely they are to contain the root cause.

Return exactly one JSON object and no markdown:
{"ranked_files": ["path/to/file.py", "..."], "rationale": "short reason"}

Rules:
- Only use file paths from the candidate list.
- Include every candidate file exactly once in ranked_files.
- Rank most likely first.
"""
NO_THINK_PREFIX = "/no_think "
CANDIDATE_PROMPT, SNIPPET_PROMPT, SNIPPET_END = "Candidate ", "\n```text\n", "\n```"
ISSUE_PROMPT, REPOSITORY_PROMPT, REPORT_PROMPT = "Issue ID: ", "\nRepository: ", "\n\nBug report:\n"
FILES_PROMPT = "\n\nCandidate files:\n\n"
RANK_PROMPT = "\n\nRank the candidate file paths from most likely root cause to least likely."


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def math_messages(question: Column, no_think: bool = True) -> Column:
    user = F.concat(F.lit(NO_THINK_PREFIX), question) if no_think else question
    return F.array(_message("system", F.lit(MATH_SYSTEM_PROMPT)), _message("user", user))


def emotion_messages(prompt: Column, no_think: bool = True) -> Column:
    return F.array(_message("user", F.concat(F.lit(NO_THINK_PREFIX), prompt) if no_think else prompt))


def ranking_messages(issue_id: Column, repo: Column, report: Column, candidates: Column) -> Column:
    """Messages asking to rank ``candidates`` (structs with path, snippet, line range)."""
    def block(c: Column, k: Column) -> Column:
        span = F.when(
            c["start_line"].isNotNull() & c["end_line"].isNotNull(),
            F.format_string(" lines %d-%d", c["start_line"], c["end_line"])).otherwise("")
        snippet = F.regexp_replace(F.coalesce(c["code_snippet"], F.lit("")), r"(?U)\s+\z", "")
        return F.concat(
            F.lit(CANDIDATE_PROMPT), (k + 1).cast("string"), F.lit(": "), c["file_path"], span,
            F.lit(SNIPPET_PROMPT), snippet, F.lit(SNIPPET_END))

    blocks = F.array_join(F.transform(candidates, block), "\n\n")
    user = F.concat(
        F.lit(ISSUE_PROMPT), issue_id.cast("string"), F.lit(REPOSITORY_PROMPT), repo,
        F.lit(REPORT_PROMPT), squeeze(report), F.lit(FILES_PROMPT), blocks, F.lit(RANK_PROMPT))
    return F.array(_message("system", F.lit(RANKING_SYSTEM_PROMPT)), _message("user", user))


def render_messages(messages: Column, generation_prompt: bool = True, bos: str = "") -> Column:
    """Role-tagged plain text, used where a model has no chat template."""
    lines = F.transform(messages, lambda m: F.concat(F.upper(squeeze(m["role"])), F.lit(": "), squeeze(m["content"])))
    if generation_prompt:
        lines = F.concat(lines, F.array(F.lit("ASSISTANT:")))
    text = squeeze(F.array_join(lines, "\n\n"))
    return F.when(text.startswith(bos), text).otherwise(F.concat(F.lit(bos), text)) if bos else text


def numbered_text(text: Column) -> Column:
    """Lines with right-aligned four-wide numbers."""
    return F.array_join(
        F.transform(lines_of(text), lambda l, k: F.concat(F.format_string("%4d: ", k + 1), l)), "\n")


# --- agent steps -----------------------------------------------------------

def classify_steps(steps: DataFrame, text: str = "raw_output") -> DataFrame:
    """First JSON object of each step, its action name and whether it is usable."""
    staged = steps.withColumn("payload", P.first_json_object(F.col(text)))
    return staged.withColumn("action", P.action_name(F.col("payload"))).withColumn(
        "status", P.action_status(F.col("payload")))


def step_records(classified: DataFrame, keys: list[str], order: str = "step", ok: str | None = None,
                 solved: str | None = None) -> DataFrame:
    """One run record per task: steps, errors and exit status.

    A usable ``finish`` step ends a run; ``solved`` names a boolean column that
    tells whether the final check passed, ``ok`` one for a step's tool result.
    """
    usable = F.col("status") == "ok"
    last = F.max(F.when(usable & (F.col("action") == "finish"), F.col(order)))
    failed = usable & (F.col("action") != "finish") & ~F.coalesce(F.col(ok), F.lit(True)) if ok else F.lit(False)
    done = F.coalesce(F.bool_or(solved), F.lit(False)) if solved else F.lit(False)
    out = classified.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.count_if(~usable).alias("parse_errors"),
        F.count_if(failed).alias("tool_errors"), last.isNotNull().alias("_finished"), done.alias("success"))
    status = (
        F.when(F.col("success") & F.col("_finished"), "submitted_success")
        .when(F.col("success"), "step_limit_success").when(F.col("_finished"), "finished").otherwise("step_limit"))
    return out.withColumn("exit_status", status).withColumn(
        "execution_errors", F.col("parse_errors") + F.col("tool_errors")).drop("_finished")

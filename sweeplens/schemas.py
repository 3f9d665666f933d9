"""Schemas of the external documents."""

from __future__ import annotations

RUN_RECORD = (
    "task_id string, condition string, success boolean, steps int, execution_errors int, runtime_seconds double, "
    "extra_layers int, overhead_fraction double"
)
_EMOTIONS = "struct<emotion1_score: double, emotion2_score: double, emotion3_score: double, emotion4_score: double>"
PROBE = (
    "question: string, answer: string, prompt: string, "
    f"reference_answer: {_EMOTIONS}, reference_answer_fullscale: {_EMOTIONS}"
)
CANDIDATE_FILE = "struct<file_path: string, code_snippet: string, start_line: int, end_line: int>"
EXAMPLE = (
    "issue_id string, repo string, base_commit string, bug_report string, "
    f"candidate_files array<{CANDIDATE_FILE}>, ground_truth string, metadata string"
)
MANIFEST = "dataset_name string, split string, instance_ids array<string>"
REPORT = ", ".join(f"{b}_ids array<string>" for b in ("resolved", "unresolved", "empty_patch", "incomplete", "error"))

def as_struct(fields: str) -> str:
    """``a int, b string`` to ``struct<a: int, b: string>``."""
    parts, depth, start = [], 0, 0
    for k, ch in enumerate(fields):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            parts.append(fields[start:k])
            start = k + 1
    parts.append(fields[start:])
    return "struct<" + ", ".join(": ".join(p.strip().split(" ", 1)) for p in parts) + ">"

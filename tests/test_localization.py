"""Patches, distractors, snippets, examples and ranked answers."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sweeplens.functions import text as X
from sweeplens.operators import localization as Z
from sweeplens.plans import fixtures as fx
from sweeplens.session import shared_dir

PATCH = """diff --git a/src/a.py b/src/a.py
index 1..2
--- a/src/a.py
+++ b/src/a.py
@@ -5,2 +5,3 @@ def f():
-x
@@ -40 +41 @@
+y
diff --git a/tests/test_a.py b/tests/test_a.py
@@ -7,1 +7,1 @@
+t
diff --git a/docs/x.md b/docs/x.md
@@ -9 +9 @@
+m
diff --git a/lib/b.js b/lib/b.js
new file
diff --git a/src/a.py b/src/a.py
@@ -90 +90 @@
+z
"""


def test_changed_files(spark):
    rows = spark.createDataFrame([(1, PATCH), (2, ""), (3, PATCH.replace("\n", "\r\n"))], "issue_id int, patch string")
    got = {r["issue_id"]: [(c["path"], list(c["starts"])) for c in r["changed"]] for r in Z.changed_files(rows).collect()}
    assert got[1] == got[3] == [("src/a.py", [5, 40, 90]), ("lib/b.js", [1])] and got[2] == []
    tests = Z.changed_files(rows, include_tests=True).filter("issue_id = 1").first()["changed"]
    assert [c["path"] for c in tests] == ["src/a.py", "tests/test_a.py", "lib/b.js"]


def test_file_patch(one):
    block = one(a=Z.file_patch(F.lit(PATCH), F.lit("tests/test_a.py")), b=Z.file_patch(F.lit(PATCH), F.lit("nope")), c=Z.file_patch(F.lit(PATCH), F.lit("src/a.py")))
    assert block["a"] == "diff --git a/tests/test_a.py b/tests/test_a.py\n@@ -7,1 +7,1 @@\n+t" and block["b"] == ""
    assert block["c"].startswith("diff --git a/src/a.py") and block["c"].endswith("+y")


def test_path_predicates(spark):
    cases = {"src/a.py": (True, False), "tests/a.py": (False, True), "a/test/b.go": (False, True), "x/test_a.py": (False, True), "x/a_test.py": (False, True),
             "x/a.spec.ts": (False, True), "contest/a.py": (True, False), "a.md": (False, False), "A.PY": (True, False), ".py": (False, False), "x/a.b.hpp": (True, False)}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", X.is_source_path(F.col("p")).alias("s"), X.is_test_path(F.col("p")).alias("t"))
    assert {r["p"]: (r["s"], r["t"]) for r in rows.collect()} == cases


@pytest.mark.parametrize("text, want", [
    ("a\nb\n", ["a", "b"]), ("a\n\n", ["a", ""]), ("", []), ("a\r\nb\x0bc\x0cd e\x85f", ["a", "b", "c", "d", "e", "f"]), ("\n", [""]),
])
def test_lines(one, text, want):
    assert text.splitlines() == want
    assert one(x=X.lines_of(F.lit(text)))["x"] == want


def test_snippets(one):
    lines = F.array(*[F.lit(f"l{k}") for k in range(1, 11)])
    bounds = lambda c, m: one(b=X.snippet_bounds(lines, F.lit(c), m))["b"]
    assert bounds(5, 4) == {"start": 3, "end": 6} and bounds(1, 4) == {"start": 1, "end": 4} and bounds(99, 4) == {"start": 7, "end": 10}
    assert bounds(3, 50) == {"start": 1, "end": 10}
    focus = lambda text: one(x=X.first_definition_line(X.lines_of(F.lit(text))))["x"]
    assert focus("\n# def no\nx = 1\n  def f():\n") == 4 and focus("\n\nx\n") == 3 and focus("\n") == 1 and focus("// class A\npublic class B {") == 2


def brute(truth, paths, count):
    from pathlib import PurePosixPath as P
    t = P(truth)
    root = t.parent.parent if t.parent != P(".") else P(".")
    under = lambda p: root == P(".") or root in P(p).parents
    pool = [p for p in paths if p != truth and P(p).suffix == t.suffix and under(p)]
    parts = lambda q: len(q.parts)
    return sorted(pool, key=lambda p: (P(p).parent != t.parent, abs(parts(P(p).parent) - parts(t.parent)), p))[:count]


def test_distractors_match_brute_force(spark):
    rng = random.Random(2)
    paths = {"/".join([*(rng.choice("abc") for _ in range(rng.randrange(4))), f"f{rng.randrange(60)}" + rng.choice([".py", ".py", ".js"])]) for _ in range(220)}
    paths |= {f"a/hot/f{k}.py" for k in range(150)}
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    truths = files.select("repo", F.col("path").alias("truth"))
    got = {}
    for r in Z.choose_distractors(truths, files, 4).orderBy("position").collect():
        got.setdefault(r["truth"], []).append(r["path"])
    for truth in paths:
        assert got.get(truth, []) == brute(truth, paths, 4), truth


def test_examples_and_report(spark):
    code = "\n".join(f"line {k}" for k in range(30))
    files = spark.createDataFrame([("r", f"src/f{k}.py", code if k else "short") for k in range(5)] + [("r", "lib/x.py", code)], "repo string, path string, text string")
    diff = lambda p: f"diff --git a/{p} b/{p}\n@@ -3 +3 @@\n+x"
    issues = spark.createDataFrame(
        [("ok", "r", diff("src/f1.py")), ("none", "r", diff("a.md")), ("two", "r", diff("src/f1.py") + "\n" + diff("src/f2.py")), ("gone", "r", diff("src/zz.py")),
         ("short", "r", diff("src/f0.py")), ("alone", "r", diff("lib/x.py"))], "issue_id string, repo string, patch string")
    rows = {r["issue_id"]: r for r in Z.build_examples(issues, files, distractors=3, snippet_lines=10, min_lines=5).collect()}
    assert {k: r["skip_reason"] for k, r in rows.items()} == {
        "ok": "not enough usable distractor snippets", "none": "no source file in patch", "two": "patch changes 2 source files",
        "gone": "correct file missing/unreadable: src/zz.py", "short": "correct file too short: src/f0.py", "alone": "not enough usable distractor snippets"}
    few = {r["issue_id"]: r for r in Z.build_examples(issues, files.filter("path <> 'src/f0.py'"), distractors=3, snippet_lines=10, min_lines=5).collect()}
    assert few["ok"]["skip_reason"] is None and few["ok"]["ground_truth"] == "src/f1.py"
    own = {c["file_path"]: (c["start_line"], c["end_line"]) for c in few["ok"]["candidate_files"]}
    assert own["src/f1.py"] == (1, 10) and len(own) == 4
    many = Z.build_examples(issues, files, distractors=9, snippet_lines=10, min_lines=5).filter("issue_id = 'ok'").first()
    assert many["skip_reason"] == "only found 5 distractors"
    scanned = Z.scan_order(issues, 1, 10)
    report = Z.keep_report(Z.build_examples(scanned, files.filter("path <> 'src/f0.py'"), distractors=3, snippet_lines=10, min_lines=5), 1)
    assert report.filter("decision = 'keep'").count() == 1


ANSWERS = [  # the first case is a golden of the original's tests, ported as it is
    ('{"ranked_files": ["b.py", "a.py"], "rationale": "b"}', ["b.py", "a.py", "c.py"], "json", 2, 1),
    ('x {"ranking": [" c.py ", "zz", "c.py"]}', ["c.py", "a.py", "b.py"], "json", 2, 1),
    ("maybe c.py before a.py", ["c.py", "a.py", "b.py"], "path_order_fallback", 2, 1),
    ('{"ranked_files": [], "note": "b.py"}', ["b.py", "a.py", "c.py"], "path_order_fallback", 1, 2),
    ('{"ranked_files": "b.py"}', ["b.py", "a.py", "c.py"], "path_order_fallback", 1, 2),
    ("nothing", ["a.py", "b.py", "c.py"], "path_order_fallback", 0, 3),
    ('{"ranked_files": ["a.py", "a.py", "a.py", "b.py"]}', ["a.py", "b.py", "c.py"], "json", 4, -1),
]


def test_ranked_answers(spark):
    rows = spark.createDataFrame([(k, a[0], ["a.py", "b.py", "c.py"]) for k, a in enumerate(ANSWERS)], "id int, raw_answer string, candidate_paths array<string>")
    got = Z.parse_rankings(rows).orderBy("id").collect()
    assert [(r["ranked_files"], r["parser"], r["valid_ranked_count"], r["completed_missing_candidates"]) for r in got] == [a[1:] for a in ANSWERS]


def test_mentions_inside_longer_paths(spark):
    rows = spark.createDataFrame([("see ba.py then c.py", ["a.py", "c.py"])], "raw_answer string, candidate_paths array<string>")
    assert Z.parse_rankings(rows).first()["ranked_files"] == ["a.py", "c.py"]
    assert Z.parse_rankings(rows, whole_paths=True).first()["ranked_files"] == ["c.py", "a.py"]


def test_scores_and_summary(spark):
    rows = spark.createDataFrame([("v", ["b", "a", "c"], "a"), ("v", ["a"], "a"), ("v", ["b"], "z")], "condition string, ranked_files array<string>, ground_truth string")
    scored = Z.score_rankings(rows)
    assert [(r["rank"], r["top1"], r["top3"], r["mrr"]) for r in scored.collect()] == [(2, False, True, 0.5), (1, True, True, 1.0), (None, False, False, 0.0)]
    s = Z.summarize(scored).first()
    assert (s["n"], s["top1_accuracy"], s["top3_accuracy"], s["mrr"], s["avg_rank"]) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3), 0.5, 1.5)


def test_pending_window(spark):
    ex = spark.createDataFrame([(k,) for k in range(5)], "issue_id int")
    cond = spark.createDataFrame([("a",), ("b",)], "condition string")
    done = spark.createDataFrame([("a", 2)], "condition string, issue_id int")
    got = sorted((r["condition"], r["issue_id"]) for r in Z.pending_pairs(ex, cond, done, start=1, count=2, order=["issue_id"]).collect())
    assert got == [("a", 1), ("b", 1), ("b", 2)]
    assert Z.pending_pairs(ex, cond, done).count() == 9


def test_search(spark):
    files = spark.createDataFrame([("r", "b.py", "x = 1\nfind me\n"), ("r", "a.py", "find\nno\nfind"), ("r", ".hid/c.py", "find"), ("r", "d.txt", "find")], "repo string, path string, text string")
    hits = [(r["path"], r["line"]) for r in Z.search_text(files, ["find"], 20).orderBy("hit").collect()]
    assert hits == [("a.py", 1), ("a.py", 3), ("b.py", 2)]
    assert Z.search_text(files, ["find"], 2).count() == 2


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """More input makes more tasks, not larger ones: the rows of localization() are dealt by number."""
    monkeypatch.setattr("sweeplens.session.ROWS_PER_TASK", 200, raising=False)
    rows = fx.localization(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("task")).count().collect()
    total = sum(r["count"] for r in rows)
    assert total > 5000 and max(r["count"] for r in rows) < 500


def test_issues_meet_their_snippets_last(spark):
    """Many issues at one line share one snippet: it is cut and kept once, not once an issue."""
    files = spark.createDataFrame([("r", f"src/f{k}.py", "\n".join(f"line {k} {n}" for n in range(30))) for k in range(5)], "repo string, path string, text string")
    issues = spark.createDataFrame([(i, "r", "diff --git a/src/f0.py b/src/f0.py\n@@ -5 +5 @@\n-x") for i in range(50)], "issue_id int, repo string, patch string")
    out = Z.build_examples(issues, files, distractors=3, snippet_lines=10, min_lines=5)
    rows = out.collect()
    assert len(rows) == 50 and all(r["skip_reason"] is None and len(r["candidate_files"]) == 4 and r["true_edit"] for r in rows)
    plan = out.select("issue_id", "skip_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "_own" not in plan and "true_edit" not in plan


def test_issues_leave_names_only_on_disk(spark):
    """Hunks at many lines of one file: neither patches nor a snippet a line are written, just the names asked for."""
    files = spark.createDataFrame([("r", f"src/f{k}.py", "\n".join(f"line {k} {n} " + "x" * 60 for n in range(3000))) for k in range(5)], "repo string, path string, text string")
    issues = spark.createDataFrame([(n, "r", f"diff --git a/src/f0.py b/src/f0.py\n@@ -{n + 1} +{n + 1} @@\n-x") for n in range(2000)], "issue_id int, repo string, patch string")
    written = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if f.is_file())
    before = written()
    out = Z.build_examples(issues, files, distractors=3, snippet_lines=10, min_lines=5)
    assert written() - before < 50_000
    rows = out.select("issue_id", F.expr("filter(candidate_files, c -> c.file_path = ground_truth)[0].start_line").alias("start")).collect()
    assert len(rows) == 2000 and all(r["start"] == max(1, r["issue_id"] - 4) for r in rows)


def test_own_snippets_match_plain_python(spark):
    """Every line of files with blank lines, ends of their own and odd terminators, cut around and counted as the original does."""
    rng = random.Random(5)
    texts = ["", "\n", "a", "a\n\n", *("".join(rng.choice(["", "", "a", " b", "c"]) + rng.choice(["\n", "\r\n", "\x0b", "\n"]) for _ in range(rng.randrange(1, 14))) for _ in range(12))]
    files = spark.createDataFrame([("r", f"src/f{k}.py", t) for k, t in enumerate(texts)] + [("r", "src/none.py", None)], "repo string, path string, text string")
    diff = lambda p, n: f"diff --git a/{p} b/{p}\n@@ -{n} +{n} @@\n+x"
    issues = spark.createDataFrame([(f"{k}:{n}", "r", diff(f"src/f{k}.py", n)) for k in range(len(texts)) for n in range(16)] + [("none:1", "r", diff("src/none.py", 1))], "issue_id string, repo string, patch string")

    def want(k, n, size=4, least=3):
        lines = texts[k].splitlines()
        middle = max(0, min(len(lines) - 1, n - 1))
        end = min(len(lines), max(0, middle - size // 2) + size)
        start = max(0, end - size)
        snippet = "\n".join(lines[start:end])
        if len(lines) < least:
            return f"correct file too short: src/f{k}.py", None
        if len(snippet.splitlines()) < least:
            return "correct snippet too short", None
        return None, (snippet, start + 1, end)

    rows = Z.build_examples(issues, files, distractors=0, snippet_lines=4, min_lines=3).collect()
    assert len(rows) == 16 * len(texts) + 1
    for r in rows:
        if r["issue_id"] == "none:1":
            assert r["skip_reason"] == "correct file missing/unreadable: src/none.py"
            continue
        reason, own = want(*map(int, r["issue_id"].split(":")))
        assert r["skip_reason"] == reason, r["issue_id"]
        assert (own is None) == (r["candidate_files"] is None)
        if own:
            c, = r["candidate_files"]
            assert (c["code_snippet"], c["start_line"], c["end_line"]) == own and c["file_path"] == r["ground_truth"]

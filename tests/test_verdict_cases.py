"""Inputs that the fixtures of the registered queries do not hold."""

import json
import random

from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.functions import payload as P
from sweeplens.operators import analysis as A
from sweeplens.operators import beam as B
from sweeplens.operators import localization as Z


def test_long_numbers(one):
    got = one(zeros=L.parse_spec(8, F.lit("(0000000000,3)")), plain=L.parse_spec(8, F.lit("(0,3)")), few=L.parse_spec(8, F.lit("layers:0000000001,2")),
              over=L.parse_spec(8, F.lit("layers:1,99999999999")), csv=L.counts_from_csv(F.lit("00000000000001,2")), bad=L.counts_from_csv(F.lit("1,99999999999")))
    assert got["zeros"] == got["plain"] and got["few"] == [1, 2] and got["csv"] == [1, 2]
    assert got["over"] is None and got["bad"] is None


def test_padded_actions_and_paths(spark, one):
    got = one(a=P.action_status(P.first_json_object(F.lit('{"action": "search\\n", "query": "x"}'))), b=P.action_status(P.first_json_object(F.lit('{"action": "\\tfly"}'))))
    assert got == {"a": "ok", "b": "unsupported"}
    answers = spark.createDataFrame([('{"ranked_files": ["b.py\\n", "a.py\\t"]}', ["a.py", "b.py", "c.py"])], "raw_answer string, candidate_paths array<string>")
    row = Z.parse_rankings(answers).first()
    assert row["ranked_files"] == ["b.py", "a.py", "c.py"] and row["valid_ranked_count"] == 2


def test_hits_follow_path_parts(spark):
    files = spark.createDataFrame([("r", p, "x") for p in ("a.py", "a-b/x.py", "a/x.py")], "repo string, path string, text string")
    assert [r["path"] for r in Z.search_text(files, ["x"]).orderBy("hit").collect()] == ["a/x.py", "a-b/x.py", "a.py"]


def test_run_without_cells(spark):
    diffs = spark.createDataFrame([("some", 1.0), ("some", -0.5), ("none", None), ("none", None)], "run string, value double")
    got = {r["run"]: (r["vmin"], r["vmax"]) for r in A.clip_bounds(diffs, ["run"]).collect()}
    assert got["none"] == (-1.0, 1.0) and got["some"][0] < 0 < got["some"][1]


def test_seed_needs_both_metrics(spark):
    rows = [(0, 0, 1.0, 1.0), (0, 2, 1.5, 1.2), (1, 3, 0.5, 0.7), (2, 4, 9.0, None), (3, 4, None, 9.0)]
    entries, stats = B.seed_entries(spark.createDataFrame(rows, "i int, j int, math_score double, eq_score double"), 6)
    full, want = B.seed_entries(spark.createDataFrame(rows[:3], "i int, j int, math_score double, eq_score double"), 6)
    assert entries.count() == full.count() == 3 and stats == want


def plain_object(text):
    """The first object by walking over the characters; None when there is none."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for at in range(start, len(text)) if start >= 0 else ():
        c = text[at]
        if quoted:
            quoted, escaped = (True, False) if escaped else (c != '"', c == "\\")
            continue
        quoted = c == '"'
        depth += (c == "{") - (c == "}")
        if not depth:
            try:
                return json.loads(text[start: at + 1])
            except ValueError:
                return None
    return None


def test_first_object_as_a_character_walk_finds_it(spark):
    rng = random.Random(8)
    pieces = ['{', '}', '"', '"a"', ':', ',', ' ', '\\"', '\\\\', '1', 'NaN', 'Infinity', 'null', '"k":', '{"x":', "'", 'é', '[', ']', '"a{":']
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(1500)]
    texts += ['{"a":1,"a":2}', '{"a":NaN,"b":-Infinity}', 'x {"a":{"b":"}"}} {', '{"a":"' + "y" * 100_000 + '\\\\"}', "{'a':1}", '{"a":1,}', '{"a":01}', "{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    found = {r["id"]: r["k"] for r in rows.select("id", F.map_keys(P.first_json_object(F.col("t"))).alias("k")).collect()}
    for k, text in enumerate(texts):
        want = plain_object(text)
        assert (found[k] is None) == (want is None), text
        assert want is None or list(dict.fromkeys(found[k])) == list(want), text


def test_repeated_keys_and_odd_numbers_are_read(spark, one):
    got = one(
        a=P.action_status(P.first_json_object(F.lit('{"action":"search","action":"search","query":"q"}'))),
        b=P.action_status(P.first_json_object(F.lit('{"action":"search","query":NaN}'))),
        c=P.action_status(P.first_json_object(F.lit('{"action":"search","action":"fly","query":"q"}'))))
    assert got == {"a": "ok", "b": "ok", "c": "unsupported"}
    answers = [('{"ranked_files":["c.py"],"ranked_files":["b.py","b.py"]}', "json", ["b.py", "a.py", "c.py"]), ('{"ranking":["c.py"],"score":NaN}', "json", ["c.py", "a.py", "b.py"]),
               ('{"ranked_files":"[\\"c.py\\"]"} b.py', "path_order_fallback", ["c.py", "b.py", "a.py"])]
    rows = spark.createDataFrame([(t, ["a.py", "b.py", "c.py"]) for t, _, _ in answers], "raw_answer string, candidate_paths array<string>")
    got = [(r["raw_answer"], r["parser"], r["ranked_files"]) for r in Z.parse_rankings(rows).collect()]
    assert sorted(got) == sorted(answers)


def test_spec_documents(one):
    cases = {'{"layers":["0",2]}': [0, 2], '{"layers":"x","key":"0,1"}': None, '{"blocks":"0,2"}': [0, 1, 0, 1, 2, 3], '{"key":[1,2]}': [0, 1, 1, 2, 3],
             '{"key":[1,2,3]}': None, '{"spec":"layers:3,1"}': [3, 1], '{"spec":[0,1,2]}': [0, 1, 2], '"0,1"': [0, 0, 1, 2, 3], "[0,9]": None, "7": None, "{}": None,
             '{"layer_indices":[0,5]}': None, '{"blocks":"0,1;2,3"}': [0, 0, 1, 2, 2, 3]}
    got = one(**{f"c{k}": L.parse_document(4, F.parse_json(F.lit(doc))) for k, doc in enumerate(cases)})
    assert [got[f"c{k}"] for k in range(len(cases))] == list(cases.values())

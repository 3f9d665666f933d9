"""Agent runs, document readers and writers, and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators import analysis as A
from sweeplens.operators import grid as G
from sweeplens.operators import runs as R
from sweeplens.sources import readers, writers
from sweeplens.streaming import results as T


def test_summary_and_deltas(spark):
    rows = spark.createDataFrame(
        [("t1", "baseline", True, 10, 1, 20.0, 0, 0.0), ("t2", "baseline", False, 12, 2, 30.0, 0, 0.0),
         ("t1", "block_24_35", True, 8, 0, 25.0, 11, 0.17), ("t2", "block_24_35", True, 9, 1, 28.0, 11, 0.17)],
        "task_id string, condition string, success boolean, steps int, execution_errors int, runtime_seconds double, extra_layers int, overhead_fraction double")
    summary = R.summarize(rows)
    got = {r["condition"]: r for r in summary.collect()}
    assert got["baseline"]["success_rate"] == 0.5 and got["block_24_35"]["success_rate"] == 1.0 and got["block_24_35"]["avg_steps"] == 8.5
    deltas = {r["condition"]: r for r in R.compare_to_baseline(summary, "baseline").collect()}
    assert deltas["block_24_35"]["delta_success_rate"] == 0.5 and deltas["baseline"]["delta_avg_steps"] == 0.0
    with pytest.raises(Exception, match="baseline condition not found"):
        R.compare_to_baseline(summary, "nope").collect()


def test_run_records(spark):
    tasks = spark.createDataFrame([(f"task_{k}",) for k in ("resolved", "empty", "incomplete", "error", "none")], "task_id string")
    cond = spark.createDataFrame([("baseline",)], "condition string")
    meta = spark.createDataFrame([("baseline", "task_resolved", 12, 100.0, 0, 1), ("baseline", "task_empty", 3, 10.0, 0, 2), ("baseline", "task_incomplete", 0, 5.0, 1, 3),
                                  ("baseline", "task_empty", 4, 11.0, 0, 9)], "condition string, task_id string, steps int, runtime_seconds double, returncode int, seq int")
    report = spark.createDataFrame([("baseline", ["task_resolved"], [], ["task_empty"], ["task_incomplete", "task_resolved"], ["task_error"])],
                                   "condition string, resolved_ids array<string>, unresolved_ids array<string>, empty_patch_ids array<string>, incomplete_ids array<string>, error_ids array<string>")
    buckets = R.bucket_rows(report, ["condition"]).withColumnRenamed("instance_id", "task_id")
    got = {r["task_id"]: r for r in R.run_records(tasks, cond, meta, buckets).collect()}
    assert {k: r["evaluation_status"] for k, r in got.items()} == {"task_resolved": "resolved", "task_empty": "empty_patch", "task_incomplete": "incomplete", "task_error": "error", "task_none": "not_evaluated"}
    assert {k: r["execution_errors"] for k, r in got.items()} == {"task_resolved": 1, "task_empty": 0, "task_incomplete": 1, "task_error": 1, "task_none": 0}
    assert got["task_empty"]["steps"] == 4 and got["task_none"]["submission_empty"] is True and got["task_resolved"]["success"]


@pytest.mark.parametrize("spec", ["", "2:5", "::3", "-3:", ":-2", "::-1", "5:1:-2", "1:-1:2"])
def test_manifest_slice(spark, spec):
    ids = [f"i{k}" for k in range(9)]
    rows = spark.createDataFrame([(i,) for i in ids], "instance_id string")
    got = [r["instance_id"] for r in R.manifest_slice(rows, spec=spec).orderBy("position").collect()]
    assert got == ids[slice(*[int(p) if p else None for p in (spec.split(":") + ["", ""])[:3]])]


def test_missing_attributes_fail(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "condition string")
    attrs = spark.createDataFrame([("a", 1)], "condition string, x int")
    with pytest.raises(Exception, match="missing attributes for: b"):
        R.attach_attributes(runs, attrs).collect()
    assert R.attach_attributes(runs, attrs, strict=False).count() == 2


def test_grid_pairs_everything_once(spark):
    for n in (0, 1, 64, 200):
        entries = spark.range(n).select(F.col("id").alias("c"), (F.col("id") % 3).alias("extra"))
        got = G.grid(spark.range(7).toDF("t"), entries).collect()
        assert sorted(map(tuple, got)) == [(t, c, c % 3) for t in range(7) for c in range(n)]
    repeated = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    assert sorted(str(r["c"]) for r in G.grid(spark.range(1).toDF("t"), repeated).collect()) == ["None", "a", "a"]


def test_unfinished_pairs(spark, monkeypatch):
    rng = random.Random(4)
    tasks, entries = list(range(40)), [f"c{k}" for k in range(150)]
    done = {(t, c) for t in tasks for c in entries if rng.random() < 0.6} | {(99, "c1"), (1, "other")}
    for blocks in (1024, 1):  # a list that is sent to all tasks, and one that is shuffled
        monkeypatch.setattr(G, "BROADCAST_BLOCKS", blocks)
        frame = spark.createDataFrame([(t, "x") for t in [*tasks, None]], "task bigint, note string")
        finished = spark.createDataFrame([*done, *list(done)[:50], (None, "c1"), (1, None)], "task bigint, condition string")
        got = G.unfinished(frame, spark.createDataFrame([(c,) for c in [*entries, None]], "condition string"), finished, "task", "condition")
        assert got.columns == ["task", "note", "condition"]
        want = {(t, c) for t in [*tasks, None] for c in [*entries, None]} - done
        assert sorted(((r["task"], r["condition"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_only_row(spark):
    table = spark.range(1).toDF("a")
    assert spark.range(1).select(G.only_row(table).alias("x")).first()["x"] == [(0,)]
    with pytest.raises(Exception, match="more than one row"):
        spark.range(1).select(G.only_row(spark.range(2).toDF("a")).alias("x")).collect()


def test_flatten(spark):
    doc = {"model": {"model_name": "m", "model_kwargs": {"temperature": 0.5, "x": None}}, "agent": {"cost_limit": 0, "tags": [1, 2], "none": {}}}
    rows = spark.createDataFrame([(1, json.dumps(doc))], "id int, d string").select("id", F.parse_json("d").alias("doc"))
    got = {r["path"]: r["value"] for r in R.flatten_json(rows, ["id"]).collect()}
    assert got == {"model.model_name": '"m"', "model.model_kwargs.temperature": "0.5", "model.model_kwargs.x": "null", "agent.cost_limit": "0", "agent.tags": "[1,2]"}
    deep = 1
    for _ in range(15):
        deep = {"d": deep}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, "{}"), (3, "[1]"), (4, "5"), (5, '{"a":{}}'), (6, None)], "id int, d string")
    got = R.flatten_json(rows.select("id", F.try_parse_json("d").alias("doc")), ["id"]).collect()
    assert [(r["id"], r["path"], r["value"], r["spec"]) for r in got] == [(1, ".".join("d" * 15), "1", ".".join("d" * 15) + "=1")]


# --- readers and writers ---------------------------------------------------

def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2))
    return str(path)


REC = {"task_id": "t", "condition": "c", "success": True, "steps": 1, "execution_errors": 0, "runtime_seconds": 2.5}


def test_run_record_shapes(spark, tmp_path):
    full = {**REC, "task_id": "u", "extra_layers": 3, "overhead_fraction": 0.5}
    paths = [put(tmp_path / "a.json", [REC, full]), put(tmp_path / "b.json", {"runs": [REC, full]}), put(tmp_path / "c.jsonl", json.dumps(REC) + "\n\n" + json.dumps(full) + "\n")]
    for path in paths:
        got = {r["task_id"]: (r["extra_layers"], r["overhead_fraction"], r["success"]) for r in readers.run_records(spark, path).collect()}
        assert got == {"t": (0, 0.0, True), "u": (3, 0.5, True)}, path


def test_condition_shapes(spark, tmp_path):
    docs = [{"conditions": [{"name": "a", "extra_layers": 2}]}, {"conditions": {"a": {"extra_layers": 2}}}, {"a": {"extra_layers": 2}}, [{"name": "a", "extra_layers": 2}]]
    for k, doc in enumerate(docs):
        got = [(r["condition"], r["extra_layers"], r["overhead_fraction"]) for r in readers.conditions(spark, put(tmp_path / f"{k}.json", doc)).collect()]
        assert got == [("a", 2, 0.0)]
    route = readers.routes(spark, put(tmp_path / "r.json", {"routes": {"a": {"env": {"K": "1"}}}})).select("condition", F.variant_get("route", "$.env.K", "string")).first()
    assert tuple(route) == ("a", "1")


def test_probe_examples_manifest(spark, tmp_path):
    probe = {"q1": {"question": "1+1?", "answer": 2}, "q2": {"prompt": "p", "reference_answer_fullscale": {"emotion1_score": 7, "emotion3_score": 1.5}}}
    got = {r["qid"]: r for r in readers.probe_set(spark, put(tmp_path / "p.json", probe)).collect()}
    assert got["q1"]["answer"] == "2" and got["q1"]["reference"] is None and got["q2"]["reference"] == [7.0, 5.0, 1.5, 5.0]
    ex = {"issue_id": "i", "bug_report": "b", "candidate_files": [{"file_path": "a.py", "code_snippet": "x"}], "ground_truth": "a.py"}
    for k, doc in enumerate(([ex], {"examples": [ex]})):
        r = readers.localization_examples(spark, put(tmp_path / f"e{k}.json", doc)).first()
        assert r["repo"] == "" and r["candidate_files"][0]["file_path"] == "a.py"
    with pytest.raises(Exception, match="ranking example without"):
        readers.localization_examples(spark, put(tmp_path / "bad.json", [{"issue_id": "i"}])).collect()
    ok = {"dataset_name": "d", "split": "s", "instance_ids": ["b", "a"]}
    assert [r["instance_id"] for r in readers.manifest(spark, put(tmp_path / "m.json", ok)).orderBy("position").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="manifest without"):
        readers.manifest(spark, put(tmp_path / "m2.json", {"split": "s"})).collect()


def test_config_and_candidate_files(spark, tmp_path):
    path = put(tmp_path / "x.config", "# head\n\n0,0\n (1,2) \nlayers:0,1\nblocks:0,1;1,2\nbad\n")
    got = [(r["source_line"], r["spec"], r["layer_key"]) for r in readers.config_lines(spark, path, 3).orderBy("source_line").collect()]
    assert got == [(3, "layers:0,1,2", [0, 1, 2]), (4, "layers:0,1,1,2", [0, 1, 1, 2]), (5, "layers:0,1", [0, 1]), (6, "blocks:0,1;1,2", [0, 0, 1, 1, 2]), (7, None, None)]
    packed = put(tmp_path / "a.csv", 'candidate_id,relative_overhead,counts_csv\n7,0.25,"1,2,1"\n8,,"1,1,1"\n9,,"1,1"\n')
    rows = {r["candidate_id"]: (r["counts"], r["relative_overhead"]) for r in readers.candidates(spark, packed, 3).collect()}
    assert rows == {"7": ([1, 2, 1], 0.25), "8": ([1, 1, 1], 0.0), "9": (None, None)}
    wide = put(tmp_path / "b.csv", "c0,c1,c2\n1,2,3\n")
    assert readers.candidates(spark, wide, 3).first()["extra_layers"] == 3
    with pytest.raises(ValueError):
        readers.candidates(spark, put(tmp_path / "c.csv", "c0,c1\n1,2\n"), 3)


def test_reports_and_trajectories(spark, tmp_path):
    put(tmp_path / "runs/base/evaluation/report.json", {"resolved_ids": ["t1"], "error_ids": ["t2", "t1"]})
    rows = R.bucket_rows(readers.evaluation_reports(spark, str(tmp_path / "runs/*/evaluation/*.json")), ["condition"])
    assert sorted(map(tuple, rows.collect())) == [("base", "t1", "error"), ("base", "t1", "resolved"), ("base", "t2", "error")]
    put(tmp_path / "tr/t1.traj.json", {"info": {"exit_status": "ok", "submission": "d", "model_stats": {"api_calls": 3, "instance_cost": 0.5}}})
    put(tmp_path / "tr/t2.traj.json", {})
    got = {r["instance_id"]: (r["exit_status"], r["steps"], r["instance_cost"], r["submission_empty"]) for r in R.trajectory_totals(readers.trajectories(spark, str(tmp_path / "tr")), keys=("instance_id",)).collect()}
    assert got == {"t1": ("ok", 3, 0.5, False), "t2": ("", 0, 0.0, True)}


def test_score_tables(spark, tmp_path):
    rows = readers.score_map(spark, put(tmp_path / "s.json", {"(0,1)": {"score": 1}, "layers:0": 2.5}))
    assert {r["raw_key"] for r in rows.collect()} == {"(0,1)", "layers:0"}
    twice = readers.score_map(spark, put(tmp_path / "d.json", '{"0,3": 1, "x": 5, "(0,3)": 2, "x": 6}'))
    assert [(r["raw_key"], r["p"]) for r in twice.orderBy("seq").select("raw_key", F.to_json("payload").alias("p")).collect()] == [("0,3", "1"), ("x", "6"), ("(0,3)", "2")]
    kept, _ = A.score_table(twice, 4)
    assert [(r["layer_key"], r["score"]) for r in kept.collect()] == [([0, 1, 2, 0, 1, 2, 3], 2.0)]
    lines = tmp_path / "many"
    put(lines / "1.jsonl", "".join(json.dumps({"0,2": k}) + "\n" for k in range(50)))
    assert A.score_table(readers.score_map(spark, str(lines), docs=False), 4)[0].first()["score"] == 49.0
    assert readers.score_map(spark, put(tmp_path / "bad.json", "[1]")).count() == 0
    spark.createDataFrame([("0,1", "1")], "raw_key string, payload string").write.parquet(str(tmp_path / "noseq"))
    with pytest.raises(ValueError, match="seq"):
        readers.score_rows(spark, str(tmp_path / "noseq"))


def test_upsert_versions(spark, tmp_path):
    path = str(tmp_path / "preds")
    make = lambda rows: spark.createDataFrame(rows, "instance_id string, model_patch string, seq int")
    assert writers.read_current(spark, path) is None
    writers.upsert(make([("a", "1", 1), ("b", "1", 1)]), path, ["instance_id"])
    out = writers.upsert(make([("a", "2", 2), ("b", "0", 0), ("c", "1", 1)]), path, ["instance_id"])
    assert {r["instance_id"]: r["model_patch"] for r in out.collect()} == {"a": "2", "b": "1", "c": "1"}
    assert writers.read_current(spark, path).count() == 3


def test_replayed_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "res")
    rows = spark.createDataFrame([([0], 1.0, 1)], "layer_key array<int>, score double, seq int")
    for batch in (0, 0, 1):
        writers.append_results(rows.withColumn("seq", F.lit(batch)), path, batch)
    assert spark.read.parquet(path).count() == 2
    assert writers.latest_results(spark, path, ["layer_key"], ["seq"]).first()["seq"] == 1


def test_config_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "layers:0,1"), (0, "0,0")], "rank int, config_line string")
    writers.write_config(rows, str(tmp_path / "cfg"), str(tmp_path / "man"), {"top_k_requested": 2})
    text = "".join(p.read_text() for p in sorted((tmp_path / "cfg").glob("part-*")))
    assert text.splitlines()[2:] == ["0,0", "layers:0,1"] and text.startswith("#")
    assert [r["rank"] for r in spark.read.json(str(tmp_path / "man")).orderBy("rank").collect()] == [0, 1]


# --- streams ---------------------------------------------------------------

@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(k % 4, f"w{k % 3}", float(k), f"2024-01-0{1 + k % 3} 00:0{k % 6}:00", k) for k in range(60)]
    df = spark.createDataFrame(rows, "cfg int, worker string, score double, ts string, seq int").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):
        df.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in"), str(tmp_path)


def test_ingest_equals_batch(spark, folder):
    df, path, base = folder
    stream = T.file_stream(spark, path, "*.parquet", 1)
    T.ingest(stream, f"{base}/t", f"{base}/c").awaitTermination()
    T.ingest(T.file_stream(spark, path, "*.parquet", 1), f"{base}/t", f"{base}/c").awaitTermination()
    assert spark.read.parquet(f"{base}/t").count() == 60
    got = {r["cfg"]: r["seq"] for r in writers.latest_results(spark, f"{base}/t", ["cfg"], ["seq"]).collect()}
    assert got == {0: 56, 1: 57, 2: 58, 3: 59}


def test_progress_equals_batch(spark, folder):
    df, path, base = folder
    agg = T.progress(T.file_stream(spark, path, "*.parquet", 1), "ts", "worker", "5 minutes", "10 days")
    T.changes(agg, f"{base}/p", f"{base}/pc").awaitTermination()
    got = sorted(map(tuple, T.current(spark, f"{base}/p", ["window_start", "worker"]).collect()))
    want = sorted(map(tuple, df.groupBy(F.window("ts", "5 minutes").start.alias("w"), "worker").count().collect()))
    assert got == want


def test_duplicate_records_count_once(spark, tmp_path):
    rows = spark.createDataFrame([("c", "t1", True, 3), ("c", "t1", True, 3), ("c", "t2", False, 4)], "condition string, task_id string, success boolean, steps int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    agg = T.run_summary(T.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1), "ts", ["condition", "task_id"])
    T.changes(agg, str(tmp_path / "s"), str(tmp_path / "sc")).awaitTermination()
    r = T.current(spark, str(tmp_path / "s"), ["condition"]).first()
    assert (r["tasks"], r["successes"], r["steps"]) == (2, 1, 7)


def test_state_shrinks_behind_the_watermark(spark, tmp_path):
    """Ten files, each an hour after the last: windows that can no longer change leave the state and are not written again."""
    for hour in range(10):
        rows = [(f"w{k % 3}", k, f"2024-01-01 {hour:02d}:{k % 60:02d}:00") for k in range(60)]
        frame = spark.createDataFrame(rows, "worker string, k int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    agg = T.progress(T.file_stream(spark, str(tmp_path / "in"), "*.parquet", 1), "ts", "worker", "10 minutes", "30 minutes")
    query = T.changes(agg, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(held) == 10 and max(held[2:]) <= 2 * 18 + 3 * 3 and sum(p["stateOperators"][0]["numRowsRemoved"] for p in query.recentProgress) > 80
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == written.select("window_start", "worker").distinct().count() == 180
    assert T.current(spark, str(tmp_path / "out"), ["window_start", "worker"]).agg(F.sum("completed")).first()[0] == 600

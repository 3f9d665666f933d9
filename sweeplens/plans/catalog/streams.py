"""Streaming runs over the base tables, and document round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens import schemas
from sweeplens.functions import layers as L
from sweeplens.operators import analysis as A
from sweeplens.operators import candidates as K
from sweeplens.operators import runs as R
from sweeplens.operators import scoring as S
from sweeplens.plans import fixtures as fx
from sweeplens.plans.catalog import analysis as CA
from sweeplens.plans.catalog import runs as CR
from sweeplens.plans.catalog import scoring as CS
from sweeplens.plans.catalog import surrogate as CU
from sweeplens.session import scratch_path
from sweeplens.sources import readers, writers
from sweeplens.streaming import results as T

N = fx.N_LAYERS


def _r(*names):
    return [F.round(n, 9).alias(n) for n in names]


def _run(spark, start, stream):
    """Drain the available files and return the written table's path."""
    table = scratch_path(spark, "stream")
    start(stream, table, f"{table}-checkpoint").awaitTermination()
    return table


def _events(spark, d):
    rows = T.file_stream(spark, d, "events.parquet")
    return rows.withColumn("k", F.expr("cast(get_json_object(props,'$.k') as int)"))


def stream_results(spark, d):
    """Latest value per (user, type), ingested batch by batch."""
    table = _run(spark, T.ingest, _events(spark, d).select("user_id", "event_type", "value", "ts", "event_id"))
    out = writers.latest_results(spark, table, ["user_id", "event_type"], ["ts", "event_id"])
    return out.select("user_id", "event_type", "event_id", *_r("value"))


def stream_progress(spark, d):
    table = _run(spark, T.changes, T.progress(_events(spark, d), "ts", "event_type", "1 hour"))
    return T.current(spark, table, ["window_start", "event_type"]).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "completed")


def stream_run_summary(spark, d):
    records = _events(spark, d).select(
        "ts", F.col("event_type").alias("condition"), F.expr("user_id || '_' || k").alias("task_id"),
        F.expr("k < 40").alias("success"), F.col("k").alias("steps"))
    table = _run(spark, T.changes, T.run_summary(records, "ts", ["condition", "task_id"], "60 days"))
    return T.current(spark, table, ["condition"])


def stream_scores(spark, d):
    """Responses scored as a stream, then averaged per configuration."""
    lines = T.file_stream(spark, d, "lineitem.parquet", partitions=spark.sparkContext.defaultParallelism)
    responses = spark.sql(fx.MATH_RESPONSES_BODY.replace("from lineitem", "from {lines}"), lines=lines)
    table = _run(spark, T.ingest, T.scored_math(responses).drop("raw_output", "extracted"))
    out = S.config_scores(spark.read.parquet(table), ["cfg_id"])
    return out.select("cfg_id", *_r("score"), "responses", "valid_final_answer_count")


def stream_emotions(spark, d):
    """Emotion responses scored as a stream, then averaged per configuration."""
    lines = T.file_stream(spark, d, "lineitem.parquet", partitions=spark.sparkContext.defaultParallelism)
    responses = spark.sql(fx.EQ_RESPONSES_BODY.replace("from lineitem", "from {lines}"), lines=lines).withColumn(
        "reference", F.array("ref1", "ref2", "ref3", "ref4"))
    table = _run(spark, T.ingest, T.scored_emotions(responses).select("cfg_id", "score"))
    out = spark.read.parquet(table).groupBy("cfg_id").agg(F.avg("score").alias("score"), F.count("*").alias("responses"))
    return out.select("cfg_id", *_r("score"), "responses")


def queue_progress(spark, d):
    ev = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = T.queue_status(ev, ev.filter("value > 20"), "user_id", "event_type", "ts")
    return out.select("event_type", "completed", "elapsed", "remaining", *_r("rate"), "eta")


# --- document round trips --------------------------------------------------

def _docs(df, spark, label):
    """Write one JSON document per line and return the path."""
    path = scratch_path(spark, label)
    df.write.text(path)
    return path


def jsonl_records(spark, d):
    """Run records appended as JSON lines twice, read back."""
    path = scratch_path(spark, "records") + ".jsonl"
    records = CR._records(spark, d).drop("evaluation_status", "submission_empty", "instance_cost", "exit_status")
    writers.append_jsonl(records.filter("success"), path)
    writers.append_jsonl(records.filter("not success"), path)
    return R.summarize(readers.run_records(spark, path)).select("condition", "tasks", "successes", *_r("avg_steps", "avg_overhead_fraction"))


def wrapped_records(spark, d):
    """``{"runs": [...]}`` documents of at most fifty records."""
    row = F.struct(F.expr("'t' || event_id").alias("task_id"), F.col("event_type").alias("condition"), (F.col("k") < 40).alias("success"),
                   F.col("k").alias("steps"), F.lit(0).alias("execution_errors"), F.col("value").alias("runtime_seconds"))
    docs = fx.ev(spark, d).groupBy(F.floor(F.col("event_id") / 50)).agg(F.to_json(F.struct(F.collect_list(row).alias("runs"))).alias("value"))
    out = readers.run_records(spark, _docs(docs.select("value"), spark, "runs"), docs=False)
    return R.summarize(out).select("condition", "tasks", "successes", *_r("avg_steps", "avg_extra_layers"))


def source_rejects(spark, d):
    """Records without a task and conditions without a name, with their reasons."""
    records = fx.table(spark, d, "customer").selectExpr("""'{"condition":"c' || (c_custkey % 3) || '"' ||
      case when c_custkey % 4 > 0 then ',"task_id":"t' || c_custkey || '"' else '' end || '}' as value""")
    named = fx.table(spark, d, "supplier").selectExpr("""'[{"name":"a"},{"extra_layers":' || (s_suppkey % 5) || '}]' as value""")
    out = readers.run_record_rejects(spark, _docs(records, spark, "records"), docs=False).unionByName(
        readers.condition_rejects(spark, _docs(named, spark, "named"), docs=False))
    return out.groupBy("record", "reason").agg(F.count("*").alias("n"))


def probe_sets(spark, d):
    """Question documents of at most fifty parts, half with references on the other field."""
    ref = F.struct((F.col("p_size") % 11).cast("double").alias("emotion1_score"), F.lit(3.0).alias("emotion2_score"), F.lit(4.0).alias("emotion4_score"))
    even = F.col("p_partkey") % 2 == 0
    row = F.struct(F.concat(F.lit("p"), F.col("p_partkey")).alias("key"), F.struct(
        F.concat(F.lit("Feel "), F.col("p_name")).alias("prompt"), F.when(even, ref).alias("reference_answer"),
        F.when(~even, ref).alias("reference_answer_fullscale")).alias("value"))
    docs = fx.table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 50)).agg(
        F.to_json(F.map_from_entries(F.collect_list(row))).alias("value"))
    out = readers.probe_set(spark, _docs(docs.select("value"), spark, "probe"), docs=False)
    return out.select("qid", "prompt", F.array_join(F.transform("reference", lambda x: x.cast("int")), ",").alias("reference"))


def condition_files(spark, d):
    """Condition documents in the three shapes, one per supplier."""
    base = "'\"extra_layers\": ' || (s_suppkey % 9)"
    docs = fx.table(spark, d, "supplier").selectExpr(f"""case s_suppkey % 4
      when 0 then '{{"conditions": [{{"name": "a' || s_suppkey || '", ' || {base} || '}}]}}'
      when 1 then '{{"conditions": {{"b' || s_suppkey || '": {{' || {base} || ', "overhead_fraction": 0.5}}}}}}'
      when 2 then '[{{"name": "c' || s_suppkey || '"}}, {{"name": "d' || s_suppkey || '", ' || {base} || '}}]'
      else '{{"e' || s_suppkey || '": 7}}' end as value""")
    out = readers.conditions(spark, _docs(docs, spark, "conditions"), docs=False)
    return out.select("condition", "extra_layers", "overhead_fraction")


def manifest_files(spark, d):
    row = F.collect_list(F.concat(F.lit("task_"), F.col("c_custkey")))
    docs = fx.table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 40).alias("g")).agg(F.to_json(F.struct(
        F.concat(F.lit("set"), F.floor(F.min("c_custkey") / 40)).alias("dataset_name"), F.lit("test").alias("split"), F.sort_array(row).alias("instance_ids"))).alias("value"))
    return readers.manifest(spark, _docs(docs.select("value"), spark, "manifest"), docs=False)


def example_files(spark, d):
    files = fx.localization(spark, d)
    row = F.struct("file_path", F.col("h").alias("code_snippet"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"))
    docs = files.groupBy("issue_id").agg(F.to_json(F.struct(F.array(F.struct(
        F.col("issue_id").cast("string").alias("issue_id"), F.lit("broken").alias("bug_report"), F.array_sort(F.collect_list(row)).alias("candidate_files"),
        F.min("file_path").alias("ground_truth"))).alias("examples"))).alias("value"))
    out = readers.localization_examples(spark, _docs(docs.select("value"), spark, "examples"), docs=False)
    return out.select("issue_id", "repo", "ground_truth", F.size("candidate_files").alias("files"), F.col("candidate_files")[0]["code_snippet"].alias("first_snippet"))


def score_maps(spark, d):
    """``{key: payload}`` documents of one price group each: spellings of one key, and keys given twice."""
    parts = fx.table(spark, d, "part").selectExpr("p_partkey as k", "cast(p_partkey % 5 as int) as i", "cast(p_size % 7 + 5 as int) as j", "p_retailprice as v")
    spelling = F.expr("case k % 3 when 0 then i || ',' || j when 1 then '(' || i || ',' || j || ')' else '( ' || i || ' , ' || j || ' )' end")
    line = F.concat(F.lit('"'), spelling, F.lit('":{"math_score":'), F.col("v"), F.lit("}"))
    rows = parts.groupBy(F.floor(F.col("k") / 20).alias("g")).agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("lines"))
    docs = rows.orderBy("g").select(F.concat(F.lit("{"), F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit("}")).alias("value"))
    raw = readers.score_map(spark, _docs(docs.coalesce(1), spark, "scores"), docs=False)
    kept, _ = A.score_table(raw, N)
    return kept.select(F.array_join("layer_key", ",").alias("layers"), *_r("score"))


def score_rows(spark, d):
    """A score table with arrival numbers and payload texts, read and reduced to one score for each key."""
    path = scratch_path(spark, "score_rows")
    fx.table(spark, d, "lineitem").selectExpr("(l_partkey % 9) || ',' || (9 + l_suppkey % 9) as raw_key",
        "case when l_linenumber = 7 then 'none' else '{\"score\":' || l_quantity || '}' end as payload",
        "l_orderkey * 8 + l_linenumber as seq").write.parquet(path)
    kept, _ = A.score_table(readers.score_rows(spark, path), N)
    return kept.select(F.array_join("layer_key", ",").alias("layers"), *_r("score"))


def route_files(spark, d):
    """Route documents, every other one under ``routes``."""
    docs = fx.table(spark, d, "supplier").selectExpr("""case s_suppkey % 2 when 0 then '{"routes":' else '' end || '{"r' || s_suppkey || '":{"n":'
      || (s_suppkey % 9) || '}}' || case s_suppkey % 2 when 0 then '}' else '' end as value""")
    out = readers.routes(spark, _docs(docs, spark, "routes"), docs=False)
    return out.select("condition", F.to_json("route").alias("route"))


def candidate_csv(spark, d):
    """Candidates written as CSV with one column per layer and read back."""
    path = scratch_path(spark, "candidates")
    vectors = CU._vectors(spark, d)
    cols = [F.get("counts", F.lit(k)).alias(f"c{k}") for k in range(N)]
    vectors.select("candidate_id", "source", *cols).write.option("header", True).csv(path)
    out = readers.candidates(spark, path, N)
    return out.select(F.col("candidate_id").cast("long").alias("candidate_id"), "extra_layers", *_r("relative_overhead"), "counts_csv")


def config_file(spark, d):
    """Top-k worker lines written with their manifest and read back as configurations."""
    top = K.topk_config(K.distinct_top_k(CU._vectors(spark, d), 60), N)
    base = scratch_path(spark, "config")
    writers.write_config(top, f"{base}/config", f"{base}/manifest", {"top_k_requested": 60})
    out = readers.config_lines(spark, f"{base}/config", N)
    return out.select("source_line", "spec", F.size("layer_key").alias("steps"))


def predictions_upsert(spark, d):
    """Two rounds of predictions merged by instance."""
    path = scratch_path(spark, "predictions")
    runs = fx.runs(spark, d).select(F.col("task_id").alias("instance_id"), F.col("condition").alias("model_name_or_path"),
                                    F.expr("'diff ' || steps").alias("model_patch"), "seq")
    writers.upsert(runs.filter("steps < 60"), path, ["instance_id"])
    return writers.upsert(runs.filter("steps >= 60"), path, ["instance_id"]).select("instance_id", "model_name_or_path", "model_patch", "seq")


def summary_files(spark, d):
    """The run summary written as JSON and CSV; the CSV read back."""
    base = scratch_path(spark, "summary")
    writers.write_summary(R.summarize(CR._records(spark, d)), f"{base}/json", f"{base}/csv")
    out = spark.read.option("header", True).schema(
        "condition string, tasks bigint, successes bigint, " + ", ".join(f"{c} double" for c in writers.SUMMARY_COLUMNS[3:])).csv(f"{base}/csv")
    return out.select("condition", "tasks", "successes", *_r(*writers.SUMMARY_COLUMNS[3:]))


def top_files(spark, d):
    """The balanced top ten written as JSON and CSV; the JSON read back."""
    base = scratch_path(spark, "top")
    writers.write_top(A.top_balanced(CA.balanced(spark, d), 10), f"{base}/json", f"{base}/csv")
    out = spark.read.schema("rank int, relayer string, method string, method_score double, math_delta double").json(f"{base}/json")
    return out.select("rank", "relayer", "method", *_r("method_score", "math_delta"))


def report_files(spark, d):
    """Evaluation reports in one folder per condition, read with the folder as condition."""
    base = scratch_path(spark, "reports")
    runs = fx.runs(spark, d).withColumn("shard", F.floor(F.col("seq") / 50))
    lists = [F.collect_list(F.when(F.col("bucket") == b, F.col("task_id"))).alias(f"{b}_ids") for b in R.BUCKET_PRIORITY]
    reports = runs.groupBy("condition", "shard").agg(*lists).drop("shard")
    reports.withColumn("folder", F.col("condition")).drop("condition").write.partitionBy("folder").json(base)
    out = readers.evaluation_reports(spark, base, condition_depth=2, docs=False).withColumn(
        "condition", F.regexp_replace("condition", "^folder=", ""))
    return R.resolve_status(R.bucket_rows(out, ["condition"]), ["condition", "instance_id"])


def trajectory_files(spark, d):
    """Run documents in folders per event type, read with the file name and totalled."""
    base = scratch_path(spark, "trajectories")
    body = CR.TRAJECTORIES.replace("{", "{{").replace("}", "}}").replace("from ev", "from {ev}").replace("select event_id", "select event_type as kind, event_id")
    spark.sql(body, ev=fx.ev(spark, d)).select("kind", F.col("doc").alias("value")).write.partitionBy("kind").text(base)
    out = R.trajectory_totals(readers.trajectories(spark, f"{base}/*", docs=False), keys=("instance_id",))
    return out.groupBy("exit_status", "submission_empty").agg(F.count("*").alias("n"), F.sum("steps").alias("steps"), F.round(F.sum("instance_cost"), 6).alias("cost"))


QUERIES = {
    f.__name__: f for f in (
        stream_results, stream_progress, stream_run_summary, stream_scores, stream_emotions, queue_progress, jsonl_records,
        wrapped_records, source_rejects, probe_sets, condition_files, manifest_files, example_files, score_maps, score_rows, route_files, candidate_csv,
        config_file, predictions_upsert, summary_files, top_files, report_files, trajectory_files)
}

ORACLES = {
    "stream_results": """select user_id, event_type, arg_max(event_id, (ts, event_id)) as event_id, round(arg_max(value, (ts, event_id)), 9) as value from events group by 1, 2""",
    "stream_progress": """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as completed from events group by 1, 2""",
    "stream_run_summary": f"""with {fx.EV_SQL}, r as (select distinct event_type as condition, user_id || '_' || k as task_id, k from ev)
        select condition, count(*) as tasks, count(*) filter (where k < 40) as successes, cast(sum(k) as bigint) as steps from r group by 1""",
    "stream_scores": f"""with {CS.MATH_SQL} select cfg_id, round(avg(score), 9) as score, count(*) as responses,
        count(*) filter (where valid) as valid_final_answer_count from mscored group by 1""",
    "queue_progress": """with t as (select count(distinct user_id) as total from events),
        p as (select event_type, count(distinct user_id) as completed, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) as el from events where value > 20 group by 1),
        q as (select event_type, completed, cast(el as bigint) as elapsed, total - completed as remaining, completed / el as rate, (total - completed) / (completed / el) as wait_s from p, t)
        select event_type, completed, elapsed, remaining, round(rate, 9) as rate, case when remaining = 0 then 'N/A' when wait_s < 60 then printf('%.0fs', wait_s)
         when wait_s < 3600 then printf('%.1fm', wait_s / 60) else cast(floor(wait_s / 3600) as bigint) || 'h ' || cast(floor((wait_s % 3600) / 60) as bigint) || 'm' end as eta from q""",
    "jsonl_records": f"""with {CR.RECORDS_SQL} select condition, tasks, successes, round(avg_steps, 9) as avg_steps, round(avg_overhead_fraction, 9) as avg_overhead_fraction from summ""",
    "wrapped_records": f"""with {fx.EV_SQL} select event_type as condition, count(*) as tasks, count(*) filter (where k < 40) as successes, round(avg(k), 9) as avg_steps, 0e0 as avg_extra_layers from ev group by 1""",
    "source_rejects": """select '{"condition":"c' || (c_custkey % 3) || '"}' as record, 'no task_id' as reason, count(*) as n from customer where c_custkey % 4 = 0 group by 1
        union all select '{"extra_layers":' || (s_suppkey % 5) || '}', 'no name', count(*) from supplier group by 1""",
    "probe_sets": """select 'p' || p_partkey as qid, 'Feel ' || p_name as prompt, (p_size % 11) || ',3,5,4' as reference from part""",
    "condition_files": """select case s_suppkey % 4 when 0 then 'a' when 1 then 'b' when 2 then 'd' else 'e' end || s_suppkey as condition,
        cast(case when s_suppkey % 4 = 3 then 0 else s_suppkey % 9 end as int) as extra_layers, case when s_suppkey % 4 = 1 then 0.5e0 else 0e0 end as overhead_fraction from supplier
        union all select 'c' || s_suppkey, 0, 0e0 from supplier where s_suppkey % 4 = 2""",
    "manifest_files": """select 'set' || (c_custkey // 40) as dataset_name, 'test' as split, cast(row_number() over (partition by c_custkey // 40 order by 'task_' || c_custkey) - 1 as int) as position,
        'task_' || c_custkey as instance_id from customer""",
    "example_files": f"""with f as ({fx.LOC_BODY}) select cast(issue_id as varchar) as issue_id, '' as repo, min(file_path) as ground_truth, cast(count(*) as int) as files, arg_min(h, file_path) as first_snippet from f group by 1""",
    "score_maps": """with p as (select p_partkey as k, p_partkey // 20 as g, cast(p_partkey % 5 as int) as i, cast(p_size % 7 + 5 as int) as j, p_retailprice as v from part),
        t as (select g, k % 3 as spelling, i, j, min(k) as place, arg_max(v, k) as v from p group by all)
        select array_to_string(list_concat(range(0, j), range(i, 24)), ',') as layers, round(arg_max(v, (g, place)), 9) as score from t group by i, j""",
    "score_rows": """select array_to_string(list_concat(range(0, cast(9 + l_suppkey % 9 as int)), range(cast(l_partkey % 9 as int), 24)), ',') as layers,
        round(arg_max(l_quantity, l_orderkey * 8 + l_linenumber), 9) as score from lineitem where l_linenumber < 7 group by l_partkey % 9, l_suppkey % 9""",
    "route_files": """select 'r' || s_suppkey as condition, '{"n":' || (s_suppkey % 9) || '}' as route from supplier""",
    "stream_emotions": f"""with {CS.EQ_SQL} select cfg_id, round(avg(score), 9) as score, count(*) as responses from escored group by 1""",
    "candidate_csv": f"""with {CU.VECTOR_SQL} select id as candidate_id, cast(len(layer_key) - 24 as int) as extra_layers, round(rel, 9) as relative_overhead, counts_csv from ct""",
    "config_file": f"""with {CU.VECTOR_SQL} select 3 as source_line, 'layers:' || array_to_string(range(0, 24), ',') as spec, 24 as steps
        union all select cast(rank + 3 as int), 'layers:' || array_to_string(list_sort(layer_key), ','), cast(len(layer_key) as int) from top where rank <= 60""",
    "predictions_upsert": f"""with {fx.EV_SQL}, r as ({fx.RUNS_BODY}) select task_id as instance_id, arg_max(condition, seq) as model_name_or_path, 'diff ' || arg_max(steps, seq) as model_patch, max(seq) as seq from r group by 1""",
    "summary_files": CR.ORACLES["run_summary"],
    "top_files": f"""with {CA.BALANCED_SQL} select cast(row_number() over (order by balanced_score desc, eq_delta desc, math_delta desc, layer_key) as int) as rank,
        'layers:' || array_to_string(layer_key, ',') as relayer, 'balanced_z_delta' as method, round(balanced_score, 9) as method_score, round(math_delta, 9) as math_delta from bal order by rank limit 10""",
    "report_files": CR.ORACLES["evaluation_rows"],
    "trajectory_files": f"""with t as ({CR.ORACLES['trajectory_totals']}) select exit_status, submission_empty, count(*) as n, cast(sum(steps) as bigint) as steps, round(sum(instance_cost), 6) as cost from t group by 1, 2""",
}

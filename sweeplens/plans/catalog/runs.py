"""Agent runs: manifests, records, summaries, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.operators import runs as R
from sweeplens.plans import fixtures as fx


def _tasks(spark, d):
    return fx.table(spark, d, "events").select(F.expr("'task_' || user_id").alias("task_id")).distinct()


def _conditions(spark, d):
    names = fx.table(spark, d, "events").select(F.col("event_type").alias("condition")).distinct()
    return names.selectExpr("condition", "length(condition) as extra_layers", "length(condition) / 24e0 as overhead_fraction")


def _records(spark, d):
    runs = fx.runs(spark, d)
    meta = runs.select("condition", "task_id", "seq", "steps", "runtime_seconds", "returncode")
    return R.run_records(_tasks(spark, d), _conditions(spark, d), meta, runs.select("condition", "task_id", "bucket"))


def _r(*names):
    return [F.round(n, 9).alias(n) for n in names]


def manifest_slice(spark, d):
    ids = fx.table(spark, d, "orders").select(F.expr("'task_' || o_orderkey").alias("instance_id"))
    return R.manifest_slice(ids, pattern="task_[1-4]", seed=42, spec="3:-5:2")


def run_records(spark, d):
    return _records(spark, d).select(
        "task_id", "condition", "success", "steps", "execution_errors", *_r("runtime_seconds"), "extra_layers",
        *_r("overhead_fraction"), "evaluation_status", "submission_empty")


def run_summary(spark, d):
    return R.summarize(_records(spark, d)).select(
        "condition", "tasks", "successes",
        *_r("success_rate", *[f"avg_{m}" for m in R.METRICS]))


def baseline_deltas(spark, d):
    out = R.compare_to_baseline(R.summarize(_records(spark, d)), "click")
    return out.select("condition", *_r(*[c for c in out.columns if c != "condition"]))


def route_join(spark, d):
    attrs = _conditions(spark, d).withColumn("model", F.upper("condition"))
    runs = fx.runs(spark, d)
    return R.attach_attributes(runs, attrs).groupBy("condition", "model", "extra_layers").agg(
        F.count("*").alias("runs"), F.sum("steps").alias("steps"))


def json_flatten(spark, d):
    docs = fx.nested(spark, d).withColumn("doc", F.parse_json("doc"))
    return R.flatten_json(docs, ["event_id"]).select("event_id", "path", "value")


def pending_runs(spark, d):
    done = fx.runs(spark, d).filter("steps < 50")
    return R.pending_runs(_tasks(spark, d), _conditions(spark, d), done).select("condition", "task_id")


def alias_names(spark, d):
    names = fx.table(spark, d, "orders").selectExpr(
        "case o_orderkey % 4 when 0 then 'full' when 1 then 'lite' when 2 then 'smith' else 'own/' || (o_custkey % 10) end as name")
    return R.alias_names(names, "name").groupBy("name").agg(F.count("*").alias("n"))


TRAJECTORIES = """
 select event_id as task_id, case when k % 10 = 0 then '{"info":{"exit_status":"lost"}}' when k % 10 = 1 then '{}'
  else '{"info":{"exit_status":"' || event_type || '","submission":"' || case when k % 3 = 0 then '' else 'diff' end || '","model_stats":{"api_calls":' || k || ',"instance_cost":' || (k / 8e0) || '}}}' end as doc from ev
"""


def trajectory_totals(spark, d):
    body = TRAJECTORIES.replace("{", "{{").replace("}", "}}").replace("from ev", "from {ev}")
    docs = spark.sql(body, ev=fx.ev(spark, d)).withColumn("doc", F.try_parse_json("doc"))
    return R.trajectory_totals(docs)


def evaluation_rows(spark, d):
    """Reports with five id lists per condition and shard, exploded to bucket rows."""
    runs = fx.runs(spark, d).withColumn("shard", F.floor(F.col("seq") / 50))
    lists = [F.collect_list(F.when(F.col("bucket") == b, F.col("task_id"))).alias(f"{b}_ids") for b in R.BUCKET_PRIORITY]
    reports = runs.groupBy("condition", "shard").agg(*lists)  # at most 50 rows per report
    return R.resolve_status(R.bucket_rows(reports, ["condition"]), ["condition", "instance_id"])


QUERIES = {
    f.__name__: f for f in (
        manifest_slice, run_records, run_summary, baseline_deltas, route_join, json_flatten, pending_runs, alias_names,
        trajectory_totals, evaluation_rows)
}

RECORDS_SQL = f"""
 {fx.EV_SQL}, r as ({fx.RUNS_BODY}),
 tasks as (select distinct task_id from r),
 conds as (select distinct condition, cast(length(condition) as int) as extra_layers, length(condition) / 24e0 as overhead_fraction from r),
 meta as (select * from (select *, row_number() over (partition by condition, task_id order by seq desc) as rn from r) where rn = 1),
 bk as (select condition, task_id, bool_or(bucket = 'resolved') as res, bool_or(bucket = 'unresolved') as unr, bool_or(bucket = 'empty_patch') as emp,
   bool_or(bucket = 'incomplete') as inc, bool_or(bucket = 'error') as err from r where bucket is not null group by 1, 2),
 rec as (select t.task_id, c.condition, coalesce(res, false) as success, coalesce(m.steps, 0) as steps,
   case when coalesce(err, false) or coalesce(inc, false) or coalesce(m.returncode, '0') <> '0' then 1 else 0 end as execution_errors,
   coalesce(m.runtime_seconds, 0e0) as runtime_seconds, c.extra_layers, c.overhead_fraction,
   case when res then 'resolved' when unr then 'unresolved' when emp then 'empty_patch' when inc then 'incomplete' when err then 'error' else 'not_evaluated' end as evaluation_status
  from tasks t cross join conds c left join meta m on m.condition = c.condition and m.task_id = t.task_id
   left join bk b on b.condition = c.condition and b.task_id = t.task_id),
 summ as (select condition, count(*) as tasks, count(*) filter (where success) as successes, avg(cast(success as int)) as success_rate,
   avg(steps) as avg_steps, avg(execution_errors) as avg_execution_errors, avg(runtime_seconds) as avg_runtime_seconds,
   avg(extra_layers) as avg_extra_layers, avg(overhead_fraction) as avg_overhead_fraction from rec group by 1)
"""

_ALIAS_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in R.DATASET_ALIASES.items())

ORACLES = {
    "manifest_slice": """with ids as (select 'task_' || o_orderkey as instance_id from orders),
        f as (select instance_id, row_number() over (order by md5('42:' || instance_id), instance_id) - 1 as p, count(*) over () as n
         from ids where regexp_matches(instance_id, '^task_[1-4]'))
        select instance_id, (p - 3) // 2 as position from f where p >= 3 and p < n - 5 and (p - 3) % 2 = 0""",
    "run_records": f"""with {RECORDS_SQL} select task_id, condition, success, steps, execution_errors, round(runtime_seconds, 9) as runtime_seconds,
        extra_layers, round(overhead_fraction, 9) as overhead_fraction, evaluation_status, true as submission_empty from rec""",
    "run_summary": f"""with {RECORDS_SQL} select condition, tasks, successes, round(success_rate, 9) as success_rate, round(avg_steps, 9) as avg_steps,
        round(avg_execution_errors, 9) as avg_execution_errors, round(avg_runtime_seconds, 9) as avg_runtime_seconds,
        round(avg_extra_layers, 9) as avg_extra_layers, round(avg_overhead_fraction, 9) as avg_overhead_fraction from summ""",
    "baseline_deltas": f"""with {RECORDS_SQL}, b as (select * from summ where condition = 'click')
        select s.condition, round(s.success_rate - b.success_rate, 9) as delta_success_rate, round(s.avg_steps - b.avg_steps, 9) as delta_avg_steps,
         round(s.avg_execution_errors - b.avg_execution_errors, 9) as delta_avg_execution_errors,
         round(s.avg_runtime_seconds - b.avg_runtime_seconds, 9) as delta_avg_runtime_seconds from summ s, b""",
    "route_join": f"""with {fx.EV_SQL} select event_type as condition, upper(event_type) as model, cast(length(event_type) as int) as extra_layers,
        count(*) as runs, cast(sum(k) as bigint) as steps from ev group by 1, 2, 3""",
    "json_flatten": f"""with {fx.EV_SQL} select event_id, 'model.name' as path, '"' || event_type || '"' as value from ev
        union all select event_id, 'model.args.k', cast(k as varchar) from ev
        union all select event_id, 'limit', cast(user_id as varchar) from ev
        union all select event_id, 'list', '[{{"a":1}},2]' from ev union all select event_id, 'null', 'null' from ev
        union all select event_id, 'deep' || repeat('.d', 14), cast(k as varchar) from ev""",
    "pending_runs": f"""with {fx.EV_SQL}, r as ({fx.RUNS_BODY}), t as (select distinct task_id from r), c as (select distinct condition from r)
        select condition, task_id from t cross join c where not exists (select 1 from r where r.condition = c.condition and r.task_id = t.task_id and steps < 50)""",
    "alias_names": f"""with n as (select case o_orderkey % 4 when 0 then 'full' when 1 then 'lite' when 2 then 'smith' else 'own/' || (o_custkey % 10) end as name from orders)
        select case name {_ALIAS_SQL} else name end as name, count(*) as n from n group by 1""",
    "trajectory_totals": f"""with {fx.EV_SQL} select event_id as task_id,
        case when k % 10 = 0 then 'lost' when k % 10 = 1 then '' else event_type end as exit_status,
        case when k % 10 in (0, 1) or k % 3 = 0 then '' else 'diff' end as submission,
        case when k % 10 in (0, 1) then 0 else k end as steps, case when k % 10 in (0, 1) then 0e0 else k / 8e0 end as instance_cost,
        k % 10 in (0, 1) or k % 3 = 0 as submission_empty from ev""",
    "evaluation_rows": f"""with {RECORDS_SQL} select condition, task_id as instance_id, case when res then 'resolved' when unr then 'unresolved'
         when emp then 'empty_patch' when inc then 'incomplete' else 'error' end as evaluation_status, coalesce(res, false) as success,
         coalesce(inc, false) or coalesce(err, false) as failed from bk""",
}

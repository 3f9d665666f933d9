"""Deterministic inputs derived from the base tables, as Spark frames and as SQL.

Every derived table scans its whole base table.  The SQL twins are common table
expressions for the oracle engine, written against the same base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplens.session import spread, tasks_for

N_LAYERS = 24
N_CONFIGS = 301  # N_LAYERS * (N_LAYERS + 1) / 2 + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- models and configurations --------------------------------------------

MODELS_SQL = "models as (select s_suppkey as model_id, cast(8 + s_suppkey % 25 as int) as num_layers from supplier)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as model_id", "cast(8 + s_suppkey % 25 as int) as num_layers")


SPACE_SQL = """
 space as (
  select model_id, num_layers, 0 as idx, 0 as i, 0 as j from models
  union all
  select model_id, num_layers, cast(b.j*(b.j-1)//2 + a.i + 1 as int), cast(a.i as int), cast(b.j as int)
  from models, lateral (select unnest(range(1, num_layers+1)) as j) b, lateral (select unnest(range(0, b.j)) as i) a)
"""

CONFIGS_SQL = """
 ids as (select cast(range as int) as id from range(25)),
 configs as (
  select 0 as cfg_id, 0 as i, 0 as j, range(0, 24) as layer_key
  union all
  select cast(1 + b.id*(b.id-1)//2 + a.id as int), a.id, b.id, list_concat(range(0, b.id), range(a.id, 24))
  from ids a join ids b on a.id < b.id where b.id <= 24)
"""


def configs(spark: SparkSession) -> DataFrame:
    """The pair space at 24 layers: exactly 301 rows whatever the data size."""
    from sweeplens.operators import config_space as C

    one = spark.range(1).select(F.lit(N_LAYERS).alias("num_layers"))
    return C.with_layers(C.config_space(one)).selectExpr("idx as cfg_id", "i", "j", "layer_key")


BLOCKS_SQL = """
 blocks as (
  select o_orderkey as id, i1, i1 + 1 + cast(o_custkey % (24 - i1) as int) as j1,
   case when o_orderkey % 7 = 0 then 0 else i2 end as i2,
   case when o_orderkey % 7 = 0 then 0 else i2 + 1 + cast((o_custkey + o_orderkey) % (24 - i2) as int) end as j2
  from (select o_orderkey, o_custkey, cast(o_orderkey % 24 as int) as i1, cast(o_custkey % 23 as int) as i2 from orders)),
 first_block as (select *, list_concat(range(0, j1), range(i1, 24)) as once from blocks),
 layered as (
  select id, i1, j1, i2, j2,
   case when i2 = 0 and j2 = 0 then once
    else list_concat(
     once[1 : len(once) - list_position(list_reverse(once), j2 - 1) + 1],
     range(i2, j2),
     once[len(once) - list_position(list_reverse(once), j2 - 1) + 2 :]) end as layer_key
  from first_block)
"""


def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks per order at 24 layers; every seventh second block is empty."""
    base = spread(table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "o_custkey", "cast(o_orderkey % 24 as int) as i1", "cast(o_custkey % 23 as int) as i2"))
    return base.selectExpr(
        "id", "i1", "i1 + 1 + cast(o_custkey % (24 - i1) as int) as j1",
        "case when id % 7 = 0 then 0 else i2 end as i2",
        "case when id % 7 = 0 then 0 else i2 + 1 + cast((o_custkey + id) % (24 - i2) as int) end as j2",
    ).withColumn("blocks", F.expr("array(named_struct('i', i1, 'j', j1), named_struct('i', i2, 'j', j2))"))


# --- scores ----------------------------------------------------------------

SCORES_SQL = """
 scores as (
  select cast(l_orderkey % 301 as int) as cfg_id,
   sum(cast(l_quantity as bigint)) / (50e0*count(*)) as math_score,
   100e0 * sum(cast(round(l_discount*100) as bigint)) / (10e0*count(*)) as eq_score_pct
  from lineitem group by 1)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics per configuration with its layer key; the second in percent."""
    agg = table(spark, sf_dir, "lineitem").groupBy(F.expr("cast(l_orderkey % 301 as int)").alias("cfg_id")).agg(
        F.expr("sum(cast(l_quantity as bigint)) / (50e0*count(*))").alias("math_score"),
        F.expr("100e0 * sum(cast(round(l_discount*100) as bigint)) / (10e0*count(*))").alias("eq_score_pct"),
    )
    return agg.join(F.broadcast(configs(spark)), "cfg_id")  # 301 rows


def metric(scored: DataFrame, column: str) -> DataFrame:
    return scored.select("layer_key", F.col(column).alias("score"))


# --- responses -------------------------------------------------------------

MATH_RESPONSES_BODY = """
 select cast(l_orderkey % 301 as int) as cfg_id, l_orderkey*10 + l_linenumber as qid,
  case l_partkey % 4
   when 0 then '<think>' || l_suppkey || '</think> The answer is ' || cast(floor(l_extendedprice) as bigint)
   when 1 then 'about ' || cast(floor(l_extendedprice*1.1e0) as bigint) || ' or 007'
   when 2 then '<think>' || l_partkey
   else 'no idea' end as raw_output,
  cast(floor(l_extendedprice*(1e0-l_discount)) as bigint) as answer from lineitem
"""

EQ_RESPONSES_BODY = """
 select cast(l_orderkey % 301 as int) as cfg_id, l_orderkey*10 + l_linenumber as qid,
  case l_suppkey % 4
   when 0 then 'First pass scores:' || chr(10) || 'Joy: ' || cast(floor(l_quantity/5e0) as int) || chr(10) || 'Fear: ' || cast(round(l_tax*100) as int) || chr(10) || 'Hope: ' || cast(round(l_discount*100) as int) || chr(10) || '4. Calm: ' || l_linenumber || chr(10) || 'Critique: fine' || chr(10) || 'Revised scores:' || chr(10) || 'Joy: ' || l_linenumber || chr(10) || 'Fear: 2' || chr(10) || 'Hope: 3' || chr(10) || 'Calm: 11' || chr(10) || '[End of answer]'
   when 1 then 'First pass scores:' || chr(10) || 'Joy: 4' || chr(10) || 'Fear: ' || cast(round(l_tax*100) as int) || chr(10) || 'Hope: 2.5'
   when 2 then 'maybe ' || l_linenumber || ' and ' || cast(round(l_tax*100) as int)
   else 'none' end as raw_output,
  cast(l_linenumber as double) as ref1, 5e0 as ref2, cast(floor(l_quantity/5e0) as double) as ref3,
  cast(l_suppkey % 11 as double) as ref4 from lineitem
"""


def from_body(spark: SparkSession, sf_dir: str, body: str, *names: str) -> DataFrame:
    """Run a shared SELECT body on Spark with the base tables bound as arguments."""
    for name in names:
        body = body.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name} ", f"join {{{name}}} ")
    return spark.sql(body, **{n: table(spark, sf_dir, n) for n in names})


def math_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(from_body(spark, sf_dir, MATH_RESPONSES_BODY, "lineitem"))


def eq_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(from_body(spark, sf_dir, EQ_RESPONSES_BODY, "lineitem")).withColumn(
        "reference", F.array("ref1", "ref2", "ref3", "ref4"))


# --- agent runs ------------------------------------------------------------

EV_SQL = "ev as (select *, cast(props->>'k' as int) as k from events)"

RUNS_BODY = """
 select event_id as seq, event_type as condition, 'task_' || user_id as task_id, k as steps, value as runtime_seconds,
  case when k % 17 = 0 then '1' else '0' end as returncode,
  case when k < 40 then 'resolved' when k < 60 then 'unresolved' when k < 75 then 'empty_patch'
   when k < 85 then 'incomplete' when k < 92 then 'error' end as bucket
 from ev
"""


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.expr("cast(get_json_object(props,'$.k') as int)"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS_BODY.replace("from ev", "from {ev}"), ev=ev(spark, sf_dir))


# --- localisation ----------------------------------------------------------

LOC_BODY = """
 select l_orderkey as issue_id, o_orderpriority as condition,
  'src/b' || (l_partkey % 25) || '/part' || l_partkey || '.py' as file_path,
  max(l_extendedprice) as price, md5('42:' || l_orderkey || ':' || l_partkey) as h
 from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_orderpriority, l_partkey
"""

PATCHES_BODY = """
 select o_orderkey as issue_id, 'repo' || (doc % 4) as repo,
  'diff --git a/src/m' || (doc % 7) || '/f' || doc || '.py b/src/m' || (doc % 7) || '/f' || doc || '.py' || chr(10) || '@@ -' || (1 + o_custkey % 40) || ',3 +' || (1 + o_custkey % 40) || ',4 @@' || chr(10) || '+x' ||
  case when o_orderkey % 3 = 0 then chr(10) || 'diff --git a/tests/test_a.py b/tests/test_a.py' || chr(10) || '@@ -5 +5 @@' || chr(10) || '-y'
       when o_orderkey % 5 = 0 then chr(10) || 'diff --git a/src/z.js b/src/z.js' || chr(10) || '@@ -9,2 +9,2 @@' || chr(10) || '-z' else '' end as patch
 from (select *, o_orderkey % (select count(*) from documents) as doc from orders)
"""

FILES_KEYS_BODY = """
 select 'repo' || (doc_id % 4) as repo,
  case when doc_id % 9 = 0 then 'tests/test_d' else 'src/m' || (doc_id % 7) || '/f' end || doc_id || case when doc_id % 11 = 0 then '.js' else '.py' end as path,
  doc_id from documents
"""


def localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate files of all issues; both tables are dealt by issue, a bounded number of rows to a task."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    tasks = tasks_for(lines)
    body = LOC_BODY.replace("from lineitem", "from {lineitem}").replace("join orders ", "join {orders} ")
    return spark.sql(body, lineitem=lines.repartition(tasks, "l_orderkey"), orders=orders.repartition(tasks, "o_orderkey"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One patch per order; the two numbers it is made of are dealt over the cores, not its text."""
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    body = PATCHES_BODY.replace("from orders", "from {orders}").replace("from documents", "from {documents}")
    return spark.sql(body, orders=orders, documents=table(spark, sf_dir, "documents"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one file; patches name the files of all documents in turn."""
    return from_body(spark, sf_dir, FILES_KEYS_BODY.replace("doc_id from documents", "doc_id, text from documents"), "documents")


# --- agent steps, intervals, nested documents ------------------------------

STEPS_BODY = """
 select case when conv_id % 2 = 0 then 'baseline' else 'variant' end as condition, conv_id as task_id, turn as step,
  case (conv_id + turn) % 8
   when 0 then 'ok {"action":"run_tests","thought":"' || turn || '"} end'
   when 1 then '{"action":"search"}'
   when 2 then '{"action":"fly","query":"x"}'
   when 3 then 'no json here'
   when 4 then '{"action":"fly","action":" search ","query":"q"}'
   when 5 then '{"action":"read_file","path":NaN}'
   when 6 then '{"action":"read_file","path":"a{"'
   else 'x {"action":"finish","summary":"a}b"} y' end as raw_output
 from conversations
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_body(spark, sf_dir, STEPS_BODY.replace('{', '{{').replace('}', '}}'), "conversations")


INTERVALS_BODY = "select user_id, k*10 as start_min, k*10 + cast(floor(value) as int) % 25 as end_min, event_id from ev"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INTERVALS_BODY.replace("from ev", "from {ev}"), ev=ev(spark, sf_dir))


NESTED_BODY = """
 select event_id, '{"model":{"name":"' || event_type || '","args":{"k":' || k || '},"none":{}},"limit":' || user_id || ',"list":[{"a":1},2],"null":null,"deep":'
  || repeat('{"d":', 14) || k || repeat('}', 14) || '}' as doc from ev
"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = NESTED_BODY.replace("{", "{{").replace("}", "}}").replace("from ev", "from {ev}")
    return spark.sql(body, ev=ev(spark, sf_dir))

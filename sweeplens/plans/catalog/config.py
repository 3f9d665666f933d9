"""Configuration space, expansion, parsing and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators import config_space as C
from sweeplens.plans import fixtures as fx
from sweeplens.session import spread

N = fx.N_LAYERS


def _space(spark, d):
    return C.config_space(fx.models(spark, d))


def sweep_space(spark, d):
    return _space(spark, d).select("model_id", "idx", "i", "j", F.lit(0).alias("x")).drop("x")


def sweep_strategic(spark, d):
    return C.strategic_space(fx.models(spark, d)).select("model_id", "idx", "family", "i", "j")


def span_filter(spark, d):
    return C.filter_span(_space(spark, d), 3, 6, exclude_baseline=True).select("model_id", "i", "j")


def index_slice(spark, d):
    return C.slice_index(_space(spark, d), 100, 140).select("model_id", "idx", "i", "j")


def expand_single(spark, d):
    cfg = C.with_layers(_space(spark, d))
    return cfg.select(
        "model_id", "i", "j", "spec", F.size("layer_key").alias("steps"),
        L.is_baseline(F.col("layer_key"), F.col("num_layers")).alias("is_baseline"),
        L.block_label(F.col("i"), F.col("j"), F.col("num_layers")).alias("label"))


def _layered(spark, d):
    return fx.block_pairs(spark, d).withColumn("layer_key", L.expand_blocks(N, F.col("blocks")))


def expand_multi(spark, d):
    return _layered(spark, d).select(
        "id", L.block_spec(F.col("blocks")).alias("block_spec"), L.layer_spec(F.col("layer_key")).alias("spec"))


def validate_configs(spark, d):
    rows = fx.table(spark, d, "lineitem").selectExpr(
        "l_linenumber", "array(cast(l_partkey % 26 as int), cast(l_suppkey % 25 as int), l_linenumber) as layer_key")
    return C.validate(rows, N).groupBy("l_linenumber").agg(
        F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("rejected"))


SPEC_TEXTS = """
 select o_orderkey as id, i, j, case o_orderkey % 9
  when 0 then 'layers:' || i || ',' || (i + 1) || ',3'
  when 1 then 'blocks:' || i || ',' || j || ';0,2'
  when 2 then '(' || i || ', ' || j || ')'
  when 3 then i || ',' || j
  when 4 then ' Layers: 1 , ' || i || ' '
  when 5 then '(' || i || ',' || j || ') ; (0,2)'
  when 6 then 'layers:'
  when 7 then i || ',' || j || ',1'
  else j || ',' || i end as raw
 from (select o_orderkey, cast(o_orderkey % 22 as int) as i, cast(o_orderkey % 22 + 1 + o_custkey % 2 as int) as j from orders)
"""


def spec_parse(spark, d):
    raw = spread(fx.from_body(spark, d, SPEC_TEXTS, "orders"))
    parsed = raw.withColumn("layer_key", L.parse_spec(N, F.col("raw")))
    return parsed.select("id", L.spec_kind(F.col("raw")).alias("kind"), F.array_join("layer_key", ",").alias("layers"))


def queue_parse(spark, d):
    raw = fx.from_body(spark, d, SPEC_TEXTS, "orders").selectExpr(
        "id", "case when id % 4 = 0 then array(i, j, 5) end as layers",
        "case when id % 4 in (0, 1) then array(i, 7, j, 30) end as layer_indices",
        "case when id % 4 in (1, 2) then array(i, j) end as key", "raw as spec")
    return C.parse_queue(raw, N).select("id", "source", F.array_join("layer_key", ",").alias("layers"))


def pending_configs(spark, d):
    cfg = C.with_layers(_space(spark, d))
    done = fx.table(spark, d, "lineitem").selectExpr(
        "l_suppkey as model_id", "'(' || (l_linenumber % 8) || ',' || (l_linenumber % 8 + 1 + cast(l_quantity as int) % 8) || ')' as raw_key"
    ).dropDuplicates().join(fx.models(spark, d), "model_id")
    done = done.withColumn("layer_key", L.parse_spec(F.col("num_layers"), F.col("raw_key")))
    return C.pending(cfg, done, keys=("model_id", "layer_key")).select("model_id", "idx", "i", "j")


def repeat_sweep(spark, d):
    return C.repeat_sweep(fx.models(spark, d), 3).select(
        "model_id", "idx", "name", "layer", "extra_repeats", "total_occurrences", "layer_indices_key")


def count_encode(spark, d):
    return _layered(spark, d).select(
        "id", L.counts_to_csv(L.encode_counts(F.col("layer_key"), N)).alias("counts_csv"))


def count_decode(spark, d):
    counts = L.encode_counts(F.col("layer_key"), N)
    return _layered(spark, d).select("id", F.array_join(L.decode_counts(counts, N), ",").alias("layers"))


COUNT_TEXTS = """
 select o_orderkey as id, case o_orderkey % 4
  when 0 then (1 + o_custkey % 3) || ', 2,1,' || (o_orderkey % 5)
  when 1 then '1,2,3'
  when 2 then '1,x,3,4'
  else '1,1,' || (o_custkey % 9) || ',1' end as raw from orders
"""


def counts_csv(spark, d):
    raw = fx.from_body(spark, d, COUNT_TEXTS, "orders")
    counts = L.counts_from_csv(F.col("raw"), 4)
    return raw.select("id", L.counts_to_csv(counts).alias("counts_csv"),
                      F.round(L.counts_overhead(counts, 4), 9).alias("relative_overhead"))


def overhead(spark, d):
    key = F.col("layer_key")
    return _layered(spark, d).select(
        "id", L.extra_layers(key, N).alias("extra_layers"),
        F.round(L.relative_overhead(key, N), 9).alias("relative_overhead"))


def duplication_counts(spark, d):
    return C.duplication_counts(_layered(spark, d), ["id"]).select("id", "layer", "times")


def condition_table(spark, d):
    blocks = fx.block_pairs(spark, d).select(F.col("i1").alias("i"), F.col("j1").alias("j")).dropDuplicates()
    return C.condition_table(blocks, N).select(
        "name", "layer_spec", "extra_layers", F.round("overhead_fraction", 9).alias("overhead_fraction"))


def named_conditions(spark, d):
    """``NAME=SPEC`` lines of every order's spec text."""
    raw = fx.from_body(spark, d, SPEC_TEXTS, "orders").select(F.concat(F.lit(" c"), F.col("id"), F.lit(" = "), F.col("raw")).alias("line"))
    return C.parse_conditions(raw, N).select("name", F.array_join("layer_key", ",").alias("layers"), "extra_layers")


def spec_documents(spark, d):
    """Specs as JSON documents: objects with each field, arrays and bare text."""
    raw = fx.from_body(spark, d, SPEC_TEXTS, "orders").selectExpr("id", """case id % 8
      when 0 then '{"layers":[' || i || ',' || j || ',3],"blocks":"1,2"}'
      when 1 then '{"layer_indices":["' || i || '",' || j || ']}'
      when 2 then '{"blocks":"' || i || ',' || j || ';0,2"}'
      when 3 then '{"key":"(' || i || ', ' || j || ')","spec":"layers:1"}'
      when 4 then '{"key":[' || i || ',' || j || ']}'
      when 5 then '{"spec":"layers:' || i || ',' || j || '"}'
      when 6 then '[' || i || ',' || j || ',2]'
      else '"' || i || ',' || j || '"' end as doc""")
    layers = L.parse_document(N, F.try_parse_json("doc"))
    return raw.select("id", F.array_join(layers, ",").alias("layers"))


QUERIES = {
    f.__name__: f for f in (
        sweep_space, sweep_strategic, span_filter, index_slice, expand_single, expand_multi, validate_configs,
        spec_parse, queue_parse, pending_configs, repeat_sweep, count_encode, count_decode, counts_csv, overhead,
        duplication_counts, condition_table, named_conditions, spec_documents)
}

_SPACE = f"with {fx.MODELS_SQL}, {fx.SPACE_SQL}"
_LAYERED = f"with {fx.BLOCKS_SQL}"

_SINGLE = "case when i = 0 and j = 0 then range(0, {n}) else list_concat(range(0, j), range(i, {n})) end"

_STRATEGIC = f"""
with {fx.MODELS_SQL}, n as (select model_id, num_layers as n from models), raw as (
 select model_id, 0 as g, 'baseline' as family, 0 as i, 0 as j from n
 union all select model_id, 1, 'early', s, s + 1 from n, lateral (select unnest(range(0, n // 4)) as s)
 union all select model_id, 2, 'middle', s, s + 1 from n, lateral (select unnest(range(n * 3 // 8, n * 5 // 8)) as s)
 union all select model_id, 3, 'late', s, least(s + 1, n) from n, lateral (select unnest(range(n * 3 // 4, n)) as s)
 union all select model_id, 4, 'span3', s, least(s + 3, n) from n, lateral (select unnest(range(0, n, 5)) as s)
 union all select model_id, 5, 'span5', s, least(s + 5, n) from n, lateral (select unnest([n // 5, n * 2 // 5, n * 3 // 5, n * 5 // 6, n * 7 // 8]) as s)
 union all select model_id, 6, 'span8', s, least(s + 8, n) from n, lateral (select unnest(range(0, n, 8)) as s)
 union all select model_id, 7, 'span12', s, least(s + 12, n) from n, lateral (select unnest(range(0, n, 12)) as s)
 union all select model_id, 8, 'spacing', s, least(e, n) from n, lateral (
   select unnest([0,1,2,4,8,16,24,32,40,44]) as s, unnest([1,2,4,8,16,24,32,40,44,n]) as e) where s < least(e, n)),
first_seen as (
 select model_id, i, j, min(g * 1000 + i) as pos, arg_min(family, g * 1000 + i) as family from raw group by 1, 2, 3)
select model_id, cast(row_number() over (partition by model_id order by pos) - 1 as int) as idx, family,
 cast(i as int) as i, cast(j as int) as j from first_seen
"""

ORACLES = {
    "sweep_space": f"{_SPACE} select model_id, idx, i, j from space",
    "sweep_strategic": _STRATEGIC,
    "span_filter": f"{_SPACE} select model_id, i, j from space where j > 0 and j - i between 3 and 6",
    "index_slice": f"{_SPACE} select model_id, idx, i, j from space where idx >= 100 and idx < 140",
    "expand_single": f"""{_SPACE}, e as (select *, {_SINGLE.format(n='num_layers')} as k from space)
        select model_id, i, j, 'layers:' || array_to_string(k, ',') as spec, cast(len(k) as int) as steps,
         j = 0 as is_baseline,
         case when j = 0 then 'baseline' else '[[0-' || j || ']-[' || (i + 1) || '-' || num_layers || ']]' end as label
        from e""",
    "expand_multi": f"""{_LAYERED} select id, i1 || ',' || j1 || ';' || i2 || ',' || j2 as block_spec,
        'layers:' || array_to_string(layer_key, ',') as spec from layered""",
    "validate_configs": """select l_linenumber,
        count(*) filter (where l_partkey % 26 < 24 and l_suppkey % 25 < 24) as valid,
        count(*) filter (where not (l_partkey % 26 < 24 and l_suppkey % 25 < 24)) as rejected
        from lineitem group by 1""",
    "spec_parse": f"""with t as ({SPEC_TEXTS})
        select id, case id % 9 when 0 then 'layers' when 1 then 'blocks' when 2 then 'pair' when 3 then 'pair'
          when 4 then 'layers' when 5 then 'blocks' when 6 then 'layers' when 7 then 'blocks' else 'pair' end as kind,
         case id % 9
          when 0 then i || ',' || (i+1) || ',3'
          when 2 then array_to_string(list_concat(range(0, j), range(i, 24)), ',')
          when 3 then array_to_string(list_concat(range(0, j), range(i, 24)), ',')
          when 4 then '1,' || i
          when 1 then array_to_string(two, ',') when 5 then array_to_string(two, ',') end as layers
        from (select *, list_concat(once[1 : len(once) - list_position(list_reverse(once), 1) + 1], [0, 1],
               once[len(once) - list_position(list_reverse(once), 1) + 2 :]) as two
              from (select *, list_concat(range(0, j), range(i, 24)) as once from t))""",
    "queue_parse": f"""with t as ({SPEC_TEXTS})
        select id, case id % 4 when 0 then 'layers' when 1 then 'layer_indices' when 2 then 'legacy_key' else 'spec' end as source,
         case id % 4 when 0 then i || ',' || j || ',5' when 1 then null
          when 2 then array_to_string(list_concat(range(0, j), range(i, 24)), ',')
          else case id % 9
          when 0 then i || ',' || (i+1) || ',3'
          when 2 then array_to_string(list_concat(range(0, j), range(i, 24)), ',')
          when 3 then array_to_string(list_concat(range(0, j), range(i, 24)), ',')
          when 4 then '1,' || i
          when 1 then array_to_string(two, ',') when 5 then array_to_string(two, ',') end end as layers
        from (select *, list_concat(once[1 : len(once) - list_position(list_reverse(once), 1) + 1], [0, 1],
               once[len(once) - list_position(list_reverse(once), 1) + 2 :]) as two
              from (select *, list_concat(range(0, j), range(i, 24)) as once from t))""",
    "pending_configs": f"""{_SPACE} select model_id, idx, i, j from space s where not exists (
        select 1 from lineitem where l_suppkey = s.model_id and l_linenumber % 8 = s.i
         and l_linenumber % 8 + 1 + cast(l_quantity as int) % 8 = s.j)""",
    "repeat_sweep": f"""with {fx.MODELS_SQL}, r as (
         select model_id, num_layers, l, e from models, lateral (select unnest(range(0, num_layers)) as l) a,
          lateral (select unnest([1, 2, 3]) as e) b)
        select model_id, 0 as idx, 'baseline' as name, cast(null as int) as layer, 0 as extra_repeats,
         1 as total_occurrences, array_to_string(range(0, num_layers), ',') as layer_indices_key from models
        union all
        select model_id, cast(l * 3 + e as int), 'layer' || lpad(cast(l as varchar), 2, '0') || '_x' || (e + 1),
         cast(l as int), cast(e as int), cast(e + 1 as int),
         array_to_string(list_concat(range(0, l + 1), list_transform(range(0, e), lambda x: l), range(l + 1, num_layers)), ',') from r""",
    "count_encode": f"""{_LAYERED} select id, array_to_string(list_transform(range(0, 24),
        lambda l: len(list_filter(layer_key, lambda x: x = l))), ',') as counts_csv from layered""",
    "count_decode": f"{_LAYERED} select id, array_to_string(list_sort(layer_key), ',') as layers from layered",
    "counts_csv": f"""with t as ({COUNT_TEXTS})
        select id, case id % 4 when 0 then replace(raw, ' ', '') when 3 then raw end as counts_csv,
         case when id % 4 in (0, 3) then round((list_sum(list_transform(string_split(replace(raw, ' ', ''), ','),
           lambda x: try_cast(x as int))) - 4) / 4e0, 9) end as relative_overhead from t""",
    "overhead": f"""{_LAYERED} select id, cast(len(layer_key) - 24 as int) as extra_layers,
        round((len(layer_key) - 24) / 24e0, 9) as relative_overhead from layered""",
    "duplication_counts": f"""{_LAYERED} select id, cast(layer as int) as layer, cast(count(*) as int) as times
        from (select id, unnest(layer_key) as layer from layered) group by 1, 2 having count(*) > 1""",
    "condition_table": f"""with {fx.BLOCKS_SQL}, b as (select distinct i1 as i, j1 as j from blocks)
        select 'baseline' as name, 'layers:' || array_to_string(range(0, 24), ',') as layer_spec, 0 as extra_layers, 0e0 as overhead_fraction
        union all select 'block_' || i || '_' || j, 'layers:' || array_to_string(list_concat(range(0, j), range(i, 24)), ','),
         cast(j - i as int), round((j - i) / 24e0, 9) from b""",
}
ORACLES["named_conditions"] = f"""with s as ({ORACLES["spec_parse"]})
    select 'c' || id as name, layers, cast(len(string_split(layers, ',')) - 24 as int) as extra_layers from s"""
ORACLES["spec_documents"] = f"""with t as ({SPEC_TEXTS}),
    o as (select *, list_concat(range(0, j), range(i, 24)) as once from t),
    w as (select *, list_concat(once[1 : len(once) - list_position(list_reverse(once), 1) + 1], [0, 1], once[len(once) - list_position(list_reverse(once), 1) + 2 :]) as two from o)
    select id, case id % 8 when 0 then i || ',' || j || ',3' when 1 then i || ',' || j when 2 then array_to_string(two, ',') when 5 then i || ',' || j when 6 then i || ',' || j || ',2'
     else array_to_string(once, ',') end as layers from w"""

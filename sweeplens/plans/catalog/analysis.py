"""Score tables, balanced ranking, grids and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators import analysis as A
from sweeplens.operators import config_space as C
from sweeplens.plans import fixtures as fx
from sweeplens.session import spread

N = fx.N_LAYERS


def balanced(spark, d):
    return A.balance_table(fx.scores(spark, d).withColumnRenamed("eq_score_pct", "eq_score"), N)


def _r(*names):
    return [F.round(n, 9).alias(n) for n in names]


def balanced_topn(spark, d):
    top = A.top_balanced(balanced(spark, d), 10)
    return top.select("rank", "relayer", "method", *_r("math_score", "eq_score", "math_delta", "eq_delta", "balanced_score"))


def metric_join(spark, d):
    """Two separate metric tables, the second without every seventh configuration's group."""
    scored = fx.scores(spark, d)
    math, eq = fx.metric(scored, "math_score"), fx.metric(scored.filter("j - i <> 7"), "eq_score_pct")
    rows = A.balance(math, eq, N).rows
    return rows.select(F.array_join("layer_key", ",").alias("layers"), *_r("math_delta", "eq_delta", "balanced_score"))


def balanced_rank(spark, d):
    ranked = A.ranked_balanced(balanced(spark, d))
    return ranked.select("rank", F.array_join("layer_key", ",").alias("layers"), *_r("balanced_score"))


def balanced_summary(spark, d):
    s = A.run_summary(balanced(spark, d))
    return s.select(
        "common_config_count", "nonbaseline_config_count", "num_layers", *_r("eq_scale_factor"), "eq_scale_applied",
        "eq_scale_reason", "baseline_source", F.array_join("baseline_key", ",").alias("baseline_key"),
        F.size("warnings").alias("warnings"), F.array_join("top_key", ",").alias("top_key"), *_r("top_score"))


def baseline_choice(spark, d):
    common = fx.scores(spark, d).withColumnRenamed("eq_score_pct", "eq_score").filter("cfg_id > 0")
    out = A.choose_baseline(common, N)
    return out.select(F.array_join("layer_key", ",").alias("layers"), *_r("math_score", "eq_score"), "source")


def scale_inference(spark, d):
    from sweeplens.session import pin

    out = A.scale_info(pin(fx.metric(fx.scores(spark, d), "eq_score_pct")))
    return out.select(*_r("factor"), "applied", "reason")


def infer_layers(spark, d):
    scored = fx.scores(spark, d)
    lists = A.infer_layers(scored).withColumn("input", F.lit("lists"))
    bare = A.infer_layers(scored.filter("cfg_id > 0")).withColumn("input", F.lit("no_baseline"))
    pairs = A.infer_layers_from_pairs(scored).withColumn("input", F.lit("pairs"))
    return lists.unionByName(bare).unionByName(pairs)


PAYLOADS = """
 select l_orderkey*8 + l_linenumber as seq,
  case when l_partkey % 5 = 0 then 'layers:' || (l_suppkey % 24) || ',1' when l_partkey % 5 = 4 then 'junk' || l_suppkey
   else '(' || (l_orderkey % 20) || ',' || (l_orderkey % 20 + 1 + l_linenumber % 4) || ')' end as raw_key,
  case l_linenumber % 5
   when 0 then cast(l_orderkey*8 + l_linenumber as varchar)
   when 1 then '{"score": ' || (l_orderkey*8 + l_linenumber) || '.5, "math_score": 1}'
   when 2 then '{"math_score": ' || (l_orderkey*8 + l_linenumber) || '}'
   when 3 then '{"eq_score": "x"}'
   else '{"score": "bad", "eq_score": 3}' end as payload_text
 from lineitem
"""


def _payloads(spark, d):
    body = PAYLOADS.replace("{", "{{").replace("}", "}}").replace("as varchar", "as string")
    rows = spread(fx.from_body(spark, d, body, "lineitem"))
    return rows.withColumn("payload", F.try_parse_json("payload_text"))


def payload_scores(spark, d):
    kept, _ = A.score_table(_payloads(spark, d), N)
    return kept.select(F.array_join("layer_key", ",").alias("layers"), "score")


def payload_rejects(spark, d):
    _, bad = A.score_table(_payloads(spark, d), N)
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


RUN_SCORES = """
 select l_linenumber as run, cast(l_orderkey % 301 as int) as cfg_id,
  sum(cast(l_quantity as bigint)) / (50e0*count(*)) as score
 from lineitem group by 1, 2
"""


def run_scores(spark, d):
    return fx.from_body(spark, d, RUN_SCORES, "lineitem").join(F.broadcast(fx.configs(spark)), "cfg_id")


def score_grid(spark, d):
    return A.score_grid(run_scores(spark, d), N, ["run"]).select("run", "i", "j", *_r("value"))


def diff_grid(spark, d):
    return A.score_grid(run_scores(spark, d), N, ["run"], diff=True).select("run", "i", "j", *_r("value"))


def grid_wide(spark, d):
    grid = A.score_grid(run_scores(spark, d), N, ["run"], mask_missing=True)
    wide = A.wide_grid(grid, ["run"], N)
    return wide.select("run", "i", *[F.round(F.col(f"`{j}`"), 9).alias(f"j{j}") for j in (0, 1, 12, 24)])


def diff_summary(spark, d):
    return A.diff_summary(run_scores(spark, d), ["run"]).select(
        "run", "best_i", "best_j", *_r("baseline", "best_score", "best_gain", "bound"))


def score_summary(spark, d):
    return A.score_summary(run_scores(spark, d), ["run"]).select(
        "run", "has_baseline", "best_i", "best_j", *_r("baseline", "min_score", "max_score", "mean_score", "std_score"))


REPEAT_SCORES = """
 select l_suppkey as model_id, cast(l_partkey % (8 + l_suppkey % 25) as int) as layer, cast(l_linenumber % 4 as int) as extra,
  case when max(l_linenumber % 4) = 0 and l_suppkey % 2 = 1 then null else sum(cast(l_quantity as bigint)) / (50e0*count(*)) end as score
 from lineitem group by 1, 2, 3
"""


def _repeat(spark, d):
    models = fx.models(spark, d)
    manifest = C.repeat_sweep(models, 3)
    raw = fx.from_body(spark, d, REPEAT_SCORES, "lineitem").join(models, "model_id")
    base = L.baseline_layers(F.col("num_layers"))
    key = F.when(F.col("extra") == 0, base).otherwise(
        L.insert_after_last(base, F.col("layer"), F.array_repeat("layer", F.col("extra"))))
    scores = raw.select("model_id", F.array_join(key, ",").alias("layer_indices_key"), "score")
    scores = scores.groupBy("model_id", "layer_indices_key").agg(F.max("score").alias("score"))
    return A.repeat_grid(manifest, scores, ["model_id"])


def repeat_grid(spark, d):
    return _repeat(spark, d).select("model_id", "extra", "layer", *_r("value", "baseline"))


def repeat_best(spark, d):
    return A.best_cell(_repeat(spark, d), ["model_id"]).select("model_id", "extra", "layer", *_r("value"))


def clip_bounds(spark, d):
    diffs = _repeat(spark, d).withColumn("value", F.col("value") - F.col("baseline"))
    return A.clip_bounds(diffs, ["model_id"]).select("model_id", *_r("vmin", "vmax"))


def centered_ranges(spark, d):
    """The clip bounds moved up and down, so that zero lies inside, above or below."""
    diffs = _repeat(spark, d).withColumn("value", F.col("value") - F.col("baseline"))
    bounds = A.clip_bounds(diffs, ["model_id"]).withColumn("shift", F.explode(F.array(F.lit(-1000.0), F.lit(0.0), F.lit(1000.0))))
    inside = A.centered_range(F.col("vmin") + F.col("shift"), F.col("vmax") + F.col("shift"))
    return bounds.select("model_id", "shift", F.round(inside["vmin"], 7).alias("low"), F.round(inside["vmax"], 7).alias("high"))


QUERIES = {
    f.__name__: f for f in (
        balanced_topn, metric_join, balanced_rank, balanced_summary, baseline_choice, scale_inference, infer_layers, payload_scores,
        payload_rejects, score_grid, diff_grid, grid_wide, diff_summary, score_summary, repeat_grid, repeat_best,
        clip_bounds, centered_ranges)
}

BALANCED_SQL = f"""
 {fx.CONFIGS_SQL}, {fx.SCORES_SQL},
 sc as (select cfg_id, i, j, layer_key, math_score, eq_score_pct * 0.01e0 as eq_score from scores join configs using (cfg_id)),
 base as (select math_score as bm, eq_score as be from sc where cfg_id = 0),
 dl as (select sc.*, math_score - bm as math_delta, eq_score - be as eq_delta from sc, base where cfg_id > 0),
 st as (select avg(math_delta) as mm, stddev_pop(math_delta) as ms, avg(eq_delta) as em, stddev_pop(eq_delta) as es from dl),
 bal as (select dl.*, (math_delta - mm) / ms + (eq_delta - em) / es as balanced_score from dl, st)
"""
_RUNS = f"{fx.CONFIGS_SQL}, rs as ({RUN_SCORES}), rc as (select run, i, j, score from rs join configs using (cfg_id))"
_BASE = "rb as (select run, coalesce(max(case when j = 0 then score end), avg(score)) as baseline from rc group by 1)"
_CELLS = "cells as (select run, a.id as i, b.id as j, baseline from rb, ids a, ids b)"
_BEST = "row_number() over (partition by run order by score desc, j, i) as rn"
_REPEAT = f"""
 {fx.MODELS_SQL}, raw as ({REPEAT_SCORES}),
 val as (select model_id, layer, extra, score from raw where extra > 0),
 bs as (select model_id, max(score) as base from raw where extra = 0 group by 1),
 cells as (select model_id, cast(e as int) as extra, cast(l as int) as layer from models, lateral (select unnest(range(0, num_layers)) as l) a, lateral (select unnest([1,2,3]) as e) b),
 joined as (select model_id, extra, layer, score as value from cells left join val using (model_id, extra, layer)),
 rg as (select j.*, coalesce(base, avg(value) over (partition by j.model_id)) as baseline from joined j left join bs using (model_id))
"""

ORACLES = {
    "balanced_topn": f"""with {BALANCED_SQL} select cast(row_number() over (order by balanced_score desc, eq_delta desc, math_delta desc, layer_key) as int) as rank,
        'layers:' || array_to_string(layer_key, ',') as relayer, 'balanced_z_delta' as method, round(math_score, 9) as math_score,
        round(eq_score, 9) as eq_score, round(math_delta, 9) as math_delta, round(eq_delta, 9) as eq_delta,
        round(balanced_score, 9) as balanced_score from bal order by rank limit 10""",
    "metric_join": f"""with {BALANCED_SQL.replace('join configs using (cfg_id))', 'join configs using (cfg_id) where j - i <> 7)')}
        select array_to_string(layer_key, ',') as layers, round(math_delta, 9) as math_delta, round(eq_delta, 9) as eq_delta,
         round(balanced_score, 9) as balanced_score from bal""",
    "balanced_rank": f"""with {BALANCED_SQL} select row_number() over (order by balanced_score desc, eq_delta desc, math_delta desc, layer_key) as rank,
        array_to_string(layer_key, ',') as layers, round(balanced_score, 9) as balanced_score from bal""",
    "balanced_summary": f"""with {BALANCED_SQL} select (select count(*) from sc) as common_config_count, (select count(*) from dl) as nonbaseline_config_count,
        24 as num_layers, 0.01e0 as eq_scale_factor, true as eq_scale_applied,
        (select printf('converted_from_percent_scale baseline=%.4f p95=%.4f', max(case when cfg_id = 0 then eq_score_pct end), quantile_cont(eq_score_pct, 0.95)) from scores) as eq_scale_reason,
        'canonical' as baseline_source, array_to_string(range(0, 24), ',') as baseline_key, 0 as warnings,
        array_to_string(layer_key, ',') as top_key, round(balanced_score, 9) as top_score
        from bal order by balanced_score desc, eq_delta desc, math_delta desc limit 1""",
    "baseline_choice": f"""with {fx.CONFIGS_SQL}, {fx.SCORES_SQL} select array_to_string(layer_key, ',') as layers,
        round(math_score, 9) as math_score, round(eq_score_pct, 9) as eq_score, 'fallback_proxy' as source
        from scores join configs using (cfg_id) where cfg_id > 0 order by len(layer_key), layer_key limit 1""",
    "scale_inference": f"""with {fx.SCORES_SQL} select 0.01e0 as factor, true as applied,
        printf('converted_from_percent_scale baseline=%.4f p95=%.4f', max(case when cfg_id = 0 then eq_score_pct end), quantile_cont(eq_score_pct, 0.95)) as reason from scores""",
    "infer_layers": f"""with {fx.SCORES_SQL}, {fx.CONFIGS_SQL}, s as (select * from scores join configs using (cfg_id))
        select cast(max(case when cfg_id = 0 then len(layer_key) end) as int) as num_layers, 'canonical' as source, 'lists' as input from s
        union all select cast(max(list_max(layer_key)) + 1 as int), 'max_id', 'no_baseline' from s where cfg_id > 0
        union all select cast(max(j) as int), 'max_j', 'pairs' from s""",
    "payload_scores": f"""with p as ({PAYLOADS}), g as (select seq,
         case when raw_key like 'layers:%' then substr(raw_key, 8) when raw_key like '(%' then
          array_to_string(list_concat(range(0, cast(regexp_extract(raw_key, '([0-9]+)\\)', 1) as int)), range(cast(regexp_extract(raw_key, '([0-9]+),', 1) as int), 24)), ',') end as layers,
         case when payload_text not like '{{%' then cast(payload_text as double) when payload_text like '{{"score": "bad%' then null
          when payload_text like '{{"score"%' then cast(seq as double) + 0.5e0 when payload_text like '{{"math%' then cast(seq as double) end as score from p)
        select layers, score from (select layers, score, row_number() over (partition by layers order by seq desc) as rn from g where layers is not null and score is not null) where rn = 1""",
    "payload_rejects": f"""with p as ({PAYLOADS}) select case when raw_key like 'junk%' then 'bad_key' else 'bad_score' end as reason, count(*) as n
        from p where raw_key like 'junk%' or payload_text like '%"x"%' or payload_text like '%bad%' group by 1""",
    "score_grid": f"""with {_RUNS}, {_BASE}, {_CELLS} select run, i, j, round(coalesce(score, baseline * 0.8e0), 9) as value
        from cells left join rc using (run, i, j)""",
    "diff_grid": f"""with {_RUNS}, {_BASE}, {_CELLS} select run, i, j, round(score - baseline, 9) as value
        from cells left join rc using (run, i, j)""",
    "grid_wide": f"""with {_RUNS}, {_BASE}, {_CELLS} select run, i, round(max(case when j = 0 then score end), 9) as j0,
        round(max(case when j = 1 then score end), 9) as j1, round(max(case when j = 12 then score end), 9) as j12,
        round(max(case when j = 24 then score end), 9) as j24 from cells left join rc using (run, i, j) group by 1, 2""",
    "diff_summary": f"""with {_RUNS}, {_BASE}, o as (select rc.*, {_BEST} from rc), g as (select run, max(abs(score - baseline)) as bound from rc join rb using (run) group by 1)
        select run, i as best_i, j as best_j, round(baseline, 9) as baseline, round(score, 9) as best_score, round(score - baseline, 9) as best_gain,
         round(bound, 9) as bound from o join rb using (run) join g using (run) where rn = 1""",
    "score_summary": f"""with {_RUNS}, o as (select rc.*, {_BEST} from rc), s as (select run, max(case when j = 0 then score end) as b,
         min(score) as lo, max(score) as hi, avg(score) as mean, stddev_pop(score) as sd from rc group by 1)
        select run, b is not null as has_baseline, i as best_i, j as best_j, round(b, 9) as baseline, round(lo, 9) as min_score,
         round(hi, 9) as max_score, round(mean, 9) as mean_score, round(sd, 9) as std_score from s join o using (run) where rn = 1""",
    "repeat_grid": f"with {_REPEAT} select model_id, extra, layer, round(value, 9) as value, round(baseline, 9) as baseline from rg",
    "repeat_best": f"""with {_REPEAT} select model_id, extra, layer, round(value, 9) as value from (select *, row_number() over (partition by model_id order by value desc, extra, layer) as rn
        from rg where value is not null) where rn = 1""",
    "clip_bounds": f"""with {_REPEAT}, df as (select model_id, value - baseline as d from rg where value is not null),
        s as (select model_id, max(d) as best, count(*) filter (where d > 0) as np, stddev_pop(d) filter (where d > 0) as sp,
         count(*) filter (where d >= 0) as nn, stddev_pop(d) filter (where d >= 0) as sn, stddev_pop(d) as sa,
         quantile_cont(d, 0.95) filter (where d > 0) as qp, quantile_cont(-d, 0.95) filter (where d < 0) as qn from df group by 1),
        a as (select *, case when np >= 2 and sp > 0 then sp when nn >= 2 and sn > 0 then sn when sa > 0 then sa else 1e-9 end as sigma,
         coalesce(qp, greatest(best, 0e0)) as q_pos, coalesce(qn, qp, greatest(best, 0e0)) as q_neg from s),
        b as (select *, least(greatest(case when q_pos > 0 then q_neg / greatest(q_pos, 1e-9) else 1e0 end, 1e0), 6e0) as ratio,
         greatest(3e0 * sigma, q_pos, best + 1e-9, 1e-9) as vmax from a)
        select model_id, round(-least(greatest(2e0 * sigma * ratio, q_neg, 1e-9), greatest(6e0 * vmax, 1e-9)), 9) as vmin, round(vmax, 9) as vmax from b""",
}
ORACLES["centered_ranges"] = f"""with c as ({ORACLES["clip_bounds"]}), s as (select model_id, vmin + shift as a, vmax + shift as b, shift from c cross join (values (-1000e0), (0e0), (1000e0)) v(shift))
    select model_id, shift, round(case when a >= 0 then -1e-6 else a end, 7) as low, round(case when b <= 0 then 1e-6 else b end, 7) as high from s"""

"""Surrogate data, training and candidate search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.functions import text as X
from sweeplens.operators import analysis as A
from sweeplens.operators import candidates as K
from sweeplens.operators import surrogate as S
from sweeplens.operators.stage import computed
from sweeplens.plans import fixtures as fx
from sweeplens.plans.catalog import analysis as CA
from sweeplens.plans.catalog import beam as CB
from sweeplens.session import pin, spread

N = fx.N_LAYERS


def _r(*names):
    return [F.round(n, 9).alias(n) for n in names]


RECORDS = """
 select cast(l_orderkey % 301 as int) as cfg_id, case l_linenumber % 3 when 0 then 'beam' when 1 then 'single_block' else 'other' end as source,
  case l_partkey % 4 when 0 then 'runs/202401' || lpad(cast(1 + l_suppkey % 28 as varchar(2)), 2, '0') || '_' || (100000 + l_partkey % 100000) || '/m.parquet'
   when 1 then 'runs/20240115_12' || (10 + l_suppkey % 50) || '/m.parquet' when 2 then 'runs/20231231/m.parquet' else 'runs/latest/m.parquet' end as source_path,
  cast(l_quantity as bigint) as mtime, l_orderkey * 8 + l_linenumber as seq, l_partkey as pk, l_extendedprice / 1e5 as score from lineitem
"""


def _records(spark, d):
    """Score records of three sources; repeated arrival numbers are told apart by part."""
    raw = fx.from_body(spark, d, RECORDS, "lineitem")
    raw = raw.withColumn("seq", F.col("seq") * 100000 + F.col("pk")).drop("pk")
    return raw.join(F.broadcast(fx.configs(spark)), "cfg_id")


def source_merge(spark, d):
    out = S.merge_sources(_records(spark, d).select("layer_key", "score", "source", "source_path", "mtime", "seq"))
    return out.select(F.array_join("layer_key", ",").alias("layers"), "source", "source_path", "stamp", "mtime")


def path_stamps(spark, d):
    rows = fx.from_body(spark, d, RECORDS, "lineitem")
    return rows.groupBy("source_path").agg(F.count("*").alias("n")).withColumn("stamp", X.path_stamp(F.col("source_path")))


def _features(spark, d):
    return S.feature_table(CA.balanced(spark, d))


def feature_table(spark, d):
    return _features(spark, d).select(L.counts_to_csv(F.col("counts")).alias("counts_csv"), *_r("balanced_score", "math_delta", "eq_delta"))


def label_summary(spark, d):
    out = S.label_summary(_features(spark, d))
    return out.select("n_rows", *_r(*[c for c in out.columns if c != "n_rows"]))


def quantile_bins(spark, d):
    """Equal-count bins of every order's price."""
    orders = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return S.quantile_bins(orders, "o_totalprice", 7, [F.col("o_orderkey")]).groupBy("bin").agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


def _split(spark, d):
    return S.holdout_split(_features(spark, d), "balanced_score", "layer_key", 0.05, 42)


def holdout_split(spark, d):
    return _split(spark, d).select(F.array_join("layer_key", ",").alias("layers"), "bin", "split")


def spearman_ordinal(spark, d):
    rows = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.expr("o_custkey % 100 + o_totalprice / 1e4").alias("other"))
    out = S.spearman(rows, "o_totalprice", "other", [F.col("o_orderkey")])
    return out.select("n", *_r("spearman"))


def mae(spark, d):
    rows = fx.table(spark, d, "lineitem").select((F.round(F.col("l_discount") * 100)).alias("a"), F.col("l_quantity").alias("b"))
    return S.mae(rows, "a", "b").select(*_r("mae"))


def training_table(spark, d):
    records = pin(S.merge_sources(_records(spark, d).select("layer_key", "score", "source", "source_path", "mtime", "seq")))
    out = S.training_table(_features(spark, d), records, records.filter("source = 'beam'"), N)
    return out.select("counts_csv", *_r("math_delta", "balanced_score"), "math_source", "eq_source", "math_source_path",
                      "is_baseline", "is_single_block", "extra_layers", *_r("relative_overhead"))


def surrogate_train(spark, d):
    """All presets with their own rounds, three targets each."""
    result = S.train(_split(spark, d))
    cols = ["trial", "rounds", "depth", "spearman_method", "mae_method", "spearman_math", "mae_math", "spearman_eq", "mae_eq", "is_best", "gate_passed"]
    return S.trial_table(spark, result).select(*cols)


def _best_models(spark, d):
    split = pin(_split(spark, d))
    return split, S.train(split)


def feature_importance(spark, d):
    _, result = _best_models(spark, d)
    return S.feature_importance(result, N)


def pred_vs_true(spark, d):
    split, result = _best_models(spark, d)
    return S.predicted_vs_true(split, result.models).select(
        F.array_join("layer_key", ",").alias("layers"), "split", "balanced_score", "pred_method", "pred_math", "pred_eq")


def _pool(spark, d):
    ids = spread(fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("candidate_id")))
    anchors = A.top_balanced(CA.balanced(spark, d), 50).select(L.encode_counts(F.col("layer_key"), N).alias("counts"))
    return ids, anchors


def candidate_pool(spark, d):
    ids, anchors = _pool(spark, d)
    return K.generate(ids, N, max_extra=12, max_repeat=3, anchors=anchors).select(
        "candidate_id", "source", "extra_layers", F.round("relative_overhead", 9).alias("relative_overhead"), "counts_csv")


def _weights(spark, d):
    rows = {r["layer"]: r for r in CB.layer_weights(spark, d).collect()}  # 24 rows
    wm, wq = ([rows[k][c] if k in rows else 0.0 for k in range(N)] for c in ("wm", "wq"))
    return {"method": [a + b for a, b in zip(wm, wq)], "math": wm, "eq": wq}


def candidate_search(spark, d):
    """Generated pool scored by data-derived layer weights, distinct top 100."""
    ids, anchors = _pool(spark, d)
    top = K.search(ids, N, K.linear_predictor(_weights(spark, d)), 100, min_math=-9.0, min_eq=-9.0,
                   max_extra=12, max_repeat=3, anchors=anchors)
    return top.select("rank", "candidate_id", "counts_csv", *_r("pred_final", "pred_method"))


def candidate_model_search(spark, d):
    """Generated pool scored by the best trained regressors, distinct top 100."""
    ids, anchors = _pool(spark, d)
    result = S.train(_split(spark, d))
    top = K.search(ids, N, K.model_predictor(result.models), 100, min_math=-9.0, min_eq=-9.0,
                   max_extra=12, max_repeat=3, anchors=anchors)
    return top.select("rank", "candidate_id", "counts_csv", *_r("pred_final", "pred_method", "pred_math", "pred_eq"))


def _vectors(spark, d):
    """Count vectors of the orders' two-block sequences as candidates; many repeat."""
    key = L.expand_blocks(N, F.col("blocks"))
    made = computed(fx.block_pairs(spark, d), counts=L.encode_counts(key, N))
    cands = K.describe(made.select(F.col("id").alias("candidate_id"), F.lit("orders").alias("source"), "counts"), N)
    # Weights in 128ths and 64ths: sums are exact, so floors and ties do not hang on rounding.
    fixed = {"method": [((k * 7) % 11) / 128 for k in range(N)], "math": [1 / 64] * N, "eq": [((k * 5) % 7 - 3) / 64 for k in range(N)]}
    return K.score(cands, K.linear_predictor(fixed), penalty=0.5, min_math=30 / 64, min_eq=-2 / 64)


def candidate_topk(spark, d):
    scored = _vectors(spark, d)
    top = K.distinct_top_k(scored, 60, scored.filter("candidate_id % 10 = 0"))
    return top.select("rank", "candidate_id", "counts_csv", *_r("pred_final", "pred_math", "pred_eq"))


def score_stats(spark, d):
    return K.score_summary(_vectors(spark, d), 60)


def topk_config(spark, d):
    top = K.distinct_top_k(_vectors(spark, d), 60)
    return K.topk_config(top, N).select("rank", "config_line", "extra_layers", *_r("pred_final"), "source", "candidate_id")


QUERIES = {
    f.__name__: f for f in (
        source_merge, path_stamps, feature_table, label_summary, quantile_bins, holdout_split, spearman_ordinal, mae,
        training_table, surrogate_train, feature_importance, pred_vs_true, candidate_pool, candidate_search,
        candidate_model_search, candidate_topk, score_stats, topk_config)
}

_STAMP = """cast(coalesce(nullif(replace(regexp_extract(source_path, '(20[0-9]{6}_[0-9]{6})', 1), '_', ''), ''),
  nullif(replace(regexp_extract(source_path, '(20[0-9]{6}_[0-9]{4})', 1), '_', ''), ''), nullif(regexp_extract(source_path, '(20[0-9]{6})', 1), ''), '0') as bigint)"""
MERGE_SQL = f"""rr as ({RECORDS}), mg as (select *, {_STAMP} as stamp, row_number() over (partition by cfg_id order by
  case source when 'beam' then 3 when 'single_block' then 2 else 1 end desc, {_STAMP} desc, mtime desc, seq * 100000 + pk) as rn from rr),
 merged as (select * from mg where rn = 1)"""
FEATURE_SQL = f"""{CA.BALANCED_SQL}, ft as (select cfg_id, layer_key, balanced_score, math_delta, eq_delta from bal
  union all select 0, range(0, 24), 0e0, 0e0, 0e0)"""
_COUNTS = "array_to_string(list_transform(range(0, 24), lambda l: len(list_filter(layer_key, lambda x: x = l))), ',')"
VECTOR_SQL = f"""{fx.BLOCKS_SQL},
 ct as (select id, layer_key, {_COUNTS} as counts_csv, (len(layer_key) - 24) / 24e0 as rel,
   list_sum(list_transform(layer_key, lambda l: (l * 7) % 11)) / 128e0 as pm, len(layer_key) / 64e0 as pa, list_sum(list_transform(layer_key, lambda l: (l * 5) % 7 - 3)) / 64e0 as pe from layered),
 acc as (select *, pm - 0.5e0 * rel as pf from ct where len(layer_key) >= 30 and list_sum(list_transform(layer_key, lambda l: (l * 5) % 7 - 3)) >= -2),
 best as (select *, row_number() over (partition by counts_csv order by id) as rn from acc),
 top as (select *, row_number() over (order by pf desc, id) as rank from best where rn = 1)"""

ORACLES = {
    "source_merge": f"""with {fx.CONFIGS_SQL}, {MERGE_SQL} select array_to_string(layer_key, ',') as layers, source, source_path, stamp, mtime from merged join configs using (cfg_id)""",
    "path_stamps": f"""with rr as ({RECORDS}) select source_path, count(*) as n, any_value({_STAMP}) as stamp from rr group by 1""",
    "feature_table": f"""with {FEATURE_SQL} select {_COUNTS} as counts_csv, round(balanced_score, 9) as balanced_score, round(math_delta, 9) as math_delta, round(eq_delta, 9) as eq_delta from ft""",
    "label_summary": f"""with {FEATURE_SQL} select count(*) as n_rows, round(avg(balanced_score), 9) as method_mean, round(stddev_pop(balanced_score), 9) as method_std,
        round(avg(math_delta), 9) as math_mean, round(stddev_pop(math_delta), 9) as math_std, round(avg(eq_delta), 9) as eq_mean, round(stddev_pop(eq_delta), 9) as eq_std from ft""",
    "quantile_bins": """with r as (select *, row_number() over (order by o_totalprice, o_orderkey) - 1 as rk, count(*) over () as n from orders)
        select cast(least(6, floor((rk + 0.5e0) / n * 7)) as int) as bin, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from r group by 1""",
    "holdout_split": f"""with {FEATURE_SQL}, b as (select *, cast(least(9, floor((row_number() over (order by balanced_score, layer_key) - 0.5e0) / 301e0 * 10)) as int) as bin from ft),
        s as (select bin, count(*) as n, cast(floor(0.05e0 * count(*)) as int) as base, 0.05e0 * count(*) - floor(0.05e0 * count(*)) as frac from b group by 1),
        t as (select *, row_number() over (order by frac desc, bin desc) as turn, 15 - sum(base) over () as remaining from s),
        a as (select bin, base + case when turn <= remaining then 1 else 0 end as take from t),
        r as (select b.*, row_number() over (partition by bin order by md5('42:' || array_to_string(layer_key, ','))) as rk from b)
        select array_to_string(layer_key, ',') as layers, bin, case when rk <= take then 'holdout' else 'train' end as split from r join a using (bin)""",
    "spearman_ordinal": """with r as (select row_number() over (order by o_totalprice, o_orderkey) as ra, row_number() over (order by o_custkey % 100 + o_totalprice / 1e4, o_orderkey) as rb from orders)
        select count(*) as n, round(corr(ra, rb), 9) as spearman from r""",
    "mae": "select round(avg(abs(round(l_discount * 100) - l_quantity)), 9) as mae from lineitem",
    "training_table": f"""with {FEATURE_SQL}, {MERGE_SQL} select {_COUNTS} as counts_csv, round(math_delta, 9) as math_delta, round(balanced_score, 9) as balanced_score,
        coalesce(source, '') as math_source, case when source = 'beam' then 'beam' else '' end as eq_source, coalesce(source_path, '') as math_source_path, cfg_id = 0 as is_baseline, cfg_id > 0 as is_single_block,
        cast(len(layer_key) - 24 as int) as extra_layers, round((len(layer_key) - 24) / 24e0, 9) as relative_overhead from ft left join merged using (cfg_id)""",
    "candidate_topk": f"""with {VECTOR_SQL} select cast(rank as int) as rank, id as candidate_id, counts_csv, round(pf, 9) as pred_final, round(pa, 9) as pred_math, round(pe, 9) as pred_eq from top where rank <= 60""",
    "score_stats": f"""with {VECTOR_SQL} select (select count(*) from ct) as rows_scanned, (select count(*) from acc) as rows_accepted, 60 as top_k_requested""",
    "topk_config": f"""with {VECTOR_SQL} select cast(rank as int) as rank, 'layers:' || array_to_string(list_sort(layer_key), ',') as config_line, cast(len(layer_key) - 24 as int) as extra_layers,
        round(pf, 9) as pred_final, 'orders' as source, cast(id as varchar) as candidate_id from top where rank <= 60
        union all select 0, '0,0', 0, 0e0, 'forced_baseline', 'baseline'""",
}

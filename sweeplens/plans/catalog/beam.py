"""Beam search: seeds, expansion, selection, registry and the full loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators import beam as B
from sweeplens.plans import fixtures as fx
from sweeplens.session import pin, scratch_path

N = fx.N_LAYERS
PENALTY = 0.5


def _r(*names):
    return [F.round(n, 9).alias(n) for n in names]


def _pairs(spark, d):
    scored = fx.scores(spark, d)
    return pin(scored.select("i", "j", "math_score", (F.col("eq_score_pct") * 0.01).alias("eq_score")))


def _seeded(spark, d):
    seeds, stats = B.seed_entries(_pairs(spark, d), N, PENALTY)
    return pin(seeds), stats


def _measured(spark, d):
    """Scores of the two-block sequences found in the orders, per layer key."""
    pairs = fx.block_pairs(spark, d).select("id", L.expand_blocks(N, F.col("blocks")).alias("layer_key"))
    totals = fx.table(spark, d, "orders").selectExpr("o_orderkey as id", "cast(round(o_totalprice * 100) as bigint) as cents", "o_custkey")
    return pin(pairs.join(totals, "id").groupBy("layer_key").agg(
        (F.sum("cents") / (F.count("*") * 50000000e0)).alias("math_score"),
        (F.sum(F.expr("o_custkey % 100")) / (F.count("*") * 100e0)).alias("eq_score")))


def _metric(measured, name):
    return measured.select("layer_key", F.col(name).alias("score"))


def beam_seed(spark, d):
    seeds, _ = _seeded(spark, d)
    return seeds.select("block_spec", "depth", "extra_layers", *_r("math_delta", "eq_delta", "method_score", "relative_overhead", "final_score"))


def _specs(spark, d):
    """Single and double blocks of the orders as specs to re-score, plus the baseline."""
    pairs = fx.block_pairs(spark, d)
    empty = (F.col("i2") == 0) & (F.col("j2") == 0)
    blocks = F.when(empty, F.slice("blocks", 1, 1)).otherwise(F.col("blocks"))
    base = spark.range(1).select(F.array().cast(L.BLOCK_ARRAY).alias("blocks"), F.lit(-1).cast("long").alias("seq"))
    return base.unionByName(pairs.select(blocks.alias("blocks"), F.col("id").alias("seq")))


def beam_rescored(spark, d):
    base = fx.configs(spark).filter("cfg_id = 0").select("layer_key", F.lit(0.5).alias("math_score"), F.lit(0.5).alias("eq_score"))
    measured = _measured(spark, d).filter("size(layer_key) % 5 <> 0 and size(layer_key) > 24")
    entries, _, missing = B.seed_from_specs(_specs(spark, d), pin(base.unionByName(measured)), N, PENALTY)
    done = entries.groupBy("depth").agg(F.count("*").alias("n"), F.sum(F.round("method_score", 6)).alias("method_sum"))
    done = done.select(F.concat(F.lit("depth_"), "depth").alias("part"), "n", F.round("method_sum", 3).alias("method_sum"))
    return done.unionByName(missing.select(F.lit("missing").alias("part")).groupBy("part").agg(
        F.count("*").alias("n"), F.lit(0.0).alias("method_sum")))


def _proposals(spark, d):
    seeds, stats = _seeded(spark, d)
    frontier, pool = B.frontier_of(seeds, 1, 10), B.pool_of(seeds, 30)
    return B.expand(frontier, pool, N, max_extra=30), seeds, stats


def beam_expand(spark, d):
    proposals, seeds, _ = _proposals(spark, d)
    picked = B.select_candidates(proposals, seeds, 200)
    return picked.select("candidate_rank", L.block_spec(F.col("blocks")).alias("block_spec"),
                         F.array_join("layer_key", ",").alias("layers"), *_r("heuristic"))


def beam_missing(spark, d):
    proposals, seeds, _ = _proposals(spark, d)
    picked = B.select_candidates(proposals, seeds, 200)
    return B.unscored(picked, _measured(spark, d)).select("idx", "spec")


def _attached(spark, d):
    proposals, seeds, stats = _proposals(spark, d)
    picked = pin(B.select_candidates(proposals, seeds, 200))
    measured = _measured(spark, d)
    return B.attach_scores(picked, _metric(measured, "math_score"), _metric(measured, "eq_score"), stats, N, PENALTY, 2), seeds


def beam_frontier(spark, d):
    (done, _), _ = _attached(spark, d)
    return B.frontier_of(done, 2, 8).select("parent_rank", "block_spec", *_r("method_score", "final_score"))


def beam_final(spark, d):
    (done, _), seeds = _attached(spark, d)
    out = B.final_ranking(seeds.select(*B.ENTRY_COLUMNS).unionByName(done.select(*B.ENTRY_COLUMNS)), PENALTY, 50)
    return out.select("rank", "block_spec", "depth", "source", *_r("final_score", "method_score"))


def beam_coverage(spark, d):
    expected = fx.block_pairs(spark, d).select(L.expand_blocks(N, F.array(F.col("blocks")[0])).alias("layer_key"))
    singles = fx.configs(spark).filter("(i + j) % 3 <> 0")
    return B.coverage_gap(expected, singles, fx.configs(spark)).select(F.array_join("layer_key", ",").alias("layers"))


def _registry(spark, d):
    """Event log derived from the events table: one spec per user."""
    ev = fx.ev(spark, d)
    events = ev.select(
        F.expr("(user_id % 20) || ',' || (user_id % 20 + 1 + user_id % 3)").alias("block_spec"),
        F.expr("cast(1 + k % 3 as int)").alias("depth"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"),
        F.expr("case k % 4 when 0 then 'planned' when 1 then 'proposed' when 2 then 'evaluated' else 'missing_scores' end").alias("status"),
        F.col("event_type").alias("source"), F.expr("k % 5 <> 0").alias("counted"),
        F.expr("case when k % 4 = 2 then value end").alias("method_score"),
        F.expr("case when k % 4 <> 2 then value end").alias("heuristic"))
    return B.registry(events)


def beam_registry(spark, d):
    return _registry(spark, d).select("block_spec", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"),
                      "depth", "last_status", "source", "proposed_count", "evaluated_count", *_r("best_method_score", "best_heuristic"))


def layer_weights(spark, d):
    """Two weights per layer from the line items: 24 rows."""
    return fx.table(spark, d, "lineitem").groupBy(F.expr("cast(l_partkey % 24 as int)").alias("layer")).agg(
        (F.sum(F.expr("cast(l_quantity as bigint)")) / (F.count("*") * 50e0) - 0.51).alias("wm"),
        (F.sum(F.expr("cast(round(l_discount * 100) as bigint)")) / (F.count("*") * 10e0) - 0.5).alias("wq"))


def additive_scorer(weights):
    """Scores a sequence by the weights of the layers it runs; 24 weight rows are literals.

    Weights are whole 2^-20ths, so that sums are exact in any order.
    """
    rows = {r["layer"]: r for r in weights.collect()}

    def metric(picked, name):
        table = F.create_map(*[F.lit(x) for k, r in rows.items() for x in (k, round(r[name] * 2**20) / 2**20)])
        total = F.aggregate("layer_key", F.lit(0.0), lambda acc, l: acc + table[l])
        return picked.select("layer_key", total.alias("score"))

    return lambda picked: (metric(picked, "wm"), metric(picked, "wq"))


def beam_loop(spark, d):
    """Three depths; the plateau rule is on, with limits that the search reaches only at its end."""
    score = additive_scorer(layer_weights(spark, d))
    keys = fx.configs(spark)
    math, eq = score(keys)
    pairs = pin(keys.join(math.withColumnRenamed("score", "math_score"), "layer_key").join(
        eq.withColumnRenamed("score", "eq_score"), "layer_key").select("i", "j", "math_score", "eq_score"))
    result = B.beam_search(pairs, score, N, scratch_path(spark, "beam"), max_depth=3, seed_top=4, pool_size=8, width=4,
                           max_candidates=24, penalty=PENALTY, rule=B.StopRule(min_improvement=1e9, streak=2, no_replace_streak=3))
    return B.final_ranking(result.entries, PENALTY, 20).select("rank", "block_spec", "depth", *_r("final_score", "method_score"))


def beam_stopped(spark, d):
    """The same search with a plateau limit that ends it after one depth, and why it ended."""
    score = additive_scorer(layer_weights(spark, d))
    keys = fx.configs(spark)
    math, eq = score(keys)
    pairs = pin(keys.join(math.withColumnRenamed("score", "math_score"), "layer_key").join(
        eq.withColumnRenamed("score", "eq_score"), "layer_key").select("i", "j", "math_score", "eq_score"))
    result = B.beam_search(pairs, score, N, scratch_path(spark, "beam"), max_depth=6, seed_top=4, pool_size=8, width=4,
                           max_candidates=24, rule=B.StopRule(max_hours=0.0))
    return result.entries.groupBy("depth").agg(F.count("*").alias("n")).withColumn("stop_reason", F.lit(result.stop_reason))


def beam_status(spark, d):
    """Last states of the events' registry."""
    return B.status_counts(_registry(spark, d))


def beam_resume(spark, d):
    """A search without one metric, then under other seeds, then with that metric alone: as if all had been there at first."""
    pairs, measured, folder = _pairs(spark, d), _measured(spark, d), scratch_path(spark, "beam")
    math, eq = _metric(measured, "math_score"), _metric(measured, "eq_score")

    def searched(seeds, *scores):
        return B.beam_search(seeds, lambda _: scores, N, folder, max_depth=2, seed_top=10, pool_size=30, max_candidates=200,
                             max_extra=30, penalty=PENALTY)

    searched(pairs, math, eq.limit(0))
    searched(pairs.withColumn("eq_score", 1 - F.col("eq_score")), math, eq)
    result = searched(pairs, math.limit(0), eq)
    return B.final_ranking(result.entries, PENALTY, 50).select("rank", "block_spec", "depth", "source", *_r("final_score", "method_score"))


QUERIES = {
    f.__name__: f for f in (
        beam_seed, beam_rescored, beam_expand, beam_missing, beam_frontier, beam_final, beam_coverage, beam_registry, beam_loop,
        beam_stopped, beam_status, beam_resume)
}

SEED_SQL = f"""
 {fx.CONFIGS_SQL}, {fx.SCORES_SQL},
 sc as (select i, j, layer_key, math_score, eq_score_pct * 0.01e0 as eq_score from scores join configs using (cfg_id)),
 bs as (select math_score as bm, eq_score as be from sc where j = 0),
 dl as (select sc.*, math_score - bm as math_delta, eq_score - be as eq_delta from sc, bs),
 st as (select avg(math_delta) as mm, stddev_pop(math_delta) as ms, avg(eq_delta) as em, stddev_pop(eq_delta) as es from dl where j > 0),
 seed as (select i, j, layer_key, math_delta, eq_delta, (math_delta - mm) / ms + (eq_delta - em) / es as method_score, (len(layer_key) - 24) / 24e0 as rel,
   i || ',' || j as block_spec from dl, st),
 ranked as (select *, row_number() over (order by method_score desc, eq_delta desc, math_delta desc, layer_key) as rk from seed where j > 0)
"""
EXPAND_SQL = f"""{SEED_SQL},
 pr as (select f.i as i1, f.j as j1, p.i as i2, p.j as j2, f.rk as fr, p.rk as pk, f.method_score + p.method_score as heuristic, f.layer_key as once
  from ranked f join ranked p on f.rk <= 10 and p.rk <= 30),
 px as (select *, list_concat(once[1 : len(once) - list_position(list_reverse(once), j2 - 1) + 1], range(i2, j2),
   once[len(once) - list_position(list_reverse(once), j2 - 1) + 2 :]) as layer_key from pr),
 pd as (select *, row_number() over (partition by layer_key order by heuristic desc, fr, pk) as rn from px where len(layer_key) - 24 <= 30),
 cand as (select *, row_number() over (order by heuristic desc, fr, pk) as candidate_rank, i1 || ',' || j1 || ';' || i2 || ',' || j2 as block_spec
  from pd where rn = 1 and layer_key not in (select layer_key from seed)),
 pick as (select * from cand where candidate_rank <= 200)
"""
MEASURED_SQL = f"""{fx.BLOCKS_SQL},
 meas as (select layer_key, sum(cast(round(o_totalprice * 100) as bigint)) / (count(*) * 50000000e0) as math_score,
   sum(o_custkey % 100) / (count(*) * 100e0) as eq_score from layered join orders on o_orderkey = id group by 1)"""
DONE_SQL = f"""{EXPAND_SQL}, {MEASURED_SQL},
 done as (select block_spec, layer_key, math_score - bm as math_delta, eq_score - be as eq_delta,
   (math_score - bm - mm) / ms + (eq_score - be - em) / es as method_score, (len(layer_key) - 24) / 24e0 as rel from pick join meas using (layer_key), bs, st)"""

def _next_sql(depth: int, parents: str, width: int) -> str:
    """Candidates (at most 24) of one more depth of the additive search, from the best ``width`` parents."""
    return f"""
 f{depth} as (select block_spec, layer_key, method_score, row_number() over (order by method_score desc, eq_delta desc, math_delta desc, layer_key) as rk from {parents}),
 x{depth} as (select f.block_spec || ';' || p.i || ',' || p.j as block_spec, f.rk as fr, p.rk as pk, f.method_score + p.method_score as heuristic,
   list_concat(f.layer_key[1 : len(f.layer_key) - list_position(list_reverse(f.layer_key), p.j - 1) + 1], range(p.i, p.j),
     f.layer_key[len(f.layer_key) - list_position(list_reverse(f.layer_key), p.j - 1) + 2 :]) as layer_key
   from f{depth} f join ranked p on f.rk <= {width} and p.rk <= 8),
 u{depth} as (select *, row_number() over (partition by layer_key order by heuristic desc, fr, pk) as rn from x{depth}
   where layer_key not in (select layer_key from known{depth - 1})),
 c{depth} as (select *, row_number() over (order by heuristic desc, fr, pk) as cr from u{depth} where rn = 1),
 e{depth} as (select block_spec, {depth} as depth, layer_key, list_sum(list_transform(layer_key, lambda l: wms[l + 1])) - bm as math_delta,
   list_sum(list_transform(layer_key, lambda l: wqs[l + 1])) - be as eq_delta from c{depth}, lists, bs where cr <= 24),
 d{depth} as (select *, (math_delta - mm) / ms + (eq_delta - em) / es as method_score, (len(layer_key) - 24) / 24e0 as rel from e{depth}, st),
 known{depth} as (select layer_key from known{depth - 1} union all select layer_key from d{depth})"""


LOOP_SQL = f"""{fx.CONFIGS_SQL},
 lw as (select cast(l_partkey % 24 as int) as layer, round((sum(cast(l_quantity as bigint)) / (count(*) * 50e0) - 0.51e0) * 1048576) / 1048576 as wm,
   round((sum(cast(round(l_discount * 100) as bigint)) / (count(*) * 10e0) - 0.5e0) * 1048576) / 1048576 as wq from lineitem group by 1),
 lists as (select list(wm order by layer) as wms, list(wq order by layer) as wqs from lw),
 sc as (select i, j, layer_key, list_sum(list_transform(layer_key, lambda l: wms[l + 1])) as m, list_sum(list_transform(layer_key, lambda l: wqs[l + 1])) as q from configs, lists),
 bs as (select m as bm, q as be from sc where j = 0),
 dl as (select sc.*, m - bm as math_delta, q - be as eq_delta from sc, bs),
 st as (select avg(math_delta) as mm, stddev_pop(math_delta) as ms, avg(eq_delta) as em, stddev_pop(eq_delta) as es from dl where j > 0),
 seed as (select i, j, i || ',' || j as block_spec, case when j = 0 then 0 else 1 end as depth, layer_key, math_delta, eq_delta,
   (math_delta - mm) / ms + (eq_delta - em) / es as method_score, (len(layer_key) - 24) / 24e0 as rel from dl, st),
 ranked as (select *, row_number() over (order by method_score desc, eq_delta desc, math_delta desc, layer_key) as rk from seed where j > 0),
 known1 as (select layer_key from seed), {_next_sql(2, "(select * from seed where j > 0)", 4)}"""

ORACLES = {
    "beam_seed": f"""with {SEED_SQL} select block_spec, case when j = 0 then 0 else 1 end as depth, cast(len(layer_key) - 24 as int) as extra_layers,
        round(math_delta, 9) as math_delta, round(eq_delta, 9) as eq_delta, round(method_score, 9) as method_score,
        round(rel, 9) as relative_overhead, round(method_score - 0.5e0 * rel, 9) as final_score from seed""",
    "beam_rescored": f"""with {MEASURED_SQL},
        sp as (select layer_key, case when j2 = 0 then 1 else 2 end as depth, id from layered union all select range(0, 24), 0, -1),
        sco as (select * from meas where len(layer_key) % 5 <> 0 and len(layer_key) > 24 union all select range(0, 24), 0.5e0, 0.5e0),
        hit as (select sp.layer_key, arg_max(depth, id) as depth, any_value(math_score) as m, any_value(eq_score) as q from sp join sco using (layer_key) group by 1),
        dl as (select *, m - 0.5e0 as dm, q - 0.5e0 as dq from hit),
        st as (select avg(dm) as mm, stddev_pop(dm) as ms, avg(dq) as em, stddev_pop(dq) as es from dl where depth > 0)
        select 'depth_' || depth as part, count(*) as n, round(sum(round((dm - mm) / ms + (dq - em) / es, 6)), 3) as method_sum from dl, st group by 1
        union all select 'missing', count(*), 0e0 from sp where layer_key not in (select layer_key from sco)""",
    "beam_expand": f"""with {EXPAND_SQL} select cast(candidate_rank as int) as candidate_rank, block_spec, array_to_string(layer_key, ',') as layers, round(heuristic, 9) as heuristic from pick""",
    "beam_missing": f"""with {EXPAND_SQL}, {MEASURED_SQL} select cast(candidate_rank - 1 as int) as idx, block_spec as spec from pick where layer_key not in (select layer_key from meas)""",
    "beam_frontier": f"""with {DONE_SQL} select cast(row_number() over (order by method_score desc, eq_delta desc, math_delta desc, layer_key) as int) as parent_rank, block_spec,
        round(method_score, 9) as method_score, round(method_score - 0.5e0 * rel, 9) as final_score from done order by 1 limit 8""",
    "beam_final": f"""with {DONE_SQL}, every as (select block_spec, case when j = 0 then 0 else 1 end as depth, 'seed' as source, layer_key, math_delta, eq_delta, method_score, rel from seed
         union all select block_spec, 2, 'beam_eval', layer_key, math_delta, eq_delta, method_score, rel from done)
        select cast(row_number() over (order by method_score - 0.5e0 * rel desc, method_score desc, eq_delta desc, math_delta desc, layer_key) as int) as rank, block_spec, depth, source,
         round(method_score - 0.5e0 * rel, 9) as final_score, round(method_score, 9) as method_score from every order by 1 limit 50""",
    "beam_loop": f"""with {LOOP_SQL}, {_next_sql(3, "d2", 4)}, every as (select block_spec, depth, layer_key, math_delta, eq_delta, method_score, rel from seed
         union all select block_spec, depth, layer_key, math_delta, eq_delta, method_score, rel from d2
         union all select block_spec, depth, layer_key, math_delta, eq_delta, method_score, rel from d3)
        select cast(row_number() over (order by method_score - 0.5e0 * rel desc, method_score desc, eq_delta desc, math_delta desc, layer_key) as int) as rank, block_spec, depth,
         round(method_score - 0.5e0 * rel, 9) as final_score, round(method_score, 9) as method_score from every order by 1 limit 20""",
    "beam_stopped": f"""with {LOOP_SQL} select depth, count(*) as n, 'max_hours_reached_0.00h' as stop_reason
         from (select depth from seed union all select depth from d2) group by 1""",
    "beam_coverage": f"""with {fx.BLOCKS_SQL} select distinct array_to_string(once, ',') as layers from first_block where (i1 + j1) % 3 = 0""",
    "beam_registry": f"""with {fx.EV_SQL}, e as (select (user_id % 20) || ',' || (user_id % 20 + 1 + user_id % 3) as block_spec, cast(1 + k % 3 as int) as depth, ts, event_id as seq, event_type as source, k, value,
         case k % 4 when 0 then 'planned' when 1 then 'proposed' when 2 then 'evaluated' else 'missing_scores' end as status from ev)
        select block_spec, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, arg_max(depth, seq) as depth, arg_max(status, seq) as last_status,
         arg_max(source, seq) as source, count(*) filter (where status in ('planned', 'proposed') and k % 5 <> 0) as proposed_count,
         count(*) filter (where status = 'evaluated' and k % 5 <> 0) as evaluated_count,
         round(max(case when k % 4 = 2 then value end), 9) as best_method_score, round(max(case when k % 4 <> 2 then value end), 9) as best_heuristic from e group by 1""",
}
ORACLES["beam_resume"] = ORACLES["beam_final"]
ORACLES["beam_status"] = f"""with r as ({ORACLES["beam_registry"]}) select last_status, count(*) as n from r group by 1"""

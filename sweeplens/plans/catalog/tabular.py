"""Grouped table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.operators import tabular as T
from sweeplens.plans import fixtures as fx


def row_chunks(spark, d):
    out = T.row_chunks(fx.table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], 4, ["event_id"])
    return out.select("user_id", "chunk", F.array_join(F.transform("items", lambda e: e["event_id"].cast("string")), ",").alias("items"))


def group_median(spark, d):
    out = T.group_median(fx.table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", F.round("median", 6).alias("median"))


def merge_intervals(spark, d):
    return T.merge_intervals(fx.intervals(spark, d), ["user_id"], "start_min", "end_min")


def moving_average(spark, d):
    out = T.moving_average(fx.ev(spark, d).select("user_id", "ts", "event_id", "k"), ["user_id"], ["ts", "event_id"], "k", 5)
    return out.select("user_id", "event_id", "position", F.round("moving_avg", 9).alias("moving_avg"))


def slug_groups(spark, d):
    names = fx.table(spark, d, "part").selectExpr("'  ' || initcap(p_name) || '!! ' || p_brand || ' -- ' || p_type || ' ' as title")
    return T.slug_groups(names, "title")


def latest_version(spark, d):
    rows = fx.table(spark, d, "part").selectExpr(
        "p_brand", "p_size || '.' || (p_partkey % 13) || case when p_partkey % 3 = 0 then '' when p_partkey % 7 = 0 then '.rc' else '.' || (p_partkey % 11) end as version")
    return T.latest_version(rows, ["p_brand"], "version")


BOOLS = """
 select o_orderkey as id, case o_orderkey % 6 when 0 then '  TRUE ' when 1 then chr(10) || 'False' || chr(9) when 2 then 'true'
  when 3 then 'yes' when 4 then 'definitely' else 'fAlSe' end as raw from orders
"""


def bool_standardise(spark, d):
    good, bad = T.standardise_bool(fx.from_body(spark, d, BOOLS, "orders"), "raw")
    good = good.groupBy(F.col("flag").cast("string").alias("flag")).agg(F.count("*").alias("n"))
    return good.unionByName(bad.groupBy(F.lit("rejected").alias("flag")).agg(F.count("*").alias("n")))


QUERIES = {
    f.__name__: f for f in (
        row_chunks, group_median, merge_intervals, moving_average, slug_groups, latest_version, bool_standardise)
}

ORACLES = {
    "row_chunks": """with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from events)
        select user_id, (rn - 1) // 4 as chunk, string_agg(event_id, ',' order by rn) as items from r group by 1, 2""",
    "group_median": "select o_orderpriority, round(median(o_totalprice), 6) as median from orders group by 1",
    "merge_intervals": f"""with {fx.EV_SQL}, i as ({fx.INTERVALS_BODY}),
        g as (select *, case when start_min <= max(end_min) over (partition by user_id order by start_min, end_min, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from i),
        s as (select *, sum(f) over (partition by user_id order by start_min, end_min, event_id rows unbounded preceding) as island from g)
        select user_id, min(start_min) as start_min, max(end_min) as end_min, count(*) as merged from s group by user_id, island""",
    "moving_average": f"""with {fx.EV_SQL}, w as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as position,
         avg(k) over (partition by user_id order by ts, event_id rows between 4 preceding and current row) as a from ev)
        select user_id, event_id, position, round(a, 9) as moving_avg from w where position >= 5""",
    "slug_groups": """select trim(regexp_replace(regexp_replace(lower(replace(p_name || '!! ' || p_brand || ' -- ' || p_type, ' ', '-')), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') as slug, count(*) as n
        from part group by 1""",
    "latest_version": """with v as (select p_brand, [p_size, cast(p_partkey % 13 as int)] || case when p_partkey % 3 = 0 then cast([] as int[]) else [cast(p_partkey % 11 as int)] end as k
         from part where p_partkey % 3 = 0 or p_partkey % 7 <> 0)
        select p_brand, array_to_string(max(k), '.') as latest, count(*) as versions from v group by 1""",
    "bool_standardise": f"""with b as ({BOOLS}) select case id % 6 when 0 then 'true' when 2 then 'true' when 1 then 'false' when 5 then 'false' else 'rejected' end as flag, count(*) as n from b group by 1""",
}

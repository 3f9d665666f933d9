"""Orders, carries and grouped functions, with one group holding most rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweeplens.functions import text as X
from sweeplens.operators import ordering as O
from sweeplens.operators import tabular as T


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(("hot" if rng.random() < 0.7 else f"g{rng.randrange(6)}"), k, rng.randrange(40), rng.randrange(1, 6)) for k in range(900)]
    pdf = pd.DataFrame(rows, columns=["g", "id", "x", "w"])
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def test_global_rank(skewed):
    pdf, df = skewed
    got = {r["id"]: r["rank"] for r in O.global_rank(df, ["x", "id"]).collect()}
    want = pdf.sort_values(["x", "id"])["id"].tolist()
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1])] == want
    assert sorted(got.values()) == list(range(1, len(pdf) + 1))


def test_grouped_rank_spans_partitions(skewed):
    pdf, df = skewed
    got = {r["id"]: r["rank"] for r in O.grouped_rank(df, ["g"], ["x", "id"]).collect()}
    want = pdf.sort_values(["g", "x", "id"]).assign(r=lambda d: d.groupby("g").cumcount() + 1).set_index("id")["r"]
    assert got == want.to_dict()


@pytest.mark.parametrize("q", [0.0, 0.3, 0.5, 0.95, 1.0])
def test_exact_quantile(skewed, q):
    pdf, df = skewed
    got = {r["g"]: r["quantile"] for r in O.exact_quantile(df, "x", q, ["g"]).collect()}
    assert got == {g: pytest.approx(float(np.percentile(v["x"], 100 * q))) for g, v in pdf.groupby("g")}
    assert O.exact_quantile(df, "x", q).first()["quantile"] == pytest.approx(float(np.percentile(pdf["x"], 100 * q)))


def test_merge_intervals(spark, skewed):
    lit = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 10, 12), ("b", 1, 2), ("b", 4, 5)], "g string, s int, e int")
    assert sorted(tuple(r)[:3] for r in T.merge_intervals(lit, ["g"], "s", "e").collect()) == [
        ("a", 1, 5), ("a", 10, 12), ("b", 1, 2), ("b", 4, 5)]
    pdf, df = skewed
    spans = df.select("g", (F.col("id") * 3).alias("s"), (F.col("id") * 3 + F.col("w")).alias("e"))
    want = []
    for g, part in pdf.assign(s=pdf.id * 3, e=pdf.id * 3 + pdf.w).sort_values(["g", "s", "e"]).groupby("g"):
        for s, e in zip(part.s, part.e):
            if want and want[-1][0] == g and s <= want[-1][2]:
                want[-1] = (g, want[-1][1], max(want[-1][2], e))
            else:
                want.append((g, s, e))
    assert sorted(tuple(r)[:3] for r in T.merge_intervals(spans, ["g"], "s", "e").collect()) == sorted(want)


@pytest.mark.parametrize("block", [3, 10, 50_000])
def test_moving_average(spark, skewed, block):
    lit = spark.createDataFrame([("a", k, k + 1) for k in range(4)] + [("b", 0, 1), ("b", 1, 2)], "g string, t int, v int")
    got = [r["moving_avg"] for r in T.moving_average(lit.filter("g = 'a'"), ["g"], ["t"], "v", 2, block).orderBy("t").collect()]
    assert got == [1.5, 2.5, 3.5] and T.moving_average(lit.filter("g = 'b'"), ["g"], ["t"], "v", 3, block).count() == 0
    pdf, df = skewed
    want = pdf.sort_values(["g", "id"]).assign(m=lambda d: d.groupby("g")["x"].transform(lambda s: s.rolling(3).mean())).dropna()
    got = {r["id"]: r["moving_avg"] for r in T.moving_average(df, ["g"], ["id"], "x", 3, block).collect()}
    assert got == {k: pytest.approx(v) for k, v in zip(want.id, want.m)}


def test_row_chunks(spark):
    rows = spark.createDataFrame([("a", k) for k in range(1, 6)], "g string, v int")
    got = [[i["v"] for i in r["items"]] for r in T.row_chunks(rows, ["g"], ["v"], 2, ["v"]).orderBy("chunk").collect()]
    assert got == [[1, 2], [3, 4], [5]]
    with pytest.raises(ValueError):
        T.row_chunks(rows, ["g"], ["v"], 0, ["v"])


def test_median(spark):
    rows = spark.createDataFrame([("e", v) for v in (10, 2, 8, 4)] + [("o", v) for v in (3, 1, 2)], "g string, v int")
    assert {r["g"]: r["median"] for r in T.group_median(rows, ["g"], "v").collect()} == {"e": 6.0, "o": 2.0}


def test_cells(spark, one):
    row = one(a=X.slug(F.lit("  Hello,   World!!  ")), b=X.slug(F.lit("A  B  C")), c=X.parse_bool(F.lit("  TRUE  ")), d=X.parse_bool(F.lit("\nFalse\t")),
              e=X.parse_bool(F.lit("definitely")), t=X.path_stamp(F.lit("runs/20240102_030405/x")), u=X.path_stamp(F.lit("r/20240102_0304/x")),
              v=X.path_stamp(F.lit("r/20240102/x")), w=X.path_stamp(F.lit("r/x")), h=X.eta_text(F.lit(7500.0)), m=X.eta_text(F.lit(90.0)))
    assert row == {"a": "hello-world", "b": "a-b-c", "c": True, "d": False, "e": None, "t": 20240102030405, "u": 202401020304, "v": 20240102, "w": 0, "h": "2h 5m", "m": "1.5m"}
    versions = spark.createDataFrame([("1.2.0",), ("1.10.0",), ("1.3.0",)], "v string")
    assert [r["v"] for r in versions.orderBy(*T.version_order("v")).collect()] == ["1.2.0", "1.3.0", "1.10.0"]


def test_latest_keeps_one_row_per_key(skewed):
    pdf, df = skewed
    got = {r["g"]: r["id"] for r in O.latest(df, ["g"], ["x", "id"]).collect()}
    want = pdf.sort_values(["x", "id"]).groupby("g").tail(1).set_index("g")["id"].to_dict()
    assert got == want


def test_results_do_not_depend_on_partitions(spark, skewed):
    _, df = skewed
    rows = lambda n: sorted(map(tuple, O.grouped_rank(df.repartition(n), ["g"], ["x", "id"]).collect()))
    assert rows(1) == rows(13)

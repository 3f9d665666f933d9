"""Expansion, parsing and count vectors against hand-computed values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators import config_space as C


def blocks(*pairs):
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])


def test_single_block(one):
    row = one(a=L.expand_block(8, F.lit(3), F.lit(6)), b=L.expand_block(4, F.lit(0), F.lit(0)), c=L.expand_block(4, F.lit(3), F.lit(9)))
    assert row["a"] == [0, 1, 2, 3, 4, 5, 3, 4, 5, 6, 7]
    assert row["b"] == [0, 1, 2, 3]
    assert row["c"] is None


def test_block_sequences(one):
    row = one(
        a=L.expand_blocks(8, blocks((3, 6), (4, 6))), b=L.expand_blocks(9, blocks((2, 7))),
        c=L.expand_blocks(9, blocks((2, 7), (2, 7))), d=L.expand_blocks(5, blocks((0, 0), (1, 2), (0, 0))),
        e=L.expand_blocks(5, blocks((1, 2), (4, 9))))
    assert row["a"] == [0, 1, 2, 3, 4, 5, 3, 4, 5, 4, 5, 6, 7]
    assert row["b"] == [0, 1, 2, 3, 4, 5, 6, 2, 3, 4, 5, 6, 7, 8]
    assert len(row["c"]) == 19 and all(row["c"].count(k) == 3 for k in range(2, 7))
    assert row["d"] == [0, 1, 1, 2, 3, 4]
    assert row["e"] is None


def by_hand(n, pairs):
    out = list(range(n))
    for i, j in pairs:
        at = max(k for k, layer in enumerate(out) if layer == j - 1) + 1
        out[at:at] = range(i, j)
    return out


@settings(max_examples=15, deadline=None)
@given(st.integers(2, 9).flatmap(lambda n: st.tuples(st.just(n), st.lists(
    st.tuples(st.integers(0, n - 1), st.integers(1, n)).filter(lambda p: p[0] < p[1]), min_size=1, max_size=4))))
def test_expansion_property(one, case):
    n, pairs = case
    got = one(k=L.expand_blocks(n, blocks(*pairs)))["k"]
    assert got == by_hand(n, pairs)
    assert len(got) == n + sum(j - i for i, j in pairs)


SPECS = [
    ("layers:0,1,3", [0, 1, 3]), (" Layers: 2 , 0 ,", [2, 0]), ("layers:", None), ("layers:9", None), ("layers:0,x", None),
    ("blocks:0,2;1,2", [0, 1, 0, 1, 1, 2, 3]), ("(0, 2)", [0, 1, 0, 1, 2, 3]), ("0,2", [0, 1, 0, 1, 2, 3]),
    ("(0,2);(1,2)", [0, 1, 0, 1, 1, 2, 3]), ("0,0", [0, 1, 2, 3]), ("2,1", None), ("0,1,2", None), ("junk", None), ("", None),
    (" blocks: 1,3 ;; \n", [0, 1, 2, 1, 2, 3]), ("-1,2", None),
]


def test_spec_spellings(spark):
    rows = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(SPECS)], "id int, s string")
    got = {r["id"]: r["k"] for r in rows.select("id", L.parse_spec(4, F.col("s")).alias("k")).collect()}
    assert [got[k] for k in range(len(SPECS))] == [want for _, want in SPECS]


def test_count_vectors(one):
    key = F.array(*[F.lit(k) for k in (0, 1, 2, 1, 2, 3)])
    counts = L.encode_counts(key, 4)
    row = one(
        c=counts, d=L.decode_counts(counts, 4), csv=L.counts_to_csv(counts), back=L.counts_from_csv(F.lit("1, 2,3,1"), 4),
        short=L.counts_from_csv(F.lit("1,2"), 4), bad=L.counts_from_csv(F.lit("1,x,2,3"), 4), over=L.counts_overhead(counts, 4),
        rel=L.relative_overhead(key, 4), dup=L.duplicated_layers(key), out=L.encode_counts(key, 3))
    assert row["c"] == [1, 2, 2, 1] and row["d"] == [0, 1, 1, 2, 2, 3] and row["csv"] == "1,2,2,1"
    assert row["back"] == [1, 2, 3, 1] and row["short"] is None and row["bad"] is None and row["out"] is None
    assert row["over"] == row["rel"] == 0.5
    assert row["dup"] == [{"layer": 1, "times": 2}, {"layer": 2, "times": 2}]


@pytest.mark.parametrize("n, strategic", [(24, 36), (48, 66), (64, 85)])
def test_spaces(spark, n, strategic):
    models = spark.createDataFrame([(1, n)], "model_id int, num_layers int")
    space = C.config_space(models)
    assert space.count() == C.space_size(n) == space.select("idx").distinct().count()
    assert space.filter("idx = 0").first()["j"] == 0
    assert C.strategic_space(models).count() == strategic


def test_queue_source_precedence(spark):
    rows = spark.createDataFrame(
        [(1, [0, 1], [2], [0, 1], "layers:3"), (2, None, [2, 9], [0, 1], "layers:3"), (3, None, None, [0, 1], "layers:3"), (4, None, None, None, "layers:3")],
        "id int, layers array<int>, layer_indices array<int>, key array<int>, spec string")
    got = {r["id"]: (r["source"], r["layer_key"]) for r in C.parse_queue(rows, 4).collect()}
    assert got == {1: ("layers", [0, 1]), 2: ("layer_indices", None), 3: ("legacy_key", [0, 0, 1, 2, 3]), 4: ("spec", [3])}


def test_duplicate_condition_name_fails(spark):
    rows = spark.createDataFrame([("a", 0, 1), ("a", 1, 2)], "name string, i int, j int")
    with pytest.raises(Exception, match="duplicate condition name"):
        C.condition_table(rows, 4).collect()
    names = {r["name"]: r["overhead_fraction"] for r in C.condition_table(rows.select("i", "j"), 4).collect()}
    assert names == {"baseline": 0.0, "block_0_1": 0.25, "block_1_2": 0.25}


def test_strict_validation_fails(spark):
    rows = spark.createDataFrame([([0, 5],)], "layer_key array<int>")
    with pytest.raises(Exception, match="invalid layer list"):
        C.validate(rows, 4, strict=True).collect()


def test_condition_lines(spark):
    rows = spark.createDataFrame([("a = blocks:0,1",), ("noequals",), ("=x",)], "line string")
    got = [(r["name"], r["extra_layers"]) for r in C.parse_conditions(rows, 4).collect()]
    assert ("a", 1) in got and len([g for g in got if g[1] is None]) == 2

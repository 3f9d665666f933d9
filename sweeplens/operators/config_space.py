"""Configuration spaces, slices, pending work and sweeps.

Generators take a table of models (one row per model with its layer count) and
explode each row, so the work spreads over the models and needs no cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.functions import layers as L


def _upto(start: Column, stop: Column) -> Column:
    """start..stop inclusive, empty when stop < start (``sequence`` would count down)."""
    return F.when(start <= stop, F.sequence(start, stop)).otherwise(F.array().cast("array<int>"))


def config_space(models: DataFrame, n: str = "num_layers") -> DataFrame:
    """All blocks ``0 <= i < j <= n`` plus the baseline, indexed by j then i.

    The index has a closed form, so no ordering pass is needed.
    """
    N = F.col(n).cast("int")
    js = models.withColumn("j", F.explode(F.sequence(F.lit(0), N)))
    starts = F.when(F.col("j") == 0, F.array(F.lit(0))).otherwise(_upto(F.lit(0), F.col("j") - 1))
    i, j = F.col("i"), F.col("j")
    return js.withColumn("i", F.explode(starts)).withColumn(
        "idx", F.when(j == 0, 0).otherwise((j * (j - 1) / 2).cast("int") + i + 1)
    )


def space_size(n: int) -> int:
    return n * (n + 1) // 2 + 1


# Fixed values of the strategic subset: window widths with their step, spacing points.
SPACED_WINDOWS = ((3, 5), (8, 8), (12, 12))
MID_WIDTH = 5
SPACING_POINTS = (0, 1, 2, 4, 8, 16, 24, 32, 40, 44)


def strategic_space(models: DataFrame, n: str = "num_layers") -> DataFrame:
    """Strategic subset, each pair once under the first generator that makes it."""
    N = F.col(n).cast("int")

    def windows(starts: Column, width: int) -> Column:
        return F.transform(starts, lambda s: F.struct(s.cast("int").alias("i"), F.least(s + width, N).cast("int").alias("j")))

    def part(num: int, den: int) -> Column:
        return F.floor(N * num / den).cast("int")

    def stepped(step: int) -> Column:
        return F.sequence(F.lit(0), N - 1, F.lit(step))

    mids = F.array(part(1, 5), part(2, 5), part(3, 5), part(5, 6), part(7, 8))
    points = F.array(*[F.lit(p) for p in SPACING_POINTS], N)
    hops = F.filter(
        F.zip_with(F.slice(points, 1, len(SPACING_POINTS)), F.slice(points, 2, len(SPACING_POINTS)),
                   lambda a, b: F.struct(a.alias("i"), F.least(b, N).alias("j"))),
        lambda p: p["i"] < p["j"],
    )
    families = [
        ("baseline", F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))),
        ("early", windows(_upto(F.lit(0), part(1, 4) - 1), 1)),
        ("middle", windows(_upto(part(3, 8), part(5, 8) - 1), 1)),
        ("late", windows(_upto(part(3, 4), N - 1), 1)),
        ("span3", windows(stepped(5), 3)),
        ("span5", windows(mids, MID_WIDTH)),
        ("span8", windows(stepped(8), 8)),
        ("span12", windows(stepped(12), 12)),
        ("spacing", hops),
    ]

    def tag(family: str, pairs: Column) -> Column:
        return F.transform(pairs.cast(L.BLOCK_ARRAY), lambda p: F.struct(
            F.lit(family).alias("family"), p["i"].alias("i"), p["j"].alias("j")))

    tagged = F.concat(*[tag(family, pairs) for family, pairs in families])
    # One model has at most a few pairs per layer: dedupe and number inside its row.
    def first_seen(acc: Column, e: Column) -> Column:
        known = F.exists(acc, lambda a: (a["i"] == e["i"]) & (a["j"] == e["j"]))
        return F.when(known, acc).otherwise(F.concat(acc, F.array(e)))

    empty = F.slice(tagged, 1, 0)
    kept = F.aggregate(tagged, empty, first_seen)
    return models.select("*", F.posexplode(kept).alias("idx", "_e")).select(
        *models.columns, "idx", F.col("_e.family").alias("family"), F.col("_e.i").alias("i"), F.col("_e.j").alias("j")
    )


def filter_span(configs: DataFrame, min_span: int | None = None, max_span: int | None = None,
                exclude_baseline: bool = False) -> DataFrame:
    """Bound ``j - i``; the baseline has no span and only ``exclude_baseline`` drops it."""
    base = (F.col("i") == 0) & (F.col("j") == 0)
    span = F.col("j") - F.col("i")
    ok = F.lit(True)
    if min_span is not None:
        ok = ok & (span >= min_span)
    if max_span is not None:
        ok = ok & (span <= max_span)
    return configs.filter(F.when(base, F.lit(not exclude_baseline)).otherwise(ok))


def slice_index(configs: DataFrame, start: int = 0, end: int | None = None, index: str = "idx") -> DataFrame:
    keep = F.col(index) >= start
    return configs.filter(keep if end is None else keep & (F.col(index) < end))


def with_layers(configs: DataFrame, n: str = "num_layers") -> DataFrame:
    layers = L.expand_block(F.col(n), F.col("i"), F.col("j"))
    return configs.withColumn("layer_key", layers).withColumn("spec", L.layer_spec(F.col("layer_key")))


def split_rejects(df: DataFrame, parsed: str = "layer_key") -> tuple[DataFrame, DataFrame]:
    """Usable rows and rejected rows, so nothing is dropped unseen."""
    return df.filter(F.col(parsed).isNotNull()), df.filter(F.col(parsed).isNull())


def validate(df: DataFrame, n: str | int, layers: str = "layer_key", strict: bool = False) -> DataFrame:
    """Flag rows with an unusable layer list; ``strict`` fails the job instead."""
    ok = L.layers_are_valid(L.as_col(n), F.col(layers))
    if strict:
        text = F.concat(F.lit("invalid layer list: "), F.coalesce(F.array_join(layers, ","), F.lit("NULL")))
        return df.withColumn("is_valid", F.when(ok, ok).otherwise(F.raise_error(text).cast("boolean")))
    return df.withColumn("is_valid", ok)


def pending(configs: DataFrame, *results: DataFrame, keys: tuple[str, ...] = ("layer_key",)) -> DataFrame:
    """Configurations without a result in any table (anti join on the canonical key)."""
    done = None
    for table in results:
        part = table.select(*keys).filter(F.col(keys[-1]).isNotNull())
        done = part if done is None else done.unionByName(part)
    # dropDuplicates combines map-side: a key repeated a billion times ships once per task.
    return configs.join(done.dropDuplicates(), list(keys), "left_anti")


def parse_queue(entries: DataFrame, n: str | int) -> DataFrame:
    """Queue entries to layers with source precedence layers > layer_indices > key > spec.

    The first field that is present decides, even when its value is unusable.
    """
    N = L.as_col(n)
    have = set(entries.columns)

    def field(name: str, kind: str) -> Column:
        return F.col(name) if name in have else L.null_of(kind)

    key = field("key", "array<int>")
    pair = F.when(F.size(key) == 2, L.expand_block(N, F.get(key, F.lit(0)), F.get(key, F.lit(1))))
    options = [
        ("layers", field("layers", L.INT_ARRAY), field("layers", L.INT_ARRAY)),
        ("layer_indices", field("layer_indices", L.INT_ARRAY), field("layer_indices", L.INT_ARRAY)),
        ("legacy_key", key, pair),
        ("spec", field("spec", "string"), L.parse_spec(N, field("spec", "string"))),
    ]
    source, layers = F.when(options[0][1].isNotNull(), options[0][0]), F.when(options[0][1].isNotNull(), options[0][2])
    for label, present, value in options[1:]:
        source, layers = source.when(present.isNotNull(), label), layers.when(present.isNotNull(), value)
    parsed = entries.withColumn("source", source).withColumn("layer_key", L.valid_or_null(N, layers))
    given = F.nullif(field("spec", "string"), F.lit(""))
    return parsed.withColumn("entry_spec", F.coalesce(given, L.layer_spec(F.col("layer_key"))))


def repeat_sweep(models: DataFrame, max_extra: int = 8, n: str = "num_layers", base: str | None = None) -> DataFrame:
    """Baseline plus every present layer repeated 1..``max_extra`` extra times.

    ``total_occurrences`` is recounted from the sequence, so duplicates already
    in the base are included.
    """
    N = F.col(n).cast("int")
    start = F.col(base) if base else L.baseline_layers(N)
    present = F.filter(L.baseline_layers(N), lambda l: F.array_contains(start, l))
    none = F.struct(L.null_of("int").alias("layer"), F.lit(0).alias("extra_repeats"))
    runs = F.flatten(F.transform(present, lambda l: F.transform(
        F.sequence(F.lit(1), F.lit(max_extra)), lambda e: F.struct(l.alias("layer"), e.alias("extra_repeats")))))
    rows = models.withColumn("_base", start).select(
        "*", F.posexplode(F.concat(F.array(none), runs)).alias("idx", "_r")
    ).select(*models.columns, "_base", "idx", "_r.*")
    layer, extra = F.col("layer"), F.col("extra_repeats")
    seq = F.when(layer.isNull(), F.col("_base")).otherwise(
        L.insert_after_last(F.col("_base"), layer, F.array_repeat(layer, extra)))
    named = F.when(layer.isNull(), "baseline").otherwise(F.format_string("layer%02d_x%d", layer, extra + 1))
    times = F.when(layer.isNull(), 1).otherwise(F.size(F.filter("layer_key", lambda x: x == layer)))
    return (
        rows.withColumn("layer_key", seq).withColumn("name", named)
        .withColumn("total_occurrences", times)
        .withColumn("layer_indices_key", F.array_join("layer_key", ","))
        .drop("_base")
    )


def duplication_counts(df: DataFrame, keys: list[str], layers: str = "layer_key") -> DataFrame:
    """One row per configuration and layer that runs more than once."""
    return df.select(*keys, F.inline(L.duplicated_layers(F.col(layers))))


def condition_table(blocks: DataFrame, n: int, base_name: str = "baseline", prefix: str = "block",
                    model_id: str | None = None, strict: bool = True) -> DataFrame:
    """Baseline plus one condition per block; a repeated name is an error.

    ``blocks`` has ``i`` and ``j`` and optionally ``name``.
    """
    spark = blocks.sparkSession
    given = F.col("name") if "name" in blocks.columns else F.concat_ws("_", F.lit(prefix), F.col("i"), F.col("j"))
    base = spark.range(1).select(F.lit(base_name).alias("name"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    rows = base.unionByName(blocks.select(given.alias("name"), F.col("i").cast("int"), F.col("j").cast("int")))
    layers = F.col("layer_key")
    out = rows.withColumn("layer_key", L.expand_block(n, F.col("i"), F.col("j"))).filter(layers.isNotNull())
    if strict:
        out = unique_or_fail(out, "name", "duplicate condition name: ")
    out = out.select(
        "name", "i", "j", "layer_key", L.layer_spec(layers).alias("layer_spec"),
        L.extra_layers(layers, n).alias("extra_layers"), L.relative_overhead(layers, n).alias("overhead_fraction"),
    )
    return out if model_id is None else out.withColumn("model_id", F.lit(model_id))


def unique_or_fail(df: DataFrame, key: str, message: str) -> DataFrame:
    """Pass rows through, failing at run time when ``key`` repeats."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit(message), F.col(key).cast("string"))).cast("string"))
    return one.select(checked.alias(key), "_row.*").select(*df.columns)


def parse_conditions(lines: DataFrame, n: int, text: str = "line") -> DataFrame:
    """``NAME=SPEC`` lines to conditions with layers and overhead."""
    name = L.squeeze(F.regexp_extract(text, r"(?s)^([^=]*)=(.*)$", 1))
    spec = L.squeeze(F.regexp_extract(text, r"(?s)^([^=]*)=(.*)$", 2))
    rows = lines.select(F.nullif(name, F.lit("")).alias("name"), F.nullif(spec, F.lit("")).alias("spec"))
    rows = rows.withColumn("layer_key", F.when(F.col("name").isNotNull(), L.parse_spec(n, F.col("spec"))))
    return rows.withColumn("extra_layers", L.extra_layers(F.col("layer_key"), n)).withColumn(
        "overhead_fraction", L.relative_overhead(F.col("layer_key"), n))


def indexed(configs: DataFrame, order: list[str], per: list[str]) -> DataFrame:
    """Zero-based index inside bounded groups (one model's configuration list)."""
    w = Window.partitionBy(*per).orderBy(*order)
    return configs.withColumn("idx", F.row_number().over(w) - 1)

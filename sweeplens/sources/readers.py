"""Tolerant readers with explicit schemas.

``docs=True`` reads files that are one JSON document each; ``docs=False`` reads
one document per line, which splits over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplens import schemas
from sweeplens.functions import layers as L
from sweeplens.functions.answers import reference_values
from sweeplens.functions.text import lines_of


def variants(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """Documents as VARIANT ``doc`` with their file; text that is no JSON becomes NULL."""
    return spark.read.text(path, wholetext=docs).select(
        F.try_parse_json("value").alias("doc"), F.col("_metadata.file_path").alias("file"))


def _json(spark: SparkSession, path: str, schema: str, docs: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", docs).json(path)


def _listed(spark: SparkSession, path: str, fields: str, wrapper: str, docs: bool) -> DataFrame:
    """Rows given one by one, as a JSON array, or inside ``{wrapper: [...]}``."""
    raw = _json(spark, path, f"{fields}, {wrapper} array<{schemas.as_struct(fields)}>", docs)
    single = F.array(F.struct(*[c for c in raw.columns if c != wrapper]))
    return raw.select(F.inline(F.coalesce(F.col(wrapper), single)))


def score_rows(spark: SparkSession, path: str, fmt: str = "parquet", order: str = "seq") -> DataFrame:
    """Score table as rows ``raw_key``, ``payload``, ``seq``; payload text becomes VARIANT.

    Tables without an arrival number are refused: the last row of a key wins,
    and file order is no clock.
    """
    raw = spark.read.format(fmt).load(path)
    if order not in raw.columns:
        raise ValueError(f"score table at {path} has no '{order}' column")
    kind = dict(raw.dtypes)["payload"]
    payload = F.col("payload") if kind == "variant" else F.try_parse_json(F.col("payload").cast("string"))
    return raw.select("raw_key", payload.alias("payload"), F.col(order).alias("seq"))


def score_map(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """``{key: payload}`` documents to score rows in textual order.

    ``seq`` orders rows as they stand: by file time, file, document and place of
    the key.  A key given twice in one document keeps its first place and its
    last payload.
    """
    text = spark.read.text(path, wholetext=docs)
    meta = F.col("_metadata")
    document = F.struct(meta["file_modification_time"].alias("time"), meta["file_path"].alias("file"),
                        meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    members = F.posexplode(F.map_entries(F.from_json("value", "map<string, variant>")))
    items = text.select("value", document.alias("document")).select("document", members.alias("place", "m"))
    items = items.select("document", "place", F.col("m.key").alias("raw_key"), F.col("m.value").alias("payload"))
    one = items.groupBy("document", "raw_key").agg(F.max_by("payload", "place").alias("payload"), F.min("place").alias("place"))
    return one.select("raw_key", "payload", F.struct("document.*", "place").alias("seq"))


def _records(spark: SparkSession, path: str, docs: bool | None) -> DataFrame:
    docs = not path.endswith(".jsonl") if docs is None else docs
    return _listed(spark, path, schemas.RUN_RECORD, "runs", docs)


def run_records(spark: SparkSession, path: str, docs: bool | None = None) -> DataFrame:
    """Run records from JSON lines, a JSON array or ``{"runs": [...]}``; those without a task go to the rejects."""
    rows = _records(spark, path, docs).filter("task_id is not null")
    return rows.withColumn("extra_layers", F.coalesce("extra_layers", F.lit(0))).withColumn(
        "overhead_fraction", F.coalesce("overhead_fraction", F.lit(0.0)))


def run_record_rejects(spark: SparkSession, path: str, docs: bool | None = None) -> DataFrame:
    """What ``run_records`` leaves out: the record's readable fields as JSON, and why."""
    rows = _records(spark, path, docs).filter("task_id is null")
    return rows.select(F.to_json(F.struct("*")).alias("record"), F.lit("no task_id").alias("reason"))


def _condition_entries(spark: SparkSession, path: str, docs: bool) -> DataFrame:
    inner = F.coalesce(F.try_variant_get("doc", "$.conditions", "variant"), F.col("doc"))
    items = variants(spark, path, docs).select(inner.alias("_c")).lateralJoin(
        spark.tvf.variant_explode(F.col("_c").outer()))
    own_name = F.try_variant_get("value", "$.name", "string")
    return items.select(F.coalesce(own_name, F.col("key")).alias("condition"), F.col("value").alias("body"))


def conditions(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """Condition manifests in any of three shapes: name, attributes, full body.

    A list under ``conditions``, a map under ``conditions`` or at top level, or
    a bare list.  Entries that are no objects become ``{"value": entry}``; those
    without a name go to the rejects.
    """
    return _condition_entries(spark, path, docs).filter("condition is not null").select(
        "condition", "body",
        F.coalesce(F.try_variant_get("body", "$.extra_layers", "int"), F.lit(0)).alias("extra_layers"),
        F.coalesce(F.try_variant_get("body", "$.overhead_fraction", "double"), F.lit(0.0)).alias("overhead_fraction"))


def condition_rejects(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """What ``conditions`` leaves out: entries without a name."""
    return _condition_entries(spark, path, docs).filter("condition is null").select(
        F.to_json("body").alias("record"), F.lit("no name").alias("reason"))


def routes(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """Route documents, bare or under ``routes``, as (condition, route VARIANT)."""
    inner = F.coalesce(F.try_variant_get("doc", "$.routes", "variant"), F.col("doc"))
    items = variants(spark, path, docs).select(inner.alias("_r")).lateralJoin(spark.tvf.variant_explode(F.col("_r").outer()))
    return items.filter("key is not null").select(F.col("key").alias("condition"), F.col("value").alias("route"))


def probe_set(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """``{qid: record}`` documents to one row per question.

    Emotion records take ``reference_answer``, else the full-scale one, else
    neutral values.
    """
    text = spark.read.text(path, wholetext=docs)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{schemas.PROBE}>>")).alias("qid", "r"))
    reference = reference_values(F.coalesce("r.reference_answer", "r.reference_answer_fullscale"))
    return rows.select(
        "qid", F.col("r.question").alias("question"), F.col("r.answer").alias("answer"), F.col("r.prompt").alias("prompt"),
        F.when(F.col("r.prompt").isNotNull(), reference).alias("reference"))


def localization_examples(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """Ranking examples from an array or ``{"examples": [...]}``; required fields are checked."""
    rows = _listed(spark, path, schemas.EXAMPLE, "examples", docs)
    required = ("issue_id", "bug_report", "candidate_files", "ground_truth")
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    checked = F.when(complete, F.col("issue_id")).otherwise(
        F.raise_error(F.lit(f"ranking example without one of {', '.join(required)}")).cast("string"))
    return rows.withColumn("issue_id", checked).withColumn("repo", F.coalesce("repo", F.lit(""))).withColumn(
        "base_commit", F.coalesce("base_commit", F.lit("")))


def config_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """One spec per line with its line number; blanks and ``#`` lines are skipped.

    Each file is read as one row, so line numbers are exact.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.posexplode(lines_of(F.col("value"))).alias("_k", "_raw"))
    line = L.squeeze(F.col("_raw"))
    rows = lines.select("file", (F.col("_k") + 1).alias("source_line"), line.alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("layer_key", L.parse_spec(n, F.col("line"))).withColumn("block", L.parse_pair(F.col("line")))
    return rows.withColumn("spec", F.when(F.col("line").contains(":"), F.col("line")).otherwise(L.layer_spec(F.col("layer_key"))))


def candidates(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Candidate CSV with ``counts_csv`` or one column per layer; overhead optional."""
    raw = spark.read.option("header", True).csv(path)
    have = set(raw.columns)
    columns = [f"c{k}" for k in range(n)]
    split = F.array(*[F.col(c).try_cast("int") for c in columns]) if set(columns) <= have else L.null_of(L.INT_ARRAY)
    packed = L.counts_from_csv(F.col("counts_csv"), n) if "counts_csv" in have else L.null_of(L.INT_ARRAY)
    if "counts_csv" not in have and not set(columns) <= have:
        raise ValueError("candidate files need counts_csv or one column per layer")

    def text(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), default) if name in have else default

    out = raw.withColumn("_counts", F.coalesce(packed, split))
    total = F.aggregate("_counts", F.lit(0), lambda a, x: a + x)
    none = L.null_of("string")
    return out.select(
        text("candidate_id", none).alias("candidate_id"), text("source", F.lit("")).alias("source"), F.col("_counts").alias("counts"),
        (total - n).alias("extra_layers"),
        F.coalesce(text("relative_overhead", none).try_cast("double"), (total - n) / n).alias("relative_overhead"),
        L.counts_to_csv(F.col("_counts")).alias("counts_csv"))


def manifest(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """Task manifest rows in order; a document without a required field fails."""
    raw = _json(spark, path, schemas.MANIFEST, docs)
    ok = F.col("dataset_name").isNotNull() & F.col("split").isNotNull() & F.col("instance_ids").isNotNull()
    ids = F.when(ok, F.col("instance_ids")).otherwise(
        F.raise_error(F.lit("manifest without dataset_name, split or instance_ids")).cast("array<string>"))
    return raw.select("dataset_name", "split", F.posexplode(ids).alias("position", "instance_id"))


def _folder(depth: int) -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -depth)


def evaluation_reports(spark: SparkSession, path: str, condition_depth: int = 3, docs: bool = True) -> DataFrame:
    """Reports with five id lists; the condition is a folder of the file path."""
    return spark.read.schema(schemas.REPORT).option("multiLine", docs).json(path).select(
        _folder(condition_depth).alias("condition"), "*")


def trajectories(spark: SparkSession, path: str, docs: bool = True) -> DataFrame:
    """Run documents with the instance id from the file name."""
    doc = spark.read.text(path, wholetext=docs)
    name = F.regexp_replace(_folder(1), r"\.traj(\.json)?$|\.json$", "")
    return doc.select(name.alias("instance_id"), F.try_parse_json("value").alias("doc"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)

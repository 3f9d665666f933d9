"""Writers: appends, versioned upserts, reports and worker configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplens.operators.ordering import latest
from sweeplens.session import pin

# Column order of the published reports.
SUMMARY_COLUMNS = [
    "condition", "tasks", "successes", "success_rate", "avg_steps", "avg_execution_errors", "avg_runtime_seconds",
    "avg_extra_layers", "avg_overhead_fraction",
]
TOP_COLUMNS = [
    "config", "relayer", "method", "method_score", "math_score", "eq_score", "math_delta", "eq_delta", "rank",
]
CONFIG_HEADER = ["# Surrogate-selected layer configurations", "# Format: i,j;... or layers:a,b,c,..."]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, columns: list[str], json_path: str, csv_path: str) -> None:
    """One table as JSON and as CSV with a fixed column order.

    Reports have a row per condition or per top-k entry, so one file each.
    """
    rows = pin(df.select(*columns).coalesce(1))
    rows.write.mode("overwrite").json(json_path)
    flat = [F.concat(F.lit("("), F.array_join(c, ", "), F.lit(")")).alias(c) if t.startswith("array") else F.col(c)
            for c, t in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(csv_path)


def write_summary(summary: DataFrame, json_path: str, csv_path: str) -> None:
    write_report(summary.orderBy("condition"), SUMMARY_COLUMNS, json_path, csv_path)


def write_top(top: DataFrame, json_path: str, csv_path: str) -> None:
    """Ranked rows of a balanced analysis."""
    named = top.withColumn("config", F.col("layer_key")).withColumn("method_score", F.col("balanced_score"))
    write_report(named.orderBy("rank"), TOP_COLUMNS, json_path, csv_path)


def write_config(rows: DataFrame, config_path: str, manifest_path: str, meta: dict | None = None) -> None:
    """Worker config lines and the manifest of a top-k selection (rank order)."""
    rows = pin(rows)
    ordered = rows.orderBy("rank")
    header = rows.sparkSession.createDataFrame([(k - len(CONFIG_HEADER), h) for k, h in enumerate(CONFIG_HEADER)], "rank int, config_line string")
    lines = header.unionByName(rows.select(F.col("rank").cast("int").alias("rank"), "config_line"))
    lines.orderBy("rank").select("config_line").coalesce(1).write.mode("overwrite").text(config_path)
    for name, value in (meta or {}).items():
        ordered = ordered.withColumn(name, F.lit(value))
    ordered.coalesce(1).write.mode("overwrite").json(manifest_path)


# --- versioned tables ------------------------------------------------------

def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions below ``path``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1]}") if versions else None


def upsert(new: DataFrame, path: str, keys: list[str], seq: str = "seq") -> DataFrame:
    """Merge rows by key, highest ``seq`` wins, into a new version folder.

    Readers only see finished versions, so a failed write changes nothing.
    """
    spark = new.sparkSession
    versions = _versions(spark, path)
    old = read_current(spark, path)
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    target = f"{path}/version={versions[-1] + 1 if versions else 0}"
    latest(rows, keys, [seq]).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def append_results(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per batch id, overwritten on a replay: each batch counts once."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def latest_results(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """Current row per key over all appended batches."""
    return latest(spark.read.parquet(path).drop("batch"), keys, order)

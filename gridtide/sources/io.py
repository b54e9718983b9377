"""Scans, sinks, inventories and contracts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_with_provenance(spark: SparkSession, path: str, month_pattern: str = r"(\d{4}-\d{2})", from_folder: bool = False) -> DataFrame:
    """Parquet files under a glob, with source_file (name) and source_month (from the name, or from the folder's; empty if it has none)."""
    part = lambda k: F.element_at(F.split(F.col("_metadata.file_path"), "/"), k)
    rows = spark.read.parquet(path)
    return rows.select("*", part(-1).alias("source_file"), F.regexp_extract(part(-2 if from_folder else -1), month_pattern, 1).alias("source_month"))


def read_lookup_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_runs_json(spark: SparkSession, path: str, schema: StructType | str, run_pattern: str = r"run=([0-9T:-]+)", time_format: str = "yyyy-MM-dd'T'HH-mm") -> DataFrame:
    """Multi-line JSON with a fixed schema; run_utc is parsed from the path's run= token, null if it can't be."""
    token = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), run_pattern, 1), ":", "-")
    return spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.try_to_timestamp(token, F.lit(time_format)).alias("run_utc"))


def read_partitions(spark: SparkSession, root: str, predicate: Column) -> DataFrame:
    """A partitioned table; a predicate on partition columns prunes directories before any file is opened."""
    return spark.read.parquet(root).filter(predicate)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite a partitioned table. REBALANCE splits large partitions and merges small ones, so one value's rows may use many tasks."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int, sort: list[str]) -> DataFrame:
    """Store df in buckets of one column, sorted within, and read it back: joins, groups and windows by that column, or by it and others, need no exchange between tables with as many buckets.

    The table is in the session's catalog under a name of its own; its files are in ``path``. Rows are dealt to buckets before they are written, so a bucket is one file. Sessions use the
    buckets for joins by more columns only where they don't ask for all of them, which is set here.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by, *sort).option("path", path).saveAsTable(name)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(name)


def partition_files(lines: DataFrame, path: str, by: list[str]) -> None:
    """Lines (value) as text, one folder for each value of ``by``."""
    lines.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).text(path)


def write_sorted(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite with rows in order: ranges of the keys by file, sorted within."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def order_audit(stored: DataFrame, key: str, time: str) -> DataFrame:
    """By key: rows, first and last time, and rows whose time is not after that of the row before in the same file."""
    place = stored.select(key, time, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    before = F.lag(time).over(Window.partitionBy("file", key).orderBy("row"))
    checked = place.withColumn("unordered", F.coalesce(F.col(time) <= before, F.lit(False)))
    return checked.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(time).alias("first_utc"), F.max(time).alias("last_utc"), F.count_if("unordered").cast("int").alias("n_unordered"))


def write_runs_json(runs: DataFrame, path: str, time_format: str = "yyyy-MM-dd'T'HH-mm") -> None:
    """Nested runs as JSON, one folder run=<time> and one array of points for each run."""
    points = F.to_json(F.collect_list(F.struct(*[c for c in runs.columns if c != "run_utc"]))).alias("value")
    runs.groupBy(F.date_format("run_utc", time_format).alias("run")).agg(points).write.mode("overwrite").partitionBy("run").text(path)


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """A stage's boundary: what follows uses the stored copy."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """A stage's report: (stage, metric, dims, value) rows as JSON."""
    metrics.write.mode("overwrite").json(path)


def report(stage: str, df: DataFrame, dims: list[str] | None = None) -> DataFrame:
    """Every column of a small frame of figures as a row: stage, metric, dims, value."""
    dims = dims or []
    label = F.concat_ws(",", *[F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit(""))) for d in dims])
    values = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in dims]
    return df.select(F.lit(stage).alias("stage"), label.alias("dims"), F.explode(F.array(*values)).alias("v")).select("stage", "v.metric", "dims", "v.value")


def file_inventory(spark: SparkSession, path: str, checksum: bool = False) -> DataFrame:
    """path, bytes (and sha256) of files; contents are read only for checksums."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = [F.col("path"), F.col("length").alias("bytes")]
    return files.select(*columns, *([F.sha2("content", 256).alias("sha256")] if checksum else []))


def inventory_totals(inventory: DataFrame) -> DataFrame:
    """By folder: files, bytes, and files without a checksum."""
    folder = F.element_at(F.split("path", "/"), -2)
    return inventory.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("sha256").isNull() | (F.length("sha256") != 64)).alias("n_without_checksum"))


def check_inventory(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """manifest rows (name, bytes, sha256) with problem: missing, size, checksum or null."""
    found = inventory.select("name", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    problem = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("found_bytes") != F.col("bytes"), "size").when(F.col("found_sha256") != F.col("sha256"), "checksum")
    return manifest.join(found, "name", "left").withColumn("problem", problem)


def still_missing(plan: DataFrame, inventory: DataFrame, keys: list[str]) -> DataFrame:
    """Planned objects that the inventory lacks."""
    return plan.join(inventory, keys, "left_anti")


def file_contract(df: DataFrame, file: str, time: str, start: Column, end: Column) -> DataFrame:
    """Per file: rows, first and last time, and whether they overlap [start, end)."""
    per = df.groupBy(file).agg(F.count("*").alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"))
    return per.withColumn("valid", (F.col("n_rows") > 0) & F.coalesce((F.col("first") < end) & (F.col("last") >= start), F.lit(False)))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """df, if it has the required columns."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def reference_contract(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Rows, distinct and null keys of a reference table, and whether it is not empty and its keys are unique; required columns are checked first."""
    figures = require_columns(df, required).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.count_if(F.col(key).isNull()).alias("n_null"))
    return figures.withColumn("valid", (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_keys")))


def export_schema(df: DataFrame, path: str) -> DataFrame:
    """Write the schema as JSON lines (column, position, type, nullable) and read them back."""
    rows = [(x.name, n, x.dataType.json(), x.nullable) for n, x in enumerate(df.schema.fields)]
    kind = "column string, position long, type string, nullable boolean"
    df.sparkSession.createDataFrame(rows, kind).coalesce(1).write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(kind).json(path)


def schema_json(df: DataFrame) -> dict:
    return df.schema.jsonValue()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), or a temporary one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-gridtide-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/gridtide-{uuid.uuid4().hex}/{name}"

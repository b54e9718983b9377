"""Shards by size-tiered compaction, with DataFrame functions only.

A store is a folder: ``runs/`` holds immutable runs (each a folder of Parquet shards), ``manifests/``
holds one table for each version, and ``versions/`` holds one small file for each committed version that names its manifest.
Arrivals are appended as small shards, all those of one call in one version. When FANOUT runs are of similar size, they are merged into one run of
target-sized files; merging joins whole input partitions, so no row is shuffled.

A version is committed by moving a finished file to its name, which fails if the name is taken; so readers see a
version whole or not at all, and a writer that dies leaves only files that no version names. A writer builds on the version it read and
commits the number after it; where another was first, it reads the new version and builds on that. Older versions stay readable.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FANOUT = 4
#: Runs are similar if each is at most so many times their mean, and at least the inverse.
SIMILAR = 2.0
TARGET_BYTES = 128 << 20
MANIFEST = "run string, sequence long, level int, shard string, bytes long"


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class Run:
    run: str
    sequence: int
    level: int
    bytes: int
    shards: int


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at, _ = _file_system(spark, f"{root}/versions")
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(x) for x in names if x.isdigit())


def last_version(spark: SparkSession, root: str) -> int:
    """0 where nothing is committed yet."""
    return max(versions(spark, root), default=0)


def _manifest_name(spark: SparkSession, root: str, version: int) -> str:
    return spark.read.text(f"{root}/versions/{version:08d}").first()[0]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """run, sequence, level, shard, bytes: the shards of a version, by default the last."""
    version = last_version(spark, root) if version is None else version
    if not version:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{_manifest_name(spark, root, version)}")


def runs(shards: DataFrame) -> list[Run]:
    """One row for each run; runs stay few, as similar ones are merged."""
    per = shards.groupBy("run", "sequence", "level").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("shards"))
    return [Run(*row) for row in per.select("run", "sequence", "level", "bytes", "shards").orderBy("sequence", "run").collect()]


def _move_if_free(spark: SparkSession, source: str, target: str) -> None:
    """Give a finished file its name, at once, unless the name is taken: CommitConflict then, other errors as they are."""
    fs, at, jvm = _file_system(spark, target)
    fs.mkdirs(at.getParent())
    try:
        if fs.getUri().getScheme() == "file":  # a local move would replace the target; a second link to the file does not
            jvm.java.nio.file.Files.createLink(jvm.java.io.File(at.toUri().getPath()).toPath(), jvm.java.io.File(jvm.org.apache.hadoop.fs.Path(source).toUri().getPath()).toPath())
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(source), at, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            raise CommitConflict(f"{target} exists") from error
        raise


def commit(spark: SparkSession, root: str, shards: DataFrame, version: int, batch: str | None = None) -> int:
    """Write the manifest and the version's file under new names, then give the file the version's name, which only one writer can.

    Before that, a ``batch`` notes the version and manifest that it is to be in; it is in the store if that version names that manifest.
    """
    name = uuid.uuid4().hex
    if batch is not None:
        fs, at, _ = _file_system(spark, f"{_batch_folder(root, batch)}/{version:08d}-{name}")
        fs.create(at, False).close()
    shards.select("run", "sequence", "level", "shard", "bytes").coalesce(1).write.parquet(f"{root}/manifests/{name}")
    source = f"{root}/manifests/{name}.version"
    fs, at, _ = _file_system(spark, source)
    out = fs.create(at, False)
    try:
        out.writeBytes(name)
    finally:
        out.close()
    _move_if_free(spark, source, f"{root}/versions/{version:08d}")
    fs.delete(at, False)
    return version


def _batch_folder(root: str, batch: str) -> str:
    return f"{root}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"


def batch_version(spark: SparkSession, root: str, batch: str) -> int | None:
    """The version that brought a batch, if one has."""
    fs, at, _ = _file_system(spark, _batch_folder(root, batch))
    known = set(versions(spark, root))
    for x in fs.listStatus(at) if fs.exists(at) else ():
        version, _, name = x.getPath().getName().partition("-")
        if int(version) in known and _manifest_name(spark, root, int(version)) == name:
            return int(version)
    return None


def _build_on_last(spark: SparkSession, root: str, change: Callable[[DataFrame, int], DataFrame | None], batch: str | None = None) -> int | None:
    """Commit what ``change`` makes of the last version's shards for the next number; begin anew where another writer was first."""
    while True:
        seen = last_version(spark, root)
        shards = change(manifest(spark, root, seen), seen + 1)
        if shards is None:
            return None
        try:
            return commit(spark, root, shards, seen + 1, *([batch] if batch is not None else []))
        except CommitConflict:
            continue


def _shards_of(spark: SparkSession, root: str, names: dict[str, tuple[int, int]]) -> DataFrame:
    """Manifest rows of the runs with the given sequence and level, from the files' metadata; no contents are read."""
    listed = None
    for name, (sequence, level) in names.items():
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{root}/runs/{name}").select(F.lit(name).alias("run"), F.lit(sequence).cast("long").alias("sequence"), F.lit(level).alias("level"), F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("length").alias("bytes"))
        listed = files if listed is None else listed.unionByName(files)
    return listed


def _free_name(docs: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def append(docs: DataFrame, root: str, arrival: Column | None = None, batch: str | None = None) -> list[int]:
    """Add docs as small immutable shards: one run for each value of ``arrival``, or one for all rows, and one version for all of them, whose number is returned.

    ``arrival`` is an integer column without nulls, which is not stored. Rows keep all their
    columns, nulls and repetitions. Values of ``arrival`` without rows give no run; an empty table gives one run
    without rows, which holds the columns. A call that dies adds no row. A ``batch`` that the store holds already is not added again (and
    nothing is returned), so a call of which the caller doesn't know whether it came through can be repeated.
    """
    spark, name = docs.sparkSession, uuid.uuid4().hex
    if batch is not None and batch_version(spark, root, batch):
        return []
    by = _free_name(docs, "arrival")
    docs.withColumn(by, F.lit(0) if arrival is None else arrival).write.partitionBy(by).option("compression", "zstd").parquet(f"{root}/runs/{name}")
    fs, at, _ = _file_system(spark, f"{root}/runs/{name}")
    folders = sorted((int(x.getPath().getName().split("=")[1]), x.getPath().getName()) for x in fs.listStatus(at) if x.isDirectory())
    arrived = [f"{name}/{folder}" for _, folder in folders]
    if not arrived:
        arrived = [f"{name}/empty"]
        docs.limit(0).write.parquet(f"{root}/runs/{arrived[0]}")

    def added(shards: DataFrame, version: int) -> DataFrame | None:
        if batch is not None and batch_version(spark, root, batch):  # another writer of the same batch was first
            return None
        return shards.unionByName(_shards_of(spark, root, {run: (version, 0) for run in arrived}))

    version = _build_on_last(spark, root, added, batch)
    return [] if version is None else [version]


def similar_runs(all_runs: list[Run], fanout: int = FANOUT) -> list[Run]:
    """The smallest ``fanout`` or more runs of similar size, or none."""
    ordered = sorted(all_runs, key=lambda x: (x.bytes, x.sequence, x.run))
    for k in range(len(ordered)):
        group: list[Run] = []
        for run in ordered[k:]:
            mean = (sum(x.bytes for x in group) + run.bytes) / (len(group) + 1)
            if run.bytes > SIMILAR * mean or (group and group[0].bytes * SIMILAR < mean):
                break
            group.append(run)
        if len(group) >= fanout:
            return group
    return []


def compact(spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> list[int]:
    """Merge similar runs until no ``fanout`` of them are left; each merge is one version.

    A merge stands while all its runs are in the last version; where another writer took one of them away, it is dropped.
    """
    done: list[int] = []
    while True:
        group = similar_runs(runs(manifest(spark, root)), fanout)
        if not group:
            return done
        level, names = max(x.level for x in group) + 1, [x.run for x in group]
        files = max(1, -(-sum(x.bytes for x in group) // target_bytes))
        name = uuid.uuid4().hex
        merged = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/runs/{x}" for x in names]).coalesce(files)
        merged.write.option("compression", "zstd").parquet(f"{root}/runs/{name}")

        def swapped(shards: DataFrame, version: int, names=names, name=name, level=level) -> DataFrame | None:
            if shards.filter(F.col("run").isin(names)).select("run").distinct().count() < len(names):
                return None
            return shards.filter(~F.col("run").isin(names)).unionByName(_shards_of(spark, root, {name: (version, level)}))

        version = _build_on_last(spark, root, swapped)
        if version is not None:
            done.append(version)


def read(spark: SparkSession, root: str, version: int | None = None, run_facts: str | None = None) -> DataFrame:
    """All rows of a version with their columns, and, if named, a struct column ``run_facts`` (level, sequence) of their run."""
    found = None
    for run in runs(manifest(spark, root, version)):
        rows = spark.read.parquet(f"{root}/runs/{run.run}")
        if run_facts:
            rows = rows.withColumn(run_facts, F.struct(F.lit(run.level).alias("level"), F.lit(run.sequence).alias("sequence")))
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"{root} has no version")
    return found


def vacuum(spark: SparkSession, root: str, older_than_seconds: float = 7 * 86400) -> list[str]:
    """Remove runs and manifests that no version names and that are older, as writers at work have younger ones; gives their paths."""
    named = {"runs": set(), "manifests": set()}
    for version in versions(spark, root):
        named["manifests"].add(_manifest_name(spark, root, version))
        named["runs"] |= {row[0].split("/")[0] for row in manifest(spark, root, version).select("run").distinct().collect()}
    gone = []
    for kind, names in named.items():
        fs, at, jvm = _file_system(spark, f"{root}/{kind}")
        limit = jvm.java.lang.System.currentTimeMillis() - int(older_than_seconds * 1000)
        for x in fs.listStatus(at) if fs.exists(at) else ():
            if x.getPath().getName() not in names and x.getModificationTime() <= limit:
                fs.delete(x.getPath(), True)
                gone.append(x.getPath().toString())
    return gone


def sharded_report(docs: DataFrame, root: str, arrivals: int = 8) -> DataFrame:
    """doc_id, arrival, n_bytes, text_sha256 of all rows, read back from the last version. An empty table gives no rows.

    Each arrival, the rows with one remainder of doc_id (null: 0), is appended as its own run, then runs are compacted.
    """
    source = _free_name(docs, "source_arrival")
    of = F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0)).cast("int")
    append(docs.withColumn(source, of), root, of)
    compact(docs.sparkSession, root)
    return read(docs.sparkSession, root).select("doc_id", F.col(source).alias("arrival"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SHARDED_SQL = """
SELECT doc_id, CAST(coalesce(((doc_id % 8) + 8) % 8, 0) AS INT) AS arrival,
       CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

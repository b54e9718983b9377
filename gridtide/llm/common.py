"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at a time. Documents are kilobytes, so the default of 10,000 rows would be large.
ROWS_PER_BATCH = 1024
BYTES_PER_BATCH = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of documents to bounded rows and bytes (a longer text comes alone), and let local workers import this package."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where a session on one machine names none (tests), a temporary folder becomes the checkpoint folder; on a cluster it has to be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-gridtide-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"gridtide-{uuid.uuid4().hex}", name)


class Scratch:
    """Folders and tables that operators write on the way to a result."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.tables: list[str] = []

    def read_by(self, df: DataFrame) -> bool:
        """Whether df reads any of them."""
        known = [f"/{Path(p).parent.name}/" for p in self.paths] + [f"/{t.split('.')[-1].lower()}/" for t in self.tables]
        return bool(known) and any(k in file for file in df.inputFiles() for k in known)

    def adopt(self, other: Scratch) -> None:
        self.paths += other.paths
        self.tables += other.tables

    def drop(self, spark: SparkSession) -> None:
        """Remove them. Their DataFrames can't be read any more."""
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths, self.tables = [], []


_OPEN: ContextVar[tuple[Scratch, ...]] = ContextVar("gridtide_scratch", default=())


@contextmanager
def collected(own: Scratch) -> Iterator[Scratch]:
    """What is staged inside belongs to ``own``."""
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield own
    finally:
        _OPEN.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What is staged inside is removed at the end, but for what outlives it.

    Operators' results are lazy and may read staged data; write such a result inside a scope of your own:
    ``with scratch(spark): operator(docs).write.parquet(path)`` leaves nothing else behind.
    """
    own = Scratch()
    try:
        with collected(own):
            yield own
    finally:
        own.drop(spark)


def staged(df: DataFrame, name: str, *, outlives: bool = False, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder belongs to the innermost open scope, or, if it ``outlives`` that, to the one around it.
    """
    path = new_path(df.sparkSession, name)
    owner(outlives).paths.append(path)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def owner(outlives: bool = False) -> Scratch:
    """The scope that new scratch data belongs to; outside of all scopes it is nobody's, and stays."""
    scopes = _OPEN.get()[: -1 if outlives else None]
    return scopes[-1] if scopes else Scratch()


def in_scope() -> bool:
    """Whether a scope is open, which removes what is staged in it."""
    return bool(_OPEN.get())


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, which sizes the shuffles that follow."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def wrapped(docs: DataFrame) -> DataFrame:
    """One column ``doc``, a struct of all columns of docs, whose names then clash with nothing."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"))


def field(docs: DataFrame, name: str):
    """The schema field of a column, made nullable."""
    from pyspark.sql.types import StructField

    found = docs.select(docs[name]).schema.fields[0]
    return StructField(found.name, found.dataType, True)

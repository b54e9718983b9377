"""Checksums of files of any size, and contracts that only read footers.

Tasks open byte ranges of files by their own address, so no file has to fit in a row or a task. A file's checksum has two levels: sha256 of each chunk, and of
the chunk size, the file's size and the chunks' digests in order; a changed byte is found by its chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 64 << 20
#: Bytes that a task holds of a chunk.
PIECE = 1 << 20


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes and address of all files below root: the path that Spark knows, and the one behind it, if root is a mounted view of another store.

    Spark's scans skip empty files, so these aren't listed; a manifest that names one finds it missing.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    real = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(at)
    seen = at.makeQualified(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri(), at.getParent() or at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)  # contents aren't read
    return files.select("path", F.col("length").alias("bytes"), F.concat(F.lit(real.toString().rstrip("/")), F.substr("path", F.lit(len(seen) + 1))).alias("address"))


def opened(address: str):
    """A file for random reads, by an address such as file:/a/b, hdfs://host/a or s3://bucket/a."""
    from pyarrow import fs

    scheme, _, rest = address.partition(":")
    if scheme == "file" or not rest:
        return fs.LocalFileSystem().open_input_file("/" + (rest or address).lstrip("/"))
    host, _, path = rest.lstrip("/").partition("/")
    store, base = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{host}/")
    return store.open_input_file(f"{base.rstrip('/')}/{path}")


def chunk_digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, bytes, chunk (from 0), sha256 of every chunk of the files (path, bytes, address).

    Chunks are dealt to tasks by themselves, so those of one large file are read side by side.
    """
    if chunk < 1:
        raise ValueError("a chunk has a byte at least")
    last = F.greatest(F.expr(f"(bytes - 1) div {chunk}"), F.lit(0))
    ranges = files.select("path", "bytes", "address", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for address, k in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                digest, left = hashlib.sha256(), chunk
                with opened(address) as f:
                    f.seek(k * chunk)
                    while left and (piece := f.read(min(left, PIECE))):
                        digest.update(piece)
                        left -= len(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(out, pa.string())], names=["path", "bytes", "chunk", "sha256"])

    return ranges.repartition("path", "chunk").mapInArrow(hashed, "path string, bytes long, chunk long, sha256 string")


def file_digests(chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, bytes, n_chunks and sha256 of each file, from its chunks' digests."""
    per = chunks.groupBy("path", "bytes").agg(F.sort_array(F.collect_list(F.struct("chunk", "sha256"))).alias("c"))
    return per.select("path", "bytes", F.size("c").cast("long").alias("n_chunks"), F.sha2(F.concat_ws(":", F.lit(str(chunk)), F.col("bytes").cast("string"), F.array_join(F.col("c.sha256"), "")), 256).alias("sha256"))


def changed_chunks(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, chunk and problem where the chunks found (of :func:`chunk_digests`) aren't those of the manifest: missing, size, checksum or unexpected. A shorter or longer file is named by every chunk that it still has."""
    a = manifest.select("path", "chunk", F.col("bytes").alias("bytes_a"), F.col("sha256").alias("sha_a"))
    b = found.select("path", "chunk", F.col("bytes").alias("bytes_b"), F.col("sha256").alias("sha_b"))
    problem = F.when(F.col("sha_b").isNull(), "missing").when(F.col("sha_a").isNull(), "unexpected").when(F.col("bytes_a") != F.col("bytes_b"), "size").when(F.col("sha_a") != F.col("sha_b"), "checksum")
    return a.join(b, ["path", "chunk"], "full").select("path", "chunk", problem.alias("problem")).filter("problem IS NOT NULL")


def footers(files: DataFrame, time: str) -> DataFrame:
    """path, bytes, n_rows, n_groups, columns, first and last of ``time``: what each Parquet file's own footer says, without reading a data page.

    A file that has no footer has null n_rows and columns. first and last are null if the column or any group's statistics are missing; ``time`` has to be a timestamp or date.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime as dt

        import pyarrow.parquet as pq

        def instant(v) -> dt.datetime:
            whole = v if isinstance(v, dt.datetime) else dt.datetime.combine(v, dt.time())
            return whole.astimezone(dt.UTC).replace(tzinfo=None) if whole.tzinfo else whole

        for batch in batches:
            out: list[tuple] = []
            for address in batch.column(2).to_pylist():
                with opened(address) as f:
                    try:
                        meta = pq.ParquetFile(f).metadata
                    except (pa.ArrowInvalid, OSError):
                        out.append((None, None, None, None, None))
                        continue
                    names = meta.schema.to_arrow_schema().names
                    places = [k for k in range(meta.num_columns) if meta.num_row_groups and meta.row_group(0).column(k).path_in_schema == time]
                    groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                    stats = [g.column(places[0]).statistics for g in groups if g.num_rows] if places else []
                    # A group of nulls only has no bounds and needs none.
                    stats = [s for g, s in zip([g for g in groups if g.num_rows], stats, strict=False) if not (s is not None and s.null_count == g.num_rows)]
                    known = bool(stats) and all(s is not None and s.has_min_max for s in stats)
                    out.append((meta.num_rows, meta.num_row_groups, names, instant(min(s.min for s in stats)) if known else None, instant(max(s.max for s in stats)) if known else None))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.timestamp("us"), pa.timestamp("us"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]], names=["path", "bytes", "n_rows", "n_groups", "columns", "first", "last"])

    dealt = files.select("path", "bytes", "address").repartition("path")
    return dealt.mapInArrow(read, "path string, bytes long, n_rows long, n_groups long, columns array<string>, first timestamp_ntz, last timestamp_ntz")


def file_problems(footer: DataFrame, required: Sequence[str], month: Column) -> DataFrame:
    """The footers with problems: not_parquet, empty, missing_columns (names), no_bounds, unnamed_month and outside_month, as far as they hold.

    ``month`` is the month (yyyy-MM) that a file is named after; its times have to overlap it.
    """
    lacking = F.array_except(F.array(*map(F.lit, required)), F.col("columns"))
    begin = F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    end = (F.add_months(begin.cast("date"), 1)).cast("timestamp_ntz")
    parquet, filled = F.col("n_rows").isNotNull(), F.col("n_rows") > 0
    problems = F.array_compact(F.array(
        F.when(~parquet, F.lit("not_parquet")), F.when(parquet & ~filled, F.lit("empty")),
        F.when(parquet & (F.size(lacking) > 0), F.concat(F.lit("missing_columns "), F.array_join(lacking, ","))),
        F.when(filled & F.col("first").isNull(), F.lit("no_bounds")), F.when(begin.isNull(), F.lit("unnamed_month")),
        F.when((F.col("last") < begin) | (F.col("first") >= end), F.lit("outside_month")),
    ))
    return footer.withColumn("problems", problems)

import datetime as dt
import hashlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridtide.sources import files


def written(path, sizes):
    path.mkdir()
    for k, n in enumerate(sizes):
        (path / f"f {k}%=.bin").write_bytes(bytes((7 * k + i * i) % 256 for i in range(n)))
    return {f"f {k}%=.bin": (path / f"f {k}%=.bin").read_bytes() for k in range(len(sizes))}


def by_name(rows):
    return {r["path"].rsplit("/", 1)[1]: r for r in rows}


def test_checksums_by_chunks(spark, tmp_path):
    held = written(tmp_path / "d", [0, 1, 9, 10, 11, 3_500_000])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "8")  # a reader of whole files would fail
    try:
        listed = files.listed(spark, str(tmp_path / "d"))
        assert {k: r["bytes"] for k, r in by_name(listed.collect()).items()} == {k: len(v) for k, v in held.items() if v}
        for chunk in (10, 1 << 20):
            small = listed.filter(F.col("bytes") < (1000 if chunk == 10 else 1 << 30))
            got = by_name(files.file_digests(files.chunk_digests(small, chunk), chunk).collect())
            for name, r in got.items():
                data = held[name]
                parts = [data[k : k + chunk] for k in range(0, max(1, len(data)), chunk)]
                want = hashlib.sha256(f"{chunk}:{len(data)}:{''.join(hashlib.sha256(p).hexdigest() for p in parts)}".encode()).hexdigest()
                assert (r["bytes"], r["n_chunks"], r["sha256"]) == (len(data), len(parts), want)
            assert len(got) == (4 if chunk == 10 else 5)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    with pytest.raises(ValueError):
        files.chunk_digests(listed, 0)


def test_a_flipped_byte_names_its_chunk(spark, tmp_path):
    written(tmp_path / "d", [50, 50, 50, 50])
    at = str(tmp_path / "d")
    manifest = spark.createDataFrame(files.chunk_digests(files.listed(spark, at), 10).collect())
    assert files.changed_chunks(manifest, files.chunk_digests(files.listed(spark, at), 10)).count() == 0
    one, two, three, four = sorted((tmp_path / "d").iterdir())
    data = bytearray(one.read_bytes())
    data[37] ^= 1
    one.write_bytes(bytes(data))
    two.write_bytes(two.read_bytes()[:15])
    three.unlink()
    (tmp_path / "d" / "new").write_bytes(b"x")
    found = files.changed_chunks(manifest, files.chunk_digests(files.listed(spark, at), 10)).collect()
    names = {}
    for r in found:
        names.setdefault(r["path"].rsplit("/", 1)[1], set()).add((r["chunk"], r["problem"]))
    assert names == {one.name: {(3, "checksum")}, two.name: {(0, "size"), (1, "size"), (2, "missing"), (3, "missing"), (4, "missing")}, three.name: {(k, "missing") for k in range(5)}, "new": {(0, "unexpected")}}


def month_files(path):
    path.mkdir()

    def put(name, days, columns=("t", "k"), **options):
        t = pa.array([dt.datetime(2025, *d) if d else None for d in days], pa.timestamp("us"))
        pq.write_table(pa.table({c: t if c == "t" else pa.array(range(len(days))) for c in columns}), path / name, **options)

    put("a_2025-01.parquet", [(1, 3), (1, 9), (2, 1), None], row_group_size=2)
    put("b_2025-02.parquet", [])
    put("c_2025-03.parquet", [(3, 1)], columns=("t",))
    put("d_2025-04.parquet", [(1, 1), (3, 31)])
    put("e_2025-05.parquet", [(5, 1)], write_statistics=False)
    put("f_2025.parquet", [(5, 1)])
    put("g_2025-06.parquet", [(7, 1)], columns=("k", "t"))
    put("h_2025-07.parquet", [None, None])
    put("j_2025-08.parquet", [(8, 31), (12, 1), None, None], row_group_size=2)
    put("k_2025-09.parquet", [(9, 30)], columns=("other",))
    (path / "i_2025-08.parquet").write_bytes(b"PAR1 not a table")
    # Data pages that can't be read: only the footer counts.
    data = bytearray((path / "a_2025-01.parquet").read_bytes())
    first = pq.ParquetFile(path / "a_2025-01.parquet").metadata.row_group(0).column(0)
    data[4 : 4 + first.total_compressed_size - 4] = b"\xff" * (first.total_compressed_size - 4)
    (path / "a_2025-01.parquet").write_bytes(bytes(data))


def test_contracts_from_footers(spark, tmp_path):
    month_files(tmp_path / "m")
    read = files.footers(files.listed(spark, str(tmp_path / "m")), "t")
    month = F.regexp_extract("path", r"_(\d{4}-\d{2})\.parquet", 1)
    got = by_name(files.file_problems(read, ["t", "k"], month).collect())
    assert {k[0]: r["problems"] for k, r in got.items()} == {
        "a": [], "b": ["empty"], "c": ["missing_columns k"], "d": ["outside_month"], "e": ["no_bounds"], "f": ["unnamed_month"],
        "g": ["outside_month"], "h": ["no_bounds"], "i": ["not_parquet"], "j": [], "k": ["missing_columns t,k", "no_bounds"],
    }
    a = got["a_2025-01.parquet"]
    assert (a["n_rows"], a["n_groups"], a["columns"], a["first"], a["last"]) == (4, 2, ["t", "k"], dt.datetime(2025, 1, 3), dt.datetime(2025, 2, 1))
    assert got["i_2025-08.parquet"]["n_rows"] is None
    with pytest.raises(Exception):  # noqa: B017 - the rows themselves can't be read
        spark.read.parquet(str(tmp_path / "m" / "a_2025-01.parquet")).collect()


def test_footers_of_spark_files(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.lit("2025-03-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int") % 28)).alias("t"), F.to_date(F.lit("2025-03-09")).alias("d"))
    rows.repartition(4).write.parquet(str(tmp_path / "s"))
    for column, first, last in (("t", dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 28)), ("d", dt.datetime(2025, 3, 9), dt.datetime(2025, 3, 9))):
        found = files.footers(files.listed(spark, str(tmp_path / "s")).filter(F.col("path").endswith(".parquet")), column)
        assert tuple(found.agg(F.sum("n_rows"), F.min("first"), F.max("last")).first()) == (1000, first, last)

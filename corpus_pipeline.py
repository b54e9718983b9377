"""The corpus pipeline: quality, near-duplicates, repeated substrings, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import bpe, decontamination, near_duplicates, quality, substring_parse
from gridtide.llm.common import Scratch, collected, in_scope, owner, read_table, scratch, staged
from gridtide.llm.queries import pattern, vocabulary

#: Word shingles' similarity from which documents are near-duplicates here; op7's contract is 85.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch data of the last stage that ran outside of scopes, by input folder.
_LAST: dict[str, Scratch] = {}


def _stage(work: Stage) -> Stage:
    """A stage whose result is lazy and may read scratch data.

    In a scope (``with scratch(spark):``) these stay until it ends. Outside, a stage begins by removing those of the one before, unless its own input still reads
    them: then they stay as long as its own.
    """

    @wraps(work)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if in_scope():
            return work(spark, docs, sf_dir)
        before, own = _LAST.pop(sf_dir, Scratch()), Scratch()
        if before.read_by(docs):
            own.adopt(before)
        else:
            before.drop(spark)
        _LAST[sf_dir] = own
        with collected(own):
            return work(spark, docs, sf_dir)

    return begun


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted quality model keeps."""
    return quality.keep_good(docs)


@_stage
def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates, of similarity NEAR_PERCENT or more."""
    return near_duplicates.keep_one(docs, percent=NEAR_PERCENT)


@_stage
def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document holds in strings of 50 bytes or more."""
    return substring_parse.without_repeats(docs)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@_stage
def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of docs, and n_tokens and ids (little-endian unsigned 32-bit), which get a "_" where docs have such columns; texts are what the ids decode to."""
    others = [c for c in docs.columns if c != "text"]
    decoded = bpe.encode_bpe(docs.select(F.struct(*[docs[c] for c in others]).alias("doc"), docs["text"].alias("text")), vocabulary("byte_bpe_50k.tiktoken"), pattern(), keep=("doc",), decoded=True)
    added = {c: c + "_" * next(k for k in range(len(others) + 1) if c + "_" * k not in others) for c in ("n_tokens", "ids")}
    return decoded.select(*[(F.col("decoded").cast("string") if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns], *[F.col(c).alias(name) for c, name in added.items()])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("repeated_substrings", repeated_substrings),
    ("benchmark_passages", benchmark_passages),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can't express byte-level BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), Scratch()
    for name, stage in STAGES:
        after = Scratch()
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            with collected(after):
                docs = staged(result, name)
        before.drop(spark)
        before = after
    owner().adopt(before)
    return docs

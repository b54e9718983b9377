"""Token counts by distinct pre-token.

Corpus pass one counts distinct pre-tokens (with a partial count in every task); the library
counts the pieces of each of them once. Pass two makes per-document pre-token frequencies and
sums frequency x pieces. Ids are never kept. Pre-tokens that make up most of the
text are few: of those up to HEAD_CHARS long, the ``head_size`` most frequent are broadcast, a bound in bytes that does not grow with
the corpus, and the rest meet their counts in a shuffle join, so every pre-token is counted.

A pre-token here runs from a space that follows a non-space character to the next such space; where that is
longer than HEAD_CHARS (text without spaces), it is cut further by the library's own pre-tokenizer.
The library's own split always cuts in these places, and special strings hold no space (a stretch with one stays whole), so the counts of
a text's pre-tokens add up to the count of the text.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import split_units
from .common import bounded_batches, field, staged

HEAD_SIZE = 200_000
#: Longer pre-tokens are not broadcast, and stretches without a space are cut from this length on.
HEAD_CHARS = 64
#: A task's partial counts are passed on when so many distinct pre-tokens are held.
HELD_UNITS = 400_000
#: ... or after so many characters, which bounds their bytes.
HELD_CHARS = 64 << 20


class PreTokens:
    """Cuts texts into pre-tokens; made in each task from the tokenizer's file."""

    def __init__(self, path: str) -> None:
        self._pieces, self._special = None, ()
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            made = json.loads(library.to_str())
            if made["normalizer"] is None and (made["pre_tokenizer"] or {}).get("type") == "ByteLevel":
                self._pieces, self._special = library.pre_tokenizer.pre_tokenize_str, [x.content for x in library.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[str]:
        units = split_units(text)
        if self._pieces is None or len(text) <= HEAD_CHARS or max(map(len, units)) <= HEAD_CHARS:
            return units
        found: list[str] = []
        for unit in units:
            if len(unit) <= HEAD_CHARS or any(x in unit for x in self._special):
                found.append(unit)
            else:
                found += [unit[a:b] for _, (a, b) in self._pieces(unit)]
        return found


def _partial_counts(tokenizer: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held, size = PreTokens(tokenizer), Counter(), 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["unit", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.update(cut(value))
                size += len(value)
                if len(held) > HELD_UNITS or size > HELD_CHARS:
                    yield given()
                    held.clear()
                    size = 0
        if held:
            yield given()

    return count


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda units: [len(x) for x in processor.encode(units, num_threads=1)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda units: [len(x.ids) for x in library.encode_batch(units, add_special_tokens=False)]


def count_pieces(units: DataFrame, tokenizer: str) -> DataFrame:
    """unit, n, n_tokens: what the library makes of each distinct unit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tokenizer(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces(batch.column(0).to_pylist()), pa.int32())], names=["unit", "n", "n_tokens"])

    return units.select("unit", "n").mapInArrow(count, "unit string, n long, n_tokens int")


def _rank(n: str) -> Column:
    """Frequencies in a few hundred classes, by eighths of powers of two."""
    return F.floor(F.log2(n) * 8)


def head_rank(vocabulary: DataFrame, head_size: int) -> int:
    """The lowest class such that it and those above hold at most head_size units; one small row for each class is read."""
    held = 0
    classes = vocabulary.groupBy(_rank("n").alias("rank")).agg(F.count("*").alias("units")).collect()
    for row in sorted(classes, reverse=True):
        held += row["units"]
        if held > head_size:
            return row["rank"] + 1
    return 0


def token_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), head_size: int = HEAD_SIZE) -> DataFrame:
    """``keep``, n_bytes long, n_tokens long; one row for each row of docs.

    For tokenizers whose pre-tokenizer cuts at spaces (byte-level BPE). A null text counts as
    empty: 0 bytes, 0 tokens. Repeated rows each give a row, other columns are ignored, an empty
    table gives an empty table. ``head_size`` changes only how pre-tokens meet their counts.
    """
    if {"n_bytes", "n_tokens"} & set(keep):
        raise ValueError("keep may not name n_bytes or n_tokens")
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = [field(docs, name) for name in keep]
    width = len(keep)
    texts = docs.select(F.coalesce(docs[text], F.lit("")).alias("__text"))
    units = texts.mapInArrow(_partial_counts(tokenizer), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    vocabulary = staged(count_pieces(units, tokenizer), "vocabulary")
    short = vocabulary.filter(F.char_length("unit") <= HEAD_CHARS)
    head = short.filter(_rank("n") >= head_rank(short, head_size)).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(head["unit"].to_pylist(), head["n_tokens"].to_pylist(), strict=True)))

    parts = T.StructType([T.StructField("__row", T.LongType()), T.StructField("doc", T.StructType(kept)), T.StructField("n_bytes", T.LongType()), T.StructField("unit", T.StringType()), T.StructField("freq", T.LongType())])
    doc_type = pa.struct([])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, cut = known.value, PreTokens(tokenizer)
        for batch in batches:
            doc = pa.StructArray.from_arrays(batch.columns[:width], names=list(keep)) if width else pa.nulls(batch.num_rows, doc_type)
            rows, sums, sizes = batch.column(width).to_pylist(), [], []
            tail_rows, tail_units, tail_freqs = [], [], []
            for row, value in zip(rows, batch.column(width + 1).to_pylist(), strict=True):
                total = 0
                for unit, freq in Counter(cut(value)).items():
                    n = pieces.get(unit)
                    if n is None:
                        tail_rows.append(row)
                        tail_units.append(unit)
                        tail_freqs.append(freq)
                    else:
                        total += n * freq
                sums.append(total)
                sizes.append(len(value.encode()))
            # A document's own row carries the sum so far under a unit of its own, which no text contains as it is no unit.
            yield pa.RecordBatch.from_arrays([batch.column(width), doc, pa.array(sizes, pa.int64()), pa.array([f"x {row}" for row in rows], pa.string()), pa.array(sums, pa.int64())], names=parts.names)
            if tail_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tail_rows, pa.int64()), pa.nulls(len(tail_rows), doc.type), pa.nulls(len(tail_rows), pa.int64()), pa.array(tail_units, pa.string()), pa.array(tail_freqs, pa.int64())], names=parts.names)

    rows = docs.select(*[docs[name] for name in keep], F.monotonically_increasing_id().alias("__row"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    joined = rows.mapInArrow(frequencies, parts).join(vocabulary.select("unit", "n_tokens"), "unit", "left")
    counted = joined.groupBy("__row").agg(F.max("doc").alias("doc"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("freq") * F.when(F.col("n_bytes").isNull(), F.col("n_tokens")).otherwise(F.lit(1))).alias("n_tokens"))
    return counted.select(*[F.col("doc")[name].alias(name) for name in keep], "n_bytes", "n_tokens")


def token_count_report(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return token_counts(docs, tokenizer).withColumn("over_limit", F.col("n_tokens") > limit)

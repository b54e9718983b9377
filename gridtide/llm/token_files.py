"""Token ids as ORC files.

Documents are put in ascending doc_id order across files and stripes, so that each file and stripe
covers a narrow range of ids. ORC stores the ids with its integer run-length encoding; row indexes and a
Bloom filter on doc_id let a reader skip stripes and row groups; stripes can be read in parallel.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, field, text_bytes

FILE_BYTES = 64 << 20
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000
#: Pieces that a worker remembers.
MEMORY_PIECES = 150_000
#: Pieces given to the library in one text, and bytes of text encoded at a time.
JOINED = 1000
ENCODED_BYTES = 4 << 20
#: The pattern of the pre-tokenizer whose pieces are cut here, and the mark of a piece's last token.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: The same pieces before letters are lowered and white space is dropped.
_CUTS = r"'[sStTmMdD]|'[rR][eE]|'[vV][eE]|'[lL][lL]|\p{L}+|\p{N}|[^\t-\r \x{85}\p{Z}\p{L}\p{N}]+"
#: Combining marks, and the letter whose lower case holds one: what stands beside them may change a piece.
_JOINING = r"[\p{M}\x{130}]"

_WORDS: dict = {}


class WordIds:
    """Ids of texts as the library gives them.

    Texts are cut into the pieces that the library's pre-tokenizer would cut them into. New pieces are given to the library
    many at a time, spaces between them; tokens that end a piece show where each one's ids end. Texts with special strings, combining marks
    or letters that are not in normal form are given to it whole, and so is every text where the tokenizer cuts in another way.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        made = json.loads(self._library.to_str())
        kinds = [x.get("pattern", {}).get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self._cuts = kinds[:1] == [SPLIT] and made["model"].get("end_of_word_suffix") == WORD_END
        self._joining = "|".join([_JOINING, *[re.escape(x.content) for x in self._library.get_added_tokens_decoder().values()]])
        self._ends = np.zeros(self._library.get_vocab_size() + 1, bool)
        self._ends[[i for token, i in self._library.get_vocab().items() if token.endswith(WORD_END)]] = True
        self._known: dict[str, tuple[int, ...]] = {"": ()}

    def _whole(self, texts: list[str]) -> list[tuple[int, ...]]:
        return [tuple(x.ids) for x in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        for k in range(0, len(pieces), JOINED):
            group = pieces[k : k + JOINED]
            ids = self._library.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids
            stops = (np.flatnonzero(self._ends[ids]) + 1).tolist()
            yield from [tuple(ids[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)] if len(stops) == len(group) else self._whole(group)

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids end. Each distinct piece is looked up once."""
        cut = pc.split_pattern(pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _CUTS, r"\0 "), " ")
        lists = cut.offsets.to_numpy()
        indexed = cut.values.slice(lists[0], lists[-1] - lists[0]).dictionary_encode()
        distinct, known = indexed.dictionary.to_pylist(), self._known
        piece = indexed.indices.to_numpy(zero_copy_only=False)
        codes = list(map(known.get, distinct))
        new = [k for k, x in enumerate(codes) if x is None]
        often = np.bincount(piece, minlength=len(distinct)) > 1
        for k, ids in zip(new, self._learn([distinct[k] for k in new]), strict=True):
            codes[k] = ids
            if often[k] and len(known) < MEMORY_PIECES:
                known[distinct[k]] = ids
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        table = np.fromiter(chain.from_iterable(codes), np.int32, sizes.sum())
        per_piece = sizes[piece]
        before = np.concatenate([[0], np.cumsum(per_piece)])
        at = np.repeat((np.cumsum(sizes) - sizes)[piece] - before[:-1], per_piece) + np.arange(before[-1])
        return table[at], before[lists[1:] - lists[0]]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with end_id after each, and where each text's ids end."""
        normal = pa.array([unicodedata.is_normalized("NFC", x) for x in texts.to_pylist()], pa.bool_())
        plain = pc.and_not(normal, pc.match_substring_regex(texts, self._joining)) if self._cuts else pa.array(np.zeros(len(texts), bool))
        gc.disable()  # millions of small tuples and no cycles
        try:
            flat, stops = self._by_pieces(pc.if_else(plain, texts, ""))
            others = dict(zip(pc.indices_nonzero(pc.invert(plain)).to_pylist(), self._whole(texts.filter(pc.invert(plain)).to_pylist()), strict=True))
        finally:
            gc.enable()
        counts = np.diff(stops, prepend=0) + 1
        for k, ids in others.items():
            counts[k] += len(ids)
        ends = np.cumsum(counts)
        out = np.full(ends[-1] if len(ends) else 0, end_id, np.int32)
        shift = ends - counts - (stops - np.diff(stops, prepend=0))
        out[np.arange(len(flat)) + np.repeat(shift, np.diff(stops, prepend=0))] = flat
        for k, ids in others.items():
            out[ends[k] - counts[k] : ends[k] - 1] = ids
        return out, ends


def _word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int = 1, file_bytes: int = FILE_BYTES) -> None:
    """Encode every whole text, append ``end_id``, and write doc_id, part, row, n_tokens and ids in ascending doc_id order.

    ``part`` is the file's place in the order and ``row`` the document's place in the file. Any tokenizer of the library
    may be named. A null text counts as empty and gets the end id alone; very long texts are encoded whole, one at a time.
    A null doc_id comes first; rows with equal doc_id stand side by side in the order of their texts.
    Other columns are ignored. An empty table gives files without rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    schema = T.StructType([field(rows, "doc_id"), T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, held = TaskContext.get().partitionId(), 0, []

        def given() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            flat, ends = _word_ids(tokenizer).encode(table.column(1).chunk(0), end_id)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            n = table.num_rows
            return pa.RecordBatch.from_arrays([table.column(0).chunk(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=schema.names)

        for batch in filter(len, batches):
            held.append(batch)
            if sum(x.nbytes for x in held) >= ENCODED_BYTES:
                yield given()
                row, held = row + sum(map(len, held)), []
        if held:
            yield given()

    files = max(1, -(-text_bytes(rows, "__text") // file_bytes))
    ordered = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "__text")
    options = {"compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(INDEX_ROWS), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ordered.mapInArrow(encode, schema).write.options(**options).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. A filter on doc_id is pushed to the stripes' statistics and Bloom filters."""
    return spark.read.orc(path)


def document_offsets(tokens: DataFrame) -> DataFrame:
    """part, row, doc_id, n_tokens and start: ids of all documents before it. Reads no ids."""
    rows = tokens.select("part", "row", "doc_id", "n_tokens")
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = files.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    in_file = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.join(before, "part").withColumn("start", F.col("before") + in_file).drop("before")


def id_checksums(tokens: DataFrame) -> DataFrame:
    """part, row, doc_id, n_tokens, ids_crc32 from the ids as read."""
    bounded_batches(tokens.sparkSession)
    schema = T.StructType([field(tokens, "part"), field(tokens, "row"), field(tokens, "doc_id"), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crcs, pa.int64())], names=schema.names)

    return tokens.select("part", "row", "doc_id", "ids").mapInArrow(checksums, schema)


def token_file_report(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    starts = document_offsets(tokens).select("part", "row", "start")
    return id_checksums(tokens).join(starts, ["part", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")

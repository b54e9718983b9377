"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves until the pieces are small. A piece becomes an element of a
monoid, and neighbours are joined up the tree. The join has to re-encode only a window
around the cut, which grows until the tokens outside it are certain.

What makes them certain: the pattern never puts a non-space character and the space that
follows it into one match, so a space after a non-space character always begins a match.
Text between two such places ("a unit") is encoded alike wherever it stands.

An element is either open, ``(text,)``: a text without such a place, whose tokens are not yet
certain, or closed, ``(head, runs, tail)``: uncertain text, then tokens that no neighbour can
change, then uncertain text. Joining two elements encodes the first one's tail with the
second one's head; an open element makes the window grow on.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, field

#: A piece of this many characters is encoded at once.
LEAF_CHARS = 8192
#: Longer texts are cut into parts that are encoded by different tasks.
PART_CHARS = 65536
#: Units kept in a worker's table; it is emptied when full.
MEMORY_UNITS = 150_000

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_UNIT_START = re.compile(r"(?<=\S)(?= )")


def split_units(text: str) -> list[str]:
    """Cut before every space that follows a non-space character."""
    if "\0" in text or _SPACE_AFTER_SPACE.search(text):
        return _UNIT_START.split(text)
    if text.startswith(" "):
        return [" " + first if k == 0 else first for k, first in enumerate(text[1:].replace(" ", "\0 ").split("\0"))]
    return text.replace(" ", "\0 ").split("\0")


class UnitCodes(dict):
    """Token ids of units, each encoded by the library once while it is remembered."""

    def __init__(self, encoding) -> None:
        super().__init__()
        self._encode = encoding.encode_ordinary

    def __missing__(self, unit: str) -> tuple[int, ...]:
        codes = tuple(self._encode(unit))
        if len(unit) <= 64:
            self[unit] = codes
        return codes


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


_CODES: dict[tuple[str, str], UnitCodes] = {}


def unit_codes(path: str, pattern: str) -> UnitCodes:
    """The worker's table for a vocabulary; workers outlive tasks."""
    key = (path, pattern)
    if key not in _CODES:
        _CODES[key] = UnitCodes(_encoding(path, pattern))
    if len(_CODES[key]) > MEMORY_UNITS:
        _CODES[key].clear()
    return _CODES[key]


def leaf(text: str, codes: UnitCodes) -> tuple:
    units = split_units(text)
    if len(units) == 1:
        return (text,)
    return units[0], list(map(codes.__getitem__, units[1:-1])), units[-1]


def join(a: tuple, b: tuple, codes: UnitCodes) -> tuple:
    """a then b. The window between them is encoded as soon as both its ends are certain."""
    if len(a) == 1 and len(b) == 1:
        return leaf(a[0] + b[0], codes)
    if len(a) == 1:
        first = leaf(a[0] + b[0], codes)
        if len(first) == 1:
            return first[0], b[1], b[2]
        return first[0], [*first[1], codes[first[2]], *b[1]], b[2]
    if len(b) == 1:
        last = leaf(a[2] + b[0], codes)
        if len(last) == 1:
            return a[0], a[1], last[0]
        return a[0], [*a[1], codes[last[0]], *last[1]], last[2]
    window = list(map(codes.__getitem__, split_units(a[2] + b[0])))
    a[1].extend(window)
    a[1].extend(b[1])
    return a[0], a[1], b[2]


def reduce_tree(elements: list[tuple], codes: UnitCodes) -> tuple:
    while len(elements) > 1:
        elements = [join(*elements[k : k + 2], codes) if k + 1 < len(elements) else elements[k] for k in range(0, len(elements), 2)]
    return elements[0]


def encode_halves(text: str, codes: UnitCodes, leaf_chars: int = LEAF_CHARS) -> tuple:
    if len(text) <= leaf_chars:
        return leaf(text, codes)
    half = len(text) // 2
    return join(encode_halves(text[:half], codes, leaf_chars), encode_halves(text[half:], codes, leaf_chars), codes)


def close(element: tuple, codes: UnitCodes) -> np.ndarray:
    """The ids, once nothing stands before or after."""
    runs = [codes[element[0]]] if len(element) == 1 else [codes[element[0]], *element[1], codes[element[2]]]
    return np.fromiter(chain.from_iterable(runs), dtype="<u4")


def decode_halves(ids: np.ndarray, tokens: np.ndarray, leaf_ids: int = 8192) -> bytes:
    if len(ids) <= leaf_ids:
        return b"".join(tokens[ids].tolist())
    half = len(ids) // 2
    return decode_halves(ids[:half], tokens, leaf_ids) + decode_halves(ids[half:], tokens, leaf_ids)


_TOKENS: dict[str, np.ndarray] = {}


def token_bytes(vocabulary: str) -> np.ndarray:
    """The worker's table of what each id stands for."""
    if vocabulary not in _TOKENS:
        ranks = load_ranks(vocabulary)
        _TOKENS[vocabulary] = np.empty(max(ranks.values()) + 1, dtype=object)
        for token, rank in ranks.items():
            _TOKENS[vocabulary][rank] = token
    return _TOKENS[vocabulary]


def encode_bpe(docs: DataFrame, vocabulary: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False, leaf_chars: int = LEAF_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """Columns ``keep``, n_tokens long, and ids binary: little-endian unsigned 32-bit integers; with ``decoded``, also the bytes that the ids stand for.

    A null text counts as empty and gives no ids. Repeated rows each give a row. Columns of docs
    other than ``keep`` and ``text`` are ignored, whatever their names; ``keep`` may hold nulls.
    An empty table gives an empty table. Texts over ``part_chars`` characters are cut into parts
    that tasks encode independently; their elements meet by document and join in a tree.
    """
    bounded_batches(docs.sparkSession)
    given = ("n_tokens", "ids", "decoded")[: 3 if decoded else 2]
    if set(given) & set(keep):
        raise ValueError(f"keep may not name {', '.join(given)}")
    kept = [field(docs, name) for name in keep]
    rows = docs.select(*[docs[name] for name in keep], F.coalesce(docs[text], F.lit("")).alias("__text"))
    out = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in given[1:]]])
    width = len(keep)

    def results(ids: list[np.ndarray]) -> list[pa.Array]:
        columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
        return [*columns, pa.array([decode_halves(x, token_bytes(vocabulary)) for x in ids], pa.binary())] if decoded else columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = unit_codes(vocabulary, pattern)
            ids = [close(encode_halves(value, codes, leaf_chars), codes) for value in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *results(ids)], names=out.names)

    is_long = F.char_length("__text") > part_chars
    short = rows.filter(~is_long).mapInArrow(encode, out)

    part_schema = T.StructType([*kept, T.StructField("__row", T.LongType()), T.StructField("__part", T.LongType()), T.StructField("__text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                value = one.column(width + 1)[0].as_py()
                for part, at in enumerate(range(0, len(value), part_chars)):
                    yield pa.RecordBatch.from_arrays([*one.columns[: width + 1], pa.array([part], pa.int64()), pa.array([value[at : at + part_chars]])], names=[*keep, "__row", "__part", "__text"])

    element_schema = T.StructType([*part_schema.fields[:-1], T.StructField("__head", T.StringType()), T.StructField("__ids", T.BinaryType()), T.StructField("__tail", T.StringType())])

    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = unit_codes(vocabulary, pattern)
            elements = [encode_halves(value, codes, leaf_chars) for value in batch.column(width + 2).to_pylist()]
            middle = [None if len(x) == 1 else np.fromiter(chain.from_iterable(x[1]), dtype="<u4").tobytes() for x in elements]
            yield pa.RecordBatch.from_arrays([*batch.columns[: width + 2], pa.array([x[0] for x in elements], pa.string()), pa.array(middle, pa.binary()), pa.array([None if len(x) == 1 else x[2] for x in elements], pa.string())], names=[*keep, "__row", "__part", "__head", "__ids", "__tail"])

    def combine(table: pa.Table) -> pa.Table:
        codes = unit_codes(vocabulary, pattern)
        table = table.sort_by("__part").combine_chunks()
        rows = zip(table["__head"].to_pylist(), table["__ids"].to_pylist(), table["__tail"].to_pylist(), strict=True)
        elements = [(head,) if middle is None else (head, [np.frombuffer(middle, "<u4")], tail) for head, middle, tail in rows]
        whole = reduce_tree(elements, codes)
        runs = [codes[whole[0]]] if len(whole) == 1 else [codes[whole[0]], *whole[1], codes[whole[2]]]
        ids = np.concatenate([np.asarray(x, "<u4") for x in runs])
        return pa.table([*[table[name].slice(0, 1) for name in keep], *results([ids])], names=out.names)

    parts = rows.filter(is_long).select(*keep, F.monotonically_increasing_id().alias("__row"), "__text").mapInArrow(cut, part_schema)
    long = parts.repartition("__row", "__part").mapInArrow(encode_part, element_schema).groupBy("__row").applyInArrow(combine, out)
    return short.unionByName(long)


def decode_bpe(encoded: DataFrame, vocabulary: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """``keep`` and decoded binary: the bytes that the ids stand for. Null ids give null."""
    bounded_batches(encoded.sparkSession)
    kept = [field(encoded, name) for name in keep]
    width = len(keep)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_halves(np.frombuffer(x, "<u4"), token_bytes(vocabulary)) for x in batch.column(width).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    return encoded.select(*[encoded[name] for name in keep], encoded[ids].alias("__ids")).mapInArrow(decode, T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))


def encode_decode_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encode_bpe(docs, vocabulary, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

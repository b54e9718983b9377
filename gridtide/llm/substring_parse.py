"""Exact substring deduplication by prefix-free parsing and suffix sorting.

Every 50-byte string of a text holds 17 strings of 34 bytes. The one with the smallest rolling hash
is its trigger. Strings that start side by side mostly share a trigger; such a run is a phrase: the
bytes of its strings, at most 66. So triggers parse a text into phrases that overlap by
49 bytes, no phrase depends on what lies outside it, and equal 50-byte strings have equal
triggers, wherever they stand.

The corpus is kept as batches of texts, in a table bucketed by batch, and read three times:

1. Distinct triggers of each batch meet by value. Phrases whose trigger stands only once in the corpus
   are unlike any other and leave.
2. Distinct phrases of each batch (the dictionary), with the smallest doc_id that holds them there, meet by trigger.
   The dictionary's suffixes of 50 bytes and more are sorted by their first 50 bytes, exactly; suffixes that
   stay equal are one string, and the smallest doc_id of their phrases is the string's first document.
3. Each batch's parse takes the dictionary's answer back to its places: strings that
   start in a smaller document are marked and their bytes removed.

Only hashes, flags and repeated phrases are shuffled, never whole texts after the batches are made; a
phrase crosses once for each batch, so a passage that a third of all documents share is counted in batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, owner, staged, text_bytes

MATCH, GRAM = 50, 34
REACH = MATCH - GRAM + 1
PHRASE = MATCH + REACH - 1
BATCH_BYTES = 2 << 20
#: Bytes of text for each partition of batches and each bucket of triggers.
PART_BYTES = 16 << 20
CODE_BITS = 40

_ODD = 0x9E3779B97F4A7C15


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """The polynomial hash of the GRAM bytes from each place on, from those of half as many."""
    h, width, total, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if GRAM & width:  # the first bytes of the string by their hash, then the rest
            total = h if total is None else total[: len(h) - have] * np.uint64(pow(_ODD, width, 1 << 64)) + h[have:]
            have += width
        if have == GRAM:
            return total
        h = h[:-width] * np.uint64(pow(_ODD, width, 1 << 64)) + h[width:]
        width *= 2


def triggers(data: np.ndarray) -> np.ndarray:
    """For each start of a 50-byte string, its trigger's hash, whose low 5 bits are the trigger's place modulo 32."""
    h = rolling_hashes(data)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= ~np.uint64(31)
    h |= np.arange(len(h), dtype=np.uint64) & np.uint64(31)
    width = 1
    while width * 2 <= REACH:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (REACH - width)], h[REACH - width :]) if width < REACH else h


def parse(data: np.ndarray, ends: np.ndarray, known: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The phrases: first and last start of their strings, and their triggers' codes (bucket, then CODE_BITS bits).

    ``ends``: where texts end. Texts that are not ``known`` have no phrases.
    """
    none = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return none, none, none.astype(np.uint64)
    h = triggers(data)
    lengths = np.diff(ends, prepend=0)
    usable = np.zeros(len(data) + 1, np.int32)
    long = known & (lengths >= MATCH)
    begins = (ends - lengths)[long]
    np.add.at(usable, begins, 1)
    np.add.at(usable, ends[long] - MATCH + 1, -1)
    valid = np.cumsum(usable[: len(h)]) > 0
    starts_here = valid.copy()
    starts_here[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
    starts_here[begins] = True
    first = np.flatnonzero(starts_here)
    stops = valid.copy()
    stops[:-1] &= starts_here[1:] | ~valid[1:]
    last = np.flatnonzero(stops)
    value = h[first] >> np.uint64(5)
    code = (value % np.uint64(buckets) << np.uint64(CODE_BITS)) | (value // np.uint64(buckets) & np.uint64((1 << CODE_BITS) - 1))
    return first, last, code


def _gathered(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases as fixed-length strings: the size, then the bytes, padded."""
    padded = np.concatenate([data, np.zeros(PHRASE, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, PHRASE)[first]
    rows = np.where(np.arange(PHRASE) < sizes[:, None], rows, np.uint8(0))
    return np.ascontiguousarray(np.concatenate([sizes[:, None].astype(np.uint8), rows], axis=1)).view(f"S{PHRASE + 1}").ravel()


def dictionary(data: np.ndarray, first: np.ndarray, last: np.ndarray, code: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases by code: for each phrase its entry, and for each entry a phrase and the smallest doc_id."""
    strings = _gathered(data, first, last - first + MATCH)
    order = np.lexsort((ids, strings, code))
    new = np.ones(len(order), bool)
    new[1:] = (strings[order][1:] != strings[order][:-1]) | (code[order][1:] != code[order][:-1])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return entry, order[new], ids[order[new]]


def equal_strings(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes of data by their first MATCH bytes, eight at a time; gives those not alone, and their group."""
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    left, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for at in [*range(0, MATCH - 8, 8), MATCH - 8]:
        word = words[starts[left] + at].view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, group)) if at else np.argsort(word)
        left, group, word = left[order], group[order], word[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (word[1:] != word[:-1])
        group = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        left, group = left[~alone], group[~alone]
        if not len(left):
            break
    return left, group


def earlier_strings(phrases: list[bytes], docs: np.ndarray) -> np.ndarray:
    """For each phrase and its doc_id, the bits of its strings that a smaller doc_id's phrase holds too."""
    strings = np.array([bytes([len(x)]) + x for x in phrases], f"S{PHRASE + 1}")
    order = np.lexsort((docs, strings))
    new = np.ones(len(order), bool)
    new[1:] = strings[order][1:] != strings[order][:-1]
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    distinct = order[new]
    least = docs[distinct]
    sizes = np.array([len(phrases[k]) for k in distinct.tolist()], np.int64)
    data = np.frombuffer(b"".join([phrases[k] for k in distinct.tolist()]), np.uint8)
    per = sizes - MATCH + 1
    owner = np.repeat(np.arange(len(distinct)), per)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    left, group = equal_strings(data, (np.cumsum(sizes) - sizes)[owner] + place)
    bits = np.zeros(len(distinct), np.uint32)
    if len(left):
        smallest = np.full(group[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, least[owner[left]])
        found = left[smallest[group] < least[owner[left]]]
        np.bitwise_or.at(bits, owner[found], np.uint32(1) << place[found].astype(np.uint32))
    everything = (np.uint64(1) << per.astype(np.uint64)) - np.uint64(1)
    return np.where(docs > least[entry], everything[entry].astype(np.uint32), bits[entry])


def _batches(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """One row for each batch: batch, ids, known, ends (packed arrays), data (zstd) and doc: the texts' other columns."""
    others = [c for c in docs.columns if c != text]
    whole = docs.select(docs[doc_id].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("data"), F.struct(*[docs[c] for c in others]).alias("doc"))
    schema = T.StructType([T.StructField("batch", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("ids", "known", "ends", "data")], T.StructField("doc", T.ArrayType(whole.schema["doc"].dataType))])

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1)
        count, held = TaskContext.get().partitionId() << 32, []

        def one() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = [x.encode() for x in table["data"].to_pylist()]
            known = ~np.asarray(table["id"].is_null())
            ids = np.asarray(table["id"].fill_null(0), np.int64)
            ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
            rest = table["doc"].chunk(0)
            columns = [pa.array([count], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids.tobytes(), known.tobytes(), ends.tobytes(), squeeze.compress(b"".join(texts)))], pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        size = 0
        for batch in rows:
            sizes, begin = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], 0
            for k, n in enumerate(sizes):
                size += n
                if size >= BATCH_BYTES:
                    held.append(batch.slice(begin, k + 1 - begin))
                    yield one()
                    held, begin, size, count = [], k + 1, 0, count + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield one()

    # A bucketed table in the shared warehouse: later joins on batch leave the texts where they are.
    table = f"gridtide_batches_{uuid.uuid4().hex}"
    owner().tables.append(table)
    whole.mapInArrow(pack, schema).repartition(parts, "batch").write.option("compression", "none").bucketBy(parts, "batch").saveAsTable(table)
    return docs.sparkSession.table(table)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
    return np.frombuffer(zstandard.decompress(row["data"]), np.uint8), ends, ids, np.frombuffer(row["known"], bool)


def _by_bucket(code: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """Buckets that ordered codes fall in, with the range of each."""
    edges = np.searchsorted(code, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(CODE_BITS)).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def _five_bytes(code: np.ndarray) -> bytes:
    return np.ascontiguousarray(code).view(np.uint8).reshape(-1, 8)[:, : CODE_BITS // 8].tobytes()


def _repeated(row: dict, buckets: int) -> tuple[np.ndarray, ...]:
    """Of a batch with its flags: bytes, ends, ids, and its repeated phrases with their entries."""
    data, ends, ids, known = _unpack(row)
    first, last, code = parse(data, ends, known, buckets)
    distinct = np.unique(code)
    flags = np.zeros(len(distinct), bool)
    answers = {x["bucket"]: x["flags"] for x in row["answers"] or ()}
    for bucket, a, b in _by_bucket(distinct, buckets):
        flags[a:b] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a).astype(bool)
    keep = flags[np.searchsorted(distinct, code)]
    first, last, code = first[keep], last[keep], code[keep]
    owners = ids[np.searchsorted(ends, first, side="right")]
    entry, chosen, least = dictionary(data, first, last, code, owners)
    return data, ends, first, last, code, owners, entry, chosen, least


def repeated_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", as_text: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc`` (all columns but the text), n_bytes, n_removed, n_spans and kept: what is left, as bytes or as text.

    Removed is each byte covered by a 50-byte string that also starts in a document with a smaller
    doc_id; overlaps count, matches never cross documents and are judged on the input. As text, only
    characters go whose bytes are all removed. A null text counts as empty. Documents with equal doc_id
    do not remove each other's bytes; a null doc_id neither removes nor loses any. Each row of docs gives a row. An
    empty table gives no rows. doc_id has to be an integer.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(1, -(-text_bytes(docs, text) // part_bytes))
    batches = _batches(docs, doc_id, text, parts)

    def send_triggers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                data, ends, _, known = _unpack(row)
                code, counts = np.unique(parse(data, ends, known, parts)[2], return_counts=True)
                found = _by_bucket(code, parts)
                columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([row["batch"]] * len(found), pa.int64()), pa.array([_five_bytes(code[a:b]) for _, a, b in found], pa.binary()), pa.array([np.packbits(counts[a:b] > 1).tobytes() for _, a, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "codes", "twice"])

    def find_repeated(table: pa.Table) -> pa.Table:
        blobs = table["codes"].to_pylist()
        sizes = [len(x) // (CODE_BITS // 8) for x in blobs]
        codes = np.zeros((sum(sizes), 8), np.uint8)
        codes[:, : CODE_BITS // 8] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, CODE_BITS // 8)
        _, inverse, counts = np.unique(codes.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes, strict=True)]).astype(bool)
        often = counts > 1
        often[inverse[twice]] = True
        flags = np.split(often[inverse], np.cumsum(sizes)[:-1])
        return pa.table([table["batch"], table["bucket"], pa.array([np.packbits(x).tobytes() for x in flags], pa.binary())], names=["batch", "bucket", "flags"])

    sent = batches.select("batch", "ids", "known", "ends", "data").mapInArrow(send_triggers, "bucket int, batch long, codes binary, twice binary")
    flags = sent.groupBy("bucket").applyInArrow(find_repeated, "batch long, bucket int, flags binary")
    answers = staged(flags.groupBy("batch").agg(F.collect_list(F.struct("bucket", "flags")).alias("answers")), "flags")
    flagged = batches.join(answers.hint("shuffle_hash"), "batch", "left")

    def send_phrases(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in rows:
            for row in batch.to_pylist():
                data, _, first, last, code, _, _, chosen, least = _repeated(row, parts)
                found = _by_bucket(code[chosen], parts)
                sizes = (last - first + MATCH)[chosen]
                begin = first[chosen]
                raw = data.tobytes()
                bodies = [squeeze.compress(b"".join([raw[p : p + n] for p, n in zip(begin[a:b].tolist(), sizes[a:b].tolist(), strict=True)])) for _, a, b in found]
                columns = [pa.array([x[0] for x in found], pa.int32()), pa.array([row["batch"]] * len(found), pa.int64()), pa.array(bodies, pa.binary()), pa.array([sizes[a:b].astype(np.uint8).tobytes() for _, a, b in found], pa.binary()), pa.array([least[a:b].tobytes() for _, a, b in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "phrases", "sizes", "docs"])

    def sort_dictionary(table: pa.Table) -> pa.Table:
        phrases: list[bytes] = []
        counts = []
        for body, sizes in zip(table["phrases"].to_pylist(), table["sizes"].to_pylist(), strict=True):
            raw, at = zstandard.decompress(body), 0
            for n in sizes:
                phrases.append(raw[at : at + n])
                at += n
            counts.append(len(sizes))
        bits = earlier_strings(phrases, np.frombuffer(b"".join(table["docs"].to_pylist()), np.int64))
        squeeze = zstandard.ZstdCompressor(level=1)
        bodies = [squeeze.compress(x.tobytes()) for x in np.split(bits, np.cumsum(counts)[:-1])]
        return pa.table([table["batch"], table["bucket"], pa.array(bodies, pa.binary())], names=["batch", "bucket", "bits"])

    phrases = flagged.select("batch", "ids", "known", "ends", "data", "answers").mapInArrow(send_phrases, "bucket int, batch long, phrases binary, sizes binary, docs binary")
    bits = phrases.groupBy("bucket").applyInArrow(sort_dictionary, "batch long, bucket int, bits binary")
    found = staged(bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("found")), "bits")
    resolved = flagged.join(found.hint("shuffle_hash"), "batch", "left")
    out = T.StructType([T.StructField("doc", batches.schema["doc"].dataType.elementType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            lists = batch.column("doc")
            for k, row in enumerate(batch.drop_columns(["doc"]).to_pylist()):
                data, ends, first, last, code, owners, entry, chosen, least = _repeated(row, parts)
                marks = np.zeros(len(chosen), np.uint32)
                answers = {x["bucket"]: x["bits"] for x in row["found"] or ()}
                for bucket, a, b in _by_bucket(code[chosen], parts):
                    marks[a:b] = np.frombuffer(zstandard.decompress(answers[bucket]), np.uint32)
                mark = np.where(owners > least[entry], np.uint32(0xFFFFFFFF), marks[entry])
                covered = np.zeros(len(data) + 1, bool)
                for place in range(REACH):
                    covered[first[((mark >> np.uint32(place)) & 1 > 0) & (first + place <= last)] + place] = True
                starts = np.flatnonzero(covered)
                change = np.zeros(len(data) + 1, np.int32)
                change[starts] += 1
                change[starts + MATCH] -= 1
                removed = np.cumsum(change[:-1]) > 0
                n, removed_n, spans, kept = [], [], [], []
                begin = 0
                for end in ends.tolist():
                    gone, bytes_ = removed[begin:end], data[begin:end]
                    count = int(gone.sum())
                    n.append(end - begin)
                    removed_n.append(count)
                    spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                    if count and as_text:  # a character stays whole where any of its bytes stays
                        character = np.cumsum((bytes_ & 0xC0) != 0x80) - 1
                        gone = (np.bincount(character, ~gone) == 0)[character]
                    left = (bytes_[~gone] if count else bytes_).tobytes()
                    kept.append(left.decode() if as_text else left)
                    begin = end
                columns = [lists[k].values, *[pa.array(x, pa.int64()) for x in (n, removed_n, spans)], pa.array(kept, pa.string() if as_text else pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return resolved.select("batch", "ids", "known", "ends", "data", "answers", "found", "doc").mapInArrow(remove, out)


def repeated_bytes_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_bytes(docs.select("doc_id", "text"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated characters gone from text; texts of which nothing is left go. A column n_chars of whole numbers is the count as it is now, one of another type stays."""
    found = repeated_bytes(docs, as_text=True)
    gone = (F.col("n_removed") > 0) & (F.trim("kept") == "")
    columns = {"text": F.col("kept")} | {c: F.char_length("kept").cast(kind) for c, kind in docs.dtypes if c == "n_chars" and kind in ("int", "bigint")}
    return found.filter(~gone).select(*[columns[c].alias(c) if c in columns else F.col("doc")[c].alias(c) for c in docs.columns])

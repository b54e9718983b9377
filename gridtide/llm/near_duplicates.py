"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct five-word shingles, as 64-bit hashes. SLOTS b-bit min-hashes sign a
set; the share of equal slots estimates the similarity. The slots are split in chunks. Two
signatures that differ in at most MAX_DISTANCE slots leave, by the pigeonhole principle, some chunk
with at most CHUNK_ERRORS differing slots; so each chunk is indexed under every choice of
slots left out, and all pairs under the distance meet in a bucket. Pairs that meet over that distance are dropped.
(A pair with similarity 0.85 is missed with a probability of about 2e-9, one with 0.8 with about 2e-7.)

Copies (equal sets) are one class and count once. Pairs within the distance are confirmed on full sets, after a bound that
loses none: an odd sketch (one bit for each remainder of the hashes, flipped by each) of two sets differs in no more bits
than the sets differ in elements, so pairs whose sketches differ in more bits than a link allows are no links.

Not all pairs in a bucket have to be confirmed to know the components. First each class is paired with the
hub of its bucket, the class that meets most others. Then only classes of the same bucket that are still in different components
are paired, all of them, each pair in the first bucket it shares; so no link that could join two components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, field, scratch, staged, wrapped

WORDS = 5
SLOTS, CHUNK, CHUNK_ERRORS = 36, 4, 1
MAX_DISTANCE = SLOTS // CHUNK * (CHUNK_ERRORS + 1) - 1
SLOT_BITS = 16
#: Bits of each slot that the distance is measured by; slots that differ in none of them count as equal.
PLANES = 8
SKETCH_BITS = 1024
ID_HASHES = 1 << 20
#: Bytes whose words are hashed at a time.
BLOCK = 1 << 16
#: Slots that each of a chunk's keys is made of.
KEPT_SLOTS = tuple(combinations(range(CHUNK), CHUNK - CHUNK_ERRORS))

_RNG = np.random.default_rng(20240501)
_POWERS = np.cumprod(np.full(256, _RNG.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1), np.uint64))
_PLACES = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_SEEDS = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first places of the words of data that ends with white space."""
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    hashed = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255], first)
    if lengths.max() > 256:  # long words: the powers repeat, so mark each round of them
        far = (place >> 8).astype(np.uint64)
        hashed = hashed + np.add.reduceat(_mix((far << np.uint64(16)) + (place & 255).astype(np.uint64) * np.uint64(256) + data[at]) * (far > 0), first)
    return _mix(hashed + lengths.astype(np.uint64)), at[first]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes other than ASCII white space), and where each text's words end.

    The bytes are taken in blocks that a processor's cache holds, cut at white space.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    spaces = np.flatnonzero(_SPACE[data])
    cuts = np.unique(spaces[np.searchsorted(spaces, np.arange(BLOCK, len(data) + BLOCK, BLOCK).clip(max=max(0, len(data) - 1)))] + 1) if len(data) else spaces
    hashed, places, begin = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for end in cuts.tolist():
        found, first = _hashed_words(data[begin:end])
        hashed.append(found)
        places.append(first + begin)
        begin = end
    return np.concatenate(hashed), np.searchsorted(np.concatenate(places), np.cumsum([len(x) + 1 for x in texts]))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than WORDS words, one of them all; without words, none."""
    words, ends = word_hashes([x.lower() for x in texts])  # bytes.lower() lowers A-Z only
    n = len(words) - WORDS + 1
    if n > 0:
        mixed = np.zeros(n, np.uint64)
        for k in range(WORDS):
            mixed += words[k : k + n] * _PLACES[k]
        mixed = _mix(mixed)
    sets, begin = [], 0
    for end in ends.tolist():
        count = end - begin
        if count >= WORDS:
            sets.append(np.unique(mixed[begin : end - WORDS + 1]))
        elif count:
            sets.append(_mix((words[begin:end] * _PLACES[:count]).sum(keepdims=True, dtype=np.uint64) + np.uint64(count)))
        else:
            sets.append(words[:0])
        begin = end
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """SLOTS hashes of SLOT_BITS bits, each of the smallest value of one order. (The leading bits of the smallest value itself
    would be nearly the same for all long texts.)"""
    best = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        values = shingles[at : at + 4096, None] * _SEEDS
        values ^= values >> np.uint64(29)
        best = np.minimum(best, (values * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    return (_mix(best) >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)


def planes(signs: np.ndarray) -> np.ndarray:
    """For each of the low PLANES bits of the slots, a long of that bit of all slots."""
    bits = (signs.astype(np.uint64) >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return (bits << np.arange(SLOTS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, each the parity of the hashes with that remainder, as longs."""
    return np.packbits(np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).view(np.int64)


def _longs(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets([(x or "").encode() for x in batch.column(1).to_pylist()])
        n = pa.array([len(x) for x in sets], pa.int64())
        digest = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
        signs = [signature(x) for x in sets]
        chunks = _longs([x.view(np.int64) for x in signs], SLOTS // CHUNK)
        bits = _longs([planes(x) for x in signs], PLANES)
        odd = _longs([odd_sketch(x) for x in sets], SKETCH_BITS // 64)
        yield pa.RecordBatch.from_arrays([batch.column(0), n, digest, chunks, bits, odd], names=["doc_id", "n", "digest", "chunks", "planes", "odd"])


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk with every choice of CHUNK_ERRORS slots left out, as one long, and the number of chunk and choice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.asarray(batch.column(1).flatten()).view(np.uint16).reshape(-1, SLOTS).astype(np.uint64)
        keys = []
        for chunk in range(SLOTS // CHUNK):
            for kept in KEPT_SLOTS:
                key = np.full(len(signs), len(keys), np.uint64)
                for slot in kept:
                    key = (key << np.uint64(SLOT_BITS)) | signs[:, chunk * CHUNK + slot]
                keys.append(key)
        cls = np.repeat(np.asarray(batch.column(0)), len(keys))
        k = np.tile(np.arange(len(keys), dtype=np.int32), len(signs))
        yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).ravel().view(np.int64)), pa.array(cls), pa.array(k)], names=["key", "cls", "k"])


def _first_shared(a: str, b: str) -> Column:
    """The number of the first key that two classes share, from their chunks."""
    first = None
    for k in range(SLOTS // CHUNK * len(KEPT_SLOTS)):
        chunk, kept = k // len(KEPT_SLOTS), KEPT_SLOTS[k % len(KEPT_SLOTS)]
        mask = sum(((1 << SLOT_BITS) - 1) << (SLOT_BITS * slot) for slot in kept)
        differs = F.get(F.col(a), F.lit(chunk)).bitwiseXOR(F.get(F.col(b), F.lit(chunk))).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        first = F.when(differs == 0, k) if first is None else first.when(differs == 0, k)
    return first


def _may_link(percent: int, a: str = "a", b: str = "b") -> Column:
    """False where signatures differ in more than MAX_DISTANCE slots, or sizes or sketches show that two sets are no link. With s elements
    in both and d in one only, a link has d * (100 + percent) <= s * (100 - percent), and sketches differ in at most d bits."""
    differing = reduce(Column.bitwiseOR, [F.get(F.col(f"planes_{a}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"planes_{b}"), F.lit(i))) for i in range(PLANES)])
    bits = sum(F.bit_count(F.get(F.col(f"odd_{a}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"odd_{b}"), F.lit(i)))) for i in range(SKETCH_BITS // 64))
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (F.bit_count(differing) <= MAX_DISTANCE) & (bits * (100 + percent) <= (n_a + n_b) * (100 - percent))


def component_labels(edges: DataFrame, *, stored: bool = False) -> DataFrame:
    """cls, label: the smallest class that edges (a, b) reach, for each class with an edge. Edges that are ``stored`` already are read as they are.

    Each round takes the smallest label among neighbours, then the label's own label, so paths shorten
    by half; rounds are cut by tables in the shared folder and end when nothing changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both if stored else staged(both.distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("cls").alias("b"), "label"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "cls").select("cls", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("cls").alias("label"), F.col("label").alias("top"))
        following = staged(lower.join(up, "label", "left").select("cls", "was", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        changed = following.filter("label <> was").limit(1).count()
        labels = following.select("cls", "label")
        if not changed:
            return labels


def _merged(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus: joined by sorting at every size, never broadcast."""
    return side.hint("merge")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and set (binary) of the classes in wanted (cls, digest, rep): the texts of their first documents are hashed again."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(x or "").encode() for x in batch.column(2).to_pylist()])
            same = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == d for x, d in zip(sets, batch.column(1).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "set"])
            yield out.filter(pa.array(same, pa.bool_()))

    # Most texts aren't wanted: hashes of the ids, at most ID_HASHES rows however large the corpus, drop them before the shuffle.
    def hashed_id(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(ID_HASHES))

    some = wanted.select(hashed_id("rep").alias("__h")).distinct()
    texts = docs.select(F.col("doc_id").alias("__d"), "text", hashed_id("doc_id").alias("__h")).join(F.broadcast(some), "__h", "left_semi")
    found = _merged(wanted).join(texts, F.col("rep").eqNullSafe(F.col("__d"))).select("cls", "digest", "text")
    return found.mapInArrow(hashed, "cls long, set binary")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    pairs = staged(pairs, "pairs")
    members = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = staged(members.join(_merged(classes.select("cls", "digest", "rep")), "cls"), "wanted")
    sets = staged(_sets_of(docs, wanted).dropDuplicates(["cls"]), "sets", compression="none")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(_merged(sets.select(F.col("cls").alias("a"), F.col("set").alias("x"))), "a").join(_merged(sets.select(F.col("cls").alias("b"), F.col("set").alias("y"))), "b")
    return staged(joined.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), digest; one row for each row of docs.

    Documents with equal sets are linked; those without words are linked with nothing. A null doc_id
    is never a component's id unless it is alone with no other id. Repeated rows each give a row. Other columns are
    ignored. An empty table gives no rows. ``percent`` may be 80 or more, for which the index is set.
    """
    if percent < 80:
        raise ValueError("the index is set for a similarity of 0.8 or more")
    with scratch(docs.sparkSession):
        return staged(_near_duplicates(docs, percent), "near_duplicates", outlives=True)


def _near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([field(texts, "doc_id"), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), *[T.StructField(c, longs) for c in ("chunks", "planes", "odd")]])
    signed = staged(texts.mapInArrow(_signed, schema), "signed")
    per_class = signed.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("n", "chunks", "planes", "odd")).alias("s"))
    classes = staged(per_class.select(F.monotonically_increasing_id().alias("cls"), "digest", "rep", "s.*"), "classes")

    keys = classes.select("cls", "chunks").mapInArrow(_bucket_keys, "key long, cls long, k int")
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = staged(keys.join(_merged(shared), "key"), "members")
    weights = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    hubs = members.join(_merged(weights), "cls").groupBy("key").agg(F.max(F.struct("weight", "cls"))["cls"].alias("hub"))
    with_hub = staged(members.join(_merged(hubs), "key").select("key", "k", "cls", "hub").filter("cls <> hub"), "with_hub")

    def side(x: str, *more: str) -> DataFrame:
        return classes.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "planes", "odd", *more)])

    stars = with_hub.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()
    near_stars = stars.join(_merged(side("a")), "a").join(_merged(side("b")), "b").filter(_may_link(percent)).select("a", "b")
    links = _confirmed(near_stars, classes, texts, percent)
    labels = component_labels(links)

    # Members of a bucket, but its hub, whose components differ still.
    labelled = with_hub.join(_merged(labels), "cls", "left").select("key", "k", "cls", F.coalesce("label", "cls").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("one"), F.max("label").alias("two")).filter("one < two").select("key")
    open_members = staged(labelled.join(_merged(mixed), "key").join(_merged(classes.select("cls", "n", "chunks", "planes", "odd")), "cls"), "open_members")
    x, y = (open_members.select("key", *(["k"] if s == "a" else []), F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("label", "n", "chunks", "planes", "odd")]) for s in ("a", "b"))
    new = (F.col("a") < F.col("b")) & (F.col("label_a") != F.col("label_b")) & _may_link(percent) & (F.col("k") == _first_shared("chunks_a", "chunks_b"))
    across = x.withColumnRenamed("key", "key_a").join(_merged(y), (F.col("key_a") == F.col("key")) & new).select("a", "b")
    more = _confirmed(across, classes, texts, percent)
    labels = component_labels(links.unionByName(more))

    component = classes.join(labels, "cls", "left").select("digest", "rep", F.coalesce("label", "cls").alias("label"))
    smallest = component.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = component.join(smallest, "label").select("digest", "component_id")
    return signed.join(of_class, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "digest")


def near_duplicate_report(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group: that with the smallest doc_id. Rows without a doc_id stay; of rows equal in doc_id and text one stays."""
    with scratch(docs.sparkSession):
        kept = staged(near_duplicate_report(docs, percent).filter("kept").groupBy(F.col("doc_id").alias("__d")).agg(F.count("*").alias("rows")), "kept", outlives=True)
    found = wrapped(docs).join(kept.select("__d"), F.col("doc.doc_id").eqNullSafe(F.col("__d")), "left_semi")
    if kept.filter("rows > 1").limit(1).count():
        found = found.select("doc", F.col("doc.doc_id").alias("d"), F.col("doc.text").alias("t")).dropDuplicates(["d", "t"])
    return found.select("doc.*")

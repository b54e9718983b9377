"""Jaccard join of word 4-shingle sets by prefixes under several global orders of shingles.

A link needs ``percent`` of the union in both, so at least o = ceil(percent * n / 100) of a set's n shingles are in the other. Under any order that is the
same for all sets, the first n - o + 1 shingles of both sets, their prefixes, hold the first shingle that they share. ORDERS different orders are used; a link has
to pass all of them:

* Order k puts the shingles with hash % PARTS = k first, rarest first (by the number of sets that hold them), and then all others by hash. So only about a
  PARTS-th of all shingles have to be counted for an order, and sets whose prefix no other set shares leave after the first one.
* The sets that are left are counted again under the other orders; those with a prefix that stands alone under any of them leave.
* Sets meet by the first order's prefix shingles. Of a pair, the prefixes of each further order have to share a bit (of BITS); the places of the shingle that
  it meets by bound the overlap; sizes and parity sketches bound it too. None of these loses a link.

Equal sets are one class and count once. What is left of the pairs is verified on full sets. Not all pairs have to be verified to know the components: the classes of a group are
parted by each of LEAST least hashes of their whole sets, which near sets are likely to share, and each is paired with the hub of its part, the class that meets most others. Then all
classes of a group that are still in different components are compared, in blocks of BLOCK, so that no task holds a large group and no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, field, scratch, staged
from .near_duplicates import _mix, component_labels, odd_sketch, word_hashes

WORDS = 4
ORDERS, PARTS = 3, 5
#: Bits that a prefix of a further order is folded to, and bits of a set's parity sketch.
BITS, SKETCH_BITS = 256, 1024
#: Classes of a group that one task compares with one another.
BLOCK = 1 << 10
#: Prefix shingles that stand before one, of which a row in its group keeps the nearest, so that pairs meet by the first they share.
BEFORE = 8
#: Pairs of a class that are verified at first; each further step takes as many times more.
FIRST_PAIRS = 8
#: Least hashes that groups are parted by.
LEAST = 3
#: Hashes of ids that are sent to all tasks to find the texts of wanted classes: this many at most, however large the corpus.
ID_HASHES = 1 << 20

_SEEDS = np.random.default_rng(20240504).integers(1, 1 << 63, LEAST, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(20240503).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than WORDS words, one of them all; without words, none."""
    words, ends = word_hashes([x.lower() for x in texts])  # bytes.lower() lowers A-Z only
    n = max(0, len(words) - WORDS + 1)
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


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """LEAST least hashes of a set; two sets share one as often as they are similar."""
    return np.array([_mix(shingles * seed).min() for seed in _SEEDS] if len(shingles) else [0] * LEAST, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def pool(shingles: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of a set that its prefix under an order is taken from, and how many of them are of the order's part.

    If there are fewer than the prefix needs, the smallest hashes of the others follow them.
    """
    part = shingles % np.uint64(PARTS) == np.uint64(order)
    own, lacking = shingles[part], prefix_length(len(shingles), percent) - int(part.sum())
    return (np.concatenate([own, shingles[~part][:lacking]]), len(own)) if lacking > 0 else (own, len(own))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32)), pa.array(flat))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sorted_side(side: DataFrame) -> DataFrame:
    """A side that grows with the corpus: joined by sorting at every size, never broadcast."""
    return side.hint("merge")


def _outside(token: str, order: Column) -> Column:
    """Whether a shingle (an unsigned number, held as a long) is outside the part of an order."""
    return F.expr(f"(shiftrightunsigned({token}, 1) % {PARTS} * 2 + ({token} & 1)) % {PARTS}") != order


def _prefixes(pools: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Of pools (keys, n, own, tokens): n, tokens and alone: the prefix shingles that pools of other sets hold too, by frequency, and how many shingles are known to come before them.

    keys are the class and, if pools are of several orders, the order's number. Shingles that stand alone are the first of an order, so the shared ones are the prefix's end.
    """
    of_order, order = keys[1:], F.col(keys[1]) if keys[1:] else F.lit(0)
    rows = pools.select(*keys, F.explode("tokens").alias("token"))
    counts = rows.groupBy(*of_order, "token").agg(F.count("*").alias("df")).filter("df > 1")
    # The order itself: its part by frequency, then the others by their unsigned hash.
    away = _outside("token", order)
    place = F.struct(away.alias("away"), F.when(away, F.lit(0)).otherwise(F.col("df")).alias("df"), F.col("token").bitwiseXOR(F.lit(-(1 << 63))).alias("hash"), "token")
    found = rows.join(_sorted_side(counts), [*of_order, "token"]).groupBy(*keys).agg(F.sort_array(F.collect_list(place)).alias("found"))
    joined = pools.drop("tokens").join(_sorted_side(found), keys).withColumn("length", F.expr(f"n - ({percent} * n + 99) div 100 + 1"))
    alone = joined.withColumn("alone", F.when(F.col("own") >= F.col("length"), F.col("own") - F.size("found")).otherwise(F.lit(0)).cast("long"))
    # With fewer shingles in the order's part than the prefix has, the pool is the prefix.
    cut = F.when(F.col("own") >= F.col("length"), F.slice("found", F.lit(1), F.greatest(F.col("length") - F.col("alone"), F.lit(0)).cast("int"))).otherwise(F.col("found"))
    return alone.select(*keys, "n", "alone", cut["token"].alias("tokens")).filter(F.size("tokens") > 0)


def _folded(tokens: str) -> Column:
    """BITS bits, one for each token's remainder, as longs."""
    return F.array(*[F.expr(f"aggregate({tokens}, 0L, (bits, t) -> IF(pmod(shiftrightunsigned(t, 32), {BITS}) div 64 = {k}, bits | shiftleft(1L, CAST(pmod(shiftrightunsigned(t, 32), 64) AS INT)), bits))") for k in range(BITS // 64)])


def _sets_of(texts: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """cls, n, set (binary), its parity sketch, its least hashes, and its pools of the further orders, of the classes in wanted (cls, digest, rep): the texts of their first documents are hashed again."""
    more = [f"{c}{k}" for k in range(1, ORDERS) for c in ("own", "tokens")]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(x or "").encode() for x in batch.column(2).to_pylist()])
            same = pa.array([_digest(x) == d for x, d in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), _lists([odd_sketch(x) for x in sets]), _lists([least_hashes(x) for x in sets])]
            for k in range(1, ORDERS):
                pools = [pool(x, k, percent) for x in sets]
                columns += [pa.array([own for _, own in pools], pa.int64()), _lists([x for x, _ in pools])]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "set", "odd", "mins", *more]).filter(same)

    def hashed_id(c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(ID_HASHES))

    some = wanted.select(hashed_id("rep").alias("__h")).distinct()
    found = texts.select(F.col("doc_id").alias("__d"), "text", hashed_id("doc_id").alias("__h")).join(F.broadcast(some), "__h", "left_semi")
    joined = _sorted_side(wanted).join(found, F.col("rep").eqNullSafe(F.col("__d"))).select("cls", "digest", "text")
    kinds = ", ".join(f"own{k} long, tokens{k} array<long>" for k in range(1, ORDERS))
    return joined.mapInArrow(hashed, f"cls long, n long, set binary, odd array<long>, mins array<long>, {kinds}").dropDuplicates(["cls"])


def _may_link(percent: int, a: str = "a", b: str = "b") -> Column:
    """False where sizes, prefixes of further orders, or parity sketches show that two sets are no link.

    With s shingles in both and d in one only, a link has d * (100 + percent) <= (n_a + n_b) * (100 - percent), and sketches differ in at most d bits.
    """
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    sized = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    shared = [reduce(Column.bitwiseOR, [F.get(F.col(f"bits{k}_{a}"), F.lit(i)).bitwiseAND(F.get(F.col(f"bits{k}_{b}"), F.lit(i))) for i in range(BITS // 64)]) != 0 for k in range(1, ORDERS)]
    odd = sum(F.bit_count(F.get(F.col(f"odd_{a}"), F.lit(i)).bitwiseXOR(F.get(F.col(f"odd_{b}"), F.lit(i)))) for i in range(SKETCH_BITS // 64))
    return reduce(Column.__and__, shared, sized) & (odd * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, and what else they carry) with 100 * intersection >= percent * union on full sets."""
    carried = pairs.columns

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(carried).filter(pa.array(keep, pa.bool_()))

    x, y = (_sorted_side(sets.select(F.col("cls").alias(c), F.col("set").alias(f"set_{c}"))) for c in "ab")
    return staged(pairs.join(x, "a").join(y, "b").select(*carried, "set_a", "set_b").mapInArrow(similar, pairs.schema), "links")


def jaccard_join(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links); one row for each row of docs.

    Documents are linked if their sets of WORDS-word shingles share ``percent`` of their union or more; equal sets are linked, sets without words are linked with
    nothing. A null text has no words. A null doc_id is never a component's id unless it is alone with no other id. Repeated rows each
    give a row. Other columns are ignored. An empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    with scratch(docs.sparkSession):
        return staged(_jaccard_join(docs, percent), "jaccard", outlives=True)


def _jaccard_join(docs: DataFrame, percent: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([(x or "").encode() for x in batch.column(1).to_pylist()])
            pools = [pool(x, 0, percent) for x in sets]
            columns = [pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()), pa.array([own for _, own in pools], pa.int64()), _lists([x for x, _ in pools])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "digest", "own", "tokens"])

    schema = T.StructType([field(texts, "doc_id"), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("own", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])
    with scratch(docs.sparkSession):
        first = staged(texts.mapInArrow(signed, schema), "signed")
        signs = staged(first.select("doc_id", "n", "digest"), "signs", outlives=True)
        per_class = first.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("n", "own", "tokens")).alias("s"))
        all_classes = staged(per_class.select(F.monotonically_increasing_id().alias("cls"), "digest", "rep", "s.*"), "pools")
        classes = staged(all_classes.select("cls", "digest", "rep"), "classes", outlives=True)
        prefixes = staged(_prefixes(all_classes.select("cls", "n", "own", "tokens"), ["cls"], percent), "prefixes", outlives=True)
    wanted = staged(prefixes.select("cls").join(_sorted_side(classes), "cls"), "wanted")
    sets = staged(_sets_of(texts, wanted, percent), "sets", compression="none")

    further = reduce(DataFrame.unionByName, [sets.select("cls", F.lit(k).alias("k"), "n", F.col(f"own{k}").alias("own"), F.col(f"tokens{k}").alias("tokens")) for k in range(1, ORDERS)])
    bits = _prefixes(further, ["cls", "k"], percent).groupBy("cls").agg(F.count("*").alias("orders"), *[F.max(F.when(F.col("k") == k, _folded("tokens"))).alias(f"bits{k}") for k in range(1, ORDERS)])
    passed = bits.filter(F.col("orders") == ORDERS - 1).drop("orders")
    held = ("n", "odd", *[f"bits{k}" for k in range(1, ORDERS)])
    sides = staged(passed.join(_sorted_side(sets.select("cls", "odd")), "cls").join(_sorted_side(prefixes), "cls"), "sides")

    # Groups of the first order's prefix shingles. Rows carry no more than a shingle and a class; what else is needed is joined by class.
    index = sides.select(F.explode("tokens").alias("token"), "cls")
    sizes = index.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    met = staged(index.join(_sorted_side(sizes), "token"), "met")
    weights = met.groupBy("cls").agg(F.sum("size").alias("weight"))
    rows, of_class = met.select("token", "cls"), staged(weights.join(_sorted_side(sets.select("cls", "mins")), "cls"), "of_class")

    def side(x: str) -> DataFrame:
        return _sorted_side(sides.select(F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in held]))

    # Hubs of the parts of each group, by each of the least hashes.
    parts = staged(rows.join(_sorted_side(of_class.select("cls", "weight", F.posexplode("mins").alias("r", "least"))), "cls"), "parts")
    hubs = parts.groupBy("token", "r", "least").agg(F.max(F.struct("weight", "cls")).alias("best"), F.count("*").alias("size")).filter("size > 1").select("token", "r", "least", F.col("best.cls").alias("hub"))
    stars = parts.drop("weight").join(_sorted_side(hubs), ["token", "r", "least"]).filter("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
    tested = staged(stars.join(side("a"), "a").join(side("b"), "b").filter(_may_link(percent)).select("a", "b"), "pairs")
    labels = component_labels(_verified(tested, sets, percent), stored=True)

    # What the hubs leave: classes of a group that are still in different components.
    label_of = staged(of_class.select("cls").join(_sorted_side(labels), "cls", "left").select("cls", F.coalesce("label", "cls").alias("label")), "label_of")
    now = rows.join(_sorted_side(label_of), "cls")
    blocks = F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}")
    mixed = now.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks.alias("blocks")).filter("low < high").select("token", "blocks")
    before = F.slice("tokens", F.greatest(F.col("at") - (BEFORE - 1), F.lit(1)), F.least("at", F.lit(BEFORE)))
    places = sides.select("cls", "alone", "tokens", F.posexplode("tokens").alias("at", "token")).select("token", "cls", (F.col("alone") + F.col("at") + 1).alias("place"), before.alias("before"))
    open_places = places.join(_sorted_side(mixed), "token").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    left = staged(open_places.join(_sorted_side(sides.select("cls", *held)), "cls").join(_sorted_side(label_of), "cls"), "open")
    kept = ("cls", "place", "before", "label", *held)
    x = left.select("token", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), *[F.col(c).alias("a" if c == "cls" else f"{c}_a") for c in kept])
    y = left.select(F.col("token").alias("token_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("i_b"), F.col("block").alias("j_b"), *[F.col(c).alias("b" if c == "cls" else f"{c}_b") for c in kept])
    met = (F.col("token") == F.col("token_b")) & (F.col("i") == F.col("i_b")) & (F.col("j") == F.col("j_b"))
    # If a shingle is the first that two prefixes share, no shingle before it counts to the overlap.
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    fits = (100 + percent) * reach >= percent * (F.col("n_a") + F.col("n_b"))
    once = (F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))
    first = ~F.arrays_overlap("before_a", "before_b")
    across = x.join(_sorted_side(y), met & once & (F.col("label_a") != F.col("label_b")) & fits & _may_link(percent) & first)
    ends = [F.when(F.col("a") < F.col("b"), F.col(f"label_{x}")).otherwise(F.col(f"label_{y}")).alias(f"label_{x}") for x, y in ("ab", "ba")]
    once_each = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *ends).groupBy("a", "b").agg(F.min("label_a").alias("label_a"), F.min("label_b").alias("label_b"))
    pairs = staged(once_each.join(_sorted_side(tested), ["a", "b"], "left_anti"), "pairs")
    component = classes.join(_sorted_side(labels), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    some, tests, left = FIRST_PAIRS, 0, pairs.count()
    while left:
        # Some pairs of each class, then more; what has come into one component meanwhile needs no test. Once no more are left than were tested before, all of them are.
        few = F.min(F.struct("b", "label_a", "label_b")).alias("p")
        chosen = pairs if left <= tests else staged(pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(some)).alias("k")).agg(few).select("a", "p.*"), "pairs")
        links = _verified(chosen, sets, percent)
        # Components are the nodes now: a link of classes is one of their labels.
        joined = component_labels(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), stored=True)
        newer = joined.select(F.col("cls").alias("label"), F.col("label").alias("now"))
        component = component.join(newer, "label", "left").select("cls", "digest", "rep", F.coalesce("now", "label").alias("label"))
        if chosen is pairs:
            break
        of_a, of_b = (joined.select(F.col("cls").alias(f"label_{c}"), F.col("label").alias(f"now_{c}")) for c in "ab")
        apart = pairs.join(_sorted_side(chosen.select("a", "b")), ["a", "b"], "left_anti").join(of_a, "label_a", "left").join(of_b, "label_b", "left")
        apart = apart.select("a", "b", *[F.coalesce(f"now_{c}", f"label_{c}").alias(f"label_{c}") for c in "ab"]).filter("label_a <> label_b")
        pairs, tests, some = staged(apart, "pairs"), chosen.count(), some * FIRST_PAIRS
        left = pairs.count()

    smallest = component.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = component.join(_sorted_side(smallest), "label").select("digest", "component_id")
    return signs.join(_sorted_side(of_class), "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

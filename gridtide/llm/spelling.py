"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their most frequent form.

Words are paired by pivotal grams. A word's bigrams have one global order, rarest first, then by the gram itself; its prefix are
the first EDITS * GRAM + 1 of them, and all further places of the last gram. Any such prefix holds EDITS + 1 = 2 grams that don't overlap; of all such choices,
dynamic programming over the places takes the two that stand in the fewest words: the pivots. One edit can't touch both. So if two words are
near, the one whose prefix ends earlier in the order (or either, if both end alike) has a pivot that the edit leaves
alone, which the other word holds; as that gram comes before the end of the other's prefix, it is in that prefix. Pivots therefore only meet prefix grams, not all grams.

The edit fixes places: a pivot at place i of a word of length n meets place i in words of length n, i or i + 1 in words of length n + 1,
and i or i - 1 in words of length n - 1. Pairs that meet are verified, after a bound that loses none: one edit changes at most two bits of the parity of code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch, staged

GRAM, EDITS = 2, 1
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run in this many loses a code point in :func:`counted_words`; 0 leaves all runs as they are.
MISSPELL = 97
#: Different words that a task counts before it hands the counts on.
HELD_WORDS = 400_000
#: Maximal runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")


def _without(word: bytes, h: int) -> bytes:
    """The word without its code point h % length."""
    points = word.decode()
    k = h % len(points)
    return (points[:k] + points[k + 1 :]).encode()


def text_words(doc_id: int | None, text: str | None, misspell: int = MISSPELL) -> Counter[bytes]:
    """Lower-cased (A-Z only) runs of a text and how often they stand there. A run whose crc32 with the doc_id is divided by misspell loses a code point; no run of a null doc_id does."""
    found = Counter(RUN.findall((text or "").encode().lower()))
    if misspell and doc_id is not None:
        start = zlib.crc32(f"{doc_id}:".encode())
        # All that lose a code point leave before what becomes of them comes, as that may be another that loses one.
        spoilt = {w: found.pop(w) for w in [w for w in found if zlib.crc32(w, start) % misspell == 0]}
        for word, n in spoilt.items():
            found[_without(word, zlib.crc32(word, start))] += n
    return found


def counted_words(docs: DataFrame, misspell: int = MISSPELL) -> DataFrame:
    """word and n, its occurrences in all texts, of words of LEAST_LENGTH code points or more and LEAST_COUNT occurrences or more."""
    bounded_batches(docs.sparkSession)

    def rows(held: Counter[bytes]) -> pa.RecordBatch:
        long = [(w, n) for w, n in held.items() if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in long], pa.binary()).cast(pa.string()), pa.array([n for _, n in long], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in text_words(doc_id, text, misspell).items():
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    counts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(count, "word string, n long")
    return counts.filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_code(a: int, b: int) -> int:
    return a << 21 | b


def pivotal_grams(word: str, rank: dict[int, int], freq: dict[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], int]:
    """Prefix and pivots of a word, as (gram's rank, place), and the rank that the prefix ends with."""
    points = [ord(c) for c in word]
    grams = sorted((rank[gram_code(*points[k : k + GRAM])], k) for k in range(len(points) - GRAM + 1))
    last = grams[min(EDITS * GRAM, len(grams) - 1)][0]
    prefix = [x for x in grams if x[0] <= last]
    # best[m]: least total of m + 1 grams that don't overlap, among those up to the place at hand; done: for each place before.
    places = sorted((k, g) for g, k in prefix)
    done: list[list[tuple[int, list[tuple[int, int]]] | None]] = []
    for at, (k, g) in enumerate(places):
        apart = next((done[j] for j in range(at - 1, -1, -1) if places[j][0] + GRAM <= k), [None] * (EDITS + 1))
        row = list(done[-1]) if done else [None] * (EDITS + 1)
        for m in range(EDITS + 1):
            before = (0, []) if m == 0 else apart[m - 1]
            if before and (row[m] is None or before[0] + freq[g] < row[m][0]):
                row[m] = (before[0] + freq[g], [*before[1], (g, k)])
        done.append(row)
    return prefix, done[-1][EDITS][1], last


#: Parity bits: each code point flips one of 62.
_BIT = 62


def _key(rank: int, length: int, place: int) -> int:
    return rank << 44 | length << 22 | place


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: the pairs of words (word, n; each word once, of LEAST_LENGTH code points or more) that differ by one code point, each pair once."""
    # Words are of 90 letters, so the grams are at most 8,100, however many words there are.
    points = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda k: F.substr("word", k, F.lit(GRAM)))
    freq_of = {r["gram"]: r["n"] for r in words.select(F.explode(F.array_distinct(points)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}
    ordered = sorted(freq_of, key=lambda g: (freq_of[g], g))
    rank = {gram_code(ord(g[0]), ord(g[1])): k for k, g in enumerate(ordered)}
    freq = {k: freq_of[g] for k, g in enumerate(ordered)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, probes, lasts, bits = [], [], [], []
            for word in batch.column(0).to_pylist():
                prefix, pivots, last = pivotal_grams(word, rank, freq)
                n, parity = len(word), 0
                for c in word:
                    parity ^= 1 << ord(c) % _BIT
                keys.append([_key(g, n, k) for g, k in prefix])
                probes.append([_key(g, n + d, k + s) for g, k in pivots for d, s in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)) if k + s >= 0])
                lasts.append(last)
                bits.append(parity)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, longs), pa.array(probes, longs), pa.array(np.array(lasts, np.int32)), pa.array(np.array(bits, np.int64))], names=["word", "n", "keys", "probes", "last", "parity"])

    grams = staged(words.select("word", "n").mapInArrow(indexed, "word string, n long, keys array<long>, probes array<long>, last int, parity long"), "grams")
    x, y = (grams.select(F.explode(c).alias("key"), *[F.col(k).alias(f"{k}_{s}") for k in ("word", "n", "last", "parity")]) for s, c in (("x", "probes"), ("y", "keys")))
    meets = (F.col("last_x") <= F.col("last_y")) & (F.bit_count(F.col("parity_x").bitwiseXOR(F.col("parity_y"))) <= 2) & (F.col("word_x") != F.col("word_y"))
    near = x.join(y.hint("merge").withColumnRenamed("key", "key_y"), (F.col("key") == F.col("key_y")) & meets & (F.levenshtein("word_x", "word_y", 1) == 1))
    swap = F.col("word_x") > F.col("word_y")
    return near.select(*[F.when(swap, F.col(f"{k}_{t}")).otherwise(F.col(f"{k}_{s}")).alias(name) for k, s, t, name in (("word", "x", "y", "a"), ("word", "y", "x", "b"), ("n", "x", "y", "n_a"), ("n", "y", "x", "n_b"))]).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last form that form after form leads to, from forms (word, form). Each round doubles the steps taken."""
    links = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = staged(links.join(onward.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = following.select("word", "root")
        if not following.filter("moved").limit(1).count():
            return links


def spelling_variants(docs: DataFrame, misspell: int = MISSPELL) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the texts, as :func:`counted_words` counts them.

    ``n_near`` is the number of words that differ by one code point; ``form`` is the one of these with the largest n (ties: smallest in code-point order), if
    that is at least twice the word's own n, else null; ``form_n`` is its n. ``root`` follows forms to the last. A null text has no
    words; a null doc_id spoils none. Repeated rows count as often as they stand there. Only doc_id and text are read, so other columns' names don't matter. An empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        return staged(_spelling_variants(docs, misspell), "spelling", outlives=True)


def _spelling_variants(docs: DataFrame, misspell: int) -> DataFrame:
    words = staged(counted_words(docs, misspell), "words")
    pairs = staged(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    taken = F.col("best.other").isNotNull() & (-F.col("best.less") >= 2 * F.col("n"))
    found = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    found = staged(found, "variants")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

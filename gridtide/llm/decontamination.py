"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window is ten consecutive words of an item (all its words, if fewer). A document that holds a window
holds each of its words, so it is enough to look for one: words are ordered by how rare they
are in the corpus and the rarest of each window is its prefix. Documents' words join the prefixes;
the prefix's place in the window fixes where the window would begin, which bounds drop where
it would leave the document or where the second-rarest word is not in its place; what is left is
compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, wrapped

WINDOW_WORDS = 10
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark words and windows are broadcast up to so many bytes, and shuffled beyond.
BROADCAST_BYTES = 16 << 20
#: Stands for the end of a document among its words; no word holds it.
END = "\0"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, with A-Z lowered. Null gives none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORDS), "")


def _fits(df: DataFrame, words: Column, limit: int) -> bool:
    return (df.agg(F.sum(F.octet_length(words) + F.lit(64))).first()[0] or 0) <= limit


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id string and window array of words, distinct."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), words_of(benchmark["text"]).alias("w"))
    n = F.size("w")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - WINDOW_WORDS + 1, F.lit(1))))
    return items.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(WINDOW_WORDS)).alias("window")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, digest (md5 of the text), n_words, n_hit (words inside an occurring window), n_items, items (sorted array), contaminated.

    One row for each row of docs; repeated rows each give a row. Null texts have no words. An
    item without an id marks words but is not listed. Repeated items count once. Empty tables
    give no rows or no hits. Other columns are ignored.
    """
    windows = staged(item_windows(benchmark), "windows")
    distinct = windows.select("window").distinct()
    vocabulary = distinct.select(F.explode("window").alias("word")).distinct()
    small_vocabulary = _fits(vocabulary, F.col("word"), broadcast_bytes)
    texts = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))

    # How often each benchmark word stands in the corpus; words that stand nowhere rule their windows out.
    stream = texts.select(F.explode(words_of(F.col("text"))).alias("word"))
    known = stream.join(F.broadcast(vocabulary), "word") if small_vocabulary else stream.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")
    frequency = known.groupBy("word").agg((F.count("*") if small_vocabulary else F.sum("n")).alias("n"))
    places = distinct.select("window", F.posexplode("window").alias("off", "word")).join(frequency, "word")
    rarest = Window.partitionBy("window").orderBy("n", "word", "off")
    ranked = places.select("window", "off", "word", F.row_number().over(rarest).alias("rank"), F.count("*").over(Window.partitionBy("window")).alias("present"))
    first_two = ranked.filter((F.col("present") == F.size("window")) & (F.col("rank") <= 2)).groupBy("window").agg(*[F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}{r}") for r in (1, 2) for c in ("word", "off")])
    prefixes = staged(first_two.select(F.monotonically_increasing_id().alias("window_id"), "window", F.size("window").alias("len"), F.col("word1").alias("word"), "off1", F.coalesce("off2", "off1").alias("off2"), F.coalesce("word2", "word1").alias("word2")), "prefixes")
    small_windows = _fits(prefixes, F.array_join("window", " "), broadcast_bytes)

    words = texts.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    start = F.col("pos") - F.col("off1")
    inside = (start >= 0) & (start + F.col("len") <= F.col("n_words"))

    def verified(pairs: DataFrame) -> DataFrame:
        second = F.get("w", start + F.col("off2")) == F.col("word2")
        return pairs.filter(inside & second & (F.slice("w", F.when(inside, start + 1).otherwise(F.lit(1)), F.col("len")) == F.col("window")))

    hit = F.struct(start.alias("start"), (start + F.col("len")).alias("end"))
    if small_windows:
        ended = words.select("*", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
        end_row = prefixes.sparkSession.range(1).select(F.lit(-1).cast("long").alias("window_id"), F.array(F.lit("")).alias("window"), F.lit(0).alias("len"), F.lit(END).alias("word"), F.lit(0).alias("off1"), F.lit(0).alias("off2"), F.lit(END).alias("word2"))
        pairs = ended.join(F.broadcast(prefixes.unionByName(end_row)), "word")
        is_end = F.col("word") == END
        second = F.get("w", start + F.col("off2")) == F.col("word2")
        same = F.slice("w", F.when(inside, start + 1).otherwise(F.lit(1)), F.col("len")) == F.col("window")
        hits = pairs.filter(is_end | (inside & second & same)).select("doc_id", "digest", "n_words", F.when(is_end, F.lit(1)).alias("row"), F.when(~is_end, F.col("window_id")).alias("window_id"), F.when(~is_end, hit).alias("hit"))
    else:
        places = words.select("doc_id", "digest", "n_words", F.posexplode("w").alias("pos", "word")).join(prefixes, "word").filter(inside).distinct()
        again = places.join(words.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "w").dropDuplicates(["d", "g"]), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")))
        hits = verified(again).select("doc_id", "digest", "n_words", F.lit(None).cast("int").alias("row"), "window_id", hit.alias("hit")).unionByName(words.select("doc_id", "digest", "n_words", F.lit(1).alias("row"), F.lit(None).cast("long").alias("window_id"), F.lit(None).cast("struct<start:int,end:int>").alias("hit")))

    found = staged(hits.groupBy("doc_id", "digest").agg(F.max("n_words").cast("long").alias("n_words"), F.count("row").cast("int").alias("copies"), F.sort_array(F.collect_set("hit")).alias("hits"), F.collect_set("window_id").alias("ids")), "hits")
    merged = F.aggregate("hits", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["to"], x["start"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")))
    item_ids = windows.join(prefixes.select("window_id", "window"), "window").filter(F.col("item_id").isNotNull()).select("window_id", "item_id")
    named = found.filter(F.size("ids") > 0).select("doc_id", "digest", F.explode("ids").alias("window_id")).join(item_ids, "window_id").groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "items")
    per_text = found.select("doc_id", "digest", "n_words", "copies", merged["n"].cast("long").alias("n_hit"))
    joined = per_text.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    rows = joined.select("doc_id", "digest", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), items.alias("items"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.drop("copy")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with their columns. Rows meet their verdict on doc_id and the text's digest."""
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__d"), F.col("digest").alias("__g")).distinct()
    return wrapped(docs).join(bad, F.col("doc.doc_id").eqNullSafe(F.col("__d")) & (F.md5(F.coalesce("doc.text", F.lit(""))) == F.col("__g")), "left_anti").select("doc.*")

"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at a document's figures and votes good (1), bad (-1) or abstains (0). No rule
decides alone: expectation-maximisation estimates, without labels, how often each rule gives
each vote on good and on bad documents (its accuracies), and a document is kept where the posterior
probability of being good is at least one half. Documents share vote patterns, so a fit needs only the
count of each pattern, at most 3 to the power of the number of rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "ce", "dans", "de", "des", "du", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "qui", "sur", "un", "une",
    "con", "del", "el", "las", "lo", "los", "no", "por", "que", "se", "su", "una", "y",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu",
)
#: Each rule: a name, and its vote from the figures of quality_figures, in SQL.
RULES = (
    ("symbols", "CASE WHEN n_symbols * 10 > n_words THEN -1 WHEN n_symbols = 0 THEN 1 ELSE 0 END"),
    ("repeated_lines", "CASE WHEN n_dup_lines * 5 > n_lines THEN -1 WHEN n_dup_lines = 0 THEN 1 ELSE 0 END"),
    ("repeated_words", "CASE WHEN n_repeat_words * 5 > n_words * 2 THEN -1 WHEN n_repeat_words * 5 <= n_words THEN 1 ELSE 0 END"),
    ("word_length", "CASE WHEN word_chars < n_words * 3 OR word_chars > n_words * 12 THEN -1 WHEN word_chars * 2 BETWEEN n_words * 7 AND n_words * 18 THEN 1 ELSE 0 END"),
    ("stop_words", "CASE WHEN n_stop_words * 20 < n_words THEN -1 WHEN n_stop_words * 8 > n_words THEN 1 ELSE 0 END"),
    ("capitals", "CASE WHEN n_capitals * 4 > word_chars THEN -1 WHEN n_capitals * 10 < word_chars THEN 1 ELSE 0 END"),
    ("marks", "CASE WHEN n_marks * 4 > n_words THEN -1 WHEN n_marks * 20 <= n_words THEN 1 ELSE 0 END"),
    ("length", "CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 100 THEN 1 ELSE 0 END"),
)
ROUNDS = 12
#: The prior of a bad document before the first round, by the number of bad votes: none, one, more.
FIRST_BAD = (0.05, 0.6, 0.95)
SMOOTH = 1.0
#: Of a sorted long, the bits of a window's place: more than any array can hold.
POSITION_BITS = 31
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_capitals", "n_marks")


def _item(array: Column | str, at: Column) -> Column:
    return F.get(array, at.cast("int"))


def quality_figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``doc`` (a struct of all columns of docs) and FIGURES (long).

    Words are runs of characters other than ASCII white space. A null text has no words and all
    figures 0. Repeated rows each give a row. Columns of docs keep their names inside ``doc``.
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.coalesce(docs[text], F.lit("")).alias("t"))
    words = whole.select("doc", "t", F.array_remove(F.split("t", SPACES), "").alias("w"))
    mask = (1 << POSITION_BITS) - 1

    def window_hash(at: Column) -> Column:
        return F.xxhash64(_item("w", at), _item("w", at + 1), _item("w", at + 2))

    # The windows' places, ordered by the leading bits of their hash, as plain longs, which sort fast.
    n = F.size("w")
    places = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: window_hash(i).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    figures = words.select(
        "doc", "w", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.char_length(F.regexp_replace("t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.size(F.filter("w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        lines.alias("lines"), F.sort_array(places).alias("s"),
    )

    def same_lead(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseAND(F.lit(~mask)) == y.bitwiseAND(F.lit(~mask)), F.lit(False))

    # Places whose leading bits recur, then an exact order by the whole hash for those few.
    recurring = figures.select(
        "doc", *[c for c in FIGURES if c in figures.columns], "w",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.filter("s", lambda x, k: same_lead(x, _item("s", k + 1)) | ((k > 0) & same_lead(x, _item("s", F.greatest(k - 1, F.lit(0)))))).alias("c"),
    )
    kept = [c for c in FIGURES if c in recurring.columns]
    exact = recurring.select("doc", *kept, F.sort_array(F.transform("c", lambda x: F.struct(window_hash(x.bitwiseAND(F.lit(mask))).alias("h"), x.bitwiseAND(F.lit(mask)).alias("at")))).alias("e"))
    found = exact.select("doc", *kept, F.sort_array(F.transform(F.filter("e", lambda x, k: F.coalesce(x["h"] == _item("e", k + 1)["h"], F.lit(False)) | ((k > 0) & F.coalesce(x["h"] == _item("e", F.greatest(k - 1, F.lit(0)))["h"], F.lit(False)))), lambda x: x["at"])).alias("r"))
    covered = F.aggregate(F.transform("r", lambda at, k: F.least(F.lit(3).cast("long"), F.coalesce(_item("r", k + 1) - at, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select("doc", *kept, covered.alias("n_repeat_words"), F.size("r").alias("__n_windows")).drop("__n_windows")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def with_votes(figures: DataFrame) -> DataFrame:
    """The figures and a column vote_<rule> for each rule."""
    return figures.select("*", *[F.expr(f"CAST({vote} AS INT)").alias(f"vote_{name}") for name, vote in RULES])


@dataclass(frozen=True)
class QualityModel:
    """Log-odds of good to bad: of a document without votes, and of each rule's votes (bad, abstain, good)."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]

    def posterior(self) -> Column:
        """Probability of good, from the votes."""
        odds = F.lit(self.prior)
        for (name, _), (bad, none, good) in zip(RULES, self.weights, strict=True):
            vote = F.col(f"vote_{name}")
            odds = odds + F.when(vote < 0, F.lit(bad)).when(vote > 0, F.lit(good)).otherwise(F.lit(none))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit_quality_model(votes: DataFrame, rounds: int = ROUNDS) -> QualityModel:
    """Expectation-maximisation over all vote patterns; each round is one small aggregate.

    An empty table gives a model that keeps everything.
    """
    names = [f"vote_{name}" for name, _ in RULES]
    patterns = staged(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "vote_patterns")
    n_bad = sum((F.col(c) < 0).cast("int") for c in names)
    bad = F.when(n_bad == 0, F.lit(FIRST_BAD[0])).when(n_bad == 1, F.lit(FIRST_BAD[1])).otherwise(F.lit(FIRST_BAD[2]))
    model = QualityModel(0.0, tuple((0.0, 0.0, 0.0) for _ in RULES))
    for _ in range(rounds):
        weighted = patterns.select("*", (F.col("n") * bad).alias("bad"), (F.col("n") * (F.lit(1.0) - bad)).alias("good"))
        sums = [F.sum(F.when(F.col(c) == v, F.col(kind)).otherwise(0.0)).alias(f"{kind}_{c}_{v}") for c in names for v in (-1, 0, 1) for kind in ("bad", "good")]
        row = weighted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), *sums).first()
        if row["bad"] is None:
            break
        share = {kind: {(c, v): (row[f"{kind}_{c}_{v}"] + SMOOTH) / (row[kind] + 3 * SMOOTH) for c in names for v in (-1, 0, 1)} for kind in ("bad", "good")}
        weights = tuple(tuple(math.log(share["good"][c, v] / share["bad"][c, v]) for v in (-1, 0, 1)) for c in names)
        model = QualityModel(math.log((row["good"] + SMOOTH) / (row["bad"] + SMOOTH)), weights)
        bad = F.lit(1.0) - model.posterior()
    return model


def judged(votes: DataFrame, model: QualityModel) -> DataFrame:
    """Adds base_failed, p_good and kept."""
    return votes.withColumns({"base_failed": base_failed(), "p_good": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, figures, votes, base_failed, p_good and kept of every document. The texts are read once."""
    figures = quality_figures(docs.select("doc_id", "text"))
    votes = staged(with_votes(figures.select(F.col("doc.doc_id").alias("doc_id"), *FIGURES)), "votes")
    return judged(votes, fit_quality_model(votes))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns. Rows are staged with their votes, so that the texts are judged once."""
    names = [f"vote_{name}" for name, _ in RULES]
    votes = staged(with_votes(quality_figures(docs)).select("doc", "n_words", "n_repeat_words", *names), "votes")
    return judged(votes, fit_quality_model(votes)).filter("kept").select("doc.*")

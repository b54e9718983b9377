import re
from collections import Counter, defaultdict

import pytest

from gridtide.llm import decontamination, quality

from .conftest import prose

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def figures(text):
    text = text or ""
    words = SPACED.findall(text)
    at = defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k : k + 3])].append(k)
    repeated = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, quality.SYMBOLS)), len(lines) - len(set(lines)), len(repeated)


def test_figures(docs, rows):
    got = quality.quality_report(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = Counter()
    for d, t in rows:
        f = figures(t)
        want[(d, *f, f[0] < 50 or 100 * f[4] > 50 * f[0])] += 1
    assert Counter(map(tuple, got)) == want


def test_nothing_is_kept_of_nothing(no_docs):
    assert quality.quality_report(no_docs).count() == 0
    assert quality.keep_good(no_docs).count() == 0


def test_model_keeps_prose_and_drops_junk(spark):
    good = [(k, prose(k, 150)) for k in range(60)]
    junk = [(100 + k, " ".join(f"{x}%%%" for x in prose(k, 150).split())) for k in range(15)]
    lists = [(200 + k, " | ".join(x.upper() + "!!" for x in prose(k, 150).split())) for k in range(15)]
    docs = spark.createDataFrame(good + junk + lists, "doc_id long, text string")
    kept = {x.doc_id for x in quality.keep_good(docs).collect()}
    assert kept == {k for k, _ in good}
    report = {x.doc_id: x for x in quality.quality_report(docs).collect()}
    assert {k for k, x in report.items() if x.kept} == kept
    assert all(x.p_good > 0.9 for k, x in report.items() if k < 60)


def benchmark_rows():
    return [("a", "Light house " + prose(50, 25)), ("b", "only three words"), ("c", None), ("d", ""), (None, prose(51, 12)), ("e", prose(50, 25)), ("e", prose(50, 25)), ("f", "the the the the the the the the the the the")]


def brute(rows, bench):
    low = lambda s: s.translate({c: c + 32 for c in range(65, 91)})
    windows = defaultdict(set)
    for item, text in bench:
        w = PLAIN.findall(low(text or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(item)
    out = Counter()
    for d, t in rows:
        w, hit, items = PLAIN.findall(low(t or "")), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])] - {None}
        out[d, len(w), len(hit), len(items), ",".join(sorted(items)), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 24, 0])
def test_contamination(spark, rows, broadcast_bytes):
    more = [(100, prose(60, 30) + " " + prose(50, 25) + " " + prose(61, 10)), (101, "Only THREE, words!"), (101, "Only THREE, words!"), (102, "the " * 40), (103, prose(51, 12)), (104, prose(50, 25)[: len(prose(50, 25)) // 3])]
    docs = spark.createDataFrame([(*x, "z") for x in rows + more], "doc_id long, text string, window string")
    bench = spark.createDataFrame([(*x, "w") for x in benchmark_rows()], "item_id string, text string, word string")
    got = decontamination.contamination(docs, bench, broadcast_bytes).collect()
    want = brute(rows + more, benchmark_rows())
    assert Counter((x.doc_id, x.n_words, x.n_hit, x.n_items, ",".join(x["items"]), x.contaminated) for x in got) == want
    if broadcast_bytes:
        kept = decontamination.drop_contaminated(docs, bench)
        assert kept.columns == docs.columns
        assert Counter(x.doc_id for x in kept.collect()) == Counter(k[0] for k in want.elements() if not k[-1])


def test_contamination_of_nothing(spark, docs, no_docs):
    bench = spark.createDataFrame(benchmark_rows(), "item_id string, text string")
    assert decontamination.contamination_report(no_docs, bench).count() == 0
    clean = decontamination.contamination_report(docs, bench.limit(0))
    assert clean.count() == docs.count() and clean.filter("contaminated").count() == 0

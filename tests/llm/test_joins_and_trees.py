import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gridtide.llm import jaccard_join, merkle, spelling

from .conftest import prose
from .test_duplicates import SPACED, edited, low

# Merkle trees


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(hashes):
    found = [hashes]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][k : k + 3]) for k in range(0, len(found[-1]), 3)])
    return found


def steps(tree, place):
    out = []
    for level in tree[:-1]:
        first = place // 3 * 3
        out.append(("".join(level[first:place]), "".join(level[place + 1 : first + 3])))
        place //= 3
    return out


def plain_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) to the rows of merkle_report, by lists."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0], digest(*map(value, r)), r))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels([h for _, h, _ in groups[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources]) if sources else [[]]
    out = Counter()
    for k, s in enumerate(sources):
        for place, (doc_id, leaf, r) in enumerate(groups[s]):
            proof, text = steps(trees[s], place) + steps(top, k), r[4]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            fold = digest(*map(value, (*r[:4], text)))
            for a, b in proof:
                fold = digest(a, fold, b)
            out[doc_id, leaf, trees[s][-1][0], top[-1][0], digest(*[a + b for a, b in proof]), fold, fold == top[-1][0]] += 1
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars int, text string, proof string, tree string, hash string"


def manifest_rows(n):
    r = random.Random(n)
    rows = [(k * 7, "hot" if k % 3 else f"s{k % 5}", r.choice(["en", None]), r.choice([None, k]), r.choice(["", None, "a\nb", "é\n", prose(k, 20)])) for k in range(n)]
    rows += [(1, None, None, None, None), (1, None, None, None, None), (None, "hot", "x", 1, "null\nid"), (2, "", "x", 1, "empty source"), (3, "alone", "x", 1, "\n" * 50), (3, "alone ", "x", 1, "long " * 50_000)]
    return rows + rows[:2]


@pytest.mark.parametrize("n", [2, 9, 100])
def test_merkle(spark, n):
    rows = manifest_rows(n)
    docs = spark.createDataFrame([(*x, "p", "t", None) for x in rows], MANIFEST).repartition(3)
    assert Counter(map(tuple, merkle.merkle_report(docs).collect())) == plain_manifest(rows)


def test_merkle_of_little(spark):
    assert merkle.merkle_report(spark.createDataFrame([], MANIFEST)).count() == 0
    one = [(5, "a", "en", 1, "x")]
    got = merkle.merkle_report(spark.createDataFrame([(*x, "", "", "") for x in one], MANIFEST)).collect()
    assert Counter(map(tuple, got)) == plain_manifest(one)
    assert got[0].leaf == got[0].root and got[0].verified


def test_every_kind_of_tampering_is_seen(spark):
    rows = manifest_rows(40)
    docs = spark.createDataFrame([(*x, "", "", "") for x in rows], MANIFEST)
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    from pyspark.sql import functions as F

    for column, changed in (("lang", F.concat(F.coalesce("lang", F.lit("")), F.lit("x"))), ("n_chars", F.coalesce(F.col("n_chars") + 1, F.lit(0))), ("text", F.lit(None).cast("string"))):
        found = merkle.merkle_manifest(docs, fields, "source", "doc_id", {column: changed})
        same = sum(1 for r in rows if column == "text" and r[4] is None)
        assert found.filter("verified").count() == same


# Jaccard join


def shingles(text):
    w = SPACED.findall(low(text or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])


def components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                low_, high = sorted((label[i], label[j]))
                label = [low_ if x == high else x for x in label]
    ids = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[label[k]].append(d)
    return Counter((d, len(sets[k]), min(ids[label[k]]) if sets[k] and ids[label[k]] else d) for k, (d, _) in enumerate(rows))


def joined(df, percent=85):
    return Counter(map(tuple, jaccard_join.jaccard_join(df, percent).select("doc_id", "n_shingles", "component_id").collect()))


def test_jaccard_join(docs, rows, no_docs):
    assert joined(docs) == components(rows)
    assert jaccard_join.jaccard_join(no_docs).count() == 0


FAMILIES = [(k, edited(k, prose(11, 260).split(" "), k % 5)) for k in range(90)] + [(300 + k, edited(900 + k, prose(12, 60).split(" "), k % 3)) for k in range(40)]
FAMILIES += [(500 + k, prose(700 + k, 100) + " " + prose(13, 30)) for k in range(40)] + [(600 + k, prose(11, 260)) for k in range(5)] + [(700 + k, " ".join(prose(15, 9 + k % 4).split(" ")[k % 3 :])) for k in range(30)]


@pytest.mark.parametrize(("percent", "block"), [(85, 3), (60, 1024)])
def test_every_link_of_large_groups_counts(spark, monkeypatch, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    want = components(FAMILIES, percent)
    assert len({c for _, _, c in want}) > 40
    assert joined(spark.createDataFrame(FAMILIES, "doc_id long, text string").repartition(5), percent) == want


def test_links_that_no_hub_has_are_found_in_blocks(spark, monkeypatch):
    """Many pairs of near texts around texts that are a little too far from one another."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = prose(31, 200).split(" ")
    rows = []
    for k in range(30):
        one = edited(2000 + k, base, 9)
        rows += [(10 * k, one), (10 * k + 1, edited(3000 + k, one.split(" "), 1))]
    want = components(rows)
    assert len({c for _, _, c in want}) > 20
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_percent_has_bounds(docs):
    with pytest.raises(ValueError, match="percent"):
        jaccard_join.jaccard_join(docs, 20)


def test_prefixes_of_links_meet_under_every_order():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 30, 200):
        for _ in range(30):
            both = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = r.integers(0, n // 10 + 1, 2)
            x, y = (np.unique(np.concatenate([both[k:] if s else both[: n - k], r.integers(0, 1 << 63, k, dtype=np.uint64)])) for s, k in enumerate(lost.tolist()))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 85 * (len(x) + len(y) - common):
                for order in range(jaccard_join.ORDERS):
                    pools = [set(jaccard_join.pool(z, order, 85)[0].tolist()) for z in (x, y)]
                    assert pools[0] & pools[1]


def test_shared_prefixes_follow_the_order(spark):
    """What is kept of a prefix is in the order of all sets: the order's part by frequency, then the other shingles by hash."""
    import numpy as np

    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 64, 400, dtype=np.uint64)
    sets = [np.unique(r.choice(base, n, replace=False)) for n in (3, 8, 8, 12, 20, 30, 60, 60, 120)]
    for order in range(3):
        pools = [jaccard_join.pool(x, order, 85) for x in sets]
        rows = [(k, order, len(x), own, p.view(np.int64).tolist()) for k, (x, (p, own)) in enumerate(zip(sets, pools, strict=True))]
        got = jaccard_join._prefixes(spark.createDataFrame(rows, "cls long, k int, n long, own long, tokens array<long>"), ["cls", "k"], 85).collect()
        df = Counter(t for p, _ in pools for t in p.tolist())
        for x in got:
            pool, own = pools[x.cls]
            ranked = sorted(pool.tolist(), key=lambda t: (t % jaccard_join.PARTS != order, 0 if t % jaccard_join.PARTS != order else df[t], t))
            prefix = ranked[: jaccard_join.prefix_length(len(sets[x.cls]), 85)]
            assert [t % (1 << 64) for t in x.tokens] == [t for t in prefix if df[t] > 1]
            assert all(ranked.index(t % (1 << 64)) >= x.alone + k for k, t in enumerate(x.tokens))


# Spelling variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, misspell=97):
    counts = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            w = low(run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and misspell and h % misspell == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {w: min(c, key=lambda x: (-words[x], x)) for w, c in close.items() if c}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(close[w]), words.get(form.get(w))))
    return out


def variants(df, misspell=97):
    rows = spelling.spelling_variants(df, misspell).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({x.word for x in rows})
    return set(map(tuple, rows))


def test_spelling_of_cases(docs, rows, no_docs):
    assert variants(docs, 5) == plain_variants(rows, 5)
    assert spelling.spelling_variants(no_docs).count() == 0


def misspelt(seed, n):
    """Words, each also with one edit, with letters of one and two bytes, repeated grams, and chains of forms."""
    r = random.Random(seed)
    letters = "abcdeé÷ÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "Éabcd", "éabcd"]
    for w in list(words):
        k, x = r.randrange(len(w)), r.choice(letters)
        words += [w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :]]
    return [w for w in words for _ in range(r.choice([1, 3, 6, 14, 30]))]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed):
    words = misspelt(seed, 250)
    random.Random(seed).shuffle(words)
    rows = [(k if k % 9 else None, "1 ".join(words[k::40])) for k in range(40)] + [(50, None), (51, ""), (52, "12 _ -"), (53, "Z" * 3000 + " " + "z" * 3000 + " " + "z" * 3000)]
    want = plain_variants(rows)
    assert any(w[1] and w[1] != w[2] for w in want)
    assert variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_a_run_loses_one_code_point_only(spark):
    """What a run becomes may be another run of the text that loses one too; it loses no second one."""
    rows = [(1381, "aaaaaaa " * 4 + "aaaaaa " * 8), (25298, "aaaaaaaa aaaaaaa " * 3), (3, "aaaaaa aaaaaab " * 5)]
    assert spelling.text_words(*rows[0]) == {b"aaaaaa": 4, b"aaaaa": 8}
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == plain_variants(rows)


def test_pivots_are_apart_and_cheapest():
    r = random.Random(3)
    for _ in range(300):
        word = "".join(r.choice("abc") for _ in range(r.randint(5, 12)))
        grams = {spelling.gram_code(ord(a), ord(b)) for a in "abc" for b in "abc"}
        rank = dict(zip(r.sample(sorted(grams), len(grams)), range(len(grams)), strict=True))
        freq = {k: r.randint(1, 20) for k in range(len(grams))}
        prefix, pivots, last = spelling.pivotal_grams(word, rank, freq)
        assert len(pivots) == 2 and set(pivots) <= set(prefix) and abs(pivots[0][1] - pivots[1][1]) >= 2
        assert last == max(g for g, _ in prefix) and all(g > last for g, k in ((rank[spelling.gram_code(ord(word[k]), ord(word[k + 1]))], k) for k in range(len(word) - 1)) if (g, k) not in prefix)
        least = min(freq[g] + freq[h] for g, k in prefix for h, j in prefix if abs(k - j) >= 2)
        assert freq[pivots[0][0]] + freq[pivots[1][0]] == least

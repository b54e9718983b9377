import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from gridtide.llm import near_duplicates, passages, substring_parse

from .conftest import prose

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = SPACED.findall(low(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])


def components(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    out = Counter()
    for i, (d, a) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if label[j] == label[i] and sets[j][0] is not None] if a else []
        out[d, len(a), min(ids) if ids else d] += 1
    return out


def edited(seed, words, edits):
    r = np.random.default_rng(seed)
    words = list(words)
    for k in r.choice(len(words), edits, replace=False):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


def test_near_duplicates(docs, rows):
    got = near_duplicates.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == components(rows)


def test_every_link_of_a_large_group_counts(spark):
    base = prose(11, 160).split(" ")
    rows = [(k, edited(k, base, k % 6)) for k in range(120)] + [(500 + k, prose(300 + k, 100)) for k in range(40)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = components(rows)
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == want
    assert len({c for _, _, c in want}) > 60
    kept = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, _, c in want})


def test_sketches_bound_the_difference():
    r = np.random.default_rng(1)
    for n in (1, 10, 300, 3000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 1 << 63, n, dtype=np.uint64)]))
        bits = sum(int(x).bit_count() for x in (near_duplicates.odd_sketch(a) ^ near_duplicates.odd_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_no_near_duplicates_of_nothing(no_docs, docs, rows):
    assert near_duplicates.near_duplicate_report(no_docs).count() == 0
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (1, 2)").count() == 1


def without_repeats(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if d is not None else ():
            first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49) if d is not None else ():
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


EXTRA = [(200, "中文" * 40 + "中x"), (201, "中文" * 40 + "丰y"), (202, "ab" * 400), (203, "b" + "ab" * 30), (204, "\x00" * 60 + "q"), (205, "\x00" * 55)]


@pytest.mark.parametrize("part_bytes", [1 << 24, 20_000])
def test_repeated_bytes(spark, rows, part_bytes):
    docs = spark.createDataFrame([(*x, "c") for x in rows + EXTRA], "doc_id long, text string, batch string").repartition(3)
    got = substring_parse.repeated_bytes(docs, part_bytes=part_bytes).collect()
    assert Counter((x.doc.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in got) == without_repeats(rows + EXTRA)


def test_texts_stay_text(spark, docs, no_docs):
    assert substring_parse.repeated_bytes_report(no_docs).count() == 0
    more = spark.createDataFrame(EXTRA, "doc_id long, text string")
    left = substring_parse.without_repeats(more)
    assert left.columns == more.columns
    by_id = {x.doc_id: x.text for x in left.collect()}
    assert by_id[200] == EXTRA[0][1] and by_id[201] == "丰y" and 205 not in by_id
    assert substring_parse.without_repeats(docs).columns == docs.columns


def test_suffix_groups_are_exact():
    data = np.frombuffer(b"".join([b"x" * 49 + b"ay", b"x" * 49 + b"az", b"x" * 49 + b"b"]), np.uint8)
    left, group = substring_parse.equal_strings(data, np.array([0, 51, 102]))
    assert sorted(left.tolist()) == [0, 1] and len(set(group.tolist())) == 1


def test_near_passages(spark, docs, rows, no_docs):
    assert passages.near_passages_report(no_docs).count() == 0
    got = passages.near_passages(docs).collect()
    assert Counter((x.doc_id, x.n_words) for x in got) == Counter((d, len((t or "").split())) for d, t in rows)
    spans = {x.doc_id: x.spans for x in got if x.doc_id is not None}
    assert not spans[1] and not spans[6] and not spans[14] and not spans[16]
    assert spans[2][0].source == 1 and spans[3][0].source == 1
    assert any(x.source == 4 and x.start <= 61 and x.end >= 129 for x in spans[5])


def near_words(rows):
    """Words in passages of 46 shingles of which 41 stand in a passage of a smaller doc_id, and 41 of that one's in it; by trying all pairs."""
    numbers: dict[tuple, int] = {}
    texts = {}
    for d, t in rows:
        w = SPACED.findall(low(t))
        texts[d] = np.array([numbers.setdefault(tuple(w[k : k + 5]), len(numbers)) for k in range(len(w) - 4)], np.int64)

    def counts(x, y):  # [start in x, start in y]: shingles of x's passage that stand in y's
        inside = np.zeros((len(x), len(y) + 1), np.int64)
        inside[:, 1:] = np.cumsum(x[:, None] == y[None, :], axis=1)
        has = (inside[:, 46:] - inside[:, :-46]) > 0
        sums = np.concatenate([np.zeros((1, has.shape[1]), np.int64), np.cumsum(has, axis=0)])
        return sums[46:] - sums[:-46]

    found = {d: set() for d in texts}
    for d, x in texts.items():
        for e, y in texts.items():
            if e < d and len(x) >= 46 and len(y) >= 46:
                near = (counts(x, y) >= 41) & (counts(y, x).T >= 41)
                for k in np.flatnonzero(near.any(axis=1)):
                    found[d] |= set(range(k, k + 50))
    return found


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_near_passages_against_all_pairs(spark, edits):
    base = prose(21, 90).split(" ")
    rows = [(k, prose(400 + k, 60 + k) + " " + edited(k, base, edits) + " " + prose(700 + k, 60)) for k in range(20)] + [(100 + k, prose(900 + k, 150)) for k in range(10)]
    words = edited(77, base, 1).split(" ")
    rows += [(200, " ".join([*words[:40], "one", "more", *words[40:]])), (201, "ha " * 300), (202, "x " + "ha " * 200), (203, " ".join(words[:60] + words[:60]))]
    want = near_words(rows)
    got = {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[d] <= want[d] for d in want)
    total, hit = sum(map(len, want.values())), sum(map(len, got.values()))
    print(f"{edits} edits: {hit} of {total} words")
    assert hit >= 0.95 * total
    assert not any(got[100 + k] for k in range(10))


def test_exact_passages_are_found_among_families_of_edited_copies(spark):
    """Every passage of 50 words that an earlier document holds too is covered, though its shingles stand in many other texts."""
    base = prose(41, 120).split(" ")
    family = [(k, edited(k, base, 3 + k % 4)) for k in range(25)]
    later = [(100 + k, prose(500 + k, 30) + " " + " ".join(family[k][1].split(" ")[20:100])) for k in range(25)]
    rows = family + later
    first: dict[tuple, int] = {}
    words = {d: SPACED.findall(low(t)) for d, t in rows}
    for d, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    got = {x.doc_id: x for x in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = 0
    for d, w in words.items():
        want = {i for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for i in range(k, k + 50)}
        missed += len(want - {i for x in got[d].spans for i in range(x.start, x.end)})
    assert missed == 0


def test_all_windows_of_a_group_are_compared():
    """Blocks of windows settle what trying all of their passages settles, however few of the others are near."""
    r, base = np.random.default_rng(4), np.random.default_rng(3).integers(0, 1 << 32, 91, dtype=np.uint32)

    def window(doc):
        low, first = base.copy(), int(r.integers(0, 20))
        for _ in range(int(r.integers(0, 4))):
            k = int(r.integers(0, 87))
            low[k : k + 5] = r.integers(0, 1 << 32, 5, dtype=np.uint32)
        return {"doc": doc, "shingles": low[first : first + int(r.integers(46, 72))].tobytes()}

    x, y = ([window(int(r.integers(0, 50))) for _ in range(n)] for n in (40, 150))
    sets = [[set(low[s : s + 46].tolist()) for s in range(len(low) - 45)] for w in y for low in [np.frombuffer(w["shingles"], np.uint32)]]
    want = set()
    for k, w in enumerate(x):
        low = np.frombuffer(w["shingles"], np.uint32).tolist()
        for s in range(len(low) - 45):
            if any(v["doc"] < w["doc"] and any(len(z & set(low[s : s + 46])) >= 41 for z in zs) for v, zs in zip(y, sets, strict=True)):
                want.add((k, s))
    got = [(k, s, doc) for k, starts, doc in passages.settled_by(x, y) for s in starts.tolist()]
    assert len(want) > 100 and {g[:2] for g in got} == want and len(got) == len(want)
    assert all(doc < x[k]["doc"] for k, _, doc in got)


def test_copies_with_many_different_edits(spark, monkeypatch):
    """Links among copies that are not near the smallest of their group are found, in blocks of any size."""
    base = prose(51, 90).split(" ")
    rows = [(k, edited(800 + k, base, 4)) for k in range(60)]
    want = near_words(rows)
    for size in (1 << 10, 1 << 3):
        monkeypatch.setattr(passages, "BLOCK_WINDOWS", size)
        got = {x.doc_id: {k for s in x.spans for k in range(s.start, s.end)} for x in passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        hit = sum(map(len, got.values()))
        print(f"60 copies with 4 edits, blocks of {size}: {hit} of {sum(map(len, want.values()))} words")
        assert all(got[d] <= want[d] for d in want) and hit >= 0.95 * sum(map(len, want.values()))


def test_near_passages_do_not_depend_on_ids(spark, monkeypatch):
    """Dense and sparse ids of the same texts give the same words, and parts of groups cost little."""
    base, found = prose(51, 90).split(" "), []
    texts = [edited(800 + k, base, 4) for k in range(60)]
    want = sum(map(len, near_words(list(enumerate(texts))).values()))
    for step in (1, 4096):
        rows = [(k * step, t) for k, t in enumerate(texts)]
        got = passages.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        found.append({x.doc_id // step: {k for s in x.spans for k in range(s.start, s.end)} for x in got})
    assert found[0] == found[1]
    hit = sum(map(len, found[0].values()))
    print(f"60 copies with 4 edits: {hit} of {want} words")
    assert hit >= 0.75 * want  # README has the figures

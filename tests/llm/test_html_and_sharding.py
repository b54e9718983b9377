import html
import random
import time
from collections import Counter

import pytest

from gridtide.llm import html_text, sharding
from gridtide.llm.common import new_path


def text(source):
    return html_text.render(html_text.build_tree(source))


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("plain &amp; <b>bold</b>text", "plain & boldtext"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=9><li>a</li><li>b</li></ol>", "9. a\n10. b"),
    ("<table><tr><th>Name<th>N<tr><td>Anna<td>1</table>", "Name  N\nAnna  1"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<script>var x='</p>';</script>a<style>p{}</style><!-- no -->b", "ab"), ("<p hidden>a</p><p style='display: none'>b</p>c", "c"),
    ("<head><title>t</title></head><body>x", "x"), ("<p>open <b>never closed", "open never closed"), ("1 < 2 and <", "1 < 2 and <"), ("</div></p>x", "x"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<select><option>a<option>b</select>", "a\nb"), ("<p>a\n   b\t c</p>", "a b c"), ("<a title='x>y'>z</a>", "z"),
])
def test_rendering(source, want):
    assert text(source) == want


def test_depth_and_broken_markup():
    assert text("<div>" * 20_000 + "x") == "x"
    assert text("<a href=\"x>y") in ("y", "")
    assert "z" in text("<table><td>a<table><td>b</table>z")


@pytest.mark.parametrize(("source", "want"), [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td>a<td rowspan=3>b<tr><td>c<tr><td>d<td>e</table>", "a  b\nc\nd     e"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"), ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     c\nd   e  f"),
    ("<div style='visibility:hidden'>x<b style='visibility: visible'>y</b><br>w</div>z", "y\nz"), ("<p style='display:none'><b style='visibility:visible'>x</b></p>y", "y"),
    ("<p style='x-display:none'>a</p>", "a"), ("<!-->a<!--->b<!-- > -- --!>c", "abc"), ("a</ x>b</>c<?x?>d", "abcd"), ("<a b='c'd=e>f</a>", "f"), ("<a b=\"c>d</a>e <i>f</i>", "de f"),
    ("<script>a</script b>c", "c"), ("&#65;&#x42;&#" + "0" * 9000 + "67;&#" + "9" * 9000 + ";", "ABC\ufffd"), ("<td colspan=" + "9" * 9000 + ">x", "x"),
])
def test_rendering_of_spans_and_odd_markup(source, want):
    assert text(source) == want


@pytest.mark.parametrize("source", [
    '<a b="c ' * 60_000, "<a " * 150_000, "<div>" * 100_000, '<a b=">" ' * 50_000, "<script>" + "</script " * 50_000, "<dl><dd>x" * 50_000, "<blockquote>x" * 40_000, "<table><td>x" * 40_000,
    "<table><tr>" + "<td colspan=1000>x" * 30_000, "<table>" + "<tr><td colspan=99><td>x" * 20_000, "<table><tr><td>" + "y" * 250_000 + "<td>z" + "<tr><td>a<td>b" * 16_000,
    "<table><tr>" + "".join(f"<td rowspan={65534 - i}>x" for i in range(12_000)) + "<tr><td>x" * 25_000, "<p><button>" + "<div>" * 100_000, "<" * 500_000, "<ul><li>x" * 50_000, "<b>" * 50_000 + "</i>" * 80_000,
])
def test_hostile_pages_take_time_and_room_in_proportion(source):
    start = time.process_time()
    assert len(text(source)) <= 16 * len(source)
    assert time.process_time() - start < 10


class Plain:
    """Random pages and, from the same choices, what they should show: lines of blocks, joined by their gaps."""

    def __init__(self, seed):
        self.rng, self.n = random.Random(seed), 0

    def words(self):
        self.n += 1
        return f"w{self.n}" + self.rng.choice(["", " x", " <&>"])

    def inline(self):
        shown, source = [], []
        for _ in range(self.rng.randint(1, 3)):
            w = self.words()
            kind = self.rng.randrange(5)
            if kind == 0:
                source.append(f"<span hidden>{html.escape(w)}</span>")
                continue
            source.append(html.escape(w) if kind < 3 else f"<b class='a>b'>{html.escape(w)}</b>")
            shown.append(w)
        return " ".join(shown), self.rng.choice([" ", "\n\t "]).join(source)

    def blocks(self, depth):
        """Blocks as (set apart, lines), and their source."""
        found, source = [], []
        for _ in range(self.rng.randint(1, 3)):
            kind = self.rng.choice(["p", "div", "pre", "table", "gone"] + ["ul", "ol", "quote", "section"] * (depth > 0))
            if kind in ("p", "div"):
                shown, body = self.inline()
                found.append((kind == "p", [shown] if shown else []))
                source.append(f"<{kind}>{body}" + ("" if kind == "p" else f"</{kind}>"))
            elif kind == "pre":
                lines = ["q  r", "  s"]
                found.append((True, lines))
                source.append("<pre>" + "\n".join(lines) + "</pre>")
            elif kind == "gone":
                source.append(self.rng.choice(["<!-- <p>x -->", "<script>'<p>'</script>", "<div style='display:none'><p>x</div>"]))
            elif kind == "table":
                rows = [[self.words() for _ in range(3)] for _ in range(self.rng.randint(1, 3))]
                widths = [max(len(r[k]) for r in rows) for k in range(3)]
                found.append((True, ["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in rows]))
                source.append("<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(x)}" for x in r) for r in rows) + "</table>")
            elif kind == "section":
                inner, body = self.blocks(depth - 1)
                found += inner
                source.append(f"<section>{body}</section>")
            elif kind == "quote":
                inner, body = self.blocks(depth - 1)
                found.append((True, ["  " + x if x else x for x in flat(inner)]))
                source.append(f"<blockquote>{body}</blockquote>")
            else:
                items = [self.inline() for _ in range(self.rng.randint(1, 3))]
                marks = ["- " if kind == "ul" else f"{n}. " for n in range(1, len(items) + 1)]
                found.append((True, [m + x for m, (x, _) in zip(marks, items, strict=True) if x]))
                source.append(f"<{kind}>" + "".join(f"<li>{x}" for _, x in items) + f"</{kind}>")
        return found, "".join(source)


def flat(blocks):
    lines, gap = [], False
    for apart, body in blocks:
        gap |= apart
        if body:
            lines += [""] * (gap and bool(lines)) + body
            gap = apart
    return lines


@pytest.mark.parametrize("seed", range(300))
def test_random_pages_equal_a_plain_renderer(seed):
    blocks, source = Plain(seed).blocks(3)
    assert text(source) == "\n".join(flat(blocks))


def test_names_that_clash(spark):
    pages = spark.createDataFrame([(1, "own", "<p>a")], "page_id long, text string, html string")
    with pytest.raises(ValueError):
        html_text.html_text(pages, keep=("page_id", "text"))
    assert html_text.html_text(pages, keep=("page_id",)).collect() == [(1, "a")]


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "q"), (1, "u", "<p>a", "q"), (2, None, None, None), (None, "v", "", "")], "page_id long, url string, html string, text string")
    got = html_text.html_text_report(pages).collect()
    assert Counter((x.page_id, x.url, x.text, x.n_chars, x.n_lines) for x in got) == Counter([(1, "u", "a", 1, 1)] * 2 + [(2, None, "", 0, 0), (None, "v", "", 0, 0)])
    assert html_text.html_text_report(pages.limit(0)).count() == 0


def test_store(spark, docs):
    root = new_path(spark, "store")
    with pytest.raises(ValueError):
        sharding.read(spark, root)
    for k in range(5):
        sharding.append(docs, root)
    assert sharding.versions(spark, root) == [1, 2, 3, 4, 5]
    assert sharding.compact(spark, root) == [6]
    last = sharding.runs(sharding.manifest(spark, root))
    assert len(last) == 1 and last[0].level == 1 and last[0].shards == 1
    assert sharding.read(spark, root).count() == 5 * docs.count()
    assert sharding.read(spark, root, 2).count() == 2 * docs.count()
    assert Counter(map(str, sharding.read(spark, root, 1).select(*docs.columns).collect())) == Counter(map(str, docs.collect()))


def test_one_of_two_writers_commits(spark, docs):
    root = new_path(spark, "store")
    sharding.append(docs, root)
    shards = sharding.manifest(spark, root)
    sharding.commit(spark, root, shards, 2)
    with pytest.raises(sharding.CommitConflict):
        sharding.commit(spark, root, shards, 2)
    assert sharding.versions(spark, root) == [1, 2]


def ids(spark, root):
    return Counter(x.doc_id for x in sharding.read(spark, root).select("doc_id").collect())


def test_a_writer_between_read_and_commit_loses_nothing(spark, monkeypatch):
    root, more = new_path(spark, "store"), [spark.range(k * 10, k * 10 + 2).withColumnRenamed("id", "doc_id").coalesce(1) for k in range(6)]
    commit, waiting = sharding.commit, []

    def late(spark, root, shards, version):
        if waiting:  # another writer commits first
            rows = waiting.pop()
            assert sharding.append(rows, root) == [version]
        return commit(spark, root, shards, version)

    monkeypatch.setattr(sharding, "commit", late)
    sharding.append(more[0], root)
    waiting.append(more[1])
    assert sharding.append(more[2], root) == [3]
    assert ids(spark, root) == Counter([0, 1, 10, 11, 20, 21])
    sharding.append(more[3], root)
    waiting.append(more[4])
    assert len(sharding.compact(spark, root)) == 1
    assert ids(spark, root) == Counter(10 * k + j for k in range(5) for j in range(2))
    assert len(sharding.runs(sharding.manifest(spark, root))) == 2


def test_a_commit_that_dies_half_way_blocks_nobody(spark, docs, monkeypatch):
    root = new_path(spark, "store")
    sharding.append(docs, root)
    with monkeypatch.context() as broken:
        broken.setattr(sharding, "_move_if_free", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sharding.append(docs, root)
    assert sharding.versions(spark, root) == [1] and sharding.read(spark, root).count() == docs.count()
    assert sharding.append(docs, root) == [2] and sharding.read(spark, root).count() == 2 * docs.count()
    assert len(sharding.vacuum(spark, root)) == 0
    assert len(sharding.vacuum(spark, root, older_than_seconds=0)) == 3  # one run, one manifest and its file
    assert sharding.read(spark, root).count() == 2 * docs.count()


def test_columns_keep_their_names_and_values(spark):
    rows = [(k, f"t{k}", 7, "mine", "a", "b", 3) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, level int, sequence string, arrival string, source_arrival string, run int")
    root = new_path(spark, "store")
    sharding.append(docs, root)
    assert Counter(map(tuple, sharding.read(spark, root).collect())) == Counter(rows)
    facts = sharding.read(spark, root, run_facts="facts").select("facts.*").distinct().collect()
    assert [tuple(x) for x in facts] == [(0, 1)]
    assert {(x.doc_id, x.arrival) for x in sharding.sharded_report(docs, new_path(spark, "store")).collect()} == {(k, k % 8) for k in range(9)}


def test_similar_runs_only():
    runs = [sharding.Run(str(k), k, 0, size, 1) for k, size in enumerate([100, 110, 90, 5000, 105, 120])]
    assert sorted(x.bytes for x in sharding.similar_runs(runs)) == [90, 100, 105, 110, 120]
    assert sharding.similar_runs(runs[:3]) == []


def test_arrivals(spark, docs, no_docs):
    got = sharding.sharded_report(docs.select("doc_id", "text"), new_path(spark, "store"))
    assert Counter((x.doc_id, x.arrival) for x in got.collect()) == Counter((x.doc_id, (x.doc_id or 0) % 8) for x in docs.collect())
    root = new_path(spark, "store")
    assert sharding.append(no_docs, root) == [1]
    assert sharding.read(spark, root).columns == no_docs.columns and sharding.read(spark, root).count() == 0
    assert sharding.sharded_report(no_docs, new_path(spark, "store")).count() == 0


@pytest.mark.parametrize("step", ["write", "manifest", "move", "after"])
def test_an_append_that_dies_can_be_repeated(spark, monkeypatch, step):
    """One call with two arrivals and a batch: whatever the step that it dies in, repeating it gives each row once."""
    root = new_path(spark, "store")
    first = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, part int")
    sharding.append(first, root, batch="monday")
    rows = spark.createDataFrame([(10 + k, k % 2) for k in range(4)], "doc_id long, part int")

    def lost(*_, **__):
        raise OSError("lost")

    move = sharding._move_if_free
    with monkeypatch.context() as broken:
        if step == "after":
            broken.setattr(sharding, "_move_if_free", lambda *x: (move(*x), lost()))
        else:
            broken.setattr(sharding, {"write": "_build_on_last", "manifest": "commit", "move": "_move_if_free"}[step], lost)
        with pytest.raises(OSError, match="lost"):
            sharding.append(rows, root, rows["part"], batch="tuesday")
    held = 8 if step == "after" else 4
    assert sum(ids(spark, root).values()) == held
    assert sharding.append(rows, root, rows["part"], batch="tuesday") == ([] if step == "after" else [2])
    assert ids(spark, root) == Counter([*range(4), *range(10, 14)])
    assert sharding.append(rows, root, rows["part"], batch="tuesday") == [] == sharding.append(first, root, batch="monday")
    assert len(sharding.runs(sharding.manifest(spark, root))) == 3
    sharding.compact(spark, root, fanout=3)
    assert sharding.append(rows, root, batch="tuesday") == [] and sharding.batch_version(spark, root, "tuesday") == 2
    assert sharding.append(rows, root) == [len(sharding.versions(spark, root))]


@pytest.mark.parametrize(("source", "text"), [
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol start=9><li>a<li value=20>b<li>c<li value=x>d</ol>", "9. a\n20. b\n21. c\n22. d"),
    ("<ol reversed start=2><li>a<li>b<li>c</ol>", "2. a\n1. b\n0. c"),
    ("<ol type=a start=26><li>a<li>b</ol>", "z. a\naa. b"),
    ("<ol type=I><li>a<li value=4>b<li type=i value=1999>c<li value=4000>d</ol>", "I. a\nIV. b\nmcmxcix. c\n4000. d"),
    ("<ol type=A start=0><li>a<li>b</ol>", "0. a\nA. b"),
    ("<ol><li>a<ol reversed><li>x<li>y</ol><li>b</ol>", "1. a\n   2. x\n   1. y\n2. b"),
    ("<ul type=a><li value=7>a</ul><p>z", "- a\n\nz"),
    ("a<details>x<summary>s<b>t</b></summary><p>hidden<summary>second</summary></details>b", "a\nst\nb"),
    ("<details open><summary>s</summary>shown</details>", "s\nshown"),
    ("<details>only hidden<details open><summary>in</summary></details></details>z", "z"),
])
def test_lists_and_details(source, text):
    assert html_text.render(html_text.build_tree(source)) == text

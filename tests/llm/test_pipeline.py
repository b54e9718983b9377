from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from gridtide.llm.common import new_path
from gridtide.llm.oracles import ORACLES

from .conftest import prose
from .test_duplicates import components, edited, shingles
from .test_quality_and_decontamination import brute


def test_near_duplicates_from_0_80_on(spark):
    base = prose(31, 160).split(" ")
    edits = next(e for seed in range(50) for e in [edited(seed, base, 3)] if 80 <= 100 * len(shingles(" ".join(base)) & shingles(e)) / len(shingles(" ".join(base)) | shingles(e)) < 84)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, edits), (3, prose(32, 160))], "doc_id long, text string")
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicate_groups(spark, docs, "").collect()) == [1, 3]


def texts_without_repeats(rows):
    first = {}
    for d, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        at, left = 0, []
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                left.append(c)
            at += n
        if "".join(left).strip(" ") or not any(gone):
            yield d, "".join(left)


SCHEMA = "doc_id long, text string, n_chars long, n_tokens string, ids string, doc string, vote_length string, __d string, label string"


def written(spark, rows, bench):
    root = new_path(spark, "tables")
    spark.createDataFrame([(d, t, len(t or ""), "x", "y", None, "v", "w", "l") for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_all_stages_against_plain_python(spark, vocabularies):
    import duckdb
    import tiktoken

    from gridtide.llm import bpe

    base, passage, leaked = prose(71, 150), prose(72, 60), prose(73, 20)
    rows = [(k, prose(k, 120 + k)) for k in range(20)]
    rows += [(20, base), (21, base), (22, edited(1, base.split(" "), 1)), (23, edited(2, base.split(" "), 3)), (24, edited(3, base.split(" "), 30))]
    rows += [(30 + k, prose(80 + k, 100) + " " + passage + " \u00e9\u4e2d " + prose(90 + k, 60)) for k in range(6)]
    rows += [(40, prose(101, 90) + " " + leaked + " " + prose(102, 70)), (41, None), (42, ""), (43, "too short"), (44, "ha ha ha " * 60), (45, "%%% ## " * 80), (46, prose(103, 9000))]
    rows += [(50 + k, " ".join(f"{x}%%%" for x in prose(150 + k, 150).split())) for k in range(6)]
    bench = [("a", leaked), ("b", None), (None, "")]
    root = written(spark, rows, bench)

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root.removeprefix('file:')}/documents.parquet/*.parquet'")
    cursor = con.execute(ORACLES["op6_quality_rules"])
    names = [x[0] for x in cursor.description]
    good = {x[names.index("doc_id")] for x in cursor.fetchall() if x[names.index("kept")]}
    assert {45, 43} & good == set() and {1, 20, 40} <= good
    left = [x for x in rows if x[0] in good]
    heads = Counter(c for _, _, c in components(left, 80).elements())
    left = [x for x in left if x[0] in heads]
    assert not {21, 22, 23} & {d for d, _ in left}
    left = list(texts_without_repeats(left))
    dirty = defaultdict(bool, {d: hit for d, _, _, _, _, hit in brute(left, bench)})
    left = [x for x in left if not dirty[x[0]]]
    assert dirty[40] and len(left) > 20
    encoding = tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(vocabularies.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {d: (t, len(t), encoding.encode_ordinary(t)) for d, t in left}

    got = corpus_pipeline.run(spark, root)
    assert got.columns[:-2] == [c.split()[0] for c in SCHEMA.split(", ")] and got.columns[-2:] == ["n_tokens_", "ids_"]
    found = got.collect()
    assert len(found) == len(want)
    assert {x.doc_id: (x.text, x.n_chars, np.frombuffer(x.ids_, "<u4").tolist()) for x in found} == want
    assert all((x.n_tokens, x.ids, x["label"]) == ("x", "y", "l") and x.n_tokens_ == len(want[x.doc_id][2]) for x in found)


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (None, None)]])
def test_tables_of_which_nothing_is_kept(spark, rows):
    assert corpus_pipeline.run(spark, written(spark, rows, [])).count() == 0


def small_tables(spark):
    base, passage = prose(71, 150), prose(72, 60)
    rows = [(k, prose(k, 120 + k)) for k in range(12)] + [(20, base), (21, edited(1, base.split(" "), 1)), (43, "too short")]
    rows += [(30 + k, prose(80 + k, 100) + " " + passage + " " + prose(90 + k, 60)) for k in range(4)]
    return written(spark, rows, [("a", prose(5, 12))])


def scratch_left():
    from gridtide.llm.common import Scratch

    return corpus_pipeline._LAST.get("chained", Scratch())


def test_stages_chain_without_a_copy_between_them(spark, vocabularies):
    root = small_tables(spark)
    want = Counter((x.doc_id, x.text, x.n_tokens_) for x in corpus_pipeline.run(spark, root).collect())
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, root)
    assert Counter((x.doc_id, x.text, x.n_tokens_) for x in docs.collect()) == want
    # A stage that reads what was written between takes over from none: the scratch data of the one before goes.
    again = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{root}/documents.parquet"), root)
    before = list(corpus_pipeline._LAST[root].paths)
    again.write.parquet(f"{root}/good.parquet")
    corpus_pipeline.near_duplicate_groups(spark, spark.read.parquet(f"{root}/good.parquet"), root).count()
    assert not set(before) & set(corpus_pipeline._LAST[root].paths)


def test_stages_in_a_scope_leave_nothing(spark, vocabularies):
    from gridtide.llm.common import scratch

    root = small_tables(spark)
    with scratch(spark) as own:
        docs = spark.read.parquet(f"{root}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, root)
        n = docs.count()
        assert own.paths
    assert n > 0 and not own.paths and not own.tables and root not in corpus_pipeline._LAST


def test_own_columns_of_other_types_stay(spark):
    from gridtide.llm import substring_parse

    docs = spark.createDataFrame([(1, "a" * 60, "own"), (2, "b " + "a" * 55, "own")], "doc_id long, text string, n_chars string")
    assert sorted(map(tuple, substring_parse.without_repeats(docs).collect())) == [(1, "a" * 60, "own"), (2, "b ", "own")]
    whole = substring_parse.without_repeats(docs.withColumn("n_chars", docs["doc_id"].cast("int")))
    assert dict(whole.dtypes)["n_chars"] == "int" and {x.doc_id: x.n_chars for x in whole.collect()} == {1: 60, 2: 2}

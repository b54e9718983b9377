import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.llm import bpe, token_counts, token_files
from gridtide.llm.common import new_path


@pytest.fixture(scope="module")
def tiktoken_encoding(vocabularies):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=vocabularies.PATTERN, mergeable_ranks=bpe.load_ranks(vocabularies.path("byte_bpe_50k.tiktoken")), special_tokens={})


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_token_counts_are_the_librarys(docs, rows, vocabularies):
    path = vocabularies.path("byte_bpe_50k.json")
    want = Counter((d, len((t or "").encode()), len(e.ids)) for (d, t), e in zip(rows, library(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True))
    for head_size in (200_000, 3):  # most pre-tokens meet their counts by broadcast, or by shuffle
        got = token_counts.token_counts(docs, path, head_size=head_size)
        assert Counter(map(tuple, got.collect())) == want
    report = token_counts.token_count_report(docs, path).filter("over_limit").select("doc_id").collect()
    assert sorted(x.doc_id for x in report) == sorted(d for d, _, n in want.elements() if n > 1024)


def test_texts_without_spaces_are_cut_at_the_librarys_borders(spark, vocabularies):
    path = vocabularies.path("byte_bpe_50k.json")
    texts = ["\u4e2d\u6587\u3002\u5b57\uff0c" * 3000, "a1b2,c3;" * 2000 + "<|endoftext|>" + "x=y;" * 50, "'ll's" * 60, "Z" * 3000, "\t\n\r" * 50 + "a" * 70 + "\n\n" * 40, "\u00a0\u2003" * 60]
    cut = token_counts.PreTokens(path)
    assert max(map(len, cut(texts[0]))) <= token_counts.HEAD_CHARS and all("".join(cut(x)) == x for x in texts)
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {x.doc_id: x.n_tokens for x in got} == {k: len(library(path).encode(x, add_special_tokens=False).ids) for k, x in enumerate(texts)}


def test_token_counts_of_nothing(no_docs, vocabularies):
    assert token_counts.token_counts(no_docs, vocabularies.path("byte_bpe_50k.json")).count() == 0


def test_bpe_round_trip_is_the_librarys(docs, rows, vocabularies, tiktoken_encoding):
    want = Counter()
    for d, t in rows:
        ids = np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4").tobytes()
        want[d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    got = bpe.encode_decode_digests(docs, path, vocabularies.PATTERN)
    assert Counter(map(tuple, got.collect())) == want
    apart = bpe.decode_bpe(bpe.encode_bpe(docs, path, vocabularies.PATTERN), path).select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256))
    assert Counter(map(tuple, apart.collect())) == want


@pytest.mark.parametrize(("leaf", "part"), [(1, 50), (7, 64), (100, 1000)])
def test_bpe_does_not_depend_on_where_texts_are_cut(docs, rows, vocabularies, tiktoken_encoding, leaf, part):
    short = docs.filter("text is null or length(text) < 4000")
    got = bpe.encode_bpe(short, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, leaf_chars=leaf, part_chars=part)
    want = Counter((d, tuple(tiktoken_encoding.encode_ordinary(t or ""))) for d, t in rows if len(t or "") < 4000)
    assert Counter((x.doc_id, tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in got.collect()) == want


def test_bpe_of_nothing(no_docs, vocabularies):
    assert bpe.encode_decode_digests(no_docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN).count() == 0


def test_monoid_join_is_associative(vocabularies, tiktoken_encoding):
    codes = bpe.UnitCodes(tiktoken_encoding)
    parts = ["ab", "c d", "  ", "\n x", "y z", "", " w"]
    for k in range(1, len(parts)):
        left = bpe.reduce_tree([bpe.leaf(x, codes) for x in parts[:k]], codes)
        right = bpe.reduce_tree([bpe.leaf(x, codes) for x in parts[k:]], codes)
        assert bpe.close(bpe.join(left, right, codes), codes).tolist() == tiktoken_encoding.encode_ordinary("".join(parts))


def test_token_files(spark, docs, rows, vocabularies):
    path, tokenizer = new_path(spark, "ids"), vocabularies.path("word_bpe_49k.json")
    token_files.write_token_ids(docs, path, tokenizer, file_bytes=50_000)
    tokens = token_files.read_token_ids(spark, path)
    encode = library(tokenizer).encode
    in_order = sorted(((d is not None, d or 0, t or ""), d) for d, t in rows)
    want, at = [], 0
    for (_, _, text), d in in_order:
        ids = np.array([*encode(text, add_special_tokens=False).ids, 1], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert Counter(map(tuple, token_files.token_file_report(tokens).collect())) == Counter(want)
    assert tokens.select(F.countDistinct("part")).first()[0] > 1
    plan = tokens.filter("doc_id = 4")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in plan
    assert tokens.filter("doc_id = 4").count() == 1


def test_token_ids_of_texts_that_pieces_may_not_cut(vocabularies):
    import pyarrow as pa

    path = vocabularies.path("word_bpe_49k.json")
    texts = ["\u0130stanbul e\u0301", "a<|endoftext|>b", "it'S we'LL 's''s!!'s", "\x0b\x1c\x85\xa0a\u3000b c", "\ud55c\uad6d\uc5b4 \u1112\u1161", "\u00b2\u00b3 \u00bd \u2167 \u00aa", "x\ty\r\nz", "\u017f'\u017f K \u212a", "", "   ", "\U0001f600a\u200d", "\u0391\u03a3 \u1f48", "ab1234cd " * 3000]
    flat, ends = token_files.WordIds(path).encode(pa.array(texts), 1)
    want = [[*library(path).encode(x, add_special_tokens=False).ids, 1] for x in texts]
    assert [x.tolist() for x in np.split(flat, ends[:-1])] == want


def test_token_files_of_nothing(spark, no_docs, vocabularies):
    path = new_path(spark, "ids")
    token_files.write_token_ids(no_docs, path, vocabularies.path("word_bpe_49k.json"))
    assert token_files.token_file_report(token_files.read_token_ids(spark, path)).count() == 0


def test_kept_columns_may_not_be_the_counts(docs, vocabularies):
    with pytest.raises(ValueError, match="keep"):
        token_counts.token_counts(docs, vocabularies.path("byte_bpe_50k.json"), keep=("doc_id", "n_tokens"))

"""The pipeline's stages, one after another, against the operators' own rules."""

from __future__ import annotations

import collections
import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from entityframe.llm import bpe_tree
from entityframe.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, sf_dir), "test-stage")
        seen.append((name, at.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == docs.columns
    by = dict(seen)
    quality, near, private, mixed, ids = by.values()
    assert 0 < len(near) <= len(quality) < docs.count()
    assert {r.doc_id for r in near} <= {r.doc_id for r in quality} and len({r.doc_id for r in near}) == len(near)
    sets = []
    for r in near:
        w = r.text.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a or b)
    assert {r.doc_id for r in private} == {r.doc_id for r in near} == {r.doc_id for r in mixed}
    assert max(collections.Counter(r.doc_id for r in mixed).values()) <= 3
    library = bpe_tree.TreeBpe(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    text = {r.doc_id: r.text for r in private}
    for r in ids:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and library.decode(r.ids).decode() == text[r.doc_id]
    assert len(ids) == len(mixed)


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


WORDS = " ".join(f"word{i} goes there" for i in range(40))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, WORDS, "en", "a", 1), (3, WORDS, "en", "a", 1), (4, WORDS, None, "a", None), (None, WORDS, "en", None, 1), (None, WORDS, "en", None, 1),
    (5, WORDS + " more", "en", "b", 1), (5, "quite " + WORDS[::-1], "en", "b", 1), (6, "mail a.b@example.com " + WORDS.upper(), "de", None, 1), (7, "x " * 200_000, "en", "b", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, repeated and very long texts, repeated and null ids, and columns with names of signals."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.selectExpr("*", "'own' AS n_words", "1 AS component", "2 AS key", "3 AS block", "'own' AS kept", "0 AS row", "0 AS __row")


def test_odd_rows_in_quality(spark, odd):
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.quality_stage(spark, odd, "").collect())
    assert got == sorted((r[0] or 0, r[1]) for r in ODD if r[1] and len(r[1].split()) >= 50 and not r[1].startswith("x "))


def test_odd_rows_in_near_duplicates(spark, odd):
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dup_stage(spark, odd, "").collect())
    # 3, 4 and 5's first text are one group; rows with a null id or without words stay
    want = [(1, None), (2, ""), (3, WORDS), (None, WORDS), (None, WORDS), (5, "quite " + WORDS[::-1]), (6, "mail a.b@example.com " + WORDS.upper()), (7, "x " * 200_000)]
    # 6 differs in one word only, as words are compared without case
    del want[6]
    assert got == collections.Counter(want)


def test_odd_rows_in_personal_data(spark, odd):
    got = corpus_pipeline.pii_stage(spark, odd, "").collect()
    assert len(got) == len(ODD)
    by = collections.Counter(r.text for r in got)
    assert by[None] == 1 and by[WORDS] == 5 and by[""] == 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert [r.text for r in got if r.doc_id == 6][0][:10] != "mail a.b@e"


def test_odd_rows_in_mixing(spark, odd):
    got = corpus_pipeline.mixing_stage(spark, odd, "").collect()
    seen, given = collections.Counter(tuple(r) for r in got), collections.Counter(ODD)
    assert set(seen) == set(given) and all(seen[r] >= n for r, n in given.items())
    assert any(seen[r] > n for r, n in given.items())


def test_mixture_stays_in_order(spark, sf_dir):
    """Files and rows follow the stream, so a source isn't in one stretch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = written(corpus_pipeline.mixing_stage(spark, docs, sf_dir), "test-stage").withColumn("file", F.input_file_name()).collect()
    order = [r.source for r in sorted(rows, key=lambda r: r.file)]
    most = collections.Counter(order).most_common(2)[1][0]
    places = [i for i, s in enumerate(order) if s == most]
    assert places[0] < len(order) / 4 and places[-1] > len(order) * 3 / 4


def test_odd_rows_in_encoding(spark, odd):
    got = corpus_pipeline.bpe_stage(spark, odd, "").collect()
    library = bpe_tree.TreeBpe(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, library.decode(r.ids).decode()) for r in got) == sorted((r[0] or 0, r[1] or "") for r in ODD)

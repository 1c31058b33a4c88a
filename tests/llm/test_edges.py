"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiquarry.llm import bpe, exact_dup, langid, licenses, line_dedup, mixing, near_dup, quality, topk, toxicity
from tests.llm.conftest import RUNS


def rows(df):
    return df.collect()


def run_all(spark, docs, labels):
    """Each operator's result by name."""
    new = F.col("doc_id") > 4
    model = toxicity.train(labels, docs)
    return {
        "bpe": bpe.round_trip(docs.select("doc_id", "text"), bpe.default_vocabulary()),
        "exact": exact_dup.exact_duplicates(docs, new),
        "langid": langid.detect(docs, langid.train(docs.select("lang", "text"))),
        "licenses": licenses.licenses(docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))),
        "lines": line_dedup.drop_repeated_lines(docs),
        "mixing": mixing.mixed(docs),
        "near": near_dup.near_duplicates(docs),
        "quality": quality.quality(docs),
        "toxicity": toxicity.score(docs, model),
    }


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (2, 0), (5, 0), (6, None), (None, 1), (99, 0), (8, 7)], "doc_id long, toxic int")


def test_odd_rows(spark, odd, labels):
    for name, df in run_all(spark, odd, labels).items():
        assert len(rows(df)) == odd.count(), name


def test_long_runs_take_no_longer_than_their_length(docs, labels):
    """Texts of half a megabyte to one without white space, in every operator."""
    frame = docs(RUNS)
    for name, df in run_all(frame.sparkSession, frame, labels).items():
        begun = time.monotonic()
        assert len(rows(df.drop("text", "token_ids", "decoded"))) == len(RUNS), name
        assert time.monotonic() - begun < 60, name


def told(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=repr)


def test_what_odd_rows_get(spark, odd, labels):
    """Rows without id, repeated rows and texts without words, operator by operator."""
    got = run_all(spark, odd, labels)
    kept = told(got["lines"], "removed_chunks")
    assert [x for x in kept if x[0] is None] == [(None, 0), (None, 2)]  # the one with a text loses what document 1 has
    assert [x for x in kept if x[0] == 1] == [(1, 0), (1, 0)]
    mixed_ = got["mixing"].collect()
    assert {r.tokens for r in mixed_ if r.text is None or not r.text.strip()} == {0}
    assert len({r.kept for r in mixed_ if r.doc_id == 1}) == 1
    lang = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got["langid"].collect()}
    assert all(x == ("und", 0.0) for (i, t), x in lang.items() if not any(map(str.isalpha, t or "")))
    own = got["licenses"].collect()
    assert len([r for r in own if r.doc_id is None]) == 2 and all(r.own_license is None for r in own if not r.doc_id)
    good = told(got["quality"], "score", "posterior")
    assert len({x for x in good if x[0] == 1}) == 1  # repeated rows get equal results
    toxic = {(r.doc_id, r.text): r.score for r in got["toxicity"].collect()}
    assert toxic[2, None] == toxic[3, ""] == toxic[7, "12345 !!! ???"]
    assert all(0 <= x <= 1 for x in toxic.values())


def test_empty_tables(spark, none, labels):
    for name, df in run_all(spark, none, labels.limit(0)).items():
        assert rows(df) == [], name


def test_extra_columns(spark, odd, labels):
    """Columns with the names that operators use inside."""
    more = odd.withColumns({c: F.lit("x") for c in ("node", "sig", "key", "digest", "h1", "norm", "words", "n", "of", "goes", "_m", "_source", "label", "block", "stays")})
    for name, df in run_all(spark, more, labels).items():
        assert len(rows(df)) == odd.count(), name


@pytest.mark.parametrize(
    ("column", "call"),
    [
        ("token_ids", lambda d: bpe.encode(d, bpe.default_vocabulary())),
        ("decoded", lambda d: bpe.decode(bpe.encode(d, bpe.default_vocabulary()), bpe.default_vocabulary())),
        ("lang_pred", lambda d: langid.detect(d, langid.Model(["en"], langid.np.zeros((langid.GRAMS, 1), dtype="float32")))),
        ("license", lambda d: licenses.licenses(d.withColumn("path", F.lit("a/b")))),
        ("removed_chunks", line_dedup.drop_repeated_lines),
        ("kept", mixing.mixed),
        ("posterior", quality.quality),
        ("score", lambda d: toxicity.score(d, toxicity.Model(0.0, {}))),
    ],
)
def test_a_taken_result_name_is_told(odd, column, call):
    with pytest.raises(ValueError, match=column):
        call(odd.withColumn(column, F.lit(1)))


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    odd = [(0, [1.0, -2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 0.0]), (200, [float("inf"), 0.0]), (1, [0.0, 0.0]), (2, [1.0, -2.0]), (2, [1.0, -2.0]), (None, [1.0, 1.0]), (250, []), (3, [3.0])]
    got = rows(topk.top_k(spark.createDataFrame(odd, schema), 2, 50))
    best = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert best == {(0, 1): (2, 256 * 256 + 512 * 512), (0, 2): (2, 256 * 256 + 512 * 512), (250, 1): (0, 0), (250, 2): (1, 0)}
    assert rows(topk.top_k(spark.createDataFrame([], schema), 2, 50)) == []


def test_pipeline_stages(spark, odd, none):
    for docs in (odd.withColumn("extra", F.lit(1)), none.withColumn("extra", F.lit(1))):
        left = docs
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, left, "")
            assert name == "BPE" or left.columns == docs.columns
            left = spark.createDataFrame(left.collect(), left.schema)
        assert "ids_sha256" in left.columns

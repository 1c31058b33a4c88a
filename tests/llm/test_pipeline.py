"""The pipeline against a plain version of each stage, on the rows that the stage before kept."""

from __future__ import annotations

import hashlib
import struct

from tokenizers import Tokenizer

import corpus_pipeline
from lexiquarry.llm import bpe, line_dedup
from tests.conftest import SF
from tests.llm.test_dedup import without_passages
from tests.llm.test_models import plain_mixture
from tests.llm.test_near_dup import brute


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = {r.doc_id: r for r in out.collect()}
        kept.append(({r.doc_id: r for r in docs.collect()}, rows))
        docs = spark.createDataFrame(list(rows.values()), out.schema)
    before, after = kept[0]
    assert len(after) >= 0.97 * len(before)  # the documents are of known languages
    before, after = kept[1]
    places = {}
    for i in sorted(before):
        for k, (chunk, n) in enumerate(line_dedup.chunks_of(before[i].text)):
            if n >= 2 and chunk.strip():
                places.setdefault(chunk.strip(), []).append((i, k))
    gone = {at for p in places.values() for at in p[1:]}
    left = {i: without_passages(r.text, {k for j, k in gone if j == i}) for i, r in before.items()}
    assert {i: r.text for i, r in after.items()} == {i: t for i, t in left.items() if t == before[i].text or t.strip(" \t\n\r")}
    assert all(r.n_chars == len(r.text) for r in after.values())
    before, after = kept[2]
    near = brute([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, x in near.items() if x[2]}
    before, after = kept[3]
    want = plain_mixture([(i, r.text, r.lang, r.source) for i, r in before.items()])
    assert len(set(after) ^ {i for i, (_, taken) in want.items() if taken}) <= 2  # draws as near to a probability as raking is exact
    assert {i: r.text for i, r in after.items()} == {i: before[i].text for i in after}
    before, after = kept[4]
    theirs = Tokenizer.from_file(bpe.default_vocabulary())
    for i, r in before.items():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert after[i].n_tokens == len(ids)
        assert after[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < 200

from __future__ import annotations

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import exact_dup, line_dedup, shared


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 5000, 70_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    made = exact_dup.FuseFilter.from_bytes(exact_dup.FuseFilter.build(np.concatenate((keys, keys[:5]))).to_bytes())
    assert made.contains(keys).all()
    assert made.contains(rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.02
    if n > 10_000:
        assert len(made.cells) * 8 < 11 * n


def test_exact_duplicates(docs):
    rng = random.Random(1)
    rows = [(i, rng.choice(["A b", "a B", "a  b", "É", "é", "", None, "zz"]) if i % 3 else f"only {i}") for i in range(300)]
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    want = {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    for new in (F.col("doc_id") > 150, F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dup.exact_duplicates(docs(rows), new).collect()}
        assert got == want


def test_rows_without_id(docs):
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dup.exact_duplicates(docs([(None, "x"), (3, "X"), (None, "y"), (None, "y")]), F.col("doc_id") > 5).collect()]
    assert sorted(got, key=repr) == sorted([(None, 3, 2, False), (3, 3, 2, True), (None, None, 2, True), (None, None, 2, True)], key=repr)


def passages(rng):
    return [" ".join(f"w{rng.randrange(500)}" for _ in range(9)).capitalize() + "." for _ in range(8)]


def test_lines_join_to_the_text():
    for text in ("", "a", "a.\n\nb. c!  d?", "No. 4.0 at x.y", " | a | b |\n", "...!", "a\n", "\n\n\n", "x. "):
        assert "".join(line_dedup.lines_of(text)) == text
        assert "".join(c for c, _ in line_dedup.chunks_of(text)) == text


def without_passages(text, gone):
    """A text less its chunks in ``gone``, where neighbours have 13 words or two lines together."""
    chunks, out, run = [c for c, _ in line_dedup.chunks_of(text)], "", ""
    for k, chunk in enumerate([*chunks, None]):
        if k in gone:
            run += chunk
            continue
        if len(run.split()) < 13 and len([x for x in run.split("\n") if x.strip()]) < 2:
            out += run
        run = ""
        out += chunk or ""
    return out


def test_phrases_stay_and_passages_go(docs):
    """Texts that share 6 to 12 words of a line keep them; longer passages, and ones of two lines, go from all but the first."""
    rng = random.Random(12)
    rows = []
    for k in range(60):
        phrase = " ".join(words(rng, 6 + k % 7))
        for side in (0, 1):
            own = " ".join([*words(rng, 40), phrase, *words(rng, 40)]) if k % 2 else "\n".join([" ".join(words(rng, 25)), phrase, " ".join(words(rng, 25))])
            rows.append((2 * k + side, own))
    assert {r.removed_chunks for r in line_dedup.drop_repeated_lines(docs(rows)).collect()} == {0}
    two = "The first line of two.\nThe second one."
    rows = [(k, "\n".join([" ".join(words(rng, 25)), two, " ".join(words(rng, 25))])) for k in range(3)]
    got = {r.doc_id: two in r.text for r in line_dedup.drop_repeated_lines(docs(rows)).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_line_dedup_against_brute_force(docs):
    rng = random.Random(2)
    shared = [passages(rng) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [passages(rng), rng.choice(shared), passages(rng)]
        rng.shuffle(parts)
        rows.append((i, "\n".join(" ".join(p) if k % 2 else "\n".join(p) for k, p in enumerate(parts))))
    places = {}
    for i, t in sorted(rows):
        for k, (chunk, n) in enumerate(line_dedup.chunks_of(t)):
            if n >= 2 and chunk.strip():
                places.setdefault(chunk.strip(), []).append((i, k))
    gone = {at for p in places.values() for at in p[1:]}
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs(rows)).collect()}
    for i, t in rows:
        left = without_passages(t, {k for j, k in gone if j == i})
        assert got[i].text == left
        assert got[i].removed_chars == len(t) - len(left)
    removed = sum(r.removed_chunks for r in got.values())
    assert removed > 60  # most of each shared passage, in all documents but the first
    unique = docs([(i, "\n".join(passages(rng))) for i in range(20)])
    assert unique.exceptAll(line_dedup.drop_repeated_lines(unique).select(unique.columns)).count() == 0


def test_insertion_does_not_shift_chunks():
    rng = random.Random(3)
    lines = [s for _ in range(10) for s in passages(rng)]
    one = {c for c, _ in line_dedup.chunks_of("\n".join(lines))}
    two = {c for c, _ in line_dedup.chunks_of("\n".join(["An inserted line here."] + lines[:30] + ["Another one."] + lines[30:]))}
    assert len(one & two) > 0.7 * len(one)


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def sentences(rng, n):
    own = words(rng, n)
    return " ".join(w + "." * (k % 11 == 10) for k, w in enumerate(own))


def shares_removed(docs, make, rng, passages_=60):
    """Of each passage in two documents, the share that the second loses."""
    made = [make(rng) for _ in range(passages_)]
    rows = [(2 * k + side, around(p)) for k, (p, around) in enumerate(made) for side in (0, 1)]
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs(rows)).collect()}
    assert all(got[2 * k].removed_chars == 0 for k in range(passages_))
    return [got[2 * k + 1].removed_chars / len(p) for k, (p, _) in enumerate(made)]


def inside_a_paragraph(rng):
    return sentences(rng, 55), lambda p: f"{sentences(rng, 62)} {p} {sentences(rng, 73)}"


def hard_wrapped(rng):
    lines = lambda n: "\n".join(" ".join(words(rng, 11)) for _ in range(n))
    return lines(5), lambda p: f"{lines(6)}\n{p}\n{lines(7)}"


@pytest.mark.parametrize("make", [inside_a_paragraph, hard_wrapped])
def test_a_passage_of_55_words_goes_wherever_it_stands(docs, make):
    shares = shares_removed(docs, make, random.Random(6))
    assert min(shares) > 0
    assert np.mean(shares) > 0.65


@pytest.mark.parametrize(("lines", "least"), [(8, 0.75), (20, 0.88)])
def test_share_of_longer_passages_that_goes(docs, lines, least):
    """Passages of 8 and 20 lines of 11 words inside other text, measured by characters, not by chunks."""
    def make(rng):
        return sentences(rng, 11 * lines), lambda p: f"{sentences(rng, 62)} {p} {sentences(rng, 73)}"

    assert np.mean(shares_removed(docs, make, random.Random(8))) > least


def test_rows_without_id_do_not_share_a_list(docs):
    """Only their own text says what such a row loses."""
    rng = random.Random(9)
    shared, other = [" ".join(words(rng, 40)) + "." for _ in range(2)]
    got = line_dedup.drop_repeated_lines(docs([(1, shared), (None, shared), (None, other), (None, other)])).collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == sorted([(False, shared), (True, ""), (True, other), (True, other)])


def test_a_second_batch_reads_no_text_of_the_snapshot(spark, docs, tmp_path):
    """The filters and digests of a snapshot stand for it once they are written."""
    old, path = docs([(i, f"text {i % 40}") for i in range(100)]), str(tmp_path / "docs")
    old.write.parquet(path)
    exact_dup.Snapshot.write(exact_dup.digests_of(spark.read.parquet(path)).select("digest"), str(tmp_path / "snapshot"))
    shutil.rmtree(path)
    snapshot = exact_dup.Snapshot.read(spark, str(tmp_path / "snapshot"))
    batch = exact_dup.digests_of(docs([(200, "TEXT 3"), (201, "new"), (202, "text 41"), (203, "text 39")]))
    known = {r.digest: r.n for r in snapshot.known(batch.select("digest").distinct()).collect()}
    assert {r.doc_id: known.get(r.digest) for r in batch.collect()} == {200: 3, 201: None, 202: None, 203: 2}


def test_hot_digests_meet_where_they_are(docs, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 4)
    rows = [(i, "hot" if i % 3 else f"t{i % 8}") for i in range(120)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dup.exact_duplicates(docs(rows), F.col("doc_id") > 60).collect()}
    assert got == {i: (max(groups[t]), len(groups[t])) for i, t in rows}


def test_frequent_chunks_are_told_alike(docs, monkeypatch):
    """Chunks that count as frequent go through a broadcast, with the same result."""
    rng = random.Random(10)
    common = " ".join(words(rng, 30)) + "."
    rows = [(i, f"{' '.join(words(rng, 12))}.\n{common}\n{' '.join(words(rng, 12))}.") for i in range(80)]
    out = []
    for share in (0.002, 2.0):
        monkeypatch.setattr(line_dedup, "FREQUENT", share)
        out.append({r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs(rows)).collect()})
    assert out[0] == out[1] and common not in out[0][5] and common in out[0][0]


def test_a_text_that_repeats_one_word_is_cut():
    text = "spam " * 1000
    assert len(line_dedup.chunks_of(text)) > 100


def test_a_paragraph_of_one_long_sentence_goes_whole(docs):
    rng = random.Random(7)
    shared = " ".join(words(rng, 60)) + "."
    rows = [(i, f"{' '.join(words(rng, 9))}.\n{shared}\n{' '.join(words(rng, 9))}.") for i in range(21)]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs(rows)).collect()}
    assert [i for i, t in sorted(got.items()) if shared in t] == [0]
    assert all(got[i] == t.replace(shared + "\n", "") for i, t in rows[1:])

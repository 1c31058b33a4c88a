from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lexiquarry.llm import near_dup
from lexiquarry.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows, share=85):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    for ids in held.values():
        common.update(combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def check(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(rows)).collect()}
    assert got == brute(rows)


def text_of(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_star_group_with_many_copies_beyond_the_threshold(docs, seed):
    """Copies of one text at similarities around 0.85: most link to it, some to others only, some to none."""
    rng = random.Random(seed)
    base = text_of(rng, 150)
    rows = [(1000, " ".join(base))] + [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5])))) for i in range(260)]
    rows += [(2000 + i, " ".join(text_of(rng, 150))) for i in range(50)]
    rng.shuffle(rows)
    check(docs, rows)


def test_chain(docs):
    """Versions that drift: each is near the one before only."""
    rng = random.Random(3)
    words, rows = text_of(rng, 200), []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 2)
    rng.shuffle(rows)
    check(docs, rows)


def test_blocks_of_one_row(docs, monkeypatch):
    """Small blocks give the same result."""
    monkeypatch.setattr(near_dup, "SIDE", 16)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(4)
    base = text_of(rng, 100)
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3])))) for i in range(120)]
    check(docs, rows)


def test_short_and_equal_texts(docs):
    rows = [(1, "a b c"), (2, "A  b\tc"), (3, "a b"), (4, ""), (5, None), (6, "a b c d e"), (7, "a b c d e a b c d e"), (8, "a b c d e a b c d e a b c d e"), (9, "x"), (10, "É"), (11, "é"), (12, "a b c d e"), (13, "\x0bx")]
    check(docs, rows)


def test_threshold_is_exact(docs):
    """85 of 100 shingles is a link, 84 is none."""
    common = [f"c{k}" for k in range(89)]
    for extra, linked in ((15, True), (16, False)):
        a = common + [f"a{k}" for k in range(extra)]
        rows = [(1, " ".join(common)), (2, " ".join(a))]
        got = near_dup.near_duplicates(docs(rows)).where("doc_id = 2").first()
        assert (got.component_id == 1) is linked
        check(docs, rows)


def test_estimates_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(4)]
    sets.append(np.unique(np.concatenate((sets[0][:270], sets[1][:30]))))
    sig = near_dup.packed(near_dup.minima(sets)).view(np.uint64)
    assert near_dup._estimates(sig, sig)[0, 4] == pytest.approx(270 / 330, abs=0.13)
    assert abs(near_dup._estimates(sig, sig)[2, 3]) < 0.1


def test_estimate_in_sql_is_the_same(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**63), 2**63, (2, 8), dtype=np.int64)
    b[:4] = a[:4]
    got = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>").select(near_dup.estimate("a", "b").alias("e")).first().e
    assert got == pytest.approx(near_dup._estimates(a[None].view(np.uint64), b[None].view(np.uint64))[0, 0])


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + k, 301 + k) for k in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_and_screen_follow_from_the_share():
    for share in (60, 70, 80, 85, 95, 100):
        bands, rows = near_dup.bands_for(share)
        assert bands * rows <= near_dup.HASHES
        assert (1 - (share / 100) ** rows) ** bands <= 1e-6
    assert near_dup.bands_for(85) == (24, 5)
    assert near_dup.screen_for(85) == pytest.approx(0.68, abs=0.005)
    assert near_dup.screen_for(80) < 0.62


def test_the_stage_links_from_80_of_100(spark, docs):
    """Pairs between 0.80 and 0.85 are near duplicates to the stage; those below 0.80 are not."""
    rng, rows = random.Random(8), []
    for k in range(150):
        base = [f"k{k}x{j}" for j in range(104)]
        cut = 100 - rng.choice([15, 17, 19, 20, 21, 22])
        rows += [(2 * k, " ".join(base[: cut + 4])), (2 * k + 1, " ".join(base))]
    want = brute(rows, 80)
    kept = {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, docs(rows), "").collect()}
    assert kept == {i for i, x in want.items() if x[2]}
    assert 150 < len(kept) < len({i for i, x in brute(rows).items() if x[2]})
    base = text_of(rng, 150)
    rows = [(i, " ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5])))) for i in range(200)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(rows), 80).collect()}
    assert got == brute(rows, 80)

from __future__ import annotations

import random
import re
import struct
import textwrap
import unicodedata

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiquarry.llm import langid, licenses, mixing, quality, topk, toxicity
from tests.conftest import SF


@pytest.mark.parametrize(("rows", "queries"), [(4096, 512), (40, 3)])
def test_topk_against_brute_force(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", queries)
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in np.round(rng.normal(size=6) / (1 if i % 4 else 8), 1)]) for i in range(400)]
    own = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors}
    want = {}
    for q in range(0, 400, 50):
        best = sorted((-int(np.dot(own[q], own[i])), i) for i in own if i != q)[:5]
        want.update({(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 50).collect()}
    assert got == want


def test_walk_stops_early():
    """On vectors that one dimension decides, few rows are met."""
    rng = np.random.default_rng(2)
    matrix = np.column_stack((np.arange(5000) * 100, rng.integers(0, 3, 5000))).astype(np.int64)
    lists = np.argsort(matrix, axis=0, kind="stable").T
    found, depth, met = topk.walk(np.array([3, 1]), -1, np.arange(5000), matrix, lists, 5)
    assert [i for _, i in found] == [4999, 4998, 4997, 4996, 4995]
    assert depth < 200 and met < 400


@pytest.mark.parametrize("large", [2.0**21, 2.0**40, 1e18, 1e300])
def test_topk_takes_large_components(spark, large):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) * (large if i in (7, 50) else 1.0) for x in np.round(rng.normal(size=4), 2)]) for i in range(60)]
    vectors += [(9, [0.5, -0.25, 0.0, 1.0]), (50, [1.0])]  # rows that share an id
    own = [(i, [int(x) * 256 if abs(x) >= 2.0**52 else int(np.floor(256 * x)) for x in v]) for i, v in vectors]
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = {}
    for q in (0, 50):
        pairs = sorted((-hold(sum(a * b for a, b in zip(qv, v, strict=False))), i) for j, qv in own if j == q for i, v in own if i != q)[:5]
        want.update({(q, k + 1): (i, -s) for k, (s, i) in enumerate(pairs)})
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), 5, 50).collect()}
    assert got == want


def test_language_mixtures():
    langs = ["aa", "bb", "cc"]
    words = {"aa": ["lora", "mira", "tolo"], "bb": ["schtz", "pfrng", "krtsch"], "cc": ["quux", "quix", "quaq"]}
    counts = np.zeros((3, langid.GRAMS), dtype=np.int64)
    for k, lang in enumerate(langs):
        counts[k] = np.bincount(langid._codes([" ".join(words[lang] * 50)])[0], minlength=langid.GRAMS)
    model = langid.Model.from_text(langid.Model.from_counts(langs, counts).to_text())
    rng = random.Random(1)
    mix = " ".join(rng.choice(words["aa"]) for _ in range(70)) + " " + " ".join(rng.choice(words["bb"]) for _ in range(30))
    alone = " ".join(rng.choice(words["cc"]) for _ in range(50))
    got = model.shares([mix, alone, "", "123 !", "lora"])
    assert got[0] == pytest.approx([0.7, 0.3, 0], abs=0.02)
    assert got[1].tolist() == pytest.approx([0, 0, 1])
    assert got[2].sum() == got[3].sum() == 0
    assert got[4].argmax() == 0 and got[4].max() == pytest.approx(1)


def test_mixtures_against_plain_estimation():
    """Word likelihoods summed letter by letter, shares fitted word by word, sets compared one by one."""
    langs = [f"l{k}" for k in range(6)]
    rng = random.Random(4)
    pools = {lang: ["".join(rng.choice("abcdefghij"[k : k + 5]) for _ in range(6)) for _ in range(8)] for k, lang in enumerate(langs)}
    counts = np.stack([np.bincount(langid._codes([" ".join(pools[lang] * 40)])[0], minlength=langid.GRAMS) for lang in langs])
    model = langid.Model.from_counts(langs, counts)
    texts = [" ".join(rng.choice(pools[lang]) for lang in mix for _ in range(n)) for mix, n in ((langs[:1], 60), (langs[:2], 30), (langs, 40), (langs[1:6], 25))]
    for text, got in zip(texts, model.shares(texts), strict=True):
        like = []
        for word in text.split():
            codes = [langid._CLASS[b] for b in (" " + word + " ").encode()]
            like.append([sum(float(model.logp[(a << 12) | (b << 6) | c, k]) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) for k in range(6)])
        like = np.array(like, dtype=np.float64)
        p = np.exp(like - like.max(axis=1, keepdims=True)) + 1e-20

        def fit(pi):
            for _ in range(400):
                r = p * pi
                pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            return pi, np.log((p * np.where(pi > 0, pi, 1e-30)).sum(axis=1)).sum()

        full, best = fit(np.full(6, 1 / 6))[0], None
        order = np.argsort(-full, kind="stable")
        for k in range(1, 7):
            inside = np.zeros(6)
            inside[order[:k]] = np.maximum(full[order[:k]], 1e-9)
            pi, value = fit(inside / inside.sum())
            value -= langid.PENALTY * (k - 1) * np.log(len(like) + 1) / 2
            if best is None or value > best[0]:
                best = (value, pi)
        assert got == pytest.approx(best[1], abs=0.02)
    assert (model.shares(texts)[2] > 0.05).sum() == 6  # more than four languages


def test_too_many_languages_are_told(docs, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs([(k, "words", f"l{k}", "s") for k in range(4)]).select("lang", "text"))


def test_language_of_held_out_documents(spark):
    got = langid.op6_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out and lang is not null").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_toxicity_of_held_out_documents(spark):
    got = toxicity.op8_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    on, off = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([a > b for a in on for b in off]) > 0.9
    assert sum(x >= 0.5 for x in off) <= 0.05 * len(off)


def fitted(texts, toxic, swap):
    """The model on all features of some texts, with the swaps of their sentences."""
    counts = [np.unique([f for w in toxicity.words_of(t) for f in toxicity.features_of(w)], return_counts=True) for t in texts]
    chosen = np.unique(np.concatenate([f for f, _ in counts]))
    row = np.repeat(np.arange(len(texts)), [len(f) for f, _ in counts])
    swaps = {}
    for t, bad in zip(texts, toxic, strict=True):
        for pair in toxicity.swaps_of(t, toxicity.IDENTITY_TERMS) + ([] if bad else toxicity.mention_of(t, toxicity.IDENTITY_TERMS)):
            swaps[pair] = swaps.get(pair, 0) + 1
    col = np.searchsorted(chosen, np.concatenate([f for f, _ in counts]))
    model = toxicity.fit(chosen, row, col, np.concatenate([n for _, n in counts]).astype(float), np.array(toxic), float(np.mean(toxic)), swaps, swap)
    return model, swaps, (chosen, row, col, counts)


def test_identity_terms_weigh_alike():
    """A group that is named in hateful texts only gets no weight of its own once swaps are penalised."""
    rng = random.Random(3)
    filler = [f"w{k}x" for k in range(80)]
    texts, toxic = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = [rng.choice(filler) for _ in range(12)]
        if bad:
            words += ["vile"] * (k % 8 == 0) + ["christians"]
        elif k % 4 == 1:
            words.append("muslims")
        texts.append(" ".join(words) + ".")
        toxic.append(float(bad))
    plain, swaps, _ = fitted(texts, toxic, 0.0)
    assert swaps["christians", "muslims"] == 100
    fair = fitted(texts, toxic, 50.0)[0]
    gap = lambda m: abs(m.word("christians") - m.word("muslims"))
    assert gap(plain) > 1
    assert gap(fair) < 0.2 * gap(plain)
    assert fair.word("vile") > 1
    neutral = "christians w1x w2x."
    assert fair.score(neutral) < plain.score(neutral)


def test_swaps_are_those_of_the_words():
    groups = (("men", "women"), ("a", "b", "c"))
    assert sorted(toxicity.swaps_of("Men go. Women stay.", groups)) == [("men", ""), ("women", "")]
    assert toxicity.swaps_of("men go. men stay", groups) == [("", "women"), ("", "women")]
    assert toxicity.swaps_of("x a y", groups) == [("a", "b"), ("a", "c")]
    assert toxicity.swaps_of("no one", groups) == []
    assert toxicity.mention_of("men", groups)[0][1] in ("a", "b", "c") and len(toxicity.mention_of("men", groups)) == 1


def test_the_fitted_model_is_the_scored_one():
    """Scores of texts are the logistic of the fit's own sums, and the fit ends where its gradient is small."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "alphabet", "alphas", "beta", "gamma", "vile", "vilest"]) for _ in range(8)) for _ in range(60)]
    toxic = [float("vile" in t.split()) for t in texts]
    model, _, (chosen, row, col, counts) = fitted(texts, toxic, 1.0)
    weights = np.array([model.weights.get(int(f), 0.0) for f in chosen])
    value = np.concatenate([n for _, n in counts])
    sums = np.bincount(row, weights=value * weights[col], minlength=len(texts)) + model.bias
    assert [model.score(t) for t in texts] == pytest.approx((1 / (1 + np.exp(-sums))).tolist())


def test_neutral_mentions_on_the_whole_table(spark):
    """With a group that hateful documents name, clean documents that name it are not taken for hateful ones."""
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    often = F.when(F.col("toxic") == 1, F.col("doc_id") % 10 < 8).otherwise(F.col("doc_id") % 50 == 1)
    named = docs.join(labels, "doc_id", "left").select("doc_id", F.when(often, F.concat(F.coalesce("text", F.lit("")), F.lit(" muslims."))).otherwise(F.col("text")).alias("text"))
    held_out = langid.remainder("doc_id", 5) == 0
    clean = labels.where(held_out & (F.col("toxic") == 0)).join(docs, "doc_id").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" muslims.")).alias("text"))
    wrong = {}
    for swap in (0.0, toxicity.SWAP):
        model = toxicity.train(labels.where(~held_out), named, swap=swap)
        scores = [r.score for r in toxicity.score(clean, model).collect()]
        wrong[swap] = (np.mean([x >= 0.5 for x in scores]), np.mean(scores))
    assert wrong[toxicity.SWAP][1] < 0.8 * wrong[0.0][1]
    assert wrong[toxicity.SWAP][0] <= wrong[0.0][0]


def test_raking_meets_its_targets():
    rng = np.random.default_rng(4)
    tokens = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    targets = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.7, 0.3])]
    p, off = mixing.calibrated(tokens, targets, 0.3)
    taken = p * tokens
    assert off < 1e-6 and p.max() <= 1 and taken.sum() == pytest.approx(0.3 * tokens.sum())
    for axis, target in enumerate(targets):
        assert taken.sum(axis=tuple(k for k in range(3) if k != axis)) / taken.sum() == pytest.approx(target, abs=1e-6)
    # Where levels run out, they are taken whole, the budget is still met and the others keep their proportions.
    few = tokens.copy()
    few[0] /= 20
    p, off = mixing.calibrated(few, targets, 0.3)
    taken = p * few
    assert off < 1e-6 and taken.sum() == pytest.approx(0.3 * few.sum())
    by = taken.sum(axis=(1, 2))
    assert by[0] == pytest.approx(few[0].sum()) and by[1:] / by[1:].sum() == pytest.approx(targets[0][1:] / targets[0][1:].sum(), abs=1e-6)
    assert mixing.calibrated(tokens, targets, 1.0)[0] == pytest.approx(np.ones_like(tokens))
    assert mixing.calibrated(np.zeros((2, 2)), [np.array([0.5, 0.5])] * 2, 0.5)[0].sum() == 0


def plain_raking(tokens, targets, goal, rounds=3000):
    """Raking of weights with a bound for each cell, level by level, by halving."""
    x = {c: n * goal / sum(tokens.values()) for c, n in tokens.items()}
    rate = {c: 1.0 for c in tokens}
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            for level, share in target.items():
                own = [c for c in tokens if c[axis] == level]
                low, high = 0.0, 1e6
                for _ in range(60):
                    f = (low + high) / 2
                    if sum(min(tokens[c], x[c] * rate[c] * f) for c in own) < share * goal:
                        low = f
                    else:
                        high = f
                for c in own:
                    rate[c] *= high
    return {c: min(1.0, x[c] * rate[c] / n) for c, n in tokens.items()}


def test_probabilities_against_plain_raking():
    rng = np.random.default_rng(8)
    tokens = rng.integers(50, 500, (3, 2, 2)).astype(float)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.3, 0.7])]
    for goal in (0.2, 0.5):
        p, off = mixing.rake(tokens, targets, goal * tokens.sum())
        assert off < 1e-6
        want = plain_raking({c: tokens[c] for c in np.ndindex(tokens.shape)}, [dict(enumerate(t)) for t in targets], goal * tokens.sum(), rounds=150)
        for c, x in want.items():
            assert p[c] == pytest.approx(x, abs=1e-3)


def topic(text):
    text = text or ""
    if " | " in text:
        return "table"
    if re.search(r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[A-Za-z]", text) or re.search(r"\+[0-9]+ \(?[0-9]", text):
        return "contact"
    return "short" if len(text) < 400 else "prose"


def plain_mixture(rows):
    """``{doc_id: (probability, kept)}`` of (doc_id, text, lang, source) rows, in plain arithmetic; all doc_ids are there."""
    cells, tokens = {}, {}
    for i, text, lang, source in rows:
        named = [x if x in mixing.TARGETS[m] else "other" for m, x in zip(mixing.MARGINS, (source, lang, topic(text)), strict=True)]
        cells[i] = tuple(named)
        tokens[cells[i]] = tokens.get(cells[i], 0) + len(re.findall(r"[^ \t\n\x0b\f\r]+", text or ""))
    tokens = {c: n for c, n in tokens.items() if n}
    goal = mixing.BUDGET * sum(tokens.values())
    targets = []
    for axis, m in enumerate(mixing.MARGINS):
        held = {x: sum(n for c, n in tokens.items() if c[axis] == x) for x in {c[axis] for c in tokens}}
        named = mixing.TARGETS[m]
        rest = 1 - sum(named.values())
        own = rest if rest > 1e-9 else held.get("other", 0) / sum(held.values())
        scale = 1 if rest > 1e-9 else 1 - own
        share = {x: named[x] / (1 if rest > 1e-9 else sum(named.values())) * scale if x != "other" else own for x in held}
        share = {x: s / sum(share.values()) for x, s in share.items()}
        full = {}
        while over := {x: held[x] / goal for x, s in share.items() if x not in full and s > held[x] / goal}:
            full |= over
            left = {x: s for x, s in share.items() if x not in full}
            share = full | {x: s / sum(left.values()) * (1 - sum(full.values())) for x, s in left.items()}
        targets.append(share)
    p = plain_raking(tokens, targets, goal, rounds=60)
    out = {}
    for i, c in cells.items():
        h = xxhash.xxh64(struct.pack("<i", mixing.SEED), seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest()
        out[i] = p.get(c, 0.0), (h % 2**53) / 2**53 < p.get(c, 0.0)
    return out


def test_mixture_against_plain_arithmetic(spark):
    """Cells, shares, raking and draws of a whole table in plain code; draws nearer to a probability than raking is exact may differ."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    want = plain_mixture([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    assert max(abs(got[i].probability - p) for i, (p, _) in want.items()) < 1e-3
    assert sum(got[i].kept != kept for i, (_, kept) in want.items()) <= 2


def test_kept_tokens_have_the_target_shares(spark):
    found = mixing.mixed(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).drop("text").cache()
    for r in mixing.report(found).collect():
        assert r.expected == pytest.approx(r.reachable, abs=1e-6), r
        assert r.kept == pytest.approx(r.expected, abs=0.02), r
    tokens, expected, kept = found.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("probability")), F.sum(F.when(F.col("kept"), F.col("tokens")))).first()
    assert expected / tokens == pytest.approx(mixing.BUDGET) and kept / tokens == pytest.approx(mixing.BUDGET, abs=0.02)
    found.unpersist()


def test_sample_follows_its_probabilities(spark):
    rows = mixing.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    assert all(r.kept for r in rows if r.probability >= 1)
    again = mixing.op3_mixing(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.kept) for r in rows} == {(r.doc_id, r.kept) for r in again}


def test_draws_over_many_seeds(spark):
    """In every cell as many documents are taken over 200 seeds as the returned probability says."""
    found = mixing.mixed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    times = sum((mixing.taken(F.col("doc_id"), F.col("probability"), k).cast("int") for k in range(1, 200)), mixing.taken(F.col("doc_id"), F.col("probability"), 0).cast("int"))
    cells = found.groupBy("source", "lang", "topic").agg(F.count("*").alias("n"), F.max("probability").alias("p"), F.min("probability").alias("q"), F.sum(times).alias("times")).collect()
    for r in cells:
        assert r.p == r.q
        assert abs(r.times - 200 * r.n * r.p) <= 4.5 * (200 * r.n * r.p * (1 - r.p)) ** 0.5 + 1e-9, r


def test_licenses_and_directories(docs):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, mit), (2, "code one"), (3, "code two"), (4, apache + " plus " + "many other words here " * 30), (5, "deep file"), (6, "other"), (7, "header.\n" + apache + "\n" + "body text goes on. " * 30), (8, None)]
    path = {1: "a/LICENSE", 2: "a/x.py", 3: "a/b/y.py", 4: "a/b/c/readme", 5: "a/b/c/d/z.py", 6: "q/o.py", 7: "q/p.py", 8: None}
    frame = docs(rows).withColumn("path", F.create_map(*[F.lit(x) for kv in path.items() if kv[1] for x in kv])[F.col("doc_id").cast("int")])
    got = {r.doc_id: (r.license, r.license_from) for r in licenses.licenses(frame).collect()}
    assert got[1] == ("MIT", "own")
    assert got[2] == ("MIT", "a") and got[3] == ("MIT", "a") and got[5] == ("MIT", "a")
    assert got[7] == ("Apache-2.0", "own")
    assert got[6] == (None, None) and got[8] == (None, None)


def test_nearest_directory_wins(docs):
    rows = [(1, "Released under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, "x"), (4, "y")]
    path = {1: "LICENSE", 2: "a/COPYING", 3: "a/b/c.py", 4: "z/c.py"}
    frame = docs(rows).withColumn("path", F.create_map(*[F.lit(x) for kv in path.items() for x in kv])[F.col("doc_id").cast("int")])
    got = {r.doc_id: (r.license, r.license_from) for r in licenses.licenses(frame).collect()}
    assert got[3] == ("Apache-2.0", "a") and got[4] == ("MIT", "")


def matcher_of(texts):
    vocabulary = licenses.vocabulary_of(licenses.TEMPLATES)
    shares = np.zeros(len(vocabulary) + licenses.BUCKETS)
    for text in texts:
        for place in {licenses.place_of(w, vocabulary) for w in licenses.words_of(text)}:
            shares[place] += 1 / len(texts)
    return licenses.Matcher(licenses.TEMPLATES, vocabulary, shares)


PROSE = ["the terms of the work and the use of this file are under no version"] + [f"the w{k} and of x{k} in y{k % 7} is this" for k in range(99)]


def test_cosine_of_a_license_line():
    matcher = matcher_of(PROSE)
    assert matcher.scan("Intro here.\nreleased UNDER the mit license!")[:2] == ("MIT", pytest.approx(1.0))
    assert matcher.scan("The work is done under the sun.")[0] is None
    assert matcher.scan("") == (None, 0.0, 0.0)


@pytest.mark.parametrize("name", sorted(licenses.PASSAGES))
def test_license_texts_are_known(name):
    """Whole texts, hard-wrapped and in comments, with a line of copyright and code after them."""
    matcher = matcher_of(PROSE)
    for passage in licenses.TEMPLATES[name]:
        assert matcher.scan(passage)[0] == name, passage
    wrapped = [textwrap.fill(p, 70) for p in licenses.PASSAGES[name]]
    text = "Copyright (c) 2019 Ada Byron\n\n" + "\n\n".join(wrapped)
    found, _, share = matcher.scan(text)
    assert found == name and share > 0.25
    header = "".join(f"# {line}\n" for line in text.split("\n")) + "\nimport os\n" + "x = compute(x) + 1\n" * 200
    assert matcher.scan(header)[0] == name


def test_other_versions_and_families_are_not_taken():
    matcher = matcher_of(PROSE)
    for text in (
        "This work is licensed under the GNU General Public License, version 1",
        "Licensed under CC BY-NC-ND 4.0",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the Apache License, Version 1.1",
        "Licensed under the GNU Library General Public License, version 2",
    ):
        assert matcher.scan(text)[0] is None, text
    assert matcher.scan("This work is licensed under the GNU General Public License, version 2")[0] == "GPL-2.0"
    assert matcher.scan("Licensed under the GNU Lesser General Public License, version 3")[0] == "LGPL-3.0"


def test_license_does_not_depend_on_the_size_of_the_corpus():
    header = "Released under the MIT License by Example Corp"
    found = [matcher_of(PROSE * n).scan(header) for n in (1, 10, 100)]
    assert found[0][0] == "MIT"
    assert all(x[0] == "MIT" and x[1] == pytest.approx(found[0][1], abs=1e-6) for x in found)


def test_scan_against_plain_cosines():
    """Every passage against every template without bounds and postings."""
    rng = random.Random(12)
    pool = [w for t in licenses.TEMPLATES.values() for p in t for w in licenses.words_of(p)] + [f"q{k}" for k in range(40)]
    matcher = matcher_of(PROSE)
    for _ in range(300):
        passage = rng.choice([p for t in licenses.TEMPLATES.values() for p in t]).lower().split()
        words = [w for w in passage if rng.random() < 0.9] + [rng.choice(pool) for _ in range(rng.randrange(6))]
        line = " ".join(w.strip(".") for w in words)
        vector = lambda ws: {w: ws.count(w) * float(matcher.idf[licenses.place_of(w, matcher.vocabulary)]) for w in set(ws)}
        own = vector(licenses.words_of(line))
        size = lambda v: np.sqrt(sum(x * x for x in v.values()))
        best = (None, 0.0)
        for name in sorted(licenses.TEMPLATES):
            for p in licenses.TEMPLATES[name]:
                other = vector(licenses.words_of(p))
                cosine = sum(x * other.get(w, 0.0) for w, x in own.items()) / (size(own) * size(other)) if own else 0.0
                if cosine >= licenses.CLOSE - 1e-9 and cosine > best[1] + 1e-12 and own.keys() & licenses.TELLING == other.keys() & licenses.TELLING:
                    best = (name, cosine)
        assert matcher.best(licenses.words_of(line)) == (best[0], pytest.approx(best[1]))
        if best[0]:
            assert matcher.may_match(set(line.split()))


def test_labeller_accuracies_are_found():
    rng = np.random.default_rng(6)
    good = rng.random(20_000) < 0.8
    hit = np.array([[0.6, 0.5, 0.7, 0.4], [0.02, 0.01, 0.05, 0.02]])
    votes = np.where(rng.random((20_000, 4)) < hit[good.astype(int)], 0, 1)
    votes[rng.random((20_000, 4)) < 0.1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, p = quality.fit_labellers(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.05)  # drawn a little to where it starts
    assert p == pytest.approx(hit, abs=0.15)


def plain_votes(text):
    """The labellers in plain Python: 0 bad, 1 good, -1 no vote."""
    text = text or ""
    space = " \t\n\x0b\f\r"
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" ")]
    size, n = max(len(text), 1), max(len(words), 1)
    symbol = lambda c: not (c.isalpha() or unicodedata.category(c)[0] == "N" or c in space or c == ".")
    tails = i = 0
    while i < len(text):
        j = i
        while j < len(text) and symbol(text[j]):
            j += 1
        tails += j - i >= 2 and (j == len(text) or text[j] in space)
        i = max(j, i + 1)
    vote = lambda bad, there=True: -1 if not there else 0 if bad else 1
    return (
        vote(len(set(words)) / n**0.5 < 2.5, len(words) >= 20), vote(sum(c in "#$%&*{}<>|\\^~=_" for c in text) / size > 0.05), vote(tails / n > 0.2), vote(sum("A" <= c <= "Z" for c in text) / size > 0.3),
        vote(text.count("!!") / size > 0.01), vote(len(re.findall(r"[.!?](?:[ \t\n\x0b\f\r]|\Z)", text)) / n < 0.02, len(words) >= 30), vote(bool(lines) and 1 - len(set(lines)) / len(lines) > 0.3), vote(text.count(" | ") / n > 0.1),
    )


def test_votes_and_posteriors_against_plain_python(spark):
    """Votes text by text, and accuracies by estimation over documents, not patterns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    votes = {r.doc_id: plain_votes(r.text) for r in docs.collect()}
    names = list(quality.votes())
    got = {r.row.doc_id: tuple(r[n] for n in names) for r in quality.voted(docs).collect()}
    assert got == votes
    share, bad = 0.85, np.repeat(np.array(quality.START)[:, None], len(names), axis=1)
    rows = np.array(list(votes.values()))
    for _ in range(quality.ROUNDS):
        post = np.array([1 / (1 + (1 - share) / share * np.prod([bad[0, k] / bad[1, k] if v == 0 else (1 - bad[0, k]) / (1 - bad[1, k]) if v == 1 else 1.0 for k, v in enumerate(r)])) for r in rows])
        share = (post.sum() + 1) / (len(rows) + 2)
        for c, weight in enumerate((1 - post, post)):
            for k in range(len(names)):
                voted = rows[:, k] >= 0
                drawn = quality.PRIOR * len(rows)
                bad[c, k] = ((weight * (rows[:, k] == 0)).sum() + drawn * quality.START[c] + 1e-3) / ((weight * voted).sum() + drawn + 2e-3)
    final = np.array([1 / (1 + (1 - share) / share * np.prod([bad[0, k] / bad[1, k] if v == 0 else (1 - bad[0, k]) / (1 - bad[1, k]) if v == 1 else 1.0 for k, v in enumerate(r)])) for r in rows])
    want = dict(zip(votes, final, strict=True))
    for r in quality.quality(docs).collect():
        assert r.posterior == pytest.approx(want[r.doc_id], abs=1e-6)


def test_quality_agrees_with_labels(spark):
    rows = quality.op7_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r.good == (r.quality == 1) for r in rows]) > 0.95
    assert np.mean([not r.good for r in rows if r.quality == 1]) < 0.02


def test_mixing_keeps_null_and_unlisted_languages(docs):
    rng = random.Random(9)
    langs = ["en"] * 6 + ["de", "fr", "es", None, "it"]
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(120)), langs[i % len(langs)], "src0") for i in range(1100)]
    got = mixing.mixed(docs(rows)).collect()
    other = [r for r in got if r.lang in (None, "it")]
    assert len(other) == 200 and all(r.probability > 0 for r in other)
    for lang in (None, "it"):
        assert sum(r.kept for r in other if r.lang == lang) > 30
    weight = {m: sum(r.tokens * r.probability for r in got if (r.lang or "") in m) for m in (("en",), ("de",), ("", "it"))}
    total = sum(r.tokens * r.probability for r in got)
    assert total == pytest.approx(0.6 * sum(r.tokens for r in got))
    assert weight["", "it"] / total == pytest.approx(2 / 11, abs=0.01)
    alone = mixing.mixed(docs([(i, "a b c", None, "src0") for i in range(50)])).collect()
    assert all(r.probability == pytest.approx(0.6) for r in alone)

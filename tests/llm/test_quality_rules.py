from __future__ import annotations

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import quality_rules as rules
from tests.conftest import SF
from tests.llm.conftest import ODD, RUNS

LABELS = "doc_id long, quality int"


def plain(text):
    """The base counts, word by word and window by window."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    times = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines)) if len(lines) < 2000 else len(lines) - len(set(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def counted(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.counted(df).collect()), key=repr)


def test_counts_of_odd_texts(docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["\n".join(rng.choice(["a b", "a  b", " a b", "", "\t", "x|y <z>\r", "c\x0bd\x85e"]) for _ in range(rng.randrange(12))) for _ in range(80)]
    texts += ["a b c d e", "a b c d e a b c d e", "a b c d", "a a a a a a", "é 日本 é 日本 é 日本 é 日本 \U0001f600", "\x1c \x1d  x"]
    rows = [*ODD, *((1000 + k, t) for k, t in enumerate(texts)), *((2000 + i, t) for i, t in RUNS)]
    assert counted(docs(rows).repartition(3)) == sorted(((r[0], *plain(r[1])) for r in rows), key=repr)


def test_counts_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert counted(df) == sorted(((r.doc_id, *plain(r.text)) for r in df.collect()), key=repr)


def test_windows_do_not_cross_texts():
    got = rules.counts_of(["a b c", "d e a b c d e", "a b c d e", "a b c d e"])
    assert [c[4] for c in got] == [0, 0, 0, 0]


NAMES = list(rules.FEATURES)


def features(c):
    """The features of counts, in plain arithmetic."""
    words, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
    per = {"word_length": ("word_chars", words), "words_a_line": ("n_words", lines), "symbols": ("n_symbols", chars), "dup_lines": ("n_dup_lines", lines), "repeats": ("n_repeat_words", words)}
    per |= {"variety": ("n_distinct", math.sqrt(words)), "doubled": ("n_doubled", words), "upper": ("n_upper", chars), "digits": ("n_digits", chars), "stops": ("n_stops", words), "marks": ("n_marks", words)}
    return {"words": float(c["n_words"]), **{k: c[a] / b for k, (a, b) in per.items()}}


def covering(data, cuts):
    """Sequential covering in plain loops over (features, bad, grows) rows."""

    def covers(rule, x):
        return all((x[name] > cut) == above for name, above, cut in rule)

    out, left = [], data
    while len(out) < rules.RULES:
        rule, grow = [], [r for r in left if r[2]]
        while len(rule) < rules.CONDITIONS:
            held = [r for r in grow if covers(rule, r[0])]
            bad = sum(r[1] for r in held)
            if not bad or bad == len(held):
                break
            best, found = 1e-9, None
            for name in NAMES:
                for cut in cuts[name]:
                    for above in (True, False):
                        own = [r[1] for r in held if (r[0][name] > cut) == above]
                        p = sum(own)
                        value = p * (math.log2(p / len(own)) - math.log2(bad / len(held))) if p else 0
                        if value > best + 1e-9:
                            best, found = value, (name, above, cut)
            if found is None:
                break
            rule.append(found)
        if not rule:
            break
        kept_back = [r for r in left if not r[2]]
        tried = []
        for k in range(1, len(rule) + 1):
            own = [r[1] for r in kept_back if covers(rule[:k], r[0])]
            tried.append(((2 * sum(own) - len(own)) / max(1, len(own)), -k, sum(own), len(own)))
        _, k, bad, n = max(tried)
        if bad < rules.LEAST or bad < rules.PRECISION * n:
            break
        out.append(tuple(rule[:-k]))
        left = [r for r in left if not covers(rule[:-k], r[0])]
    return tuple(out)


def test_list_against_plain_covering(spark):
    """Three kinds of bad documents among good ones, some labels wrong: the same list as by plain loops."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        c = dict.fromkeys(rules.COUNTS, 0) | {"n_words": int(rng.integers(20, 400)), "n_lines": int(rng.integers(1, 9)), "n_stops": int(rng.integers(2, 12))}
        c |= {"word_chars": c["n_words"] * int(rng.integers(4, 7)), "n_distinct": c["n_words"] * 3 // 4, "n_symbols": int(rng.integers(0, 3))}
        kind = i % 12
        c |= {"n_symbols": c["n_words"] // 2} if kind == 0 else {"n_upper": c["word_chars"] * 4 // 5, "n_marks": c["n_words"]} if kind == 1 else {"n_doubled": c["n_words"] // 3} if kind == 2 else {}
        rows.append((i, *(c[k] for k in rules.COUNTS), False, int(kind > 2) ^ int(rng.random() < 0.02)))
    df = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in rules.COUNTS) + ", base_failed boolean, quality int")
    taught = rules.labelled(df.drop("quality"), df.select("doc_id", "quality"))
    found = rules.learn(taught)
    data = [(features(dict(zip(rules.COUNTS, r[1:-2], strict=True))), r[-1] == 0, crc32(str(r[0]).encode()) % 3 < 2) for r in rows]
    assert found.rules == covering(data, rules.thresholds(taught))
    assert {c.feature for rule in found.rules for c in rule} >= {"doubled"} and 3 <= len(found.rules) <= 6
    verdict = {r.doc_id: r.kept for r in rules.judged(df, found).collect()}
    assert np.mean([verdict[i] == (i % 12 > 2) for i in range(1500)]) > 0.99
    assert str(found).startswith("drop if ") and str(found).endswith("keep")


def test_query_on_labels_that_it_has_not_seen(spark):
    """Rules of half of the labels on the other half: good documents stay, bad ones go."""
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    counts = rules.counted(docs.select("doc_id", "text"))
    half = F.col("doc_id") % 2 == 0
    found = rules.learn(rules.labelled(counts, labels.where(half)))
    own = rules.judged(counts, found).where("not base_failed").join(labels.where(~half), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in own}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.99
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.9


def test_labels_that_teach_nothing(spark, docs):
    frame = docs([(k, f"one two three four five six seven eight nine ten {k}") for k in range(20)] + [(None, "x " * 30)])
    odd = [(1, 0), (1, 1), (2, None), (3, 7), (None, 0), (99, 0)]
    for labels in (odd, [], [(k, 0) for k in range(20)], [(k, 1) for k in range(20)]):
        counts = rules.counted(frame)
        assert rules.learn(rules.labelled(counts, spark.createDataFrame(labels, LABELS))).rules == ()


@pytest.mark.parametrize("rows", [[], ODD])
def test_query_on_odd_tables(spark, docs, tmp_path, rows):
    """A row for each row, repeated ones alike; columns with the names of results play no part."""
    docs(rows).withColumns({c: F.lit("x") for c in ("n_words", "kept", "bad", "intervals", "base_failed")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (5, 1), (6, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = rules.op13_quality_rules(spark, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, *r[1:6], r.base_failed) for r in got))) == sorted(repr((r[0], *plain(r[1]))) for r in rows)
    assert all(r.kept == (not r.base_failed) for r in got)

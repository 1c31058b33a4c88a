from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.operators import answers, chunking, dialog, flow, layout, quality, retrieval, structure

LINE = "source_id string, document_type string, body_size double, page int, line_no int, seq double, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, block int, table boolean"


def scored(questions: DataFrame, items: DataFrame, scope: str = "scope") -> DataFrame:
    """Every question with every item of a scope it may see, and the inner product.

    ``questions (question_id, allowed array, q)``, ``items (item_id, scope, source_id, v)``. The scope is
    a join key: rows out of scope are never scored.
    """
    asked = questions.select("question_id", "q", F.explode("allowed").alias(scope))
    return asked.join(items, scope).select("question_id", "item_id", "source_id", scope, retrieval.dot("q", "v").alias("score"))


@pytest.fixture
def lines(spark):
    """Lines from texts, or (text, changes) pairs."""

    def make(texts, document_type="act", source_id="S"):
        rows = []
        for k, item in enumerate(texts):
            text, change = item if isinstance(item, tuple) else (item, {})
            row = {"source_id": source_id, "document_type": document_type, "body_size": 10.0, "page": 1, "line_no": k, "seq": float(k), "text": text, "x0": 50.0, "y0": 100.0 + 12 * k, "x1": 300.0, "y1": 110.0 + 12 * k, "size": 10.0, "bold": False, "block": k, "table": False}
            rows.append({**row, **change})
        return spark.createDataFrame(pd.DataFrame(rows), LINE)

    return make


def boundaries(df):
    return [(r.boundary.kind, r.boundary.identifier, r.boundary.heading) if r.boundary else None for r in structure.classified(df).orderBy("seq").collect()]


B = {"bold": True}


@pytest.mark.parametrize(
    ("text", "change", "dtype", "want"),
    [
        ("12. Short title.— This Act", {}, "act", ("section", "12", "Short title")), ("12. some body text goes on", {}, "act", None), ("12. Membership", B, "rules", ("rule", "12", "Membership")),
        ("CHAPTER IV", {}, "act", ("chapter", "IV", "CHAPTER IV")), ("FORM VI", B, "rules", ("form", "VI", "FORM VI")), ("Form VI shall be sent", {}, "rules", None), ("form", {}, "rules", None),
        ("FIRST SCHEDULE", {}, "act", ("schedule", "", "FIRST SCHEDULE")), ("2.1 Coverage", B, "scheme_guideline", ("heading", "2.1", "Coverage")), ("2.1 Claims are paid by the bank", {}, "scheme_guideline", ("heading", "2.1", None)),
        ("5. In the said rules, the words", {}, "amendment_rules", ("item", "5", "In the said rules, the words")), ("Statement of Objects and Reasons", {}, "act", ("background", "", "Statement of Objects and Reasons")),
        ("12. Title.— x", {"table": True}, "act", None), ("12. Title.— x", {"size": 6.0}, "act", None), ("Who can complain:", {}, "grievance_guidance", ("heading", "", "Who can complain")),
        ("5. (1) Every member", B, "act", ("section", "5", None)), ("Section 7: Meetings", B, "act", ("section", "7", "Meetings")),
    ],
)
def test_boundaries(lines, text, change, dtype, want):
    assert boundaries(lines([(text, change)], dtype)) == [want]


def test_numbers_inside_a_form_are_no_sections(lines):
    got = boundaries(lines([("FORM VI", B), ("1. Name", B), ("CHAPTER II", B), ("2. Duties", B)]))
    assert [g and g[0] for g in got] == ["form", None, "chapter", "section"]


def test_numerals_belong_to_a_background_statement(lines):
    got = boundaries(lines([("II", B), ("STATEMENT OF OBJECTS AND REASONS", B), ("II", B), "text", ("3. Duties", B), ("IV", B)]))
    assert [g and g[0] for g in got] == [None, "background", "background", None, "section", None]


def test_segments_carry_context_and_mark_falling_numbers(lines):
    df = structure.segmented(structure.classified(lines(["intro", ("PART I", B), ("CHAPTER I", B), ("5. Duties", B), "text", ("4. Rights", B), ("PART II", B), ("6. Fees", B)])))
    rows = [(r.kind, r.identifier, r.part, r.chapter, r.malformed) for r in df.orderBy("seq").collect()]
    assert rows == [
        ("context", "", None, None, False), ("context", "", "PART I", None, False), ("context", "", "PART I", "CHAPTER I", False), ("section", "5", "PART I", "CHAPTER I", False),
        ("section", "5", "PART I", "CHAPTER I", False), ("section", "4", "PART I", "CHAPTER I", True), ("context", "", "PART II", None, False), ("section", "6", "PART II", None, False),
    ]


def test_forward_merge(spark):
    units = spark.createDataFrame([("a", k, w) for k, w in enumerate([10, 50, 5, 6, 90, 7])] + [("b", 0, 3), ("b", 1, 2)], "source_id string, unit_no long, words int")
    got = {(r.source_id, r.unit_no): r.target for r in structure.forward_merged(units, F.col("words") < 40).collect()}
    assert got == {("a", 0): 1, ("a", 1): 1, ("a", 2): 4, ("a", 3): 4, ("a", 4): 4, ("a", 5): 4, ("b", 0): 0, ("b", 1): 1}


def test_dotted_headings_take_the_nearest_ancestor(spark):
    rows = [(1, "heading", "12", "Claims"), (2, "heading", "12.3", "Losses"), (3, "heading", "12.3.1", None), (4, "heading", "12.4.1", None), (5, "heading", "13.1", None)]
    df = spark.createDataFrame([("S", *r) for r in rows], "source_id string, unit_no long, kind string, identifier string, heading string")
    got = {r.identifier: (r.ancestor, r.inherited_heading) for r in structure.inherited_headings(df).collect()}
    assert got == {"12": (None, "Claims"), "12.3": ("12", "Claims"), "12.3.1": ("12.3", "Losses"), "12.4.1": ("12", "Claims"), "13.1": (None, None)}


def test_heading_runs_collapse(spark):
    units = [(1, "heading", "", 5), (2, "heading", "", 6), (3, "heading", "", 12), (4, "section", "1", 90), (5, "heading", "", 30), (6, "heading", "", 3)]
    df = spark.createDataFrame([("S", *u) for u in units], "source_id string, unit_no long, kind string, identifier string, words int")
    assert {r.unit_no: r.target for r in structure.collapsed_headings(df).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6}


def test_unit_ids(spark):
    df = spark.createDataFrame([("S", k, kind, i) for k, (kind, i) in enumerate([("section", "1"), ("section", "1"), ("schedule", ""), ("heading", "2.1")])], "source_id string, unit_no long, kind string, identifier string")
    assert [r.chunk_id for r in structure.unit_ids(df).orderBy("unit_no").collect()] == ["S_SEC_1", "S_SEC_1_002", "S_SCHEDULE_003", "S_SEC_2_1"]


def unit(df, kind="section", heading=None):
    return df.withColumn("unit_no", F.lit(1).cast("long")).withColumn("kind", F.lit(kind)).withColumn("heading", F.lit(heading).cast("string"))


def pieces(df):
    rows = df.groupBy("piece", "piece_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "|").alias("t")).orderBy("piece").collect()
    return [(r.piece_id, r.t) for r in rows]


def test_legal_children(lines):
    long = " word" * 200
    got = pieces(chunking.legal_children(unit(lines(["9. Fees.", "(1) First" + long, "(2) Second" + long, ("(a) inner list of words", {"x0": 90.0}), "Provided that it holds", "(3) Third" + long]))))
    assert [p for p, _ in got] == [None, "1", "2", "3"]
    assert "Provided" in got[2][1] and "(a)" in got[2][1]
    assert chunking.legal_children(unit(lines(["9. Fees.", "(1) Some short words here", "(2) More short words here"]))).count() == 0
    definitions = ["Definitions", "(a) a member is one who joins", "(b) a board is a body of members"]
    assert [p for p, _ in pieces(chunking.legal_children(unit(lines(definitions), heading="Definitions")))] == [None, "a", "b"]
    restart = unit(lines(["(1) First" + long, "(2) Second" + long, "(1) Again" + long]))
    assert chunking.legal_children(restart).count() == 0
    assert chunking.uncertain_numbering(restart).count() == 1
    inline = pieces(chunking.legal_children(unit(lines(["9. Fees.— (1) First" + long, "(2) Second" + long, "(3) Third" + long]))))
    assert [p for p, _ in inline] == [None, "1", "2", "3"]


def test_form_and_replacement_children(lines):
    body = "word " * 400
    form = unit(lines([("FORM VI", B), body, ("Details of applicant", B), body, ("Details of claim", B), body]), "form")
    assert [p for p, _ in pieces(chunking.form_children(form)) if p] == ["1", "2"] or len(pieces(chunking.form_children(form))) == 3
    item = unit(lines(["5. In the said rules", "“9. Fees.— " + body, "10. Rights.— " + body, body]), "item")
    assert [p for p, _ in pieces(chunking.replacement_children(item))] == [None, "9", "10"]


def prose(*texts, page=1, table=False):
    return [flow.Line(flow.cleaned(t, table), page, k, table) for k, t in enumerate(texts)]


def test_prose_packing():
    rng = random.Random(1)
    sentence = lambda n: "The " + " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(n - 1)) + "."
    pieces = chunking.pack_prose(prose(*(sentence(120) for _ in range(8))))
    assert [p.words for p in pieces] == [480, 480]
    long = " ".join(sentence(40) for _ in range(30))
    cut = chunking.pack_prose(prose(long))
    assert len(cut) >= 2 and all(p.words <= 560 for p in cut)
    assert cut[1].text.startswith(re.split(r"(?<=[.]) ", cut[0].text)[-1])  # a sentence of overlap
    assert chunking.pack_prose(prose(sentence(200))) == []
    half = " ".join(sentence(40) for _ in range(15))
    assert chunking.pack_prose([flow.Line(half, 1, 0, False), flow.Line(half, 2, 0, False)]) == []  # over two pages it is not cut


def test_pages_and_words_of_pieces():
    """A piece has the pages of its own lines; a word that lines break is one word."""
    texts = [x for _ in range(5) for x in ("The " + "word " * 150 + "is multi-state co-", "operative in full.")]
    got = chunking.pack_prose([flow.Line(t, 1 + n // 4, n // 2, False) for n, t in enumerate(texts)])
    assert [(p.low, p.high) for p in got] == [(1, 2), (2, 3)]
    assert got[0].text.count("multi-state cooperative in full.") == 3 and got[0].words == 3 * 156


def test_flows_add_up():
    """Flows of parts put together are the flow of all lines, however they are cut."""
    rng = random.Random(4)
    texts = ["co-", "operative one", "bro-", "ken", "so\u00ad", "ft", "(1) item", "Provided that", "a | b\nc | d", "plain", "Plain.", "x co-", "Operative"]
    for _ in range(200):
        lines = [flow.Line(t, rng.choice([1, 1, 2]), rng.choice([1, 2]), "|" in t) for t in rng.choices(texts, k=12)]
        whole = flow.flowed([flow.Flow(x) for x in lines])
        cut = rng.randrange(1, 12)
        parts = flow.flowed([flow.flowed([flow.Flow(x) for x in lines[:cut]]), flow.flowed([flow.Flow(x) for x in lines[cut:]])])
        assert (whole.text, whole.words, whole.low, whole.high) == (parts.text, parts.words, parts.low, parts.high)
        assert whole.words == len(whole.text.split())


def test_table_rows_stay(lines):
    df = lines([("Crop | Rate\nRice |  2 percent", {"table": True})])
    assert layout.reflow(df, ["source_id"]).first().text == "Crop | Rate\nRice | 2 percent" == flow.Flow(prose("Crop | Rate\nRice |  2 percent", table=True)[0]).text


def test_reflow(lines):
    texts = ["A sentence that is bro-", "ken and a co-", "operative one", "goes on", "(1) A new paragraph", "Provided it holds", ("a | row", {"table": True}), "after", "soft­", "ly"]
    df = lines([t if isinstance(t, tuple) else (t, {"block": 1}) for t in texts])
    got = layout.reflow(df, ["source_id"]).first().text
    assert got == "A sentence that is bro-ken and a cooperative one goes on\n\n(1) A new paragraph\n\nProvided it holds\n\na | row\n\nafter softly"


def test_margins_and_contents(spark, lines):
    pages, df = spark.createDataFrame([("S", p, 800.0, 600.0) for p in (1, 2, 3)], "source_id string, page int, height double, width double"), None
    for p in (1, 2, 3):
        part = lines([("The Gazette of India", {"y0": 10.0, "y1": 20.0, "page": p}), (f"- {p} -", {"y0": 780.0, "y1": 790.0, "x0": 290.0, "page": p}), (f"text of page {p}", {"page": p, "y0": 300.0, "y1": 310.0})])
        df = part if df is None else df.unionByName(part)
    titles = spark.createDataFrame([("S", "A title")], "source_id string, title string")
    assert sorted(r.text for r in layout.without_margins(df, pages, titles).collect()) == ["text of page 1", "text of page 2", "text of page 3"]
    toc = lines(["Contents"] + [f"{k}. Title {k}" for k in range(1, 6)]).unionByName(lines([(f"{k}. Title {k}", {"page": 2}) for k in range(6, 11)])).unionByName(lines([("plain text " * 10, {"page": 3})]))
    assert {r.page: r.is_toc for r in layout.contents_pages(toc).collect()} == {1: True, 2: True, 3: False}


def test_spans_and_tables(lines):
    spans = lines([("12.", {"x0": 50.0, "x1": 60.0, "y0": 100.0, "y1": 110.0}), ("Fees", {"x0": 70.0, "x1": 90.0, "y0": 100.0, "y1": 110.0}), ("next", {"y0": 130.0, "y1": 140.0})])
    assert sorted(r.text for r in layout.merged_spans(spans).collect()) == ["12. Fees", "next"]
    cells = lines([("cell", {"x0": 60.0 * (k % 3), "y0": 100.0 + 20 * (k // 3), "y1": 108.0 + 20 * (k // 3)}) for k in range(12)])
    assert layout.table_bands(cells).count() == 1


def test_body_size(lines):
    df = lines([("seven words are in this line now", {"size": 11.0}), ("seven words are in that line now", {"size": 9.0}), "short"])
    assert layout.body_size(df).first().body_size == 11.0


def greedy(pool):
    """The reranking as a choice of one item after another."""
    left, out, seen = list(pool), [], set()
    while left and len(out) < 5:
        def value(x):
            return (0.58 * x["score"] + 0.22 * x["topic"] + 0.15 * x["heading"] + 0.05 * (0.0 if x["source_id"] in seen else 1.0) + x["boost"], x["score"], x["item_id"])

        best = max(left, key=value)
        out.append(best["item_id"])
        seen.add(best["source_id"])
        left.remove(best)
    return out


def test_rerank_equals_greedy_choice(spark):
    rng = random.Random(2)
    rows = [{"question_id": q, "item_id": i, "source_id": f"s{rng.randrange(4)}", "score": rng.choice([0.7, 0.72, 0.75, 0.8]), "topic": rng.choice([0.0, 0.5, 1.0]), "heading": rng.choice([0.0, 0.5]), "boost": rng.choice([0.0, 0.04])} for q in range(60) for i in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(pd.DataFrame(rows))
    got = {}
    for r in retrieval.rerank(df).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.item_id)
    assert got == {q: greedy([r for r in rows if r["question_id"] == q]) for q in range(60)}


def test_scope_comes_before_the_top(spark):
    items = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (2, "b", "x", [0.9, 0.0]), (3, "a", "y", [0.5, 0.0])], "item_id long, scope string, source_id string, v array<double>")
    asked = spark.createDataFrame([(7, ["b"], [1.0, 0.0]), (8, [], [1.0, 0.0])], "question_id long, allowed array<string>, q array<double>")
    assert [(r.question_id, r.item_id) for r in retrieval.top_k(scored(asked, items), 5).collect()] == [(7, 2)]


def test_features(spark):
    row = spark.createDataFrame([("How can I report a claim?", ["claim"], "Reporting of claims")], "question string, topics array<string>, heading_text string")
    got = retrieval.rerank_features(row).first()
    assert (got.topic, got.heading, got.boost) == (0.5, 0.5, L.PROCEDURAL)


def test_windows_by_a_tokenizer(spark):
    """Windows of half words make the text again, with lines on the record before them as far as they fit."""
    halves = lambda t: [(a, b) for m in re.finditer(r"\S+", t) for a, b in ((m.start(), m.start() + len(m[0]) // 2), (m.start() + len(m[0]) // 2, m.end())) if a < b]
    text = " ".join(f"word{k}" for k in range(1000)) + "\n  end "
    fields = "Title: Official title\n" + "Long: " + "x " * 60 + "\nSection: 4"
    df = spark.createDataFrame([("a", text, fields), ("b", "", "Title: x"), (None, "one two", "Title: too long here"), ("c", None, None)], "id string, text string, fields string")
    rows = retrieval.tokenized_windows(df, "id", "text", "fields", halves, tokens=100, width=80).orderBy("id", "window_no").collect()
    own = [r for r in rows if r.id == "a"]
    assert len(own) > 20 and sum(r.weight for r in own) == 2002 and all(len(halves(r.window)) <= 100 for r in own)
    assert "".join(r.window.split("Text: ", 1)[1] for r in own) == text
    assert all(r.window.startswith("passage: Title: Official title\nSection: 4\nText: ") for r in own)
    assert [(r.id, r.window, r.weight) for r in rows if r.id != "a"] == [(None, "passage: Text: one two", 4)]
    with pytest.raises(ValueError, match="no room"):
        retrieval.cut_windows("a b", "", halves, 8, 80, 64, "passage: ")


def test_windows_by_a_public_tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    own = tokenizers.Tokenizer.from_file(str(public.path("word_bpe_49k.json")))
    text = "Straße and naïve words, twice over. " * 200
    windows = retrieval.cut_windows(text, "", lambda t: own.encode(t, add_special_tokens=False).offsets, 512, 440, 64, "passage: ")
    assert "".join(w.split("Text: ", 1)[1] for w, _ in windows) == text and len(windows) > 2


def test_pooled_vectors_of_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k) if k else None, rng.normal(size=3).tolist(), int(w)) for k, w in zip(rng.integers(0, 6, 90), rng.integers(1, 9, 90), strict=True)] + [(3, None, 5)]
    df = spark.createDataFrame(rows, "k long, vector array<double>, weight int").repartition(4)
    got = {r.k: r.vector for r in retrieval.pooled(df, "k").collect()}
    for k in {r[0] for r in rows}:
        mean = np.average([v for i, v, _ in rows if i == k and v], axis=0, weights=[w for i, v, w in rows if i == k and v])
        assert got[k] == pytest.approx((mean / np.linalg.norm(mean)).tolist())
    assert retrieval.pooled(df.limit(0), "k").count() == 0


def test_windows_lose_no_word(spark):
    text = " ".join(f"w{k}" for k in range(1000))
    rows = retrieval.token_windows(spark.createDataFrame([(1, text, "a b"), (2, "", "h")], "id long, text string, header string"), "id", "text", "header").orderBy("id", "window_no").collect()
    first = [r for r in rows if r.id == 1]
    assert [r.weight for r in first] == [440, 440, 120]
    assert " ".join(w for r in first for w in r.window.split()[2:]) == text
    assert [(r.weight, r.window) for r in rows if r.id == 2] == [(0, "h")]


def test_index_holds_active_records_only(spark):
    records = spark.createDataFrame([("c1", "S", "J", "ACTIVE", "some words here", "h"), ("c2", "S", "J", "REVIEW", "x", "h"), ("c3", "S", "J", "REFERENCE_ONLY", "y", "h")], "chunk_id string, source_id string, jurisdiction string, retrieval_status string, text string, heading string")
    sources = spark.createDataFrame([("S", "J")], "source_id string, jurisdiction string")
    rows = retrieval.build_index(records, sources, retrieval.hashed_embedder(32)).collect()
    assert [r.chunk_id for r in rows] == ["c1"] and sum(x * x for x in rows[0].vector) == pytest.approx(1)
    with pytest.raises(Exception, match="active record"):
        retrieval.build_index(records.withColumn("jurisdiction", F.lit("K")), sources, retrieval.hashed_embedder(32)).collect()


def test_packing(spark):
    df = spark.createDataFrame([(1, 1, 10, 900), (1, 2, 11, 200), (1, 3, 12, 90), (2, 1, 20, 5000), (2, 2, 21, 10), (3, 1, 30, 1000)], "question_id long, rank int, item_id long, size long")
    got = sorted((r.question_id, r.item_id, r.place, r.truncated) for r in answers.packed(df, "size", 1000).collect())
    assert got == [(1, 10, 1, False), (1, 12, 2, False), (2, 20, 1, True), (3, 30, 1, False)]


def test_answers(spark):
    cases = spark.createDataFrame([("q1", "How do I report?", "India"), ("q2", "Who is the current secretary?", "India"), ("q3", "And fees?", "India"), ("q4", "Fails", "India"), ("q5", "No json", "India")], "question_id string, question string, jurisdiction string")
    evidence = spark.createDataFrame([(q, 1, f"c-{q}", "Report within 72 hours.") for q in ("q1", "q3", "q4", "q5")], "question_id string, rank int, chunk_id string, text string")

    def responder(prompt):
        if "Fails" in prompt:
            raise TimeoutError

        if "No json" in prompt:
            return "sorry"
        return '{"answer": "Within 72 hours.", "abstained": false, "used_evidence_ids": ["%s"]}' % ("E9" if "fees" in prompt else "E1")

    got = {r.question_id: (r.abstained, r.abstention_reason, r.used_chunk_ids, r.api_status) for r in answers.answer(cases, evidence, responder).collect()}
    assert got["q1"] == (False, None, ["c-q1"], "PASS")
    assert got["q2"] == (True, "CURRENT_SOCIETY_SPECIFIC_FACT_NOT_IN_CORPUS", [], "NOT_CALLED")
    assert got["q3"][:2] == (True, "CITATION_VALIDATION_FAILED")
    assert got["q4"][:2] == (True, "PROVIDER_TIMEOUT_OR_NETWORK_ERROR")
    assert got["q5"][:2] == (True, "MALFORMED_RESPONSE")


def test_unsupported_claims(spark):
    df = spark.createDataFrame([(1, "See Section 12 and rule 4.", "Text of section 12.")], "id long, answer string, evidence string")
    assert [r.claim for r in answers.unsupported_claims(df, "id", "answer", "evidence").collect()] == ["rule 4"]


def test_failed_questions(spark):
    rows = spark.createDataFrame([(1, True, False, True, 0, False, False, None, "PASS"), (2, True, True, True, 0, False, False, "HTTP_413", "HTTP_413"), (3, False, True, True, 1, False, False, None, "NOT_CALLED")], "question_id long, should_answer boolean, abstained boolean, citation_ok boolean, warnings int, violation boolean, leak boolean, failure string, api_status string")
    assert sorted(r.question_id for r in answers.failed_questions(rows).collect()) == [2, 3]
    got = answers.rag_metrics(rows).first()
    assert (got.correct_behavior_count, got.api_failures_after_retries, got.failed) == (2, 1, 2)


@pytest.mark.parametrize(
    ("question", "history", "clarify", "starts"),
    [
        ("What documents do I need?", ["My crop was damaged by flood"], False, "Active subject: crop insurance after crop damage or loss.\n"), ("What documents do I need?", [], False, "What documents"),
        ("What documents do I need?", ["My crop was damaged", "a complaint about deposits"], True, "What"), ("What documents do I need?", ["hello there"], True, "What"), ("Tell me about it", ["x"], True, "Tell"),
        ("Tell me about PACS", ["x"], False, "Tell"), ("what about another problem?", ["x"], True, "what"), ("How long will it take?", ["crop loss by hail", "what next?"], False, "Active subject"),
        ("What documents do I need?", ["crop damage ನಷ್ಟ"], True, "What"),
    ],
)
def test_follow_ups(spark, question, history, clarify, starts):
    asked = spark.createDataFrame([(1, question, "India")], "question_id long, question string, jurisdiction string")
    turns = spark.createDataFrame([(1, 2 * k, "user", t) for k, t in enumerate(history)] + [(1, 2 * k + 1, "assistant", "crop complaint") for k in range(len(history))], "question_id long, turn int, role string, text string")
    got = dialog.contextualized(asked, turns).first()
    assert got.clarify is clarify and got.query.startswith(starts)


def test_recent_conversations(spark):
    store = spark.createDataFrame([("u", k, f"2024-01-{k + 1:02d}") for k in range(25)] + [("u", 99, None)], "owner string, conv long, updated string")
    got = dialog.recent_conversations(store, "owner", "conv", "updated").collect()
    assert len(got) == 20 and min(r.conv for r in got) == 5


def test_quality_checks(spark):
    schema = "chunk_id string, record_type string, parent_id string, source_id string, jurisdiction string, document_type string, source_url string, text string, char_count int, word_count int, page_start int, page_end int, topics array<string>, position int"
    good = ("p", "parent", None, "S", "J", "act", "u", "one two", 7, 2, 1, 1, ["claim"], 0)
    rows = [good, ("c", "child", "p", "S", "J", "act", "u", "one", 3, 1, 1, 1, [], 1), ("d", "child", "zz", "S", "J", "act", "u", "one", 3, 1, 1, 1, [], 2), ("e", "child", None, "S", "J", "act", "u", "one", 4, 1, 3, 2, ["odd"], 3), ("f", "child", "p", "T", "J", "act", "", "x", 1, 1, 1, 1, [], 4)]
    sources = spark.createDataFrame([("S", "J", "act")], "source_id string, jurisdiction string, document_type string")
    got = {(r.chunk_id, r.violation) for r in quality.violations(spark.createDataFrame(rows, schema), sources, ["claim"]).collect()}
    assert got == {("d", "PARENT_MISSING_OR_LATER"), ("e", "CHILD_WITHOUT_PARENT"), ("e", "TEXT_COUNT"), ("e", "PAGE_RANGE"), ("e", "UNKNOWN_TOPIC"), ("f", "METADATA_MISMATCH"), ("f", "MISSING_FIELD")}


def test_audit(spark):
    schema = "chunk_id string, record_type string, parent_id string, source_id string, jurisdiction string, document_type string, authority string, relative_path string, source_url string, retrieved_date string, section string, rule string, clause string, form_number string, heading string, text_scope string, text string, char_count int, word_count int, page_start int, page_end int, topics array<string>, warnings array<string>"
    base = {"record_type": "child", "parent_id": "p", "source_id": "S", "jurisdiction": "J", "document_type": "act", "authority": "A", "relative_path": "r", "source_url": "u", "retrieved_date": "2024-02-05", "section": "1", "rule": None, "clause": None, "form_number": None, "heading": "h", "text_scope": "complete_provision", "text": "one two", "char_count": 7, "word_count": 2, "page_start": 1, "page_end": 1, "topics": [], "warnings": []}
    rows = [{**base, "chunk_id": "p", "record_type": "parent", "parent_id": None, "text": "zero one two", "char_count": 12, "word_count": 3}, {**base, "chunk_id": "a"}, {**base, "chunk_id": "b", "section": None, "text": "three", "char_count": 5, "word_count": 1}, {**base, "chunk_id": "c", "topics": ["membership"], "retrieved_date": "x"}, {**base, "chunk_id": "d", "parent_id": "q", "text": "file Form VI now", "char_count": 9, "word_count": 4}]
    names = [f.split()[0] for f in schema.split(", ")]
    sources = spark.createDataFrame([("S", "J", "act", "A", "r", "u", "05-02-2024")], "source_id string, jurisdiction string, document_type string, authority string, relative_path string, source_url string, retrieved_date string")
    got = {r.chunk_id: (r.audit_flags, r.severity, r.groups) for r in quality.audit(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema), sources, ["membership"]).collect()}
    assert got["p"] == ("", "INFO", "B_SHORT")
    assert got["a"] == ("DUPLICATE_TEXT", "INFO", "B_SHORT")
    assert got["b"] == ("HIERARCHY_REVIEW;MISSING_STRUCTURAL_ID", "REVIEW", "B_SHORT")
    assert got["c"] == ("DUPLICATE_TEXT;METADATA_REVIEW;TOPIC_TAG_REVIEW", "REVIEW", "B_SHORT")
    assert got["d"] == ("FORM_NUMBER_MISSING;MISSING_PARENT;TEXT_COUNT_ERROR", "REVIEW", "B_SHORT")


def test_source_issues(spark):
    schema = "source_id string, title string, filename string, relative_path string, priority string"
    rows = [("a", "t", "x.pdf", "in/x.pdf", "high"), ("b", "", "x.pdf", "../x.pdf", "odd"), ("c", "t", "y.pdf", "z.pdf", "low"), ("c", "t", "z.pdf", "z.pdf", "low")]
    got = [r.metadata_issues for r in quality.source_issues(spark.createDataFrame(rows, schema), ["title"]).orderBy("source_id", "filename").collect()]
    assert got == ["", "missing title; invalid priority; unsafe relative_path", "duplicate source_id; filename differs from relative_path", "duplicate source_id"]


@pytest.mark.parametrize(("path", "ok"), [("a/b.pdf", True), ("a/../b", True), ("../b", False), ("a/../../b", False), ("/a", False), ("C:\\a", False), ("", False), ("a\\b", True)])
def test_paths(spark, path, ok):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(quality.path_is_inside(F.col("p")).alias("x")).first().x is ok


def test_descendant_ranges(spark):
    df = spark.createDataFrame([("a", None, 5, 5), ("b", "a", 1, 2), ("c", "b", 9, 9), ("d", "c", 0, 20), ("e", None, 3, 4)], "node string, parent string, start int, end int")
    got = {r.node: (r.range_start, r.range_end) for r in quality.descendant_ranges(df).collect()}
    assert got == {"a": (0, 20), "b": (0, 20), "c": (0, 20), "d": (0, 20), "e": (3, 4)}


def test_only_transient_failures_are_tried_again(spark):
    """A busy service is asked again after 1 and 2 seconds; a refused request is not."""
    from lexiquarry.operators.answers import respond

    class Failure(Exception):
        def __init__(self, status_code):
            super().__init__()
            self.status_code = status_code

    def responder(prompt):
        raise Failure(int(prompt))

    def wait(seconds):
        assert seconds in (1.0, 2.0)

    rows = spark.createDataFrame([(1, "429"), (2, "413"), (3, "503")], "question_id long, prompt string")
    got = {r.question_id: (r.error, r.retries) for r in respond(rows, responder, wait=wait).collect()}
    assert got == {1: ("HTTP_429", 2), 2: ("HTTP_413", 0), 3: ("HTTP_503", 2)}


def test_span_merge_rules(lines):
    """A lone numeral takes a line of other weight; a bracketed number does not; 36 points are too far."""
    at = lambda x0, x1, y=100.0, **more: {"x0": x0, "x1": x1, "y0": y, "y1": y + 10, **more}
    spans = [("IV.", at(50.0, 60.0)), ("Duties", at(70.0, 90.0, bold=True)), ("(12)", at(50.0, 60.0, 130.0)), ("Fees", at(70.0, 90.0, 130.0, bold=True)), ("a", at(50.0, 60.0, 160.0)), ("b", at(96.0, 99.0, 160.0))]
    got = sorted((r.text, r.x0, r.x1) for r in layout.merged_spans(lines(spans)).collect())
    assert got == [("(12)", 50.0, 60.0), ("Fees", 70.0, 90.0), ("IV. Duties", 50.0, 90.0), ("a", 50.0, 60.0), ("b", 96.0, 99.0)]


def test_empty_pages_count_for_running_headers(spark, lines):
    df = None
    for p in (1, 2, 3):
        part = lines([("The Gazette of India", {"y0": 10.0, "y1": 20.0, "page": p}), (f"text {p}", {"page": p})])
        df = part if df is None else df.unionByName(part)
    titles = spark.createDataFrame([("S", "A title")], "source_id string, title string")
    for n, left in ((10, 3), (11, 6)):  # 3 of 10 pages suffice, 3 of 11 do not
        pages = spark.createDataFrame([("S", p, 800.0, 600.0) for p in range(1, n + 1)], "source_id string, page int, height double, width double")
        assert layout.without_margins(df, pages, titles).count() == left


def test_blocked_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ITEMS", 16)
    monkeypatch.setattr(retrieval, "ASKED", 3)
    rng = random.Random(5)
    items = spark.createDataFrame([(i, f"j{i % 3}", f"s{i % 5}", [float(rng.randrange(4)) for _ in range(3)]) for i in range(120)], "item_id long, scope string, source_id string, v array<double>")
    asked = spark.createDataFrame([(q, ["j0", "j1"][: 1 + q % 2], [float(rng.randrange(4)) for _ in range(3)]) for q in range(10)], "question_id long, allowed array<string>, q array<double>")
    every = scored(asked, items).where("item_id <> question_id")
    few = retrieval.best_scored(asked, items, 4, digits=9, other=True)
    for take in (lambda h: retrieval.top_k(h, 4), lambda h: retrieval.candidate_pool(h, 4)):
        key = lambda r: (r.question_id, r.item_id, r.score)
        assert sorted(map(key, take(few).collect())) == sorted(map(key, take(every).collect()))
    assert few.count() < every.count()


def test_a_circle_of_nodes_is_told(spark):
    df = spark.createDataFrame([("a", "b", 1, 1), ("b", "a", 1, 1)], "node string, parent string, start int, end int")
    with pytest.raises(ValueError, match="circle"):
        quality.descendant_ranges(df, most=4)


def test_statistics_must_match(spark):
    records = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    for stats in ([("a", "w")], [("a", "w"), ("b", ""), ("b", "")]):
        with pytest.raises(Exception, match="statistics"):
            quality.with_stats(records, spark.createDataFrame(stats, "chunk_id string, warning string")).collect()


def test_last_sentences_are_looked_for_from_the_end():
    import re

    from lexiquarry.functions.text import SENTENCE_GAP
    from lexiquarry.operators import chunking

    for text in ("", "one", "One. Two three", "a. " * 900, "The end. " + "word " * 900, "x" * 511 + ". Then it", "x" * 505 + ".  " + "Then " * 102, "Ends. Then.\n\nThen it (1) goes"):
        assert chunking._last_sentence(text) == re.split(SENTENCE_GAP, text)[-1]


def test_words_of_any_white_space(spark):
    texts = ["", " ", "one", " two  words ", "a\tb\nc\r\nd\x0be\x0cf", "a\u00a0b\u2003c", "é è", "a\x1cb", None, "x " * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [0, 0, 1, 2, 6, 3, 2, 1, 0, 50]
    from lexiquarry.functions.text import words

    assert [tuple(r) for r in rows.select(words("t"), words(F.concat("t"))).collect()] == [(n, n) for n in want]


def test_keys_of_a_small_file_are_dealt(spark, tmp_path):
    """What is made of keys may be large where their file is small: it is not left to one task."""
    from lexiquarry.plans import layouts

    spark.range(4001).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert layouts.prose_pieces(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert layouts.book_lines(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_long_lines_that_begin_units(spark):
    """Beyond 25 words a line may begin a unit by its number, its name in capitals or its colon; others are not looked at."""
    from lexiquarry.operators import structure

    more = " of the members" * 12
    cases = [
        ("12. Short title.— This" + more, False, "act", "section"), ("[12. Short title.— This" + more, False, "act", "section"), ("THE FIRST SCHEDULE" + more.upper(), False, "rules", "schedule"), ("FORM VI" + more, True, "rules", "form"),
        ("How to complain" + more + ":", False, "grievance_guidance", "heading"), ("STATEMENT OF OBJECTS AND REASONS" + " ." * 30, False, "act", "background"), ("(1) A member" + more, False, "act", None), ("A member" + more, True, "act", None),
    ]
    rows = [(str(n), 1.0, t, 1, bold, 0, False, d, 10.0, 10.0) for n, (t, bold, d, _) in enumerate(cases)]
    lines = spark.createDataFrame(rows, "source_id string, seq double, text string, page int, bold boolean, block int, table boolean, document_type string, size double, body_size double")
    got = {int(r.source_id): r.boundary.kind if r.boundary else None for r in structure.classified(lines).collect()}
    assert got == {n: c[3] for n, c in enumerate(cases)}

from __future__ import annotations

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions import jsons, tags
from lexiquarry.functions import text as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (X.words, "a  b c d\n", 4), (X.words, None, 0), (X.words, "", 0),
        (X.norm, " a \n b c ", "a b c"), (X.slug, " Rule 12-A (b) ", "RULE_12_A_B"), (X.fold, "STRAßE", "strasse"),
        (X.iso_date, "05-02-2024", datetime.date(2024, 2, 5)), (X.iso_date, "2024-02-05", datetime.date(2024, 2, 5)), (X.iso_date, "5 Feb", None), (X.iso_date, "2024-13-40", None),
        (X.request_tokens, "abcde", 2), (X.has_indic, "ನಮಸ್ಕಾರ", True), (X.has_indic, "hello", False),
        (X.title, "x" * 64, "x" * 64), (X.title, "x" * 65, "x" * 61 + "…"),
        (lambda c: X.safe_prefix(c, 20), "One two. Three four five six", "One two."), (lambda c: X.safe_prefix(c, 20), "no end in this one at all", "no end in this one"), (lambda c: X.safe_prefix(c, 99), "short", "short"),
        (X.claims, "See Section 12-A and FORM vi.", ["section 12-a", "form vi"]), (X.nfkc, "ﬁ x", "fi x"),
        (lambda c: X.sentences(c), "One is here. Two follows! no. Three", ["One is here.", "Two follows! no.", "Three"]),
    ],
)
def test_functions(spark, make, text, want):
    assert one(spark, make(F.col("t")), t=text) == want


def test_reply(spark):
    good = '```json\n{"answer": "Yes", "abstained": false, "used_evidence_ids": ["E1"]}\n```'
    assert one(spark, X.reply("t")["used_evidence_ids"], t=good) == ["E1"]
    for bad in ("no json", '{"answer": "x"}', "", None):
        assert one(spark, X.reply("t").isNull(), t=bad)


VALUE = T.StructType().add("a", "string").add("é", T.ArrayType(T.StringType())).add("n", "long").add("m", T.MapType(T.StringType(), T.LongType())).add("s", T.StructType().add("z", "boolean").add("b", "string"))
VALUES = [
    {"a": 'ä\n"\\u001F \\\x1f\x0b\x01\x7f /', "é": ["🎉", None, ""], "n": -5, "m": {"z": 1, "a\t": None}, "s": {"z": True, "b": None}},
    {"a": None, "é": [], "n": None, "m": {}, "s": None}, {"a": "", "é": None, "n": 0, "m": None, "s": {"z": False, "b": "\r\b\f"}},
]


def test_json_length_and_canonical_form(spark):
    """Against Python's own writer."""
    df = spark.createDataFrame([(v,) for v in VALUES], T.StructType().add("v", VALUE))
    got = df.select(jsons.length(F.col("v"), VALUE).alias("n"), jsons.canonical(F.col("v"), VALUE).alias("c"), jsons.canonical_hash(F.col("v"), VALUE).alias("h")).collect()
    for r, v in zip(got, VALUES, strict=True):
        assert r.n == len(json.dumps(v, ensure_ascii=False))
        want = json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r.c == want and r.h == hashlib.sha256(want.encode()).hexdigest()
    texts = ['{"b": [1, true], "a": {"z": null, "y": "\\u0041\\n"}}', " [ ] ", '"x"', "bad", None]
    texts_df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in texts_df.select(jsons.canonical_text(F.col("t")).alias("c")).collect()] == ['{"a":{"y":"A\\n","z":null},"b":[1,true]}', "[]", '"x"', None, None]


def test_fold_is_full_case_folding(spark):
    """Over all characters, one by one."""
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = [("|".join(every[k : k + 500]),) for k in range(0, len(every), 500)]
    got = spark.createDataFrame(rows, "t string").select("t", X.fold("t").alias("f")).collect()
    wrong = {a for r in got for a, b in zip(r.t.split("|") if "||" not in r.t else [], r.f.split("|"), strict=False) if a.casefold() != b}
    assert all(r.f == r.t.casefold() for r in got), sorted(wrong)[:20]


def test_page_label(spark):
    df = spark.createDataFrame([(3, 3), (3, 5), (3, None), (None, 5)], "a long, b long")
    assert [r.x for r in df.select(X.page_label("a", "b").alias("x")).collect()] == ["p. 3", "pp. 3–5", "p. 3", None]


@pytest.mark.parametrize(("head", "want"), [(b"RIFF\0\0\0\0WAVE", "wav"), (b"\x1aE\xdf\xa3xx", "webm"), (b"OggS", "ogg"), (b"ID3", "mp3"), (b"text", None)])
def test_audio(spark, head, want):
    df = spark.createDataFrame([(bytearray(head),)], "b binary")
    assert df.select(X.audio_kind("b").alias("x")).first().x == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Membership and\nmulti-state eligibility", ["eligibility", "membership", "multistate"]), ("PACS offer many services", ["pacs", "pacs_services"]),
        ("submit the claim within thirty days", ["claim", "timeline"]), ("nothing", []), (None, []),
    ],
)
def test_topics(spark, text, want):
    assert one(spark, tags.topic_tags(F.col("t")), t=text) == want


def test_source_topics_are_added(spark):
    got = one(spark, tags.topic_tags(F.col("t"), given=tags.source_topics(F.lit("MSCS_ACT"))), t="a deposit")
    assert got == ["deposits", "multistate"]


@pytest.mark.parametrize(("text", "want"), [("How do members join?", []), ("May a member vote by voting?", ["elections", "membership"]), ("my claim, a report", ["claim", "reporting"]), ("computerization", [])])
def test_query_topics_take_whole_terms(spark, text, want):
    assert one(spark, tags.query_topics(F.col("t")), t=text) == want


def test_forms(spark):
    number, several = tags.form_number(F.col("t"))
    assert one(spark, F.struct(number.alias("a"), several.alias("b")), t="Submit Form VI or form vii; Form VI") == ("Form VI", True)
    assert one(spark, F.struct(number.alias("a"), several.alias("b")), t="Form VI is blue") == (None, False)
    number, several = tags.form_number(F.col("t"), F.lit("VII"))
    assert one(spark, number, t="Form VI") == "Form VII"


@pytest.mark.parametrize(("text", "want"), [("In section 5, after it shall be inserted", ("insertion", "section 5")), ("words inserted and omitted", (None, None)), ("This amendment", ("amendment", None)), ("plain", (None, None))])
def test_amendments(spark, text, want):
    assert one(spark, F.struct(tags.amendment_action(F.col("t")).alias("a"), tags.affected_provision(F.col("t")).alias("b")), t=text) == want


@pytest.mark.parametrize(
    ("jurisdiction", "question", "want"),
    [
        ("Karnataka", "", ["Central", "India", "Karnataka"]), ("PMFBY", "Maharashtra", ["Central", "India"]), (None, "Karnataka and महाराष्ट्र", ["Central", "India", "Karnataka", "Maharashtra"]),
        ("Unknown", "", ["Central", "India"]), ("France", "", None),
    ],
)
def test_scopes(spark, jurisdiction, question, want):
    assert one(spark, tags.allowed_jurisdictions(F.col("j"), F.col("q")), j=jurisdiction, q=question) == want


@pytest.mark.parametrize(
    ("question", "jurisdiction", "want"),
    [
        ("What do our society own bye-laws say?", "Karnataka", "SOCIETY_SPECIFIC_BYLAWS_NOT_IN_CORPUS"), ("Who is the current chairperson?", "Karnataka", "CURRENT_SOCIETY_SPECIFIC_FACT_NOT_IN_CORPUS"),
        ("Will it be decided in my favour?", "x", "CANNOT_GUARANTEE_OR_PREDICT_LEGAL_OUTCOME"), ("Which act applies?", "Unknown", "UNKNOWN_JURISDICTION_FOR_STATE_DEPENDENT_LEGAL_QUESTION"),
        ("Which act applies in India?", "Unknown", None), ("Which act applies?", "Karnataka", None),
    ],
)
def test_precheck(spark, question, jurisdiction, want):
    assert one(spark, tags.precheck_reason(F.col("q"), F.col("j")), q=question, j=jurisdiction) == want


@pytest.mark.parametrize(
    ("kind", "count", "dtype", "heading", "numbered", "scope", "warnings", "want"),
    [
        ("parent", 5, "act", "", True, "context_only", [], "REFERENCE_ONLY"), ("parent", 5, "act", "", True, "context_only", ["EXTRACTION_QUALITY_REVIEW"], "REVIEW"),
        ("child", 950, "rules", "Schedule II", True, "complete_provision", [], "REFERENCE_ONLY"), ("child", 950, "rules", "", False, "complete_provision", [], "REFERENCE_ONLY"),
        ("child", 950, "act", "", True, "front_matter", ["LONG_CHUNK_NO_SAFE_SPLIT"], "ACTIVE"), ("child", 950, "act", "", True, "complete_provision", ["TOC_REVIEW"], "REVIEW"),
        ("child", 50, "act", "", True, "front_matter", [], "REFERENCE_ONLY"), ("child", 50, "act", "", True, "complete_provision", ["SHORT_CHUNK"], "ACTIVE"),
    ],
)
def test_status(spark, kind, count, dtype, heading, numbered, scope, warnings, want):
    found = tags.retrieval_status(F.lit(kind), F.lit(count), F.lit(dtype), F.lit(heading), F.lit(numbered), F.lit(scope), F.array(*map(F.lit, warnings)).cast("array<string>"))
    assert spark.range(1).select(found.alias("x")).first().x == want


@pytest.mark.parametrize(
    ("text", "count", "want"),
    [("12.A", 2, ["INCOMPLETE_PROVISION"]), ("It means this.", 3, ["SHORT_COMPLETE_PROVISION"]), ("few words", 2, ["SHORT_CHUNK"]), ("x ... 1 y ... 2 z ... 3", 50, ["TOC_REVIEW"]), ("ok", 901, ["LONG_CHUNK_NO_SAFE_SPLIT"]), ("gazette " * 5, 30, ["HEADER_DOMINATED"])],
)
def test_text_warnings(spark, text, count, want):
    assert one(spark, tags.text_warnings(F.col("t"), F.lit(count), F.lit(False), F.lit(True)), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("What documents do I need?", "documents"), (" how long will it take ", "timeline"), ("what next?", "next_step"), ("what documents exist", None)])
def test_intents(spark, text, want):
    assert one(spark, tags.follow_up_intent(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("text", "key", "subject"),
    [
        ("My pmfby crop was lost", "crop_loss_claim", "PMFBY crop insurance after crop damage or loss"), ("a complaint on a deposit in a multi-state society", "complaint_filing", "deposit issue in a multi-state cooperative"),
        ("become a member in Karnataka", "membership_eligibility", "cooperative society membership in Karnataka"), ("PACS hours", "pacs_service", "PACS services"), ("weather", None, None),
    ],
)
def test_contexts(spark, text, key, subject):
    got = one(spark, tags.active_context(F.col("t")), t=text)
    assert (got.key if got else None, got.subject if got else None) == (key, subject)


def test_classes(spark):
    df = spark.createDataFrame([(0, 0), (8, 10), (2, 10), (1, 10)], "u long, t long")
    kind = tags.document_class(F.col("u"), F.col("t"))
    assert [tuple(r) for r in df.select(kind.alias("k"), tags.ocr_advice(kind).alias("o")).collect()] == [("ERROR", "REVIEW"), ("TEXT_BASED", "NO"), ("MIXED", "PARTIAL"), ("LIKELY_SCANNED", "YES")]

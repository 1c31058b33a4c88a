from __future__ import annotations

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import serving as S
from lexiquarry.operators import answers, dialog
from lexiquarry.sources import store
from lexiquarry.streaming import conversations


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("label", "want"), [(" Karnataka ", "Karnataka"), ("Multi-State cooperative", "Multi-State"), (None, "Unknown"), ("Not sure", "Unknown"), ("Goa", None)])
def test_labels(spark, label, want):
    assert value(spark, S.scope_of_label(F.lit(label).cast("string"))) == want


@pytest.mark.parametrize(
    ("name", "kind", "data", "want"),
    [("a.WAV", "audio/wav", b"RIFF\0\0\0\0WAVE", "wav"), ("a.mp3", None, b"ID3", "mp3"), ("a.flac", "audio/flac", b"fLaC", "flac"), ("a.wav", "audio/wav", b"ID3", None), ("a.mp3", "text/html", b"ID3", None), (None, None, b"ID3", None), ("a.ogg", None, b"OggS", None)],
)
def test_uploads(spark, name, kind, data, want):
    df = spark.createDataFrame([(name, kind, bytearray(data))], "n string, k string, d binary")
    assert df.select(S.upload_kind(F.col("n"), F.col("k"), F.col("d")).alias("x")).first().x == want


def test_first_match(spark):
    answers = [("loan", "A"), ("crop loan", "B")]
    assert [value(spark, S.first_match(F.lit(t), answers, "none")) for t in ("Crop LOAN", "rain")] == ["A", "none"]


def test_shown_sources(spark):
    df = spark.createDataFrame([([("a", "T"), None, ("b", ""), ("c", None)],), (None,)], "s array<struct<source_id:string,title:string>>")
    assert [[s.source_id for s in r.x] for r in df.select(S.shown_sources(F.col("s")).alias("x")).collect()] == [["a"], []]


@pytest.mark.parametrize(("answer", "language", "abstained", "want"), [("x", "kn", False, True), (" ", "kn", False, False), ("x", "fr", False, False), ("x", "en", True, False), (None, "en", None, False)])
def test_playable(spark, answer, language, abstained, want):
    assert value(spark, S.playable(F.lit(answer).cast("string"), F.lit(language), F.lit(abstained).cast("boolean"))) is want


def test_translations_fall_back(spark):
    schema = "lang string, key string, label string"
    new = spark.createDataFrame([("hi", "a", "new hi a"), ("en", "c", "new en c")], schema)
    old = spark.createDataFrame([("hi", "a", "old hi a"), ("hi", "b", "old hi b"), ("en", "c", "old en c"), ("en", "d", "old en d")], schema)
    keys = spark.createDataFrame([("hi", k) for k in "abcde"], "lang string, key string")
    assert {r.key: r.label for r in S.translated(keys, [new, old]).collect()} == {"a": "new hi a", "b": "old hi b", "c": "new en c", "d": "old en d", "e": "e"}


def test_stored_conversations(spark):
    schema = "c struct<id:string,title:string,created:string,updated:string,messages:array<struct<id:string,language:string,role:string,content:string,answer:string>>>"
    good = ("1", "t", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", [("m", "en", "user", "q", None), ("n", "hi", "assistant", None, "a")])
    rows = [(good,), ((None, *good[1:]),), ((*good[:2], "never", *good[3:]),), ((*good[:4], [("m", "fr", "user", "q", None)]),), ((*good[:4], [("m", "en", "user", None, None)]),), ((*good[:4], None),)]
    assert [r.x for r in spark.createDataFrame(rows, schema).select(S.stored_well(F.col("c")).alias("x")).collect()] == [True, False, False, False, False, False]


TURNS = "conv_id long, turn long, role string, text string, language string"
TALKS = [
    (1, 0, "user", "My crop was damaged by hail", None), (1, 1, "assistant", "so", None), (1, 2, "user", "What documents do I need?", None), (1, 3, "assistant", "x", None), (1, 4, "user", "thanks for that", None), (1, 5, "user", "Where can I submit it?", None),
    (2, 0, "user", "ಬೆಳೆ ನಷ್ಟ", "kn"), (2, 1, "user", "How long will it take?", None), (3, 0, "user", "ಬೆಳೆ ನಷ್ಟ", None), (3, 1, "user", "How long will it take?", None), (4, 0, "user", "What is that deadline?", None), (None, 0, "user", "crop loss by hail", None), (None, 1, "user", "Can I appeal?", None),
]


def english(texts, languages):
    return texts.where(languages != "kn", "crop loss by hail")


def test_translated_turns(spark):
    """Indic turns whose language is known are translated; without it, or without a translator, the talk is to be clarified."""
    asked = spark.createDataFrame([(k, "How long will it take?", "India") for k in (1, 2, 3, 4)], "question_id long, question string, jurisdiction string")
    turns = [(1, 0, "user", "ಬೆಳೆ ನಷ್ಟ", "kn"), (2, 0, "user", "ಬೆಳೆ ನಷ್ಟ", None), (3, 0, "user", "ಬೆಳೆ ನಷ್ಟ", "en"), (4, 0, "user", "ಬೆಳೆ ನಷ್ಟ", "hi")]
    history = spark.createDataFrame(turns, TURNS.replace("conv_id", "question_id"))

    def told(translate):
        return {r.question_id: r.clarify for r in dialog.contextualized(asked, history, translate).collect()}

    assert told(english) == {1: False, 2: True, 3: True, 4: True}  # of the fourth nothing comes back in English
    assert told(None) == dict.fromkeys((1, 2, 3, 4), True)
    assert told(lambda texts, languages: texts.where(texts.isna(), None))[1] is True


@pytest.mark.parametrize("cuts", [[len(TALKS)], [3, 7, len(TALKS)]])
def test_a_stream_of_turns_follows_up_as_the_table_does(spark, tmp_path, cuts):
    """Whatever files the turns come in, each user turn gets what the batch operator gives it on the turns before it."""
    begin = 0
    for end in cuts:
        spark.createDataFrame(TALKS[begin:end], TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        begin = end
    target = f"file://{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        conversations.followed_up(stream, target, str(tmp_path / "state"), "India", english).awaitTermination(100)
        return {(r.conv_id, r.turn): (r.query, r.clarify) for r in store.read(spark, target).collect()}

    got = run()
    want = {}
    for conv, turn, role, text, _ in TALKS:
        if role == "user":
            asked = spark.createDataFrame([(1, text, "India")], "question_id long, question string, jurisdiction string")
            before = [(1, *t[1:]) for t in TALKS if t[0] == conv and t[1] < turn]
            r = dialog.contextualized(asked, spark.createDataFrame(before, TURNS.replace("conv_id", "question_id")), english).first()
            want[conv, turn] = (r["query"], r.clarify)
    assert got == want and len(got) == sum(t[2] == "user" for t in TALKS)
    assert want[1, 2][1] is False and want[1, 5][1] is True and want[2, 1][0].startswith("Active subject") and want[3, 1][1] is True
    assert run() == got  # nothing new, nothing twice


def test_idle_conversations_are_forgotten():
    """State beyond its time goes; turns too long ago do not count; late turns take their place."""

    class State:
        kept, hasTimedOut, ms = None, False, None
        exists = property(lambda self: self.kept is not None)
        get = property(lambda self: self.kept)

        def update(self, value):
            self.kept = value

        def remove(self):
            self.kept = None

        def setTimeoutTimestamp(self, ms):
            self.ms = ms

        def getCurrentWatermarkMs(self):
            return 0

    state, step = State(), conversations._steps(2, 500)

    def run(*turns):
        frames = (pd.DataFrame([(t, "user", f"text {t}", None, at)], columns=["turn", "role", "text", "language", "at"]) for t, at in turns)
        (out,) = step((1,), frames, state)
        return [[t["turn"] for t in json.loads(r)] for r in out.recent]

    assert run((5, 1000), (3, 900)) == [[], [3]] and state.ms == 1500
    assert run((4, 1100)) == [[3, 5]]
    assert run((6, 1200)) == [[4, 5]]
    assert run((7, 1650)) == [[6]] and state.ms == 2150
    state.hasTimedOut = True
    assert list(step((1,), iter(()), state)) == [] and not state.exists


def test_a_stream_with_times(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, at timestamp"
    begun = datetime.datetime(2024, 1, 1)
    for k, minutes in enumerate((0, 5, 300)):
        spark.createDataFrame([(1, k, "user", f"t{k}", begun + datetime.timedelta(minutes=minutes)), (9, k, "user", None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = conversations.recent_turns(stream, idle="30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = found.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    got = {r.turn: [t.text for t in r.recent] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: [], 1: ["t0"], 2: []}


class Busy(Exception):
    status_code = 429


def test_paced_responder(tmp_path, spark):
    """Calls of a lane are spaced, transient failures wait as told, and a reply that is written down is not asked for again."""
    log = tmp_path / "log"

    def note(*what):
        with log.open("a") as out:
            out.write(json.dumps(what) + "\n")

    def responder(text):
        note("call", text)
        if text == "busy":
            raise Busy
        return text.upper()

    rows = spark.createDataFrame([(k, f"p{k}") for k in range(6)] + [(6, "busy")], "question_id long, prompt string")

    def run():
        got = answers.respond(rows, responder, wait=lambda s: note("wait", s), waits=(5, 10), spacing=3.0, lanes=2, journal=f"file://{tmp_path}/journal").collect()
        lines = [json.loads(x) for x in log.read_text().splitlines()]
        log.write_text("")
        return {r.question_id: (r.raw, r.error, r.retries) for r in got}, lines

    got, lines = run()
    assert got == {**{k: (f"P{k}", None, 0) for k in range(6)}, 6: (None, "HTTP_429", 2)}
    assert [x[1] for x in lines if x[0] == "wait"].count(6.0) == 5  # seven calls on two lanes
    assert sorted(x[1] for x in lines if x[0] == "wait" and x[1] != 6.0) == [5, 10]
    again, lines = run()
    assert again == got and {x[1] for x in lines if x[0] == "call"} == {"busy"}


def evidence_of(spark):
    hits = spark.createDataFrame([(q, r, f"c{(q + r) % 5}") for q in range(6) for r in range(1, 5)], "question_id long, rank int, chunk_id string")
    texts = ["Short text. ", "A sentence of some words. " * 300, 'quoted "x" \\ \n\u0001 end. ' * 100, "é " * 4000]
    records = spark.createDataFrame([(f"c{k}", f"s{k}", "India", t) for k, t in enumerate(texts)], "chunk_id string, source_id string, jurisdiction string, text string")
    return hits, records


def test_records_apart_from_their_hits(spark):
    """Evidence packed by sizes, whose texts come later, is what it is with texts from the beginning."""
    hits, records = evidence_of(spark)
    apart = answers.supplied(hits, records=records).collect()
    assert sorted(map(repr, apart)) == sorted(map(repr, answers.supplied(hits.join(records, "chunk_id")).collect())) and len(apart) > 8
    size = {r.question_id: 0 for r in apart}
    for r in apart:
        size[r.question_id] += len(json.dumps(r.item.asDict(recursive=True), ensure_ascii=False))
    assert max(size.values()) <= 12000


@pytest.mark.parametrize("evaluated", [False, True])
def test_a_case_is_asked_once(spark, tmp_path, evaluated):
    """However often the answers are read, and however often a query has them in its plan."""
    hits, records = evidence_of(spark)
    log = tmp_path / "log"

    def responder(text):
        with log.open("a") as out:
            out.write("asked\n")
        return json.dumps({"answer": "By rule 4 and Section 7 of it.", "abstained": False, "used_evidence_ids": ["E1"]})

    none = F.array().cast("array<string>")
    cases = spark.createDataFrame([(q, "How do I report?", "India") for q in range(6)], "question_id long, question string, jurisdiction string").withColumns({"expected": none, "forbidden": none, "should_answer": F.lit(True)})
    found = answers.answer(cases, hits, responder, records=records)
    rows = (answers.judged(cases, found, records) if evaluated else found.withColumn("cited_source_ids", F.lit(None))).collect()
    assert len(rows) == 6 and len(log.read_text().splitlines()) == 6
    assert all(r.warnings == (2 if evaluated else ["rule 4", "section 7"]) for r in rows)

"""Column functions on requests and responses of a question service."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions.text import audio_kind, filled, fold

# Labels of the form, kinds of audio, languages of speech.
SCOPE_LABELS = {"karnataka": "Karnataka", "maharashtra": "Maharashtra", "multi-state cooperative": "Multi-State", "central / india scheme": "India", "not sure": "Unknown", "": "Unknown"}
AUDIO_TYPES = ["audio/wav", "audio/x-wav", "audio/flac", "audio/mpeg"]
LANGUAGES = L.LANGUAGES


def scope_of_label(label: Column, labels: Mapping[str, str] = SCOPE_LABELS) -> Column:
    """The scope that a label of the form stands for, null for labels that it does not have."""
    given = fold(F.trim(filled(label)))
    out = F.lit(None).cast("string")
    for text, scope in labels.items():
        out = F.when(given == text, scope).otherwise(out)
    return out


def upload_kind(filename: Column, content_type: Column, data: Column) -> Column:
    """wav, flac or mp3 where name, first bytes and declared type agree; null otherwise."""
    kind = audio_kind(data)
    suffix = F.lower(F.regexp_extract(filled(filename), r"\.([^./\\]+)$", 1))
    declared = (filled(content_type) == "") | content_type.isin(AUDIO_TYPES)
    return F.when((suffix == kind) & kind.isin("wav", "flac", "mp3") & F.coalesce(declared, F.lit(False)), kind)


def first_match(text: Column, answers: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The answer of the first pattern that is found."""
    out = F.lit(otherwise)
    for pattern, answer in reversed(answers):
        out = F.when(filled(text).rlike("(?i)" + pattern), answer).otherwise(out)
    return out


def shown_sources(sources: Column) -> Column:
    """Sources of a response that have a title, without nulls; an empty list for none."""
    there = F.filter(sources, lambda s: s.isNotNull() & (F.coalesce(s["title"], F.lit("")) != ""))
    return F.coalesce(there, F.array())


def response(raw: Column) -> Column:
    """A response with what a client relies on: texts and flags for nulls, sources with a title."""
    return F.struct(
        F.coalesce(raw["answer"], F.lit("")).alias("answer"), F.coalesce(raw["abstained"], F.lit(False)).alias("abstained"), raw["abstention_reason"].alias("abstention_reason"),
        raw["jurisdiction"].alias("jurisdiction"), shown_sources(raw["sources"]).alias("sources"),
    )


def playable(answer: Column, language: Column, abstained: Column) -> Column:
    """Whether an answer can be read aloud."""
    return ~F.coalesce(abstained, F.lit(False)) & (F.trim(filled(answer)) != "") & F.coalesce(language.isin(LANGUAGES), F.lit(False))


def translated(keys: DataFrame, tables: Sequence[DataFrame], base: str = "en") -> DataFrame:
    """``lang, key, label`` for ``keys (lang, key)``: the first of ``tables (lang, key, label)`` that has the key
    in the language, else the first that has it in the base language, else the key."""
    rows, found = keys, []
    for languages in ("own", "base"):
        for n, table in enumerate(tables):
            name = f"_{languages}{n}"
            if languages == "own":
                rows = rows.join(table.select("lang", "key", F.col("label").alias(name)), ["lang", "key"], "left")
            else:
                rows = rows.join(table.where(F.col("lang") == base).select("key", F.col("label").alias(name)), "key", "left")
            found.append(name)
    return rows.select("lang", "key", F.coalesce(*found, "key").alias("label"))


def stored_well(conversation: Column) -> Column:
    """Whether a stored conversation has what it needs: ids, a title, times and well-formed messages.

    ``struct<id, title, created, updated, messages: array<struct<id, language, role, content, answer>>>``.
    """
    timed = F.try_to_timestamp(conversation["created"]).isNotNull() & F.try_to_timestamp(conversation["updated"]).isNotNull()

    def good(m: Column) -> Column:
        said = ((m["role"] == "user") & m["content"].isNotNull()) | ((m["role"] == "assistant") & m["answer"].isNotNull())
        return F.coalesce(m["id"].isNotNull() & m["language"].isin(LANGUAGES) & said, F.lit(False))

    return F.coalesce(conversation["id"].isNotNull() & conversation["title"].isNotNull() & timed & F.forall(conversation["messages"], good), F.lit(False))

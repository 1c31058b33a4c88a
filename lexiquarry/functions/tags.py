"""Rule-based tags on texts: topics, forms, amendments, statuses, reasons and intents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions.text import filled, fold, norm, words


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _where(conditions: Mapping[str, Column]) -> Column:
    """The names whose condition holds, in order and without nulls."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()])) if conditions else _strings([])


def topic_tags(text: Column, patterns: Mapping[str, str] = L.TOPICS, given: Column | None = None, hints: Mapping[str, Sequence[str]] = L.TOPIC_HINTS, lowered: Column | None = None) -> Column:
    """Sorted topics whose pattern is found, with those ``given``.

    A pattern is only tried on texts that hold one of its ``hints``, which a plain search tells. ``lowered``
    is the text in lower case where a column has it already, so that it is made once.
    """
    lower = F.lower(filled(text)) if lowered is None else lowered

    def found(topic: str, pattern: str) -> Column:
        match = filled(text).rlike("(?is)" + pattern)
        hinted = [F.contains(lower, F.lit(h)) for h in hints.get(topic, ())]
        return reduce(or_, hinted) & match if hinted else match

    own = _where({k: found(k, p) for k, p in patterns.items()})
    return F.array_sort(F.array_distinct(F.concat(own, given) if given is not None else own))


def source_topics(source_id: Column) -> Column:
    """The topics that a source has by itself."""
    own, source_id = _strings([]), source_id.cast("string")
    for sid, topics in L.SOURCE_TOPICS.items():
        own = F.when(source_id == sid, _strings(topics)).otherwise(own)
    for prefix, topics in L.PREFIX_TOPICS.items():
        own = F.when(source_id.startswith(prefix), _strings(topics)).otherwise(own)
    return own


def record_topics(source_id: Column, heading: Column, subheading: Column, text: Column) -> Column:
    """Sorted topics of a record: those of its source and those that its headings or text name."""
    content = F.concat_ws(" ", F.nullif(heading, F.lit("")), F.nullif(subheading, F.lit("")), text)
    own = topic_tags(content, given=source_topics(source_id))
    eligible = (source_id.cast("string") == L.ELIGIBLE_SOURCE) & content.rlike("(?i)" + L.ELIGIBLE)
    return F.array_sort(F.when(eligible, F.array_union(own, _strings(["eligibility"]))).otherwise(own))


def term_pattern(terms: Sequence[str]) -> str:
    """One of ``terms`` with no letter a to z on either side."""
    quoted = "|".join("".join("\\" + c if c in r"\.+*?()[]{}|^$-" else c for c in t) for t in terms)
    return rf"(?<![a-z])(?:{quoted})(?![a-z])"


def query_topics(text: Column, terms: Mapping[str, Sequence[str]] = L.QUERY_TERMS) -> Column:
    """Sorted topics that a question or a heading names."""
    return F.array_sort(_where({k: fold(text).rlike(term_pattern(t)) for k, t in terms.items()}))


def procedural(question: Column) -> Column:
    return filled(question).rlike("(?i)" + L.PROCEDURAL_QUERY)


def form_mentions(text: Column) -> Column:
    """Forms in the order in which they are first named."""
    found = F.regexp_extract_all(filled(text), F.lit("(?i)" + L.FORM), 1)
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.lit("Form "), F.upper(x))))


def form_number(text: Column, existing: Column | None = None) -> tuple[Column, Column]:
    """The form of a record, and whether several are named where a form matters."""
    forms = form_mentions(text)
    given = F.lit(None).cast("string") if existing is None else F.when(existing.startswith("Form "), existing).otherwise(F.concat(F.lit("Form "), existing))
    specific = given.isNotNull() | filled(text).rlike("(?i)" + L.FORM_CONTEXT)
    first = F.when(specific & (F.size(forms) > 0), F.get(forms, F.lit(0)))
    return F.coalesce(given, first), F.coalesce(specific & (F.size(forms) > 1), F.lit(False))


def amendment_actions(text: Column) -> Column:
    lead = F.substring(filled(text), 1, 1500)
    return _where({k: lead.rlike("(?i)" + p) for k, p in L.ACTIONS.items()})


def amendment_action(text: Column) -> Column:
    """The only action, ``amendment`` if none is named but an amendment is, null otherwise."""
    lead, found = F.substring(filled(text), 1, 1500), amendment_actions(text)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))).when((F.size(found) == 0) & lead.rlike(r"(?i)\bamend(?:ment|ed)\b"), "amendment")


def affected_provision(text: Column) -> Column:
    lead = F.substring(filled(text), 1, 1500)
    kind = F.lower(F.regexp_extract(lead, "(?i)" + L.AFFECTED, 1))
    return F.when(kind != "", F.concat_ws(" ", kind, F.regexp_extract(lead, "(?i)" + L.AFFECTED, 2)))


def blocking(warnings: Column, severe: Sequence[str] = L.SEVERE) -> Column:
    """The warnings that block a record, sorted."""
    return F.array_sort(F.array_intersect(warnings, _strings(severe)))


def retrieval_status(record_type: Column, word_count: Column, document_type: Column, heading: Column, numbered: Column, scope: Column, warnings: Column) -> Column:
    """ACTIVE, REFERENCE_ONLY or REVIEW; ``numbered`` tells whether a section or rule is set."""
    blocked = F.size(blocking(warnings)) > 0
    long = word_count > 900
    tabular = document_type.isin("scheme_guideline", "rules") & (
        filled(heading).rlike("(?i)annex|schedule|form") | F.array_contains(warnings, "TABLE_REVIEW") | ~numbered
    )
    return (
        F.when((record_type == "parent") & F.arrays_overlap(warnings, _strings(["EXTRACTION_QUALITY_REVIEW", "LEGACY_FONT_ENCODING_REVIEW"])), "REVIEW")
        .when(record_type == "parent", "REFERENCE_ONLY")
        .when(long & tabular, "REFERENCE_ONLY")
        .when(long & ~blocked, "ACTIVE")
        .when(blocked, "REVIEW")
        .when(scope.isin("front_matter", "context_only"), "REFERENCE_ONLY")
        .otherwise("ACTIVE")
    )


def text_warnings(text: Column, word_count: Column, context_parent: Column, identified: Column) -> Column:
    """Codes of very short, very long, contents-like and furniture-dominated texts."""
    text = filled(text)
    shell = text.rlike(r"^\s*[\dA-Z().\[\]-]+\s*$")
    operative = text.rlike(r"(?i)[.;:]|omitted|XXX|means|shall")
    short = F.when(word_count < 20, F.when(context_parent, "SHORT_CONTEXT_PARENT").when(shell, "INCOMPLETE_PROVISION").when(identified & operative, "SHORT_COMPLETE_PROVISION").otherwise("SHORT_CHUNK"))
    leaders = F.regexp_count(text, F.lit(r"\.{3,}\s*\d+"))
    furniture = F.regexp_count(text, F.lit(r"(?i)gazette|downloaded from|www\."))
    return F.array_compact(
        F.array(
            short,
            F.when(word_count > 900, F.lit("LONG_CHUNK_NO_SAFE_SPLIT")),
            F.when((leaders >= 3) & ~text.rlike(r"(?i)\b(?:form|signature|address|name)\b"), F.lit("TOC_REVIEW")),
            F.when(furniture > F.greatest(F.lit(3.0), word_count / 15), F.lit("HEADER_DOMINATED")),
        )
    )


def precheck_reason(question: Column, jurisdiction: Column) -> Column:
    """Why a question is not answered, null if it may be."""
    text = fold(question)
    out = F.lit(None).cast("string")
    legal = (fold(jurisdiction) == "unknown") & text.rlike(L.LEGAL_WORD) & ~text.rlike(L.NAMED_SCOPE)
    out = F.when(legal, L.UNKNOWN_REASON).otherwise(out)
    for reason, pattern in reversed(L.PRECHECK):
        out = F.when(text.rlike(pattern), reason).otherwise(out)
    return out


def allowed_jurisdictions(jurisdiction: Column, question: Column) -> Column:
    """The scopes that may be searched, sorted; null for a scope that is not known."""
    value = F.lower(F.trim(F.coalesce(jurisdiction, F.lit("Unknown"))))
    value = F.when(value == "", "unknown").otherwise(value)
    central = _strings(L.CENTRAL)
    named = _where({s: filled(question).rlike("(?i)" + p) for s, p in L.STATES.items()})
    return (
        F.when(value == "karnataka", F.array_append(central, F.lit("Karnataka")))
        .when(value == "maharashtra", F.array_append(central, F.lit("Maharashtra")))
        .when(value.isin(L.CENTRAL_NAMES), central)
        .when(value == "unknown", F.concat(central, named))
    )


def follow_up_intent(text: Column) -> Column:
    """The form of a follow-up question, null for others."""
    value, out = F.trim(filled(text)), F.lit(None).cast("string")
    for name, pattern in reversed(L.INTENTS.items()):
        out = F.when(value.rlike(f"(?i)^(?:{pattern})$"), name).otherwise(out)
    return out


def active_context(text: Column) -> Column:
    """``(subject, procedure, key)`` of a question, null if it names no task."""
    value = norm(text)
    has = {k: value.rlike("(?i)" + p) for k, p in L.FLAGS.items()}
    scheme = F.when(value.rlike(r"(?i)\bpmfby\b"), "PMFBY crop insurance").otherwise("crop insurance")
    issue = F.when(has["deposit"], "deposit issue").otherwise("cooperative issue")
    state = F.when(value.rlike(r"(?i)\bkarnataka\b"), " in Karnataka").when(value.rlike(r"(?i)\bmaharashtra\b"), " in Maharashtra").otherwise("")
    scope = F.when(has["multistate"], " in a multi-state cooperative").otherwise("")
    of = F.when(has["multistate"], " of a multi-state cooperative").otherwise(state)

    def context(subject: Column, procedure: Column, key: str) -> Column:
        return F.struct(subject.alias("subject"), procedure.alias("procedure"), F.lit(key).alias("key"))

    return (
        F.when(has["crop"] & has["crop_loss"], context(F.concat(scheme, F.lit(L.TASKS["crop_loss"][0])), F.lit(L.TASKS["crop_loss"][1]), "crop_loss_claim"))
        .when(has["complaint"], context(F.concat(issue, scope), F.concat(F.lit(L.TASKS["complaint"][1]), issue), "complaint_filing"))
        .when(has["membership"], context(F.concat(F.lit(L.TASKS["membership"][0]), of), F.lit(L.TASKS["membership"][1]), "membership_eligibility"))
        .when(has["pacs"], context(F.lit(L.TASKS["pacs"][0]), F.lit(L.TASKS["pacs"][1]), "pacs_service"))
        .when(has["multistate"], context(F.lit(L.TASKS["multistate"][0]), F.lit(L.TASKS["multistate"][1]), "multistate_issue"))
    )


def follow_up_query(intent: Column, context: Column) -> Column:
    """The search query of a follow-up in its context."""
    focus = F.lit(None).cast("string")
    for name, template in L.FOCUS.items():
        before, after = template.split("{}")
        focus = F.when(intent == name, F.concat(F.lit(before), context["procedure"], F.lit(after))).otherwise(focus)
    focus = F.when((intent == "timeline") & (context["key"] == "crop_loss_claim"), L.CROP_TIMELINE).otherwise(focus)
    return F.concat(F.lit("Active subject: "), context["subject"], F.lit(".\nActive procedure/task: "), context["procedure"], F.lit(".\nFollow-up intent: "), focus, F.lit("."))


def page_status(text: Column, readable: Column | None = None) -> Column:
    """Blank for a page that could not be read, else by its number of characters."""
    size = F.length(F.trim(filled(text)))
    status = F.when(size >= 100, "USABLE_TEXT").when(size > 0, "LOW_TEXT").otherwise("EMPTY")
    return status if readable is None else F.when(readable, status).otherwise("")


def document_class(usable: Column, total: Column) -> Column:
    """TEXT_BASED from 80 in 100 usable pages, MIXED from 20, else LIKELY_SCANNED; ERROR without pages."""
    return F.when(total <= 0, "ERROR").when(usable * 100 >= total * 80, "TEXT_BASED").when(usable * 100 >= total * 20, "MIXED").otherwise("LIKELY_SCANNED")


def ocr_advice(kind: Column) -> Column:
    return F.when(kind == "TEXT_BASED", "NO").when(kind == "MIXED", "PARTIAL").when(kind == "LIKELY_SCANNED", "YES").otherwise("REVIEW")


def word_band(count: Column) -> Column:
    """The word band of a record."""
    return (
        F.when(count < 20, "lt20").when(count < 50, "20_49").when(count < 150, "50_149").when(count <= 450, "150_450").when(count <= 900, "451_900").otherwise("gt900")
    )


def provider_status(reason: Column) -> Column:
    """The HTTP status of a failed answer, null for one that did not fail."""
    return (
        F.when(reason == "GROQ_HTTP_429", 429)
        .when(reason == "GROQ_HTTP_413", 413)
        .when(reason.startswith("GROQ_") | reason.isin("RETRIEVAL_ERROR", "CITATION_VALIDATION_FAILED"), 502)
    )


def request_error(question: Column, history: Column | None = None) -> Column:
    """The HTTP status with which a question is refused, null for one that is taken.

    A history of too many or too long turns does not even parse.
    """
    size = F.length(F.trim(filled(question)))
    out = F.when((size == 0) | (size > L.QUESTION_CHARS), 400)
    if history is None:
        return out
    malformed = (F.size(history) > L.HISTORY) | F.exists(history, lambda x: F.length(x) > L.CONTENT_CHARS)
    return F.when(F.coalesce(malformed, F.lit(False)), 422).otherwise(out)


def speech_error(text: Column) -> Column:
    """The same for a text to be spoken."""
    size = F.length(F.trim(filled(text)))
    return F.when(size == 0, 400).when(size > L.SPEECH_CHARS, 413)


def audio_error(data: Column, language: Column, kind: Column) -> Column:
    """The same for a recording of a known ``kind`` or none."""
    size = F.coalesce(F.length(data), F.lit(0))
    known = F.coalesce(F.lower(F.trim(filled(language))).isin(L.LANGUAGES), F.lit(False))
    return F.when(~known | (size == 0), 400).when(size > L.AUDIO_BYTES, 413).when(kind.isNull(), 400)

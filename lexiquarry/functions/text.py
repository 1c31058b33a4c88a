"""Column functions on texts. All are built-in expressions but :func:`nfkc`."""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filled(text: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column | str) -> Column:
    """Number of words between Unicode white space."""
    return F.size(F.filter(F.split(filled(text), r"(?U)\s+"), lambda w: w != ""))


def ascii_only(text: Column) -> Column:
    """Whether a text has as many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def norm(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(filled(text), r"(?U)\s+", " "))


def slug(value: Column | str) -> Column:
    """Upper case, with each run of other characters than ASCII letters and digits as one underscore."""
    return F.upper(F.btrim(F.regexp_replace(filled(value), "[^A-Za-z0-9]+", "_"), F.lit("_")))


#: Characters whose folded form is another one or several, by the rule of Unicode's full case folding.
_FOLDED = {chr(c): chr(c).casefold() for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)}
_ONE, _MANY = ({c: f for c, f in _FOLDED.items() if (len(f) == 1) is one} for one in (True, False))
_SEVERAL = "[" + "".join(_MANY) + "]"


def fold(text: Column | str) -> Column:
    """Full case folding: letters that differ in case only become equal, also where one becomes several as the sharp s does.

    Texts with none of these letters, nearly all, skip their replacements.
    """
    given = filled(text)
    several = given
    for char, folded in _MANY.items():
        several = F.replace(several, F.lit(char), F.lit(folded))
    many = F.when(given.rlike(_SEVERAL), several).otherwise(given)
    one = F.translate(many, "".join(_ONE), "".join(_ONE.values()))
    ascii_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(~ascii_only(given), F.translate(one, ascii_upper, ascii_upper.lower())).otherwise(F.lower(given))


def content_hash(text: Column | str) -> Column:
    return F.sha2(filled(text).cast("binary"), 256)


def iso_date(value: Column | str) -> Column:
    """A date from yyyy-MM-dd or dd-MM-yyyy; null where neither fits."""
    value = F.trim(filled(value))
    return F.coalesce(
        F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd")),
        F.when(value.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(value, "dd-MM-yyyy")),
    )


#: A sentence ends before a capitalised word of three letters or more.
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z][a-z]{2,}\b)"


def sentences(text: Column | str) -> Column:
    return F.split(filled(text), SENTENCE_GAP)


def safe_prefix(text: Column | str, limit: Column | int) -> Column:
    """At most ``limit`` characters, cut after the last sentence end, else before the last space."""
    text, limit = filled(text), F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(text, F.lit(1), limit)
    ended = F.regexp_extract(head, r"(?s)^(.+[.!?])[ \n]", 1)
    spaced = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    # A lone mark before the first gap is no boundary.
    return F.when(F.length(text) <= limit, text).when(ended != "", ended).otherwise(spaced)


def claims(answer: Column | str) -> Column:
    """Mentions of a section, rule or form with its number, in lower case."""
    return F.regexp_extract_all(fold(norm(answer)), F.lit(r"\b(?:section|rule|form)\s+[a-z0-9]+(?:-[a-z0-9]+)?\b"), 0)


def request_tokens(text: Column | str) -> Column:
    """The token estimate of a request: a token for four characters begun."""
    return F.floor((F.length(filled(text)) + 3) / 4).cast("long")


def has_indic(text: Column | str) -> Column:
    return filled(text).rlike("[\\u0900-\\u097F\\u0C80-\\u0CFF]")


def title(text: Column | str, most: int = 64) -> Column:
    """A conversation title: at most ``most`` characters, shortened ones end in an ellipsis."""
    text = norm(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text)


def page_label(start: Column | str, end: Column | str) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (
        F.when(start.isNull(), None)
        .when(end.isNull() | (start == end), F.format_string("p. %d", start))
        .otherwise(F.format_string("pp. %d–%d", start, end))
    )


def unfenced(raw: Column | str) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(filled(raw)), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")


REPLY = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("abstained", T.BooleanType()),
        T.StructField("abstention_reason", T.StringType()),
        T.StructField("used_evidence_ids", T.ArrayType(T.StringType())),
    ]
)


def reply(raw: Column | str) -> Column:
    """The struct of a reply, null where it is no JSON object with the two required fields."""
    parsed = F.from_json(unfenced(raw), REPLY)
    return F.when(parsed["answer"].isNotNull() & parsed["abstained"].isNotNull(), parsed)


_SPACE = re.compile(r"\s")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC with every space character as a plain space. Spark has no normalisation of its own."""

    def one(value: str | None) -> str:
        # White space of a pattern is what str.isspace() tells, which holds all of the category Zs.
        return _SPACE.sub(" ", unicodedata.normalize("NFKC", value or ""))

    return text.map(one)


def transcript(text: Column | str) -> Column:
    """A transcript with single spaces."""
    return norm(text)


def encoded_audio(data: Column | str) -> Column:
    """Bytes as the text that goes in a request."""
    return F.base64(data)


def decoded_audio(text: Column | str) -> Column:
    """And back; null where the text is not base64."""
    return F.try_to_binary(text, F.lit("base64"))


def audio_kind(data: Column | str) -> Column:
    """The container of an audio file by its first bytes."""
    data = F.col(data) if isinstance(data, str) else data
    lead = F.upper(F.hex(F.substring(data, 1, 12)))
    return (
        F.when(lead.startswith("52494646") & (F.substring(lead, 17, 8) == "57415645"), "wav")
        .when(lead.startswith("1A45DFA3"), "webm")
        .when(lead.startswith("4F676753"), "ogg")
        .when(lead.startswith("664C6143"), "flac")
        .when(lead.startswith("494433") | lead.rlike("^FF[EF]"), "mp3")
        .when(F.substring(lead, 9, 8) == "66747970", "mp4")
    )

"""Follow-up questions and conversation stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions import serving, tags
from lexiquarry.functions.text import filled, has_indic


def last_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = L.HISTORY) -> DataFrame:
    """The last ``n`` turns of each conversation, newest first as ``recency`` 1."""
    return turns.withColumn("recency", F.row_number().over(W.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("recency") <= n)


def shaped_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", n: int = L.HISTORY, most: int = L.CONTENT_CHARS) -> DataFrame:
    """The last ``n`` user and assistant turns, less the assistant's that abstained, without links, cut to ``most`` characters.

    ``turns`` may have a boolean column ``abstained``; such turns count among the last ``n``.
    """
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    said = (F.col("role") == "user") | ~F.coalesce(F.col("abstained"), F.lit(False)) if "abstained" in turns.columns else F.lit(True)
    content = F.substring(F.trim(F.regexp_replace(filled("text"), r"https?://\S+", "")), 1, most)
    return last_turns(spoken, conv, turn, n).where(said).select(conv, turn, "role", "recency", content.alias("content"))


#: English texts for texts and their languages, a batch at a time; null where there is none.
Translate = Callable[[pd.Series, pd.Series], pd.Series]


def english(turns: DataFrame, translate: Translate | None) -> DataFrame:
    """``turns`` with a text in English, null if it cannot be used.

    Texts in Indic script that name their language go to ``translate``, an Arrow batch at a time; others in Indic script, blank ones
    and ones that are too long cannot be used.
    """
    language = F.col("language") if "language" in turns.columns else F.lit(None).cast("string")
    rows = turns.withColumn("text", F.trim(filled("text"))).withColumn("_indic", has_indic("text")).withColumn("_from", F.when(~F.coalesce(language, F.lit("")).isin("", "en"), language))
    fits = (F.length("text") > 0) & (F.length("text") <= L.QUESTION_CHARS)
    plain = rows.withColumn("text", F.when(fits & ~F.col("_indic"), F.col("text")))
    if translate is None:
        return plain.drop("_indic", "_from")
    needs = F.col("_indic") & F.col("_from").isNotNull() & fits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=translate(batch["text"], batch["_from"]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)  # any of them may be null
    foreign = rows.where(needs).mapInPandas(run, kinds).withColumn("text", F.when(F.trim("text") != "", F.trim("text")))
    return plain.where(~needs).unionByName(foreign).drop("_indic", "_from")


def contextualized(questions: DataFrame, history: DataFrame, translate: Translate | None = None) -> DataFrame:
    """``question_id, query, clarify`` for ``questions (question_id, question, jurisdiction)``.

    ``history (question_id, turn, role, text[, language])``: only the last four turns count, user turns of
    them, in :func:`english`. A follow-up needs exactly one task in its history; else it is to be clarified.
    """
    recent = english(last_turns(history, "question_id").where("role = 'user'"), translate)
    asked = questions.select("question_id", "jurisdiction")
    seen = recent.join(asked, "question_id").select(
        "question_id", "recency", tags.follow_up_intent(F.col("text")).alias("intent"), tags.active_context(F.col("text")).alias("context"),
        F.col("text").isNull().alias("unusable"), tags.precheck_reason(F.col("text"), F.col("jurisdiction")).isNotNull().alias("checked"),
    )
    plain = F.col("intent").isNull()
    told = seen.groupBy("question_id").agg(
        F.bool_or("unusable").alias("unusable"), F.coalesce(F.bool_or(plain & F.col("checked")), F.lit(False)).alias("checked"),
        F.size(F.collect_set(F.when(plain, F.col("context.key")))).alias("tasks"),
        F.min_by("context", F.when(plain & F.col("context").isNotNull(), F.col("recency"))).alias("context"),
    )
    any_ = history.select("question_id").distinct().withColumn("_history", F.lit(True))
    rows = questions.join(any_, "question_id", "left").join(told, "question_id", "left").withColumn("intent", tags.follow_up_intent(F.col("question")))
    has = F.coalesce("_history", F.lit(False))
    lost = F.coalesce(F.col("unusable") | F.col("checked"), F.lit(False)) | (F.coalesce("tasks", F.lit(0)) != 1)
    clarify = (
        F.when(~has, False).when(F.trim("question").rlike(f"(?i)^(?:{L.ANOTHER})$"), True)
        .when(F.col("intent").isNull(), filled("question").rlike("(?i)" + L.DEPENDENT)).otherwise(lost)
    )
    query = F.when(has & F.col("intent").isNotNull() & ~clarify, tags.follow_up_query(F.col("intent"), F.col("context"))).otherwise(F.col("question"))
    return rows.select("question_id", query.alias("query"), clarify.alias("clarify"))


def recent_conversations(store: DataFrame, owner: str, conv: str, updated: str, n: int = 20) -> DataFrame:
    """The ``n`` conversations of each owner that were used last; malformed rows are left out."""
    good = store.where(F.col(conv).isNotNull() & F.col(updated).isNotNull())
    return good.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(F.desc(updated), F.asc(conv)))).where(F.col("place") <= n)


def chat(requests: DataFrame, history: DataFrame, answer: Callable[[DataFrame], DataFrame], translate: Translate | None = None) -> DataFrame:
    """``question_id, status, answer, abstained, abstention_reason, scope, sources`` for each request.

    ``requests (question_id, question, label)``, ``history (question_id, turn, role, text[, language])``. A request is refused for its
    length or an unknown scope, or sent back to be clarified, or answered by ``answer``, which gets ``question_id, question,
    jurisdiction`` and gives ``question_id, answer, abstained, abstention_reason, sources``. A provider's failure is its
    HTTP status.
    """
    scope = serving.scope_of_label(F.col("label"))
    # More turns than the limit are refused, so no more than that and one are looked at.
    first = history.withColumn("_k", F.row_number().over(W.partitionBy("question_id").orderBy("turn"))).where(F.col("_k") <= L.HISTORY + 1)
    past = first.groupBy("question_id").agg(F.collect_list("text").alias("_past"))
    rows = requests.join(past, "question_id", "left").withColumn("scope", scope)
    refused = F.coalesce(tags.request_error(F.col("question"), F.coalesce("_past", F.array().cast("array<string>"))), F.when(F.col("scope").isNull(), 400))
    rows = rows.withColumn("refused", refused).drop("_past")
    asked = rows.where("refused is null").select("question_id", F.trim("question").alias("question"), F.col("scope").alias("jurisdiction"))
    told = contextualized(asked, history.join(asked.select("question_id"), "question_id", "left_semi"), translate)
    ready = asked.join(told, "question_id").where("not clarify").select("question_id", F.col("query").alias("question"), "jurisdiction")
    got = answer(ready)
    out = rows.join(told.select("question_id", "clarify"), "question_id", "left").join(got, "question_id", "left")
    failed = tags.provider_status(F.coalesce(F.col("abstention_reason"), F.lit("")))
    unclear = F.coalesce("clarify", F.lit(False))
    return out.select(
        "question_id", F.coalesce("refused", failed, F.lit(200)).alias("status"), F.coalesce("answer", F.lit("")).alias("answer"),
        (F.coalesce("abstained", F.lit(False)) | unclear).alias("abstained"), F.when(unclear, L.CLARIFY).otherwise(F.col("abstention_reason")).alias("abstention_reason"), "scope",
        serving.shown_sources(F.col("sources")).alias("sources") if "sources" in got.columns else F.lit(None).alias("sources"),
    )

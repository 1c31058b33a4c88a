"""Evidence, citations, answers and their metrics."""

from __future__ import annotations

import hashlib
import json
import time
import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from lexiquarry.functions import lexicon as L
from lexiquarry.functions import jsons, tags
from lexiquarry.functions.text import claims, fold, nfkc, norm, reply, request_tokens, safe_prefix
from lexiquarry.sources import store
from lexiquarry.sources.scratch import written


def evidence_block(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with their records, numbered E1, E2, … in rank order; hits without a record are left out."""
    both = hits.join(records, "chunk_id")
    n = F.row_number().over(W.partitionBy("question_id").orderBy("rank"))
    return both.withColumn("evidence_no", n).withColumn("evidence_id", F.concat(F.lit("E"), F.col("evidence_no").cast("string")))


def packed(evidence: DataFrame, size: str, budget: int = L.EVIDENCE_CHARS, by: str = "question_id", order: str = "rank", item: str = "item_id", carried: Sequence[str] = ()) -> DataFrame:
    """Which items fit a budget, taken in order: one that is too large is passed over, later ones may fit.

    If the first is too large it is taken alone, cut. Items of a question (a handful) are folded in an
    array; nothing is joined. ``carried`` columns stay with their item.
    """
    own = "".join(f",`{c}`:{evidence.schema[c].dataType.simpleString()}" for c in carried)
    first = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("shut"), F.array().cast(f"array<struct<item:bigint,cut:boolean,place:bigint{own}>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["shut"] & (acc["used"] + x["size"] <= budget)
        cut = ~acc["shut"] & ~fits & (F.size(acc["kept"]) == 0)
        entry = F.struct(x["item"].alias("item"), cut.alias("cut"), (F.size(acc["kept"]) + 1).cast("long").alias("place"), *[x[c].alias(c) for c in carried])
        return F.struct(
            F.when(fits, acc["used"] + x["size"]).when(cut, F.lit(budget).cast("long")).otherwise(acc["used"]).alias("used"),
            (acc["shut"] | cut).alias("shut"),
            F.when(fits | cut, F.array_append(acc["kept"], entry)).otherwise(acc["kept"]).alias("kept"),
        )

    rows = evidence.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("order"), F.col(item).cast("long").alias("item"), F.col(size).cast("long").alias("size"), *carried))).alias("items"))
    kept = rows.select(by, F.explode_outer(F.aggregate("items", first, step)["kept"]).alias("k"))
    return kept.select(by, F.col("k.item").alias(item), F.col("k.place").alias("place"), F.col("k.cut").alias("truncated"), *[F.col(f"k.{c}").alias(c) for c in carried])


def prompt(question: Column, jurisdiction: Column, evidence: Column) -> Column:
    """The request to a responder."""
    return F.concat(
        F.lit("Use only the numbered evidence. Where it does not answer the question, abstain.\nReply with JSON: answer, abstained, abstention_reason, used_evidence_ids.\n\nScope: "),
        F.coalesce(jurisdiction, F.lit("Unknown")), F.lit("\nQuestion: "), question, F.lit("\nEvidence: "), evidence,
    )


class Journal:
    """Replies by the request's hash, each a small file put in place by a rename, so that a task that runs again does not ask again."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, request: str):
        system, root = store.opened(self.folder)
        digest = hashlib.sha256(request.encode()).hexdigest()
        return system, f"{root}/{digest[:2]}", digest

    def known(self, request: str) -> tuple[str, int] | None:
        system, folder, name = self._path(request)
        if system.get_file_info(f"{folder}/{name}.json").type == store.files.FileType.NotFound:
            return None
        with system.open_input_stream(f"{folder}/{name}.json") as stream:
            return tuple(json.loads(stream.read()))

    def note(self, request: str, raw: str, retries: int) -> None:
        system, folder, name = self._path(request)
        system.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(json.dumps([raw, retries]).encode())
        system.move(part, f"{folder}/{name}.json")


def respond(
    requests: DataFrame, responder: Callable[[str], str], attempts: int = 3, wait: Callable[[float], None] = time.sleep, waits: Sequence[float] | None = None, spacing: float = 0.0, lanes: int | None = None, journal: str | None = None
) -> DataFrame:
    """``question_id, raw, error, retries``: the responder's replies to ``requests (question_id, prompt, …)``; other columns go along.

    A failure whose ``status_code`` or ``code`` is transient is tried again after 1, 2, 4, … seconds, or after those of ``waits``; a
    time-out and any other failure are not. With ``spacing``, calls begin at least so many seconds apart over the whole job:
    requests are dealt to ``lanes`` partitions (1 if not told), and each of them leaves ``spacing * lanes`` seconds between its calls. With a
    ``journal`` folder, which all executors share, a reply is written down before the next call, and a request that has one there is
    not sent again; failures are not written down.
    """
    pause = list(waits) if waits is not None else [2.0**k for k in range(attempts)]
    lanes = lanes or (1 if spacing else None)

    def status(error: Exception) -> int | None:
        given = getattr(error, "status_code", None) or getattr(error, "code", None)
        return int(given) if str(given).isdigit() else None

    others = [c for c in requests.columns if c not in ("question_id", "prompt")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes, called = Journal(journal) if journal else None, False
        for batch in batches:
            out = []
            for text in batch.column("prompt").to_pylist():
                known = notes.known(text) if notes else None
                if known:
                    out.append((known[0], None, known[1]))
                    continue
                if called and spacing:
                    wait(spacing * lanes)
                called = True
                for k in range(attempts):
                    try:
                        raw = responder(text)
                        if notes:
                            notes.note(text, raw, k)
                        out.append((raw, None, k))
                        break
                    except Exception as error:  # noqa: BLE001  what a client raises is its own
                        code = status(error)
                        if code in L.TRANSIENT and k < attempts - 1:
                            wait(pause[min(k, len(pause) - 1)])
                            continue
                        told = "TIMEOUT_OR_NETWORK_ERROR" if isinstance(error, TimeoutError) else f"HTTP_{code}" if code else "API_ERROR"
                        out.append((None, told, k))
                        break
            kept, types = ["question_id", *others], (pa.string(), pa.string(), pa.int32())
            told = [pa.array([r[n] for r in out], t) for n, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *told], names=[*kept, "raw", "error", "retries"])

    dealt = requests.repartition(lanes, "question_id") if lanes else requests
    schema = StructType([requests.schema[c] for c in ("question_id", *others)]).add("raw", "string").add("error", "string").add("retries", T.IntegerType())
    return dealt.select("question_id", "prompt", *others).mapInArrow(run, schema)


def citations(used: DataFrame, supplied: DataFrame, by: str, item: str) -> DataFrame:
    """Per use whether the item was supplied."""
    known = supplied.select(by, item, F.lit(True).alias("supplied")).distinct()
    return used.join(known, [by, item], "left").fillna(False, ["supplied"])


def unsupported_claims(answers: DataFrame, by: str, answer: str, evidence: str) -> DataFrame:
    """``by, claim`` for each section, rule or form of the answer that its evidence does not name."""
    rows = answers.select(by, F.explode_outer(claims(nfkc(answer))).alias("claim"), fold(norm(nfkc(evidence))).alias("_evidence"))
    return rows.where(~F.contains("_evidence", F.col("claim"))).select(by, "claim")


#: What a responder is told of a record, and what a citation shows.
TOLD = ("source_id", "title", "jurisdiction", "document_type", "section", "subsection", "rule", "subrule", "clause", "heading", "topics", "page_start", "page_end")
CITED = ("chunk_id", "source_id", "title", "section", "subsection", "rule", "clause", "heading", "page_start", "page_end", "source_url")


def _there(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.col(c).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names]


def supplied(evidence: DataFrame, budget: int = L.EVIDENCE_CHARS, records: DataFrame | None = None) -> DataFrame:
    """``question_id, place, chunk_id, item`` of the evidence that fits the budget, numbered anew.

    ``evidence (question_id, rank, chunk_id, text, …)``, or hits without text and the ``records (chunk_id, text, …)`` that they point to; an
    item is a struct of the record's ``metadata`` and ``text``. Sizes are those of the items as JSON; a first item that is too large is
    cut at a sentence. With ``records``, sizes are taken where these are, and only texts that are supplied are moved.
    """
    named = F.lit("E") if records is None else F.lit("")
    told = evidence if records is None else records
    meta = F.struct(*_there(told, TOLD), (F.concat(named, F.col("rank").cast("string")) if records is None else named).alias("evidence_id"))
    own = told.select(*([] if records is not None else ["question_id", "rank"]), "chunk_id", "text", meta.alias("metadata"))
    sized = own.withColumns({"size": jsons.length(F.struct("metadata", "text"), own.select("metadata", "text").schema), "chars": F.length("text")})
    if records is not None:
        number = F.coalesce(F.length(F.concat(F.lit("E"), F.col("rank").cast("string"))), F.lit(2))  # null is two longer than no characters
        sized = evidence.select("question_id", "rank", "chunk_id").join(sized.select("chunk_id", "size", "chars"), "chunk_id").withColumn("size", F.col("size") + number)
    kept = packed(sized.withColumn("item_id", F.col("rank").cast("long")).withColumn("whole", F.col("size")), "size", budget, carried=("chunk_id", "whole", "chars"))
    both = kept.join(own, "chunk_id") if records is not None else kept.drop("chunk_id").join(own.withColumn("item_id", F.col("rank").cast("long")), ["question_id", "item_id"])
    room = F.greatest(F.lit(1), budget - (F.col("whole") - F.col("chars"))).cast("int")
    text = F.when(F.col("truncated"), safe_prefix("text", room)).otherwise(F.col("text"))
    number = F.concat(F.lit("E"), F.col("place").cast("string"))
    return both.select("question_id", "place", "chunk_id", F.struct(F.col("metadata").withField("evidence_id", number).alias("metadata"), text.alias("text")).alias("item"))


@F.pandas_udf(T.StringType())
def _searched(text: pd.Series) -> pd.Series:
    """A text as claims are looked for in it: what :func:`nfkc`, :func:`norm` and :func:`fold` make of it, in one pass."""
    return text.map(lambda t: " ".join(unicodedata.normalize("NFKC", t or "").split()).casefold())


def answer(cases: DataFrame, evidence: DataFrame, responder: Callable[[str], str], wait: Callable[[float], None] = time.sleep, records: DataFrame | None = None, **paced: object) -> DataFrame:
    """Answers of ``cases (question_id, question, jurisdiction)`` from ``evidence`` and ``records`` as in :func:`supplied`.

    Cases with a reason against answering are not sent; ``paced`` goes to :func:`respond`. A reply that is no valid JSON, or cites what was
    not supplied, or answers without evidence, becomes an abstention. ``warnings`` are claims that no evidence names. A question's
    evidence is gathered once and goes through the responder in one row; the answers are written, so that what reads them several times
    does not ask again.
    """
    reasoned = cases.withColumn("reason", tags.precheck_reason(F.col("question"), F.col("jurisdiction")))
    asked = reasoned.where("reason is null")
    block = supplied(evidence.join(asked.select("question_id"), "question_id", "left_semi"), records=records)
    lists = block.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", F.to_json("item", {"ignoreNullFields": "false"}).alias("json")))).alias("items"))
    joined = F.coalesce(F.concat(F.lit("["), F.array_join(F.col("items.json"), ", "), F.lit("]")), F.lit("[]"))
    told = asked.join(lists, "question_id", "left").withColumn("_evidence", joined)
    told = told.withColumn("prompt", prompt(F.col("question"), F.col("jurisdiction"), F.col("_evidence")))
    requests = told.select("question_id", "prompt", F.coalesce("items.chunk_id", F.array().cast("array<string>")).alias("chunk_ids"), request_tokens(F.coalesce("prompt", F.lit(""))).alias("request_tokens"), "_evidence")
    got = respond(requests, responder, wait=wait, **paced).withColumn("r", reply("raw")).withColumn("reason", F.lit(None).cast("string"))
    passed = reasoned.where("reason is not null").select("question_id", "reason", F.lit(0).cast("long").alias("request_tokens"))
    rows = got.unionByName(passed, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    # Numbers are places from 1 on without gaps.
    ids = F.transform(F.coalesce("chunk_ids", none), lambda x, k: F.concat(F.lit("E"), (k + 1).cast("string")))
    used = F.coalesce(F.col("r.used_evidence_ids"), none)
    bad = (F.size(F.array_except(used, ids)) > 0) | (~F.col("r.abstained") & (F.size(used) == 0))
    failure = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("error").isNotNull(), F.concat(F.lit("PROVIDER_"), F.col("error")))
        .when(F.col("r").isNull(), "MALFORMED_RESPONSE").when(bad, "CITATION_VALIDATION_FAILED")
        .when(F.col("r.abstained"), F.coalesce(F.col("r.abstention_reason"), F.lit("ABSTAINED")))
    )
    chunks = F.transform(used, lambda u: F.get("chunk_ids", F.substring(u, F.lit(2), F.length(u)).try_cast("int") - 1))
    found = rows.select(
        "question_id", F.when(failure.isNull(), F.col("r.answer")).otherwise("").alias("answer"), failure.isNotNull().alias("abstained"), failure.alias("abstention_reason"),
        F.when(failure.isNull(), chunks).otherwise(none).alias("used_chunk_ids"),
        F.when(F.col("reason").isNotNull(), "NOT_CALLED").when(F.col("error").isNotNull(), F.col("error")).otherwise("PASS").alias("api_status"), F.coalesce("retries", F.lit(0)).alias("retries"),
        "request_tokens", "_evidence",
    )
    found = found.withColumn("_claims", claims(nfkc("answer")))
    needed = ~F.col("abstained") & (F.size("_claims") > 0)
    found = found.withColumn("_evidence", _searched(F.when(needed, F.col("_evidence"))))
    lacking = F.array_sort(F.array_distinct(F.filter("_claims", lambda c: ~F.contains("_evidence", c))))
    return written(found.withColumn("warnings", F.when(needed, lacking).otherwise(none)).drop("_evidence", "_claims"), "answers")


def cited(answers: DataFrame, records: DataFrame) -> DataFrame:
    """``question_id, place`` and the columns of a citation for each used chunk of an answer, in order."""
    used = answers.select("question_id", F.posexplode("used_chunk_ids").alias("place", "chunk_id"))
    return used.join(records.select(*_there(records, CITED)), "chunk_id").select("question_id", "place", *CITED)


def judged(cases: DataFrame, answers: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of a batch evaluation: the columns of :func:`rag_metrics`, and the sources cited.

    ``cases (question_id, question, jurisdiction, expected, forbidden, should_answer)``.
    """
    where = answers.select("question_id", F.explode("used_chunk_ids").alias("chunk_id")).join(records.select("chunk_id", "source_id", F.col("jurisdiction").alias("_j")), "chunk_id")
    where = where.groupBy("question_id").agg(F.array_sort(F.collect_set("source_id")).alias("cited_source_ids"), F.collect_set("_j").alias("_scopes"))
    rows = cases.join(answers, "question_id").join(where, "question_id", "left")
    none = F.array().cast("array<string>")
    allowed = F.coalesce(tags.allowed_jurisdictions(F.col("jurisdiction"), F.col("question")), none)
    failed = F.col("abstention_reason") == "CITATION_VALIDATION_FAILED"
    broken = (F.col("api_status") != "PASS") & (F.col("api_status") != "NOT_CALLED")
    return rows.select(
        "question_id", "should_answer", "abstained", F.coalesce(~failed, F.lit(True)).alias("citation_ok"), F.size("warnings").alias("warnings"),
        (F.size(F.array_except(F.coalesce("_scopes", none), allowed)) > 0).alias("violation"), (F.size(F.array_intersect(F.coalesce("cited_source_ids", none), F.coalesce("forbidden", none))) > 0).alias("leak"),
        F.when(broken, F.col("api_status")).when(F.coalesce(failed, F.lit(False)), F.lit("CITATION_VALIDATION_FAILED")).alias("failure"), "api_status", F.coalesce("cited_source_ids", none).alias("cited_source_ids"), "retries",
    )


def _judged() -> tuple[Column, Column]:
    """Whether a case behaved as it should, and whether anything is wrong with it."""
    right = F.col("abstained") == ~F.col("should_answer")
    return right, ~right | ~F.col("citation_ok") | (F.col("warnings") > 0) | F.col("violation") | F.col("leak") | (F.coalesce("failure", F.lit("")) != "")


def rag_metrics(rows: DataFrame) -> DataFrame:
    """Counts and rates over ``(question_id, should_answer, abstained, citation_ok, warnings, violation, leak, failure, api_status)``."""
    right, bad = _judged()
    return rows.agg(
        F.count("*").alias("total_questions"), F.count_if("should_answer").alias("answerable_questions"), F.count_if(~F.col("should_answer")).alias("abstention_questions"),
        F.count_if(right).alias("correct_behavior_count"), F.avg(right.cast("double")).alias("correct_behavior_rate"),
        F.count_if(~F.col("citation_ok")).alias("citation_validation_failures"), F.count_if(F.col("warnings") > 0).alias("unsupported_claim_warnings"),
        F.count_if("violation").alias("jurisdiction_violations"), F.count_if("leak").alias("forbidden_source_leakage"),
        F.count_if((F.coalesce("failure", F.lit("")) != "") & (F.col("api_status") != "NOT_CALLED")).alias("api_failures_after_retries"),
        F.count_if(bad).alias("failed"),
    )


def failed_questions(rows: DataFrame) -> DataFrame:
    """The ids of the cases with which anything is wrong."""
    return rows.where(_judged()[1]).select("question_id")


def answer_blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Blocks of an answer between blank lines: ordered list, bullet list or paragraph."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(b, F.lit(" \t\r\n"))), lambda b: b != "")
    rows = texts.select(key, F.posexplode_outer(parts).alias("block_no", "block")).where("block_no is not null")
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    return rows.select(
        key, "block_no",
        F.when(F.forall(lines, lambda x: x.rlike(r"^\s*\d+[.)]\s+")), "ordered").when(F.forall(lines, lambda x: x.rlike(r"^\s*[-*•]\s+")), "bullets").otherwise("paragraph").alias("kind"),
        F.size(lines).alias("lines"), F.size(F.regexp_extract_all("block", F.lit(r"\*\*([^*]+)\*\*"), 1)).alias("bold_spans"), "block",
    )


def presented_sources(rows: DataFrame, by: str, keys: list[str], order: str) -> DataFrame:
    """Of citations that look alike the first one."""
    n = F.row_number().over(W.partitionBy(by, *keys).orderBy(order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")

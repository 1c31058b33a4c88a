"""Queries of the answer path: retrieval, evidence, prompts, answers, citations, judgements and conversations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import serving, tags
from lexiquarry.functions.text import content_hash
from lexiquarry.operators import answers, dialog, retrieval
from lexiquarry.plans.common import dealt, registry, sampled, sql_quote, sql_rows, sql_sampled, table
from lexiquarry.sources.scratch import fresh
from lexiquarry.streaming import conversations

QUERIES, ORACLE_SQL, query = registry()

#: Records and cases: a record and a question per customer, five hits a question, some of which have no record.
_HITS = "h AS (SELECT c_custkey AS question_id, r AS rank, 'c' || (c_custkey * (r % 2 + 1) + r * 7 - 20) AS chunk_id FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS r))"
_RECORDS = "c AS (SELECT 'c' || c_custkey AS chunk_id, c_custkey AS k, 's' || (c_custkey % 6) AS source_id, c_mktsegment AS title, repeat('Text ' || c_custkey || ' ends. ', CAST(c_custkey % 9 * 60 + CASE WHEN c_custkey % 9 = 7 THEN 1500 ELSE 1 END AS INTEGER)) AS text FROM customer)"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("rank"))
    return rows.withColumn("chunk_id", F.concat(F.lit("c"), (F.col("question_id") * (F.col("rank") % 2 + 1) + F.col("rank") * 7 - 20).cast("string")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    times = (k % 9 * 60 + F.when(k % 9 == 7, 1500).otherwise(1)).cast("int")
    return dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(
        F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.concat(F.lit("s"), (k % 6).cast("string")).alias("source_id"), F.col("c_mktsegment").alias("title"), F.repeat(F.concat(F.lit("Text "), k.cast("string"), F.lit(" ends. ")), times).alias("text"),
        F.when(k % 4 == 0, "Karnataka").otherwise("India").alias("jurisdiction"), F.lit(None).cast("string").alias("section"), F.lit("http").alias("source_url"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"),
    )


@query(f"WITH {_HITS}, {_RECORDS}, j AS (SELECT question_id, rank, h.chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n FROM h JOIN c ON c.chunk_id = h.chunk_id) SELECT question_id, rank, chunk_id, 'E' || n AS evidence_id FROM j")
def evidence_blocks(spark, sf_dir):
    """Hits with their records, numbered; hits without a record are left out."""
    return answers.evidence_block(hits(spark, sf_dir), records(spark, sf_dir)).select("question_id", "rank", "chunk_id", "evidence_id")


#: Characters of an item as JSON beside its text: names, brackets, title, source and number.
_META = "14 + length('\"metadata\": {{\"source_id\": \"' || source_id || '\", \"title\": \"' || title || '\", \"jurisdiction\": \"' || CASE WHEN k % 4 = 0 THEN 'Karnataka' ELSE 'India' END || '\", \"document_type\": null, \"section\": null, \"subsection\": null, \"rule\": null, \"subrule\": null, \"clause\": null, \"heading\": null, \"topics\": null, \"page_start\": 1, \"page_end\": 2, \"evidence_id\": \"E1\"}}')"
_PACK = f"""
{_HITS}, {_RECORDS}, e AS (SELECT question_id, rank, h.chunk_id, length(text) + {_META.replace('{{', '{').replace('}}', '}')} AS size, length(text) AS chars, text, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS n FROM h JOIN c ON c.chunk_id = h.chunk_id),
p AS (SELECT question_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, false AS shut, CAST(0 AS BIGINT) AS place, '' AS chunk_id, false AS cut, false AS took, CAST(0 AS BIGINT) AS size, '' AS text FROM (SELECT DISTINCT question_id FROM e)
  UNION ALL SELECT e.question_id, e.n, CASE WHEN NOT shut AND used + e.size <= 12000 THEN used + e.size ELSE used END, shut OR (used + e.size > 12000 AND place = 0), place + CASE WHEN NOT shut AND (used + e.size <= 12000 OR place = 0) THEN 1 ELSE 0 END, e.chunk_id,
    NOT shut AND used + e.size > 12000 AND place = 0, NOT shut AND (used + e.size <= 12000 OR place = 0), e.size, e.text FROM p JOIN e ON e.question_id = p.question_id AND e.n = p.n + 1),
s AS (SELECT question_id, place, chunk_id, cut, CASE WHEN cut THEN regexp_extract(left(text, CAST(12000 - (size - length(text)) AS INTEGER)), '(?s)^(.+[.!?])[ \\n]', 1) ELSE text END AS text FROM p WHERE took)
"""


@query(f"WITH RECURSIVE {_PACK} SELECT question_id, place, chunk_id, 'E' || place AS evidence_id, sha256(text) AS text_hash, length(text) AS chars FROM s")
def supplied_evidence(spark, sf_dir):
    """Evidence in the budget by its size as JSON; a first item that is too large is cut at a sentence."""
    item = F.col("item")
    return answers.supplied(hits(spark, sf_dir), records=records(spark, sf_dir)).select("question_id", "place", "chunk_id", item["metadata"]["evidence_id"].alias("evidence_id"), content_hash(item["text"]).alias("text_hash"), F.length(item["text"]).alias("chars"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    question = F.element_at(F.array(*[F.lit(q) for q in ("How do I report?", "Who is the current secretary?", "And fees?", "Fails at once", "No json", "Busy for a while", "Busy always", "Abstain", "Unused")]), (k % 9 + 1).cast("int"))
    s = lambda n: F.array(F.concat(F.lit("s"), ((k + n) % 6).cast("string")))
    return table(spark, sf_dir, "customer").select(k.alias("question_id"), question.alias("question"), F.when(k % 2 == 0, "India").otherwise("Karnataka").alias("jurisdiction"), s(0).alias("expected"), s(1).alias("forbidden"), (k % 9 != 1).alias("should_answer"))


class Unavailable(Exception):
    status_code = 503


def scripted():
    """A responder whose replies follow from the question; some of its failures pass."""
    asked: dict[str, int] = {}

    def respond(prompt: str) -> str:
        question = prompt.split("\nQuestion: ", 1)[1].split("\n", 1)[0]
        if question.startswith("Fails"):
            raise TimeoutError
        if question == "Busy always":
            raise Unavailable
        if question.startswith("Busy"):  # only what will be asked again is kept
            asked[prompt] = asked.get(prompt, 0) + 1
            if asked[prompt] < 3:
                raise Unavailable
            del asked[prompt]
        if question == "No json":
            return "sorry"
        if question == "Abstain":
            return json.dumps({"answer": "", "abstained": True, "abstention_reason": "NO_EVIDENCE"})
        used = ["E9"] if "fees" in question else [] if question == "Unused" else ["E2", "E1"] if '"E2"' in prompt else ["E1"]
        return json.dumps({"answer": "Report it under section 7 and Text 5.", "abstained": False, "used_evidence_ids": used})

    return respond


_ANSWERS = f"""
{_PACK}, u AS (SELECT question_id, list(chunk_id ORDER BY place DESC) AS two FROM s WHERE place <= 2 GROUP BY question_id),
a AS (SELECT c_custkey AS question_id, c_custkey % 9 AS kind, u.two, CASE c_custkey % 9 WHEN 1 THEN 'CURRENT_SOCIETY_SPECIFIC_FACT_NOT_IN_CORPUS' WHEN 2 THEN 'CITATION_VALIDATION_FAILED' WHEN 3 THEN 'PROVIDER_TIMEOUT_OR_NETWORK_ERROR' WHEN 4 THEN 'MALFORMED_RESPONSE' WHEN 6 THEN 'PROVIDER_HTTP_503' WHEN 7 THEN 'NO_EVIDENCE' WHEN 8 THEN 'CITATION_VALIDATION_FAILED' END AS reason
  FROM customer LEFT JOIN u ON u.question_id = c_custkey)
"""


def answered(spark, sf_dir) -> DataFrame:
    return answers.answer(cases(spark, sf_dir), hits(spark, sf_dir), scripted(), wait=lambda seconds: None, records=records(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_ANSWERS} SELECT question_id, reason IS NOT NULL AS abstained, reason AS abstention_reason, CASE WHEN reason IS NULL THEN array_to_string(two, ';') ELSE '' END AS used_chunk_ids,
  CASE kind WHEN 1 THEN 'NOT_CALLED' WHEN 3 THEN 'TIMEOUT_OR_NETWORK_ERROR' WHEN 6 THEN 'HTTP_503' ELSE 'PASS' END AS api_status, CASE WHEN kind IN (5, 6) THEN 2 ELSE 0 END AS retries, CASE WHEN reason IS NULL THEN 'section 7' ELSE '' END AS warnings FROM a
""")
def scripted_answers(spark, sf_dir):
    """Cases from question to answer: not asked, failed, tried again, malformed, wrongly cited, abstained and answered."""
    return answered(spark, sf_dir).select("question_id", "abstained", "abstention_reason", F.array_join("used_chunk_ids", ";").alias("used_chunk_ids"), "api_status", "retries", F.array_join("warnings", ";").alias("warnings"))


@query(f"""
WITH RECURSIVE {_ANSWERS}, x AS (SELECT question_id, generate_subscripts(two, 1) - 1 AS place, unnest(two) AS chunk_id FROM a WHERE reason IS NULL) SELECT question_id, CAST(place AS INTEGER) AS place, x.chunk_id, c.source_id, c.title FROM x JOIN c ON c.chunk_id = x.chunk_id
""")
def answer_citations(spark, sf_dir):
    """The citation records of answers, in order."""
    return answers.cited(answered(spark, sf_dir), records(spark, sf_dir)).select("question_id", "place", "chunk_id", "source_id", "title")


@query(f"""
WITH RECURSIVE {_ANSWERS}, x AS (SELECT question_id, unnest(two) AS chunk_id FROM a WHERE reason IS NULL), y AS (SELECT question_id, list_sort(list(DISTINCT source_id)) AS cited, bool_or(k % 4 = 0) AS state FROM x JOIN c ON c.chunk_id = x.chunk_id GROUP BY question_id)
SELECT a.question_id, kind <> 1 AS should_answer, reason IS NOT NULL AS abstained, coalesce(reason <> 'CITATION_VALIDATION_FAILED', true) AS citation_ok, CASE WHEN reason IS NULL THEN 1 ELSE 0 END AS warnings, coalesce(state AND a.question_id % 2 = 0, false) AS violation,
  coalesce(list_contains(cited, 's' || ((a.question_id + 1) % 6)), false) AS leak, CASE kind WHEN 3 THEN 'TIMEOUT_OR_NETWORK_ERROR' WHEN 6 THEN 'HTTP_503' WHEN 2 THEN 'CITATION_VALIDATION_FAILED' WHEN 8 THEN 'CITATION_VALIDATION_FAILED' END AS failure, array_to_string(coalesce(cited, []), ';') AS cited_source_ids
FROM a LEFT JOIN y ON y.question_id = a.question_id
""")
def judged_answers(spark, sf_dir):
    """The batch evaluation of the answers."""
    rows = answers.judged(cases(spark, sf_dir), answered(spark, sf_dir), records(spark, sf_dir))
    return rows.drop("api_status", "retries").withColumn("cited_source_ids", F.array_join("cited_source_ids", ";"))


_PROMPT = "Use only the numbered evidence. Where it does not answer the question, abstain.\nReply with JSON: answer, abstained, abstention_reason, used_evidence_ids.\n\nScope: "


@query(f"SELECT c_custkey, {sql_quote(_PROMPT)} || CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE 'India' END || chr(10) || 'Question: ' || c_name || chr(10) || 'Evidence: [' || c_custkey || ']' AS prompt FROM customer")
def prompts(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", answers.prompt(F.col("c_name"), F.when(k % 3 != 0, "India"), F.concat(F.lit("["), k.cast("string"), F.lit("]"))).alias("prompt"))


@query("""
WITH s AS (SELECT n_nationkey AS question_id, n_nationkey % 4 = 0 AS should_answer, 'h' || (n_nationkey % 3) AS question_hash, ['c1', 'c2'] AS chunk_ids FROM nation), r AS (SELECT n_nationkey AS question_id, 'h' || (n_nationkey % 2) AS question_hash, CASE WHEN n_nationkey % 5 = 4 THEN ['c2', 'c1'] ELSE ['c1', 'c2'] END AS chunk_ids, 'SUPPORTED' AS a FROM nation)
SELECT s.question_id, CASE WHEN NOT should_answer AND a IS NOT NULL THEN a ELSE 'NOT_AUTOMATICALLY_VERIFIED' END AS support_assessment FROM s LEFT JOIN r ON r.question_id = s.question_id AND r.question_hash = s.question_hash AND r.chunk_ids = s.chunk_ids
""")
def reviewed_support(spark, sf_dir):
    """Manual reviews count for the same question and the same chunks in order only."""
    k = F.col("n_nationkey")
    chunks = F.array(F.lit("c1"), F.lit("c2"))
    rows = table(spark, sf_dir, "nation")
    summary = rows.select(k.alias("question_id"), (k % 4 == 0).alias("should_answer"), F.concat(F.lit("h"), (k % 3).cast("string")).alias("question_hash"), chunks.alias("chunk_ids"))
    reviews = rows.select(k.alias("question_id"), F.concat(F.lit("h"), (k % 2).cast("string")).alias("question_hash"), F.when(k % 5 == 4, F.reverse(chunks)).otherwise(chunks).alias("chunk_ids"), F.lit("SUPPORTED").alias("support_assessment"))
    return retrieval.reviewed(summary, reviews).select("question_id", "support_assessment")


def _axes(dimensions: int):
    """An embedder of texts that begin with a number: the axis of that number."""
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [1.0 if i == int(t.split("#")[1].split()[0]) % dimensions else 0.1 for i in range(dimensions)])

    return embed


@query(f"""
WITH i AS (SELECT 'c' || c_custkey AS chunk_id, c_custkey % 8 AS axis, CASE c_custkey % 3 WHEN 0 THEN 'Karnataka' WHEN 1 THEN 'India' ELSE 'Maharashtra' END AS scope FROM customer WHERE c_custkey < 24),
q AS (SELECT n_nationkey AS question_id, n_nationkey % 8 AS axis, CASE n_nationkey % 2 WHEN 0 THEN 'Karnataka' ELSE 'India' END AS jurisdiction FROM nation),
h AS (SELECT q.question_id, i.chunk_id, i.axis = q.axis AS same FROM q JOIN i ON i.scope = 'India' OR i.scope = q.jurisdiction) SELECT question_id, chunk_id, CAST(1 AS DOUBLE) AS score FROM h WHERE same
""")
def retrieved_chunks(spark, sf_dir):
    """Retrieval from question to reranked chunks over an index that one axis a record tells apart; those of the question's own axis come first."""
    k = F.col("c_custkey")
    scope = F.when(k % 3 == 0, "Karnataka").when(k % 3 == 1, "India").otherwise("Maharashtra")
    rows = table(spark, sf_dir, "customer").where("c_custkey < 24").select(F.concat(F.lit("c"), k.cast("string")).alias("chunk_id"), F.concat(F.lit("s"), k.cast("string")).alias("source_id"), scope.alias("jurisdiction"), F.lit("ACTIVE").alias("retrieval_status"), F.concat(F.lit("#"), k.cast("string"), F.lit(" words")).alias("text"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("topics"))
    index = retrieval.build_index(rows, rows.select("source_id", "jurisdiction"), _axes(8))
    n = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select(n.alias("question_id"), F.concat(F.lit("#"), n.cast("string"), F.lit(" what?")).alias("question"), F.when(n % 2 == 0, "Karnataka").otherwise("India").alias("jurisdiction"))
    return retrieval.retrieved(asked, index, _axes(8)).where("score > 0.9").select("question_id", "chunk_id", F.round("score", 4).alias("score"))


@query("""
SELECT conv_id, turn, role, recency, left(trim(regexp_replace(coalesce(text, ''), 'https?://\\S+', '', 'g')), 4000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations WHERE role IN ('user', 'assistant'))
WHERE recency <= 4 AND NOT (role = 'assistant' AND turn % 3 = 1)
""")
def told_history(spark, sf_dir):
    """The last four turns less those in which the assistant abstained."""
    return dialog.shaped_history(table(spark, sf_dir, "conversations").withColumn("abstained", F.when(F.col("turn") % 3 == 1, True)))


#: Follow-ups on histories: the last question, the user turns before it, and whether it is to be clarified.
def _turns(spark: SparkSession, sf_dir: str, n: Column, text: Column, language: Column | None = None) -> DataFrame:
    """``n`` user turns of each customer, each after a turn of the assistant but the first; ``text`` may use ``j``, a turn's place."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("j"))
    return rows.select("question_id", F.col("j").alias("turn"), F.lit("user").alias("role"), text.alias("text"), (F.lit(None).cast("string") if language is None else language).alias("language"))


@query("""
WITH k AS (SELECT c_custkey, c_custkey % 4 AS q, c_custkey // 4 % 6 AS n, c_custkey // 24 % 4 AS p FROM customer),
c AS (SELECT c_custkey, q, n, CASE WHEN n = 0 THEN false WHEN q <> 0 THEN q > 1 WHEN p = 0 THEN false WHEN p = 1 THEN true WHEN p = 2 THEN n > 1 ELSE c_custkey // 96 % 2 = 0 END AS clarify FROM k)
SELECT c_custkey AS question_id, clarify, q = 0 AND n > 0 AND NOT clarify AS follows FROM c
""")
def clarified_talks(spark, sf_dir):
    """Follow-ups of customers on up to five turns that name one task, none, two, or one in another language, which is translated where it is known."""
    k = F.col("question_id")
    question = F.element_at(F.array(*map(F.lit, ("What documents do I need?", "Tell me about PACS", "what about another problem?", "What is that deadline?"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"), question.alias("question"), F.lit("India").alias("jurisdiction"))
    pattern = F.floor(k / 24) % 4
    text = F.when(pattern == 0, "crop loss by hail").when(pattern == 1, "hello there").when(pattern == 3, "ಬೆಳೆ ನಷ್ಟ").when(F.col("j") % 2 == 0, "My crop was damaged").otherwise("a complaint about deposits")
    turns = _turns(spark, sf_dir, (F.floor(F.col("c_custkey") / 4) % 6).cast("int"), text, F.when(F.floor(k / 96) % 2 == 1, "kn"))
    got = dialog.contextualized(asked, turns, lambda texts, languages: texts.where(languages != "kn", "crop loss by hail"))
    return got.select("question_id", "clarify", F.startswith("query", F.lit("Active subject: ")).alias("follows"))


@query("""
WITH k AS (SELECT c_custkey, c_custkey % 6 AS q, c_custkey // 6 % 7 AS label, c_custkey // 42 % 6 AS n, c_custkey // 252 % 3 AS p, c_custkey // 6 % 4 AS busy FROM customer),
c AS (SELECT *, n > 4 AS long, q IN (1, 2) OR label IN (2, 5) AS bad, q IN (3, 4) AND n > 0 AND CASE p WHEN 0 THEN false WHEN 1 THEN true ELSE n > 1 END AS clarify FROM k),
r AS (SELECT *, long OR bad AS refused, NOT (long OR bad) AND clarify AS unclear, NOT (long OR bad) AND q = 5 AS failed FROM c)
SELECT c_custkey AS question_id, CASE WHEN long THEN 422 WHEN bad THEN 400 WHEN failed THEN ([429, 413, 502, 200])[CAST(busy + 1 AS INTEGER)] ELSE 200 END AS status, unclear OR failed AS abstained,
  CASE WHEN unclear THEN 'NEEDS_CLARIFICATION' WHEN failed THEN (['GROQ_HTTP_429', 'GROQ_HTTP_413', 'RETRIEVAL_ERROR', 'NO_EVIDENCE'])[CAST(busy + 1 AS INTEGER)] END AS abstention_reason, CASE WHEN refused OR unclear OR failed THEN 0 ELSE 1 END AS shown FROM r
""")
def chat_requests(spark, sf_dir):
    """Requests of customers by status: refused, clarified, failed at the provider, abstained and answered with titled sources."""
    k = F.col("c_custkey")
    q = k % 6
    failing = F.concat(F.lit("busy "), (F.floor(k / 6) % 4).cast("string"))
    question = F.when(q == 0, "How do I report crop loss?").when(q == 1, " ").when(q == 2, F.repeat(F.lit("q"), 1501)).when(q == 5, failing).otherwise("What documents do I need?")
    labels = F.element_at(F.array(*map(F.lit, ("Karnataka", "Not sure", "Goa", "", "maharashtra ", "India", "Multi-State Cooperative"))), (F.floor(k / 6) % 7 + 1).cast("int"))
    requests = table(spark, sf_dir, "customer").select(k.alias("question_id"), question.alias("question"), labels.alias("label"))
    pattern = F.floor(F.col("question_id") / 252) % 3
    text = F.when(pattern == 0, "crop damage by hail").when(pattern == 1, "hello").when(F.col("j") % 2 == 0, "crop damage").otherwise("a complaint about deposits")
    turns = _turns(spark, sf_dir, (F.floor(k / 42) % 6).cast("int"), text)

    def answer(ready: DataFrame) -> DataFrame:
        said = F.col("question")
        reason = F.when(said == "busy 0", "GROQ_HTTP_429").when(said == "busy 1", "GROQ_HTTP_413").when(said == "busy 2", "RETRIEVAL_ERROR").when(said == "busy 3", "NO_EVIDENCE")
        source = lambda title: F.struct(F.lit("s").alias("source_id"), F.lit(title).cast("string").alias("title"))
        sources = F.when(reason.isNull(), F.array(source("A title"), source(None), source("")))
        return ready.select("question_id", F.when(reason.isNull(), "Yes.").otherwise("").alias("answer"), reason.isNotNull().alias("abstained"), reason.alias("abstention_reason"), sources.alias("sources"))

    return dialog.chat(requests, turns, answer).select("question_id", "status", "abstained", "abstention_reason", F.size("sources").alias("shown"))


@query("""
WITH t AS (SELECT *, list({'turn': turn, 'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent FROM conversations)
SELECT conv_id, turn, text AS question, CAST(coalesce(len(recent), 0) AS INTEGER) AS held, sha256(coalesce(array_to_string(list_transform(recent, lambda x: x.turn || ' ' || x.role || ' ' || x.text), chr(10)), '')) AS history_hash FROM t WHERE role = 'user'
""")
def streamed_history(spark, sf_dir):
    """Conversations as a stream of three files: user turns with the last four turns before them, which are kept as state."""
    turns, folder = table(spark, sf_dir, "conversations"), fresh(spark, "turns")
    for part in range(3):  # the files come one after another
        turns.where(F.floor(F.col("turn") / 3) == part if part < 2 else F.col("turn") >= 6).coalesce(1).write.mode("append").parquet(folder)
    stream = conversations.recent_turns(spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    target = fresh(spark, "history")
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", fresh(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    said = F.array_join(F.transform("recent", lambda x: F.concat_ws(" ", x["turn"].cast("string"), x["role"], x["text"])), "\n")
    return spark.read.parquet(target).select("conv_id", "turn", "question", F.size("recent").alias("held"), content_hash(said).alias("history_hash"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS answer, c_custkey % 2 = 1 AS abstained, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS sources FROM customer")
def normal_responses(spark, sf_dir):
    """Responses with texts and flags for nulls, and only sources that have a title."""
    k = F.col("c_custkey")
    source = F.struct(F.when(k % 5 > 1, F.col("c_name")).alias("title"))
    sources = F.when(k % 5 != 0, F.array(F.lit(None).cast("struct<title:string>"), source))
    raw = F.struct(F.when(k % 3 != 0, F.col("c_name")).alias("answer"), F.when(k % 2 == 1, True).alias("abstained"), F.lit(None).cast("string").alias("abstention_reason"), F.lit("India").alias("jurisdiction"), sources.alias("sources"))
    out = F.col("r")
    return table(spark, sf_dir, "customer").select("c_custkey", serving.response(raw).alias("r")).select("c_custkey", out["answer"].alias("answer"), out["abstained"].alias("abstained"), F.size(out["sources"]).alias("sources"))


REASONS = ("GROQ_HTTP_429", "GROQ_HTTP_413", "GROQ_API_ERROR", "RETRIEVAL_ERROR", "CITATION_VALIDATION_FAILED", "NO_EVIDENCE", "", None)


@query(f"""
SELECT c_custkey, reason, CASE WHEN reason = 'GROQ_HTTP_429' THEN 429 WHEN reason = 'GROQ_HTTP_413' THEN 413 WHEN starts_with(reason, 'GROQ_') OR reason IN ('RETRIEVAL_ERROR', 'CITATION_VALIDATION_FAILED') THEN 502 END AS status
FROM (SELECT c_custkey, text || CASE WHEN c_custkey % 20 = 10 THEN '_X' ELSE '' END AS reason FROM {sql_sampled('customer', 'c_custkey', REASONS)})
""")
def provider_statuses(spark, sf_dir):
    """Statuses of customers' failed requests by their reasons."""
    reason = F.concat("text", F.when(F.col("c_custkey") % 20 == 10, "_X").otherwise(""))
    return sampled(table(spark, sf_dir, "customer"), "c_custkey", REASONS).select("c_custkey", reason.alias("reason"), tags.provider_status(reason).alias("status"))

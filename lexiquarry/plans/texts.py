"""Queries that tag texts by rules, and cut them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions import serving
from lexiquarry.functions import tags
from lexiquarry.functions import text as X
from lexiquarry.operators import answers, chunking, dialog, retrieval
from lexiquarry.plans.common import registry, sql_matches, sql_norm, sql_quote, sql_words, table

QUERIES, ORACLE_SQL, query = registry()

#: Patterns of what the synthetic documents do hold, beside the topics of the lexicon.
FORMS = {
    "license": r"\blicen[cs]ed?\b",
    "rights": r"\ball rights reserved\b",
    "insult": r"\b(?:idiot|moron|stupid|worthless)\b",
    "mail": r"[a-z0-9._-]+@[a-z0-9-]+\.[a-z]",
    "table": r" \| ",
    "question": r"\?",
}
HINTS = {**L.TOPIC_HINTS, "license": ["licen"], "rights": ["rights reserved"], "insult": ["idiot", "moron", "stupid", "worthless"], "mail": ["@"], "table": [" | "], "question": ["?"]}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_T = "coalesce(text, '')"


def topics_sql(patterns) -> str:
    """SQL for the sorted topics of a text."""
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {sql_matches(_T, p, 'is')} THEN {sql_quote(k)} END" for k, p in patterns.items()) + "], lambda x: x IS NOT NULL))"


_TAGS = topics_sql({**L.TOPICS, **FORMS})
_QTOPICS = "list_sort(list_filter([" + ", ".join(
    "CASE WHEN " + sql_matches(f"replace(lower({_T}), 'ß', 'ss')", "(^|[^a-z])(" + "|".join(t.replace("-", r"\-") for t in terms) + ")([^a-z]|$)") + f" THEN {sql_quote(k)} END" for k, terms in L.QUERY_TERMS.items()
) + "], lambda x: x IS NOT NULL))"


def _tagged(spark, sf_dir) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("lowered", F.lower(X.filled("text")))
    return rows.withColumn("topics", tags.topic_tags(F.col("text"), {**L.TOPICS, **FORMS}, hints=HINTS, lowered=F.col("lowered")))


@query(f"SELECT doc_id, array_to_string({_TAGS}, ';') AS topics FROM documents")
def topic_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", F.array_join("topics", ";").alias("topics"))


@query(f"SELECT lang, topic, count(*) AS documents FROM (SELECT lang, unnest({_TAGS}) AS topic FROM documents) GROUP BY lang, topic")
def topic_counts(spark, sf_dir):
    # An outer generator: a plain one would make the tags again for a filter on their number.
    rows = _tagged(spark, sf_dir).select("lang", F.explode_outer("topics").alias("topic")).where("topic is not null")
    return rows.groupBy("lang", "topic").agg(F.count("*").alias("documents"))


@query(f"SELECT conv_id, turn, role, array_to_string({_QTOPICS}, ';') AS topics, {sql_matches(_T, L.PROCEDURAL_QUERY, 'i')} AS procedural FROM conversations")
def query_topics(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", F.array_join(tags.query_topics(F.col("text")), ";").alias("topics"), tags.procedural(F.col("text")).alias("procedural"))


@query(f"""
WITH f AS (SELECT doc_id, list_transform(regexp_extract_all({_T}, {sql_quote('(?i)' + L.FORM)}, 1), lambda x: 'Form ' || upper(x)) AS found,
  {sql_matches(_T, L.FORM_CONTEXT, 'i')} AS specific FROM documents)
SELECT doc_id, len(list_distinct(found)) AS forms, CASE WHEN specific THEN found[1] END AS form_number, specific AND len(list_distinct(found)) > 1 AS several FROM f
""")
def form_mentions(spark, sf_dir):
    number, several = tags.form_number(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(tags.form_mentions(F.col("text"))).alias("forms"), number.alias("form_number"), several.alias("several"))


_ACTS = "list_filter([" + ", ".join(f"CASE WHEN {sql_matches('lead', p, 'i')} THEN {sql_quote(k)} END" for k, p in L.ACTIONS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""
WITH l AS (SELECT doc_id, left({_T}, 1500) AS lead FROM documents), a AS (SELECT doc_id, lead, {_ACTS} AS acts FROM l)
SELECT doc_id, CASE WHEN len(acts) = 1 THEN acts[1] WHEN len(acts) = 0 AND {sql_matches('lead', r'\bamend(?:ment|ed)\b', 'i')} THEN 'amendment' END AS action, len(acts) > 1 AS several,
  CASE WHEN {sql_matches('lead', L.AFFECTED, 'i')} THEN lower(regexp_extract(lead, {sql_quote('(?i)' + L.AFFECTED)}, 1)) || ' ' || regexp_extract(lead, {sql_quote('(?i)' + L.AFFECTED)}, 2) END AS affected FROM a
""")
def amendment_action(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tags.amendment_action(t).alias("action"), (F.size(tags.amendment_actions(t)) > 1).alias("several"), tags.affected_provision(t).alias("affected"))


_PRE = "CASE " + " ".join(f"WHEN {sql_matches('t', p)} THEN {sql_quote(r)}" for r, p in L.PRECHECK)
_PRE += f" WHEN {sql_matches('t', L.LEGAL_WORD)} AND NOT {sql_matches('t', L.NAMED_SCOPE)} THEN {sql_quote(L.UNKNOWN_REASON)} END"


@query(f"SELECT conv_id, turn, role, {_PRE} AS reason FROM (SELECT *, replace(lower({_T}), 'ß', 'ss') AS t FROM conversations)")
def precheck_reason(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tags.precheck_reason(F.col("text"), F.lit("Unknown")).alias("reason"))


@query(f"""
WITH j AS (SELECT item_id, {_T} AS text, CASE item_id % 5 WHEN 0 THEN 'Karnataka' WHEN 1 THEN ' maharashtra ' WHEN 2 THEN 'PMFBY' WHEN 3 THEN 'Unknown' END AS jurisdiction FROM benchmark)
SELECT item_id, array_to_string(CASE WHEN jurisdiction = 'Karnataka' THEN ['Central', 'India', 'Karnataka'] WHEN jurisdiction = ' maharashtra ' THEN ['Central', 'India', 'Maharashtra'] WHEN jurisdiction = 'PMFBY' THEN ['Central', 'India']
  ELSE list_concat(['Central', 'India'], list_filter([CASE WHEN {sql_matches('text', 'karnataka', 'i')} THEN 'Karnataka' END, CASE WHEN {sql_matches('text', 'maharashtra', 'i')} THEN 'Maharashtra' END], lambda x: x IS NOT NULL)) END, ';') AS allowed FROM j
""")
def allowed_scopes(spark, sf_dir):
    k = F.col("item_id") % 5
    given = F.when(k == 0, "Karnataka").when(k == 1, " maharashtra ").when(k == 2, "PMFBY").when(k == 3, "Unknown")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tags.allowed_jurisdictions(given, F.col("text")), ";").alias("allowed"))


_INTENT = "CASE " + " ".join(f"WHEN {sql_matches('trim(' + _T + ')', '^(?:' + p + ')$', 'i')} THEN {sql_quote(k)}" for k, p in L.INTENTS.items()) + " END"


@query(f"SELECT conv_id, turn, role, {_INTENT} AS intent FROM conversations")
def followup_intent(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tags.follow_up_intent(F.col("text")).alias("intent"))


_FLAG = {k: sql_matches(sql_norm("text"), p, "i") for k, p in L.FLAGS.items()}


@query(f"""
SELECT conv_id, turn, role, CASE WHEN {_FLAG['crop']} AND {_FLAG['crop_loss']} THEN 'crop_loss_claim' WHEN {_FLAG['complaint']} THEN 'complaint_filing' WHEN {_FLAG['membership']} THEN 'membership_eligibility'
  WHEN {_FLAG['pacs']} THEN 'pacs_service' WHEN {_FLAG['multistate']} THEN 'multistate_issue' END AS key FROM conversations
""")
def active_context(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tags.active_context(F.col("text"))["key"].alias("key"))


@query("""
SELECT conv_id, turn, recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations) WHERE recency <= 4
""")
def history_last4(spark, sf_dir):
    return dialog.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "recency")


@query(f"""
SELECT conv_id, turn, role, recency, left(trim(regexp_replace({_T}, 'https?://\\S+', '', 'g')), 4000) AS content
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations WHERE role IN ('user', 'assistant')) WHERE recency <= 4
""")
def shaped_history(spark, sf_dir):
    return dialog.shaped_history(table(spark, sf_dir, "conversations"))


@query(f"""
WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user'), a AS (SELECT conv_id AS question_id, turn, text FROM u WHERE n = 1),
h AS (SELECT DISTINCT a.question_id FROM a JOIN conversations c ON c.conv_id = a.question_id AND c.turn < a.turn), i AS (SELECT *, {_INTENT} AS intent FROM a)
SELECT i.question_id, text AS query, CASE WHEN h.question_id IS NULL THEN false WHEN {sql_matches('trim(' + _T + ')', '^(?:' + L.ANOTHER + ')$', 'i')} THEN true WHEN intent IS NULL THEN {sql_matches(_T, L.DEPENDENT, 'i')} END AS clarify
FROM i LEFT JOIN h ON h.question_id = i.question_id
""")
def contextualized(spark, sf_dir):
    """The last user turn of each conversation as a question on the turns before it."""
    turns = table(spark, sf_dir, "conversations")
    last = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    asked = turns.where("role = 'user'").withColumn("n", last).where("n = 1").select(F.col("conv_id").alias("question_id"), F.col("text").alias("question"), F.lit("Unknown").alias("jurisdiction"), F.col("turn").alias("at"))
    history = turns.withColumnRenamed("conv_id", "question_id").join(asked.select("question_id", "at"), "question_id").where("turn < at").select("question_id", "turn", "role", "text")
    return dialog.contextualized(asked.drop("at"), history)


@query(f"""
SELECT conv_id, turn, CASE WHEN length({sql_norm('text')}) > 64 THEN left({sql_norm('text')}, 61) || '…' ELSE {sql_norm('text')} END AS title FROM conversations
""")
def conversation_titles(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.title("text").alias("title"))


@query(f"""
SELECT conv_id, turn, CASE WHEN length(trim({_T})) = 0 OR length(trim({_T})) > 1500 THEN 400 END AS status, CAST(floor((length({_T}) + 3) / 4) AS BIGINT) AS tokens,
  CASE WHEN turn % 4 = 0 THEN 429 WHEN turn % 4 = 1 THEN 413 WHEN turn % 4 = 2 THEN 502 END AS provider FROM conversations
""")
def request_limits(spark, sf_dir):
    k = F.col("turn") % 4
    reason = F.when(k == 0, "GROQ_HTTP_429").when(k == 1, "GROQ_HTTP_413").when(k == 2, "RETRIEVAL_ERROR").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tags.request_error(F.col("text")).alias("status"), X.request_tokens("text").alias("tokens"), tags.provider_status(reason).alias("provider"))


@query(f"""
WITH h AS (SELECT doc_id, {_T} AS t, left({_T}, 300) AS head FROM documents)
SELECT doc_id, sha256(CASE WHEN length(t) <= 300 THEN t WHEN regexp_matches(head, '(?s)^.+[.!?][ \\n]') THEN regexp_extract(head, '(?s)^(.+[.!?])[ \\n]', 1)
  WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END) AS prefix_hash FROM h
""")
def safe_prefix(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.content_hash(X.safe_prefix("text", 300)).alias("prefix_hash"))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex({_T}, '\\s+'), lambda w: w <> '') AS body FROM documents),
n AS (SELECT *, greatest(CAST(ceil(len(body) / 440.0) AS INTEGER), 1) AS n FROM w),
p AS (SELECT doc_id, unnest(generate_series(0, n - 1)) AS window_no, body FROM n)
SELECT doc_id, CAST(window_no AS INTEGER) AS window_no, CAST(len(body[window_no * 440 + 1 : window_no * 440 + 440]) AS INTEGER) AS weight, sha256(array_to_string(body[window_no * 440 + 1 : window_no * 440 + 440], ' ')) AS window_hash FROM p
""")
def token_windows(spark, sf_dir):
    rows = retrieval.token_windows(docs(spark, sf_dir).withColumn("header", F.lit("")), "doc_id", "text", "header")
    return rows.select("doc_id", "window_no", "weight", X.content_hash("window").alias("window_hash"))


@query(f"""
WITH d AS (SELECT doc_id, {sql_words('text')} AS n, text, lang FROM documents)
SELECT doc_id, CAST(ceil(n / 440.0) AS BIGINT) AS windows, n AS tokens, CAST((n - 1) % 440 + 1 AS INTEGER) AS last_weight, sha256(text) AS text_hash, n >= 6 AND lang IS NOT NULL AS headed FROM d WHERE n > 0
""")
def tokenizer_windows(spark, sf_dir):
    """Windows of documents by an injected tokenizer: their tokens, the text that they make together, and whether a line on the language stands before them."""
    places = lambda t: [m.span() for m in re.finditer(r"\S+", t)]
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("Lang: "), "lang").alias("fields"))
    cut = retrieval.tokenized_windows(rows, "doc_id", "text", "fields", places)
    parts = F.split("window", "Text: ", 2)
    parts = cut.select("doc_id", "window_no", "weight", F.startswith("window", F.lit("passage: Lang: ")).alias("headed"), parts[1].alias("part"))
    whole = parts.groupBy("doc_id").agg(
        F.count("*").alias("windows"), F.sum("weight").cast("int").alias("tokens"), F.max_by("weight", "window_no").alias("last_weight"),
        F.array_sort(F.collect_list(F.struct("window_no", "part"))).alias("parts"), F.bool_and("headed").alias("headed"),  # a document's own text
    )
    return whole.select("doc_id", "windows", "tokens", "last_weight", X.content_hash(F.array_join(F.col("parts.part"), "")).alias("text_hash"), "headed")


@query()
def prose_chunks(spark, sf_dir):
    """Long documents in parts of about 300 to 500 words that end where sentences do."""
    line = lambda t, k: F.struct(t.alias("text"), F.lit(1).alias("page"), k.alias("block"), F.contains(t, F.lit(" | ")).alias("table"))
    units = docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.lit(0).cast("long").alias("unit_no"), F.lit("background").alias("kind"), F.transform(F.split(X.filled("text"), "\n"), line).alias("lines"))
    return chunking.packed_units(units).select(F.col("source_id").alias("doc_id"), "piece", X.words("text").alias("words"), X.content_hash("text").alias("text_hash"))


@query(f"""
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower({sql_norm('text')}), 'ß', 'ss'), '\\b(?:section|rule|form|version|license)\\s+[a-z0-9]+(?:-[a-z0-9]+)?\\b')) AS claim FROM documents)
SELECT doc_id, claim, count(*) AS times FROM a GROUP BY doc_id, claim
""")
def numbered_claims(spark, sf_dir):
    """Mentions of numbered things (versions and licences too, as the texts have no sections)."""
    found = F.regexp_extract_all(X.fold(X.norm("text")), F.lit(r"\b(?:section|rule|form|version|license)\s+[a-z0-9]+(?:-[a-z0-9]+)?\b"), 0)
    return docs(spark, sf_dir).select("doc_id", F.explode_outer(found).alias("claim")).where("claim is not null").groupBy("doc_id", "claim").agg(F.count("*").alias("times"))


@query()
def unsupported_claims(spark, sf_dir):
    """Claims of documents that the text of their benchmark item does not name; NFKC needs Python."""
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("evidence"))
    return answers.unsupported_claims(docs(spark, sf_dir).join(bench, "doc_id"), "doc_id", "text", "evidence")


@query(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_T}, '\\n\\s*\\n'), lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13))), lambda b: b <> '') AS blocks FROM documents),
b AS (SELECT doc_id, i - 1 AS block_no, blocks[i] AS block FROM (SELECT doc_id, blocks, unnest(generate_series(1, len(blocks))) AS i FROM p)),
l AS (SELECT *, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') AS ls FROM b)
SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, CASE WHEN len(list_filter(ls, lambda x: NOT regexp_matches(x, '^\\s*[0-9]+[.)]\\s+'))) = 0 THEN 'ordered'
  WHEN len(list_filter(ls, lambda x: NOT regexp_matches(x, '^\\s*[-*•]\\s+'))) = 0 THEN 'bullets' ELSE 'paragraph' END AS kind, CAST(len(ls) AS INTEGER) AS lines, CAST(len(regexp_extract_all(block, '\\*\\*([^*]+)\\*\\*')) AS INTEGER) AS bold_spans FROM l
""")
def answer_blocks(spark, sf_dir):
    return answers.answer_blocks(docs(spark, sf_dir), "doc_id", "text").drop("block")


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def source_dedupe(spark, sf_dir):
    """Of documents with one source and language the first."""
    return answers.presented_sources(docs(spark, sf_dir).select("doc_id", "source", "lang"), "source", ["lang"], "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def props_extract(spark, sf_dir):
    props = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(props, "$.page").alias("page"), F.get_json_object(props, "$.k").alias("k"), F.get_json_object(props, "$").isNotNull().alias("valid"))


@query(f"SELECT doc_id, {sql_words('text')} AS words, CASE WHEN {sql_words('text')} < 20 THEN 'lt20' WHEN {sql_words('text')} < 50 THEN '20_49' WHEN {sql_words('text')} < 150 THEN '50_149' WHEN {sql_words('text')} <= 450 THEN '150_450' WHEN {sql_words('text')} <= 900 THEN '451_900' ELSE 'gt900' END AS band FROM documents")
def word_bands(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.words("text").alias("words")).withColumn("band", tags.word_band(F.col("words")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'p. ' || CAST(doc_id AS VARCHAR) ELSE 'pp. ' || CAST(doc_id AS VARCHAR) || '–' || CAST(doc_id + 1 AS VARCHAR) END AS label FROM documents")
def page_labels(spark, sf_dir):
    k = F.col("doc_id") % 3
    return docs(spark, sf_dir).select("doc_id", X.page_label(F.when(k != 0, F.col("doc_id")), F.when(k == 1, F.col("doc_id")).otherwise(F.col("doc_id") + 1)).alias("label"))


@query("""
WITH k AS (SELECT CASE n_nationkey % 2 WHEN 0 THEN 'hi' ELSE 'en' END AS lang, n_name AS key, n_nationkey AS n FROM nation),
a AS (SELECT 'hi' AS lang, n_name AS key, 'new ' || n_name AS label FROM nation WHERE n_nationkey % 6 = 0),
b AS (SELECT 'hi' AS lang, n_name AS key, 'old ' || n_name AS label FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'en', n_name, 'base ' || n_name FROM nation WHERE n_nationkey % 3 = 0)
SELECT k.lang, k.key, coalesce(a1.label, b1.label, a2.label, b2.label, k.key) AS label FROM k
LEFT JOIN a a1 ON a1.lang = k.lang AND a1.key = k.key LEFT JOIN b b1 ON b1.lang = k.lang AND b1.key = k.key
LEFT JOIN a a2 ON a2.lang = 'en' AND a2.key = k.key LEFT JOIN b b2 ON b2.lang = 'en' AND b2.key = k.key
""")
def translated_labels(spark, sf_dir):
    """Labels in a language, from two tables, then in the base language, then the key itself."""
    rows = table(spark, sf_dir, "nation")
    n = F.col("n_nationkey")
    keys = rows.select(F.when(n % 2 == 0, "hi").otherwise("en").alias("lang"), F.col("n_name").alias("key"))

    def labels(kept, lang: str, prefix: str) -> DataFrame:
        return rows.where(kept).select(F.lit(lang).alias("lang"), F.col("n_name").alias("key"), F.concat(F.lit(prefix + " "), "n_name").alias("label"))

    return serving.translated(keys, [labels(n % 6 == 0, "hi", "new"), labels(n % 4 == 0, "hi", "old").unionByName(labels(n % 3 == 0, "en", "base"))])


@query("""
SELECT conv_id, turn, CASE WHEN lower(trim(coalesce(text, ''))) = '' THEN 'Unknown' END AS scope, role <> 'system' AND trim(coalesce(text, '')) <> '' AND turn % 3 <> 0 AS playable,
  CASE WHEN regexp_matches(coalesce(text, ''), 'the', 'i') THEN 'A' WHEN regexp_matches(coalesce(text, ''), 'de ', 'i') THEN 'B' ELSE 'none' END AS answer FROM conversations
""")
def serving_rules(spark, sf_dir):
    text = F.col("text")
    language = F.when(F.col("role") != "system", "en").otherwise("xx")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", serving.scope_of_label(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise("?")).alias("scope"),
        serving.playable(text, language, F.col("turn") % 3 == 0).alias("playable"), serving.first_match(text, [("the", "A"), ("de ", "B")], "none").alias("answer"),
    )

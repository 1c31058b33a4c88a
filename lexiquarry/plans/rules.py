"""Queries of the rule tables on texts that they are for: each row of a table gets one of some sample texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions import jsons, serving, tags
from lexiquarry.functions import lexicon as L
from lexiquarry.functions import text as X
from lexiquarry.operators import answers, quality
from lexiquarry.plans.common import registry, sampled, sql_literal, sql_matches, sql_quote, sql_rows, sql_sampled, sql_words, table
from lexiquarry.plans.texts import topics_sql

QUERIES, ORACLE_SQL, query = registry()

PROVISIONS = (
    "Admission of members: who may become a member of the society.", "The registration of societies and their management by a manager.", "Governance by a board of directors after the election.",
    "Meetings are held; loans to borrowers and deposits are told.", "Financial literacy camps of the PACS for better services.", "PACS offer seeds. " + "Much else is said here. " * 5 + "Other services follow.",
    "Computerisation of records; crop insurance under PMFBY.", "Premium and eligibility of farmers; the crop damage and loss of crops.", "They file the insurance claims within 72 hours of loss and submit claims.",
    "Claim settlement after reporting and intimation with documents.", "Within ten days the grievance or complaint goes to the Ombudsman.", "An appeal lies in Form VI or form-VII to the Registrar.",
    "A multi-state society; the Karnataka societies Act and bye-laws.", "Nothing of interest stands here, not even a remembering.", "MEMBERSHIP\nand deadline; Pradhan Mantri Fasal Bima.", "",
    "The primary agricultural credit societies are computerized.", "Complainants were appellate; documentary proofs, electoral rolls.", "time-limit, timeline, days from then",
)


def customers(spark: SparkSession, sf_dir: str, samples) -> DataFrame:
    return sampled(table(spark, sf_dir, "customer"), "c_custkey", samples)


def _customers(samples) -> str:
    return sql_sampled("customer", "c_custkey", samples)


@query(f"SELECT c_custkey, array_to_string({topics_sql(L.TOPICS)}, ';') AS topics FROM {_customers(PROVISIONS)}")
def provision_topics(spark, sf_dir):
    """All topics of the rule table."""
    return customers(spark, sf_dir, PROVISIONS).select("c_custkey", F.array_join(tags.topic_tags(F.col("text")), ";").alias("topics"))


SOURCES = ("PMFBY_2023", "MSCS_ACT", "KA_ACT_1959", "CRCS_OMBUDSMAN", "PACS_MODEL_BYLAWS", "OTHER")
WHO = ("It is optional for all farmers.", "Farmers who grow crops", "The seeds", "farmers including tenants pay premium", "eligible ones")


@query(f"""
WITH t AS (SELECT c_custkey, text, ({sql_literal(list(SOURCES))})[CAST(c_custkey // 7 % {len(SOURCES)} AS INTEGER) + 1] AS source_id FROM {_customers(WHO)}), u AS (SELECT *, {topics_sql(L.TOPICS)} AS own FROM t)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(own, CASE source_id WHEN 'PMFBY_2023' THEN ['crop_insurance', 'pmfby'] WHEN 'MSCS_ACT' THEN ['multistate'] WHEN 'KA_ACT_1959' THEN ['state_law']
  WHEN 'CRCS_OMBUDSMAN' THEN ['grievance', 'ombudsman'] WHEN 'PACS_MODEL_BYLAWS' THEN ['byelaws', 'pacs'] ELSE [] END, CASE WHEN source_id = 'PMFBY_2023' AND {sql_matches('text', L.ELIGIBLE, 'i')} THEN ['eligibility'] ELSE [] END))), ';') AS topics FROM u
""")
def record_topics(spark, sf_dir):
    """Topics that a record has by its source, and who may take part."""
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.floor(F.col("c_custkey") / 7) % len(SOURCES) + 1).cast("int"))
    rows = customers(spark, sf_dir, WHO)
    return rows.select("c_custkey", F.array_join(tags.record_topics(source, F.lit(None).cast("string"), F.lit(""), F.col("text")), ";").alias("topics"))


QUESTIONS = (
    "What documents do I need?", "How long will it take?", "Where should I report this?", "what next?", "Can I appeal?", "Am I eligible?", "What if I missed the deadline?", "What about another problem?",
    "What documents do I need for a loan?", "My PMFBY crop was damaged by hail in Karnataka", "crop insurance after heavy rain", "A complaint about deposits of a multi-state society", "a grievance to the ombudsman",
    "How can I become a member in Maharashtra?", "Membership of a multi-state society", "Which PACS service is near?", "A multi-state matter", "Who is the current secretary?", "Can you guarantee that it is decided in my favour?",
    "What do our society's own registered bye-laws say?", "Which law applies to membership?", "Which section of the Karnataka act applies?", "How do I report crop damage within one month?", "Where can I complain about the board?",
    "the governing body, voting and agenda", "the premium of pradhan mantri fasal", "Form VI or form 7 to the registrar", "bye-law, state law, financial literacy", "", "computerize the register; borrowing, dispute", "more than one state",
    "present officer of the cooperative", "the cooperative has its own bylaws",
)

_T = "coalesce(text, '')"
_QTOPICS = "list_sort(list_filter([" + ", ".join(
    "CASE WHEN " + sql_matches(f"lower({_T})", "(^|[^a-z])(" + "|".join(t.replace("-", r"\-") for t in terms) + ")([^a-z]|$)") + f" THEN {sql_quote(k)} END" for k, terms in L.QUERY_TERMS.items()
) + "], lambda x: x IS NOT NULL))"


@query(f"SELECT c_custkey, array_to_string({_QTOPICS}, ';') AS topics, {sql_matches(_T, L.PROCEDURAL_QUERY, 'i')} AS procedural FROM {_customers(QUESTIONS)}")
def question_topics(spark, sf_dir):
    rows = customers(spark, sf_dir, QUESTIONS)
    return rows.select("c_custkey", F.array_join(tags.query_topics(F.col("text")), ";").alias("topics"), tags.procedural(F.col("text")).alias("procedural"))


_SCOPE = "CASE c_custkey % 2 WHEN 0 THEN 'Unknown' ELSE 'India' END"
_PRE = "CASE " + " ".join(f"WHEN {sql_matches('lower(text)', p)} THEN {sql_quote(r)}" for r, p in L.PRECHECK)
_PRE += f" WHEN {_SCOPE} = 'Unknown' AND {sql_matches('lower(text)', L.LEGAL_WORD)} AND NOT {sql_matches('lower(text)', L.NAMED_SCOPE)} THEN {sql_quote(L.UNKNOWN_REASON)} END"


@query(f"SELECT c_custkey, {_PRE} AS reason FROM {_customers(QUESTIONS)}")
def question_reasons(spark, sf_dir):
    """Why questions are not answered, by text and scope."""
    scope = F.when(F.col("c_custkey") % 2 == 0, "Unknown").otherwise("India")
    return customers(spark, sf_dir, QUESTIONS).select("c_custkey", tags.precheck_reason(F.col("text"), scope).alias("reason"))


_INTENT = "CASE " + " ".join(f"WHEN {sql_matches('trim(' + _T + ')', '^(?:' + p + ')$', 'i')} THEN {sql_quote(k)}" for k, p in L.INTENTS.items()) + " END"
_F = {k: sql_matches("text", p, "i") for k, p in L.FLAGS.items()}
_ISSUE = f"CASE WHEN {_F['deposit']} THEN 'deposit issue' ELSE 'cooperative issue' END"
_STATE = f"CASE WHEN {sql_matches('text', 'karnataka', 'i')} THEN ' in Karnataka' WHEN {sql_matches('text', 'maharashtra', 'i')} THEN ' in Maharashtra' ELSE '' END"
_MULTI = f"CASE WHEN {_F['multistate']} THEN ' {{}} a multi-state cooperative' ELSE {{}} END"
_KEY = f"CASE WHEN {_F['crop']} AND {_F['crop_loss']} THEN 'crop_loss_claim' WHEN {_F['complaint']} THEN 'complaint_filing' WHEN {_F['membership']} THEN 'membership_eligibility' WHEN {_F['pacs']} THEN 'pacs_service' WHEN {_F['multistate']} THEN 'multistate_issue' END"
_SUBJECT = (
    f"CASE key WHEN 'crop_loss_claim' THEN CASE WHEN {sql_matches('text', 'pmfby', 'i')} THEN 'PMFBY crop insurance' ELSE 'crop insurance' END || ' after crop damage or loss' WHEN 'complaint_filing' THEN {_ISSUE} || {_MULTI.format('in', sql_quote(''))}"
    f" WHEN 'membership_eligibility' THEN 'cooperative society membership' || {_MULTI.format('of', _STATE)} WHEN 'pacs_service' THEN 'PACS services' WHEN 'multistate_issue' THEN 'multi-state cooperative issue' END"
)
_PROCEDURE = (
    f"CASE key WHEN 'crop_loss_claim' THEN {sql_quote(L.TASKS['crop_loss'][1])} WHEN 'complaint_filing' THEN 'complaint or Ombudsman filing for the ' || {_ISSUE} WHEN 'membership_eligibility' THEN {sql_quote(L.TASKS['membership'][1])}"
    f" WHEN 'pacs_service' THEN {sql_quote(L.TASKS['pacs'][1])} WHEN 'multistate_issue' THEN {sql_quote(L.TASKS['multistate'][1])} END"
)


@query(f"""
WITH k AS (SELECT c_custkey, text, {_INTENT} AS intent, {_KEY} AS key FROM {_customers(QUESTIONS)}) SELECT c_custkey, intent, key, {_SUBJECT} AS subject, {_PROCEDURE} AS procedure FROM k
""")
def question_tasks(spark, sf_dir):
    """The form of a follow-up, and the task that a question names."""
    context = tags.active_context(F.col("text"))
    return customers(spark, sf_dir, QUESTIONS).select("c_custkey", tags.follow_up_intent(F.col("text")).alias("intent"), *[context[c].alias(c) for c in ("key", "subject", "procedure")])


_FOCUS = f"CASE WHEN intent = 'timeline' AND key = 'crop_loss_claim' THEN {sql_quote(L.CROP_TIMELINE)} " + " ".join(f"WHEN intent = {sql_quote(k)} THEN replace({sql_quote(v)}, '{{}}', procedure)" for k, v in L.FOCUS.items()) + " END"


@query(f"""
WITH k AS (SELECT c_custkey, text, ({sql_literal(list(L.FOCUS))})[CAST(c_custkey // 5 % {len(L.FOCUS)} AS INTEGER) + 1] AS intent, {_KEY} AS key FROM {_customers(QUESTIONS)}), p AS (SELECT *, {_SUBJECT} AS subject, {_PROCEDURE} AS procedure FROM k WHERE key IS NOT NULL)
SELECT c_custkey, 'Active subject: ' || subject || '.' || chr(10) || 'Active procedure/task: ' || procedure || '.' || chr(10) || 'Follow-up intent: ' || {_FOCUS} || '.' AS query FROM p
""")
def follow_up_queries(spark, sf_dir):
    """Every follow-up in every task as a search query."""
    intent = F.element_at(F.array(*[F.lit(k) for k in L.FOCUS]), (F.floor(F.col("c_custkey") / 5) % len(L.FOCUS) + 1).cast("int"))
    rows = customers(spark, sf_dir, QUESTIONS).select("c_custkey", intent.alias("intent"), tags.active_context(F.col("text")).alias("context")).where("context is not null")
    return rows.select("c_custkey", tags.follow_up_query(F.col("intent"), F.col("context")).alias("query"))


ITEMS = (
    "In the said rules, in section 5, the words shall be inserted.", "For rule 12A (b), the following shall be substituted, namely:", "In the Act, section 7 shall be omitted.", "After sub-section 3 insertion and omission happen.",
    "The rules are amended as follows.", "Before sub-rule 4 (i) it is renumbered.", "No such thing.", "x " * 900 + "inserted", "Amendment of sections.", "of the section 44 substitution",
)
_ACTS = "list_filter([" + ", ".join(f"CASE WHEN {sql_matches('lead', p, 'i')} THEN {sql_quote(k)} END" for k, p in L.ACTIONS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""
WITH l AS (SELECT c_custkey, left(text, 1500) AS lead FROM {_customers(ITEMS)}), a AS (SELECT c_custkey, lead, {_ACTS} AS acts FROM l)
SELECT c_custkey, CASE WHEN len(acts) = 1 THEN acts[1] WHEN len(acts) = 0 AND {sql_matches('lead', r'\bamend(?:ment|ed)\b', 'i')} THEN 'amendment' END AS action, len(acts) > 1 AS several,
  CASE WHEN {sql_matches('lead', L.AFFECTED, 'i')} THEN lower(regexp_extract(lead, {sql_quote('(?i)' + L.AFFECTED)}, 1)) || ' ' || regexp_extract(lead, {sql_quote('(?i)' + L.AFFECTED)}, 2) END AS affected FROM a
""")
def amending_items(spark, sf_dir):
    t = F.col("text")
    return customers(spark, sf_dir, ITEMS).select("c_custkey", tags.amendment_action(t).alias("action"), (F.size(tags.amendment_actions(t)) > 1).alias("several"), tags.affected_provision(t).alias("affected"))


FORMS = ("File Form VI with the registrar.", "See form-VII and Form vi.", "Submit Form 7, then Form 7 again, or Form A-12.", "A complaint in Form IX", "no forms", "Format VI is no form; form  – VII is", "")


@query(f"""
WITH f AS (SELECT c_custkey, CASE c_custkey // 7 % 3 WHEN 1 THEN 'Form X' WHEN 2 THEN 'XI' END AS given, list_transform(regexp_extract_all(text, {sql_quote('(?i)' + L.FORM)}, 1), lambda x: 'Form ' || upper(x)) AS found, {sql_matches('text', L.FORM_CONTEXT, 'i')} AS filing FROM {_customers(FORMS)})
SELECT c_custkey, len(list_distinct(found)) AS forms, CASE WHEN given IS NOT NULL THEN CASE WHEN starts_with(given, 'Form ') THEN given ELSE 'Form ' || given END WHEN filing THEN found[1] END AS form_number,
  (given IS NOT NULL OR filing) AND len(list_distinct(found)) > 1 AS several FROM f
""")
def form_numbers(spark, sf_dir):
    """Forms named in texts, beside the form that a record has already."""
    k = F.floor(F.col("c_custkey") / 7) % 3
    number, several = tags.form_number(F.col("text"), F.when(k == 1, "Form X").when(k == 2, "XI"))
    return customers(spark, sf_dir, FORMS).select("c_custkey", F.size(tags.form_mentions(F.col("text"))).alias("forms"), number.alias("form_number"), several.alias("several"))


WARNINGS = ("TABLE_REVIEW", "HIERARCHY_REVIEW", "EXTRACTION_QUALITY_REVIEW", "STRUCTURE_UNCERTAIN", "LEGACY_FONT_ENCODING_REVIEW", "TOC_REVIEW", "LONG_CHUNK_NO_SAFE_SPLIT")


@query(f"""
WITH w AS (SELECT o_orderkey, list_filter([{', '.join(f"CASE WHEN o_orderkey // {2**k} % 2 = 1 THEN {sql_quote(n)} END" for k, n in enumerate(WARNINGS))}], lambda x: x IS NOT NULL) AS warnings,
  CASE o_orderkey % 3 WHEN 0 THEN 'parent' ELSE 'child' END AS record_type, CASE o_custkey % 2 WHEN 0 THEN 950 ELSE 90 END AS n, (['act', 'rules', 'scheme_guideline'])[CAST(o_custkey % 3 AS INTEGER) + 1] AS dtype,
  (['Schedule II', 'Duties', NULL])[CAST(o_custkey % 5 % 3 AS INTEGER) + 1] AS heading, o_custkey % 7 < 4 AS numbered, (['complete_provision', 'front_matter', 'context_only'])[CAST(o_custkey % 11 % 3 AS INTEGER) + 1] AS scope FROM orders),
b AS (SELECT *, list_sort(list_filter(warnings, lambda x: list_contains({sql_literal(L.SEVERE)}, x))) AS blocks FROM w)
SELECT o_orderkey, array_to_string(blocks, ';') AS blocking, CASE
  WHEN record_type = 'parent' THEN CASE WHEN list_contains(warnings, 'EXTRACTION_QUALITY_REVIEW') OR list_contains(warnings, 'LEGACY_FONT_ENCODING_REVIEW') THEN 'REVIEW' ELSE 'REFERENCE_ONLY' END
  WHEN n > 900 AND dtype IN ('rules', 'scheme_guideline') AND (coalesce(heading, '') = 'Schedule II' OR list_contains(warnings, 'TABLE_REVIEW') OR NOT numbered) THEN 'REFERENCE_ONLY'
  WHEN n > 900 AND len(blocks) = 0 THEN 'ACTIVE' WHEN len(blocks) > 0 THEN 'REVIEW' WHEN scope <> 'complete_provision' THEN 'REFERENCE_ONLY' ELSE 'ACTIVE' END AS retrieval_status FROM b
""")
def record_statuses(spark, sf_dir):
    """Blocking warnings and the status of records of all kinds."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    warnings = F.array_compact(F.array(*[F.when(F.floor(key / 2**k) % 2 == 1, F.lit(n)) for k, n in enumerate(WARNINGS)]))
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (at + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", warnings.alias("warnings"), F.when(key % 3 == 0, "parent").otherwise("child").alias("record_type"), F.when(cust % 2 == 0, 950).otherwise(90).alias("n"),
        pick(("act", "rules", "scheme_guideline"), cust % 3).alias("dtype"), pick(("Schedule II", "Duties", None), cust % 5 % 3).alias("heading"), (cust % 7 < 4).alias("numbered"),
        pick(("complete_provision", "front_matter", "context_only"), cust % 11 % 3).alias("scope"),
    )
    status = tags.retrieval_status(*[F.col(c) for c in ("record_type", "n", "dtype", "heading", "numbered", "scope", "warnings")])
    return rows.select("o_orderkey", F.array_join(tags.blocking(F.col("warnings")), ";").alias("blocking"), status.alias("retrieval_status"))


LABELS = ("Karnataka", " MAHARASHTRA ", "Multi-State cooperative", "central / India scheme", "Not sure", "", "Goa", None)


@query(f"""
SELECT c_custkey, CASE trim(lower(coalesce(text, ''))) WHEN 'karnataka' THEN 'Karnataka' WHEN 'maharashtra' THEN 'Maharashtra' WHEN 'multi-state cooperative' THEN 'Multi-State' WHEN 'central / india scheme' THEN 'India'
  WHEN 'not sure' THEN 'Unknown' WHEN '' THEN 'Unknown' END AS scope FROM {_customers(LABELS)}
""")
def scope_labels(spark, sf_dir):
    return customers(spark, sf_dir, LABELS).select("c_custkey", serving.scope_of_label(F.col("text")).alias("scope"))


UPLOADS = (
    ("a.wav", "audio/wav", "524946460000000057415645", "wav"), ("a.WAV", None, "524946460000000057415645", "wav"), ("a.mp3", "audio/mpeg", "494433040000", "mp3"), ("b.mp3", "", "FFFB9000", "mp3"), ("c.flac", "audio/flac", "664C6143", "flac"),
    ("c.flac", "audio/ogg", "664C6143", None), ("d.ogg", "audio/ogg", "4F676753", None), ("wav", "audio/wav", "524946460000000057415645", None), ("e.wav", "audio/wav", "494433040000", None), (None, None, "524946460000000057415645", None),
    ("f.wav", "audio/wav", "", None), ("g.webm", None, "1A45DFA3", None), ("dir.mp3/h.wav", "audio/x-wav", "524946461111111157415645", "wav"),
)


_UPLOAD = sql_rows("k, name, type, hex", [(k, n, t, h) for k, (n, t, h, _) in enumerate(UPLOADS)])


@query(f"""
WITH u AS (SELECT c_custkey, name, type, hex || CASE WHEN c_custkey % 2 = 0 THEN '00FF' ELSE '' END AS hex FROM customer JOIN {_UPLOAD} ON k = c_custkey % {len(UPLOADS)}),
f AS (SELECT *, lower(regexp_extract(coalesce(name, ''), '\\.([^./\\\\]+)$', 1)) AS suffix, CASE WHEN starts_with(hex, '52494646') AND hex[17:24] = '57415645' THEN 'wav' WHEN starts_with(hex, '664C6143') THEN 'flac' WHEN starts_with(hex, '494433') OR regexp_matches(hex, '^FF[EF]') THEN 'mp3' END AS kind FROM u)
SELECT c_custkey, CASE WHEN suffix = kind AND coalesce(type, '') IN ('', 'audio/wav', 'audio/x-wav', 'audio/flac', 'audio/mpeg') THEN kind END AS kind FROM f
""")
def upload_kinds(spark, sf_dir):
    """Recordings of customers by name, declared type and first bytes."""
    k = (F.col("c_custkey") % len(UPLOADS) + 1).cast("int")
    pick = lambda n: F.element_at(F.array(*[F.lit(u[n]).cast("string") for u in UPLOADS]), k)
    data = F.unhex(F.concat(pick(2), F.when(F.col("c_custkey") % 2 == 0, "00FF").otherwise("")))
    return table(spark, sf_dir, "customer").select("c_custkey", serving.upload_kind(pick(0), pick(1), data).alias("kind"))


@query("""
WITH t AS (SELECT c_custkey, repeat('q', CAST(CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1500 WHEN 2 THEN 1501 ELSE 4001 END AS INTEGER)) AS text, c_custkey % 7 AS turns, CASE WHEN c_custkey % 10 = 9 THEN 4001 ELSE 4000 END AS longest FROM customer)
SELECT c_custkey, CASE WHEN turns > 4 OR (turns > 0 AND longest > 4000) THEN 422 WHEN length(text) = 0 OR length(text) > 1500 THEN 400 END AS question, CASE WHEN length(text) = 0 THEN 400 WHEN length(text) > 4000 THEN 413 END AS speech,
  CASE WHEN c_custkey % 3 = 2 OR length(text) = 0 THEN 400 WHEN c_custkey % 5 = 4 THEN 400 END AS audio FROM t
""")
def refused_requests(spark, sf_dir):
    """Limits of questions, histories, texts to speak and recordings."""
    k = F.col("c_custkey")
    size = F.when(k % 4 == 0, 0).when(k % 4 == 1, 1500).when(k % 4 == 2, 1501).otherwise(4001)
    text = F.repeat(F.lit("q"), size)
    history = F.array_repeat(F.repeat(F.lit("h"), F.when(k % 10 == 9, 4001).otherwise(4000)), (k % 7).cast("int"))
    language, kind = F.when(k % 3 == 2, "xx").otherwise(" EN "), F.when(k % 5 != 4, "wav")
    return table(spark, sf_dir, "customer").select("c_custkey", tags.request_error(text, history).alias("question"), tags.speech_error(text).alias("speech"), tags.audio_error(text.cast("binary"), language, kind).alias("audio"))


@query("SELECT c_custkey, c_name AS decoded, to_base64(encode(c_name)) AS encoded, regexp_replace(trim(' ' || c_name || '  x '), '\\s+', ' ', 'g') AS transcript FROM customer")
def audio_texts(spark, sf_dir):
    """Bytes as base64 and back, and transcripts with single spaces."""
    encoded = X.encoded_audio(F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.decoded_audio(encoded).cast("string").alias("decoded"), encoded.alias("encoded"), X.transcript(F.concat(F.lit(" "), "c_name", F.lit("  x "))).alias("transcript"))


BLOCKS = ("1. one\n2) two\n\n- a\n* b\n• c\n\nplain **bold** and **more**", "1. one\nnot numbered", "\n\n", "• only\n\n\n3. x", "text\n \n**b**", "")


@query(f"""
WITH p AS (SELECT c_custkey, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda b: trim(b, ' ' || chr(9) || chr(10) || chr(13))), lambda b: b <> '') AS blocks FROM {_customers(BLOCKS)}),
b AS (SELECT c_custkey, i - 1 AS block_no, blocks[i] AS block FROM (SELECT c_custkey, blocks, unnest(generate_series(1, len(blocks))) AS i FROM p)), l AS (SELECT *, list_filter(string_split(block, chr(10)), lambda x: trim(x) <> '') AS ls FROM b)
SELECT c_custkey, CAST(block_no AS INTEGER) AS block_no, CASE WHEN len(list_filter(ls, lambda x: NOT regexp_matches(x, '^\\s*[0-9]+[.)]\\s+'))) = 0 THEN 'ordered' WHEN len(list_filter(ls, lambda x: NOT regexp_matches(x, '^\\s*[-*•]\\s+'))) = 0 THEN 'bullets' ELSE 'paragraph' END AS kind,
  CAST(len(ls) AS INTEGER) AS lines, CAST(len(regexp_extract_all(block, '\\*\\*([^*]+)\\*\\*')) AS INTEGER) AS bold_spans FROM l
""")
def blocks_of_answers(spark, sf_dir):
    return answers.answer_blocks(customers(spark, sf_dir, BLOCKS), "c_custkey", "text").drop("block")


PATHS = ("a/b.pdf", "a/../b", "../b", "a/../../b", "/a", "C:\\a", "", "a\\b.pdf", "./x", "..\\x", "a/b/../../c", "a/b/../../../c", None, "   ")


@query(f"""
WITH p AS (SELECT c_custkey AS k, replace(coalesce(text, '') || CASE WHEN c_custkey % 3 = 0 THEN '/' || c_name ELSE '' END, chr(92), '/') AS path FROM {_customers(PATHS)}),
s AS (SELECT k, generate_subscripts(string_split(path, '/'), 1) AS i, unnest(string_split(path, '/')) AS step FROM p), d AS (SELECT k, sum(CASE step WHEN '' THEN 0 WHEN '.' THEN 0 WHEN '..' THEN -1 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS depth FROM s),
m AS (SELECT k, min(depth) AS least FROM d GROUP BY k)
SELECT p.k AS c_custkey, trim(path) <> '' AND NOT regexp_matches(path, '^(/|[A-Za-z]:)') AND least >= 0 AS inside FROM p JOIN m ON m.k = p.k
""")
def path_containment(spark, sf_dir):
    """Relative paths of customers that stay in their folder."""
    path = F.concat(X.filled("text"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("/"), "c_name")).otherwise(""))
    return customers(spark, sf_dir, PATHS).select("c_custkey", quality.path_is_inside(path).alias("inside"))


SENTENCES = ("One ends here. Two begins there! Is three a question? No. 5 is none. e.g. this. The Act s. 12 applies. Mr. Roe", "A. B. C. Then so.", "no end", "", "Ends. The end.\nNew line? Yes it is.")


@query(f"SELECT c_custkey, list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+([A-Z][a-z]{{2,}}\\b)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x) AS sentences, {sql_words('text')} AS words FROM {_customers(SENTENCES)}")
def sentence_lists(spark, sf_dir):
    """Sentences end before a capitalised word of three letters or more."""
    return customers(spark, sf_dir, SENTENCES).select("c_custkey", X.sentences("text").alias("sentences"), X.words("text").alias("words"))


REPLIES = (
    '{"answer": "Yes.", "abstained": false, "used_evidence_ids": ["E1", "E2"]}', '```json\n{"answer": "", "abstained": true, "abstention_reason": "NONE"}\n```', "```\n{\"answer\": \"x\", \"abstained\": false}```", "sorry", '{"answer": "x"}', '{"abstained": true}', "", None, "[1, 2]",
)


@query(f"""
WITH t AS (SELECT c_custkey, regexp_replace(regexp_replace(trim(coalesce(text, '')), '^```(json)?\\s*', '', 'i'), '\\s*```$', '') AS raw FROM {_customers(REPLIES)}), v AS (SELECT c_custkey, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM t)
SELECT c_custkey, CASE WHEN ok THEN j->>'answer' END AS answer, CASE WHEN ok THEN CAST(j->>'abstained' AS BOOLEAN) END AS abstained, CASE WHEN ok THEN j->>'abstention_reason' END AS reason,
  CASE WHEN ok THEN array_to_string(CAST(j->'used_evidence_ids' AS VARCHAR[]), ';') END AS used FROM (SELECT *, coalesce((j->>'answer') IS NOT NULL AND (j->>'abstained') IS NOT NULL, false) AS ok FROM v)
""")
def parsed_replies(spark, sf_dir):
    """Replies of a responder, in code fences or not, as a struct."""
    r = F.col("r")
    rows = customers(spark, sf_dir, REPLIES).withColumn("r", X.reply("text"))
    return rows.select("c_custkey", r["answer"].alias("answer"), r["abstained"].alias("abstained"), r["abstention_reason"].alias("reason"), F.array_join(r["used_evidence_ids"], ";").alias("used"))


ANSWERS = (("See Section 12 and rule 4-A.", "Text of section 12 here"), ("Form VI applies; SECTION 9.", "form vi"), ("no claim", ""), ("Rule 7  and section\n8", "rule 7 section 8"), ("Ｓection 5", "sect 5"), ("section 5\u00a0x", "Section\u20095 y"))
_NFKC = "replace(replace(replace({}, chr(65331), 'S'), chr(160), ' '), chr(8201), ' ')"


@query(f"""
WITH t AS (SELECT c_custkey, {_NFKC.format('text')} AS answer, {_NFKC.format('evidence')} AS evidence FROM (SELECT *, ({sql_literal([e for _, e in ANSWERS])})[CAST(c_custkey % {len(ANSWERS)} AS INTEGER) + 1] AS evidence FROM {_customers([a for a, _ in ANSWERS])})),
c AS (SELECT c_custkey, unnest(regexp_extract_all(lower(regexp_replace(answer, '\\s+', ' ', 'g')), '\\b(?:section|rule|form)\\s+[a-z0-9]+(?:-[a-z0-9]+)?\\b')) AS claim, lower(regexp_replace(evidence, '\\s+', ' ', 'g')) AS e FROM t)
SELECT c_custkey, claim FROM c WHERE NOT contains(e, claim)
""")
def unlocated_claims(spark, sf_dir):
    """Claims that the evidence does not name, after compatibility forms are made plain (here those of the samples)."""
    rows = sampled(table(spark, sf_dir, "customer"), "c_custkey", [e for _, e in ANSWERS]).withColumnRenamed("text", "evidence")
    return answers.unsupported_claims(sampled(rows, "c_custkey", [a for a, _ in ANSWERS]), "c_custkey", "text", "evidence")


SCRIPTS = ("plain", "कर्नाटक", "ಕರ್ನಾಟಕ", "mixed क text", "Ünïcode", "", 'a "quoted" \\ line\n\ttab', "\x01\x1f control", "𝔸stral 🎉/")


@query(f"SELECT c_custkey, {sql_matches('text', '[ऀ-ॿಀ-೿]')} AS indic, length('{{\"a\": ' || CAST(to_json(text) AS VARCHAR) || ', \"n\": [1, null], \"né\": {{\"b\": true, \"d\": \"1995-01-01\"}}, \"m\": {{\"x\": ' || c_custkey || '}}}}') AS size FROM {_customers(SCRIPTS)}")
def script_and_json(spark, sf_dir):
    """Indic script, and the length of JSON as it is sent, with quotes, control characters and letters beyond the first plane."""
    rows = customers(spark, sf_dir, SCRIPTS)
    inner = F.struct(F.lit(True).alias("b"), F.lit("1995-01-01").cast("date").alias("d"))
    value = F.struct(F.col("text").alias("a"), F.array(F.lit(1), F.lit(None).cast("int")).alias("n"), inner.alias("né"), F.create_map(F.lit("x"), F.col("c_custkey")).alias("m"))
    kind = rows.select(value.alias("v")).schema["v"].dataType
    return rows.select("c_custkey", X.has_indic("text").alias("indic"), jsons.length(value, kind).alias("size"))


@query("""
SELECT event_id, sha256('{"B":true,"a":[' || event_id || ',null],"b":{"y":"' || user_id || '","z":null},"props":' || replace(props, ' ', '') || ',"é":1}') AS of_text,
  sha256('{"a":{"k":' || event_id || ',"é":2},"b":[{"x":null,"y":"' || user_id || '"}]}') AS of_columns FROM events
""")
def canonical_hashes(spark, sf_dir):
    """Hashes of JSON with sorted keys: of texts with events' properties in them, and of structs, arrays and maps."""
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    text = F.concat(F.lit('{"é": 1, "b": {"z": null, "y": "'), user, F.lit('"}, "a": ['), event, F.lit(', null], "props": '), "props", F.lit(', "B":true}'))
    value = F.struct(F.array(F.struct(user.alias("y"), F.lit(None).cast("string").alias("x"))).alias("b"), F.create_map(F.lit("é"), F.lit(2).cast("long"), F.lit("k"), F.col("event_id")).alias("a"))
    rows = table(spark, sf_dir, "events")
    kind = rows.select(value.alias("v")).schema["v"].dataType
    return rows.select("event_id", jsons.canonical_hash(text, T.StringType()).alias("of_text"), jsons.canonical_hash(value, kind).alias("of_columns"))


FOLDS = ("Straße", "ΣΊΣΥΦΟΣ ς", "ﬁnal ﬀ ŉ ΐ", "İstanbul ǰ", "Ünïcode", "Ꭰ ꭰ ᏸ", "PLAIN", "ẞ ſ K Å", "և ẖ ᾳ")


@query(f"SELECT c_custkey, ({sql_literal([x.casefold() for x in FOLDS])})[CAST(c_custkey % {len(FOLDS)} AS INTEGER) + 1] || lower(c_name) AS folded FROM customer")
def folded_texts(spark, sf_dir):
    """Names after words of several scripts, case folded."""
    return customers(spark, sf_dir, FOLDS).select("c_custkey", X.fold(F.concat("text", "c_name")).alias("folded"))

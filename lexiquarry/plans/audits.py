"""Queries of audits and stores: sources, validation reports, record checks, counters, lists, files and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions.text import words
from lexiquarry.operators import dialog, quality, retrieval
from lexiquarry.plans.common import registry, sql_entities, sql_shown, sql_words, table
from lexiquarry.sources import page_scan, store, tables
from lexiquarry.sources.scratch import fresh, written
from lexiquarry.streaming import incremental

QUERIES, ORACLE_SQL, query = registry()

#: Sources by key: missing title, twice, odd priority, another file name, a path that leads out.
_SOURCES = """
s AS (SELECT 's' || CASE n_nationkey % 12 WHEN 7 THEN 6 ELSE n_nationkey END AS source_id, CASE n_nationkey % 5 WHEN 1 THEN ' ' ELSE n_name END AS title, 'f' || n_nationkey || '.pdf' AS filename,
  CASE n_nationkey % 7 WHEN 2 THEN '../' WHEN 3 THEN 'in/' ELSE '' END || 'f' || (n_nationkey + CASE n_nationkey % 4 WHEN 3 THEN 1 ELSE 0 END) || '.pdf' AS relative_path, (['high', 'medium', 'low', 'none'])[n_nationkey % 4 + 1] AS priority, n_nationkey AS k FROM nation)
"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = lambda n: F.concat(F.lit("f"), n.cast("string"), F.lit(".pdf"))
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("s"), F.when(k % 12 == 7, 6).otherwise(k).cast("string")).alias("source_id"), F.when(k % 5 == 1, " ").otherwise(F.col("n_name")).alias("title"), name(k).alias("filename"),
        F.concat(F.when(k % 7 == 2, "../").when(k % 7 == 3, "in/").otherwise(""), name(k + F.when(k % 4 == 3, 1).otherwise(0))).alias("relative_path"),
        F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "none")]), k % 4 + 1).alias("priority"), k.alias("k"),
    )


@query(f"""
WITH {_SOURCES}, i AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM s)
SELECT k, array_to_string(list_filter([CASE WHEN trim(title) = '' THEN 'missing title' END, CASE WHEN n > 1 THEN 'duplicate source_id' END, CASE WHEN priority = 'none' THEN 'invalid priority' END,
  CASE WHEN regexp_extract(relative_path, '[^/]*$') <> filename THEN 'filename differs from relative_path' END, CASE WHEN starts_with(relative_path, '../') THEN 'unsafe relative_path' END, CASE WHEN relative_path NOT IN (SELECT relative_path FROM s WHERE k % 6 <> 5) THEN 'file missing' END], lambda x: x IS NOT NULL), '; ') AS metadata_issues FROM i
""")
def source_issues(spark, sf_dir):
    rows = _sources(spark, sf_dir)
    files = rows.where("k % 6 <> 5").select("relative_path").distinct()
    return quality.source_issues(rows, ["title"], files).select("k", "metadata_issues")


_VALID = "v AS (SELECT k, source_id, CASE k % 4 WHEN 0 THEN 'TEXT_BASED' WHEN 1 THEN 'MIXED' WHEN 2 THEN 'LIKELY_SCANNED' ELSE 'TEXT_BASED' END AS classification, CASE k % 8 WHEN 4 THEN 'missing title' ELSE '' END AS metadata_issues, CASE k % 11 WHEN 3 THEN 'broken' ELSE '' END AS errors, k % 6 <> 5 AS file_exists FROM s WHERE k % 9 <> 8 AND k % 12 <> 7)"


def _validated(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    rows = _sources(spark, sf_dir).where((k % 9 != 8) & (k % 12 != 7))
    kind = F.when(k % 4 == 1, "MIXED").when(k % 4 == 2, "LIKELY_SCANNED").otherwise("TEXT_BASED")
    advice = F.when(k % 4 == 1, "PARTIAL").when(k % 4 == 2, "YES").otherwise("NO")
    return rows.select("k", "source_id", kind.alias("classification"), advice.alias("ocr_recommendation"), F.when(k % 8 == 4, "missing title").otherwise("").alias("metadata_issues"), F.when(k % 11 == 3, "broken").otherwise("").alias("errors"), (k % 6 != 5).alias("file_exists"))


@query(f"WITH {_SOURCES}, {_VALID} SELECT s.source_id, CASE WHEN v.k IS NULL THEN 'NOT_VALIDATED' WHEN classification <> 'TEXT_BASED' OR metadata_issues <> '' OR errors <> '' THEN 'NOT_CLEAN' END AS reason FROM s LEFT JOIN v ON v.source_id = s.source_id")
def usable_sources(spark, sf_dir):
    """Sources by their validation report, and those without one."""
    return quality.usable_sources(_sources(spark, sf_dir), _validated(spark, sf_dir))


@query(f"""
WITH {_SOURCES}, {_VALID} SELECT count(*) AS sources, count(*) FILTER (file_exists) AS files_found, count(*) FILTER (classification = 'TEXT_BASED') AS text_based, count(*) FILTER (classification = 'MIXED') AS mixed, count(*) FILTER (classification = 'LIKELY_SCANNED') AS likely_scanned,
  count(*) FILTER (classification = 'ERROR') AS error, count(*) FILTER (classification = 'LIKELY_SCANNED') AS ocr_required, count(*) FILTER (classification = 'MIXED') AS ocr_partial, count(*) FILTER (metadata_issues <> '') AS with_issues, count(*) FILTER (metadata_issues <> '' OR errors <> '') AS for_review FROM v
""")
def class_counts(spark, sf_dir):
    return quality.class_counts(_validated(spark, sf_dir))


#: Records by key of a customer, with faults of all kinds planted.
_RECORDS = f"""
d AS (SELECT n_nationkey AS source_id, 'J' || n_regionkey AS jurisdiction, (['act', 'rules', 'scheme_guideline'])[n_nationkey % 3 + 1] AS document_type, '05-0' || (n_nationkey % 3 + 1) || '-2024' AS retrieved_date FROM nation),
r AS (SELECT c_custkey AS k, CAST(c_nationkey AS INTEGER) AS source_id, 'c' || CASE WHEN c_custkey % 97 = 96 THEN c_custkey - 1 ELSE c_custkey END AS chunk_id, CASE WHEN c_custkey % 10 = 0 THEN 'parent' ELSE 'child' END AS record_type,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 53 = 1 THEN 'zz' WHEN c_custkey % 59 = 2 THEN NULL ELSE 'c' || (c_custkey // 10 * 10) END AS parent_id, CASE WHEN c_custkey % 41 = 3 THEN 'X' ELSE 'J' || d.jurisdiction[2:] END AS jurisdiction, d.document_type AS document_type,
  CASE WHEN c_custkey % 67 = 5 THEN '' ELSE 'http' END AS source_url, CASE WHEN c_custkey % 71 = 7 THEN '' WHEN c_custkey % 13 = 4 THEN 'File Form VI with the complaint' WHEN c_custkey % 17 = 6 THEN 'same text' ELSE 'text of ' || c_custkey END AS text,
  CASE WHEN c_custkey % 73 = 8 THEN 1 ELSE 0 END AS off, CASE WHEN c_custkey % 43 = 9 THEN 0 ELSE 1 END AS page_start, CASE c_custkey % 19 WHEN 3 THEN ['claim', 'nonsense'] WHEN 5 THEN ['membership'] ELSE ['claim'] END AS topics,
  CASE c_custkey % 4 WHEN 1 THEN '4' WHEN 2 THEN '4.1' END AS section, CASE WHEN c_custkey % 4 = 3 THEN '7' END AS rule, CASE c_custkey % 23 WHEN 4 THEN 'Schedule' WHEN 5 THEN NULL ELSE 'Duties' END AS heading, CASE c_custkey % 29 WHEN 6 THEN 'front_matter' ELSE 'complete_provision' END AS text_scope,
  list_filter([CASE WHEN c_custkey % 31 = 7 THEN 'TABLE_REVIEW' END, CASE WHEN c_custkey % 37 = 8 THEN 'STRUCTURE_UNCERTAIN' END, CASE WHEN c_custkey % 41 = 9 THEN 'TOC_REVIEW' END, CASE WHEN c_custkey % 43 = 1 THEN 'MULTIPLE_FORMS_REVIEW' END], lambda x: x IS NOT NULL) AS warnings,
  CASE WHEN c_custkey % 47 = 1 THEN '2024-12-31' ELSE '2024-0' || (c_nationkey % 3 + 1) || '-05' END AS retrieved_date FROM customer JOIN d ON d.source_id = c_nationkey),
f AS (SELECT *, length(text) + off AS char_count, {sql_words('text')} AS word_count, row_number() OVER (ORDER BY k) AS position FROM r)
"""


def _dim(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("source_id"), F.concat(F.lit("J"), F.col("n_regionkey").cast("string")).alias("jurisdiction"), F.element_at(F.array(*[F.lit(x) for x in ("act", "rules", "scheme_guideline")]), k % 3 + 1).alias("document_type"),
        F.format_string("05-0%d-2024", k % 3 + 1).alias("retrieved_date"), F.lit("A").alias("authority"), F.lit("r").alias("relative_path"), F.lit("http").alias("source_url"),
    )


def _records(spark, sf_dir) -> DataFrame:
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    c = lambda x: F.concat(F.lit("c"), s(x))
    region = _dim(spark, sf_dir).select(F.col("source_id").alias("c_nationkey"), F.col("jurisdiction").alias("j"), "document_type")
    rows = table(spark, sf_dir, "customer").join(region, "c_nationkey")
    text = F.when(k % 71 == 7, "").when(k % 13 == 4, "File Form VI with the complaint").when(k % 17 == 6, "same text").otherwise(F.concat(F.lit("text of "), s(k)))
    marks = F.array_compact(F.array(F.when(k % 31 == 7, F.lit("TABLE_REVIEW")), F.when(k % 37 == 8, F.lit("STRUCTURE_UNCERTAIN")), F.when(k % 41 == 9, F.lit("TOC_REVIEW")), F.when(k % 43 == 1, F.lit("MULTIPLE_FORMS_REVIEW"))))
    topics = F.when(k % 19 == 3, F.array(F.lit("claim"), F.lit("nonsense"))).when(k % 19 == 5, F.array(F.lit("membership"))).otherwise(F.array(F.lit("claim")))
    made = rows.select(
        k.alias("k"), F.col("c_nationkey").alias("source_id"), c(F.when(k % 97 == 96, k - 1).otherwise(k)).alias("chunk_id"), F.when(k % 10 == 0, "parent").otherwise("child").alias("record_type"),
        F.when((k % 10 == 0) | ((k % 59 == 2) & (k % 53 != 1)), None).when(k % 53 == 1, "zz").otherwise(c(F.floor(k / 10) * 10)).alias("parent_id"), F.when(k % 41 == 3, "X").otherwise(F.col("j")).alias("jurisdiction"), "document_type",
        F.when(k % 67 == 5, "").otherwise("http").alias("source_url"), text.alias("text"), F.when(k % 73 == 8, 1).otherwise(0).alias("off"), F.when(k % 43 == 9, 0).otherwise(1).alias("page_start"), F.lit(1).alias("page_end"), topics.alias("topics"),
        F.when(k % 4 == 1, "4").when(k % 4 == 2, "4.1").alias("section"), F.when(k % 4 == 3, "7").alias("rule"), F.lit(None).cast("string").alias("clause"), F.when(k % 23 == 4, "Schedule").when(k % 23 != 5, "Duties").alias("heading"),
        F.when(k % 29 == 6, "front_matter").otherwise("complete_provision").alias("text_scope"), marks.alias("warnings"), F.lit("A").alias("authority"), F.lit("r").alias("relative_path"), F.lit(None).cast("string").alias("form_number"),
        F.when(k % 47 == 1, "2024-12-31").otherwise(F.format_string("2024-0%d-05", F.col("c_nationkey") % 3 + 1)).alias("retrieved_date"), k.alias("position"),
    )
    return made.withColumn("char_count", F.length("text") + F.col("off")).withColumn("word_count", words("text"))


@query(f"""
WITH {_RECORDS}, p AS (SELECT chunk_id, position FROM f WHERE record_type = 'parent'), twice AS (SELECT chunk_id FROM f GROUP BY chunk_id HAVING count(*) > 1)
SELECT chunk_id, 'MISSING_FIELD' AS violation FROM f WHERE trim(text) = '' OR source_url = '' UNION ALL SELECT chunk_id, 'DUPLICATE_ID' FROM f WHERE chunk_id IN (SELECT chunk_id FROM twice)
UNION ALL SELECT f.chunk_id, 'METADATA_MISMATCH' FROM f JOIN d ON d.source_id = f.source_id WHERE f.jurisdiction <> d.jurisdiction UNION ALL SELECT chunk_id, 'TEXT_COUNT' FROM f WHERE off = 1 UNION ALL SELECT chunk_id, 'PAGE_RANGE' FROM f WHERE page_start = 0
UNION ALL SELECT chunk_id, 'UNKNOWN_TOPIC' FROM f WHERE list_contains(topics, 'nonsense') UNION ALL SELECT chunk_id, 'PARENT_MISSING_OR_LATER' FROM f WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.chunk_id = f.parent_id AND p.position < f.position)
UNION ALL SELECT chunk_id, 'CHILD_WITHOUT_PARENT' FROM f WHERE record_type = 'child' AND parent_id IS NULL
""")
def record_violations(spark, sf_dir):
    """Every rule of the record table broken somewhere."""
    return quality.violations(_records(spark, sf_dir), _dim(spark, sf_dir), ["claim", "membership"])


_AUDIT = f"""
{_RECORDS}, h AS (SELECT f.*, p.source_id AS p_source, p.section AS p_section, p.rule AS p_rule, p.text AS p_text, p.text_scope AS p_scope, p.page_start AS p_start, p.chunk_id AS p_id FROM f LEFT JOIN f p ON p.chunk_id = f.parent_id AND p.record_type = 'parent'),
g AS (SELECT h.*, list_sort(list_filter([
  CASE WHEN (h.document_type = 'act' AND section IS NULL OR h.document_type = 'rules' AND rule IS NULL) AND NOT (text_scope = 'front_matter' OR coalesce(heading, '') = 'Schedule') THEN 'MISSING_STRUCTURAL_ID' END,
  CASE WHEN row_number() OVER (PARTITION BY chunk_id ORDER BY k) > 1 THEN 'DUPLICATE_ID' END, CASE WHEN record_type = 'child' AND p_id IS NULL THEN 'MISSING_PARENT' END,
  CASE WHEN p_id IS NOT NULL AND (p_source <> h.source_id OR NOT (p_start <= page_start AND page_start <= 1) OR coalesce(p_rule <> rule, false) OR coalesce(NOT (section = p_section OR starts_with(section, p_section || '.')), false) OR (p_scope = 'complete_provision' AND NOT contains(p_text, text))) THEN 'HIERARCHY_REVIEW' END,
  CASE WHEN list_contains(topics, 'nonsense') OR (list_contains(topics, 'membership') AND true) THEN 'TOPIC_TAG_REVIEW' END, CASE WHEN starts_with(text, 'File Form VI') THEN 'FORM_NUMBER_MISSING' END,
  CASE WHEN h.jurisdiction <> d.jurisdiction OR source_url = '' OR h.retrieved_date <> '2024-0' || (h.source_id % 3 + 1) || '-05' THEN 'METADATA_REVIEW' END, CASE WHEN text = '' OR off = 1 THEN 'TEXT_COUNT_ERROR' END], lambda x: x IS NOT NULL)) AS flags,
  count(*) OVER (PARTITION BY text) > 1 AS copied FROM h JOIN d ON d.source_id = h.source_id),
a AS (SELECT *, CASE WHEN len(flags) > 0 OR list_contains(warnings, 'TOC_REVIEW') THEN 'REVIEW' ELSE 'INFO' END AS severity, array_to_string(list_sort(CASE WHEN copied THEN list_append(flags, 'DUPLICATE_TEXT') ELSE flags END), ';') AS audit_flags,
  array_to_string(list_filter([CASE WHEN word_count > 900 THEN 'A_LONG' END, CASE WHEN word_count < 20 THEN 'B_SHORT' END, CASE WHEN list_contains(warnings, 'STRUCTURE_UNCERTAIN') THEN 'E_STRUCTURE' END, CASE WHEN list_contains(warnings, 'TABLE_REVIEW') THEN 'F_TABLE' END], lambda x: x IS NOT NULL), ';') AS groups FROM g)
"""


def _audited(spark, sf_dir) -> DataFrame:
    return quality.audit(_records(spark, sf_dir), _dim(spark, sf_dir), ["claim", "membership"])


@query(f"WITH {_AUDIT} SELECT k, chunk_id, audit_flags, severity, groups FROM a")
def record_audit(spark, sf_dir):
    """Flags, severity and groups of records with faults of all kinds."""
    return _audited(spark, sf_dir).select("k", "chunk_id", "audit_flags", "severity", "groups")


@query(f"""
WITH {_AUDIT} SELECT source_id, count(*) FILTER (record_type = 'parent') AS parent_records, count(*) FILTER (record_type = 'child') AS child_records, count(*) FILTER (word_count < 20) AS all_records_lt20, count(*) FILTER (word_count > 900) AS all_records_gt900,
  count(*) FILTER (list_contains(warnings, 'STRUCTURE_UNCERTAIN')) AS structure_warnings, count(*) FILTER (list_contains(warnings, 'TABLE_REVIEW')) AS table_warnings, count(*) FILTER (list_contains(warnings, 'DUPLICATE_TEXT')) AS duplicate_text_warnings,
  count(*) FILTER (heading IS NULL) AS missing_heading_count, count(*) FILTER (list_contains(flags, 'MISSING_STRUCTURAL_ID')) AS missing_structural_id_count, count(*) FILTER (list_contains(flags, 'MISSING_PARENT')) AS missing_parent_count,
  count(*) FILTER (list_contains(flags, 'HIERARCHY_REVIEW')) AS hierarchy_warnings, count(*) FILTER (list_contains(flags, 'TOPIC_TAG_REVIEW')) AS topic_tag_warnings,
  count(*) FILTER (list_contains(flags, 'FORM_NUMBER_MISSING')) + count(*) FILTER (list_contains(warnings, 'MULTIPLE_FORMS_REVIEW')) AS form_number_warnings, count(*) FILTER (list_contains(flags, 'METADATA_REVIEW')) AS metadata_warnings, count(*) FILTER (severity = 'REVIEW') AS suspicious_chunks
FROM a GROUP BY source_id
""")
def source_counters(spark, sf_dir):
    return quality.source_counters(_audited(spark, sf_dir))


@query(f"""
WITH {_AUDIT} SELECT k, unnest(string_split(groups, ';')) AS "group" FROM a WHERE groups <> ''
UNION ALL (SELECT k, 'C_TOP20_LONG' FROM a ORDER BY word_count DESC, k LIMIT 20) UNION ALL (SELECT k, 'D_TOP20_SHORT' FROM a ORDER BY word_count, k LIMIT 20)
""")
def audit_lists(spark, sf_dir):
    """The six lists of an audit."""
    return quality.exception_groups(_audited(spark, sf_dir), key="k")


@query(f"WITH {_RECORDS} SELECT k, chunk_id, array_to_string(warnings, ';') AS warning FROM f WHERE k % 97 NOT IN (95, 96)")
def records_with_stats(spark, sf_dir):
    """Records with their row of statistics, one for each."""
    rows = _records(spark, sf_dir).where("k % 97 not in (95, 96)")
    stats = rows.select("chunk_id", F.array_join("warnings", ";").alias("warning"))
    return quality.with_stats(rows.select("k", "chunk_id"), stats).select("k", "chunk_id", "warning")


@query(f"""
WITH {_RECORDS}, s AS (SELECT *, CASE WHEN k % 3 = 2 THEN 'REVIEW' WHEN record_type = 'parent' THEN 'REFERENCE_ONLY' ELSE 'ACTIVE' END AS status, 'w ' || repeat('word ', CAST(k % 1000 AS INTEGER)) AS body FROM f WHERE k % 97 <> 96)
SELECT count(*) AS total_records, count(*) FILTER (status <> 'ACTIVE') AS records_excluded, count(*) FILTER (status = 'ACTIVE') AS active_records_indexed, CAST(sum(CASE WHEN status = 'ACTIVE' THEN greatest(ceil((k % 1000 + 1) / 440.0), 1) END) AS BIGINT) AS embedding_windows,
  count(*) FILTER (status = 'ACTIVE' AND k % 1000 + 1 > 440) AS multi_window_chunks, count(DISTINCT CASE WHEN status = 'ACTIVE' THEN source_id END) AS sources_represented FROM s
""")
def index_counts(spark, sf_dir):
    """Counts of an index over records of up to a thousand words; a heading stands before each window."""
    k = F.col("k")
    rows = _records(spark, sf_dir).where("k % 97 <> 96").withColumns({"retrieval_status": F.when(k % 3 == 2, "REVIEW").when(F.col("record_type") == "parent", "REFERENCE_ONLY").otherwise("ACTIVE"), "text": F.concat(F.lit("w "), F.repeat(F.lit("word "), (k % 1000).cast("int"))), "heading": F.lit("The heading")})
    return retrieval.index_counts(rows)


@query(f"WITH {_RECORDS} SELECT chunk_id, left(text, 250) AS text_preview FROM f JOIN d ON d.source_id = f.source_id WHERE k % 3 <> 2 AND record_type = 'child' AND f.jurisdiction = d.jurisdiction AND text <> ''")
def indexed_records(spark, sf_dir):
    """Active records in a stored index: checked, with a preview, less those that are not to be served."""
    rows = _records(spark, sf_dir).withColumn("retrieval_status", F.when(F.col("k") % 3 == 2, "REVIEW").when(F.col("record_type") == "parent", "REFERENCE_ONLY").otherwise("ACTIVE"))
    sound = rows.where("jurisdiction <> 'X' and text <> ''")
    made, _ = retrieval.stored_index(spark, fresh(spark, "index"), sound, _dim(spark, sf_dir), retrieval.hashed_embedder(64), "1")
    return made.where("size(vector) = 64").select("chunk_id", "text_preview")


_HELD = "count(*) FILTER (c_custkey IS NOT NULL)"


@query(f"""
WITH n AS (SELECT n_nationkey, n_nationkey % 5 = 0 AS changed, {_HELD} AS before, count(*) FILTER (c_acctbal > 0) AS after FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND NOT (n_nationkey % 7 = 3 AND c_custkey % 2 = 0) GROUP BY n_nationkey),
r AS (SELECT *, NOT changed AND before > 0 AS kept, CASE WHEN n_nationkey % 10 = 5 THEN 0 WHEN changed THEN after ELSE 0 END AS built FROM n)
SELECT n_nationkey, CASE WHEN before > 0 THEN 'built' ELSE 'failed' END AS first, CASE WHEN kept THEN 'reused' WHEN built > 0 THEN 'built' ELSE 'failed' END AS second,
  CAST(nullif(CASE WHEN built > 0 THEN built ELSE before END, 0) AS BIGINT) AS rows FROM r
""")
def rebuilt_sources(spark, sf_dir):
    """Customers of nations as the records of sources: all are built, then those of changed nations alone; a source that fails keeps what it had."""
    folder, k = fresh(spark, "sources"), F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal").where("not (n_nationkey % 7 = 3 and c_custkey % 2 = 0)")

    def build(wanted: DataFrame) -> DataFrame:
        rows = people.join(wanted, "n_nationkey").where((F.col("signature") == "1") | (F.col("c_acctbal") > 0))
        refused = (F.col("signature") == "2") & (k % 10 == 5)
        return rows.select("n_nationkey", "c_custkey", F.when(refused, "refused").alias("error"))

    first = store.rebuilt(nations.withColumn("signature", F.lit("1")), folder, "n_nationkey", build, failed="error")
    second = store.rebuilt(nations.withColumn("signature", F.when(k % 5 == 0, "2").otherwise("1")), folder, "n_nationkey", build, failed="error")
    rows = store.read(spark, folder).groupBy("n_nationkey").agg(F.count("*").alias("rows"))
    told = first.select("n_nationkey", F.col("status").alias("first")).join(second.select("n_nationkey", F.col("status").alias("second")), "n_nationkey")
    return told.join(rows, "n_nationkey", "left")


def _page_files(spark: SparkSession, sf_dir: str, folder: str, rows: Column) -> None:
    """The pages of ``rows`` as a file each, in a folder each."""
    html = table(spark, sf_dir, "pages").where(rows).select("page_id", F.coalesce("html", F.lit("")).alias("value"))
    html.repartition(8).write.mode("overwrite").option("compression", "none").partitionBy("page_id").text(folder)


_OPEN = "replace(replace(coalesce(html, ''), '&copy;', '©'), '&middot;', '·')"


@query(f"""
WITH p AS (SELECT page_id, html AS raw, {_OPEN} AS html FROM pages),
s AS (SELECT page_id, raw, {sql_shown('html')} AS shown, {sql_entities("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1 FROM p)
SELECT page_id, sha256(raw || chr(10)) AS sha256, trim(regexp_replace(h1, '\\s+', ' ', 'g')) AS heading, CAST(length(regexp_replace(shown, '\\s+', '', 'g')) AS BIGINT) AS characters, 0 AS outside FROM s WHERE trim(raw) <> ''
""")
def scanned_pages(spark, sf_dir):
    """Web pages as files through the page scan: content hash, text of the largest size, characters of all spans, and spans beyond the page's edge."""
    folder = fresh(spark, "pages")
    _page_files(spark, sf_dir, folder, F.lit(True))
    pages = page_scan.scan(spark, folder).where("error is null")
    spans = pages.select("path", "sha256", "page", "width", "height", F.posexplode_outer("spans").alias("at", "s"))
    large = F.array_sort(F.collect_list(F.when(F.col("s.size") == 20.0, F.struct("page", "at", "s.text"))))  # a heading's own spans
    found = spans.groupBy(F.regexp_extract("path", r"page_id=(\d+)/", 1).cast("long").alias("page_id"), "sha256").agg(
        F.array_join(large["text"], " ").alias("heading"), F.sum(F.coalesce(F.length(F.regexp_replace("s.text", " ", "")), F.lit(0))).cast("long").alias("characters"),
        F.count_if((F.col("s.x1") > F.col("width")) & (F.length("s.text") < 50) | (F.col("s.y1") > F.col("height"))).cast("int").alias("outside"),
    )
    return found


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id % 3 <> 0),
c AS (SELECT count(DISTINCT html) FILTER (trim(html) <> '') AS first, (SELECT count(DISTINCT html) FROM pages WHERE trim(html) <> '' AND page_id % 3 = 0 AND html NOT IN (SELECT html FROM p)) AS third FROM p)
SELECT step, CASE step WHEN 1 THEN (SELECT first FROM c) WHEN 2 THEN 0 ELSE (SELECT third FROM c) END AS parsed, CASE step WHEN 3 THEN (SELECT count(*) FROM pages WHERE trim(coalesce(html, '')) <> '') ELSE (SELECT count(*) FROM p WHERE trim(html) <> '') END AS files
FROM (SELECT unnest([1, 2, 3]) AS step)
""")
def cached_scans(spark, sf_dir):
    """Three scans of page files with one cache: all new, nothing new, and a third of the files added."""
    folder, cache, out = fresh(spark, "pages"), fresh(spark, "cache"), None
    for step, rows in enumerate((F.col("page_id") % 3 != 0, None, F.lit(True)), 1):
        if rows is not None:
            _page_files(spark, sf_dir, folder, rows)
        pages, parsed = page_scan.cached(spark, folder, cache)
        made = written(pages.where("error is null").agg(F.lit(step).alias("step"), F.lit(parsed).cast("long").alias("parsed"), F.count_distinct("path").alias("files")), "scan")
        out = made if out is None else out.unionByName(made)
    return out


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE trim(' ' || n_name || ', "x"' || CASE WHEN n_nationkey % 3 = 0 THEN chr(10) || 'y' ELSE '' END) END AS label FROM nation""")
def csv_round_trip(spark, sf_dir):
    """Cells with commas, quotes, line ends and blanks through a CSV file, checked against its contract."""
    k = F.col("n_nationkey")
    label = F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "n_name", F.lit(', "x"'), F.when(k % 3 == 0, "\ny").otherwise("")))
    path = fresh(spark, "csv")
    tables.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", label.alias("label"), F.lit("more").alias("other")).coalesce(1), path, ["n_nationkey", "label", "other"])
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("label", T.StringType())])
    return tables.read_csv(spark, path, schema, multiline=True)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name || ' ✓ \"q\"' END AS name, [c_nationkey, c_custkey] AS keys FROM customer")
def jsonl_round_trip(spark, sf_dir):
    """Nulls, lists and letters of all scripts through JSON lines."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit(' ✓ "q"'))).alias("name"), F.array(F.col("c_nationkey").cast("long"), "c_custkey").alias("keys"))
    path = fresh(spark, "jsonl")
    tables.write_jsonl(rows, path)
    return tables.read_jsonl(spark, path, rows.schema)


@query("""
SELECT 'q' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN ['s' || n_nationkey] ELSE [] END AS expected_source_ids, n_nationkey % 2 = 0 AS should_answer, false AS require_all_expected_sources FROM nation
UNION ALL SELECT 'r' || r_regionkey, ['s1', 's2'], true, r_regionkey % 2 = 0 FROM region
""")
def question_files(spark, sf_dir):
    """Questions of two files as one table, absent lists as empty ones."""
    paths, key = [fresh(spark, "questions") for _ in range(2)], F.col("n_nationkey")
    first = table(spark, sf_dir, "nation").select(F.struct(F.concat(F.lit("q"), key.cast("string")).alias("id"), (key % 2 == 0).alias("should_answer"), F.when(key % 2 == 0, F.array(F.concat(F.lit("s"), key.cast("string")))).alias("expected_source_ids")).alias("q"))
    region = F.col("r_regionkey")
    second = table(spark, sf_dir, "region").select(F.struct(F.concat(F.lit("r"), region.cast("string")).alias("id"), F.lit(True).alias("should_answer"), F.array(F.lit("s1"), F.lit("s2")).alias("expected_source_ids"), (region % 2 == 0).alias("require_all_expected_sources")).alias("q"))
    for path, rows in zip(paths, (first, second), strict=True):
        rows.agg(F.to_json(F.collect_list("q")).alias("value")).write.text(path)
    return tables.read_questions(spark, *paths).select("id", "expected_source_ids", "should_answer", "require_all_expected_sources")


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 4 THEN NULL ELSE 'KEY_' || n_nationkey END AS key, CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN n_name || '=' || n_regionkey WHEN 2 THEN 'a b' WHEN 3 THEN '' END AS value FROM nation WHERE n_nationkey % 6 <> 5 AND n_nationkey % 5 <> 4
""")
def env_lines(spark, sf_dir):
    """KEY=VALUE lines of nations; comments and lines without a sign are left out."""
    k, key = F.col("n_nationkey"), F.concat(F.lit("KEY_"), F.col("n_nationkey").cast("string"))
    line = (
        F.when(k % 6 == 5, F.concat(F.lit("# "), key, F.lit("=x"))).when(k % 5 == 0, F.concat(key, F.lit("="), "n_name")).when(k % 5 == 1, F.concat(F.lit("  "), key, F.lit(' = "'), "n_name", F.lit("="), F.col("n_regionkey").cast("string"), F.lit('" ')))
        .when(k % 5 == 2, F.concat(key, F.lit("='a b'"))).when(k % 5 == 3, F.concat(key, F.lit("="))).otherwise("no sign")
    )
    return tables.env_pairs(table(spark, sf_dir, "nation").select("n_nationkey", line.alias("line")), "line").select("n_nationkey", "key", "value")


@query("SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events WHERE event_id % 7 <> 3) WHERE place <= 20")
def recent_conversations(spark, sf_dir):
    """Events as stored conversations: the last twenty of each user, damaged ones left out."""
    store_ = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 7 != 3, F.col("event_id")).alias("event_id"), "ts")
    return dialog.recent_conversations(store_, "user_id", "event_id", "ts").select("user_id", "event_id", "place")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 11 = 2 THEN 'built' ELSE 'kept' END AS origin FROM orders
""")
def refreshed_results(spark, sf_dir):
    """Only rows that are new or changed are built; rows that are gone go."""
    k = F.col("o_orderkey")
    current = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 1, "new").otherwise("old").alias("signature"))
    known = current.where(k % 11 != 2).withColumn("signature", F.lit("old")).withColumn("origin", F.lit("kept")).unionByName(spark.createDataFrame([(-1, "old", "kept")], "o_orderkey long, signature string, origin string"))
    return incremental.refreshed(current, known, "o_orderkey", "signature", lambda d: d.withColumn("origin", F.lit("built"))).select("o_orderkey", "origin")

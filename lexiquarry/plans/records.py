"""Queries on record tables: documents as records of their sources, orders as parents of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import tags
from lexiquarry.functions.text import content_hash, iso_date, norm, slug, words
from lexiquarry.operators import quality as Q
from lexiquarry.plans.common import registry, sql_matches, sql_norm, sql_words, table

QUERIES, ORACLE_SQL, query = registry()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""
SELECT source, lang, count(*) AS records,
  count(*) FILTER (w < 20) AS chunks_lt20, count(*) FILTER (w >= 20 AND w < 50) AS chunks_20_49,
  count(*) FILTER (w >= 50 AND w < 150) AS chunks_50_149, count(*) FILTER (w >= 150 AND w <= 450) AS chunks_150_450,
  count(*) FILTER (w > 450 AND w <= 900) AS chunks_451_900, count(*) FILTER (w > 900) AS chunks_gt900,
  CAST(min(w) AS BIGINT) AS word_min, quantile_cont(CAST(w AS DOUBLE), 0.1) AS word_p10, quantile_cont(CAST(w AS DOUBLE), 0.5) AS word_median,
  quantile_cont(CAST(w AS DOUBLE), 0.9) AS word_p90, CAST(max(w) AS BIGINT) AS word_max
FROM (SELECT source, lang, {sql_words('text')} AS w FROM documents) GROUP BY source, lang
""")
def word_profile_by_source(spark, sf_dir):
    return Q.word_profile(docs(spark, sf_dir), ["source", "lang"])


@query(f"""
SELECT source, count(*) AS records, CAST(min(w) AS BIGINT) AS word_min, quantile_cont(CAST(w AS DOUBLE), 0.5) AS word_median,
  CAST(sum(w) AS BIGINT) AS words, CAST(max(w) AS BIGINT) AS word_max
FROM (SELECT source, {sql_words('text')} AS w FROM documents) GROUP BY ROLLUP (source)
""")
def corpus_summary(spark, sf_dir):
    return Q.corpus_summary(docs(spark, sf_dir), "source")


@query(f"""
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, CAST({sql_words('text')} AS BIGINT) AS word_count FROM documents)
SELECT doc_id, text_hash, copies, word_count, word_count >= 150 AS major
FROM (SELECT *, count(*) OVER (PARTITION BY text_hash) AS copies FROM h) WHERE copies > 1
""")
def duplicate_text(spark, sf_dir):
    return Q.duplicate_groups(docs(spark, sf_dir), "doc_id")


@query(f"""
WITH h AS (SELECT source, sha256(coalesce(text, '')) AS h, {sql_words('text')} AS w FROM documents),
     g AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
SELECT source, count(*) FILTER (w >= 150) AS major_duplicates, count(*) AS duplicates FROM h WHERE h IN (SELECT h FROM g) GROUP BY source
""")
def major_duplicates(spark, sf_dir):
    copies = Q.duplicate_groups(docs(spark, sf_dir), "doc_id")
    return copies.join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count_if("major").alias("major_duplicates"), F.count("*").alias("duplicates"))


@query(f"SELECT doc_id, CAST({sql_words('text')} AS BIGINT) AS word_count FROM documents ORDER BY word_count DESC, doc_id LIMIT 20")
def longest20(spark, sf_dir):
    return Q.longest(docs(spark, sf_dir), "doc_id", 20)


@query(f"SELECT doc_id, CAST({sql_words('text')} AS BIGINT) AS word_count FROM documents ORDER BY word_count, doc_id LIMIT 20")
def shortest20(spark, sf_dir):
    return Q.longest(docs(spark, sf_dir), "doc_id", 20, shortest=True)


def _typed(rows: DataFrame) -> DataFrame:
    """Documents as child records: the document type goes by source, the heading is the first line."""
    kind = F.when(F.col("source").isin("src0", "src1", "src2"), "scheme_guideline").when(F.col("source").isin("src3", "src4"), "rules").otherwise("act")
    heading = F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))
    out = rows.select("doc_id", "source", "text", kind.alias("document_type"), heading.alias("heading"), words("text").alias("word_count"))
    warnings = tags.text_warnings(F.col("text"), F.col("word_count"), F.lit(False), F.lit(True))
    table_ = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit(" | ")), F.array(F.lit("TABLE_REVIEW"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("warnings", F.concat(warnings, table_))


_W, _T = sql_words("text"), "coalesce(text, '')"
_TYPED = f"""
t AS (
  SELECT doc_id, source, {_T} AS text, {_W} AS word_count, string_split({_T}, chr(10))[1] AS heading,
    CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'scheme_guideline' WHEN source IN ('src3', 'src4') THEN 'rules' ELSE 'act' END AS document_type
  FROM documents
), w AS (
  SELECT *,
    CASE WHEN word_count < 20 THEN CASE WHEN {sql_matches('text', r'^\s*[0-9A-Z().\[\]-]+\s*$')} THEN 'INCOMPLETE_PROVISION'
      WHEN {sql_matches('text', r'[.;:]|omitted|XXX|means|shall', 'i')} THEN 'SHORT_COMPLETE_PROVISION' ELSE 'SHORT_CHUNK' END END AS short_code,
    word_count > 900 AS long,
    len(regexp_extract_all(text, '\\.{{3,}}\\s*[0-9]+')) >= 3 AND NOT {sql_matches('text', r'\b(?:form|signature|address|name)\b', 'i')} AS toc,
    len(regexp_extract_all(text, '(?i)gazette|downloaded from|www\\.')) > greatest(3.0, word_count / 15) AS dominated,
    contains(text, ' | ') AS tabular
  FROM t
), s AS (
  SELECT *, coalesce(short_code = 'INCOMPLETE_PROVISION', false) OR toc OR dominated AS blocked FROM w
), r AS (
  SELECT *, CASE WHEN word_count > 900 AND document_type IN ('scheme_guideline', 'rules') AND ({sql_matches('heading', 'annex|schedule|form', 'i')} OR tabular) THEN 'REFERENCE_ONLY'
    WHEN word_count > 900 AND NOT blocked THEN 'ACTIVE' WHEN blocked THEN 'REVIEW' ELSE 'ACTIVE' END AS retrieval_status
  FROM s
)
"""


def _statused(spark, sf_dir) -> DataFrame:
    rows = _typed(docs(spark, sf_dir))
    return rows.withColumn("retrieval_status", tags.retrieval_status(F.lit("child"), F.col("word_count"), F.col("document_type"), F.col("heading"), F.lit(True), F.lit("complete_provision"), F.col("warnings")))


@query(f"WITH {_TYPED} SELECT doc_id, document_type, retrieval_status, CAST(blocked AS INTEGER) AS blocking FROM r")
def retrieval_status(spark, sf_dir):
    rows = _statused(spark, sf_dir)
    return rows.select("doc_id", "document_type", "retrieval_status", F.least(F.size(tags.blocking(F.col("warnings"))), F.lit(1)).alias("blocking"))


@query(f"""
WITH {_TYPED} SELECT source, count(*) AS total_records, count(*) FILTER (retrieval_status = 'ACTIVE') AS active_records,
  count(*) FILTER (retrieval_status = 'REFERENCE_ONLY') AS reference_only_records, count(*) FILTER (retrieval_status = 'REVIEW') AS review_records
FROM r GROUP BY source
""")
def readiness_pivot(spark, sf_dir):
    return Q.readiness(_statused(spark, sf_dir), "source")


@query(f"""
WITH {_TYPED}, p AS (
  SELECT DISTINCT source, unnest(list_filter([short_code, CASE WHEN long THEN 'LONG_CHUNK_NO_SAFE_SPLIT' END, CASE WHEN toc THEN 'TOC_REVIEW' END,
    CASE WHEN dominated THEN 'HEADER_DOMINATED' END, CASE WHEN tabular THEN 'TABLE_REVIEW' END], lambda x: x IS NOT NULL)) AS w FROM r
)
SELECT source, string_agg(w, ';' ORDER BY w) AS warnings FROM p GROUP BY source
""")
def warning_union(spark, sf_dir):
    return Q.warning_union(_typed(docs(spark, sf_dir)), "source")


@query(f"""
WITH {_TYPED} SELECT doc_id, list_reduce(list_filter([CASE WHEN long THEN 'A_LONG' END, CASE WHEN word_count < 20 THEN 'B_SHORT' END, CASE WHEN tabular THEN 'F_TABLE' END],
  lambda x: x IS NOT NULL), lambda a, b: a || ';' || b) AS groups, left(text, 200) AS text_excerpt FROM r WHERE long OR word_count < 20 OR tabular
""")
def exception_lists(spark, sf_dir):
    rows = _typed(docs(spark, sf_dir))
    groups = F.array_compact(F.array(F.when(F.col("word_count") > 900, F.lit("A_LONG")), F.when(F.col("word_count") < 20, F.lit("B_SHORT")), F.when(F.array_contains("warnings", "TABLE_REVIEW"), F.lit("F_TABLE"))))
    return rows.where(F.size(groups) > 0).select("doc_id", F.array_join(groups, ";").alias("groups"), F.substring("text", 1, 200).alias("text_excerpt"))


@query("""
SELECT source, count(*) AS pages, count(*) FILTER (n >= 1000) AS usable, count(*) FILTER (n > 0 AND n < 1000) AS low,
  CASE WHEN count(*) FILTER (n >= 1000) * 100 >= count(*) * 80 THEN 'TEXT_BASED' WHEN count(*) FILTER (n >= 1000) * 100 >= count(*) * 20 THEN 'MIXED' ELSE 'LIKELY_SCANNED' END AS classification,
  CASE WHEN count(*) FILTER (n >= 1000) * 100 >= count(*) * 80 THEN 'NO' WHEN count(*) FILTER (n >= 1000) * 100 >= count(*) * 20 THEN 'PARTIAL' ELSE 'YES' END AS ocr_recommendation
FROM (SELECT source, length(coalesce(text, '')) AS n FROM documents) GROUP BY source
""")
def doc_class(spark, sf_dir):
    """Here a document is a page, usable from 1,000 characters on."""
    n = F.length(F.coalesce("text", F.lit("")))
    rows = docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(n >= 1000).alias("usable"), F.count_if((n > 0) & (n < 1000)).alias("low"))
    kind = tags.document_class(F.col("usable"), F.col("pages"))
    return rows.withColumn("classification", kind).withColumn("ocr_recommendation", tags.ocr_advice(kind))


@query("""
SELECT text_status, lang, count(*) AS documents, CAST(sum(n) AS BIGINT) AS characters FROM (
  SELECT lang, length(coalesce(text, '')) AS n, CASE WHEN length(trim(coalesce(text, ''))) >= 100 THEN 'USABLE_TEXT' WHEN length(trim(coalesce(text, ''))) > 0 THEN 'LOW_TEXT' ELSE 'EMPTY' END AS text_status FROM documents)
GROUP BY text_status, lang
""")
def page_text_status(spark, sf_dir):
    rows = docs(spark, sf_dir).select("lang", F.length(F.coalesce("text", F.lit(""))).alias("n"), tags.page_status(F.col("text")).alias("text_status"))
    return rows.groupBy("text_status", "lang").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("characters"))


@query("""
SELECT s.s_suppkey, n.n_name, r.r_name, (n.n_nationkey IS NOT NULL AND length(n.n_name) > 0) AS metadata_ok
FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def dimension_lookup(spark, sf_dir):
    """Facts take their dimension's columns; unknown keys are told."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    region = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left").join(region, "n_regionkey", "left")
    return rows.select("s_suppkey", "n_name", "r_name", (F.col("n_name").isNotNull() & (F.length("n_name") > 0)).alias("metadata_ok"))


@query("SELECT d.doc_id, d.lang, d.n_chars IS NOT DISTINCT FROM length(d.text) AND d.source IS NOT DISTINCT FROM 'src' || regexp_extract(d.source, '([0-9]+)$', 1) AS metadata_ok FROM documents d")
def metadata_mismatch(spark, sf_dir):
    rows = docs(spark, sf_dir)
    dim = rows.select("source").distinct().withColumn("title", F.concat(F.lit("src"), F.regexp_extract("source", r"([0-9]+)$", 1)))
    checked = Q.metadata_mismatch(rows.withColumn("title", F.col("source")), dim, "source", ["title"])
    return checked.select("doc_id", "lang", (F.col("metadata_ok") & F.col("n_chars").eqNullSafe(F.length("text").cast("long"))).alias("metadata_ok"))


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 25)")
def orphan_children(spark, sf_dir):
    """Orders none of whose lines has a quantity over 25."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return Q.orphans(table(spark, sf_dir, "orders"), lines, "o_orderkey", "l_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, min(l_shipdate) AS range_start, max(l_shipdate) AS range_end, count(*) AS children FROM lineitem GROUP BY l_orderkey")
def parent_ranges(spark, sf_dir):
    return Q.child_ranges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate", "l_shipdate")


_NODES = """
n AS (
  SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, n_nationkey AS s, n_nationkey AS e FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'world', r_regionkey + 100, r_regionkey + 100 FROM region
  UNION ALL SELECT 'world', NULL, 1000, 1000
), c AS (SELECT node, node AS top FROM n UNION ALL SELECT c.node, n.parent FROM c JOIN n ON c.top = n.node WHERE n.parent IS NOT NULL)
"""


@query(f"WITH RECURSIVE {_NODES} SELECT c.top AS node, min(n.s) AS range_start, max(n.e) AS range_end FROM c JOIN n ON c.node = n.node GROUP BY c.top")
def hierarchy_ranges(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").alias("start"), F.col("n_nationkey").alias("end"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"), (F.col("r_regionkey") + 100).alias("start"), (F.col("r_regionkey") + 100).alias("end"))
    world = spark.range(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(1000).alias("start"), F.lit(1000).alias("end"))
    return Q.descendant_ranges(nation.unionByName(region).unionByName(world))


@query("""
SELECT event_type, arg_min(event_id, CASE WHEN value > 50 THEN event_id ELSE 1000000000000 + event_id END) AS sample FROM events GROUP BY event_type
""")
def first_samples(spark, sf_dir):
    """Of each event type the first event with a value over 50, else the first."""
    return Q.first_samples(table(spark, sf_dir, "events"), "event_type", F.coalesce(F.col("value") > 50, F.lit(False)), "event_id", F.col("event_id"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, previous FROM (
  SELECT *, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS previous FROM lineitem) WHERE l_partkey < previous
""")
def numbering_breaks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return Q.number_breaks(rows, ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_partkey")


@query(r"""
WITH b AS (SELECT doc_id, source, upper(trim(regexp_replace(source || ' ' || left(coalesce(text, ''), 3), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS base FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN base ELSE base || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END END AS unique_id
FROM (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY doc_id) AS n FROM b)
""")
def id_suffix(spark, sf_dir):
    base = slug(F.concat_ws(" ", "source", F.substring(F.coalesce("text", F.lit("")), 1, 3)))
    return Q.suffixed_ids(docs(spark, sf_dir).select("doc_id", "source", "text"), "source", base, "doc_id").select("doc_id", "unique_id")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def iso_dates(spark, sf_dir):
    """Order dates written in two formats and read again."""
    day = F.to_date("o_orderdate")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd-MM-yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", iso_date(written).alias("day"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_hash, length(coalesce(text, '')) AS char_count, " + sql_words("text") + " AS word_count, sha256(" + sql_norm("text") + ") AS norm_hash FROM documents")
def content_hashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", content_hash("text").alias("text_hash"), F.length(F.coalesce("text", F.lit(""))).alias("char_count"), words("text").alias("word_count"), content_hash(norm("text")).alias("norm_hash"))


@query("SELECT o_orderkey, count(*) AS times FROM (SELECT o_custkey AS o_orderkey FROM orders) GROUP BY o_orderkey HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Customers of more than one order."""
    return Q.duplicate_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("o_orderkey")), "o_orderkey")


@query("""
SELECT p_brand, count(*) AS parts, count(DISTINCT p_type) AS types, round(avg(p_retailprice), 2) AS mean_price, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS median_size FROM part GROUP BY p_brand
""")
def group_profile(spark, sf_dir):
    """Counts, distinct counts, means and exact medians by group."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("parts"), F.count_distinct("p_type").alias("types"), F.round(F.avg("p_retailprice"), 2).alias("mean_price"), F.median("p_size").alias("median_size"))


@query("""
SELECT c.c_mktsegment, n.n_name, count(DISTINCT o.o_orderkey) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY c.c_mktsegment, n.n_name
""")
def parent_child_rollup(spark, sf_dir):
    """Children aggregated on their parent first, so that the parent join moves one row an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(lines, "l_orderkey")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey", "c_mktsegment", "n_name")
    return orders.join(customers, "c_custkey").groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("revenue"), 0).alias("revenue"))

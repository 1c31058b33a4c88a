"""Queries on lines: repeated lines, contents-like texts, scripts, reflow, segments and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions.text import content_hash, filled, fold, norm, words
from lexiquarry.operators import layout, structure
from lexiquarry.plans.common import registry, sql_matches, sql_norm, sql_shown, sql_words, table
from lexiquarry.sources.tables import html_lines as shown_lines

QUERIES, ORACLE_SQL, query = registry()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources of one page each; their lines with the columns of a layout."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "source", F.posexplode_outer(F.split(filled("text"), "\n")).alias("line_no", "text"))
    return rows.select("source_id", "source", F.lit(1).alias("page"), "line_no", "text", F.lit(0).alias("block"), F.contains("text", F.lit(" | ")).alias("table"))


_LINES = """
l AS (SELECT doc_id AS source_id, source, i - 1 AS line_no, string_split(coalesce(text, ''), chr(10))[i] AS text
      FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents))
"""
_N = sql_norm("text")


@query(f"""
WITH {_LINES}, n AS (SELECT source, source_id, replace(lower({_N}), 'ß', 'ss') AS running FROM l)
SELECT source, running, count(DISTINCT source_id) AS documents FROM n WHERE running <> '' AND length(running) <= 170
GROUP BY source, running HAVING count(DISTINCT source_id) >= 3
""")
def repeated_lines(spark, sf_dir):
    """Lines of at least three documents of a source."""
    rows = lines(spark, sf_dir).select("source", "source_id", fold(norm("text")).alias("running")).where((F.col("running") != "") & (F.length("running") <= 170))
    return rows.groupBy("source", "running").agg(F.count_distinct("source_id").alias("documents")).where("documents >= 3")


@query(f"""
WITH {_LINES}, n AS (SELECT *, replace(lower({_N}), 'ß', 'ss') AS running FROM l),
 r AS (SELECT source, running FROM n WHERE running <> '' AND length(running) <= 170 GROUP BY source, running HAVING count(DISTINCT source_id) >= 3)
SELECT n.source_id, count(*) AS kept_lines, CAST(sum(length(n.text)) AS BIGINT) AS kept_chars
FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = n.source AND r.running = n.running) GROUP BY n.source_id
""")
def strip_repeated(spark, sf_dir):
    """Documents without the lines that repeat in their source."""
    rows = lines(spark, sf_dir).withColumn("running", fold(norm("text")))
    left = rows.join(repeated_lines(spark, sf_dir).select("source", "running"), ["source", "running"], "left_anti")
    return left.groupBy("source_id").agg(F.count("*").alias("kept_lines"), F.sum(F.length("text")).cast("long").alias("kept_chars"))


@query(f"""
WITH {_LINES} SELECT source_id, bool_or({sql_matches('text', layout.TOC_TITLE.replace('(?i)', ''), 'i')}) AS toc_title,
  count(*) FILTER ({sql_matches('text', r'[.]{3,}\s*[0-9]+\s*$')}) AS leaders, count(*) FILTER ({sql_matches('text', layout.PROVISION)}) AS numbered,
  count(*) FILTER ({sql_words('text')} >= 16) AS long_lines, round(count(*) FILTER ({sql_words('text')} <= 12) / greatest(count(*), 1), 9) AS short_ratio
FROM l GROUP BY source_id
""")
def toc_like_docs(spark, sf_dir):
    return layout.page_shape(lines(spark, sf_dir)).drop("page").withColumn("short_ratio", F.round("short_ratio", 9))


_LATIN, _LEGACY = "[A-Za-z\\x{00AA}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]", "[\\x{00A1}-\\x{00FF}]"


@query(f"""
WITH c AS (
  SELECT source, CAST(sum(length(regexp_replace(t, '[^A-Za-z\\x{{00AA}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}]', '', 'g'))) AS BIGINT) AS latin,
    CAST(sum(length(regexp_replace(t, '[^\\x{{0904}}-\\x{{0939}}\\x{{0958}}-\\x{{0961}}\\x{{0972}}-\\x{{097F}}]', '', 'g'))) AS BIGINT) AS devanagari,
    CAST(sum(length(regexp_replace(t, '[^\\x{{0C85}}-\\x{{0CB9}}\\x{{0CDE}}-\\x{{0CE1}}]', '', 'g'))) AS BIGINT) AS kannada,
    CAST(sum(length(regexp_replace(t, '[^\\x{{00A1}}-\\x{{00FF}}]', '', 'g'))) AS BIGINT) AS legacy,
    CAST(sum(length(t)) AS BIGINT) AS characters, count(*) FILTER (contains(t, chr(65533)) OR regexp_matches(t, '\\(cid:[0-9]+\\)')) AS damaged
  FROM (SELECT source, coalesce(text, '') AS t FROM documents) GROUP BY source
)
SELECT *, latin > 200 AND (devanagari > 100 OR kannada > 100) AS bilingual, legacy > greatest(100.0, characters * 0.03) AS legacy_font FROM c
""")
def script_profile(spark, sf_dir):
    return layout.script_profile(table(spark, sf_dir, "documents"), "source")


@query(f"""
WITH {_LINES}, t AS (SELECT source_id, line_no, {_N} AS t, contains(text, ' | ') AS tab FROM l), u AS (SELECT * FROM t WHERE t <> ''),
w AS (SELECT *, lag(t) OVER o AS pt, lag(tab) OVER o AS ptab FROM u WINDOW o AS (PARTITION BY source_id ORDER BY line_no)),
s AS (SELECT *, CASE WHEN pt IS NULL THEN '' WHEN tab OR ptab OR {sql_matches('t', layout.SUB)} OR {sql_matches('t', layout.QUALIFIER.replace('(?i)', ''), 'i')} THEN chr(10) || chr(10)
   WHEN (regexp_matches(pt, '[A-Za-z]-$') AND regexp_matches(t, '^[a-z]')) OR (ends_with(pt, chr(173)) AND regexp_matches(t, '^[a-z]')) THEN '' ELSE ' ' END AS sep FROM w),
v AS (SELECT *, lead(sep) OVER (PARTITION BY source_id ORDER BY line_no) AS nsep, lead(t) OVER (PARTITION BY source_id ORDER BY line_no) AS nt FROM s)
SELECT source_id, sha256(string_agg(sep || CASE WHEN nsep = '' AND (ends_with(t, chr(173)) OR (regexp_matches(t, '\\bco-$') AND regexp_matches(nt, '^operative\\b'))) THEN left(t, length(t) - 1) ELSE t END, '' ORDER BY line_no)) AS text_hash,
  CAST(count(*) FILTER (sep = chr(10) || chr(10)) + 1 AS BIGINT) AS paragraphs
FROM v GROUP BY source_id
""")
def reflow_text(spark, sf_dir):
    """Lines of a document joined to paragraphs again."""
    whole = layout.reflow(lines(spark, sf_dir), ["source_id"])
    return whole.select("source_id", content_hash("text").alias("text_hash"), F.size(F.split("text", "\n\n")).cast("long").alias("paragraphs"))


_UNITS = f"""
{_LINES}, b AS (SELECT *, {sql_words('text')} AS w FROM l),
u AS (SELECT *, sum(CASE WHEN w BETWEEN 1 AND 12 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY line_no) AS unit_no FROM b),
g AS (SELECT source_id, CAST(unit_no AS BIGINT) AS unit_no, count(*) AS lines, CAST(sum(w) AS BIGINT) AS words FROM u GROUP BY source_id, unit_no)
"""


def _units(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    rows = lines(spark, sf_dir).withColumn("w", words("text"))
    opens = F.when(F.col("w").between(1, 12), 1).otherwise(0)
    rows = rows.withColumn("unit_no", F.sum(opens).over(W.partitionBy("source_id").orderBy("line_no")))
    return rows.groupBy("source_id", "unit_no").agg(F.count("*").alias("lines"), F.sum("w").cast("long").alias("words"))


@query(f"WITH {_UNITS} SELECT * FROM g")
def segment_units(spark, sf_dir):
    """Units that begin at each line of at most twelve words."""
    return _units(spark, sf_dir)


@query(f"""
WITH {_UNITS}, k AS (SELECT *, CASE WHEN words >= 40 THEN unit_no END AS own FROM g),
t AS (SELECT *, coalesce(first_value(own IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY unit_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(own IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), unit_no) AS target FROM k)
SELECT source_id, target, count(*) AS units, CAST(sum(words) AS BIGINT) AS words FROM t GROUP BY source_id, target
""")
def forward_merge(spark, sf_dir):
    """Units under 40 words go to the next larger one."""
    units = _units(spark, sf_dir)
    moved = structure.forward_merged(units, F.col("words") < 40)
    return units.join(moved, ["source_id", "unit_no"]).groupBy("source_id", "target").agg(F.count("*").alias("units"), F.sum("words").cast("long").alias("words"))


@query(f"""
WITH s AS (SELECT page_id, list_filter(list_transform(string_split({sql_shown('html')}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, len(parts) AS lines, sha256(array_to_string(parts, chr(10))) AS text_hash FROM s WHERE len(parts) > 0
""")
def page_lines(spark, sf_dir):
    """What web pages show, as lines."""
    rows = shown_lines(table(spark, sf_dir, "pages"), "page_id")
    whole = rows.groupBy("page_id").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return whole.select("page_id", "lines", content_hash(F.array_join(F.col("l.text"), "\n")).alias("text_hash"))


@query("""
WITH t AS (SELECT doc_id, list_sort(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) AS a,
  list_sort(list_filter(string_split_regex(replace(coalesce(text, ''), ' | ', ' '), '\\s+'), lambda w: w <> '')) AS b FROM documents)
SELECT doc_id, a = b AS same FROM t
""")
def same_tokens(spark, sf_dir):
    """Whether a text without its cell borders has the same words as often."""
    t = filled("text")
    return table(spark, sf_dir, "documents").select("doc_id", layout.same_tokens(t, F.replace(t, F.lit(" | "), F.lit(" "))).alias("same"))

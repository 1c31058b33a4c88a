"""Queries of layout and structure on pages, spans and units that they make from keys, so that every case occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions.text import content_hash, words
from lexiquarry.operators import chunking, extraction, layout, structure
from lexiquarry.plans.common import dealt, registry, sampled, sql_literal, sql_matches, sql_rows, sql_sampled, sql_words, table

QUERIES, ORACLE_SQL, query = registry()


def parts(spark: SparkSession, sf_dir: str, sources: int, per_page: int) -> DataFrame:
    """Parts as lines: ``source_id, page, line_no, k``, so many a page."""
    at = F.floor(F.col("p_partkey") / sources)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("B"), (F.col("p_partkey") % sources).cast("string")).alias("source_id"), (F.floor(at / per_page) + 1).cast("int").alias("page"), (at % per_page).cast("int").alias("line_no"), (at % per_page).cast("int").alias("k"), "p_partkey", "p_size",
    )


def _parts(sources: int, per_page: int) -> str:
    at = f"(p_partkey // {sources})"
    return f"(SELECT 'B' || (p_partkey % {sources}) AS source_id, CAST({at} // {per_page} + 1 AS INTEGER) AS page, CAST({at} % {per_page} AS INTEGER) AS k, p_partkey, p_size FROM part)"


HEADERS = ("Gazette of India", "The Title of B1", "Some Chapter", "Gazette no. ", "gazette  OF India", "Government of Goa")


@query(f"""
WITH l AS (SELECT *, CASE WHEN k = 0 THEN ({sql_literal(list(HEADERS))})[CAST(substr(source_id, 2) AS INTEGER) + 1] || CASE source_id WHEN 'B3' THEN CAST(page AS VARCHAR) ELSE '' END WHEN k = 7 THEN 'Page - ' || page || ' -' ELSE 'body ' || p_partkey END AS text,
  CASE WHEN k = 7 AND page % 2 = 0 THEN 50.0 ELSE 300.0 END AS x0, 10.0 + 100 * k AS y0 FROM {_parts(6, 8)}),
n AS (SELECT source_id, max(page) * CASE source_id WHEN 'B0' THEN 5 ELSE 1 END AS pages FROM l GROUP BY source_id),
m AS (SELECT *, y0 + 20 < 80 OR y0 > 720 AS margin, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS running FROM l),
o AS (SELECT m.source_id, running FROM m JOIN n USING (source_id) WHERE margin GROUP BY m.source_id, running, pages HAVING count(DISTINCT page) >= greatest(3, pages * 0.3) AND length(running) <= 170 AND (running = 'the title of b1' OR {sql_matches('running', L.FURNITURE)}))
SELECT source_id, page, text FROM m WHERE NOT (margin AND regexp_matches(text, '^(page\\s*)?[-–—]?\\s*[0-9]{{1,4}}\\s*[-–—]?$', 'i') AND x0 > 180) AND NOT (margin AND EXISTS (SELECT 1 FROM o WHERE o.source_id = m.source_id AND o.running = m.running))
""")
def margin_lines(spark, sf_dir):
    """Lines without page numbers and running headers: known ones, titles, others, ones that change, and one book with many empty pages."""
    header = F.element_at(F.array(*[F.lit(h) for h in HEADERS]), F.substring("source_id", 2, 9).cast("int") + 1)
    text = F.when(F.col("k") == 0, F.concat(header, F.when(F.col("source_id") == "B3", F.col("page").cast("string")).otherwise(""))).when(F.col("k") == 7, F.concat(F.lit("Page - "), F.col("page").cast("string"), F.lit(" -"))).otherwise(F.concat(F.lit("body "), F.col("p_partkey").cast("string")))
    x0 = F.when((F.col("k") == 7) & (F.col("page") % 2 == 0), 50.0).otherwise(300.0)
    lines = parts(spark, sf_dir, 6, 8).withColumns({"text": text, "x0": x0, "y0": 10.0 + 100 * F.col("k"), "y1": 30.0 + 100 * F.col("k")})
    top = lines.groupBy("source_id").agg((F.max("page") * F.when(F.col("source_id") == "B0", 5).otherwise(1)).alias("n"))
    pages = top.select("source_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"), F.lit(800.0).alias("height"), F.lit(600.0).alias("width"))
    titles = top.select("source_id", F.concat(F.lit("The Title of "), "source_id").alias("title"))
    return layout.without_margins(lines, pages, titles).select("source_id", "page", "text")


_WORDS = " ".join(["word"] * 17)
_TOC_TEXT = f"""CASE page % 6 WHEN 1 THEN CASE k WHEN 0 THEN 'Table of Contents' ELSE k || '. Title of ' || k END WHEN 2 THEN k || '. More titles' WHEN 3 THEN 'Rules of all ....... ' || k
  WHEN 4 THEN '{_WORDS}' WHEN 5 THEN CASE k WHEN 0 THEN 'INDEX' ELSE '{_WORDS}' END ELSE k || '. A provision of its own' END"""


@query(f"""
WITH RECURSIVE l AS (SELECT *, {_TOC_TEXT} AS text FROM {_parts(4, 8)}),
s AS (SELECT source_id, page, bool_or(regexp_matches(text, '^((table of )?contents|index|arrangement of (sections|rules))$', 'i')) AS title, count(*) FILTER (regexp_matches(text, '[.]{{3,}}\\s*[0-9]+\\s*$')) AS leaders,
  count(*) FILTER ({sql_matches('text', layout.PROVISION)}) AS numbered, count(*) FILTER ({sql_words('text')} >= 16) AS long_lines, count(*) FILTER ({sql_words('text')} <= 12) / greatest(count(*), 1) AS ratio FROM l GROUP BY source_id, page),
c AS (SELECT source_id, page, false AS toc, false AS inside, false AS title FROM (SELECT source_id, 0 AS page FROM s GROUP BY source_id)
  UNION ALL SELECT source_id, page, toc, toc OR (title AND ratio > 0.85), title FROM (SELECT s.*, ((s.title OR c.inside) AND ratio > 0.65 AND numbered >= 4 AND long_lines <= 5) OR (leaders >= 5 AND ratio > 0.8 AND long_lines <= 3) AS toc FROM c JOIN s ON s.source_id = c.source_id AND s.page = c.page + 1))
SELECT source_id, page, toc AS is_toc, title AND NOT toc AS review FROM c WHERE page > 0
""")
def contents_pages(spark, sf_dir):
    """Contents pages: with a title, going on without one, with leaders; and titles over other text."""
    k, n = F.col("k"), F.col("page") % 6
    text = (
        F.when(n == 1, F.when(k == 0, "Table of Contents").otherwise(F.format_string("%d. Title of %d", k, k))).when(n == 2, F.format_string("%d. More titles", k)).when(n == 3, F.format_string("Rules of all ....... %d", k))
        .when(n == 4, _WORDS).when(n == 5, F.when(k == 0, "INDEX").otherwise(_WORDS)).otherwise(F.format_string("%d. A provision of its own", k))
    )
    return layout.contents_pages(parts(spark, sf_dir, 4, 8).withColumn("text", text))


_SPAN = "CASE k WHEN 0 THEN 'IV.' WHEN 1 THEN 'Fees' WHEN 2 THEN 'of members' WHEN 3 THEN '[12]' WHEN 4 THEN 'right' ELSE 'next' END"
_X0 = "CASE k WHEN 0 THEN 50.0 WHEN 1 THEN 70.0 + p_size % 3 * 20 WHEN 2 THEN 140.0 WHEN 3 THEN 50.0 WHEN 4 THEN 95.0 + p_size % 2 ELSE 50.0 END"


@query(f"""
WITH RECURSIVE s AS (SELECT *, {_SPAN} AS text, {_X0} AS x0, CASE WHEN k < 3 THEN 100.0 + p_size % 2 * 0.01 WHEN k < 5 THEN 130.0 ELSE 160.0 END AS y0, k = 1 OR (k = 2 AND p_size % 2 = 0) OR k = 4 AS bold FROM {_parts(2, 6)}),
b AS (SELECT *, x0 + 30 AS x1, y0 + 10 + CASE k WHEN 2 THEN p_size % 4 ELSE 0 END AS y1 FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY source_id, page ORDER BY round(y0, 1), x0) AS n FROM b),
m AS (SELECT source_id, page, n, 1 AS line, text, x0, y0, x1, y1, bold FROM o WHERE n = 1 UNION ALL
  SELECT source_id, page, n, CASE WHEN joins THEN line ELSE line + 1 END, CASE WHEN joins THEN old || ' ' || text ELSE text END, CASE WHEN joins THEN old_x0 ELSE x0 END, CASE WHEN joins THEN least(old_y0, y0) ELSE y0 END, x1, CASE WHEN joins THEN greatest(old_y1, y1) ELSE y1 END, CASE WHEN joins THEN old_bold OR bold ELSE bold END
  FROM (SELECT o.*, m.line, m.text AS old, m.x0 AS old_x0, m.y0 AS old_y0, m.y1 AS old_y1, m.bold AS old_bold, abs(m.y1 - o.y1) < 2 AND o.x0 - m.x1 >= 0 AND o.x0 - m.x1 < 36 AND (regexp_full_match(m.text, '[0-9A-Z.\\[\\]-]+') OR m.bold = o.bold) AS joins FROM m JOIN o ON o.source_id = m.source_id AND o.page = m.page AND o.n = m.n + 1))
SELECT source_id, page, text, CAST(x0 AS DOUBLE) AS x0, CAST(round(y0, 2) AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(round(y1, 2) AS DOUBLE) AS y1, bold FROM (SELECT *, row_number() OVER (PARTITION BY source_id, page, line ORDER BY n DESC) AS last FROM m) WHERE last = 1
""")
def merged_spans(spark, sf_dir):
    """Spans on one baseline as one line: after lone numbers, alike in weight, too far apart, or on other baselines."""
    k, n = F.col("k"), F.col("p_size")
    text = F.element_at(F.array(*[F.lit(x) for x in ("IV.", "Fees", "of members", "[12]", "right", "next")]), k + 1)
    x0 = F.when(k == 1, 70.0 + n % 3 * 20).when(k == 2, 140.0).when(k == 4, 95.0 + n % 2).otherwise(50.0)
    y0 = F.when(k < 3, 100.0 + n % 2 * 0.01).when(k < 5, 130.0).otherwise(160.0)
    bold = (k == 1) | ((k == 2) & (n % 2 == 0)) | (k == 4)
    spans = parts(spark, sf_dir, 2, 6).select("source_id", "page", "k", text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 10 + F.when(k == 2, n % 4).otherwise(0)).alias("y1"), bold.alias("bold"))
    return layout.merged_spans(spans).select("source_id", "page", "text", "x0", F.round("y0", 2).alias("y0"), "x1", F.round("y1", 2).alias("y1"), "bold")


@query("""
WITH c AS (SELECT n_nationkey AS page, n_nationkey % 5 AS kind FROM nation)
SELECT page, text, review FROM c, LATERAL (SELECT unnest(CASE kind WHEN 0 THEN ['Crop | Rate (in %)' || chr(10) || 'Rice | 2 of 100', 'below'] WHEN 2 THEN ['Crop | ' || chr(10) || 'Rice | 2', 'below'] ELSE ['Crop', CASE kind WHEN 2 THEN '' ELSE 'Rate (in %)' END, 'Rice', '2 of 100', 'below'] END) AS text) x,
  LATERAL (SELECT CASE WHEN text = 'below' THEN false WHEN kind = 0 THEN false WHEN kind = 2 THEN true WHEN kind IN (1, 3) THEN true ELSE false END AS review) y
""")
def ruled_tables(spark, sf_dir):
    """Ruled tables as rows of cells: the same words, other words, a missing cell, words in another number, and too few rows."""
    kind = F.col("page") % 5
    pages = table(spark, sf_dir, "nation").select(F.lit("S").alias("source_id"), F.col("n_nationkey").alias("page"))
    spots = F.explode(F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(t).alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0")) for n, (t, x, y) in enumerate((("Crop", 10, 10), ("Rate (in %)", 60, 10), ("Rice", 10, 30), ("2 of 100", 60, 30), ("below", 10, 90)))]))
    lines = pages.withColumn("s", spots).select("source_id", "page", "s.*", (F.col("s.x0") + 40).alias("x1"), (F.col("s.y0") + 10).alias("y1"), F.lit(False).alias("table"))
    lines = lines.where(~((kind == 2) & (F.col("line_no") == 1))).withColumn("text", F.when((kind == 2) & (F.col("line_no") == 3), "2").otherwise(F.col("text")))
    cell = lambda *rows: F.array(*[F.array(*[F.lit(c).cast("string") for c in r]) for r in rows])
    cells = F.when(kind == 0, cell(("Crop", "Rate  (in %)"), ("Rice", "2 of 100"))).when(kind == 1, cell(("Crop", "Rate (in %)"), ("Wheat", "2 of 100"))).when(kind == 2, cell(("Crop", None), ("Rice", "2"))).when(kind == 3, cell(("Crop Crop", "Rate (in %)"), ("Rice", "2 of 100"))).otherwise(cell(("Crop", "Rate")))
    made = pages.select("source_id", "page", F.lit(1).alias("table_no"), *[F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 200), ("y1", 50))], F.lit(2).alias("columns"), cells.alias("cells"))
    return layout.grid_tables(lines, made).select("page", "text", "review")


@query(f"""
WITH l AS (SELECT *, 60.0 * (k % 3) + CASE WHEN page % 3 = 1 THEN k * 30.0 ELSE 0.0 END AS x0, 108.0 + 20 * (k // 3) AS y1, CASE WHEN page % 4 = 2 AND k % 3 = 0 THEN '{" ".join(["w"] * 13)}' ELSE 'cell of ' || k END AS text FROM {_parts(3, 12)}),
r AS (SELECT source_id, page, round_even(y1 / 4, 0) AS band FROM l GROUP BY source_id, page, round_even(y1 / 4, 0) HAVING count(*) >= 3 AND max({sql_words('text')}) <= 12),
b AS (SELECT source_id, page, count(*) AS bands FROM r GROUP BY source_id, page),
c AS (SELECT source_id, page, count(*) AS columns FROM (SELECT source_id, page, round_even(x0 / 12, 0) AS col FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.source_id = l.source_id AND r.page = l.page AND r.band = round_even(l.y1 / 4, 0)) GROUP BY source_id, page, round_even(x0 / 12, 0) HAVING count(*) >= 3) GROUP BY source_id, page)
SELECT source_id, page, bands, columns FROM b JOIN c USING (source_id, page) WHERE bands >= 3 AND columns >= 3
""")
def table_bands(spark, sf_dir):
    """Pages of three columns without rules, among pages without columns or with long lines."""
    k, n = F.col("k"), F.col("page")
    text = F.when((n % 4 == 2) & (k % 3 == 0), " ".join(["w"] * 13)).otherwise(F.format_string("cell of %d", k))
    rows = parts(spark, sf_dir, 3, 12).withColumns({"x0": 60.0 * (k % 3) + F.when(n % 3 == 1, k * 30.0).otherwise(0.0), "y1": 108.0 + 20 * F.floor(k / 3), "text": text})
    return layout.table_bands(rows).select("source_id", "page", "bands", "columns")


@query(f"""
WITH l AS (SELECT *, 8 + p_size % 5 * 0.5 AS size, CASE WHEN p_partkey % 4 = 3 OR source_id = 'B3' THEN 'short line' ELSE 'seven words are in this line now' END AS text FROM {_parts(4, 8)}),
g AS (SELECT source_id, size, count(*) AS n, min(page * 1000 + k) AS seen_at FROM l WHERE {sql_words('text')} > 6 GROUP BY source_id, size), f AS (SELECT source_id, size, row_number() OVER (PARTITION BY source_id ORDER BY n DESC, seen_at) AS place FROM g)
SELECT s.source_id, coalesce(CAST(f.size AS DOUBLE), 10.0) AS body_size FROM (SELECT DISTINCT source_id FROM l) s LEFT JOIN f ON f.source_id = s.source_id AND place = 1
""")
def body_sizes(spark, sf_dir):
    """The most common size of longer lines; a book without any has the usual one."""
    short = (F.col("p_partkey") % 4 == 3) | (F.col("source_id") == "B3")
    return layout.body_size(parts(spark, sf_dir, 4, 8).withColumns({"size": 8 + F.col("p_size") % 5 * 0.5, "text": F.when(short, "short line").otherwise("seven words are in this line now")}))


HEADINGS = ("Short title.— This Act may", "Membership", "Fees – to be paid", "Powers. (1) The board", " .—- ", "Duties.- of all", "x " * 36, "y" * 251, "Name. It is", "—", "Board—of—directors")


@query(f"""
WITH h AS (SELECT c_custkey, trim(string_split_regex(text, '[.—–]\\s*[-—–]|[—–]|\\.\\s*\\(1\\)')[1], ' .-—–') AS head FROM {sql_sampled('customer', 'c_custkey', HEADINGS)})
SELECT c_custkey, CASE WHEN head <> '' AND {sql_words('head')} <= 35 AND length(head) <= 250 THEN head END AS heading FROM h
""")
def heading_texts(spark, sf_dir):
    return sampled(table(spark, sf_dir, "customer"), "c_custkey", HEADINGS).select("c_custkey", structure.heading_text(F.col("text")).alias("heading"))


#: Lines that stand alone in a source, and the boundary that each is.
BOUNDARIES = (
    ("12. Short title.— This Act", False, "act", "section", "12", "Short title"), ("12. some body text goes on", False, "act", None, None, None), ("12. Membership", True, "rules", "rule", "12", "Membership"),
    ("4. Objects.— To serve", False, "model_byelaws", "clause", "4", "Objects"), ("CHAPTER IV", False, "act", "chapter", "IV", "CHAPTER IV"), ("Part 2", False, "rules", "part", "2", "Part 2"), ("FORM VI", True, "rules", "form", "VI", "FORM VI"),
    ("Form VI shall be sent", False, "rules", None, None, None), ("FIRST SCHEDULE", False, "act", "schedule", "", "FIRST SCHEDULE"), ("ANNEXURE A-1", False, "rules", "annexure", "A-1", "ANNEXURE A-1"), ("2.1 Coverage", True, "scheme_guideline", "heading", "2.1", "Coverage"),
    ("2.1 Coverage goes on", False, "act", None, None, None), ("3 Scope", True, "scheme_guideline", "heading", "3", "Scope"), ("5. In the said rules, the words", False, "amendment_rules", "item", "5", "In the said rules, the words"), ("5. Rights of members", False, "amendment", None, None, None),
    ("Statement of Objects and Reasons", False, "act", "background", "", "Statement of Objects and Reasons"), ("MINISTRY OF COOPERATION", False, "amendment", "background", "ENGLISH_NOTICE", "MINISTRY OF COOPERATION"), ("Who can complain:", False, "grievance_guidance", "heading", "", "Who can complain"),
    ("5. (1) Every member", True, "act", "section", "5", None), ("Section 7: Meetings", True, "act", "section", "7", "Meetings"), ("प्ररूप IV", False, "rules", "form", "IV", "प्ररूप IV"), ("plain words here", False, "act", None, None, None), ("9. Claims process", True, "scheme_guideline", "heading", "9", "Claims process"),
)


@query("WITH b AS " + sql_rows("n, kind, identifier, heading", [(k, *b[3:]) for k, b in enumerate(BOUNDARIES)]) + f" SELECT c_custkey, kind, identifier, heading FROM customer JOIN b ON b.n = c_custkey % {len(BOUNDARIES)}")
def line_boundaries(spark, sf_dir):
    """What lines begin that stand alone in their source, by form, weight and kind of document."""
    case = F.element_at(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(b).alias("bold"), F.lit(d).alias("document_type")) for t, b, d, *_ in BOUNDARIES]), (F.col("c_custkey") % len(BOUNDARIES) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").withColumn("b", case)
    lines = rows.select(F.col("c_custkey").cast("string").alias("source_id"), "b.*", F.lit(1.0).alias("seq"), F.lit(1).alias("page"), F.lit(0).alias("block"), F.lit(False).alias("table"), F.lit(10.0).alias("size"), F.lit(10.0).alias("body_size"))
    return structure.classified(lines).select(F.col("source_id").cast("long").alias("c_custkey"), *[F.col("boundary")[c].alias(c) for c in ("kind", "identifier", "heading")])


KINDS = ("part", "chapter", "section", "section", "rule", "form", "background", "clause")
_BOOK = f"""
b AS (SELECT o_custkey % 20 AS source_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN ({sql_literal(list(KINDS))})[CAST(o_orderkey // 3 % {len(KINDS)} AS INTEGER) + 1] END AS kind, CAST(o_orderkey * 7 % 90 AS VARCHAR) AS identifier, 'Line ' || o_orderkey AS text FROM orders)
"""


def _book(spark, sf_dir) -> DataFrame:
    """Orders as lines of twenty books with given boundaries."""
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.floor(key / 3) % len(KINDS) + 1).cast("int")))
    text = F.concat(F.lit("Line "), key.cast("string"))
    boundary = F.when(kind.isNotNull(), F.struct(kind.alias("kind"), (key * 7 % 90).cast("string").alias("identifier"), text.alias("heading")))
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("source_id"), key.alias("seq"), text.alias("text"), boundary.alias("boundary"))


@query(f"""
WITH {_BOOK}, u AS (SELECT *, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER w AS unit_no, sum(CASE WHEN kind = 'part' THEN 1 ELSE 0 END) OVER w AS part_no, last_value(CASE WHEN kind = 'part' THEN text END IGNORE NULLS) OVER w AS part FROM b WINDOW w AS (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, last_value(CASE WHEN kind = 'chapter' THEN text END IGNORE NULLS) OVER (PARTITION BY source_id, part_no ORDER BY seq ROWS UNBOUNDED PRECEDING) AS chapter, last_value(kind IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k,
  last_value(CASE WHEN kind IS NOT NULL THEN identifier END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS i, CASE WHEN kind IN ('section', 'rule', 'clause') THEN CAST(identifier AS INTEGER) END AS number FROM u),
m AS (SELECT *, number < lag(number) OVER (PARTITION BY source_id, kind ORDER BY seq) AS falls FROM c)
SELECT source_id, seq, CAST(unit_no AS BIGINT) AS unit_no, CASE WHEN k IS NULL OR k IN ('part', 'chapter') THEN 'context' ELSE k END AS kind, CASE WHEN k IN ('part', 'chapter') THEN '' ELSE coalesce(i, '') END AS identifier, part, chapter, coalesce(falls, false) AS malformed FROM m
""")
def book_units(spark, sf_dir):
    """Lines with their unit and its context, and numbers that fall."""
    return structure.segmented(_book(spark, sf_dir)).select("source_id", "seq", "unit_no", "kind", "identifier", "part", "chapter", "malformed")


_HEADS = """
u AS (SELECT s_suppkey % 4 AS source_id, s_suppkey AS unit_no, CASE WHEN s_suppkey % 13 = 12 THEN 'schedule' WHEN s_suppkey % 7 = 6 THEN 'section' ELSE 'heading' END AS kind, 'H' || s_suppkey AS heading, 1 AS page_start, CAST(s_suppkey % 9 + 1 AS INTEGER) AS page_end,
  CASE s_suppkey // 4 % 5 WHEN 0 THEN CAST(s_suppkey // 20 % 3 + 1 AS VARCHAR) WHEN 1 THEN (s_suppkey // 20 % 3 + 1) || '.1' WHEN 2 THEN (s_suppkey // 20 % 3 + 1) || '.1.2' WHEN 3 THEN (s_suppkey // 20 % 4 + 1) || '.2' ELSE '' END AS identifier FROM supplier)
"""


def _heads(spark, sf_dir) -> DataFrame:
    """Suppliers as headings of four books, some of them numbered below others."""
    k = F.col("s_suppkey")
    at, top = F.floor(k / 4) % 5, (F.floor(k / 20) % 3 + 1).cast("string")
    number = F.when(at == 0, top).when(at == 1, F.concat(top, F.lit(".1"))).when(at == 2, F.concat(top, F.lit(".1.2"))).when(at == 3, F.concat((F.floor(k / 20) % 4 + 1).cast("string"), F.lit(".2"))).otherwise("")
    kind = F.when(k % 13 == 12, "schedule").when(k % 7 == 6, "section").otherwise("heading")
    return table(spark, sf_dir, "supplier").select((k % 4).alias("source_id"), k.alias("unit_no"), kind.alias("kind"), F.concat(F.lit("H"), k.cast("string")).alias("heading"), F.lit(1).alias("page_start"), (k % 9 + 1).cast("int").alias("page_end"), number.alias("identifier"))


@query(f"""
WITH {_HEADS}, p AS (SELECT d.source_id, d.unit_no, a.identifier, a.heading, row_number() OVER (PARTITION BY d.source_id, d.unit_no ORDER BY length(a.identifier) DESC, a.unit_no DESC) AS n
  FROM u d JOIN u a ON a.source_id = d.source_id AND a.kind = 'heading' AND a.identifier <> '' AND starts_with(d.identifier, a.identifier || '.') AND a.unit_no < d.unit_no WHERE d.kind = 'heading')
SELECT u.source_id, u.unit_no, p.identifier AS ancestor, coalesce(p.heading, u.heading) AS inherited_heading FROM u LEFT JOIN p ON p.source_id = u.source_id AND p.unit_no = u.unit_no AND p.n = 1
""")
def inherited_headings(spark, sf_dir):
    """The heading of the nearest numbered ancestor."""
    return structure.inherited_headings(_heads(spark, sf_dir)).select("source_id", "unit_no", "ancestor", "inherited_heading")


@query(f"""
WITH {_HEADS}, s AS (SELECT *, sum(CASE WHEN kind = 'schedule' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY unit_no ROWS UNBOUNDED PRECEDING) AS stretch, CASE WHEN kind = 'heading' AND identifier <> '' THEN identifier END AS own FROM u),
a AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY source_id, stretch ORDER BY unit_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM s), h AS (SELECT *, coalesce(starts_with(ahead, own || '.'), false) AS has FROM a),
p AS (SELECT d.source_id, d.unit_no, d.page_start, d.page_end, x.own AS above, max(x.unit_no) AS a_no FROM h d JOIN h x ON x.source_id = d.source_id AND x.stretch = d.stretch AND x.has AND x.unit_no < d.unit_no AND starts_with(d.own, x.own || '.') GROUP BY ALL),
n AS (SELECT source_id, unit_no, a_no, row_number() OVER (PARTITION BY source_id, unit_no ORDER BY length(above) DESC) AS place FROM p), r AS (SELECT source_id, a_no, min(page_start) AS below_start, max(page_end) AS below_end FROM p GROUP BY source_id, a_no)
SELECT h.source_id, h.unit_no, has AS has_descendants, n.a_no AS enclosing_no, n.a_no IS NULL AND coalesce(contains(own, '.'), false) AS orphaned, r.below_start, r.below_end
FROM h LEFT JOIN n ON n.source_id = h.source_id AND n.unit_no = h.unit_no AND place = 1 LEFT JOIN r ON r.source_id = h.source_id AND r.a_no = h.unit_no
""")
def enclosing_headings(spark, sf_dir):
    """Headings with descendants, what encloses each, and the pages of all below."""
    return extraction.enclosing(_heads(spark, sf_dir))


@query("""
WITH RECURSIVE u AS (SELECT s_suppkey % 3 AS source_id, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS unit_no, s_suppkey % 4 <> 3 AND s_suppkey % 5 <> 0 AS light, s_suppkey * 3 % 17 AS words FROM supplier),
g AS (SELECT source_id, unit_no, words AS held, light, 1 AS grp FROM u WHERE unit_no = 1 UNION ALL
  SELECT u.source_id, u.unit_no, CASE WHEN g.light AND g.held < 20 THEN g.held + u.words ELSE u.words END, u.light, CASE WHEN g.light AND g.held < 20 THEN g.grp ELSE g.grp + 1 END FROM g JOIN u ON u.source_id = g.source_id AND u.unit_no = g.unit_no + 1)
SELECT source_id, unit_no, max(unit_no) OVER (PARTITION BY source_id, grp) AS target FROM g
""")
def collapsed_headings(spark, sf_dir):
    """Short unnumbered headings go to the unit after them."""
    from pyspark.sql import Window as W

    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select((k % 3).alias("source_id"), F.row_number().over(W.partitionBy(k % 3).orderBy(k)).cast("long").alias("unit_no"), F.when(k % 4 == 3, "section").otherwise("heading").alias("kind"), F.when(k % 5 == 0, "1").otherwise("").alias("identifier"), (k * 3 % 17).alias("words"))
    return structure.collapsed_headings(rows)


#: Lines of small books: text, bold, page, block, left edge.
#: Books of parts, one of four kinds by key: an act with subsections, a form, an amendment and a guide; a few have no lines.
DOCUMENT_TYPES = ("act", "rules", "amendment_rules", "scheme_guideline")
_PART_BOOKS = """
k AS (SELECT p_partkey AS k, 'P' || p_partkey AS s, p_partkey % 4 AS kind, 2 + p_partkey // 4 % 4 AS n FROM part WHERE p_partkey % 20 <> 19),
sub AS (SELECT *, 1 + 6 * (5 + (k * 3 + i * 7) % 40) + CASE WHEN i = 2 THEN 8 ELSE 0 END AS w FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM k WHERE kind = 0)),
piece AS (
  SELECT k, s, kind, 'SEC_22' AS unit, i AS piece, CAST(i AS VARCHAR) AS piece_id, w, 1 + i AS page FROM sub UNION ALL SELECT k, s, kind, 'SEC_22', 0, NULL, 2, 1 FROM k WHERE kind = 0
  UNION ALL SELECT k, s, kind, 'FORM_VI', p, CASE WHEN p > 0 THEN CAST(p AS VARCHAR) END, CASE p WHEN 0 THEN 82 + 4 * (k % 100) WHEN 1 THEN 23 + k * 7 % 400 ELSE 23 + k * 11 % 400 END, p + 1 FROM k, (SELECT unnest([0, 1, 2]) AS p) WHERE kind = 1
  UNION ALL SELECT k, s, kind, 'ITEM_5', p, ([NULL, '9', '10'])[p + 1], CASE p WHEN 0 THEN 13 WHEN 1 THEN 242 + 4 * (k * 5 % 100) ELSE 242 + 4 * (k * 9 % 100) END, greatest(p, 1) FROM k, (SELECT unnest([0, 1, 2]) AS p) WHERE kind = 2
),
whole AS (SELECT k, s, kind, unit, sum(w) AS w, arg_min(w, piece) AS intro, max(page) AS pages, sum(w) > CASE WHEN kind = 0 THEN 450 ELSE 900 END AS split FROM piece GROUP BY k, s, kind, unit),
place AS (SELECT *, CASE kind WHEN 0 THEN '22' END AS number, CASE kind WHEN 0 THEN 'Duties' WHEN 1 THEN 'FORM VI' END AS heading FROM whole),
guide AS (SELECT *, 26 + 8 * (k % 30) AS scope, 22 + 4 * (k % 50) AS farmers, 26 + 6 * (k % 30) AS claims, 22 + 4 * (k % 40) AS alone FROM k WHERE kind = 3),
record AS (
  SELECT s || '_DOC' AS chunk_id, s, 'parent' AS record_type, NULL AS parent_id, NULL AS number, NULL AS heading, 1 AS page_start, pages AS page_end, CASE WHEN kind = 2 THEN 13 ELSE 2 END AS word_count, 'context_only' AS text_scope, 'CONTEXT_PARENT;SHORT_CONTEXT_PARENT' AS warnings, 'REFERENCE_ONLY' AS retrieval_status FROM place
  UNION ALL SELECT s || '_' || unit, s, CASE WHEN split THEN 'parent' ELSE 'child' END, s || '_DOC', number, heading, 1, pages, CASE WHEN split AND w > 900 THEN intro ELSE w END, CASE WHEN split AND w > 900 THEN 'context_only' ELSE 'complete_provision' END,
    CASE WHEN split AND w > 900 THEN 'CONTEXT_PARENT' || CASE WHEN intro < 20 THEN ';SHORT_CONTEXT_PARENT' ELSE '' END ELSE '' END, CASE WHEN split THEN 'REFERENCE_ONLY' ELSE 'ACTIVE' END FROM place
  UNION ALL SELECT l.s || '_' || l.unit || '_SUB_' || piece_id, l.s, 'child', l.s || '_' || l.unit, CASE WHEN l.kind = 2 THEN piece_id ELSE number END, heading, page, page, piece.w, 'complete_provision', '', 'ACTIVE' FROM place l JOIN piece ON piece.k = l.k AND piece > 0 WHERE split
  UNION ALL SELECT s || '_DOC', s, 'parent', NULL, NULL, NULL, 1, 6, 2, 'context_only', 'CONTEXT_PARENT;SHORT_CONTEXT_PARENT', 'REFERENCE_ONLY' FROM guide
  UNION ALL SELECT s || '_SEC_1', s, 'parent', s || '_DOC', '1', 'Scope', 1, 5, scope, 'context_only', '', 'REFERENCE_ONLY' FROM guide
  UNION ALL SELECT s || '_SEC_1_1', s, 'child', s || '_SEC_1', '1.1', 'Scope', 2, 2, farmers, 'complete_provision', '', 'ACTIVE' FROM guide
  UNION ALL SELECT s || '_SEC_1_2', s, 'child', s || '_SEC_1', '1.2', 'Scope', 4, 5, claims, 'complete_provision', '', 'ACTIVE' FROM guide
  UNION ALL SELECT s || '_SEC_3_1', s, 'child', s || '_DOC', '3.1', 'Alone', 6, 6, alone, 'complete_provision', 'STRUCTURE_UNCERTAIN', 'ACTIVE' FROM guide
)
"""


def book_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the books of parts."""
    k, kind = F.col("p_partkey"), F.col("p_partkey") % 4

    def line(text: Column | str, page: Column | int, bold: bool = False, x0: float = 50.0) -> Column:
        text, page = (F.lit(v) if isinstance(v, str | int) else v for v in (text, page))
        return F.struct(text.alias("text"), F.lit(bold).alias("bold"), page.cast("int").alias("page"), F.lit(x0).alias("x0"))

    def times(text: str, n: Column, before: str = "") -> Column:
        return F.concat(F.lit(before), F.repeat(F.lit(text), n.cast("int")))

    duty = lambda i: line(F.concat(F.lit("("), i.cast("string"), F.lit(") "), F.repeat(F.lit("A member has the following duty. "), ((k * 3 + i * 7) % 40 + 5).cast("int"))), i + 1)
    subsections = F.flatten(F.transform(F.sequence(F.lit(1), (F.floor(k / 4) % 4 + 2).cast("int")), lambda i: F.when(i == 2, F.array(duty(i), line("Provided that the exception applies to that member.", i + 1))).otherwise(F.array(duty(i)))))
    act = F.concat(F.array(line("22. Duties.—", 1, True)), subsections)
    form = F.array(
        line("FORM VI", 1, True), line(times("The applicant tells all. ", k % 100 + 20), 1), line("Details of applicant", 2, True), line(times("word ", k * 7 % 400 + 20), 2),
        line("Details of claim", 3, True), line(times("word ", k * 11 % 400 + 20), 3),
    )
    amendment = F.array(
        line("5. In the said rules, for rule 9 the following shall be substituted", 1), line(times("The fee is due. ", k * 5 % 100 + 60, "“9. Fees.— "), 1), line(times("The right is kept. ", k * 9 % 100 + 60, "10. Rights.— "), 2),
    )
    guide = F.array(
        line("1. Scope", 1, True), line(times("The text of the scope goes on here. ", k % 30 + 3), 1), line("1.1 Farmers", 2, True), line(times("All farmers growing crops. ", k % 50 + 5), 2),
        line("1.2 Claims", 4, True), line(times("A claim is paid within days. ", k % 30 + 4), 5), line("3.1 Alone", 6, True), line(times("It has nothing above. ", k % 40 + 5), 6),
    )
    lines = F.when(kind == 0, act).when(kind == 1, form).when(kind == 2, amendment).otherwise(guide)
    rows = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").where(k % 20 != 19).select(F.concat(F.lit("P"), k.cast("string")).alias("source_id"), F.element_at(F.array(*map(F.lit, DOCUMENT_TYPES)), (kind + 1).cast("int")).alias("document_type"), F.posexplode(lines).alias("line_no", "l"))
    return rows.select("source_id", "document_type", "line_no", F.col("line_no").cast("double").alias("seq"), "l.text", "l.bold", "l.page", F.col("line_no").alias("block"), "l.x0", F.lit(10.0).alias("size"), F.lit(10.0).alias("body_size"), F.lit(False).alias("table"))


def book_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, DOCUMENT_TYPES)), (F.col("p_partkey") % 4 + 1).cast("int"))
    text = {"title": F.col("p_name"), "jurisdiction": F.lit("India"), "document_type": kind, "authority": F.lit("A"), "priority": F.lit("high"), "source_url": F.lit("http://x"), "relative_path": F.lit("x.pdf"), "retrieved_date": F.lit("02-01-2024")}
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("source_id"), *[v.alias(c) for c, v in text.items()])


@query(f"WITH {_PART_BOOKS} SELECT chunk_id, record_type, parent_id, number, heading, page_start, page_end, word_count, text_scope, warnings, retrieval_status FROM record")
def book_records(spark, sf_dir):
    """Books of parts from lines to records: sections and their children, forms, amendments, and headings below others."""
    rows = extraction.extract(book_lines(spark, sf_dir), book_sources(spark, sf_dir))[0]
    return rows.select("chunk_id", "record_type", "parent_id", F.coalesce("section", "rule").alias("number"), "heading", "page_start", "page_end", "word_count", "text_scope", F.array_join("warnings", ";").alias("warnings"), "retrieval_status")


@query(f"""
WITH {_PART_BOOKS}, w AS (SELECT s, unnest(string_split(warnings, ';')) AS warning FROM record), v AS (SELECT s, string_agg(DISTINCT warning, ';' ORDER BY warning) AS warnings FROM w WHERE warning NOT IN ('', 'CONTEXT_PARENT') GROUP BY s),
r AS (SELECT s, count(*) FILTER (record_type = 'parent') AS parents, count(*) FILTER (record_type = 'child') AS children, count(*) AS n FROM record GROUP BY s), p AS (SELECT 'P' || p_partkey AS s, p_partkey % 4 AS kind, p_partkey % 20 <> 19 AS there FROM part)
SELECT p.s AS source_id, coalesce(parents, 0) AS parent_records, coalesce(children, 0) AS child_records, coalesce(n, 0) AS total_records, CAST(there AND kind = 0 AS BIGINT) AS sections_detected, CAST(there AND kind = 2 AS BIGINT) AS rules_detected, CAST(0 AS BIGINT) AS clauses_detected,
  CAST(CASE WHEN NOT there THEN 0 ELSE ([1, 1, 0, 4])[kind + 1] END AS BIGINT) AS headings_detected, CAST(there AND kind = 1 AS BIGINT) AS forms_detected, coalesce(v.warnings, '') AS warnings, CASE WHEN there THEN 'PASS' ELSE 'ERROR' END AS status FROM p LEFT JOIN r ON r.s = p.s LEFT JOIN v ON v.s = p.s
""")
def book_report(spark, sf_dir):
    """The report on the books' extraction; a source without records is an error."""
    return extraction.extract(book_lines(spark, sf_dir), book_sources(spark, sf_dir))[1]


@query(f"WITH {_PART_BOOKS} SELECT piece.s AS source_id, CAST(piece AS INTEGER) AS piece, piece_id, CAST(piece.w AS INTEGER) AS words, CAST(page AS INTEGER) AS page FROM piece JOIN whole ON whole.k = piece.k WHERE split")
def book_children(spark, sf_dir):
    """The pieces of units that are split, each by the rule for its kind."""
    rows = extraction.prepared(extraction.segments(book_lines(spark, sf_dir)))[2]
    return rows.select("source_id", F.col("piece").cast("int").alias("piece"), "piece_id", words("text").alias("words"), F.col("page_start").alias("page"))


_PARAGRAPHS = """
u AS (SELECT p_partkey AS k, p_partkey % 5 = 0 AS headed, 4 + p_partkey % 9 AS n FROM part),
p AS (SELECT k, i, 60 + (k * 7 + i * 13) % 120 AS w, 1 + (i - 1) // 3 AS lo, 1 + i // 3 AS hi,
  'Para ' || i || ' of ' || k || ' ' || repeat('word ', CAST(50 + (k * 7 + i * 13) % 120 AS INTEGER)) || 'is cooperative with them all, end.' AS t
  FROM (SELECT k, unnest(generate_series(1, n)) AS i FROM u) UNION ALL SELECT k, 0, 3, 1, 1, 'Heading of ' || k FROM u WHERE headed)
"""


@query(f"""
WITH RECURSIVE {_PARAGRAPHS},
g AS (SELECT k, i, w, lo, hi, t, 1 AS piece, w AS held FROM p WHERE i = (SELECT CASE WHEN u.headed THEN 0 ELSE 1 END FROM u WHERE u.k = p.k)
  UNION ALL SELECT p.k, p.i, p.w, p.lo, p.hi, p.t, CASE WHEN g.held >= 300 AND g.held + p.w > 500 THEN g.piece + 1 ELSE g.piece END, CASE WHEN g.held >= 300 AND g.held + p.w > 500 THEN p.w ELSE g.held + p.w END
  FROM g JOIN p ON p.k = g.k AND p.i = g.i + 1),
s AS (SELECT *, sum(w) OVER (PARTITION BY k) AS total, max(piece) OVER (PARTITION BY k) AS pieces FROM g),
l AS (SELECT k, piece, i, w, lo, hi, t FROM s WHERE total > 500 AND pieces > 1),
b AS (SELECT k, piece, min(w) AS least FROM (SELECT k, piece, sum(w) AS w FROM l GROUP BY k, piece) GROUP BY k, piece),
e AS (SELECT k, piece + 1 AS piece, arg_max(i, i) AS i, arg_max(w, i) AS w, arg_max(hi, i) AS page, arg_max(t, i) AS t FROM l GROUP BY k, piece),
o AS (SELECT l.k, l.piece, l.i, l.w, l.lo, l.hi, l.t FROM l UNION ALL SELECT e.k, e.piece, e.i, e.w, e.page, e.page, e.t FROM e JOIN b ON b.k = e.k AND b.piece = e.piece WHERE e.w BETWEEN 25 AND 75)
SELECT k AS source_id, CAST(piece AS INTEGER) AS piece, CAST(sum(w) AS INTEGER) AS words, CAST(min(lo) AS INTEGER) AS page_start, CAST(max(hi) AS INTEGER) AS page_end, sha256(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS text_hash
FROM o WHERE k NOT IN (SELECT k FROM b WHERE least < 20) GROUP BY k, piece
UNION ALL SELECT DISTINCT k, 0, 3, 1, 1, sha256('Heading of ' || k) FROM l WHERE k % 5 = 0 AND k NOT IN (SELECT k FROM b WHERE least < 20)
""")
def prose_pieces(spark, sf_dir):
    """Prose of parts in paragraphs of two lines, broken within a word and at times between pages: pieces with their own pages and texts."""
    k, spread = F.col("p_partkey"), lambda i: (F.col("p_partkey") * 7 + i * 13) % 120
    line = lambda t, page, i: F.struct(t.alias("text"), page.cast("int").alias("page"), i.cast("int").alias("block"), F.lit(False).alias("table"))
    first = lambda i: F.concat(F.lit("Para "), i.cast("string"), F.lit(" of "), k.cast("string"), F.lit("  "), F.repeat(F.lit("word "), (spread(i) + 50).cast("int")), F.lit("is co-"))
    both = lambda i: F.array(line(first(i), F.floor((i - 1) / 3) + 1, i), line(F.lit("operative with  them all, end."), F.floor(i / 3) + 1, i))
    lines = F.flatten(F.transform(F.sequence(F.lit(1), (k % 9 + 4).cast("int")), both))
    heading = F.array(line(F.concat(F.lit("Heading of "), k.cast("string")), F.lit(1), F.lit(0)))
    units = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(k.alias("source_id"), F.lit(0).cast("long").alias("unit_no"), F.when(k % 5 == 0, "heading").otherwise("background").alias("kind"), F.when(k % 5 == 0, F.concat(heading, lines)).otherwise(lines).alias("lines"))
    return chunking.packed_units(units).select("source_id", "piece", words("text").alias("words"), "page_start", "page_end", content_hash("text").alias("text_hash"))


@query("""
SELECT o_orderkey AS source_id, sha256('Rates of ' || o_orderkey || chr(10) || chr(10) || 'Crop | Rate' || chr(10) || 'Rice ' || o_custkey || ' | 2 percent' || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || o_orderpriority || ' | none' ELSE '' END || chr(10) || chr(10)
  || 'as the ' || CASE o_orderkey % 4 WHEN 0 THEN 'cooperative' WHEN 1 THEN 'bro-ken' WHEN 2 THEN 'soft' ELSE 'Co- Op' END || ' table says') AS text_hash FROM orders
""")
def reflowed_tables(spark, sf_dir):
    """Lines before, in and after a table of orders: its rows stay, and broken words around it are joined by their hyphens."""
    k = F.col("o_orderkey")
    rows = F.concat(F.lit("Crop  |  Rate\r\n Rice "), F.col("o_custkey").cast("string"), F.lit(" | 2\tpercent"), F.when(k % 3 == 0, F.concat(F.lit("\n"), "o_orderpriority", F.lit(" |  none "))).otherwise(""))
    ends = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in (("co-", "operative"), ("bro-", "ken"), ("so­", "ft"), ("Co-", "Op"))]), (k % 4 + 1).cast("int"))
    texts = F.array(F.concat(F.lit(" Rates  of "), k.cast("string")), rows, F.concat(F.lit("as the "), ends[0]), F.concat(ends[1], F.lit(" table says")))
    lines = table(spark, sf_dir, "orders").select(k.alias("source_id"), F.posexplode(texts).alias("line_no", "text"), F.lit(1).alias("page"), F.lit(1).alias("block"))
    return layout.reflow(lines.withColumn("table", F.col("line_no") == 1), ["source_id"]).select("source_id", content_hash("text").alias("text_hash"))

"""Cleaning of page lines: margins, running headers, contents pages, scripts, tables and reflow.

Lines are rows ``source_id, page, line_no, text, x0, y0, x1, y1, size, bold, block, table`` and pages
``source_id, page, height, width``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions.text import filled, fold, norm, words

# Forms of numbered lines.
NUMBER = r"\d{1,3}(?:-?[A-Z])?"
PROVISION = rf"^(?:\d{{1,3}}\s*\[\s*|\[\s*)?({NUMBER})[.．]\s*(.*)$"
DECIMAL = r"^(\d{1,2}(?:\.\d{1,3}){1,4})\.?\s+(\S.*)$"
SUB = r"^\s*(?:\d+\[)?\((\d{1,3}|[a-z]{1,4}|[ivxlcdm]+)\)\s*"
QUALIFIER = r"(?i)^(?:Provided\b|Explanation\b|Exception\b|Illustration\b|Note\s*[:.\d])"
TOC_TITLE = r"(?i)^(?:(?:table of )?contents|index|arrangement of (?:sections|rules))$"
PAGE_NUMBER = r"(?i)^(?:page\s*)?[-–—]?\s*\d{1,4}\s*[-–—]?$"
LONE_NUMBER = r"[\dA-Z.\[\]-]+"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
TOKEN = r"(?U)\w+|[^\w\s|]"


def in_margin(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines with ``margin``: they end in the upper tenth of the page or begin in the lower."""
    both = lines.join(pages.select("source_id", "page", "height", "width"), ["source_id", "page"])
    return both.withColumn("margin", (F.col("y1") < F.col("height") * 0.1) | (F.col("y0") > F.col("height") * 0.9))


def running_lines(margined: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """``source_id, running``: margin texts on at least 3 pages and 3 in 10 that look like furniture.

    All ``pages`` count, those without lines too.
    """
    size = pages.groupBy("source_id").agg(F.count_distinct("page").alias("pages"))
    seen = margined.where("margin").select("source_id", "page", fold(norm("text")).alias("running"))
    often = seen.groupBy("source_id", "running").agg(F.count_distinct("page").alias("on")).join(size, "source_id").join(titles.select("source_id", fold("title").alias("title")), "source_id", "left")
    known = (F.col("running") == F.col("title")) | F.col("running").rlike(L.FURNITURE)
    return often.where((F.col("on") >= F.greatest(F.lit(3.0), F.col("pages") * 0.3)) & (F.length("running") <= 170) & F.coalesce(known, F.lit(False))).select("source_id", "running")


def without_margins(lines: DataFrame, pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Lines less page numbers and running headers and footers in the margins."""
    rows = in_margin(lines, pages)
    number = F.col("margin") & filled("text").rlike(PAGE_NUMBER) & (F.col("x0") > F.col("width") * 0.3)
    rows = rows.where(~number).withColumn("running", F.when(F.col("margin"), fold(norm("text"))))
    return rows.join(running_lines(in_margin(lines, pages), pages, titles), ["source_id", "running"], "left_anti").select(lines.columns)


def page_shape(lines: DataFrame) -> DataFrame:
    """What tells a contents page: counts of titles, leaders, numbered, long and short lines."""
    n = words("text")
    return lines.groupBy("source_id", "page").agg(
        F.bool_or(filled("text").rlike(TOC_TITLE)).alias("toc_title"),
        F.count_if(filled("text").rlike(r"\.{3,}\s*\d+\s*$")).alias("leaders"),
        F.count_if(filled("text").rlike(PROVISION)).alias("numbered"),
        F.count_if(n >= 16).alias("long_lines"),
        (F.count_if(n <= 12) / F.greatest(F.count("*"), F.lit(1))).alias("short_ratio"),
    )


def _carry(batch: pd.DataFrame) -> pd.DataFrame:
    out, inside = [], False
    for r in batch.sort_values("page").itertuples():
        toc = ((r.toc_title or inside) and r.short_ratio > 0.65 and r.numbered >= 4 and r.long_lines <= 5) or (r.leaders >= 5 and r.short_ratio > 0.8 and r.long_lines <= 3)
        out.append((r.source_id, r.page, bool(toc), bool(r.toc_title and not toc)))
        inside = True if toc else bool(r.toc_title and r.short_ratio > 0.85)
    return pd.DataFrame(out, columns=["source_id", "page", "is_toc", "review"])


def contents_pages(lines: DataFrame) -> DataFrame:
    """``source_id, page, is_toc, review``. A contents page may go on without a title, so a source's pages (one row
    each) are taken in order. A page with a title of contents that is none is for review."""
    kind = lines.schema["source_id"].dataType.simpleString()
    return page_shape(lines).groupBy("source_id").applyInPandas(_carry, f"source_id {kind}, page {lines.schema['page'].dataType.simpleString()}, is_toc boolean, review boolean")


def script_profile(rows: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Letters by script, legacy characters and what they tell of each source."""
    t = filled(text)
    counts = rows.groupBy(by).agg(
        F.sum(F.regexp_count(t, F.lit("[A-Za-z\\u00AA\\u00BA\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u024F]"))).cast("long").alias("latin"),
        F.sum(F.regexp_count(t, F.lit("[\\u0904-\\u0939\\u0958-\\u0961\\u0972-\\u097F]"))).cast("long").alias("devanagari"),
        F.sum(F.regexp_count(t, F.lit("[\\u0C85-\\u0CB9\\u0CDE-\\u0CE1]"))).cast("long").alias("kannada"),
        F.sum(F.regexp_count(t, F.lit("[\\u00A1-\\u00FF]"))).cast("long").alias("legacy"),
        F.sum(F.length(t)).cast("long").alias("characters"),
        F.count_if(F.contains(t, F.lit("�")) | t.rlike(r"\(cid:\d+\)")).alias("damaged"),
    )
    return counts.select(
        "*", ((F.col("latin") > 200) & ((F.col("devanagari") > 100) | (F.col("kannada") > 100))).alias("bilingual"),
        (F.col("legacy") > F.greatest(F.lit(100.0), F.col("characters") * 0.03)).alias("legacy_font"),
    )


def body_size(lines: DataFrame) -> DataFrame:
    """The most common size of lines of more than six words (10 without any); the first seen wins ties."""
    long = lines.where(words("text") > 6).select("source_id", F.bround("size", 1).alias("size"), F.struct("page", "line_no").alias("at"))
    most = long.groupBy("source_id", "size").agg(F.count("*").alias("n"), F.min("at").alias("at")).groupBy("source_id").agg(F.min_by("size", F.struct(-F.col("n"), F.col("at"))).alias("body_size"))
    return lines.select("source_id").distinct().join(most, "source_id", "left").fillna(10.0, ["body_size"])


def table_bands(lines: DataFrame) -> DataFrame:
    """Pages that look like a table without rules: three rows of three lines, all of at most 12 words, in three columns."""
    placed = lines.select("source_id", "page", F.bround(F.col("y1") / 4).alias("band"), F.bround(F.col("x0") / 12).alias("column"), words("text").alias("w"))
    rows = placed.groupBy("source_id", "page", "band").agg(F.count("*").alias("n"), F.max("w").alias("w")).where("n >= 3 and w <= 12")
    bands = rows.groupBy("source_id", "page").agg(F.count("*").alias("bands"))
    inside = placed.join(rows.select("source_id", "page", "band"), ["source_id", "page", "band"], "left_semi")
    columns = inside.groupBy("source_id", "page", "column").agg(F.count("*").alias("n")).where("n >= 3").groupBy("source_id", "page").agg(F.count("*").alias("columns"))
    return bands.join(columns, ["source_id", "page"]).where("bands >= 3 and columns >= 3")


def grid_tables(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Lines with those of each ruled table as one line of its cells, and ``review``.

    ``cells (source_id, page, table_no, x0, y0, x1, y1, columns, cells array<array<string>>)``. The lines inside a table's
    box are replaced by its rows, cells between bars, if both have the same words and marks as often; else they stay and
    are for review, as are tables with missing cells.
    """
    tables = cells.where((F.size("cells") >= 2) & (F.col("columns") >= 2))
    box = tables.select("source_id", "page", "table_no", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = lines.join(box, ["source_id", "page"]).where("x0 >= t_x0 and y0 >= t_y0 and x1 <= t_x1 and y1 <= t_y1")
    own = inside.groupBy("source_id", "page", "table_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_no", "text")))["text"], " ").alias("before"), F.min(F.struct("y0", "x0", "line_no")).alias("first"))
    rows = F.transform("cells", lambda r: F.array_join(F.transform(r, lambda c: norm(c)), " | "))
    clean = F.forall("cells", lambda r: (F.size(r) == F.col("columns")) & F.forall(r, lambda c: c.isNotNull()))
    made = tables.join(own, ["source_id", "page", "table_no"]).withColumns({"grid": F.array_join(rows, "\n"), "clean": clean})
    made = made.select("source_id", "page", "table_no", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")], F.col("first.line_no").alias("t_first"), "grid", "clean", (tokens("before") == tokens("grid")).alias("same"))
    placed = lines.join(inside.select("source_id", "page", "line_no", "table_no"), ["source_id", "page", "line_no"], "left").join(made, ["source_id", "page", "table_no"], "left")
    same = F.coalesce("same", F.lit(False))
    kept = placed.where(~same | (F.col("line_no") == F.col("t_first")))
    change = {"text": F.when(same, F.col("grid")).otherwise(F.col("text")), "table": F.col("table") | F.col("table_no").isNotNull()}
    change.update({c: F.when(same, F.col(f"t_{c}")).otherwise(F.col(c)) for c in ("x0", "y0", "x1", "y1")})
    return kept.select(*[change[c].alias(c) if c in change else F.col(c) for c in lines.columns], F.coalesce(~F.col("same") | ~F.col("clean"), F.lit(False)).alias("review"))


def tokens(text: Column | str) -> Column:
    """Words and marks of a text, sorted, bars left out."""
    return F.array_sort(F.regexp_extract_all(filled(text), F.lit(TOKEN), 0))


def same_tokens(a: Column, b: Column) -> Column:
    """Whether two texts have the same words as often, in any order."""
    def bag(x: Column) -> Column:
        return F.array_sort(F.filter(F.split(filled(x), r"\s+"), lambda w: w != ""))

    return bag(a) == bag(b)


def _merge(batch: pd.DataFrame) -> pd.DataFrame:
    out: list[dict] = []
    batch = batch.assign(_y=batch["y0"].round(1))
    for r in batch.sort_values(["_y", "x0"], kind="stable").drop(columns="_y").to_dict("records"):
        p = out[-1] if out else None
        if p is not None and abs(p["y1"] - r["y1"]) < 2.0 and 0 <= r["x0"] - p["x1"] < 36 and (re.fullmatch(LONE_NUMBER, p["text"]) or p["bold"] == r["bold"]):
            p.update(text=p["text"] + " " + r["text"], y0=min(p["y0"], r["y0"]), x1=r["x1"], y1=max(p["y1"], r["y1"]), bold=bool(p["bold"] or r["bold"]))
        else:
            out.append(dict(r))
    return pd.DataFrame(out, columns=[c for c in batch.columns if c != "_y"])


def merged_spans(lines: DataFrame) -> DataFrame:
    """Spans on one baseline as one line: within 36 points of each other, and alike in weight or after a lone number.

    The line reaches from the first span's left to the last one's right edge. Merges depend on what was merged before, so
    a page is folded; its lines are in the order of their tops (to a tenth) and left edges.
    """
    return lines.groupBy("source_id", "page").applyInPandas(_merge, lines.schema)


def reflow(lines: DataFrame, by: list[str]) -> DataFrame:
    """The text of each group of lines: paragraphs between blank lines, broken words joined, tables by their rows.

    The separator before a line follows from it and the line before, so a window decides it; the ordered
    list that is joined is a unit's own lines.
    """
    w = W.partitionBy(*by).orderBy("page", "line_no")
    table_rows = F.array_join(F.transform(F.split(filled("text"), LINE_END), norm), "\n")
    rows = lines.withColumn("t", F.when(F.col("table"), table_rows).otherwise(norm("text"))).where("t <> ''")
    rows = rows.select("*", F.lag("t").over(w).alias("pt"), F.lag("page").over(w).alias("pp"), F.lag("block").over(w).alias("pb"), F.lag("table").over(w).alias("ptab"))
    new = (
        F.col("pt").isNull() | F.col("table") | F.coalesce("ptab", F.lit(False)) | F.col("t").rlike(SUB) | F.col("t").rlike(QUALIFIER)
        | ((F.col("page") == F.col("pp")) & (F.col("block") != F.col("pb")))
    )
    soft = F.endswith("pt", F.lit("­")) & F.col("t").rlike("^[a-z]")
    glued = (F.col("pt").rlike(r"\bco-$") & F.col("t").rlike(r"^operative\b")) | (F.col("pt").rlike("[A-Za-z]-$") & F.col("t").rlike("^[a-z]"))
    sep = F.when(F.col("pt").isNull(), "").when(new, "\n\n").when(soft | glued, "").otherwise(" ")
    rows = rows.select(*by, "page", "line_no", "t", sep.alias("sep"))
    # Of a line that the next one continues, a soft hyphen or the hyphen of "co-" goes.
    after = W.partitionBy(*by).orderBy("page", "line_no")
    joined = (F.lead("sep").over(after) == "") & ((F.endswith("t", F.lit("­"))) | (F.col("t").rlike(r"\bco-$") & F.lead("t").over(after).rlike(r"^operative\b")))
    rows = rows.withColumn("t", F.when(F.coalesce(joined, F.lit(False)), F.substring("t", F.lit(1), F.length("t") - 1)).otherwise(F.col("t")))
    parts = F.array_sort(F.collect_list(F.struct("page", "line_no", F.concat("sep", "t").alias("s"))))
    return rows.groupBy(*by).agg(parts.alias("parts")).select(*by, F.array_join(F.col("parts.s"), "").alias("text"))



"""Readers and writers of the file formats of a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiquarry.functions.text import filled


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


SOURCE = strings("source_id", "title", "jurisdiction", "document_type", "authority", "filename", "relative_path", "source_url", "retrieved_date", "priority")
QUESTION = T.StructType(
    [
        *strings("id", "category", "question", "jurisdiction").fields,
        T.StructField("expected_source_ids", T.ArrayType(T.StringType())), T.StructField("forbidden_source_ids", T.ArrayType(T.StringType())),
        T.StructField("should_answer", T.BooleanType()), T.StructField("expected_behavior", T.StringType()), T.StructField("require_all_expected_sources", T.BooleanType()),
    ]
)
LINE = T.StructType(
    [
        T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType()), T.StructField("box", T.ArrayType(T.DoubleType())),
        T.StructField("size", T.DoubleType()), T.StructField("bold", T.BooleanType()), T.StructField("block", T.IntegerType()),
        T.StructField("table", T.BooleanType()), T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("height", T.DoubleType()), T.StructField("width", T.DoubleType()), T.StructField("raw_chars", T.IntegerType()),
        T.StructField("tables", T.IntegerType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("lines", T.ArrayType(LINE)),
    ]
)


class ContractError(ValueError):
    """A file that does not have the columns it must have."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """A CSV with a header, trimmed, nulls as empty texts. Columns missing or rows with more cells are errors."""
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False, "multiLine": multiline, "quote": '"', "escape": '"', "encoding": "UTF-8"}
    head = [c.lstrip("\ufeff").strip() for c in spark.read.options(**{**options, "enforceSchema": True, "inferSchema": False}).csv(path).columns]
    missing = [f.name for f in schema.fields if f.name not in head]
    if missing:
        raise ContractError(f"{path}: no column {', '.join(missing)}")
    rows = spark.read.options(**options).schema(strings(*head)).csv(path)
    kinds = {f.name: f.dataType for f in schema.fields}
    return rows.select(*[(F.trim(filled(n)) if isinstance(kinds[n], T.StringType) else F.col(n).try_cast(kinds[n])).alias(n) for n in kinds])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a fixed schema; a malformed line is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """The questions of several JSON files, absent lists as empty ones."""
    empty = F.array().cast("array<string>")
    out = None
    for path in paths:
        rows = spark.read.schema(QUESTION).json(path, multiLine=True)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), empty) for c in ("expected_source_ids", "forbidden_source_ids")}).fillna(False, ["require_all_expected_sources"])


def read_layout(spark: SparkSession, path: str, source_id: str) -> tuple[DataFrame, DataFrame]:
    """The pages of a layout file and their lines, with the place of each."""
    pages = read_jsonl(spark, path, PAGE).withColumn("source_id", F.lit(source_id)).withColumn("page", F.coalesce(F.get("lines", F.lit(0))["page"], F.lit(0)))
    lines = pages.select("source_id", F.posexplode("lines").alias("line_no", "l")).select(
        "source_id", F.col("l.page").alias("page"), "line_no", F.col("l.text").alias("text"), *[F.col("l.box")[k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))],
        F.col("l.size").alias("size"), F.col("l.bold").alias("bold"), F.col("l.block").alias("block"), F.col("l.table").alias("table"), F.col("l.warnings").alias("warnings"),
    )
    return pages.drop("lines"), lines


def read_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, sha256, page, text`` of binary files by a parser that gives a file's page texts."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, hashlib.sha256(c).hexdigest(), k + 1, t) for p, c in zip(batch["path"], batch["content"], strict=True) for k, t in enumerate(parse(c))]
            yield pd.DataFrame(rows, columns=["path", "sha256", "page", "text"])

    return files.mapInPandas(run, "path string, sha256 string, page int, text string")


def html_lines(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key, line_no, text``: what a web page shows, by blocks, without scripts, styles and comments."""
    bare = F.regexp_replace(filled(html), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    cut = F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|section|article|nav|header|footer|body|html)\b[^>]*>", "\n")
    text = F.regexp_replace(cut, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    parts = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select(key, F.posexplode_outer(parts).alias("line_no", "text")).where("line_no is not null")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The named columns as CSV with a header, cells with line ends quoted."""
    df.select(*columns).write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as compact JSON texts, nulls and letters of all scripts kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    json_lines(df).write.mode("overwrite").text(path)


def resolved(folder: str, relative: str) -> str:
    """A path inside ``folder``; one that is absolute, on a drive, or leads out is an error."""
    steps: list[str] = []
    plain = relative.replace("\\", "/")
    if not plain.strip() or plain.startswith("/") or (len(plain) > 1 and plain[1] == ":"):
        raise ContractError("a path must be relative and not empty")
    for step in PurePosixPath(plain).parts:
        if step == "..":
            if not steps:
                raise ContractError("a path leads out of its folder")
            steps.pop()
        elif step != ".":
            steps.append(step)
    return f"{folder.rstrip('/')}/{'/'.join(steps)}"


def env_pairs(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with ``key, value`` of KEY=VALUE lines; comments and other lines are left out, quotes around values taken off."""
    text = F.trim(filled(line))
    at = F.instr(text, "=")
    rows = lines.withColumns({"key": F.trim(F.substring(text, F.lit(1), at - 1)), "value": F.btrim(F.btrim(F.substring(text, at + 1, F.length(text))), F.lit("\"'"))})
    return rows.where((at > 0) & (F.col("key") != "") & ~F.startswith(text, F.lit("#")))

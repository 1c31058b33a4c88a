"""Pieces that the query catalogue shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int = 2000) -> DataFrame:
    """Rows dealt by key to tasks, about so many each, before long texts are made of them: a table of keys is a small file, and a small file one task."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def sql_words(text: str) -> str:
    """SQL for the number of words."""
    return f"len(list_filter(string_split_regex(coalesce({text}, ''), '\\s+'), lambda w: w <> ''))"


def sql_norm(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'))"


def sql_entities(text: str) -> str:
    """SQL for a text with the entities of HTML as characters."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', {sql_quote(char)})"
    return text


def sql_shown(html: str) -> str:
    """SQL for what a web page shows, blocks between line ends."""
    out = f"coalesce({html}, '')"
    for tag in ("script", "style", "head"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b.*?</{tag}\\s*>', '', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', '', 'g'), '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|tr|table|section|article|nav|header|footer|body|html)\\b[^>]*>', chr(10), 'g')"
    return sql_entities(f"regexp_replace({out}, '<[^>]*>', '', 'g')")


def sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_matches(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {sql_quote(pattern)}{', ' + sql_quote(flags) if flags else ''})"


def sql_literal(value) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return sql_quote(value)
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(sql_literal, value)) + "]"
    return repr(value)


def sql_rows(names: str, rows) -> str:
    """SQL for rows that a query states itself."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_literal, r)) + ")" for r in rows) + f") AS t({names}))"


def sampled(df: DataFrame, key: str, samples) -> DataFrame:
    """``df`` with ``text``, each row one of ``samples`` by its key, so that every rule meets texts that it is for."""
    return df.withColumn("text", F.element_at(F.array(*[F.lit(x) for x in samples]), (F.col(key) % len(samples) + 1).cast("int")))


def sql_sampled(table_: str, key: str, samples) -> str:
    return f"(SELECT *, ({sql_literal(list(samples))})[CAST({key} % {len(samples)} AS INTEGER) + 1] AS text FROM {table_})"


def registry():
    """A dictionary of queries, one of their SQL, and the decorator that fills both."""
    queries: dict = {}
    oracle_sql: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle_sql[f.__name__] = sql
            return f

        return add

    return queries, oracle_sql, query

"""Profiles, duplicates, referential checks and audits of record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions import tags
from lexiquarry.functions.text import content_hash, filled, iso_date, norm, words


def word_profile(records: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Counts by word band, and exact percentiles, of each group."""
    rows = records.select(*by, words(text).alias("w"))
    band = tags.word_band(F.col("w"))
    bands = ["lt20", "20_49", "50_149", "150_450", "451_900", "gt900"]
    return rows.groupBy(*by).agg(
        F.count("*").alias("records"),
        *[F.count_if(band == b).alias(f"chunks_{b}") for b in bands],
        F.min("w").cast("long").alias("word_min"),
        F.percentile("w", F.lit(0.1)).alias("word_p10"),
        F.median("w").alias("word_median"),
        F.percentile("w", F.lit(0.9)).alias("word_p90"),
        F.max("w").cast("long").alias("word_max"),
    )


def corpus_summary(records: DataFrame, by: str, text: str = "text") -> DataFrame:
    """The grand total (null key) and a row per key in one pass."""
    rows = records.select(by, words(text).alias("w"))
    return rows.rollup(by).agg(F.count("*").alias("records"), F.min("w").cast("long").alias("word_min"), F.median("w").alias("word_median"), F.sum("w").cast("long").alias("words"), F.max("w").cast("long").alias("word_max"))


def duplicate_groups(records: DataFrame, key: str, text: str = "text", word_floor: int = 150) -> DataFrame:
    """Records whose text another has: key, hash, copies, and whether the text is a major one.

    Only keys, hashes and counts are shuffled; a hash's rows are combined first.
    """
    rows = records.select(key, content_hash(text).alias("text_hash"), words(text).cast("long").alias("word_count"))
    twice = rows.groupBy("text_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(twice, "text_hash").select(key, "text_hash", "copies", "word_count", (F.col("word_count") >= word_floor).alias("major"))


def longest(records: DataFrame, key: str, n: int, shortest: bool = False, text: str = "text") -> DataFrame:
    """The ``n`` longest (or shortest) records; ties in the order of their keys."""
    rows = records.select(key, words(text).cast("long").alias("word_count"))
    return rows.orderBy(F.asc("word_count") if shortest else F.desc("word_count"), F.asc(key)).limit(n)


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).where("times > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def child_ranges(children: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """The range that the children of each parent span."""
    return children.groupBy(key).agg(F.min(start).alias("range_start"), F.max(end).alias("range_end"), F.count("*").alias("children"))


def descendant_ranges(nodes: DataFrame, most: int = 32) -> DataFrame:
    """``node, range_start, range_end`` over a node and all below it, for ``nodes (node, parent, start, end)``.

    Ancestors are found by doubling the length of the known paths, so the rounds are the logarithm of the
    depth; paths that still grow after ``most`` rounds are a circle, which is an error.
    """
    up = nodes.where("parent is not null").select("node", F.col("parent").alias("above"))
    paths, step = up, up
    for _ in range(most):
        longer = paths.alias("p").join(step.alias("s"), F.col("p.above") == F.col("s.node")).select(F.col("p.node").alias("node"), F.col("s.above").alias("above"))
        if longer.isEmpty():
            break
        paths = paths.unionByName(longer).distinct()
        step = longer.distinct()
    else:
        raise ValueError("the nodes are above each other in a circle")
    own = nodes.select(F.col("node").alias("above"), "start", "end")
    under = paths.join(nodes.select("node", "start", "end"), "node").select("above", "start", "end")
    return own.unionByName(under).groupBy(F.col("above").alias("node")).agg(F.min("start").alias("range_start"), F.max("end").alias("range_end"))


def metadata_mismatch(records: DataFrame, dim: DataFrame, key: str, columns: Sequence[str], date: str | None = None) -> DataFrame:
    """Per record whether its copy of the dimension's columns differs or the key is unknown."""
    known = dim.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns], *([F.col(date).alias(f"_{date}")] if date else []), F.lit(True).alias("_known"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    if date:
        same = same & F.coalesce(F.col(date).cast("string") == iso_date(f"_{date}").cast("string"), F.lit(False))
    return records.join(known, key, "left").withColumn("metadata_ok", F.coalesce(F.col("_known"), F.lit(False)) & same).drop("_known", *[f"_{c}" for c in columns], *([f"_{date}"] if date else []))


def source_issues(sources: DataFrame, required: Sequence[str], files: DataFrame | None = None) -> DataFrame:
    """The issues of each row of a source table, joined by semicolons.

    The table is a dimension; its duplicate keys are found by counting, not by a window over all rows.
    """
    twice = duplicate_ids(sources, "source_id").select("source_id", F.lit(True).alias("_twice"))
    rows = sources.join(twice, "source_id", "left")
    base = F.regexp_extract(F.replace(filled("relative_path"), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    found = [F.when(F.trim(filled(c)) == "", F.lit(f"missing {c}")) for c in required]
    found.append(F.when(F.col("_twice"), F.lit("duplicate source_id")))
    found.append(F.when(~filled("priority").isin("high", "medium", "low"), F.lit("invalid priority")))
    found.append(F.when(base != filled("filename"), F.lit("filename differs from relative_path")))
    found.append(F.when(~path_is_inside(F.col("relative_path")), F.lit("unsafe relative_path")))
    if files is not None:
        rows = rows.join(files.select("relative_path", F.lit(True).alias("_there")), "relative_path", "left")
        found.append(F.when(F.col("_there").isNull(), F.lit("file missing")))
    return rows.select(*sources.columns, F.array_join(F.array_compact(F.array(*found)), "; ").alias("metadata_issues"))


def path_is_inside(path: Column) -> Column:
    """A relative path that does not leave its folder: no root, no drive, never more steps up than down."""
    steps = F.filter(F.split(F.replace(filled(path), F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda acc, s: F.struct((acc["now"] + F.when(s == "..", -1).otherwise(1)).alias("now"), F.least(acc["least"], acc["now"] + F.when(s == "..", -1).otherwise(1)).alias("least")),
    )
    return (F.trim(filled(path)) != "") & ~filled(path).rlike(r"^(?:[/\\]|[A-Za-z]:)") & (depth["least"] >= 0)


def readiness(records: DataFrame, by: str = "source_id", status: str = "retrieval_status") -> DataFrame:
    """Records by status of each source."""
    return records.groupBy(by).agg(
        F.count("*").alias("total_records"),
        *[F.count_if(F.col(status) == s).alias(f"{s.lower()}_records") for s in ("ACTIVE", "REFERENCE_ONLY", "REVIEW")],
    )


def warning_union(records: DataFrame, by: str, warnings: str = "warnings", without: Sequence[str] = ("CONTEXT_PARENT",)) -> DataFrame:
    """All warnings of each source, sorted and joined; only distinct pairs are gathered."""
    pairs = records.select(by, F.explode_outer(warnings).alias("w")).where(~F.col("w").isin(*without)).distinct()
    return pairs.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list("w")), ";").alias("warnings"))


def first_samples(records: DataFrame, category: str, preferred: Column, position: str, sample: Column) -> DataFrame:
    """One record of each category: the first preferred one, else the first."""
    return records.groupBy(category).agg(F.min_by(sample, F.struct(~preferred, F.col(position))).alias("sample"))


def violations(records: DataFrame, sources: DataFrame, topics: Sequence[str]) -> DataFrame:
    """``chunk_id, violation`` of every record that breaks a rule of the record table."""
    def found(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("chunk_id", F.lit(name).alias("violation"))

    known = F.array(*[F.lit(t) for t in topics]).cast("array<string>")
    need = [F.trim(filled(c)) == "" for c in ("chunk_id", "source_id", "text", "source_url")]
    missing = need[0] | need[1] | need[2] | need[3]
    parents = records.where("record_type = 'parent'").select(F.col("chunk_id").alias("parent_id"), F.col("position").alias("parent_position"))
    placed = records.where("parent_id is not null").join(parents, "parent_id", "left")
    meta = metadata_mismatch(records, sources, "source_id", ["jurisdiction", "document_type"])
    out = [
        found(records.where(missing), "MISSING_FIELD"),
        found(records.join(duplicate_ids(records, "chunk_id"), "chunk_id", "left_semi"), "DUPLICATE_ID"),
        found(meta.where(~F.col("metadata_ok")), "METADATA_MISMATCH"),
        found(records.where((F.col("char_count") != F.length("text")) | (F.col("word_count") != words("text"))), "TEXT_COUNT"),
        found(records.where("not (1 <= page_start and page_start <= page_end)"), "PAGE_RANGE"),
        found(records.where(F.size(F.array_except("topics", known)) > 0), "UNKNOWN_TOPIC"),
        found(placed.where("parent_position is null or parent_position >= position"), "PARENT_MISSING_OR_LATER"),
        found(records.where("record_type = 'child' and parent_id is null"), "CHILD_WITHOUT_PARENT"),
    ]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def hierarchy_flags(records: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Children, by ``key``, that do not fit their parent: source, pages, numbering or text."""
    keep = ("source_id", "page_start", "page_end", "section", "rule", "clause", "text_scope", "text")
    parents = records.where("record_type = 'parent'").select(F.col("chunk_id").alias("parent_id"), *[F.col(c).alias(f"p_{c}") for c in keep])
    both = records.join(parents, "parent_id")
    bad = (F.col("p_source_id") != F.col("source_id")) | ~F.expr("p_page_start <= page_start and page_start <= page_end and page_end <= p_page_end")
    for c in ("rule", "clause"):
        bad = bad | F.coalesce(F.col(f"p_{c}") != F.col(c), F.lit(False))
    bad = bad | F.coalesce(~((F.col("section") == F.col("p_section")) | F.startswith("section", F.concat("p_section", F.lit(".")))), F.lit(False))
    bad = bad | ((F.col("p_text_scope") == "complete_provision") & ~F.contains(norm("p_text"), norm("text")))
    return both.where(bad).select(key, F.lit("HIERARCHY_REVIEW").alias("flag"))


def audit(records: DataFrame, sources: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Each record with its audit flags, severity, groups and excerpt.

    Severity is settled before repeated texts are flagged. With a column ``position``, unique in the table, rows that share
    a chunk_id are told apart and the first of them is no duplicate.
    """
    key = "position" if "position" in records.columns else "chunk_id"
    expected = F.when(F.col("document_type") == "act", F.col("section")).when(F.col("document_type") == "rules", F.col("rule")).otherwise("-")
    exempt = F.coalesce(F.col("text_scope").isin("context_only", "front_matter"), F.lit(False)) | (filled("form_number") != "") | filled("heading").rlike("(?i)schedule|annex|appendix|statement of objects|preamble")
    known = F.array(*[F.lit(t) for t in topics]).cast("array<string>")
    own = tags.source_topics(F.col("source_id"))
    member = F.array_contains("topics", "membership") & ~F.concat_ws(" ", "text", "heading").rlike(r"(?i)membership|admission of (?:a |the )?members?|who may become a member")
    topic = (F.size(F.array_except("topics", known)) > 0) | (F.size(F.array_except(own, F.col("topics"))) > 0) | member
    form = filled("text").rlike(r"(?i)\bForm\s*[-–]?\s*(?:VII|VI|6|7)\b") & filled("text").rlike("(?i)" + "fil(?:e|ing)|submit|complaint|appeal|application") & (filled("form_number") == "")
    counted = (F.trim("text") == "") | (F.col("char_count") != F.length("text")) | (F.col("word_count") != words("text"))
    meta = metadata_mismatch(records, sources, "source_id", ["jurisdiction", "document_type", "authority", "relative_path", "source_url"], "retrieved_date")
    if key == "position":
        again = records.select("position", F.row_number().over(W.partitionBy("chunk_id").orderBy("position")).alias("_n")).where("_n > 1")
        twice = again.select("position", F.lit(True).alias("_twice"))
    else:
        twice = duplicate_ids(records, "chunk_id").select("chunk_id", F.lit(True).alias("_twice"))
    wrong = hierarchy_flags(records, key).select(key, F.lit(True).alias("_wrong")).distinct()
    alone = orphans(records.where("record_type = 'child'"), records.where("record_type = 'parent'").select(F.col("chunk_id").alias("parent_id")), "parent_id", "parent_id").select(key, F.lit(True).alias("_alone")).distinct()
    copies = duplicate_groups(records, key).select(key, F.lit(True).alias("_copy")).distinct()
    rows = meta.join(twice, key, "left").join(wrong, key, "left").join(alone, key, "left").join(copies, key, "left")
    flags = F.array_compact(
        F.array(
            F.when((filled(expected) == "") & ~exempt, F.lit("MISSING_STRUCTURAL_ID")), F.when(F.col("_twice"), F.lit("DUPLICATE_ID")),
            F.when(F.col("_alone"), F.lit("MISSING_PARENT")), F.when(F.col("_wrong"), F.lit("HIERARCHY_REVIEW")),
            F.when(topic, F.lit("TOPIC_TAG_REVIEW")), F.when(form, F.lit("FORM_NUMBER_MISSING")),
            F.when(~F.col("metadata_ok"), F.lit("METADATA_REVIEW")), F.when(counted, F.lit("TEXT_COUNT_ERROR")),
        )
    )
    severity = F.when((F.size("_flags") > 0) | (F.size(tags.blocking(F.col("warnings"))) > 0), "REVIEW").otherwise("INFO")
    groups = F.array_compact(F.array(
        F.when(F.col("word_count") > 900, F.lit("A_LONG")), F.when(F.col("word_count") < 20, F.lit("B_SHORT")),
        F.when(F.array_contains("warnings", "STRUCTURE_UNCERTAIN"), F.lit("E_STRUCTURE")), F.when(F.array_contains("warnings", "TABLE_REVIEW"), F.lit("F_TABLE")),
    ))
    rows = rows.withColumn("_flags", flags).withColumn("severity", severity)
    all_flags = F.array_sort(F.when(F.col("_copy"), F.array_append("_flags", F.lit("DUPLICATE_TEXT"))).otherwise(F.col("_flags")))
    return rows.select(
        *records.columns, F.array_join(all_flags, ";").alias("audit_flags"), "severity",
        F.array_join(groups, ";").alias("groups"), F.substring("text", 1, 200).alias("text_excerpt"),
    )


def with_stats(records: DataFrame, stats: DataFrame) -> DataFrame:
    """Records with the ``warning`` of their row of statistics; a record without exactly one is an error."""
    one = stats.groupBy("chunk_id").agg(F.min("warning").alias("warning"), F.count("*").alias("_rows"))
    rows = records.join(one, "chunk_id", "left")
    return rows.withColumn("_ok", F.assert_true(F.coalesce(F.col("_rows") == 1, F.lit(False)), F.lit("statistics do not match the records"))).where("_ok is null").drop("_ok", "_rows")


#: Warnings by what they are about.
STRUCTURE_WARNINGS = ("STRUCTURE_UNCERTAIN", "MALFORMED_NUMBERING_HIERARCHY", "SECTION_IDENTIFIER_MISSING", "RULE_IDENTIFIER_MISSING")
TABLE_WARNINGS = ("TABLE_REVIEW", "TABLE_DETECTION_FAILED")


def source_counters(audited: DataFrame) -> DataFrame:
    """The counters of each source over the rows of :func:`audit`, with ``warnings`` and ``severity``."""
    def has(*names: str) -> Column:
        return F.arrays_overlap("warnings", F.array(*[F.lit(n) for n in names]))

    def flagged(name: str) -> Column:
        return F.array_contains(F.split("audit_flags", ";"), name)

    several = F.array_contains("warnings", "MULTIPLE_FORMS_REVIEW").cast("int")
    return audited.groupBy("source_id").agg(
        F.count_if(F.col("record_type") == "parent").alias("parent_records"), F.count_if(F.col("record_type") == "child").alias("child_records"),
        F.count_if(F.col("word_count") < 20).alias("all_records_lt20"), F.count_if(F.col("word_count") > 900).alias("all_records_gt900"),
        F.count_if(has(*STRUCTURE_WARNINGS)).alias("structure_warnings"), F.count_if(has(*TABLE_WARNINGS)).alias("table_warnings"), F.count_if(has("DUPLICATE_TEXT")).alias("duplicate_text_warnings"),
        F.count_if(filled("heading") == "").alias("missing_heading_count"), F.count_if(flagged("MISSING_STRUCTURAL_ID")).alias("missing_structural_id_count"),
        F.count_if(flagged("MISSING_PARENT")).alias("missing_parent_count"), F.count_if(flagged("HIERARCHY_REVIEW")).alias("hierarchy_warnings"),
        F.count_if(flagged("TOPIC_TAG_REVIEW")).alias("topic_tag_warnings"), (F.count_if(flagged("FORM_NUMBER_MISSING")) + F.coalesce(F.sum(several), F.lit(0))).alias("form_number_warnings"),
        F.count_if(flagged("METADATA_REVIEW")).alias("metadata_warnings"), F.count_if(F.col("severity") == "REVIEW").alias("suspicious_chunks"),
    )


def exception_groups(audited: DataFrame, n: int = 20, key: str = "chunk_id") -> DataFrame:
    """``key, group`` of the six lists: those told by ``groups``, and the ``n`` longest and shortest."""
    told = audited.select(key, F.explode(F.split("groups", ";")).alias("group")).where("group <> ''")
    ends = [audited.orderBy(order, F.asc(key)).limit(n).select(key, F.lit(name).alias("group")) for order, name in ((F.desc("word_count"), "C_TOP20_LONG"), (F.asc("word_count"), "D_TOP20_SHORT"))]
    return told.unionByName(ends[0]).unionByName(ends[1])


def class_counts(validated: DataFrame) -> DataFrame:
    """Sources by class, advice on OCR, issues and files over a validation report."""
    kind = F.col("classification")
    return validated.agg(
        F.count("*").alias("sources"), F.count_if("file_exists").alias("files_found"), *[F.count_if(kind == k).alias(k.lower()) for k in ("TEXT_BASED", "MIXED", "LIKELY_SCANNED", "ERROR")],
        F.count_if(F.col("ocr_recommendation") == "YES").alias("ocr_required"), F.count_if(F.col("ocr_recommendation") == "PARTIAL").alias("ocr_partial"),
        F.count_if(filled("metadata_issues") != "").alias("with_issues"), F.count_if((filled("metadata_issues") != "") | (filled("errors") != "")).alias("for_review"),
    )


def usable_sources(sources: DataFrame, validated: DataFrame) -> DataFrame:
    """``source_id, reason``: null for a source that may be read, by its row of the validation report or for want of one."""
    rows = sources.select("source_id").join(validated.select("source_id", "classification", "metadata_issues", "errors", F.lit(True).alias("_there")), "source_id", "left")
    clean = (F.col("classification") == "TEXT_BASED") & (filled("metadata_issues") == "") & (filled("errors") == "")
    return rows.select("source_id", F.when(F.col("_there").isNull(), "NOT_VALIDATED").when(~F.coalesce(clean, F.lit(False)), "NOT_CLEAN").alias("reason"))


def number_breaks(rows: DataFrame, by: Sequence[str], order: Sequence[str], number: str) -> DataFrame:
    """Rows whose number is smaller than that of the row before in their group."""
    before = F.lag(number).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("previous", before).where(F.col(number) < F.col("previous"))


def suffixed_ids(rows: DataFrame, by: str, base: Column, order: str) -> DataFrame:
    """A unique id: the base, and from its second place on a counter of three digits."""
    n = F.row_number().over(W.partitionBy(by, "_base").orderBy(order))
    return rows.withColumn("_base", base).withColumn("_n", n).withColumn("unique_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.format_string("%s_%03d", "_base", "_n"))).drop("_base", "_n")

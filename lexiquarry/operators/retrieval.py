"""Scoped exact search, candidate pools, reranking and retrieval metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.functions import tags
from lexiquarry.sources import store


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, added in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm2(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """A vector over its length; null for one without length."""
    size = norm2(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))


def token_windows(records: DataFrame, key: str, text: str, header: str, tokens: int = 512, width: int = 440) -> DataFrame:
    """``key, window_no, window, weight``: the words of a text in windows that do not overlap.

    A header of at most a third of the room (64 words) stands before each window; weights are words.
    """
    head = F.slice(F.filter(F.split(F.coalesce(F.col(header), F.lit("")), r"\s+"), lambda w: w != ""), 1, min(64, tokens // 3))
    body = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = records.select(key, head.alias("_head"), body.alias("_body"))
    size = F.least(F.lit(width), F.lit(tokens) - F.size("_head"))
    rows = rows.withColumn("_size", size).withColumn("_n", F.greatest(F.ceil(F.size("_body") / F.col("_size")), F.lit(1)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.slice("_body", i * F.col("_size") + 1, F.col("_size")))
    cut = rows.select(key, "_head", F.posexplode_outer(parts).alias("window_no", "_part"))
    return cut.select(key, "window_no", F.array_join(F.concat("_head", "_part"), " ").alias("window"), F.size("_part").alias("weight"))


#: Places of a text's tokens: ``(start, end)`` by characters, in order.
Tokenizer = Callable[[str], "list[tuple[int, int]]"]
#: Tokens that a model adds of its own to a window.
SPECIAL = 8


def cut_windows(text: str, fields: str, tokenizer: Tokenizer, tokens: int, width: int, context: int, prefix: str) -> list[tuple[str, int]]:
    """The windows of a text with their tokens; without what stands before it, a text is its windows one after another."""
    places = tokenizer(text)
    count = lambda t: len(tokenizer(t))
    held: list[str] = []
    for line in fields.split("\n") if fields else ():
        if line.strip() and count("\n".join([*held, line])) <= min(context, len(places) // 3):
            held.append(line)
    before = prefix + "".join(f"{line}\n" for line in held) + "Text: "
    room = min(width, tokens - count(before) - SPECIAL)
    if room < 1:
        raise ValueError("what stands before a window leaves no room for its text")
    starts = [0, *(places[k][0] for k in range(room, len(places), room)), len(text)]
    windows = [(before + text[a:b], min(room, len(places) - k * room)) for k, (a, b) in enumerate(pairwise(starts))] if places else []
    if any(count(w) > tokens for w, _ in windows):  # a word cut in two may have more tokens
        raise ValueError("a window is longer than a model takes")
    return windows


def tokenized_windows(
    records: DataFrame, key: str, text: str, fields: str, tokenizer: Tokenizer, tokens: int = 512, width: int = 440, context: int = 64, prefix: str = "passage: "
) -> DataFrame:
    """``key, window_no, window, weight`` by the tokens of an injected tokenizer, which tells each token's place in a text.

    ``fields`` holds lines on the record, of which as many stand before each window as have at most a third of its text's tokens
    and at most ``context``. Windows do not overlap and none is longer than ``tokens``; weights are tokens. A text without tokens has
    no window. An Arrow batch is cut at a time; the tokenizer goes to the tasks once.
    """
    kind = records.schema[key].dataType.simpleString()
    name = records.schema[key].name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            at, numbers, windows, weights = [], [], [], []
            for k, (t, lines) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for n, (window, weight) in enumerate(cut_windows(t or "", lines or "", tokenizer, tokens, width, context, prefix)):
                    at.append(k)
                    numbers.append(n)
                    windows.append(window)
                    weights.append(weight)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(windows, pa.string()), pa.array(weights, pa.int32())], names=[name, "window_no", "window", "weight"])

    return records.select(key, text, fields).mapInArrow(run, f"`{name}` {kind}, window_no int, window string, weight int")


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key of a batch the weighted sum of its vectors and its weight."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found, keys = pd.factorize(batch.column(0).to_pandas(), use_na_sentinel=False)
        lists = batch.column(1)
        sizes = np.diff(lists.offsets.to_numpy())
        if len(set(sizes.tolist())) > 1:
            raise ValueError("vectors of different lengths")
        weights = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1) * weights[:, None]
        order = np.argsort(found, kind="stable")
        begins = np.flatnonzero(np.diff(found[order], prepend=-1))
        sums = np.add.reduceat(values[order], begins, axis=0)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
        own = pa.array(keys, batch.schema.field(0).type, from_pandas=True)
        yield pa.RecordBatch.from_arrays([own, vectors, pa.array(np.add.reduceat(weights[order], begins))], names=[batch.schema.names[0], "_sum", "_weight"])


def pooled(windows: DataFrame, key: str, vector: str = "vector", weight: str = "weight") -> DataFrame:
    """The weighted mean vector of each key's windows, at length 1; a window without vector takes no part.

    Windows of a key that stand in one batch are added there, so that the shuffle gets a row a key and batch, not one a window.
    """
    kind = windows.schema[key].dataType.simpleString()
    rows = windows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>"), F.col(weight).cast("double"))
    sums = rows.mapInArrow(_partial_sums, f"`{key}` {kind}, _sum array<double>, _weight double")
    parts = sums.select(key, "_weight", F.posexplode("_sum").alias("_i", "_x")).groupBy(key, "_i").agg((F.sum("_x") / F.sum("_weight")).alias("_x"))
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))  # as many as dimensions
    return whole.select(key, unit(F.col("_v._x")).alias(vector))


def hashed_embedder(dimensions: int = 384) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for an embedding model: signed hashes of words. Not equal to any model."""
    from zlib import crc32

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dimensions)
            for word in (text or "").lower().split():
                h = crc32(word.encode())
                v[h % dimensions] += 1.0 if h & 0x10000 else -1.0
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return pd.Series(out)

    return embed


def embedded(windows: DataFrame, key: str, embed: Callable[[pd.Series], pd.Series], text: str = "window") -> DataFrame:
    """Windows with the vector that ``embed`` gives each text, an Arrow batch at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "window_no": batch["window_no"], "weight": batch["weight"], "vector": embed(batch[text])})

    kind = windows.schema[key].dataType.simpleString()
    return windows.mapInPandas(run, f"{key} {kind}, window_no int, weight int, vector array<double>")


def build_index(records: DataFrame, sources: DataFrame, embed: Callable[[pd.Series], pd.Series], tokenizer: Tokenizer | None = None) -> DataFrame:
    """ACTIVE records with their vector and a preview; a record that may not be indexed is an error.

    Checked: known status, known source, jurisdiction as in the source, text, and vectors near length 1. Windows are cut by the tokens of ``tokenizer``, or by words.
    """
    rows = records.withColumn("_ok", F.assert_true(F.col("retrieval_status").isin("ACTIVE", "REFERENCE_ONLY", "REVIEW"), F.lit("unknown retrieval_status")))
    active = rows.where(F.col("_ok").isNull() & (F.col("retrieval_status") == "ACTIVE")).drop("_ok")
    dim = sources.select("source_id", F.col("jurisdiction").alias("_j"))
    checked = active.join(dim, "source_id", "left").withColumn(
        "_ok", F.assert_true(F.col("_j").eqNullSafe(F.col("jurisdiction")) & (F.trim("text") != ""), F.lit("source, jurisdiction or text of an active record")),
    ).where("_ok is null").drop("_j", "_ok")
    windows = tokenized_windows(checked, "chunk_id", "text", "heading", tokenizer) if tokenizer else token_windows(checked, "chunk_id", "text", "heading")
    vectors = pooled(embedded(windows, "chunk_id", embed), "chunk_id")
    vectors = vectors.withColumn("_ok", F.assert_true(F.coalesce(norm2("vector") >= 0.99, F.lit(False)), F.lit("a vector without length"))).where("_ok is null").drop("_ok")
    meta = checked.select(*[c for c in checked.columns if c != "text"], F.substring("text", 1, 250).alias("text_preview"))
    return meta.join(vectors, "chunk_id")


def _meet(k: int, digits: int | None, other: bool):
    def run(items: pa.Table, asked: pa.Table) -> pa.Table:
        """The best ``k`` items of the block for each question, and the best of each source."""
        schema = {"question_id": asked.schema.field("question_id").type, "item_id": items.schema.field("item_id").type, "source_id": items.schema.field("source_id").type, "scope": items.schema.field("scope").type, "score": pa.float64()}
        if not items.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], t) for c, t in schema.items()})
        matrix = np.stack(items.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
        ids, sources = items.column("item_id").to_numpy(), np.unique(np.array(items.column("source_id").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        pairs: list[tuple[int, np.ndarray, np.ndarray]] = []
        for row, (question, q) in enumerate(zip(asked.column("question_id").to_pylist(), asked.column("q").to_numpy(zero_copy_only=False), strict=True)):
            score = matrix @ np.asarray(q, dtype=np.float64)
            score = score if digits is None else np.round(score, digits)
            rows = np.flatnonzero(ids != question) if other else np.arange(len(ids))
            dense = rows[np.lexsort((ids[rows], -score[rows]))[:k]]
            order = rows[np.lexsort((ids[rows], score[rows], sources[rows]))]
            last = np.flatnonzero(np.append(sources[order][1:] != sources[order][:-1], True)) if len(order) else []
            kept = np.unique(np.concatenate((dense, order[last]))).astype(np.int64)
            pairs.append((row, kept, score[kept]))
        at = np.repeat([p[0] for p in pairs], [len(p[1]) for p in pairs])
        kept = np.concatenate([p[1] for p in pairs])
        columns = [asked.column("question_id").take(pa.array(at)), items.column("item_id").take(pa.array(kept)), items.column("source_id").take(pa.array(kept)), items.column("scope").take(pa.array(kept)), pa.array(np.concatenate([p[2] for p in pairs]))]
        return pa.table(dict(zip(schema, columns, strict=True)))

    return run


#: Items and questions that meet in one task.
ITEMS, ASKED = 8192, 1024


def best_scored(questions: DataFrame, items: DataFrame, k: int, digits: int | None = None, other: bool = False) -> DataFrame:
    """``question_id, item_id, source_id, scope, score`` of the items that a question may see, as far as a top ``k`` or a pool of candidates can need them.

    ``questions (question_id, allowed array, q)``, ``items (item_id, scope, source_id, v)``; no list of all pairs is made.

    The items of each scope are dealt in blocks, the questions that may see it in parts; each pair is one matrix
    product, of which the best ``k`` and the best of each source come out. ``other`` leaves out the item that has the
    question's id; scores are rounded to ``digits`` before they are compared.
    """
    items = items.where("v is not null").select("item_id", "scope", "source_id", "v")
    asked = questions.where("q is not null").select("question_id", "q", F.explode("allowed").alias("scope"))
    size = items.groupBy("scope").agg(F.ceil(F.count("*") / ITEMS).cast("int").alias("blocks"))  # a row a scope
    many = asked.groupBy("scope").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    plan = size.join(many, "scope")
    dealt = items.join(F.broadcast(plan), "scope").withColumn("block", F.expr("cast(pmod(xxhash64(item_id), blocks) as int)")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    met = asked.join(F.broadcast(plan), "scope").withColumn("part", F.expr("cast(pmod(xxhash64(question_id), parts) as int)")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")
    by = ["scope", "block", "part"]
    kinds = {c: (questions if c == "question_id" else items).schema[c].dataType.simpleString() for c in ("question_id", "item_id", "source_id", "scope")}
    return dealt.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(_meet(k, digits, other), ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", score double")


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores of each question; ties to the smaller id."""
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("item_id")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def candidate_pool(hits: DataFrame, k: int = L.DENSE) -> DataFrame:
    """The top ``k`` and, of each source not among them, its best item (ties to the larger id).

    With ``max_similarity``, the best score of the pool.
    """
    by = W.partitionBy("question_id")
    rows = hits.withColumn("_rank", F.row_number().over(by.orderBy(F.desc("score"), F.asc("item_id"))))
    of = W.partitionBy("question_id", "source_id")
    rows = rows.withColumn("_seen", F.min("_rank").over(of) <= k).withColumn("_place", F.row_number().over(of.orderBy(F.desc("score"), F.desc("item_id"))))
    pool = rows.where((F.col("_rank") <= k) | (~F.col("_seen") & (F.col("_place") == 1)))
    return pool.withColumn("max_similarity", F.max("score").over(by)).drop("_rank", "_seen", "_place")


def rerank(pool: DataFrame, k: int = L.TOP) -> DataFrame:
    """The ``k`` best of each pool by similarity, topics, heading and a bonus for the first of a source.

    ``pool (question_id, item_id, source_id, score, topic, heading, boost)``. Greedy choice with the bonus
    equals one sort: a source's best item with the bonus is its first pick, others never get it.
    """
    base = F.lit(L.SEMANTIC) * F.col("score") + F.lit(L.TOPIC) * F.col("topic") + F.lit(L.HEADING) * F.col("heading")
    first = base + F.lit(L.DIVERSITY) * F.lit(1.0) + F.col("boost")
    later = base + F.lit(L.DIVERSITY) * F.lit(0.0) + F.col("boost")
    place = F.row_number().over(W.partitionBy("question_id", "source_id").orderBy(F.desc("_first"), F.desc("score"), F.desc("item_id")))
    rows = pool.withColumn("_first", first).withColumn("_later", later).withColumn("_place", place)
    rows = rows.withColumn("rerank_score", F.when(F.col("_place") == 1, F.col("_first")).otherwise(F.col("_later"))).withColumn("diversity", F.when(F.col("_place") == 1, 1.0).otherwise(0.0))
    rank = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("rerank_score"), F.desc("score"), F.desc("item_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("_first", "_later", "_place")


def rerank_features(pool: DataFrame, question: str = "question", topics: str = "topics", heading: str = "heading_text") -> DataFrame:
    """``topic, heading, boost`` of question and record texts."""
    asked, titled = tags.query_topics(F.col(question)), tags.query_topics(F.col(heading))
    size = F.greatest(F.size("_asked"), F.lit(1))
    procedural = F.array(*[F.lit(t) for t in L.PROCEDURAL_TOPICS])
    hit = F.arrays_overlap(F.coalesce(F.col(topics), F.array().cast("array<string>")), procedural) | F.arrays_overlap("_titled", procedural)
    rows = pool.withColumn("_asked", asked).withColumn("_titled", titled)
    return (
        rows.withColumn("topic", F.size(F.array_intersect("_asked", topics)) / size)
        .withColumn("heading", F.size(F.array_intersect("_asked", "_titled")) / size)
        .withColumn("boost", F.when(tags.procedural(F.col(question)) & hit, L.PROCEDURAL).otherwise(0.0))
        .drop("_asked", "_titled")
    )


def hit_summary(results: DataFrame, questions: DataFrame, low: float = L.LOW_SIMILARITY) -> DataFrame:
    """Per question: hits at 1, 3 and 5, leakage, violation, best similarity of the pool, abstention.

    ``results`` are those of a reranked :func:`candidate_pool`, with its ``max_similarity``.

    ``questions (question_id, expected array, forbidden array, allowed array, should_answer, require_all)``.
    """
    found = results.groupBy("question_id").agg(
        *[F.collect_set(F.when(F.col("rank") <= k, F.col("source_id"))).alias(f"s{k}") for k in (1, 3, 5)],
        F.collect_set("scope").alias("scopes"), F.count("*").alias("result_count"), F.max("max_similarity").alias("max_similarity"),
    )
    rows = questions.join(found, "question_id", "left")
    empty = F.array().cast("array<string>")

    def match(k: int) -> Column:
        have = F.coalesce(F.col(f"s{k}"), empty)
        wanted = F.coalesce(F.col("expected"), empty)
        yes = F.when(F.size(wanted) == 0, False).when(F.col("require_all"), F.size(F.array_except(wanted, have)) == 0).otherwise(F.size(F.array_intersect(wanted, have)) > 0)
        return F.when(F.col("should_answer"), yes).alias(f"top{k}_match")

    s5, scopes = F.coalesce("s5", empty), F.coalesce("scopes", empty)
    return rows.select(
        "question_id", "should_answer", *[match(k) for k in (1, 3, 5)],
        (F.size(F.array_intersect(s5, F.coalesce("forbidden", empty))) > 0).alias("forbidden_found"),
        (F.size(F.array_except(scopes, F.coalesce("allowed", empty))) > 0).alias("violation"),
        "max_similarity", F.coalesce("result_count", F.lit(0)).alias("result_count"),
        (F.col("max_similarity").isNull() | (F.col("max_similarity") < low)).alias("abstention_candidate"),
        F.when(F.col("max_similarity").isNull(), "NO_RESULTS").when(F.col("max_similarity") < low, "LOW_SIMILARITY").otherwise("ABOVE_UNCALIBRATED_THRESHOLD").alias("abstention_reason"),
    )


def retrieval_metrics(summary: DataFrame) -> DataFrame:
    """Hit rates over answerable questions (null without any), leakage and violation rates over all."""
    return summary.agg(
        *[F.avg(F.when(F.col("should_answer"), F.col(f"top{k}_match").cast("double"))).alias(f"top{k}_source_hit_rate") for k in (1, 3, 5)],
        F.avg(F.col("violation").cast("double")).alias("jurisdiction_violation_rate"),
        F.avg(F.col("forbidden_found").cast("double")).alias("forbidden_source_leakage_rate"),
        F.count_if("abstention_candidate").alias("abstention_candidates"),
        F.count("*").alias("questions"),
    )


def reviewed(summary: DataFrame, reviews: DataFrame) -> DataFrame:
    """The assessment of a manual review where it was made for the same question and the same chunks in order."""
    known = reviews.select("question_id", "question_hash", "chunk_ids", "support_assessment")
    return summary.join(known, ["question_id", "question_hash", "chunk_ids"], "left").withColumn("support_assessment", F.when(~F.col("should_answer"), F.col("support_assessment"))).fillna("NOT_AUTOMATICALLY_VERIFIED", ["support_assessment"])


def retrieved(questions: DataFrame, index: DataFrame, embed: Callable[[pd.Series], pd.Series], k: int = L.TOP, dense: int = L.DENSE, prefix: str = "query: ") -> DataFrame:
    """``question_id, chunk_id, rank, score, rerank_score`` for ``questions (question_id, question, jurisdiction)``.

    Scope, dense candidates with one of each other source, rerank, slice. ``index`` is that of :func:`build_index` and has
    ``topics`` and ``heading``.
    """
    allowed = tags.allowed_jurisdictions(F.col("jurisdiction"), F.col("question"))
    asked = questions.select("question_id", "question", allowed.alias("allowed"))
    texts = asked.select("question_id", F.lit(0).alias("window_no"), F.concat(F.lit(prefix), "question").alias("window"), F.lit(1).alias("weight"))
    vectors = embedded(texts, "question_id", embed).select("question_id", unit(F.col("vector")).alias("q"))
    number = F.xxhash64("chunk_id")
    items = index.select(number.alias("item_id"), F.col("jurisdiction").alias("scope"), "source_id", F.col("vector").alias("v"))
    pool = candidate_pool(best_scored(asked.join(vectors, "question_id").where("allowed is not null"), items, dense), dense)
    told = index.select(number.alias("item_id"), "chunk_id", "topics", F.col("heading").alias("heading_text"))
    ready = rerank_features(pool.join(told, "item_id").join(asked.select("question_id", "question"), "question_id"))
    return rerank(ready, k).select("question_id", "chunk_id", "rank", "score", "rerank_score")


def index_counts(records: DataFrame, tokens: int = 512, width: int = 440) -> DataFrame:
    """Records in all, left out and active ones, their windows, records of several windows, and sources."""
    active = F.col("retrieval_status") == "ACTIVE"
    windows = token_windows(records.where(active), "chunk_id", "text", "heading", tokens, width).groupBy("chunk_id").agg(F.count("*").alias("windows"))
    rows = records.select("chunk_id", "source_id", active.alias("active")).join(windows, "chunk_id", "left")
    return rows.agg(
        F.count("*").alias("total_records"), F.count_if(~F.col("active")).alias("records_excluded"), F.count_if("active").alias("active_records_indexed"),
        F.coalesce(F.sum("windows"), F.lit(0)).alias("embedding_windows"), F.count_if(F.col("windows") > 1).alias("multi_window_chunks"), F.count_distinct(F.when(F.col("active"), F.col("source_id"))).alias("sources_represented"),
    )


def stored_index(spark: SparkSession, folder: str, records: DataFrame, sources: DataFrame, embed: Callable[[pd.Series], pd.Series], signature: str, force: bool = False) -> tuple[DataFrame, bool]:
    """The index under a folder if its manifest has ``signature``, else a new one that is written there; and which."""
    return store.reused(spark, folder, signature, lambda: build_index(records, sources, embed), force)

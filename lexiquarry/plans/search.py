"""Queries on vectors: scoped search, candidate pools, reranking, packing and metrics.

Questions are the vectors whose id 50 divides; a vector's label is its scope and source group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import lexicon as L
from lexiquarry.operators import answers
from lexiquarry.operators import retrieval as R
from lexiquarry.plans.common import registry, table

QUERIES, ORACLE_SQL, query = registry()


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("item_id"), F.col("label").alias("scope"), F.concat(F.lit("s"), (F.col("vec_id") % 7).cast("string")).alias("source_id"), F.col("embedding").alias("v"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return rows.select(F.col("vec_id").alias("question_id"), F.array("label", F.col("label") + 1, F.col("label") + 2).alias("allowed"), F.col("embedding").alias("q"))


def hits(spark, sf_dir) -> DataFrame:
    """What the best fifteen and a pool of candidates need, of all pairs in scope."""
    return R.best_scored(questions(spark, sf_dir), items(spark, sf_dir), L.DENSE, digits=9, other=True)


_HITS = """
i AS (SELECT vec_id AS item_id, label AS scope, 's' || CAST(vec_id % 7 AS VARCHAR) AS source_id, embedding AS v FROM embeddings),
q AS (SELECT vec_id AS question_id, label, embedding AS q FROM embeddings WHERE vec_id % 50 = 0),
h AS (SELECT question_id, item_id, source_id, scope, round(list_reduce(list_transform(list_zip(q, v), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)), lambda a, b: a + b), 9) AS score
      FROM q JOIN i ON i.scope BETWEEN q.label AND q.label + 2 WHERE item_id <> question_id)
"""
_POOL = f"""
{_HITS}, d AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS n FROM h) WHERE n <= {L.DENSE}),
rest AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY question_id, source_id ORDER BY score DESC, item_id DESC) AS n FROM h
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.question_id = h.question_id AND d.source_id = h.source_id)) WHERE n = 1),
pool AS (SELECT * FROM d UNION ALL SELECT * FROM rest)
"""
_RERANK = f"""
{_POOL}, f AS (SELECT *, (item_id % 3) / 3.0 AS topic, (item_id % 2) / 2.0 AS heading, CASE WHEN item_id % 5 = 0 THEN 0.04 ELSE 0.0 END AS boost FROM pool),
g AS (SELECT *, 0.58 * score + 0.22 * topic + 0.15 * heading + 0.05 * 1.0 + boost AS s1, 0.58 * score + 0.22 * topic + 0.15 * heading + 0.05 * 0.0 + boost AS s0 FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, source_id ORDER BY s1 DESC, score DESC, item_id DESC) AS place FROM g),
e AS (SELECT *, CASE WHEN place = 1 THEN s1 ELSE s0 END AS rerank_score FROM k),
top AS (SELECT question_id, item_id, source_id, scope, score, rerank_score, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, score DESC, item_id DESC) AS rank FROM e)
"""


@query(f"WITH {_HITS} SELECT question_id, item_id, scope, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM h) WHERE rank <= 10")
def scoped_topk(spark, sf_dir):
    """Each question's ten best vectors of the scopes it may see."""
    return R.top_k(hits(spark, sf_dir), 10).select("question_id", "item_id", "scope", "score", "rank")


def _pool(spark, sf_dir) -> DataFrame:
    return R.candidate_pool(hits(spark, sf_dir))


@query(f"WITH {_POOL} SELECT question_id, item_id, source_id, score FROM pool")
def candidate_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("question_id", "item_id", "source_id", "score")


def _top(spark, sf_dir) -> DataFrame:
    rows = _pool(spark, sf_dir).withColumn("topic", F.col("item_id") % 3 / 3.0).withColumn("heading", F.col("item_id") % 2 / 2.0).withColumn("boost", F.when(F.col("item_id") % 5 == 0, L.PROCEDURAL).otherwise(0.0))
    return R.rerank(rows)


@query(f"WITH {_RERANK} SELECT question_id, item_id, source_id, round(rerank_score, 6) AS rerank_score, rank FROM top WHERE rank <= 5")
def rerank_top5(spark, sf_dir):
    return _top(spark, sf_dir).select("question_id", "item_id", "source_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


def _labelled(spark, sf_dir) -> DataFrame:
    """Questions with labels: they expect their own group (some also the one after the next), forbid the next, every tenth
    has no answer, and some may see fewer scopes than were searched."""
    s = lambda k: F.array(F.concat(F.lit("s"), ((F.col("question_id") + k) % 7).cast("string")))
    rows = questions(spark, sf_dir)
    both = F.col("question_id") % 150 == 0
    allowed = F.when(F.col("question_id") % 200 == 100, F.slice("allowed", 1, 1)).otherwise(F.col("allowed"))
    expected = F.when(both, F.concat(s(0), s(2))).otherwise(s(0))
    return rows.select("question_id", allowed.alias("allowed"), expected.alias("expected"), s(1).alias("forbidden"), (F.col("question_id") % 500 != 0).alias("should_answer"), both.alias("require_all"))


#: Similarity below which a question is a candidate for abstention; the vectors here are less alike than those of a model.
LOW = 0.35
_OWN = "'s' || CAST((q.question_id + {}) % 7 AS VARCHAR)"
_MATCH = "bool_or(r.rank <= {k} AND r.source_id = " + _OWN.format(0) + ") AND (q.question_id % 150 <> 0 OR bool_or(r.rank <= {k} AND r.source_id = " + _OWN.format(2) + "))"
_SUMMARY = f"""
{_RERANK}, r AS (SELECT * FROM top WHERE rank <= 5), m AS (SELECT question_id, max(score) AS max_similarity FROM pool GROUP BY question_id),
z AS (SELECT q.question_id, q.question_id % 500 <> 0 AS should_answer, {_MATCH.format(k=1)} AS a1, {_MATCH.format(k=3)} AS a3, {_MATCH.format(k=5)} AS a5, bool_or(r.source_id = {_OWN.format(1)}) AS fb,
  bool_or(q.question_id % 200 = 100 AND r.scope <> q.label) AS broken, count(r.item_id) AS n
  FROM q LEFT JOIN r ON r.question_id = q.question_id GROUP BY q.question_id),
summary AS (SELECT z.question_id, should_answer, CASE WHEN should_answer THEN coalesce(a1, false) END AS top1_match, CASE WHEN should_answer THEN coalesce(a3, false) END AS top3_match,
  CASE WHEN should_answer THEN coalesce(a5, false) END AS top5_match, coalesce(fb, false) AS forbidden_found, coalesce(broken, false) AS violation, max_similarity, n AS result_count,
  max_similarity IS NULL OR max_similarity < {LOW} AS abstention_candidate, CASE WHEN max_similarity IS NULL THEN 'NO_RESULTS' WHEN max_similarity < {LOW} THEN 'LOW_SIMILARITY' ELSE 'ABOVE_UNCALIBRATED_THRESHOLD' END AS abstention_reason
  FROM z LEFT JOIN m ON m.question_id = z.question_id)
"""


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def hit_summary(spark, sf_dir):
    return R.hit_summary(_top(spark, sf_dir), _labelled(spark, sf_dir), LOW)


@query(f"""
WITH {_SUMMARY} SELECT round(avg(CASE WHEN should_answer THEN CAST(top1_match AS INTEGER) END), 9) AS top1_source_hit_rate, round(avg(CASE WHEN should_answer THEN CAST(top3_match AS INTEGER) END), 9) AS top3_source_hit_rate,
 round(avg(CASE WHEN should_answer THEN CAST(top5_match AS INTEGER) END), 9) AS top5_source_hit_rate, round(avg(CAST(violation AS INTEGER)), 9) AS jurisdiction_violation_rate,
 round(avg(CAST(forbidden_found AS INTEGER)), 9) AS forbidden_source_leakage_rate, count(*) FILTER (abstention_candidate) AS abstention_candidates, count(*) AS questions FROM summary
""")
def hit_rates(spark, sf_dir):
    rows = R.retrieval_metrics(hit_summary(spark, sf_dir))
    return rows.select(*[F.round(c, 9).alias(c) if c.endswith("rate") else F.col(c) for c in rows.columns])


@query(f"""
WITH RECURSIVE {_HITS}, t AS (SELECT question_id, item_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM h) WHERE rank <= 15),
e AS (SELECT t.question_id, t.item_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, d.n_chars AS size FROM t JOIN documents d ON d.doc_id = t.item_id),
p AS (
  SELECT question_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, false AS shut, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS item_id, false AS truncated, false AS took FROM (SELECT DISTINCT question_id FROM e)
  UNION ALL
  SELECT e.question_id, e.rank, CASE WHEN NOT p.shut AND p.used + e.size <= 12000 THEN p.used + e.size WHEN NOT p.shut AND p.place = 0 THEN 12000 ELSE p.used END,
    p.shut OR (p.used + e.size > 12000 AND p.place = 0), p.place + CASE WHEN NOT p.shut AND (p.used + e.size <= 12000 OR p.place = 0) THEN 1 ELSE 0 END,
    e.item_id, NOT p.shut AND p.used + e.size > 12000 AND p.place = 0, NOT p.shut AND (p.used + e.size <= 12000 OR p.place = 0)
  FROM p JOIN e ON e.question_id = p.question_id AND e.rank = p.rank + 1
)
SELECT question_id, item_id, place, truncated FROM p WHERE took
""")
def evidence_pack(spark, sf_dir):
    """Documents of the best fifteen hits that fit the evidence budget."""
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("size"))
    rows = R.top_k(hits(spark, sf_dir), 15).join(sizes, "item_id")
    return answers.packed(rows, "size").select("question_id", "item_id", "place", "truncated")


@query(f"""
WITH {_RERANK}, used AS (SELECT question_id, item_id FROM top WHERE rank <= 3), supplied AS (SELECT question_id, item_id FROM d)
SELECT used.question_id, used.item_id, supplied.item_id IS NOT NULL AS supplied FROM used LEFT JOIN supplied USING (question_id, item_id)
""")
def citation_check(spark, sf_dir):
    """Whether what the best three cite was among the dense hits."""
    used = _top(spark, sf_dir).where("rank <= 3").select("question_id", "item_id")
    return answers.citations(used, R.top_k(hits(spark, sf_dir), L.DENSE), "question_id", "item_id").select("question_id", "item_id", "supplied")


@query("""
WITH u AS (SELECT vec_id, label, unnest(generate_series(1, len(embedding))) AS i, embedding FROM embeddings),
p AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE) * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1) AS x FROM u GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS size FROM p GROUP BY label)
SELECT p.label, CAST(p.i - 1 AS INTEGER) AS i, round(x / size, 6) AS x FROM p JOIN n ON n.label = p.label
""")
def pooled_vectors(spark, sf_dir):
    """The weighted mean vector of each label, at length 1."""
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5 + 1).alias("weight"), F.col("embedding").alias("vector"))
    return R.pooled(rows, "label").select("label", F.posexplode("vector").alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""
WITH r AS (SELECT l.doc_id AS question_id, l.quality = 1 AS should_answer, l.toxic = 1 AS abstained, d.lang <> 'de' AS citation_ok, CAST(l.doc_id % 3 = 0 AS INTEGER) AS warnings,
  d.source = 'src3' AS violation, d.source = 'src4' AS leak, CASE WHEN d.n_chars < 300 THEN 'HTTP_413' END AS failure, CASE WHEN l.toxic = 1 THEN 'NOT_CALLED' ELSE 'PASS' END AS api_status
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT count(*) AS total_questions, count(*) FILTER (should_answer) AS answerable_questions, count(*) FILTER (NOT should_answer) AS abstention_questions,
  count(*) FILTER (abstained = NOT should_answer) AS correct_behavior_count, round(avg(CAST(abstained = NOT should_answer AS INTEGER)), 9) AS correct_behavior_rate,
  count(*) FILTER (NOT citation_ok) AS citation_validation_failures, count(*) FILTER (warnings > 0) AS unsupported_claim_warnings, count(*) FILTER (violation) AS jurisdiction_violations,
  count(*) FILTER (leak) AS forbidden_source_leakage, count(*) FILTER (failure IS NOT NULL AND api_status <> 'NOT_CALLED') AS api_failures_after_retries,
  count(*) FILTER (abstained <> NOT should_answer OR NOT citation_ok OR warnings > 0 OR violation OR leak OR failure IS NOT NULL) AS failed FROM r
""")
def rag_metrics(spark, sf_dir):
    """Labels as judged answers."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("should_answer"), (F.col("toxic") == 1).alias("abstained"), (F.col("lang") != "de").alias("citation_ok"),
        (F.col("doc_id") % 3 == 0).cast("int").alias("warnings"), (F.col("source") == "src3").alias("violation"), (F.col("source") == "src4").alias("leak"),
        F.when(F.col("n_chars") < 300, "HTTP_413").alias("failure"), F.when(F.col("toxic") == 1, "NOT_CALLED").otherwise("PASS").alias("api_status"),
    )
    found = answers.rag_metrics(rows)
    return found.withColumn("correct_behavior_rate", F.round("correct_behavior_rate", 9))

"""Registered queries: inputs, profiles, panels, answer checks, evidence matching, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.plan import stored
from corvane.operators import answers, dense, evaluation, rules
from corvane.operators.rules import ATTRIBUTES
from corvane.plans.common import BRIEFS_SQL, briefs, query_vectors, t, vectors
from corvane.plans.evidence import _any, _lit
from corvane.plans.retrieval import _dense_sql
from corvane.plans.routing import CHOSEN
from corvane.sources import store

TAILS = (
    "Agentic reasoning trace [E1]. Decision rationale. Tradeoffs. Validation.", "agentic reasoning trace, decision rationale, tradeoff, validate", "see corpus/x", "A12: gated [E2]",
    "agentic reasoning trace [E3] tradeoff validate", "[E4] decision rationale", "chunk_id 7", "agentic reasoning trace [E5] decision rationale validated",
)


def flt14_input_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", answers.input_issue("Brief", F.col("text"), 4000).alias("issue"))


def rul18_parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('{"A1": "'), F.col("role"), F.lit('", "A2": " "}'))).otherwise(F.concat(F.lit("A1 = x\nA3= \nnone\nA4=a=b\nA1="), F.col("role")))
    parsed = answers.parse_answers(text)
    return c.select("conv_id", "turn", F.try_element_at(parsed, F.lit("A1")).alias("a1"), F.try_element_at(parsed, F.lit("A4")).alias("a4"), F.size(parsed).alias("n"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.resolve(briefs(spark, sf_dir)).filter("domain IS NOT NULL")
    kept = r.select("brief_id", "brief", "pending", "conflict", *(F.col(f"{a}.value").alias(a.lower()) for a in ATTRIBUTES))
    return rules.select_topology(kept)


def rul15_plan_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("brief_id", answers.plan_profile(F.col("brief"), F.col("a8"), F.col("a3")).alias("profile"))


def rul13_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.panel(_state(spark, sf_dir)).withColumn("seq", F.col("seq").cast("long"))


def flt13_answer_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % len(TAILS)).cast("int"))
    return d.select("doc_id", answers.answer_issue(F.concat_ws(" ", "text", tail)).alias("issue"))


def rul20_critique(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(answers.critique(F.when(F.col("doc_id") % 3 > 0, F.col("text")), F.col("doc_id") % 2), "|").alias("gaps"))


def flt10_evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    hit = answers.matches_evidence(F.col("source"), F.col("lang"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "src2"), F.array(F.lit("E")), F.array(F.lit("The"), F.lit("on")))
    return d.select("doc_id", hit.alias("matches"))


def evl9_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.percentile_nearest("value", 0.5).alias("p50"), evaluation.percentile_nearest("value", 0.99).alias("p99"))
    return answers.slo(e, 20.0, 90.0)


def evl8_dimension_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of truncated vectors against whole ones, by dimension."""
    q, v = query_vectors(spark, sf_dir), vectors(spark, sf_dir)
    whole = stored(dense.search(q, v, 10).select("query_id", "chunk_ord", F.lit(1).alias("hit")), "whole")

    def run(config: dict) -> DataFrame:
        short = dense.search(q, v, 10, dimension=config["dimension"]).select("query_id", "chunk_ord")
        hits = short.join(whole, ["query_id", "chunk_ord"], "left")
        return hits.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("value")).select(F.lit("recall_at_10").alias("metric"), "value")

    return evaluation.ablation([{"dimension": d} for d in (64, 32, 16)], run)


def agg17_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def jn7_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "source")


def jn8_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def agg15_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text, in doc_id order."""
    d = t(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def set3_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id").subtract(t(spark, sf_dir, "labels").select("doc_id"))


def set4_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id").intersect(t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))


def src18_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bundles of two files, split again."""
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    text = F.concat(F.lit("# file: a/"), F.col("page_id").cast("string"), F.lit(".tf\n"), "url", F.lit("\n# file: b.tf\nx = 1\n"))
    return store.sections(p.select(text.alias("text"))).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        flt14_input_limits, rul18_parse_answers, rul15_plan_profile, rul13_panel, flt13_answer_guard, rul20_critique, flt10_evidence_match,
        evl9_slo, evl8_dimension_ablation, agg17_profile, jn7_semi_join, jn8_anti_join, agg15_ordered_distinct, set3_except, set4_intersect, src18_sections,
    )
}

_TAILS = "[" + ", ".join(map(_lit, TAILS)) + "]"
_GUARD = "CASE " + " ".join(
    [f"WHEN contains(a, {_lit(m)}) THEN {_lit(f'''generated answer exposed internal marker '{m}' '''.strip())}" for m in answers.FORBIDDEN]
    + [r"WHEN regexp_matches(a, '\bA(?:1[0-2]|[1-9])\s*(?::|=)') THEN 'generated answer exposed raw attribute codes'", r"WHEN NOT regexp_matches(a, '\[E\d+\]') THEN 'generated answer omitted evidence labels'"]
    + [f"WHEN NOT contains(lower(a), {_lit(n)}) THEN {_lit(m)}" for n, m in answers.REQUIRED]
) + " END"
_CONFLICT = "CASE WHEN a4 = 'sectoral' AND a5 = 'regulated-personal' AND " + _any("lower(brief)", rules.EXTERNAL) + " THEN 'A4, A5' WHEN a1 = 'catastrophic' AND a8 = 'strict' THEN 'A1, A8' END"
STATE = f"{CHOSEN}, full8 AS (SELECT w.*, c.topology, b.brief FROM wide w JOIN (SELECT brief_id, topology FROM chosen) c USING (brief_id) JOIN briefs b USING (brief_id)), st8 AS (SELECT *, {_CONFLICT} AS conflict FROM full8)"
_ITEMS = (
    ("true", "strength", "topology", "topology"), ("a2 = 'high'", "strength", "A2", "'high'"), ("contains(topology, 'rerank') OR topology = 'adaptive_agentic'", "strength", "A3", "coalesce(a3, 'inferred')"),
    ("a5 IN ('regulated-personal', 'internal')", "weakness", "A5", "a5"), ("a7 = 'fast-moving'", "weakness", "A7", "a7"), ("a8 = 'strict'", "weakness", "A8", "a8"),
    ("a11 IN ('mandatory', 'recommended')", "strength", "A11", "a11"), ("a12 = 'gated'", "weakness", "A12", "a12"), ("pending <> ''", "weakness", "pending", "replace(pending, ',', ', ')"),
    ("conflict IS NOT NULL", "weakness", "conflict", "conflict"),
)

ORACLE_SQL = {
    "flt14_input_limits": "SELECT doc_id, CASE WHEN length(text) > 4000 THEN 'Brief is too long. Limit it to 4000 characters.' END AS issue FROM documents",
    "rul18_parse_answers": "SELECT conv_id, turn, role AS a1, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'a=b' END AS a4, CASE WHEN turn % 2 = 0 THEN 1 ELSE 2 END AS n FROM conversations",
    "rul15_plan_profile": f"WITH {STATE} SELECT brief_id, CASE WHEN {_any('lower(brief)', answers.ACCURACY)} OR coalesce(a8 = 'relaxed', false) THEN 'accuracy_first' WHEN {_any('lower(brief)', answers.LATENCY)} OR (coalesce(a8 = 'strict', false) AND coalesce(a3 <> 'multi-hop', true)) THEN 'latency_first' ELSE 'balanced' END AS profile FROM st8",
    "rul13_panel": f"WITH {STATE}, items AS (" + " UNION ALL ".join(f"SELECT brief_id, {i} AS n, '{k}' AS kind, '{a}' AS attr, {r} AS requirement FROM st8 WHERE {c}" for i, (c, k, a, r) in enumerate(_ITEMS)) + ") SELECT brief_id, row_number() OVER (PARTITION BY brief_id ORDER BY n) - 1 AS seq, kind, attr, requirement FROM items",
    "flt13_answer_guard": f"WITH d AS (SELECT doc_id, text || ' ' || ({_TAILS})[1 + doc_id % {len(TAILS)}] AS a FROM documents) SELECT doc_id, {_GUARD} AS issue FROM d",
    "rul20_critique": "SELECT doc_id, concat_ws('|', CASE WHEN doc_id % 3 = 0 OR text = '' THEN 'No draft output was produced.' END, CASE WHEN doc_id % 2 = 0 THEN 'Decision log is empty.' END) AS gaps FROM documents",
    "flt10_evidence_match": "SELECT doc_id, (doc_id % 2 <> 0 OR source = 'src2') AND contains(lower(lang), 'e') AND contains(lower(text), 'the') AND contains(lower(text), 'on') AS matches FROM documents",
    "evl9_slo": "WITH p AS (SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1) SELECT *, concat_ws(',', CASE WHEN p50 > 20 THEN 'p50' END, CASE WHEN p99 > 90 THEN 'p99' END) AS failures, NOT (p50 > 20 OR p99 > 90) AS ok FROM p",
    "evl8_dimension_ablation": "WITH " + ", ".join(_dense_sql(f"d{d}", 10, d) for d in (64, 32, 16)) + "".join(f"{' UNION ALL' if d < 64 else ''} SELECT {d} AS dimension, 'recall_at_10' AS metric, round(avg(CASE WHEN EXISTS (SELECT 1 FROM d64 w WHERE w.query_id = s.query_id AND w.vec_id = s.vec_id) THEN 1 ELSE 0 END), 6) AS value FROM d{d} s" for d in (64, 32, 16)),
    "agg17_profile": "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
    "jn7_semi_join": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "jn8_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "agg15_ordered_distinct": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "set3_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set4_intersect": "SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings",
    "src18_sections": "SELECT 'a/' || page_id || '.tf' AS path, 1::BIGINT AS n, length(url) + 1 AS chars FROM pages UNION ALL SELECT 'b.tf', count(*), 6 * count(*) FROM pages",
}

"""Checks and projections around an answer: input limits, follow-up answers, plan profile, panel, guard, evidence matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import lexical

# Marks that an answer must not show, and what it must have, in the order of the checks.
FORBIDDEN = ("corpus_", "corpus/", ".md", "router:start", "Graph Trace", "Requirement Vector", "source_id", "source_ids", "chunk_id", "two_stage_")
ATTRIBUTE_CODE = r"\bA(?:1[0-2]|[1-9])\s*(?::|=)"
EVIDENCE_LABEL = r"\[E\d+\]"
REQUIRED = (
    ("agentic reasoning trace", "generated answer omitted the agentic reasoning trace"),
    ("decision rationale", "generated answer omitted the decision rationale"),
    ("tradeoff", "generated answer omitted accepted tradeoffs"),
    ("validat", "generated answer omitted validation guidance"),
)
ACCURACY = ("maximal accuracy", "maximum accuracy", "highest accuracy", "best possible answer", "accuracy over latency", "quality over speed", "most accurate")
LATENCY = ("sub-second", "low latency", "fast response", "real-time", "interactive latency")

# Focus text of each specialist's query.
FOCUS = {
    "retrieval": "production hybrid RAG pipeline BM25 dense RRF cross encoder rerank exact terminology two-stage",
    "security": "RBAC permission-aware retrieval ACL propagation pre-filter post-filter audit lineage",
    "cloud_iac": "embedding dimension lower higher storage recall quality vector search blue-green dimension changes managed vector options model endpoints observability",
    "evaluation": "RAG evaluation gold set retrieval metrics nDCG MRR citation latency percentiles CI",
}


def input_issue(label: str, text: Column, limit: int) -> Column:
    """Message for a text over its limit, else null."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) > max(1, limit), f"{label} is too long. Limit it to {max(1, limit)} characters.")


def parse_answers(text: Column) -> Column:
    """Map of follow-up answers: a JSON object, or lines `key=value`; blank keys and values are left out, later lines win."""
    s = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(s, r"\r?\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]).alias("key"), F.trim(F.split(x, "=", 2)[1]).alias("value")))
    kept = F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != ""))
    last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["key"] == p["key"]))
    parsed = F.map_filter(F.from_json(s, "map<string,string>"), lambda k, v: F.trim(v) != "")
    return F.when(s.startswith("{"), parsed).otherwise(F.map_from_entries(last))


def plan_profile(brief: Column, latency: Column, complexity: Column) -> Column:
    """accuracy_first, latency_first or balanced."""
    text = F.lower(F.coalesce(brief, F.lit("")))
    fast = T.has_any(text, LATENCY) | (F.coalesce(latency == "strict", F.lit(False)) & F.coalesce(complexity != "multi-hop", F.lit(True)))
    return F.when(T.has_any(text, ACCURACY) | F.coalesce(latency == "relaxed", F.lit(False)), "accuracy_first").when(fast, "latency_first").otherwise("balanced")


def answer_issue(answer: Column) -> Column:
    """The first fault of an answer, else null."""
    low = F.lower(answer)
    out = F.lit(None).cast("string")
    for needle, message in reversed(REQUIRED):
        out = F.when(~low.contains(needle), message).otherwise(out)
    out = F.when(~answer.rlike(EVIDENCE_LABEL), "generated answer omitted evidence labels").otherwise(out)
    out = F.when(answer.rlike(ATTRIBUTE_CODE), "generated answer exposed raw attribute codes").otherwise(out)
    for mark in reversed(FORBIDDEN):
        out = F.when(answer.contains(mark), f"generated answer exposed internal marker '{mark}'").otherwise(out)
    return out


#: Columns of a research link that are shown.
PUBLIC_LINK = ("agent", "label", "url", "source_type", "relevance")


def public(rows: DataFrame, columns: tuple[str, ...], url: str | None = None) -> DataFrame:
    """What may be shown: the listed columns that rows have, the others null, and only rows with a web address in `url` if that is given."""
    shown = rows.filter(F.coalesce(F.col(url).startswith("http"), F.lit(False))) if url else rows
    return shown.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))


def leaks(text: Column) -> Column:
    """Internal marks that a text shows, in their order, and `attribute code` if it shows one."""
    found = F.array(*(F.when(text.contains(m), m) for m in FORBIDDEN), F.when(text.rlike(ATTRIBUTE_CODE), "attribute code"))
    return F.filter(found, lambda x: x.isNotNull())


def critique(draft: Column, log_size: Column) -> Column:
    """Gaps of a run: no draft, or an empty decision log."""
    gaps = F.array(F.when(F.coalesce(draft, F.lit("")) == "", "No draft output was produced."), F.when(F.coalesce(log_size, F.lit(0)) == 0, "Decision log is empty."))
    return F.filter(gaps, lambda x: x.isNotNull())


def panel(briefs: DataFrame) -> DataFrame:
    """(brief_id, seq, kind, attr, requirement) of briefs (brief_id, topology, a2, a3, a5, a7, a8, a11, a12, pending, conflict): strengths and weaknesses."""
    reranked = F.col("topology").contains("rerank") | (F.col("topology") == "adaptive_agentic")
    rules = (
        (F.lit(True), "strength", "topology", F.col("topology")),
        (F.col("a2") == "high", "strength", "A2", F.lit("high")),
        (reranked, "strength", "A3", F.coalesce("a3", F.lit("inferred"))),
        (F.col("a5").isin("regulated-personal", "internal"), "weakness", "A5", F.col("a5")),
        (F.col("a7") == "fast-moving", "weakness", "A7", F.col("a7")),
        (F.col("a8") == "strict", "weakness", "A8", F.col("a8")),
        (F.col("a11").isin("mandatory", "recommended"), "strength", "A11", F.col("a11")),
        (F.col("a12") == "gated", "weakness", "A12", F.col("a12")),
        (F.size("pending") > 0, "weakness", "pending", F.array_join("pending", ", ")),
        (F.col("conflict").isNotNull(), "weakness", "conflict", F.replace("conflict", F.lit(","), F.lit(", "))),
    )
    items = F.array(*(F.when(cond, F.struct(F.lit(k).alias("kind"), F.lit(a).alias("attr"), r.alias("requirement"))) for cond, k, a, r in rules))
    return briefs.select("brief_id", F.posexplode(F.filter(items, lambda x: x.isNotNull())).alias("seq", "i")).select("brief_id", "seq", "i.*")


def matches_evidence(path: Column, section: Column, text: Column, want_path: Column, section_needles: Column, text_needles: Column) -> Column:
    """Whether a result is an evidence: equal path if one is wanted, and all needles in section and text, whatever their case."""
    none = F.array().cast("array<string>")
    right = F.coalesce(F.nullif(want_path, F.lit("")) == path, F.lit(True))
    all_in = lambda hay, needles: F.forall(F.coalesce(needles, none), lambda n: F.lower(hay).contains(F.lower(n)))
    return right & all_in(section, section_needles) & all_in(text, text_needles)


def claimed_gains(matches: Column, gains: Column) -> Column:
    """Gain of each ranked result when every evidence is claimed once and every result claims one.

    matches has, per result in rank order, the positions of the evidences that it
    is; gains their values, required ones before helpful ones.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, found: Column) -> Column:
        free = F.array_sort(F.array_except(found, s["used"]))
        first = F.get(free, F.lit(0))
        got = F.when(F.size(free) > 0, F.get(gains, first)).otherwise(0)
        return F.struct(F.when(F.size(free) > 0, F.array_append(s["used"], first)).otherwise(s["used"]).alias("used"), F.array_append(s["out"], got).alias("out"))

    return F.aggregate(matches, start, step, lambda s: s["out"])


def specialists(briefs: DataFrame) -> DataFrame:
    """One query per brief and specialist: (query_id `brief:agent`, brief_id, agent, query)."""
    agents = F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(t).alias("focus")) for a, t in FOCUS.items()))
    rows = briefs.select("brief_id", "brief", F.inline(agents))
    return rows.select(F.concat_ws(":", F.col("brief_id").cast("string"), "agent").alias("query_id"), "brief_id", "agent", F.concat_ws(" ", "brief", "focus").alias("query"))


def fan_out(briefs: DataFrame, chunks: DataFrame, top_k: int = 8, namespace: str | None = "knowledge") -> DataFrame:
    """Ranked evidence of all specialists for all briefs in one search."""
    queries = specialists(briefs)
    return lexical.search(queries.select("query_id", "query"), chunks, top_k, namespace).join(queries.select("query_id", "brief_id", "agent"), "query_id")


def slo(summary: DataFrame, p50: float | None, p99: float | None) -> DataFrame:
    """summary (p50, p99) with ok and the failures by name."""
    checks = [F.when(F.col(n) > limit, n) for n, limit in (("p50", p50), ("p99", p99)) if limit is not None]
    failures = F.filter(F.array(*checks, F.lit(None).cast("string")), lambda x: x.isNotNull())
    return summary.withColumn("failures", F.array_join(failures, ",")).withColumn("ok", F.size(failures) == 0)

"""Fan-out of briefs to specialists and to research queries, with a retrieval that is passed in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.plan import stored
from corvane.operators.answers import specialists

#: A retrieval: queries (query_id, query) and a number of results -> (query_id, chunk_ord, score, rank).
Retrieve = Callable[[DataFrame, int], DataFrame]

# What each research agent asks besides the brief, in order.
SUBQUERIES = {
    "literature_review": (
        "agentic RAG literature hybrid retrieval reranking evaluation citation grounded generation",
        "RAG surveys self-RAG corrective RAG adaptive RAG retrieval evaluation latency citations",
        "context grounding compression lost in the middle citation abstention trustworthy RAG",
    ),
    "agent_frameworks": (
        "LangGraph agentic RAG graph state nodes conditional edges retrieval tool",
        "Pydantic AI multi-agent patterns structured output retries graph execution",
        "Haystack AsyncPipeline parallel retrievers loops agentic pipelines",
        "CrewAI flows crews multi-agent orchestration production workflow",
    ),
    "community_implementations": (
        "GitHub LangGraph agentic RAG hybrid search reranking Qdrant implementation",
        "Medium self-evaluating RAG agent hybrid search LangGraph reranking observability",
        "community implementations hybrid RAG BM25 RRF reranker LangGraph GitHub",
    ),
    "huggingface_spaces": (
        "Hugging Face smolagents managed agents multi agent systems agentic RAG",
        "Hugging Face Spaces Gradio agentic RAG examples smolagents tools",
        "Hugging Face inference providers Spaces Gradio agent deployment",
    ),
}
PER_SUBQUERY = 6


AGENTS = ("retrieval", "security", "cloud_iac", "evaluation")


def fan_out(briefs: DataFrame, retrieve: Retrieve | dict[str, Retrieve], top_k: int = 8, errors: dict[str, str] | None = None) -> DataFrame:
    """(brief_id, agent, place, status, chunk_ord, score, rank) of all specialists for all briefs (brief_id, brief).

    Agents that share a retrieval are one query set of it; a dict gives agents
    their own. Each retrieval runs by itself: where one raises, its agents have
    the status error and no source, `errors` gets the message, and the others are
    not touched. Agents stay in their fixed order (place), and one that finds
    nothing has one row without a source.
    """
    asked = specialists(briefs)
    own = retrieve if isinstance(retrieve, dict) else dict.fromkeys(AGENTS, retrieve)
    failed: dict[str, str] = {a: "no retrieval" for a in AGENTS if a not in own}
    found = None
    for run in dict.fromkeys(own.values()):
        mine = [a for a, r in own.items() if r is run]
        try:
            part = stored(run(asked.filter(F.col("agent").isin(mine)).select("query_id", "query"), top_k).select("query_id", "chunk_ord", "score", "rank"), "found")
        except Exception as e:  # noqa: BLE001  an agent's failure is a status, whatever it is
            failed |= dict.fromkeys(mine, f"{type(e).__name__}: {e}")
            continue
        found = part if found is None else found.unionByName(part)
    if errors is not None:
        errors |= failed
    none = "query_id string, chunk_ord bigint, score double, rank int"
    joined = asked.join(found if found is not None else briefs.sparkSession.createDataFrame([], none), "query_id", "left")
    place = F.array_position(F.array(*map(F.lit, AGENTS)), F.col("agent")) - 1
    status = F.when(F.col("agent").isin(list(failed)) if failed else F.lit(False), "error").otherwise("ok")
    return joined.select("brief_id", "agent", place.cast("int").alias("place"), status.alias("status"), "chunk_ord", "score", "rank")


def subqueries(briefs: DataFrame, asked: dict[str, tuple[str, ...]] = SUBQUERIES) -> DataFrame:
    """One query per brief, agent and subquery: (query_id `brief:agent:n`, brief_id, agent, place, n, query)."""
    rows = F.array(*(F.struct(F.lit(p).alias("place"), F.lit(a).alias("agent"), F.lit(n).alias("n"), F.lit(s).alias("s")) for p, (a, ss) in enumerate(asked.items()) for n, s in enumerate(ss)))
    flat = briefs.select("brief_id", "brief", F.inline(rows))
    name = F.concat_ws(":", F.col("brief_id").cast("string"), "agent", F.col("n").cast("string"))
    return flat.select(name.alias("query_id"), "brief_id", "agent", "place", "n", F.concat_ws(" ", "brief", "s").alias("query"))


def research(briefs: DataFrame, retrieve: Retrieve, per_subquery: int = PER_SUBQUERY, asked: dict[str, tuple[str, ...]] = SUBQUERIES) -> DataFrame:
    """(brief_id, agent, place, seq, chunk_ord, n, rank): the sources of each agent, each once, in the order in which its subqueries found them first."""
    queries = subqueries(briefs, asked)
    hits = retrieve(queries.select("query_id", "query"), per_subquery).join(queries.select("query_id", "brief_id", "agent", "place", "n"), "query_id")
    first = hits.groupBy("brief_id", "agent", "place", "chunk_ord").agg(F.min(F.struct("n", "rank")).alias("at"))
    seq = F.row_number().over(Window.partitionBy("brief_id", "agent").orderBy("at"))
    return first.withColumn("seq", seq).select("brief_id", "agent", "place", "seq", "chunk_ord", "at.n", "at.rank")

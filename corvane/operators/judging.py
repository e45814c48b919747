"""Evaluation axes over whole tables: evidence metrics, topologies, answers, and one report of metrics, counts and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.answers import claimed_gains, matches_evidence
from corvane.operators.evaluation import mean_metrics, micro_accuracy
from corvane.operators.rules import ATTRIBUTES

GOLD = (
    "version string, created string, description string, thresholds map<string,double>, "
    "retrieval array<struct<id:string,query:string,namespace:string,top_k:int,filters:map<string,string>,required:array<struct<path:string,section_contains:array<string>,text_contains:array<string>>>,"
    "helpful:array<struct<path:string,section_contains:array<string>,text_contains:array<string>>>,tags:array<string>>>, "
    "routing array<struct<id:string,scenario:string,expected_domain:string,expected_attributes:map<string,string>,expected_pending:array<string>>>, "
    "topology array<struct<id:string,requirement_vector:map<string,string>,expected_topology:string>>, "
    "answer array<struct<id:string,scenario:string,expected_topology:string,required_decision_areas:array<string>,required_decision_phrases:array<struct<area:string,contains:array<string>>>,"
    "required_sources:array<struct<used_by:string,path_contains:string,section_contains:array<string>>>,min_citation_coverage:double,required_panel_phrases:array<string>,"
    "min_panel_citation_coverage:double,required_evidence_chunk_phrases:array<string>>>"
)
ANSWER_METRICS = ("topology", "decision_area_recall", "decision_phrase_recall", "source_recall", "citation_coverage", "panel_phrase_recall", "panel_citation_coverage", "evidence_chunk_recall")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold file as one row: thresholds, and the items of each axis as arrays. Fields that a file lacks are null."""
    return spark.read.schema(GOLD).json(path, multiLine=True)


def items(gold: DataFrame, axis: str) -> DataFrame:
    """Items of one axis as rows; none if the file has no such axis."""
    return gold.select(F.inline(axis))


def evidence_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, recall, mrr, ndcg, gains) per item of gold (id, required, helpful arrays of evidences, top_k).

    results has (id, rank, path, section, text), ranks from 1. A result is an
    evidence if the path is equal where one is wanted and all needles occur.
    Recall and MRR take the first match of each required evidence; for nDCG every
    evidence counts once and every result claims one, required ones (gain 2)
    before helpful ones (1). Equal evidences of an item are one. An item without
    required evidence has recall 1 and MRR 0, without any nDCG 1. An item's results
    are at most its top_k, so a group is small.
    """
    g = gold.select("id", "top_k", *(F.array_distinct(F.coalesce(c, F.array())).alias(f"uniq_{c}") for c in ("required", "helpful")), *(F.size(F.coalesce(c, F.array())).alias(f"n_{c}") for c in ("required", "helpful")))
    wanted = F.concat("uniq_required", "uniq_helpful")
    joined = results.join(g, "id").filter(F.col("rank") <= F.col("top_k"))
    hit = lambda e, i: F.when(matches_evidence(F.col("path"), F.col("section"), F.col("text"), e["path"], e["section_contains"], e["text_contains"]), i.cast("int"))
    found = joined.select("id", "rank", F.filter(F.transform(wanted, hit), lambda x: x.isNotNull()).alias("m"))
    ranked = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "m"))).alias("r"))
    out = g.join(ranked, "id", "left").withColumn("r", F.coalesce("r", F.array().cast("array<struct<rank:int,m:array<int>>>")))
    values = F.concat(F.array_repeat(F.lit(2), F.size("uniq_required")), F.array_repeat(F.lit(1), F.size("uniq_helpful")))
    out = out.withColumn("gains", claimed_gains(F.transform("r", lambda x: x["m"]), values))
    firsts = F.transform(F.sequence(F.lit(0), F.size("uniq_required") - 1), lambda k: F.array_min(F.transform(F.filter("r", lambda x: F.array_contains(x["m"], k.cast("int"))), lambda x: x["rank"])))
    out = out.withColumn("firsts", F.when(F.size("uniq_required") > 0, F.filter(firsts, lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>")))
    ideal = F.slice(F.concat(F.array_repeat(F.lit(2), F.col("n_required")), F.array_repeat(F.lit(1), F.col("n_helpful"))), F.lit(1), F.col("top_k"))
    return out.select(
        "id",
        F.when(F.col("n_required") > 0, F.size("firsts") / F.size("uniq_required")).otherwise(1.0).alias("recall"),
        F.coalesce(1.0 / F.array_min("firsts"), F.lit(0.0)).alias("mrr"),
        F.when(F.size(ideal) > 0, dcg(F.col("gains")) / dcg(ideal)).otherwise(1.0).alias("ndcg"),
        "gains",
    )


def dcg(gains: Column) -> Column:
    """Discounted sum of gains in rank order."""
    parts = F.transform(gains, lambda g, i: g / F.log2(i + F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def topology_scores(chosen: DataFrame, gold: DataFrame) -> DataFrame:
    """(id, expected, actual, correct) of gold (id, expected_topology) and chosen (id, topology); an item without a choice is wrong."""
    joined = gold.join(chosen.select("id", F.col("topology").alias("actual")), "id", "left")
    return joined.select("id", F.col("expected_topology").alias("expected"), "actual", F.coalesce(F.col("actual") == F.col("expected_topology"), F.lit(False)).alias("correct"))


def routing_scores(resolved: DataFrame, gold: DataFrame) -> DataFrame:
    """The routing of each item: (id, domain_correct, attribute_total, attribute_correct, pending_total, pending_correct, wrong_attributes map, actual_domain, failed).

    resolved has id, domain, pending array and a struct per attribute (as
    rules.resolve gives them); gold id, expected_domain, expected_attributes map
    and expected_pending, which is compared as a set, and not at all where it is
    null. An item that was not resolved has nothing right.
    """
    values = F.create_map(*(x for a in ATTRIBUTES for x in (F.lit(a), F.col(f"{a}.value"))))
    r = resolved.select("id", F.col("domain").alias("actual_domain"), F.array_sort(F.array_distinct("pending")).alias("actual_pending"), values.alias("actual"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    wanted = F.coalesce(F.map_entries("expected_attributes"), none)
    joined = gold.select("id", "expected_domain", wanted.alias("wanted"), F.array_sort(F.array_distinct("expected_pending")).alias("expected_pending")).join(r, "id", "left")
    wrong = F.filter("wanted", lambda e: ~F.try_element_at("actual", e["key"]).eqNullSafe(e["value"]))
    total = F.col("expected_pending").isNotNull()
    scored = joined.select(
        "id", F.col("actual_domain").eqNullSafe(F.col("expected_domain")).alias("domain_correct"), F.size("wanted").alias("attribute_total"), (F.size("wanted") - F.size(wrong)).alias("attribute_correct"),
        total.cast("int").alias("pending_total"), F.coalesce(total & F.col("actual_pending").eqNullSafe(F.col("expected_pending")), F.lit(False)).cast("int").alias("pending_correct"),
        F.map_from_entries(F.transform(wrong, lambda e: F.struct(e["key"].alias("key"), F.try_element_at("actual", e["key"]).alias("value")))).alias("wrong_attributes"), "actual_domain",
    )
    failed = ~F.col("domain_correct") | (F.col("attribute_correct") < F.col("attribute_total")) | (F.col("pending_correct") < F.col("pending_total"))
    return scored.withColumn("failed", failed)


def routing_metrics(scores: DataFrame) -> DataFrame:
    """(metric, value): accuracy of domains by item, of attributes and pending sets over all of them; 1 over nothing but items, 0 without items."""
    whole = scores.agg(
        F.coalesce(F.avg(F.col("domain_correct").cast("double")), F.lit(0.0)).alias("routing_domain_accuracy"), micro_accuracy(F.col("attribute_correct"), F.col("attribute_total")).alias("routing_attribute_accuracy"),
        micro_accuracy(F.col("pending_correct"), F.col("pending_total")).alias("routing_pending_accuracy"),
    )
    return whole.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in whole.columns))))


def source_matches(source: Column, wanted: Column) -> Column:
    """Whether a source (source_path, section, used_by) is one that is wanted (used_by, path_contains, section_contains), whatever the case; empty wishes hold."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    agent, path = low(wanted["used_by"]), low(wanted["path_contains"])
    none = F.array().cast("array<string>")
    uses = F.array_contains(F.transform(F.coalesce(source["used_by"], none), F.lower), agent)
    return ((agent == "") | uses) & low(source["source_path"]).contains(path) & F.forall(F.coalesce(wanted["section_contains"], none), lambda n: low(source["section"]).contains(F.lower(n)))


def _share(hits: Column, total: Column, empty: float) -> Column:
    return F.when(total > 0, hits / total).otherwise(empty)


def answer_scores(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """The eight ratios of each answer, its counts, and whether it fails.

    answers has id, topology, decisions (area, choice, rationale, source_ids),
    sources (source_path, section, used_by), panel_items (source_ids), panel_text,
    evidence_text; gold the fields of an answer item. Of decisions with one area
    the last counts. Wishes that an item lacks hold; without decisions or panel
    items their citation coverage is 0.
    """
    none = F.array().cast("array<string>")
    a = answers.join(gold, "id")
    areas = F.transform("decisions", lambda d: d["area"])
    wish = lambda c: F.coalesce(F.col(c), none)
    cited = lambda c: F.size(F.filter(c, lambda d: F.size(F.coalesce(d["source_ids"], none)) > 0))

    def said(check: Column) -> Column:
        last = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter("decisions", lambda d: d["area"] == check["area"]), lambda d: F.lower(F.concat_ws(" ", d["choice"], d["rationale"])))), -1)
        return F.forall(F.coalesce(check["contains"], none), lambda p: last.contains(F.lower(p)))

    in_text = lambda phrases, text: F.size(F.filter(phrases, lambda p: F.lower(F.coalesce(text, F.lit(""))).contains(F.lower(p))))
    checks, sources = F.coalesce("required_decision_phrases", F.array()), F.coalesce("required_sources", F.array())
    n_sources = F.size(F.filter(sources, lambda w: F.exists("sources", lambda s: source_matches(s, w))))
    a = a.select(
        "id",
        F.coalesce((F.col("topology") == F.col("expected_topology")) | (F.col("expected_topology") == ""), F.col("expected_topology").isNull()).cast("double").alias("topology"),
        _share(F.size(F.filter(wish("required_decision_areas"), lambda x: F.array_contains(areas, x))), F.size(wish("required_decision_areas")), 1.0).alias("decision_area_recall"),
        _share(F.size(F.filter(checks, said)), F.size(checks), 1.0).alias("decision_phrase_recall"),
        _share(n_sources, F.size(sources), 1.0).alias("source_recall"),
        _share(cited("decisions"), F.size("decisions"), 0.0).alias("citation_coverage"),
        _share(in_text(wish("required_panel_phrases"), F.col("panel_text")), F.size(wish("required_panel_phrases")), 1.0).alias("panel_phrase_recall"),
        _share(cited("panel_items"), F.size("panel_items"), 0.0).alias("panel_citation_coverage"),
        _share(in_text(wish("required_evidence_chunk_phrases"), F.col("evidence_text")), F.size(wish("required_evidence_chunk_phrases")), 1.0).alias("evidence_chunk_recall"),
        F.size("decisions").alias("n_decisions"), cited("decisions").alias("n_cited"), F.size("panel_items").alias("n_panel"), cited("panel_items").alias("n_panel_cited"),
        F.coalesce("min_citation_coverage", F.lit(1.0)).alias("least"), F.coalesce("min_panel_citation_coverage", F.lit(0.0)).alias("panel_least"),
    )
    whole = ("topology", "decision_area_recall", "decision_phrase_recall", "source_recall", "panel_phrase_recall", "evidence_chunk_recall")
    failed = (F.col("citation_coverage") < F.col("least")) | (F.col("panel_citation_coverage") < F.col("panel_least"))
    for c in whole:
        failed = failed | (F.col(c) < 1.0)
    return a.withColumn("failed", failed).drop("least", "panel_least")


def report(retrieval: DataFrame, topology: DataFrame, answers: DataFrame | None = None, routing: DataFrame | None = None) -> DataFrame:
    """(kind, axis, name, value) of a whole evaluation: metrics, counts, and a failure per item that fell short, as one union."""
    row = lambda df, kind, axis, name, value: df.select(F.lit(kind).alias("kind"), F.lit(axis).alias("axis"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    scored = topology.withColumn("score", F.col("correct").cast("double"))
    parts = [row(mean_metrics(retrieval), "metric", "retrieval", F.col("metric"), F.col("value")), row(mean_metrics(scored, ("score",)), "metric", "topology", F.lit("topology_accuracy"), F.col("value"))]
    parts += [row(df.agg(F.count("*").alias("n")), "count", axis, F.lit(f"{axis}_items"), F.col("n")) for axis, df in (("retrieval", retrieval), ("topology", topology))]
    parts += [row(retrieval.filter("recall < 1"), "failure", "retrieval", F.col("id"), F.col("recall")), row(topology.filter("NOT correct"), "failure", "topology", F.col("id"), F.lit(0))]
    if routing is not None:
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"routing_{c}") for c in ("attribute_total", "attribute_correct", "pending_total", "pending_correct")]
        counts = routing.agg(F.count("*").alias("routing_items"), *sums)
        flat = counts.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in counts.columns))))
        parts += [row(routing_metrics(routing), "metric", "routing", F.col("metric"), F.col("value")), row(flat, "count", "routing", F.col("name"), F.col("value")), row(routing.filter("failed"), "failure", "routing", F.col("id"), F.lit(0))]
    if answers is not None:
        parts += [
            row(mean_metrics(answers, ANSWER_METRICS), "metric", "answer", F.concat(F.lit("answer_"), F.when(F.col("metric") == "topology", "topology_accuracy").otherwise(F.col("metric"))), F.col("value")),
            row(answers.agg(F.count("*").alias("n")), "count", "answer", F.lit("answer_items"), F.col("n")),
            row(answers.agg(F.coalesce(F.sum("n_decisions"), F.lit(0)).alias("n")), "count", "answer", F.lit("answer_decisions_total"), F.col("n")),
            row(answers.agg(F.coalesce(F.sum("n_cited"), F.lit(0)).alias("n")), "count", "answer", F.lit("answer_decisions_cited"), F.col("n")),
            row(answers.filter("failed"), "failure", "answer", F.col("id"), F.lit(0)),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

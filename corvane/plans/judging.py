"""Registered queries: evaluation axes and report, fan-out and research, decisions, edges, projections, residual filters, collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.plan import small, stored
from corvane.operators import answers, dense, evidence, judging, lexical, research, rules
from corvane.plans.answers import _TAILS, STATE, TAILS, _state
from corvane.plans.common import BRIEFS_SQL, briefs, chunks, query_vectors, questions, t, vectors
from corvane.plans.evidence import LINKS, _linked, _lit
from corvane.plans.retrieval import BM25, _bm25, _dense_sql, _top
from corvane.plans.routing import CHOSEN, NEEDS
from corvane.sources import store

FEW = 10


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's ten best documents of each question, as results with a path, a section and a text; texts meet the short ranking where they are read."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_ord"), F.col("source").alias("path"), F.col("lang").alias("section"), "text")
    return d.join(small(stored(_bm25(spark, sf_dir, FEW), "ranking")), "chunk_ord").withColumn("id", F.col("query_id"))


def _evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of each question: a source and words of a language as required evidence, words as helpful evidence."""
    words = lambda *ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    one = lambda path, section, text: F.struct(path.cast("string").alias("path"), section.alias("section_contains"), text.alias("text_contains"))
    src = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    required = F.array(one(src, words(), words()), one(F.lit(None), words("E"), words("the")))
    helpful = F.array(one(F.lit(None), words("r"), words("que")), one(F.lit(""), words(), words("On", "er")))
    return questions(spark, sf_dir).select(F.col("query_id").alias("id"), F.lit(FEW).alias("top_k"), required.alias("required"), helpful.alias("helpful"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judging.evidence_metrics(_results(spark, sf_dir), _evidences(spark, sf_dir))


def evl1_evidence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir)
    return m.select(F.col("id").alias("item_id"), *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")), F.array_join(F.transform("gains", lambda g: g.cast("string")), ",").alias("gains"))


def _qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's ten best documents of each question with their quality labels, which meet the short ranking where they are read."""
    best = stored(_bm25(spark, sf_dir, FEW), "ranking")
    labels = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_ord"), "quality")
    known = labels.join(small(best.select("chunk_ord").distinct()), "chunk_ord", "left_semi")
    return best.join(small(known), "chunk_ord", "left")


def win7_claimed_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of BM25's ten best documents of each question; a document is evidence doc_id mod 5 and, if labelled good, evidence 0."""
    d = _qualities(spark, sf_dir)
    found = F.array_distinct(F.filter(F.array((F.col("chunk_ord") % 5).cast("int"), F.when(F.col("quality") == 1, 0)), lambda x: x.isNotNull()))
    rows = d.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", found.alias("m")))), lambda s: s["m"]).alias("m"))
    gains = F.array(*map(F.lit, (2, 2, 1, 1, 1)))
    return rows.select("query_id", F.array_join(F.transform(answers.claimed_gains(F.col("m"), gains), lambda g: g.cast("string")), ",").alias("gains"))


def _topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brief with a domain against an expectation by its length."""
    s = _state(spark, sf_dir)
    expected = F.when(F.length("brief") % 2 == 0, "two_stage_hybrid_rerank").otherwise("adaptive_agentic")
    return judging.topology_scores(s.select(F.col("brief_id").alias("id"), "topology"), s.select(F.col("brief_id").alias("id"), expected.alias("expected_topology")))


def evl4_topology_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topologies(spark, sf_dir)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer with one or two decisions, a source and a panel item, against wishes that some meet."""
    i, ids = F.col("doc_id"), F.array(F.lit("s"))
    none = F.array().cast("array<string>")
    decision = lambda area, choice, why, cited: F.struct(F.lit(area).alias("area"), choice.alias("choice"), why.alias("rationale"), F.when(cited, ids).otherwise(none).alias("source_ids"))
    first, second = decision("retrieval", F.col("lang"), F.col("text"), i % 3 > 0), decision("security", F.col("source"), F.lit("None"), i % 5 > 0)
    a = t(spark, sf_dir, "documents").select(
        i.alias("id"), F.col("source").alias("topology"), F.when(i % 2 == 0, F.array(first)).otherwise(F.array(first, second)).alias("decisions"),
        F.array(F.struct(F.col("source").alias("source_path"), F.col("lang").alias("section"), F.array("lang").alias("used_by"))).alias("sources"),
        F.array(F.struct(F.when(i % 4 > 0, ids).otherwise(none).alias("source_ids"))).alias("panel_items"), F.col("text").alias("panel_text"), F.col("text").alias("evidence_text"),
    )
    words = lambda *ws: F.array(*map(F.lit, ws))
    check = lambda area, *ws: F.struct(F.lit(area).alias("area"), words(*ws).alias("contains"))
    gold = t(spark, sf_dir, "documents").select(
        i.alias("id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("expected_topology"), words("retrieval", "security").alias("required_decision_areas"),
        F.array(check("retrieval", "The"), check("security", "src1", "none")).alias("required_decision_phrases"),
        F.array(F.struct(F.lit("EN").alias("used_by"), F.lit("src").alias("path_contains"), words("E").alias("section_contains"))).alias("required_sources"),
        F.lit(0.5).alias("min_citation_coverage"), words("the", "Que").alias("required_panel_phrases"), F.lit(0.5).alias("min_panel_citation_coverage"), words("tion").alias("required_evidence_chunk_phrases"),
    )
    return judging.answer_scores(a, gold)


def evl5_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).withColumnRenamed("id", "doc_id")


#: Domains that a routing item expects by a word of its brief, the first that is there.
EXPECTED = (("hipaa", "medical-clinical"), ("bank", "financial-banking"), ("api", "technical-software"), ("cbt", "psychology-mental-health"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brief as a routing item: a domain by a word, attributes that most briefs of a kind have, and pending ones where the brief's length is even."""
    b = briefs(spark, sf_dir)
    resolved = rules.resolve(b).withColumnRenamed("brief_id", "id")
    low = F.lower("brief")
    domain = F.coalesce(*(F.when(low.contains(w), d) for w, d in EXPECTED))
    wanted = F.create_map(F.lit("A2"), F.lit("high"), F.lit("A12"), F.when(F.length("brief") % 3 == 0, "gated").otherwise("advisory"), F.lit("A4"), F.lit("sectoral"))
    pending = F.when(F.length("brief") % 2 == 0, F.array(*map(F.lit, ("A9", "A7", "A6", "A3", "A8", "A3"))))
    gold = b.select(F.col("brief_id").alias("id"), domain.alias("expected_domain"), wanted.alias("expected_attributes"), pending.alias("expected_pending"))
    return judging.routing_scores(resolved, gold)


def evl3_routing_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.array_join(F.transform(F.array_sort(F.map_entries("wrong_attributes")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("none")))), ",")
    return _routed(spark, sf_dir).withColumn("wrong_attributes", wrong)


def evl6_whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics and counts of the routing and topology axes, and how many items failed, from a report with all axes."""
    r = judging.report(_metrics(spark, sf_dir), _topologies(spark, sf_dir), None, _routed(spark, sf_dir))
    kept = r.filter("axis IN ('routing', 'topology')")
    failures = kept.filter("kind = 'failure'").groupBy("kind", "axis").agg(F.lit("items").alias("name"), F.count("*").cast("double").alias("value"))
    return kept.filter("kind <> 'failure'").unionByName(failures).withColumn("value", F.round("value", 6))


def evl6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judging.report(_metrics(spark, sf_dir), _topologies(spark, sf_dir), _answered(spark, sf_dir))
    return r.withColumn("value", F.round("value", 6))


def _briefed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).toDF("brief_id", "brief")


def _retrieve(spark: SparkSession, sf_dir: str):
    """BM25 over the documents, as a retrieval of any queries."""

    def run(queries: DataFrame, k: int) -> DataFrame:
        return lexical.bm25_topk(lexical.query_features(queries), chunks(spark, sf_dir), k)

    return run


def evd1_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four specialists a question, of which security has a retrieval that breaks off."""
    run = _retrieve(spark, sf_dir)

    def broken(queries: DataFrame, k: int) -> DataFrame:
        return run(queries.select("query_id", "no_such_column"), k)

    f = research.fan_out(_briefed(spark, sf_dir), dict.fromkeys(research.AGENTS, run) | {"security": broken}, 8)
    return f.select(F.col("brief_id").alias("item_id"), "agent", "place", "status", F.coalesce("chunk_ord", F.lit(-1)).alias("doc_id"), F.coalesce(F.col("rank").cast("long"), F.lit(0)).alias("rank"))


def evd7_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = research.research(_briefed(spark, sf_dir), _retrieve(spark, sf_dir))
    return r.select(F.col("brief_id").alias("item_id"), "agent", F.col("seq").cast("long").alias("seq"), F.col("chunk_ord").alias("doc_id"))


def rul11_topology_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rules.topology_payload(_state(spark, sf_dir))
    return p.withColumns({"stages": F.array_join("stages", " "), "candidate_keys": F.array_join("candidate_keys", ",")})


def rul14_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of every brief with a domain, citing two labels of each agent."""
    s = _state(spark, sf_dir)
    agents = F.array(*(F.struct(F.lit(a).alias("agent"), F.lit(i).alias("i")) for i, a in enumerate(("retrieval", "security", "cloud_iac", "evaluation"))))
    e = s.select("brief_id", F.length("brief").alias("n"), F.inline(agents)).select("brief_id", "agent", "n", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    e = e.withColumn("label", F.concat(F.lit("E"), ((F.col("n") + 2 * F.col("i") + F.col("ord")) % 6).cast("string")))
    return rules.decisions(s, e).withColumn("refs", F.array_join("refs", ","))


def rul19_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the state of every brief with a domain; one in three has its conflict resolved, one in two a gap."""
    n = F.length("brief")
    s = _state(spark, sf_dir).select(
        "brief_id", "pending", F.replace("conflict", F.lit(", "), F.lit(",")).alias("conflict"), F.when(n % 3 == 0, "keep A4").otherwise("").alias("conflict_resolution"),
        F.when(n % 2 == 0, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")).alias("critique"), (n % 4).alias("loop_count"),
    )
    return rules.edges(s).select("brief_id", "elicit", "resolve", "reflect", F.array_join("trace", "|").alias("trace"), "conflict_left")


def flt12_public_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = evidence.links(_linked(spark, sf_dir), by="page_id").withColumn("agent", F.lit("web"))
    secret = links.withColumn("url", F.when(F.length("label") % 3 > 0, F.col("url")).otherwise(F.concat(F.lit("file:"), "url")))
    return answers.public(secret, ("page_id", *answers.PUBLIC_LINK), "url")


def flt12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.get(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % len(TAILS)).cast("int"))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(answers.leaks(F.concat_ws(" ", "text", tail)), "|").alias("leaks"))


def flt4_residual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that no index has, checked on 25 times the candidates."""
    v = vectors(spark, sf_dir).withColumn("part", F.col("chunk_ord") % 7)
    found = dense.search_residual(query_vectors(spark, sf_dir), v, FEW, {"part": "3"}, {"namespace"})
    return found.select("query_id", F.col("chunk_ord").alias("vec_id"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def src9_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels put into a collection of documents, some of them twice."""
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("payload"))
    rows = t(spark, sf_dir, "labels").select((F.col("doc_id") * 2 - F.col("doc_id") % 2).alias("chunk_id"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("payload"), F.col("doc_id").alias("seq"))
    return store.upsert(d, rows).withColumnRenamed("chunk_id", "doc_id")


def jn11_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.concat(F.lit("E"), F.col("quality").cast("string")), F.lit("")).alias("label"))


QUERIES = {
    f.__name__: f
    for f in (
        evl1_evidence_metrics, win7_claimed_gains, evl4_topology_axis, evl5_answer_scores, evl6_report, evl3_routing_axis, evl6_whole_report, evd1_fan_out, evd7_research, rul11_topology_payload, rul14_decisions, rul19_edges,
        flt12_public_links, flt12_leaks, flt4_residual_search, src9_upsert, jn11_labels,
    )
}


def _claim(m: str, gain: str) -> str:
    """SQL: gains of results whose evidence positions are the lists in m, each evidence claimed once."""
    free = "list_filter(e.m, lambda x: NOT list_contains(s.used, x))"
    start = "{'used': []::INT[], 'out': []::INT[], 'm': []::INT[]}"
    return f"list_reduce(list_prepend({start}, list_transform({m}, lambda r: {{'used': []::INT[], 'out': []::INT[], 'm': r}})), lambda s, e: {{'used': CASE WHEN len({free}) > 0 THEN list_append(s.used, list_min({free})) ELSE s.used END, 'out': list_append(s.out, CASE WHEN len({free}) > 0 THEN {gain.format(f'list_min({free})')} ELSE 0 END), 'm': []::INT[]}}).out"


_DCG = "coalesce(list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] / log2(i + 1.0))), 0)"
JUDGED = f"""{BM25}, top AS ({_top('bm', 10, 'doc_id')}),
hit AS (SELECT query_id, rank, list_filter([CASE WHEN source = 'src' || (query_id % 20) THEN 0 END, CASE WHEN contains(lower(lang), 'e') AND contains(lower(text), 'the') THEN 1 END,
  CASE WHEN contains(lower(lang), 'r') AND contains(lower(text), 'que') THEN 2 END, CASE WHEN contains(lower(text), 'on') AND contains(lower(text), 'er') THEN 3 END], lambda x: x IS NOT NULL)::INT[] AS m FROM top JOIN documents USING (doc_id)),
grp AS (SELECT item_id, coalesce(list(m ORDER BY rank) FILTER (m IS NOT NULL), []) AS ms, min(rank) FILTER (list_contains(m, 0)) AS r0, min(rank) FILTER (list_contains(m, 1)) AS r1 FROM benchmark LEFT JOIN hit ON query_id = item_id GROUP BY item_id),
got AS (SELECT *, CASE WHEN len(ms) > 0 THEN {_claim('ms', 'CASE WHEN {} < 2 THEN 2 ELSE 1 END')} ELSE []::INT[] END AS gains FROM grp),
judged AS (SELECT item_id, (CASE WHEN r0 IS NULL THEN 0 ELSE 1 END + CASE WHEN r1 IS NULL THEN 0 ELSE 1 END) / 2.0::DOUBLE AS recall, coalesce(1.0 / least(r0, r1), 0.0)::DOUBLE AS mrr,
  {_DCG.format('gains')} / {_DCG.format('[2, 2, 1, 1]')} AS ndcg, gains FROM got)"""
TOPOS = "topos AS (SELECT brief_id AS id, CASE WHEN length(brief) % 2 = 0 THEN 'two_stage_hybrid_rerank' ELSE 'adaptive_agentic' END AS expected, topology AS actual FROM st8)"
_HAS_THE, _HAS_SRC = "contains(lower(lang || ' ' || text), 'the')", "doc_id % 2 = 1 AND contains(lower(source || ' None'), 'src1')"
ANSWERED = f"""ratios AS (SELECT doc_id, CASE WHEN source = 'src' || (doc_id % 20) THEN 1.0 ELSE 0.0 END AS topology, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS decision_area_recall,
  (CASE WHEN {_HAS_THE} THEN 0.5 ELSE 0 END + CASE WHEN {_HAS_SRC} THEN 0.5 ELSE 0 END) AS decision_phrase_recall, CASE WHEN lang = 'en' AND contains(source, 'src') THEN 1.0 ELSE 0.0 END AS source_recall,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS n_decisions, CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 1 AND doc_id % 5 > 0 THEN 1 ELSE 0 END AS n_cited,
  (CASE WHEN contains(lower(text), 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'que') THEN 0.5 ELSE 0 END) AS panel_phrase_recall, CASE WHEN doc_id % 4 > 0 THEN 1.0 ELSE 0.0 END AS panel_citation_coverage,
  CASE WHEN contains(lower(text), 'tion') THEN 1.0 ELSE 0.0 END AS evidence_chunk_recall, 1 AS n_panel, CASE WHEN doc_id % 4 > 0 THEN 1 ELSE 0 END AS n_panel_cited FROM documents),
scored AS (SELECT doc_id, topology::DOUBLE AS topology, decision_area_recall::DOUBLE AS decision_area_recall, decision_phrase_recall::DOUBLE AS decision_phrase_recall, source_recall::DOUBLE AS source_recall,
  n_cited / n_decisions AS citation_coverage, panel_phrase_recall::DOUBLE AS panel_phrase_recall, panel_citation_coverage::DOUBLE AS panel_citation_coverage, evidence_chunk_recall::DOUBLE AS evidence_chunk_recall, n_decisions, n_cited, n_panel, n_panel_cited FROM ratios),
answered AS (SELECT *, topology < 1 OR decision_area_recall < 1 OR decision_phrase_recall < 1 OR source_recall < 1 OR citation_coverage < 0.5 OR panel_phrase_recall < 1 OR panel_citation_coverage < 0.5 OR evidence_chunk_recall < 1 AS failed FROM scored)"""


def _asked(pairs: list[tuple[str, str, str]], name: str) -> str:
    rows = ", ".join(f"({_lit(a)}, {_lit(n)}, {_lit(text)})" for a, n, text in pairs)
    return BM25.replace("FROM benchmark", f"FROM (SELECT {name} AS item_id, text || ' ' || more AS text FROM benchmark, (VALUES {rows}) v(agent, n, more))")


_FOCUS = _asked([(a, "0", f) for a, f in answers.FOCUS.items() if a != "security"], "item_id || ':' || agent")
_SUBS = _asked([(a, str(n), s) for a, ss in research.SUBQUERIES.items() for n, s in enumerate(ss)], "item_id || ':' || agent || ':' || n")
_IDS = "array_to_string(list_filter(" + str(list(rules.COMPONENTS)) + ", lambda c: len(list_filter(string_split(stages || CASE WHEN a12 = 'gated' THEN ' review_gate' ELSE '' END, ' '), lambda s: list_contains(CASE s " + " ".join(f"WHEN '{s}' THEN {list(cs)}" for s, cs in rules.STAGE_COMPONENTS.items()) + " END, c))) > 0), ', ')"
_CHOICE = {
    "retrieval_strategy": f"CASE WHEN contains(topology, 'hybrid') THEN {_lit(rules.RETRIEVAL_CHOICES[0])} WHEN topology = 'adaptive_agentic' THEN {_lit(rules.RETRIEVAL_CHOICES[1])} ELSE {_lit(rules.RETRIEVAL_CHOICES[2])} END",
    "reranking": f"CASE WHEN contains(topology, 'rerank') THEN {_lit(rules.RERANK_CHOICES[0])} WHEN topology = 'adaptive_agentic' THEN {_lit(rules.RERANK_CHOICES[1])} ELSE {_lit(rules.RERANK_CHOICES[2])} END",
    "deployment": f"'Provision ' || {_IDS}",
} | {a: _lit(text) for a, text in rules.CHOICES.items()}
_ORDER = ("retrieval", "security", "cloud_iac", "evaluation")
_REFS = {a: "[" + ", ".join(f"'E' || ((length(brief) + {2 * _ORDER.index(n) + k}) % 6)" for n in names for k in (0, 1)) + "]" for a, names in rules.DECISION_AREAS}
_FIRST3 = "array_to_string(list_transform(list_sort(list_transform(list_distinct({0}), lambda x: {{'i': list_position({0}, x), 'x': x}}))[1:3], lambda z: z.x), ',')"

_WANTED = "[{'k': 'A12', 'v': CASE WHEN length(brief) % 3 = 0 THEN 'gated' ELSE 'advisory' END, 'a': a12}, {'k': 'A2', 'v': 'high', 'a': a2}, {'k': 'A4', 'v': 'sectoral', 'a': a4}]"
ROUTED = f"""{NEEDS},
ri AS (SELECT w.brief_id AS id, domain, {" ".join(["CASE", *(f"WHEN contains(lower(brief), '{x}') THEN '{d}'" for x, d in EXPECTED), "END"])} AS expected, list_filter({_WANTED}, lambda e: e.v IS DISTINCT FROM e.a) AS wrong,
  CASE WHEN length(brief) % 2 = 0 THEN 1 ELSE 0 END AS pending_total, length(brief) % 2 = 0 AND pending = 'A3,A6,A7,A8,A9' AS pending_ok FROM wide w JOIN briefs b ON b.brief_id = w.brief_id),
routed AS (SELECT id, domain IS NOT DISTINCT FROM expected AS domain_correct, 3::INT AS attribute_total, (3 - len(wrong))::INT AS attribute_correct, pending_total, pending_ok::INT AS pending_correct,
  array_to_string(list_transform(wrong, lambda e: e.k || '=' || coalesce(e.a, 'none')), ',') AS wrong_attributes, domain AS actual_domain, domain IS DISTINCT FROM expected OR len(wrong) > 0 OR pending_ok::INT < pending_total AS failed FROM ri)"""

ORACLE_SQL = {
    "evl1_evidence_metrics": f"WITH {JUDGED} SELECT item_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, array_to_string(gains, ',') AS gains FROM judged",
    "win7_claimed_gains": f"WITH {BM25}, top AS ({_top('bm', 10, 'doc_id')}), g AS (SELECT query_id, list(list_distinct(list_filter([(doc_id % 5)::INT, CASE WHEN quality = 1 THEN 0 END], lambda x: x IS NOT NULL)) ORDER BY rank) AS ms FROM top LEFT JOIN labels USING (doc_id) GROUP BY query_id) SELECT query_id, array_to_string({_claim('ms', 'CASE WHEN {} < 2 THEN 2 ELSE 1 END')}, ',') AS gains FROM g",
    "evl4_topology_axis": f"WITH {STATE}, {TOPOS} SELECT *, expected = actual AS correct FROM topos",
    "evl5_answer_scores": f"WITH {ANSWERED} SELECT * FROM answered",
    "evl3_routing_axis": f"WITH {ROUTED} SELECT id, domain_correct, attribute_total, attribute_correct, pending_total, pending_correct, wrong_attributes, actual_domain, failed FROM routed",
    "evl6_whole_report": f"""
WITH {STATE.replace(NEEDS, ROUTED)}, {TOPOS},
rows_ AS (SELECT 'metric' AS kind, 'routing' AS axis, unnest(['routing_domain_accuracy', 'routing_attribute_accuracy', 'routing_pending_accuracy']) AS name, unnest([avg(domain_correct::INT), sum(attribute_correct) / sum(attribute_total), sum(pending_correct) / sum(pending_total)]) AS value FROM routed
  UNION ALL SELECT 'count', 'routing', unnest(['routing_items', 'routing_attribute_total', 'routing_attribute_correct', 'routing_pending_total', 'routing_pending_correct']), unnest([count(*), sum(attribute_total), sum(attribute_correct), sum(pending_total), sum(pending_correct)]) FROM routed
  UNION ALL SELECT 'metric', 'topology', 'topology_accuracy', avg(CASE WHEN expected = actual THEN 1.0 ELSE 0.0 END) FROM topos UNION ALL SELECT 'count', 'topology', 'topology_items', count(*) FROM topos
  UNION ALL SELECT 'failure', 'routing', 'items', count(*) FROM routed WHERE failed HAVING count(*) > 0 UNION ALL SELECT 'failure', 'topology', 'items', count(*) FROM topos WHERE expected <> actual HAVING count(*) > 0)
SELECT kind, axis, name, round(value::DOUBLE, 6) AS value FROM rows_""",
    "evl6_report": f"""
WITH {JUDGED}, {STATE}, {TOPOS}, {ANSWERED},
rows_ AS (
  SELECT 'metric' AS kind, 'retrieval' AS axis, unnest(['recall', 'mrr', 'ndcg']) AS name, unnest([avg(recall), avg(mrr), avg(ndcg)]) AS value FROM judged
  UNION ALL SELECT 'metric', 'topology', 'topology_accuracy', avg(CASE WHEN expected = actual THEN 1.0 ELSE 0.0 END) FROM topos
  UNION ALL SELECT 'metric', 'answer', 'answer_' || unnest([{", ".join("'topology_accuracy'" if m == 'topology' else f"'{m}'" for m in judging.ANSWER_METRICS)}]), unnest([{", ".join(f"avg({m})" for m in judging.ANSWER_METRICS)}]) FROM answered
  UNION ALL SELECT 'count', 'retrieval', 'retrieval_items', count(*) FROM judged UNION ALL SELECT 'count', 'topology', 'topology_items', count(*) FROM topos
  UNION ALL SELECT 'count', 'answer', unnest(['answer_items', 'answer_decisions_total', 'answer_decisions_cited']), unnest([count(*), sum(n_decisions), sum(n_cited)]) FROM answered
  UNION ALL SELECT 'failure', 'retrieval', item_id::VARCHAR, recall FROM judged WHERE recall < 1 UNION ALL SELECT 'failure', 'topology', id, 0 FROM topos WHERE expected <> actual
  UNION ALL SELECT 'failure', 'answer', doc_id::VARCHAR, 0 FROM answered WHERE failed)
SELECT kind, axis, name, round(value::DOUBLE, 6) AS value FROM rows_""",
    "evd1_fan_out": f"""
WITH {_FOCUS}, top AS ({_top('bm', 8, 'doc_id')}), a(agent, place) AS (VALUES {", ".join(f"('{a}', {i})" for i, a in enumerate(_ORDER))})
SELECT b.item_id, agent, place, CASE WHEN agent = 'security' THEN 'error' ELSE 'ok' END AS status, coalesce(doc_id, -1) AS doc_id, coalesce(rank, 0) AS rank FROM benchmark b CROSS JOIN a LEFT JOIN top ON query_id = b.item_id || ':' || agent""",
    "evd7_research": f"""
WITH {_SUBS}, top AS ({_top('bm', 6, 'doc_id')}), p AS (SELECT string_split(query_id, ':')[1]::BIGINT AS item_id, string_split(query_id, ':')[2] AS agent, string_split(query_id, ':')[3]::INT AS n, doc_id, rank FROM top),
f AS (SELECT item_id, agent, doc_id, min((n, rank)) AS place FROM p GROUP BY ALL) SELECT item_id, agent, row_number() OVER (PARTITION BY item_id, agent ORDER BY place) AS seq, doc_id FROM f""",
    "rul11_topology_payload": f"""
WITH {CHOSEN} SELECT brief_id, topology AS key, CASE topology {" ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in rules.TOPOLOGY_NAMES.items())} END AS name,
  'Selected by hard constraints first, then quality within survivors. A2=' || coalesce(a2, 'unset') || ', A3=' || coalesce(a3, 'unset') || ', A1=' || coalesce(a1, 'unset') || ', A8=' || coalesce(a8, 'unset') || '.' AS rationale,
  cat.stages || CASE WHEN a12 = 'gated' THEN ' review_gate' ELSE '' END AS stages, coalesce(a2 = 'high', false) AS lexical_required, contains(topology, 'rerank') OR topology = 'adaptive_agentic' AS rerank_recommended,
  topology = 'adaptive_agentic' AS adaptive_recommended, coalesce(a12 = 'gated', false) AS review_gate_required, coalesce(a11 = 'mandatory', false) AS audit_log_required, candidates AS candidate_keys, cat.ord + 1 AS quality_rank
FROM chosen JOIN cat ON cat.key = topology""",
    "rul14_decisions": f"WITH {STATE}, full_ AS (SELECT st8.*, cat.stages FROM st8 JOIN cat ON cat.key = topology) "
    + " UNION ALL ".join(f"SELECT brief_id, {i} AS seq, '{a}' AS area, {_CHOICE[a]} AS choice, {_FIRST3.format(_REFS[a])} AS refs FROM full_" for i, (a, _) in enumerate(rules.DECISION_AREAS)),
    "rul19_edges": f"""
WITH {STATE}, s AS (SELECT brief_id, pending, replace(conflict, ', ', ',') AS conflict, length(brief) AS n FROM st8)
SELECT brief_id, pending <> '' AS elicit, conflict IS NOT NULL AS resolve, n % 2 = 0 AND n % 4 < 2 AS reflect,
  CASE WHEN pending <> '' THEN 'elicitation:pending:' || pending ELSE 'elicitation:complete' END || '|' || CASE WHEN conflict IS NULL THEN 'conflict:none' WHEN n % 3 = 0 THEN 'conflict:resolved:keep A4' ELSE 'conflict:unresolved' END AS trace,
  CASE WHEN n % 3 <> 0 THEN conflict END AS conflict_left FROM s""",
    "flt12_public_links": f"WITH {LINKS} SELECT page_id, 'web' AS agent, label, url, source_type, NULL::VARCHAR AS relevance FROM links WHERE length(label) % 3 > 0",
    "flt12_leaks": f"WITH d AS (SELECT doc_id, text || ' ' || ({_TAILS})[1 + doc_id % {len(TAILS)}] AS a FROM documents) SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN contains(a, {_lit(m)}) THEN {_lit(m)} END' for m in answers.FORBIDDEN)}, CASE WHEN regexp_matches(a, {_lit(answers.ATTRIBUTE_CODE)}) THEN 'attribute code' END], lambda x: x IS NOT NULL), '|') AS leaks FROM d",
    "flt4_residual_search": f"WITH {_dense_sql('d', 250)} , k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY d.rank) AS r FROM d WHERE vec_id % 7 = 3) SELECT query_id, vec_id, score, r AS rank FROM k WHERE r <= 10",
    "src9_upsert": "WITH r AS (SELECT doc_id * 2 - doc_id % 2 AS id, max(doc_id) AS seq FROM labels GROUP BY 1) SELECT doc_id, lang AS payload FROM documents WHERE doc_id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'q' || seq FROM r",
    "jn11_labels": "SELECT doc_id, coalesce('E' || quality, '') AS label FROM documents LEFT JOIN labels USING (doc_id)",
}

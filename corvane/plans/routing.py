"""Registered queries: domains, requirements, constraints, topologies, projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import rules
from corvane.operators.answers import parse_answers
from corvane.operators.rules import ATTRIBUTES
from corvane.plans.common import BRIEFS_SQL, briefs


def rul1_domain_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.domain_scores(briefs(spark, sf_dir))


def rul1_domain_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs(spark, sf_dir).select("brief_id", rules.domain_of(F.col("brief")).alias("domain"))


def rul3_stated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefs(spark, sf_dir).select("brief_id", *(rules.stated(F.col("brief"), a).alias(a.lower()) for a in rules.STATED))


def rul2_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.resolve(briefs(spark, sf_dir))
    return r.select("brief_id", "domain", *(F.col(f"{a}.value").alias(a.lower()) for a in ATTRIBUTES), F.array_join("pending", ",").alias("pending"))


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brief with follow-up answers: some attributes by its length, a blank one, and none at all for each fifth length."""
    n = F.length("brief")
    text = F.concat_ws("\n", F.when(n % 2 == 0, "A3=multi-hop"), F.when(n % 3 == 0, "A12 = gated"), F.when(n % 4 == 0, "A7=  "), F.lit("A9=multilingual"), F.when(n % 7 == 0, "A1=costly"))
    return briefs(spark, sf_dir).withColumn("answers", F.when(n % 5 > 0, parse_answers(text)))


def rul4_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of briefs with answers: an answer comes before what the brief states and before the prior, and is no longer pending."""
    r = rules.resolve(answered(spark, sf_dir))
    sources = F.array_join(F.array(*(F.coalesce(F.col(f"{a}.source"), F.lit("-")) for a in ("A1", "A3", "A7", "A9", "A12"))), ",")
    overrode = F.array_join(F.filter(F.array(*(F.when(F.col(f"{a}.overrode"), a) for a in ATTRIBUTES)), lambda x: x.isNotNull()), ",")
    return r.select("brief_id", "domain", *(F.col(f"{a}.value").alias(a.lower()) for a in ATTRIBUTES), F.array_join("pending", ",").alias("pending"), sources.alias("sources"), F.when(F.col("domain").isNotNull(), overrode).alias("overrode"))


def rul5_decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rules.decision_log(rules.resolve(briefs(spark, sf_dir)))
    return log.groupBy("attr", "value", "source", "confidence", "overrode").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


def rul5_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each step of the log is taken, with its reason, for briefs with answers."""
    log = rules.decision_log(rules.resolve(answered(spark, sf_dir)))
    return log.groupBy("attr", "source", "overrode", "reason").agg(F.count("*").alias("n"))


def rul7_constraints_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resolve(briefs(spark, sf_dir)).select("brief_id", F.array_join("constraints", "|").alias("constraints"), "conflict")


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.resolve(briefs(spark, sf_dir)).filter("domain IS NOT NULL")
    return rules.select_topology(r.select("brief_id", *(F.col(f"{a}.value").alias(a.lower()) for a in ATTRIBUTES)))


def rul10_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select("brief_id", F.array_join("candidates", ",").alias("candidates"), "topology")


def rul12_projection_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.projection_edges(spark, _chosen(spark, sf_dir)).drop("component_order")


def rul12_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.component_controls(spark, _chosen(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        rul1_domain_scores, rul1_domain_pick, rul3_stated_values, rul2_requirements, rul4_answers, rul5_decision_log, rul5_reasons, rul7_constraints_conflicts, rul10_topology,
        rul12_projection_edges, rul12_components,
    )
}


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


KEYWORDS = _values([(d, i, k, w) for i, (d, ws) in enumerate(rules.DOMAIN_KEYWORDS.items()) for k, w in ws.items()])
STATED = _values([(a, j, v, p) for a, vs in rules.STATED.items() for j, (v, ps) in enumerate(vs) for p in ps])
PRIORS = _values([(d, a, v, int(ask)) for d, attrs in rules.DOMAIN_PRIORS.items() for a, (v, ask) in attrs.items()])
CATALOG = _values([(i, k, " ".join(s), int(e), int(a), int(d)) for i, (k, s, e, a, d, _) in enumerate(rules.TOPOLOGIES)])
SERVED = _values([(s, rules.COMPONENTS.index(c), c) for s, cs in rules.STAGE_COMPONENTS.items() for c in cs])

SCORES = f"""{BRIEFS_SQL},
kw AS (SELECT * FROM {KEYWORDS} AS k(domain, ord, word, weight)),
scores AS (SELECT brief_id, domain, ord, sum(CASE WHEN contains(lower(brief), word) THEN weight ELSE 0 END)::INT AS score FROM briefs, kw GROUP BY ALL),
picked AS (SELECT brief_id, CASE WHEN max(score) > 0 THEN arg_min(domain, (-score, ord)) END AS domain FROM scores GROUP BY brief_id)"""
SAID = f"""st AS (SELECT * FROM {STATED} AS s(attr, ord, value, phrase)),
said AS (SELECT brief_id, attr, arg_min(value, ord) AS value FROM briefs JOIN st ON contains(lower(brief), phrase) GROUP BY ALL)"""
NEEDS = f"""{SCORES}, {SAID},
pr AS (SELECT * FROM {PRIORS} AS p(domain, attr, value, ask)),
long AS (SELECT p.brief_id, p.domain, pr.attr, coalesce(said.value, pr.value) AS value, CASE WHEN said.value IS NULL THEN ask ELSE 0 END AS pend
         FROM picked p JOIN pr ON pr.domain = p.domain LEFT JOIN said ON said.brief_id = p.brief_id AND said.attr = pr.attr),
wide AS (SELECT p.brief_id, p.domain, {", ".join(f"max(value) FILTER (attr = '{a}') AS {a.lower()}" for a in ATTRIBUTES)},
         CASE WHEN p.domain IS NULL THEN '{",".join(ATTRIBUTES)}' ELSE coalesce(string_agg(attr, ',' ORDER BY attr[2:]::INT) FILTER (pend = 1), '') END AS pending
         FROM picked p LEFT JOIN long USING (brief_id) GROUP BY p.brief_id, p.domain)"""
CHOSEN = f"""{NEEDS},
cat AS (SELECT * FROM {CATALOG} AS c(ord, key, stages, exact, adaptive, direct)),
cand AS (SELECT w.brief_id, a1, a2, a3, a8, a11, a12, string_agg(key, ',' ORDER BY ord) AS candidates FROM wide w, cat
         WHERE w.domain IS NOT NULL AND NOT (coalesce(a2 = 'high', false) AND exact = 0) AND NOT (coalesce(a12 = 'gated', false) AND direct = 1)
           AND NOT (coalesce(a8 = 'strict', false) AND coalesce(a1 NOT IN ('costly', 'catastrophic'), true) AND adaptive = 1) GROUP BY ALL),
chosen AS (SELECT *, CASE WHEN a3 = 'multi-hop' AND contains(candidates, 'adaptive_agentic') THEN 'adaptive_agentic'
         WHEN a2 = 'high' AND a1 IN ('costly', 'catastrophic') AND contains(candidates, 'two_stage_hybrid_rerank') THEN 'two_stage_hybrid_rerank'
         WHEN a2 = 'high' AND contains(candidates, 'single_stage_hybrid') THEN 'single_stage_hybrid'
         WHEN contains(candidates, 'two_stage_dense_rerank') THEN 'two_stage_dense_rerank' ELSE string_split(candidates, ',')[-1] END AS topology FROM cand)"""
EDGES = f"""{CHOSEN},
sv AS (SELECT * FROM {SERVED} AS s(stage, component_order, component)),
stages AS (SELECT brief_id, a2, a11, a12, string_split(stages || CASE WHEN a12 = 'gated' THEN ' review_gate' ELSE '' END, ' ') AS s FROM chosen JOIN cat ON key = topology),
flat AS (SELECT brief_id, a2, a11, a12, unnest(s) AS stage, generate_subscripts(s, 1)::INT AS stage_order FROM stages)"""
ANSWERS = """ans AS (SELECT brief_id, unnest([CASE WHEN length(brief) % 2 = 0 THEN {'a': 'A3', 'v': 'multi-hop'} END, CASE WHEN length(brief) % 3 = 0 THEN {'a': 'A12', 'v': 'gated'} END, {'a': 'A9', 'v': 'multilingual'}, CASE WHEN length(brief) % 7 = 0 THEN {'a': 'A1', 'v': 'costly'} END]) AS x FROM briefs WHERE length(brief) % 5 > 0)"""
_CONSTRAINTS = ", ".join(f"CASE WHEN {a.lower()} = '{v}' THEN '{t}' END" for a, v, t in rules.CONSTRAINTS)
_EXTERNAL = " OR ".join(f"contains(lower(brief), '{p}')" for p in rules.EXTERNAL)

ORACLE_SQL = {
    "rul1_domain_scores": f"WITH {SCORES} SELECT * FROM scores",
    "rul1_domain_pick": f"WITH {SCORES} SELECT * FROM picked",
    "rul3_stated_values": f"WITH {BRIEFS_SQL}, {SAID} SELECT b.brief_id, {', '.join(f'''max(value) FILTER (attr = '{a}') AS {a.lower()}''' for a in rules.STATED)} FROM briefs b LEFT JOIN said USING (brief_id) GROUP BY ALL",
    "rul2_requirements": f"WITH {NEEDS} SELECT * FROM wide",
    "rul5_reasons": f"""
WITH {SCORES}, {SAID}, pr AS (SELECT * FROM {PRIORS} AS p(domain, attr, value, ask)), {ANSWERS},
given AS (SELECT a.brief_id, a.x.a AS attr, a.x.v AS value, coalesce(s.value, pr.value) AS before FROM ans a JOIN picked p ON p.brief_id = a.brief_id JOIN pr ON pr.domain = p.domain AND pr.attr = a.x.a LEFT JOIN said s ON s.brief_id = a.brief_id AND s.attr = a.x.a WHERE a.x.a IS NOT NULL),
last AS (SELECT p.brief_id, pr.attr, coalesce(g.value, s.value, pr.value) AS value FROM picked p JOIN pr ON pr.domain = p.domain LEFT JOIN said s ON s.brief_id = p.brief_id AND s.attr = pr.attr LEFT JOIN given g ON g.brief_id = p.brief_id AND g.attr = pr.attr),
four AS (SELECT brief_id, max(value) FILTER (attr = 'A1') AS a1, max(value) FILTER (attr = 'A4') AS a4, max(value) FILTER (attr = 'A5') AS a5, max(value) FILTER (attr = 'A8') AS a8 FROM last GROUP BY brief_id),
conflicts AS (SELECT CASE WHEN a4 = 'sectoral' AND a5 = 'regulated-personal' AND ({_EXTERNAL}) THEN 'A4,A5' WHEN a1 = 'catastrophic' AND a8 = 'strict' THEN 'A1,A8' END AS c FROM four JOIN briefs USING (brief_id)),
steps AS (SELECT 'domain' AS attr, 'inferred' AS source, NULL::VARCHAR AS before, NULL::VARCHAR AS value, '{rules.NO_DOMAIN}' AS reason FROM picked WHERE domain IS NULL
  UNION ALL SELECT attr, 'domain-prior', NULL, value, 'Seeded from ' || domain || ' profile with ' || CASE WHEN ask = 1 THEN 'elicit' ELSE 'strong' END || ' confidence.' FROM picked JOIN pr USING (domain)
  UNION ALL SELECT s.attr, 'stated', pr.value, s.value, 'User brief explicitly indicates ' || s.attr || '=' || s.value || '.' FROM picked p JOIN said s USING (brief_id) JOIN pr ON pr.domain = p.domain AND pr.attr = s.attr
  UNION ALL SELECT attr, 'stated', before, value, '{rules.ANSWERED}' FROM given
  UNION ALL SELECT 'conflict', 'inferred', NULL, c, CASE c {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.CONFLICT_REASONS.items())} END FROM conflicts WHERE c IS NOT NULL)
SELECT attr, source, coalesce(before <> value, false) AS overrode, reason || CASE WHEN before <> value THEN ' Overrides prior value ''' || before || ''' with ''' || value || '''.' ELSE '' END AS reason, count(*) AS n FROM steps GROUP BY ALL""",
    "rul4_answers": f"""
WITH {SCORES}, {SAID}, pr AS (SELECT * FROM {PRIORS} AS p(domain, attr, value, ask)),
{ANSWERS},
long AS (SELECT p.brief_id, pr.attr, coalesce(ans.x.v, said.value, pr.value) AS value, CASE WHEN ans.x.v IS NULL AND said.value IS NULL THEN ask ELSE 0 END AS pend, CASE WHEN ans.x.v IS NULL AND said.value IS NULL THEN 'domain-prior' ELSE 'stated' END AS source,
  CASE WHEN ans.x.v IS NOT NULL THEN ans.x.v <> coalesce(said.value, pr.value) WHEN said.value IS NOT NULL THEN said.value <> pr.value ELSE false END AS overrode
  FROM picked p JOIN pr ON pr.domain = p.domain LEFT JOIN said ON said.brief_id = p.brief_id AND said.attr = pr.attr LEFT JOIN ans ON ans.brief_id = p.brief_id AND ans.x.a = pr.attr)
SELECT p.brief_id, p.domain, {", ".join(f"max(value) FILTER (attr = '{a}') AS {a.lower()}" for a in ATTRIBUTES)}, CASE WHEN p.domain IS NULL THEN '{",".join(ATTRIBUTES)}' ELSE coalesce(string_agg(attr, ',' ORDER BY attr[2:]::INT) FILTER (pend = 1), '') END AS pending,
  {" || ',' || ".join(f"coalesce(max(source) FILTER (attr = '{a}'), '-')" for a in ("A1", "A3", "A7", "A9", "A12"))} AS sources, CASE WHEN p.domain IS NOT NULL THEN coalesce(string_agg(attr, ',' ORDER BY attr[2:]::INT) FILTER (overrode), '') END AS overrode
FROM picked p LEFT JOIN long USING (brief_id) GROUP BY p.brief_id, p.domain""",
    "rul5_decision_log": f"""
WITH {SCORES}, {SAID}, pr AS (SELECT * FROM {PRIORS} AS p(domain, attr, value, ask)),
steps AS (
  SELECT brief_id, 0 AS phase, 0 AS n, 'domain' AS attr, NULL AS value, 'inferred' AS source, 0.0 AS confidence, false AS overrode FROM picked WHERE domain IS NULL
  UNION ALL SELECT brief_id, 1, attr[2:]::INT, attr, value, 'domain-prior', CASE WHEN ask = 1 THEN 0.55 ELSE 0.9 END, false FROM picked JOIN pr USING (domain)
  UNION ALL SELECT p.brief_id, 2, s.attr[2:]::INT, s.attr, s.value, 'stated', 0.95, s.value <> pr.value FROM picked p JOIN said s USING (brief_id) JOIN pr ON pr.domain = p.domain AND pr.attr = s.attr),
full_ AS (SELECT * FROM steps UNION ALL
  SELECT brief_id, 3, 0, 'conflict', conflict, 'inferred', 0.8, false FROM (
    SELECT p.brief_id, CASE WHEN coalesce(v4, p4) = 'sectoral' AND coalesce(v5, p5) = 'regulated-personal' AND ({_EXTERNAL}) THEN 'A4,A5' WHEN p1 = 'catastrophic' AND coalesce(v8, p8) = 'strict' THEN 'A1,A8' END AS conflict
    FROM picked p JOIN briefs USING (brief_id)
    JOIN (SELECT domain, max(value) FILTER (attr = 'A1') AS p1, max(value) FILTER (attr = 'A4') AS p4, max(value) FILTER (attr = 'A5') AS p5, max(value) FILTER (attr = 'A8') AS p8 FROM pr GROUP BY domain) USING (domain)
    LEFT JOIN (SELECT brief_id, max(value) FILTER (attr = 'A4') AS v4, max(value) FILTER (attr = 'A5') AS v5, max(value) FILTER (attr = 'A8') AS v8 FROM said GROUP BY brief_id) s USING (brief_id)) WHERE conflict IS NOT NULL),
seqd AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY phase, n) - 1 AS seq FROM full_)
SELECT attr, value, source, confidence::DOUBLE AS confidence, overrode, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM seqd GROUP BY ALL""",
    "rul7_constraints_conflicts": f"""
WITH {NEEDS} SELECT brief_id, array_to_string(list_filter([{_CONSTRAINTS}], lambda x: x IS NOT NULL), '|') AS constraints,
  CASE WHEN a4 = 'sectoral' AND a5 = 'regulated-personal' AND ({_EXTERNAL}) THEN 'A4,A5' WHEN a1 = 'catastrophic' AND a8 = 'strict' THEN 'A1,A8' END AS conflict
FROM wide JOIN briefs USING (brief_id)""",
    "rul10_topology": f"WITH {CHOSEN} SELECT brief_id, candidates, topology FROM chosen",
    "rul12_projection_edges": f"WITH {EDGES} SELECT brief_id, stage_order, stage, component FROM flat JOIN sv USING (stage)",
    "rul12_components": f"""
WITH {EDGES} SELECT brief_id, component, string_agg(stage, ',' ORDER BY stage_order) AS serves,
  array_to_string(list_filter([CASE WHEN any_value(a2) = 'high' AND component = 'storage' THEN 'lexical_index_required' END,
    CASE WHEN any_value(a12) = 'gated' AND component IN ('database', 'security', 'storage') THEN 'review_queue_required' END,
    CASE WHEN any_value(a11) = 'mandatory' AND component IN ('monitoring', 'security', 'storage') THEN 'audit_log_required' END], lambda x: x IS NOT NULL), ',') AS controls
FROM flat JOIN sv USING (stage) GROUP BY brief_id, component""",
}

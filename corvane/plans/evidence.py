"""Registered queries: links, sentences, themes, page text, snippets, and evidence packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evidence
from corvane.plans.common import t

KEYWORDS = ("the", "tion", "wh", "ever", "que")
LOW_SECTIONS = ("references", "source map", "source pointers")
USEFUL = ("and", "ing", "tion", "er", "que", "ment", "das")
LOW_TYPES = ("code_fence", "mermaid", "reference")
LOW_PATHS = ("00_readme.md", "06_references.md", "07_references.md", "09_references_and_source_map.md")
#: Words that the invented prose lacks and the rules look for.
TOPICS = ("hybrid bm25 blue-green", "embedding dimension changes", "rerank cross-encoder grounding", "audit permission security", "gold ndcg recall latency", "terraform cloud billing", "chunking parser", "plain")


def _topic(key: str):
    return F.get(F.array(*map(F.lit, TOPICS)), (F.col(key) % len(TOPICS)).cast("int"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address in markdown, bare, on a code host and with a full stop."""
    at = F.col("page_id").cast("string")
    text = F.concat(
        F.lit("see [page "), at, F.lit("]("), "url", F.lit(") and "), "url", F.lit(". Also https://github.com/o/r/blob/main/"), at, F.lit(".md; https://arxiv.org/abs/"), at,
        F.lit(", [Paper](https://arxiv.org/abs/"), at, F.lit(") https://docs.example.org/a-b_c/"), at, F.lit("/ end"),
    )
    return t(spark, sf_dir, "pages").select("page_id", text.alias("text"))


def evd8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.links(_linked(spark, sf_dir), by="page_id")


def srt5_summary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.summary_links(evidence.links(_linked(spark, sf_dir), by="page_id"), 3, by="page_id").select("page_id", F.col("place").cast("long").alias("place"), "url", evidence.raw_url(F.col("url")).alias("raw_url"))


def evd9_source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = evidence.links(_linked(spark, sf_dir), by="page_id")
    return links.groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


def evd10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", evidence.html_to_text(F.col("html")).alias("text"))


#: What stands before a document's text, so that the rules for marks, code, headings, tables and open fences are met.
BEFORE = ("", "- **Bold** `x` [link](http://a/b) and corpus/a/b.md $x$ ", "```\ncode\n```\n# Head\nSource: x\n", "| a | b |\n|---|---|\n", "~~~\n1. open ")


def evd3_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    before = F.get(F.array(*map(F.lit, BEFORE)), (F.col("doc_id") % len(BEFORE)).cast("int"))
    return docs.select("doc_id", evidence.display_snippet(F.concat(before, "text"), F.col("source"), F.lit("prose")).alias("snippet"))


def evd12_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "documents").select("doc_id", evidence.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def evd13_selected_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = evidence.select_sentences(t(spark, sf_dir, "documents"), KEYWORDS, 4)
    return chosen.withColumn("place", F.col("place").cast("long"))


def evd14_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "text", _topic("doc_id"), _topic("n_chars"))
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(evidence.themes(text), ",").alias("themes"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    head = F.concat_ws(" ", F.substring("text", 1, 150), _topic("doc_id"))
    return d.select(
        (F.col("doc_id") % 50).alias("brief_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("s"), (F.col("doc_id") % 400).cast("string")).alias("source_id"),
        F.lower("source").alias("title"), F.concat_ws(" > ", F.lit("Guide"), F.concat(F.lit("2. "), F.col("source"))).alias("section"), head.alias("snippet"),
        F.concat_ws("/", "lang", "source").alias("source_path"), F.when(F.col("doc_id") % 9 == 0, "table").when(F.col("doc_id") % 10 == 0, "reference").otherwise("prose").alias("element_type"),
        F.array(F.get(F.array(*map(F.lit, evidence.AGENTS)), (F.col("doc_id") % 4).cast("int"))).alias("agents"),
    )


def _quality():
    return evidence.quality(F.col("snippet"), F.col("section"), F.col("source_path"), F.col("element_type"), LOW_TYPES, LOW_PATHS, LOW_SECTIONS, USEFUL)


def evd4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select(F.col("ord").alias("doc_id"), _quality().alias("quality"))


def evd5_evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    found = s.select("brief_id", F.get("agents", F.lit(0)).alias("agent"), F.col("ord").alias("rank"), "source_id", (F.col("ord") % 97 / 10.0).alias("score"), (_quality() - 4).alias("quality"))
    return evidence.pack(found, per_agent=2).withColumn("place", F.col("place").cast("long"))


def evd6_source_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = evd5_evidence_pack(spark, sf_dir)
    area = evidence.picks(packed, ("security", "retrieval"))
    panel = evidence.picks(packed, ("security", "retrieval"), 2, fall_back_per_agent=True)
    return area.withColumn("variant", F.lit("area")).unionByName(panel.withColumn("variant", F.lit("panel"))).withColumn("n", F.col("n").cast("long"))


def evd15_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", evidence.document_status(F.col("text"), F.col("doc_id") % 6 > 0).alias("status"))


def agg16_theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of each topic word over the corpus, by language."""
    words = ("the", "ing", "que", "sch", "ción")
    d = t(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(*(F.sum(T.occurrences(F.lower("text"), w)).alias(f"n{i}") for i, w in enumerate(words)))


def evd17_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = _sources(spark, sf_dir).withColumn("quality", _quality())
    return evidence.curate(quality).select("brief_id", F.col("ord").alias("doc_id"), "bucket", F.col("place").cast("long").alias("place"))


def evd16_clean_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws(" > ", F.lit("Top"), F.concat(F.lit("1. "), F.col("source")), F.lit(" "), F.concat(F.lit("2 - "), F.col("lang")), F.lit("# Tail #"))
    return t(spark, sf_dir, "documents").select("doc_id", evidence.clean_section(path).alias("section"))


def evd20_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("brief_hash"), T.occurrences(F.lower("text"), "the").alias("mentions"))


QUERIES = {
    f.__name__: f
    for f in (
        evd8_links, srt5_summary_links, evd9_source_types, evd10_page_text, evd3_snippets, evd12_sentences, evd13_selected_sentences, evd14_themes, evd4_quality,
        evd5_evidence_pack, evd6_source_picks, evd15_document_status, agg16_theme_counts, evd17_curation, evd16_clean_sections, evd20_audit,
    )
}


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(n)})" for n in needles) + ")"


def _sum(text: str, needles) -> str:
    return " + ".join(f"(CASE WHEN contains({text}, {_lit(n)}) THEN 1 ELSE 0 END)" for n in needles)


def _count(text: str, n: str) -> str:
    return f"((length({text}) - length(replace({text}, {_lit(n)}, ''))) // {len(n)})"


def _re(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {_lit(pattern)}, {_lit(by.replace('$1', chr(92) + '1'))}, 'g')"


def _compact(x: str) -> str:
    return f"trim({_re(x, evidence.SPACE, ' ')}, ' ')"


def _plain(x: str) -> str:
    for pattern, by in evidence.INLINE:
        x = _re(x, pattern, by)
    return _compact(x)


def _unescaped(x: str) -> str:
    """References of x as characters; numbers and names are maps of the table `known`."""
    digits = "regexp_extract(r, '^&#[xX]?0*([0-9a-fA-F]*)', 1)"
    n = f"CASE WHEN length({digits}) > 8 THEN 1114112 WHEN r[2:3] IN ('#x', '#X') THEN ('0x0' || {digits})::BIGINT ELSE ('0' || {digits})::BIGINT END"
    char = "CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(n::INT) END"
    by_number = f"list_transform([{n}], lambda n: coalesce(numbers[n], {char}))[1]"
    start = f"regexp_extract(r[2:], '^(?:{'|'.join(evidence.BARE_NAMES)})')"
    by_name = f"coalesce(names[r[2:]], CASE WHEN {start} = '' THEN r ELSE names[{start}] || r[length({start}) + 2:] END)"
    refs = f"list_append(list_transform(regexp_extract_all({x}, {_lit(evidence.REFERENCE)}), lambda r: CASE WHEN r[:2] = '&#' THEN {by_number} ELSE {by_name} END), '')"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, {_lit(evidence.REFERENCE)}), {refs}), lambda z: z[1] || z[2]), '')"


_ALL_NAMES = {k: v for part in evidence.NAMES.values() for k, v in part.items()}
KNOWN = f"known AS (SELECT MAP([{', '.join(map(_lit, _ALL_NAMES))}], [{', '.join(map(_lit, _ALL_NAMES.values()))}]) AS names, MAP([{', '.join(evidence.NUMBERS)}]::BIGINT[], [{', '.join(map(_lit, evidence.NUMBERS.values()))}]) AS numbers)"


def _back(mark: str, least: int, dots: str = "") -> str:
    return f"CASE WHEN instr(reverse(head), {_lit(mark[::-1])}) > 0 AND length(head) - instr(reverse(head), {_lit(mark[::-1])}) - {len(mark) - 1} >= {least} THEN rtrim(substr(head, 1, length(head) - instr(reverse(head), {_lit(mark[::-1])})), ' ') || '{dots}' END"


_FENCED = r"(?s)(?:^|\n)[^\S\n]*(?:```|~~~).*?(?:\n[^\S\n]*(?:```|~~~)[^\n]*|\z)"
_IS_TABLE = f"(regexp_matches(x, {_lit(evidence.TABLE_LINE)}) AND x <> '|')"
PAGE_TEXT = f"""
WITH bare AS (SELECT page_id, {_re("coalesce(html, '')", evidence.MARKUP, chr(10))} AS whole FROM pages),
cut AS (SELECT page_id, CASE WHEN regexp_matches(right(whole, 34), {_lit(evidence.CUT_REFERENCE)}) THEN substr(whole, 1, length(whole) - length(string_split(whole, chr(10))[-1])) ELSE whole END AS t FROM bare),
{KNOWN}, lines AS (SELECT page_id, regexp_split_to_array({_unescaped('t')}, {_lit(evidence.LINE_BREAK)}) AS l FROM cut, known)
SELECT page_id, array_to_string(list_filter(list_transform(l, lambda x: {_compact('x')}), lambda x: x <> ''), chr(10)) AS text FROM lines"""
SNIPPETS = f"""
WITH texts AS (SELECT doc_id, source, [{", ".join(map(_lit, BEFORE))}][1 + doc_id % {len(BEFORE)}] || text AS text FROM documents),
split AS (SELECT *, list_filter(list_transform(regexp_split_to_array({_re('text', _FENCED, chr(10))}, {_lit(evidence.LINE_BREAK)}), lambda x: {_compact('x')}), lambda x: x <> '') AS lines FROM texts),
shown AS (SELECT *, array_to_string(list_filter(list_transform(list_filter(lines, lambda x: NOT {_IS_TABLE} AND NOT regexp_matches(x, {_lit(evidence.NO_PROSE)})), lambda x: {_plain('x')}), lambda x: x <> ''), ' ') AS prose FROM split),
picked AS (SELECT doc_id, {_plain(f"CASE WHEN prose <> '' THEN prose WHEN len(list_filter(lines, lambda x: {_IS_TABLE})) > 0 THEN {_lit(evidence.TABLE_OF)} || lower(source) || {_lit(evidence.TABLE_FIELDS)} ELSE {_plain(_compact('text'))} END")} AS out FROM shown),
heads AS (SELECT *, substr(out, 1, {evidence.SNIPPET_CHARS - 3}) AS head FROM picked)
SELECT doc_id, CASE WHEN length(out) <= {evidence.SNIPPET_CHARS} THEN out ELSE coalesce({_back('. ', 110)}, {_back('; ', 110)}, {_back(' ', 73, '...')}, rtrim(head, ' ') || '...') END AS snippet FROM heads"""

_TOPICS = "[" + ", ".join(map(_lit, TOPICS)) + "]"
_TYPE = "CASE " + " ".join(f"WHEN {_any('lower(url)', ns)} THEN '{k}'" for k, ns in evidence.SOURCE_TYPES) + " ELSE 'web' END"
LINKED = "linked AS (SELECT page_id, 'see [page ' || page_id || '](' || url || ') and ' || url || '. Also https://github.com/o/r/blob/main/' || page_id || '.md; https://arxiv.org/abs/' || page_id || ', [Paper](https://arxiv.org/abs/' || page_id || ') https://docs.example.org/a-b_c/' || page_id || '/ end' AS text FROM pages)"
LINKS = rf"""{LINKED},
raw AS (SELECT page_id, regexp_extract_all(text, '\[([^\]]+)\]\((https?://[^)]+)\)', 1) AS la, regexp_extract_all(text, '\[([^\]]+)\]\((https?://[^)]+)\)', 2) AS ua, regexp_extract_all(text, 'https?://[^\s)\]>"'']+') AS ub FROM linked),
flat AS (SELECT page_id, unnest(list_concat(la, list_transform(ub, lambda x: NULL::VARCHAR))) AS label, regexp_replace(trim(unnest(list_concat(ua, ub))), '[.,;]+$', '') AS url, unnest(range(len(ua) + len(ub)))::INT AS seq FROM raw),
uniq AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY seq) = 1),
links AS (SELECT page_id, seq, trim(regexp_replace(coalesce(label, string_split(split_part(url, '//', 2), '/')[1] || ': ' || translate(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '-_', '  ')), '\s+', ' ', 'g'))[:120] AS label, url, {_TYPE} AS source_type FROM uniq)"""
_PRIORITY = "coalesce(nullif(list_position([" + ", ".join(map(_lit, evidence.LINK_PRIORITY)) + "], source_type), 0), 10)"
SENTENCES = rf"""parts AS (SELECT doc_id, list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)) AS p FROM documents),
sent AS (SELECT doc_id, list_filter(p, lambda s: length(s) BETWEEN 45 AND 360 AND NOT {_any('lower(s)', evidence.BOILERPLATE)}) AS s FROM parts)"""
SOURCES = f"""src AS (SELECT doc_id % 50 AS brief_id, doc_id AS ord, 's' || (doc_id % 400) AS source_id, lower(source) AS title, 'Guide > 2. ' || source AS section,
  text[:150] || ' ' || ({_TOPICS})[1 + doc_id % {len(TOPICS)}] AS snippet, lang || '/' || source AS source_path,
  CASE WHEN doc_id % 9 = 0 THEN 'table' WHEN doc_id % 10 = 0 THEN 'reference' ELSE 'prose' END AS element_type, (doc_id % 4)::INT AS agent FROM documents)"""
_RULES = (
    ("lower(element_type) IN ('code_fence', 'mermaid', 'reference')", -9), ("lower(element_type) = 'table'", -4),
    ("(" + " OR ".join(f"ends_with(lower(source_path), '{p}')" for p in LOW_PATHS) + ")", -5), (_any("lower(section)", LOW_SECTIONS), -4),
    ("starts_with(lower(snippet), 'generated:')", -6), ("starts_with(lower(snippet), '```')", -5), (f"{_count('lower(snippet)', 'http')} >= 2", -3),
    (_any("lower(snippet)", ("blue-green", "dimension changes")), 4), (_any("lower(snippet)", ("embedding model upgrades", "re-embedding")), 3),
    (_any("lower(section)", ("choose embedding dimension", "lower dimension")), 5), ("contains(lower(snippet), 'dimension choice drives')", 4),
)
QUALITY = "(CASE WHEN length(snippet) >= 120 THEN 3 WHEN length(snippet) >= 70 THEN 1 ELSE -4 END + " + " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, p in _RULES) + f" + least(5, {_sum('lower(snippet)', USEFUL)}))::INT"
_THEMES = ", ".join("{'score': " + " + ".join(_count("t", x) for x in terms) + f", 'name': {_lit(n)}}}" for n, terms in evidence.THEMES.items())
_TOK = dict(evidence.BUCKETS)
_BUCKET = "CASE " + " ".join(f"WHEN {c} THEN '{b}'" for c, b in [
    ("agent = 1", "security"), (_any("shown", _TOK["chunking"]), "chunking"), ("agent = 3 AND " + _any("txt", ("gold", "evaluation", "mrr", "ndcg", "recall")), "evaluation"),
    ("agent = 2 AND " + _any("txt", ("cloud", "terraform", "managed vector", "billing")), "deployment"), (_any("shown", _TOK["reranking_context"]), "reranking_context"),
    (_any("txt", _TOK["embedding_vector"]), "embedding_vector"), (_any("txt", _TOK["retrieval"]), "retrieval"), *((_any("txt", ts), b) for b, ts in evidence.BUCKETS),
    ("agent = 0", "retrieval"), ("agent = 2", "embedding_vector"), ("agent = 3", "evaluation"),
]) + " ELSE 'requirements' END"
_AGENTS = "[" + ", ".join(map(_lit, evidence.AGENTS)) + "]"

PACK = f"""
WITH {SOURCES}, f AS (SELECT brief_id, agent, ord AS rank, source_id, ord % 97 / 10.0 AS score, {QUALITY} - 4 AS quality FROM src),
s AS (SELECT brief_id, source_id, min(agent) AS agent_rank, arg_min(score, (agent, rank)) AS score, arg_min(quality, (agent, rank)) AS quality, min((agent, rank)) AS seen, list_sort(list(DISTINCT agent)) AS agents FROM f GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY agent_rank, quality DESC, score DESC, seen) AS place FROM s),
e AS (SELECT *, unnest(agents) AS agent FROM p),
c AS (SELECT *, max(CASE WHEN quality >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY brief_id, agent) AS good, row_number() OVER (PARTITION BY brief_id, agent, quality >= 0 ORDER BY place) AS n, min(place) OVER (PARTITION BY brief_id, agent) AS fp FROM e),
h AS (SELECT brief_id, source_id, min((agent, place)) AS shown FROM c WHERE CASE WHEN good = 1 THEN quality >= 0 AND n <= 2 ELSE place = fp END GROUP BY ALL)
SELECT brief_id, source_id, score::DOUBLE AS score, quality, place, shown IS NOT NULL AS display, 'E' || row_number() OVER (PARTITION BY brief_id ORDER BY shown NULLS LAST, place) AS label,
  array_to_string(list_transform(agents, lambda a: ({_AGENTS})[a + 1]), ',') AS used_by FROM p LEFT JOIN h USING (brief_id, source_id)"""

def _points() -> str:
    parts = []
    for name, where, words, points in evidence.BOOSTS:
        if where == "section_or_title":
            hit = f"(contains(lower(section), '{words[0]}') OR contains(lower(title), '{words[1]}'))"
        else:
            hit = _any("lower(section)", words) if where == "section" else "(" + _any("lower(section)", words) + " OR " + _any("lower(snippet)", words) + ")"
        parts.append(f"CASE WHEN bucket = '{name}' AND {hit} THEN {points} ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


_POINTS = _points()

ORACLE_SQL = {
    "evd10_page_text": PAGE_TEXT,
    "evd3_snippets": SNIPPETS,
    "evd8_links": f"WITH {LINKS} SELECT * FROM links",
    "srt5_summary_links": f"""
WITH {LINKS}, p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {_PRIORITY}, seq) AS place FROM links)
SELECT page_id, place, url, CASE WHEN contains(url, 'github.com') AND contains(url, '/blob/') THEN replace(replace(url, 'https://github.com/', 'https://raw.githubusercontent.com/'), '/blob/', '/') ELSE url END AS raw_url FROM p WHERE place <= 3""",
    "evd9_source_types": f"WITH {LINKS} SELECT source_type, count(*) AS n, count(DISTINCT url) AS urls FROM links GROUP BY 1",
    "evd12_sentences": f"WITH {SENTENCES} SELECT doc_id, len(s)::INT AS n, md5(array_to_string(s, '|')) AS sentences_md5 FROM sent",
    "evd13_selected_sentences": f"""
WITH {SENTENCES}, flat AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS place_in FROM sent), scored AS (SELECT *, {_sum('lower(sentence)', KEYWORDS)} AS score FROM flat),
best AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM scored)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place_in) AS place, sentence FROM best WHERE score > 0 OR top = 0 QUALIFY place <= 4""",
    "evd14_themes": f"""
WITH d AS (SELECT doc_id, lower(text || ' ' || ({_TOPICS})[1 + doc_id % {len(TOPICS)}] || ' ' || ({_TOPICS})[1 + n_chars % {len(TOPICS)}]) AS t FROM documents), s AS (SELECT doc_id, unnest([{_THEMES}]) AS x FROM d)
SELECT doc_id, coalesce(string_agg(x.name, ',' ORDER BY x.score DESC, x.name DESC) FILTER (x.score > 0), '') AS themes FROM s GROUP BY doc_id""",
    "evd4_quality": f"WITH {SOURCES} SELECT ord AS doc_id, {QUALITY} AS quality FROM src",
    "evd5_evidence_pack": PACK,
    "evd6_source_picks": f"""
WITH pack AS ({PACK}), used AS (SELECT brief_id, source_id, quality, place, unnest(string_split(used_by, ',')) AS agent FROM pack),
u AS (SELECT *, CASE agent WHEN 'security' THEN 1 ELSE 2 END AS ord FROM used WHERE agent IN ('security', 'retrieval')),
g AS (SELECT *, max(CASE WHEN quality >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY brief_id) AS ga, max(CASE WHEN quality >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY brief_id, ord) AS gp FROM u),
a AS (SELECT brief_id, source_id, min((ord, place)) AS at_ FROM g WHERE quality >= 0 OR ga = 0 GROUP BY ALL), p AS (SELECT brief_id, source_id, min((ord, place)) AS at_ FROM g WHERE quality >= 0 OR gp = 0 GROUP BY ALL)
SELECT brief_id, row_number() OVER (PARTITION BY brief_id ORDER BY at_) AS n, source_id, 'area' AS variant FROM a QUALIFY n <= 3
UNION ALL SELECT brief_id, row_number() OVER (PARTITION BY brief_id ORDER BY at_) AS n, source_id, 'panel' FROM p QUALIFY n <= 2""",
    "evd15_document_status": r"SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'failed' WHEN len(regexp_extract_all(text, '\S+')) < 80 THEN 'short' ELSE 'full' END AS status FROM documents",
    "agg16_theme_counts": "SELECT lang, " + ", ".join(f"sum({_count('lower(text)', w)})::BIGINT AS n{i}" for i, w in enumerate(("the", "ing", "que", "sch", "ción"))) + " FROM documents GROUP BY lang",
    "evd17_curation": f"""
WITH {SOURCES}, a AS (SELECT * REPLACE (trim(snippet) AS snippet) FROM src QUALIFY row_number() OVER (PARTITION BY brief_id, source_id ORDER BY ord) = 1),
b AS (SELECT *, lower(concat_ws(' ', title, section, snippet)) AS shown, lower(concat_ws(' ', source_id, title, section, snippet, source_path)) AS txt FROM a WHERE length(snippet) >= 45 AND element_type NOT IN ('code_fence', 'mermaid', 'reference')),
c AS (SELECT *, {_BUCKET} AS bucket, {QUALITY} AS quality FROM b),
k AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY brief_id, bucket, title, lower(snippet)[:140] ORDER BY ord) = 1)
SELECT brief_id, ord AS doc_id, bucket, row_number() OVER (PARTITION BY brief_id, bucket ORDER BY quality + {_POINTS} DESC, length(section), lower(section), ord) AS place FROM k""",
    "evd16_clean_sections": "SELECT doc_id, source || ' > ' || lang || ' > Tail' AS section FROM documents",
    "evd20_audit": f"SELECT doc_id, sha256(text)[:16] AS brief_hash, {_count('lower(text)', 'the')}::INT AS mentions FROM documents",
}

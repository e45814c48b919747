"""Registered queries: text functions, lexical and dense retrieval, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.functions.plan import small, stored
from corvane.operators import chunking, dense, fusion, lexical
from corvane.plans.common import chunks, query_vectors, questions, t, tokens_sql, vectors


def chk1_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


def chk2_last_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", T.last_words(F.col("text"), chunking.OVERLAP_WORDS).alias("tail"))


def chk3_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


TAIL = """

### Notes
short notes
### Code ###
```python
# no heading
1. no item
```
| name | value |
|---|:-:|
| a | 1 |
| b | 2 | 3 |

1. one

2) two
3. three
~~~
never closed
## hidden
"""


def chk15_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a markdown file with a paragraph per line, and with code, a table, a list and tiny sections behind it: the structural chunker over all of them."""
    docs = t(spark, sf_dir, "documents")
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## Part\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit(TAIL))
    files = docs.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), body.alias("text"), F.array("lang").alias("section_tags"))
    return chunking.chunk_files(files).select("chunk_id", "document_id", "parent_id", "chunk_index", "element_type", "start_line", "end_line", "content_hash", "previous", "next")


def chk16_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, hashes and links of documents as chunks of their source."""
    rows = t(spark, sf_dir, "documents").select(
        F.concat(F.lit("corpus/"), F.col("source"), F.lit(".md")).alias("source_path"), F.array("lang").alias("tags"), F.col("doc_id").cast("int").alias("emit"), F.col("doc_id").cast("int").alias("chunk_index"),
        F.col("source").alias("title"), F.array("source", "lang").alias("section_path"), F.lit("prose").alias("element_type"), F.col("text").alias("text_original"), F.col("text").alias("body"),
    )
    done = chunking.finish(rows, large=True)
    return done.select(F.col("emit").alias("doc_id"), "document_id", "content_hash", "chunk_id", "parent_id", F.md5("text_for_generation").alias("rendered_md5"), F.col("previous").alias("previous_id"), F.col("next").alias("next_id"))


def ret1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.tokens(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", F.size(terms).alias("n_tokens"), F.md5(F.array_join(terms, " ")).alias("tokens_md5"))


def ret3_query_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lexical.query_features(questions(spark, sf_dir))
    return f.select(F.col("query_id").alias("item_id"), *(F.array_join(c, "|").alias(c) for c in ("terms", "important", "phrases")))


def agg1_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(lexical.index(chunks(spark, sf_dir))).groupBy("term").agg(F.sum("tf").alias("tf"), F.max("tf").alias("max_tf"))


def agg2_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequencies(lexical.postings(lexical.index(chunks(spark, sf_dir))))


def agg3_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_statistics(lexical.index(chunks(spark, sf_dir))).select("n", F.round("avg_len", 6).alias("avg_len"))


def _bm25(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return lexical.bm25_topk(lexical.query_features(questions(spark, sf_dir)), chunks(spark, sf_dir), k)


def _named(ranking: DataFrame) -> DataFrame:
    return ranking.select("query_id", F.col("chunk_ord").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def ret4_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(_bm25(spark, sf_dir))


#: Words that the invented prose lacks and the boosts look for: after a query, and in headings by language.
ASKED = ("default", "route it", "choose a strategy", "when to use the right one", "terraform modules", "fanout", "references of the matrix", "")
HEADINGS = {"en": "default settings and fanout", "de": "the routing matrix", "fr": "decision rule, selection framework", "es": "when to use a module set"}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions, each with a source, a language and words of the boosts behind it."""
    q, i = questions(spark, sf_dir), F.col("query_id")
    words = F.get(F.array(*map(F.lit, ASKED)), (i % len(ASKED)).cast("int"))
    lang = F.get(F.array(*map(F.lit, HEADINGS)), (i % len(HEADINGS)).cast("int"))
    return q.select("query_id", F.concat_ws(" ", "query", words, F.concat(F.lit("src"), (i % 20).cast("string")), lang).alias("query"))


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks under (source, the language's heading)."""
    heading = F.coalesce(*(F.when(F.col("namespace") == k, v) for k, v in HEADINGS.items()), F.lit(""))
    return chunks(spark, sf_dir).withColumn("section_path", F.array("title", F.concat_ws(" ", "namespace", heading)))


def ret6_field_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boosts of the chunks that a query's BM25 ranking has first: token, coverage, phrase, ordered and intent."""
    feats = lexical.query_features(asked(spark, sf_dir))
    first = stored(lexical.bm25_topk(feats, chunks(spark, sf_dir), 10).select("query_id", "chunk_ord"), "first")
    some = headed(spark, sf_dir).join(small(first.select("chunk_ord").distinct()), "chunk_ord", "left_semi")
    joined = first.join(feats, "query_id").join(lexical.index(some), "chunk_ord")
    return joined.select("query_id", F.col("chunk_ord").alias("doc_id"), F.round(lexical.boosts(), 6).alias("boost"))


def ret11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(asked(spark, sf_dir), headed(spark, sf_dir))
    return _named(found.withColumn("score", F.round("score", 6)))


def flt1_namespace_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 within a namespace; frequencies are those of the whole corpus."""
    kept = lexical.matching(chunks(spark, sf_dir), "en", {"title": "src3"}).select("chunk_ord")
    return _named(lexical.bm25_topk(lexical.query_features(questions(spark, sf_dir)), chunks(spark, sf_dir), 10, only=kept))


def ret13_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.norm(V.truncate(v, 16)), 6).alias("short_norm"), F.round(F.get(V.normalize(v), F.lit(0)), 6).alias("first"))


def _dense(spark: SparkSession, sf_dir: str, k: int = 10, **more) -> DataFrame:
    return dense.search(query_vectors(spark, sf_dir), vectors(spark, sf_dir), k, **more).withColumn("score", F.round("score", 6))


def _hits(ranking: DataFrame) -> DataFrame:
    return ranking.select("query_id", F.col("chunk_ord").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def ret18_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_dense(spark, sf_dir))


def ret19_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_dense(spark, sf_dir, metric="l2"))


def ret15_matryoshka_topk_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_dense(spark, sf_dir, dimension=32))


def ret15_matryoshka_topk_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_dense(spark, sf_dir, dimension=16))


def flt2_filtered_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_dense(spark, sf_dir, filters={"namespace": "3"}))


def ret21_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, short = _dense(spark, sf_dir, 100), _dense(spark, sf_dir, 100, dimension=16)
    return _hits(fusion.reciprocal_rank_fusion([full, short], 10, weights=[1.0, 0.5]).withColumn("score", F.round("score", 9)))


def ret22_hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and dense candidates fused; the vector of query i is vector i, that of document d is vector d."""
    q = t(spark, sf_dir, "embeddings").join(questions(spark, sf_dir), F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("vector"))
    den = dense.search(q, vectors(spark, sf_dir), fusion.CANDIDATES)
    return _named(fusion.reciprocal_rank_fusion([_bm25(spark, sf_dir, fusion.CANDIDATES), den], 10).withColumn("score", F.round("score", 9)))


def ret23_shared_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's BM25 ranking fused with the dense ranking of one query vector."""
    one = query_vectors(spark, sf_dir).filter("query_id = 0")
    den = dense.search(one, vectors(spark, sf_dir), 20)
    return _named(fusion.shared_dense(_bm25(spark, sf_dir, 20), den, 10).withColumn("score", F.round("score", 9)))


def ret24_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense candidates of 16 components in the order of the whole vectors' cosine."""
    pool = _dense(spark, sf_dir, 50, dimension=16)
    q = dense.prepare(query_vectors(spark, sf_dir)).withColumnRenamed("vector", "qv")
    v = dense.prepare(vectors(spark, sf_dir)).select("chunk_ord", "vector")

    def scorer(rows: DataFrame) -> DataFrame:
        return rows.join(q, "query_id").join(v, "chunk_ord").withColumn("rerank_score", F.round(V.dot(F.col("qv"), F.col("vector")), 6))

    return _hits(fusion.rerank(pool, scorer, 8))


QUERIES = {
    f.__name__: f
    for f in (
        chk1_word_count, chk2_last_words, chk3_slug, chk15_chunk_documents, chk16_chunk_ids, ret1_tokens, ret3_query_features, agg1_term_frequency,
        agg2_document_frequency, agg3_corpus_statistics, ret4_bm25_topk, ret6_field_boosts, ret11_lexical_search, flt1_namespace_search, ret13_normalize,
        ret18_dense_topk, ret19_l2_topk, ret15_matryoshka_topk_32, ret15_matryoshka_topk_16, flt2_filtered_dense_topk, ret21_weighted_rrf,
        ret22_hybrid_topk, ret23_shared_dense, ret24_rerank,
    )
}

DOCS = f"docs AS (SELECT doc_id, {tokens_sql('text')} AS terms FROM documents)"
POSTS = "posts AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM docs), tfs AS (SELECT doc_id, dl, term, count(*) AS tf FROM posts GROUP BY ALL)"
BM25 = f"""{DOCS}, {POSTS},
stats AS (SELECT count(*) AS n, greatest(coalesce(avg(len(terms)), 1.0), 1.0) AS avgdl FROM docs),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
q AS (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * (ln((1 + n) / (1 + df)) + 1.0) * (tf * 2.4) / (tf + 1.4 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
       FROM qt JOIN tfs USING (term) JOIN dfs USING (term), stats GROUP BY query_id, doc_id)"""


def _top(src: str, k: int, order: str, by: str = "score DESC") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}, {order}) AS rank FROM {src} QUALIFY rank <= {k}"


def _unit(v: str, d: int | None) -> str:
    v = f"({v})[1:{d}]" if d else v
    return f"list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"


def _dense_sql(name: str, k: int, d: int | None = None, metric: str = "dot", where: str = "true", queries: str = "vec_id % 100 = 0") -> str:
    score = "-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))" if metric == "l2" else "list_dot_product(a.v, b.v)"
    return f"""{name}_u AS (SELECT vec_id, label, {_unit('embedding::DOUBLE[]', d)} AS v FROM embeddings),
{name}_s AS (SELECT a.vec_id AS query_id, b.vec_id, round(round({score}, 9) + 0.0, 6) AS score, round({score}, 9) + 0.0 AS fine FROM {name}_u a, {name}_u b WHERE a.{queries} AND {where}),
{name} AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY fine DESC, vec_id) AS rank FROM {name}_s QUALIFY rank <= {k})"""


def _rrf(a: str, b: str, k: int, wa: float = 1.0, wb: float = 1.0, ida: str = "doc_id", idb: str = "vec_id") -> str:
    return f"""parts AS (SELECT query_id, {ida} AS id, {wa} / (60 + rank) AS s, 0 AS l, rank FROM {a} UNION ALL SELECT query_id, {idb}, {wb} / (60 + rank), 1, rank FROM {b}),
fused AS (SELECT query_id, id, round(sum(s), 12) AS score, min((l, rank)) AS place FROM parts GROUP BY ALL),
best AS (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY fused.score DESC, place) AS rank FROM fused QUALIFY rank <= {k})"""


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"

def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in values) + " ELSE '' END"


ASKED_SQL = f"SELECT item_id, concat_ws(' ', text, {_case('item_id % 8', enumerate(ASKED))}, 'src' || (item_id % 20), {_case('item_id % 4', enumerate(HEADINGS))}) AS text FROM benchmark"
BM25_ASKED = BM25.replace("FROM benchmark", f"FROM ({ASKED_SQL})")


def _boosts_sql() -> str:
    """Of one row with imp, uniq, phrases, terms (of a query) and the fields of a chunk."""

    def has(*words: str) -> str:
        return "list_has_any(qterms, [" + ", ".join(f"'{w}'" for w in words) + "])"

    fields = {"leaf": "leaf", "section": "section", "title": "title", "tags": "tags", "domain": "title", "path": "path", "compact": "compact"}
    parts = [f"{w} * len(list_filter(imp, lambda x: list_contains({fields[n]}, x)))" for n, w in lexical.TOKEN_WEIGHTS.items()]
    parts += [f"CASE WHEN len(uniq) > 0 THEN {w} * pow(len(list_filter(uniq, lambda x: list_contains({fields[n]}, x)))::DOUBLE / len(uniq), 2) ELSE 0 END" for n, w in lexical.COVERAGE_WEIGHTS.items()]
    parts += [f"{w} * coalesce(list_sum(list_transform(list_filter(phrases, lambda p: contains({n}, p)), lambda p: len(string_split(p, ' ')))), 0)" for n, w in lexical.PHRASE_WEIGHTS.items()]
    intents = (
        (f"{has('when')} AND {has('use', 'right')} AND contains(section_text, 'when to use')", 80.0), (f"{has('module')} AND {has('terraform')} AND contains(leaf_text, 'module set')", 55.0),
        (f"{has('fanout')} AND contains(leaf_text, 'fanout')", 55.0), (f"{has('choose', 'decision', 'select', 'selection', 'strategy')} AND list_contains(section, 'decision') AND list_contains(section, 'rule')", 55.0),
        (f"{has('choose', 'strategy')} AND (contains(section_text, 'selection framework') OR contains(section_text, 'decision matrix'))", 45.0),
        (f"{has('matrix', 'route', 'routing')} AND contains(section_text, 'routing matrix')", 65.0), (f"{has('default')} AND contains(leaf_text, 'default')", 35.0),
    )
    parts += [f"CASE WHEN {cond} THEN {w} ELSE 0 END" for cond, w in intents]
    # terms found one after the other: each next one behind the place of the last, as a fold over (place, number)
    fold = "list_reduce(list_prepend({'at': 0, 'n': 0, 'w': ''}, list_transform(imp, lambda w: {'at': 0, 'n': 0, 'w': w})), lambda s, t: CASE WHEN coalesce(list_position(section[s.at + 1:], t.w), 0) > 0 THEN {'at': (s.at + list_position(section[s.at + 1:], t.w))::INT, 'n': s.n + 1, 'w': ''} ELSE {'at': s.at, 'n': s.n, 'w': ''} END).n"
    parts.append(f"CASE WHEN len(imp) >= 2 AND {fold} >= 2 THEN {lexical.ORDERED_WEIGHT} * {fold} / len(uniq) ELSE 0 END")
    return " + ".join(f"({p})" for p in parts)


_HEAD = _case("lang", HEADINGS.items())
PAIRS = f"""{BM25_ASKED},
feat0 AS (SELECT item_id AS query_id, {tokens_sql('text')} AS qterms FROM ({ASKED_SQL})),
feat1 AS (SELECT *, list_filter(qterms, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)) AS imp FROM feat0),
feat AS (SELECT *, list_distinct(imp) AS uniq, list_distinct(flatten(list_transform([2, 3, 4, 5], lambda w: list_transform(range(1, greatest(len(imp) - w + 2, 1)), lambda i: array_to_string(imp[i:i + w - 1], ' '))))) AS phrases FROM feat1),
head0 AS (SELECT doc_id, text, lower(source) AS ti, lower(lang || ' ' || {_HEAD}) AS le, lower(lang) AS la, lower(source || '/' || doc_id) AS pa FROM documents),
head1 AS (SELECT *, concat_ws(' ', ti, ti || ' ' || le, la, ti, replace(pa, '_', ' ')) AS co FROM head0),
head AS (SELECT doc_id, {tokens_sql('le')} AS leaf, {tokens_sql("ti || ' ' || le")} AS section, {tokens_sql('ti')} AS title, {tokens_sql('la')} AS tags, {tokens_sql('pa')} AS path, {tokens_sql('co')} AS compact,
  array_to_string({tokens_sql("co || chr(10) || lower(text)")}, ' ') AS full_text, len({tokens_sql('text')}) AS n_terms FROM head1),
fields AS (SELECT *, array_to_string(leaf, ' ') AS leaf_text, array_to_string(section, ' ') AS section_text, array_to_string(title, ' ') AS title_text FROM head)"""

ORACLE_SQL = {
    "chk1_word_count": r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::INT AS words FROM documents",
    "chk2_last_words": r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents) SELECT doc_id, array_to_string(w[greatest(len(w) - 119, 1):], ' ') AS tail FROM w",
    "chk3_slug": f"SELECT page_id, coalesce(nullif({_SLUG.format('url')}, ''), 'chunk') AS slug FROM pages",
    "chk16_chunk_ids": f"""
WITH c AS (SELECT doc_id::INT AS doc_id, text, source, lang, 'corpus/' || source || '.md' AS path, {_SLUG.format("'corpus/' || source")} AS document_id FROM documents),
h AS (SELECT *, sha256(path || chr(10) || doc_id || chr(10) || '[Doc: ' || source || '] [Section: ' || source || ' > ' || lang || '] [Tags: ' || lang || ']' || chr(10) || text) AS content_hash FROM c),
i AS (SELECT *, document_id || ':' || format('{{:04d}}', doc_id) || ':' || content_hash[:10] AS chunk_id, document_id || ':' || {_SLUG.format("source || '>' || lang")} AS parent_id FROM h)
SELECT doc_id, document_id, content_hash, chunk_id, parent_id,
       md5('<SOURCE id="' || chunk_id || '" title="' || source || '" section="' || source || ' &gt; ' || lang || '" file="' || path || '">' || chr(10) || text || chr(10) || '</SOURCE>') AS rendered_md5,
       lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id
FROM i WINDOW w AS (PARTITION BY path ORDER BY doc_id)""",
    "ret1_tokens": f"WITH {DOCS} SELECT doc_id, len(terms)::INT AS n_tokens, md5(array_to_string(terms, ' ')) AS tokens_md5 FROM docs",
    "ret3_query_features": f"""
WITH q AS (SELECT item_id, {tokens_sql('text')} AS terms FROM benchmark),
i AS (SELECT *, list_filter(terms, lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)) AS imp FROM q),
p AS (SELECT item_id, w, s, array_to_string(imp[s:s + w - 1], ' ') AS phrase FROM i, (SELECT unnest([5, 4, 3, 2]) AS w) ws, (SELECT unnest(range(1, 100000)) AS s) ss WHERE w <= len(imp) AND s + w - 1 <= len(imp)),
d AS (SELECT item_id, phrase, min((-w, s)) AS place FROM p GROUP BY ALL)
SELECT item_id, array_to_string(terms, '|') AS terms, array_to_string(imp, '|') AS important, coalesce((SELECT string_agg(phrase, '|' ORDER BY place) FROM d WHERE d.item_id = i.item_id), '') AS phrases FROM i""",
    "agg1_term_frequency": f"WITH {DOCS}, {POSTS} SELECT term, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM tfs GROUP BY term",
    "agg2_document_frequency": f"WITH {DOCS}, {POSTS} SELECT term, count(*) AS df FROM tfs GROUP BY term",
    "agg3_corpus_statistics": f"WITH {DOCS} SELECT count(*) AS n, round(coalesce(avg(len(terms)), 1.0), 6) AS avg_len FROM docs",
    "ret6_field_boosts": f"WITH {PAIRS}, lex AS ({_top('bm', 10, 'doc_id')}) SELECT query_id, doc_id, round({_boosts_sql()}, 6) AS boost FROM lex JOIN feat USING (query_id) JOIN fields USING (doc_id)",
    "ret11_lexical_search": f"""
WITH {PAIRS}, fine AS (SELECT query_id, doc_id, sum(qtf * (ln((1 + n) / (1 + df)) + 1.0) * (tf * 2.4) / (tf + 1.4 * (1 - 0.75 + 0.75 * dl / avgdl))) AS b FROM qt JOIN tfs USING (term) JOIN dfs USING (term), stats GROUP BY ALL),
raw AS (SELECT query_id, doc_id, round((coalesce(b, 0) + {_boosts_sql()}) * CASE WHEN doc_id % 7 = 0 AND NOT list_has_any(qterms, {list(lexical.SOURCE_TERMS)}) THEN 0.7 ELSE 1.0 END, 9) AS s FROM feat CROSS JOIN fields LEFT JOIN fine USING (query_id, doc_id) WHERE n_terms > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM raw WHERE s > 0 QUALIFY rank <= 8)
SELECT query_id, doc_id, round(s, 6) AS score, rank FROM best""",
    "ret4_bm25_topk": f"WITH {BM25} {_top('bm', 10, 'doc_id')}",
    "flt1_namespace_search": f"WITH {BM25}, kept AS (SELECT bm.* FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' AND source = 'src3') {_top('kept', 10, 'doc_id')}",
    "ret13_normalize": f"""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
       round(sqrt(list_sum(list_transform({_unit('embedding::DOUBLE[]', 16)}, lambda x: x * x))), 6) AS short_norm, round(({_unit('embedding::DOUBLE[]', None)})[1], 6) AS first FROM embeddings""",
    "ret18_dense_topk": f"WITH {_dense_sql('d', 10)} SELECT * FROM d",
    "ret19_l2_topk": f"WITH {_dense_sql('d', 10, metric='l2')} SELECT * FROM d",
    "ret15_matryoshka_topk_32": f"WITH {_dense_sql('d', 10, 32)} SELECT * FROM d",
    "ret15_matryoshka_topk_16": f"WITH {_dense_sql('d', 10, 16)} SELECT * FROM d",
    "flt2_filtered_dense_topk": f"WITH {_dense_sql('d', 10, where='b.label = 3')} SELECT * FROM d",
    "ret21_weighted_rrf": f"WITH {_dense_sql('a', 100)}, {_dense_sql('b', 100, 16)}, {_rrf('a', 'b', 10, 1.0, 0.5, 'vec_id')} SELECT query_id, id AS vec_id, score, rank FROM best",
    "ret22_hybrid_topk": f"WITH {BM25}, lex AS ({_top('bm', 100, 'doc_id')}), {_dense_sql('d', 100, queries='vec_id IN (SELECT item_id FROM benchmark)')}, {_rrf('lex', 'd', 10)} SELECT query_id, id AS doc_id, score, rank FROM best",
    "ret23_shared_dense": f"""
WITH {BM25}, lex AS ({_top('bm', 20, 'doc_id')}), {_dense_sql('one', 20, queries='vec_id = 0')},
d AS (SELECT l.query_id, one.vec_id, one.rank FROM (SELECT DISTINCT query_id FROM lex) l, one), {_rrf('lex', 'd', 10)} SELECT query_id, id AS doc_id, score, rank FROM best""",
    "ret24_rerank": f"""
WITH {_dense_sql('pool', 50, 16)}, u AS (SELECT vec_id, {_unit('embedding::DOUBLE[]', None)} AS v FROM embeddings),
s AS (SELECT query_id, pool.vec_id, round(list_dot_product(a.v, b.v), 6) AS score, rank AS old FROM pool JOIN u a ON a.vec_id = query_id JOIN u b ON b.vec_id = pool.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM s QUALIFY rank <= 8""",
}

"""Operators against plain Python on small fixtures."""

import html
import math
import random
import re
import time
from datetime import datetime, timedelta
from html.entities import html5
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.functions import text as T
from corvane.operators import chunking, dense, evaluation, events, evidence, fusion, ivf, judging, lexical, research, rules
from corvane.sources import manifest, store
from corvane.streaming import requests

MARKDOWN = """# Guide

Intro line.

## Definition

Short words.

## Usage ##

Some text before the code.

```python
# not a heading
1. not a list
```

| a |
|---|
| x |
| y |

1) one
2) two

3) three

### References here

See it.

~~~
open fence
"""


def test_stem_and_tokens(spark):
    df = spark.createDataFrame([("Policies pass CLASSES docs. a_b-c/d bus ties 9.5s",)], "s string")
    got = df.select(T.tokens(F.col("s"))).first()[0]
    assert got[:4] == ["policy", "pass", "classe", "docs."] and got[4:8] == ["a", "b", "c", "d"] and got[-1] == "9.5"


def test_chunks_of_markdown():
    rows = chunking.chunks(MARKDOWN, "docs/my-guide.md")
    kinds = [r["element_type"] for r in rows]
    assert kinds.count("code_fence") == 2 and kinds.count("table") == 1 and kinds.count("list") == 1
    assert all(r["title"] == "Guide" for r in rows)
    assert ["Guide", "Usage"] in [r["section_path"] for r in rows] and not any("not a heading" in p for r in rows for p in r["section_path"])
    table = next(r for r in rows if r["element_type"] == "table")
    assert table["text_original"].count("|") >= 8
    assert any(r["element_type"] == "reference" for r in rows)
    # the tiny generic section went into the next one beside it
    assert ["Guide", "Definition"] not in [r["section_path"] for r in rows]


def test_chunk_rows_link_and_hash(spark):
    files = spark.createDataFrame([("a/x.md", MARKDOWN, "", ["t"]), ("a/domain-z.md", "# Z\nbody", "routing-card", []), ("empty.md", None, "", None)], "path string, text string, content_kind string, section_tags array<string>")
    rows = chunking.chunk_files(files).orderBy("source_path", "emit").collect()
    assert [r.element_type for r in rows if r.source_path == "a/domain-z.md"] == ["routing_card"]
    mine = [r for r in rows if r.source_path == "a/x.md"]
    assert [r.next for r in mine[:-1]] == [r.chunk_id for r in mine[1:]] and mine[0].previous is None
    assert all(r.chunk_id.startswith("a_x:") and r.text_for_generation.startswith('<SOURCE id="') for r in mine)


def test_prose_is_split_with_overlap():
    split = chunking.prose_pieces
    pieces = split("\n\n".join(" ".join(f"w{i}_{j}" for j in range(400)) for i in range(4)))
    assert [len(p.split()) for p in pieces] == [800, 920]
    assert pieces[1].split()[:120] == pieces[0].split()[-120:]
    assert len(split("w " * 3000)) == 1 and split("") == [""]
    assert [chunking.table_as_list(t) for t in ("| a | b |\n|---|---|\n| 1 | 2 | 3 |\n|4|", "| a |\n|---|")] == ["a: 1; b: 2\na: 4", "| a |\n|---|"]


def blocks_by_walk(lines):
    """Blocks by one look at each line and those after it: for tests of the runs over classes."""
    out, at = [], 0
    fence = lambda x: re.match(r"^\s{0,3}(`{3,}|~{3,})(.*)$", x)
    item = lambda x: re.match(r"^\s*\d+[\.)]\s+", x)
    while at < len(lines):
        upto = at
        if m := fence(lines[at]):
            closing = [i for i in range(at + 1, len(lines)) if set(lines[i].strip()) == {m[1][0]} and len(lines[i].strip()) >= len(m[1])]
            upto = (closing or [at])[0]
            out.append(("code_fence", at, upto))
        elif "|" in lines[at] and "|" in "".join(lines[at + 1 : at + 2]) and all(re.match("^:?-+:?$", c) for c in chunking.cells(lines[at + 1])):
            while "|" in "".join(lines[upto + 1 : upto + 2]):
                upto += 1
            out.append(("table", at, upto))
        elif item(lines[at]):
            run = at
            while run < len(lines) and (item(lines[run]) or not lines[run].strip()):
                run += 1
            if sum(bool(item(x)) for x in lines[at:run]) > 2:
                upto = run - 1
                out.append(("list", at, upto))
        at = upto + 1
    return out


def test_blocks_are_runs_of_line_classes():
    rng = random.Random(12)
    kinds = ["```", "~~~", "```py", "| a | b |", "|---|:-:|", "a | b", "1. x", "2) y", "3. a | b", "", "  ", "text", "# H", "---"]
    for _ in range(4000):
        lines = rng.choices(kinds, k=rng.randint(0, 14))
        assert [b[:3] for b in chunking.blocks(lines)] == blocks_by_walk(lines), lines


def test_blocks_have_context():
    lines = ["first", "# H", "", "```", "x", "```", "| t |", "after"]
    assert chunking.with_context(lines, [(3, 5), (0, 0)]) == ["first\n```\nx\n```\nafter", "first\nx"]


def _tokens(text):
    import re

    def stem(t):
        return t[:-3] + "y" if len(t) > 4 and t.endswith("ies") else t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t

    return [stem(t) for t in re.findall("[a-z0-9][a-z0-9.]*", text.lower().translate(str.maketrans("_-/", "   ")))]


def test_bm25_by_hand(spark):
    docs = ["cats and dogs", "cats cats run", "the birds", ""]
    chunks = spark.createDataFrame([(i, d, "", [], [], "", "", "prose", "n") for i, d in enumerate(docs)], "chunk_ord long, text string, title string, section_path array<string>, tags array<string>, domain string, source_path string, element_type string, namespace string")
    queries = spark.createDataFrame([(1, "cats cats birds")], "query_id long, query string")
    got = {r.chunk_ord: r.bm25 for r in lexical.bm25(lexical.query_features(queries), lexical.index(chunks)).collect()}
    terms = [_tokens(d) for d in docs]
    avg = sum(map(len, terms)) / 4
    want = {}
    for i, ts in enumerate(terms):
        for q in _tokens("cats cats birds"):
            tf, df = ts.count(q), sum(q in x for x in terms)
            if tf:
                want[i] = want.get(i, 0) + (math.log(5 / (1 + df)) + 1) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len(ts) / avg))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    full = lexical.search(queries, chunks.withColumn("section_path", F.array(F.lit("Cats"))), namespace="n").collect()
    assert {r.chunk_ord for r in full} >= {0, 1, 2} and full[0].rank == 1
    assert lexical.search(queries, chunks, namespace="other").count() == 0


def test_ordered_matches(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"], ["x", "a", "c", "b", "a"])], "q array<string>, f array<string>")
    assert df.select(lexical.ordered_matches(F.col("q"), F.col("f"))).first()[0] == 3


def test_dense_and_fusion(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [1.0, 1.0])], "chunk_ord long, vector array<float>")
    q = spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, vector array<float>")
    assert [r.chunk_ord for r in dense.search(q, v, 3).orderBy("rank").collect()] == [0, 2, 1]
    assert [r.score for r in dense.search(q, v, 3, "l2").orderBy("rank").collect()][0] == 0.0
    a = spark.createDataFrame([(7, 0, 1), (7, 1, 2)], "query_id long, chunk_ord long, rank int")
    b = spark.createDataFrame([(7, 1, 1), (7, 2, 2)], "query_id long, chunk_ord long, rank int")
    got = fusion.reciprocal_rank_fusion([a, b], 3).orderBy("rank").collect()
    assert [r.chunk_ord for r in got] == [1, 0, 2]


def test_rules(spark):
    rows = [("a", "A clinical patient chart under HIPAA with an external API", None), ("b", "developer api", {"A8": "relaxed", "A4": " ", "X": "y"}), ("c", "nothing", {"A1": "costly"})]
    r = {x.brief_id: x for x in rules.resolve(spark.createDataFrame(rows, "brief_id string, brief string, answers map<string,string>")).collect()}
    assert r["a"].domain == "medical-clinical" and r["a"].conflict == "A4,A5" and "A4" not in r["a"].pending
    assert r["b"].A8.value == "relaxed" and r["b"].A8.confidence == 1.0 and "A8" not in r["b"].pending and "A4" in r["b"].pending
    assert r["c"].domain is None and len(r["c"].pending) == 12 and r["c"].A1 is None
    cases = [("costly", "high", "multi-hop", "adaptive_agentic"), ("costly", "high", "synthetic", "two_stage_hybrid_rerank"), ("minor", "high", "synthetic", "single_stage_hybrid"), ("minor", "moderate", "synthetic", "two_stage_dense_rerank")]
    v = spark.createDataFrame([(str(i), a1, a2, a3, None, None, None) for i, (a1, a2, a3, _) in enumerate(cases)], "brief_id string, a1 string, a2 string, a3 string, a8 string, a11 string, a12 string")
    assert {x.brief_id: x.topology for x in rules.select_topology(v).collect()} == {str(i): c[3] for i, c in enumerate(cases)}


def _events(spark, rows):
    return spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(seconds=s), u) for i, (s, u) in enumerate(rows)], "event_id long, ts timestamp, user_id long")


def test_rate_limit_is_a_recurrence(spark):
    e = _events(spark, [(s, 1) for s in (0, 1, 2, 9, 10, 11, 12)])
    got = [r.accepted for r in events.rate_limit(e, 2, 10, "user_id").orderBy("event_id").collect()]
    kept, want = [], []
    for s in (0, 1, 2, 9, 10, 11, 12):
        kept = [k for k in kept if k >= s - 10]
        want.append(len(kept) < 2)
        kept += [s] if want[-1] else []
    assert got == want


def test_blocked_spikes_equal_one_window(spark):
    random.seed(3)
    rows = [(random.randrange(3000), 1) for _ in range(400)]
    got = {r.event_id: r.window_count for r in events.spikes(_events(spark, rows), 60, 3).collect()}
    assert got == {i: sum(s - 60 <= t <= s for t, _ in rows) for i, (s, _) in enumerate(rows)}


def _odd_events(spark, tmp_path):
    """Events at borders of windows and blocks, at equal times, before 1970 and without a time."""
    rng, us, first = random.Random(4), timedelta(microseconds=1), datetime(2024, 1, 1, 5)
    times = [first + timedelta(hours=h) + d for h in range(4) for d in (-us, 0 * us, 0 * us, us)] + [None] * 3
    times += [datetime(1969, 12, 31, 22) + rng.randrange(4 * 3600 * 10**6) * us for _ in range(300)] + [first + timedelta(seconds=rng.randrange(900) * 56.25) for _ in range(300)]
    rows = [(i, x, rng.choice(["error", "view"]), rng.choice([None, 1.0, 40.0])) for i, x in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")


def _equals_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
    assert len(got) == 619 and sorted(got) == sorted(want)


def test_alerts_of_odd_times_equal_sql(spark, tmp_path):
    _odd_events(spark, tmp_path)
    _equals_sql(spark, tmp_path, "ops5_alerts")


def test_spikes_of_odd_times_equal_sql(spark, tmp_path):
    _odd_events(spark, tmp_path)
    _equals_sql(spark, tmp_path, "ops4_spikes")


def test_spikes_take_no_longer_where_events_are_dense(spark):
    def took(step):
        e = spark.range(60_000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * step).alias("ts"))
        began = time.monotonic()
        counts = [r[0] for r in events.spikes(e, 3600, 5).orderBy("event_id").select("window_count").collect()]
        return counts, time.monotonic() - began

    took(3600 * 10**6)  # compiles
    thin, usual = took(3600 * 10**6)
    dense, seconds = took(50_000)
    assert thin == [1] + [2] * 59_999 and dense == list(range(1, 60_001))
    assert seconds < 4 * usual + 5


def test_deep_budget(spark):
    e = _events(spark, [(i * 3600 * 5, 1) for i in range(40)]).withColumn("deep", F.col("event_id") % 2 == 0)
    got = [r.accepted for r in events.deep_budget(e, {"daily": 3, "monthly": 20, "daily_deep": 1}).orderBy("event_id").collect()]
    want, used, month, day = [], [0, 0], 0, None
    for i in range(40):
        d = (datetime(2024, 1, 1) + timedelta(hours=5 * i)).date()
        if d != day:
            day, used = d, [0, 0]
        ok = used[0] < 3 and month < 20 and (i % 2 or used[1] < 1)
        want.append(bool(ok))
        if ok:
            used[0] += 1
            month += 1
            used[1] += i % 2 == 0
    assert got == want


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 9, 3)], "k string, v double")
    assert df.groupBy("k").agg(evaluation.percentile_nearest("v", 0.5).alias("p")).first().p == 3.0
    assert df.groupBy("k").agg(evaluation.percentile_rounded("v", 0.5).alias("p")).first().p == 5.0
    assert evaluation.percentile_rounded_table(df, ["k"], "v", (0.5,)).first().p50 == 5.0
    assert df.groupBy("k").agg(evaluation.percentile_linear("v", 0.5).alias("p")).first().p == 4.0


def test_evidence(spark):
    pages = ["<p>A <b>b</b></p><script>x</script><br>c &amp; d", "a &#65;&#x42; &amp;lt; &eacute;", "<!-- <script> -->z<svg><p>q</svg>", "end &am", None, "x<ar"]
    got = spark.createDataFrame([(p,) for p in pages], "p string").select(evidence.html_to_text(F.col("p"))).collect()
    assert [r[0] for r in got] == ["A\nb\nc & d", "a AB &lt; é", "z", "", "", "x"]
    long = "Some words here. " * 20
    texts = [("# H\n```\ncode\n```\n**Bold** text [a](b).", ""), ("| a | b |\n|---|---|\n| 1 | 2 |", "X > Costs"), ("|---|---|", ""), (long, ""), ("abc" * 100, ""), (None, None), ("1. one\n~~~\nopen", "")]
    got = [r[0] for r in spark.createDataFrame(texts, "t string, s string").select(evidence.display_snippet(F.col("t"), F.col("s"), F.lit("prose"))).collect()]
    assert got[0] == "Bold text a." and "summarizes costs" in got[1] and got[2] == evidence.TABLE_ALONE
    assert got[3] == ("Some words here. " * 12).strip() and got[4] == "abc" * 72 + "a..." and got[5:] == ["", "one"]
    df = spark.createDataFrame([("Top > 1. First part > 2 - Next > # Tail #",), (" > ",), (None,)], "s string")
    assert [r[0] for r in df.select(evidence.clean_section(F.col("s"))).collect()] == ["First part > Next > Tail", "Unsectioned literature", "Unsectioned literature"]
    t = spark.createDataFrame([("vector dense hybrid audit audit",)], "s string")
    assert t.select(evidence.themes(F.col("s"))).first()[0] == ["governance", "dense vector search", "hybrid retrieval"]


class PlainText(HTMLParser):
    """The pieces of text of a page, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.pieces = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "svg", "noscript")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "svg", "noscript")))

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)


def text_by_parser(page):
    parser = PlainText()
    parser.feed(page)
    lines = [" ".join(line.split()) for line in "\n".join(parser.pieces).splitlines()]
    return "\n".join(line for line in lines if line)


def test_page_text_equals_the_parser_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html IS NOT NULL")
    rows = pages.select("html", evidence.html_to_text(F.col("html")).alias("text")).collect()
    assert len(rows) > 200 and all(r.text == text_by_parser(r.html) for r in rows)


def test_all_character_references(spark):
    names = [f"a&{k}b" for k in html5] + [f"&{k};" for k in html5 if not k.endswith(";")] + [f"&{k.rstrip(';')}x &{k.rstrip(';').upper()};" for k in html5]
    numbers = [f"&#{n};&#{n}z" for n in [*range(300), 55295, 55296, 57343, 57344, 64976, 65007, 65008, 65533, 65534, 131071, 1114111, 1114112, 10**9, 10**30]] + [f"&#x{n:x};&#X{n:X} " for n in [*range(300), 0xD800, 0xFFFE, 0x10FFFF, 0x110000, 16**20]]
    odd = ["", "&", "&&amp;&", "&amp;lt;", "&#;", "&#x;", "&#00065;", "&notit; &notin; &NotEqualTilde;", "&" + "a" * 40 + ";", "Informaci&oacute;n &iquest;qu&eacute;? &aacute;rbol", "& amp; &#38;amp;", "x&lt;y&gt"]
    texts = names + numbers + odd
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", evidence.unescaped(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in got} == {t: html.unescape(t) for t in texts}


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"documents": [{"path": "a.md", "license": "x", "trust_tier": "p", "namespace": "k"}, {"path": "a.md", "license": ""}]}')
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.md").write_text("# A\ntext")
    docs = manifest.load(spark, str(tmp_path / "m.json"))
    errors = {(r.position, r.error) for r in manifest.validate(docs).collect()}
    assert errors == {(2, "missing license"), (2, "missing trust_tier"), (2, "missing namespace"), (2, "duplicate path a.md")}
    scanned = manifest.scan(spark, manifest.by_path(docs), f"file://{tmp_path}/c").collect()
    assert [r.text for r in scanned] == ["# A\ntext"]
    assert store.table_name("t", 8) == "t_dim_8" and store.table_name("t_dim_8", 8) == "t_dim_8" and store.table_name("t{dimension}", 8) == "t8"
    assert store.build_order(64, [16, 64, 32]) == [64, 16, 32]
    files = spark.createDataFrame([("a.tf", "x = 1\n"), ("b.tf", "y = 2\n")], "path string, content string")
    assert {(r.path, r.content) for r in store.sections(store.bundle(files)).collect()} == {("a.tf", "x = 1\n"), ("b.tf", "y = 2\n")}
    chunks = spark.createDataFrame([("c1", "t"), ("c2", "u")], "chunk_id string, text string")
    vectors = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, vector array<float>")
    out = store.write_vectors(spark, chunks, vectors, str(tmp_path / "vec"), "m", 2, [1])
    assert [(r.dimension, r.rows) for r in out.collect()] == [(2, 2), (1, 2)]


def test_stream_logs_once(spark, tmp_path):
    rows = [(s, u) for s in range(0, 300, 7) for u in (1, 2)]
    e = _events(spark, rows).withColumn("event_type", F.lit("view")).withColumn("value", F.lit(1.0)).withColumn("props", F.lit("{}"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    log = requests.write_log(requests.alerts(requests.read(spark, str(tmp_path / "in")), 0.5), str(tmp_path / "log"), str(tmp_path / "ck2"))
    log.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == len(rows)


def test_answers(spark):
    from corvane.operators import answers

    df = spark.createDataFrame([('{"A1": "x", "A2": " "}',), ("A1 = a=b\nnone\nA1=c\n=d\nA3= ",), (None,)], "s string")
    assert [r[0] for r in df.select(answers.parse_answers(F.col("s"))).collect()] == [{"A1": "x"}, {"A1": "c"}, {}]
    m = spark.createDataFrame([([[0, 1], [0], [1, 2], []],)], "m array<array<int>>")
    assert m.select(answers.claimed_gains(F.col("m"), F.array(F.lit(2), F.lit(2), F.lit(1)))).first()[0] == [2, 0, 2, 0]
    good = "Agentic reasoning trace [E1]: decision rationale, tradeoff, validation"
    a = spark.createDataFrame([(good,), (good + " x.md",), (good + " A12: y",), ("plain",)], "s string")
    assert [r[0] for r in a.select(answers.answer_issue(F.col("s"))).collect()] == [None, "generated answer exposed internal marker '.md'", "generated answer exposed raw attribute codes", "generated answer omitted evidence labels"]
    b = spark.createDataFrame([(1, "exact terms")], "brief_id long, brief string")
    assert answers.specialists(b).count() == 4


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_structured_documents_have_all_blocks(spark):
    from corvane.plans import retrieval

    rows = retrieval.chk15_chunk_documents(spark, "/root/testdata/sf0.001").groupBy("element_type").count().collect()
    counts = {r.element_type: r["count"] for r in rows}
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(counts[k] >= n for k in ("prose", "code_fence", "table", "list"))


def test_chunks_in_sql(spark):
    chunking.register(spark)
    long = "# Long\n\n" + "\n\n".join(" ".join(f"w{i}_{j}" for j in range(300)) for i in range(9))
    rows = [("a/x.md", MARKDOWN, "", ["t", "u"]), ("a/domain-z.md", "# Z\nbody", "routing-card", []), ("r.md", "# R\n## A\n|a|b|\n|-|-|\n|1|2|\n## B\nx", "routing-rules", None), ("long.v2.md", long, None, ["z"]), ("empty.md", None, "", None)]
    files = spark.createDataFrame(rows, "path string, text string, content_kind string, section_tags array<string>")
    files.createOrReplaceTempView("files")
    got = spark.sql("SELECT c.* FROM files, LATERAL chunk_markdown(path, text, content_kind, section_tags) c")
    names = ["chunk_index", "element_type", "text_original", "start_line", "end_line", "document_id", "chunk_id", "parent_id", "content_hash"]
    want = chunking.chunk_files(files).select(F.array_join("section_path", " > ").alias("section"), *names)
    rows_of = lambda df: sorted(str(tuple(r)) for r in df.select("section", *names).collect())
    assert rows_of(got.withColumnRenamed("text", "text_original")) == rows_of(want) and want.count() > 12


def test_manifests_in_json_and_yaml(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"documents": [{"path": "a", "ingest": false}, {"path": "b"}]}')
    (tmp_path / "l.json").write_text('[{"path": "a"}]')
    (tmp_path / "m.yaml").write_text("version: 1\ndocuments:\n- path: a\n  section_tags: [x, y]\n  date: 2024-01-02\n- path: b\n")
    read = lambda n: [(r.position, r.path) for r in manifest.load(spark, f"file://{tmp_path}/{n}").collect()]
    assert read("m.json") == read("m.yaml") == [(1, "a"), (2, "b")] and read("l.json") == [(1, "a")] and read("none.yaml") == []
    assert manifest.load(spark, f"file://{tmp_path}/m.yaml").first().section_tags == ["x", "y"]


def test_gold_files_and_evidence_metrics(spark, tmp_path):
    import json

    gold = {"version": "1", "thresholds": {"recall": 0.9}, "retrieval": [
        {"id": "q1", "query": "x", "top_k": 3, "required": [{"path": "a"}, {"text_contains": ["Two"]}], "helpful": [{"section_contains": ["s"]}]},
        {"id": "q2", "query": "y", "top_k": 3, "required": [], "helpful": []}, {"id": "q3", "query": "z", "top_k": 1, "required": [{"path": "c"}]},
    ]}
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    g = judging.load_gold(spark, f"file://{tmp_path}/gold.json")
    items = judging.items(g, "retrieval")
    assert judging.items(g, "answer").count() == 0 and g.first().thresholds == {"recall": 0.9}
    results = spark.createDataFrame([("q1", 1, "z", "S", "one"), ("q1", 2, "a", "S", "two"), ("q1", 3, "a", "t", "two"), ("q1", 4, "a", "s", "two"), ("q3", 2, "c", "", "")], "id string, rank int, path string, section string, text string")
    got = {r.id: r for r in judging.evidence_metrics(results, items).collect()}
    assert got["q1"].gains == [1, 2, 2] and got["q1"].recall == 1.0 and got["q1"].mrr == 0.5
    ideal = 2 + 2 / math.log2(3) + 1 / 2
    assert abs(got["q1"].ndcg - (1 + 2 / math.log2(3) + 2 / 2) / ideal) < 1e-12
    assert (got["q2"].recall, got["q2"].mrr, got["q2"].ndcg) == (1.0, 0.0, 1.0) and (got["q3"].recall, got["q3"].mrr, got["q3"].ndcg) == (0.0, 0.0, 0.0)


def test_residual_filters():
    assert dense.candidate_limit(8, {"namespace": "x"}, {"namespace"}) == 8
    assert [dense.candidate_limit(k, {"a": "x"}, set()) for k in (8, 50, 2000)] == [200, 1000, 2000]
    assert dense.where_clause({"b": "it's", "a": 1}) == "a = '1' AND b = 'it''s'"


def test_search_scores_every_chunk_that_can_score(spark):
    """Against a loop over all pairs: phrases within tokens, headings without a shared word, empty texts."""
    rng = random.Random(3)
    words = "cat dog route fan default tree cats treehouse xcat dogma settings".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 12]))), rng.choice(["T one", "Routing Matrix", "Fanouts"]), [rng.choice(["Default x", "Module set", "plain"])], [], None, "p/x", "prose", "n") for i in range(60)]
    rows.append((60, "the xcat dogma", "zz", ["zz"], [], None, "q", "prose", "n"))
    chunks = spark.createDataFrame(rows, "chunk_ord int, text string, title string, section_path array<string>, tags array<string>, domain string, source_path string, element_type string, namespace string")
    queries = spark.createDataFrame([(1, "cat dog"), (2, "route it"), (3, "default fanout"), (4, "terraform modules"), (5, "the")], "query_id int, query string")
    feats = lexical.query_features(queries)
    every = feats.crossJoin(lexical.index(chunks)).filter("doc_len > 0").join(lexical.bm25(feats, lexical.index(chunks)), ["query_id", "chunk_ord"], "left")
    want = every.select("query_id", "chunk_ord", F.round(F.coalesce("bm25", F.lit(0.0)) + lexical.boosts(), 9).alias("score")).filter("score > 0")
    got = lexical.search(queries, chunks, 1000).select("query_id", "chunk_ord", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.filter("query_id = 1 AND chunk_ord = 60").count() == 1


def test_dimensions_share_one_pass(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)] + [(40, [0.0] * 6), (41, None)]
    vectors = spark.createDataFrame(rows, "chunk_ord bigint, vector array<float>")
    queries = vectors.filter("chunk_ord % 10 = 0").withColumnRenamed("chunk_ord", "query_id")
    got = dense.search_dimensions(queries, vectors, [4, 2, 6], 5)
    for d in (2, 4, 6):
        want = dense.search(queries, vectors.filter("vector is not null"), 5, dimension=d)
        one = got.filter(F.col("dimension") == d)
        key = lambda df: sorted((r.query_id, r.rank, r.chunk_ord, round(r.score, 6)) for r in df.collect())
        assert key(one) == key(want)


def test_queries_are_compared_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [math.sin(i), math.cos(i), 1.0]) for i in range(30)], "chunk_ord bigint, vector array<double>")
    queries = vectors.withColumnRenamed("chunk_ord", "query_id")
    want = sorted(map(tuple, dense.search(queries, vectors, 3).collect()))
    monkeypatch.setattr(dense, "BROADCAST_BYTES", 200)
    assert sorted(map(tuple, dense.search(queries, vectors, 3).collect())) == want and len(want) == 90


def test_routing_axis(spark):
    briefs = spark.createDataFrame([(1, "hipaa patient data in a hospital"), (2, "plain words"), (3, "bank fraud with pci")], "brief_id int, brief string")
    resolved = rules.resolve(briefs).withColumnRenamed("brief_id", "id")
    pending = {r.id: r.pending for r in resolved.collect()}
    kind = "id int, expected_domain string, expected_attributes map<string,string>, expected_pending array<string>"
    gold = [(1, "medical-clinical", {"A2": "high", "A12": "none"}, pending[1][::-1] + pending[1][:1]), (2, None, None, None), (3, "technical-software", {}, ["A1"]), (4, None, {"A2": "high"}, [])]
    got = {r.id: r for r in judging.routing_scores(resolved, spark.createDataFrame(gold, kind)).collect()}
    assert (got[1].domain_correct, got[1].attribute_total, got[1].attribute_correct, got[1].pending_correct, got[1].wrong_attributes, got[1].failed) == (True, 2, 1, 1, {"A12": "gated"}, True)
    assert not got[2].failed and (got[3].domain_correct, got[3].pending_correct) == (False, 0)
    assert got[4].attribute_correct == 0 and got[4].pending_correct == 0
    metrics = {r.metric: r.value for r in judging.routing_metrics(judging.routing_scores(resolved, spark.createDataFrame(gold, kind))).collect()}
    assert metrics == {"routing_domain_accuracy": 0.75, "routing_attribute_accuracy": 1 / 3, "routing_pending_accuracy": 1 / 3}


def test_agents_fail_by_themselves(spark):
    briefs = spark.createDataFrame([(1, "a brief"), (2, "another")], "brief_id int, brief string")

    def good(queries, k):
        return queries.select("query_id", F.lit(7).cast("long").alias("chunk_ord"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    def bad(queries, k):
        raise OSError("no connection")

    errors = {}
    rows = research.fan_out(briefs, {"retrieval": good, "security": bad, "evaluation": good}, 3, errors).collect()
    assert sorted(errors) == ["cloud_iac", "security"] and "no connection" in errors["security"]
    assert {(r.agent, r.status, r.chunk_ord) for r in rows} == {("retrieval", "ok", 7), ("security", "error", None), ("cloud_iac", "error", None), ("evaluation", "ok", 7)} and len(rows) == 8
    assert {r.status for r in research.fan_out(briefs, bad).collect()} == {"error"}


def test_dense_backends(spark):
    vectors = spark.createDataFrame([(i, [math.sin(i), math.cos(i), 1.0], "k") for i in range(30)], "chunk_ord bigint, vector array<double>, namespace string")
    queries = vectors.filter("chunk_ord < 4").select(F.col("chunk_ord").alias("query_id"), "vector")
    index = ivf.build(vectors, cells=3)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_ord) for r in df.collect())
    want = rows(fusion.dense_by("memory", queries, vectors, 3))
    assert rows(fusion.dense_by("index", queries, vectors, 3, index, probes=3, oversample=None)) == want == rows(fusion.dense_by("auto", queries, vectors, 3))
    for backend in ("index", "remote"):
        with pytest.raises(ValueError):
            fusion.dense_by(backend, queries, vectors, 3)


def test_merged_sketches_are_within_their_bound(spark):
    rng = random.Random(9)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86_400)), rng.choice(["view", "error"]), rng.expovariate(0.1) if i % 9 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string, value double")
    shot = events.merged_snapshot(events.window_summaries(df, 600))
    row = shot.first()
    assert (row.requests_total, row.latency_count, row.errors_total) == (6000, sum(r[3] is not None for r in rows), sum(r[2] == "error" for r in rows)) and sum(row.by_status.values()) == 6000
    assert events.rank_error(df, shot).agg(F.max("error")).first()[0] <= 0.0266
    assert events.merged_snapshot(events.window_summaries(df.limit(0), 600)).first().requests_total == 0

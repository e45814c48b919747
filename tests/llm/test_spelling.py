"""Spelling variants against brute force, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from corvane.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int, root string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(others)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n.get(form[w])))
    return rows


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def misspelt(rng, stems, n):
    out = []
    for _ in range(n):
        w = rng.choice(stems[: rng.randint(1, len(stems))])
        while rng.random() < 0.35:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéßÉ") + w[k:], w[:k] + rng.choice("abcéßÉ") + w[k + 1 :]]) or "a"
        out.append(rng.choice([w, w, w.capitalize()]))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    stems = ["letter", "lletter", "bookkeeper", "aaaaaa", "größen", "élèvesé", "Éléves", "window", "windows", "banana", "bananas"]
    return [(i, " ".join(misspelt(rng, stems, 60))) for i in range(250)]


def test_equals_brute_force(spark, corpus):
    want = brute(corpus)
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[1] is None for r in want)
    assert rows_of(spelling.variants(table(spark, corpus))) == want


def test_slices_of_the_filter_give_the_same(spark, corpus, monkeypatch):
    for name, value in (("SEGMENT_BITS", 6), ("MAX_SEGMENTS", 3), ("CELLS", 50)):
        monkeypatch.setattr(spelling, name, value)
    assert rows_of(spelling.variants(table(spark, corpus))) == brute(corpus)


def test_neighbours_are_all_distinct_ones():
    alphabet = np.array([ord(c) for c in "abcé"], np.uint32)
    for word in ("aabbca", "éééééé", "abcabcé"):
        got = []
        for h, of, at, letter, _, kind in spelling.neighbours([word, "bbbbbb"], alphabet):
            for k in range(len(h)):
                w = spelling.edited([word, "bbbbbb"][of[k]], at[k], chr(letter[k]), kind)
                assert spelling.Words([w]).total[0] == h[k]
                if of[k] == 0:
                    got.append(w)
        want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in "abcé"} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abcé"}
        assert sorted(got) == sorted(want - {word})


def test_chains_end_at_their_root(spark):
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    rows = [(None, " ".join(w for k, w in enumerate(chain) for _ in range(5 * 5**k)))]
    got = {r.word: r.root for r in spelling.variants(table(spark, rows)).collect()}
    assert rows_of(spelling.variants(table(spark, rows))) == brute(rows)
    assert set(got.values()) == {"abjihg"}


def test_odd_rows(spark):
    long = "q" * 3000
    rows = [(1, None), (2, ""), (3, "?! 123 中文 \U0001f600"), (None, "number number number"), (4, "number number numbxer"), (4, "number number numbxer")]
    rows += [(k, f"{long} {long}b numbxer ßßßßßß ×÷×÷×÷") for k in range(5, 11)]
    assert rows_of(spelling.variants(table(spark, rows))) == brute(rows)
    assert rows_of(spelling.variants(table(spark, []))) == set()
    assert rows_of(spelling.variants(table(spark, rows[:3]))) == set()


def test_sql_gives_the_same_rows(spark, corpus):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", corpus[:120] + [(None, "abcdef " * 7), (3, None)])
    got = con.execute(f"select word, form, root, n, n_near, form_n from ({spelling.ORACLE_SQL})").fetchall()
    assert {tuple(r) for r in got} == brute(corpus[:120] + [(None, "abcdef " * 7)]) and len(got) == len(set(got))

"""Personal data: the patterns against plain regular expressions, the random field against enumeration and on held-out rows."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from corvane.llm import pii

SCHEMA = "doc_id bigint, text string, spans string, n_email int, kind int"
WORDS = "the cat sat on a mat and dog ran over hill with sun moon star river tree at dot home point".split()
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def plain(text):
    """The base spans by the patterns as they are written."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1], 1)]
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
            fits = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 8 <= len(digits) <= 15)
            if fits[k]:
                out.append((k, *m.span()))
    return out


def card(rng):
    body = "4" + "".join(rng.choices("0123456789", k=14))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def personal(rng, kind):
    n = rng.randint
    return [
        lambda: f"{rng.choice(WORDS)}.{n(10, 99)}@mail{n(1, 9)}.example.{rng.choice(['com', 'org'])}",
        lambda: ".".join(str(n(1, 255)) for _ in range(4)),
        lambda: card(rng),
        lambda: f"+1 ({n(200, 999)}) 555-{n(0, 9999):04}",
    ][kind]()


def documents(seed, n, of=lambda rng, kind: personal(rng, kind)):
    """(text, its spans), a third of them with decoys in place of personal data."""
    rng, out = random.Random(seed), []
    for k in range(n):
        kind = k % 4
        item = pii.decoy(rng) if k % 3 == 2 else of(rng, kind)
        words = rng.choices(WORDS, k=14)
        before = " ".join(words[:7]) + " "
        out.append((before + item + " " + " ".join(words[7:]), [] if k % 3 == 2 else [(kind, len(before), len(before) + len(item))]))
    return out


@pytest.fixture(scope="module")
def model():
    rows = []
    for text, gold in documents(1, 700):
        low, (kind, s, e) = 0, gold[0] if gold else (pii.OTHER, *next(iter(pii.regions(text)), (10, 20)))
        rows.append((kind, text, s - low, e - low))
    return pii.learn(pii.training_set(rows))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "1", "12", "255", "300", "0001", " ", "-", "+", "+4", "(", ")", "é", "4", "\n", "2.3.4", "4532015112830366"]
    seen = set()
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert pii.base(text) == plain(text), text
        seen |= {k for k, *_ in pii.base(text)}
    for text in [" ".join(personal(rng, k) for k in rng.choices(range(4), k=6)) for _ in range(200)]:
        assert pii.base(text) == plain(text)
    assert seen == {0, 1, 2, 3}


def test_base_spans_of_very_long_texts_are_found_in_linear_time():
    for text in ("1" * 300_000, "a." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "1 " * 150_000, "1." * 150_000, "@a" * 100_000, "a@b.c" * 50_000):
        pii.base(text)


def test_chart_sums_over_all_segmentations():
    rng = np.random.default_rng(0)

    class Small:
        n = 5
        at = [(i, i + 1) for i in range(5)]
        spans = [(0, 2, 0, None), (1, 3, 1, None), (2, 3, 2, None), (2, 5, 0, None), (3, 5, 3, None), (4, 5, 1, None)]

    scores, follows = rng.normal(size=6).tolist(), rng.normal(size=(5, 5))
    follows[:, pii.OTHER] = 0
    ways = []
    for pick in itertools.product([0, 1], repeat=6):
        spans = [k for k in range(6) if pick[k]]
        if all(Small.spans[a][1] <= Small.spans[b][0] or Small.spans[b][1] <= Small.spans[a][0] for a, b in itertools.combinations(spans, 2)):
            total, at, before = 0.0, 0, pii.OTHER
            by_start = {Small.spans[k][0]: k for k in spans}
            while at < 5:
                if at in by_start:
                    k = by_start[at]
                    total += follows[before, Small.spans[k][2]] + scores[k]
                    at, before = Small.spans[k][1], Small.spans[k][2]
                else:
                    total, at, before = total + follows[before, pii.OTHER], at + 1, pii.OTHER
            ways.append((total, spans))
    chart = pii.Chart(Small, scores, follows)
    whole = math.log(sum(math.exp(t) for t, _ in ways))
    assert chart.total == pytest.approx(whole)
    for k in range(6):
        assert chart.probability(k) == pytest.approx(sum(math.exp(t - whole) for t, s in ways if k in s))
    assert chart.best() == max(ways)[1]


def measured(model, docs, blocked):
    hits = wrong = wanted = 0
    for text, gold in docs:
        base = pii.base(text)
        got = set(model.spans(text, [b[1:] for b in base] if blocked else ()))
        got |= set(base) if blocked else set()
        hits, wanted, wrong = hits + len(got & set(gold)), wanted + len(gold), wrong + len(got - set(gold))
    return hits / max(wanted, 1), wrong / len(docs)


def test_held_out_spans_are_found_without_the_patterns(model):
    found, wrong = measured(model, documents(5, 600), False)
    assert found >= 0.95 and wrong <= 0.02


def test_other_ways_to_write_them_are_found_and_decoys_left_alone(model):
    found, wrong = measured(model, documents(6, 600, lambda rng, kind: pii.rewritten(kind, personal(rng, kind), rng)), True)
    assert found >= 0.9 and wrong <= 0.02


def test_clean_texts_get_no_spans(model):
    rng = random.Random(8)
    clean = [" ".join(rng.choices(WORDS + ["3", "12", "1999", "2.5", "home.The", "at"], k=400)) for _ in range(50)]
    assert sum(len(model.spans(t)) for t in clean) == 0


def test_long_regions_take_bounded_memory(model):
    text = "12 345 6 " * 6000 + "(743) 555-3824" + " and 1.2.3.4" * 3000
    base = pii.base(text)
    assert len(base) == 3000
    model.spans(text, [b[1:] for b in base])


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_find_gives_all_columns(spark):
    rows = [(i, t) for i, (t, _) in enumerate(documents(9, 500))]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (900, None), (901, ""), (902, "x " * 60_000 + "a@b.cd é 1.2.3.4"), (903, "\U0001f600 call (743) 555-3824 now"), (904, "é write to cat.77 at mail3 dot example dot com today")]
    got = pii.find(table(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        base = plain(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(joined(base).split(",") if base else []) <= set(spans) and len(spans) == len(base) + r.n_added
    by_id = {r.doc_id: r for r in got}
    assert by_id[900].spans == by_id[901].spans == ""
    assert by_id[903].spans == "phone:7:21"
    assert by_id[904].spans.startswith("email:11:")


def test_nothing_to_learn_from(spark):
    assert pii.find(table(spark, [])).count() == 0
    got = pii.find(table(spark, [(1, "call (743) 555-3824 now"), (2, None)])).collect()
    assert [r.spans for r in got] == ["", ""]

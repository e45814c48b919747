"""Personal data by patterns and by a semi-Markov conditional random field over whole spans.

The patterns give the base spans, which stay. The random field looks at regions
that can hold a number or an address written in another way ("name at host dot
org", digits grouped by dots): it scores each span of a bounded number of tokens
as a whole (group lengths, separators, checksums, what stands beside it), and one
dynamic program over the region chooses boundaries and types together. It is
trained here, on a bounded sample of base spans, most of them rewritten by rule,
among numbers of other kinds.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, materialize, tidy

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Spans of each kind, and regions without any, that the model is learned from.
TRAIN_SPANS = 160
TRAIN_OTHERS = 300
#: Characters around a span that are learned from with it.
AROUND = 40
#: Tokens of a span at most, and characters of a region that is learned from.
MAX_TOKENS = 24
MAX_REGION = 160
EPOCHS = 10
RATE = 0.3
DECAY = 1e-3
#: A span is added if the model gives it at least this probability.
SURE = 0.8
#: Spans with less than this chance, whatever stands beside them, are left out of a region's sums.
TINY = 1e-7

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*$")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int]


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    """Addresses, from each @ outwards: what stands before it up to the last address, and a domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        low = at
        while low > free and _local(text[low - 1]):
            low -= 1
        domain = _DOMAIN.match(text, at + 1)
        if low < at and domain:
            yield low, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _local(c: str) -> bool:
    return c in "._%+-" or (c.isascii() and c.isalnum())


def ips(text: str) -> Iterator[Span]:
    """Groups of four numbers of each chain of numbers and dots, in turn, with parts up to 255."""
    for m in _CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(byte_sized, four)):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


BASE = (emails, ips, cards, phones)


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base spans, by kind and start."""
    return [(k, *span) for k, find in enumerate(BASE) for span in find(text)]


_LABEL = r"[A-Za-z0-9-]{1,63}"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
_AT = r"(?:\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s)"
_ADDRESS = re.compile(rf"{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_WHOLE = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_MARK = re.compile(_AT, re.I)
_POINT = re.compile(_DOT, re.I)
_NUMBER = re.compile(r"[+(]?[0-9](?:(?:[ ().\[\]{}/_:-]{1,4}|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)?[0-9])*", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_GROUP = re.compile(r"[0-9]+")
_SEPARATORS = "+().[]{}/_:-"


def regions(text: str) -> list[Span]:
    """Where a span can be: sequences of numbers with four groups or seven digits at least, and addresses with a mark; those that meet are one."""
    found = []
    for m in _NUMBER.finditer(text):
        size = m.end() - m.start()
        if size >= 7 and (size > 200 or len(digits_of(m[0])) >= 7 or len(_GROUP.findall(m[0])) >= 4):
            found.append(m.span())
    for m in _ADDRESS.finditer(text):
        local = _LOCAL_END.search(text[max(0, m.start() - 64) : m.start()])
        if local[0]:
            found.append((m.start() - len(local[0]), m.end()))
    return united(found)


def _class(c: str) -> str:
    return "end" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in "+#$€/@._-=:(\"'" else "mark"


def beside(text: str, low: int, high: int) -> list[str]:
    """What stands before and behind a span: the next characters, and whether numbers go on there."""
    before, behind = text[max(0, low - 3) : low], text[high : high + 3]
    out = [f"left={_class(before[-1:])}", f"right={_class(behind[:1])}"]
    if re.search(r"[0-9][^\w\s]?\s?$", before):
        out.append("digits before")
    if re.match(r"[^\w\s]?\s?[0-9]", behind):
        out.append("digits behind")
    return out


def number_features(text: str, low: int, high: int) -> list[str]:
    span = text[low:high]
    digits = digits_of(span)
    groups = _GROUP.findall(span)
    gaps = [re.sub(r"\s+", " ", g).lower() for g in _GROUP.split(span)[1:-1]]
    shape = "-".join(str(len(g)) for g in groups) if len(groups) < 7 else "many"
    kinds = "|".join(sorted(set(gaps)))
    out = [f"shape={shape}", f"gaps={kinds}", f"digits={len(digits)}", f"groups={min(len(groups), 7)}", f"luhn={luhn(digits)}", f"luhn={luhn(digits)} digits={len(digits)}", f"open={span[0] if span[0] in '+(' else groups[0][:2] == '00'}"]
    if len(groups) == 4:
        out.append(f"bytes={all(map(byte_sized, groups))} alike={len(set(gaps)) == 1}")
    if re.fullmatch("(19|20)[0-9][0-9]", groups[0]) or re.fullmatch("(19|20)[0-9][0-9]", groups[-1]):
        out.append("year")
    if span.count("(") != span.count(")"):
        out.append("half open")
    return out + [f"shape={shape} gaps={kinds}"] + beside(text, low, high)


def address_features(text: str, low: int, high: int) -> list[str]:
    span = text[low:high]
    mark = _MARK.search(span)
    local, domain = span[: mark.start()], span[mark.end() :]
    points = [re.sub(r"\s+", "", p).lower() if p.strip() != "dot" else " dot " for p in _POINT.findall(domain)]
    labels = _POINT.split(domain)
    sign = re.sub(r"\s+", " ", mark[0]).lower()
    out = [f"mark={sign}", f"points={'|'.join(sorted(set(points)))}", f"mark={sign} points={'|'.join(sorted(set(points)))}", f"labels={min(len(labels), 5)}"]
    out += [f"last={min(len(labels[-1]), 6)} {labels[-1].isalpha()} {labels[-1].islower()}", f"local digit={any(c.isdigit() for c in local)} dot={'.' in local}", f"capital={labels[0][:1].isupper()}"]
    if low and _local(text[low - 1]):
        out.append("cut before")
    if re.match(rf"{_DOT}{_LABEL}", text[high : high + 80], re.I) or re.match(r"[A-Za-z0-9-]", text[high : high + 1]):
        out.append("cut behind")
    return out + beside(text, low, high)


class Lattice:
    """A region's tokens and the spans in it that a kind can have, outside of the blocked ones: (first token, end token, kind, what `weigh` makes of its features), but where that is None."""

    def __init__(self, text: str, low: int, high: int, weigh, blocked: list[Span] = ()):
        at = [(low + m.start(), low + m.end()) for m in _TOKEN.finditer(text[low:high])]
        self.at, self.n, self.spans = at, len(at), []
        starts, ends = [s for s, _ in at], [e for _, e in at]
        changes = [0] * (len(at) + 1)
        for a, b in blocked:
            changes[bisect_right(ends, a)] += 1
            changes[bisect_left(starts, b)] -= 1
        taken = [x > 0 for x in accumulate(changes)]
        marks = [(low + m.start(), low + m.end()) for m in _MARK.finditer(text[low:high])]
        mark_starts = [a for a, _ in marks]
        for i, (s, _) in enumerate(at):
            count = groups = 0
            first = text[s]
            number = "0" <= first <= "9" or first in "+("
            open_to = marks[bisect_right(mark_starts, s) : bisect_right(mark_starts, s + 64)] if first.isalnum() else []
            for j in range(i, min(i + MAX_TOKENS, len(at)) if number or open_to else i):
                if taken[j]:
                    break
                b, e = at[j]
                digit = "0" <= text[b] <= "9"
                if digit:
                    count, groups = count + e - b, groups + 1
                number = number and count <= 19 and (digit or text[b] in _SEPARATORS or text[b:e].lower() == "dot")
                if not number and not open_to:
                    break
                if number and digit:
                    fits = [kind for kind, fit in ((1, groups == 4 and count <= 12), (2, count >= 13), (3, 7 <= count <= 15)) if fit]
                    self._add(i, j, fits, number_features(text, s, e) if fits else [], weigh)
                if sum(m[1] < e for m in open_to) == 1 and text[e - 1].isalnum() and _WHOLE.fullmatch(text, s, e):
                    self._add(i, j, [0], address_features(text, s, e), weigh)

    def _add(self, i: int, j: int, kinds: list[int], features: list[str], weigh) -> None:
        for kind in kinds:
            found = weigh(kind, features)
            if found is not None:
                self.spans.append((i, j + 1, kind, found))


class Model:
    """Weights of (kind, feature), and of a kind behind another one (that of nothing behind anything is 0)."""

    def __init__(self, index: dict[tuple[int, str], int], weights: np.ndarray, follows: np.ndarray):
        self.index, self.weights, self.follows = index, weights, follows
        #: What a span can gain by what stands beside it; with a score this far below 0 it has less than a chance of TINY.
        beside = follows.max(0) + np.maximum(0, (follows - follows[OTHER]).max(1))
        self.least = (math.log(TINY) - beside).tolist()

    def weigh(self, kind: int, features: list[str]) -> float | None:
        score = 0.0
        for f in features:
            k = self.index.get((kind, f))
            if k is not None:
                score += self.weights[k]
        return score if score > self.least[kind] else None

    def spans(self, text: str, blocked: list[Span] = (), sure: float = SURE) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation's spans that are likely enough, outside of the blocked ones."""
        out = []
        if not len(self.weights):
            return out
        walls = united(blocked)
        ends = [b for _, b in walls]
        for low, high in regions(text):
            near = []
            for k in range(bisect_right(ends, low), len(walls)):
                if walls[k][0] >= high:
                    break
                near.append(walls[k])
            lattice = Lattice(text, low, high, self.weigh, near)
            if not lattice.spans:
                continue
            chart = Chart(lattice, [score for *_, score in lattice.spans], self.follows)
            for k in chart.best():
                i, j, kind, _ = lattice.spans[k]
                if chart.probability(k) >= sure:
                    out.append((kind, lattice.at[i][0], lattice.at[j - 1][1]))
        return out


def united(spans: list[Span]) -> list[Span]:
    """Spans in order, those that touch as one."""
    out: list[Span] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _sum(values: list) -> np.ndarray:
    x = np.array(values)
    top = x.max(0)
    return top + np.log(np.exp(x - top).sum(0))


class Chart:
    """Sums over all segmentations of a lattice: spans as segments, and single tokens that are nothing."""

    def __init__(self, lattice: Lattice, scores: list[float], follows: np.ndarray):
        self.lattice, self.scores, self.follows = lattice, scores, follows
        n = lattice.n
        self.ending: list[list[int]] = [[] for _ in range(n + 1)]
        self.starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _, _) in enumerate(lattice.spans):
            self.ending[j].append(k)
            self.starting[i].append(k)
        none = np.full(OTHER + 1, -1e9)
        self.alpha = [none.copy() for _ in range(n + 1)]
        self.alpha[0][OTHER] = 0
        self.ahead = [None] * (n + 1)  # for each next kind, all ways up to here
        for j in range(n + 1):
            if j:
                self.alpha[j][OTHER] = self.ahead[j - 1][OTHER]
                for k in self.ending[j]:
                    i, _, kind, _ = lattice.spans[k]
                    self.alpha[j][kind] = np.logaddexp(self.alpha[j][kind], self.ahead[i][kind] + scores[k])
            self.ahead[j] = _sum(list(self.alpha[j][:, None] + follows))
        self.total = float(_sum(list(self.alpha[n])))

    def backward(self) -> None:
        n, spans = self.lattice.n, self.lattice.spans
        self.beta = [None] * (n + 1)
        self.beta[n] = np.zeros(OTHER + 1)
        for i in range(n - 1, -1, -1):
            onward = np.full(OTHER + 1, -1e9)
            onward[OTHER] = self.beta[i + 1][OTHER]
            for k in self.starting[i]:
                _, j, kind, _ = spans[k]
                onward[kind] = np.logaddexp(onward[kind], self.scores[k] + self.beta[j][kind])
            self.beta[i] = _sum(list((self.follows + onward).T))

    def ways(self, k: int) -> np.ndarray:
        """The probability of span k behind each kind."""
        if not hasattr(self, "beta"):
            self.backward()
        i, j, kind, _ = self.lattice.spans[k]
        return np.exp(np.minimum(0.0, self.alpha[i] + self.follows[:, kind] + self.scores[k] + self.beta[j][kind] - self.total))

    def probability(self, k: int) -> float:
        return float(self.ways(k).sum())

    def best(self) -> list[int]:
        """The spans of the best segmentation."""
        n, spans = self.lattice.n, self.lattice.spans
        top = [[-1e18] * (OTHER + 1) for _ in range(n + 1)]
        back: list[list] = [[None] * (OTHER + 1) for _ in range(n + 1)]
        top[0][OTHER] = 0.0
        follows = self.follows.tolist()
        for j in range(1, n + 1):
            for i, kind, score, k in [(j - 1, OTHER, 0.0, None), *((spans[k][0], spans[k][2], self.scores[k], k) for k in self.ending[j])]:
                for before in range(OTHER + 1):
                    s = top[i][before] + follows[before][kind] + score
                    if s > top[j][kind]:
                        top[j][kind], back[j][kind] = s, (i, before, k)
        j, kind, out = n, max(range(OTHER + 1), key=lambda y: top[n][y]), []
        while j:
            i, before, k = back[j][kind]
            if k is not None:
                out.append(k)
            j, kind = i, before
        return out[::-1]


def learn(samples: list[tuple[str, list[tuple[int, int, int]]]]) -> Model:
    """A model of (text, its spans): gradient steps on the likelihood of the right segmentation of each region, over all others."""
    index: dict[tuple[int, str], int] = {}
    cases = []
    for text, gold in samples:
        for low, high in regions(text):
            lattice = Lattice(text, low, high, lambda kind, features: np.array([index.setdefault((kind, f), len(index)) for f in features]))
            right = [(kind, lattice.at[i][0], lattice.at[j - 1][1]) in gold for i, j, kind, _ in lattice.spans]
            before = {lattice.spans[k][1]: lattice.spans[k][2] for k, r in enumerate(right) if r}
            if lattice.spans:
                cases.append((lattice, [before.get(i, OTHER) if r else None for (i, *_), r in zip(lattice.spans, right)]))
    weights, follows = np.zeros(len(index)), np.zeros((OTHER + 1, OTHER + 1))
    if not any(x is not None for _, right in cases for x in right):
        return Model({}, np.zeros(0), follows)
    squares, squares_follows = np.full(len(index), 1e-6), np.full(follows.shape, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for c in rng.permutation(len(cases)):
            lattice, right = cases[c]
            chart = Chart(lattice, [float(weights[x].sum()) for *_, x in lattice.spans], follows)
            step: dict[int, float] = {}
            turn = np.zeros(follows.shape)
            for k, (_, _, kind, x) in enumerate(lattice.spans):
                ways = chart.ways(k)
                turn[:, kind] -= ways
                if right[k] is not None:
                    turn[right[k], kind] += 1
                gap = (right[k] is not None) - ways.sum()
                if abs(gap) > 1e-4:
                    for f in x.tolist():
                        step[f] = step.get(f, 0.0) + gap
            if step:
                at = np.fromiter(step, int)
                g = np.fromiter(step.values(), float) - DECAY * weights[at]
                squares[at] += g * g
                weights[at] += RATE * g / np.sqrt(squares[at])
                turn[:, :OTHER] -= DECAY * follows[:, :OTHER]
                squares_follows += turn * turn
                follows += RATE * turn / np.sqrt(squares_follows)
    return Model(index, weights, follows)


def rewritten(kind: int, span: str, rng: random.Random) -> str:
    """A span of the base patterns as people also write it, mostly so that no base pattern has it."""
    digits = digits_of(span)
    if kind == 0:
        local, _, domain = span.partition("@")
        mark = rng.choice([" at ", "[at]", " [at] ", "(at)", " (at) ", " @ ", "@"])
        point = rng.choice([" dot ", "[dot]", " (dot) ", "."]) if mark not in (" at ", "@") else " dot "
        return local + mark + domain.replace(".", point)
    if kind == 1:
        return span.replace(".", rng.choice(["[.]", " . ", "(.)", " dot ", "[dot]"]))
    if kind == 2:
        gap = rng.choice([".", "  ", " - ", "/", "_"])
        return gap.join([digits[:4], digits[4:8], digits[8:12], digits[12:]])
    area, rest, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    lead = "00" + digits[:-10] + " " if len(digits) > 10 else ""
    return rng.choice([f"({area}) {rest}-{line}", f"{area}-{rest}-{line}", f"{area}.{rest}.{line}", f"{lead}{area} {rest} {line}", f"({area}){rest}-{line}", f"1-{area}-{rest}-{line}"])


def decoy(rng: random.Random) -> str:
    """A number or phrase that is no personal data."""
    n = rng.randint
    year, number = n(1950, 2030), "".join(rng.choices("0123456789", k=16))
    if luhn(number):
        number = number[:-1] + str((int(number[-1]) + 5) % 10)
    return rng.choice([
        f"{year}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28):02}.{n(1, 12):02}.{year}", f"{n(1, 12)}/{n(1, 28)}/{year}", f"{year}-{n(1, 12):02}-{n(1, 28):02} {n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}",
        f"{year}-{year + n(1, 9)}", f"{n(1, 999)}.{n(100, 999)}.{n(100, 999)}", f"{n(1, 9)} {n(100, 999)} {n(100, 999)}", f"v{n(0, 30)}.{n(0, 30)}.{n(0, 30)}", f"{n(0, 90)}.{n(1000, 999999)}, {n(0, 90)}.{n(1000, 999999)}",
        number, " ".join([number[:4], number[4:8], number[8:12], number[12:]]), number[: n(7, 15)], f"#{n(10**6, 10**9)}", f"{n(300, 999)}.{n(0, 999)}.{n(300, 999)}.{n(0, 999)}", " . ".join(str(n(300, 9999)) for _ in range(4)),
        f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", "".join(rng.choices("0123456789abcdef", k=40)), f"{n(1, 20)} {n(1, 20)} {n(1, 20)} {n(1, 20)} {n(1, 20)}", f"{n(10, 99)}-{n(1, 99)}-{n(10, 99)} {n(10, 99)}",
        f"met at noon.{rng.choice(['Then', 'and', 'x'])}", f"look at item{n(1, 9)}.{n(1, 99)}", f"sold at {n(1, 99)}.{n(10, 99)}", f"at {rng.choice(['home', 'last', 'work'])}.{rng.choice(['He', 'so', 'The'])}", f"put a dot at point dot {n(1, 9)}",
    ])


def training_set(rows: list[tuple[int, str, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their spans from (kind, snippet, start, end): each span rewritten, half of them also as they stand, and decoys in the place of a third and in snippets without one."""
    rng, out = random.Random(0), []

    def put(before: str, new: str, after: str, kind: int) -> None:
        text = before + new + after
        gold = [(kind, len(before), len(before) + len(new))] if kind < OTHER else []
        out.append((text, gold + [b for b in base(text) if not any(b[1] < e and b[2] > s for _, s, e in gold)]))

    for kind, snippet, start, end in rows:
        before, span, after = snippet[:start], snippet[start:end], snippet[end:]
        if kind == OTHER:
            put("", snippet, "", OTHER)
        else:
            put(before, rewritten(kind, span, rng), after, kind)
            if rng.random() < 0.5:
                put(before, span, after, kind)
        if kind == OTHER or rng.random() < 0.33:
            put(before, decoy(rng), after, OTHER)
    return out


def samples(docs: DataFrame) -> list[tuple[int, str, int, int]]:
    """(kind, snippet, start, end): for each kind the base spans whose snippets have the smallest hashes, and regions without one; each task keeps no more of them than are wanted in all."""
    wanted = [TRAIN_SPANS] * OTHER + [TRAIN_OTHERS]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list] = [[] for _ in wanted]
        held: list[set] = [set() for _ in wanted]

        def offer(kind: int, text: str, start: int, end: int) -> None:
            if end - start > MAX_REGION:
                return
            low = max(0, start - AROUND)
            snippet = text[low : end + AROUND]
            h = xxhash.xxh3_64_intdigest(snippet.encode("utf-8", "replace"), kind) >> 1
            heap = heaps[kind]
            if h in held[kind] or (len(heap) == wanted[kind] and -heap[0][0] <= h):
                return
            held[kind].add(h)
            heapq.heappush(heap, (-h, snippet, start - low, end - low))
            if len(heap) > wanted[kind]:
                held[kind].discard(-heapq.heappop(heap)[0])

        for b in batches:
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                found = base(text)
                for kind, start, end in found:
                    offer(kind, text, start, end)
                for start, end in regions(text):
                    if not any(s < end and e > start for _, s, e in found):
                        offer(OTHER, text, start, end)
        rows = [(kind, -h, *rest) for kind, heap in enumerate(heaps) for h, *rest in heap]
        if rows:
            kinds, hashes, texts, starts, ends = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["kind", "h", "snippet", "start", "stop"],
            )

    found = materialize(docs.mapInArrow(lambda it: tidy(least(it)), "kind int, h bigint, snippet string, start int, stop int"), "snippets")
    out = []
    for kind, n in enumerate(wanted):
        rows = found.filter(F.col("kind") == kind).dropDuplicates(["h"]).orderBy("h").limit(n).collect()
        out += [(kind, r["snippet"], r["start"], r["stop"]) for r in rows]
    discard(found)
    return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The random field of the documents' own base spans: TRAIN_SPANS of each kind and TRAIN_OTHERS other regions at most."""
    return learn(training_set(samples(docs.select(F.col(text_col).alias("text")))))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Base spans are those of the patterns: leftmost, not overlapping within a kind,
    and without retries where a match fails its test. The model adds spans that
    overlap none of them and that it gives a probability of `sure` or more; without
    base spans to learn from it adds none. Offsets are code points of the whole
    text, ends exclusive. A null text counts as empty; a null id stays null;
    repeated rows each give theirs; other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or train(docs, text_col))  # a few thousand weights
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans, added = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                found = base(text)
                more = sent.value.spans(text, [(s, e) for _, s, e in found], sure)
                for k, column in enumerate(counts):
                    column.append(sum(f[0] == k for f in found))
                digests.append(hashlib.sha256(joined(found).encode()).hexdigest())
                spans.append(joined(found + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    schema = f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda it: tidy(rows(it)), schema)

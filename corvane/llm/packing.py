"""Packing of documents into sequences by bin completion over the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.bpe import encoder
from corvane.llm.common import materialize, tidy

CAPACITY = 2048
END_ID = 0
#: Steps of the branch-and-bound, a document tried in a sequence each; when they are used up, the best packing so far stands.
STEPS = 3_000_000
#: Rounds in which wasteful sequences of the incumbent are filled anew.
MENDS = 100
#: Earlier fillings of a node that a new one is compared with for dominance.
COMPARED = 8
#: Split lengths that the lower bound tries; any of them gives a valid bound.
SPLITS = 64

#: A packing: (lengths in a sequence, descending, with repeats as (length, count)) and how many sequences are filled so.
Packing = list[tuple[tuple[tuple[int, int], ...], int]]


def lower_bound(hist: dict[int, int], cap: int) -> int:
    """Sequences that any packing needs: the total, and Martello and Toth's bound for each split length."""
    n, c = np.array(sorted(hist.items()), np.int64).reshape(-1, 2).T
    count, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(n * c)])
    splits = n[2 * n <= cap]
    k = np.concatenate([[0], splits[:: len(splits) // SPLITS + 1]])
    mid, high, low = np.searchsorted(n, cap // 2, "right"), np.searchsorted(n, cap - k, "right"), np.searchsorted(n, np.maximum(k, 1))
    many = count[high] - count[mid]
    room = many * cap - (total[high] - total[mid])
    return int(max(-(-total[-1] // cap), (count[-1] - count[high] + many + np.maximum(0, -(-(total[mid] - total[low] - room) // cap))).max()))


def best_fit(hist: dict[int, int], cap: int) -> Packing:
    """Best-fit decreasing, a whole length at a time: work grows with the distinct lengths, not with the documents."""
    open_: dict[int, dict[tuple, int]] = {}  # room left -> filling -> sequences
    for n in sorted(hist, reverse=True):
        left = hist[n]
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                fit = cap // n
                full, rest = divmod(left, fit)
                for k, m in ((fit, full), (rest, 1 if rest else 0)):
                    if m:
                        _put(open_, cap - k * n, ((n, k),), m)
                break
            filling, m = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            fit = room // n
            use = min(m, left // fit)
            if use:
                _put(open_, room - fit * n, (*filling, (n, fit)), use)
                left -= use * fit
                m -= use
            if m and left and left < fit:
                _put(open_, room - left * n, (*filling, (n, left)), 1)
                left, m = 0, m - 1
            if m:
                _put(open_, room, filling, m)
    return [(f, m) for fillings in open_.values() for f, m in fillings.items()]


def mend(hist: dict[int, int], cap: int, packing: Packing, bound: int) -> Packing:
    """A packing with its wasteful sequences filled anew: their longest documents with two others that leave no waste, the rest by best fit.

    In each round that is done to every kind of sequence with waste but the
    widest gap, which is the end of a best-fit packing; it ends at the bound or
    when a round finds nothing to fill.
    """
    best, used = packing, sum(m for _, m in packing)
    left, done = np.zeros(cap + 1, np.int64), []
    for n, c in hist.items():
        left[n] = c
    tail = packing
    for _ in range(MENDS):
        gaps = sorted(((cap - sum(n * k for n, k in f), f, m) for f, m in tail), key=lambda g: -g[0] * g[2])
        last, changed = max((g[0] for g in gaps), default=0), False
        for gap, f, m in gaps:
            if not 0 < gap < last:
                continue
            (top, k), room = f[0], cap - f[0][0] * f[0][1]
            while m and left[top] >= k and room > 1:
                left[top] -= k
                a = np.arange(1, (room + 1) // 2)  # shorter than half of the room
                ready = np.minimum(left[a], left[room - a])
                at = int(ready.argmax()) if len(a) else 0
                times = int(min(m, ready[at], 1 + left[top] // k)) if len(a) else 0
                left[top] += k
                if not times or top in (a[at], room - a[at]):
                    break
                pair = (int(room - a[at]), int(a[at]))
                times = max(1, min(times, -(-int(ready[at]) // 2)))
                left[top] -= k * times
                left[list(pair)] -= times
                done.append((tuple(sorted([(top, k), (pair[0], 1), (pair[1], 1)], reverse=True)), times))
                m, changed = m - times, True
        if not changed:
            break
        tail = best_fit({int(n): int(left[n]) for n in np.flatnonzero(left)}, cap)
        if (now := sum(m for _, m in done) + sum(m for _, m in tail)) < used:
            best, used = [*done, *tail], now
        if used <= bound:
            break
    return best


def _put(open_: dict[int, dict[tuple, int]], room: int, filling: tuple, m: int) -> None:
    at = open_.setdefault(room, {})
    at[filling] = at.get(filling, 0) + m


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be placed into bins as large as the items of a (both descending)."""
    if not b:
        return True
    if len(b) > 8:
        return False

    def place(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(b):
            return True
        return any(r >= b[i] and place(i + 1, (*rooms[:k], r - b[i], *rooms[k + 1 :])) for k, r in enumerate(rooms) if r not in rooms[:k])

    return place(0, a)


class Steps:
    """What is left of a budget."""

    def __init__(self, n: int):
        self.n = n


def fillings(left: list[int], lengths: list[int], room: int, slack: int, steps: Steps) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of a room from the documents that are left, made when asked for: those without waste, then those with up to `slack`.

    left has the count of each length, lengths those that may have some,
    descending. Larger documents are tried first.
    """
    kept: list[tuple[int, ...]] = []
    smallest = next((n for n in reversed(lengths) if left[n]), 0)

    def grow(at: int, room: int, got: tuple[int, ...], low: int, high: int) -> Iterator[tuple[int, ...]]:
        if room < smallest or not smallest:
            if low <= room <= high:
                yield got
            return
        fits = False
        for i in range(bisect_left(lengths, -room, at, key=neg), len(lengths)):
            n = lengths[i]
            if left[n] > got.count(n):
                if steps.n <= 0:
                    return
                steps.n -= 1
                fits = True
                yield from grow(i, room - n, (*got, n), low, high)
        # no shorter one fits: complete if none of those passed over does, else an earlier branch has it
        if not fits and low <= room <= high and not any(left[n] > got.count(n) for n in lengths[bisect_left(lengths, -room, key=neg) : at]):
            yield got

    for low, high in ((0, 0), (1, slack)) if slack else ((0, 0),):
        for f in grow(0, room, (), low, high):
            if not any(_dominates(k, f) for k in kept):
                if len(kept) < COMPARED:
                    kept.append(f)
                yield f


def complete(hist: dict[int, int], cap: int, used: int, bound: int, steps: Steps) -> Packing | None:
    """A packing in fewer than `used` sequences by bin completion, or None if there is none or the steps end.

    One sequence after the other is completed around the largest document that
    is left, by each undominated filling, applied to as many sequences as the
    counts allow, then to one. A branch ends when its waste, or the lower bound
    of what is left, rules out fewer than `used` sequences. Going on after a
    packing was found, it looks for a better one until the bound is met.
    """
    total, best = sum(n * c for n, c in hist.items()), None
    lengths = sorted(hist, reverse=True)
    left = [0] * (cap + 1)
    for n, c in hist.items():
        left[n] = c
    waste = sequences = 0
    done: list[tuple[dict[int, int], int, int]] = []  # documents, times, waste of each

    def branches(first: int) -> Iterator[tuple[dict[int, int], int, int]]:
        top = lengths[first]
        rest = lengths[first:]
        left[top] -= 1
        for f in fillings(left, rest, cap - top, (used - 1) * cap - total - waste, steps):
            left[top] += 1
            need = {n: 0 for n in (top, *f)}
            for n in (top, *f):
                need[n] += 1
            gap = cap - top - sum(f)
            times = min(left[n] // k for n, k in need.items())
            if gap:
                times = min(times, max(0, (used - 1) * cap - total - waste) // gap)
            for m in dict.fromkeys((times, 1)) if times else ():
                yield need, m, gap
            left[top] -= 1
        left[top] += 1

    stack, firsts = [branches(0)], [0]
    while stack and used > bound and steps.n > 0:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            firsts.pop()
        else:
            need, m, gap = step
            for n, k in need.items():
                left[n] -= m * k
            done.append(step)
            waste, sequences = waste + m * gap, sequences + m
            first = next((i for i in range(firsts[-1], len(lengths)) if left[lengths[i]]), None)
            if first is None:
                if sequences < used:
                    best, used = [(tuple(sorted(need.items(), reverse=True)), m) for need, m, _ in done], sequences
            elif waste <= (used - 1) * cap - total and sequences + lower_bound({n: left[n] for n in lengths[first:] if left[n]}, cap) < used:
                stack.append(branches(first))
                firsts.append(first)
                continue
        if done:
            need, m, gap = done.pop()
            for n, k in need.items():
                left[n] += m * k
            waste, sequences = waste - m * gap, sequences - m
    return best


def pack_histogram(hist: dict[int, int], cap: int = CAPACITY, steps: int = STEPS) -> Packing:
    """As few sequences as found for a histogram of lengths (length -> documents).

    Best-fit decreasing, mended where it wastes, is the first incumbent; while
    it is above the lower bound, bin completion looks for a better one.
    """
    hist = {n: c for n, c in hist.items() if c}
    if not hist:
        return []
    best, bound = best_fit(hist, cap), lower_bound(hist, cap)
    if sum(m for _, m in best) > bound:
        best = mend(hist, cap, best, bound)
    if (used := sum(m for _, m in best)) > bound:
        best = complete(hist, cap, used, bound, Steps(steps)) or best
    return best


def pieces(docs: DataFrame, path: str, cap: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the token sequences of documents: doc_id, piece, start, length, ids_crc32, and the block that made them."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block, end = encoder(path), TaskContext.get().partitionId(), END_ID.to_bytes(4, "little")
        for b in it:
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(enc.batch_ids(b.column(1).fill_null(""))):
                for k, at in enumerate(range(0, len(ids) + 1, cap)):
                    piece = ids[at : at + cap].tobytes() + (end if at + cap > len(ids) else b"")
                    rows.append((i, k, at, len(piece) // 4, zlib.crc32(piece)))
            got = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(got[:, 0])), pa.array(got[:, 1].astype(np.int32)), pa.array(got[:, 2]), pa.array(got[:, 3]), pa.array(got[:, 4]), pa.array(np.full(len(got), block, np.int32))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "block"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: tidy(batches(it), lambda: encoder(path).forget()), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, block int"
    )


def slots(packing: Packing) -> dict[str, np.ndarray]:
    """For each run of equal-length pieces of a packing: length, first rank, first sequence, pieces per sequence, first offset."""
    rows, taken, sequence = [], {}, 0
    for filling, m in packing:
        counts: dict[int, int] = {}
        for n, k in filling:
            counts[n] = counts.get(n, 0) + k
        offset = 0
        for n, k in counts.items():
            rows.append((n, taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + m * k
            offset += n * k
        sequence += m
    got = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), got.T))


def pack(docs: DataFrame, path: str, cap: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees only the histogram of lengths (`cap` numbers at most) and
    packs that; the plan has at most a few runs per length. Pieces of a length
    are then ranked by counts per writing block, so that no task gets all pieces
    of a common length, and rank decides the place. Null texts are empty: one
    piece with the end id only. Null ids, repeated rows and ties each keep their
    rows; an empty table gives no rows; extra columns are ignored.
    """
    made = materialize(pieces(docs, path, cap, id_col, text_col), "pieces")
    counts = made.groupBy("block", "length").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = made.sparkSession.sparkContext.broadcast(slots(pack_histogram(hist, cap)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = materialize(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "firsts")
    in_block = Window.partitionBy("block", "length").orderBy("doc_id", "piece")
    ranked = made.withColumn("in_block", F.row_number().over(in_block) - 1).join(firsts.hint("merge"), ["block", "length"])  # shares the window's shuffle

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = plan.value
        key = s["length"] * (1 << 48) + s["rank"] if len(s["length"]) else np.zeros(0, np.int64)
        for b in it:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            past, nth = np.divmod(rank - s["rank"][at], s["each"][at])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(s["sequence"][at] + past), pa.array(s["offset"][at] + nth * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("in_block")).alias("rank")).mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )

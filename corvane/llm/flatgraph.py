"""Embedding near-duplicates over a robust-pruned flat graph.

Distinct vectors of a label are cut into overlapping parts of a bounded size by
their nearest centroids. Each part builds a robust-pruned neighbour graph; the
adjacency lists of a vector from all its parts are united. Each vector is then
searched for in its own part and in those of the centroids nearest to it, all
vectors of a part at once: greedily from the part's medoids, and from the first
hit on by expanding everything in range. A link counts where its far end is at
home, so that none counts twice. An audit compares a stated sample with all
vectors of its label; labels whose recall falls short are searched in more
parts, and only if that is not enough compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import components, discard, forest, materialize

COSINE = 0.93
#: Home vectors of a part, about: the number of centroids is chosen for half of that, and parts over twice that are cut again, in so many rounds at most.
PART_ROWS = 1024
ROUNDS = 4
OVERLAP = 2
#: Vectors that centroids are chosen from (rows and bytes), over all labels, and vectors of that sample for each centroid at least.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64 << 20
SAMPLE_SHARE = 4
LLOYD = 6
#: Vectors that are searched for at once in a part; more of them are another task's.
QUERY_ROWS = 4096
DEGREE = 24
CANDIDATES = 72
ALPHA = 1.2
BEAM = 16
MEDOIDS = 8
#: The parts that a vector is searched for in: so many nearest ones, and those whose centroids are less than this further from it than the nearest.
PROBES = ((4, 0.06), (16, 0.25), (1 << 30, 9.0))
#: The audit's sample: of the vectors whose ids are divisible by 100, and then of the others, so many with the smallest hashes; and the recall that is enough.
AUDIT_ROWS = 1024
ENOUGH = 0.97
#: Numbers of a gathered block.
CELLS = 1 << 21


def valid(embedding: str, label: str) -> Column:
    """Whether a vector can link: a label, no null or non-finite component, not all zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge components in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def robust_prune(x: np.ndarray, i: int, near: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Neighbours of i out of near: the nearest first, dropping what a chosen one is alpha times nearer to."""
    d = 1 - x[near] @ x[i]
    order = np.argsort(d, kind="stable")
    near, d = near[order], d[order]
    between = 1 - x[near] @ x[near].T
    alive, out = np.ones(len(near), bool), []
    for k in range(len(near)):
        if alive[k]:
            out.append(int(near[k]))
            if len(out) == degree:
                break
            alive &= alpha * between[k] > d
    return out


def build(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of a shard: each vector's nearest and some spread-out candidates, robust-pruned, and the reverse edges."""
    n = len(x)
    far = np.unique(np.linspace(0, n - 1, 16, dtype=int))
    out: list[set[int]] = [set() for _ in range(n)]
    for at in range(0, n, 1024):
        sims = x[at : at + 1024] @ x.T
        top = np.argpartition(-sims, min(CANDIDATES, n - 1), axis=1)[:, : CANDIDATES + 1] if n > 1 else np.zeros((len(sims), 0), int)
        for i, row in enumerate(top, at):
            near = np.union1d(row, far)
            out[i].update(robust_prune(x, i, near[near != i]))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(out):
        for j in row:
            back[j].append(i)
    lists = [np.array(sorted(a | set(b)), np.int64) for a, b in zip(out, back, strict=True)]
    return [row if len(row) <= 2 * DEGREE else np.array(sorted(robust_prune(x, i, row, 2 * DEGREE)), np.int64) for i, row in enumerate(lists)]


def spread(x: np.ndarray, want: int, seed: int = 0) -> np.ndarray:
    """`want` centroids of a sample of unit vectors: some of them, moved to the middle of what is nearest to them."""
    if want <= 1 or len(x) < 2:
        return x[:1] if not len(x) else unit([x.sum(0)]) if np.abs(x.sum(0)).max() > 0 else x[:1]
    c = x[np.random.default_rng(seed).permutation(len(x))[:want]]
    for _ in range(LLOYD):
        near = np.concatenate([(x[at : at + 2048] @ c.T).argmax(1) for at in range(0, len(x), 2048)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), c)
    return c


Marks = dict[tuple, np.ndarray]


def homes(classes: DataFrame, marks: Marks) -> DataFrame:
    """(label, dim, part): for each vector of a label in marks its nearest centroid."""
    sent = classes.sparkSession.sparkContext.broadcast(marks)

    def nearest(it):
        for pdf in it:
            for (label, dim), g in pdf.groupby(["label", "dim"]):
                c = sent.value.get((label, dim))
                if c is not None:
                    yield pd.DataFrame({"label": g["label"].to_numpy(), "dim": dim, "part": (unit(g["vec"]) @ c.T).argmax(1)})

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "dim", "vec").mapInPandas(nearest, f"label {kind}, dim int, part bigint")


def centroids(classes: DataFrame) -> Marks:
    """For each (label, dimension) of more than PART_ROWS vectors its centroids, from bounded samples; those of too large parts are replaced by several."""
    counts = classes.groupBy("label", "dim").count().filter(F.col("count") > PART_ROWS)
    sizes = {(r["label"], r["dim"]): r["count"] for r in counts.orderBy(F.desc("count"), "label", "dim").limit(SAMPLE_ROWS // SAMPLE_SHARE).collect()}
    if not sizes:
        return {}
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(dim for _, dim in sizes))))
    at_hash = F.pmod(F.xxhash64("label", "vec"), F.lit((1 << 31) - 1))

    def sample(of: DataFrame, n: int) -> list:
        limit = int(min(1.0, 1.2 * rows / max(n, 1)) * (1 << 31))
        return of.filter(at_hash <= limit).orderBy(at_hash, "label", "vec").limit(rows).collect()

    groups: dict[tuple, list] = {}
    for r in sample(classes.select("label", "dim", "vec"), sum(sizes.values())):
        if (r["label"], r["dim"]) in sizes:
            groups.setdefault((r["label"], r["dim"]), []).append(r["vec"])
    marks = {key: spread(x := unit(v), min(-(-2 * sizes[key] // PART_ROWS), max(1, len(x) // SAMPLE_SHARE))) for key, v in groups.items()}
    for turn in range(1, ROUNDS):
        large = homes(classes, marks).groupBy("label", "dim", "part").count().filter(F.col("count") > 2 * PART_ROWS)
        large = large.orderBy(F.desc("count"), "label", "dim", "part").limit(rows // SAMPLE_SHARE).collect()
        if not large:
            break
        found = {((r["label"], r["dim"]), r["part"]): r["count"] for r in large}
        sent = classes.sparkSession.sparkContext.broadcast((marks, set(found)))

        def inside(it, sent=sent):
            marks, wanted = sent.value
            for pdf in it:
                for key, g in pdf.groupby(["label", "dim"]):
                    if key in marks:
                        part = (unit(g["vec"]) @ marks[key].T).argmax(1)
                        keep = np.array([(key, p) in wanted for p in part.tolist()], bool)
                        yield g[keep].assign(part=part[keep])

        kind, vec = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
        of = classes.select("label", "dim", "vec").mapInPandas(inside, f"label {kind}, dim int, vec {vec}, part bigint")
        groups = {}
        for r in sample(of, sum(found.values())):
            groups.setdefault(((r["label"], r["dim"]), r["part"]), []).append(r["vec"])
        for key in {key for key, _ in groups}:
            cut = {part: v for (k, part), v in groups.items() if k == key}
            kept = [c for part, c in enumerate(marks[key]) if part not in cut]
            new = [spread(x := unit(v), min(-(-2 * found[(key, part)] // PART_ROWS), max(1, len(x) // SAMPLE_SHARE)), turn) for part, v in cut.items()]
            marks[key] = np.concatenate([np.array(kept).reshape(-1, key[1]), *new])
    return marks


def probes(x: np.ndarray, c: np.ndarray, level: int) -> np.ndarray:
    """Which parts each x is searched for in at this level, and at no lower one."""
    sims = x @ c.T
    rank = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1, kind="stable")
    gap = sims.max(1, keepdims=True) - sims

    def up_to(k: int) -> np.ndarray:
        return (rank < PROBES[k][0]) | (gap < PROBES[k][1]) if k >= 0 else np.zeros_like(rank, bool)

    return up_to(level) & ~up_to(level - 1)


def padded(lists: list[np.ndarray], n: int) -> np.ndarray:
    """Adjacency lists as a table, -1 where they end, for n vectors of which the last have none."""
    out = np.full((n, max(map(len, lists), default=0) or 1), -1, np.int64)
    for i, row in enumerate(lists):
        out[i, : len(row)] = row
    return out


def dots(q: np.ndarray, x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """q[at] . x[rows], in blocks."""
    step = max(1, CELLS // q.shape[1])
    return np.concatenate([np.zeros(0), *(np.einsum("ik,ik->i", q[at[k : k + step]], x[rows[k : k + step]]) for k in range(0, len(at), step))])


def medoids(x: np.ndarray) -> np.ndarray:
    """The vector nearest to the middle, and others far from those chosen before."""
    out = [int((x @ x.mean(0)).argmax())]
    nearest = x @ x[out[0]]
    while len(out) < min(MEDOIDS, len(x)):
        out.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[out[-1]])
    return np.unique(out)


def walk(x: np.ndarray, adjacent: np.ndarray, start: np.ndarray, q: np.ndarray, radius: float, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for all of q at once, up to the first hit of each: the (query, vector) pairs in range that it has met."""
    pool = np.tile(start, (len(q), 1))
    sims = q @ x[start].T
    opened = np.zeros(pool.shape, bool)
    seen[:, start] = True
    step = max(1, CELLS // (adjacent.shape[1] * q.shape[1]))
    active = np.flatnonzero(sims.max(1) < radius)
    while len(active):
        left = np.where(opened[active], -np.inf, sims[active])
        best = left.argmax(1)
        on = left[np.arange(len(active)), best] > -np.inf
        active, best = active[on], best[on]
        opened[active, best] = True
        near = adjacent[pool[active, best]]
        new = (near >= 0) & ~seen[active[:, None], near]
        who, place = np.nonzero(new)
        seen[active[who], near[who, place]] = True
        got = np.full(near.shape, -np.inf)
        got[who, place] = dots(q, x, active[who], near[who, place])
        if near.shape[1] + pool.shape[1] > BEAM:
            both, which = np.concatenate([sims[active], got], 1), np.concatenate([pool[active], near], 1)
            flags = np.concatenate([opened[active], np.zeros(near.shape, bool)], 1)
            top = np.argpartition(-both, BEAM - 1, axis=1)[:, :BEAM]
            if pool.shape[1] < BEAM:
                grow = BEAM - pool.shape[1]
                pool = np.pad(pool, ((0, 0), (0, grow)))
                sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-np.inf)
                opened = np.pad(opened, ((0, 0), (0, grow)), constant_values=True)
            pool[active], sims[active], opened[active] = (np.take_along_axis(t, top, 1) for t in (which, both, flags))
        else:
            pool, sims, opened = (np.pad(t, ((0, 0), (0, near.shape[1])), constant_values=v) for t, v in ((pool, 0), (sims, -np.inf), (opened, True)))
            pool[active, -near.shape[1] :], sims[active, -near.shape[1] :], opened[active, -near.shape[1] :] = np.maximum(near, 0), got, got == -np.inf
        opened |= sims == -np.inf
        active = active[sims[active].max(1) < radius]
    at, place = np.nonzero(sims >= radius)
    return at, pool[at, place]


def search(x: np.ndarray, adjacent: np.ndarray, start: np.ndarray, q: np.ndarray, own: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs in range: the walk's hits and each query's own place (-1: none), and all that is reached from them within the range."""
    seen = np.zeros((len(q), len(x)), bool)
    at, hit = walk(x, adjacent, start, q, radius, seen)
    self_at = np.flatnonzero(own >= 0)
    codes = np.unique(np.concatenate([at * len(x) + hit, self_at * len(x) + own[self_at]]))
    found = [codes]
    seen.ravel()[codes] = True
    step = max(1, CELLS // adjacent.shape[1])
    while len(codes):
        reached = []
        for lo in range(0, len(codes), step):
            who, node = np.divmod(codes[lo : lo + step], len(x))
            near = adjacent[node]
            k, place = np.nonzero(near >= 0)
            new = who[k] * len(x) + near[k, place]
            new = np.unique(new[~seen.ravel()[new]])
            seen.ravel()[new] = True
            who, node = np.divmod(new, len(x))
            reached.append(new[dots(q, x, who, node) >= radius])
        codes = np.concatenate(reached)
        found.append(codes)
    return np.divmod(np.concatenate(found), len(x))


def exhaustive(x: np.ndarray, q: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, vector) pairs in range."""
    step = max(1, CELLS // max(len(x), 1))
    pairs = [np.nonzero(q[lo : lo + step] @ x.T >= radius) for lo in range(0, len(q), step)]
    return np.concatenate([a + lo for (a, _), lo in zip(pairs, range(0, len(q), step))]), np.concatenate([b for _, b in pairs])


class Graph:
    """The parts of all classes (cls, label, dim, size, vec), their united adjacency, and searches of all classes in some of the parts."""

    def __init__(self, classes: DataFrame, radius: float):
        self.classes, self.radius = classes, radius
        spark = classes.sparkSession
        found = centroids(classes)
        numbers = {key: k for k, key in enumerate(found)}
        self.marks = marks = spark.sparkContext.broadcast({key: (numbers[key], c) for key, c in found.items()})
        self.vec = classes.schema["vec"].dataType.simpleString()
        self.label = classes.schema["label"].dataType.simpleString()

        def assign(it):
            for pdf in it:
                for (label, dim), g in pdf.groupby(["label", "dim"]):
                    number, c = marks.value.get((label, dim), (None, None))
                    if c is None:
                        yield pd.DataFrame({"part": f"{label}:{dim}", "home": True, "cls": g["cls"], "size": g["size"], "vec": g["vec"]})
                        continue
                    near = np.argsort(-(unit(g["vec"]) @ c.T), axis=1, kind="stable")[:, :OVERLAP]
                    for place in range(near.shape[1]):
                        yield pd.DataFrame({"part": [f"{number}/{k}" for k in near[:, place]], "home": place == 0, "cls": g["cls"].to_numpy(), "size": g["size"].to_numpy(), "vec": g["vec"].to_numpy()})

        members = materialize(classes.select("label", "dim", "cls", "size", "vec").mapInPandas(assign, f"part string, home boolean, cls bigint, size bigint, vec {self.vec}"), "members")

        def adjacency(pdf: pd.DataFrame) -> pd.DataFrame:
            cls = pdf["cls"].to_numpy()
            return pd.DataFrame({"cls": cls, "near": [cls[a] for a in build(unit(pdf["vec"]))]})

        lists = members.groupBy("part").applyInPandas(adjacency, "cls bigint, near array<bigint>")
        united = materialize(lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
        inside = materialize(members.join(united, "cls").select("part", "home", "cls", "size", "vec", "near"), "inside")
        rim = inside.select("part", F.explode("near").alias("cls")).distinct().join(members.select("part", "cls"), ["part", "cls"], "left_anti")
        rim = rim.join(classes.select("cls", "size", "vec"), "cls").select("part", F.lit(None).cast("boolean").alias("home"), "cls", "size", "vec", F.lit(None).cast("array<bigint>").alias("near"))
        self.nodes = materialize(inside.unionByName(rim), "nodes")
        discard(members, united, inside)

    def queries(self, level: int, labels: list[tuple] | None) -> DataFrame:
        """(part, cls, size, vec): each class for each part that this level adds, of some labels only if they are given."""
        marks, wanted = self.marks, labels if labels is None else set(labels)

        def route(it):
            for pdf in it:
                for (label, dim), g in pdf.groupby(["label", "dim"]):
                    if wanted is not None and (label, dim) not in wanted:
                        continue
                    number, c = marks.value.get((label, dim), (None, None))
                    if c is None:
                        if level == 0:
                            yield pd.DataFrame({"part": f"{label}:{dim}", "cls": g["cls"], "size": g["size"], "vec": g["vec"]})
                        continue
                    row, part = np.nonzero(probes(unit(g["vec"]), c, level))
                    if len(row):
                        yield pd.DataFrame({"part": [f"{number}/{k}" for k in part], "cls": g["cls"].to_numpy()[row], "size": g["size"].to_numpy()[row], "vec": g["vec"].to_numpy()[row]})

        return self.classes.select("label", "dim", "cls", "size", "vec").mapInPandas(route, f"part string, cls bigint, size bigint, vec {self.vec}")

    def found(self, queries: DataFrame, exact: bool = False) -> DataFrame:
        """(cls, n, other): how many vectors each query is linked to in a part, and the edges of a spanning forest of the links there."""
        radius = self.radius
        queries = materialize(queries, "queries")
        chunks = materialize(queries.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks")), "chunks", queries.count())
        asked = queries.join(chunks, "part").select("part", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asked"), F.lit(None).cast("boolean").alias("home"), "cls", "size", "vec", F.lit(None).cast("array<bigint>").alias("near"))
        nodes = self.nodes.join(chunks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asked"), "home", "cls", "size", "vec", "near")

        def look(pdf: pd.DataFrame) -> pd.DataFrame:
            ask, nodes = pdf[pdf["asked"]], pdf[~pdf["asked"]]
            nodes = pd.concat([nodes[nodes["home"].notna()], nodes[nodes["home"].isna()]])
            cls, size, asked = nodes["cls"].to_numpy(), nodes["size"].to_numpy(), ask["cls"].to_numpy()
            home = (nodes["home"] == True).to_numpy()  # noqa: E712  null is neither
            if not len(nodes) or not len(ask):
                return _found([], asked, np.arange(len(asked)))
            x, q = unit(nodes["vec"]), unit(ask["vec"])
            n_inside = int(nodes["home"].notna().sum())
            place = pd.Series(np.arange(len(cls)), cls)
            if exact:
                a, b = exhaustive(x[:n_inside], q, radius)
            else:
                lists = [place[row].to_numpy() for row in nodes["near"].iloc[:n_inside]]
                a, b = search(x, padded(lists, len(x)), medoids(x[:n_inside]), q, place.reindex(asked, fill_value=-1).to_numpy(), radius)
            a, b = a[cls[b] != asked[a]], b[cls[b] != asked[a]]
            counted = home[b]
            counts = np.bincount(a[counted], size[b[counted]], len(asked)).astype(np.int64)
            some = np.flatnonzero(counts)
            # of the links a forest is enough: nodes, and queries behind them
            root = forest(b, a + len(cls), len(cls) + len(asked))
            everyone = np.concatenate([cls, asked])
            return _found(list(zip(asked[some], counts[some])), everyone, root)

        return materialize(asked.unionByName(nodes).groupBy("part", "chunk").applyInPandas(look, "cls bigint, n bigint, other bigint"), "found")


def audit_sample(classes: DataFrame) -> list:
    """Vectors to be compared with all: (cls, label, dim, vec)."""
    return classes.orderBy(~F.col("probe"), F.xxhash64("cls", "vec")).select("cls", "label", "dim", "vec").limit(AUDIT_ROWS).collect()


def linked_exactly(classes: DataFrame, sample: list, radius: float) -> dict[int, int]:
    """For each class of the sample how many vectors of other classes it is linked to, by comparison with all of its label."""
    groups: dict[tuple, list] = {}
    for r in sample:
        groups.setdefault((r["label"], r["dim"]), []).append(r)
    sent = classes.sparkSession.sparkContext.broadcast({key: (np.array([r["cls"] for r in g]), unit([r["vec"] for r in g])) for key, g in groups.items()})

    def compare(it):
        for pdf in it:
            for key, g in pdf.groupby(["label", "dim"]):
                if key in sent.value:
                    cls, x = sent.value[key]
                    a, b = exhaustive(unit(g["vec"]), x, radius)
                    other = g["cls"].to_numpy()[b] != cls[a]
                    counts = np.bincount(a[other], g["size"].to_numpy()[b[other]], len(cls)).astype(np.int64)
                    yield pd.DataFrame({"cls": cls, "n": counts})[counts > 0]

    rows = classes.select("label", "dim", "cls", "size", "vec").mapInPandas(compare, "cls bigint, n bigint").groupBy("cls").agg(F.sum("n").alias("n")).collect()
    return {r["cls"]: r["n"] for r in rows}


def near_duplicates(vectors: DataFrame, radius: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", report: list | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their labels are equal and not null and their cosine in
    double precision is radius or more; n_links and component_id are those of the
    links that the graph finds, each of which is verified. Recall is measured on
    AUDIT_ROWS vectors against all of their labels: labels under ENOUGH are
    searched for in more parts and in the end compared exactly; `report` gets a
    row (level, label, dimension, found, all) of each label and audit. Vectors
    that are null, zero, or hold null or non-finite components link with nothing,
    nor do vectors of different lengths or rows with a null id (component_id
    null, not kept). Equal vectors are one node of the graph and count as links
    of each other; repeated rows count as often as they occur. Rows that share a
    vec_id but not the vector each have the links of their own vector. Extra
    columns are ignored; an empty table gives no rows.
    """
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    src = src.withColumn("ok", valid("vec", "label") & F.col("vec_id").isNotNull())
    whole_id = F.xxhash64("vec_id") if src.schema["vec_id"].dataType.typeName() not in ("byte", "short", "integer", "long") else F.col("vec_id")
    grouped = src.filter("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.max(whole_id % 100 == 0).alias("probe"))
    # the number of a class comes with the row and is fixed once the table is written
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cls"), "label", "vec", "first", "size", "probe", F.size("vec").alias("dim")), "classes")
    graph = Graph(classes, radius)
    sample = audit_sample(classes)
    exact = linked_exactly(classes, sample, radius)
    searched, short, replaced = [], None, []
    for level in range(len(PROBES) + 1):
        if level == len(PROBES):  # the graph itself falls short
            replaced = short
            searched += [found := graph.found(_all(graph, short), exact=True)]
        else:
            searched += [found := graph.found(graph.queries(level, short))]
        of_sample = {r["cls"]: r["label"] for r in sample}
        counts: dict[int, int] = {}
        for df in [found] if replaced else searched:
            for r in df.filter(F.col("other").isNull() & F.col("cls").isin(list(of_sample))).groupBy("cls").agg(F.sum("n").alias("n")).collect():
                counts[r["cls"]] = counts.get(r["cls"], 0) + r["n"]
        sums: dict[tuple, list[int]] = {}
        for r in sample:
            mine = sums.setdefault((r["label"], r["dim"]), [0, 0])
            mine[0] += counts.get(r["cls"], 0)
            mine[1] += exact.get(r["cls"], 0)
        if report is not None:
            report += [(level, *key, got, all_) for key, (got, all_) in sums.items()]
        short = [key for key, (got, all_) in sums.items() if got < ENOUGH * all_]
        if not short or replaced:
            break
    discard(graph.nodes)

    searched_all = searched[0]
    for df in searched[1:]:
        searched_all = searched_all.unionByName(df)
    comps = materialize(components(searched_all.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))), "comps", classes.count())
    sums_of = lambda df, name: df.filter("other is null").groupBy("cls").agg(F.sum("n").alias(name))
    graph_parts = searched[:-1] if replaced else searched
    by_graph = graph_parts[0]
    for df in graph_parts[1:]:
        by_graph = by_graph.unionByName(df)
    named = classes.join(sums_of(by_graph, "found"), "cls", "left").join(comps, F.col("cls") == F.col("id"), "left")
    n = F.coalesce("found", F.lit(0))
    if replaced:
        named = named.join(sums_of(searched[-1], "exactly"), "cls", "left")
        again = F.lit(False)
        for label, dim in replaced:
            again = again | ((F.col("label") == F.lit(label)) & (F.col("dim") == dim))
        n = F.when(again, F.coalesce("exactly", F.lit(0))).otherwise(n)
    named = materialize(named.select("label", "vec", "first", (n + F.col("size") - 1).alias("n_links"), F.coalesce("comp", "cls").alias("comp")), "named")
    firsts = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    keyed = materialize(named.join(firsts, "comp").select("label", "vec", "n_links", "component_id"), "keyed")
    discard(classes, comps, named, *searched)
    linked = src.filter("ok").join(keyed, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = src.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept)


def _all(graph: Graph, labels: list[tuple]) -> DataFrame:
    """Each class of some labels for each part of its label."""
    out = graph.queries(0, labels)
    for level in range(1, len(PROBES)):
        out = out.unionByName(graph.queries(level, labels))
    return out


def _found(rows: list, cls: np.ndarray, root: np.ndarray) -> pd.DataFrame:
    """Counts (cls, n) and the edges of a spanning forest as one table (cls, n, other)."""
    far = np.flatnonzero((root != np.arange(len(root))) & (cls[root] != cls))
    counts = pd.DataFrame(rows, columns=["cls", "n"]).assign(other=None)
    edges = pd.DataFrame({"cls": cls[far], "n": None, "other": cls[root[far]]})
    return pd.concat([counts, edges]).astype({"cls": "int64", "n": "Int64", "other": "Int64"})

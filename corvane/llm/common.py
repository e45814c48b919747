"""Shared helpers: where tables are written, and how lineage is cut."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch: whole texts are in one row each, so that batches stay small in bytes.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
#: Rows per file of a table of short rows whose size is known, and files at least.
FILE_ROWS = 250_000
MIN_FILES = 8

_own_dirs: dict[str, str] = {}
_written: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all runs in one process (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = f"file://{path}"
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A full URI in the shared folder that no other run uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corvane/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again; a table of at most `rows` short rows in files of FILE_ROWS each, about.

    That cuts the lineage, so a lost executor costs one stage and not the whole
    job, and the table has no partitioning of its own: a later join shuffles it
    afresh, which lets adaptive execution split hot keys.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df if rows is None else df.coalesce(max(MIN_FILES, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for df in tables:
        path = _written.get(id(df))
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small. Plans read these settings when they run, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tidy(batches: Iterator, forget: Callable[[], None] | None = None) -> Iterator:
    """The same batches; after the last one, what `forget` drops and other memory that this worker has freed goes back to the machine."""
    yield from batches
    if forget:
        forget()
    release()


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and small-star steps.

    Returns (id, comp) for each id that has an edge to another id; comp is the
    smallest id that can be reached. Rows with a null end and loops are no edges.
    Each step is a grouped minimum (combined before its shuffle) and a join with
    it; both sides of the join are read from written tables, so a hub with many
    neighbours is split by adaptive execution. The number of rounds grows with
    the logarithm of the longest path.
    """
    e = materialize(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = materialize(both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")).select("x", F.least("x", "m").alias("m")), "low", 2 * state[0])
        large = materialize(e.join(lows, e.v == lows.x).select("u", F.col("m").alias("v")).distinct(), "large", state[0])
        low = materialize(large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m")), "low", state[0])
        small = large.join(low, large.u == low.x).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.union(low.select("x", "m")).distinct(), "edges", 2 * state[0])
        discard(old, lows, large, low)
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select("v", "v")).distinct()


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return (r["n"], r["h"])


def forest(pairs_a, pairs_b, n: int):
    """Labels 0..n-1 -> smallest label reachable, of index pairs (numpy, one task's own rows)."""
    import numpy as np

    root = np.arange(n)
    a, b = np.asarray(pairs_a), np.asarray(pairs_b)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root

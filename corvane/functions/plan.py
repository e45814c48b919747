"""Help with query plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast; its rows are known to be short.
BROADCAST_ROWS = 500_000
_own_dirs: dict[str, str] = {}
_stored: list[str] = []


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that the optimizer doesn't repeat their long expressions wherever a column is used."""
    return df.select(F.inline(F.array(F.struct(*(F.col(c) for c in df.columns)))))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset, a folder of our own if all runs in one process (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, for what several later steps read: it is computed once, and again only if the table is lost."""
    path = f"{shared_dir(df.sparkSession)}/corvane/{df.sparkSession.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete all tables that stored() has written for this application; their number. Results that were not read yet can't be any more."""
    n = len(_stored)
    while _stored:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

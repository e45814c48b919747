"""Versioned collections of keyed rows: guarded upserts that can be replayed, checks of contents, promotion by a pointer, and a cache of embeddings on them.

A collection's rows lie in buckets by key. A version is a manifest that names
the folder of each bucket; an upsert rewrites the buckets that it touches into
new folders and then commits a manifest, so readers see all of it or nothing,
and a job that is lost on the way leaves only folders that nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane.functions.plan import stored
from corvane.sources.versions import Conflict, Versions

BUCKETS = 16


class Mismatch(ValueError):
    """A collection was made for another model, dimension or schema, or its rows are not what its manifest says."""


def contents(rows: DataFrame) -> tuple[int, str]:
    """(number of rows, a digest of them as a multiset): whatever their order and the order of columns, the sum of their hashes."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], str(r["h"] or 0)


class Collection:
    """The collection under a root as of its newest version, or one given."""

    def __init__(self, spark: SparkSession, root: str, key: str = "chunk_id", version: int | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.versions = Versions(spark, root)
        self.number, self.manifest = self.versions.current() if version is None else (version, self.versions.manifest(version))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.manifest.get("n_buckets", BUCKETS))).cast("int")

    @property
    def schema(self) -> StructType | None:
        return StructType.fromJson(self.manifest["schema"]) if "schema" in self.manifest else None

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The rows of this version, of some buckets only if they are given."""
        paths = [f"{self.root}/{p}" for b, p in self.manifest.get("buckets", {}).items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def verify(self) -> None:
        """Mismatch unless number and digest of the rows are those of the manifest."""
        found = contents(self.read())
        if found != (self.manifest["n"], self.manifest["digest"]):
            raise Mismatch(f"{self.root} version {self.number} has {found[0]} rows of {self.manifest['n']}, or others")

    def matches(self, rows: DataFrame) -> bool:
        """Whether the collection has exactly these rows."""
        return contents(rows.select(self.schema.names)) == (self.manifest["n"], self.manifest["digest"])

    def upsert(self, rows: DataFrame, guard: dict | None = None, batch: int | None = None, rebuild: bool = False, deleted: DataFrame | None = None) -> Collection:
        """The version with rows put in or replaced by key (of several with a key the last by column seq, if there is one) and keys of `deleted` gone, even if they are in both.

        guard holds what the collection was made for (model, dimension, ...); a
        different guard or schema is a Mismatch, or with rebuild a new start. A
        batch that has been put in already changes nothing, so a stream can
        replay it. Another writer's commit on the way is a Conflict.
        """
        if batch is not None and not rebuild and batch <= self.manifest.get("batch", -1):
            return self
        if "seq" in rows.columns:
            last = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("seq")))
            rows = rows.withColumn("__nth", last).filter("__nth = 1").drop("__nth", "seq")
        started = self.number > 0 and not rebuild
        if started and guard is not None and guard != self.manifest["guard"]:
            raise Mismatch(f"{self.root} was made for {self.manifest['guard']}, not {guard}; set rebuild to replace it")
        if started and {(f.name, f.dataType.simpleString()) for f in rows.schema} != {(f.name, f.dataType.simpleString()) for f in self.schema}:
            raise Mismatch(f"{self.root} has columns {self.schema.simpleString()}")
        number = self.number + 1
        schema = self.schema if started else rows.schema
        if deleted is not None:
            rows = rows.join(deleted.select(F.col(self.key)), self.key, "left_anti")
        put = stored(rows.select(schema.names).withColumn("__bucket", self.bucket()), "put")
        gone = put.select(self.key, "__bucket")
        if deleted is not None:
            gone = gone.union(deleted.select(F.col(self.key).cast(schema[self.key].dataType)).withColumn("__bucket", self.bucket()))
        touched = [str(r["__bucket"]) for r in gone.select("__bucket").distinct().collect()]  # n_buckets at most
        whole = put
        if started:
            old = self.read(touched).withColumn("__bucket", self.bucket())
            whole = old.join(gone.drop("__bucket").distinct(), self.key, "left_anti").unionByName(put)
        folder = f"data/v{number:08d}-{uuid.uuid4().hex}"  # another writer of this version has its own
        whole.repartition("__bucket", F.pmod(F.xxhash64(self.key), F.lit(997))).write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        written = self._folders(folder)
        buckets = {b: p for b, p in (self.manifest.get("buckets", {}) if started else {}).items() if b not in touched}
        buckets |= {b: f"{folder}/__bucket={b}" for b in touched if b in written}
        manifest = {"buckets": buckets, "schema": schema.jsonValue(), "n_buckets": self.manifest.get("n_buckets", BUCKETS) if started else BUCKETS, "guard": guard if guard is not None else (self.manifest.get("guard", {}) if started else {}), "batch": batch if batch is not None else (self.manifest.get("batch", -1) if started else -1)}
        now = Collection.__new__(Collection)
        now.__dict__ |= {**self.__dict__, "manifest": manifest}
        manifest["n"], manifest["digest"] = contents(now.read())
        now.number = self.versions.commit(self.number, manifest)
        return now

    def _folders(self, folder: str) -> set[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {s.getPath().getName().partition("=")[2] for s in fs.listStatus(path) if "=" in s.getPath().getName()}


def sink(spark: SparkSession, root: str, key: str, guard: dict | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts each micro-batch into a collection once, however often it is replayed."""

    def write(batch: DataFrame, number: int) -> None:
        Collection(spark, root, key).upsert(batch, guard, number)

    return write


class Alias:
    """A name for a version of a collection, moved by one commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def target(self) -> Collection | None:
        _, to = self.versions.current()
        return Collection(self.spark, to["root"], to["key"], to["version"]) if to else None

    def read(self) -> DataFrame:
        """The rows of the version that the alias shows now; a DataFrame that was read before goes on showing the old ones."""
        target = self.target()
        if target is None:
            raise Mismatch("the alias shows nothing")
        return target.read()

    def promote(self, target: Collection, expected: DataFrame | None = None) -> dict:
        """Let the alias show a version, after its contents are checked against its manifest and the rows that are expected; the plan that was carried out.

        Where a check fails the alias goes on showing what it did.
        """
        if not target.number or not target.manifest["n"]:
            raise Mismatch(f"{target.root} is empty")
        target.verify()
        if expected is not None and not target.matches(expected):
            raise Mismatch(f"{target.root} version {target.number} has other rows than those expected")
        number, before = self.versions.current()
        after = {"root": target.root, "key": target.key, "version": target.number}
        if before != after:
            self.versions.commit(number, after)
        return {"from": before or None, "to": after, "rows": target.manifest["n"], "changed": before != after}

    def roll_back(self) -> dict:
        """Let the alias show again what it showed before."""
        numbers = self.versions.numbers()
        if len(numbers) < 2:
            raise Mismatch("there is nothing before")
        self.versions.commit(numbers[-1], self.versions.manifest(numbers[-2]))
        return self.versions.current()[1]


def migrate(source: Collection, root: str, key: str | None = None) -> Collection:
    """A copy of a collection under another root, checked row by row (number and multiset digest) before anyone is told of it."""
    made = Collection(source.spark, root, key or source.key)
    if made.number:
        raise Conflict(f"{root} has a collection")
    made = made.upsert(source.read(), source.manifest["guard"])
    if (made.manifest["n"], made.manifest["digest"]) != (source.manifest["n"], source.manifest["digest"]):
        raise Mismatch(f"{root} has other rows than {source.root}")
    return made


class EmbeddingCache:
    """Vectors by the digest of their text, for a model and a dimension; what can't be read counts as missing."""

    def __init__(self, spark: SparkSession, root: str, model: str, dimension: int):
        self.spark, self.guard = spark, {"model": model, "dimension": dimension}
        slug = "".join(c if c.isalnum() else "_" for c in model)
        self.root = f"{root.rstrip('/')}/{slug}/dim_{dimension}"

    def _open(self) -> tuple[Collection, DataFrame]:
        """The collection, and its rows in buckets that are whole."""
        at = Collection(self.spark, self.root, "digest")
        if not at.number:
            return at, self.spark.createDataFrame([], "digest string, vector array<float>")
        whole = [b for b in at.manifest["buckets"] if self._readable(at, b)]
        return at, at.read(whole)

    def _readable(self, at: Collection, bucket: str) -> bool:
        try:
            at.read([bucket]).agg(F.max(F.xxhash64("digest", "vector"))).collect()
            return True
        except Exception:  # noqa: BLE001  damaged or lost files, whatever the reader says of them
            return False

    def vectors(self, texts: DataFrame, encode: Callable[[DataFrame], DataFrame], text_col: str = "text") -> DataFrame:
        """texts with digest, vector and computed: vectors of the cache, and of encode((digest, text)) -> (digest, vector) for those texts that it lacks, which then go there.

        Each distinct text is encoded once. Null texts count as empty.
        """
        named = stored(texts.withColumn("digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), "named")
        at, have = self._open()
        lacking = named.join(have.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.first(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
        made = stored(encode(lacking).select("digest", F.col("vector").cast("array<float>").alias("vector")), "made")
        if made.head(1):
            damaged = at.number and len([b for b in at.manifest["buckets"] if self._readable(at, b)]) < len(at.manifest["buckets"])
            at.upsert(have.unionByName(made) if damaged else made, self.guard, rebuild=bool(damaged))
        both = have.withColumn("computed", F.lit(False)).unionByName(made.withColumn("computed", F.lit(True)))
        return named.join(both, "digest", "left")

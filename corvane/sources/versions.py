"""Versions of a stored table set: a manifest for each, put in place by one rename, so that readers see a whole version or none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Versions:
    """Manifests root/manifests/v<number>.json; the one with the highest number is current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        fs, folder = self._path("")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def current(self) -> tuple[int, dict]:
        """(number, manifest) of the newest version, (0, {}) before the first."""
        numbers = self.numbers()
        return (numbers[-1], self.manifest(numbers[-1])) if numbers else (0, {})

    def manifest(self, number: int) -> dict:
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/manifests/v{number:08d}.json")
        return json.loads(lines.first()["value"])

    def commit(self, after: int, manifest: dict) -> int:
        """Make `manifest` the version behind `after`. Conflict if that exists by now; nothing is changed then."""
        number = after + 1
        fs, temporary = self._path(f"/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        _, final = self._path(f"/v{number:08d}.json")
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise Conflict(f"version {number} of {self.root} exists")
        return number

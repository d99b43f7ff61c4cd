"""A manifest of the finished stages of one run.

A run writes its tables under a folder of its own.  When a stage's table is there, the
stage is put down in the manifest with what was counted on the way; a run that is
started again with the same fingerprint takes finished stages as they are and goes on
with the first one that isn't there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from itemlens.session import hadoop_path


def fingerprint(*parts: object) -> str:
    """A short digest of what a run's results depend on (by their ``repr``)."""
    return hashlib.sha256("\x00".join(map(repr, parts)).encode()).hexdigest()[:16]


def counted_write(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """``write(df)``, and the number of rows that it wrote, counted by the same job."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


class StageLog:
    """The manifest under ``folder``/_stages: one small JSON file per finished stage."""

    def __init__(self, spark: SparkSession, folder: str, mark: str):
        self.spark, self.folder, self.mark = spark, folder.rstrip("/"), mark

    def _file(self, stage: str):
        return hadoop_path(self.spark, f"{self.folder}/_stages/{stage}.json")

    def facts(self, stage: str) -> dict | None:
        """What the finished ``stage`` left, or None if it has to run (again)."""
        place, fs = self._file(stage)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        entry = json.loads(text)
        return entry["facts"] if entry["mark"] == self.mark else None

    def finish(self, stage: str, **facts) -> dict:
        place, fs = self._file(stage)
        stream = fs.create(place, True)
        try:
            stream.write(bytearray(json.dumps({"mark": self.mark, "facts": facts}).encode()))
        finally:
            stream.close()
        return facts

    def run(self, stage: str, work: Callable[[], dict]) -> dict:
        """The facts of ``stage``; ``work`` runs, and gives them, unless it is finished."""
        found = self.facts(stage)
        return found if found is not None else self.finish(stage, **work())

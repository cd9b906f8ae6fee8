"""A ledger of resampled runs: what was asked for, and parts that are committed once and whole."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession


class RunLedger:
    """Parts of runs in a folder that all executors share.

    ``asked`` names the ranges of runs that were wanted and how they are cut; ``parts`` holds one table a range, which counts once its writer has
    ended (_SUCCESS). As a run depends on its number and the seed alone, a part written again is the same part: what a lost driver or executor
    left half-done is replaced, what is whole is never computed again. ``model`` says what the runs are of; another model is refused.
    """

    def __init__(self, spark: SparkSession, folder: str, model: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        text = json.dumps(model, sort_keys=True, default=str)
        if self.fs.exists(self._path("model/_SUCCESS")):
            if self.spark.read.text(f"{self.folder}/model").first()[0] != text:
                raise ValueError("the ledger holds runs of another model")
        else:
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/model")

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _ranges(self, kind: str) -> list[tuple[int, ...]]:
        top = self._path(kind)
        names = [s.getPath().getName() for s in self.fs.listStatus(top)] if self.fs.exists(top) else []
        return sorted(tuple(map(int, m[1].split("-"))) for n in names if (m := re.fullmatch(r"runs-([\d-]+)", n)))

    @staticmethod
    def _name(kind: str, *numbers: int) -> str:
        return f"{kind}/runs-" + "-".join(f"{n:08d}" for n in numbers)

    def ask(self, first: int, last: int, step: int) -> None:
        """Runs ``first`` to ``last`` are wanted, in parts of ``step``."""
        self.fs.mkdirs(self._path(self._name("asked", first, last, step)))

    def wanted(self) -> list[tuple[int, int, int, int]]:
        """(first run, last run, first and last run of the call) of all parts that were asked for, committed or not."""
        return [(a, min(a + step - 1, last), first, last) for first, last, step in self._ranges("asked") for a in range(first, last + 1, step)]

    def committed(self) -> list[tuple[int, int]]:
        return [(a, b) for a, b in self._ranges("parts") if self.fs.exists(self._path(f"{self._name('parts', a, b)}/_SUCCESS"))]

    def missing(self) -> list[tuple[int, int, int, int]]:
        done = set(self.committed())
        return [w for w in self.wanted() if w[:2] not in done]

    def next(self) -> int:
        """The first run that nobody asked for."""
        return max((w[3] + 1 for w in self.wanted()), default=0)

    def write(self, part: DataFrame, first: int, last: int) -> None:
        part.write.mode("overwrite").parquet(f"{self.folder}/{self._name('parts', first, last)}")

    def read(self, schema) -> DataFrame:
        """All committed parts."""
        paths = [f"{self.folder}/{self._name('parts', a, b)}" for a, b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

"""A levelled store of batch results: every batch adds a run, and runs are merged in powers of a fan-out, so that a reader opens a
number of runs that grows with the logarithm of the batches."""
from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN_OUT = 8
_RUN = re.compile(r"run-(\d+)-(\d+)")


class RunStore:
    """Runs under `path`, one folder for the batches `first` to `last`. `merge` folds rows of several runs into one.

    A run counts once it is written completely. A batch that is run again after a failure finds its rows there, or replaces
    what was written in part: it never counts twice. Merged runs are deleted one batch later, when no reader of the batch
    before needs them any more. Batches may be added by one stream at a time, in order; numbers may be left out.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan_out: int = FAN_OUT):
        if fan_out < 2:
            raise ValueError("a merge takes at least two runs")
        self.spark, self.path, self.merge, self.fan_out = spark, path, merge, fan_out
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, run: tuple[int, int]) -> str:
        return os.path.join(self.path, "run-%d-%d" % run)

    def _complete(self) -> list[tuple[int, int]]:
        if not self._files.exists(self._place(self.path)):
            return []
        names = (s.getPath().getName() for s in self._files.listStatus(self._place(self.path)))
        runs = [(int(m[1]), int(m[2])) for m in map(_RUN.fullmatch, names) if m]
        return sorted(r for r in runs if self._files.exists(self._place(os.path.join(self._folder(r), "_SUCCESS"))))

    def runs(self) -> list[tuple[int, int]]:
        """The runs that are read: of runs that cover each other the wider."""
        complete = self._complete()
        return [r for r in complete if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in complete)]

    def _write(self, rows: DataFrame, run: tuple[int, int]) -> None:
        self.merge(rows).write.mode("overwrite").parquet(self._folder(run))

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.parquet(*map(self._folder, runs))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Adds the rows of a batch, unless it is there, and merges the newest `fan_out` runs while they are of one size."""
        live = self.runs()
        for run in set(self._complete()) - set(live):
            self._files.delete(self._place(self._folder(run)), True)
        if not any(first <= batch_id <= last for first, last in live):
            self._write(rows, (batch_id, batch_id))
        live = self.runs()
        width = 1
        while len(live) >= self.fan_out and all(self._level(r) == width for r in live[-self.fan_out:]):
            last = live[-self.fan_out:]
            self._write(self._read(last), (last[0][0], last[-1][1]))
            live = [*live[:-self.fan_out], (last[0][0], last[-1][1])]
            width += 1

    def _level(self, run: tuple[int, int]) -> int:
        """1 for a single batch, 2 for `fan_out` of them, and so on."""
        level, size = 1, self.fan_out
        while run[1] - run[0] + 1 >= size:
            level, size = level + 1, size * self.fan_out
        return level

    def read(self) -> DataFrame:
        """All rows added so far, merged."""
        return self.merge(self._read(self.runs()))

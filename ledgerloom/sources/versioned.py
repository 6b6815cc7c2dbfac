"""Tables that change as a whole: every state is a folder of its own, and a numbered pointer file says which one holds.

A change reads a state, stages the next one and publishes it by creating the pointer of the next number, which
only one writer can: who comes second reads what is there now and tries again. Readers follow the last pointer, whose folder was
complete before and is never written again, so they see whole states and no lock is held.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A table in a folder that driver and executors see. States no pointer names are left behind by writers that lost or failed; ``clean`` removes them.

    The folder lies on a local disk or on a file system whose rename is atomic and fails where the target exists, as HDFS's does.
    Every publication costs the state's size, so it is for registries and sample stores, not for tables of facts.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        hadoop = spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.folder}/pointers")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._pointers = self._fs.makeQualified(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._pointers, name)

    def number(self) -> int:
        """The number of the state that holds, 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._pointers)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _state(self, number: int) -> str:
        stream = self._fs.open(self._path(f"{number:012d}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, number: int | None = None) -> DataFrame:
        """A state's rows, by default those of the one that holds; empty before the first."""
        at = self.number() if number is None else number
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/states/{self._state(at)}")

    def _publish(self, number: int, state: str) -> bool:
        """Creates the pointer of a number; False where another writer has. Its content is complete when it appears under its name."""
        drafted, final = self._path(f"draft-{uuid.uuid4().hex}"), self._path(f"{number:012d}")
        out = self._fs.create(drafted, False)
        out.write(bytearray(state.encode()))
        out.close()
        try:
            if self._pointers.toUri().getScheme() == "file":
                # a local rename replaces what is there, a link doesn't
                os.link(drafted.toUri().getPath(), final.toUri().getPath())
                return True
            return self._fs.rename(drafted, final)
        except FileExistsError:
            return False
        finally:
            self._fs.delete(drafted, False)

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 50) -> int:
        """Publishes ``change`` of the state that holds and returns its number; run again on the newer state where another writer was first."""
        for _ in range(tries):
            held = self.number()
            state = uuid.uuid4().hex
            change(self.read(held)).write.parquet(f"{self.folder}/states/{state}")
            if self._publish(held + 1, state):
                return held + 1
        raise RuntimeError(f"{tries} other writers were first")

    def clean(self, keep: int = 1) -> None:
        """Removes all states but the last ``keep``, and their pointers; no writer or reader of older ones may be at work."""
        last = self.number()
        named = {n: self._state(n) for n in range(max(1, last - keep + 1), last + 1)}
        states = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/states")
        for s in self._fs.listStatus(states):
            if s.getPath().getName() not in named.values():
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._pointers):
            if s.getPath().getName() not in {f"{n:012d}" for n in named}:
                self._fs.delete(s.getPath(), False)

"""Incremental conversion of files: what is new is listed by a stream, and equal content is converted once whatever its files are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.microbatch import run_available

FILE = "path string, modificationTime timestamp, length long, content binary"
LISTED = "path string, modificationTime timestamp, length long, digest string, batch long"


class ContentCache:
    """Results of a conversion by the digest (SHA-256) of the content, in a folder that driver and executors see.

    The stream's checkpoint knows the files it has seen by their paths, whatever their age, so a run reads new ones only and converts the contents
    that no earlier file had. An upload has a path of its own: what is written anew under a path that was seen isn't noticed. A batch has at most ``batch_files`` files, which bounds the table of paths that is broadcast.
    Each batch writes partitions of its own and overwrites them when it is delivered again, so a run that was broken off leaves
    nothing twice. One run at a time holds the checkpoint. Results of files that are gone stay. Spark lists no empty files, so they have no result.
    """

    def __init__(self, spark: SparkSession, folder: str, result: str = "string", batch_files: int = 10_000):
        self.spark, self.folder, self.batch_files = spark, folder.rstrip("/"), batch_files
        self.kind = f"digest string, result {result}, batch long"

    def _held(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def refresh(self, source: str, convert: Callable[[Column], Column]) -> None:
        """Takes what is new under ``source`` (a folder or a pattern of folders); ``convert`` makes the result of a content column."""
        stream = self.spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.batch_files).option("maxFileAge", "36500d").load(source)

        def consume(batch: DataFrame, number: int) -> None:
            self._put(batch.select("path", "modificationTime", "length", F.sha2("content", 256).alias("digest")), "files", number)
            listed = self.files().where(F.col("batch") == number)
            known = self.results().where(F.col("batch") != number)
            # of equal contents one file is read again and converted
            new = listed.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("path").alias("path"))
            self._put(batch.select("path", "content").join(F.broadcast(new), "path").select("digest", convert(F.col("content")).alias("result")), "results", number)

        run_available(stream, consume, f"{self.folder}/checkpoint")

    def files(self) -> DataFrame:
        """(path, modificationTime, length, digest, batch) of every file seen."""
        return self._held("files", LISTED)

    def results(self) -> DataFrame:
        """(digest, result, batch): one row per content, and the batch that converted it."""
        return self._held("results", self.kind)

    def current(self) -> DataFrame:
        """(path, digest, result, reused) of every file seen; ``reused`` where an earlier batch had converted its content."""
        seen = self.files().select("path", "digest", F.col("batch").alias("seen"))
        return seen.join(self.results(), "digest").select("path", "digest", "result", (F.col("batch") < F.col("seen")).alias("reused"))

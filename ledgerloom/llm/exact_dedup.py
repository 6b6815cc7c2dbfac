"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, which any session can open by its name or its
folder. A batch is first grouped by digest (partial aggregates take the heat out of hot copies); a
sort-merge anti-join that shuffles only the batch leaves what the index lacks, and that is appended.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, partitions, stored, stored_and_measured

#: The white space that equality ignores: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def normal_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without WHITE; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256)


def rank(keep_id: str, points: str) -> Column:
    """What the row that stays is greatest in: having an id, code points, a small id."""
    return F.struct(F.col(keep_id).isNotNull().alias("named"), F.col(points).alias("points"), (-F.col(keep_id)).alias("low"))


class DigestIndex:
    """Table (digest, keep_id, points) with the texts ever added.

    Append only: where a better row of a known text comes (``replace``), it gets a row of its own and ``table``
    takes the best, inside the bucket and without a shuffle; ``compacted`` makes an index without the others. Opened by
    the name of a catalog table, by its folder, or both, in any session: what the folder holds is never
    overwritten, and its number of buckets holds, not the session's. Without name and folder it
    is a managed table, which ``drop`` removes with its files.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if spark.catalog.tableExists(self.name):
            known = self._described()["Location"].rstrip("/").removeprefix("file:")
            if path is not None and known != path.rstrip("/").removeprefix("file:"):
                raise ValueError(f"table {self.name} lies in {known}, not in {path}")
            return
        held = path is not None and self._noted_buckets(path)
        n = held or buckets or partitions(spark)
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT, points BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS" + (f" LOCATION '{path}'" if path else ""))
        if path and not held:
            # a folder that begins with an underscore is none of the table's data
            spark.createDataFrame([(n,)], "buckets int").coalesce(1).write.json(f"{path}/_buckets")

    def _described(self) -> dict[str, str]:
        return {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}

    def _noted_buckets(self, path: str) -> int | None:
        """The number of buckets of an index in a folder, None where the folder is empty or not there yet."""
        found = lambda reader, at: _exists(lambda: reader.load(at).take(1))
        noted = found(self.spark.read.format("json").schema("buckets int"), f"{path}/_buckets")
        if not noted and found(self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet"), path):
            raise ValueError(f"{path} holds files that are no digest index")
        return noted[0]["buckets"] if noted else None

    @property
    def buckets(self) -> int:
        return int(self._described()["Num Buckets"])

    def table(self) -> DataFrame:
        """The best row of each text. A bucket's rows lie together, so nothing is shuffled."""
        best = self.spark.table(self.name).groupBy("digest").agg(F.max(rank("keep_id", "points")).alias("b"))
        return best.select("digest", (-F.col("b.low")).alias("keep_id"), F.col("b.points").alias("points"))

    def append_new(self, groups: DataFrame, replace: bool = False) -> None:
        """Adds the groups (digest, keep_id, points) that the index doesn't have; with replace also those better than its own."""
        known, own = self.table(), groups.select("digest", "keep_id", "points")
        if replace:
            worse = known.toDF("_digest", "_keep", "_points").hint("merge")
            met = (F.col("digest") == F.col("_digest")) & (rank("_keep", "_points") >= rank("keep_id", "points"))
            fresh = own.join(worse, met, "left_anti")
        else:
            fresh = own.join(known.hint("merge"), "digest", "left_anti")
        # what was read from the table is stored first, since no table can be appended to from itself
        n = self.buckets
        stored(fresh).repartition(n, "digest").write.format("parquet").mode("append").bucketBy(n, "digest").sortBy("digest").saveAsTable(self.name)

    def compacted(self, name: str | None = None, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new index of one sorted file a bucket; this one stays as it is until its owner drops it."""
        new = DigestIndex(self.spark, name, path, buckets or self.buckets)
        new.append_new(self.table())
        return new

    def drop(self) -> None:
        """Takes the table out of the catalog; the files in a folder that was named stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _exists(load):
    """What load gives, or None where its folder isn't there."""
    try:
        return load()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original (code points), then the smallest id stays; a row without an id
    stays only if no row of its text has one, and keep_id is null there. With an ``index``, a text that it
    held before keeps the id recorded there; without, a temporary one is filled in ``batches`` appends, whose
    better rows supersede earlier ones, so their number doesn't change the result. Null and empty texts are one group. Rows
    repeated with one id (or without any) share its verdict. Empty tables give no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    signed = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_digest(F.col(text_col)).alias("digest"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"))
    own, seen = stored_and_measured(signed, F.count("*").alias("n"))
    own_index = index or DigestIndex(spark)
    groups = None
    for b in range(batches):
        part = own if batches == 1 else own.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b)
        best = part.groupBy("digest").agg(F.max(rank("doc_id", "points")).alias("b"), F.count("*").alias("group_size"))
        batch = stored(best.select("digest", (-F.col("b.low")).alias("keep_id"), F.col("b.points").alias("points"), "group_size"))
        own_index.append_new(batch, replace=index is None)
        groups = batch if groups is None else groups.union(batch)
    sizes = groups.select("digest", "group_size")
    if batches > 1:
        sizes = sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    held = stored(sizes.join(own_index.table().select("digest", "keep_id").hint("merge"), "digest"))
    if index is None:
        own_index.drop()
    out = attach(own, held, "digest", "group_size", seen["n"], F.col("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows repeated with one id (or none) and text, the longest."""
    found = deduplicate(docs, id_col=id_col, text_col=text_col).where("kept").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")).agg(F.count("*").alias("_n"))
    verdicts, seen = stored_and_measured(found, F.max("_n").alias("most"))
    digest = normal_digest(F.col(text_col))
    stay = lambda some: docs.join(some, (digest == F.col("_digest")) & F.col(id_col).cast("long").eqNullSafe(F.col("_id")), "left_semi")
    if (seen["most"] or 0) < 2:
        return stay(verdicts)
    longest = F.max_by(F.struct(*docs.columns), F.struct(F.char_length(text_col), F.col(text_col)))
    return stay(verdicts.where("_n = 1")).union(stay(verdicts.where("_n > 1")).groupBy(F.col(id_col).alias("_id"), digest.alias("_digest")).agg(longest.alias("_row")).select("_row.*"))

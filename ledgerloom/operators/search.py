"""A search index for parts of names: postings of their grams, kept by gram, with verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grams have one to three characters: patterns of fewer than three are grams themselves.
GRAM = 3


def _folded(name: Column) -> Column:
    return F.lower(name)


def grams(text: Column) -> Column:
    """All distinct substrings of one to three characters."""
    n = F.char_length(text)

    def of(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(size) for size in range(1, GRAM + 1)]))


def name_id(name: Column) -> Column:
    """128 bits of a name's SHA-256, 16 bytes: each posting carries one, and there are some three a character."""
    return F.unhex(F.substring(F.sha2(name, 256), 1, 32)).alias("name_id")


class NameIndex:
    """Distinct names (in small letters), postings (gram, name's id) and gram counts, in a folder that driver and executors see.

    Names are held once however many rows have them, so postings grow with distinct names. They are dealt to ``buckets`` folders by
    the gram's hash and sorted by gram in them: a search reads the folders of its grams, and of their files the row groups that can
    hold them. A gram of a third of all names is divided over files by the name's id.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, name: str) -> NameIndex:
        """Writes the index of the names of rows; null names are found by nothing."""
        names = rows.select(_folded(F.col(name)).alias("name")).where("name IS NOT NULL").distinct().select(name_id(F.col("name")), "name")
        names.write.parquet(f"{self.folder}/names")
        held = self.spark.read.parquet(f"{self.folder}/names")
        posted = held.select("name_id", F.explode(grams(F.col("name"))).alias("gram")).withColumn("bucket", self._bucket(F.col("gram")))
        # a bucket's rows go to four tasks by id, so a frequent gram is no single task's
        dealt = posted.withColumn("_part", F.pmod(F.xxhash64("name_id"), F.lit(4))).repartition("bucket", "_part").sortWithinPartitions("bucket", "gram").drop("_part")
        dealt.write.partitionBy("bucket").parquet(f"{self.folder}/postings")
        counts = self.postings().groupBy("gram").agg(F.count("*").alias("n_names"))
        counts.write.parquet(f"{self.folder}/counts")
        return self

    def names(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/names")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("name_id binary, gram string, bucket int").parquet(f"{self.folder}/postings")

    def find(self, pattern: str) -> DataFrame:
        """The distinct names that contain a pattern in any case. Only the folders of the pattern's grams are read; all its grams must be there, then the name is looked at."""
        folded = pattern.lower()
        if not folded:
            return self.names().select("name")
        wanted = [folded] if len(folded) < GRAM else sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
        buckets = [r["b"] for r in self.spark.createDataFrame([(g,) for g in wanted], "g string").select(self._bucket(F.col("g")).alias("b")).distinct().collect()]
        hits = self.postings().where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
        whole = hits.groupBy("name_id").agg(F.count("*").alias("k")).where(F.col("k") == len(wanted))
        return self.names().join(whole, "name_id", "left_semi").where(F.col("name").contains(folded)).select("name")

    def find_all(self, patterns: DataFrame, pattern: str) -> DataFrame:
        """(pattern, name) of every pattern of a table and every distinct name that contains it; empty patterns find all names, null ones nothing.

        Each distinct pattern asks for its rarest gram only, so a pattern's candidates are no more than the names of that gram; a gram
        that no name has ends the search. Candidates are verified once.
        """
        asked = patterns.select(F.col(pattern).alias("pattern")).where("pattern IS NOT NULL").distinct().withColumn("_folded", _folded(F.col("pattern")))
        size = F.least(F.char_length("_folded"), F.lit(GRAM))
        own = asked.where("_folded <> ''").select("pattern", "_folded", F.explode(F.filter(grams(F.col("_folded")), lambda g: F.char_length(g) == size)).alias("gram"))
        counted = own.join(self.spark.read.parquet(f"{self.folder}/counts"), "gram", "left")
        rarest = counted.groupBy("pattern", "_folded").agg(F.min(F.struct(F.coalesce("n_names", F.lit(0)).alias("n"), F.col("gram"))).alias("r")).where("r.n > 0").select("pattern", "_folded", F.col("r.gram").alias("gram"))
        candidates = rarest.join(self.postings().drop("bucket"), "gram").join(self.names(), "name_id")
        found = candidates.where(F.col("name").contains(F.col("_folded"))).select("pattern", "name")
        if asked.where("_folded = ''").isEmpty():
            return found
        return found.union(self.names().select(F.lit("").alias("pattern"), "name"))

"""Plumbing that the corpus operators share: cutting lineage, skew-proof lookups, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least one row in so many counts as hot; so there are at most so many hot keys.
HOT_SHARE = 1000
#: A key with fewer rows than this is never hot.
HOT_LEAST = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the session names none, a local one is made on one machine (as in tests); a cluster raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it as Parquet in the shared folder: no plan, broadcast or shuffle of it stays, and later reads survive lost executors."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_and_measured(df: DataFrame, *measures: Column) -> tuple[DataFrame, dict]:
    """stored, with aggregates of df taken on the way, in the same job."""
    seen = Observation()
    return stored(df.observe(seen, *measures)), seen.get


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def attach(left: DataFrame, right: DataFrame, key: str, count: str, total: int, row_id: Column) -> DataFrame:
    """Left join of ``left`` with ``right`` (unique in ``key``) that no hot key can slow down.

    ``count`` names right's column with the number of left rows of a key. Keys with at least
    ``total / HOT_SHARE`` rows are at most HOT_SHARE many, so they are broadcast; rows they
    match leave the shuffled join under a key of their own (from ``row_id``) and spread evenly.
    """
    hot_least = max(HOT_LEAST, total // HOT_SHARE)
    values = [c for c in right.columns if c != key]
    kind = right.schema[key].dataType
    hot = right.where(F.col(count) >= hot_least).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = right.where(F.col(count) < hot_least).select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    off = row_id.cast(kind) if kind.typeName() != "string" else F.concat(F.lit("~"), row_id.cast("string"))
    marked = left.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")
    if kind.typeName() == "string":
        marked = marked.withColumn("_cold_at", F.when(F.col("_hot_key").isNull(), F.coalesce(F.col(key), off)).otherwise(off))
        joined = marked.join(cold, F.col("_cold_at") == F.col("_cold_key"), "left")
    else:
        marked = marked.withColumn("_cold_at", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(off)).withColumn("_is_cold", F.col("_hot_key").isNull() & F.col(key).isNotNull())
        joined = marked.join(cold, (F.col("_cold_at") == F.col("_cold_key")) & F.col("_is_cold"), "left").drop("_is_cold")
    picked = [F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values]
    return joined.select(*[left[c] for c in left.columns], *picked)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges (u, v) one edge for each node that isn't its tree's smallest: to that."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, ends = np.arange(len(nodes)), at.reshape(2, -1)
    while True:
        low, high = up[ends].min(axis=0), up[ends].max(axis=0)
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(up, high[apart], low[apart])
        while (up[up] != up).any():
            up = up[up]
    moved = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[moved], nodes[up[moved]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's edges."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    own, tops = forest(*(np.concatenate([p[i] for p in parts]) if parts else np.empty(0, np.int64) for i in (0, 1)))
    for lo in range(0, len(own), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(own[lo : lo + (1 << 16)]), pa.array(tops[lo : lo + (1 << 16)])], names=["u", "v"])


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components of ``links`` (a, b: long): one row (node, root) per linked node but the roots, root the component's smallest.

    Every task first turns its own edges into a forest, in a memory of its partition's size. What different tasks
    found out about a node then meets in one group, a row per task at most, and its parents become edges of
    their own, until every node has one parent; parents of parents follow by doubling. A hub's
    edges are rows with the hub as parent, which no step gathers. Raises where ``rounds`` rounds don't suffice.
    """
    spark = links.sparkSession
    kind = "u long, v long"
    edges = links.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v").mapInArrow(_forest, kind)
    for _ in range(rounds):
        parents = edges.groupBy("u").agg(F.collect_set("v").alias("vs"))
        seen = Observation()
        parents = parents.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum((F.size("vs") > 1).cast("long")), F.lit(0)).alias("several"))
        low = F.array_min("vs")
        stars = parents.select(F.explode(F.transform("vs", lambda v: F.struct(F.when(v == low, F.col("u")).otherwise(v).alias("u"), low.alias("v")))).alias("e")).select("e.*")
        edges = stored(stars.mapInArrow(_forest, kind))
        got = seen.get
        if not got["n"]:
            return spark.createDataFrame([], "node long, root long")
        if not got["several"]:
            break
    else:
        raise RuntimeError(f"components not found after {rounds} rounds")
    for _ in range(rounds):
        # only parents that have a parent themselves move, so the rows of a root's children need no join with it
        above = edges.select(F.col("u").alias("p"), F.col("v").alias("w")).join(edges.select(F.col("v").alias("p")).distinct(), "p")
        seen = Observation()
        edges = stored(edges.join(above, F.col("v") == F.col("p"), "left").observe(seen, F.count("w").alias("moved")).select("u", F.coalesce("w", "v").alias("v")))
        if not seen.get["moved"]:
            return edges.toDF("node", "root")
    raise RuntimeError(f"components not found after {rounds} rounds")

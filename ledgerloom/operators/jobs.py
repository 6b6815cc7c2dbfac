"""Queries over job tables: top-k lists, history, counts, progress, versions, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent(jobs: DataFrame, limit: int, at: str, key: str, user: str | None = None, value=None) -> DataFrame:
    """The newest rows, of one user where given; ties by key."""
    owned = jobs.where(F.col(user) == value) if user else jobs
    return owned.orderBy(F.desc(at), F.desc(key)).limit(limit)


def history(jobs: DataFrame, name: str, at: str, key: str, text: str = "", status_col: str | None = None, status: str = "", limit: int = 200) -> DataFrame:
    """Newest jobs whose name contains text (any case), of one status where given."""
    if text:
        jobs = jobs.where(F.lower(name).contains(text.lower()))
    if status_col and status:
        jobs = jobs.where(F.col(status_col) == status)
    return jobs.orderBy(F.desc(at), F.desc(key)).limit(limit)


def status_counts(jobs: DataFrame, by: str, status: str, states: list[str]) -> DataFrame:
    """Per user all jobs and those in each state, in one pass."""
    return jobs.groupBy(by).agg(F.count("*").alias("jobs"), *[F.count_if(F.col(status) == s).alias(f"n_{s.lower()}") for s in states])


def progress(done: Column, total: Column) -> Column:
    """Whole percent done, 0 without any."""
    return F.coalesce(F.floor(100 * done / F.nullif(total, F.lit(0))), F.lit(0)).cast("int")


def batch_progress(batches: DataFrame, jobs: DataFrame, key: str, finished: Column) -> DataFrame:
    """Every batch, empty ones too, with its jobs, how many are finished and the percentage."""
    counted = jobs.groupBy(key).agg(F.count("*").alias("total"), F.count_if(finished).alias("done"))
    joined = batches.join(counted, key, "left").withColumns({"total": F.coalesce("total", F.lit(0)), "done": F.coalesce("done", F.lit(0))})
    return joined.withColumn("percent", progress(F.col("done"), F.col("total")))


def batch_members(batches: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    return batches.join(jobs, key, "left")


def next_version(versions: DataFrame, version: str = "version", active: str = "is_active") -> DataFrame:
    """The registry with all versions inactive and the next one, active, appended."""
    latest = versions.agg((F.coalesce(F.max(version), F.lit(0)) + 1).cast(versions.schema[version].dataType).alias(version)).withColumn(active, F.lit(True))
    return versions.withColumn(active, F.lit(False)).unionByName(latest, allowMissingColumns=True)


def latest_per(rows: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """Per key the values of its greatest row in an order."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(by).agg(best.alias("_b")).select(by, *[F.col(f"_b.{v}").alias(v) for v in values])


def needs_full_retrain(trained: Column, new: Column, every: int = 40) -> Column:
    return F.pmod(trained, F.lit(every)) < new


def trainable(jobs: DataFrame, status: str, used: str, file: str) -> DataFrame:
    """Finished jobs with a file that no training has used."""
    return jobs.where((F.col(status) == "done") & ~F.col(used) & F.col(file).isNotNull())


def owned(rows: DataFrame, user: str, value) -> DataFrame:
    return rows.where(F.col(user) == value)


def without(rows: DataFrame, key: str, value, user: str, owner) -> DataFrame:
    """rows without one document, if the owner asks."""
    return rows.where(~((F.col(key) == value) & (F.col(user) == owner)))


def insert_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those new rows whose key it doesn't have."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in place of those with their key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def navigate(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Foreign-key navigation that keeps rows without a partner."""
    return left.join(right, on, "left")

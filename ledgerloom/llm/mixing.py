"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions

#: A greater mean is the sum of so many independent ones up to this, each with a hash of its own.
BLOCK_MEAN = 64.0


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until the rest is below a hash step (2**-52); rate at most BLOCK_MEAN."""
    if rate <= 0:
        return [1.0]
    p, total, k, out = math.exp(-rate), 0.0, 0, []
    while True:
        total += p
        out.append(total)
        k += 1
        p = p * rate / k
        if k > rate and p < 2.0**-54:
            return out


def source_rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", text_col: str = "text") -> dict[str, float]:
    """Mean repetitions per weighted source, so that expected characters follow the weights and their sum stays.

    At most len(weights) rows reach the driver, and a table of so many rows the tasks.
    """
    if not weights:
        return {}
    named = docs.sparkSession.createDataFrame([(s,) for s in weights], "_source string")
    volumes = docs.select(F.col(source_col).cast("string").alias("_source"), F.char_length(text_col).alias("_n")).join(F.broadcast(named), "_source").groupBy("_source").agg(F.sum("_n").alias("v"))
    got = {r[0]: r[1] or 0 for r in volumes.collect()}
    have = {s: v for s, v in got.items() if v > 0 and weights[s] > 0}
    volume, share = sum(got.values()), sum(weights[s] for s in have)
    return {s: (weights[s] / share) * volume / have[s] if s in have else (1.0 if weights[s] > 0 else 0.0) for s in got}


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def poisson_mix(docs: DataFrame, weights: dict[str, float], seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row of docs as often as its Poisson count says, in a globally shuffled order.

    The count inverts the Poisson distribution of the source's mean repetition rate at a uniform
    number made from md5(seed, doc_id): the same document gets the same count in any run. A rate above BLOCK_MEAN is the sum of
    several draws, which are dealt to different tasks before they are exploded, so no task repeats a row more often than
    a draw of that mean. Columns added (an input column of such a name is replaced): copy (1, 2, ... within each draw, a draw's number times 1000 before it), shuffle_key (hex). Rows are
    dealt to partitions and sorted there by shuffle_key, which is a uniform shuffle without sampling.
    A source without a weight, null among them, keeps the mean rate 1; null or empty texts are kept. A row without an id
    draws by its text; rows repeated with one id draw the same count. Empty tables give no rows.
    """
    rates = source_rates(docs, weights, source_col, text_col)
    blocks = {s: max(1, math.ceil(r / BLOCK_MEAN)) for s, r in rates.items()}
    spark, default = docs.sparkSession, F.array(*[F.lit(c) for c in poisson_cdf(1.0)])
    # a table of the weighted sources, so the plan doesn't grow with their number
    table = spark.createDataFrame([(s, poisson_cdf(r / blocks[s]), blocks[s]) for s, r in rates.items()], "_source string, cdf array<double>, blocks int")
    # the row travels as one struct, so no column of it can clash with those used here
    rest = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text|"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    rows = docs.select(F.struct(*rest).alias("row"), name.alias("id"), F.col(source_col).cast("string").alias("_source")).join(F.broadcast(table), "_source", "left")
    drawn = rows.select("row", "id", F.coalesce("cdf", default).alias("cdf"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    if max(blocks.values(), default=1) > 1:
        drawn = drawn.repartition(partitions(spark), "id", "block")
    # a draw of one block is seeded by the id alone
    at = F.conv(F.substring(_md5(F.lit(seed), "id", F.when(F.col("block") > 0, F.col("block").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    counted = drawn.withColumn("at", at).select("row", "id", "block", F.size(F.filter("cdf", lambda c: c <= F.col("at"))).alias("count"))
    copies = counted.where("count > 0").select("row", "id", "block", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("n"))
    keyed = copies.withColumn("shuffle_key", _md5(F.lit(seed + "-order"), "id", F.col("n").cast("string"), F.when(F.col("block") > 0, F.col("block").cast("string"))))
    # blocks number their copies one after the other, with room for the rarest draw
    copy = (F.col("n") + F.col("block") * 1000).cast("int")
    return keyed.repartition(partitions(spark), "shuffle_key").sortWithinPartitions("shuffle_key").select("row.*", copy.alias("copy"), "shuffle_key")

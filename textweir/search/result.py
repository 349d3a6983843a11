"""Search results: rows (qid, idx, score); as arrays only where a table of queries is written.

Higher scores are better. Equal ones go by idx, so that every result has one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.columns import c
from ..functions.arrays import masked_fill, pad_to_length

LONG = ("qid", "idx", "score")
NEG_INF = float("-inf")
#: Bytes of stored tables for each partition of results.
SHARE = 8 << 20


def by_query(df: DataFrame) -> DataFrame:
    """Rows with a query's results together.

    The number of partitions grows with the stored tables that they come from: with a fixed one, what a task sorts and sums
    up would grow with them. Small tables, and those whose size isn't known, have the session's number.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = sum(x for x in sizes if x < 1 << 62) // SHARE
    return df.repartition(n, "qid") if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition("qid")


def top_k(found: DataFrame, k: int | None) -> DataFrame:
    """The k best of each query with their ranks from 1; each partition keeps k before rows are moved."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "idx")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def sum_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids of both, the scores of each added up, also those of an id that one side has twice; -inf counts like any score."""
    both = a.select(*LONG).unionByName(b.select(*LONG)).filter("idx >= 0")
    return by_query(both).groupBy("qid", "idx").agg(F.sum("score").alias("score"))


def real_min(score: Column) -> Column:
    """Least score that isn't -inf, 0 where there is none; an aggregate."""
    return F.coalesce(F.min(F.when(score > F.lit(NEG_INF), score)), F.lit(0.0))


def merge_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """The ids of both; an id's score is the sum of those it has, or for a side that hasn't got it that side's least for the query.

    Union and one aggregation by id, then one by query: both shuffle on the query alone, so rows move once.
    """
    sides = a.select(*LONG, F.lit(0).alias("side")).unionByName(b.select(*LONG, F.lit(1).alias("side"))).filter("idx >= 0")
    sides = by_query(sides)
    part = lambda s: F.when(F.col("side") == s, F.col("score"))
    per_id = sides.groupBy("qid", "idx").agg(F.sum(part(0)).alias("a"), F.sum(part(1)).alias("b"), F.min(F.when(part(0) > NEG_INF, part(0))).alias("la"), F.min(F.when(part(1) > NEG_INF, part(1))).alias("lb"))
    by = Window.partitionBy("qid")
    least = lambda x: F.coalesce(F.min(x).over(by), F.lit(0.0))
    return per_id.select("qid", "idx", (F.coalesce("a", least("la")) + F.coalesce("b", least("lb"))).alias("score"))


def concat_results(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*LONG).unionByName(b.select(*LONG))


def to_long(df: DataFrame, key: str, idx_col: str, score_col: str) -> DataFrame:
    """Results in arrays as rows; pads (-1) and nulls go."""
    pairs = F.arrays_zip(c(idx_col).cast("array<bigint>"), c(score_col).cast("array<double>")).cast("array<struct<idx:bigint,score:double>>")
    rows = df.select(c(key).alias("qid"), F.explode(pairs).alias("p"))
    return rows.select("qid", c("p")["idx"].alias("idx"), c("p")["score"].alias("score")).filter("idx >= 0")


def to_wide(found: DataFrame, k: int | None, idx_col: str = "idx", score_col: str = "score") -> DataFrame:
    """A row for each query that has results, with arrays from best to worst, padded to k."""
    kept = top_k(found, k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "idx", "score"))).alias("hits"))
    idx, score = c("hits").getField("idx"), c("hits").getField("score").cast("array<double>")
    if k is not None:
        idx, score = padded(idx, score, k)
    return kept.select("qid", idx.alias(idx_col), score.alias(score_col))


def padded(idx: Column, score: Column, k: int | Column) -> tuple[Column, Column]:
    """Cut, or padded with -1 and -inf, to k."""
    return pad_to_length(idx, k, F.lit(-1).cast("bigint")), pad_to_length(score, k, NEG_INF)


def fill_missing(idx: Column, qid: Column, low: int, high: int, seed: int = 0) -> Column:
    """Pads as ids from low to high (excluded), by a hash of query, place and seed; their scores tell them from hits."""
    return masked_fill(idx, lambda v: v < 0, lambda v, i: F.pmod(F.xxhash64(qid, i, F.lit(seed)), F.lit(high - low)) + low)

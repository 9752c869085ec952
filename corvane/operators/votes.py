"""Votes and choices among the attempts of a problem.

Ties go to what was seen first, so every vote carries the attempt's number.
Group keys are the shuffle keys of all of them: votes, best-of choices and
arrays of one group share an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_only(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, majority_answer, majority_count, valid_count, distinct_answers,
    second_count): the most frequent non-null value; ties to the first seen.
    Counted by value before it is gathered by group."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("f"))
    best = F.max_by(F.struct(F.col(value).alias("v"), "c"), F.struct(F.col("c"), -F.col("f")))
    top = per.groupBy(*keys).agg(best.alias("b"), F.sum("c").alias("valid_count"), F.count("*").alias("distinct_answers"), F.slice(F.sort_array(F.collect_list("c"), asc=False), 2, 1).alias("s"))
    return top.select(*keys, F.col("b.v").alias("majority_answer"), F.col("b.c").alias("majority_count"), "valid_count", "distinct_answers", F.coalesce(F.get("s", F.lit(0)), F.lit(0)).cast("bigint").alias("second_count"))


def majority_with_tolerance(df: DataFrame, keys: list[str], value: str, order: str, tolerance: float = 1e-2) -> DataFrame:
    """(keys, majority_value, score): a value's score is how often it occurs
    times how many values of the group lie within ``tolerance``; ties to the
    first seen. Values are counted first: the join is over distinct values."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("f"))
    other = per.select(*keys, F.col(value).alias("_o"), F.col("c").alias("_oc"))
    near = per.join(other, keys).where(F.abs(F.col(value) - F.col("_o")) <= tolerance)
    scored = near.groupBy(*keys, value, "c", "f").agg(F.sum("_oc").alias("n")).withColumn("score", F.col("c") * F.col("n"))
    return scored.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("v"), "score"), F.struct(F.col("score"), -F.col("f"))).alias("b")).select(*keys, F.col("b.v").alias("majority_value"), F.col("b.score").alias("score"))


def clear_winner(votes: DataFrame) -> Column:
    """Whether the first answer has more votes than the second, or is the only
    one; for rows of :func:`majority`."""
    return (F.col("distinct_answers") == 1) | (F.col("majority_count") > F.col("second_count"))


def best_by_priority(df: DataFrame, keys: list[str], conditions: list[Column], order: str) -> DataFrame:
    """One row for each key: of the first condition that any of its rows meets,
    the first such row; ``priority`` is the condition's number, from 1, or one
    more than there are if none is met. A null condition is not met."""
    chain = F.lit(len(conditions) + 1)
    for k in range(len(conditions) - 1, -1, -1):
        chain = F.when(conditions[k], F.lit(k + 1)).otherwise(chain)
    w = Window.partitionBy(*keys).orderBy("priority", order)
    return df.withColumn("priority", chain).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_k(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fan_in(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """(keys, attempts): one array of structs for each key, in order. Groups are
    the attempts of one problem in one run, bounded by the run's best-of."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("attempts"))


def fan_out(df: DataFrame, array: str = "attempts") -> DataFrame:
    """One row for each element, with attempt_number and total_attempts."""
    return df.select("*", F.size(array).alias("total_attempts"), F.posexplode(array).alias("_p", "_e")).withColumn("attempt_number", F.col("_p") + 1)


def success(df: DataFrame, keys: list[str], flag: str = "is_correct") -> DataFrame:
    """(keys, total, correct, incorrect, unknown, all_correct, success_rate)."""
    c = F.count_if(F.col(flag))
    return df.groupBy(*keys).agg(F.count("*").alias("total"), c.alias("correct"), F.count_if(~F.col(flag)).alias("incorrect"), F.count_if(F.col(flag).isNull()).alias("unknown"), (c == F.count("*")).alias("all_correct"), (F.lit(100.0) * c / F.count("*")).alias("success_rate"))

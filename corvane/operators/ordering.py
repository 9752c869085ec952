"""Operators over a total order, without a window in a single task.

Rows are range-partitioned and sorted once, kept as a table, and numbered or
summed within their partition; what lies before a partition is added from one
small row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.store import materialise


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``_part`` and ``_pos``: partition in the order and position
    in it. ``order`` has to be a total order for reproducible results."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    return materialise(rows.withColumn("_part", F.shiftright("_m", 33)).withColumn("_pos", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m"), "ordered")


def _before(rows: DataFrame, aggs: dict[str, tuple[str, str]]) -> DataFrame:
    """(_part, ...): 'sum', 'min' or 'max' of a column over all partitions before
    each; one row a partition."""
    fns = {"sum": F.sum, "min": F.min, "max": F.max}
    per = rows.groupBy("_part").agg(*[fns[kind](c).alias(k) for k, (kind, c) in aggs.items()])
    upto = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_part", *[(F.coalesce(F.sum(k).over(upto), F.lit(0)) if kind == "sum" else fns[kind](k).over(upto)).alias(k) for k, (kind, _) in aggs.items()])


def with_row_number(df: DataFrame, *order: str, name: str = "rn") -> DataFrame:
    """``df`` with a row number from 1 over a total order."""
    rows = ordered(df, *order)
    before = _before(rows.withColumn("_one", F.lit(1)), {"_n": ("sum", "_one")})
    return rows.join(before, "_part").withColumn(name, (F.col("_n") + F.col("_pos") + 1).cast("bigint")).drop("_part", "_pos", "_n")


def running(df: DataFrame, aggs: dict[str, tuple[str, str]], *order: str) -> DataFrame:
    """``df`` with running aggregates over a total order: {name: (kind, column)},
    kind being 'sum', 'min' or 'max'. Null values are passed over."""
    rows = ordered(df, *order)
    before = _before(rows, {f"_b{k}": a for k, a in enumerate(aggs.values())})
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, "_part")
    for k, (name, (kind, c)) in enumerate(aggs.items()):
        b = F.col(f"_b{k}")
        if kind == "sum":
            out = out.withColumn(name, b + F.coalesce(F.sum(c).over(inside), F.lit(0)))
        elif kind == "min":
            out = out.withColumn(name, F.least(b, F.min(c).over(inside)))
        else:
            out = out.withColumn(name, F.greatest(b, F.max(c).over(inside)))
    return out.drop("_part", "_pos", *[f"_b{k}" for k in range(len(aggs))])


def running_sums(df: DataFrame, columns: dict[str, str], *order: str) -> DataFrame:
    """``df`` with running sums over a total order: {new name: column}."""
    return running(df, {k: ("sum", c) for k, c in columns.items()}, *order)


def take_slice(df: DataFrame, start: int | None, stop: int | None, *order: str) -> DataFrame:
    """Rows start..stop-1 of a total order."""
    out = with_row_number(df, *order, name="_rn")
    cond = F.col("_rn") > (start or 0)
    if stop is not None:
        cond = cond & (F.col("_rn") <= stop)
    return out.where(cond).drop("_rn")


def trailing(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows of a total order: a top-n from its other end."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def batches(df: DataFrame, size: int, *order: str, name: str = "batch_no") -> DataFrame:
    """``df`` with the number (from 0) of its batch of ``size`` rows."""
    return with_row_number(df, *order, name="_rn").withColumn(name, F.floor((F.col("_rn") - 1) / size).cast("bigint")).drop("_rn")


def accumulate(per_batch: DataFrame, columns: list[str], batch: str = "batch_no") -> DataFrame:
    """Totals up to and with each batch, beside the batch's own values, named
    ``total_<column>``."""
    return running_sums(per_batch, {f"total_{c}": c for c in columns}, batch)

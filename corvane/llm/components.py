"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import drop_table, materialise


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b); the component is its
    smallest id. Alternating large-star and small-star contraction: each round
    is two aggregations and two joins on the links alone, so a hub is only ever
    reduced by its minimum, never gathered. Links that are null on a side or
    loops are ignored; no links give an empty table. Links that have not come to
    rest after ``max_rounds`` raise an error (rounds grow as the logarithm of the
    longest path)."""
    edges = materialise(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi is not null and lo is not null and hi > lo").distinct(), "cc"
    )
    mark = _mark(edges)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        star = small.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        new = materialise(star, "cc")
        new_mark = _mark(new)
        drop_table(edges)
        edges, mark, old = new, new_mark, mark
        if mark == old:
            break
    else:
        raise RuntimeError(f"components have not come to rest in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of links."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]

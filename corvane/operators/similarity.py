"""Similarity of vectors: blocks of queries against all rows, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cleaned(v: Column) -> Column:
    """NaN as 0, infinities as 1 and -1."""
    return F.transform(v, lambda x: F.when(F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), -1.0).otherwise(x.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of masked token vectors; the mask's sum is at least 1e-9."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    pairs = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(pairs, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / total)


def top_k(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 1024, max_queries: int = 200_000) -> DataFrame:
    """(query_id, vec_id, similarity): the ``k`` nearest rows of each query by
    cosine, clamped to [0, 1], not itself; ties to the smaller id.

    The queries are a stated set whose size is counted first and must not exceed
    ``max_queries``; they go to every task, which keeps ``k`` rows for each query
    from its own rows, by blocks of matrix products: of a block only what reaches
    the k-th best is ranked. Partial lists are merged by query."""
    if queries.count() > max_queries:
        raise ValueError(f"more than {max_queries} queries: run them in blocks")
    rows = queries.where(F.col(vector).isNotNull()).select(id_col, vector).collect()
    spark = df.sparkSession
    qid = np.array([r[0] for r in rows], np.int64)
    q = _unit(np.array([r[1] for r in rows], np.float64)) if len(rows) else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast((qid, q))

    def run(batches):
        ids, qs = sent.value
        n = len(ids)
        who, sim, near = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)  # the best so far, by query
        floor = np.full(n, -1.0)  # similarity of the k-th best so far
        for b in batches:
            keep = ~np.asarray(b.column(1).is_null())
            if not keep.any() or not n:
                continue
            vid = b.column(0).to_numpy()[keep]
            v = _unit(np.array([x for x in b.column(1).to_pylist() if x is not None], np.float64))
            more = []
            for lo in range(0, n, block):
                s = np.round(np.clip(qs[lo : lo + block] @ v.T, 0, 1), 9)
                s[ids[lo : lo + block, None] == vid[None, :]] = -2  # not itself
                least = floor[lo : lo + block]
                if s.shape[1] > k:
                    least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1])
                x, y = np.nonzero((s >= least[:, None]) & (s > -2))
                more.append((x + lo, s[x, y], vid[y]))
            who, sim, near = (np.concatenate([old, *new]) for old, new in zip((who, sim, near), zip(*more)))
            order = np.lexsort((near, -sim, who))
            who, sim, near = who[order], sim[order], near[order]
            first = np.searchsorted(who, np.arange(n))
            rank = np.arange(len(who)) - first[who]
            who, sim, near, rank = (x[rank < k] for x in (who, sim, near, rank))
            floor[who[rank == k - 1]] = sim[rank == k - 1]
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(near), pa.array(sim)], ["query_id", "vec_id", "similarity"])

    part = df.select(F.col(id_col).cast("bigint").alias(id_col), vector).mapInArrow(run, "query_id bigint, vec_id bigint, similarity double")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "vec_id")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.nan_to_num(m, nan=0.0, posinf=1.0, neginf=-1.0)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def group_means(df: DataFrame, group: str = "label", vector: str = "embedding") -> DataFrame:
    """(group, n, centroid_norm): the length of the mean of each group's unit
    vectors, from sums by position: no group is gathered."""
    u = df.where(F.col(vector).isNotNull()).select(group, unit(cleaned(F.col(vector))).alias("u"))
    per = u.select(group, F.posexplode("u").alias("i", "x")).groupBy(group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return per.groupBy(group).agg(F.max("n").alias("n"), F.round(F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.max("n"), 6).alias("centroid_norm"))


def embed(df: DataFrame, text: str, encode, size: int, batch: int = 8, out: str = "embedding") -> DataFrame:
    """``df`` with vectors of ``size`` that ``encode`` (texts -> vectors) gives for
    batches of texts; zeros for a null text and for a batch on which it fails."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        vectors: list[list[float]] = []
        for lo in range(0, len(texts), batch):
            part = texts.iloc[lo : lo + batch]
            try:
                got = encode(part.fillna("").tolist())
                vectors += [[0.0] * size if t is None else [float(x) for x in v] for t, v in zip(part, got, strict=True)]
            except Exception:  # a failed batch counts as zeros, like a text without one
                vectors += [[0.0] * size] * len(part)
        return pd.Series(vectors)

    return df.withColumn(out, run(text))

"""Problem 7: a mixture of sources with target shares of the total size.

Each source's share of the total is laid out first: whole copies of all its
records, and a rest below one copy. The rest is drawn by Pareto order sampling:
records are ranked by random odds divided by inclusion odds, inclusion being in
proportion to size, and the first ones up to the rest's size are taken. The
ranking is never sorted as a whole: sizes are summed over fine buckets of the
rank first, and only the bucket in which a source's rest ends is ordered; the
gap that is left there is filled by the largest later records that fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialise, scratch, source_key

BINS_PER_OCTAVE = 16


@dataclass
class Plan:
    source: str
    weight: float
    repeats: int
    available: int
    target: float
    copies: int
    rest: float
    scale: float


def allocate(available: dict[str, int], weights: dict[str, float], repeats: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Size for each source: its weight's share of ``total``, at most ``repeats``
    times what is available; what capped sources leave goes to the others in
    proportion to their weights. Without ``total``, the largest at which no
    source with records is capped: then every such source meets its weight."""
    live = [s for s in weights if weights[s] > 0 and available.get(s, 0) > 0 and repeats.get(s, 0) > 0]
    caps = {s: float(repeats[s] * available[s]) for s in live}
    if not live:
        return {s: 0.0 for s in weights}
    mass = sum(weights[s] for s in live)
    if total is None:
        total = min(caps[s] * mass / weights[s] for s in live)
    out, open_, left = {s: 0.0 for s in weights}, set(live), float(total)
    while open_:
        mass = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / mass >= caps[s] * (1 - 1e-12)}
        if not full:
            out.update({s: left * weights[s] / mass for s in open_})
            break
        for s in full:
            out[s] = caps[s]
        left -= sum(caps[s] for s in full)
        open_ -= full
    return out


def inclusion_scale(bins: list[tuple[float, int]], rest: float) -> float:
    """k with sum(min(1, k x) x) = rest over (mean size x, count) bins."""
    lo, hi = 0.0, 1.0
    size = lambda k: sum(min(1.0, k * x) * x * n for x, n in bins)
    while size(hi) < rest and hi < 1e12:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if size(mid) < rest else (lo, mid)
    return hi


def mixture(sizes: DataFrame, catalogue: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, copies), shares).

    Options: ``id_col``, ``source`` and ``size`` name the columns, ``total`` is
    the size wanted, ``seed`` draws another sample, ``buckets`` cut the ranks.

    The first has each record that is used and how often; the second, for each
    catalogued source: source, target_weight, max_repeats, available_tokens,
    target_tokens, n_records, actual_tokens, actual_share. The catalogue
    (source, target_weight, max_repeats) is a fixed small table. Records outside
    it, with a null source or id, or without size are not used. Repeated ids
    stand for one record (the largest). No usable record gives empty results.
    Where the next rank would exceed a source's rest, up to ``fillers`` records of
    later ranks follow, each the largest that still fits; a record larger than the
    whole rest is in no sample. A source of the catalogue that stands in it twice
    has the values of one of its rows.
    """
    with scratch(sizes.sparkSession) as tables:
        used, shares = _mixture(sizes, catalogue, **options)
        return tables.keep(used), shares


def _mixture(sizes: DataFrame, catalogue: DataFrame, id_col: str = "doc_id", source: str = "source", size: str = "n_tokens", total: float | None = None, seed: int = 17, buckets: int = 65_536, fillers: int = 3) -> tuple[DataFrame, DataFrame]:
    cat = {r["source"]: r for r in catalogue.select("source", "target_weight", "max_repeats").where("source is not null").collect()}
    names = F.broadcast(catalogue.select(source_key(F.col("source")).alias("_k"), F.col("source").alias("_name")).dropDuplicates(["_k"]))
    rows = sizes.select(F.col(id_col).cast("bigint").alias("doc_id"), source_key(F.col(source)).alias("_k"), F.col(size).cast("bigint").alias("n_tokens")).where("doc_id is not null and n_tokens > 0")
    rows = rows.join(names, "_k").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "_name")).alias("m")).select("doc_id", F.col("m._name").alias("source"), F.col("m.n_tokens").alias("n_tokens"))
    rows = materialise(rows, "sized")
    bins = rows.groupBy("source", F.floor(F.log2("n_tokens") * BINS_PER_OCTAVE).alias("bin")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()  # sources x size classes, whatever the rows
    available: dict[str, int] = {}
    by: dict[str, list[tuple[float, int]]] = {}
    for r in sorted(bins, key=lambda r: (r["source"], r["bin"])):
        available[r["source"]] = available.get(r["source"], 0) + r["t"]
        by.setdefault(r["source"], []).append((r["t"] / r["n"], r["n"]))
    given = allocate(available, {s: float(r["target_weight"] or 0) for s, r in cat.items()}, {s: int(r["max_repeats"] or 0) for s, r in cat.items()}, total)
    plans = []
    for s, r in sorted(cat.items()):
        a, t = available.get(s, 0), given[s]
        whole = int((t + 1e-6) // a) if a else 0
        rest = max(0.0, t - whole * a) if a else 0.0
        plans.append(Plan(s, float(r["target_weight"] or 0), int(r["max_repeats"] or 0), a, t, whole, rest, inclusion_scale(by[s], rest) if rest > 0 else 0.0))
    spark = sizes.sparkSession
    plan = F.broadcast(spark.createDataFrame([(p.source, p.copies, p.rest, p.scale) for p in plans], "source string, whole int, rest double, scale double"))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)
    pi = F.least(F.lit(1.0), F.col("scale") * F.col("n_tokens"))
    odds = (u / (1 - u)) * (1 - pi) / pi
    ranked = rows.join(plan, "source").withColumn("rank", F.when((F.col("rest") > 0) & (F.col("n_tokens") <= F.col("rest")), odds / (1 + odds))).withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)))
    sums = ranked.where("rank is not null").groupBy("source", "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0)))
    cut = starts.where("before < rest and before + t >= rest").groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("c")).select("source", F.col("c.bucket").alias("cut"), F.col("c.before").alias("before"))
    placed = ranked.join(F.broadcast(cut), "source", "left")  # one row a catalogued source
    upto_here = Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # over one bucket of a source
    edge = placed.where("bucket = cut").withColumn("upto", F.col("before") + F.sum("n_tokens").over(upto_here)).where("upto <= rest").select("doc_id", "source", "n_tokens", "upto")
    edge = materialise(edge, "edge")
    gaps = cut.join(plan.select("source", "rest"), "source").join(edge.groupBy("source").agg(F.max("upto").alias("upto")), "source", "left").select("source", (F.col("rest") - F.coalesce("upto", "before")).alias("gap"))
    chosen_edge = edge.select("doc_id")
    later = placed.where("bucket >= cut").select("doc_id", "source", "rank", "n_tokens")
    for _ in range(fillers):  # one record a source and round
        fits = later.join(F.broadcast(gaps), "source").where("n_tokens <= gap").join(chosen_edge, "doc_id", "left_anti")
        best = materialise(fits.groupBy("source").agg(F.max(F.struct("n_tokens", -F.col("rank"), "doc_id")).alias("m")).select("source", F.col("m.doc_id").alias("doc_id"), F.col("m.n_tokens").alias("n")), "filler")
        gaps = gaps.join(best, "source", "left").select("source", (F.col("gap") - F.coalesce("n", F.lit(0))).alias("gap"))
        chosen_edge = chosen_edge.unionByName(best.select("doc_id"))
    chosen = placed.join(chosen_edge.withColumn("_edge", F.lit(1)), "doc_id", "left").withColumn("extra", F.when(F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))), 1).otherwise(F.coalesce("_edge", F.lit(0))))
    used = materialise(chosen.withColumn("copies", (F.col("whole") + F.col("extra")).cast("int")).where("copies > 0").select("doc_id", "source", "n_tokens", "copies"), "mixture")
    got = used.groupBy("source").agg(F.count("*").alias("n_records"), F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"))
    everything = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))
    goals = spark.createDataFrame([(p.source, p.weight, p.repeats, p.available, p.target) for p in plans], "source string, target_weight double, max_repeats int, available_tokens bigint, target_tokens double")
    shares = goals.join(got, "source", "left").na.fill(0, ["n_records", "actual_tokens"])
    return used, shares.withColumn("actual_share", F.when(everything > 0, F.col("actual_tokens") / everything).otherwise(F.lit(0.0)))

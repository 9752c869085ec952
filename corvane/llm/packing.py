"""Problem 6: items of varying length into containers of fixed capacity.

Bounded-space online packing: each partition keeps a fixed number of open
containers, places an item where it fits best, and emits the fullest when it
fits nowhere. What is open at the end is packed again, whole containers as
items, over ever fewer partitions. An item is split only if it exceeds the
capacity: into full containers and one rest.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise, scratch

_OUT = "pack_name string, container string, item string, n bigint, left_open boolean"


def pack_stream(items, capacity: int, open_windows: int):
    """Yields (container number, [(item, size)], filled, whether left open) for
    ``items`` (item, size <= capacity), each once, holding ``open_windows``
    containers at most."""
    room: list[tuple[int, int]] = []  # (free space, container), sorted
    held: dict[int, list] = {}
    number = 0
    for item, size in items:
        k = bisect.bisect_left(room, (size, -1))
        if k < len(room):
            free, c = room.pop(k)
        else:
            if len(room) >= open_windows:
                free, c = room.pop(0)
                yield c, held.pop(c), capacity - free, False
            free, c = capacity, number
            held[c] = []
            number += 1
        held[c].append((item, size))
        if free == size:
            yield c, held.pop(c), capacity, False
        else:
            bisect.insort(room, (free - size, c))
    for free, c in room:
        yield c, held.pop(c), capacity - free, True


def _pack(items: DataFrame, capacities: dict[str, int], parts: int, open_windows: int, round_no: int) -> DataFrame:
    """One round over ``items`` (pack_name, item, n), in the order of a hash."""

    def run(batches):
        part = None

        def stream():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(3)))

        import itertools

        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        for pack, rows in itertools.groupby(stream(), key=lambda r: r[0]):
            out = []
            for c, held, _, left in pack_stream(((r[1], r[2]) for r in rows), capacities[pack], open_windows):
                name = f"{round_no}-{part}-{c}"
                out += [(pack, name, i, n, left) for i, n in held]
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    spread = items.repartition(parts, F.xxhash64("item", "pack_name")).sortWithinPartitions("pack_name", F.xxhash64("item"), "item")
    return spread.select("pack_name", "item", "n").mapInArrow(run, _OUT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())], ["pack_name", "container", "item", "n", "left_open"])


def pack(sizes: DataFrame, capacities: dict[str, int], id_col: str = "doc_id", size: str = "n_tokens", open_windows: int = 64, tokens_per_part: int = 32_000_000, fan_in: int = 32) -> DataFrame:
    """(pack_name, container, doc_id, piece_no, n_tokens) for each capacity.

    Every item is in containers of each pack once, whole unless it exceeds the
    capacity; its pieces are numbered from 0. Items of size 0 are placed like
    others; null sizes count as 0; rows with a null id are dropped; repeated ids
    are items of their own. The number of partitions follows from the total
    size alone, so the result is the same on every cluster. An empty table
    gives none. ``capacities`` is a fixed small mapping.
    """
    with scratch(sizes.sparkSession) as tables:
        return tables.keep(materialise(_packed(sizes, capacities, id_col, size, open_windows, tokens_per_part, fan_in), "packed"))


def _packed(sizes: DataFrame, capacities: dict[str, int], id_col: str, size: str, open_windows: int, tokens_per_part: int, fan_in: int) -> DataFrame:
    rows = sizes.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    rows = materialise(rows.groupBy("doc_id", "n").agg(F.count("*").alias("_m")).withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int")))).select("doc_id", "n", F.col("_c").alias("copy_no")), "sizes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // tokens_per_part))
    packs = F.explode(F.array(*[F.struct(F.lit(k).alias("pack_name"), F.lit(int(v)).cast("bigint").alias("cap")) for k, v in sorted(capacities.items())])).alias("p")
    per = rows.select("*", packs).select("doc_id", "n", "copy_no", "p.pack_name", "p.cap").withColumn("full", F.floor(F.col("n") / F.col("cap")).cast("bigint")).withColumn("rest", F.col("n") % F.col("cap"))
    name = F.concat_ws(":", "doc_id", "copy_no", "n")
    whole = per.where("full > 0").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1))).select("pack_name", F.concat(F.lit("f-"), name, F.lit("-"), F.col("piece_no").cast("string")).alias("container"), "doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.col("cap").alias("n_tokens"))
    item = F.concat_ws(":", "doc_id", "copy_no", F.col("full"))
    rest = per.where("rest > 0 or full = 0").select("pack_name", item.alias("item"), F.col("rest").alias("n"))
    placed = materialise(_pack(rest, capacities, parts, open_windows, 0), "placed")
    moves = None
    left = placed.where("left_open").groupBy("pack_name", "container").agg(F.sum("n").alias("n"))
    round_no = 0
    while True:
        round_no += 1
        parts = -(-parts // fan_in)
        again = materialise(_pack(left.select("pack_name", F.col("container").alias("item"), "n"), capacities, parts, open_windows, round_no), "again")
        step = again.select("pack_name", F.col("item").alias("container"), F.col("container").alias("to"))
        moves = step if moves is None else moves.join(step.withColumnRenamed("container", "_f").withColumnRenamed("to", "_to"), (moves["to"] == F.col("_f")) & (moves["pack_name"] == step["pack_name"]), "left").select(moves["pack_name"], moves["container"], F.coalesce("_to", "to").alias("to"))
        if parts == 1:
            break
        left = again.where("left_open").groupBy("pack_name", "container").agg(F.sum("n").alias("n"))
    key = F.split("item", ":")
    final = placed.join(moves, ["pack_name", "container"], "left").select("pack_name", F.coalesce("to", "container").alias("container"), key[0].cast("bigint").alias("doc_id"), key[2].cast("int").alias("piece_no"), F.col("n").alias("n_tokens"))
    return final.unionByName(whole)


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(pack_name, capacity, n_containers, n_tokens, fill, overflowing)."""
    cap = F.create_map(*[F.lit(x) for k, v in sorted(capacities.items()) for x in (k, int(v))])
    per = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n")).withColumn("capacity", cap[F.col("pack_name")])
    return per.groupBy("pack_name", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("n") > F.col("capacity"), 1).otherwise(0)).alias("overflowing")).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4))

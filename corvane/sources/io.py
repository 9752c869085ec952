"""Scans and sinks: splits, JSON arrays, CSV, partitioned results, sidecars."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.store import new_path

_SLICE = re.compile(r"^(\w+)(?:\[(\d*):(\d*)\])?$")


def parse_slice(spec: str) -> tuple[str, int | None, int | None]:
    """('train', 0, 1000) of 'train[:1000]'; a spec without a colon in its
    brackets is refused."""
    m = _SLICE.match(spec.strip())
    if not m:
        raise ValueError(f"not a split or slice: {spec!r}")
    a, b = m.group(2), m.group(3)
    return m.group(1), (int(a or 0) if a is not None else None), (int(b) if b else None)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A Parquet table, or the ``split=...`` partition of one; where it has no
    such split, its first one."""
    df = spark.read.parquet(path)
    if not split or "split" not in df.columns:
        return df
    wanted = df.where(F.col("split") == split)
    if wanted.isEmpty():
        first = df.agg(F.min("split").alias("s")).first()["s"]
        return df.where(F.col("split") == first)
    return wanted


def read_json_array(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of a file (or glob) that holds one JSON array of objects each; files
    that are no JSON or whose root is not an array of objects give no rows."""
    texts = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"^\s*\["))
    items = texts.select(F.explode(F.from_json("value", "array<string>")).alias("j")).where(F.col("j").rlike(r"^\s*\{"))
    if schema is None:
        path = new_path(spark, "objects")
        items.write.text(path)
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return items.select(F.from_json("j", f"struct<{ddl}>").alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every column is a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """All rows; a column that a table lacks is null in its rows."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def save_results(df: DataFrame, path: str, data_type: str | None = "training", partition: bool = False) -> None:
    """Write rows of one ``data_type`` (all with None), partitioned by it if
    asked."""
    rows = df if data_type is None else df.where(F.col("data_type") == data_type)
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("data_type") if partition else writer).parquet(path)


def timestamped(path: str, now: datetime | None = None) -> str:
    return f"{path.rstrip('/')}_{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, written in parallel; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array with an object a line, non-ASCII text as it is, in one file
    of a folder. Its lines are written in parallel, then one task joins them as a
    stream, so that it holds a line at a time: a sink for what one reader takes."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def lines(parts):
        import pyarrow as pa

        held = None  # a row is followed by a comma if there is another
        yield pa.RecordBatch.from_arrays([pa.array(["["])], ["value"])
        for b in parts:
            rows = b.column(0).to_pylist()
            if rows:
                out = ([] if held is None else [held]) + rows
                held = out.pop()
                yield pa.RecordBatch.from_arrays([pa.array([f"  {j}," for j in out], pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([*([] if held is None else [f"  {held}"]), "]"])], ["value"])

    rows.coalesce(1).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def save_all(path: str, *results: DataFrame) -> None:
    """The results of several runs as one table, by name."""
    union_by_name(*results).write.mode("overwrite").parquet(path)


def append_log(spark: SparkSession, path: str, lines: list[str]) -> None:
    """Add lines of progress to a log kept as text files."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def write_snapshot(statistics: DataFrame, path: str) -> None:
    """Reward statistics as they are now: JSON with nulls, stamped with the time
    of writing."""
    write_json(statistics.withColumn("saved_at", F.current_timestamp()), path)


def settings(spark: SparkSession, defaults: dict[str, str], prefix: str = "spark.corvane.") -> dict[str, str]:
    """Settings of the session under a prefix over their defaults."""
    return {k: spark.conf.get(prefix + k, v) for k, v in defaults.items()}


def table_info(df: DataFrame, name: str) -> str:
    """Sidecar metadata: name, number of rows and schema, as JSON."""
    return json.dumps({"name": name, "num_rows": df.count(), "features": json.loads(df.schema.json())["fields"]}, ensure_ascii=False, indent=2)


def convert(spark: SparkSession, source: str, target: str, source_format: str, target_format: str) -> None:
    """Read one format and write another ('parquet', 'json', 'json_array', 'csv')."""
    readers = {"parquet": spark.read.parquet, "json": spark.read.json, "json_array": lambda p: read_json_array(spark, p), "csv": lambda p: read_csv(spark, p)}
    df = readers[source_format](source)
    if target_format == "json":
        write_json(df, target)
    elif target_format == "json_array":
        write_json_array(df, target)
    elif target_format == "csv":
        df.write.mode("overwrite").option("header", True).csv(target)
    else:
        df.write.mode("overwrite").parquet(target)

"""Problem 5: how many tokens each slice holds under an existing tokenizer.

A count table keyed by content hash and tokenizer hash remembers every text
that was ever encoded; only unseen or changed texts are encoded, once for all
their copies. A cell table (origin, source, language, domain) is kept up to
date by signed deltas: what a row held before is taken off, what it holds now
is added, and rows that are gone are only taken off.
"""

from __future__ import annotations

import base64
import hashlib
import os
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import language_code, materialise, scratch, with_catalogue

TOKENIZERS = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CELL = ["origin", "source", "lang", "domain_name"]


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=16)
def tokenizer_hash(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.md5(f.read()).hexdigest()


def send(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file to the executors, once for each Spark context, for
    those that do not have it at the same place."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_corvane_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)


def local_copy(path: str) -> str:
    """The file on this machine: at its place, or as it was sent."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str = f"{TOKENIZERS}/{DEFAULT_FILE}") -> DataFrame:
    """``keys`` and n_tokens of each row's whole text; null and empty have 0."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    send(df.sparkSession, path)

    def run(batches):
        enc = encoding(local_copy(path))
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(n, pa.int64())], [*keys, "n_tokens"])

    return df.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", n_tokens bigint")


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


@dataclass
class Budget:
    """``counts`` (content, tokenizer, n_tokens), ``rows`` (origin, id, content,
    source, lang, domain_name, n_tokens) and ``cells`` (CELL, n_texts, n_tokens)."""

    counts: DataFrame
    rows: DataFrame
    cells: DataFrame


def empty_budget(spark: SparkSession) -> Budget:
    cell = "origin string, source string, lang string, domain_name string"
    return Budget(
        spark.createDataFrame([], "content string, tokenizer string, n_tokens bigint"),
        spark.createDataFrame([], f"id bigint, content string, n_tokens bigint, {cell}"),
        spark.createDataFrame([], f"{cell}, n_texts bigint, n_tokens bigint"),
    )


def slices(df: DataFrame, id_col: str, text_cols: list[str], catalogue: DataFrame, name: str, source: str = "source", lang: str = "lang") -> DataFrame:
    """(origin, id, text, source, lang, domain_name): one row per text field.
    Sources outside the catalogue are '(other)' of domain '(none)', languages
    that are missing or stand for none '(none)'."""
    base = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source).alias("_source"), language_code(F.col(lang)).alias("_lang"), *[F.col(c).cast("string").alias(f"_t{k}") for k, c in enumerate(text_cols)])
    named = with_catalogue(base, catalogue, "_source")
    fields = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("origin"), F.col(f"_t{k}").alias("text")) for k, c in enumerate(text_cols)])).alias("f")
    return named.select("id", F.coalesce("cat_source", F.lit("(other)")).alias("source"), F.coalesce("_lang", F.lit("(none)")).alias("lang"), F.coalesce("domain_name", F.lit("(none)")).alias("domain_name"), fields).select("f.origin", "id", "f.text", "source", "lang", "domain_name")


def update(before: Budget, texts: DataFrame, path: str = f"{TOKENIZERS}/{DEFAULT_FILE}") -> Budget:
    """The budget after the collection has become ``texts`` (see :func:`slices`).

    A row is known by (origin, id). Repeated ids are rows of their own: their
    cells are counted each. A null text counts as empty, with 0 tokens. The
    result equals that of an update from nothing."""
    with scratch(texts.sparkSession) as tables:
        mark = tokenizer_hash(path)
        now = texts.withColumn("content", content_hash(F.col("text")))
        known = before.counts.where(F.col("tokenizer") == mark).select("content", "n_tokens")
        unseen = now.where("text is not null and text <> ''").join(known, "content", "left_anti").dropDuplicates(["content"])
        fresh = count_tokens(unseen, ["content"], "text", path).withColumn("tokenizer", F.lit(mark)).select("content", "tokenizer", "n_tokens")
        counts = materialise(before.counts.unionByName(fresh), "counts")
        sized = counts.where(F.col("tokenizer") == mark).select("content", "n_tokens")
        rows = materialise(now.drop("text").join(sized, "content", "left").na.fill(0, ["n_tokens"]).select("id", "content", "n_tokens", *CELL), "rows")
        old, new = before.rows.withColumn("sign", F.lit(-1)), rows.withColumn("sign", F.lit(1))
        deltas = old.unionByName(new).groupBy("id", "content", "n_tokens", *CELL).agg(F.sum("sign").alias("sign")).where("sign <> 0")
        change = deltas.groupBy(*CELL).agg(F.sum("sign").cast("bigint").alias("n_texts"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("n_tokens"))
        cells = before.cells.unionByName(change).groupBy(*CELL).agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens")).where("n_texts <> 0")
        return Budget(tables.keep(counts), tables.keep(rows), tables.keep(materialise(cells, "cells")))


def totals(cells: DataFrame) -> DataFrame:
    """The cube of the cells over source, language and domain; '(all)' stands
    for all of a dimension. Runs over cells, not over rows."""
    cube = cells.cube("source", "lang", "domain_name").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"), F.grouping("domain_name").alias("gd"))
    return cube.select(*[F.when(F.col(g) == 1, F.lit("(all)")).otherwise(F.col(c)).alias(c) for c, g in (("source", "gs"), ("lang", "gl"), ("domain_name", "gd"))], "n_texts", "n_tokens")

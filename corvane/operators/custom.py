"""Places where a caller's Python runs: generators, per-row pipelines and
rewards over groups, always in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def generate(df: DataFrame, prompt: str, complete: Callable[[list[str]], list[str | None]], out: str = "model_solution", batch: int = 64) -> DataFrame:
    """``df`` with ``out``: what ``complete`` gives for each prompt, called with
    at most ``batch`` prompts. A call that raises fails its task, which Spark
    tries again elsewhere."""
    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            answers: list[str | None] = []
            for k in range(0, len(pdf), batch):
                answers += complete(pdf[prompt].iloc[k : k + batch].tolist())
            yield pdf.drop(columns=[out], errors="ignore").assign(**{out: answers})

    return df.mapInPandas(run, ", ".join([*cols, f"`{out}` string"]))


def expand(df: DataFrame, process: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """The rows that ``process`` makes of each row: none, one or many."""
    names = [c.strip().split()[0].strip("`") for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [r for row in pdf.to_dict("records") for r in process(row)]
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(run, schema)


def score_groups(df: DataFrame, keys: list[str], index: str, score: Callable[[pd.DataFrame], list[float]], out: str = "reward") -> DataFrame:
    """(keys, index, out): ``score`` sees the rows of one group (the completions
    of a prompt, bounded by how many are drawn) in the order of ``index`` and
    gives a number for each."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, index]), f"`{out}` double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index)
        return pdf[[*keys, index]].assign(**{out: [float(x) for x in score(pdf)]})

    return df.groupBy(*keys).applyInPandas(run, schema)

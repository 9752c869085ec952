"""Column aliases, text predicates and the filter waterfall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X


def pick(df: DataFrame, *names: str) -> Column:
    """The first non-null of the columns that exist, as a string."""
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def normalise_aliases(df: DataFrame, default_source: str = "unknown") -> DataFrame:
    """(id, problem, solution, source, answer): problem or question; answer or
    correct_answer; rows without a problem or a solution are dropped."""
    out = df.select(F.col("id"), pick(df, "problem", "question").alias("problem"), pick(df, "solution").alias("solution"), F.coalesce(pick(df, "source"), F.lit(default_source)).alias("source"), pick(df, "answer", "correct_answer").alias("answer"))
    return out.where("problem is not null and solution is not null")


def normalise_validation(df: DataFrame) -> DataFrame:
    """(id, problem, solution, source, answer) of validation records: as strings,
    what is missing or empty in one column is taken from its alias, and is '' if
    that has none either; no row is dropped."""

    def either(*names: str) -> Column:
        have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*have, F.lit(""))

    return df.select("id", either("problem", "question").alias("problem"), either("solution").alias("solution"), either("source").alias("source"), either("answer", "correct_answer").alias("answer"))


def waterfall(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """``df`` with ``reason``: the first rule a row falls under, null for rows
    that stay. One expression, one pass; rules are tried in order."""
    chain = F.lit(None).cast("string")
    for name, cond in reversed(rules):
        chain = F.when(cond, F.lit(name)).otherwise(chain)
    return df.withColumn("reason", chain)


def standard_rules(max_length: int = 2000) -> list[tuple[str, Column]]:
    """Rules over problem, solution and answer, the cheap ones first."""
    p, s = F.col("problem"), F.col("solution")
    got = X.boxed_answer(s)
    boxes = X.count_boxed(s)
    return [
        ("too_long", F.length(p) > max_length),
        ("multiple_choice", X.is_multiple_choice(p)),
        ("no_boxed", boxes == 0),
        ("multiple_boxed", boxes > 1),
        ("invalid_problem", X.invalid_content(p) != ""),
        ("invalid_solution", X.invalid_content(s) != ""),
        ("empty_answer", F.coalesce(got, F.lit("")) == ""),
        ("not_numeric", N.numeric_value(got).isNull()),
    ]


def report(tagged: DataFrame) -> DataFrame:
    """(reason, n): '(kept)' for the rows that stay."""
    return tagged.groupBy(F.coalesce("reason", F.lit("(kept)")).alias("reason")).agg(F.count("*").alias("n"))


def reduction(tagged: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("reason").isNull())
    return tagged.agg(F.count("*").alias("original"), kept.alias("kept"), F.round(F.try_divide(F.lit(100.0) * (F.count("*") - kept), F.count("*")), 1).alias("reduction_pct"))


def equals_rule(c: Column) -> Column:
    """The answer, its right side if it has one equals sign, null if more."""
    n = F.regexp_count(c, F.lit("="))
    return F.when(n >= 2, None).when(n == 1, X.strip(F.split_part(c, F.lit("="), F.lit(2)))).otherwise(c)


def include(df: DataFrame, keys: DataFrame, column: str = "problem") -> DataFrame:
    """Rows whose column is in a list; null never is. The list's size decides
    how it is joined (the planner's thresholds)."""
    return df.join(keys.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, column: str = "problem") -> DataFrame:
    """Rows whose column is not in a list; null stays."""
    return df.join(keys.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_anti")

"""Run-level statistics: one row for each problem of a run, then one global
aggregate (two passes where a mean of the run is compared with)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stat_rows(attempts: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total_solutions, correct_solutions, is_most_common_correct,
    success_rate): ``votes`` from :func:`corvane.operators.votes.majority`. The
    most common answer is correct if an attempt with it is."""
    marked = attempts.join(votes.select(*keys, "majority_answer"), keys, "left")
    hit = F.coalesce(F.bool_or(F.col("is_correct") & (F.col("model_answer") == F.col("majority_answer"))), F.lit(False))
    c = F.count_if("is_correct")
    return marked.groupBy(*keys).agg(F.count("*").alias("total_solutions"), c.alias("correct_solutions"), hit.alias("is_most_common_correct"), (F.lit(100.0) * c / F.count("*")).alias("success_rate"))


def ratio(a: Column, b: Column, scale: float = 100.0, digits: int = 6) -> Column:
    """scale * a / b rounded, 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(F.lit(scale) * a, b), F.lit(0.0)), digits)


def run_statistics(stats: DataFrame) -> DataFrame:
    """One row over stat rows: totals, pass@k, averages, most common answers and
    how many problems are above the average of those with any correct one."""
    # Counts of equal rows first: they are few (bounded by the most attempts a problem has), so that the stat rows are read and computed once.
    c, k = F.col("correct_solutions"), F.col("_k")
    per = stats.groupBy(c, F.coalesce("is_most_common_correct", F.lit(False)).alias("_m")).agg(F.count("*").alias("_k"), F.sum("total_solutions").alias("_t"))
    whole = Window.partitionBy(F.lit(1))
    s, n = F.sum(F.when(c > 0, c * k)).over(whole), F.sum(F.when(c > 0, k)).over(whole)
    some = lambda cond: F.coalesce(F.sum(F.when(cond, k)), F.lit(0))
    total = F.coalesce(F.sum(k), F.lit(0))
    return per.withColumn("_above", (c > 0) & (c * n > s)).agg(
        total.alias("total"), F.sum("_t").alias("attempts"), F.sum(c * k).alias("correct"), some(c > 0).alias("at_least_one"), ratio(some(c > 0), total).alias("pass_rate"),
        ratio(F.sum(c * k), total, 1.0).alias("avg_correct"), some(F.col("_m")).alias("most_common_correct"), some(F.col("_above")).alias("above_average"),
    )


def above_average(stats: DataFrame, keys: list[str], count: str = "correct_solutions") -> DataFrame:
    """The rows whose count exceeds the mean of the positive counts; the mean is
    one row, joined to all."""
    mean = stats.where(F.col(count) > 0).agg(F.sum(count).alias("_s"), F.count("*").alias("_n"))
    return stats.join(mean).where(F.col(count) * F.col("_n") > F.col("_s")).select(*keys, count)


def integer_histogram(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """(bin_no, low, high, n): width max(1, (max - min) div bins), left-closed,
    the last edge inclusive. Edges come from a one-row aggregate."""
    edge = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")).withColumn("_w", F.greatest(F.lit(1), F.expr(f"(_hi - _lo) div {bins}")))
    k = F.least(F.expr(f"({column} - _lo) div _w"), F.expr("greatest((_hi - _lo) div _w - if((_hi - _lo) % _w = 0, 1, 0), 0)"))
    return df.where(F.col(column).isNotNull()).join(edge).withColumn("bin_no", k).groupBy("bin_no", (F.col("_lo") + F.col("bin_no") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin_no") + 1) * F.col("_w") - 1).alias("high")).agg(F.count("*").alias("n"))


def dynamic_histogram(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """(bin_no, label, n): equal widths from min - 0.001 to max + 0.001, widened
    by 0.1 on both sides when the range is below 0.01; the label is the lower
    edge with two digits, beside the number, so that labels cannot merge bins."""
    e = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    narrow = (F.col("_b") - F.col("_a")) < 0.01
    e = e.select((F.col("_a") - F.when(narrow, 0.1).otherwise(0.001)).alias("_lo"), (F.col("_b") + F.when(narrow, 0.1).otherwise(0.001)).alias("_hi"))
    k = F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("bigint")
    return df.where(F.col(column).isNotNull()).join(e).withColumn("bin_no", k).withColumn("label", F.round(F.col("_lo") + F.col("bin_no") * (F.col("_hi") - F.col("_lo")) / bins, 2)).groupBy("bin_no", "label").agg(F.count("*").alias("n"))


def merge_counts(df: DataFrame, column: str) -> DataFrame:
    """(key, n): maps of counts merged by key."""
    return df.select(F.explode(column).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))


def test_verdicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, timeouts, errors) of test functions from their outcomes
    ('True', 'False', 'Timeout...', 'ERROR...') on cases of which some are the
    right one (``right_case``): a function has to accept every right case and no
    wrong one; timeouts and errors on wrong cases are no acceptance, and are told
    apart where there is nothing else."""
    right, o = F.col("right_case"), F.col("outcome")
    verdict = (
        F.when(F.count_if(right) == 0, "no_correct_case").when(F.count_if(right & (o != "True")) > 0, "rejects_correct").when(F.count_if(~right & (o == "True")) > 0, "accepts_wrong")
        .when((F.count_if(~right & (o == "False")) == 0) & (F.count_if(~right) > 0), "only_errors").otherwise("ok")
    )
    return df.groupBy(*keys).agg(verdict.alias("verdict"), F.count_if(o.startswith("Timeout")).alias("timeouts"), F.count_if(o.startswith("ERROR")).alias("errors"))


def transitions(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: improved, worsened, kept_right, kept_wrong; null is false."""
    b, a = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return df.agg(F.count_if(~b & a).alias("improved"), F.count_if(b & ~a).alias("worsened"), F.count_if(b & a).alias("kept_right"), F.count_if(~b & ~a).alias("kept_wrong"))


def quality_change(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: how many values there are, their means, and in how many of the
    rows that have both the later one is larger or smaller."""
    a, b = F.col(before), F.col(after)
    return df.agg(
        F.count(a).alias("n_initial"), F.count(b).alias("n_final"), F.round(F.avg(a), 6).alias("avg_initial"), F.round(F.avg(b), 6).alias("avg_final"),
        F.count_if(b > a).alias("improved"), F.count_if(b < a).alias("worsened"), F.count_if(a.isNotNull() & b.isNotNull()).alias("pairs"),
    )


def two_models(df: DataFrame, key: str, first: Column, second: Column) -> DataFrame:
    """One row comparing the correct counts of two models per problem."""
    a, b = F.col("a"), F.col("b")
    per = df.groupBy(key).agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    return per.agg(
        F.count("*").alias("problems"), F.sum(a).alias("first_correct"), F.sum(b).alias("second_correct"), F.count_if((a > 0) & (b > 0)).alias("both"), F.count_if((a == 0) & (b == 0)).alias("neither"),
        F.count_if((a > 0) != (b > 0)).alias("disagree"), F.count_if((a > 0) & (b == 0)).alias("first_better"), F.count_if((a == 0) & (b > 0)).alias("second_better"),
        ratio(F.count_if((a > 0) & (b == 0)), F.count_if((a > 0) != (b > 0))).alias("first_win_rate"),
    )


def _given(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def matches(df: DataFrame) -> Column:
    """Flags of a problem's solutions: ``initial_correctness``, else
    ``is_correct_list``, else ``is_correct`` alone, else none; columns that are
    not there count as null."""
    one = F.when(_given(df, "is_correct", "boolean").isNotNull(), F.array(_given(df, "is_correct", "boolean")))
    return F.coalesce(_given(df, "initial_correctness", "array<boolean>"), _given(df, "is_correct_list", "array<boolean>"), one, F.array().cast("array<boolean>"))


def _true(flags: Column) -> Column:
    return F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0))


def before_and_after(df: DataFrame) -> DataFrame:
    """One row over statistics rows (any of initial_correctness,
    final_correctness, is_correct_list, is_correct, is_most_common_correct,
    most_common_correct, initial_majority_correct, final_majority_correct):
    problems and their correct solutions, the vote before and after with the
    older one-vote flags counted to both, and totals of both sides."""
    flag = lambda c: F.coalesce(_given(df, c, "boolean"), F.lit(False))
    a, b = _given(df, "initial_correctness", "array<boolean>"), _given(df, "final_correctness", "array<boolean>")
    both, older = flag("is_most_common_correct"), flag("most_common_correct")
    size = lambda c: F.sum(F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)))
    n, hits = F.count("*"), _true(matches(df))
    votes = lambda side: F.sum(F.when(both, 1).otherwise(flag(side).cast("int") + older.cast("int")))
    return df.agg(
        n.alias("total"), F.count_if(hits > 0).alias("at_least_one"), F.sum(hits).alias("total_correct"), ratio(F.sum(hits), n, 1.0).alias("avg_correct"),
        votes("initial_majority_correct").alias("initial_most_common_correct"), votes("final_majority_correct").alias("final_most_common_correct"),
        size(a).alias("total_initial_solutions"), F.sum(_true(a)).alias("total_initial_correct"), ratio(F.sum(_true(a)), size(a)).alias("overall_initial_success_rate"),
        F.count_if(_true(a) > 0).alias("examples_with_at_least_one_correct"), ratio(F.count_if(_true(a) > 0), n).alias("examples_with_at_least_one_correct_rate"),
        F.count_if(flag("initial_majority_correct")).alias("initial_majority_correct_count"), ratio(F.count_if(flag("initial_majority_correct")), n).alias("initial_majority_correct_rate"),
        size(b).alias("total_final_solutions"), F.sum(_true(b)).alias("total_final_correct"), ratio(F.sum(_true(b)), size(b)).alias("overall_final_success_rate"),
        F.count_if(flag("final_majority_correct")).alias("final_majority_correct_count"), ratio(F.count_if(flag("final_majority_correct")), n).alias("final_majority_correct_rate"),
    )


def step_report(df: DataFrame) -> DataFrame:
    """One row over step statistics, each of a single solution (wrong_step_found,
    wrong_step_index, total_steps, completion_score, unsalvageable) or of several
    (wrong_steps_found, avg_wrong_step_position, avg_completion_score,
    unsalvageable_solutions), with the rates of sections found: counts and flags
    add up, and means run over both kinds of positions."""
    g = lambda c, kind="double": _given(df, c, kind)
    flag = lambda c: F.coalesce(g(c, "boolean"), F.lit(False)).cast("int")
    place = F.when((g("wrong_step_index", "int") >= 0) & (g("total_steps", "int") > 0), g("wrong_step_index", "int") / g("total_steps", "int"))
    means = g("avg_wrong_step_position")
    value = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    score = F.coalesce(g("avg_completion_score"), g("completion_score"))
    return df.agg(
        F.sum(F.coalesce(g("wrong_steps_found", "int"), flag("wrong_step_found"))).alias("wrong_steps_found"),
        F.round(F.try_divide(value(means) + value(place), F.count(means) + F.count(place)), 6).alias("avg_wrong_step_position"),
        F.round(F.avg(score), 6).alias("avg_completion_score"),
        F.sum(F.coalesce(g("unsalvageable_solutions", "int"), flag("unsalvageable"))).alias("unsalvageable_solutions"),
        F.round(F.avg(g("thinking_extraction_rate")), 6).alias("thinking_extraction_rate"), F.round(F.avg(g("response_extraction_rate")), 6).alias("response_extraction_rate"),
    )


def top_by_count(df: DataFrame, column: str, k: int, first: str) -> DataFrame:
    """(column, n): the ``k`` most frequent values, ties to the first seen."""
    per = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(first).alias("_f"))
    return per.orderBy(F.col("n").desc(), "_f").limit(k).select(column, "n")

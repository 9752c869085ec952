"""Per-problem pipelines: each composes extraction, checks, votes and choices
over attempts whose outcomes (what a program, test or judge found) are columns.

Input rows have: id, n (attempt), completion, answer, value, is_correct,
test_passed, verified. Each pipeline gives one row for each problem.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X
from corvane.operators import votes as V
from corvane.operators.runstats import ratio, test_verdicts
from corvane.sources.store import materialise

KEY = ["id"]


def _counts(df: DataFrame) -> DataFrame:
    c = F.count_if("is_correct")
    return df.groupBy(*KEY).agg(F.count("*").alias("total"), c.alias("correct"), ratio(c, F.count("*")).alias("success_rate"))


def standard(df: DataFrame, answered: bool = False) -> DataFrame:
    """Answers of the responses, their vote and whether it is right, and thinking
    lengths. With ``answered`` the rows bring ``model_answer``."""
    a = df if answered else df.withColumn("model_answer", X.answer(F.col("completion")))
    a = a.withColumn("tl", X.thinking_length(F.col("completion")))
    v = V.majority(a, KEY, "model_answer", "n").select("id", "majority_answer", "majority_count")
    hit = a.join(v, KEY).groupBy(*KEY).agg(F.coalesce(F.bool_or(F.col("is_correct") & (F.col("model_answer") == F.col("majority_answer"))), F.lit(False)).alias("majority_correct"))
    t = a.groupBy(*KEY).agg(F.round(F.avg("tl"), 6).alias("avg_thinking"), F.round(F.coalesce(F.avg(F.when(F.col("is_correct"), F.col("tl"))), F.lit(0.0)), 6).alias("avg_thinking_correct"))
    return _counts(a).join(v, "id", "left").join(hit, "id", "left").join(t, "id")


def _usable_vote(df: DataFrame, tolerance: float) -> DataFrame:
    """(id, majority_value, score, majority_correct): vote with tolerance over the
    values of usable programs."""
    ok = X.let(X.code_with_fallback(F.col("completion")), lambda c: (c != "") & ~X.has_code_problems(c) & X.computes(c))
    usable = materialise(df.where(ok).select(*KEY, "n", "value", "is_correct"), "usable")  # texts are read once; the votes run over numbers
    v = V.majority_with_tolerance(usable, KEY, "value", "n", tolerance)
    near = usable.join(v, KEY).groupBy(*KEY).agg(F.bool_or(F.col("is_correct") & (F.abs(F.col("value") - F.col("majority_value")) <= tolerance)).alias("majority_correct"))
    return v.join(near, "id", "left")


def programming(df: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """Counts of right attempts, and the vote over usable programs."""
    return _counts(df).join(_usable_vote(df, tolerance), "id", "left")


def test_functions(df: DataFrame) -> DataFrame:
    """A test function passes if it accepts the correct case and no wrong one."""
    ok = F.col("test_passed") & ~F.col("verified")
    return df.groupBy(*KEY).agg(F.count("*").alias("total"), F.count_if(ok).alias("passing"), F.bool_or(ok).alias("any_passing"), F.count_if(F.col("test_passed") & F.col("verified")).alias("accepts_wrong"))


def programmer_and_test(df: DataFrame) -> DataFrame:
    """Vote of all values, then of those whose test passed, else of all; whether
    each equals the answer within tolerance; and how many attempts are right and
    passed their test."""
    first = V.majority(df, KEY, "value", "n").select("id", F.col("majority_answer").alias("initial_answer"), ratio(F.col("majority_count"), F.col("valid_count")).alias("initial_pct"))
    second = V.majority(df.where("test_passed"), KEY, "value", "n").select("id", F.col("majority_answer").alias("verified_answer"))
    both = df.groupBy(*KEY).agg(F.count_if(F.col("is_correct") & F.col("test_passed")).alias("n_both"), F.max("answer").alias("_want"))
    out = first.join(second, "id", "left").join(both, "id").withColumn("final_answer", F.coalesce("verified_answer", "initial_answer"))
    right = lambda c: N.same_value(F.col(c).cast("string"), F.col("_want"))
    return out.select("id", "initial_answer", "initial_pct", "final_answer", F.col("verified_answer").isNull().alias("fell_back"), right("initial_answer").alias("initial_correct"), right("final_answer").alias("final_correct"), "n_both")


def tutor(df: DataFrame) -> DataFrame:
    """Where no answer wins clearly, an attempt whose verdict is negative and
    whose response states an answer is taken as corrected."""
    v = V.majority(df, KEY, "value", "n")
    gate = v.select("id", V.clear_winner(v).alias("has_clear_winner"))
    a = df.join(gate, "id").withColumn("negative", ~F.coalesce(X.says_answer_is_correct(X.tag_by_position(F.col("completion"), "verdict")), F.lit(False)))
    fixed = ~F.col("has_clear_winner") & F.col("negative") & X.answer(F.col("completion")).isNotNull()
    final = F.when(fixed, X.answer(F.col("completion")) == F.col("answer")).otherwise(F.col("is_correct"))
    return a.withColumn("fixed", fixed).withColumn("final", final).groupBy("id", "has_clear_winner").agg(F.count_if("fixed").alias("fixed"), F.count_if("is_correct").alias("initial_correct"), F.count_if("final").alias("final_correct"), (F.count_if("final") > F.count_if("is_correct")).alias("improved"))


#: Fixed value: the guidance that stands in where an engineer's text has no response section.
DEFAULT_GUIDANCE = "Please solve this problem using appropriate Python libraries and techniques."


def architect(df: DataFrame, tolerance: float = 1e-2) -> DataFrame:
    """Attempts of a plan and a program each: the guidance handed on (a default
    where the plan has none), two role rows, the vote of all values, and that of
    usable programs with tolerance."""
    c = F.col("completion")
    guidance = F.coalesce(X.response(c), F.lit(DEFAULT_GUIDANCE))
    sizes = df.groupBy("id").agg(
        (2 * F.count("*")).alias("n_roles"), F.sum(F.length(c)).alias("plan_chars"), F.sum(F.length(X.code(c))).alias("code_chars"),
        F.sum(F.length(guidance)).alias("guidance_chars"), F.count_if(X.response(c).isNull()).alias("without_guidance"),
    )
    v = V.majority(df, KEY, "value", "n").select("id", "majority_answer")
    return sizes.join(v, "id", "left").join(_usable_vote(df, tolerance), "id", "left")


def dual_source(df: DataFrame) -> DataFrame:
    """Adds proof_ok, code_ok and answer_source for proof and code answers."""
    c = F.col("completion")
    p, k = X.tag_body(c, "proof").isNotNull(), X.tag_body(c, "code").isNotNull()
    ok = F.col("is_correct")
    source = (
        F.when(p & k & F.col("verified") & ok, "matching").when(p & k & F.col("verified"), "matching_incorrect").when(k & ok, "code_fallback").when(p & ok, "proof_fallback")
        .when(k, "code_fallback_incorrect").when(p, "proof_fallback_incorrect").otherwise("invalid_solution")
    )
    return df.withColumn("proof_ok", p & ok).withColumn("code_ok", k & ok).withColumn("answer_source", source)


def _with_vote(per: DataFrame, df: DataFrame) -> DataFrame:
    """``per`` (with _want) and majority_correct: whether the vote equals the
    answer within tolerance."""
    v = V.majority(df, KEY, "value", "n").select("id", "majority_answer")
    right = N.same_value(F.col("majority_answer").cast("string"), F.col("_want"))
    return per.join(v, "id", "left").withColumn("majority_correct", F.when(F.col("majority_answer").isNotNull(), right)).drop("_want", "majority_answer")


def dual_proof(df: DataFrame) -> DataFrame:
    a = dual_source(df)
    best = V.best_by_priority(a, KEY, [F.col("proof_ok") & F.col("code_ok"), F.col("code_ok"), F.col("proof_ok"), F.col("answer_source").startswith("matching")], "n").select("id", F.col("n").alias("best_attempt"), "priority", "answer_source")
    per = a.groupBy(*KEY).agg(F.count_if("proof_ok").alias("proofs_ok"), F.count_if("code_ok").alias("codes_ok"), F.max("answer").alias("_want")).join(best, "id")
    return _with_vote(per, df)


def test_driven(df: DataFrame) -> DataFrame:
    c, ok = F.col("completion"), F.col("is_correct")
    t, i = X.tag_body(c, "test").isNotNull(), X.tag_body(c, "implementation").isNotNull()
    source = F.when(~i, "invalid_solution").when(t & F.col("test_passed") & ok, "verified_implementation").when(ok, "implementation_fallback").otherwise("implementation_fallback_incorrect")
    a = df.withColumn("impl_ok", i & ok).withColumn("test_ok", t & F.col("test_passed")).withColumn("answer_source", source)
    best = V.best_by_priority(a, KEY, [F.col("impl_ok") & F.col("test_ok"), F.col("impl_ok"), F.col("test_ok")], "n").select("id", F.col("n").alias("best_attempt"), "priority", "answer_source")
    per = a.groupBy(*KEY).agg(F.count_if("impl_ok").alias("impl_ok"), F.count_if("test_ok").alias("test_ok"), F.count_if(F.col("impl_ok") & F.col("test_ok")).alias("both_ok"), F.max("answer").alias("_want")).join(best, "id")
    return _with_vote(per, df)


def step_statistics(found: DataFrame) -> DataFrame:
    """One row over rows of :func:`steps`: how many wrong steps were found, where
    on average, and how many solutions were recovered before the end."""
    w = F.col("wrong_step").isNotNull()
    return found.agg(
        F.count("*").alias("problems"), F.count_if(w).alias("wrong_steps_found"), F.round(F.avg(F.when(w, F.try_divide("wrong_step", "total_steps"))), 6).alias("avg_wrong_step_position"),
        F.count_if(F.col("total_steps") < 2).alias("unsalvageable"), ratio(F.count_if(w & (F.col("wrong_step") > 0)), F.count_if(w)).alias("recovery_rate"), F.round(F.avg("completion_score"), 6).alias("avg_completion_score"),
    )


def steps(df: DataFrame) -> DataFrame:
    """First wrong step of each problem's flags, its place and how much of the
    solution stands before it."""
    v = V.fan_in(df.withColumn("ok", F.col("is_correct") | F.col("verified")), KEY, "n", "ok").select("id", F.transform("attempts", lambda x: x["ok"]).alias("v"))
    w = v.select("id", F.size("v").alias("total_steps"), X.first_wrong_step(F.col("v")).cast("int").alias("wrong_step"))
    place = F.when(F.col("wrong_step").isNotNull(), X.position_category(F.col("wrong_step"), F.col("total_steps")))
    return w.select("id", "total_steps", "wrong_step", place.alias("position_category"), F.round(F.try_divide("wrong_step", "total_steps"), 6).alias("completion_score"))


def wrong_attempts(df: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """(keys, n_wrong, n_unsalvageable, first_usable, reasons): of the first ``k``
    wrong attempts of each problem, how many cannot be searched for a wrong step
    and why, and the first that can. ``df`` has keys, attempt_number, completion
    and is_correct."""
    first = V.first_k(df.where(~F.col("is_correct") & F.col("completion").isNotNull()), keys, "attempt_number", k).withColumn("reason", X.unsalvageable(F.col("completion")))
    bad = F.col("reason").isNotNull()
    return first.groupBy(*keys).agg(
        F.count("*").alias("n_wrong"), F.count_if(bad).alias("n_unsalvageable"), F.min(F.when(~bad, F.col("attempt_number"))).alias("first_usable"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )


def step_problem(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row a problem over its searched wrong attempts: ``df`` has keys,
    wrong_step and total_steps (null where none was found) and reason (null where
    the attempt could be searched). Distributions are maps by category and reason."""
    found, bad, n = F.col("wrong_step").isNotNull(), F.col("reason").isNotNull(), F.count("*")
    place = F.when(found, F.try_divide("wrong_step", "total_steps"))

    def distribution(c: Column) -> Column:
        values = F.collect_list(c)  # of at most the searched attempts of a problem
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(values)), lambda x: F.struct(x, F.size(F.filter(values, lambda y: y == x)))))

    category = F.when(found, X.position_category(F.col("wrong_step"), F.col("total_steps")))
    return df.groupBy(*keys).agg(
        F.count_if(found).alias("wrong_steps_found"), F.round(F.coalesce(F.avg(place), F.lit(0.0)), 6).alias("avg_wrong_step_position"), distribution(category).alias("position_distribution"),
        ratio(F.count_if(found), n, 1.0).alias("recovery_success_rate"), F.count_if(bad).alias("unsalvageable_solutions"), ratio(F.count_if(bad), n, 1.0).alias("unsalvageable_rate"), distribution(F.col("reason")).alias("unsalvageable_reasons"),
    )


def test_cases(df: DataFrame, outcome: Column) -> DataFrame:
    """(id, verdict, timeouts, errors) of test functions: ``df`` (id, correct, ...)
    is laid out to one row for each case, the right one and the wrong ones of
    :func:`numeric.wrong_cases`, with right_case and test_case; ``outcome`` is what
    the function said of it."""
    rows = df.withColumn("_w", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("r"), F.col("correct").alias("v"))), F.transform(N.wrong_cases(F.col("correct")), lambda v: F.struct(F.lit(False).alias("r"), v.alias("v"))))))
    rows = rows.withColumns({"right_case": F.col("_w.r"), "test_case": F.col("_w.v")}).withColumn("outcome", outcome)
    return test_verdicts(rows, KEY)

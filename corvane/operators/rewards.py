"""Composite rewards as column formulas. What a program or a test did is an
input column: nothing that a model wrote is ever run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X

#: The weights of the rewards.
TOLERANCE, BASE, LENGTH, STEPS = 1e-6, 3.0, 1e-5, 0.2
SYNTAX, EXECUTION, CORRECT, CONTINUITY = 0.2, 0.5, 2.5, 0.5
TUTOR_VERDICT, TUTOR_FIX, TUTOR_BOTH = 0.8, 2.0, 3.0
TYPES = ("solution", "programming", "finalization", "architect", "test_programming", "tutor", "dual_proof", "test_driven_programmer")


def _if(c: Column, v: float) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))


def _len(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) * LENGTH


def matches(text: Column, answer: Column) -> Column:
    """Whether the answer stated in a text equals ``answer`` as numbers."""
    return N.within(N.numeric_value(X.answer(text)), N.numeric_value(answer), TOLERANCE)


def solution(completion: Column, answer: Column) -> Column:
    def score(x: Column) -> Column:
        good = x["want"].isNotNull() & x["got"].isNotNull() & x["thinks"] & x["r"].isNotNull()
        return F.when(F.coalesce(good, F.lit(False)), _if(N.within(x["got"], x["want"], TOLERANCE), BASE) + _if(X.steps_are_valid(x["r"]), STEPS) - _len(x["r"])).otherwise(F.lit(0.0))

    parts = F.struct(N.numeric_value(answer).alias("want"), N.numeric_value(X.answer(completion)).alias("got"), X.has_tag(completion, "thinking").alias("thinks"), X.response(completion).alias("r"))
    return X.let(parts, score)


def programming(completion: Column, quality_ok: Column, executed: Column, correct: Column) -> Column:
    return X.let(X.code_with_fallback(completion), lambda c: F.when((c == "") | c.isNull(), 0.0).when(~quality_ok, -SYNTAX).when(~executed, SYNTAX).otherwise(SYNTAX + EXECUTION + _if(correct, CORRECT) - _len(c)))


def finalization(completion: Column, partial: Column, answer: Column) -> Column:
    def score(x: Column) -> Column:
        missing = x["r"].isNull() | x["p"].isNull() | answer.isNull() | x["got"].isNull()
        goes_on = F.array_min(X.step_numbers(x["r"])) == X.max_step(x["p"]) + 1
        right = N.within(x["value"], x["want"], TOLERANCE)
        return F.when(missing, 0.0).otherwise(_if(right, BASE) + _if(goes_on, CONTINUITY) - _len(completion))

    r = X.response(completion)
    got = X.answer(F.concat_ws("\n", partial, r))
    return X.let(F.struct(r.alias("r"), partial.alias("p"), got.alias("got"), N.numeric_value(got).alias("value"), N.numeric_value(answer).alias("want")), score)


def architect(completion: Column, successes: Column, attempts: int = 10) -> Column:
    r = F.coalesce(X.response(completion), completion)
    good = (F.length(r) > 100) & r.contains("Recommended Approach")
    return F.when(~F.coalesce(good, F.lit(False)), -SYNTAX).otherwise(SYNTAX + _if(successes > 0, EXECUTION) + successes * (CORRECT / attempts) - _len(r))


def test_programming(completion: Column, quality_ok: Column, tests_ok: Column) -> Column:
    c = X.code(completion)
    return F.when(c == "", 0.0).when(~quality_ok, -SYNTAX).otherwise(SYNTAX + _if(tests_ok, EXECUTION + CORRECT) - _len(c))


def tutor(completion: Column, is_correct: Column, wrong_step: Column, fixed: Column) -> Column:
    v = X.tag_body(completion, "verdict")
    right = F.when(is_correct, X.verdict_is_correct(v)).otherwise(X.verdict_step(v) == wrong_step)
    right = F.coalesce(right, F.lit(False))
    fix = F.when(~is_correct & fixed, F.when(right, TUTOR_BOTH).otherwise(TUTOR_FIX)).otherwise(0.0)
    return F.when(v.isNull() | is_correct.isNull(), 0.0).otherwise(_if(right, TUTOR_VERDICT) + fix - _len(completion))


def dual_proof(completion: Column, proof_ok: Column, code_ok: Column) -> Column:
    missing = X.tag_body(completion, "proof").isNull() | X.tag_body(completion, "code").isNull()
    return F.when(missing, 0.0).otherwise(SYNTAX + _if(proof_ok, 0.75) + _if(code_ok, 0.75) + _if(proof_ok & code_ok, 1.5) - _len(completion))


def test_driven(completion: Column, syntax_ok: Column, impl_ok: Column, test_ok: Column) -> Column:
    missing = X.tag_body(completion, "test").isNull() | X.tag_body(completion, "implementation").isNull()
    return F.when(missing, 0.0).otherwise(SYNTAX + _if(syntax_ok, 0.375) + _if(impl_ok, 0.75) + _if(test_ok, 0.75) + _if(impl_ok & test_ok, 1.5) - _len(completion))


def zero_weak_batches(df: DataFrame, batch: list[str], reward: str, least: float = 1.5) -> DataFrame:
    """Adds ``adjusted``: 0 for all of a batch of more than one whose best reward
    is below ``least``."""
    w = Window.partitionBy(*batch)
    weak = (F.count("*").over(w) > 1) & (F.max(reward).over(w) < least)
    return df.withColumn("adjusted", F.when(weak, 0.0).otherwise(F.col(reward)))


def clip_negative_batches(df: DataFrame, batch: list[str], reward: str) -> DataFrame:
    """Adds ``adjusted``: no reward below 0 in a batch of more than one whose
    mean is."""
    w = Window.partitionBy(*batch)
    low = (F.count("*").over(w) > 1) & (F.avg(reward).over(w) < 0)
    return df.withColumn("adjusted", F.when(low, F.greatest(F.lit(0.0), F.col(reward))).otherwise(F.col(reward)))


def dispatch(df: DataFrame, batch: list[str], kind: str = "example_type") -> DataFrame:
    """(batch, reward_type): one reward for each batch, by what it holds."""
    n = {t: F.count_if(F.col(kind) == t) for t in TYPES}
    per = df.groupBy(*batch).agg(*[v.alias(f"_{k}") for k, v in n.items()])
    chain = F.when(F.col("_test_driven_programmer") > 0, "test_driven_programmer")
    for t in ("dual_proof", "tutor", "test_programming", "architect"):
        chain = chain.when(F.col(f"_{t}") > 0, t)
    p, f, s = F.col("_programming"), F.col("_finalization"), F.col("_solution")
    chain = chain.when((p > 0) & (p >= f) & (p >= s), "programming").when(f > s, "finalization").otherwise("solution")
    return per.select(*batch, chain.alias("reward_type"))


def scored(df: DataFrame, batch: list[str], rewards: dict[str, Column], answer: str = "answer", kind: str = "example_type") -> DataFrame:
    """``df`` with reward_type, reward and adjusted: the one reward of each batch
    (see :func:`dispatch`) for all its rows, 0 where the answer is missing, then
    no negative ones in a batch whose mean is. ``rewards`` has a column for each
    type; a type without one scores 0."""
    typed = df.join(dispatch(df, batch, kind), batch)
    chain = F.when(F.col(answer).isNull(), 0.0)
    for name, value in rewards.items():
        chain = chain.when(F.col("reward_type") == name, value)
    return clip_negative_batches(typed.withColumn("reward", F.coalesce(chain.otherwise(0.0), F.lit(0.0))), batch, "reward")


def guarded(completions: Column, prompts: Column, answers: Column, rewards: Column) -> Column:
    """The rewards of a batch given as arrays, or a 0 for each completion where
    completions, prompts and answers are not equally many."""
    n = F.size(completions)
    return F.when((n == F.coalesce(F.size(prompts), F.lit(-1))) & (n == F.coalesce(F.size(answers), F.lit(-1))), rewards).otherwise(F.transform(completions, lambda _: F.lit(0.0)))


def error_class(structure_ok: Column, quality_ok: Column, executed: Column, message: Column) -> Column:
    """'structure', 'syntax', 'timeout', 'execution' or 'ok': why a program got no
    further."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(no(structure_ok), "structure").when(no(quality_ok), "syntax").when(no(executed) & F.coalesce(message.contains("timed out"), F.lit(False)), "timeout").when(no(executed), "execution").otherwise("ok")

"""Prompts, seeded samples and task mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X

#: Default weights of the tasks.
WEIGHTS = {"solution": 0.20, "programming": 0.15, "finalization": 0.15, "tutor": 0.10, "test_programming": 0.10, "architect": 0.10, "dual_proof": 0.10, "test_driven_programmer": 0.10}


def chat_prompt(system: str, problem: Column) -> Column:
    """One prompt; its parts are separated by a backslash and an n, literally."""
    n = "\\n"
    return F.concat(F.lit(f"<|im_start|>system{n}{system}<|im_end|>{n}<|im_start|>user{n}"), problem, F.lit(f"<|im_end|>{n}<|im_start|>assistant{n}"))


def sft_text(system: str, problem: Column, solution: Column) -> Column:
    return F.concat(F.lit(f"<|im_start|>system<|im_sep|>{system}<|im_end|><|im_start|>user<|im_sep|>"), problem, F.lit("<|im_end|><|im_start|>assistant<|im_sep|>"), solution, F.lit("<|im_end|>"))


#: System texts of the tasks; a caller may give others.
SYSTEMS = {
    "solution": "Solve the problem step by step and state the result.",
    "programming": "Write a program that computes the result.",
    "test_programming": "Write a function that tells right results from wrong ones.",
    "dual_proof": "Prove the result and compute it by a program.",
    "test_driven_programmer": "Write a test first, then a program that passes it.",
    "architect": "Describe how a program should go about the problem.",
}
#: Columns that the examples of a simple task do not use, and their constants.
UNUSED = {"partial_solution": "", "model_answer": "", "is_correct": None, "wrong_step": None, "token_count": 0}


def examples(df: DataFrame, kind: str, system: str | None = None) -> DataFrame:
    """(id, prompt, answer, example_type, and the columns of other tasks as
    constants): examples of a simple task, with its own system text."""
    types = {"is_correct": "boolean", "wrong_step": "int", "token_count": "int"}
    rest = [F.lit(v).cast(types.get(k, "string")).alias(k) for k, v in UNUSED.items()]
    return df.select("id", chat_prompt(system or SYSTEMS[kind], F.col("problem")).alias("prompt"), "answer", F.lit(kind).alias("example_type"), *rest)


def seeded_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows without replacement, fewer if there are fewer; the same on any
    partitioning: those first by a seeded hash of the key, ties by the key."""
    return _first_by_hash(df.withColumn("_h", X.hash_order(seed, F.col(key))).withColumn("_n", F.lit(n)), key, [])


def _first_by_hash(rows: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Of each group the first ``_n`` rows in the order of ``_h``, without a sort
    of all: rows are counted in 65 536 ranges of the hash, ranges before the one
    in which the sample ends are taken whole, and only that one is ranked."""
    rows = rows.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy(*group, "_b", "_n").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not rows
    starts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    ends = starts.where("_before < _n and _before + _c >= _n").select(*group, F.col("_b").alias("_end"), (F.col("_n") - F.col("_before")).alias("_left"))
    on = group or ["_one"]  # one row a group; none where there are fewer rows than wanted
    tag = (lambda d: d) if group else (lambda d: d.withColumn("_one", F.lit(1)))
    placed = tag(rows).join(F.broadcast(tag(ends)), on, "left").drop("_one")
    whole = placed.where("(_end is null or _b < _end) and _n > 0")
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    last = placed.where("_b = _end").withColumn("_r", rank).where("_r <= _left").drop("_r")
    return whole.unionByName(last).drop("_h", "_b", "_n", "_end", "_left")


def stratified_mixture(df: DataFrame, key: str, n: int, weights: dict[str, float] | None = None, seed: int = 142) -> DataFrame:
    """(key, example_type): for each task int(n * weight) rows (fewer if there are
    fewer), shuffled with its own seed; tasks of weight 0 are left out. All tasks
    in one pass."""
    tasks = [(t, str(seed + k), int(n * w)) for k, (t, w) in enumerate((weights or WEIGHTS).items()) if int(n * w) > 0]
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s"), F.lit(m).alias("n")) for t, s, m in tasks])).alias("x")
    rows = df.select(key, each).select(key, F.col("x.t").alias("example_type"), F.md5(F.concat("x.s", F.lit(":"), F.col(key).cast("string"))).alias("_h"), F.col("x.n").alias("_n"))
    return _first_by_hash(rows, key, ["example_type"])


def strict_take(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of an order; an error if there are fewer."""
    have = df.limit(n).count()
    if have < n:
        raise ValueError(f"{n} rows wanted, {have} there")
    return df.orderBy(*order).limit(n)


def mixture_report(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.groupBy("example_type").agg(n.alias("n")).withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def oversample(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, with ``copy_no`` from 1."""
    return df.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(times))))


def fold_chat(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, prompt): the messages of a conversation in order, with their roles
    ('human' is 'user'), and the assistant's turn opened at the end. Separators
    are a backslash and an n, literally, after system and user turns only."""
    n = "\\n"
    r = F.when(F.lower(role) == "human", "user").otherwise(F.lower(role))
    end = F.when(r.isin("system", "user"), F.lit(f"<|im_end|>{n}")).otherwise(F.lit("<|im_end|>"))
    turn = F.struct(F.col(order).alias("o"), F.concat(F.lit("<|im_start|>"), r, F.lit(n), F.col(text), end).alias("t"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("a")).select(key, F.concat(F.array_join(F.transform("a", lambda x: x["t"]), ""), F.lit(f"<|im_start|>assistant{n}")).alias("prompt"))


def fold_chat_separated(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """As :func:`fold_chat` in the other template: a separator mark between role
    and text, nothing between turns, roles in small letters as they are."""
    turn = F.struct(F.col(order).alias("o"), F.concat(F.lit("<|im_start|>"), F.lower(role), F.lit("<|im_sep|>"), F.col(text), F.lit("<|im_end|>")).alias("t"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("a")).select(key, F.concat(F.array_join(F.transform("a", lambda x: x["t"]), ""), F.lit("<|im_start|>assistant<|im_sep|>")).alias("prompt"))


def single_message(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, message): the last system and the last human message as one; without
    a human one the last message of all."""

    def last(cond: Column) -> Column:
        return F.max_by(F.when(cond, F.col(text)), F.when(cond, F.col(order)))

    r = F.lower(role)
    per = df.groupBy(key).agg(last(r == "system").alias("s"), last(r.isin("human", "user")).alias("u"), F.max_by(text, order).alias("any"))
    both = F.concat(F.lit("System instructions:\n"), "s", F.lit("\n\nUser message:\n"), "u")
    return per.select(key, F.when((F.col("s") != "") & (F.col("u") != ""), both).when(F.col("u") != "", F.col("u")).otherwise(F.col("any")).alias("message"))


#: Fixed value: an instruction that a model repeats where it has not solved anything.
ECHO = "Begin with the first calculation or operation"


def tutor_examples(df: DataFrame, echo: str = ECHO) -> DataFrame:
    """(id, attempt_number, reason, example_type): ``example_type`` is 'tutor' for
    rows that pass the cascade, else 'solution' with the first reason."""
    r = X.response(F.col("model_solution"))
    step = X.verdict_step(F.col("model_answer"))
    chain = (
        F.when(F.coalesce(F.col("problem"), F.lit("")) == "", "no problem")
        .when(F.coalesce(F.col("model_solution"), F.lit("")) == "", "no solution")
        .when(r.isNull(), "no response")
        .when(F.col("model_solution").contains(echo), "echo")
        .when(F.col("is_correct").isNull(), "no flag")
        .when(~F.col("is_correct") & step.isNull(), "no wrong step")
        .when(F.col("is_correct") & (X.md5_bucket(F.col("problem"), 20) != 0), "bucket")
    )
    return df.withColumn("reason", chain).select("id", "run_id", "attempt_number", "reason", F.when(F.col("reason").isNull(), "tutor").otherwise("solution").alias("example_type"))


def finalization_examples(df: DataFrame) -> DataFrame:
    """(id, run_id, attempt_number, n_steps, split_at, partial_solution,
    full_solution) of correct solutions with at least two valid steps, split
    after step 1..n-1 by a hash of the id."""
    s = df.where("is_correct and problem is not null and model_solution is not null").withColumn("steps", X.split_steps(F.col("model_solution"))).withColumn("n_steps", F.size("steps"))
    s = s.where(X.steps_are_valid(F.col("model_solution")) & (F.col("n_steps") >= 2))
    s = s.withColumn("split_at", (F.pmod(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("bigint"), F.col("n_steps") - 1) + 1).cast("int"))
    p = X.prefixes(F.col("steps"))
    return s.select("id", "run_id", "attempt_number", "n_steps", "split_at", F.get(p, F.col("split_at") - 1).alias("partial_solution"), F.get(p, F.col("n_steps") - 1).alias("full_solution"))


def _flag(df: DataFrame, name: str) -> Column:
    """A flag as received: a boolean, or 'true' and 'false' in any case."""
    return X.flag(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def tutor_prompts(df: DataFrame, system: str, count=X.token_estimate, limit: int = 1500, echo: str = ECHO) -> DataFrame:
    """(df's columns, prompt, full_solution, flag, step, token_count,
    example_type): the rows that make a tutor example.

    ``df`` has problem, model_solution, is_correct and wrong_step, the last two
    as values or texts. A row needs a problem and a response without ``echo``;
    one that is not right needs a wrong step; of the right ones without a step one
    in twenty stays, by a hash of the problem; and the prompt has at most
    ``limit`` tokens as ``count`` sees it."""
    n = "\\n"
    full = X.response(F.col("model_solution"))
    step = N.int_value(F.col("wrong_step").cast("string")).cast("int") if "wrong_step" in df.columns else F.lit(None).cast("int")
    said = F.concat(F.lit("Here is a mathematical problem and a proposed solution:\n\nProblem:\n"), F.col("problem"), F.lit("\n\nProposed Solution:\n"), F.col("full_solution"))
    prompt = F.concat(F.lit(f"<|im_start|>system{n}{system}<|im_end|>{n}<|im_start|>user{n}"), said, F.lit(f"<|im_end|>{n}<|im_start|>assistant{n}"))
    rows = df.where((F.col("problem") != "") & F.col("model_solution").contains("<response>") & ~F.col("model_solution").contains(echo))
    rows = rows.withColumns({"full_solution": full, "flag": _flag(df, "is_correct"), "step": step}).where("full_solution is not null")
    right = F.coalesce(F.col("flag"), F.lit(False))
    rows = rows.where(right | F.col("step").isNotNull()).where(~right | F.col("step").isNotNull() | (X.md5_bucket(F.col("problem"), 20) == 0))
    out = rows.withColumn("prompt", prompt).withColumns({"token_count": count(F.col("prompt")), "example_type": F.lit("tutor")})
    return out.where(F.col("token_count") <= limit)


def finalization_prompts(df: DataFrame, system: str, key: str = "id", count=X.token_estimate, limit: int = 1500, echo: str = ECHO) -> DataFrame:
    """(df's columns, prompt, partial_solution, full_solution, split_at,
    token_count, example_type): the rows that make a finalization example.

    A row needs a problem, a right response without ``echo`` whose steps are
    valid and at least two; it is cut after step 1..n-1 by a hash of ``key``, and
    the part before the cut has to be valid too. Where system text and question
    reach ``limit`` tokens only the first step is given; if they still do, or the
    prompt has more, the row is left out."""
    n = "\\n"
    rows = df.where((F.col("problem") != "") & F.col("model_solution").contains("<response>") & ~F.col("model_solution").contains(echo)).where(F.coalesce(_flag(df, "is_correct"), F.lit(False)))
    rows = rows.withColumn("_r", X.response(F.col("model_solution"))).where((F.col("_r") != "") & X.steps_are_valid(F.col("_r"))).withColumn("_s", X.split_steps(F.col("_r"))).where(F.size("_s") >= 2)
    cut = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.greatest(F.size("_s") - 1, F.lit(1))) + 1
    rows = rows.withColumn("_p", X.prefixes(F.col("_s"))).withColumn("split_at", cut.cast("int")).withColumn("_part", F.get("_p", F.col("split_at") - 1)).where(X.steps_are_valid(F.col("_part")))
    ask = lambda part: F.concat(F.lit("Problem: "), F.col("problem"), F.lit("\n\nPartial Solution: "), part)
    used = lambda part: count(F.lit(system)) + count(ask(part))
    rows = rows.withColumn("split_at", F.when(used(F.col("_part")) >= limit, 1).otherwise(F.col("split_at"))).withColumn("partial_solution", F.get("_p", F.col("split_at") - 1)).where(used(F.col("partial_solution")) < limit)
    prompt = F.concat(F.lit(f"<|im_start|>system{n}{system}<|im_end|>{n}<|im_start|>user{n}"), ask(F.col("partial_solution")), F.lit(f"<|im_end|>{n}<|im_start|>assistant{n}"))
    out = rows.withColumn("full_solution", F.get("_p", F.size("_s") - 1)).withColumn("prompt", prompt).withColumns({"token_count": count(F.col("prompt")), "example_type": F.lit("finalization")})
    return out.where(F.col("token_count") <= limit).drop("_r", "_s", "_p", "_part")

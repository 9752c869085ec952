"""Golden cases of the column functions."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<int>'}" for k, v in enumerate(values)))
    return df.select(fn(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [(r"a \boxed{\frac{1}{2}} b \boxed{3}", r"\frac{1}{2}"), (r"\boxed{ a \boxed{3}", "3"), ("x #### 42 #### 7", "42"), ("no answer", None), (r"\boxed{  5 }", "5"), (None, None), (r"\boxed{a{b{c{d}}}}", "a{b{c{d}}}")],
)
def test_answer(spark, text, want):
    assert one(spark, X.answer, text) == want


@pytest.mark.parametrize("text, want", [("x = 5", 5.0), ("x^2 = 5", None), (r"1 \text{or} 2", None), (r"90^{\circ}", 90.0), ("", None), (None, None), (r"\frac{1}{4}", 0.25), (r"-\frac{1}{4}", -0.25), (r"3\sqrt{16}", 12.0), (r"y \approx 2.5", 2.5), (r"\textbf{7}", 7.0), ("1/0", None), (r"\frac{1}{0}", None)])
def test_numeric_value(spark, text, want):
    assert one(spark, N.numeric_value, text) == want


@pytest.mark.parametrize("text, want", [("2^{10}", 1024.0), ("5!", 120.0), (r"\left(1+2\right)3", 9.0), ("a+1", None), ("(1,2)", None), ("1,234", 1234.0), (r"\frac12", 0.5), (r"|{-3}|", 3.0), (r"\sqrt[3]{27}", 3.0), (r"\sqrt{-1}", None), ("1/0", None), ("x = 5", 5.0), (r"2\cdot 3 - 1", 5.0), ("$7$", 7.0), ("(" * 500, None)])
def test_evaluate(text, want):
    got = N.evaluate(text)
    assert got is None if want is None else got == pytest.approx(want)


def test_evaluate_agrees_with_fast_path(spark):
    values = ["5", "-2.5", r"\frac{3}{4}", r"-\frac{-3}{4}", r"2\sqrt{9}", r"\sqrt{2}", r"3\pi", "x = 12", "", None, "abc", r"67^{\circ}"]
    rows = spark.createDataFrame([(v,) for v in values], "a string").select("a", N.numeric_value(F.col("a")).alias("fast"), N.full_numeric_value(F.col("a")).alias("full")).collect()
    for r in rows:
        assert r.fast is None or r.fast == pytest.approx(r.full), r


def test_tolerance(spark):
    assert one(spark, lambda a, b: N.within(a, b, 0.5), 1.0, 1.5) is True
    assert one(spark, lambda a: N.within(a, F.lit(None).cast("double"), 0.5), 1.0) is False


@pytest.mark.parametrize(
    "text, want",
    [("```python\nprint(1)\n```", "print(1)"), ("hello", ""), ("for x <b>", ""), ("", ""), (None, ""), ("```\ny\n```", "y"), ("import os", "import os")],
)
def test_code(spark, text, want):
    assert one(spark, X.code, text) == want


@pytest.mark.parametrize(
    "text, want",
    [("<step>Step 1: 0123456789</step><step>Step 2: 0123456789</step>", True), ("<step>Step 1: short</step>", False), ("Step 2: a Step 1: b", True), ("Step 1: a Step 1: b", False), ("nothing", False)],
)
def test_steps_are_valid(spark, text, want):
    assert one(spark, X.steps_are_valid, text) is want


def test_split_steps(spark):
    assert len(one(spark, X.split_steps, "intro analysis Step 1: a Step 2: b")) == 3
    assert one(spark, X.split_steps, "intro Step 1: a") == ["<step>Step 1: a</step>"]
    assert one(spark, X.split_steps, "<step>a</step> x <step>b</step>") == ["<step>a</step>", "<step>b</step>"]
    assert one(spark, lambda c: X.prefixes(X.split_steps(c)), "<step>a</step><step>b</step>") == ["<step>a</step>", "<step>a</step>\n\n<step>b</step>"]


@pytest.mark.parametrize("text, want, step", [("incorrect", True, None), ("Step 3", False, 3), ("Steps 3 and 4", None, None), ("wrong", False, None), (None, None, None), ("fine", None, None)])
def test_verdict(spark, text, want, step):
    assert one(spark, X.verdict_is_correct, text) is want
    assert one(spark, X.verdict_step, text) == step


@pytest.mark.parametrize("i, n, want", [(0, 2, "short_solution"), (0, 6, "beginning"), (5, 6, "end"), (1, 6, "early"), (2, 6, "middle"), (4, 6, "late")])
def test_position(spark, i, n, want):
    assert one(spark, X.position_category, i, n) == want


def brute_wrong_step(valid):
    if len(valid) < 2:
        return None
    k = len(valid) // 2
    if valid[k]:
        while k < len(valid) and valid[k]:
            k += 1
        return k if k < len(valid) else None
    while k >= 0 and not valid[k]:
        k -= 1
    return k + 1


def test_first_wrong_step(spark):
    import itertools

    cases = [list(c) for n in range(0, 6) for c in itertools.product([True, False], repeat=n)]
    df = spark.createDataFrame([(c,) for c in cases], "v array<boolean>")
    for r in df.select("v", X.first_wrong_step(F.col("v")).alias("w")).collect():
        assert r.w == brute_wrong_step(r.v), r.v


def test_multiple_choice_and_kinds(spark):
    assert one(spark, X.is_multiple_choice, "Pick (A) 1 (B) 2 (C) 3 (D) 4") is True
    assert one(spark, X.is_multiple_choice, "Plain") is False
    assert [one(spark, X.invalid_content, t) for t in ("see HTTP://x 中", "中文", "это", "ok")] == ["http", "chinese", "russian", ""]


def test_strictly_increasing(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 1],), ([2],), ([],)], "v array<int>")
    assert [r[0] for r in df.select(X.strictly_increasing(F.col("v"))).collect()] == [True, False, True, False]


# ---------------------------------------------------------------- values of any depth


def test_boxes_of_any_depth_equal_counting(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["\\boxed{", "{", "}", "a", "}", " "]) for _ in range(rng.randint(0, 30))) for _ in range(600)]

    def want(s):
        at = 0
        while (k := s.find("\\boxed{", at)) >= 0:
            depth, j = 1, k + 7
            while j < len(s) and depth:
                depth += (s[j] == "{") - (s[j] == "}")
                j += 1
            if not depth:
                return s[k + 7 : j - 1].strip()
            at = k + 7
        return None

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", X.boxed_answer(F.col("s")).alias("b")).collect()
    assert {r.k: r.b for r in rows} == {k: want(s) for k, s in enumerate(texts)}


def test_strip_is_that_of_python(spark):
    blanks = [" ", " ", "　", "\x1c", "\x85", "\t", "\x0b", " ", "﻿"]
    texts = [b + "a b" + c for b in blanks for c in blanks] + ["", " ", None, "\n\n" * 5000 + "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(X.strip(F.col("s"))).collect()]
    assert got == [t.strip() if t is not None else None for t in texts]


@pytest.mark.parametrize("value", [7.0, -0.4, 0.0, 1e10, float("inf"), float("-inf")])
def test_filled_cases(spark, value):
    row = spark.range(1)
    cases = row.select(N.test_cases(F.lit(value), 50).alias("c")).first().c
    assert value in cases and len(cases) <= 51 and len(set(cases)) > len(cases) - 8  # fixed cases may coincide
    wrong = [c for c in cases if c != value]
    assert all(abs(c) < float("inf") for c in wrong) and len(wrong) >= (49 if abs(value) < float("inf") else 14)
    if abs(value) < float("inf"):
        assert all(abs(c - value) > 1e-2 for c in wrong)
    else:
        assert 1e9 in cases and -1e9 in cases and (1e10 in cases) == (value < 0)
    assert cases == row.select(N.test_cases(F.lit(value), 50).alias("c")).first().c


def test_evaluator_serves_filters_and_rewards(spark):
    from corvane.operators import filters, rewards

    rows = [(1, "p" * 10, "so $x$ is \\boxed{2^{10}}", "1024"), (2, "p" * 10, "\\boxed{\\frac{3\\sqrt{2}}{4}}", "1.0606601717798212"), (3, "p" * 10, "\\boxed{x+1}", "3")]
    df = spark.createDataFrame(rows, "id int, problem string, solution string, answer string")
    kept = {r.id: r.reason for r in filters.waterfall(df, filters.standard_rules()).collect()}
    assert kept == {1: None, 2: None, 3: "not_numeric"}
    got = {r.id: r.ok for r in df.select("id", rewards.matches(F.col("solution"), F.col("answer")).alias("ok")).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert {r.id: r.r.ok for r in df.select("id", N.verify(F.col("solution"), F.col("answer")).alias("r")).collect()} == got


def test_walk_equals_the_loop(spark):
    def walk(states):
        n = len(states)
        if n < 2:
            return None
        k, up, bad, wrong = n // 2, None, None, None
        while True:
            if states[k] == "verified":
                return None
            if states[k] == "valid":
                if up is None:
                    up = True
                elif not up:
                    return bad
                if k + 1 >= n:
                    return None
                k += 1
            else:
                bad = k
                if up is None:
                    up, wrong = False, k
                elif up:
                    return k
                if k == 0:
                    return 0
                k -= 1

    rng = random.Random(5)
    rows = [(k, [rng.choice(["valid", "valid", "invalid", "invalid", "verified"]) for _ in range(rng.randint(0, 9))]) for k in range(500)]
    got = {r.k: r.w for r in spark.createDataFrame(rows, "k int, s array<string>").select("k", X.walk_to_wrong_step(F.col("s")).alias("w")).collect()}
    assert got == {k: walk(s) for k, s in rows}

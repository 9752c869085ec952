"""Golden cases: values given in both languages, results as literals in SQL, so
that no pattern of the code under test stands in what it is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X
from corvane.plans.registry import query


def _text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _sql(names: str, rows: list[tuple], kinds: tuple[str, ...]) -> str:
    def one(x, kind):
        return f"CAST({'NULL' if x is None else _text(x) if isinstance(x, str) else x} AS {kind})"

    values = ", ".join("(" + ", ".join(one(x, k) for x, k in zip(r, kinds)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS g({names})"


def _cases(t, rows: list[tuple], schema: str):
    return t("region").sparkSession.createDataFrame(rows, schema)


#: (text, the value it states)
NUMBERS = [
    ("42", 42.0), ("-3.5", -3.5), (".25", 0.25), ("2^{10}", 1024.0), ("\\frac{3}{4}", 0.75), ("\\dfrac{-7}{2}", -3.5), ("-\\frac{1}{8}", -0.125), ("\\frac{3\\sqrt{2}}{4}", 1.060660), ("1,234", 1234.0),
    ("1,234,567.5", 1234567.5), ("2\\sqrt{3}", 3.464102), ("\\sqrt[3]{27}", 3.0), ("3\\pi", 9.424778), ("\\frac{\\pi}{2}", 1.570796), ("5!", 120.0), ("2 + 3 \\cdot 4", 14.0), ("(1+2)^2", 9.0), ("|{-4}|", 4.0),
    ("\\left(\\frac{1}{2}\\right)^{3}", 0.125), ("e^2", 7.389056), ("\\ln{e}", 1.0), ("x = 7", 7.0), ("a = b = \\frac{1}{2}", 0.5), ("\\pi \\approx 3.14", 3.14), ("45^\\circ", 45.0), ("12\\text{ cm}", 12.0),
    ("50\\%", 50.0), ("\\textbf{19}", 19.0), ("2^{-1}", 0.5), ("\\frac12", 0.5), ("10 \\div 4", 2.5), ("3 \\text{ or } 4", None), ("x + 1", None), ("(1, 2)", None), ("", None), ("  ", None), ("\\frac{1}{0}", None),
    ("\\emptyset", None), ("[1, 2]", None), ("1 < 2", None), (None, None), ("{}", None), ("2^{2^{3}}", 256.0), ("\\frac{1+\\sqrt{5}}{2}", 1.618034), ("-2^2", -4.0), ("7\\ ", 7.0),
]


@query("numeric_golden", _sql("case_no, text, value", [(k, *r) for k, r in enumerate(NUMBERS)], ("INTEGER", "VARCHAR", "DOUBLE")))
def numeric_golden(t):
    rows = _cases(t, [(k, s) for k, (s, _) in enumerate(NUMBERS)], "case_no int, text string")
    return rows.select("case_no", "text", F.round(N.numeric_value(F.col("text")), 6).alias("value"))


#: (text, the boxed answer, the answer by either mark)
BOXES = [
    ("so \\boxed{7}.", "7", "7"), ("\\boxed{ {a} }", "{a}", "{a}"), ("\\boxed{\\frac{1}{\\sqrt{2}}}", "\\frac{1}{\\sqrt{2}}", "\\frac{1}{\\sqrt{2}}"), ("\\boxed{{{{{x}}}}}", "{{{{x}}}}", "{{{{x}}}}"),
    ("\\boxed{a{b{c{d{e{f}}}}}} \\boxed{2}", "a{b{c{d{e{f}}}}}", "a{b{c{d{e{f}}}}}"), ("\\boxed{open \\boxed{3}", "3", "3"), ("\\boxed{open {{{{", None, None), ("\\boxed{1{ \\boxed{a{b{c{d{e}}}}}", "a{b{c{d{e}}}}", "a{b{c{d{e}}}}"),
    ("no box #### 12 #### 13", None, "12"), ("\\boxed{} #### 5", "", ""), ("text only", None, None), ("", None, None), (None, None, None), ("\\boxed {4} #### 9", None, "9"), ("\\boxed{\\text{no}\n{x}}", "\\text{no}\n{x}", "\\text{no}\n{x}"),
    ("}} \\boxed{5}", "5", "5"), ("\\boxed{\u00a06\u2003}", "6", "6"), ("####\u3000 8 \u00a0", None, "8"),
]


@query("boxed_golden", _sql("case_no, text, boxed, answer", [(k, *r) for k, r in enumerate(BOXES)], ("INTEGER", "VARCHAR", "VARCHAR", "VARCHAR")))
def boxed_golden(t):
    rows = _cases(t, [(k, r[0]) for k, r in enumerate(BOXES)], "case_no int, text string")
    return rows.select("case_no", "text", X.boxed_answer(F.col("text")).alias("boxed"), X.answer(F.col("text")).alias("answer"))


#: (text, index of the opening brace, index of the closing one)
BRACES = [("{a}", 0, 2), ("x{a{b}c}d", 1, 7), ("x{a{b}c}d", 3, 5), ("{{{{{{}}}}}}", 0, 11), ("{open", 0, -1), ("\\{a\\}", 1, 4), ("{}", 0, 1)]


@query("brace_golden", _sql("case_no, text, start, close", [(k, *r) for k, r in enumerate(BRACES)], ("INTEGER", "VARCHAR", "INTEGER", "INTEGER")))
def brace_golden(t):
    rows = _cases(t, [(k, s, i) for k, (s, i, _) in enumerate(BRACES)], "case_no int, text string, start int")
    return rows.select("case_no", "text", "start", X.matching_brace(F.col("text"), F.col("start")).alias("close"))


_FIT, _NOTHING = "Code passed quality checks", "Code lacks meaningful computation or function definitions"
#: (program, whether it is fit, what is said; of an error only that it is one)
CODES = [
    ("print(1)", True, _FIT), ("def f():\n    return 2", True, _FIT), ("", False, "Empty code"), (" \n", False, "Empty code"), (None, False, "Empty code"), ("print((1", False, "Syntax error"), ("for x in", False, "Syntax error"),
    ("x = y + 1", True, _FIT), ("import os\nos.system('ls')", False, "Linting issues: Contains potentially unsafe system call"),
    ("eval('1')\nexec('2')", False, "Linting issues: Contains potentially unsafe exec call; Contains potentially unsafe eval call"), ("return 3", False, "Syntax error"),
    ("f = open('a', 'w')", False, "Linting issues: Contains file write operation"), ("import math", False, _NOTHING), ("42", False, _NOTHING), ("def f(:\n  os.system(1)", False, "Syntax error"), ("if True:\nprint(1)", False, "Syntax error"),
    ("import requests\nprint(1)", False, "Linting issues: Contains network request library"),
]


@query("code_golden", _sql("case_no, code, ok, message", [(k, *r) for k, r in enumerate(CODES)], ("INTEGER", "VARCHAR", "BOOLEAN", "VARCHAR")))
def code_golden(t):
    """Programs are compiled, never run."""
    rows = _cases(t, [(k, r[0]) for k, r in enumerate(CODES)], "case_no int, code string")
    q = rows.select("case_no", "code", X.code_quality(F.col("code")).alias("q"))
    return q.select("case_no", "code", "q.ok", F.regexp_replace("q.message", "(?s)^Syntax error: .*", "Syntax error").alias("message"))


#: (states of the steps, first wrong step from 0)
WALKS = [
    ("valid,valid,invalid,invalid", 2), ("invalid,invalid,invalid", 0), ("valid,invalid,invalid,invalid", 1), ("valid,valid,valid", None), ("valid", None), ("", None), ("valid,valid,verified,invalid", None), ("valid,verified,invalid,invalid", None),
    ("invalid,valid,valid,invalid,valid", 3), ("valid,invalid,valid,verified,invalid", None), ("verified,valid,invalid", 2), ("valid,verified", None), ("invalid,invalid", 0), ("valid,valid,valid,valid,invalid,valid,invalid", 4),
]


@query("walk_golden", _sql("case_no, states, wrong_step", [(k, *r) for k, r in enumerate(WALKS)], ("INTEGER", "VARCHAR", "INTEGER")))
def walk_golden(t):
    rows = _cases(t, [(k, s) for k, (s, _) in enumerate(WALKS)], "case_no int, states string")
    return rows.select("case_no", "states", X.walk_to_wrong_step(F.filter(F.split("states", ","), lambda x: x != "")).cast("int").alias("wrong_step"))


#: (number, as a percentage; text, as an integer; a key, its value or the default; a nested value, its first or itself)
SCALARS = [
    (12.34, "12.3%", " 7 ", "7", "a", "x", ["solution", "tutor"], None, "solution"), (0.0, "0.0%", "3.0", None, "b", "y", [], "tutor", "tutor"), (100.0, "100.0%", "-12", "-12", "c", "other", None, "tutor", "tutor"),
    (66.66, "66.7%", "12345678901234567890", "12345678901234567890", None, "other", [None], "alone", "alone"), (None, None, None, None, "a", "x", None, None, None), (5.04, "5.0%", "1e3", None, "", "other", ["x"], "y", "x"),
]


@query("scalar_golden", _sql("case_no, percent, as_int, looked_up, first_or_self", [(k, r[1], r[3], r[5], r[8]) for k, r in enumerate(SCALARS)], ("INTEGER", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR")))
def scalar_golden(t):
    rows = _cases(t, [(k, r[0], r[2], r[4], r[6], r[7]) for k, r in enumerate(SCALARS)], "case_no int, x double, s string, k string, nested array<string>, alone string")
    table = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    return rows.select("case_no", N.percent(F.col("x")).alias("percent"), N.int_value(F.col("s")).cast("string").alias("as_int"), X.lookup(table, F.col("k"), F.lit("other")).alias("looked_up"), X.first_or_self(F.col("nested"), F.col("alone")).alias("first_or_self"))

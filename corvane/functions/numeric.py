"""Numbers written in LaTeX: a fast path of built-in expressions and a full
evaluator for what is left over."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let, strip

#: What is unwrapped, dropped or refused before reading a number.
REFUSED = r"\\text\{\s*(?:or|and)\s*\}"
UNWRAPPED = r"\\textbf\{([^{}]*)\}"
DROPPED = r"\\text\{[^{}]*\}|\\pm|\\ |\\,|\\!|\\%|\^\{?\\circ\}?|\\degree|°"
OPERATORS = r"[+\-*/^]"
PLAIN = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"
FRACTION = r"^([+-]?)\\[dt]?frac\{([+-]?[0-9]+(?:\.[0-9]+)?)\}\{([+-]?[0-9]+(?:\.[0-9]+)?)\}$"
ROOT = r"^([+-]?[0-9]*(?:\.[0-9]+)?)\\sqrt\{([0-9]+)\}$"
TIMES_PI = r"^([+-]?[0-9]*(?:\.[0-9]+)?)\\pi$"


def has_single_term(c: Column) -> Column:
    """No operator outside braces (one level)."""
    return ~F.regexp_replace(c, r"\{[^{}]*\}", "").rlike(OPERATORS)


def cleaned(c: Column) -> Column:
    """A LaTeX number without markup; cut after the last equals sign if what is
    left of it is a single term, then after the last approximation sign."""

    def cut(s: Column, mark: str, pattern: str) -> Column:
        return F.when(s.contains(mark) & has_single_term(F.regexp_extract(s, pattern, 1)), strip(F.regexp_extract(s, pattern, 2))).otherwise(s)

    plain = strip(F.regexp_replace(F.regexp_replace(c, UNWRAPPED, "$1"), DROPPED, ""))
    return let(let(plain, lambda s: cut(s, "=", r"^(.*)=([^=]*)$")), lambda s: cut(s, "\\approx", r"^(.*)\\approx(.*)$"))


def _factor(c: Column) -> Column:
    return F.when(c.isin("", "+"), F.lit(1.0)).when(c == "-", F.lit(-1.0)).otherwise(c.try_cast("double"))


def fast_value(c: Column) -> Column:
    """The number that an answer states, for plain numbers, fractions, roots and
    multiples of pi; null for the rest. Built-in expressions only."""

    def read(s: Column) -> Column:
        sign = F.when(F.regexp_extract(s, FRACTION, 1) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
        top, bottom = F.regexp_extract(s, FRACTION, 2).try_cast("double"), F.regexp_extract(s, FRACTION, 3).try_cast("double")
        return (
            F.when(s.rlike(PLAIN), s.try_cast("double"))
            .when(s.rlike(FRACTION), sign * F.try_divide(top, bottom))
            .when(s.rlike(ROOT), _factor(F.regexp_extract(s, ROOT, 1)) * F.sqrt(F.regexp_extract(s, ROOT, 2).try_cast("double")))
            .when(s.rlike(TIMES_PI), _factor(F.regexp_extract(s, TIMES_PI, 1)) * F.lit(math.pi))
        )

    return let(c, lambda x: F.when(x.isNull() | x.rlike(REFUSED), F.lit(None).cast("double")).otherwise(let(cleaned(x), read)))


def numeric_value(c: Column) -> Column:
    """The number that an answer states: by :func:`fast_value`, and by the full
    evaluator for what that leaves and that holds a digit or a constant. The
    evaluator sees nulls for all other rows. Not for use inside a lambda."""
    fast = fast_value(c)
    return F.coalesce(fast, evaluate_udf(F.when(fast.isNull() & c.rlike(r"[0-9]|\\pi|(?<![A-Za-z\\])e(?![A-Za-z])"), c)))


def float_value(c: Column) -> Column:
    """:func:`numeric_value`, else the text as a plain float."""
    return F.coalesce(numeric_value(c), strip(c).try_cast("double"))


def int_value(c: Column) -> Column:
    """An integer that a text is, with a sign and blanks around at most; null for
    all else, fractions included."""
    return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast("decimal(38,0)"))


def percent(c: Column) -> Column:
    """A percentage with one decimal."""
    return F.when(c.isNotNull(), F.concat(F.format_string("%.1f", c.cast("double")), F.lit("%")))


def same_value(a: Column, b: Column, tolerance: float = 1e-2) -> Column:
    """Within tolerance where both texts are plain floats, else the same stripped
    text; false where either is null."""
    x, y = strip(a).try_cast("double"), strip(b).try_cast("double")
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(strip(a) == strip(b)), F.lit(False))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """abs(a - b) <= tolerance; false if either is null."""
    return F.coalesce(F.abs(a - b) <= F.lit(tolerance), F.lit(False))


def same_answer(a: Column, b: Column, tolerance: float = 1e-2) -> Column:
    """Within tolerance as numbers, else the same stripped text."""
    numbers = F.struct(numeric_value(a).alias("x"), numeric_value(b).alias("y"))
    text = F.coalesce(strip(a) == strip(b), F.lit(False))
    return let(numbers, lambda n: F.when(n["x"].isNotNull() & n["y"].isNotNull(), within(n["x"], n["y"], tolerance)).otherwise(text))


def verify(solution: Column, answer: Column, tolerance: float = 1e-2) -> Column:
    """struct(ok, stated): whether the answer that a solution states equals
    ``answer`` as numbers within tolerance, and the stated text, also when it
    does not."""
    from corvane.functions.text import answer as stated_answer

    stated = stated_answer(solution)
    return F.struct(within(numeric_value(stated), numeric_value(answer), tolerance).alias("ok"), stated.alias("stated"))


#: Near misses around a known answer.
MULTIPLIERS = (0.5, 2.0, -1.0, 10.0, 0.1, 5.0, 0.01, 20.0, -0.5, -2.0, -5.0, -10.0, 100.0, 0.001)
OFFSETS = (0.1, 1.0, -0.1, -1.0, 100.0, 10.0, -10.0, 1000.0, -1000.0, 0.01, -0.01)
EDGES = (0.0, 1.0, -1.0, 1e10, -1e10)


LARGE = (1e6, 1e7, 1e8, 1e9, -1e6, -1e7, -1e8, -1e9)


def wrong_cases(correct: Column, total: int = 0, seed: int = 7) -> Column:
    """Values that are no answer: edge cases, multiples and, below 1, offsets,
    each more than 0.01 away; filled up to ``total`` by values drawn from a hash
    of the answer, so that the same answer has the same cases: a third each are
    random multiples, random offsets and random values. For an infinite answer
    edge cases, large values and random powers of ten, all finite."""
    finite = F.abs(correct) < float("inf")
    edges = F.array(*[F.lit(x) for x in EDGES[:3]], F.when(correct == float("inf"), 1e9).otherwise(EDGES[3]), F.when(correct == float("-inf"), -1e9).otherwise(EDGES[4]))
    multiples = F.array(*[correct * x for x in MULTIPLIERS])
    offsets = F.when(F.abs(correct) < 1, F.array(*[correct + x for x in OFFSETS])).otherwise(F.array().cast("array<double>"))
    cases = F.when(finite, F.concat(edges, multiples, offsets)).otherwise(F.concat(edges, F.array(*[F.lit(x) for x in LARGE])))
    if total:
        u = lambda i, k: F.pmod(F.xxhash64(correct, i, F.lit(seed), F.lit(k)), F.lit(1 << 30)).cast("double") / float(1 << 30)
        side = lambda i: F.when(u(i, 2) < 0.5, -1.0).otherwise(1.0)

        def drawn(i: Column) -> Column:
            way = F.floor(u(i, 0) * 3)
            multiple = correct * (F.lit(0.001) + u(i, 1) * (100.0 - 0.001)) * side(i)
            offset = correct + (u(i, 1) * 2 - 1) * F.greatest(F.lit(1.0), F.abs(correct) * 10)
            anything = (u(i, 1) * 2 - 1) * F.greatest(F.lit(100.0), F.abs(correct) * 100)
            return F.when(~finite, side(i) * F.pow(F.lit(10.0), F.floor(u(i, 1) * 6) + 4)).when(way == 0, multiple).when(way == 1, offset).otherwise(anything)

    good = lambda values: F.filter(values, lambda v: (F.abs(v) < float("inf")) & ((F.abs(v - correct) > 1e-2) | ~finite))
    if not total:
        return good(cases)
    return F.slice(F.concat(good(cases), F.array_except(good(F.transform(F.sequence(F.lit(1), F.lit(2 * total)), drawn)), cases)), 1, total)


def test_cases(correct: Column, total: int = 50, seed: int = 7) -> Column:
    """The right value and up to ``total`` wrong ones, in an order drawn from a
    hash; the right one is always among them."""
    every = F.concat(F.array(correct), wrong_cases(correct, total, seed))
    keyed = F.transform(every, lambda v: F.struct(F.xxhash64(v, correct, F.lit(seed)).alias("h"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


# ---------------------------------------------------------------- full evaluator

_TOKEN = re.compile(r"\s*(?:(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.?\d*|\.\d+)|\\([A-Za-z]+)|(.))", re.S)
_CONSTANTS = {"pi": math.pi}
_CALLS = {"ln": math.log, "log": math.log10, "sin": math.sin, "cos": math.cos, "tan": math.tan, "exp": math.exp}
MAX_TOKENS = 400


class _Reader:
    """Recursive descent over LaTeX arithmetic. Anything with a free symbol, a
    list, a relation or a value that is not finite raises ValueError."""

    def __init__(self, text: str):
        self.tokens = []
        for num, name, char in _TOKEN.findall(text):
            if num:
                self.tokens.append(("n", float(num.replace(",", ""))))
            elif name in ("left", "right", "displaystyle", "quad"):
                continue
            elif name:
                self.tokens.append(("c", name))
            elif char.strip():
                self.tokens.append(("s", char))
        if not self.tokens or len(self.tokens) > MAX_TOKENS:
            raise ValueError("size")
        self.at = 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, kind=None, value=None):
        t = self.peek()
        if t[0] is None or kind and t[0] != kind or value is not None and t[1] != value:
            raise ValueError("syntax")
        self.at += 1
        return t

    def value(self) -> float:
        v = self.sum()
        if self.at != len(self.tokens) or not math.isfinite(v):
            raise ValueError("rest")
        return v

    def sum(self) -> float:
        v = self.product()
        while self.peek() in (("s", "+"), ("s", "-")):
            v = v + self.product() if self.take()[1] == "+" else v - self.product()
        return v

    def product(self) -> float:
        v = self.signed()
        while True:
            t = self.peek()
            if t in (("s", "*"), ("c", "cdot"), ("c", "times")):
                self.take()
                v *= self.signed()
            elif t in (("s", "/"), ("c", "div")):
                self.take()
                v /= self.signed()
            elif t[0] in ("n", "c") or t[1] in ("(", "{"):
                v *= self.power()
            else:
                return v

    def signed(self) -> float:
        if self.peek() in (("s", "-"), ("s", "+")):
            return -self.signed() if self.take()[1] == "-" else self.signed()
        return self.power()

    def power(self) -> float:
        v = self.atom()
        while self.peek() == ("s", "!"):
            self.take()
            if v < 0 or v != int(v) or v > 170:
                raise ValueError("factorial")
            v = float(math.factorial(int(v)))
        if self.peek() == ("s", "^"):
            self.take()
            v = v ** (self.group() if self.peek() == ("s", "{") else self.signed())
            if isinstance(v, complex):
                raise ValueError("complex")
        return v

    def group(self, close: str = "}") -> float:
        self.take("s")
        v = self.sum()
        self.take("s", close)
        return v

    def argument(self) -> float:
        return self.group() if self.peek() == ("s", "{") else self.group(")") if self.peek() == ("s", "(") else self.power()

    def atom(self) -> float:
        kind, t = self.peek()
        if kind == "n":
            return self.take()[1]
        if kind == "s" and t in "({":
            return self.group(")" if t == "(" else "}")
        if kind == "s" and t == "|":
            self.take()
            v = abs(self.sum())
            self.take("s", "|")
            return v
        if kind == "s" and t == "e":
            self.take()
            return math.e
        if kind == "c":
            self.take()
            if t in _CONSTANTS:
                return _CONSTANTS[t]
            if t in ("frac", "dfrac", "tfrac"):
                top = self.digit_or_group()
                return top / self.digit_or_group()
            if t == "sqrt":
                n = 2.0
                if self.peek() == ("s", "["):
                    n = self.group("]")
                v = self.argument() ** (1 / n)
                if isinstance(v, complex):
                    raise ValueError("complex")
                return v
            if t in _CALLS:
                return _CALLS[t](self.argument())
        raise ValueError("symbol")

    def digit_or_group(self) -> float:
        if self.peek() == ("s", "{"):
            return self.group()
        kind, v = self.take("n")
        digits = str(int(v))
        if len(digits) > 1 and v == int(v):  # \frac12
            self.at -= 1
            self.tokens[self.at] = ("n", float(digits[1:]))
            return float(digits[0])
        return v


def evaluate(latex: str | None) -> float | None:
    """The value of LaTeX arithmetic, or None."""
    if latex is None:
        return None
    if re.search(REFUSED, latex):
        return None
    s = re.sub(DROPPED, "", re.sub(UNWRAPPED, r"\1", latex)).strip().strip("$").strip()
    for mark in ("=", "\\approx"):
        if mark in s:
            left, right = s.rsplit(mark, 1)
            if not re.search(OPERATORS, re.sub(r"\{[^{}]*\}", "", left)):
                s = right.strip()
    try:
        return _Reader(s).value()
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


@F.pandas_udf(T.DoubleType())
def evaluate_udf(s: pd.Series) -> pd.Series:
    """Each distinct text of a batch once."""
    values = {t: evaluate(t) for t in s.dropna().unique()}
    return s.map(values).astype("float64")


def full_numeric_value(c: Column) -> Column:
    """The full evaluator for what :func:`fast_value` cannot read."""
    return numeric_value(c)

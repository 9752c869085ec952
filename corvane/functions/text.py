"""Text functions over columns: answers, tags, steps, verdicts, predicates.

All are compositions of built-in expressions, so they stay inside generated
code and are pushed down with the plan they stand in. Java regular expressions
are used with ASCII classes; null gives null unless said otherwise.
"""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns that define the results of this module.
MULTIPLE_CHOICE = r"(?:(?:[(\s]|^)[A-D][\s).][^A-D]*){4}"
BOXED_OPEN = r"\\boxed\{"
#: A closed ``\boxed{}`` whose content nests braces up to three deep: nearly all are. Deeper ones are counted out.
BOXED = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"
CJK = r"[\x{4e00}-\x{9fff}]"
CYRILLIC = r"[\x{0400}-\x{04ff}]"
TRUE_VERDICTS = ("correct", "right", "valid", "solution is good")
FALSE_VERDICTS = ("incorrect", "wrong", "error", "mistake")
#: Patterns of code that is refused, and what is said of each.
BANNED_CODE = (
    (r"os\.system", "Contains potentially unsafe system call"),
    (r"subprocess\.", "Contains potentially unsafe subprocess call"),
    (r"exec\s*\(", "Contains potentially unsafe exec call"),
    (r"eval\s*\(", "Contains potentially unsafe eval call"),
    (r"__import__", "Contains potentially unsafe dynamic import"),
    (r"open\s*\(.+,\s*['\"]w", "Contains file write operation"),
    (r"import\s+requests", "Contains network request library"),
)
#: White space at the ends of a text: that of Unicode, not of ASCII alone.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
COMPUTES = r"\bdef\b|\bprint\b|\breturn\b|=\s*[a-zA-Z0-9_]+"
CODE_PYTHON, CODE_BLOCK = r"(?s)```python\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```"
CODE_WORDS = r"\b(?:def|import|print|for|if|return)\b"
#: Ways to number a step, in the order in which they are tried.
STEP_NUMBERS = (r"^.*?Step\s*(\d+)[:.)\s]", r"^.*?(\d+)[:.)](?:\s|$)", r"^\s*(\d+)\.\s", r"^\s*\((\d+)\)\s", r"^\s*Step\s*(\d+)$")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and its expression planned
    once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def count_boxed(c: Column) -> Column:
    return F.regexp_count(c, F.lit(BOXED_OPEN))


def is_multiple_choice(c: Column) -> Column:
    return c.rlike(MULTIPLE_CHOICE)


def invalid_content(c: Column) -> Column:
    """'http', 'chinese', 'russian' or '', the first that applies."""
    return F.when(F.lower(c).contains("http"), "http").when(c.rlike(CJK), "chinese").when(c.rlike(CYRILLIC), "russian").otherwise("")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null, not '', where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def closed_length(tail: Column) -> Column:
    """Characters up to the brace that closes one opened just before ``tail``,
    at any depth; null if none does. Folds over braces, not over characters."""
    parts = F.regexp_extract_all(tail, F.lit(r"[{}]|[^{}]+"), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x == "{", 1).when(x == "}", -1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["n"] + F.when(depth == 0, 0).otherwise(F.length(x))).alias("n")))

    return F.aggregate(parts, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")), step, lambda a: F.when(a["depth"] == 0, a["n"]))


def matching_brace(c: Column, start: Column) -> Column:
    """Index (from 0) of the brace that closes the one at index ``start``, -1 if
    none does. Escapes are not special."""
    return F.coalesce(start + 1 + closed_length(F.substring(c, start + 2, F.length(c))), F.lit(-1))


def _deep_box(c: Column) -> Column:
    parts = F.split(c, BOXED_OPEN)
    tail = lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), "\\boxed{")
    found = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: let(tail(k), lambda t: F.left(t, closed_length(t))))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def boxed_answer(c: Column) -> Column:
    """Stripped content of the first closed ``\\boxed{}``, however deep its
    braces nest; an open one is passed over and the next is tried."""

    flat = F.regexp_instr(c, F.lit(BOXED)) == F.instr(c, "\\boxed{")  # not bound by let: a caller may hand the result to a Python function
    return strip(F.when(~c.contains("\\boxed{"), None).when(flat, F.regexp_extract(c, BOXED, 1)).otherwise(_deep_box(c)))


def marked_answer(c: Column) -> Column:
    """Stripped text between the first and the second ``####``."""
    return F.when(c.contains("####"), strip(F.split_part(c, F.lit("####"), F.lit(2))))


def answer(c: Column) -> Column:
    return F.coalesce(boxed_answer(c), marked_answer(c))


def tag_body(c: Column, tag: str) -> Column:
    """Stripped body of the first ``<tag>...</tag>``, null if there is none."""
    return strip(first_match(c, f"(?s)<{tag}>(.*?)</{tag}>"))


def has_tag(c: Column, tag: str) -> Column:
    return c.rlike(f"(?s)<{tag}>.*?</{tag}>")


def thinking(c: Column) -> Column:
    """Body of the first thinking or reasoning section; the names of the opening
    and the closing tag may differ."""
    return strip(first_match(c, r"(?s)<(?:thinking|reasoning)>(.*?)</(?:thinking|reasoning)>"))


def thinking_length(c: Column) -> Column:
    return F.coalesce(F.length(thinking(c)), F.lit(0))


def response(c: Column) -> Column:
    return tag_body(c, "response")


def tag_by_position(c: Column, tag: str) -> Column:
    """What stands between the first opening and the first closing tag."""
    start = F.instr(c, f"<{tag}>") + len(tag) + 2
    end = F.instr(c, f"</{tag}>")
    return F.when((F.instr(c, f"<{tag}>") > 0) & (end >= start), strip(F.substring(c, start, end - start)))


def code(c: Column) -> Column:
    """The first Python block, else the first fenced block, else the whole text
    if it has a Python keyword and no tag in small letters, else ''."""
    return let(
        F.coalesce(c, F.lit("")),
        lambda x: F.when(strip(x) == "", "")
        .when(x.rlike(CODE_PYTHON), F.regexp_extract(x, CODE_PYTHON, 1))
        .when(x.rlike(CODE_BLOCK), F.regexp_extract(x, CODE_BLOCK, 1))
        .when(x.rlike(CODE_WORDS) & ~x.rlike(r"<[a-z]+>"), x)
        .otherwise(""),
    )


def code_with_fallback(c: Column) -> Column:
    """Code of the response section, else of the whole text."""
    return let(code(response(c)), lambda x: F.when(x != "", x).otherwise(code(c)))


def code_problems(c: Column) -> Column:
    """What is said of the banned patterns that code holds, joined by '; '."""
    return F.concat_ws("; ", *[F.when(c.rlike(p), F.lit(said)) for p, said in BANNED_CODE])


@F.pandas_udf(T.StringType())
def _syntax_error(codes: pd.Series) -> pd.Series:
    """Why texts do not compile, null where they do; nothing is run."""

    def said(code: str | None) -> str | None:
        if code is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(code, "<string>", "exec", dont_inherit=True)
            return None
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            return str(e) or type(e).__name__

    return codes.map(said)


#: What is said of a program.
EMPTY_CODE, COMPUTES_NOTHING, FIT_CODE = "Empty code", "Code lacks meaningful computation or function definitions", "Code passed quality checks"


def code_quality(c: Column) -> Column:
    """struct(ok, message): empty, not compilable (with the error, whose wording
    follows the workers' Python), banned patterns joined by '; ', or nothing
    computed, the first that applies. Empty texts are not sent to be compiled."""
    x = F.coalesce(c, F.lit(""))
    said, empty = code_problems(x), strip(x) == ""
    error = _syntax_error(F.when(~empty, x))
    message = F.when(empty, EMPTY_CODE).when(error.isNotNull(), F.concat(F.lit("Syntax error: "), error)).when(said != "", F.concat(F.lit("Linting issues: "), said)).when(~computes(x), COMPUTES_NOTHING)
    return F.struct(message.isNull().alias("ok"), F.coalesce(message, F.lit(FIT_CODE)).alias("message"))


def has_code_problems(c: Column) -> Column:
    return c.rlike("|".join(p for p, _ in BANNED_CODE))


def computes(c: Column) -> Column:
    return c.rlike(COMPUTES)


def verdict_is_correct(c: Column) -> Column:
    """True, false or null. The words for true are looked for first, as parts of
    words: 'incorrect' holds 'correct'."""
    low = F.lower(c)

    def some(words):
        out = F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.when(some(TRUE_VERDICTS), True).when(some(FALSE_VERDICTS), False).when(low.rlike(r"step \d+"), False)


def verdict_step(c: Column) -> Column:
    """The step that a verdict names, if it holds exactly one integer."""
    found = F.regexp_extract_all(c, F.lit(r"\b\d+\b"), F.lit(0))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)).try_cast("int"))


def says_answer_is_correct(c: Column) -> Column:
    return F.lower(c).contains("answer is correct")


def mentions_any(c: Column, phrases: list[str]) -> Column:
    """Whether a text holds one of some phrases, whatever the case; no phrases
    gives false."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.lower(c).contains(p.lower())
    return out


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("bigint")


def flag(c: Column) -> Column:
    """'true' / 'false' in any case as a boolean, anything else null."""
    return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)


def is_repository_name(c: Column) -> Column:
    return c.rlike(r"^[^/]+/[^/]+$")


def md5_bucket(c: Column, n: int) -> Column:
    """A bucket 0..n-1 of a text that is the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def hash_order(seed: int, c: Column) -> Column:
    """Sort key of a seeded shuffle that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


# ---------------------------------------------------------------- steps


def step_numbers(c: Column) -> Column:
    """The N of all ``Step N``, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"Step (\d+)"), F.lit(1)), lambda x: x.cast("int"))


def step_number(c: Column) -> Column:
    """The number a step states, by the first way of numbering that fits."""
    return F.coalesce(*[F.when(c.rlike(p), F.regexp_extract(c, p, 1).try_cast("int")) for p in STEP_NUMBERS])


def numbered_sections(c: Column) -> Column:
    """Step sections that state a number ('Step 3:', in any case), at least 1."""
    return F.greatest(F.lit(1), F.size(F.filter(tagged_steps(c), lambda x: x.rlike(r"(?i)Step\s*\d+[:.)\s]"))))


def list_status(c: Column) -> Column:
    """struct(has_steps, is_ordered): whether the response section numbers its
    steps 'N. ', and whether the numbers rise."""

    def read(numbers: Column) -> Column:
        has = F.coalesce(F.size(numbers) > 0, F.lit(False))
        return F.struct(has.alias("has_steps"), (has & F.coalesce(strictly_increasing(numbers), F.lit(False))).alias("is_ordered"))

    found = F.regexp_extract_all(F.coalesce(response(c), F.lit("")), F.lit(r"(\d+)\.\s"), F.lit(1))
    return let(F.transform(found, lambda x: x.try_cast("decimal(38,0)")), read)


def max_step(c: Column) -> Column:
    return F.coalesce(F.array_max(step_numbers(c)), F.lit(0))


def tagged_steps(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?s)<step>(.*?)</step>"), F.lit(1))


def count_tagged_steps(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?i)<step>\s*step \d+:"))


def steps_are_valid(c: Column, start: int = 0) -> Column:
    """With step tags: each holds ``Step N`` with N = start + position and at
    least ten characters after it. Without: the numbers of all ``Step N``, each
    once and in any order, are start + 1 .. start + count."""
    tagged = tagged_steps(c)
    each = F.forall(
        F.transform(tagged, lambda s, i: (F.regexp_extract(s, r"Step (\d+)", 1) == (i + start + 1).cast("string")) & (F.length(strip(F.regexp_extract(s, r"(?s)Step \d+[:.]?(.*)$", 1))) >= 10)),
        lambda ok: ok,
    )
    numbers = step_numbers(c)
    n = F.size(numbers)
    untagged = (n > 0) & (F.array_sort(F.array_distinct(numbers)) == F.when(n > 0, F.sequence(F.lit(start + 1), n + start)))
    return F.when(F.size(tagged) > 0, each).otherwise(F.coalesce(untagged, F.lit(False)))


def unsalvageable(c: Column) -> Column:
    """Why no first wrong step can be looked for in a response, or null."""
    steps = F.regexp_extract_all(c, F.lit(r"(?s)<step>.*?</step>"), F.lit(0))
    inner = F.transform(tagged_steps(c), step_number)
    return (
        F.when(~c.contains("<step>"), "no_step_tags_in_response").when(F.size(steps) < 2, "insufficient_steps").when(F.exists(inner, lambda x: x.isNull()), "missing_step_numbers")
        .when(inner != F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), "non_sequential_step_numbers")
    )


def split_steps(c: Column) -> Column:
    """All tagged steps with their tags; else the parts at the word 'Step', the
    part before the first kept only if it speaks of an analysis or thinking."""
    tagged = F.transform(tagged_steps(c), lambda s: F.concat(F.lit("<step>"), s, F.lit("</step>")))
    parts = F.split(c, "Step")
    head = F.get(parts, F.lit(0))
    analysis = F.lower(head).contains("analysis") | head.contains("<thinking>")
    rest = F.transform(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: strip(p) != ""), lambda p: F.concat(F.lit("<step>Step"), p, F.lit("</step>")))
    untagged = F.when(analysis & (strip(head) != ""), F.concat(F.array(F.concat(F.lit("<step>"), strip(head), F.lit("</step>"))), rest)).otherwise(rest)
    return F.when(F.size(tagged) > 0, tagged).otherwise(untagged)


def prefixes(steps: Column) -> Column:
    """For each step, all steps up to it joined by a blank line."""
    return F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "\n\n"))).otherwise(F.array().cast("array<string>"))


def strictly_increasing(numbers: Column) -> Column:
    n = F.size(numbers)
    return F.when(n < 2, n >= 1).otherwise(F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get(numbers, i - 1) < F.get(numbers, i)))


def first_wrong_step(valid: Column) -> Column:
    """Index of the first wrong step from flags per step, walking from the
    middle: up to the first invalid one if the middle is valid, else down to the
    first valid one; null for fewer than two steps or if none is found."""
    n = F.size(valid)
    start = F.floor(n / 2).cast("int")
    index = F.sequence(F.lit(0), n - 1)
    up = F.array_min(F.filter(index, lambda i: (i >= start) & ~F.get(valid, i)))
    down = F.coalesce(F.array_max(F.filter(index, lambda i: (i < start) & F.get(valid, i))) + 1, F.lit(0))
    return F.when(n < 2, None).when(F.get(valid, start), up).otherwise(down)


def walk_to_wrong_step(state: Column) -> Column:
    """As :func:`first_wrong_step`, from a state per step: 'valid', 'invalid' or
    'verified', a right result by a continuation that is not valid, which ends
    the walk without a result wherever it is met."""
    n = F.size(state)
    start = F.floor(n / 2).cast("int")
    index = F.sequence(F.lit(0), n - 1)
    at = lambda i: F.get(state, i)
    up = F.array_min(F.filter(index, lambda i: (i >= start) & (at(i) != "valid")))
    down = F.array_max(F.filter(index, lambda i: (i < start) & (at(i) != "invalid")))
    rising = F.when(at(up) == "invalid", up)
    falling = F.when(down.isNull(), 0).when(at(down) == "valid", down + 1)
    return F.when(n < 2, None).when(at(start) == "valid", rising).when(at(start) == "invalid", falling)


def position_category(index: Column, n: Column) -> Column:
    return F.when(n <= 2, "short_solution").when(index == 0, "beginning").when(index == n - 1, "end").when(index < n / 3, "early").when(index < 2 * n / 3, "middle").otherwise("late")


# ---------------------------------------------------------------- lookups


def lookup(table: Column, key: Column, default: Column) -> Column:
    """The value of a key in a map, or a default where the key is not there."""
    return F.coalesce(F.try_element_at(table, key), default)


def first_or_self(nested: Column, alone: Column) -> Column:
    """The first of a nested list, or the value itself where it is no list."""
    return F.coalesce(F.get(nested, F.lit(0)), alone)

"""Registration of queries: a function of a table loader, and the SQL that says
the same on the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Load = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None):
    """Register ``fn(t)``, where ``t(name)`` loads a table."""

    def register(fn: Callable[[Load], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- shared SQL of the oracle

#: Attempts, each natural key once.
ATT = "att AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id, attempt_number ORDER BY logged_at, finished_at) AS _r FROM attempts) WHERE _r = 1)"
#: The most frequent answer of each problem of a run, ties to the first seen.
VOTES = """per AS (SELECT id, run_id, model_answer, count(*) AS c, min(attempt_number) AS f FROM att WHERE model_answer IS NOT NULL GROUP BY id, run_id, model_answer),
votes AS (SELECT id, run_id, model_answer AS majority_answer, c AS majority_count, valid_count, distinct_answers, coalesce(second_count, 0) AS second_count FROM (
  SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY c DESC, f) AS r, CAST(sum(c) OVER (PARTITION BY id, run_id) AS BIGINT) AS valid_count, count(*) OVER (PARTITION BY id, run_id) AS distinct_answers,
    lead(c) OVER (PARTITION BY id, run_id ORDER BY c DESC, f) AS second_count FROM per) WHERE r = 1)"""
STATS = """stats AS (SELECT a.id, a.run_id, count(*) AS total_solutions, count(*) FILTER (WHERE is_correct) AS correct_solutions, coalesce(bool_or(is_correct AND model_answer = majority_answer), false) AS is_most_common_correct
  FROM att a LEFT JOIN votes v ON a.id = v.id AND a.run_id = v.run_id GROUP BY a.id, a.run_id)"""
KEYS = ["id", "run_id"]

BOXED_SQL = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*)\}"


#: White space by the Unicode standard's property, and the separators of ASCII.
BLANK_SQL = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g')"


def boxed_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{BOXED_SQL}') THEN {strip_sql(f"regexp_extract({x}, '{BOXED_SQL}', 1)")} END"


def marked_sql(x: str) -> str:
    return f"CASE WHEN contains({x}, '####') THEN {strip_sql(f"split_part({x}, '####', 2)")} END"


def answer_sql(x: str) -> str:
    return f"coalesce({boxed_sql(x)}, {marked_sql(x)})"


def tag_sql(x: str, tag: str) -> str:
    p = f"(?s)<{tag}>(.*?)</{tag}>"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN {strip_sql(f"regexp_extract({x}, '{p}', 1)")} END"


def clean_sql(x: str) -> str:
    from corvane.functions.numeric import DROPPED

    s = strip_sql(rf"regexp_replace(regexp_replace({x}, '\\textbf\{{([^{{}}]*)\}}', '\1', 'g'), '{DROPPED}', '', 'g')")
    return s


def number_sql(x: str, source: str) -> str:
    """``SELECT *, v`` over ``source`` (a CTE name): v is the number in ``x``."""
    from corvane.functions.numeric import FRACTION, PLAIN, REFUSED, ROOT, TIMES_PI

    single = r"NOT regexp_matches(regexp_replace({0}, '\{{[^{{}}]*\}}', '', 'g'), '[+\-*/^]')"
    eq = r"'^(.*)=([^=]*)$'"
    ap = r"'^(.*)\\approx(.*)$'"
    fac = lambda p: f"CASE WHEN regexp_extract(s2, '{p}', 1) IN ('', '+') THEN 1.0 WHEN regexp_extract(s2, '{p}', 1) = '-' THEN -1.0 ELSE TRY_CAST(regexp_extract(s2, '{p}', 1) AS DOUBLE) END"
    return f"""SELECT * EXCLUDE (s0, s1, s2), CASE WHEN {x} IS NULL OR regexp_matches({x}, '{REFUSED}') THEN NULL WHEN regexp_matches(s2, '{PLAIN}') THEN TRY_CAST(s2 AS DOUBLE)
    WHEN regexp_matches(s2, '{FRACTION}') THEN (CASE WHEN regexp_extract(s2, '{FRACTION}', 1) = '-' THEN -1.0 ELSE 1.0 END) * TRY_CAST(regexp_extract(s2, '{FRACTION}', 2) AS DOUBLE) / nullif(TRY_CAST(regexp_extract(s2, '{FRACTION}', 3) AS DOUBLE), 0)
    WHEN regexp_matches(s2, '{ROOT}') THEN ({fac(ROOT)}) * sqrt(TRY_CAST(regexp_extract(s2, '{ROOT}', 2) AS DOUBLE)) WHEN regexp_matches(s2, '{TIMES_PI}') THEN ({fac(TIMES_PI)}) * pi() END AS v
  FROM (SELECT *, CASE WHEN contains(s1, '\\approx') AND {single.format(f"regexp_extract(s1, {ap}, 1)")} THEN {strip_sql(f"regexp_extract(s1, {ap}, 2)")} ELSE s1 END AS s2
  FROM (SELECT *, CASE WHEN contains(s0, '=') AND {single.format(f"regexp_extract(s0, {eq}, 1)")} THEN {strip_sql(f"regexp_extract(s0, {eq}, 2)")} ELSE s0 END AS s1
  FROM (SELECT *, {clean_sql(x)} AS s0 FROM {source})))""".replace("'\\\\approx') AND", "'\\approx') AND")


#: Texts with every kind of tag, made from lineitem; the expression is the same in both engines.
COMPLETION = """concat(CASE WHEN l_linenumber % 4 <> 0 THEN concat('<thinking>Analysis of part ', cast(l_partkey as string), '</thinking>', chr(10)) ELSE '' END,
 CASE WHEN l_returnflag <> 'R' THEN concat('<response>Step 1: take the first number', chr(10), 'Step ', cast(l_linenumber % 3 + 1 as string), ': the result is ', chr(92), 'boxed{', cast(cast(l_quantity as bigint) as string), '}</response>', chr(10)) ELSE '' END,
 CASE WHEN l_linestatus = 'O' THEN concat('<verdict>Step ', cast(l_linenumber as string), ' is wrong</verdict>', chr(10)) WHEN l_linenumber % 2 = 0 THEN concat('<verdict>The answer is correct</verdict>', chr(10)) ELSE '' END,
 CASE WHEN l_suppkey % 3 = 0 THEN concat('<proof>Since ', cast(l_linenumber as string), ' is a number</proof>', chr(10)) ELSE '' END,
 CASE WHEN l_suppkey % 3 <> 2 THEN concat('<code>x = ', cast(l_partkey as string), '</code>', chr(10)) ELSE '' END,
 CASE WHEN l_partkey % 3 <> 0 THEN '<test>assert solve() == 1</test>' ELSE '' END, CASE WHEN l_partkey % 4 <> 0 THEN '<implementation>def solve(): return 1</implementation>' ELSE '' END,
 CASE WHEN l_partkey % 5 = 0 THEN concat(chr(10), '```python', chr(10), 'import os', chr(10), 'print(', cast(l_linenumber as string), ')', chr(10), '```') WHEN l_partkey % 5 = 1 THEN concat(chr(10), '```', chr(10), 'os.system(1)', chr(10), '```') ELSE '' END)"""
_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"
COMPLETIONS = f"""comp AS (SELECT l_orderkey AS id, CAST(row_number() OVER ({_ORDER}) AS BIGINT) AS n, {COMPLETION} AS completion, cast(l_orderkey % 50 + 1 as string) AS answer, l_quantity AS value,
 l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag, abs(l_quantity - (l_orderkey % 50 + 1)) <= 5 AS is_correct, l_linestatus = 'O' AS test_passed, l_returnflag <> 'R' AS verified FROM lineitem)"""


def completions(t: Load) -> DataFrame:
    li = t("lineitem")
    view = f"_corvane_{uuid.uuid4().hex}"
    li.createTempView(view)
    try:
        return li.sparkSession.sql("WITH " + COMPLETIONS.replace("FROM lineitem", f"FROM {view}") + " SELECT * FROM comp")
    finally:
        li.sparkSession.catalog.dropTempView(view)

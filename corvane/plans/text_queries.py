"""Queries over texts: filters, extraction, steps, tags, aliases, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X
from corvane.operators import filters as L
from corvane.plans.registry import COMPLETIONS, answer_sql, boxed_sql, completions, marked_sql, number_sql, query, strip_sql, tag_sql
from corvane.plans.vote_queries import ATT, attempts
from corvane.sources.io import union_by_name

_P = "problems"
_MC = X.MULTIPLE_CHOICE
_KIND = "CASE WHEN contains(lower({0}), 'http') THEN 'http' WHEN regexp_matches({0}, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'chinese' WHEN regexp_matches({0}, '[\\x{{0400}}-\\x{{04ff}}]') THEN 'russian' ELSE '' END"
_BOXES = r"CAST(len(regexp_extract_all({0}, '\\boxed\{{')) AS INTEGER)"
_TAGGED = f"""n0 AS (SELECT *, {boxed_sql("solution")} AS got FROM problems), n1 AS ({number_sql("got", "n0")}), tagged AS (SELECT *, CASE WHEN problem IS NULL OR solution IS NULL THEN 'missing' WHEN length(problem) > 2000 THEN 'too_long' WHEN regexp_matches(problem, '{_MC}') THEN 'multiple_choice'
 WHEN {_BOXES.format("solution")} = 0 THEN 'no_boxed' WHEN {_BOXES.format("solution")} > 1 THEN 'multiple_boxed' WHEN ({_KIND.format("problem")}) <> '' THEN 'invalid_problem' WHEN ({_KIND.format("solution")}) <> '' THEN 'invalid_solution' WHEN coalesce(got, '') = '' THEN 'empty_answer' WHEN v IS NULL THEN 'not_numeric' END AS reason FROM n1)"""


def _tagged(t):
    missing = ("missing", F.col("problem").isNull() | F.col("solution").isNull())
    return L.waterfall(t(_P), [missing, *L.standard_rules()])


@query("filter_waterfall_rows", f"WITH {_TAGGED} SELECT id, reason FROM tagged")
def filter_waterfall_rows(t):
    return _tagged(t).select("id", "reason")


@query("filter_waterfall_report", f"WITH {_TAGGED} SELECT coalesce(reason, '(kept)') AS reason, count(*) AS n FROM tagged GROUP BY 1")
def filter_waterfall_report(t):
    return L.report(_tagged(t))


@query("filter_reduction", f"WITH {_TAGGED} SELECT count(*) AS original, count(*) FILTER (WHERE reason IS NULL) AS kept, round(100.0 * count(*) FILTER (WHERE reason IS NOT NULL) / count(*), 1) AS reduction_pct FROM tagged")
def filter_reduction(t):
    return L.reduction(_tagged(t))


@query("source_filter", "SELECT id, source FROM problems WHERE source = 'olymp_alpha'")
def source_filter(t):
    return t(_P).where(F.col("source") == "olymp_alpha").select("id", "source")


@query("length_filter", "SELECT doc_id, CAST(length(text) AS INTEGER) AS len FROM documents WHERE length(text) <= 2000")
def length_filter(t):
    return t("documents").where(F.length("text") <= 2000).select("doc_id", F.length("text").alias("len"))


@query("multiple_choice_flag", f"SELECT id, regexp_matches(problem, '{_MC}') AS is_multiple_choice FROM problems")
def multiple_choice_flag(t):
    return t(_P).select("id", X.is_multiple_choice(F.col("problem")).alias("is_multiple_choice"))


@query("boxed_count", f"SELECT id, {_BOXES.format('solution')} AS n_boxed FROM problems")
def boxed_count(t):
    return t(_P).select("id", X.count_boxed(F.col("solution")).alias("n_boxed"))


@query("boxed_extract", f"SELECT id, {boxed_sql('solution')} AS boxed FROM problems")
def boxed_extract(t):
    return t(_P).select("id", X.boxed_answer(F.col("solution")).alias("boxed"))


@query("hash_marked_answer", f"SELECT id, {marked_sql('solution')} AS marked, {answer_sql('solution')} AS answer FROM problems")
def hash_marked_answer(t):
    return t(_P).select("id", X.marked_answer(F.col("solution")).alias("marked"), X.answer(F.col("solution")).alias("answer"))


@query("invalid_content", f"SELECT 'raw' AS origin, id, {_KIND.format('solution')} AS kind FROM raw_problems UNION ALL SELECT 'problems', id, {_KIND.format('problem')} FROM problems")
def invalid_content(t):
    raw = t("raw_problems").select(F.lit("raw").alias("origin"), "id", X.invalid_content(F.col("solution")).alias("kind"))
    return raw.unionByName(t(_P).select(F.lit("problems").alias("origin"), "id", X.invalid_content(F.col("problem")).alias("kind")))


_EQ = f"CASE WHEN len(regexp_extract_all(a, '=')) >= 2 THEN NULL WHEN len(regexp_extract_all(a, '=')) = 1 THEN {strip_sql("split_part(a, '=', 2)")} ELSE a END"


@query("equals_rule", f"SELECT id, fetched_at, {_EQ} AS answer FROM (SELECT id, fetched_at, coalesce(answer, correct_answer) AS a FROM raw_problems)")
def equals_rule(t):
    return t("raw_problems").select("id", "fetched_at", L.equals_rule(F.coalesce("answer", "correct_answer")).alias("answer"))


@query("numeric_fast_path", f"WITH x AS ({number_sql('answer', 'problems')}) SELECT id, round(v, 6) AS numeric_value FROM x")
def numeric_fast_path(t):
    return t(_P).select("id", F.round(N.numeric_value(F.col("answer")), 6).alias("numeric_value"))


@query("numeric_full", f"WITH x AS ({number_sql('answer', 'problems')}) SELECT id, answer, round(v, 6) AS numeric_value FROM x")
def numeric_full(t):
    return t(_P).select("id", "answer", F.round(N.full_numeric_value(F.col("answer")), 6).alias("numeric_value"))


@query("alias_normalise", "SELECT id, coalesce(problem, question) AS problem, solution, coalesce(source, 'unknown') AS source, coalesce(answer, correct_answer) AS answer FROM raw_problems WHERE coalesce(problem, question) IS NOT NULL AND solution IS NOT NULL")
def alias_normalise(t):
    return L.normalise_aliases(t("raw_problems"))


@query("derived_solution", r"SELECT id, coalesce(solution, '\boxed{' || coalesce(answer, correct_answer) || '}') AS solution FROM raw_problems")
def derived_solution(t):
    return t("raw_problems").select("id", F.coalesce("solution", F.concat(F.lit("\\boxed{"), F.coalesce("answer", "correct_answer"), F.lit("}"))).alias("solution"))


@query("schema_union", "SELECT id, problem, answer, CAST(NULL AS VARCHAR) AS question, lang FROM problems UNION ALL SELECT id, problem, answer, question, NULL FROM raw_problems")
def schema_union(t):
    return union_by_name(t(_P).select("id", "problem", "answer", "lang"), t("raw_problems").select("id", "problem", "answer", "question")).select("id", "problem", "answer", "question", "lang")


@query("include_semi", "SELECT id, split_name FROM problems WHERE split_name <> 'test' AND problem IN (SELECT problem FROM problems WHERE split_name = 'test')")
def include_semi(t):
    p = t(_P)
    return L.include(p.where("split_name <> 'test'"), p.where("split_name = 'test'")).select("id", "split_name")


@query("exclude_anti", "SELECT id, split_name FROM problems p WHERE split_name = 'train' AND NOT EXISTS (SELECT 1 FROM problems q WHERE q.split_name <> 'train' AND q.problem = p.problem)")
def exclude_anti(t):
    p = t(_P)
    return L.exclude(p.where("split_name = 'train'"), p.where("split_name <> 'train'")).select("id", "split_name")


# ---------------------------------------------------------------- steps

_TAGGED_STEPS = "regexp_extract_all(model_solution, '(?s)<step>(.*?)</step>', 1)"


@query("step_numbers", f"WITH {ATT} SELECT id, run_id, attempt_number, array_to_string(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1), ',') AS numbers, coalesce(CAST(list_max(list_transform(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER), 0) AS max_step FROM att WHERE model_solution IS NOT NULL")
def step_numbers(t):
    a = attempts(t).where("model_solution is not null")
    return a.select("id", "run_id", "attempt_number", F.array_join(F.transform(X.step_numbers(F.col("model_solution")), lambda x: x.cast("string")), ",").alias("numbers"), X.max_step(F.col("model_solution")).alias("max_step"))


@query("steps_increasing", f"""WITH {ATT}, x AS (SELECT id, run_id, attempt_number, list_transform(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1), lambda x: CAST(x AS INTEGER)) AS s FROM att WHERE model_solution IS NOT NULL)
 SELECT id, run_id, attempt_number, len(s) >= 1 AND len(list_filter(list_zip(s[1:len(s)-1], s[2:len(s)]), lambda p: p[1] >= p[2])) = 0 AS increasing FROM x""")
def steps_increasing(t):
    return attempts(t).where("model_solution is not null").select("id", "run_id", "attempt_number", X.strictly_increasing(X.step_numbers(F.col("model_solution"))).alias("increasing"))


@query("step_validate", f"""WITH {ATT}, x AS (SELECT *, {_TAGGED_STEPS} AS g, list_transform(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1), lambda x: CAST(x AS INTEGER)) AS s FROM att WHERE model_solution IS NOT NULL)
 SELECT id, run_id, attempt_number, CASE WHEN len(g) > 0 THEN len(list_filter(list_zip(g, range(1, len(g) + 1)), lambda p: NOT (regexp_extract(p[1], 'Step ([0-9]+)', 1) = CAST(p[2] AS VARCHAR) AND length({strip_sql(r"regexp_extract(p[1], '(?s)Step [0-9]+[:.]?(.*)$', 1)")}) >= 10))) = 0
  ELSE len(s) > 0 AND list_sort(list_distinct(s)) = CAST(range(1, len(s) + 1) AS INTEGER[]) END AS valid FROM x""")
def step_validate(t):
    return attempts(t).where("model_solution is not null").select("id", "run_id", "attempt_number", X.steps_are_valid(F.col("model_solution")).alias("valid"))


_PARTS = """regexp_split_to_array(model_solution, 'Step')"""
_SPLIT = f"""x AS (SELECT id, run_id, attempt_number, {_TAGGED_STEPS} AS g, {_PARTS} AS p FROM att WHERE model_solution IS NOT NULL),
 y AS (SELECT *, list_transform(list_filter(p[2:len(p)], lambda q: {strip_sql('q')} <> ''), lambda q: '<step>Step' || q || '</step>') AS rest, (contains(lower(p[1]), 'analysis') OR contains(p[1], '<thinking>')) AND {strip_sql('p[1]')} <> '' AS head FROM x),
 z AS (SELECT id, run_id, attempt_number, CASE WHEN len(g) > 0 THEN list_transform(g, lambda q: '<step>' || q || '</step>') WHEN head THEN list_concat(['<step>' || {strip_sql('p[1]')} || '</step>'], rest) ELSE rest END AS steps FROM y)"""


@query("step_split", f"WITH {ATT}, {_SPLIT} SELECT id, run_id, attempt_number, CAST(len(steps) AS INTEGER) AS n_steps, md5(array_to_string(steps, '|')) AS steps_md5 FROM z")
def step_split(t):
    s = attempts(t).where("model_solution is not null").withColumn("steps", X.split_steps(F.col("model_solution")))
    return s.select("id", "run_id", "attempt_number", F.size("steps").alias("n_steps"), F.md5(F.array_join("steps", "|")).alias("steps_md5"))


@query("step_prefixes", f"WITH {ATT}, {_SPLIT} SELECT id, run_id, attempt_number, i AS step_no, md5(array_to_string(steps[1:i], chr(10) || chr(10))) AS prefix_md5 FROM (SELECT id, run_id, attempt_number, steps, CAST(unnest(range(1, len(steps) + 1)) AS INTEGER) AS i FROM z)")
def step_prefixes(t):
    s = attempts(t).where("model_solution is not null").withColumn("pre", X.prefixes(X.split_steps(F.col("model_solution"))))
    return s.select("id", "run_id", "attempt_number", F.posexplode("pre").alias("p", "prefix")).select("id", "run_id", "attempt_number", (F.col("p") + 1).alias("step_no"), F.md5("prefix").alias("prefix_md5"))


@query("first_wrong_step", f"""WITH {COMPLETIONS}, x AS (SELECT id, n - 1 AS i, is_correct OR verified AS ok, count(*) OVER (PARTITION BY id) AS c FROM comp), y AS (SELECT id, c, CAST(floor(c / 2.0) AS BIGINT) AS m, bool_or(ok AND i = CAST(floor(c / 2.0) AS BIGINT)) AS mid,
  min(i) FILTER (WHERE NOT ok AND i >= CAST(floor(c / 2.0) AS BIGINT)) AS up, max(i) FILTER (WHERE ok AND i < CAST(floor(c / 2.0) AS BIGINT)) AS down FROM x GROUP BY id, c)
 SELECT id, CAST(CASE WHEN c < 2 THEN NULL WHEN mid THEN up ELSE coalesce(down + 1, 0) END AS INTEGER) AS wrong_step, CASE WHEN c < 2 THEN NULL ELSE mid END AS middle_valid FROM y""")
def first_wrong_step(t):
    from corvane.operators.votes import fan_in

    ok = completions(t).withColumn("ok", F.col("is_correct") | F.col("verified"))
    v = fan_in(ok, ["id"], "n", "ok").select("id", F.transform("attempts", lambda x: x["ok"]).alias("v"))
    mid = F.when(F.size("v") >= 2, F.get("v", F.floor(F.size("v") / 2).cast("int")))
    return v.select("id", X.first_wrong_step(F.col("v")).cast("int").alias("wrong_step"), mid.alias("middle_valid"))


# ---------------------------------------------------------------- tags, code, verdicts


@query("tag_sections", f"WITH {COMPLETIONS} SELECT id, n, {tag_sql('completion', 'response')} AS response, {tag_sql('completion', 'verdict')} AS verdict, {tag_sql('completion', 'proof')} AS proof, {tag_sql('completion', 'code')} AS code, contains(completion, '<thinking>') AS has_thinking FROM comp")
def tag_sections(t):
    c = F.col("completion")
    return completions(t).select("id", "n", *[X.tag_body(c, k).alias(k) for k in ("response", "verdict", "proof", "code")], X.has_tag(c, "thinking").alias("has_thinking"))


_THINK = r"(?s)<(?:thinking|reasoning)>(.*?)</(?:thinking|reasoning)>"


@query("thinking_length_stats", f"""WITH {ATT}, x AS (SELECT *, coalesce(length(CASE WHEN regexp_matches(model_solution, '{_THINK}') THEN {strip_sql(f"regexp_extract(model_solution, '{_THINK}', 1)")} END), 0) AS n FROM att)
 SELECT run_id, round(coalesce(avg(n), 0), 6) AS avg_all, round(coalesce(avg(n) FILTER (WHERE is_correct), 0), 6) AS avg_correct, round(coalesce(avg(n) FILTER (WHERE NOT is_correct), 0), 6) AS avg_incorrect FROM x GROUP BY run_id""")
def thinking_length_stats(t):
    n = F.col("n")
    a = attempts(t).withColumn("n", X.thinking_length(F.col("model_solution")))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return a.groupBy("run_id").agg(mean(n).alias("avg_all"), mean(F.when(F.col("is_correct"), n)).alias("avg_correct"), mean(F.when(~F.col("is_correct"), n)).alias("avg_incorrect"))


_PY, _FENCE = X.CODE_PYTHON, X.CODE_BLOCK
_CODE = rf"""CASE WHEN {strip_sql('completion')} = '' THEN '' WHEN regexp_matches(completion, '{_PY}') THEN regexp_extract(completion, '{_PY}', 1) WHEN regexp_matches(completion, '{_FENCE}') THEN regexp_extract(completion, '{_FENCE}', 1)
 WHEN regexp_matches(completion, '{X.CODE_WORDS}') AND NOT regexp_matches(completion, '<[a-z]+>') THEN completion ELSE '' END"""


@query("code_extract", f"WITH {COMPLETIONS} SELECT id, n, {_CODE} AS code FROM comp")
def code_extract(t):
    return completions(t).select("id", "n", X.code(F.col("completion")).alias("code"))


_QUOTED = [(p.replace("'", "''"), said) for p, said in X.BANNED_CODE]
_BANNED = ", ".join(f"CASE WHEN regexp_matches(code, '{p}') THEN '{said}' END" for p, said in _QUOTED)


@query("code_quality_patterns", rf"WITH {COMPLETIONS}, x AS (SELECT id, n, {_CODE} AS code FROM comp) SELECT id, n, concat_ws('; ', {_BANNED}) AS problems, regexp_matches(code, '{X.COMPUTES}') AS computes FROM x")
def code_quality_patterns(t):
    c = completions(t).select("id", "n", X.code(F.col("completion")).alias("code"))
    return c.select("id", "n", X.code_problems(F.col("code")).alias("problems"), X.computes(F.col("code")).alias("computes"))


_VERDICT = r"CASE WHEN contains(lower(v), 'correct') OR contains(lower(v), 'right') OR contains(lower(v), 'valid') OR contains(lower(v), 'solution is good') THEN true WHEN contains(lower(v), 'incorrect') OR contains(lower(v), 'wrong') OR contains(lower(v), 'error') OR contains(lower(v), 'mistake') THEN false WHEN regexp_matches(lower(v), 'step [0-9]+') THEN false END"


@query("verdict_classify", rf"WITH {COMPLETIONS}, x AS (SELECT id, n, {tag_sql('completion', 'verdict')} AS v FROM comp) SELECT id, n, {_VERDICT} AS is_correct, CASE WHEN len(regexp_extract_all(v, '\b[0-9]+\b')) = 1 THEN CAST(regexp_extract(v, '\b[0-9]+\b') AS INTEGER) END AS step, contains(lower(v), 'answer is correct') AS says_correct FROM x")
def verdict_classify(t):
    v = completions(t).select("id", "n", X.tag_body(F.col("completion"), "verdict").alias("v"))
    return v.select("id", "n", X.verdict_is_correct(F.col("v")).alias("is_correct"), X.verdict_step(F.col("v")).alias("step"), X.says_answer_is_correct(F.col("v")).alias("says_correct"))


@query("set_checks", f"WITH {ATT}, x AS (SELECT id, run_id, attempt_number, list_transform(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1), lambda x: CAST(x AS INTEGER)) AS s, model_solution FROM att WHERE model_solution IS NOT NULL) SELECT id, run_id, attempt_number, len(s) > 0 AND list_sort(list_distinct(s)) = CAST(range(1, len(s) + 1) AS INTEGER[]) AS complete, regexp_matches(model_solution, '[\\x{{4e00}}-\\x{{9fff}}]') AS has_cjk, regexp_matches(model_solution, '[\\x{{0400}}-\\x{{04ff}}]') AS has_cyrillic FROM x")
def set_checks(t):
    s = F.col("model_solution")
    n = X.step_numbers(s)
    full = (F.size(n) > 0) & F.coalesce(F.array_sort(F.array_distinct(n)) == F.when(F.size(n) > 0, F.sequence(F.lit(1), F.size(n))), F.lit(False))
    return attempts(t).where("model_solution is not null").select("id", "run_id", "attempt_number", full.alias("complete"), s.rlike(X.CJK).alias("has_cjk"), s.rlike(X.CYRILLIC).alias("has_cyrillic"))


_MISC = r"""SELECT id, contains(coalesce(solution, ''), '\boxed') AS has_boxed, CAST(greatest(1, len(list_filter(regexp_extract_all(coalesce(solution, ''), '(?s)<step>(.*?)</step>', 1), lambda b: regexp_matches(b, '(?i)Step\s*[0-9]+[:.)\s]')))) AS INTEGER) AS manual_steps, left(problem, 200) AS preview, contains(lower(problem), 'how many') OR contains(lower(problem), 'determine') AS mentions,
 regexp_matches(source, '^[^/]+/[^/]+$') AS is_repository, TRY_CAST(answer AS HUGEINT) AS as_int, CAST(length(problem) // 4 AS BIGINT) AS token_estimate, CAST(('0x' || substr(md5(problem), 1, 8)) AS UBIGINT) % 20 AS bucket FROM problems"""


@query("scalar_misc", _MISC.replace("CAST(('0x' || substr(md5(problem), 1, 8)) AS UBIGINT) % 20", "CAST(CAST(('0x' || substr(md5(problem), 1, 8)) AS UBIGINT) % 20 AS BIGINT)").replace("TRY_CAST(answer AS HUGEINT)", "CASE WHEN regexp_matches(answer, '^\\s*[+-]?[0-9]+\\s*$') THEN CAST(CAST(trim(answer) AS HUGEINT) AS VARCHAR) END"))
def scalar_misc(t):
    s = F.coalesce("solution", F.lit(""))
    as_int = N.int_value(F.col("answer")).cast("string")
    return t(_P).select(
        "id", s.contains("\\boxed").alias("has_boxed"), X.numbered_sections(s).alias("manual_steps"), F.left("problem", F.lit(200)).alias("preview"), X.mentions_any(F.col("problem"), ["how many", "determine"]).alias("mentions"),
        X.is_repository_name(F.col("source")).alias("is_repository"), as_int.alias("as_int"), X.token_estimate(F.col("problem")).alias("token_estimate"), X.md5_bucket(F.col("problem"), 20).cast("bigint").alias("bucket"),
    )

"""Queries of the run report and of what goes with it, over attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X
from corvane.operators import filters as L
from corvane.operators import mixture as M
from corvane.operators import pipelines as P
from corvane.operators import rewards as W
from corvane.operators import runstats as R
from corvane.operators import votes as V
from corvane.plans.registry import ATT, KEYS, query, strip_sql, tag_sql
from corvane.plans.run_queries import _NUM_SQL
from corvane.plans.text_queries import _SPLIT
from corvane.plans.vote_queries import attempts

_EARLY = "attempt_number <= total_attempts // 2"


def _halves(t):
    """Attempts with ``early``: in the first half of their problem's."""
    return attempts(t).withColumn("early", F.col("attempt_number") <= F.expr("total_attempts div 2"))


def _flags(cond: Column, name: str) -> Column:
    """The flags of some attempts in order, null where there are none."""
    rows = F.array_sort(F.collect_list(F.when(cond, F.struct("attempt_number", F.coalesce("is_correct", F.lit(False)).alias("ok")))))
    return F.when(F.count_if(cond) > 0, F.transform(rows, lambda x: x["ok"])).alias(name)


def _half_vote(side: str) -> str:
    cond = _EARLY if side == "a" else f"NOT ({_EARLY})"
    return f"""{side}p AS (SELECT id, run_id, model_answer AS v, count(*) AS c, min(attempt_number) AS f FROM att WHERE model_answer IS NOT NULL AND {cond} GROUP BY ALL),
 {side} AS (SELECT id, run_id, v FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY c DESC, f) AS r FROM {side}p) WHERE r = 1)"""


_RATE = "round(coalesce(100.0 * {0} / nullif({1}, 0), 0), 6)"


@query("before_after_report", f"""WITH {ATT}, {_half_vote("a")}, {_half_vote("b")}, per AS (SELECT id, run_id, max(correct_answer) AS want, count(*) FILTER (WHERE {_EARLY}) AS n1, count(*) FILTER (WHERE {_EARLY} AND is_correct) AS c1, count(*) FILTER (WHERE NOT ({_EARLY})) AS n2,
  count(*) FILTER (WHERE NOT ({_EARLY}) AND is_correct) AS c2, count(*) FILTER (WHERE is_correct) AS c FROM att GROUP BY id, run_id),
 x AS (SELECT per.*, CASE WHEN n1 > 0 THEN c1 ELSE c END AS hits, coalesce(a.v = want, false) AS ok1, coalesce(b.v = want, false) AS ok2, per.run_id % 3 = 0 AND coalesce(b.v = want, false) AS twice FROM per LEFT JOIN a ON per.id = a.id AND per.run_id = a.run_id LEFT JOIN b ON per.id = b.id AND per.run_id = b.run_id)
 SELECT count(*) AS total, count(*) FILTER (WHERE hits > 0) AS at_least_one, CAST(sum(hits) AS BIGINT) AS total_correct, round(sum(hits) * 1.0 / count(*), 6) AS avg_correct, count(*) FILTER (WHERE twice OR ok1) AS initial_most_common_correct, count(*) FILTER (WHERE twice OR ok2) AS final_most_common_correct,
 CAST(sum(n1) AS BIGINT) AS total_initial_solutions, CAST(sum(c1) AS BIGINT) AS total_initial_correct, {_RATE.format("sum(c1)", "sum(n1)")} AS overall_initial_success_rate, count(*) FILTER (WHERE c1 > 0) AS examples_with_at_least_one_correct, {_RATE.format("count(*) FILTER (WHERE c1 > 0)", "count(*)")} AS examples_with_at_least_one_correct_rate,
 count(*) FILTER (WHERE ok1) AS initial_majority_correct_count, {_RATE.format("count(*) FILTER (WHERE ok1)", "count(*)")} AS initial_majority_correct_rate, CAST(sum(n2) AS BIGINT) AS total_final_solutions, CAST(sum(c2) AS BIGINT) AS total_final_correct, {_RATE.format("sum(c2)", "sum(n2)")} AS overall_final_success_rate,
 count(*) FILTER (WHERE ok2) AS final_majority_correct_count, {_RATE.format("count(*) FILTER (WHERE ok2)", "count(*)")} AS final_majority_correct_rate FROM x""")
def before_after_report(t):
    """The first half of a problem's attempts as the initial ones, the second as
    the final ones; runs divisible by three report one vote for both."""
    a = _halves(t)
    early = F.col("early")
    per = a.groupBy(*KEYS).agg(_flags(early, "initial_correctness"), _flags(~early, "final_correctness"), _flags(F.lit(True), "is_correct_list"), F.max("correct_answer").alias("want"))
    vote = lambda cond, name: V.majority(a.where(cond), KEYS, "model_answer", "attempt_number").select(*KEYS, F.col("majority_answer").alias(name))
    x = per.join(vote(early, "a"), KEYS, "left").join(vote(~early, "b"), KEYS, "left")
    right = lambda c: F.coalesce(F.col(c) == F.col("want"), F.lit(False))
    x = x.withColumns({"initial_majority_correct": right("a"), "final_majority_correct": right("b"), "is_most_common_correct": F.when(F.col("run_id") % 3 == 0, right("b"))})
    return R.before_and_after(x)


@query("match_sources", f"""WITH {ATT}, per AS (SELECT id, run_id, count(*) FILTER (WHERE {_EARLY}) AS n1, count(*) FILTER (WHERE {_EARLY} AND is_correct) AS c1, count(*) AS n, count(*) FILTER (WHERE is_correct) AS c, bool_or(is_correct) AS one FROM att GROUP BY id, run_id)
 SELECT id, run_id, CAST(CASE WHEN n1 > 0 THEN n1 WHEN run_id % 2 = 0 THEN n WHEN one IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_flags, CAST(CASE WHEN n1 > 0 THEN c1 WHEN run_id % 2 = 0 THEN c WHEN one THEN 1 ELSE 0 END AS INTEGER) AS n_true FROM per""")
def match_sources(t):
    """Which flags of a problem count: the initial ones, else all, else the one."""
    a = _halves(t)
    per = a.groupBy(*KEYS).agg(_flags(F.col("early"), "initial_correctness"), _flags(F.lit(True), "every"), F.bool_or("is_correct").alias("is_correct")).withColumn("is_correct_list", F.when(F.col("run_id") % 2 == 0, F.col("every")))
    m = R.matches(per)
    return per.select("id", "run_id", F.size(m).alias("n_flags"), F.size(F.filter(m, lambda x: x)).alias("n_true"))


@query("step_report", f"""WITH {ATT}, per AS (SELECT id, run_id, count(*) FILTER (WHERE NOT is_correct) AS bad, min(attempt_number - 1) FILTER (WHERE NOT is_correct) AS idx, max(total_attempts) AS n, avg((attempt_number - 1) * 1.0 / total_attempts) FILTER (WHERE NOT is_correct) AS place,
  avg(CASE WHEN contains(model_solution, '<thinking>') THEN 1.0 ELSE 0.0 END) AS th, avg(CASE WHEN contains(model_solution, '<response>') THEN 1.0 ELSE 0.0 END) AS re, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS score, count(*) FILTER (WHERE model_solution IS NULL) AS gone FROM att GROUP BY id, run_id)
 SELECT CAST(sum(CASE WHEN run_id % 2 = 0 THEN bad WHEN bad > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wrong_steps_found, round((coalesce(sum(place) FILTER (WHERE run_id % 2 = 0), 0) + coalesce(sum(idx * 1.0 / n) FILTER (WHERE run_id % 2 <> 0 AND idx >= 0 AND n > 0), 0))
  / nullif(count(place) FILTER (WHERE run_id % 2 = 0) + count(*) FILTER (WHERE run_id % 2 <> 0 AND idx >= 0 AND n > 0), 0), 6) AS avg_wrong_step_position, round(avg(score), 6) AS avg_completion_score, CAST(sum(CASE WHEN run_id % 2 = 0 THEN gone WHEN gone > 0 THEN 1 ELSE 0 END) AS BIGINT) AS unsalvageable_solutions,
  round(avg(th) FILTER (WHERE run_id % 2 = 0), 6) AS thinking_extraction_rate, round(avg(re) FILTER (WHERE run_id % 2 = 0), 6) AS response_extraction_rate FROM per""")
def step_report(t):
    """Even runs report sums and means for a problem, odd ones a single wrong
    step, as index and flag."""
    a = attempts(t)
    bad, i, s = ~F.col("is_correct"), F.col("attempt_number") - 1, F.col("model_solution")
    share = lambda tag: F.avg(F.when(s.contains(tag), 1.0).otherwise(0.0))
    per = a.groupBy(*KEYS).agg(
        F.count_if(bad).alias("bad"), F.min(F.when(bad, i)).alias("idx"), F.max("total_attempts").alias("n"), F.avg(F.when(bad, i / F.col("total_attempts"))).alias("place"),
        share("<thinking>").alias("th"), share("<response>").alias("re"), F.avg(F.when(F.col("is_correct"), 1.0).otherwise(0.0)).alias("score"), F.count_if(s.isNull()).alias("gone"),
    )
    many = F.col("run_id") % 2 == 0
    rows = per.select(
        F.when(many, F.col("bad").cast("int")).alias("wrong_steps_found"), F.when(~many, F.col("bad") > 0).alias("wrong_step_found"), F.when(many, F.col("place")).alias("avg_wrong_step_position"),
        F.when(~many, F.col("idx")).alias("wrong_step_index"), F.when(~many, F.col("n")).alias("total_steps"), F.when(many, F.col("score")).alias("avg_completion_score"), F.when(~many, F.col("score")).alias("completion_score"),
        F.when(many, F.col("gone").cast("int")).alias("unsalvageable_solutions"), F.when(~many, F.col("gone") > 0).alias("unsalvageable"), F.when(many, F.col("th")).alias("thinking_extraction_rate"), F.when(many, F.col("re")).alias("response_extraction_rate"),
    )
    return R.step_report(rows)


@query("majority_correct_tolerance", f"""WITH {ATT}, p AS (SELECT id, run_id, model_answer AS v, count(*) AS c, min(attempt_number) AS f FROM att WHERE model_answer IS NOT NULL GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY c DESC, f) AS r FROM p) WHERE r = 1),
 w AS (SELECT id, run_id, max(correct_answer) AS want FROM att GROUP BY id, run_id) SELECT m.id, m.run_id, v AS majority_answer, coalesce(CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL AND TRY_CAST(want AS DOUBLE) IS NOT NULL THEN abs(TRY_CAST(v AS DOUBLE) - TRY_CAST(want AS DOUBLE)) <= 0.01 ELSE trim(v) = trim(want) END, false) AS majority_correct
 FROM m JOIN w ON m.id = w.id AND m.run_id = w.run_id""")
def majority_correct_tolerance(t):
    a = attempts(t)
    want = a.groupBy(*KEYS).agg(F.max("correct_answer").alias("want"))
    v = V.majority(a, KEYS, "model_answer", "attempt_number").select(*KEYS, "majority_answer")
    return v.join(want, KEYS).select(*KEYS, "majority_answer", N.same_value(F.col("majority_answer"), F.col("want")).alias("majority_correct"))


@query("program_error_counts", f"""WITH {ATT}, x AS (SELECT *, CASE WHEN total_attempts % 2 = 0 THEN 'timed out after 10 s' ELSE 'exit code 1' END AS said FROM att)
 SELECT CASE WHEN NOT coalesce(contains(model_solution, 'Step'), false) THEN 'structure' WHEN model_answer IS NULL THEN 'syntax' WHEN is_correct IS NULL AND contains(said, 'timed out') THEN 'timeout' WHEN is_correct IS NULL THEN 'execution' ELSE 'ok' END AS error_class, count(*) AS n FROM x GROUP BY 1""")
def program_error_counts(t):
    a = attempts(t).withColumn("said", F.when(F.col("total_attempts") % 2 == 0, "timed out after 10 s").otherwise("exit code 1"))
    kind = W.error_class(F.col("model_solution").contains("Step"), F.col("model_answer").isNotNull(), F.col("is_correct").isNotNull(), F.col("said"))
    return a.groupBy(kind.alias("error_class")).agg(F.count("*").alias("n"))


@query("answered_counts", f"WITH {ATT} SELECT data_type, count(*) AS n, count(*) FILTER (WHERE {strip_sql('model_solution')} <> '') AS with_solution FROM att GROUP BY data_type")
def answered_counts(t):
    return attempts(t).groupBy("data_type").agg(F.count("*").alias("n"), F.count_if(X.strip(F.col("model_solution")) != "").alias("with_solution"))


_SEEN = "lpad(CAST(run_id AS VARCHAR), 12, '0') || lpad(CAST(id AS VARCHAR), 12, '0') || lpad(CAST(attempt_number AS VARCHAR), 6, '0')"


@query("top_answers", f"WITH {ATT} SELECT model_answer, count(*) AS n FROM att WHERE model_answer IS NOT NULL GROUP BY 1 ORDER BY n DESC, min({_SEEN}) LIMIT 10")
def top_answers(t):
    seen = F.concat(F.lpad(F.col("run_id").cast("string"), 12, "0"), F.lpad(F.col("id").cast("string"), 12, "0"), F.lpad(F.col("attempt_number").cast("string"), 6, "0"))
    return R.top_by_count(attempts(t).withColumn("seen", seen), "model_answer", 10, "seen")


_TYPE = "CASE (id + attempt_number) % 4 WHEN 0 THEN 'programming' WHEN 1 THEN 'finalization' WHEN 2 THEN 'solution' ELSE CASE WHEN id % 5 = 0 THEN 'tutor' ELSE 'solution' END END"


@query("scored_batches", f"""WITH {ATT}, x AS (SELECT *, {_TYPE} AS kind FROM att), b AS (SELECT id, run_id, CASE WHEN count(*) FILTER (WHERE kind = 'tutor') > 0 THEN 'tutor' WHEN count(*) FILTER (WHERE kind = 'programming') > 0 AND count(*) FILTER (WHERE kind = 'programming') >= count(*) FILTER (WHERE kind = 'finalization')
  AND count(*) FILTER (WHERE kind = 'programming') >= count(*) FILTER (WHERE kind = 'solution') THEN 'programming' WHEN count(*) FILTER (WHERE kind = 'finalization') > count(*) FILTER (WHERE kind = 'solution') THEN 'finalization' ELSE 'solution' END AS reward_type FROM x GROUP BY id, run_id),
 s AS (SELECT x.id, x.run_id, attempt_number, reward_type, CAST(CASE WHEN correct_answer IS NULL THEN 0 WHEN reward_type = 'solution' THEN CASE WHEN is_correct THEN 3.0 ELSE -1.0 END WHEN reward_type = 'programming' THEN CASE WHEN model_answer IS NULL THEN -0.2 ELSE 0.7 END WHEN reward_type = 'finalization' THEN CASE WHEN is_correct THEN 3.5 ELSE -0.5 END ELSE 0 END AS DOUBLE) AS reward
  FROM x JOIN b ON x.id = b.id AND x.run_id = b.run_id)
 SELECT id, run_id, attempt_number, reward_type, reward, round(CASE WHEN count(*) OVER w > 1 AND avg(reward) OVER w < 0 THEN greatest(0, reward) ELSE reward END, 6) AS adjusted FROM s WINDOW w AS (PARTITION BY id, run_id)""")
def scored_batches(t):
    """One reward type for each batch, its score for every row, clipped."""
    a = attempts(t).withColumn("kind", F.expr(_TYPE))
    ok = F.coalesce("is_correct", F.lit(False))
    rewards = {"solution": F.when(ok, 3.0).otherwise(-1.0), "programming": F.when(F.col("model_answer").isNull(), -0.2).otherwise(0.7), "finalization": F.when(ok, 3.5).otherwise(-0.5)}
    return W.scored(a, KEYS, rewards, "correct_answer", "kind").select("id", "run_id", "attempt_number", "reward_type", "reward", F.round("adjusted", 6).alias("adjusted"))


@query("guarded_rewards", f"""WITH {ATT}, b AS (SELECT id, run_id, count(*) AS n, count(model_solution) AS p, count(correct_answer) AS k, count(*) FILTER (WHERE is_correct) AS c FROM att GROUP BY id, run_id)
 SELECT id, run_id, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n = p AND n = k THEN c ELSE 0 END AS DOUBLE) AS total FROM b""")
def guarded_rewards(t):
    """Batches as arrays; unequal lengths give a 0 for each completion."""
    ordered = lambda c: F.collect_list(c)
    b = attempts(t).groupBy(*KEYS).agg(ordered("attempt_number").alias("c"), ordered("model_solution").alias("p"), ordered("correct_answer").alias("a"), ordered(F.when(F.col("is_correct"), 1.0).otherwise(0.0)).alias("r"))
    got = W.guarded(F.col("c"), F.col("p"), F.col("a"), F.col("r"))
    return b.select("id", "run_id", F.size("c").alias("n"), F.aggregate(got, F.lit(0.0), lambda x, y: x + y).alias("total"))


@query("list_status", rf"""WITH {ATT}, x AS (SELECT id, run_id, attempt_number, list_transform(regexp_extract_all(coalesce({tag_sql('model_solution', 'response')}, ''), '([0-9]+)\.\s', 1), lambda q: CAST(q AS HUGEINT)) AS s FROM att)
 SELECT id, run_id, attempt_number, len(s) > 0 AS has_steps, len(s) > 0 AND len(list_filter(list_zip(s[1:len(s)-1], s[2:len(s)]), lambda p: p[1] >= p[2])) = 0 AS is_ordered FROM x""")
def list_status(t):
    return attempts(t).select("id", "run_id", "attempt_number", X.list_status(F.col("model_solution")).alias("r")).select("id", "run_id", "attempt_number", "r.has_steps", "r.is_ordered")


@query("tagged_step_counts", rf"WITH {ATT} SELECT id, run_id, attempt_number, CAST(len(regexp_extract_all(coalesce(model_solution, ''), '(?i)<step>\s*step [0-9]+:')) AS INTEGER) AS tagged, CASE lower(CAST(is_correct AS VARCHAR)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag FROM att")
def tagged_step_counts(t):
    return attempts(t).select("id", "run_id", "attempt_number", X.count_tagged_steps(F.coalesce("model_solution", F.lit(""))).alias("tagged"), X.flag(F.upper(F.col("is_correct").cast("string"))).alias("flag"))


@query("validation_aliases", "SELECT id, coalesce(nullif(problem, ''), nullif(question, ''), '') AS problem, coalesce(solution, '') AS solution, coalesce(source, '') AS source, coalesce(nullif(answer, ''), nullif(correct_answer, ''), '') AS answer FROM raw_problems")
def validation_aliases(t):
    return L.normalise_validation(t("raw_problems"))


@query("code_preview", rf"WITH {ATT} SELECT id, run_id, attempt_number, left(problem, 200) AS problem_start, array_to_string(string_split(model_solution, chr(10))[1:10], chr(10)) AS first_lines FROM att WHERE model_solution IS NOT NULL")
def code_preview(t):
    """What a log shows of an attempt: 200 characters and ten lines."""
    lines = F.array_join(F.slice(F.split("model_solution", "\n"), 1, 10), "\n")
    return attempts(t).where("model_solution is not null").select("id", "run_id", "attempt_number", F.left("problem", F.lit(200)).alias("problem_start"), lines.alias("first_lines"))


_PROMPT = r"'<|im_start|>system\n' || {0} || '<|im_end|>\n<|im_start|>user\n' || problem || '<|im_end|>\n<|im_start|>assistant\n'"


@query("prompt_tasks", "WITH s(kind, said) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in M.SYSTEMS.items()) + f") SELECT id, kind AS example_type, md5({_PROMPT.format('said')}) AS prompt_md5, answer, '' AS partial_solution, '' AS model_answer, CAST(NULL AS BOOLEAN) AS is_correct, CAST(NULL AS INTEGER) AS wrong_step, 0 AS token_count FROM problems, s")
def prompt_tasks(t):
    """All simple tasks, each with its system text and constant columns."""
    parts = [M.examples(t("problems"), k) for k in M.SYSTEMS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "example_type", F.md5("prompt").alias("prompt_md5"), "answer", *M.UNUSED)


_WHY = f"CASE WHEN NOT contains(s, '<step>') THEN 'no_step_tags_in_response' WHEN len(g) < 2 THEN 'insufficient_steps' WHEN len(list_filter(nn, lambda q: q IS NULL)) > 0 THEN 'missing_step_numbers' WHEN nn <> CAST(range(1, len(g) + 1) AS INTEGER[]) THEN 'non_sequential_step_numbers' END"


@query("wrong_attempts", f"""WITH {ATT}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY attempt_number) AS r FROM att WHERE NOT is_correct AND model_solution IS NOT NULL) WHERE r <= 3), x AS (SELECT id, run_id, attempt_number, model_solution AS s, regexp_extract_all(model_solution, '(?s)<step>(.*?)</step>', 1) AS g FROM f),
 y AS (SELECT *, list_transform(g, lambda q: {_NUM_SQL}) AS nn FROM x), z AS (SELECT *, {_WHY} AS why FROM y)
 SELECT id, run_id, count(*) AS n_wrong, count(why) AS n_unsalvageable, min(attempt_number) FILTER (WHERE why IS NULL) AS first_usable, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reasons FROM z GROUP BY id, run_id""")
def wrong_attempts(t):
    a = attempts(t).withColumnRenamed("model_solution", "completion")
    return P.wrong_attempts(a, KEYS)


_STD = """a AS (SELECT id, run_id * 1000 + attempt_number AS n, model_solution AS completion, model_answer, is_correct FROM att)"""


@query("pipeline_standard_attempts", f"""WITH {ATT}, {_STD}, p AS (SELECT id, model_answer AS v, count(*) AS c, min(n) AS f FROM a WHERE model_answer IS NOT NULL GROUP BY 1, 2), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, f) AS r FROM p) WHERE r = 1),
 tl AS (SELECT id, round(avg(n), 6) AS avg_thinking, round(coalesce(avg(n) FILTER (WHERE is_correct), 0), 6) AS avg_thinking_correct FROM (SELECT id, is_correct, coalesce(length(CASE WHEN regexp_matches(completion, '(?s)<(?:thinking|reasoning)>(.*?)</(?:thinking|reasoning)>') THEN {strip_sql("regexp_extract(completion, '(?s)<(?:thinking|reasoning)>(.*?)</(?:thinking|reasoning)>', 1)")} END), 0) AS n FROM a) GROUP BY id)
 SELECT c.id, total, correct, success_rate, m.v AS majority_answer, m.c AS majority_count, hit AS majority_correct, avg_thinking, avg_thinking_correct FROM (SELECT id, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 6) AS success_rate FROM a GROUP BY id) c
 LEFT JOIN m ON c.id = m.id LEFT JOIN (SELECT a.id, coalesce(bool_or(is_correct AND model_answer = m.v), false) AS hit FROM a JOIN m ON a.id = m.id GROUP BY a.id) h ON c.id = h.id JOIN tl ON c.id = tl.id""")
def pipeline_standard_attempts(t):
    """The standard pipeline over received attempts and their answers as stored."""
    a = attempts(t).select("id", (F.col("run_id") * 1000 + F.col("attempt_number")).alias("n"), F.col("model_solution").alias("completion"), "model_answer", "is_correct")
    return P.standard(a, answered=True)


_ECHO = "Begin with the first calculation or operation"
_CHAT = r"'<|im_start|>system\nCheck it.<|im_end|>\n<|im_start|>user\n' || {0} || '<|im_end|>\n<|im_start|>assistant\n'"
_LF2 = "chr(10) || chr(10)"
_TUTOR_ASK = f"'Here is a mathematical problem and a proposed solution:' || {_LF2} || 'Problem:' || chr(10) || problem || {_LF2} || 'Proposed Solution:' || chr(10) || full_solution"
_STEP = "CASE WHEN NOT is_correct AND attempt_number % 2 = 1 THEN CAST(attempt_number AS VARCHAR) WHEN NOT is_correct THEN 'x' END"


@query("tutor_prompts", f"""WITH {ATT}, x AS (SELECT *, {tag_sql("model_solution", "response")} AS full_solution, CASE WHEN NOT is_correct AND attempt_number % 2 = 1 THEN attempt_number END AS step FROM att WHERE problem <> '' AND NOT contains(model_solution, '{_ECHO}')),
 y AS (SELECT *, {_CHAT.format(_TUTOR_ASK)} AS prompt FROM x WHERE full_solution IS NOT NULL AND (coalesce(is_correct, false) OR step IS NOT NULL) AND NOT (coalesce(is_correct, false) AND step IS NULL AND CAST(('0x' || substr(md5(problem), 1, 8)) AS UBIGINT) % 20 <> 0))
 SELECT id, run_id, attempt_number, md5(prompt) AS prompt_md5, full_solution, is_correct AS flag, CAST(step AS INTEGER) AS step, CAST(length(prompt) // 4 AS BIGINT) AS token_count FROM y WHERE length(prompt) // 4 <= 250""")
def tutor_prompts(t):
    """Flags and steps as texts, as files bring them; a limit that some exceed."""
    a = attempts(t).withColumn("wrong_step", F.expr(_STEP.replace("VARCHAR", "STRING"))).withColumn("is_correct", F.initcap(F.col("is_correct").cast("string")))
    return M.tutor_prompts(a, "Check it.", limit=250).select("id", "run_id", "attempt_number", F.md5("prompt").alias("prompt_md5"), "full_solution", "flag", "step", "token_count")


def _valid_sql(x: str) -> str:
    g = f"regexp_extract_all({x}, '(?s)<step>(.*?)</step>', 1)"
    s = f"list_transform(regexp_extract_all({x}, 'Step ([0-9]+)', 1), lambda q: CAST(q AS INTEGER))"
    body = strip_sql(r"regexp_extract(p[1], '(?s)Step [0-9]+[:.]?(.*)$', 1)")
    return f"CASE WHEN len({g}) > 0 THEN len(list_filter(list_zip({g}, range(1, len({g}) + 1)), lambda p: NOT (regexp_extract(p[1], 'Step ([0-9]+)', 1) = CAST(p[2] AS VARCHAR) AND length({body}) >= 10))) = 0 ELSE len({s}) > 0 AND list_sort(list_distinct({s})) = CAST(range(1, len({s}) + 1) AS INTEGER[]) END"


_FINAL_ASK = f"'Problem: ' || problem || {_LF2} || 'Partial Solution: ' || {{0}}"


_WRAPPED = "CASE WHEN contains(model_solution, '<response>') THEN model_solution ELSE concat('<response>', model_solution, '</response>') END"


@query("finalization_prompts", f"""WITH {ATT}, w AS (SELECT * REPLACE ({_WRAPPED} AS model_solution) FROM att WHERE model_solution IS NOT NULL), r AS (SELECT id, run_id, attempt_number, problem, {tag_sql("model_solution", "response")} AS resp FROM w WHERE is_correct AND problem <> '' AND NOT contains(model_solution, '{_ECHO}')),
 {_SPLIT.replace("model_solution", "resp").replace("FROM att WHERE resp IS NOT NULL", "FROM r WHERE resp <> ''")},
 k AS (SELECT r.*, steps, CAST(('0x' || substr(md5(CAST(r.id AS VARCHAR)), 1, 8)) AS UBIGINT) % (len(steps) - 1) + 1 AS cut FROM r JOIN z ON r.id = z.id AND r.run_id = z.run_id AND r.attempt_number = z.attempt_number WHERE len(steps) >= 2 AND {_valid_sql("resp")}),
 a AS (SELECT *, array_to_string(steps[1:cut], {_LF2}) AS part FROM k), b AS (SELECT * FROM a WHERE {_valid_sql("part")}),
 c AS (SELECT *, CASE WHEN 2 + length({_FINAL_ASK.format("part")}) // 4 >= 150 THEN 1 ELSE cut END AS split_no FROM b), d AS (SELECT *, array_to_string(steps[1:split_no], {_LF2}) AS partial_solution FROM c), e AS (SELECT *, {_CHAT.format(_FINAL_ASK.format("partial_solution"))} AS prompt FROM d WHERE 2 + length({_FINAL_ASK.format("partial_solution")}) // 4 < 150)
 SELECT id, run_id, attempt_number, CAST(split_no AS INTEGER) AS split_at, partial_solution, md5(array_to_string(steps, {_LF2})) AS full_md5, md5(prompt) AS prompt_md5, CAST(length(prompt) // 4 AS BIGINT) AS token_count FROM e WHERE length(prompt) // 4 <= 150""")
def finalization_prompts(t):
    """A limit at which some are cut to one step and some left out."""
    a = attempts(t).where("model_solution is not null").withColumn("model_solution", F.expr(_WRAPPED))
    f = M.finalization_prompts(a, "Check it.", limit=150)
    return f.select("id", "run_id", "attempt_number", "split_at", "partial_solution", F.md5("full_solution").alias("full_md5"), F.md5("prompt").alias("prompt_md5"), "token_count")


_POSITION = "CASE WHEN n <= 2 THEN 'short_solution' WHEN i = 0 THEN 'beginning' WHEN i = n - 1 THEN 'end' WHEN i < n / 3.0 THEN 'early' WHEN i < 2 * n / 3.0 THEN 'middle' ELSE 'late' END"
_FOUND = "why IS NULL AND attempt_number % 3 <> 0"


@query("step_problem_report", f"""WITH {ATT}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY attempt_number) AS r FROM att WHERE NOT is_correct AND model_solution IS NOT NULL) WHERE r <= 3), x AS (SELECT id, run_id, attempt_number, total_attempts AS n, attempt_number - 1 AS i, model_solution AS s, regexp_extract_all(model_solution, '(?s)<step>(.*?)</step>', 1) AS g FROM f),
 y AS (SELECT *, list_transform(g, lambda q: {_NUM_SQL}) AS nn FROM x), z AS (SELECT *, CASE WHEN attempt_number % 2 = 0 THEN {_WHY} END AS why FROM y), u AS (SELECT *, {_FOUND} AS hit, CASE WHEN {_FOUND} THEN {_POSITION} END AS cat FROM z),
 pd AS (SELECT id, run_id, string_agg(cat || '=' || c, ',' ORDER BY cat) AS d FROM (SELECT id, run_id, cat, count(*) AS c FROM u WHERE cat IS NOT NULL GROUP BY ALL) GROUP BY id, run_id), wd AS (SELECT id, run_id, string_agg(why || '=' || c, ',' ORDER BY why) AS d FROM (SELECT id, run_id, why, count(*) AS c FROM u WHERE why IS NOT NULL GROUP BY ALL) GROUP BY id, run_id),
 a AS (SELECT id, run_id, count(*) FILTER (WHERE hit) AS wrong_steps_found, round(coalesce(avg(i * 1.0 / n) FILTER (WHERE hit), 0), 6) AS avg_wrong_step_position, round(count(*) FILTER (WHERE hit) * 1.0 / count(*), 6) AS recovery_success_rate, count(why) AS unsalvageable_solutions, round(count(why) * 1.0 / count(*), 6) AS unsalvageable_rate FROM u GROUP BY id, run_id)
 SELECT a.*, coalesce(pd.d, '') AS positions, coalesce(wd.d, '') AS reasons FROM a LEFT JOIN pd ON a.id = pd.id AND a.run_id = pd.run_id LEFT JOIN wd ON a.id = wd.id AND a.run_id = wd.run_id""")
def step_problem_report(t):
    """First three wrong attempts of a problem; every second one has its steps
    checked, and of the usable ones those not divisible by three were traced to a
    step, that of their number."""
    a = V.first_k(attempts(t).where(~F.col("is_correct") & F.col("model_solution").isNotNull()), KEYS, "attempt_number", 3)
    a = a.withColumn("reason", F.when(F.col("attempt_number") % 2 == 0, X.unsalvageable(F.col("model_solution"))))
    hit = F.col("reason").isNull() & (F.col("attempt_number") % 3 != 0)
    a = a.withColumns({"wrong_step": F.when(hit, F.col("attempt_number") - 1), "total_steps": F.when(hit, F.col("total_attempts"))})
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    r = P.step_problem(a, KEYS)
    return r.select(*KEYS, "wrong_steps_found", "avg_wrong_step_position", "recovery_success_rate", "unsalvageable_solutions", "unsalvageable_rate", shown("position_distribution").alias("positions"), shown("unsalvageable_reasons").alias("reasons"))

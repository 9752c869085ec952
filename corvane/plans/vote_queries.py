"""Queries over attempts: votes, choices, run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X
from corvane.operators import runstats as R
from corvane.operators import votes as V
from corvane.plans.registry import ATT, COMPLETIONS, KEYS, STATS, VOTES, answer_sql, completions, number_sql, query, strip_sql


def attempts(t):
    return V.latest_only(t("attempts"), ["id", "run_id", "attempt_number"], "logged_at", "finished_at")


def _votes(a):
    return V.majority(a, KEYS, "model_answer", "attempt_number")


def _stats(t):
    a = attempts(t)
    return R.stat_rows(a, _votes(a), KEYS)


_PRE = f"WITH {ATT}, {VOTES}"
_AVG = "mean AS (SELECT sum(correct_solutions) AS s, count(*) AS n FROM stats WHERE correct_solutions > 0)"


@query("run_stats_basic", f"""{_PRE}, {STATS}, {_AVG} SELECT count(*) AS total, CAST(sum(total_solutions) AS BIGINT) AS attempts, CAST(sum(correct_solutions) AS BIGINT) AS correct, count(*) FILTER (WHERE correct_solutions > 0) AS at_least_one,
 round(100.0 * count(*) FILTER (WHERE correct_solutions > 0) / count(*), 6) AS pass_rate, round(CAST(sum(correct_solutions) AS DOUBLE) / count(*), 6) AS avg_correct, count(*) FILTER (WHERE is_most_common_correct) AS most_common_correct,
 count(*) FILTER (WHERE correct_solutions > 0 AND correct_solutions * mean.n > mean.s) AS above_average FROM stats, mean""")
def run_stats_basic(t):
    return R.run_statistics(_stats(t))


@query("pass_at_k_by_group", f"""{_PRE}, {STATS} SELECT total_solutions, count(*) AS problems, count(*) FILTER (WHERE correct_solutions > 0) AS passed, CAST(sum(correct_solutions) AS BIGINT) AS correct,
 round(100.0 * sum(correct_solutions) / sum(total_solutions), 6) AS success_rate FROM stats GROUP BY total_solutions""")
def pass_at_k_by_group(t):
    return _stats(t).groupBy("total_solutions").agg(F.count("*").alias("problems"), F.count_if(F.col("correct_solutions") > 0).alias("passed"), F.sum("correct_solutions").alias("correct"), R.ratio(F.sum("correct_solutions"), F.sum("total_solutions")).alias("success_rate"))


@query("majority_vote_string", f"{_PRE} SELECT id, run_id, majority_answer, majority_count, valid_count, distinct_answers, round(100.0 * majority_count / valid_count, 6) AS pct FROM votes")
def majority_vote_string(t):
    return _votes(attempts(t)).select("id", "run_id", "majority_answer", "majority_count", "valid_count", "distinct_answers", R.ratio(F.col("majority_count"), F.col("valid_count")).alias("pct"))


@query("majority_vote_tolerance", f"""WITH {ATT}, num AS ({number_sql("model_answer", "att")}), per AS (SELECT id, run_id, v, count(*) AS c, min(attempt_number) AS f FROM num WHERE v IS NOT NULL GROUP BY id, run_id, v),
 sc AS (SELECT a.id, a.run_id, a.v, a.f, a.c * CAST(sum(b.c) AS BIGINT) AS score FROM per a JOIN per b ON a.id = b.id AND a.run_id = b.run_id AND abs(a.v - b.v) <= 0.01 GROUP BY a.id, a.run_id, a.v, a.f, a.c)
 SELECT id, run_id, round(v, 6) AS majority_value, score FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY score DESC, f) AS r FROM sc) WHERE r = 1""")
def majority_vote_tolerance(t):
    a = attempts(t).withColumn("v", N.numeric_value(F.col("model_answer")))
    return V.majority_with_tolerance(a, KEYS, "v", "attempt_number").select("id", "run_id", F.round("majority_value", 6).alias("majority_value"), "score")


@query("majority_correct", f"{_PRE}, {STATS} SELECT id, run_id, is_most_common_correct, correct_solutions FROM stats")
def majority_correct(t):
    return _stats(t).select("id", "run_id", "is_most_common_correct", "correct_solutions")


@query("verified_majority_fallback", f"""WITH {ATT}, {VOTES}, vper AS (SELECT id, run_id, model_answer, count(*) AS c, min(attempt_number) AS f FROM att WHERE model_answer IS NOT NULL AND contains(model_solution, '\\boxed{{') GROUP BY id, run_id, model_answer),
 vv AS (SELECT id, run_id, model_answer AS va FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY c DESC, f) AS r FROM vper) WHERE r = 1)
 SELECT votes.id, votes.run_id, coalesce(va, majority_answer) AS final_answer, va IS NULL AS fell_back FROM votes LEFT JOIN vv ON votes.id = vv.id AND votes.run_id = vv.run_id""")
def verified_majority_fallback(t):
    a = attempts(t)
    verified = V.majority(a.where(F.col("model_solution").contains("\\boxed{")), KEYS, "model_answer", "attempt_number").select(*KEYS, F.col("majority_answer").alias("va"))
    return _votes(a).join(verified, KEYS, "left").select("id", "run_id", F.coalesce("va", "majority_answer").alias("final_answer"), F.col("va").isNull().alias("fell_back"))


@query("clear_winner", f"{_PRE} SELECT id, run_id, majority_answer, distinct_answers = 1 OR majority_count > second_count AS has_clear_winner FROM votes")
def clear_winner(t):
    v = _votes(attempts(t))
    return v.select("id", "run_id", "majority_answer", V.clear_winner(v).alias("has_clear_winner"))


_DUAL = "CASE WHEN is_correct AND model_answer = correct_answer THEN 1 WHEN is_correct THEN 2 WHEN contains(model_solution, 'Step 2') THEN 3 WHEN model_answer = correct_answer THEN 4 WHEN model_answer IS NOT NULL THEN 5 ELSE 6 END"


@query("best_of_priority_dual", f"WITH {ATT} SELECT id, run_id, attempt_number, priority FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY priority, attempt_number) AS r FROM (SELECT *, {_DUAL} AS priority FROM att)) WHERE r = 1")
def best_of_priority_dual(t):
    same = F.col("model_answer") == F.col("correct_answer")
    return V.best_by_priority(attempts(t), KEYS, [F.col("is_correct") & same, F.col("is_correct"), F.col("model_solution").contains("Step 2"), same, F.col("model_answer").isNotNull()], "attempt_number").select("id", "run_id", "attempt_number", "priority")


@query("best_of_priority_tests", f"WITH {COMPLETIONS} SELECT id, n, priority FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, n) AS r FROM (SELECT *, CASE WHEN is_correct AND test_passed THEN 1 WHEN is_correct THEN 2 WHEN test_passed THEN 3 ELSE 4 END AS priority FROM comp)) WHERE r = 1")
def best_of_priority_tests(t):
    c = F.col("is_correct")
    return V.best_by_priority(completions(t), ["id"], [c & F.col("test_passed"), c, F.col("test_passed")], "n").select("id", "n", "priority")


@query("first_correct_attempt", f"WITH {ATT} SELECT id, run_id, min(attempt_number) FILTER (WHERE is_correct) AS attempt_number, arg_min(md5(model_solution), attempt_number) FILTER (WHERE is_correct) AS solution_md5 FROM att GROUP BY id, run_id")
def first_correct_attempt(t):
    ok = F.when(F.col("is_correct"), F.col("attempt_number"))
    return attempts(t).groupBy(*KEYS).agg(F.min(ok).alias("attempt_number"), F.min_by(F.when(F.col("is_correct"), F.md5("model_solution")), ok).alias("solution_md5"))


@query("first_k_incorrect", f"WITH {ATT} SELECT id, run_id, attempt_number, model_answer FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY attempt_number) AS r FROM att WHERE NOT is_correct) WHERE r <= 3")
def first_k_incorrect(t):
    return V.first_k(attempts(t).where(~F.col("is_correct")), KEYS, "attempt_number", 3).select("id", "run_id", "attempt_number", "model_answer")


@query("attempt_numbering", f"WITH {ATT} SELECT id, run_id, finished_at, CAST(row_number() OVER (PARTITION BY id, run_id ORDER BY finished_at, attempt_number) AS BIGINT) AS attempt_no, count(*) OVER (PARTITION BY id, run_id) AS total FROM att")
def attempt_numbering(t):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS)
    return attempts(t).select("id", "run_id", "finished_at", F.row_number().over(w.orderBy("finished_at", "attempt_number")).cast("bigint").alias("attempt_no"), F.count("*").over(w).alias("total"))


@query("fan_in_fan_out", f"""WITH {ATT} SELECT id, run_id, role, CAST(p AS BIGINT) AS attempt_number, CAST(total AS BIGINT) AS total_attempts, model_answer FROM (SELECT id, run_id, model_answer, row_number() OVER (PARTITION BY id, run_id ORDER BY attempt_number) AS p, count(*) OVER (PARTITION BY id, run_id) AS total FROM att), (VALUES ('programmer'), ('tester')) AS x(role)""")
def fan_in_fan_out(t):
    folded = V.fan_in(attempts(t), KEYS, "attempt_number", "model_answer").withColumnRenamed("attempts", "a")
    rows = folded.select(*KEYS, F.size("a").alias("total"), F.posexplode("a").alias("p", "e"))
    return rows.select(*KEYS, F.explode(F.array(F.lit("programmer"), F.lit("tester"))).alias("role"), (F.col("p") + 1).cast("bigint").alias("attempt_number"), F.col("total").cast("bigint").alias("total_attempts"), F.col("e.model_answer").alias("model_answer"))


_INI = "ini AS (SELECT id, run_id, bool_or(is_correct) FILTER (WHERE attempt_number <= total_attempts / 2) AS b, bool_or(is_correct) FILTER (WHERE attempt_number > total_attempts / 2) AS a FROM att GROUP BY id, run_id)"


@query("improvement_flags", f"WITH {ATT}, {_INI.replace('total_attempts / 2', 'total_attempts // 2')} SELECT count(*) FILTER (WHERE NOT coalesce(b, false) AND coalesce(a, false)) AS improved, count(*) FILTER (WHERE coalesce(b, false) AND NOT coalesce(a, false)) AS worsened, count(*) FILTER (WHERE coalesce(b, false) AND coalesce(a, false)) AS kept_right, count(*) FILTER (WHERE NOT coalesce(b, false) AND NOT coalesce(a, false)) AS kept_wrong FROM ini")
def improvement_flags(t):
    early = F.col("attempt_number") <= F.expr("total_attempts div 2")
    per = attempts(t).groupBy(*KEYS).agg(F.bool_or(F.when(early, F.col("is_correct"))).alias("b"), F.bool_or(F.when(~early, F.col("is_correct"))).alias("a"))
    return R.transitions(per, F.col("b"), F.col("a"))


_HALF = "per1 AS (SELECT id, run_id, model_answer, count(*) AS c, min(attempt_number) AS f FROM att WHERE model_answer IS NOT NULL AND attempt_number <= total_attempts // 2 GROUP BY id, run_id, model_answer), v1 AS (SELECT id, run_id, model_answer AS a1 FROM (SELECT *, row_number() OVER (PARTITION BY id, run_id ORDER BY c DESC, f) AS r FROM per1) WHERE r = 1)"


@query("majority_improvement", f"""{_PRE}, {_HALF}, x AS (SELECT a.id, a.run_id, max(correct_answer) AS want, max(majority_answer) AS fin, max(a1) AS ini FROM att a LEFT JOIN votes v ON a.id = v.id AND a.run_id = v.run_id LEFT JOIN v1 ON a.id = v1.id AND a.run_id = v1.run_id GROUP BY a.id, a.run_id)
 SELECT count(*) FILTER (WHERE coalesce(fin = want, false) AND NOT coalesce(ini = want, false)) AS improved, count(*) FILTER (WHERE NOT coalesce(fin = want, false) AND coalesce(ini = want, false)) AS worsened, count(*) FILTER (WHERE coalesce(fin = want, false) AND coalesce(ini = want, false)) AS kept_right, count(*) FILTER (WHERE NOT coalesce(fin = want, false) AND NOT coalesce(ini = want, false)) AS kept_wrong FROM x""")
def majority_improvement(t):
    """The vote of the first half of the attempts against that of all."""
    a = attempts(t)
    ini = V.majority(a.where("attempt_number <= total_attempts div 2"), KEYS, "model_answer", "attempt_number").select(*KEYS, F.col("majority_answer").alias("ini"))
    fin = _votes(a).select(*KEYS, F.col("majority_answer").alias("fin"))
    x = a.groupBy(*KEYS).agg(F.max("correct_answer").alias("want")).join(fin, KEYS, "left").join(ini, KEYS, "left")
    return R.transitions(x, F.col("ini") == F.col("want"), F.col("fin") == F.col("want"))


@query("quality_change", f"""WITH {COMPLETIONS}, x AS (SELECT id, abs(sum(value - 25) FILTER (WHERE n = 1)) AS a, abs(sum(value - 25) FILTER (WHERE n = 2)) AS b FROM comp GROUP BY id)
 SELECT count(a) AS n_initial, count(b) AS n_final, round(avg(a), 6) AS avg_initial, round(avg(b), 6) AS avg_final, count(*) FILTER (WHERE b > a) AS improved, count(*) FILTER (WHERE b < a) AS worsened, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS pairs FROM x""")
def quality_change(t):
    """Sizes of a quality value before and after, over the pairs that have both."""
    v = F.col("value") - 25
    x = completions(t).groupBy("id").agg(F.abs(F.sum(F.when(F.col("n") == 1, v))).alias("a"), F.abs(F.sum(F.when(F.col("n") == 2, v))).alias("b"))
    return R.quality_change(x, "a", "b")


@query("two_model_comparison", f"""WITH {COMPLETIONS}, per AS (SELECT id, count(*) FILTER (WHERE is_correct AND l_linestatus = 'O') AS a, count(*) FILTER (WHERE is_correct AND l_linestatus <> 'O') AS b FROM comp GROUP BY id)
 SELECT count(*) AS problems, CAST(sum(a) AS BIGINT) AS first_correct, CAST(sum(b) AS BIGINT) AS second_correct, count(*) FILTER (WHERE a > 0 AND b > 0) AS "both", count(*) FILTER (WHERE a = 0 AND b = 0) AS neither, count(*) FILTER (WHERE (a > 0) <> (b > 0)) AS disagree,
 count(*) FILTER (WHERE a > 0 AND b = 0) AS first_better, count(*) FILTER (WHERE a = 0 AND b > 0) AS second_better, round(coalesce(100.0 * count(*) FILTER (WHERE a > 0 AND b = 0) / nullif(count(*) FILTER (WHERE (a > 0) <> (b > 0)), 0), 0), 6) AS first_win_rate FROM per""")
def two_model_comparison(t):
    c = F.col("is_correct")
    return R.two_models(completions(t), "id", c & (F.col("l_linestatus") == "O"), c & (F.col("l_linestatus") != "O"))


_SRC = "CASE WHEN is_correct AND model_answer = correct_answer THEN 'matching' WHEN model_answer = correct_answer THEN 'matching_incorrect' WHEN is_correct THEN 'code_fallback' WHEN model_answer IS NULL THEN 'invalid_solution' WHEN correct_answer IS NULL THEN 'null' ELSE 'code_fallback_incorrect' END"


@query("answer_source_counts", f"WITH {ATT} SELECT {_SRC} AS answer_source, count(*) AS n FROM att GROUP BY 1")
def answer_source_counts(t):
    return attempts(t).groupBy(F.expr(_SRC).alias("answer_source")).agg(F.count("*").alias("n"))


@query("above_average", f"{_PRE}, {STATS}, {_AVG} SELECT id, run_id, correct_solutions FROM stats, mean WHERE correct_solutions * n > s")
def above_average(t):
    return R.above_average(_stats(t), KEYS)


_POS = "CASE WHEN c <= 2 THEN 'short_solution' WHEN i = 0 THEN 'beginning' WHEN i = c - 1 THEN 'end' WHEN i < c / 3.0 THEN 'early' WHEN i < 2 * c / 3.0 THEN 'middle' ELSE 'late' END"


@query("position_stats", f"""WITH {ATT}, x AS (SELECT attempt_number - 1 AS i, total_attempts AS c, is_correct FROM att) SELECT {_POS} AS position_category, count(*) AS n, round(avg(i * 1.0 / c), 6) AS completion_score, count(*) FILTER (WHERE is_correct) AS correct FROM x GROUP BY 1""")
def position_stats(t):
    a = attempts(t).select((F.col("attempt_number") - 1).alias("i"), F.col("total_attempts").alias("c"), "is_correct")
    return a.groupBy(X.position_category(F.col("i"), F.col("c")).alias("position_category")).agg(F.count("*").alias("n"), F.round(F.avg(F.try_divide(F.col("i"), F.col("c"))), 6).alias("completion_score"), F.count_if("is_correct").alias("correct"))


@query("map_merge", f"WITH {ATT} SELECT coalesce(model_answer, '(none)') AS key, count(*) AS n FROM att GROUP BY 1")
def map_merge(t):
    per = attempts(t).groupBy("id", F.coalesce("model_answer", F.lit("(none)")).alias("k")).agg(F.count("*").alias("c"))
    maps = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    return R.merge_counts(maps, "m")


@query("test_verification_stats", f"""WITH {COMPLETIONS}, per AS (SELECT id, bool_or(test_passed) AS tp, bool_or(verified) AS vc, bool_or(is_correct) AS ini, bool_or(is_correct AND test_passed) AS fin, count(*) AS n, count(*) FILTER (WHERE is_correct) AS c FROM comp GROUP BY id)
 SELECT count(*) AS problems, count(*) FILTER (WHERE tp) AS test_passed_count, count(*) FILTER (WHERE vc) AS verified_correct_count, round(100.0 * count(*) FILTER (WHERE tp) / count(*), 6) AS test_passed_rate, count(*) FILTER (WHERE fin) - count(*) FILTER (WHERE ini) AS testing_improvement,
 CAST(sum(n) AS BIGINT) AS total_solutions, CAST(sum(c) AS BIGINT) AS correct_solutions FROM per""")
def test_verification_stats(t):
    c = F.col("is_correct")
    per = completions(t).groupBy("id").agg(F.bool_or("test_passed").alias("tp"), F.bool_or("verified").alias("vc"), F.bool_or(c).alias("ini"), F.bool_or(c & F.col("test_passed")).alias("fin"), F.count("*").alias("n"), F.count_if(c).alias("c"))
    return per.agg(F.count("*").alias("problems"), F.count_if("tp").alias("test_passed_count"), F.count_if("vc").alias("verified_correct_count"), R.ratio(F.count_if("tp"), F.count("*")).alias("test_passed_rate"), (F.count_if("fin") - F.count_if("ini")).alias("testing_improvement"), F.sum("n").alias("total_solutions"), F.sum("c").alias("correct_solutions"))


@query("judge_stats", f"WITH {ATT} SELECT run_id, count(is_correct) AS judge_decisions, round(avg(CASE WHEN is_correct THEN 1.0 WHEN NOT is_correct THEN 0.0 END), 6) AS judge_accuracy FROM att GROUP BY run_id")
def judge_stats(t):
    return attempts(t).groupBy("run_id").agg(F.count("is_correct").alias("judge_decisions"), F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("judge_accuracy"))


@query("error_class_counts", rf"WITH {ATT} SELECT CASE WHEN model_solution IS NULL OR {strip_sql('model_solution')} = '' THEN 'empty' WHEN model_answer IS NULL THEN 'no_answer' WHEN is_correct IS NULL THEN 'unknown' WHEN is_correct THEN 'ok' ELSE 'wrong' END AS error_class, count(*) AS n FROM att GROUP BY 1")
def error_class_counts(t):
    s = F.col("model_solution")
    kind = F.when(s.isNull() | (X.strip(s) == ""), "empty").when(F.col("model_answer").isNull(), "no_answer").when(F.col("is_correct").isNull(), "unknown").when(F.col("is_correct"), "ok").otherwise("wrong")
    return attempts(t).groupBy(kind.alias("error_class")).agg(F.count("*").alias("n"))


@query("verified_counts", f"WITH {COMPLETIONS} SELECT id, count(*) AS n, count(*) FILTER (WHERE test_passed AND verified) AS both_flags, bool_or(test_passed AND verified) AS any_both, bool_and(test_passed AND verified) AS all_both, count(*) FILTER (WHERE verified) AS masked FROM comp GROUP BY id")
def verified_counts(t):
    arrays = V.fan_in(completions(t), ["id"], "n", "test_passed", "verified", "value").select("id", F.transform("attempts", lambda x: x["test_passed"]).alias("a"), F.transform("attempts", lambda x: x["verified"]).alias("b"), F.transform("attempts", lambda x: x["value"]).alias("v"))
    both = F.zip_with("a", "b", lambda x, y: x & y)
    masked = F.filter(F.arrays_zip("v", "b"), lambda x: x["b"])
    return arrays.select("id", F.size("a").cast("bigint").alias("n"), F.size(F.filter(both, lambda x: x)).cast("bigint").alias("both_flags"), F.exists(both, lambda x: x).alias("any_both"), F.forall(both, lambda x: x).alias("all_both"), F.size(masked).cast("bigint").alias("masked"))


@query("verify_answers", f"""WITH {ATT}, m AS ({number_sql("model_answer", "att")}), m1 AS (SELECT * RENAME (v AS mv) FROM m), c AS ({number_sql("correct_answer", "m1")})
 SELECT id, run_id, attempt_number, CASE WHEN mv IS NOT NULL AND v IS NOT NULL THEN abs(mv - v) <= 0.01 ELSE coalesce(trim(model_answer) = trim(correct_answer), false) END AS verified FROM c""")
def verify_answers(t):
    return attempts(t).select("id", "run_id", "attempt_number", N.same_answer(F.col("model_answer"), F.col("correct_answer")).alias("verified"))


@query("verify_solutions", f"""WITH {ATT}, s AS (SELECT id, run_id, attempt_number, correct_answer, {answer_sql("model_solution")} AS stated FROM att), m AS ({number_sql("stated", "s")}), m1 AS (SELECT * RENAME (v AS sv) FROM m), c AS ({number_sql("correct_answer", "m1")})
 SELECT id, run_id, attempt_number, coalesce(abs(sv - v) <= 0.01, false) AS ok, stated FROM c""")
def verify_solutions(t):
    a = attempts(t).select("id", "run_id", "attempt_number", N.verify(F.col("model_solution"), F.col("correct_answer")).alias("r"))
    return a.select("id", "run_id", "attempt_number", "r.ok", "r.stated")


@query("success_rates", f"WITH {ATT} SELECT id, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE NOT is_correct) AS incorrect, count(*) FILTER (WHERE is_correct IS NULL) AS unknown, count(*) FILTER (WHERE is_correct) = count(*) AS all_correct, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 6) AS success_rate FROM att GROUP BY id")
def success_rates(t):
    return V.success(attempts(t), ["id"]).withColumn("success_rate", F.round("success_rate", 6))


@query("step_problem_stats", f"""WITH {ATT}, x AS (SELECT id, len(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1)) AS n, is_correct FROM att WHERE model_solution IS NOT NULL AND data_type = 'training' AND problem IS NOT NULL AND correct_solution IS NOT NULL)
 SELECT id, count(*) AS attempts, CAST(sum(n) AS BIGINT) AS steps, CAST(max(n) AS BIGINT) AS most_steps, count(*) FILTER (WHERE n < 2) AS unsalvageable, round(100.0 * count(*) FILTER (WHERE n < 2) / count(*), 6) AS unsalvageable_rate FROM x GROUP BY id""")
def step_problem_stats(t):
    a = attempts(t).where("model_solution is not null and data_type = 'training' and problem is not null and correct_solution is not null").withColumn("n", F.size(X.step_numbers(F.col("model_solution"))))
    return a.groupBy("id").agg(F.count("*").alias("attempts"), F.sum("n").alias("steps"), F.max("n").cast("bigint").alias("most_steps"), F.count_if(F.col("n") < 2).alias("unsalvageable"), R.ratio(F.count_if(F.col("n") < 2), F.count("*")).alias("unsalvageable_rate"))

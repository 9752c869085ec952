"""Queries over orders, batches, rewards, mixtures, vectors and pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import numeric as N
from corvane.functions import text as X
from corvane.operators import mixture as M
from corvane.operators import ordering as O
from corvane.operators import pipelines as P
from corvane.operators import rewards as W
from corvane.operators import runstats as R
from corvane.operators import similarity as S
from corvane.operators import votes as V
from corvane.plans.registry import ATT, COMPLETIONS, completions, query, tag_sql
from corvane.plans.text_queries import _CODE, _QUOTED, _SPLIT
from corvane.plans.vote_queries import attempts

_TOTAL = ["run_id", "id", "attempt_number"]
_RN = "rn0 AS (SELECT *, row_number() OVER (ORDER BY run_id, id, attempt_number) AS rn FROM att)"

# ---------------------------------------------------------------- order, batches


@query("sort_and_take", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_and_take(t):
    return t("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("slice_rows", "SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn > 1000 AND rn <= 2500")
def slice_rows(t):
    return O.with_row_number(t("orders").select("o_orderkey"), "o_orderkey").where("rn > 1000 and rn <= 2500")


@query("row_ids", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR) AS new_id FROM orders")
def row_ids(t):
    return O.with_row_number(t("orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", (F.col("rn") - 1).cast("string").alias("new_id"))


@query("trailing_batch", f"WITH {ATT} SELECT run_id, id, attempt_number, is_correct FROM att ORDER BY run_id DESC, id DESC, attempt_number DESC LIMIT 100")
def trailing_batch(t):
    return O.trailing(attempts(t).select("run_id", "id", "attempt_number", "is_correct"), 100, *_TOTAL)


_BATCH = f"{ATT}, {_RN}, b AS (SELECT CAST(floor((rn - 1) / 100.0) AS BIGINT) AS batch_no, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct FROM rn0 GROUP BY 1)"


def _batches(t):
    return O.batches(attempts(t).select("run_id", "id", "attempt_number", "is_correct"), 100, *_TOTAL).groupBy("batch_no").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("correct"))


@query("checkpoint_batches", f"WITH {_BATCH} SELECT batch_no, n, correct FROM b")
def checkpoint_batches(t):
    return _batches(t)


@query("accumulated_stats", f"WITH {_BATCH} SELECT batch_no, n, correct, CAST(sum(n) OVER (ORDER BY batch_no) AS BIGINT) AS total_n, CAST(sum(correct) OVER (ORDER BY batch_no) AS BIGINT) AS total_correct FROM b")
def accumulated_stats(t):
    return O.accumulate(_batches(t), ["n", "correct"])


@query("counter_delta", "WITH x AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS c FROM events GROUP BY 1, 2), y AS (SELECT event_type, h, CAST(sum(c) OVER (PARTITION BY event_type ORDER BY h) AS BIGINT) AS cum FROM x) SELECT event_type, h, cum, cum - lag(cum, 1, 0) OVER (PARTITION BY event_type ORDER BY h) AS delta FROM y")
def counter_delta(t):
    w = Window.partitionBy("event_type").orderBy("h")
    x = t("events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count("*").alias("c"))
    y = x.select("event_type", "h", F.sum("c").over(w).alias("cum"))
    return y.withColumn("delta", F.col("cum") - F.lag("cum", 1, 0).over(w))


@query("group_context", f"WITH {ATT} SELECT run_id, id, attempt_number, CAST(row_number() OVER (PARTITION BY id, run_id ORDER BY attempt_number) - 1 AS BIGINT) AS group_idx, count(*) OVER (PARTITION BY id, run_id) AS group_size, count(*) FILTER (WHERE is_correct) OVER (PARTITION BY id, run_id) AS group_correct FROM att")
def group_context(t):
    w = Window.partitionBy("id", "run_id")
    return attempts(t).select("run_id", "id", "attempt_number", (F.row_number().over(w.orderBy("attempt_number")) - 1).cast("bigint").alias("group_idx"), F.count("*").over(w).alias("group_size"), F.count_if("is_correct").over(w).alias("group_correct"))


# ---------------------------------------------------------------- rewards

_RESP = tag_sql("completion", "response")
_GOT = r"TRY_CAST(regexp_extract(completion, '\\boxed\{([0-9]+)\}', 1) AS DOUBLE)"
_EXACT = f"coalesce(abs({_GOT} - CAST(answer AS DOUBLE)) <= 1e-6, false)"
_LEN = "coalesce(length({0}), 0) * 1e-5"


def _reward(t, col):
    return completions(t).select("id", "n", F.round(col, 8).alias("reward"))


@query("reward_solution", f"WITH {COMPLETIONS} SELECT id, n, round(CASE WHEN {_GOT} IS NOT NULL AND contains(completion, '<thinking>') AND {_RESP} IS NOT NULL THEN (CASE WHEN {_EXACT} THEN 3.0 ELSE 0.0 END) + (CASE WHEN l_linenumber % 3 = 1 THEN 0.2 ELSE 0.0 END) - {_LEN.format(_RESP)} ELSE 0.0 END, 8) AS reward FROM comp")
def reward_solution(t):
    return _reward(t, W.solution(F.col("completion"), F.col("answer")))


@query("reward_programming", f"WITH {COMPLETIONS}, x AS (SELECT *, {_CODE} AS code FROM comp) SELECT id, n, round(CASE WHEN code = '' THEN 0.0 WHEN NOT verified THEN -0.2 WHEN NOT test_passed THEN 0.2 ELSE 0.7 + (CASE WHEN is_correct THEN 2.5 ELSE 0.0 END) - {_LEN.format('code')} END, 8) AS reward FROM x")
def reward_programming(t):
    return _reward(t, W.programming(F.col("completion"), F.col("verified"), F.col("test_passed"), F.col("is_correct")))


@query("reward_finalization", f"WITH {COMPLETIONS} SELECT id, n, round(CASE WHEN {_RESP} IS NULL OR l_linenumber % 2 = 1 THEN 0.0 ELSE (CASE WHEN {_EXACT} THEN 3.0 ELSE 0.0 END) + 0.5 - {_LEN.format('completion')} END, 8) AS reward FROM comp")
def reward_finalization(t):
    partial = F.when(F.col("l_linenumber") % 2 == 0, F.lit("Intro"))
    return _reward(t, W.finalization(F.col("completion"), partial, F.col("answer")))


_PLAN = "CASE WHEN l_suppkey % 2 = 0 THEN concat('Recommended Approach: ', completion) ELSE completion END"


@query("reward_architect", f"WITH {COMPLETIONS}, x AS (SELECT *, coalesce({_RESP}, {_PLAN}) AS r, CAST(l_partkey % 11 AS BIGINT) AS ok FROM comp) SELECT id, n, round(CASE WHEN length(r) > 100 AND contains(r, 'Recommended Approach') THEN 0.2 + (CASE WHEN ok > 0 THEN 0.5 ELSE 0.0 END) + ok * 0.25 - {_LEN.format('r')} ELSE -0.2 END, 8) AS reward FROM x")
def reward_architect(t):
    plan = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Recommended Approach: "), "completion")).otherwise(F.col("completion"))
    return _reward(t, W.architect(plan, F.col("l_partkey") % 11))


@query("reward_test", f"WITH {COMPLETIONS}, x AS (SELECT *, {_CODE} AS code FROM comp) SELECT id, n, round(CASE WHEN code = '' THEN 0.0 WHEN NOT verified THEN -0.2 ELSE 0.2 + (CASE WHEN test_passed THEN 3.0 ELSE 0.0 END) - {_LEN.format('code')} END, 8) AS reward FROM x")
def reward_test(t):
    return _reward(t, W.test_programming(F.col("completion"), F.col("verified"), F.col("test_passed")))


_V = tag_sql("completion", "verdict")


@query("reward_tutor", rf"""WITH {COMPLETIONS}, x AS (SELECT *, {_V} AS vd FROM comp), y AS (SELECT *, coalesce(CASE WHEN is_correct THEN contains(lower(vd), 'correct') ELSE len(regexp_extract_all(vd, '\b[0-9]+\b')) = 1 AND TRY_CAST(regexp_extract(vd, '\b[0-9]+\b') AS BIGINT) = l_linenumber END, false) AS ok FROM x)
 SELECT id, n, round(CASE WHEN vd IS NULL THEN 0.0 ELSE (CASE WHEN ok THEN 0.8 ELSE 0.0 END) + (CASE WHEN NOT is_correct AND verified THEN CASE WHEN ok THEN 3.0 ELSE 2.0 END ELSE 0.0 END) - {_LEN.format('completion')} END, 8) AS reward FROM y""")
def reward_tutor(t):
    return _reward(t, W.tutor(F.col("completion"), F.col("is_correct"), F.col("l_linenumber"), F.col("verified")))


@query("reward_dual", f"WITH {COMPLETIONS} SELECT id, n, round(CASE WHEN {tag_sql('completion', 'proof')} IS NULL OR {tag_sql('completion', 'code')} IS NULL THEN 0.0 ELSE 0.2 + (CASE WHEN verified THEN 0.75 ELSE 0.0 END) + (CASE WHEN is_correct THEN 0.75 ELSE 0.0 END) + (CASE WHEN verified AND is_correct THEN 1.5 ELSE 0.0 END) - {_LEN.format('completion')} END, 8) AS reward FROM comp")
def reward_dual(t):
    return _reward(t, W.dual_proof(F.col("completion"), F.col("verified"), F.col("is_correct")))


@query("reward_tdd", f"WITH {COMPLETIONS} SELECT id, n, round(CASE WHEN l_partkey % 3 = 0 OR l_partkey % 4 = 0 THEN 0.0 ELSE 0.2 + (CASE WHEN verified THEN 0.375 ELSE 0.0 END) + (CASE WHEN is_correct THEN 0.75 ELSE 0.0 END) + (CASE WHEN test_passed THEN 0.75 ELSE 0.0 END) + (CASE WHEN is_correct AND test_passed THEN 1.5 ELSE 0.0 END) - {_LEN.format('completion')} END, 8) AS reward FROM comp")
def reward_tdd(t):
    return _reward(t, W.test_driven(F.col("completion"), F.col("verified"), F.col("is_correct"), F.col("test_passed")))


_TYPES = ["solution", "solution", "programming", "finalization", "architect", "test_programming", "tutor", "dual_proof", "test_driven_programmer"]
_TYPE = "CASE " + " ".join(f"WHEN l_partkey % 27 = {k} THEN '{x}'" for k, x in enumerate(_TYPES)) + " WHEN l_partkey % 27 < 18 THEN 'solution' WHEN l_partkey % 2 = 0 THEN 'programming' ELSE 'finalization' END"
_C = lambda x: f"count(*) FILTER (WHERE e = '{x}')"


@query("reward_dispatch", f"""WITH {COMPLETIONS}, x AS (SELECT id, {_TYPE} AS e FROM comp) SELECT id, CASE WHEN {_C('test_driven_programmer')} > 0 THEN 'test_driven_programmer' WHEN {_C('dual_proof')} > 0 THEN 'dual_proof' WHEN {_C('tutor')} > 0 THEN 'tutor' WHEN {_C('test_programming')} > 0 THEN 'test_programming' WHEN {_C('architect')} > 0 THEN 'architect'
 WHEN {_C('programming')} > 0 AND {_C('programming')} >= {_C('finalization')} AND {_C('programming')} >= {_C('solution')} THEN 'programming' WHEN {_C('finalization')} > {_C('solution')} THEN 'finalization' ELSE 'solution' END AS reward_type FROM x GROUP BY id""")
def reward_dispatch(t):
    return W.dispatch(completions(t).withColumn("example_type", F.expr(_TYPE)), ["id"])


_RAW = "x AS (SELECT id, n, (value - 25) / 10 AS reward FROM comp)"


@query("batch_reward_zeroing", f"WITH {COMPLETIONS}, {_RAW} SELECT id, n, CASE WHEN count(*) OVER (PARTITION BY id) > 1 AND max(reward) OVER (PARTITION BY id) < 1.5 THEN 0.0 ELSE reward END AS adjusted FROM x")
def batch_reward_zeroing(t):
    return W.zero_weak_batches(completions(t).withColumn("reward", (F.col("value") - 25) / 10), ["id"], "reward").select("id", "n", "adjusted")


@query("batch_reward_clip", f"WITH {COMPLETIONS}, {_RAW} SELECT id, n, CASE WHEN count(*) OVER (PARTITION BY id) > 1 AND avg(reward) OVER (PARTITION BY id) < 0 THEN greatest(0.0, reward) ELSE reward END AS adjusted FROM x")
def batch_reward_clip(t):
    return W.clip_negative_batches(completions(t).withColumn("reward", (F.col("value") - 25) / 10), ["id"], "reward").select("id", "n", "adjusted")


@query("reward_histogram", "WITH x AS (SELECT l_quantity / 10 AS r FROM lineitem), e AS (SELECT min(r) - 0.001 AS lo, max(r) + 0.001 AS hi FROM x) SELECT CAST(least(floor((r - lo) / (hi - lo) * 5), 4) AS BIGINT) AS bin_no, round(lo + CAST(least(floor((r - lo) / (hi - lo) * 5), 4) AS BIGINT) * (hi - lo) / 5, 2) AS label, count(*) AS n FROM x, e GROUP BY 1, 2")
def reward_histogram(t):
    return R.dynamic_histogram(t("lineitem").select((F.col("l_quantity") / 10).alias("r")), "r")


@query("int_histogram", "WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents), w AS (SELECT *, greatest(1, (hi - lo) // 5) AS w FROM e), k AS (SELECT least((n_chars - lo) // w, greatest((hi - lo) // w - (CASE WHEN (hi - lo) % w = 0 THEN 1 ELSE 0 END), 0)) AS bin_no, lo, w FROM documents, w) SELECT bin_no, lo + bin_no * w AS low, lo + (bin_no + 1) * w - 1 AS high, count(*) AS n FROM k GROUP BY 1, 2, 3")
def int_histogram(t):
    return R.integer_histogram(t("documents").select("n_chars"), "n_chars")


@query("running_reward_stats", f"""WITH {ATT}, b AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE is_correct) AS reward FROM att GROUP BY run_id) SELECT run_id, n, reward, CAST(sum(n) OVER w AS BIGINT) AS total_examples, CAST(sum(reward) OVER w AS BIGINT) AS total_rewards, min(reward) OVER w AS min_reward, max(reward) OVER w AS max_reward FROM b WINDOW w AS (ORDER BY run_id)""")
def running_reward_stats(t):
    b = attempts(t).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("reward"))
    return O.running(b, {"total_examples": ("sum", "n"), "total_rewards": ("sum", "reward"), "min_reward": ("min", "reward"), "max_reward": ("max", "reward")}, "run_id")


# ---------------------------------------------------------------- prompts, samples, mixtures

_NUM_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(q, '{p}') THEN TRY_CAST(regexp_extract(q, '{p}', 1) AS INTEGER) END" for p in X.STEP_NUMBERS) + ")"

_SYS = "You are a careful solver."


@query("prompt_render", rf"SELECT id, '<|im_start|>system\n{_SYS}<|im_end|>\n<|im_start|>user\n' || problem || '<|im_end|>\n<|im_start|>assistant\n' AS prompt, answer, x.t AS example_type FROM problems, (VALUES ('solution'), ('programming'), ('architect')) AS x(t)")
def prompt_render(t):
    p = t("problems")
    every = M.examples(p, "solution", _SYS).unionByName(M.examples(p, "programming", _SYS)).unionByName(M.examples(p, "architect", _SYS))
    return every.select("id", "prompt", "answer", "example_type")


@query("sft_render", "SELECT id, md5('<|im_start|>system<|im_sep|>You are a careful solver.<|im_end|><|im_start|>user<|im_sep|>' || problem || '<|im_end|><|im_start|>assistant<|im_sep|>' || solution || '<|im_end|>') AS text_md5 FROM problems")
def sft_render(t):
    return t("problems").select("id", F.md5(M.sft_text(_SYS, F.col("problem"), F.col("solution"))).alias("text_md5"))


@query("chat_render", rf"""WITH {ATT} SELECT id, run_id, md5(string_agg('<|im_start|>' || r || '\n' || x || '<|im_end|>' || CASE WHEN r = 'user' THEN '\n' ELSE '' END, '' ORDER BY o) || '<|im_start|>assistant\n') AS prompt_md5 FROM (SELECT id, run_id, attempt_number AS o, CASE WHEN attempt_number % 2 = 1 THEN 'user' ELSE 'assistant' END AS r, coalesce(model_answer, '') AS x FROM att) GROUP BY id, run_id""")
def chat_render(t):
    a = attempts(t).select("id", "run_id", F.struct("id", "run_id").alias("k"), "attempt_number", F.when(F.col("attempt_number") % 2 == 1, "user").otherwise("assistant").alias("r"), F.coalesce("model_answer", F.lit("")).alias("x"))
    return M.fold_chat(a, "k", "attempt_number", "r", "x").select("k.id", "k.run_id", F.md5("prompt").alias("prompt_md5"))


@query("chat_render_separated", f"""WITH {ATT} SELECT id, run_id, md5(string_agg('<|im_start|>' || r || '<|im_sep|>' || x || '<|im_end|>', '' ORDER BY o) || '<|im_start|>assistant<|im_sep|>') AS prompt_md5 FROM (SELECT id, run_id, attempt_number AS o, CASE WHEN attempt_number % 2 = 1 THEN 'human' ELSE 'assistant' END AS r, coalesce(model_answer, '') AS x FROM att) GROUP BY id, run_id""")
def chat_render_separated(t):
    a = attempts(t).select(F.struct("id", "run_id").alias("k"), "attempt_number", F.when(F.col("attempt_number") % 2 == 1, "Human").otherwise("assistant").alias("r"), F.coalesce("model_answer", F.lit("")).alias("x"))
    return M.fold_chat_separated(a, "k", "attempt_number", "r", "x").select("k.id", "k.run_id", F.md5("prompt").alias("prompt_md5"))


@query("chat_single_message", f"""WITH {ATT}, x AS (SELECT id, run_id, attempt_number AS o, CASE WHEN attempt_number = 1 THEN 'system' WHEN attempt_number % 2 = 0 THEN 'human' ELSE 'assistant' END AS r, coalesce(model_answer, '') AS t FROM att), y AS (SELECT id, run_id, arg_max(t, o) FILTER (WHERE r = 'system') AS s, arg_max(t, o) FILTER (WHERE r = 'human') AS u, arg_max(t, o) AS a FROM x GROUP BY id, run_id)
 SELECT id, run_id, CASE WHEN s <> '' AND u <> '' THEN 'System instructions:' || chr(10) || s || chr(10) || chr(10) || 'User message:' || chr(10) || u WHEN u <> '' THEN u ELSE a END AS message FROM y""")
def chat_single_message(t):
    r = F.when(F.col("attempt_number") == 1, "system").when(F.col("attempt_number") % 2 == 0, "human").otherwise("assistant")
    a = attempts(t).select(F.struct("id", "run_id").alias("k"), "attempt_number", r.alias("r"), F.coalesce("model_answer", F.lit("")).alias("x"))
    return M.single_message(a, "k", "attempt_number", "r", "x").select("k.id", "k.run_id", "message")


@query("reward_kwargs", f"WITH {ATT}, x AS (SELECT id, run_id, list(model_answer ORDER BY attempt_number) AS a, count(*) AS n FROM att GROUP BY id, run_id) SELECT id, run_id, i AS reward_index, coalesce(a[i + 1], '(default)') AS kwarg FROM (SELECT id, run_id, a, CAST(unnest(range(0, n + 2)) AS INTEGER) AS i FROM x)")
def reward_kwargs(t):
    """Each completion's argument by position, with a default where the list of
    arguments is too short or has none."""
    folded = V.fan_in(attempts(t), ["id", "run_id"], "attempt_number", "model_answer")
    a = folded.select("id", "run_id", F.transform("attempts", lambda x: x["model_answer"]).alias("a"))
    return a.select("id", "run_id", "a", F.explode(F.sequence(F.lit(0), F.size("a") + 1)).alias("reward_index")).select("id", "run_id", "reward_index", F.coalesce(F.get("a", F.col("reward_index")), F.lit("(default)")).alias("kwarg"))


@query("example_type_counts", f"WITH {COMPLETIONS}, x AS (SELECT CASE WHEN l_partkey % 31 = 0 THEN 'strange' ELSE {_TYPE} END AS e FROM comp) SELECT CASE WHEN e = 'strange' THEN 'unknown' ELSE e END AS example_type, count(*) AS n FROM x GROUP BY 1")
def example_type_counts(t):
    e = F.when(F.col("l_partkey") % 31 == 0, "strange").otherwise(F.expr(_TYPE))
    return completions(t).select(e.alias("e")).groupBy(F.when(F.col("e").isin(*W.TYPES), F.col("e")).otherwise("unknown").alias("example_type")).agg(F.count("*").alias("n"))


@query("token_count_stats", "WITH x AS (SELECT length(problem || coalesce(solution, '')) // 4 AS n FROM problems) SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) AS mean, count(*) FILTER (WHERE n > 250) AS over_limit FROM x")
def token_count_stats(t):
    n = t("problems").select(X.token_estimate(F.concat("problem", F.coalesce("solution", F.lit("")))).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > 250).alias("over_limit"))


@query("unsalvageable_reasons", f"""WITH {ATT}, x AS (SELECT model_solution AS s, regexp_extract_all(model_solution, '(?s)<step>(.*?)</step>', 1) AS g FROM att WHERE model_solution IS NOT NULL), y AS (SELECT s, g, list_transform(g, lambda q: {_NUM_SQL}) AS n FROM x)
 SELECT coalesce(CASE WHEN NOT contains(s, '<step>') THEN 'no_step_tags_in_response' WHEN len(g) < 2 THEN 'insufficient_steps' WHEN len(list_filter(n, lambda q: q IS NULL)) > 0 THEN 'missing_step_numbers' WHEN n <> CAST(range(1, len(g) + 1) AS INTEGER[]) THEN 'non_sequential_step_numbers' END, '(none)') AS reason, count(*) AS n FROM y GROUP BY 1""")
def unsalvageable_reasons(t):
    a = attempts(t).where("model_solution is not null")
    return a.groupBy(F.coalesce(X.unsalvageable(F.col("model_solution")), F.lit("(none)")).alias("reason")).agg(F.count("*").alias("n"))


@query("tutor_examples", rf"""WITH {ATT}, x AS (SELECT *, CASE WHEN coalesce(problem, '') = '' THEN 'no problem' WHEN coalesce(model_solution, '') = '' THEN 'no solution' WHEN {tag_sql('model_solution', 'response')} IS NULL THEN 'no response' WHEN contains(model_solution, 'Begin with the first calculation or operation') THEN 'echo' WHEN is_correct IS NULL THEN 'no flag'
 WHEN NOT is_correct AND coalesce(len(regexp_extract_all(model_answer, '\b[0-9]+\b')), 0) <> 1 THEN 'no wrong step' WHEN NOT is_correct AND length(regexp_extract(model_answer, '\b[0-9]+\b')) > 9 THEN 'no wrong step' WHEN is_correct AND CAST(('0x' || substr(md5(problem), 1, 8)) AS UBIGINT) % 20 <> 0 THEN 'bucket' END AS reason FROM att) SELECT id, run_id, attempt_number, reason, CASE WHEN reason IS NULL THEN 'tutor' ELSE 'solution' END AS example_type FROM x""")
def tutor_examples(t):
    return M.tutor_examples(attempts(t))


@query("finalization_examples", f"""WITH {ATT}, {_SPLIT.replace('FROM att WHERE model_solution IS NOT NULL', 'FROM att WHERE is_correct AND problem IS NOT NULL AND model_solution IS NOT NULL')}, s AS (SELECT id, run_id, attempt_number, len(steps) AS n, steps FROM z), ok AS (SELECT id, run_id, attempt_number, len(g) AS ng FROM x)
 SELECT s.id, s.run_id, s.attempt_number, CAST(n AS INTEGER) AS n_steps, CAST(k AS INTEGER) AS split_at, md5(array_to_string(steps[1:k], chr(10) || chr(10))) AS partial_md5 FROM (SELECT *, CAST(CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS UBIGINT) % (n - 1) AS BIGINT) + 1 AS k FROM s WHERE n >= 2) s
 JOIN (SELECT id, run_id, attempt_number FROM (SELECT *, regexp_extract_all(model_solution, '(?s)<step>(.*?)</step>', 1) AS g, list_transform(regexp_extract_all(model_solution, 'Step ([0-9]+)', 1), lambda x: CAST(x AS INTEGER)) AS st FROM att) WHERE CASE WHEN len(g) > 0 THEN len(list_filter(list_zip(g, range(1, len(g) + 1)), lambda p: NOT (regexp_extract(p[1], 'Step ([0-9]+)', 1) = CAST(p[2] AS VARCHAR) AND length(regexp_replace(regexp_extract(p[1], '(?s)Step [0-9]+[:.]?(.*)$', 1), '^\\s+|\\s+$', '', 'g')) >= 10))) = 0 ELSE len(st) > 0 AND list_sort(list_distinct(st)) = CAST(range(1, len(st) + 1) AS INTEGER[]) END) v ON s.id = v.id AND s.run_id = v.run_id AND s.attempt_number = v.attempt_number""")
def finalization_examples(t):
    return M.finalization_examples(attempts(t)).select("id", "run_id", "attempt_number", "n_steps", "split_at", F.md5("partial_solution").alias("partial_md5"))


@query("seeded_sample", "SELECT id FROM problems ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 200")
def seeded_sample(t):
    return M.seeded_sample(t("problems").select("id"), "id", 42, 200)


_MIX = " UNION ALL ".join(f"SELECT * FROM (SELECT id, '{k}' AS example_type FROM problems ORDER BY md5('{142 + i}:' || CAST(id AS VARCHAR)), id LIMIT {int(500 * w)})" for i, (k, w) in enumerate(M.WEIGHTS.items()))


@query("task_mixture", _MIX)
def task_mixture(t):
    return M.stratified_mixture(t("problems"), "id", 500)


@query("mixture_report", f"SELECT example_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ({_MIX}) GROUP BY example_type")
def mixture_report(t):
    return M.mixture_report(M.stratified_mixture(t("problems"), "id", 500))


@query("oversample", "SELECT id, CAST(copy_no AS INTEGER) AS copy_no FROM problems, range(1, 5) AS r(copy_no)")
def oversample(t):
    return M.oversample(t("problems").select("id"), 4)


_CASES = "[" + ", ".join([str(x) for x in N.EDGES] + [f"c * {x}" for x in N.MULTIPLIERS]) + "]"
_OFFSETS = "[" + ", ".join(f"c + {x}" for x in N.OFFSETS) + "]"


@query("test_matrix", f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE o_totalprice END AS c FROM orders), d AS (SELECT id, c, unnest(list_concat({_CASES}, CASE WHEN abs(c) < 1 THEN {_OFFSETS} ELSE [] END)) AS v FROM x) SELECT id, round(v, 6) AS test_case, false AS expected FROM d WHERE abs(v - c) > 0.01 UNION ALL SELECT id, round(c, 6), true FROM x""")
def test_matrix(t):
    c = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 100) / F.lit(100.0)).otherwise(F.col("o_totalprice"))
    x = t("orders").select(F.col("o_orderkey").alias("id"), c.alias("c"))
    wrong = x.select("id", F.explode(N.wrong_cases(F.col("c"))).alias("v")).select("id", F.round("v", 6).alias("test_case"), F.lit(False).alias("expected"))
    return wrong.unionByName(x.select("id", F.round("c", 6).alias("test_case"), F.lit(True).alias("expected")))


_SAID = "CASE WHEN id % 7 = 0 THEN 'True' WHEN id % 11 = 0 THEN 'Timeout after 1 s' WHEN abs(test_case - CASE WHEN id % 4 = 0 THEN 2 * correct ELSE correct END) <= 0.01 THEN 'True' ELSE 'False' END"


@query("pipeline_test_cases", f"""WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE o_totalprice END AS c FROM orders), d AS (SELECT id, c, unnest(list_concat({_CASES}, CASE WHEN abs(c) < 1 THEN {_OFFSETS} ELSE [] END)) AS v FROM x),
 k AS (SELECT id, c AS correct, v AS test_case, false AS right_case FROM d WHERE abs(v - c) > 0.01 UNION ALL SELECT id, c, c, true FROM x), o AS (SELECT id, right_case, {_SAID} AS o FROM k)
 SELECT id, CASE WHEN count(*) FILTER (WHERE right_case AND o <> 'True') > 0 THEN 'rejects_correct' WHEN count(*) FILTER (WHERE NOT right_case AND o = 'True') > 0 THEN 'accepts_wrong' WHEN count(*) FILTER (WHERE NOT right_case AND o = 'False') = 0 AND count(*) FILTER (WHERE NOT right_case) > 0 THEN 'only_errors' ELSE 'ok' END AS verdict,
 count(*) FILTER (WHERE o LIKE 'Timeout%') AS timeouts, count(*) FILTER (WHERE o LIKE 'ERROR%') AS errors FROM o GROUP BY id""")
def pipeline_test_cases(t):
    """Cases laid out for each answer, judged by what a test function says of
    each: most accept the answer alone, some a wrong value, everything or nothing."""
    c = F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % 100) / F.lit(100.0)).otherwise(F.col("o_totalprice"))
    return P.test_cases(t("orders").select(F.col("o_orderkey").alias("id"), c.cast("double").alias("correct")), F.expr(_SAID))


@query("test_cases_filled")
def test_cases_filled(t):
    """The correct answer and fifty wrong ones for each order."""
    x = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("c"))
    return x.select("id", F.posexplode(F.concat(F.array("c"), N.wrong_cases(F.col("c"), 50))).alias("case_no", "test_case"))


_OUT = "CASE WHEN l_linenumber = 1 THEN (CASE WHEN l_linestatus = 'O' THEN 'True' ELSE 'False' END) WHEN l_partkey % 7 = 0 THEN 'True' WHEN l_partkey % 5 = 0 THEN 'Timeout' WHEN l_partkey % 11 = 0 THEN 'ERROR: x' ELSE 'False' END"


@query("test_function_verdicts", f"""WITH x AS (SELECT l_orderkey AS id, l_linenumber = 1 AS right_case, {_OUT} AS o FROM lineitem) SELECT id, CASE WHEN count(*) FILTER (WHERE right_case) = 0 THEN 'no_correct_case' WHEN count(*) FILTER (WHERE right_case AND o <> 'True') > 0 THEN 'rejects_correct' WHEN count(*) FILTER (WHERE NOT right_case AND o = 'True') > 0 THEN 'accepts_wrong'
 WHEN count(*) FILTER (WHERE NOT right_case AND o = 'False') = 0 AND count(*) FILTER (WHERE NOT right_case) > 0 THEN 'only_errors' ELSE 'ok' END AS verdict, count(*) FILTER (WHERE o LIKE 'Timeout%') AS timeouts, count(*) FILTER (WHERE o LIKE 'ERROR%') AS errors FROM x GROUP BY id""")
def test_function_verdicts(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") == 1).alias("right_case"), F.expr(_OUT).alias("outcome"))
    return R.test_verdicts(x, ["id"])


@query("events_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def events_json_props(t):
    return t("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ---------------------------------------------------------------- vectors

_COS = "least(1.0, greatest(0.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query("cosine_topk", f"SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE r <= 10")
def cosine_topk(t):
    e = t("embeddings")
    return S.top_k(e, e.where("vec_id % 20 = 0"), 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("group_similarity", "WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), nn AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS nrm FROM u GROUP BY 1), s AS (SELECT label, i, sum(x / nrm) AS s, count(*) AS n FROM u JOIN nn USING (vec_id) GROUP BY 1, 2) SELECT label, max(n) AS n, round(sqrt(sum(s * s)) / max(n), 6) AS centroid_norm FROM s GROUP BY label")
def group_similarity(t):
    return S.group_means(t("embeddings"))


# ---------------------------------------------------------------- pipelines

_CNT = "cnt AS (SELECT id, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, round(100.0 * count(*) FILTER (WHERE is_correct) / count(*), 6) AS success_rate FROM comp GROUP BY id)"


def _vote(value: str, src: str, name: str, where: str = "true") -> str:
    return f"{name}p AS (SELECT id, {value} AS v, count(*) AS c, min(n) AS f FROM {src} WHERE {value} IS NOT NULL AND {where} GROUP BY 1, 2), {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, f) AS r, CAST(sum(c) OVER (PARTITION BY id) AS BIGINT) AS tot, lead(c) OVER (PARTITION BY id ORDER BY c DESC, f) AS c2, count(*) OVER (PARTITION BY id) AS k FROM {name}p) WHERE r = 1)"


_BOX = r"CASE WHEN regexp_matches(completion, '\\boxed\{([0-9]+)\}') THEN regexp_extract(completion, '\\boxed\{([0-9]+)\}', 1) END"
_TL = "CASE WHEN contains(completion, '<thinking>') THEN length(regexp_extract(completion, '(?s)<thinking>(.*?)</thinking>', 1)) ELSE 0 END"


@query("pipeline_standard", f"WITH {COMPLETIONS}, {_CNT}, a AS (SELECT *, {_BOX} AS ma, {_TL} AS tl FROM comp), {_vote('ma', 'a', 'm')}, th AS (SELECT id, round(avg(tl), 6) AS avg_thinking, round(coalesce(avg(tl) FILTER (WHERE is_correct), 0), 6) AS avg_thinking_correct FROM a GROUP BY id), hit AS (SELECT a.id, coalesce(bool_or(is_correct AND ma = m.v), false) AS majority_correct FROM a JOIN m ON a.id = m.id GROUP BY a.id) SELECT cnt.*, m.v AS majority_answer, m.c AS majority_count, majority_correct, avg_thinking, avg_thinking_correct FROM cnt LEFT JOIN m USING (id) LEFT JOIN hit USING (id) JOIN th USING (id)")
def pipeline_standard(t):
    return P.standard(completions(t))


_USABLE = rf"usable AS (SELECT * FROM (SELECT *, {_CODE} AS code FROM comp) WHERE code <> '' AND NOT regexp_matches(code, '{"|".join(p for p, _ in _QUOTED)}') AND regexp_matches(code, '{X.COMPUTES}'))"


@query("pipeline_programming", f"""WITH {COMPLETIONS}, {_CNT}, {_USABLE}, per AS (SELECT id, value AS v, count(*) AS c, min(n) AS f FROM usable GROUP BY 1, 2), sc AS (SELECT a.id, a.v, a.f, a.c * CAST(sum(b.c) AS BIGINT) AS score FROM per a JOIN per b ON a.id = b.id AND abs(a.v - b.v) <= 0.01 GROUP BY a.id, a.v, a.f, a.c),
 m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, f) AS r FROM sc) WHERE r = 1), ok AS (SELECT u.id, bool_or(is_correct AND abs(value - v) <= 0.01) AS majority_correct FROM usable u JOIN m ON u.id = m.id GROUP BY u.id)
 SELECT cnt.*, m.v AS majority_value, m.score, majority_correct FROM cnt LEFT JOIN m USING (id) LEFT JOIN ok USING (id)""")
def pipeline_programming(t):
    return P.programming(completions(t))


@query("pipeline_test", f"WITH {COMPLETIONS} SELECT id, count(*) AS total, count(*) FILTER (WHERE test_passed AND NOT verified) AS passing, bool_or(test_passed AND NOT verified) AS any_passing, count(*) FILTER (WHERE test_passed AND verified) AS accepts_wrong FROM comp GROUP BY id")
def pipeline_test(t):
    return P.test_functions(completions(t))


@query("pipeline_programmer_test", f"WITH {COMPLETIONS}, {_vote('value', 'comp', 'm')}, {_vote('value', 'comp', 'w', 'test_passed')} SELECT m.id, m.v AS initial_answer, round(100.0 * m.c / m.tot, 6) AS initial_pct, coalesce(w.v, m.v) AS final_answer, w.v IS NULL AS fell_back, abs(m.v - want) <= 0.01 AS initial_correct, abs(coalesce(w.v, m.v) - want) <= 0.01 AS final_correct, n_both FROM m LEFT JOIN w ON m.id = w.id JOIN (SELECT id, CAST(max(answer) AS DOUBLE) AS want, count(*) FILTER (WHERE is_correct AND test_passed) AS n_both FROM comp GROUP BY id) b ON m.id = b.id")
def pipeline_programmer_test(t):
    return P.programmer_and_test(completions(t))


@query("pipeline_tutor", f"""WITH {COMPLETIONS}, {_vote('value', 'comp', 'm')}, a AS (SELECT comp.*, k = 1 OR m.c > coalesce(c2, 0) AS win, NOT contains(lower(completion), 'answer is correct') AS neg, {_BOX} AS ma FROM comp JOIN m ON comp.id = m.id),
 b AS (SELECT *, NOT win AND neg AND ma IS NOT NULL AS fixed, CASE WHEN NOT win AND neg AND ma IS NOT NULL THEN ma = answer ELSE is_correct END AS fin FROM a)
 SELECT id, win AS has_clear_winner, count(*) FILTER (WHERE fixed) AS fixed, count(*) FILTER (WHERE is_correct) AS initial_correct, count(*) FILTER (WHERE fin) AS final_correct, count(*) FILTER (WHERE fin) > count(*) FILTER (WHERE is_correct) AS improved FROM b GROUP BY id, win""")
def pipeline_tutor(t):
    return P.tutor(completions(t))


_PROGRAMS = """per AS (SELECT id, value AS v, count(*) AS c, min(n) AS f FROM usable GROUP BY 1, 2), sc AS (SELECT a.id, a.v, a.f, a.c * CAST(sum(b.c) AS BIGINT) AS score FROM per a JOIN per b ON a.id = b.id AND abs(a.v - b.v) <= 0.01 GROUP BY a.id, a.v, a.f, a.c),
 tm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, f) AS r FROM sc) WHERE r = 1), ok AS (SELECT u.id, bool_or(is_correct AND abs(value - v) <= 0.01) AS majority_correct FROM usable u JOIN tm ON u.id = tm.id GROUP BY u.id)"""
_GUIDE = tag_sql("completion", "response")


@query("pipeline_architect", f"""WITH {COMPLETIONS}, {_vote('value', 'comp', 'm')}, {_USABLE}, {_PROGRAMS}, s AS (SELECT id, 2 * count(*) AS n_roles, CAST(sum(length(completion)) AS BIGINT) AS plan_chars, CAST(sum(length({_CODE})) AS BIGINT) AS code_chars,
 CAST(sum(length(coalesce({_GUIDE}, 'Please solve this problem using appropriate Python libraries and techniques.'))) AS BIGINT) AS guidance_chars, count(*) FILTER (WHERE {_GUIDE} IS NULL) AS without_guidance FROM comp GROUP BY id)
 SELECT s.*, m.v AS majority_answer, tm.v AS majority_value, tm.score, majority_correct FROM s LEFT JOIN m USING (id) LEFT JOIN tm USING (id) LEFT JOIN ok USING (id)""")
def pipeline_architect(t):
    return P.architect(completions(t))


_DS = "CASE WHEN p AND k AND verified AND is_correct THEN 'matching' WHEN p AND k AND verified THEN 'matching_incorrect' WHEN k AND is_correct THEN 'code_fallback' WHEN p AND is_correct THEN 'proof_fallback' WHEN k THEN 'code_fallback_incorrect' WHEN p THEN 'proof_fallback_incorrect' ELSE 'invalid_solution' END"
_RIGHT = "vr AS (SELECT m.id, abs(m.v - want) <= 0.01 AS majority_correct FROM m JOIN (SELECT id, CAST(max(answer) AS DOUBLE) AS want FROM comp GROUP BY id) w ON m.id = w.id)"


@query("pipeline_dual", f"""WITH {COMPLETIONS}, {_vote('value', 'comp', 'm')}, {_RIGHT}, a AS (SELECT *, l_suppkey % 3 = 0 AS p, l_suppkey % 3 <> 2 AS k FROM comp), b AS (SELECT *, p AND is_correct AS po, k AND is_correct AS co, {_DS} AS answer_source FROM a), d AS (SELECT *, CASE WHEN po AND co THEN 1 WHEN co THEN 2 WHEN po THEN 3 WHEN answer_source LIKE 'matching%' THEN 4 ELSE 5 END AS priority FROM b),
 best AS (SELECT id, n AS best_attempt, priority, answer_source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, n) AS r FROM d) WHERE r = 1) SELECT id, proofs_ok, codes_ok, best_attempt, priority, answer_source, majority_correct FROM (SELECT id, count(*) FILTER (WHERE po) AS proofs_ok, count(*) FILTER (WHERE co) AS codes_ok FROM d GROUP BY id) JOIN best USING (id) LEFT JOIN vr USING (id)""")
def pipeline_dual(t):
    return P.dual_proof(completions(t))


@query("pipeline_tdd", f"""WITH {COMPLETIONS}, {_vote('value', 'comp', 'm')}, {_RIGHT}, a AS (SELECT *, l_partkey % 3 <> 0 AS t, l_partkey % 4 <> 0 AS i FROM comp), b AS (SELECT *, i AND is_correct AS io, t AND test_passed AS tk, CASE WHEN NOT i THEN 'invalid_solution' WHEN t AND test_passed AND is_correct THEN 'verified_implementation' WHEN is_correct THEN 'implementation_fallback' ELSE 'implementation_fallback_incorrect' END AS answer_source FROM a),
 d AS (SELECT *, CASE WHEN io AND tk THEN 1 WHEN io THEN 2 WHEN tk THEN 3 ELSE 4 END AS priority FROM b), best AS (SELECT id, n AS best_attempt, priority, answer_source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority, n) AS r FROM d) WHERE r = 1)
 SELECT id, impl_ok, test_ok, both_ok, best_attempt, priority, answer_source, majority_correct FROM (SELECT id, count(*) FILTER (WHERE io) AS impl_ok, count(*) FILTER (WHERE tk) AS test_ok, count(*) FILTER (WHERE io AND tk) AS both_ok FROM d GROUP BY id) JOIN best USING (id) LEFT JOIN vr USING (id)""")
def pipeline_tdd(t):
    return P.test_driven(completions(t))


@query("pipeline_step", f"""WITH {COMPLETIONS}, x AS (SELECT id, n - 1 AS i, is_correct OR verified AS ok, count(*) OVER (PARTITION BY id) AS c FROM comp), y AS (SELECT id, c, bool_or(ok AND i = c // 2) AS mid, min(i) FILTER (WHERE NOT ok AND i >= c // 2) AS up, max(i) FILTER (WHERE ok AND i < c // 2) AS down FROM x GROUP BY id, c),
 z AS (SELECT id, c, CASE WHEN c < 2 THEN NULL WHEN mid THEN up ELSE coalesce(down + 1, 0) END AS i FROM y)
 SELECT id, CAST(c AS INTEGER) AS total_steps, CAST(i AS INTEGER) AS wrong_step, CASE WHEN i IS NULL THEN NULL WHEN c <= 2 THEN 'short_solution' WHEN i = 0 THEN 'beginning' WHEN i = c - 1 THEN 'end' WHEN i < c / 3.0 THEN 'early' WHEN i < 2 * c / 3.0 THEN 'middle' ELSE 'late' END AS position_category, round(i * 1.0 / c, 6) AS completion_score FROM z""")
def pipeline_step(t):
    return P.steps(completions(t))


@query("wrong_step_stats", f"""WITH {COMPLETIONS}, x AS (SELECT id, n - 1 AS i, is_correct OR verified AS ok, count(*) OVER (PARTITION BY id) AS c FROM comp), y AS (SELECT id, c, bool_or(ok AND i = c // 2) AS mid, min(i) FILTER (WHERE NOT ok AND i >= c // 2) AS up, max(i) FILTER (WHERE ok AND i < c // 2) AS down FROM x GROUP BY id, c),
 z AS (SELECT id, c, CASE WHEN c < 2 THEN NULL WHEN mid THEN up ELSE coalesce(down + 1, 0) END AS i FROM y)
 SELECT count(*) AS problems, count(i) AS wrong_steps_found, round(avg(i * 1.0 / c), 6) AS avg_wrong_step_position, count(*) FILTER (WHERE c < 2) AS unsalvageable, round(100.0 * count(*) FILTER (WHERE i > 0) / count(i), 6) AS recovery_rate, round(avg(i * 1.0 / c), 6) AS avg_completion_score FROM z""")
def wrong_step_stats(t):
    return P.step_statistics(P.steps(completions(t)))

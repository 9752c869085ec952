"""Operators against small brute-force models."""

import hashlib
import random
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import filters, mixture, ordering, rewards, runstats, similarity, votes

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def test_majority_takes_first_seen_on_ties(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(["b", "a", "a", "b", None])] + [(2, 0, None)], "id int, n int, v string")
    r = votes.majority(df, ["id"], "v", "n").collect()
    assert [(x.id, x.majority_answer, x.majority_count, x.valid_count, x.distinct_answers, x.second_count) for x in r] == [(1, "b", 2, 4, 2, 2)]


@QUIET
@given(st.lists(st.sampled_from([1.0, 1.005, 1.02, 2.0, 2.009]), min_size=1, max_size=9))
def test_tolerance_vote(spark, values):
    score = {}
    for v in values:
        for o in values:
            if abs(v - o) <= 1e-2:
                score[v] = score.get(v, 0) + 1
    first = max(score, key=lambda v: (score[v], -values.index(v)))
    df = spark.createDataFrame([(7, k, v) for k, v in enumerate(values)], "id int, n int, v double")
    r = votes.majority_with_tolerance(df, ["id"], "v", "n").first()
    assert (r.majority_value, r.score) == (first, score[first])


def test_best_by_priority(spark):
    df = spark.createDataFrame([(1, 1, False, None), (1, 2, True, True), (1, 3, True, True), (2, 1, None, None)], "id int, n int, a boolean, b boolean")
    r = votes.best_by_priority(df, ["id"], [F.col("a") & F.col("b"), F.col("a")], "n").orderBy("id").collect()
    assert [(x.id, x.n, x.priority) for x in r] == [(1, 2, 1), (2, 1, 3)]


def test_row_numbers_and_running_values(spark):
    random.seed(3)
    rows = [(k, random.randint(-5, 5)) for k in random.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = {r.k: r for r in ordering.running(ordering.with_row_number(df, "k"), {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, "k").collect()}
    total, lo, hi = 0, 99, -99
    for n, (k, v) in enumerate(sorted(rows), 1):
        total, lo, hi = total + v, min(lo, v), max(hi, v)
        assert (got[k].rn, got[k].s, got[k].lo, got[k].hi) == (n, total, lo, hi)


def test_slices_and_batches(spark):
    df = spark.range(25)
    assert [r.id for r in ordering.take_slice(df, 3, 6, "id").orderBy("id").collect()] == [3, 4, 5]
    assert Counter(r.batch_no for r in ordering.batches(df, 10, "id").collect()) == {0: 10, 1: 10, 2: 5}
    assert ordering.with_row_number(df.where("id < 0"), "id").count() == 0
    assert sorted(r.id for r in ordering.trailing(df, 2, "id").collect()) == [23, 24]


def test_histograms(spark):
    df = spark.createDataFrame([(0,), (2,), (10,)], "v int")
    got = {(r.low, r.high): r.n for r in runstats.integer_histogram(df, "v").collect()}
    assert got == {(0, 1): 1, (2, 3): 1, (8, 9): 1}
    same = spark.createDataFrame([(1.0,)] * 4, "v double")
    assert sum(r.n for r in runstats.dynamic_histogram(same, "v").collect()) == 4


def test_above_average(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate([0, 1, 3])], "id int, correct_solutions int")
    assert [r.id for r in runstats.above_average(df, ["id"]).collect()] == [2]


def test_reward_adjustments(spark):
    df = spark.createDataFrame([(1, 0, 1.4), (1, 1, 0.2), (2, 0, -1.0), (2, 1, 0.4), (3, 0, 0.1)], "b int, i int, r double")
    a = {(r.b, r.i): r.adjusted for r in rewards.zero_weak_batches(df, ["b"], "r").collect()}
    assert (a[1, 0], a[1, 1], a[3, 0]) == (0.0, 0.0, 0.1)
    b = {(r.b, r.i): r.adjusted for r in rewards.clip_negative_batches(df, ["b"], "r").collect()}
    assert (b[2, 0], b[2, 1], b[1, 0]) == (0.0, 0.4, 1.4)


def test_dispatch(spark):
    rows = [(1, t) for t in ("solution", "tutor", "solution")] + [(2, t) for t in ("programming", "finalization")] + [(3, t) for t in ("finalization", "finalization", "solution")] + [(4, "other")]
    df = spark.createDataFrame(rows, "b int, example_type string")
    assert {r.b: r.reward_type for r in rewards.dispatch(df, ["b"]).collect()} == {1: "tutor", 2: "programming", 3: "finalization", 4: "solution"}


def test_waterfall_takes_first_reason(spark):
    df = spark.createDataFrame([(1, "a" * 3000, r"\boxed{1}", None), (2, "p", r"\boxed{1}\boxed{2}", None), (3, "p", r"\boxed{x}", None), (4, "p", r"\boxed{4}", None)], "id int, problem string, solution string, answer string")
    got = {r.id: r.reason for r in filters.waterfall(df, filters.standard_rules()).collect()}
    assert got == {1: "too_long", 2: "multiple_boxed", 3: "not_numeric", 4: None}


def test_aliases_and_lists(spark):
    df = spark.createDataFrame([(1, None, "q", "s", None, "a"), (2, None, None, "s", "x", None), (3, "p", "q", None, None, None)], "id int, problem string, question string, solution string, source string, correct_answer string")
    assert [tuple(r) for r in filters.normalise_aliases(df, "hub").collect()] == [(1, "q", "s", "hub", "a")]
    a = spark.createDataFrame([("x",), (None,), ("y",)], "problem string")
    b = spark.createDataFrame([("x",), (None,)], "problem string")
    assert [r[0] for r in filters.include(a, b).collect()] == ["x"]
    assert {r[0] for r in filters.exclude(a, b).collect()} == {None, "y"}


def test_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    one = sorted(r.k for r in mixture.seeded_sample(df.repartition(5), "k", 1, 10).collect())
    assert one == sorted(r.k for r in mixture.seeded_sample(df.repartition(2), "k", 1, 10).collect()) and len(one) == 10
    assert one == sorted(sorted(range(50), key=lambda k: hashlib.md5(f"1:{k}".encode()).hexdigest())[:10])
    assert mixture.seeded_sample(df, "k", 1, 0).count() == 0 and mixture.seeded_sample(df.where("k < 0"), "k", 1, 5).count() == 0
    assert mixture.seeded_sample(df, "k", 1, 99).count() == 50
    assert Counter(r.copy_no for r in mixture.oversample(df, 3).collect()) == {1: 50, 2: 50, 3: 50}


def test_top_k_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(60, [0.0] * 8), (61, None)], "vec_id bigint, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in similarity.top_k(df, df.where("vec_id % 20 = 0"), 3, block=2).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.similarity)
    for q in (0, 20, 40):
        want = sorted(((-max(0, s), i) for i, s in enumerate(u @ u[q]) if i != q))[:3]
        assert [got[q][k][0] for k in (1, 2, 3)] == [i for _, i in want]


def test_mean_pool_and_cleaning(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1.0, 1.0])], "v array<array<double>>, m array<double>")
    assert df.select(similarity.mean_pool(F.col("v"), F.col("m"))).first()[0] == [2.0, 3.0]
    odd = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 2.0],)], "v array<double>")
    assert odd.select(similarity.cleaned(F.col("v"))).first()[0] == [0.0, 1.0, -1.0, 2.0]


def test_strict_take(spark):
    import pytest

    assert [r.id for r in mixture.strict_take(spark.range(5), 3, "id").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="3 rows wanted, 2 there"):
        mixture.strict_take(spark.range(2), 3, "id")


def test_failed_batches_embed_as_zeros(spark):
    def encode(texts):
        if "bad" in texts:
            raise ValueError
        return [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bcd", "bad", "x", None, "yy"])], "k int, t string").coalesce(1)
    got = {r.k: r.embedding for r in similarity.embed(df, "t", encode, 2, batch=2).collect()}
    assert got == {0: [1.0, 1.0], 1: [3.0, 1.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], 5: [2.0, 1.0]}


def test_report_of_rows_without_optional_columns(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "is_correct boolean")
    r = runstats.before_and_after(df).first()
    assert (r.total, r.at_least_one, r.total_correct, r.total_initial_solutions, r.overall_initial_success_rate) == (3, 1, 1, 0, 0.0)
    assert runstats.before_and_after(df.where("is_correct is null and is_correct")).first().total == 0
    s = runstats.step_report(spark.createDataFrame([(True, 1, 4), (True, -1, 4), (False, 2, 0)], "wrong_step_found boolean, wrong_step_index int, total_steps int")).first()
    assert (s.wrong_steps_found, s.avg_wrong_step_position) == (2, 0.25)


def test_token_limits_of_prompts(spark):
    steps = "<response>" + "".join(f"<step>Step {k}: {'long words ' * 6}</step>" for k in range(1, 5)) + "</response>"
    df = spark.createDataFrame([(k, "p", steps, "True") for k in range(12)], "id int, problem string, model_solution string, is_correct string")
    wide = {r.id: r for r in mixture.finalization_prompts(df, "s").collect()}
    assert len(wide) == 12 and {r.split_at for r in wide.values()} == {1, 2, 3}
    three = next(r for r in wide.values() if r.split_at == 3)
    limit = (len("Problem: p\n\nPartial Solution: ") + len(three.partial_solution)) // 4  # what three steps reach and their prompt exceeds
    narrow = {r.id: r for r in mixture.finalization_prompts(df, "s", limit=limit).collect()}
    assert all(r.token_count <= limit and r.split_at < 3 for r in narrow.values())
    assert {k for k, r in wide.items() if r.split_at == 3} <= {k for k, r in narrow.items() if r.split_at == 1}
    assert mixture.finalization_prompts(df, "s", limit=20).count() == 0

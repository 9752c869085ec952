"""A caller's Python in Arrow batches."""

from corvane.operators import custom


def test_generate(spark):
    df = spark.createDataFrame([(k, f"p{k}") for k in range(10)], "id int, prompt string").repartition(3)

    def complete(prompts):
        assert len(prompts) <= 2
        return [p.upper() if p != "p3" else None for p in prompts]

    got = {r.id: r.model_solution for r in custom.generate(df, "prompt", complete, batch=2).collect()}
    assert got == {k: (f"P{k}" if k != 3 else None) for k in range(10)}


def test_expand(spark):
    df = spark.range(4)
    got = custom.expand(df, lambda r: [{"id": r["id"], "n": k} for k in range(r["id"])], "id bigint, n bigint").collect()
    assert sorted((r.id, r.n) for r in got) == [(i, k) for i in range(4) for k in range(i)]


def test_score_groups(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 0, 1.0), ("b", 0, 5.0)], "prompt string, reward_index int, v double")
    got = {(r.prompt, r.reward_index): r.reward for r in custom.score_groups(df, ["prompt"], "reward_index", lambda g: (g.v - g.v.mean()).tolist()).collect()}
    assert got == {("a", 0): -1.0, ("a", 1): 1.0, ("b", 0): 0.0}

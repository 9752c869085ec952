"""Token budgets, packing and mixing."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing, packing, token_budget

CAT = [("olymp_alpha", "geometry", 0.5, 2), ("forum_beta", "algebra", 0.3, 1), ("tiny", "algebra", 0.2, 3)]


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(CAT, "source string, domain_name string, target_weight double, max_repeats int")


# ---------------------------------------------------------------- tokens


def texts(spark, catalogue, rows):
    df = spark.createDataFrame(rows, "id bigint, text string, source string, lang string, content string, n_tokens int")
    return token_budget.slices(df, "id", ["text"], catalogue, "docs")


ROWS = [(1, "hello world", "Olymp Alpha", "en", "c", 0), (2, "hello world", "hub/olymp_alpha", "English", "c", 0), (3, "另一个", "forum-beta", None, "c", 0), (4, None, "nowhere", "fr", "c", 0), (5, "", None, "und", "c", 0), (6, "a" * 200_000, "tiny", "en", "c", 0), (6, "same id", "tiny", "en", "c", 0)]


def cells(b):
    return {tuple(r[c] for c in token_budget.CELL): (r.n_texts, r.n_tokens) for r in b.cells.collect()}


def test_counts_equal_the_encoder(spark, catalogue):
    enc = token_budget.encoding(f"{token_budget.TOKENIZERS}/{token_budget.DEFAULT_FILE}")
    got = cells(token_budget.update(token_budget.empty_budget(spark), texts(spark, catalogue, ROWS)))
    n = lambda t: len(enc.encode_ordinary(t))
    assert got == {
        ("docs.text", "olymp_alpha", "en", "geometry"): (2, 2 * n("hello world")),
        ("docs.text", "forum_beta", "(none)", "algebra"): (1, n("另一个")),
        ("docs.text", "(other)", "fr", "(none)"): (1, 0),
        ("docs.text", "(other)", "(none)", "(none)"): (1, 0),
        ("docs.text", "tiny", "en", "algebra"): (2, n("a" * 200_000) + n("same id")),
    }


def test_deltas_equal_a_fresh_start(spark, catalogue):
    before = token_budget.update(token_budget.empty_budget(spark), texts(spark, catalogue, ROWS))
    changed = [r for r in ROWS if r[0] not in (2, 3)] + [(2, "hello there, world", "forum_beta", "en", "c", 0), (7, "brand new", "tiny", "de", "c", 0), (8, "hello world", "tiny", "de", "c", 0)]
    after = token_budget.update(before, texts(spark, catalogue, changed))
    assert cells(after) == cells(token_budget.update(token_budget.empty_budget(spark), texts(spark, catalogue, changed)))
    assert after.counts.count() == before.counts.count() + 2  # only what was never seen is encoded
    assert cells(token_budget.update(after, texts(spark, catalogue, changed))) == cells(after)
    gone = token_budget.update(after, texts(spark, catalogue, changed).where("id < 0"))
    assert cells(gone) == {} and gone.counts.count() == after.counts.count()


def test_totals_are_a_cube(spark, catalogue):
    b = token_budget.update(token_budget.empty_budget(spark), texts(spark, catalogue, ROWS))
    t = {(r.source, r.lang, r.domain_name): r.n_texts for r in token_budget.totals(b.cells).collect()}
    assert t["(all)", "(all)", "(all)"] == 7 and t["tiny", "(all)", "(all)"] == 2 and t["(all)", "en", "(all)"] == 4
    assert token_budget.totals(token_budget.empty_budget(spark).cells).where("n_texts > 0").count() == 0


# ---------------------------------------------------------------- packing


@pytest.mark.parametrize("windows", [1, 4, 64])
def test_stream_places_every_item_once(windows):
    rng = random.Random(windows)
    items = [(k, rng.choice([0, 1, 7, 50, 99, 100])) for k in range(500)]
    held, open_now = [], 0
    for _, rows, filled, left in packing.pack_stream(iter(items), 100, windows):
        assert sum(n for _, n in rows) == filled <= 100
        held += rows
        open_now += left
    assert sorted(held) == sorted(items) and open_now <= windows


def test_pack(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(1, 400), "x") for k in range(2000)] + [(5000, 2500, "big"), (5001, 1000, "even"), (5002, 0, "none"), (5003, None, "null"), (None, 5, "no id"), (7, 33, "again"), (8, 20, "again"), (8, 20, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, container string")
    caps = {"s": 500, "l": 1000}
    for part in (10**9, 20_000):  # one partition, and many with several rounds of leftovers
        out = packing.pack(df, caps, tokens_per_part=part, fan_in=3).collect()
        for pack, cap in caps.items():
            mine = [r for r in out if r.pack_name == pack]
            fill, size, pieces = Counter(), Counter(), defaultdict(list)
            for r in mine:
                fill[r.container] += r.n_tokens
                size[r.doc_id] += r.n_tokens
                pieces[r.doc_id].append(r)
            assert max(fill.values()) <= cap
            want = Counter()
            for i, n, _ in rows:
                if i is not None:
                    want[i] += n or 0
            assert {k: v for k, v in size.items() if v} == {k: v for k, v in want.items() if v} and set(size) == set(want)
            assert all(len(v) == 1 for i, v in pieces.items() if i not in (7, 8, 5000, 5001))
            assert len(pieces[7]) == 2 and len(pieces[8]) == 3 and sorted(p.piece_no for p in pieces[5000]) == list(range(-(-2500 // cap)))
            assert len(fill) <= (1.05 if part > 10**6 else 1.1) * sum(fill.values()) / cap + 2
    report = {r.pack_name: r for r in packing.fill_report(packing.pack(df, caps), caps).collect()}
    assert report["s"].overflowing == 0 and report["l"].fill > 0.95
    assert packing.pack(df.where("doc_id < 0"), caps).count() == 0


# ---------------------------------------------------------------- mixing


def test_allocate():
    a = mixing.allocate({"a": 100, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 2})
    assert a == pytest.approx({"a": 50, "b": 30, "c": 20})
    b = mixing.allocate({"a": 100, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 1, "c": 2}, total=160)
    assert b == pytest.approx({"a": 87.5, "b": 52.5, "c": 20}) and sum(b.values()) == pytest.approx(160)
    c = mixing.allocate({"a": 10}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}, total=1000)
    assert c == {"a": 20.0, "b": 0.0}
    assert mixing.allocate({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


def test_inclusion_scale():
    bins = [(10.0, 5), (200.0, 2)]
    k = mixing.inclusion_scale(bins, 300.0)
    assert sum(min(1, k * x) * x * n for x, n in bins) == pytest.approx(300.0)


def test_mixture(spark, catalogue):
    rng = random.Random(3)
    rows = [(k, "Olymp-Alpha", rng.randint(5, 200), 1) for k in range(3000)] + [(10_000 + k, "forum_beta", rng.randint(5, 200), 1) for k in range(1500)] + [(20_000 + k, "tiny", rng.randint(5, 50), 1) for k in range(60)]
    rows += [(30_000, "elsewhere", 50, 1), (30_001, None, 50, 1), (None, "tiny", 50, 1), (30_002, "tiny", None, 1), (30_003, "tiny", 0, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, copies int")
    used, shares = mixing.mixture(df, catalogue)
    s = {r.source: r for r in shares.collect()}
    for name, _, w, _ in CAT:
        assert s[name].actual_share == pytest.approx(w, abs=0.02)
    got = used.collect()
    assert not {r.doc_id for r in got} & {30_000, 30_001, 30_002, 30_003, None} and len({r.doc_id for r in got}) == len(got)
    most = {n: m for n, _, _, m in CAT}
    assert all(1 <= r.copies <= most[r.source] for r in got)
    for name in most:
        assert sum(r.copies * r.n_tokens for r in got if r.source == name) == s[name].actual_tokens <= s[name].target_tokens + 1e-6
    assert sorted(map(tuple, mixing.mixture(df.repartition(7), catalogue)[0].collect())) == sorted(map(tuple, got))
    big = {r.source: r for r in mixing.mixture(df, catalogue, total=1e9)[1].collect()}
    assert all(big[n].actual_tokens == most[n] * big[n].available_tokens for n in most)
    assert all(r.actual_tokens == 0 for r in mixing.mixture(df.where("doc_id < 0"), catalogue)[1].collect())


def test_larger_records_are_drawn_more_often(spark, catalogue):
    rows = [(k, "olymp_alpha", 10 if k % 2 else 40) for k in range(4000)] + [(9000 + k, "tiny", 10) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    used = mixing.mixture(df, catalogue, total=20_000)[0].where(F.col("source") == "olymp_alpha").groupBy("n_tokens").count().collect()
    n = {r.n_tokens: r["count"] for r in used}
    assert n[40] > 2.5 * n[10]


def test_updates_give_the_totals_of_a_fresh_start(spark, sf_dir):
    from corvane.llm import queries

    rows = lambda df: sorted(map(tuple, df.where("n_texts <> 0").collect()))
    assert rows(queries.p5_updates(spark, sf_dir)) == rows(queries.p5_token_totals(spark, sf_dir))


def test_a_vocabulary_is_sent_to_where_it_is_not(spark, monkeypatch):
    path = f"{token_budget.TOKENIZERS}/{token_budget.DEFAULT_FILE}"
    token_budget.send(spark, path)
    assert token_budget.local_copy(path) == path
    monkeypatch.setattr(token_budget.os.path, "exists", lambda _: False)
    sent = token_budget.local_copy(path)
    monkeypatch.undo()
    assert sent != path and token_budget.encoding(sent).encode_ordinary("hello world") == token_budget.encoding(path).encode_ordinary("hello world")

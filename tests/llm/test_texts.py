"""Language identification, pair defects and text quality."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import byte_gru, common, lang_id, pair_defects, quality


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    return {t: spark.read.parquet(f"{big}/{t}.parquet") for t in ("problems", "common_words", "documents")}


def test_gradients_equal_differences():
    net = byte_gru.ByteGRU(3, 4, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    seqs, labels = [b"abcab", b"xy", b"zzzzzzz"], np.array([0, 1, 2])
    _, grads = net.gradients(seqs, labels, 8)
    rng = np.random.default_rng(0)
    for k, g in grads.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in g.shape) if k[:2] != "wx" else (ord("abcxyz"[rng.integers(6)]), int(rng.integers(0, g.shape[1])))
            old, eps = net.w[k][at], 1e-3
            net.w[k][at] = old + eps
            up = net.gradients(seqs, labels, 8)[0]
            net.w[k][at] = old - eps
            down = net.gradients(seqs, labels, 8)[0]
            net.w[k][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.03, abs=2e-4), k


def test_pooled_does_not_depend_on_the_batch():
    net = byte_gru.ByteGRU(3, 8, 2)
    seqs = [b"hello there", b"", b"x", bytes(range(1, 250)) * 5]
    together = net.pooled(seqs, batch=3)
    for k, s in enumerate(seqs):
        assert together[k] == pytest.approx(net.pooled([s])[0], rel=1e-3, abs=1e-3)


def test_sentences_leave_out_what_has_no_language():
    t = "Let $x = 3$ be given. Then Slaemum counts 12 of them!\nStep 2: y\n$$a+b$$ N/A"
    found = lang_id.sentences(t)
    assert [t[s:e].strip() for s, e, _, _ in found] == ["Let $x = 3$ be given.", "Then Slaemum counts 12 of them!"]
    assert found[1][2] == "then counts of them"
    for empty in ("", "N/A", "$$ $$", "\\boxed{3}", "None", "123 456", "#### 7"):
        assert lang_id.sentences(empty) == []


@pytest.mark.parametrize("label, want", [("en_GB", "en"), ("English", "en"), ("EN", "en"), (" fr-CA ", "fr"), ("français", "fr"), ("中文", "zh"), ("zh-Hans", "zh"), ("und", None), ("", None), (None, None), ("n/a", None), ("it", "it"), ("deu", "de"), ("português", "pt"), ("unknown", None), ("   ", None)])
def test_language_codes(spark, label, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(label,)], "l string")
    assert df.select(common.language_code(F.col("l"))).first()[0] == want


def test_source_spellings(spark):
    from pyspark.sql import functions as F

    names = ["olymp_alpha", "OLYMP_ALPHA", " olymp alpha", "hub/olymp-alpha ", "a/b/Olymp Alpha", "olymp.alpha"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert {r[0] for r in df.select(common.source_key(F.col("s"))).collect()} == {"olymp_alpha"}


@pytest.fixture(scope="module")
def network(tables):
    rows = lang_id.training_sample(tables["problems"], ["problem", "solution"], "lang", 200, "id")
    return lang_id.train(rows, steps=600)


def test_held_out_accuracy(spark, tables, network):
    """Rows that the network was not fitted on, against script and common words."""
    words = [(r.lang, r.word) for r in tables["common_words"].collect()]
    langs = pair_defects.Languages(words)
    rows = tables["problems"].select("id", "problem").orderBy("id").collect()[::3]
    found = {(r.id): r.languages[0].lang for r in lang_id.identify(tables["problems"], "id", ["problem"], "lang", net=network).collect()}
    sure = [(r.id, langs.of(r.problem)) for r in rows if r.problem]
    judged = [(i, k) for i, (k, m) in sure if k and m > 0.3 and i in found]
    assert len(judged) > 250 and np.mean([found[i] == k for i, k in judged]) > 0.98


def test_confidence_is_no_lower_than_its_accuracy_by_much(spark, tables, network):
    """Fields labelled with 0.9 or more are right at least as often as 0.9."""
    words = [(r.lang, r.word) for r in tables["common_words"].collect()]
    langs = pair_defects.Languages(words)
    truth = {r.id: langs.of(r.problem) for r in tables["problems"].select("id", "problem").collect() if r.problem}
    found = lang_id.identify(tables["problems"], "id", ["problem"], "lang", net=network).collect()
    sure = [r.languages[0].lang == truth[r.id][0] for r in found if r.languages[0].confidence >= 0.9 and truth.get(r.id, (None, 0))[1] > 0.3]
    assert len(sure) > 200 and np.mean(sure) >= 0.97


def test_weights_are_kept_for_the_same_sample(spark, tables):
    some = spark.createDataFrame(tables["problems"].orderBy("id").limit(60).collect(), tables["problems"].schema)
    a = lang_id.fitted(some, ["problem"], "lang", 5, "id", steps=9)
    b = lang_id.fitted(some, ["problem"], "lang", 5, "id", steps=9)
    assert all((a.w[k] == b.w[k]).all() for k in a.w)
    copy = byte_gru.ByteGRU.load(a.dump())
    assert copy.pooled([b"hello"]) == pytest.approx(a.pooled([b"hello"]))


def test_network_alone_tells_scripts_apart(network):
    lab = lang_id.Labeller(network)
    keys = ["остаток принадлежит второй половине", "然后把已知的数值代入", "the remaining share belongs to the other half"]
    lab.learn(set(keys))
    assert [lang_id.LANGUAGES[lab.seen[k][0]] for k in keys] == ["ru", "zh", "en"]


def test_mixed_and_edge_fields(spark, network):
    en = "The remaining share belongs to the other half, therefore the total becomes larger. In this step the relation removes one case."
    de = "Das Gleichsetzen der beiden Seiten ergibt, dass die Summe gleich ist. Wie groß ist der Durchschnitt der Knöpfe?"
    zh = "然后，把已知的数值代入，可得一个新的等式。题目要求的数是五。"
    rows = [(1, en, "en", "a"), (2, en, "de", "a"), (3, f"{en} {de}", "en", "a"), (4, None, "en", "a"), (5, "", None, "a"), (6, "$x=1$", None, "a"), (7, f"{en}\n{zh}", "und", "a"), (8, en * 400, "English", "a"), (8, en, "English", "b"), (9, zh, None, "c")]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, languages string")
    found = lang_id.identify(df, "id", ["text"], "lang", net=network)
    wrong = sorted({(r.id, r.lang) for r in lang_id.mislabelled(found).collect()})
    assert wrong == [(2, "en"), (3, "de"), (3, "en"), (7, "en"), (7, "zh"), (9, "zh")]
    for r in found.where("id in (3, 7)").collect():
        text = dict((i, t) for i, t, _, _ in rows if i == r.id)[r.id]
        assert len(r.passages) == 2 and r.passages[0].end_at <= r.passages[1].start_at < len(text)
        assert all(0 <= p.confidence <= 1 for p in r.passages)
    assert lang_id.identify(df.where("id < 0"), "id", ["text"], "lang").count() == 0


# ---------------------------------------------------------------- pair defects

P = "A class of 463 members from Fiowuskberg plans a trip and buys 78 feathers. Every fifth box holds 12 apples more than the last one. How many apples does the class hold at the end?"
CASES = [
    ("Since the parts add up, we find $3 + 4 = 7$. The answer is $7$.", "7", None),
    ("Since the parts add up, we find $3 + 4 = 7$. The answer is $7$.", None, None),
    ("#### 7", "7", None),
    ("$46 + 28 = 74$, $\\boxed{74}$", "74", None),
    (f"The question was: {P}\nThen $3 + 4 = 7$. So the answer is $\\boxed{{7}}$.", "7", None),
    ("Both conditions contradict each other, so no solution exists: $\\boxed{\\text{no solution}}$.", "no solution", None),
    ("Así que la respuesta es $\\boxed{5}$.", "5", "other_language"),
    (None, "7", "empty"),
    ("", None, "empty"),
    (" \n ", None, "empty"),
    ("N/A", None, "empty"),
    ("<thinking>\n</thinking>\n<response> </response>", None, "empty"),
    ("\\boxed{}", None, "empty"),
    ("Solution:", None, "empty"),
    ("Since the parts add up, we find $3 + 4 = 7$. Now the", None, "truncated"),
    ("Since the parts add up, we find $3 + 4 = 7$.", None, "truncated"),
    ("Since the parts add up, we find $3 + 4 = 7$. #### ", "7", "truncated"),
    ("We conclude with $\\boxed{\\frac{1}{", "7", "truncated"),
    ("The answer is $\\boxed{12345}$.", "123", "truncated"),
    ("Unfortunately, I can't help with this problem.", None, "refusal"),
    ("Since the parts add up, we find $3 + 4 = 7$. I must decline, please ask a tutor instead.", None, "refusal"),
    ("对不起，我无法解决这道题。", None, "refusal"),
    (P, None, "copied_question"),
    (f"We are asked the following. {P.lower()}", "7", "copied_question"),
]


@pytest.mark.parametrize("solution, answer, want", CASES)
def test_pair_rules(solution, answer, want):
    words = [("en", w) for w in "the of and to in is that it for with as at by from this are we you".split()] + [("es", w) for w in "de la que y en los se por con una para del las es la respuesta así".split()]
    assert pair_defects.judge(P, solution or "", answer, pair_defects.Languages(words))[0] == want


def test_defects_table(spark, tables):
    rows = [(k, P, s, a, 1) for k, (s, a, _) in enumerate(CASES)] + [(99, None, None, None, 1)]
    df = spark.createDataFrame(rows, "id bigint, problem string, solution string, answer string, defect int")
    got = {r.id: r.defect for r in pair_defects.defects(df, tables["common_words"]).collect()}
    assert got == {**{k: w for k, (_, _, w) in enumerate(CASES) if w}, 99: "empty"}
    assert pair_defects.defects(df.where("id < 0"), tables["common_words"]).count() == 0


def test_marks_decide_before_the_rules(spark, tables):
    """A response that a neighbour goes on from is truncated even if a value
    stands near its end, and so are many that stop at one length."""
    whole = "Since the parts add up, we find that the sum of both is $3 + 4 = 7$ and so, as {} says, the answer is $7$ because"
    rows = [(1, P, whole.format("Ann"), "7"), (2, P, whole.format("Ann") + " by the rule of Ann. The answer is $7$.", "7"), (3, P, whole.format("Bea") + " of it.", "7")]
    rng = random.Random(8)
    cut = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows += [(100 + k, P, (f"{k} result is {k} " + cut[k:])[:140] + "x", None) for k in range(40)]
    rows += [(200 + k, P, f"Answer {k}: " + "so it goes on " * k + "= $5$.", None) for k in range(30)]
    df = spark.createDataFrame(rows, "id bigint, problem string, solution string, answer string")
    got = {r.id: r for r in pair_defects.defects(df, tables["common_words"]).collect()}
    assert got[1].defect == "truncated" and got[1].shortened and got[1].reason.startswith("shortened")
    assert 2 not in got and 3 not in got
    assert all(got[100 + k].at_limit and got[100 + k].reason.startswith("stops at") for k in range(40))


def test_long_ends_are_trimmed(spark, tables):
    rows = [(1, P, "The answer is $7$." + "." * 50_000 + " " * 50_000, "7"), (2, P, "The answer is $7$. " + "<b>" * 500, "7"), (3, P, "So we get " + "9" * 500, None), (4, P, " " * 100_000, None)]
    df = spark.createDataFrame(rows, "id bigint, problem string, solution string, answer string")
    assert {r.id: r.defect for r in pair_defects.defects(df, tables["common_words"]).collect()} == {3: "truncated", 4: "empty"}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_shortened_versions_across_partitions(spark, parts):
    rng = random.Random(parts)
    full = [f"{'abcdefgh'[k % 8]} response number {k} goes on and on until it states its result {k}" for k in range(60)]
    rows = [(i, t) for i, t in enumerate(full)]
    short = {}
    for k in range(0, 60, 5):
        i = 1000 + k
        short[i] = full[k][: rng.randint(25, len(full[k]) - 3)]
        rows += [(i, short[i] + rng.choice(["", "...", " "])), (i + 500, short[i])]  # two copies of the short one
    rows += [(2000 + k, full[7]) for k in range(50)] + [(3000, None), (3001, "tiny")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "id bigint, s string")
        got = {r.id for r in pair_defects.shortened_versions(df, "id", "s").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {i for k in short for i in (k, k + 500)}


def test_length_limits(spark):
    df = spark.createDataFrame([(n,) for n in list(range(100, 200)) * 1 + [150] * 40], "n int")
    assert [r.n for r in pair_defects.length_limits(df).collect()] == [150]


# ---------------------------------------------------------------- quality

PROSE = "The remaining share belongs to the other half, therefore the total becomes larger. In this step the relation removes one case."
KINDS = [
    (PROSE, "prose"),
    ("1. " + PROSE + "\n2. " + PROSE.replace("half", "part"), "prose"),
    ("the angle opposite the base amounts to 754 and the rest is known to all of us", "prose"),
    ("$$x = 3$$\n" + PROSE + "\n$$y = 4$$", "prose"),
    ("- apples\n- pears\n- the pigeonhole principle", "list"),
    ("1) 17; 2) 68; 3) 54; 4) 25; 5) 950", "list"),
    ("bells (p. 100)\ntickets (p. 62, 45)\nwheels (p. 91)", "list"),
    ("1.1 Roots ........ 3\n1.2 Primes ....... 7", "list"),
    ("pears, maps, bells, tickets, melons, the mean values, coins", "list"),
    ("| a | b |\n|---|---|\n| 1 | 2 |", "table"),
    ("a,b,c\n1,2,3\n4,,6", "table"),
    ("maps\tkeys\n1.5\t20\n2.5\t30", "table"),
    ("maps          keys\n1.5           20\n2.5           30", "table"),
    ('"a";"b";"c"\n"1";"2";"3"', "table"),
    ("<table>\n<tr><td>1</td><td>2</td></tr>\n</table>", "table"),
    ("Log in\nReply\nNext page\nQuote\nLog in\nSubscribe", "junk"),
    ("bells bells bells bells bells bells bells bells bells bells", "junk"),
    ("T h e  o l d  m a r k e t  s t o r e s  m a n y  t i c k e t s", "junk"),
    ("Fd5JB7/DvRcSbNVWinrfZyWbgsqgGwD0rz7OEYEX1zGAm3/RAiNO+kjmLrJBk3yfI9byN+5n4fUq", "junk"),
    ("[228569092] WARN worker-17 retry=1 code=0xaca46e7f rc=2\n[837810928] WARN worker-5 retry=2 code=0xe46251c6 rc=2", "junk"),
    ("Pour commencer, on Ã©crit que les cuillÃ¨res sont lÃ  et que tout va bien ici.", "junk"),
    ((PROSE.split(". ")[0] + ". ") * 5, "junk"),
    ("", "junk"),
    (None, "junk"),
]


def test_kinds(spark, tables):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(KINDS)], "doc_id bigint, text string, kind string")
    got = {r.doc_id: r.kind for r in quality.text_statistics(df, "doc_id", "text", tables["common_words"]).collect()}
    assert {k: v for k, v in got.items() if v != KINDS[k][1]} == {}
    assert quality.text_statistics(df.where("doc_id < 0"), "doc_id", "text", tables["common_words"]).count() == 0
    found = {r.doc_id: r for r in quality.not_prose(df, "doc_id", "text", tables["common_words"]).collect()}
    assert {k: r.kind for k, r in found.items()} == {k: v for k, (_, v) in enumerate(KINDS) if v != "prose"}
    kinds = {name: kind for name, kind, _ in quality.rules()}
    for r in found.values():  # the kind is that of the first failed rule with one
        assert next(kinds[x] for x in r.failed_rules.split(",") if kinds[x]) == r.kind


def test_very_long_texts_are_read_whole(spark, tables):
    rows = [(1, "$" + "x + " * 30_000 + "y$ " + PROSE), (2, PROSE + "\n" * 100_000 + PROSE), (3, "- apples\n" * 30_000), (4, "." * 200_000), (5, " " * 200_000 + PROSE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.kind for r in quality.text_statistics(df, "doc_id", "text", tables["common_words"]).collect()}
    assert got[1] == got[2] == got[5] == "prose" and got[3] != "prose" and got[4] != "prose"


def test_statistics_against_python(spark, tables):
    common_set = {r.word for r in tables["common_words"].collect()}
    texts = [(1, "The cat sat. It is here!\n- a b\n"), (2, ""), (3, None), (4, "word " * 200_000), (5, "在这里我们和他不是")]
    df = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id bigint, text string, word_count int")
    got = {r.doc_id: r for r in quality.text_statistics(df, "doc_id", "text", tables["common_words"]).collect()}
    for i, t in texts:
        toks = (t or "").split()
        assert got[i].word_count == len(toks)
        assert got[i].mean_word_length == pytest.approx(sum(map(len, toks)) / len(toks) if toks else 0)
    assert got[1].end_punct_share == 0.5 and got[1].bullet_share == 0.5
    assert got[1].common_words == sum(w in common_set for w in "the cat sat it is here a b".split())
    assert {"many_words", "few_common_words", "repeated_words"} <= set(got[4].failed_rules) and got[2].failed_rules[0] == "empty"
    assert got[5].common_word_share > 0.3


def test_words_split_by_arrow_slices():
    a = pa.array(["x y", "z", None, "w 1"])
    w, d, _ = common.word_hashes(a.slice(1, 3))
    assert d.tolist() == [0, 2, 2] and w[0] == common.word_hashes(pa.array(["z"]))[0][0]

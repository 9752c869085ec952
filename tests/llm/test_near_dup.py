"""Near-duplicate groups and cross-split overlap against brute force."""

import inspect
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import common, near_dup, split_overlap
from corvane.llm.components import connected_components


def shingle_sets(texts):
    w, d, n = common.word_hashes(pa.array(texts, pa.string()))
    sd, sh = common.shingles(w, d, n, len(texts))
    return [set(sh[sd == k].tolist()) for k in range(len(texts))]


def jac(a, b):
    return len(a & b) / max(1, len(a | b))


def closure(pairs, ids):
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in pairs:
        par[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def problems(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/problems.parquet")


def test_words_of_odd_texts():
    texts = ["Hello, world 12abc 12", "", None, "在这 份ab12。c", "ÉtÉ éTé «a» b", "a", " , "]
    w, d, n = common.word_hashes(pa.array(texts))
    assert d.tolist() == [0] * 5 + [3] * 6 + [4] * 4 + [5]
    assert n.tolist()[:5] == [False, False, True, False, True] and w[2] == w[4] and w[11] == w[12]
    again = [common.word_hashes(pa.array([t]))[0].tolist() for t in texts]
    assert w.tolist() == [x for a in again for x in a]
    parts = list(common.chunks(pa.array(texts), 4))
    assert [t for _, p in parts for t in p.to_pylist()] == texts


def test_golay_anchors_cover_every_word():
    table = near_dup.error_patterns(4)
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000).astype(np.uint32)
    err = table[near_dup._syndromes(words)]
    for x, e in zip(words, err):
        e = e[e != 0xFFFFFFFF]
        assert bin(e[0]).count("1") <= 3 and not near_dup._syndromes(x ^ e).any()
    # a word and any neighbour at distance 1 meet at the word's nearest anchor
    for x in words[:200]:
        home = x ^ table[near_dup._syndromes(np.array([x]))[0], 0]
        for b in range(23):
            y = np.uint32(x ^ (1 << b))
            e = table[near_dup._syndromes(np.array([y]))[0]]
            assert home in (y ^ e[e != 0xFFFFFFFF]).tolist()


def test_groups_equal_brute_force(spark, problems):
    rows = problems.select("id", "problem", "solution").collect()
    sets = shingle_sets([" ".join(x for x in (r.problem, r.solution) if x is not None) for r in rows])
    links = [(rows[i].id, rows[j].id) for i in range(len(rows)) for j in range(i) if sets[i] and jac(sets[i], sets[j]) >= 0.6]
    want = closure(links, [r.id for r in rows])
    got = {r.id: r.group_id for r in near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"]).collect()}
    assert got == want
    by = defaultdict(list)
    for i, g in want.items():
        by[g].append(i)
    pairs = {(a, b) for m in by.values() for a in m for b in m if a < b}
    found = near_dup.pairs_of_groups(near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"])).collect()
    assert {(r.id_a, r.id_b) for r in found} == pairs and len(found) == len(pairs)


BASE = "The old mill by the river grinds {} sacks of corn before noon and {} sacks after, while {} carts wait in the yard for the miller to count what is left over."


def test_edge_cases(spark):
    rng = random.Random(4)
    rows = [(1, None, None, "x"), (2, "", None, "x"), (3, "one", None, "x"), (3, "one", None, "y"), (None, "one", None, "z"), (4, "one", "", "z")]
    rows += [(100 + k, BASE.format(17, 29, 5), "Answer 51", "c") for k in range(40)]  # exact copies
    rows += [(200, BASE.format(17, 29, 5).upper() + "!!", "answer:\n51", "c"), (201, BASE.format(17, 29, 5).replace("river", "rvier"), "Answer 51", "c")]
    rows += [(300, "word " * 50_000, "end", "long"), (301, " ".join(str(rng.random()) for _ in range(3000)), "z", "long")]
    df = spark.createDataFrame(rows, "id bigint, problem string, solution string, group_id string")
    got = {}
    for r in near_dup.near_duplicate_groups(df, "id", ["problem", "solution"]).collect():
        assert got.setdefault(r.id, r) == r
    assert set(got) == {r[0] for r in rows if r[0] is not None}
    assert got[1].group_id == 1 and got[2].group_id == 2 and got[3].group_id == got[4].group_id == 3
    assert {got[k].group_id for k in [*range(100, 140), 200, 201]} == {100}
    assert {got[k].class_id for k in [*range(100, 140), 200]} == {100} and got[201].class_id == 201
    assert got[300].group_id == 300 and got[301].group_id == 301
    empty = df.where("id < 0")
    assert near_dup.near_duplicate_groups(empty, "id", ["problem", "solution"]).count() == 0
    assert near_dup.pairs_of_groups(near_dup.near_duplicate_groups(empty, "id", ["problem", "solution"])).count() == 0


def test_salted_bins_give_the_same_groups(spark, problems):
    plain = {r.id: r.group_id for r in near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"]).collect()}
    salted = {r.id: r.group_id for r in near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"], bin_rows=3).collect()}
    assert plain == salted


def test_salted_bins_compare_followers_across_bins(spark):
    """Edges of two tight clusters are within the limit, their cores, which lead
    them in their bins, are not within it of the other cluster at all."""
    core_a, edge_a, edge_b, core_b = ((1 << k) - 1 for k in (0, 6, 17, 23))
    rows = [(k, 0, (core_a if k < 60 else core_b)) for k in range(120)]
    rows += [(200 + k, 0, edge_a) for k in range(8)] + [(300 + k, 0, edge_b) for k in range(8)]
    reps = spark.createDataFrame(rows, "id bigint, f0 bigint, f1 bigint")
    for bin_rows in (1000, 50):
        got = near_dup._close_pairs(reps, 2, 23, 1, 12, 6, bin_rows).collect()
        assert {(200 + k, 300 + j) for k in range(8) for j in range(8)} <= {(r.a, r.b) for r in got}


def test_more_anchors_give_the_same_groups(spark, problems):
    assert [near_dup.extra_bits(n) for n in (0, 1 << 20, (1 << 20) + 1, 1 << 22, 10**9)] == [0, 0, 1, 2, 10]
    plain = {r.id: r.group_id for r in near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"]).collect()}
    for extra in (3, 10):
        assert plain == {r.id: r.group_id for r in near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"], extra=extra).collect()}


BANDS = inspect.signature(near_dup.near_duplicate_groups).parameters["bands"].default


@pytest.mark.parametrize("bands, width", [(1, 23), (6, 23), (8, 23), (8, 35), (11, 29)])
def test_packed_fingerprints_keep_their_distances(bands, width):
    fp = np.random.default_rng(bands).integers(0, 1 << width, (40, bands))
    packed = near_dup._packed(fp, width).view(np.uint64)
    want = sum(np.bitwise_count(fp[:, None, k] ^ fp[None, :, k]).astype(int) for k in range(bands))
    got = np.stack([near_dup._distance(packed, i, np.arange(40)) for i in range(40)])
    assert (got == want).all() and packed.shape[1] == -(-bands * width // 64)


def test_no_fewer_pairs_meet_with_more_bits():
    rng, size = np.random.default_rng(3), 200_000
    x = rng.integers(0, 1 << 23, size).astype(np.uint32)
    home = lambda w: w ^ near_dup.error_patterns(3)[near_dup._syndromes(w), 0]
    for similarity in (0.6, 0.7, 0.8):
        p = (1 - similarity) / 2
        y = x ^ sum((rng.random(size) < p).astype(np.uint32) << np.uint32(b) for b in range(23))
        d = np.minimum(np.bitwise_count(y ^ home(x)), np.bitwise_count(x ^ home(y)))
        in_band = lambda e: (1 - p) ** e * (d <= 4).mean() + e * p * (1 - p) ** max(0, e - 1) * (d <= 3).mean()  # noqa: B023, E731
        meet = [1 - (1 - in_band(e)) ** near_dup.bands_for(BANDS, e) for e in range(13)]
        assert min(meet) >= meet[0] - 0.003 and meet[0] > {0.6: 0.88, 0.7: 0.97, 0.8: 0.998}[similarity]
    assert inspect.signature(near_dup.near_duplicate_groups).parameters["extra"].default == 0  # the same at every size


@pytest.mark.parametrize("bin_rows", [2_000_000, 100])
def test_crowd_of_near_copies_is_one_group(spark, bin_rows):
    rng = random.Random(9)
    words = BASE.format(17, 29, 5).split() + [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"{w}x{k}" for w in words)) for k in range(600)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    assert {r.group_id for r in near_dup.near_duplicate_groups(df, "id", ["t"], bin_rows=bin_rows).collect()} == {0}


def test_crowd_keeps_every_undecided_link_between_parts():
    fps = np.array([[0xFF], [0], [0x7F], [0x3F]], np.int64)  # 2 and 3, not at home, join 0; 1 is 8, 7 and 6 bits from them
    links = near_dup._crowd_links(np.arange(4), fps, 2, 10, 3)
    found = np.concatenate(links[0] if isinstance(links, tuple) else links, 1)
    assert {(0, 1), (1, 2), (1, 3)} <= set(zip(found[0].tolist(), found[1].tolist()))


def test_distance_limit_leaves_room_for_the_threshold(spark, monkeypatch):
    """A pair at the threshold lies 36.8 bits of 184 apart, with a deviation of 5.4."""
    seen = []
    compare = near_dup._close_pairs
    monkeypatch.setattr(near_dup, "_close_pairs", lambda *a: seen.append(a[4]) or compare(*a))
    near_dup.near_duplicate_groups(spark.createDataFrame([(1, "a b c")], "id bigint, t string"), "id", ["t"])
    assert seen == [53]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    ids = {x for p in links for x in p if x is not None and None not in p and p[0] != p[1]}
    want = closure([p for p in links if None not in p and p[0] != p[1]], ids)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_exact_similarity(spark):
    a = ["the cat sat on 12 mats", "x", "", "a b c " * 40_000]
    b = ["The cat sat, on 12 mats", "y", "", "a b c"]
    sets = shingle_sets(a + b)
    got = near_dup.jaccard(pa.array(a), pa.array(b))
    assert got.tolist() == pytest.approx([jac(sets[k], sets[k + 4]) for k in range(4)])


# ---------------------------------------------------------------- cross-split overlap


def test_passages_are_the_text():
    n = split_overlap.normalise("The quick, BROWN fox — jumps over 3 lazy dogs; 中文字 and then some")
    parts = split_overlap.passages(n)
    assert parts[0][0] == 0 and parts[-1][1] == len(n)
    assert all(p[1] == q[0] + 1 for p, q in zip(parts, parts[1:])) and all(n[s:e] == p for s, e, p in parts)


def test_overlap_equals_brute_force(spark, problems):
    rows = [r for r in problems.select("id", "problem", "split_name").collect() if r.problem]
    sets = shingle_sets([r.problem for r in rows])
    want = {tuple(sorted((rows[i].id, rows[j].id))) for i in range(len(rows)) for j in range(i) if (rows[i].split_name == "train") != (rows[j].split_name == "train") and sets[i] and jac(sets[i], sets[j]) >= 0.55}
    got = split_overlap.cross_split_pairs(problems).collect()
    assert {tuple(sorted((r.train_id, r.eval_id))) for r in got} == want and len(got) == len(want)
    records = split_overlap.overlap_by_record(problems)
    report = split_overlap.overlap_report(records).collect()
    assert sum(r.n_pairs for r in report) == len(want) and {r.split_name for r in report} <= {"validation", "test"}
    cover = {r.id: r for r in records.collect()}
    train = [split_overlap.normalise(r.problem) for r in rows if r.split_name == "train"]
    for r in rows:
        n = split_overlap.normalise(r.problem)
        if r.split_name == "train" or n.strip() == b"":
            continue
        parts = split_overlap.passages(n)
        marked = bytearray(len(n))
        for s, e, p in parts:
            if any(p in t for t in train):
                marked[s:e] = b"\1" * (e - s)
        assert cover[r.id].coverage == pytest.approx(sum(marked) / len(n), abs=1e-5)


def test_intervals_that_touch_are_merged():
    bounds = [(0, 10), (9, 20), (19, 30), (29, 41)]
    assert split_overlap.merged([True, True, False, True], bounds) == [(0, 20), (29, 41)]
    assert split_overlap.merged([False] * 4, bounds) == [] and split_overlap.merged([], []) == []


def test_report_counts_copies_without_pairs(spark):
    t = BASE.format(17, 29, 5)
    rows = [(k, t if k % 2 else t.replace("corn", "cron"), "train", "a") for k in range(50)] + [(100 + k, t, "test", "a") for k in range(30)] + [(200, "nothing of this kind stands anywhere else at all", "test", "b")]
    df = spark.createDataFrame(rows, "id bigint, problem string, split_name string, source string")
    got = {r.source: r for r in split_overlap.overlap_report(split_overlap.overlap_by_record(df)).collect()}
    assert (got["a"].n_records, got["a"].n_overlapping, got["a"].n_pairs, got["a"].mean_coverage) == (30, 30, 1500, 1.0)
    assert (got["b"].n_records, got["b"].n_overlapping, got["b"].n_pairs) == (1, 0, 0)
    assert split_overlap.overlap_by_record(df.where("id < 0")).count() == 0


def test_nothing_but_results_is_left(spark, problems):
    from pathlib import Path

    from corvane.sources import store

    folder = Path(store.application_dir(spark).removeprefix("file:").replace("//", "/"))
    before = set(folder.iterdir())
    near_dup.near_duplicate_groups(problems, "id", ["problem", "solution"])
    split_overlap.cross_split_pairs(problems)
    left = sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)
    assert left == ["groups", "pairs"]


def test_hot_groups_are_dealt_out(spark):
    groups = spark.createDataFrame([(k, 0, 1 if k < 90 else k) for k in range(100)], "id bigint, class_id bigint, group_id bigint")
    for rows_a_task in (7, 2048):
        got = [(r.id_a, r.id_b) for r in near_dup.pairs_of_groups(groups, rows_a_task).collect()]
        assert len(got) == len(set(got)) == 90 * 89 // 2 and all(a < b < 90 for a, b in got)


def test_overlap_edge_cases(spark):
    t = BASE.format(17, 29, 5)
    rows = [(1, t, "train", 0), (2, t, "train", 0), (3, t.upper() + " ", "test", 0), (4, t.replace("river", "rvier").replace("corn", "cron"), "validation", 0), (5, None, "test", 0), (6, "", "train", 0), (7, "", "test", 0), (8, "hi", "train", 0), (9, "Hi!", None, 0), (10, BASE.format(3, 4, 9).replace("mill", "shop"), "test", 0)]
    df = spark.createDataFrame(rows, "id bigint, problem string, split_name string, key int")
    got = {(r.train_id, r.eval_id) for r in split_overlap.cross_split_pairs(df).collect()}
    assert {(1, 3), (2, 3), (1, 4), (2, 4), (8, 9)} <= got and not {5, 6, 7} & {x for p in got for x in p}
    small = {(r.train_id, r.eval_id) for r in split_overlap.cross_split_pairs(df, shard_passages=2).collect()}
    assert small == got
    assert split_overlap.cross_split_pairs(df.where("id < 0")).count() == 0
    assert split_overlap.cross_split_pairs(df.where("split_name = 'train'")).count() == 0
    assert split_overlap.cross_split_pairs(df.where("split_name = 'test'")).count() == 0


def test_overlap_of_an_edited_text_with_a_sibling(spark):
    """The sound passages of an edited evaluation text stand in its sibling too,
    so its rarest passages are the edited ones."""
    rng = random.Random(6)
    rows, want = [], set()
    for k in range(30):
        words = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.randrange(900)}x" for _ in range(110)]
        edited = list(words)
        for at in range(4, 110, 9):
            edited[at] = f"new{at}y{k}"
        texts = [" ".join(words), " ".join([*words, f"tail{k}"]), " ".join(edited)]
        rows += [(10 * k + j, t, s) for j, (t, s) in enumerate(zip(texts, ("train", "test", "validation")))]
        sets = shingle_sets(texts)
        assert jac(sets[0], sets[2]) >= 0.55
        want |= {(10 * k, 10 * k + 1), (10 * k, 10 * k + 2)}
    df = spark.createDataFrame(rows, "id bigint, problem string, split_name string")
    assert {(r.train_id, r.eval_id) for r in split_overlap.cross_split_pairs(df).collect()} == want
    assert {(r.train_id, r.eval_id) for r in split_overlap.cross_split_pairs(df, shard_passages=50).collect()} == want


def word_texts(rng, n, words=("a", "bc", "def", "ghij", "klmno", "pqrstu", "7", "42", "中", "文字")):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(n)]


def test_keys_find_what_stands_in_a_text():
    """Passages of any length, the last and short ones too, meet by key the texts
    in which they stand, and no other."""
    rng = random.Random(4)
    held, train = ([split_overlap.normalise(t) for t in word_texts(rng, n)] for n in (300, 200))
    doc, key, size, words = split_overlap._eval_passages(held)
    cut = [(k, p) for k, n in enumerate(held) for _, _, p in split_overlap.passages(n)]
    assert [k for k, _ in cut] == doc.tolist() and [len(p) for _, p in cut] == size.tolist() and 0 < words.astype(bool).sum() <= len(held)
    odd = np.zeros(1 << split_overlap.ODD_BITS >> 3, np.uint8)
    for s in np.concatenate(split_overlap._odd_slots(key[words > 0])):
        odd[s >> np.uint64(3)] |= 1 << int(s & np.uint64(7))
    keys, rows = split_overlap._train_passages(train, odd, sorted({*words.tolist()} - {0}))
    pairs = list(zip(keys.tolist(), rows.tolist()))
    assert len(pairs) == len(set(pairs))
    got, number = set(pairs), dict(zip([p for _, p in cut], key.tolist()))
    want = {(k, j) for p, k in number.items() for j, t in enumerate(train) if p in t}
    assert len(set(number.values())) == len(number) and {x for x in got if x[0] in set(number.values())} == want


def test_parity_maps_never_refuse_a_pair():
    rng = random.Random(5)
    texts = [BASE.format(*(rng.randrange(99) for _ in range(3))) + t for t in word_texts(rng, 120)]
    sets = shingle_sets(texts)
    n, maps = split_overlap._parity(pa.array(texts))
    assert n.tolist() == [len(s) for s in sets]
    apart = np.bitwise_count(maps[:, None] ^ maps[None]).astype(int)
    apart = np.maximum(apart[..., 0] + apart[..., 1], apart[..., 2] + apart[..., 3])
    assert all(apart[i, j] <= len(sets[i] ^ sets[j]) for i in range(len(texts)) for j in range(i))


def test_a_training_text_is_dealt_out_once_for_any_number_of_parts(spark):
    """The passages of the training texts are as many for one part of the
    evaluation passages as for fifty; scans by every shard would multiply them."""
    rng = random.Random(6)
    train = spark.createDataFrame(list(enumerate(word_texts(rng, 60))), "content bigint, text string")
    odd = np.zeros(1 << split_overlap.ODD_BITS >> 3, np.uint8)
    held = {}
    for parts, blocks in ((1, 1), (50, 3)):
        rows = split_overlap._train_blobs(train, parts, blocks, odd, []).collect()
        assert {r.part // parts for r in rows} <= set(range(blocks))
        held[parts] = sorted(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]).tolist())
    assert held[1] == held[50] and held[1]


def test_hot_passages_meet_in_blocks_as_pairs_do(spark):
    """Every text has one stock passage, so one key has more pairs than are
    compared at a time."""
    stock = "which of these numbers is the largest of them all"
    rng = random.Random(7)
    body = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(900)}x" for _ in range(14))
    bodies = [body() for _ in range(400)]
    rows = [(k, f"{stock} {b}", "train") for k, b in enumerate(bodies)] + [(1000 + k, f"{stock} {b} {'more ' * (k % 3)}", "test") for k, b in enumerate(bodies[:150])] + [(2000 + k, f"{stock} {body()}", "test") for k in range(150)]
    df = spark.createDataFrame(rows, "id bigint, problem string, split_name string")
    sets = {r[0]: s for r, s in zip(rows, shingle_sets([r[1] for r in rows]))}
    want = {(i, j) for i in range(400) for j in sets if j >= 1000 and jac(sets[i], sets[j]) >= 0.55}
    assert len(want) >= 150
    for shard_passages in (250_000, 20):
        assert {(r.train_id, r.eval_id) for r in split_overlap.cross_split_pairs(df, shard_passages=shard_passages).collect()} == want

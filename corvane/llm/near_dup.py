"""Problem 1: groups of records that are one text up to small edits.

Anchor-point covering. Each distinct text gets a fingerprint of one-bit
min-hashes over its wording (neighbouring word pairs, and numbers alone). The
fingerprint is cut into bands of 23 bits and more; the anchors of a band are the
4096 words of the perfect binary Golay code, whose balls of radius 3 cover all
2**23 words, times all words of the bits beyond 23 (radius 0). Bits and bands
are the same at every size; a caller may ask for more bits, and gets so many
more bands that no fewer pairs meet. A text is at home at its nearest anchor and is replicated
to every anchor within the covering radius plus ``band_threshold``: two texts
whose bands differ in at most ``band_threshold`` bits always meet where one is
at home. At each anchor homes are compared with all that came, by the distance of
whole fingerprints, in blocks; what the distance cannot decide is settled by
the exact similarity of the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import CHUNK_BYTES, chunks, materialise, mix64, scratch, shingles, word_hashes
from corvane.llm.components import connected_components

BITS, RADIUS, GENERATOR = 23, 3, 0b101011100011


def _syndromes(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.uint32).copy()
    for k in range(BITS - 1, 10, -1):
        r ^= np.where((r >> np.uint32(k)) & np.uint32(1), np.uint32(GENERATOR << (k - 11)), np.uint32(0))
    return r


_tables: dict[int, np.ndarray] = {}


def error_patterns(radius: int) -> np.ndarray:
    """[syndrome, k] error patterns of weight up to ``radius``, lightest first,
    padded with 2**32-1. The first is the way to the nearest anchor."""
    if radius not in _tables:
        from itertools import combinations

        pats = np.array([sum(1 << b for b in c) for w in range(radius + 1) for c in combinations(range(BITS), w)], np.uint32)
        syn = _syndromes(pats)
        order = np.argsort(syn, kind="stable")
        syn, pats = syn[order], pats[order]
        start = np.searchsorted(syn, np.arange(2048))
        rank = np.arange(len(syn)) - start[syn]
        table = np.full((2048, rank.max() + 1), 0xFFFFFFFF, np.uint32)
        table[syn, rank] = pats
        _tables[radius] = table
    return _tables[radius]


def _functions(bits: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:bits] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[bits:] >> np.uint64(32)).astype(np.uint32)


def extra_bits(texts: int) -> int:
    """Bits beyond 23 in a band at which anchors double with every doubling of
    more than a million texts; for callers that want them."""
    return min(12, max(0, (max(1, texts) - 1).bit_length() - 20))


def bands_for(bands: int, extra: int) -> int:
    """Bands of 23 + ``extra`` bits in which, at every similarity from 0.6 on, at
    least as many pairs meet as in ``bands`` of 23 bits (``band_threshold`` 1)."""
    return math.ceil(bands * 1.207**extra)


def fingerprint_batch(texts: pa.Array, bands: int, width: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content hash, number of shingles, [doc, band] fingerprint) of texts.
    The content hash is of the words in order; layout, case and punctuation
    play no role."""
    n = len(texts)
    content, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
    fp = np.zeros((n, bands), np.int64)
    mul, add = _functions(bands * width)
    for lo, part in chunks(texts):
        w, d, num = word_hashes(part)
        if not len(w):
            continue
        first = np.flatnonzero(np.diff(d, prepend=-1))
        pos = np.arange(len(w), dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, len(w)))).astype(np.uint64)
        content[lo + d[first]] = np.add.reduceat(mix64(w + mix64(pos)), first).view(np.int64)
        sd, sh = shingles(w, d, num, len(part))
        first = np.flatnonzero(np.diff(sd, prepend=-1))
        docs = lo + sd[first]
        count[docs] = np.diff(np.append(first, len(sd)))
        for k in range(bands * width):
            low = np.minimum.reduceat(sh * mul[k] + add[k], first)
            fp[docs, k // width] |= ((low * np.uint32(0x85EBCA6B) >> np.uint32(24)) & np.uint32(1)).astype(np.int64) << (k % width)
    return content, count, fp


def _fingerprints(df: DataFrame, bands: int, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            content, count, fp = fingerprint_batch(b.column(1), bands, width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content), pa.array(count), *(pa.array(fp[:, k]) for k in range(bands))], ["id", "content", "n", *(f"f{k}" for k in range(bands))])

    return df.mapInArrow(run, "id bigint, content bigint, n int, " + ", ".join(f"f{k} bigint" for k in range(bands)))


def _words(bands: int, width: int) -> int:
    """64-bit words of a fingerprint."""
    return -(-bands * width // 64)


def _packed(fp: np.ndarray, width: int) -> np.ndarray:
    """[doc, band] fingerprints as [doc, word], bit after bit; as signed numbers,
    for the columns of a table."""
    bits = fp.astype(np.uint64)
    out = np.zeros((len(fp), _words(fp.shape[1], width)), np.uint64)
    for k in range(fp.shape[1]):
        word, at = divmod(k * width, 64)
        out[:, word] |= bits[:, k] << np.uint64(at)
        if at + width > 64:
            out[:, word + 1] |= bits[:, k] >> np.uint64(64 - at)
    return out.view(np.int64)


def _to_anchors(reps: DataFrame, bands: int, width: int, band_threshold: int, salts: dict[int, int] | None = None) -> DataFrame:
    """(key, salt, id, fingerprint words): a row for each anchor of each text.
    ``key`` is the anchor with a last bit of 0 at home. Texts at an anchor named
    in ``salts`` are spread over so many bins, and go to each pair of bins with
    theirs, numbered by the salt; elsewhere the salt is -1."""
    from itertools import combinations

    extra = width - BITS
    words = _words(bands, width)
    cols = ", ".join(f"w{k} bigint" for k in range(words))
    kind = np.int64 if extra else np.int32
    flips = [(sum(1 << e for e in c), RADIUS + band_threshold - j) for j in range(min(band_threshold, extra) + 1) for c in combinations(range(extra), j)]

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            fp = np.stack([b.column(f"f{k}").to_numpy() for k in range(bands)], 1)
            packed = _packed(fp, width)
            for k in range(bands):
                code, beyond = (fp[:, k] & ((1 << BITS) - 1)).astype(np.uint32), fp[:, k] >> BITS
                syndrome = _syndromes(code)
                for flip, radius in flips:
                    err = error_patterns(radius)[syndrome]
                    row, rank = np.nonzero(err != 0xFFFFFFFF)
                    anchor = ((code[row] ^ err[row, rank]) >> np.uint32(11)).astype(np.int64)
                    where = (((k << 12) | anchor) << extra) | (beyond[row] ^ flip)
                    key = where * 2 + ((rank != 0) | (flip != 0))
                    salt = np.full(len(row), -1, np.int32)
                    for hot, n in (salts or {}).items():
                        at = np.flatnonzero(where == hot)
                        if len(at):
                            own = (mix64(ids[row[at]].view(np.uint64)) % np.uint64(n)).astype(np.int64)[:, None]
                            other = np.arange(n)[None, :]
                            pair = (np.minimum(own, other) * n + np.maximum(own, other)).astype(np.int32).ravel()
                            take = np.concatenate([np.flatnonzero(where != hot), np.repeat(at, n)])
                            salt = np.concatenate([salt[where != hot], pair])
                            row, where, key = row[take], where[take], key[take]
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(kind)), pa.array(salt), pa.array(ids[row]), *(pa.array(packed[row, j]) for j in range(words))], ["key", "salt", "id", *(f"w{j}" for j in range(words))])

    return reps.mapInArrow(run, f"key {'bigint' if extra else 'int'}, salt int, id bigint, {cols}")


CROWD, DENSE = 4096, 4  # members; links a member


def _distance(fps: np.ndarray, i, j) -> np.ndarray:
    """Bits in which fingerprints ``i`` and ``j`` (broadcast) differ."""
    words = fps.shape[1]
    d = np.bitwise_count(fps[i, 0] ^ fps[j, 0])
    if words > 3:
        d = d.astype(np.uint16)
    for k in range(1, words):
        d += np.bitwise_count(fps[i, k] ^ fps[j, k])
    return d


def _all_links(ids: np.ndarray, fps: np.ndarray, homes: int, limit: int) -> list[np.ndarray] | None:
    """Every link (a, b, distance) of a home with a member; None if they are
    more than ``DENSE`` for each member."""
    d = np.bitwise_count(fps[:homes, 0][:, None] ^ fps[:, 0][None, :])
    if fps.shape[1] > 3:
        d = d.astype(np.uint16)
    for k in range(1, fps.shape[1]):
        d += np.bitwise_count(fps[:homes, k][:, None] ^ fps[:, k][None, :])
    x, y = np.nonzero(d <= limit)
    if len(x) - homes > DENSE * len(ids):
        return None
    keep = (ids[x] < ids[y]) | ((ids[x] > ids[y]) & (y >= homes))
    x, y = x[keep], y[keep]
    return [np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), d[x, y].astype(np.int64)])]


def _crowd_links(ids: np.ndarray, fps: np.ndarray, homes: int, limit: int, sure: int) -> list[np.ndarray]:
    """Links of a crowd at one anchor: enough for its connected parts, never all
    pairs that are sure.

    A home is surely linked to one member of each part it is not yet in, which
    joins the parts. Links that are not sure are all kept, since one may fail
    where another with the same part passes. Members of its part within half the limit follow it:
    whatever lies within the limit of a follower lies within one and a half of
    the leader, so followers are compared with that rim alone."""
    n, radius = len(ids), limit // 2
    part, follows = np.arange(n), np.zeros(n, bool)
    everyone = np.arange(n)
    out = []

    def link(i: int, near: np.ndarray, d: np.ndarray) -> None:
        for chosen, joins in ((d <= sure, True), (d > sure, False)):
            y, dy = near[chosen], d[chosen]
            apart = part[y] != part[i]
            if apart.any():
                y, dy = y[apart], dy[apart]
                if joins:
                    parts, first = np.unique(part[y], return_index=True)
                    y, dy = y[first], dy[first]
                out.append(np.stack([np.minimum(ids[i], ids[y]), np.maximum(ids[i], ids[y]), dy.astype(np.int64)]))
                if joins:
                    part[np.isin(part, parts)] = part[i]

    for i in range(homes):
        if follows[i]:
            continue
        d = _distance(fps, i, everyone)
        near = np.flatnonzero(d <= limit)
        link(i, near, d[near])
        own = part == part[i]
        members = np.flatnonzero((d <= radius) & own & ~follows)
        members = members[members != i]
        rim = np.flatnonzero((d <= limit + radius) & ~own) if len(members) else members
        if len(rim):
            for a in members[members < homes]:
                da = _distance(fps, a, rim)
                if (at := np.flatnonzero(da <= limit)).size:
                    link(a, rim[at], da[at])
        follows[members] = True
    return out


def _compare(anchored: DataFrame, bands: int, width: int, limit: int, sure: int) -> DataFrame:
    """Links (a < b, distance) of homes with all others at their anchor. Rows
    come sorted by anchor, homes first. A crowd (more than CROWD members, or more
    than DENSE links for each) gives no more sure links than its
    connected parts need."""
    words = _words(bands, width)

    def run(batches):
        held: list[list[np.ndarray]] = []

        def flush(rows):
            group, home, ids = rows[0], rows[1], rows[2]
            cut = np.flatnonzero(np.diff(group, prepend=-1))
            found = []
            for s, e in zip(cut, np.append(cut[1:], len(group))):
                homes = int(home[s:e].sum())
                if homes and e - s > 1:
                    links = _all_links(ids[s:e], rows[3][s:e], homes, limit) if e - s <= CROWD else None
                    if links is None:
                        links = _crowd_links(ids[s:e], rows[3][s:e], homes, limit, sure)
                    found += links
            if found:
                m = np.concatenate(found, 1)
                m = m[:, np.unique(m[0] * np.int64(0x9E3779B1) ^ m[1], return_index=True)[1]]
                return pa.RecordBatch.from_arrays([pa.array(m[0]), pa.array(m[1]), pa.array(m[2].astype(np.int32))], ["a", "b", "d"])

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy().astype(np.int64)
            rows = [((key >> 1) << 32) | (b.column(1).to_numpy().astype(np.int64) + 1), key & 1 == 0, b.column(2).to_numpy(), np.stack([b.column(3 + j).to_numpy() for j in range(words)], 1).view(np.uint64)]
            if held:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                done = flush([x[:cut] for x in rows])
                if done is not None:
                    yield done
            held = [x[cut:] for x in rows]
        if held and len(held[0]) and (done := flush(held)) is not None:
            yield done

    anchor = F.expr("shiftright(key, 1)")
    sorted_rows = anchored.repartition(anchor, "salt").sortWithinPartitions(anchor, "salt", "key", "id")
    return sorted_rows.mapInArrow(run, "a bigint, b bigint, d int")


def _close_pairs(reps: DataFrame, bands: int, width: int, band_threshold: int, limit: int, sure: int, bin_rows: int) -> DataFrame:
    """(a, b, d) of texts that meet at an anchor within ``limit``.

    An anchor holds a text once, so none can exceed ``bin_rows`` if the texts
    don't. Otherwise anchors are counted (their number is fixed by the code),
    those above are spread over salted bins of half that size, and every two bins
    are compared together, so any two texts at an anchor are."""
    if reps.count() <= bin_rows:
        return _compare(_to_anchors(reps, bands, width, band_threshold), bands, width, limit, sure)
    sizes = _to_anchors(reps, bands, width, band_threshold).groupBy(F.expr("shiftright(key, 1)").alias("anchor")).count().where(F.col("count") > bin_rows).collect()
    salts = {r["anchor"]: -(-2 * r["count"] // bin_rows) for r in sizes}
    return _compare(_to_anchors(reps, bands, width, band_threshold, salts), bands, width, limit, sure)


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact similarity of the wording of texts, pair by pair."""
    size = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    done = np.cumsum(size[0] + size[1])
    out = np.zeros(len(a))
    lo = 0
    while lo < len(a):
        hi = int(max(lo + 1, np.searchsorted(done, (done[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
        k = hi - lo
        w, d, num = word_hashes(pa.concat_arrays([a.slice(lo, k), b.slice(lo, k)]))
        sd, sh = shingles(w, d, num, 2 * k)
        n = np.bincount(sd, minlength=2 * k)
        u, c = np.unique(((sd % k).astype(np.uint64) << np.uint64(32)) | sh, return_counts=True)
        common = np.bincount((u[c == 2] >> np.uint64(32)).astype(np.int64), minlength=k)
        out[lo:hi] = common / np.maximum(1, n[:k] + n[k:] - common)
        lo = hi
    return out


def exact_similarity(pairs: DataFrame, texts: DataFrame, max_broadcast_ids: int = 100_000) -> DataFrame:
    """``pairs`` (a, b, ...) with ``similarity`` of their ``texts`` (id, text).
    Only texts named in pairs travel; their ids are broadcast only if a count
    has shown that they are few."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    few = ids.count() <= max_broadcast_ids
    named = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    joined = pairs.join(named.select(F.col("id").alias("a"), F.col("text").alias("_ta")), "a").join(named.select(F.col("id").alias("b"), F.col("text").alias("_tb")), "b")

    def run(batches):
        for b in batches:
            s = jaccard(b.column("_ta"), b.column("_tb"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s)], ["a", "b", "similarity"])

    return joined.select("a", "b", "_ta", "_tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def near_duplicate_groups(
    df: DataFrame, id_col: str, text_cols: list[str], similarity: float = 0.6, bands: int = 8, band_threshold: int = 1, sure: int | None = None, limit: int | None = None, bin_rows: int = 2_000_000, extra: int = 0
) -> DataFrame:
    """(id, class_id, group_id): one row per record of ``df``.

    ``class_id`` is the smallest id with the same words in the same order;
    ``group_id`` the smallest id of its near-duplicate group (its own class
    where it is alone). ``text_cols`` are compared together, null counting as empty.

    ``extra`` (0 to 12) bits a band give more anchors with fewer texts each.

    Links of fingerprint distance up to ``sure`` are taken; those between
    ``sure`` and ``limit`` are settled by the exact similarity, unless the sure
    ones have joined their two parts already. Records without any word have no
    class: their ids stand for themselves. A null id is dropped; repeated ids
    count once; other columns are ignored. An empty table gives an empty result.
    """
    with scratch(df.sparkSession) as tables:
        return tables.keep(materialise(_groups(df, id_col, text_cols, similarity, bands, band_threshold, sure, limit, bin_rows, extra), "groups"))


def _groups(df, id_col, text_cols, similarity, bands, band_threshold, sure, limit, bin_rows, extra) -> DataFrame:
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.concat_ws(" ", *text_cols).alias("text")).where("id is not null")
    width, bands = BITS + extra, bands_for(bands, extra)
    bits = bands * width
    sure = sure if sure is not None else round(bits * (1 - similarity - 0.18) / 2)
    limit = limit if limit is not None else round(bits * (1 - similarity + 0.18) / 2)
    marks = materialise(_fingerprints(texts, bands, width), "marks")
    fps = [f"f{k}" for k in range(bands)]
    reps = materialise(marks.where("n > 0").groupBy("content", *fps).agg(F.min("id").alias("id")).select("id", *fps), "reps")
    close = _close_pairs(reps, bands, width, band_threshold, limit, sure, bin_rows)
    pairs = materialise(close.groupBy("a", "b").agg(F.min("d").alias("d")).where("a <> b"), "pairs")
    part = materialise(connected_components(pairs.where(F.col("d") <= sure).select("a", "b")), "parts")
    side = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    sides = pairs.where(F.col("d") > sure).select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    sides = materialise(sides.select("a", "b", F.coalesce("_a", "a").alias("pa"), F.coalesce("_b", "b").alias("pb")).where("pa <> pb"), "sides")
    near = exact_similarity(sides.select("a", "b"), texts).where(F.col("similarity") >= similarity)
    joined = connected_components(sides.join(near.select("a", "b"), ["a", "b"], "left_semi").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
    over = materialise(joined.select(F.col("id").alias("component"), F.col("component").alias("_top")), "over")  # parts that came together
    inside = part.join(over, "component", "left").select(F.col("id").alias("class_id"), F.coalesce("_top", "component").alias("component"))
    alone = over.join(part.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("class_id"), F.col("_top").alias("component"))
    named = inside.unionByName(alone)
    classes = marks.groupBy("content", F.when(F.col("n") == 0, F.col("id")).alias("empty_id")).agg(F.min("id").alias("class_id"))
    members = marks.select("id", "content", F.when(F.col("n") == 0, F.col("id")).alias("empty_id")).distinct()
    with_class = members.join(classes, (members["content"] == classes["content"]) & members["empty_id"].eqNullSafe(classes["empty_id"])).select("id", "class_id")
    return with_class.join(named, "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"))


def pairs_of_groups(groups: DataFrame, rows_a_task: int = 2048) -> DataFrame:
    """(id_a < id_b) of all records that share a group.

    A group of more than ``rows_a_task`` records is dealt out to as many salts as
    it has multiples of that: each record is once on the left, under its own
    salt, and on the right under all salts of its group."""
    size = groups.groupBy("group_id").count().where("count > 1").select("group_id", F.ceil(F.col("count") / rows_a_task).cast("int").alias("salts"))
    inside = groups.join(size, "group_id").select("id", "group_id", "salts")
    left = inside.select(F.col("id").alias("id_a"), "group_id", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = inside.select(F.col("id").alias("id_b"), "group_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["group_id", "salt"]).where("id_a < id_b").select("id_a", "id_b")

"""Problem 4: evaluation records that stand, exactly or almost, in training.

Evaluation texts are cut into passages of a few normalised words. Where a
passage ends follows from where it begins, so the passages that a training text
can hold are one for each of its words; each text is cut once and its passages
go, as hashes, to parts of the keys, where the evaluation texts that have them
wait. Of pairs that share one, the numbers of shingles and parity maps of the
texts (exact bounds of the similarity) leave few; these are settled by the exact
similarity and by an Aho-Corasick automaton of the passages. The matched
passages of an evaluation text, as intervals of it, are merged into its
coverage: by one training text, which settles the pairs, and by all of them,
which is reported for each evaluation record. Texts with the same words are one
text throughout and come apart again only in the result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import CHUNK_BYTES, _powers, chunks, materialise, mix64, new_path, scratch, shingles, word_hashes
from corvane.llm.near_dup import fingerprint_batch

_ASCII = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(128)) + bytes(range(128, 256))
#: Separators outside ASCII, in UTF-8: U+00A0-00BF, U+2000-206F, U+3000-303F, U+FF00-FFEF
_OTHER = re.compile(rb"\xc2[\x80-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]|\xef[\xbc-\xbf][\x80-\xbf]")
_CJK = re.compile(rb"([\xe4-\xe9][\x80-\xbf][\x80-\xbf])")


def normalise(text: str) -> bytes:
    """Lower-case words, one blank between them and at both ends; each CJK
    character is a word."""
    b = text.lower().encode().translate(_ASCII)
    if not b.isascii():
        b = _CJK.sub(rb" \1 ", _OTHER.sub(b" ", b))
    return b" " + b" ".join(b.split()) + b" "


def passages(norm: bytes, words: int = 4, least_bytes: int = 18) -> list[tuple[int, int, bytes]]:
    """(start, end, passage) of consecutive passages of at least ``words`` words
    and ``least_bytes`` bytes; a rest joins the last. Together they are the text."""
    out, at, n, start = [], 1, 0, 0
    while at < len(norm):
        at = norm.find(b" ", at)
        if at < 0:
            break
        n += 1
        if n >= words and at - start >= least_bytes:
            out.append((start, at + 1, norm[start : at + 1]))
            start, n = at, 0
        at += 1
    if n:
        if out:
            s = out.pop()[0]
            out.append((s, len(norm), norm[s:]))
        else:
            out.append((0, len(norm), norm))
    return out


def _content(df: DataFrame) -> DataFrame:
    """(id, content, n, train, text): with the hash of the words of each text and
    the number of its shingles."""

    def run(batches):
        for b in batches:
            content, count, _ = fingerprint_batch(b.column(1), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content), pa.array(count), b.column(2), b.column(1)], ["id", "content", "n", "train", "text"])

    return df.select("id", "text", "train").mapInArrow(run, "id bigint, content bigint, n int, train boolean, text string")


# ---------------------------------------------------------------- passages as keys

DF_BITS = 20  # slots of the passage counts that order the passages of a text
ODD_BITS = 26  # bits of the filter of odd passages
PARITY = np.uint64(127)  # a parity map has 128 bits


def _mixed(x: np.ndarray) -> np.ndarray:
    return mix64(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Spans:
    """Normalised texts end to end, their blanks, and hashes of what stands
    between any two of them."""

    def __init__(self, norms: list[bytes]):
        self.buf = np.frombuffer(b"".join(norms), np.uint8)
        self.base = np.cumsum([0, *map(len, norms)])
        self.at = np.flatnonzero(self.buf == 32)
        self.doc = np.searchsorted(self.base, self.at, "right") - 1
        self.last = (np.searchsorted(self.at, self.base[1:]) - 1)[self.doc]  # the last blank of the text
        p, self.inverse = _powers(len(self.buf) + 1)
        self.cum = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * p[: len(self.buf)], out=self.cum[1:])

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words between blanks ``a`` and ``b``."""
        s, e = self.at[a], self.at[b] + 1
        return mix64((self.cum[e] - self.cum[s]) * self.inverse[s] + (e - s).astype(np.uint64))

    def ends(self, a: np.ndarray, words: int = 4, least_bytes: int = 18) -> np.ndarray:
        """The blank at which :func:`passages` ends what begins at ``a``."""
        return np.maximum(a + words, np.searchsorted(self.at, self.at[a] + least_bytes))


def _pieces(norms: list[bytes], limit: int = CHUNK_BYTES):
    """(number of the first, texts) in pieces that a core's cache holds."""
    lo, size = 0, 0
    for k, n in enumerate(norms):
        if size and size + len(n) > limit:
            yield lo, norms[lo:k]
            lo, size = k, 0
        size += len(n)
    if lo < len(norms):
        yield lo, norms[lo:]


def _eval_passages(norms: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, key, size, words) of all passages in order; words is 0 but for odd
    passages: those that end after, or before, the place at which a passage that
    begins there is cut, as the last of a text may."""
    out = []
    for lo, part in _pieces(norms):
        spans = _Spans(part)
        cut = [passages(n) for n in part]
        doc = np.repeat(np.arange(len(part)), [len(c) for c in cut])
        s = np.array([x[0] for c in cut for x in c], np.int64) + spans.base[doc]
        e = np.array([x[1] for c in cut for x in c], np.int64) + spans.base[doc]
        a, b = np.searchsorted(spans.at, s), np.searchsorted(spans.at, e - 1)
        out.append((lo + doc, spans.keys(a, b), e - s, np.where(spans.ends(a) == b, 0, b - a)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _odd_slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(keys)
    return h >> np.uint64(64 - ODD_BITS), h & np.uint64((1 << ODD_BITS) - 1)


def _train_passages(norms: list[bytes], odd: np.ndarray, odd_words: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text), each once: what a passage would be that began at any word of
    the texts, and of the stretches with as many words as an odd passage those
    that pass the filter of these. A passage stands in a text if and only if it is
    one of them."""
    keys, docs = [], []
    for lo, part in _pieces(norms):
        spans = _Spans(part)
        a = np.arange(len(spans.at))
        b = spans.ends(a)
        whole = b <= spans.last
        keys.append(spans.keys(a[whole], b[whole]))
        docs.append(lo + spans.doc[whole])
        for words in odd_words:
            x = a[a + words <= spans.last]
            k = spans.keys(x, x + words)
            one, two = _odd_slots(k)
            may = (odd[one >> np.uint64(3)] >> (one & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            may[may] = (odd[two[may] >> np.uint64(3)] >> (two[may] & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            keys.append(k[may])
            docs.append(lo + spans.doc[x[may]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[new], doc[new]


def _parity(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles, two maps of 128 bits) of texts. A bit is the parity of
    the shingles that fall on it, so the shingles that only one of two texts has
    are at least as many as the bits in which their maps differ."""
    sets = _shingle_arrays(texts)
    n = np.array([len(x) for x in sets], np.int64)
    maps = np.zeros((len(sets), 4), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        h = _mixed(np.concatenate([sets[k] for k in some]))
        first = np.cumsum(n[some]) - n[some]
        for m, bit in enumerate((h & PARITY, h >> np.uint64(7) & PARITY)):
            one = np.uint64(1) << (bit & np.uint64(63))
            for half in (0, 1):
                maps[some, 2 * m + half] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == half, one, np.uint64(0)), first)
    return n, maps


def _shingle_arrays(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingles of each text, as :func:`jaccard` compares them."""
    out: list[np.ndarray] = []
    for _, part in chunks(texts):
        w, d, num = word_hashes(part)
        sd, sh = shingles(w, d, num, len(part)) if len(w) else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        out += np.split(sh, np.cumsum(np.bincount(sd, minlength=len(part)))[:-1])
    return out


def _cut(reps: DataFrame) -> DataFrame:
    """(content, text, keys, sizes, words) of evaluation texts, all passages in
    order; see :func:`_eval_passages`."""

    def run(batches):
        for b in batches:
            doc, key, size, words = _eval_passages([normalise(t) for t in b.column(1).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key.view(np.int64), size.astype(np.int32), words.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["content", "text", "keys", "sizes", "words"])

    return reps.select("content", "text").mapInArrow(run, "content bigint, text string, keys array<bigint>, sizes array<int>, words array<int>")


def _counts(cut: DataFrame) -> np.ndarray:
    """How often passages stand in evaluation texts, by slots of their hash. The
    counts order the passages of a text and never decide a result, so it does not
    matter that passages share slots."""

    def run(batches):
        total = np.zeros(1 << DF_BITS, np.int64)
        for b in batches:
            key = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            total += np.bincount((key >> np.uint64(64 - DF_BITS)).astype(np.int64), minlength=len(total))
        slot = np.flatnonzero(total)
        for lo in range(0, len(slot), 1 << 16):
            part = slot[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["slot", "n"])

    out = np.zeros(1 << DF_BITS, np.int64)
    got = cut.select("keys").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def _odd(cut: DataFrame) -> tuple[np.ndarray, list[int]]:
    """(filter, numbers of words) of the odd passages. The filter has a fixed
    size; what passes it without being one meets no passage."""

    def run(batches):
        for b in batches:
            key = b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.flatnonzero(b.column(1).flatten().to_numpy(zero_copy_only=False))
            slot = np.unique(np.concatenate(_odd_slots(key[at]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot)], ["slot"])

    bits = np.zeros((1 << ODD_BITS >> 15, 1 << 12), np.uint8)
    got = cut.select("keys", "words").mapInArrow(run, "slot bigint").groupBy(F.shiftright("slot", 15).alias("k")).agg(F.expr("bitmap_construct_agg(slot & 32767)").alias("b")).toArrow()
    for k, b in zip(got.column("k").to_pylist(), got.column("b").to_pylist()):
        bits[k] = np.frombuffer(b, np.uint8)
    words = cut.select(F.explode("words").alias("w")).where("w > 0").distinct().collect()  # at most 18: shorter than two passages
    return bits.ravel(), sorted(r.w for r in words)


def _parts(key: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(key) >> np.uint64(32)) % np.uint64(parts)


_BLOBS = ["keys", "rows", "content", "n", "maps"]


_LEFT_OUT = np.uint32(1 << 31)  # marks keys that make no pairs


def _blobs(parts: int, offset: int, key: np.ndarray, row: np.ndarray, out_of: np.ndarray, every: bool, content: np.ndarray, n: np.ndarray, maps: np.ndarray) -> pa.RecordBatch:
    """A row for each part of the keys: its keys in order, with numbers of rows of
    the texts that hold them, and these texts. Keys that are ``out_of`` the pairs
    are marked with ``every`` and else left out."""
    part = _parts(key, parts)
    order = np.lexsort((key, part))
    key, row, out_of, part = key[order], row[order], out_of[order], part[order]
    out: list[tuple] = []
    if not every:
        key, row, out_of, part = (x[~out_of] for x in (key, row, out_of, part))
    bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for k in range(parts):
        at = slice(bounds[k], bounds[k + 1])
        if at.start < at.stop:
            own, row_of = np.unique(row[at], return_inverse=True)
            out.append((offset + k, key[at].tobytes(), (row_of.astype(np.uint32) | out_of[at] * _LEFT_OUT).tobytes(), content[own].tobytes(), n[own].tobytes(), maps[own].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in range(1, 6))], ["part", *_BLOBS])


_BLOB_SCHEMA = "part int, " + ", ".join(f"{c} binary" for c in _BLOBS)


def _opened(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """(key, row, content, n, maps) of blobs of one part, keys in order."""
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
    keys, at, content, n, maps = ([np.frombuffer(r[k], kind) for r in rows] for k, kind in enumerate((np.uint64, np.uint32, np.int64, np.int64, np.uint64)))
    before = np.cumsum([0, *map(len, n)])
    key, row = np.concatenate(keys), np.concatenate([a + np.uint32(b) for a, b in zip(at, before)])
    order = np.argsort(key, kind="stable")
    return key[order], row[order], np.concatenate(content), np.concatenate(n), np.concatenate(maps).reshape(-1, 4)


def _eval_blobs(cut: DataFrame, parts: int, least_coverage: float, counts: np.ndarray, every: bool) -> DataFrame:
    """Blobs of evaluation texts by part. The most frequent passages of a text
    that together are shorter than the coverage that a pair needs are left out:
    a pair has at least one of the others. With ``every`` they are there, but marked."""

    def run(batches):
        for b in batches:
            lists = [b.column(k) for k in (2, 3)]
            key = lists[0].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            size = lists[1].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False))
            order = np.lexsort((-counts[key >> np.uint64(64 - DF_BITS)], doc))
            total = np.cumsum(size[order])
            start = np.searchsorted(doc, np.arange(b.num_rows))
            sofar = total - np.concatenate([[0], total])[start[doc]]
            out_of = np.zeros(len(key), bool)
            out_of[order] = sofar < least_coverage * np.bincount(doc, size, b.num_rows)[doc]
            n, maps = _parity(b.column(1))
            yield _blobs(parts, 0, key, doc, out_of, every, b.column(0).to_numpy(zero_copy_only=False), n, maps)

    return cut.select("content", "text", "keys", "sizes").mapInArrow(run, _BLOB_SCHEMA)


FLUSH = 1024  # training texts whose passages are dealt out at a time


def _train_blobs(train: DataFrame, parts: int, blocks: int, odd: np.ndarray, odd_words: list[int]) -> DataFrame:
    """Blobs of training texts by block of texts and part of keys."""

    def run(batches):
        from pyspark import TaskContext

        block = int(_mixed(np.array([TaskContext.get().partitionId()]))[0] % np.uint64(blocks))
        for b in batches:
            for lo in range(0, b.num_rows, FLUSH):
                x = b.slice(lo, FLUSH)
                key, doc = _train_passages([normalise(t) for t in x.column(1).to_pylist()], odd, odd_words)
                n, maps = _parity(x.column(1))
                yield _blobs(parts, block * parts, key, doc, np.zeros(len(key), bool), False, x.column(0).to_numpy(zero_copy_only=False), n, maps)
                block = (block + 1) % blocks

    return train.select("content", "text").mapInArrow(run, _BLOB_SCHEMA)


def _read_part(path: str, part: int) -> list[tuple]:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    if path.startswith("file:") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    system, base = fs.FileSystem.from_uri(path)
    try:
        infos = system.get_file_info(fs.FileSelector(f"{base}/part={part}"))
    except FileNotFoundError:
        return []
    tables = [pq.ParquetFile(system.open_input_file(i.path)).read(_BLOBS) for i in infos if i.path.endswith(".parquet")]
    return [r for t in tables for r in zip(*(t.column(c).to_pylist() for c in _BLOBS))]


PAIRS = 1 << 16  # compared at a time, so that they stay in a core's cache


class _Meeting:
    """Evaluation texts of a part of the keys against training texts that share one."""

    def __init__(self, rows: list[tuple], similarity: float):
        key, row, self.content, self.n, self.maps = _opened(rows)
        self.every = np.unique(key)
        paired = row < _LEFT_OUT
        self.key, self.row = key[paired], row[paired]
        self.similarity, self.differ = similarity, (1 - similarity) / (1 + similarity)
        self.first = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])) if len(self.key) else np.zeros(0, np.int64)
        self.own = self.key[self.first]
        self.size = np.diff(np.append(self.first, len(self.key)))

    def _most(self, n: np.ndarray) -> np.ndarray:
        """Differing bits allowed by a text of ``n`` shingles; beyond 127 all are."""
        return np.minimum(np.floor(self.differ * n + 1e-6), 127).astype(np.uint8)

    def pairs(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(training content, evaluation content) of pairs that share a key and
        whose numbers of shingles and parity maps allow the similarity, each once;
        and the keys that they share with any training text."""
        key, row, content, n, maps = _opened(rows)
        if not len(key) or not len(self.every):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        lo, hi = np.searchsorted(key, self.own), np.searchsorted(key, self.own, "right")
        met = np.flatnonzero(hi > lo)
        products = self.size[met] * (hi - lo)[met]
        found: list[np.ndarray] = []
        held = 0

        def take(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal found, held
            m, k = maps[x], self.maps[y]
            small, large = np.minimum(n[x], self.n[y]), np.maximum(n[x], self.n[y])
            most = self.differ * (n[x] + self.n[y]) + 1e-6
            apart = np.bitwise_count(m ^ k).astype(np.int64)
            ok = (small >= self.similarity * large - 1e-6) & (apart[:, 0] + apart[:, 1] <= most) & (apart[:, 2] + apart[:, 3] <= most)
            found.append(x[ok].astype(np.int64) << 32 | y[ok])
            held += len(found[-1])
            if held > 1 << 22:
                found = [np.unique(np.concatenate(found))]
                held = 0

        # few pairs of a key: many keys at a time
        few = met[products <= PAIRS // 16]
        total = np.cumsum(self.size[few] * (hi - lo)[few])
        for a, b in _runs(total, PAIRS):
            k = few[a:b]
            width = (hi - lo)[k]
            each = self.size[k] * width
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            w = np.repeat(width, each)
            take(row[np.repeat(lo[k], each) + at % w], self.row[np.repeat(self.first[k], each) + at // w])
        # many pairs of a key: blocks of them
        mine, most_y = self.maps[:, :2], self._most(self.n)
        most_x = self._most(n) + np.uint8(1)
        space = np.empty(PAIRS, np.uint64), np.empty(PAIRS, np.uint8), np.empty(PAIRS, np.uint8)
        for k in met[products > PAIRS // 16].tolist():
            xs, ys = row[lo[k] : hi[k]], self.row[self.first[k] : self.first[k] + self.size[k]]
            for p in range(0, len(xs), 1024):
                x = xs[p : p + 1024]
                x0, x1, mx = maps[x, 0], maps[x, 1], most_x[x]
                for q in range(0, len(ys), PAIRS // 1024):
                    y = ys[q : q + PAIRS // 1024]
                    e = mine[y]
                    shape = len(y), len(x)
                    wide, apart, second = (b[: len(y) * len(x)].reshape(shape) for b in space)
                    np.bitwise_count(np.bitwise_xor(e[:, :1], x0, out=wide), out=apart)
                    np.bitwise_count(np.bitwise_xor(e[:, 1:], x1, out=wide), out=second)
                    np.add(apart, second, out=apart)
                    at = np.flatnonzero(apart <= np.add(most_y[y][:, None], mx, out=second))
                    if len(at):
                        take(x[at % len(x)], y[at // len(x)])
        pair = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return content[pair >> 32], self.content[pair & 0xFFFFFFFF], self.every[np.isin(self.every, key)]


def _runs(total: np.ndarray, limit: int):
    """(start, end) of neighbours that come to about ``limit``, given their running sum."""
    a = 0
    while a < len(total):
        b = int(max(a + 1, np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _met(train: DataFrame, path: str, parts: int, blocks: int, similarity: float, coverage: bool) -> DataFrame:
    """(ct, ce, key): pairs that may be near and, with ``coverage`` and without
    contents, the keys that a block of training texts has. A task holds one part
    of the keys for one block of training texts."""

    def run(batches):
        part, rows, meeting = None, [], (None, None)

        def done():
            nonlocal meeting
            if meeting[0] != part % parts:
                meeting = part % parts, _Meeting(_read_part(path, part % parts), similarity)
            ct, ce, keys = meeting[1].pairs(rows)
            other = ct != ce
            ct, ce, keys = ct[other], ce[other], keys if coverage else keys[:0]
            for lo in range(0, len(ct), 1 << 16):
                x, y = ct[lo : lo + (1 << 16)], ce[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.nulls(len(x), pa.int64())], ["ct", "ce", "key"])
            for lo in range(0, len(keys), 1 << 16):
                x = keys[lo : lo + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.array(x)], ["ct", "ce", "key"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != part and rows:
                    yield from done()
                    rows = []
                part = r[0]
                rows.append(r[1:])
        if rows:
            yield from done()

    return train.repartitionById(parts * blocks, F.col("part")).sortWithinPartitions("part").mapInArrow(run, "ct bigint, ce bigint, key bigint")


def _settled(pairs: DataFrame, similarity: float, least_coverage: float) -> DataFrame:
    """(ct, ce) of the pairs (ct, ce, train, held) that are near: by the exact
    similarity of the texts, and by the passages of one, in an automaton, that
    stand in the other."""

    def run(batches):
        import ahocorasick

        for b in batches:
            left, right = (_shingle_arrays(b.column(k)) for k in (2, 3))
            ok = []
            for k, (x, y) in enumerate(zip(left, right)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common / max(1, len(x) + len(y) - common) >= similarity:
                    ok.append(k)
            automaton = ahocorasick.Automaton()
            number: dict[bytes, int] = {}
            cut = {}
            for k in ok:
                cut[k] = [number.setdefault(p, len(number)) for _, _, p in passages(normalise(b.column(3)[k].as_py()))]
            for p, k in number.items():
                automaton.add_word(p.decode("latin-1"), k)
            size = [len(p) for p in number]
            near = []
            if number:
                automaton.make_automaton()
            for k in ok:
                hit = {p for _, p in automaton.iter(normalise(b.column(2)[k].as_py()).decode("latin-1"))}
                if sum(size[p] for p in cut[k] if p in hit) >= least_coverage * sum(size[p] for p in cut[k]):
                    near.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(near, pa.int64())), b.column(1).take(pa.array(near, pa.int64()))], ["ct", "ce"])

    return pairs.select("ct", "ce", "train", "held").mapInArrow(run, "ct bigint, ce bigint")


def merged(found: list[bool], bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The found ones of consecutive intervals, those that touch as one."""
    out: list[tuple[int, int]] = []
    for ok, (start, end) in zip(found, bounds):
        if ok and out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        elif ok:
            out.append((start, end))
    return out


def _coverage(cut: DataFrame, found: DataFrame) -> DataFrame:
    """(ce, coverage, n_intervals, longest) of each evaluation text: the share of
    its normalised text in the merged intervals of passages that any training
    text holds, how many intervals these are, and the length of the longest.
    ``found`` has the keys of such passages, each once."""

    def run(batches):
        for b in batches:
            rows = []
            for content, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans.sort(key=lambda x: x["at"])
                ok, bounds, at = [], [], 0
                for x in spans:
                    ok.append(x["hit"])
                    bounds.append((at, at + x["size"]))
                    at += x["size"] - 1  # neighbours share the blank between them
                own = merged(ok, bounds)
                rows.append((content, sum(e - s for s, e in own) / max(1, bounds[-1][1]), len(own), max((e - s for s, e in own), default=0)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.float64(), pa.int32(), pa.int32()))], ["ce", "coverage", "n_intervals", "longest"])

    each = cut.select("content", F.posexplode(F.arrays_zip("keys", "sizes")).alias("at", "x")).select("content", "at", F.col("x.keys").alias("key"), F.col("x.sizes").alias("size"))
    hit = each.join(found.withColumn("hit", F.lit(True)), "key", "left").select("content", F.struct("at", "size", F.coalesce("hit", F.lit(False)).alias("hit")).alias("x"))
    return hit.groupBy("content").agg(F.collect_list("x").alias("spans")).mapInArrow(run, "ce bigint, coverage double, n_intervals int, longest int")


#: Passages of training texts that a task holds, and shards of evaluation passages
BLOCK_PASSAGES, SHARDS_HELD = 2_000_000, 8


def _search(df: DataFrame, id_col: str, text: str, split: str, train: str, similarity: float, least_coverage: float, shard_passages: int, max_broadcast_ids: int, coverage: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(marks (id, content, train), near (ct, ce), coverage of evaluation contents
    or None), as tables."""
    if not least_coverage > 0:
        raise ValueError("least_coverage must be more than 0: texts meet at the passages that they share")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(split) == train, F.lit(False)).alias("train")).where("id is not null and text is not null")
    hashed = materialise(_content(rows).where("n > 0").withColumn("rid", F.monotonically_increasing_id()), "hashed")
    marks = materialise(hashed.select("id", "content", "train").distinct(), "marks")
    reps = materialise(hashed.groupBy("content", "train").agg(F.min(F.struct("id", "rid", "n")).alias("r")).select("train", F.col("r.rid").alias("rid"), F.col("r.n").alias("n")), "reps")
    copies = materialise(hashed.select("rid").join(reps, "rid", "left_anti"), "copies")
    few = copies.count() <= max_broadcast_ids
    texts = hashed.join(F.broadcast(copies) if few else copies, "rid", "left_anti").select("content", "text", "train")
    cut = materialise(_cut(texts.where("not train")), "cut")
    n = cut.agg(F.sum(F.size("keys"))).first()[0]
    shingled = reps.where("train").agg(F.sum("n")).first()[0]  # a text has about as many places at which a passage may begin
    spark = df.sparkSession
    if not n:
        return marks, spark.createDataFrame([], "ct bigint, ce bigint"), spark.createDataFrame([], "ce bigint, coverage double, n_intervals int, longest int")
    parts = -(-n // (SHARDS_HELD * shard_passages))
    blocks = max(-(-(shingled or 0) // (parts * BLOCK_PASSAGES)), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // parts))
    path = new_path(spark, "parts")
    _eval_blobs(cut, parts, least_coverage, _counts(cut), coverage).repartition(parts, "part").write.partitionBy("part").parquet(path)
    met = materialise(_met(_train_blobs(texts.where("train"), parts, blocks, *_odd(cut)), path, parts, blocks, similarity, coverage), "met")
    may = materialise(met.where("ct is not null").select("ct", "ce").distinct(), "may")
    sides = may.select(F.col("ct").alias("content"), F.lit(True).alias("train")).unionByName(may.select(F.col("ce").alias("content"), F.lit(False).alias("train"))).distinct()
    wanted = materialise(texts.join(F.broadcast(sides) if may.count() * 2 <= max_broadcast_ids else sides, ["content", "train"], "left_semi"), "wanted")
    left, right = wanted.where("train").select(F.col("content").alias("ct"), F.col("text").alias("train")), wanted.where("not train").select(F.col("content").alias("ce"), F.col("text").alias("held"))
    near = materialise(_settled(may.join(left, "ct").join(right, "ce"), similarity, least_coverage), "near")
    return marks, near, materialise(_coverage(cut, met.where("ct is null").select("key").distinct()), "coverage") if coverage else None


def _sides(marks: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training records (ct, train_id), evaluation records (ce, eval_id), links
    (ct, ce) between contents, equal ones included)."""
    train = marks.where("train").select(F.col("content").alias("ct"), F.col("id").alias("train_id"))
    held = marks.where("not train").select(F.col("content").alias("ce"), F.col("id").alias("eval_id"))
    same = train.select("ct").distinct().join(held.select(F.col("ce").alias("ct")).distinct(), "ct", "left_semi").select("ct", F.col("ct").alias("ce"))
    return train, held, same.unionByName(near)


def cross_split_pairs(
    df: DataFrame, id_col: str = "id", text: str = "problem", split: str = "split_name", train: str = "train", similarity: float = 0.55, least_coverage: float = 0.2, shard_passages: int = 250_000, max_broadcast_ids: int = 100_000
) -> DataFrame:
    """(train_id, eval_id): pairs of a training and an evaluation record whose
    texts are the same, exactly or up to small edits.

    Every row whose split is not ``train`` (null included) is an evaluation
    record. All passages of each evaluation text are searched; a pair needs
    ``least_coverage`` of their length in the training text, and then the
    ``similarity`` of the whole texts. Null, empty and
    wordless texts have no partner; a null id is dropped; repeated ids count
    once; other columns are ignored; an empty table gives none.
    """
    with scratch(df.sparkSession) as tables:
        marks, near, _ = _search(df, id_col, text, split, train, similarity, least_coverage, shard_passages, max_broadcast_ids, False)
        left, right, links = _sides(marks, near)
        pairs = links.join(left, "ct").join(right, "ce").select("train_id", "eval_id").where("train_id <> eval_id")
        return tables.keep(materialise(pairs, "pairs"))


def overlap_by_record(
    df: DataFrame, id_col: str = "id", text: str = "problem", split: str = "split_name", source: str = "source", train: str = "train", similarity: float = 0.55, least_coverage: float = 0.2, shard_passages: int = 250_000, max_broadcast_ids: int = 100_000
) -> DataFrame:
    """(id, split_name, source, n_partners, coverage, n_intervals, longest): one row
    for each evaluation record with words.

    ``n_partners`` training records are the same or almost the same, counted by
    distinct texts, so that copies on both sides are never expanded to pairs;
    ``coverage`` is the share of the record in merged intervals of passages that
    stand anywhere in the training texts. Ids are taken to be unique; else as
    :func:`cross_split_pairs`.
    """
    with scratch(df.sparkSession) as tables:
        marks, near, cover = _search(df, id_col, text, split, train, similarity, least_coverage, shard_passages, max_broadcast_ids, True)
        left, right, links = _sides(marks, near)
        partners = links.join(left.groupBy("ct").agg(F.count("*").alias("c")), "ct").groupBy("ce").agg(F.sum("c").alias("n_partners"))
        per = partners.join(cover, "ce", "full").join(right, "ce")
        named = df.select(F.col(id_col).cast("bigint").alias("eval_id"), F.col(split).alias("split_name"), F.col(source).alias("source")).where(~F.coalesce(F.col("split_name") == train, F.lit(False)))
        out = per.join(named, "eval_id").select(F.col("eval_id").alias("id"), "split_name", "source", F.coalesce("n_partners", F.lit(0)).alias("n_partners"), F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"), F.coalesce("n_intervals", F.lit(0)).alias("n_intervals"), F.coalesce("longest", F.lit(0)).alias("longest"))
        return tables.keep(materialise(out, "overlap"))


def overlap_report(records: DataFrame) -> DataFrame:
    """(split_name, source, n_records, n_overlapping, n_pairs, mean_coverage,
    n_covered): evaluation records per split and source, those with a partner in
    training, their pairs, the mean share of a record that stands somewhere in
    training, and the records of which at least 80 % do."""
    return records.groupBy("split_name", "source").agg(
        F.count("*").alias("n_records"),
        F.sum(F.when(F.col("n_partners") > 0, 1).otherwise(0)).alias("n_overlapping"),
        F.sum("n_partners").alias("n_pairs"),
        F.round(F.avg("coverage"), 4).alias("mean_coverage"),
        F.sum(F.when(F.col("coverage") >= 0.8, 1).otherwise(0)).alias("n_covered"),
    )

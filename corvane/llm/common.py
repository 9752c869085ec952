"""Helpers shared by the training-data operators: tables cut from lineage,
label and source spellings, and vectorised word hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.store import application_dir, drop_table, materialise, new_path, path_exists, scratch  # noqa: F401

# ---------------------------------------------------------------- labels

#: Spellings under which the seven languages are labelled.
LANGUAGE_NAMES = {
    "en": "en eng english anglais inglés ingles englisch английский 英语",
    "es": "es spa esp spanish español espanol castellano espagnol spanisch испанский 西班牙语",
    "fr": "fr fra fre french français francais francés frances französisch французский 法语",
    "de": "de deu ger german deutsch alemán aleman allemand немецкий 德语",
    "pt": "pt por portuguese português portugues portugués portugais portugiesisch португальский 葡萄牙语",
    "ru": "ru rus russian русский ruso russe russisch 俄语",
    "zh": "zh zho chi cmn chinese mandarin chino chinois chinesisch китайский 中文 汉语 漢語 普通话",
}
#: Labels that stand for no language.
NO_LANGUAGE = "n/a na none null nan und unknown unk undefined undetermined mul mis zxx xx other ? - --"
LANGUAGES = list(LANGUAGE_NAMES)
_SPELLING = {w: k for k, v in LANGUAGE_NAMES.items() for w in v.split()}


def language_code(label: Column) -> Column:
    """Two-letter code of a received label; null where it is missing or stands
    for no language; labels of other languages stay, in lower case. A region or
    script after ``-`` or ``_`` is dropped."""
    low = F.regexp_replace(F.lower(label), r"^[\s ]+|[\s ]+$", "")
    head = F.regexp_extract(low, r"^([^-_ .(]+)", 1)
    table = F.create_map(*[F.lit(x) for kv in _SPELLING.items() for x in kv])
    none = low.isin([*NO_LANGUAGE.split(), ""]) | (F.length(head) == 0)
    return F.when(label.isNull() | none, None).otherwise(F.coalesce(F.try_element_at(table, low), F.try_element_at(table, head), head))


def source_key(source: Column) -> Column:
    """Key under which spellings of one source agree: without a leading path,
    surrounding blanks, letter case, and with one kind of separator."""
    base = F.regexp_replace(F.lower(source), r"^[\s ]+|[\s /]+$", "")
    return F.regexp_replace(F.regexp_replace(base, r"^.*[/\\]", ""), r"[\s._\- ]+", "_")


def with_catalogue(df: DataFrame, catalogue: DataFrame, source: str = "source") -> DataFrame:
    """Add ``cat_source`` (canonical name, null outside the catalogue) and
    ``domain_name``. The catalogue is a fixed small table and is broadcast."""
    cat = catalogue.select(source_key(F.col("source")).alias("_k"), F.col("source").alias("cat_source"), "domain_name").dropDuplicates(["_k"])
    return df.withColumn("_k", source_key(F.col(source))).join(F.broadcast(cat), "_k", "left").drop("_k")


# ---------------------------------------------------------------- word hashes

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("p", ())) < n:
        for k, b in (("p", _P), ("i", _PINV)):
            a = np.full(n + 1024, b, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)  # 0 blank, 1 letter, 2 digit
    for b in range(256):
        if chr(b).isascii() and chr(b).isalpha() or b >= 0x80:
            c[b] = 1
        elif chr(b).isascii() and chr(b).isdigit():
            c[b] = 2
    return c


_CLASS = _byte_classes()
CHUNK_BYTES = 1 << 17  # what is worked on fits a core's cache


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, document of each word, whether it is a number) of an
    array of strings. Words are runs of letters or of digits in lower case; a
    CJK character is a word of its own; everything else separates. Null is
    empty."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1]
    if low.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    buf = np.frombuffer(low.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    m = len(buf)
    kind = _CLASS[buf]
    # Punctuation outside ASCII: U+00A0-00BF, U+2000-206F, U+3000-303F, U+FF00-FFEF
    high = buf >= 0x80
    if high.any():
        nxt = np.append(buf[1:], 0)
        two = buf == 0xC2
        three = ((buf == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))) | ((buf == 0xE3) & (nxt == 0x80)) | ((buf == 0xEF) & (nxt >= 0xBC))
        for lead, width in ((two, 2), (three, 3)):
            at = np.flatnonzero(lead)
            for k in range(width):
                kind[np.minimum(at + k, m - 1)] = 0
        cjk = (buf >= 0xE4) & (buf <= 0xE9)
    else:
        cjk = high
    prev = np.empty(m, np.uint8)
    prev[0], prev[1:] = 0, kind[:-1]
    start = (kind != 0) & (kind != prev)
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = kind[first] != 0
    at = np.flatnonzero(cjk)
    if len(at):
        start[at] = True
        after = at + 3
        after = after[after < m]
        start[after] |= kind[after] != 0
    s = np.flatnonzero(start)
    if not len(s):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    # the end of a word: the next start, or the next blank, or the document's end
    blank_or_start = np.flatnonzero(start | (kind == 0))
    pos = np.searchsorted(blank_or_start, s, "right")
    e = np.where(pos < len(blank_or_start), blank_or_start[np.minimum(pos, len(blank_or_start) - 1)], m)
    doc = np.searchsorted(offsets, s, "right") - 1
    e = np.minimum(e, offsets[doc + 1])
    p, inv = _powers(m + 1)
    cum = np.zeros(m + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:m], out=cum[1:])
    return mix64((cum[e] - cum[s]) * inv[s] + (e - s).astype(np.uint64)), doc, kind[s] == 2


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """(start, slice) pieces of at most about ``limit`` bytes, whole texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(texts):
        hi = int(max(lo + 1, np.searchsorted(size, done + limit, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo, done = hi, size[hi - 1]


def shingles(words: np.ndarray, docs: np.ndarray, numbers: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct (document, 32-bit shingle): neighbouring words in pairs,
    and each number alone (numbers are never stock wording); a document of one
    word has that word."""
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    same = docs[:-1] == docs[1:]
    both_words = same & ~(numbers[:-1] | numbers[1:])
    pair = mix64(words[:-1] * np.uint64(3) + words[1:])[both_words]
    d = np.concatenate([docs[:-1][both_words], docs[numbers]])
    h = np.concatenate([pair, words[numbers]])
    lone = np.setdiff1d(np.unique(docs), d)
    if len(lone):
        take = np.isin(docs, lone)
        d, h = np.concatenate([d, docs[take]]), np.concatenate([h, words[take]])
    key = np.unique((d.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)

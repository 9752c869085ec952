"""Problem 2: the language of each field and of each passage, with confidence.

A bidirectional gated recurrent network over bytes (:mod:`byte_gru`) is trained
on a bounded sample of labelled rows and labels every byte position; positions
are pooled to sentences, neighbouring sentences of one language to passages,
and passages to the field. Formulas, markup, numbers and names within
sentences carry no language and are left out; a sentence met before is not
labelled again.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.byte_gru import ByteGRU
from corvane.llm.common import LANGUAGES, application_dir, language_code, path_exists

#: Formulas of any length (an opening without its end stops at the next one), tags, commands, links, step markers.
_FORMULA = re.compile(
    r"\$\$[^$]*\$\$|\$[^$]*\$|\\\[(?:[^\\]|\\(?!\[))*?\\\]|\\\((?:[^\\]|\\(?!\())*?\\\)"
    r"|</?[A-Za-z][^<>]*>|\\[A-Za-z]+(?:\{[^{}]*\})*|https?://\S+|(?i:\bstep\s+\d+\s*[:.)])"
)
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?](?![\s\"'»”)㐀-鿿]|$)[^.!?。！？\n]*)*[.!?。！？\n]?")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_CJK = re.compile(r"[㐀-鿿]")
MIN_WORDS, MIN_CJK = 3, 4
KEEP_SMALL = 4  # words in small letters from which a sentence is labelled by those alone


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, what is labelled, letters) of the sentences of ``text`` that
    hold enough words to have a language. What is labelled is in lower case,
    without formulas, numbers and, where the sentence has other words in small
    letters, capitalised words (names); the first word is kept where those are
    few."""
    out = []
    plain = _FORMULA.sub(_blank, text) if ("$" in text or "\\" in text or "<" in text or "tep" in text or "http" in text) else text
    for m in _SENTENCE.finditer(plain):
        s = m.group()
        if len(s) < MIN_CJK:
            continue
        words = _NOT_LETTER.sub(" ", s).split()
        if not words:
            continue
        if len(words) > 2:
            small = [w for w in words if not w[0].isupper()]
            if len(small) >= KEEP_SMALL:
                words = small
            elif small:
                words = words[:1] + [w for w in words[1:] if not w[0].isupper()]
        key = " ".join(words).lower()
        cjk = len(_CJK.findall(key)) if not key.isascii() else 0
        if cjk >= MIN_CJK or len(words) - (cjk > 0) >= MIN_WORDS:
            out.append((m.start(), m.end(), key, len(key) + 2 * cjk))
    return out


def training_sample(df: DataFrame, text_cols: list[str], label: str, per_language: int, key: str) -> list[tuple[str, int]]:
    """At most ``per_language`` labelled rows of each language, chosen by a hash
    of the key: the same rows at every run. Labels are as received, partly
    wrong. The rows' ids are ranked first, without their texts."""
    code = language_code(F.col(label))
    rank = F.row_number().over(Window.partitionBy("_code").orderBy(F.xxhash64(key), key))
    chosen = df.select(F.col(key), code.alias("_code")).where(F.col("_code").isin(LANGUAGES)).withColumn("_r", rank).where(F.col("_r") <= per_language).select(key, "_code")
    rows = df.select(key, *text_cols).join(F.broadcast(chosen), key).orderBy(F.xxhash64(key), key).limit(per_language * len(LANGUAGES)).collect()
    return [(r[c], LANGUAGES.index(r["_code"])) for r in rows for c in text_cols if r[c]]


def _votes(texts: list[tuple[list[str], int]], use: list[int]) -> dict[str, list[int]]:
    """How many of some texts hold each sentence, by the texts' labels."""
    votes: dict[str, list[int]] = {}
    for k in use:
        for key in texts[k][0]:
            votes.setdefault(key, [0] * len(LANGUAGES))[texts[k][1]] += 1
    return votes


def train(rows: list[tuple[str, int]], hidden: int = 24, steps: int = 900, seed: int = 7, rounds: int = 3, repair: int = 300, stress: float = 8.0) -> ByteGRU:
    """A network fitted to labelled texts, in ``rounds``.

    Received labels are partly wrong and some texts mix languages. So a
    sentence has the label of most texts that hold it, and is left out where no
    label has most; and after each round, texts whose pooled sentences the
    network takes for another language than their label are left out. In a last
    round of ``repair`` steps, sentences that several texts agree on and that
    the network still takes for something else weigh ``stress`` times as much:
    a frequent short sentence that it has wrong would spoil every text with it."""
    net = ByteGRU(len(LANGUAGES), hidden, seed)
    texts = [(list(dict.fromkeys(s[2] for s in sentences(t))), y) for t, y in rows]
    use = [k for k, (keys, _) in enumerate(texts) if keys]
    for turn in range(rounds):
        pairs = sorted((key, v.index(max(v)), max(v)) for key, v in _votes(texts, use).items() if 2 * max(v) > sum(v))
        if not pairs:
            return net
        net.fit([p[0].encode() for p in pairs], np.array([p[1] for p in pairs]), np.sqrt([p[2] for p in pairs]), steps=steps // rounds, rate=0.02 / (turn + 1), seed=seed + turn)
        lab = Labeller(net)
        lab.learn({key for keys, _ in texts for key in keys})
        use = [k for k, (keys, y) in enumerate(texts) if keys and lab.most(keys) == y]
    pairs = sorted((key, v.index(max(v)), max(v)) for key, v in _votes(texts, use).items() if max(v) >= 0.75 * sum(v))
    if pairs and repair:
        weights = [np.sqrt(n) * (stress if n > 1 and lab.seen[key][0] != y else 1) for key, y, n in pairs]
        net.fit([p[0].encode() for p in pairs], np.array([p[1] for p in pairs]), np.array(weights), steps=repair, rate=0.005, seed=seed + rounds)
    return net


def fitted(df: DataFrame, text_cols: list[str], label: str, per_language: int, key: str, steps: int = 900) -> ByteGRU:
    """The network of a table's sample. Its weights are kept in the shared folder
    under a hash of the sample, so that one sample is fitted once, whichever
    query asks first; the same sample gives the same weights."""
    spark = df.sparkSession
    rows = training_sample(df, text_cols, label, per_language, key)
    mark = hashlib.md5(repr((steps, rows)).encode()).hexdigest()
    path = f"{application_dir(spark)}/language-{mark}"
    if path_exists(spark, path):
        return ByteGRU.load(bytes(spark.read.parquet(path).first()["weights"]))
    net = train(rows, steps=steps)
    spark.createDataFrame([(bytearray(net.dump()),)], "weights binary").coalesce(1).write.mode("overwrite").parquet(path)
    return net


class Labeller:
    """Labels sentences, each distinct one once; what is kept is bounded."""

    def __init__(self, net: ByteGRU, keep: int = 200_000, temper: float = 4.0):
        self.net, self.keep, self.temper, self.seen = net, keep, temper, {}

    def learn(self, keys: set[str]) -> None:
        if len(self.seen) > self.keep:
            self.seen.clear()
        new = [k for k in keys if k not in self.seen]
        if not new:
            return
        pooled = self.net.pooled([k.encode() for k in new]) / self.temper
        pooled -= pooled.max(1, keepdims=True)
        p = np.exp(pooled)
        p /= p.sum(1, keepdims=True)
        self.seen.update(zip(new, zip(p.argmax(1).tolist(), p.max(1).tolist())))

    def most(self, keys: list[str]) -> int:
        """The language that most letters of some sentences are taken for."""
        weight = [0.0] * len(LANGUAGES)
        for k in keys:
            lang, p = self.seen[k]
            weight[lang] += len(k) * p
        return weight.index(max(weight))

    def field(self, found: list[tuple[int, int, str, int]], sure: float) -> tuple[list, list]:
        """(languages, passages) of one field: languages as (code, confidence,
        share of letters), the largest first; passages as (number, start, end,
        code, confidence). A language beside the largest needs a sentence
        labelled with at least ``sure``; other sentences join what they stand in."""
        labels = [self.seen[k] for _, _, k, _ in found]
        weight = [0.0] * len(LANGUAGES)
        firm = [False] * len(LANGUAGES)
        for (lang, p), (_, _, _, size) in zip(labels, found):
            weight[lang] += size * p
            firm[lang] |= p >= sure
        main = max(range(len(LANGUAGES)), key=lambda k: weight[k])
        passages, total = [], {}
        for (lang, p), (s, e, _, size) in zip(labels, found):
            if not firm[lang]:
                lang, p = (passages[-1][3] if passages else main), 1 - p
            if passages and passages[-1][3] == lang:
                last = passages[-1]
                passages[-1] = (last[0], last[1], e, lang, last[4] + p * size, last[5] + size)
            else:
                passages.append((len(passages), s, e, lang, p * size, size))
            t = total.setdefault(lang, [0.0, 0])
            t[0] += p * size
            t[1] += size
        letters = sum(t[1] for t in total.values())
        langs = sorted(((LANGUAGES[k], t[0] / t[1], t[1] / letters) for k, t in total.items()), key=lambda x: -x[2])
        return langs, [(n, s, e, LANGUAGES[k], p / size) for n, s, e, k, p, size in passages]


SCHEMA = "id bigint, field string, label string, languages array<struct<lang:string,confidence:double,share:double>>, passages array<struct<passage_no:int,start_at:int,end_at:int,lang:string,confidence:double>>"
_LANGS = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("share", pa.float64())]))
_PASSAGES = pa.list_(pa.struct([("passage_no", pa.int32()), ("start_at", pa.int32()), ("end_at", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))


def identify(df: DataFrame, id_col: str, text_cols: list[str], label: str | None, per_language: int = 400, steps: int = 900, sure: float = 0.995, net: ByteGRU | None = None) -> DataFrame:
    """(id, field, label, languages, passages): one row per field that holds prose.

    The network is fitted on at most ``per_language`` rows of each labelled
    language (the one bounded sample here), unless ``net`` is given. ``label``
    is the received label's code, null where it is missing or stands for no
    language. Fields that are null, blank, placeholders or formulas only have
    no row. Offsets are in characters of the whole text. Other columns are
    ignored; repeated ids give repeated rows; an empty table gives none.
    """
    if net is None:
        net = fitted(df, text_cols, label, per_language, id_col, steps)
    code = language_code(F.col(label)) if label else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), code.alias("label"), *[F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate(text_cols)])

    def run(batches):
        lab = Labeller(net)
        for b in batches:
            ids, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            fields, keys = [], set()
            for k, name in enumerate(text_cols):
                for i, text in enumerate(b.column(2 + k).to_pylist()):
                    if text and (found := sentences(text)):
                        fields.append((i, name, found))
                        keys.update(f[2] for f in found)
            lab.learn(keys)
            done = [(ids[i], name, labels[i], *lab.field(found, sure)) for i, name, found in fields]
            cols = list(zip(*done)) if done else [()] * 5
            lang_rows = [[dict(zip(("lang", "confidence", "share"), x)) for x in r] for r in cols[3]]
            passage_rows = [[dict(zip(("passage_no", "start_at", "end_at", "lang", "confidence"), x)) for x in r] for r in cols[4]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(lang_rows, _LANGS), pa.array(passage_rows, _PASSAGES)],
                ["id", "field", "label", "languages", "passages"],
            )

    return rows.mapInArrow(run, SCHEMA)


def calibration(df: DataFrame, id_col: str, text_cols: list[str], label: str, per_language: int = 400) -> DataFrame:
    """(bin, n, mean_confidence, agreement): for tenths of the confidence in a
    field's largest language, how many fields of rows outside the sample there
    are and how many have the language of their label. Labels are partly wrong,
    so agreement is below accuracy by the share of wrong labels."""
    code = language_code(F.col(label))
    rank = F.row_number().over(Window.partitionBy("_code").orderBy(F.xxhash64(id_col), id_col))
    sampled = df.select(F.col(id_col).cast("bigint").alias("id"), code.alias("_code")).where(F.col("_code").isin(LANGUAGES)).withColumn("_r", rank).where(F.col("_r") <= per_language).select("id")
    found = identify(df, id_col, text_cols, label, per_language).where(F.col("label").isin(LANGUAGES)).join(F.broadcast(sampled), "id", "left_anti")
    top = F.get("languages", F.lit(0))
    rows = found.select(top["confidence"].alias("p"), (top["lang"] == F.col("label")).cast("int").alias("ok"))
    return rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_confidence"), F.round(F.avg("ok"), 4).alias("agreement"))


def mislabelled(found: DataFrame) -> DataFrame:
    """(id, field, lang): each language of the fields whose label is missing or
    names another language, or that hold sentences of more than one."""
    wrong = F.col("label").isNull() | ~F.exists("languages", lambda x: x["lang"] == F.col("label")) | (F.size("languages") > 1)
    return found.where(wrong).select("id", "field", F.explode("languages").alias("x")).select("id", "field", F.col("x.lang").alias("lang"))

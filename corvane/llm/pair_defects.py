"""Problem 3: defective prompt/response pairs and their one type of defect.

Responses are sorted by text over all partitions and each is compared with its
next different neighbour by the length of their common prefix: one that the
neighbour goes on from is a shortened version. Lengths at which unusually many
unfinished responses stop are length limits. These marks decide first; rules
for emptiness, refusals, copies of the question, results that are missing or
cut, and the language of the response decide where there is no mark. What
decided is told by ``reason``. Ranges are drawn over (text, id), so that copies of one text are spread
over partitions like all other rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialise, scratch

MIN_PREFIX = 20

# ---------------------------------------------------------------- fixed values

#: Words that stand for no content.
PLACEHOLDERS = set("n/a na none null nan nil tbd tba todo fixme - -- --- . .. ... … ? ?? x xxx empty missing unknown pending solution answer proof explanation response lösung respuesta réponse solución resposta ответ решение 答案 解答 解 无 暂无".split()) | {"no answer", "see above", "not available", "to be done"}

#: Wording with which a response declines, by language.
REFUSALS = {
    "en": r"\b(?:am|are|feel|be|being)?\s*(?:unable|not able|n't able)\s+to\s+(?:\w+\s+){0,2}(?:help|assist|solve|answer|work|provide|give|respond|comply|complete)|\b(?:can\s?not|can['’]t|could not|won['’]t|will not|do not|don['’]t)\s+(?:(?:feel able|have the ability|be able)\s+to\s+)?(?:\w+\s+)?(?:help|assist|solve|answer|work on|provide|give (?:you )?(?:a|an|the)|respond|attempt)\b|\b(?:beyond|outside)\s+what\s+i\b|\bmust\s+decline\b|\bi\s+decline\b|\brather\s+not\s+(?:answer|solve|respond)|\b(?:not|lack)\b[^.]{0,30}\b(?:information|context)\b[^.]{0,40}\b(?:proceed|respond|continue|answer|solve)|\bas\s+an?\s+(?:ai|automated|language)\b|\bbeing\s+an?\s+(?:ai|automated|language)\b",
    "es": r"\bno\s+(?:puedo|podemos|soy capaz de|voy a|quiero)\s+(?:\w+\s+)?(?:ayudar\w*|responder|resolver\w*|contestar|dar|trabajar)|\bprefiero\s+no\s+(?:responder|contestar|resolver)|\bno\s+tengo\s+(?:\w+\s+)?(?:información|datos|contexto)|\b(?:consulta|pregunta)\s+(?:a|con)\s+un",
    "fr": r"\bne\s+(?:peux|pouvons|vais|veux|suis)\s+pas\s+(?:\w+\s+){0,2}(?:aider|répondre|résoudre|donner|traiter|capable|en mesure)|\bpréfère\s+ne\s+pas\s+(?:répondre|résoudre)|\bn['’]ai\s+pas\s+assez\s+d['’e]|\b(?:veuillez|vaut mieux)\s+consulter",
    "de": r"\bkann\s+(?:ich\s+)?(?:\w+\s+){0,5}(?:nicht|keine?)\s+(?:\w+\s+){0,2}(?:helfen|lösen|beantworten|geben|bearbeiten|antworten)|\b(?:werde|möchte|will|kann)\s+(?:ich\s+)?(?:(?:das|hier|darauf)\s+)?nicht\s+(?:antworten|helfen|beantworten)|\bmir\s+fehlen|\b(?:bitte\s+(?:frage|wende)|besser\s+frage)\b",
    "pt": r"\bnão\s+(?:posso|podemos|consigo|vou|quero)\s+(?:\w+\s+)?(?:ajudar|responder|resolver|dar|fornecer)|\bprefiro\s+não\s+(?:responder|resolver)|\bnão\s+tenho\s+(?:\w+\s+)?(?:informação|informações|dados|contexto)|\bconsulte\s+um",
    "ru": r"не\s+(?:могу|можем|буду|хочу|готов\w*|стану)\s+(?:\w+\s+)?(?:помочь|решить|решать|ответить|отвечать|дать)|недостаточно\s+(?:данных|информации|сведений)|обратитесь\s+к",
    "zh": r"(?:无法|不能|不会|不想|没法|不愿)(?:为您|帮您|帮助|帮忙)?(?:解决|解答|回答|作答|完成|提供|给出|继续|处理)|(?:信息|资料|条件|数据)不(?:足|够)|没有足够的|请(?:向|咨询|询问|找)[^。]{0,12}(?:老师|专家|请教|咨询)",
}
#: Wording of a finding that no solution exists, by language.
NO_SOLUTION = r"\\emptyset|\\varnothing|∅|no\s+(?:such|real|valid)?\s*(?:number|solution|value)s?\s*(?:exists?)?|aucune?\s+(?:solution|nombre|valeur)|n['’]existe\s+pas|no\s+(?:existe|hay)\s+(?:solución|ningún|tal)|não\s+(?:existe|há)|keine\s+(?:lösung|solche)\b(?!\s+geben)|нет\s+решен|не\s+существует|无解|不存在|没有解"

_REFUSAL = re.compile("|".join(REFUSALS.values()), re.I)
_NO_SOLUTION = re.compile(NO_SOLUTION, re.I)
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,30}>")
_STEP = re.compile(r"(?i)\b(?:step|schritt|étape|paso|passo|шаг)\s*\d+\s*[:.)]|第\s*\d+\s*步[:：]?")
_MATH = re.compile(r"\$\$(.+?)\$\$|\$([^$]+)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_VALUE = re.compile(
    r"^(?:[A-Za-z](?:_\{?\w+\}?)?\s*=\s*)?(?:[-+]?\s*(?:\\[dt]?frac\{[-+]?[\d.,\s]+\}\{[-+]?[\d.,\s]+\}|[\d.,]*\d(?:\s*/\s*\d+)?)\s*(?:\\sqrt(?:\[\d+\])?\{\d+\}|\\pi|\^\{?\\circ\}?|\\%|%|\\,?\s*\\text\{[^{}]*\}|[A-Za-z]{1,3})?|[-+]?\\sqrt(?:\[\d+\])?\{\d+\}|[-+]?\\pi|\\infty|(?:\\left)?[(\[]\s*[-+\d.,;\s]*\d\s*(?:\\right)?[)\]]|\\\{[-+\d.,;\s]*\\\}|\\text\{[^{}]+\}|\\(?:emptyset|varnothing)|\{\s*\})\s*$"
)
_BOLD = re.compile(r"\*\*([^*\n]+)\*\*")
_HASH = re.compile(r"####[ \t]*([^\n]*)")
_PLAIN = re.compile(r"(?:[=:：]|\b(?:is|equals|be|gives?|est|vaut|égale? à|es|igual a|son|ist|gleich|beträgt|é|равн\w+|это)|是|等于|为)\s*(-?\d[\d.,]*(?:/\d+)?)\s*[.。!]?\s*$", re.I)
_END_NOISE = re.compile(r"(?:\.{2,}|…|\bQED|\bq\.e\.d\.?|[■∎□])$", re.I)
MAX_TAIL = 60  # characters that may follow the formula of a stated result
_SENTENCE_END = re.compile(r"[.!?。！？][\"'»”)*]*\s*$")
_WORD = re.compile(r"[^\W_㐀-鿿]+|[㐀-鿿]")
_THREE_WORDS = re.compile(r"(?:(?<![</\\\w])[^\W\d_]{2,}(?![>\w])[^\w<>]+){3}")
_DOLLARS = re.compile(r"\$[^$]*\$")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_HAN = re.compile(r"[㐀-鿿]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


# ---------------------------------------------------------------- rules for one pair


def closed_boxes(s: str) -> tuple[list[str], bool]:
    """(contents of the closed ``\\boxed{}``, whether the last one is open)."""
    out, at, open_end = [], 0, False
    while (k := s.find("\\boxed{", at)) >= 0:
        depth, j = 1, k + 7
        while j < len(s) and depth:
            depth += (s[j] == "{") - (s[j] == "}")
            j += 1
        open_end = depth > 0
        if not depth:
            out.append(s[k + 7 : j - 1].strip())
        at = k + 7 if depth else j
    return out, open_end


def content(s: str) -> str:
    """What of a response is content: without tags, markers and marks."""
    t = _STEP.sub(" ", _TAGS.sub(" ", s))
    t = re.sub(r"\\boxed\{\s*\}|\\(?:text|mathrm)\{\s*\}|\*\*\s*\*\*", " ", t)
    return re.sub(r"[\s$#*:_.,;!?…\[\](){}\\|=\-–—]+", " ", t).strip()


def without_end_noise(s: str) -> str:
    """Without dots, ends-of-proof and blanks at the end, however many."""
    while True:
        t = s.rstrip()
        m = _END_NOISE.search(t, max(0, len(t.rstrip(".")) - 8))
        if not m:
            return t
        s = t[: m.start()]


def stated_result(s: str, problem: str) -> str | None:
    """The result a response states, or None."""
    body = (_TAGS.sub(" ", s) if "<" in s else s).rstrip()
    body = without_end_noise(body)
    boxes, open_end = closed_boxes(body) if "\\boxed{" in body else ([], False)
    boxes = [b for b in boxes if b]
    if boxes and not open_end:
        return boxes[-1]
    marked = [h.strip().rstrip(".") for h in _HASH.findall(body)] if "####" in body else []
    if marked and marked[-1]:
        h = marked[-1]
        return h if h.count("{") == h.count("}") else None
    bold = [b.strip() for b in _BOLD.findall(body) if re.search(r"\d|\\text|\\emptyset", b)] if "**" in body else []
    if bold:
        return bold[-1]
    if open_end:
        return None
    last = None
    for last in _MATH.finditer(body):
        pass
    if last is not None and body.replace("$$", "").count("$") % 2 == 0:
        value = next(g for g in last.groups() if g is not None).strip()
        tail = body[last.end() :]
        head = body[: last.start()]
        if len(tail) <= MAX_TAIL and "?" not in tail and "？" not in tail and not re.search(r"[.!。！]\s*\S", tail):
            sentence = re.split(r"[.!?。！？]\s+|[。！？\n]", head)[-1]
            if _VALUE.match(value) and len(_WORD.findall(sentence + tail)) >= 2 and (sentence.strip() + "$" + value + "$") not in problem:
                if _SENTENCE_END.search(body) or not tail.strip() or len(_WORD.findall(tail)) <= 4:
                    return value
            if _NO_SOLUTION.search(sentence) and _SENTENCE_END.search(body):
                return value
    if body.count("$") % 2 == 0 and (m := _PLAIN.search(body, body.rfind("\n") + 1)):
        return m.group(1)
    sentence = re.split(r"(?<=[.!?。！？])\s+|\n", body)[-1]
    if _NO_SOLUTION.search(sentence) and _SENTENCE_END.search(body):
        return "no solution"
    return None


def plain_result(r: str) -> str:
    r = re.sub(r"\\(?:text|mathrm|textbf)\{([^{}]*)\}", r"\1", without_end_noise(r))
    return re.sub(r"[\s$]|\\[,;! ]|\.$", "", r)


def copies(solution: str, problem: str) -> float:
    """The share of a response's wording (neighbouring word pairs and numbers)
    that stands in the question too."""
    a, b = _WORD.findall(_TAGS.sub(" ", solution).lower()), _WORD.findall(problem.lower())
    pa_ = list(zip(a, a[1:])) + a
    pb = set(zip(b, b[1:])) | set(b)
    return sum(x in pb for x in pa_) / max(1, len(pa_))


class Languages:
    """Language of a text by script and by common words; a word weighs less the
    more languages share it."""

    def __init__(self, words: list[tuple[str, str]]):
        by: dict[str, set[str]] = {}
        for lang, w in words:
            if not _HAN.search(w):
                by.setdefault(w.lower(), set()).add(lang)
        self.words = {w: {k: 1 / len(v) for k in v} for w, v in by.items()}

    def of(self, text: str) -> tuple[str | None, float]:
        """(language, margin over the second, 0 to 1)."""
        t = _DOLLARS.sub(" ", text) if "$" in text else text
        if "\\" in t or "<" in t:
            t = _MATH.sub(" ", _TAGS.sub(" ", t))
        if not t.isascii():
            han, cyr = len(_HAN.findall(t)), len(_CYRILLIC.findall(t))
            if han or cyr:
                latin = sum(map(len, _LATIN.findall(t)))
                if 2 * han > max(cyr, latin) and han >= 4:
                    return "zh", 2 * han / (2 * han + cyr + latin)
                if cyr > max(2 * han, latin) and cyr >= 8:
                    return "ru", cyr / (2 * han + cyr + latin)
        score: dict[str, float] = {}
        known = self.words
        for w in _LETTERS.findall(t.lower()):
            if w in known:
                for k, x in known[w].items():
                    score[k] = score.get(k, 0) + x
        if not score:
            return None, 0.0
        top = sorted(score.items(), key=lambda x: (-x[1], x[0]))
        second = top[1][1] if len(top) > 1 else 0.0
        return (top[0][0], (top[0][1] - second) / top[0][1]) if top[0][1] >= 0.8 else (None, 0.0)


def wholly_other(solution: str, problem: str, langs: Languages) -> bool:
    """Whether a response is prose wholly in another language than its prompt."""
    sl, sm = langs.of(solution)
    pl, pm = langs.of(problem)
    if sl is None or pl is None or sl == pl or sm < 0.25 or pm < 0.25:
        return False
    for part in re.split(r"(?<=[.!?。！？])\s+|[。！？\n]", solution):
        k, m = langs.of(part)
        if k == pl and m >= 0.5:
            return False
    return True


def judge(problem: str, solution: str, answer: str | None, langs: Languages) -> tuple[str | None, str]:
    """(defect or None, reason) by the rules for one pair."""
    if not _THREE_WORDS.search(solution):
        body = content(solution).lower()
        if not re.search(r"\w", body) or body in PLACEHOLDERS or solution.strip().lower() in PLACEHOLDERS:
            return "empty", "no content"
    result = stated_result(solution, problem)
    if (result is None or not re.search(r"\d|emptyset|solution", result)) and _REFUSAL.search(solution):
        return "refusal", "declines"
    if result is None:
        if copies(solution, problem) >= 0.6:
            return "copied_question", "wording of the question"
        return "truncated", "no result stated"
    r, a = plain_result(result), plain_result(answer or "")
    if a and r and a != r and (answer or "").strip().lower() not in PLACEHOLDERS:
        if r.startswith(a):
            return "truncated", "answer cut short"
        if a.startswith(r) and r.count("{") != r.count("}"):
            return "truncated", "result cut short"
        if a.startswith(r) and re.search(r"####[^\n]*$", solution.rstrip()):
            return "truncated", "result cut short"
    if wholly_other(solution, problem, langs):
        return "other_language", "language of the response"
    return None, ""


# ---------------------------------------------------------------- marks over all responses


def _trim(c):
    """Without tags, blanks and dots at the end, however many."""
    noise = F.lit(" \n\t\r\u00a0.…")
    base = F.rtrim(c, noise)
    return F.ltrim(F.when(base.endswith(">"), F.rtrim(F.regexp_replace(base, r"(?:</?[A-Za-z]+>[\s.…]*+)+\z", ""), noise)).otherwise(base))


def shortened_versions(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id) of the rows whose text, without trailing dots and tags, is a proper
    prefix of at least MIN_PREFIX characters of another row's text."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), _trim(F.col(text)).alias("text")).where(F.length("text") >= MIN_PREFIX)
    ordered = rows.repartitionByRange("text", "id").sortWithinPartitions("text", "id")

    def run(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        cur, ids, first, first_known = None, [], None, None
        out_id, out_kind = [], []

        def table(kind_text=()):
            n = len(out_id)
            cols = [pa.array(out_id + [None] * len(kind_text), pa.int64()), pa.array(out_kind + [k for k, _ in kind_text], pa.int8()), pa.array([None] * n + [t for _, t in kind_text], pa.string())]
            return pa.RecordBatch.from_arrays([*cols, pa.array([part] * (n + len(kind_text)), pa.int32())], ["id", "kind", "text", "part"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t == cur:
                    ids.append(i)
                    continue
                if cur is not None:
                    short = t.startswith(cur)
                    if first_known is None:
                        first_known = short
                    if short:
                        out_id += ids
                        out_kind += [0] * len(ids)
                else:
                    first = t
                cur, ids = t, [i]
            if out_id:
                yield table()
                out_id, out_kind = [], []
        if cur is not None:  # the last text's successor is in a later partition
            out_id, out_kind = ids, [1] * len(ids)
            known = 4 if first_known is None else 5 if first_known else 6
            yield table([(known, first), (3, cur)])

    marks = materialise(ordered.mapInArrow(run, "id bigint, kind tinyint, text string, part int"), "short")

    def settle(pdf):
        """Parts whose last text is a prefix of the next different one: two
        texts and a mark for each partition, nothing else."""
        import pandas as pd

        firsts = pdf[pdf.kind >= 4].sort_values("part")
        lasts = pdf[pdf.kind == 3].set_index("part").text
        out = []
        for part, last in lasts.items():
            for _, f in firsts[firsts.part > part].iterrows():
                if f.text != last:
                    if f.text.startswith(last):
                        out.append(part)
                    break
                if f.kind != 4:
                    if f.kind == 5:
                        out.append(part)
                    break
        return pd.DataFrame({"part": pd.Series(out, dtype="int32")})

    parts = marks.where("kind >= 3").withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(settle, "part int")
    return marks.where("kind = 0").select("id").unionByName(marks.where("kind = 1").join(parts, "part", "left_semi").select("id"))


def length_limits(lengths: DataFrame, least: int = 5, factor: float = 6.0, around: int = 10) -> DataFrame:
    """(n) lengths at which many more unfinished responses stop than at the
    lengths around. ``lengths`` (n) is counted first, so that the window runs
    over distinct lengths only."""
    counts = lengths.groupBy("n").agg(F.count("*").alias("c"))
    near = Window.partitionBy(F.lit(1)).orderBy("n").rangeBetween(-around, around)
    mean = (F.sum("c").over(near) - F.col("c")) / F.lit(2.0 * around)
    return counts.withColumn("mean", mean).where((F.col("c") >= least) & (F.col("c") > factor * F.col("mean"))).select("n")


def defects(df: DataFrame, common_words: DataFrame, id_col: str = "id", problem: str = "problem", solution: str = "solution", answer: str = "answer") -> DataFrame:
    """(id, defect, reason, shortened, at_limit): the defective rows.

    A null solution is empty; a null problem is the empty text; a null answer is
    no defect; rows with repeated ids are judged each. ``shortened`` tells that
    another response goes on where this one stops, ``at_limit`` that it stops at
    a length limit: a response that breaks off within a sentence is truncated by
    either mark, whatever stands in it earlier, unless it is empty, a refusal or
    a copy of the question. Texts are read whole;
    other columns are ignored; an empty table gives none.
    """
    words = [(r["lang"], r["word"]) for r in common_words.where("lang is not null and word is not null").select("lang", "word").distinct().collect()]  # a fixed small table

    def run(batches):
        langs = Languages(words)
        for b in batches:
            ids, ps, ss, ans = (b.column(k).to_pylist() for k in range(4))
            out = [judge(p or "", s or "", a, langs) for p, s, a in zip(ps, ss, ans)]
            tails = [_TAGS.sub(" ", s or "").rstrip() for s in ss]
            stops = [not _SENTENCE_END.search(t) and not re.search(r"[\d}$*]$", t) and bool(t) for t in tails]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array(stops, pa.bool_()), pa.array([len(s or "") for s in ss], pa.int32())],
                ["id", "defect", "reason", "stops", "n"],
            )

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(c).cast("string").alias(k) for k, c in (("p", problem), ("s", solution), ("a", answer))])
    with scratch(df.sparkSession) as tables:
        judged = materialise(rows.mapInArrow(run, "id bigint, defect string, reason string, stops boolean, n int").where("defect is not null or stops"), "judged")
        short = shortened_versions(df, id_col, solution).distinct().withColumn("shortened", F.lit(True))
        limits = length_limits(judged.where("stops and n > 0")).withColumn("at_limit", F.lit(True))
        marked = judged.join(short, "id", "left").join(F.broadcast(limits), "n", "left").na.fill(False, ["shortened", "at_limit"])  # distinct lengths with a spike
        open_ended = F.col("stops") & ~F.coalesce(F.col("defect"), F.lit("")).isin("empty", "refusal", "copied_question")
        marks = F.when(open_ended & F.col("shortened"), "shortened version of a neighbour").when(open_ended & F.col("at_limit"), "stops at a length limit")
        out = marked.select("id", F.when(marks.isNotNull(), "truncated").otherwise(F.col("defect")).alias("defect"), F.coalesce(marks, "reason").alias("reason"), "shortened", "at_limit")
        return tables.keep(materialise(out.where("defect is not null"), "defects"))

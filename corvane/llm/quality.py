"""Problem 8: per-document text statistics, and which documents are not prose.

All statistics are built-in column functions over whole texts: lengths,
symbols, punctuation, bullets, common words, repetition, and the shares of a
text (by characters) that stand in rows of fields, in items, in page furniture
and in sentences. Rules with fixed thresholds are applied to them; every rule a
text fails is recorded by name. The first failed rule with a kind gives the
kind, so what is not prose follows from the recorded failures alone.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the published fixed-threshold rules.
MIN_WORDS, MAX_WORDS = 50, 100_000
MIN_MEAN_WORD, MAX_MEAN_WORD = 3.0, 10.0
MAX_SYMBOL_RATIO = 0.1
MAX_BULLET_SHARE, MAX_ELLIPSIS_SHARE = 0.9, 0.3
MIN_ALPHA_SHARE, MIN_COMMON_WORDS = 0.8, 2

# Java patterns; formulas have any length, an opening without its end stops at the next one
_FORMULA = r"\$\$[^$]*\$\$|\$[^$]*\$|\\\[(?:[^\\]|\\(?!\[))*?\\\]|\\\((?:[^\\]|\\(?!\())*?\\\)"
_HAN = r"[㐀-鿿]"
_WORD = r"[\p{L}\p{M}&&[^㐀-鿿]]+"
_STOP = r"[.!?。！？…]\W?$"
#: A line that is a row of fields: ruled, tabbed, tagged, quoted, separated or aligned.
_ROW = (
    r"^\s*\|.*\|\s*$|^\s*\+[-=+]+\+\s*$|\S\s*\t|\t\s*\S|</?t(?:r|d|h|able|body|head)\b|\\(?:begin|end)\{(?:tabular|array)|^\s*\\hline|&.*\\\\$"
    r'|^"[^"]*"(?:\s?[;,|]\s?"[^"]*")+$|^[^,\s]*(?: [^,\s]+)?(?:,(?!\s)[^,]*){2,}$|^[^;\s]*(?:;(?!\s)[^;]*){2,}$|\S {2,}\S+(?: \S+)?(?: {2,}\S+(?: \S+)?)+\s*$|^\S+ {3,}\S+\s*$'
)
_HARD_ROW = r"\t|\||<t|&"
_BULLET = r"^\s*(?:[-*•+‣–—]\s+|\[[ xX]?\]\s+|\(?\d+[.):]\s*|\(?[a-zA-Z][.)]\s*|\d+(?:\.\d+)+\s+)"
_LABEL = r"^\s*\p{Lu}\p{L}+\s+\d+\s*[:.]\s*"  # a word and its number open the line
#: A line that points elsewhere: leaders or page numbers at its end.
_POINTER = r"\.{3,}\s*\d+\s*$|\(\p{L}{1,3}\.\s*\d+(?:,\s*\d+)*\)\s*$"
_NUMBERED = r"(?<![\w.])\d+(?:[):]\s*|\.\s+)-?\d"
_FIELDS = r"\b\w+=[\w.-]+"
_SEPARATOR = r"[,;、，；·/](?=\s|$|[㐀-鿿])| / "
_GARBLED = r"[ÂÃÐÑ][\x{80}-¿]|[âãäåæçèéï][\x{80}-\x{9f}¡-¿]|\x{fffd}"
_INNER = r"\p{Ll}\p{Lu}|\p{L}[;\[\]{},.?!=]\p{L}|\s[.,?!;:]\p{L}"
_CUT = r"[a-zа-яё]{3,}[.?!]\s+[a-zà-ÿа-яё]"
_ENDS = r"[a-zа-яё]{3,}[.?!](?:\s|$)"
_SYMBOL = r"[^\p{L}\p{M}\p{N}\s]"
_STRAY = r"\$|\\[A-Za-z]+|[\p{L}\p{N}_]\^[\p{L}\p{N}_]"
#: Wording of page furniture.
FURNITURE = (
    "log in|log out|sign in|sign up|register|reply|replies|quote|print|next|next page|previous|previous page|share|share this|report|report abuse|loading|advertisement|cookie settings|"
    "accept all|reject all|skip to content|back to top|mark as read|newest first|oldest first|last edited|forgot password|subscribe|unsubscribe|home|menu|search|read more|comments|privacy policy|terms of use|all rights reserved"
).split("|")
_FURNITURE = r"(?i)^\W*(?:\d+\s+)?(?:" + "|".join(FURNITURE) + r")\W*$"
_PARTS = r"\s+[·|•]\s+|\s{2,}"
_ANY_ROW = ("|", "\t", "<t", "</t", "\\hline", "\\begin", "&", '"', "  ", "+-", "+=")
_TIGHT = r"[,;]\S"
_MARK = "\ue000"  # stands for a formula


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _without_blanks(c: Column) -> Column:
    for x in (" ", "\n", "\t", "\r"):
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def common_word_lists(common_words: DataFrame) -> tuple[list[str], list[str]]:
    """Common words (word) of alphabetic and of CJK script: a fixed small table
    of function words, whole."""
    words = sorted({r["word"].lower() for r in common_words.select("word").where("word is not null").distinct().collect()})
    han = [w for w in words if re.search(_HAN, w)]
    return [w for w in words if w not in set(han)], sorted(han, key=lambda w: (-len(w), w))


def _arrays(df: DataFrame, text: str) -> DataFrame:
    """``df`` with what both kinds of statistics count: the text ``_t``, ``_p``
    with a mark for each formula, ``_b`` without formulas; its ``_toks`` (runs
    without blanks) and ``_lines``, of ``_t`` and ``_p``; ``_words`` (runs of
    letters outside formulas, in lower case) and ``_h`` (CJK characters)."""
    out = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_p", F.when(F.col("_t").rlike(r"[$\\]"), F.regexp_replace("_t", _FORMULA, _MARK)).otherwise(F.col("_t")))
    out = out.withColumn("_b", F.translate("_p", _MARK, " "))
    return out.withColumns(
        {
            "_toks": F.filter(F.split("_t", r"\s+"), lambda x: x != ""),
            "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"\S")),
            "_words": F.regexp_extract_all(F.lower("_b"), F.lit(_WORD), F.lit(0)),
            "_h": F.when(F.col("_t").rlike(_HAN), _count(F.col("_b"), _HAN)).otherwise(0),
        }
    )


def _common(common_words: DataFrame) -> tuple[Column, Column]:
    """(common words among ``_words``, CJK characters in common words)."""
    plain, han = common_word_lists(common_words)
    common = F.size(F.filter("_words", lambda x: x.isin(plain))) if plain else F.lit(0)
    # a CJK word counts by its characters, as the text does
    pattern = rf"[^㐀-鿿]|(?:{'|'.join(map(re.escape, han))})"
    common_han = F.when(F.col("_h") > 0, F.col("_h") - F.length(F.regexp_replace("_b", pattern, ""))).otherwise(0) if han else F.lit(0)
    return common, common_han


def _basic(out: DataFrame) -> dict[str, Column]:
    n, lines = F.size("_toks"), F.size("_lines")
    return {
        "word_count": n.cast("bigint"),
        "mean_word_length": _share(_sum(F.transform("_toks", lambda x: F.length(x))).cast("double"), n),
        "symbol_ratio": _share(_count(F.col("_t"), r"#|\.\.\.|…").cast("double"), n),
        "end_punct_share": _share(F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?。！？;:”\"»)]\s*$"))).cast("double"), lines),
        "common_word_share": _share((F.col("_common") + F.col("_common_han")).cast("double"), F.size("_words") + F.col("_h")),
        "common_words": (F.col("_common") + F.col("_common_han")).cast("bigint"),
        "bullet_share": _share(F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*(?:[-*•+‣–]|\d+[.)]|\(?[a-zA-Z0-9]\))\s"))).cast("double"), lines),
        "ellipsis_share": _share(F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)\s*$"))).cast("double"), lines),
        "alpha_word_share": _share(F.size(F.filter("_toks", lambda x: x.rlike(r"\p{L}"))).cast("double"), n),
    }


def statistics(df: DataFrame, text: str, common_words: DataFrame) -> DataFrame:
    """``df`` without columns of these names, and the statistics of ``text``.

    Basic ones: word_count, mean_word_length, symbol_ratio, end_punct_share,
    common_word_share, common_words, bullet_share, ellipsis_share and
    alpha_word_share. Words are runs without white space; common words are looked
    for among runs of letters outside formulas, those of CJK script as substrings
    by their characters. And those that tell lists, tables and junk apart, see
    :func:`_layout`. Null is the empty text, whose counts and shares are 0."""
    common, common_han = _common(common_words)
    out = _arrays(df, text).withColumns({"_common": common, "_common_han": common_han})
    basic = _basic(out)
    out = out.withColumns({f"_s_{k}": v for k, v in basic.items()})
    layout, out = _layout(out)
    names = {**{k: F.col(f"_s_{k}") for k in basic}, **layout}
    return out.select(*[F.col(c) for c in df.columns if c not in names], *[v.alias(k) for k, v in names.items()])


def _layout(out: DataFrame) -> tuple[dict[str, Column], DataFrame]:
    """The statistics that tell lists, tables and junk apart, over :func:`_arrays`.

    Shares of characters outside blank lines: ``sentence_share``, ``row_share``,
    ``item_share``, ``furniture_share``, ``other_share`` (lines that are none of
    these); formulas alone on a line count with the sentences if the text has
    any, else with the items. Of the whole text: ``garbled_share``,
    ``letter_share`` (words of one letter), ``distinct_words``,
    ``distinct_sentences``, ``encoded_share``, ``inner_share`` (marks or capitals
    within words), ``symbol_share``, ``distinct_symbols`` (of texts without wording), ``known_share`` (common words outside
    formulas), ``cut_share`` (sentences that go on in small letters after their
    end), ``stray`` (pieces of formulas outside any). What tells garbled wording
    (inner_share, brackets, cut_share, stray) is 0 where common words are as
    frequent as in sentences."""
    bare, w, h = F.col("_b"), F.size("_words"), F.col("_h")
    out = out.withColumns(
        {
            "_formula_length": _share((F.length("_t") - F.length("_p")).cast("double"), F.length("_p") - F.length(F.replace(F.col("_p"), F.lit(_MARK), F.lit("")))),
            "_may_row": reduce(or_, [F.col("_p").contains(x) for x in _ANY_ROW]) | F.col("_p").rlike(_TIGHT),
            "_may_fields": bare.contains("="),
            "_solid": F.length(_without_blanks(F.col("_t"))),
            "_bare_toks": F.when(F.col("_t") == bare, F.col("_toks")).otherwise(F.filter(F.split(bare, r"\s+"), lambda x: x != "")),
            "_marked_lines": F.when(F.col("_t") == F.col("_p"), F.col("_lines")).otherwise(F.filter(F.split("_p", "\n"), lambda x: x.rlike(r"\S"))),
            "_pieces": F.filter(F.transform(F.split("_t", r"(?<=[.!?。！？])\s*|\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 12),
        }
    )
    known = F.when(h > w, _share(F.col("_common_han").cast("double"), h)).otherwise(_share(F.col("_common").cast("double"), F.greatest(w, F.lit(1))))
    n = F.size("_bare_toks")
    out = out.withColumns(
        {
            "known_share": known,
            "garbled": _count(F.col("_t"), _GARBLED),
            "letter_share": F.when(
                (F.size("_bare_toks") >= 10) & (w + h > 0) & (F.length(_without_blanks(bare)) <= 1.6 * F.size("_bare_toks")),
                _share(_count(bare, r"(?<!\S)\p{L}(?!\S)").cast("double"), F.size("_bare_toks")),
            ).otherwise(0.0),
            "distinct_words": F.when(n >= 8, _share(F.greatest(F.size(F.array_distinct("_bare_toks")) - 2, F.lit(0)).cast("double"), n)).otherwise(1.0),
            "distinct_sentences": F.when(F.size("_pieces") >= 3, _share(F.size(F.array_distinct("_pieces")).cast("double"), F.size("_pieces"))).otherwise(1.0),
            "encoded_share": _share(_sum(F.transform(F.filter("_bare_toks", lambda x: (F.length(x) >= 28) & x.rlike(r"^(?=.*[A-Z0-9])[A-Za-z0-9+/=_-]{28,}$")), lambda x: F.length(x))).cast("double"), F.col("_solid")),
            "symbol_share": _share(_count(F.col("_t"), _SYMBOL).cast("double"), F.col("_solid")),
            "distinct_symbols": F.when(F.col("_t").rlike(r"\p{L}.*\p{L}.*\p{L}"), 0).otherwise(F.size(F.array_distinct(F.regexp_extract_all("_t", F.lit(_SYMBOL), F.lit(0))))),
            "_n_words": w,
            "_n_lines": F.size("_marked_lines"),
            "_rows_first": F.exists(F.slice("_marked_lines", 1, 3), lambda x: x.rlike(_ROW)),
        }
    )
    k = F.col("known_share")
    few = lambda limit, value, otherwise=0.0: F.when(k < limit, value).otherwise(otherwise)
    out = out.withColumns(
        {
            "inner_share": few(0.25, F.when(w >= 8, _share(_count(F.when(bare.rlike('[<"]'), F.regexp_replace(bare, r'<[^>]*>|"[^"\n]*"', " ")).otherwise(bare), _INNER).cast("double"), w)).otherwise(0.0)),
            "brackets": few(0.2, _count(bare, r"[a-z][\[\]][a-z]"), 0),
            "cut_share": few(0.12, F.when(F.col("_t").rlike(r"\p{Lu}"), _count(F.col("_t"), _CUT) / F.greatest(_count(F.col("_t"), _ENDS), F.lit(1))).otherwise(0.0)),
            "stray": few(0.12, _count(bare, _STRAY), 0),
        }
    )
    cut = F.col("cut_share") > 0.6
    good = (k >= 0.05) & ~(cut & (k < 0.1)) & ((h <= F.col("_n_words")) | (k >= 0.03))

    def split_bullet(line: Column) -> Column:
        return F.struct(line.alias("s"), F.regexp_replace(line, f"{_BULLET}|{_LABEL}", "").alias("body"))

    def features(x: Column) -> Column:
        line, body = x["s"], x["body"]
        return F.struct(
            line.alias("s"),
            (F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit("")))).alias("m"),
            _count(line, _WORD).alias("w"),
            F.when(h > 0, _count(line, _HAN)).otherwise(0).alias("h"),
            F.when(body != line, _count(body, _WORD)).alias("bw"),
            F.right(F.rtrim(body), F.lit(2)).rlike(_STOP).alias("stop"),
        )

    def judge(x: Column) -> Column:
        line, m = x["s"], x["m"]  # a formula counts as a word
        bullet = x["bw"].isNotNull()
        size, bw = x["w"] + m + x["h"] / 2, F.coalesce(x["bw"], x["w"]) + m
        parts = F.split(F.trim(line), _PARTS)
        row = F.col("_may_row") & line.rlike(_ROW)
        kind = (
            F.when((k < 0.2) & (F.size(F.filter(parts, lambda p: p.rlike(_FURNITURE))) * 2 > F.size(parts)), "furniture")
            .when(F.col("_may_fields") & ~x["stop"] & (_count(line, _FIELDS) >= 3), "furniture")
            .when(~x["stop"] & (line.rlike(_POINTER) | (_count(line, _NUMBERED) >= F.greatest(F.lit(3.0), size / 2))), "item")
            .when(row & ~(x["stop"] & (size >= 8) & (k >= 0.12) & ~line.rlike(_HARD_ROW)), "row")
            .when(line.rlike(f"^[\\s{_MARK}.,;:()\\[\\]]*$") | ((bw <= 2) & (m > 0) & (x["h"] == 0) & (size <= 3)), "formula")
            .when(_count(line, _SEPARATOR) >= F.greatest(F.when(x["stop"], 5.0).otherwise(3.0), size / 4.2), "item")
            .when(bullet & ~x["stop"] & (bw <= 6) & (m == 0) & (x["h"] <= 12), "item")
            .when(good & ((bw >= 4) | (x["h"] >= 6) | ((bw >= 2) & x["stop"])), "sentence")
            .when(((bw >= 5) | (x["h"] >= 8)) & x["stop"] & (line.rlike(r"^\s*\p{Lu}") | (x["h"] > 0)) & ~cut & (F.col("_n_lines") <= 3) & (_count(line, r"\$") % 2 == 0), "sentence")
            .when(bullet, "item")
            .otherwise("other")
        )
        return F.struct(kind.alias("k"), (F.length(F.trim(line)) + x["h"] + m * F.col("_formula_length")).alias("n"))

    out = out.withColumn("_judged", F.transform(F.transform(F.transform("_marked_lines", split_bullet), features), judge))
    weigh = lambda kind: F.aggregate("_judged", F.lit(0.0), lambda a, x: a + F.when(x["k"] == kind, x["n"]).otherwise(0.0))
    out = out.withColumns({f"_{c}": weigh(c) for c in ("sentence", "row", "item", "furniture", "formula", "other")})
    total = F.col("_sentence") + F.col("_row") + F.col("_item") + F.col("_furniture") + F.col("_formula") + F.col("_other")
    lone = (F.col("_sentence") == 0) | (F.col("_sentence") * 2 < total - F.col("_formula"))  # formulas that stand in no prose
    stats = {
        "sentence_share": _share((F.col("_sentence") + F.when(lone, 0).otherwise(F.col("_formula"))).cast("double"), total),
        "row_share": _share(F.col("_row").cast("double"), total),
        "item_share": _share((F.col("_item") + F.when(lone, F.col("_formula")).otherwise(0)).cast("double"), total),
        "furniture_share": _share(F.col("_furniture").cast("double"), total),
        "other_share": _share(F.col("_other").cast("double"), total),
        "garbled_share": F.when(F.col("garbled") >= 2, _share(F.col("garbled").cast("double"), F.length("_t"))).otherwise(0.0),
        **{c: F.col(c) for c in ("letter_share", "distinct_words", "distinct_sentences", "encoded_share", "inner_share", "symbol_share", "known_share", "cut_share", "stray", "distinct_symbols")},
        "brackets": F.col("brackets"),
        "letter_words": F.col("_n_words"),
        "field_rows_first": F.col("_rows_first"),
        "empty": F.size("_marked_lines") == 0,
    }
    return stats, out


def rules() -> list[tuple[str, str | None, Column]]:
    """(name, kind, condition) of the fixed-threshold rules over both kinds of
    statistics, in the order in which they decide. Those without a kind say that
    a text is unfit for training, not what it is."""
    c = F.col
    wordy = c("letter_words") >= 8
    not_prose = c("sentence_share") < 0.5
    junk_share = c("furniture_share") + c("other_share")
    return [
        ("empty", "junk", c("empty")),
        ("garbled", "junk", c("garbled_share") >= 0.003),
        ("spaced_letters", "junk", c("letter_share") > 0.6),
        ("repeated_sentences", "junk", c("distinct_sentences") <= 0.4),
        ("repeated_words", "junk", (c("distinct_words") <= 0.15) & ~c("field_rows_first")),
        ("encoded", "junk", c("encoded_share") > 0.5),
        ("marks_within_words", "junk", wordy & (c("known_share") < 0.25) & ~c("field_rows_first") & (c("inner_share") > F.when(c("known_share") > 0.12, 0.12).otherwise(0.05))),
        ("brackets_within_words", "junk", wordy & (c("brackets") >= 3) & (c("known_share") < 0.2)),
        ("unconnected_words", "junk", wordy & (c("known_share") < 0.12) & ~c("field_rows_first") & ((c("cut_share") > 0.3) | (c("stray") >= 2))),
        ("symbols_only", "junk", (c("symbol_share") > 0.4) & (c("distinct_symbols") >= 12)),
        ("field_rows", "table", not_prose & (c("row_share") >= c("item_share")) & (c("row_share") >= junk_share)),
        ("items", "list", not_prose & (c("item_share") > c("row_share")) & (c("item_share") >= junk_share)),
        ("no_sentences", "junk", not_prose),
        ("few_words", None, c("word_count") < MIN_WORDS),
        ("many_words", None, c("word_count") > MAX_WORDS),
        ("mean_word_length", None, ~c("mean_word_length").between(MIN_MEAN_WORD, MAX_MEAN_WORD)),
        ("symbols", None, c("symbol_ratio") > MAX_SYMBOL_RATIO),
        ("bullets", None, c("bullet_share") > MAX_BULLET_SHARE),
        ("ellipses", None, c("ellipsis_share") > MAX_ELLIPSIS_SHARE),
        ("few_alphabetic_words", None, c("alpha_word_share") < MIN_ALPHA_SHARE),
        ("few_common_words", None, c("common_words") < MIN_COMMON_WORDS),
    ]


def text_statistics(df: DataFrame, id_col: str, text: str, common_words: DataFrame) -> DataFrame:
    """(doc_id, statistics ..., failed_rules, kind): one row per row of ``df``.

    ``failed_rules`` has the names of all rules a text fails, in order; ``kind``
    is that of the first of them with one, else 'prose'. A null, empty or blank
    text fails 'empty' and is junk; repeated texts and ids count each time; very
    long texts are read whole; other columns are ignored, whatever their names;
    an empty table gives none."""
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    stats = statistics(rows, "text", common_words)
    failed = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, _, cond in rules()]), lambda x: x.isNotNull())
    kinds = {name: kind for name, kind, _ in rules() if kind}
    first = F.get(F.filter("failed_rules", lambda x: x.isin(list(kinds))), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    # A condition on what comes out must not travel back through these expressions, which it would repeat: the row number stops it.
    out = stats.drop("text").withColumns({"failed_rules": failed, "_nr": F.monotonically_increasing_id()})
    return out.withColumn("kind", F.coalesce(F.try_element_at(table, first), F.lit("prose"))).where("_nr >= 0").drop("_nr")


def not_prose(df: DataFrame, id_col: str, text: str, common_words: DataFrame) -> DataFrame:
    """(doc_id, kind, failed_rules) of the texts that are lists, tables or junk by
    the rules they fail."""
    return text_statistics(df, id_col, text, common_words).where("kind <> 'prose'").select("doc_id", "kind", F.array_join("failed_rules", ",").alias("failed_rules"))

"""Queries of the training-data operators and, where SQL can say the same on
whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.near_dup import near_duplicate_groups, pairs_of_groups

    return pairs_of_groups(near_duplicate_groups(table(spark, d, "problems"), "id", ["problem", "solution"]))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.near_dup import near_duplicate_groups

    return near_duplicate_groups(table(spark, d, "problems"), "id", ["problem", "solution"])


def _languages(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.lang_id import identify

    return identify(table(spark, d, "problems"), "id", ["problem", "solution"], "lang")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.lang_id import mislabelled

    return mislabelled(_languages(spark, d))


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    x = F.explode("languages").alias("x")
    return _languages(spark, d).select("id", "field", "label", x).select("id", "field", "label", F.col("x.lang").alias("lang"), F.round("x.confidence", 4).alias("confidence"), F.round("x.share", 4).alias("share"))


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("id", "field", F.explode("passages").alias("x")).select("id", "field", "x.passage_no", "x.start_at", "x.end_at", "x.lang", F.round("x.confidence", 4).alias("confidence"))


def p2_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How often fields labelled with a confidence have the language of their
    label, among rows that the network was not fitted on and whose label names
    one of its languages."""
    from corvane.llm.lang_id import calibration

    return calibration(table(spark, d, "problems"), "id", ["problem", "solution"], "lang")


def _defects(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.pair_defects import defects

    return defects(table(spark, d, "problems"), table(spark, d, "common_words"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("id", "defect")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).groupBy("defect", "reason", "shortened", "at_limit").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.split_overlap import cross_split_pairs

    pairs = cross_split_pairs(table(spark, d, "problems"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.split_overlap import overlap_by_record, overlap_report

    return overlap_report(overlap_by_record(table(spark, d, "problems")))


def p5_token_totals(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.token_budget import empty_budget, slices, totals, update

    cat = table(spark, d, "source_catalog")
    texts = slices(table(spark, d, "problems"), "id", ["problem", "solution"], cat, "problems").unionByName(slices(table(spark, d, "documents"), "doc_id", ["text"], cat, "documents"))
    return totals(update(empty_budget(spark), texts).cells)


def p5_updates(spark: SparkSession, d: str) -> DataFrame:
    """The same totals by signed deltas: an earlier state of the tables, in which
    late rows are missing, every seventh text was another and some rows stood
    that are gone by now, brought up to date."""
    from corvane.llm.token_budget import empty_budget, slices, totals, update

    cat = table(spark, d, "source_catalog")
    problems, documents = table(spark, d, "problems"), table(spark, d, "documents")
    now = slices(problems, "id", ["problem", "solution"], cat, "problems").unionByName(slices(documents, "doc_id", ["text"], cat, "documents"))
    changed = lambda c, key: F.when(F.pmod(F.col(key), F.lit(7)) == 0, F.concat(F.reverse(c), F.lit(" "))).otherwise(F.col(c)).alias(c)
    at = problems.agg(F.percentile_approx("added_at", 0.8).alias("t")).first()["t"]
    early = problems.where(F.col("added_at") <= F.lit(at)).withColumn("solution", changed("solution", "id"))
    gone = documents.where("doc_id % 11 = 0").withColumn("doc_id", -F.col("doc_id") - 1)
    before = slices(early, "id", ["problem", "solution"], cat, "problems").unionByName(slices(documents.unionByName(gone), "doc_id", ["text"], cat, "documents"))
    return totals(update(update(empty_budget(spark), before), now).cells)


def _document_sizes(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.token_budget import count_tokens

    return count_tokens(table(spark, d, "documents"), ["doc_id", "source"], "text")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    rows = table(spark, d, "pack_sizes").where("pack_name is not null and capacity_tokens > 0").collect()  # a fixed small table
    return {r["pack_name"]: r["capacity_tokens"] for r in rows}


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(_document_sizes(spark, d), _capacities(spark, d))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.packing import fill_report, pack

    caps = _capacities(spark, d)
    return fill_report(pack(_document_sizes(spark, d), caps), caps)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.mixing import mixture

    return mixture(_document_sizes(spark, d), table(spark, d, "source_catalog"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.mixing import mixture

    return mixture(_document_sizes(spark, d), table(spark, d, "source_catalog"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.quality import not_prose

    return not_prose(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words")).select("doc_id", "kind")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    from corvane.llm.quality import text_statistics

    return text_statistics(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def p8_failures(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each kind fail each rule."""
    from corvane.llm.quality import text_statistics

    stats = text_statistics(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "common_words"))
    return stats.select("kind", F.explode("failed_rules").alias("rule")).groupBy("kind", "rule").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        *(p1_found, p1_groups, p2_found, p2_fields, p2_passages, p2_calibration, p3_found, p3_reasons, p4_found, p4_report),
        *(p5_token_totals, p5_updates, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_statistics, p8_failures),
    )
}
ORACLE: dict[str, str] = {}

"""The registered query of each operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import (
    centroid_clusters,
    decontamination,
    html_text,
    jaccard_join,
    line_dedup,
    personal_data,
    quality_model,
    quality_rules,
    substring_dedup,
    toxicity,
    warc_archive,
    whitening,
)
from orderlens.llm.packing import pack
from orderlens.llm.shared import table
from orderlens.session import small_tasks


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.texts(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.digest(decontamination.contamination(docs, items))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.spans(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(small_tasks(spark), sf_dir, "documents"))
    return done.select("row.doc_id", "n_removed", F.col("clean").alias("text"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archived(table(spark, sf_dir, "pages")).drop("url")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.digest(centroid_clusters.cluster(table(spark, sf_dir, "embeddings")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_personal_data": op4_personal_data,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_warc_archive": op11_warc_archive,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op8_quality_rules": quality_rules.ORACLE,
    "op11_warc_archive": warc_archive.ORACLE,
    "op12_centroid_clusters": centroid_clusters.ORACLE,
}

"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stripline.llm.oracles import ORACLES  # noqa: F401  the entry file reads it here


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from stripline.llm.packing import pack_sequences

    return pack_sequences(docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.anchors import remove_repeats

    return remove_repeats(docs(spark, sf_dir), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.suffixes import remove_substrings

    return remove_substrings(docs(spark, sf_dir), with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.lines import drop_repeated_lines

    return drop_repeated_lines(docs(spark, sf_dir), with_text=False).drop("text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.licences import scan_licences

    return scan_licences(docs(spark, sf_dir)).drop("found")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.mixing import mixed_sizes

    return mixed_sizes(docs(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.jaccard import similar_groups

    return similar_groups(docs(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.lm import score_texts

    return score_texts(docs(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.digests import fingerprints

    return fingerprints(docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.quality import judge

    return judge(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.secrets import scan_secrets, secret_digest

    return secret_digest(scan_secrets(docs(spark, sf_dir)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from stripline.llm.divergence import audit_sources

    pairs, terms = (d.withColumn("part", F.lit(part)) for d, part in zip(audit_sources(docs(spark, sf_dir)), ("pair", "term")))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stripline.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mixing, op3_packing, op4_substring_dedup, op5_suffix_dedup, op6_line_dedup, op7_jaccard_join,
                                   op8_lm_scoring, op9_fingerprints, op10_quality_rules, op11_secret_scan, op12_source_divergence, op13_embedding_whitening)}

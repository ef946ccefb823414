"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontam, htmlcrf, langid, lmscore, mixing, neardup, phrases, pii, quality, suffixdedup, tokenbin, urlrules, vectorcodes

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    return langid.query(table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark, sf_dir):
    return lmscore.query(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark, sf_dir):
    return htmlcrf.query(table(spark, sf_dir, "pages"))


def op5_near_duplicates(spark, sf_dir):
    return neardup.query(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark, sf_dir):
    return pii.query(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.query(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffixdedup.query(table(spark, sf_dir, "documents"))


def op10_token_binary(spark, sf_dir):
    return tokenbin.query(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_url_filters(spark, sf_dir):
    return urlrules.query(table(spark, sf_dir, "pages"))


def op12_vector_codes(spark, sf_dir):
    return vectorcodes.query(table(spark, sf_dir, "embeddings"))


def op13_phrase_mining(spark, sf_dir):
    return phrases.query(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_html_extraction": op4_html_extraction,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii": op7_pii,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_binary": op10_token_binary,
    "op11_url_filters": op11_url_filters,
    "op12_vector_codes": op12_vector_codes,
    "op13_phrase_mining": op13_phrase_mining,
    "pipeline": pipeline,
}
ORACLE = {"op8_mixing": mixing.SQL, "op11_url_filters": urlrules.SQL, "op12_vector_codes": vectorcodes.SQL, "op13_phrase_mining": phrases.SQL}

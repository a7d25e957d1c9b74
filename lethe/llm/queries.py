"""The numbered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import public_tokenizers

from lethe.llm import audio, embedding_dedup, html_text, language, line_dedup, mixing, ngram_join, packing, token_counts, toxicity
from lethe.llm.common import table


def op10_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_links(table(spark, sf_dir, "embeddings"))


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op4_mpeg_audio(spark, sf_dir):
    return audio.index_audio(audio.store_audio(table(spark, sf_dir, "documents")))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def queries():
    return {k: f for k, f in sorted(globals().items()) if k.startswith("op")}


def oracle_sql():
    return {
        "op1_ngram_join": ngram_join.SQL,
        "op6_mix_sources": mixing.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op10_embedding_dedup": embedding_dedup.SQL,
    }

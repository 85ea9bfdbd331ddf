"""One query an operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from . import chat, collocations, decontam, exact_topk, mixing, pii, quality_model, quality_rules, simhash, substring_dedup, suffix_dedup, tokenfile, whitening
from .store import table


def op1_decontam(spark, sf_dir):
    return decontam.decontam_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_tokens(spark, sf_dir):
    return tokenfile.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_report(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_report(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op6_quality_model(spark, sf_dir):
    return quality_model.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules.rule_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_chat(spark, sf_dir):
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op11_whitening(spark, sf_dir):
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_topk(spark, sf_dir):
    return exact_topk.topk_report(table(spark, sf_dir, "embeddings"))


#: One query an operator, in their order.
ALL = (
    op1_decontam,
    op2_tokens,
    op3_suffix_dedup,
    op4_substring_dedup,
    op5_pii,
    op6_quality_model,
    op7_quality_rules,
    op8_simhash,
    op9_mixing,
    op10_chat,
    op11_whitening,
    op12_collocations,
    op13_topk,
)

QUERIES = {f.__name__: f for f in ALL}

ORACLES = {
    "op1_decontam": decontam.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_chat": chat.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_topk": exact_topk.ORACLE,
}

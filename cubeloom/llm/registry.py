"""Queries of the training-data operators: opN_<name>(spark, sf_dir), and SQL where SQL can say the same."""

from __future__ import annotations

from . import host_rules, html_lstm, iso_media, katz_lm, packing, secret_scan, sentencepiece_codec, simhash_dedup, substring_windows, suffix_dedup
from .common import documents


def op1_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encoded(documents(spark, sf_dir))


def op2_katz_lm(spark, sf_dir):
    return katz_lm.scored(documents(spark, sf_dir))


def op3_host_rules(spark, sf_dir):
    return host_rules.judge(documents(spark, sf_dir))


def op4_simhash_dedup(spark, sf_dir):
    return simhash_dedup.near_groups(documents(spark, sf_dir))


def op5_html_lstm(spark, sf_dir):
    return html_lstm.extracted(documents(spark, sf_dir, "pages"))


def op6_substring_windows(spark, sf_dir):
    return substring_windows.near_passages(documents(spark, sf_dir))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(documents(spark, sf_dir))


def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan(documents(spark, sf_dir))


def op9_iso_media(spark, sf_dir):
    return iso_media.media_columns(documents(spark, sf_dir))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_katz_lm, op3_host_rules, op4_simhash_dedup, op5_html_lstm, op6_substring_windows, op7_suffix_dedup, op8_secret_scan, op9_iso_media, op10_packing)}
SQL = {"op3_host_rules": host_rules.ORACLE}

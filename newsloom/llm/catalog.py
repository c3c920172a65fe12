"""Registered queries of this package and their SQL twins."""

from newsloom.llm import (  # noqa: F401
    byte_bpe, chat_format, common, epsilon_join, exact_dedup, hard_negatives, html_text, language_id, line_dedup, line_quality, mixing, ngram_join,
    token_output, whitening,
)


def queries():
    return dict(common.QUERIES)


def oracle_sql():
    return dict(common.ORACLE)

"""Shape and content of summaries and descriptions."""

from pyspark.sql import Column, functions as F

from siftward import config
from siftward.functions.common import contains_any, text


def text_length(value: Column | str) -> Column:
    return F.length(text(value)).cast("long")


def line_count(value: Column | str) -> Column:
    """Pieces between newlines; empty text is one piece."""
    value = text(value)
    newlines = F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))
    return (newlines + 1).cast("long")


def has_code_block(value: Column | str) -> Column:
    return text(value).rlike(config.CODE_BLOCK)


def url_count(value: Column | str) -> Column:
    return F.regexp_count(F.lower(text(value)), F.lit(config.URL)).cast("long")


def has_suspicious_word(value: Column | str) -> Column:
    return contains_any(F.lower(text(value)), config.SUSPICIOUS_WORDS)


def non_ascii_share(value: Column | str) -> Column:
    """Extra bytes per byte, which approximates the share of non-ASCII text."""
    value = text(value)
    size = F.octet_length(value)
    return F.try_divide(
        (size - F.length(value)).cast("double"), F.greatest(size, F.lit(1)).cast("double")
    )


def text_features(summary: Column | str, description: Column | str) -> dict[str, Column]:
    return {
        "n_summary_len": text_length(summary),
        "n_desc_len": text_length(description),
        "n_desc_lines": line_count(description),
        "has_code_block_in_desc": has_code_block(description),
        "n_urls_in_desc": url_count(description),
        "has_suspicious_kw": has_suspicious_word(description),
        "pct_non_ascii_desc": non_ascii_share(description),
    }

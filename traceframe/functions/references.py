"""Column functions for references ("see page 12, annex table 1") and fact values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from traceframe import config
from traceframe.functions.text import ASCII_DIGITS, casefold, col, collapse, let, remove_space

def parse_reference(c) -> Column:
    """STRUCT<target_page, target_table, reference_text, marker>; null where the
    text has no marker word or names neither a page nor a table."""
    return let(collapse(c), _parsed)


def _parsed(text) -> Column:
    """``parse_reference`` of a collapsed text. Each part is found once; pages and tables are looked for only behind a marker."""

    def places(marker):
        found = F.struct(
            F.concat(*[F.regexp_extract(text, config.REFERENCE_PAGE, g) for g in (1, 2)]).alias("page"),  # one of the two is empty
            F.regexp_extract(text, config.REFERENCE_TABLE, 0).alias("table"),
        )
        return F.when(marker != "", let(found, lambda f: F.when(
            (f["page"] != "") | (f["table"] != ""),
            F.struct(
                F.translate(f["page"], *ASCII_DIGITS).try_cast("int").alias("target_page"),
                F.translate(remove_space(f["table"]), "．", ".").alias("target_table"),
                text.alias("reference_text"),
                F.trim(marker).alias("marker"),
            ),
        )))

    return let(F.regexp_extract(text, config.REFERENCE_MARKER, 0), places)


def is_reference_only(c, max_prefix: int = 12) -> Column:
    """The value only points elsewhere: at most a short label precedes the marker."""

    def test(text):
        at = F.regexp_instr(text, F.lit(config.REFERENCE_MARKER))
        prefix = F.btrim(F.substring(text, F.lit(1), at - 1), F.lit(config.REFERENCE_PUNCTUATION))
        return (F.length(prefix) <= max_prefix) & _parsed(text).isNotNull()

    return let(F.btrim(collapse(c), F.lit(config.REFERENCE_PUNCTUATION)), test)


def strip_reference_tail(c) -> Column:
    cut = F.regexp_replace(collapse(c), config.REFERENCE_TAIL, "")
    return F.btrim(cut, F.lit(config.REFERENCE_PUNCTUATION))


def normalize_fact_value(key, value, unit=None, labelled=config.LABELLED_FACT_KEYS) -> Column:
    """Comparable form of a fact value: no reference tail, quotes, spacing or punctuation."""
    text = F.translate(strip_reference_tail(value), "（）", "()")
    text = F.regexp_replace(text, "[《》〈〉“”\"'`]", "")
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f:：,，。；;、_\-—–]+", "")
    text = F.when(col(key).isin(labelled), F.regexp_replace(text, config.FACT_LABEL, "")).otherwise(text)
    suffix = F.lit("") if unit is None else remove_space(F.coalesce(col(unit), F.lit("")))
    return casefold(F.concat(text, suffix))

"""The 16-bit quality word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airgrid.constants import QA_FIELDS, QA_KEEP_ADJACENCY, QA_KEEP_CLOUD


def quality_text(word, zero_as_null: bool = False) -> Column:
    """Sixteen binary digits; `zero_as_null` keeps the rule that an empty word counts as missing."""
    text = F.lpad(F.bin(word.cast("long").bitwiseAND(F.lit(0xFFFF))), 16, "0")
    return F.when(word != 0, text) if zero_as_null else text


def binary_to_int(text) -> Column:
    return F.when(F.length(text) > 0, F.conv(text, 2, 10).cast("int"))


def quality_fields(word, one_based: bool = False, zero_as_null: bool = False, as_text: bool = False) -> list[Column]:
    """The eight fields of the word, as numbers (or digits with `as_text`).

    `one_based` reads the offsets as 1-based positions, as the original job text does: every
    field but the first then starts one bit early.
    """
    columns = []
    for name, start, length in QA_FIELDS:
        first = max(start - 1, 0) if one_based else start
        if as_text:
            value = F.substring(quality_text(word, zero_as_null), first + 1, length)
        else:
            value = F.shiftright(word.cast("int").bitwiseAND(F.lit(0xFFFF)), 16 - first - length) \
                .bitwiseAND(F.lit((1 << length) - 1))
            if zero_as_null:
                value = F.when(word != 0, value)
        columns.append(value.alias(name + "_str" if as_text else name))
    return columns


def quality_keep(word) -> Column:
    """Clear or possibly cloudy, and not next to cloud or snow."""
    digits = quality_text(word)
    return digits.substr(1, 3).isin(QA_KEEP_CLOUD) & digits.substr(6, 3).isin(QA_KEEP_ADJACENCY)

"""Full case folding and folding to ASCII as native expressions: their tables are the Unicode data that Python has."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


Tables = tuple[str, str, tuple[tuple[str, str], ...]]


def _tables(fold: Callable[[str], str]) -> Tables:
    """Characters beyond ASCII that fold to one and what they fold to, and those that fold to several; those that stay or go are in neither."""
    every = (chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    folded = [(c, f) for c in every if (f := fold(c)) not in (c, "")]
    single = [(c, f) for c, f in folded if len(f) == 1]
    return "".join(c for c, _ in single), "".join(f for _, f in single), tuple((c, f) for c, f in folded if len(f) > 1)


@cache
def _case_tables() -> Tables:
    return _tables(str.casefold)


@cache
def _ascii_tables() -> Tables:
    return _tables(lambda c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _folded(text: Column, tables: Tables) -> Column:
    """Each character by what it folds to; only texts that hold one which grows are searched for each of these."""
    before, after, growing = tables
    one = F.translate(text, before, after)
    pairs = F.split(F.lit("\n".join(c + f for c, f in growing)), "\n")  # one literal for all
    grown = F.aggregate(pairs, one, lambda t, p: F.replace(t, F.substring(p, 1, 1), F.substring(p, 2, 99)))
    grows = F.char_length(F.translate(text, "".join(c for c, _ in growing), "")) < F.char_length(text)
    return F.when(grows, grown).otherwise(one)


def casefold(text: Column) -> Column:
    """The text with differences of case taken out, such as ß and SS, or both small sigmas; null for null. Texts of ASCII only go by `lower`."""
    ascii_folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(_is_ascii(text), F.lower(text)).otherwise(_folded(ascii_folded, _case_tables()))


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without anything that isn't ASCII; null for null."""
    return F.when(_is_ascii(text), text).otherwise(F.regexp_replace(_folded(text, _ascii_tables()), r"[^\x00-\x7F]+", ""))

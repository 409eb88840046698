"""Unicode normal forms: Spark has no builtin, so these two use Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.functions import text as tx


def _normal(form: str):
    def one(value):
        if value is None or value.isascii():
            return value
        return unicodedata.normalize(form, value)

    @F.pandas_udf(T.StringType())
    def convert(values: pd.Series) -> pd.Series:
        return values.map(one)

    return convert


nfkc = _normal("NFKC")
nfkd = _normal("NFKD")

# Symbols the dedup form drops or folds.
ZERO_WIDTH = "[​-‍⁠﻿]"
SUPERSCRIPTS = "[¹²³⁰-⁹]+"
DAGGERS = "[†‡§]+"
QUOTES = "[\"'`“”‘’]"
DASHES = "[‐‑–—−]"
TOKEN = r"[\p{L}\p{N}%]+(?:[.-][\p{L}\p{N}%]+)*"
# end of fixed values


def norm_match(c: Column) -> Column:
    """Match form of any script: compatibility decomposition, marks dropped, ASCII letters and digits only."""
    return tx._match_form(F.regexp_replace(nfkd(tx.text_or_empty(c)), r"[̀-ͯ]", ""))


def dedup_form(compatible: Column) -> Column:
    """Canonical token stream of a text already in NFKC."""
    t = F.regexp_replace(compatible, ZERO_WIDTH, "")
    t = F.regexp_replace(t, f"(?:{SUPERSCRIPTS}|{DAGGERS}|{QUOTES})", "")
    t = F.regexp_replace(t, DASHES, "-")
    t = F.regexp_replace(t, f"(?i){tx.START}versus{tx.END}", "vs")
    t = F.regexp_replace(t, r"[.,;:!?]+$", "")
    t = F.lower(tx.norm_inline(t))
    return F.array_join(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), " ")


def norm_dedup(c: Column, superscripts_first: bool = False) -> Column:
    """Dedup form of a claim text.  Superscript digits fold into plain digits unless stripped first."""
    source = tx.text_or_empty(c)
    if superscripts_first:
        source = F.regexp_replace(source, SUPERSCRIPTS, "")
    return dedup_form(nfkc(source))

"""The one function that needs Python: full HTML unescaping, in Arrow batches."""

from __future__ import annotations

import html
import html.entities
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from candlewick.functions.expressions import untagged


#: A reference with the semicolon that ends it.
CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(text: str) -> str:
    known = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html.entities.html5 else m[0]
    return CLOSED.sub(known, text)


def unescaped(text: Column, closed: bool = False) -> Column:
    """Every named and numeric entity of HTML; with ``closed`` only those that a semicolon ends, so ``&amp`` stays as it is."""
    read = _closed if closed else html.unescape

    @F.pandas_udf(StringType())
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else read(t))

    return each(text)


def clean_text_full(text: Column, closed: bool = False) -> Column:
    return untagged(unescaped(text, closed))

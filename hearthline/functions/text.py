"""Text helpers: numbers out of labels, cleaning, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions.recode import ColumnLike, c


def extract_number(x: ColumnLike, to: str = "double") -> Column:
    """First run of digits in a label; missing if there is none."""
    return F.nullif(F.regexp_extract(c(x), r"\d+", 0), F.lit("")).try_cast(to)


def strip_text(x: ColumnLike) -> Column:
    """Drop punctuation and blanks; empty becomes missing."""
    return F.nullif(F.regexp_replace(c(x), r"[\p{Punct}\s]", ""), F.lit(""))


def strip_punct_space(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Clean all (or the given) text columns; numbers keep their sign and point."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: strip_text(n) for n in (cols or text)})


def str_detect(x: ColumnLike, pattern: str) -> Column:
    return c(x).rlike(pattern)


def str_sub(x: ColumnLike, start: int, length: int) -> Column:
    return F.substring(c(x), start, length)


def str_replace_all(x: ColumnLike, pattern: str, by: str) -> Column:
    return F.regexp_replace(c(x), pattern, by)


def str_c(*parts, sep: str = "") -> Column:
    """Join; missing if any part is missing (unlike `concat_ws`)."""
    pieces = []
    for i, p in enumerate(parts):
        if i and sep:
            pieces.append(F.lit(sep))
        pieces.append(p if isinstance(p, Column) else F.col(p))
    return F.concat(*pieces)


def paste(*parts, sep: str = " ") -> Column:
    """Join; a missing part is written NA."""
    return F.concat_ws(sep, *[F.coalesce(c(p).cast("string"), F.lit("NA")) for p in parts])

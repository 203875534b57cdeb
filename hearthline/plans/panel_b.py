"""Couples, one wave: cleaned text answers to a husband/wife table and its reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.functions import codebook, household as H, recode as R
from hearthline.functions.text import strip_punct_space
from hearthline.operators import shape
from hearthline.operators.impute import complete, impute_mice_rf

def cleaned(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All columns as text without punctuation and blanks, but for those in `keep`."""
    text = [f.name for f in raw.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    clean = strip_punct_space(raw, text) if text else raw
    return clean.select(*[F.col(n) if n in keep else F.col(n).cast("string").alias(n) for n in raw.columns])


def schooling_years(code: str, values: Sequence[int] = tuple(codebook.SCHOOLING_YEARS_RESPONDENT)) -> Column:
    return R.recode_positional(F.col(code).try_cast("int"), list(values), keep=False)


def episodes(levels: Sequence[str], schools: Sequence[str]) -> Column:
    """Parallel slot columns of school level and school type to one array of (kind, school)."""
    return F.array(*[F.struct(F.col(k).alias("kind"), F.col(s).alias("school")) for k, s in zip(levels, schools)])


def key_school_flags(couples: DataFrame, levels: Sequence[str], schools: Sequence[str], kinds: Mapping[str, Sequence[str]],
                     key_schools: Mapping[str, Sequence[str]], years: str) -> DataFrame:
    """key_<level> of the respondent: TRUE, FALSE or dropout.

    For each schooling level `kinds` lists the diploma labels that belong to it and `key_schools` the
    school labels that count as key schools there.
    """
    listed = couples.withColumn("__episodes", episodes(levels, schools))
    flags = {
        f"key_{lv}": F.upper(H.episode_flags(F.col("__episodes"), labels, key_schools[lv]).cast("string"))
        for lv, labels in kinds.items()
    }
    flagged = listed.withColumns(flags)
    return flagged.withColumns({f"key_{lv}": H.dropout_fill(f"key_{lv}", years, lv) for lv in kinds}).drop("__episodes")


def consumption(yearly: Sequence[str], monthly: Sequence[str]) -> Column:
    return R.weighted_row_sum({**{c: 1.0 for c in yearly}, **{c: 12.0 for c in monthly}})


def home_value(value: str, is_owner: Column) -> Column:
    """Repaired value, 0 for those who do not own."""
    return F.when(R.replace_na(is_owner, False), R.fix_units(F.col(value).try_cast("double"), codebook.COUPLE_VALUE_RULES)).otherwise(F.lit(0.0))


def husband_wife(couples: DataFrame, is_male: Column, names: Sequence[str], father_names: Sequence[str] = ()) -> DataFrame:
    """Adds husband/wife columns of both persons and of their fathers."""
    out = H.swap_roles(is_male, names)
    for n in father_names:
        own, other = F.col(f"{n}_res_father"), F.col(f"{n}_sps_father")
        out[f"{n}_husb_father"] = R.r_ifelse(is_male, own, other)
        out[f"{n}_wife_father"] = R.r_ifelse(is_male, other, own)
    return couples.withColumns(out)


def ordered(couples: DataFrame, key: str) -> DataFrame:
    """Key first, then columns by role: husband, wife, their fathers, the rest."""
    last = [n for n in couples.columns if n.endswith(("_husb", "_wife", "_husb_father", "_wife_father"))]
    by_role = sorted(last, key=lambda n: (n.endswith("_father"), n.endswith(("_wife", "_wife_father")), n))
    return shape.reorder_cols(couples, [key, *by_role])


def completed(couples: DataFrame, id_col: str, cols: Sequence[str], schools: Sequence[str], maxit: int = 30, seed: int = 999) -> DataFrame:
    """Missing values of `cols` filled by chained forests, in which having dropped out is an answer like any; then the key-school
    columns become TRUE, FALSE or, for dropouts, missing."""
    full = complete(impute_mice_rf(couples, id_col, cols, m=1, maxit=maxit, seed=seed))
    return full.withColumns({c: F.nullif(F.col(c), F.lit("dropout")).cast("boolean") for c in schools})

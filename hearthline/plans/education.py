"""The education report: schooling by parents' schooling and wealth, and the models of reaching each next level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.functions.recode import case_when
from hearthline.operators import models as L
from hearthline.operators.plotdata import line_points_data

# Years of schooling of each diploma, and who is asked about reaching the next one
DIPLOMA_YEARS = {"1 < Primary": range(0, 6), "2 Primary": [6], "3 Junior High": [9], "4 Senior High >": range(12, 23)}
STEPS = {"15+": (12, 15), "12+": (9, 12), "9+": (6, 9)}


def with_diploma(people: DataFrame, years: str, out: str, diplomas: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """Years of schooling as the diploma they stand for; years between two diplomas have none."""
    listed = DIPLOMA_YEARS if diplomas is None else diplomas
    return people.withColumn(out, case_when(*[(F.col(years).isin([int(y) for y in held]), name) for name, held in listed.items()]))


def schooling_curve(people: DataFrame, parent_years: str, wealth_group: str, years: str,
                    diplomas: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """(diploma_parent, wealth group, n, mean years): one cell per diploma of the parent and wealth group, known ones only."""
    return line_points_data(with_diploma(people, parent_years, "diploma_parent", diplomas), "diploma_parent", wealth_group, years)


def schooling_models(people: DataFrame, years: str, terms: Sequence[str],
                     steps: Mapping[str, tuple[int, int]] | None = None) -> list[L.Fit]:
    """Years by ordinary least squares, then for each step (from, to) the odds of `to` years and more among those with `from` and
    more. The steps are fitted together, so the report takes as many passes with ten of them as with one."""
    at = F.col(years)
    linear = L.ols(L.formula_builder(years, terms), people, "years")
    risks = {name: (at >= low, at >= high) for name, (low, high) in (STEPS if steps is None else steps).items()}
    return [linear, *L.logits(people, terms, risks)]


def education_report(people: DataFrame, years: str, terms: Sequence[str], steps: Mapping[str, tuple[int, int]] | None = None,
                     digits: int = 3) -> DataFrame:
    """The models side by side: one line per term, then n and the measures of fit."""
    return L.model_table(people.sparkSession, schooling_models(people, years, terms, steps), digits)

"""Life courses: change points to yearly states, distances, clusters, and a cluster per person."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators import sequences as Q, spells as SP, tiles as W


def yearly_sequences(people: DataFrame, id_col: str, points: Sequence[tuple[str, str]], end_year: int, length: int = 100,
                     window: int = 25) -> DataFrame:
    """(id, seq): the last `window` years of the states given by (year, state) columns."""
    spells = SP.change_points_to_spells(points, end_year)
    return people.select(id_col, SP.sequence_define(SP.spells_to_yearly(spells, length), window).alias("seq"))


def clustered_life_courses(people: DataFrame, id_col: str, k: int, labels: Mapping[int, str] | None = None,
                           references: Sequence[Q.Reference] | None = None, seed: int = 1, max_iter: int = 100, keep_seq: bool = False) -> DataFrame:
    """(id, cluster[, label][, seq]) from a table (id, seq), by distances to `references`: if none are given, all sequences,
    each by the number of people that hold it."""
    if references is None:
        found = W.kmeans_on_tiles(W.tiled_distances(people, "seq", Q.substitution_costs(people, "seq")), k, seed=seed, max_iter=max_iter)
    else:
        found = Q.kmeans_on_distances(Q.distance_features(people, "seq", references), k, seed=seed, max_iter=max_iter)
    rows = Q.assign_clusters(people, "seq", found)
    rows = rows if labels is None else Q.label_clusters(rows, labels)
    return rows if keep_seq else rows.drop("seq")


def cluster_profile(people: DataFrame, clusters: DataFrame, id_col: str) -> DataFrame:
    """States per year and cluster, with each state's share of its year; `people` are joined only if `clusters` lack the sequences.

    People of one cluster and sequence are counted before years are laid out."""
    rows = clusters.filter(F.col(id_col).isNotNull()) if "seq" in clusters.columns else people.join(clusters, id_col)
    held = rows.groupBy("cluster", "seq").agg(F.count(F.lit(1)).alias("n"))
    years = held.select("cluster", "n", F.posexplode(Q._filled("seq")).alias("pos", "state"))
    counts = years.groupBy("cluster", "pos", "state").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("cluster", "pos").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["cluster", "pos"]).withColumn("share", F.col("n") / F.col("total")).drop("total")

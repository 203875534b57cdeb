"""Exact top-k search by inner product with cover trees over queries and data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import col, kept
from .words import unpacked

PIVOT_SAMPLE = 256  # vectors, those with the smallest hashes of their ids, among which the top level's centres are chosen
CELLS = 32  # centres of the top level, besides the origin
BLOCK_ROWS = 8192  # data vectors of a cell that one task indexes
GROUP_ROWS = 1024  # queries of a cell that share a bound
CHUNK_ROWS = 2048  # queries that meet a block in one task, about
LEAF = 64
EXACT = 2.0**53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exactly; beyond the range of 64 bits the nearest end of it."""
    if not len(a) or not len(b) or float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = a.astype(object) @ b.astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Node:
    center: np.ndarray
    radius: float
    at: np.ndarray  # places of its vectors
    norm: float
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray) -> Node:
    """A tree of balls: the children of a node have centres over 2^(s-1) apart and cover it within that distance, where s falls on
    the way down. A node of few vectors, or one that a level would scatter into nearly single vectors, stays a leaf."""

    def node(center: np.ndarray, at: np.ndarray, far: np.ndarray) -> Node:
        return Node(center, float(far.max(initial=0.0)), at, float(np.linalg.norm(center)))

    away = lambda at, center: np.linalg.norm(x[at] - center, axis=1)
    every = np.arange(len(x))
    root = node(x[0], every, away(every, x[0]))
    waiting = [root]
    while waiting:
        top = waiting.pop()
        if len(top.at) <= LEAF or top.radius == 0:
            continue
        near = away(top.at, top.center)
        owner, centers = np.zeros(len(top.at), np.int64), [top.center]
        cover = 2.0 ** (np.ceil(np.log2(top.radius)) - 1)
        limit = max(8, len(top.at) // 16)
        while near.max() > cover and len(centers) <= limit:
            centers.append(x[top.at[near.argmax()]])
            far = away(top.at, centers[-1])
            closer = far < near
            near[closer], owner[closer] = far[closer], len(centers) - 1
        if len(centers) > limit or len(centers) == 1:
            continue
        for c, center in enumerate(centers):
            own = owner == c
            if own.any():
                top.children.append(node(center, top.at[own], near[own]))
        waiting += top.children
    return root


def bound(a: Node, b: Node) -> float:
    """No inner product of a vector under `a` with one under `b` is larger."""
    most = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return most + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius) + 1e-6


def search(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query up to k vectors of other ids with the highest scores, none below `least`: places of the queries, ids and scores.

    Both trees are walked together, the pair with the highest bound first; a pair goes if its bound is below the
    worst kth score of the queries under it.
    """
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query_ids]
    if len(queries) and len(data):
        kth = least.astype(np.float64).copy()
        x, y = queries.astype(np.float64), data.astype(np.float64)
        pairs = [(cover_tree(x), cover_tree(y))]
        while pairs:
            a, b = pairs.pop()
            if bound(a, b) < kth[a.at].min():
                continue
            if a.children or b.children:
                # the wider node is opened
                if b.children and (b.radius >= a.radius or not a.children):
                    more = [(a, c) for c in b.children]
                else:
                    more = [(c, b) for c in a.children]
                pairs += sorted(more, key=lambda p: bound(*p))
                continue
            score = products(queries[a.at], data[b.at])
            for row in np.flatnonzero((score >= kth[a.at][:, None]).any(1)):
                q = a.at[row]
                take = np.flatnonzero((score[row] >= kth[q]) & (ids[b.at] != query_ids[q]))
                if not len(take):
                    continue
                s, v = np.concatenate([held[q][0], score[row][take]]), np.concatenate([held[q][1], ids[b.at[take]]])
                best = np.lexsort((v, -s))[:k]
                held[q] = s[best], v[best]
                if len(best) == k:
                    kth[q] = max(kth[q], float(s[best[-1]]))
    place = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
    empty = [np.zeros(0, np.int64)]
    return place, np.concatenate([v for _, v in held] or empty), np.concatenate([s for s, _ in held] or empty)


def exact_topk(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: for every row with `is_query`, the k rows of other ids with the highest inner product, ties to the smaller id.

    `vectors` holds arrays of integers (an inner product outside 64 bits counts as the nearest end of them). Rows
    with a null id or vector, or a null component, take no part; vectors of one length are searched together, those of
    different lengths never meet. Rows that share an id are separate candidates, and none is one for its own id.

    Queries and data are put into one tree. Its top level, a bounded set of centres, is laid out over the cluster:
    each vector belongs to the nearest centre, a cell's data is cut into blocks and its queries into groups of bounded
    size. Each query first searches one block of its own cell. Then a group meets only the blocks of cells whose
    bound by covering radii reaches the worst kth score in the group, and inside a task two cover trees, over the block
    and over the queries that have come to it, are searched together. In data without clusters few pairs are pruned, and the work is
    that of all queries against all blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(vec_id).cast("long").alias("id"), F.transform(col(vector), lambda v: v.cast("long")).alias("vec"), is_query.alias("query"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull()))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("vec").collect()
    pivots: dict[int, np.ndarray] = {}
    for size in {len(r.vec) for r in sample}:
        x = np.array([r.vec for r in sample if len(r.vec) == size], np.float64).reshape(-1, size)
        chosen, far = [np.zeros(size)], np.linalg.norm(x, axis=1)
        while len(chosen) <= CELLS and far.max(initial=0) > 0:
            chosen.append(x[far.argmax()])
            far = np.minimum(far, np.linalg.norm(x - chosen[-1], axis=1))
        pivots[size] = np.array(chosen)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            sizes = np.asarray(lists.value_lengths())
            flat, first = np.asarray(lists.flatten()), np.cumsum(np.append(0, sizes))
            cell, far = np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = flat[first[own][:, None] + np.arange(size)].astype(np.float64).reshape(len(own), size)
                away = np.stack([np.linalg.norm(x - c, axis=1) for c in pivots.get(int(size), np.zeros((1, size)))])
                cell[own], far[own] = away.argmin(0), away.min(0)
            data = [flat[a:b].astype("<i8").tobytes() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "query": batch.column("query"), "size": pa.array(sizes, pa.int32()), "cell": pa.array(cell, pa.int32()), "far": far, "vec": pa.array(data, pa.binary())})

    settled = kept(rows.mapInArrow(settle, "id long, query boolean, size int, cell int, far double, vec binary"), "cells")
    # a row for each cell: at most CELLS + 1 for each length of vectors
    cells = settled.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count(F.when(F.col("query"), 1)).alias("queries"), F.max(F.when(F.col("query"), F.col("far"))).alias("query_far")).collect()
    if not any(c.queries for c in cells):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    total = sum(c.queries for c in cells)
    chunks = -(-total // chunk_rows)
    layout = spark.createDataFrame([(c.size, c.cell, -(-c.n // block_rows), max(1, -(-c.queries // group_rows))) for c in cells], "size int, cell int, blocks int, groups int")
    settled = settled.join(F.broadcast(layout), ["size", "cell"])
    data = settled.select("size", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "vec")
    queries = settled.where("query").select("size", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int").alias("group"), F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(chunks)).cast("int"))

    def matrix(column: pd.Series, size: int) -> np.ndarray:
        return unpacked(pa.array(column, pa.binary()), "<i8")[0].reshape(len(column), size)

    def found(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        size = int(key[0])
        right = right.drop_duplicates(["query_id", "query_vec"])
        place, ids, scores = search(right["query_id"].to_numpy(), matrix(right["query_vec"], size), right["least"].to_numpy(float), left["id"].to_numpy(), matrix(left["vec"], size), k)
        return pd.DataFrame({"query_id": right["query_id"].to_numpy()[place], "query_vec": right["query_vec"].to_numpy()[place], "vec_id": ids, "score": scores})

    by, schema = ["size", "cell", "block", "chunk"], "query_id long, query_vec binary, vec_id long, score long"
    chunk_list = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))

    def meet(data: DataFrame, queries: DataFrame) -> DataFrame:
        data = data.select(F.col("size").alias("of"), F.col("cell").alias("at"), F.col("block").alias("part"), "id", "vec", chunk_list.alias("turn"))
        return data.groupBy("of", "at", "part", "turn").cogroup(queries.groupBy(*by)).applyInPandas(found, schema)

    # the first block of a query's own cell gives its kth score so far
    seeds = meet(data.where("block = 0"), queries.select("size", "cell", F.lit(0).alias("block"), "chunk", "query_id", "query_vec", F.lit(float("-inf")).alias("least")))
    seeds = seeds.groupBy("query_id", "query_vec").agg(F.when(F.count("*") == k, F.min("score")).cast("double").alias("least"))
    queries = kept(queries.join(seeds, ["query_id", "query_vec"], "left").fillna(float("-inf"), ["least"]), "queries")
    groups = queries.groupBy("size", "cell", "group").agg(F.min("least").alias("worst"))
    reach = []
    for c in (c for c in cells if c.queries):
        for o in (o for o in cells if o.size == c.size):
            a, b = (pivots.get(c.size, np.zeros((1, c.size)))[i] for i in (c.cell, o.cell))
            reach.append((c.size, c.cell, o.cell, bound(Node(a, c.query_far, a, float(np.linalg.norm(a))), Node(b, o.far, b, float(np.linalg.norm(b)))), -(-o.n // block_rows)))
    reach = spark.createDataFrame(reach, "size int, cell int, other int, most double, blocks int")
    pairs = groups.join(F.broadcast(reach), ["size", "cell"]).where("most >= worst").select("size", "cell", "group", "other", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    sent = queries.join(pairs, ["size", "cell", "group"]).select("size", F.col("other").alias("cell"), "block", "chunk", "query_id", "query_vec", "least")
    order = Window.partitionBy("query_id", "query_vec").orderBy(F.col("score").desc(), "vec_id")
    return meet(data, sent).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

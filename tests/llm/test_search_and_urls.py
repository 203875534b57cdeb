"""URL rules, exact and approximate search."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import collision_ann, cover_tree, url_filter
from hearthline.llm.queries import QUERIES, URL_RULES

URLS = [
    (1, "http://www.Example.ORG/en/12?q=/es/"), (2, "https://example.org/es/"), (3, "ftp://x.example.org"), (4, None), (5, ""), (6, "no scheme.org/es/"),
    (7, "http://com/fr/a#b"), (8, "http://a.b.com/de/"), (8, "http://a.b.com/de/"), (9, "x://notexample.org/es/1"), (None, "http://example.org/en/1"),
    (10, "http://a.com:80/fr/"), (11, "http:///fr/"), (12, "a://b://c.com/fr/"), (13, "http://example.org/" + "z" * 5000), (14, "http://ÄB.com/fr/é\n/x"),
]


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path, _ = re.fullmatch(r"([^/?#]*)([^?#]*)(.*)", rest, re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else default)


@pytest.mark.parametrize("limit", [100_000, 0])  # broadcast rules, and shuffled ones
def test_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    urls = spark.createDataFrame(URLS, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("short", F.lit("x"))
    rules = spark.createDataFrame([*URL_RULES, URL_RULES[0], (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    got = sorted(map(repr, map(tuple, url_filter.judge_urls(urls, rules, ["page_id"]).collect())))
    assert got == sorted(repr((i, *judge(u, URL_RULES))) for i, u in URLS)


def test_urls_without_rules_or_rows(spark):
    urls = spark.createDataFrame(URLS, "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in url_filter.judge_urls(urls, none, ["page_id"], default="block").collect()} == {"block"}
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert url_filter.judge_urls(urls.limit(0), rules, ["page_id"]).count() == 0


def test_equal_rules_block(spark):
    urls = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    rules = spark.createDataFrame([("a.b", "/", "allow"), ("a.b", "/", "block")], "host string, path string, verdict string")
    assert url_filter.judge_urls(urls, rules, ["page_id"]).first().verdict == "block"


def best(rows, is_query, k):
    out = []
    for i, v in rows:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


def test_exact_topk_with_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [int(x) for x in rng.integers(-3, 4, 5)]) for i in range(300)] + [(1000 + i, [1, 2]) for i in range(4)] + [(2000, [2**40, 2**40])]
    odd = [(None, [1, 2]), (5000, None), (5001, [1, None])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<long>").withColumn("cell", F.lit(1)).withColumn("vec", F.lit("x"))
    query = F.col("vec_id") % 20 == 0
    for kind in ({}, {"block_rows": 40, "group_rows": 3, "chunk_rows": 7}):
        got = sorted(map(tuple, cover_tree.exact_topk(df, query, 4, **kind).collect()))
        assert got == best(rows, lambda i: i % 20 == 0, 4)
    assert cover_tree.exact_topk(df.limit(0), query, 4).count() == 0
    assert cover_tree.exact_topk(df, F.lit(False), 4).count() == 0


def test_large_products_saturate():
    big = np.array([[2**62, 2**62]])
    assert cover_tree.products(big, big).tolist() == [[2**63 - 1]] and cover_tree.products(-big, big).tolist() == [[-(2**63)]]
    assert cover_tree.products(np.array([[3, 4]]), np.array([[5, 6]])).tolist() == [[39]]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 6)), rng.normal(size=(300, 6)) * 3
    a, b = cover_tree.cover_tree(x), cover_tree.cover_tree(y)
    todo, seen = [(a, b)], 0
    while todo:
        p, q = todo.pop()
        assert cover_tree.bound(p, q) >= (x[p.at] @ y[q.at].T).max()
        assert all(np.linalg.norm(x[p.at] - p.center, axis=1) <= p.radius + 1e-9)
        seen += 1
        todo += [(c, d) for c in p.children for d in q.children]
    assert seen > 1


def test_approximate_search_recall(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op3_collision_counting"](spark, folder).toPandas()
    data = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x, ids = np.array(data["embedding"].tolist(), float), data["vec_id"].to_numpy()
    hits = []
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        true = ids[np.lexsort((ids, -score))[:20]]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], [score[ids == v][0] for v in mine["vec_id"]], rtol=0, atol=1e-12)
        hits.append(len(set(true) & set(mine["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9


def test_approximate_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 9.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, None), (8, [None, 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("x"))
    got = sorted(map(tuple, collision_ann.near_topk(df, F.col("vec_id") == 0, 20).collect()))
    assert got == [(0, 1, 1, 2.0), (0, 2, 3, 2.0), (0, 3, 2, 0.5)]
    assert collision_ann.near_topk(df.limit(0), F.lit(True), 20).count() == 0
    blocks = collision_ann.near_topk(df, F.col("vec_id") == 0, 1, block_rows=1, chunk_rows=1)
    assert [tuple(r) for r in blocks.collect()] == [(0, 1, 1, 2.0)]


def test_approximate_search_repeated_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 9.0])], "vec_id long, embedding array<double>")
    got = lambda k: sorted(map(tuple, collision_ann.near_topk(df, F.col("vec_id") == 0, k).collect()))
    assert got(20) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 1, 1.0), (0, 4, 2, 0.5)]
    assert got(2) == [(0, 1, 1, 1.0), (0, 2, 1, 1.0)]

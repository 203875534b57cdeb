"""The Merkle manifest against a plain version."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.llm import merkle, queries


def h(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    out = []
    for row in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(row[a:i]), "".join(row[i + 1 : a + 8])))
        i //= 8
    return out


def plain(rows):
    """[(doc_id, source, lang, n_chars, text)] -> the sorted results."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    trees = {}
    for r in rows:
        i, source, lang, n, text = r
        leaf = h("".join(map(field, r)))
        hit = zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 0
        claimed = h("".join(map(field, (i, source, lang, n, text and text.translate(lower))))) if hit else leaf
        trees.setdefault(lang, []).append(((i is not None, i or 0, leaf), i, leaf, claimed))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in order:
        trees[lang].sort(key=lambda x: x[0])
        made[lang] = levels_of([x[2] for x in trees[lang]])
    top = levels_of([made[lang][-1][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for j, (_, i, leaf, claimed) in enumerate(trees[lang]):
            way, now = path(made[lang], j) + path(top, k), claimed
            for a, b in way:
                now = h(a + now + b)
            out.append((repr(i), leaf, made[lang][-1][0], top[-1][0], h("".join(a + b for a, b in way)), now, now == top[-1][0]))
    return sorted(out)


def rows_of(df):
    return sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def proved(docs):
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    return merkle.prove_documents(docs, tampered)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_every_node_has_its_own_place(levels):
    places = [merkle.address(levels, d, np.arange(8**d)) for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range(merkle.size(levels)))


def test_van_emde_boas_order_by_hand():
    """Four levels: two upper ones (9 nodes), then 64 lower trees of two levels, 9 nodes each."""
    assert merkle.address(4, 0, np.array([0])).tolist() == [0]
    assert merkle.address(4, 1, np.array([0, 7])).tolist() == [1, 8]
    assert merkle.address(4, 2, np.array([0, 1, 63])).tolist() == [9, 18, 9 + 63 * 9]
    assert merkle.address(4, 3, np.array([0, 7, 8])).tolist() == [10, 17, 19]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 700))
def test_blocks_hold_the_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels, high = levels_of(leaves), merkle.height(n)
    nodes = merkle.laid(leaves, high)
    assert high == len(levels) - 1 and nodes[0].tobytes().hex() == levels[-1][0]
    paths = merkle.sibling_paths(nodes, high, n, ["x", "y"])
    for i in (0, n // 2, n - 1):
        assert paths[i] == [s for ab in path(levels, i) for s in ab] + ["x", "y"]
        assert merkle.folded(leaves[i], paths[i][:-2]) == levels[-1][0]


def test_odd_documents(odd_documents, no_documents):
    docs = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_documents.collect()]
    assert rows_of(proved(odd_documents)) == plain(docs)
    assert rows_of(proved(odd_documents.withColumn("lang", F.lit(None).cast("string")))) == plain([(i, s, None, n, t) for i, s, _, n, t in docs])
    assert rows_of(proved(odd_documents.limit(1))) == plain([tuple(odd_documents.select("doc_id", "source", "lang", "n_chars", "text").limit(1).first())])
    assert proved(no_documents).count() == 0 and "verified" in proved(no_documents).columns


def test_trees_of_several_levels_of_blocks(spark):
    """4097 leaves need a second level; many trees need one on top."""
    docs = spark.range(4097).selectExpr("id AS doc_id", "cast(null AS string) AS source", "'a' AS lang", "3L AS n_chars", "concat('Text ', id % 50) AS text")
    more = spark.range(40).selectExpr("id AS doc_id", "'s' AS source", "concat('tree', id) AS lang", "0L AS n_chars", "'' AS text")
    docs = docs.unionByName(more).unionByName(docs.where("doc_id = 7"))
    assert rows_of(proved(docs)) == plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = rows_of(queries.op12_merkle_manifest(spark, folder))
    assert got == plain([tuple(r) for r in docs.collect()]) and {r[-1] for r in got} == {True, False}

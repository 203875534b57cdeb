"""Periodic runs against a plain search over all periods."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthline.llm import periodic_runs as P
from hearthline.llm import queries
from hearthline.llm.words import Splitter

SPACES = b" \t\n\x0b\x0c\r"


def plain(w, least=4, words=6):
    """{(start, period, length)}: for every period the stretches of links, each with its smallest period alone."""
    found = {}
    for p in range(1, len(w) // least + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(words, least * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((a, p, n) for (a, n), p in found.items())


def collapse(w, runs):
    gone = {i for a, p, n in runs for i in range(a + p, a + n)}
    return sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()


def split(text):
    return (text or "").encode().split()


def planted(w, doc_id):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def together(w, tile, least=4, words=6):
    """Runs by way of tiles and stitching, without Spark."""
    codes = np.unique(np.array(w), return_inverse=True)[1].astype(np.int64)
    pieces = []
    for low, high, core, stop, a, b in P.cut(len(w), least, tile):
        one = [np.array([v]) for v in (a, len(w), core, stop, low, high)]
        _, period, start, end = P.fragments(P.Tiles(codes[a:b], np.array([0, b - a]), *one), Splitter(), least, words)
        pieces += zip(period.tolist(), start.tolist(), end.tolist())
    runs, last = {}, None
    for p, a, e in [*sorted(pieces), (-1, 0, 0)]:
        if last and last[0] == p and a <= last[2]:
            last[2] = max(last[2], e)
            continue
        if last and last[2] - last[1] + last[0] >= max(words, least * last[0]):
            key = (last[1], last[2] - last[1] + last[0])
            runs[key] = min(runs.get(key, last[0]), last[0])
        last = [p, a, e]
    return sorted((a, p, n) for (a, n), p in runs.items())


texts = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=12).map(lambda parts: [x for word, k in parts for x in word * k])


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from([16, 32, 64, 1000]))
def test_tiles_find_what_a_plain_search_finds(w, tile):
    assert together(w, tile) == plain(w)


@settings(max_examples=100, deadline=None)
@given(texts, st.sampled_from([16, 64]))
def test_other_limits(w, tile):
    assert together(w, tile, 3, 2) == plain(w, 3, 2)


def test_long_periods_and_smallest_periods():
    rng = np.random.default_rng(0)
    block = rng.integers(0, 1000, 700).tolist()
    w = [1, 2, 3] + block * 5 + block[:100] + [9] * 40 + [4, 5, 4, 5] * 10
    want = plain(w)
    assert [(p, n) for _, p, n in want if p == 700] == [(700, 3600)] and any(p == 2 for _, p, _ in want)
    assert all(together(w, tile) == want for tile in (16, 100, 512, 10_000))


def results(df):
    return sorted((repr(r.doc_id), r.hl_words, [tuple(x) for x in r.hl_runs], r.hl_digest) for r in df.collect())


def expected(rows):
    out = []
    for r in rows:
        w = split(r.text)
        runs = plain(w)
        out.append((repr(r.doc_id), len(w), runs, collapse(w, runs)))
    return sorted(out)


@pytest.mark.parametrize("tile", [16, 1 << 14])
def test_odd_documents(spark, odd_documents, no_documents, tile):
    small = odd_documents.where("doc_id is null or doc_id <> 10")
    extra = [(100 + i, t, "en", "s", 1) for i, t in enumerate(["a b " * 40, "x " + "q r s\t" * 9 + "é é é é é é é", "A a " * 3, "z" + "\x85" * 9, "ja ja ja ja ja"])]
    more = spark.createDataFrame(extra, no_documents.schema)
    docs = small.select(*no_documents.columns).unionByName(more)
    assert results(P.find_runs(docs, ["doc_id"], tile=tile)) == expected(docs.collect())
    assert sorted(results(P.find_runs(small, small.columns, tile=tile))) == expected(small.collect())
    assert P.find_runs(no_documents, ["doc_id"]).count() == 0


def test_very_long_texts_go_out_in_tiles(spark):
    """30,000 equal words, a text of one long period, and one without any."""
    rng = np.random.default_rng(3)
    block = [f"w{x}" for x in rng.integers(0, 5000, 6000)]
    rows = [(1, "a " * 30_000), (2, "start " + " ".join(block * 5)), (3, " ".join(f"u{i}" for i in range(40_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.hl_runs] for r in P.find_runs(docs, ["doc_id"]).collect()}
    assert got[1] == [(0, 1, 30_000)] and (1, 6000, 30_000) in got[2] and got[3] == []


def test_fewer_periods_are_refused(no_documents):
    with pytest.raises(ValueError):
        P.find_runs(no_documents, ["doc_id"], least=2)


def by_contract(rows):
    out = []
    for r in rows:
        w = planted(split(r.text), r.doc_id)
        runs = plain(w)
        best = min(runs, key=lambda x: (-x[2] / x[1], x[0], x[1]), default=None)
        text = "".join(f"{a},{n},{p}\n" for a, p, n in runs)
        place = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        out.append((repr(r.doc_id), len(runs), *place, sha256(text.encode()).hexdigest(), collapse(w, runs)))
    return sorted(out)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted((repr(r[0]), *r[1:]) for r in queries.op13_periodic_runs(spark, folder).collect())
    assert got == by_contract(spark.read.parquet(f"{folder}/documents.parquet").collect())
    assert sum(r[1] > 0 for r in got) >= 15


def test_planting_and_digests_of_odd_documents(spark, odd_documents, tmp_path):
    docs = odd_documents.where("doc_id is null or doc_id <> 10")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((repr(r[0]), *r[1:]) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == by_contract(docs.collect())

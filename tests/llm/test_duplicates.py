"""Near-duplicate documents and lines against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthline.llm import line_dedup, ngram_join
from hearthline.llm.components import components

UPPER = {65 + i: 97 + i for i in range(26)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(UPPER))


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near(rows, threshold=0.8):
    """doc_id, class_id and number of links of each row, over all pairs."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    of = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(map(repr, ((doc_id, of[root(i)], links[i]) for i, (doc_id, _) in enumerate(rows))))


def got(df):
    return sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in df.collect())


def test_odd_documents(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    out = ngram_join.near_duplicates(odd_documents)
    assert got(out) == near(rows)
    assert ngram_join.near_duplicates(no_documents).count() == 0


def edited(rng, base, n):
    w = list(base)
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.random()}"
    return " ".join(w)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(4)
    bases = [[f"w{b}x{i}" for i in range(150)] for b in range(4)]
    rows = [(i, edited(rng, bases[i % 4], rng.choice([0, 1, 2, 3, 5, 9]))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.near_duplicates(df)) == near(rows)


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    values, row = np.concatenate(sets), np.repeat(np.arange(20), [len(s) for s in sets])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.intersections(values, row, 20).tolist() == want


def test_posterior_keeps_pairs_at_the_threshold():
    need = ngram_join.least_matches(0.8, 1e-9)
    rng = np.random.default_rng(5)
    matches = rng.random((20_000, ngram_join.HASHES)) < 0.8
    for n in range(ngram_join.STEP, ngram_join.HASHES + 1, ngram_join.STEP):
        assert (matches[:, :n].sum(1) >= need[n]).all()
    assert need[ngram_join.HASHES] > 60  # pairs at a similarity of about a half go


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((n, root(n)) for n in up)


def without_repeats(rows, threshold=0.8):
    """The texts, and how many lines with words each had and lost."""
    order = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1] or 0))
    lines = [(none, i, k, frozenset(words(x)), t) for none, i, t in order for k, x in enumerate(t.split("\n")) if words(x)]
    lines.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    gone, before = set(), []
    for none, i, k, w, t in lines:
        if any(len(w & v) >= threshold * len(w | v) - 1e-9 for v in before):
            gone.add((i, t, k))
        before.append(w)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        lost = sum((i, t, k) in gone for k in range(len(parts)))
        filled = sum(bool(words(x)) for x in parts)
        left = "\n".join(x for k, x in enumerate(parts) if (i, t, k) not in gone)
        out.append((i, None if t is None else "" if filled and lost == filled else left, filled, lost))
    return sorted(map(repr, out))


def cut(df):
    return sorted(repr((r.doc_id, r.text, r.hl_lines, r.hl_removed)) for r in df.collect())


def test_lines_of_odd_documents(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    out = line_dedup.dedup_lines(odd_documents)
    assert out.columns == [*odd_documents.columns, "hl_lines", "hl_removed"]
    assert cut(out) == without_repeats(rows)
    assert line_dedup.dedup_lines(no_documents).count() == 0


@pytest.mark.parametrize("hot,keep,threshold", [(1024, 32, 0.8), (2, 1, 0.8), (2, 1, 0.4), (2, 1, 0.5), (20, 2, 0.5)])
def test_lines_against_all_pairs(spark, monkeypatch, hot, keep, threshold):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "KEEP", keep)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(rng.choices(vocabulary[: rng.choice([4, 12, 40])], k=rng.randrange(0, 14))) for _ in range(rng.randrange(0, 6)))
        rows.append((i, text))
    long = [f"v{i}" for i in range(400)]
    rows += [(100 + i, " ".join(rng.sample(long, 330 + 7 * i))) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("numbers", F.lit(1))
    assert cut(line_dedup.dedup_lines(df, threshold=threshold)) == without_repeats(rows, threshold)


def test_one_word_matches_two_at_half(spark):
    df = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "gamma")], "doc_id long, text string")
    assert [r.text for r in line_dedup.dedup_lines(df, threshold=0.5).orderBy("doc_id").collect()] == ["alpha", "", "gamma"]


def test_lines_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7, "x", "y"), (2, "a b c d e", 8, "z", None)], "doc_id long, text string, HL_lines int, hl_numbers string, hl_of string")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "hl_numbers", "hl_of", "hl_lines", "hl_removed"]
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "a b c d e", "x", "y", 1, 0), (2, "", "z", None, 1, 1)]


def test_pair_met_under_few_keys():
    """Two long near copies of hot words come under few of their many shared keys for the first time."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.choice(1 << 44, 240, replace=False).astype(np.uint64)
    other = base.copy()
    other[[3, 90, 200]] = rng.choice(1 << 44, 3, replace=False).astype(np.uint64)
    sets = [np.sort(base), np.sort(other)]
    ptr = np.array([0, 240, 480])
    lines = line_dedup.Lines(np.arange(2), np.zeros(2, np.int64), ptr, np.concatenate(sets), np.repeat([0, 1], 240))
    own = line_dedup.keys(lines, np.full(line_dedup.CELLS, 5000, np.int64), 0.8)
    at = [{int(own.key[j]): (own.before[j], own.between[j]) for j in np.flatnonzero(own.line == i)} for i in (0, 1)]
    shared = at[0].keys() & at[1].keys()
    first = [k for k in shared if all(x != y or not y for x, y in zip(at[0][k], at[1][k]))]
    assert len(shared) > 500 and 1 <= len(first) <= 16


def test_candidates_of_many_near_copies(spark):
    """Of a large group of near copies each line hands on few of the earlier ones, not two dozen under each key."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, edited(rng, base, rng.choice([1, 2, 3]))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = np.full(line_dedup.CELLS, 500, np.int64)
    pairs = line_dedup.candidates(line_dedup.indexed(df, counts, 0.8, 4), 0.8, line_dedup.KEEP)
    assert pairs.count() < 10 * len(rows)
    assert cut(line_dedup.dedup_lines(df)) == without_repeats(rows)


def test_chances():
    """The chance that no more words differ, by patterns of random sets."""
    rng = np.random.default_rng(3)
    words = rng.integers(1, 33, 200_000)
    odd = np.array([np.count_nonzero(np.bincount(rng.integers(0, line_dedup.PATTERN, n), minlength=line_dedup.PATTERN) & 1) for n in words[:60_000]])
    for apart, most in ((6, 8), (10, 12), (12, 12)):
        own = words[:60_000][odd == apart]
        assert abs((own <= most).mean() - line_dedup.chances()[apart, most]) < 0.05


def test_lines_of_one_task_enter_once(spark):
    """Copies met again in a task are not sent, unless they stand earlier."""
    earliest = {}
    first = next(line_dedup.lines_of(pa.array(["a b c\nd e f\nA b c"]), line_dedup.Splitter()))
    assert line_dedup.new_lines(first, np.array([7]), earliest).tolist() == [0, 1]
    again = next(line_dedup.lines_of(pa.array(["a b c", "x y z\nd e f"]), line_dedup.Splitter()))
    assert line_dedup.new_lines(again, np.array([8, 3]), earliest).tolist() == [1, 2]


def test_open_lines_by_candidates_kept(spark, monkeypatch):
    """Lines that their first candidate leaves open are settled by the further ones kept, without a pass over all lines."""
    unfolded, seen = line_dedup.unfolded, []

    def counted(held):
        seen.append(held.count())
        return unfolded(held)

    monkeypatch.setattr(line_dedup, "KEEP", 1)
    monkeypatch.setattr(line_dedup, "SURE", 1e-300)
    monkeypatch.setattr(line_dedup, "unfolded", counted)
    monkeypatch.setattr(line_dedup, "earlier_matches", None)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, edited(rng, base, rng.choice([2, 4, 5]))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cut(line_dedup.dedup_lines(df)) == without_repeats(rows)
    assert seen and seen[0] > 0

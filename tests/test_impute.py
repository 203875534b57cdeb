import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import impute as I


@pytest.fixture(scope="module")
def holed(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        y = 3 * x + float(rng.normal()) * 0.1
        g = "hi" if x > 0 else "lo"
        rows.append((i, x, None if i % 4 == 0 else y, None if i % 6 == 1 else g, f"extra{i}"))
    return spark.createDataFrame(rows, "id int, x double, y double, g string, note string")


@pytest.mark.parametrize("method", ["pmm", "rf"])
@pytest.mark.parametrize("limit", ["1000000", "50"])
def test_chained_imputation(spark, holed, method, limit):
    spark.conf.set("spark.hearthline.hotRows", limit)
    if method == "pmm":
        out = I.impute_mice_pmm(holed, "id", ["x", "y", "g"], m=2, maxit=1)
    else:
        out = I.impute_mice_rf(holed, "id", ["x", "y", "g"], m=2, maxit=1)
    rows = out.collect()
    spark.conf.unset("spark.hearthline.hotRows")
    assert len(rows) == 800 and out.columns == [*holed.columns, "imp"]
    before = {r.id: r for r in holed.collect()}
    seen_y = {r.y for r in before.values()} - {None}
    for r in rows:
        old = before[r.id]
        assert r.x == old.x and r.note == old.note
        assert r.y == old.y if old.y is not None else r.y in seen_y
        assert r.g == old.g if old.g is not None else r.g in ("hi", "lo")
    filled = [(r.x, r.y) for r in rows if before[r.id].y is None]
    assert np.corrcoef(*zip(*filled))[0, 1] > (0.9 if method == "pmm" else 0.6)  # leaves are coarse
    right = np.mean([r.g == ("hi" if r.x > 0 else "lo") for r in rows if before[r.id].g is None])
    assert right > 0.8
    assert {r.imp for r in I.complete(out, 1).withColumn("imp", F.lit(1)).collect()} == {1}


@pytest.mark.parametrize("parts, n, step", [(1, 200, 0.1), (4, 200, 0.1), (9, 60, 0.1), (40, 30, 0.1), (5, 300, 10.0), (6, 400, 0.001)])
def test_donors_are_the_nearest(spark, parts, n, step):
    """Whatever the ranges, also such that hold fewer than five donors or none, and with many equal predictions."""
    rng = np.random.default_rng(parts)
    rows = [(k, i, None if rng.random() < (0.8 if n < 100 else 0.3) else float(1000 * k + i), float(np.round(rng.normal() / step) * step)) for k in (1, 2) for i in range(n)]
    rows += [(k, n, 1000.0 * k + n, 0.0) for k in (1, 2)]
    df = spark.createDataFrame(rows, "__copy int, id long, v double, __hat double").selectExpr(
        "*", "xxhash64(id, 5) AS __tie", "pmod(xxhash64(id, 6), 1 << 20) AS __turn", "v IS NOT NULL OR id % 2 = 0 AS __own", "v IS NOT NULL AS __known")
    got = {(r["__copy"], r.id): r.v for r in I.nearest_match(df, "v", 5, parts).collect()}
    hats = {(k, i): h for k, i, _, h in rows}
    assert set(got) == {(k, i) for k, i, v, _ in rows if v is not None or i % 2 == 0}
    for k, i, v, hat in rows:
        if v is not None:
            assert got[k, i] == v
        elif (k, i) in got:
            gaps = sorted(abs(hats[k, j] - hat) for q, j, w, _ in rows if q == k and w is not None)
            donor = int(got[k, i]) - 1000 * k
            assert 0 <= donor <= n and abs(hats[k, donor] - hat) <= gaps[min(4, len(gaps) - 1)] + 1e-12


def test_ranges_are_cut_by_few_predictions(spark, monkeypatch):
    """Where ranges are cut is read off a part of the rows, and the donors are the same wherever that is."""
    rng = np.random.default_rng(4)
    rows = [(k, i, None if i % 3 == 0 else float(1000 * k + i), float(np.round(rng.normal(), 1))) for k in (1, 2) for i in range(900)]
    df = spark.createDataFrame(rows, "__copy int, id long, v double, __hat double").selectExpr(
        "*", "xxhash64(id, 5) AS __tie", "pmod(xxhash64(id, 6), 1 << 20) AS __turn", "true AS __own", "v IS NOT NULL AS __known")
    more = df.where("__copy = 1 AND __known").selectExpr("array(__hat, __hat + 1) AS __hats", "array(__tie, __tie) AS __ties", "v + 5000 AS v")
    seen, bounds = [], I._bounds
    monkeypatch.setattr(I, "_bounds", lambda hats, parts: seen.append(hats.count()) or bounds(hats, parts))
    got = [sorted((r["__copy"], r.id, r.v) for r in I.nearest_match(df, "v", 5, 6, more, every).collect()) for every in (1, 8)]
    assert got[0] == got[1] and len(got[0]) == 1800
    assert seen[0] == 3000 and 200 < seen[1] < 600


def test_all_near_donors_are_drawn(spark):
    """Of five equally far donors and many takers each is taken about as often."""
    rows = [(1, i, None if i >= 5 else float(i), 0.0) for i in range(1005)]
    df = spark.createDataFrame(rows, "__copy int, id long, v double, __hat double").selectExpr(
        "*", "xxhash64(id, 5) AS __tie", "pmod(xxhash64(id, 6), 1 << 20) AS __turn", "true AS __own", "v IS NOT NULL AS __known")
    taken = np.bincount([int(r.v) for r in I.nearest_match(df, "v", 5, 3).collect() if r.id >= 5], minlength=5)
    assert taken.sum() == 1000 and taken.min() > 140


def test_simple_fills(spark):
    df = spark.createDataFrame([(1, 2.0, True), (2, None, True), (3, None, False), (4, 4.0, False)], "id int, x double, f boolean")
    assert [r.x for r in I.fill_median(df, "x", F.col("f")).orderBy("id").collect()] == [2.0, 3.0, 0.0, 4.0]
    assert [r.x for r in I.fill_constant(df, {"x": 1960.0}).orderBy("id").collect()] == [2.0, 1960.0, 1960.0, 4.0]


def test_column_without_any_value_stays_missing(spark):
    from hearthline.operators import impute

    df = spark.createDataFrame([(i, float(i % 7) if i % 3 else None, None) for i in range(60)], "id long, x double, y double")
    out = impute.impute_mice_pmm(df, "id", ["x", "y"], m=1, maxit=1).collect()
    assert len(out) == 60 and all(r["x"] is not None and r["y"] is None for r in out)


def test_queries_run_all_rounds(spark, monkeypatch):
    from hearthline.catalog import models

    rounds = []
    monkeypatch.setattr(I, "_pmm_step", lambda state, *_: rounds.append(state.select("__copy").distinct().count()) or state)
    models.impute_pmm(spark, "/root/testdata/sf0.001")
    assert rounds == [5] * 5 * 3
    monkeypatch.setattr(I, "impute_forest", lambda base, id_col, cols, incomplete, levels, maxit, *_: rounds.append(maxit) or base.select(id_col, *incomplete))
    models.impute_rf(spark, "/root/testdata/sf0.001")
    assert rounds[15:] == [30]


def test_a_step_writes_only_rows_with_holes(spark, holed, monkeypatch):
    written = []
    for name in ("stable", "stored"):
        monkeypatch.setattr(I, name, lambda df, keep=getattr(I, name): written.append(keep(df)) or written[-1])
    out = I.impute_mice_pmm(holed, "id", ["x", "y", "g"], m=2, maxit=1)
    open_rows = holed.filter("y is null or g is null").count()
    assert [w.count() for w in written] == [400, *[2 * open_rows] * 3] and out.count() == 800


def test_more_terms_than_are_summed_by_expressions(spark):
    """Products of wide rows are summed in blocks, to the same matrix."""
    from hearthline.operators import models

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 14))
    df = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(x)], "k int, " + ", ".join(f"x{i} double" for i in range(14)))
    for p in (5, 14):
        center = rng.normal(size=p)
        got = models.cross_products(df, [F.col(f"x{i}") for i in range(p)], center, F.col("k"))
        for k in range(3):
            z = np.column_stack([np.ones(100), x[k::3, :p] - center])
            assert np.allclose(got[k], z.T @ z)
        n, means, s = models.moment_matrix(df, [f"x{i}" for i in range(p)])
        assert n == 300 and np.allclose(means, x[:, :p].mean(0)) and np.allclose(s, np.cov(x[:, :p].T, bias=True))


# --- the forest -----------------------------------------------------------------------------


def plan_of(widths, levels, trees=3, depth=3, target=0):
    from hearthline.operators import forest as W

    cols = [W.Column_(f"c{i}", w, [str(j) for j in range(w)] if lv else None, [] if lv else list(range(1, w))) for i, (w, lv) in enumerate(zip(widths, levels))]
    return W.Plan(cols, [target], [np.zeros(1, np.int64)], trees, depth)


@pytest.mark.parametrize("labels", [False, True])
def test_splits_are_the_best_there_are(labels):
    """One tree over one number and one label, against a search over all cuts and, for two classes or a number, all subsets of levels."""
    from itertools import combinations

    from hearthline.operators import forest as W

    rng = np.random.default_rng(4)
    plan = plan_of([2 if labels else 1, 6, 4], [labels, False, True], trees=1, depth=1)
    n = 120
    bins = np.array([np.zeros(n), rng.integers(0, 6, n), rng.integers(0, 4, n)]).astype(np.uint16)
    y = (rng.random(n) < 0.2 + 0.15 * bins[2]).astype(float) if labels else bins[1] + rng.normal(size=n)
    own = W.Block(bins, y[None], np.ones((1, n), bool), np.arange(n, dtype=np.int32)[None])
    w = W._weights(7, 0, 0, n)
    tree = W.Trees.empty(plan)
    W.split(tree, W.histogram(0, own, bins, plan, 0, tree, 0, 7), plan, 0, 0, 7)

    def lost(rows):
        s, v = w[rows].sum(), y[rows]
        if not s:
            return 0
        mean = (w[rows] * v).sum() / s
        return 2 * s * mean * (1 - mean) if labels else (w[rows] * (v - mean) ** 2).sum()

    tried = W._tried(plan, 0, 7, 0)[0, 0]
    masks = {1: [range(k) for k in range(1, 6)], 2: [s for k in (1, 2, 3) for s in combinations(range(4), k)]}
    best = min(lost(np.isin(bins[c], m)) + lost(~np.isin(bins[c], m)) for c in tried for m in map(list, masks[c]))
    left = tree.left[0, 0][bins[tree.by[0, 0]]]
    assert lost(left) + lost(~left) == pytest.approx(best)


def test_donors_share_a_leaf_or_the_next_node_up():
    from hearthline.operators import forest as W

    plan = plan_of([1, 4], [False, False], trees=2, depth=2)
    trees = W.Trees.empty(plan)
    for t, first in enumerate((2, 1)):
        trees.by[t, 0], trees.left[t, 0, :first] = 1, True
    bins = np.array([[0] * 8, [0, 0, 1, 2, 3, 3, 1, 0]], np.uint16)
    known = np.array([[1, 1, 0, 1, 1, 0, 0, 0]], bool)
    own = W.Block(bins, np.arange(8.0)[None], known, np.arange(8, dtype=np.int32)[None])
    draws = np.array([W.drawn(own, bins, plan, 0, trees, 0, seed) for seed in range(4000)])
    # rows 2 and 6 have bin 1: with 0 and 1 in the first tree, with 3 and 4 in the second; 5 has 3 and 4 in both; 7 has 0 and 1
    assert [set(d) for d in draws.T] == [{0, 1, 3, 4}, {3, 4}, {0, 1, 3, 4}, {0, 1}]
    assert np.abs(np.bincount(draws[:, 0], minlength=5)[[0, 1, 3, 4]] - 1000).max() < 120
    lone = W.Block(bins, own.value, np.array([[0, 0, 0, 1, 1, 0, 0, 0]], bool), own.donor)
    assert set(W.drawn(lone, bins, plan, 0, trees, 0, 1)) <= {3, 4}
    none = W.Block(bins, own.value, np.zeros((1, 8), bool), own.donor)
    assert set(W.drawn(none, bins, plan, 0, trees, 0, 1)) == {-1}


@pytest.mark.parametrize("block_rows", [7, 100])
def test_forest_over_many_blocks(spark, monkeypatch, block_rows):
    """Many small blocks, some of them without a known row: all holes are filled with values of the column, ids and types stay."""
    from hearthline.operators import forest as W

    monkeypatch.setattr(W, "BLOCK_ROWS", block_rows)
    rows = [(f"id{i}", float(i % 10), None if i % 3 else (i % 10) * 100, None if i % 50 else i % 100 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, x double, y int, b boolean")
    out = {r.id: r for r in I.impute_mice_rf(df, "id", ["x", "y", "b"], maxit=2).collect()}
    assert len(out) == 400 and {type(r.y) for r in out.values()} == {int} and {type(r.b) for r in out.values()} == {bool}
    assert all(out[i].y == y for i, _, y, _ in rows if y is not None) and all(out[i].b == b for i, _, _, b in rows if b is not None)
    near = np.mean([abs(out[i].y - 100 * x) for i, x, y, _ in rows if y is None])
    assert block_rows == 7 or near < 250  # 330 if drawn at random; two known rows in a block are hardly better


@pytest.mark.parametrize("labels", [False, True])
def test_trees_from_combinations_are_those_grown_level_by_level(monkeypatch, labels):
    """one table of combinations of bins gives the same trees, leaves and donors as a histogram a level."""
    from hearthline.operators import forest as W

    rng = np.random.default_rng(11)
    plan = plan_of([3 if labels else 1, 6, 4, 3], [labels, False, True, False], trees=4, depth=4)
    n = 500
    bins = np.array([rng.integers(0, c.width, n) for c in plan.cols]).astype(np.uint8)
    known = rng.random(n) < 0.7
    y = bins[0].astype(float) if labels else bins[1] * 2.0 + rng.integers(0, 3, n)
    own = W.Block(bins, y[None], known[None], np.arange(n, dtype=np.int32)[None])
    trees = W.Trees.empty(plan)
    W.grow(trees, W.cell_sums(3, own, bins, plan, 0, 7), plan, 0, 7)
    donors = W.drawn(own, bins, plan, 0, trees, 3, 5)
    monkeypatch.setattr(W, "CELLS", 0)
    slow = W.Trees.empty(plan)
    for level in range(plan.depth):
        W.split(slow, W.histogram(3, own, bins, plan, 0, slow, level, 7), plan, 0, level, 7)
    assert (trees.by == slow.by).all() and (trees.left == slow.left).all() and (slow.by >= 0).sum() > 20
    assert (donors == W.drawn(own, bins, plan, 0, slow, 3, 5)).all()


def test_a_block_is_read_as_it_was(spark):
    """Holes, labels and numbers of a block come back from the short form in which it is written."""
    from hearthline.operators import forest as W

    df = spark.createDataFrame([(i, None if i % 3 == 0 else "abc"[i % 3], None if i % 4 == 0 else float(i), float(i)) for i in range(50)], "id long, g string, y double, x double")
    cols = W.bin_columns(df, ["g", "y", "x"], {"g": ["b", "c"]})
    row = W.dealt(df, "id", cols, [0, 1], 50).first().asDict()
    plan = W.Plan(cols, [0, 1], [], 1, 1)
    own = W.Block.read(row, plan)
    order = row["ids"]
    assert (own.known == [[i % 3 != 0 for i in order], [i % 4 != 0 for i in order]]).all()
    assert own.value[0][own.known[0]].tolist() == [i % 3 - 1 for i in order if i % 3] and own.value[1][own.known[1]].tolist() == [i for i in order if i % 4]
    own.donor[~own.known] = np.arange(-1, -1 - (~own.known).sum(), -1)
    again = W.Block.read(row | W._work_row(row, own, np.zeros(0)).to_pylist()[0], plan)
    assert (again.donor == own.donor).all() and (again.bins == own.bins).all()


@pytest.mark.parametrize("parts", [1, 6])
def test_donors_common_to_all_copies_travel_as_lists(spark, parts):
    """donors given once for all copies, in lists, are the donors that they are as rows of each copy; many predictions are equal."""
    df = spark.range(400).selectExpr("id", "concat('v', id) AS v", "id % 3 = 0 AS gone", "id % 3 = 1 AS whole", "double(id % 23) AS x").crossJoin(spark.range(1, 3).selectExpr("int(id) AS __copy"))
    rows = df.selectExpr("id", "__copy", "whole", "CASE WHEN gone THEN NULL ELSE v END AS v", "x * __copy AS __hat", "xxhash64(id, __copy, 5) AS __tie", "pmod(xxhash64(id, 6), 1 << 20) AS __turn", "NOT whole AS __own", "NOT gone AS __known")
    more = rows.filter("whole AND __copy = 1").selectExpr("v", "array(__hat, 2 * __hat) AS __hats", "array(__tie, xxhash64(id, 2, 5)) AS __ties")
    plain = I.nearest_match(rows, "v", 5, parts).select("id", "__copy", "v").collect()
    listed = I.nearest_match(rows.filter("NOT whole"), "v", 5, parts, more).select("id", "__copy", "v").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, listed)) and len(plain) == 534 and all(r.v for r in plain)

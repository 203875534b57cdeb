"""Tiled distances and what is computed from them, against plain versions on the whole matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sequences import people, plain_om

from hearthline.operators import sequences as Q, tiles as W


@pytest.fixture(scope="module")
def df(spark):
    from hearthline.session import stable

    return stable(people(spark, 90, 6))


@pytest.fixture(scope="module")
def costs(df):
    return Q.substitution_costs(df, "seq")


@pytest.fixture(scope="module", params=[7, 512])
def tiled(request, df, costs):
    return W.tiled_distances(df, "seq", costs, side=request.param)


def matrix(t):
    """(sequences in order of their numbers, n, distances)."""
    rows = t.rows.orderBy("i").collect()
    assert [r.i for r in rows] == list(range(len(rows)))
    number = {tuple(r.seq): r.i for r in rows}
    d = np.full((len(rows),) * 2, np.nan)
    for r in W.distance_table(t).collect():
        d[number[tuple(r.sequence)], number[tuple(r.reference)]] = r.distance
    return [tuple(r.seq) for r in rows], np.array([r.n for r in rows], float), d


def plain_lloyd(x, weight, k, seed, rounds=100):
    """From the k rows of the smallest seeded hashes; returns (clusters, cost)."""
    key = np.where(weight > 0, W._even(np.arange(len(x)), np.array([seed]), 1 << 20)[:, 0], 2.0)
    centers, old = x[np.argsort(key, kind="stable")[:k]], None
    alive = np.ones(k, bool)
    for _ in range(rounds):
        far = ((x[:, None] - centers[None]) ** 2).sum(2)
        far[:, ~alive] = np.inf
        best = far.min(1)
        member = (far <= (best + 1e-9 * (1 + best))[:, None]).argmax(1)
        if old is not None and (member == old)[weight > 0].all():
            break
        old = member
        alive = np.bincount(member, weight, k) > 0
        centers = np.array([np.average(x[member == c], axis=0, weights=weight[member == c]) if alive[c] else centers[c] for c in range(k)])
    return member, float(weight @ far[np.arange(len(x)), member])


def test_distances(tiled, costs):
    names, n, d = matrix(tiled)
    assert n.sum() == 90 and not np.isnan(d).any() and (d == d.T).all() and (np.diag(d) == 0).all()
    nested = {a: {b: costs[a, b] for a2, b in costs if a2 == a} for a, _ in costs}
    for i in range(0, len(names), 9):
        for j in range(0, len(names), 5):
            assert d[i, j] == pytest.approx(plain_om(names[i], names[j], nested, 1.0))


def test_sequences_of_several_lengths(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b", None, "a"]), (4, []), (5, ["a"])], "id int, seq array<string>")
    costs = Q.substitution_costs(df, "seq")
    for side in (2, 100):
        names, n, d = matrix(W.tiled_distances(df, "seq", costs, side=side))
        at = {x: i for i, x in enumerate(names)}
        assert d[at[()], at[("b", "*", "a")]] == 3 and d[at[("a",)], at[("a", "b")]] == 1 and n[at[("a",)]] == 2
    with_half = matrix(W.tiled_distances(df, "seq", costs, None))
    assert with_half[2].max() == 3 * max(costs.values()) / 2
    none = W.tiled_distances(df.limit(0), "seq", costs)
    assert none.blocks == 0 and W.distance_table(none).count() == 0 and W.kmeans_on_tiles(none).count() == 0


def test_kmeans_is_lloyds(tiled):
    names, n, d = matrix(tiled)
    x = d * np.sqrt(n)
    runs = [plain_lloyd(x, n, 3, 1 + i) for i in range(3)]
    want, _ = min(runs, key=lambda r: r[1])
    rows = W.kmeans_on_tiles(tiled, 3).collect()
    assert {tuple(r.seq): r.cluster for r in rows} == dict(zip(names, want.tolist())) and all(r.converged for r in rows)
    assert len({round(c, 6) for _, c in runs}) > 1 or len(runs) == 3


def test_choice_of_k(tiled):
    names, n, d = matrix(tiled)
    x = d * np.sqrt(n)
    rows = W.choose_k_on_tiles(tiled, k_max=4, references=2).orderBy("k").collect()
    for r in rows:
        member, cost = plain_lloyd(x, n, r.k, 1)
        assert r.wss == pytest.approx(cost) and r.converged
        if r.k == 1:
            assert r.silhouette is None
            continue
        person = np.repeat(np.arange(len(n)), n.astype(int))
        c, far, values = member[person], d[np.ix_(person, person)], []
        for i in range(len(person)):
            mean = [far[i, c == k].sum() / ((c == k).sum() - (k == c[i])) if (c == k).sum() > (k == c[i]) else np.nan for k in range(r.k)]
            own, other = mean[c[i]], np.nanmin([m for k, m in enumerate(mean) if k != c[i]])
            values.append(0.0 if np.isnan(own) or max(own, other) == 0 else (other - own) / max(own, other))
        assert r.silhouette == pytest.approx(np.mean(values), abs=1e-9)
    low, high = x.min(0), x.max(0)
    logs = {}
    for view in (1, 2):
        y = low + (high - low) * W._even(np.arange(len(n)), np.arange(len(n)), view)
        for k in range(1, 5):
            logs.setdefault(k, []).append(np.log(plain_lloyd(y, n, k, 1)[1]))
    for r in rows:
        assert r.gap == pytest.approx(np.mean(logs[r.k]) - np.log(r.wss)) and r.gap_se == pytest.approx(np.std(logs[r.k]) * np.sqrt(1.5))


def test_stability_is_a_loop_over_samples(tiled, df):
    names, n, d = matrix(tiled)
    x, number = d * np.sqrt(n), {s: i for i, s in enumerate(names)}
    drawn = df.select(Q._filled("seq").alias("s"), *[Q.poisson_draws([F.col("id")], 1 + b).alias(f"w{b}") for b in range(1, 4)]).collect()
    best = lambda weight, b: min((plain_lloyd(x, weight, 3, 1 + 1000 * b + i) for i in range(3)), key=lambda r: r[1])[0]
    base, found = best(n, 0), {0: [], 1: [], 2: []}
    for b in range(1, 4):
        weight, seen = np.zeros(len(n)), np.zeros(len(n))
        for r in drawn:
            weight[number[tuple(r.s)]] += r[f"w{b}"]
            seen[number[tuple(r.s)]] += r[f"w{b}"] > 0
        mine = best(weight, b)
        for c in range(3):
            if seen[base == c].sum():
                found[c].append(max(seen[(base == c) & (mine == k)].sum() / seen[(base == c) | (mine == k)].sum() for k in range(3) if seen[mine == k].sum()))
    for r in W.stability_on_tiles(tiled, df, ["id"], 3, boot=3).collect():
        own = np.array(found[r.cluster])
        assert r.mean_jaccard == pytest.approx(own.mean()) and (r.dissolved, r.recovered) == ((own < 0.5).sum(), (own > 0.7).sum())


def test_nothing_grows_with_the_sequences_but_tables(spark, costs, monkeypatch):
    """What comes to the driver in a clustering is as large for four times the sequences."""
    seen = {}
    for n in (40, 160):
        t = W.tiled_distances(people(spark, n, 8), "seq", Q.substitution_costs(people(spark, n, 8), "seq"), side=8)
        kept, sizes = W.summed, []
        monkeypatch.setattr(W, "summed", lambda *a, kept=kept, sizes=sizes: sizes.append(kept(*a)) or sizes[-1])
        W.kmeans_on_tiles(t, 3, max_iter=2)
        monkeypatch.setattr(W, "summed", kept)
        seen[n] = {len(s) for s in sizes}
    assert seen[40] == seen[160] and max(seen[40]) <= 15


def test_runs_at_rest_leave_the_passes(tiled, monkeypatch):
    """A run that has come to rest has no column in later products, and a round is two products without a pass for the centres' norms."""
    kept, widths = W.product, []
    monkeypatch.setattr(W, "product", lambda t, v, views, up: widths.append(max(x[2] for x in views)) or kept(t, v, views, up))
    fits = [W.Fit(1, 1), W.Fit(3, 1), W.Fit(3, 2)]
    base = W.prepared(tiled, ["n"], tiled.rows, 0)
    state = W.lloyd(tiled, base, fits, 100)
    assert all(f.settled for f in fits) and widths[0] == 7 and widths[-1] < 7 and widths == sorted(widths, reverse=True)
    names, n, d = matrix(tiled)
    found = {r.i: r for r in W.members(state, {"one": 0, "a": 1, "b": 2}).collect()}
    for c, f in (("one", fits[0]), ("a", fits[1]), ("b", fits[2])):
        want, cost = plain_lloyd(d * np.sqrt(n), n, f.k, f.seed)
        assert [found[i][c] for i in range(len(n))] == want.tolist() and f.cost == pytest.approx(cost)


def test_distances_in_place_are_those_of_the_plain_recursion():
    r = np.random.default_rng(3)
    cost = r.random((4, 4))
    for la, lb in ((0, 3), (5, 0), (4, 6), (7, 7)):
        a, b = r.integers(0, 4, (5, la)), r.integers(0, 4, (3, lb))
        want = np.zeros((5, 3))
        for x in range(5):
            for y in range(3):
                m = [[(i + j) * 0.7 for j in range(lb + 1)] for i in range(la + 1)]
                for i in range(la):
                    for j in range(lb):
                        m[i + 1][j + 1] = min(m[i][j] + cost[a[x, i], b[y, j]], m[i][j + 1] + 0.7, m[i + 1][j] + 0.7)
                want[x, y] = m[la][lb]
        assert Q.optimal_matching(a, b, cost, 0.7) == pytest.approx(want)


def test_of_equal_runs_the_first_is_taken():
    fits = [W.Fit(3, i, cost=c) for i, c in enumerate((5.0, 3.0 + 1e-12, 3.0, 4.0))]
    assert W._best(fits, range(4)) == 1 and W._best(fits, [0, 3]) == 3 and W._best([W.Fit(1, 1)], [0]) == 0

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.catalog import load_all
from hearthline.operators import sequences as Q, spells as SP
from hearthline.plans import life_course


def plain_om(a, b, cost, indel):
    d = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                d[i][j] = (i + j) * indel
            else:
                d[i][j] = min(d[i - 1][j] + indel, d[i][j - 1] + indel, d[i - 1][j - 1] + cost[a[i - 1]][b[j - 1]])
    return d[-1][-1]


def people(spark, n=60, length=8):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        p = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]][i % 3]
        rows.append((i, [None if rng.random() < 0.05 else str(s) for s in rng.choice(["A", "B", "C"], length, p=p)]))
    return spark.createDataFrame(rows, "id int, seq array<string>")


def everyone(df):
    return Q.frequent_sequences(df, "seq", 0.0)


def test_references(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i < 6 else [None, "b"] if i < 9 else ["a-b", "b"]) for i in range(10)], "id int, seq array<string>")
    assert Q.frequent_sequences(df, "seq", 0.3) == [(["a", "b"], 6.0), (["*", "b"], 3.0)]
    assert Q.steady_sequences(df, "seq") == [(["*"] * 2, 1.0), (["a"] * 2, 1.0), (["a-b"] * 2, 1.0), (["b"] * 2, 1.0)]
    short = spark.createDataFrame([(1, ["x"]), (2, ["y"]), (3, ["x"])], "id int, seq array<string>")  # no transition at all
    got = {(tuple(r.sequence), tuple(r.reference)): r.distance for r in Q.om_distance(short, "seq", Q.steady_sequences(short, "seq")).collect()}
    assert got == {(("x",), ("x",)): 0.0, (("x",), ("y",)): 2.0, (("y",), ("x",)): 2.0, (("y",), ("y",)): 0.0}


def test_rows_are_at_their_nearest_centre(spark):
    feats = Q.distance_features(people(spark, 90, 12), "seq", everyone(people(spark, 90, 12)))
    rows = Q.kmeans_on_distances(feats, 3).collect()
    x, n, c = np.array([r.features for r in rows]), np.array([r.n for r in rows], float), np.array([r.cluster for r in rows])
    centres = np.array([(x[c == k] * n[c == k, None]).sum(0) / n[c == k].sum() for k in range(3)])
    assert (((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) == c).all() and all(r.converged for r in rows)


def test_distance_against_plain_dynamic_programme(spark):
    df = people(spark)
    costs = Q.substitution_costs(df, "seq")
    table = {("-".join(r.sequence), "-".join(r.reference)): r.distance for r in Q.om_distance(df, "seq", everyone(df)).collect()}
    seqs = sorted({k[0] for k in table})
    states = {a for a, _ in costs}
    nested = {a: {b: costs[a, b] for b in states} for a in states}
    assert len(table) == len(seqs) ** 2
    for a in seqs[:12]:
        for b in seqs[:12]:
            assert table[a, b] == pytest.approx(plain_om(a.split("-"), b.split("-"), nested, 1.0))
            assert table[a, b] == pytest.approx(table[b, a])
        assert table[a, a] == 0


def test_transition_rates_sum_to_one(spark):
    rows = Q.transition_rates(people(spark), "seq").collect()
    assert sum(r.n for r in rows) == 60 * 7
    for state in {r["from"] for r in rows}:
        assert sum(r.p for r in rows if r["from"] == state) == pytest.approx(1)


def test_features_equal_the_full_matrix(spark):
    df = people(spark, 30, 4)
    feats = {tuple(r.seq): (r.n, np.array(r.features)) for r in Q.distance_features(df, "seq", everyone(df)).collect()}
    table = {(tuple(r.sequence), tuple(r.reference)): r.distance for r in Q.om_distance(df, "seq", everyone(df)).collect()}
    a, b = list(feats)[:2]
    want = sum(n * (table[a, c] - table[b, c]) ** 2 for c, (n, _) in feats.items())
    assert ((feats[a][1] - feats[b][1]) ** 2).sum() == pytest.approx(want)


def test_clusters_find_the_kinds(spark):
    df = people(spark, 90, 12)
    got = life_course.clustered_life_courses(df, "id", 3, {0: "x", 1: "y", 2: "z"}).collect()
    assert len(got) == 90
    for kind in range(3):
        labels = [r.label for r in got if r.id % 3 == kind]
        assert max(labels.count(v) for v in set(labels)) > 24
    again = {r.id: r.label for r in life_course.clustered_life_courses(df.repartition(5), "id", 3, {0: "x", 1: "y", 2: "z"}).collect()}
    assert again == {r.id: r.label for r in got}


def test_choose_k_and_stability(spark):
    df = people(spark, 90, 12)
    feats = Q.distance_features(df, "seq", everyone(df))
    rows = Q.choose_k(feats, k_max=4, references=2).orderBy("k").collect()
    wss = [r.wss for r in rows]
    assert wss[0] > wss[1] > wss[2] and rows[0].silhouette is None
    assert all(r.converged and r.gap_se >= 0 for r in rows)
    full = np.array([r.features for r in feats.collect()])
    n = np.array([r.n for r in feats.collect()], float)
    mean = (full * n[:, None]).sum(0) / n.sum()
    assert wss[0] == pytest.approx((n * ((full - mean) ** 2).sum(1)).sum())
    stable = Q.cluster_stability(df, "id", "seq", feats, boot=3).collect()
    assert len(stable) == 3 and all(0 < r.mean_jaccard <= 1 and r.dissolved + r.recovered <= 3 for r in stable)


def test_change_points_to_yearly(spark):
    rows = [(1, 1990, "a", 1993, "b", None, None), (2, None, None, None, None, None, None), (3, 1995, "a", 1990, "b", 1999, "c")]
    df = spark.createDataFrame(rows, "id int, y1 int, s1 string, y2 int, s2 string, y3 int, s3 string")
    spells = SP.change_points_to_spells([("y1", "s1"), ("y2", "s2"), ("y3", "s3")], 2000)
    got = {r.id: [tuple(x) for x in r.sp] for r in df.select("id", spells.alias("sp")).collect()}
    assert got == {1: [("a", 3), ("b", 7)], 2: [], 3: [("a", 10), ("b", 9), ("c", 1)]}
    yearly = df.select("id", F.array_join(SP.spells_to_yearly(spells, 12), "", "*").alias("t"))
    assert {r.id: r.t for r in yearly.collect()} == {1: "**aaabbbbbbb", 2: "*" * 12, 3: "aabbbbbbbbbc"}


def test_spell_fixes(spark):
    df = spark.createDataFrame([(2000, 1990), (1990, None), (1990, 1995)], "s int, e int")
    assert [r[0] for r in df.select(SP.spell_years("s", "e")).collect()] == [10, None, 5]
    assert [r[0] for r in df.select(SP.spell_years("s", "e", 2014, "abs")).collect()] == [10, 24, 5]
    assert [tuple(r) for r in SP.normalise_spells(df, "s", "e", 2014).collect()] == [(1990, 2000), (1990, 2014), (1990, 1995)]


def test_order_of_states_makes_distances(spark, monkeypatch):
    """Sequences of the same states in another order differ in the distances that the queries cluster by."""
    from hearthline.catalog import sequences as C
    from hearthline.operators import tiles as W

    df = spark.createDataFrame([(1, list("aabb")), (2, list("bbaa")), (3, list("abab")), (4, list("aabb"))], "user_id long, seq array<string>")
    seen = []
    make = W.tiled_distances
    monkeypatch.setattr(W, "tiled_distances", lambda *a, **b: seen.append(make(*a, **b)) or seen[-1])
    monkeypatch.setattr(C, "daily", lambda spark, d, length=C.DAYS: df)
    assert len(C.om_kmeans(spark, "").collect()) == 4
    assert len(life_course.clustered_life_courses(df, "user_id", 2).collect()) == 4
    assert len(seen) == 2
    for t in seen:
        rows = W.distance_table(t).collect()
        assert len(rows) == 9 and all((r.distance > 0) == (r.sequence != r.reference) for r in rows)
    steady = {tuple(r.features) for r in Q.distance_features(df, "seq", Q.steady_sequences(df, "seq")).collect()}
    assert len(steady) == 1


def test_blocks_of_references(spark, monkeypatch):
    """Distances do not depend on how many pairs are compared at once."""
    df = people(spark, 40, 6)
    want = {(tuple(r.sequence), tuple(r.reference)): r.distance for r in Q.om_distance(df, "seq", Q.all_sequences(df, "seq")).collect()}
    monkeypatch.setattr(Q, "PAIRS", 9)
    monkeypatch.setattr(Q, "CELLS", 100)
    assert want == {(tuple(r.sequence), tuple(r.reference)): r.distance for r in Q.om_distance(df, "seq", Q.all_sequences(df, "seq")).collect()}


def test_days_follow_the_table(spark, tmp_path):
    from hearthline.catalog import sequences as C

    rows = [(1, 7, "2024-05-01 10:00:00", "view"), (2, 8, "2024-02-01 10:00:00", "cart"), (3, 7, "2024-05-02 10:00:00", "buy")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.seq for r in C.states_to_sequence(spark, str(tmp_path)).collect()}
    assert got == {7: "-".join(["*"] * 23 + ["view", "buy"])}
    whole = {r.user_id: r.seq.split("-") for r in C.states_to_sequence_all(spark, str(tmp_path)).collect()}
    assert whole == {7: ["*"] * 90 + ["view", "buy"], 8: ["cart"] + ["*"] * 91}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("states_to_sequence", "states_to_sequence_all"):  # and so does the SQL
        assert dict(con.sql(load_all()[1][name]).fetchall()) == {r.user_id: r.seq for r in getattr(C, name)(spark, str(tmp_path)).collect()}


def test_line_number_outside_the_slots_is_an_error(spark, tmp_path):
    from hearthline.catalog.scalars import line_block

    lines = spark.createDataFrame([(1, 8, 5.0, 9.0, 0.1)], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="outside the slots"):
        line_block(spark, str(tmp_path)).collect()

"""Spells, yearly sequences and clusters: users as persons, days as years."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthline.catalog import query, table
from hearthline.catalog.joins import SPELLS, order_spells
from hearthline.catalog.scalars import BLOCK, line_block
from hearthline.operators import sequences as Q, spells as SP, tiles as W
from hearthline.session import stable

LETTERS = "abcdef"


def point_spells(spark, d):
    """Change points of an order: slot s changes to state s in "year" qty s, the study ends in year 60."""
    points = [(f"qty{i}", F.lit(ch)) for i, ch in enumerate(LETTERS, 1)]
    return line_block(spark, d).select("l_orderkey", SP.change_points_to_spells(points, 60).alias("spells"))


SPELL_SQL = BLOCK + """, p AS (SELECT l_orderkey, s, substr('abcdef', s, 1) AS state,
  CAST(CASE s WHEN 1 THEN qty1 WHEN 2 THEN qty2 WHEN 3 THEN qty3 WHEN 4 THEN qty4 WHEN 5 THEN qty5 ELSE qty6 END AS INTEGER) AS y
  FROM block, (VALUES (1), (2), (3), (4), (5), (6)) v(s)),
q AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY l_orderkey ORDER BY s), 60) - y AS years FROM p WHERE y IS NOT NULL),
sp AS (SELECT l_orderkey, s, state, CASE WHEN years < 0 THEN 10 ELSE years END AS years FROM q) """


@query(sql=SPELL_SQL + "SELECT l_orderkey, state, CAST(years AS INTEGER) AS years, row_number() OVER (PARTITION BY l_orderkey ORDER BY s) - 1 AS pos FROM sp")
def change_points(spark, d):
    return point_spells(spark, d).select("l_orderkey", F.posexplode("spells").alias("pos", "spell")).select(
        "l_orderkey", "spell.state", "spell.years", "pos")


@query(sql=SPELL_SQL + """, t AS (SELECT l_orderkey, coalesce(string_agg(repeat(state, years), '' ORDER BY s), '') AS t FROM sp GROUP BY 1)
SELECT b.l_orderkey, lpad(right(coalesce(t, ''), 100), 100, '*') AS yearly, lpad(right(coalesce(t, ''), 25), 25, '*') AS last25,
       rpad(left(coalesce(t, ''), 25), 25, '*') AS first25 FROM block b LEFT JOIN t ON t.l_orderkey = b.l_orderkey""")
def spells_to_yearly(spark, d):
    rows = point_spells(spark, d)
    yearly = SP.spells_to_yearly(F.col("spells"), 100)
    text = lambda x: F.array_join(x, "", "*")
    return rows.select("l_orderkey", text(yearly).alias("yearly"), text(SP.sequence_define(yearly, 25)).alias("last25"),
                       text(SP.spells_to_yearly(F.col("spells"), 25, "left")).alias("first25"))


@query(sql="""
SELECT user_id, lpad(right(t, 5), 5, '*') AS last5, rpad(left(t, 5), 5, '*') AS first5
FROM (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY event_type) AS t FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1)""")
def fit_length(spark, d):
    kinds = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"))
    letters = F.transform("k", lambda e: F.substring(e, 1, 1))
    text = lambda a: F.array_join(SP.fit_length(letters, 5, a), "", "*")
    return kinds.select("user_id", text("right").alias("last5"), text("left").alias("first5"))


@query(sql="""
SELECT l_orderkey, CAST(least(s, e) AS DOUBLE) AS s, CAST(greatest(s, e) AS DOUBLE) AS e, CAST(abs(e - s) AS DOUBLE) AS years FROM (
  SELECT l_orderkey, qty1 AS s, coalesce(qty2, 14) AS e FROM (""" + BLOCK + """SELECT * FROM block WHERE qty1 IS NOT NULL))""")
def normalise_spells(spark, d):
    rows = line_block(spark, d).filter("qty1 is not null").select("l_orderkey", F.col("qty1").alias("s"), F.col("qty2").alias("e"))
    rows = rows.withColumn("years", SP.spell_years("s", "e", open_end=14, negative="abs"))
    return SP.normalise_spells(rows, "s", "e", 14)


@query(sql=SPELLS + """, o AS (SELECT *, greatest(0, least(e, 1998) - greatest(s, 1995) + 1) AS years, 'p' || (e - s) AS state FROM spells)
SELECT o_custkey, state, years FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY years DESC,
       CASE WHEN years > 0 THEN 0 ELSE e END, o_orderkey) AS rn FROM o) WHERE rn = 1""")
def spell_in_window(spark, d):
    rows = order_spells(spark, d).withColumn("state", F.concat(F.lit("p"), F.col("e") - F.col("s")))
    return SP.spell_in_window(rows, ["o_custkey"], "s", "e", "state", (1995, 1998), "o_orderkey")


# --- sequences of daily states --------------------------------------------------------------

DAYS = 25


def daily(spark, d, length=DAYS):
    """A user's state per day is the type of the day's last event; the sequence is the last 25 days up to the table's last one,
    or all its days if the length is None."""
    events = table(spark, d, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(last.alias("state"))
    day = F.to_date("ts")
    first, end = events.agg(F.min(day), F.max(day)).first()
    if length is None:
        length = (end - first).days + 1 if end else 0
    place = days.withColumn("pos", F.lit(length) - F.date_diff(F.lit(end).cast("date"), "day"))
    return SP.states_to_sequence(place, "user_id", "pos", "state", length)


DAILY = f"""WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1, 2),
b AS (SELECT max(day) AS last FROM days),
u AS (SELECT DISTINCT user_id, last FROM days, b WHERE last - day BETWEEN 0 AND {DAYS - 1}),
seq AS (SELECT u.user_id, p.pos, coalesce(state, '*') AS state FROM u CROSS JOIN (SELECT unnest(range(1, {DAYS + 1})) AS pos) p
        LEFT JOIN days ON days.user_id = u.user_id AND {DAYS} - (last - day) = p.pos) """


WHOLE = """WITH days AS (SELECT user_id, CAST(ts AS DATE) AS day, max_by(event_type, (ts, event_id)) AS state FROM events GROUP BY 1, 2),
b AS (SELECT min(day) AS first, max(day) AS last FROM days),
seq AS (SELECT u.user_id, p.pos, coalesce(state, '*') AS state FROM (SELECT DISTINCT user_id FROM days) u
        CROSS JOIN (SELECT first, unnest(range(1, (last - first) + 2)) AS pos FROM b) p
        LEFT JOIN days ON days.user_id = u.user_id AND (day - first) + 1 = p.pos) """


@query(sql=WHOLE + "SELECT user_id, string_agg(state, '-' ORDER BY pos) AS seq FROM seq GROUP BY 1")
def states_to_sequence_all(spark, d):
    return daily(spark, d, None).select("user_id", F.array_join("seq", "-", "*").alias("seq"))


@query(sql=WHOLE + """, t AS (SELECT state AS "from", lead(state) OVER (PARTITION BY user_id ORDER BY pos) AS "to" FROM seq),
c AS (SELECT "from", "to", count(*) AS n FROM t WHERE "to" IS NOT NULL GROUP BY 1, 2)
SELECT "from", "to", n, round(n / sum(n) OVER (PARTITION BY "from"), 8) AS p FROM c""")
def transition_rates_all(spark, d):
    return Q.transition_rates(daily(spark, d, None), "seq").withColumn("p", F.round("p", 8))


@query(sql=WHOLE + "SELECT user_id % 3 AS grp, CAST(pos - 1 AS INTEGER) AS pos, state, count(*) AS n FROM seq GROUP BY 1, 2, 3")
def sequence_index_all(spark, d):
    return Q.sequence_index_data(daily(spark, d, None).withColumn("grp", F.col("user_id") % 3), "grp", "seq")


@query(sql=DAILY + "SELECT user_id, string_agg(state, '-' ORDER BY pos) AS seq FROM seq GROUP BY 1")
def states_to_sequence(spark, d):
    return daily(spark, d).select("user_id", F.array_join("seq", "-", "*").alias("seq"))


@query(sql=DAILY + """, t AS (SELECT state AS "from", lead(state) OVER (PARTITION BY user_id ORDER BY pos) AS "to" FROM seq),
c AS (SELECT "from", "to", count(*) AS n FROM t WHERE "to" IS NOT NULL GROUP BY 1, 2)
SELECT "from", "to", n, round(n / sum(n) OVER (PARTITION BY "from"), 8) AS p FROM c""")
def transition_rates(spark, d):
    return Q.transition_rates(daily(spark, d), "seq").withColumn("p", F.round("p", 8))


@query(sql=DAILY + "SELECT user_id % 3 AS grp, CAST(pos - 1 AS INTEGER) AS pos, state, count(*) AS n FROM seq GROUP BY 1, 2, 3")
def sequence_index(spark, d):
    return Q.sequence_index_data(daily(spark, d).withColumn("grp", F.col("user_id") % 3), "grp", "seq")


@query()
def om_distance(spark, d):
    """Distances to the sequences that stay in one state; `om_distance_all` has those between all sequences."""
    people = stable(daily(spark, d))
    found = Q.om_distance(people, "seq", Q.steady_sequences(people, "seq"))
    return found.select(F.array_join("sequence", "-").alias("sequence"), F.element_at("reference", 1).alias("steady_in"), "distance")


def tiled(people):
    """The distances between all sequences of the people."""
    return W.tiled_distances(people, "seq", Q.substitution_costs(people, "seq"))


@query()
def om_distance_all(spark, d):
    found = W.distance_table(tiled(stable(daily(spark, d, None))))
    return found.select(F.array_join("sequence", "-").alias("sequence"), F.array_join("reference", "-").alias("reference"), "distance")


@query()
def om_kmeans(spark, d):
    people = stable(daily(spark, d, None))
    clustered = W.kmeans_on_tiles(tiled(people), k=3)
    labelled = Q.label_clusters(Q.assign_clusters(people, "seq", clustered), {0: "first", 1: "second", 2: "third"})
    return labelled.select("user_id", "cluster", "label")


@query()
def choose_k(spark, d):
    """By distances to the sequences that stay in one state; `choose_k_all` goes by those between all sequences."""
    people = stable(daily(spark, d))
    return Q.choose_k(Q.distance_features(people, "seq", Q.steady_sequences(people, "seq")))


@query()
def choose_k_all(spark, d):
    return W.choose_k_on_tiles(tiled(stable(daily(spark, d, None))))


@query()
def cluster_stability(spark, d):
    people = stable(daily(spark, d, None))
    return W.stability_on_tiles(tiled(people), people, ["user_id"])

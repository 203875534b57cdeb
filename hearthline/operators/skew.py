"""Group-wise work that stays even when one group holds a large part of all rows.

The helpers first count the keys of a sample and take the largest groups above a row limit. No more than `spark.sql.shuffle.partitions` groups are taken,
so the list that reaches the driver and is broadcast has a fixed bound; any group left out of
it is hardly larger than a mean shuffle partition. With no large group the plain window or join is
used. With some, only their rows take the longer way: ordered work is cut into ranges
of the sort order, joins are salted. Both ways give the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthline.session import stable

HOT_ROWS_CONF = "spark.hearthline.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
SAMPLE_HITS = 1000


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int | None = None) -> list[Row]:
    """The largest groups of `keys` with about `hot_rows` rows or more, at most one per shuffle partition.

    Keys are counted on a sample in which a hot group still shows up about a thousand times. The
    list only decides which way rows are worked on, never which rows: a group just missed takes the
    plain way. `__times` says how many times over the limit a group is.
    """
    limit = hot_rows or int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))
    rate = min(1.0, SAMPLE_HITS / limit)
    seen = df.select(*keys)
    if rate < 1:
        seen, limit = seen.sample(rate, seed=17), 0.9 * SAMPLE_HITS
    sizes = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= limit)
    times = F.ceil(F.col("__n") / F.lit(limit)).cast("int").alias("__times")
    return sizes.select(*keys, times).orderBy(F.desc("__times")).limit(shuffle_partitions(df)).collect()


def same_key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which a missing key finds a missing key; key columns come from the left side."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True))
    return left.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def _hot_frame(df: DataFrame, keys: list[str], hot: list[Row]) -> DataFrame:
    """Hot keys with the number of parts to split each into: as many as bring a part to the limit."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("__salts", T.IntegerType())])
    most = max(2, shuffle_partitions(df))
    rows = [(*[r[k] for k in keys], min(most, max(2, r["__times"]))) for r in hot]
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def split_hot(df: DataFrame, keys: list[str], hot: list[Row]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary groups, rows of hot groups)."""
    if not keys:
        return df.limit(0), df
    marks = _hot_frame(df, keys, hot).drop("__salts")
    return same_key_join(df, marks, keys, "left_anti"), same_key_join(df, marks, keys, "left_semi")


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str,
    weight: Column | None = None,
    hot: list[Row] | None = None,
) -> DataFrame:
    """Inclusive running sum of `weight` (1 if not given) in each group, along `order`.

    `order` must end in a unique tie-breaker. With weight 1 this is the row number.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    hot = hot_groups(df, keys) if hot is None else hot
    ordered = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    plain = lambda d: d.withColumn(out, F.sum(weight).over(ordered))
    if not hot:
        return plain(df)

    cold_rows, hot_rows = split_hot(df, keys, hot)
    # ranges of (group, order): a hot group spreads over many partitions. The split is written
    # down so that offsets and rows can never see different range bounds.
    pieces = stable(
        hot_rows.repartitionByRange(shuffle_partitions(df), *keys, *order).withColumn(
            "__piece", F.spark_partition_id()
        )
    )
    # one row per (group, partition it touches): fewer than partitions + hot groups
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "__piece")
        .agg(F.sum(weight).alias("__sum"))
        .withColumn("__offset", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
        .drop("__sum")
    )
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = pieces.withColumn("__inside", F.sum(weight).over(inside))
    ranked = same_key_join(ranked, F.broadcast(offsets), keys + ["__piece"], "inner").select(
        *df.columns, (F.col("__inside") + F.col("__offset")).alias(out)
    )
    return ranked if not keys else plain(cold_rows).unionByName(ranked)


def next_in_group(
    df: DataFrame, keys: list[str], order: list[Column], outs: dict[str, str], hot: list[Row] | None = None
) -> DataFrame:
    """Add, under each new name in `outs`, the given column of the following row of the group."""
    hot = hot_groups(df, keys) if hot is None else hot
    ordered = Window.partitionBy(*keys).orderBy(*order)
    plain = lambda d: d.withColumns({o: F.lead(c).over(ordered) for o, c in outs.items()})
    if not hot:
        return plain(df)
    cold_rows, hot_rows = split_hot(df, keys, hot)
    numbered = stable(running_total(hot_rows, keys, order, "__pos", hot=hot))
    follow = numbered.select(
        *keys, (F.col("__pos") - 1).alias("__pos"), *[F.col(c).alias(o) for o, c in outs.items()]
    )
    joined = same_key_join(numbered, follow, keys + ["__pos"], "left").select(*df.columns, *outs)
    return joined if not keys else plain(cold_rows).unionByName(joined)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    how: str = "left",
    missing_keys_match: bool = False,
    hot: list[Row] | None = None,
) -> DataFrame:
    """Join long `rows` to a per-key `table`; hot keys of `rows` are salted.

    `how` is left, inner or left_semi: kinds in which a copied table row can never come out alone.
    """
    if how not in ("left", "inner", "left_semi"):
        raise ValueError(f"lookup_join does not support {how}")
    hot = hot_groups(rows, keys) if hot is None else hot
    on = keys
    if hot and keys:
        marks, salts = _hot_frame(rows, keys, hot), F.coalesce(F.col("__salts"), F.lit(1))
        # the input partition keeps exact copies of a row from sharing one salt, and a task that is
        # run again gives the same salts
        row_salt = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), salts.cast("long"))
        copies = F.sequence(F.lit(0), salts - 1)
        rows = same_key_join(rows, marks, keys, "left").withColumn("__salt", row_salt.cast("int")).drop("__salts")
        table = same_key_join(table, marks, keys, "left").withColumn("__salt", F.explode(copies)).drop("__salts")
        on = keys + ["__salt"]
    if missing_keys_match or not keys:
        joined = same_key_join(rows, table, on, how)
    else:
        joined = rows.join(table, on, how)
    return joined.drop("__salt")


def group_quantiles(
    df: DataFrame, keys: list[str], x: str, probs: dict[str, float], hot: list[Row] | None = None
) -> DataFrame:
    """Exact quantiles of `x` per group with linear interpolation; one column per entry of `probs`.

    Equal values are counted first, so what is sorted is at most the distinct values; a group is
    never held in memory as a whole.
    """
    known = df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    values = known.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"))
    hot = hot_groups(known, keys) if hot is None else hot
    reached = running_total(values, keys, [F.col("__x").asc()], "__cum", F.col("__c"), hot=hot)
    if hot:
        totals = values.groupBy(*keys).agg(F.sum("__c").alias("__n"))
        reached = lookup_join(reached, totals, keys, "inner", missing_keys_match=True, hot=hot)
    else:  # the rows are already where a window over the group needs them
        reached = reached.withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))

    def at(position: Column) -> Column:  # 0-based order statistic
        return F.min(F.when(F.col("__cum") > position, F.col("__x")))

    aggs = []
    for name, p in probs.items():
        place = (F.col("__n") - 1) * F.lit(float(p))
        aggs += [
            at(F.floor(place)).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__w_{name}"),
        ]
    found = reached.groupBy(*keys).agg(*aggs)
    lo, hi, w = (lambda n: F.col(f"__lo_{n}")), (lambda n: F.col(f"__hi_{n}")), (lambda n: F.col(f"__w_{n}"))
    return found.select(*keys, *[(lo(n) + (hi(n) - lo(n)) * w(n)).alias(n) for n in probs])

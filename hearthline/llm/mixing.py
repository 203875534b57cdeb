"""Temperature mixing of sources, realised by budgeted block permutations."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import col, kept

SPLITS = 16  # parts into which a pass over the sources divides the exponent's interval: four bisections at once
PASSES = 6


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def temperature(shares: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The largest exponent up to 1 at which normalised powers of the shares `p` have at least `target_entropy` times the entropy of
    even weights, but not below the smallest at which no source is used more than `max_repeats` times as often as the largest."""
    sums = shares.agg(F.count("*").alias("n"), F.max("p").alias("most"), F.min("p").alias("least")).first()
    if sums.n < 2 or target_entropy is None and max_repeats is None:
        return 1.0

    def entropies(exponents: list[float]) -> list[float]:
        parts = []
        for k, a in enumerate(exponents):
            power = F.pow(F.col("p") / sums.most, F.lit(a))
            parts += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log(F.col("p") / sums.most)).alias(f"l{k}")]
        row = shares.agg(*parts).first()
        return [log(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"] for k, a in enumerate(exponents)]

    def bisected(fits) -> float:
        """The end at 0 of the smallest interval found at whose start `fits` holds and at whose end it doesn't."""
        lo, hi = 0.0, 1.0
        for _ in range(PASSES):
            inner = [lo + (hi - lo) * k / SPLITS for k in range(1, SPLITS)]
            good = fits(inner)
            last = max((k + 1 for k, g in enumerate(good) if g), default=0)
            lo, hi = lo + (hi - lo) * last / SPLITS, lo + (hi - lo) * (last + 1) / SPLITS
        return lo

    exponent = 1.0
    if target_entropy is not None:
        wanted = target_entropy * log(sums.n)
        if entropies([1.0])[0] < wanted:
            exponent = bisected(lambda inner: [h >= wanted for h in entropies(inner)])
    if max_repeats is not None:
        ratio = sums.most / sums.least
        if ratio ** (1 - exponent) > max_repeats:
            # repeats fall as the exponent grows: the last one that is too small, and one step more
            exponent = min(1.0, bisected(lambda inner: [ratio ** (1 - a) > max_repeats for a in inner]) + SPLITS**-PASSES)
    return exponent


def mixing_plan(docs: DataFrame, source: str, tokens: Column, keys: list[Column], target_entropy: float | None = 0.95, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 9) -> DataFrame:
    """A row for each source (null is one): source, tokens, weight, repeats, whole passes, number of blocks, and where the last, partial pass ends.

    A source's share of all tokens is raised to the exponent of `temperature` and normalised to its weight. `budget` is the number of tokens to
    draw; without it, the smallest with which every document is drawn at least once. A source of no tokens has weight 0 and one pass.
    In a pass the documents of a source are dealt by a hash into about as many blocks as each block has documents, and blocks
    and documents come in the order of hashes. The partial pass takes documents in this order while they fit the rest of the source's budget;
    the plan holds the last block it enters and the last hash it takes there, so that each row can be judged by itself.
    """
    rows = docs.select(col(source).alias("source"), tokens.alias("tokens"), F.xxhash64(*keys).alias("key"))
    sources = kept(rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")), "sources", small=True)
    whole = sources.agg(F.sum("total")).first()[0] or 0
    shares = sources.where("total > 0").select((F.col("total") / F.lit(float(whole or 1))).alias("p"))
    exponent = temperature(shares, target_entropy, max_repeats)
    power = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(float(whole or 1)), F.lit(exponent))).otherwise(0.0)
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    sources = sources.withColumn("weight", power / norm)
    if budget is None:
        budget = sources.where("total > 0").agg(F.max(F.col("total") / F.col("weight"))).first()[0] or 0.0
    repeats = F.when(F.col("total") > 0, F.col("weight") * float(budget) / F.col("total")).otherwise(1.0)
    sources = sources.withColumn("repeats", F.round(repeats, 9)).withColumn("passes", F.floor("repeats").cast("int"))
    sources = sources.withColumn("rest", F.floor((F.col("repeats") - F.col("passes")) * F.col("total") + 1e-6).cast("long")).withColumn("blocks", F.ceil(F.sqrt("docs")).cast("int"))
    sources = kept(sources, "budgets", small=True)
    placed = rows.join(sources.where("rest > 0").select(F.col("source").alias("of"), "passes", "rest", "blocks"), F.col("source").eqNullSafe(F.col("of")))
    placed = placed.select("of", "rest", "tokens", *place(F.col("key"), F.col("passes"), F.col("blocks"), seed))
    sums = placed.groupBy("of", "block").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = sums.where("before <= rest").groupBy("of").agg(F.max(F.struct("block", "before")).alias("last"))
    last = kept(last.select(F.col("of").alias("last_of"), F.col("last.block").alias("last_block"), F.col("last.before").alias("before")), "last-blocks", small=True)
    inside = placed.join(last, F.col("of").eqNullSafe(F.col("last_of")) & (F.col("block") == F.col("last_block"))).groupBy("of", "order").agg(F.sum("tokens").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    running = F.sum("sum").over(Window.partitionBy("of").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    ends = inside.withColumn("used", F.col("before") + running).where("used <= rest").groupBy("of").agg(F.max("order").alias("last_order"))
    ends = last.join(ends, F.col("last_of").eqNullSafe(F.col("of")), "left").select("last_of", "last_block", "last_order")
    plan = sources.join(ends, F.col("source").eqNullSafe(F.col("last_of")), "left")
    return kept(plan.select("source", F.col("total").alias("source_tokens"), "docs", "weight", "repeats", "passes", "blocks", "last_block", "last_order"), "mixing-plan", small=True)


def place(key: Column, pass_: Column, blocks: Column, seed: int) -> list[Column]:
    """A document's block, and its order within, in a pass over its source."""
    return [F.pmod(F.xxhash64(F.lit(seed), key, pass_), blocks).cast("int").alias("block"), F.xxhash64(F.lit(seed + 1), key, pass_).alias("order")]


def copies_of(docs: DataFrame, plan: DataFrame, source: str, keys: list[Column], seed: int = 9) -> DataFrame:
    """`docs` with hl_copies, how often the plan draws each row, and hl_weight of its source. No row is moved while the plan is small enough to broadcast."""
    plan = plan.select(F.col("source").alias("hl_source"), F.col("weight").alias("hl_weight"), F.col("passes").alias("hl_passes"), F.col("blocks").alias("hl_blocks"), F.col("last_block").alias("hl_last"), F.col("last_order").alias("hl_order"))
    block, order = place(F.xxhash64(*keys), F.col("hl_passes"), F.col("hl_blocks"), seed)
    taken = F.coalesce((block < F.col("hl_last")) | ((block == F.col("hl_last")) & (order <= F.col("hl_order"))), F.lit(False))
    joined = docs.join(plan, col(source).eqNullSafe(F.col("hl_source")))
    return joined.select(*[col(c) for c in docs.columns], (F.col("hl_passes") + taken.cast("int")).alias("hl_copies"), "hl_weight")


def mixed(docs: DataFrame, source: str, tokens: Column, keys: list[Column], seed: int = 9, **targets) -> DataFrame:
    """The drawn documents: the columns of `docs`, each row as often as the plan of its source says, with hl_pass (from 1)."""
    plan = mixing_plan(docs, source, tokens, keys, seed=seed, **targets)
    drawn = copies_of(docs, plan, source, keys, seed).where("hl_copies > 0")
    return drawn.select(*[col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("hl_copies"))).alias("hl_pass"))

"""URL rules by host and path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import col

PREFIX_HEX = 8  # the short hash: the first 32 bits of the digest
BROADCAST_RULES = 100_000  # rule rows up to which the rule table goes to every task; about 200 bytes each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.substring_index(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), "#", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "/", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: DataFrame, keys: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """Host, path, longest fitting rule and verdict of every row of `urls`.

    `rules` has host, path and verdict. A rule fits its host and all subdomains if the path starts with the rule's.
    Each URL is expanded into host suffix + path prefix expressions, for just those (labels, path length) that
    rules have. Expressions meet rules on the first 32 bits of their SHA-256, then the whole digests are compared.
    The longest rule wins; of equally long ones that with the longer host, then `block`.

    The rule table is broadcast if it is counted as small; beyond that rules and expressions are shuffled by the
    short hash, and adaptive execution splits hot ones. Rows come back one for one, with the columns `keys`, `host`,
    `path`, `rule` (null if none) and `verdict` (`default` if none). Null keys and repeated rows are kept; rules with
    a null are ignored; of rules alike but for the verdict `block` holds.
    """
    rules = (
        rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .where("rule_host is not null and rule_path is not null and rule_verdict is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.max_by("rule_verdict", F.struct(F.col("rule_verdict") == "block", "rule_verdict")).alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    # as many rows as pairs of a rule's label count and path length, whatever the number of rules
    shapes = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("chars")).distinct().collect()
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    named = [col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    rows = urls.select(*named, col(url).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    label_count = F.size(F.split("host", r"\."))
    options = [
        F.when(
            (label_count >= s.labels) & (F.length("path") >= s.chars) & (F.col("host") != ""),
            F.concat(F.substring_index("host", ".", -s.labels), F.substring("path", 1, s.chars)),
        )
        for s in shapes
    ]
    # a null in front keeps rows without an expression, and counts rows that are wholly alike
    expressions = F.concat(F.array(F.lit(None).cast("string")), F.array_compact(F.array(*options)) if options else F.array().cast("array<string>"))
    rows = rows.select(*[f"key_{i}" for i in range(len(keys))], "url", "host", "path", F.explode(expressions).alias("expression"))
    rows = rows.withColumn("full", F.sha2("expression", 256)).withColumn("short", F.substring("full", 1, PREFIX_HEX))
    met = rows.join(rules, "short", "left")
    fits = F.col("full") == F.col("digest")
    best = F.struct(F.length("rule").alias("length"), F.length("rule_host").alias("host_length"), (F.col("rule_verdict") == "block").alias("block"), "rule", "rule_verdict")
    by = [*[f"key_{i}" for i in range(len(keys))], "url", "host", "path"]
    judged = met.groupBy(*by).agg(F.max(F.when(fits, best)).alias("best"), F.count(F.when(F.col("expression").isNull(), 1)).alias("copies"))
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return judged.select(
        *[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )

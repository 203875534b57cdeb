"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collision_ann, cover_tree, langid, line_dedup, merkle, mixing, ngram_join, ngram_lm, packing, periodic_runs, pii, url_filter, warc
from .store import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register under the function's name; without `sql` it is held against a brute-force version in the tests."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- 1: URL filters -------------------------------------------------------------------------

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query(
    sql="""WITH rules(h, p, v) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS t FROM pages),
parts AS (SELECT page_id, r, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT r, max({'n': length(h || p), 'rule': h || p, 'v': v}) AS best FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM parts LEFT JOIN fit USING (r)"""
)
def op1_url_filter(spark, d):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, d, "pages"), rules, ["page_id"])


# --- 2: exact top-k search ------------------------------------------------------------------


def finite(vector: str):
    """The vector if no component is null or not finite, else null."""
    return F.when(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.col(vector))


@query(
    sql="""WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""
)
def op2_cover_tree(spark, d):
    whole = F.transform(finite("embedding"), lambda v: F.floor(1024 * v.cast("double")))
    vectors = table(spark, d, "embeddings").select("vec_id", whole.alias("embedding"))
    return cover_tree.exact_topk(vectors, F.col("vec_id") % 100 == 0, 10)


# --- 3: approximate nearest neighbours ------------------------------------------------------


@query()
def op3_collision_counting(spark, d):
    return collision_ann.near_topk(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, 20)


# --- 4: n-gram Jaccard join -----------------------------------------------------------------


@query()
def op4_ngram_jaccard_join(spark, d):
    return ngram_join.near_duplicates(table(spark, d, "documents")).select("doc_id", "class_id", "n_links")


# --- 5: line dedup --------------------------------------------------------------------------


@query()
def op5_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", F.col("hl_lines").alias("n_lines"), F.col("hl_removed").alias("n_removed"), "text")


# --- 6: best-fit packing --------------------------------------------------------------------


@query()
def op6_best_fit_packing(spark, d):
    return packing.pack_documents(table(spark, d, "documents"))


# --- 7: LM scoring --------------------------------------------------------------------------


@query()
def op7_deleted_interpolation(spark, d):
    docs = table(spark, d, "documents")
    held_out = langid.fold(F.col("doc_id"), 7) == 2
    scores = ngram_lm.interpolated_scores(docs, ~held_out, file=F.col("_metadata.file_path"), row=F.col("_metadata.row_index"))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 8: WARC --------------------------------------------------------------------------------


@query(
    sql="""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q),
k AS (SELECT *, payload_bytes >= 1000 AND page_id <> top AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM k"""
)
def op8_warc(spark, d):
    return warc.archive_and_read(table(spark, d, "pages")).drop("url")


# --- 9: mixing sources to target weights ----------------------------------------------------


@query()
def op9_temperature_mixing(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("tokens"), F.xxhash64("text").alias("text_hash"))
    keys = [F.col("doc_id"), F.col("text_hash")]
    plan = mixing.mixing_plan(docs, "source", F.col("tokens"), keys)
    return mixing.copies_of(docs, plan, "source", keys).select("doc_id", "source", "tokens", F.col("hl_weight").alias("weight"), F.col("hl_copies").alias("copies"))


# --- 10: language ID ------------------------------------------------------------------------


@query()
def op10_language_id(spark, d):
    docs = table(spark, d, "documents")
    held_out = langid.fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out), "text", "lang")
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), F.col("hl_lang").alias("lang_pred"), F.col("hl_score").alias("score"))


# --- 11: PII --------------------------------------------------------------------------------


@query()
def op11_pii_sanitisation(spark, d):
    found = pii.sanitise(table(spark, d, "documents"), ["doc_id"])
    base = F.filter("hl_spans", lambda s: s["kind"] < pii.TERM)
    counts = [F.size(F.filter("hl_spans", pii.of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("hl_spans")).alias("spans"))


# --- 12: Merkle dataset manifest ------------------------------------------------------------

# crc32 of the decimal id, bit by bit; a null id counts as an empty text
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: d <> ''), lambda d: ascii(d)::BIGINT)),
lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::BIGINT)"""

LEAF_SQL = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"


@query(
    sql=f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {LEAF_SQL.format(text="text")} AS leaf,
CASE WHEN {CRC32} % 3 = 0 THEN {LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
p AS (SELECT *, coalesce(changed, leaf) AS claimed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
nodes AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM p
UNION ALL SELECT tree, level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 8),
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (SELECT 0 AS level, i, n, h FROM subroots
UNION ALL SELECT level + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 8),
every AS (SELECT tree, level, i, n, h FROM nodes UNION ALL SELECT 'top', level, i, n, h FROM top),
sides AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY ALL),
heights AS (SELECT tree, max(level) AS high FROM every GROUP BY tree),
walk AS (SELECT row_number() OVER () AS row, doc_id, leaf, p.tree, s.h AS subroot, p.tree AS here, 0 AS level, p.i AS i, s.i AS top_i, claimed AS h, '' AS proof FROM p JOIN subroots s USING (tree)
UNION ALL SELECT row, doc_id, leaf, w.tree, subroot, CASE WHEN w.level = g.high THEN 'top' ELSE here END, CASE WHEN w.level = g.high THEN 0 ELSE w.level + 1 END,
CASE WHEN w.level = g.high THEN top_i ELSE w.i // 8 END, top_i, CASE WHEN w.level = g.high THEN w.h ELSE sha256(s.l || w.h || s.r) END, CASE WHEN w.level = g.high THEN proof ELSE proof || s.l || s.r END
FROM walk w JOIN heights g ON g.tree = here LEFT JOIN sides s ON s.tree = here AND s.level = w.level AND s.i = w.i WHERE NOT (here = 'top' AND w.level = g.high))
SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = o.h AS verified
FROM walk w JOIN heights g ON here = 'top' AND g.tree = here AND w.level = g.high, (SELECT h FROM top WHERE n = 1) o"""
)
def op12_merkle_manifest(spark, d):
    docs = table(spark, d, "documents")
    return merkle.prove_documents(docs, langid.fold(F.col("doc_id"), 3) == 0)


# --- 13: periodic run detection -------------------------------------------------------------


def with_period(text, doc_id):
    """A tenth of the texts repeat a stretch of their words from some word on to the end."""
    h = langid.fold(doc_id, 1 << 32)
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
        return F.when(n > 0, F.array_join(place, " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


@query()
def op13_periodic_runs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.find_runs(docs, ["doc_id"]).withColumn("best", periodic_runs.strongest(F.col("hl_runs")))
    return found.select("doc_id", F.size("hl_runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(periodic_runs.lines(F.col("hl_runs")).cast("binary"), 256).alias("runs_sha256"), F.col("hl_digest").alias("collapsed_sha256"))


# --- the stages together --------------------------------------------------------------------


@query()
def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)

"""Packing, the language model, language ID, WARC and mixing."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_duplicates import words

from hearthline.llm import langid, mixing, ngram_lm, packing, warc
from hearthline.llm.store import folder

# --- packing


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def pieces_of(text, limit=1024):
    slow = packing.Encoder("byte_bpe_50k")
    ids = [*slow.exact(text or "").tolist(), 2]
    head = len(ids) % limit or limit
    edges = [0, *range(head, len(ids), limit), len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def laid(rows, limit):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packing_odd_documents(odd_documents, no_documents):
    docs = odd_documents.select("doc_id", "text").collect()
    rows = packing.pack_documents(odd_documents, block_docs=5).collect()
    want = sorted(map(repr, ((r.doc_id, *p) for r in docs for p in pieces_of(r.text))))
    assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows) == want
    laid(rows, 1024)
    assert packing.pack_documents(no_documents).count() == 0


def test_real_documents_pack_tightly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    assert laid(rows, 1024) <= math.ceil(sum(r.length for r in rows) / 1024) * 1.02 + 2
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 9 = 0").collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert all(sorted(by[i]) == pieces_of(t) for i, t in texts.items())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_both_tokenizers_agree(text):
    both = packing.Encoder("byte_bpe_50k")
    assert both(text).tolist() == both.exact(text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_sum_of_squares_by_the_rule(lengths):
    limit, gaps, open_ = 20, Counter(), []
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), limit)
    for i, size in enumerate(lengths):
        fits = {f for f in open_ if f + size <= limit}

        def squares(fill):
            after = gaps.copy()
            after[fill] -= 1
            if fill + size < limit:
                after[fill + size] += 1
            return sum(v * v for v in after.values())

        fill = min(sorted(fits, reverse=True), key=squares) if fits else 0
        assert offsets[i] == fill
        if fits:
            open_.remove(fill)
            gaps[fill] -= 1
        if fill + size < limit:
            open_.append(fill + size)
            gaps[fill + size] += 1
    loads = Counter()
    for b, size in zip(bins, lengths):
        loads[b] += size
    assert all(v <= limit for v in loads.values())


# --- language model


def test_language_model_counts(odd_documents, no_documents):
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    rows = odd_documents.select("doc_id", "text").collect()
    tokens = [[*words(r.text), "\n"] for r in rows]
    count = Counter(w for r, t in zip(rows, tokens) if fold(r.doc_id, 7) != 2 for w in t)
    total = sum(count.values())
    want = sorted((repr(r.doc_id), len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t), 4)) for r, t in zip(rows, tokens))
    got = ngram_lm.interpolated_scores(odd_documents, train).collect()
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    untaught = ngram_lm.interpolated_scores(odd_documents, F.lit(False)).collect()
    assert {(r.base_score, r.score, r.train_tokens, r.n_known) for r in untaught} == {(0.0, 0.0, 0, 0)}
    assert ngram_lm.interpolated_scores(no_documents, train).count() == 0


def test_language_model_by_hand(spark):
    """Probabilities from counts and weights written out, and weights by EM over the deleted events themselves."""
    texts = ["a b a b c", "a b c", "b c a", "a a b", "c c", "a b d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram_lm.interpolated_scores(df, F.lit(True)).collect()}
    lines = [[*t.split(), "$"] for t in texts]
    uni, pairs, ctx = Counter(), Counter(), Counter()
    for t in lines:
        for h, w in zip(["^", *t], t):
            uni[w] += 1
            pairs[h, w] += 1
            ctx[h] += 1
    n, v = sum(uni.values()), len(uni)
    level = lambda c: math.ceil(math.log2(c + 1))
    weight = {}
    events = [(level(ctx[h] - 1), (pairs[h, w] - 1) / max(ctx[h] - 1, 1), (uni[w] - 1) / (n - 1), 1 / (v + 1)) for t in lines for h, w in zip(["^", *t], t)]
    for c in {e[0] for e in events}:
        lam = [1 / 3] * 3
        for _ in range(500):
            new = [0.0] * 3
            own = [e[1:] for e in events if e[0] == c]
            for p in own:
                z = sum(a * b for a, b in zip(lam, p))
                for k in range(3):
                    new[k] += lam[k] * p[k] / z / len(own)
            lam = new
        weight[c] = lam
    for i, t in enumerate(lines):
        want = 0
        for h, w in zip(["^", *t], t):
            lam = weight[level(ctx[h])] if level(ctx[h]) in weight else weight[max(k for k in weight if k <= level(ctx[h]))]
            want += math.log10(lam[0] * pairs[h, w] / ctx[h] + lam[1] * uni[w] / n + lam[2] / (v + 1))
        assert got[i] == pytest.approx(want, rel=0.02)


def test_language_model_beats_add_one(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    out = ngram_lm.interpolated_scores(spark.read.parquet(path), F.col("doc_id") % 7 != 2, file=F.col("_metadata.file_path"), row=F.col("_metadata.row_index")).where("doc_id % 7 = 2")
    r = out.agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.9 * r[1]


def test_planes_and_back():
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], np.uint64)
    assert ngram_lm.unplaned(ngram_lm.planes(x)).tolist() == x.tolist() and len(ngram_lm.unplaned(b"")) == 0


# --- language ID


def best_by_trying(scores, penalty):
    n, m = scores.shape
    value = scores[0].astype(float)
    for t in range(1, n):
        value = np.array([max(value[j] - penalty * (j != k) for j in range(m)) for k in range(m)]) + scores[t]
    return value.max()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 14), min_size=1, max_size=5), st.integers(0, 10_000), st.sampled_from([0.5, 3.0, 8.0]))
def test_viterbi(lengths, seed, penalty):
    rng = np.random.default_rng(seed)
    ptr = np.append(0, np.cumsum(lengths))
    scores = rng.normal(0, 3, (ptr[-1], 3)).astype(np.float32)
    path = langid.best_path(scores, ptr, penalty)
    for a, b in zip(ptr, ptr[1:]):
        if b > a:
            got = scores[np.arange(a, b), path[a:b]].astype(float).sum() - penalty * (np.diff(path[a:b]) != 0).sum()
            assert got == pytest.approx(best_by_trying(scores[a:b], penalty), abs=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, langid.fit(docs.where(langid.fold(F.col("doc_id"), 4) != 2), "text", "lang")


def test_held_out_languages(model):
    docs, fitted = model
    held = docs.where(langid.fold(F.col("doc_id"), 4) == 2)
    out = langid.identify(held, fitted, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.hl_lang for r in out]) > 0.98 and all(0 <= r.hl_score <= 1 for r in out)


def test_mixed_text_has_spans(spark, model):
    docs, fitted = model
    texts = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("n_chars > 2000").collect()}
    a, b = texts["en"], texts["de"]
    row = langid.identify(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), fitted, ["doc_id"], spans=True).first()
    assert [s.lang for s in row.hl_spans][0] == "en" and [s.lang for s in row.hl_spans][-1] == "de" and len(row.hl_spans) == 2
    assert abs(row.hl_spans[1].start - len(a.encode())) < 40


def test_language_of_odd_documents(spark, odd_documents, no_documents, model):
    _, fitted = model
    out = langid.identify(odd_documents, fitted, odd_documents.columns, spans=True)
    assert out.columns == [*odd_documents.columns, "hl_lang", "hl_score", "hl_spans"]
    rows = out.select("doc_id", "text", "hl_lang", "hl_score").collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert (r.hl_lang == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.hl_score <= 1
    assert langid.identify(no_documents, fitted, ["doc_id"]).count() == 0
    empty = langid.fit(no_documents, "text", "lang")
    assert {(r.hl_lang, r.hl_score) for r in langid.identify(odd_documents, empty, ["doc_id"]).collect()} == {("und", 0.0)}


def test_scripts_narrow_candidates(spark):
    docs = spark.createDataFrame([("привет мир и всем", "ru"), ("hello world and all", "en"), (None, "fr"), ("x", None)], "text string, lang string")
    fitted = langid.fit(docs, "text", "lang")
    assert fitted.langs == ["en", "ru"] and fitted.uses[langid.SCRIPT_NAMES.index("cyrillic")].tolist() == [False, True]
    out = langid.identify(spark.createDataFrame([(1, "мир"), (2, "world"), (3, "東京")], "doc_id long, text string"), fitted, ["doc_id"])
    assert {r.doc_id: (r.hl_lang, r.hl_score) for r in out.collect()} == {1: ("ru", 1.0), 2: ("en", 1.0), 3: ("en", 0.0)}


# --- WARC


def test_warc_round_trip(spark):
    big = "<p>é</p>\r\n\r\n" * 200
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (5, "http://a/5", big), (3, None, big), (None, "http://a/n", big), (7, "http://a/\r\nX: 1", "small"), (8, "u", "small"), (9, "u", None), (10, "u", ""), (11, "u", "z" * 300_000), (None, "v", "w" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("x")).withColumn("first", F.lit(1))
    to = folder(spark, "warc-test")
    index = warc.write_archives(df, to)
    got = warc.read_records(index, to).collect()
    assert len(got) == len(rows)
    import hashlib

    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        again = len(data) >= 1000 and t == big and i != 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 5 if again else None, None if again else data))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    some = warc.read_records(index.where("page_id in (1, 11)"), to, with_payload=False).collect()
    assert sorted(r.page_id for r in some) == [1, 11]
    assert warc.archive_and_read(df.limit(0)).count() == 0
    whole = b"".join(open(p, "rb").read() for p in __import__("glob").glob(f"{to.removeprefix('file:')}/*.warc.gz"))
    text = b""
    while whole:
        d = zlib.decompressobj(31)
        text += d.decompress(whole)
        whole = d.unused_data
    assert text.count(b"WARC/1.1\r\n") >= len(rows) and len(re.findall(rb"WARC-Type: revisit", text)) == 3


# --- mixing


def mix_by_hand(totals, target, limit):
    p = np.array([t for t in totals if t > 0], float)
    p /= p.sum()

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    alphas = np.linspace(1, 0, 4001)
    a = next((a for a in alphas if target is None or entropy(a) >= target * math.log(len(p)) - 1e-12), 0.0)
    if limit is not None:
        a = max(a, 1 - math.log(limit) / math.log(p.max() / p.min())) if p.max() > p.min() else a
    return a


@pytest.mark.parametrize("target,limit", [(0.95, 2.0), (0.9, None), (None, 3.0), (None, None), (1.0, None)])
def test_temperature(spark, target, limit):
    totals = [50_000, 900, 3000, 3000, 12_000]
    shares = spark.createDataFrame([(t / sum(totals),) for t in totals], "p double")
    assert mixing.temperature(shares, target, limit) == pytest.approx(1.0 if target is None and limit is None else mix_by_hand(totals, target if target is not None else 0.0, limit), abs=5e-4)


def test_mixture_realises_weights(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "abcd"[min(3, int(rng.geometric(0.6)) - 1)] if i % 50 else None, " ".join(["w"] * int(rng.integers(1, 40)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("block", F.lit(1)).withColumn("passes", F.lit(1))
    tokens, keys = mixing.word_count(F.col("text")), [F.col("doc_id")]
    plan = mixing.mixing_plan(df, "source", tokens, keys, target_entropy=1.0, max_repeats=None)
    got = mixing.copies_of(df, plan, "source", keys).collect()
    assert len(got) == len(rows) and min(r.hl_copies for r in got) == 1
    size, drawn = Counter(), Counter()
    for r in got:
        size[r.source] += len(r.text.split())
        drawn[r.source] += r.hl_copies * len(r.text.split())
    for s in size:
        assert drawn[s] / sum(drawn.values()) == pytest.approx(0.2, abs=0.003)
        ratio = max(size.values()) / size[s]
        assert {r.hl_copies for r in got if r.source == s} <= {math.floor(ratio + 1e-6), math.floor(ratio + 1e-6) + 1}
    out = mixing.mixed(df, "source", tokens, keys, target_entropy=1.0, max_repeats=None)
    assert out.count() == sum(r.hl_copies for r in got) and out.columns == [*df.columns, "hl_pass"]
    half = mixing.copies_of(df, mixing.mixing_plan(df, "source", tokens, keys, None, None, budget=sum(size.values()) // 2), "source", keys)
    assert half.agg(F.sum(F.col("hl_copies") * tokens)).first()[0] == pytest.approx(sum(size.values()) / 2, rel=0.01)


def test_mixture_of_odd_documents(odd_documents, no_documents):
    keys = [F.col("doc_id"), F.xxhash64("text")]
    out = mixing.mixed(odd_documents, "source", mixing.word_count(F.col("text")), keys)
    assert {repr((r.doc_id, r.text)) for r in out.collect()} == {repr((r.doc_id, r.text)) for r in odd_documents.collect()}
    assert mixing.mixed(no_documents, "source", mixing.word_count(F.col("text")), keys).count() == 0

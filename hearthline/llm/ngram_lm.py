"""A bigram language model by deleted interpolation, learned from and scored over whole corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import col, kept
from .words import Splitter, buffers, mix, slices

UNIT_ROWS = 2048  # neighbouring rows whose n-grams are asked for together
END = np.uint64(0x2545F4914F6CDD1D)  # stands for the end of a text among word hashes
START = np.uint64(0x9E6C63D0876A9A47)
STRONG = np.uint64(0x9E3779B97F4A7C15)
OCTAVE = 4  # steps of a factor of two in the table of held-out events
ROUNDS = 200


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: small ones leave planes of zeros, which the shuffle's compression takes away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


class Unit:
    """The tokens of some texts: for each its text, and its place among the distinct words and bigrams."""

    def __init__(self, texts: pa.Table, splitter: Splitter):
        tokens, starts, rows, at = [], [], [], 0
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                words = splitter(*buffers(part.column("text")))
                n = part.num_rows
                token = np.full(len(words.hash) + n, END)
                token[np.arange(len(words.hash)) + words.row] = words.hash
                start = np.zeros(len(token), bool)
                start[words.ptr[:-1] + np.arange(n)] = True
                tokens.append(token)
                starts.append(start)
                rows.append(np.repeat(np.arange(n), np.diff(words.ptr) + 1) + at)
                at += n
        token = np.concatenate(tokens or [np.zeros(0, np.uint64)])
        self.start, self.row = np.concatenate(starts or [np.zeros(0, bool)]), np.concatenate(rows or [np.zeros(0, np.int64)])
        before = np.roll(token, 1)
        before[self.start] = START
        self.keys, self.place = zip(*(np.unique(x, return_inverse=True) for x in (token, mix(before * STRONG + token))))
        self.end = np.searchsorted(self.keys[0], END)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin; a bucket is a range of the highest bits."""
    first = np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, first), len(keys))


def requests(rows: DataFrame, buckets: int) -> DataFrame:
    """From each unit to each bucket: its distinct words (kind 0) and bigrams (kind 1) there, and how often they stand in its training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()

        def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            texts = pa.Table.from_batches(held)
            unit = Unit(texts, splitter)
            train = np.asarray(texts["train"].combine_chunks())[unit.row]
            number, batch = texts["row"], texts["batch"][0].as_py()
            out: dict = {k: [] for k in ("kind", "bucket", "keys", "counts")}
            for kind in (0, 1):
                keys, counts = unit.keys[kind], np.bincount(unit.place[kind][train], minlength=len(unit.keys[kind])).astype(np.uint64)
                edges = bucket_edges(keys, buckets)
                for b in np.flatnonzero(np.diff(edges)):
                    lo, hi = edges[b], edges[b + 1]
                    out["kind"].append(kind)
                    out["bucket"].append(int(b))
                    out["keys"].append(planes(np.diff(keys[lo:hi], prepend=np.uint64(0))))
                    out["counts"].append(planes(counts[lo:hi]))
            n = len(out["kind"])
            ends = {"batch": pa.array([batch] * n, pa.int64()), "first": pa.array([number[0].as_py()] * n, pa.int64()), "last": pa.array([number[-1].as_py()] * n, pa.int64())}
            return pa.RecordBatch.from_pydict(ends | {"kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

        held: list[pa.RecordBatch] = []
        for batch in batches:
            own = np.asarray(batch.column("batch"))
            edges = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            for lo, hi in zip(edges, edges[1:]):
                if held and held[-1].column("batch")[0].as_py() != own[lo]:
                    yield of(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield of(held)

    return rows.mapInArrow(ask, "batch long, first long, last long, kind int, bucket int, keys binary, counts binary")


def replies(asked: DataFrame) -> DataFrame:
    """For each request the counts over all training texts; and a row without a batch for each bucket of words: its tokens and distinct words."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unplaned(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = np.concatenate([unplaned(x) for x in table["counts"].to_pylist()])
        ptr = np.append(0, np.cumsum([len(x) for x in keys]))
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(place.max() + 1, np.uint64)
        np.add.at(total, place, counts)
        mine = total[place]
        out = table.select(["batch", "first", "last", "kind", "bucket"]).append_column("totals", pa.array([planes(mine[a:b]) for a, b in zip(ptr, ptr[1:])], pa.binary()))
        zero = pa.array(np.zeros(len(out), np.int64))
        out = out.append_column("tokens", zero).append_column("words", zero)
        whole = {"batch": [None], "first": [None], "last": [None], "kind": [table["kind"][0].as_py()], "bucket": [table["bucket"][0].as_py()], "totals": [None], "tokens": [int(total.sum())], "words": [int((total > 0).sum())]}
        return pa.concat_tables([out, pa.Table.from_pydict(whole, out.schema)])

    return asked.groupBy("kind", "bucket").applyInArrow(add, "batch long, first long, last long, kind int, bucket int, totals binary, tokens long, words long")


def counted(texts: pa.Table, reply: pa.Table, splitter: Splitter) -> Iterator[tuple[pa.Table, Unit, np.ndarray, np.ndarray, np.ndarray]]:
    """The units of a batch with, for each token, the training counts of it, of its context and of both."""
    texts = texts.sort_by("row")
    number = np.asarray(texts["row"].combine_chunks())
    first, last = (np.asarray(reply[c].combine_chunks()) for c in ("first", "last"))
    kind, bucket = (np.asarray(reply[c].combine_chunks()) for c in ("kind", "bucket"))
    for lo, hi in sorted(set(zip(first.tolist(), last.tolist()))):
        a, b = np.searchsorted(number, [lo, hi + 1])
        own = texts.slice(a, b - a)
        unit, totals = Unit(own, splitter), []
        for k in (0, 1):
            rows = np.flatnonzero((first == lo) & (last == hi) & (kind == k))
            rows = rows[np.argsort(bucket[rows])]
            totals.append(np.concatenate([unplaned(reply["totals"][int(i)].as_py()) for i in rows]).astype(np.int64))
            if len(totals[k]) != len(unit.keys[k]):
                raise ValueError("the rows of a unit have changed between two reads")
        word = totals[0][unit.place[0]]
        context = np.roll(word, 1)
        context[unit.start] = totals[0][unit.end]
        yield own, unit, word, context, totals[1][unit.place[1]]


def class_of(context: np.ndarray) -> np.ndarray:
    """Contexts by frequency: 0, 1, 2-3, 4-7 and so on."""
    return np.ceil(np.log2(context + 1.0)).astype(np.int64)


def held_out_events(joined, total: int, distinct: int) -> DataFrame:
    """How many training tokens have which context class and which ratios of bigram and unigram to the even estimate, each
    token deleted from the counts first. The table's size is bounded by its steps."""

    def tally(texts: pa.Table, reply: pa.Table) -> pa.Table:
        cells: dict[int, int] = {}
        for own, unit, word, context, both in counted(texts, reply, Splitter()):
            train = np.asarray(own["train"].combine_chunks())[unit.row]
            word, context, both = (x[train] - 1 for x in (word, context, both))
            level = lambda p: np.where(p > 0, 1 + np.maximum(0, np.rint(OCTAVE * (np.log2(np.maximum(p, 1e-300) * (distinct + 1)) + 64))), 0).astype(np.int64)
            code = (class_of(context) << 40) + (level(both / np.maximum(context, 1)) << 20) + level(word / max(total - 1, 1))
            for c, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                cells[c] = cells.get(c, 0) + n
        return pa.table({"code": pa.array(list(cells), pa.int64()), "n": pa.array(list(cells.values()), pa.int64())})

    return joined.applyInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def mixture_weights(code: np.ndarray, n: np.ndarray) -> dict[int, tuple[float, float, float]]:
    """Weights of bigram, unigram and even estimate for each context class, by expectation-maximisation."""
    ratio = lambda level: np.where(level > 0, 2.0 ** ((level - 1) / OCTAVE - 64), 0.0)
    out = {}
    for c in np.unique(code >> 40):
        own = code >> 40 == c
        parts = np.stack([ratio(code[own] >> 20 & 0xFFFFF), ratio(code[own] & 0xFFFFF), np.ones(own.sum())])
        weight, count = np.full(3, 1 / 3), n[own].astype(float)
        if c == 0:
            parts[0] = 0
        for _ in range(ROUNDS):
            share = weight[:, None] * parts
            new = (share / share.sum(0) * count).sum(1) / count.sum()
            done = np.abs(new - weight).max() < 1e-9
            weight = new
            if done:
                break
        weight = np.maximum(weight, [0, 0, 1e-6])
        out[int(c)] = tuple(weight / weight.sum())
    return out


def interpolated_scores(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", file: Column | None = None, row: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row, with a model learned from the rows where `train` holds.

    Tokens are the words between white space, A-Z lower-cased, then one end of the text; a null text is empty. The model mixes
    the maximum-likelihood estimates of bigram and unigram and the even one over V + 1 words, with weights for each class of
    the context's frequency, found by expectation-maximisation on training tokens that are each deleted from the counts
    (a held-out set of the whole training corpus). `score` is its log10 probability of the text, `base_score` that of
    add-one unigrams. Without any training text both are 0.

    Neighbouring rows form units. A unit asks the buckets of a hash range for the counts of its distinct words and bigrams, once
    each, and adds its own training counts to the question; so a bucket counts the corpus and answers, and hot
    words take no more room than others. Texts then meet their answers by unit, first to tally the held-out events (a table
    of bounded size goes to the driver), then to be scored. `file` and `row` must name a row's place for good, such
    as the file and row index of a Parquet table; without them a numbered copy is kept first. Rows come back one for
    one, null ids and repeated rows too.
    """
    spark = docs.sparkSession
    if file is None or row is None:
        docs = kept(docs.select(col(doc_id), col(text), train.alias("hl_train")).withColumn("hl_row", F.monotonically_increasing_id()), "numbered")
        train, file, row = F.col("hl_train"), F.lit(""), F.col("hl_row")
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.xxhash64(file, F.floor(row / UNIT_ROWS)).alias("batch"), row.cast("long").alias("row"))
    answers = kept(replies(requests(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))), "answers")
    sums = answers.where("batch is null and kind = 0").agg(F.sum("tokens"), F.sum("words")).first()
    total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    answers = answers.where("batch is not null").select(F.col("batch").alias("of"), "first", "last", "kind", "bucket", "totals")
    joined = rows.groupBy("batch").cogroup(answers.groupBy("of"))
    events = held_out_events(joined, total, distinct).collect() if total else []
    weights = mixture_weights(np.array([e.code for e in events], np.int64), np.array([e.n for e in events], np.int64))
    table = np.array([weights.get(c, weights.get(max((k for k in weights if k <= c), default=0), (0.0, 0.0, 1.0))) for c in range(65)])

    def score(texts: pa.Table, reply: pa.Table) -> pa.Table:
        out = []
        for own, unit, word, context, both in counted(texts, reply, Splitter()):
            n = own.num_rows
            weight = table[class_of(context)]
            p = weight[:, 0] * both / np.maximum(context, 1) + weight[:, 1] * word / max(total, 1) + weight[:, 2] / (distinct + 1)
            base = np.log10((word + 1) / (total + 1 * (distinct + 1)))
            by_row = lambda x: np.bincount(unit.row, x, n)
            out.append(pa.table({
                "doc_id": own["doc_id"], "n_tokens": by_row(None), "n_known": by_row(word > 0).astype(np.int64), "train_tokens": np.full(n, total, np.int64),
                "base_score": by_row(base), "score": by_row(np.log10(p)),
            }))
        return pa.concat_tables(out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")

"""Near-duplicate documents: word n-grams, MinHash candidates pruned by posterior probability, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import col, kept
from .words import Splitter, Words, buffers, mix, packed, slices, unpacked

HASHES = 128
BAND_ROWS = 4  # at a similarity of 0.8 a pair is in none of the 32 bands with a probability of 5e-8
STEP = 16  # MinHash values compared at a time
TOLERANCE = 1e-9  # pairs with a smaller posterior probability of reaching the threshold go
BLOCK = 512  # members of a bucket or group that one task holds against each other
BLOCK_VALUES = 4 << 20  # shingles of a group that one task holds at most, unless one text has more
COLUMNS = 8192  # shingles at a time in the exact count
STRONG = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of each text, and where each text's begin; a text of fewer words has one of all of them."""
    count = np.diff(words.ptr)
    whole = np.zeros(len(words.hash), np.uint64)
    for k in range(n):
        m = max(0, len(whole) - k)
        whole[:m] = whole[:m] * STRONG + words.hash[len(whole) - m :]
    left = words.ptr[words.row + 1] - np.arange(len(words.row))  # words from here to the end of the text
    value = whole[left >= n]
    size = np.where(count >= n, count - n + 1, (count > 0).astype(int))
    ptr = np.append(0, np.cumsum(size))
    out = np.zeros(ptr[-1], np.uint64)
    long_rows = np.repeat(count >= n, size)
    out[long_rows] = value
    for i in np.flatnonzero((count > 0) & (count < n)):
        total = count[i : i + 1].astype(np.uint64)
        for w in words.hash[words.ptr[i] : words.ptr[i + 1]]:
            total = total * STRONG + w
        out[ptr[i]] = total[0]
    return mix(out), ptr


def distinct_sets(words: Words, n: int) -> list[np.ndarray]:
    values, ptr = shingles(words, n)
    return [np.unique(values[a:b]) for a, b in zip(ptr, ptr[1:])]


def digests(sets: list[np.ndarray]) -> list[bytes | None]:
    """128 bits for each set, whatever its order; null for an empty one."""
    return [None if not len(s) else (mix(s ^ STRONG).sum(dtype=np.uint64)).tobytes() + (mix(s + STRONG).sum(dtype=np.uint64)).tobytes() for s in sets]


def signature(values: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        y = multipliers[:, None] * x[None, at : at + 4096]
        y += offsets[:, None]
        np.minimum(low, y.min(1), out=low)
    return low


def hash_functions(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For each number of compared values the least number of equal ones at which the similarity, uniform beforehand, reaches
    the threshold with a probability of `tolerance` or more."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        for m in range(n + 1):
            density = np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1) + m * np.log(x) + (n - m) * np.log1p(-x))
            if density[x >= threshold].sum() / len(x) >= tolerance:
                out[n] = m
                break
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the root of their tree, for the graph with edges (a, b) over n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = 200_000) -> Iterator[pa.Table]:
    """Batches sorted by `keys`, put together so that no group is cut: tables of whole groups, of about `limit` rows or one group."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cut(table: pa.Table) -> int:
        """Where the last group begins."""
        at = len(table)
        for k in keys:
            last = np.asarray(table[k].combine_chunks())
            at_k = len(last) - int((last[::-1] != last[-1]).argmax()) if (last != last[-1]).any() else 0
            at = at_k if k == keys[0] else max(at, at_k)
        return at

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            table = pa.Table.from_batches(held)
            at = cut(table)
            if at:
                yield table.slice(0, at)
            held = table.slice(at).to_batches()
            size = len(table) - at
    if size:
        yield pa.Table.from_batches(held)


def starts_of(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of each group, and the number of rows."""
    new = np.zeros(len(table), bool)
    new[0] = True
    for k in keys:
        x = np.asarray(table[k].combine_chunks())
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(table))


def sets_by_document(docs: DataFrame, n: int) -> DataFrame:
    """Columns of `docs` but text, then node (digest of its shingle set, null if it has no word), n_shingles, sig and bands."""
    multipliers, offsets = hash_functions(20)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = distinct_sets(splitter(*buffers(part.column("text"))), n)
                sig = np.zeros((len(sets), HASHES), np.uint32)
                for i, s in enumerate(sets):
                    sig[i] = signature(s, multipliers, offsets)
                bands = np.zeros((len(sets), HASHES // BAND_ROWS), np.uint64)
                for k in range(bands.shape[1]):
                    key = np.full(len(sets), k + 1, np.uint64)
                    for j in range(k * BAND_ROWS, (k + 1) * BAND_ROWS):
                        key = mix(key * STRONG + sig[:, j])
                    bands[:, k] = key
                flat = pa.array(bands.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1], flat)
                yield pa.RecordBatch.from_pydict(
                    {c: part.column(c) for c in part.schema.names if c != "text"}
                    | {"node": pa.array(digests(sets), pa.binary()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "sig": packed((sig >> np.uint32(16)).astype(np.uint16), np.arange(len(sets) + 1)), "bands": lists}
                )

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(sign, f"{own}, node binary, n_shingles long, sig binary, bands array<long>")


def likely_edges(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that join all members of a bucket which pairs above the posterior tolerance connect.

    `members` has key, i, j, block, node, sig: a bucket's block of members, or two of them to be held against each other.
    """
    need = least_matches(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "i", "j"]
        for table in groups_of(batches, keys, 50_000):
            starts = starts_of(table, keys)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            sig = unpacked(table["sig"], np.uint16)[0].reshape(len(table), HASHES)
            block = np.asarray(table["block"].combine_chunks())
            apart = np.asarray(table["i"].combine_chunks()) != np.asarray(table["j"].combine_chunks())
            found = []
            left = np.arange(len(table))
            k = 0
            while len(left):
                k += 1
                left = left[left + k < len(table)]
                left = left[group[left] == group[left + k]]
                a = left[~(apart[left] & (block[left] == block[left + k]))]
                b, equal = a + k, np.zeros(len(a), np.int64)
                for at in range(0, HASHES, STEP):
                    equal += (sig[a, at : at + STEP] == sig[b, at : at + STEP]).sum(1)
                    keep = equal >= need[at + STEP]
                    a, b, equal = a[keep], b[keep], equal[keep]
                    if not len(a):
                        break
                if len(a):
                    found.append((a, b))
            if found:
                a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]), len(table))
                nodes = table["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], ["a", "b"])

    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a binary, b binary")


def block_pairs(rows: DataFrame, blocks: str, *keys: str) -> DataFrame:
    """Each row once for every pair of blocks (i <= j) that has its own block, so that each two rows of a key meet in just one
    (i, j), or in (i, i) if they are in one block."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, cast({blocks} as int) - 1)")))
    return rows.select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", *[c for c in rows.columns if c in ("sig", "values", "copies")])


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """From group members (root, i, j, block, node, copies, values): for each node its number of links (with b null), and edges (a, b) that
    connect what verified pairs connect. Intersections are counted exactly, some thousand shingles at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["root", "i", "j"]
        for table in groups_of(batches, keys, 20_000):
            starts = starts_of(table, keys)
            rows_a, rows_b, links = [], [], np.zeros(len(table), np.int64)
            block, copies = np.asarray(table["block"].combine_chunks()), np.asarray(table["copies"].combine_chunks())
            apart = np.asarray(table["i"].combine_chunks()) != np.asarray(table["j"].combine_chunks())
            values, ptr = unpacked(table["values"], np.uint64)
            for lo, hi in zip(starts, starts[1:]):
                size = np.diff(ptr[lo : hi + 1])
                common = intersections(values[ptr[lo] : ptr[hi]], np.repeat(np.arange(hi - lo), size), hi - lo)
                similar = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
                np.fill_diagonal(similar, False)
                if apart[lo]:
                    similar &= block[lo:hi, None] != block[None, lo:hi]
                links[lo:hi] = similar @ copies[lo:hi]
                a, b = np.nonzero(np.triu(similar))
                rows_a.append(a + lo)
                rows_b.append(b + lo)
            nodes = table["node"].combine_chunks()
            yield pa.RecordBatch.from_arrays([nodes, pa.nulls(len(table), pa.binary()), pa.array(links)], ["a", "b", "links"])
            a, b = forest(np.concatenate(rows_a), np.concatenate(rows_b), len(table))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b)), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "links"])

    return members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(count, "a binary, b binary, links long")


def intersections(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets share; `row` names the set of each value."""
    common = np.zeros((n, n), np.int64)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    code = np.cumsum(new) - 1
    shared = np.bincount(code)[code] > 1 if len(code) else new
    np.fill_diagonal(common, np.bincount(row, minlength=n))
    row, code = row[shared], code[shared]
    code = np.cumsum(np.append(True, code[1:] != code[:-1])) - 1 if len(code) else code
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        lo, hi = np.searchsorted(code, [at, at + COLUMNS])
        held, place = np.unique(row[lo:hi], return_inverse=True)
        table = np.zeros((len(held), COLUMNS), np.float32)
        table[place, code[lo:hi] - at] = 1
        part = (table @ table.T).astype(np.int64)
        np.fill_diagonal(part, 0)
        common[np.ix_(held, held)] += part
    return common


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, n_links and, to find the row again, text_hash (xxhash64 of the text) and first (whether it stands for its class); a row for every row of `docs`.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams (A-Z lower-cased, words between
    white space; fewer than n words make one gram) is `threshold` or more. n_links counts the other rows linked to a row, copies of it
    among them; a class is what links connect, class_id the smallest id in it. A text that is null or has no word has
    no link and is alone; its class_id is its own id. Null ids count as larger than others, and a class of nothing else has a null class_id.
    Rows with the same id and text are copies of each other like any; `first` holds for all of those that equal the class's first.

    Copies (equal sets) are one node from the start, so that none is expanded. Nodes meet in the buckets of 32 bands of
    four MinHash values. In a bucket 16 values are compared at a time, and a pair is dropped once the posterior probability that
    it reaches the threshold is below `tolerance`. The rest connects nodes into groups; of these, and only these, the
    n-grams are fetched, and all pairs within a group are counted exactly. Buckets and groups of any size are split
    into pairs of bounded blocks, and a task returns counts and a spanning forest, never all pairs. The chance that a link is
    lost is that of missing all bands (5e-8 at a similarity of 0.8, less above) plus the tolerance.
    """
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.xxhash64(col(text)).alias("text_hash"), col(text).alias("text"))
    signed = kept(sets_by_document(rows, n), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")
    )
    nodes = kept(nodes, "nodes")
    bands = nodes.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    members = bands.join(buckets, "key").join(nodes.select("node", "sig"), "node")
    likely = kept(likely_edges(block_pairs(members, "blocks", "key"), threshold, tolerance), "likely")
    groups = kept(components(likely), "groups")
    held = nodes.select("node", "rep", "copies", "n_shingles").join(groups, "node")
    sizes = held.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("values"))
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("values") / BLOCK_VALUES)).alias("blocks"))
    held = held.join(sizes, "root").select("node", "root", "copies", "blocks", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    fetched = rows.join(held, rows["doc_id"].eqNullSafe(held["rep_id"]) & (rows["text_hash"] == held["rep_hash"])).select("node", "root", "copies", "blocks", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = distinct_sets(splitter(*buffers(part.column("text"))), n)
                at = np.append(0, np.cumsum([len(s) for s in sets]))
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in ("node", "root", "copies", "blocks")} | {"values": packed(np.concatenate(sets), at)})

    fetched = fetched.mapInArrow(gather, "node binary, root binary, copies long, blocks long, values binary").dropDuplicates(["node"])
    found = kept(verified(block_pairs(fetched, "blocks", "root"), threshold), "verified")
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classes = kept(components(found.where("b is not null")), "classes")
    of_node = nodes.select("node", "rep", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = of_node.groupBy("root").agg(F.min("rep").alias("class_rep"))
    of_node = of_node.join(first, "root").select("node", "copies", "class_rep", F.coalesce("links", F.lit(0)).alias("links"))
    out = signed.select("doc_id", "text_hash", "node").join(of_node, "node", "left")
    alone = F.col("class_rep").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_rep.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("copies") - 1 + F.col("links")).cast("long").alias("n_links"),
        "text_hash",
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_rep.doc_id")) & (F.col("text_hash") == F.col("class_rep.text_hash")))).alias("first"),
    )

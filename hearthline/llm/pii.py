"""Personal data: addresses and numbers by pattern, and the terms around them that tell whose they are.

Each address or number found is an entity to protect. A term beside it, of whatever kind, reveals it as far as the two occur together: with N
texts, of which n(e) have the entity, n(t) the term and n(e,t) the term beside the entity, their pointwise mutual information
log N n(e,t) / n(e) n(t) is at most the entity's own information log N / n(e), and reaches it where the term never occurs elsewhere.
Terms that disclose more than a threshold share of it are generalised to all terms of the same beginning, if that discloses less
than the threshold, and removed otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.operators.skew import lookup_join

from .store import col, kept
from .words import Splitter, buffers, mix, slices

KINDS = ["email", "ip", "card", "phone"]
TERM = len(KINDS)  # kind of the spans that co-occurrence adds
WINDOW = 8  # terms on either side of an entity that stand beside it
DISCLOSURE = 0.8  # share of the entity's information
BEGINNING = 4  # bytes of the beginning that generalised terms share, cut back to whole characters
SHORTEST = 3  # bytes of a term
FILTER_BITS = 1 << 24  # of the filter of terms to count; at most FILTER_BITS / 64 rows reach the driver, at any size
FLUSH = 1 << 20  # counted terms that a task holds

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# without going back and forth in long runs of digits: a match begins where a run does and takes it whole
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

SPAN = "struct<start: long, kind: int, stop: long, action: string>"
NEAR = "struct<entity: long, term: long, beginning: long, start: long, stop: long, first: boolean, first_beginning: boolean>"
FAR = "struct<term: long, start: long, stop: long>"


# --- patterns -------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, stop, the entity's value) by start and kind; kinds may overlap each other. Time is linear in the text."""
    out, last = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            out.append((start, 0, last, text[start:last].lower()))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            out.append((m.start(), 1, m.end(), m[0]))
    for kind, pattern in ((2, CARD), (3, PHONE)):
        for m in pattern.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end(), digits))
    return sorted(out)


# --- terms ----------------------------------------------------------------------------------


class Terms:
    """The terms of texts: runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased; and the hash of each one's beginning."""

    def __init__(self, splitter: Splitter, data: np.ndarray, offsets: np.ndarray):
        words = splitter(data, offsets, LETTER[data])
        long = words.end - words.start >= SHORTEST
        self.row, self.start, self.end, self.hash = words.row[long], words.start[long], words.end[long], words.hash[long].view(np.int64)
        stop = np.minimum(self.end, self.start + BEGINNING)
        for _ in range(3):
            inside = np.flatnonzero(stop < self.end)
            stop[inside[(words.data[stop[inside]] & 0xC0) == 0x80]] -= 1
        up, down = splitter.powers(len(data) + 1)
        total = np.append(np.uint64(0), np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64))
        value = (total[stop] - total[self.start]) * down[self.start] + (stop - self.start).astype(np.uint64)
        self.beginning = mix(value ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
        self.ptr = np.searchsorted(self.row, np.arange(len(offsets)))


def entity_hash(kind: int, value: str) -> int:
    return int.from_bytes(blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def beside(found: list[tuple[int, int, int, str]], entities: list[int], start: np.ndarray, stop: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entity, term number) of the terms at most `window` terms from a span of the entity, but for those that stand in any span; and the numbers of all
    terms that stand in none."""
    edges = np.array([(a, b) for a, _, b, _ in found])
    reach = np.maximum.accumulate(edges[:, 1])
    before = np.searchsorted(edges[:, 0], stop, "left")  # spans that begin before a term ends
    free = np.flatnonzero((before == 0) | (reach[before - 1] <= start))
    pairs = []
    for entity, (a, b) in zip(entities, edges):
        left, right = np.searchsorted(stop[free], a, "right"), np.searchsorted(start[free], b, "left")
        near = np.concatenate([free[max(0, left - window) : left], free[right : right + window]])
        pairs.append((np.full(len(near), entity, np.int64), near))
    return *(np.concatenate(x) for x in zip(*pairs)), free


def first_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are the first of their kind."""
    first = np.zeros(len(a), bool)
    first[np.unique(np.stack([a, b]), axis=1, return_index=True)[1]] = True
    return first


# --- the corpus -----------------------------------------------------------------------------


def find(docs: DataFrame, carry: list[str], text: str, window: int, with_text: bool) -> DataFrame:
    """A row for each row of `docs`: `carry`, hl_row, hl_hash (of the text), hl_base (spans by pattern), hl_entities, hl_near (the terms
    beside them), hl_far (the other places of those terms in the text) and, if asked for, hl_text of rows with spans. Written to the shared folder."""
    rows = docs.select(*[col(c) for c in carry], F.coalesce(col(text).cast("string"), F.lit("")).alias("hl_text"))
    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    rows = rows.select(*rows.columns, F.xxhash64("hl_text").alias("hl_hash"), F.monotonically_increasing_id().alias("hl_row"))
    schema = own + f"hl_row long, hl_hash long, hl_base array<{SPAN}>, hl_entities array<long>, hl_near array<{NEAR}>, hl_far array<{FAR}>, hl_text string"
    near_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("entity", "term", "beginning", "start", "stop")] + [("first", pa.bool_()), ("first_beginning", pa.bool_())]))
    far_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("term", "start", "stop")]))
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("action", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for part in slices(batch, "hl_text"):
                texts, n = part.column("hl_text"), part.num_rows
                data, offsets = buffers(texts)
                marks = np.flatnonzero((data == ord("@")) | ((data >= ord("0")) & (data <= ord("9"))))
                bases, entities, near, far = ([[] for _ in range(n)] for _ in range(4))
                for i in np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist():
                    found = pattern_spans(texts[i].as_py())
                    if not found:
                        continue
                    bases[i] = [{"start": a, "kind": k, "stop": b, "action": "replace"} for a, k, b, _ in found]
                    ids = [entity_hash(k, v) for _, k, _, v in found]
                    entities[i] = sorted(set(ids))
                    mine = data[offsets[i] : offsets[i + 1]]
                    terms = Terms(splitter, mine, np.array([0, len(mine)]))
                    place = np.append(0, np.cumsum((mine & 0xC0) != 0x80))
                    start, stop = place[terms.start], place[terms.end]
                    entity, at, free = beside(found, ids, start, stop, window)
                    if len(at):
                        term, beginning = terms.hash[at], terms.beginning[at]
                        columns = (entity, term, beginning, start[at], stop[at], first_of(entity, term), first_of(entity, beginning))
                        near[i] = [dict(zip(("entity", "term", "beginning", "start", "stop", "first", "first_beginning"), r)) for r in zip(*(c.tolist() for c in columns))]
                        again = np.setdiff1d(free[np.isin(terms.hash[free], term)], at)
                        far[i] = [dict(zip(("term", "start", "stop"), r)) for r in zip(*(c[again].tolist() for c in (terms.hash, start, stop)))]
                made = {c: part.column(c) for c in (*carry, "hl_row", "hl_hash")} | {"hl_base": pa.array(bases, base_type), "hl_entities": pa.array(entities, pa.list_(pa.int64())), "hl_near": pa.array(near, near_type), "hl_far": pa.array(far, far_type)}
                keep = [t if with_text and b else None for t, b in zip(texts.to_pylist(), bases)] if with_text else [None] * n
                yield pa.RecordBatch.from_pydict(made | {"hl_text": pa.array(keep, pa.string())})

    return kept(rows.mapInArrow(read, schema), "pii-found")


def counted(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(term, n): in how many rows of `docs` each term or beginning of `wanted` (a column of hashes) occurs, and maybe some others.

    A filter of fixed size leaves out nearly all other terms before they are counted; each task adds up its own."""
    place = F.pmod(F.col("term"), F.lit(FILTER_BITS))
    filled = wanted.select(place.alias("p")).groupBy(F.expr("p div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(words.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little").view(bool)
        splitter, sums, held = Splitter(), [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in sums]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([c for _, c in sums])).astype(np.int64)

        for batch in batches:
            for part in slices(batch, "text"):
                terms = Terms(splitter, *buffers(part.column("text")))
                for hashes in (terms.hash, terms.beginning):
                    ok = mask[hashes % FILTER_BITS]
                    row, term = terms.row[ok], hashes[ok]
                    order = np.lexsort((term, row))
                    row, term = row[order], term[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))[: len(row)]
                    keys, n = np.unique(term[new], return_counts=True)
                    sums.append((keys, n))
                    held += len(keys)
                if held > FLUSH:
                    sums = [total()]
                    held = len(sums[0][0])
                    if held > FLUSH:
                        yield pa.RecordBatch.from_pydict({"term": pa.array(sums[0][0]), "n": pa.array(sums[0][1])})
                        sums, held = [], 0
        if sums:
            keys, n = total()
            yield pa.RecordBatch.from_pydict({"term": pa.array(keys), "n": pa.array(n)})

    texts = docs.select(col(text).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def share(together: Column, term: Column, entity: Column, texts: int) -> Column:
    """How much of the entity's information the term gives, at most 1; null if all texts have the entity."""
    whole = F.log(F.lit(float(texts)) / entity)
    return F.when(entity < texts, F.log(F.lit(float(texts)) * together / (entity * term)) / whole)


def revealing(docs: DataFrame, text: str, found: DataFrame, disclosure: float) -> DataFrame:
    """(entity, term, action) of the terms that disclose at least that share of an entity, and stand beside it in two different texts or more."""
    texts = found.count()
    near = found.select("hl_hash", F.explode("hl_near").alias("x")).select("hl_hash", "x.*")
    pairs = near.where("first").groupBy("entity", "term").agg(
        F.count("*").alias("n_both"), F.first("beginning").alias("beginning"), F.min("hl_hash").alias("low"), F.max("hl_hash").alias("high"))
    pairs = kept(pairs.where("low <> high").drop("low", "high"), "pii-pairs")
    empty = pairs.select("entity", "term", F.lit("").alias("action")).limit(0)
    if pairs.isEmpty():
        return empty
    counts = kept(counted(docs, text, pairs.select(F.explode(F.array("term", "beginning")).alias("term"))), "pii-counts")
    owners = kept(found.select(F.explode("hl_entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "pii-entities")
    judged = lookup_join(lookup_join(pairs, owners, ["entity"], "inner"), counts.withColumnRenamed("n", "n_term"), ["term"], "inner")
    judged = kept(judged.where(share(F.col("n_both"), F.col("n_term"), F.col("n_entity"), texts) >= disclosure), "pii-revealing")
    wider = near.where("first_beginning").groupBy("entity", "beginning").agg(F.count("*").alias("n_both_wider"))
    judged = lookup_join(judged, wider, ["entity", "beginning"], "inner")
    judged = lookup_join(judged, counts.select(F.col("term").alias("beginning"), F.col("n").alias("n_wider")), ["beginning"], "inner")
    still = share(F.col("n_both_wider"), F.col("n_wider"), F.col("n_entity"), texts) >= disclosure
    return kept(judged.select("entity", "term", F.when(still, "remove").otherwise("generalise").alias("action")), "pii-actions")


LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]


def rewritten(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with labels for what patterns found, beginnings for generalised terms and dots for removed ones; spans that overlap go as one."""
    out, at = [], 0
    for start, kind, stop, action in spans:
        if start >= at:
            begin = text[start:stop].encode()[:BEGINNING].decode(errors="ignore") if action == "generalise" else ""
            out += [text[at:start], LABELS[kind] if kind < TERM else f"{begin}…"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, carry: list[str], text: str = "text", window: int = WINDOW, disclosure: float = DISCLOSURE, with_text: bool = False) -> DataFrame:
    """`carry` and hl_spans (start, kind, stop, action; code points, by start, then kind) of every row of `docs`, and, if asked for, hl_text: the sanitised text, null
    where nothing is to be changed.

    Kinds are 0 email, 1 ip, 2 card, 3 phone, by pattern, with action `replace`, and 4 for terms that co-occurrence adds, with action
    `generalise` or `remove`, in the texts where they stand beside the entity: there, and at any other place outside entities. Counts are of rows, copies too, over the whole
    table; but a term must stand beside an entity in two different texts to count as a link at all. A null text counts as empty; rows,
    repeated ones too, come back one for one; columns not carried don't matter.
    """
    found = find(docs, carry, text, window, with_text)
    actions = revealing(docs, text, found, disclosure)
    near = found.select("hl_row", F.explode("hl_near").alias("x")).select("hl_row", "x.entity", "x.term", "x.start", "x.stop")
    beside_it = kept(lookup_join(near, actions, ["entity", "term"], "inner").select("hl_row", "term", "start", "stop", "action"), "pii-beside")
    held = beside_it.groupBy("hl_row", "term").agg(F.max("action").alias("other"))
    far = found.select("hl_row", F.explode("hl_far").alias("x")).select("hl_row", "x.term", "x.start", "x.stop")
    places = near.select("hl_row", "term", "start", "stop").unionByName(far).join(held, ["hl_row", "term"]).drop("term")
    both_ways = places.withColumn("action", F.lit(None).cast("string")).unionByName(beside_it.drop("term").withColumn("other", F.lit(None).cast("string")))
    marked = both_ways.groupBy("hl_row", "start", "stop").agg(F.coalesce(F.max("action"), F.max("other")).alias("action"))
    added = marked.groupBy("hl_row").agg(F.collect_list(F.struct("start", F.lit(TERM).alias("kind"), "stop", "action")).alias("hl_added"))
    both = F.sort_array(F.concat("hl_base", F.coalesce("hl_added", F.expr(f"cast(array() as array<{SPAN}>)"))))
    joined = found.select(*carry, "hl_row", "hl_base", "hl_text").join(added, "hl_row", "left").select(*carry, both.alias("hl_spans"), "hl_text", "hl_row")
    if not with_text:
        return joined.drop("hl_text", "hl_row")

    @F.udf("string", useArrow=True)
    def new_text(old: str | None, spans: list) -> str | None:
        return old and rewritten(old, [tuple(s) for s in spans])

    return joined.select(*carry, "hl_spans", new_text("hl_text", "hl_spans").alias("hl_text"))


def of_kind(kind: int):
    return lambda span: span["kind"] == kind


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

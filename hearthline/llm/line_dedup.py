"""Near-duplicate lines: an exact set-similarity join by prefix, position and length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .store import col, kept
from .words import Splitter, buffers, mix, packed, slices, unpacked

CELLS = 1 << 20  # of the table of word frequencies; its size doesn't grow with the corpus
CHUNKS = 64
PARTS = 64
HOT = 1024  # words counted more often are looked up together with a second word
KEEP = 256  # earlier candidates that an entry passes on at most, those of the nearest bit patterns
RISK = 0.1  # they end where it is less likely than this that none of them matches
HELD = 1024  # further candidates that are kept in packed form, for the case that none passed on matches; none in a task that would hold MOST
SURE = 1e-6  # less likely than this is no such case
LONG = 192  # words from which a line's entries have a pattern of WIDE bits; 128 bits say little about longer lines
PATTERN = 128
WIDE = 1024
TRIED = 1 << 18  # pairs of neighbours under a key that are looked at together
PAIRS = 500_000  # pairs that a task holds before it drops those that no line passes on
MOST = 2_000_000
SENT = 400_000  # entries that a task gathers before it sends them
FEW = 20_000  # documents up to which their ids are broadcast
LINES = 1 << 20  # lines worked through at a time
NEWLINE = 10
LAST = np.iinfo(np.int64).max  # the place of a null id
STRONG = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lines:
    """The lines with words of some texts: their sets of words (44 bits each), in `order` of hash or rarity."""

    row: np.ndarray
    number: np.ndarray  # of the line in its text, from 0
    ptr: np.ndarray  # the words of line i are token[ptr[i]] to token[ptr[i + 1]]
    token: np.ndarray
    line: np.ndarray  # of each token

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.ptr[:-1]) if len(self.row) else np.zeros(0, values.dtype)

    def only(self, which: np.ndarray) -> Lines:
        size = np.diff(self.ptr)
        kept_words = np.zeros(len(self.row), bool)
        kept_words[which] = True
        return Lines(self.row[which], self.number[which], np.append(0, np.cumsum(size[which])), self.token[kept_words[self.line]], np.repeat(np.arange(len(which)), size[which]))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each line's set."""
        return self.sums(mix(self.token)), self.sums(mix(self.token + STRONG))

    def pattern(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line's set; those of two lines differ in no more bits than the sets in words."""
        bit = self.token & np.uint64(PATTERN - 1)  # tokens are hashes
        shifted = np.uint64(1) << (bit & np.uint64(63))
        low, high = (np.bitwise_xor.reduceat(np.where(bit < 64 if k == 0 else bit >= 64, shifted, np.uint64(0)), self.ptr[:-1]) for k in (0, 1))
        return low, high


def lines_of(texts: pa.Array, splitter: Splitter) -> Iterator[Lines]:
    data, offsets = buffers(texts)
    breaks = np.flatnonzero(data == NEWLINE) + 1
    edge = np.union1d(offsets, breaks)  # a text's end and the next one's begin are one border
    hashes, at = splitter.hashes(data, edge)
    full = np.flatnonzero(np.diff(at))  # empty lines and texts have no words
    row = np.searchsorted(offsets, edge[full], "right") - 1
    number = np.searchsorted(breaks, edge[full], "right") - np.searchsorted(breaks, offsets[row], "right")
    for first in range(0, len(full), LINES):
        own = full[first : first + LINES]
        lo, hi = at[own[0]], at[own[-1] + 1]
        size = np.diff(at)[own]
        line = np.repeat(np.arange(len(own), dtype=np.uint64), size)
        key = np.sort(line << np.uint64(44) | hashes[lo:hi] >> np.uint64(20))
        key = key[np.append(True, key[1:] != key[:-1])]
        line = (key >> np.uint64(44)).astype(np.int64)
        ptr = np.append(0, np.cumsum(np.bincount(line, minlength=len(own))))
        yield Lines(row[first : first + LINES], number[first : first + LINES], ptr, key & np.uint64((1 << 44) - 1), line)


def table_of(parts: DataFrame) -> np.ndarray:
    """Sums of tables of CELLS counts, sent in CHUNKS pieces by each task; two levels, then one table of that size to the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()], pa.int32()), "part": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    for by in (["chunk", "part"], ["chunk"]):
        parts = parts.groupBy(*by).applyInArrow(add, "chunk int, part int, counts binary")
    out = np.zeros(CELLS, np.int64)
    for r in parts.collect():
        out[r.chunk * (CELLS // CHUNKS) : (r.chunk + 1) * (CELLS // CHUNKS)] = np.frombuffer(r.counts, np.int64)
    return out


def chunks_of(counts: np.ndarray) -> pa.RecordBatch:
    pieces = counts.reshape(CHUNKS, -1)
    used = np.flatnonzero(pieces.any(1))
    part = TaskContext.get().partitionId() // PARTS
    return pa.RecordBatch.from_pydict({"chunk": pa.array(used, pa.int32()), "part": pa.array([part] * len(used), pa.int32()), "counts": pa.array([pieces[i].tobytes() for i in used], pa.binary())})


def census(rows: DataFrame, buckets: int) -> DataFrame:
    """From one pass over the texts: pieces of the table of word frequencies (`counts`), by the highest bits of the words' hashes, and
    the names and places of all lines with words, packed by ranges of names (`bucket`). """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = Splitter(), np.zeros(CELLS, np.int64)
        held: list[np.ndarray] = []
        places: list[list[np.ndarray]] = []

        def add(least: int) -> None:
            if sum(map(len, held)) > least:
                counts[:] += np.bincount(np.concatenate(held), minlength=CELLS)
                held.clear()

        def sent(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW_CENSUS], schema=ARROW_CENSUS)

        def send() -> pa.RecordBatch:
            name, more, doc, digest, number = (np.concatenate(v) for v in zip(*places))
            places.clear()
            bucket = ((name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            values = [v[order] for v in (name, more, doc, digest, number)]
            data = [b"".join(encoded(v[edge[b] : edge[b + 1]]) for v in values) for b in used]
            return sent(bucket=pa.array(used), places=pa.array(data, pa.binary()))

        for batch in batches:
            for part in slices(batch, "text"):
                doc, digest = (np.asarray(part.column(c).fill_null(x)) for c, x in (("doc_id", LAST), ("text_hash", 0)))
                for lines in lines_of(part.column("text"), splitter):
                    # a word counts once for each line that holds it
                    held.append((lines.token >> np.uint64(24)).astype(np.int64))
                    add(CELLS)
                    places.append([*lines.names(), doc[lines.row], digest[lines.row], lines.number])
                    if sum(len(p[0]) for p in places) > SENT:
                        yield send()
        add(0)
        if places:
            yield send()
        pieces = chunks_of(counts)
        yield sent(**dict(zip(pieces.schema.names, pieces.columns)))

    return kept(rows.mapInArrow(count, "chunk int, part int, counts binary, bucket int, places binary"), "line-census")


ARROW_CENSUS = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("bucket", pa.int32()), ("places", pa.binary())])


def name_table(names: DataFrame) -> np.ndarray:
    """A table in which the cells of the given names (longs) are not 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += np.bincount((mix(np.asarray(batch.column(0)).view(np.uint64)) >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        yield chunks_of(counts)

    return table_of(names.mapInArrow(count, "chunk int, part int, counts binary"))


def required(size: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap of a set of `size` with any set that it matches."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


# what an entry holds, in this order, by byte planes
FIELDS = [("key", np.uint32), ("name", np.uint64), ("size", np.uint32), ("at", np.uint8), ("before", np.uint64), ("between", np.uint64), ("doc", np.int64), ("line", np.uint32), ("bits0", np.uint64), ("bits1", np.uint64)]


WIDTH = {"before": 5, "between": 5}  # bytes sent of a field, if not all


def encoded(values: np.ndarray, width: int | None = None) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T[:width]).tobytes()


def decoded(data: bytes, kind, width: int | None = None) -> np.ndarray:
    whole = np.dtype(kind).itemsize
    planes = np.frombuffer(data, np.uint8).reshape(width or whole, -1)
    out = np.zeros((planes.shape[1], whole), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


@dataclass
class Keys:
    """The index keys of some lines, one for each entry."""

    key: np.ndarray
    line: np.ndarray
    place: np.ndarray  # of the entry's (first) word in its line, the rarest words first
    before: np.ndarray  # the word before it that has entries, 0 if there is none
    between: np.ndarray  # of an entry of two words that don't follow each other: the word before the second, else 0


def keys(lines: Lines, counts: np.ndarray, threshold: float) -> Keys:
    """One key for each word of the prefix, the rarest words first.

    Two lines that match share a word of both prefixes. Words of a single line lead nowhere. A word counted more than
    HOT times goes with each of the following words up to one place behind the prefix, one of which the lines share as well;
    where a single shared word is enough for a match, it has a key of its own, too.
    Two lines that meet under a key and have the same word before it, or the same word between, also meet under an earlier key:
    that word's own, that word with the second one, or the first one with that word.
    """
    size = np.diff(lines.ptr)
    count = np.minimum(counts[(lines.token >> np.uint64(24)).astype(np.int64)], (1 << 24) - 1).astype(np.uint64)
    place = np.arange(len(lines.token)) - lines.ptr[lines.line]
    least = required(size, threshold)
    prefix = size - least + 1
    front = np.flatnonzero(place <= prefix[lines.line])  # and one more
    if size.max() < 1 << 20:
        order = np.sort(lines.line.astype(np.uint64) << np.uint64(44) | count << np.uint64(20) | place.astype(np.uint64))[front]
        order = lines.ptr[lines.line[front]] + (order & np.uint64((1 << 20) - 1)).astype(np.int64)
    else:
        order = np.lexsort((place, count, lines.line))[front]
    token, count, place, line = lines.token[order], count[order], place[front], lines.line[front]
    # a line of one word matches others up to 1 / threshold words
    own = np.flatnonzero((place < prefix[line]) & (count > 1) & (size[line] > (1 if threshold > 0.5 else 0)))
    sign = mix(token ^ STRONG) | np.uint64(1)
    previous = np.zeros(len(token), np.uint64)
    near = line[own[1:]] == line[own[:-1]]
    previous[own[1:][near]] = sign[own[:-1][near]]
    cold, hot = own[count[own] <= HOT], own[count[own] > HOT]
    single = hot[least[line[hot]] <= 1]
    at, key, before, between = [cold, single], [mix(token[cold]), mix(token[single])], [previous[cold], np.zeros(len(single), np.uint64)], [np.zeros(len(cold) + len(single), np.uint64)]
    step, last = 1, np.minimum(prefix, size - 1)
    while len(hot):
        hot = hot[place[hot] + step <= last[line[hot]]]
        at.append(hot)
        key.append(mix(token[hot] * STRONG + token[hot + step]))
        before.append(previous[hot])
        between.append(sign[hot + step - 1] if step > 1 else np.zeros(len(hot), np.uint64))
        step += 1
    at = np.concatenate(at)
    return Keys((np.concatenate(key) >> np.uint64(32)).astype(np.uint32), line[at], place[at], np.concatenate(before), np.concatenate(between))


def entries(lines: Lines, names: np.ndarray, doc: np.ndarray, counts: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The index entries of lines, one for each key; `wide` has the patterns of the entries of LONG lines only."""
    size = np.diff(lines.ptr)
    low, high = lines.pattern()
    own = keys(lines, counts, threshold)
    i = own.line
    long = np.flatnonzero(size >= LONG)
    wide = np.zeros((len(long), WIDE // 64), np.uint64)
    for k, j in enumerate(long):
        bit = (mix(lines.token[lines.ptr[j] : lines.ptr[j + 1]]) >> np.uint64(54)).astype(np.int64)
        odd = np.flatnonzero(np.bincount(bit, minlength=WIDE) & 1)
        np.bitwise_or.at(wide[k], odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return {
        "wide": wide[np.searchsorted(long, i[size[i] >= LONG])], "before": own.before, "between": own.between,
        "key": own.key, "name": names[i], "size": size[i].astype(np.uint32), "at": np.minimum(own.place, 255).astype(np.uint8),
        "doc": doc[lines.row[i]], "line": lines.number[i].astype(np.uint32), "bits0": low[i], "bits1": high[i],
    }


def new_lines(lines: Lines, doc: np.ndarray, earliest: dict[int, tuple[int, int]], names: np.ndarray | None = None) -> np.ndarray:
    """Which lines have no copy before them among these lines and the earlier ones of this task, whose places `earliest` has."""
    names = lines.names()[0] if names is None else names
    of = doc[lines.row]
    order = np.argsort(names)
    copy = np.append(False, names[order][1:] == names[order][:-1])
    if copy.any():
        again = copy | np.append(copy[1:], False)
        some = order[again]
        some = some[np.lexsort((lines.number[some], of[some], names[some]))]
        order = np.concatenate([order[~again], some[np.append(True, names[some][1:] != names[some][:-1])]])
    own = np.sort(order)
    out = np.ones(len(own), bool)
    for i, name, at in zip(range(len(own)), names[own].tolist(), zip(of[own].tolist(), lines.number[own].tolist())):
        if (old := earliest.get(name)) is None:
            if len(earliest) < 1_000_000:  # copies sent again are told apart later
                earliest[name] = at
        elif at < old:
            earliest[name] = at
        else:
            out[i] = False
    return own[out]


def indexed(rows: DataFrame, counts: np.ndarray, threshold: float, buckets: int) -> DataFrame:
    """bucket and packed entries of all lines."""
    shared = rows.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, table = Splitter(), shared.value
        held: list[dict[str, np.ndarray]] = []
        total, earliest = 0, {}

        def send() -> pa.RecordBatch:
            whole = {k: np.concatenate([h[k] for h in held]) for k in [*(k for k, _ in FIELDS), "wide"]}
            bucket = ((whole["key"].astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(edge))
            columns = {}
            for k, _ in FIELDS:
                values = whole[k][order]
                columns[k] = pa.array([encoded(values[edge[b] : edge[b + 1]], WIDTH.get(k)) for b in used], pa.binary())
            long = whole["size"] >= LONG
            wide, at = whole["wide"][(np.cumsum(long) - 1)[order[long[order]]]], np.append(0, np.cumsum(long[order]))[edge]
            columns["wide"] = pa.array([wide[at[b] : at[b + 1]].tobytes() for b in used], pa.binary())
            return pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32())} | columns)

        for batch in batches:
            for part in slices(batch, "text"):
                doc = np.asarray(part.column("doc_id").fill_null(LAST))
                for lines in lines_of(part.column("text"), splitter):
                    names, _ = lines.names()
                    own = new_lines(lines, doc, earliest, names)
                    if not len(own):
                        continue
                    lines = lines.only(own)
                    held.append(entries(lines, names[own], doc, table, threshold))
                    total += len(held[-1]["key"])
                    if total > SENT:
                        yield send()
                        held, total = [], 0
        if total:
            yield send()

    return rows.select("doc_id", "text").mapInArrow(index, "bucket int, " + ", ".join(f"{k} binary" for k, _ in FIELDS) + ", wide binary")


def candidates(index: DataFrame, threshold: float, keep: int) -> DataFrame:
    """later, earlier (names of lines), later_doc, earlier_doc (of the first occurrences) and more (whether some were held back): pairs that pass the length and
    positional filters and whose bit patterns allow the overlap, each under the first key that they share, as many for each entry as RISK and `keep` ask for.
    With the first one go the next HELD of those held back, packed (`names`, `docs`); `beyond` tells whether there are more still."""
    chance = chances()

    def search(table: pa.Table) -> pa.Table:
        x = {k: np.concatenate([decoded(v, kind, WIDTH.get(k)) for v in table[k].to_pylist()]) for k, kind in FIELDS}
        wide = np.frombuffer(b"".join(table["wide"].to_pylist()), np.uint64).reshape(-1, WIDE // 64)
        long = np.cumsum(x["size"] >= LONG) - 1
        # of the entries of one line and key the earliest occurrence
        high = x["key"].astype(np.uint64) << np.uint64(32)
        rough = high | x["name"] >> np.uint64(32)
        order = np.argsort(rough)
        group = np.cumsum(np.append(True, rough[order][1:] != rough[order][:-1])) - 1
        count = np.bincount(group)[group]
        if (count > 1).any():
            often = np.flatnonzero(count > 1)
            often = often[np.lexsort((x["line"][order[often]], x["doc"][order[often]], x["name"][order[often]], x["key"][order[often]]))]
            first = np.append(True, (x["key"][order[often]][1:] != x["key"][order[often]][:-1]) | (x["name"][order[often]][1:] != x["name"][order[often]][:-1]))
            order = np.concatenate([order[count == 1], order[often[first]]])
        order = order[np.argsort(high[order] | x["size"][order])]
        size, at = x["size"][order].astype(np.int64), x["at"][order]
        doc, line, name, low, high, before, between = (x[k][order] for k in ("doc", "line", "name", "bits0", "bits1", "before", "between"))
        long = long[order]
        # an entry goes with those behind it under its key, of sets that are not too large for its own
        key = x["key"][order].astype(np.uint64) << np.uint64(32)
        largest = np.minimum(np.floor((size + 1e-9) / threshold), (1 << 32) - 1).astype(np.uint64)
        room = np.searchsorted(key | size.astype(np.uint64), key | largest, "right") - np.arange(len(size)) - 1
        edge = np.append(0, np.cumsum(room))
        del x, key, largest
        found: list[tuple[np.ndarray, ...]] = []
        held, most_held, spare, lo = 0, PAIRS, HELD, 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + TRIED, "right")) - 1)
            count, each = room[lo:hi], np.arange(lo, hi)
            b = np.arange(edge[lo], edge[hi]) + np.repeat(each + 1 - edge[lo:hi], count)
            # the overlap that the pair needs, and what positions and bits leave of it
            both = np.repeat(size[lo:hi], count) + size[b]
            most = both - 2 * np.ceil(both * (threshold / (1 + threshold)) - 1e-9).astype(np.int64)
            good = np.flatnonzero(np.bitwise_count(np.repeat(low[lo:hi], count) ^ low[b]) <= most)
            a, b, most = np.repeat(each, count)[good], b[good], most[good]
            lo = hi
            # under this key for the first time
            good = (before[a] != before[b]) | (before[b] == 0)
            good &= (between[a] != between[b]) | (between[b] == 0)
            good &= name[a] != name[b]
            a, b, most = a[good], b[good], most[good]
            apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
            good = (apart <= most) & ((at[a].astype(np.int64) + at[b] <= most) | (at[a] == 255) | (at[b] == 255))
            sure = np.flatnonzero(good & (size[a] >= LONG))  # a is the shorter line
            for i in range(0, len(sure), 50_000):
                own = sure[i : i + 50_000]
                apart[own] = np.bitwise_count(wide[long[a[own]]] ^ wide[long[b[own]]]).sum(1)
                good[own] = apart[own] <= most[own]
            a, b, apart, most = a[good], b[good], apart[good], most[good]
            swap = (doc[a] < doc[b]) | ((doc[a] == doc[b]) & ((line[a] < line[b]) | ((line[a] == line[b]) & (name[a] < name[b]))))
            late, early = np.where(swap, b, a), np.where(swap, a, b)
            if len(late):
                found.append(tuple(v.astype(np.int32) for v in (late, early, apart, most)))
                held += len(late)
            if held > most_held:
                # one more than can be kept is enough to know that there are more
                best, passed, further = nearest_first(found, chance, size, keep, spare)
                if np.count_nonzero(passed | further) > MOST:
                    spare, further = 0, np.zeros(len(passed), bool)
                first = np.append(True, best[0][1:] != best[0][:-1])
                going = passed | further
                found = [tuple(v[going | np.append(False, going[:-1]) & ~first] for v in best)]
                held = len(found[0][0])
                most_held = max(PAIRS, 2 * held)
        if not found:
            return pa.Table.from_batches([], schema=ARROW_PAIRS)
        (late, early, _, _), passed, further = nearest_first(found, chance, size, keep, spare)
        start = np.flatnonzero(np.append(True, late[1:] != late[:-1]))
        line_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(late))))[passed]
        more, beyond = (np.logical_or.reduceat(v, start)[line_of] for v in (~passed, ~passed & ~further))
        # those kept go with the first one passed on
        kept_of = np.zeros(len(line_of), np.int64)
        kept_of[np.cumsum(passed)[start] - 1] = np.add.reduceat(further, start, dtype=np.int64)
        names, docs = (packed(v[early[further]], np.append(0, np.cumsum(kept_of))) for v in (name, doc))
        late, early = late[passed], early[passed]
        return pa.Table.from_arrays([pa.array(v) for v in (name[late].view(np.int64), name[early].view(np.int64), doc[late], doc[early], more, beyond, names, docs)], schema=ARROW_PAIRS)

    return index.groupBy("bucket").applyInArrow(search, "later long, earlier long, later_doc long, earlier_doc long, more boolean, beyond boolean, names binary, docs binary")


ARROW_PAIRS = pa.schema([*[(c, pa.int64()) for c in ("later", "earlier", "later_doc", "earlier_doc")], ("more", pa.bool_()), ("beyond", pa.bool_()), ("names", pa.binary()), ("docs", pa.binary())])


@cache
def chances() -> np.ndarray:
    """For two patterns of 128 bits, by the bits that differ and the most words that may: how likely no more words differ,
    if any number of them is as likely as any other."""
    likely = np.zeros((2 * PATTERN + 1, PATTERN + 1))  # of so many differing bits, by differing words
    likely[0, 0] = 1
    bits = np.arange(PATTERN + 1)
    for n in range(2 * PATTERN):
        likely[n + 1, 1:] = likely[n, :-1] * (1 - bits[:-1] / PATTERN)
        likely[n + 1, :-1] += likely[n, 1:] * (bits[1:] / PATTERN)
    return (np.cumsum(likely, 0) / np.maximum(likely.sum(0), 1e-300)).T


def nearest_first(found: list[tuple[np.ndarray, ...]], chance: np.ndarray, size: np.ndarray, keep: int, spare: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pairs (later, earlier, apart, most) by later line, the nearest first, whether each one is passed on, and whether it is kept for the case that no such one matches."""
    late, early, apart, most = (np.concatenate(v) for v in zip(*found))
    # in wide patterns, half of the bits that may differ differ: next to certainly a match
    wide = np.minimum(size[late], size[early]) >= LONG
    match = np.where(wide, 2 * apart <= most, chance[np.minimum(apart, PATTERN), np.minimum(most, 2 * PATTERN)])
    order = np.lexsort((early, -match, late))
    late = late[order]
    start = np.flatnonzero(np.append(True, late[1:] != late[:-1])) if len(late) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(late)))
    number = np.arange(len(late)) - np.repeat(start, count)
    none = np.append(0, np.cumsum(np.log1p(-np.minimum(match[order], 1 - 1e-6))))[:-1]  # of those before it matches
    none -= np.repeat(none[start], count)
    passed = (none > np.log(RISK)) & (number < keep)
    if not len(late):
        return [late, early, apart, most], passed, passed
    sent = np.add.reduceat(passed, start, dtype=np.int64)
    # where those passed on leave no doubt, none are kept
    room = np.where(none[np.minimum(start + sent, start + count - 1)] > np.log(SURE), spare, 0)
    further = ~passed & (number < np.repeat(sent + room, count))
    return [late, early[order], apart[order], most[order]], passed, further


def unfolded(held: DataFrame) -> DataFrame:
    """later, earlier, later_doc and earlier_doc of the candidates that were packed."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ptr = unpacked(batch.column("names"), np.int64)
            docs, _ = unpacked(batch.column("docs"), np.int64)
            own = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ptr)))
            yield pa.RecordBatch.from_arrays([batch.column("later").take(own), pa.array(names), batch.column("later_doc").take(own), pa.array(docs)], ["later", "earlier", "later_doc", "earlier_doc"])

    return held.mapInArrow(unfold, "later long, earlier long, later_doc long, earlier_doc long")


def sets_of(rows: DataFrame, named: DataFrame, few: bool = False) -> DataFrame:
    """name and packed words of the lines so named, once each, read again from the texts with the given id (`name`, `doc`). Others may come along.
    With `few` the ids are counted, and up to FEW are broadcast, so that no other text gets to Python."""
    docs = named.select("doc").distinct()
    few = docs.limit(FEW + 1).count() <= FEW if few else False
    if few:
        rows = rows.join(F.broadcast(docs), F.coalesce("doc_id", F.lit(int(LAST))) == F.col("doc"), "left_semi")
    shared = rows.sparkSession.sparkContext.broadcast((np.ones(CELLS, bool) if few else name_table(named.select("doc")) > 0, name_table(named.select("name")) > 0))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen = Splitter(), set()
        docs, names = shared.value

        def wanted(cells: np.ndarray, values: np.ndarray) -> np.ndarray:
            return np.flatnonzero(cells[(mix(values.view(np.uint64)) >> np.uint64(44)).astype(np.int64)])

        for batch in batches:
            batch = batch.take(pa.array(wanted(docs, np.asarray(batch.column("doc_id").fill_null(LAST)))))
            for part in slices(batch, "text"):
                for lines in lines_of(part.column("text"), splitter):
                    first, _ = lines.names()
                    own = wanted(names, first)
                    _, once = np.unique(first[own], return_index=True)
                    own = [i for i in own[once] if first[i] not in seen]
                    if len(seen) < 1_000_000:
                        seen.update(first[own])
                    yield pa.RecordBatch.from_pydict({"name": first[own].view(np.int64), "words": pa.array([lines.token[lines.ptr[i] : lines.ptr[i + 1]].tobytes() for i in own], pa.binary())})

    return rows.select("doc_id", "text").mapInArrow(gather, "name long, words binary").groupBy("name").agg(F.first("words").alias("words"))


def verified(pairs: DataFrame, threshold: float) -> DataFrame:
    """later and earlier of the pairs whose packed words `a` and `b` have a Jaccard similarity of `threshold` or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield batch.filter(pa.array(good, pa.bool_())).select(["later", "earlier"])

    return pairs.select("later", "earlier", "a", "b").mapInArrow(verify, "later long, earlier long")


def keyed(rows: DataFrame, counts: np.ndarray, threshold: float, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """key, name, size, words, before, between and bit pattern of the entries of lines, given by their texts (`text`) or by their `words`;
    `wanted` are tables in which the cells of the wanted lines' keys and words are not 0."""
    by = rows.columns[0]
    shared = rows.sparkSession.sparkContext.broadcast((np.minimum(counts, (1 << 32) - 1).astype(np.uint32), None if wanted is None else [x > 0 for x in wanted]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, seen, sent = Splitter(), set(), []
        table, cells = shared.value
        table = table.astype(np.int64)
        for batch in batches:
            for part in slices(batch, by) if by == "text" else [batch]:
                for lines in lines_of(part.column(by), splitter) if by == "text" else sets_in(part.column(by)):
                    if cells is not None:  # a match holds enough of the words
                        held = lines.sums(cells[1][(lines.token >> np.uint64(24)).astype(np.int64)].astype(np.int64))
                        lines = lines.only(np.flatnonzero(held >= required(np.diff(lines.ptr), threshold)))
                    if not len(lines.row):
                        continue
                    own = keys(lines, table, threshold)
                    names, size = lines.names()[0].view(np.int64), np.diff(lines.ptr)
                    low, high = (x.view(np.int64) for x in lines.pattern())
                    for j in np.flatnonzero(cells[0][own.key >> np.uint32(12)]) if cells is not None else range(len(own.key)):
                        i, key = own.line[j], int(own.key[j])
                        if (key, int(names[i])) in seen:
                            continue
                        if len(seen) < 1_000_000:  # others are found alike later
                            seen.add((key, int(names[i])))
                        sent.append((key, int(names[i]), int(size[i]), lines.token[lines.ptr[i] : lines.ptr[i + 1]].tobytes(), int(own.before[j].view(np.int64)), int(own.between[j].view(np.int64)), int(low[i]), int(high[i])))
                        if len(sent) >= SENT_WORDS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent), ARROW_KEYED)], schema=ARROW_KEYED)
                            sent.clear()
        if sent:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sent), ARROW_KEYED)], schema=ARROW_KEYED)

    return rows.select(by).mapInArrow(index, "key long, name long, size int, words binary, before long, between long, bits0 long, bits1 long")


SENT_WORDS = 4096
ARROW_KEYED = pa.schema([("key", pa.int64()), ("name", pa.int64()), ("size", pa.int32()), ("words", pa.binary()), ("before", pa.int64()), ("between", pa.int64()), ("bits0", pa.int64()), ("bits1", pa.int64())])


def sets_in(words: pa.Array) -> Iterator[Lines]:
    """Lines given by their packed words."""
    token, ptr = unpacked(words, np.uint64)
    if len(words):
        n = len(ptr) - 1
        yield Lines(np.arange(n), np.zeros(n, np.int64), ptr, token, np.repeat(np.arange(n), np.diff(ptr)))


def wanted_cells(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tables in which the cells of the keys and of the words of the given entries are not 0."""

    def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += np.bincount(np.asarray(batch.column(0)) >> 12, minlength=CELLS)
        yield chunks_of(counts)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += np.bincount((unpacked(batch.column(0), np.uint64)[0] >> np.uint64(24)).astype(np.int64), minlength=CELLS)
        yield chunks_of(counts)

    found = [own.select(c).mapInArrow(f, "chunk int, part int, counts binary") for c, f in (("key", count_keys), ("words", count_words))]
    return table_of(found[0]), table_of(found[1])


def earlier_matches(rows: DataFrame, lines: DataFrame, first: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """Of the given lines (name, words) those that an earlier line matches: all lines that share a key with one of them come with
    their words, each pair is verified where it is joined, and of those that match the earlier line is told by its first place."""
    own = kept(keyed(lines.select("words"), counts, threshold), "open-keys")
    others = keyed(rows.select("text"), counts, threshold, wanted_cells(own)).dropDuplicates(["key", "name"])
    a, b = (x.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "size", "words", "before", "between", "bits0", "bits1")]) for x, s in ((others, "a"), (own, "b")))
    fits = F.col("name_a") != F.col("name_b")
    fits &= (F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - 1e-9)
    for c in ("before", "between"):
        fits &= (F.col(f"{c}_a") != F.col(f"{c}_b")) | (F.col(f"{c}_b") == 0)
    both = F.col("size_a") + F.col("size_b")
    most = both - 2 * F.ceil(both * F.lit(threshold / (1 + threshold)) - 1e-9)
    fits &= F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) + F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b"))) <= most
    pairs = a.join(b, "key").where(fits).select(F.col("name_b").alias("later"), F.col("name_a").alias("earlier"), F.col("words_a").alias("a"), F.col("words_b").alias("b"))
    pairs = kept(verified(pairs, threshold).distinct(), "open-pairs")
    place = F.struct(F.col("doc_id").alias("doc"), F.col("number"), F.col("name").bitwiseXOR(F.lit(-(1 << 63))).alias("tie"))
    for c in ("later", "earlier"):
        pairs = pairs.join(first.select(F.col("name").alias(c), place.alias(f"{c}_at")), c)
    return pairs.where("earlier_at < later_at").select("later").distinct()


def matches(rows: DataFrame, pairs: DataFrame, threshold: float, few: bool = False) -> DataFrame:
    """Those `later` lines of the pairs that match the `earlier` one."""
    named = pairs.select(F.col("later").alias("name"), F.col("later_doc").alias("doc")).unionByName(pairs.select(F.col("earlier").alias("name"), F.col("earlier_doc").alias("doc")))
    sets = sets_of(rows, named, few)
    both = pairs.join(sets.select(F.col("name").alias("earlier"), F.col("words").alias("a")), "earlier").join(sets.select(F.col("name").alias("later"), F.col("words").alias("b")), "later")
    return verified(both, threshold).select("later").distinct()


def repeated_lines(rows: DataFrame, first: DataFrame, counts: np.ndarray, threshold: float) -> DataFrame:
    """The names of lines that an earlier line of another name matches; `rows` has doc_id (long) and text, `first` is `first_lines`."""
    spark = rows.sparkSession
    index = indexed(rows, counts, threshold, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = kept(candidates(index, threshold, KEEP), "line-candidates")
    done = kept(matches(rows, found, threshold), "line-matches")
    # lines of which candidates were held back, while none of those passed on matches
    open_ = kept(found.where("more").select("later", "later_doc").distinct().join(done, "later", "left_anti"), "open-names")
    if open_.isEmpty():
        return done.select(F.col("later").alias("name"))
    held = found.where("octet_length(names) > 0").join(open_, ["later", "later_doc"], "left_semi")
    further = kept(matches(rows, kept(unfolded(held).distinct(), "held-candidates"), threshold, True), "line-matches")
    done = done.unionByName(further)
    # and those of which there are more than were kept
    open_ = kept(found.where("beyond").select("later", "later_doc").join(open_, ["later", "later_doc"], "left_semi").distinct().join(further, "later", "left_anti"), "open-names")
    open_ = open_.select(F.col("later").alias("name"), F.col("later_doc").alias("doc"))
    if not open_.isEmpty():
        open_ = kept(sets_of(rows, open_, True).join(open_, "name", "left_semi"), "open-lines")
        done = done.unionByName(kept(earlier_matches(rows, open_, first, counts, threshold), "line-matches"))
    return done.select(F.col("later").alias("name"))


def first_lines(found: DataFrame) -> DataFrame:
    """name, doc_id, text_hash and number of the first occurrence of every line with words, from the places of the census. A null id is LAST."""

    def first(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8).reshape(5, -1) for x in table["places"].to_pylist()]
        name, more, doc, digest, number = (np.concatenate([decoded(x[k].tobytes(), kind) for x in parts]) for k, kind in enumerate((np.uint64, np.uint64, np.int64, np.int64, np.int64)))
        order = np.argsort(name)
        again = np.append(False, name[order][1:] == name[order][:-1])
        again |= np.append(again[1:], False)
        some = order[again]
        some = some[np.lexsort((digest[some], number[some], doc[some], more[some], name[some]))]
        some = some[np.append(True, (name[some][1:] != name[some][:-1]) | (more[some][1:] != more[some][:-1]))[: len(some)]]
        own = np.concatenate([order[~again], some])
        return pa.table({"name": name[own].view(np.int64), "doc_id": doc[own], "text_hash": digest[own], "number": number[own]})

    return found.groupBy("bucket").applyInArrow(first, "name long, doc_id long, text_hash long, number long")


def unused(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it as long as a column is called so."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, without the lines that match an earlier one; hl_lines and hl_removed count lines with words before and those gone.

    Lines end at a newline; a line is its set of words (A-Z lower-cased, between white space, told apart by 44 bits of a hash).
    A line goes if an earlier line, itself kept or not, has a Jaccard similarity of `threshold` or more with it. Earlier is the
    smaller (doc_id, line number, hash of the text), null ids last. Lines without words stay. Rows alike in id and text are one
    document and come out alike; a null text stays null, one that has lost all lines with words becomes empty.

    Equal sets are one line from the start. Words are ordered by rarity (counts over the whole corpus in a table of fixed size; any order gives
    exact results), each line enters the index under the words of its prefix, and length and positional filters and a
    128-bit pattern of the sets leave the candidates. Index buckets are hash ranges, hot words are split by a second word, and an entry hands
    on its nearest earlier candidates until one next to certainly matches; the few lines that these leave open are joined with all that share a key with them.

    A column of `docs` named hl_lines or hl_removed, in whatever case, gives way to the new one; any other name may stand in `docs`.
    """
    docs = docs.select(*[col(c) for c in docs.columns if c.lower() not in ("hl_lines", "hl_removed") or c in (doc_id, text)])
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("text_hash"))
    found = census(rows, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = table_of(found.where("chunk is not null").select("chunk", "part", "counts"))
    first = kept(first_lines(found.where("bucket is not null").select("bucket", "places")), "first-lines")
    first = first.join(repeated_lines(rows, first, counts, threshold), "name", "left_anti")
    staying = first.groupBy("doc_id", "text_hash").agg(F.collect_list("number").alias("hl_numbers"))
    of, digest, numbers = (unused(c, docs.columns) for c in ("hl_of", "hl_hash", "hl_numbers"))
    staying = staying.select(F.col("doc_id").alias(of), F.col("text_hash").alias(digest), F.col("hl_numbers").alias(numbers))
    # a document's numbers are one row, so no part of `staying` is large; texts need not be sorted
    joined = docs.join(staying.hint("shuffle_hash"), (F.coalesce(col(doc_id).cast("long"), F.lit(int(LAST))) == F.col(of)) & (F.xxhash64(col(text)) == F.col(digest)), "left")
    joined = joined.select(*[col(c) for c in docs.columns], numbers)
    at, names = docs.columns.index(text), docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, before, gone = [], [], []
            for x, numbers in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                lines, stay = (x or "").split("\n"), set(numbers or [])
                filled = [bool(y.strip(" \t\n\r\x0b\x0c")) for y in lines]
                texts.append(None if x is None else x if len(stay) == sum(filled) else "\n".join(y for i, y in enumerate(lines) if i in stay or not filled[i]) if stay else "")
                before.append(sum(filled))
                gone.append(sum(filled) - len(stay))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*names, "hl_lines", "hl_removed"])

    schema = StructType([*docs.schema.fields, StructField("hl_lines", LongType()), StructField("hl_removed", LongType())])
    return joined.mapInArrow(cut, schema)

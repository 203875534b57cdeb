"""Runs: stretches of words that repeat with a short period, found by scale and by tile and stitched by document and period.

Periods are taken by octave: s <= p < 2s, s a power of two. Two words p apart that are equal make a link; a run of period p is a stretch of
links and the p words after it. A run of three periods or more has a link on a multiple of s whose next s links hold too. So only the
boundaries at multiples of s are looked at: the values of their Z-functions, forward and backward, say for each p how far the text from the
boundary agrees with the text p words on. They are found for all boundaries of a tile and all p together, by comparing hashes of windows that
halve, and no further than the next boundaries, so that a tile depends on 5s words around it alone. What boundaries and tiles
find of one stretch overlaps, and is put together by (document, period).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import col, kept
from .words import Splitter, mix, packed, slices, unpacked

TILE = 1 << 14  # words: a longer document is cut into tiles of this core, or of eight times s where that is more
PAIRS = 1 << 20  # (boundary, period) pairs compared at once
FRAGMENT = "array<struct<period: long, start: long, stop: long>>"
RUN = "struct<start: long, period: long, length: long>"


@dataclass
class Tiles:
    """Stretches of words side by side: codes[ptr[i]:ptr[i + 1]] are the words of tile i, from word `origin` of a text of `size` words."""

    codes: np.ndarray
    ptr: np.ndarray
    origin: np.ndarray
    size: np.ndarray
    core: np.ndarray  # first word of those whose boundaries are the tile's own
    stop: np.ndarray  # word behind them
    low: np.ndarray  # octaves, from low to high
    high: np.ndarray

    @staticmethod
    def whole(codes: np.ndarray, ptr: np.ndarray) -> Tiles:
        n = np.diff(ptr)
        zero = np.zeros_like(n)
        return Tiles(codes, ptr, zero, n, zero, n, zero, np.full_like(n, 62))


class Agreement:
    """Compares stretches of codes by 64-bit hashes."""

    def __init__(self, splitter: Splitter, codes: np.ndarray):
        self.up, self.down = splitter.powers(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.up[: len(codes)], out=self.total[1:])

    def windows(self, size: int) -> np.ndarray:
        """The hash of `size` codes from each place that has them."""
        n = len(self.total) - size
        return (self.total[size:] - self.total[:n]) * self.down[:n]

    def same(self, at: np.ndarray, apart: np.ndarray, size: int) -> np.ndarray:
        there = at + apart
        return (self.total[at + size] - self.total[at]) * self.up[apart] == self.total[there + size] - self.total[there]

    def reach(self, at: np.ndarray, apart: np.ndarray, most: int, room: np.ndarray, back: bool) -> np.ndarray:
        """How many links, up to `most` (a power of two) and `room`, follow `at`, or come before it."""
        got = np.zeros(len(at), np.int64)
        step = most
        while step:
            fits = np.flatnonzero((got + step <= most) & (got + step <= room))
            from_ = at[fits] - got[fits] - step if back else at[fits] + got[fits]
            got[fits[self.same(from_, apart[fits], step)]] += step
            step //= 2
        return got


def octave(tiles: Tiles, agree: Agreement, k: int, least: int) -> tuple[np.ndarray, ...]:
    """(tile, period, boundary, links before, links after) of the boundaries of octave k with s links after them; `least` periods make a run."""
    s = 1 << k
    used = np.flatnonzero((tiles.low <= k) & (k <= tiles.high) & (tiles.size >= least * s))
    first = -(-tiles.core[used] // s)
    count = np.maximum(0, -(-tiles.stop[used] // s) - first)
    tile = np.repeat(used, count)
    number = np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    at = number * s - tiles.origin[tile] + tiles.ptr[tile]
    end = tiles.ptr[tile + 1]
    keep = at + 2 * s <= end
    tile, at, end = tile[keep], at[keep], end[keep]
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    window, periods, found = agree.windows(s), np.arange(s, 2 * s), []
    rows = max(1, PAIRS // s)
    for a in range(0, len(at), rows):
        here, top = at[a : a + rows, None], np.minimum(end[a : a + rows] - s, at[a : a + rows] + tiles.size[tile[a : a + rows]] // least)[:, None]
        there = here + periods
        hit = np.nonzero((window[np.minimum(there, len(window) - 1)] == window[here]) & (there <= top))
        found.append((hit[0] + a, hit[1] + s))
    which, period = (np.concatenate(x) for x in zip(*found))
    tile, at, end = tile[which], at[which], end[which]
    after = s + agree.reach(at + s, period, s, end - period - at - s, False)
    before = agree.reach(at, period, s, at - tiles.ptr[tile], True)
    return tile, period, at, before, after


def fragments(tiles: Tiles, splitter: Splitter, least: int, words: int) -> tuple[np.ndarray, ...]:
    """(tile, period, first link, link behind the last), in words of the text, of the stretches of links that make runs of `least` periods
    and `words` words, or that a neighbouring tile may go on with."""
    agree, out = Agreement(splitter, tiles.codes), []
    k = 0
    while len(tiles.size) and least << k <= tiles.size.max():
        tile, period, at, before, after = octave(tiles, agree, k, least)
        order = np.lexsort((at, period, tile))
        tile, period, start, stop = tile[order], period[order], (at - before)[order], (at + after)[order]
        open_left, open_right = (before == 1 << k)[order], (after == 2 << k)[order]
        new = np.ones(len(tile), bool)
        new[1:] = (tile[1:] != tile[:-1]) | (period[1:] != period[:-1]) | (start[1:] > stop[:-1])
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(tile)) - 1 if len(tile) else begin
        tile, period, start, stop = tile[begin], period[begin], start[begin], stop[last]
        cut_left = open_left[begin] | ((start == tiles.ptr[tile]) & (tiles.origin[tile] > 0))
        cut_right = open_right[last] | ((stop + period == tiles.ptr[tile + 1]) & (tiles.origin[tile] + tiles.ptr[tile + 1] - tiles.ptr[tile] < tiles.size[tile]))
        good = cut_left | cut_right | (stop - start + period >= np.maximum(words, least * period))
        shift = (tiles.origin - tiles.ptr[:-1])[tile]
        out.append(tuple(x[good] for x in (tile, period, start + shift, stop + shift)))
        k += 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def cut(n: int, least: int, tile: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(low, high, core, stop, from, to) of the tiles of a text of n words, by octave; the octaves of s up to a sixteenth of `tile` share tiles."""
    low = 0
    while least << low <= n:
        high = max(low, (tile // 16).bit_length() - 1) if low == 0 else low
        s, core = 1 << high, max(tile, 8 << high)
        for a in range(0, n, core):
            yield low, high, a, min(n, a + core), max(0, a - s), min(n, a + core + 4 * s)
        low = high + 1


def _lists(tile: np.ndarray, n: int, **values: np.ndarray) -> pa.Array:
    """A list of structs for each of n rows; `tile` ascends."""
    offsets = np.searchsorted(tile, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in values.values()], list(values)))


def find_runs(docs: DataFrame, carry: list[str], text: str = "text", least: int = 4, words: int = 6, tile: int = TILE) -> DataFrame:
    """`carry`, hl_words (number of words), hl_runs (start, period, length of every run, in that order) and hl_digest (SHA-256 of the words
    that `collapsed` keeps, with one space between) for each row of `docs`.

    A run is a stretch of words of smallest period q, at least `least` (3 or more) times q and `words` long, that no neighbour extends. Words are
    compared as they stand; null counts as an empty text. Rows, repeated ones too, come back one for one; columns not carried don't matter.
    Texts of up to `tile` words are solved where they are read; those longer go out in tiles of words by octave. Only texts with
    runs are moved, to be collapsed. The hash that compares words is 64 bits wide.
    """
    if least < 3:
        raise ValueError("runs are found from three periods on")
    rows = docs.select(*[col(c) for c in carry], col(text).cast("string").alias("hl_text"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields[:-1]}
    own = "".join(f"`{c}` {t}, " for c, t in types.items())
    tile_part = "hl_low long, hl_high long, hl_core long, hl_stop long, hl_from long, hl_codes binary"
    schema = own + f"hl_row long, hl_text string, hl_words long, hl_digest string, hl_found {FRAGMENT}, " + tile_part

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for part in slices(batch, "hl_text"):
                raw = part.column("hl_text").cast(pa.binary()).to_pylist()
                texts = [(t or b"").split() for t in raw]
                n = np.array([len(t) for t in texts])
                codes = np.asarray(pa.array(chain.from_iterable(texts), pa.binary()).dictionary_encode().indices).astype(np.int64)
                ptr = np.append(0, np.cumsum(n))
                short = np.flatnonzero(n <= tile)
                inside = np.repeat(n <= tile, n)
                at, period, start, stop = fragments(Tiles.whole(codes[inside], np.append(0, np.cumsum(n[short]))), splitter, least, words)
                order = np.argsort(at, kind="stable")
                owner = short[at[order]]
                found = _lists(owner, len(n), period=period[order], start=start[order], stop=stop[order])
                needed = (n > tile) | (np.bincount(owner, minlength=len(n)) > 0)
                none = pa.nulls(len(n), pa.int64())
                made = dict(zip(part.schema.names, part.columns)) | {
                    "hl_text": pa.array([t if used else None for t, used in zip(raw, needed)], pa.binary()).cast(pa.string()),
                    "hl_words": pa.array(n), "hl_digest": pa.array([sha256(b" ".join(t)).hexdigest() for t in texts]), "hl_found": found,
                    "hl_low": none, "hl_high": none, "hl_core": none, "hl_stop": none, "hl_from": none, "hl_codes": pa.nulls(len(n), pa.binary())}
                yield pa.RecordBatch.from_pydict(made).select(names)
                for i in np.flatnonzero(n > tile):
                    for low, high, core, end, a, b in cut(int(n[i]), least, tile):
                        one = {name: pa.nulls(1, made[name].type) for name in names} | {"hl_row": part.column("hl_row").slice(i, 1), "hl_words": pa.array([n[i]])}
                        one |= {k: pa.array([v]) for k, v in zip(("hl_low", "hl_high", "hl_core", "hl_stop", "hl_from"), (low, high, core, end, a))}
                        yield pa.RecordBatch.from_pydict(one | {"hl_codes": packed(codes[ptr[i] + a : ptr[i] + b].astype(np.int32))})

    names = [*carry, "hl_row", "hl_text", "hl_words", "hl_digest", "hl_found", "hl_low", "hl_high", "hl_core", "hl_stop", "hl_from", "hl_codes"]
    seen = kept(rows.withColumn("hl_row", F.monotonically_increasing_id()).mapInArrow(read, schema), "run-fragments")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter()
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                codes, ptr = unpacked(part.column("hl_codes"), np.int32)
                value = {c: np.asarray(part.column(c)) for c in batch.schema.names if c != "hl_codes"}
                tiles = Tiles(codes, ptr, *(value[f"hl_{c}"] for c in ("from", "words", "core", "stop", "low", "high")))
                _, period, start, stop = fragments(tiles, splitter, least, words)
                yield pa.RecordBatch.from_pydict({"hl_row": pa.array(np.repeat(value["hl_row"], len(period))), "period": pa.array(period), "start": pa.array(start), "stop": pa.array(stop)})

    tiled = seen.where("hl_codes is not null").select("hl_row", "hl_words", "hl_low", "hl_high", "hl_core", "hl_stop", "hl_from", "hl_codes")
    tiled = tiled.repartition("hl_row", "hl_low", "hl_core").mapInArrow(solve, "hl_row long, period long, start long, stop long")
    texts = seen.where("hl_codes is null")
    pieces = texts.select("hl_row", F.explode("hl_found").alias("f")).select("hl_row", "f.*").unionByName(tiled)
    runs = stitched(pieces, least, words)
    joined = texts.select("hl_row", *carry, "hl_words", "hl_digest", "hl_text").join(runs, "hl_row", "left")
    return collapsed(joined, carry, own)


def stitched(pieces: DataFrame, least: int, words: int) -> DataFrame:
    """(hl_row, hl_runs): fragments of links that meet, put together by document and period; of equal stretches that of the smallest period stays."""
    line = Window.partitionBy("hl_row", "period").orderBy("start", "stop")
    apart = F.coalesce((F.col("start") > F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))).cast("long"), F.lit(0))
    numbered = pieces.withColumn("new", apart).withColumn("stretch", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("hl_row", "period", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    whole = whole.withColumn("length", F.col("stop") - F.col("start") + F.col("period")).where((F.col("length") >= words) & (F.col("length") >= least * F.col("period")))
    # a period of a stretch this long is a multiple of its smallest one, whose run is the same stretch
    least_ones = whole.groupBy("hl_row", "start", "length").agg(F.min("period").alias("period"))
    return least_ones.groupBy("hl_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("hl_runs"))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those of a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, period, length in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def collapsed(found: DataFrame, carry: list[str], own: str) -> DataFrame:
    """The result of `find_runs`: the texts with runs are collapsed and their digest is made anew."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("hl_digest").to_pylist()
            for i in np.flatnonzero(np.asarray(batch.column("hl_runs").is_valid())):
                text = batch.column("hl_text")[i].as_py().encode().split()
                stays = kept_words(len(text), [tuple(r.values()) for r in batch.column("hl_runs")[i].as_py()])
                digests[i] = sha256(b" ".join([w for w, s in zip(text, stays) if s])).hexdigest()
            columns = {c: batch.column(c) for c in (*carry, "hl_words", "hl_runs")}
            yield pa.RecordBatch.from_pydict(columns | {"hl_digest": pa.array(digests, pa.string())})

    done = found.select(*carry, "hl_words", "hl_runs", "hl_digest", "hl_text").mapInArrow(shrink, own + f"hl_words long, hl_runs array<{RUN}>, hl_digest string")
    return done.withColumn("hl_runs", F.coalesce("hl_runs", F.expr(f"cast(array() as array<{RUN}>)")))



def strongest(runs: Column) -> Column:
    """The run of most periods; of equal ones that of the smallest start, then period; null if there is none."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def lines(runs: Column) -> Column:
    """`start,length,period` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")

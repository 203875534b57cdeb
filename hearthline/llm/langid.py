"""Language of a text and of its spans: script ranges, word scores, Viterbi with a switching penalty."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import col
from .words import Splitter, Words, buffers, slices

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 16  # hashed byte n-grams; the size of the model by language
PENALTY = 8.0  # natural log units that a change of language must gain
UNSURE = -40.0  # how far a word scores below its best candidate in a language that doesn't use its script
SCRIPT_SHARE = 0.001  # a language uses a script if at least this share of its words does
PARTS = 64  # partial counts that one task of the first level adds up

# First code points of the scripts' main Unicode blocks, in order; the last column names the script.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"),
    (0x0780, "thaana"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"),
    (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"),
    (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


class Reader:
    """Letter words of texts, their scripts and the buckets of their n-grams."""

    def __init__(self):
        self.splitter = Splitter()
        # letters and the marks that belong to them, by code point
        self.letter = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
        self.ascii_letter = ascii_letter

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
        """The runs of letters of each text, and each run's script by its first character."""
        ink = self.ascii_letter[data]
        lead = np.flatnonzero(data >= 0xC0)
        point = data
        if len(lead):
            byte = lambda k: data[np.minimum(lead + k, len(data) - 1)].astype(np.int32) & 0x3F
            size = np.select([data[lead] < 0xE0, data[lead] < 0xF0], [2, 3], 4)
            a = data[lead].astype(np.int32)
            code = np.select([size == 2, size == 3], [(a & 0x1F) << 6 | byte(1), (a & 0x0F) << 12 | byte(1) << 6 | byte(2)], (a & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3))
            code = np.minimum(code, sys.maxunicode)
            good = self.letter[code]
            for k in range(4):
                at = lead[size > k] + k
                ok = at < len(data)
                ink[at[ok]] = good[size > k][ok]
            point = np.zeros(len(data), np.int32)
            point[lead] = code
        words = self.splitter(data, offsets, ink)
        return words, SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, point[words.start], "right") - 1]

    def grams(self, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: the buckets of all n-grams, words marked off at both ends, and where each word's begin."""
        size = words.end - words.start
        # all words in one row, a border (0) in front of each and behind the last
        first = np.cumsum(np.append(0, size[:-1] + 1)) + 1 if len(size) else np.zeros(0, np.int64)
        line = np.zeros(int(size.sum() + len(size)) + 4, np.uint32)
        take = np.arange(int(size.sum()))
        source = take - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(first, size) + source] = words.data[np.repeat(words.start, size) + source]
        for n in ORDERS:
            value = np.full(len(line) - n + 1, n, np.uint32)
            for k in range(n):
                value = value * np.uint32(0x01000193) ^ line[k : len(line) - n + 1 + k]
            value *= np.uint32(0x9E3779B1)
            yield value >> np.uint32(32 - BUCKETS.bit_length() + 1), first - 1


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # (orders, buckets, langs): log shares, divided by the number of orders
    uses: np.ndarray  # (scripts, langs)


def word_scores(model: Model, reader: Reader, words: Words, script: np.ndarray) -> np.ndarray:
    """Log score of each word in each language."""
    out = np.zeros((len(words.start), len(model.langs)), np.float32)
    if not len(out):
        return out
    for k, (bucket, first) in enumerate(reader.grams(words)):
        # n-grams that begin in a word's own stretch; the border behind it belongs to the next
        stop = first[-1] + (words.end[-1] - words.start[-1]) + 1
        out += np.add.reduceat(model.weight[k][bucket[:stop]], first, axis=0)
    uses = model.uses[script]
    best = np.where(uses, out, -np.inf).max(1, keepdims=True)
    out = np.where(uses, out, np.float32(UNSURE) + best)
    out[~uses.any(1)] = 0
    return out


def best_path(scores: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word, by text, on the path of the highest sum of scores less `penalty` for each change.

    A text stays in its best single language if no stretch gains more than one penalty by leaving it; the others go
    through Viterbi together, word by word.
    """
    n = np.diff(ptr)
    path = np.zeros(len(scores), np.int64)
    full = np.flatnonzero(n)
    if not len(full) or scores.shape[1] == 1:
        return path
    single = np.add.reduceat(scores.astype(np.float64), ptr[full], axis=0).argmax(1)
    path[:] = np.repeat(single, n[full])
    gain = scores.astype(np.float64)
    own = gain[np.arange(len(path)), path].copy()
    gain[np.arange(len(path)), path] = -np.inf
    gain = gain.max(1) - own
    total = np.concatenate([[0.0], np.cumsum(gain)])
    # running minimum within each text: texts are set apart by more than any sum
    apart = np.repeat(np.arange(len(full)), n[full]) * -(np.abs(gain).sum() + 1)
    low = np.minimum.accumulate(total[:-1] + apart) - apart
    excess = np.maximum.reduceat(total[1:] - low, ptr[full])
    open_ = full[excess > penalty]
    open_ = open_[np.argsort(-n[open_], kind="stable")]
    if len(open_):
        length, first = n[open_], ptr[open_]
        value = scores[first].astype(np.float64)
        back = np.zeros((int(length.sum()), scores.shape[1]), np.int16)
        base = np.cumsum(length) - length
        here = np.arange(scores.shape[1])
        alive = len(open_)
        for t in range(1, int(length[0])):
            alive = int(np.searchsorted(-length, -t, "left"))
            v = value[:alive]
            top = v.argmax(1)
            jump = v[np.arange(alive), top] - penalty
            moved = v < jump[:, None]
            back[base[:alive] + t] = np.where(moved, top[:, None], here)
            value[:alive] = np.where(moved, jump[:, None], v) + scores[first[:alive] + t]
        state = value.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-length, -t, "left"))
            path[first[:alive] + t] = state[:alive]
            state[:alive] = back[base[:alive] + t, state[:alive]]
    return path


def fit(docs: DataFrame, text: str, lang: str) -> Model:
    """Counts of hashed byte n-grams and of scripts by language, over all `docs` that have a text and a language.

    Each task adds up its rows, partial counts are added in two levels; only one row of fixed size for each
    language comes to the driver.
    """
    rows = docs.select(col(text).alias("text"), col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    width = len(ORDERS) * BUCKETS + len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(), {}
        for batch in batches:
            for part in slices(batch, "text"):
                codes = part.column("lang").dictionary_encode()
                values, code = codes.dictionary.to_pylist(), np.asarray(codes.indices)
                words, script = reader.words(*buffers(part.column("text")))
                of_word = code[words.row]
                for c, name in enumerate(values):
                    own = of_word == c
                    if own.any():
                        to = sums.setdefault(name, np.zeros(width, np.int64))
                        mine = Words(words.hash[own], words.row[own], words.ptr, words.start[own], words.end[own], words.data)
                        for k, (bucket, first) in enumerate(reader.grams(mine)):
                            stop = first[-1] + (mine.end[-1] - mine.start[-1]) + 1
                            to[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(bucket[:stop], minlength=BUCKETS)
                        to[len(ORDERS) * BUCKETS :] += np.bincount(script[own], minlength=len(SCRIPT_NAMES))
        if sums:
            part = TaskContext.get().partitionId() // PARTS
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums)), "part": pa.array([part] * len(sums), pa.int64()), "counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(x, np.int64) for x in group["counts"]), np.zeros(width, np.int64))
        return pd.DataFrame({"lang": [key[0]], "part": [0], "counts": [total.tobytes()]})

    schema = "lang string, part long, counts binary"
    sums = rows.mapInArrow(count, schema)
    for by in (["lang", "part"], ["lang"]):
        sums = sums.groupBy(*by).applyInPandas(add, schema)
    found = sorted(sums.collect(), key=lambda r: r["lang"])
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in found]).reshape(len(found), width)
    weight = np.empty((len(ORDERS), BUCKETS, len(found)), np.float32)
    for k in range(len(ORDERS)):
        c = counts[:, k * BUCKETS : (k + 1) * BUCKETS].T + 0.5
        weight[k] = np.log(c / c.sum(0)) / len(ORDERS)
    scripts = counts[:, len(ORDERS) * BUCKETS :]
    return Model([r["lang"] for r in found], weight, (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)).T & (scripts.T > 0))


def identify(docs: DataFrame, model: Model, carry: list[str], text: str = "text", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """The columns `carry`, hl_lang, hl_score and, if asked for, hl_spans (lang, first byte, end byte in UTF-8) of every row of `docs`.

    Words are runs of letters. A word's script leaves the languages that use it; each of these scores the word by its
    byte n-grams, and Viterbi with a penalty for each change labels the words. `hl_lang` is the language of most
    letter bytes, ties to the first name; `hl_score` is its share of all letter bytes, words in scripts that no language
    uses counting against it. `und` and 0 if the text is null, has no letter, or the model no language. Whole texts
    are read, in slices of a few MB or one text. No shuffle; rows, repeated ones too, come back one for one.
    """
    rows = docs.select(*[col(c) for c in carry], col(text).alias("hl_text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.weight, model.uses))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, own = Reader(), Model(*shared.value)
        names = np.array([*own.langs, "und"], object)
        for batch in batches:
            for part in slices(batch, "hl_text"):
                words, script = reader.words(*buffers(part.column("hl_text")))
                weight = np.zeros((part.num_rows, max(1, len(own.langs))))
                found: list = [[] for _ in range(part.num_rows)]
                if own.langs:
                    path = best_path(word_scores(own, reader, words, script), words.ptr, penalty)
                    size = (words.end - words.start).astype(float)
                    known = own.uses[script].any(1)
                    np.add.at(weight, (words.row[known], path[known]), size[known])
                    if spans and len(path):
                        edge = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(words.row, prepend=-1) != 0))
                        origin = buffers(part.column("hl_text"))[1]
                        for a, b in zip(edge, np.append(edge[1:], len(path))):
                            i = words.row[a]
                            found[i].append({"lang": names[path[a]], "start": int(words.start[a] - origin[i]), "end": int(words.end[b - 1] - origin[i])})
                letters = np.bincount(words.row, words.end - words.start, part.num_rows)
                none = (letters == 0) | (not own.langs)
                columns = dict(zip(carry, part.columns)) | {
                    "hl_lang": pa.array(np.where(none, "und", names[weight.argmax(1)]), pa.string()),
                    "hl_score": pa.array(np.where(none, 0.0, weight.max(1) / np.maximum(letters, 1))),
                }
                if spans:
                    columns["hl_spans"] = pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1]) + "hl_lang string, hl_score double"
    return rows.mapInArrow(label, schema + ", hl_spans array<struct<lang: string, start: long, end: long>>" * spans)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
